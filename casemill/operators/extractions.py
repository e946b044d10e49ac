"""Structured extractions stored as JSON text: parsing, validation, reshaping, latest run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.tables import utc_stamp

ELEMENTS = ("material_misrepresentation", "scienter", "connection", "reliance", "economic_loss", "loss_causation")
STATUSES = ("SATISFIED", "NOT_SATISFIED", "CONTESTED", "NOT_ANALYZED")
# The legal conditions of each element.
CONDITIONS = {
    "material_misrepresentation": ["FalseStatements", "MisleadingOmissions", "SchemeToDefraud"],
    "scienter": ["MotiveAndOpportunity", "ConsciousMisbehavior", "RecklessDisregard"],
    "connection": ["InConnectionWithPurchase", "InConnectionWithSale"],
    "reliance": ["FraudOnTheMarket", "DirectReliance", "AffiliateOmission"],
    "economic_loss": ["ActualDamages", "DiminishedValue"],
    "loss_causation": ["CorrectiveDisclosurePriceDrop", "MaterializationOfConcealedRisk"],
}
_ELEMENT = "struct<status:string,sub_conditions:array<string>,key_facts:array<string>,judge_reasoning:string,confidence:double>"
SCHEMA = (
    "struct<case_id:bigint,opinion_id:bigint,procedural_stage:string,outcome:string,statutes_cited:array<string>,precedents_cited:array<string>,"
    f"arguments_plaintiff:array<string>,arguments_defendant:array<string>,elements:map<string,{_ELEMENT}>>"
)


#: what the graph has of an extraction
LINKS = "struct<outcome:string,statutes_cited:array<string>,arguments_plaintiff:array<string>,arguments_defendant:array<string>>"


def parsed(extractions: DataFrame, schema: str = SCHEMA) -> DataFrame:
    """Adds ``x``, the extraction as a struct with a map of elements; null where the JSON is cut off or no object."""
    whole = F.try_parse_json("extraction").isNotNull()
    return extractions.withColumn("x", F.when(whole, F.from_json("extraction", schema, {"mode": "PERMISSIVE"})))


def valid(extractions: DataFrame, schema: str = SCHEMA) -> DataFrame:
    """The rows with is_valid = 1 and whole JSON, each id once; texts are parsed where they lie and don't move."""
    return parsed(extractions.where("is_valid = 1"), schema).where("x is not null").drop("extraction", "llm_raw", "errors").dropDuplicates(["id"])


def latest_valid(extractions: DataFrame) -> DataFrame:
    """The newest row with is_valid = 1 and whole JSON of each opinion; ties by greater id."""
    w = Window.partitionBy("opinion_id").orderBy(F.desc_nulls_last(utc_stamp("created_at")), F.desc("id"))
    good = parsed(extractions.where("is_valid = 1")).where("x is not null").dropDuplicates(["id"])
    return good.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def element_rows(extractions: DataFrame) -> DataFrame:
    """A row per extraction and element: id, docket_id, opinion_id, element, and the element's fields."""
    return extractions.select("id", "docket_id", "opinion_id", F.explode("x.elements").alias("element", "e")).select("id", "docket_id", "opinion_id", "element", "e.*")


def argument_rows(extractions: DataFrame) -> DataFrame:
    """A row per argument: id, docket_id, outcome, side, position, text; the plaintiff's before the defendant's."""
    sides = [extractions.select("id", "docket_id", F.col("x.outcome").alias("outcome"), F.lit(side).alias("side"), F.posexplode(f"x.arguments_{side}").alias("position", "text")) for side in ("plaintiff", "defendant")]
    return sides[0].unionByName(sides[1])


def outcome_of(statuses: Column) -> Column:
    """From a map of statuses: any element failed, all satisfied, or mixed."""
    values = F.map_values(statuses)
    return F.when(F.exists(values, lambda s: s == "NOT_SATISFIED"), "DEFENDANT_WINS").when((F.size(values) > 0) & F.forall(values, lambda s: s == "SATISFIED"), "PLAINTIFF_WINS").otherwise("MIXED")


def illegal_conditions(rows: DataFrame) -> DataFrame:
    """Element rows with ``illegal``: the conditions that the element's vocabulary lacks."""
    legal = F.create_map(*[y for k, w in CONDITIONS.items() for y in (F.lit(k), F.array(*map(F.lit, w)))])
    return rows.withColumn("illegal", F.array_except(F.coalesce("sub_conditions", F.array()), F.coalesce(legal[F.col("element")], F.array())))


def violations(x: Column) -> Column:
    """Array of the schema rules that a parsed extraction breaks."""
    statuses = F.map_values(x["elements"])
    rules = [
        ("stage", ~F.coalesce(x["procedural_stage"].isin("MTD", "SJ", "TRIAL", "APPEAL"), F.lit(False))),
        ("outcome", ~F.coalesce(x["outcome"].isin("PLAINTIFF_WINS", "DEFENDANT_WINS", "MIXED"), F.lit(False))),
        ("elements", F.size(F.array_except(F.array(*map(F.lit, ELEMENTS)), F.map_keys(x["elements"]))) > 0),
        ("status", F.exists(statuses, lambda e: ~F.coalesce(e["status"].isin(*STATUSES), F.lit(False)))),
        ("confidence", F.exists(statuses, lambda e: ~F.coalesce(e["confidence"].between(0, 1), F.lit(True)))),
    ]
    return F.filter(F.array(*[F.when(broken, name) for name, broken in rules]), lambda v: v.isNotNull())


def _balanced(text: str) -> str | None:
    """From the first opening brace to the one that closes it, counting braces alone."""
    start = text.find("{")
    if start < 0:
        return None
    depth = 0
    for i in range(start, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if not depth:
            return text[start : i + 1]
    return None


def json_in_text(c: str) -> Column:
    """The JSON object in a model's raw answer: without a code fence if that parses, else the first balanced object."""

    @F.pandas_udf("string")
    def rest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: _balanced(t) if isinstance(t, str) else None)

    bare = F.trim(F.regexp_replace(F.trim(F.col(c)), r"^```(?:json)?\s*|\s*```$", ""))
    return F.when(F.try_parse_json(bare).isNotNull() & bare.startswith("{"), bare).otherwise(rest(F.col(c)))
