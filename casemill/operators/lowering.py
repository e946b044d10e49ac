"""From extractions and answers to checked records: injected fields, placeholders, status flags, citation flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.operators.constraints import circuit
from casemill.operators.extractions import ELEMENTS, SCHEMA, STATUSES

#: scores up to which a case is contested
CONTESTED = 0.1


def placeholder() -> Column:
    """The record that stands for an extraction that failed: six unanalysed elements and a mixed outcome."""
    element = F.struct(F.lit("NOT_ANALYZED").alias("status"), *[F.array().cast("array<string>").alias(c) for c in ("sub_conditions", "key_facts")], F.lit("").alias("judge_reasoning"), F.lit(None).cast("double").alias("confidence"))
    lists = [F.array().cast("array<string>").alias(c) for c in ("statutes_cited", "precedents_cited", "arguments_plaintiff", "arguments_defendant")]
    elements = F.map_from_arrays(F.array(*map(F.lit, ELEMENTS)), F.array_repeat(element, len(ELEMENTS)))
    ids = [F.lit(None).cast("bigint").alias(c) for c in ("case_id", "opinion_id")]
    return F.struct(*ids, F.lit(None).cast("string").alias("procedural_stage"), F.lit("MIXED").alias("outcome"), *lists, elements.alias("elements")).cast(SCHEMA)


def completed(extractions: DataFrame, stage: Column, default_stage: str = "APPEAL") -> DataFrame:
    """Adds ``failed`` and fills ``x``: the parsed extraction or a placeholder, with the row's own ids and the known stage.

    extractions: docket_id, opinion_id, x. Confidences that the answer gave are dropped, as they are computed later.
    """
    bare = F.transform_values("x.elements", lambda _, e: e.withField("confidence", F.lit(None).cast("double")))
    known = F.when(F.col("x").isNotNull(), F.col("x").withField("elements", bare))
    filled = F.coalesce(known, placeholder()).withField("case_id", F.col("docket_id")).withField("opinion_id", F.col("opinion_id")).withField("procedural_stage", F.coalesce(stage, F.lit(default_stage)))
    return extractions.withColumn("failed", F.col("x").isNull()).withColumn("x", filled)


def assessed(elements: DataFrame, score: Column | None = None) -> DataFrame:
    """Element rows (status) with a status of the vocabulary and flags: not_analyzed, contested.

    A status outside the vocabulary, or none, counts as NOT_ANALYZED. A score of the case within CONTESTED of 0 makes
    all its elements contested; without a score the status decides alone.
    """
    status = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("NOT_ANALYZED")
    rows = elements.withColumn("status", status).withColumn("not_analyzed", F.col("status") == "NOT_ANALYZED")
    near = F.coalesce(F.abs(score) <= CONTESTED, F.lit(False)) if score is not None else F.lit(False)
    return rows.withColumn("contested", (F.col("status") == "CONTESTED") | near)


def citation_flags(cited: DataFrame, known: DataFrame) -> DataFrame:
    """Citations (court_id, cited_docket, cited_court) with verified and cross_circuit. known: docket_id.

    verified: the cited docket is known. cross_circuit: both courts have a circuit, which differ, and the cited one isn't
    the supreme court.
    """
    mine, other = circuit(F.col("court_id")), circuit(F.col("cited_court"))
    there = known.select(F.col("docket_id").alias("cited_docket")).distinct().withColumn("_known", F.lit(True))
    rows = cited.join(there, "cited_docket", "left")
    return rows.withColumn("verified", F.coalesce("_known", F.lit(False))).withColumn("cross_circuit", F.coalesce((other != "scotus") & (mine != other), F.lit(False))).drop("_known")
