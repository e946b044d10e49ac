"""Profiles of tables and of semi-structured columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.plans.durable import durable
from casemill.plans.ranking import sum_below

# Codes of court statistics.
DISPOSITIONS = {
    0: "Ongoing / not terminated", 1: "Transfer to another district", 2: "Remanded", 3: "Dismissed - want of prosecution", 4: "Dismissed - lack of jurisdiction",
    5: "Dismissed - settled", 6: "Dismissed - voluntarily", 7: "Dismissed - other", 8: "Default judgment", 9: "Consent judgment", 10: "Judgment on motion before trial",
    11: "Judgment on jury verdict", 12: "Judgment on directed verdict", 13: "Judgment on court trial", 14: "Judgment on appeal of magistrate decision",
    15: "Multi-district litigation transfer", 18: "Statistical closing", 19: "Other",
}
JUDGMENTS = {0: "No judgment", 1: "Plaintiff", 2: "Defendant", 3: "Both", 4: "Unknown"}


def decode(code: Column, names: dict[int, str]) -> Column:
    """The name of a code, ``Code n`` for others, null for null."""
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(pairs, code.cast("int")), F.concat(F.lit("Code "), code.cast("string"))))


def filled(c: Column) -> Column:
    """Neither null nor blank."""
    return c.isNotNull() & (F.trim(c.cast("string")) != "")


def fill_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, n_filled, n, rate) of each column, in one pass over the table."""
    columns = columns or df.columns
    row = df.agg(F.count("*").alias("_n"), *[F.count_if(filled(F.col(c))).alias(c) for c in columns])
    long = row.unpivot(["_n"], columns, "column_name", "n_filled")
    return long.select("column_name", "n_filled", F.col("_n").alias("n"), F.round(F.when(F.col("_n") > 0, F.col("n_filled") / F.col("_n")).otherwise(0.0), 6).alias("rate"))


def density(df: DataFrame, columns: list[str]) -> Column:
    """Filled columns of a row."""
    return sum((filled(F.col(c)).cast("long") for c in columns), F.lit(0).cast("long"))


def upper_median(values: DataFrame, column: str) -> DataFrame:
    """(median, mean, n): of n sorted values the one at n div 2, and their mean, from counts of distinct values."""
    by = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("median")).agg(F.count("*").alias("c"))
    placed = durable(sum_below(by, "median", "c", "below"), "median")
    total = placed.agg(F.sum("c")).first()[0] or 0
    middle = (F.col("below") <= total // 2) & (F.col("below") + F.col("c") > total // 2)
    mean = F.sum(F.col("median") * F.col("c")) / F.nullif(F.sum("c"), F.lit(0))
    return placed.agg(F.max(F.when(middle, F.col("median"))).alias("median"), F.round(mean, 6).alias("mean"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"))


def bins(df: DataFrame, column: str, width: int) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy((F.floor(F.col(column) / width) * width).alias("bin")).agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """(value, n), the most frequent first, ties by value; a report of the first ``most`` if given."""
    out = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(most) if most else out


def json_profile(df: DataFrame, column: str) -> DataFrame:
    """(field, type, n, least sample) of the top-level fields of JSON objects, found from the data; cut-off JSON is left out."""
    v = df.select(F.try_parse_json(column).alias("v")).where("v is not null")
    rows = v.withColumn("m", F.expr("try_cast(v as map<string, variant>)")).select(F.explode("m").alias("field", "x"))
    return rows.groupBy("field", F.schema_of_variant("x").alias("type")).agg(F.count("*").alias("n"))


def role_class(role: Column) -> Column:
    """Plaintiff before defendant before relief, by substring."""
    return F.when(role.contains("Plaintiff"), "plaintiff").when(role.contains("Defendant"), "defendant").when(role.contains("Relief"), "relief").otherwise("other")


def joined_distinct(values: Column, separator: str = "; ") -> Column:
    """Distinct non-empty values of an array in first-seen order, as one text."""
    return F.array_join(F.array_distinct(F.filter(values, lambda v: F.coalesce(v, F.lit("")) != "")), separator)
