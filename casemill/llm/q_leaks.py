"""Queries of the leaks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm.leaks import WINDOW, leaks
from casemill.tables import table


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the items of which a passage of 13 words occurs in them with at most two edited words."""
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Those with an unedited passage."""
    return p8_leaks(spark, d).where((F.col("edits") == 0) & (F.col("words") == WINDOW)).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Per item, the documents with an exact and with an edited passage."""
    found = p8_leaks(spark, d).groupBy("item_id")
    return found.agg(F.count_if(F.col("edits") == 0).alias("n_exact"), F.count_if(F.col("edits") > 0).alias("n_edited"))


QUERIES = {"p8_found": p8_found, "p8_leaks": p8_leaks, "p8_items": p8_items}
ORACLES = {
    "p8_found": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 12], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
v AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
h AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM v))
SELECT DISTINCT doc_id, item_id FROM g JOIN h USING (gram)"""
}
