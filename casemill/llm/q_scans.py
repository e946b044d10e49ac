"""Queries of the scanned texts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm.scans import repair
from casemill.tables import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = repair(table(spark, d, "opinions"), "opinion_id", "plain_text", with_text=False)
    return found.select("opinion_id", F.explode("noise").alias("x")).select("opinion_id", "x.line_no", "x.kind").distinct()


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every opinion's text in continuous paragraphs, and how many lines had noise of each kind."""
    n = lambda kind: F.size(F.filter("noise", lambda x: x["kind"] == kind)).alias(f"n_{kind}")
    found = repair(table(spark, d, "opinions"), "opinion_id", "plain_text")
    return found.select("opinion_id", n("header"), n("page_number"), n("hyphen"), n("misread"), "text")


QUERIES = {"p5_found": p5_found, "p5_repaired": p5_repaired}
ORACLES = {}
