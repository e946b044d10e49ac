"""Queries of the orphan references, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.operators.orphans import orphans
from casemill.tables import absent_if_blank, table, utc_stamp


def cited_id(url):
    """The number after /opinions/ in any letter case; null if there is none or it is no long."""
    return F.regexp_extract(url, r"(?i)/opinions/([0-9]+)", 1).try_cast("bigint")


def _always(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("key"), F.lit(None).cast("string").alias("arrived"), F.lit(None).cast("timestamp").alias("stamp"))


def all_orphans(spark: SparkSession, d: str) -> DataFrame:
    """field, record_id, key, period, stamp, state of every orphan reference.

    Citations have no date of their own: their period is the month in which the citing opinion's cluster was filed,
    null where the citing opinion is unknown or undated. Extractions: the month of created_at.
    """
    opinions, cases = table(spark, d, "opinions"), table(spark, d, "cases")
    edges = table(spark, d, "citation_edges").select("source_opinion_id", "cited_opinion_url").distinct()
    runs = table(spark, d, "irac_extractions").select("id", "docket_id", "created_at")
    filed = opinions.groupBy("opinion_id").agg(F.min(F.substring(absent_if_blank("cluster_date_filed"), 1, 7)).alias("period"))
    never = F.lit(None).cast("timestamp").alias("stamp")
    edges = edges.join(filed, edges.source_opinion_id == filed.opinion_id, "left")
    sources = edges.select(F.col("source_opinion_id").alias("record_id"), F.col("source_opinion_id").alias("key"), "period", never)
    cited = edges.select(F.col("source_opinion_id").alias("record_id"), cited_id("cited_opinion_url").alias("key"), "period", never)
    ran = runs.select(F.col("id").alias("record_id"), F.col("docket_id").alias("key"), F.date_format(utc_stamp("created_at"), "yyyy-MM").alias("period"), utc_stamp("created_at").alias("stamp"))
    seen = cases.select(F.col("docket_id").alias("key"), utc_stamp("scraped_at").alias("stamp"))
    # the earliest stamp counts, and rows without one say nothing beside one with a stamp
    seen = seen.groupBy("key").agg(F.min("stamp").alias("stamp")).select("key", F.date_format("stamp", "yyyy-MM").alias("arrived"), "stamp")
    known = _always(opinions, "opinion_id")
    every = known.unionByName(_always(table(spark, d, "landmarks"), "opinion_id"))
    found = (("source_opinion_id", orphans(sources, known)), ("cited_opinion_url", orphans(cited, every)), ("docket_id", orphans(ran, seen)))
    return reduce(DataFrame.unionByName, [rows.withColumn("field", F.lit(field)) for field, rows in found])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return all_orphans(spark, d).select("field", "record_id", F.col("key").alias("missing_id"), "state").distinct()


def p6_by_period(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references and distinct missing keys by table, field, period and state."""
    source = F.when(F.col("field") == "docket_id", "irac_extractions").otherwise("citation_edges")
    return (
        all_orphans(spark, d)
        .groupBy(source.alias("table_name"), "field", "period", "state")
        .agg(F.count("*").alias("n_references"), F.countDistinct("key").alias("n_missing"))
    )


_SQL = r"""
WITH e AS (SELECT DISTINCT source_opinion_id, cited_opinion_url FROM citation_edges),
filed AS (SELECT opinion_id, min(CASE WHEN trim(cluster_date_filed) <> '' THEN substr(cluster_date_filed, 1, 7) END) AS period FROM opinions GROUP BY 1),
p AS (SELECT e.*, period, try_cast(nullif(regexp_extract(cited_opinion_url, '(?i)/opinions/([0-9]+)', 1), '') AS BIGINT) AS cited
      FROM e LEFT JOIN filed ON opinion_id = source_opinion_id),
seen AS (SELECT docket_id, min(try_cast(rtrim(replace(trim(scraped_at), 'T', ' '), 'Z') AS TIMESTAMP)) AS came FROM cases GROUP BY 1),
runs AS (SELECT DISTINCT id, r.docket_id, s.docket_id AS there, came, try_cast(rtrim(replace(trim(created_at), 'T', ' '), 'Z') AS TIMESTAMP) AS made
         FROM irac_extractions r LEFT JOIN seen s ON s.docket_id = r.docket_id WHERE r.docket_id IS NOT NULL),
found AS (
  SELECT DISTINCT 'source_opinion_id' AS field, source_opinion_id AS record_id, source_opinion_id AS missing_id, period, 'absent' AS state FROM p
  WHERE source_opinion_id IS NOT NULL AND source_opinion_id NOT IN (SELECT opinion_id FROM opinions WHERE opinion_id IS NOT NULL)
  UNION ALL
  SELECT DISTINCT 'cited_opinion_url', source_opinion_id, cited, period, 'absent' FROM p
  WHERE cited IS NOT NULL AND cited NOT IN (SELECT opinion_id FROM opinions WHERE opinion_id IS NOT NULL UNION ALL SELECT opinion_id FROM landmarks)
  UNION ALL
  SELECT DISTINCT 'docket_id', id, docket_id, strftime(made, '%Y-%m'), CASE WHEN there IS NULL THEN 'absent' ELSE 'late' END FROM runs WHERE there IS NULL OR came > made)
"""

QUERIES = {"p6_found": p6_found, "p6_by_period": p6_by_period}
ORACLES = {
    "p6_found": _SQL + "SELECT DISTINCT field, record_id, missing_id, state FROM found",
    "p6_by_period": _SQL
    + """SELECT CASE WHEN field = 'docket_id' THEN 'irac_extractions' ELSE 'citation_edges' END AS table_name, field, period, state,
    count(*) AS n_references, count(DISTINCT missing_id) AS n_missing FROM found GROUP BY ALL""",
}
