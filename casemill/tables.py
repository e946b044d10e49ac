"""Reading the registered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = tuple(
    """region nation customer supplier part orders lineitem events documents embeddings cases opinions citation_edges
    parties case_labels irac_extractions opinion_embeddings landmarks eval_items mix_targets""".split()
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Registers tables as temporary views, for plans that are written in SQL."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def absent_if_blank(c):
    """Null for null and blank text: both mean absent in these tables."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.trim(c) != "", c)


def utc_stamp(c):
    """Timestamp of the two stamp formats, ``2025-01-31 10:20:30`` and ``2025-01-31T10:20:30Z``; null if neither."""
    c = F.col(c) if isinstance(c, str) else c
    return F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.trim(c), "[Tt]", " "), "[Zz]$", ""), F.lit("yyyy-MM-dd HH:mm:ss"))
