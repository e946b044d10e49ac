"""Where results are written: appended extractions, replaced labels, stored scores, unique keys."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_extractions(lifted: DataFrame, path: str, model: str) -> None:
    """Appends (docket_id, opinion_id, extraction, llm_model, llm_raw, is_valid, errors, created_at); a re-run appends anew.

    lifted: docket_id, opinion_id, raw, extraction, errors (array of text). A row is valid if it has JSON and no errors.
    """
    broken = F.coalesce(F.size(F.filter("errors", lambda e: e.isNotNull())), F.lit(0)) > 0
    rows = lifted.select(
        "docket_id", "opinion_id", "extraction", F.lit(model).alias("llm_model"), F.col("raw").alias("llm_raw"),
        F.when(F.col("extraction").isNotNull() & ~broken, 1).otherwise(0).alias("is_valid"),
        F.when(broken, F.to_json("errors")).when(F.col("extraction").isNull(), '["JSON parse failure"]').alias("errors"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    )
    rows.write.mode("append").parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Replaces the table at path as a whole; df must not read from it."""
    df.write.mode("overwrite").parquet(path)


def save_scores(scores: DataFrame, path: str) -> None:
    """Replaces stored scores (entity_type, entity_id, score), one file set per entity type."""
    scores.write.mode("overwrite").partitionBy("entity_type").parquet(path)


def key_violations(frames: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(name, n_null, n_repeated) of tables whose keys must be present and unique: rows without a key, and keys used again."""
    out = []
    for name, (df, keys) in frames.items():
        absent = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
        counted = df.groupBy(*keys).agg(F.count("*").alias("_n"))
        sums = counted.agg(F.coalesce(F.sum(F.when(absent, F.col("_n"))), F.lit(0)).alias("n_null"), F.count_if(~absent & (F.col("_n") > 1)).alias("n_repeated"))
        out.append(sums.select(F.lit(name).alias("name"), "n_null", "n_repeated"))
    return reduce(DataFrame.unionByName, out)


def first_available(*sources: Callable[[], DataFrame]) -> DataFrame:
    """The first source that can be analysed; the last one's error is raised if none can."""
    for k, source in enumerate(sources):
        try:
            df = source()
            df.schema  # noqa: B018
            return df
        except Exception:  # noqa: BLE001
            if k == len(sources) - 1:
                raise
    raise ValueError("no source")


def tier(cases: DataFrame, name: str, limit: int = 200) -> DataFrame:
    """golden: the first ``limit`` cases with opinions by docket; opinions: all that have any; all."""
    if name == "all":
        return cases
    with_opinions = cases.where("has_opinions = 1")
    if name == "opinions":
        return with_opinions
    if name == "golden":
        return with_opinions.orderBy("docket_id").limit(limit)
    raise ValueError("a tier is golden, opinions or all")
