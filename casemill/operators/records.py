"""Row versions: which row of a key counts, what is left to do, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; give a total order to fix ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(current: DataFrame, batch: DataFrame, keys: list[str], seq: str, policy: str = "replace") -> DataFrame:
    """Union of both by key. replace: the batch's last row by ``seq`` wins; ignore: the current row, else the batch's first."""
    if policy not in ("replace", "ignore"):
        raise ValueError("policy is replace or ignore")
    order = F.desc(seq) if policy == "replace" else F.asc(seq)
    news = one_per_key(batch, keys, order)
    if policy == "replace":
        return current.join(news.select(*keys), keys, "left_anti").unionByName(news.select(*current.columns))
    return current.unionByName(news.join(current.select(*keys), keys, "left_anti").select(*current.columns))


def to_do(found: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys found and not done. A null key is never done."""
    return found.select(*keys).distinct().join(done.select(*keys).distinct(), keys, "left_anti")


