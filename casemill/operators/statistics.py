"""Statistics of predictions against labels, as aggregates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.plans.ranking import sum_below


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """(auc, n_pos, n_neg): Mann-Whitney by average ranks of the distinct scores; null if a class is empty.

    Ranks are taken over distinct scores with counts, which are rounded values in practice and few next to the rows.
    """
    by = df.where(f"{score} is not null and {positive} is not null").groupBy(F.col(score).alias("s")).agg(F.count("*").alias("c"), F.count_if(F.col(positive)).alias("p"))
    ranked = sum_below(by, "s", "c", "below").withColumn("r", F.col("below") + (F.col("c") + 1) / 2)
    sums = ranked.agg(F.sum(F.col("r") * F.col("p")).alias("u"), F.coalesce(F.sum("p"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum(F.col("c") - F.col("p")), F.lit(0)).alias("n_neg"))
    value = (F.col("u") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * F.col("n_neg"))
    return sums.select(F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.round(value, 6)).alias("auc"), "n_pos", "n_neg")


def average_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the average rank of a column, from distinct values with counts."""
    by = df.groupBy(column).agg(F.count("*").alias("_c"))
    ranks = sum_below(by, column, "_c", "_below")
    return df.join(ranks.select(column, (F.col("_below") + (F.col("_c") + 1) / 2).alias(out)), column)


def beta_tail(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if not 0 < x < 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, out = 1.0, 1 / (1 - (a + b) * x / (a + 1)), 1 / (1 - (a + b) * x / (a + 1))
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            c, d = 1 + step / c, 1 / (1 + step * d)
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def two_sided(r: float, n: int) -> float | None:
    """The p-value of a correlation of n pairs under no association, by Student's t with n - 2 degrees of freedom."""
    if r is None or n < 3:
        return None
    return beta_tail(1 - r * r, (n - 2) / 2, 0.5)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(rho, p, n): Pearson's correlation of average ranks with its p-value; null if a side is constant."""
    rows = average_rank(average_rank(df.where(f"{x} is not null and {y} is not null").select(x, y), x, "_rx"), y, "_ry")
    spread = F.stddev_pop("_rx") * F.stddev_pop("_ry")
    out = rows.agg(F.try_divide(F.covar_pop("_rx", "_ry"), F.when(spread > 0, spread)).alias("rho"), F.count("*").alias("n"))
    tail = F.pandas_udf(lambda r, n: pd.Series([two_sided(None if pd.isna(a) else a, int(b)) for a, b in zip(r, n)], dtype="float64"), "double")
    return out.select(F.round("rho", 6).alias("rho"), F.round(tail("rho", "n"), 6).alias("p"), "n")


def confusion(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def per_class(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support of each class on either side; 0 where a denominator is."""
    both = df.select(F.explode(F.array_distinct(F.array(true, pred))).alias("class"), true, pred)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = both.groupBy("class").agg(F.count_if((F.col(true) == F.col("class")) & (F.col(pred) == F.col("class"))).alias("hit"), F.count_if(F.col(true) == F.col("class")).alias("support"), F.count_if(F.col(pred) == F.col("class")).alias("said"))
    p, r = ratio(F.col("hit"), F.col("said")), ratio(F.col("hit"), F.col("support"))
    return c.select("class", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"), "support")


def accuracy(df: DataFrame, true: str, pred: str) -> DataFrame:
    """(accuracy, balanced, n): share of hits, and mean recall over the classes present in the truth."""
    hit = (F.col(true) == F.col(pred)).cast("double")
    by = df.groupBy(true).agg(F.avg(hit).alias("recall"), F.sum(hit).alias("hits"), F.count("*").alias("n"))
    return by.agg(F.round(F.sum("hits") / F.sum("n"), 6).alias("accuracy"), F.round(F.avg("recall"), 6).alias("balanced"), F.sum("n").alias("n"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """(kappa, n): Cohen's; 0 without rows, 1 if chance agreement is total."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    # per class its cells on either side, then everything in one aggregate
    sides = cells.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.lit(True).alias("first")), F.struct(F.col("b").alias("c"), F.lit(False).alias("first")))).alias("s"), "a", "b", "n")
    one, other = F.sum(F.when(F.col("s.first"), F.col("n")).otherwise(0)), F.sum(F.when(F.col("s.first"), 0).otherwise(F.col("n")))
    same = F.sum(F.when(F.col("s.first") & (F.col("a") == F.col("b")), F.col("n")).otherwise(0))
    classes = sides.groupBy("s.c").agg(one.alias("x"), other.alias("y"), same.alias("same"))
    both = classes.agg(F.sum("x").alias("t"), F.sum("same").alias("same"), F.sum(F.col("x") * F.col("y")).alias("xy"))
    po, pe = F.col("same") / F.col("t"), F.col("xy") / (F.col("t") * F.col("t"))
    return both.select(F.round(F.when(F.coalesce("t", F.lit(0)) == 0, 0.0).when(pe >= 1, 1.0).otherwise((po - pe) / (1 - pe)), 6).alias("kappa"), F.coalesce("t", F.lit(0)).alias("n"))


def weighted_mean(values: np.ndarray, counts: np.ndarray) -> float:
    return float((values * counts).sum() / counts.sum())


def bootstrap(df: DataFrame, value: str, statistic: Callable[[np.ndarray, np.ndarray], float] = weighted_mean, resamples: int = 10_000, level: float = 0.95, seed: int = 2026, most: int = 1_000_000) -> DataFrame:
    """(point, low, high): percentile interval of a statistic of one numeric column; nulls without values.

    statistic: of distinct values and their counts. A resample of n values is a multinomial draw of the counts, so only
    distinct values are held, however many rows there are, and the resamples are spread over tasks with a seed each. More
    distinct values than ``most`` are an error; for these pass a rounded column.
    """
    spark = df.sparkSession
    by = df.select(F.col(value).cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n")).orderBy("v").limit(most + 1).toPandas()
    if len(by) > most:
        raise ValueError(f"more than {most} distinct values: round them first")
    if by.empty:
        return spark.createDataFrame([(None, None, None)], "point double, low double, high double")
    values, counts = by["v"].to_numpy(), by["n"].to_numpy()

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        share = counts / counts.sum()
        for batch in batches:
            stats = []
            for k in batch["id"]:
                drawn = np.random.default_rng([seed, int(k)]).multinomial(counts.sum(), share)
                stats.append(statistic(values[drawn > 0], drawn[drawn > 0]))
            yield pd.DataFrame({"s": stats})

    ends = spark.range(resamples).mapInPandas(draw, "s double").agg(F.percentile("s", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))).alias("q"))
    return ends.select(F.lit(float(statistic(values, counts))).alias("point"), F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def ranking_metrics(hits: DataFrame, query: str, rank: str, relevant: str, k: int) -> DataFrame:
    """(p_at_k, ndcg, mrr, n): means over queries of the top k; the ideal order has the relevant of the top k first."""
    top = F.col(rank) <= k
    rel = F.when(top, F.col(relevant).cast("double"))
    first = F.min(F.when(F.col(relevant), F.col(rank))).alias("first")
    # one pass: the hits' plan would be run again for a second use
    per = hits.groupBy(query).agg(F.avg(rel).alias("p"), F.sum(rel / F.log2(F.col(rank) + 1)).alias("dcg"), F.sum(rel).alias("n_rel"), first, F.count_if(top).alias("_top")).where("_top > 0")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n_rel"), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return per.agg(F.round(F.avg("p"), 6).alias("p_at_k"), F.round(F.avg(F.when(F.col("n_rel") > 0, F.col("dcg") / ideal).otherwise(0.0)), 6).alias("ndcg"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.count("*").alias("n"))
