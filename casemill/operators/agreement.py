"""Agreement between annotators, and of extractions with annotations, element by element."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.operators.extractions import ELEMENTS, STATUSES
from casemill.operators.records import one_per_key


def latest_annotations(annotations: DataFrame, *order: Column) -> DataFrame:
    """The first row in the given order of each annotator and docket. annotations: annotator, docket_id, statuses (map), outcome."""
    return one_per_key(annotations.where("annotator is not null and docket_id is not null"), ["annotator", "docket_id"], *order)


def status_rows(annotations: DataFrame) -> DataFrame:
    """A row per annotation and element of the six; an element without a status is NOT_ANALYZED."""
    each = F.transform(F.array(*map(F.lit, ELEMENTS)), lambda e: F.struct(e.alias("element"), F.coalesce(F.try_element_at("statuses", e), F.lit("NOT_ANALYZED")).alias("status")))
    return annotations.drop("element", "status").withColumn("_e", F.explode(each)).select("*", "_e.element", "_e.status").drop("_e", "statuses")


def kappa_by(df: DataFrame, by: list[str], a: str, b: str, out: str = "kappa") -> DataFrame:
    """(by..., kappa): Cohen's within each group; 1 where chance agreement is total.

    Cells are counted before anything is compared, so a group of any size is a handful of rows.
    """
    cells = df.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    side = lambda c, first: F.struct(F.col(c).alias("c"), F.lit(first).alias("first"))
    sides = cells.select(*by, F.explode(F.array(side("a", True), side("b", False))).alias("s"), "a", "b", "n")
    of = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    classes = sides.groupBy(*by, "s.c").agg(of(F.col("s.first")).alias("x"), of(~F.col("s.first")).alias("y"), of(F.col("s.first") & (F.col("a") == F.col("b"))).alias("same"))
    sums = classes.groupBy(*by).agg(F.sum("x").alias("t"), F.sum("same").alias("same"), F.sum(F.col("x") * F.col("y")).alias("xy"))
    po, pe = F.col("same") / F.col("t"), F.col("xy") / (F.col("t") * F.col("t"))
    return sums.select(*by, F.round(F.when(pe >= 1, 1.0).otherwise((po - pe) / (1 - pe)), 6).alias(out))


def pairs(latest: DataFrame) -> DataFrame:
    """(annotator_1, annotator_2, type, n_shared, element_kappa, outcome_kappa) of annotators that share a docket.

    annotator_1 < annotator_2; a pair in which either is a retest is intra-rater. latest: one row per annotator and docket.
    """
    x = latest.select("docket_id", F.col("annotator").alias("annotator_1"), F.col("statuses").alias("s1"), F.col("outcome").alias("o1"))
    y = latest.select("docket_id", F.col("annotator").alias("annotator_2"), F.col("statuses").alias("s2"), F.col("outcome").alias("o2"))
    both = x.join(y, "docket_id").where("annotator_1 < annotator_2")
    by = ["annotator_1", "annotator_2"]
    status = lambda s, e: F.coalesce(F.try_element_at(s, e), F.lit("NOT_ANALYZED"))
    each = F.transform(F.array(*map(F.lit, ELEMENTS)), lambda e: F.struct(status("s1", e).alias("x"), status("s2", e).alias("y")))
    elements = kappa_by(both.select(*by, F.explode(each).alias("e")).select(*by, "e.x", "e.y"), by, "x", "y", "element_kappa")
    outcomes = kappa_by(both.select(*by, "o1", "o2"), by, "o1", "o2", "outcome_kappa")
    kind = F.when(F.col("annotator_1").contains("retest") | F.col("annotator_2").contains("retest"), "intra-rater").otherwise("inter-rater")
    shared = both.groupBy(*by).agg(F.count("*").alias("n_shared"))
    return shared.join(elements, by).join(outcomes, by).select(*by, kind.alias("type"), "n_shared", "element_kappa", "outcome_kappa")


def element_accuracy(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(element, n, accuracy, balanced): of both statuses of each docket; rows with a status that is none of STATUSES don't count.

    truth, predicted: docket_id, statuses. An element that nothing is compared for has n 0 and accuracy 0.
    """
    t = status_rows(truth.select("docket_id", "statuses"))
    p = status_rows(predicted.select("docket_id", "statuses")).withColumnRenamed("status", "said")
    both = t.join(p, ["docket_id", "element"]).where(F.col("status").isin(*STATUSES) & F.col("said").isin(*STATUSES))
    hit = (F.col("status") == F.col("said")).cast("double")
    classes = both.groupBy("element", "status").agg(F.avg(hit).alias("recall"), F.sum(hit).alias("hits"), F.count("*").alias("n"))
    found = classes.groupBy("element").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.avg("recall").alias("balanced"))
    every = truth.sparkSession.createDataFrame([(e,) for e in ELEMENTS], "element string")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return every.join(found, "element", "left").select("element", F.coalesce("n", F.lit(0)).alias("n"), zero(F.col("hits") / F.col("n")).alias("accuracy"), zero(F.col("balanced")).alias("balanced"))
