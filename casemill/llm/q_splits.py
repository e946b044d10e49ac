"""Queries of the splits."""

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.llm.splits import TARGETS, named_split, split_dockets, split_records
from casemill.plans.durable import durable, shared_dir
from casemill.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split_dockets(spark, table(spark, d, "case_labels")).where("state = 'quarantined'").select("docket_id")


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    """The split of every docket."""
    return split_dockets(spark, table(spark, d, "case_labels")).select("docket_id", "split", "state")


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    """Rows, rows with an opinion, and dockets of each split and state."""
    labels = table(spark, d, "case_labels")
    sizes = labels.groupBy("docket_id").agg(F.count("*").alias("n_rows"), F.count("opinion_id").alias("n_with_opinion"))
    found = split_dockets(spark, labels).join(sizes, "docket_id").groupBy("split", "state")
    return found.agg(F.count("*").alias("n_dockets"), F.sum("n_rows").alias("n_rows"), F.sum("n_with_opinion").alias("n_with_opinion"))


def p1_targets(spark: SparkSession, d: str) -> DataFrame:
    """Per split: whether its weight is within one component of its target, or over it by no more than what was declared."""
    labels = table(spark, d, "case_labels").where("docket_id is not null")
    sizes = labels.groupBy("docket_id").agg(F.count("opinion_id").alias("n"))
    placed = durable(split_dockets(spark, labels).join(sizes, "docket_id").where("state <> 'quarantined'"), "placed")
    per_split = placed.groupBy("split").agg(F.sum("n").alias("got"), F.sum(F.when(F.col("state") == "kept", F.col("n")).otherwise(0)).alias("declared"))
    total = placed.agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    wanted = spark.createDataFrame(list(TARGETS.items()), "split string, target double").join(per_split, "split", "left").crossJoin(total)  # one row
    aim = F.col("target") * F.col("total")
    # a window over a row a split
    over = F.greatest(F.sum(F.greatest(F.lit(0.0), F.col("declared") - aim)).over(Window.partitionBy(F.lit(0))), F.lit(0.0))
    near = (F.coalesce("got", F.lit(0)) >= aim - over - F.col("most")) & (F.coalesce("got", F.lit(0)) <= F.greatest(aim, F.col("declared")) + F.col("most"))
    return wanted.select("split", near.alias("near"))


def p1_batches(spark: SparkSession, d: str) -> DataFrame:
    """case_labels in two batches through a persisted table: first the rows of opinions with an even id, then all rows.

    Per docket: how many splits its rows name, the only one that the first batch names, and whether the final split obeys:
    two names are quarantined, a split once given stays, and a late name agrees with it or quarantines.
    """
    labels = table(spark, d, "case_labels").where("docket_id is not null")
    early = labels.where("opinion_id % 2 = 0")
    store = f"{shared_dir(spark).rstrip('/')}/casemill/splits-{uuid.uuid4().hex}"
    first = split_dockets(spark, early, store).select("docket_id", F.col("split").alias("before"), F.col("state").alias("state_before"))
    last = split_dockets(spark, labels, store).select("docket_id", "split", "state")
    names = lambda rows: rows.groupBy("docket_id").agg(F.countDistinct(named_split("split")).alias("n"), F.min(named_split("split")).alias("name"))
    all_names, early_names = names(labels), names(early).toDF("docket_id", "n_early", "early")
    rows = last.join(all_names, "docket_id").join(early_names, "docket_id", "left").join(first, "docket_id", "left")
    stays = F.col("before").isNull() | (F.col("split") == F.col("before")) | (F.col("state") == "quarantined")
    rule = (
        F.when(F.col("n") > 1, F.col("state") == "quarantined")
        .when(F.col("n_early") == 1, (F.col("state") == "kept") & (F.col("split") == F.col("early")))
        .when(F.col("n") == 1, (F.col("split") == F.col("name")) | ((F.col("state") == "quarantined") & (F.col("before") != F.col("name"))))
        .otherwise(F.col("split").isin(list(TARGETS)) & (F.col("before").isNull() | (F.col("before") == F.col("split"))))
    )
    return rows.select("docket_id", F.col("n").alias("n_names"), F.when(F.col("n_early") == 1, F.col("early")).alias("early"), (F.coalesce(rule, F.lit(False)) & stays).alias("obeys"))


def p1_related(spark: SparkSession, d: str) -> DataFrame:
    """Opinions tied by docket, cluster and equal text: the least opinion of what each belongs to, and whether its split is that one's."""
    opinions = table(spark, d, "opinions").where("opinion_id is not null")
    rows = opinions.select("opinion_id", "docket_id", "cluster_id", F.when(F.trim("plain_text") != "", F.sha2("plain_text", 256)).alias("digest"))
    found = durable(split_records(spark, rows, "opinion_id", ["docket_id", "cluster_id", "digest"]), "related")
    groups = found.groupBy("component").agg(F.min("opinion_id").alias("least"), F.countDistinct("split").alias("n_splits"))
    return found.join(groups, "component").select("opinion_id", "least", "n_splits")


QUERIES = {f.__name__: f for f in (p1_found, p1_splits, p1_shares, p1_targets, p1_batches, p1_related)}
_NAMED = """named AS (SELECT docket_id, opinion_id, CASE lower(trim(split)) WHEN 'train' THEN 'train' WHEN 'test' THEN 'test' WHEN 'val' THEN 'val'
               WHEN 'validation' THEN 'val' WHEN 'dev' THEN 'val' END AS s FROM case_labels WHERE docket_id IS NOT NULL)"""
ORACLES = {
    "p1_found": f"WITH {_NAMED} SELECT docket_id FROM named GROUP BY 1 HAVING count(DISTINCT s) > 1",
    "p1_targets": "SELECT split, true AS near FROM (VALUES ('train'), ('val'), ('test')) t(split)",
    "p1_batches": f"""WITH {_NAMED} SELECT docket_id, count(DISTINCT s) AS n_names, true AS obeys,
CASE WHEN count(DISTINCT s) FILTER (WHERE opinion_id % 2 = 0) = 1 THEN min(s) FILTER (WHERE opinion_id % 2 = 0) END AS early FROM named GROUP BY 1""",
    "p1_related": """WITH RECURSIVE o AS (SELECT DISTINCT opinion_id AS o, unnest(list_filter(['d' || docket_id, 'c' || cluster_id, CASE WHEN trim(plain_text) <> '' THEN 't' || plain_text END], lambda x: x IS NOT NULL)) AS k FROM opinions WHERE opinion_id IS NOT NULL),
e AS (SELECT DISTINCT a.o AS a, b.o AS b FROM o a JOIN o b USING (k)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS opinion_id, min(b) AS least, 1 AS n_splits FROM r GROUP BY 1""",
}
