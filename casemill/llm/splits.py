"""Splits that keep related records together.

The component table (node, component, split, state) persists between batches. A batch of links merges components by
pointer jumping. A component in which all prior splits agree keeps its split, one without any fills the deficit of
the splits against the target proportions, and one in which prior splits conflict is quarantined.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm.components import components
from casemill.plans.durable import durable
from casemill.plans.ranking import running_sum

TARGETS = {"train": 0.70, "val": 0.15, "test": 0.15}
#: spellings of the splits; fixed values
SPELLINGS = {"train": "train", "test": "test", "val": "val", "validation": "val", "dev": "val"}


def named_split(c):
    """The split that a hand-typed value names; null for anything else."""
    c = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.coalesce(*[F.when(c == F.lit(k), F.lit(v)) for k, v in SPELLINGS.items()])


def _tagged(kind: str, c: str):
    return F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))


def merge(old: DataFrame | None, links: DataFrame, named: DataFrame) -> DataFrame:
    """(node, component, split, state) of all nodes after ``links`` (a, b) are added to ``old`` (the same columns, or None).

    Links are drawn between the old components that their ends lie in, so pointer jumping sees the batch and what it
    touches, never the whole table; then every old node follows its component. named: (node, split) that the batch
    declares. state: ``kept`` if exactly one split is known in the component, from its old parts or declared, ``new`` if
    none is, ``quarantined`` if two or more are or an old part was; quarantined components have a null split.
    """
    if old is None:
        placed = components(links)
        before = None
    else:
        old = old.select("node", "component", "split", "state")
        place = lambda end: old.select(F.col("node").alias(end), F.col("component").alias(f"at_{end}"))
        ends = durable(links.join(place("a"), "a", "left").join(place("b"), "b", "left"), "ends")
        at = lambda end: F.coalesce(f"at_{end}", end)
        found = components(ends.select(at("a").alias("a"), at("b").alias("b"))).toDF("part", "component")
        fresh = ends.where("at_a is null").select(F.col("a").alias("node")).union(ends.where("at_b is null").select("b")).distinct()
        nodes = old.select("node", F.col("component").alias("part")).unionByName(fresh.select("node", F.col("node").alias("part")))
        placed = durable(nodes.join(found, "part", "left").select("node", F.coalesce("component", "part").alias("component")), "placed")
        before = old.select(F.col("component").alias("part"), "split", (F.col("state") == "quarantined").alias("bad")).distinct()
        before = before.join(found, "part", "left").select(F.coalesce("component", "part").alias("component"), "split", "bad")
    declared = named.where("split is not null").distinct().join(placed, "node").select("component", "split", F.lit(False).alias("bad"))
    known = (before.unionByName(declared) if before else declared).groupBy("component").agg(F.min("split").alias("lo"), F.max("split").alias("hi"), F.max("bad").alias("bad"))
    state = F.when(F.col("bad") | (F.col("lo") != F.col("hi")), "quarantined").when(F.col("lo").isNotNull(), "kept").otherwise("new")
    known = known.select("component", state.alias("state"), F.when(state == "kept", F.col("lo")).alias("split"))
    return placed.join(known, "component", "left").select("node", "component", "split", F.coalesce("state", F.lit("new")).alias("state"))


def fill(sized: DataFrame, targets: dict[str, float] = TARGETS, large: float = 0.002) -> DataFrame:
    """Gives each ``new`` component of (component, split, state, weight) a split, so that the sums of weight near the targets.

    Components of at least ``large`` of all weight, of which there can be no more than 1 / large, go one by one to
    the split with the greatest deficit. All smaller ones are laid end to end in hash order, and the deficits that
    then remain cut that line; so each split misses its target by less than one small component.
    Quarantined components count for no split. Components of weight 0 go the same way, by hash.
    """
    sized = durable(sized, "sized")
    sums = {r["split"]: r["w"] for r in sized.where("split is not null").groupBy("split").agg(F.sum("weight").alias("w")).collect()}
    total = sized.where("state <> 'quarantined'").agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    have = {s: sums.get(s, 0) for s in targets}
    is_large = (F.col("state") == "new") & (F.col("weight") > 0) & (F.col("weight") >= math.ceil(large * total))
    rows, placed = sized.where(is_large).orderBy(F.desc("weight"), "component").collect(), []  # at most 1 / large rows
    for r in rows:
        split = max(targets, key=lambda s: targets[s] * total - have[s])
        have[split] += r["weight"]
        placed.append((r["component"], split))
    deficit = {s: max(0.0, targets[s] * total - have[s]) for s in targets}
    scale = sum(deficit.values()) or 1.0
    small = sized.where((F.col("state") == "new") & ~is_large)
    room = small.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    line = running_sum(small, "weight", ["component"], "at")
    spread = F.pmod(F.xxhash64(F.lit(3), "component"), F.lit(1_000_000)) / 1e6
    share = F.when(F.col("weight") > 0, (F.col("at") + F.col("weight") / 2) / float(room or 1)).otherwise(spread)
    cut, chosen = 0.0, F.lit(list(targets)[-1])
    for s in reversed(list(targets)[:-1]):
        cut = sum(deficit[x] for x in list(targets)[: list(targets).index(s) + 1]) / scale if sum(deficit.values()) else sum(list(targets.values())[: list(targets).index(s) + 1])
        chosen = F.when(share < cut, F.lit(s)).otherwise(chosen)
    filled = line.select("component", chosen.alias("chosen"))
    if placed:
        filled = filled.unionByName(sized.sparkSession.createDataFrame(placed, "component string, chosen string"))
    return sized.join(filled, "component", "left").select("component", F.coalesce("split", "chosen").alias("split"), "state", "weight")


def latest(spark: SparkSession, store: str) -> tuple[int, DataFrame | None]:
    """(number, table) of the last whole version in the folder, (-1, None) if there is none; half-written ones don't count."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(store)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    done = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(hadoop.Path(f"{store}/{n}/_SUCCESS"))]
    return (max(done), spark.read.parquet(f"{store}/v{max(done)}")) if done else (-1, None)


def update(spark: SparkSession, store: str | None, links: DataFrame, weights: DataFrame, prior: DataFrame | None = None, targets: dict[str, float] = TARGETS) -> DataFrame:
    """One incremental step: merges ``links`` into the table at ``store``, fills new components, writes the next version.

    links: record, entity; a record without an entity stands alone, a null record is left out. weights: record, weight; a
    record sent again takes its new weight. prior: (record, split) declared by the batch, beside the stored splits.
    store: folder of versions, or None to keep nothing. All nodes of earlier batches stay in the table, records as well
    as entities, so a record that comes again with another entity ties the two. A stored split never changes except into
    quarantine. Returns the new table (node, component, split, state, weight of the node). A version counts once its
    _SUCCESS is there, so a step that is lost halfway is repeated from the version before.
    """
    nothing = "node string, component string, split string, state string, weight long"
    version, old = latest(spark, store) if store else (-1, None)
    ends = links.where("record is not null").select(_tagged("r", "record").alias("a"), F.coalesce(_tagged("e", "entity"), _tagged("r", "record")).alias("b")).distinct()
    named = ends.select(F.col("a").alias("node"), F.lit(None).cast("string").alias("split")).limit(0) if prior is None else prior.select(_tagged("r", "record").alias("node"), "split")
    now = weights.where("record is not null").groupBy(_tagged("r", "record").alias("node")).agg(F.sum("weight").cast("long").alias("now"))
    merged = merge(old, ends, named).join(now, "node", "left")
    merged = merged.withColumn("weight", F.lit(0)) if old is None else merged.join(old.select("node", "weight"), "node", "left")
    merged = durable(merged.select("node", "component", "split", "state", F.coalesce("now", "weight", F.lit(0)).alias("weight")), "merged")
    sized = merged.groupBy("component").agg(F.first("split").alias("split"), F.first("state").alias("state"), F.sum("weight").alias("weight"))
    filled = fill(sized, targets).select("component", F.when(F.col("state") != "quarantined", F.col("split")).alias("split"))
    table = merged.drop("split").join(filled, "component").select("node", "component", "split", "state", "weight")
    if not store:
        return table
    table.write.mode("overwrite").parquet(f"{store}/v{version + 1}")
    return spark.read.schema(nothing).parquet(f"{store}/v{version + 1}")


def split_records(spark: SparkSession, records: DataFrame, key: str, entities: list[str], store: str | None = None, weight: str | None = None, named: str | None = None, targets: dict[str, float] = TARGETS) -> DataFrame:
    """(key, component, split, state): records that share a value of any of the ``entities`` columns get one split.

    weight: a column of record weights, else every row weighs 1. named: a column of hand-typed splits. Rows are reduced to
    distinct links before anything is joined. Null and blank entities tie nobody; a record without any stands alone.
    """
    tie = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}="), F.col(c).cast("string")))
    rows = records.where(F.col(key).isNotNull()).withColumn("record", F.col(key).cast("string"))
    links = rows.select("record", F.explode(F.array(*map(tie, entities))).alias("entity")).distinct()
    sizes = rows.groupBy("record").agg(F.sum(weight or F.lit(1)).alias("weight"))
    prior = rows.select("record", named_split(named).alias("split")).where("split is not null").distinct() if named else None
    table = update(spark, store, links, sizes, prior, targets)
    kind = dict(records.dtypes)[key]
    return table.where("node like 'r:%'").select(F.expr(f"cast(substr(node, 3) as {kind})").alias(key), "component", "split", "state")


def split_dockets(spark: SparkSession, labels: DataFrame, store: str | None = None, targets: dict[str, float] = TARGETS) -> DataFrame:
    """(docket_id, component, split, state) of every docket of case_labels, and of earlier batches in the store.

    The rows of a docket that name one split are a record with that split; its rows without one are another record; the
    docket is the entity that ties them. Weight: rows with an opinion. Rows are reduced to one per docket and named split
    before anything is joined, so a docket with a third of all rows costs no more than another.
    A null docket_id is nobody's docket and is left out. Quarantined dockets have a null split in every row.
    """
    parts = (
        labels.where("docket_id is not null")
        .groupBy(F.col("docket_id").cast("string").alias("entity"), F.coalesce(named_split("split"), F.lit("none")).alias("named"))
        .agg(F.count("opinion_id").alias("weight"))
        .withColumn("record", F.concat_ws(":", "entity", "named"))
    )
    parts = durable(parts, "parts")
    prior = parts.where("named <> 'none'").select("record", F.col("named").alias("split"))
    table = update(spark, store, parts.select("record", "entity"), parts.select("record", "weight"), prior, targets)
    return table.where("node like 'e:%'").select(F.expr("cast(substr(node, 3) as bigint)").alias("docket_id"), "component", "split", "state")
