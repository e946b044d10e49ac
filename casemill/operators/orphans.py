"""References to records that do not exist.

Keys are dictionary-encoded as integers, the references of each period become bitmaps over ranges of 64 codes, and
``references AND NOT parents`` leaves the bits of the orphans, which are decoded back to keys.

The dictionary is a written table (key, code): within a task's key range the codes are consecutive, so the bitmaps are
dense whatever the keys look like. A bitmap is kept by its words of 64 bits, and words without a bit aren't kept, so a
sparse period costs what it refers to; however often a key is referenced it is one bit after the map-side combine.
Parents are accumulated over the periods of each range once, in order, so the work grows with the periods and not with
their square.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.plans.durable import durable


def dictionary(*keys: DataFrame) -> DataFrame:
    """(key, code) of all distinct non-null keys of one-column frames; written, so that codes are stable on recomputation."""
    united = keys[0].toDF("key")
    for other in keys[1:]:
        united = united.unionByName(other.toDF("key"))
    distinct = united.where("key is not null").distinct().sort("key")
    return durable(distinct.withColumn("code", F.monotonically_increasing_id()), "dictionary")


def bitmaps(coded: DataFrame, *by: str) -> DataFrame:
    """(by..., word, bits): the bits of the codes of a frame with a column ``code``, 64 to a word, for words with any."""
    bit = F.expr("shiftleft(1L, cast(code & 63 as int))")
    return coded.groupBy(*by, F.shiftright("code", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def decoded(words: DataFrame, bits: str) -> DataFrame:
    """The rows with a ``code`` for every bit that is set."""
    places = F.expr(f"filter(sequence(0, 63), i -> shiftright({bits}, i) & 1 = 1)")
    return words.where(F.col(bits) != 0).withColumn("_bit", F.explode(places)).withColumn("code", F.col("word") * 64 + F.col("_bit")).drop("_bit")


def orphan_keys(references: DataFrame, parents: DataFrame) -> DataFrame:
    """Distinct (period, key) of references whose key no parent has by then.

    references: key, period. parents: key, arrived; a parent counts for a reference of a later period than
    ``arrived``, and always if ``arrived`` is null. A reference of the parent's own period is reported: whether the
    parent came first is below the grain of periods and for the caller to decide on the records.
    Null keys refer to nothing and are left out; a null period is a period of its own, in which every parent counts.
    """
    references, parents = references.select("key", "period"), parents.select("key", "arrived")
    codes = dictionary(references.select("key"), parents.select("key"))
    wanted = bitmaps(references.distinct().join(codes, "key"), "period")
    first = parents.groupBy("key").agg(F.min("arrived").alias("arrived"), F.count_if(F.col("arrived").isNull()).alias("always"))
    first = first.select("key", F.when(F.col("always") == 0, F.col("arrived")).alias("arrived"))
    have = bitmaps(first.join(codes, "key"), "arrived")
    # parents that always were come first, references without a period last; a period's references come before its parents
    nothing = F.lit(None).cast("long")
    asked = wanted.select("word", "period", F.when(F.col("period").isNull(), 2).otherwise(1).alias("phase"), F.lit(0).alias("turn"), F.col("bits").alias("wanted"), nothing.alias("have"))
    there = have.select("word", F.col("arrived").alias("period"), F.when(F.col("arrived").isNull(), 0).otherwise(1).alias("phase"), F.lit(1).alias("turn"), nothing.alias("wanted"), F.col("bits").alias("have"))
    so_far = Window.partitionBy("word").orderBy("phase", "period", "turn").rowsBetween(Window.unboundedPreceding, -1)
    compared = asked.unionByName(there).withColumn("known", F.bit_or("have").over(so_far)).where("turn = 0")
    left = decoded(compared.withColumn("left", F.expr("wanted & ~coalesce(known, 0L)")), "left")
    return left.join(codes, "code").select("period", "key")


def orphans(references: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows (record_id, key, period, stamp, state) of references whose parent is ``absent`` or came ``late``.

    references: record_id, key, period, stamp. parents: key, arrived, stamp, where ``arrived`` is the period of the
    stamp. A parent without any stamp was always there; of several rows the earliest stamp counts. A reference
    without a stamp is never late. Repeated references give one row. Empty tables give no rows, or all references
    as absent where there is no parent.
    """
    references = references.select("record_id", "key", "period", "stamp").where("key is not null").distinct()
    parents = parents.select("key", "arrived", F.col("stamp").alias("came"))
    suspects = orphan_keys(references, parents)
    first = parents.groupBy("key").agg(F.min("came").alias("came"), F.lit(True).alias("there"))
    hit = references.alias("r").join(suspects.alias("s"), (F.col("r.key") == F.col("s.key")) & F.col("r.period").eqNullSafe(F.col("s.period"))).select("r.*")
    state = F.when(F.col("there").isNull(), "absent").when(F.col("came") > F.col("stamp"), "late")
    return hit.join(first, "key", "left").withColumn("state", state).where("state is not null").select("record_id", "key", "period", "stamp", "state")
