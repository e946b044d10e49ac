"""Mixing sources to target weights.

The schedule is a low-discrepancy sequence: slot i of the mix takes the point frac((i + 1/2) * golden ratio), whose
place in the cumulative weights names the slot's source; so every prefix of the mix is near the targets too. Slots are
made and ranked where they lie, so their number grows with the mix. Each source's records, repeated in shuffled epochs,
are laid out on a line of tokens and cut into blocks of about equal tokens; the n-th slot of a source is joined with its
n-th block. A source too small for a slot of its own shares the one nearest to its place, so none is left out.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.plans.durable import durable
from casemill.plans.ranking import BUCKETS

TOKENIZER = os.environ.get("CASEMILL_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the public pattern that splits text before the merges of a rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
GOLDEN = 0.6180339887498949
#: tokens of a slot, and slots of even the smallest mix
SLOT_TOKENS, LEAST_SLOTS = 4096, 4096
#: slots up to which their table is broadcast
FEW_SLOTS = 100_000
_GAP = re.compile(r"[^\S\x1c-\x1f]{5000,}")

_loaded: dict = {}


def encoder(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts, by the tokenizer at path, loaded once a process.

    Rank files (.tiktoken) and tokenizer files (.json) are read; special tokens in a text count as ordinary text.
    """
    if path not in _loaded:
        _loaded[path] = _by_ranks(path) if path.endswith(".tiktoken") else _by_file(path)
    return _loaded[path]


def _by_file(path: str) -> Callable[[list[str]], list[int]]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda texts: [len(e.ids) for at in range(0, len(texts), 256) for e in tokenizer.encode_batch_fast(texts[at : at + 256], add_special_tokens=False)]


def _by_ranks(path: str) -> Callable[[list[str]], list[int]]:
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    tokenizer = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def count(text: str) -> int:
        # the pattern's engine can't take very long white space, which is one piece but for its last character
        total, at = 0, 0
        for gap in _GAP.finditer(text) if len(text) >= 5000 else ():
            end = gap.end() - (gap.end() < len(text))
            total += len(tokenizer.encode_ordinary(text[at : gap.start()])) + len(tokenizer._encode_single_piece(text[gap.start() : end]))
            at = end
        return total + len(tokenizer.encode_ordinary(text[at:] if at else text))

    return lambda texts: [count(t) for t in texts]


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", path: str = TOKENIZER) -> DataFrame:
    """Adds the number of tokens of each text; 0 for null and empty texts."""

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        count = encoder(path)
        for batch in batches:
            yield pd.Series(count(batch.fillna("").tolist()), dtype="int64")

    return df.withColumn(out, tokens(F.col(text)))


def budgets(have: dict[str, int], targets: dict[str, float], repeats: dict[str, int], total: int | None = None) -> dict[str, int]:
    """Tokens that each source contributes.

    total None: as many as the sources allow at the exact weights, i.e. the least of tokens * repeats / weight over the
    sources that have any. A given total that some cannot reach is met by the others in proportion to their weights,
    as far as their own caps go. Every source with a weight and tokens gets at least one.
    """
    cap = {s: have.get(s, 0) * max(0, repeats[s]) for s in targets}
    live = {s: w for s, w in targets.items() if w > 0 and cap[s] > 0}
    if not live:
        return dict.fromkeys(targets, 0)
    if total is None:
        total = int(min(cap[s] / (live[s] / sum(live.values())) for s in live))
    got, open_, rest = dict.fromkeys(targets, 0), dict(live), total
    while open_ and rest > 0:
        weight = sum(open_.values())
        full = [s for s in open_ if cap[s] <= rest * open_[s] / weight]
        if not full:
            for s in open_:
                got[s] = max(1, int(rest * open_[s] / weight))
            break
        for s in full:
            got[s] = cap[s]
            open_.pop(s)
        rest = total - sum(got.values())
    return got


def points(slot: Column) -> Column:
    """frac((slot + 1/2) * GOLDEN), in two steps so that slots up to 2 ** 40 keep their digits."""
    high, low = F.floor(slot / (1 << 20)), slot % (1 << 20)
    return ((high * ((GOLDEN * (1 << 20)) % 1.0)) % 1.0 + (low + 0.5) * GOLDEN) % 1.0


def schedule(spark: SparkSession, shares: dict[str, float], slots: int) -> DataFrame:
    """(source, block, slot): the slots of each source in order, ranked from 0; every source with a share has at least one.

    Slots are ranked by ranges: only a count per range and source (BUCKETS of them at most) passes a window of a source.
    """
    live = {s: w for s, w in shares.items() if w > 0}
    names, edges = list(live), np.cumsum(list(live.values())).tolist()
    if not names:
        return spark.createDataFrame([], "source string, block long, slot long")
    width = -(-slots // BUCKETS)
    point = points(F.col("id")) * edges[-1]
    place = F.least(F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= point)), F.lit(len(names) - 1))
    found = spark.range(slots).select(F.col("id").alias("slot"), F.element_at(F.array(*map(F.lit, names)), place + 1).alias("source"), F.floor(F.col("id") / width).alias("_b"))
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = found.groupBy("source", "_b").agg(F.count("*").alias("_n")).select("source", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("source", "_b").orderBy("slot")
    ranked = found.join(F.broadcast(starts), ["source", "_b"]).select("source", (F.col("_start") + F.row_number().over(inside) - 1).alias("block"), "slot")  # BUCKETS rows a source
    narrow = [(s, (a + b) / 2 / edges[-1]) for s, a, b in zip(names, [0.0, *edges], edges) if (b - a) * slots < 8 * edges[-1]]
    if not narrow:
        return ranked
    # sources with so small a share that no point may lie in it: the slot whose point is nearest
    has = {r[0] for r in ranked.where(F.col("source").isin([s for s, _ in narrow])).select("source").distinct().collect()}
    lost = [(s, middle) for s, middle in narrow if s not in has]
    if not lost:
        return ranked
    nearest = [F.min(F.struct(F.abs(points(F.col("id")) - middle).alias("d"), F.col("id").alias("slot")))["slot"].alias(f"s{k}") for k, (_, middle) in enumerate(lost)]
    spots = spark.range(slots).agg(*nearest).first()
    return ranked.unionByName(spark.createDataFrame([(s, 0, int(x)) for (s, _), x in zip(lost, spots)], "source string, block long, slot long"))


def mix(records: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 11, slots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(mix, shares): the mix has a row (slot, offset, source, doc_id, epoch, n_tokens) per use of a record, in order of slot and offset.

    records: doc_id, source, n_tokens; targets: source, target_weight, max_repeats (one small row per source).
    No record is used more than max_repeats times: an epoch takes every record of its source once, so a source needs
    ceil(budget / its tokens) epochs, the last in part; every source with a budget has at least its first record used.
    Records without tokens, without a source, or of a source that has no target are not used. shares has every target
    with the share reached and the greatest use of a record. slots: how many, else one for SLOT_TOKENS tokens of the mix
    and at least LEAST_SLOTS. A source that holds most of the rows is cut by hash ranges like any other; nothing is gathered per source.
    """
    spark = records.sparkSession
    wanted = {r["source"]: (r["target_weight"], r["max_repeats"]) for r in targets.collect()}
    records = durable(records.where("n_tokens > 0 and source is not null").select("doc_id", "source", F.col("n_tokens").cast("long").alias("n_tokens")), "records")
    records = records.where(F.col("source").isin(list(wanted)))
    have = {r["source"]: r["n"] for r in records.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    got = budgets(have, {s: w for s, (w, _) in wanted.items()}, {s: m for s, (_, m) in wanted.items()}, total)
    whole = sum(got.values())
    slots = slots or max(LEAST_SLOTS, -(-whole // SLOT_TOKENS))
    order = schedule(spark, {s: n / whole for s, n in got.items()} if whole else {}, slots)
    order = durable(order, "slots")
    blocks = {r["source"]: r["n"] for r in order.groupBy("source").agg(F.count("*").alias("n")).collect()}
    plan = [(s, int(n), int(have[s]), -(-n // have[s]), blocks[s]) for s, n in got.items() if n]
    plan_df = spark.createDataFrame(plan, "source string, budget long, have long, epochs long, blocks long")
    # a row per record and epoch, each epoch in an order of its own
    uses = records.join(F.broadcast(plan_df), "source").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("epochs"))))
    uses = uses.withColumn("_h", F.xxhash64(F.lit(seed), "epoch", "doc_id")).withColumn("_b", F.shiftrightunsigned("_h", 52).cast("int"))
    assert BUCKETS == 1 << 12
    sums = uses.groupBy("source", "epoch", "_b").agg(F.sum("n_tokens").alias("_s"))
    before = Window.partitionBy("source", "epoch").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "epoch", "_b", (F.coalesce(F.sum("_s").over(before), F.lit(0))).alias("_start"))
    inside = Window.partitionBy("source", "epoch", "_b").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = uses.join(starts, ["source", "epoch", "_b"]).withColumn("at", (F.col("epoch") - 1) * F.col("have") + F.col("_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    # a record that the budget cuts is used if at least half of it is within, the first one always
    placed = placed.where((F.col("at") == 0) | (F.col("at") + F.col("n_tokens") / 2 <= F.col("budget")))
    placed = placed.withColumn("block", F.least(F.floor(F.col("at") * F.col("blocks") / F.col("budget")), F.col("blocks") - 1))
    mixed = placed.join(F.broadcast(order) if slots <= FEW_SLOTS else order, ["source", "block"]).select("slot", F.col("at").alias("offset"), "source", "doc_id", "epoch", "n_tokens")
    mixed = durable(mixed, "mix")
    reached = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_uses"), F.max("epoch").alias("max_used"))
    asked = spark.createDataFrame([(s, float(w), int(m), int(have.get(s, 0)), int(got[s])) for s, (w, m) in wanted.items()], "source string, target_weight double, max_repeats int, have_tokens long, budget long")
    used = mixed.agg(F.sum("n_tokens")).first()[0] or 0
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    shares = asked.join(reached, "source", "left").select("source", "target_weight", "max_repeats", "have_tokens", "budget", n("tokens"), n("n_uses"), n("max_used"), (F.coalesce("tokens", F.lit(0)) / F.lit(float(used or 1))).alias("share"))
    return mixed, shares
