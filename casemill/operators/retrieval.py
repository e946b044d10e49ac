"""Candidates for query cases, their fusion and ranking, and packing into a token budget; all query cases at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.plans.durable import durable

#: cases of the same court that a query case gets
COURT_LIMIT = 50
#: queries of one block: what is broadcast at once
BLOCK = 2048
#: vectors that a task compares with a block at once
CHUNK = 1024
#: pairs that a task computes in double precision at once
PAIRS = 8192
PROXIMITY = {1: 1.0, 2: 0.5, 3: 0.3, 4: 0.1}
W_SEMANTIC, W_GRAPH, W_SCORE, W_IRAC = 0.4, 0.3, 0.2, 0.1


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query, key, cosine, rank): the exact k vectors nearest to each query, never the query itself.

    queries, vectors: key, vector; of one width. The queries stream through the driver as bytes, in blocks of bounded size,
    and each block is compared with all vectors where these lie. A task sends on at most k rows a query, so what is shuffled
    doesn't grow with the vectors. Where there are several blocks each is one job, whose k rows a query are written
    before the next is broadcast. Ties rank by the smaller key. Zero vectors have cosine 0 with all.

    Single precision finds what can be among the k best, by the greatest error that it can have; these are computed in
    double precision pair by pair, so equal vectors have equal cosines wherever they lie.
    """
    spark = vectors.sparkSession
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "key")

    def unit(x: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    def numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        return keys, batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                keys, x = numbers(batch.slice(start, block))
                yield pa.RecordBatch.from_pylist([{"keys": keys.tobytes(), "kind": x.dtype.str, "numbers": x.tobytes()}])

    def search(keys: np.ndarray, numbers_: np.ndarray) -> tuple[DataFrame, Broadcast]:
        shared = spark.sparkContext.broadcast((keys, numbers_))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qk, q = shared.value
            q = unit(q.astype(np.float64))
            single, error = q.astype(np.float32), 2 * (q.shape[1] + 8) * 2.0**-24
            at, keys, cos, least = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(len(qk), -2.0)
            for batch in batches:
                if not batch.num_rows:
                    continue
                every, all_ = numbers(batch)
                for start in range(0, len(every), CHUNK):
                    mk, x = every[start : start + CHUNK], unit(all_[start : start + CHUNK].astype(np.float64))
                    sims = single @ x.astype(np.float32).T
                    sims[qk[:, None] == mk[None, :]] = -9
                    bound = least - error
                    if len(mk) >= k and (least < -1).any():  # what is below the k-th of the chunk, or of those before, can't be among the k best
                        bound = np.maximum(bound, np.partition(sims, -k, axis=1)[:, -k] - 2 * error)
                    row, column = np.nonzero(sims >= np.maximum(bound, -8).astype(np.float32)[:, None])
                    for run in range(0, len(row), PAIRS):
                        r, c = row[run : run + PAIRS], column[run : run + PAIRS]
                        at, keys, cos = np.concatenate([at, r]), np.concatenate([keys, mk[c]]), np.concatenate([cos, np.einsum("ij,ij->i", q[r], x[c])])
                        order = np.lexsort((keys, -cos, at))
                        at = at[order]
                        first = np.arange(at.size) - np.searchsorted(at, at) < k
                        at, keys, cos = at[first], keys[order][first], cos[order][first]
                    full = np.flatnonzero(np.bincount(at, minlength=len(qk)) >= k)
                    least[full] = np.maximum(least[full], cos[np.searchsorted(at, full, "right") - 1])
            yield pa.RecordBatch.from_arrays([pa.array(qk[at], pa.int64()), pa.array(keys, pa.int64()), pa.array(cos, pa.float64())], ["query", "key", "cosine"])

        hits = vectors.select(F.col("key").cast("long"), "vector").mapInArrow(best, "query long, key long, cosine double")
        return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), shared

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        packs = queries.select(F.col("key").cast("long"), "vector").repartition("key").mapInArrow(packed, "keys binary, kind string, numbers binary")
        for row in packs.toLocalIterator():
            keys = np.frombuffer(row[0], np.int64)
            held.append((keys, np.frombuffer(row[2], row[1]).reshape(len(keys), -1)))
            if sum(len(x) for x, _ in held) > block:
                keys, x = (np.concatenate(z) for z in zip(*held))
                yield keys[:block], x[:block]
                held = [(keys[block:], x[block:])]
        if held:
            yield tuple(np.concatenate(z) for z in zip(*held))

    paths, last = [], None
    for some in blocks():
        if last is not None:
            hits, shared = search(*last)
            paths.append(durable(hits, "hits")._written_at)
            shared.destroy()
        last = some
    if last is None:
        return spark.createDataFrame([], "query long, key long, cosine double, rank int")
    hits, shared = search(*last)
    if not paths:
        return hits
    paths.append(durable(hits, "hits")._written_at)
    shared.destroy()
    return spark.read.schema(hits.schema).parquet(*paths)


def same_attribute(queries: DataFrame, attribute: DataFrame, value: str, cases: DataFrame, limit: int | None = None) -> DataFrame:
    """(query, docket_id): other cases that share a value. attribute: docket_id, value; queries: query (docket ids).

    limit: at most so many a query and value, the least docket ids. Then each value is cut to limit + 1 cases before it
    is joined, so a value that a third of all cases share gives no more rows than another.
    """
    mine = queries.join(attribute.withColumnRenamed("docket_id", "query"), "query").select("query", value).distinct()
    theirs = attribute.select("docket_id", value).distinct().join(cases.select("docket_id"), "docket_id", "left_semi")
    if limit is not None:
        first = Window.partitionBy(value).orderBy("docket_id")
        theirs = theirs.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= limit + 1).drop("_n")
    found = mine.join(theirs, value).where("docket_id <> query")
    if limit is not None:
        first = Window.partitionBy("query", value).orderBy("docket_id")
        found = found.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= limit)
    return found.select("query", "docket_id").distinct()


def closest(candidates: DataFrame) -> DataFrame:
    """The least distance of each (query, opinion_id); at equal distance the reason of lower rank."""
    w = Window.partitionBy("query", "opinion_id").orderBy("distance", "reason_rank")
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def leading(queries: DataFrame, members: DataFrame, own: DataFrame, semantic: DataFrame, facts: DataFrame, value: str, distance: int, k: int = 10, most: int | None = None) -> DataFrame:
    """(query, opinion_id, distance): the opinions at a distance, by a shared value, that can be among the k best of a query.

    queries: query, value; members: value, opinion_id; own: query, opinion_id, left out; all distinct. Opinions without a
    semantic score that are as near by one value rank by their facts alone, for every query alike: behind k others of the
    value an opinion has k better candidates, so each value is cut to its first k, and room for the query's own, before
    it is joined (``most``: the most of own of any query, counted here if not given). Of all its values together a query keeps as many again, in the same order. An opinion with a semantic score is
    looked for in all values of its query. So what is formed grows with queries and members and not with their product, and
    the k best are those of all opinions.
    """
    room = queries.join(own.groupBy("query").agg(F.count("*").alias("_own")), "query", "left").select("query", value, (F.coalesce("_own", F.lit(0)) + k).alias("_room"))
    widest = room.groupBy(value).agg(F.max("_room").alias("_most"))
    limit = k + ((own.groupBy("query").count().agg(F.max("count")).first()[0] or 0) if most is None else most)
    placed = members.join(widest, value).join(facts, "opinion_id", "left").withColumn("_total", _total(F.lit(None), F.lit(distance)))
    placed = placed.withColumn("_n", F.row_number().over(Window.partitionBy(value).orderBy(F.desc("_total"), "opinion_id")))
    first = placed.where(F.col("_n") <= limit).where("_n <= _most").select(value, "opinion_id", "_total", "_n")
    # an opinion of several values has one place
    found = room.join(first, value).where("_n <= _room").withColumn("_n", F.dense_rank().over(Window.partitionBy("query").orderBy(F.desc("_total"), "opinion_id")))
    found = found.where(F.col("_n") <= limit).where("_n <= _room").select("query", "opinion_id")
    scored = semantic.select("query", "opinion_id").join(queries, "query").join(members, [value, "opinion_id"], "left_semi").select("query", "opinion_id")
    return found.unionByName(scored).distinct().join(own, ["query", "opinion_id"], "left_anti").withColumn("distance", F.lit(distance))


def _total(semantic, distance):
    """The final score by the columns score and has_irac; nulls count 0."""
    near = F.lit(0.0)
    for at, value in PROXIMITY.items():
        near = F.when(distance == at, value).otherwise(near)
    return F.round(W_SEMANTIC * F.greatest(F.coalesce(semantic.cast("double"), F.lit(0.0)), F.lit(0.0)) + W_GRAPH * near + W_SCORE * F.abs(F.coalesce("score", F.lit(0.0))) + W_IRAC * F.coalesce(F.col("has_irac").cast("double"), F.lit(0.0)), 6)


def fused(semantic: DataFrame, graph: DataFrame, facts: DataFrame, k: int = 10) -> DataFrame:
    """(query, opinion_id, semantic, distance, final_score, rank) of the k best candidates of each query.

    semantic: query, opinion_id, semantic; graph: query, opinion_id, distance; facts: opinion_id, score, has_irac.
    Candidates are those of either side. Ties rank by the smaller opinion.
    """
    both = semantic.groupBy("query", "opinion_id").agg(F.max("semantic").alias("semantic")).join(graph.select("query", "opinion_id", "distance"), ["query", "opinion_id"], "full_outer").join(facts, "opinion_id", "left")
    ranked = both.withColumn("final_score", _total(F.col("semantic"), F.col("distance"))).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("final_score"), "opinion_id")))
    return ranked.where(F.col("rank") <= k).select("query", "opinion_id", F.round("semantic", 6).alias("semantic"), "distance", "final_score", "rank")


def pack(items: DataFrame, budget: int, used: str = "used", full: str = "full_tokens", brief: str = "brief_tokens", brief_header: int = 0) -> DataFrame:
    """(query, opinion_id, rank, form): what fits each query's budget, in order of rank, until the first that overflows.

    Full entries first; then, if any are left, a header and brief entries of the rest, again until the first overflow.
    Sizes are never negative, so an entry is in exactly if the running sum up to it fits.
    """
    w = Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = items.withColumn("_sum", F.sum(full).over(w) + F.col(used)).withColumn("_full", F.col("_sum") <= budget)
    taken = Window.partitionBy("query")
    rows = rows.withColumn("_base", F.col(used) + F.coalesce(F.sum(F.when(F.col("_full"), F.col(full))).over(taken), F.lit(0)) + brief_header)
    rows = rows.withColumn("_rest", F.col("_base") + F.sum(F.when(F.col("_full"), 0).otherwise(F.col(brief))).over(w))
    form = F.when(F.col("_full"), "full").when(F.col("_rest") <= budget, "brief")
    return rows.withColumn("form", form).where("form is not null").select("query", "opinion_id", "rank", "form")
