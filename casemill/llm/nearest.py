"""Most similar vectors for every vector, by learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts; a small softmax classifier learns, for a vector, in
which parts its neighbours lie. Every vector is placed in its most probable part and sent as a query to the most
probable parts, where cosines are computed in double precision on a shortlist. Two levels of classifiers are broadcast;
parts that are still too large are cut again where they lie, level by level, each by a classifier of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.plans.durable import broadcast_if_small, durable

#: vectors that the partition and the classifier are fitted on, at most
SAMPLE = 6144
#: vectors a part should hold, and parts of one level at most: a part needs some dozens of sample vectors
PART_SIZE, MAX_PARTS = 512, 64
#: members and queries of one block
BLOCK = 4096
#: vectors of a part, in part sizes, beyond which it is cut again, rows of one task of that, and levels at most
TOO_LARGE, STREAM, DEPTH = 8, 200_000, 6
#: parts that a query is sent to: until so much of the probability is covered, at most PROBES
COVER, PROBES = 0.97, 5


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Ids of the k nearest other rows of each unit row."""
    n, out = len(x), []
    k = min(k, n - 1)
    for at in range(0, n, 1024):
        sims = x[at : at + 1024] @ x.T
        sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -np.inf
        out.append(np.argpartition(-sims, k - 1, axis=1)[:, :k] if k else np.zeros((len(sims), 0), int))
    return np.concatenate(out)


def bisect(nodes: np.ndarray, u: np.ndarray, v: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Halves of equal size (as a mask) of a graph of local edges u-v, with few edges between.

    Power iteration gives an approximate Fiedler vector, its median the first halves; then swaps of the nodes with the
    greatest gains, as long as they cut fewer edges.
    """
    n = nodes.size
    degree = np.bincount(u, minlength=n).astype(float) + 1
    x = rng.standard_normal(n)
    for _ in range(60):
        x = 0.5 * x + 0.5 * (np.bincount(u, x[v], n) + x) / degree
        x -= (x * degree).sum() / degree.sum()
        x /= np.abs(x).max() or 1
    side = np.zeros(n, bool)
    side[np.argsort(x, kind="stable")[n // 2 :]] = True
    cut = (side[u] != side[v]).sum()
    for _ in range(12):
        gain = np.bincount(u, np.where(side[u] != side[v], 1.0, -1.0), n)
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(a.size, b.size)
        better = int((gain[a[:m]] + gain[b[:m]] > 0).sum())
        if not better:
            break
        tried = side.copy()
        take = max(1, better // 2)
        tried[a[:take]], tried[b[:take]] = False, True
        now = (tried[u] != tried[v]).sum()
        if now >= cut:
            break
        side, cut = tried, now
    return side


def partition(graph: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """Part of each node: recursive bisection of the symmetrised neighbour graph into a power of two of balanced parts."""
    n, rng = len(graph), np.random.default_rng(seed)
    u = np.repeat(np.arange(n), graph.shape[1])
    v = graph.ravel()
    u, v = np.concatenate([u, v]), np.concatenate([v, u])
    part = np.zeros(n, int)
    for _ in range(int(np.log2(parts))):
        halves = np.zeros(n, int)
        for p in range(part.max() + 1):
            nodes = np.flatnonzero(part == p)
            local = np.full(n, -1)
            local[nodes] = np.arange(nodes.size)
            inside = (local[u] >= 0) & (local[v] >= 0)
            halves[nodes] = 2 * p + bisect(nodes, local[u[inside]], local[v[inside]], rng)
        part = halves
    return part


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_router(x: np.ndarray, parts: int, k: int = 10, epochs: int = 24, seed: int = 5) -> np.ndarray:
    """Weights (dim + 1, parts) of a classifier from a unit vector to the parts of its neighbours."""
    graph = neighbour_graph(x, k)
    part = partition(graph, parts, seed)
    near = np.zeros((len(x), parts), np.float32)
    np.add.at(near, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1.0)
    near[np.arange(len(x)), part] += 2.0
    near /= near.sum(axis=1, keepdims=True)
    # begin at the parts' means, which point the right way
    means = np.stack([x[part == p].mean(axis=0) if (part == p).any() else np.zeros(x.shape[1]) for p in range(parts)])
    w = np.concatenate([unit(means + 1e-9).T * 10, np.zeros((1, parts))]).astype(np.float32)
    xb = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(np.float32)
    rng, m, s, step = np.random.default_rng(seed), np.zeros_like(w), np.zeros_like(w), 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 512):
            rows = order[at : at + 512]
            g = xb[rows].T @ (softmax(xb[rows] @ w) - near[rows]) / len(rows) + 1e-5 * w
            step += 1
            m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
            w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return w


class Router:
    """Parts of one level, or of two: each part of the first may be cut again by a classifier of its own."""

    def __init__(self, first: np.ndarray | None, second: dict[int, np.ndarray] | None = None, fan: int = 1):
        self.first, self.second, self.fan = first, second or {}, fan

    def top(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """(parts, probabilities) of each unit row, the most probable first; part = first * fan + second."""
        if self.first is None:
            return np.zeros((len(x), 1), int), np.ones((len(x), 1))
        xb = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(np.float32)
        p = softmax(xb @ self.first)
        top = np.argsort(-p, axis=1, kind="stable")[:, :probes]
        mass = np.take_along_axis(p, top, axis=1)
        if self.fan == 1:
            return top, mass
        parts, values = np.zeros((len(x), top.shape[1] * probes), int), np.zeros((len(x), top.shape[1] * probes))
        for c in range(top.shape[1]):
            for f in np.unique(top[:, c]):
                rows = np.flatnonzero(top[:, c] == f)
                w = self.second.get(int(f))
                q = softmax(xb[rows] @ w) if w is not None else np.ones((rows.size, 1))
                inner = np.argsort(-q, axis=1, kind="stable")[:, :probes]
                at = c * probes + np.arange(inner.shape[1])
                parts[rows[:, None], at] = f * self.fan + inner
                values[rows[:, None], at] = mass[rows, c][:, None] * np.take_along_axis(q, inner, axis=1)
        order = np.argsort(-values, axis=1, kind="stable")[:, :probes]
        return np.take_along_axis(parts, order, 1), np.take_along_axis(values, order, 1)

    def route(self, x: np.ndarray, cover: float, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """(parts, wanted): the most probable parts of each unit row, and which of them it is sent to, two at least."""
        top, mass = self.top(x, probes)
        wanted = mass > 0
        wanted[:, :1] = True
        wanted[:, 2:] &= mass.cumsum(axis=1)[:, 1:-1] < cover
        return top, wanted


def _power(n: int, most: int) -> int:
    return 1 << max(0, min(most, n).bit_length() - 1)


def _fit(rows: DataFrame, by: str, parts: int) -> dict[int, np.ndarray]:
    """A classifier for each value of ``by``, fitted where its sample lies; the weights come to the driver."""
    fit = lambda pdf: pd.DataFrame({"g": pdf[by].iloc[:1], "w": [fit_router(unit(np.stack(pdf["vector"]).astype(np.float32)), parts).tobytes()]})
    return {r["g"]: np.frombuffer(r["w"], np.float32).reshape(-1, parts) for r in rows.groupBy(by).applyInPandas(fit, "g int, w binary").toLocalIterator()}


def fit_levels(vectors: DataFrame, n: int, sample: int, part_size: int, max_parts: int) -> Router:
    """The router of n vectors. A sample is what lies below a cut of the keys' hash, about ``sample`` rows each."""
    whole = n // part_size
    parts = _power(whole, max_parts)
    if parts < 2:
        return Router(None)
    spot = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    router = Router(_fit(vectors.where(spot < sample / n).select("vector", F.lit(0).alias("g")), "g", parts)[0])
    fan = _power(whole // parts, max_parts)
    if fan < 2:
        return router
    shared = vectors.sparkSession.sparkContext.broadcast(router)

    def place(batches):
        for batch in batches:
            if not batch.empty:
                part = shared.value.top(unit(np.stack(batch["vector"].to_numpy()).astype(np.float32)), 1)[0][:, 0]
                yield batch.assign(g=part)

    placed = vectors.mapInPandas(place, "key long, vector array<float>, g int")
    sizes = vectors.sparkSession.createDataFrame(placed.groupBy("g").count().collect(), "g int, n long")  # max_parts rows
    drawn = placed.join(F.broadcast(sizes), "g").where((spot < sample / F.col("n")) & (F.col("n") >= 2 * part_size)).select("g", "vector")
    return Router(router.first, _fit(drawn, "g", fan), fan)


def deepen(rows: DataFrame, sample: int, part_size: int, max_parts: int, cover: float, probes: int) -> DataFrame:
    """Rows (part, key, home, data) with every part of more than TOO_LARGE * part_size vectors cut into smaller ones.

    A large part gets a classifier of its own, fitted on a sample of its vectors. The classifiers are a table: rows are
    sorted behind the one of their part and stream past it, a part in as many tasks as its rows ask for, so neither the
    number of parts nor their size meets a bound. A vector goes to its most probable new part, a query to those that
    cover its neighbours, ``probes`` at most. Parts that stay too large after DEPTH levels, of equal vectors say, are
    still cut into blocks and searched whole.
    """
    for _ in range(DEPTH):
        sizes = rows.groupBy("part").agg(F.count_if("home").alias("n"), F.count("*").alias("rows")).where(F.col("n") > TOO_LARGE * part_size)
        sizes = durable(sizes, "large")
        if sizes.isEmpty():
            return rows
        spot = F.pmod(F.xxhash64(F.lit(11), "key"), F.lit(1 << 30)) / float(1 << 30)
        drawn = rows.where("home").join(F.broadcast(sizes.select("part", "n")), "part").where(spot < sample / F.col("n")).select("part", "n", "data")  # a row a part

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            x = unit(np.stack([np.frombuffer(d, np.float32) for d in pdf["data"]]))
            fan = _power(int(pdf["n"].iloc[0]) // part_size, min(max_parts, max(2, len(x) // 8)))
            return pd.DataFrame({"part": pdf["part"].iloc[:1], "data": [fit_router(x, fan).tobytes()]})

        fitted = durable(drawn.groupBy("part").applyInPandas(fit, "part long, data binary"), "classifiers")
        salts = F.ceil(F.col("rows") / STREAM).cast("long")
        leads = fitted.join(sizes, "part").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).select("part", "salt", F.lit(None).cast("long").alias("key"), F.lit(None).cast("boolean").alias("home"), "data")
        large = rows.join(F.broadcast(sizes.select("part", "rows")), "part").withColumn("salt", F.pmod(F.xxhash64("key"), salts)).select("part", "salt", "key", "home", "data")
        sent = leads.unionByName(large).repartition("part", "salt").sortWithinPartitions("part", "salt", F.col("key").isNotNull())

        def cut(batches, max_parts=max_parts):
            w, of = None, None
            for batch in batches:
                out = []
                new = np.flatnonzero(batch["key"].isna().to_numpy())
                for a, b in zip([0, *new], [*new, len(batch)]):
                    piece = batch.iloc[a:b]
                    if a < b and a in new:
                        w, of = np.frombuffer(piece["data"].iloc[0], np.float32), piece["part"].iloc[0]
                        piece = piece.iloc[1:]
                    if piece.empty:
                        continue
                    if of is None or (piece["part"] != of).any():
                        raise ValueError("a part without a classifier")
                    x = unit(np.stack([np.frombuffer(d, np.float32) for d in piece["data"]]))
                    top, wanted = Router(w.reshape(x.shape[1] + 1, -1)).route(x, cover, probes)
                    # a vector at home goes to one part as a member and to the others as a query
                    home = piece["home"].to_numpy(bool)
                    r, c = np.nonzero(wanted)
                    out.append(pd.DataFrame({"part": piece["part"].to_numpy()[r] * max_parts + top[r, c], "key": piece["key"].to_numpy(np.int64)[r], "home": home[r] & (c == 0), "data": piece["data"].to_numpy()[r]}))
                yield pd.concat(out) if out else pd.DataFrame({"part": [], "key": [], "home": [], "data": []})

        small = rows.join(F.broadcast(sizes.select("part")), "part", "left_anti").withColumn("part", F.col("part") * max_parts)
        rows = durable(small.unionByName(sent.mapInPandas(cut, "part long, key long, home boolean, data binary")), "parts")
    return rows


def usable(df: DataFrame, key: str, vector: str, order: str) -> DataFrame:
    """(key, vector) of the latest usable row of each key; ties in ``order`` fall to the greater hash of the vector.

    Usable: a non-null key, and a vector that is not null or empty, without null, NaN and infinite entries, and not all
    zeros. The choice is made on keys, stamps and hashes alone, so the vectors themselves aren't shuffled for it.
    Rows that are equal in all of these stay; knn() counts them once.
    """
    good = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    rows = df.select(F.col(key).alias("key"), F.col(vector).alias("vector"), F.coalesce(F.col(order).cast("string"), F.lit("")).alias("stamp")).where(
        F.col("key").isNotNull() & (F.size("vector") > 0) & good
    )
    newest = Window.partitionBy("key").orderBy(F.desc("stamp"), F.desc("h"))
    marks = rows.select("key", "stamp", F.xxhash64("vector").alias("h")).distinct()
    old = broadcast_if_small(durable(marks.withColumn("n", F.row_number().over(newest)).where("n > 1").select("key", "stamp", "h"), "old"))
    return rows.withColumn("h", F.xxhash64("vector")).join(old, ["key", "stamp", "h"], "left_anti").select("key", "vector")


def knn(vectors: DataFrame, k: int = 5, sample: int = SAMPLE, part_size: int = PART_SIZE, cover: float = COVER, probes: int = PROBES, max_parts: int = MAX_PARTS) -> DataFrame:
    """(key, neighbour, cosine, rank): for every row of (key, vector) its k most similar others.

    vectors: long keys and usable vectors of one width; rows of one key must be equal. Equal cosines rank by the smaller key. With no more
    than k others all of them come out; with fewer than two parts' worth of rows the search is exact. The sample that
    the index is fitted on is bounded, every vector is indexed and searched for. A part is cut into blocks of members
    and of queries, so no task holds more than BLOCK of each, however full a part is.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("key", F.col("vector").cast("array<float>").alias("vector"))
    n = vectors.count()
    router = fit_levels(vectors, n, sample, part_size, max_parts)
    shared = spark.sparkContext.broadcast(router)  # width * MAX_PARTS * (MAX_PARTS + 1) floats at most

    def send(batches):
        for batch in batches:
            if batch.empty:
                continue
            x, keys = np.stack(batch["vector"].to_numpy()).astype(np.float32), batch["key"].to_numpy()
            top, wanted = shared.value.route(unit(x), cover, probes)
            r, c = np.nonzero(wanted[:, 1:])
            own = [v.tobytes() for v in x]
            yield pd.DataFrame({"part": np.concatenate([top[:, 0], top[r, c + 1]]), "key": np.concatenate([keys, keys[r]]), "home": np.arange(len(x) + r.size) < len(x), "data": own + [own[i] for i in r]})

    routed = vectors.mapInPandas(send, "part long, key long, home boolean, data binary")
    if n > TOO_LARGE * part_size * max_parts * max_parts:
        routed = deepen(durable(routed, "parts"), sample, part_size, max_parts, cover, probes)
    sizes = routed.groupBy("part").agg(F.ceil(F.count_if("home") / BLOCK).alias("mb"), F.ceil(F.count("*") / BLOCK).alias("qb"))
    sizes = durable(sizes, "sizes")  # a row a part
    h = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
    placed = routed.join(broadcast_if_small(sizes), "part").where("mb > 0")
    placed = placed.withColumn("own_m", h % F.col("mb")).withColumn("own_q", F.shiftright(h, 8) % F.col("qb"))

    def place(m, q, member, query):
        return F.struct(m.alias("m"), q.alias("q"), F.lit(member).alias("member"), F.lit(query).alias("query"))

    # members go to their block for every block of queries, queries to theirs for every block of members
    as_member = F.transform(F.sequence(F.lit(0), F.col("qb") - 1), lambda q: place(F.col("own_m"), q, True, False))
    as_query = F.transform(F.sequence(F.lit(0), F.col("mb") - 1), lambda m: place(m, F.col("own_q"), False, True))
    single = F.array(place(F.lit(0).cast("long"), F.lit(0).cast("long"), True, True))
    where = F.when(~F.col("home"), as_query).when(F.col("mb") * F.col("qb") == 1, single).otherwise(F.concat(as_member, as_query))
    blocks = placed.withColumn("to", F.explode(where)).select("part", "to.m", "to.q", "to.member", "to.query", "key", "data")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        members, queries = pdf[pdf["member"]].drop_duplicates("key"), pdf[pdf["query"]].drop_duplicates("key")
        if members.empty or queries.empty:
            return pd.DataFrame({"key": [], "neighbour": [], "cosine": []})
        mk, qk, data = members["key"].to_numpy(), queries["key"].to_numpy(), queries["data"].to_numpy()
        exact = unit(np.stack([np.frombuffer(d, np.float32) for d in members["data"]]).astype(np.float64))
        rough, out = exact.astype(np.float32), []
        take = min(k + 8, len(mk))
        for at in range(0, len(qk), 512):
            ids = qk[at : at + 512]
            q = unit(np.stack([np.frombuffer(d, np.float32) for d in data[at : at + 512]]).astype(np.float64))
            sims = q.astype(np.float32) @ rough.T
            sims[ids[:, None] == mk[None, :]] = -2
            top = np.argpartition(-sims, take - 1, axis=1)[:, :take]
            fine = np.einsum("qd,qtd->qt", q, exact[top])
            fine[mk[top] == ids[:, None]] = -2
            order = np.lexsort((mk[top], -fine), axis=1)[:, :k]
            top, fine = np.take_along_axis(top, order, 1), np.take_along_axis(fine, order, 1)
            good = fine > -1.5
            out.append(pd.DataFrame({"key": np.repeat(ids, good.sum(axis=1)), "neighbour": mk[top[good]], "cosine": fine[good]}))
        return pd.concat(out)

    found = blocks.groupBy("part", "m", "q").applyInPandas(search, "key long, neighbour long, cosine double")
    best = Window.partitionBy("key").orderBy(F.desc("cosine"), "neighbour")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
