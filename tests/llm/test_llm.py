"""The training-data operators against brute force, round trips and held-out accuracy."""

import itertools
import os
import random
import sys
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from casemill.llm import leaks as L
from casemill.llm import mixing as M
from casemill.llm import names as N
from casemill.llm import near_copies as D
from casemill.llm import nearest as K
from casemill.llm import pieces as P
from casemill.llm import queries as Q
from casemill.llm import scans as O
from casemill.llm import sentences as S
from casemill.llm import splits as Sp
from casemill.llm.components import components
from casemill.llm.shingles import jaccard, shingles, word_hashes
from casemill.llm.trie_join import Trie, trie_join
from casemill.tables import table

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---------------------------------------------------------------- queries


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    df = Q.queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = Counter(tuple(r[c] for c in columns) for r in df.collect())
    if name.endswith("_found"):
        assert not ours or max(ours.values()) == 1
    if name in Q.oracle_sql():
        con = duckdb.connect()
        for f in os.listdir(SF):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
        rel = con.execute(Q.oracle_sql()[name])
        order = [x[0] for x in rel.description]
        assert ours == Counter(tuple(r[order.index(c)] for c in columns) for r in rel.fetchall())


# ---------------------------------------------------------------- splits


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5), (None, 3)]
    root = {x: x for e in edges for x in e if None not in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = dict(rows(components(spark.createDataFrame(edges, "a int, b int"))))
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_splits_follow_rules_and_targets(spark):
    rng = random.Random(2)
    data = [(1, 10, "train"), (1, 11, " Dev "), (2, 12, "VALIDATION"), (2, 13, None), (3, None, "unassigned"), (None, 5, "train")]
    data += [(100 + rng.randrange(900), i, None) for i in range(4000)] + [(7, 90_000 + i, None) for i in range(300)]
    df = spark.createDataFrame(data, "docket_id long, opinion_id long, split string").withColumn("state", F.lit("clash"))
    got = Sp.split_dockets(spark, df)
    by = {r["docket_id"]: r for r in got.collect()}
    assert len(by) == got.count() == len({d for d, *_ in data if d is not None})
    assert by[1]["state"] == "quarantined" and by[1]["split"] is None
    assert by[2]["state"] == "kept" and by[2]["split"] == "val"
    assert by[3]["state"] == "new" and by[3]["split"] in Sp.TARGETS
    weight = Counter()
    for d, o, _ in data:
        if d is not None and o is not None and by[d]["split"]:
            weight[by[d]["split"]] += 1
    for s, share in Sp.TARGETS.items():
        assert abs(weight[s] / sum(weight.values()) - share) < 0.02
    assert rows(got) == rows(Sp.split_dockets(spark, df))


def test_splits_are_kept_between_batches(spark, tmp_path):
    store = str(tmp_path / "store")
    first = spark.createDataFrame([(f"r{i}", f"e{i // 2}") for i in range(60)], "record string, entity string")
    ones = lambda df: df.select("record", F.lit(1).alias("weight")).distinct()
    a = {r["node"]: r["split"] for r in Sp.update(spark, store, first, ones(first)).collect()}
    two = next((x, y) for x in range(30) for y in range(30) if a[f"e:e{x}"] != a[f"e:e{y}"])
    same = next((x, y) for x in range(30) for y in range(x + 1, 30) if a[f"e:e{x}"] == a[f"e:e{y}"] and not {x, y} & set(two))
    second = spark.createDataFrame([("m1", f"e{two[0]}"), ("m1", f"e{two[1]}"), ("m2", f"e{same[0]}"), ("m2", f"e{same[1]}"), ("n", "fresh")], "record string, entity string")
    b = {r["node"]: (r["split"], r["state"]) for r in Sp.update(spark, store, second, ones(second)).collect()}
    assert b[f"e:e{two[0]}"] == b[f"e:e{two[1]}"] == (None, "quarantined")
    assert b[f"e:e{same[0]}"] == b[f"e:e{same[1]}"] == (a[f"e:e{same[0]}"], "kept")
    assert b["e:fresh"][1] == "new"
    for e in set(range(30)) - set(two):
        assert b[f"e:e{e}"][0] == a[f"e:e{e}"]


def test_a_record_of_an_earlier_batch_ties_its_entities(spark, tmp_path):
    """(r1, A) then (r1, B): both entities must be in one split, and a later (r2, C), (r2, A) with another split is quarantined."""
    ones = lambda df: df.select("record", F.lit(1).alias("weight")).distinct()
    batch = lambda *rows: spark.createDataFrame(list(rows), "record string, entity string")
    store = str(tmp_path / "ties")
    one = batch(("r1", "A"), ("r9", "Z"), ("r8", None))
    first = {r["node"]: r for r in Sp.update(spark, store, one, ones(one)).collect()}
    assert set(first) == {"r:r1", "e:A", "r:r9", "e:Z", "r:r8"}
    two = batch(("r1", "B"))
    second = {r["node"]: r for r in Sp.update(spark, store, two, ones(two)).collect()}
    assert len({(second[n]["component"], second[n]["split"]) for n in ("r:r1", "e:A", "e:B")}) == 1
    assert second["e:B"]["split"] == first["r:r1"]["split"] and second["e:B"]["state"] == "kept" and second["r:r1"]["weight"] == 1
    assert second["r:r9"]["split"] == first["r:r9"]["split"]
    other = next(s for s in Sp.TARGETS if s != first["r:r1"]["split"])
    three = batch(("r2", "C"), ("r2", "A"))
    prior = spark.createDataFrame([("r2", other)], "record string, split string")
    third = {r["node"]: r for r in Sp.update(spark, store, three, ones(three), prior).collect()}
    assert {third[n]["state"] for n in ("r:r1", "r:r2", "e:A", "e:B", "e:C")} == {"quarantined"} and third["e:C"]["split"] is None
    four = batch(("r3", "C"))
    fourth = {r["node"]: r for r in Sp.update(spark, store, four, ones(four)).collect()}
    assert fourth["r:r3"]["state"] == "quarantined" and fourth["r:r9"]["split"] == first["r:r9"]["split"]


def test_splits_by_several_entities(spark):
    """Null and blank entities tie nobody; a chain over two columns is one component; extra columns don't matter."""
    data = [(1, "x", 10, "c"), (2, "x", 11, "c"), (3, None, 11, "c"), (4, " ", None, "c"), (5, " ", None, "c"), (None, "x", 10, "c"), (1, "x", 10, "c")]
    df = spark.createDataFrame(data, "id int, author string, source int, component string")
    got = {r["id"]: r for r in Sp.split_records(spark, df, "id", ["author", "source"]).collect()}
    assert len({got[k]["component"] for k in (1, 2, 3)}) == 1 and len({r["component"] for r in got.values()}) == 3
    assert all(r["split"] in Sp.TARGETS for r in got.values())


def test_splits_of_empty_tables(spark):
    assert Sp.split_dockets(spark, spark.createDataFrame([], "docket_id long, opinion_id long, split string")).count() == 0


# ---------------------------------------------------------------- names


def test_trie_join_against_brute_force(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(160)} | {"ab", "ba"}
    want = {(a, b) for a in words for b in words if a != b and N.distance(a, b) <= 1}
    got = {tuple(r) for r in trie_join(spark.createDataFrame([(w,) for w in [*words, *words]] + [(None,)], "w string")).collect()}
    assert got == want
    trie = Trie(sorted(words))
    for q in list(words)[:25]:
        assert set(trie.near(q, 2)) == {w for w in words if N.distance(q, w, 2) <= 2}


def test_distance():
    for a, b, d in [("ab", "ba", 1), ("abc", "ac", 1), ("abc", "abd", 1), ("", "a", 1), ("abcd", "badc", 2), ("ca", "abc", 3)]:
        assert N.distance(a, b, 5) == d


@pytest.mark.parametrize("name", ["", "  ", "John Doe", "Does 1-10", "DOES 1 through 25, inclusive", "Unknown Defendants", "n/a"])
def test_nobody(name):
    assert N.read_name(name) is None


@pytest.mark.parametrize("name", ["Doe Run Co", "Sealed Air Corp", "Unknown Worlds Entertainment Inc.", "Doeman, Peter", "Various Artists Holdings LLC"])
def test_somebody(name):
    assert N.read_name(name) is not None


@pytest.mark.parametrize("name", ["Doe 3", "Jane Roe", "John Does 1 through 10", "To be assigned", "UNKNOWN", "Sealed Defendant 2", "Unnamed Trader No. 4", "Redacted", "Doe Corporations 1-5"])
def test_nobody_by_whole_name(name):
    assert N.read_name(name) is None


def test_orders_and_short_names(spark):
    """Parts in any order, short names beside a far more used one with the same other part, and neither without support."""
    names = [f"{g} {h}" for g in ("John", "Mary", "Peter", "Alice") for h in ("Smith", "Wagner", "Hooper")] + ["Smith John", "Hooper Mary Ann", "Thomas James", "James Thomas"]
    names += ["John Kim"] * 20 + ["John Kin", "Susan Kin", "Robert Wong", "Robert Wang"] + ["Robert Wong"] * 19 + ["John Carter"] * 20 + ["John Cartre", "Mary Ann Hooper"]
    got = {r["name"]: r["entity"] for r in N.entities(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    same = [("Smith John", "John Smith"), ("Hooper Mary Ann", "Mary Ann Hooper"), ("Thomas James", "James Thomas"), ("John Kin", "John Kim"), ("Robert Wang", "Robert Wong"), ("John Cartre", "John Carter")]
    apart = [("Susan Kin", "John Kim"), ("John Smith", "Mary Smith"), ("John Smith", "John Wagner"), ("Robert Wong", "John Kim")]
    assert all(got[a] == got[b] for a, b in same), [(a, got[a], b, got[b]) for a, b in same if got[a] != got[b]]
    assert all(got[a] != got[b] for a, b in apart)


PEOPLE = {
    "a": ["Edward M. Butnallid", "BUTNALLID, EDWARD", "Butnallid, E.M.", "Ted  Butnallid et al.", "Mr. Edwadr Butnallid (pro se)", "Edward Butnalild"],
    "b": ["Olga E. Butnallid", "O. Butnallid", "Butnallid, Olga E., as Trustee"],
    "c": ["Abigail B. Veskenbal", "Hon. Abby Veskenbal", "AB Veskenbal", "Veskenbal, Abigail, U.S.D.J.", "Chief Judge Abigail Veskenabl"],
    "d": ["Baldurmun Digital Systems Ltd.", "Bal durmun Digital Systems Limited", "The Baldurmun Digi. Sys., Ltd et al.", "Systems Digital Baldurmun Ltd.", "Baldurmun Digital Systems", "Badlurmun Digital Syst. Ltd"],
    "e": ["Baldurmun Nutrition Industries, Inc.", "Baldurmun Nutrition Indus. Inc., and its subsidiaries"],
    "f": ["Kensolvar Mineral Partners L.P.", "Kensolvar Mineral Ptnrs., Limited Partnership (nominal defendant)", "Kensolvar LP"],
}
OTHERS = ["Rikpontal Digital Systems Ltd.", "Gorvandul Digital Holdings Inc.", "Zumfelkar Nutrition Industries Corp.", "Tembilrok Nutrition Systems Inc.", "Wolsanter Mineral Services LLC", "Hirgulman Mineral Partners Inc."]


def test_entities(spark):
    names = [n for v in PEOPLE.values() for n in v] + OTHERS
    data = [(i, n) for i, n in enumerate(names)] + [(900, None), (901, ""), (902, "John Doe"), (0, names[0]), (903, names[0])]
    got = N.link(spark.createDataFrame(data, "id long, name string").withColumn("entity", F.lit(1)), "id", "name")
    by = defaultdict(set)
    for r in got.collect():
        by[r["id"]].add(r["entity"])
    assert not {900, 901, 902} & set(by) and by[903] == by[0]
    index = {n: i for i, n in enumerate(names)}
    for group, spelled in PEOPLE.items():
        assert len({frozenset(by[index[n]]) for n in spelled}) == 1, (group, [(n, by[index[n]]) for n in spelled])
    assert len({frozenset(by[index[v[0]]]) for v in PEOPLE.values()}) == len(PEOPLE)
    pairs = N.linked_pairs(got, "id")
    assert pairs.where("a >= b").count() == 0 and pairs.count() == pairs.distinct().count()
    assert N.link(spark.createDataFrame([], "id long, name string"), "id", "name").count() == 0


# ---------------------------------------------------------------- nearest


def exact(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return [sorted(range(len(x)), key=lambda j: (-s[i, j], j))[:k] for i in range(len(x))]


def vectors(spark, x, keys=None):
    return spark.createDataFrame([(int(k), [float(v) for v in r]) for k, r in zip(keys if keys is not None else range(len(x)), x)], "key long, vector array<float>")


def test_knn_is_exact_while_small(spark):
    x = np.random.default_rng(1).standard_normal((70, 12)).astype(np.float32)
    x[3] = x[4]
    df = vectors(spark, x)
    got = defaultdict(list)
    for r in K.knn(df.unionAll(df.limit(9)), 5).orderBy("rank").collect():
        got[r["key"]].append(r["neighbour"])
    assert [got[i] for i in range(70)] == exact(x.astype(float), 5)
    assert K.knn(df.limit(0), 5).count() == 0 and K.knn(df.limit(1), 5).count() == 0 and K.knn(df.limit(3), 5).count() == 6


@pytest.mark.parametrize("levels", [{"part_size": 64}, {"part_size": 32, "max_parts": 4}])
def test_knn_recall(spark, levels):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 24))
    x = (centres[rng.integers(0, 40, 900)] + 0.4 * rng.standard_normal((900, 24))).astype(np.float32)
    want = exact(x.astype(float), 5)
    got = K.knn(vectors(spark, x), 5, sample=500, **levels).collect()
    hit = sum(r["neighbour"] in want[r["key"]] for r in got)
    assert hit / 4500 > 0.9 and len(got) == 4500


def recall(x: np.ndarray, got, every: int) -> float:
    """Share of the true five nearest, by brute force, of every so many vectors."""
    u = K.unit(x.astype(np.float64))
    found = defaultdict(set)
    for r in got:
        found[r["key"]].add(r["neighbour"])
    asked = range(0, len(x), every)
    hits = 0
    for q in asked:
        s = u @ u[q]
        s[q] = -2
        hits += len(found[q] & set(np.argsort(-s, kind="stable")[:5].tolist()))
    return hits / (5 * len(asked))


def test_recall_of_wide_vectors_at_two_levels(spark):
    """Vectors of 768 numbers from the tables; the cosines are those of the whole vectors, in double precision."""
    rows = K.usable(table(spark, "/root/testdata/sf0.1", "opinion_embeddings").where((F.col("model_name") == "lexvec-base-768") & (F.size("embedding") == 768)), "opinion_id", "embedding", "created_at").collect()
    x = np.array([r["vector"] for r in rows], np.float32)
    got = K.knn(vectors(spark, x), 5, sample=600, part_size=24, max_parts=8).collect()
    assert len(x) > 1000 and recall(x, got, 7) > 0.9
    u = K.unit(x.astype(np.float64))
    assert all(abs(u[r["key"]] @ u[r["neighbour"]] - r["cosine"]) < 1e-12 for r in got[:500])


def test_recall_of_parts_cut_level_by_level(spark, monkeypatch):
    """More vectors than two levels hold: large parts are cut again until none is too large."""
    monkeypatch.setattr(K, "TOO_LARGE", 2)
    monkeypatch.setattr(K, "STREAM", 150)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((120, 48))
    x = (np.repeat(centres, 12, axis=0) + 0.25 * rng.standard_normal((1440, 48))).astype(np.float32)
    got = K.knn(vectors(spark, x), 5, sample=400, part_size=24, max_parts=4).collect()
    assert recall(x, got, 5) > 0.9 and {r["key"] for r in got} == set(range(1440))
    seen = Counter((r["key"], r["rank"]) for r in got)
    assert max(seen.values()) == 1


def test_usable(spark):
    nan = float("nan")
    data = [(1, [1.0, 0.0], "2024"), (1, [0.0, 2.0], "2025"), (2, [0.0, 0.0], "2025"), (3, [nan, 1.0], "2025"), (3, [3.0, 1.0], "2020"), (4, None, "2025"), (5, [], "2025"), (None, [1.0, 1.0], "2025"), (6, [1.0, None], "2025")]
    df = spark.createDataFrame(data, "id long, e array<float>, at string")
    assert rows(K.usable(df, "id", "e", "at")) == [(1, [0.0, 2.0]), (3, [3.0, 1.0])]


def test_partition_is_balanced_and_cuts_few_edges():
    rng = np.random.default_rng(3)
    x = K.unit(np.repeat(np.eye(8), 40, axis=0) + 0.05 * rng.standard_normal((320, 8)))
    graph = K.neighbour_graph(x, 5)
    part = K.partition(graph, 8)
    assert Counter(part.tolist()).most_common()[0][1] == 40 == Counter(part.tolist()).most_common()[-1][1]
    assert (part[graph] == part[:, None]).mean() > 0.9


# ---------------------------------------------------------------- near copies


def test_word_hashes_are_those_of_words():
    a, b = word_hashes("The cat, the CAT!"), word_hashes("x the\tcat")
    assert a[0] == a[2] == b[1] and a[1] == a[3] == b[2] and a[0] != a[1]
    assert word_hashes("").size == word_hashes("¡—!").size == 0 and shingles("one two three four").size == 0
    assert shingles("a b c d e f").size == 2


@pytest.mark.parametrize("t", [0.5, 0.8])
def test_near_copies_against_brute_force(spark, t):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(250)]
    texts = []
    for base in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([4, 6, 12, 80, 300]))]
        for _ in range(4):
            copy = list(words)
            for _ in range(rng.randrange(0, max(2, len(words) // 12))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(0, 2)] = [rng.choice(vocabulary)]
            texts.append(" ".join(copy))
    texts += [texts[0].upper() + "!", "", "w1 w2", " ".join(["same"] * 50)]
    data = [(i, x) for i, x in enumerate(texts)] + [(0, texts[0]), (500, None), (None, "x")]
    links, classes = D.near_copies(spark.createDataFrame(data, "id long, body string").withColumn("text", F.lit(1)), "id", "body", 5, t)
    sets = [shingles(x) for x in texts]
    norm = [" ".join(__import__("re").findall("[a-z0-9]+", x.lower())) for x in texts]
    same = lambda i, j: norm[i] == norm[j]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if same(i, j) or jaccard(sets[i], sets[j]) >= t - 1e-12}
    assert {tuple(r) for r in D.all_pairs(links, classes).collect()} == want
    groups = {r["key"]: r["group_id"] for r in D.groups(links, classes).collect()}
    assert set(groups) == set(range(len(texts))) and all(groups[i] == groups[j] for i, j in want)


def test_common_phrases_form_no_pairs_of_all(spark, monkeypatch):
    """Texts of phrases that many share, and copies of some: few candidates whatever the ranges, and no blob or list of pairs beyond its bound."""
    rng = random.Random(8)
    phrases = [" ".join(f"p{i}x{k}" for k in range(9)) for i in range(60)]
    texts = [" ".join(rng.choice(phrases) if rng.random() < 0.55 else " ".join(f"u{n}y{k}z{j}" for j in range(9)) for k in range(40)) for n in range(300)]
    texts += [f"{x} and one more end" for x in texts[::10]]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string").repartition(1)
    monkeypatch.setattr(D, "RANGE_SIZE", 500)
    got = {tuple(r) for r in D.candidates(df, 5, 0.5).collect()}
    sets = [shingles(x) for x in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if jaccard(sets[i], sets[j]) >= 0.5}
    assert len(want) >= 30 and want <= got and len(got) < len(texts) * 10


@pytest.mark.parametrize("pairs", [1, 7, 10**6])
def test_runs_of_pairs_are_the_same(monkeypatch, pairs):
    monkeypatch.setattr(D, "PAIRS", pairs)
    rng = np.random.default_rng(2)
    size = rng.integers(5, 40, 30)
    rows = sorted({(int(a), int(size[b]), int(b)) for a, b in zip(rng.integers(0, 12, 200), rng.integers(0, 30, 200))})
    token, doc = np.array([r[0] for r in rows]), np.array([r[2] for r in rows], np.int32)
    got = [(int(a), int(b), int(n)) for x in D._pairs(token, doc, size, 0.5) for a, b, n in zip(*x)]
    lists = {d: {x for x, _, e in rows if e == d} for d in range(30)}
    want = {frozenset((a, b)): len(lists[a] & lists[b]) for a in range(30) for b in range(a) if lists[a] & lists[b] and 2 * min(size[a], size[b]) >= max(size[a], size[b])}
    assert len(got) == len(want) and all(want[frozenset((a, b))] == n for a, b, n in got)


@pytest.mark.parametrize("few", [0, 8, 10**6])
def test_copies_are_left_out_without_moving_texts(spark, monkeypatch, few):
    """Many copies of few texts: texts are read where they lie, or moved once where neither side is few; the pairs are the same."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(90)) for _ in range(60)) for _ in range(6)]
    texts[1] = f"{texts[0]} and more"
    data = [(100 * i + k, x) for i, x in enumerate(texts) for k in range(9)] + [(0, texts[0])]
    monkeypatch.setattr(D, "FEW", few)
    seen = []
    monkeypatch.setattr(D, "candidates", lambda texts, n, t, was=D.candidates: (seen.append(texts._jdf.queryExecution().optimizedPlan().toString()), was(texts, n, t))[1])
    links, classes = D.near_copies(spark.createDataFrame(data, "id long, body string"), "id", "body", 5, 0.5)
    assert ("Join" in seen[0], "LeftSemi" in seen[0]) == ((False, False) if few == 0 else (True, few == 8))
    got = [tuple(r) for r in D.all_pairs(links, classes).collect()]
    want = {(a, b) for a, x in data for b, y in data if a < b and (a // 100 == b // 100 or a < 100 and b // 100 == 1)}
    assert len(got) == len(want) and set(got) == want


def test_packed_keys():
    for keys in ([5], [-7, -6, 2**40], [2**62, 2**62 + 1], [-(2**63), 2**63 - 1]):
        assert D.unpacked_keys(D.packed_keys(np.array(keys, np.int64))).tolist() == keys
    assert len(D.packed_keys(np.arange(10**9, 10**9 + 100))) < 120
    for x in ([], [3, 65535], [3, 65536]):
        assert D._wide(D._narrow(np.array(x, np.int64)), len(x)).tolist() == x


def test_near_copies_of_nothing(spark):
    links, classes = D.near_copies(spark.createDataFrame([], "id long, body string"), "id", "body")
    assert links.count() == classes.count() == 0


def test_packed_integers():
    for v in (np.array([], np.uint64), np.array([0, 5, 5, 2**40, 2**63], np.uint64), np.arange(300, dtype=np.uint64)):
        assert (D.unpacked(D.packed(v)) == v).all()


# ---------------------------------------------------------------- scans


def page_text(rng, lines, name):
    """A text as printed, its lines' true kinds, and the text as scanned."""
    scanned, truth = [], []
    for p in range(6):
        scanned += [f"   Case 1:20-cv-00{name} Document {name} Filed 01/02/20 Page {p + 1} of 6", ""]
        truth += [(len(scanned) - 1, "header")]
        for _ in range(18):
            line, kinds = rng.choice(lines), []
            if rng.random() < 0.2:
                words = line.split()
                at = next((i for i, w in enumerate(words) if w.isalpha() and len(w) > 5 and "c" in w[1:]), None)
                if at is not None:
                    words[at] = words[at][0] + words[at][1:].replace("c", "□", 1)
                    line, kinds = " ".join(words), ["misread"]
            scanned.append(line)
            truth += [(len(scanned), k) for k in kinds]
        scanned += ["", f"        - {p + 1} -", "\f"]
        truth.append((len(scanned) - 1, "page_number"))
    return "\n".join(scanned), set(truth)


def test_noise_of_pages_is_found(spark):
    rng = random.Random(5)
    nouns = "contract record customer scienter account practice decision revenue inventory forecast auditor market".split()
    verbs = "reflected concealed increased produced recited included collected described".split()
    lines = [f"The {rng.choice(nouns)} {rng.choice(verbs)} the {rng.choice(nouns)} and the {rng.choice(nouns)} {rng.choice(verbs)} it" for _ in range(400)]
    made = [page_text(rng, lines, 100 + i) for i in range(14)]
    clean = ["\n".join(rng.sample(lines, 40)) + "\n\n4711\n" for _ in range(14)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)] + [(100 + i, t) for i, t in enumerate(clean)] + [(900, ""), (901, None)], "id long, body string")
    got = {r["id"]: {(n["line_no"], n["kind"]) for n in r["noise"]} for r in O.repair(df, "id", "body").collect()}
    assert 901 not in got and got[900] == set() and all(got[100 + i] == set() for i in range(14))
    found, true = {(i, x) for i in range(14) for x in got[i]}, {(i, x) for i in range(14) for x in made[i][1]}
    assert len(found & true) / len(true) > 0.95 and len(found & true) / len(found) > 0.95


def test_repaired_text_is_continuous(spark):
    body = ["The auditor described the contr□ct and the forecast of reve-", "nue as a third-", "party practice.", "", "    A new paragraph begins here and ends."]
    pages = "\n".join(f"   Case 1:20-cv-1 Document 9 Filed 01/02/20 Page {p} of 4\n\nThe contract of revenue is a third-party practice of the auditor.\n\n        - {p} -\n\f" for p in range(1, 5)) + "\n" + "\n".join(body)
    df = spark.createDataFrame([(i, pages) for i in range(6)], "id long, body string")
    text = O.repair(df, "id", "body").first()["text"]
    assert "of revenue as a third-party practice." in text and "contract and" in text
    assert "Document 9" not in text and "- 2 -" not in text and "\n\nA new paragraph" in text


def test_labels_of_words_are_the_same_at_every_size(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abdghkmnoprstuvwz", k=rng.randint(5, 9))) for _ in range(150)]
    lines = [" ".join(rng.choices(words, range(150, 0, -1), k=9)) for _ in range(400)]
    page = "\n".join(f"   Case 1:20-cv-7 Document 9 Filed 01/02/20 Page {p} of 4\n\n{words[40 + p]}\n{words[50]}-\n{words[60]} {words[70]}\n\n        - {p} -\n\f" for p in range(1, 5))
    found = []
    for times in (1, 50):
        df = spark.createDataFrame([("\n".join(lines),)] * times + [(page,)], "text string")
        repairer = O.fit(df)
        found.append((repairer.read(page)[0], repairer.join(words[50], words[60], Counter()), repairer.edit("xq" + words[3], Counter())))
        assert abs(repairer.lexicon[words[0]] - O.REFERENCE * sum(x.split().count(words[0]) for x in lines) / 3600) < 0.05 * repairer.lexicon[words[0]]
    assert found[0] == found[1]


def test_joins_of_broken_words_are_learned():
    rng = random.Random(8)
    words = sorted({"".join(rng.choices("abdghkmnoprstuvwz", k=rng.randint(4, 9))) for _ in range(500)})
    held, words = words[:100], words[100:]
    lexicon = dict.fromkeys(words, 60) | {f"{rng.choice(words)}-{rng.choice(words)}": 5 for _ in range(150)}
    r = O.Repairer(lexicon, {}, O.Perceptron(), O.Editor())
    O.train_joins(r)
    pairs = [(x, y) for x, y in zip(words, words[7:]) if f"{x}-{y}" not in lexicon]
    assert sum(not r.join(x, y, Counter()) for x, y in pairs) > 0.9 * len(pairs)
    assert sum(r.join(w[:2], w[2:], Counter()) for w in held) > 90
    assert r.join(words[0][:2], words[0][2:], Counter()) and not r.join(*next(w for w in lexicon if "-" in w).split("-"), Counter())


def test_characters_are_edited_by_their_labels():
    """Held-out misreadings of one and two places; words stay as they are; figures among letters go without a lexicon."""
    rng = random.Random(11)
    parts = "con rep tra men der sti bil gro fal cum ner vol fin dic mar tel ous ive".split()
    words = sorted({"".join(rng.choices(parts, k=rng.randint(2, 4))) for _ in range(1500)})
    lexicon = {w: rng.choice([20, 60, 300]) for w in words} | {"10b": 40, "2d": 30, "15u": 20, "401k": 30}
    editor = O.train_words(lexicon)
    count = lambda w: lexicon.get(w, 0)
    asked = [(*O.misread(w, times, rng), w, times) for w in rng.choices(words, k=1500) for times in (1, 2)]
    asked = [(read, w, times) for read, edits, w, times in asked if len(edits) == times and read not in lexicon]
    for times in (1, 2):
        got = [O.best_edit(editor, read, 0, count) for read, _, t in asked if t == times]
        true = [w for _, w, t in asked if t == times]
        assert sum(g is not None and g[0] == w for g, w in zip(got, true)) > 0.95 * len(true)
    assert sum(O.best_edit(editor, w, lexicon[w], count) is None for w in words) > 0.99 * len(words)
    held = sorted({"".join(rng.choices(parts, k=3)) for _ in range(200)} - set(words))
    read = [(O.misread(w, 1, rng, "0")[0], w) for w in held if "o" in w]
    assert sum((e := O.best_edit(editor, r, 0, count)) is not None and e[0] == w for r, w in read) > 0.9 * len(read)
    assert O.best_edit(editor, "10b", 40, count) is None and O.best_edit(editor, "", 0, count) is None
    for word, edits in (("modem", ((2, "d", "cl"), (4, "m", "rn"))), ("rn", ((0, "rn", "m"),)), ("x", ())):
        assert [*itertools.chain(*map(O.labels, edits))] == {"modem": ["replace d>c", "insert l", "replace m>r", "insert n"], "rn": ["replace r>m", "delete n"], "x": []}[word]


def test_unbroken_drops_both_halves():
    assert O.unbroken("one two-\nthree four").split() == ["one", "four"]
    assert O.unbroken("plain text") == "plain text"


# ---------------------------------------------------------------- pieces


@pytest.mark.parametrize("seed", range(6))
def test_pieces_cover_the_text(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["word ", "a", "é", "Sentence. ", "\n", "\n\n", "x" * 40, " "]) for _ in range(600))
    points = P.code_points(text)
    for limit, overlap in ((100, 20), (37, 0), (500, 499), (10_000, 200)):
        parts = P.cuts(P.boundaries(points), points.size, None, limit, overlap)
        assert parts[0][0] == 0 and parts[-1][1] == points.size
        for (a, b, level), (c, d, _) in zip(parts, parts[1:]):
            assert c == b - overlap and d > b and b - a <= limit
            assert level == "hard" or text[b - 1].isspace()
        assert all(b - a <= limit for a, b, _ in parts)


def test_pieces_by_tokens():
    text = "one two three four five six seven eight nine ten " * 5
    points = P.code_points(text)
    offsets = np.concatenate(([0], np.cumsum((points == 32).astype(int))))
    parts = P.cuts(P.boundaries(points), points.size, offsets, 10, 2)
    assert all(offsets[b] - offsets[a] <= 10 for a, b, _ in parts) and parts[-1][1] == points.size


def test_levels():
    line, word = "x" * 30, "y" * 5
    for text, level in [("\n \n".join([line] * 9), "paragraph"), ("\n".join([line] * 9), "line"), (" ".join([word] * 50), "word"), ("z" * 99, "none"), ("", "paragraph"), ("\n\n", "paragraph")]:
        assert P.sufficient(P.code_points(text), 40) == level


def test_pieces_of_a_table(spark):
    df = spark.createDataFrame([(1, "a b " * 60), (1, "a b " * 60), (2, "short"), (3, None), (4, " " * 300), (5, "é" * 150)], "id long, body string").withColumn("key", F.lit(0))
    got = P.split_pieces(df, "id", "body", 100, 10).collect()
    assert {r["id"] for r in got} == {1, 5} and len(got) == len({(r["id"], r["piece_no"]) for r in got})
    for k, text in ((1, "a b " * 60), (5, "é" * 150)):
        mine = sorted((r for r in got if r["id"] == k), key=lambda r: r["piece_no"])
        assert mine[0]["piece"] + "".join(r["piece"][10:] for r in mine[1:]) == text
    with pytest.raises(ValueError):
        P.cuts([], 5, None, 10, 10)


# ---------------------------------------------------------------- leaks


def edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        before, row = row, [i]
        for j, c in enumerate(text, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (p != c)))
    return min(row)


def test_myers_against_table():
    rng = np.random.default_rng(6)
    p, t = rng.integers(0, 4, (200, 13)), rng.integers(0, 4, (200, 17))
    assert L.myers(p, t).tolist() == [edits(a, b) for a, b in zip(p.tolist(), t.tolist())]
    assert L.myers(rng.integers(0, 2, (3, 64)), rng.integers(0, 2, (3, 70))).shape == (3,)


def test_word_hashes_follow_words_in_any_slice_and_company(monkeypatch):
    """Equal words have equal hashes wherever they stand; slices and joined texts give the words that the pattern gives."""
    texts = ["Straße 12,5 ab-cd", "", "กรุงเทพ 東京 \U0001d504x", "İstanbul ΟΔΟΣ ΟΔΟΣ.", "x" * 50, "a b c d e f g h"]
    split = lambda t: L._WORD.findall(t.lower())
    known = {w: L.word_hashes(w)[0] for t in texts for w in split(t)}
    assert len(set(known.values())) == len(known)
    for chunk in (400_000, 7, 1):
        monkeypatch.setattr(L, "CHUNK", chunk)
        for t in texts:
            assert L.word_hashes(t).tolist() == [known[w] for w in split(t)]
        got = [(k, h) for words, of in L.chunks(texts) for k, h in zip(of.tolist(), words.tolist())]
        assert got == [(k, known[w]) for k, t in enumerate(texts) for w in split(t)]


def test_leaks_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 13, 20, 30])))) for i in range(20)]
    docs = []
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 40, 90]))]
        if k % 2:
            passage = items[rng.randrange(20)][1].split()
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(passage))
                passage[at : at + rng.randrange(0, 2)] = [rng.choice(vocabulary)] * rng.randrange(0, 2)
            words[5:5] = passage
        docs.append((k, ", ".join(words).upper()))
    docs += [(100, "w1 w2"), (101, ""), (102, items[3][1]), (103, " ".join(items[4][1].split()[1:])), (104, " ".join(items[4][1].split()[:1]))]
    want = {}
    for d, text in docs:
        t = text.lower().replace(",", " ").split()
        for i, item in items:
            w = item.split()
            m = min(13, len(w))
            best = min(edits(w[a : a + m], t) for a in range(len(w) - m + 1))
            if best <= (2 if m == 13 else 2 * m // 13):
                want[d, i] = best, m
    data = docs + [(0, docs[0][1]), (999, None), (998, "")]
    for chars in (10_000, 150):  # one block, and several
        got = L.leaks(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items + [(77, None), (78, "absent"), (79, "--")], "item_id long, text string"), block_chars=chars)
        assert {(r["doc_id"], r["item_id"]): (r["edits"], r["words"]) for r in got.collect()} == want and got.count() == len(want)
    assert L.leaks(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert L.leaks(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 0


# ---------------------------------------------------------------- mixing


def test_budgets():
    assert M.budgets({"a": 100, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 4}) == {"a": 100, "b": 100}
    assert M.budgets({"a": 100, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 4}, 400) == {"a": 100, "b": 300}
    assert M.budgets({"a": 10}, {"a": 0.5, "b": 0.5}, {"a": 3, "b": 3}) == {"a": 30, "b": 0}
    assert M.budgets({}, {"a": 1.0}, {"a": 2}) == {"a": 0}


def test_every_prefix_of_the_schedule_is_near_the_shares(spark):
    """Slots are whole, ranked per source, and near the shares in every prefix; a share without a point gets the nearest slot."""
    shares = {"a": 0.5, "b": 0.3, "c": 0.2}
    rows = M.schedule(spark, shares, 5000).collect()
    slots = {s: np.array([r["slot"] for r in sorted(rows, key=lambda r: r["block"]) if r["source"] == s]) for s in shares}
    assert sorted(r["slot"] for r in rows) == list(range(5000)) and all((np.diff(x) > 0).all() for x in slots.values())
    want = ((np.arange(5000) + 0.5) * M.GOLDEN) % 1.0
    assert (slots["a"] == np.flatnonzero(want < 0.5)).all()
    for n in (50, 500, 5000):
        for s, w in shares.items():
            assert abs((slots[s] < n).sum() / n - w) < 4 / n**0.5 / 5 + 0.02
    tiny = [r for r in M.schedule(spark, {"a": 0.5, "t": 1e-9, "b": 0.5 - 1e-9}, 1000).collect() if r["source"] == "t"]
    assert [(r["block"], r["slot"]) for r in tiny] == [(0, int(np.abs(want[:1000] - 0.5).argmin()))]


def test_a_source_with_the_smallest_share_is_not_dropped(spark):
    data = [(i, "a", 100) for i in range(2000)] + [(9000, "b", 60), (9001, "b", 40)]
    targets = spark.createDataFrame([("a", 0.99999, 60), ("b", 0.00001, 1)], "source string, target_weight double, max_repeats int")
    mixed, shares = M.mix(spark.createDataFrame(data, "doc_id long, source string, n_tokens int"), targets)
    got = {r["source"]: r for r in shares.collect()}
    assert got["b"]["tokens"] == 100 and got["b"]["n_uses"] == 2 and got["b"]["max_used"] == 1
    assert abs(got["a"]["tokens"] - got["a"]["budget"]) <= 100 and got["a"]["max_used"] == 50
    assert mixed.where("source = 'b'").count() == 2


def test_mix(spark):
    rng = random.Random(8)
    data = [(i, rng.choice(["a"] * 8 + ["b", "c", "x", None]), rng.randrange(0, 60)) for i in range(4000)]
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("none", 0.1, 2)], "source string, target_weight double, max_repeats int")
    mixed, shares = M.mix(spark.createDataFrame(data, "doc_id long, source string, n_tokens int"), targets, slots=500)
    used = Counter((r["source"], r["doc_id"]) for r in mixed.collect())
    caps = {"a": 1, "b": 3, "c": 2}
    assert all(n <= caps[s] for (s, _), n in used.items()) and {s for s, _ in used} == set(caps)
    got = {r["source"]: r for r in shares.collect()}
    assert got["none"]["tokens"] == 0 and set(got) == {"a", "b", "c", "none"}
    for s, w in (("a", 4 / 9), ("b", 3 / 9), ("c", 2 / 9)):
        assert abs(got[s]["share"] - w) < 0.01
    empty = spark.createDataFrame([], "doc_id long, source string, n_tokens int")
    mixed, shares = M.mix(empty, targets)
    assert mixed.count() == 0 and shares.count() == 4


def test_count_tokens(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("<|endoftext|>",)], "text string")
    assert [r["n_tokens"] for r in M.count_tokens(df).collect()][:3] == [2, 0, 0]


def test_rank_file_and_tokenizer_file_count_alike():
    texts = ["hello  world\n\n", "", "<|endoftext|> it's", "x" + " " * 20_000 + "y", "\n" * 9_000, "a \t" * 4_000, " " * 6_000 + "x" + "\u3000" * 7_000 + "z", "naïve ฅ 12,5 😀"]
    folder = os.path.dirname(M.TOKENIZER)
    assert M.encoder(f"{folder}/byte_bpe_50k.tiktoken")(texts) == M.encoder(f"{folder}/byte_bpe_50k.json")(texts)
    assert M.encoder(M.TOKENIZER)([" " * 2_000_000 + "end"]) == M.encoder(f"{folder}/byte_bpe_50k.json")([" " * 2_000_000 + "end"])


# ---------------------------------------------------------------- sentences


@pytest.fixture(scope="module")
def models(spark):
    return S.train(S.laid_out(table(spark, "/root/testdata/sf0.01", "documents").select(F.col("doc_id").alias("k"), F.col("text").alias("t"))))


@pytest.mark.parametrize(
    "sentences",
    [
        ["Dr. Bortum, an expert for Remlik, put the damage at $38.56 billion, i.e. 39.6% of the float.", "That is not enough!", "Was the proxy statement well-known?"],
        ["Nalrut wrote: “Our product recalls did not match the ledger. Tell nobody before June 2004.”", "On February 4, 2008, the price fell 4 percent."],
        ["The price fell 4 percent to $717.10 million on June 10, 2021.", "(See D.E. 279 at 134.)", "Id. at 441."],
        ["Der Kurs fiel am 19. April 2007 auf 503,29 Mio. Euro.", "Warum nannte der Prospekt nicht auch der Umsatz?"],
        ["Le cours est tombé à 120,86 millions d'euros le 5 avril 2015.", "M. Goklim a déclaré : « le stock ne pose aucun problème. Il n'y a rien à craindre. »", "Rien de tel n'a été prouvé en avril 2006 !"],
        ["El 25 de septiembre de 2016, Losbul S.A. comunicó que las ventas había bajado un 40,5 %.", "¡Nada de eso se probó en julio 2020!"],
        ["См. ст. 293 закона, п. 2, т. е. правило о доказывании.", "Свидетель сказал: «доля рынка растёт. Бояться нечего».", "Коллегия признаёт, что довод не доказан!"],
        ["डॉ. Petlen ने लाभ का मूल्य 421.44 करोड़ रु. आँका।", "गवाह ने कहा, “आरक्षित निधि ठीक है। डरने की बात नहीं।”", "14 मार्च 2011 को लाभ 64.1% घट गई।"],
    ],
)
def test_sentences(models, sentences):
    for joint in (" ", "  ", "\n"):
        text = joint.join(sentences)
        assert [text[a:b] for a, b in S.sentences_of(text, models)] == sentences


def test_sentences_without_spaces(models):
    for sentences in (["证人说：“商誉没有问题。不必担心。”", "为什么董事会记录没有披露用户数量？", "被告指出，重大性不能仅凭订单余额推定。"], ["証人は「保険準備金に問題はない。心配は無用だ。」と述べた。", "第175条第2項を参照。"]):
        text = "".join(sentences)
        assert [text[a:b] for a, b in S.sentences_of(text, models)] == sentences


def test_thai_and_units(models):
    thai = ["พยานแจ้งว่ารายได้ไม่มีปัญหาแต่อย่างใด", "เมื่อปี 2558 เงินสำรองลดลงร้อยละ 63.5 จากปีก่อน", "พยานแจ้งว่ากระแสเงินสดไม่มีปัญหาแต่อย่างใด"]
    text = " ".join(thai)
    assert [text[a:b] for a, b in S.sentences_of(text, models)] == thai
    text = "II. STANDARD OF REVIEW\n(1) An earnings call dated March 9, 1998;\n(2) A letter dated July 7, 2024\nThat is not\nenough! Id. at 4.\n\nFACTS\n\nIt is so ordered."
    got = [text[a:b] for a, b in S.sentences_of(text, models)]
    assert got == ["II. STANDARD OF REVIEW", "(1) An earnings call dated March 9, 1998;", "(2) A letter dated July 7, 2024", "That is not\nenough!", "Id. at 4.", "FACTS", "It is so ordered."]


def test_sentences_lose_no_character(spark, models):
    docs = table(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = defaultdict(list)
    for r in S.sentences(docs, models=models).orderBy("doc_id", "sentence_no").collect():
        got[r["doc_id"]].append((r["start_pos"], r["end_pos"]))
    for k, text in texts.items():
        if text is None or not text.strip():
            assert k not in got
            continue
        kept = "".join(text[a - 1 : b] for a, b in got[k])
        assert "".join(kept.split()) == "".join(text.split())
        assert all(text[a - 1 : b] == text[a - 1 : b].strip() for a, b in got[k])


def test_sentences_without_any_training(spark):
    df = spark.createDataFrame([(1, "One. Two."), (2, None), (3, "  ")], "doc_id long, text string")
    assert {r["doc_id"] for r in S.sentences(df).collect()} == {1}
    assert S.sentences(df.limit(0)).count() == 0


def test_posteriors_of_a_chain_against_all_sequences():
    import itertools
    import zlib

    class Toy(S.Model):
        def p_event(self, before, last):
            return (zlib.crc32(f"{before} {last}".encode()) % 89 + 5) / 100

        def p_start(self, word):
            return (zlib.crc32(word.encode()) % 83 + 5) / 100

        def p_follow(self, last, word):
            return (zlib.crc32(f"{word} {last}".encode()) % 79 + 5) / 100

    words = ["Ab", "U.", "S.", "C.", "Sec.", "Id"]
    model = Toy(set(words), [], Counter(), Counter())
    places = list(zip(words, words[1:], words[2:]))
    total, sums = 0.0, [0.0] * len(places)
    for states in itertools.product((0, 1), repeat=len(places)):
        p, left = 1.0, 0
        for (b, a, n), s in zip(places, states):
            e = model.p_event("<^>" if left else S.shape(b), a)
            p, left = p * (e * model.p_start(n) if s else (1 - e) * model.p_follow(a, n)), s
        total += p
        sums = [x + p * s for x, s in zip(sums, states)]
    assert np.allclose(model.run(places), [x / total for x in sums])


def test_nothing_else_imports_this_subpackage():
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", "import sys, casemill.registry as r; r.queries(); print([m for m in sys.modules if m.startswith('casemill.llm')])"], cwd=root, capture_output=True, text=True)
    assert out.stdout.strip().endswith("[]")


def test_scans_of_an_empty_table(spark):
    assert O.repair(spark.createDataFrame([], "id long, body string"), "id", "body").count() == 0
    only = O.repair(spark.createDataFrame([(1, ""), (2, "x" * 50_000)], "id long, body string"), "id", "body").collect()
    assert {(r["id"], len(r["noise"])) for r in only} == {(1, 0), (2, 0)}
