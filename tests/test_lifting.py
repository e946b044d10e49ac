"""Annotators, lowered elements, sinks, report and command line."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from casemill.operators import agreement as A
from casemill.operators import lifting as Li
from casemill.operators import lowering as L
from casemill.operators.extractions import ELEMENTS, parsed
from casemill.operators.graph import CaseGraph, chain_sample, chains_of_three
from casemill.operators.retrieval import same_attribute
from casemill.operators.statistics import beta_tail, bootstrap, two_sided
from casemill.plans.ranking import sum_below
from casemill.queries.lifting import eligible
from casemill.sources import sinks as K


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_agreement_of_annotators(spark):
    """The latest annotation counts; missing elements are NOT_ANALYZED; a retest is intra-rater; lone annotators have no pair."""
    data = [("a", 1, {"scienter": "SATISFIED"}, "MIXED", 1), ("a", 1, {"scienter": "CONTESTED"}, "PLAINTIFF_WINS", 2), ("b", 1, {"scienter": "CONTESTED"}, "PLAINTIFF_WINS", 1), ("b", 2, {}, "MIXED", 1), ("a", 2, {}, "DEFENDANT_WINS", 1), ("a retest", 2, {}, "DEFENDANT_WINS", 1), ("z", 9, {}, "MIXED", 1), (None, 1, {}, "MIXED", 1)]
    df = spark.createDataFrame(data, "annotator string, docket_id int, statuses map<string,string>, outcome string, at int")
    got = {(r["annotator_1"], r["annotator_2"]): r for r in A.pairs(A.latest_annotations(df, F.desc("at"))).collect()}
    assert set(got) == {("a", "a retest"), ("a", "b"), ("a retest", "b")}
    assert got["a", "b"]["n_shared"] == 2 and got["a", "b"]["element_kappa"] == 1.0 and got["a", "b"]["outcome_kappa"] == pytest.approx(1 / 3, abs=1e-6)
    assert got["a", "a retest"]["type"] == "intra-rater" and got["a", "b"]["type"] == "inter-rater"
    assert A.pairs(df.limit(0)).count() == 0


def test_element_accuracy(spark):
    truth = spark.createDataFrame([(1, {"scienter": "SATISFIED"}), (2, {"scienter": "CONTESTED"}), (3, {"scienter": "odd"})], "docket_id int, statuses map<string,string>")
    said = spark.createDataFrame([(1, {"scienter": "SATISFIED"}), (2, {"scienter": "SATISFIED"}), (3, {}), (4, {})], "docket_id int, statuses map<string,string>")
    got = {r["element"]: r for r in A.element_accuracy(truth, said).collect()}
    assert set(got) == set(ELEMENTS) and (got["scienter"]["n"], got["scienter"]["accuracy"], got["scienter"]["balanced"]) == (2, 0.5, 0.5)
    assert got["reliance"]["n"] == 3 and got["reliance"]["accuracy"] == 1.0
    assert {r["n"] for r in A.element_accuracy(truth.limit(0), said).collect()} == {0}


def test_completed_records_and_flags(spark):
    good = '{"outcome": "MIXED", "elements": {"scienter": {"status": "SATISFIED", "confidence": 0.9}}}'
    df = spark.createDataFrame([(1, 10, 100, good, "MTD"), (2, 20, 200, "{cut", None), (3, 30, 300, None, "SJ")], "id int, docket_id long, opinion_id long, extraction string, stage string")
    got = {r["id"]: r for r in L.completed(parsed(df), F.col("stage")).collect()}
    assert [got[k]["failed"] for k in (1, 2, 3)] == [False, True, True]
    assert got[1]["x"]["case_id"] == 10 and got[1]["x"]["procedural_stage"] == "MTD" and got[1]["x"]["elements"]["scienter"]["confidence"] is None
    assert got[2]["x"]["procedural_stage"] == "APPEAL" and set(got[2]["x"]["elements"]) == set(ELEMENTS) and got[2]["x"]["outcome"] == "MIXED" and got[2]["x"]["opinion_id"] == 200
    e = spark.createDataFrame([("SATISFIED", 0.05), ("odd", 0.5), (None, None), ("CONTESTED", None)], "status string, score double")
    assert [(r["status"], r["not_analyzed"], r["contested"]) for r in L.assessed(e, F.col("score")).collect()] == [("SATISFIED", False, True), ("NOT_ANALYZED", True, False), ("NOT_ANALYZED", True, False), ("CONTESTED", False, True)]
    cited = spark.createDataFrame([("nysd", 1, "cacd"), ("nysd", 2, "ca2"), ("nysd", 9, "scotus"), (None, 1, "cacd")], "court_id string, cited_docket long, cited_court string")
    flags = rows(L.citation_flags(cited, spark.createDataFrame([(1,), (2,)], "docket_id long")).select("cited_docket", "verified", "cross_circuit"))
    assert flags == [(1, True, False), (1, True, True), (2, True, False), (9, False, False)]


def test_sinks(spark, tmp_path):
    lifted = spark.createDataFrame([(1, 10, "raw", "{}", []), (2, 20, "raw", None, []), (3, 30, "raw", "{}", ["status"])], "docket_id long, opinion_id long, raw string, extraction string, errors array<string>")
    path = str(tmp_path / "runs")
    for _ in range(2):
        K.append_extractions(lifted, path, "mock")
    back = spark.read.parquet(path)
    assert back.count() == 6 and rows(back.select("docket_id", "is_valid", "errors").distinct()) == [(1, 1, None), (2, 0, '["JSON parse failure"]'), (3, 0, '["status"]')]
    for n in (3, 2):
        K.replace_table(spark.range(n), str(tmp_path / "labels"))
    assert spark.read.parquet(str(tmp_path / "labels")).count() == 2
    K.save_scores(spark.createDataFrame([("case", "1", 0.5), ("argument", "x", 1.0)], "entity_type string, entity_id string, score double"), str(tmp_path / "scores"))
    assert spark.read.parquet(str(tmp_path / "scores")).where("entity_type = 'case'").count() == 1
    twice = spark.createDataFrame([(1,), (1,), (None,), (2,)], "k int")
    assert rows(K.key_violations({"t": (twice, ["k"]), "u": (twice.limit(0), ["k"])})) == [("t", 1, 1), ("u", 0, 0)]
    assert K.first_available(lambda: spark.read.parquet(str(tmp_path / "nowhere")), lambda: twice).count() == 4
    with pytest.raises(Exception):
        K.first_available(lambda: spark.read.parquet(str(tmp_path / "nowhere")))
    cases = spark.createDataFrame([(3, 1), (1, 1), (2, 0)], "docket_id int, has_opinions int")
    assert rows(K.tier(cases, "golden", 1)) == [(1, 1)] and K.tier(cases, "opinions").count() == 2 and K.tier(cases, "all").count() == 3
    with pytest.raises(ValueError):
        K.tier(cases, "other")


def test_eligible_queue_is_shortest_first(spark):
    opinions = spark.createDataFrame([(1, 1, "x" * 1500), (2, 1, "x" * 1200), (3, 1, "x" * 900), (4, 1, None), (5, 2, "x" * 1100), (2, 1, "x" * 1200)], "opinion_id long, docket_id long, plain_text string")
    labels = spark.createDataFrame([(k, "PRIVATE", "MIXED", "MTD") for k in (1, 2, 3, 4)] + [(5, "SEC", "MIXED", "MTD"), (5, "PRIVATE", "UNLABELED", "MTD")], "opinion_id long, contamination_type string, outcome_label string, procedural_stage string")
    cases = spark.createDataFrame([(1, "A v. B", "nysd"), (2, "C v. D", "cand")], "docket_id long, case_name string, court_id string")
    done = spark.createDataFrame([], "opinion_id long")
    assert [r["opinion_id"] for r in eligible(opinions, cases, labels, done).collect()] == [2, 1]
    assert [r["opinion_id"] for r in eligible(opinions, cases, labels, done, 1).collect()] == [2]
    assert eligible(opinions, cases, labels, spark.createDataFrame([(2,)], "opinion_id long")).count() == 1


def test_ranks_over_ranges_and_tails(spark):
    values = list(np.random.default_rng(1).permutation(300))
    df = spark.createDataFrame([(int(v), int(v % 7 + 1)) for v in values], "v int, c int")
    want, total = {}, 0
    for v in range(300):
        want[v], total = total, total + v % 7 + 1
    assert {r["v"]: r["below"] for r in sum_below(df, "v", "c", "below").collect()} == want
    assert sum_below(df.limit(0), "v", "c", "below").count() == 0
    assert beta_tail(0.3, 2, 3) == pytest.approx(0.3483) and two_sided(0.5, 10) == pytest.approx(0.14111, abs=1e-4)
    assert two_sided(1.0, 5) == 0 and two_sided(None, 5) is None and two_sided(0.5, 2) is None
    many = spark.range(2_000_000).select((F.col("id") % 4 == 0).cast("int").alias("hit"))
    b = bootstrap(many, "hit", resamples=300).first()
    assert b["point"] == 0.25 and 0.2485 < b["low"] < 0.25 < b["high"] < 0.2515
    assert bootstrap(many.limit(0), "hit").first()["point"] is None


def test_chains_and_court_limit(spark):
    links = [(1, 2), (2, 3), (3, 1), (2, 1), (4, 4), (4, 2), (5, 6)]
    cites = spark.createDataFrame(links, "src long, dst long")
    want = sorted((a, b, d) for a, b in links for c, d in links if b == c and a != d)
    count = {a: sum(x == a for x, _, _ in want) for a, _, _ in want}
    assert dict(rows(chains_of_three(cites))) == count
    assert [tuple(r) for r in chain_sample(cites, 3).collect()] == want[:3] and [tuple(r) for r in chain_sample(cites, 50).collect()] == want
    cases = spark.createDataFrame([(k, "x" if k < 8 else "y") for k in range(10)], "docket_id int, court_id string")
    q = spark.createDataFrame([(0,), (5,), (9,)], "query int")
    got = rows(same_attribute(q, cases, "court_id", cases, 3))
    assert got == [(0, 1), (0, 2), (0, 3), (5, 0), (5, 1), (5, 2), (9, 8)]
    assert len(rows(same_attribute(q, cases, "court_id", cases))) == 15


def test_blobs_and_encoders(spark):
    df = spark.createDataFrame([(1, [1.0, -2.5]), (2, None), (3, [])], "k int, v array<double>")
    back = {r["k"]: r["w"] for r in df.select("k", Li.vector_of_blob(Li.blob_of_vector("v")).alias("w")).collect()}
    assert back == {1: [1.0, -2.5], 2: None, 3: []}
    texts = spark.createDataFrame([(1, "ab"), (2, None), (3, ""), (4, "abcd")], "opinion_id long, plain_text string")
    got = {r["opinion_id"]: r["embedding"] for r in Li.encoded(texts, lambda ts: np.array([[len(t), 1] for t in ts]), 2).collect()}
    assert got == {1: [2.0, 1.0], 4: [4.0, 1.0]}


def test_command_line_and_report(spark, capsys, tmp_path):
    from casemill.__main__ import main
    from casemill.report import as_markdown

    assert main(["list"]) == 0 and "fused_rank" in capsys.readouterr().out
    assert main(["run", "no such query", "/root/testdata/sf0.001"]) == 2
    assert main(["run", "node_judge", "/root/testdata/sf0.001", "--out", str(tmp_path / "out"), "--format", "json"]) == 0
    assert spark.read.json(str(tmp_path / "out")).columns == ["judge"]
    text = as_markdown(spark.createDataFrame([("a|b", None), ("c", 1), ("d", 2)], "x string, n int"), 2)
    assert text.splitlines()[0] == "| x | n |" and "a\\|b |  |" in text and text.endswith("Only the first 2 rows.")


def test_kept_graph_gives_the_same_frames(spark):
    lazy, kept = CaseGraph(spark, "/root/testdata/sf0.001"), CaseGraph(spark, "/root/testdata/sf0.001", keep=True)
    for name in ("cases", "has_opinion", "cites", "involves"):
        assert rows(getattr(lazy, name)()) == rows(getattr(kept, name)()) == rows(getattr(kept, name)())
    assert set(lazy.nodes()) == {"Case", "Opinion", "Statute", "Argument", "Judge", "Company", "Firm"} and len(lazy.edges()) == 7


def test_case_retrieval_is_over_all_cases(spark):
    """Every case that has a precedent counts, not every 50th."""
    from casemill.queries import retrieval as Q
    from casemill.queries.lifting import case_retrieval

    sf = "/root/testdata/sf0.01"
    g = CaseGraph(spark, sf, keep=True)
    owned = Q.fused_rank(spark, sf, every=1, g=g).join(g.has_opinion(), "opinion_id")
    assert case_retrieval(spark, sf).first()["n"] == owned.select("query").distinct().count() > g.cases().count() / 2
