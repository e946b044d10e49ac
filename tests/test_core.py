"""Units of the core: edge cases, brute force on small fixtures, and plans."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casemill.functions import patterns as P
from casemill.functions import text as T
from casemill.functions.sections import sections
from casemill.operators import constraints as C
from casemill.operators import extractions as X
from casemill.operators import profile as Pr
from casemill.operators import retrieval as R
from casemill.operators import scoring as S
from casemill.operators import statistics as St
from casemill.operators.graph import within_two
from casemill.operators.orphans import orphan_keys, orphans
from casemill.operators.records import upsert
from casemill.plans.ranking import running_sum
from casemill.sources import landed
from casemill.streaming.ingest import KeyedTable, ingest, stream


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_text_normal_forms(spark):
    assert one(spark, T.normalize_argument(F.lit("  The  Claim\tFails.;: "))) == "the claim fails"
    assert one(spark, T.normalize_name(F.lit("Chief Judge  Ann  B. Cole, Jr."))) == "ann b. cole"
    assert one(spark, T.normalize_statute(F.lit("15 U.S.C. §§78j(b)"))) == "15 u.s.c. § 78j(b)"
    assert one(spark, T.statute_key(F.lit("15 USC §§ 78j"))) == "15 usc 78j"
    assert one(spark, T.firm_name(F.lit("Phone 1\nAnn Cole\nCole & Kahn LLP\nx LLP"))) == "Cole & Kahn LLP"
    assert one(spark, T.firm_name(F.lit(None).cast("string"))) is None
    assert one(spark, T.truncate_middle(F.lit("a" * 60 + "b" * 60), 100, "|")) == "a" * 60 + "|" + "b" * 40
    assert one(spark, T.first_text(F.lit(""), F.lit(None), F.lit("z"))) == "z"
    assert one(spark, T.extension(F.lit("x/Y.PDF"))) == "pdf"


@pytest.mark.parametrize(
    "text, label",
    [
        ("The motion to dismiss is hereby granted.", "DEFENDANT_WINS"),
        ("The motion to dismiss is denied.", "PLAINTIFF_WINS"),
        ("It is granted in part and denied in part.", "MIXED"),
        ("The complaint is dismissed. We reverse.", "MIXED"),
        ("The district court denied the motion to dismiss. AFFIRMED.", "PLAINTIFF_WINS"),
        ("AFFIRMED.", "DEFENDANT_WINS"),
        ("Nothing here.", "UNCLEAR"),
        ("", "UNCLEAR"),
    ],
)
def test_outcome(spark, text, label):
    assert one(spark, P.outcome(F.lit(text)))["label"] == label


def test_outcome_of_whole_text_costs_confidence(spark):
    got = one(spark, P.outcome(F.lit("The motion to dismiss is granted." + " x" * 3000)))
    assert (got["label"], got["source"], got["confidence"]) == ("DEFENDANT_WINS", "fulltext_regex", 0.72)


def test_first_pattern_in_list_order_wins(spark):
    got = one(spark, P.first_hit(F.lit("dismissed with prejudice; the complaint is dismissed"), P.DEFENDANT))
    assert got["name"] == "def_complaint_dismissed"


def test_sections(spark):
    """Blank lines before a heading belong to it; a heading near the last one is none; positions count whole characters."""
    text = "COURT\n" * 30 + "\nI. BACKGROUND\n" + "Facts. " * 20 + "\nDISCUSSION\n" + "Law. " * 20 + "\n\n\nCONCLUSION\nDone.\n\nA. Order\n"
    wide = "\U0001d504" * 600 + "\n\nORDER\n" + "z" * 70 + "\nB. Merits\n"
    rows = spark.createDataFrame([(0, text), (1, ""), (2, None), (3, " \n\t"), (4, "No heading at all."), (5, wide), (6, "OPINION\nIt is so.")], "id int, t string")
    got = {r["id"]: [tuple(s) for s in r["s"]] for r in rows.select("id", sections("t").alias("s")).collect()}
    assert [s[:2] for s in got[0]] == [("HEADER", ""), ("BACKGROUND", "BACKGROUND"), ("ANALYSIS", "DISCUSSION"), ("CONCLUSION", "CONCLUSION")]
    assert got[0][0][2] == 0 and got[0][-1][3] == len(text) and all(a[3] == b[2] for a, b in itertools.pairwise(got[0]))
    assert got[0][-1][2] == text.index("\n\nCONCLUSION")
    assert got[1] == got[2] == [("ANALYSIS", "", 0, 0)] and got[3] == [("ANALYSIS", "", 0, 3)] and got[4] == [("ANALYSIS", "", 0, 18)]
    assert got[5] == [("HEADER", "", 0, 601), ("CONCLUSION", "ORDER", 601, 679), ("ANALYSIS", "Merits", 679, 689)]
    assert got[6] == [("ANALYSIS", "OPINION", 0, 17)]


def test_json_in_text(spark):
    df = spark.createDataFrame([("```json\n{\"a\": 1}\n```",), ("so: {\"a\": {\"b\": 2}} ok }",), ("none",), (None,)], "raw string")
    got = [json.loads(r[0]) if r[0] else None for r in df.select(X.json_in_text("raw")).collect()]
    assert got == [{"a": 1}, {"a": {"b": 2}}, None, None]


def test_orphans_edges(spark):
    refs = spark.createDataFrame([(1, 10, "2024-01", "2024-01-05 00:00:00"), (2, 11, "2024-01", "2024-01-05 00:00:00"), (3, 12, "2024-02", None), (4, None, None, None), (5, 13, None, None), (1, 10, "2024-01", "2024-01-05 00:00:00"), (6, 14, "2024-01", "2024-01-05 00:00:00")], "record_id long, key long, period string, stamp string").withColumn("stamp", F.col("stamp").cast("timestamp"))
    parents = spark.createDataFrame([(10, "2024-01", "2024-01-06 00:00:00"), (11, "2024-01", "2024-01-04 00:00:00"), (12, "2024-03", "2024-03-01 00:00:00"), (14, None, None)], "key long, arrived string, stamp string").withColumn("stamp", F.col("stamp").cast("timestamp"))
    got = rows(orphans(refs, parents).select("record_id", "key", "state"))
    assert got == [(1, 10, "late"), (5, 13, "absent")]
    assert rows(orphans(refs.limit(0), parents)) == []
    assert {r[1] for r in rows(orphans(refs, parents.limit(0)).select("record_id", "key"))} == {10, 11, 12, 13, 14}


def test_orphan_keys_against_brute_force(spark):
    rng = random.Random(1)
    refs = [(rng.randrange(90_000), f"2024-0{rng.randrange(1, 5)}") for _ in range(3000)]
    parents = [(k, f"2024-0{rng.randrange(1, 5)}") for k in rng.sample(range(90_000), 40_000)]
    came = dict(parents)
    want = {(p, k) for k, p in refs if not (k in came and came[k] < p)}
    got = {(r[0], r[1]) for r in orphan_keys(spark.createDataFrame(refs, "key long, period string"), spark.createDataFrame(parents, "key long, arrived string")).collect()}
    assert got == want


def test_running_sum_is_a_prefix_sum(spark):
    df = spark.range(500).withColumn("w", (F.col("id") % 7).cast("long"))
    got = running_sum(df, "w", ["id"], "at", buckets=16).collect()
    at = 0
    for r in sorted(got, key=lambda r: (r["at"], r["w"] > 0)):
        assert r["at"] == at
        at += r["w"]


def test_upsert(spark):
    now = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, s int, v string")
    new = spark.createDataFrame([(2, 5, "x"), (2, 4, "y"), (3, 1, "z")], "k int, s int, v string")
    assert rows(upsert(now, new, ["k"], "s")) == [(1, 1, "a"), (2, 5, "x"), (3, 1, "z")]
    assert rows(upsert(now, new, ["k"], "s", "ignore")) == [(1, 1, "a"), (2, 1, "b"), (3, 1, "z")]
    with pytest.raises(ValueError):
        upsert(now, new, ["k"], "s", "other")


def test_reinforce_against_dense_arrays(spark):
    rng = np.random.default_rng(2)
    m = rng.integers(-1, 2, (12, 9))
    seed = np.sign(m.sum(1) + 0.5).astype(int)
    edges = [(int(i), int(j), int(m[i, j]), int(seed[i])) for i in range(12) for j in range(9)]
    x = seed.astype(float)
    for _ in range(4):
        w = m * x[:, None]
        y = np.divide(w.sum(0), np.abs(w).sum(0), out=np.zeros(9), where=np.abs(w).sum(0) > 0)
        w = m * y[None, :]
        x = np.divide(w.sum(1), np.abs(w).sum(1), out=np.zeros(12), where=np.abs(w).sum(1) > 0)
    args, cases, done = S.reinforce(spark.createDataFrame(edges, "case_id int, arg_id int, sign int, seed int"), rounds=4)
    assert done == 4
    assert np.allclose([r["score"] for r in args.orderBy("arg_id").collect()], y)
    assert np.allclose([r["score"] for r in cases.orderBy("case_id").collect()], x)


def test_two_hops(spark):
    cites = spark.createDataFrame([(1, 2), (2, 3), (4, 2), (1, 1), (5, 6)], "src long, dst long")
    got = rows(within_two(spark.createDataFrame([(1,)], "start long"), cites))
    assert got == [(1, 2, 1), (1, 3, 2), (1, 4, 2)]


def test_contained_either_way_against_brute_force(spark):
    rng = random.Random(3)
    words = lambda n: ["".join(rng.choice("ab ") for _ in range(rng.randrange(0, 14))) for _ in range(n)]
    a, b = words(150), [w for w in words(40) if len(w) > 3]
    want = {x for x in a if any(x in y or y in x for y in b)}
    got = {r[0] for r in C.contained_either_way(spark.createDataFrame([(x,) for x in a], "v string"), spark.createDataFrame([(x,) for x in b], "v string")).collect()}
    assert got == want
    assert C.contained_either_way(spark.createDataFrame([("q",)], "v string"), spark.createDataFrame([("",)], "v string")).count() == 1
    assert C.contained_either_way(spark.createDataFrame([("q",)], "v string"), spark.createDataFrame([], "v string")).count() == 0


def test_contained_has_no_cross_join(spark):
    names = spark.createDataFrame([("abc",)], "v string")
    plan = C.contained_either_way(names, names)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_cosine_topk(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((60, 8))
    v[7] = v[8]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "key long, vector array<double>")
    got = R.cosine_topk(df.where("key % 10 = 0"), df, 3, block=2)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for r in got.collect():
        s = u @ u[r["query"]]
        order = sorted((i for i in range(60) if i != r["query"]), key=lambda i: (-s[i], i))
        assert order[r["rank"] - 1] == r["key"] and abs(s[r["key"]] - r["cosine"]) < 1e-9
    assert got.count() == 18
    assert R.cosine_topk(df.limit(0), df, 3).count() == 0


def test_pack_stops_at_first_overflow(spark):
    items = spark.createDataFrame([(1, 10, 1, 50, 5, 10), (1, 11, 2, 60, 5, 10), (1, 12, 3, 5, 30, 10), (1, 13, 4, 5, 1, 10)], "query int, opinion_id int, rank int, full_tokens int, brief_tokens int, used int")
    got = rows(R.pack(items, 100, brief_header=5))
    assert got == [(1, 10, 1, "full"), (1, 11, 2, "brief"), (1, 12, 3, "brief")] or got == [(1, 10, 1, "full"), (1, 11, 2, "brief")]
    assert rows(R.pack(items, 100, brief_header=5)) == [(1, 10, 1, "full"), (1, 11, 2, "brief"), (1, 12, 3, "brief")]


def test_statistics(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, False), (0.8, True), (0.1, False)], "s double, p boolean")
    assert St.auc(df, "s", "p").first()["auc"] == 0.875
    flipped = St.auc(df.withColumn("s", -F.col("s")), "s", "p").first()["auc"]
    assert flipped == 0.125
    assert St.auc(df.where("p"), "s", "p").first()["auc"] is None
    both = spark.createDataFrame([("a", "a"), ("b", "a"), ("b", "b")], "t string, y string")
    assert St.kappa(both, "t", "y").first()["kappa"] == 0.4
    assert St.kappa(both.where("t = 'a'"), "t", "y").first()["kappa"] == 1.0
    assert St.kappa(both.limit(0), "t", "y").first()["kappa"] == 0.0
    assert St.accuracy(both, "t", "y").first()["balanced"] == 0.75
    b = St.bootstrap(spark.createDataFrame([(1.0,), (0.0,), (1.0,)], "v double"), "v", resamples=200).first()
    assert b["low"] <= b["point"] <= b["high"]
    with pytest.raises(ValueError):
        St.bootstrap(spark.range(5), "id", most=3)


def test_profile(spark):
    df = spark.createDataFrame([("a", None), ("", "x"), ("b", " ")], "p string, q string")
    assert rows(Pr.fill_rates(df).select("column_name", "n_filled")) == [("p", 2), ("q", 1)]
    assert rows(Pr.upper_median(spark.createDataFrame([(1,), (2,), (3,), (4,)], "v int"), "v").select("median", "mean", "n")) == [(3, 2.5, 4)]
    assert rows(Pr.upper_median(spark.createDataFrame([], "v int"), "v").select("median", "n")) == [(None, 0)]
    assert one(spark, Pr.decode(F.lit(99), Pr.DISPOSITIONS)) == "Code 99"
    assert one(spark, Pr.decode(F.lit(None).cast("int"), Pr.DISPOSITIONS)) is None
    assert one(spark, Pr.role_class(F.lit("Relief Defendant"))) == "defendant"
    j = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": "y"}',), ('{"a": ',), (None,)], "j string")
    assert {(r["field"], r["type"], r["n"]) for r in Pr.json_profile(j, "j").collect()} == {("a", "BIGINT", 1), ("a", "STRING", 1), ("b", "STRING", 1)}


def test_landed_json(spark, tmp_path):
    page = {"results": [{"docket_id": 1, "id": 7, "date_filed": "2020-01-01", "precedential_status": "P", "sub_opinions": [{"id": 70, "type": "010combined", "author_str": "A", "plain_text": "", "html": "<p>x</p>", "opinions_cited": ["u/1", "u/1"]}]}]}
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.json").write_text(json.dumps(page))
    clusters = landed.read_pages(spark, str(tmp_path / "p"), landed.CLUSTERS)
    assert rows(landed.opinions(clusters).select("opinion_id", "plain_text")) == [(70, "<p>x</p>")]
    assert rows(landed.citation_edges(clusters)) == [(70, "u/1")]
    people = spark.createDataFrame([(1, 5, "N", [(1, "Plaintiff", None), (2, "Defendant", None)], [])], landed.PARTIES)
    assert rows(landed.parties(people).select("party_id", "party_type")) == [(5, "Plaintiff")]
    df = spark.createDataFrame([(1, 'a "b"; c;; ', None)], "k int, v string, w string")
    landed.write_csv(df.select("k", "v"), str(tmp_path / "csv"))
    assert rows(landed.trimmed_csv(spark, str(tmp_path / "csv"))) == [("1", 'a "b"; c;;')]
    assert landed.split_fields(df, ["v", "w"]).first()[1:] == (['a "b"', "c"], [])


def test_stream_repeats_change_nothing(spark, tmp_path):
    src, out = str(tmp_path / "in"), KeyedTable(spark, str(tmp_path / "t"), ["k"], "s")
    spark.createDataFrame([(1, 1), (2, 1), (1, 3)], "k int, s int").write.parquet(src)
    events = stream(spark, src, "k int, s int")
    ingest(events, out, str(tmp_path / "c"))
    assert rows(out.read()) == [(1, 3), (2, 1)]
    ingest(stream(spark, src, "k int, s int"), out, str(tmp_path / "c"))
    assert rows(out.read()) == [(1, 3), (2, 1)]
    spark.createDataFrame([(2, 9)], "k int, s int").write.mode("append").parquet(src)
    ingest(stream(spark, src, "k int, s int"), out, str(tmp_path / "c"))
    assert rows(out.read()) == [(1, 3), (2, 9)]
    out.apply(spark.createDataFrame([(2, 100)], "k int, s int"), 0)
    assert rows(out.read()) == [(1, 3), (2, 9)]


def test_filters_and_columns_reach_the_scan(spark):
    from casemill.queries.text import scan_long_text

    plan = scan_long_text(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(type,010combined)" in plan
    assert "citation_count" not in plan


def test_both_parties_in(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 11)))
    known = [f"{word()} v. {word()}" for _ in range(30)] + ["In re x"]
    cited = [f"{word()} {rng.choice(['v.', 'V', 'v'])} {word()}" for _ in range(200)] + ["no versus", known[0].upper()]
    import re

    def good(name):
        p = re.split(r"(?i)\s+v\.?\s+", name, maxsplit=1)
        return len(p) == 2 and any(p[0].strip().lower()[:8] in k.lower() and p[1].strip().lower()[:8] in k.lower() for k in known)

    got = {r[0] for r in C.both_parties_in(spark.createDataFrame([(x,) for x in cited], "name string"), spark.createDataFrame([(x,) for x in known], "k string")).collect()}
    assert got == {x for x in cited if good(x)}


def test_lifting_with_the_mock(spark):
    from casemill.operators.lifting import hashed_vector, lift, prompts, vector_of_blob

    df = spark.createDataFrame([(1, 10, "OPINION\n" + "Text. " * 9000), (2, 11, "Short."), (3, 12, None)], "opinion_id long, docket_id long, plain_text string")
    asked = {r["opinion_id"]: r for r in prompts(df).collect()}
    assert set(asked) == {1, 2} and len(asked[1]["prompt"]) < 16_000 and "TRUNCATED" in asked[1]["prompt"] and "TRUNCATED" not in asked[2]["prompt"]
    out = X.parsed(lift(prompts(df))).select("opinion_id", F.col("x.outcome").alias("o"), F.size(X.violations(F.col("x"))).alias("n"))
    assert rows(out) == [(1, "DEFENDANT_WINS", 0), (2, "DEFENDANT_WINS", 0)]
    a, b, c = (np.array(r["x"]) for r in spark.createDataFrame([("the fraud claim",), ("claim the fraud",), ("",)], "t string").select(hashed_vector("t").alias("x")).collect())
    assert np.allclose(a, b) and abs(np.linalg.norm(a) - 1) < 1e-6 and not c.any()
    blobs = spark.createDataFrame([(bytearray(np.array([1.5, 2], "<f4").tobytes()),), (bytearray(b"123"),), (None,)], "b binary")
    assert [r["x"] for r in blobs.select(vector_of_blob("b").alias("x")).collect()] == [[1.5, 2.0], None, None]


def test_formats(spark):
    from casemill.functions import format as Fm

    assert one(spark, Fm.interval(F.lit(0.5), F.lit(0.25), F.lit(0.75), 2)) == "0.50 [0.25, 0.75]"
    assert one(spark, Fm.brief(F.lit("A v. B"), F.lit(3), F.lit(None), F.lit("MIXED"), F.lit(0.5), F.lit(1.0))) == "- A v. B (docket=3, court=unknown, outcome=MIXED, anco=0.50, score=1.000)"
    items = F.array(F.struct(F.lit(1).alias("number"), F.lit("2020-01-01").alias("date"), F.lit("Filed").alias("text")), F.struct(F.lit(None).cast("int").alias("number"), F.lit("d").alias("date"), F.lit("x" * 600).alias("text")))
    assert one(spark, Fm.entries(items)) == "[1|2020-01-01] Filed ||| [|d] " + "x" * 500
    assert one(spark, T.bar(F.lit(50.0), 100, 4)) == "##.."


def test_represented_by(spark):
    from casemill.operators.graph import represented_by

    a = spark.createDataFrame([(1, "Cole & Kahn LLP\n1 Main St"), (2, "no firm here"), (1, "x\nCole  & Kahn LLP")], "docket_id long, contact_raw string")
    p = spark.createDataFrame([(1, 5, "Plaintiff"), (1, 4, "Defendant")], "docket_id long, party_id long, party_type string")
    assert rows(represented_by(a, p)) == [(1, "cole & kahn llp", "defendant")]


def test_flat_record_of_a_nested_docket(spark):
    from casemill.sources import dockets as Dk

    people = [("Ann", [("Plaintiff",)], [("Q", "1", "q@sec.gov", "Securities and Exchange Commission (NYRO)"), ("R", "1", None, None)]), ("Bo", [("Relief Defendant",)], None), ("Cy", [("Relief",)], []), ("Di", None, None)]
    entry = (1, "2020-01-01", "Filed", [(3, 10, None, None), (None, 5, True, None)])
    row = spark.createDataFrame([(json.dumps({"identifier": "x", "case_name": "A v. B", "idb_data": {"disposition": 5, "judgment": 9, "procedural_progress": 2, "section": "78j", "subsection": "b"}, "cause": "15:78m"}),), ("{}",)], "j string")
    whole = spark.createDataFrame([], Dk.DOCKET).schema
    df = row.select(F.from_json("j", whole).alias("x")).select("x.*")
    extra = spark.createDataFrame([(people, [entry])], "parties array<struct<name:string,party_types:array<struct<name:string>>,attorneys:array<struct<name:string,phone:string,email:string,contact_raw:string>>>>, docket_entries array<struct<entry_number:int,date_filed:string,description:string,recap_documents:array<struct<page_count:int,file_size:bigint,is_sealed:boolean,ocr_status:int>>>>")
    got = {r["case_title"]: r for r in Dk.records(df.drop("parties", "docket_entries").crossJoin(extra), "http://h").collect()}
    r = got["A v. B"]
    assert (r["petitioner"], r["respondent"], r["relief_defendants"]) == ("Ann", "Bo", "Cy")
    assert (r["sec_attorneys"], r["sec_regional_office"], r["attorney_phone"]) == ("Q", "NYRO", "1")
    assert r["charges_and_sections"] == "15:78m; Section 78j(b)" and r["outcome"] == "Dismissed - settled" and r["judgment_code"] == "9 - Code 9"
    assert r["final_judgment_details"] == "Disposition: Dismissed - settled; Judgment for: Code 9; Procedural progress: 2"
    assert (r["doc_page_count"], r["doc_file_size"], r["doc_is_sealed"], r["docket_entry_text"]) == ("3", "15", "True", "[1|2020-01-01] Filed")
    assert got[""]["case_status"] == "Open" and all(v is not None for k, v in got[""].asDict().items() if k != "identifier")
    hits = spark.createDataFrame([("q", 2, "b"), ("q", 1, "a"), ("p", 1, "c")], "query string, position int, name string")
    assert rows(Dk.best_hit(hits.where("query = 'q'"), hits).select("query", "name")) == [("p", "c"), ("q", "a")]
    assert rows(Dk.inventory(spark.range(2).toDF("docket_id"), {"e": spark.createDataFrame([(1, "x", " ")], "docket_id long, a string, b string")})) == [(0, "e", "empty", 0, []), (1, "e", "ok", 1, ["a"])]


def test_flat_records_name_every_party(spark, tmp_path):
    import hashlib

    from casemill.queries.dockets import flat_records

    sf = "/root/testdata/sf0.001"
    cases = spark.read.parquet(f"{sf}/cases.parquet")
    docket = cases.select("docket_id").where("docket_id is not null").first()[0]
    people = spark.read.parquet(f"{sf}/parties.parquet").limit(1)
    many = people.drop("docket_id", "party_id", "name", "party_type").crossJoin(spark.range(450).select(F.lit(docket).alias("docket_id"), F.col("id").alias("party_id"), F.format_string("P%d", "id").alias("name"), F.when(F.col("id") % 2 == 0, "Plaintiff").otherwise("Defendant").alias("party_type")))
    cases.write.parquet(f"{tmp_path}/cases.parquet")
    many.select(*people.columns).write.parquet(f"{tmp_path}/parties.parquet")
    r = flat_records(spark, str(tmp_path)).where(F.col("identifier") == str(docket)).first()
    names = lambda k: hashlib.sha256("; ".join(f"P{i}" for i in range(k, 450, 2)).encode()).hexdigest()
    assert (r["petitioner"], r["respondent"]) == (names(0), names(1))


def test_zipped_arrays_and_manifests(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["x"]), (2, [], []), (3, None, ["y"])], "k int, p array<string>, q array<string>")
    assert rows(landed.zipped(df, "k", ["p", "q"])) == [(1, 0, "a", "x"), (1, 1, "b", None)]
    assert landed.zipped(df, "k", ["p", "q"], 1).count() == 1
    files = spark.createDataFrame([("b.pdf",), ("a.PDF",), ("c",)], "name string")
    assert rows(landed.manifest(files, most=1)) == [("", 1, ["c"]), ("pdf", 2, ["a.PDF"])]
    arrays = spark.createDataFrame([(["8-K", "10-K", "X"], ["1", "2", "3"], ["d", "d", "d"], ["p", "q", "r"])], "form array<string>, accessionNumber array<string>, filingDate array<string>, primaryDocument array<string>")
    assert [r["accessionNumber"] for r in landed.filings(arrays, ["10-K", "8-K"], 1).collect()] == ["1"]


def test_leading_gives_the_best_of_all(spark):
    """A value that nearly all opinions share gives each query a few rows, and the ranks are those of all pairs."""
    r = random.Random(3)
    own = [(q, q * 1000 + i) for q in range(12) for i in range(r.randint(0, 4))]
    ids = [o for _, o in own] + list(range(50_000, 50_400))
    members = [(v, o) for o in ids for v in ("hot", "warm", "rare") if r.random() < {"hot": 0.9, "warm": 0.4, "rare": 0.02}[v]]
    asked = [(q, v) for q in range(12) for v in ("hot", "warm", "rare") if r.random() < 0.7]
    facts = [(o, r.choice((None, 0.5, -0.5, 0.25)), r.choice((None, True))) for o in ids if r.random() < 0.8]
    near = [(q, o, r.random() - 0.2) for q in range(12) for o in r.sample(ids, 8) if (q, o) not in own]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    own_, members_, asked_ = frame(own, "query long, opinion_id long"), frame(members, "value string, opinion_id long"), frame(asked, "query long, value string")
    facts_, near_ = frame(facts, "opinion_id long, score double, has_irac boolean"), frame(near, "query long, opinion_id long, semantic double")
    every = asked_.join(members_, "value").select("query", "opinion_id").distinct().join(own_, ["query", "opinion_id"], "left_anti").withColumn("distance", F.lit(3))
    few = R.leading(asked_, members_, own_, near_, facts_, "value", 3)
    assert few.count() < every.count() / 3
    assert {tuple(x) for x in R.fused(near_, few, facts_).collect()} == {tuple(x) for x in R.fused(near_, every, facts_).collect()}


def test_fused_rank_forms_no_pairs_of_all(spark, monkeypatch):
    """The ranking doesn't list every pair that graph_distance lists."""
    from casemill.queries import retrieval as Q

    monkeypatch.setattr(Q, "within_two", None)
    monkeypatch.setattr(Q, "same_statute", None)
    assert Q.fused_rank(spark, "/root/testdata/sf0.001", every=10).count() > 0


def test_cosine_topk_over_chunks(spark, monkeypatch):
    """Vectors in several chunks and batches, ties by key."""
    from casemill.operators import retrieval

    monkeypatch.setattr(retrieval, "CHUNK", 3)
    rows = [(i, [float(i % 4 + 1), float(i % 3), 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "key long, vector array<double>").repartition(2)
    got = {(x.query, x["rank"]): x.key for x in R.cosine_topk(df.where("key < 5"), df, 6).collect()}
    v = np.array([x for _, x in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(5):
        order = sorted((k for k in range(40) if k != q), key=lambda k: (-round(float(v[q] @ v[k]), 12), k))
        assert [round(float(v[q] @ v[got[q, i + 1]]), 12) for i in range(6)] == [round(float(v[q] @ v[k]), 12) for k in order[:6]]


def test_reinforce_over_several_plans_stops_at_its_round(spark):
    """A plan of several rounds gives the same rounds and scores as one round a plan, where it ends within a plan too."""
    rng = np.random.default_rng(5)
    m = rng.integers(-1, 2, (9, 7))
    edges = spark.createDataFrame([(int(i), f"a{j}", int(m[i, j]), int((-1) ** i)) for i in range(9) for j in range(7)], "case_id int, arg_id string, sign int, seed int")
    single = S.reinforce(edges, epsilon=1e-3, step=1)
    table = lambda r: ([tuple(x) for x in r[0].orderBy("arg_id").collect()], [tuple(x) for x in r[1].orderBy("case_id").collect()])
    want = table(single)
    assert 1 < single[2] < 200
    for step in (2, 5, single[2] + 3):
        got = S.reinforce(edges, epsilon=1e-3, step=step)
        assert got[2] == single[2]
        for a, b in zip(table(got), want, strict=True):
            assert [x[0] for x in a] == [x[0] for x in b] and np.allclose([x[1] for x in a], [x[1] for x in b])
    assert S.reinforce(edges.where("case_id < 0"))[2] == 1
    assert [x["score"] for x in S.reinforce(edges, rounds=0)[0].collect()] == [1.0] * 7


def test_ranking_metrics_run_their_input_once(spark):
    """The ranked rows are read once, and a query of which nothing is in the first k doesn't count."""
    from casemill.operators.statistics import ranking_metrics

    hits = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, None), (3, 4, True)], "q int, r int, rel boolean")
    out = ranking_metrics(hits, "q", "r", "rel", 3)
    d = 1 + 1 / np.log2(3)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    got = out.first()
    assert (got["p_at_k"], got["mrr"], got["n"]) == (round(2 / 3, 6), 0.25, 2)
    assert got["ndcg"] == round((1 / np.log2(3) + 0.5) / d / 2, 6)


def test_valid_runs_are_parsed_where_they_lie(spark):
    """A broken row of an id doesn't hide its whole one, and no text of an extraction is shuffled."""
    good = '{"outcome": "MIXED", "arguments_plaintiff": ["a"], "statutes_cited": ["s"], "elements": {"scienter": {"status": "SATISFIED"}}}'
    table = spark.createDataFrame([(1, 5, 7, good[:40], 1), (1, 5, 7, good, 1), (1, 5, 7, good, 1), (2, 5, 7, good, 0), (3, 6, 8, "[", 1)], "id long, docket_id long, opinion_id long, extraction string, is_valid int")
    for schema in (X.SCHEMA, X.LINKS):
        runs = X.valid(table, schema)
        assert [(r["id"], r["x"]["outcome"], r["x"]["arguments_plaintiff"], r["x"]["statutes_cited"]) for r in runs.collect()] == [(1, "MIXED", ["a"], ["s"])]
        plan = runs._jdf.queryExecution().executedPlan().toString()
        assert "from_json" in plan[plan.index("Exchange hashpartitioning") :]  # below the exchange


def test_leading_keeps_few_of_many_values(spark):
    """A query with hundreds of values keeps room for the k best and its own, not that for each value; the ranks are those of all."""
    r = random.Random(7)
    members = sorted({(v, r.randrange(400)) for v in range(200) for _ in range(12)})
    own = [(1, o) for o in (3, 5)]
    facts = [(o, r.choice((None, 0.5, -0.25, 0.75)), r.choice((None, True))) for o in range(400)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    members_, own_, facts_ = frame(members, "value long, opinion_id long"), frame(own, "query long, opinion_id long"), frame(facts, "opinion_id long, score double, has_irac boolean")
    asked, near = frame([(1, v) for v in range(200)], "query long, value long"), frame([(1, 17, 0.9), (1, 399, 0.1)], "query long, opinion_id long, semantic double")
    few = R.leading(asked, members_, own_, near, facts_, "value", 2)
    assert few.count() <= 10 + len(own) + 2
    every = asked.join(members_, "value").select("query", "opinion_id").distinct().join(own_, ["query", "opinion_id"], "left_anti").withColumn("distance", F.lit(2))
    assert sorted(map(tuple, R.fused(near, few, facts_).collect()), key=str) == sorted(map(tuple, R.fused(near, every, facts_).collect()), key=str)


def test_cosine_topk_over_blocks_of_queries(spark, monkeypatch):
    """All vectors as queries in several blocks: equal vectors tie exactly wherever they lie, and what single precision can't tell apart is in order."""
    from casemill.operators import retrieval

    monkeypatch.setattr(retrieval, "CHUNK", 7)
    monkeypatch.setattr(retrieval, "PAIRS", 11)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 33))
    v = np.concatenate([base, base, base + 1e-9 * rng.normal(size=base.shape), base])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "key long, vector array<double>").repartition(3)
    got = {(x.query, x["rank"]): (x.key, x.cosine) for x in R.cosine_topk(df, df, 5, block=10).collect()}
    assert len(got) == len(v) * 5
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(len(v)):
        cos = np.einsum("ij,ij->i", np.repeat(u[q : q + 1], len(u), axis=0), u)
        assert [got[q, i + 1][0] for i in range(5)] == sorted((k for k in range(len(v)) if k != q), key=lambda k: (-cos[k], k))[:5]
