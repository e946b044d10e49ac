"""Queries of retrieval, ranking, packing and constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.functions import text as T
from casemill.functions.format import brief
from casemill.operators import constraints as C
from casemill.operators import extractions as X
from casemill.operators import retrieval as R
from casemill.operators import scoring as S
from casemill.operators.graph import CaseGraph, neighbours, within_two
from casemill.operators.statistics import ranking_metrics
from casemill.plans.durable import broadcast_if_small, durable, together
from casemill.queries.graph import _DONE, BASE, DIGITS, EVERY, _edges
from casemill.tables import table

MODEL, WIDTH = "lexvec-base-768", 768


def _vectors(spark, d):
    """The newest usable vector of each opinion, the greatest of one stamp. Only those of an opinion with several move."""
    good = ~F.array_contains("embedding", F.lit(float("nan")).cast("float")) & ((F.array_max("embedding") > 0) | (F.array_min("embedding") < 0))  # null where a number is null
    named = table(spark, d, "opinion_embeddings").where((F.col("model_name") == MODEL) & F.col("opinion_id").isNotNull()).withColumnRenamed("opinion_id", "key")
    several = broadcast_if_small(durable(named.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "several"))
    rows = named.where((F.size("embedding") == WIDTH) & good)
    newest = rows.join(several, "key", "left_semi").groupBy("key").agg(F.max_by("embedding", F.struct("created_at", F.col("embedding"))).alias("vector"))
    return rows.join(several, "key", "left_anti").select("key", F.col("embedding").alias("vector")).unionByName(newest)


def cosine_top5(spark, d):
    """The five nearest opinions of every 50th opinion, exactly."""
    v = _vectors(spark, d)
    return R.cosine_topk(v.where(F.col("key") % EVERY == 0), v, 5).select("query", "key", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


def label_retrieval(spark, d):
    """How often the ten nearest of every 50th vector share its label."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), "label")
    hits = R.cosine_topk(rows.where(F.col("key") % EVERY == 0), rows, 10)
    labels = rows.select("key", "label")
    joined = hits.join(labels, "key").join(labels.toDF("query", "mine"), "query").withColumn("relevant", F.col("label") == F.col("mine"))
    return ranking_metrics(joined, "query", "rank", "relevant", 10)


def _queries(g, every=EVERY):
    return g.cases().where(F.col("docket_id") % every == 0).select(F.col("docket_id").alias("query"))


def same_statute(spark, d, every=EVERY, g=None):
    g = g or CaseGraph(spark, d)
    return R.same_attribute(_queries(g, every), g.charged_under(), "statute", g.cases())


def same_judge(spark, d, every=EVERY, g=None):
    g = g or CaseGraph(spark, d)
    return R.same_attribute(_queries(g, every), g.decided_by(), "judge", g.cases())


def same_court(spark, d, every=EVERY, g=None):
    """The first 50 other cases of each query case's court, by docket."""
    g = g or CaseGraph(spark, d)
    courts = g.cases().where("court_id <> ''").select("docket_id", "court_id")
    return R.same_attribute(_queries(g, every), courts, "court_id", g.cases(), R.COURT_LIMIT)


def graph_distance(spark, d, every=EVERY, g=None):
    """The graph's nearest reason for each query case and opinion."""
    g = g or CaseGraph(spark, d, keep=True)
    q, own = _queries(g, every), g.has_opinion()
    starts = own.join(q.withColumnRenamed("query", "docket_id"), "docket_id").select(F.col("docket_id").alias("query"), F.col("opinion_id").alias("start"))
    internal = g.opinions().where("internal").select("opinion_id")
    links = within_two(starts.select("start"), g.cites()).join(starts, "start").groupBy("query", "opinion_id").agg(F.min("distance").alias("distance")).withColumn("reason_rank", F.lit(0))
    parts = [links]
    for rank, (distance, frame) in enumerate(((3, same_statute(spark, d, every, g)), (3, same_judge(spark, d, every, g)), (4, same_court(spark, d, every, g))), 1):
        parts.append(frame.join(own, "docket_id").select("query", "opinion_id", F.lit(distance).alias("distance"), F.lit(rank).alias("reason_rank")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    mine = own.select(F.col("docket_id").alias("query"), "opinion_id")
    near = R.closest(every.join(internal, "opinion_id", "left_semi")).join(mine, ["query", "opinion_id"], "left_anti")
    return near.select("query", "opinion_id", F.col("distance").cast("long").alias("distance"), F.col("reason_rank").cast("long").alias("reason_rank"))


def _semantic(g, every, v):
    """The 20 nearest opinions of the first opinion, by id, of each query case, without its own."""
    first = durable(g.has_opinion().join(_queries(g, every).withColumnRenamed("query", "docket_id"), "docket_id").groupBy("docket_id").agg(F.min("opinion_id").alias("key")), "first")
    hits = R.cosine_topk(v.join(broadcast_if_small(first.select("key").distinct()), "key").select("key", "vector"), v, 20)
    mine = g.has_opinion().select(F.col("docket_id"), F.col("opinion_id").alias("key"))
    found = hits.join(first.select("docket_id", F.col("key").alias("query")), "query").join(mine, ["docket_id", "key"], "left_anti")
    return found.select(F.col("docket_id").alias("query"), F.col("key").alias("opinion_id"), F.col("cosine").alias("semantic"))


def _near(spark, d, g, every):
    """What _reasons needs besides scores: own opinions and the most of a query, (query, mid), (mid, opinion), holders by value."""
    q, has = durable(_queries(g, every), "queries"), g.has_opinion()
    own = durable(has.withColumnRenamed("docket_id", "query").join(q, "query"), "own")
    internal = table(spark, d, "opinions").select("opinion_id").distinct()
    most = own.groupBy("query").count().agg(F.max("count")).first()[0] or 0
    links = durable(neighbours(g.cites()).select("src", "dst").distinct(), "links")
    inner = durable(links.select(F.col("src").alias("mid"), F.col("dst").alias("opinion_id")).join(internal, "opinion_id", "left_semi"), "inner")
    starts = durable(own.join(links.withColumnRenamed("src", "opinion_id"), "opinion_id").select("query", F.col("dst").alias("mid")).distinct(), "starts")
    one = starts.withColumnRenamed("mid", "opinion_id").join(internal, "opinion_id", "left_semi").withColumn("distance", F.lit(1))
    values = []
    for value, held in (("statute", g.charged_under()), ("judge", g.decided_by())):
        held = durable(held, value)
        values.append((value, held.withColumnRenamed("docket_id", "query").join(q, "query").select("query", value), held.join(has, "docket_id").select(value, "opinion_id").distinct()))
    return own, most, starts, inner, one, values


def _reasons(spark, d, g, every, semantic, facts, near):
    """(query, opinion_id, distance): graph_distance for all opinions that can be among the ten best of a query case."""
    own, most, starts, inner, one, values = near
    # written one by one: as one plan they fill the driver's memory, which plans it anew after every stage
    out = one
    for distance, (value, asked, members) in ((2, ("mid", starts, inner)), *((3, v) for v in values)):
        out = out.unionByName(durable(R.leading(asked, members, own, semantic, facts, value, distance, most=most), "leading"))
    court = same_court(spark, d, every, g).join(g.has_opinion(), "docket_id").select("query", "opinion_id", F.lit(4).alias("distance"))
    return out.unionByName(court).groupBy("query", "opinion_id").agg(F.min("distance").cast("long").alias("distance")).join(own, ["query", "opinion_id"], "left_anti")


def fused_rank(spark, d, every=EVERY, g=None):
    """The ten best precedents of every 50th case: vectors, graph, scores and extractions together."""
    g = g or CaseGraph(spark, d, keep=True)
    # first what several parts share, and what needs none of them: with has_opinion come the cases and runs below it
    _, v, _ = together(spark, g.has_opinion, lambda: durable(_vectors(spark, d), "vectors"), g.cites)

    def scored():
        _, cases, _ = S.reinforce(_edges(spark, d, g))
        irac = g.valid_runs().select("opinion_id").distinct().withColumn("has_irac", F.lit(True))
        owner = g.has_opinion().groupBy("opinion_id").agg(F.min("docket_id").alias("case_id"))
        return durable(owner.join(cases, "case_id", "left").join(irac, "opinion_id", "full_outer").select("opinion_id", F.round("score", DIGITS).alias("score"), "has_irac"), "facts")

    facts, semantic, near = together(spark, scored, lambda: durable(_semantic(g, every, v), "semantic"), lambda: _near(spark, d, g, every))
    out = R.fused(semantic, _reasons(spark, d, g, every, semantic, facts, near), facts)
    return out.withColumn("rank", F.col("rank").cast("long"))


def pack_context(spark, d):
    """Which of the ranked precedents fit a context of 1,200 tokens, in full or as a line."""
    g = CaseGraph(spark, d, keep=True)
    names = g.cases().select("docket_id", F.coalesce("case_name", F.lit("")).alias("case_name"))
    owner = g.has_opinion().groupBy("opinion_id").agg(F.min("docket_id").alias("docket_id"))
    text = table(spark, d, "opinions").groupBy("opinion_id").agg(F.max(F.length("plain_text")).alias("n_chars"))
    rows = fused_rank(spark, d, g=g).join(owner, "opinion_id").join(names, "docket_id").join(text, "opinion_id")
    full = F.floor((F.least(F.coalesce("n_chars", F.lit(0)), F.lit(900)) + F.length("case_name")) / 2.6)
    brief = F.floor((F.length("case_name") + 60) / 2.6)
    sized = rows.select("query", "opinion_id", "rank", full.alias("full_tokens"), brief.alias("brief_tokens"), F.lit(100).alias("used"))
    return R.pack(sized, 1200, brief_header=15)


def format_brief(spark, d):
    """The ranked precedents as lines of a prompt."""
    g = CaseGraph(spark, d, keep=True)
    ranked = fused_rank(spark, d, g=g)
    cases = g.cases().select("docket_id", "case_name", "court_id", "outcome_label")
    owner = g.has_opinion().groupBy("opinion_id").agg(F.min("docket_id").alias("docket_id"))
    rows = ranked.join(owner, "opinion_id").join(cases, "docket_id")
    return rows.select("query", "rank", brief("case_name", "docket_id", "court_id", "outcome_label", F.lit(0.0), "final_score").alias("line"))


# constraints over the latest valid extraction of each opinion
def _runs(spark, d):
    return X.latest_valid(table(spark, d, "irac_extractions")).select("docket_id", "opinion_id", "id", "x")


def c1_citation(spark, d, runs=None):
    cited = (_runs(spark, d) if runs is None else runs).select("docket_id", F.explode("x.precedents_cited").alias("name")).distinct()
    return C.unknown_names(cited, table(spark, d, "cases").select("case_name").where("case_name <> ''").distinct(), T.case_name_key)


def c2_statute(spark, d, runs=None):
    cited = (_runs(spark, d) if runs is None else runs).select("docket_id", F.explode("x.statutes_cited").alias("statute")).distinct()
    return C.ungrounded(cited, table(spark, d, "cases").select("cause").where("cause <> ''").distinct(), T.statute_key)


def _pairs(g):
    facts = g.cases().select("docket_id", F.coalesce("court_id", F.lit("")).alias("court_id"), F.coalesce("date_filed", F.lit("")).alias("date"))
    own = g.has_opinion()
    links = g.cites().join(own.select(F.col("opinion_id").alias("src"), "docket_id"), "src").join(own.select(F.col("opinion_id").alias("dst"), F.col("docket_id").alias("cited_docket")), "dst")
    links = links.select("docket_id", "cited_docket").where("docket_id <> cited_docket").distinct()
    return links.join(facts, "docket_id").join(facts.toDF("cited_docket", "cited_court", "cited_date"), "cited_docket")


def c3_circuit(spark, d):
    return C.not_binding(_pairs(CaseGraph(spark, d)))


def c4_temporal(spark, d):
    return C.too_late(_pairs(CaseGraph(spark, d)))


def c5_contested(spark, d, g=None):
    g = g or CaseGraph(spark, d, keep=True)
    args, _, _ = S.reinforce(_edges(spark, d, g))
    uses = g.involves().select("docket_id", F.col("text_hash").alias("arg_id"))
    return C.contested(uses.join(args, "arg_id").select("docket_id", F.col("arg_id").alias("subject"), F.round("score", DIGITS).alias("score")))


def c6_missing(spark, d, runs=None):
    return C.missing_elements(X.element_rows(_runs(spark, d) if runs is None else runs))


def validate_all(spark, d):
    """All checks; the extractions are parsed once, and cases and links are written once."""
    g, runs = CaseGraph(spark, d, keep=True), durable(_runs(spark, d), "latest")
    pairs = durable(_pairs(g), "pairs")
    return C.all_of(c1_citation(spark, d, runs), c2_statute(spark, d, runs), C.not_binding(pairs), C.too_late(pairs), c5_contested(spark, d, g), c6_missing(spark, d, runs))


def violation_rates(spark, d):
    return C.rates(validate_all(spark, d), table(spark, d, "cases").agg(F.countDistinct("docket_id")).first()[0])


QUERIES = {f.__name__: f for f in (cosine_top5, label_retrieval, same_statute, same_judge, same_court, graph_distance, fused_rank, pack_context, format_brief, c1_citation, c2_statute, c3_circuit, c4_temporal, c5_contested, c6_missing, validate_all, violation_rates)}

_VEC = """vec AS (SELECT opinion_id AS key, max_by(embedding, struct_pack(a := created_at, b := embedding)) AS v FROM (SELECT opinion_id, created_at, CAST(embedding AS DOUBLE[]) AS embedding FROM opinion_embeddings
  WHERE model_name = 'lexvec-base-768' AND len(embedding) = 768) WHERE len(list_filter(embedding, lambda x: isnan(x) OR x IS NULL)) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1)"""
_GD = r""", q AS (SELECT docket_id AS query FROM kase WHERE docket_id % 50 = 0),
st AS (SELECT DISTINCT query, y.docket_id FROM q JOIN charged x ON x.docket_id = query JOIN charged y USING (statute) WHERE y.docket_id <> query AND y.docket_id IN (SELECT docket_id FROM kase)),
ju AS (SELECT DISTINCT query, y.docket_id FROM q JOIN decided x ON x.docket_id = query JOIN decided y USING (judge) WHERE y.docket_id <> query AND y.docket_id IN (SELECT docket_id FROM kase)),
co AS (SELECT query, docket_id FROM (SELECT query, y.docket_id, row_number() OVER (PARTITION BY query ORDER BY y.docket_id) AS rn FROM q JOIN kase x ON x.docket_id = query JOIN kase y USING (court_id) WHERE court_id <> '' AND y.docket_id <> query) WHERE rn <= 50),
n AS (SELECT src, dst, src AS s, dst AS t FROM cites WHERE src <> dst UNION ALL SELECT dst, src, src, dst FROM cites WHERE src <> dst),
qo AS (SELECT query, opinion_id AS start FROM q JOIN hasop ON docket_id = query),
hop AS (SELECT query, dst AS opinion_id, 1 AS distance FROM qo JOIN n ON src = start UNION ALL SELECT query, y.dst, 2 FROM qo JOIN n x ON x.src = start JOIN n y ON x.dst = y.src WHERE (x.s, x.t) <> (y.s, y.t) AND y.dst <> start),
allc AS (SELECT query, opinion_id, distance, 0 AS reason_rank FROM hop UNION ALL SELECT query, opinion_id, 3, 1 FROM st JOIN hasop USING (docket_id) UNION ALL SELECT query, opinion_id, 3, 2 FROM ju JOIN hasop USING (docket_id) UNION ALL SELECT query, opinion_id, 4, 3 FROM co JOIN hasop USING (docket_id)),
gd0 AS (SELECT *, row_number() OVER (PARTITION BY query, opinion_id ORDER BY distance, reason_rank) AS rn FROM allc WHERE opinion_id IN (SELECT opinion_id FROM ops) AND (query, opinion_id) NOT IN (SELECT docket_id, opinion_id FROM hasop WHERE docket_id IS NOT NULL)),
gd AS (SELECT query, opinion_id, distance, reason_rank FROM gd0 WHERE rn = 1)"""
_FUSED = _DONE + _GD + ", " + _VEC + r""",
first_ AS (SELECT query, min(start) AS key FROM qo GROUP BY 1),
sem0 AS (SELECT query, v.key AS opinion_id, list_cosine_similarity(a.v, v.v) AS semantic, row_number() OVER (PARTITION BY query ORDER BY list_cosine_similarity(a.v, v.v) DESC, v.key) AS rn FROM first_ JOIN vec a USING (key) JOIN vec v ON v.key <> a.key),
sem AS (SELECT query, opinion_id, semantic FROM sem0 WHERE rn <= 20 AND (query, opinion_id) NOT IN (SELECT docket_id, opinion_id FROM hasop WHERE docket_id IS NOT NULL)),
owner AS (SELECT opinion_id, min(docket_id) AS case_id FROM hasop GROUP BY 1),
fr0 AS (SELECT coalesce(s.query, g.query) AS query, coalesce(s.opinion_id, g.opinion_id) AS opinion_id, semantic, distance FROM sem s FULL JOIN gd g ON s.query = g.query AND s.opinion_id = g.opinion_id),
fr1 AS (SELECT f.query, f.opinion_id, semantic, distance, round(0.4 * greatest(coalesce(semantic, 0), 0) + 0.3 * CASE distance WHEN 1 THEN 1 WHEN 2 THEN 0.5 WHEN 3 THEN 0.3 WHEN 4 THEN 0.1 ELSE 0 END
  + 0.2 * abs(coalesce(sc.score, 0)) + 0.1 * CASE WHEN f.opinion_id IN (SELECT opinion_id FROM runs WHERE opinion_id IS NOT NULL) THEN 1 ELSE 0 END, 6) AS final_score
  FROM fr0 f LEFT JOIN owner o ON o.opinion_id = f.opinion_id LEFT JOIN scores sc ON sc.entity_type = 'case' AND sc.entity_id = CAST(o.case_id AS VARCHAR)),
fr AS (SELECT query, opinion_id, round(semantic, 6) AS semantic, distance, final_score, row_number() OVER (PARTITION BY query ORDER BY final_score DESC, opinion_id) AS rank FROM fr1 QUALIFY rank <= 10)"""
_CIRCUIT = "CASE {0} " + " ".join(f"WHEN '{court}' THEN '{c}'" for court, c in C.CIRCUITS.items()) + " END"
_LATEST = BASE + r""", lv AS (SELECT *, row_number() OVER (PARTITION BY opinion_id ORDER BY try_cast(rtrim(replace(trim(created_at), 'T', ' '), 'Z') AS TIMESTAMP) DESC NULLS LAST, id DESC) AS rn FROM runs), lx AS (SELECT * FROM lv WHERE rn = 1)"""
_KEY = r"trim(regexp_replace(lower({0}), '[^a-z0-9\s]', '', 'g'))"
_SKEY = r"lower(trim(regexp_replace({0}, '[§\s]+', ' ', 'g')))"
_CP = r""", pr AS (SELECT DISTINCT a.docket_id, b.docket_id AS cited_docket FROM cites JOIN hasop a ON a.opinion_id = src JOIN hasop b ON b.opinion_id = dst WHERE a.docket_id <> b.docket_id),
pf AS (SELECT p.*, coalesce(x.court_id, '') AS court_id, coalesce(x.date_filed, '') AS date, coalesce(y.court_id, '') AS cited_court, coalesce(y.date_filed, '') AS cited_date FROM pr p JOIN kase x ON x.docket_id = p.docket_id JOIN kase y ON y.docket_id = cited_docket)"""
_CHECKS = {
    "c1_citation": rf"""SELECT docket_id, 'citation_check' AS name, 'ERROR' AS severity, n AS subject FROM (SELECT DISTINCT docket_id, unnest(CAST(j->'$.precedents_cited' AS VARCHAR[])) AS n FROM lx)
      WHERE n IS NOT NULL AND ({_KEY.format('n')} = '' OR NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT {_KEY.format('case_name')} AS k FROM cases WHERE case_name <> '') WHERE contains(k, {_KEY.format('n')}) OR contains({_KEY.format('n')}, k))
        AND NOT (regexp_matches(n, '(?i)\\s+v\\.?\\s+') AND EXISTS (SELECT 1 FROM (SELECT DISTINCT lower(case_name) AS k FROM cases WHERE case_name <> '')
          WHERE contains(k, left(lower(trim(regexp_extract(n, '(?is)^(.*?)\\s+v\\.?\\s+', 1))), 8)) AND contains(k, left(lower(trim(regexp_replace(n, '(?is)^.*?\\s+v\\.?\\s+', ''))), 8)))))""",
    "c2_statute": rf"""SELECT docket_id, 'statute_grounding' AS name, 'WARNING' AS severity, s AS subject FROM (SELECT DISTINCT docket_id, unnest(CAST(j->'$.statutes_cited' AS VARCHAR[])) AS s FROM lx)
      WHERE {_SKEY.format('s')} <> '' AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT {_SKEY.format('cause')} AS k FROM cases WHERE cause <> '') WHERE contains(k, {_SKEY.format('s')}) OR contains({_SKEY.format('s')}, k))""",
    "c3_circuit": f"SELECT docket_id, 'binding_authority' AS name, 'WARNING' AS severity, CAST(cited_docket AS VARCHAR) AS subject FROM pf WHERE {_CIRCUIT.format('court_id')} <> {_CIRCUIT.format('cited_court')} AND {_CIRCUIT.format('cited_court')} <> 'scotus'",
    "c4_temporal": "SELECT docket_id, 'temporal_validity' AS name, 'ERROR' AS severity, CAST(cited_docket AS VARCHAR) AS subject FROM pf WHERE date <> '' AND cited_date <> '' AND cited_date > date",
    "c5_contested": "SELECT docket_id, 'ambiguity_flag' AS name, 'INFO' AS severity, text_hash AS subject FROM involves JOIN scores ON entity_id = text_hash AND entity_type = 'argument' WHERE abs(score) <= 0.1",
    "c6_missing": "SELECT docket_id, 'missing_element' AS name, 'WARNING' AS severity, k AS subject FROM (SELECT docket_id, j, unnest(json_keys(j, '$.elements')) AS k FROM lx) WHERE json_extract_string(j, '$.elements.' || k || '.status') = 'NOT_ANALYZED'",
}
_WITH = _LATEST + _CP + _DONE[len(BASE) :]
_ALL = _WITH + ", v AS (" + " UNION ALL ".join(_CHECKS.values()) + ")"
_PACK = _FUSED + r""", tx AS (SELECT opinion_id, max(length(plain_text)) AS n FROM opinions GROUP BY 1),
sz AS (SELECT f.query, f.opinion_id, f.rank, CAST(floor((least(coalesce(n, 0), 900) + length(coalesce(case_name, ''))) / 2.6) AS BIGINT) AS ft, CAST(floor((length(coalesce(case_name, '')) + 60) / 2.6) AS BIGINT) AS bt
  FROM fr f JOIN owner o ON o.opinion_id = f.opinion_id JOIN kase k ON k.docket_id = o.case_id JOIN tx ON tx.opinion_id = f.opinion_id),
p1 AS (SELECT *, 100 + sum(ft) OVER (PARTITION BY query ORDER BY rank) <= 1200 AS is_full FROM sz),
p2 AS (SELECT *, 100 + 15 + coalesce(sum(CASE WHEN is_full THEN ft END) OVER (PARTITION BY query), 0) + sum(CASE WHEN is_full THEN 0 ELSE bt END) OVER (PARTITION BY query ORDER BY rank) AS rest FROM p1)
SELECT query, opinion_id, rank, CASE WHEN is_full THEN 'full' ELSE 'brief' END AS form FROM p2 WHERE is_full OR rest <= 1200"""
ORACLES = {
    "cosine_top5": f"WITH {_VEC}, h AS (SELECT a.key AS query, b.key, list_cosine_similarity(a.v, b.v) AS c FROM vec a JOIN vec b ON a.key <> b.key WHERE a.key % 50 = 0) SELECT query, key, round(c, 6) AS cosine, row_number() OVER (PARTITION BY query ORDER BY c DESC, key) AS rank FROM h QUALIFY rank <= 5",
    "label_retrieval": """WITH e AS (SELECT vec_id AS key, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), h AS (SELECT a.key AS query, a.label = b.label AS rel, row_number() OVER (PARTITION BY a.key ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.key) AS rank FROM e a JOIN e b ON a.key <> b.key WHERE a.key % 50 = 0 QUALIFY rank <= 10),
      q AS (SELECT query, avg(CAST(rel AS INT)) AS p, sum(CASE WHEN rel THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, sum(CAST(rel AS INT)) AS n, min(CASE WHEN rel THEN rank END) AS f FROM h GROUP BY 1)
      SELECT round(avg(p), 6) AS p_at_k, round(avg(CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, CAST(n AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END), 6) AS ndcg, round(avg(coalesce(1.0 / f, 0)), 6) AS mrr, count(*) AS n FROM q""",
    "same_statute": BASE + _GD + " SELECT query, docket_id FROM st",
    "same_judge": BASE + _GD + " SELECT query, docket_id FROM ju",
    "same_court": BASE + _GD + " SELECT query, docket_id FROM co",
    "graph_distance": BASE + _GD + " SELECT * FROM gd",
    "fused_rank": _FUSED + " SELECT * FROM fr",
    "pack_context": _PACK,
    "format_brief": _FUSED
    + " SELECT query, rank, '- ' || coalesce(case_name, 'unknown') || ' (docket=' || docket_id || ', court=' || coalesce(court_id, 'unknown') || ', outcome=' || coalesce(outcome_label, 'unknown') || ', anco=0.00, score=' || printf('%.3f', final_score) || ')' AS line FROM fr JOIN owner USING (opinion_id) JOIN kase ON docket_id = case_id",
    **{k: _WITH + " " + v for k, v in _CHECKS.items()},
    "validate_all": _ALL + " SELECT * FROM v",
    "violation_rates": _ALL + " SELECT name, severity, count(*) AS n, count(DISTINCT docket_id) AS n_dockets, round(count(DISTINCT docket_id) / (SELECT count(DISTINCT docket_id) FROM cases), 6) AS share FROM v GROUP BY 1, 2",
}
