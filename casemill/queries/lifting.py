"""Queries around extractions: the work queue, completed records, lowered elements, annotators, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.functions.format import full, query_case
from casemill.operators import agreement as A
from casemill.operators import extractions as X
from casemill.operators import lowering as L
from casemill.operators.graph import CaseGraph
from casemill.operators.constraints import circuit
from casemill.operators.records import one_per_key
from casemill.operators.statistics import ranking_metrics
from casemill.plans.durable import durable
from casemill.queries.evaluation import _DONE
from casemill.queries.graph import BASE, anco_converged
from casemill.queries.retrieval import _CIRCUIT, _CP, _FUSED, _LATEST, _pairs, fused_rank
from casemill.sources.sinks import key_violations as violations
from casemill.tables import table, utc_stamp


def eligible(opinions, cases, labels, done, limit: int | None = None):
    """(opinion_id, docket_id, case_name, court_id, stage, n_chars): opinions to be lifted, the shortest first.

    Private, labelled, with more than 1,000 characters, and not among ``done``. Each opinion once per distinct result.
    """
    rows = opinions.where("plain_text is not null").where(F.length("plain_text") > 1000).select("opinion_id", "docket_id", F.length("plain_text").cast("long").alias("n_chars")).distinct()
    wanted = labels.where("contamination_type = 'PRIVATE' and outcome_label <> 'UNLABELED'").select("opinion_id", F.col("procedural_stage").alias("stage")).distinct()
    out = rows.join(done.select("opinion_id").distinct(), "opinion_id", "left_anti").join(wanted, "opinion_id").join(cases.select("docket_id", "case_name", "court_id").distinct(), "docket_id")
    out = out.orderBy("n_chars", "opinion_id").select("opinion_id", "docket_id", "case_name", "court_id", "stage", "n_chars")
    return out.limit(limit) if limit else out


def eligible_queue(spark, d):
    g = CaseGraph(spark, d)
    return eligible(table(spark, d, "opinions"), g.cases(), table(spark, d, "case_labels"), table(spark, d, "irac_extractions").where("is_valid = 1 and opinion_id is not null"))


def _annotations(spark, d):
    """The valid runs as annotations: the model annotates the docket."""
    runs = X.valid(table(spark, d, "irac_extractions"))
    statuses = F.transform_values("x.elements", lambda _, e: F.coalesce(e["status"], F.lit("NOT_ANALYZED")))
    return runs.select("id", "docket_id", F.col("llm_model").alias("annotator"), statuses.alias("statuses"), F.col("x.outcome").alias("outcome"), utc_stamp("created_at").alias("at"))


def annotator_pairs(spark, d):
    """Agreement of every two models on the dockets that both have, by the latest run of each."""
    return A.pairs(durable(A.latest_annotations(_annotations(spark, d), F.desc_nulls_last("at"), F.desc("id")), "annotations"))


def element_accuracy(spark, d):
    """The latest run of each docket against its first one, as if that were the truth."""
    runs = durable(_annotations(spark, d).where("docket_id is not null"), "annotations")
    return A.element_accuracy(one_per_key(runs, ["docket_id"], F.asc_nulls_last("at"), F.asc("id")), one_per_key(runs, ["docket_id"], F.desc_nulls_last("at"), F.desc("id")))


def completed_records(spark, d):
    """Every extraction as a record: parsed or a placeholder, with the row's ids and the stage that its opinion's label has."""
    rows = X.parsed(table(spark, d, "irac_extractions").dropDuplicates(["id"]))
    stages = table(spark, d, "case_labels").where("opinion_id is not null").groupBy("opinion_id").agg(F.min("procedural_stage").alias("stage"))
    out = L.completed(rows.join(stages, "opinion_id", "left"), F.col("stage"))
    confident = F.exists(F.map_values("x.elements"), lambda e: e["confidence"].isNotNull())
    return out.select("id", "failed", "x.case_id", "x.opinion_id", "x.procedural_stage", "x.outcome", F.size("x.elements").cast("long").alias("n_elements"), confident.alias("confident"))


def lowered_elements(spark, d):
    """The elements of the latest valid run of each opinion with their flags; a contested score of the case contests them all."""
    g = CaseGraph(spark, d, keep=True)
    rows = X.element_rows(X.latest_valid(table(spark, d, "irac_extractions")))
    scores = anco_converged(spark, d, g).where("entity_type = 'case'").select(F.col("entity_id").cast("bigint").alias("docket_id"), "score")
    return L.assessed(rows.join(scores, "docket_id", "left"), F.col("score")).select("id", "element", "status", "not_analyzed", "contested")


def citation_flags(spark, d):
    """Cited dockets of each docket: whether they are known, and of another circuit."""
    g = CaseGraph(spark, d, keep=True)
    return L.citation_flags(_pairs(g), g.cases()).select("docket_id", "cited_docket", "verified", "cross_circuit")


def key_violations(spark, d):
    """Rows of the tables without a key, and keys used more than once."""
    keys = {"cases": ["docket_id"], "opinions": ["opinion_id"], "parties": ["party_id"], "irac_extractions": ["id"], "landmarks": ["opinion_id"], "case_labels": ["opinion_id"]}
    return violations({name: (table(spark, d, name), k) for name, k in keys.items()})


def run_gaps(spark, d):
    """Seconds between consecutive runs of each model: least, mean, most."""
    from pyspark.sql import Window

    rows = table(spark, d, "irac_extractions").dropDuplicates(["id"]).select("llm_model", "id", utc_stamp("created_at").cast("long").alias("at")).where("at is not null")
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("llm_model").orderBy("at", "id"))
    return rows.withColumn("gap", gap).groupBy("llm_model").agg(F.count("gap").alias("n"), F.min("gap").alias("least"), F.round(F.avg("gap"), 6).alias("mean"), F.max("gap").alias("most"))


def case_retrieval(spark, d):
    """Ranking metrics of the ranked precedents of all cases: relevant if the outcome or the circuit is that of the query case."""
    g = CaseGraph(spark, d, keep=True)
    ranked = durable(fused_rank(spark, d, every=1, g=g).select("query", "opinion_id", "rank"), "ranked")
    facts = durable(g.cases().select("docket_id", F.nullif("outcome_label", F.lit("")).alias("outcome"), circuit(F.col("court_id")).alias("circuit")), "facts")
    owner = g.has_opinion().groupBy("opinion_id").agg(F.min("docket_id").alias("docket_id"))
    rows = ranked.join(owner, "opinion_id").join(facts, "docket_id").join(facts.toDF("query", "outcome_q", "circuit_q"), "query")
    same = F.coalesce(F.col("outcome") == F.col("outcome_q"), F.lit(False)) | F.coalesce(F.col("circuit") == F.col("circuit_q"), F.lit(False))
    return ranking_metrics(rows.withColumn("relevant", same), "query", "rank", "relevant", 10)


def format_context(spark, d):
    """The text on every case with a valid run, as a query case and as a precedent in full, by digest."""
    g = CaseGraph(spark, d)
    runs = one_per_key(X.latest_valid(table(spark, d, "irac_extractions")), ["docket_id"], F.desc("id")).select("docket_id", "x")
    rows = g.cases().select("docket_id", "case_name", "court_id").join(runs, "docket_id")
    zero = F.lit(0.0)
    precedent = full("case_name", "docket_id", "court_id", zero, F.lit(None).cast("string"), zero, zero, F.col("x"), X.ELEMENTS)
    return rows.select("docket_id", F.sha2(query_case("case_name", "docket_id", F.col("x"), X.ELEMENTS), 256).alias("as_query"), F.sha2(precedent, 256).alias("in_full"))


def court_sample(spark, d):
    """The first five distinct courts by id, and of each the first three dockets."""
    cases = CaseGraph(spark, d).cases().where("court_id <> ''")
    first = cases.select("court_id").distinct().orderBy("court_id").limit(5)
    return cases.join(F.broadcast(first), "court_id").groupBy("court_id").agg(F.slice(F.sort_array(F.collect_set("docket_id")), 1, 3).alias("dockets")).select("court_id", F.array_join("dockets", ",").alias("dockets"))


QUERIES = {f.__name__: f for f in (eligible_queue, annotator_pairs, element_accuracy, completed_records, lowered_elements, citation_flags, key_violations, run_gaps, case_retrieval, format_context, court_sample)}

_STATUS = lambda j, e: f"coalesce(json_extract_string({j}, '$.elements.{e}.status'), 'NOT_ANALYZED')"
_AT = "try_cast(rtrim(replace(trim(created_at), 'T', ' '), 'Z') AS TIMESTAMP)"
_KAPPA = "round(CASE WHEN pe >= 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6)"


def _kappa(a: str, b: str, rows: str) -> str:
    return f"""(SELECT a1, a2, {_KAPPA} AS kappa FROM (SELECT a1, a2, avg(CAST(same AS INT)) AS po, max(pe) AS pe FROM (SELECT a1, a2, {a} = {b} AS same FROM {rows}) JOIN
    (SELECT a1, a2, sum(x.n * y.n) / max(t * t) AS pe FROM (SELECT a1, a2, {a} AS c, count(*) AS n FROM {rows} GROUP BY ALL) x LEFT JOIN (SELECT a1, a2, {b} AS c, count(*) AS n FROM {rows} GROUP BY ALL) y USING (a1, a2, c) JOIN (SELECT a1, a2, count(*) AS t FROM {rows} GROUP BY ALL) USING (a1, a2) GROUP BY a1, a2) USING (a1, a2) GROUP BY a1, a2))"""


_PAIRS = (
    BASE
    + f""", an AS (SELECT r.*, i.llm_model AS annotator, row_number() OVER (PARTITION BY i.llm_model, r.docket_id ORDER BY {_AT.replace('created_at', 'r.created_at')} DESC NULLS LAST, r.id DESC) AS rn FROM runs r JOIN (SELECT DISTINCT id, llm_model FROM irac_extractions WHERE is_valid = 1 AND json_valid(extraction)) i ON i.id = r.id WHERE r.docket_id IS NOT NULL AND i.llm_model IS NOT NULL),
    la AS (SELECT * FROM an WHERE rn = 1), bo AS (SELECT x.annotator AS a1, y.annotator AS a2, x.docket_id, x.j AS j1, y.j AS j2 FROM la x JOIN la y ON x.docket_id = y.docket_id AND x.annotator < y.annotator),
    el AS ({' UNION ALL '.join(f"SELECT a1, a2, {_STATUS('j1', e)} AS x, {_STATUS('j2', e)} AS y FROM bo" for e in X.ELEMENTS)}), ou AS (SELECT a1, a2, j1->>'$.outcome' AS x, j2->>'$.outcome' AS y FROM bo)"""
)
_TRUTH = (
    BASE
    + f""", tr AS (SELECT *, row_number() OVER (PARTITION BY docket_id ORDER BY {_AT} NULLS LAST, id) AS f, row_number() OVER (PARTITION BY docket_id ORDER BY {_AT} DESC NULLS LAST, id DESC) AS l FROM runs WHERE docket_id IS NOT NULL),
    el AS ({' UNION ALL '.join(f"SELECT '{e}' AS element, {_STATUS('a.j', e)} AS t, {_STATUS('b.j', e)} AS p FROM tr a JOIN tr b USING (docket_id) WHERE a.f = 1 AND b.l = 1" for e in X.ELEMENTS)}),
    ok AS (SELECT * FROM el WHERE t IN {X.STATUSES} AND p IN {X.STATUSES}), rc AS (SELECT element, t, avg(CAST(t = p AS INT)) AS r FROM ok GROUP BY ALL)"""
)
ORACLES = {
    "eligible_queue": BASE
    + """ SELECT DISTINCT o.opinion_id, o.docket_id, k.case_name, k.court_id, l.procedural_stage AS stage, length(o.plain_text) AS n_chars FROM opinions o JOIN kase k ON k.docket_id = o.docket_id JOIN case_labels l ON l.opinion_id = o.opinion_id
    WHERE contamination_type = 'PRIVATE' AND l.outcome_label NOT IN ('UNLABELED') AND length(o.plain_text) > 1000 AND o.opinion_id NOT IN (SELECT opinion_id FROM irac_extractions WHERE is_valid = 1 AND opinion_id IS NOT NULL)""",
    "annotator_pairs": _PAIRS
    + f""" SELECT a1 AS annotator_1, a2 AS annotator_2, CASE WHEN contains(a1, 'retest') OR contains(a2, 'retest') THEN 'intra-rater' ELSE 'inter-rater' END AS type, n AS n_shared, e.kappa AS element_kappa, o.kappa AS outcome_kappa
    FROM (SELECT a1, a2, count(*) AS n FROM bo GROUP BY ALL) JOIN {_kappa('x', 'y', 'el')} e USING (a1, a2) JOIN {_kappa('x', 'y', 'ou')} o USING (a1, a2)""",
    "element_accuracy": _TRUTH + " SELECT element, count(*) AS n, round(avg(CAST(t = p AS INT)), 6) AS accuracy, (SELECT round(avg(r), 6) FROM rc WHERE rc.element = ok.element) AS balanced FROM ok GROUP BY 1",
    "completed_records": """WITH r AS (SELECT DISTINCT ON (id) *, json_valid(extraction) AS good FROM irac_extractions), s AS (SELECT opinion_id, min(procedural_stage) AS stage FROM case_labels WHERE opinion_id IS NOT NULL GROUP BY 1)
      SELECT id, NOT good AS failed, r.docket_id AS case_id, r.opinion_id, coalesce(stage, 'APPEAL') AS procedural_stage, CASE WHEN good THEN json_extract_string(CASE WHEN good THEN extraction ELSE '{}' END, '$.outcome') ELSE 'MIXED' END AS outcome,
      CASE WHEN good THEN len(json_keys(CASE WHEN good THEN extraction ELSE '{}' END, '$.elements')) ELSE 6 END AS n_elements, false AS confident FROM r LEFT JOIN s ON s.opinion_id = r.opinion_id""",
    "lowered_elements": _LATEST
    + _DONE[len(BASE) :]
    + f""", el AS (SELECT id, docket_id, j, unnest(json_keys(j, '$.elements')) AS element FROM lx), st AS (SELECT *, json_extract_string(j, '$.elements.' || element || '.status') AS s0 FROM el),
    s2 AS (SELECT id, docket_id, element, CASE WHEN s0 IN {X.STATUSES} THEN s0 ELSE 'NOT_ANALYZED' END AS status FROM st)
    SELECT id, element, status, status = 'NOT_ANALYZED' AS not_analyzed, status = 'CONTESTED' OR coalesce(abs(score) <= 0.1, false) AS contested FROM s2 LEFT JOIN scores ON entity_type = 'case' AND entity_id = CAST(docket_id AS VARCHAR)""",
    "citation_flags": BASE + _CP + f" SELECT docket_id, cited_docket, true AS verified, coalesce({_CIRCUIT.format('court_id')} <> {_CIRCUIT.format('cited_court')} AND {_CIRCUIT.format('cited_court')} <> 'scotus', false) AS cross_circuit FROM pf",
    "key_violations": " UNION ALL ".join(
        f"SELECT '{t}' AS name, (SELECT count(*) FROM {t} WHERE {k} IS NULL) AS n_null, (SELECT count(*) FROM (SELECT {k} FROM {t} WHERE {k} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS n_repeated"
        for t, k in (("cases", "docket_id"), ("opinions", "opinion_id"), ("parties", "party_id"), ("irac_extractions", "id"), ("landmarks", "opinion_id"), ("case_labels", "opinion_id"))
    ),
    "run_gaps": f"""WITH r AS (SELECT DISTINCT ON (id) id, llm_model, epoch({_AT}) AS t_ FROM irac_extractions), g AS (SELECT llm_model, CAST(t_ - lag(t_) OVER (PARTITION BY llm_model ORDER BY t_, id) AS BIGINT) AS gap FROM r WHERE t_ IS NOT NULL)
      SELECT llm_model, count(gap) AS n, min(gap) AS least, round(avg(gap), 6) AS mean, max(gap) AS most FROM g GROUP BY 1""",
    "case_retrieval": _FUSED.replace(" WHERE docket_id % 50 = 0", "")
    + f""", h AS (SELECT fr.query, fr.rank, coalesce(x.outcome_label = y.outcome_label AND x.outcome_label <> '', false) OR coalesce({_CIRCUIT.format('x.court_id')} = {_CIRCUIT.format('y.court_id')}, false) AS rel FROM fr JOIN owner USING (opinion_id) JOIN kase x ON x.docket_id = case_id JOIN kase y ON y.docket_id = fr.query),
    m AS (SELECT query, avg(CAST(rel AS INT)) AS p, sum(CASE WHEN rel THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, sum(CAST(rel AS INT)) AS n, min(CASE WHEN rel THEN rank END) AS f FROM h GROUP BY 1)
    SELECT round(avg(p), 6) AS p_at_k, round(avg(CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, CAST(n AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END), 6) AS ndcg, round(avg(coalesce(1.0 / f, 0)), 6) AS mrr, count(*) AS n FROM m""",
    "court_sample": BASE + ", f AS (SELECT DISTINCT court_id FROM kase WHERE court_id <> '' ORDER BY 1 LIMIT 5) SELECT court_id, array_to_string(list_slice(list_sort(list_distinct(list(docket_id))), 1, 3), ',') AS dockets FROM kase WHERE court_id IN (SELECT court_id FROM f) GROUP BY 1",
}
