"""Queries of the graph and its scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.functions import text as T
from casemill.operators import scoring as S
from casemill.operators.graph import CaseGraph, chain_sample, chains_of_three, counts, within_two
from casemill.plans.durable import durable
from casemill.tables import table

EVERY = 50  # query rows: ids that are divisible by this
#: digits to which converged scores are given
DIGITS = 5


def node_case(spark, d):
    return CaseGraph(spark, d).cases().select("docket_id", "court_id", "outcome_label", "has_irac")


def node_opinion(spark, d):
    return CaseGraph(spark, d).opinions().select("opinion_id", "docket_id", "internal")


def node_statute(spark, d):
    return CaseGraph(spark, d).statutes()


def node_argument(spark, d):
    return CaseGraph(spark, d).arguments()


def node_judge(spark, d):
    return CaseGraph(spark, d).judges()


def node_company(spark, d):
    return CaseGraph(spark, d).companies()


def edge_has_opinion(spark, d):
    return CaseGraph(spark, d).has_opinion()


def edge_cites(spark, d):
    return CaseGraph(spark, d).cites()


def edge_charged_under(spark, d):
    return CaseGraph(spark, d).charged_under()


def edge_involves(spark, d):
    return CaseGraph(spark, d).involves().select("docket_id", "text_hash", F.col("sign").cast("long").alias("sign"), "side")


def edge_decided_by(spark, d):
    return CaseGraph(spark, d).decided_by()


def edge_defendant(spark, d):
    return CaseGraph(spark, d).defendant_is()


def _with_firms(spark, d, keep=False):
    """The graph with contact blocks made of the parties' names and notes, as the tables have no attorneys."""
    attorneys = table(spark, d, "parties").select("docket_id", F.concat_ws("\n", "extra_info", "name").alias("contact_raw"))
    return CaseGraph(spark, d, keep, attorneys)


def edge_represented_by(spark, d):
    return _with_firms(spark, d).represented_by()


def node_firm(spark, d):
    return _with_firms(spark, d).firms()


def graph_counts(spark, d):
    g = _with_firms(spark, d, keep=True)
    return counts({**g.nodes(), **g.edges()})


def sign_distribution(spark, d):
    return CaseGraph(spark, d).involves().groupBy(F.col("sign").cast("long").alias("sign")).agg(F.count("*").alias("n"), F.countDistinct("docket_id").alias("n_cases"), F.countDistinct("text_hash").alias("n_arguments"))


def orphan_cases(spark, d):
    """Cases without any edge."""
    g = _with_firms(spark, d)
    out = g.cases().select("docket_id")
    for e in (g.has_opinion(), g.charged_under(), g.involves(), g.decided_by(), g.defendant_is(), g.represented_by()):
        out = out.join(e.select("docket_id"), "docket_id", "left_anti")
    return out


def chain3(spark, d):
    """Citation chains of three opinions, counted by the first."""
    return chains_of_three(CaseGraph(spark, d).cites())


def chain3_sample(spark, d):
    """The first ten such chains."""
    return chain_sample(CaseGraph(spark, d, keep=True).cites())


def hops(spark, d):
    """Opinions within two links of every 50th opinion."""
    g = CaseGraph(spark, d)
    starts = g.read("opinions").where(F.col("opinion_id") % EVERY == 0).select(F.col("opinion_id").alias("start"))
    return within_two(starts, g.cites()).withColumn("distance", F.col("distance").cast("long"))


def _edges(spark, d, g=None):
    g = g or CaseGraph(spark, d, keep=True)
    uses = g.involves()
    outcome = F.col("x.outcome")
    seed = F.when(outcome == "PLAINTIFF_WINS", 1).when(outcome == "DEFENDANT_WINS", -1).otherwise(0)
    first = g.valid_runs().select("docket_id", "id", seed.alias("seed"), F.size("x.arguments_plaintiff").alias("n_p"), F.size("x.arguments_defendant").alias("n_d"))
    first = first.where("seed <> 0 and n_p + n_d > 0").groupBy("docket_id").agg(F.min_by("seed", "id").alias("seed"))
    return uses.join(first, "docket_id", "left").select(F.col("docket_id").alias("case_id"), F.col("text_hash").alias("arg_id"), "sign", F.coalesce("seed", F.lit(0)).alias("seed"))


def anco_k5(spark, d):
    args, cases, _ = S.reinforce(_edges(spark, d), rounds=5)
    return S.long_table(args, cases).withColumn("score", F.round("score", 6) + 0.0)


def anco_converged(spark, d, g=None):
    """Scores of arguments and cases when nothing moves any more."""
    args, cases, _ = S.reinforce(_edges(spark, d, g))
    return S.long_table(args, cases).withColumn("score", F.round("score", DIGITS) + 0.0)


def bip_degree(spark, d):
    e = _edges(spark, d).where("sign <> 0")
    degree = e.groupBy("arg_id").agg(F.count("*").alias("n"))
    return degree.agg(F.count("*").alias("n_arguments"), F.round(F.avg("n"), 6).alias("mean_degree"), F.max("n").alias("max_degree"), F.count_if(F.col("n") == 1).alias("n_single"), F.count_if(F.col("n") > 1).alias("n_shared"))


def score_bands(spark, d):
    return anco_converged(spark, d).where("entity_type = 'argument'").groupBy(S.band(F.col("score")).alias("band")).agg(F.count("*").alias("n"))


def score_histogram(spark, d):
    """Scores of cases in 20 bins by outcome of their label, and of arguments in 30."""
    scores = durable(anco_converged(spark, d), "scores")
    outcome = CaseGraph(spark, d).cases().select(F.col("docket_id").cast("string").alias("entity_id"), F.coalesce("outcome_label", F.lit("none")).alias("of"))
    cases = scores.where("entity_type = 'case'").join(outcome, "entity_id")
    args = scores.where("entity_type = 'argument'").withColumn("of", F.lit("argument"))
    return S.histogram(cases, "score", -1.1, 1.1, 20, "of").unionByName(S.histogram(args, "score", -1.1, 1.1, 30, "of"))


def score_by_outcome(spark, d):
    g = CaseGraph(spark, d)
    scores = anco_converged(spark, d).where("entity_type = 'case'").select(F.col("entity_id").cast("bigint").alias("docket_id"), "score")
    joined = scores.join(g.cases().select("docket_id", "outcome_label"), "docket_id")
    s = F.col("score")
    return joined.groupBy("outcome_label").agg(F.count("*").alias("n"), F.round(F.avg(s), 6).alias("mean"), F.round(F.stddev_pop(s), 6).alias("std"), F.min(s).alias("least"), F.max(s).alias("most"), F.round(F.avg((F.abs(s) > 0.99).cast("double")), 6).alias("extremal"), F.count_if(S.direction(F.col("outcome_label"), s)).alias("n_agree"))


def top_bottom(spark, d):
    """The ten highest and lowest argument scores; ties by hash."""
    args = anco_converged(spark, d).where("entity_type = 'argument'").select("entity_id", "score")
    top = args.orderBy(F.desc("score"), "entity_id").limit(10).withColumn("kind", F.lit("top"))
    return top.unionByName(args.orderBy("score", "entity_id").limit(10).withColumn("kind", F.lit("bottom")))


QUERIES = {f.__name__: f for f in (node_case, node_opinion, node_statute, node_argument, node_judge, node_company, edge_has_opinion, edge_cites, edge_charged_under, edge_involves, edge_decided_by, edge_defendant, edge_represented_by, node_firm, graph_counts, sign_distribution, orphan_cases, chain3, chain3_sample, hops, anco_k5, anco_converged, bip_degree, score_bands, score_histogram, score_by_outcome, top_bottom)}

_STAMP = lambda c: f"try_cast(rtrim(replace(trim({c}), 'T', ' '), 'Z') AS TIMESTAMP)"
_NORM = r"lower(trim(regexp_replace(regexp_replace(regexp_replace(trim({0}), '(?i)^(hon\.?|judge|justice|chief\s+judge|magistrate\s+judge)\s+', ''), '(?i),?\s*(jr\.?|sr\.?|iii?|iv|esq\.?|ph\.?d\.?|j\.?d\.?)$', ''), '\s+', ' ', 'g')))"
_STATUTE = r"lower(trim(regexp_replace(regexp_replace(replace(replace(trim({0}), '§§', '§'), 'SS', '§'), '§\s*', '§ ', 'g'), '\s+', ' ', 'g')))"
BASE = rf"""WITH RECURSIVE runs AS (SELECT DISTINCT ON (id) id, docket_id, opinion_id, created_at, CAST(extraction AS JSON) AS j FROM irac_extractions WHERE is_valid = 1 AND json_valid(extraction)),
c0 AS (SELECT *, row_number() OVER (PARTITION BY docket_id ORDER BY {_STAMP('scraped_at')} DESC NULLS LAST, assigned_to_str DESC NULLS LAST, case_name DESC NULLS LAST) AS rn FROM cases),
l0 AS (SELECT docket_id, outcome_label, procedural_stage, row_number() OVER (PARTITION BY docket_id ORDER BY label_confidence DESC NULLS LAST, outcome_label NULLS LAST, opinion_id NULLS LAST) AS rn FROM case_labels),
kase AS (SELECT c.docket_id, c.case_name, c.court_id, c.date_filed, c.cause, c.assigned_to_str, l.outcome_label, l.procedural_stage, c.docket_id IN (SELECT docket_id FROM runs WHERE docket_id IS NOT NULL) AS has_irac
  FROM c0 c LEFT JOIN (SELECT * FROM l0 WHERE rn = 1) l ON l.docket_id = c.docket_id WHERE c.rn = 1),
cited AS (SELECT DISTINCT source_opinion_id AS src, try_cast(nullif(regexp_extract(cited_opinion_url, '(?i)/opinions/([0-9]+)', 1), '') AS BIGINT) AS dst FROM citation_edges),
ops AS (SELECT opinion_id, min(docket_id) AS docket_id, min(nullif(trim(cluster_date_filed), '')) AS date_filed FROM opinions GROUP BY 1),
cites AS (SELECT src, dst FROM cited WHERE dst IS NOT NULL AND src IN (SELECT opinion_id FROM ops)),
opinion AS (SELECT opinion_id, docket_id, true AS internal FROM ops UNION ALL SELECT DISTINCT dst, NULL, false FROM cited WHERE dst IS NOT NULL AND dst NOT IN (SELECT opinion_id FROM ops)),
args AS (SELECT id, docket_id, j->>'$.outcome' AS outcome, 'plaintiff' AS side, 0 AS s, unnest(CAST(j->'$.arguments_plaintiff' AS VARCHAR[])) AS t, generate_subscripts(CAST(j->'$.arguments_plaintiff' AS VARCHAR[]), 1) AS position FROM runs
  UNION ALL SELECT id, docket_id, j->>'$.outcome', 'defendant', 1, unnest(CAST(j->'$.arguments_defendant' AS VARCHAR[])), generate_subscripts(CAST(j->'$.arguments_defendant' AS VARCHAR[]), 1) FROM runs),
arg AS (SELECT *, rtrim(trim(regexp_replace(lower(t), '\s+', ' ', 'g')), '.,;:') AS norm FROM args),
a AS (SELECT *, sha256(norm) AS text_hash, CASE WHEN outcome = 'PLAINTIFF_WINS' THEN CASE side WHEN 'plaintiff' THEN 1 ELSE -1 END WHEN outcome = 'DEFENDANT_WINS' THEN CASE side WHEN 'plaintiff' THEN -1 ELSE 1 END ELSE 0 END AS sign FROM arg WHERE norm <> ''),
inv0 AS (SELECT *, row_number() OVER (PARTITION BY docket_id, text_hash ORDER BY id DESC, s DESC, position DESC) AS rn FROM a),
involves AS (SELECT docket_id, text_hash, sign, side FROM inv0 WHERE rn = 1),
charged AS (SELECT DISTINCT docket_id, {_STATUTE.format('st')} AS statute FROM (SELECT docket_id, cause AS st FROM kase UNION ALL SELECT docket_id, unnest(CAST(j->'$.statutes_cited' AS VARCHAR[])) FROM runs) WHERE {_STATUTE.format('st')} <> ''),
authors AS (SELECT DISTINCT docket_id, {_NORM.format('author_str')} AS judge FROM opinions WHERE trim(author_str) <> '' AND {_NORM.format('author_str')} <> ''),
decided AS (SELECT * FROM authors UNION SELECT docket_id, {_NORM.format('assigned_to_str')} FROM kase WHERE trim(assigned_to_str) <> '' AND {_NORM.format('assigned_to_str')} <> '' AND docket_id NOT IN (SELECT docket_id FROM authors WHERE docket_id IS NOT NULL)),
defendant AS (SELECT DISTINCT docket_id, {_NORM.format('name')} AS company FROM parties WHERE party_type ILIKE '%defendant%' AND trim(name) <> '' AND {_NORM.format('name')} <> ''),
firm0 AS (SELECT DISTINCT docket_id, lower(trim(regexp_replace(list_filter(list_transform(string_split(concat_ws(chr(10), extra_info, name), chr(10)), lambda x: trim(x)), lambda x: length(x) >= 5 AND NOT regexp_matches(x, '{T.CONTACT_LINE}') AND regexp_matches(x, '{T.FIRM_MARKS}'))[1], '\s+', ' ', 'g'))) AS firm FROM parties),
side AS (SELECT docket_id, min_by(CASE WHEN contains(party_type, 'Defendant') THEN 'defendant' ELSE 'plaintiff' END, party_id) AS side FROM parties GROUP BY 1),
repby AS (SELECT f.docket_id, firm, side FROM firm0 f LEFT JOIN side s ON s.docket_id = f.docket_id WHERE firm IS NOT NULL AND f.docket_id IS NOT NULL),
hasop AS (SELECT DISTINCT docket_id, opinion_id FROM opinions WHERE docket_id IN (SELECT docket_id FROM kase)),
seed0 AS (SELECT docket_id, CASE j->>'$.outcome' WHEN 'PLAINTIFF_WINS' THEN 1 ELSE -1 END AS seed, row_number() OVER (PARTITION BY docket_id ORDER BY id) AS rn FROM runs
  WHERE j->>'$.outcome' IN ('PLAINTIFF_WINS', 'DEFENDANT_WINS') AND json_array_length(j, '$.arguments_plaintiff') + json_array_length(j, '$.arguments_defendant') > 0),
e AS (SELECT i.docket_id AS case_id, text_hash AS arg_id, CAST(sign AS DOUBLE) AS sign, coalesce(seed, 0) AS seed FROM involves i LEFT JOIN (SELECT * FROM seed0 WHERE rn = 1) s ON s.docket_id = i.docket_id)"""


ROUNDS = 40


def anco_sql(rounds: int, digits: int = 6) -> str:
    out = ", x0 AS (SELECT DISTINCT case_id, CAST(seed AS DOUBLE) AS score FROM e)"
    mean = "coalesce(sum(sign * score) / nullif(sum(abs(sign * score)), 0), 0) AS score"
    for k in range(1, rounds + 1):
        out += f", y{k} AS MATERIALIZED (SELECT arg_id, {mean} FROM e JOIN x{k - 1} USING (case_id) GROUP BY 1), x{k} AS MATERIALIZED (SELECT case_id, {mean} FROM e JOIN y{k} USING (arg_id) GROUP BY 1)"
    return out + f", scores AS (SELECT 'argument' AS entity_type, arg_id AS entity_id, round(score, {digits}) + 0.0 AS score FROM y{rounds} UNION ALL SELECT 'case', CAST(case_id AS VARCHAR), round(score, {digits}) + 0.0 FROM x{rounds})"


_ANCO = BASE + anco_sql(5)
#: rounds by which nothing moves any more on tables of the size that SQL is checked on
_DONE = BASE + anco_sql(ROUNDS, DIGITS)
ORACLES = {
    "node_case": BASE + " SELECT docket_id, court_id, outcome_label, has_irac FROM kase",
    "node_opinion": BASE + " SELECT opinion_id, docket_id, internal FROM opinion",
    "node_statute": BASE + " SELECT DISTINCT statute FROM charged",
    "node_argument": BASE + ", f AS (SELECT text_hash, t AS text, side, row_number() OVER (PARTITION BY text_hash ORDER BY id, s, position) AS rn, count(*) OVER (PARTITION BY text_hash) AS n_uses FROM a) SELECT text_hash, text, side, n_uses FROM f WHERE rn = 1",
    "node_judge": BASE + " SELECT DISTINCT judge FROM decided",
    "node_company": BASE + " SELECT DISTINCT company FROM defendant",
    "edge_has_opinion": BASE + " SELECT * FROM hasop",
    "edge_cites": BASE + " SELECT * FROM cites",
    "edge_charged_under": BASE + " SELECT * FROM charged",
    "edge_involves": BASE + " SELECT * FROM involves",
    "edge_decided_by": BASE + " SELECT * FROM decided",
    "edge_represented_by": BASE + " SELECT docket_id, firm, side FROM repby",
    "node_firm": BASE + " SELECT DISTINCT firm FROM repby",
    "edge_defendant": BASE + " SELECT * FROM defendant",
    "graph_counts": BASE
    + """ SELECT 'Case' AS name, count(*) AS n FROM kase UNION ALL SELECT 'Opinion', count(*) FROM opinion UNION ALL SELECT 'Statute', count(DISTINCT statute) FROM charged
    UNION ALL SELECT 'Argument', count(DISTINCT text_hash) FROM a UNION ALL SELECT 'Judge', count(DISTINCT judge) FROM decided UNION ALL SELECT 'Company', count(DISTINCT company) FROM defendant
    UNION ALL SELECT 'HAS_OPINION', count(*) FROM hasop UNION ALL SELECT 'CITES', count(*) FROM cites UNION ALL SELECT 'CHARGED_UNDER', count(*) FROM charged UNION ALL SELECT 'INVOLVES', count(*) FROM involves
    UNION ALL SELECT 'DECIDED_BY', count(*) FROM decided UNION ALL SELECT 'DEFENDANT_IS', count(*) FROM defendant UNION ALL SELECT 'Firm', count(DISTINCT firm) FROM repby UNION ALL SELECT 'REPRESENTED_BY', count(*) FROM repby""",
    "sign_distribution": BASE + " SELECT sign, count(*) AS n, count(DISTINCT docket_id) AS n_cases, count(DISTINCT text_hash) AS n_arguments FROM involves GROUP BY 1",
    "orphan_cases": BASE + " SELECT docket_id FROM kase WHERE docket_id NOT IN (SELECT docket_id FROM hasop UNION SELECT docket_id FROM charged UNION SELECT docket_id FROM involves UNION SELECT docket_id FROM decided UNION SELECT docket_id FROM defendant WHERE docket_id IS NOT NULL UNION SELECT docket_id FROM repby)",
    "chain3": BASE + " SELECT x.src AS opinion_id, count(*) AS n FROM cites x JOIN cites y ON x.dst = y.src AND x.src <> y.dst GROUP BY 1",
    "chain3_sample": BASE + " SELECT x.src AS a, x.dst AS b, y.dst AS c FROM cites x JOIN cites y ON x.dst = y.src AND x.src <> y.dst ORDER BY 1, 2, 3 LIMIT 10",
    "hops": BASE
    + """, n AS (SELECT src, dst, src AS s, dst AS t FROM cites WHERE src <> dst UNION ALL SELECT dst, src, src, dst FROM cites WHERE src <> dst),
    h AS (SELECT src AS start, dst AS opinion_id, 1 AS distance FROM n WHERE src IN (SELECT opinion_id FROM ops WHERE opinion_id % 50 = 0)
      UNION ALL SELECT x.src, y.dst, 2 FROM n x JOIN n y ON x.dst = y.src WHERE x.src IN (SELECT opinion_id FROM ops WHERE opinion_id % 50 = 0) AND (x.s, x.t) <> (y.s, y.t) AND y.dst <> x.src)
    SELECT start, opinion_id, min(distance) AS distance FROM h GROUP BY 1, 2""",
    "anco_k5": _ANCO + " SELECT * FROM scores",
    "anco_converged": _DONE + " SELECT * FROM scores",
    "bip_degree": BASE + ", g AS (SELECT arg_id, count(*) AS n FROM e WHERE sign <> 0 GROUP BY 1) SELECT count(*) AS n_arguments, round(avg(n), 6) AS mean_degree, max(n) AS max_degree, count_if(n = 1) AS n_single, count_if(n > 1) AS n_shared FROM g",
    "score_bands": _DONE + " SELECT CASE " + " ".join(f"WHEN score >= {lo} AND score < {hi} THEN '{n}'" for n, lo, hi in S.BANDS) + " END AS band, count(*) AS n FROM scores WHERE entity_type = 'argument' GROUP BY 1",
    "score_histogram": _DONE
    + """, h AS (SELECT coalesce(outcome_label, 'none') AS of_, score, 20 AS n FROM scores JOIN kase ON CAST(docket_id AS VARCHAR) = entity_id WHERE entity_type = 'case' UNION ALL SELECT 'argument', score, 30 FROM scores WHERE entity_type = 'argument')
    SELECT of_ AS "of", CAST(least(floor((score + 1.1) / 2.2 * n), n - 1) AS BIGINT) AS bin, count(*) AS n FROM h GROUP BY 1, 2""",
    "score_by_outcome": _DONE
    + """ SELECT outcome_label, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, min(score) AS least, max(score) AS most, round(avg(CASE WHEN abs(score) > 0.99 THEN 1.0 ELSE 0.0 END), 6) AS extremal,
    count_if(CASE outcome_label WHEN 'PLAINTIFF_WINS' THEN score > 0 WHEN 'DEFENDANT_WINS' THEN score < 0 ELSE outcome_label = 'MIXED' END) AS n_agree FROM scores JOIN kase ON CAST(docket_id AS VARCHAR) = entity_id WHERE entity_type = 'case' GROUP BY 1""",
    "top_bottom": _DONE + " SELECT * FROM (SELECT entity_id, score, 'top' AS kind FROM scores WHERE entity_type = 'argument' ORDER BY score DESC, entity_id LIMIT 10) UNION ALL SELECT * FROM (SELECT entity_id, score, 'bottom' FROM scores WHERE entity_type = 'argument' ORDER BY score, entity_id LIMIT 10)",
}
