"""Queries of text functions and pattern labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.functions import patterns as P
from casemill.functions import text as T
from casemill.functions.sections import analysis_text, sections
from casemill.operators import extractions as X
from casemill.tables import table


def _texts(spark, d) -> DataFrame:
    """One row per opinion and text: repeated rows differ in counts only."""
    return table(spark, d, "opinions").select("opinion_id", "docket_id", "plain_text").where("plain_text <> ''").distinct()


def contamination(spark, d):
    return table(spark, d, "cases").select("docket_id", P.first_class("case_name", P.PARTY_CLASSES, "PRIVATE").alias("class")).distinct()


def stage_detect(spark, d):
    courts = table(spark, d, "cases").groupBy("docket_id").agg(F.max("court_id").alias("court_id"))
    return _texts(spark, d).join(courts, "docket_id", "left").select("opinion_id", P.stage("plain_text", "court_id").alias("stage"))


def classify_outcome(spark, d):
    return _texts(spark, d).select("opinion_id", P.outcome("plain_text").alias("o")).select("opinion_id", "o.label", "o.source", F.round("o.confidence", 4).alias("confidence"), "o.pattern")


def label_breakdown(spark, d):
    return classify_outcome(spark, d).groupBy("label", "source").agg(F.count("*").alias("n"))


def scan_long_text(spark, d):
    """Filtered text scan: type and null checks reach the Parquet reader."""
    rows = table(spark, d, "opinions").where("plain_text is not null and type = '010combined'").where(F.length("plain_text") > 1000)
    return rows.select("opinion_id", "docket_id", F.length("plain_text").cast("long").alias("n_chars")).distinct()


def normalize_arguments(spark, d):
    rows = X.argument_rows(X.latest_valid(table(spark, d, "irac_extractions")))
    return rows.select("id", "side", F.col("position").cast("long").alias("position"), T.normalize_argument("text").alias("argument"), T.argument_hash("text").alias("text_hash"))


def normalize_names(spark, d):
    names = table(spark, d, "parties").select("name").union(table(spark, d, "cases").select("assigned_to_str")).where("name is not null").distinct()
    return names.select("name", T.normalize_name("name").alias("normal"))


def normalize_statutes(spark, d):
    causes = table(spark, d, "cases").select("cause").where("cause is not null").distinct()
    return causes.select("cause", T.normalize_statute("cause").alias("normal"), T.statute_key("cause").alias("statute_key"))


def case_name_keys(spark, d):
    return table(spark, d, "cases").select("case_name").where("case_name is not null").distinct().select("case_name", T.case_name_key("case_name").alias("name_key"))


def firm_names(spark, d):
    """Firms in contact blocks, here of three lines each made from parties."""
    block = F.concat(F.lit("Phone: 555-0100\n"), F.col("name"), F.lit("\n12 Main Street\n"), F.col("name"), F.lit(" LLP"))
    rows = table(spark, d, "parties").where("name is not null").select("party_id", block.alias("contact")).distinct()
    return rows.select("party_id", T.firm_name("contact").alias("firm"))


def url_opinion_id(spark, d):
    urls = table(spark, d, "citation_edges").select("cited_opinion_url").where("cited_opinion_url is not null").distinct()
    return urls.select("cited_opinion_url", F.regexp_extract("cited_opinion_url", r"/api/rest/v\d+/opinions/(\d+)/?", 1).try_cast("bigint").alias("opinion_id"))


def token_budget(spark, d):
    rows = _texts(spark, d)
    b = T.prompt_budget("plain_text")
    return rows.select("opinion_id", T.token_estimate("plain_text").cast("long").alias("tokens"), b["max_chars"].alias("max_chars"), b["out_tokens"].alias("out_tokens"))


def truncate_text(spark, d):
    return _texts(spark, d).select("opinion_id", F.sha2(T.truncate_middle("plain_text", 3000), 256).alias("digest"))


def text_fallback(spark, d):
    rows = table(spark, d, "opinions").select("opinion_id", T.first_text("syllabus", "disposition", "posture", "procedural_history").alias("text"))
    return rows.distinct()


def split_sections(spark, d):
    parts = _texts(spark, d).select("opinion_id", F.posexplode(sections("plain_text")).alias("n", "s"))
    return parts.select("opinion_id", "n", "s.*")


def section_chars(spark, d):
    return split_sections(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("n_chars"))


def analysis_chars(spark, d):
    rows = _texts(spark, d).withColumn("parts", sections("plain_text"))
    return rows.select("opinion_id", F.length(analysis_text(F.col("plain_text"), F.col("parts"))).alias("n_chars"))


def irac_outcome_rule(spark, d):
    x = X.latest_valid(table(spark, d, "irac_extractions"))
    statuses = F.transform_values("x.elements", lambda _, e: e["status"])
    return x.select("id", F.col("x.outcome").alias("stated"), X.outcome_of(statuses).alias("derived"))


def sub_condition_check(spark, d):
    rows = X.illegal_conditions(X.element_rows(X.latest_valid(table(spark, d, "irac_extractions"))))
    return rows.groupBy("element").agg(F.count("*").alias("n"), F.count_if(F.size("illegal") > 0).alias("n_illegal"), F.sum(F.size("illegal")).alias("n_conditions"))


def irac_validate(spark, d):
    rows = X.parsed(table(spark, d, "irac_extractions").dropDuplicates(["id"]))
    return rows.select("id", F.when(F.col("x").isNull(), F.lit("json")).otherwise(F.array_join(X.violations(F.col("x")), ",")).alias("broken"))


def extract_json(spark, d):
    rows = table(spark, d, "irac_extractions").dropDuplicates(["id"]).withColumn("raw", F.concat(F.lit("Answer:\n```json\n"), "extraction", F.lit("\n```")))
    return rows.select("id", F.sha2(X.json_in_text("raw"), 256).alias("digest"))


def latest_extraction(spark, d):
    return X.latest_valid(table(spark, d, "irac_extractions")).select("opinion_id", "id")


def status_rates(spark, d):
    rows = X.element_rows(X.latest_valid(table(spark, d, "irac_extractions")))
    return rows.groupBy("element", "status").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


QUERIES = {f.__name__: f for f in (contamination, stage_detect, classify_outcome, label_breakdown, scan_long_text, normalize_arguments, normalize_names, normalize_statutes, case_name_keys, firm_names, url_opinion_id, token_budget, truncate_text, text_fallback, split_sections, section_chars, analysis_chars, irac_outcome_rule, sub_condition_check, irac_validate, extract_json, latest_extraction, status_rates)}

_O = "o AS (SELECT DISTINCT opinion_id, docket_id, plain_text FROM opinions WHERE plain_text <> '')"


def _hit(column: str, patterns) -> str:
    """The name and confidence of the first pattern, as two CASE expressions."""
    name = "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p, _ in patterns) + " END"
    conf = "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p.replace(chr(39), chr(39) * 2)}') THEN {c}" for _, p, c in patterns) + " END"
    return f"{name}, {conf}"


def _hits(alias: str, column: str) -> str:
    return ", ".join(f"{_hit(column, ps).replace(' END, CASE', f' END AS {alias}{k}, CASE')} AS {alias}{k}_conf" for k, ps in (("m", P.MIXED), ("d", P.DEFENDANT), ("p", P.PLAINTIFF)))


def _pass(a: str, source: str, both_source: str, both: float, both_pattern: str, factor: float) -> str:
    affirmed = f"regexp_matches({a}, '{P.AFFIRMED}')"
    denied, granted = f"regexp_matches(lower(plain_text), '{P.BELOW_DENIED}')", f"regexp_matches(lower(plain_text), '{P.BELOW_GRANTED}')"
    k = a[0]

    def row(label, src, conf, pattern):
        return f"struct_pack(label := '{label}', source := '{src}', confidence := round(CAST({conf} AS DOUBLE), 4), pattern := {pattern})"

    return f"""CASE WHEN {k}m IS NOT NULL THEN {row("MIXED", source, f"{k}m_conf * {factor}", f"{k}m")}
    WHEN {k}d IS NOT NULL AND {k}p IS NOT NULL THEN {row("MIXED", both_source, both, f"'{both_pattern}'")}
    WHEN {k}d IS NOT NULL THEN {row("DEFENDANT_WINS", source, f"{k}d_conf * {factor}", f"{k}d")}
    WHEN {k}p IS NOT NULL THEN {row("PLAINTIFF_WINS", source, f"{k}p_conf * {factor}", f"{k}p")}
    WHEN {affirmed} AND {denied} THEN {row("PLAINTIFF_WINS", source, 0.7 * factor, "'affirmed_disambiguated'")}
    WHEN {affirmed} AND {granted} THEN {row("DEFENDANT_WINS", source, 0.7 * factor, "'affirmed_disambiguated'")}
    WHEN {affirmed} THEN {row("DEFENDANT_WINS", source, 0.5 * factor, "'affirmed_disambiguated'")} END"""


_OUTCOME = f"""WITH {_O}, t AS (SELECT *, right(plain_text, 2000) AS tail, plain_text AS full_ FROM o),
h AS (SELECT *, {_hits("t", "tail")}, {_hits("f", "full_")} FROM t),
r AS (SELECT opinion_id, coalesce({_pass("tail", "conclusion_regex", "conclusion_cooccurrence", 0.7, "both_in_tail", 1.0)},
  {_pass("full_", "fulltext_regex", "fulltext_cooccurrence", 0.5, "both_in_fulltext", 0.8)},
  struct_pack(label := 'UNCLEAR', source := 'no_signal', confidence := CAST(0 AS DOUBLE), pattern := '')) AS s FROM h)"""
_ANY = lambda c, ps: "(" + " OR ".join(f"regexp_matches({c}, '{p}')" for p in ps) + ")"
_X = """v AS (SELECT *, row_number() OVER (PARTITION BY opinion_id ORDER BY try_cast(rtrim(replace(trim(created_at), 'T', ' '), 'Z') AS TIMESTAMP) DESC NULLS LAST, id DESC) AS rn
  FROM (SELECT DISTINCT id, docket_id, opinion_id, extraction, created_at FROM irac_extractions WHERE is_valid = 1 AND json_valid(extraction))),
x AS (SELECT * EXCLUDE (extraction, rn), CAST(extraction AS JSON) AS j FROM v WHERE rn = 1)"""
_EL = _X + """, el AS (SELECT id, docket_id, opinion_id, k AS element, json_extract(j, '$.elements.' || k) AS e FROM x, unnest(json_keys(j, '$.elements')) AS t(k))"""

_RULES = {
    "stage": "coalesce(NOT (j->>'$.procedural_stage' IN ('MTD', 'SJ', 'TRIAL', 'APPEAL')), true)",
    "outcome": "coalesce(NOT (j->>'$.outcome' IN ('PLAINTIFF_WINS', 'DEFENDANT_WINS', 'MIXED')), true)",
    "elements": "len(list_filter(" + repr(list(X.ELEMENTS)) + ", lambda k: NOT list_contains(json_keys(j, '$.elements'), k))) > 0",
    "status": "len(list_filter(json_keys(j, '$.elements'), lambda k: NOT coalesce(json_extract_string(j, '$.elements.' || k || '.status') IN " + str(X.STATUSES) + ", false))) > 0",
    "confidence": "len(list_filter(json_keys(j, '$.elements'), lambda k: NOT coalesce(CAST(json_extract_string(j, '$.elements.' || k || '.confidence') AS DOUBLE) BETWEEN 0 AND 1, true))) > 0",
}
ORACLES = {
    # a cut-off object never closes, a whole one is the text between the fences
    "extract_json": "SELECT DISTINCT ON (id) id, CASE WHEN json_valid(extraction) THEN sha256(extraction) END AS digest FROM irac_extractions",
    "firm_names": r"""WITH p AS (SELECT DISTINCT party_id, name FROM parties WHERE name IS NOT NULL), l AS (SELECT party_id, name, ['Phone: 555-0100', trim(name), '12 Main Street', trim(name || ' LLP')] AS lines FROM p)
      SELECT party_id, list_filter(lines, lambda x: length(x) >= 5 AND NOT regexp_matches(x, '"""
    + T.CONTACT_LINE
    + """') AND regexp_matches(x, '"""
    + T.FIRM_MARKS
    + """'))[1] AS firm FROM l""",
    "irac_validate": "WITH r AS (SELECT DISTINCT id, extraction FROM irac_extractions), v AS (SELECT id, CAST(extraction AS JSON) AS j FROM r WHERE json_valid(extraction)) SELECT id, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {rule} THEN '{k}' END" for k, rule in _RULES.items())
    + "], lambda x: x IS NOT NULL), ',') AS broken FROM v UNION ALL SELECT id, 'json' FROM r WHERE NOT json_valid(extraction)",
    "contamination": "SELECT DISTINCT docket_id, CASE " + " ".join(f"WHEN {_ANY('case_name', ps)} THEN '{n}'" for n, ps in P.PARTY_CLASSES) + " ELSE 'PRIVATE' END AS class FROM cases",
    "stage_detect": f"WITH {_O}, c AS (SELECT docket_id, max(court_id) AS court_id FROM cases GROUP BY 1) SELECT opinion_id, CASE WHEN {_ANY('plain_text', P.STAGES['APPEAL'])} OR coalesce(starts_with(court_id, 'ca') OR court_id = 'scotus', false) THEN 'APPEAL' "
    + " ".join(f"WHEN {_ANY('plain_text', P.STAGES[s])} THEN '{s}'" for s in ("TRIAL", "SJ", "MTD")) + " END AS stage FROM o LEFT JOIN c USING (docket_id)",
    "classify_outcome": _OUTCOME + " SELECT opinion_id, s.label, s.source, s.confidence, s.pattern FROM r",
    "label_breakdown": _OUTCOME + " SELECT s.label, s.source, count(*) AS n FROM r GROUP BY ALL",
    "scan_long_text": "SELECT DISTINCT opinion_id, docket_id, length(plain_text) AS n_chars FROM opinions WHERE type = '010combined' AND length(plain_text) > 1000",
    "normalize_arguments": f"""WITH {_X}, a AS (SELECT id, 'plaintiff' AS side, unnest(CAST(j->'$.arguments_plaintiff' AS VARCHAR[])) AS t, generate_subscripts(CAST(j->'$.arguments_plaintiff' AS VARCHAR[]), 1) - 1 AS position FROM x
      UNION ALL SELECT id, 'defendant', unnest(CAST(j->'$.arguments_defendant' AS VARCHAR[])), generate_subscripts(CAST(j->'$.arguments_defendant' AS VARCHAR[]), 1) - 1 FROM x),
      n AS (SELECT id, side, position, rtrim(trim(regexp_replace(lower(t), '\\s+', ' ', 'g')), '.,;:') AS argument FROM a)
      SELECT id, side, position, argument, sha256(argument) AS text_hash FROM n""",
    "normalize_names": r"""WITH n AS (SELECT DISTINCT name FROM (SELECT name FROM parties UNION ALL SELECT assigned_to_str FROM cases) WHERE name IS NOT NULL)
      SELECT name, lower(trim(regexp_replace(regexp_replace(regexp_replace(trim(name), '(?i)^(hon\.?|judge|justice|chief\s+judge|magistrate\s+judge)\s+', ''), '(?i),?\s*(jr\.?|sr\.?|iii?|iv|esq\.?|ph\.?d\.?|j\.?d\.?)$', ''), '\s+', ' ', 'g'))) AS normal FROM n""",
    "normalize_statutes": r"""WITH c AS (SELECT DISTINCT cause FROM cases WHERE cause IS NOT NULL)
      SELECT cause, lower(trim(regexp_replace(regexp_replace(replace(replace(trim(cause), '§§', '§'), 'SS', '§'), '§\s*', '§ ', 'g'), '\s+', ' ', 'g'))) AS normal, lower(trim(regexp_replace(cause, '[§\s]+', ' ', 'g'))) AS statute_key FROM c""",
    "case_name_keys": r"SELECT DISTINCT case_name, trim(regexp_replace(lower(case_name), '[^a-z0-9\s]', '', 'g')) AS name_key FROM cases WHERE case_name IS NOT NULL",
    "url_opinion_id": r"SELECT DISTINCT cited_opinion_url, try_cast(nullif(regexp_extract(cited_opinion_url, '/api/rest/v\d+/opinions/(\d+)/?', 1), '') AS BIGINT) AS opinion_id FROM citation_edges WHERE cited_opinion_url IS NOT NULL",
    "token_budget": f"""WITH {_O}, t AS (SELECT opinion_id, length(plain_text) AS n, CAST(floor(length(plain_text) / 2.6) AS BIGINT) AS tokens FROM o)
      SELECT opinion_id, tokens, CASE WHEN 6892 - tokens >= 512 THEN n ELSE 15256 END AS max_chars, CASE WHEN 6892 - tokens >= 1024 THEN 1024 WHEN 6892 - tokens >= 512 THEN 6892 - tokens ELSE 1024 END AS out_tokens FROM t""",
    "truncate_text": f"""WITH {_O} SELECT opinion_id, sha256(CASE WHEN length(plain_text) <= 3000 THEN plain_text ELSE left(plain_text, 1800) || chr(10) || chr(10) || '[... TEXT TRUNCATED ...]' || chr(10) || chr(10) || right(plain_text, 1200) END) AS digest FROM o""",
    "text_fallback": "SELECT DISTINCT opinion_id, coalesce(nullif(syllabus, ''), nullif(disposition, ''), nullif(posture, ''), nullif(procedural_history, '')) AS text FROM opinions",
    "irac_outcome_rule": f"""WITH {_EL} SELECT x.id, j->>'$.outcome' AS stated, CASE WHEN count_if(e->>'$.status' = 'NOT_SATISFIED') > 0 THEN 'DEFENDANT_WINS' WHEN count(e) > 0 AND count_if(e->>'$.status' = 'SATISFIED') = count(e) THEN 'PLAINTIFF_WINS' ELSE 'MIXED' END AS derived
      FROM x LEFT JOIN el ON el.id = x.id GROUP BY 1, 2""",
    "sub_condition_check": f"""WITH {_EL}, b AS (SELECT element, len(list_distinct(list_filter(coalesce(CAST(e->'$.sub_conditions' AS VARCHAR[]), []), lambda s: NOT list_contains(CASE element {' '.join(f"WHEN '{k}' THEN {w}" for k, w in X.CONDITIONS.items())} ELSE [] END, s)))) AS bad FROM el)
      SELECT element, count(*) AS n, count_if(bad > 0) AS n_illegal, CAST(sum(bad) AS BIGINT) AS n_conditions FROM b GROUP BY 1""",
    "latest_extraction": f"WITH {_X} SELECT opinion_id, id FROM x",
    "status_rates": f"WITH {_EL} SELECT element, e->>'$.status' AS status, count(*) AS n, round(avg(CAST(e->>'$.confidence' AS DOUBLE)), 6) AS confidence FROM el GROUP BY 1, 2",
}
