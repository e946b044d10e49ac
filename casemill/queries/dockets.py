"""Queries of the flat records and inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.operators.graph import CaseGraph
from casemill.operators.profile import DISPOSITIONS, JUDGMENTS
from casemill.operators.records import one_per_key
from casemill.sources.dockets import DOCKET, inventory, records
from casemill.queries.graph import BASE
from casemill.tables import table, utc_stamp


def flat_records(spark, d):
    """The flat record of each docket's last scrape, from a nested docket built of its row and its parties."""
    cases = one_per_key(table(spark, d, "cases"), ["docket_id"], F.desc_nulls_last(utc_stamp("scraped_at")), F.desc_nulls_last("assigned_to_str"), F.desc_nulls_last("case_name"))
    people = table(spark, d, "parties").where("name is not null").select("docket_id", "party_id", "name", "party_type").distinct()
    one = F.struct("party_id", "name", F.coalesce("party_type", F.lit("")).alias("role"))
    listed = people.groupBy("docket_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["name"].alias("name"), F.array(F.struct(x["role"].alias("name"))).alias("party_types"))).alias("parties"))
    joined = cases.join(listed, "docket_id", "left")
    nested = joined.select(
        F.col("docket_id").cast("string").alias("identifier"), "case_name", F.col("court_id").alias("court"), "date_filed", "date_terminated", "date_last_filing", "assigned_to_str", "referred_to_str", "nature_of_suit", "cause", "absolute_url",
        "docket_number", "pacer_case_id", "jurisdiction_type", "jury_demand", "parties",
        F.struct(F.col("idb_disposition").alias("disposition"), F.col("idb_judgment").alias("judgment"), F.col("idb_procedural_progress").alias("procedural_progress"), F.col("idb_origin").alias("origin")).alias("idb_data"),
    )
    whole = spark.createDataFrame([], DOCKET).schema
    out = records(nested.select(F.from_json(F.to_json(F.struct("*")), whole).alias("x")).select("x.*"))
    return out.select("identifier", "case_title", "judges", "legal_topic", "case_status", "outcome", "judgment_code", "final_judgment_details", F.sha2("petitioner", 256).alias("petitioner"), F.sha2("respondent", 256).alias("respondent"))


def endpoint_inventory(spark, d):
    """Per kind of table, dockets with and without rows."""
    t = lambda n: table(spark, d, n)
    found = inventory(t("cases"), {"opinions": t("opinions").select("docket_id", "opinion_id", "plain_text"), "parties": t("parties").select("docket_id", "name", "party_type"), "labels": t("case_labels").select("docket_id", "outcome_label")})
    return found.groupBy("endpoint", "status", F.array_join("filled", ",").alias("filled")).agg(F.count("*").alias("n_dockets"), F.sum("n").alias("n_rows"))


def reverse_citations(spark, d):
    """How often each opinion is cited by opinions of the tables, and by how many dockets."""
    g = CaseGraph(spark, d)
    own = g.has_opinion().select(F.col("opinion_id").alias("src"), "docket_id")
    return g.cites().join(own, "src").groupBy(F.col("dst").alias("opinion_id")).agg(F.countDistinct("src").alias("n_opinions"), F.countDistinct("docket_id").alias("n_dockets"))


QUERIES = {f.__name__: f for f in (flat_records, endpoint_inventory, reverse_citations)}

_CODE = lambda c, names: f"CASE WHEN {c} IS NULL THEN NULL " + " ".join(f"WHEN {c} = {k} THEN '{v}'" for k, v in names.items()) + f" ELSE 'Code ' || {c} END"
_J = lambda *p: f"array_to_string(list_filter([{', '.join(p)}], lambda x: x IS NOT NULL AND x <> ''), '; ')"
ORACLES = {
    "flat_records": BASE
    + rf""", pp AS (SELECT docket_id, string_agg(name, '; ' ORDER BY party_id, name, role) FILTER (contains(role, 'Plaintiff')) AS pl, string_agg(name, '; ' ORDER BY party_id, name, role) FILTER (contains(role, 'Defendant') AND NOT contains(role, 'Plaintiff')) AS de
      FROM (SELECT * FROM (SELECT DISTINCT docket_id, party_id, name, coalesce(party_type, '') AS role FROM parties WHERE name IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY docket_id ORDER BY party_id, name, role) <= 200) GROUP BY 1)
    SELECT CAST(c.docket_id AS VARCHAR) AS identifier, coalesce(case_name, '') AS case_title, {_J('trim(assigned_to_str)', 'trim(referred_to_str)')} AS judges, {_J('trim(nature_of_suit)', 'trim(cause)')} AS legal_topic,
      CASE WHEN coalesce(date_terminated, '') <> '' THEN 'Closed' ELSE 'Open' END AS case_status, coalesce({_CODE('idb_disposition', DISPOSITIONS)}, '') AS outcome, coalesce(idb_judgment || ' - ' || {_CODE('idb_judgment', JUDGMENTS)}, '') AS judgment_code,
      {_J("'Disposition: ' || " + _CODE('idb_disposition', DISPOSITIONS), "'Judgment for: ' || " + _CODE('idb_judgment', JUDGMENTS), "CASE WHEN idb_procedural_progress <> 0 THEN 'Procedural progress: ' || idb_procedural_progress END")} AS final_judgment_details,
      sha256(coalesce(pl, '')) AS petitioner, sha256(coalesce(de, '')) AS respondent FROM c0 c LEFT JOIN pp ON pp.docket_id = c.docket_id WHERE rn = 1""",
    "endpoint_inventory": """WITH k AS (SELECT DISTINCT docket_id FROM cases),
    r AS (SELECT docket_id, 'opinions' AS endpoint, count(*) AS n, concat_ws(',', CASE WHEN count(opinion_id) > 0 THEN 'opinion_id' END, CASE WHEN count_if(trim(plain_text) <> '') > 0 THEN 'plain_text' END) AS filled FROM opinions GROUP BY 1
      UNION ALL SELECT docket_id, 'parties', count(*), concat_ws(',', CASE WHEN count_if(trim(name) <> '') > 0 THEN 'name' END, CASE WHEN count_if(trim(party_type) <> '') > 0 THEN 'party_type' END) FROM parties GROUP BY 1
      UNION ALL SELECT docket_id, 'labels', count(*), concat_ws(',', CASE WHEN count_if(trim(outcome_label) <> '') > 0 THEN 'outcome_label' END) FROM case_labels GROUP BY 1),
    j AS (SELECT e.endpoint, n, filled FROM k CROSS JOIN (VALUES ('opinions'), ('parties'), ('labels')) e(endpoint) LEFT JOIN r ON r.docket_id = k.docket_id AND r.endpoint = e.endpoint)
    SELECT endpoint, CASE WHEN n > 0 THEN 'ok' ELSE 'empty' END AS status, coalesce(filled, '') AS filled, count(*) AS n_dockets, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_rows FROM j GROUP BY 1, 2, 3""",
    "reverse_citations": BASE + " SELECT dst AS opinion_id, count(DISTINCT src) AS n_opinions, count(DISTINCT docket_id) AS n_dockets FROM cites JOIN hasop ON opinion_id = src GROUP BY 1",
}
