"""Queries of scans, row versions, profiles, joins of the star schema, and the stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from casemill.operators import profile as Pr
from casemill.operators.extractions import latest_valid
from casemill.operators.records import one_per_key, to_do, upsert
from casemill.plans.durable import shared_dir
from casemill.sources.landed import manifest, zipped
from casemill.streaming.ingest import KeyedTable, ingest, windowed_counts
from casemill.tables import table, utc_stamp


def resume_todo(spark, d):
    """Dockets seen and not scraped to the end."""
    cases = table(spark, d, "cases")
    return to_do(cases, cases.where("scrape_status = 'done'"), ["docket_id"])


def upsert_replace(spark, d):
    """The last open order of each customer over a table that has their first filled ones."""
    return _upserted(spark, d, "replace")


def upsert_ignore(spark, d):
    return _upserted(spark, d, "ignore")


def _upserted(spark, d, policy):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    current = one_per_key(orders.where("o_orderstatus = 'F'"), ["o_custkey"], F.asc("o_orderkey"))
    return upsert(current, orders.where("o_orderstatus = 'O'"), ["o_custkey"], "o_orderkey", policy).drop("o_orderstatus")


def latest_scrape(spark, d):
    return one_per_key(table(spark, d, "cases"), ["docket_id"], F.desc_nulls_last(utc_stamp("scraped_at")), F.desc_nulls_last("assigned_to_str"), F.desc_nulls_last("case_name")).select("docket_id", "case_name", "scraped_at")


def first_opinion_per_docket(spark, d):
    return table(spark, d, "opinions").groupBy("docket_id").agg(F.min("opinion_id").alias("opinion_id"))


def case_fill_rates(spark, d):
    return Pr.fill_rates(table(spark, d, "cases"))


def _dense(spark, d):
    cases = table(spark, d, "cases")
    return cases.select("scrape_status", Pr.density(cases, cases.columns).alias("density"))


def density_median(spark, d):
    return Pr.upper_median(_dense(spark, d), "density").select("median", "mean")


def density_bins(spark, d):
    return Pr.bins(_dense(spark, d), "density", 5)


def density_by_status(spark, d):
    return _dense(spark, d).groupBy("scrape_status").agg(F.count("*").alias("n"), F.round(F.avg("density"), 6).alias("mean"))


def value_counts(spark, d):
    return Pr.value_counts(table(spark, d, "cases"), "nature_of_suit", 10)


def fjc_decode(spark, d):
    rows = table(spark, d, "cases").select(Pr.decode(F.col("idb_disposition"), Pr.DISPOSITIONS).alias("disposition"), Pr.decode(F.col("idb_judgment"), Pr.JUDGMENTS).alias("judgment"), F.when(F.coalesce("date_terminated", F.lit("")) != "", "closed").otherwise("open").alias("case_status"))
    return rows.groupBy("disposition", "judgment", "case_status").agg(F.count("*").alias("n"))


def role_route(spark, d):
    return table(spark, d, "parties").select("docket_id", "party_id", "party_type").distinct().groupBy(Pr.role_class(F.col("party_type")).alias("role")).agg(F.count("*").alias("n"), F.countDistinct("docket_id").alias("n_dockets"))


def schema_profile(spark, d):
    """Top-level fields and types of the extractions' JSON."""
    rows = table(spark, d, "irac_extractions").select("id", "extraction").dropDuplicates(["id"])
    return Pr.json_profile(rows, "extraction").groupBy("field").agg(F.sum("n").alias("n"))


def zip_arrays(spark, d):
    """Parallel arrays of each extraction as rows."""
    x = latest_valid(table(spark, d, "irac_extractions")).select("id", F.col("x.statutes_cited").alias("statute"), F.col("x.precedents_cited").alias("precedent"))
    return zipped(x, "id", ["statute", "precedent"]).withColumn("n", F.col("n").cast("long"))


def file_manifest(spark, d):
    urls = table(spark, d, "opinions").select("download_url").where("download_url is not null").distinct()
    return manifest(urls, "download_url").select("extension", "n", F.array_join("names", " ").alias("names"))


def doc_types(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count("*").alias("n"), F.count_if(F.coalesce("text", F.lit("")) != "").alias("n_text"), F.coalesce(F.min(n), F.lit(0)).alias("least"), F.coalesce(F.max(n), F.lit(0)).alias("most"))


def pricing_summary(spark, d):
    """Grouped aggregates over the fact table: one pass, partial aggregation before the shuffle."""
    rows = table(spark, d, "lineitem").where("l_shipdate <= timestamp'1998-09-02'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


def region_revenue(spark, d):
    """A star join: the planner broadcasts the dimensions by their sizes."""
    t = lambda x: table(spark, d, x)
    rows = t("lineitem").join(t("orders"), F.expr("l_orderkey = o_orderkey")).join(t("customer"), F.expr("o_custkey = c_custkey")).join(t("nation"), F.expr("c_nationkey = n_nationkey")).join(t("region"), F.expr("n_regionkey = r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def stream_ingest(spark, d):
    """The newest event of each user after the whole stream went through keyed upserts."""
    source = table(spark, d, "events")
    columns = source.select("user_id", "event_id", "event_type", "value")
    events = spark.readStream.schema(source.schema).parquet(f"{d}/events.parquet*").select(*columns.columns)
    root = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    target = KeyedTable(spark, f"{root}/table", ["user_id"], "event_id")
    ingest(events, target, f"{root}/checkpoint")
    return target.read()


def event_windows(spark, d):
    """Hourly counts and sums by event type, kept up to date by a stream with a watermark of an hour."""
    source = table(spark, d, "events")
    events = spark.readStream.schema(source.schema).parquet(f"{d}/events.parquet*")
    root = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    target = KeyedTable(spark, f"{root}/table", ["start", "event_type"], "n")
    ingest(windowed_counts(events), target, f"{root}/checkpoint", "update")
    return target.read().select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {f.__name__: f for f in (resume_todo, upsert_replace, upsert_ignore, latest_scrape, first_opinion_per_docket, case_fill_rates, density_median, density_bins, density_by_status, value_counts, fjc_decode, role_route, schema_profile, zip_arrays, file_manifest, doc_types, pricing_summary, region_revenue, stream_ingest, event_windows)}

_STAMP = "try_cast(rtrim(replace(trim(scraped_at), 'T', ' '), 'Z') AS TIMESTAMP)"
_CASES = "docket_id case_name docket_number pacer_case_id slug absolute_url court_id cause nature_of_suit jurisdiction_type date_filed date_terminated date_last_filing assigned_to_str referred_to_str jury_demand idb_disposition idb_judgment idb_procedural_progress idb_nature_of_suit idb_monetary_demand idb_pro_se idb_class_action idb_origin idb_jury_demand has_opinions scrape_status scraped_at".split()
_DENSE = "d AS (SELECT scrape_status, " + " + ".join(f"CASE WHEN trim(CAST({c} AS VARCHAR)) <> '' THEN 1 ELSE 0 END" for c in _CASES) + " AS density FROM cases)"
_DECODE = lambda c, names: f"CASE WHEN {c} IS NULL THEN NULL " + " ".join(f"WHEN {c} = {k} THEN '{v}'" for k, v in names.items()) + f" ELSE 'Code ' || {c} END"
_UP = "f AS (SELECT o_custkey, min_by(o_orderkey, o_orderkey) AS o_orderkey, min_by(o_totalprice, o_orderkey) AS o_totalprice FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)"
ORACLES = {
    "resume_todo": "SELECT DISTINCT docket_id FROM cases WHERE docket_id NOT IN (SELECT docket_id FROM cases WHERE scrape_status = 'done')",
    "upsert_replace": f"WITH {_UP}, b AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey, max_by(o_totalprice, o_orderkey) AS o_totalprice FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT * FROM f WHERE o_custkey NOT IN (SELECT o_custkey FROM b) UNION ALL SELECT * FROM b",
    "upsert_ignore": f"WITH {_UP}, b AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey, min_by(o_totalprice, o_orderkey) AS o_totalprice FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT * FROM f UNION ALL SELECT * FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM f)",
    "latest_scrape": f"SELECT docket_id, case_name, scraped_at FROM cases QUALIFY row_number() OVER (PARTITION BY docket_id ORDER BY {_STAMP} DESC NULLS LAST, assigned_to_str DESC NULLS LAST, case_name DESC NULLS LAST) = 1",
    "first_opinion_per_docket": "SELECT docket_id, min(opinion_id) AS opinion_id FROM opinions GROUP BY 1",
    "case_fill_rates": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count_if(trim(CAST({c} AS VARCHAR)) <> '') AS n_filled, count(*) AS n, round(count_if(trim(CAST({c} AS VARCHAR)) <> '') / count(*), 6) AS rate FROM cases" for c in _CASES),
    "density_median": f"WITH {_DENSE} SELECT (SELECT list_sort(list(density))[len(list(density)) // 2 + 1] FROM d) AS median, (SELECT round(avg(density), 6) FROM d) AS mean",
    "density_bins": f"WITH {_DENSE} SELECT density // 5 * 5 AS bin, count(*) AS n FROM d GROUP BY 1",
    "density_by_status": f"WITH {_DENSE} SELECT scrape_status, count(*) AS n, round(avg(density), 6) AS mean FROM d GROUP BY 1",
    "value_counts": "SELECT nature_of_suit AS value, count(*) AS n FROM cases GROUP BY 1 ORDER BY n DESC, value NULLS FIRST LIMIT 10",
    "fjc_decode": f"SELECT {_DECODE('idb_disposition', Pr.DISPOSITIONS)} AS disposition, {_DECODE('idb_judgment', Pr.JUDGMENTS)} AS judgment, CASE WHEN coalesce(date_terminated, '') <> '' THEN 'closed' ELSE 'open' END AS case_status, count(*) AS n FROM cases GROUP BY ALL",
    "role_route": "SELECT CASE WHEN contains(party_type, 'Plaintiff') THEN 'plaintiff' WHEN contains(party_type, 'Defendant') THEN 'defendant' WHEN contains(party_type, 'Relief') THEN 'relief' ELSE 'other' END AS role, count(*) AS n, count(DISTINCT docket_id) AS n_dockets FROM (SELECT DISTINCT docket_id, party_id, party_type FROM parties) GROUP BY 1",
    "schema_profile": "WITH r AS (SELECT DISTINCT id, extraction FROM irac_extractions WHERE json_valid(extraction)) SELECT field, count(*) AS n FROM (SELECT unnest(json_keys(CAST(extraction AS JSON))) AS field FROM r) GROUP BY 1",
    "zip_arrays": """WITH v AS (SELECT *, row_number() OVER (PARTITION BY opinion_id ORDER BY try_cast(rtrim(replace(trim(created_at), 'T', ' '), 'Z') AS TIMESTAMP) DESC NULLS LAST, id DESC) AS rn FROM (SELECT DISTINCT id, opinion_id, extraction, created_at FROM irac_extractions WHERE is_valid = 1 AND json_valid(extraction))),
      a AS (SELECT id, CAST(CAST(extraction AS JSON)->'$.statutes_cited' AS VARCHAR[]) AS s, CAST(CAST(extraction AS JSON)->'$.precedents_cited' AS VARCHAR[]) AS p FROM v WHERE rn = 1)
      SELECT id, n, s[n + 1] AS statute, p[n + 1] AS precedent FROM (SELECT *, unnest(range(0, greatest(coalesce(len(s), 0), coalesce(len(p), 0)))) AS n FROM a)""",
    "file_manifest": r"SELECT lower(regexp_extract(download_url, '\.([A-Za-z0-9]+)$', 1)) AS extension, count(*) AS n, array_to_string(list_slice(list_sort(list(download_url)), 1, 20), ' ') AS names FROM (SELECT DISTINCT download_url FROM opinions WHERE download_url IS NOT NULL) GROUP BY 1",
    "doc_types": "SELECT lower(trim(source)) AS source, count(*) AS n, count_if(coalesce(text, '') <> '') AS n_text, coalesce(min(n_chars), 0) AS least, coalesce(max(n_chars), 0) AS most FROM documents GROUP BY 1",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "region_revenue": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "event_windows": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_ingest": "SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events GROUP BY 1",
}
