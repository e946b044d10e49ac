"""Queries of the mix."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm.mixing import count_tokens, mix
from casemill.plans.durable import durable
from casemill.tables import absent_if_blank, table


def _records(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", F.lower(F.trim(absent_if_blank("source"))).alias("source"), "text")
    return count_tokens(documents)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every use of a record in the mix, with its slot and its place in its source's line of tokens."""
    return mix(_records(spark, d), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of all tokens that each source reached, beside its target."""
    return mix(_records(spark, d), table(spark, d, "mix_targets"))[1]


def p9_rules(spark: SparkSession, d: str) -> DataFrame:
    """Per target, its records and whether the mix obeys: repeats kept, budget and target share met to within one record.

    Targets whose source has no record have a null share_met; the others share its weight.
    """
    records = durable(_records(spark, d).select("doc_id", "source", "n_tokens").where("n_tokens > 0"), "counted")
    mixed, shares = mix(records, table(spark, d, "mix_targets"))
    sizes = records.groupBy("source").agg(F.count("*").alias("n_records"), F.max("n_tokens").alias("longest"))
    uses = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("n")).groupBy("source").agg(F.max("n").alias("most_uses"))
    live = shares.where("have_tokens > 0").agg(F.sum("target_weight").alias("live"), F.sum("budget").alias("whole"), F.count("*").alias("n_live"))
    rows = shares.join(sizes, "source", "left").join(uses, "source", "left").crossJoin(live)  # one row
    met = (F.abs(F.col("tokens") - F.col("budget")) <= F.col("longest")) & (F.abs(F.col("budget") - F.col("target_weight") / F.col("live") * F.col("whole")) <= F.col("n_live"))
    kept = F.coalesce("most_uses", F.lit(0)) <= F.col("max_repeats")
    return rows.select("source", F.coalesce("n_records", F.lit(0)).alias("n_records"), kept.alias("repeats_kept"), F.when(F.col("have_tokens") > 0, met).alias("share_met"))


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares, "p9_rules": p9_rules}
ORACLES = {
    "p9_rules": """SELECT t.source, count(d.text) AS n_records, true AS repeats_kept, CASE WHEN count(d.text) > 0 THEN true END AS share_met
FROM mix_targets t LEFT JOIN (SELECT lower(trim(source)) AS s, text FROM documents WHERE text <> '') d ON d.s = t.source GROUP BY 1"""
}
