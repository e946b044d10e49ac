"""Queries of the names."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm.names import link, linked_pairs
from casemill.plans.durable import durable
from casemill.tables import table


def p2_entities(spark: SparkSession, d: str) -> DataFrame:
    """The entity of every party and judge: the links without their pairs."""
    parties = table(spark, d, "parties").select(F.lit("party").alias("kind"), F.col("party_id").alias("id"), "name")
    judges = table(spark, d, "cases").select(F.lit("judge").alias("kind"), F.col("docket_id").alias("id"), F.col("assigned_to_str").alias("name"))
    return link(parties.unionByName(judges), "id", "name", "kind")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = linked_pairs(durable(p2_entities(spark, d), "linked"), "id", "kind")
    return pairs.select("kind", F.col("a").alias("id_a"), F.col("b").alias("id_b"))


QUERIES = {"p2_found": p2_found, "p2_entities": p2_entities}
ORACLES = {}
