"""Queries of the sentences."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm.sentences import sentences
from casemill.tables import table


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "text")
    found = sentences(documents).select("doc_id", "start_pos", "end_pos")
    # sentences of one text are distinct: only a key that occurs again can repeat any
    again = documents.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    return found if again.isEmpty() else found.distinct()


def p10_cover(spark: SparkSession, d: str) -> DataFrame:
    """Characters but white space of every document, and of its sentences: none is lost and none is in two."""
    documents = table(spark, d, "documents").select("doc_id", "text").where("text is not null")
    solid = lambda c: F.length(F.regexp_replace(c, SPACE, "")).cast("long")
    spans = sentences(documents).groupBy("doc_id").agg(F.collect_list(F.struct("start_pos", "end_pos")).alias("s"))
    rows = documents.join(spans, "doc_id")
    inside = F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + solid(F.substring("text", x["start_pos"], x["end_pos"] - x["start_pos"] + 1)))
    return rows.select("doc_id", solid("text").alias("n_chars"), inside.alias("n_inside"))


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of every document with its number and text."""
    documents = table(spark, d, "documents").select("doc_id", "text")
    return sentences(documents).join(documents, "doc_id").withColumn("sentence", F.expr("substring(text, start_pos, end_pos - start_pos + 1)")).drop("text")


#: white space, spelled out so that both engines mean the same
SPACE = "[ \t\n\x0b\x0c\r\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
QUERIES = {"p10_found": p10_found, "p10_sentences": p10_sentences, "p10_cover": p10_cover}
ORACLES = {"p10_cover": f"SELECT doc_id, n AS n_chars, n AS n_inside FROM (SELECT doc_id, length(regexp_replace(text, '{SPACE}', '', 'g')) AS n FROM documents WHERE text IS NOT NULL) WHERE n > 0"}
