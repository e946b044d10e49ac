"""Queries of the pieces."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.llm.pieces import LIMIT, OVERLAP, split_pieces, word_offsets
from casemill.tables import table


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return split_pieces(table(spark, d, "opinions"), "opinion_id", "plain_text", repeats=True, with_text=False).where("piece_no = 1").select("opinion_id", "cut").distinct()


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every opinion over the limit, with its text."""
    return split_pieces(table(spark, d, "opinions"), "opinion_id", "plain_text")


def p7_levels(spark: SparkSession, d: str) -> DataFrame:
    """Pieces and characters by the level at which they end."""
    pieces = split_pieces(table(spark, d, "opinions"), "opinion_id", "plain_text", with_text=False)
    return pieces.groupBy("level").agg(F.count("*").alias("n_pieces"), F.sum(F.col("end_pos") - F.col("start_pos") + 1).alias("n_chars"))


def p7_rules(spark: SparkSession, d: str) -> DataFrame:
    """Per opinion over the limit, whether its pieces obey: none over 10,000 characters, each beginning 200 before the last one's end, all covered."""
    pieces = split_pieces(table(spark, d, "opinions"), "opinion_id", "plain_text", with_text=False)
    before = F.lag("end_pos").over(Window.partitionBy("opinion_id").orderBy("piece_no"))
    rows = pieces.withColumn("fits", F.col("end_pos") - F.col("start_pos") < LIMIT).withColumn("joins", F.col("start_pos") == F.coalesce(before - OVERLAP + 1, F.lit(1)))
    return rows.groupBy("opinion_id").agg(F.max("end_pos").cast("long").alias("n_chars"), F.bool_and("fits").alias("fits"), F.bool_and("joins").alias("joins"))


def p7_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of opinions over 2,000 words, counted by offsets per word: how many, and whether none is over the limit."""
    pieces = split_pieces(table(spark, d, "opinions"), "opinion_id", "plain_text", 2000, 40, sizes=word_offsets)
    words = F.size(F.split(F.trim(F.regexp_replace("piece", r"\s+", " ")), " "))
    return pieces.groupBy("opinion_id").agg(F.count("*").alias("n_pieces"), F.bool_and(words <= 2001).alias("fits"))


QUERIES = {"p7_rules": p7_rules, "p7_tokens": p7_tokens, "p7_found": p7_found, "p7_pieces": p7_pieces, "p7_levels": p7_levels}
ORACLES = {
    "p7_rules": "SELECT DISTINCT opinion_id, length(plain_text) AS n_chars, true AS fits, true AS joins FROM opinions WHERE length(plain_text) > 10000",
    "p7_found": r"""
WITH o AS (SELECT DISTINCT opinion_id, plain_text FROM opinions WHERE length(plain_text) > 10000),
l AS (SELECT opinion_id, plain_text, unnest(string_split(plain_text, chr(10))) AS line, generate_subscripts(string_split(plain_text, chr(10)), 1) AS i FROM o),
g AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13) || chr(160)) = '' AS blank FROM l),
p AS (SELECT *, count_if(blank) OVER (PARTITION BY opinion_id, hash(plain_text) ORDER BY i) AS par FROM g),
pars AS (SELECT opinion_id, hash(plain_text) AS h, par, sum(length(line) + 1) - 1 AS n FROM p WHERE NOT blank GROUP BY 1, 2, 3),
lines AS (SELECT opinion_id, hash(plain_text) AS h, max(length(line)) AS n FROM l GROUP BY 1, 2),
words AS (SELECT opinion_id, hash(plain_text) AS h, list_max(list_transform(string_split_regex(plain_text, '\s+'), lambda w: length(w))) AS n FROM o),
m AS (SELECT opinion_id, h, max(n) AS n FROM pars GROUP BY 1, 2)
SELECT DISTINCT opinion_id, CASE WHEN m.n <= 10000 THEN 'paragraph' WHEN lines.n <= 10000 THEN 'line' WHEN words.n <= 10000 THEN 'word' ELSE 'none' END AS cut
FROM m JOIN lines USING (opinion_id, h) JOIN words USING (opinion_id, h)"""
}
