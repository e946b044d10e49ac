"""Queries of the nearest vectors."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm.nearest import knn, usable
from casemill.tables import table

MODEL, WIDTH = "lexvec-base-768", 768


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "opinion_embeddings").where((F.col("model_name") == MODEL) & (F.size("embedding") == WIDTH))
    return usable(rows, "opinion_id", "embedding", "created_at")


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five opinions with the most similar vectors of every opinion."""
    return knn(_vectors(spark, d)).select(F.col("key").alias("opinion_id"), F.col("neighbour").alias("neighbour_id"), "rank", F.round("cosine", 8).alias("cosine"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("opinion_id"), F.col("neighbour_id")
    return p3_neighbours(spark, d).select(F.least(a, b).alias("opinion_id_a"), F.greatest(a, b).alias("opinion_id_b")).distinct()


QUERIES = {"p3_found": p3_found, "p3_neighbours": p3_neighbours}
# brute force: all pairs of vectors, which DuckDB does at the size of the SQL check; the search itself is exact there
ORACLES = {
    "p3_found": """WITH u AS (SELECT opinion_id, max_by(e, struct_pack(a := created_at, b := e)) AS v FROM (SELECT opinion_id, created_at, CAST(embedding AS DOUBLE[]) AS e FROM opinion_embeddings
  WHERE model_name = 'lexvec-base-768' AND len(embedding) = 768) WHERE len(list_filter(e, lambda x: isnan(x) OR x IS NULL)) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0 GROUP BY 1),
h AS (SELECT a.opinion_id AS a, b.opinion_id AS b FROM u a JOIN u b ON a.opinion_id <> b.opinion_id QUALIFY row_number() OVER (PARTITION BY a.opinion_id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.opinion_id) <= 5)
SELECT DISTINCT least(a, b) AS opinion_id_a, greatest(a, b) AS opinion_id_b FROM h""",
    "p3_neighbours": """WITH u AS (SELECT opinion_id, max_by(e, struct_pack(a := created_at, b := e)) AS v FROM (SELECT opinion_id, created_at, CAST(embedding AS DOUBLE[]) AS e FROM opinion_embeddings
  WHERE model_name = 'lexvec-base-768' AND len(embedding) = 768) WHERE len(list_filter(e, lambda x: isnan(x) OR x IS NULL)) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0 GROUP BY 1),
h AS (SELECT a.opinion_id, b.opinion_id AS neighbour_id, list_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.opinion_id <> b.opinion_id)
SELECT opinion_id, neighbour_id, row_number() OVER (PARTITION BY opinion_id ORDER BY c DESC, neighbour_id) AS rank, round(c, 8) AS cosine FROM h QUALIFY rank <= 5""",
}
