"""Landed JSON of dockets, searches and filings as tables, and the sinks of the exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.functions.text import extension, first_text, squeeze

DOCKET = "id long, court_id string, case_name string, docket_number string, date_filed string, date_terminated string, cause string, nature_of_suit string, assigned_to_str string, idb_data struct<disposition:int,judgment:int,monetary_demand:double>"
CLUSTERS = "docket_id long, id long, date_filed string, precedential_status string, sub_opinions array<struct<id:long,type:string,author_str:string,plain_text:string,html_with_citations:string,html:string,xml_harvard:string,opinions_cited:array<string>>>"
PARTIES = "docket_id long, id long, name string, party_types array<struct<docket_id:long,name:string,date_terminated:string>>, attorneys array<struct<id:long,name:string,contact_raw:string,phone:string,fax:string,email:string,roles:array<int>>>"


def read_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed pages of a paginated endpoint: files with an object of ``results``, or with plain rows; bad files give no rows."""
    paged = spark.read.schema(f"results array<struct<{_struct(schema)}>>").option("multiLine", True).json(path)
    return paged.select(F.inline("results"))


def _struct(schema: str) -> str:
    depth, out, field = 0, [], ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = field.strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            field = ""
        else:
            field += c
    return ",".join(out)


def dockets(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("docket_id"), "case_name", "docket_number", "court_id", "cause", "nature_of_suit", "date_filed", "date_terminated", "assigned_to_str", F.col("idb_data.disposition").alias("idb_disposition"), F.col("idb_data.judgment").alias("idb_judgment"), F.col("idb_data.monetary_demand").alias("idb_monetary_demand"))


def opinions(clusters: DataFrame) -> DataFrame:
    """A row per opinion of each cluster, with the first text that isn't empty."""
    one = clusters.select("docket_id", F.col("id").alias("cluster_id"), F.col("date_filed").alias("cluster_date_filed"), "precedential_status", F.explode("sub_opinions").alias("o"))
    text = first_text("o.plain_text", "o.html_with_citations", "o.html", "o.xml_harvard")
    return one.select(F.col("o.id").alias("opinion_id"), "docket_id", "cluster_id", text.alias("plain_text"), "o.type", "o.author_str", "cluster_date_filed", "precedential_status")


def citation_edges(clusters: DataFrame) -> DataFrame:
    return clusters.select(F.explode("sub_opinions").alias("o")).select(F.col("o.id").alias("source_opinion_id"), F.explode("o.opinions_cited").alias("cited_opinion_url")).distinct()


def parties(rows: DataFrame) -> DataFrame:
    """A row per role of a party in its own docket; roles in other dockets are left out."""
    one = rows.select("docket_id", F.col("id").alias("party_id"), "name", F.explode_outer("party_types").alias("t"))
    return one.where("t is null or t.docket_id = docket_id").select("docket_id", "party_id", "name", F.col("t.name").alias("party_type"), F.col("t.date_terminated").alias("date_terminated"))


def attorneys(rows: DataFrame) -> DataFrame:
    one = rows.select("docket_id", F.explode("attorneys").alias("a"))
    return one.select("docket_id", F.col("a.id").alias("attorney_id"), "a.name", "a.contact_raw", "a.phone", "a.fax", "a.email", "a.roles").dropDuplicates(["docket_id", "attorney_id"])


def filings(submissions: DataFrame, forms: list[str], most: int | None = None) -> DataFrame:
    """Rows from parallel arrays (form, accessionNumber, filingDate, primaryDocument), of the given forms, the first ``most`` if given."""
    zipped = submissions.select(F.posexplode(F.arrays_zip("form", "accessionNumber", "filingDate", "primaryDocument")).alias("n", "f")).select("n", "f.*")
    found = zipped.where(F.col("form").isin(forms)).orderBy("n")
    return found.limit(most) if most else found


def zipped(df: DataFrame, key: str, arrays: list[str], most: int | None = None) -> DataFrame:
    """(key, n, one column per array): parallel arrays as rows, position from 0; shorter arrays end in nulls."""
    rows = df.select(key, F.posexplode(F.arrays_zip(*arrays)).alias("n", "z")).select(key, "n", "z.*")
    return rows.where(F.col("n") < most) if most else rows


def manifest(files: DataFrame, column: str = "name", most: int = 20) -> DataFrame:
    """(extension, n, names): how many files have an extension, and the first ``most`` of their names."""
    rows = files.select(extension(column).alias("extension"), F.col(column).alias("name"))
    w = Window.partitionBy("extension").orderBy("name")
    first = rows.withColumn("i", F.row_number().over(w)).where(F.col("i") <= most).groupBy("extension").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return rows.groupBy("extension").agg(F.count("*").alias("n")).join(first, "extension")


def trimmed_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, every cell stripped."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(*[F.trim(F.col(c)).alias(c) for c in df.columns])


def split_fields(df: DataFrame, columns: list[str], separator: str = ";") -> DataFrame:
    """Joined fields as arrays of stripped values without empty ones."""
    cut = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), separator), lambda x: squeeze(x)), lambda x: x != "")
    return df.select(*[cut(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
