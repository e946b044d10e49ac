"""Hard checks of an analysis; each gives rows (docket_id, name, severity, subject)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The circuit of each court id.
CIRCUITS = {
    "ca1": "ca1", "mad": "ca1", "med": "ca1", "nhd": "ca1", "prd": "ca1", "rid": "ca1", "mab": "ca1",
    "ca2": "ca2", "ctd": "ca2", "nyed": "ca2", "nynd": "ca2", "nysd": "ca2", "nywd": "ca2", "nysb": "ca2", "vtd": "ca2",
    "ca3": "ca3", "ded": "ca3", "njd": "ca3", "paed": "ca3", "pamd": "ca3", "pawd": "ca3", "paeb": "ca3", "vid": "ca3",
    "ca4": "ca4", "mdd": "ca4", "nced": "ca4", "ncmd": "ca4", "ncwd": "ca4", "scd": "ca4", "vaed": "ca4", "vawd": "ca4", "wvnd": "ca4", "wvsd": "ca4",
    "ca5": "ca5", "laed": "ca5", "lamd": "ca5", "lawd": "ca5", "msnd": "ca5", "mssd": "ca5", "txed": "ca5", "txnd": "ca5", "txsd": "ca5", "txwd": "ca5",
    "ca6": "ca6", "kyed": "ca6", "kywd": "ca6", "mied": "ca6", "miwd": "ca6", "ohnd": "ca6", "ohsd": "ca6", "tned": "ca6", "tnmd": "ca6", "tnwd": "ca6",
    "ca7": "ca7", "ilnd": "ca7", "ilsd": "ca7", "ilcd": "ca7", "innd": "ca7", "insd": "ca7", "wied": "ca7", "wiwd": "ca7",
    "ca8": "ca8", "ared": "ca8", "arwd": "ca8", "iaed": "ca8", "iand": "ca8", "iasd": "ca8", "mnd": "ca8", "moed": "ca8", "mowd": "ca8", "ned": "ca8", "ndd": "ca8", "sdd": "ca8",
    "ca9": "ca9", "akd": "ca9", "azd": "ca9", "cacd": "ca9", "cand": "ca9", "casd": "ca9", "caed": "ca9", "hid": "ca9", "idd": "ca9", "mtd": "ca9", "nvd": "ca9", "ord": "ca9", "waed": "ca9", "wawd": "ca9",
    "ca10": "ca10", "cod": "ca10", "ksd": "ca10", "nmd": "ca10", "oknd": "ca10", "oked": "ca10", "okwd": "ca10", "utd": "ca10", "wyd": "ca10",
    "ca11": "ca11", "almd": "ca11", "alnd": "ca11", "alsd": "ca11", "flmd": "ca11", "flnd": "ca11", "flsd": "ca11", "gamd": "ca11", "gand": "ca11", "gasd": "ca11",
    "cadc": "cadc", "dcd": "cadc",
    "scotus": "scotus",
}


def circuit(court):
    """The circuit of a court id; null for other courts."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in CIRCUITS.items() for x in pair]), court)


def _inside(small: DataFrame, large: DataFrame, grams: int) -> DataFrame:
    """(x, y): non-empty values x of ``small`` that lie in values y of ``large``, each a distinct column v.

    No cross join: if x lies in y, the first n letters of x are among the n-grams of y, where n is ``grams`` or the
    length of x if that is less.
    """
    size = F.least(F.length("v"), F.lit(grams))
    heads = small.where("v <> ''").select(F.col("v").alias("x"), F.substring(F.col("v"), F.lit(1), size).alias("g"))
    widths = F.broadcast(heads.select(F.length("g").alias("n")).distinct())  # at most `grams` rows
    starts = F.sequence(F.lit(1), F.length("v") - F.col("n") + 1)
    parts = large.join(widths, F.length("v") >= F.col("n")).withColumn("i", F.explode(starts)).select(F.col("v").alias("y"), F.expr("substring(v, i, n)").alias("g")).distinct()
    return heads.join(parts, "g").where(F.contains("y", "x")).select("x", "y").distinct()


def contained_either_way(left: DataFrame, right: DataFrame, grams: int = 8) -> DataFrame:
    """Distinct values of ``left`` (one column v) that contain, or are contained in, a value of ``right``.

    An empty value lies in every other, and a null in none.
    """
    a, b = left.toDF("v").where("v is not null").distinct(), right.toDF("v").where("v is not null").distinct()
    found = _inside(a, b, grams).select("x").union(_inside(b, a, grams).select("y"))
    everything = a.limit(0) if b.isEmpty() else a.where("v = ''") if b.where("v = ''").isEmpty() else a
    return found.union(everything).distinct().toDF("v")


def both_parties_in(cited: DataFrame, known: DataFrame, letters: int = 8) -> DataFrame:
    """Distinct names (one column name) of the form "a v. b" such that the starts of both a and b lie in one known name.

    Upper and lower case don't matter. The starts are ``letters`` long; a shorter party is taken whole.
    """
    parts = F.split(F.col("name"), r"(?i)\s+v\.?\s+", 2)
    start = lambda i: F.substring(F.lower(F.trim(parts[i])), 1, letters)
    asked = cited.toDF("name").where(F.size(parts) == 2).select("name", start(0).alias("a"), start(1).alias("b")).distinct()
    names = known.toDF("v").select(F.lower("v").alias("v")).distinct()
    hits = _inside(asked.select(F.col("a").alias("v")).distinct(), names, letters).toDF("a", "y")
    first = asked.join(hits, "a").where(F.contains("y", "b")).select("name")
    bare = _inside(asked.where("a = ''").select(F.col("b").alias("v")).distinct(), names, letters).select(F.col("x").alias("b")).distinct()
    return first.union(asked.where("a = ''").join(bare, "b").select("name")).distinct()


def rows(df: DataFrame, name: str, severity: str, subject) -> DataFrame:
    return df.select("docket_id", F.lit(name).alias("name"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"))


def unknown_names(cited: DataFrame, known: DataFrame, key) -> DataFrame:
    """Citations (docket_id, name) that match no known name (one column).

    A name matches if, after ``key``, it contains a known one or is contained in it, or if the starts of both its
    parties lie in one. A name of which ``key`` leaves nothing matches none.
    """
    keyed = cited.where("name is not null").withColumn("v", key(F.col("name")))
    good = contained_either_way(keyed.select("v").where("v <> ''"), known.select(key(F.col(known.columns[0])).alias("v")))
    rest = keyed.join(good, "v", "left_anti")
    parties = both_parties_in(rest.where("v <> ''").select("name"), known)
    return rows(rest.join(parties, "name", "left_anti"), "citation_check", "ERROR", F.col("name"))


def ungrounded(cited: DataFrame, known: DataFrame, key) -> DataFrame:
    """Statutes (docket_id, statute) that aren't, contain, or lie in any of the vocabulary; blank ones are skipped."""
    keyed = cited.withColumn("v", key(F.col("statute"))).where("v <> ''")
    vocabulary = known.select(key(F.col(known.columns[0])).alias("v")).distinct()
    rest = keyed.join(vocabulary, "v", "left_anti")
    good = contained_either_way(rest.select("v"), vocabulary)
    return rows(rest.join(good, "v", "left_anti"), "statute_grounding", "WARNING", F.col("statute"))


def not_binding(pairs: DataFrame) -> DataFrame:
    """Citations (docket_id, court_id, cited_docket, cited_court) of another circuit that isn't the supreme court's."""
    mine, other = circuit(F.col("court_id")), circuit(F.col("cited_court"))
    return rows(pairs.where(mine.isNotNull() & other.isNotNull() & (other != "scotus") & (mine != other)), "binding_authority", "WARNING", F.col("cited_docket"))


def too_late(pairs: DataFrame) -> DataFrame:
    """Citations (docket_id, date, cited_docket, cited_date) of later cases; ISO dates compare as text, absent ones never."""
    return rows(pairs.where((F.col("date") != "") & (F.col("cited_date") != "") & (F.col("cited_date") > F.col("date"))), "temporal_validity", "ERROR", F.col("cited_docket"))


def contested(scores: DataFrame, threshold: float = 0.1) -> DataFrame:
    return rows(scores.where(F.abs("score") <= threshold), "ambiguity_flag", "INFO", F.col("subject"))


def missing_elements(elements: DataFrame) -> DataFrame:
    return rows(elements.where("status = 'NOT_ANALYZED'"), "missing_element", "WARNING", F.col("element"))


def rates(violations: DataFrame, n_cases: int) -> DataFrame:
    """Violations, cases with any, and their share of all cases, by check."""
    counted = violations.groupBy("name", "severity").agg(F.count("*").alias("n"), F.countDistinct("docket_id").alias("n_dockets"))
    return counted.select("name", "severity", "n", "n_dockets", F.round(F.col("n_dockets") / F.lit(n_cases), 6).alias("share"))


def all_of(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
