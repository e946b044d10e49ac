"""A typed property graph as one DataFrame per node label and edge type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.functions import text as T
from casemill.operators import extractions as X
from casemill.operators.records import one_per_key
from casemill.plans.durable import durable
from casemill.queries.orphans import cited_id
from casemill.tables import absent_if_blank, table, utc_stamp


class CaseGraph:
    """Nodes and edges over the tables in a folder. Every frame is distinct by its key.

    Frames are lazy; with ``keep`` those that others build on are written once, for plans that use them in many places.
    Attorneys come from the table ``attorneys`` (docket_id, contact_raw) if one is given, else from the contact blocks of
    the parties.
    """

    def __init__(self, spark, sf_dir: str, keep: bool = False, attorneys: DataFrame | None = None):
        self.read = lambda name: table(spark, sf_dir, name)
        self._kept: dict[str, DataFrame] | None = {} if keep else None
        self._attorneys = attorneys

    def _once(self, name: str, make) -> DataFrame:
        if self._kept is None:
            return make()
        if name not in self._kept:
            self._kept[name] = durable(make(), name)
        return self._kept[name]

    # nodes
    def cases(self) -> DataFrame:
        return self._once("cases", self._cases)

    def _cases(self) -> DataFrame:
        """The last scrape of each docket, with its most confident label and whether a valid extraction exists."""
        rows = one_per_key(self.read("cases"), ["docket_id"], F.desc_nulls_last(utc_stamp("scraped_at")), F.desc_nulls_last("assigned_to_str"), F.desc_nulls_last("case_name"))
        labels = one_per_key(self.read("case_labels"), ["docket_id"], F.desc_nulls_last("label_confidence"), F.asc_nulls_last("outcome_label"), F.asc_nulls_last("opinion_id"))
        runs = self.valid_runs().select("docket_id").distinct().withColumn("has_irac", F.lit(True))
        joined = rows.join(labels.select("docket_id", "outcome_label", "procedural_stage"), "docket_id", "left").join(runs, "docket_id", "left")
        return joined.select("docket_id", "case_name", "court_id", "date_filed", "cause", "assigned_to_str", "outcome_label", "procedural_stage", F.coalesce("has_irac", F.lit(False)).alias("has_irac"))

    def valid_runs(self) -> DataFrame:
        return self._once("runs", lambda: X.valid(self.read("irac_extractions"), X.LINKS))

    def opinions(self) -> DataFrame:
        """Opinions of the tables, and placeholders for those only cited."""
        own = self.read("opinions").groupBy("opinion_id").agg(F.min("docket_id").alias("docket_id"), F.min(absent_if_blank("cluster_date_filed")).alias("date_filed")).withColumn("internal", F.lit(True))
        outside = self.cited().select(F.col("dst").alias("opinion_id")).distinct().join(own, "opinion_id", "left_anti")
        return own.unionByName(outside.withColumn("internal", F.lit(False)), allowMissingColumns=True)

    def cited(self) -> DataFrame:
        return self.read("citation_edges").select(F.col("source_opinion_id").alias("src"), cited_id("cited_opinion_url").alias("dst")).where("dst is not null").distinct()

    def statutes(self) -> DataFrame:
        return self.charged_under().select("statute").distinct()

    def arguments(self) -> DataFrame:
        """Distinct arguments; the first text and side seen, by run, side and position."""
        rows = self._argument_rows()
        first = F.struct("id", F.when(F.col("side") == "plaintiff", 0).otherwise(1).alias("s"), "position")
        return rows.groupBy("text_hash").agg(F.min_by("text", first).alias("text"), F.min_by("side", first).alias("side"), F.count("*").alias("n_uses"))

    def _argument_rows(self) -> DataFrame:
        rows = X.argument_rows(self.valid_runs()).withColumn("text_hash", T.argument_hash("text"))
        return rows.where(T.normalize_argument("text") != "")

    def judges(self) -> DataFrame:
        return self.decided_by().select("judge").distinct()

    def companies(self) -> DataFrame:
        return self.defendant_is().select("company").distinct()

    def firms(self) -> DataFrame:
        return self.represented_by().select("firm").distinct()

    # edges
    def has_opinion(self) -> DataFrame:
        return self._once("has_opinion", self._has_opinion)

    def _has_opinion(self) -> DataFrame:
        return self.read("opinions").select("docket_id", "opinion_id").distinct().join(self.cases().select("docket_id"), "docket_id", "left_semi")

    def cites(self) -> DataFrame:
        """Citations of which both ends are nodes."""
        return self._once("cites", self._cites)

    def _cites(self) -> DataFrame:
        return self.cited().join(self.read("opinions").select(F.col("opinion_id").alias("src")).distinct(), "src", "left_semi")

    def charged_under(self) -> DataFrame:
        causes = self.cases().select("docket_id", F.col("cause").alias("s"))
        named = self.valid_runs().select("docket_id", F.explode("x.statutes_cited").alias("s"))
        both = causes.unionByName(named).select("docket_id", T.normalize_statute("s").alias("statute"))
        return both.where("statute <> ''").distinct()

    def involves(self) -> DataFrame:
        """Case to argument; of several uses in a case the last one's sign and side count."""
        return self._once("involves", self._involves)

    def _involves(self) -> DataFrame:
        rows = self._argument_rows().withColumn("sign", sign(F.col("outcome"), F.col("side")))
        last = F.struct("id", F.when(F.col("side") == "plaintiff", 0).otherwise(1).alias("s"), "position")
        return rows.groupBy("docket_id", "text_hash").agg(F.max_by("sign", last).alias("sign"), F.max_by("side", last).alias("side"))

    def decided_by(self) -> DataFrame:
        """Authors of a docket's opinions; the assigned judge only where no opinion has an author."""
        authors = self.read("opinions").select("docket_id", T.normalize_name(absent_if_blank("author_str")).alias("judge")).where("judge <> ''").distinct()
        assigned = self.cases().select("docket_id", T.normalize_name(absent_if_blank("assigned_to_str")).alias("judge")).where("judge <> ''")
        return authors.unionByName(assigned.join(authors, "docket_id", "left_anti")).distinct()

    def defendant_is(self) -> DataFrame:
        rows = self.read("parties").where(F.col("party_type").ilike("%defendant%")).select("docket_id", T.normalize_name(absent_if_blank("name")).alias("company"))
        return rows.where("company <> ''").distinct()

    def represented_by(self) -> DataFrame:
        """Docket to firm, with the side of the docket's first party."""
        attorneys = self._attorneys if self._attorneys is not None else self.read("parties").select("docket_id", F.col("extra_info").alias("contact_raw"))
        return represented_by(attorneys, self.read("parties")).where("docket_id is not null")

    def nodes(self) -> dict[str, DataFrame]:
        return {"Case": self.cases(), "Opinion": self.opinions(), "Statute": self.statutes(), "Argument": self.arguments(), "Judge": self.judges(), "Company": self.companies(), "Firm": self.firms()}

    def edges(self) -> dict[str, DataFrame]:
        return {"HAS_OPINION": self.has_opinion(), "CITES": self.cites(), "CHARGED_UNDER": self.charged_under(), "INVOLVES": self.involves(), "DECIDED_BY": self.decided_by(), "DEFENDANT_IS": self.defendant_is(), "REPRESENTED_BY": self.represented_by()}


def sign(outcome, side):
    """1 if the side that argued prevailed, -1 if it lost, 0 if neither did. Any side but the plaintiff's is the other one."""
    mine = side == "plaintiff"
    return F.when(outcome == "PLAINTIFF_WINS", F.when(mine, 1).otherwise(-1)).when(outcome == "DEFENDANT_WINS", F.when(mine, -1).otherwise(1)).otherwise(0)


def represented_by(attorneys: DataFrame, parties: DataFrame) -> DataFrame:
    """(docket_id, firm, side): firms in contact blocks; the side is that of the docket's first party by id."""
    firms = attorneys.select("docket_id", F.lower(T.squeeze(T.firm_name("contact_raw"))).alias("firm")).where("firm is not null").distinct()
    side = parties.groupBy("docket_id").agg(F.min_by(F.when(F.col("party_type").contains("Defendant"), "defendant").otherwise("plaintiff"), "party_id").alias("side"))
    return firms.join(side, "docket_id", "left")


def counts(frames: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each frame."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, df in frames.items()])


def neighbours(cites: DataFrame) -> DataFrame:
    """Both directions of each link: (src, dst, edge), without links to oneself."""
    e = cites.where("src <> dst").withColumn("edge", F.struct("src", "dst"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge"))


def within_two(starts: DataFrame, cites: DataFrame) -> DataFrame:
    """(start, opinion_id, distance 1 or 2) over links in either direction, no link used twice, never back at the start.

    starts: a column ``start`` of opinions. The first hop is reduced to the starts' links before the second is joined.
    """
    both = neighbours(cites)
    one = starts.select(F.col("start").alias("src")).distinct().join(both, "src")
    hop1 = one.select(F.col("src").alias("start"), F.col("dst").alias("opinion_id"), F.lit(1).alias("distance")).distinct()
    second = both.select(F.col("src").alias("mid"), F.col("dst").alias("opinion_id"), F.col("edge").alias("edge2"))
    hop2 = one.select(F.col("src").alias("start"), F.col("dst").alias("mid"), "edge").distinct().join(second, "mid").where("edge <> edge2 and opinion_id <> start")
    hop2 = hop2.select("start", "opinion_id", F.lit(2).alias("distance")).distinct()
    return hop1.unionByName(hop2).groupBy("start", "opinion_id").agg(F.min("distance").alias("distance"))


def chains_of_three(cites: DataFrame) -> DataFrame:
    """(opinion_id, n): chains a, b, c of distinct links a to b and b to c with a unlike c, counted by a.

    A link to b goes on over each of b's links but one back to a, so degrees and reciprocal links give the count: no path
    is formed, and a much cited opinion costs no more than its links.
    """
    out = cites.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("n"))
    back = cites.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("back"))
    ends = cites.join(out, "dst").join(back, ["src", "dst"], "left")
    return ends.groupBy(F.col("src").alias("opinion_id")).agg(F.sum(F.col("n") - F.coalesce("back", F.lit(0))).alias("n")).where("n > 0")


def chain_sample(cites: DataFrame, most: int = 10) -> DataFrame:
    """(a, b, c): the first ``most`` chains in order of their opinions, from the first links that can hold them.

    A link gives a chain unless it leads nowhere or only back, so the first ``most`` of the others suffice; each is
    followed over at most most + 1 links.
    """
    sources = cites.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("n"))
    back = cites.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("back"))
    going = cites.join(sources, "dst").join(back, ["src", "dst"], "left").where(F.col("n") > F.coalesce("back", F.lit(0)))
    first = going.select(F.col("src").alias("a"), F.col("dst").alias("b")).orderBy("a", "b").limit(most)
    on = cites.select(F.col("src").alias("b"), F.col("dst").alias("c")).join(F.broadcast(first.select("b").distinct()), "b")  # most rows
    few = on.withColumn("_n", F.row_number().over(Window.partitionBy("b").orderBy("c"))).where(F.col("_n") <= most + 1).drop("_n")
    return first.join(few, "b").where("a <> c").select("a", "b", "c").orderBy("a", "b", "c").limit(most)
