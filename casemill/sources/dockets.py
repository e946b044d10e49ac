"""One flat record per docket from its nested JSON, in one select; and an inventory of what endpoints delivered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.operators.profile import DISPOSITIONS, JUDGMENTS, decode, joined_distinct

DOCKET = """identifier string, case_name string, court string, date_filed string, date_terminated string, date_last_filing string, assigned_to_str string,
referred_to_str string, nature_of_suit string, cause string, absolute_url string, docket_number string, pacer_case_id string, jurisdiction_type string, jury_demand string,
idb_data struct<disposition:int,judgment:int,nature_of_judgement:int,procedural_progress:int,origin:int,monetary_demand:double,class_action:string,diversity_of_residence:string,
pro_se:int,arbitration_at_filing:string,arbitration_at_termination:string,county_of_residence:int,amount_received:double,section:string,subsection:string>,
parties array<struct<name:string,party_types:array<struct<name:string>>,attorneys:array<struct<name:string,phone:string,email:string,contact_raw:string>>>>,
docket_entries array<struct<entry_number:int,date_filed:string,description:string,recap_documents:array<struct<page_count:int,file_size:bigint,is_sealed:boolean,ocr_status:int>>>>"""


def joined(*parts: Column, separator: str = "; ") -> Column:
    """The non-empty parts as one text."""
    return F.concat_ws(separator, *[F.when(F.trim(p.cast("string")) != "", F.trim(p.cast("string"))) for p in parts])


def _named(role: str, *before: str) -> Column:
    """Names of parties in whose role the word occurs and none of the earlier ones does."""
    is_role = lambda t: F.coalesce(t["name"], F.lit("")).contains(role)

    def hits(p: Column) -> Column:
        roles = F.filter(F.coalesce(p["party_types"], F.array()), is_role)
        for b in before:
            roles = F.filter(roles, lambda t: ~t["name"].contains(b))  # noqa: B023
        return F.transform(roles, lambda t: p["name"])

    return F.array_join(F.flatten(F.transform(F.coalesce("parties", F.array()), hits)), "; ")


def records(dockets: DataFrame, base_url: str = "") -> DataFrame:
    """The flat record of each docket; every field is text, empty where the source has nothing."""
    idb = F.col("idb_data")
    disposition, judgment = decode(idb["disposition"], DISPOSITIONS), decode(idb["judgment"], JUDGMENTS)
    coded = lambda code, text: F.when(code.isNotNull(), F.concat(code.cast("string"), F.lit(" - "), text))
    nature = F.when(F.coalesce(idb["nature_of_judgement"], F.lit(0)) != 0, F.concat(judgment, F.lit(" (nature: "), idb["nature_of_judgement"].cast("string"), F.lit(")")))
    section = F.when(F.trim(idb["section"]) != "", F.concat(F.lit("Section "), F.trim(idb["section"]), F.when(F.trim(idb["subsection"]) != "", F.concat(F.lit("("), F.trim(idb["subsection"]), F.lit(")"))).otherwise("")))
    attorneys = F.flatten(F.transform(F.coalesce("parties", F.array()), lambda p: F.coalesce(p["attorneys"], F.array())))
    mine = F.filter(attorneys, lambda a: F.lower(F.coalesce(a["email"], F.lit(""))).contains("sec.gov") | F.coalesce(a["contact_raw"], F.lit("")).contains("Securities and Exchange"))
    office = F.filter(F.transform(mine, lambda a: F.regexp_extract(F.coalesce(a["contact_raw"], F.lit("")), r"Securities and Exchange Commission\s*\((\w+)\)", 1)), lambda o: o != "")
    entries = F.coalesce("docket_entries", F.array())
    documents = F.flatten(F.transform(entries, lambda e: F.coalesce(e["recap_documents"], F.array())))
    total = lambda f: F.aggregate(documents, F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(x[f].cast("bigint"), F.lit(0)))
    described = F.transform(F.slice(entries, 1, 200), lambda e: F.concat(F.lit("["), F.coalesce(e["entry_number"].cast("string"), F.lit("")), F.lit("|"), F.coalesce(e["date_filed"], F.lit("")), F.lit("] "), F.substring(F.coalesce(e["description"], F.lit("")), 1, 500)))
    any_sealed = F.exists(documents, lambda x: F.coalesce(x["is_sealed"], F.lit(False)))
    fields = {
        "case_title": F.col("case_name"), "court": F.col("court"), "date": F.col("date_filed"), "judges": joined(F.col("assigned_to_str"), F.col("referred_to_str")),
        "judgment_type": F.coalesce(nature, judgment), "outcome": disposition, "legal_topic": joined(F.col("nature_of_suit"), F.col("cause")),
        "charges_and_sections": joined(F.col("cause"), section), "case_status": F.when(F.coalesce("date_terminated", F.lit("")) != "", "Closed").otherwise("Open"),
        "complaint_filed_date": F.col("date_filed"), "judgment_date": F.col("date_terminated"),
        "source_url": F.when(F.coalesce("absolute_url", F.lit("")) != "", F.concat(F.lit(base_url), F.col("absolute_url"))).otherwise(F.col("identifier")),
        "petitioner": _named("Plaintiff"), "respondent": _named("Defendant", "Plaintiff"), "relief_defendants": _named("Relief", "Plaintiff", "Defendant"),
        "sec_attorneys": joined_distinct(F.transform(mine, lambda a: a["name"])), "sec_regional_office": F.get(office, F.lit(0)), "total_fine_amount": idb["amount_received"],
        "final_judgment_details": joined(F.concat(F.lit("Disposition: "), disposition), F.concat(F.lit("Judgment for: "), judgment), F.when(F.coalesce(idb["procedural_progress"], F.lit(0)) != 0, F.concat(F.lit("Procedural progress: "), idb["procedural_progress"].cast("string")))),
        "docket_number": F.col("docket_number"), "pacer_case_id": F.col("pacer_case_id"), "jurisdiction_type": F.col("jurisdiction_type"), "jury_demand": F.col("jury_demand"),
        "disposition_code": coded(idb["disposition"], disposition), "judgment_code": coded(idb["judgment"], judgment), "procedural_progress": idb["procedural_progress"], "case_origin": idb["origin"],
        "monetary_demand": idb["monetary_demand"], "class_action_flag": idb["class_action"], "diversity_of_residence": idb["diversity_of_residence"], "pro_se": idb["pro_se"],
        "arbitration_at_filing": idb["arbitration_at_filing"], "arbitration_at_termination": idb["arbitration_at_termination"], "county_of_residence": idb["county_of_residence"],
        "date_last_filing": F.col("date_last_filing"), "date_terminated": F.col("date_terminated"),
        "attorney_phone": joined_distinct(F.transform(attorneys, lambda a: a["phone"])), "attorney_email": joined_distinct(F.transform(attorneys, lambda a: a["email"])),
        "doc_page_count": total("page_count"), "doc_file_size": total("file_size"), "doc_is_sealed": F.when(any_sealed, "True").otherwise("False"),
        "docket_entry_text": F.array_join(described, " ||| "),
    }
    return dockets.select("identifier", *[F.coalesce(c.cast("string"), F.lit("")).alias(k) for k, c in fields.items()])


def inventory(keys: DataFrame, endpoints: dict[str, DataFrame], key: str = "docket_id") -> DataFrame:
    """(key, endpoint, status, n, filled): of each endpoint's rows per key, and its columns with any value.

    keys: the keys asked for. status: ``ok`` with rows, ``empty`` without. Wide rows are reduced per key first.
    """
    out = None
    for name, df in endpoints.items():
        columns = [c for c in df.columns if c != key]
        full = F.array_sort(F.array_compact(F.array(*[F.when(F.max(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""), c) for c in columns])))
        got = df.groupBy(key).agg(F.count("*").alias("n"), full.alias("filled"))
        part = keys.select(key).distinct().join(got, key, "left").select(key, F.lit(name).alias("endpoint"), F.when(F.col("n") > 0, "ok").otherwise("empty").alias("status"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("filled", F.array().cast("array<string>")).alias("filled"))
        out = part if out is None else out.unionByName(part)
    return out


def cited_by(hits: DataFrame) -> DataFrame:
    """(cluster_id, name, date, court, citation) of the cases that search hits say cite one."""
    return hits.select("cluster_id", F.explode("results").alias("h")).select("cluster_id", F.col("h.caseName").alias("name"), F.col("h.dateFiled").alias("date"), "h.court", "h.citation")


def best_hit(filtered: DataFrame, unfiltered: DataFrame, key: str = "query") -> DataFrame:
    """The first hit of each query by ``position``, of the filtered search if it has any, else of the other."""
    first = lambda df: df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), "position").alias("hit"))
    a, b = first(filtered), first(unfiltered)
    return a.unionByName(b.join(a, key, "left_anti")).select(key, "hit.*")
