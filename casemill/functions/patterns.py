"""Labelling texts by ordered pattern lists: the first pattern of a list that occurs wins, not the first in the text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from casemill.functions.text import _c

# Fixed values: (name, pattern, confidence) in order of precedence.
MIXED = [
    ("mixed_granted_denied_in_part", r"(?i)granted\s+in\s+part\s+(?:and\s+)?denied\s+in\s+part", 0.85),
    ("mixed_denied_granted_in_part", r"(?i)denied\s+in\s+part\s+(?:and\s+)?granted\s+in\s+part", 0.85),
    ("mixed_affirm_reverse_in_part", r"(?i)affirm(?:ed)?\s+in\s+part\s+(?:and\s+)?revers(?:ed|e)\s+in\s+part", 0.85),
    ("mixed_reverse_affirm_in_part", r"(?i)revers(?:ed|e)\s+in\s+part\s+(?:and\s+)?affirm(?:ed)?\s+in\s+part", 0.85),
]
DEFENDANT = [
    ("def_mtd_granted", r"(?i)motion\s+to\s+dismiss\s+is\s+(?:hereby\s+)?granted", 0.9),
    ("def_complaint_dismissed", r"(?i)complaint\s+is\s+(?:hereby\s+)?dismissed", 0.9),
    ("def_dismissed_with_prejudice", r"(?i)dismissed\s+with\s+prejudice", 0.85),
    ("def_affirm_dismissal", r"(?i)(?:we|the\s+court)\s+affirm(?:s)?\s+(?:the\s+)?(?:district\s+court.s?\s+)?(?:judgment\s+of\s+)?dismiss", 0.85),
    ("def_affirm_grant", r"(?i)(?:we|the\s+court)\s+affirm(?:s)?\s+(?:the\s+)?(?:district\s+court.s?\s+)?(?:grant|order)", 0.75),
    ("def_dismissal_affirmed", r"(?i)(?:the\s+)?dismissal\s+(?:of\s+.*?\s+)?is\s+(?:hereby\s+)?affirmed", 0.85),
    ("def_sj_granted_for_def", r"(?i)summary\s+judgment\s+(?:is\s+)?(?:hereby\s+)?granted\s+(?:in\s+favor\s+of\s+)?(?:the\s+)?defendants?", 0.9),
    ("def_sj_granted_generic", r"(?i)(?:defendants?'?\s+)?(?:motion\s+for\s+)?summary\s+judgment\s+(?:is\s+)?(?:hereby\s+)?granted", 0.75),
    ("def_district_court_affirmed", r"(?i)(?:judgment|decision|order)\s+(?:of\s+the\s+district\s+court\s+)?is\s+(?:hereby\s+)?affirmed", 0.7),
]
PLAINTIFF = [
    ("plt_mtd_denied", r"(?i)motion\s+to\s+dismiss\s+is\s+(?:hereby\s+)?denied", 0.9),
    ("plt_sj_denied", r"(?i)(?:defendants?'?\s+)?(?:motion\s+for\s+)?summary\s+judgment\s+(?:is\s+)?(?:hereby\s+)?denied", 0.9),
    ("plt_reversed_and_remanded", r"(?i)reversed?\s+and\s+remanded", 0.85),
    ("plt_we_reverse", r"(?i)(?:we|the\s+court)\s+(?:hereby\s+)?reverse", 0.85),
    ("plt_dismissal_reversed", r"(?i)(?:the\s+)?dismissal\s+.*?is\s+(?:hereby\s+)?reversed", 0.85),
    ("plt_standalone_reversed", r"\bREVERSED\b", 0.8),
    ("plt_vacated_and_remanded", r"(?i)vacate[ds]?\s+and\s+remand(?:ed)?", 0.8),
]
AFFIRMED = r"(?im)(?:is|are)\s+(?:hereby\s+)?affirmed|(?:\bAFFIRMED\b\.?\s*$)"
#: what the court below did, in lower-cased text
BELOW_DENIED = r"(?:district\s+court|lower\s+court).*?denied.*?motion\s+to\s+dismiss"
BELOW_GRANTED = r"(?:district\s+court|lower\s+court).*?(?:grant.*?motion\s+to\s+dismiss|dismiss|grant.*?summary\s+judgment)"
STAGES = {
    "APPEAL": [r"(?i)(?:we|this\s+court)\s+(?:affirm|reverse|vacate|remand)", r"(?i)on\s+appeal"],
    "TRIAL": [r"(?i)(?:jury|bench)\s+(?:trial|verdict)", r"(?i)after\s+(?:a\s+)?trial", r"(?i)the\s+jury\s+(?:found|returned|awarded)"],
    "SJ": [r"(?i)summary\s+judgment", r"(?i)Rule\s+56"],
    "MTD": [r"(?i)motion\s+to\s+dismiss", r"(?i)12\s*\(\s*b\s*\)\s*\(\s*6\s*\)", r"(?i)failure\s+to\s+state\s+a\s+claim"],
}
PARTY_CLASSES = [
    ("SEC", [r"(?i)^SEC\s+v\.", r"(?i)^S\.E\.C\.\s+v\.", r"(?i)Securities and Exchange Commission", r"(?i)Securities & Exchang"]),
    ("DOJ", [r"(?i)^United States\s+v\."]),
    ("SEC_APPEAL", [r"(?i)v\.\s+SEC\s*$", r"(?i)v\.\s+Securities and Exchange"]),
]


def any_of(c, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [_c(c).rlike(p) for p in patterns])


def first_class(c, classes: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """The first class of which a pattern occurs."""
    chosen = F.lit(otherwise)
    for name, patterns in reversed(classes):
        chosen = F.when(any_of(c, patterns), name).otherwise(chosen)
    return chosen


def first_hit(c, patterns: list[tuple[str, str, float]], with_text: bool = True) -> Column:
    """struct(name, confidence, matched) of the first pattern in list order; null if none occurs.

    matched: the hit with 30 characters around, at most 200 in all; left out, with its cost, unless ``with_text``.
    """
    c = _c(c)
    hit = F.lit(None)
    for name, p, confidence in reversed(patterns):
        fields = [F.lit(name).alias("name"), F.lit(confidence).alias("confidence")]
        if with_text:
            at, size = F.regexp_instr(c, F.lit(p)), F.length(F.regexp_substr(c, F.lit(p)))
            start = F.greatest(at - 30, F.lit(1))
            fields.append(F.substring(F.trim(F.substring(c, start, at + size + 30 - start)), 1, 200).alias("matched"))
        hit = F.when(c.rlike(p), F.struct(*fields)).otherwise(hit)
    return hit


def outcome(c, tail_chars: int = 2000) -> Column:
    """struct(label, source, confidence, pattern): the cascade over the end of a text and then over all of it.

    In each pass a mixed pattern wins; hits of both sides are a mixed co-occurrence; one side's hit is that side's;
    a bare "affirmed" is read by what the court below did. The second pass costs a fifth of the confidence.
    """
    c = _c(c)
    tail, low = F.right(c, F.lit(tail_chars)), F.lower(c)
    below_denied = low.rlike(BELOW_DENIED)

    def row(label, source, confidence, pattern):
        return F.struct(F.lit(label).alias("label"), F.lit(source).alias("source"), confidence.cast("double").alias("confidence"), pattern.alias("pattern"))

    def one_pass(text, source, factor, both, pattern_both, both_source):
        mixed, d, p = (first_hit(text, patterns, False) for patterns in (MIXED, DEFENDANT, PLAINTIFF))
        scaled = lambda x: F.round(x * factor, 4)
        return (
            F.when(mixed.isNotNull(), row("MIXED", source, scaled(mixed["confidence"]), mixed["name"]))
            .when(d.isNotNull() & p.isNotNull(), row("MIXED", both_source, F.lit(both), F.lit(pattern_both)))
            .when(d.isNotNull(), row("DEFENDANT_WINS", source, scaled(d["confidence"]), d["name"]))
            .when(p.isNotNull(), row("PLAINTIFF_WINS", source, scaled(p["confidence"]), p["name"]))
            .when(text.rlike(AFFIRMED) & below_denied, row("PLAINTIFF_WINS", source, scaled(F.lit(0.7)), F.lit("affirmed_disambiguated")))
            .when(text.rlike(AFFIRMED) & low.rlike(BELOW_GRANTED), row("DEFENDANT_WINS", source, scaled(F.lit(0.7)), F.lit("affirmed_disambiguated")))
            .when(text.rlike(AFFIRMED), row("DEFENDANT_WINS", source, scaled(F.lit(0.5)), F.lit("affirmed_disambiguated")))
        )

    return F.coalesce(
        one_pass(tail, "conclusion_regex", 1.0, 0.7, "both_in_tail", "conclusion_cooccurrence"),
        one_pass(c, "fulltext_regex", 0.8, 0.5, "both_in_fulltext", "fulltext_cooccurrence"),
        row("UNCLEAR", "no_signal", F.lit(0.0), F.lit("")),
    )


def stage(c, court) -> Column:
    """The latest procedural stage named; courts whose id begins with ca, and the supreme court, hear appeals."""
    c, court = _c(c), _c(court)
    chosen = F.lit(None).cast("string")
    for name in reversed(STAGES):
        found = any_of(c, STAGES[name])
        if name == "APPEAL":
            found = found | F.coalesce(court.startswith("ca") | (court == "scotus"), F.lit(False))
        chosen = F.when(found, name).otherwise(chosen)
    return chosen
