"""Texts for reports and prompts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casemill.functions.text import _c


def interval(point, low, high, digits: int = 3) -> Column:
    """point [low, high] with fixed digits."""
    f = f"%.{digits}f"
    return F.format_string(f"{f} [{f}, {f}]", _c(point), _c(low), _c(high))


def brief(name, docket, court, outcome, score, final) -> Column:
    """One line on a precedent."""
    text = lambda c: F.coalesce(_c(c).cast("string"), F.lit("unknown"))
    return F.concat(F.lit("- "), text(name), F.lit(" (docket="), text(docket), F.lit(", court="), text(court), F.lit(", outcome="), text(outcome), F.format_string(", anco=%.2f, score=%.3f)", F.coalesce(_c(score), F.lit(0.0)), F.coalesce(_c(final), F.lit(0.0))))


def elements(x: Column, names: tuple[str, ...], most: int = 150) -> Column:
    """A line on each element of an extraction's map, with the start of its reasoning."""

    def line(n: str) -> Column:
        e = x["elements"][n]
        reason = F.substring(F.coalesce(e["judge_reasoning"], F.lit("")), 1, most)
        return F.when(e.isNotNull(), F.concat(F.lit(f"  {n}: "), F.coalesce(e["status"], F.lit("")), F.when(reason != "", F.concat(F.lit(" — "), reason)).otherwise("")))

    return F.array_join(F.filter(F.array(*map(line, names)), lambda v: v.isNotNull()), "\n")


def entries(items: Column, most: int = 200, width: int = 500) -> Column:
    """Docket entries (number, date, text) as one text: [number|date] text, in order."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    one = lambda e: F.concat(F.lit("["), blank(e["number"]), F.lit("|"), blank(e["date"]), F.lit("] "), F.substring(blank(e["text"]), 1, width))
    return F.array_join(F.transform(F.slice(items, 1, most), one), " ||| ")


def query_case(name, docket, x: Column, names: tuple[str, ...], facts: int = 2, listed: int = 5) -> Column:
    """The section of a prompt on the query case, from its extraction: stage, outcome, elements with facts, citations."""

    def element(n: str) -> Column:
        e = x["elements"][n]
        fact = F.transform(F.slice(F.coalesce(e["key_facts"], F.array()), 1, facts), lambda f: F.concat(F.lit("\n    Fact: "), F.substring(f, 1, 200)))
        reason = F.substring(F.coalesce(e["judge_reasoning"], F.lit("")), 1, 300)
        line = F.concat(F.lit(f"\n  - {n}: "), F.coalesce(e["status"], F.lit("")), F.array_join(fact, ""), F.when(reason != "", F.concat(F.lit("\n    Reasoning: "), reason)).otherwise(""))
        return F.when(e.isNotNull(), line)

    def cited(label: str, c: Column) -> Column:
        return F.when(F.size(c) > 0, F.concat(F.lit(f"\n{label}: "), F.array_join(F.slice(c, 1, listed), ", "))).otherwise("")

    head = F.concat(F.lit("## Query Case: "), F.coalesce(_c(name), F.lit("")), F.lit(" (docket_id="), _c(docket).cast("string"), F.lit(")"))
    lines = F.array_join(F.filter(F.array(*map(element, names)), lambda v: v.isNotNull()), "")
    text = lambda c: F.coalesce(c, F.lit(""))
    body = F.concat(F.lit("\nProcedural stage: "), text(x["procedural_stage"]), F.lit("\nOutcome: "), text(x["outcome"]), F.lit("\nElements:"), lines, cited("Statutes", x["statutes_cited"]), cited("Precedents cited", x["precedents_cited"]))
    return F.concat(head, F.when(x.isNull(), "\n(No IRAC extraction available for this case)").otherwise(body))


def full(name, docket, court, semantic, reason, score, final, x: Column, names: tuple[str, ...]) -> Column:
    """The entry of a prompt on a precedent: where it was found, and its outcome and elements if it has an extraction."""
    n = lambda c: F.coalesce(_c(c), F.lit(0.0))
    text = lambda c: F.coalesce(_c(c).cast("string"), F.lit("unknown"))
    head = F.concat(F.lit("### "), text(name), F.lit(" (docket_id="), text(docket), F.lit(", court="), text(court), F.lit(")\n"))
    found = F.format_string("  Retrieval: semantic=%.3f, graph=%s, anco_hits=%.3f, final=%.3f", n(semantic), F.coalesce(_c(reason), F.lit("none")), n(score), n(final))
    irac = F.concat(F.lit("\n  Outcome: "), F.coalesce(x["outcome"], F.lit("")), F.lit(", Stage: "), F.coalesce(x["procedural_stage"], F.lit("")), F.lit("\n"), elements(x, names))
    return F.concat(head, found, F.coalesce(irac, F.lit("")))
