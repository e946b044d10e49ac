"""A Markdown report of the evaluation, from small aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casemill import registry

#: sections of the report: title and query, each of few rows
SECTIONS = (
    ("Agreement of outcomes", "confusion"),
    ("Per class", "per_class"),
    ("Accuracy", "balanced_accuracy"),
    ("Majority baseline", "majority_baseline"),
    ("Pattern baseline", "regex_baseline"),
    ("Threshold baseline", "threshold_baseline"),
    ("Scores: area under the curve", "score_auc"),
    ("Scores: rank correlation", "score_spearman"),
    ("Scores by outcome", "score_by_outcome"),
    ("Elements", "element_accuracy"),
    ("Retrieval", "case_retrieval"),
    ("Constraint violations", "violation_rates"),
)
MOST = 100


def as_markdown(df: DataFrame, most: int = MOST) -> str:
    """A table of the first ``most`` rows, which is all of them for an aggregate; a note says if there are more."""
    rows = df.limit(most + 1).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows[:most]]
    return "\n".join(lines + ([f"\nOnly the first {most} rows."] if len(rows) > most else []))


def report(spark: SparkSession, sf_dir: str, sections: tuple[tuple[str, str], ...] = SECTIONS) -> str:
    queries = registry.queries()
    return "# Evaluation\n\n" + "\n\n".join(f"## {title}\n\n{as_markdown(queries[name](spark, sf_dir))}" for title, name in sections) + "\n"
