"""Queries of evaluation statistics: extractions and scores against labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.operators import extractions as X
from casemill.operators import statistics as St
from casemill.operators.graph import CaseGraph
from casemill.operators.records import one_per_key
from casemill.queries.graph import _DONE, BASE, anco_converged
from casemill.queries.text import _OUTCOME
from casemill.tables import table


def _compared(spark, d):
    """Label and latest extraction of each opinion that has both: docket_id, opinion_id, true, pred, stages."""
    labels = one_per_key(table(spark, d, "case_labels").where("opinion_id is not null"), ["opinion_id"], F.desc_nulls_last("label_confidence"), F.asc_nulls_last("outcome_label"), F.asc_nulls_last("procedural_stage"), F.asc_nulls_last("docket_id"))
    x = X.latest_valid(table(spark, d, "irac_extractions")).select("opinion_id", F.col("x.outcome").alias("pred"), F.col("x.procedural_stage").alias("pred_stage"))
    return labels.select("docket_id", "opinion_id", F.col("outcome_label").alias("true"), F.col("procedural_stage").alias("true_stage")).join(x, "opinion_id").where("true is not null and pred is not null")


def confusion(spark, d):
    return St.confusion(_compared(spark, d), "true", "pred")


def per_class(spark, d):
    return St.per_class(_compared(spark, d), "true", "pred")


def balanced_accuracy(spark, d):
    return St.accuracy(_compared(spark, d), "true", "pred")


def kappa_stage(spark, d):
    return St.kappa(_compared(spark, d).where("true_stage is not null and pred_stage is not null"), "true_stage", "pred_stage")


def kappa_gate(spark, d):
    """Whether both agreements pass 0.7."""
    rows = _compared(spark, d)
    a = St.kappa(rows, "true", "pred")
    b = kappa_stage(spark, d)
    return a.unionByName(b).agg(F.bool_and(F.col("kappa") >= 0.7).alias("passed"), F.min("kappa").alias("least"))


def majority_baseline(spark, d):
    """The most frequent label and how often it is right; ties by name."""
    rows = _compared(spark, d).groupBy("true").agg(F.count("*").alias("n"))
    return rows.agg(F.max_by("true", F.struct("n", "true")).alias("label"), F.round(F.max("n") / F.sum("n"), 6).alias("accuracy"))


def _scored(spark, d):
    scores = anco_converged(spark, d).where("entity_type = 'case'").select(F.col("entity_id").cast("bigint").alias("docket_id"), "score")
    return scores.join(CaseGraph(spark, d).cases().select("docket_id", "outcome_label"), "docket_id").where("outcome_label in ('PLAINTIFF_WINS', 'DEFENDANT_WINS')")


def score_auc(spark, d):
    return St.auc(_scored(spark, d).withColumn("pos", F.col("outcome_label") == "PLAINTIFF_WINS"), "score", "pos")


def score_spearman(spark, d):
    return St.spearman(_scored(spark, d).withColumn("y", F.when(F.col("outcome_label") == "PLAINTIFF_WINS", 1).otherwise(-1)), "score", "y")


def threshold_baseline(spark, d):
    """Classes from scores beyond 0.3 either way, against the labels of all scored cases."""
    scores = anco_converged(spark, d).where("entity_type = 'case'").select(F.col("entity_id").cast("bigint").alias("docket_id"), "score")
    pred = F.when(F.col("score") > 0.3, "PLAINTIFF_WINS").when(F.col("score") < -0.3, "DEFENDANT_WINS").otherwise("MIXED")
    rows = scores.join(CaseGraph(spark, d).cases().select("docket_id", "outcome_label"), "docket_id").where("outcome_label is not null").withColumn("pred", pred)
    return St.accuracy(rows, "outcome_label", "pred")


def regex_baseline(spark, d):
    """The pattern cascade over the texts against the labels of their opinions."""
    from casemill.queries.text import classify_outcome

    said = classify_outcome(spark, d).groupBy("opinion_id").agg(F.max("label").alias("pred"))
    truth = table(spark, d, "case_labels").where("opinion_id is not null and outcome_label is not null").groupBy("opinion_id").agg(F.min("outcome_label").alias("true"))
    return St.accuracy(truth.join(said, "opinion_id"), "true", "pred")


def bootstrap_point(spark, d):
    """Interval of the share of right outcomes."""
    out = St.bootstrap(_compared(spark, d).withColumn("hit", (F.col("true") == F.col("pred")).cast("int")), "hit")
    return out.select(*[F.round(c, 6).alias(c) for c in ("point", "low", "high")])


def holdout_sets(spark, d):
    """Scored cases that no valid extraction trained on, and those that are in both."""
    g = CaseGraph(spark, d)
    labelled, trained = table(spark, d, "case_labels").select("docket_id").distinct(), g.valid_runs().select("docket_id").distinct()
    out = labelled.exceptAll(trained.intersect(labelled)).withColumn("kind", F.lit("held_out"))
    return out.unionByName(labelled.intersect(trained).withColumn("kind", F.lit("both")))


def consistency(spark, d):
    """Whether each extraction's outcome can follow from its elements, with the reason if not."""
    x = X.latest_valid(table(spark, d, "irac_extractions"))
    s = F.transform(F.map_values("x.elements"), lambda e: e["status"])
    count = lambda status: F.size(F.filter(s, lambda v: v == status))
    sat, bad, none, outcome = count("SATISFIED"), count("NOT_SATISFIED"), count("NOT_ANALYZED"), F.col("x.outcome")
    reason = (
        F.when(none == F.size(s), "all_not_analyzed")
        .when((sat == 6) & (outcome != "PLAINTIFF_WINS"), "all_satisfied")
        .when((bad > 0) & (outcome == "PLAINTIFF_WINS"), "has_not_satisfied")
        .when((sat == 0) & (bad > 0) & (outcome != "DEFENDANT_WINS"), "none_satisfied")
        .otherwise("consistent")
    )
    return x.select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def pass_rate(spark, d):
    rows = table(spark, d, "irac_extractions").dropDuplicates(["id"])
    return rows.groupBy("llm_model").agg(F.count("*").alias("n"), F.count_if(F.col("is_valid") == 1).alias("n_valid"), F.round(F.avg(F.coalesce((F.col("is_valid") == 1).cast("double"), F.lit(0.0))), 6).alias("rate"))


def split_pivot(spark, d):
    """Labels by normalised split."""
    s = F.lower(F.trim("split"))
    rows = table(spark, d, "case_labels").where("opinion_id is not null").distinct().withColumn("s", F.when(s.isin("val", "dev", "validation"), "val").when(s.isin("train", "test"), s).otherwise("none"))
    return rows.groupBy("outcome_label").pivot("s", ["train", "val", "test", "none"]).agg(F.count(F.lit(1))).fillna(0, ["train", "val", "test", "none"])


def stratified_split(spark, d):
    """Labelled opinions split 70/15/15 within each outcome, by hash order; a class of less than three is all train."""
    from pyspark.sql import Window

    rows = table(spark, d, "case_labels").where("opinion_id is not null and outcome_label is not null").groupBy("opinion_id").agg(F.min("outcome_label").alias("outcome"))
    w = Window.partitionBy("outcome")
    order = F.sha2(F.concat(F.lit("42:"), F.col("opinion_id").cast("string")), 256)
    rows = rows.withColumn("n", F.count("*").over(w)).withColumn("i", F.row_number().over(w.orderBy(order)))
    part = F.greatest(F.lit(1), F.bround(F.col("n") * 0.15, 0).cast("long"))
    return rows.select("opinion_id", "outcome", F.when(F.col("n") < 3, "train").when(F.col("i") <= part, "test").when(F.col("i") <= 2 * part, "val").otherwise("train").alias("split"))


QUERIES = {f.__name__: f for f in (confusion, per_class, balanced_accuracy, kappa_stage, kappa_gate, majority_baseline, score_auc, score_spearman, threshold_baseline, regex_baseline, bootstrap_point, holdout_sets, consistency, pass_rate, split_pivot, stratified_split)}

_CMP = BASE + r""", lb AS (SELECT docket_id, opinion_id, outcome_label, procedural_stage, row_number() OVER (PARTITION BY opinion_id ORDER BY label_confidence DESC NULLS LAST, outcome_label NULLS LAST, procedural_stage NULLS LAST, docket_id NULLS LAST) AS rn FROM case_labels WHERE opinion_id IS NOT NULL),
lv AS (SELECT *, row_number() OVER (PARTITION BY opinion_id ORDER BY try_cast(rtrim(replace(trim(created_at), 'T', ' '), 'Z') AS TIMESTAMP) DESC NULLS LAST, id DESC) AS rn FROM runs), lx AS (SELECT * FROM lv WHERE rn = 1),
cmp AS (SELECT l.docket_id, l.opinion_id, outcome_label AS t, procedural_stage AS ts, j->>'$.outcome' AS p, j->>'$.procedural_stage' AS ps FROM lb l JOIN lx USING (opinion_id) WHERE l.rn = 1 AND outcome_label IS NOT NULL AND j->>'$.outcome' IS NOT NULL)"""
_KAPPA = lambda a, b, src: f"(SELECT round(CASE WHEN pe >= 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) AS kappa, n FROM (SELECT (SELECT avg(CAST({a} = {b} AS INT)) FROM {src}) AS po, (SELECT coalesce(sum(x.n * y.n), 0) FROM (SELECT {a} AS c, count(*) AS n FROM {src} GROUP BY 1) x JOIN (SELECT {b} AS c, count(*) AS n FROM {src} GROUP BY 1) y USING (c)) / (SELECT count(*) * count(*) FROM {src}) AS pe, (SELECT count(*) FROM {src}) AS n))"
_STG = "(SELECT * FROM cmp WHERE ts IS NOT NULL AND ps IS NOT NULL)"
_SC = _DONE + ", sc AS (SELECT docket_id, outcome_label AS o, score FROM scores JOIN kase ON CAST(docket_id AS VARCHAR) = entity_id WHERE entity_type = 'case')"
ORACLES = {
    "confusion": _CMP + " SELECT t AS true, p AS pred, count(*) AS n FROM cmp GROUP BY 1, 2",
    "per_class": _CMP
    + """, k AS (SELECT t AS c FROM cmp UNION SELECT p FROM cmp), s AS (SELECT c, (SELECT count(*) FROM cmp WHERE t = c AND p = c) AS hit, (SELECT count(*) FROM cmp WHERE t = c) AS support, (SELECT count(*) FROM cmp WHERE p = c) AS said FROM k),
    r AS (SELECT c, support, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS pr, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS re FROM s) SELECT c AS class, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1, support FROM r""",
    "balanced_accuracy": _CMP + ", g AS (SELECT t, avg(CAST(t = p AS INT)) AS r FROM cmp GROUP BY 1) SELECT (SELECT round(avg(CAST(t = p AS INT)), 6) FROM cmp) AS accuracy, (SELECT round(avg(r), 6) FROM g) AS balanced, (SELECT count(*) FROM cmp) AS n",
    "kappa_stage": _CMP + f" SELECT * FROM {_KAPPA('ts', 'ps', _STG)}",
    "kappa_gate": _CMP + f" SELECT bool_and(kappa >= 0.7) AS passed, min(kappa) AS least FROM (SELECT * FROM {_KAPPA('t', 'p', 'cmp')} UNION ALL SELECT * FROM {_KAPPA('ts', 'ps', _STG)})",
    "majority_baseline": _CMP + ", g AS (SELECT t, count(*) AS n FROM cmp GROUP BY 1) SELECT max_by(t, struct_pack(a := n, b := t)) AS label, round(max(n) / sum(n), 6) AS accuracy FROM g",
    "score_auc": _SC
    + """, r AS (SELECT o, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM sc WHERE o IN ('PLAINTIFF_WINS', 'DEFENDANT_WINS')), c AS (SELECT count_if(o = 'PLAINTIFF_WINS') AS a, count_if(o = 'DEFENDANT_WINS') AS b, sum(CASE WHEN o = 'PLAINTIFF_WINS' THEN rk END) AS u FROM r)
    SELECT CASE WHEN a > 0 AND b > 0 THEN round((u - a * (a + 1) / 2) / (a * b), 6) END AS auc, a AS n_pos, b AS n_neg FROM c""",
    "score_spearman": _SC
    + """, y AS (SELECT score, CASE o WHEN 'PLAINTIFF_WINS' THEN 1 ELSE -1 END AS y FROM sc WHERE o IN ('PLAINTIFF_WINS', 'DEFENDANT_WINS')), r AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS b FROM y)
    SELECT round(r, 6) AS rho, n, CASE WHEN r IS NOT NULL AND n > 2 THEN round(1 - exp(lgamma((n - 1) / 2) - lgamma((n - 2) / 2)) / sqrt(pi()) * 2 * (SELECT sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(cos(i / 4000 * asin(abs(r))), n - 3)) * asin(abs(r)) / 4000 / 3 FROM range(4001) g(i)), 6) END AS p FROM (SELECT corr(a, b) AS r, count(*) AS n FROM r)""",
    "threshold_baseline": _SC
    + """, p AS (SELECT o, CASE WHEN score > 0.3 THEN 'PLAINTIFF_WINS' WHEN score < -0.3 THEN 'DEFENDANT_WINS' ELSE 'MIXED' END AS p FROM sc WHERE o IS NOT NULL), g AS (SELECT o, avg(CAST(o = p AS INT)) AS r FROM p GROUP BY 1)
    SELECT (SELECT round(avg(CAST(o = p AS INT)), 6) FROM p) AS accuracy, (SELECT round(avg(r), 6) FROM g) AS balanced, (SELECT count(*) FROM p) AS n""",
    "regex_baseline": _OUTCOME
    + """, said AS (SELECT opinion_id, max(s.label) AS p FROM r GROUP BY 1), truth AS (SELECT opinion_id, min(outcome_label) AS t FROM case_labels WHERE opinion_id IS NOT NULL AND outcome_label IS NOT NULL GROUP BY 1), c AS (SELECT t, p FROM truth JOIN said USING (opinion_id)),
    g AS (SELECT t, avg(CAST(t = p AS INT)) AS r FROM c GROUP BY 1) SELECT (SELECT round(avg(CAST(t = p AS INT)), 6) FROM c) AS accuracy, (SELECT round(avg(r), 6) FROM g) AS balanced, (SELECT count(*) FROM c) AS n""",
    "holdout_sets": BASE + " SELECT docket_id, CASE WHEN docket_id IN (SELECT docket_id FROM runs WHERE docket_id IS NOT NULL) THEN 'both' ELSE 'held_out' END AS kind FROM (SELECT DISTINCT docket_id FROM case_labels)",
    "consistency": _CMP
    + """, el AS (SELECT id, j->>'$.outcome' AS o, [json_extract_string(j, '$.elements.' || k || '.status') FOR k IN json_keys(j, '$.elements')] AS s FROM lx),
    n AS (SELECT o, len(s) AS n, len(list_filter(s, lambda x: x = 'SATISFIED')) AS sat, len(list_filter(s, lambda x: x = 'NOT_SATISFIED')) AS bad, len(list_filter(s, lambda x: x = 'NOT_ANALYZED')) AS na FROM el)
    SELECT CASE WHEN na = n THEN 'all_not_analyzed' WHEN sat = 6 AND o <> 'PLAINTIFF_WINS' THEN 'all_satisfied' WHEN bad > 0 AND o = 'PLAINTIFF_WINS' THEN 'has_not_satisfied' WHEN sat = 0 AND bad > 0 AND o <> 'DEFENDANT_WINS' THEN 'none_satisfied' ELSE 'consistent' END AS reason, count(*) AS n FROM n GROUP BY 1""",
    "pass_rate": "WITH r AS (SELECT DISTINCT id, llm_model, is_valid FROM irac_extractions) SELECT llm_model, count(*) AS n, count_if(is_valid = 1) AS n_valid, round(avg(CASE WHEN is_valid = 1 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM r GROUP BY 1",
    "split_pivot": """WITH r AS (SELECT DISTINCT * FROM case_labels WHERE opinion_id IS NOT NULL), s AS (SELECT outcome_label, CASE WHEN lower(trim(split)) IN ('val', 'dev', 'validation') THEN 'val' WHEN lower(trim(split)) IN ('train', 'test') THEN lower(trim(split)) ELSE 'none' END AS s FROM r)
      SELECT outcome_label, count_if(s = 'train') AS train, count_if(s = 'val') AS val, count_if(s = 'test') AS test, count_if(s = 'none') AS "none" FROM s GROUP BY 1""",
    "stratified_split": """WITH r AS (SELECT opinion_id, min(outcome_label) AS outcome FROM case_labels WHERE opinion_id IS NOT NULL AND outcome_label IS NOT NULL GROUP BY 1),
      w AS (SELECT *, count(*) OVER (PARTITION BY outcome) AS n, row_number() OVER (PARTITION BY outcome ORDER BY sha256('42:' || opinion_id)) AS i FROM r), p AS (SELECT *, greatest(1, CAST(round_even(n * 0.15, 0) AS BIGINT)) AS part FROM w)
      SELECT opinion_id, outcome, CASE WHEN n < 3 THEN 'train' WHEN i <= part THEN 'test' WHEN i <= 2 * part THEN 'val' ELSE 'train' END AS split FROM p""",
}
