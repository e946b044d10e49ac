"""Scores on a signed bipartite graph of cases and arguments, by mutual reinforcement until nothing moves."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.plans.durable import durable, forget

#: rounds of one plan
STEP = 2


def seeds(edges: DataFrame) -> DataFrame:
    """(case_id, score): a case begins with its outcome; edges: case_id, arg_id, sign, seed (1, -1 or 0)."""
    return edges.groupBy("case_id").agg(_seed().alias("score"))


def _seed():
    return F.max_by("seed", F.abs("seed")).cast("double")


def reinforce(edges: DataFrame, rounds: int = 200, epsilon: float = 1e-6, step: int = STEP) -> tuple[DataFrame, DataFrame, int]:
    """(arguments, cases, rounds done): each side's score is the other's signed mean by absolute weight, 0 without weight.

    Rounds end when no score of either side moves by epsilon or more, or after ``rounds``. Two joins and aggregates a
    round, partitioned by the two keys; nodes that have zero signs only stay with 0. Up to ``step`` rounds are one plan,
    which is written with the scores before its last round and the greatest moves of each of its rounds; that cuts the
    lineage. Where a plan turns out to go beyond the last round it is made again up to that one. Earlier tables are removed.
    Arguments go by numbers within the rounds, as their keys may be long.
    """
    edges = durable(edges.select("case_id", "arg_id", F.col("sign").cast("double").alias("sign"), "seed"), "edges")
    names = durable(edges.select("arg_id").distinct().withColumn("_arg", F.monotonically_increasing_id()), "names")
    edges = durable(edges.join(names, "arg_id").select("case_id", "_arg", "sign", "seed"), "edges")
    # the scores are the side with a row a key: hashed, while the edges needn't be sorted in every round
    join = lambda scores, key: edges.join(scores.hint("shuffle_hash"), key)
    mean = lambda v: F.when(F.sum(F.abs(v)) > 0, F.sum(v) / F.sum(F.abs(v))).otherwise(0.0)
    sent = lambda c: mean(F.col("sign") * F.col(c))
    moved = F.abs(F.col("score") - F.col("was"))

    def follow(cases: DataFrame, first: bool, n: int) -> DataFrame:
        """(case_id, score, was, m0, m1, ...) after n rounds. Moves travel with the scores: all nodes have edges, so none is lost."""
        for i in range(n):
            start, seen = first and i == 0, [F.max(f"m{j}").alias(f"m{j}") for j in range(i)]
            args = join(cases, "case_id").groupBy("_arg").agg(sent("score").alias("score"), (F.lit(1.0) if start else sent("was")).alias("was"), *seen).withColumn(f"m{i}", moved)
            seen.append(F.max(f"m{i}").alias(f"m{i}"))
            cases = join(args, "_arg").groupBy("case_id").agg(sent("score").alias("score"), (_seed() if start else sent("was")).alias("was"), *seen).withColumn(f"m{i}", F.greatest(f"m{i}", moved))
        return cases

    cases, done, moves = seeds(edges), 0, [epsilon]
    while done < rounds and moves[-1] >= epsilon:
        n = min(step, rounds - done, _rounds_left(moves, epsilon))
        after = durable(follow(cases, not done, n), "cases")
        now = [x or 0.0 for x in after.agg(*[F.max(f"m{i}") for i in range(n)]).first()]
        last = next((i + 1 for i, x in enumerate(now) if x < epsilon), n)
        if last < n:
            forget(after)
            after = durable(follow(cases, not done, last), "cases")
        forget(cases)
        cases, done, moves = after, done + last, moves + now[:last]
    args = names.withColumn("score", F.lit(1.0))
    if done:
        args = join(cases, "case_id").groupBy("_arg").agg(sent("was").alias("score")).join(names, "_arg")
    return args.select("arg_id", "score"), cases.select("case_id", "score"), done


def _rounds_left(moves: list[float], epsilon: float) -> int:
    """Rounds until a move is under epsilon if moves go on to shrink as the last two did; many if they don't shrink."""
    if len(moves) < 3 or not 0 < moves[-1] < moves[-2]:
        return 1 << 30
    return max(1, math.ceil(math.log(epsilon / moves[-1]) / math.log(moves[-1] / moves[-2])))


def long_table(args: DataFrame, cases: DataFrame) -> DataFrame:
    """(entity_type, entity_id, score) of both."""
    a = args.select(F.lit("argument").alias("entity_type"), F.col("arg_id").cast("string").alias("entity_id"), "score")
    return a.unionByName(cases.select(F.lit("case").alias("entity_type"), F.col("case_id").cast("string").alias("entity_id"), "score"))


#: score bands, upper end exclusive
BANDS = [("strong plaintiff", 0.5, 1.01), ("moderate plaintiff", 0.1, 0.5), ("contested", -0.1, 0.1), ("moderate defendant", -0.5, -0.1), ("strong defendant", -1.01, -0.5)]


def band(score):
    chosen = F.lit(None).cast("string")
    for name, lo, hi in BANDS:
        chosen = F.when((score >= lo) & (score < hi), name).otherwise(chosen)
    return chosen


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, *by: str) -> DataFrame:
    """(by..., bin, n) of equal width, the last one closed; values outside are left out."""
    at = F.least(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(bins - 1))
    return df.where(F.col(value).between(low, high)).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))


def direction(outcome, score):
    """Whether a score points to the outcome; a mixed outcome agrees with any."""
    return F.when(outcome == "PLAINTIFF_WINS", score > 0).when(outcome == "DEFENDANT_WINS", score < 0).otherwise(outcome == "MIXED")
