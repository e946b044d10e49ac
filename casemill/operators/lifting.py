"""From opinion texts to structured extractions through a pluggable text model, and vectors from texts without one."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions.sections import analysis_text, sections
from casemill.functions.text import prompt_budget
from casemill.operators.extractions import ELEMENTS, json_in_text

INSTRUCTION = "Read the opinion and answer with one JSON object: procedural_stage, outcome, elements, statutes_cited, precedents_cited, arguments_plaintiff, arguments_defendant.\n\n"


def prompts(opinions: DataFrame) -> DataFrame:
    """(opinion_id, docket_id, prompt, out_tokens): the analysis part of each text, cut to what fits, shortest first when sorted by length."""
    rows = opinions.where("plain_text is not null").withColumn("parts", sections("plain_text"))
    rows = rows.withColumn("body", analysis_text(F.col("plain_text"), F.col("parts"))).withColumn("b", prompt_budget("body"))
    n, head = F.col("b.max_chars").cast("int"), F.floor(F.col("b.max_chars") * 0.6).cast("int")
    cut = F.when(F.length("body") <= n, F.col("body")).otherwise(F.concat(F.left("body", head), F.lit("\n\n[... TEXT TRUNCATED ...]\n\n"), F.right("body", n - head)))
    return rows.select("opinion_id", "docket_id", F.concat(F.lit(INSTRUCTION), cut).alias("prompt"), F.col("b.out_tokens").alias("out_tokens"))


def mock_client(prompts: list[str]) -> list[str]:
    """A fixed, valid answer to any prompt, for runs without a model."""
    element = {"status": "NOT_ANALYZED", "sub_conditions": [], "key_facts": [], "judge_reasoning": "", "confidence": 0.5}
    answer = {"procedural_stage": "MTD", "outcome": "DEFENDANT_WINS", "elements": {e: element | {"status": "NOT_SATISFIED"} if e == "scienter" else element for e in ELEMENTS}, "statutes_cited": ["15 U.S.C. § 78j(b)"], "precedents_cited": [], "arguments_plaintiff": [], "arguments_defendant": ["The complaint pleads no motive."]}
    return [f"```json\n{json.dumps(answer)}\n```"] * len(prompts)


def lift(asked: DataFrame, client: Callable[[list[str]], list[str]] = mock_client) -> DataFrame:
    """(opinion_id, docket_id, raw, extraction): the client's answers, batch by batch where the prompts lie, and the JSON in them.

    client: a picklable function from prompts to answers; an answer may be None. A raised error fails the task, which
    Spark repeats.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"opinion_id": batch["opinion_id"], "docket_id": batch["docket_id"], "raw": client(batch["prompt"].tolist())})

    return asked.mapInPandas(ask, "opinion_id long, docket_id long, raw string").withColumn("extraction", json_in_text("raw"))


def hashed_vector(text, width: int = 256) -> Column:
    """A unit vector of hashed word counts: word i adds 1 or -1 to the place its hash names. Zero for texts without words."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import xxhash

        for batch in batches:
            out = []
            for t in batch.fillna(""):
                v = np.zeros(width, np.float32)
                for w in t.lower().split():
                    h = xxhash.xxh64_intdigest(w)
                    v[h % width] += 1 if h >> 63 else -1
                n = np.linalg.norm(v)
                out.append((v / n if n else v).tolist())
            yield pd.Series(out)

    return encode(F.col(text) if isinstance(text, str) else text)


def vector_of_blob(blob) -> Column:
    """float32 bytes as an array; null for null, and for bytes that are no whole number of floats."""

    @F.pandas_udf("array<float>")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda b: np.frombuffer(b, "<f4").tolist() if b is not None and len(b) % 4 == 0 else None)

    return decode(F.col(blob) if isinstance(blob, str) else blob)


def blob_of_vector(vector) -> Column:
    """An array of floats as float32 bytes; null for null and for arrays with nulls."""

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda v: np.asarray(v, "<f4").tobytes() if v is not None else None)

    c = F.col(vector) if isinstance(vector, str) else vector
    return encode(F.when(~F.exists(c, lambda x: x.isNull()), c))


def encoded(texts: DataFrame, encoder: Callable[[list[str]], np.ndarray], width: int, key: str = "opinion_id", text: str = "plain_text") -> DataFrame:
    """(key, embedding): vectors of a pluggable encoder, a picklable function from texts to rows of ``width`` floats.

    Null and empty texts get no row. Texts go to the encoder batch by batch where they lie; a raised error fails the task,
    which Spark repeats.
    """
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = np.asarray(encoder(batch["t"].tolist()), np.float32) if len(batch) else np.zeros((0, width), np.float32)
            if rows.shape != (len(batch), width):
                raise ValueError(f"the encoder gave {rows.shape}, not {(len(batch), width)}")
            yield pd.DataFrame({key: batch["k"], "embedding": list(rows)})

    return texts.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t <> ''").mapInPandas(run, f"{key} {kind}, embedding array<float>")
