"""Cutting oversized texts into overlapping pieces at natural boundaries.

Per text: offsets of the units (characters, or tokens with their prefix sums) and one sorted array of boundary
positions per level, coarse to fine. The last boundary under the limit is found by binary search; the next piece
begins the overlap before it; where no level has a boundary the cut is hard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.plans.durable import broadcast_if_small, durable

LIMIT, OVERLAP = 10_000, 200
LEVELS = ("paragraph", "line", "sentence", "word")
#: characters of str.isspace; fixed values
SPACES = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288], np.uint32)
#: marks that end a sentence, and marks that may close it; fixed values
ENDS = np.array([ord(c) for c in ".!?…。！？．｡।॥؟۔"], np.uint32)
CLOSERS = np.array([ord(c) for c in "\"')]}’”»›」』）】"], np.uint32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_TABLE = np.zeros(65536, bool)
_TABLE[SPACES] = True


def is_space(points: np.ndarray) -> np.ndarray:
    return _TABLE[np.minimum(points, 65535)]


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def structure(points: np.ndarray) -> dict[str, np.ndarray]:
    """Word runs, line bounds, and runs of non-blank lines, each as starts and ends."""
    word_start, word_end = _runs(~is_space(points))
    breaks = np.flatnonzero(points == 10)
    line_start, line_end = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [points.size]))
    # a line is blank if no word begins in it
    full = np.searchsorted(word_start, line_end) > np.searchsorted(word_start, line_start)
    first, last = _runs(full)
    return {"word_start": word_start, "word_end": word_end, "line_start": line_start, "line_end": line_end, "par_start": line_start[first], "par_end": line_end[last - 1] if last.size else last}


def sufficient(points: np.ndarray, limit: int = LIMIT) -> str:
    """The coarsest level at which every stretch between boundaries is within the limit."""
    s = structure(points)
    for level, key in (("paragraph", "par"), ("line", "line"), ("word", "word")):
        if s[f"{key}_end"].size == 0 or int((s[f"{key}_end"] - s[f"{key}_start"]).max()) <= limit:
            return level
    return "none"


def boundaries(points: np.ndarray) -> list[np.ndarray]:
    """Sorted cut positions of each of LEVELS; a cut at p ends a piece before character p."""
    s = structure(points)
    closing = np.isin(points[s["word_end"] - 1], ENDS) if s["word_end"].size else np.zeros(0, bool)
    if s["word_end"].size > 1:
        before = np.maximum(s["word_end"] - 2, 0)
        closing |= np.isin(points[s["word_end"] - 1], CLOSERS) & np.isin(points[before], ENDS)
    next_word = np.append(s["word_start"][1:], points.size)
    return [s["par_start"][1:], s["line_start"][1:], next_word[closing], s["word_start"][1:]]


def cuts(bounds: list[np.ndarray], total: int, offsets: np.ndarray | None = None, limit: int = LIMIT, overlap: int = OVERLAP, fill: float = 0.5) -> list[tuple[int, int, str]]:
    """(start, end, level) of the pieces of a text of ``total`` characters.

    offsets: prefix sums of unit sizes with one entry per character plus one; None counts characters. Pieces hold at
    most ``limit`` units, each begins ``overlap`` units before its predecessor's end. A level is taken if its last
    boundary under the limit fills at least ``fill`` of it; if none does, the coarsest that gets ahead at all.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than the limit")
    if total == 0:
        return []
    reach = (lambda at, n: min(at + n, total)) if offsets is None else (lambda at, n: int(np.searchsorted(offsets, offsets[at] + n, "right")) - 1)
    back = (lambda at, n: max(at - n, 0)) if offsets is None else (lambda at, n: int(np.searchsorted(offsets, offsets[at] - n, "left")))
    out, start, done = [], 0, 0
    while True:
        end = reach(start, limit)
        if end >= total:
            out.append((start, total, "end"))
            return out
        # more must be new than the overlap takes back, so that the pieces advance
        least = max(reach(start, overlap), done) + 1
        for lowest in (max(least, reach(start, int(limit * fill))), least):
            chosen = next(((int(b[i]), level) for b, level in zip(bounds, LEVELS) if (i := int(np.searchsorted(b, end, "right")) - 1) >= 0 and b[i] >= lowest), None)
            if chosen:
                break
        cut, level = chosen or (max(end, start + 1), "hard")
        out.append((start, cut, level))
        start, done = min(back(cut, overlap), cut), cut


def _once(rows: DataFrame) -> DataFrame:
    """One of the rows with equal key and text. Only keys and hashes are shuffled; texts move where a key has several rows."""
    marked = rows.withColumn("h", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(5), "text"))
    again = broadcast_if_small(durable(marked.groupBy("key", "h", "h2").agg(F.count("*").alias("n")).where("n > 1").select("key", "h", "h2"), "again"))
    same = F.col("key").eqNullSafe(F.col("k")) & (F.col("h") == F.col("g")) & (F.col("h2") == F.col("g2"))
    few = again.toDF("k", "g", "g2")
    repeated = marked.join(few, same, "left_semi").dropDuplicates(["key", "h", "h2"])
    return marked.join(few, same, "left_anti").unionByName(repeated).select("key", "text")


def word_offsets(text: str) -> np.ndarray:
    """Prefix sums of words per character, for pieces that are limited in words: each word counts where it begins."""
    starts = np.zeros(len(text) + 1, np.int64)
    starts[structure(code_points(text))["word_start"] + 1] = 1
    return np.cumsum(starts)


def split_pieces(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, sizes: Callable[[str], np.ndarray] | None = None, repeats: bool = False, with_text: bool = True) -> DataFrame:
    """(key, piece_no, n_pieces, start_pos, end_pos, level, cut, piece) of the texts with more than ``limit`` units.

    Positions count characters from 1, inclusive. level: where the piece ends; cut: the coarsest level at which cutting
    suffices for the whole text. sizes: gives the offsets array of a text for units other than characters, applied to
    every text. Rows with the same key and text give their pieces once, or each time if ``repeats``. Null and blank
    texts, and texts within the limit, give no rows. One text is one task's work, linear in its length. The piece is
    null unless ``with_text``.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    if sizes is None:
        rows = rows.where(F.length("text") > limit)
    if not repeats:
        rows = _once(rows)
    kind = dict(df.dtypes)[key]
    columns = ("key", "piece_no", "n_pieces", "start_pos", "end_pos", "level", "cut", "piece")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for k, t in zip(batch["key"], batch["text"]):
                offsets = sizes(t) if sizes else None
                if not t.strip() or (offsets is not None and offsets[-1] <= limit):
                    continue
                points = code_points(t)
                parts, suffices = cuts(boundaries(points), points.size, offsets, limit, overlap), sufficient(points, limit)
                out += [(k, i, len(parts), a + 1, b, level, suffices, t[a:b] if with_text else None) for i, (a, b, level) in enumerate(parts, 1)]
            yield pd.DataFrame(out, columns=columns)

    schema = f"key {kind}, piece_no int, n_pieces int, start_pos int, end_pos int, level string, cut string, piece string"
    return rows.mapInPandas(cut, schema).withColumnRenamed("key", key)
