"""Evaluation texts leaking into training text.

Every passage (``window`` consecutive words) of a test item is split into error budget + 1 pieces. A passage that
occurs in a document with at most that many edits leaves at least one piece untouched, so exact piece hits find every
candidate; Myers' bit-parallel distance over words verifies them. An item shorter than the window is one passage, with
the budget that falls to its length. Words are 64-bit hashes, made and compared as arrays over many documents at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.shingles import _upto, mixed
from casemill.plans.durable import durable

WINDOW = 13
#: characters of item text in one block: what is broadcast at once
BLOCK_CHARS = 8_000_000
#: bits of the filter over the pieces of all items, and characters hashed at once
FILTER_BITS, CHUNK = 27, 400_000
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """Whether each code point is a letter or a digit; made once a process."""
    if not _letters:
        table = np.zeros(0x110000, bool)
        for a, b in ((0, 0xD800), (0xE000, 0x110000)):
            for m in _WORD.finditer("".join(map(chr, range(a, b)))):
                table[a + m.start() : a + m.end()] = True
        _letters.append(table)
    return _letters[0]


def _hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of a lower-cased text."""
    points = np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = np.flatnonzero(np.diff(is_letter()[points], prepend=False, append=False))
    start, end = edges[::2], edges[1::2]
    if not start.size:
        return np.zeros(0, np.uint64), start
    power, inverse = _upto(points.size + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(points.size + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[: points.size], out=sums[1:])
        return mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64)), start


def word_hashes(text: str) -> np.ndarray:
    """A hash of each maximal run of letters and digits of the lower-cased text, in order; long texts go by slices."""
    text, out, at = text.lower(), [], 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text) and (m := _WORD.match(text, end)):
            end = m.end()
        out.append(_hashed(text[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def chunks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, text number of each) of runs of texts of bounded length; a longer text is a run of its own."""
    held, size, first = [], 0, 0

    def flush():
        starts = np.cumsum([0, *(len(t) + 1 for t in held[:-1])])
        words, at = _hashed("\n".join(held))
        return words, first + np.searchsorted(starts, at, "right") - 1

    for k, text in enumerate(texts):
        if len(text) > CHUNK:
            if held:
                yield flush()
            words = word_hashes(text)
            yield words, np.full(words.size, k)
            held, size, first = [], 0, k + 1
            continue
        held.append(text.lower())
        size += len(text)
        if size > CHUNK:
            yield flush()
            held, size, first = [], 0, k + 1
    if held:
        yield flush()


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive words."""
    if words.size < n:
        return np.zeros(0, np.uint64)
    power, inverse = _upto(words.size + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(words.size + 1, np.uint64)
        np.cumsum(words * power[: words.size], out=sums[1:])
        return mixed((sums[n:] - sums[:-n]) * inverse[: words.size - n + 1] + np.uint64(n))


def myers(patterns: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Least edit distance of each pattern to any stretch of its text, all rows at once.

    patterns: (rows, m) words, m at most 64; texts: (rows, n) words, padded with what no pattern has. A row's vertical differences are two
    64-bit words; each text position takes a dozen word operations for all rows.
    """
    rows, m = patterns.shape
    if m > 64:
        raise ValueError("a pattern has at most 64 words")
    one, top = np.uint64(1), np.uint64(m - 1)
    pv, mv = np.full(rows, np.uint64(2**64 - 1)), np.zeros(rows, np.uint64)
    score = np.full(rows, m, np.int64)
    best = score.copy()
    bits = one << np.arange(m, dtype=np.uint64)
    for j in range(texts.shape[1]):
        eq = ((patterns == texts[:, j : j + 1]) * bits).sum(axis=1, dtype=np.uint64)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score += ((ph >> top) & one).astype(np.int64) - ((mh >> top) & one).astype(np.int64)
        ph, mh = ph << one, mh << one  # row 0 stays 0: a match may begin anywhere
        pv, mv = mh | ~(xv | ph), ph & xv
        best = np.minimum(best, score)
    return best


def budget_of(words: int, window: int, budget: int) -> int:
    """Edits allowed in a passage of so many words: those of the window, less in proportion for a shorter item."""
    return budget if words >= window else budget * words // window


class Passages:
    """All passages of one length of a block of items, and their pieces sorted by hash."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, owners: np.ndarray, length: int, budget: int):
        self.words, self.length, self.budget = words, length, budget
        # items share passages: each distinct one is looked for once
        _, first, back = np.unique(window_hashes(words, length)[starts], return_index=True, return_inverse=True)
        self.starts = starts[first]
        pairs = np.unique(np.stack([back.ravel(), owners]), axis=1)
        self.owner_of, self.owners = np.searchsorted(pairs[0], np.arange(first.size + 1)), pairs[1]
        cut = np.linspace(0, length, budget + 2).astype(int)
        self.pieces = []
        for a, b in zip(cut, cut[1:]):
            h = window_hashes(words, b - a)[self.starts + a]
            order = np.argsort(h, kind="stable")
            self.pieces.append((int(a), int(b - a), h[order], order))

    def find(self, words: np.ndarray, text: np.ndarray, hits: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, item, edits) of the passages near the hits, (place, hash) by length of piece, in the words of several texts."""
        found, pad = [np.zeros((2, 0), np.int64)], self.length
        size = words.size + pad
        for offset, n, sorted_hashes, order in self.pieces:
            at, h = hits[n]
            lo, hi = np.searchsorted(sorted_hashes, h, "left"), np.searchsorted(sorted_hashes, h, "right")
            counts = hi - lo
            run = np.repeat(lo, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            at = np.repeat(at, counts)
            found.append(np.stack([order[run] * size + at - offset + pad, text[at]]))
        # each (passage, start, text) once, with the number of its pieces that are there
        cand, of = np.concatenate(found, axis=1)
        by = np.lexsort((of, cand))
        cand, of = cand[by], of[by]
        first = np.flatnonzero(np.concatenate(([True], (cand[1:] != cand[:-1]) | (of[1:] != of[:-1])))) if cand.size else by
        pieces = np.diff(np.append(first, cand.size))
        p, start, of = cand[first] // size, cand[first] % size - pad, of[first]
        whole = pieces == self.budget + 1
        yield self._owned(p[whole], of[whole], np.zeros(whole.sum(), np.int64))
        rest = np.flatnonzero(~whole) if self.budget else by[:0]
        span = np.arange(-self.budget, self.length + self.budget)
        for at in range(0, rest.size, 20_000):
            r = rest[at : at + 20_000]
            place = start[r, None] + span
            near = np.clip(place, 0, words.size - 1)
            around = np.where((place == near) & (text[near] == of[r, None]), words[near], np.uint64(0))
            edits = myers(self.words[self.starts[p[r], None] + np.arange(self.length)], around)
            good = edits <= self.budget
            yield self._owned(p[r][good], of[r][good], edits[good])

    def _owned(self, p: np.ndarray, text: np.ndarray, edits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counts = self.owner_of[p + 1] - self.owner_of[p]
        run = np.repeat(self.owner_of[p], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.repeat(text, counts), self.owners[run], np.repeat(edits, counts)


class ItemIndex:
    """The passages of a block of items by length, and a filter of their pieces' hashes."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, budget: int = 2):
        if not 0 <= budget < window <= 64:
            raise ValueError("the budget must be less than the window, and the window at most 64 words")
        hashed = [word_hashes(text) for _, text in items]
        sizes = np.array([h.size for h in hashed], np.int64)
        words, begin = np.concatenate([np.zeros(0, np.uint64), *hashed]), np.cumsum(sizes) - sizes
        keys = np.array([k for k, _ in items], np.int64)
        self.groups = []
        for length in np.unique(np.minimum(sizes, window)):
            if length:
                which = np.flatnonzero(sizes >= window if length == window else sizes == length)
                n = sizes[which] - length + 1
                starts = np.repeat(begin[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                self.groups.append(Passages(words, starts, np.repeat(keys[which], n), int(length), budget_of(int(length), window, budget)))
        self.filter = np.zeros(1 << 20, bool)
        for g in self.groups:
            for _, _, h, _ in g.pieces:
                self.filter[(h >> np.uint64(44)).astype(np.int64)] = True

    def piece_hashes(self) -> Iterator[np.ndarray]:
        return (h for g in self.groups for _, _, h, _ in g.pieces)

    def find(self, texts: list[str]) -> pd.DataFrame:
        """(text, item, edits, words): per text number and item the least edits of any of its passages of that many words."""
        out = [(np.zeros(0, np.int64),) * 4]
        lengths = {n for g in self.groups for _, n, _, _ in g.pieces}
        for words, text in chunks(texts):
            hits = {}
            for n in lengths:
                h = window_hashes(words, n)
                at = np.flatnonzero(self.filter[(h >> np.uint64(44)).astype(np.int64)])
                at = at[text[at] == text[at + n - 1]]
                hits[n] = (at, h[at])
            for g in self.groups:
                out += [(t, i, e, np.full(t.size, g.length)) for t, i, e in g.find(words, text, hits) if t.size]
        found = pd.DataFrame(dict(zip(("text", "item", "edits", "words"), map(np.concatenate, zip(*out)))))
        return found.groupby(["text", "item", "words"], as_index=False)["edits"].min()


def item_blocks(items: DataFrame, key: str, text: str, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded text; they stream through the driver one partition at a time."""
    block, size = [], 0
    for row in items.select(key, text).where(f"{text} is not null").distinct().toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1])
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def _filter(items: DataFrame, item_key: str, text: str, window: int, budget: int, block_chars: int) -> tuple[int, np.ndarray]:
    """Number of blocks, and packed bits of the hashes of all their pieces: 2 ** FILTER_BITS bits, whatever the items."""
    n, bits = 0, np.zeros(1 << FILTER_BITS, bool)
    for block in item_blocks(items, item_key, text, block_chars):
        n += 1
        for h in ItemIndex(block, window, budget).piece_hashes():
            bits[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return n, np.packbits(bits)


def _touched(documents: DataFrame, bits: np.ndarray, window: int, budget: int) -> DataFrame:
    """The rows (k, t) of which some piece-long run of words is in the filter: a superset of those with a passage."""
    shared = documents.sparkSession.sparkContext.broadcast(bits)  # 2 ** FILTER_BITS / 8 bytes
    lengths = {int(n) for m in range(1, window + 1) for n in np.diff(np.linspace(0, m, budget_of(m, window, budget) + 2).astype(int))}

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hit = np.zeros(len(batch), bool)
            for words, text in chunks(batch["t"].tolist()):
                for n in lengths:
                    place = (window_hashes(words, n) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                    at = np.flatnonzero(shared.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1)
                    hit[text[at]] = True
            yield batch[hit]

    return documents.mapInPandas(keep, "k long, t string")


def leaks(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", window: int = WINDOW, budget: int = 2, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_key, item_key, words, edits): documents in which a passage of the item occurs with at most ``budget`` word edits.

    Words are the maximal runs of letters and digits of the lower-cased text. words is the length of the passage: the
    window, or the whole item where that is shorter, with the budget scaled down to its length. Each block of items is
    broadcast (bounded by ``block_chars``) and documents are read against it without a shuffle; whole texts, whatever
    their length. With several blocks one pass over all documents keeps those that touch a filter of all pieces, and the
    blocks see only these. Keys are numbers. Null texts contain nothing, items without words occur nowhere. A document
    that is listed twice, or an item met in several blocks, gives one row with the least edits.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(doc_key).cast("long").alias("k"), F.col(text).alias("t")).where("t is not null and k is not null")
    blocks = item_blocks(items, item_key, text, block_chars)
    first, second = next(blocks, None), next(blocks, None)
    if second is not None:
        rows = durable(_touched(rows, _filter(items, item_key, text, window, budget, block_chars)[1], window, budget), "touched")
    found = []
    for block in [] if first is None else [first] if second is None else item_blocks(items, item_key, text, block_chars):
        shared = spark.sparkContext.broadcast(ItemIndex(block, window, budget))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = shared.value
            for batch in batches:
                hits = index.find(batch["t"].tolist())
                yield pd.DataFrame({"k": batch["k"].to_numpy()[hits["text"].to_numpy()], "item": hits["item"], "words": hits["words"], "edits": hits["edits"]})

        hits = rows.mapInPandas(search, "k long, item long, words int, edits int")
        if second is not None:
            hits = durable(hits, "hits")
            shared.destroy()
        found.append(hits)
    if not found:
        found = [spark.createDataFrame([], "k long, item long, words int, edits int")]
    every = found[0]
    for hits in found[1:]:
        every = every.unionByName(hits)
    return every.groupBy(F.col("k").alias(doc_key), F.col("item").alias(item_key), "words").agg(F.min("edits").alias("edits"))
