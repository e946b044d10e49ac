"""Trie join: all pairs of strings within a bounded edit distance, by Levenshtein automata over sharded tries.

Distance: insertions, deletions, substitutions, and transpositions of neighbours, each 1. A string is cut into
2k + 1 segments; k edits touch at most 2k of them (a transposition may touch two), so one segment survives, shifted by
what the edits before it insert or delete. The shard of a (length, segment number, segment text) has the strings with that segment as a trie, and is
asked by the strings that have the text near that place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

class Node:
    """The words of a sorted list that share their first ``depth`` letters; what is below is found when it is asked for."""

    __slots__ = ("_children", "_rests", "_skips", "depth", "words")

    def __init__(self, words: list[str], depth: int):
        self.words, self.depth = words, depth
        self._children = self._rests = self._skips = None

    def child(self, letter: str) -> Node | None:
        return self.children().get(letter)

    def children(self) -> dict[str, Node]:
        if self._children is None:
            by: dict[str, list[str]] = {}
            for w in self.words:
                if len(w) > self.depth:
                    by.setdefault(w[self.depth], []).append(w)
            self._children = {c: Node(ws, self.depth + 1) for c, ws in by.items()}
        return self._children

    def rests(self) -> dict[str, str]:
        """The words by what follows here."""
        if self._rests is None:
            self._rests = {w[self.depth :]: w for w in self.words}
        return self._rests

    def skips(self) -> dict[str, list[str]]:
        """The words by what follows after one more letter, whichever it is."""
        if self._skips is None:
            self._skips = {}
            for w in self.words:
                if len(w) > self.depth:
                    self._skips.setdefault(w[self.depth + 1 :], []).append(w)
        return self._skips


class Trie:
    """A trie that is traversed with the query's Levenshtein automaton."""

    def __init__(self, words: list[str]):
        self.root = Node(sorted(set(words)), 0)

    def near(self, query: str, k: int) -> list[str]:
        """Words within distance k of query.

        The automaton's states are (letters of the query read, edits left), advanced along the trie. A state without edits
        left needs the rest of the query as it is, and one with a single edit left the rest after it: both are looked up
        in the node's tables instead of being followed letter by letter, so with k = 1 only the query's own path is walked.
        """
        found, n = set(), len(query)
        stack, seen = [(self.root, 0, k)], set()
        while stack:
            node, i, left = stack.pop()
            if left == 0:
                if (w := node.rests().get(query[i:])) is not None:
                    found.add(w)
                continue
            if k > 1:
                if (id(node), i, left) in seen:
                    continue
                seen.add((id(node), i, left))
            swapped = None
            if i < n:
                if (child := node.child(query[i])) is not None:
                    stack.append((child, i + 1, left))
                if i + 1 < n and (other := node.child(query[i + 1])) is not None:
                    swapped = other.child(query[i])
            else:
                found.update(w for w in node.words if len(w) <= node.depth + left)
            if swapped is not None:
                stack.append((swapped, i + 2, left - 1))
            if left == 1:
                found.update(node.skips().get(query[i:], ()))
                if i < n:
                    found.update(node.skips().get(query[i + 1 :], ()))
                    if (w := node.rests().get(query[i + 1 :])) is not None:
                        found.add(w)
                continue
            for child in node.children().values():
                stack.append((child, i, left - 1))
                if i < n:
                    stack.append((child, i + 1, left - 1))
            if i < n:
                stack.append((node, i + 1, left - 1))
        return sorted(found)


def segments(length: int, k: int) -> list[tuple[int, int]]:
    """Start and length of the 2k + 1 segments of a string of that length."""
    parts = 2 * k + 1
    cut = [length * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


def shifts(n: int, size: int, segment: int, k: int) -> list[int]:
    """How far a segment of a string of ``size`` letters can have moved in one of n letters, k edits in all.

    Edits before the segment move it, edits after it make up the rest of the difference in length; before the first and
    after the last segment there is none.
    """
    rest = n - size
    return [s for s in range(-k, k + 1) if abs(s) + abs(rest - s) <= k and (segment > 0 or s == 0) and (segment < 2 * k or s == rest)]


def _keys(word: str, k: int) -> tuple[list[str], set[str]]:
    """Shards that the word is in, and those that it asks."""
    n = len(word)
    own = [f"{n}:{i}:{word[a : a + m]}" for i, (a, m) in enumerate(segments(n, k))]
    asks = {f"{size}:{i}:{word[a + s : a + s + m]}" for size in range(max(1, n - k), n + k + 1) for i, (a, m) in enumerate(segments(size, k)) for s in shifts(n, size, i, k) if 0 <= a + s <= n - m}
    return own, asks


def trie_join(words: DataFrame, k: int = 1) -> DataFrame:
    """(word, near): all pairs of different strings of the one-column frame within distance k, both ways.

    Repeated and null strings count once and not at all. Strings shorter than 2k + 1 letters have empty segments and
    so meet all strings of near lengths, of which there are few for so short ones. A shard's members stream through
    one trie; queries are looked up one by one.
    """
    distinct = words.toDF("word").where("word is not null").distinct()

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for w in batch["word"]:
                own, asks = _keys(w, k)
                rows += [(s, w, True) for s in own] + [(s, w, False) for s in asks]
            yield pd.DataFrame(rows, columns=["shard", "word", "member"])

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by shard with members first; a shard may run on into the next batch."""
        shard, members, trie = None, [], None
        for batch in batches:
            out = []
            for s, w, member in zip(batch["shard"], batch["word"], batch["member"]):
                if s != shard:
                    shard, members, trie = s, [], None
                if member:
                    members.append(w)
                elif members and members != [w]:
                    trie = trie or Trie(members)
                    out += [(w, x) for x in trie.near(w, k) if x != w]
            yield pd.DataFrame(out, columns=["word", "near"])

    rows = distinct.mapInPandas(spread, "shard string, word string, member boolean").repartition("shard").sortWithinPartitions("shard", F.desc("member"))
    return rows.mapInPandas(look, "word string, near string").distinct()
