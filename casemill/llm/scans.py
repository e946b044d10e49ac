"""Noise in text from scanned pages: running headers, page numbers, broken words, misread characters.

Two averaged perceptrons are trained here. One tells body lines from headers and page numbers by their position and
repetition on the pages. The other is a character editor: it labels the characters of a token with keep, replace, delete
(one for two), insert (two for one) and line-join, and the sequence of labels that scores best is the repair. It learns
from words of the corpus to which known misreadings were applied, with the counts of all words over all texts as its
lexicon; so no label is needed.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.plans.durable import durable

#: texts that the perceptrons are fitted on, at most; the lexicon and everything else cover all texts
SAMPLE = 600
#: share of all words from which a word is in the lexicon, which bounds its size
SHARE = 1e-6
#: counts of the lexicon are uses in so many words of the corpus, so that they mean the same at every size
REFERENCE = 1_700_000
#: uses in REFERENCE words: of a word that only the lexicon may correct, of a word whose break shows a page
FAMILIAR, KNOWN = 50, 5
# What scanners read -> what was printed.
MISREADINGS = [("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("1", "i"), ("1", "l"), ("l", "i"), ("i", "l"), ("0", "o"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("q", "g"), ("ri", "n"), ("ii", "u"), ("ii", "n"), ("cl", "d"), ("d", "cl"), ("rn", "m"), ("m", "rn"), ("li", "h"), ("h", "li"), ("h", "b"), ("b", "h"), ("vv", "w"), ("w", "vv"), ("u", "n"), ("n", "u"), ("n", "ri"), ("u", "ii"), ("o", "c"), ("y", "v"), ("|", "l"), ("tl", "d"), ("nn", "m"), ("m", "nn"), ("lc", "k")]
LETTERS = "abcdefghijklmnopqrstuvwxyz"
BOX = "□"
_BY_SEEN = defaultdict(list)
for _seen, _meant in MISREADINGS:
    _BY_SEEN[_seen].append(_meant)

_WORD = re.compile(r"[A-Za-z□][\w□|]*(?:[-'’][A-Za-z□][\w□|]*)*|\d[\w□|]*[a-z□][\w□|]*")
_BREAK = re.compile(r"-[ \t]*\n\s*")
_MARKS = re.compile(r"[.,;:!?()\[\]“”\"$%§¶–]+")
_ORDINAL = re.compile(r"\d+(?:st|nd|rd|th|s|d|a|b|c|[a-h]|k|m|bn|pm|am)(?:-\d+)?")
_NUMBER = re.compile(r"^\s*(?:(?P<bare>\d{1,4})|-\s?(?P<dash>\d{1,4})\s?-|\[\s?(?P<bracket>\d{1,4})\s?\]|\(\s?(?P<paren>\d{1,4})\s?\)|[Pp][a□]g[ec]\s+(?P<page>\d{1,4})(?:\s+of\s+\d+)?|(?P<of>\d{1,4})\s+of\s+\d{1,4})\s*$")
_EDGED = re.compile(r"\S {3,}\S|\d\s*$|^\s*\d|^ {5,}\S|^ {1,3}\S")
_FOLD = str.maketrans({"0": "o", "1": "l", "i": "l", "|": "l", "5": "s", "6": "b", "8": "b", "e": "c", "f": "t", "q": "g", BOX: ""})


@lru_cache(100_000)
def _bone(token: str) -> str:
    """# for a token that is mostly figures; else its letters, those that scanners confuse made equal."""
    if not token.isalpha():
        letters, digits = sum(map(str.isalpha, token)), sum(map(str.isdigit, token))
        if digits and digits >= letters and not (token[0].isalpha() and digits == 1):
            return "#"
    return re.sub(r"[^a-z]", "", token.translate(_FOLD).replace("rn", "m").replace("cl", "d").replace("rl", "n").replace("ll", "u"))


def skeleton(line: str) -> str:
    """A line without its numbers, with letters that scanners confuse made equal."""
    out = [b for b in map(_bone, line.lower().split()) if b]
    while out and out[0] == "#":
        out.pop(0)
    while out and out[-1] == "#":
        out.pop()
    return " ".join(out)


def edged(line: str) -> bool:
    """Whether a line can be a running header: with a number at an end or a gap inside, or set off from the margin."""
    if len(line) < 5:
        return False
    first, last = line[0], line[-1]
    if not (first == " " or last == " " or first.isdigit() or last.isdigit() or "   " in line) or last in ",;-":
        return False
    return bool(_EDGED.search(line))


def unbroken(text: str) -> str:
    """The text without the words at the two sides of a hyphen at a line's end."""
    parts, at = [], 0
    for m in _BREAK.finditer(text):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        parts.append(text[at:start])
        at = m.end()
        while at < len(text) and not text[at].isspace():
            at += 1
    return "".join(parts) + text[at:] if parts else text


class Perceptron:
    """Averaged multi-class perceptron over sets of feature names."""

    def __init__(self, weights: dict[str, dict[str, float]] | None = None):
        self.w: dict[str, dict[str, float]] = weights or {}
        self._sum: dict[tuple[str, str], float] = defaultdict(float)
        self._t = 0

    def scores(self, features: list[str], classes: list[str]) -> list[float]:
        out = [0.0] * len(classes)
        for f in features:
            row = self.w.get(f)
            if row:
                for k, c in enumerate(classes):
                    out[k] += row.get(c, 0.0)
        return out

    def update(self, good: list[tuple[str, str]], bad: list[tuple[str, str]]) -> None:
        for pairs, step in ((good, 1.0), (bad, -1.0)):
            for f, c in pairs:
                row = self.w.setdefault(f, {})
                row[c] = row.get(c, 0.0) + step
                self._sum[f, c] += step * self._t

    def tick(self) -> None:
        self._t += 1

    def average(self) -> None:
        for f, row in self.w.items():
            for c in row:
                row[c] -= self._sum[f, c] / max(1, self._t)
        self._sum.clear()


# ---------------------------------------------------------------- lines

CLASSES = ["body", "header", "page_number"]


class Page:
    """The lines of a text with what their neighbourhood says about furniture."""

    def __init__(self, text: str, common: dict[str, tuple[int, int]]):
        self.lines = text.split("\n")
        self.blank = [not x.strip() for x in self.lines]
        self.feed = [("\f" in x) for x in self.lines]
        self.printed = [k for k in range(len(self.lines)) if not self.blank[k]]
        self.number: dict[int, tuple[str, int]] = {}
        for k in self.printed:
            if (m := _NUMBER.match(self.lines[k].replace("\f", ""))):
                self.number[k] = (m.lastgroup or "bare", int(m[m.lastgroup]))
        self.chain = self._chain()
        self.common = common
        self.bones = {k: b for k in self.printed if k not in self.number and edged(self.lines[k].replace("\f", "")) and len(b := skeleton(self.lines[k])) > 3 and (self._apart(k) or self._usual(b))}
        self.times = Counter(self.bones.values())

    def _apart(self, k: int) -> bool:
        """Next to a blank line, a form feed, a page number or an edge of the text, or far from the margin."""
        return self.lines[k].replace("\f", "").startswith("      ") or any(not 0 <= j < len(self.lines) or self.blank[j] or self.feed[j] or j in self.number for j in (k - 1, k + 1)) or self.feed[k]

    def _usual(self, bone: str) -> bool:
        """A skeleton that many texts repeat."""
        df, again = self.common.get(bone, (0, 0))
        return df >= 5 and again * 8 >= df

    def _chain(self) -> set[int]:
        """Lines of the longest run of page numbers of one form that rise by one, or by a few where pages lack theirs."""
        best: list[int] = []
        for form in {f for f, _ in self.number.values()}:
            rows = [(k, v) for k, (f, v) in self.number.items() if f == form]
            reach: list[tuple[int, int]] = []  # length, previous
            for i, (k, v) in enumerate(rows):
                here = (1, -1)
                for j in range(max(0, i - 12), i):
                    step = v - rows[j][1]
                    if 1 <= step <= 3 and k - rows[j][0] >= 4 * step and reach[j][0] + 1 > here[0]:
                        here = (reach[j][0] + 1, j)
                reach.append(here)
            if reach:
                i = max(range(len(reach)), key=lambda i: reach[i][0])
                if reach[i][0] > len(best):
                    best = []
                    while i >= 0:
                        best.append(rows[i][0])
                        i = reach[i][1]
        return set(best) if len(best) > 1 else set()

    def _beside(self, k: int, blind: bool) -> list[str]:
        out = []
        for name, step in (("before", -1), ("after", 1)):
            j, gap = k + step, 0
            while 0 <= j < len(self.lines) and self.blank[j] and not self.feed[j] and gap < 3:
                j, gap = j + step, gap + 1
            if not 0 <= j < len(self.lines):
                out.append(f"{name}:edge")
            elif self.feed[j]:
                out.append(f"{name}:feed")
            elif j in self.chain and not blind:
                out.append(f"{name}:chain")
            elif j in self.number:
                out.append(f"{name}:number")
            elif j in self.bones and self.times[self.bones[j]] > 1:
                out.append(f"{name}:repeated")
            else:
                out.append(f"{name}:text{min(gap, 2)}")
        return out

    def features(self, k: int, blind: bool = False) -> list[str]:
        """blind: as if no page numbers followed one another, as in a text of one page."""
        chained, one = k in self.chain and not blind, blind or not self.chain
        line = self.lines[k].replace("\f", "")
        indent = len(line) - len(line.lstrip())
        out = ["bias", f"indent:{min(indent, 1)}", f"indent8:{indent >= 8}", *self._beside(k, blind)]
        if k in self.number:
            form, v = self.number[k]
            out += [f"number:{form}", f"number:{form}:{min(indent, 1)}", f"chain:{chained}:{one}", f"chain:{chained}:{one}:{form}:{min(indent, 1)}", f"digits:{len(str(v))}:{min(indent, 1)}"]
        b = self.bones.get(k)
        if b:
            n, (df, again) = self.times[b], self.common.get(b, (0, 0))
            first, last = bool(re.match(r"\s*\d", line)), bool(re.search(r"\d\s*$", line))
            gap = bool(re.search(r"\S {2,}\S", line))
            out += [f"times:{min(n, 4)}", f"again:{round(4 * again / df) if df else -1}", f"again:{round(4 * again / df) if df else -1}:{min(n, 2)}", f"ends:{first}{last}:{gap}", f"gap:{gap}:{' v. ' in line}", f"words:{min(len(b.split()), 9)}"]
        return out

    def weak(self, k: int) -> str | None:
        """A label that is right where the page shows it beyond doubt, None where it doesn't; used to train only."""
        if len(self.lines[k]) > 110:
            return None  # a paragraph's line tells little about the furniture that lines near it are
        if k in self.number:
            if k in self.chain:
                return "page_number" if len(self.chain) > 2 else None
            indented = self.lines[k][:1].isspace()
            return None if indented and not self.chain else "body"
        b = self.bones.get(k, "")
        df, again = self.common.get(b, (0, 0))
        if "after:number" in self._beside(k, False):
            return "body"
        if self.times[b] > 2 and (again * 8 >= df or not df) or again * 8 >= df >= 20:
            return "header"
        return "body" if again * 8 < df or self.times[b] == 1 and not df else None

    def candidates(self) -> list[int]:
        return [*self.number, *self.bones]


def train_lines(texts: list[str], common: dict[str, tuple[int, int]], rounds: int = 4) -> Perceptron:
    p, rows = Perceptron(), []
    for t in texts:
        page = Page(t, common)
        for k in page.candidates():
            if label := page.weak(k):
                rows += [(page.features(k, blind), label) for blind in (False, True)]
    rng = random.Random(3)
    for _ in range(rounds):
        rng.shuffle(rows)
        for features, label in rows:
            p.tick()
            s = p.scores(features, CLASSES)
            guess = CLASSES[max(range(3), key=s.__getitem__)]
            if guess != label:
                p.update([(f, label) for f in features], [(f, guess) for f in features])
    p.average()
    return p


# ---------------------------------------------------------------- words


class Editor:
    """Averaged perceptron over the operations on the characters of a token.

    A label stands at every character: keep it, replace it, delete it (as the second of two that were one), insert one
    after it (as one that was two), or, for the hyphen at a line's end, join the lines. A sequence of labels scores the
    sum of its places' features and of features of the word it makes; the best sequence is the repair.
    """

    def __init__(self, weights: dict[str, float] | None = None):
        self.w: dict[str, float] = weights or {}
        self._sum: dict[str, float] = defaultdict(float)
        self._t = 0

    def score(self, features: list[str]) -> float:
        get = self.w.get
        return sum(get(f, 0.0) for f in features)

    def learn(self, good: list[str], bad: list[str]) -> None:
        for features, step in ((good, 1.0), (bad, -1.0)):
            for f in features:
                self.w[f] = self.w.get(f, 0.0) + step
                self._sum[f] += step * self._t

    def average(self) -> None:
        for f, total in self._sum.items():
            self.w[f] -= total / max(1, self._t)
        self._sum.clear()
        self._t = 0


#: a run of edits in a token: (place, characters read, characters meant)
Edit = tuple[int, str, str]
#: edits beside each other in a word that are looked up in the lexicon, and letters of the longest token that is
MOST_EDITS, LONGEST = 2, 40


def edits_of(word: str, capital: bool = False) -> list[Edit]:
    """Every single run of labels that undoes a misreading. The misreadings are those of small letters, so a capital stays."""
    out = []
    for i, c in enumerate(word):
        if capital and i == 0 and c in LETTERS:
            continue
        if c == BOX:
            out += [(i, c, x) for x in LETTERS]
            continue
        out += [(i, c, meant) for meant in _BY_SEEN.get(c, ())]
        pair = word[i : i + 2]
        out += [(i, pair, meant) for meant in _BY_SEEN.get(pair, ())]
    return out


def apply(word: str, edits: tuple[Edit, ...]) -> str:
    """The word with the edits, which are in order and apart."""
    out, at = [], 0
    for i, seen, meant in edits:
        out += [word[at:i], meant]
        at = i + len(seen)
    return "".join(out) + word[at:]


def labels(edit: Edit) -> list[str]:
    """The labels of an edit's characters."""
    _, seen, meant = edit
    if len(seen) == len(meant):
        return [f"replace {seen}>{meant}" if seen != BOX else f"replace {BOX}"]
    return [f"replace {seen[0]}>{meant}", f"delete {seen[1]}"] if len(seen) > 1 else [f"replace {seen}>{meant[0]}", f"insert {meant[1]}"]


def edit_features(word: str, edit: Edit) -> list[str]:
    """Features of an edit's labels and their surroundings."""
    i, seen, _ = edit
    name = "+".join(labels(edit))
    left, right = word[i - 1] if i else "^", word[i + len(seen)] if i + len(seen) < len(word) else "$"
    return [name, f"{name}|{left}", f"{name}||{right}", f"{name}|{_type(left)}{_type(right)}"]


def keep_features(word: str, i: int) -> list[str]:
    """Features of keeping a character that could be a misreading."""
    left, right = word[i - 1] if i else "^", word[i + 1] if i + 1 < len(word) else "$"
    return [f"keep {word[i]}", f"keep {word[i]}|{_type(left)}{_type(right)}"]


def _type(c: str) -> str:
    return "9" if c.isdigit() else "a" if c.isalpha() and c != BOX else c


def _rate(n: float) -> int:
    return min(14, int(math.log2(n + 1)))


def word_features(word: str, n: float, m: float, edits: int) -> list[str]:
    """Features of what the labels make: n and m are the counts of the word as read and as edited."""
    strange = any(c.isdigit() for c in word) or BOX in word or "|" in word
    size = min(len(word), 8)
    if not edits:
        return [f"same|{strange}", f"same|counts:{_rate(n)}", f"same|{strange}:{min(_rate(n), 3)}", f"same|len:{size}", f"same|ordinal:{bool(strange and _ORDINAL.fullmatch(word))}"]
    k = min(edits, 3)
    ratio = max(-6, min(12, _rate(m) - _rate(n)))
    out = [f"{k}|ratio:{ratio}", f"{k}|counts:{min(_rate(n), 6)}:{min(_rate(m), 8)}", f"{k}|{strange}:{min(_rate(m), 2)}", f"{k}|len:{size}"]
    if strange:
        out.append(f"figures:{min(sum(c.isdigit() for c in word), 3)}:{min(sum(c.isalpha() for c in word), 5)}:{word[0].isdigit()}:{m > 0}")
    return out


def local_features(edit: Edit, mine: int, theirs: int) -> list[str]:
    """Features of an edit of a word that the lexicon lacks, by uses of both in the same text."""
    return [f"local:{min(mine, 4)}:{min(theirs, 9)}", f"local:{max(-3, min(3, theirs - 2 * mine))}", "local " + "+".join(labels(edit))]


def certain_edits(editor: Editor, word: str, singles: list[Edit]) -> tuple[Edit, ...]:
    """The edits of figures whose own features beat keeping them, from left to right and apart: the best labels without a lexicon."""
    best: dict[int, tuple[float, Edit]] = {}
    for e in singles:
        if any(c in "0123456789|" for c in e[1]):
            s = editor.score(edit_features(word, e)) - editor.score(keep_features(word, e[0]))
            if s > 0 and s > best.get(e[0], (0.0, e))[0]:
                best[e[0]] = s, e
    out, end = [], 0
    for i in sorted(best):
        if i >= end:
            out.append(best[i][1])
            end = i + len(best[i][1][1])
    return tuple(out)


def options(editor: Editor, word: str, count, capital: bool = False) -> Iterator[tuple[tuple[Edit, ...], str, float]]:
    """(edits, result, count of the result) of the label sequences that are weighed against keeping the word.

    All sequences with one edit, or, where none makes a known word, with two, that make one; and the one that goes by
    the characters alone.
    """
    singles = edits_of(word, capital)
    if not singles:
        return
    known = False
    for e in singles:
        if (m := count(r := apply(word, (e,)))) > 0:
            known = True
            yield (e,), r, m
    if not known and len(word) <= LONGEST:
        for k, e in enumerate(singles):
            for f in singles[k + 1 :]:
                if f[0] >= e[0] + len(e[1]) and (m := count(r := apply(word, (e, f)))) > 0:
                    yield (e, f), r, m
    # without the lexicon only a character that no word has calls for an edit
    if (sure := certain_edits(editor, word, singles)):
        yield sure, (r := apply(word, sure)), count(r)


def sequence_features(word: str, n: float, edits: tuple[Edit, ...], m: float) -> tuple[list[str], list[str]]:
    """Features of a sequence of labels, and those of keeping the same places; the rest is kept in both."""
    changed = [f for e in edits for f in edit_features(word, e)] + word_features(word, n, m, len(edits))
    return changed, [f for e in edits for i in range(len(e[1])) for f in keep_features(word, e[0] + i)] + word_features(word, n, n, 0)


def best_edit(editor: Editor, word: str, n: float, count, capital: bool = False) -> tuple[str, list[int]] | None:
    """The best sequence of labels that isn't keep throughout, as (result, places), if it beats that one."""
    best, chosen = 0.0, None
    for edits, result, m in options(editor, word, count, capital):
        changed, kept = sequence_features(word, n, edits, m)
        if (s := editor.score(changed) - editor.score(kept)) > best:
            best, chosen = s, (result, [e[0] for e in edits])
    return chosen


def misread(word: str, times: int, rng: random.Random, only: str = "") -> tuple[str, tuple[Edit, ...]]:
    """The word as a scanner may read it, and the edits that undo it; ``only``: characters that the misreadings must show."""
    out, edits, at, shift = word, [], 0, 0
    reverse = [(seen, meant) for seen, meant in MISREADINGS if not only or any(c in only for c in seen)] + ([] if only else [(BOX, "")])
    spots = [(i, seen, meant) for seen, meant in reverse for i in range(len(word)) if meant and word.startswith(meant, i)]
    spots += [(i, BOX, word[i]) for i in range(len(word)) if not only and word[i] in LETTERS and rng.random() < 0.1]
    for i, seen, meant in sorted(rng.sample(spots, min(times, len(spots)))):
        if i >= at:
            out = out[: i + shift] + seen + out[i + shift + len(meant) :]
            edits.append((i + shift, seen, meant))
            shift += len(seen) - len(meant)
            at = i + len(meant)
    return out, tuple(edits)


def numeral(rng: random.Random) -> str:
    """A token of figures and few letters that isn't a word: an ordinal, a section, a court, or a misread number."""
    n = str(rng.randint(1, 999))
    kind = rng.random()
    if kind < 0.4:
        return n + rng.choice(["st", "nd", "rd", "th", "d", "s", *"abcdefghkm"])
    if kind < 0.75:
        return "".join(rng.choices(LETTERS, k=rng.randint(1, 2))) + str(rng.randint(0, 19))
    return "".join({"1": rng.choice("li"), "0": "o", "5": "s", "8": "b"}.get(c, c) if rng.random() < 0.5 else c for c in n)


def train_words(lexicon: dict[str, float], amount: int = 16_000, seed: int = 3) -> Editor:
    """Trained on words of the lexicon, half of them with one or two misreadings applied as a scanner would.

    A part of them is taken out of the lexicon, so that figures among letters and uses in the same text are learned too.
    """
    rng, editor = random.Random(seed), Editor()
    words = sorted(w for w, n in lexicon.items() if w.isalpha() and len(w) > 2)
    figures = sorted(w for w, n in lexicon.items() if n >= 16 and w.isalnum() and any(map(str.isdigit, w)) and any(map(str.isalpha, w)))
    figures = [w for w in figures if all(lexicon.get(apply(w, (e,)), 0) < 8 * lexicon[w] for e in edits_of(w))]
    if not words:
        return editor
    count = lambda w: lexicon.get(w, 0)
    drawn = rng.choices(words, [math.sqrt(lexicon[w]) for w in words], k=amount)

    def step(word: str, n: float, truth: tuple[Edit, ...], seen, hidden: bool = False) -> None:
        ways = [(e, sequence_features(word, n, e, m)) for e, _, m in options(editor, word, seen)]
        score = lambda f: editor.score(f[0]) - editor.score(f[1])
        meant = apply(word, truth)
        guess = max(ways, key=lambda x: score(x[1]), default=None)
        guess = guess if guess and score(guess[1]) > 0 else None
        right = next((x for x in ways if x[0] == truth), None) or next((x for x in ways if apply(word, x[0]) == meant), None)
        if truth and not right and hidden:
            right = truth, sequence_features(word, n, truth, 0)
        editor._t += 1
        if truth and right and (not guess or apply(word, guess[0]) != meant):
            editor.learn(right[1][0] + (guess[1][1] if guess else []), right[1][1] + (guess[1][0] if guess else []))
        elif not truth and guess:
            editor.learn(guess[1][1], guess[1][0])

    for word in drawn:
        draw = rng.random()
        if draw < 0.5:
            # a rare word beside a far more frequent one may be a misreading itself
            if lexicon[word] >= 2 * 8 or all(count(apply(word, (e,))) < 8 * max(1, lexicon[word]) for e in edits_of(word)):
                step(word, lexicon[word], (), count)
        elif draw < 0.9:
            read, truth = misread(word, 1 if draw < 0.8 else 2, rng)
            # a misreading that makes another common word can't be told by the word alone
            if truth and lexicon[word] >= 8 * max(1, count(read)):
                step(read, count(read), truth, count)
        elif draw < 0.935:
            read, truth = misread(word, rng.randint(1, 2), rng, "01568|")
            if truth:
                step(read, 0, truth, lambda w: 0, True)
        elif figures and draw < 0.945:
            word = rng.choice(figures)
            step(word, lexicon[word] if rng.random() < 0.5 else 0, (), lambda w, own=word: 0 if w == own else count(w))
        else:
            step(numeral(rng), 0, (), count)
    for word in drawn[: amount // 4]:
        # words that the lexicon lacks: a misreading of a name that the text uses more often, or a name beside another
        wrong = rng.random() < 0.5
        read, truth = misread(word, 1, rng)
        if not truth:
            continue
        mine, theirs = (1, rng.randint(2, 9)) if wrong else (rng.randint(1, 6), rng.randint(1, 6))
        if not wrong and theirs > 2 * mine:
            continue
        changed, kept = local_features(truth[0], mine, theirs), ["local:same"]
        editor._t += 1
        if (editor.score(changed) > editor.score(kept)) != wrong:
            editor.learn(*((changed, kept) if wrong else (kept, changed)))
    editor.average()
    return editor


def join_features(joined: float, kept: float, x: float, y: float, len_x: int, len_y: int, fixed: bool) -> list[str]:
    """Features of the label of a hyphen at a line's end; joined, kept, x, y: counts of the word, of the compound and of the two parts."""
    if joined > 1e-9 or kept > 1e-9:
        sign = "even" if joined == kept else "joined" if joined > kept else "kept"
        return [f"{sign}", f"{sign}:{max(-3, min(3, _rate(joined) - _rate(kept)))}"]
    low = min(x, y)
    return ["unseen", f"fixed:{fixed}", f"low:{min(_rate(low), 10)}", f"parts:{min(_rate(x), 10) // 3}:{min(_rate(y), 10) // 3}", f"short:{min(len_x, 4)}:{min(len_y, 4)}"]


def train_joins(repairer: Repairer, amount: int = 4_000, seed: int = 3) -> None:
    """Teaches the editor the line-join label: words of the lexicon broken anywhere, compounds at a hyphen.

    Half of them count as if the corpus had them nowhere else, as most words do that the lexicon lacks. The weights
    begin at the verdict of the counts.
    """
    rng, editor, lexicon = random.Random(seed), Editor(), repairer.lexicon
    editor.w = {"join joined": 1.0, "join even": 1.0, "hyphen kept": 1.0}
    whole = sorted(w for w in lexicon if w.isalpha() and len(w) > 4)
    compounds = sorted(w for w in lexicon if w.count("-") == 1 and all(len(x) > 1 and x.isalpha() for x in w.split("-")))
    pool = whole + compounds
    for word in rng.choices(pool, [math.sqrt(lexicon[w]) for w in pool], k=amount) if pool else ():
        hidden = lexicon[word] if rng.random() < 0.5 else 0
        if "-" in word:
            a, b = word.split("-")
            features, truth, other = repairer._evidence(a, b, Counter(), less_kept=hidden), "hyphen", "join"
        else:
            at = rng.randint(2, len(word) - 2)
            features, truth, other = repairer._evidence(word[:at], word[at:], Counter(), less_joined=hidden), "join", "hyphen"
        editor._t += 1
        lead = editor.score([f"join {f}" for f in features]) - editor.score([f"hyphen {f}" for f in features])
        if (lead >= 0) != (truth == "join"):
            editor.learn([f"{truth} {f}" for f in features], [f"{other} {f}" for f in features])
    editor.average()
    repairer.editor.w.update(editor.w)


# ---------------------------------------------------------------- texts


class Repairer:
    def __init__(self, lexicon: dict[str, float], common: dict[str, tuple[int, int]], lines: Perceptron, editor: Editor):
        self.lexicon, self.common, self.lines, self.editor = dict(lexicon), common, lines, editor
        for w, n in lexicon.items():
            if "-" in w:  # the parts of compounds are words too
                for part in w.split("-"):
                    self.lexicon[part] = self.lexicon.get(part, 0) + n
        self.memo: dict[bool, dict[str, tuple[str, list[int]] | None]] = {False: {}, True: {}}

    def global_edit(self, word: str, capital: bool = False) -> tuple[str, list[int]] | None:
        memo = self.memo[capital]
        if word not in memo:
            if len(memo) > 200_000:
                memo.clear()
            memo[word] = best_edit(self.editor, word, self.lexicon.get(word, 0), lambda w: self.lexicon.get(w, 0), capital)
        return memo[word]

    def edit(self, word: str, local: Counter, capital: bool = False) -> tuple[str, list[int]] | None:
        """As global_edit, and for words that the lexicon lacks, by their uses in the same text."""
        found = self.global_edit(word, capital)
        if found or self.lexicon.get(word, 0) > FAMILIAR:
            return found
        best, chosen, mine = 0.0, None, local[word]
        for e in edits_of(word):
            theirs = local.get(result := apply(word, (e,)), 0)
            if theirs > 1:
                s = self.editor.score(local_features(e, mine, theirs)) - self.editor.score(["local:same"])
                if s > best:
                    best, chosen = s, (result, [e[0]])
        return chosen

    def _evidence(self, first: str, second: str, local: Counter, less_joined: float = 0, less_kept: float = 0) -> list[str]:
        """Features of a break, from counts without those of the word or compound that is left out."""
        a, b = first.lower(), second.lower()
        count = lambda w: self.lexicon.get(w, 0) + local.get(w, 0)
        x, tail = a.rpartition("-")[2], b.split("-")[0]
        joined = max(count(a + b), count(x + tail)) - less_joined
        kept = max(count(a + "-" + b), *(count(w + "-" + tail) for w in (a, x)), self.prefixes.get(x + "-" + tail, 0)) - less_kept
        known = lambda w: max(0.0, self.lexicon.get(w, 0) - less_kept)
        if less_joined:
            fix = best_edit(self.editor, a + b, 0, lambda w: self.lexicon.get(w, 0) if w != a + b else 0)
        else:
            fix = self.global_edit(a + b)
        fixed = bool(fix and count(fix[0]))
        return join_features(max(0.0, joined), max(0.0, kept), known(x), known(tail), len(x), len(tail), fixed)

    def join(self, first: str, second: str, local: Counter) -> bool:
        """The label of the hyphen between the two parts: whether it is only there because the line broke."""
        features = self._evidence(first, second, local)
        return self.editor.score([f"join {f}" for f in features]) >= self.editor.score([f"hyphen {f}" for f in features])

    def _words_broken(self, lines: list[str], broken: list[int]) -> int:
        """Line ends that break a word of the lexicon, which nothing but a page does."""
        parts = [(re.search(r"[A-Za-z]+-$", lines[k].rstrip()), re.match(r"\s*([a-z]+)", lines[k + 1])) for k in broken if k + 1 < len(lines)]
        return sum(1 for a, b in parts if a and b and self.lexicon.get((a[0][:-1] + b[1]).lower(), 0) >= KNOWN)

    @property
    def prefixes(self) -> dict[str, int]:
        """Counts of two neighbouring parts of compounds, so that off-balance counts from off-balance-sheet."""
        found = self.__dict__.get("_prefixes")
        if found is None:
            found = Counter()
            for w, n in self.lexicon.items():
                if "-" in w:
                    parts = w.split("-")
                    for x, y in zip(parts, parts[1:]):
                        found[f"{x}-{y}"] += n
            self.__dict__["_prefixes"] = found
        return found

    def read(self, text: str, want_text: bool = True) -> tuple[list[tuple[int, str]], str]:
        """((line number from 1, kind) of the noise, repaired text). A text that shows no page isn't touched."""
        page = Page(text, self.common)
        kinds: dict[int, str] = {}
        for k in page.candidates():
            s = self.lines.scores(page.features(k), CLASSES)
            c = CLASSES[max(range(3), key=s.__getitem__)]
            if (c == "page_number") == (k in page.number) and c != "body":
                kinds[k] = c
        broken = [k for k, x in enumerate(page.lines) if x.rstrip().endswith("-") and len(x.rstrip()) > 1 and x.rstrip()[-2].isalpha()]
        if not kinds and self._words_broken(page.lines, broken) < 2:
            return [], text
        local = Counter(w.lower() for w in _WORD.findall(unbroken(text)))
        noise = [(k + 1, c) for k, c in kinds.items()]
        bad: set[int] = set()
        body = [k for k in range(len(page.lines)) if k not in kinds and not page.blank[k]]
        following = dict(zip(body, body[1:]))
        fixes: dict[int, dict[str, str]] = defaultdict(dict)
        joins: dict[int, bool] = {}
        skip_last, skip_first = set(), set()
        for k in broken:
            nxt = following.get(k)
            if k in kinds or nxt is None:
                continue
            first = re.search(r"[\w□|-]+-$", page.lines[k].rstrip())
            second = re.match(r"\s*([\w□|]+(?:-[\w□|]+)*)", page.lines[nxt])
            if not first or not second:
                continue
            a, b = first[0][:-1], second[1]
            skip_last.add(k)
            skip_first.add(nxt)
            joins[k] = self.join(a, b, local)
            if joins[k]:
                noise.append((k + 1, "hyphen"))
            word = (a.rpartition("-")[2] + b.split("-")[0] if joins[k] else "").lower()
            if word and (fix := self.edit(word, local, a[:1].isupper())):
                head = len(a.rpartition("-")[2])
                bad.update(k if place < head else nxt for place in fix[1])
                fixes[k]["\n"] = fix[0]
        common = self.lexicon
        for k in body:
            words = _WORD.findall(page.lines[k])
            if k in skip_last and words:
                words = words[:-1]
            if k in skip_first and words:
                words = words[1:]
            for w in words:
                low = w.lower()
                if common.get(low, 0) > FAMILIAR and not self.memo[w[:1].isupper()].get(low, True):
                    continue
                at = 0
                for part in re.split(r"[-'’]", low) if not low.isalnum() else (low,):
                    if len(part) > 2 and (fix := self.edit(part, local, w[at : at + 1].isupper())):
                        bad.add(k)
                        fixes[k][part] = fix[0]
                    at += len(part) + 1
        noise += [(k + 1, "misread") for k in bad]
        return sorted(noise), self._text(page, kinds, joins, fixes) if want_text else ""

    def _text(self, page: Page, kinds: dict[int, str], joins: dict[int, bool], fixes: dict[int, dict[str, str]]) -> str:
        paragraphs: list[str] = []
        run, glue, after_furniture = "", "", False
        width = sorted(len(x) for x in page.lines if x.strip())
        full = 0.7 * width[int(0.9 * (len(width) - 1))] if width else 0
        blank_before, last = False, ""
        for k, line in enumerate(page.lines):
            if k in kinds:
                after_furniture = True
                continue
            if page.blank[k]:
                blank_before = True
                continue
            for seen, meant in fixes.get(k, {}).items():
                if seen != "\n":
                    line = re.sub(rf"(?i)(?<![\w□]){re.escape(seen)}(?![\w□])", lambda m: meant.capitalize() if m[0][:1].isupper() and not m[0].isupper() else meant.upper() if m[0].isupper() else meant, line)  # noqa: B023
            stripped = line.strip()
            # a page's end is no paragraph's end unless the sentence ends too
            open_ = not re.search(r"[.!?:][\"”’)]*$", last)
            starts = (blank_before or line[:4] == "    ") and not (open_ and after_furniture) and not glue
            short = run and len(last) < full and not glue and not open_
            if run and (starts or (short and blank_before)):
                paragraphs.append(run)
                run = ""
            run = run[: len(run) - 1] + stripped if run and glue == "join" else run + stripped if run and glue == "keep" else (run + " " + stripped).strip()
            glue = "join" if joins.get(k) else "keep" if k in joins else ""
            blank_before, after_furniture, last = False, False, stripped
        return "\n\n".join([*paragraphs, run]) if run else "\n\n".join(paragraphs)


def fit(texts: DataFrame, sample: int = SAMPLE, share: float = SHARE) -> Repairer:
    """Lexicon and line skeletons over all texts, perceptrons on at most ``sample`` texts chosen by hash. texts: text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()
        bones: Counter = Counter()
        again: Counter = Counter()
        for batch in batches:
            for t in batch["text"]:
                words.update(_MARKS.sub(" ", unbroken(t).lower()).split())
                here = Counter(skeleton(x) for x in t.split("\n") if edged(x))
                bones.update(here.keys())
                again.update(k for k, n in here.items() if n > 2)
        for kind, found in (("w", words), ("b", bones), ("r", again)):
            yield pd.DataFrame([(kind, what, n) for what, n in found.items()], columns=["kind", "what", "n"])

    counted = durable(texts.mapInPandas(count, "kind string, what string, n long").groupBy("kind", "what").agg(F.sum("n").alias("n")), "lexicon")
    sizes = {r["kind"]: r["n"] for r in counted.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    least = {"w": max(3, share * sizes.get("w", 0)), "b": max(3, 1e-4 * sizes.get("b", 0))}
    kept = counted.where(((F.col("kind") == "w") & (F.col("n") >= least["w"])) | ((F.col("kind") != "w") & (F.col("n") >= least["b"]))).collect()  # at most 1 / share and 10,000 rows
    lexicon = {r["what"]: r["n"] * REFERENCE / sizes["w"] for r in kept if r["kind"] == "w"}
    again = {r["what"]: r["n"] for r in kept if r["kind"] == "r"}
    common = {r["what"]: (r["n"], again.get(r["what"], 0)) for r in kept if r["kind"] == "b"}
    # the sample's hashes first, so that no task sends texts that others outbid; equal texts count once
    h = texts.withColumn("h", F.xxhash64("text"))
    chosen = [r["h"] for r in h.select("h").distinct().orderBy("h").limit(sample).collect()]
    drawn = [r["text"] for r in h.where(F.col("h").isin(chosen)).groupBy("h").agg(F.min("text").alias("text")).orderBy("h").collect()] if chosen else []
    repairer = Repairer(lexicon, common, train_lines(drawn, common), Editor())
    repairer.editor = train_words(repairer.lexicon)
    train_joins(repairer)
    return repairer


def repair(records: DataFrame, key: str, text: str, with_text: bool = True, repairer: Repairer | None = None) -> DataFrame:
    """(key, noise array<struct<line_no, kind>>, text): the noise found in each text and the text without it.

    Kinds: header, page_number, hyphen, misread; lines are split at line feeds and counted from 1. A text without page
    furniture and broken words counts as not scanned and is returned as it is, without noise. Null texts are left out, blank ones have no
    noise. Rows come out as often as they go in. Each text is read whole by one task.
    """
    rows = records.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    shared = records.sparkSession.sparkContext.broadcast(repairer or fit(rows.select("text")))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repairer = shared.value
        for batch in batches:
            out = []
            for k, t in zip(batch["key"], batch["text"]):
                noise, clean = repairer.read(t, with_text)
                out.append((k, [{"line_no": n, "kind": c} for n, c in noise], clean if with_text else None))
            yield pd.DataFrame(out, columns=["key", "noise", "text"])

    kind = dict(records.dtypes)[key]
    return rows.mapInPandas(read, f"key {kind}, noise array<struct<line_no: int, kind: string>>, text string").withColumnRenamed("key", key)
