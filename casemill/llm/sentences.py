"""Sentence boundaries across languages and scripts by a hidden-event n-gram language model.

Between any two words a boundary event may be hidden. The model has the probability of the event after the last words,
of a word after the event, and of a word after the last word without it; forward-backward over these gives the
posterior of each event. It is trained on all documents without labels: ends of paragraphs are certain events, words
that go on in lower case are certainly none, and expectation maximisation settles the rest. So it learns which words
with a point are abbreviations, in any language, and, in a script without points, which spaces part sentences.

Text inside quotation marks and brackets holds no event, blank lines and the ends of headings and list items always do.
"""

from __future__ import annotations

import copy
import json
import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.plans.durable import durable

#: share of a language's places from which a word has probabilities of its own, which bounds their number
OWN_SHARE = 2e-4
ROUNDS = 3

# Punctuation.
ENDS = ".!?…。！？｡।॥؟۔"
SURE = "!?。！？｡।॥؟۔"
OPENERS = {"(": ")", "（": "）", "[": "]", "「": "」", "『": "』", "«": "»", "“": "”", "„": "“”", "【": "】"}
CLOSERS = frozenset("".join(OPENERS.values()))
BRACKETS = regex.compile("[" + regex.escape("".join({*OPENERS, *CLOSERS})) + "]")

#: frequent function words by language, to tell languages of one script apart
FUNCTION_WORDS = {
    "en": "the of and to in that is was on for by with as at it",
    "de": "der die das und nicht ist den von zu mit dem des auch auf dass",
    "fr": "le la les des du et est que en un une dans pas qui au",
    "es": "el la los las de que en y un una por del se con no",
    "it": "il lo la di che e un una per non del con gli nel della",
    "pt": "o a os as de que e do da em um uma para com não",
    "nl": "de het een van en in is dat op te met voor niet zijn aan",
}

_WIDE = r"\p{Han}\p{Hiragana}\p{Katakana}"
_POINT = regex.compile(rf"[{ENDS}]+")
_GAP = regex.compile(r"(?<=[\p{Thai}])\s+(?=[\p{Thai}])")
_BLOCK = regex.compile(r"\n\s*\n")
_MARK = regex.compile(r"\s*(?:\(\d{1,3}\)|\(\p{L}\)|\d{1,3}[.)]|\p{Ll}\)|[-•*–‣◦])\s+\S")
_HEAD_MARK = regex.compile(r"(?:[IVX]+|[A-H]|\d{1,2}(?:\.\d{1,2})*)\.\s+")
_DIGITS = regex.compile(r"\d+")
_LEAD = "".join(OPENERS) + "\"'¿¡*_"


_FLAT = "\n\t\f\r\v\u00a0\u202f\u2009\u2028\u2029"
_WIDE_LETTER = regex.compile(rf"[{_WIDE}]").match
_GOES_ON = regex.compile(r"[\p{Latin}\p{Cyrillic}\p{Greek}]").match
_WORD = regex.compile(r"\p{L}+")
_THAI, _THAI_END = regex.compile(r"\p{Thai}"), regex.compile(r"\p{Thai}$")
_TAIL = regex.compile(rf"[{ENDS}]*[^{ENDS}]*$")


def flattened(block: str) -> str:
    """The block with all kinds of single white space made spaces; positions stay."""
    for c in _FLAT[: 5 if block.isascii() else None]:
        if c in block:
            block = block.replace(c, " ")
    return block


_LANGUAGES = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_SCRIPTS = [(k, regex.compile(v)) for k, v in (("th", r"\p{Thai}"), ("ja", r"[\p{Hiragana}\p{Katakana}]"), ("zh", r"\p{Han}"), ("ru", r"\p{Cyrillic}"), ("ar", r"\p{Arabic}"), ("hi", r"\p{Devanagari}"), ("ko", r"\p{Hangul}"), ("el", r"\p{Greek}"))]
_FOREIGN = regex.compile(r"[^\p{Latin}\p{Common}\p{Inherited}]")


def language_of(text: str) -> str:
    """A name of the text's script, or of its language where the script is Latin; any stable grouping serves the model."""
    if not text.isascii() and _FOREIGN.search(text):
        best = max((len(x.findall(text)) * (3 if k in ("ja", "zh") else 1), k) for k, x in _SCRIPTS)
        if best[0] * 4 > len(text):
            return best[1]
    words = set(text.split())
    found = max((len(words & v), k) for k, v in _LANGUAGES.items())
    if not found[0]:  # a text in capitals, or of other languages
        words = set(text.lower().split())
        found = max((len(words & v), k) for k, v in _LANGUAGES.items())
    return found[1]


@lru_cache(200_000)
def normal(token: str) -> str:
    """A word with its figures reduced to their length (one or two, three, four and more)."""
    token = token.lstrip("\"'*_")
    return _DIGITS.sub(lambda m: "9" if len(m[0]) < 3 else "9" * min(len(m[0]), 4), token)[:24] if token[:1] else token


@lru_cache(200_000)
def shape(word: str) -> str:
    """What is left of a rare word: the kind of its first letter, whether it is one letter, points inside, its ending."""
    core = word.lstrip(_LEAD)
    lead = "(" if core != word else ""
    first = core[:1]
    kind = "9" if first.isdigit() else "U" if first.isupper() else "l" if first.islower() else "o" if first.isalpha() else "p"
    body = core.rstrip(ENDS + "".join(CLOSERS) + "\"',;:")
    size = "1" if len(body) == 1 else "3" if len(body) <= 4 else "+"
    inner = "." if "." in body else ""
    caps = "C" if len(body) > 1 and body.isupper() else ""
    return f"<{lead}{kind}{caps}{size}{inner}{core[len(body):][-3:]}>"


#: what stands before a word that an event goes before
START = "<^>"


def context(before: str) -> str:
    return START if before == START else shape(before)


def pairs_of(text: str) -> list[tuple[int, int]]:
    """Outermost matched quotations and brackets as (opener, closer); marks without a partner count for nothing."""
    stack: list[tuple[str, int]] = []
    found = []
    for m in BRACKETS.finditer(text):
        c, at = m[0], m.start()
        if c in CLOSERS:
            k = next((k for k in range(len(stack) - 1, -1, -1) if c in OPENERS[stack[k][0]]), None)
            if k is not None and not (c in OPENERS and stack[k][0] != "„"):
                found.append((stack[k][1], at))
                del stack[k:]
                continue
        if c in OPENERS:
            stack.append((c, at))
    found.sort()
    outer: list[tuple[int, int]] = []
    for a, b in found:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


def is_heading(line: str) -> bool:
    """A line of its own in capitals, or a marker with a few capitalised words, without an end mark."""
    if len(line) > 80 or line[-1:] in ENDS + ",;:":
        return False
    marked = _HEAD_MARK.match(line)
    body = line[marked.end() :] if marked else line
    words = _WORD.findall(body)
    if not words or any(c.isdigit() for c in body):
        return False
    if body.upper() == body and body.lower() != body and max(map(len, words)) > 3:
        return True
    return bool(marked) and len(words) <= 8 and all(w[0].isupper() or len(w) < 4 for w in words) and words[0][0].isupper()


def blocks_of(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole) of the runs that hold sentences; whole: a heading or list item, which is one unit."""
    begin = 0
    for m in [*_BLOCK.finditer(text), None]:
        end = m.start() if m else len(text)
        if "\n" not in text[begin:end]:
            line = text[begin:end]
            if line.strip():
                yield begin, end, bool(is_heading(line.strip()) or _MARK.match(line))
        else:
            start, at, ended = begin, begin, True
            while at < end:
                stop = text.find("\n", at, end)
                stop = end if stop < 0 else stop
                line = text[at:stop].strip()
                if line:
                    own = bool(ended and is_heading(line))
                    own = own or bool(ended and _MARK.match(text[at:stop]))
                    if own:
                        if text[start:at].strip():
                            yield start, at, False
                        yield at, stop, True
                        start = stop
                    ended = own or line.rstrip("".join(CLOSERS) + "\"' ")[-1:] in ENDS + ":" or bool(_THAI_END.search(line))
                at = stop + 1
            if text[start:end].strip():
                yield start, end, False
        begin = m.end() if m else end


def candidates_of(block: str) -> list[tuple[int, int, str, str, str]]:
    """(end, next, before, last, following) of the places of a block where an event may hide.

    end: after the last character of the sentence; next: the first of the following one. The words are normal forms.
    """
    flat = flattened(block)
    outer = pairs_of(flat)
    closing = {b: a for a, b in outer}
    out, k = [], 0
    size = len(flat)
    thai = _GAP.finditer(flat) if not flat.isascii() and _THAI.search(flat) else ()
    spots = [(m.start(), m.end(), True) for m in thai] + [(m.start(), m.end(), False) for m in _POINT.finditer(flat)]
    spots.sort()
    for start, end, gap in spots:
        if gap:
            after = end
            end = start
        else:
            while end < size:
                if end in closing:
                    end += 1
                elif flat[end] == " " and end + 1 < size and flat[end + 1] in "»”" and end + 1 in closing:
                    end += 2
                elif flat[end] in "\"'’" and (end + 1 == size or flat[end + 1] == " "):
                    end += 1
                else:
                    break
            after = end
            while after < size and flat[after] == " ":
                after += 1
        if after >= size:
            continue
        while k < len(outer) and outer[k][1] < end:
            k += 1
        if k < len(outer) and outer[k][0] < end:
            continue
        if gap:
            out.append((end, after, "", flat[max(0, end - 6) : end].rpartition(" ")[2], flat[after : after + 6].partition(" ")[0]))
            continue
        c = flat[after]
        if after == end and not (flat[start] in "。！？｡।॥؟۔" or c.isupper() or c in "¿¡“„«(") or c in ENDS + ",;:":
            continue
        if after == end and flat[start] == ".":
            # no space: only a new word of its own begins a sentence here
            nxt = flat[after + 1 : after + 2]
            if not (start and (flat[start - 1].islower() or flat[start - 1].isdigit() or flat[start - 1] in CLOSERS or flat[start - 1] == "%")) or (nxt == "." and flat[after + 2 : after + 3] != "g") or (c.isupper() and not (nxt.islower() or nxt in " .")):
                continue
        if flat[start] in "。！？｡" or (c > "⺀" and _WIDE_LETTER(c)):
            out.append((end, after, "", flat[start:end], flat[after : after + 2]))
            continue
        left = flat.rfind(" ", 0, start) + 1
        if left == start and start:  # a mark that stands alone after a space
            left = start
        before = flat[flat.rfind(" ", 0, max(0, left - 1)) + 1 : max(0, left - 1)] if left else "^"
        stop = flat.find(" ", after)
        out.append((end, after, normal(before), normal(flat[left:end].replace(" ", "")), normal(flat[after : stop if stop > 0 else size])))
    return out


def certain(last: str, following: str) -> bool | None:
    """What needs no model: a word in lower case goes on."""
    c = following.lstrip(_LEAD)[:1]
    if c.islower() and (c.isascii() or _GOES_ON(c)):
        return False
    return None


class Model:
    """Probabilities of the events, from counts of (before, last, following)."""

    def __init__(self, own: set[str], triples: list[tuple[str, str, str, int]], ends: Counter, starts: Counter, linked: list[tuple[str, str, str, int]] = ()):
        """triples: of places on their own; linked: of places in chains, whose posteriors come to learn()."""
        self.own = own
        self.triples, self.ends, self.start_seed = [*triples, *linked], ends, starts
        self.memo: dict = {}
        self.share = self._shares()
        seed = self._seed()
        self._count(seed)
        self.triples, self.seed = list(triples), seed[: len(triples)]
        self.seed_of = {(a, n): p for (_, a, n, _), p in zip(linked, seed[len(triples) :])}

    def learn(self, expected: list[tuple[str, str, str, float, float]] = ()) -> None:
        """A round of expectation maximisation. expected: (left, last, following, places, events) of the chains."""
        # the seed stays half of the evidence, so that a free bigram can't explain every event away
        posterior = [(self.alone(b, a, n) + p) / 2 for (b, a, n, _), p in zip(self.triples, self.seed)]
        posterior += [(e / c + self.seed_of[a, n]) / 2 for _, a, n, c, e in expected]
        alone, self.triples = self.triples, [*self.triples, *(x[:4] for x in expected)]
        self._count(posterior)
        self.triples = alone
        self.memo.clear()

    def settled(self) -> Model:
        """A copy without what only training needs."""
        model = copy.copy(self)
        model.memo = {}
        del model.triples, model.seed, model.seed_of
        return model

    def _shares(self) -> dict[str, float]:
        """The share of each word among the following words of its shape."""
        count, kind = Counter(), Counter()
        for _, _, n, c in self.triples:
            count[n] += c
            kind[shape(n)] += c
        for n, c in self.start_seed.items():
            count[n] += c
            kind[shape(n)] += c
        return {n: c / kind[shape(n)] for n, c in count.items()}

    def _seed(self) -> list[float]:
        """First posteriors: how much a word ends, and its follower begins, paragraphs as often as it stands elsewhere."""
        last, following = Counter(), Counter()
        for _, a, n, c in self.triples:
            last[a] += c
            following[n] += c
        whole, ends, starts = sum(last.values()) or 1, sum(self.ends.values()) or 1, sum(self.start_seed.values()) or 1
        r_end = {a: (self.ends[a] + 0.02) / ends * whole / (n + 1) for a, n in last.items()}
        r_start = {w: (self.start_seed[w] + 0.02) / starts * whole / (n + 1) for w, n in following.items()}
        out = []
        for _, a, n, _ in self.triples:
            fixed = certain(a, n)
            if fixed is not None:
                out.append(float(fixed))
            elif a[-1:] in SURE and a:
                out.append(0.98)
            else:
                out.append(min(0.98, max(0.01, min(1.0, 4 * r_end[a]) * (0.35 + 0.65 * min(1.0, 4 * r_start[n])))))
        return out

    def key(self, word: str) -> str:
        return word if word in self.own else shape(word)

    def _count(self, posterior: list[float]) -> None:
        self.after, self.event = Counter(), Counter()
        self.start, self.follow = Counter(), defaultdict(Counter)
        for a, n in self.ends.items():
            for k in {a, shape(a), "", *((a[-1],) if a else ())}:
                self.event[k] += n
                self.after[k] += n
        for n, c in self.start_seed.items():
            self.start[n] += c
            self.start[shape(n)] += c
        total = sum(self.start_seed.values())
        for (b, a, n, c), p in zip(self.triples, posterior):
            for k in {a, shape(a), "", (context(b), a)}:
                self.after[k] += c
                self.event[k] += c * p
            total += c * p
            for k in {n, shape(n)}:
                self.start[k] += c * p
                for x in {a, shape(a), ""}:
                    self.follow[x][k] += c * (1 - p)
        self.total = total + 1
        self.mass = {a: self.after[a] - self.event[a] for a in self.after}

    def p_event(self, before: str, last: str) -> float:
        p = (self.event[""] + 1) / (self.after[""] + 2)
        for k, weight in ((shape(last), 20), (last, 5), ((context(before), last), 20)):
            p = (self.event[k] + weight * p) / (self.after[k] + weight)
        return min(0.9999, max(1e-4, p))

    def p_word(self, counts: Counter, mass: float, word: str, back: float, weight: float) -> float:
        return (counts[word] + weight * back) / (max(0.0, mass) + weight)

    def p_start(self, word: str) -> float:
        by_shape = (self.start[shape(word)] + 0.01) / (self.total + 1)
        if word not in self.own:
            return by_shape
        # a fifth of the mass goes by how common the word is among its kind, wherever it stands
        return 0.8 * self.start[word] / self.total + 0.2 * by_shape * self.share.get(word, 0.05)

    def p_follow(self, last: str, word: str) -> float:
        s = shape(word)
        p = (self.follow[""][s] + 0.01) / (max(0.0, self.mass.get("", 0)) + 1)
        for k, weight in ((shape(last), 20), (last, 5)):
            p = self.p_word(self.follow[k], self.mass.get(k, 0), s, p, weight)
        if word not in self.own:
            return p
        q = p * self.share.get(word, 0.05)
        for k, weight in ((shape(last), 20), (last, 60)):
            q = self.p_word(self.follow[k], self.mass.get(k, 0), word, q, weight)
        return q

    def alone(self, before: str, last: str, following: str) -> float:
        """The posterior of a single event; rare words must be given as shapes already."""
        key = (before, last, following)
        p = self.memo.get(key)
        if p is None:
            fixed = certain(last, following)
            if fixed is not None:
                p = float(fixed)
            else:
                e = self.p_event(before, last)
                yes, no = e * self.p_start(following), (1 - e) * self.p_follow(last, following)
                p = yes / (yes + no)
            if len(self.memo) < 500_000:
                self.memo[key] = p
        return p

    def run(self, places: list[tuple[str, str, str]]) -> list[float]:
        """Posteriors of events of which each one's following word is the next one's last: forward-backward."""
        own = self.own
        places = [(shape(b), a if a in own else shape(a), n if n in own else shape(n)) for b, a, n in places]
        if len(places) == 1:
            return [self.alone(*places[0])]
        return [x[0][1] + x[1][1] for x in self.chain(places)]

    def chain(self, places: list[tuple[str, str, str]]) -> list[list[list[float]]]:
        """Posteriors [state before][state] of each place, whose words are shapes where rare; before the first: no event."""
        steps = []
        for b, a, n in places:
            fixed, rows = certain(a, n), []
            for left in (b, START):
                e = self.p_event(left, a)
                rows.append(((1 - e) * self.p_follow(a, n), 0.0 if fixed is False else e * self.p_start(n)))
            steps.append(rows)
        forward, backward = [[1.0, 0.0]], [[1.0, 1.0]]
        for rows in steps:
            x = [forward[-1][0] * rows[0][s] + forward[-1][1] * rows[1][s] for s in (0, 1)]
            forward.append([v / sum(x) for v in x])
        for rows in reversed(steps[1:]):
            x = [rows[left][0] * backward[-1][0] + rows[left][1] * backward[-1][1] for left in (0, 1)]
            backward.append([v / sum(x) for v in x])
        out = []
        for f, rows, later in zip(forward, steps, reversed(backward)):
            both = [[f[left] * rows[left][s] * later[s] for s in (0, 1)] for left in (0, 1)]
            total = sum(map(sum, both))
            out.append([[v / total for v in row] for row in both])
        return out


class Layout(NamedTuple):
    """What a text has for the model: its group, its blocks, and the places of blocks where an event may hide."""

    group: str
    starts: list[int]
    ends: list[int]
    #: a heading or list item, which is one unit
    whole: list[bool]
    #: of each block, how many of the places are its
    n_places: list[int]
    #: where a sentence ends at the place (exclusive), and where the next one begins
    stops: list[int]
    nexts: list[int]
    before: list[str]
    last: list[str]
    following: list[str]
    #: whether the place's last word is the following word of the place before it
    linked: list[bool]
    #: first and last words of the blocks that aren't whole
    firsts: list[str]
    lasts: list[str]


LAYOUT = "g string, starts array<int>, ends array<int>, whole array<boolean>, n_places array<int>, stops array<int>, nexts array<int>, before array<string>, last array<string>, following array<string>, linked array<boolean>, firsts array<string>, lasts array<string>"


def layout(text: str) -> Layout:
    out = Layout(language_of(text), *([] for _ in range(12)))
    for begin, end, whole in blocks_of(text):
        raw = text[begin:end]
        block = raw.strip()
        if not block:
            continue
        begin += len(raw) - len(raw.lstrip())
        out.starts.append(begin)
        out.ends.append(begin + len(block))
        out.whole.append(whole)
        places = [] if whole else candidates_of(block)
        if not whole:
            if places:
                stops, nexts, before, last, following = zip(*places)
                out.stops.extend([begin + stop for stop in stops])
                if not block.isascii():  # spaces that only wide scripts have
                    nexts = [at + len(block[at:]) - len(block[at:].lstrip()) if block[at].isspace() else at for at in nexts]
                out.nexts.extend([begin + at for at in nexts])
                out.before.extend(before)
                out.last.extend(last)
                out.following.extend(following)
                out.linked.append(False)
                out.linked.extend([a == n and stop - at <= len(a) + 2 for a, n, stop, at in zip(last[1:], following, stops[1:], nexts)])
            first, last = _ends_of(block)
            out.firsts.append(first)
            out.lasts.append(last)
        out.n_places.append(len(places))
    return out


def chains(x) -> Iterator[list[tuple[str, str, str]]]:
    """The (before, last, following) of each chain of a layout."""
    chain: list[tuple[str, str, str]] = []
    for before, last, following, linked in zip(x.before, x.last, x.following, x.linked):
        if chain and not linked:
            yield chain
            chain = []
        chain.append((before, last, following))
    if chain:
        yield chain


def cut(x, model: Model) -> list[tuple[int, int]]:
    """(start, end) of each sentence of a layout, counted from 0, end exclusive."""
    posterior = [p for chain in chains(x) for p in model.run(chain)]
    out, i = [], 0
    for begin, end, n in zip(x.starts, x.ends, x.n_places):
        for j in range(i, i + n):
            if posterior[j] >= 0.5:
                if x.stops[j] > begin:
                    out.append((begin, x.stops[j]))
                begin = x.nexts[j]
        i += n
        if end > begin:
            out.append((begin, end))
    return out


def sentences_of(text: str, models: dict[str, Model]) -> list[tuple[int, int]]:
    """(start, end) of each sentence, counted from 0, end exclusive. models: by language_of; the largest if it has none."""
    x = layout(text)
    return cut(x, models.get(x.group) or models.get("") or Model(set(), [], Counter(), Counter()))


def _last_words(block: str) -> tuple[str, str]:
    words = block.split()
    last = words[-1] if len(words) < 2 or words[-1].strip("".join(CLOSERS) + ENDS) else words[-2] + words[-1]
    return normal(words[0]), normal(last)


def _ends_of(block: str) -> tuple[str, str]:
    """First and last words of a block, or what stands for words in scripts without spaces."""
    if _THAI.match(block):
        return block[:6].partition(" ")[0], block[-6:].rpartition(" ")[2]
    if _WIDE_LETTER(block):
        return block[:2], _TAIL.search(block)[0][:3]
    return _last_words(block)


def laid_out(texts: DataFrame) -> DataFrame:
    """(k, layout columns) of the texts of (k, t): each is parsed once, and training and cutting read this table."""
    kind = dict(texts.dtypes)["k"]
    names = [c.split()[0] for c in LAYOUT.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [layout(t) for t in batch["t"]]
            yield pd.DataFrame(dict(zip(names, zip(*rows))) if rows else {c: [] for c in names}).assign(k=batch["k"].to_numpy())[["k", *names]]

    return durable(texts.where("t is not null").mapInPandas(parse, f"k {kind}, {LAYOUT}"), "layout")


def _expected(chains: DataFrame, models: dict[str, Model]) -> DataFrame:
    """(g, b, a, n, c, e): places of the chains by what stands before, and events among them, as the models expect them."""
    shared = chains.sparkSession.sparkContext.broadcast(models)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, e = Counter(), Counter()
        for batch in batches:
            for g, b, n in zip(batch["g"], batch["b"], batch["c"]):
                places = [tuple(x) for x in json.loads(b)]
                for (before, last, following), both in zip(places, shared.value[g].chain(places)):
                    for left, row in zip((before, START), both):
                        if sum(row) > 0:
                            c[g, left, last, following] += n * sum(row)
                            e[g, left, last, following] += n * row[1]
        yield pd.DataFrame([(*k, v, e[k]) for k, v in c.items()], columns=["g", "b", "a", "n", "c", "e"])

    return chains.mapInPandas(weigh, "g string, b string, a string, n string, c double, e double").groupBy("g", "b", "a", "n").agg(F.sum("c").alias("c"), F.sum("e").alias("e"))


def train(rows: DataFrame, share: float = OWN_SHARE) -> dict[str, Model]:
    """Models by language, of the layouts of all documents. Words with counts of their own are at most 1 / share a language.

    Words and places are counted where they lie; each language's model is fitted in a task of its own, from counts of
    own words and shapes only. Chains stay distributed and are weighed anew each round. What comes to the driver, to be
    broadcast, are the models.
    """
    spark = rows.sparkSession
    counted = rows.select("g", F.explode(F.concat("last", "following", "firsts", "lasts")).alias("w")).groupBy("g", "w").agg(F.count("*").alias("n"))
    counted = durable(counted, "words")
    totals = counted.groupBy("g").agg(F.sum("n").alias("total"))
    own: dict[str, set[str]] = defaultdict(set)
    for r in counted.join(F.broadcast(totals), "g").where((F.col("n") >= 3) & (F.col("n") >= share * F.col("total"))).collect():  # at most 1 / share words a language
        own[r["g"]].add(r["w"])
    shared = spark.sparkContext.broadcast(dict(own))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count: Counter = Counter()
        for batch in batches:
            for x in batch.itertuples(index=False):
                g, known = x.g, shared.value.get(x.g, ())
                key = lambda w: w if w in known else shape(w)  # noqa: B023, E731
                for chain in chains(x):
                    chain = [(shape(b), key(a), key(n)) for b, a, n in chain]
                    count.update((g, "u" if len(chain) > 1 else "t", *y) for y in chain)
                    if len(chain) > 1:
                        count[g, "c", json.dumps(chain), "", ""] += 1
                count.update((g, "s", "", "", key(w)) for w in x.firsts)
                count.update((g, "e", "", key(w), "") for w in x.lasts)
            if len(count) > 200_000:
                yield pd.DataFrame([(*k, n) for k, n in count.items()], columns=["g", "kind", "b", "a", "n", "c"])
                count.clear()
        yield pd.DataFrame([(*k, n) for k, n in count.items()], columns=["g", "kind", "b", "a", "n", "c"])

    needed = rows.select("g", "before", "last", "following", "linked", "firsts", "lasts")
    kinds = needed.mapInPandas(places, "g string, kind string, b string, a string, n string, c long").groupBy("g", "kind", "b", "a", "n").agg(F.sum("c").alias("c"))
    kinds = durable(kinds, "places")
    state = "g string, ends long, state binary, model binary"

    def packed(g: str, model: Model) -> pd.DataFrame:
        return pd.DataFrame({"g": [g], "ends": [sum(model.ends.values())], "state": [pickle.dumps(model)], "model": [pickle.dumps(model.settled())]})

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        g, found, linked, ends, starts = pdf["g"].iloc[0], [], [], Counter(), Counter()
        for kind, b, a, n, c in sorted(zip(pdf["kind"], pdf["b"], pdf["a"], pdf["n"], pdf["c"])):
            if kind == "e":
                ends[a] += c
            elif kind == "s":
                starts[n] += c
            else:
                (linked if kind == "u" else found).append((b, a, n, c))
        return packed(g, Model(shared.value.get(g, set()), found, ends, starts, linked))

    def learn(key: tuple, before: pd.DataFrame, expected: pd.DataFrame) -> pd.DataFrame:
        if before.empty:
            return before
        model = pickle.loads(before["state"].iloc[0])
        model.learn(sorted(zip(expected["b"], expected["a"], expected["n"], expected["c"], expected["e"])))
        return packed(key[0], model)

    chained = kinds.where("kind = 'c'").select("g", "b", "c")
    fitted = durable(kinds.where("kind <> 'c'").groupBy("g").applyInPandas(begin, state), "models")
    unpacked = lambda: {r["g"]: pickle.loads(r["model"]) for r in fitted.select("g", "model").collect()}
    for _ in range(ROUNDS):
        expected = _expected(chained, unpacked())
        fitted = durable(fitted.groupBy("g").cogroup(expected.groupBy("g")).applyInPandas(learn, state), "models")
    models = unpacked()
    largest = fitted.orderBy(F.desc("ends"), F.desc("g")).select("g").first()
    if largest:
        models[""] = models[largest["g"]]
    return models


def sentences(documents: DataFrame, key: str = "doc_id", text: str = "text", models: dict[str, Model] | None = None) -> DataFrame:
    """(key, sentence_no, start_pos, end_pos): the sentences of each text in order.

    Positions count characters from 1, both inclusive. Null and blank texts have none. A text that occurs under several
    keys is split under each. Texts of any length are read whole, one in one task.
    """
    kind = dict(documents.dtypes)[key]
    rows = laid_out(documents.select(F.col(key).alias("k"), F.col(text).alias("t")))
    shared = documents.sparkSession.sparkContext.broadcast(models or train(rows))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = shared.value
        other = models.get("") or Model(set(), [], Counter(), Counter())
        for batch in batches:
            out = [(x.k, i, a + 1, b) for x in batch.itertuples(index=False) for i, (a, b) in enumerate(cut(x, models.get(x.g) or other), 1)]
            yield pd.DataFrame(out, columns=["k", "sentence_no", "start_pos", "end_pos"])

    needed = rows.drop("whole", "firsts", "lasts")
    return needed.mapInPandas(split, f"k {kind}, sentence_no int, start_pos int, end_pos int").withColumnRenamed("k", key)
