"""Variant spellings of names typed by people: from spellings to entities.

Each distinct spelling is read once: titles and remarks are dropped, abbreviations expanded, parts found. Every part
of every name (surnames, given names, firms' own names, lines of business) meets the parts within one edit through one
trie join; a rare part is read as the far more used one beside it, a short one only where the name's other part agrees.
Then the orders of a person's parts are checked: of two orders the one that more names have is taken. Spellings whose
heads (surname, or a firm's own name) agree form a family, and within it given names are compared with nicknames and
initials, businesses with abbreviations and legal forms.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.trie_join import trie_join
from casemill.plans.durable import durable

# Common English word lists.
#: kinds of firms, with their usual abbreviations
KINDS = {
    "partners": "ptnrs prtnrs ptrs partner",
    "holdings": "hldg hldgs holding",
    "services": "svcs svc servs serv service",
    "systems": "sys syst systs system",
    "industries": "inds ind indus industry",
    "international": "intl internatl int",
    "technologies": "tech techs technology",
    "resources": "rsrcs rsrc res resource",
    "group": "grp",
    "enterprises": "ents enterprise",
    "solutions": "solns solution",
    "associates": "assocs assoc",
    "ventures": "venture",
    "management": "mgmt mgt",
    "capital": "",
    "bancorp": "",
}
#: legal forms
FORMS = {"inc": "inc incorporated", "corp": "corp corporation", "ltd": "ltd limited", "llc": "llc", "lp": "lp limitedpartnership", "llp": "llp", "plc": "plc", "co": "co company", "bros": "bros"}
#: nicknames, by given name
NICKNAMES = {
    "abigail": "abby", "albert": "al bert", "alexander": "alex sandy", "alexandra": "alex sandy lexi", "andrew": "andy drew", "anthony": "tony",
    "arthur": "art artie", "barbara": "barb barbie", "benjamin": "ben benny", "calvin": "cal", "catherine": "cathy kate katie", "charles": "charlie chuck",
    "christine": "chris chrissy tina", "christopher": "chris", "clifford": "cliff", "constance": "connie", "cynthia": "cindy", "daniel": "dan danny",
    "david": "dave", "deborah": "deb debbie", "dorothy": "dot dottie dolly", "douglas": "doug", "edward": "ed eddie ted ned", "eleanor": "ellie nell nora",
    "elizabeth": "beth liz betty lizzie eliza", "ernest": "ernie", "eugene": "gene", "florence": "flo", "frederick": "fred freddy", "gabrielle": "gabby",
    "gerald": "gerry jerry", "gilbert": "gil bert", "gregory": "greg", "gustavo": "gus", "harold": "hal harry", "henry": "hank harry", "jacqueline": "jackie",
    "james": "jim jimmy jamie", "jeffrey": "jeff", "jennifer": "jen jenny", "john": "jack johnny", "jonathan": "jon", "joseph": "joe joey", "josephine": "jo josie",
    "joshua": "josh", "judith": "judy", "katherine": "kate kathy katie", "kenneth": "ken kenny", "kimberly": "kim", "lawrence": "larry", "leonard": "len lenny leo",
    "margaret": "maggie meg peggy", "martin": "marty", "matthew": "matt", "michael": "mike mick", "milton": "milt", "nathaniel": "nate nat", "nicholas": "nick",
    "oscar": "ozzie", "pamela": "pam", "patricia": "pat patty trish tricia", "patrick": "pat paddy", "penelope": "penny", "peter": "pete", "philip": "phil",
    "raymond": "ray", "rebecca": "becky becca", "richard": "dick rick rich", "robert": "bob rob bobby", "ronald": "ron ronnie", "rosalind": "roz rosie",
    "samantha": "sam sammy", "samuel": "sam sammy", "stanley": "stan", "stephen": "steve", "steven": "steve", "susan": "sue susie", "suzanne": "sue suzy susie",
    "theodore": "ted theo teddy", "theresa": "terry tess tessa", "thomas": "tom tommy", "timothy": "tim", "veronica": "ronnie vera", "victoria": "vicky tori",
    "vincent": "vince vinny", "walter": "walt wally", "william": "bill will billy", "winifred": "winnie freddie", "zachary": "zach zack",
}
TITLES = "hon honorable judge justice chief magistrate senior district circuit presiding mr mrs ms miss dr prof esq usdj usmj"
SUFFIXES = "jr sr ii iii iv"
#: what may follow a name
REMARKS = r"\(.*?\)|\bet\.? al\b\.?|,? and (?:its|their|all) (?:\w+ ?)*|, an? [a-z ]*\b(?:company|corporation|partnership|firm|individual|entity)\b.*|,? (?:as|in (?:his|her|their)) (?:trustee|executor|administrator|receiver|guardian|capacity)\b.*|,? individually\b.*|,? (?:pro se|nominal defendant|deceased)\b.*|,? (?:d/?b/?a|f/?k/?a|a/?k/?a)\b.*"
#: words of placeholders: for somebody without a name, names put before them, for what isn't known, and for what it is
NOBODIES = "doe does roe roes"
PLAIN = "john jane jack jim richard mary baby minor"
UNKNOWN = "unknown unnamed unidentified anonymous undisclosed unassigned redacted sealed n/a none null tbd various fictitious"
GENERIC = (
    "defendant defendants plaintiff plaintiffs party parties person persons people individual individuals entity entities trader traders purchaser "
    "purchasers seller sellers officer officers director directors judge insider insiders tippee tippees account accounts holder holders owner owners "
    "investor investors shareholder shareholders employee employees agent agents witness witnesses corporation corporations company companies "
    "partnership partnerships business businesses affiliate affiliates name names"
)
AROUND = "the a an and or through thru to inclusive no nos number numbers et al other others of as yet i ii iii iv v vi vii viii ix x"
TO_COME = r"to be (?:named|determined|assigned|announced)"

_KIND = {a: k for k, v in KINDS.items() for a in [k, *v.split()]}
_FORM = {a: k for k, v in FORMS.items() for a in [k, *v.split()]}
_FULL = defaultdict(set)
for _name, _short in NICKNAMES.items():
    for _s in _short.split():
        _FULL[_s].add(_name)
_TITLES, _REMARKS, _TO_COME = frozenset(TITLES.split()), re.compile(REMARKS), re.compile(TO_COME)
_NOBODIES, _UNKNOWN, _AROUND = frozenset(NOBODIES.split()), frozenset(UNKNOWN.split()), frozenset(AROUND.split())
_FILL = frozenset([*PLAIN.split(), *GENERIC.split()])


def distance(a: str, b: str, most: int = 1) -> int:
    """Edits between a and b with transpositions; most + 1 if more than most."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
    return min(row[-1], most + 1)


def _dotted(m: re.Match) -> str:
    """L.L.C. and U.S.D.J. are one word, but D.R. are initials."""
    word = m[1].replace(".", "")
    return word + " " if word in _FORM or (len(word) > 2 and word in _TITLES) else m[1].replace(".", ". ")


def is_placeholder(text: str) -> bool:
    """Whether a lower-cased name as a whole stands for nobody known: "John Doe", "Does 1-10", "Unknown Defendants"; not "Doe Run Co"."""
    words = [w for w in re.findall(r"n/a|[^\W\d_]+", text) if w not in _AROUND]
    named = [w for w in words if w not in _NOBODIES and w not in _UNKNOWN]
    return bool(_TO_COME.match(text)) or (len(named) < len(words) and all(w in _FILL for w in named))


def read_name(name: str) -> dict | None:
    """The parts of a spelling; None for blanks and placeholders, which denote nobody.

    person: {org: False, head, given, middle, turned: the three if the first part is the surname, None if a comma or
    initials leave no doubt}; firm: {org: True, core: parts that are neither kind nor legal form, kind,
    form}. Empty strings stand for what is missing.
    """
    text = " ".join(name.lower().replace("’", "'").split())
    if not re.search(r"\w", text) or is_placeholder(text):
        return None
    text = " ".join(_REMARKS.sub(" ", text).split()).strip(" ,;")
    if is_placeholder(text):
        return None
    text = re.sub(r"\bthe (?=\w)", "", text).replace("'", "")
    text = re.sub(r"\b((?:\w\.){2,}\w?)(?=\W|$)", _dotted, text)
    text = re.sub(r"\blimited partnership\b", "limitedpartnership", text)
    sides = [[t for t in re.findall(r"\w+(?:-\w+)*", side) if t not in _TITLES] for side in text.split(",")]
    sides = [s for s in sides if s]
    if sum(map(len, sides)) > 2 and sides[-1][-1] in SUFFIXES.split():  # else SR are initials
        sides = [s for s in [*sides[:-1], sides[-1][:-1]] if s]
    tokens = [t.replace("-", "") for s in sides for t in s]
    if not tokens:
        return None
    forms = [t for t in tokens if t in _FORM]
    kinds = [t for t in tokens if t in _KIND]
    if forms or kinds or len(tokens) == 1:
        core = [t for t in tokens if t not in _FORM and t not in _KIND]
        if not core:
            core, kinds = tokens[:1], []
        return {"org": True, "core": core, "kind": _KIND[kinds[0]] if kinds else "", "form": _FORM[forms[0]] if forms else ""}
    if len(sides) > 1:  # surname first
        head, rest = sides[0][-1], [*sides[1], *sides[0][:-1]]
    else:
        head, rest = sides[0][-1], sides[0][:-1]
    rest = [x for t in rest for x in (t if len(t) == 2 and t not in _FULL else [t])]  # ML: two initials
    if len(head) == 1 and any(len(t) > 1 for t in rest):
        head, rest = max(rest, key=len), [t for t in rest if t != max(rest, key=len)] + [head]
    plain = [t.replace("-", "") for t in (*rest, head)]
    turned = None
    if len(sides) == 1 and len(plain) > 1 and len(plain[0]) > 1 and len(plain[1]) > 1:
        turned = (plain[0], plain[1], plain[2][0] if len(plain) > 2 else "")
    elif len(sides) == 1 and len(plain) > 2 and len(plain[0]) > 1 and len(plain[-1]) > 1:  # an initial between: Smith J. Robert
        turned = (plain[0], plain[-1], plain[1][0])
    return {"org": False, "head": plain[-1], "given": plain[0] if rest else "", "middle": rest[1][0] if len(rest) > 1 else "", "turned": turned}


@lru_cache(100_000)
def _proper(given: str) -> str:
    """The listed given name that a typo of it means, if only one is near."""
    if len(given) < 4 or given in NICKNAMES or given in _FULL:
        return given
    near = [k for k in NICKNAMES if distance(k, given) <= 1]
    return near[0] if len(near) == 1 else given


def given_alike(a: str, b: str) -> bool:
    """Both spell one given name: equal, a nickname of the other, or one edit apart."""
    if a == b or _proper(a) == _proper(b) or _proper(a) in _FULL.get(b, ()) or _proper(b) in _FULL.get(a, ()):
        return True
    return len(a) > 3 and len(b) > 3 and not (a in NICKNAMES and b in NICKNAMES) and distance(a, b) <= 1


def business_alike(a: str, b: str) -> bool:
    """Both spell one line of business: equal, an abbreviation of the other, or one edit apart."""
    short, long = sorted((a, b), key=len)
    return a == b or (len(short) >= 3 and long.startswith(short)) or (len(short) > 4 and distance(a, b) <= 1)


def _cluster(values: Counter, alike) -> dict[str, int]:
    """Groups of values: the more frequent lead, others join the first leader they are like."""
    leaders: list[list[str]] = []
    group: dict[str, int] = {}
    for v, _ in sorted(values.items(), key=lambda x: (-x[1], -len(x[0]), x[0])):
        for g, members in enumerate(leaders):
            if alike(members[0], v):
                group[v] = g
                members.append(v)
                break
        else:
            group[v] = len(leaders)
            leaders.append([v])
    return group


def persons(rows: list[dict]) -> list[str]:
    """An entity label for each spelling of a family of persons; spellings that fit several people keep to themselves."""
    full = Counter()
    for r in rows:
        if len(r["given"]) > 1:
            full[r["given"]] += r["n"]
    # true given names lead; nicknames that fit two of them lead nobody and join only where one fits
    proper = {_proper(g) for g in full}
    certain = Counter({g: n for g, n in full.items() if g not in _FULL or g in NICKNAMES or not _FULL[g] & proper})
    group = _cluster(certain, given_alike)
    names = defaultdict(list)
    for g, k in group.items():
        names[k].append(g)
    for g in full:
        if g not in group:
            fit = {k for k, members in names.items() if any(given_alike(g, m) for m in members[:1])}
            fit = fit or {k for k, members in names.items() if any(given_alike(g, m) for m in members)}
            if len(fit) == 1:
                group[g] = fit.pop()
            elif not fit:
                group[g] = next((group[h] for h in full if h in group and h not in certain and _FULL[h] & _FULL[g]), max([*group.values(), -1]) + 1)
            else:
                group[g] = -1
    middles: dict[int, Counter] = defaultdict(Counter)
    for r in rows:
        k = group.get(r["given"], -1)
        if k >= 0 and r["middle"]:
            middles[k][r["middle"]] += r["n"]
    leads = lambda g: names.get(group[g], [""])[0] == g
    # (group, middle) are the people; a group without any middle is one person
    people = {(k, m) for k in set(group.values()) if k >= 0 for m in (middles[k] or [""])}
    weight = {(k, m): middles[k][m] for k, m in people}
    initial = {k: {x[0] for g in full if group.get(g) == k for x in (g, *(_FULL[g] if g in _FULL and leads(g) else ()))} for k in group.values()}
    leader = {k: names[k][0][0] if names.get(k) else "" for k in group.values()}
    out = []
    for r in rows:
        g, m = r["given"], r["middle"]
        if g in group and group[g] >= 0:
            fit = [p for p in people if p[0] == group[g]]
        elif g in group:  # an ambiguous nickname
            fit = [p for p in people if any(given_alike(g, x) for x in names.get(p[0], ()))]
        elif g:
            fit = [p for p in people if leader[p[0]] == g] or [p for p in people if g in initial[p[0]]]
        else:
            fit = list(people)
        exact = [p for p in fit if p[1] == m] if m else fit
        if m and not exact:
            exact = [p for p in fit if not p[1]]
        if g in group and group[g] >= 0 and not m and len(exact) > 1:
            exact = [max(exact, key=lambda p: (weight[p], p[1]))]
        out.append(f"{exact[0][0]}:{exact[0][1]}" if len(exact) == 1 else f"?{g}:{m}")
    return out


def firms(rows: list[dict]) -> list[str]:
    """An entity label for each spelling of a family of firms; short forms that fit several sisters keep to themselves."""
    businesses = Counter()
    for r in rows:
        if r["business"]:
            businesses[r["business"]] += r["n"]
    group = _cluster(Counter({b: n + (len(b) > 4) * 1000 for b, n in businesses.items()}), business_alike)
    kinds, forms = defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        if r["business"]:
            kinds[group[r["business"]]][r["sort"]] += r["n"]
    people = set()
    for k, c in kinds.items():
        c.pop("", None)
        people |= {(k, x) for x in c} or {(k, "")}
    for r in rows:
        if r["business"] and r["form"]:
            for p in people:
                if p[0] == group[r["business"]] and r["sort"] in ("", p[1]):
                    forms[p][r["form"]] += r["n"]
    out = []
    for r in rows:
        fit = [p for p in people if (not r["business"] or p[0] == group[r["business"]]) and (not r["sort"] or p[1] in ("", r["sort"]))]
        if len(fit) > 1 and r["form"]:
            fit = [p for p in fit if not forms[p] or forms[p].most_common(1)[0][0] == r["form"]] or fit
        if r["form"] and not r["business"] and not r["sort"]:
            fit = [p for p in fit if not forms[p] or r["form"] in forms[p]]
        out.append(f"{fit[0][0]}:{fit[0][1]}" if len(fit) == 1 else f"?{r['business']}:{r['sort']}:{r['form'] if not r['business'] else ''}")
    return out


_PARTS = "struct<org:boolean,head:string,second:string,third:string,given:string,middle:string,sort:string,form:string,n_core:int,turned_head:string,turned_given:string,turned_middle:string>"


def _read(names: pd.Series) -> pd.DataFrame:
    rows = []
    for name in names:
        p = read_name(name) if isinstance(name, str) else None
        if p is None:
            rows.append((None,) * 12)
        elif p["org"]:
            core = p["core"]
            rows.append((True, core[0], core[1] if len(core) > 1 else None, "".join(core[2:]) or None, None, None, p["kind"], p["form"], len(core), None, None, None))
        else:
            rows.append((False, p["head"], None, None, p["given"], p["middle"], None, None, 1, *(p["turned"] or (None,) * 3)))
    return pd.DataFrame(rows, columns=["org", "head", "second", "third", "given", "middle", "sort", "form", "n_core", "turned_head", "turned_given", "turned_middle"]).astype({"n_core": "Int32"})


#: letters of a word that is read as its neighbour whatever stands beside it, and of one that is never: an edit to an
#: initial or to one of two letters makes another name
SURE, INITIALS = 5, 2


def followed(words: DataFrame, near: DataFrame, sure: int = SURE) -> DataFrame:
    """(tag, word, beside, lead): words beside which a neighbour is used far more. words: tag, word, beside, n; near: word, near.

    A rare spelling follows a neighbour used four times as often or more; of spellings used once or twice the lesser
    follows the greater, by use and then by the text. beside is the name's other part: a word of fewer than ``sure``
    letters follows only a neighbour used with the same one, and only one used four times as often. Longer words follow
    whatever is beside them, and have a null there. Words of up to INITIALS letters follow none.
    """
    by = durable(words.where("word <> ''").groupBy("tag", "word", "beside").agg(F.sum("n").alias("n")), "counts")
    total = by.groupBy("tag", "word").agg(F.sum("n").alias("n"))
    ahead = F.struct("n_near", "near") > F.struct("n", "word")
    rare = F.col("n") * 4 <= F.col("n_near")
    few = (F.length("near") >= sure) & (F.col("n") <= 2) & ((F.col("n_near") <= 2) | (F.col("n_near") > F.col("n")))
    best = F.max(F.struct("n_near", "near")).alias("m")
    long = total.where(F.length("word") >= sure).join(near, "word").join(total.toDF("tag", "near", "n_near"), ["tag", "near"])
    long = long.where((rare | few) & ahead).groupBy("tag", "word").agg(best).withColumn("beside", F.lit(None).cast("string"))
    short = by.where(F.length("word").between(INITIALS + 1, sure - 1) & (F.col("beside") != "")).join(near, "word").join(by.toDF("tag", "near", "beside", "n_near"), ["tag", "near", "beside"])
    short = short.where(rare & ahead & (F.length("near") > INITIALS)).groupBy("tag", "word", "beside").agg(best)
    return durable(long.unionByName(short).select("tag", "word", "beside", F.col("m.near").alias("lead")), "follow")


def led(rows: DataFrame, follow: DataFrame, word: str, beside: str, out: str, keep: list[str] = (), sure: int = SURE) -> DataFrame:
    """Adds ``out``: what the word is read as beside the other part; words of ``keep`` as themselves."""
    long = F.length(word) >= sure
    key = F.when(~long, F.col(beside))
    found = follow.select(F.col("tag").alias("_t"), F.col("word").alias("_w"), F.col("beside").alias("_b"), F.col("lead").alias("_l"))
    joined = rows.join(found, (F.col("tag") == F.col("_t")) & (F.col(word) == F.col("_w")) & key.eqNullSafe(F.col("_b")), "left")
    lead = F.when(~F.col(word).isin(list(keep)), F.col("_l")) if keep else F.col("_l")
    return joined.withColumn(out, F.coalesce(lead, F.col(word))).drop("_t", "_w", "_b", "_l")


def ordered(people: DataFrame) -> DataFrame:
    """The rows with the parts of each name in the order that more names have.

    people: kind, tag, name, n, head, given, middle and turned_head, turned_given, turned_middle (null where the order is certain).
    The turned order is taken if more uses have it than the order as typed; if as many do, or if no other name has either,
    by whether its surname is mostly a surname and its given name mostly a given name in other names; if that doesn't tell
    and both orders are used, by the text, so that all spellings of a pair come out the same way.
    """
    support = people.groupBy("tag", "head", "given").agg(F.sum("n").alias("s"))
    votes = people.select("tag", F.explode(F.array(F.struct(F.col("head").alias("w"), F.col("n").alias("v")), F.struct(F.col("given").alias("w"), (-F.col("n")).alias("v")))).alias("x"))
    votes = durable(votes.groupBy("tag", "x.w").agg(F.sum("x.v").alias("v")), "votes")
    rows = people.join(support.toDF("tag", "head", "given", "s1"), ["tag", "head", "given"])
    rows = rows.join(support.toDF("tag", "turned_head", "turned_given", "s2"), ["tag", "turned_head", "turned_given"], "left")
    rows = rows.join(votes.toDF("tag", "head", "v1"), ["tag", "head"], "left").join(votes.toDF("tag", "turned_head", "v2"), ["tag", "turned_head"], "left")
    typed, turned = F.col("s1"), F.coalesce("s2", F.lit(0))
    # heads and given names elsewhere: without what the two orders of this pair add
    as_head, as_given = F.coalesce("v2", F.lit(0)) + typed - turned, F.col("v1") - typed + turned
    fits, unfits = (as_head > 0) & (as_given < 0), (as_head < 0) & (as_given > 0)
    tie = F.when(fits, True).when(unfits, False).otherwise(F.col("turned_head") < F.col("head"))
    turn = F.when((typed == F.col("n")) & (turned == 0), fits).when(turned == typed, tie).otherwise(turned > typed)
    turn = F.col("turned_head").isNotNull() & turn
    part = lambda c: F.when(turn, F.col(f"turned_{c}")).otherwise(F.col(c)).alias(c)
    return rows.select("kind", "tag", "name", "n", part("head"), part("given"), part("middle"))


def entities(names: DataFrame, max_edits: int = 1) -> DataFrame:
    """(kind, name, entity) of the distinct spellings of a frame of names, for those that denote anybody.

    names: name, and kind if there are several kinds of names, which don't bear on one another and never share an entity.
    Work goes by distinct spelling: a name with a third of all rows is one spelling. Frequencies, roles of words and
    families cover all spellings. entity is a stable text. Repeated parts, ties and any order of rows give the same
    result: all choices fall by count, then by the text itself.
    """
    names = names if "kind" in names.columns else names.withColumn("kind", F.lit(""))
    counted = names.where("name is not null").groupBy("kind", F.trim("name").alias("name")).agg(F.count("*").alias("n"))
    read = durable(counted.withColumn("p", F.pandas_udf(_read, _PARTS)("name")).where("p.org is not null").select("kind", "name", "n", "p.*"), "names")
    firm = read.where("org")
    # words after a firm's own name more often than first, and after several, are lines of business
    votes = firm.where("n_core = 2").select("kind", F.explode(F.expr("array(struct(head as w, 1L as v, cast(null as string) as after), struct(second as w, -1L as v, head as after))")).alias("x"), "n")
    votes = durable(votes.groupBy("kind", F.col("x.w").alias("w")).agg(F.sum(F.col("x.v") * F.col("n")).alias("v"), F.countDistinct("x.after").alias("several")), "votes")
    firm = firm.join(votes.select("kind", F.col("w").alias("head"), F.col("v").alias("v1"), (F.expr("v < 0 and several > 1")).alias("b1")), ["kind", "head"], "left")
    firm = firm.join(votes.select("kind", F.col("w").alias("second"), F.col("v").alias("v2"), (F.expr("v < 0 and several > 1")).alias("b2")), ["kind", "second"], "left")
    turned = F.expr("n_core = 2 and coalesce(b1, false) and coalesce(v2, 0) > v1")
    turned3 = F.expr("n_core > 2 and coalesce(b1, false)")
    split = F.expr("n_core = 2 and not coalesce(b2, false) and length(head) <= 4")  # a name broken in two
    firm = firm.select(
        "kind", "name", "n",
        F.when(turned, F.col("second")).when(turned3, F.concat("second", "third")).when((F.col("n_core") > 2) | split, F.concat("head", "second")).otherwise(F.col("head")).alias("head"),
        F.when(turned | turned3, F.col("head")).when(F.col("n_core") > 2, F.col("third")).when(split, F.lit("")).otherwise(F.coalesce("second", F.lit(""))).alias("business"),
        "sort", "form", F.concat("kind", F.lit("o")).alias("tag"),
    )
    firm = durable(firm, "firms")
    person = read.where("not org").select("kind", F.concat("kind", F.lit("p")).alias("tag"), "name", "n", "head", "given", "middle", "turned_head", "turned_given", "turned_middle")
    # every part of every name through one trie join
    columns = [firm.select("head"), firm.select("business"), *(person.select(c) for c in ("head", "given", "turned_head", "turned_given"))]
    near = durable(trie_join(reduce(DataFrame.union, columns).toDF("word").where("word <> ''"), max_edits), "near")
    words = lambda rows, word, beside: rows.select("tag", F.col(word).alias("word"), F.coalesce(F.col(beside), F.lit("")).alias("beside"), "n")
    listed = sorted({*NICKNAMES, *_FULL})
    # a misspelt given name is read as the far more frequent one beside it, a listed one as itself
    heads = followed(words(person, "head", "given").unionByName(words(firm, "head", "business")), near)
    givens, lines = followed(words(person, "given", "head"), near, 4), followed(words(firm, "business", "head"), near)
    for head, given in (("head", "given"), ("turned_head", "turned_given")):
        person = led(led(person, heads, head, given, "_head"), givens, given, head, "_given", listed, 4).drop(head, given).withColumnsRenamed({"_head": head, "_given": given})
    person = ordered(durable(person, "people"))
    firm = led(led(firm, heads, "head", "business", "_head"), lines, "business", "head", "_business").drop("head", "business").withColumnsRenamed({"_head": "head", "_business": "business"})
    blank = lambda *names: [F.lit("").alias(c) for c in names]
    parts = firm.select("kind", "tag", "name", "n", F.lit(True).alias("org"), "head", "business", "sort", "form", *blank("given", "middle"))
    parts = parts.unionByName(person.select("kind", "tag", "name", "n", F.lit(False).alias("org"), "head", *blank("business", "sort", "form"), "given", "middle"))
    # heads lead one another once more, as a lead may follow a greater one
    placed = led(parts, heads.where("beside is null"), "head", "given", "family")

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by family; a family may run on into the next batch."""
        held: list[dict] = []

        def done() -> list[tuple[str, str]]:
            labels = (firms if held[0]["org"] else persons)(held)
            return [(r["kind"], r["name"], f"{r['tag']}:{r['family']}:{x}") for r, x in zip(held, labels)]

        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                if held and (r["tag"], r["family"]) != (held[0]["tag"], held[0]["family"]):
                    out += done()
                    held = []
                held.append(r)
            yield pd.DataFrame(out, columns=["kind", "name", "entity"])
        if held:
            yield pd.DataFrame(done(), columns=["kind", "name", "entity"])

    return placed.repartition("tag", "family").sortWithinPartitions("tag", "family", "name").mapInPandas(settle, "kind string, name string, entity string")


def link(records: DataFrame, key: str, name: str, kind: str | None = None) -> DataFrame:
    """(kind, key, entity): the entities that the names of each key denote; blank, absent and placeholder names denote nobody.

    kind: a column of kinds of records, which are never linked with each other; without it there is no kind in the result.
    """
    rows = records.select((F.col(kind) if kind else F.lit("")).alias("kind"), F.col(key).alias("key"), F.trim(F.col(name)).alias("name")).where("key is not null and name <> ''").distinct()
    found = rows.join(entities(rows.select("kind", "name")), ["kind", "name"])
    return found.select(*([F.col("kind").alias(kind)] if kind else []), F.col("key").alias(key), "entity").distinct()


def linked_pairs(linked: DataFrame, key: str, *by: str) -> DataFrame:
    """(by..., a, b), a < b: keys that share an entity, within equal ``by``."""
    x, y = linked.select(*by, F.col(key).alias("a"), "entity"), linked.select(*by, F.col(key).alias("b"), "entity")
    return x.join(y, [*by, "entity"]).where("a < b").select(*by, "a", "b").distinct()
