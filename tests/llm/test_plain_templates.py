"""Template windows and slots against a plain matcher, and bitmaps of many windows."""

import random
import re

from lakespark.llm import decontaminate as D
from pyspark.sql import functions as F
from test_native import leaks

UNITS = ("km", "miles", "hours", "dollars")
NAMES = "Alice Bob Carol Dan Erin Frank".split()
WORDS = "the of in to a had sold gave took each then when boat road house tree apples stones very old new".split()


def tokens(text):
    """(type, value): a word has no type; in the second form names are words."""
    found = []
    for w in re.findall("[A-Za-z0-9]+", text):
        if w.isdigit():
            found.append(("number", w))
        elif found and found[-1][0] == "number" and w.lower() in UNITS:
            found.append(("unit", w.lower()))
        else:
            found.append(("name" if re.fullmatch("[A-Z][a-z]+", w) else "", w.lower()))
    return found, [("" if t == "name" else t, w) for t, w in found]


def canonical(window):
    return tuple(t or w for t, w in window)


def matches(doc, item):
    forms = list(zip(tokens(doc), tokens(item)))
    size = len(forms[0][1])
    if size < D.LEAST_WORDS:
        return None
    n = min(size, D.WINDOW)
    spots = range(size - n + 1)
    literal = {i for _, b in forms for i in spots if sum(not t for t, _ in b[i : i + n]) >= D.LITERAL}
    need = min(len(literal), 6)
    lines: dict = {}
    for d, b in forms:
        for i in spots:
            w = b[i : i + n]
            for j in range(len(d) - n + 1):
                v = d[j : j + n]
                same = [x[1] for x in w] == [x[1] for x in v] and [x[0] for x in w] == [x[0] for x in v]
                loose = sum(not t for t, _ in w) >= D.LITERAL
                if canonical(w) != canonical(v) or not loose and not same:
                    continue
                line = lines.setdefault(j - i, {"verbatim": set(), "held": {}})
                if same:
                    line["verbatim"].add(i)
                if loose or need == 6:
                    line["held"].setdefault(i, set()).update((t, x, y) for (t, x), (_, y) in zip(w, v) if t)
    kinds = set()
    for line in lines.values():
        if len(line["verbatim"]) >= min(len(spots), 6):
            kinds.add("verbatim")
            continue
        places = sorted(line["held"])
        for k in range(len(places) - need + 1) if need else ():
            pairs = {p for s in places if places[k] <= s <= places[k + need - 1] for p in line["held"][s]}
            names = {(x, y) for t, x, y in pairs if t == "name"}
            if len({(t, x) for t, x, _ in pairs}) == len(pairs) and len({y for _, y in names}) == len(names):
                kinds.add("reparameterised")
    return kinds


def made(rng, n):
    words = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.15 and (not words or not words[-1][0].isupper()):
            words.append(rng.choice(NAMES))
        elif kind < 0.3:
            words.append(str(rng.randint(1, 40)))
            if rng.random() < 0.4:
                words.append(rng.choice(UNITS))
        else:
            words.append(rng.choice(WORDS))
    return words


def changed(rng, words):
    """With other values: mostly one for each, sometimes not."""
    to = {}
    consistent = rng.random() < 0.7
    names = rng.sample(NAMES, len(NAMES)) if rng.random() < 0.8 else [rng.choice(NAMES)] * len(NAMES)
    found = []
    for w in words:
        if w in NAMES:
            w = names[NAMES.index(w)]
        elif w.isdigit():
            w = to.setdefault(w, str(rng.randint(1, 99))) if consistent else str(rng.randint(1, 99))
        elif w in UNITS and rng.random() < 0.5:
            w = to.setdefault(w, rng.choice(UNITS))
        elif rng.random() < 0.03:
            w = rng.choice(WORDS)
        found.append(w)
    return found


def test_against_a_plain_matcher(spark):
    rng = random.Random(11)
    items = [made(rng, rng.randint(4, 40)) for _ in range(25)]
    docs = []
    for k in range(160):
        body = made(rng, rng.randint(0, 15))
        piece = items[k % len(items)]
        piece = changed(rng, piece) if rng.random() < 0.8 else piece
        cut = rng.randint(0, len(piece) // 3) if rng.random() < 0.4 else 0
        # no name meets another, which would be a run of names
        docs.append(" ".join([*body, "and", *piece[cut:], "and", *made(rng, rng.randint(0, 5))]))
    got = leaks(spark, docs, [" ".join(w) for w in items])
    checked = {"verbatim": 0, "reparameterised": 0, "none": 0}
    for i, doc in enumerate(docs):
        for j, item in enumerate(items):
            want = matches(doc, " ".join(item))
            if want is None:
                continue
            assert ((i, j) in got) == bool(want), (doc, item, want)
            if want:
                assert got[i, j].reparameterised == ("verbatim" not in want), (doc, item, want)
            checked["verbatim" if "verbatim" in want else "reparameterised" if want else "none"] += 1
    assert min(checked.values()) > 10, checked


def test_different_names_meet_different_ones(spark):
    item = "when Alice sold the boat to Bob then Alice took the house of Bob and there Alice gave each tree to Bob"
    texts = [item.replace("Alice", "Carol").replace("Bob", "Dan"), item.replace("Alice", "Carol").replace("Bob", "Carol")]
    assert set(leaks(spark, texts, [item])) == {(0, 0)}


def test_the_bitmap_follows_the_benchmark(spark):
    """At 500,000 windows few of other hashes pass, and all of the benchmark's do."""
    n = 500_000
    hashes = spark.range(n).select(F.xxhash64("id").alias("h"))
    test = D._Bitmap(hashes, n)
    assert (test.mask + 1) * 64 >= 16 * n and D._Bitmap(hashes.limit(10), 10).mask + 1 == D._BITMAP[0] and D._Bitmap(hashes.limit(10), 1 << 40).mask + 1 == D._BITMAP[1]
    passes = lambda h: f"size(element_at(transform(array({test.words}), bits -> filter(array({h}), x -> {test.holds('x')})), 1))"
    own = hashes.limit(20_000).selectExpr(f"sum({passes('h')}) as n").first().n
    others = spark.range(20_000).select(F.xxhash64("id", F.lit("other")).alias("h")).selectExpr(f"sum({passes('h')}) as n").first().n
    assert own == 20_000 and others < 0.1 * 20_000
