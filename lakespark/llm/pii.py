"""Personal data by patterns and a semi-Markov conditional random field.

The model scores whole candidate spans: a segment of up to ``SPAN`` tokens and a type get the weights of
features of the segment's full text and of the word before it.  Dynamic programming over the tokens chooses
boundaries and types together.  Tokens end at white space and at punctuation that stands in no entity, so that
long runs without spaces (JSON, CSV, URLs) are cut as well; no entity has over 64 characters.  It is trained here, on sentences made from a seed, by gradient steps on
the conditional log-likelihood.  Text without digits or ``@`` can't hold an entity of these types, so
only runs of tokens around such characters are decoded.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import renamed, ship

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Runs of numbers with a dot between them; the pattern of an address, [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), matches four and
#: four of them from the left, and this takes each run once, however long it is.
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Tokens and characters of the longest entity that the model proposes; with the punctuation around it four times as many.
SPAN, LONGEST = 5, 64
_SIGNS = re.compile(r"[0-9@]+")
#: White space, and punctuation that stands in no entity; both part tokens.
_CUT = frozenset(",:;&\"'`[]{}<>=/|\\")
_TOKEN = re.compile(r"[^\s,:;&\"'`\[\]{}<>=/|\\]+")
_BETWEEN = re.compile(r"[\s,:;&\"'`\[\]{}<>=/|\\]*")
_CUES = {"phone": ("tel", "phone", "call", "mobile", "fax", "dial", "ring", "cell"), "card": ("card", "visa", "mastercard", "amex", "paid", "charge", "debit"), "ip": ("ip", "host", "server", "ping", "node"), "email": ("mail", "email", "contact", "write")}
_CUE = {w: k for k, ws in _CUES.items() for w in ws}


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octets(parts: list[str]) -> bool:
    return all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, stop) of the patterns' leftmost matches that pass their tests, in order."""
    found = []
    if "@" in text:
        found += [(m.start(), 0, m.end()) for m in _emails(text)]
    if not _SIGNS.search(text):
        return found
    found += _addresses(text)
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found)


def _addresses(text: str) -> Iterator[tuple[int, int, int]]:
    for m in DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            stop = at + sum(map(len, parts[k : k + 4])) + 3
            if _octets(parts[k : k + 4]):
                yield at, 1, stop
            at = stop + 1


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[re.Match]:
    """Matches of EMAIL, sought from each ``@`` only: a match starts where the characters before it do."""
    stop = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > stop and text[start - 1] in _LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m
            stop = m.end()
        at = text.find("@", max(at + 1, stop))


def features(piece: str, tokens: int, before: str) -> tuple[str, ...] | None:
    """Of a whole segment; None if its text can't be an entity."""
    if len(piece) > LONGEST:
        return None
    digits = _digits(piece)
    n = len(digits)
    found = [f"tokens{tokens}", "long" if len(piece) > 30 else "short"]
    if "@" in piece:
        user, _, domain = piece.rpartition("@")
        found += ["at", "domain" if re.fullmatch(r"[\w-]+(\.[\w-]+)+", domain) else "nodomain", "user" if re.fullmatch(r"[\w.%+-]+", user) else "nouser"]
    else:
        if n < 4:
            return None
        found.append("n" + ("4-6" if n < 7 else "7" if n < 8 else "8-9" if n < 10 else "10-11" if n < 12 else "12-13" if n < 14 else "14-19" if n < 20 else "20+"))
        parts = piece.split(".")
        if len(parts) == 4 and all(p.isdecimal() and p.isascii() for p in parts):
            found.append("octets" if _octets(parts) else "dotted")
        if 14 <= n <= 19:
            found.append("luhn" if luhn(digits) else "noluhn")
        found.append("plain" if re.fullmatch(r"\+?[0-9 ().-]+", piece) else "odd")
        groups = [len(g) for g in re.findall("[0-9]+", piece)]
        found.append("groups" + "-".join(map(str, groups)) if len(groups) < 6 else "many")
        if re.fullmatch(r"(19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](19|20)[0-9]{2}", piece):
            found.append("date")
        if piece[0] == "+":
            found.append("plus")
        if "(" in piece and ")" in piece:
            found.append("area")
        if "," in piece or "$" in piece or "%" in piece or ":" in piece:
            found.append("amount")
    cue = _CUE.get(before.strip(".,:;()#").lower())
    if cue:
        found.append("cue-" + cue)
    return tuple(found)


def _trimmed(text: str, start: int, stop: int) -> tuple[int, int]:
    """Without the punctuation around a segment."""
    while start < stop and text[start] in "\"'[<{*#|" or start < stop and text[start] == "(" and ")" not in text[start:stop]:
        start += 1
    while start < stop and (text[stop - 1] in ".,;:!?\"']>}*#|&%$" or text[stop - 1] == ")" and "(" not in text[start:stop]):
        stop -= 1
    return start, stop


def runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of neighbouring tokens that hold digits or ``@``, with nothing but white space or cuts between them."""
    run: list[tuple[int, int]] = []
    end = 0
    for m in _SIGNS.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and not text[start - 1].isspace() and text[start - 1] not in _CUT:
            start -= 1
        stop = _TOKEN.match(text, m.start()).end()
        if run and not _BETWEEN.fullmatch(text, end, start):
            yield run
            run = []
        run.append((start, stop))
        end = stop
    if run:
        yield run


def _before(text: str, start: int) -> str:
    return (text[max(0, start - 24) : start].split() or [""])[-1]


def segments(text: str, run: list[tuple[int, int]]) -> list[tuple[int, int, int, int, tuple[str, ...]]]:
    """(first token, token after the last, start, stop, features) of a run's candidates."""
    found = []
    for i in range(len(run)):
        before = _before(text, run[i][0])
        for j in range(i + 1, min(i + SPAN, len(run)) + 1):
            if run[j - 1][1] - run[i][0] > 4 * LONGEST:
                break
            start, stop = _trimmed(text, run[i][0], run[j - 1][1])
            if stop - start > LONGEST:
                break
            got = features(text[start:stop], j - i, before) if start < stop else None
            if got:
                found.append((i, j, start, stop, got))
    return found


class Model:
    """Weights of (type, feature), and of an entity right after another; a token outside scores 0."""

    def __init__(self, weights: dict[tuple[int, str], float] | None = None, next_to: float = 0.0):
        self.weights, self.next_to = weights or {}, next_to

    def score(self, kind: int, got: tuple[str, ...]) -> float:
        return sum(self.weights.get((kind, f), 0.0) for f in got)

    def decode(self, text: str, run: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """The best segmentation's entities as (start, kind, stop)."""
        by_end: dict[int, list] = {}
        for i, j, start, stop, got in segments(text, run):
            kind = max(range(len(KINDS)), key=lambda k: self.score(k, got))
            by_end.setdefault(j, []).append((i, start, stop, kind, self.score(kind, got)))
        best = [(0.0, -math.inf)]  # with the last token outside, or in an entity
        back: list[tuple] = [(None, None)]
        for j in range(1, len(run) + 1):
            out = max(best[j - 1])
            inside, how = -math.inf, None
            for i, start, stop, kind, s in by_end.get(j, ()):
                o, e = best[i]
                if max(o, e + self.next_to) + s > inside:
                    inside, how = max(o, e + self.next_to) + s, (i, start, stop, kind, e + self.next_to > o)
            best.append((out, inside))
            back.append((best[j - 1][1] > best[j - 1][0], how))
        j, entity, found = len(run), best[-1][1] > best[-1][0], []
        while j > 0:
            if entity:
                i, start, stop, kind, entity = back[j][1]
                found.append((start, kind, stop))
                j = i
            else:
                entity = back[j][0]
                j -= 1
        return found[::-1]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        return [s for run in runs(text) for s in self.decode(text, run)]


def _add(a: float, b: float) -> float:
    if a == -math.inf or b == -math.inf:
        return max(a, b)
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def fit(sentences: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = 4, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """Learns from texts and their entities, by AdaGrad on the log-likelihood of the right segmentation."""
    model, squares, next_square = Model(), {}, 1e-6
    cases = []
    for text, entities in sentences:
        right = set(entities)
        for run in runs(text):
            cases.append((len(run), [(i, j, got, [(start, k, stop) in right for k in range(len(KINDS))]) for i, j, start, stop, got in segments(text, run)]))
    for _ in range(epochs):
        for n, found in cases:
            scored = [(i, j, got, gold, [model.score(k, got) for k in range(len(KINDS))]) for i, j, got, gold in found]
            by_end: dict[int, list] = {}
            by_start: dict[int, list] = {}
            for c in scored:
                by_end.setdefault(c[1], []).append(c)
                by_start.setdefault(c[0], []).append(c)
            fore = [(0.0, -math.inf)]
            for j in range(1, n + 1):
                inside = -math.inf
                for i, _, _, _, s in by_end.get(j, ()):
                    into = _add(fore[i][0], fore[i][1] + model.next_to)
                    for x in s:
                        inside = _add(inside, into + x)
                fore.append((_add(*fore[j - 1]), inside))
            rear: list = [None] * n + [(0.0, 0.0)]  # after an outside token, or an entity
            for i in range(n - 1, -1, -1):
                more = -math.inf
                for _, j, _, _, s in by_start.get(i, ()):
                    for x in s:
                        more = _add(more, x + rear[j][1])
                rear[i] = (_add(rear[i + 1][0], more), _add(rear[i + 1][0], more + model.next_to))
            total = rear[0][0]
            step: dict[tuple[int, str], float] = {}
            pairs = 0.0
            ends = {j for _, j, _, gold, _ in scored if any(gold)}
            for i, j, got, gold, s in scored:
                for k, x in enumerate(s):
                    after = math.exp(min(0.0, fore[i][1] + model.next_to + x + rear[j][1] - total))
                    p = after + math.exp(min(0.0, fore[i][0] + x + rear[j][1] - total))
                    pairs += (gold[k] and i in ends) - after
                    if abs(gold[k] - p) > 1e-4:
                        for f in got:
                            step[k, f] = step.get((k, f), 0.0) + gold[k] - p
            for key, g in step.items():
                g -= decay * model.weights.get(key, 0.0)
                squares[key] = squares.get(key, 1e-2) + g * g
                model.weights[key] = model.weights.get(key, 0.0) + rate * g / math.sqrt(squares[key])
            next_square += pairs * pairs
            model.next_to += rate * pairs / math.sqrt(next_square + 1e-2)
    return model


def sentences(n: int = 500, seed: int = 4) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Made-up texts with their entities: personal data in usual forms among dates, amounts, versions and numbers that are none."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choices("0123456789", k=k))
    word = lambda: "".join(rng.choices("abcdefghilmnoprstuvw", k=rng.randint(2, 9)))

    def card() -> str:
        head = rng.choice("3456") + d(rng.choice((13, 14, 14, 14)))
        digits = next(head + c for c in "0123456789" if luhn(head + c))
        sep = rng.choice(("", " ", "-"))
        return sep.join(digits[k : k + 4] for k in range(0, len(digits), 4))

    def phone() -> str:
        a, b, c = str(rng.randint(2, 9)) + d(2), d(3), d(4)
        return rng.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+44 20 {c} {d(4)}", f"+{rng.randint(10, 99)} {a} {d(7)}", f"1-{a}-{b}-{c}"))

    def email() -> str:
        return f"{word()}{rng.choice(('', '.', '_', '+'))}{rng.choice((word(), d(2)))}@{word()}{rng.choice(('', '-' + word()))}.{rng.choice(('com', 'org', 'net', 'co.uk', 'example.com'))}"

    def ip() -> str:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))

    def other() -> str:
        bad = next(x for x in iter(lambda: d(16), None) if not luhn(x))
        return rng.choice((f"20{d(2)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/20{d(2)}", f"${rng.randint(1, 999)},{d(3)}.{d(2)}", f"{d(2)}.{d(1)}%", f"{rng.randint(1, 9)}.{d(2)}.{d(1)}", f"{rng.randint(256, 999)}.{d(3)}.{d(2)}.{d(1)}", f"#{d(7)}", d(rng.randint(1, 9)), d(13), d(rng.randint(20, 24)), bad, f"{bad[:4]} {bad[4:8]} {bad[8:12]} {bad[12:]}", f"{rng.randint(10, 23)}:{d(2)}", f"{d(4)}-{d(4)}", f"@{word()}", f"{word()}@{word()}", f"{d(3)} {d(3)} {d(3)}", f"{d(5)} {d(4)}", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}"))

    makers = (email, ip, card, phone)
    found = []
    for _ in range(n):
        text, entities = "", []
        for _ in range(rng.randint(1, 4)):
            text += " ".join(word() for _ in range(rng.randint(0, 4))) + " "
            kind = rng.randrange(8)
            if kind < 4:
                if rng.random() < 0.4:
                    text += rng.choice(_CUES[KINDS[kind]]) + rng.choice((" ", ": "))
                piece = makers[kind]()
                entities.append((len(text), kind, len(text) + len(piece)))
            else:
                piece = other()
            text += piece + rng.choice(("", "", ".", ",")) + " "
        found.append((text, entities))
    return found


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def find(text: str, model: Model) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans; and those with the model's that overlap none of them.  Both are in order."""
    base = base_spans(text)
    added, k = [], 0
    reach = np.maximum.accumulate([z for _, _, z in base]).tolist() if base else []
    for s in model.spans(text):  # both lists are in order
        while k < len(base) and reach[k] <= s[0]:
            k += 1
        j = k
        while j < len(base) and base[j][0] < s[2] and base[j][2] <= s[0]:
            j += 1
        if j == len(base) or base[j][0] >= s[2]:
            added.append(s)
    return base, sorted(base + added)


def _scan(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, shas, lists = np.zeros((len(KINDS), b.num_rows), np.int64), [], []
            for row, text in enumerate(b.column("text").to_pylist()):
                base, every = find(text, model) if text else ([], [])
                for _, k, _ in base:
                    counts[k, row] += 1
                shas.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                lists.append(_listed(every))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, counts), pa.array(shas, pa.string()), pa.array(lists, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def find_personal_data(docs: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and all spans of every row.

    Base spans come from the patterns, of any length; the model adds entities of up to five tokens and 64 characters that
    overlap none of them.  A text's cost is in proportion to its length.  Null text is
    empty and has no spans; repeated rows and null ids give a row each; an empty table gives none.  Other
    columns are not read.
    """
    ship(docs.sparkSession)
    rows = renamed(docs, doc_id=key, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scan(model or fit(sentences())), f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")
