"""Secret scans with patterns and character Markov models, in DataFrame expressions only.

Two first-order models over the characters of candidate strings, one learnt from random strings and one
from ordinary identifiers, are compared by their log-likelihood ratio.  Learning runs on the driver over a
small labelled sample; scanning is built-in expressions alone.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import renamed

#: The patterns of the three base kinds, in the order of the kinds.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Strings that the models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KINDS = ("assign", "access", "hex", "random")

#: Words that ordinary identifiers of the built-in sample are made of.
_WORDS = (
    "account action active address admin agent alpha amount archive array async audit author backup balance batch binary block branch buffer build bundle button bytes cache call channel "
    "check child class client clone close cluster code color column command commit common compare config connect content context control convert count create current custom data date "
    "default delete deploy detail device direct display docs domain download driver element email empty enable engine entity entry error event example export factory feature field file "
    "filter final find first flag folder format frame from global group handler hash header height history host image import index info input insert instance item join key label language "
    "last layer layout length level library limit line link list load local logger login main manager map master match memory merge message method metric mode model module monitor name "
    "network next node number object offset option order output page parent parse path pattern payload point policy pool port prefix print process product profile project property public "
    "query queue random range read record region release remote remove render report request reset resource response result return role root route rule sample save schema scope score "
    "script search section segment select send sequence server service session setting shape share signal simple size sort source split start state static status storage stream string "
    "style submit summary switch symbol sync system table tag target task template test text thread time title total trace track transform tree trigger type unique update upload user "
    "utils valid value vector version view visible warning widget width window worker write zone"
).split()


def labelled_samples(n: int = 2000, seed: int = 1) -> list[tuple[str, bool]]:
    """(string, is random): random strings over usual alphabets, and identifiers, paths and versions made of words."""
    rng = random.Random(seed)
    kinds = (ALPHABET[:62], ALPHABET[:62], ALPHABET[:64], "0123456789abcdef", ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62])
    found = [("".join(rng.choices(rng.choice(kinds), k=rng.randint(20, 64))), True) for _ in range(n)]
    for _ in range(n):
        words = rng.choices(_WORDS, k=rng.randint(3, 7))
        form = rng.randrange(6)
        if form == 0:
            words = [words[0], *(w.title() for w in words[1:])]
        elif form == 1:
            words = [w.upper() for w in words]
        text = ("", "_", "_", "-", "/", "")[form].join(words)
        if rng.random() < 0.5:
            text += rng.choice(("", "_", "-", "/v")) + rng.choice((str(rng.randint(0, 99)), "2024-01-15", "20231130", "1000"))
        found.append((text, False))
    return found


def log_ratios(samples: Iterable[tuple[str, bool]], smooth: float = 0.5) -> list[int]:
    """Thousandths of the log ratio of both models' probabilities of a step, for each pair of characters."""
    steps: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for text, is_random in samples:
        known = [c for c in text if c in ALPHABET]
        steps[is_random].update(zip(known, known[1:]))
    size = len(ALPHABET)

    def chance(kind: bool, a: str, b: str, totals: dict[str, int]) -> float:
        return (steps[kind][a, b] + smooth) / (totals.get(a, 0) + smooth * size)

    totals: dict[bool, dict[str, int]] = {True: {}, False: {}}
    for kind in totals:
        for (a, _), n in steps[kind].items():
            totals[kind][a] = totals[kind].get(a, 0) + n
    return [round(1000 * math.log(chance(True, a, b, totals[True]) / chance(False, a, b, totals[False]))) for a in ALPHABET for b in ALPHABET]


#: Matches that are put together at a time: a whole array is copied once for each so many, and not once for each match.
_TOGETHER = 512


def _running(items: str, kind: str, first: str, value: str, make: str) -> str:
    """For each item ``x`` of an array, in order, ``make`` (of ``kind``) with ``now``: what ``value`` gave for the items before it.

    ``value`` is an int expression of ``x`` and ``now``, and ``first`` what it starts with.
    """
    inner = f"""aggregate(slice(items, b * {_TOGETHER} + 1, {_TOGETHER}), struct(whole.now as now, cast(array() as array<{kind}>) as part),
        (got, x) -> element_at(transform(array(got.now), now -> struct({value} as now, array_append(got.part, {make}) as part)), 1))"""
    return f"""element_at(transform(array({items}), items -> aggregate(
        case when size(items) = 0 then cast(array() as array<int>) else sequence(0, cast((size(items) - 1) div {_TOGETHER} as int)) end,
        struct({first} as now, cast(array() as array<array<{kind}>>) as parts),
        (whole, b) -> element_at(transform(array({inner}), done -> struct(done.now as now, array_append(whole.parts, done.part) as parts)), 1),
        whole -> flatten(whole.parts))), 1)"""


_HIT = "struct<start:int,stop:int,hit:string>"


def _found(text: str, pattern: str, keep: str = "true") -> Column:
    """array<struct<start, stop, hit>> of a pattern's leftmost matches in a column; ``keep`` tests a match ``x``."""
    made = "struct(now + x.gap as start, now + x.gap + x.n as stop, x.hit as hit)"
    pairs = f"zip_with(slice(split({text}, r'{pattern}', -1), 1, size(hits)), hits, (gap, hit) -> struct(char_length(gap) as gap, char_length(hit) as n, hit as hit))"
    whole = f"filter({_running(pairs, _HIT, '0', 'now + x.gap + x.n', made)}, x -> {keep})"
    return F.expr(f"element_at(transform(array(regexp_extract_all({text}, r'{pattern}', 0)), hits -> case when size(hits) > 0 then {whole} else cast(array() as array<{_HIT}>) end), 1)")


def _ratio(hit: str, ratios: str) -> str:
    """Sum of the steps' log ratios of a string."""
    size = len(ALPHABET)
    places = f"transform(split({hit}, ''), c -> instr('{ALPHABET}', c) - 1)"
    return f"aggregate(zip_with(slice({places}, 1, char_length({hit}) - 1), slice({places}, 2, char_length({hit}) - 1), (a, b) -> element_at({ratios}, a * {size} + b + 1)), 0, (s, v) -> s + v)"


def find_secrets(docs: DataFrame, samples: Iterable[tuple[str, bool]] | None = None, least: float = 8.0, mean: float = 0.25, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text and ``found``: array<struct<start, kind, stop>> (kind: place in ``KINDS``), in order, of every row.

    Base spans come from the patterns.  A candidate string that doesn't lie wholly inside a base
    span is added as ``random``, beside those that it overlaps, if its log-likelihood ratio is ``least`` nats or more, and ``mean``
    or more for each character.  Each pattern is run once over a text (twice, if it matches); very long texts with very many
    matches take a little more than in proportion.  Other columns are not read.  Null text is empty and has no spans; repeated rows and null ids give a
    row each; an empty table gives none.
    """
    steps = log_ratios(labelled_samples() if samples is None else samples)
    ratios = f"cast(split('{','.join(map(str, steps))}', ',') as array<int>)"
    rows = renamed(docs, doc_id=key, text=F.coalesce(F.col(f"`{text}`"), F.lit("")))
    rows = rows.select(
        "*",
        _found("text", ASSIGN, f"char_length(regexp_extract(x.hit, r'{ASSIGN}', 1)) >= 12").alias("assign"),
        F.when(F.col("text").contains("AKIA"), _found("text", ACCESS)).otherwise(F.expr("cast(array() as array<struct<start:int,stop:int,hit:string>>)")).alias("access"),
        _found("text", HEX).alias("hex"),
        _found("text", CANDIDATE).alias("candidates"),
    )
    spans = [f"transform({kind}, x -> struct(x.start as start, {k} as kind, x.stop as stop))" for k, kind in enumerate(KINDS[:3])]
    rows = rows.withColumn("base", F.expr(f"array_sort(concat({', '.join(spans)}))"))
    # in the order of starts, base spans first, a candidate lies inside a base span if one before it reaches its end
    mixed = "array_sort(concat(transform(base, b -> struct(b.start as start, 0 as candidate, b.stop as stop, '' as hit)), transform(candidates, c -> struct(c.start as start, 1 as candidate, c.stop as stop, c.hit as hit))))"
    free = _running(mixed, "struct<start:int,stop:int,hit:string,free:boolean>", "-1", "case when x.candidate = 0 then greatest(now, x.stop) else now end", "struct(x.start as start, x.stop as stop, x.hit as hit, x.candidate = 1 and x.stop > now as free)")
    sure = f"{_ratio('x.hit', ratios)} >= greatest({round(1000 * least)}, {round(1000 * mean)} * (char_length(x.hit) - 1))"
    added = F.expr(f"case when size(candidates) > 0 then transform(filter({free}, x -> x.free and {sure}), x -> struct(x.start as start, 3 as kind, x.stop as stop)) else cast(array() as array<struct<start:int,kind:int,stop:int>>) end")
    return rows.withColumn("added", added).select("doc_id", "text", "base", F.expr("case when size(added) > 0 then array_sort(concat(base, added)) else base end").alias("found"))


def _listed(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', element_at(array({names}), x.kind + 1), x.start, x.stop)), ',')")


def scan(docs: DataFrame, **options) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of every row; see ``find_secrets``."""
    rows = find_secrets(docs, **options)
    count = lambda k: F.expr(f"cast(size(filter(base, x -> x.kind = {k})) as long)")
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("found").alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", text: str = "text", length: str = "n_chars", **options) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``mark``, and the new text's length in ``length`` if there is
    such a column; overlapping spans are replaced together, null stays null."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text}`").alias("whole"))
    rows = find_secrets(whole, key="row", text="whole", **options)
    # spans are replaced some at a time, each time in the part of the text that they cover
    one = f"""aggregate(part, struct(0 as at, '' as out),
        (got, x) -> struct(greatest(got.at, x.stop - whole.at) as at, case when x.start - whole.at < got.at then got.out else concat(got.out, substring(piece, got.at + 1, x.start - whole.at - got.at), '{mark}') end as out),
        got -> got.out)"""
    clean = f"""aggregate(transform(sequence(0, cast((size(found) - 1) div {_TOGETHER} as int)), b -> slice(found, b * {_TOGETHER} + 1, {_TOGETHER})),
        struct(0 as at, cast(array() as array<string>) as out),
        (whole, part) -> element_at(transform(array(greatest(whole.at, array_max(transform(part, x -> x.stop)))), stop ->
            struct(stop as at, array_append(whole.out, element_at(transform(array(substring(text, whole.at + 1, stop - whole.at)), piece -> {one}), 1)) as out)), 1),
        whole -> concat(array_join(whole.out, ''), substring(text, whole.at + 1)))"""
    rows = rows.withColumn("clean", F.expr(f"case when size(found) > 0 then {clean} end"))
    fixed = {text: F.coalesce("clean", F.col("doc_id")[text])}
    if length in docs.columns:
        size = F.char_length("clean").cast(docs.schema[length].dataType)
        fixed[length] = F.when(F.col("clean").isNotNull(), size).otherwise(F.col("doc_id")[length])
    return rows.select(*(fixed.get(c, F.col("doc_id")[c]).alias(c) for c in docs.columns))
