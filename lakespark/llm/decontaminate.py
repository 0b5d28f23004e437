"""Benchmark decontamination by template windows, in DataFrame expressions only.

Numbers, units after them, and names (words of one capital and small letters, and runs of them) become typed
placeholders, each of them one word whatever its length.
Windows of canonical words are joined by hash with those of the benchmark; a bitmap of the benchmark's
hashes, whose size follows their number up to a bound, sorts out nearly all others before they become rows.  Windows that line up (same
distance between both places) count together if they are verbatim, or if the slots of neighbouring ones are
consistent: a benchmark value always meets the same value in the document.  So verbatim passages are found,
whatever the rest of the copy holds, and questions with other values as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import identified, renamed, stored, without

#: Words of a window; shorter benchmark texts are one window, and if below ``LEAST_WORDS`` a verbatim one.
WINDOW, LEAST_WORDS = 8, 5
#: Words that aren't placeholders in a window that may be re-parameterised, at least; others must be verbatim.
LITERAL = 4
_NUMBER, _UNIT, _NAME, _REST = "\x01", "\x02", "\x03", "\x04"
#: Between the names of a run.
_JOIN = "\x07"
_UNITS = "percent|dollars?|cents?|euros?|pounds?|meters?|metres?|km|kilometers?|kilometres?|cm|mm|miles?|feet|foot|inch|inches|yards?|kg|kilograms?|grams?|g|mg|ounces?|lbs?|tons?|liters?|litres?|ml|gallons?|seconds?|minutes?|hours?|days?|weeks?|months?|years?|degrees?|mph|kmh|watts?|volts?"
#: 64-bit words of the bitmap at least and at most (2 MB), powers of two; in between it has 16 bits for each of the
#: benchmark's windows, so that about one in 16 others passes.
_BITMAP = 1 << 12, 1 << 18


def _tokens(text: Column) -> Column:
    """Lower-case words; placeholders begin with a character of their type and keep their value.  A number is one word with
    its separators, decimals or fraction, and a run of names is one with ``_JOIN`` between them."""
    marked = F.regexp_replace(text, r"[\x01-\x07]", " ")
    marked = F.regexp_replace(marked, r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}+(?![\p{L}\p{N}])", f"{_NAME}$0\x06")
    marked = F.regexp_replace(marked, r"\x06\s+\x03", _JOIN)
    numbers = F.regexp_replace(marked, r"(?<=[0-9])(?:[.,/]|\x20(?=[0-9]+/[0-9]))(?=[0-9])", "\x05")
    numbers = F.regexp_replace(numbers, r"[0-9][0-9\x05]*", f" {_NUMBER}$0 ")
    numbers = F.regexp_replace(numbers, rf"(\x01[0-9\x05]+ +)(?i:({_UNITS}))(?![\p{{L}}\p{{N}}])", f"$1{_UNIT}$2")
    marked = F.when(text.rlike("[0-9]"), numbers).otherwise(marked)
    return F.filter(F.split(F.lower(marked), r"[^\p{L}\p{N}\x01-\x03\x05\x07]+"), lambda t: t != "")


#: Columns of the forms of a text's words: with each name as a placeholder, with names as words like others, so that
#: text in other cases is found as well, and with each run of names as one placeholder (only of texts that have such runs).
_FORMS = ("words", "plain", "runs")


def _with_words(rows: DataFrame) -> DataFrame:
    """Adds the forms, and ``at``: the place in ``runs`` of each word, empty where it is the word's own place."""
    rows = rows.withColumn("runs", _tokens(F.col("text"))).withColumn("joined", F.expr(f"exists(runs, t -> contains(t, '{_JOIN}'))")).drop("text")
    apart = f"flatten(transform(runs, t -> case when contains(t, '{_JOIN}') then transform(split(substring(t, 2), '{_JOIN}'), w -> concat('{_NAME}', w)) else array(t) end))"
    rows = rows.withColumn("words", F.expr(f"case when joined then {apart} else runs end"))
    rows = rows.withColumn("at", F.expr(f"case when joined then flatten(transform(runs, (t, i) -> array_repeat(i, size(split(t, '{_JOIN}'))))) else cast(array() as array<int>) end"))
    rows = rows.withColumn("runs", F.expr("case when joined then runs else cast(array() as array<string>) end")).drop("joined")
    plain = F.transform("words", lambda t: F.when((t >= _NAME) & (t < _REST), F.substring(t, 2, 1 << 30)).otherwise(t))
    return rows.withColumn("plain", plain)


def _hashed(rows: DataFrame, sizes: list[int], exact: list[int] | tuple = ()) -> DataFrame:
    """Adds, for each form, hashes of its runs of 1, 2 and 4 words, each made from the shorter ones, and of the asked sizes
    (those of ``exact`` for the plain form only)."""
    run = lambda a, b, by: f"zip_with({a}, slice({b}, {by + 1}, size({b})), (a, b) -> xxhash64(a, b))"
    for f in _FORMS:
        rows = rows.withColumn(f"{f}1", F.expr(f"transform({f}, t -> xxhash64(case when t < '{_REST}' then left(t, 1) else t end))"))
        rows = rows.withColumn(f"{f}2", F.expr(run(f"{f}1", f"{f}1", 1)))
        rows = rows.withColumn(f"{f}4", F.expr(run(f"{f}2", f"{f}2", 2)))
        for n in sorted({*sizes, *(exact if f == "plain" else ())}):
            if n == 3:
                rows = rows.withColumn("plainw3", F.expr(run("plain2", "plain1", 2)))
                continue
            rest = f"{f}{n - 4}" if n - 4 in (1, 2, 4) else run(f"{f}2", f"{f}1", 2)
            rows = rows.withColumn(f"{f}w{n}", F.expr(f"slice({run(f'{f}4', rest, 4)}, 1, greatest(0, size({f}) - {n - 1}))"))
    return rows


def _windows(rows: DataFrame, sizes: list[int], test: "_Bitmap | None" = None, exact: list[int] | tuple = ()) -> DataFrame:
    """A row for each window whose hash without values, ``loose_h``, passes ``test``: its place in words and among ``runs``, its
    form and its words.  Windows of ``plain`` of the sizes ``exact`` come as form 3, with a hash of their values as ``h``."""
    keep = (lambda h: test.holds(h)) if test else (lambda h: "true")
    place = {f: ("i", "coalesce(get(at, i), i)") for f in _FORMS}
    place["runs"] = ("cast(array_position(at, i) - 1 as int)", "i")
    per_size = [
        f"transform(array_compact(transform({f}w{n}, (h, i) -> case when {keep('h')} then i end)), i -> struct(element_at({f}w{n}, i + 1) as h, element_at({f}w{n}, i + 1) as loose_h, {place[f][0]} as place, {place[f][1]} as run_place, {k}Y as form, slice({f}, i + 1, {n}) as slots))"
        for k, f in enumerate(_FORMS)
        for n in sizes
    ]
    for n in exact:
        # the hash without values sorts out nearly all of them before one with values is made
        h = f"plain{n}" if n in (1, 2, 4) else f"plainw{n}"
        per_size.append(f"transform(array_compact(transform({h}, (h, i) -> case when {keep('h')} then i end)), i -> struct(xxhash64(slice(plain, i + 1, {n}), 'exact') as h, element_at({h}, i + 1) as loose_h, i as place, coalesce(get(at, i), i) as run_place, 3Y as form, slice(plain, i + 1, {n}) as slots))")
    whole = f"concat({', '.join(per_size)})"
    if test:  # bound once, however often it is asked
        whole = f"element_at(transform(array({test.words}), bits -> {whole}), 1)"
    others = [c for c in rows.columns if c not in (*_FORMS, "at")]
    return _hashed(rows, sizes, [n for n in exact if n not in (1, 2, 4)]).select(*others, F.inline(F.expr(whole)))


def _canonical(slots: str) -> str:
    return f"transform({slots}, t -> case when t < '{_REST}' then left(t, 1) else t end)"


class _Bitmap:
    """Which hashes may be among some: the low bits choose a word and six more a bit.  At most ``_BITMAP[1]`` rows come to the driver."""

    def __init__(self, hashes: DataFrame, n: int):
        size = min(_BITMAP[1], max(_BITMAP[0], 1 << max(0, (n - 1).bit_length() - 2)))
        self.mask, self.shift = size - 1, size.bit_length() - 1
        bits = hashes.select(F.expr(f"cast(h & {self.mask}L as int) as word"), F.expr(f"shiftleft(1L, cast(shiftright(h, {self.shift}) & 63L as int)) as bit"))
        words = [0] * size
        for word, bit in bits.groupBy("word").agg(F.bit_or("bit")).collect():
            words[word] = bit
        self.words = f"cast(split('{','.join(map(str, words))}', ',') as array<bigint>)"

    def holds(self, h: str) -> str:
        return f"getbit(get(bits, cast({h} & {self.mask}L as int)), cast(shiftright({h}, {self.shift}) & 63L as int)) = 1"


def contaminated(docs: DataFrame, benchmark: DataFrame, enough: int = 6, broadcast: int = 1_000_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document and benchmark item that it holds: ``row`` (a hash of the document's id and
    text), doc_id, item_id, n_windows, item_windows, place (in words) and reparameterised.

    A pair counts if ``enough`` windows line up verbatim, or neighbouring ones consistently (13 words; all windows, if the item has
    fewer).  Windows with fewer than four words that are no placeholders, and items of
    fewer than five words, count only where they are verbatim.  Other columns are not read; a text's cost is in
    proportion to its length.  Null texts are empty; repeated documents
    or items count once; null ids are kept; without documents or items there are no rows.  The
    benchmark's windows are broadcast only if there are at most ``broadcast`` of them.
    """
    items = renamed(benchmark, item_id=F.col("item_id"), text=F.coalesce(F.col("text"), F.lit(""))).distinct()
    items = stored(_with_words(items.withColumn("item", F.xxhash64(F.col("item_id").cast("string"), "text"))), "benchmark-words")
    # an item is cut into windows of one size: the full one, or all of its words
    own = items.withColumn("own", F.least(F.size("words"), F.lit(WINDOW))).withColumn("run_words", F.expr("case when size(runs) > 0 then size(runs) else size(words) end"))
    own = own.withColumn("run_own", F.least("run_words", F.lit(WINDOW))).withColumn("size_of", F.size("words"))
    lengths = [r[0] for r in own.select(F.explode(F.array("own", "run_own")).alias("n")).where(f"n >= {LEAST_WORDS}").distinct().collect()]
    sizes = sorted(set(lengths) | {WINDOW})  # at most four
    windows = _windows(own, sizes).where(f"size(slots) = case when form = 2 then run_own else own end and size(filter(slots, t -> t >= '{_REST}')) >= {LITERAL}")
    # windows of few words that are no placeholders, and short items, count where they are verbatim
    few = _windows(own, [], exact=range(1, WINDOW + 1)).where(f"size(slots) = own and (own < {LEAST_WORDS} or size(filter(slots, t -> t >= '{_REST}')) < {LITERAL})")
    windows = windows.unionByName(few).withColumn("starts", F.expr("run_words - run_own")).withColumn("all_windows", F.expr("size_of - own + 1"))
    windows = stored(windows.select("item", "item_id", "h", "loose_h", "form", "starts", "all_windows", F.col("place").alias("item_place"), F.col("run_place").alias("item_run_place"), F.col("slots").alias("item_slots")).distinct(), "benchmark-windows")
    places = [F.expr("count(distinct case when form < 2 then item_place end)").alias("literal_windows"), F.expr("count(distinct case when form < 3 and item_run_place <= starts then item_run_place end)").alias("run_windows")]
    windows = windows.withColumn("item_form", F.expr("form = 3")).drop("form", "starts").join(windows.groupBy("item").agg(*places), "item").withColumnRenamed("all_windows", "item_windows")
    sizes_few = [r[0] for r in windows.where("item_form").select(F.size("item_slots")).distinct().collect()]
    n = windows.count()
    test = _Bitmap(windows.select(F.col("loose_h").alias("h")), n)
    windows = windows.drop("loose_h")
    if n <= broadcast:
        windows = F.broadcast(windows)
    rows = renamed(docs, doc_id=key, text=F.coalesce(F.col(f"`{text}`"), F.lit(""))).withColumn("row", _row(F.col("doc_id"), F.col("text")))
    hits = _windows(_with_words(rows), sizes, test, sizes_few).join(windows, "h").where(f"(form = 3) = item_form and case when item_form then slots = item_slots else {_canonical('slots')} = {_canonical('item_slots')} end")
    # of a run of names the last one is compared: words before it may be none, such as the first of a sentence
    value = lambda x: f"case when contains({x}, '{_JOIN}') then concat('{_NAME}', substring_index({x}, '{_JOIN}', -1)) else {x} end"
    pairs = F.expr(f"transform(filter(zip_with(item_slots, slots, (b, d) -> struct(b as b, d as d)), p -> p.b < '{_REST}'), p -> struct({value('p.b')} as b, {value('p.d')} as d))")
    # windows line up by words, and by words with runs of names as one, whose numbers of words may differ
    by = [f"struct({k} as by, {at} - item_{at} as line, item_{at} as spot, least({n}, {enough}) as need, {k} = 0 as in_words)" for k, (at, n) in enumerate((("place", "literal_windows"), ("run_place", "run_windows")))]
    hits = hits.select("*", pairs.alias("pairs"), F.expr(f"inline(array({', '.join(by)}))")).withColumn("verbatim", F.expr("case when slots = item_slots and in_words then spot end")).withColumn("loose", F.expr(f"case when not item_form or need = {enough} then spot end"))
    lines = hits.groupBy("row", "doc_id", "item", "item_id", "item_windows", "by", "line", "need")
    lines = lines.agg(F.count_distinct("spot").alias("n_windows"), F.count_distinct("verbatim").alias("n_verbatim"), F.min("place").alias("place"), F.array_sort(F.collect_set(F.expr("case when loose is not null then struct(spot, pairs) end"))).alias("held"))
    lines = lines.withColumn("is_verbatim", F.expr(f"n_verbatim >= least(item_windows, {enough})"))
    # slots are to be consistent in a stretch of as many neighbouring windows as are needed, not on the whole line
    lines = lines.withColumn("places", F.expr("array_distinct(transform(held, x -> x.spot))"))
    stretch = "array_distinct(flatten(transform(filter(held, x -> x.spot between places[i] and places[i + need - 1]), x -> x.pairs)))"
    # a value always meets the same one, and different names meet different ones
    one_to_one = f"size(array_distinct(transform(s, p -> p.b))) = size(s) and size(array_distinct(transform(filter(s, p -> p.b >= '{_NAME}'), p -> p.d))) = size(filter(s, p -> p.b >= '{_NAME}'))"
    sound = f"exists(sequence(0, size(places) - cast(need as int)), i -> exists(array({stretch}), s -> {one_to_one}))".replace("need - 1", "cast(need as int) - 1")
    found = lines.where(f"case when is_verbatim then true when need > 0 and size(places) >= need then {sound} else false end").withColumn("reparameterised", ~F.col("is_verbatim"))
    return found.groupBy("row", "doc_id", "item_id", "item_windows").agg(
        F.max("n_windows").alias("n_windows"), F.min("place").alias("place"), F.min("reparameterised").alias("reparameterised")
    ).select("row", "doc_id", "item_id", "n_windows", "item_windows", "place", "reparameterised")


def _row(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id.cast("string"), F.coalesce(text, F.lit("")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; the others keep all their columns, whatever their names.
    Only the found documents' hashes are joined with the documents; see ``without``."""
    held = stored(contaminated(docs, benchmark, **options).select("row").distinct(), "contaminated")
    own = identified(docs)
    plain = [c for c in own.columns if c not in ("id", "row", "body")]
    at = dict(zip(docs.columns, plain))
    own = own.withColumn("row", _row(F.col(at["doc_id"]), F.col("body")))
    return without(own, held, ["row"]).select(*plain).toDF(*docs.columns)
