"""Near-duplicates by the Jaccard similarity of word shingles, exactly, behind SimHash.

Fingerprints over the same shingles are searched by vantage-point trees first (``simhash.links``), and what links there
is confirmed by the whole sets: that joins copies that differ in little, whatever their number.  The rest is completed
by prefix filtering: two sets with a similarity of at least t share one of their first |x| - ceil(t |x|) + 1 members in
any order that holds for all sets.  The order is that of the hashes, with frequent members last, the most frequent ones
behind all, so that lines which many texts share make few candidates; and of what two sets share, the first member stands
so early in both that enough can follow.  Only components are asked for, so of the texts that share a member the one in
which it stands first is held against the others before all else; pairs are then made between those alone that are still in different
components.  Every link counts only if the whole sets confirm it, and no link between components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, identified, ship, stored, tidy
from .components import components
from .simhash import _majorities, heads, links

#: The similarity that links two texts, in twentieths, so that tests of it are exact.
LEAST = 16
#: 64-bit words of the bitmap of candidates; 2 to the power of 18.
_BITMAP = 1 << 18


#: Buckets of a set's counts: what two sets share in a bucket is at most the lesser count.
_BUCKETS = 256
#: Digests that a task remembers, so that it passes on what hangs on them once.
_SEEN = 500_000


def _hashes(text: str | None, words: int) -> np.ndarray:
    """Hashes of a text's runs of words, repeats included; a shorter text is one run, one without words has none."""
    from xxhash import xxh64_intdigest

    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return np.empty(0, np.uint64)
    whole = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    if n == 1:
        return np.array([xxh64_intdigest(whole, 42)], np.uint64)
    ends = np.cumsum([len(p) + 1 for p in parts])
    firsts = np.concatenate([[0], ends])[:n].tolist()
    return np.array([xxh64_intdigest(whole[a:z], 42) for a, z in zip(firsts, (ends[words - 1 :] - 1).tolist())], np.uint64)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of words."""
    return np.unique(_hashes(text, words).view(np.int64))


def first_members(size: int, least: int = LEAST) -> int:
    return size + least * size // -20 + 1 if size else 0


def _counts(members: np.ndarray) -> bytes | None:
    """How many members are in each bucket, a byte each; None if a byte doesn't hold it."""
    n = np.bincount(members & (_BUCKETS - 1), minlength=_BUCKETS)
    return n.astype(np.uint8).tobytes() if n.max(initial=0) < 256 else None


#: Of what ``_sets`` gives.
SETS = "id long, row long, digest long, print long, counts binary, members array<long>"


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                runs = [_hashes(t, words) for t in part.column("body").to_pylist()]
                prints = _majorities(np.concatenate(runs), np.array([len(x) for x in runs], np.int64)).view(np.int64)
                found = [np.unique(x.view(np.int64)) for x in runs]
                digests = np.array([xxh64_intdigest(x.tobytes(), 7) if len(x) else 0 for x in found], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("row"), pa.array(digests), pa.array(prints), pa.array(map(_counts, found), pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["id", "row", "digest", "print", "counts", "members"])
        tidy()

    return run


class _New:
    """Which digests a task meets for the first time, as far as it remembers."""

    def __init__(self):
        self.seen: set[int] = set()

    def __call__(self, digests: np.ndarray) -> np.ndarray:
        if len(self.seen) > _SEEN:
            self.seen.clear()
        kept = np.zeros(len(digests), bool)
        for k, d in enumerate(digests.tolist()):
            if d not in self.seen:
                self.seen.add(d)
                kept[k] = True
        return kept


def _first(least: int, hot: np.ndarray, tiers: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = _New()
        for whole in batches:
            whole = whole.filter(pa.array(new(whole.column("digest").to_numpy())))
            for at in range(0, whole.num_rows, 100):
                b = whole.slice(at, 100)
                sizes = b.column("members").value_lengths().to_numpy().astype(np.int64)
                flat = b.column("members").flatten().to_numpy()
                tier = np.zeros(len(flat), np.uint8)
                if len(hot):
                    near = np.minimum(np.searchsorted(hot, flat), len(hot) - 1)
                    tier = np.where(hot[near] == flat, tiers[near], 0)
                of = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((tier, of))  # stable: by hash within a tier
                place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                firsts = np.array([first_members(n, least) for n in sizes.tolist()], np.int64)
                kept = place < firsts[of] if len(of) else np.zeros(0, bool)
                who = of[kept]
                columns = [pa.array(flat[order][kept]), pa.array(b.column("digest").to_numpy()[who]), pa.array(sizes[who].astype(np.int32)), pa.array(place[kept].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["member", "digest", "size", "place"])
        tidy()

    return run


def _passing(bitmap: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = _New()
        for b in batches:
            digest = b.column("digest").to_numpy()
            b = b.filter(pa.array((bitmap[digest & (_BITMAP - 1)] >> ((digest >> 18) & 63)) & 1 == 1))
            yield b.filter(pa.array(new(b.column("digest").to_numpy())))

    return run


def _only(sets: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """(digest, column) for the digests in pairs, once each; a bitmap of fixed size spares nearly all others the shuffle."""
    asked = pairs.select(F.col("a").alias("digest")).unionAll(pairs.select("b")).distinct()
    bits = asked.select(F.expr(f"cast(digest & {_BITMAP - 1}L as int) as word"), F.expr("shiftleft(1L, cast(shiftright(digest, 18) & 63L as int)) as bit"))
    words = bits.groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()  # at most _BITMAP rows
    bitmap = np.zeros(_BITMAP, np.int64)
    bitmap[words["word"].to_numpy(np.int64)] = words["bit"].to_numpy(np.int64)
    sets = sets.select("digest", column)
    return stored(sets.mapInArrow(_passing(bitmap), sets.schema).join(asked, "digest", "left_semi").dropDuplicates(["digest"]), f"asked-{column}")


def _both(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
    one = lambda digest, name: of.select(F.col("digest").alias(digest), F.col(column).alias(name))
    return pairs.join(one("a", "x"), "a").join(one("b", "y"), "b")


def _close(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                known = np.flatnonzero(b.column("x").is_valid().to_numpy(zero_copy_only=False) & b.column("y").is_valid().to_numpy(zero_copy_only=False))
                x, y = (np.frombuffer(b"".join(b.column(c).take(pa.array(known)).to_pylist()), np.uint8).reshape(len(known), _BUCKETS) for c in "xy")
                most, total = np.minimum(x, y).sum(1, dtype=np.int64), x.sum(1, dtype=np.int64) + y.sum(1, dtype=np.int64)
                kept = np.ones(b.num_rows, bool)
                kept[known] = (20 + least) * most >= least * total
                yield b.select(["a", "b"]).filter(pa.array(kept))

    return run


def confirmed(sets: DataFrame, pairs: DataFrame, least: int = LEAST) -> DataFrame:
    """Of stored pairs (a, b) of digests those whose whole sets (digest, counts, members) have a similarity of ``least`` twentieths or more.

    Pairs whose counts by bucket rule that out are dropped before whole sets are sent to them.
    """
    near = stored(_both(pairs, _only(sets, pairs, "counts"), "counts").select("a", "b", "x", "y").mapInArrow(_close(least), "a long, b long"), "close")
    both = _both(near, _only(sets, near, "members"), "members")
    return both.where(f"{20 + least} * size(array_intersect(x, y)) >= {least} * (size(x) + size(y))").select("a", "b")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    new = _New()
    for b in batches:
        b = b.filter(pa.array(new(b.column("digest").to_numpy())))
        yield pa.RecordBatch.from_arrays([b.column("members").flatten()], ["member"])


def first_rows(sets: DataFrame, least: int = LEAST, often: int = 32, most: int = 500_000, share: int = 16) -> DataFrame:
    """(member, digest, size, place, one...): the first members of each set that more than one set begins with, and beside
    them the set in which each member stands first.

    At most ``most`` members, those that about ``often`` or more sets hold (counted in one of ``share`` sets: any
    order of members gives the same links), come to the driver, 9 bytes each, and are put last by the logarithm of their
    number; where there are more, those of the lower logarithms are left out.
    """
    form = "member long, digest long, size int, place int"
    sets = sets.select("digest", "members")
    some = sets.where(F.expr(f"pmod(digest, {share}) = 0")).mapInArrow(_members, "member long")
    counts = some.groupBy("member").agg(F.count("*").alias("count")).where(F.col("count") >= max(2, often // share))
    counts = stored(counts.select("member", F.ceil(F.log2("count")).cast("tinyint").alias("tier")), "frequent-members")
    sizes = dict(counts.groupBy("tier").count().collect())
    tier = min((t for t in sizes if sum(n for u, n in sizes.items() if u >= t) <= most), default=127)
    hot = counts.where(F.col("tier") >= tier).toPandas().sort_values("member")
    rows = sets.mapInArrow(_first(least, hot["member"].to_numpy(np.int64), 1 + hot["tier"].to_numpy(np.uint8)), form).repartition("member").distinct()
    one = F.min(F.struct("place", "digest", "size")).alias("one")
    met = rows.groupBy("member").agg(one, F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo < hi")
    met = met.select("member", F.col("one.digest").alias("one"), F.col("one.size").alias("one_size"), F.col("one.place").alias("one_place"))
    return stored(rows.join(met, "member"), "shared-members")


def _possible(n: str, m: str, i: str, j: str, least: int) -> str:
    """Whether sets of ``n`` and ``m`` members whose first shared one stands at ``i`` and ``j`` can be similar enough."""
    return f"{20 + least} * (1 + least({n} - {i} - 1, {m} - {j} - 1)) >= {least} * ({n} + {m})"


def _with_one(rows: DataFrame, least: int) -> DataFrame:
    """(a, b): of the digests that share a member, that in which it stands first with each other; a row for each of ``rows`` at most."""
    met = rows.where(f"digest <> one and {_possible('size', 'one_size', 'place', 'one_place', least)}")
    return met.select(F.least("one", "digest").alias("a"), F.greatest("one", "digest").alias("b")).distinct()


def _all_apart(rows: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """(a, b): all pairs of different components (``found``: node, component) that share a member so early that they can be similar."""
    found = F.broadcast(found) if found.count() <= BROADCAST_KEYS else found
    parts = rows.join(found, F.col("digest") == F.col("node"), "left").select("member", "digest", "size", "place", F.coalesce("component", "digest").alias("part"))
    met = parts.groupBy("member").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("member")
    apart = parts.join(met, "member", "left_semi")
    a = apart.select("member", *(F.col(c).alias(k) for c, k in zip(("digest", "size", "place", "part"), "anip")))
    b = apart.select("member", *(F.col(c).alias(k) for c, k in zip(("digest", "size", "place", "part"), "bmjq")))
    test = (a["member"] == b["member"]) & (F.col("a") < F.col("b")) & (F.col("p") != F.col("q")) & F.expr(_possible("n", "m", "i", "j", least))
    return a.join(b, test).select("a", "b").distinct()


def similar_components(sets: DataFrame, least: int = LEAST, within: int = 3, **limits: int) -> DataFrame:
    """(node, component) of the digests of ``sets`` (digest, print, counts, members) that links of a similarity of ``least``
    twentieths or more join to others.  ``limits`` go to ``first_rows``."""
    prints = stored(sets.select("print", "digest").distinct().groupBy("print").agg(F.min("digest").alias("digest"), F.count("*").alias("n")), "prints")
    near = links(prints.select(F.col("print").alias("fp")), within)
    first = lambda c: prints.select(F.col("print").alias(c), F.col("digest").alias(f"{c}_digest"))
    pairs = near.join(first("a"), "a").join(first("b"), "b").select(F.col("a_digest").alias("a"), F.col("b_digest").alias("b"))
    alike = sets.select("print", F.col("digest").alias("b")).distinct().join(prints.where("n > 1").select("print", F.col("digest").alias("a")), "print").where("a <> b").select("a", "b")
    rows = first_rows(sets, least, **limits)
    pairs = pairs.unionAll(alike).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionAll(_with_one(rows, least))
    found = stored(confirmed(sets, stored(pairs.distinct(), "candidates"), least), "confirmed")
    now = stored(components(found), "components")
    more = stored(confirmed(sets, stored(_all_apart(rows, now, least), "candidates"), least), "confirmed")
    return components(found.unionAll(more))


def one_of_each_similar(docs: DataFrame, words: int = 5, least: int = LEAST, within: int = 3, **limits: int) -> DataFrame:
    """``docs`` with one row of each group that pairs of similar texts link: that of its smallest id, as in
    ``simhash.heads``.  Null and empty texts are alike; repeated ids, repeated rows and null ids are told apart by the
    whole row; an empty table gives none; a text's cost is in proportion to its length.  ``limits`` go to ``first_rows``."""
    ship(docs.sparkSession)
    own = identified(docs)
    sets = stored(own.select("id", "row", "body").mapInArrow(_sets(words), SETS), "shingles")
    rows = sets.select("id", "row", F.col("digest").alias("node"))
    found = similar_components(sets.select("digest", "print", "counts", "members"), least, within, **limits)
    nodes = rows.select("node").distinct()
    classes = nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return heads(own, rows, classes).toDF(*docs.columns)
