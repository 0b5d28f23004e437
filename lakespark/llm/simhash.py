"""SimHash near-duplicates through vantage-point shards.

Fingerprints are 64-bit majorities over the XXH64 values of word shingles.  Distinct fingerprints are dealt
to the leaves of a vantage-point tree: each node parts them by their Hamming distance to one fingerprint.
A fingerprint has one home leaf, and also visits each leaf that can hold a linked one by the triangle
inequality.  Leaves search their own vantage-point tree, and pass on a spanning forest of the links they
found, which loses no component.  Components are then found over all leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, identified, renamed, ship, stored, without
from .components import components

_LANES = np.uint64(0x0101010101010101)


def _majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of hashes, the bits that are set in over half of them; 0 for an empty run."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    # eight counters of a byte each add up in one word, for at most 255 hashes at a time
    blocks = -(-n // 255)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    cuts = np.repeat(starts - first * 255, blocks) + np.arange(blocks.sum()) * 255
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & _LANES, cuts)
        ones = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            out[full] |= (2 * ones[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + shift)
    return out


def fingerprints(texts: list[str | None], words: int = 3) -> np.ndarray:
    """Signed 64-bit fingerprints of whole texts; a text without words has fingerprint 0."""
    from xxhash import xxh64_intdigest

    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not parts:
            continue
        whole = b" ".join(parts)
        n = max(1, len(parts) - words + 1)
        counts[k] = n
        if n == 1:
            hashes.append(xxh64_intdigest(whole, 42))
            continue
        ends = np.cumsum([len(p) + 1 for p in parts])
        firsts = np.concatenate([[0], ends])[:n].tolist()
        hashes += [xxh64_intdigest(whole[a:z], 42) for a, z in zip(firsts, (ends[words - 1 :] - 1).tolist())]
    return _majorities(np.array(hashes, np.uint64), counts).view(np.int64)


def _fingerprint(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints(part.column("text").to_pylist(), words))], ["doc_id", "fp"])

    return run


def fingerprint_table(docs: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; null text is empty."""
    ship(docs.sparkSession)
    rows = renamed(docs, doc_id=F.col(f"`{key}`").cast("long"), text=text)
    return rows.mapInArrow(_fingerprint(words), "doc_id long, fp long")


def _distance(points: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ point).astype(np.int16)


def _vantage(points: np.ndarray, within: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """The vantage point and distance that part points evenly with few of them near the border; None if none parts them."""
    best = None
    for point in points[rng.integers(0, len(points), 8)]:
        reach = np.cumsum(np.bincount(_distance(points, point), minlength=65 + 2 * within))
        inner = reach[:65]
        border = reach[within : 65 + within] - np.concatenate([np.zeros(within, np.int64), inner])[:65]
        uneven = np.abs(2 * inner - len(points))
        cost = border + 2 * np.maximum(uneven - 0.4 * len(points), 0)
        cost = np.where((inner > 0) & (inner < len(points)), cost, np.inf)
        at = int(np.argmin(cost))
        if np.isfinite(cost[at]) and (best is None or cost[at] < best[0]):
            best = (cost[at], point, at)
    return best and (best[1], best[2])


def routing_tree(sample: np.ndarray, leaves: int, within: int, seed: int = 7) -> list:
    """Nested [point, distance, near, far]; a leaf is its number."""
    rng = np.random.default_rng(seed)
    number = iter(range(leaves + 1))

    def grow(points: np.ndarray, share: int):
        found = _vantage(points, within, rng) if share > 1 and len(points) > 1 else None
        if found is None:
            return next(number)
        near = _distance(points, found[0]) <= found[1]
        return [found[0], found[1], grow(points[near], share // 2), grow(points[~near], share - share // 2)]

    return grow(sample, leaves)


def route(tree, points: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, leaf, at home) for each visit of each point.  Of two points that part at a node, the near one visits the far side."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def go(node, who: np.ndarray, home: np.ndarray) -> None:
        if not len(who):
            return
        if not isinstance(node, list):
            found.append((who, np.full(len(who), node), home))
            return
        d = _distance(points[who], node[0])
        near = np.where(home, d <= node[1], d <= node[1] + within)
        far = d > node[1] - within
        go(node[2], who[near], home[near])
        go(node[3], who[far], (home & (d > node[1]))[far])

    go(tree, np.arange(len(points)), np.ones(len(points), bool))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found))


def _route(tree, within: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy()
            who, leaf, home = route(tree, fp.view(np.uint64), within)
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), pa.array(fp[who]), pa.array(home)], ["leaf", "fp", "home"])

    return run


class _Forest:
    """Union-find over places."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def labels(self) -> np.ndarray:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return up
            self.root = up

    def find(self, k: int) -> int:
        while self.root[k] != k:
            self.root[k] = self.root[self.root[k]]
            k = int(self.root[k])
        return k

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        labels = self.labels()
        a, b = labels[a], labels[b]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b], axis=1)
        for x, y in pairs.T.tolist():
            x, y = self.find(x), self.find(y)
            if x != y:
                self.root[max(x, y)] = min(x, y)


def search(points: np.ndarray, homes: np.ndarray, queries: np.ndarray, within: int, leaf: int = 64, block: int = 8192) -> np.ndarray:
    """Smallest place that each place is linked to; links run between homes and queries (places of ``points``)."""
    forest, rng = _Forest(len(points)), np.random.default_rng(11)
    todo = [(homes, queries)]
    while todo:
        inside, asking = todo.pop()
        if not len(inside) or not len(asking):
            continue
        found = _vantage(points[inside], within, rng) if len(inside) > leaf else None
        if found is not None:
            d, q = _distance(points[inside], found[0]), _distance(points[asking], found[0])
            todo.append((inside[d <= found[1]], asking[q <= found[1] + within]))
            todo.append((inside[d > found[1]], asking[q > found[1] - within]))
            continue
        for at in range(0, len(asking), block):
            part = asking[at : at + block]
            near = np.bitwise_count(points[part][:, None] ^ points[inside][None, :]) <= within
            who, which = np.nonzero(near)
            if not len(who):
                continue
            # a query joins its first home, and that one the query's others
            first = inside[near.argmax(1)]
            forest.join(part[who], first[who])
            forest.join(first[who], inside[which])
    return forest.labels()


def _search(within: int):
    def run(rows: pa.Table) -> pa.Table:
        fp, home = rows.column("fp").to_numpy(), rows.column("home").to_numpy()
        # a fingerprint can come as a home and as a query
        points, place = np.unique(fp, return_inverse=True)
        top = search(points.view(np.uint64), np.unique(place[home]), np.unique(place[~home]), within)
        linked = np.flatnonzero(top != np.arange(len(top)))
        return pa.table({"a": points[linked], "b": points[top[linked]]})

    return run


def links(points: DataFrame, within: int = 3, homes: int = 16_384, least: int = 16, most: int = 65_536, block: int = 262_144) -> DataFrame:
    """(a, b): a forest of links between distinct fingerprints (column ``fp``) at ``within`` or fewer bits.

    The routing tree is grown from at most 64 fingerprints for each of its leaves, of which there are
    ``least`` to ``most``, as the table grows, so it has a bounded size.  A leaf with more than ``block`` homes, or four times
    as many queries, is searched in blocks of homes by blocks of queries.
    """
    spark = points.sparkSession
    ship(spark)
    leaves = min(most, max(least, -(-points.count() // homes)))
    sample = points.orderBy(F.xxhash64("fp")).limit(64 * leaves).select("fp").toPandas()["fp"].to_numpy(np.int64)
    if not len(sample):
        return spark.createDataFrame([], "a long, b long")
    tree = routing_tree(sample.view(np.uint64), leaves, within)
    visits = stored(points.select("fp").mapInArrow(_route(tree, within), "leaf int, fp long, home boolean"), "visits")
    sizes = visits.groupBy("leaf").agg(F.sum(F.col("home").cast("long")).alias("h"), F.count("*").alias("q"))
    sizes = sizes.select("leaf", F.ceil(F.col("h") / block).cast("int").alias("hs"), F.ceil(F.col("q") / (4 * block)).cast("int").alias("qs"))
    visits = visits.join(F.broadcast(sizes), "leaf").where("hs > 0")  # one row for each of at most `most` leaves
    asked = visits.withColumn("hb", F.explode(F.expr("sequence(0, hs - 1)"))).withColumn("qb", F.expr("cast(pmod(xxhash64(fp), qs) as int)"))
    held = visits.where("home").withColumn("qb", F.explode(F.expr("sequence(0, qs - 1)"))).withColumn("hb", F.expr("cast(pmod(xxhash64(fp, 1), hs) as int)"))
    columns = ("leaf", "hb", "qb", "fp")
    dealt = asked.select(*columns, F.lit(False).alias("home")).unionAll(held.select(*columns, F.lit(True).alias("home")))
    return dealt.groupBy("leaf", "hb", "qb").applyInArrow(_search(within), "a long, b long")


def _classes(points: DataFrame, within: int, limits: dict[str, int]) -> DataFrame:
    """(fp, component) of every distinct fingerprint; component is the smallest fingerprint reachable."""
    found = components(links(points, within, **limits))
    return points.select("fp").join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, words: int = 3, within: int = 3, key: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``.

    Rows link at ``within`` or fewer differing bits; component_id is the smallest id reachable.  Null and
    empty texts have fingerprint zero and link like any other; rows with one id and different texts are
    rows of their own, so an id can be in several components; repeated rows share a component; null ids
    are no candidates for component_id, which is null if a component has no other; an empty table gives no
    rows.  A text's cost is in proportion to its length.  Other columns are not read.  ``limits`` go to ``links``.
    """
    rows = stored(fingerprint_table(docs, words, key, text), "fingerprints")
    points = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "points")
    whole = stored(points.join(_classes(points, within, limits), "fp"), "classes")
    # stored, so that adaptive execution can split a component that most fingerprints are in
    heads = stored(whole.groupBy("component").agg(F.min("first").alias("component_id")), "first-ids")
    whole = stored(whole.join(heads, "component").select("fp", "component_id"), "classes")
    return rows.join(whole, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _fingerprint_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("row"), pa.array(fingerprints(part.column("body").to_pylist(), words))], ["id", "row", "node"])

    return run


def one_of_each(docs: DataFrame, words: int = 3, within: int = 3, **limits: int) -> DataFrame:
    """``docs`` with one row of each component, the one of the smallest id; see ``heads``.  ``docs`` keeps its columns,
    whatever their names; an empty table gives none; null and empty texts are alike."""
    ship(docs.sparkSession)
    own = identified(docs)
    rows = stored(own.select("id", "row", "body").mapInArrow(_fingerprint_rows(words), "id long, row long, node long"), "fingerprints")
    points = stored(rows.select(F.col("node").alias("fp")).distinct(), "points")
    return heads(own, rows, _classes(points, within, limits).withColumnRenamed("fp", "node")).toDF(*docs.columns)


def heads(own: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Of ``own`` (see ``identified``) the row of each component with the smallest id, without the added columns.

    ``rows`` has (id, row, node) of every row and ``classes`` (node, component).  A null id comes after all
    others, and of rows with one id the one with the smallest ``row`` stays, so the choice is determined; of rows that
    are alike in all columns one stays.  Only the keys of rows to drop are joined with the documents.
    """
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "row")).alias("head")
    nodes = stored(rows.groupBy("node").agg(first).join(classes, "node"), "nodes")
    # stored, so that adaptive execution can split a component that most nodes are in
    best = stored(nodes.groupBy("component").agg(F.min("head").alias("head")), "best")
    to = stored(nodes.select("node", "component").join(best, "component").select("node", F.col("head.id").alias("head_id"), F.col("head.row").alias("head_row")), "heads")
    told = rows.join(to, "node").withColumn("stays", F.col("id").eqNullSafe(F.col("head_id")) & (F.col("row") == F.col("head_row")))
    told = stored(told.groupBy("id", "row").agg(F.max("stays").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"), "rows-to-drop")
    plain = [c for c in own.columns if c not in ("id", "row", "body")]
    kept = without(own, told, ["id", "row"]).select(*plain)
    again = told.where("stays")
    if again.head(1):
        kept = kept.unionAll(among(own, again, ["id", "row"]).dropDuplicates(["id", "row"]).select(*plain))
    return kept
