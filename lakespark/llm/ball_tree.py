"""Exact top-k inner products by ball trees.

A bounded sample parts space into leaves, so that a shard holds vectors that lie together; each shard has a ball tree and
a ball around all of it.  The balls are few and known to every task.  A query visits shards in rounds, those with the highest
upper bounds ``q.c + |q| r`` first and four times as many in each round, as long as the bound reaches its k-th score so
far, which goes from shard to shard; within a shard it descends the tree in the same order.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stored

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_HITS = "query_id long, query_row long, vec_id long, row long, score long"
#: Bytes of the routing tree, and of the balls, that go to every task at most.
MOST_BYTES = 32 << 20
#: Lengths of vectors that have shards of their own by place, the most frequent ones; rows of others are dealt by hash.
LENGTHS = 64


def quantised(vectors: pa.Array) -> np.ndarray:
    """floor(64 * x) of vectors of one length, as whole doubles."""
    if not len(vectors):
        return np.empty((0, 0))
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(64 * flat).reshape(len(vectors), -1)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products as int64; those beyond its range take its ends."""
    top = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    if top < 2**53:
        return (q @ x.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(q).dot(whole(x).T)
    return np.vectorize(lambda v: min(max(v, _LOW), _HIGH), otypes=[np.int64])(exact)


class BallTree:
    """Rows in the order of the leaves; for each node its centre, radius, rows and children (-1: a leaf)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = 256, rows: np.ndarray | None = None):
        order = np.arange(len(ids))
        centres, radii, spans, children = [], [], [], []

        def grow(a: int, z: int) -> int:
            me, part = len(centres), x[order[a:z]]
            centre = part.mean(0)
            centres.append(centre)
            radii.append(float(np.sqrt(((part - centre) ** 2).sum(1).max(initial=0))))
            spans.append((a, z))
            children.append((-1, -1))
            if z - a > leaf and radii[me] > 0:
                far = part[((part - centre) ** 2).sum(1).argmax()]
                other = part[((part - far) ** 2).sum(1).argmax()]
                side = np.argsort(part @ (other - far), kind="stable")
                order[a:z] = order[a:z][side]
                middle = (a + z) // 2
                children[me] = (grow(a, middle), grow(middle, z))
            return me

        grow(0, len(ids))
        self.ids, self.x, self.rows = ids[order], x[order], (ids if rows is None else rows)[order]
        self.centres, self.radii, self.spans, self.children = np.array(centres), np.array(radii), spans, children

    def bounds(self, q: np.ndarray, norms: np.ndarray, nodes: list[int]) -> np.ndarray:
        """Upper bounds of the products of queries with any row of nodes, with room for rounding."""
        b = q @ self.centres[nodes].T + norms[:, None] * self.radii[nodes]
        return b + 1e-9 * (np.abs(b) + norms[:, None] * (np.sqrt((self.centres[nodes] ** 2).sum(1)) + self.radii[nodes])) + 1e-6


class Best:
    """The k best of each query so far: higher scores first, then smaller ids.  ``own`` are the queries' own rows."""

    def __init__(self, own: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int):
        self.own, self.q, self.k, self.floor = own, q, k, floor
        self.norms = np.sqrt((q**2).sum(1))
        self.scores = np.full((len(own), k), _LOW)
        self.ids = np.full((len(own), k), _HIGH)
        self.rows = np.full((len(own), k), -1)

    def kth(self) -> np.ndarray:
        return np.maximum(self.scores[:, -1], self.floor)

    def offer(self, who: np.ndarray, ids: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
        """Rows' scores for some queries; a query's own row is left out."""
        own = rows[None, :] == self.own[who][:, None]
        hit = np.flatnonzero(((scores >= self.kth()[who][:, None]) & ~own).any(1))
        if not len(hit):
            return
        mine = who[hit]
        wide = lambda a: np.broadcast_to(a, (len(hit), len(ids)))
        s = np.concatenate([self.scores[mine], np.where(own[hit], _LOW, scores[hit])], 1)
        i = np.concatenate([self.ids[mine], np.where(own[hit], _HIGH, wide(ids))], 1)
        r = np.concatenate([self.rows[mine], np.where(own[hit], -1, wide(rows))], 1)
        order = np.lexsort((r, i, -np.maximum(s, _LOW + 1)))[:, : self.k]
        self.scores[mine], self.ids[mine], self.rows[mine] = (np.take_along_axis(a, order, 1) for a in (s, i, r))

    def search(self, tree: BallTree) -> int:
        """Offers all rows of a tree that can matter; returns the number of leaves looked at."""
        looked, turn = 0, 0
        top = tree.bounds(self.q, self.norms, [0])[:, 0]
        heap = [(-float(top.max(initial=-np.inf)), 0, 0, np.arange(len(self.own)), top)]
        while heap:
            _, _, node, who, bound = heapq.heappop(heap)
            live = bound >= self.kth()[who]
            who = who[live]
            if not len(who):
                continue
            left, right = tree.children[node]
            if left < 0:
                a, z = tree.spans[node]
                self.offer(who, tree.ids[a:z], tree.rows[a:z], products(self.q[who], tree.x[a:z]))
                looked += 1
                continue
            both = tree.bounds(self.q[who], self.norms[who], [left, right])
            for k, child in enumerate((left, right)):
                turn += 1
                heapq.heappush(heap, (-float(both[:, k].max()), turn, child, who, both[:, k]))
        return looked


def _halves(x: np.ndarray) -> tuple[np.ndarray, float] | None:
    """A direction and a place on it that part rows into two groups that lie together, neither of them tiny; None if all are alike."""
    a = x[((x - x.mean(0)) ** 2).sum(1).argmax()]
    b = x[((x - a) ** 2).sum(1).argmax()]
    if (a == b).all():
        return None
    for _ in range(4):
        side = x @ (b - a) > (b - a) @ (a + b) / 2
        if min(side.sum(), (~side).sum()) < 0.05 * len(x):
            break
        a, b = x[~side].mean(0), x[side].mean(0)
    else:
        return b - a, float((b - a) @ (a + b) / 2)
    at = x @ (b - a)
    place = float(np.sort(at)[(len(at) - 1) // 2])
    return b - a, place if (at > place).any() else float(np.nextafter(at.max(), -np.inf))


def parting(sample: np.ndarray, leaves: int) -> list | int:
    """Nested [direction, place, below, above] that deals vectors to leaves; a leaf is its number."""
    number = iter(range(leaves + 1))

    def grow(x: np.ndarray, share: int) -> list | int:
        found = _halves(x) if share > 1 and len(x) > 1 else None
        if found is None:
            return next(number)
        below = x @ found[0] <= found[1]
        of = min(share - 1, max(1, round(share * below.mean())))
        return [*found, grow(x[below], of), grow(x[~below], share - of)]

    return grow(sample, leaves)


def leaves_of(tree: list | int, x: np.ndarray) -> np.ndarray:
    found = np.zeros(len(x), np.int32)

    def go(node, who: np.ndarray) -> None:
        if not isinstance(node, list):
            found[who] = node
        elif len(who):
            below = x[who] @ node[0] <= node[1]
            go(node[2], who[below])
            go(node[3], who[~below])

    go(tree, np.arange(len(x)))
    return found


def _deal(trees: dict[int, list | int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            leaf = np.zeros(len(dims), np.int32)
            for d in np.unique(dims).tolist():
                if isinstance(trees.get(d), list):
                    who = np.flatnonzero(dims == d)
                    leaf[who] = leaves_of(trees[d], quantised(b.column("embedding").take(pa.array(who))))
            yield b.append_column("leaf", pa.array(leaf))

    return run


def _grow(leaf: int):
    def run(rows: pa.Table) -> pa.Table:
        # a fixed order, so that a task that runs again gives the same tree
        rows = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        tree = BallTree(rows.column("vec_id").to_numpy(), quantised(rows.column("embedding").combine_chunks()), leaf, rows.column("row").to_numpy())
        return pa.table({
            **{c: rows.column(c).slice(0, 1) for c in ("dim", "leaf", "sub")}, "centre": pa.array([tree.centres[0].tolist()], pa.list_(pa.float64())), "radius": pa.array([tree.radii[0]], pa.float64()), "tree": pa.array([pickle.dumps(tree, 5)], pa.binary()),
        })

    return run


class Balls:
    """The balls around the shards of vectors of one length, by shard number."""

    def __init__(self, shards: np.ndarray, centres: np.ndarray, radii: np.ndarray):
        self.shards, self.centres, self.radii = shards, centres, radii

    def bounds(self, q: np.ndarray) -> np.ndarray:
        norms = np.sqrt((q**2).sum(1))
        b = q @ self.centres.T + norms[:, None] * self.radii
        return b + 1e-9 * (np.abs(b) + norms[:, None] * (np.sqrt((self.centres**2).sum(1)) + self.radii)) + 1e-6


def _visits(balls: dict[int, Balls], sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int, first: int, last: int):
    """The shards that a query visits in this round: from ``first`` to ``last`` in the order of bounds, if they can matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                dims, rows = b.column("dim").to_numpy(), b.column("row").to_numpy()
                kth = b.column("kth").to_numpy().copy()
                place, shard = [], []
                for d in np.unique(dims).tolist():
                    who = np.flatnonzero(dims == d)
                    q = quantised(b.column("embedding").take(pa.array(who)))
                    known, x = sample.get(d, (np.empty(0, np.int64), q[:0]))
                    if len(known) > k:
                        s = np.where(known[None, :] == rows[who][:, None], _LOW, products(q, x))
                        kth[who] = np.maximum(kth[who], np.partition(s, len(known) - k, 1)[:, len(known) - k])
                    bounds = balls[d].bounds(q)
                    order = np.argsort(-bounds, axis=1, kind="stable")[:, first:last]
                    i, j = np.nonzero(np.take_along_axis(bounds, order, 1) >= kth[who][:, None])
                    place.append(who[i])
                    shard.append(balls[d].shards[order[i, j]])
                place, shard = np.concatenate(place), np.concatenate(shard)
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *(b.column(c).take(pa.array(place)) for c in ("vec_id", "row", "embedding")), pa.array(kth[place])], ["shard", "vec_id", "row", "embedding", "kth"])

    return run


def _search(k: int):
    def run(queries: pa.Table, trees: pa.Table) -> pa.Table:
        parts = []
        if queries.num_rows and trees.num_rows:
            ids, own = queries.column("vec_id").to_numpy(), queries.column("row").to_numpy()
            best = Best(own, quantised(queries.column("embedding").combine_chunks()), queries.column("kth").to_numpy(), k)
            for tree in trees.column("tree"):
                best.search(pickle.loads(tree.as_buffer()))
            who, place = np.nonzero(best.ids < _HIGH)
            parts = [ids[who], own[who], best.ids[who, place], best.rows[who, place], best.scores[who, place]]
        parts = parts or [np.empty(0, np.int64)] * 5
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("query_id", "query_row", "vec_id", "row", "score"), parts)})

    return run


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _met(visits: DataFrame, trees: DataFrame, key: str, k: int, block: int) -> DataFrame:
    """Hits of queries in the shards that they visit; a shard with many queries meets them in blocks."""
    blocks = visits.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    asked = visits.join(blocks, key).withColumn("block", F.expr("cast(pmod(xxhash64(row), blocks) as int)")).drop("blocks")
    held = trees.select(key, "tree").join(blocks.toDF(key, "times"), key).select(key, "tree", F.explode(F.expr("sequence(0, times - 1)")).alias("block"))
    return asked.groupBy(key, "block").cogroup(held.groupBy(key, "block")).applyInArrow(_search(k), _HITS)


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, shard: int = 4096, block: int = 4096, most: int = 8192, leaf: int = 256, sample: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` highest inner products of each row whose id is divisible by ``every``.

    Vectors are compared as floor(64 * x) with those of the same length; ties go to smaller ids.  Rows
    take no part if the vector is null or holds a null or non-finite component, or if the id is null.  Each row is a query
    and a candidate of its own, so rows that repeat an id are candidates of each other; only a query's own row is left out.
    Of rows with one vector, the ``k`` + 1 smallest ids are candidates: more can't be among a query's best.  Scores beyond a
    long take its ends.  No rows give no rows.  Other columns are not read.

    Shards have about ``shard`` rows, or more once there are ``most`` of them, so that what all tasks
    know of them has a bounded size; a leaf of many rows is several shards.  Tasks meet one shard and ``block`` queries.  At
    most ``sample`` rows of a length give queries a first k-th score.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    rows = stored(rows.withColumn("dim", F.size("embedding")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = rows.where(F.col("vec_id") % every == 0)
    # Spark drops what lies beyond the limit before rows of one vector meet
    alike = Window.partitionBy(F.xxhash64("embedding"), "embedding").orderBy("vec_id", "row")
    held = rows.withColumn("place", F.row_number().over(alike)).where(F.col("place") <= k + 1).drop("place")
    lengths = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.col("vec_id") % every == 0).alias("asked")).where("asked").orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()
    trees: dict[int, list | int] = {}
    first: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    target: dict[int, int] = {}
    total = sum(r["n"] for r in lengths)
    for r in lengths:
        dim, own = r["dim"], rows.where(F.col("dim") == r["dim"])
        # a length's part of what may go to every task
        bytes_of = int(MOST_BYTES * r["n"] / total) // (8 * max(1, dim))
        leaves = max(1, min(int(most * r["n"] / total), bytes_of, -(-r["n"] // shard)))
        target[dim] = max(shard, -(-r["n"] // leaves))
        size = max(2 * k, min(max(sample, 16 * leaves), bytes_of))
        some = own.orderBy(F.xxhash64("row")).limit(size).select("row", "embedding").toArrow().sort_by("row")
        x = quantised(some.column("embedding").combine_chunks())
        trees[dim] = parting(x, leaves) if leaves > 1 else 0
        first[dim] = some.column("row").to_numpy()[:sample], x[:sample]
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dealt = stored(held.mapInArrow(_deal(trees), "vec_id long, embedding array<double>, dim int, row long, leaf int"), "dealt-vectors")
    goal = F.coalesce(F.element_at(F.create_map(*(F.lit(v) for d in target for v in (d, target[d]))), F.col("dim")), F.lit(shard))
    sizes = dealt.groupBy("dim", "leaf").agg(F.count("*").alias("n")).withColumn("subs", F.greatest(F.lit(1), F.round(F.col("n") / goal)).cast("int")).drop("n")
    shards = dealt.join(sizes, ["dim", "leaf"]).withColumn("sub", F.expr("cast(pmod(xxhash64(row), subs) as int)")).drop("subs")
    grown = stored(shards.groupBy("dim", "leaf", "sub").applyInArrow(_grow(leaf), "dim int, leaf int, sub int, centre array<double>, radius double, tree binary"), "ball-trees")
    routed = F.col("dim").isin(list(target))
    told = grown.where(routed).select("dim", "leaf", "sub", "centre", "radius").orderBy("dim", "leaf", "sub").toArrow()  # at most about twice ``most``
    balls: dict[int, Balls] = {}
    numbers: list[tuple[int, int, int, int]] = []
    dims, centres, radii = told.column("dim").to_numpy(), told.column("centre").to_pylist(), told.column("radius").to_numpy()
    for d in target:
        who = np.flatnonzero(dims == d)
        balls[d] = Balls(who, np.array([centres[w] for w in who], np.float64).reshape(len(who), d), radii[who])
    numbers = [(int(a), int(b), int(c), n) for n, (a, b, c) in enumerate(zip(dims.tolist(), told.column("leaf").to_pylist(), told.column("sub").to_pylist()))]
    numbered = grown.join(F.broadcast(spark.createDataFrame(numbers, "dim int, leaf int, sub int, shard int")), ["dim", "leaf", "sub"])
    best = kth = None
    at, step, widest = 0, 1, max(len(b.shards) for b in balls.values())
    mine = asked.where(routed).select("vec_id", "row", "dim", "embedding")
    while at < widest:
        # a query's k-th score so far; the first ones come from the sample
        now = mine.withColumn("kth", F.lit(_LOW)) if kth is None else mine.join(kth, mine["row"] == kth["query_row"], "left").select("vec_id", "row", "dim", "embedding", F.coalesce("kth", F.lit(_LOW)).alias("kth"))
        visits = stored(now.mapInArrow(_visits(balls, first, k, at, at + step), "shard int, vec_id long, row long, embedding array<double>, kth long"), "visits")
        at, step = at + step, 4 * step
        if not visits.head(1):
            break  # bounds only fall from here on
        hits = _met(visits, numbered, "shard", k, block)
        best = stored(_ranked(hits if best is None else hits.unionAll(best.drop("rank")), k), "best")
        kth = best.where(F.col("rank") == k).select("query_row", F.col("score").alias("kth"))
    # lengths beyond the most frequent ones: each query meets all vectors of its length
    rest = asked.where(~routed).select(F.col("dim").alias("length"), "vec_id", "row", "embedding")
    if rest.head(1):
        others = _met(rest.withColumn("kth", F.lit(_LOW)), grown.where(~routed).withColumnRenamed("dim", "length"), "length", k, block)
        others = _ranked(others, k)
        best = others if best is None else best.unionAll(others)
    return best.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
