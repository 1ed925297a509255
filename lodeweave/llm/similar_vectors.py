"""The k most similar vectors of every vector, by vantage-point trees.

Vectors are scaled to length one, so that the nearest by distance are the most similar by cosine.
A small vantage-point tree over a bounded sample cuts the space into shards. Every vector is indexed
in its own shard and also asked for in the shards that its search radius reaches; in a shard a tree
over all its vectors answers them together. By the triangle inequality a ball can be left out if
its border is further away than the radius; ``factor`` scales the radius in that rule only. Factor 1
is exact search, less is faster and may miss some neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.tables import spread
from .rolling import U, mixed

#: Rows of the sample on which the shards' tree is fitted, at least and at most (80 MB), how many of them for each shard, and rows of those that bound a search radius.
SAMPLE_ROWS, MOST_SAMPLE_ROWS, ROWS_A_SHARD, RADIUS_ROWS = 20_000, 200_000, 4, 2_000
#: Vectors that a shard is meant to hold, and that a leaf of a shard's tree holds.
SHARD_ROWS, LEAF_ROWS = 40_000, 128


def distance(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (points @ to)))


def split(points: np.ndarray, margin: float, tries: int = 40) -> tuple[np.ndarray, float] | None:
    """A vantage point and radius: of some tried, those with the fewest points near the border, and balance."""
    some = points[:: max(1, len(points) // 2048)]
    n, best = len(some), None
    cuts = np.arange(max(1, n // 10), n - n // 10, max(1, n // 64))
    for at in np.linspace(0, n - 1, min(tries, n // 8 + 4)).astype(int):
        d = np.sort(distance(some, some[at]))
        mu = (d[cuts - 1] + d[cuts]) / 2
        near = (np.searchsorted(d, mu + margin) - np.searchsorted(d, mu - margin)) / n
        cost = near + np.abs(cuts / n - 0.5) / 2 + 9.0 * (d[cuts - 1] == d[cuts])
        if len(cuts) and (best is None or cost.min() < best[0]):
            best = (cost.min(), some[at], float(mu[cost.argmin()]))
    return best[1:] if best and best[0] < 9 else None


class Tree:
    """A vantage-point tree; leaves are numbered. ``limit``: points of a leaf."""

    def __init__(self, points: np.ndarray, limit: int, margin: float) -> None:
        self.nodes: list[tuple] = []
        self.leaves: list[np.ndarray] = []
        self._grow(points, np.arange(len(points)), limit, margin)

    def _grow(self, points: np.ndarray, rows: np.ndarray, limit: int, margin: float) -> int:
        number = len(self.nodes)
        cut = split(points[rows], margin) if len(rows) > limit else None
        if cut is None:  # small, or of equal distances from everywhere
            self.nodes.append((None, len(self.leaves), 0, 0))
            self.leaves.append(rows)
            return number
        self.nodes.append(())
        inside = distance(points[rows], cut[0]) <= cut[1]
        low = self._grow(points, rows[inside], limit, margin)
        high = self._grow(points, rows[~inside], limit, margin)
        self.nodes[number] = (cut[0], cut[1], low, high)
        return number

    def visits(self, queries: np.ndarray, reach: np.ndarray | float, outward: bool = False) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of the queries that come there): those with a ball of the size ``reach`` in it.

        ``outward``: at the border that parts two neighbours only the inner one crosses over, which is
        enough if whoever comes to a leaf is found there too.
        """
        reach = np.broadcast_to(np.asarray(reach, np.float32), len(queries))
        todo = [(0, np.arange(len(queries)), np.full(len(queries), outward))]
        while todo:
            node, rows, at_home = todo.pop()
            point, mu, low, high = self.nodes[node]
            if point is None:
                yield mu, rows
                continue
            d = distance(queries[rows], point)
            inside = d <= mu
            for child, own, keep in ((low, inside, inside | ~at_home & (d - reach[rows] <= mu)), (high, ~inside, ~inside | (d + reach[rows] > mu))):
                if keep.any():
                    todo.append((child, rows[keep], (at_home & own)[keep]))


def _merge(best_s: np.ndarray, best_i: np.ndarray, rows: np.ndarray, sims: np.ndarray, names: np.ndarray, k: int) -> None:
    """Takes new similarities into the k best of each row; of equal ones the least number stays."""
    s = np.concatenate((best_s[rows], sims), axis=1)
    i = np.concatenate((best_i[rows], np.broadcast_to(names, sims.shape)), axis=1)
    if s.shape[1] > 4 * k:
        part = np.argpartition(-s, 2 * k, axis=1)[:, : 2 * k]
        s, i = np.take_along_axis(s, part, 1), np.take_along_axis(i, part, 1)
    order = np.lexsort((i, -s), axis=1)[:, :k]
    best_s[rows], best_i[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def search(points: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, factor: float, radius: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, similarity) of up to k nearest points of each query within its ``radius``.

    ``own``: the point that a query is itself, or -1.
    """
    tree = Tree(points, LEAF_ROWS, margin)
    floor = 1 - radius.astype(np.float64) ** 2 / 2 - 1e-6
    best_s = np.full((len(queries), k), -2, np.float32)
    best_i = np.full((len(queries), k), -1, np.int64)
    home = np.full(len(queries), -1)

    def look(leaf: int, rows: np.ndarray) -> None:
        names = tree.leaves[leaf]
        if not len(names):
            return
        for at in range(0, len(rows), 4096):
            part = rows[at : at + 4096]
            sims = queries[part] @ points[names].T
            sims[(sims < floor[part][:, None]) | (names[None, :] == own[part][:, None])] = -2
            some = (sims > -2).any(axis=1)
            if some.any():
                _merge(best_s, best_i, part[some], sims[some], names, k)

    for leaf, rows in tree.visits(queries, 0.0):
        home[rows] = leaf
        look(leaf, rows)
    kth = np.sqrt(np.maximum(0, 2 - 2 * best_s[:, k - 1].astype(np.float64)))
    reach = factor * np.where(best_s[:, k - 1] > -2, np.minimum(radius, kth), radius)
    for leaf, rows in tree.visits(queries, reach):
        rows = rows[home[rows] != leaf]
        if len(rows):
            look(leaf, rows)
    q, j = np.nonzero(best_s > -2)
    return q, best_i[q, j], best_s[q, j]


def _unit(array: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable rows (as long as ``dim``, finite, not zero, no nulls) and their scaled vectors."""
    sizes = np.asarray(array.value_lengths().fill_null(-1))
    rows = np.flatnonzero(sizes == dim)
    flat = array.take(pa.array(rows)).flatten()
    x = np.asarray(flat.cast(pa.float64()).fill_null(math.nan)).reshape(-1, dim)
    norm = np.sqrt((x * x).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return rows[good], (x[good] / norm[good, None]).astype("<f4")


def similar_vectors(
    df: DataFrame,
    k: int = 10,
    factor: float = 0.12,
    min_cosine: float | None = None,
    asked: Column | None = None,
    id_col: str = "node_id",
    vector_col: str = "embedding",
    dim: int = 100,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(id, neighbour, cosine, rank): up to ``k`` most similar other ids of each id, at least ``min_cosine`` if given.

    Null, short, long, zero and not finite vectors take no part. A repeated row counts once; an id with
    several vectors is near to what any of them is near to. Of equal similarities the least id comes
    first. Ids with the very same vector are searched as one, so that a group of copies of any
    size costs k rows for each copy. ``asked``: which ids to search for, all if not given; all are
    indexed. Only a sample comes to the driver, of ``ROWS_A_SHARD`` vectors for each shard within
    ``SAMPLE_ROWS`` and ``MOST_SAMPLE_ROWS``, and the tree fitted on it (one vector for each two shards'
    border) is broadcast. Beyond 2 billion vectors shards grow instead of their number.
    """
    spark = df.sparkSession
    everyone = asked is None
    total = df.count()
    source = spread(df.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<float>").alias("v"), (F.lit(True) if everyone else F.coalesce(asked, F.lit(False))).alias("asked")).where("id is not null"))

    def unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _unit(batch.column(1), dim)
            raw = x.tobytes()
            bits = np.ascontiguousarray(x).view("<u4").astype(U)
            h = mixed((bits * (mixed(np.arange(dim)) | U(1))).sum(axis=1, dtype=U))
            h2 = mixed((bits * (mixed(np.arange(dim) + dim) | U(1))).sum(axis=1, dtype=U))
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(h2.view(np.int64)), pa.array([raw[i : i + 4 * dim] for i in range(0, len(raw), 4 * dim)], pa.binary()), batch.column(0).take(at), batch.column(2).take(at)], ["h", "h2", "v", "id", "asked"])

    units = source.mapInArrow(unit_rows, "h long, h2 long, v binary, id string, asked boolean")
    shards = max(1, math.ceil(total / shard_rows), min(2 * spark.sparkContext.defaultParallelism, total // 2000))
    most = min(MOST_SAMPLE_ROWS, max(SAMPLE_ROWS, ROWS_A_SHARD * shards))
    share = min(1.0, 1.3 * most / max(total, 1))
    head = units.where(F.abs(F.col("h") % 1_000_000_000) < int(share * 1_000_000_000)).select("v").limit(most).toArrow().column(0)
    sample = np.unique(np.frombuffer(b"".join(head.to_pylist()), "<f4").reshape(-1, dim), axis=0)
    sample = sample[np.argsort(mixed(sample.view("<u4")[:, 0]))] if len(sample) else np.zeros((0, dim), np.float32)
    widest = 2.0 if min_cosine is None else math.sqrt(2 - 2 * min_cosine)
    margin = factor * widest / (1 if min_cosine is not None else 10)
    top = spark.sparkContext.broadcast((Tree(sample, max(1, math.ceil(len(sample) / shards * 1.5)), margin), sample[:RADIUS_ROWS]))

    # Copies of a vector become one row; its k + 1 least ids stand for them. No task sends more than k + 2 of them.

    def within_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = dict(zip(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4))), range(batch.num_rows)))
            yield batch.take(pa.array(sorted(seen.values()), pa.int64()))

    once = units.mapInArrow(within_batch, "h long, h2 long, v binary, id string, asked boolean")
    least = once.withColumn("n", F.dense_rank().over(Window.partitionBy("h", "h2").orderBy("id"))).where(F.col("n") <= k + 2)
    classes = least.groupBy("h", "h2").agg(F.first("v").alias("v"), F.array_sort(F.collect_set(F.when(F.col("n") <= k + 1, F.struct("id", "asked")))).alias("ids"), F.max("n").cast("long").alias("n"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, bound = top.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<f4").reshape(-1, dim)
            ask = np.array([any(i["asked"] for i in ids) for ids in batch.column(3).to_pylist()])
            radius = np.full(len(x), widest, np.float32)
            if min_cosine is None and len(bound) > k and ask.any():
                near = -np.partition(-(x[ask] @ bound.T), k, axis=1)[:, k]  # one more than k: it may itself be in the sample
                radius[ask] = np.sqrt(np.maximum(0, 2 - 2 * near))
            home = np.full(len(x), -1)
            for leaf, rows in tree.visits(x, 0.0):
                home[rows] = leaf
            parts = [(home, np.arange(len(x)), True)]
            at = np.flatnonzero(ask)
            for leaf, rows in tree.visits(x[at], factor * radius[at], outward=everyone):
                rows = at[rows]
                rows = rows[home[rows] != leaf]
                parts.append((np.full(len(rows), leaf), rows, False))
            for shard, rows, is_home in parts:
                if len(rows):
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(np.full(len(rows), is_home)), batch.column(2).take(take), batch.column(3).take(take), pa.array(radius[rows])], ["shard", "home", "v", "ids", "radius"])

    routed = classes.mapInArrow(route, "shard int, home boolean, v binary, ids array<struct<id:string,asked:boolean>>, radius float")

    def in_shard(table: pa.Table) -> pa.Table:
        home = np.asarray(table.column("home").combine_chunks())
        x = np.frombuffer(b"".join(table.column("v").to_pylist()), "<f4").reshape(-1, dim)
        ids = table.column("ids").to_pylist()
        ask = np.array([any(i["asked"] for i in g) for g in ids])
        radius = np.asarray(table.column("radius").combine_chunks())
        points, queries = np.flatnonzero(home | everyone), np.flatnonzero(ask)  # if all are asked for, visitors are found too
        own = np.full(len(x), -1)
        own[points] = np.arange(len(points))
        q, p, s = search(x[points], x[queries], own[queries], k, factor, radius[queries], margin)
        out: list[tuple] = []
        for a, b, sim in zip(queries[q].tolist(), points[p].tolist(), s.tolist()):
            for i in ids[a]:
                if i["asked"]:
                    out += [(i["id"], j["id"], sim) for j in ids[b] if j["id"] != i["id"]]
        for a in np.flatnonzero(home).tolist():
            if len(ids[a]) > 1:
                for i in ids[a]:
                    if i["asked"]:
                        out += [(i["id"], j["id"], 1.0) for j in ids[a] if j["id"] != i["id"]][:k]
        a, b, s = zip(*out) if out else ((), (), ())
        return pa.table([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(s, pa.float64())], ["id", "neighbour", "cosine"])

    found = routed.groupBy("shard").applyInArrow(in_shard, "id string, neighbour string, cosine double")
    # The other members of a large group of copies: their nearest are the group's least ids.
    large = classes.where(F.col("n") > k + 1).select("h", "h2", F.slice("ids", 1, k).alias("least"), "ids")
    others = (
        units.where("asked").select("h", "h2", "id").join(large, ["h", "h2"]).where(~F.array_contains(F.col("ids.id"), F.col("id")))
        .select("id", F.explode("least.id").alias("neighbour"), F.lit(1.0).alias("cosine"))
    )
    best = found.union(others).groupBy("id", "neighbour").agg(F.least(F.max("cosine"), F.lit(1.0)).alias("cosine"))
    order = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
