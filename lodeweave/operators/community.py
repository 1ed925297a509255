"""Communities of a weighted undirected graph: adjacency, modularity, components and local moving.

Each state of a loop is a table of its own: unlike a checkpoint it has its real size in the plans of the
next round, where estimates of joins of joins would grow with every round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.tables import stored

#: Rows of adjacency that one task settles: about 60 bytes each.
TASK_ROWS = 8_000_000


def adjacency(edges: DataFrame) -> DataFrame:
    """(i, j, w): each directed edge adds 1 to both directions, a loop 2 to its own."""
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    ways = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j"), (2 * F.col("n")).alias("w"))))
    both = F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j"), F.col("n").alias("w")), F.struct(F.col("b").alias("i"), F.col("a").alias("j"), F.col("n").alias("w")))
    return pairs.select(F.inline(ways.otherwise(both)))


def degrees(adjacent: DataFrame) -> DataFrame:
    return adjacent.groupBy(F.col("i").alias("id")).agg(F.sum("w").alias("degree"))


def modularity(adjacent: DataFrame, labels: DataFrame) -> DataFrame:
    """(modularity) of a partition (id, community), one row."""
    a = labels.select(F.col("id").alias("i"), F.col("community").alias("ci"))
    b = labels.select(F.col("id").alias("j"), F.col("community").alias("cj"))
    inside = adjacent.join(a, "i").join(b, "j").where("ci = cj").agg(F.coalesce(F.sum("w"), F.lit(0)).alias("inside"))
    sizes = degrees(adjacent).join(labels, "id").groupBy("community").agg(F.sum("degree").alias("d"))
    d = F.col("d").cast("double")
    parts = sizes.agg(F.sum(d).alias("total"), F.sum(d * d).alias("squares")).withColumn("inside", inside.scalar())
    return parts.select(F.round(F.col("inside") / F.col("total") - F.col("squares") / (F.col("total") * F.col("total")), 6).alias("modularity"))


def components(adjacent: DataFrame) -> DataFrame:
    """(id, component): connected components, each named by its least id.

    Nodes are numbers within: a hash of their id, which is also a random order; names are joined at the end,
    and two ids of one hash would end it with an error. In every round each node hooks to the neighbour
    that is least in that order, if that is less than itself; hooks are followed to their roots, which a
    random order keeps near; then the edges are contracted to the roots, so that the graph shrinks
    quickly. All states are materialised in the shared folder; it ends when no edge is left.
    """
    ids = stored(adjacent.select(F.col("i").alias("id")).distinct().select("id", F.xxhash64("id").alias("component")))
    if not ids.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("two ids have one hash")
    labels = ids.select(F.col("component").alias("node"), "component")
    edges = stored(adjacent.where("i != j").select(F.xxhash64("i").alias("i"), F.xxhash64("j").alias("j")).distinct())
    while not edges.isEmpty():
        hooks = stored(edges.groupBy(F.col("i").alias("node")).agg(F.min("j").alias("near")).select("node", F.least("node", "near").alias("parent")))
        while True:
            up = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
            further = stored(hooks.join(up, "parent").select("node", F.col("root").alias("parent"), (F.col("root") != F.col("parent")).alias("moved")))
            hooks = further.select("node", "parent")
            if further.where("moved").isEmpty():
                break
        to = hooks.select(F.col("node").alias("component"), F.col("parent").alias("root"))
        labels = stored(labels.join(to, "component", "left").select("node", F.coalesce("root", "component").alias("component")))
        a, b = (hooks.select(F.col("node").alias(k), F.col("parent").alias(f"{k}_root")) for k in ("i", "j"))
        edges = stored(edges.join(a, "i").join(b, "j").where("i_root != j_root").select(F.col("i_root").alias("i"), F.col("j_root").alias("j")).distinct())
    named = labels.join(ids.select("id", F.col("component").alias("node")), "node")
    names = named.groupBy("component").agg(F.min("id").alias("name"))
    return named.join(names, "component").select("id", F.col("name").alias("component"))


def numbered(labels: DataFrame) -> DataFrame:
    """(id, number): communities numbered from 0 in the order of their least ids.

    The communities are sorted in ranges; only how many each range has goes through the driver.
    """
    first = labels.groupBy("community").agg(F.min("id").alias("first"))
    ranges = stored(first.repartitionByRange("first").sortWithinPartitions("first").select("community", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")))
    sizes, before = {r.part: r["count"] for r in ranges.groupBy("part").count().collect()}, 0  # a row for each range
    offsets = []
    for part in sorted(sizes):
        offsets.append((part, before))
        before += sizes[part]
    offset = labels.sparkSession.createDataFrame(offsets, "part int, before long")
    return labels.join(ranges.join(F.broadcast(offset), "part").select("community", (F.col("place") + F.col("before")).alias("number")), "community").select("id", "number")


def communities(adjacent: DataFrame) -> DataFrame:
    """(id, community): local moving by modularity, named by a member's id.

    In each sweep every node finds the neighbouring community with the greatest gain, of equal ones its
    own or the least. Of neighbours that want to move only the one with the greatest number does, drawn
    anew for each sweep, and of the others only those whose gain is more than they can lose to all with
    lesser numbers that enter the same community or leave it: so every sweep raises the modularity, nothing
    swaps for ever, and it ends when no node wants to move, after as many sweeps as that takes. The gain
    of a move is k_in / W - k * total / W^2, the community's total counted without the node, in whole
    numbers of W^2. Nodes are numbers within, as for ``components``.

    A graph of at most ``TASK_ROWS`` rows, for which a sweep as joins is nearly all overhead, settles in
    one task; a larger one by joins and groupings. Both end by the same rule.
    """
    return named(*settle(adjacent)[::2])


def named(degree: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, community) of what ``settle`` gives, each community named by a member's id."""
    names = degree.select(F.col("node").alias("community"), F.col("id").alias("name"))
    return labels.join(degree.select("node", "id"), "node").join(names, "community").select("id", F.col("name").alias("community"))


def settle(adjacent: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``communities`` in numbers: (id, node, degree), the adjacency (i, j, w) of nodes, and (node, community)."""
    known = stored(adjacent.select("i", F.xxhash64("i").alias("node"), F.xxhash64("j").alias("other"), "w"))
    return _settle(known.select(F.col("i").alias("id"), "node").distinct(), known.select("node", "other", "w"))


def settle_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``settle`` of the adjacency of edges (src, dst), which are numbered before they are grouped, so that no ids are shuffled with them."""
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.xxhash64("id").alias("node"))
    numbers = edges.select(F.xxhash64("src").alias("src"), F.xxhash64("dst").alias("dst"))
    return _settle(ids, stored(adjacency(numbers).select(F.col("i").alias("node"), F.col("j").alias("other"), "w")))


def _settle(ids: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``settle`` of ids (id, node) and edges (node, other, w) in both directions."""
    degree = stored(ids.join(edges.groupBy("node").agg(F.sum("w").alias("degree")), "node").select("id", "node", "degree"))
    if not degree.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("two ids have one hash")
    labels = _in_task(edges) if edges.count() <= TASK_ROWS else _by_joins(edges, degree.select("node", "degree"))
    return degree, edges.select(F.col("node").alias("i"), F.col("other").alias("j"), "w"), labels


def _by_joins(edges: DataFrame, degree: DataFrame) -> DataFrame:
    """(node, community) of edges (node, other, w), a sweep at a time as joins and groupings."""
    total = degree.agg(F.sum("degree")).first()[0] or 1
    exact = "bigint" if total < 3_000_000_000 else "decimal(38,0)"  # holds W^2
    whole = lambda c: F.col(c).cast(exact)
    labels = degree.select("node", F.col("node").alias("community"), "degree")
    edges = edges.where("node != other")
    sweep = 0
    while True:
        sizes = labels.groupBy("community").agg(F.sum("degree").alias("size"))
        links = edges.join(labels.select(F.col("node").alias("other"), "community"), "other").groupBy("node", "community").agg(F.sum("w").alias("k_in"))
        near = links.unionByName(labels.select("node", "community", F.lit(0).cast("bigint").alias("k_in"))).groupBy("node", "community").agg(F.sum("k_in").alias("k_in"))  # its own always among them
        gain = whole("k_in") * F.lit(total).cast(exact) - whole("degree") * (F.col("size") - F.when(F.col("community") == F.col("own"), F.col("degree")).otherwise(F.lit(0))).cast(exact)
        rated = near.join(labels.withColumnRenamed("community", "own"), "node").join(sizes, "community").withColumn("gain", gain)
        best = rated.groupBy("node", "own", "degree").agg(F.max_by(F.struct("community", "gain"), F.struct("gain", F.col("community") == F.col("own"), -F.col("community").cast("decimal(20,0)"))).alias("best"), F.max(F.when(F.col("community") == F.col("own"), F.col("gain"))).alias("now"))
        wish = stored(best.where("best.gain > 0 and best.gain > now").select("node", "own", "degree", F.col("best.community").alias("target"), (F.col("best.gain") - F.col("now")).alias("margin"), F.xxhash64("node", F.lit(sweep)).alias("turn")))
        if wish.isEmpty():
            return labels.select("node", "community")
        both = edges.join(wish.select("node", "turn"), "node").join(wish.select(F.col("node").alias("other"), F.col("turn").alias("others")), "other")
        free = wish.join(both.where("others > turn or (others = turn and other > node)").select("node"), "node", "left_anti")
        before = lambda c: F.sum("degree").over(Window.partitionBy(c).orderBy("turn", "node").rowsBetween(Window.unboundedPreceding, -1))
        lost = whole("degree") * (F.coalesce(before("target"), F.lit(0)) + F.coalesce(before("own"), F.lit(0))).cast(exact)
        moves = free.withColumn("lost", lost).where("margin > lost").select("node", "target")
        labels = stored(labels.join(moves, "node", "left").select("node", F.coalesce("target", "community").alias("community"), "degree"))
        sweep += 1


def _in_task(edges: DataFrame) -> DataFrame:
    """(node, community) of edges (node, other, w), in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in b.columns] for b in batches]
        if parts:
            node, other, w = map(np.concatenate, zip(*parts))
            del parts
            nodes = np.unique(node)
            found = settled(*(np.searchsorted(nodes, x).astype(np.int32) for x in (node, other)), w, len(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[found])], ["node", "community"])

    return stored(edges.coalesce(1).mapInArrow(run, "node long, community long"))


def settled(node: np.ndarray, other: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """The community of each of ``n`` nodes: local moving of edges, both directions given, until no node wants to move.

    Only nodes whose rating may have changed are rated again: neighbours of what moved, and, once these
    have settled, all that touch a community whose total has changed.
    """
    degree = np.bincount(node, weights=w, minlength=n).astype(np.int64)
    total = int(degree.sum())
    order = np.argsort(node, kind="stable")
    order = order[node[order] != other[order]]
    node, other, w = node[order], other[order], w[order]
    start = np.searchsorted(node, np.arange(n + 1))
    own, size, changed = np.arange(n), degree.copy(), np.zeros(n, bool)
    random = np.random.default_rng(1)
    active = np.arange(n)
    while True:
        if len(active) == 0:
            touched = changed[own]
            touched[node[changed[own[other]]]] = True
            active, changed = np.flatnonzero(touched), np.zeros(n, bool)
            if len(active) == 0:
                return own
        who, to, margin = _wishes(active, own, size, degree, total, start, other, w)
        turn = np.full(n, -1.0)
        turn[who] = random.permutation(len(who))
        at = _rows(start, who)
        beaten = np.zeros(n, bool)
        beaten[node[at][turn[other[at]] > turn[node[at]]]] = True
        free = np.flatnonzero(~beaten[who])
        free = free[np.argsort(turn[who[free]])]
        who_, to_, d = who[free], to[free], degree[who[free]]
        may = margin[free] > d * (_before(to_, d) + _before(own[who_], d))
        moved, target = who_[may], to_[may]
        for c, sign in ((own[moved], -1), (target, 1)):
            np.add.at(size, c, sign * degree[moved])
            changed[c] = True
        own[moved] = target
        again = np.zeros(n, bool)
        again[other[_rows(start, moved)]] = True
        again[who] = True
        active = np.flatnonzero(again)


def _rows(start: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Where the edges of ``nodes`` stand, those of node v from start[v] to start[v + 1]."""
    many = start[nodes + 1] - start[nodes]
    return np.repeat(start[nodes] - np.cumsum(many) + many, many) + np.arange(many.sum())


def _before(group: np.ndarray, d: np.ndarray) -> np.ndarray:
    """For each entry the sum of ``d`` of those before it in its group."""
    order = np.argsort(group, kind="stable")
    sums = np.cumsum(d[order]) - d[order]
    first = np.diff(group[order], prepend=-1) != 0
    out = np.empty_like(sums)
    out[order] = sums - np.maximum.accumulate(np.where(first, sums, 0))
    return out


def _wishes(active: np.ndarray, own: np.ndarray, size: np.ndarray, degree: np.ndarray, total: int, start: np.ndarray, other: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of ``active`` that want to move, where to, and how much more they gain there."""
    at = _rows(start, active)
    n = len(own)
    key = np.repeat(active, start[active + 1] - start[active]) * n + own[other[at]]
    order = np.argsort(key)
    key, weight = key[order], w[at][order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    if len(first) == 0:
        return active[:0], active[:0], active[:0]
    k_in = np.add.reduceat(weight, first)
    who, to = np.divmod(key[first], n)
    home = own[who] == to
    gain = k_in * total - degree[who] * (size[to] - np.where(home, degree[who], 0))
    now = -degree * (size[own] - degree)
    now[who[home]] = gain[home]
    begin = np.flatnonzero(np.diff(who, prepend=-1))
    best = np.maximum.reduceat(gain, begin)
    place = np.flatnonzero(gain == np.repeat(best, np.diff(begin, append=len(who))))
    place = place[np.diff(who[place], prepend=-1) != 0]  # of equal ones the least
    place = place[(gain[place] > 0) & (gain[place] > now[who[place]])]
    return who[place], to[place], gain[place] - now[who[place]]


def describe(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(community, member_count, members, label): of labels (id, community) and nodes (id, name).

    Communities are named by a member's id, as in ``communities``; a node without a label is one of its own.
    Each is labelled with the first three of all its members' names in order, equal ones repeated, and how
    many more there are; where no member has a name, with the number of members. A community's ids and
    names are gathered in its row.
    """
    each = labels.select("id", "community").join(nodes.select("id", "name"), "id", "full").select(F.coalesce("community", "id").alias("community"), "id", "name")
    groups = each.groupBy("community").agg(F.count("*").alias("member_count"), F.sort_array(F.collect_list("id")).alias("members"), F.sort_array(F.collect_list("name")).alias("names"))
    known = F.size("names")
    more = F.when(known > 3, F.concat(F.lit(", +"), (known - 3).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    inside = F.when(known == 0, F.concat(F.col("member_count").cast("string"), F.lit(" members"))).otherwise(F.concat(F.array_join(F.slice("names", 1, 3), ", "), more))
    return groups.select("community", "member_count", "members", F.concat(F.lit("Community ("), inside, F.lit(")")).alias("label"))
