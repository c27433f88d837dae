"""Nearest neighbours by cosine with a hierarchical k-means tree.

The tree is fitted on the driver on a bounded sample (the vectors whose id
hashes lowest: an eighth of them, ``sample`` at least, and at most as many as
``sample_mb`` of doubles hold): each node splits its vectors into ``branch``
clusters of unit vectors until a leaf stands for some ``leaf`` rows of the table.
Where the sample is too small for that, leaves grow with the table.  Every row of
the table is then put in the leaf it descends to.  A query visits leaves best bin
first: a priority queue holds open branches by their centre's distance, the
nearest is opened first, and leaves come out in that order.

Leaves come out in falling order of their *reach*, the least cosine of the query
with a centre on the leaf's path, so that a query's visits are the leaves whose
reach is not under that of the last one.  This one number goes with the query in
place of a list of leaves.

How many leaves a query visits is calibrated: for ``probes`` queries the true
neighbours are found by comparison with all rows, and visits are widened until
``recall`` of those of one half of the probes lie in visited leaves; the same
number then serves all queries.  The recall of the other half, which took no
part in this, is returned beside the results (that of all, if there are under
twenty).  Vectors that fill their space evenly need most leaves for a high
recall, whatever the tree; then the search compares most rows.

Equal vectors are one entry with the smallest ids that any query can need
(k + 1 of them), so copies neither fill a leaf nor multiply comparisons, and
equal queries are searched once.  Neighbouring leaves make a tile of rows, a leaf
beyond its size several; a tile meets the queries that visit one of its leaves, in
groups of bounded size, and each leaf in it is compared with its own visitors.
What is shuffled grows with rows times groups and visitors times tiles, the work
with the rows of visited leaves; no task holds more than a tile and a group.
Cosines are computed in double precision on the original vectors; nearest first,
ties to the smaller id.

Vectors that are null, empty, zero, of another length than most, or hold null
or non-finite components take no part, as queries or candidates; neither do rows
of null id.  With fewer candidates than k, all are returned.  Repeated ids are
separate candidates of one id.  Other columns are ignored.  An empty table gives
no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import drop, join_skewed, stage


def _unit(x: np.ndarray) -> np.ndarray:
    # largest component first: squares of very large or small ones stay finite
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of one query (or of as many) with rows, each dot product on its own,
    so that a pair's value does not depend on what stands beside it."""
    a, b = q / np.abs(q).max(-1, keepdims=True), x / np.abs(x).max(1, keepdims=True)
    return np.clip((b * a).sum(1) / (np.sqrt((b * b).sum(1)) * np.sqrt((a * a).sum(-1))), -1.0, 1.0)


#: Numbers in a matrix that is made for a moment.
MATRIX = 1 << 22
#: Two ways to the same cosine differ by less.
NEAR = 1e-9


@dataclass
class Tree:
    """Nodes in arrays: children of node i are ``first[i] .. first[i] + n[i]``
    with unit centres; n = 0 for a leaf."""

    centres: np.ndarray
    parent: np.ndarray
    first: np.ndarray
    n: np.ndarray

    def descend(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each (unit) row."""
        at = np.zeros(len(x), np.int64)
        while len(open_ := np.flatnonzero(self.n[at])):
            open_ = open_[np.argsort(at[open_], kind="stable")]
            for rows in np.split(open_, np.flatnonzero(np.diff(at[open_])) + 1):
                first = self.first[at[rows[0]]]
                at[rows] = first + np.argmax(x[rows] @ self.centres[first : first + self.n[at[rows[0]]]].T, 1)
        return at

    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.n == 0)

    def paths(self, leaves: np.ndarray) -> list[np.ndarray]:
        """The centres of the nodes on the paths of some leaves, then step by step the
        places of nodes and of their parents, and at last the leaves' places."""
        levels = [np.unique(leaves)]
        while len(up := levels[-1][levels[-1] > 0]):
            levels.append(np.unique(self.parent[up]))
        nodes = np.unique(np.concatenate(levels))
        depth = np.zeros(len(nodes), np.int64)
        above = np.searchsorted(nodes, np.maximum(self.parent[nodes], 0))
        for i in range(1, len(nodes)):  # a parent's number is below its children's
            depth[i] = depth[above[i]] + 1
        levels = [np.flatnonzero(depth == d) for d in range(1, depth.max(initial=0) + 1)]
        steps = [x for at in levels for x in (at, above[at])]
        return [self.centres if len(nodes) == len(self.centres) else self.centres[nodes], *steps, np.searchsorted(nodes, leaves)]

    @staticmethod
    def reach(q: np.ndarray, paths: list[np.ndarray]) -> np.ndarray:
        """Of each (unit) query and leaf of ``paths``: the least cosine of the query
        with a centre on the way.  Best bin first takes leaves in its falling order."""
        centres, *steps, leaves = paths
        s = q @ centres.T
        s[:, 0] = np.inf  # the root
        for at, above in zip(steps[::2], steps[1::2], strict=True):
            s[:, at] = np.minimum(s[:, at], s[:, above])
        return s[:, leaves]


def grow(x: np.ndarray, branch: int, leaf: int, seed: int = 7, rounds: int = 8) -> Tree:
    """k-means of unit vectors, node by node, in blocks of them: beside ``x`` it
    holds their numbers and the tree."""
    rng = np.random.default_rng(seed)
    centres, parent, first, n = [np.zeros((1, x.shape[1]))], [-1], [0], [0]

    def assign(rows: np.ndarray, c: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
        """The nearest centre of each row; ``sums`` gets those of their vectors."""
        near = np.empty(len(rows), np.int64)
        for i in range(0, len(rows), 8192):
            part = x[rows[i : i + 8192]]
            near[i : i + 8192] = own = np.argmax(part @ c.T, 1)
            if sums is not None:
                sums += (own == np.arange(len(c))[:, None]).astype(np.float64) @ part
        return near

    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= leaf:
            continue
        k = min(branch, len(rows))
        c = x[rows[rng.choice(len(rows), k, replace=False)]]
        for _ in range(rounds):
            has = np.bincount(assign(rows, c, sums := np.zeros_like(c)), minlength=k) > 0
            c[has] = sums[has] / np.maximum(np.linalg.norm(sums[has], axis=1, keepdims=True), 1e-12)
        near = assign(rows, c)
        used = np.flatnonzero(np.bincount(near, minlength=k))
        if len(used) < 2:
            continue
        first[node], n[node] = len(n), len(used)
        centres.append(c[used])
        for j in used.tolist():
            parent.append(node)
            first.append(0)
            n.append(0)
            todo.append((len(n) - 1, rows[near == j]))
    return Tree(np.concatenate(centres), np.array(parent), np.array(first), np.array(n))


def top(q: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the rows of its k largest cosines (more, where the k-th is
    tied: ids settle that later) and these.  One matrix product finds them, give
    or take its rounding; their cosines are then computed singly."""
    rough = _unit(q) @ _unit(x).T
    for i, r in enumerate(rough):
        keep = np.flatnonzero(r >= np.partition(r, len(r) - k)[len(r) - k] - 1e-9) if len(r) > k else np.arange(len(r))
        yield keep, cosines(q[i], x[keep])


def _rows(column, kind: str) -> np.ndarray:
    """Vectors kept as bytes of numbers of a kind, as a matrix of these."""
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            yield pd.DataFrame({"v": [r.tobytes() for r in _unit(np.stack(pdf["v"].to_numpy()).astype("<f8"))]})


def _sampled(entries: DataFrame, width: int, n: int, wanted: int) -> np.ndarray:
    """Some ``wanted`` unit vectors, those whose ids' hashes lie below a bound: no order
    is made.  They come as bytes, into a matrix made beforehand, so that the driver
    holds them once."""
    share = F.shiftrightunsigned(F.xxhash64(F.element_at("ids", 1)), 11).cast("double") / float(1 << 53)
    picked = entries.filter(share < wanted / n) if wanted < n else entries
    x = np.empty((min(n, wanted + 6 * int(wanted**0.5) + 10), width))
    at = 0
    for r in picked.select("v").mapInPandas(_units, "v binary").toLocalIterator():
        if at < len(x):
            x[at] = np.frombuffer(r["v"], "<f8")
            at += 1
    if not at:  # a bound below which no hash lies
        return _unit(np.array([entries.first()["v"]], np.float64))
    return x[:at]


def _tiles(leaves: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first tile of each leaf and how many it has: leaves in a row share one
    while their rows are no more than ``most``, a larger leaf has several of its own."""
    first, many, tile, held = np.zeros(len(leaves), np.int64), np.ones(len(leaves), np.int64), 0, 0
    for i, c in enumerate(counts.tolist()):
        if held and held + c > most:
            tile, held = tile + 1, 0
        first[i], held = tile, held + c
        if c > most:
            many[i] = -(-c // most)
            tile, held = tile + many[i], 0
    return first, many


class _Held:
    """The ``k`` nearest rows of each query so far: score, and of equal scores the
    smallest first id and entry."""

    def __init__(self, n: int, k: int):
        self.k, self.s = k, np.full((n, k), -np.inf)
        self.e, self.f = np.full((2, n, k), np.iinfo(np.int64).max)

    def add(self, q: np.ndarray, s: np.ndarray, e: np.ndarray, f: np.ndarray) -> None:
        own = np.unique(q)
        of = np.concatenate([np.repeat(own, self.k), q])
        s, e, f = (np.concatenate([x[own].ravel(), y]) for x, y in ((self.s, s), (self.e, e), (self.f, f)))
        order = np.lexsort((e, f, -s, of))
        of = of[order]
        order = order[np.arange(len(of)) - np.searchsorted(of, of) < self.k]
        for x, y in ((self.s, s), (self.e, e), (self.f, f)):
            x[own] = y[order].reshape(len(own), self.k)


def compare(q: np.ndarray, least: np.ndarray, x: np.ndarray, leaf: np.ndarray, e: np.ndarray, f: np.ndarray, tree: Tree, k: int, step: int = 2048) -> Iterator[tuple[np.ndarray, ...]]:
    """Each leaf's rows of a tile with the queries whose ``least`` reach it has.
    Matrix products of at most ``step`` queries and rows find those that can be among
    the k nearest, whose cosines are then computed singly.  For some queries at a
    time: their places, and score, entry and first id of the k best."""
    by = np.argsort(leaf, kind="stable")
    x, e, f = x[by], e[by], f[by]
    unit = np.concatenate([_unit(x[i : i + step].astype("<f8")) for i in range(0, len(x), step)])
    leaves, starts = np.unique(leaf[by], return_index=True)
    ends, paths = [*starts[1:].tolist(), len(x)], tree.paths(leaves)
    step_q = max(1, min(step, MATRIX // len(paths[0])))
    for at in range(0, len(q), step_q):
        mine = q[at : at + step_q].astype("<f8")
        uq, held = _unit(mine), _Held(len(mine), k)
        visits = tree.reach(uq, paths) >= least[at : at + step_q, None] - NEAR
        for j, (begin, end) in enumerate(zip(starts.tolist(), ends, strict=True)):
            asking = np.flatnonzero(visits[:, j])
            for a in range(begin, end, step) if len(asking) else ():
                b = min(end, a + step)
                rough = uq[asking] @ unit[a:b].T
                hit = np.flatnonzero(rough.max(1) >= held.s[asking, -1] - NEAR)
                if not len(hit):
                    continue
                rough, own = rough[hit], asking[hit]
                bar = held.s[own, -1]
                if b - a > k:
                    bar = np.maximum(bar, np.partition(rough, b - a - k, axis=1)[:, b - a - k])
                i, r = np.nonzero(rough >= bar[:, None] - NEAR)
                for c in range(0, len(i), 1 << 16):
                    of, row = own[i[c : c + (1 << 16)]], a + r[c : c + (1 << 16)]
                    held.add(of, cosines(mine[of], x[row].astype("<f8")), e[row], f[row])
        i, r = np.nonzero(held.s > -np.inf)
        yield at + i, held.s[i, r], held.e[i, r], held.f[i, r]


def nearest(
    table: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", branch: int = 16, leaf: int = 256,
    sample: int = 16384, sample_mb: int = 128, probes: int = 200, recall: float = 0.97, tile_mb: int = 64
) -> DataFrame:
    """Per query and rank: query_id, rank, vec_id, score, and ``visits`` and
    ``probe_recall``: leaves visited of each query (and those of the same reach as
    the last), and the share of the true neighbours of the probes kept apart that
    lie in as many leaves."""
    spark = table.sparkSession
    of = table.schema[vector].dataType
    # single precision is carried as it is, other numbers as doubles; all is computed in doubles
    kind, of = ("<f4", "float") if isinstance(of, T.ArrayType) and isinstance(of.elementType, T.FloatType) else ("<f8", "double")
    v = F.transform(F.col(vector), lambda x: x.cast(of))
    sound = F.col(vector).isNotNull() & F.forall(
        v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    ) & F.exists(v, lambda x: x != 0)
    rows = table.select(
        F.col(key).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), v.alias("v"),
        F.coalesce(sound, F.lit(False)).alias("ok")
    ).filter("ok AND id IS NOT NULL").drop("ok")
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double, visits int, probe_recall double"
    if size is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("v") == size["n"])

    # one entry for equal vectors, with the ids a query can need; the limit acts before the shuffle
    by_id = Window.partitionBy("v").orderBy("id")
    few = rows.select("v", "id").withColumn("r", F.row_number().over(by_id)).filter(F.col("r") <= k + 1)
    entries = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("e", F.monotonically_increasing_id())
    entries = stage(entries, "vectors")
    n_entries = entries.count()
    wanted = max(1, min(max(sample, n_entries // 8), (sample_mb << 20) // (8 * size["n"])))
    x = _sampled(entries, size["n"], n_entries, wanted)
    tree = grow(_unit(x), branch, max(4, leaf * len(x) // n_entries))
    del x
    shared = spark.sparkContext.broadcast(tree)
    leaves = tree.leaves()

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                m = np.stack(pdf["v"].to_numpy()).astype(kind)
                yield pd.DataFrame({"v": [r.tobytes() for r in m], "ids": pdf["ids"], "e": pdf["e"], "leaf": shared.value.descend(_unit(m.astype("<f8")))})

    located = stage(entries.mapInPandas(locate, "v binary, ids array<long>, e long, leaf long"), "leaves")

    # distinct queries, and which ids ask them: many ids may ask with one vector
    asked = rows.filter("asks").select("v", F.col("id").alias("query_id"))
    times = stage(asked.groupBy("v").agg(F.count("*").alias("times")).join(entries.select("v", "e"), "v"), "asked-vectors")
    most = max(1000, (times.agg(F.sum("times")).first()[0] or 0) // max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    asking = stage(
        join_skewed(asked, times.select("v", "e", "times"), "v", "times", most, "inner").select("query_id", F.col("e").alias("q")), "asking"
    )
    queries = stage(times.select("e", "times").join(located.select("e", "v"), "e"), "queries")

    # calibration: true neighbours of some queries among all rows
    some = [(r["e"], np.frombuffer(bytes(r["v"]), kind).astype("<f8")) for r in queries.orderBy(F.xxhash64("e"), "e").limit(probes).select("e", "v").collect()]
    probe = spark.sparkContext.broadcast(some)

    def truth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, list[tuple[float, int, int]]] = {e: [] for e, _ in probe.value}
        for pdf in batches if probe.value else ():
            if not len(pdf):
                continue
            m, e, own = _rows(pdf["v"], kind).astype("<f8"), pdf["e"].to_numpy(), pdf["leaf"].to_numpy()
            for (qe, _), (keep, s) in zip(probe.value, top(np.stack([q for _, q in probe.value]), m, k + 1), strict=True):
                best[qe] = heapq.nsmallest(k + 1, best[qe] + [(-a, int(e[i]), int(own[i])) for i, a in zip(keep, s, strict=True)])
        yield pd.DataFrame([(qe, -a, e, leaf) for qe, b in best.items() for a, e, leaf in b], columns=["q", "s", "e", "leaf"])

    near = located.select("v", "e", "leaf").mapInPandas(truth, "q long, s double, e long, leaf long")
    near = near.withColumn(
        "r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "e"))
    ).filter((F.col("r") <= k + 1) & (F.col("q") != F.col("e"))).collect()
    # how many leaves reach further than that of a true neighbour: some queries at a time
    paths = tree.paths(leaves)
    place, step = {e: [] for e, _ in some}, max(1, MATRIX // len(paths[0]))
    for i in range(0, len(some), step):
        part = {e: q for e, q in some[i : i + step]}
        reach = dict(zip(part, tree.reach(_unit(np.stack(list(part.values()))), paths), strict=True))
        for r in near:
            if (own := reach.get(r["q"])) is not None:
                place[r["q"]].append(int((own > own[np.searchsorted(leaves, r["leaf"])]).sum()) + 1)
    del paths
    apart = len(some) >= 20
    fitted = sorted(x for i, (e, _) in enumerate(some) if not apart or i % 2 for x in place[e])
    kept = [x for i, (e, _) in enumerate(some) if not apart or not i % 2 for x in place[e]]
    visits = fitted[min(len(fitted) - 1, int(np.ceil(recall * len(fitted))) - 1)] if fitted else 1
    found = sum(x <= visits for x in kept) / len(kept) if kept else 1.0
    probe.destroy()

    # tiles: as many rows as their share of the bytes, or fewer where that leaves cores without work
    most = max(1, min((tile_mb << 20) // (8 * size["n"]), max(256, n_entries // (4 * spark.sparkContext.defaultParallelism))))
    counts, in_leaf = np.zeros(len(leaves), np.int64), located.groupBy("leaf").count().toArrow()
    counts[np.searchsorted(leaves, in_leaf["leaf"].to_numpy())] = in_leaf["count"].to_numpy()
    first, many = _tiles(leaves, counts, most)
    n_queries, n_tiles = queries.count(), int((first + many).max())
    groups = -(-n_queries // max(1, (tile_mb << 20) // (8 * size["n"])))
    starts = np.flatnonzero(np.diff(first, prepend=-1))  # leaves of one tile stand in a row
    spans = spark.sparkContext.broadcast((first[starts], np.maximum.reduceat(many, starts), starts))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, (tile, wide, starts) = shared.value.paths(shared.value.leaves()), spans.value
        step = max(1, MATRIX // len(paths[0]))
        for b in batches:
            for s in range(0, len(b), step):
                part = b.slice(s, step)
                reach = Tree.reach(_unit(_rows(part.column("v").to_pylist(), kind).astype("<f8")), paths)
                nth = max(0, reach.shape[1] - visits)
                least = np.partition(reach, nth, axis=1)[:, nth]
                met = np.logical_or.reduceat(reach >= least[:, None] - NEAR, starts, axis=1)
                tiles = [np.concatenate([np.arange(tile[i], tile[i] + wide[i]) for i in np.flatnonzero(m)]) for m in met]
                yield pa.RecordBatch.from_arrays(
                    [part.column("e"), part.column("v"), pa.array(least), pa.array(tiles, pa.list_(pa.int64()))], ["q", "qv", "least", "tiles"]
                )

    # a tile meets its visitors, in groups by hash
    keys, n_parts = ["tile", "group"], max(1, n_tiles * groups)
    visiting = queries.select("e", "v").mapInArrow(route, "q long, qv binary, least double, tiles array<long>").select(
        F.explode("tiles").alias("tile"), F.pmod(F.xxhash64("q"), F.lit(max(1, groups))).alias("group"), "q", "qv", "least"
    )
    spread = spark.createDataFrame(pa.table({"leaf": leaves, "first": first, "many": many}))
    placed = located.join(F.broadcast(spread), "leaf").select(
        (F.col("first") + F.pmod(F.xxhash64("e"), "many")).alias("tile"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group") if groups > 1 else F.lit(0).cast("long").alias("group"),
        "e", F.element_at("ids", 1).alias("f"), "leaf", "v"
    )

    def meet(asking: pa.Table, rows: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        if len(asking) and len(rows):
            q, x = (_rows(t.column(c).to_pylist(), kind) for t, c in ((asking, "qv"), (rows, "v")))
            names, least, own, e, f = (t.column(c).to_numpy() for t, c in ((asking, "q"), (asking, "least"), (rows, "leaf"), (rows, "e"), (rows, "f")))
            parts = [(names[i], s, e, f) for i, s, e, f in compare(q, least, x, own, e, f, shared.value, k + 1)]
            out = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return pa.table(dict(zip("qsef", out, strict=True)))

    pairs = visiting.repartition(n_parts, *keys).groupBy(*keys).cogroup(placed.repartition(n_parts, *keys).groupBy(*keys)).applyInArrow(meet, "q long, s double, e long, f long")
    # of equal scores the entries with the smallest ids: k + 1 entries hold the k + 1 best ids
    near = pairs.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "f", "e"))).filter(F.col("r") <= k + 1)
    full = near.join(located.select("e", "ids"), "e").select("q", F.explode("ids").alias("vec_id"), F.col("s").alias("score"))
    best = full.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k + 1)
    # a group of equal queries asks once, and takes its own id out of k + 1
    best = stage(best.join(queries.select(F.col("e").alias("q"), "times"), "q").select("q", "vec_id", "score", "times"), "best")
    mine = join_skewed(asking, best, "q", "times", most, "inner").filter("vec_id <> query_id")
    ranked = mine.withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ).filter(F.col("rank") <= k)
    out = stage(
        ranked.select("query_id", "rank", "vec_id", "score", F.lit(int(visits)).alias("visits"), F.lit(float(found)).alias("probe_recall")), "nearest"
    )
    drop(entries, located, times, asking, queries, best)
    return out
