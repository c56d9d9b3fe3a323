"""Approximate nearest neighbours by inner product: stable projections, kd-trees, a chi-square test.

The largest inner product becomes the least distance when a candidate x gets one more entry,
sqrt(M^2 - |x|^2) with M the largest norm, and a query is scaled to norm M with 0 there. DIMS
Gaussian (2-stable) projections of these follow: the projected squared distance of two points
over their true one is chi-square distributed with DIMS degrees of freedom. So what lies within the
k-th distance found so far, d_k, has a projected one under quantile(SURE) * d_k^2 with probability
SURE; the search takes projected neighbours from near to far, verifies them on the vectors, and
stops where the projected distance passes that bound.

A kd-tree over projections has two levels. The upper one is fitted on a bounded sample: a multiple
of the rows' key hashes thins them to about SAMPLE, so it has at most SAMPLE / 16 cells whatever the
size of the data. All rows go into cells; a cell over CELL rows is dealt out in blocks. A block gets a tree of its own, of leaves
with bounding boxes, within its task. Queries first search their own cell, then all cells whose
boxes the bound reaches; blocks meet groups of GROUP queries, so a task holds CELL vectors and
GROUP queries at most.

Copies: of equal vectors only the k + 1 smallest ids can be in a result, the others are left out of
the trees (they are no loss); equal queries are searched once, and each gets the list less itself.

Edge cases: vectors that are null, empty or zero, hold null or non-finite entries, or are not of the
most frequent length, and rows without a key take no part; repeated rows count once, rows that share
a key are one candidate (the nearer) and are never a neighbour of their own key's query; fewer than k candidates give as many rows; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, table
from .vectors import listed, matrix, usable

NEAREST = 20
DIMS = 12
SURE = 0.97
SEED = 7
SAMPLE = 1 << 14
CELL = 4096
GROUP = 1024
LEAF = 128
LEAVES_AT_ONCE = 4
SLACK = 1e-9
RESULT = "query_id long, rank int, vec_id long, score double"


def chi_square(x: float, dims: int) -> float:
    """The distribution function for an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, dims // 2):
        term *= x / 2 / i
        total += term
    return 1 - exp(-x / 2) * total


def quantile(sure: float, dims: int) -> float:
    low, high = 0.0, 1000.0
    while high - low > 1e-9:
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, dims) < sure else (low, middle)
    return high


def directions(d: int, dims: int) -> np.ndarray:
    """The projections of d entries and the added one."""
    return np.random.default_rng(SEED).standard_normal((d + 1, dims))


def boxes(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts)


def box_distance(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The squared distance of a point to each box."""
    apart = np.maximum(np.maximum(low - point, point - high), 0)
    return np.einsum("ij,ij->i", apart, apart)


def grown(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The planes of a full kd-tree in level order: at each node the widest dimension, its median."""
    dims, cuts, parts = [], [], [points]
    for _ in range(depth):
        below = []
        for part in parts:
            at = int(np.ptp(part, axis=0).argmax()) if len(part) else 0
            cut = float(np.median(part[:, at])) if len(part) else 0.0
            dims.append(at)
            cuts.append(cut)
            left = part[:, at] < cut
            below += [part[left], part[~left]]
        parts = below
    return np.array(dims, np.int32), np.array(cuts)


def cells(points: np.ndarray, dims: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The leaf of each point in the tree of `grown`."""
    node = np.zeros(len(points), np.int64)
    while len(dims) and node.size and node[0] < len(dims):
        node = 2 * node + 1 + (points[np.arange(len(points)), dims[node]] >= cuts[node])
    return node - len(dims)


def leaf_order(points: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """An order in which the leaves of a balanced kd-tree stand one after another, and their starts."""
    parts, done = [np.arange(len(points))], []
    while parts:
        part = parts.pop()
        if len(part) <= leaf:
            done.append(part)
            continue
        values = points[part]
        by = np.argpartition(values[:, np.ptp(values, axis=0).argmax()], len(part) // 2)
        parts += [part[by[len(part) // 2 :]], part[by[: len(part) // 2]]]
    return np.concatenate(done), np.cumsum([0, *map(len, done[:-1])])


class Block:
    """Candidates of one block under a kd-tree of their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray):
        order, self.starts = leaf_order(projected, LEAF)
        self.ids, self.vectors, self.projected = ids[order], vectors[order], projected[order]
        self.ends = np.append(self.starts[1:], len(ids))
        self.low, self.high = boxes(self.projected, self.starts)

    def nearest(self, query: np.ndarray, point: np.ndarray, k: int, least: float, largest: float, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best candidates of at least the score `least`."""
        norm = sqrt(query @ query)
        slack = SLACK * largest * norm
        lower = box_distance(point, self.low, self.high)
        order = np.argsort(lower, kind="stable")
        found, scores, kth = [], [], least
        reach = lambda: bound * max(0.0, 2 * largest * (largest - kth / norm) + SLACK * largest**2)
        for a in range(0, len(order), LEAVES_AT_ONCE):
            limit = reach()
            if lower[order[a]] > limit:  # all that is unseen lies beyond: the test holds
                break
            at = np.concatenate([np.arange(self.starts[i], self.ends[i]) for i in order[a : a + LEAVES_AT_ONCE]])
            apart = self.projected[at] - point
            at = at[~(np.einsum("ij,ij->i", apart, apart) > limit)]
            some = self.vectors[at] @ query
            good = ~(some < kth - slack)
            found.append(at[good])
            scores.append(some[good])
            known = np.concatenate(scores)
            if len(known) >= k:
                kth = max(kth, np.partition(known, len(known) - k)[len(known) - k])
        if not found:
            return self.ids[:0], np.zeros(0)
        at, known = np.concatenate(found), np.concatenate(scores)
        at = at[~(known < kth - slack)]
        exact = (self.vectors[at] * query).sum(axis=1)  # the same whatever rows stand around
        best = np.lexsort((self.ids[at], -exact))[:k]
        return self.ids[at[best]], exact[best]


@dataclass(frozen=True)
class Tree:
    """The upper tree and its cells: bounding boxes and numbers of blocks."""

    dims: np.ndarray
    cuts: np.ndarray
    low: np.ndarray
    high: np.ndarray
    blocks: np.ndarray


def identical(points: DataFrame) -> DataFrame:
    """Two hashes of the vector beside each row: 128 bits stand for its equality."""
    return points.withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit("other"), F.col("v"))})


def without_copies(points: DataFrame, key: str, keep: int) -> DataFrame:
    """The rows less those of which `keep` equal vectors have smaller keys."""
    slim = identical(points).select("h", "g", key)
    many = materialise(slim.groupBy("h", "g").count().filter(F.col("count") > keep).select("h", "g"))
    if many.isEmpty():
        discard(many)
        return points
    order = Window.partitionBy("h", "g").orderBy(key)
    first = slim.join(many, ["h", "g"]).distinct().withColumn("r", F.row_number().over(order)).filter(F.col("r") <= keep)
    last = materialise(first.groupBy("h", "g").agg(F.max(key).alias("last")))
    discard(many)
    return identical(points).join(last, ["h", "g"], "left").filter(F.col("last").isNull() | (F.col(key) <= F.col("last"))).select(key, "v")


def projected(rows: DataFrame, columns: str, made, *args) -> DataFrame:
    """rows with key and v, and what `made` gives for the matrix of v."""
    held = rows.sparkSession.sparkContext.broadcast(args)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                more = made(matrix(batch["v"]), *held.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, *more.values()], [*batch.schema.names, *more])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, {columns}")


def candidate_points(vectors: np.ndarray, largest: float, way: np.ndarray) -> np.ndarray:
    last = np.sqrt(np.maximum(0, largest**2 - np.einsum("ij,ij->i", vectors, vectors)))
    return np.column_stack([vectors, last]) @ way


def placed_candidates(vectors: np.ndarray, largest: float, way: np.ndarray, dims: np.ndarray, cuts: np.ndarray) -> dict:
    y = candidate_points(vectors, largest, way)
    return {"y": listed(y), "cell": pa.array(cells(y, dims, cuts).astype(np.int32))}


def placed_queries(vectors: np.ndarray, largest: float, way: np.ndarray, dims: np.ndarray, cuts: np.ndarray) -> dict:
    scaled = vectors * (largest / np.sqrt(np.einsum("ij,ij->i", vectors, vectors)))[:, None]
    y = scaled @ way[:-1]
    return {"y": listed(y), "home": pa.array(cells(y, dims, cuts).astype(np.int32))}


def planted(candidates: DataFrame, key: str, n: int, largest: float, way: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray]:
    """The planes of the upper tree, fitted on about SAMPLE rows' projections."""
    depth = min(max(0, (n - 1).bit_length() - cell.bit_length() + 1), SAMPLE.bit_length() - 5)
    if not depth:
        return np.zeros(0, np.int32), np.zeros(0)
    every = F.pmod(F.xxhash64(key), F.lit(-(-n // SAMPLE))) == 0
    some = projected(candidates.filter(every), "y array<double>", lambda v, *a: {"y": listed(candidate_points(v, *a))}, largest, way).select("y").limit(2 * SAMPLE)
    return grown(matrix(some.toArrow()["y"]), depth)


def groups(share: list[int]) -> list[tuple[int, int]]:
    """For each cell of so many queries its first group and their number: cells side by side share a
    group while it has room, a cell of over GROUP queries has several of its own."""
    out, group, filled = [], 0, 0
    for n in share:
        if filled and filled + n > GROUP:
            group, filled = group + 1, 0
        width = max(1, -(-n // GROUP))
        out.append((group, width))
        group, filled = (group + width, 0) if width > 1 else (group, filled + n)
    return out


def search(visits: DataFrame, placed: DataFrame, k: int, largest: float, bound: float) -> DataFrame:
    """query, vec_id and score: the best k of each block that a query visits, of at least `least`.

    visits has query, part, cell, v, y, least; a part is a group of queries. A block comes once to
    each part that visits it.
    """
    pairs = visits.select("cell", F.col("part").alias("for_part")).distinct()
    blocks = placed.join(pairs, "cell").select("for_part", F.col("cell").alias("in_cell"), F.col("block").alias("in_block"), "id", F.col("v").alias("x"), F.col("y").alias("p"))
    asked = visits.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("part", "cell", "block", "query", "v", "y", "least")
    held = visits.sparkSession.sparkContext.broadcast((k, largest, bound))

    def run(asked: pa.Table, there: pa.Table) -> pa.Table:
        k, largest, bound = held.value
        queries, ids, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if asked.num_rows and there.num_rows:
            names, vectors = there["id"].to_numpy(), matrix(there["x"])
            once = {(i, v.tobytes()): at for at, (i, v) in enumerate(zip(names, vectors))}
            at = np.fromiter(once.values(), np.int64)
            block = Block(names[at], vectors[at], matrix(there["p"])[at])
            for q, v, y, least in zip(asked["query"].to_numpy(), matrix(asked["v"]), matrix(asked["y"]), asked["least"].to_numpy()):
                found, score = block.nearest(v, y, k, least, largest, bound)
                queries.append(np.full(len(found), q))
                ids.append(found)
                scores.append(score)
        return pa.table({"query": np.concatenate(queries), "vec_id": np.concatenate(ids), "score": np.concatenate(scores)})

    return asked.groupBy("part", "cell", "block").cogroup(blocks.groupBy("for_part", "in_cell", "in_block")).applyInArrow(run, "query long, vec_id long, score double")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; a key counts once."""
    once = found.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)


def nearest(rows: DataFrame, key: str = "vec_id", value: str = "embedding", every: int = 20, k: int = NEAREST, dims: int = DIMS, sure: float = SURE, cell: int = CELL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row whose key `every` divides."""
    spark = rows.sparkSession
    points = usable(rows, key, value).filter(F.col(key).isNotNull() & F.exists("v", lambda c: c != 0)).select(F.col(key).alias("id"), "v")
    squares = F.aggregate("v", F.lit(0.0), lambda total, c: total + c.cast("double") * c.cast("double"))
    n, d, square = points.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(squares)).first()
    if not n:
        return spark.createDataFrame([], RESULT)
    largest, way = sqrt(square), directions(d, dims)
    candidates = without_copies(points, "id", k + 1)
    dims_, cuts = planted(candidates, "id", n, largest, way, cell)
    placed = materialise(projected(candidates, "y array<double>, cell int", placed_candidates, largest, way, dims_, cuts))
    edges = [f(F.get("y", F.lit(i))) for f in (F.min, F.max) for i in range(dims)]
    seen = {r.cell: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *edges).collect()}
    empty = (0, 0, *[float("inf")] * dims, *[float("-inf")] * dims)
    table_ = np.array([seen.get(c, empty) for c in range(len(dims_) + 1)], float)
    tree = Tree(dims_, cuts, table_[:, 2 : 2 + dims], table_[:, 2 + dims :], np.ceil(table_[:, 1] / cell).astype(int))
    blocks = F.array(*(F.lit(int(b)) for b in tree.blocks))
    placed_in = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.get(blocks, F.col("cell"))).cast("int"))

    asked = identical(points.filter(F.col("id") % every == 0))
    members = materialise(asked.select("h", "g", F.col("id").alias("query_id")).distinct())
    leaders = members.groupBy("h", "g").agg(F.min("query_id").alias("id"))
    led = asked.join(leaders, ["h", "g", "id"]).dropDuplicates(["h", "g"]).select("h", "g", "v")
    numbered = projected(led, "y array<double>, home int", placed_queries, largest, way, dims_, cuts).withColumn("query", F.monotonically_increasing_id())
    queries = materialise(numbered)
    share = {r.home: r.n for r in queries.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()}
    start, width = (F.get(F.array(*map(F.lit, x)), F.col("home")) for x in zip(*groups([share.get(c, 0) for c in range(len(tree.blocks))])))
    grouped = queries.withColumn("part", (start + F.pmod(F.xxhash64("query"), width)).cast("int"))

    bound = quantile(sure, dims)
    of_cell = lambda visits: visits.withColumn("blocks", F.get(blocks, F.col("cell"))).filter("blocks > 0")
    own = of_cell(grouped.select("query", "part", F.col("home").alias("cell"), "v", "y", F.lit(float("-inf")).alias("least")))
    near = materialise(best(search(own, placed_in, k + 1, largest, bound), k + 1))
    worst = near.filter(F.col("rank") == k + 1).select("query", F.col("score").alias("least"))
    bounded = grouped.join(worst, "query", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    far = of_cell(others(bounded, tree, largest, bound))
    both = near.select("query", "vec_id", "score").unionByName(search(far, placed_in, k + 1, largest, bound))
    lists = best(both, k + 1).groupBy("query").agg(F.sort_array(F.collect_list(F.struct(F.col("rank").alias("at"), "vec_id", "score"))).alias("list"))
    answers = materialise(lists.join(queries.select("query", "h", "g"), "query").select("h", "g", "list"))
    for frame in (placed, queries, near):
        discard(frame)
    mine = F.slice(F.filter("list", lambda c: c["vec_id"] != F.col("query_id")), 1, k)
    return members.join(answers, ["h", "g"]).select("query_id", F.posexplode(mine).alias("at", "c")).select("query_id", (F.col("at") + 1).alias("rank"), "c.vec_id", "c.score")


def others(queries: DataFrame, tree: Tree, largest: float, bound: float) -> DataFrame:
    """A row for each query and cell, not its own, that the chi-square bound of its k-th score reaches."""
    held = queries.sparkSession.sparkContext.broadcast((tree, largest, bound))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, largest, bound = held.value
        for batch in batches:
            vectors, points, homes, least = matrix(batch["v"]), matrix(batch["y"]), batch["home"].to_numpy(), batch["least"].to_numpy()
            rows, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for at, (v, y, home, score) in enumerate(zip(vectors, points, homes, least)):
                reach = bound * max(0.0, 2 * largest * (largest - score / sqrt(v @ v)) + SLACK * largest**2)
                met = ~(box_distance(y, tree.low, tree.high) > reach)
                met[home] = False
                to.append(np.flatnonzero(met))
                rows.append(np.full(len(to[-1]), at))
            some = batch.select(["query", "part", "v", "y", "least"]).take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.concatenate(to).astype(np.int32))], [*some.schema.names, "cell"])

    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}
    fields = ", ".join(f"{c} {kinds[c]}" for c in ("query", "part", "v", "y", "least"))
    return queries.mapInArrow(run, f"{fields}, cell int")


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings")).select("query_id", "rank", "vec_id", "score")
