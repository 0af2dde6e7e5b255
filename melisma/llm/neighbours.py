"""Approximate nearest neighbours: stable projections to few dimensions, indexed by kd-trees, verified until a chi-square test holds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written

#: Directions of the projection: an even number.
DIRECTIONS = 8
#: A neighbour is missed with at most the rest of this probability.
CONFIDENCE = 0.96
#: Rows in one block, queries in one block, rows in a leaf of a block's kd-tree, leaves visited at a time.
BLOCK_ROWS, QUERY_ROWS, LEAF, VISIT = 2048, 1024, 32, 8
#: The upper kd-tree is grown on this many projected rows at most, those whose hash is least, to this many cells at most.
SAMPLE, CELLS = 16_384, 1024
#: Blocks of rows that one task streams past one block of queries.
SLICE = 64

_PLACED = "cell int, block int, dims int, vec_id long, x array<double>"
_PACKED = "block int, cell int, dims int, ids binary, x binary, extra binary, lo array<double>, hi array<double>"


def chi_square(share: float, m: int) -> float:
    """The value that a chi-square variable of an even number m of degrees of freedom stays below with the given probability."""

    def below(x: float) -> float:
        term, total = 1.0, 0.0
        for i in range(m // 2):
            total, term = total + term, term * (x / 2) / (i + 1)
        return 1 - math.exp(-x / 2) * total

    lo, hi = 0.0, 1.0
    while below(hi) < share:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < share else (lo, mid)
    return hi


def directions(dims: int, m: int, seed: int) -> np.ndarray:
    """Normal directions: squared lengths of projected differences are squared distances times a chi-square variable."""
    return np.random.default_rng([seed, dims]).standard_normal((dims, m))


def projected(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.clip(np.nan_to_num(x @ a, nan=0.0), -1e150, 1e150)


class Tree(NamedTuple):
    """Nodes of a kd-tree: axis (-1: a leaf), cut, the two children, and of a leaf its number."""

    axis: np.ndarray
    cut: np.ndarray
    children: np.ndarray
    cell: np.ndarray


def grown(points: np.ndarray, leaves: int) -> Tree:
    """Split the most populous leaf at the median of its widest axis until there are so many leaves, or none can be split."""
    axis, cut, children, held = [-1], [0.0], [(0, 0)], {0: points}
    done: dict[int, np.ndarray] = {}
    while held and len(held) + len(done) < leaves:
        at = max(held, key=lambda i: len(held[i]))
        own = held.pop(at)
        spread = own.max(0) - own.min(0) if len(own) > 1 else np.zeros(1)
        d = int(spread.argmax())
        middle = np.median(own[:, d]) if spread[d] > 0 else 0.0
        low = own[:, d] < middle if spread[d] > 0 else np.zeros(len(own), dtype=bool)
        if spread[d] > 0 and not low.any():  # the median is also the least
            middle = own[own[:, d] > middle, d].min()
            low = own[:, d] < middle
        if not low.any():
            done[at] = own
            continue
        axis[at], cut[at], children[at] = d, float(middle), (len(axis), len(axis) + 1)
        for part in (own[low], own[~low]):
            held[len(axis)] = part
            axis.append(-1)
            cut.append(0.0)
            children.append((0, 0))
    axis = np.array(axis)
    return Tree(axis, np.array(cut), np.array(children), np.where(axis < 0, np.cumsum(axis < 0) - 1, -1))


def found_cell(tree: Tree, y: np.ndarray) -> np.ndarray:
    at = np.zeros(len(y), dtype=np.int64)
    while True:
        inner = np.flatnonzero(tree.axis[at] >= 0)
        if not len(inner):
            return tree.cell[at]
        node = at[inner]
        right = y[inner, tree.axis[node]] >= tree.cut[node]
        at[inner] = tree.children[node, right.astype(np.int64)]


class Index(NamedTuple):
    """Projection and upper trees: for each vector length the tree and its first cell. Lengths that the sample lacks are one cell."""

    m: int
    seed: int
    trees: dict[int, Tree]
    first: dict[int, int]


def _lists(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length in a column of vectors: the rows that have it, as a matrix."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, at = column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lengths)))
    for dims in np.unique(lengths):
        own = np.flatnonzero(lengths == dims)
        yield own, flat[(at[own][:, None] + np.arange(dims)).ravel()].reshape(len(own), dims)


def _sampled(m: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, x in _lists(batch["x"]) if batch.num_rows else ():
                y = projected(x, directions(x.shape[1], m, seed))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), x.shape[1], dtype=np.int32)), pa.array(list(y))], names=["dims", "y"])

    return run


def _placed(index: Index, first: dict[int, int] | None, parts: dict[int, int] | None):
    """Each vector's cell, and its block: a cell's rows are dealt over its blocks by where they are read, so that equal rows part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.zeros(batch.num_rows, dtype=np.int32)
            for own, x in _lists(batch["x"]):
                dims = x.shape[1]
                base = index.first[dims]
                cell[own] = base + found_cell(index.trees[dims], projected(x, directions(dims, index.m, index.seed))) if dims in index.trees else base
            block = np.zeros(batch.num_rows, dtype=np.int32)
            if first is not None:
                hashed = batch["hashed"].to_numpy()
                block[:] = [first[c] + h % parts[c] for c, h in zip(cell.tolist(), hashed.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(block), batch["x"].value_lengths().cast(pa.int32()), batch["vec_id"], batch["x"]], names=["cell", "block", "dims", "vec_id", "x"])

    return run


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x, hashed): vectors of doubles without null or non-finite components, not all zero, with an id."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(~bad & F.exists("x", lambda c: c != 0))
    return rows.withColumn("hashed", F.xxhash64(F.monotonically_increasing_id()))


def dealt(counts: dict[int, int], length_of: dict[int, int], size: int, shared: bool) -> tuple[dict[int, int], dict[int, int]]:
    """(first block, number of blocks) of each cell; with shared, neighbouring cells of one length share a block while it has room."""
    first, parts, block, held, length = {}, {c: -(-n // size) for c, n in counts.items()}, 0, 0, None
    for c in sorted(counts):
        if held and not (shared and length == length_of[c] and held + counts[c] <= size):
            block, held = block + 1, 0
        first[c], length, held = block, length_of[c], held + counts[c]
        if held >= size:
            block, held = block + parts[c], 0
    return first, parts


def _ordered(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts) of a kd-tree's leaves: rows halved at the median of the widest axis until LEAF at most are left."""
    out, starts, todo = [], [], [np.arange(len(y))]
    while todo:
        own = todo.pop()
        if len(own) <= LEAF:
            starts.append(sum(map(len, out[-1:])) + (starts[-1] if starts else 0))
            out.append(own)
            continue
        d = int((y[own].max(0) - y[own].min(0)).argmax())
        half = len(own) // 2
        own = own[np.argpartition(y[own, d], half)]
        todo += [own[half:], own[:half]]
    return np.concatenate(out), np.array(starts, dtype="<i4")


def _pack_rows(m: int, seed: int, kind: str):
    def run(group: pa.Table) -> pa.Table:
        dims = group["dims"][0].as_py()
        x = group["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, dims)
        y = projected(x, directions(dims, m, seed))
        order, starts = _ordered(y)
        row = (group["block"][0].as_py(), group["cell"][0].as_py(), dims, group["vec_id"].to_numpy()[order].astype("<i8").tobytes(), x[order].astype(kind).tobytes(), starts.tobytes(), y.min(0).tolist(), y.max(0).tolist())
        return _packed_table([row])

    return run


def _packed_table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()))
    return pa.table({n: pa.array([r[i] for r in rows], type=t) for i, (n, t) in enumerate(zip(("block", "cell", "dims", "ids", "x", "extra", "lo", "hi"), kinds, strict=True))})


def _pack_queries(group: pa.Table) -> pa.Table:
    """A block of queries of one length; extra has their cells, lo those cells once each, hi nothing."""
    dims, cells = group["dims"][0].as_py(), group["cell"].to_numpy().astype("<i4")
    x = group["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f8")
    return _packed_table([(group["block"][0].as_py(), -1, dims, group["vec_id"].to_numpy().astype("<i8").tobytes(), x.tobytes(), cells.tobytes(), [float(c) for c in np.unique(cells)], [])])


class Queries:
    """A block of queries and the best that each has met so far."""

    def __init__(self, r: dict, k: int, m: int, seed: int, stop: float):
        self.ids, self.k, self.stop = np.frombuffer(r["ids"], dtype="<i8"), k, stop
        self.x = np.frombuffer(r["x"], dtype="<f8").reshape(len(self.ids), r["dims"])
        self.cells = np.frombuffer(r["extra"], dtype="<i4")
        self.directions = directions(r["dims"], m, seed)
        self.y = projected(self.x, self.directions)
        self.known = np.frombuffer(r["known"]).copy() if r["known"] else np.full(len(self.ids), np.inf)
        self.best = [(np.zeros(0), np.zeros(0, dtype=np.int64)) for _ in self.ids]
        self.margin = 0.0

    def radius(self, i: int) -> float:
        """Rows whose projected squared distance is beyond this are no neighbours, by the chi-square test; with room for rounding."""
        return self.stop * self.known[i] * self.known[i] + self.margin

    def meet(self, r: dict, kind: str, at_home: bool) -> None:
        """Search a block of rows: leaves in the order of their projected distance, until the test holds for the next one."""
        ids, starts = np.frombuffer(r["ids"], dtype="<i8"), np.frombuffer(r["extra"], dtype="<i4")
        x = np.frombuffer(r["x"], dtype=kind).reshape(len(ids), r["dims"]).astype(np.float64)
        y = projected(x, self.directions)
        lo, hi = np.minimum.reduceat(y, starts), np.maximum.reduceat(y, starts)
        ends = np.append(starts[1:], len(ids))
        self.margin = (1e-9 * (np.abs(y).max(initial=0) + np.abs(self.y).max(initial=0))) ** 2
        # what was searched at home isn't searched again
        own = self.cells == r["cell"]
        mine = np.flatnonzero(own if at_home else ~own if r["home"] else np.ones(len(own), dtype=bool))
        if not len(mine):
            return
        away = np.zeros((len(mine), len(starts)))
        for d in range(y.shape[1]):
            q = self.y[mine, d][:, None]
            away += np.maximum(np.maximum(lo[:, d] - q, q - hi[:, d]), 0) ** 2
        for row, i in enumerate(mine.tolist()):
            order = np.argsort(away[row], kind="stable")
            sorted_away, at = away[row][order], 0
            while at < len(order) and sorted_away[at] <= self.radius(i):
                near = order[at : at + VISIT][sorted_away[at : at + VISIT] <= self.radius(i)]
                at += VISIT
                rows = np.concatenate([np.arange(starts[j], ends[j]) for j in near.tolist()])
                close = ((y[rows] - self.y[i]) ** 2).sum(1) <= self.radius(i)
                rows = rows[close & (ids[rows] != self.ids[i])]
                if len(rows):
                    self.add(i, np.sqrt(((x[rows] - self.x[i]) ** 2).sum(1)), ids[rows])

    def add(self, i: int, d: np.ndarray, ids: np.ndarray) -> None:
        fits = d <= self.known[i]
        d, ids = np.concatenate((self.best[i][0], d[fits])), np.concatenate((self.best[i][1], ids[fits]))
        order = np.lexsort((ids, d))[: self.k]
        self.best[i] = (d[order], ids[order])
        if len(order) == self.k:
            self.known[i] = min(self.known[i], d[order[-1]])


def _searched(k: int, m: int, seed: int, stop: float, kind: str, at_home: bool):
    """Stream blocks of rows past their block of queries, nearest first. At home: also return the distances known after the search."""

    def answer(r: dict, q: Queries) -> pa.RecordBatch:
        found = [np.repeat(q.ids, [len(d) for d, _ in q.best]), np.concatenate([i for _, i in q.best]), np.concatenate([d for d, _ in q.best])]
        if at_home:
            return pa.RecordBatch.from_arrays([pa.array([r["q_block"]], pa.int32()), pa.array([q.known.tobytes()], pa.binary()), *(pa.array([c]) for c in found)], names=["q_block", "known", "query_ids", "vec_ids", "scores"])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, q = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    if q is not None:
                        yield answer(head, q)
                    head, q = r, Queries(r, k, m, seed, stop)
                else:
                    q.meet(r, kind, at_home)
        if q is not None:
            yield answer(head, q)

    return run


def _needed(index: Index, boxes: dict[int, list[tuple[int, list[float], list[float]]]], stop: float):
    """Of each block of queries, the cells that some query's test leaves open, with the least projected distance to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                own = boxes.get(r["dims"], [])
                if not own:
                    continue
                x = np.frombuffer(r["x"], dtype="<f8").reshape(-1, r["dims"])
                y = projected(x, directions(r["dims"], index.m, index.seed))
                radius = stop * (np.frombuffer(r["known"]) if r["known"] else np.full(len(y), np.inf)) ** 2
                lo, hi = np.array([b[1] for b in own]), np.array([b[2] for b in own])
                away = np.zeros((len(y), len(own)))
                for d in range(index.m):
                    q = y[:, d][:, None]
                    away += np.maximum(np.maximum(lo[:, d] - q, q - hi[:, d]), 0) ** 2
                open_ = (away <= radius[:, None]).any(0)
                rows += [(r["block"], own[j][0], float(away[:, j].min())) for j in np.flatnonzero(open_).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64()))], names=["q_block", "cell", "bound"])

    return run


def _streams(q: DataFrame, x: DataFrame, pairs: DataFrame, slices: int) -> DataFrame:
    """Each block of queries, followed by the blocks of rows that it is to meet, in slices of about SLICE blocks."""
    heads = q.join(pairs.select(F.col("q_block").alias("block"), "slice").distinct(), "block")
    left = heads.select(F.col("block").alias("q_block"), "slice", F.lit(0).alias("kind"), F.lit(-1.0).alias("bound"), F.lit(False).alias("home"), "block", "cell", "dims", "ids", "x", "extra", "known")
    right = pairs.join(x, "block").select("q_block", "slice", F.lit(1).alias("kind"), "bound", "home", "block", "cell", "dims", "ids", "x", "extra", F.lit(None).cast("binary").alias("known"))
    return left.unionByName(right).repartition(slices, "q_block", "slice").sortWithinPartitions("q_block", "slice", "kind", "bound", "block")


def neighbours(queries: DataFrame, rows: DataFrame, k: int = 10, m: int = DIRECTIONS, confidence: float = CONFIDENCE, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k nearest rows found, by Euclidean distance: (query_id, rank, vec_id, score), ties to the smaller vec_id.

    Vectors are projected on m normal directions; every row is in a kd-tree over its projection: upper cells cut on a bounded
    sample, blocks of rows in them, leaves within a block. A query first meets a block of its own cell and so knows a k-th
    distance d; it then meets blocks, and leaves within them, in the order of projected distance, verifies vectors in double
    precision, which lowers d, and stops where squared projected distance passes d * d times the chi-square quantile: a true
    neighbour is beyond with probability 1 - confidence at most. Blocks of rows are streamed past blocks of queries, so a task
    holds one of each; hot vectors are dealt over blocks by where they stand, and only counts and boxes of cells, and the
    projected sample, reach the driver.

    Vectors null, zero, or with null or non-finite components, and rows without an id take no part; only vectors of the
    query's length are candidates; rows of one id are no candidates of each other, else repeated rows keep a place each;
    repeated query rows are one query, different vectors of one query id are answered together. Empty tables give no rows.
    Other columns are not read.
    """
    spark = rows.sparkSession
    if m % 2:
        raise ValueError("the number of directions must be even")
    element = rows.schema[vector_col].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    stop, name = chi_square(confidence, m), "query_id long, rank int, vec_id long, score double"
    x, q = usable(rows, id_col, vector_col), usable(queries, id_col, vector_col).dropDuplicates(["vec_id", "x"])
    sizes = {r["dims"]: r["n"] for r in x.groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], name)
    sample: dict[int, list] = {}
    for r in x.select("x", F.xxhash64("x", "vec_id").alias("h")).orderBy("h").limit(SAMPLE).select("x").mapInArrow(_sampled(m, seed), "dims int, y array<double>").collect():
        sample.setdefault(r["dims"], []).append(r["y"])
    trees = {d: grown(np.array(y), min(CELLS, -(-sizes[d] // BLOCK_ROWS))) for d, y in sorted(sample.items())}
    first, cells = {}, 0
    for d in sorted(sizes):
        first[d], cells = cells, cells + (int(trees[d].cell.max()) + 1 if d in trees else 1)
    index = Index(m, seed, trees, first)
    q = q.where(F.size("x").isin(sorted(sizes)))
    counted = lambda df: {r["cell"]: (r["n"], r["dims"]) for r in df.select("vec_id", "x", "hashed").mapInArrow(_placed(index, None, None), _PLACED).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dims").alias("dims")).collect()}

    def packed(df: DataFrame, size: int, shared: bool, pack, label: str) -> tuple[DataFrame, int]:
        counts = counted(df)
        begin, parts = dealt({c: n for c, (n, _) in counts.items()}, {c: d for c, (_, d) in counts.items()}, size, shared)
        placed = df.select("vec_id", "x", "hashed").mapInArrow(_placed(index, begin, parts), _PLACED)
        return written(placed.groupBy("block").applyInArrow(pack, _PACKED), label), max((begin[c] + parts[c] for c in counts), default=0)

    blocks, n_blocks = packed(x, BLOCK_ROWS, False, _pack_rows(m, seed, kind), "neighbour-rows")
    asked, n_asked = packed(q, QUERY_ROWS, True, _pack_queries, "neighbour-queries")
    if not n_asked:
        return spark.createDataFrame([], name)
    payload = blocks.select("block", "cell", "dims", "ids", "x", "extra")
    # at home: one block of each query's own cell
    homes = asked.select(F.col("block").alias("q_block"), F.explode(F.expr("cast(lo as array<int>)")).alias("cell"))
    leading = blocks.groupBy("cell").agg(F.min("block").alias("block"))
    home = homes.join(leading, "cell").select("q_block", "block", F.lit(0).alias("slice"), F.lit(0.0).alias("bound"), F.lit(True).alias("home"))
    fresh = asked.withColumn("known", F.lit(None).cast("binary"))
    known = _streams(fresh, payload, home, min(n_asked, 20_000)).mapInArrow(_searched(k, m, seed, stop, kind, True), "q_block int, known binary, query_ids array<long>, vec_ids array<long>, scores array<double>")
    # a block's lists hold k numbers for each of its queries
    ready = written(asked.join(known.withColumnRenamed("q_block", "block"), "block", "left"), "neighbour-known")
    # boxes of cells: fewer than CELLS and one for each further length
    edge = blocks.groupBy("cell", "dims").agg(*[F.min(F.get("lo", F.lit(i))).alias(f"lo{i}") for i in range(m)], *[F.max(F.get("hi", F.lit(i))).alias(f"hi{i}") for i in range(m)])
    boxes: dict[int, list] = {}
    for r in edge.collect():
        boxes.setdefault(r["dims"], []).append((r["cell"], [r[f"lo{i}"] for i in range(m)], [r[f"hi{i}"] for i in range(m)]))
    slices = -(-n_blocks // SLICE)
    open_cells = ready.select("block", "dims", "x", "known").mapInArrow(_needed(index, boxes, stop), "q_block int, cell int, bound double")
    pairs = open_cells.join(blocks.select("block", "cell"), "cell").join(leading.withColumnRenamed("block", "leading"), "cell")
    pairs = pairs.select("q_block", "block", F.pmod("block", F.lit(slices)).alias("slice"), "bound", (F.col("block") == F.col("leading")).alias("home"))
    met = _streams(ready, payload, written(pairs, "neighbour-pairs"), min(n_asked * slices, 20_000)).mapInArrow(_searched(k, m, seed, stop, kind, False), "query_id long, vec_id long, score double")
    at_home = ready.select(F.explode(F.arrays_zip("query_ids", "vec_ids", "scores")).alias("r")).select("r.query_ids", "r.vec_ids", "r.scores").toDF("query_id", "vec_id", "score")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return met.unionByName(at_home).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: rows whose vec_id is divisible by 100; candidates: every other row of embeddings."""
    rows = table(spark, sf_dir, "embeddings")
    return neighbours(rows.where(F.col("vec_id") % 100 == 0), rows, k=10)
