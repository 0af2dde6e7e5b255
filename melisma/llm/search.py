"""Exact top-k inner-product search by multi-resolution segment statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Vectors in one block of candidates or of queries; a task holds one of each.
BLOCK_ROWS = 4096
#: Numbers of segments, coarse to fine.
RESOLUTIONS = (4, 16)
#: Blocks of rows that one task streams past a block of queries.
SLICE = 16

PACKED = "block int, ids binary, dims int, vectors binary, box binary"
_PACKED = pa.schema([("block", pa.int32()), ("ids", pa.binary()), ("dims", pa.int32()), ("vectors", pa.binary()), ("box", pa.binary())])


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """Rows (vec_id, v) with v = floor(scale * x); null vectors, ids, and null or non-finite components take no part."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(~bad).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v")
    )


def _summaries(x: np.ndarray, segments: int) -> np.ndarray:
    """For each row and segment sqrt(m) times mean and deviation, with which an inner product of rows is at most that of summaries."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    parts = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = x[:, a:b]
        parts += [part.mean(1) * np.sqrt(b - a), part.std(1) * np.sqrt(b - a)]
    return np.stack(parts, 1)


def _box(x: np.ndarray) -> np.ndarray:
    """(2, all summaries): the least and the largest of each summary of rows, at every resolution."""
    found = np.concatenate([_summaries(x.astype(np.float64), n) for n in RESOLUTIONS], 1) if x.shape[1] else np.zeros((len(x), 0))
    return np.stack((found.min(0), found.max(0)))


def most(a: np.ndarray, b: np.ndarray, dims: int) -> float:
    """No inner product of a row in one box with a row in the other exceeds this: the least bound of all resolutions."""
    reach = np.max([x * y for x in a for y in b], 0)
    cuts = np.cumsum([0, *(2 * min(n, dims) for n in RESOLUTIONS)])
    return float(min((reach[i:j].sum() for i, j in zip(cuts[:-1], cuts[1:], strict=True)), default=0.0)) if dims else 0.0


def _pack(group: pa.Table) -> pa.Table:
    """One row for each vector length in the block."""
    ids, block = group["vec_id"].to_numpy(), group["block"][0].as_py()
    column = group["v"].combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat, at = column.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lengths)))
    rows = []
    for dims in np.unique(lengths):
        own = np.flatnonzero(lengths == dims)
        matrix = flat[(at[own][:, None] + np.arange(dims)).ravel()].astype("<i8").reshape(len(own), dims)
        rows.append((block, ids[own].astype("<i8").tobytes(), int(dims), matrix.tobytes(), _box(matrix).tobytes()))
    return pa.table({n: [r[i] for r in rows] for i, n in enumerate(_PACKED.names)}, schema=_PACKED)


def packed(vectors: DataFrame, block_rows: int) -> DataFrame:
    """Blocks of about block_rows vectors that are alike: of one cell, which tells the signs of four stretches' sums and the
    power of two of the norm, dealt out within it by a hash of the row and where it stands, so that neither a key nor equal rows make a large block. Small
    cells share a block with the next ones.

    Only the number of rows in each cell reaches the driver: 16 * 128 numbers at most.
    """
    size = F.size("v")
    part = lambda i: F.slice("v", (F.floor(size * i / 4) + 1).cast("int"), (F.floor(size * (i + 1) / 4) - F.floor(size * i / 4)).cast("int"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    signs = sum((F.when(total(part(i)) >= 0, 1 << i).otherwise(0) for i in range(1, 4)), F.when(total(part(0)) >= 0, 1).otherwise(0))
    norm = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    celled = vectors.withColumn("cell", (signs * 128 + F.least(F.lit(127), F.floor(F.log2(norm + 1)))).cast("int"))
    found = {r["cell"]: r["count"] for r in celled.groupBy("cell").count().collect()}
    parts, first, block, held = {c: -(-n // block_rows) for c, n in found.items()}, {}, 0, 0
    for c in sorted(found):
        if held and held + found[c] > block_rows:
            block, held = block + 1, 0
        first[c], held = block, held + found[c]
        if held >= block_rows:
            block, held = block + parts[c], 0
    if not found:
        return vectors.sparkSession.createDataFrame([], PACKED)
    of_cell = lambda values: F.element_at(F.create_map(*[F.lit(x) for c in sorted(values) for x in (c, values[c])]), F.col("cell"))
    dealt = celled.withColumn("block", (of_cell(first) + F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), of_cell(parts))).cast("int"))
    return dealt.groupBy("block").applyInArrow(_pack, PACKED)


_END = 2**63 - 1


def reached(score: int) -> float:
    """What a score tells of those below it: at the lower end of longs, nothing."""
    return float(score) if score > -_END else -np.inf


def products(queries: np.ndarray, rows: np.ndarray):
    """A function (i, own) of the exact inner products of query i with those rows, as longs; sums beyond a long stand at its ends."""
    size = lambda x: max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    reach = max(1, queries.shape[1]) * size(queries) * size(rows)
    if reach < 2**52:
        q, x = queries.astype(np.float64), rows.astype(np.float64)
        return lambda i, own: (x[own] @ q[i]).astype(np.int64)
    if reach < 2**62:
        return lambda i, own: rows[own] @ queries[i]
    q, x = queries.astype(object), rows.astype(object)
    return lambda i, own: np.array([min(max(v, -_END), _END) for v in (x[own] * q[i]).sum(1).tolist()] if len(own) else [], dtype=np.int64)


def block_top(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, resolutions=RESOLUTIONS, known: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query (query id, row id, score) of its k best rows here, ties to smaller ids; a query's own id is no candidate.

    The inner product of two segments is m*mean*mean plus their covariance, which the product of deviations bounds; maximal
    inner product is minimal distance up to the norms. Bounds, in doubles with a margin, are taken coarse to fine, then
    survivors are scored exactly in integers. Rows below the scores known for the queries may be left out.
    """
    known = np.full(len(queries), -np.inf) if known is None else known
    order = np.argsort(row_ids, kind="stable")
    rows, row_ids = rows[order], row_ids[order]
    q, x = queries.astype(np.float64), rows.astype(np.float64)
    levels = [(_summaries(q, s), _summaries(x, s)) for s in resolutions if x.shape[1]]
    slack = 1e-6 * (np.abs(q).sum(1).max(initial=0) * np.abs(x).max(initial=0) + 1)
    dot = products(queries, rows)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(q), 256):
        coarse = levels[0][0][lo : lo + 256] @ levels[0][1].T if levels else np.zeros((len(q[lo : lo + 256]), len(x)))
        for i in range(lo, min(lo + 256, len(q))):
            bound = coarse[i - lo]
            others = row_ids != query_ids[i]
            own = np.flatnonzero(others & (bound + slack >= known[i]))
            if len(own) > k:
                first = own[np.argpartition(-bound[own], k - 1)[:k]]
                least = max(reached(dot(i, first).min()), known[i])
                own = own[bound[own] + slack >= least]
                for fine_q, fine_x in levels[1:]:
                    own = own[fine_x[own] @ fine_q[i] + slack >= least]
            scores = dot(i, own)
            best = np.lexsort((row_ids[own], -scores))[:k]
            found.append((np.full(len(best), query_ids[i]), row_ids[own][best], scores[best]))
    return found


def _whole(r: dict, ids: str, vectors: str) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(r[ids], dtype="<i8")
    return found, np.frombuffer(r[vectors], dtype="<i8").reshape(len(found), r["dims"])


def _streamed(k: int, resolutions: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block of queries, followed by the blocks of rows that promise it most: each raises what the next ones must reach."""
        q_ids, q, known, best = np.zeros(0, dtype=np.int64), None, None, []
        names, kinds = ["query_id", "vec_id", "score"], pa.int64()

        def answer() -> pa.RecordBatch:
            held = [np.concatenate(c) if best else np.zeros(0, dtype=np.int64) for c in zip(*best, strict=True)] if best else [np.zeros(0, dtype=np.int64)] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, type=kinds) for c in (np.repeat(q_ids, [len(ids) for ids, _ in best]), *held)], names=names)

        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    yield answer()
                    q_ids, q = _whole(r, "ids", "vectors")
                    known, best = np.frombuffer(r["known"]).copy(), [(np.zeros(0, dtype=np.int64),) * 2 for _ in q_ids]
                elif -r["order"] >= known.min(initial=np.inf):
                    ids, x = _whole(r, "ids", "vectors")
                    for i, (_, near, score) in enumerate(block_top(q, q_ids, x, ids, k, resolutions, known)):
                        near, score = np.concatenate((best[i][0], near)), np.concatenate((best[i][1], score))
                        top = np.lexsort((near, -score))[:k]
                        best[i] = (near[top], score[top])
                        if len(top) == k:
                            known[i] = max(known[i], reached(score[top[-1]]))
        yield answer()

    return run


def _seeded(k: int, resolutions: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query block with the k-th score of its queries in one block of rows, where there are so many."""
        for batch in batches:
            known = []
            for r in batch.to_pylist():
                q_ids, q = _whole(r, "q_ids", "q_vectors")
                ids, x = _whole(r, "ids", "vectors")
                found = block_top(q, q_ids, x, ids, k, resolutions)
                known.append(np.array([reached(score[-1]) if len(score) == k else -np.inf for _, _, score in found]).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("q_block", "dims", "q_ids", "q_vectors")), pa.array(known, pa.binary())], names=["q_block", "dims", "q_ids", "q_vectors", "known"])

    return run


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each pair of blocks, the score that no query and row of theirs can exceed."""
    for batch in batches:
        bounds = []
        for r in batch.to_pylist():
            q, x = np.frombuffer(r["q_box"]).reshape(2, -1), np.frombuffer(r["box"]).reshape(2, -1)
            slack = 1e-6 * (np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(r["dims"], 1) + 1)
            bounds.append(most(q, x, r["dims"]) + slack)
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("q_block", "dims", "block")), pa.array(bounds, pa.float64())], names=["q_block", "dims", "block", "bound"])


def plan(queries: DataFrame, rows: DataFrame, k: int, block_rows: int, resolutions: tuple[int, ...] = RESOLUTIONS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks of queries with the scores that they know, blocks of rows, pairs of them that are to be searched)."""
    x = written(packed(rows, block_rows), "search-rows")
    q = written(packed(queries, block_rows).select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), "dims", F.col("vectors").alias("q_vectors"), F.col("box").alias("q_box")), "search-queries")
    # only boxes meet here: 640 bytes for a block of either side
    last = q.agg(F.max("q_block")).first()[0] or 0
    every = x.select("dims", "block", "box", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("q_block"))
    reach = written(q.select("q_block", "dims", "q_box").join(every, ["q_block", "dims"]).mapInArrow(_bounded, "q_block int, dims int, block int, bound double"), "search-bounds")
    # each query knows its k-th score in the block that promises most
    seed = reach.groupBy("q_block", "dims").agg(F.max(F.struct("bound", "block")).alias("seed")).select("q_block", "dims", F.col("seed.block").alias("block"))
    first = q.drop("q_box").join(seed, ["q_block", "dims"]).join(x.select("block", "dims", "ids", "vectors"), ["block", "dims"])
    known = written(first.mapInArrow(_seeded(k, resolutions), "q_block int, dims int, q_ids binary, q_vectors binary, known binary"), "search-known")

    @F.pandas_udf("double")
    def least(values: pd.Series) -> pd.Series:
        return values.map(lambda v: float(np.frombuffer(v).min(initial=np.inf)))

    pairs = reach.join(known.select("q_block", "dims", least("known").alias("least")), ["q_block", "dims"]).where("bound >= least").select("q_block", "dims", "block", "bound")
    return known, x, pairs


def top_k(queries: DataFrame, rows: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, block_rows: int = BLOCK_ROWS, resolutions: tuple[int, ...] = RESOLUTIONS) -> DataFrame:
    """Each query's k rows of highest integer inner product: (query_id, rank, vec_id, score).

    Ties go to the smaller vec_id, then repeated rows keep one place each. Scores are exact integers of any size that a long
    holds; sums beyond stand at its ends. Vectors of other lengths than the query's are no
    candidates. Null vectors, null ids and vectors that hold null or non-finite components take no part; an empty table gives
    no rows; a query's id that stands twice is answered once for all its rows together. Rows and queries are cut into blocks
    of vectors that are alike. Each query first learns a score from the block whose bound is highest; a block of rows is sent only to
    the blocks of queries for which the bound of both blocks' summaries reaches what some query knows. There they stream past
    their block of queries, SLICE to a task, the most promising first, each raising what the next must reach, and rows are
    bounded coarse to fine. A task holds one block of each and returns k rows a query at most.
    """
    known, x, pairs = plan(whole_vectors(queries, id_col, vector_col, scale), whole_vectors(rows, id_col, vector_col, scale), k, block_rows, tuple(resolutions))
    pairs = written(pairs.withColumn("slice", F.expr(f"block div {SLICE}")), "search-pairs")
    columns = ["q_block", "dims", "slice", "kind", "order", "ids", "vectors", "known"]
    heads = pairs.select("q_block", "dims", "slice").distinct().join(known, ["q_block", "dims"]).select("q_block", "dims", "slice", F.lit(0).alias("kind"), F.lit(0.0).alias("order"), F.col("q_ids").alias("ids"), F.col("q_vectors").alias("vectors"), "known")
    sent = pairs.join(x.select("block", "dims", "ids", "vectors"), ["block", "dims"]).select("q_block", "dims", "slice", F.lit(1).alias("kind"), (-F.col("bound")).alias("order"), "ids", "vectors", F.lit(None).cast("binary").alias("known"))
    groups = pairs.select("q_block", "dims", "slice").distinct().count()
    spread = heads.unionByName(sent).select(*columns).repartition(max(1, min(200_000, groups)), "q_block", "dims", "slice").sortWithinPartitions("q_block", "dims", "slice", "kind", "order")
    best = spread.mapInArrow(_streamed(k, tuple(resolutions)), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: rows whose vec_id is divisible by 20; candidates: every other row of embeddings."""
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows.where(F.col("vec_id") % 20 == 0), rows, k=20)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
