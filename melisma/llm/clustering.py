"""Centroid clustering in exact integers: Lloyd's rounds over distinct quantised vectors weighted by how often they occur."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import looked_up, table, written

_SUMS = pa.schema([("cluster", pa.int32()), ("dim", pa.int32()), ("total", pa.decimal128(38)), ("weight", pa.int64())])
_LONG = 2**63


def quantised(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, v) of the vectors with exactly dims components, none null or non-finite: v = floor(scale * x), x as double."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("x").isNotNull() & (F.size("x") == dims)).where(~bad).select(
        "vec_id", F.transform("x", lambda c: F.floor(F.lit(float(scale)) * c).cast("long")).alias("v")
    )


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid, ties to the smaller number; exact for any integers.

    Distances come from inner products of doubles while every sum stays below 2**53, else from integers of any length.
    """
    c = np.array(centroids, dtype=np.int64)
    if x.shape[1] * (_largest(x) + _largest(c)) ** 2 < 2**53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    else:
        a, b = x.astype(object), c.astype(object)
        d = np.stack([((a - row) ** 2).sum(1) for row in b], 1)
    best = np.array([min(range(len(r)), key=r.__getitem__) for r in d], dtype=np.int64) if d.dtype == object else d.argmin(1)
    return best, d[np.arange(len(d)), best]


def _partial(centroids: list[list[int]], dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each centroid and component, the weighted sum over this task's vectors: k * dims rows."""
        totals, weights = np.zeros((len(centroids), dims), dtype=object), np.zeros(len(centroids), dtype=object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, w = _matrix(batch["v"], dims), batch["weight"].to_numpy()
            best, _ = nearest(x, centroids)
            if _largest(x) * int(w.astype(object).sum()) >= _LONG:
                x, w = x.astype(object), w.astype(object)
            for j in np.unique(best):
                own = best == j
                totals[j] += (x[own] * w[own, None]).sum(0).astype(object)
                weights[j] += int(w[own].sum())
        held = [j for j in range(len(centroids)) if weights[j]]
        rows = [(j, i, Decimal(int(totals[j, i])), int(weights[j])) for j in held for i in range(dims)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=_SUMS.field(i).type) for i in range(4)], schema=_SUMS)

    return run


def _assigned(centroids: list[list[int]], dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, d = nearest(_matrix(batch["v"], dims), centroids) if batch.num_rows else (np.zeros(0, dtype=np.int64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch["v"], batch["weight"], pa.array(best.astype(np.int32)), pa.array([Decimal(int(x)) for x in d], type=pa.decimal128(38))], names=["v", "weight", "cluster", "distance"])

    return run


def _moved(distinct: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """One round: each centroid that has vectors becomes the floor of their mean. k * dims sums reach the driver."""
    found = distinct.mapInArrow(_partial(centroids, dims), "cluster int, dim int, total decimal(38,0), weight long")
    moved = [list(c) for c in centroids]
    for r in found.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight")).collect():
        moved[r["cluster"]][r["dim"]] = int(r["total"]) // r["weight"]
    return moved


def lloyd(df: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each kept vector: (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256).

    Identical quantised vectors are grouped first, so a round reads each distinct vector once, with its multiplicity: copies,
    however many, are one row, and sums are taken within tasks before k * dims numbers a task are shuffled. Sums, floors
    and distances are integers, so results don't depend on partitions. The k vectors whose hash of `seed:vec_id` is least
    begin as centroids (a null id hashes last, repeated ids by their components); with fewer vectors there are fewer
    centroids. Rows of one id stay separate rows. Vectors of other lengths, null ones and those with null or non-finite
    components take no part; an empty table gives no rows. Quantised components beyond a long stand at its ends, and a
    distance or inertia that no long can hold is null. Other columns are not read.
    """
    rows = quantised(df, id_col, vector_col, dims, scale)
    start = rows.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)).orderBy(F.asc_nulls_last("h"), "v").limit(k).select("v").collect()
    centroids = [[int(x) for x in r["v"]] for r in start]
    kinds = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return df.sparkSession.createDataFrame([], kinds)
    distinct = written(rows.groupBy("v").agg(F.count(F.lit(1)).alias("weight")), "distinct-vectors")
    for _ in range(rounds):
        moved = _moved(distinct, centroids, dims)
        if moved == centroids:  # later rounds would repeat this one
            break
        centroids = moved
    last = written(distinct.mapInArrow(_assigned(centroids, dims), "v array<long>, weight long, cluster int, distance decimal(38,0)"), "assigned-vectors")
    # sums in two halves: the product of a distance and a weight may pass 38 digits
    halves = {r["cluster"]: (r["n"], int(r["low"] or 0) + 10**9 * int(r["high"] or 0)) for r in last.groupBy("cluster").agg(
        F.sum("weight").alias("n"), F.sum(F.expr("cast(distance % 1000000000 as decimal(10,0)) * weight")).alias("low"), F.sum(F.expr("cast(floor(distance / 1000000000) as decimal(28,0)) * cast(weight as decimal(10,0))")).alias("high")).collect()}
    fits = lambda n: n if -_LONG <= n < _LONG else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda values, kind: F.element_at(F.create_map(*[F.lit(x) for j in halves for x in (j, values(j))]), F.col("cluster")).cast(kind)
    joined = looked_up(rows, last, ["v"], "weight", sum(n for n, _ in halves.values()))
    return joined.select(
        "vec_id", "cluster", F.when(F.col("distance") < F.lit(Decimal(_LONG)), F.col("distance").cast("long")).alias("distance"),
        of(lambda j: fits(halves[j][1]), "long").alias("cluster_inertia"), F.lit(fits(sum(t for _, t in halves.values()))).cast("long").alias("inertia"),
        of(lambda j: digest[j], "string").alias("centroid_sha256"),
    )


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd(table(spark, sf_dir, "embeddings"))


def _oracle(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    near = (
        "SELECT r, vec_id, e, cluster, distance FROM (SELECT k.r, k.vec_id, k.e, c.cluster, d.distance, row_number() OVER (PARTITION BY k.r ORDER BY d.distance, c.cluster) AS place "
        "FROM kept k CROSS JOIN c{i} c CROSS JOIN LATERAL (SELECT CAST(list_sum(list_transform(list_zip(k.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance) d) WHERE place = 1"
    )
    move = (
        "SELECT cluster, list(m ORDER BY i) AS e FROM (SELECT cluster, i, CAST(CASE WHEN s % n < 0 THEN (s - (s % n) - n) // n ELSE (s - s % n) // n END AS BIGINT) AS m FROM "
        f"(SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(e) AS x, unnest(range({dims})) AS i FROM a{{i}}) GROUP BY cluster, i)) GROUP BY cluster "
        "UNION ALL SELECT cluster, e FROM c{i} WHERE cluster NOT IN (SELECT cluster FROM a{i})"
    )
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings "
        f"WHERE embedding IS NOT NULL AND len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT cluster, e FROM (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, e) - 1 AS INTEGER) AS cluster, e FROM kept) WHERE cluster < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED ({near.replace('{i}', str(i))})")
        if i < rounds:
            parts.append(f"c{i + 1} AS MATERIALIZED ({move.replace('{i}', str(i))})")
    return (
        f"WITH {', '.join(parts)} SELECT a.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(c.e, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster"
    )


ORACLE = _oracle()
