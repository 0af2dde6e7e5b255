"""Reading tables, writing intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where the session names none, one of our own in local mode (tests), else an error."""
    found = spark.conf.get(CHECKPOINT_DIR, None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="melisma-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df written once as a table in the shared folder and read back: later jobs and lost executors need not redo it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def row_key(*cols: str) -> Column:
    """A 64-bit key that spreads rows evenly over partitions whatever their ids are."""
    return F.xxhash64(*[F.col(c) for c in cols])


def whole_row(df: DataFrame) -> Column:
    """A 64-bit hash of all columns, which orders rows that share a key: only equal rows can't be told apart."""
    return F.xxhash64(*[F.col(f"`{c}`").cast("string") if "map<" in kind else F.col(f"`{c}`") for c, kind in df.dtypes])


#: The columns of documents, which stages may name; all others are set aside while they work.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def set_aside(df: DataFrame, named: tuple[str, ...] = DOCUMENT) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(df with all but the named columns in one struct, a function that puts a result's columns back as they were).

    So no column of df, whatever its name, meets one that an operator makes: those begin with an underscore or are new.
    """
    names = df.columns
    rest = [c for c in names if c not in named]
    inside = {c: f"_{i}" for i, c in enumerate(rest)}
    packed = df.select(*[F.col(f"`{c}`") for c in names if c in named], F.struct(*[F.col(f"`{c}`").alias(n) for c, n in inside.items()]).alias("_rest")) if rest else df
    return packed, lambda done: done.select(*[F.col("_rest")[inside[c]].alias(c) if c in inside else F.col(f"`{c}`") for c in names])


def lower_ascii(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: A key is hot if more than 1/HOT_KEYS of all rows ask for it: there are fewer such keys than HOT_KEYS.
HOT_KEYS = 1000


def looked_up(many: DataFrame, one: DataFrame, keys: list[str], asked: str, total: int) -> DataFrame:
    """Left join of many rows with one row a key, where some keys may be asked for by a large part of all rows.

    asked is one's column that tells how many rows of many have the key, total is their sum. Hot keys, fewer than HOT_KEYS,
    are looked up by broadcast; for the others a key's rows are at most total / HOT_KEYS.
    """
    is_hot = F.col(asked) * HOT_KEYS > F.lit(total)
    hot, rest = one.where(is_hot), one.where(~is_hot)
    near = many.join(F.broadcast(hot), keys, "inner")
    far = many.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys, "left")
    return near.unionByName(far)


#: Equal rows that one task numbers at most.
COPIES = 4096


def with_copies(df: DataFrame, out: str = "copy") -> DataFrame:
    """df with a number from 0 among rows that are equal in all columns, however many there are, and the same on every run.

    Equal rows are counted where they are read and made again, COPIES to a row of the second step, so no task holds them all.
    For tables of few narrow columns.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    parts = counted.withColumn("_part", F.explode(F.expr(f"sequence(0L, (_n - 1) div {COPIES}L)"))).repartition("_part", *columns)
    first = F.col("_part") * COPIES
    numbers = F.sequence(first, F.least(first + COPIES, F.col("_n")) - 1)
    return parts.select(*columns, F.explode(numbers).alias(out))
