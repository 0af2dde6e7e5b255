"""A store of projects in revisions: readers see a revision only when it is whole, and a register of assets tells what changed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a project may hold besides its score and its workspace.
ASSET_PATH = (
    r"^(audio/original\.(mp3|wav|m4a|flac|ogg|mp4|mov|m4v|audio)|runs/[a-f0-9-]{36}/((clip|vocals|drums|bass|other|guitar|piano)\.wav|"
    r"(stems|pitch-observations|melody-candidates-v3|key-analysis|lyrics|lyrics-alignment|intro-melody|chords|result|params)\.json|recognized\.jpu))$"
)
#: Assets whose change must be seen where a recognition is examined.
EXAMINED = r"/(recognized\.jpu|result\.json|melody-candidates-v3\.json|pitch-observations\.json)$"
POINTER = "current"


class Conflict(ValueError):
    """Another revision was written since the one that a change is based on."""


class ProjectStore:
    """Tables of projects in root, a folder of any file system that Spark reaches, one folder for each revision.

    A write puts all its tables into a new folder first; then a pointer file, written beside and renamed over the old one,
    makes it the current revision. A writer that dies before has left a folder that no pointer names. Readers follow the
    pointer once and read that revision, whatever is written meanwhile.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), spark._jsc.hadoopConfiguration())
        self._rename = jvm.org.apache.hadoop.fs.Options.Rename

    def revision(self) -> tuple[int, str | None]:
        """(number, folder) of the current revision; (0, None) of an empty store."""
        pointer = self._path(f"{self.root}/{POINTER}")
        if not self._files.exists(pointer):
            return 0, None
        number, folder = self.spark.read.text(f"{self.root}/{POINTER}").first()["value"].split(" ", 1)
        return int(number), folder

    def write(self, tables: dict[str, DataFrame], based_on: int) -> int:
        """Make tables the revision after based_on; those that are not given go on from there. Refused if based_on is not current."""
        number, folder = self.revision()
        if number != based_on:
            raise Conflict(f"revision {number} is current, not {based_on}")
        fresh = self._written(tables, folder, number + 1)
        if self.revision()[0] != based_on:
            raise Conflict(f"a revision was written after {based_on}")
        self._published(number + 1, fresh)
        return number + 1

    def _written(self, tables: dict[str, DataFrame], folder: str | None, number: int) -> str:
        fresh = f"revisions/{number:08d}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{fresh}/{name}")
        for name in self.names(folder) if folder else []:
            if name not in tables:
                self.spark.read.parquet(f"{self.root}/{folder}/{name}").write.parquet(f"{self.root}/{fresh}/{name}")
        return fresh

    def _published(self, number: int, folder: str) -> None:
        beside = self._path(f"{self.root}/.{POINTER}-{uuid.uuid4().hex}")
        out = self._files.create(beside, True)
        try:
            out.write(bytearray(f"{number} {folder}", "utf-8"))
        finally:
            out.close()
        options = self.spark._sc._gateway.new_array(self._rename, 1)
        options[0] = self._rename.OVERWRITE
        self._context.rename(beside, self._path(f"{self.root}/{POINTER}"), options)

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._files.listStatus(self._path(f"{self.root}/{folder}")) if s.isDirectory())

    def read(self, name: str) -> DataFrame:
        _, folder = self.revision()
        if folder is None:
            raise ValueError("the store holds no revision")
        return self.spark.read.parquet(f"{self.root}/{folder}/{name}")


def register(files: DataFrame) -> DataFrame:
    """IO9: (project_id, path, size, sha256, accepted) of (project_id, path, content). A path is accepted by the list of what a project
    may hold; of one path given twice the last by its digest stands. Null content is as empty."""
    content = F.coalesce("content", F.lit(b""))
    found = files.select("project_id", "path", F.octet_length(content).cast("long").alias("size"), F.sha2(content, 256).alias("sha256"), F.coalesce(F.col("path").rlike(ASSET_PATH), F.lit(False)).alias("accepted"))
    return found.groupBy("project_id", "path").agg(F.max(F.struct("sha256", "size", "accepted")).alias("a")).select("project_id", "path", "a.size", "a.sha256", "a.accepted")


def registered_files(spark: SparkSession, root: str) -> DataFrame:
    """IO9: the register of every file below root/<project>/. Spark's reader leaves files of no bytes out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    own = F.regexp_extract("path", f"/{root.rstrip('/').rsplit('/', 1)[-1]}/([^/]+)/(.*)$", 1)
    return register(files.select(own.alias("project_id"), F.regexp_extract("path", f"/{root.rstrip('/').rsplit('/', 1)[-1]}/([^/]+)/(.*)$", 2).alias("path"), "content"))


def changed_assets(before: DataFrame, after: DataFrame) -> DataFrame:
    """X29: (project_id, path, change, examined) of two registers: added, removed or changed by digest or size."""
    joined = before.select("project_id", "path", F.col("sha256").alias("old"), F.col("size").alias("old_size")).join(after.select("project_id", "path", F.col("sha256").alias("new"), F.col("size").alias("new_size")), ["project_id", "path"], "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return joined.where("old IS NULL OR new IS NULL OR old <> new OR old_size <> new_size").select("project_id", "path", change.alias("change"), F.col("path").rlike(EXAMINED).alias("examined"))


def changed_projects(before: DataFrame, after: DataFrame, assets_before: DataFrame, assets_after: DataFrame) -> DataFrame:
    """X29 over projects (project_id, score, based_on, runs: array of (id, status, notation), workspace) and their registers:
    (project_id, reason), the first of score, based_on, runs, assets that calls for a new look. The workspace alone does not."""
    joined = before.select("project_id", *[F.col(c).alias(f"old_{c}") for c in ("score", "based_on", "runs")]).join(after.select("project_id", "score", "based_on", "runs"), "project_id", "full")
    lost = F.col("score").isNull() | F.col("old_score").isNull()
    moved = changed_assets(assets_before, assets_after).where("examined").select("project_id").distinct().withColumn("moved", F.lit(True))
    reason = F.when(lost, "project").when(~F.col("based_on").eqNullSafe(F.col("old_based_on")), "based on").when(F.col("score") != F.col("old_score"), "score").when(~F.col("runs").eqNullSafe(F.col("old_runs")), "runs").when(F.col("moved"), "assets")
    return joined.join(moved, "project_id", "left").select("project_id", reason.alias("reason")).where("reason IS NOT NULL")


def _assets(spark: SparkSession, sf_dir: str, later: bool) -> DataFrame:
    """Pages as assets: a run's result, an original, and a path that no project may hold."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    run = F.concat(F.substring(F.sha2(F.col("page_id").cast("string"), 256), 1, 36))
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("runs/"), F.regexp_replace(run, "^(.{8}).(.{4})", "$1-$2"), F.lit("/result.json"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("audio/original."), F.element_at(F.array(F.lit("mp3"), F.lit("wav")), (F.col("page_id") % 2 + 1).cast("int")))).otherwise(F.concat(F.lit("../"), F.col("page_id").cast("string")))
    own = p.select((F.col("page_id") % 50).alias("project_id"), path.alias("path"), "page_id", F.col("html").cast("binary").alias("content"))
    if later:
        own = own.where("page_id % 11 > 0").withColumn("content", F.when(F.col("page_id") % 7 == 0, F.lit(b"changed")).otherwise(F.col("content")))
    return own.drop("page_id")


QUERIES = {"asset_register": lambda s, d: register(_assets(s, d, False)), "asset_changes": lambda s, d: changed_assets(register(_assets(s, d, False)), register(_assets(s, d, True)))}


def _asset_sql(later: bool) -> str:
    content = "CASE WHEN page_id % 7 = 0 THEN 'changed' ELSE html END" if later else "html"
    return f"""SELECT page_id % 50 AS project_id, CASE WHEN page_id % 3 = 0 THEN 'runs/' || regexp_replace(substr(sha256(CAST(page_id AS VARCHAR)), 1, 36), '^(.{{8}}).(.{{4}})', '\\1-\\2') || '/result.json' WHEN page_id % 3 = 1 THEN 'audio/original.' || CASE WHEN page_id % 2 = 0 THEN 'mp3' ELSE 'wav' END ELSE '../' || page_id END AS path,
    coalesce({content}, '') AS content FROM pages{" WHERE page_id % 11 > 0" if later else ""}"""


def _register_sql(later: bool) -> str:
    return f"SELECT project_id, path, max(sha256(content)) AS sha256, arg_max(CAST(strlen(content) AS BIGINT), sha256(content)) AS size FROM ({_asset_sql(later)}) GROUP BY project_id, path"


ORACLES = {
    "asset_register": f"SELECT project_id, path, size, sha256, regexp_matches(path, '{ASSET_PATH}') AS accepted FROM ({_register_sql(False)})",
    "asset_changes": f"SELECT coalesce(b.project_id, a.project_id) AS project_id, coalesce(b.path, a.path) AS path, CASE WHEN b.sha256 IS NULL THEN 'added' WHEN a.sha256 IS NULL THEN 'removed' ELSE 'changed' END AS change, regexp_matches(coalesce(b.path, a.path), '{EXAMINED}') AS examined FROM ({_register_sql(False)}) b FULL JOIN ({_register_sql(True)}) a ON a.project_id = b.project_id AND a.path = b.path WHERE b.sha256 IS DISTINCT FROM a.sha256",
}
