"""Immutable versions of a dataset: a manifest of Parquet folders with the fixes that led to them."""

from __future__ import annotations

import json
import tempfile
from datetime import datetime, timezone
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from cleargrain.sources.rowid import ROW_ID

MANIFEST = "version long, parent long, name string, path string, rows long, columns int, is_cleaned boolean, status string, note string, at timestamp"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local master may go without: it gets a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def compilable(spark: SparkSession) -> None:
    """Lets Spark split the code of wide expressions: the JVM runs methods of more than 8,000 bytes uncompiled, many times slower."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", 8_000)


#: Partitions that a shuffle starts with, and the bytes up to which they are joined.
FINE_PARTS, FINE_BYTES = 1_000, 16 << 20


def fine_shuffles(spark: SparkSession) -> None:
    """Shuffles start with many small partitions, which Spark joins up to FINE_BYTES: what a task holds does not grow with the table.

    Sizes that the session sets itself stay.
    """
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if int(spark.conf.get(name, None) or spark.conf.get("spark.sql.shuffle.partitions")) < FINE_PARTS:
        spark.conf.set(name, FINE_PARTS)
    if spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None) in (None, "67108864b", "64MB", "64m"):
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", FINE_BYTES)


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read back, its lineage cut."""
    shared_folder(df.sparkSession)
    compilable(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As settled(), but in Parquet, so that a later scan reads only the columns it needs. Rows come back in any order."""
    compilable(df.sparkSession)
    folder = f"{shared_folder(df.sparkSession)}/stored-{uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class VersionStore:
    """Versions under one folder. A version is never overwritten; undo adds one that points to an older path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")
        except Exception as e:  # an empty store has no manifest yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def _claimed(self) -> int:
        """The next version number. It is taken by creating a file under it, which only one writer can."""
        version = (self.manifest().agg(F.max("version")).first()[0] or 0) + 1
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        while True:
            path = hadoop.Path(f"{self.root}/numbers/{version}")
            try:
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, False).close()
                return version
            except Py4JJavaError as e:
                if "AlreadyExists" not in str(e.java_exception):
                    raise
                version += 1

    def _log(self, **row) -> int:
        version = self._claimed()
        row = {"version": version, "at": datetime.now(timezone.utc).replace(tzinfo=None)} | row
        names = [f.split()[0] for f in MANIFEST.split(", ")]
        self.spark.createDataFrame([tuple(row.get(n) for n in names)], MANIFEST).write.mode("append").parquet(f"{self.root}/manifest")
        return version

    def save(self, df: DataFrame, name: str, parent: int | None = None, is_cleaned: bool = False, note: dict | None = None, paged: bool = False) -> int:
        """Write a version in one pass that also counts its rows; an empty dataset is refused at first ingest.

        paged: rows are written by ranges of their numbers, and what range each file has is kept, so that page() reads only the files of a page.
        """
        if parent is None and df.isEmpty():
            raise ValueError("the dataset has no rows")
        seen = Observation()
        path = f"{self.root}/data/{datetime.now(timezone.utc):%Y%m%d%H%M%S%f}"
        if paged:
            df = df.repartitionByRange(ROW_ID).sortWithinPartitions(ROW_ID)
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        if paged:
            files = self.spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), ROW_ID)
            files.groupBy("file").agg(F.count("*").alias("rows"), F.min(ROW_ID).alias("first")).coalesce(1).write.parquet(f"{path}-files")
        return self._log(parent=parent, name=name, path=path, rows=seen.get["rows"], columns=len(df.columns), is_cleaned=is_cleaned, status="ready", note=json.dumps(note or {}))

    def row(self, version: int | None = None):
        rows = self.manifest()
        rows = rows.where(F.col("version") == version) if version is not None else rows.orderBy(F.desc("version"))
        found = rows.first()
        if found is None:
            raise KeyError(f"no version {version}")
        return found

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.row(version)["path"])

    def page(self, limit: int, offset: int = 0, version: int | None = None) -> DataFrame:
        """A page of a version in row order. Of one saved with paged, only the files that hold the page are read, however deep it lies.

        Row numbers may have gaps: rows are counted by file.
        """
        path = self.row(version)["path"]
        try:
            files = self.spark.read.schema("file string, rows long, first long").parquet(f"{path}-files")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.read.parquet(path).orderBy(ROW_ID).offset(offset).limit(limit)
        before = F.coalesce(F.sum("rows").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per file
        wanted = files.withColumn("start", before).where((F.col("start") < offset + limit) & (F.col("start") + F.col("rows") > offset)).orderBy("start").collect()  # limit + 1 files at most
        if not wanted:
            return self.spark.read.parquet(path).limit(0)
        return self.spark.read.parquet(*[r["file"] for r in wanted]).orderBy(ROW_ID).offset(offset - wanted[0]["start"]).limit(limit)

    def restore(self, version: int) -> int:
        """Undo: a new version with the data of an older one."""
        old = self.row(version)
        return self._log(parent=old["parent"], name=old["name"], path=old["path"], rows=old["rows"], columns=old["columns"], is_cleaned=old["is_cleaned"], status="ready", note=json.dumps({"restored": version}))

    def baseline(self) -> int:
        return self.manifest().agg(F.min("version")).first()[0]

    def catalogue(self, limit: int = 20, offset: int = 0) -> tuple[DataFrame, int]:
        """A page of versions, newest first, and the total."""
        rows = self.manifest()
        return rows.orderBy(F.desc("version")).offset(offset).limit(limit), rows.count()
