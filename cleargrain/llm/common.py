"""Small helpers that several training-data operators share."""

from __future__ import annotations

import pickle
import tempfile

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the text contracts: runs of anything but the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of texts that a Python task holds at a time.
BATCH_ROWS = 1_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir. Only a local master may go without: it gets a temporary folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as make it new among df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small_batches(df: DataFrame) -> None:
    """Have Spark hand Python BATCH_ROWS rows at a time at most: texts may be long, and a batch lies in memory several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(df.sparkSession.conf.get(name, "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and read it back, so lost executors cost no recomputation."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def split_of(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod: decides which rows are held out of training."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def hash_key(seed: int, *cols: Column) -> Column:
    """32 hex digits that look random and depend on the seed and the values alone."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols]))


def share(df: DataFrame, value) -> Broadcast:
    """Broadcast a model of bounded size; shared() opens it in a task."""
    return df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(held: Broadcast):
    return pickle.loads(held.value)
