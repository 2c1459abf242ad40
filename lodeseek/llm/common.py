"""What the operators share: scratch tables in the cluster's shared folder, and import paths for workers."""

from __future__ import annotations

import ctypes
import gc
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Rows of whole texts in one Arrow batch: 10,000, Spark's own number, make buffers of tens of MB a task outside the heap, which pools keep.
BATCH_ROWS = 1000
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


_shipped: set[str] = set()


def one_machine(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, as in tests."""
    return spark.sparkContext.master.split("[")[0] == "local"


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package also where it isn't installed on them, and keep the session's Arrow batches short.

    On a cluster the package travels to the executors as a zip archive in the shared
    folder, once a context; on one machine its folder is put on the workers' path.
    """
    if not 0 < int(spark.conf.get(BATCH_CONF, "10000")) <= BATCH_ROWS:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))
    sc = spark.sparkContext
    if one_machine(spark):
        have = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
        if ROOT not in have:
            sc.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, have)])
    elif sc.applicationId not in _shipped:
        package, held = os.path.basename(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for folder, _, names in os.walk(os.path.join(ROOT, package)):
                for n in sorted(n for n in names if n.endswith(".py")):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), ROOT))
        fs, made = own_folder(spark, "package")
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{made}/{package}.zip"))
        out.write(held.getvalue())
        out.close()
        sc.addPyFile(f"{made}/{package}.zip")
        _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only where it is unset and there is but one machine (tests), one of our own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not one_machine(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lodeseek-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def own_folder(spark: SparkSession, name: str) -> tuple:
    """A new folder in the shared one, which the driver's end deletes, and its file system."""
    base = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return fs, base


class Scratch:
    """Tables written to the shared folder to cut lineage; drop() deletes those that nothing reads any more, the driver's end the rest."""

    def __init__(self, spark: SparkSession, name: str):
        ready(spark)
        self.spark, (_, self.base) = spark, own_folder(spark, name)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(conf).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SMALL_ROWS = 500


def release() -> None:
    """Gives this process's free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """For mapInArrow: gives run its batches in short slices, and afterwards the worker's free memory back to the system.

    Workers outlive their tasks, so what one keeps adds to what the next needs.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(b.slice(at, SMALL_ROWS) for b in batches for at in range(0, b.num_rows, SMALL_ROWS))
        finally:
            release()

    return wrapped


#: Up to so many ids (16 MB of longs) are broadcast; a longer list goes through a shuffle.
BROADCAST_IDS = 2_000_000


def pick(rows: DataFrame, ids: DataFrame, how: str = "left_semi", id_col: str = "doc_id") -> DataFrame:
    """The rows whose id is (left_semi) or isn't (left_anti) among ids, a written table of distinct ids whose size is checked first."""
    ids = ids.select(F.col(ids.columns[0]).alias("_pick"))
    small = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if small else ids, F.col(id_col) == F.col("_pick"), how)
