"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of ASCII white space, and of what is neither digit, a-z nor beyond ASCII, as Java patterns.
SPACES = r"[\x20\x09-\x0D]+"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of an Arrow batch, where Spark has such a bound.
BATCH_BYTES = 4 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent and the master is local (tests) a temporary folder is set; a cluster without the
    setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows read back from a table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    released(spark)
    return spark.read.schema(df.schema).parquet(path)


def parted(df: DataFrame, condition: Column, purpose: str) -> tuple[DataFrame, DataFrame]:
    """As written(), in two tables: the rows for which the condition holds, and the others. Each can be dropped() alone."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.withColumn("_part", F.coalesce(condition, F.lit(False))).write.partitionBy("_part").parquet(path)
    released(spark)
    for side in ("true", "false"):  # one without rows has no folder
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_part={side}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    yes, no = (spark.read.schema(df.schema).parquet(f"{path}/_part={side}") for side in ("true", "false"))
    return yes, no


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Python workers get at most so many rows at once, so that long texts fit; a smaller setting stays. The setting is the
    session's: plans run after this function has returned."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, rows)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.isModifiable(name):
        spark.conf.set(name, str(BATCH_BYTES))


_caches: dict[str, Callable[[], None]] = {}


def only(owner: str, clear: Callable[[], None] | None = None) -> None:
    """In a Python worker, which goes from one operator to the next: the caches of all operators but `owner` are emptied.
    `clear` is how to empty this one's."""
    for name, other in _caches.items():
        if name != owner:
            other()
    if clear:
        _caches[owner] = clear


def trimmed() -> None:
    """In a Python worker, which stays: what Arrow and the C library hold without need goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library of another kind keeps what it has
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of jobs that are over: it does once the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table made by written(), once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; texts of ASCII only take the quick built-in way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column, breaks: str) -> Column:
    """The maximal runs between separators, as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), breaks), "")


def bounded(df: DataFrame, rows: int) -> bool:
    """Whether the table has at most so many rows; reads no more of it than needed."""
    return df.limit(rows + 1).count() <= rows
