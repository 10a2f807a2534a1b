"""Shared helpers of the operators: reading tables, checkpoints, bounded sampling."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NullType, StructField, StructType


#: Folders of local sessions that name none, by application.
LOCAL_FOLDERS: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The whole table ``table`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from the session's ``spark.checkpoint.dir``.

    Only where it is unset and the master is local, as in tests, a temporary one is made (and removed at exit); on a cluster
    its absence is an error, since executors could not read what the driver names.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext.applicationId not in LOCAL_FOLDERS:
        made = tempfile.mkdtemp(prefix="lithoscope-")
        atexit.register(shutil.rmtree, made, True)
        LOCAL_FOLDERS[spark.sparkContext.applicationId] = "file://" + made
    return LOCAL_FOLDERS[spark.sparkContext.applicationId]


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder, so that a lost executor costs nothing but a reread."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, reread, and the table's path."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that ``written`` made, in whatever store it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def crc_mod(doc_id, n: int):
    """crc32(doc_id as text) mod n; null for a null doc_id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n)).cast("int")


def unit_hash(*cols):
    """A hash of the columns, spread evenly over [0, 1)."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)).cast("double") / float(1 << 30)


#: Classes up to this number are sent to all executors as a table of rates; more are joined by shuffles.
BROADCAST_CLASSES = 100_000


def bounded_sample(df: DataFrame, keys: list[str], by: str, per_class: int) -> DataFrame:
    """About ``per_class`` rows of each value of ``by``, with ``rate``, the share of the value's rows that was taken.

    Rows are chosen by a hash of ``keys``, at a rate set from the size of each class, so that the bound is the same for
    every input and no group is gathered in one task. Every class is in the sample; only their number comes to the driver.
    """
    df = df.where(F.col(by).isNotNull())
    rates = checkpoint(df.groupBy(by).count().select(by, F.least(F.lit(1.0), F.lit(float(per_class)) / F.col("count")).alias("rate")))
    few = rates.count() <= BROADCAST_CLASSES
    return df.join(F.broadcast(rates) if few else rates, by).where(unit_hash(*keys) < F.col("rate"))


def appended(schema: StructType, extra: list[StructField]) -> StructType:
    """``schema`` with ``extra``; a column of the input that has the name of an added one (in any case) gives way to it."""
    names = {f.name.lower() for f in extra}
    return StructType([f for f in schema.fields if f.name.lower() not in names] + extra)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` less the columns of these names, in any case."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


#: Rows of an Arrow batch: whole texts may be long, and a batch is held in memory more than once.
ARROW_ROWS = 1_000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are small enough for long texts."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ARROW_ROWS:
        conf.set(name, str(ARROW_ROWS))
    return df


def plain(df: DataFrame) -> DataFrame:
    """``df`` with columns of the void type as strings, which Arrow and Parquet can carry; in small batches."""
    small_batches(df)

    def void(t):
        return isinstance(t, NullType) or isinstance(t, ArrayType) and void(t.elementType)

    return df.withColumns({f.name: F.col(f"`{f.name}`").cast("string") for f in df.schema.fields if void(f.dataType)})


def parts(texts: list, rows: int = ARROW_ROWS, chars: int = 8_000_000) -> list[tuple[int, int]]:
    """Bounds of consecutive parts of ``texts`` with at most so many rows, and characters where a part has several."""
    out, lo, total = [], 0, 0
    for i, t in enumerate(texts):
        n = len(t) if isinstance(t, str) else 0
        if i > lo and (i - lo >= rows or total + n > chars):
            out.append((lo, i))
            lo, total = i, 0
        total += n
    return [*out, (lo, len(texts))] if len(texts) else []


class Memo(dict):
    """A bounded cache of a pure function: emptied when it has grown to ``limit``; results never depend on it.

    Keys of more than ``longest`` characters, if that is given, are not held.
    """

    def __init__(self, function, limit: int = 400_000, longest: int | None = None):
        super().__init__()
        self.function, self.limit, self.longest = function, limit, longest

    def __missing__(self, key):
        value = self.function(key)
        if self.longest is None or len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def sent(df: DataFrame, thing):
    """A broadcast of ``thing`` with its class, for ``received``; the caller answers for its size."""
    return df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(thing))


def received(broadcast):
    tidy()
    return cloudpickle.loads(broadcast.value)


def tidy() -> None:
    """Give back what earlier tasks of this Python worker left: workers are reused, and their caches hold cycles."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
