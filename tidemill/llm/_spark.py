"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, one of our own, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "tidemill-checkpoints")
    return f"{folder.rstrip('/')}/tidemill"


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name in have:
        name = f"_{name}"
    return name


def with_columns(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` and further columns."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def written(df: DataFrame, name: str, compression: str = "zstd", options: dict | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Cuts the lineage: what follows survives the loss of executors, and rows whose
    keys depend on how a scan was split keep them. Arrays of hashes do not compress:
    ``compression="none"`` saves the codec's buffers for them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression=compression, **(options or {})).parquet(path)
    table_ = spark.read.schema(df.schema).parquet(path)
    table_.written_at = path
    return table_


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` gave and nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], heavy: Column) -> DataFrame:
    """Inner join of rows with the one row of ``right`` that has their keys.

    Rows of ``right`` that are ``heavy`` go out by broadcast, once, and meet their rows of
    ``left`` where those are: the caller sees to it that they are few, whatever the data,
    by asking for a fixed share of all rows of ``left``. The others meet in an ordinary
    join, through which rows of heavy keys pass dealt out by all that they hold.
    """
    more = [c for c in right.columns if c not in keys]
    others = [c for c in left.columns if c not in keys]
    hot, cold = unused(left, "hot"), unused(left, "cold")
    twins = [unused(left, f"right_{k}") for k in keys]
    row = F.struct(F.lit(True).alias("_there"), *more)
    met = left.join(F.broadcast(right.where(heavy).select(*keys, row.alias(hot))), keys, "left")
    rest = right.where(~heavy).select(*(F.col(k).alias(t) for k, t in zip(keys, twins, strict=True)), row.alias(cold))
    dealt = F.when(F.col(hot).isNotNull(), F.xxhash64(*left.columns)).otherwise(F.xxhash64(*keys))
    same = [F.col(k) == F.col(t) for k, t in zip(keys, twins, strict=True)]
    found = F.coalesce(hot, cold)
    both = met.join(rest.hint("merge"), [*same, dealt == F.xxhash64(*twins)], "left").where(found.isNotNull())
    return both.select(*keys, *others, *(found[c].alias(c) for c in more))


#: A key is heavy if it has more than this share of all rows; there are at most as many as its inverse.
HEAVY = 1 / 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def released() -> None:
    """Give memory that was freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(run: Callable) -> Callable:
    """``run`` over Arrow batches; a worker that lives on holds no freed memory after it, whatever runs there next."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            released()

    return whole


#: Text that Spark hands to Python at once; larger batches only cost memory off the heap.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1024
_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": (BATCH_BYTES, 1 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": (BATCH_ROWS, 0)}


def require(df: DataFrame, columns: Iterable[str]) -> None:
    """Check that ``df`` has the columns; also bound the session's Arrow batches, if they are larger."""
    for key, (most, least) in _BATCHES.items():
        now = df.sparkSession.conf.get(key, None)
        now = int(now) if now and now.lstrip("-").isdigit() else None
        if now is None or not least <= now <= most:
            df.sparkSession.conf.set(key, str(most))
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
