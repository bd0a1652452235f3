"""Shared pieces of the training-data operators: tables, the shared folder, sampling-free helpers."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_written: list[tuple[SparkSession, str]] = []
#: Of paths of store(): weak references of the JVM to the file index that all plans which read the table share.
_read_by: dict[str, JavaObject] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where it is unset."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    sc = spark.sparkContext
    if (have := sc._jsc.sc().getCheckpointDir()).isDefined():
        return have.get().rstrip("/")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessitura-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the Hadoop API."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/tessitura-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> Iterator[None]:
    """Plans made meanwhile send Python so many rows and about so many bytes at once at most: texts may be long."""
    most = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in most}
    for k, v in most.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def store(df: DataFrame, label: str, rows: int = 1000) -> DataFrame:
    """Cut the lineage: write a Parquet table in the shared folder and read it again. rows: most that Python gets at once."""
    path = new_path(df.sparkSession, label)
    with small_batches(df.sparkSession, rows):
        df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    index = found._jdf.queryExecution().analyzed().collectLeaves().head().relation().location()
    _read_by[path] = df.sparkSession.sparkContext._jvm.java.lang.ref.WeakReference(index)
    return found


def release(spark: SparkSession) -> None:
    """Remove the tables of store() that no DataFrame reads any more, and let Spark remove shuffle files likewise."""
    gc.collect()
    time.sleep(1.5)  # Py4J tells the JVM each second what Python has freed
    spark.sparkContext._jvm.System.gc()
    for own, path in list(_written):
        if own is spark and path in _read_by and _read_by[path].get() is None:
            fs, p = hadoop_path(spark, path)
            fs.delete(p, True)
            _written.remove((own, path))
            del _read_by[path]


def sums_of(parts: DataFrame, kind: type) -> Iterator[tuple[int, np.ndarray]]:
    """(at, sum) of parts (at long, part binary): arrays of equal kind and length, added up on executors."""

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, dtype=kind) for x in t.column(1).to_pylist())
        return pa.table({"at": t.column(0)[:1], "part": pa.array([total.tobytes()], pa.binary())})

    for r in parts.groupBy("at").applyInArrow(add, "at long, part binary").toLocalIterator():
        yield r["at"], np.frombuffer(r["part"], dtype=kind)


@atexit.register
def clear() -> None:
    """Remove the tables that this process wrote to the shared folder."""
    while _written:
        spark, path = _written.pop()
        _read_by.pop(path, None)
        try:
            fs, p = hadoop_path(spark, path)
            fs.delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone
            return


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
