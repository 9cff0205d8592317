"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE_ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per Spark context.

    Functions then arrive by reference, so what a worker has loaded (vocabularies,
    word caches) serves all tasks that it runs.
    """
    sc = spark.sparkContext
    if getattr(sc, "_ledgerlight_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="ledgerlight-"), "ledgerlight_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((PACKAGE_ROOT / "ledgerlight").rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE_ROOT))
    sc.addPyFile(path)
    sc._ledgerlight_shipped = True


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under the cluster's checkpoint folder, for tables that cut lineage.

    ``spark.checkpoint.dir`` names a folder that all executors see. Where it is unset a
    session in one process (tests, local runs) uses a local folder, which is set for
    ``checkpoint()`` as well; a cluster is told to name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "ledgerlight-shared")
        os.makedirs(base, exist_ok=True)
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    if _scratch:
        _scratch[-1].append(table)
    return table


_scratch: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables that ``written`` makes inside go at the end, but for those taken out of the list: for jobs whose result is written inside as well."""
    _scratch.append([])
    try:
        yield _scratch[-1]
    finally:
        discard(*_scratch.pop())


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for t in tables:
        path = getattr(t, "written_to", None)
        if path:
            sc = t.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


class Memo(dict):
    """A bounded cache of a pure function.

    Two generations of half the bound: when the new one is full it becomes the old one,
    from which entries still in use come back, so common keys outlive rare ones.
    """

    def __init__(self, fn: Callable, bound: int = 300_000):
        super().__init__()
        self.fn, self.half, self.old = fn, bound // 2, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


_resident: dict = {}


def resident(make: Callable, *key):
    """``make(*key)``, kept in this Python worker until another such object is asked for; a worker thus holds one vocabulary at most."""
    name = (make.__qualname__, *key)
    if name not in _resident:
        _resident.clear()
        trim()
        _resident[name] = make(*key)
    return _resident[name]


def sized(batches: Iterator[pa.RecordBatch], *text_columns: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of record batches with about ``most`` bytes of text each, so that memory follows the longest text and not the number of rows."""
    for batch in batches:
        size = sum(pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for i in text_columns)
        edges = np.flatnonzero(np.diff(np.cumsum(size) // most, prepend=-1, append=-1))
        for at, end in zip(edges[:-1], edges[1:]):
            yield batch.slice(at, end - at)


def release() -> None:
    """Let go of what this worker keeps for another job, as stages of a pipeline follow each other in the same workers."""
    if _resident:
        _resident.clear()
        trim()


def trim() -> None:
    """Give free memory of this worker back to the machine, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Python workers get record batches of about ``most`` bytes at most, whatever their number of rows, unless the session says otherwise.

    Both the worker and its executor hold a batch whole. It is set for the session, as a table is computed after the call that describes it.
    """
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(most))


def by_batch(fn: Callable[[pa.RecordBatch], dict[str, list]], schema: pa.Schema) -> Callable:
    """A ``mapInArrow`` function from one that maps a record batch to columns; the texts stand in column 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, 1):
            out = fn(batch)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return run


def whole_texts(batch: pa.RecordBatch, at: int = 1) -> list[str]:
    """The texts of a batch; null becomes the empty text."""
    return [t or "" for t in batch.column(at).to_pylist()]


def bounded_rows(df: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows at most, chosen by a hash of ``key``; all of them if there are fewer."""
    n = df.count()
    if n <= bound:
        return df
    return df.filter(F.shiftrightunsigned(F.xxhash64(F.lit(17), F.col(key)), 1) < int((1 << 63) * bound / n))
