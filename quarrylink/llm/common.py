"""What the operators share: the scratch folder, fresh column names and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Whether Spark deletes the shuffle files of a query at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Temporary folders of local sessions without the setting, by application.
_LOCAL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of a data folder; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, named by ``spark.checkpoint.dir``.

    Only a session whose driver and tasks are one process (``local[..]``, as in tests) may do
    without the setting: it gets a temporary folder. On a cluster its absence is an error,
    since executors would write to their own disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # a running session does not let this setting be changed
        app = spark.sparkContext.applicationId
        found = _LOCAL.get(app) or tempfile.mkdtemp(prefix="quarrylink-")
        _LOCAL[app] = found
    return found.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/quarrylink/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, label: str, clean: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    This cuts the lineage: a lost executor costs only tasks that read the table again. It
    also gives the planner the true size, so that it broadcasts only what is small.
    ``discard`` deletes one such table, ``release`` all of the session's. With ``clean`` the
    shuffle files of the write are deleted as it ends.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    try:
        if clean:
            spark.conf.set(_CLEANUP, "true")
        # a plan that is already made keeps the setting of its time
        (df.select("*") if clean else df).write.option("compression", "zstd").parquet(path)
    finally:
        if clean:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote, once nothing that is still to run reads it."""
    _delete(df.sparkSession, df._stored_at)


def release(spark: SparkSession) -> None:
    """Delete all tables that this session stored; results not written yet can't be read any more."""
    _delete(spark, _own_folder(spark))


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names that ``df`` does not have (names count without regard to case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for base in bases:
        name, n = base, 0
        while name.lower() in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name.lower())
        out.append(name)
    return out


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and the n+1 offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]
