"""What the operators share: reading tables, keeping results on shared storage, slicing batches."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without spark.checkpoint.dir only a
    session on one machine (tests) gets a folder of its own; a cluster has none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that driver and executors share (master {master})")
        found = tempfile.mkdtemp(prefix="terrasift-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (with _ for .) that hold inside the block only."""
    names = {k.replace("_", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Where keep() writes: the innermost workspace's folder.
_FOLDERS: ContextVar[tuple[str, ...]] = ContextVar("_FOLDERS", default=())


@contextlib.contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Tables kept inside the block go when it ends; settled() ones stay."""
    path = f"{shared_dir(spark)}/terrasift/{uuid.uuid4().hex}"
    token = _FOLDERS.set((*_FOLDERS.get(), path))
    try:
        yield
    finally:
        _FOLDERS.reset(token)
        _delete(spark, path)


def _write(df: DataFrame, folders: tuple[str, ...], rows_at_once: int) -> DataFrame:
    spark = df.sparkSession
    path = f"{folders[-1] if folders else shared_dir(spark) + '/terrasift'}/{uuid.uuid4().hex}"
    # The shuffle files of the query that writes the table go with it.
    with settings(spark, spark_sql_execution_arrow_maxRecordsPerBatch=str(rows_at_once), spark_sql_classic_shuffleDependency_fileCleanup_enabled="true"):
        df.write.option("compression", "zstd").parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def keep(df: DataFrame, rows_at_once: int = 1000) -> DataFrame:
    """Writes df to the shared folder and reads it back: it is computed once, its
    lineage ends there, and the rows outlive any executor. rows_at_once: rows of
    an Arrow batch meanwhile, which bounds what a worker holds of long texts."""
    return _write(df, _FOLDERS.get(), rows_at_once)


def settled(df: DataFrame, rows_at_once: int = 1000) -> DataFrame:
    """An operator's result, kept outside its workspace, of which nothing else is left."""
    return _write(df, _FOLDERS.get()[:-1], rows_at_once)


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def drop(*tables: DataFrame) -> None:
    """Deletes what keep() wrote, once nothing needs it any more."""
    for df in tables:
        _delete(df.sparkSession, df._kept_at)


#: The most ids (of 8 bytes) that are broadcast; more take a shuffled join.
MOST_IDS = 2_000_000


def only_ids(df: DataFrame, ids: DataFrame, on: str | list[str], how: str = "left_semi") -> DataFrame:
    """The rows of df whose id is one of ids (distinct): a filter without a shuffle
    of df while the ids are few, a shuffled semi-join beyond MOST_IDS."""
    ids = keep(ids)
    return df.join(F.broadcast(ids) if ids.count() <= MOST_IDS else ids, on, how)


def without_ids(df: DataFrame, ids: DataFrame, on: str | list[str]) -> DataFrame:
    """The rows of df whose id is null or none of ids, in the same way."""
    return only_ids(df, ids, on, "left_anti")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_terrasift_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    path = f"{tempfile.mkdtemp(prefix='terrasift-')}/terrasift.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(path)
    sc._terrasift_shipped = True


#: The most rows that the session's readers and Arrow batches take at once: rows hold
#: whole texts, and thousands of long ones make buffers that a small heap cannot place.
BATCH_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.parquet.columnarReaderBatchSize": 512}


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's batch sizes to BATCH_ROWS; lower ones stay."""
    for name, most in BATCH_ROWS.items():
        now = int(spark.conf.get(name))
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def map_arrow(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """df.mapInArrow, with this package on the executors, in small batches."""
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def slices(column: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column of at most `most` bytes, or of one row."""
    import numpy as np

    ends = _offsets(column)
    start, n = 0, len(column)
    while start < n:
        stop = int(np.searchsorted(ends, ends[start] + most, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        yield start, stop
        start = stop


def _offsets(column: pa.Array):
    import numpy as np

    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def utf8(column: pa.Array):
    """(bytes, offsets) of a string column as numpy arrays; null counts as empty."""
    import numpy as np

    column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = _offsets(column)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]
