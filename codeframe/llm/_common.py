"""Shared plumbing: folders that survive executor loss, and text buffers for numpy kernels."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kernels work on slices of about this many bytes of text, so that their
#: temporaries stay small whatever the size of an Arrow batch.
SLICE_BYTES = 1 << 21


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local session that names none (as in tests) gets a folder of its own; on a
    cluster a folder of one machine would lose rows, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get() if own.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="codeframe-")
        atexit.register(shutil.rmtree, found[7:], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Folders of tables written so far that nobody has dropped.
_written: list[str] = []


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_shared(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends here.

    Unlike ``localCheckpoint`` the rows survive the loss of any executor.  The table goes
    when the application ends, or when ``drop_written`` is told that nobody reads it.
    ``rows_per_file`` bounds the files of tables whose rows are big.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codeframe/{name}-{uuid.uuid4().hex}"
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many shared tables there are; a mark for ``drop_written``."""
    return len(_written)


def drop_written(spark: SparkSession, since: int, upto: int) -> None:
    """Remove the tables written between two marks; their place in the list stays, so marks stay good."""
    for k in range(since, min(upto, len(_written))):
        if _written[k]:
            fs, p = _file_system(spark, _written[k])
            fs.delete(p, True)
            fs.cancelDeleteOnExit(p)
            _written[k] = ""


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to trim


def tidy(run: Callable) -> Callable:
    """Give a task's freed memory back to the system at its end: workers are reused, and would keep it."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped


def tidy_groups(run: Callable) -> Callable:
    """The same after each group of a function of two tables, whose groups are big and few."""

    @wraps(run)
    def wrapped(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            _give_back()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id (long) and the text (null: empty); whatever else the table has is pruned."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """128 bits, k1 and k2, that name a row by its id (or the want of one) and its whole text.

    Two rows share them only if both are equal; any two such rows are interchangeable.
    """
    name = F.col(id_col).cast("long")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return [F.xxhash64(F.lit(seed), name.isNull(), name, text).alias(f"k{i}") for i, seed in ((1, 0x2545F491), (2, 0x7F4A7C15))]


def salted(left: DataFrame, right: DataFrame, key: str, spread: str, n: int | None = None, least: int = 1_000_000) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row for each ``key`` and its rows in ``left`` as ``hits``.

    Rows of a key with very many of them are spread over tasks by ``spread``, and the other
    side's one row is repeated for each part.  Fewer than 10,000 keys can be so hot, as each
    has over a ten-thousandth of all rows (``n``, counted if not given); only these are broadcast.
    """
    n = (right.agg(F.sum("hits")).first()[0] or 0) if n is None else n
    limit = max(least, n // 10_000)
    if n <= limit or right.where(F.col("hits") > limit).isEmpty():
        return left.join(right.drop("hits"), key)
    hot = right.where(F.col("hits") > limit).select(key, F.ceil(F.col("hits") / limit).cast("int").alias("__parts"))
    part = F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.lit(5), spread), F.col("__parts")).cast("int"))
    a = left.join(F.broadcast(hot), key, "left").withColumn("__part", part).drop("__parts")
    parts = F.sequence(F.lit(0), F.when(F.col("hits") > limit, F.ceil(F.col("hits") / limit).cast("int") - 1).otherwise(0))
    return a.join(right.withColumn("__part", F.explode(parts)).drop("hits"), [key, "__part"]).drop("__part")


def held_out(id_col: str = "doc_id"):
    """True for the test fold: crc32 of the id as text leaves 1 when divided by 3; null ids are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without copying, and n + 1 offsets into them."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    bufs = col.buffers()
    if len(col) == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offs = np.frombuffer(bufs[1], kind, len(col) + 1 + col.offset)[col.offset :].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column into runs of whole rows: (first row, row after the last, bytes, offsets from 0).

    A run has about ``limit`` bytes; a single longer text is a run of its own.
    """
    data, offs = utf8(col)
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j
