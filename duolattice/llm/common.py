"""What the operators of this subpackage share: where shared files go, table access, Arrow and word kernels."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import scratch_path, shared_dir  # noqa: F401  for the operators

#: Bytes of text that a kernel takes at a time, so that memory doesn't follow the size of Arrow batches.
CHUNK_BYTES = 8 << 20


#: What modules remember between the tasks of a worker process (name to dict).
MEMORIES: dict[str, dict] = {}


def forget_others(*mine: str) -> None:
    """Empties the memories of other operators when a task begins in a worker that has run them before."""
    held = [m for name, m in MEMORIES.items() if name not in mine and m]
    if held:
        for m in held:
            m.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries give memory back by themselves
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def materialized(df: DataFrame, name: str, made: list[str] | None = None) -> DataFrame:
    """df, written to the shared folder and read again: it cuts the lineage and outlives lost executors. made takes its path."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, made: list[str]) -> None:
    """Deletes written tables that nothing reads any more."""
    for path in made:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, or wanted with underscores before it until no column of df has it (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    """The Arrow type of a column, as kernels see it."""
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def labelled_rows(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column | None, most: int, id_col: str, text_col: str) -> DataFrame:
    """id, text and y (0 or 1) of at most `most` documents, chosen by a hash of the id among those with a usable label.

    Labels that are null or others than 0 and 1, labels without an id, and ids whose labels disagree are not usable. An id that
    stands on several document rows is taken once, with the text of the smallest hash."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = (known if usable is None else known.filter(usable)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("other"))
    known = known.filter(F.col("y") == F.col("other")).select("id", F.col("y").cast("int").alias("y"))
    # Of a row's hash the upper bits choose about twice as many as wanted, so that few are put in order.
    n, by = known.count(), F.xxhash64("id")
    if n > most:
        near = known.filter(F.pmod(F.shiftright(by, 20), F.lit(1 << 20)) < F.lit(min(1 << 20, (2 * most + 1000) * (1 << 20) // n)))
        known = near.orderBy(by, "id").limit(most)
    # At most `most` labels: they can go to every task.
    met = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    return met.groupBy("id").agg(F.min("y").alias("y"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("id", F.col("t.text").alias("text"), "y")


def row_key(df: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """Three columns, never null, that tell rows apart and order them by id, nulls last: whether the id is null, the id, a hash of the text."""
    kind = df.schema[id_col].dataType
    if not isinstance(kind, (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise TypeError(f"ids must be numbers, strings or dates, not {kind.simpleString()}")
    none = F.lit("") if isinstance(kind, T.StringType) else F.lit(0).cast(kind) if isinstance(kind, T.NumericType) else F.lit("1970-01-01").cast(kind)
    return [F.col(id_col).isNull(), F.coalesce(F.col(id_col), none), F.xxhash64(F.col(text_col))]


def integral(df: DataFrame, column: str) -> Column:
    """An id column as a long; ids of other types than whole numbers are an error."""
    if not isinstance(df.schema[column].dataType, T.IntegralType):
        raise TypeError(f"{column} must hold whole numbers, not {df.schema[column].dataType.simpleString()}")
    return F.col(column).cast("long")


def chunks(batches: Iterator[pa.RecordBatch], text_at: int = 1, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each piece has about limit bytes of text or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes.astype(np.int64) + 1) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array with a zero byte after each, and where each text starts there (n + 1 offsets). Null: empty."""
    texts = [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]
    flat = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return flat, starts


def _word_table() -> np.ndarray:
    """Byte to its lower-case form if it belongs to words (a digit, a letter, or part of a non-ASCII character), else 0."""
    t = np.zeros(256, np.uint8)
    for b in range(256):
        c = b + 32 if 65 <= b <= 90 else b
        if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128:
            t[b] = c
    return t


WORD_TABLE = _word_table()


def word_spans(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes of flat with 0 between words; first and past-the-end positions of the words."""
    low = WORD_TABLE[flat]
    edge = np.diff((low != 0).view(np.int8), prepend=0, append=0)
    return low, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        np.cumprod(np.full(n - 1, 0x9E3779B97F4A7C15 | 1, np.uint64), out=out[1:])
    return out


def word_hashes(low: np.ndarray, begin: np.ndarray, end: np.ndarray, at_once: int = 1 << 16) -> np.ndarray:
    """A 64-bit hash of each word: its bytes as digits in an odd base, mixed. Equal words have equal hashes; callers verify matches by bytes.

    Words are taken some at a time, as every byte needs several numbers."""
    out = np.zeros(len(begin), np.uint64)
    powers = _powers(int((end - begin).max())) if len(begin) else None
    for k in range(0, len(begin), at_once):
        b, length = begin[k : k + at_once], (end - begin)[k : k + at_once]
        first = np.cumsum(length) - length
        inside = np.arange(int(length.sum())) - np.repeat(first, length)
        digits = low[inside + np.repeat(b, length)].astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            h = np.add.reduceat(digits * powers[inside], first)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            h += length.astype(np.uint64)
        out[k : k + at_once] = h
    return out
