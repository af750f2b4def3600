"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of text, handed to numpy at once inside a task; a longer text is a slice of its own.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 20
#: Rows and bytes of one Arrow batch of whole texts.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session has none (tests, a laptop) a temporary folder is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base:
        base = tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(base)
    return base


#: The folder of what is written on the way, where a caller has set one.
_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, or the scratch folder in it, that no other call returns."""
    return f"{(_SCRATCH.get() or shared_dir(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written on the way inside goes to a folder that is deleted at the end.

    For callers that write their result elsewhere before the end: frames made
    inside cannot be read after it.
    """
    path = new_path(spark, "scratch")
    mark = _SCRATCH.set(path)
    try:
        yield
    finally:
        _SCRATCH.reset(mark)
        discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it (cuts lineage)."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], text: str | None = None, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into parts of at most ``rows`` rows and ``size`` bytes of the column ``text``, one row at least."""
    for batch in batches:
        upto = np.zeros(batch.num_rows, dtype=np.int64) if text is None else np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = upto[at - 1] if at else 0
            to = min(max(at + 1, int(np.searchsorted(upto, done + size, side="right"))), at + rows)
            yield batch.slice(at, to - at)
            at = to


def keep_apart(docs: DataFrame, keep: tuple[str, ...], new: tuple[str, ...], text_col: str) -> DataFrame:
    """The ``keep`` columns and the text as ``__text``; one that shares its name with a ``new`` column becomes ``kept_<name>``."""
    return docs.select(*[F.col(f"`{c}`").alias(f"kept_{c}" if c in new else c) for c in keep], F.col(f"`{text_col}`").alias("__text"))


def salted_join(rows: DataFrame, other: DataFrame, on: str, spread: Column, how: str = "left", salts: int = 8) -> DataFrame:
    """Join on a column that may be hot in ``rows`` and is unique in ``other``: rows of a key are dealt over ``salts`` tasks, ``other`` is repeated."""
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = other.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [on, "__salt"], how).drop("__salt")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (xor-shift-multiply), on uint64 arrays."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    space = np.zeros(256, dtype=bool)
    space[[32, *range(9, 14)]] = True
    return lower, space


LOWER, SPACE = _byte_tables()
#: Powers of an odd multiplier, for the polynomial hash of a word's bytes.
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    while len(_POWERS) < n:
        step = np.uint64(pow(_BASE, len(_POWERS), 1 << 64))
        _POWERS = np.concatenate([_POWERS, _POWERS * step])
    return _POWERS


def word_hashes(text: bytes, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text, in order."""
    raw = np.frombuffer(text, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], SPACE[raw], [True]]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    size = ends - starts
    inside = ~SPACE[raw]
    chars = (LOWER[raw] if lower else raw)[inside].astype(np.uint64) + np.uint64(1)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(len(chars)) - np.repeat(first, size)
    sums = np.add.reduceat(chars * _powers(int(size.max()))[place], first)
    return mix64(sums + mix64(size.astype(np.uint64)))


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bound the Arrow batches of whole texts by rows and bytes, so that long texts fit a worker's memory.

    Spark reads these settings when the plan runs, so they stay lowered in the session.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(re.match(r"-?\d+", spark.conf.get(key, "2147483646"))[0])
        if not 0 < now <= most:
            spark.conf.set(key, str(most))
