"""What the training-data operators share: reading tables, the shared work folder, byte-level tokenisers.

Executors may be lost at any time, so whatever has to survive is written as Parquet into the folder named by
``spark.checkpoint.dir`` (shared by driver and executors) and read back from there.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from loam.sources.store import remove, stored, work_dir, written

__all__ = ["remove", "stored", "work_dir", "written"]

#: ASCII white space, the separators of "[^\x20\x09-\x0D]+". ``bytes.split()`` splits on exactly these.
SPACES = b" \t\n\x0b\x0c\r"

#: For bytes.translate: lower-cases A-Z only.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

#: For bytes.translate: lower-cases A-Z, and turns what "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+" excludes into spaces.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


#: Rows that Spark puts into one Arrow batch; its default of 10,000 documents is tens of MB for each task and each direction.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Makes the session's Arrow batches small, unless they were set to something else."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(name: str, columns: list[str]) -> str:
    """A column name that is not among ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def held(table: DataFrame, rows: int = 100_000) -> DataFrame:
    """``table`` as one side of a join: broadcast if it has at most so many rows, which is checked here, else merged."""
    from pyspark.sql import functions as F

    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table.hint("merge")


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A string or binary Arrow array as (bytes, offsets, is_null) without decoding; nulls have no bytes."""
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, bool)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    nulls = np.asarray(column.is_null())
    if nulls.any() and (offsets[1:] != offsets[:-1])[nulls].any():  # a null slot may hold stale bytes
        return raw_bytes(column.fill_null(b""))[:2] + (nulls,)
    return data, offsets, nulls


def give_back() -> None:
    """Returns freed memory to the system: workers wait for their next task, and several wait beside each executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_chunks(
    batches: Iterator[pa.RecordBatch], most_bytes: int, column: str = "text"
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts record batches at rows so that each piece has at most ``most_bytes`` of text, or one row.

    Yields (the rows, their bytes, offsets from 0). Memory per step is then bounded by ``most_bytes`` or the longest text.
    """
    try:
        for batch in batches:
            data, offsets, _ = raw_bytes(batch.column(column))
            first, n = 0, batch.num_rows
            while first < n:
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1)
                last = min(last, n)
                lo, hi = int(offsets[first]), int(offsets[last])
                yield batch.slice(first, last - first), data[lo:hi], offsets[first : last + 1] - lo
                first = last
    finally:
        give_back()


class Hashes(dict):
    """Word bytes -> XXH64 as an unsigned 64-bit integer, remembered unless long; emptied when it gets large."""

    MOST, LONG = 150_000, 64

    def __missing__(self, word: bytes) -> int:
        if len(word) > self.LONG:
            return xxhash.xxh64_intdigest(word, 42)
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, on uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; short lists are remembered."""
    known = _POWERS.get(base)
    if known is not None and n <= len(known):
        return known[:n]
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    if n <= 1 << 20:
        _POWERS[base] = out
    return out[:n]


#: One memory of word hashes for all operators in a worker.
word_hashes = Hashes()
