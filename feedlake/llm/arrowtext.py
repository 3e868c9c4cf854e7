"""Helpers shared by the operators: Arrow text columns, vectorised word hashing, scratch tables.

Memory: texts are handled in runs of at most ``RUN_BYTES`` bytes (one longer text is a run of its own), so a
task holds one Arrow batch and a small multiple of the longest text.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from feedlake.session import scratch_path

RUN_BYTES = 1 << 18
U64 = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 truth values, true inside the given inclusive ranges."""
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo:hi + 1] = True
    return table


#: words are everything but the space and the bytes 9 to 13
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: words are digits, letters a-z (after lower-casing A-Z) and every non-ASCII byte
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


#: rows and bytes of an Arrow batch: what a Python worker holds at once
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20
BROADCAST_BYTES = "16m"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package also where only the driver's sys.path has it, and bound the batches
    that they get and what a join may broadcast (these jobs have many joins, and the driver holds each broadcast)."""
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", BROADCAST_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)


def give_back() -> None:
    """Return freed memory to the system where the C library can: a Python worker lives on after a task that needed
    much."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows written as a table in the shared checkpoint folder and read back: cuts the lineage."""
    path = scratch_path(df.sparkSession, "llm", name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a column, null as the empty text."""
    return [x or "" for x in column(batch, name).to_pylist()]


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the n + 1 offsets into them; null has no bytes."""
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_string())
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64)[arr.offset:arr.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, off


def runs(off: np.ndarray, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most ``limit`` bytes together, or one row."""
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p = np.full(n, BASE, np.uint64)
    q = np.full(n, BASE_INV, np.uint64)
    p[0] = q[0] = 1
    return np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(RUN_BYTES + 1, 1 << int(n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def word_spans(data: np.ndarray, off: np.ndarray, is_word: np.ndarray):
    """Words of the lower-cased bytes: (lowered bytes, starts, ends, first word of each row and the total)."""
    low = LOWER[data]
    mask = is_word[low]
    n = len(mask)
    edge = np.zeros(n + 1, bool)          # a row begins here
    edge[off[:-1]] = True
    edge[n] = True
    before = np.zeros(n, bool)
    before[1:] = mask[:-1]
    begin = mask & (~before | edge[:n])
    after = np.zeros(n, bool)
    after[:-1] = mask[1:]
    end = mask & (~after | edge[1:])
    starts = np.flatnonzero(begin)
    return low, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def span_hash(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever the span stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, q = powers(len(low) + 1)
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[low] * p[:len(low)], out=total[1:])
    h = (total[ends] - total[starts]) * q[starts]
    return mix(h + (ends - starts).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def hashed_words(arr: pa.Array, is_word: np.ndarray, limit: int = RUN_BYTES):
    """For each run of rows: (first row, end row, lowered bytes, starts, ends, word hashes, word offsets by row)."""
    data, off = text_bytes(arr)
    for i, j in runs(off, limit):
        part, rel = data[off[i]:off[j]], off[i:j + 1] - off[i]
        low, starts, ends, first = word_spans(part, rel, is_word)
        yield i, j, low, starts, ends, span_hash(low, starts, ends), first


def hash_word(word: str | bytes) -> int:
    """The hash that ``hashed_words`` gives a (lower-cased) word."""
    b = LOWER[np.frombuffer(word.encode() if isinstance(word, str) else word, np.uint8)]
    return int(span_hash(b, np.array([0]), np.array([len(b)]))[0])
