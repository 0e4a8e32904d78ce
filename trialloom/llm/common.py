"""Expressions and small helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


#: Rows in an Arrow batch of whole texts; Spark's default suits narrow rows.
TEXT_ROWS, _BATCH_ROWS = "1000", "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, and keep batches of texts small."""
    if spark.conf.get(_BATCH_ROWS) == "10000":
        spark.conf.set(_BATCH_ROWS, TEXT_ROWS)
    context = spark.sparkContext
    if not getattr(context, "_trialloom_shipped", False):
        package = Path(__file__).resolve().parent.parent
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name))
        context._trialloom_shipped = True


def tidy(run: Callable) -> Callable:
    """``run`` over the batches of a task, whose memory then goes back to the system.

    Python workers outlive their tasks, and what one task took would stand beside the
    next one's in the memory of the executor.
    """

    def tidied(batches) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            hand_back()

    return tidied


def hand_back() -> None:
    """Give free memory of this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def words(text: Column) -> Column:
    """The words of a text, in order; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def hash_words(data: bytes) -> np.ndarray:
    """One 64-bit hash for each white-space separated word of ``data``, vectorised.

    Each word is a polynomial in an odd base modulo 2**64, read off prefix sums
    over the whole buffer, then mixed; the word's length enters as well.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    n = len(raw)
    if not n:
        return np.empty(0, np.uint64)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.uint64)
    return hash_spans(raw, start, end)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64)))) for b in (_BASE, _INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


def hash_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end) of ``raw``, in blocks of bounded length."""
    out = np.empty(len(start), np.uint64)
    block = 1 << 22
    at = 0
    while at < len(start):
        low = int(start[at])
        stop = max(int(np.searchsorted(end, low + block, side="right")), at + 1)
        high = int(end[stop - 1])
        power, inverse = _power_tables(high - low)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE_VALUES[raw[low:high]] * power)))
        s, e = start[at:stop] - low, end[at:stop] - low
        out[at:stop] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = stop
    return out


def shingles(word_hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle."""
    n = len(word_hashes)
    if not n:
        return np.empty(0, np.uint64)
    size = min(width, n)
    acc = np.full(n - size + 1, np.uint64(size))
    for i in range(size):
        acc = mix(acc * _BASE + word_hashes[i : n - size + 1 + i])
    return np.unique(acc)


def digest(values: np.ndarray) -> bytes:
    """A 128-bit digest of an array's content."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()
