"""Fill-in-the-middle documents, cut with a learned index over the unit boundaries.

A unit is a run of ASCII letters or one other character; a text of n units has the
boundaries 0 to n, each at a byte offset. ``RankIndex`` replaces the offsets by a
piecewise-linear model of them: segments grow over the boundaries for as long as
one slope meets all of them within ``ERROR`` bytes (the cone of slopes that still do
narrows with every point; it is followed in vectorised steps). One signed byte a
boundary keeps the residual, so an offset is the segment's prediction, corrected
exactly: two cuts cost two look-ups, whatever the number of units.

The cuts are drawn from a digest of the seed and the id, so reruns agree and no row
depends on another: the whole operator is one pass without a shuffle. ``restore``
rebuilds the text from the output and the form alone, in Spark's own functions.

Defined cases: null and empty texts are plain and empty; a text that holds a
control string is plain, so that it stays readable; a null id draws as the word
``null``; rows that repeat are rows of their own; texts of any length are cut
whole, in pieces of bounded size; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Texts of 100 that stay plain, and of those cut that put the suffix first.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
#: Bytes a prediction may miss a boundary by: what one signed byte of residual holds.
ERROR = 120
#: Bytes whose boundaries are fitted at once; a segment does not reach across.
PIECE = 1 << 22
#: Boundaries looked at in a segment's first step; each further step doubles.
STEP = 1 << 10

_LETTER, _INNER = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[0x80:0xC0] = _INNER  # a character's further bytes


@dataclass(frozen=True)
class RankIndex:
    """Byte offsets of a text's boundaries, by rank."""

    ranks: np.ndarray
    """Rank of each segment's first boundary."""
    offsets: np.ndarray
    """Offset of each segment's first boundary."""
    slopes: np.ndarray
    residuals: np.ndarray
    """int8, one for each boundary."""

    @property
    def units(self) -> int:
        return len(self.residuals) - 1

    def offset(self, rank: int) -> int:
        """The exact offset of boundary ``rank``."""
        at = int(np.searchsorted(self.ranks, rank, side="right")) - 1
        guess = np.rint(self.slopes[at] * (rank - self.ranks[at]))
        return int(self.offsets[at]) + int(guess) + int(self.residuals[rank])


def boundaries(data: bytes):
    """Sorted offsets of the boundaries of UTF-8 ``data``, in arrays of bounded size."""
    raw = np.frombuffer(data, np.uint8)
    yield np.zeros(1, np.int64)
    for low in range(0, len(raw), PIECE):
        kind = _KIND[raw[low : low + PIECE + 1]]
        if low + PIECE >= len(raw):
            kind = np.append(kind, np.uint8(0))  # the end of the text ends a unit
        joined = (kind[1:] == _INNER) | ((kind[1:] == _LETTER) & (kind[:-1] == _LETTER))
        yield np.flatnonzero(~joined) + (low + 1)


def fit(ends: np.ndarray) -> tuple[list[int], list[float]]:
    """Starts (positions in ``ends``) and slopes of segments that miss no offset by more than ``ERROR``."""
    starts, slopes, start = [], [], 0
    while start < len(ends):
        least, most, at, step = -np.inf, np.inf, start + 1, STEP
        while at < len(ends):
            rise = (ends[at : at + step] - ends[start]).astype(np.float64)
            run = np.arange(at - start, at - start + len(rise), dtype=np.float64)
            # Rounding a prediction costs half a byte more.
            lows = np.maximum(np.maximum.accumulate((rise - ERROR + 1) / run), least)
            highs = np.minimum(np.minimum.accumulate((rise + ERROR - 1) / run), most)
            fits = len(rise) if lows[-1] <= highs[-1] else int(np.argmax(lows > highs))
            if fits:
                least, most = lows[fits - 1], highs[fits - 1]
            at += fits
            if fits < len(rise):
                break
            step *= 2
        starts.append(start)
        slopes.append((least + most) / 2 if at > start + 1 else 0.0)
        start = at
    return starts, slopes


def index(data: bytes) -> RankIndex:
    """The learned index of a text's boundaries."""
    ranks, offsets, slopes, residuals, before = [], [], [], [], 0
    for ends in boundaries(data):
        if not len(ends):
            continue
        starts, rises = fit(ends)
        first = np.array(starts)
        own = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ends))))
        guesses = np.rint(np.array(rises)[own] * (np.arange(len(ends)) - first[own])).astype(np.int64)
        residuals.append((ends - ends[first][own] - guesses).astype(np.int8))
        ranks.append(first + before)
        offsets.append(ends[first])
        slopes.append(np.array(rises))
        before += len(ends)
    return RankIndex(*(np.concatenate(x) for x in (ranks, offsets, slopes, residuals)))


def _characters(data: bytes) -> int:
    return len(data) - int(np.count_nonzero(_KIND[np.frombuffer(data, np.uint8)] == _INNER))


_CONTROL = tuple(c.encode() for c in (PREFIX, SUFFIX, MIDDLE))


def arrange(data: bytes, draw: str, plain_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, characters of prefix and middle, and the output, for the hexadecimal ``draw``."""
    h1, h2, h3, h4 = (int(draw[i : i + 8], 16) for i in range(0, 32, 8))
    found = index(data)
    n = found.units
    if not data or h3 % 100 >= 100 - plain_percent or any(c in data for c in _CONTROL):
        return n, "plain", None, None, data
    low, high = (found.offset(rank) for rank in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = data[:low], data[low:high], data[high:]
    p, s, m = _CONTROL
    spm = h4 % 100 < spm_percent
    output = b"".join([s, suffix, p, prefix, m, middle] if spm else [p, prefix, s, suffix, m, middle])
    return n, "spm" if spm else "psm", _characters(prefix), _characters(middle), output


_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.int64()]


def transform(docs: DataFrame, seed: int = 1, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row."""
    if not (0 <= plain_percent <= 100 and 0 <= spm_percent <= 100):
        raise ValueError("percentages lie between 0 and 100")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            rows = [arrange(t or b"", d, plain_percent, spm_percent) for t, d in zip(texts, batch.column("draw").to_pylist(), strict=True)]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)]
            output = pa.array([r[4] for r in rows], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns, output], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
            )

    return docs.select("doc_id", "text", drawn.alias("draw")).mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. No control string stands inside a part, so the first of each is the real one."""
    first, second = F.when(form == "spm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX)), F.lit(MIDDLE)
    a, b = F.position(first, output), F.position(second, output)
    width = len(PREFIX)
    one = F.substr(output, F.lit(width + 1), a - F.lit(width + 1))
    two = F.substr(output, a + F.lit(width), b - a - F.lit(width))
    middle = F.substr(output, b + F.lit(width))
    return F.when(form == "plain", output).when(form == "spm", F.concat(two, middle, one)).otherwise(F.concat(one, middle, two))


def restore(transformed: DataFrame) -> DataFrame:
    """``transformed`` with the column ``text``, rebuilt from ``output`` and ``form``."""
    return transformed.withColumn("text", restored(F.col("output"), F.col("form")))
