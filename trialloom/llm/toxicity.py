"""Toxicity: cumulative-link ordinal regression over sparse word features.

P(grade > k) = sigmoid(w . x - theta_k): one weight vector serves all severity
grades, and only the ordered thresholds tell them apart. The expected severity is
the sum of these probabilities over k.

Labels say toxic or not; grades above 0 are the thirds of the toxic rows by how
much they hold of what speaks for the label (log odds in the training sample).
Features are hashed lower-case words and their beginnings, log(1 + count), brought to equal spread. An
L1 penalty, by accelerated proximal gradient, chooses the features; those chosen
are fitted again without it, so the model is small and its weights are not
shrunk. It learns in the driver from a bounded sample of labelled rows (at most
``SAMPLE`` of each label, in the order of a hash of the id), weighted to the
labels' shares. Scoring is one pass over whole texts without a shuffle.

Defined cases: null and empty texts have no features and get the lowest severity
the thresholds allow; texts of any length are read whole; a null label or id
teaches nothing, contradicting labels of one id count as toxic if most say so;
with labels of one kind only, or none, every severity is 0; repeated rows get
equal results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 4_000
#: Rows whose entries are laid out side by side while features are chosen.
ROWS_AT_ONCE = 256
BITS = 20
GRADES = 3
MIN_DOCUMENTS = 4
STEPS, PENALTY, REFIT_STEPS, RIDGE = 200, 0.03, 3000, 1e-5
#: Besides itself a word gives its beginnings of these lengths.
BEGINNINGS = (4, 5, 7)
_WORDS = re.compile(r"[^\W_]+")
_SIZE = 1 << BITS


class _Hashed(dict):
    """Feature numbers of a word and its beginnings; forgotten all at once when they are many."""

    def __missing__(self, word: str) -> list[int]:
        if len(self) > 300_000:
            self.clear()
        parts = {word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n)}
        self[word] = at = [xxhash.xxh3_64_intdigest(p.encode()) & (_SIZE - 1) for p in sorted(parts)]
        return at


def features(text: str, known: _Hashed) -> tuple[np.ndarray, np.ndarray]:
    """The text's feature numbers and their counts."""
    found = np.fromiter(chain.from_iterable(map(known.__getitem__, _WORDS.findall(text.lower()))), np.int64)
    return np.unique(found, return_counts=True)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, weight: np.ndarray) -> dict:
    """Weights (sparse) and thresholds that minimise the weighted ordinal log loss."""
    weight = weight / weight.sum()
    reached = [(grade > k).astype(np.float64) for k in range(GRADES)]

    def row_slope(z, theta):
        # Grade probabilities are differences of the cumulative ones.
        upper = np.stack([np.ones(len(rows)), *(_sigmoid(z - t) for t in theta), np.zeros(len(rows))])
        p = np.maximum(upper[grade, np.arange(len(rows))] - upper[grade + 1, np.arange(len(rows))], 1e-12)
        slope = upper * (1 - upper)
        here, above = slope[grade, np.arange(len(rows))], slope[grade + 1, np.arange(len(rows))]
        dz = -weight * (here - above) / p
        dtheta = np.array([(weight * ((grade == k + 1) * here - (grade == k) * above) / p).sum() for k in range(GRADES)])
        return dz, dtheta

    def loss_gradient(w, theta):
        z = np.bincount(of, values * w[at], minlength=len(rows)) if width else np.zeros(len(rows))
        dz, dtheta = row_slope(z, theta)
        return (np.bincount(at, values * dz[of], minlength=width) if width else np.zeros(0)), dtheta

    share = np.array([np.average(r, weights=weight) for r in reached]).clip(1e-4, 1 - 1e-4)
    theta = -np.log(share / (1 - share)) + np.arange(GRADES) * 1e-3

    def descend(w, theta, penalty, ridge, steps):
        # A safe step: a row's loss bends at most by a quarter, twice for two thresholds,
        # along the direction in which the features spread most (found by power iteration).
        v, most = np.ones(width), 1e-6
        for _ in range(20):
            v = np.bincount(at, values * (weight * np.bincount(of, values * v[at], minlength=len(rows)))[of], minlength=width)
            most = max(float(np.linalg.norm(v)), 1e-6)
            v /= most
        step = 1.0 / (0.6 * most + 1e-6)
        ahead, t = (w, theta), 1.0
        for _ in range(steps):
            gw, gt = loss_gradient(*ahead)
            new_w = ahead[0] - step * (gw + ridge * ahead[0])
            new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * penalty, 0)
            new_theta = np.maximum.accumulate(ahead[1] - 2.0 * gt + np.arange(GRADES) * 1e-6)
            new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
            m = (t - 1) / new_t
            ahead = (new_w + m * (new_w - w), np.maximum.accumulate(new_theta + m * (new_theta - theta)))
            w, theta, t = new_w, new_theta, new_t
        return w, theta

    def entries(part):
        counts = np.concatenate([rows[i][1] for i in part])
        return np.concatenate([rows[i][0] for i in part]), np.log1p(counts.astype(np.float64)), np.repeat(part, [len(rows[i][0]) for i in part])

    # What the start's slope does not call for stays out: sums over all entries, a few rows at a time.
    at, values, of, width = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), 0
    start = row_slope(np.zeros(len(rows)), theta)[0]
    parts = np.array_split(np.arange(len(rows), dtype=np.int32), -(-len(rows) // ROWS_AT_ONCE))
    seen, total, square, slope = (np.zeros(_SIZE) for _ in range(4))
    for part in parts:
        x, v, i = entries(part)
        for sums, what in ((seen, None), (total, weight[i] * v), (square, weight[i] * v * v), (slope, v * start[i])):
            sums += np.bincount(x, what, minlength=_SIZE)
    spread = np.sqrt(np.maximum(square - total * total, 1e-9))
    names_kept = np.flatnonzero((seen >= MIN_DOCUMENTS) & (np.abs(slope / spread) > PENALTY))
    place = np.full(_SIZE, -1, np.int32)
    place[names_kept] = np.arange(len(names_kept))
    kept = []
    for part in parts:
        x, v, i = entries(part)
        held = place[x] >= 0
        kept.append((place[x[held]], v[held] / spread[x[held]], i[held]))
    at, values, of = (np.concatenate(k) for k in zip(*kept, strict=True))
    width, spread = len(names_kept), spread[names_kept]

    def narrow(chosen):
        nonlocal at, values, of, width, spread, names_kept
        new = np.full(width, -1)
        new[chosen] = np.arange(len(chosen))
        held = new[at] >= 0
        at, values, of, width = new[at[held]], values[held], of[held], len(chosen)
        spread, names_kept = spread[chosen], names_kept[chosen]

    # Then what the penalty leaves at zero.
    w, theta = descend(np.zeros(width), theta, PENALTY, 0.0, STEPS)
    used = np.flatnonzero(w)
    narrow(used)
    w, theta = descend(w[used], theta, 0.0, RIDGE, REFIT_STEPS)
    return {"features": names_kept.astype(np.int64), "weights": w / spread, "theta": theta}


def _grades(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> np.ndarray:
    """0 for rows that are not toxic, else the third by how many features speak for toxic, each by its log(1 + count)."""

    def number(pick):
        sums = np.zeros(_SIZE, np.int64)
        for i in np.flatnonzero(pick):
            sums[rows[i][0]] += 1  # a row's features are distinct
        return sums

    with_, without = number(toxic == 1), number(toxic == 0)
    odds = np.log((with_ + 0.5) / ((toxic == 1).sum() + 1)) - np.log((without + 0.5) / ((toxic == 0).sum() + 1))
    telling = (odds > np.log(8)) & (with_ >= MIN_DOCUMENTS)
    much = np.array([np.log1p(counts[telling[at]]).sum() for at, counts in rows])
    cuts = np.quantile(much[toxic == 1], [1 / 3, 2 / 3])
    return np.where(toxic == 1, 1 + np.searchsorted(cuts, much, side="right"), 0).astype(np.int64).clip(0, GRADES)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> dict | None:
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg((F.avg(label) > 0.5).cast("int").alias("_y"))
    totals = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    if len(totals) < 2:
        return None
    some = [known.filter(F.col("_y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    rows = [(r.doc_id, r._y) for part in some for r in part.collect()]
    chosen = docs.sparkSession.createDataFrame(rows, "doc_id long, _y int")

    def describe(batches):
        known_words = _Hashed()
        for batch in batches:
            found = [features(t.as_py() or "", known_words) for t in batch.column("text")]
            columns = [pa.array([f[i].astype("<i4").tobytes() for f in found], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_y"), *columns], names=["doc_id", "_y", "at", "counts"])

    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "_y", "text")
    found = joined.mapInArrow(describe, "doc_id long, _y int, at binary, counts binary").dropDuplicates(["_y", "at", "counts"])
    found = sorted((r.doc_id, r._y, bytes(r["at"]), bytes(r.counts)) for r in found.toLocalIterator())
    toxic = np.array([r[1] for r in found], np.int64)
    if len(set(toxic.tolist())) < 2:
        return None
    bags = [(np.frombuffer(r[2], "<i4"), np.frombuffer(r[3], "<i4")) for r in found]
    share = np.array([totals[k] / max((toxic == k).sum(), 1) for k in (0, 1)], np.float64)
    return fit(bags, _grades(bags, toxic), share[toxic])


def assess(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, severity (expected grade), grade (most thresholds passed) and is_toxic (grade above 0)."""
    if model is None:
        model = {"features": np.empty(0, np.int64), "weights": np.empty(0), "theta": np.full(GRADES, np.inf)}

    def run(batches):
        weight = np.zeros(_SIZE)
        weight[model["features"]] = model["weights"]
        known = _Hashed()
        for batch in batches:
            z = np.array([_total(weight, *features(t.as_py() or "", known)) for t in batch.column("text")])
            p = 1 / (1 + np.exp(-np.clip(z[:, None] - model["theta"], -700, 700)))
            p[:, np.isinf(model["theta"])] = 0.0
            grade = (p > 0.5).sum(1)
            columns = [pa.array(p.sum(1)), pa.array(grade.astype(np.int32)), pa.array(grade > 0)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "severity", "grade", "is_toxic"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, severity double, grade int, is_toxic boolean")


def _total(weight: np.ndarray, at: np.ndarray, counts: np.ndarray) -> float:
    return float((weight[at] * np.log1p(counts)).sum())
