"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of 40 words that together are its whole text,
however long it is. Each passage is described by its character classes, word shapes and repetitions and
encoded by a small layer. Gated attention weights the encoded passages, and their
weighted mean is scored. The label belongs to the document; the attention learns
from it which passages decide. Scoring streams the softmax over blocks of passages
(running maximum, running weighted sum), so a long text needs no larger passages.

The model is fitted in the driver on a bounded sample of labelled rows (at most
``SAMPLE`` of each label, in the order of a hash of the id; of a sampled text at most
``FIT_PASSAGES`` passages, evenly spaced) and is a few hundred numbers. Its loss is weighted to the shares of the labels among all rows it may
learn from, so that scores are probabilities. Scoring is one pass over the texts
without a shuffle.

Defined cases: null and empty texts are one empty passage and get a score as
well; a text of any length is read whole; an id with labels that contradict each
other by halves, a null label or a null id teaches nothing; with labels of one
kind only, or none, every score is 0.5; repeated rows get equal scores, and an id
with several texts teaches by one of them (the first by its features); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.llm.common import hash_spans, mix, tidy

SAMPLE = 1_200
PASSAGE_WORDS, FIT_PASSAGES = 40, 64
BLOCK = 16_384
ENCODED, ATTENTION = 16, 8
STEPS, RATE, SHRINK = 200, 0.04, 1e-4
THRESHOLD = 0.7

_CLASSES = 8


def _class_table() -> np.ndarray:
    table = np.full(256, 7, np.uint8)  # bytes of characters outside ASCII
    table[:128] = 6
    for number, members in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b".,;:?'\"()-", b" \t\n\v\f\r")):
        table[list(members)] = number
    return table


_TABLE = _class_table()


def passage_features(text: str) -> np.ndarray:
    """One row of features for each passage."""
    raw = np.frombuffer(text.encode(), np.uint8)
    kind = _TABLE[raw]
    inside = kind != 5
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(start)
    if not n:
        return np.zeros((1, _CLASSES + 12), np.float32)
    of = np.arange(n) // PASSAGE_WORDS
    count = int(of[-1]) + 1
    size = np.bincount(of, minlength=count).astype(np.float64)
    mean = lambda x: np.bincount(of, weights=x, minlength=count) / size
    byte_of = np.repeat(of, np.diff(np.append(start, len(raw)))) if len(raw) > start[0] else of[:0]
    classes = np.bincount(byte_of * _CLASSES + kind[start[0] :], minlength=count * _CLASSES).reshape(count, _CLASSES)
    length = (end - start).astype(np.float64)
    hashes = hash_spans(raw, start, end)
    same = np.concatenate(([False], hashes[1:] == hashes[:-1]))
    novel = lambda h: _first(h)
    inner = _first(mix(hashes + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    triple = np.ones(n, bool)
    if n >= 3:
        triple[2:] = novel(mix(mix(hashes[:-2] * np.uint64(3) + hashes[1:-1]) + hashes[2:] * np.uint64(7)))
    upper = np.concatenate(([0], np.cumsum(kind == 1)))
    symbol = np.concatenate(([0], np.cumsum((kind == 3) | (raw == 33))))
    capital = kind[start] == 1
    shouted = (upper[end] - upper[start]) * 2 > length
    features = [
        *(classes / np.maximum(classes.sum(1, keepdims=True), 1)).T,
        np.log1p(mean(length)), mean(length == 1), mean(symbol[end] > symbol[start]), mean(capital), mean(shouted & (length > 1)), mean(same),
        mean(inner), mean(triple), mean(kind[end - 1] == 4), mean(kind[end - 1] == 3), np.log1p(size) / 4, np.full(count, np.log1p(n) / 8),
    ]
    return np.stack(features, 1).astype(np.float32)


def _first(values: np.ndarray) -> np.ndarray:
    """True where a value stands for the first time."""
    found = np.zeros(len(values), bool)
    found[np.unique(values, return_index=True)[1]] = True
    return found


def spaced(bag: np.ndarray) -> np.ndarray:
    """At most ``FIT_PASSAGES`` passages of a sampled text, evenly spaced."""
    n = len(bag)
    return bag if n <= FIT_PASSAGES else bag[np.arange(FIT_PASSAGES) * n // FIT_PASSAGES]


def forward(model: dict, x: np.ndarray, starts: np.ndarray) -> tuple:
    """Scores of bags whose passages are rows of ``x`` from ``starts`` on, and what the gradient needs."""
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
    h = np.tanh(x @ model["e"] + model["eb"])
    t, g = np.tanh(h @ model["v"]), 1 / (1 + np.exp(-(h @ model["u"])))
    a = (t * g) @ model["w"]
    a = np.exp(a - np.maximum.reduceat(a, starts)[of])
    a /= np.add.reduceat(a, starts)[of]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    score = 1 / (1 + np.exp(-np.clip(z @ model["c"] + model["cb"], -30, 30)))
    return score, (of, h, t, g, a, z)


def _gradient(model: dict, x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    score, (of, h, t, g, a, z) = forward(model, x, starts)
    d = (score - y) * weight
    dz = d[:, None] * model["c"]
    da = (dz[of] * h).sum(1)
    ds = a * (da - np.add.reduceat(a * da, starts)[of])
    dt, dg = ds[:, None] * model["w"] * g * (1 - t * t), ds[:, None] * model["w"] * t * g * (1 - g)
    dh = (a[:, None] * dz[of] + dt @ model["v"].T + dg @ model["u"].T) * (1 - h * h)
    return {"e": x.T @ dh, "eb": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "w": (t * g).T @ ds, "c": z.T @ d, "cb": d.sum()}


def fit(bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict:
    """Adam on the weighted log loss, over all bags in each step."""
    x, starts = np.concatenate(bags).astype(np.float32), np.cumsum([0, *map(len, bags[:-1])])
    model = {"mean": x.mean(0), "scale": x.std(0) + 1e-3}
    x = np.clip((x - model["mean"]) / model["scale"], -8, 8)
    draw = np.random.default_rng(6)
    shapes = {"e": (x.shape[1], ENCODED), "eb": ENCODED, "v": (ENCODED, ATTENTION), "u": (ENCODED, ATTENTION), "w": ATTENTION, "c": ENCODED, "cb": ()}
    model |= {k: draw.normal(0, 0.3, s).astype(np.float32) if s else np.float32(0) for k, s in shapes.items()}
    first, second = ({k: np.zeros(s, np.float32) for k, s in shapes.items()} for _ in range(2))
    y, weight = y.astype(np.float32), (weight / weight.sum()).astype(np.float32)
    for step in range(1, STEPS + 1):
        rate = RATE * (1 - step / (STEPS + 1))
        for k, d in _gradient(model, x, starts, y, weight).items():
            d = d + SHRINK * model[k]
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.999 * second[k] + 0.001 * d * d
            model[k] = model[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _score(model: dict, bag: np.ndarray) -> float:
    top, total, z = -np.inf, 0.0, np.zeros(ENCODED)
    for at in range(0, len(bag), BLOCK):
        h = np.tanh(np.clip((bag[at : at + BLOCK] - model["mean"]) / model["scale"], -8, 8) @ model["e"] + model["eb"])
        a = (np.tanh(h @ model["v"]) / (1 + np.exp(-(h @ model["u"])))) @ model["w"]
        high = max(top, a.max())
        carried, share = np.exp(top - high), np.exp(a - high)
        top, total, z = high, total * carried + share.sum(), z * carried + share @ h
    return 1 / (1 + np.exp(-np.clip(z / total @ model["c"] + model["cb"], -30, 30)))


def predict(model: dict | None, bags: list[np.ndarray]) -> np.ndarray:
    """Scores of bags of any size: the attention's softmax is carried from block to block.

    Each bag is computed by itself, so equal bags get equal scores to the last bit.
    """
    return np.array([0.5 if model is None else _score(model, bag) for bag in bags], np.float64)


def held_out(doc_id: Column) -> Column:
    """Rows that teach nothing: a quarter of all ids, by their checksum."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> dict | None:
    """The model, fitted on a bounded sample of the labelled rows that are not held out."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg(label) - 0.5).alias("_y")).filter("_y <> 0").select("doc_id", (F.col("_y") > 0).cast("int").alias("_y"))
    totals = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    if len(totals) < 2:
        return None
    some = [known.filter(F.col("_y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    rows = [(r.doc_id, r._y) for part in some for r in part.collect()]
    chosen = docs.sparkSession.createDataFrame(rows, "doc_id long, _y int")

    def describe(batches):
        for batch in batches:
            found = [spaced(passage_features(t.as_py() or "")).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_y"), pa.array(found, pa.binary())], names=["doc_id", "_y", "bag"])

    bags = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "_y", "text").mapInArrow(tidy(describe), "doc_id long, _y int, bag binary")
    # One row for each id, so that an id which many rows repeat does not fill the driver.
    bags = bags.groupBy("doc_id", "_y").agg(F.min("bag").alias("bag"))
    found = sorted((r.doc_id, r._y, bytes(r.bag)) for r in bags.collect())
    y = np.array([r[1] for r in found], np.float64)
    if len(set(y)) < 2:
        return None
    width = _CLASSES + 12
    share = np.array([totals[0] / max((y == 0).sum(), 1), totals[1] / max((y == 1).sum(), 1)])
    return fit([np.frombuffer(r[2], np.float32).reshape(-1, width) for r in found], y, share[y.astype(int)])


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs`` with ``score``: the probability of label 1."""

    def run(batches):
        for batch in batches:
            bags = [passage_features(t.as_py() or "") for t in batch.column("text")]
            at = [i for i, name in enumerate(batch.schema.names) if name != "score"]
            columns = [batch.column(i) for i in at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(predict(model, bags), pa.float64())], names=[*(batch.schema.names[i] for i in at), "score"])

    kept = docs.drop("score")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(tidy(run), f"{fields}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of ``THRESHOLD`` on)."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
