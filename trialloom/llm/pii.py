"""Personal data: base patterns, and information-theoretic sanitisation of what reveals them.

The values that the base patterns find are the protected entities. A term that
stands in the texts of an entity may reveal it even when the mention is gone. How
strongly is estimated from the whole corpus: with N documents, df(c) of them with
entity c, df(t) with term t and n(c, t) with both,

    PMI(c, t) = log2(N n(c, t) / (df(c) df(t))),   I(c, t) = log2(N / n(c, t)),

and PMI / I is the share of the entity's information that the term discloses: 1 if
the two only occur together, be it in one document. I is the information of c where
t stands in all its documents, and more where t stands in a few: what meets a
frequent value once is discounted, what meets a rare value is not. No number of
texts is asked for. Every occurrence of the term, in every document that holds it,
is generalised from one threshold on and removed from a higher one.

Terms are all runs of letters and digits of any length; Chinese and Japanese, which
do not space their words, give each two neighbouring characters. Only English
function words are none, and what lies inside a span: it goes with the span.

Entities that share all their documents have the same counts with every term, and
terms likewise, so pairs are counted between such groups, and only where df(c) and
df(t) are so close that the threshold can be reached at all; both are exact. A long
text with many values and rare terms of its own is one group of each. Counts are
partial aggregates, and equal texts of a batch count as one row with a weight.

Defined cases: null and empty texts have no spans; texts of any length are read
whole; repeated rows are rows of their own; null ids stay null; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.llm.common import tidy
from trialloom.staging import stage

KINDS = ("email", "ip", "card", "phone")
METHOD_KINDS = ("generalised", "removed")
#: Shares of an entity's information.
GENERALISE, REMOVE = 0.95, 0.99
#: Up to so many terms (8 MB) are sent to the tasks that count or mark terms; beyond, every term is counted, and marks are joined to the texts.
SENT_TERMS = 1_000_000
#: Words whose hash a task remembers: some 20 MB.
KNOWN_WORDS = 150_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DIGIT = re.compile(r"[0-9]")
# Possessive, and never begun inside a run of digits: the same matches without trying any twice.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ASCII_TERM = re.compile(r"[A-Za-z0-9]+")
_UNSPACED = r"\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_TERM = re.compile(rf"[^\W_{_UNSPACED}]+|([{_UNSPACED}]+)")
#: Closed-class words: they name nothing, also where a small table has them next to one value only.
FUNCTION_WORDS = frozenset(
    "a an the this that these those i me my we us our you your he him his she her it its they them their who whom whose which what "
    "and or nor but if so as than then because while when where how why not no of to in on at by for from with into onto over under "
    "about after before between through during without is am are was were be been being has have had do does did will would shall "
    "should can could may might must there here".split()
)


def _emails(text: str):
    """Leftmost matches: the run of name characters before an at sign, and the domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(doubled)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all personal data, by kind, then start; code points, end exclusive."""
    spans = [("email", *s) for s in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return spans
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-12:]) <= 255 for p in m.group().split(".")):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            spans.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_DIGIT.findall(m.group())) <= 15:
            spans.append(("phone", *m.span()))
    return spans


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


def _entity(kind: str, value: str) -> int:
    """Spellings of one value are one entity."""
    value = value.lower() if kind == "email" else value if kind == "ip" else "".join(_DIGIT.findall(value))
    return _hash(f"{kind}:{value}")


def _words(text: str):
    """(start, end) of every term."""
    if text.isascii():
        for m in _ASCII_TERM.finditer(text):
            yield m.span()
        return
    for m in _TERM.finditer(text):
        start, end = m.span()
        if m.group(1) and end - start > 2:
            yield from ((i, i + 2) for i in range(start, end - 1))
        else:
            yield start, end


def _free(text: str, spans: list[tuple[str, int, int]]):
    """(start, end) of every term that no span touches."""
    covered = sorted((s, e) for _, s, e in spans)
    starts, reach = [s for s, _ in covered], list(accumulate((e for _, e in covered), max))
    for start, end in _words(text):
        at = bisect_left(starts, end) - 1
        if at < 0 or reach[at] <= start:
            yield start, end


class _Terms(dict):
    """The hash of a word in any case, None for a function word; forgotten all at once when they are many."""

    def __missing__(self, word: str) -> int | None:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        low = word.lower()
        self[word] = term = None if low in FUNCTION_WORDS else _hash(low)
        return term

    def of(self, text: str, spans: list[tuple[str, int, int]]) -> set[int]:
        """The distinct terms that no span touches."""
        if not spans and text.isascii():
            words = set(_ASCII_TERM.findall(text))
        else:
            words = {text[s:e] for s, e in _free(text, spans)}
        return {t for t in map(self.__getitem__, words) if t is not None}


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_HELD = "row long, n long, text_key long, entities array<long>, terms array<long>"


def mentions(docs: DataFrame) -> DataFrame:
    """Entities and terms of the texts that hold any entity; equal texts of a batch are one row of weight ``n``."""

    def run(batches):
        names = [f.split()[0] for f in _HELD.split(", ")]
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2
        row, known = TaskContext.get().partitionId() << 33, _Terms()
        for batch in batches:
            rows = []
            for text, n in Counter(t.as_py() or "" for t in batch.column("text")).items():
                if spans := base_spans(text):
                    entities = {_entity(k, text[s:e]) for k, s, e in spans}
                    rows.append((row, n, _hash(text), sorted(entities), sorted(known.of(text, spans))))
                    row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=names)

    return docs.select("text").mapInArrow(tidy(run), _HELD)


def term_frequencies(docs: DataFrame, wanted: np.ndarray | None) -> DataFrame:
    """term and df: in how many documents it stands outside spans; of the wanted terms (sorted), or of all.

    Wanted terms are counted in one array over the whole task, of the wanted terms' size.
    """

    def counted(batch, known) -> tuple[np.ndarray, np.ndarray]:
        """The terms of each text of a batch, text after text, and how many rows have the text."""
        found, sizes, weights = [], [], []
        for text, n in Counter(t.as_py() or "" for t in batch.column("text")).items():
            own = known.of(text, base_spans(text))
            found.append(np.fromiter(own, np.int64, len(own)))
            sizes.append(len(own))
            weights.append(n)
        return np.concatenate([np.empty(0, np.int64), *found]), np.repeat(np.array(weights, np.int64), sizes)

    def run(batches):
        known = _Terms()
        if wanted is None:
            for batch in batches:
                terms, n = counted(batch, known)
                terms, at = np.unique(terms, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(np.bincount(at, n, len(terms)).astype(np.int64))], names=["term", "n"])
            return
        total = np.zeros(len(wanted), np.int64)
        for batch in batches if len(wanted) else ():
            terms, n = counted(batch, known)
            at = np.minimum(np.searchsorted(wanted, terms), len(wanted) - 1)
            met = wanted[at] == terms
            np.add.at(total, at[met], n[met])
        some = np.flatnonzero(total)
        for low in range(0, len(some), 50_000):
            part = some[low : low + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(wanted[part]), pa.array(total[part])], names=["term", "n"])

    return docs.select("text").mapInArrow(tidy(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


def _sent(terms: DataFrame, *columns: str) -> list[np.ndarray] | None:
    """The columns in the order of their terms, where they are few enough to be sent."""
    if terms.count() > SENT_TERMS:
        return None
    rows = terms.select(*columns).toArrow()
    order = np.argsort(term := rows["term"].to_numpy())
    return [term[order], *(rows[c].to_numpy()[order] for c in columns[1:])]


def revealing(docs: DataFrame) -> DataFrame:
    """term and level (index of its kind) of all terms whose disclosure of any entity reaches a threshold."""
    held = stage(mentions(docs), "pii-mentions")
    total = float(docs.count())
    slack = max(total, 1.0) ** (1 - GENERALISE) * (1 + 1e-9)
    # Two sums over the documents, each of 31 bits of a hash, tell sets of documents apart.
    key = F.xxhash64("text_key")
    where = [F.sum("n").alias("df_m"), F.sum(F.col("n") * F.shiftrightunsigned(key, 33)).alias("f1"), F.sum(F.col("n") * key.bitwiseAND(F.lit((1 << 31) - 1))).alias("f2")]
    entities = held.select("n", "text_key", F.explode("entities").alias("entity")).groupBy("entity").agg(*where)
    entities = stage(entities.select("entity", F.col("df_m").alias("df_c"), F.xxhash64("df_m", "f1", "f2").alias("group_c")), "pii-entities")
    most = entities.agg(F.max("df_c")).first()[0] or 0
    terms = stage(held.select("n", "text_key", F.explode("terms").alias("term")).groupBy("term").agg(*where), "pii-terms")
    wanted = _sent(terms, "term")
    terms = terms.join(term_frequencies(docs, wanted and wanted[0]), "term")
    # A share from the threshold g on means df(c) df(t) <= n ** (1 + g) N ** (1 - g), and n is at most df(c) and df_m.
    terms = terms.filter(F.col("df") <= F.pow(F.least("df_m", F.lit(most)).cast("double"), F.lit(GENERALISE)) * slack)
    terms = stage(terms.select("term", "df", F.xxhash64("df", "df_m", "f1", "f2").alias("group_t")), "pii-rare")
    left = held.select("row", "n", F.explode("entities").alias("entity")).join(entities, "entity").select("row", "n", "group_c", "df_c").distinct()
    right = held.select("row", F.explode("terms").alias("term")).join(terms, "term").select("row", "group_t", "df").distinct()
    pairs = left.join(right, "row").filter((F.col("df") <= F.col("df_c") * slack) & (F.col("df_c") <= F.col("df") * slack))
    together = pairs.groupBy("group_c", "group_t", "df_c", "df").agg(F.sum("n").alias("n"))
    information = F.log2(F.lit(total) / F.col("n"))
    shared = F.log2(F.lit(total) * F.col("n") / (F.col("df_c") * F.col("df")))
    share = F.when(information > 0, shared / information)
    level = (share >= REMOVE).cast("int").alias("level")
    groups = together.filter(share >= GENERALISE).select("group_t", level).groupBy("group_t").agg(F.max("level").alias("level"))
    return terms.join(groups, "group_t").select("term", "level")


def _marked(docs: DataFrame, run, schema) -> DataFrame:
    """``run(batch, spans)`` over all batches of ``docs``, with base spans and method spans of each text."""
    found = stage(revealing(docs), "pii-revealing")
    sent = _sent(found, "term", "level")
    if sent is None:
        keyed = docs.withColumn("_key", F.xxhash64("text"))

        def hold(batches):
            known = _Terms()
            for batch in batches:
                keys, terms = [], []
                for key, text in dict(zip(batch.column("_key").to_pylist(), batch.column("text").to_pylist(), strict=True)).items():
                    own = known.of(text or "", base_spans(text or ""))
                    keys.extend([key] * len(own))
                    terms.extend(own)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(terms, pa.int64())], names=["_key", "term"])

        told = keyed.select("_key", "text").mapInArrow(tidy(hold), "_key long, term long").distinct().join(found, "term")
        told = told.groupBy("_key").agg(F.collect_list(F.struct("term", "level")).alias("_told"))
        docs = keyed.join(told, "_key", "left").drop("_key")

    def mark(batches):
        known = _Terms()
        for batch in batches:
            spans = []
            told = [None] * batch.num_rows if sent else batch.column("_told").to_pylist()
            for text, own in zip(batch.column("text").to_pylist(), told, strict=True):
                base, more = base_spans(text or ""), []
                if sent:
                    mine = known.of(text or "", base) if len(sent[0]) else ()
                    mine = np.fromiter(mine, np.int64, len(mine))
                    at = np.minimum(np.searchsorted(sent[0], mine), max(len(sent[0]) - 1, 0))
                    level = {t: l for t, l, x in zip(mine.tolist(), sent[1][at].tolist(), (sent[0][at] == mine).tolist(), strict=True) if x} if len(mine) else {}
                else:
                    level = {t["term"]: t["level"] for t in own or ()}
                if level:
                    for s, e in _free(text, base):
                        if (kind := level.get(known[text[s:e]])) is not None:
                            more.append((METHOD_KINDS[kind], s, e))
                spans.append((base, sorted(more)))
            yield run(batch, spans)

    return docs.mapInArrow(tidy(mark), schema)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, base_sha256 and spans of every row."""

    def run(batch, spans):
        base = [_joined(b) for b, _ in spans]
        counts = [pa.array([sum(s[0] == k for s in b) for b, _ in spans], pa.int64()) for k in KINDS]
        sha = pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string())
        both = pa.array([_joined([*b, *m]) for b, m in spans], pa.string())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, sha, both], names=[*_COLUMNS, "spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return _marked(docs.select("doc_id", "text"), run, schema)


_COLUMNS = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]


def redact(text: str, spans: str) -> str:
    """The text with every span replaced: base kinds and generalised terms by their name, removed terms by nothing."""
    parts, at = [], 0
    for start, end, kind in sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x)):
        if end <= at:
            continue
        parts.append(text[at : max(start, at)])
        if start >= at and kind != "removed":
            parts.append(f"[{'TERM' if kind == 'generalised' else kind.upper()}]")
        at = end
    return "".join([*parts, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its texts replaced; all else, and rows without spans, unchanged."""
    columns = docs.columns

    def run(batch, spans):
        texts = [redact(t, _joined([*b, *m])) if b or m else t for t, (b, m) in zip(batch.column("text").to_pylist(), spans, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in columns], names=columns)

    return _marked(docs, run, docs.schema)
