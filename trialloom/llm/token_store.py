"""Token ids as files: one zstandard frame for each document, with a shared dictionary.

Texts are range-partitioned by id, encoded, and each document's id array is
compressed by itself with a dictionary trained on serialised id arrays. Rows of
the store are blocks of documents in ascending id order: the frames one after the
other, the offset index to them, and the hash of the dictionary, which lies
beside the blocks. A single short document is read by slicing one frame.

Blocks are rows of Parquet files, written by Spark's own committer: a lost
executor's work is done again and nothing half-written is ever read.

Defined cases: a null or empty text is the end id alone; rows that repeat an id
stand side by side in the order of their texts, null ids stand first; an empty
table gives an empty store.
"""

from __future__ import annotations

import hashlib
import re
import string
import struct
import uuid
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trialloom.staging import stage, staging_root

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: The dictionary learns from so many documents, of at most so many characters, in the order of a hash.
TRAINING_DOCUMENTS, TRAINING_CHARS = 1_500, 20_000
DICTIONARY_BYTES = 64 * 1024
BLOCK_BYTES = 4 << 20
#: Pieces whose ids a Python worker remembers; forgotten all at once beyond that.
REMEMBERED = 1_000_000
#: Bytes of text that are split into pieces at once.
SPLIT_BYTES = 4 << 20
#: A run of these behind letters is a pre-token of its own; an apostrophe may open a contraction.
_SYMBOLS = "".join(c for c in string.punctuation if c != "'")
_LOOSE_SPACE = re.compile(r" (?=\s|$)")
_BLOCK = "part int, block int, dictionary_hash string, docs array<long>, sizes array<int>, offsets array<long>, frames binary"
_READ = "doc_id long, start long, n_tokens long, ids binary"


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


class _Pieces(dict):
    """Ids of text pieces, kept from when they are first asked for.

    Within a piece there are more places that pre-tokens never cross: around a
    single line feed between other characters than white space, and between
    letters and final symbols.
    """

    def __init__(self, tokenizer: Tokenizer, before: str):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.before, self.line_start = before, self if not before else _Pieces(tokenizer, "")
        self.line_feed = self._encoded("\n")

    def _encoded(self, text: str) -> bytes:
        if text.removeprefix(" ").isalpha():  # one pre-token: straight to the model
            # ASCII letters are written as themselves.
            letters = text.replace(" ", _BYTE_LETTERS[32]) if text.isascii() else text.encode().decode("latin-1").translate(_BYTE_LETTERS)
            ids = [t.id for t in self.model.tokenize(letters)]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, piece: str) -> bytes:
        head, feed, tail = piece.partition("\n")
        if feed and head and tail and not head[-1].isspace() and not tail[0].isspace():
            return self[head] + self.line_feed + self.line_start[tail]
        word = piece.rstrip(_SYMBOLS)
        if word != piece and word.isalpha():
            ids = self[word] + self.line_start[piece[len(word) :]]
        else:
            ids = self._encoded(self.before + piece)
        self[piece] = ids
        return ids


@lru_cache(maxsize=1)
def _pieces(path: str) -> _Pieces:
    """The pieces behind a space, kept for a Python worker's later tasks."""
    return _Pieces(_tokenizer(path), " ")


def array_encoder(path: str):
    """A function from a non-empty array of texts to their ids, one after the other, and the end of each text in them.

    A space in front of any other character than white space opens a pre-token,
    so a text without other spaces may be cut at its spaces, and equal pieces have
    equal ids: each is looked up once for all texts of the array. Texts with other
    spaces are encoded whole. A null text has no ids.
    """
    tokenizer, later = _tokenizer(path), _pieces(path)
    first = later.line_start

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        for known in (first, later):
            if len(known) > REMEMBERED:
                known.clear()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        pieces, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
        starts = split.offsets.to_numpy().astype(np.int64)
        starts, counts = starts[:-1] - starts[0], np.diff(starts)
        # A space in front of white space or the end: a later piece that is empty or begins with white space.
        openings = pc.utf8_slice_codeunits(coded.dictionary, 0, 1).dictionary_encode()
        white = np.array([not c or c.isspace() for c in openings.dictionary.to_pylist()], bool)
        loose = white[openings.indices.to_numpy()][index]
        loose[starts] = False
        loose = np.add.reduceat(loose, starts, dtype=np.int64) > 0
        heads = [
            whole_text(texts[i].as_py()) if alone else first[pieces[at]]
            for i, (alone, at) in enumerate(zip(loose.tolist(), index[starts].tolist(), strict=True))
        ]
        index[starts] = len(pieces) + np.arange(len(starts))
        if loose.any():
            kept = ~np.repeat(loose, counts)
            kept[starts] = True
            index, counts = index[kept], np.where(loose, 1, counts)
            used = np.zeros(len(pieces) + len(heads), bool)
            used[index] = True
            found = [later[p] if u else b"" for p, u in zip(pieces, used.tolist(), strict=False)]
        else:
            found = list(map(later.__getitem__, pieces))
        found += heads
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        offset, size = np.cumsum(sizes) - sizes, sizes[index]
        ends = np.cumsum(size)
        flat = np.frombuffer(b"".join(found), "<u4")
        return flat[np.repeat(offset[index] - (ends - size), size) + np.arange(ends[-1])], ends[np.cumsum(counts) - 1]

    def whole_text(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    return encode


def encoder(path: str):
    """A function from a text to its ids (little-endian unsigned 32-bit integers)."""
    encode = array_encoder(path)
    return lambda text: encode(pa.array([text], pa.string()))[0].tobytes()


def _serialised(path: str):
    """A function from an array of texts to their id arrays as stored: the end id appended, two bytes for each id."""
    encode, end = array_encoder(path), struct.pack("<H", END_ID)

    def run(texts: pa.Array):
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        share = np.cumsum(sizes, dtype=np.int64) // SPLIT_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(texts)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if low == high:
                continue
            ids, ends = encode(texts.slice(low, high - low))
            if len(ids) and ids.max() > 0xFFFF:
                raise ValueError("the store holds ids below 65,536")
            data, ends = ids.astype("<u2").tobytes(), (2 * ends).tolist()
            for a, b in zip([0, *ends], ends, strict=False):
                yield data[a:b] + end

    return run


def train_dictionary(docs: DataFrame, path: str) -> bytes:
    """A dictionary from the serialised id arrays of a bounded sample of documents."""
    key = F.xxhash64("doc_id", "text")
    chosen = docs.filter(F.length("text").between(1, TRAINING_CHARS)).select(key.alias("_key")).orderBy("_key").limit(TRAINING_DOCUMENTS)
    keys = [r[0] for r in chosen.distinct().collect()]
    sample = docs.select(key.alias("_key"), "text").join(F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in keys], "_key long")), "_key", "left_semi")

    def run(batches):
        serialised = _serialised(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(list(serialised(batch.column("text"))), pa.binary())], names=["_key", "ids"])

    # Copies share a key: one of each.
    found = sample.mapInArrow(run, "_key long, ids binary").groupBy("_key").agg(F.first("ids").alias("ids")).orderBy("_key").collect()
    samples = [r.ids for r in found]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little to learn from: the samples themselves are the dictionary
        return b"".join(samples)[-DICTIONARY_BYTES:] or b"\0" * 8


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data)


def write_store(docs: DataFrame, folder: str, tokenizer_path: str | None = None) -> None:
    """Encode every text and write the store: ``folder/dictionary`` and ``folder/blocks``."""
    path = tokenizer_path or public_tokenizers.path(TOKENIZER)
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    dictionary = train_dictionary(docs, path)
    name = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(name, bytearray(dictionary))], "dictionary_hash string, bytes binary").coalesce(1).write.parquet(f"{folder}/dictionary")

    def run(batches):
        serialised = _serialised(path)
        compressor = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(dictionary))
        part, number = TaskContext.get().partitionId(), 0
        ids, sizes, frames, total = [], [], [], 0

        def block():
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames]))).tolist()
            values = [part, number, name, ids, sizes, offsets, b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), serialised(batch.column("text")), strict=True):
                ids.append(doc_id)
                sizes.append(len(data) // 2)
                frames.append(compressor.compress(data))
                total += len(frames[-1])
                if total >= BLOCK_BYTES:
                    yield block()
                    ids, sizes, frames, total, number = [], [], [], 0, number + 1
        if ids:
            yield block()

    kinds = [pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
    names = ["part", "block", "dictionary_hash", "docs", "sizes", "offsets", "frames"]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(partitions, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(run, _BLOCK).write.option("compression", "none").parquet(f"{folder}/blocks")


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the store, in place: doc_id, start (ids before it), n_tokens, ids."""
    name, dictionary = spark.read.parquet(f"{folder}/dictionary").first()
    dictionary = bytes(dictionary)
    blocks = spark.read.parquet(f"{folder}/blocks")
    # Ids before a block: those of the parts before its part, and of the part's blocks before it.
    sizes = blocks.select("part", "block", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("_n"))
    parts = sizes.groupBy("part").agg(F.sum("_n").alias("_all"))
    parts = parts.select("part", (F.sum("_all").over(W.orderBy("part")) - F.col("_all")).alias("_part"))
    inside = F.sum("_n").over(W.partitionBy("part").orderBy("block")) - F.col("_n")
    starts = sizes.withColumn("_block", inside).join(parts, "part").select("part", "block", (F.col("_part") + F.col("_block")).alias("start"))
    # Written, the index has a known size: Spark sends it to the blocks where it is small.
    placed = blocks.join(stage(starts, "token-index"), ["part", "block"])

    def run(batches):
        decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_hash"] != name:
                    raise ValueError("a block was written with another dictionary")
                at, frames, sizes = row["offsets"], row["frames"], row["sizes"]
                ids = [np.frombuffer(decompressor.decompress(frames[a:b]), "<u2").astype("<u4").tobytes() for a, b in zip(at, at[1:], strict=False)]
                before = row["start"] + np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))[: len(ids)]
                columns = [pa.array(row["docs"], pa.int64()), pa.array(before, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])

    return placed.select("dictionary_hash", "docs", "sizes", "offsets", "frames", "start").mapInArrow(run, _READ)


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document (of each row with this id): one slice of one frame of its block."""
    name, dictionary = spark.read.parquet(f"{folder}/dictionary").first()
    decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(bytes(dictionary)))
    blocks = spark.read.parquet(f"{folder}/blocks").filter(F.array_contains("docs", F.lit(doc_id).cast("long")))
    rows = blocks.select("part", "block", "dictionary_hash", F.posexplode("docs"), "offsets", "frames").filter(F.col("col") == doc_id)
    at = F.get("offsets", F.col("pos"))
    frame = F.expr("substring(frames, cast(offsets[pos] + 1 as int), cast(offsets[pos + 1] - offsets[pos] as int))")
    found = rows.select("part", "block", "pos", at.alias("at"), frame.alias("frame"), "dictionary_hash").orderBy("part", "block", "pos").collect()
    if any(r.dictionary_hash != name for r in found):
        raise ValueError("a block was written with another dictionary")
    return [np.frombuffer(decompressor.decompress(bytes(r.frame)), "<u2").astype(np.uint32) for r in found]


def new_folder(spark: SparkSession) -> str:
    return f"{staging_root(spark)}/token-store-{uuid.uuid4().hex}"
