"""Byte-level BPE by a global shuffle of distinct words, and decoding by the token-byte table.

1. Texts are split into pre-tokens in blocks of bounded size. A block keeps its
   documents as positions in its own word list, and its distinct words.
2. The blocks' words are exploded with their positions in the block and shuffled
   by word, so every distinct word of the corpus is encoded once, wherever and
   however often it stands. A frequent word is one row for each block, not for
   each occurrence.
3. The ids go back to the blocks, which look up each position and so reassemble
   the documents.

Decoding looks every id up in the table of token bytes, which the vocabulary bounds.

Defined cases: a null or empty text has no ids and decodes to no bytes; a text of
any length stays whole (its block grows with it); repeated rows and null ids are
carried along by position; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from trialloom.llm.common import hand_back, tidy

#: Characters of text after which a block is closed.
BLOCK_CHARS = 32_000_000
RANKS = "byte_bpe_multi_50k.tiktoken"
_PACKED = pa.schema([("block", pa.int64()), ("docs", pa.list_(pa.int64())), ("lengths", pa.binary()), ("sequence", pa.binary()), ("words", pa.binary())])
_WORD = pa.schema([("word", pa.binary()), ("block", pa.int64()), ("place", pa.int32())])
_CODES = pa.schema([("block", pa.int64()), ("codes", pa.binary())])
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])


@lru_cache(maxsize=2)
def _encoding(ranks_path: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(ranks_path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all bytes, and each id's offset and length in them."""
    encoding = _encoding(ranks_path)
    tokens = [encoding.decode_single_token_bytes(i) for i in range(encoding.max_token_value + 1)]
    sizes = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes


def _gather(flat: np.ndarray, offset: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of ``flat`` that ``at`` names, joined, and the end of each in the result."""
    sizes = size[at]
    ends = np.cumsum(sizes)
    if not len(ends):
        return flat[:0], ends
    where = np.repeat(offset[at] - (ends - sizes), sizes) + np.arange(ends[-1])
    return flat[where], ends


def _planes(values: np.ndarray) -> bytes:
    """Unsigned integers, compressed a byte plane at a time: the high bytes of small numbers are zero."""
    compressor = zstandard.ZstdCompressor(level=3).compressobj(size=4 * len(values))
    parts = [compressor.compress(((values >> np.uint32(8 * k)) & np.uint32(255)).astype(np.uint8)) for k in range(4)]
    return b"".join([*parts, compressor.flush()])


def _unplanes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    values = planes[0].astype(np.uint32)
    for k in (1, 2, 3):
        if planes[k].any():
            values |= planes[k].astype(np.uint32) << np.uint32(8 * k)
    return values


def _split(batches):
    """Documents to blocks of word positions."""
    find = regex.compile(public_tokenizers.PATTERN).findall
    partition, number = TaskContext.get().partitionId(), 0

    def fresh():
        known: dict[str, int] = {}
        return known, [], [], 0

    def packed():
        lengths = _planes(np.array([len(p) for p in places], np.uint32))
        sequence = np.concatenate([np.empty(0, np.uint32), *places])
        places.clear()
        # The most frequent words get the lowest places: their high bytes are zero.
        order = np.argsort(-np.bincount(sequence, minlength=len(known)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        np.take(rank, sequence, out=sequence)
        listed = list(known)
        known.clear()
        listed = [listed[i].encode() for i in order.tolist()]
        sizes = _planes(np.array([len(w) for w in listed], np.uint32))
        text = zstandard.ZstdCompressor(level=3).compress(b"".join(listed))
        row = [(partition << 32) + number, ids, lengths, _planes(sequence), len(sizes).to_bytes(8, "little") + sizes + text]
        return pa.RecordBatch.from_pydict(dict(zip(_PACKED.names, ([v] for v in row), strict=True)), schema=_PACKED)

    known, ids, places, chars = fresh()
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            found = find(text.as_py() or "")
            ids.append(doc_id)
            places.append(np.array([known.setdefault(w, len(known)) for w in found], np.uint32))
            chars += sum(map(len, found))
            if chars >= BLOCK_CHARS:
                yield packed()
                number += 1
                known, ids, places, chars = fresh()
    if ids:
        yield packed()


def _words(batches):
    """Blocks to their distinct words, with the words' places."""
    for batch in batches:
        for block, data in zip(batch.column("block").to_pylist(), batch.column("words"), strict=True):
            data = data.as_py()
            cut = 8 + int.from_bytes(data[:8], "little")
            sizes = _unplanes(data[8:cut])
            text = zstandard.ZstdDecompressor().decompress(data[cut:])
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            for low in range(0, len(sizes), 20_000):
                high = min(low + 20_000, len(sizes))
                piece = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(ends[low : high + 1].tobytes()), pa.py_buffer(text)])
                yield pa.RecordBatch.from_arrays([piece, pa.array(np.full(high - low, block)), pa.array(np.arange(low, high, dtype=np.int32))], schema=_WORD)


def _encode(ranks_path: str, flush: int = 500_000):
    def run(batches):
        """Words in order: each distinct one is encoded once; its ids go to all its blocks."""
        encode = _encoding(ranks_path).encode_ordinary
        last, ids, rows = None, b"", 0
        blocks: dict[int, tuple[list, list]] = {}

        def packed():
            codes = []
            for places, coded in blocks.values():
                sizes = np.array([len(c) // 4 for c in coded], np.uint32)
                parts = [_planes(np.array(places, np.uint32)), _planes(sizes), _planes(np.frombuffer(b"".join(coded), "<u4"))]
                codes.append(b"".join(len(p).to_bytes(8, "little") + p for p in parts))
            return pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array(codes, pa.binary())], schema=_CODES)

        for batch in batches:
            for word, block, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if word != last:
                    last, ids = word, np.array(encode(word.decode()), "<u4").tobytes()
                places, coded = blocks.setdefault(block, ([], []))
                places.append(place)
                coded.append(ids)
            rows += batch.num_rows
            if rows >= flush:
                yield packed()
                blocks, rows = {}, 0
        if blocks:
            yield packed()

    return run


def _reassemble(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's documents, and the codes of its words, to the documents' ids."""
    parts = []
    for docs, lengths, sequence in zip(*(left.column(c) for c in ("docs", "lengths", "sequence")), strict=True):
        places, sizes, flat = [], [], []
        for data in right.column("codes"):
            data, at = data.as_py(), 0
            for into in (places, sizes, flat):
                size = int.from_bytes(data[at : at + 8], "little")
                into.append(_unplanes(data[at + 8 : at + 8 + size]))
                at += 8 + size
        places, sizes, flat = (np.concatenate([np.empty(0, np.uint32), *x]) for x in (places, sizes, flat))
        offset, size = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        offset[places], size[places] = np.cumsum(sizes, dtype=np.int64) - sizes, sizes
        sequence, cuts = _unplanes(sequence.as_py()), np.concatenate(([0], np.cumsum(_unplanes(lengths.as_py()), dtype=np.int64)))
        before = np.cumsum([0, *(int(size[sequence[a:b]].sum()) for a, b in zip(cuts, cuts[1:], strict=False))])
        ids = np.empty(int(before[-1]), "<u4")
        for i in range(len(cuts) - 1):
            ids[before[i] : before[i + 1]] = _gather(flat, offset, size, sequence[cuts[i] : cuts[i + 1]])[0]
        # Documents of a block lie one after the other: one buffer and their ends.
        ends = pa.py_buffer((4 * before).astype(np.int64).tobytes())
        column = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, ends, pa.py_buffer(ids)])
        parts += [pa.table([docs.values.slice(low, 2_000), column.slice(low, 2_000).cast(pa.binary())], schema=_IDS) for low in range(0, len(column), 2_000)]
    return pa.concat_tables(parts) if parts else _IDS.empty_table()


def encode(docs: DataFrame, ranks_path: str | None = None, decoded: bool = False) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of every text.

    With ``decoded`` the column of ``decode`` comes along, made where the ids are put
    together: one Python worker for each task in place of two.
    """
    ranks_path = ranks_path or public_tokenizers.path(RANKS)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = "block long, docs array<long>, lengths binary, sequence binary, words binary"
    # Both uses of the blocks take the whole rows of this one exchange, so Spark runs it once.
    blocks = docs.select("doc_id", "text").mapInArrow(tidy(_split), packed).repartition(partitions, "block")
    words = blocks.mapInArrow(tidy(_words), "word binary, block long, place int").repartition("word").sortWithinPartitions("word")
    codes = words.mapInArrow(tidy(_encode(ranks_path)), "block long, codes binary")

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        table = _reassemble(left, right)
        if decoded:
            texts = [pa.array(_decoded(chunk, ranks_path), pa.binary()) for chunk in table.column("ids").chunks]
            table = table.append_column("decoded", pa.chunked_array(texts, pa.binary()))
        hand_back()
        return table

    schema = "doc_id long, ids binary" + ", decoded binary" * decoded
    return blocks.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(together, schema)


def _decoded(ids: pa.Array, ranks_path: str) -> list[bytes]:
    flat, offset, size = token_bytes(ranks_path)
    return [_gather(flat, offset, size, np.frombuffer(x.as_py() or b"", "<u4"))[0].tobytes() for x in ids]


def decode(encoded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``: the bytes that its ``ids`` stand for."""
    ranks_path = ranks_path or public_tokenizers.path(RANKS)

    def run(batches):
        for batch in batches:
            texts = _decoded(batch.column("ids"), ranks_path)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "decoded"])

    kept = encoded.drop("decoded")
    return kept.mapInArrow(tidy(run), StructType([*kept.schema.fields, StructField("decoded", BinaryType())]))
