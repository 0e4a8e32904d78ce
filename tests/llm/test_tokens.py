"""BPE and the token store against the tokenizers' own results."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trialloom.llm import bpe, token_store
from tests.llm import brute

TEXTS = [
    (3, "The cat's  mat.\n\n  And 12,345 dogs!"), (1, None), (2, ""), (5, " "), (4, "naïve çà et là 漢字 🙂 \x1c  x"), (9, "a " * 20_000 + "end"),
    (7, "it's IT'S <|endoftext|> 's"), (8, "twice twice twice"), (8, "twice twice twice"), (None, "no id"), (6, "tab\tand\r\nline \n end "),
]


def test_bpe_equals_the_library_and_round_trips(documents, shipped, monkeypatch):
    encoding = brute.encoding()
    found = bpe.decode(bpe.encode(documents(TEXTS))).collect()
    as_key = lambda i: -1 if i is None else i
    got = sorted((as_key(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in found)
    assert got == sorted((as_key(i), np.array(encoding.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in TEXTS)
    assert bpe.encode(documents([])).count() == 0
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 10)
    assert bpe.encode(documents(TEXTS)).count() == len(TEXTS)


def test_each_distinct_word_is_encoded_once(documents):
    plan = bpe.encode(documents(TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(word" in plan


def pieces(draw):
    letters = ["a", "é", "ß", "1", " ", "\n", ".", ",", "!", "'s", "\t", " ", "x", "漢", "\x1c", "\r\n", "  ", "<|endoftext|>"]
    return "".join(draw.choices(letters, k=draw.randrange(14)))


def test_cut_texts_have_the_ids_of_whole_texts():
    path = public_tokenizers.path(token_store.TOKENIZER)
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    encode, draw = token_store.encoder(path), random.Random(5)
    for _ in range(4000):
        text = pieces(draw)
        assert np.frombuffer(encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_arrays_have_the_ids_of_their_texts_and_each_piece_is_looked_up_once(monkeypatch):
    path = public_tokenizers.path(token_store.TOKENIZER)
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    token_store._pieces.cache_clear()
    asked, missing = [], token_store._Pieces.__missing__
    monkeypatch.setattr(token_store._Pieces, "__missing__", lambda self, piece: asked.append((id(self), piece)) or missing(self, piece))
    draw = random.Random(6)
    words = ["a", "Zaun***", "Zaun", "é$$$", "don't", "x'!", "1.", "two\nlines", "", "\x1c", "漢字"]
    texts = [None, "", " ", "again Zaun", "again Zaun.", *(" ".join(draw.choices(words, k=draw.randrange(9))) for _ in range(800))]
    ids, ends = token_store.array_encoder(path)(pa.array(texts))
    for text, a, b in zip(texts, [0, *ends], ends, strict=False):
        assert ids[a:b].tolist() == whole.encode(text or "", add_special_tokens=False).ids
    assert len(ids) == ends[-1]
    cut = [a for a in asked if "\n" not in a[1]]
    assert len(cut) == len(set(cut))


def test_store_reads_back_in_order_and_by_document(documents, shipped):
    whole = Tokenizer.from_file(public_tokenizers.path(token_store.TOKENIZER))
    whole.encode_special_tokens = True
    folder = token_store.new_folder(shipped)
    token_store.write_store(documents(TEXTS), folder)
    read = token_store.read_store(shipped, folder).orderBy("start").collect()
    ordered = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for row, (doc_id, text) in zip(read, ordered, strict=True):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [token_store.END_ID]
        assert (row.doc_id, row.start, row.n_tokens) == (doc_id, start, len(ids))
        assert zlib.crc32(bytes(row.ids)) == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert [len(x) for x in token_store.read_document(shipped, folder, 8)] == [whole.encode("twice twice twice").ids.__len__() + 1] * 2
    assert token_store.read_document(shipped, folder, 77) == []
    blocks = shipped.read.parquet(f"{folder}/blocks")
    named = shipped.read.parquet(f"{folder}/dictionary").first()
    assert {r.dictionary_hash for r in blocks.select("dictionary_hash").collect()} == {hashlib.sha256(bytes(named.bytes)).hexdigest()}
    assert blocks.filter(F.size("offsets") != F.size("docs") + 1).count() == 0


def test_empty_store(documents, shipped):
    folder = token_store.new_folder(shipped)
    token_store.write_store(documents([]), folder)
    assert token_store.read_store(shipped, folder).count() == 0
