"""Fill in the middle: every cut against a plain tokenisation, and the text from output and form."""

import hashlib
import random
import re

import numpy as np
import pytest

from trialloom.llm import fill_middle as fim


def plain_version(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    draw = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(draw[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(c in text for c in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


def random_text(rng, length):
    return "".join(rng.choice(["word", "a", " ", "\n", ".", "é", "漢", "😀", "7", "<", "P>", ">", "xyz" * 9]) for _ in range(length))


def test_all_rows_equal_the_plain_version(documents):
    rng = random.Random(3)
    rows = [(i, random_text(rng, rng.choice([1, 2, 5, 40, 300]))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "a<P>b"), (1003, "<M>"), (1004, "\n"), (None, "no id at all"), (None, None)]
    rows += [(1005, "same row"), (1005, "same row"), (1005, "same id, other text"), (1006, "ab\r\n\x00cd")]
    found = fim.restore(fim.transform(documents(rows)))
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "text"]
    assert found.columns == names
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(repr(plain_version(*r[:2])) for r in rows)
    forms = {plain_version(*r[:2])[2] for r in rows}
    assert forms == {"plain", "psm", "spm"}


def test_very_long_text(documents):
    rng = random.Random(5)
    text = random_text(rng, 700_000) + "z" * 300_000
    row = fim.restore(fim.transform(documents([(9, text)]))).first()
    assert tuple(row) == plain_version(9, text)


def test_pieces_do_not_show(monkeypatch):
    rng = random.Random(11)
    texts = [random_text(rng, 200).encode() for _ in range(30)]
    whole = [np.concatenate(list(fim.boundaries(t))) for t in texts]
    for piece in (1, 3, 64):
        monkeypatch.setattr(fim, "PIECE", piece)
        assert all(np.array_equal(np.concatenate(list(fim.boundaries(t))), w) for t, w in zip(texts, whole, strict=True))


@pytest.mark.parametrize("step", [1, 4, 1024])
def test_index_predicts_within_the_error_and_corrects_exactly(monkeypatch, step):
    monkeypatch.setattr(fim, "STEP", step)
    rng = random.Random(7)
    text = "".join(rng.choice(["a" * rng.randrange(1, 400), " ", "é", "x y "]) for _ in range(3_000)).encode()
    ends = np.concatenate(list(fim.boundaries(text)))
    found = fim.index(text)
    assert [found.offset(r) for r in range(found.units + 1)] == ends.tolist()
    assert np.abs(found.residuals.astype(int)).max() <= fim.ERROR
    # Words of even length need few segments.
    even = fim.index(b"four " * 50_000)
    assert len(even.ranks) <= 3 and even.units == 100_000


def test_empty_table_and_parameters(documents):
    assert fim.restore(fim.transform(documents([]))).collect() == []
    rows = [(i, "one two three four") for i in range(60)]
    assert {r.form for r in fim.transform(documents(rows), plain_percent=100).collect()} == {"plain"}
    assert {r.form for r in fim.transform(documents(rows), plain_percent=0, spm_percent=100).collect()} == {"spm"}
    assert fim.transform(documents(rows), seed=2).collect() != fim.transform(documents(rows), seed=1).collect()
    with pytest.raises(ValueError):
        fim.transform(documents(rows), plain_percent=101)


def test_one_pass_without_a_shuffle(documents):
    plan = fim.restore(fim.transform(documents([(1, "a b")])))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
