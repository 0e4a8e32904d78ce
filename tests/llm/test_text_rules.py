"""Personal data, quality rules and mixing on hand-made rows."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from trialloom.llm import mixing, pii, quality_rules
from tests.llm import brute

PERSONAL = [
    "mail a.b@x.org, then a@b@c.de and q@x.", "x@y.co_z@w.net @ @@a@b.c", "10.0.0.255 1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 0000001.2.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 12345", "+49 (30) 1234-5678 +1 2 +123456789012345678", "1" * 400 + " 5.5.5.5", "none here", "", None,
    "ä é ü: über@mail.example.com 🙂 8.8.8.8",
]


@pytest.mark.parametrize("text", [t for t in PERSONAL if t is not None])
def test_base_spans(text):
    assert pii.base_spans(text) == brute.personal_data(text)


def test_base_spans_of_random_texts():
    draw = random.Random(2)
    for _ in range(4000):
        text = "".join(draw.choices(["a", "@", ".", "1", "23", " ", "-", "+", "_", "b.c", "(", ")", "4111111111111111"], k=draw.randrange(20)))
        assert pii.base_spans(text) == brute.personal_data(text)


def test_terms_that_reveal_are_sanitised_where_the_entity_stands(documents):
    # "zanzibar" stands near one address in different texts and nowhere else; "office" stands everywhere.
    rows = [(i, f"text{'abcdefgh'[i]} office zanzibar write to boss@corp.example.org today number{'abcdefgh'[i]} zanzibar") for i in range(4)]
    rows += [(10 + i, f"office hours of team{"abcdefgh"[i % 8]} and others, write today, plain words only") for i in range(40)]
    rows += [(60, None), (61, ""), (0, rows[0][1]), (None, "none@corp.example.org")]
    found = {r.doc_id: r for r in pii.detect(documents(rows)).collect()}
    assert len(pii.detect(documents(rows)).collect()) == len(rows)
    spans = found[1].spans.split(",")
    text = rows[1][1]
    named = [(k, text[int(s) : int(e)]) for k, s, e in (x.split(":") for x in spans)]
    assert named == [("email", "boss@corp.example.org"), ("removed", "zanzibar"), ("removed", "zanzibar")]
    assert found[10].spans == "" and found[60].spans == "" and found[1].n_email == 1
    clean = {r.doc_id: r.text for r in pii.sanitise(documents(rows)).collect()}
    assert "zanzibar" not in clean[1] and "[EMAIL]" in clean[1] and "office" in clean[1] and clean[10] == rows[4][1]
    assert clean[60] is None and clean[61] == "" and clean[None] == "[EMAIL]"
    assert pii.sanitise(documents(rows)).columns == documents(rows).columns
    assert pii.detect(documents([])).count() == 0 and pii.sanitise(documents([])).count() == 0


def test_a_value_of_one_text_is_protected(documents):
    rows = [(1, "write to boss@corp.example.org zanzibar today office")] + [(10 + i, "office hours, write to us today") for i in range(40)]
    clean = {r.doc_id: r.text for r in pii.sanitise(documents(rows)).collect()}
    assert clean[1] == "write to [EMAIL]  today office" and clean[10] == rows[1][1]


def test_terms_of_any_shape_and_place_are_sanitised(documents):
    # Short, with digits, without spaces between words, and far from the mention.
    many = " office hours, write to us today" * 8
    rows = [(1, f"Kim AC77 q9 " + "\u6211\u89c1\u5f20\u4f1f\u6765" + f"{many} a@x.org{many} farword")]
    rows += [(10 + i, "office hours, write to us today \u6211\u89c1 \u6765") for i in range(40)]
    # A value of 20 texts; "tells" stands in these, and in one without the value.
    rows += [(100 + i, "tells office boss@corp.example.org") for i in range(20)] + [(200, "office tells hours")]
    clean = {r.doc_id: r.text for r in pii.sanitise(documents(rows)).collect()}
    assert not any(t in clean[1] for t in ("Kim", "AC77", "q9", "\u5f20", "\u4f1f", "farword", "@")) and "office hours, write to us today" in clean[1]
    assert clean[200] == "office [TERM] hours" and clean[100] == "[TERM] office [EMAIL]" and clean[10] == rows[1][1]


def test_a_long_text_of_many_values_and_terms(documents):
    text = " ".join(f"a{i}@x.org own{i}" for i in range(30_000))
    rows = [(1, text)] + [(10 + i, "office hours today") for i in range(40)]
    found = {r.doc_id: r.spans for r in pii.detect(documents(rows)).collect()}
    assert found[1].count("removed:") == 30_000 and found[10] == ""


def test_the_two_ways_of_counting_terms_agree(documents, monkeypatch):
    rows = [(i, f"t{i} zanzibar boss@corp.example.org n{i}") for i in range(4)] + [(9, "plain words")] * 30
    want = sorted((r.doc_id, r.spans) for r in pii.detect(documents(rows)).collect())
    monkeypatch.setattr(pii, "SENT_TERMS", 0)
    assert sorted((r.doc_id, r.spans) for r in pii.detect(documents(rows)).collect()) == want


def prose(draw, n, words="the of and to in is that it for with house tree river stone light water paper music".split()):
    return " ".join(draw.choice(words) + draw.choice(["", "", "", "ing", "ed", "ly"]) for _ in range(n)).capitalize() + "."


def test_quality_rules(documents):
    draw = random.Random(4)
    rows = [(i, prose(draw, 150)) for i in range(80)]
    junk = {200: "### $$$ " * 60 + prose(draw, 40), 201: "word " * 100, 202: " ".join(f"{draw.randrange(10**9)}|" for _ in range(150)), 203: "short text"}
    rows += list(junk.items())
    rows += [(300, None), (301, ""), (302, "a\na\n \n\nb c\nb c"), (303, prose(draw, 150), None), (304, prose(draw, 150), "xx"), (0, rows[0][1])]
    found = quality_rules.judge(documents(rows))
    got = {r.doc_id: r for r in found.collect()}
    for row in rows:
        r = got[row[0]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.base_counts(row[1])
    assert not any(got[i].kept for i in (*junk, 300, 301)) and all(got[i].kept for i in range(80)) and got[303].kept and got[304].kept
    assert got[202].base_failed is False and got[202].class_distance > got[5].class_distance
    assert found.count() == len(rows) and quality_rules.judge(documents([])).count() == 0


def test_quality_rules_stay_native(documents):
    plan = quality_rules.measure(documents([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def mix_by_hand(rows):
    """Replays the queue one document at a time: (size, source_size, target, taken) of each row, in the order of the rows."""
    import hashlib

    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    sizes, met = [], Counter()
    for d, t, _, s in rows:
        base = md5(f"{'null' if d is None else d}:{md5(t or '')}")
        number, met[s, base] = met[s, base], met[s, base] + 1
        sizes.append((md5(f"{base}:{number}") if number else base, s, len((t or "").split())))
    per = defaultdict(int)
    for _, s, n in sizes:
        per[s] += n
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(per.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= 3 * per[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3.0 * per[s] for s in full}
        free -= full
        left -= sum(3 * per[s] for s in full)
    queue = []
    for s in order:
        mine = sorted((key, i, n) for i, (key, x, n) in enumerate(sizes) if x == s and n)
        for r in range(3):
            upto = 0
            for key, i, n in mine:
                upto += n
                queue.append(((upto + r * per[s]) / target[s], key, (s is None, s or ""), r, i, n))
    taken, total = defaultdict(int), 0
    for *_, i, n in sorted(queue):
        total += n
        if total > sum(per.values()):
            break
        taken[i] += n
    return [(n, per[s], target[s], taken[i]) for i, (_, s, n) in enumerate(sizes)]


def compared(rows, found):
    """The mix of ``rows`` as counted rows, by hand and as found; targets to nine digits."""
    line = lambda d, v: (d, v[0], v[1], f"{v[2]:.9g}", v[3])
    want = Counter(line(r[0], v) for r, v in zip(rows, mix_by_hand(rows), strict=True))
    return want, Counter(line(r.doc_id, (r.size, r.source_size, r.target, r.taken)) for r in found)


def test_mixing_replays_the_queue(documents):
    draw = random.Random(8)
    rows = [(i, "w " * draw.randrange(0, 40), "en", draw.choice(["a", "b", "b", "b", "c", "é", None])) for i in range(300)]
    rows += [(400, None, "en", "empty"), (401, "", "en", "empty"), (402, "x y", "en", "a")]
    found = mixing.mix(documents(rows)).collect()
    want, got = compared(rows, found)
    assert got == want and all(r.taken <= 3 * r.size for r in found)
    out = mixing.mixed(documents(rows))
    assert out.columns == documents(rows).columns
    words = out.select(F.sum(mixing.document_size(F.col("text")))).first()[0]
    assert words == sum(r.taken for r in found)


@pytest.mark.parametrize("chunk", [7, 4096])
def test_mixing_of_null_and_repeated_ids(documents, monkeypatch, chunk):
    monkeypatch.setattr(mixing, "CHUNK", chunk)
    draw = random.Random(9)
    # A third without an id, a third one and the same row, ids with several texts, one id in two sources.
    rows = [(None, "n " * draw.randrange(1, 30), "en", "a") for _ in range(100)]
    rows += [(7, "same row of words", "en", draw.choice(["a", "b"])) for _ in range(100)]
    rows += [(draw.randrange(30), "t " * draw.randrange(1, 30), "en", draw.choice(["a", "b", "c", None])) for _ in range(100)]
    found = mixing.mix(documents(rows).repartition(5)).collect()
    want, got = compared(rows, found)
    assert got == want
    for source in ("a", "b", "c", None):
        mine = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 30


def test_mixed_leaves_every_column_as_it_is(shipped):
    draw = random.Random(10)
    names = "doc_id long, text string, source string, size double, target string, served int, taken long, source_size long, key string, round int, _copy int, _key string, _place int"
    rows = [(i, "w " * draw.randrange(1, 9), "ab"[i % 2], 7.5, "t", -1, -2, -3, "k", 11, 12, "x", 13) for i in range(60)]
    docs = shipped.createDataFrame(rows, names)
    out = mixing.mixed(docs)
    assert out.schema == docs.schema
    got = out.collect()
    assert {tuple(r) for r in got} <= set(rows) and len(got) >= 40
    mixed = mixing.mix(docs)
    assert sorted(c for c in mixed.columns) == sorted(docs.columns) and mixed.filter("served > 0").count() == len({r.doc_id for r in got})


def test_mixing_edges(documents):
    assert mixing.mix(documents([])).count() == 0 and mixing.mixed(documents([])).count() == 0
    none = mixing.mix(documents([(1, None), (2, "")])).collect()
    assert [(r.size, r.taken, r.target) for r in none] == [(0, 0, 0.0)] * 2
    again = mixing.mix(documents([(1, "a b"), (1, "a b"), (None, "c")])).collect()
    assert len(again) == 3 and sum(r.taken for r in again) <= 5
