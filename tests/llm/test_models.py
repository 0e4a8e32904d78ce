"""The two fitted models, nearest neighbours and chat formatting."""

import hashlib
import inspect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialloom.llm import chat_format, nearest, quality_model, toxicity

GOOD = "the river runs past quiet houses and over old stones while people talk about music".split()


def prose(draw, n):
    return " ".join(draw.choice(GOOD) for _ in range(n)).capitalize() + "."


def labelled(documents, shipped, n=240):
    draw = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        bad, toxic = i % 3 == 0, i % 4 == 0
        text = " ".join(w.upper() + "!!" for w in prose(draw, 60).split()) if bad else prose(draw, draw.randrange(30, 200))
        if toxic:
            words = text.split(" ")
            for _ in range(draw.randrange(2, 9)):
                words.insert(draw.randrange(len(words)), draw.choice(["trash", "scum", "moron"]))
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, 0 if bad else 1, int(toxic)))
    labels += [(None, 1, 1), (5, None, None), (9999, 1, 0)]
    rows += [(1000, None), (1001, ""), (1002, prose(draw, 20_000)), (0, rows[0][1]), (None, prose(draw, 50))]
    return documents(rows), shipped.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_model(documents, shipped):
    docs, labels = labelled(documents, shipped)
    scored = quality_model.classify(docs, labels)
    assert scored.count() == docs.count()
    found = scored.join(labels, "doc_id", "left").collect()
    judged = [r for r in found if r.quality is not None and r.held_out]
    assert len(judged) > 30 and np.mean([(r.predicted == 1) == (r.quality == 1) for r in judged]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    assert len({r.score for r in found if r.doc_id == 0}) == 1
    held = {r.doc_id for r in docs.filter(quality_model.held_out(F.col("doc_id"))).collect()}
    import zlib

    assert held == {i for i in [*range(240), 1000, 1001, 1002] if zlib.crc32(str(i).encode()) % 4 == 2}


def test_quality_model_without_labels(documents, shipped):
    docs, labels = labelled(documents, shipped, 6)
    none = labels.filter("quality = 1")
    assert quality_model.train(docs, none) is None
    assert {r.score for r in quality_model.classify(docs, none).collect()} == {0.5}
    assert quality_model.classify(documents([]), labels).count() == 0


def test_attention_gradient():
    draw = np.random.default_rng(0)
    bags = [draw.normal(size=(n, 20)).astype(np.float32) for n in (1, 3, 2)]
    x, starts, y, weight = np.concatenate(bags).astype(np.float64), np.array([0, 1, 4]), np.array([0.0, 1, 1]), np.array([0.2, 0.3, 0.5])
    shapes = {"e": (20, quality_model.ENCODED), "eb": quality_model.ENCODED, "v": (quality_model.ENCODED, quality_model.ATTENTION)}
    shapes |= {"u": shapes["v"], "w": quality_model.ATTENTION, "c": quality_model.ENCODED, "cb": ()}
    model = {k: draw.normal(0, 0.3, s) for k, s in shapes.items()}

    def loss(m):
        p = quality_model.forward(m, x, starts)[0]
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    slopes = quality_model._gradient(model, x, starts, y, weight)
    for name in shapes:
        step = np.zeros(shapes[name])
        step[(0,) * step.ndim] = 1e-5
        change = (loss(model | {name: model[name] + step}) - loss(model | {name: model[name] - step})) / 2e-5
        assert slopes[name][(0,) * step.ndim] == pytest.approx(change, abs=1e-6)


def test_passages_cover_the_whole_text():
    assert quality_model.passage_features("").shape == quality_model.passage_features(" \n").shape == (1, 20)
    for n in (1, 39, 41, 5000):
        found = quality_model.passage_features("word " * n)
        assert len(found) == -(-n // quality_model.PASSAGE_WORDS)
        assert len(quality_model.spaced(found)) == min(len(found), quality_model.FIT_PASSAGES)


def plain_score(model, bag):
    """A document's score, passage by passage."""
    logits, encoded = [], []
    for x in bag.astype(np.float64):
        h = np.tanh(np.clip((x - model["mean"]) / model["scale"], -8, 8) @ model["e"] + model["eb"])
        gate = 1 / (1 + np.exp(-(h @ model["u"])))
        logits.append(float((np.tanh(h @ model["v"]) * gate) @ model["w"]))
        encoded.append(h)
    weights = [np.exp(a - max(logits)) for a in logits]
    z = sum(w * h for w, h in zip(weights, encoded, strict=True)) / sum(weights)
    return 1 / (1 + np.exp(-(z @ model["c"] + model["cb"])))


def test_streamed_attention_is_the_whole_sum(monkeypatch):
    """Blocks that cut bags anywhere, and a text of 100,000 words with one junk passage."""
    draw = random.Random(2)
    clean, junk = [prose(draw, 80) for _ in range(60)], [" ".join(["$$$ BUY!!"] * 40) for _ in range(60)]
    bags = [quality_model.passage_features(t) for t in clean + junk]
    model = quality_model.fit(bags, np.repeat([1, 0], 60), np.ones(120))
    long = [prose(draw, 40) for _ in range(2_500)]
    mixed = [*long[:1_200], junk[0], *long[1_200:]]
    texts = [" ".join(long), "", " ".join(mixed), *clean[:5], *junk[:5]]
    bags = [quality_model.passage_features(t) for t in texts]
    assert len(bags[0]) == 2_500
    expected = [plain_score(model, b) for b in bags]
    for block in (1, 7, 1_000, 1 << 20):
        monkeypatch.setattr(quality_model, "BLOCK", block)
        assert quality_model.predict(model, bags) == pytest.approx(expected, abs=1e-5)
    assert min(expected[3:8]) > 0.7 > max(expected[8:]) and expected[0] > 0.7


def test_repeated_ids_teach_once(documents, shipped):
    """An id that many rows repeat, with other texts too, is one row of the sample."""
    docs, labels = labelled(documents, shipped, 60)
    repeated = docs.filter("doc_id = 3").join(shipped.range(500).select(), how="cross").unionByName(docs)
    other = docs.filter("doc_id = 4").select(F.lit(3).cast("long").alias("doc_id"), *[c for c in docs.columns if c != "doc_id"])
    one, two = quality_model.train(docs, labels), quality_model.train(repeated, labels)
    assert all(np.array_equal(one[k], two[k]) for k in one)
    assert quality_model.train(repeated.unionByName(other), labels) is not None


def test_toxicity(documents, shipped):
    docs, labels = labelled(documents, shipped)
    model = toxicity.train(docs, labels)
    assert list(model["theta"]) == sorted(model["theta"])
    found = toxicity.assess(docs, model).join(labels, "doc_id", "left").collect()
    known = [r for r in found if r.toxic is not None]
    assert np.mean([r.is_toxic == bool(r.toxic) for r in known]) >= 0.98
    assert all(0 <= r.severity <= toxicity.GRADES and r.is_toxic == (r.grade > 0) for r in found)
    assert not any(r.is_toxic for r in found if r.doc_id in (1000, 1001, 1002))
    mild, strong = toxicity.assess(documents([(1, "you moron"), (2, "you moron, trash, scum, trash, scum and moron")]), model).orderBy("doc_id").collect()
    assert mild.severity < strong.severity
    assert toxicity.assess(documents([]), None).count() == 0
    assert {r.severity for r in toxicity.assess(docs, None).collect()} == {0.0}


def exact(rows, query, k):
    vectors = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    q = vectors[query]
    scores = {i: float(v @ q / (np.linalg.norm(v) * np.linalg.norm(q))) for i, v in vectors.items() if i != query and len(v) == len(q)}
    return sorted(scores.items(), key=lambda s: (-round(s[1], 12), s[0]))[:k]


def vectors(n, dim=16):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, dim))
    rows = [(i, (centres[i % 12] + 0.6 * draw.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]
    same = rows[7][1]
    rows += [(n + i, same) for i in range(n // 3)]  # a vector that many rows share
    rows += [(90_001, None), (90_002, [0.0] * dim), (90_003, [float("nan")] * dim), (90_004, [1.0] * (dim - 1) + [None]), (90_005, [float("inf")] * dim), (None, same)]
    return rows + [(90_050, [1.0, 2.0]), (90_006, []), (0, rows[0][1])]


SCHEMA = "vec_id long, embedding array<float>, label int, query long, rank int, score double"


def test_nearest_recall_and_ties(shipped, monkeypatch):
    monkeypatch.setattr(nearest, "CELL_ROWS", 100)
    monkeypatch.setattr(nearest, "SHARD_ROWS", 60)
    rows = vectors(900)
    table = shipped.createDataFrame([(i, v, 0, 1, 2, 3.0) for i, v in rows], SCHEMA)
    found = {}
    for r in nearest.neighbours(table, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    right = total = 0
    queries = [i for i, v in rows if i is not None and i % 50 == 0 and v and i < 90_000]
    for q in set(queries):
        want = exact(rows, q, 5)
        got = found[q]
        assert [g[0] for g in got] == [1, 2, 3, 4, 5] and q not in [g[1] for g in got]
        right += len({g[1] for g in got} & {w[0] for w in want})
        total += 5
    assert right / total >= 0.95
    assert [g[1] for g in found[900]] == [7, 901, 902, 903, 904]  # copies of one vector: the smallest ids
    assert 90_050 not in found


def test_nearest_goes_on_until_a_miss_is_unlikely():
    class OneMore:
        def leaves(self, q):
            yield 0.0, np.array([0])
            yield 0.9 * nearest.chi_square_quantile(0.97, nearest.PROJECTIONS) * (2 - 2 * 0.8), np.array([1])

    confidence = inspect.signature(nearest.neighbours).parameters["confidence"].default
    vectors = np.array([[0.8, 0.6], [1.0, 0.0]])
    best = nearest.search(OneMore(), vectors, np.ones(2), [[1], [2]], np.array([1.0, 0.0]), np.zeros(nearest.PROJECTIONS), np.inf, 1, nearest.chi_square_quantile(confidence, nearest.PROJECTIONS))
    assert best == [(1.0, 2)]


def test_toxicity_learns_from_4000_rows_of_each_label(documents, shipped, monkeypatch):
    rows = [(i, f"plain words number{i}" + " trash scum" * (i % 2)) for i in range(8200)]
    labels = shipped.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    given = []
    monkeypatch.setattr(toxicity, "fit", lambda bags, grade, weight: given.append(grade))
    toxicity.train(documents(rows), labels)
    # Less the few whose hashed features all coincide with another row's: such rows are one.
    assert 3950 <= (given[0] == 0).sum() <= 4000 and 3950 <= (given[0] > 0).sum() <= 4000


def test_nearest_with_few_rows(shipped):
    table = shipped.createDataFrame([(0, [1.0, 0.0], 0, 1, 2, 3.0), (1, [1.0, 1.0], 0, 1, 2, 3.0), (2, [0.0, 1.0], 0, 1, 2, 3.0)], SCHEMA)
    got = [(r.query_id, r.rank, r.vec_id) for r in nearest.neighbours(table, F.col("vec_id") == 0, 5).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]
    assert nearest.neighbours(table.limit(0), F.lit(True), 5).count() == 0


def test_chi_square_quantile():
    assert nearest.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    assert nearest.chi_square_quantile(0.5, 2) == pytest.approx(1.386, abs=1e-3)


TALK = [
    (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "b\\<\\["), (1, 0, "user", "qzxprobexzq"),
    (1, 2, "assistant", None), (2, 0, None, "x"), (2, 0, "system", "y"), (None, 0, "assistant", "é🙂"), (2, None, "assistant", ""),
]


def test_chat_round_trip(shipped):
    table = shipped.createDataFrame([(*t, 1) for t in TALK], "conv_id long, turn long, role string, text string, loss int")
    formatted = chat_format.format_conversations(table).collect()
    for row in formatted:
        turns = sorted(((t[1] if t[1] is not None else -1, t[2] or "", t[3] or "") for t in TALK if t[0] == row.conv_id), key=lambda t: t[:3])
        text = row.text
        assert [(r, chat_format.unescape(text[s.start : s.end])) for r, s in zip(row.roles, row.texts)] == [t[1:] for t in turns]
        assert "".join(text[s.start : s.end] for s in row.spans) == text[len("<s>") :] and not row.rewrites_history
        assert text.count("</s>") == sum(r == "assistant" for r in row.roles)
    done = {r.conv_id: r for r in chat_format.digests(chat_format.format_conversations(table)).collect()}
    say = TALK[0][3]
    assert done[-7].turns_sha256 == hashlib.sha256(f"user\n{say}\nassistant\n{say}\n".encode()).hexdigest()
    assert done[-7].loss_chars == len(say) and done[-7].loss_sha256 == hashlib.sha256(say.encode()).hexdigest()
    assert done[1].loss_chars == len("b\\<\\[") and done[None].loss_chars == 2
    assert chat_format.format_conversations(table.limit(0)).count() == 0


def test_templates_that_rewrite_history_are_found():
    only_last = lambda turns: "".join(f"<{r}>{t if i + 1 == len(turns) else '...'}" for i, (r, t) in enumerate(turns))
    assert chat_format.locate([("a", "x"), ("b", "y")], only_last)[3]
    closing = lambda turns: "".join(f"<{r}>{t}" for r, t in turns) + "</end>"
    assert chat_format.locate([("a", "x"), ("b", "y")], closing)[3]
    assert chat_format.locate([("a", "x"), ("b", "xx")])[2] == [(9, 10), (22, 24)]


@pytest.mark.parametrize("text", ["", "\\", "<\\", "[[\\\\<", "</s>", "a<b[c\\d"])
def test_escape_is_reversible(text):
    assert chat_format.unescape(chat_format.escape(text)) == text
    assert not any(c in chat_format.escape(text) for c in ("</s>", "[INST]", "[/INST]", "<<"))
