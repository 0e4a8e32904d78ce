"""N-gram Jaccard join against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from trialloom.llm import ngram_join
from trialloom.llm.common import hash_words, shingles
from tests.llm import brute


def text(draw, n, vocabulary=400):
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


def changed(draw, words, share):
    return " ".join(w if draw.random() > share else f"x{draw.randrange(10**6)}" for w in words.split(" "))


def corpus():
    draw = random.Random(7)
    common = text(draw, 60)
    rows, origin = [], text(draw, 120)
    rows += [(i, changed(draw, origin, 0.015 * (i % 4))) for i in range(60)]  # near copies, some linked only through others
    rows += [(100 + i, text(draw, 40) + " " + common) for i in range(40)]  # a passage that many share
    rows += [(200 + i, origin) for i in range(30)] + [(300 + i, text(draw, draw.randrange(1, 9), 3)) for i in range(60)]
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, "Ab c"), (404, "aB\tC"), (405, "É b"), (406, "é b")]
    rows += [(500, text(draw, 30_000)), (501, "")]
    rows += [(502, changed(draw, rows[-2][1], 0.005)), (503, rows[-2][1] + " more")]
    return rows


def test_components_equal_those_of_all_pairs(documents):
    rows = corpus()
    found = ngram_join.join(documents(rows)).collect()
    want = brute.components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert len(found) == len(rows) and len({c for _, c in want.values()}) < len(rows) - 50


def test_large_branches_go_leaf_by_leaf(documents, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAF", 8)
    monkeypatch.setattr(ngram_join, "NODE", 4)
    draw = random.Random(3)
    base = text(draw, 60)
    rows = [(i, changed(draw, base, 0.02 * (i % 3))) for i in range(40)]
    found = ngram_join.join(documents(rows))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute.components(rows)


def test_repeated_rows_null_ids_and_no_rows(documents):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, "other words that stand alone here")]
    found = sorted((r.doc_id or 0, r.component_id) for r in ngram_join.join(documents(rows)).collect())
    assert found == [(0, None), (1, 1), (1, 1), (2, 1), (3, 3)]
    kept = ngram_join.representatives(documents(rows))
    assert kept.columns == documents([]).columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3]
    assert ngram_join.join(documents([])).count() == 0


def brute_rows(rows):
    """(id, set size, component) of every row, where rows with one id are one document; and the groups of rows by text alone."""
    ids, sets = [d for d, _ in rows], [brute.shingle_set(t) for _, t in rows]
    linked = lambda a, b: bool(a & b) and 100 * len(a & b) >= 80 * len(a | b)

    def groups(same):
        label = list(range(len(rows)))
        changing = True
        while changing:
            changing = False
            for i in range(len(rows)):
                for j in range(i):
                    if label[i] != label[j] and same(i, j):
                        low = min(label[i], label[j])
                        label[i] = label[j] = low
                        changing = True
        return label

    by_id = groups(lambda i, j: linked(sets[i], sets[j]) or ids[i] == ids[j])
    by_text = groups(lambda i, j: linked(sets[i], sets[j]))
    least = {c: min(d for d, x in zip(ids, by_id, strict=True) if x == c) for c in by_id}
    return sorted((d, len(s), least[c]) for d, s, c in zip(ids, sets, by_id, strict=True)), by_text


def test_an_id_with_two_texts_loses_no_link(documents):
    draw = random.Random(5)
    a, b = text(draw, 60), text(draw, 60)
    rows = [(5, a), (5, b), (7, a + " more"), (3, b + " more")]
    found = ngram_join.join(documents(rows)).collect()
    assert {r.component_id for r in found} == {3}
    # The two texts are not near each other: one of each pair stays.
    kept = {(r.doc_id, r.text) for r in ngram_join.representatives(documents(rows)).collect()}
    assert kept == {(5, a), (3, b + " more")}


@pytest.mark.parametrize("seed", range(4))
def test_random_corpora_with_repeated_ids(documents, seed):
    draw = random.Random(seed)
    origins = [text(draw, draw.choice([3, 8, 40])) for _ in range(6)]
    rows = []
    for _ in range(90):
        t = draw.choice([*origins, "", None, text(draw, 20)])
        rows.append((draw.randrange(40), changed(draw, t, draw.choice([0, 0.01, 0.03])) if t else t))
    want, by_text = brute_rows(rows)
    found = ngram_join.join(documents(rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == want
    kept = [(r.doc_id, r.text) for r in ngram_join.representatives(documents(rows)).collect()]
    with_words = [r for r in kept if brute.shingle_set(r[1])]
    sets = {}
    for (d, t), c in zip(rows, by_text, strict=True):
        if brute.shingle_set(t):
            sets.setdefault(c, []).append((d, brute.shingle_set(t)))
    # One row of each group, with its smallest id and a text that this id has in the group.
    assert len(with_words) == len(sets)
    left = {c: {(d, s) for d, s in members if d == min(x for x, _ in members)} for c, members in sets.items()}
    for d, t in with_words:
        assert sum((d, brute.shingle_set(t)) in options for options in left.values()) == 1
    blank = {d for d, t in rows if not brute.shingle_set(t)}
    assert sorted(d for d, t in kept if not brute.shingle_set(t)) == sorted(blank)


def test_components_of_a_chain_and_a_star(shipped):
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    found = ngram_join.components(shipped.createDataFrame(chain + star, "a long, b long"))
    assert {r.node: r.comp for r in found.collect()} == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert ngram_join.components(shipped.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n", [1, 4, 5, 6, 300])
def test_hashed_shingles_count_like_sets(n):
    draw = random.Random(n)
    t = text(draw, n, 6)
    assert len(shingles(hash_words(t.encode().lower()))) == len(brute.shingle_set(t))
    assert len(hash_words(b"\x0b a\x0cb\r\n")) == 2 and not len(hash_words(b" "))


def test_bounds_never_prune_a_link():
    draw = random.Random(1)
    origin = text(draw, 100)
    sets = [ngram_join.text_set(changed(draw, origin, 0.01 * (i % 5))) for i in range(24)]
    width = max(len(ngram_join._bitmap(s)) for s in sets)
    same = [s for s in sets if len(ngram_join._bitmap(s)) == width]
    leaf = ngram_join._Leaf(np.arange(len(same)), np.array([len(s) for s in same]), np.arange(len(same)), np.stack([ngram_join._bitmap(s) for s in same]))
    order = np.argsort(leaf.n, kind="stable")
    leaf = ngram_join._Leaf(leaf.node[order], leaf.n[order], leaf.comp[order], leaf.bits[order])
    a, b, most = ngram_join.traverse(leaf, leaf, True)
    possible = {tuple(sorted((int(leaf.node[x]), int(leaf.node[y])))): int(m) for x, y, m in zip(a, b, most)}
    for i, s in enumerate(same):
        for j in range(i):
            both = len(np.intersect1d(s, same[j]))
            if 100 * both >= 80 * (len(s) + len(same[j]) - both):
                assert possible[(j, i)] >= both


def test_plan_has_no_cross_join(documents):
    plan = ngram_join.join(documents([(1, "a b c d e f g")]))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_branches_hold_only_classes_that_may_link():
    # (token, node, size, early): which members a token's branches keep.
    tokens = {
        1: [(10, 100, 1), (11, 200, 1)],  # sizes too far apart
        2: [(10, 100, 0), (11, 110, 0)],  # the smaller one has the token late
        3: [(10, 100, 1), (11, 110, 0), (12, 300, 1), (13, 310, 1), (14, 900, 1)],
        4: [(10, 100, 1), (11, 110, 0)],  # the members of a branch of token 3
        5: [(20, 100, 0), (21, 100, 1), (22, 90, 0)],  # of equal sizes either may be the smaller one
    }
    rows = [(token, node, 2 * n + early) for token, members in tokens.items() for node, n, early in members]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["token", "node", "marked"])
    found: dict[int, set] = {}
    for out in ngram_join._branches([batch.slice(0, 3), batch.slice(3)]):
        for branch, node, n in zip(*(c.to_pylist() for c in out.columns), strict=True):
            found.setdefault(branch, set()).add((node, n))
    assert sorted(map(sorted, found.values())) == [[(10, 100), (11, 110)], [(12, 300), (13, 310)], [(20, 100), (21, 100)]]


def test_the_first_shared_token_is_early_in_the_smaller_set():
    draw = np.random.default_rng(5)
    for _ in range(3000):
        order = draw.permutation(400)
        a = set(draw.choice(400, draw.integers(1, 80), replace=False).tolist())
        b = {x for x in a if draw.random() > 0.1} | set(draw.choice(400, draw.integers(0, 6)).tolist())
        if not b or 100 * len(a & b) < ngram_join.THRESHOLD * len(a | b):
            continue
        small, large = sorted((a, b), key=len)
        place = lambda s: sorted(order[x] for x in s)
        first = min(order[x] for x in a & b)
        early = len(small) * (100 - ngram_join.THRESHOLD) // (100 + ngram_join.THRESHOLD)
        assert early == len(small) - ngram_join.least_overlap(len(small), len(small))
        assert place(small).index(first) <= early
        assert place(large).index(first) < ngram_join._prefix_length(len(large))


def test_whole_texts_are_not_shuffled_to_the_kept_ids(documents):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words that stand alone here")]
    spark = documents([]).sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        kept = ngram_join.representatives(documents(rows))
        plan = kept._jdf.queryExecution().sparkPlan().toString()
        found = sorted(r.doc_id for r in kept.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == [1, 3]
    semi = [line for line in plan.splitlines() if "LeftSemi" in line and "_join_digest" not in line]
    assert any("BroadcastHashJoin" in line for line in semi)
