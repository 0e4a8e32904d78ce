"""The registered corpus queries over the smallest given tables, and their SQL."""

import glob
import numbers
import os

import duckdb
import pytest

from trialloom.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op2_nearest": ["query_id", "rank", "vec_id", "score"],
    "op3_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op4_token_store": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op5_chat_format": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op6_quality_model": ["doc_id", "held_out", "score", "predicted"],
    "op7_ngram_join": ["doc_id", "n_shingles", "component_id"],
    "op8_toxicity": ["doc_id", "severity", "grade", "is_toxic"],
    "op9_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op10_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op11_fill_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
    "op12_clusters": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
    "op13_url_rules": ["page_id", "host", "path", "rule", "verdict"],
}


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: float(v) if isinstance(v, numbers.Number) and not isinstance(v, bool) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    found = QUERIES[name](spark, FOLDER)
    assert found.columns[: len(COLUMNS[name])] == COLUMNS[name]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    rows = [tuple(r) for r in found.collect()]
    count = {"op2_nearest": 50, "op5_chat_format": None, "op12_clusters": None, "op13_url_rules": None}.get(name, 200)
    assert rows and (count is None or len(rows) == count)
    if name in ORACLES:
        duck = duckdb.connect()
        for path in glob.glob(f"{FOLDER}/*.parquet"):
            duck.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        result = duck.execute(ORACLES[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == sorted(found.columns)
        assert canonical(found.columns, rows) == canonical(names, result.fetchall())
