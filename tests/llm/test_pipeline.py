"""The pipeline and the entry file: stages against plain Python, each on what the one before kept."""

import hashlib
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from trialloom.llm import pii, quality_model
from tests.llm import brute
from tests.llm.test_models import prose
from tests.llm.test_text_rules import mix_by_hand

ROOT = Path(entry.__file__).resolve().parent


def tables(documents, shipped, folder):
    draw = random.Random(12)
    rows, labels = [], []
    for i in range(160):
        bad = i % 4 == 0
        text = " ".join(w.upper() + "!!" for w in prose(draw, 60).split()) if bad else prose(draw, 80)
        if i % 5 == 0:
            text += " write to a%d@x.org or 10.0.0.%d" % (i, i % 250)
        rows.append((i, text, "en", draw.choice(["a", "b", None])))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(200 + i, rows[1][1] + " end" * (i % 2), "en", "a") for i in range(8)] + [(300, None, "en", "a")]
    documents(rows).write.parquet(f"{folder}/documents.parquet")
    shipped.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_pipeline_stage_by_stage(documents, shipped, tmp_path):
    folder = str(tmp_path)
    rows = tables(documents, shipped, folder)
    docs = shipped.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(shipped, docs, folder).write.parquet(f"{folder}/{number}")
        docs = shipped.read.parquet(f"{folder}/{number}")
        kept.append(docs.collect())
        assert number == 4 or docs.columns == columns, name
    quality, single, clean, mixed, tokens = kept

    scored = {r.doc_id: r.score for r in quality_model.classify(shipped.read.parquet(f"{folder}/documents.parquet"), shipped.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert {r.doc_id for r in quality} == {d for d, s in scored.items() if s >= 0.7}
    sound = {i for i in range(160) if i % 4}
    assert len({r.doc_id for r in quality} & sound) >= 0.97 * len(sound) and len({r.doc_id for r in quality} - sound) < 20

    parts = brute.components([(r.doc_id, r.text) for r in quality])
    assert sorted(r.doc_id for r in single) == sorted(d for d, (_, c) in parts.items() if c == d)

    texts = {r.doc_id: r.text for r in single}
    for r in clean:
        given = texts[r.doc_id]
        spans = ",".join(f"{k}:{s}:{e}" for k, s, e in brute.personal_data(given or ""))
        assert r.text == (pii.redact(given, spans) if spans else given) and "@" not in (r.text or "")
        assert r.n_chars == len(r.text or "")

    taken = dict(zip((r.doc_id for r in clean), mix_by_hand([(r.doc_id, r.text, r.lang, r.source) for r in clean]), strict=True))
    count = Counter(r.doc_id for r in mixed)
    assert {d: n * taken[d][0] for d, n in count.items()} == {d: v[3] for d, v in taken.items() if v[3]}

    encoding = brute.encoding()
    want = []
    for r in mixed:
        ids = encoding.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, tokens)) == sorted(want)
    assert len(rows) > len(quality) > len(single)


def test_third_stage_takes_what_reveals_a_value_of_one_text(documents, shipped, tmp_path):
    draw = random.Random(3)
    rows = [(i, prose(draw, 80)) for i in range(60)] + [(90, prose(draw, 80) + " zanzibar write to boss@corp.example.org")]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    clean = {r.doc_id: r.text for r in corpus_pipeline.sanitise(shipped, shipped.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    assert "zanzibar" not in clean[90] and "[EMAIL]" in clean[90] and clean[5] == rows[5][1]


def test_pipeline_of_no_rows(documents, shipped, tmp_path):
    documents([]).write.parquet(f"{tmp_path}/documents.parquet")
    shipped.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(shipped, str(tmp_path)).count() == 0


def test_entry_lists_all_operators_and_the_pipeline():
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {f"{x.partition('_')[0]}_" for x in names if x.startswith("op")} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names and {"op3_mixing", "op10_quality_rules"} <= set(entry.oracle_sql())


def test_entry_works_without_the_corpus_package(tmp_path):
    for name in ("__spark_entry__.py", "trialloom"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else (tmp_path / name).mkdir()
    for part in (ROOT / "trialloom").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (tmp_path / "trialloom" / part.name).symlink_to(part)
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; assert 'sc_pairs' in e.queries() and not any(x.startswith('op') for x in e.queries()); print('ok')"
    code = code.replace("import __spark_entry__ as e", "import importlib.util as u; s = u.spec_from_file_location('entry', '__spark_entry__.py'); e = u.module_from_spec(s); s.loader.exec_module(e)")
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "ok", done.stderr
