from trialloom.sources.registry import read_registry
from trialloom.streaming.folder_import import import_folder, version_path
from xml_documents import document, trial


def test_files_become_versions(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()

    def run():
        query = import_folder(spark, str(folder), store, str(tmp_path / "checkpoint"), "REG")
        query.awaitTermination()
        assert query.exception() is None

    (folder / "a.xml").write_text(document(trial("A", public_title="one"), trial("B")))
    run()
    (folder / "b.xml").write_text(document(trial("A", public_title="two"), trial(" "), trial("C")))
    run()
    run()
    latest = read_registry(spark, version_path(store, 1))
    got = sorted((r.id, r.trial_id, r.public_title) for r in latest["trial"].collect())
    assert got == [(1, "A", "two"), (2, "B", "Untitled trial"), (5, "C", "Untitled trial")]
    assert latest["trial_review"].count() == 4
    assert latest["trial_public_snapshot"].filter("is_current").count() == 3
    assert spark.read.parquet(f"{version_path(store, 1)}/import_quarantine").count() == 1
