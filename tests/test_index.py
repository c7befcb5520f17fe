"""Change detection, upsert, store and streaming."""

from pyspark.sql import functions as F

from lexmill.operators import index as I
from lexmill.plans import pipelines
from lexmill.streaming import ingest


def test_two_snapshots(spark):
    manifest = spark.createDataFrame([("a", "1", "2024", 1, 5), ("a", "0", "2023", 1, 5), ("b", "1", "2024", 1, 5), ("gone", "9", "2024", 1, 5), ("broken", "1", "2024", 1, 5)], I.MANIFEST)
    scan = spark.createDataFrame([("a", "1", 5), ("b", "2", 6), ("c", "3", 7), ("x", None, 8), ("broken", "2", 9)], "source_file string, content_hash string, file_size long")
    changes = I.classify(scan, manifest)
    assert {r.source_file: r.status for r in changes.collect()} == {"a": "unchanged", "b": "modified", "c": "new", "x": "failed", "broken": "modified"}
    old = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "b"), ("4", "gone"), ("5", "broken")], "id string, source_file string")
    rows = spark.createDataFrame([("6", "b"), ("7", "c"), ("8", "a")], "id string, source_file string")
    assert sorted(r.id for r in I.upsert(old, rows, changes).collect()) == ["1", "4", "5", "6", "7"]
    assert sorted(r.id for r in I.upsert(old, rows, changes, purge_missing=True).collect()) == ["1", "5", "6", "7"]
    after = {r.source_file: (r.content_hash, r.document_count) for r in I.new_manifest(manifest, changes, rows, F.lit("now")).collect()}
    assert after == {"a": ("1", 1), "b": ("2", 1), "c": ("3", 1), "gone": ("9", 1), "broken": ("1", 1)}
    s = I.import_stats(changes, rows).first()
    assert (s.scanned_files, s.new_files, s.modified_files, s.unchanged_files, s.failed_files, s.added_chunks, s.success_rate) == (5, 1, 1, 1, 2, 2, 40.0)


def test_store_and_import(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('[{"text": "利率条款", "metadata": {"source": "a.docx", "chunk_index": 9}}, {"text": ""}]', encoding="utf-8")
    (folder / "bad.json").write_text("{", encoding="utf-8")
    store = I.Store(spark, str(tmp_path / "root" / "main"))
    assert not store.exists() and I.collections(spark, str(tmp_path / "root")) == []
    store.create("main", "hashing")
    first = pipelines.import_folders(spark, store, [str(folder), str(tmp_path / "missing")], "t1").first()
    assert (first.scanned_files, first.new_files, first.failed_files, first.added_chunks) == (2, 1, 1, 1)
    row = store.index().first()
    assert (row.document, row.chunk_index, row.total_chunks, row.file_name) == ("利率条款", 0, 2, "a.json") and len(row.embedding) == 64
    again = pipelines.import_folders(spark, store, [str(folder)], "t2").first()
    assert (again.unchanged_files, again.added_chunks) == (1, 0) and store.index().count() == 1
    (folder / "a.json").write_text('[{"text": "还款条款"}, {"text": "担保条款"}]', encoding="utf-8")
    third = pipelines.import_folders(spark, store, [str(folder)], "t3").first()
    assert third.modified_files == 1 and sorted(r.document for r in store.index().collect()) == ["担保条款", "还款条款"]
    assert I.open_collection(spark, str(tmp_path / "root"), "other").path.endswith("main")
    answer = pipelines.review(spark, store, "担保条款", lambda: lambda p: f"见{len(p)}").first()
    assert "担保条款" in answer.retrieved_knowledge and answer.response.startswith("见")
    assert pipelines.simple_review(spark, "x", lambda: lambda p: p).first().response.startswith("请审查以下")


def test_stream(spark, tmp_path):
    schema = "id string, document string, source_file string, content_hash string"
    store = I.Store(spark, str(tmp_path / "store"))
    store.commit(spark.createDataFrame([], "id string, document string, source_file string"), spark.createDataFrame([], I.MANIFEST))
    source = str(tmp_path / "source")
    spark.createDataFrame([("1", "x", "f", "h1"), ("2", "y", "g", "h1")], schema).write.parquet(source)
    for _ in range(2):
        ingest.ingest(ingest.stream_chunks(spark, source, schema), store, str(tmp_path / "check"), "now").awaitTermination()
    assert sorted(r.id for r in store.index().collect()) == ["1", "2"]
    spark.createDataFrame([("3", "z", "f", "h2")], schema).write.mode("append").parquet(source)
    ingest.ingest(ingest.stream_chunks(spark, source, schema), store, str(tmp_path / "check"), "now").awaitTermination()
    assert sorted(r.id for r in store.index().collect()) == ["2", "3"]


def test_commit_is_whole_or_not_at_all(spark, tmp_path):
    """A job lost before its commit file leaves the state before; nothing of it is read, and its number is free again."""
    schema = "id string, document string, source_file string"
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    manifest = spark.createDataFrame([("f", "1", "t", 1, 1)], I.MANIFEST)
    store = I.Store(spark, str(tmp_path / "s"))
    store.commit(rows(("1", "x", "f"), ("2", "y", "g")), manifest)
    text, store._text = store._text, None
    try:
        store.apply(rows(("3", "z", "f")), spark.createDataFrame([("f", "modified")], "source_file string, status string"), manifest)
        raise AssertionError
    except TypeError:
        pass
    store._text = text
    assert store.current() == 1 and sorted(r.id for r in store.index().collect()) == ["1", "2"] and store.manifest().count() == 1
    store.apply(rows(("4", "z", "f")), spark.createDataFrame([("f", "modified")], "source_file string, status string"), manifest)
    assert store.current() == 2 and sorted(r.id for r in store.index().collect()) == ["2", "4"]
    try:
        store._text("commits/2", "{}", once=True)
        raise AssertionError
    except FileExistsError:
        pass


def test_only_touched_buckets_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(str(k), "t", f"f{k}") for k in range(200)], "id string, document string, source_file string")
    empty = spark.createDataFrame([], I.MANIFEST)
    store = I.Store(spark, str(tmp_path / "s"))
    store.commit(rows, empty)
    changes = spark.createDataFrame([("f7", "modified"), ("new", "new"), ("f9", "unchanged")], "source_file string, status string")
    fresh = spark.createDataFrame([("x7", "t", "f7", 1), ("n", "t", "new", 2), ("no", "t", "f9", 3)], "id string, document string, source_file string, extra int")
    assert {(r.source_file, r.deleted, r.added) for r in I.replaced_counts(store.index(), fresh, changes).collect()} == {("f7", 1, 1), ("new", 0, 1)}
    store.apply(fresh, changes, empty)
    written = [p.name for p in (tmp_path / "s" / "data" / "2").iterdir() if p.name.startswith("bucket=")]
    assert 1 <= len(written) <= 2
    want = {str(k) for k in range(200) if k != 7} | {"x7", "n"}
    assert {r.id for r in store.index().collect()} == want and {r.extra for r in store.index().collect()} == {None, 1, 2}
    store.vacuum()
    assert {r.id for r in store.index().collect()} == want and not (tmp_path / "s" / "commits" / "1").exists()
    store.apply(fresh.limit(0), spark.createDataFrame([("f1", "unchanged")], "source_file string, status string"), empty, purge_missing=True)
    assert {r.id for r in store.index().collect()} == {"1"}
