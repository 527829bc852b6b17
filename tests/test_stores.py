"""Stores under repeated and failed writes, guarded encoding, and rows with nulls."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import encoders, text
from corpusloom.operators import corpus, search, store
from corpusloom.session import exists


def vectors(spark, ids, value):
    return spark.createDataFrame([(i, [float(value), 3.0]) for i in ids], "doc_index long, embedding array<double>")


def state(spark, path):
    return sorted((r["doc_index"], tuple(r["embedding"])) for r in spark.read.parquet(path).collect())


def test_repeated_writes_change_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    assert store.write_shards(vectors(spark, range(10), 1), path, size=4, batch=1)
    first = state(spark, path)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "s").glob("shard=2/*.parquet")}
    assert not store.write_shards(vectors(spark, range(10), 9), path, size=4, batch=1) and state(spark, path) == first
    assert store.write_shards(vectors(spark, [3, 5, 5 + 7], 2), path, size=4, batch=2)  # touches shards 0, 1 and 3
    want = sorted([(i, (1.0, 3.0)) for i in range(10) if i not in (3, 5)] + [(i, (2.0, 3.0)) for i in (3, 5, 12)])
    assert state(spark, path) == want
    assert files == {p: p.stat().st_mtime_ns for p in (tmp_path / "s").glob("shard=2/*.parquet")}
    store.write_shards(vectors(spark, [3], 2), path, size=4)
    assert state(spark, path) == want and not exists(spark, f"{path}/_pending/batch=none")
    with pytest.raises(ValueError, match="several times"):
        store.write_shards(vectors(spark, [3, 3], 2), path, size=4)


@pytest.mark.parametrize("where", ["before", "within"])
def test_a_failed_write_is_made_good(spark, tmp_path, monkeypatch, where):
    path = f"file://{tmp_path}/s"
    store.write_shards(vectors(spark, range(10), 1), path, size=4, batch=1)
    finish = store._finish

    def fails(session, at, calls=[]):  # noqa: B006
        calls.append(1)
        if len(calls) > 1:
            if where == "within":  # a shard is gone, as when the committer stops half-way
                import shutil

                shutil.rmtree(tmp_path / "s" / "shard=0")
            raise OSError("stopped")
        finish(session, at)

    monkeypatch.setattr(store, "_finish", fails)
    with pytest.raises(OSError):
        store.write_shards(vectors(spark, [1, 4], 2), path, size=4, batch=2)
    monkeypatch.setattr(store, "_finish", finish)
    want = sorted([(i, (2.0 if i in (1, 4) else 1.0, 3.0)) for i in range(10)])
    assert not store.write_shards(vectors(spark, [1, 4], 2), path, size=4, batch=2)  # what was prepared is brought in
    assert state(spark, path) == want


def test_reads_check_rows_and_shapes(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store.write_shards(vectors(spark, range(8), 4), path, size=4)
    rows = spark.read.parquet(path)
    got = store.read_shards(rows, 8, size=4, dim=2)
    assert {tuple(round(x, 6) for x in r["embedding"]) for r in got.collect()} == {(0.8, 0.6)}
    with pytest.raises(ValueError, match="16 rows"):
        store.read_shards(rows.select("doc_index", "embedding").unionAll(rows.select("doc_index", "embedding")), 8, size=4)
    for bad in ([1.0], None, [1.0, None]):
        odd = spark.createDataFrame([(7, bad)], "doc_index long, embedding array<double>")
        with pytest.raises(ValueError, match="components"):
            store.read_shards(rows.where("doc_index < 7").select("doc_index", "embedding").unionByName(odd), 8, size=4)
    with pytest.raises(ValueError, match="components"):
        store.read_shards(rows, 8, size=4, dim=3)


def test_changes_name_their_columns(spark, tmp_path):
    path, columns = f"file://{tmp_path}/log", ["status", "error"]
    made = lambda rows, names: spark.createDataFrame(rows, f"task string, at long, {names}")
    assert store.record(path, made([("a", 1, "new"), ("b", 1, "new")], "status string"), "task", "at", columns, 1)
    assert store.record(path, made([("a", 2, "failed", "x")], "status string, error string"), "task", "at", columns, 2)
    assert not store.record(path, made([("a", 2, "failed", "x")], "status string, error string"), "task", "at", columns, 2)
    assert store.record(path, made([("a", 3, "done")], "status string"), "task", "at", columns, 3)
    with pytest.raises(ValueError, match="colour"):
        store.record(path, made([("a", 4, "red")], "colour string"), "task", "at", columns, 4)
    got = store.latest_state(spark.read.parquet(path), "task", ["at"], columns, "at").collect()
    assert {r["task"]: (r["status"], r["error"], r["n_events"]) for r in got} == {"a": ("done", "x", 3), "b": ("new", None, 1)}


def test_digests_of_prefixes(spark, monkeypatch):
    rows = spark.range(400_000).select(F.col("id").alias("i"), F.sha1(F.col("id").cast("string")).alias("v"))
    whole = store.ordered_digest(rows, "i", "v")
    assert whole == store.ordered_digest(rows.repartition(13).orderBy(F.desc("v")), "i", "v")
    part = store.ordered_digest(rows, "i", "v", upto=399_999)
    assert part != whole and part == store.ordered_digest(rows.where("i < 399999"), "i", "v")
    swapped = rows.withColumn("i", F.when(F.col("i") == 7, 300_000).when(F.col("i") == 300_000, 7).otherwise(F.col("i")))
    assert store.ordered_digest(swapped, "i", "v") != whole
    few = spark.createDataFrame([(0, None), (1, "")], "i long, v string")
    assert store.ordered_digest(few, "i", "v") != store.ordered_digest(few.select("i", F.lit("").alias("v")), "i", "v")
    assert store.ordered_digest(few.limit(0), "i", "v") == hashlib.sha256(b"").hexdigest()


def test_the_guard_at_size(spark, tmp_path):
    path, settings = f"file://{tmp_path}/state", {"model": "m", "dim": 4}
    rows = spark.range(400_000).select(F.col("id").alias("i"), F.sha1(F.col("id").cast("string")).alias("v"))
    first = store.guard(rows.where("i < 300001"), path, settings, "i", "v")
    assert (first["n"], first["version"]) == (300_001, 1)
    assert store.guard(rows.where("i < 300001"), path, settings, "i", "v") == first
    assert store.guard(rows, path, settings, "i", "v")["version"] == 2
    for bad, other in ((rows.where("i < 300001"), settings), (rows.withColumn("v", F.when(F.col("i") == 5, "x").otherwise(F.col("v"))), settings), (rows, settings | {"dim": 5}), (rows, {"model": "m"})):
        with pytest.raises(store.Changed):
            store.guard(bad, path, other, "i", "v")


def test_encoding_goes_on_where_it_was(spark, tmp_path):
    path, calls = f"file://{tmp_path}/e", []
    rows = spark.createDataFrame([(i, f"text {i % 9}") for i in range(50)], "doc_index long, text string").withColumn("cache_key", text.cache_key(F.col("text"), "m"))

    def encode(r):
        calls.append(r.count())
        return encoders.encoder("hash-128")(r, "cache_key", "text")

    go = lambda n, **more: store.encode_resumable(rows.where(F.col("doc_index") < n), path, {"model": "m"}, encode, size=8, **more)
    assert go(43, most=2) == {"total": 43, "before": 0, "new": 16, "complete": False}
    assert go(43) == {"total": 43, "before": 16, "new": 27, "complete": True}
    assert go(43) == {"total": 43, "before": 43, "new": 0, "complete": True} and calls[2] == 0
    assert go(50) == {"total": 50, "before": 43, "new": 7, "complete": True}
    whole = store.read_shards(spark.read.parquet(path), 50, size=8, dim=128)
    assert whole.count() == 50 and whole.select("embedding").distinct().count() == 9
    with pytest.raises(store.Changed):
        go(20)
    with pytest.raises(store.Changed):
        store.encode_resumable(rows, path, {"model": "other"}, encode, size=8)


def test_rows_without_content(spark):
    batch = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "a"), (5, "b")], "doc_id long, content_hash string")
    known = spark.createDataFrame([(0, "b"), (9, None)], batch.schema)
    got = {r["doc_id"]: (r["outcome"], r["kept"]) for r in store.import_outcomes(known, batch).collect()}
    assert got == {1: ("new", 1), 2: ("new", 2), 3: ("new", 3), 4: ("in_batch", 1), 5: ("in_store", 0)}
    old = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    new = spark.createDataFrame([(None, 3), ("x", 4), ("y", 5)], old.schema)
    assert sorted(map(tuple, store.insert_or_ignore(old, new, "k", "v").collect()), key=str) == [("x", 2), ("y", 5), (None, 1)]
    paths = spark.createDataFrame([(None,), ("b",), ("a",)], "path string")
    first = corpus.manifest(paths, "path")
    assert sorted(map(tuple, corpus.manifest(paths, "path", first).collect())) == sorted(map(tuple, first.collect())) and first.count() == 3
    texts = spark.createDataFrame([(1, None), (2, ""), (3, ""), (4, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["duplicate_of"] for r in corpus.exact_duplicates(texts).collect()} == {1: None, 2: None, 3: 2, 4: 1}


def test_ties_round_to_even(spark):
    terms = " ".join(f"t{k:02d}" for k in range(32))
    rows = spark.createDataFrame([(1, "", "t00 t01 t02"), (2, "", "t00 t01 t02 t03 t04")], "doc_id long, heading string, content string")
    got = {r["doc_id"]: r["score"] for r in search.keyword_search(rows, terms, 5).collect()}
    assert got == {1: round(0.17625, 4), 2: 0.2938} and got[1] == 0.1762
