"""Many patterns, evaluation sets, and windows over long conversations, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import evaluation, memory, patterns


def test_patterns_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(patterns, "PATTERNS", 7)
    r = random.Random(2)
    known = ["".join(r.choice("abcé漢😀") for _ in range(r.randint(1, 4))) for _ in range(30)] + ["aa", "aa", "", None]
    rows = [(i, "".join(r.choice("abcé漢😀") for _ in range(r.randint(0, 60)))) for i in range(40)] + [(40, None), (40, "aaa"), (None, "aa")]
    got = sorted((tuple(x) for x in patterns.found(spark.createDataFrame(rows, "id long, t string"), spark.createDataFrame(list(enumerate(known)), "name int, pattern string"), "id", F.col("t")).collect()), key=repr)
    want = []
    for i, t in rows:
        for k, p in enumerate(known):
            at = [x for x in range(len(t or "")) if p and t.startswith(p, x)]
            if at:
                want.append((i, k, len(at), at[0]))
    assert got == sorted(want, key=repr)


def test_ten_thousand_rules(spark):
    rules = [(k, f"key{k:05d}", f"tag{k % 700}") for k in range(10_000)] + [(10_000, "LEAVE", "hr"), (10_001, "leave", "default"), (10_002, "pol", "hr")]
    paths = [(i, f"a/Key{(i * 37) % 10_000:05d}/key{(i * 91) % 10_000:05d}_leave-Policy.md" if i % 3 else f"b/{i}.md") for i in range(300)] + [(300, None)]
    df = spark.createDataFrame(paths, "id long, path string")
    got = {r["id"]: r["tags"] for r in patterns.tagged(df, spark.createDataFrame(rules, "place int, keyword string, tag string"), ["default"], "id", "path").collect()}
    few = {k: t for _, k, t in rules[-3:]}
    assert {k: [t for t in v if not t.startswith("tag")] for k, v in got.items()} == {r["id"]: r["t"] or ["default"] for r in df.select("id", text.tagged(F.col("path"), few, ["default"]).alias("t")).collect()}
    for i, path in paths:
        want = [t for _, k, t in rules if path and k.lower() in path.lower()]
        assert got[i] == list(dict.fromkeys(["default", *want]))


QUERY = "id string, query string, category string, difficulty string, expected_document_id string, expected_source_path string, expected_heading string, expected_evidence array<string>, acceptable_documents array<struct<document_id:string,heading:string>>"


def test_evaluation_sets(spark):
    docs = spark.createDataFrame([("d1", "hr/a.md", "# Leave\nten days a year"), ("d2", "it/b.md", "# Net\nports"), ("d3", "x.md", None)], "document_id string, source_path string, content string")
    good = ("q1", "how many days", "direct", "easy", "d1", "hr/a.md", "Leave", ["ten days"], [("d2", "Net")])
    assert evaluation.problems(spark.createDataFrame([good], QUERY), docs, ["direct"], ["easy"]).count() == 0
    bad = [
        good, ("q1", "other", "odd", None, "d9", "hr/a.md", "Leave", None, None), ("q2", "how many days", "direct", "easy", "d2", "hr/a.md", "Nett", ["ports", "no"], [("d7", "x"), ("d1", "Gone")]),
        ("q3", "third", "direct", "easy", "d3", "x.md", None, [], None),
    ]
    got = sorted((r["id"], r["problem"], r["what"]) for r in evaluation.problems(spark.createDataFrame(bad, QUERY), docs, ["direct"], ["easy"]).collect() if r["what"] is not None)
    assert got == sorted([
        ("q1", "repeated id", "q1"), ("q1", "repeated query", "how many days"), ("q2", "repeated query", "how many days"), ("q1", "unknown category", "odd"), ("q1", "missing document", "d9"), ("q2", "other source path", "hr/a.md"),
        ("q2", "heading not in document", "Nett"), ("q2", "evidence not in document", "no"), ("q2", "missing acceptable document", "d7"), ("q2", "acceptable heading not in document", "Gone"),
    ])
    nulls = {(r["id"], r["problem"]) for r in evaluation.problems(spark.createDataFrame(bad, QUERY), docs, ["direct"], ["easy"]).where("what IS NULL").collect()}
    assert nulls == {("q1", "unknown difficulty"), ("q3", "heading not in document")}


def test_source_manifest(spark):
    import hashlib

    rows = [("q2", "hr/a.md", "Leave", ["ten"]), ("q1", " hr/a.md ", "Leave", None), ("q3", "it/b.md", "", ["x", "y"])]
    queries = spark.createDataFrame(rows, "id string, expected_source_path string, expected_heading string, expected_evidence array<string>")
    files = spark.createDataFrame([("hr/a.md", bytearray(b"one")), ("it/b.md", bytearray(b"two")), ("z", bytearray(b"z"))], "source_path string, content binary")
    got = {r["source_path"]: r for r in evaluation.source_manifest(queries, files).collect()}
    assert set(got) == {"hr/a.md", "it/b.md"} and got["hr/a.md"]["query_ids"] == ["q1", "q2"] and got["hr/a.md"]["expected_headings"] == ["Leave"] and got["it/b.md"]["expected_headings"] == []
    assert got["hr/a.md"]["expected_evidence"] == {"q2": ["ten"]} and got["it/b.md"]["content_hash"] == "sha256:" + hashlib.sha256(b"two").hexdigest()
    for path in ("", "/abs", "a/../b", "none.md"):
        with pytest.raises(ValueError):
            evaluation.source_manifest(spark.createDataFrame([("q", path, "", None)], queries.schema), files)


def test_a_very_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(memory, "STRETCH", 50)
    rows = [(1, t) for t in range(1000)] + [(2, t) for t in range(0, 90, 3)] + [(3, 5)] + [(k, 1) for k in range(4, 40)]
    df = spark.createDataFrame([(c, t, "user", f"{c}-{t}") for c, t in rows], "conv_id long, turn long, role string, text string").repartition(7)
    by = {}
    for c, t in rows:
        by.setdefault(c, []).append(t)
    for n in (1, 3, 49, 50, 70):
        got = {(r["conv_id"], r["turn"]): (r["context"], r["n_context"]) for r in memory.context_frame(df, n).collect()}
        assert len(got) == len(rows)
        for c, turns in by.items():
            for i, t in enumerate(turns):
                before = turns[max(0, i - n) : i]
                assert got[c, t] == ("\n".join(f"user: {c}-{x}" for x in before), len(before))


def test_stretches_spread(spark):
    turns = spark.range(0, 1_000_000, 1, 8).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    got = memory.context_frame(turns, 3)
    assert got.agg(F.sum("n_context"), F.count("*")).first() == (2_999_994, 1_000_000)
    sizes = memory.numbered(turns).groupBy(F.floor(F.col("_n") / memory.STRETCH)).count().agg(F.count("*"), F.max("count")).first()
    assert tuple(sizes) == (100, 10_000)
