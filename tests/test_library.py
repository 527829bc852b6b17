"""Verbs, registries, the table function, exchange files, and turns with a memory."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom import library as lib
from corpusloom.functions import encoders
from corpusloom.functions.vectors import cosine
from corpusloom.operators import chunking, keyword_index, memory, turns
from corpusloom.sources import exchange


@pytest.fixture(scope="module")
def library(spark):
    docs = [(f"d{k}", t, "ann", "2026-01-01", tags, f"hr/{k}.md", c) for k, (t, tags, c) in enumerate([("Leave policy", ["HR"], "# Leave\nten days of leave a year"), ("Network", ["it", "net"], "# Net\nopen ports and cables"), ("Leaving", [], "# Exit\nreturn the laptop")])]
    documents = spark.createDataFrame(docs, "document_id string, title string, author string, created_at string, tags array<string>, source_path string, content string")
    made = chunking.chunk_documents(documents, "document_id", "content")
    chunks = made.join(documents.select("document_id", "title", "source_path"), "document_id").select("chunk_id", "document_id", "title", F.element_at("heading_path", -1).alias("heading"), "content", "source_path")
    chunks = chunks.join(encoders.encoder("hash-128")(chunks, "chunk_id", "content"), "chunk_id")
    return lib.Library(documents, chunks.cache())


def test_verbs(library):
    page, total = lib.list_documents(library, "leav")
    assert total == 2 and [r["document_id"] for r in page.collect()] == ["d0", "d2"]
    assert lib.list_documents(library, tag="NET")[1] == 1 and lib.list_documents(library, number=2, size=2)[0].count() == 1
    assert lib.get_document(library, "d1").first()["content"].startswith("# Net") and lib.get_document(library, "x").count() == 0
    hit = lib.query_documents(library, "leave year").orderBy("rank").first()
    assert hit["document_id"] == "d0" and hit["rank"] == 1 and hit["heading"] == "Leave"
    near = lib.search_knowledge(library, "open ports and cables", 2).orderBy("rank").collect()
    assert near[0]["document_id"] == "d1" and near[0]["distance"] == 0.0 and near[0]["score"] == 1.0 and len(near) == 2
    got = lib.ask(library, "open ports and cables", 1).first()
    assert got["confident"] and got["context"] == "open ports and cables" and got["sources"] == ["hr/1.md"]
    assert tuple(lib.ask(library, "zzzzqqqq xyxyxy", 2).first())[0::2] == (False, "")
    indexed = lib.Library(library.documents, library.chunks, index=keyword_index.build(library.chunks, "chunk_id"))
    assert [tuple(r) for r in lib.query_documents(indexed, "leave laptop", 3).orderBy("rank").collect()] == [tuple(r) for r in lib.query_documents(library, "leave laptop", 3).orderBy("rank").collect()]
    with pytest.raises(ValueError):
        lib.retrieve(library, "x", 1, "none")
    lib.RETRIEVERS["first"] = lambda own, query, k: own.chunks.orderBy("chunk_id").limit(k).select("chunk_id", F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    assert lib.retrieve(library, "x", 1, "first").first()["document_id"] == "d0"


def test_browsing(spark):
    rows = spark.createDataFrame([(1, "ASSIGNED", "a > b > c"), (2, "PARTIAL", "a > b"), (3, "PARTIAL", "a"), (4, "UNKNOWN", ""), (5, "PARTIAL", "ab > x")], "doc_id long, status string, path string")
    assert [r["doc_id"] for r in lib.browse(rows, "a").collect()] == [1, 2, 3] and lib.browse(rows).count() == 5
    assert {r["name"]: r["n"] for r in lib.categories(rows).collect()} == {"a": 3, "ab": 1, None: 1}
    assert {r["name"]: r["n"] for r in lib.categories(rows, "a").collect()} == {"b": 2, None: 1}


def test_table_function(spark, data):
    lib.register(spark)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    docs.createOrReplaceTempView("docs_for_chunks")
    for counter in ("words", "quarters"):
        got = spark.sql(f"SELECT * FROM chunks(TABLE(SELECT doc_id, text FROM docs_for_chunks), '{counter}')")
        want = chunking.chunk_documents(docs, counter=counter).withColumn("doc", F.col("doc_id").cast("string")).select(got.columns)
        assert got.count() == want.count() > 150 and got.exceptAll(want).count() == 0


def test_counted_once():
    """Spans' tokens by places are those of the slices."""
    r = random.Random(3)
    for _ in range(40):
        text = "".join(r.choice(["word ", "word. ", "a.b ", "\n\n", "# Head\n", "漢字。", "!", "  ", "x" * 30 + " "]) for _ in range(r.randint(1, 3000)))
        assert chunking.rich_chunks(text) == chunking.rich_chunks(text, lambda x: chunking.count_tokens(x))


def test_embeddings_as_files(spark, tmp_path):
    old = [{"chunk_id": "c1", "document_id": "d1", "title": "T", "heading": None, "content": "x", "source_path": "a/b", "embedding": [1.0, 2.0]}]
    new = [old[0] | {"chunk_id": f"c{k}", "document_id": "d2", "chunk_index": k, "heading_path": ["A", "B"], "offsets": [0, 5], "document_metadata": {"k": "v"}} for k in (11, 10)]
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "old.json").write_text(json.dumps(old, indent=2))
    (tmp_path / "in" / "sub" / "new.json").write_text(json.dumps(new, ensure_ascii=False))
    rows = exchange.read_embeddings(spark, f"file://{tmp_path}/in")
    got = {r["chunk_id"]: r for r in rows.collect()}
    assert len(got) == 3 and got["c1"]["chunk_version"] == "v1" and got["c1"]["heading_path"] == [] and got["c1"]["document_metadata"] == {} and got["c1"]["chunk_index"] == 0 and got["c1"]["version"] is None
    assert got["c10"]["offsets"] == [0, 5] and got["c10"]["document_metadata"] == {"k": "v"} and got["c10"]["file"].endswith("new.json")
    exchange.write_embeddings(rows.drop("file"), f"file://{tmp_path}/out")
    lines = [json.loads(x) for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert sorted([c["chunk_id"] for c in line] for line in lines) == [["c1"], ["c10", "c11"]]
    for f in (tmp_path / "out").glob("part-*.txt"):
        f.rename(f.with_suffix(".json"))
    again = exchange.read_embeddings(spark, f"file://{tmp_path}/out").drop("file")
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.drop("file").collect()))
    assert exchange.read_embeddings(spark, f"file://{tmp_path}/none").count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text(json.dumps([{"chunk_id": "c", "title": "T"}]))
    with pytest.raises(Exception, match="a chunk lacks document_id, content"):
        exchange.read_embeddings(spark, f"file://{tmp_path}/bad").collect()


def test_matches_and_labels(spark, tmp_path):
    anchors = spark.createDataFrame([(0, 1, "a", None), (1, 2, "b", "a"), (2, 3, "c", "b"), (3, 3, "d", "b")], "ord int, level int, key string, parent_key string")
    rows = spark.createDataFrame([(1, "ASSIGNED", 3, "a > b > d", "d", 0.5, 0.6, 0.7123456), (2, "UNKNOWN", 0, "", "zz", 0.1, 0.1, 0.1)], "doc_id long, status string, depth int, path string, best_leaf string, l1_score double, l2_score double, l3_score double")
    got = {r["doc_id"]: tuple(r)[1:4] for r in exchange.match_rows(rows, anchors, "doc_id").collect()}
    assert got == {1: (0, 1, 3), 2: (-1, -1, -1)}
    names = spark.createDataFrame([(1, "x/1"), (2, "x/2"), (3, "x/3")], "doc_id long, rel_path string")
    counts = {r["status"]: (r["n"], r["percent"]) for r in exchange.write_labels(rows, names, f"file://{tmp_path}/labels").collect()}
    assert counts == {"ASSIGNED": (1, 33.3), "PARTIAL": (0, 0.0), "FALLBACK": (0, 0.0), "UNKNOWN": (2, 66.7)}
    lines = {x["doc_id"]: x for f in (tmp_path / "labels").glob("part-*") for x in map(json.loads, f.read_text().splitlines())}
    assert lines[1]["category_path"] == ["a", "b", "d"] and lines[1]["level_scores"]["L3"] == 0.712346 and lines[3]["classification_status"] == "UNKNOWN" and lines[3]["category_path"] == []
    fits = {1: {"value": 0.12345678, "method": "mixture", "reason": "r", "n": 5}, 2: {"value": 0.5, "method": "percentile", "reason": "s", "n": 6}}
    exchange.write_thresholds(spark, fits, f"file://{tmp_path}/t", 1, 9, {"model": "m"})
    assert [r["value"] for r in spark.read.parquet(f"{tmp_path}/t").orderBy("level").collect()] == [0.123457, 0.5]
    with pytest.raises(Exception, match="(?i)exists"):
        exchange.write_thresholds(spark, fits, f"file://{tmp_path}/t", 1, 9, {})


def test_recall_of_large_scopes(spark, monkeypatch):
    from corpusloom.functions import vectors

    monkeypatch.setattr(vectors, "SHARD_ROWS", 30)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 4)
    r = random.Random(6)
    rows = [(["hot", "s1", "s2"][0 if k % 2 else k % 3], k, [r.gauss(0, 1) for _ in range(4)]) for k in range(300)] + [("s1", 900, None), ("s1", 901, [0.0] * 4), ("hot", 902, [1.0, 0.0, 0.0, 0.0]), ("hot", 903, [1.0, 0.0, 0.0, 0.0])]
    vecs = spark.createDataFrame(rows, "scope string, vec_id long, embedding array<double>")
    asked = vecs.where("vec_id % 9 = 0 AND embedding IS NOT NULL").select(F.col("vec_id").alias("query_id"), "scope", F.col("embedding").alias("asked"))
    memories = vecs.select("vec_id", F.when(F.col("vec_id") % 7 == 0, "deprecated").otherwise("active").alias("status"))
    got = sorted(map(tuple, memory.recall(vecs, asked, memories, 5).collect()))
    near = vecs.join(asked, "scope").where("query_id <> vec_id").select("query_id", "vec_id", F.round(cosine(F.col("asked"), F.col("embedding")), 6).alias("cos"))
    want, by = [], {}
    for x in near.collect():
        by.setdefault(x["query_id"], []).append((-x["cos"], x["vec_id"]))
    for q, hits in by.items():
        want += [(q, v, -c, k + 1) for k, (c, v) in enumerate(sorted(hits)[:5]) if v % 7]
    assert [(q, v, k) for q, v, _, k in got] == [(q, v, k) for q, v, _, k in sorted(want)] and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, sorted(want)))


def test_turns_with_a_memory(spark):
    said = [(1, 0, "user", "what about my leave days"), (1, 1, "assistant", "ten a year"), (1, 2, "user", "thanks"), (2, 0, "user", "hello"), (9, 4, "user", "I have a dog called Rex")]
    table = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    known = [(10, "the dog is called Rex", "active", 9, 4, "ann"), (11, "leave days are ten", "active", None, None, "ann"), (12, "the dog is called Max", "deprecated", 9, 4, "ann"), (13, "the dog is called Bo", "active", 9, 4, "bob")]
    memories = spark.createDataFrame(known, "vec_id long, text string, status string, source_conv long, source_turn long, scope string")
    encode = encoders.encoder("hash-128")
    vecs = encode(memories, "vec_id", "text").join(memories.select("vec_id", "scope"), "vec_id")
    asked = spark.createDataFrame([(1, 3, "ann", "and which?"), (2, 1, "ann", "what is the dog called then"), (3, 0, "bob", "what is the dog called then"), (4, 0, "eve", "anything?")], "conv_id long, turn long, scope string, text string")
    got = {r["conv_id"]: r for r in turns.answered(asked, table, memories, vecs, encode, n=2, k=2).collect()}
    assert got[1]["query"] == "thanks and which?" and got[1]["n_recent"] == 2 and got[2]["query"] == "what is the dog called then"
    assert got[2]["memories"] in ([10], [10, 11], [11, 10]) and 12 not in got[2]["memories"] and got[3]["memories"] == [13] and got[4]["memories"] == []
    assert got[2]["prompt"].startswith("Known:\n- the dog is called Rex (source: user: I have a dog called Rex)") and "Recent:\nuser: hello\n\nQuestion: what is" in got[2]["prompt"]
    assert got[4]["prompt"] == "Question: anything?" and got[1]["prompt"].split("Recent:\n")[1].startswith("assistant: ten a year\nuser: thanks")
    store = spark.createDataFrame([], "key string, scope string, content string, source_conv long, source_turn long, created_at long")
    new = spark.createDataFrame([(True, "ann", " likes tea ", 1, 2, 5), (True, "ann", " ", 1, 2, 5), (False, "ann", "no", 1, 2, 5), (True, "bob", "likes tea", 1, 2, 6)], "should_store boolean, scope string, content string, source_conv long, source_turn long, created_at long")
    once = turns.remembered(store, new)
    assert sorted((r["scope"], r["content"]) for r in once.collect()) == [("ann", "likes tea"), ("bob", "likes tea")] and all(len(r["key"]) == 16 for r in once.collect())
    assert sorted(map(tuple, turns.remembered(once, new).collect())) == sorted(map(tuple, once.collect()))


def test_digest_vectors(spark):
    import hashlib
    import struct

    def plain(t):
        raw = (hashlib.sha256(t.encode()).digest() * 48)[: 384 * 4]
        v = [f if f == f and abs(f) < 1e30 else 0.0 for f in struct.unpack("384f", raw)]
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v]

    texts = [f"text {k}" for k in range(40)] + ["", "é"]
    rows = spark.createDataFrame([*enumerate(texts), (99, None)], "id long, t string")
    got = {r["id"]: r["embedding"] for r in encoders.encoder("digest-384")(rows, "id", "t").collect()}
    for k, t in enumerate(texts):
        assert max(abs(a - b) for a, b in zip(got[k], plain(t), strict=True)) < 1e-12
    assert got[99] == got[40]


def test_files_in_order(spark):
    from corpusloom.sources import documents

    paths = ["b/x.md", "a/z.md", "a/b/c.md", "a-b/y.md", "top.md", "a/b.md"]
    rows = spark.createDataFrame([(p, i) for i, p in enumerate(paths * 2)], "path string, i int")
    got = [tuple(r) for r in documents.listed(rows, "path", "i").collect()]
    assert [p for p, _ in got[::2]] == ["top.md", "a/b.md", "a/z.md", "a/b/c.md", "a-b/y.md", "b/x.md"] and all(a[0] == b[0] and a[1] < b[1] for a, b in zip(got[::2], got[1::2], strict=True))
