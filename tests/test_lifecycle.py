"""Manifests of many files, grafted trees, versions, shards, resumed encoding, samples and cases of stores."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import encoders, text
from corpusloom.functions.vectors import cosine
from corpusloom.operators import corpus, memory, search, store, taxonomy
from corpusloom.sources import documents as sources


def test_manifest_of_many_files(spark):
    paths = spark.range(0, 400_000, 1, 8).select(F.concat(F.lit("p/"), F.sha1(F.col("id").cast("string"))).alias("path"))
    old = corpus.manifest(paths.where("crc32(path) % 4 = 0"), "path").cache()
    whole = corpus.manifest(paths, "path", old)
    for rows, n in ((old, old.count()), (whole, 400_000)):
        assert tuple(corpus.contiguous(rows).first()) == (n, n, n - 1, True)
    assert whole.join(old, ["doc_index", "path"]).count() == old.count()
    new = [r["path"] for r in whole.where(F.col("doc_index") >= old.count()).orderBy("doc_index").limit(1000).collect()]
    assert new == sorted(new)
    with pytest.raises(ValueError):
        corpus.manifest(paths, "path", old.where("doc_index <> 5"))


def test_empty_manifest(spark):
    none = spark.createDataFrame([], "path string")
    assert corpus.manifest(none, "path").count() == 0
    assert corpus.manifest(none, "path", corpus.manifest(none, "path")).count() == 0


TREE = {"it": {"name": "IT", "desc": "d", "children": {"net": {"name": "Net", "desc": "d", "children": {"lan": {"name": "Lan", "desc": "d"}}}}}}


def test_graft():
    found = [(3, "net", "lan", "Lan again", "x"), (2, "it", "net", "Net again", "y"), (1, None, "hr", "HR", "z"), (3, "gone", "q", "Q", "q"), (2, "hr", "hr_general", "More", "w")]
    tree, missing = taxonomy.graft(TREE, found)
    assert missing == ["gone"] and list(TREE) == ["it"] and list(TREE["it"]["children"]["net"]["children"]) == ["lan"]
    assert list(tree["it"]["children"]) == ["net", "net_2"] and list(tree["it"]["children"]["net"]["children"]) == ["lan", "lan_2"]
    assert tree["it"]["children"]["net_2"]["children"]["net_2_general"]["name"] == "Net again (General)"
    assert list(tree["hr"]["children"]) == ["hr_general", "hr_general_2"]
    assert list(tree["hr"]["children"]["hr_general"]["children"]) == ["hr_general_general"]
    nodes = taxonomy.flatten(tree)
    assert len({n[1] for n in nodes}) == len(nodes)
    assert {n[3] for n in nodes if not any(m[2] == n[1] for m in nodes)} == {3}
    assert taxonomy.free_key("a", {"a", "a_2"}) == "a_3"


def test_versions(spark, tmp_path):
    path, rows = f"file://{tmp_path}/t", spark.range(3)
    assert sources.read_latest(spark, path, seed=rows).count() == 3
    with pytest.raises(ValueError):
        sources.read_latest(spark, path)
    for v in (2, 10):
        sources.write_versioned(spark.range(v), path, v)
    assert sources.read_latest(spark, path).count() == 10 and sources.read_latest(spark, path, 2).count() == 2
    with pytest.raises(ValueError):
        sources.read_latest(spark, path, 3)


def test_shards_and_resume(spark, tmp_path):
    path = f"file://{tmp_path}/shards"
    rows = spark.createDataFrame([(i, f"text {i % 7}") for i in range(50)], "doc_index long, text string").withColumn("cache_key", text.cache_key(F.col("text"), "m"))
    encode = lambda r: encoders.encoder("hash-128")(r, "cache_key", "text")
    first = encode(rows.dropDuplicates(["cache_key"])).join(rows, "cache_key").select("doc_index", "embedding").where("doc_index < 20")
    store.write_shards(first, path, size=8)
    done = spark.read.parquet(path)
    with pytest.raises(ValueError, match="2, 3, 4, 5, 6"):
        store.read_shards(done, 50, size=8)
    cache = encode(rows.where("text = 'text 3'").limit(1))
    rest = store.resume(rows, done, cache, encode).cache()
    assert rest.count() == 30 and rest.where("source = 'cache'").count() == 4
    store.write_shards(rest.select("doc_index", "embedding"), path, size=8)
    whole = store.read_shards(spark.read.parquet(path), 50, size=8)
    assert whole.count() == 50 and whole.select("embedding").distinct().count() == 7
    assert store.resume(rows, whole, cache, encode).count() == 0


def test_encoders(spark):
    rows = spark.createDataFrame([(1, "alpha beta"), (2, "alpha BETA"), (3, "zzz"), (4, ""), (5, None)], "id long, t string")
    got = {r["id"]: r["embedding"] for r in encoders.hashed_vectors(rows, "id", "t").collect()}
    assert got[1] == got[2] != got[3] and not any(got[4]) and not any(got[5])
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-9
    pair = spark.createDataFrame([(got[1], got[3])], "a array<double>, b array<double>")
    assert pair.select(cosine(F.col("a"), F.col("b"))).first()[0] < 0.5
    with pytest.raises(ValueError):
        encoders.encoder("none")


def plain_counts(texts, size=128):
    """Counts by place, a token at a time."""
    places, out = {}, []
    for x in texts:
        low, counts = (x or "").lower(), [0] * size
        for t in [*low.split(), *(low[i : i + 2] for i in range(len(low) - 1))]:
            if t not in places:
                places[t] = int.from_bytes(hashlib.md5(t.encode()).digest()[:4], "big") % size
            counts[places[t]] += 1
        out.append(counts)
    return out


def test_counts_of_odd_texts_in_small_pieces(monkeypatch):
    r = random.Random(2)
    texts = ["".join(r.choice("abAB \n\t\x1c\u00a0\u3000.\u0130\u00df\u03a3\u6f22\u5b57\U0001f600") for _ in range(r.choice([0, 0, 1, 2, 3, 40, 200]))) for _ in range(120)]
    for slot_bits, chars, memory in ((20, 1 << 18, 500_000), (2, 7, 3), (4, 1, 1), (3, 100, 50)):
        for name, value in (("SLOT_BITS", slot_bits), ("CHARS", chars), ("MEMORY", memory)):
            monkeypatch.setattr(encoders, name, value)
        for some in (texts, ["", "", "ab", ""], [""], ["a"]):
            words, pairs = encoders._Words(128), encoders._Pairs(128)
            got = [c.tolist() for held in encoders._stretches(x.lower() for x in some) for c in encoders._counts(held, 128, words, pairs)]
            assert got == plain_counts(some)


def test_counting_new_words_does_not_look_at_all_known_ones(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(160)) for i in range(3000)]
    rows = spark.createDataFrame(list(enumerate([*texts, None])), "id long, t string").coalesce(1)
    rows = encoders.hashed_counts(rows, "id", "t")
    began = time.time()
    want = plain_counts([*texts, None])
    plain = time.time() - began
    began = time.time()
    got = {r["id"]: r["counts"] for r in rows.collect()}
    assert got == dict(enumerate(want)) and time.time() - began < 5 * plain + 5  # it was the square of the rows


def test_sample_meets_every_quota(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") < 15_000, "big").when(F.col("id") < 19_990, "mid").otherwise("few").alias("s"))
    for total in (3, 50, 7000, 30_000):
        plan = {r["s"]: r["quota"] for r in corpus.quotas(rows, ["s"], total).collect()}
        got = {r["s"]: r["count"] for r in corpus.stratified_sample(rows, ["s"], total, "id").groupBy("s").count().collect()}
        assert got == {k: v for k, v in plan.items() if v}


def test_ties_and_missing_hits(spark):
    old = spark.createDataFrame([(1, 5, [1.0], "old"), (2, 5, [1.0], "old")], "k long, v int, embedding array<double>, t string")
    new = spark.createDataFrame([(1, 5, [1.0], None), (2, 4, [1.0], "new")], old.schema)
    got = {r["k"]: r["t"] for r in corpus.upsert(old, new, "k", "v", blank=("t",)).collect()}
    assert got == {1: "", 2: "old"}
    hits = spark.createDataFrame([("a", 0.9)], "query_id string, cos double")
    asked = spark.createDataFrame([("a",), ("b",)], "query_id string")
    assert sorted(map(tuple, search.confident(hits, asked).collect())) == [("a", True, 0.1), ("b", False, None)]


def test_recent_turns_with_gaps(spark):
    r = random.Random(1)
    turns = [(c, t) for c in range(5) for t in sorted(r.sample(range(100_000), 40 if c else 2))]
    got = memory.recent_turns(spark.createDataFrame(turns, "conv_id int, turn int"), 3).collect()
    want = {(c, t) for c in range(5) for t in sorted(t for d, t in turns if d == c)[-3:]}
    assert {tuple(x) for x in got} == want


def test_labels_and_names(spark):
    one = spark.range(1)
    assert [one.select(text.count_label(F.lit(n))).first()[0] for n in (0, 999, 1000, 1500, 23000, 1049)] == ["0", "999", "1k", "1.5k", "23k", "1.0k"]
    assert one.select(text.safe_path(F.lit("..\\a/../b/./c"))).first()[0] == "a/b/c"
    assert one.select(text.named_title(F.lit(" \n "), F.lit("x/hr__leave-policy_one.md"))).first()[0] == "Leave Policy One"
    title, body = text.title_and_body(F.lit("\r\n Title \r\n\r\nbody\r\nmore \r\n"))
    assert tuple(one.select(title, body).first()) == ("Title", "body\nmore")


def test_latest_state_keeps_values(spark):
    log = spark.createDataFrame([(1, 1, "a", 1.0), (1, 2, None, 2.0), (2, 1, None, None)], "k int, at int, s string, v double")
    got = {r["k"]: (r["s"], r["v"], r["created_at"], r["updated_at"], r["n_events"]) for r in store.latest_state(log, "k", ["at"], ["s", "v"], "at").collect()}
    assert got == {1: ("a", 2.0, 1, 2, 2), 2: (None, None, 1, 1, 1)}
