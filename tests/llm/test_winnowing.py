"""Decontamination where hashes collide, where nothing is broadcast, with short items and items without a name."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, shared

SCHEMA = "doc_id long, text string"


def brute(text, items):
    def words(t):
        return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        n = min(10, len(b))
        windows = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                found.add(item)
    ids = ",".join(sorted(x for x in found if x is not None))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(5)
    items = [(f"i{k}", " ".join(r.choice("abcdefgh") for _ in range(r.choice((1, 3, 9, 10, 11, 40))))) for k in range(12)]
    items += [(None, "p q r s t u v w x y z"), ("e", ""), ("n", None), ("i1", "p q r s t u v w x y z"), ("same", "a " * 30)]
    docs = []
    for k in range(60):
        t = [r.choice("abcdefghXYZ") for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            own = (r.choice(items)[1] or "").split()
            a = r.randint(0, max(0, len(own) - 10))
            at = r.randint(0, len(t))
            t[at:at] = own[a : a + r.randint(8, 14)]
        docs.append((k, r.choice((" ", ", ", "\n")).join(t)))
    docs += [(7, docs[7][1]), (7, "A " * 500), (None, docs[3][1]), (90, None), (91, "")]
    return docs, items


def check(spark, docs, items):
    found = decontaminate.contamination(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id string, text string"))
    want = collections.Counter((d, *brute(t, items)) for d, t in docs)
    got = collections.Counter(map(tuple, found.collect()))
    assert got == want, ([(k[:4], n) for k, n in (got - want).items()][:5], [(k[:4], n) for k, n in (want - got).items()][:5])


def test_brute_force(spark, tables):
    check(spark, *tables)


def test_long_items_only(spark, tables):
    check(spark, tables[0], [x for x in tables[1] if len((x[1] or "").split()) >= 10])


def test_colliding_hashes(spark, tables, monkeypatch):
    monkeypatch.setattr(decontaminate, "hashes", lambda w: F.transform(w, lambda x: (F.ascii(x) % 3).cast("long")))
    check(spark, *tables)


def test_without_broadcast(spark, tables, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check(spark, *tables)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_fewer_rows_than_words(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = docs.select("doc_id", decontaminate.words(F.col("text")).alias("w"))
    rows = decontaminate.fingerprints(rows.select("doc_id", "w", decontaminate.hashes(F.col("w")).alias("h")), ["doc_id"], [])
    n, joined = rows.select(F.size("r").alias("n")).agg(F.sum("n")).first()[0], docs.select(F.size(decontaminate.words(F.col("text"))).alias("n")).agg(F.sum("n")).first()[0]
    assert n < 0.36 * joined


def test_clashing_columns(spark, tables):
    docs, items = tables
    names = ["w", "h", "r", "f", "_id", "class", "item_id"]
    t = spark.createDataFrame(docs, SCHEMA).select("doc_id", "text", *(F.lit(1).alias(c) for c in names))
    kept = decontaminate.clean(t, spark.createDataFrame(items, "item_id string, text string"))
    assert kept.columns == t.columns
    assert collections.Counter(r["text"] for r in kept.collect()) == collections.Counter(t for _, t in docs if not brute(t, items)[4])
