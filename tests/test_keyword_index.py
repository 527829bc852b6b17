"""The index gives the answers of the scan, and looks at few texts."""

import random

import pytest

from corpusloom.functions.text import query_tokens
from corpusloom.operators import keyword_index, search


def same(index, rows, query, k):
    got = keyword_index.search(index, query, k)
    want = search.keyword_search(rows, query, k)
    assert got.columns == want.columns
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [tuple(r) for r in want.orderBy("rank").collect()], query


@pytest.fixture(scope="module")
def rows(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").selectExpr("doc_id", "source AS heading", "text AS content")


def test_queries(spark, rows, monkeypatch):
    monkeypatch.setattr(keyword_index, "BLOCK_TEXTS", 16)
    monkeypatch.setattr(keyword_index, "FIRST", 2)
    index = keyword_index.build(rows.repartition(3))
    r = random.Random(4)
    words = sorted({w for x in rows.limit(60).collect() for w in query_tokens((x["content"] or "")[:400])})
    queries = [" ".join(r.choice(words) for _ in range(r.randint(1, 4))) for _ in range(7)] + [w[: r.randint(1, 4)] for w in r.sample(words, 3)]
    for k, query in enumerate([*queries, "src1", "the the thre", "zzzz qqqq", "e"]):
        same(index, rows, query, (3, 20, 500)[k % 3])


def test_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(keyword_index, "BLOCK_TEXTS", 2)
    monkeypatch.setattr(keyword_index, "CHARACTERS", 50)
    texts = [None, "", "请假制度 请假", "年假 leave leave LEAVE", "aaaa aa a", "İstanbul ß 😀a😀b", "x" * 3000 + " leave", "leave", "leave", "Leave policy 制"]
    rows = spark.createDataFrame([(k if k < 8 else 7, "Leave" if k % 4 == 3 else None, t) for k, t in enumerate(texts)], "doc_id long, heading string, content string")
    index = keyword_index.build(rows)
    for k, query in enumerate(("请假制度", "制", "leave", "leave", "leave leave a", "aa", "aaa", "ß istanbul", "xxxx leave", "nothing here", "", "!?", "policy 年假")):
        same(index, rows, query, (3, 1, 50)[k % 3])
    same(keyword_index.build(rows.limit(0)), rows.limit(0), "leave", 3)


def test_few_texts_are_looked_at(spark, monkeypatch):
    monkeypatch.setattr(keyword_index, "BLOCK_TEXTS", 32)
    monkeypatch.setattr(keyword_index, "FIRST", 2)
    r = random.Random(1)
    words = [a + b + c for a in "bcdfgh" for b in "aeiou" for c in "lmnprst"]
    rows = [(k, "", " ".join(r.choice(words) for _ in range(30)) + (" xylophone quartz" * (k % 7 + 1) if k % 100 == 0 else "")) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, heading string, content string")
    index, cost = keyword_index.build(df), {}
    same(index, df, "xylophone quartz", 5)
    keyword_index.search(index, "xylophone quartz", 5, cost)
    assert cost["texts"] == 3000 and cost["texts_read"] <= 30 and cost["characters_read"] * 50 < cost["characters"]


def test_codes():
    codes = keyword_index.run_codes
    assert codes("ab") == [] and len(codes("abcd")) == 2 and len(codes("aaaaa")) == 1 and len(codes("制")) == len(codes("制度")) == 1 and codes("制") != codes("制度")
    run, text, count = keyword_index.runs_of(["abab abab", "", "ab a制度", "bab"])
    found = {(int(a), int(b)): int(c) for a, b, c in zip(run, text, count, strict=True)}
    (aba,), (bab,), (one,), (two,) = codes("aba"), codes("bab"), codes("度"), codes("制度")
    assert found == {(aba, 0): 2, (bab, 0): 2, (bab, 3): 1, (one, 2): 1, (codes("制")[0], 2): 1, (two, 2): 1}
