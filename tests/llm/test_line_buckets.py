"""Entries of lines in buckets, and small groups that are verified together, against brute force."""

import random

import numpy as np
import pytest

from corpusloom.llm import lines, links

DOCS = "doc_id long, text string"


def texts(seed, n, letters="abcdefghijkl"):
    r = random.Random(seed)
    return [(k, "\n".join(" ".join(r.sample(letters, r.randint(1, len(letters)))) for _ in range(4))) for k in range(n)]


def brute(docs, threshold):
    before, gone = [], set()
    for doc, text in docs:
        for k, line in enumerate(text.split("\n")):
            s = set(line.split())
            if any(100 * len(s & o) >= round(100 * threshold) * len(s | o) for o in before):
                gone.add((doc, k))
            before.append(s)
    return gone


@pytest.mark.parametrize(("held", "together", "block"), [(7, 5, 3), (1 << 17, 1 << 17, 1024)])
def test_buckets_change_nothing(spark, monkeypatch, held, together, block):
    for name, x in (("HELD", held), ("TOGETHER", together), ("LINE_BLOCK", block)):
        monkeypatch.setattr(lines, name, x)
    docs = texts(5, 30)
    got = {(x["doc_id"], k) for x in lines.removed_lines(spark.createDataFrame(docs, DOCS)).collect() for k in x["removed"]}
    assert got == brute(docs, 0.8) != set()


def test_entries_travel_many_a_row(spark):
    docs = [(k, "\n".join(f"the same {k}w{i} rare {k}x{i} words {k}y{i}" for i in range(400))) for k in range(4)]
    rows = lines._entries(spark.createDataFrame(docs, DOCS).coalesce(1), np.zeros(lines.SKETCH, np.uint8), 80, 100).collect()
    body = np.frombuffer(b"".join(bytes(r["bodies"]) for r in rows), lines._BODY)
    assert len(body) == 1600 * 2  # lines of seven words have two in their prefix
    assert len(rows) <= lines.BUCKETS and all(0 <= r["cell"] < lines.BUCKETS for r in rows)
    assert max(len(r["bodies"]) for r in rows) <= lines.ROW * lines._BODY.itemsize


def test_a_row_of_entries_is_bounded(monkeypatch):
    monkeypatch.setattr(lines, "ROW", 4)
    body = np.zeros(50, lines._BODY)
    body["cell"], body["id"] = np.array([1 << 40, 1 << 62], np.uint64)[np.arange(50) % 2], np.arange(50)
    got = [(c, bytes(x)) for part in lines._dealt([body[:20], body[20:]], 4) for c, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
    assert [c for c, _ in got] == [0] * 7 + [1] * 7
    assert all(len(x) <= 4 * body.itemsize for _, x in got)
    assert np.frombuffer(b"".join(x for _, x in got), lines._BODY)["id"].tolist() == [*range(0, 50, 2), *range(1, 50, 2)]


@pytest.mark.parametrize("pairs", [1, 1 << 21])
def test_pairs_of_a_cell(monkeypatch, pairs):
    monkeypatch.setattr(lines, "PAIRS", pairs)
    rng = np.random.default_rng(1)
    tied = []
    for four in (50, 80, 93):
        rows = np.zeros(300, lines._BODY)
        rows["cell"], rows["id"], rows["n"] = rng.integers(0, 40, 300), rng.integers(0, 90, 300), rng.integers(20, 60, 300)
        rows["at"] = rng.integers(0, 9, 300) * 4 + np.where(rows["cell"] % 2, rng.integers(1, 3, 300), 0)
        rows["map"] = rng.integers(0, 1 << 6, (300, 2))
        a, b = [], []
        for i in range(300):
            for j in range(i):
                x, y = rows[i], rows[j]
                n, m, p, q = int(x["n"]), int(y["n"]), int(x["at"]) >> 2, int(y["at"]) >> 2
                need = -(-four * (n + m) // (four + 100))
                apart = sum(int(u ^ v).bit_count() for u, v in zip(x["map"].tolist(), y["map"].tolist(), strict=True))
                sides = (int(x["at"]) & 3, int(y["at"]) & 3)
                if x["cell"] == y["cell"] and 100 * min(n, m) >= four * max(n, m) and min(n - p, m - q) >= need and (0 in sides or len(set(sides)) == 2) and apart <= n + m - 2 * need:
                    a.append(int(x["id"]))
                    b.append(int(y["id"]))
        want = links.least_labels(90, np.array(a), np.array(b))
        x, y = lines._tied(rows, four, 100)
        assert (links.least_labels(90, x, y) == want).all()
        tied.append(int((want != np.arange(90)).sum()))
    assert tied[1] > 5


def test_small_groups_together():
    rng = np.random.default_rng(0)
    for _ in range(100):
        sets, side, begins, want = [], [], [0], []
        for _ in range(rng.integers(1, 9)):
            base = rng.choice(30, 12, replace=False).astype(np.uint64)
            own = []
            for _ in range(rng.integers(2, 8)):
                x = base.copy()
                x[: rng.integers(0, 4)] += np.uint64(100 + rng.integers(0, 3))
                own.append(x[: rng.integers(8, 13)])
            of = rng.integers(1, 3, len(own)) if rng.random() < 0.5 else np.zeros(len(own), np.int64)
            want += [(begins[-1] + a, begins[-1] + b) for a, b in zip(*links._linked(own, of, 100, 80), strict=True)]
            sets, side = [*sets, *own], [*side, *of]
            begins.append(len(sets))
        got = links._few_linked(sets, np.array(side), np.array(begins), 100, 80)
        assert sorted(zip(*got, strict=True)) == sorted(want)


def test_few_and_many_give_the_same(spark, monkeypatch):
    r = random.Random(9)
    rows = [(k % 7, 6, bytes([k]), np.array(r.sample(range(k % 7, k % 7 + 12), r.randint(9, 12)), np.uint64).tobytes(), 1, (r.random(), k)) for k in range(40)]
    t = spark.createDataFrame(rows, "root int, n_group long, id binary, set binary, copies long, ord struct<x: double, k: int>")
    found = []
    for few in (0, 16):
        monkeypatch.setattr(links, "FEW", few)
        found.append(sorted((bytes(r["id"]), r["links"], r["later"]) for r in links.verified(t).collect()))
    assert found[0] == found[1] != []


def test_line_counts(spark, tmp_path):
    from corpusloom.llm.queries import op7_line_join

    rows = [(1, None), (2, ""), (3, "a"), (4, "a b\n"), (5, "\n\n"), (6, "é\r\nü\n\nß ﬁ\U0001f600")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["n_lines"] for r in op7_line_join(spark, str(tmp_path)).collect()} == {k: len((t or "").split("\n")) for k, t in rows}
