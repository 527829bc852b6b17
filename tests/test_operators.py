"""Golden cases of parsers, chunkers, thresholds, clusters and streams."""

import numpy as np
from pyspark.sql import functions as F

from corpusloom.functions.text import query_tokens, search_tokens
from corpusloom.operators import chunking, discovery, taxonomy, thresholds
from corpusloom.sources import documents
from corpusloom.streaming import ingest


def test_front_matter_and_bad_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("---\ndocument_id: x\ntitle: T\ntags:\n  - hr\n  - leave\n---\n\n# T\nbody\n")
    (tmp_path / "b.yaml").write_text("---\ndocument_id: x\ntitle: U\ntags: [a, b]\n---\nlast wins")
    (tmp_path / "c.yaml").write_text("no front matter")
    out = {r["path"][-6:]: r for r in documents.parse_documents(documents.read_files(spark, str(tmp_path), "*.yaml")).collect()}
    assert set(out) == {"b.yaml", "c.yaml"}
    assert out["b.yaml"]["tags"] == ["a", "b"] and out["b.yaml"]["author"] == "unknown" and out["b.yaml"]["error"] is None
    assert out["c.yaml"]["error"] == "no front matter"


def test_html_lines():
    page = "<html><head><style>x</style><script>y</script></head><body><h1>A</h1><p>b <b>c</b></p><img src='i.png'><img alt='q' src='j'><table><tr><td>1</td><td>2</td></tr></table></body></html>"
    assert documents.html_lines(page).split("\n") == ["A", "b", "c", "[图片: image](i.png)", "[图片: q](j)", "1 | 2"]


def test_atx_headings():
    assert documents.atx_headings("A\n===\nB\n---\n- x\n---\n```\nC\n---\n```") == "# A\n## B\n- x\n---\n```\nC\n---\n```"


def test_chunks_are_slices_and_overlap():
    text = "intro\n\n# A\n\n" + "\n\n".join(f"Paragraph {i}. " + "word " * 90 for i in range(20)) + "\n\n## B\n\nshort\n"
    found = chunking.rich_chunks(text)
    assert all(text[c["start"] : c["end"]] == c["content"] and c["token_count"] <= 1100 + 132 for c in found)
    assert found[0]["heading_path"] == [] and found[-1]["heading_path"] == ["A", "B"]
    inner = [c for c in found if c["heading_path"] == ["A"]]
    assert len(inner) > 1 and all(b["start"] < a["end"] for a, b in zip(inner, inner[1:], strict=False))
    assert chunking.identity("d", 0, ["A"], "x") == chunking.identity("d", 0, ["A"], "x") != chunking.identity("d", 0, ["A"], "x", "2")
    assert chunking.simple_chunks("# A\n\n# B\nx") == [("B", "x")] and chunking.simple_chunks("") == []


def test_tokens(spark):
    for text in ("员工年假 Leave 2024", "年", "", "abc-DEF 工作日x9"):
        assert spark.range(1).select(search_tokens(F.lit(text))).first()[0] == query_tokens(text)


def test_threshold_guards(spark):
    rng = np.random.default_rng(1)

    def fit(x):
        return thresholds.fit(spark.createDataFrame([(float(v),) for v in x], "score double"))

    assert fit([0.5] * 10)["method"] == "p30_fallback"
    two = fit(np.concatenate([rng.normal(0.2, 0.03, 400), rng.normal(0.6, 0.03, 400)]))
    assert two["method"] == "gmm" and abs(two["value"] - 0.4) < 0.05
    assert fit(np.concatenate([rng.normal(0.3, 0.05, 990), rng.normal(0.7, 0.01, 10)]))["method"] == "p30_fallback"
    assert fit([float("nan"), float("inf")])["n"] == 0


def test_clusters():
    rng = np.random.default_rng(2)
    centres = np.eye(8)[:3]
    rows = np.concatenate([c + rng.normal(0, 0.02, (40, 8)) for c in centres])
    label = discovery.clusters_of(rows, 15)
    assert len(set(label) - {-1}) == 3 and min(np.bincount(label[label >= 0])) >= 15
    assert (discovery.clusters_of(rows[:4], 15) == -1).all()


def test_tree_problems(spark):
    tree = {"a": {"name": "A", "desc": "x", "children": {"b": {"name": "", "desc": "x", "children": {"c": {"name": "C", "desc": " "}}}, "d": {"name": "D", "desc": "x"}}}}
    found = taxonomy.problems(spark.createDataFrame(taxonomy.flatten(tree), taxonomy.FLAT_SCHEMA)).collect()
    assert {(r["problem"], r["key"]) for r in found} == {("blank name", "b"), ("blank description", "c"), ("leaf not at level 3", "d")}


def test_stream_equals_table(spark, data, tmp_path):
    table = spark.read.parquet(f"{data}/events.parquet")
    stream = ingest.file_stream(spark, data, table.schema, pattern="events.parquet")
    counts = ingest.window_counts(stream)
    q = counts.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, ingest.window_counts(table).collect()))
    ingest.run_available(ingest.file_stream(spark, data, table.schema, pattern="events.parquet"), str(tmp_path / "out"), str(tmp_path / "ck"))
    ingest.run_available(ingest.file_stream(spark, data, table.schema, pattern="events.parquet"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == table.count()
