"""Files of each type to documents and back, front matter, streams with state, and queries that SQL can't express."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking
from corpusloom.plans import relational, semantic  # noqa: F401
from corpusloom.sources import convert, documents
from corpusloom.streaming import ingest

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(*paragraphs):
    body = "".join(f"<w:p><w:r>{p}</w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}<w:tbl><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tbl></w:body></w:document>')
    return out.getvalue()


def test_docx():
    assert convert.docx_text(docx("<w:t>One</w:t><w:tab/><w:t> two &amp; é</w:t>", "<w:t> </w:t>", "<w:t>a</w:t><w:br/><w:t>b</w:t>")) == "One\t two & é\n\na\nb"
    for bad in (b"", b"PK\x03\x04 cut", zipfile_without()):
        with pytest.raises(ValueError):
            convert.docx_text(bad)


def zipfile_without():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("other.xml", "<a/>")
    return out.getvalue()


def test_files_to_documents_and_back(spark, tmp_path):
    root = tmp_path / "in"
    (root / "hr").mkdir(parents=True)
    (root / "hr" / "a__leave-policy.docx").write_bytes(docx("<w:t>Leave: it's 'new'</w:t>", "<w:t>Body</w:t>"))
    (root / "hr" / "page.html").write_text("<h1>T</h1><script>x</script><table><tr><td>a </td><td>b</td></tr></table><img alt='p' src='s'>")
    (root / "note__my-note.txt").write_bytes("  \n".encode())
    (root / "hr" / "gbk.txt").write_bytes("标题\n正文".encode("gbk"))
    (root / "hr" / "x.pdf").write_bytes(b"%PDF")
    (root / "hr" / "bad.docx").write_bytes(b"no")
    rows = convert.texts_of(documents.read_files(spark, str(root)))
    assert {r["path"].rsplit("/", 1)[1] for r in rows.where("error IS NOT NULL").collect()} == {"x.pdf", "bad.docx"}
    made = convert.metadata(rows.where("error IS NULL"), f"file:{root}", {"hr/": "personnel"}, ["all"]).cache()
    got = {r["source_path"]: r for r in made.collect()}
    assert set(got) == {"hr/a__leave-policy.docx", "hr/page.html", "note__my-note.txt", "hr/gbk.txt"}
    assert got["hr/a__leave-policy.docx"]["title"] == "Leave: it's 'new'" and got["hr/a__leave-policy.docx"]["tags"] == ["all", "personnel"]
    assert got["note__my-note.txt"]["title"] == "My Note" and got["hr/gbk.txt"]["title"] == "标题"
    assert got["hr/page.html"]["text"] == "T\na | b\n[图片: p](s)"
    assert len(got["hr/page.html"]["updated_at"]) == 19 and got["hr/page.html"]["created_at"] == got["hr/page.html"]["updated_at"]
    names = ("document_id", "title", "author", "created_at", "source_path")
    whole = convert.front_matter({n: F.col(n) for n in names}, F.col("tags"), F.col("text"))
    files = made.select("source_path", whole.alias("text")).collect()
    for r in files:
        front, body = documents.parse_front_matter(r["text"])
        assert {n: front[n] for n in names} == {n: got[r["source_path"]][n] for n in names}
        assert front["tags"] == got[r["source_path"]]["tags"] and body == got[r["source_path"]]["text"].strip()
    convert.write_documents(made.select("document_id", "text"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4


FRONT = """---
title: "A: b"   
tags: ["x, y", 'it''s', z]
nested:
  owner: 'N: 1'
  deep:
    k: v
list:
  - "one: two"
  - three
note: |
  line one

  line two
fold: >-
  a
  b
url: http://x/y # comment
none: ~
---
Body
"""


def test_front_matter():
    m, body = documents.parse_front_matter(FRONT)
    assert body == "Body"
    assert m == {"title": "A: b", "tags": ["x, y", "it's", "z"], "nested": {"owner": "N: 1", "deep": {"k": "v"}}, "list": ["one: two", "three"], "note": "line one\n\nline two", "fold": "a b", "url": "http://x/y", "none": None}
    for bad in ("---\n- a\n---\n", "---\na b\n---\n", "no", "---\na: 1\n   b\n---\n"):
        with pytest.raises(ValueError):
            documents.parse_front_matter(bad)


def test_identifier_is_rewritten(spark):
    rows = spark.createDataFrame([("---\ntitle: a\ndocument_id: old\n---\nx\ndocument_id: body",), ("plain",)], "t string")
    got = [r[0] for r in rows.select(documents.with_id(F.col("t"), F.lit("new"))).collect()]
    assert got == ["---\ntitle: a\ndocument_id: new\n---\nx\ndocument_id: body", "document_id: new\nplain"]


def test_stream_of_threads(spark, tmp_path):
    schema = "conv_id long, turn int, role string, text string"
    for k, rows in enumerate(([(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "x")], [(1, 1, "u", "b"), (1, 2, "u", "c"), (1, 3, "u", "d")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        out: list = []
        q = ingest.thread_states(stream, 2).writeStream.outputMode("update").foreachBatch(lambda b, _, out=out: out.extend(map(tuple, b.collect()))).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
        want = [[(1, 2, 1, ["a", "b"]), (2, 1, 0, ["x"])], [(1, 4, 3, ["c", "d"])]][k]
        assert sorted(out) == want


def test_stream_once_each_and_batches(spark, tmp_path):
    rows = spark.createDataFrame([(k % 5, f"2024-01-01 00:00:{k:02d}") for k in range(20)], "content_hash long, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    ingest.run_available(ingest.once_each(stream()), f"{tmp_path}/out", f"{tmp_path}/ck1")
    assert sorted(r["content_hash"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 1, 2, 3, 4]
    seen: list = []

    def work(batch, number):
        if not seen:
            seen.append("failed")
            raise RuntimeError("once")
        seen.append(batch.count())

    with pytest.raises(Exception, match="once"):
        ingest.each_batch(stream(), work, f"{tmp_path}/ck2")
    ingest.each_batch(stream(), work, f"{tmp_path}/ck2")
    assert seen == ["failed", 20]


def test_pages_as_lines(spark, data):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in relational.QUERIES["html_to_text"](spark, data).collect()}
    assert got == {k: documents.html_lines(h or "") for k, h in pages.items()}
    assert all("track(0)" not in t and "margin" not in t and "\n\n" not in t for t in got.values())
    assert documents.html_lines("<style>p{}</style><p>a<p>b<br>c &lt; d</p>") == "a\nb\nc < d"


def test_rich_chunks_of_all_documents(spark, data):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = relational.QUERIES["chunk_rich"](spark, data).collect()
    assert {r["doc_id"] for r in rows} == {k for k, t in docs.items() if (t or "").strip()}
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for k in list(by_doc)[:60]:
        want = [tuple(c.values()) if isinstance(c, dict) else tuple(c) for c in chunking.rich_chunks(docs[k])]
        assert len(want) == len(by_doc[k])


def test_thresholds_and_clusters_run(spark, data):
    fits = relational.QUERIES["threshold_fit"](spark, data).collect()
    assert [r["level"] for r in sorted(fits)] == [1, 2, 3] and all(r["n"] > 0 and 0.15 <= r["value"] <= 0.80 for r in fits)
    found = relational.QUERIES["discovered_clusters"](spark, data)
    n = relational.QUERIES["status_histogram"](spark, data).where("status = 'UNKNOWN'").first()["n"]
    assert found.count() >= 0 and n >= 0
