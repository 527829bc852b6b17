"""The query of simple chunks on documents with headings."""

from corpusloom.plans import semantic


def test_documents_with_headings_are_cut(spark, tmp_path):
    rows = [(1, "before\n# One\n\nfirst\n\n## Two\nsecond part"), (2, "no heading")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in semantic.chunk_simple(spark, str(tmp_path)).collect())
    assert {r[0] for r in got} == {1, 2}
    assert [r[1] for r in got if r[0] == 1] == list(range(len(got) - 1)) and len(got) > 2
    assert {"One", "Two"} <= {r[2] for r in got} and (2, 0, None, 10) in got
