"""Rows that repeat both doc_id and text."""

from corpusloom.llm import near


def test_one_of_repeated_rows_stays(spark):
    text = "a text of some ten words that is there many times"
    rows = [(5, text)] * 30 + [(7, text), (8, "another text that has no copy at all here"), (8, "a third text by the same number, also without a copy")]
    rows += [(None, "a text without a number that comes more than once")] * 3
    kept = near.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert kept.columns == ["doc_id", "text"]
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted((i or 0, t) for i, t in set(rows) if i != 7)
