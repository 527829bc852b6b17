"""A text above a group's size, and the tokenizer that a worker keeps."""

import collections

import public_tokenizers
from corpusloom.llm import packing


def test_a_text_larger_than_a_group(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(1, " ".join(f"word{k}" for k in range(9000)))] + [(k, f"short text number {k}") for k in range(2, 60)] + [(60, None)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), path, group_bytes=2000).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
    assert set(by) == set(range(1, 61))
    for pieces in by.values():
        ends = 0
        for start, length, total in sorted(pieces):
            assert start == ends
            ends += length
        assert ends == total
    assert len(by[1]) > 4 and by[60] == [(0, 1, 1)]
    sizes = collections.Counter()
    for r in got:
        sizes[r["sequence_id"]] += r["length"]
    assert max(sizes.values()) <= 2048
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_workers_keep_the_tokenizer(spark):
    """Tasks of one worker, one after the other, find the same one."""
    path = public_tokenizers.path("word_bpe_49k.json")

    def run(parts):
        for _ in parts:
            pass
        import pyarrow as pa

        known = path in packing._ids
        packing.ids_of(path)
        yield pa.RecordBatch.from_arrays([pa.array([known])], names=["known"])

    for _ in range(6):
        seen = [r["known"] for r in spark.range(0, 4, 1, 1).mapInArrow(run, "known boolean").collect()]
    assert seen == [True]
