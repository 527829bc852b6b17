"""Operators for training data against brute force, libraries and exact round trips, on small fixtures with odd rows."""

import collections
import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

import public_tokenizers
from corpusloom.llm import archives, bpe, decontaminate, licences, lines, near, packing, pages, quality, rules

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOW))


ODD = [
    (None, "a row without a number " * 6), (1, None), (2, ""), (3, "\x00\x1c \n\n\t"), (4, "Ünï çödé É é İ ß 漢字 😀 " * 8), (5, "same words here again and again\n" * 30),
    (6, "same words here again and again\n" * 30), (6, "same words here again and again\n" * 30), (7, "MIT License. Released under the MIT License.\nLicensed under CC BY-NC 4.0."), (8, "x" * 200_000),
    (9, "one two three four five six seven eight nine ten eleven twelve"), (10, "zero one two three four five six seven eight nine ten eleven\nthe end"), (11, "don't <|endoftext|> I'M 12,5 ### $$$"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in ODD], "doc_id long, text string, lang string, source string, th int, removed string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def corpus(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def plain(df):
    return [tuple(r) for r in df.collect()]


def test_rules(docs, empty, corpus):
    for t in (docs, corpus):
        texts = collections.Counter((r["doc_id"], r["text"]) for r in t.collect())
        found = rules.ledger(t).collect()
        assert len(found) == sum(texts.values())
        by_id = {i: x for i, x in texts if i is not None}
        for r in found:
            if r["doc_id"] is None:
                continue
            text = by_id[r["doc_id"]] or ""
            w = re.findall(r"[^\x20\x09-\x0D]+", text)
            at = collections.defaultdict(list)
            for k in range(len(w) - 7):
                at[tuple(w[k : k + 8])].append(k)
            cover = {x for v in at.values() if len(v) > 1 for k in v for x in range(k, k + 8)}
            full = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(cover))
            assert bool(r["failed"] & rules.BASE_MASK) == (len(w) < 20 or 100 * len(cover) > 30 * len(w))
    assert plain(rules.ledger(empty)) == []
    assert rules.keep_good(docs).columns == docs.columns
    found = rules.ledger(corpus)
    total = {r["rule"]: r for r in rules.ablations(found).collect()}
    assert total["too_few_words"]["n_failed"] == found.where("n_words < 20").count()
    assert rules.verdicts(found).where("kept_v3 AND NOT kept_v1").count() == 0


def test_tokens(docs, empty, corpus):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for t in (docs, corpus):
        want = collections.Counter((r["doc_id"], len((r["text"] or "").encode()), len(sp.encode(r["text"] or ""))) for r in t.collect())
        assert collections.Counter((r[0], r[1], r[2]) for r in plain(bpe.token_counts(t, path))) == want
    assert plain(bpe.token_counts(empty, path)) == []


def test_packing(docs, empty, corpus):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    for t in (docs, corpus):
        ids = {(r["doc_id"], r["text"]): [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in t.collect()}
        one = {i: v for (i, _), v in ids.items()}
        found = packing.packed(t, path, group_bytes=200_000).collect()
        sequences = collections.defaultdict(list)
        for r in found:
            own = one[r["doc_id"]]
            assert r["doc_tokens"] == len(own)
            assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own[r["start"] : r["start"] + r["length"]]))
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert sum(r["length"] for r in found) == sum(len(one[r["doc_id"]]) for r in t.collect())
        for pieces in sequences.values():
            pieces.sort()
            assert pieces[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(pieces, pieces[1:], strict=False))
            n = sum(p[1] for p in pieces)
            assert n == 2048 or n & (n - 1) == 0
    assert plain(packing.packed(empty, path)) == []


def test_first_fit_decreasing():
    assert packing.first_fit_decreasing([5, 4, 3, 2, 2], 8) == [[0, 2], [1, 3, 4]]
    assert packing.pack([], 8) == []


def brute_contamination(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        b = words(t)
        n = min(10, len(b))
        windows = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination(spark, docs, empty, corpus, data):
    own = [(1, "ONE two three four five six seven eight nine ten eleven"), (2, "same WORDS"), (3, None), (4, ""), (5, "no such words at all are in any of these texts here")]
    bench = spark.createDataFrame(own, "item_id long, text string")
    full = spark.read.parquet(f"{data}/benchmark.parquet")
    for t, b in ((docs, bench), (corpus, full)):
        items = [(r["item_id"], r["text"]) for r in b.collect()]
        want = collections.Counter((r["doc_id"], *brute_contamination(r["text"], items)) for r in t.collect())
        assert collections.Counter(plain(decontaminate.contamination(t, b))) == want
    assert plain(decontaminate.contamination(empty, bench)) == []
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.clean(docs, bench).columns == docs.columns


def sets(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def similar(a, b):
    both = len(a & b)
    return bool(a and b) and 5 * both >= 4 * (len(a) + len(b) - both)


def test_near(docs, empty, corpus):
    for t in (docs, corpus):
        rows = [(r["doc_id"], sets(r["text"])) for r in t.collect()]
        links = [{j for j in range(len(rows)) if j != i and similar(rows[i][1], rows[j][1])} for i in range(len(rows))]
        group = list(range(len(rows)))
        for _ in rows:
            group = [min([group[i], *(group[j] for j in links[i])]) for i in range(len(rows))]
        want = []
        for i, (doc, _) in enumerate(rows):
            ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
            want.append((doc, min(ids) if ids else None, len(links[i])))
        got = plain(near.near_duplicates(t).select("doc_id", "class_id", "n_links"))
        assert collections.Counter(got) == collections.Counter(want)
    assert plain(near.near_duplicates(empty)) == []
    kept = near.one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 6").count() == 0 and kept.where("doc_id = 5").count() == 1


def test_lines(docs, empty, corpus):
    for t in (docs, corpus):
        places, gone = [], set()
        texts = {(r["doc_id"], r["text"]) for r in t.collect()}
        for doc, text in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)):
            for k, line in enumerate((text or "").split("\n")):
                w = frozenset(words(line))
                if not w:
                    continue
                if any(similar(w, o) for o in places):
                    gone.add((doc, k))
                if w not in places:
                    places.append(w)
        got = {(r["doc_id"], k) for r in lines.removed_lines(t).collect() for k in r["removed"]}
        assert got == gone
    out = lines.without_lines(docs, into="numbers")
    assert out.columns == [*docs.columns, "numbers"] and out.count() == docs.count()
    with pytest.raises(ValueError):
        lines.without_lines(docs)
    out = {r["doc_id"]: r for r in lines.deduped(docs).collect()}
    assert list(out[7].asDict()) == docs.columns and out[7]["removed"] == "x" and out[5]["text"].count("\n") == 1
    assert plain(lines.removed_lines(empty)) == []


def test_licences(docs, empty, corpus):
    for t in (docs, corpus):
        for r, (text,) in zip(licences.licence_labels(t).orderBy("doc_id").collect(), t.orderBy("doc_id").select("text").collect(), strict=True):
            w = words(text)
            at = [(k, label) for phrase, label in licences.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
            starts = [k for k, _ in at]
            if r["doc_id"] != 6:
                assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))
            assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert plain(licences.licence_labels(empty)) == []


def test_automaton():
    a = licences.Automaton("[this <0,2> is] licensed under [a|the] x <1> end")
    assert a.match(b"this very work is licensed under the x 4 end".split(), 0) == 10
    assert a.match(b"licensed under x y end".split(), 0) == 5
    assert a.match(b"licensed under x end".split(), 0) == -1


def test_archives(spark):
    rows = [(1, "http://a b", "<p>é</p>"), (2, None, None), (3, "u", ""), (4, "u\nv", "<p>é</p>\r\n\r\nWARC/1.0\r\n\r\n"), (5, "w", "<p>é</p>"), (None, "n", "only"), (6, "x", "y" * 5_000_000)]
    got = {r["page_id"]: r for r in archives.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, html in rows:
        body = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        top = max(same, default=None)
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), archives.base32_sha1(body))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == top else ("revisit", top))
    assert plain(archives.round_trip(spark.createDataFrame([], "page_id long, url string, html string"))) == []


def test_arc_versions():
    records = [archives.ArcRecord({"URL": "http://x/a b", "IP-address": "1.2.3.4", "Archive-date": "20010203", "Content-type": "text/html"}, b"HTTP/1.0 200 OK\r\n\r\nhi"), archives.ArcRecord({"URL": "dns:x", "Content-type": "text/dns", "Archive-date": "2001"}, b"a\nb\n")]
    for version in (1, 2):
        back = list(archives.read_arc(archives.write_arc(records, version)))
        assert [r.body for r in back[1:]] == [r.body for r in records]
        w = [archives.convert(r, not k, str(k)) for k, r in enumerate(back)]
        assert [x.kind for x in w] == ["warcinfo", "response", "resource"]
        assert w[1].fields["WARC-Date"] == "2001-02-03T00:00:00Z" and w[1].fields["WARC-Target-URI"] == "http://x/a b"
        assert w[1].fields["WARC-Payload-Digest"] == "sha1:" + archives.base32_sha1(b"hi")
    with pytest.raises(ValueError):
        list(archives.read_arc(archives.write_arc(records, 1)[:-4]))


def test_pages(spark):
    boiler = "<div>We keep small files on your machine to count visits and more</div>"
    bare = [(i, "http://h.example/x", f"<body>{boiler}<p>{i} page has text {i} of its own {i} &amp; more</p>") for i in range(3)]
    odd = [(10, None, None), (11, "u", ""), (12, "u", "<article><h1>T</h1><p>a<br>b &lt;c&gt;<p>d</p><div class='comments'><p>e</p></div><aside>f</aside></article><footer>g</footer>"), (13, "u", "text <b>only</b> <scr"), (14, "u", "<script>x</script><nav>n</nav>")]
    got = {r["page_id"]: r for r in pages.main_texts(spark.createDataFrame(bare + odd, "page_id long, url string, html string")).collect()}
    for i in range(3):
        assert got[i]["text"] == f"{i} page has text {i} of its own {i} & more"
    assert [got[i]["text"] for i in range(10, 15)] == ["", "", "T\na b <c>\nd", "text only", ""]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert plain(pages.main_texts(spark.createDataFrame([], "page_id long, url string, html string"))) == []


def test_quality(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = quality.quality_scores(d, labels)
    assert found.count() == d.count()
    right = found.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.95
    assert quality.quality_scores(docs, labels).where("score < 0 OR score > 1 OR score IS NULL OR held_out IS NULL").count() == 0
    assert plain(quality.quality_scores(empty, labels.limit(0))) == []
    assert {r["score"] for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = [r for r in rules.keep_good(docs).collect()]
    out = corpus_pipeline.run(spark, data)
    assert out.columns[0] == "doc_id" and {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in kept}
    assert ORDER == [n for n, _ in corpus_pipeline.STAGES]


ORDER = ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
