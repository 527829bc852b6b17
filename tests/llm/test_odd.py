"""Cases that are easy to get wrong: clashing names, long words, hubs, large groups, odd identifiers, overlaps."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from corpusloom.llm import archives, bpe, licences, lines, links, near, packing, pages, quality, rules, shared

DOCS = "doc_id long, text string"


def thue_morse(n, a, b):
    return "".join((a, b)[bin(k).count("1") & 1] for k in range(n))


def test_long_words_differ():
    x, y = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    h = shared.Words([x.encode(), y.encode()]).hashes
    assert h[0] != h[1]
    text = " ".join([x] * 8 + [y] * 8)
    m = rules.measure([text.encode()])
    assert m["n_repeat_words"][0] == 0
    assert set(lines.Lines([x.encode()]).names()) != set(lines.Lines([y.encode()]).names())


def test_archive_names(spark):
    rows = [("p\r\nX: 1", "filedesc://x", "a"), ("é %41", "filedesc://x", "a"), ("r", "http://r/ s\nt", "b"), ("r", "http://r/ s\nt", "b"), (None, "dns:x", "c")]
    t = spark.createDataFrame([(*r, "w") for r in rows], "page_id string, url string, html string, record string")
    path = f"{shared.shared_folder(spark)}/named"
    archives.write_archives(t, path)
    got = archives.read_archives(spark, path, "string").collect()
    assert collections.Counter(r["page_id"] for r in got) == collections.Counter(r[0] for r in rows)
    one = {r["page_id"]: r for r in got}
    assert one["p\r\nX: 1"]["record_type"] == "revisit" or one["é %41"]["record_type"] == "revisit"
    ids = []
    for (data,) in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").collect():
        ids += [r.fields["WARC-Record-ID"] for r in archives.read_warc(bytes(data))]
        assert all(r.fields["WARC-Refers-To-Target-URI"] == "filedesc://x" for r in archives.read_warc(bytes(data)) if r.kind == "revisit")
    assert len(ids) == len(set(ids)) > 5


def test_components_of_hubs_and_chains(spark, monkeypatch):
    r = random.Random(2)
    edges = [(0, k) for k in range(1, 3000)] + [(5000 + k, 5001 + k) for k in range(120)] + [(9000 + r.randint(0, 80), 9000 + r.randint(0, 80)) for _ in range(60)]
    r.shuffle(edges)
    t = spark.createDataFrame([(b, a) for a, b in edges], "a long, b long")
    n = 10_000
    want = links.least_labels(n, *np.array(edges).T)
    for rows in (500_000, -1):
        monkeypatch.setattr(shared, "BROADCAST_ROWS", rows)
        got = {x["id"]: x["root"] for x in links.components(t).collect()}
        assert got == {k: want[k] for e in edges if e[0] != e[1] for k in e}


def variants(seed, n, words):
    """Near copies in several groups, as texts of one line."""
    r = random.Random(seed)
    base = [[r.choice("abcdefghijklmnopqrstuvwxyz") * r.randint(1, 4) + str(r.randint(0, 9)) for _ in range(words)] for _ in range(6)]
    out = []
    for k in range(n):
        t = list(base[k % 6])
        for _ in range(r.randint(0, 3)):
            t[r.randrange(len(t))] = f"w{r.randint(0, 30)}"
        out.append((k, " ".join(t)))
    return out


def test_blocks_change_nothing(spark, monkeypatch):
    t = spark.createDataFrame(variants(1, 90, 60), DOCS)
    want = sorted(map(tuple, near.near_duplicates(t).select("doc_id", "class_id", "n_links").collect()))
    assert sum(x[2] for x in want) > 100
    monkeypatch.setattr(near, "BUCKET_BLOCK", 2)
    monkeypatch.setattr(links.verified, "__defaults__", (4, 5, 2))
    assert sorted(map(tuple, near.near_duplicates(t).select("doc_id", "class_id", "n_links").collect())) == want
    with pytest.raises(ValueError):
        near.near_duplicates(t, 0.7)


@pytest.mark.parametrize("threshold", [0.6, 0.75, 0.8, 1.0])
def test_line_thresholds(spark, monkeypatch, threshold):
    monkeypatch.setattr(lines, "LINE_BLOCK", 3)
    r = random.Random(3)
    docs = [(k, "\n".join(" ".join(r.sample("abcdefg", r.randint(1, 6))) for _ in range(3))) for k in range(25)]
    got = {(x["doc_id"], k) for x in lines.removed_lines(spark.createDataFrame(docs, DOCS), threshold).collect() for k in x["removed"]}
    before, want = [], set()
    for doc, text in docs:
        for k, line in enumerate(text.split("\n")):
            s = set(line.split())
            if any(100 * len(s & o) >= round(100 * threshold) * len(s | o) for o in before):
                want.add((doc, k))
            before.append(s)
    assert got == want


def as_pattern(template):
    """A template as a pattern over words that end in a space each."""
    out = []
    for t in re.findall(r"\[|\]|\||<\d+(?:,\d+)?>|[^\s\[\]|<>]+", template):
        if t in "[]|":
            out.append({"[": "(?:", "]": ")?", "|": "|"}[t])
        elif t[0] == "<":
            out.append(r"(?:\S+ ){%s}" % t[1:-1])
        else:
            out.append(re.escape(t) + " ")
    return re.compile("".join(out))


def brute_labels(words):
    found = []
    for label, t in licences.TEMPLATES:
        mandatory = licences.Automaton(t).mandatory
        for i in range(len(words)):
            # the longest match, which a pattern alone doesn't promise
            for j in range(len(words), i, -1):
                if as_pattern(t).fullmatch("".join(w + " " for w in words[i:j])):
                    found.append((mandatory, -i, j, label))
                    break
    taken, labels = [], set()
    for mandatory, i, j, label in sorted(found, reverse=True):
        if not any(a <= -i and j <= b for a, b in taken):
            taken.append((-i, j))
            labels.add(label)
    return labels


def plain_words(template):
    return re.sub(r"\[[^\[\]]*\]", " ", re.sub(r"\[[^\[\]]*\]", " ", re.sub(r"<[\d,]+>", "some people", template))).split()


def test_licence_labels_by_brute_force():
    texts = ["licensed under the mit license", "this is licensed under the terms of the gnu general public license version 2 copyright 2004 x y all rights reserved", "licensed under cc by nc 4 0 and cc by 3 0", "mit apache license version 2 0 license"]
    texts += ["x " + " ".join(plain_words(t)[:12]) + " y" for _, t in licences.TEMPLATES[4:]]
    scanner = licences.Scanner()
    for text in texts:
        w = text.split()
        _, base, labels, _ = scanner.scan([x.encode() for x in w])
        assert labels == brute_labels(w) | base, text


@pytest.mark.parametrize("k", range(4))
def test_whole_licences(k):
    label, template = licences.TEMPLATES[k]
    w = plain_words(template)
    scanner = licences.Scanner()
    assert label in scanner.scan([x.encode() for x in w])[2]
    changed = list(w)
    changed[len(w) // 2] = "altered"  # mandatory wording differs
    a = licences.Automaton(template)
    assert a.match([x.encode() for x in w], 0) == len(w) and a.match([x.encode() for x in changed], 0) == -1


def test_spans():
    r = random.Random(4)
    spans = [(a := r.randint(0, 40), a + r.randint(1, 20)) for _ in range(300)]
    s, plain = licences.Spans(sorted({a for a, _ in spans})), []
    for a, b in spans:
        assert s.inside(a, b) == any(x <= a and b <= y for x, y in plain)
        s.add(a, b)
        plain.append((a, b))


def test_repeated_runs_by_brute_force():
    r = np.random.default_rng(1)
    for _ in range(150):
        n, run = int(r.integers(1, 70)), int(r.integers(1, 10))
        w, page = r.integers(0, 3, n).astype(np.uint64), np.sort(r.integers(0, 5, n))
        where = collections.defaultdict(set)
        spans = [(k, tuple(w[k : k + run])) for k in range(n - run + 1) if page[k] == page[k + run - 1]]
        for k, s in spans:
            where[s].add(page[k])
        want = np.zeros(n, bool)
        for k, s in spans:
            want[k : k + run] |= len(where[s]) > 1
        assert (pages.repeated(w, page, run) == want).all()
        order, common = pages.suffix_array(w, page)
        tails = [tuple(w[k : np.searchsorted(page, page[k], "right")]) for k in order]
        assert tails == sorted(tails) and all(tails[k][: common[k]] == tails[k - 1][: common[k]] and tails[k][: common[k] + 1] != tails[k - 1][: common[k] + 1] or tails[k] == tails[k - 1] for k in range(1, n))


def test_hostile_markup_is_linear():
    for text in ("<div>a " * 30_000, "<div>" * 30_000 + "</span>" * 30_000, "<p>a<b hidden>" * 20_000, "</p>" * 50_000):
        pages.blocks(text)


def test_pages_of_any_columns(spark):
    rows = [(1, "u", "<p>a", 1, "x"), (1, "u", "<p>a", 2, "y"), (1, "v", "<p>b", 3, None)]
    got = pages.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, host int, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, "u", "a", 1), (1, "u", "a", 1), (1, "v", "b", 1)]


def test_token_fuzz():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    counter, sp, r = bpe.PieceCounter(path), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(6)
    alphabet = "abcdetnro  ▁\n\t\r\0.,'\"<>/sé漢😀ß0127​́"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(4000)]
    assert [counter.count(x) for x in texts] == [len(x) for x in sp.encode(texts, num_threads=1)]


def test_packing_fuzz():
    import pyarrow as pa

    ids, r = packing.Ids(public_tokenizers.path("word_bpe_49k.json")), random.Random(7)
    alphabet = "abctsrXYZ '  .,!?|<>\n\x1c\x85\xa0éß漢İ012#$́"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(4000)] + ["<|endoftext|>", "a<|STARTOFTEXT|> B"]
    got, bounds = ids.encode(pa.array(texts), 1)
    want = ids.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [got[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [[*e.ids, 1] for e in want]


def test_learning_and_scores():
    good = [f"clear prose about topic {k % 7} and its many sides {k}".encode() for k in range(60)]
    bad = [f"$$$ xx !! buy {k % 5} zz {k} $$$".encode() for k in range(60)]
    model = quality.learn([*good, *bad], [1] * 60 + [0] * 60)
    scores = model.score([*good, *bad, b""])
    assert (scores[:60] > 0.5).all() and (scores[60:120] < 0.5).all()
    for k in (0, 70, 120):  # one by one, by a loop over kinds
        text = [*good, *bad, b""][k]
        total = model.bias
        for b, first, last in quality.buckets([text]):
            own = b[first[0] : last[0]]
            total += sum(float(model.table[x]) for x in own) / max(1, len(own))
        assert abs(scores[k] - 1 / (1 + np.exp(-total))) < 1e-6


def test_ledger_by_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    mask = rules.POLICIES[rules.CURRENT]
    alone, out = collections.Counter(), rules.ledger(docs).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in out:
        text = texts[r["doc_id"]]
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        full = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        upper, letters = len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text))
        marked = sum(1 for x in w if re.search(r"[!?][!?]$", x) or not re.search(r"[0-9A-Za-z\x80-\U0010ffff]", x))
        n = len(w)
        fails = {
            "too_few_words": n < 20, "repeated_windows": 100 * r["n_repeat_words"] > 30 * n, "symbols": 10 * len(re.findall(r"[#*$%&|<>]", text)) > 3 * n,
            "upper_case": letters >= 50 and 2 * upper > letters, "duplicate_lines": len(full) >= 4 and 2 * (len(full) - len(set(full))) > len(full),
            "word_length": n > 0 and not 2 * n <= sum(map(len, w)) <= 14 * n, "shouted_words": 20 * marked > 3 * n, "endless_word": max(map(len, map(str.encode, w)), default=0) > 1000,
            "echoed_words": 10 * sum(a == b for a, b in zip(w, w[1:])) > 3 * n,
        }
        bits = sum(1 << x.bit for x in rules.RULES if fails[x.name])
        assert r["failed"] == bits, (r["doc_id"], fails)
        own = [x.name for x in rules.RULES if mask >> x.bit & 1 and fails[x.name]]
        alone.update(own if len(own) == 1 else [])
    got = {r["rule"]: r["n_failed_alone"] for r in rules.ablations(rules.ledger(docs)).collect()}
    assert {k: v for k, v in got.items() if v} == dict(alone)


def test_pipeline_stage_by_stage(spark, data, tmp_path):
    """Odd rows and clashing columns through all stages; each filter against the operator's own rows."""
    import corpus_pipeline

    r = random.Random(8)
    rows = [(k, "\n".join(" ".join(r.choice("abcdefghijklm") + r.choice("nopqrs") + r.choice("tuvwxyz") for _ in range(25)) for _ in range(3)), "en", "s", k) for k in range(12)]
    rows += [(None, rows[1][1], "en", "s", 1), (1, rows[1][1], "en", "s", 1), (20, None, None, None, None), (21, "", "", "", 0), (22, rows[2][1] + "\n" + rows[2][1], "en", "s", 0)]
    rows += [(30, " ".join(f"long{k}" for k in range(60_000)), "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "'r' AS removed", "1 AS th", "2 AS id", "3 AS `_doc`", "4 AS `_th`", "5 AS cell")
    bench = spark.createDataFrame([("b", rows[5][1].split("\n")[1])], "item_id string, text string")
    for name, table in (("docs", docs), ("none", docs.limit(0))):
        folder = tmp_path / name
        bench.write.parquet(f"file://{folder}/benchmark.parquet")
        now = table
        for stage, run in corpus_pipeline.STAGES[:-1]:
            after = shared.written(run(spark, now, f"file://{folder}"), stage.replace(" ", "-"))
            assert after.columns == docs.columns
            if stage != "line dedup":
                assert after.exceptAll(now).count() == 0
            now = after
        out = corpus_pipeline.STAGES[-1][1](spark, now, f"file://{folder}").collect()
        kept = {r["doc_id"] for r in now.collect()}
        assert {r["doc_id"] for r in out} == kept
        if name == "docs":
            assert 5 not in kept and 20 not in kept and 21 not in kept and 30 in kept and {0, 2, 3, 4, 6, 7, 8, 9, 10, 11} <= kept and now.count() == len(kept) + 1  # both rows of 1 lost their lines to the one before
        else:
            assert not kept


def test_queries_of_the_entry(spark, data):
    import __spark_entry__

    known = {k: v for k, v in __spark_entry__.queries().items() if re.match(r"op\d+_|pipeline", k)}
    assert len(known) == 14
    for name in ("op3_licence_templates", "op4_piece_tokens", "op9_subword_quality", "op10_rule_ledger"):
        assert known[name](spark, data).select("doc_id").count() == spark.read.parquet(f"{data}/documents.parquet").count()
    assert known["op2_host_suffix_array"](spark, data).agg(F.sum("n_chars")).first()[0] > 0
