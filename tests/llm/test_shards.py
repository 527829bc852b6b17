"""Main text of pages of a host that is cut into shards."""

import pytest

from corpusloom.llm import pages

SCHEMA = "page_id long, url string, html string"


def made(spark, rows):
    return {r["page_id"]: r["text"] for r in pages.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize("size", [1 << 20, 100])
def test_runs_across_shards(spark, monkeypatch, size):
    monkeypatch.setattr(pages, "SHARD_BYTES", size)
    boiler = "<div>We keep small files on your machine to count visits and more</div>"
    own = [f"{i} page has text {i} of its own {i} and more {i}" for i in range(40)]
    rows = [(i, f"http://h.example/{i}", f"<body>{boiler if i in (3, 31) else ''}<p>{own[i]}</p>{chr(0) * (i == 7)}") for i in range(40)]
    other = [(100 + i, f"http://g{i}.example/", f"<body>{boiler}<p>{own[i]}</p>") for i in range(2)]  # once on each host
    rows += [(200, "http://h.example/200", "<body><p>a line that only one page has but which comes twice</p>")] * 2 + [(300, "http://h.example/300", ""), (301, "http://h.example/301", None)]
    got = made(spark, rows + other)
    assert [got[i].replace("\0", "").strip() for i in range(40)] == own
    assert all(got[100 + i].startswith("We keep small files") for i in range(2))
    assert got[200] == "a line that only one page has but which comes twice" and got[300] == got[301] == ""


def test_runs_decide_beside_articles(spark):
    boiler = "<div>We keep small files on your machine to count visits and more</div>"
    page = "<body><nav>n</nav><main>{b}<p>{i} main text {i} that only {i} has, beside its teasers {i}</p></main><article>Teaser {i}</article><div>Also {i} in a div</div></body>"
    rows = [(i, f"http://h.example/{i}", page.format(b=boiler, i=i)) for i in range(3)]
    rows += [(10 + i, f"http://k.example/{i}", f"<body>{boiler}<main>In main {i}</main><p>Beside main {i}</p></body>") for i in range(3)]
    got = made(spark, rows)
    for i in range(3):
        assert got[i] == f"{i} main text {i} that only {i} has, beside its teasers {i}\nTeaser {i}\nAlso {i} in a div"
        assert got[10 + i] == f"In main {i}\nBeside main {i}"
