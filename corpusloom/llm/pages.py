"""Main text of web pages, from their markup and from what repeats across the pages of a host.

A page is cut into blocks. The words of a host's pages are put in one stream, whose suffixes are sorted; neighbours that
share at least RUN words and stand on distinct pages begin runs that repeat. Markup decides first: blocks in navigation, footers, forms, adverts and the like go; blocks of an
article (without one, of main) stay, as passages are rightly quoted on several pages. Elsewhere, repeated runs go and
unique runs stay.

Large hosts are cut into shards of at most SHARD_BYTES of html on average, each with an array of its own,
so no host meets in one task. Runs that touch open blocks are also looked up by hash among all pages of the
host, so what counts as repeated doesn't depend on the shards.

Nulls and empty pages have no text. A null url is a host of its own. Rows that repeat a page_id are pages
of their own, and do not count as distinct if the url is equal too. Very long pages are taken whole. An empty
table gives no row. Other columns aren't carried, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .links import by_cell
from .shared import FOLD, Words, mix, small, text_bytes, written

#: Words of the shortest run that counts as repeated.
RUN = 8
SHARD_BYTES = 1 << 20
GOES, STAYS, OPEN = "-", "+", "?"

#: Names of HTML elements by what they are.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_RAW = frozenset("script style noscript template textarea title svg math iframe object noembed noframes xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ASIDE = frozenset("nav footer aside form button select menu dialog datalist fieldset".split())
_SCRAP = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promos?|promotions?|banners?|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlays?|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|side|aside"
    r"|widgets?|footers?|masthead|topbar|site[_-]?header|page[_-]?header|share|sharing|social|related|recommended|recommendations?|more[_-]?stories|comments?|commentlist|disqus|replies|respond|newsletter|subscribe|subscription|signup|login|search|pagination|pager|skip[_-]?link|toolbar|copyright)(?:$|[\s_-]|\d)",
    re.IGNORECASE,
)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_TOKEN = re.compile(r"<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_BLANK = re.compile(r"\s+")


def _kind(name: str, attributes: str, in_article: bool) -> str:
    """Whether what an element holds goes, stays, or is as what's around it."""
    if name in _ASIDE or (name == "header" and not in_article):
        return GOES
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)} if attributes and not attributes.isspace() else {}
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role") in _ROLES:
        return GOES
    if name not in ("html", "body", "article", "main") or in_article:
        for key in ("class", "id"):
            if key in found and _SCRAP.search(found[key]):
                return GOES
    if name == "article" or found.get("itemprop") == "articlebody":
        return STAYS
    if name == "main" or found.get("role") == "main":
        return "m"
    return ""


def blocks(page: str) -> list[tuple[str, str]]:
    """The blocks of a page that have text, in order, each with GOES, STAYS or OPEN."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # open elements and what they make of their text
    opened: Counter[str] = Counter()  # of each name
    words: list[str] = []
    at, size = 0, len(page)
    drop = stay = main = 0

    def close() -> None:
        if words:
            text = _BLANK.sub(" ", entities.unescape("".join(words))).strip()
            words.clear()
            if text:
                out.append((text, GOES if drop else STAYS if stay else "m" if main else OPEN))

    def pop() -> None:
        nonlocal drop, stay, main
        name, kind = stack.pop()
        opened[name] -= 1
        drop -= kind == GOES
        stay -= kind == STAYS
        main -= kind == "m"

    while at < size:
        cut = page.find("<", at)
        if cut < 0:
            words.append(page[at:])
            break
        if cut > at:
            words.append(page[at:cut])
        m = _TOKEN.match(page, cut)
        if not m:
            words.append("<")
            at = cut + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        name, ends = m[2].lower(), bool(m[1])
        if not m[0].endswith(">"):  # the page ends within a tag
            break
        if name == "br":
            words.append(" ")
            continue
        if name in _INLINE and not ends and "class" not in m[3] and "hidden" not in m[3]:
            continue
        if ends and not opened[name]:
            if name not in _INLINE:
                close()
            continue
        if not ends and name in _RAW:
            if m[3].endswith("/") and name in ("svg", "math"):
                continue
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            continue
        if name not in _INLINE:
            close()
        if ends:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    if name in _INLINE:
                        if stack[depth][1] == GOES:
                            words_kept = len(stack) - depth
                            close()
                            for _ in range(words_kept):
                                pop()
                    else:
                        while len(stack) > depth:
                            pop()
                    break
            continue
        if name in _VOID:
            continue
        if name == "p":
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p":
                    while len(stack) > depth:
                        pop()
                    break
                if stack[depth][0] not in _INLINE:
                    break
        kind = _kind(name, m[3], stay > 0)
        if name in _INLINE:
            if kind != GOES:
                continue
            close()
        stack.append((name, kind))
        opened[name] += 1
        drop += kind == GOES
        stay += kind == STAYS
        main += kind == "m"
    close()
    best = STAYS if any(k == STAYS for _, k in out) else "m"
    return [(t, STAYS if k == best else GOES if k == GOES else OPEN) for t, k in out]


def suffix_array(hashes: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a stream of words in order, and how many words each shares with the one before it.

    hashes: of the words; page: the number of each word's page, never falling. A suffix ends with its page. Ranks
    (the place of the first suffix that begins alike) stand for one word, then two, four and so on; only suffixes
    that still share a rank are sorted again, until all differ or no page is longer. Words shared by neighbours are
    counted by the same ranks, from the longest to one word.
    """
    n = len(hashes)
    order = np.argsort(hashes, kind="stable")
    first = np.concatenate([[True], hashes[order[1:]] != hashes[order[:-1]]])  # of those with one rank
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    end = np.searchsorted(page, page, "right")  # of each word's page
    levels, size, longest = [rank], 1, int((end - np.arange(n)).max())
    while size < longest:
        open_ = np.flatnonzero(~first | ~np.concatenate([first[1:], [True]]))  # places in the order
        if not len(open_):
            break
        own = order[open_]
        later = own + size
        inside = later < end[own]
        key = rank[own] * (n + 2) + np.where(inside, rank[np.where(inside, later, 0)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[open_], key = own[by], key[by]
        first[open_[1:]] |= key[1:] != key[:-1]
        rank = rank.copy()
        starts = np.maximum.accumulate(np.where(first[open_], open_, 0))
        rank[order[open_]] = starts
        levels.append(rank)
        size *= 2
    common = np.zeros(n, np.int64)
    x, y = order[1:], order[:-1]
    common[1:] = levels[0][x] == levels[0][y]
    if len(levels) > 1:
        two = np.flatnonzero(levels[1][x] == levels[1][y])
        two = two[np.minimum(end[x[two]] - x[two], end[y[two]] - y[two]) > 1]
        x, y = x[two], y[two]
        most, done = np.minimum(end[x] - x, end[y] - y), np.zeros(len(two), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            fits = done + (1 << k) <= most
            i, j = np.where(fits, x + done, 0), np.where(fits, y + done, 0)
            done += np.where(fits & (levels[k][i] == levels[k][j]), 1 << k, 0)
        common[1 + two] = done
    return order, common


def repeated(hashes: np.ndarray, page: np.ndarray, run: int = RUN) -> np.ndarray:
    """Which words of a stream lie in a run of at least so many words that two distinct pages have.

    Neighbours in the suffix array that share so many words are one group; the suffixes of a group that has two
    pages begin repeated runs.
    """
    n = len(hashes)
    cover = np.zeros(n, bool)
    if n < run:
        return cover
    suffix, common = suffix_array(hashes, page)
    group = np.cumsum(common < run) - 1
    least = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
    most = np.full(len(least), -1, np.int64)
    np.minimum.at(least, group, page[suffix])
    np.maximum.at(most, group, page[suffix])
    starts = np.zeros(n + run, np.int64)
    starts[run + suffix[(least < most)[group]]] = 1
    seen = np.cumsum(starts)
    return seen[run:] > seen[:n]


def runs(pages: list[bytes], host: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of pages, the first word of each run of RUN words of a page, and the run's key within its host."""
    t = Words(pages, FOLD)
    at, h = t.windows(RUN)
    with np.errstate(over="ignore"):
        return t, at, mix(h + mix(host.astype(np.int64).view(np.uint64))[t.owner[at]]).view(np.int64)


def host_texts(texts: list[list[str]], kinds: list[str], page: list[int], covered: np.ndarray | None = None) -> list[str]:
    """The main text of each page of a shard; pages of equal number aren't distinct. covered: words known to repeat elsewhere."""
    flat = [b.encode() for t in texts for b in t]
    if not flat:
        return ["" for _ in texts]
    t = Words(flat, FOLD)
    owner = np.repeat(np.asarray(page), [len(x) for x in texts])  # of each block
    order = np.argsort(owner[t.owner], kind="stable")
    cover = np.zeros(len(t.hashes), bool)
    cover[order] = repeated(t.hashes[order], owner[t.owner][order])
    if covered is not None:
        cover |= covered
    out, k = [], 0
    for own, kind in zip(texts, kinds, strict=True):
        kept = []
        for b, mark in zip(own, kind, strict=True):
            if mark == STAYS:
                kept.append(b)
            elif mark == OPEN:
                a, z = int(t.first[k]), int(t.first[k + 1])
                if not cover[a:z].any():
                    kept.append(b)
                elif not cover[a:z].all():
                    kept.append(_unique_runs(flat[k], t.starts[a:z] - t.begins[k], t.ends[a:z] - t.begins[k], cover[a:z]))
            k += 1
        out.append("\n".join(x for x in kept if x))
    return out


def _unique_runs(block: bytes, starts: np.ndarray, ends: np.ndarray, cover: np.ndarray) -> str:
    """A block without its covered words; what stands between two kept words stays."""
    parts, i, n = [], 0, len(cover)
    while i < n:
        if cover[i]:
            i += 1
            continue
        j = i
        while j + 1 < n and not cover[j + 1]:
            j += 1
        parts.append(block[(int(starts[i]) if i else 0) : (int(starts[j + 1]) if j + 1 < n else len(block))].decode("utf-8", "replace").strip())
        i = j + 1
    return " ".join(p for p in parts if p)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    types = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    sizes = rows.groupBy("host").agg(F.ceil(F.sum(F.coalesce(F.octet_length("html"), F.lit(0))) / SHARD_BYTES).cast("int").alias("shards"))
    large = small(written(sizes.where("shards > 1"), "hosts"))  # the others have one shard
    rows = rows.join(large, "host", "left")
    page = F.xxhash64("page_id", "url")
    shard = F.pmod(page, F.coalesce("shards", F.lit(1)))
    rows = rows.select("page_id", "url", "html", F.xxhash64("host", shard).alias("cell"), F.xxhash64("host").alias("host"), page.alias("page"), "shards")

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [blocks(x.as_py() or "") for x in part.column(2)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(3), part.column(4), pa.array(["\n".join(t for t, _ in f) for f in found], pa.string()), pa.array(["".join(k for _, k in f) for f in found], pa.string()), pa.nulls(len(found), pa.list_(pa.int64()))],
                names=["page_id", "url", "cell", "host", "blocks", "kinds", "runs"],
            )

    def work(table: pa.Table, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            part = table.slice(a, b - a)
            known = part.filter(pc.is_valid(part.column("runs"))).column("runs")
            part = part.filter(pc.is_null(part.column("runs")))
            kinds = part.column("kinds").to_pylist()
            texts = [t.split("\n") if k else [] for t, k in zip(part.column("blocks").to_pylist(), kinds, strict=True)]
            number: dict[tuple, int] = {}
            page = [number.setdefault(x, len(number)) for x in zip(part.column("page_id").to_pylist(), part.column("url").to_pylist(), strict=True)]
            covered = None
            if len(known):
                t, at, key = runs(text_bytes(part.column("blocks")), part.column("host").to_numpy())
                covered = np.zeros(len(t.hashes), bool)
                at = at[np.isin(key, pc.list_flatten(known).to_numpy())]
                for k in range(RUN):
                    covered[at + k] = True
            made = host_texts(texts, kinds, page, covered)
            yield from pa.Table.from_arrays(
                [part.column("page_id"), part.column("url"), pa.chunked_array([pa.array(made, pa.string())]), pa.chunked_array([pa.array([len(x) for x in made], pa.int64())])], names=["page_id", "url", "text", "n_chars"]
            ).to_batches()

    kind = f"page_id {types['page_id']}, url {types['url']}, cell long, host long, blocks string, kinds string, runs array<long>"
    cells = rows.select("page_id", "url", "html", "cell", "host").mapInArrow(cut, kind)
    known = _shared_runs(rows.where("shards > 1").select("html", "host", "cell", "page"))
    if known is not None:
        none = {c: F.lit(None).cast(t) for c, t in types.items()}
        cells = cells.unionByName(known.select(none["page_id"].alias("page_id"), none["url"].alias("url"), "cell", F.lit(0).cast("long").alias("host"), F.lit("").alias("blocks"), F.lit("").alias("kinds"), "runs"))
    return by_cell(cells, work, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")


def _shared_runs(rows: DataFrame) -> DataFrame | None:
    """cell and runs: the keys of the runs that touch open blocks of a shard and that two distinct pages of the host have.

    rows: html, host, cell and page. None where no page has an open block.
    """

    def found(wanted: bool):
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                made = [blocks(x.as_py() or "") for x in part.column(0)]
                host, other = part.column(1).to_numpy(), part.column(2).to_numpy()
                pick = [i for i, f in enumerate(made) if not wanted or any(k == OPEN for _, k in f)]
                for low in range(0, len(pick), 64):
                    some = pick[low : low + 64]
                    t, at, key = runs(["\n".join(x for x, _ in made[i]).encode() for i in some], host[some])
                    of = t.owner[at]
                    if wanted:
                        block = np.searchsorted(np.sort(np.concatenate([np.flatnonzero(t.raw == 10), t.begins[1:] - 1])), t.starts)  # of all these pages
                        is_open = np.array([k == OPEN for i in some for _, k in (made[i] or [("", GOES)])])[block]
                        seen = np.concatenate([np.zeros(1, np.int64), np.cumsum(is_open)])
                        touch = seen[at + RUN] > seen[at]
                        key, of = key[touch], of[touch]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(other[some][of]), pa.array(host[some][of])], names=["key", "other", "host"])

        return run

    kind = "key long, other long, host long"
    asked = written(rows.select("html", "host", "cell").mapInArrow(found(True), kind).distinct(), "open-runs")
    if asked.isEmpty():
        return None
    hosts = small(written(asked.select("host").distinct(), "open-hosts"))
    pages = rows.join(hosts, "host", "left_semi").select("html", "host", "page")
    several = pages.mapInArrow(found(False), kind).groupBy("key").agg(F.min("other").alias("a"), F.max("other").alias("b")).where("a < b").select("key")
    known = asked.join(several, "key").groupBy(F.col("other").alias("cell")).agg(F.collect_list("key").alias("runs"))
    return written(known, "shared-runs")
