"""Documents from files and pages: front matter, HTML, plain text, and JSON lines; bad rows get a reason, not an exception."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import doc_slug, file_type

FRONT = re.compile(r"\A﻿?---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)(.*)\Z", re.DOTALL)
#: Fixed value: encodings in the order in which they are tried.
ENCODINGS = ("utf-8-sig", "utf-8", "gbk", "latin-1")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, content, time of change and type of files below a path, in any store that Spark reads."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return rows.select("path", "length", "content", F.col("modificationTime").alias("modified"), file_type(F.col("path")).alias("file_type"))


def listed(files: DataFrame, path: str = "path", *others: str) -> DataFrame:
    """Files in the order of their folders and names, as a walk that sorts the names of each folder meets them; then by other columns."""
    parts = F.split(F.col(path), "/")
    return files.orderBy(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, -1), *others)


def decoded(content: bytes) -> str:
    """Text in the first encoding that fits."""
    for name in ENCODINGS:
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    return ""


def _scalar(x: str) -> str | list | None:
    x = x.strip()
    if x.startswith("[") and x.endswith("]"):
        return [y for y in (_scalar(p) for p in re.findall(r"""(?:"[^"]*"|'[^']*'|[^,"'])+""", x[1:-1])) if y]
    if len(x) > 1 and x[0] == x[-1] and x[0] in "\"'":
        return x[1:-1].replace("''", "'") if x[0] == "'" else x[1:-1].replace('\\"', '"')
    x = re.sub(r"\s+#.*$", "", x)
    return None if x in ("", "null", "~") else x


def _mapping(lines: list[str], at: int, depth: int) -> tuple[dict, int]:
    """The mapping whose keys stand so many blanks in, from a line on, and the line after it."""
    out: dict = {}
    key = None
    while at < len(lines):
        line = lines[at]
        own = len(line) - len(line.lstrip(" "))
        if not line.strip() or line.lstrip().startswith("#"):
            at += 1
            continue
        item = re.match(r"\s*-\s+(.*)$", line)
        if item and key is not None and isinstance(out.get(key) or [], list):
            out[key] = [*(out.get(key) or []), _scalar(item[1])]
            at += 1
            continue
        pair = re.match(r"""\s*("[^"]+"|'[^']+'|[A-Za-z_][\w .-]*?)\s*:(?:\s+(.*))?$""", line)
        if own < depth and pair:
            break
        if own > depth and pair and key is not None and out[key] is None:
            out[key], at = _mapping(lines, at, own)
            continue
        if own != depth or not pair:
            raise ValueError(f"not a mapping: {line[:60]}")
        key, value = pair[1].strip("\"'"), (pair[2] or "").strip()
        at += 1
        if re.fullmatch(r"[|>][+-]?", value):
            held = []
            while at < len(lines) and (not lines[at].strip() or len(lines[at]) - len(lines[at].lstrip(" ")) > depth):
                held.append(lines[at].strip())
                at += 1
            out[key] = ("\n" if value[0] == "|" else " ").join(held).strip()
        else:
            out[key] = _scalar(value)
    return out, at


def parse_front_matter(text: str) -> tuple[dict, str]:
    """The mapping at the head and the body, trimmed. Of YAML: scalars, quoted or not, lists, blocks of text, nested mappings."""
    m = FRONT.match(text)
    if not m:
        raise ValueError("no front matter")
    lines = m[1].splitlines()
    out, at = _mapping(lines, 0, 0)
    if at < len(lines):
        raise ValueError(f"not a mapping: {lines[at][:60]}")
    return out, m[2].strip()


def _text(x: object) -> str | None:
    return x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False)


DOCUMENT = "document_id string, title string, author string, created_at string, tags array<string>, source_path string, body string, error string"


def parse_documents(files: DataFrame) -> DataFrame:
    """Documents of files with front matter; ``error`` says why a file isn't one. Of equal identifiers the last path stays."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DOCUMENT.split(", ")]
        for part in parts:
            rows: list[list] = [[] for _ in range(9)]
            for path, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                try:
                    m, body = parse_front_matter(decoded(content or b""))
                    tags = m.get("tags") or []
                    values = [_text(m.get("document_id")), _text(m.get("title")), _text(m.get("author")) or "unknown", _text(m.get("created_at")), [tags] if isinstance(tags, str) else [_text(x) for x in tags], _text(m.get("source_path")), body, None]
                except ValueError as e:
                    values = [None] * 7 + [str(e)]
                for column, x in zip(rows, (path, *values), strict=True):
                    column.append(x)
            kinds = [pa.string()] * 5 + [pa.list_(pa.string())] + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=["path", *names])

    rows = files.select("path", "content").mapInArrow(run, f"path string, {DOCUMENT}")
    rows = rows.withColumn("document_id", F.when(F.col("error").isNull(), F.coalesce("document_id", doc_slug(F.col("path")))))
    good = rows.where("error IS NULL")
    last = good.groupBy("document_id").agg(F.max("path").alias("path"))
    return good.join(last, ["document_id", "path"], "left_semi").unionByName(rows.where("error IS NOT NULL"))


class _Text(HTMLParser):
    """Text by line: scripts, styles and head links out, images as marks, table rows as cells."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.cells: list[str] | None = None
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "img":
            a = dict(attrs)
            self.handle_data(f"[图片: {a.get('alt') or 'image'}]({a.get('src') or ''})")
        elif tag == "tr":
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("td", "th") and self.cell is not None and self.cells is not None:
            self.cells.append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "tr" and self.cells is not None:
            self.out.append(" | ".join(self.cells))
            self.cells = None

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        (self.cell if self.cell is not None else self.out).append(data)


def html_lines(html: str) -> str:
    """The page's text, a line for each piece, blank lines dropped."""
    p = _Text()
    p.feed(html)
    p.close()
    return "\n".join(x for x in (line.strip() for piece in p.out for line in piece.split("\n")) if x)


def html_to_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key and text of each page; a narrow pass."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([html_lines(x or "") for x in part.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return pages.select(key, html).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, text string")


def atx_headings(text: str) -> str:
    """Underlined headings as # and ##; fenced code and rules after list items stay."""
    lines, out, fence = text.split("\n"), [], None
    for line in lines:
        mark = re.match(r"\s*(```|~~~)", line)
        if mark:
            fence = None if fence == mark[1] else fence or mark[1]
        under = re.fullmatch(r"(=+|-+)\s*", line)
        if not fence and under and len(line.strip()) >= 3 and out and out[-1].strip() and not out[-1].lstrip().startswith("#") and not (under[1][0] == "-" and re.match(r"\s*[-*]\s", out[-1])):
            out[-1] = ("# " if under[1][0] == "=" else "## ") + out[-1].strip()
        else:
            out.append(line)
    return "\n".join(out)


def canonical(document_id: F.Column, title: F.Column, author: F.Column, source_path: F.Column, body: F.Column) -> F.Column:
    """A document with front matter; the body begins with the title's heading, once."""
    head = F.concat(F.lit("# "), title)
    whole = F.when(F.startswith(F.ltrim(body), head), F.ltrim(body)).otherwise(F.concat_ws("\n\n", head, body))
    return F.concat(F.lit("---\ndocument_id: "), document_id, F.lit("\ntitle: "), title, F.lit("\nauthor: "), author, F.lit("\nsource_path: "), source_path, F.lit("\n---\n\n"), whole)


def with_id(text: F.Column, document_id: F.Column) -> F.Column:
    """The text with its first document_id line replaced, or one put first."""
    return F.when(F.rlike(text, F.lit("(?m)^document_id:")), F.regexp_replace(text, F.lit(r"(?ms)\A(.*?^)document_id:[^\n]*"), F.concat(F.lit("$1document_id: "), document_id))).otherwise(F.concat(F.lit("document_id: "), document_id, F.lit("\n"), text))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """doc_index, doc_id, rel_path, stratum and source of a JSON-lines manifest."""
    return spark.read.schema("doc_index long, doc_id string, rel_path string, stratum string, source string").json(path)


def write_versioned(rows: DataFrame, path: str, version: int) -> str:
    """Parquet under version=N; an existing version is never overwritten."""
    target = f"{path}/version={version}"
    rows.write.mode("error").parquet(target)
    return target


def read_latest(spark: SparkSession, path: str, version: int | None = None, seed: DataFrame | None = None) -> DataFrame:
    """A version, which must be there; without one the highest, or the seed where there is none at all."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(there)] if system.exists(there) else []
    known = [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]
    if version is not None and version not in known:
        raise ValueError(f"there is no version {version} under {path}")
    if not known:
        if seed is None:
            raise ValueError(f"there is no version under {path}")
        return seed
    return spark.read.parquet(path).where(F.col("version") == (max(known) if version is None else version))
