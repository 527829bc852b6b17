"""Raw files to documents with front matter: text of each type, metadata, and a sink that mirrors the folders."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import doc_slug, named_title, tagged
from .documents import decoded, html_lines

#: Fixed value: the name space of word processing documents.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Bytes that a document's main part may have unpacked.
MOST = 256 << 20


def docx_text(content: bytes) -> str:
    """The paragraphs of a word processing document that aren't blank, with a blank line between; tables are left out."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            if z.getinfo("word/document.xml").file_size > MOST:
                raise ValueError("the document is too large")
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise ValueError(f"not a word processing document: {e}") from None
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    out = []
    for p in body.findall(f"{_W}p") if body is not None else ():
        text = "".join((x.text or "") if x.tag == f"{_W}t" else marks.get(x.tag, "") for r in p.iter(f"{_W}r") for x in r)
        if text.strip():
            out.append(text)
    return "\n\n".join(out)


def texts_of(files: DataFrame) -> DataFrame:
    """path, modified, file_type, text and error of files (read_files); a file that can't be read has a reason, not a text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts: list[str | None] = []
            errors: list[str | None] = []
            for content, kind in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                try:
                    if kind not in ("docx", "html", "text"):
                        raise ValueError(f"no reader for {kind or 'this suffix'}")
                    texts.append(docx_text(content) if kind == "docx" else html_lines(decoded(content)) if kind == "html" else decoded(content))
                    errors.append(None)
                except ValueError as e:
                    texts.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "modified", "file_type", "text", "error"])

    return files.select("path", "modified", "content", "file_type").mapInArrow(run, "path string, modified timestamp, file_type string, text string, error string")


def metadata(rows: DataFrame, root: str, rules: dict[str, str], tags: list[str], author: str = "unknown", created_at: str | None = None) -> DataFrame:
    """The rows with source_path (below the root), document_id, title, author, created_at, updated_at, source_type and tags."""
    changed = F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss")
    rows = rows.withColumn("source_path", F.regexp_replace(F.translate("path", "\\", "/"), "^.*?" + _quoted(root.rstrip("/") + "/"), ""))
    return rows.withColumns({
        "document_id": doc_slug(F.col("source_path")), "title": named_title(F.col("text"), F.col("source_path")), "author": F.lit(author),
        "created_at": F.lit(created_at) if created_at else changed, "updated_at": changed, "source_type": F.col("file_type"), "tags": tagged(F.col("source_path"), rules, tags),
    })


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def front_matter(values: dict[str, Column], tags: Column, body: Column) -> Column:
    """A document: a line for each value, quoted where it must be, a list of tags, and the body."""
    quote = lambda c: F.when(F.rlike(c, F.lit(r"""^[\s\[\]{}&*!|>'"%@`#,?-]|: |\s#|[:\s]$|^(?:null|~|)$""")), F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(c)
    lines = [F.concat(F.lit(f"{k}: "), quote(F.regexp_replace(F.coalesce(v, F.lit("")), r"\s+", " "))) for k, v in values.items()]
    listed = F.when(F.size(tags) == 0, F.lit("tags: []")).otherwise(F.concat(F.lit("tags:\n"), F.array_join(F.transform(tags, lambda t: F.concat(F.lit("  - "), quote(t))), "\n")))
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines, listed), F.lit("\n---\n\n"), body)


def write_documents(rows: DataFrame, path: str) -> None:
    """document_id and text of each document as JSON lines in 256 folders by a hash, written whole or not at all."""
    shard = F.lpad(F.conv(F.right(F.md5("document_id"), F.lit(2)), 16, 10), 3, "0")
    rows.select("document_id", "text", shard.alias("shard")).repartition("shard").write.mode("error").partitionBy("shard").json(path)
