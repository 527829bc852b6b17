"""Text expressions: slugs, titles, tokens, hashes, paths and salvage of loose JSON. All run in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File suffixes by type.
FILE_TYPES = {"pdf": ["pdf"], "docx": ["docx", "doc"], "html": ["html", "htm"], "text": ["txt", "md", "rst"]}


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def file_type(path: Column) -> Column:
    """pdf, docx, html or text by suffix; null for others."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    out = F.lit(None).cast("string")
    for name, suffixes in FILE_TYPES.items():
        out = F.when(suffix.isin(suffixes), name).otherwise(out)
    return out


def doc_slug(path: Column) -> Column:
    """Identifier of a relative path: no suffix, hyphens for slashes and underscores, runs of hyphens as one."""
    stem = F.regexp_replace(path, r"\.[^./\\]+$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(F.translate(stem, "\\/_", "---"), "-+", "-"), "^-|-$", ""))


def doc_slug_plain(path: Column) -> Column:
    """As doc_slug, but runs of hyphens stay and ends aren't trimmed."""
    return F.lower(F.translate(F.regexp_replace(path, r"\.[^./\\]+$", ""), "/_", "--"))


def derived_id(path: Column) -> Column:
    """A dsid_ identifier in the name stays; else path_ and 24 digits of the path's SHA-1."""
    name = F.regexp_extract(path, r"(dsid_[0-9a-f]{32})", 1)
    return F.when(name != "", name).otherwise(F.concat(F.lit("path_"), F.substring(F.sha1(path), 1, 24)))


def stratum(path: Column, depth: int = 2) -> Column:
    """The first directory parts of a path."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(depth), F.greatest(F.size(parts) - 1, F.lit(0)))), "/")


def first_line(text: Column) -> Column:
    """The first line that isn't blank, without leading # and spaces, trimmed."""
    line = F.regexp_extract(text, r"(?U)^\s*([^\n]*)", 1)
    return strip(F.regexp_replace(line, "^[# ]+", ""))


def token_count(text: Column) -> Column:
    """Runs of word characters, and every other character that isn't white space."""
    return F.regexp_count(text, F.lit(r"(?U)\w+|[^\w\s]"))


def search_tokens(text: Column) -> Column:
    """CJK runs as overlapping pairs (one character alone stays), then Latin words and numbers, in order, with repeats."""
    low = F.lower(text)
    runs = F.regexp_extract_all(low, F.lit(r"([\x{4e00}-\x{9fff}]+)"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substr(r, i, F.lit(2))))))
    return F.concat(pairs, F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), F.lit(1)))


def query_tokens(query: str) -> list[str]:
    """search_tokens of a string on the driver."""
    low, out = query.lower(), []
    for run in re.findall("[一-鿿]+", low):
        out += [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
    return out + re.findall("[a-z0-9]+", low)


def occurrences(text: Column, term: str) -> Column:
    """How often a term stands in a text, without overlaps."""
    return (F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / F.lit(len(term))


def embedding_text(title: Column, heading: Column, content: Column) -> Column:
    """Title, heading and content by line; a heading that is empty or equals the title is left out."""
    again = heading.isNull() | (strip(heading) == "") | (strip(heading) == strip(title))
    return F.when(again, F.concat_ws("\n", title, content)).otherwise(F.concat_ws("\n", title, heading, content))


def classifier_text(title: Column, body: Column, most: int = 2000) -> Column:
    """The title twice and the head of the body."""
    return F.concat_ws("\n", title, title, F.substring(body, 1, most))


def chunk_id(doc: Column, index: Column, *identity: Column) -> Column:
    """Document, position and 12 digits of the SHA-256 of the identity's parts, joined by NUL."""
    return F.concat_ws("-", doc, F.lit("chunk"), F.lpad(index.cast("string"), 3, "0"), F.substring(F.sha2(F.concat_ws("\0", *identity), 256), 1, 12))


def cache_key(text: Column, fingerprint: str) -> Column:
    """Key of an encoder's result: of the text's hash and the encoder's settings."""
    return F.sha2(F.concat(F.sha2(text, 256), F.lit("|" + fingerprint)), 256)


def shard(identifier: Column) -> Column:
    """One of 256 folders, three digits, by the last byte of MD5."""
    return F.lpad(F.conv(F.right(F.md5(identifier), F.lit(2)), 16, 10), 3, "0")


def safe_name(name: Column) -> Column:
    """A base name of letters, digits, dot, hyphen and underscore; "file" if nothing is left."""
    base = F.element_at(F.split(F.translate(name, "\\", "/"), "/"), -1)
    clean = F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._-]", "_"), r"^[. ]+|[. ]+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("file"))


def truncated(text: Column, tokens: int, marker: str = "...") -> Column:
    """At most four characters a token, and a marker where something is cut."""
    return F.when(F.length(text) > 4 * tokens, F.concat(F.substring(text, 1, 4 * tokens), F.lit(marker))).otherwise(text)


def salvaged_json(text: Column) -> Column:
    """The JSON object in a loose answer: the whole, a fenced block, or from the first to the last brace; else {}."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    valid = [F.when(F.get_json_object(c, "$").isNotNull() & F.startswith(F.ltrim(c), F.lit("{")), c) for c in (text, fenced, braces)]
    return F.coalesce(*valid, F.lit("{}"))


def count_label(n: Column) -> Column:
    """3000 as 3k, 1500 as 1.5k, numbers below 1000 as they are."""
    whole = F.concat((n / 1000).cast("long").cast("string"), F.lit("k"))
    return F.when(n < 1000, n.cast("string")).when(n % 1000 == 0, whole).otherwise(F.concat(F.regexp_replace(F.format_number(n / 1000, 1), ",", ""), F.lit("k")))


def tagged(path: Column, rules: dict[str, str], defaults: list[str]) -> Column:
    """Default tags, then the tags of rules whose keyword the path has, each once, in the rules' order."""
    low = F.lower(path)
    hits = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(k.lower())), F.lit(t)) for k, t in rules.items())))
    return F.array_distinct(F.concat(F.array(*map(F.lit, defaults)), hits))


def percent(part: Column, whole: Column) -> Column:
    """Percent with two digits; 0 where the whole is 0."""
    return F.coalesce(F.round(F.try_divide(part * 100.0, whole), 2), F.lit(0.0))


def delta(new: Column, old: Column) -> Column:
    """A change with its sign and two digits."""
    return F.format_string("%+.2f", (new - old).cast("double"))


def plain_embedding_text(title: Column, path: Column, content: Column) -> Column:
    """Title, path of headings and content by line, whatever repeats."""
    return F.concat(title, F.lit("\n"), F.coalesce(path, F.lit("")), F.lit("\n"), content)


def snake_key(name: Column) -> Column:
    """Lower case, other signs as one underscore, none at the ends; "topic" if nothing is left."""
    key = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(key, F.lit("")), F.lit("topic"))


def safe_path(path: Column) -> Column:
    """A relative path without empty parts, "." and ".."."""
    return F.array_join(F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: ~p.isin("", ".", "..")), "/")


def title_and_body(text: Column) -> tuple[Column, Column]:
    """The first line that isn't blank, stripped, and the rest, stripped; line ends are made one."""
    lined = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\r", "\n")
    return strip(F.regexp_extract(lined, r"(?U)^\s*([^\n]*)", 1)), strip(F.regexp_replace(lined, r"(?U)^\s*[^\n]*", ""))


def named_title(text: Column, path: Column) -> Column:
    """The first line; where it is blank, the file's name after "__" in title case."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    words = F.regexp_replace(F.element_at(F.split(name, "__"), -1), "[-_]+", " ")
    return F.coalesce(F.nullif(first_line(text), F.lit("")), F.initcap(words))


def output_path(path: Column, root: str, suffix: str, flat: bool = False) -> Column:
    """A file's place under another root, in the same folders or in none, with another suffix."""
    name = F.element_at(F.split(path, "/"), -1) if flat else path
    return F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(name, r"\.[^./]*$", ""), F.lit(suffix))


def anchor_text(path: Column, description: Column) -> Column:
    """The names of a node's path and its description, as an encoder gets them."""
    return F.concat(F.array_join(path, " > "), F.lit(": "), F.coalesce(description, F.lit("")))


def fingerprint(rows_sorted: Column) -> Column:
    """A digest of an ordered list of strings; for lists that a tree or a prefix bounds."""
    return F.sha2(F.array_join(rows_sorted, "\n"), 256)
