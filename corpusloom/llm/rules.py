"""Quality rules as a ledger: each rule runs once, its failure is a bit, its measurement stays.

A policy is a version number and a mask of rules. Verdicts, and what would change if a rule were left
out, come from the bits alone; the texts aren't read again.

n_marked_words counts words without a letter or digit, and those that end in two or more of "!" and "?". Words and
windows of words are told apart by 64-bit hashes.

Nulls: a null text has no words and fails too_few_words. Empty texts likewise. Repeated rows give
repeated ledger rows; no row depends on another. Very long texts are taken whole. An empty table gives no row. Other
columns of the input stay in keep_good(), whatever their names, and aren't carried elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import FOLD, SPACED, Words, chunks, text_bytes, tidy

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marked_words", "longest_word", "n_echo_words")
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
#: Words in a window; a window that comes twice counts as repetition.
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A text fails if the condition over its measurements (arrays, one entry a text) holds."""

    bit: int
    name: str
    fails: Callable[[dict[str, np.ndarray]], np.ndarray]


RULES = (
    Rule(0, "too_few_words", lambda m: m["n_words"] < 20),
    Rule(1, "repeated_windows", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    Rule(2, "symbols", lambda m: 10 * m["n_symbols"] > 3 * m["n_words"]),
    Rule(3, "upper_case", lambda m: (m["n_letters"] >= 50) & (2 * m["n_upper"] > m["n_letters"])),
    Rule(4, "duplicate_lines", lambda m: (m["n_lines"] >= 4) & (2 * m["n_dup_lines"] > m["n_lines"])),
    Rule(5, "word_length", lambda m: (m["n_words"] > 0) & ((m["word_chars"] > 14 * m["n_words"]) | (m["word_chars"] < 2 * m["n_words"]))),
    Rule(6, "shouted_words", lambda m: 20 * m["n_marked_words"] > 3 * m["n_words"]),
    Rule(7, "endless_word", lambda m: m["longest_word"] > 1000),
    Rule(8, "echoed_words", lambda m: 10 * m["n_echo_words"] > 3 * m["n_words"]),
)
BASE_MASK = 0b11
#: Versions stay as they are; a change is a new version.
POLICIES = {1: 0b11, 2: 0b1111, 3: 0b101111111}
CURRENT = 3


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The measurements of some texts."""
    t = Words(texts, SPACED)
    n = len(texts)
    ends = t.begins[1:] - 1
    raw = t.raw

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(flags, dtype=np.int64)])
        return total[ends] - total[t.begins[:-1]]

    out = {"n_words": t.counts.astype(np.int64)}
    out["word_chars"] = per_text((t.folded != 0) & ((raw & 0xC0) != 0x80))
    out["n_symbols"] = per_text(_SYMBOLS[raw])
    upper = (raw >= 65) & (raw <= 90)
    out["n_upper"] = per_text(upper)
    out["n_letters"] = per_text(upper | ((raw >= 97) & (raw <= 122)))
    length = (t.ends - t.starts).astype(np.int64)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, t.owner, length)
    out["longest_word"] = longest
    shout = (raw == 33) | (raw == 63)
    marked = shout[t.ends - 1] & shout[np.maximum(t.ends - 2, t.starts)] & (length > 1)
    written = np.concatenate([np.zeros(1, np.int64), np.cumsum(FOLD[raw] != 0)])  # letters, digits and bytes beyond ASCII
    marked |= written[t.ends] == written[t.starts]
    out["n_marked_words"] = np.bincount(t.owner, weights=marked, minlength=n).astype(np.int64)
    dup, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, text in enumerate(texts):
        if b"\n" in text:
            full = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
            lines[i], dup[i] = len(full), len(full) - len(set(full))
        else:
            lines[i] = t.counts[i] > 0
    out["n_dup_lines"], out["n_lines"] = dup, lines
    echo = (t.hashes[1:] == t.hashes[:-1]) & (t.owner[1:] == t.owner[:-1])
    out["n_echo_words"] = np.bincount(t.owner[1:][echo], minlength=n).astype(np.int64)
    at, h = t.windows(WINDOW)
    repeat = np.zeros(n, np.int64)
    if len(at):
        with np.errstate(over="ignore"):
            h = h + t.owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(h)
        s, o = h[order], t.owner[at[order]]
        same = (s[1:] == s[:-1]) & (o[1:] == o[:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        first = np.zeros(len(t.starts) + WINDOW, bool)
        first[at[twice] + WINDOW] = True
        seen = np.cumsum(first)
        inside = seen[WINDOW:] > seen[: len(t.starts)]
        repeat = np.bincount(t.owner, weights=inside, minlength=n).astype(np.int64)
    out["n_repeat_words"] = repeat
    return out


def failures(m: dict[str, np.ndarray], rules: tuple[Rule, ...] = RULES) -> np.ndarray:
    """The failure bits of some texts."""
    return sum((r.fails(m).astype(np.int64) << r.bit for r in rules), np.zeros(len(m["n_words"]), np.int64))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measurements and ``failed``, the bits of the rules that the text fails; one narrow pass."""

    def measured(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = text_bytes(part.column(1))
            for a, b in chunks(texts):
                m = measure(texts[a:b])
                columns = [*(pa.array(m[k], pa.int64()) for k in MEASURES), pa.array(failures(m, rules), pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), *columns], names=["doc_id", *MEASURES, "failed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{k} long" for k in (*MEASURES, "failed"))
    return docs.select("doc_id", "text").mapInArrow(tidy(measured), schema)


def passes(failed: Column | str, mask: int) -> Column:
    """Whether none of the mask's rules failed."""
    failed = F.col(failed) if isinstance(failed, str) else failed
    return failed.bitwiseAND(F.lit(mask).cast("long")) == 0


def verdicts(rows: DataFrame, policies: dict[int, int] = POLICIES) -> DataFrame:
    """The ledger with a column kept_vN for each policy."""
    return rows.withColumns({f"kept_v{v}": passes("failed", m) for v, m in policies.items()})


def ablations(rows: DataFrame, mask: int = POLICIES[CURRENT], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: texts that fail it, that fail it alone, and that all others would keep.

    The ledger is first counted by its bits (at most two to the number of rules), so no text is read.
    """
    counted = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("failed")).agg(F.count("*").alias("n"))
    of_rule = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules if mask >> r.bit & 1))).alias("r")
    hit = F.col("failed").bitwiseAND(F.col("r.bit")) != 0
    return (
        counted.select("failed", "n", of_rule)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("failed") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
            F.sum(F.when((F.col("failed") == 0) | (F.col("failed") == F.col("r.bit")), F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )


def keep_good(docs: DataFrame, mask: int = POLICIES[CURRENT]) -> DataFrame:
    """The rows whose text passes a policy, with all their columns.

    Each row is judged where it is read: no join, no shuffle.
    """
    names = docs.columns
    schema = docs.schema

    def kept(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = text_bytes(part.column(names.index("text")))
            keep = np.zeros(len(texts), bool)
            for a, b in chunks(texts):
                keep[a:b] = (failures(measure(texts[a:b])) & mask) == 0
            yield part.filter(pa.array(keep))

    return docs.mapInArrow(tidy(kept), schema)
