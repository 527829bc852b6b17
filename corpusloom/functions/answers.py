"""Expressions that read a reviewer's loose answer: its decision and its bulleted sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: The decision's pattern, the sections' headings, and bullets that say nothing.
DECISION = r"(?i)(?:\*{2})?Decision(?:\*{2})?:?\s*(?:\*{2})?:?\s*(?:\*{2})?\s*(PASS|REVISE)\b"
HEADINGS = {
    "reasons": "Reasons:?",
    "unnecessary_content": "Unnecessary or out-of-scope content:?",
    "missing_information": "Missing important information:?",
    "unsupported_claims": "Unsupported claims:?",
}
NOTHING = ["none", "none.", "无", "n/a", "na"]


def decision(answer: Column) -> Column:
    """PASS or REVISE; null where the answer has neither."""
    return F.nullif(F.upper(F.regexp_extract(answer, DECISION, 1)), F.lit(""))


def bullets(section: Column) -> Column:
    """Lines without their marks and quotes, less those that say nothing."""
    lines = F.transform(F.split(section, "\n"), lambda x: strip(F.regexp_replace(strip(x), r"^[-*•\d.]+\s*", "")))
    lines = F.transform(lines, lambda x: F.regexp_replace(x, "^[\"']+|[\"']+$", ""))
    return F.filter(lines, lambda x: (x != "") & ~F.lower(x).isin(NOTHING))


def _above(values: Column, low: Column) -> Column:
    return F.filter(values, lambda x: x > low)


def review(answer: Column) -> Column:
    """A struct of the decision and the sections' bullets; a section ends where the next heading begins.

    Headings may come in any order; of a repeated one the first counts. Null and blank answers have no
    decision and empty sections.
    """
    whole = F.coalesce(answer, F.lit(""))
    heads = {name: rf"(?i)(?:^|\n)\s*\*{{0,2}}{p}" for name, p in HEADINGS.items()}
    begins = {name: F.regexp_instr(whole, F.lit(p)) for name, p in heads.items()}  # from 1; 0: none
    every = F.array(*begins.values())
    fields = []
    for name, p in heads.items():
        begin = begins[name]
        end = begin + F.length(F.regexp_substr(whole, F.lit(p)))
        after = F.coalesce(F.array_min(_above(every, begin)), F.length(whole) + 1)
        section = F.when(begin > 0, F.substring(whole, end, after - end)).otherwise("")
        fields.append(bullets(section).alias(name))
    return F.struct(decision(whole).alias("decision"), *fields)
