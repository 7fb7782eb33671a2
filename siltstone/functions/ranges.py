"""Numbered ranges: finding them in text, and whether they meet."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a query names numbered items (English and Vietnamese).
ITEM = "questions?|question|câu hỏi|câu"
QUERY_RANGE = rf"(?:{ITEM})\s*(?:từ\s+)?(\d{{1,2}})(?:\s*(?:-|–|to)\s*(?:{ITEM})?\s*(\d{{1,2}}))?"
HEADER = r"questions?\s+(\d{1,2})\s*(?:-|–|to)\s*(\d{1,2})"
RANGE = "array<struct<start:int,end:int>>"


def _pairs(text: Column, pattern: str, swap: bool) -> Column:
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("a"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("b"))

    def pair(x: Column) -> Column:
        a = x["a"].cast("int")
        b = F.when(x["b"] == "", a).otherwise(F.nullif(x["b"], F.lit("")).cast("int"))
        low, high = (F.least(a, b), F.greatest(a, b)) if swap else (a, b)
        return F.struct(low.alias("start"), high.alias("end"))

    return F.transform(both, pair)


def query_ranges(text: Column) -> Column:
    """All ranges that a query names; one number is a range of one; reversed ends are swapped."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "đến|tới", "to")
    return _pairs(plain, QUERY_RANGE, swap=True)


def ranges_of(query: str) -> list[tuple[int, int]]:
    """query_ranges of a query that is a parameter."""
    plain = query.lower().replace("đến", "to").replace("tới", "to")
    found = [(int(m[1]), int(m[2] or m[1])) for m in re.finditer(QUERY_RANGE, plain)]
    return [(min(x), max(x)) for x in found]


def header_ranges(text: Column) -> Column:
    return _pairs(F.lower(F.coalesce(text, F.lit(""))), HEADER, swap=False)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Inclusive ends; a range with a null end meets none (greatest and least would skip the null)."""
    return F.coalesce((a_start <= a_end) & (a_start <= b_end) & (b_start <= a_end) & (b_start <= b_end), F.lit(False))


def overlap_size(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.least(a_end, b_end) - F.greatest(a_start, b_start) + 1


def meeting(left: DataFrame, a_start: str, a_end: str, right: DataFrame, b_start: str, b_end: str) -> DataFrame:
    """Pairs of rows whose ranges meet: an equi-join on the first number that both cover, so each pair comes once.
    Ranges are over a document's item numbers, so they are short. Column names of both sides must differ."""
    numbers = lambda low, high: F.explode(F.when(F.col(low) <= F.col(high), F.sequence(low, high)))
    both = left.withColumn("__n", numbers(a_start, a_end)).join(right.withColumn("__n", numbers(b_start, b_end)), "__n")
    return both.where(F.col("__n") == F.greatest(a_start, b_start)).drop("__n")
