"""Text functions as column expressions: tokens, normalisation, ratios, token estimates."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that the lexical search ignores (English and Vietnamese).
STOPWORDS = ["a", "an", "and", "are", "các", "câu", "cho", "của", "from", "gì", "is", "là", "nội", "of", "the", "to", "trong", "từ", "về", "what", "what's"]
WORD = r"[\p{L}\p{N}_]+"
#: Zero-width characters that normalisation drops.
ZERO_WIDTH = "​‌‍﻿"


def tokens(text: Column) -> Column:
    """Lower-cased words, in order, repeats included."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), 1)


def search_terms(text: Column) -> Column:
    """Words without stop words and without single characters other than digits."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(tokens(text), lambda t: ((F.length(t) > 1) | t.rlike(r"^\p{Nd}$")) & ~F.array_contains(stop, t))


def plain_terms(text: Column) -> Column:
    """Distinct words without single characters other than digits; stop words stay."""
    return F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) > 1) | t.rlike(r"^\p{Nd}$")))


def term_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def query_terms(query: str) -> list[str]:
    """search_terms of a query that is a parameter, on the driver."""
    words = re.findall(r"\w+", query.lower())
    return [w for w in words if w not in STOPWORDS and (len(w) > 1 or w.isdigit())]


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def _nfkd_unmarked(text: pd.Series) -> pd.Series:
    def plain(x: str | None) -> str | None:
        if x is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFKD", x.casefold()) if not unicodedata.combining(c))

    return text.map(plain)


#: Characters that canonical composition may change or join with their neighbours: marks, Hangul letters,
#: and blocks that hold characters with another canonical form. Texts without any are composed already.
COMPOSED_BLOCKS = [(0x0340, 0x0387), (0x0958, 0x09DF), (0x0A33, 0x0A5E), (0x0B5C, 0x0B5D), (0x0F43, 0x0FB9), (0x1100, 0x11FF), (0x1F71, 0x1FFD), (0x2000, 0x2001), (0x2126, 0x212B), (0x2329, 0x232A), (0x2ADC, 0x2ADC), (0xF900, 0xFB4E), (0x1D15E, 0x1D1C0), (0x2F800, 0x2FA1D)]
MAY_COMPOSE = r"[\p{M}" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in COMPOSED_BLOCKS) + "]"


def nfc(text: Column, needed: bool = True) -> Column:
    """Canonical composition. Spark has no such function, so texts that may need it take Arrow batches through Python;
    of others nothing is sent."""
    return F.coalesce(_nfc(F.when(text.rlike(MAY_COMPOSE), text)), text) if needed else text


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once a row, however often it is used. Not for Python functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends (trim takes spaces only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Whitespace runs as one space, ends stripped."""
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def normalize_text(text: Column, compose: bool = True) -> Column:
    """The order matters: compose, drop zero-width characters, unify line ends, collapse blanks, rejoin hyphenated
    words, trim lines, leave at most one empty line, strip."""
    out = nfc(F.coalesce(text, F.lit("")), compose)
    for pattern, by in (
        (f"[{ZERO_WIDTH}]", ""),
        (r"\r\n|\r", "\n"),
        (r"[ \t\r\f\x0B]+", " "),
        (r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2"),
        (r" *\n *", "\n"),
        (r"\n{3,}", "\n\n"),
    ):
        out = F.regexp_replace(out, pattern, by)
    return strip(out)


def normalize_inline(text: Column, compose: bool = True) -> Column:
    return collapse(normalize_text(text, compose))


def normalize_reference(text: Column) -> Column:
    """ASCII letters and digits of the case-folded, decomposed text, runs joined by one space. A letter without a
    decomposition, such as đ, splits its word."""
    return F.array_join(F.regexp_extract_all(_nfkd_unmarked(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1), " ")


def normalize_reference_text(text: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))
    return " ".join(re.findall(r"[a-z0-9]+", plain))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def share_of(text: Column, pattern: str, empty: float) -> Column:
    """Share of the characters that the class matches; `empty` for no characters."""
    n = F.length(text)
    kept = F.length(F.regexp_replace(text, f"[^{pattern}]", ""))
    return F.when(n == 0, F.lit(empty)).otherwise(kept / F.when(n == 0, 1).otherwise(n))


def readable_ratio(text: Column) -> Column:
    """Letters, digits, white space, printable ASCII and U+00C0 to U+1EF9."""
    return share_of(text, r"\p{L}\p{N}\s\x20-\x7E\x{00C0}-\x{1EF9}", 0.0)


def control_ratio(text: Column) -> Column:
    """Unicode category C but line feeds and tabs; 1 for no characters."""
    return share_of(text, r"\p{C}&&[^\n\t]", 1.0)


def markdown_cells(row: Column) -> Column:
    """Cells between unescaped pipes, trimmed, outer pipes dropped."""
    inner = F.regexp_replace(F.regexp_replace(strip(row), r"^\|", ""), r"(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.regexp_replace(strip(c), r"\\\|", "|"))
