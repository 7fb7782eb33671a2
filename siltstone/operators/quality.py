"""Quality of a page's native text, and reconciliation of recognised text with it."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.ranges import HEADER, header_ranges
from ..functions.text import control_ratio, readable_ratio, strip, term_set

#: Thresholds of page quality and of duplicates.
MIN_CHARS, MIN_READABLE, MOST_CONTROL, MOST_REPEATED, SCANNED, USABLE = 40, 0.82, 0.03, 0.35, 0.65, 0.72
LAYOUT_BLOCKS, LAYOUT_COVERAGE, DPI = 8, 0.35, 180
SIMILAR, OVERLAP, NEW_TERMS, COMPACT_CHARS = 0.88, 0.92, 0.08, 20_000


def repeated_line_ratio(text: Column) -> Column:
    """Share of the non-empty lines that occur more than once; 0 for fewer than four. Runs of equal lines are found in
    the sorted list, so a document's lines never leave its row."""
    lines = F.array_sort(F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"), strip), lambda x: x != ""))

    def ratio(own: Column) -> Column:
        again = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: F.coalesce(F.get(own, i) == F.get(own, i - 1), F.lit(False)) | F.coalesce(F.get(own, i) == F.get(own, i + 1), F.lit(False)))
        return F.when(F.size(own) < 4, 0.0).otherwise(F.size(again) / F.greatest(F.size(own), F.lit(1)))

    # inside the lambda the sorted lines are a variable, worked out once
    return F.element_at(F.transform(F.array(lines), ratio), 1)


def page_quality(pages: DataFrame, text: str = "text", blocks: str = "text_block_count", coverage: str = "image_coverage") -> DataFrame:
    """Adds readable, control, repeated, reasons, score, usable, requires_layout, requires_ocr, recommended_dpi."""
    rows = pages.withColumn("__t", strip(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.withColumns({"readable": readable_ratio(F.col("__t")), "control": control_ratio(F.col("__t")), "repeated": repeated_line_ratio(F.col("__t")), "__n": F.length("__t")})
    scanned = (F.col(coverage) >= SCANNED) & (F.col(blocks) <= 1)
    tests = {
        "too_few_chars": F.col("__n") < MIN_CHARS,
        "low_readable_ratio": F.col("readable") < MIN_READABLE,
        "too_many_control_chars": F.col("control") > MOST_CONTROL,
        "too_many_repeated_lines": F.col("repeated") > MOST_REPEATED,
        "likely_scanned_page": scanned,
        "no_text_blocks": F.col(blocks) == 0,
    }
    loss = (
        F.least(F.lit(0.4), F.greatest(F.lit(0), MIN_CHARS - F.col("__n")) / MIN_CHARS * 0.4)
        + F.least(F.lit(0.25), F.greatest(F.lit(0.0), MIN_READABLE - F.col("readable")))
        + F.least(F.lit(0.2), F.col("control") * 4)
        + F.least(F.lit(0.2), F.col("repeated"))
        + F.when(scanned, 0.25).otherwise(0.0)
    )
    rows = rows.withColumns({"reasons": F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items()))), "score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - loss))})
    usable = (F.size("reasons") == 0) | ((F.col("score") >= USABLE) & ~scanned & (F.col(blocks) != 0))
    return rows.withColumns({"usable": usable, "requires_ocr": ~usable, "requires_layout": (F.col(blocks) > LAYOUT_BLOCKS) | (F.col(coverage) > LAYOUT_COVERAGE), "recommended_dpi": F.lit(DPI)}).drop("__t", "__n")


def ocr_adds_text(native: Column, recognised: Column) -> Column:
    """Five new terms or a tenth more text."""
    return (F.size(F.array_except(term_set(recognised), term_set(native))) >= 5) | (F.length(recognised) > F.length(native) * 1.1)


@F.pandas_udf(DoubleType())
def similarity(first: pd.Series, second: pd.Series) -> pd.Series:
    """SequenceMatcher ratio of the compacted texts; no expression gives it."""

    def compact(x: str | None) -> str:
        return " ".join((x or "").lower().split())[:COMPACT_CHARS]

    return pd.Series([SequenceMatcher(None, compact(a), compact(b)).ratio() for a, b in zip(first, second, strict=True)])


def is_ocr(kind: Column, source: Column) -> Column:
    return (kind == "ocr_overlay") | F.contains(F.lower(source), F.lit("ocr"))


def overlap_metrics(native_terms: Column, own_terms: Column) -> tuple[Column, Column]:
    """Shares of an element's terms that the native text has and lacks; 0 and 0 without terms."""
    n = F.greatest(F.size(own_terms), F.lit(1))
    return F.size(F.array_intersect(own_terms, native_terms)) / n, F.size(F.array_except(own_terms, native_terms)) / n


def reconcile(elements: DataFrame, with_similarity: bool = False) -> DataFrame:
    """elements: page_id, element_id, kind, source, text. Recognised elements that repeat the page's native text are
    marked duplicate, others on a page with native text are retyped. With terms the overlap alone decides, since the
    share of new terms is its complement; similarity decides only for texts without terms, and is worked out where
    asked for. Adds token_overlap, new_token_ratio, duplicate, kind_after."""
    marked = elements.withColumn("ocr", is_ocr(F.col("kind"), F.col("source")))
    native = marked.where(~F.col("ocr")).groupBy("page_id").agg(
        F.array_distinct(F.flatten(F.collect_list(term_set(F.col("text"))))).alias("native_terms"), F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("element_id", "text"))), lambda x: x["text"])).alias("native_text")
    )
    rows = marked.join(native, "page_id", "left")
    overlap, new = overlap_metrics(F.coalesce("native_terms", F.array().cast("array<string>")), term_set(F.col("text")))
    rows = rows.withColumns({"token_overlap": overlap, "new_token_ratio": new})
    like = similarity(F.col("native_text"), F.col("text")) if with_similarity else F.lit(0.0)
    rows = rows.withColumn("similarity", like)
    same = F.col("ocr") & F.col("native_text").isNotNull() & ((F.col("token_overlap") >= OVERLAP) | (F.col("similarity") >= SIMILAR)) & (F.col("new_token_ratio") < NEW_TERMS)
    return rows.withColumn("duplicate", same).withColumn("kind_after", F.when(F.col("ocr") & F.col("native_text").isNotNull() & ~same, F.lit("ocr_supplement")).otherwise(F.col("kind"))).drop("native_terms", "native_text")


def page_report(reconciled: DataFrame, route: str = "native") -> DataFrame:
    """For each page its counts, the sorted types that stay and its route."""
    counts = reconciled.groupBy("page_id").agg(
        F.count_if(~F.col("ocr")).alias("native_elements"), F.count_if("ocr").alias("ocr_elements"), F.count_if("duplicate").alias("duplicates_removed"),
        F.array_sort(F.collect_set(F.when(~F.col("duplicate"), F.col("kind_after")))).alias("element_types"),
    )
    suffix = F.when(F.col("native_elements") == 0, "").when(F.col("duplicates_removed") > 0, "_deduped").when(F.col("ocr_elements") > 0, "_reconciled").otherwise("")
    return counts.withColumn("processing_route", F.concat(F.lit(route), suffix))


#: Words of a native text by which its page has a layout that recognition may tell more of.
LAYOUT_WORDS = ["complete the table", "complete the flow chart", "complete the flowchart", "complete the diagram", "flow chart", "flowchart", "table."]


def merge_reasons(native: Column) -> Column:
    """Why a page's recognised text should be added to its native one: `layout_question`, and missing_question_numbers_a_b
    for each range of the text's headers of which fewer than half of the numbers (one at least) are visible."""
    low = F.lower(F.coalesce(native, F.lit("")))
    layout = F.when(F.exists(F.array(*map(F.lit, LAYOUT_WORDS)), lambda w: F.contains(low, w)), F.lit("layout_question"))
    bare = F.regexp_replace(low, HEADER, "")
    shown = F.transform(F.regexp_extract_all(bare, F.lit(r"(?<!\d)(\d{1,2})\s*[.)]|\((\d{1,2})\)"), 0), lambda x: F.regexp_replace(x, r"\D", "").cast("int"))
    ordered = F.transform(header_ranges(low), lambda r: F.struct(F.least(r["start"], r["end"]).alias("start"), F.greatest(r["start"], r["end"]).alias("end")))
    wide = F.filter(ordered, lambda r: r["end"] > r["start"])
    few = lambda r: F.size(F.array_intersect(F.sequence(r["start"], r["end"]), shown)) < F.greatest(F.lit(1), F.floor((r["end"] - r["start"] + 1) / 2))
    names = F.transform(F.filter(wide, few), lambda r: F.concat(F.lit("missing_question_numbers_"), r["start"].cast("string"), F.lit("_"), r["end"].cast("string")))
    return F.concat(F.array_compact(F.array(layout)), names)
