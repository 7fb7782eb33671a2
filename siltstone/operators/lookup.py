"""Lookups by metadata alone: overview, units, ranges, parents and children, deduplication.

Rows are chunks with position or chunk_index as their order; every limit has a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import overlap_size, overlaps

#: Unit types that an overview shows first.
OUTLINE_UNITS = ["document_outline", "passage_summary", "writing_prompt", "writing_table", "writing_task", "sample_answer"]
ENOUGH_TOKENS = 80
NO_PAGE = 999


def in_scope(chunks: DataFrame, document_ids: list | None) -> DataFrame:
    if document_ids is None:
        return chunks
    return chunks.where(F.col("document_id").isin(document_ids)) if document_ids else chunks.limit(0)


def mark(rows: DataFrame, method: Column | str, score: Column | float) -> DataFrame:
    """Adds retrieval_method and structured_score."""
    return rows.withColumns({"retrieval_method": method if isinstance(method, Column) else F.lit(method), "structured_score": score.cast("double") if isinstance(score, Column) else F.lit(float(score))})


def first_per_key(rows: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each key. n is small, so Spark keeps n rows a key and task before it shuffles."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def document_chunks(chunks: DataFrame, top_k: int = 8, document_ids: list | None = None) -> DataFrame:
    rows = in_scope(chunks, document_ids).orderBy("chunk_index", "position").limit(max(1, min(top_k, 50)))
    return mark(rows, "explicit_scope", 1.0)


def unit_lookup(chunks: DataFrame, unit_types: list[str], top_k: int, document_ids: list | None = None) -> DataFrame:
    rows = in_scope(chunks, document_ids).where(F.col("unit_type").isin(unit_types)).orderBy("chunk_index", "position").limit(top_k)
    return mark(rows, "structured_unit", 1.0)


def overview(chunks: DataFrame, top_k: int = 8, document_ids: list | None = None) -> DataFrame:
    """Outline rows, then the first passage of each (document, passage number); without outline rows the first rows by
    page, those of enough tokens if there are any. Three bounded candidate lists, of which one row decides."""
    top_k = max(1, min(top_k, 50))
    rows = in_scope(chunks, document_ids)
    outline = mark(rows.where(F.col("unit_type").isin(OUTLINE_UNITS)).orderBy("chunk_index", "position").limit(top_k), "overview", 1.0).withColumn("__tier", F.lit(0))
    passages = first_per_key(rows.where("unit_type = 'passage'"), ["document_id", "passage_number"], ["chunk_index", "position"])
    passages = mark(passages.orderBy("chunk_index", "position").limit(top_k), "overview_passage", 0.8).withColumn("__tier", F.lit(1))
    page = F.coalesce(F.array_min("pages"), F.lit(NO_PAGE))
    plain = rows.withColumns({"__page": page, "__enough": F.coalesce(F.col("token_count"), F.lit(0)) >= ENOUGH_TOKENS})
    plain = plain.orderBy(F.desc("__enough"), "__page", "chunk_index", "position").limit(top_k)
    fallback = mark(plain, "overview_fallback", 1.0).withColumn("__tier", F.when(F.col("__enough"), 2).otherwise(3))
    # at most 3 * top_k rows from here on
    found = outline.unionByName(passages).unionByName(fallback.drop("__enough"), allowMissingColumns=True)
    whole = Window.partitionBy(F.lit(0))
    ranked = found.withColumns({"__best": F.min("__tier").over(whole), "__plain": F.min(F.when(F.col("__tier") >= 2, F.col("__tier"))).over(whole)})
    chosen = ranked.where(F.when(F.col("__best") == 0, F.col("__tier") <= 1).otherwise(F.col("__tier") == F.col("__plain")))
    return chosen.orderBy("__tier", F.coalesce("__page", F.lit(0)), "chunk_index", "position").limit(top_k).drop("__tier", "__best", "__plain", "__page")


def question_lookup(chunks: DataFrame, ranges: list[tuple[int, int]], top_k: int, document_ids: list | None = None) -> DataFrame:
    start, end = F.col("range_start"), F.col("range_end")
    score = F.lit(0.0)
    for a, b in ranges:
        x, y = F.lit(a), F.lit(b)
        kind = F.when((start == a) & (end == b), 100.0).when((start <= a) & (end >= b), 70.0).otherwise(30.0)
        unit = F.when(F.col("unit_type") == "question_group", 15.0).otherwise(8.0)
        score = score + F.when(overlaps(x, y, start, end), overlap_size(x, y, start, end) + kind + unit).otherwise(0.0)
    rows = in_scope(chunks, document_ids).where(F.col("unit_type").isin("question_group", "question") & start.isNotNull() & end.isNotNull())
    return mark(rows, "structured_question", score).where("structured_score > 0").orderBy(F.desc("structured_score"), "position").limit(top_k)


def visual_lookup(chunks: DataFrame, ranges: list[tuple[int, int]], visual: str, question_type: str, top_k: int, prefer_writing: bool = False, document_ids: list | None = None, writing_document: str = "writing_task_1") -> DataFrame:
    """has_visual says whether the chunk carries the visual's data."""
    is_visual = F.coalesce((F.col("unit_type") == visual) | (F.col("question_type") == question_type), F.lit(False))
    writing = F.col("unit_type").isin("writing_table", "table_row") & F.lit(visual == "table")
    rows = in_scope(chunks, document_ids).where(is_visual | writing)
    if prefer_writing:
        rows = rows.where(writing | (F.col("document_type") == writing_document))
    score = F.when(is_visual, 40.0).otherwise(20.0) + F.when(F.col("has_visual"), 20.0).otherwise(0.0) + F.when(writing, 20.0).otherwise(0.0)
    if ranges:
        met = F.lit(False)
        for a, b in ranges:
            met = met | overlaps(F.lit(a), F.lit(b), F.col("range_start"), F.col("range_end"))
        rows, score = rows.where(met), score + 60.0
    return mark(rows, f"structured_{visual}", score).orderBy(F.desc("structured_score"), "position").limit(top_k)


def canonical_chunk_id(chunk_id: Column, document_id: Column) -> Column:
    """A local id gets its document's prefix unless it has it."""
    value, scope = F.trim(F.coalesce(chunk_id, F.lit(""))), F.trim(F.coalesce(document_id, F.lit("")))
    prefix = F.concat(scope, F.lit("-"))
    return F.when((value == "") | (scope == "") | F.startswith(value, prefix), value).otherwise(F.concat(prefix, value))


def question_context(sources: DataFrame, chunks: DataFrame, top_k: int | None = 8, document_ids: list | None = None) -> DataFrame:
    """For questions their groups, for groups themselves and the questions of the same range; all without top_k."""
    parents = sources.where("unit_type = 'question' and parent_id <> ''").select("document_id", canonical_chunk_id(F.col("parent_id"), F.col("document_id")).alias("key")).distinct()
    spans = sources.where("unit_type = 'question_group' and range_start is not null and range_end is not null").select("document_id", "range_start", "range_end").distinct()
    rows = in_scope(chunks, document_ids)
    groups = rows.where("unit_type = 'question_group'").withColumn("key", canonical_chunk_id(F.col("chunk_id"), F.col("document_id")))
    by_parent = groups.join(parents, ["document_id", "key"], "left_semi").drop("key")
    by_span = groups.drop("key").join(spans, ["document_id", "range_start", "range_end"], "left_semi").select(*by_parent.columns)
    children = rows.where("unit_type = 'question'").join(spans, ["document_id", "range_start", "range_end"], "left_semi").select(*by_parent.columns)
    found = mark(by_parent.unionByName(by_span), "parent_question_group", 1.0).dropDuplicates(["document_id", "chunk_id"]).unionByName(mark(children, "child_question", 0.8))
    return found if top_k is None else found.orderBy("chunk_index", "position").limit(top_k)


def passage_context(sources: DataFrame, chunks: DataFrame, most: int = 3, document_ids: list | None = None) -> DataFrame:
    keys = sources.where("passage_number is not null and passage_number <> 0").select("document_id", "passage_number").distinct()
    rows = in_scope(chunks, document_ids).where("unit_type = 'passage'").join(keys, ["document_id", "passage_number"], "left_semi")
    return mark(first_per_key(rows, ["document_id", "passage_number"], ["chunk_index", "position"], most), "parent_passage", 1.0)


def sibling_context(sources: DataFrame, chunks: DataFrame, top_k: int = 4, document_ids: list | None = None) -> DataFrame:
    """Tasks and answers that share the parent of the first source that has one."""
    units = ["writing_task", "sample_answer"]
    target = sources.where(F.col("unit_type").isin(units) & (F.col("parent_id") != "")).orderBy("position").limit(1).select("document_id", "parent_id")
    rows = in_scope(chunks, document_ids).where(F.col("unit_type").isin(units)).join(F.broadcast(target), ["document_id", "parent_id"], "left_semi")
    return mark(rows.orderBy("chunk_index", "position").limit(top_k), "writing_parent", 1.0)


def dedupe_first(rows: DataFrame, keys: list[str], position: str = "position") -> DataFrame:
    """The first row of each key in the given order (dropDuplicates keeps any)."""
    return first_per_key(rows, keys, [position])
