"""From intent to operators: intents, constraints, filters by intent, packets of exact questions, completeness, evidence."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grammar as G
from ..functions.ranges import overlaps, ranges_of
from . import lookup
from .tables import cell_lookup_score

#: The intents, those that show a visual, and how many rows of evidence a question and a request may have.
INTENTS = [
    "document_overview", "show_questions", "translate_questions", "translate_content", "explain_questions", "solve_questions", "semantic_qa", "show_table", "extract_table", "table_cell", "table_calculation", "table_comparison", "show_flowchart",
    "show_diagram", "show_writing_prompt", "writing_generation",
]
QUESTION_INTENTS = ["show_questions", "translate_questions", "explain_questions", "solve_questions"]
TABLE_INTENTS = ["show_table", "extract_table", "table_cell", "table_calculation", "table_comparison"]
TABLE_OPERATIONS = ["table_cell", "table_calculation", "table_comparison"]
TABLE_UNITS = {"table", "table_row", "writing_table"}
EVIDENCE_EACH, EVIDENCE_ALL = 2, 12
#: How a request forbids solving or writing: a negation and an act, or a phrase by itself.
NEGATIONS = ("không", "chưa")
NOT_SOLVED = (r"(?:tự\s+)?giải(?!\s*thích)", rf"{G.one_of('đưa', 'điền')}\s+(?:ra\s+)?{G.phrase('đáp án')}", rf"chọn\s+(?:\S+\s+){{0,3}}?{G.phrase('đáp án')}", "ghép")
NOT_WRITTEN = (rf"viết\s+{G.one_of('bài', 'đoạn', 'report', 'essay')}", r"viết(?=\s*(?:[.!?]|$))")
KEPT_BLANK = G.phrase("giữ nguyên ô trống")
ONLY_SHOWN = rf"chỉ\s+{G.one_of('trình bày', 'nêu', 'giải thích', 'mô tả')}\s+(?:phần\s+)?{G.one_of('yêu cầu', 'đề bài', 'prompt')}"
_NOT = rf"\b{G.one_of(*NEGATIONS)}\s+"
NO_SOLUTION = rf"(?i){_NOT}(?:{'|'.join(NOT_SOLVED)})(?![\p{{L}}\p{{N}}_])|\b{KEPT_BLANK}\b"
NO_WRITING = rf"(?i){_NOT}(?:{'|'.join(NOT_WRITTEN)})(?![\p{{L}}\p{{N}}_])|\b{ONLY_SHOWN}\b"
PASSAGE = re.compile(rf"(?:reading\s+)?passage\s+(\d{{1,2}}|{'|'.join(G.COUNT_WORDS)})\b")


def passage_number(message: str) -> int | None:
    m = PASSAGE.search(message.lower())
    return None if not m else int(m[1]) if m[1].isdigit() else G.COUNT_WORDS[m[1]]


def allowed_intents(message: str, unit_types: set[str], has_affinity: bool = False) -> list[str]:
    """Intents that the message and the catalog can serve, in their order: questions need a range or a question that is
    being talked about, operations on tables a table."""
    gone = set(QUESTION_INTENTS) if not ranges_of(message) and not has_affinity else set()
    gone |= set(TABLE_OPERATIONS) if not unit_types & TABLE_UNITS else set()
    return [x for x in INTENTS if x not in gone]


def allowed_by_document(messages: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """allowed_intents of every message: messages have key, has_range and has_affinity; catalog has key and
    unit_types. Adds intents."""
    units = catalog.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("unit_types"))).alias("__u"))
    rows = messages.join(units, key, "left")
    asked, tables = F.col("has_range") | F.col("has_affinity"), F.coalesce(F.arrays_overlap("__u", F.array(*map(F.lit, sorted(TABLE_UNITS)))), F.lit(False))
    kept = F.filter(F.array(*map(F.lit, INTENTS)), lambda x: (asked | ~x.isin(QUESTION_INTENTS)) & (tables | ~x.isin(TABLE_OPERATIONS)))
    return rows.withColumn("intents", kept).drop("__u")


def constrain(message: Column, intent: Column) -> Column:
    """Solving becomes showing where the message forbids solving, writing likewise."""
    return F.when((intent == "solve_questions") & message.rlike(NO_SOLUTION), F.lit("show_questions")).when((intent == "writing_generation") & message.rlike(NO_WRITING), F.lit("show_writing_prompt")).otherwise(intent)


def structured_lookup(chunks: DataFrame, message: str, intent: str, top_k: int = 8, document_ids: list | None = None) -> DataFrame:
    """The rows that an intent asks for; nothing for one that has no structured form."""
    ranges = ranges_of(message)
    writing = any(x in message.lower() for x in ("writing", "ảnh", "hình", "image", "task 1"))

    def visual(unit: str, kind: str, prefer: bool = False) -> Callable[[], DataFrame]:
        return lambda: lookup.visual_lookup(chunks, ranges, unit, kind, top_k, prefer, document_ids)

    builders: dict[str, Callable[[], DataFrame]] = {
        "document_overview": lambda: lookup.overview(chunks, top_k, document_ids),
        **{k: visual("table", "table_completion", writing) for k in TABLE_INTENTS if k != "table_cell"},
        "table_cell": lambda: table_cells(chunks, message, top_k, document_ids),
        "show_flowchart": visual("flowchart", "flowchart_completion"),
        "show_diagram": visual("diagram", "diagram_completion"),
        "show_writing_prompt": lambda: lookup.unit_lookup(chunks, ["writing_prompt", "writing_task"], top_k, document_ids),
        "writing_generation": lambda: lookup.unit_lookup(chunks, ["writing_prompt", "writing_table"], top_k, document_ids),
    }
    if ranges:
        builders |= {k: lambda: lookup.question_lookup(chunks, ranges, top_k, document_ids) for k in QUESTION_INTENTS}
    return builders[intent]() if intent in builders else chunks.limit(0)


def table_cells(chunks: DataFrame, message: str, top_k: int, document_ids: list | None = None) -> DataFrame:
    """Chunks of tables by the score of their best cell, best first; chunks without cells (an array of row_idx, label,
    col_idx, column, value) have none."""
    rows = lookup.in_scope(chunks, document_ids).where(F.col("unit_type").isin(sorted(TABLE_UNITS)))
    if "cells" not in chunks.columns:
        return rows.limit(0)
    cells = rows.select(F.col("chunk_id").alias("table_id"), F.explode("cells").alias("c")).select("table_id", "c.*")
    scored = rows.join(cell_lookup_score(cells, message).withColumnRenamed("table_id", "chunk_id"), "chunk_id")
    return lookup.mark(scored.drop("structured_score"), "structured_table_cell", scored["structured_score"]).orderBy(F.desc("structured_score"), "position").limit(top_k)


def filter_for_intent(sources: DataFrame, message: str, intent: str) -> DataFrame:
    """Sources of the passage that the message names, of the kind that the intent shows, and of its ranges."""
    number = passage_number(message)
    if number is not None:
        sources = sources.where((F.col("passage_number") == number) | (F.col("unit_type") == "document_outline"))
    if intent in TABLE_INTENTS:
        return sources.where(F.col("unit_type").isin("writing_table", "table", "table_row") | (F.col("question_type") == "table_completion"))
    if intent in ("show_flowchart", "show_diagram"):
        kind = intent.removeprefix("show_")
        return sources.where((F.col("unit_type") == kind) | (F.col("question_type") == f"{kind}_completion"))
    ranges = ranges_of(message)
    if not ranges or intent not in ("show_questions", "explain_questions", "translate_questions"):
        return sources
    met = F.lit(False)
    for a, b in ranges:
        met = met | overlaps(F.lit(a), F.lit(b), F.col("range_start"), F.col("range_end"))
    return sources.where(F.col("unit_type").isin("question_group", "question") & met)


def requested_numbers(message: str) -> list[int]:
    return list(dict.fromkeys(n for a, b in ranges_of(message) for n in range(a, b + 1)))


def exact_questions(sources: DataFrame, message: str) -> DataFrame:
    return sources.where((F.col("unit_type") == "question") & (F.col("range_start") == F.col("range_end")) & F.col("range_start").isin(requested_numbers(message)))


def answer_kind(stated: Column, instructions: Column, question: Column, has_options: Column) -> Column:
    """How a question is to be answered, from its parsed type and its words."""
    said = F.lower(F.concat_ws("\n", instructions, question))
    kind = F.regexp_replace(F.lower(F.trim(F.coalesce(stated, F.lit("")))), "-", "_")
    has = lambda *w: [F.contains(said, F.lit(x)) for x in w]
    t, f, n, y, no = has("true", "false", "not given", "yes", "no")
    m1, m2, m3 = has("match each", "match the", "with one of")
    listed = said.rlike(r"from\s+the\s+list\s+below|choose\s+(?:the\s+)?(?:correct\s+|appropriate\s+)?letters?|which\s+(?:(?:two|three|four|\d+)\s+)?of\s+the\s+following|list\s+of\s+headings")
    return (
        F.when((kind == "true_false_not_given") | (t & f & n), "true_false_not_given").when((kind == "yes_no_not_given") | (y & no & n), "yes_no_not_given")
        .when((kind == "matching") | (has_options & (m1 | m2 | m3)), "matching").when((kind == "multiple_choice") | has_options | listed, "multiple_choice")
        .when(kind.isin("short_answer", "short_answer_examples") | word_limit(said).isNotNull(), "short_answer").otherwise(F.coalesce(F.nullif(kind, F.lit("")), F.lit("unknown")))
    )


def word_limit(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    a = F.regexp_extract(low, r"\bno\s+more\s+than\s+(one|two|three|four|\d+)\s+words?\b", 1)
    b = F.regexp_extract(low, r"\b(one|two|three|four|\d+)\s+words?\s+only\b", 1)
    said = F.when(a != "", a).otherwise(b)
    out = F.when(said.rlike(r"^\d+$"), said.cast("int"))
    for word, n in list(G.COUNT_WORDS.items())[:4]:
        out = F.when(said == word, n).otherwise(out)
    return out


def option_labels(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?:^|\s)([A-H])(?:[.)]|\s+(?=\S))"), 1))


def solve_packets(sources: DataFrame, message: str) -> DataFrame:
    """One row for each requested number that has one question: its group (by parent, else by range) if that is one,
    its passage, its evidence and what is wrong. Questions, groups and passages meet by equi-joins on the document."""
    first = sources.withColumn("__rn", F.row_number().over(Window.partitionBy("chunk_id").orderBy("position"))).where("__rn = 1").drop("__rn")
    exact = exact_questions(first, message).withColumn("number", F.col("range_start"))
    exact = exact.withColumn("__n", F.count("*").over(Window.partitionBy("number"))).where("__n = 1")
    asked = exact.select("number", "document_id", F.col("chunk_id").alias("question_chunk_id"), F.col("text").alias("question_text"), F.col("passage_number").alias("question_passage"), F.col("question_type").alias("stated"), lookup.canonical_chunk_id(F.col("parent_id"), F.col("document_id")).alias("parent"))
    groups = first.where("unit_type = 'question_group'").select("document_id", lookup.canonical_chunk_id(F.col("chunk_id"), F.col("document_id")).alias("group_id"), F.col("passage_number").alias("group_passage"), "instructions", F.col("text").alias("group_text"), F.col("question_type").alias("group_type"), F.col("range_start").alias("gs"), F.col("range_end").alias("ge"))
    by_parent = asked.where("parent <> ''").join(groups.withColumnRenamed("group_id", "parent"), ["document_id", "parent"]).withColumn("group_id", F.col("parent"))
    covers = groups.withColumn("number", F.explode(F.sequence("gs", "ge")))
    by_range = asked.where("parent = ''").join(covers, ["document_id", "number"])
    fields = ["group_id", "group_passage", "instructions", "group_text", "group_type"]
    found = by_parent.select("number", *fields).unionByName(by_range.select("number", *fields)).groupBy("number").agg(F.count("*").alias("groups"), *(F.first(c).alias(c) for c in fields))
    rows = asked.join(found, "number", "left").withColumns({c: F.when(F.col("groups") == 1, F.col(c)) for c in fields}).withColumn("groups", F.coalesce("groups", F.lit(0)))
    rows = rows.withColumns({"passage_number": F.coalesce("question_passage", "group_passage"), "mismatch": F.coalesce(F.col("question_passage") != F.col("group_passage"), F.lit(False))})
    passages = first.where("unit_type = 'passage'").select("document_id", "passage_number", F.col("chunk_id").alias("pid"), F.col("position").alias("pos"))
    evidence = rows.where("groups = 1 and not mismatch").join(passages, ["document_id", "passage_number"]).groupBy("number").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "pid"))), lambda x: x["pid"]).alias("evidence"))
    rows = rows.join(evidence, "number", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))
    labels = option_labels(F.concat(F.lit(" "), F.regexp_replace("question_text", r"^\s*\d{1,3}\s*[.)]\s*", "")))
    rows = rows.withColumn("labels", labels)
    shared = option_labels(F.col("group_text"))
    rows = rows.withColumn("kind", answer_kind(F.coalesce("stated", "group_type"), F.col("instructions"), F.col("question_text"), (F.size("labels") >= 2) | (F.size(F.coalesce(shared, F.array().cast("array<string>"))) >= 2)))
    rows = rows.withColumn("labels", F.when((F.col("kind") == "matching") & (F.size("labels") < 2), shared).otherwise(F.col("labels")))
    wants = F.col("kind").isin("multiple_choice", "matching") & (F.coalesce(F.size("labels"), F.lit(0)) < 2)
    warnings = F.array_compact(F.array(
        F.when(F.col("groups") == 0, F.lit("missing_question_group")).when(F.col("groups") > 1, F.lit("ambiguous_question_group")), F.when(F.col("mismatch"), F.lit("question_group_passage_mismatch")),
        F.when(F.col("passage_number").isNull(), F.lit("missing_passage_link")), F.when(wants, F.lit("missing_answer_options")),
    ))
    return rows.select("number", "document_id", "question_chunk_id", "kind", "labels", word_limit(F.coalesce(F.nullif("instructions", F.lit("")), "group_text")).alias("word_limit"), "passage_number", "evidence", warnings.alias("warnings")).withColumn("context_ready", F.size("warnings") == 0)


#: Issues in the order in which they are reported.
ISSUES = ["missing_exact_questions", "ambiguous_exact_questions", "missing_question_groups", "ambiguous_question_groups", "question_group_passage_mismatch", "missing_passage_links", "missing_passage_evidence", "missing_answer_options"]


def completeness(sources: DataFrame, message: str) -> DataFrame:
    """One row: requested, found, missing and ambiguous numbers, and the issues in fixed order."""
    spark = sources.sparkSession
    asked = spark.createDataFrame([(n,) for n in requested_numbers(message)], "number int")
    counts = exact_questions(sources, message).groupBy(F.col("range_start").alias("number")).agg(F.countDistinct("chunk_id").alias("n"))
    rows = asked.join(counts, "number", "left").join(solve_packets(sources, message).select("number", "warnings", "evidence"), "number", "left")
    has = lambda w: F.coalesce(F.bool_or(F.array_contains("warnings", w)), F.lit(False))
    some = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("number"))))
    out = rows.agg(
        some(F.lit(True)).alias("requested"), some(F.col("warnings").isNotNull()).alias("found"), some(F.col("n").isNull()).alias("missing"), some(F.col("n") > 1).alias("ambiguous"),
        has("missing_question_group").alias("a"), has("ambiguous_question_group").alias("b"), has("question_group_passage_mismatch").alias("c"), has("missing_passage_link").alias("d"),
        F.coalesce(F.bool_or(F.size("evidence") == 0), F.lit(False)).alias("e"), has("missing_answer_options").alias("f"),
    )
    tests = [F.size("missing") > 0, F.size("ambiguous") > 0, *(F.col(x) for x in "abcdef")]
    return out.select("requested", "found", "missing", "ambiguous", F.array_compact(F.array(*(F.when(t, F.lit(i)) for t, i in zip(tests, ISSUES, strict=True)))).alias("issues"))


def evidence_quota(questions: int, each: int = EVIDENCE_EACH, most: int = EVIDENCE_ALL) -> int:
    return min(each, max(1, most // max(1, questions)))


def select_evidence(scored: DataFrame, question: str, score: str, position: str, questions: int) -> DataFrame:
    """The best rows of each question within its quota, then of all within the cap."""
    best = Window.partitionBy(question).orderBy(F.desc(score), position)
    rows = scored.withColumn("__rn", F.row_number().over(best)).where(F.col("__rn") <= evidence_quota(questions))
    return rows.orderBy(question, "__rn").limit(EVIDENCE_ALL).drop("__rn")


def merge_evidence(contract: DataFrame, evidence: DataFrame) -> DataFrame:
    """Rows that are no passages, then the selected evidence, each chunk once."""
    both = contract.where("unit_type <> 'passage'").withColumn("__o", F.lit(0)).unionByName(evidence.withColumn("__o", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("__rn", F.row_number().over(Window.partitionBy("chunk_id").orderBy("__o", "position"))).where("__rn = 1").drop("__rn", "__o")


def inventory(tasks: DataFrame) -> DataFrame:
    """Writing tasks with whether an answer of the same document and parent exists; replies.writing_inventory orders them."""
    answers = tasks.where("unit_type = 'sample_answer'").select("document_id", "parent_id").distinct().withColumn("has_answer", F.lit(True))
    rows = tasks.where("unit_type = 'writing_task'").join(answers, ["document_id", "parent_id"], "left")
    return rows.withColumn("has_answer", F.coalesce("has_answer", F.lit(False)))


def trim_words(text: Column, most: int) -> Column:
    """Cut at the last word end that fits."""
    cut = F.regexp_replace(F.substring(text, 1, most), r"\s+\S*$", "")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("…")))


def context_block(label: Column, text: Column) -> Column:
    return F.concat(F.lit("["), label, F.lit("]\n"), text)


def event_json(kind: str, *fields: Column) -> Column:
    """One line of a stream of events."""
    return F.to_json(F.struct(F.lit(kind).alias("type"), *fields))


#: What is told of a retrieval's rows.
TOLD = {"chunk_id": "string", "document_id": "string", "source_file": "string", "retrieval_method": "string", "unit_type": "string", "passage_number": "int", "range_start": "int", "range_end": "int", "parent_id": "string", "pages": "array<int>"}


def compact(sources: DataFrame) -> DataFrame:
    """What is told of a retrieval's rows, in order; null for what they don't have."""
    return sources.select(*(F.col(c).cast(t).alias(c) if c in sources.columns else F.lit(None).cast(t).alias(c) for c, t in TOLD.items()))
