"""Replies that need no generator: put together from sources, which are the few rows that a retrieval has kept.

sources: position, source_file, pages (array of int), unit_type, text and what an operator names. Every reply is a
DataFrame of one row and one column, `reply`; it is null where the sources don't give one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from . import tables

#: What replies say.
SOURCE, PAGE = "Nguồn: ", "trang "
QUESTIONS, TASKS = "Nội dung câu hỏi:", "Các đề và bài mẫu trong tài liệu:"
ANSWERED, UNANSWERED, UNTITLED = "có bài mẫu", "chưa thấy bài mẫu", "Writing task"
TABLE, FLOW, DIAGRAM = "Dưới đây là bảng mình trích xuất được từ tài liệu:", "Mình tìm thấy cấu trúc flowchart:", "Mình tìm thấy cấu trúc diagram:"
NO_TABLE = "Mình chưa có dữ liệu bảng đã được trích xuất theo cấu trúc cho phần này. Để tránh tự dựng sai hàng/cột hoặc ô trống, mình chưa hiển thị bảng."
NO_FLOW = "Mình chưa có dữ liệu flowchart đã được trích xuất theo node/edge cho phần này. Để tránh tự tưởng tượng cấu trúc, mình chưa mô tả flowchart."
NO_DIAGRAM = "Mình chưa có dữ liệu diagram đã được trích xuất theo cấu trúc cho phần này. Để tránh tự tưởng tượng nhãn hoặc quan hệ, mình chưa mô tả diagram."
LARGEST, RISE, FALL = " có mức ", "tăng", "giảm"
#: How a source's unit is called in a generator's context.
ROLES = {
    "question_group": "QUESTION INSTRUCTIONS", "question": "QUESTION", "passage": "PASSAGE EVIDENCE", "document_outline": "DOCUMENT OUTLINE", "writing_prompt": "WRITING PROMPT", "writing_task": "WRITING TASK",
    "sample_answer": "SAMPLE ANSWER", "writing_table": "STRUCTURED TABLE", "table": "STRUCTURED TABLE", "flowchart": "STRUCTURED FLOWCHART", "diagram": "STRUCTURED DIAGRAM",
}
OTHER_ROLE = "DOCUMENT CONTEXT"


def page_list(pages: Column) -> Column:
    return F.array_join(F.transform(pages, lambda p: p.cast("string")), ", ")


def source_label(file: Column, pages: Column) -> Column:
    """The file, with its pages if it has any."""
    return F.when(F.coalesce(F.size(pages), F.lit(0)) <= 0, file).otherwise(F.concat(file, F.lit(f", {PAGE}"), page_list(pages)))


def source_line() -> Column:
    return F.concat(F.lit(SOURCE), source_label(F.col("source_file"), F.col("pages")), F.lit("."))


def _in_order(of: Column, order: Column, by: str) -> Column:
    """An aggregate: texts of the rows in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), of.alias("t")))), lambda x: x["t"]), by)


def questions(sources: DataFrame) -> DataFrame:
    """Groups, each with its source; without any the questions by number, with the first one's source."""
    said = strip(F.col("text"))
    groups = sources.where("unit_type = 'question_group'").where(said != "")
    by_group = groups.agg(F.nullif(_in_order(F.concat(said, F.lit("\n\n"), source_line()), F.col("position"), "\n\n"), F.lit("")).alias("groups"))
    number = F.struct(F.coalesce(F.nullif("range_start", F.lit(0)), F.lit(999)), F.col("position"))
    own = sources.where("unit_type = 'question'").agg(
        _in_order(F.when(said != "", F.concat(F.lit("- "), said, F.lit("\n"))), number, "").alias("lines"), F.min_by(source_line(), number).alias("source")
    )
    single = F.concat(F.lit(QUESTIONS + "\n"), F.col("lines"), F.lit("\n"), F.col("source"))
    return by_group.join(own).select(F.coalesce("groups", F.when(F.col("source").isNotNull(), single)).alias("reply"))


def writing_prompt(sources: DataFrame) -> DataFrame:
    """The first prompt or task with a text."""
    said = strip(F.col("text"))
    rows = sources.where(F.col("unit_type").isin("writing_prompt", "writing_task")).where(said != "")
    return rows.agg(F.min_by(F.concat(said, F.lit("\n\n"), source_line()), "position").alias("reply"))


def writing_inventory(sources: DataFrame) -> DataFrame:
    """Tasks by page and index, each with whether an answer of its section is there; the source is the first task's."""
    key = lambda end: F.regexp_replace(F.coalesce("section_id", F.lit("")), f"-{end}$", "")
    answers = sources.where("unit_type = 'sample_answer'").select(key("answer").alias("key")).distinct().withColumn("answered", F.lit(True))
    tasks = sources.where("unit_type = 'writing_task'").withColumn("key", key("task")).join(answers, "key", "left")
    title = F.coalesce(F.get(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0)), F.lit(UNTITLED))
    line = F.concat(F.lit("- Trang "), page_list(F.col("pages")), F.lit(": "), title, F.when(F.col("answered"), f" ({ANSWERED})").otherwise(f" ({UNANSWERED})"))
    order = F.struct(F.coalesce(F.array_min("pages"), F.lit(999)), F.col("chunk_index"), F.col("position"))
    listed = tasks.agg(_in_order(line, order, "\n").alias("lines"), F.min_by(source_line(), "position").alias("source"))
    return listed.select(F.when(F.col("source").isNotNull(), F.concat(F.lit(TASKS + "\n"), F.col("lines"), F.lit("\n\n"), F.col("source"))).alias("reply"))


def _fullest(sources: DataFrame) -> DataFrame:
    """The source whose table has most rows, the first of equal ones: table_id, source line."""
    sizes = sources.groupBy("table_id").agg(F.countDistinct("row_idx").alias("n"), F.min("position").alias("p"), F.min_by(source_line(), "position").alias("line"))
    return sizes.orderBy(F.desc("n"), "p").limit(1).select("table_id", "line")


def table_cell(cells: DataFrame, message: str) -> DataFrame:
    """cells: the long form of the sources' tables (table_id, row_idx, label, col_idx, column, value) with position,
    source_file and pages. The value of the best cell of all tables."""
    best = tables.cell_value(cells, message).join(cells.groupBy("table_id").agg(F.min("position").alias("p"), F.min_by(source_line(), "position").alias("line")), "table_id")
    return best.agg(F.min_by(F.concat("value", F.lit("\n\n"), F.col("line")), F.struct(-F.col("score"), F.col("p"))).alias("reply"))


def table_calculation(cells: DataFrame, message: str) -> DataFrame:
    """The change of every row between the two years that the message names, and the largest one."""
    full = _fullest(cells)
    rows = tables.changes(cells.join(F.broadcast(full), "table_id", "left_semi"), message)
    n = tables.format_number
    line = F.concat(F.lit("- "), F.col("label"), F.lit(": "), n(F.col("second")), F.lit(" - "), n(F.col("first")), F.lit(" = "), n(F.col("change")))
    way = F.when(F.col("direction") == "decrease", FALL).otherwise(RISE)
    won = F.concat("label", F.lit(LARGEST), way, F.lit(" lớn nhất: "), n(F.col("change")), F.lit("."))
    said = rows.groupBy("table_id").agg(_in_order(line, F.col("row_idx"), "\n").alias("lines"), F.max_by(won, "winner").alias("won")).join(full, "table_id")
    return said.agg(F.max(F.concat("lines", F.lit("\n\n"), F.col("won"), F.lit("\n\n"), F.col("line"))).alias("reply"))


def table_comparison(cells: DataFrame, message: str) -> DataFrame:
    """The row that the message names, as a table, and what its metrics did."""
    full = _fullest(cells)
    own = cells.join(F.broadcast(full), "table_id", "left_semi")
    row = tables.comparison_row(own, message).select("table_id", "row_idx")
    shown = tables.markdown(own.join(row, ["table_id", "row_idx"], "left_semi"))
    facts = tables.comparison_facts(own, message).groupBy("table_id").agg(_in_order(F.concat(F.lit("- "), F.col("fact")), F.col("at"), "\n").alias("facts"))
    said = shown.join(facts, "table_id", "left").join(full, "table_id")
    return said.agg(F.max(F.concat_ws("\n\n", "markdown", "facts", "line")).alias("reply"))


def table_shown(cells: DataFrame) -> DataFrame:
    """The first source's table; a set sentence if there is none."""
    first = cells.groupBy("table_id").agg(F.min("position").alias("p"), F.min_by(source_line(), "position").alias("line")).orderBy("p").limit(1)
    shown = tables.markdown(cells.join(F.broadcast(first), "table_id", "left_semi")).join(first, "table_id")
    return shown.agg(F.coalesce(F.max(F.concat(F.lit(TABLE + "\n\n"), F.col("markdown"), F.lit("\n\n"), F.col("line"))), F.lit(NO_TABLE)).alias("reply"))


def flow_shown(sources: DataFrame, diagram: bool = False) -> DataFrame:
    """sources: nodes (array of id, text, question_number) and edges (array of from, to) of the first one's flow."""
    label = lambda n: F.when(F.coalesce(n["question_number"], F.lit(0)) != 0, F.concat(F.lit("Question "), n["question_number"].cast("string"), F.lit(" blank"))).otherwise(n["text"])
    nodes = F.transform("nodes", lambda n: F.concat(F.lit("- "), n["id"], F.lit(": "), label(n)))
    edges = F.transform("edges", lambda e: F.concat(F.lit("- edge: "), e["from"], F.lit(" -> "), e["to"]))
    said = F.array_join(F.concat(F.array(F.lit(DIAGRAM if diagram else FLOW)), nodes, edges, F.array(F.concat(F.lit("\n"), source_line()))), "\n")
    rows = sources.where("size(nodes) > 0 and size(edges) > 0")
    return rows.agg(F.coalesce(F.min_by(said, "position"), F.lit(NO_DIAGRAM if diagram else NO_FLOW)).alias("reply"))


def context(sources: DataFrame, most: int | None = None) -> DataFrame:
    """The sources as a generator reads them, in order: role, number, file, pages, text; long texts cut at a blank."""
    n = F.row_number().over(_by_position())
    text = F.col("text")
    if most:
        cut = F.substring(text, 1, most)
        text = F.when(F.length(text) > most, F.concat(F.regexp_replace(cut, r"(?s) [^ ]*$", ""), F.lit(" ..."))).otherwise(text)
    role = F.lit(OTHER_ROLE)
    for unit, name in ROLES.items():
        role = F.when(F.col("unit_type") == unit, name).otherwise(role)
    pages = F.when(F.coalesce(F.size("pages"), F.lit(0)) <= 0, "unknown").otherwise(page_list(F.col("pages")))
    block = F.concat(F.lit("--- "), role, F.lit(" "), F.col("__n").cast("string"), F.lit(" ---\nFile: "), F.col("source_file"), F.lit("\nPages: "), pages, F.lit("\n"), text)
    return sources.withColumn("__n", n).agg(_in_order(block, F.col("__n"), "\n\n").alias("context"))


def _by_position():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy("position")  # of the few rows of a context
