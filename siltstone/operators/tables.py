"""Analytics over small tables: a cell, a change, a comparison, rankings.

A table is long: table_id, row_idx, label, col_idx (from 1), column, value (text). Many tables are worked on at once;
nothing is gathered outside a table. Messages are parameters.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_terms, strip

YEAR = r"\b(\d{4})\b"


def _message_terms(message: str) -> list[str]:
    return sorted({w for w in re.findall(r"\w+", message.lower()) if len(w) > 1 or w.isdigit()})


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def numeric_value(value: Column) -> Column:
    """The first signed decimal number, a comma read as a point: "1,234" is 1.234."""
    return F.nullif(F.regexp_extract(F.regexp_replace(value, ",", "."), r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def format_number(x: Column) -> Column:
    """Whole numbers without a point, others with six significant digits at most."""
    digits = F.greatest(F.lit(0), F.lit(5) - F.floor(F.log10(F.greatest(F.abs(x), F.lit(1e-9)))).cast("int"))
    rounded = F.round(x * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(F.regexp_replace(rounded.cast("string"), r"\.0$", ""))


def format_signed(x: Column) -> Column:
    return F.concat(F.when(x >= 0, F.lit("+")).otherwise(F.lit("")), format_number(x))


def row_match_score(message: str, label: Column) -> Column:
    """10 if the label is in the message as whole words, else the number of terms they share."""
    label = strip(F.coalesce(label, F.lit("")))
    lowered = F.lower(label)
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), lowered, F.lit(r"\E(?![\p{L}\p{N}_])"))
    shared = F.size(F.array_intersect(plain_terms(label), _strings(_message_terms(message))))
    return F.when(label == "", 0.0).when(F.regexp_like(F.lit(message.lower()), quoted), 10.0).otherwise(shared.cast("double"))


def column_match_score(message: str, column: Column) -> Column:
    """The number of shared terms, and 4 for a shared year."""
    column = strip(F.coalesce(column, F.lit("")))
    shared = F.size(F.array_intersect(plain_terms(column), _strings(_message_terms(message)))).cast("double")
    years = _strings(sorted(set(re.findall(YEAR, message))))
    return F.when(column == "", 0.0).otherwise(shared + F.when(F.arrays_overlap(F.regexp_extract_all(column, F.lit(YEAR), 1), years), 4.0).otherwise(0.0))


def cell_value(table: DataFrame, message: str) -> DataFrame:
    """For each table the best column's value in the best row, with the sum of both scores; both must be over 0, and
    the first wins ties."""
    scored = table.withColumns({"column_score": column_match_score(message, F.col("column")), "row_score": row_match_score(message, F.col("label"))})
    columns = scored.groupBy("table_id").agg(F.max_by(F.struct("col_idx", "column_score"), F.struct("column_score", -F.col("col_idx"))).alias("best")).where("best.column_score > 0")
    cells = scored.where("row_score > 0").join(columns, "table_id").where("col_idx = best.col_idx")
    return cells.groupBy("table_id").agg(F.max_by(F.struct((F.col("row_score") + F.col("best.column_score")).alias("score"), "label", "column", "value"), F.struct("row_score", -F.col("row_idx"))).alias("x")).select("table_id", "x.*")


def cell_lookup_score(table: DataFrame, message: str) -> DataFrame:
    """For each table the best sum of a row's score and its best column's, both over 0: which table has the cell."""
    columns = table.groupBy("table_id").agg(F.max(column_match_score(message, F.col("column"))).alias("c"), F.max(row_match_score(message, F.col("label"))).alias("r"))
    return columns.where("c > 0 and r > 0").select("table_id", (F.col("c") + F.col("r")).alias("structured_score"))


def changes(table: DataFrame, message: str) -> DataFrame:
    """For each row with numbers in the two years that the message names, in that order: first, second, change, and
    whether it is its table's winner (the smallest change if a decrease is asked for)."""
    years = list(dict.fromkeys(re.findall(YEAR, message)))
    if len(years) != 2:
        raise ValueError("two different years are needed")
    scored = table.withColumn("score", column_match_score(message, F.col("column")))
    best = [F.max_by(F.when(F.contains("column", F.lit(y)), F.col("col_idx")), F.when(F.contains("column", F.lit(y)), F.struct("score", -F.col("col_idx")))).alias(f"c{i}") for i, y in enumerate(years)]
    chosen = scored.groupBy("table_id").agg(*best).where("c0 is not null and c1 is not null and c0 <> c1")
    rows = table.join(chosen, "table_id").where("col_idx = c0 or col_idx = c1").groupBy("table_id", "row_idx").agg(
        F.first("label").alias("label"),
        F.max(F.when(F.col("col_idx") == F.col("c0"), numeric_value(F.col("value")))).alias("first"),
        F.max(F.when(F.col("col_idx") == F.col("c1"), numeric_value(F.col("value")))).alias("second"),
    )
    rows = rows.where("first is not null and second is not null").withColumn("change", F.col("second") - F.col("first"))
    decrease = "giảm" in message.lower() or "decrease" in message.lower()
    order = F.col("change").asc() if decrease else F.col("change").desc()
    winner = F.row_number().over(Window.partitionBy("table_id").orderBy(order, "row_idx")) == 1
    return rows.withColumns({"winner": winner, "direction": F.lit("decrease" if decrease else "increase")})


def metric_key(column: Column) -> Column:
    """The column's words without its years."""
    return F.array_join(F.regexp_extract_all(F.regexp_replace(F.lower(column), YEAR, " "), F.lit(r"([\p{L}\p{N}]+)"), 1), " ")


def metric_label(column: Column) -> Column:
    cut = strip(F.regexp_replace(column, r"\s+\d{4}\b.*$", ""))
    return F.when(cut == "", column).otherwise(cut)


def _spans(table: DataFrame) -> DataFrame:
    """First and last year of each metric and row: table_id, metric, row_idx, label, years, labels, values."""
    years = table.withColumns({"year": F.nullif(F.regexp_extract("column", YEAR, 1), F.lit("")).cast("int"), "metric": metric_key(F.col("column"))}).where("year is not null and metric <> ''")
    place = F.struct("year", "col_idx")
    spans = years.groupBy("table_id", "metric").agg(F.min("col_idx").alias("at"), F.min(F.struct("year", "col_idx", "column")).alias("a"), F.max(F.struct("year", "col_idx", "column")).alias("z")).where("a.year <> z.year")
    cells = years.join(spans, ["table_id", "metric"]).where((place == F.struct("a.year", "a.col_idx")) | (place == F.struct("z.year", "z.col_idx")))
    rows = cells.groupBy("table_id", "metric", "row_idx").agg(
        F.first("label").alias("label"), F.first("at").alias("at"), F.first("a").alias("a"), F.first("z").alias("z"),
        F.max(F.when(F.col("col_idx") == F.col("a.col_idx"), numeric_value(F.col("value")))).alias("first"),
        F.max(F.when(F.col("col_idx") == F.col("z.col_idx"), numeric_value(F.col("value")))).alias("last"),
    )
    return rows.where("first is not null and last is not null")


def comparison_row(table: DataFrame, message: str) -> DataFrame:
    """The row of each table that the message names best."""
    rows = table.groupBy("table_id", "row_idx").agg(F.first("label").alias("label"), F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "value"))), lambda x: x["value"]).alias("cells"))
    return rows.withColumn("score", row_match_score(message, F.col("label"))).where("score > 0").groupBy("table_id").agg(F.max_by(F.struct("row_idx", "label", "cells"), F.struct("score", -F.col("row_idx"))).alias("x")).select("table_id", "x.*")


def comparison_facts(table: DataFrame, message: str) -> DataFrame:
    """For each metric of that row its first and last year's values, as one sentence."""
    rows = _spans(table).join(comparison_row(table, message).select("table_id", "row_idx"), ["table_id", "row_idx"])
    change = F.col("last") - F.col("first")
    said = F.concat(
        metric_label(F.col("a.column")), F.lit(": "), format_number(F.col("first")), F.lit(" ("), F.col("a.year").cast("string"), F.lit(") → "), format_number(F.col("last")), F.lit(" ("),
        F.col("z.year").cast("string"), F.lit("), "), F.when(change >= 0, F.lit("tăng")).otherwise(F.lit("giảm")), F.lit(" "), format_number(F.abs(change)), F.lit("."),
    )
    return rows.select("table_id", "at", said.alias("fact"))


def _listed(order: Column, text: Column, by: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("row_idx").alias("i"), text.alias("t")))), lambda x: x["t"]), by)


def summary_facts(table: DataFrame) -> DataFrame:
    """Two sentences for each metric with two years or more: all changes and the largest, both years' rankings."""
    change = F.col("last") - F.col("first")
    ranked = lambda x: F.concat("label", F.lit(" "), format_number(F.col(x)))
    facts = _spans(table).groupBy("table_id", "metric").agg(
        F.first("at").alias("at"), F.first("a").alias("a"), F.first("z").alias("z"),
        _listed(F.col("row_idx"), F.concat("label", F.lit(" "), format_number(F.col("first")), F.lit(" -> "), format_number(F.col("last")), F.lit(" ("), format_signed(change), F.lit(")")), "; ").alias("values"),
        F.max_by(F.concat("label", F.lit(" ("), format_signed(change), F.lit(")")), F.struct(change, -F.col("row_idx"))).alias("largest"),
        _listed(-F.col("first"), ranked("first"), " > ").alias("ranking_first"),
        _listed(-F.col("last"), ranked("last"), " > ").alias("ranking_last"),
        F.max_by(F.concat("label", F.lit(" ("), format_number(F.col("last")), F.lit(")")), F.struct("last", -F.col("row_idx"))).alias("highest"),
    )
    name, a, z = metric_label(F.col("a.column")), F.col("a.year").cast("string"), F.col("z.year").cast("string")
    return facts.select(
        "table_id", "at",
        F.concat(name, F.lit(", values from "), a, F.lit(" to "), z, F.lit(": "), F.col("values"), F.lit(". Largest increase: "), F.col("largest"), F.lit(".")).alias("changes"),
        F.concat(name, F.lit(" ranking in "), a, F.lit(": "), F.col("ranking_first"), F.lit(". Ranking in "), z, F.lit(": "), F.col("ranking_last"), F.lit(". Highest final value in "), F.col("z.column"), F.lit(": "), F.col("highest"), F.lit(".")).alias("rankings"),
    )


def markdown(table: DataFrame) -> DataFrame:
    """Header, rule and rows, pipes escaped, rows cut or filled to the header's width."""
    escape = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    head = table.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("col_idx", "column"))), lambda x: escape(x["column"])).alias("names"))
    rows = table.groupBy("table_id", "row_idx").agg(F.first("label").alias("label"), F.map_from_entries(F.collect_list(F.struct("col_idx", "value"))).alias("cells"))
    rows = rows.join(head, "table_id").withColumn("line", line(F.concat(F.array(escape(F.col("label"))), F.transform("names", lambda _, i: escape(F.try_element_at("cells", i + 1))))))
    rule = F.concat(F.lit("| --- | "), F.array_join(F.transform("names", lambda _: F.lit("---")), " | "), F.lit(" |"))
    return rows.groupBy("table_id").agg(F.first("names").alias("names"), F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "line"))), lambda x: x["line"]).alias("lines")).select(
        "table_id", F.array_join(F.concat(F.array(line(F.concat(F.array(F.lit("")), F.col("names"))), rule), F.col("lines")), "\n").alias("markdown")
    )

