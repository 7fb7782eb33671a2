"""Queries over chunking, structure, validation and dispatch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, dispatch, structure, validate
from ..operators.search import keyword_scores
from ..streaming.limits import response_chunks as chunks_of
from .common import Registry, chunks, quoted, sql_terms, table

REGISTRY = Registry()
add = REGISTRY.add


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as elements; the first of each ten is a heading, a page has eight."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"),
        F.transform(lines, lambda x, i: F.struct(F.concat(F.lit("e"), i.cast("string")).alias("element_id"), (F.floor(i / 8) + 1).cast("int").alias("page"), F.when(i % 10 == 0, "heading").otherwise("paragraph").alias("kind"), x.alias("text"), F.lit("native").alias("source"), (1.0 - i % 3 / 10.0).cast("double").alias("confidence"))).alias("elements"),
    )


@add(None)
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.semantic_chunks(_elements(spark, sf_dir))


@add(None)
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sentence_split(table(spark, sf_dir, "documents"), "doc_id")


@add("""SELECT l_orderkey AS table_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus) - 1 AS INTEGER) AS row_idx, 'flag: ' || l_returnflag || '; status: ' || l_linestatus AS text FROM lineitem""")
def table_row_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("table_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus"))), lambda x: F.array(x["l_returnflag"], x["l_linestatus"])).alias("rows"))
    return chunking.row_chunks(lines.withColumn("columns", F.array(F.lit("flag"), F.lit("status"))))


@add("SELECT l_orderkey AS unit_id, CAST(min(l_discount) AS DOUBLE) AS min_confidence FROM lineitem GROUP BY l_orderkey")
def min_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    references = lines.select(F.col("l_orderkey").alias("unit_id"), F.lit("d").alias("document_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("element_id")).distinct()
    elements = lines.select(F.lit("d").alias("document_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("element_id"), F.col("l_discount").alias("confidence"))
    return chunking.min_confidence(references, elements)


@add("""SELECT conv_id, turn, CAST(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 2 AS BIGINT) AS "end", CAST(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 2 - length(text) AS BIGINT) AS start FROM conversations""")
def linearize_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.spans(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "start", "end")


_GROUPS = "SELECT o_custkey AS k, o_orderkey AS o, o_orderkey % 40 + 1 AS s, o_orderkey % 40 + 1 + o_orderkey % 5 AS e FROM orders"


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("o_orderkey") % 40 + 1
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"), start.alias("s"), (start + F.col("o_orderkey") % 5).alias("e"))


@add(f"""WITH g AS ({_GROUPS}), n AS (SELECT DISTINCT k, unnest(generate_series(s, e)) AS n FROM g), r AS (SELECT k, list(n) AS c, min(n) AS a, max(n) AS b, count(*) AS covered FROM n GROUP BY k)
    SELECT k, CAST(len(list_filter(generate_series(a, b), lambda x: NOT list_contains(c, x))) AS INTEGER) AS n_missing, CAST(covered AS INTEGER) AS covered FROM r""")
def structure_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.missing_numbers(_groups(spark, sf_dir), "k", "s", "e").select("k", F.size("missing").alias("n_missing"), "covered")


@add(f"WITH g AS ({_GROUPS}) SELECT a.k, a.o, b.o AS other_order FROM g a JOIN g b ON a.k = b.k AND a.o < b.o AND greatest(a.s, b.s) <= least(a.e, b.e)")
def structure_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.overlapping_groups(_groups(spark, sf_dir), "k", "s", "e", "o").select("k", "o", "other_order")


@add(f"WITH g AS ({_GROUPS}) SELECT k, s FROM g GROUP BY k, s HAVING count(*) > 1")
def structure_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.duplicate_numbers(_groups(spark, sf_dir), "k", "s")


@add("""SELECT conv_id, turn, CAST(1 + sum(CASE WHEN role = 'user' AND rn > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS INTEGER) AS section FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)""")
def passage_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.assign_sections(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", "section")


_TAGLESS = r"regexp_replace(coalesce(text, ''), '\[Source\s+[0-9]+\s*:[^\]]+\]', ' ', 'gi')"
_FREE = rf"regexp_replace({_TAGLESS}, '\bNO\s+MORE\s+THAN\s+[A-Z-]+(\s+[A-Z-]+){{{{0,3}}}}\b|\b(TRUE|FALSE|NOT\s+GIVEN)\b|\bQuestions?\s+[0-9]{{{{1,3}}}}(\s*(-|–|—|to)\s*[0-9]{{{{1,3}}}})?\b|\b[^\s]+\.(pdf|png|jpe?g|docx?)\b', ' ', 'gi')".replace("{{", "{").replace("}}", "}")


@add(rf"""WITH t AS (SELECT doc_id, {_FREE} AS t FROM documents), w AS (SELECT doc_id, t, list_transform(regexp_extract_all(t, '\p{{L}}+'), lambda x: lower(x)) AS w FROM t),
    vi AS (SELECT string_split('ai ban bạn bằng cau câu cho co có cua của dich dịch duoc được gi gì hay hãy khong không la là minh mình mot một nao nào nhung những sao theo thong thông tin toi tôi trong tu từ va và voi với xin để', ' ') AS vi),
    en AS (SELECT string_split('and answer are can choose did do does for from how in is of should the to was were what when where which who why with words', ' ') AS en)
    SELECT doc_id, CAST(2 * len(list_filter(w, lambda x: list_contains(vi, x))) + least(length(regexp_replace(lower(t), '[^ăâđêôơưáàảãạấầẩẫậắằẳẵặéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ]', '', 'g')), 10) AS INTEGER) AS vietnamese,
        CAST(2 * len(list_filter(w, lambda x: list_contains(en, x))) AS INTEGER) AS english, CAST(len(w) AS INTEGER) AS tokens FROM w, vi, en""")
def language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", validate.language_evidence(F.col("text")).alias("e")).select("doc_id", "e.vietnamese", "e.english", "e.tokens")


_COUNT = r"CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_][\p{L}\p{N}_''-]*')) AS INTEGER)"


@add(rf"""SELECT conv_id, turn, {_COUNT} AS words, CAST(len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\n\s*\n')) AS INTEGER) AS paragraphs, CAST(CASE WHEN {_COUNT} < 40 THEN 1 ELSE 0 END + CASE WHEN {_COUNT} > 80 THEN 1 ELSE 0 END AS INTEGER) AS issues FROM conversations""")
def writing_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", validate.word_count(text).alias("words"), validate.paragraph_count(text).alias("paragraphs"), F.size(validate.writing_issues(text, 40, 80, True)).alias("issues"))


@add(f"""WITH p AS (SELECT conv_id, turn, greatest(0, 40 - {_COUNT}, {_COUNT} - 80) AS d FROM conversations WHERE role = 'assistant') SELECT conv_id, arg_min(turn, (d, turn)) AS turn FROM p GROUP BY conv_id""")
def select_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")
    return validate.select_best(rows, "conv_id", validate.writing_penalty(F.col("text"), 40, 80, False), "turn").select("conv_id", "turn")


@add("SELECT event_id, CAST(json_extract_string(props, '$.' || json_keys(props)[1]) AS VARCHAR) AS first_value, len(json_keys(props)) AS n FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = validate.json_object(F.concat(F.lit("noise "), F.col("props"), F.lit(" end")), "map<string,string>")
    keys = F.json_object_keys("props")
    return table(spark, sf_dir, "events").select("event_id", F.element_at(parsed, F.get(keys, F.lit(0))).alias("first_value"), F.size(keys).cast("long").alias("n"))


_NORM = r"array_to_string(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+'), ' ')"


@add(f"""WITH b AS (SELECT item_id, {_NORM.format('text')} AS p FROM benchmark), d AS (SELECT doc_id, {_NORM.format('text')} AS s FROM documents) SELECT item_id, doc_id FROM b JOIN d ON len(string_split(p, ' ')) >= 3 AND contains(s, p)""")
def evidence_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of the benchmark, looked for in every document."""
    return validate.evidence_in(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


@add(f"""WITH q AS (SELECT item_id, {sql_terms('text')} AS qt, lower(text) AS ph FROM benchmark), d AS (SELECT doc_id, lower(text) AS low, {sql_terms('text')} AS dt FROM documents),
    s AS (SELECT item_id, doc_id, CAST(len(list_filter(qt, lambda t: list_contains(dt, t))) + CASE WHEN contains(low, ph) THEN 2 ELSE 0 END AS DOUBLE) AS score FROM q, d),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rn FROM s WHERE score > 0) SELECT item_id, doc_id, score FROM r WHERE rn <= 1 ORDER BY item_id, rn LIMIT 12""")
def evidence_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    scores = keyword_scores(chunks(spark, sf_dir), asked)
    return dispatch.select_evidence(scores, "query_id", "score", "position", asked.count()).select(F.col("query_id").alias("item_id"), F.col("position").alias("doc_id"), "score")


@add("SELECT doc_id FROM documents WHERE doc_id % 4 = 2 AND lang IN ('de', 'fr')")
def intent_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).select("chunk_id", (F.col("chunk_id") % 4).alias("passage_number"), F.when(F.col("unit_type").isin("de", "fr"), "table").otherwise("passage").alias("unit_type"), F.lit(None).cast("string").alias("question_type"), F.lit(1).alias("range_start"), F.lit(2).alias("range_end"))
    return dispatch.filter_for_intent(rows, "show the table of passage two", "show_table").select(F.col("chunk_id").alias("doc_id"))


@add("""SELECT l_orderkey, l_linenumber, EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag = 'R') AS has_answer FROM lineitem a WHERE l_returnflag <> 'R'""")
def writing_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit("d").alias("document_id"), F.col("l_orderkey").alias("parent_id"), F.when(F.col("l_returnflag") == "R", "sample_answer").otherwise("writing_task").alias("unit_type"))
    return dispatch.inventory(rows).select("l_orderkey", "l_linenumber", "has_answer")


@add(None)
def response_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.udf(chunks_of, "array<string>", useArrow=True)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(split("text")).alias("n", "chunk"))

