"""Queries over requests: routing, retrieval arms, replies and contexts, catalogs as text, models brought by a caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog, dispatch, models, quality, replies, strategy
from ..sources import files
from ..streaming import limits
from .analytics import _FIELD, _MARKET, _field_scores, _market, _message, _titles
from .common import Registry, quoted, table
from .generated import NL, K, made, made_long, pick, pick_text

REGISTRY = Registry()
add = REGISTRY.add

# routing

_ALL = quoted(["document_overview", "show_questions", "translate_questions", "translate_content", "explain_questions", "solve_questions", "semantic_qa", "show_table", "extract_table", "table_cell", "table_calculation", "table_comparison", "show_flowchart", "show_diagram", "show_writing_prompt", "writing_generation"])


@add(f"""SELECT k, array_to_string(list_filter({_ALL}, lambda x: (k % 2 = 0 OR k % 5 = 0 OR x NOT IN ('show_questions', 'translate_questions', 'explain_questions', 'solve_questions')) AND (k % 3 = 1 OR x NOT IN ('table_cell', 'table_calculation', 'table_comparison'))), ',') AS intents FROM {K}""")
def allowed_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, has_range="k % 2 = 0", has_affinity="k % 5 = 0")
    units = made(spark, sf_dir, unit_types=pick("k", "array('passage')", "array('question', 'table_row')", "cast(array() as array<string>)")).where("k % 3 < 2")
    return dispatch.allowed_by_document(rows, units, "k").select("k", F.array_join("intents", ",").alias("intents"))


_FORBIDS = ("Xin đừng ngại, hãy giải", "Không tự giải", "chưa  giải thích", "chưa điền ra đáp án", "không chọn giúp tôi đáp án", "Giữ nguyên ô trống nhé", "không viết bài", "chưa viết.", "chỉ nêu phần yêu cầu", "không viết ra", "please do not solve")


@add(f"""SELECT k, CASE WHEN k % 11 IN (1, 3, 4, 5) THEN 'show_questions' ELSE 'solve_questions' END AS solving, CASE WHEN k % 11 IN (6, 7, 8) THEN 'show_writing_prompt' ELSE 'writing_generation' END AS writing FROM {K}""")
def intent_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, message=f"k || ': ' || {pick_text('k', *_FORBIDS)}")
    m = F.col("message")
    return rows.select("k", dispatch.constrain(m, F.lit("solve_questions")).alias("solving"), dispatch.constrain(m, F.lit("writing_generation")).alias("writing"))


@add(f"""SELECT k, array_to_string(list_filter([CASE WHEN k % 4 IN (1, 2) THEN 'layout_question' END, CASE WHEN k % 4 IN (2, 3) THEN 'missing_question_numbers_' || (k % 20 + 1) || '_' || (k % 20 + 6) END], lambda x: x IS NOT NULL), ',') AS reasons FROM {K}""")
def merge_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = "(k % 20 + 1)"
    rows = made(spark, sf_dir, text=pick("k", f"'Questions ' || {n} || '-' || ({n} + 5) || ' ' || {n} || '. a (' || ({n} + 1) || ') b ' || ({n} + 5) || ') c'", f"'Complete the table below. Question ' || {n}", f"'Flow chart of questions ' || ({n} + 5) || ' to ' || {n} || ', ' || {n} || '. and ' || ({n} + 1) || ') only'", f"'Questions ' || {n} || ' – ' || ({n} + 5) || ' but none ' || {n} || ' is here'"))
    return rows.select("k", F.array_join(quality.merge_reasons(F.col("text")), ",").alias("reasons"))


_PATHS = ("/in/a' || k || '.TXT", "/in/b' || k || '.md", "/in/c.d/' || k || '.pdf", "/in/d' || k || '.docx", "/in/e' || k || '.JPeG", "/in/f' || k || '.exe", "/in/g' || k || '", "/in/h.x/' || k || '")


@add(f"SELECT k, CASE WHEN k % 9 = 8 THEN 'too_large' ELSE {pick_text('k', 'text', 'text', 'pdf', 'docx', 'image', 'unsupported', 'pdf', 'unsupported')} END AS route FROM {K}")
def file_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, path=pick("k", *(f"'{p}'" for p in _PATHS)), length="CASE WHEN k % 9 = 8 THEN 26214401 ELSE k END", mime=pick("k", *["'image/png'"] * 6, "'application/pdf'", "'video/mp4'"))
    return rows.select("k", files.route(F.col("path"), F.col("length"), F.col("mime")).alias("route"))


@add("SELECT doc_id, sha256(text) AS document_id FROM documents")
def document_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return rows.select("doc_id", files.document_id(F.col("content")).alias("document_id"))


@add(f"SELECT k, 'p1-e1' AS element_id, 'First ' || k AS text, 1.0::DOUBLE AS confidence FROM {K} UNION ALL SELECT k, 'p1-e2', 'Sec ond' || chr(10) || 'line', 1.0 FROM {K} UNION ALL SELECT k, 'p1-e3', 'last', 1.0 FROM {K} WHERE k % 2 = 0")
def text_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = f"'{chr(0xfeff)}' || '  First ' || k || {NL} || '  ' || {NL} || {NL} || {NL} || 'Sec{chr(0x200b)}  ond' || chr(13) || {NL} || ' line' || CASE WHEN k % 2 = 0 THEN {NL} || {NL} || 'last ' ELSE '' END"
    rows = made(spark, sf_dir, content=f"encode({said}, 'UTF-8')", route="'text'", source_file="'a.txt'", document_id="'' || k")
    return files.text_documents(rows).select(F.col("document_id").cast("long").alias("k"), F.explode("elements").alias("e")).select("k", "e.element_id", "e.text", "e.confidence")


@add(f"SELECT k, array_to_string(regexp_extract_all({pick_text('k', 'cafe ao', 'x2', '', 'a i h c')}, '[a-z0-9 ]+'), '') AS reference FROM {K}")
def reference_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, text=pick_text("k", "  Café -- ÃO! ", "X²", "ß", "à.i/đhđc")).select("k", T.normalize_reference(F.col("text")).alias("reference")).withColumn("reference", F.when(F.col("k") % 4 == 2, "").otherwise(F.col("reference")))


@add(rf"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(text, '([\p{{L}}\p{{N}}_])-[ \t]*\n[ \t]*([\p{{L}}\p{{N}}_])', '\1-\2', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g'))) AS inline_sha256 FROM documents WHERE NOT regexp_matches(text, '-[ \t]*\n') AND text = nfc_normalize(text) AND NOT regexp_matches(text, '[\x{{200B}}-\x{{200D}}\x{{FEFF}}]')""")
def normalize_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of texts that need no composition and have no broken words; normalize_text has the others."""
    docs = table(spark, sf_dir, "documents").where(~F.col("text").rlike(r"-[ \t]*\n") & ~F.col("text").rlike("[​-‍﻿]"))
    return docs.select("doc_id", F.sha2(T.normalize_inline(F.col("text")), 256).alias("inline_sha256"))


# retrieval arms


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as questions and groups of five, each tenth a passage."""
    return made(
        spark, sf_dir, chunk_id="'c' || k", position="k", chunk_index="k", document_id="'d' || (k % 3)", source_file="'f' || (k % 3) || '.pdf'", unit_type="case when k % 10 = 0 then 'passage' when k % 5 = 1 then 'question_group' else 'question' end",
        passage_number="cast(k % 4 + 1 as int)", question_type="cast(null as string)", range_start="cast(k % 40 + 1 as int)", range_end="cast(k % 40 + 1 + if(k % 5 = 1, 4, 0) as int)", text="'about wine ' || k", pages="array(cast(k % 9 + 1 as int))", token_count="100",
        embedding="cast(array(1.0, 0.0) as array<float>)",
    ).drop("k")


def _arm(name: str, rows: DataFrame, method: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.min(F.substring("chunk_id", 2, 20).cast("long")), F.lit(-1)).alias("least")).select(F.lit(name).alias("request"), F.lit(method).alias("method"), "n", "least")


_ARMS = (
    ("range", strategy.Request("show questions 4-6", "show_questions")), ("none", strategy.Request("solve question 77", "solve_questions")), ("overview", strategy.Request("overview of it", "document_overview")),
    ("explicit", strategy.Request("what is said", "semantic_qa", ["d1"], ("d1", "d2"), True)), ("probe", strategy.Request("about wine", "semantic_qa", ["d2"])), ("nothing", strategy.Request("zzz qqq", "semantic_qa", ["d2"])), ("passage", strategy.Request("passage two about wine", "semantic_qa", ["d1"])),
)


@add(f"""WITH c AS (SELECT k, k % 3 AS d, k % 10 = 0 AS passage, k % 10 <> 0 AND k % 5 = 1 AS grp, k % 40 + 1 AS a, k % 40 + 1 + CASE WHEN k % 5 = 1 THEN 4 ELSE 0 END AS b FROM {K}),
    met AS (SELECT k, greatest(a, 4) AS lo, least(b, 6) AS hi, a, b, grp FROM c WHERE NOT passage AND greatest(a, 4) <= least(b, 6)),
    sc AS (SELECT k, hi - lo + 1 + CASE WHEN a = 4 AND b = 6 THEN 100 WHEN a <= 4 AND 6 <= b THEN 70 ELSE 30 END + CASE WHEN grp THEN 15 ELSE 8 END AS s FROM met ORDER BY s DESC, k LIMIT 5)
    SELECT 'range' AS request, 'structured' AS method, count(*) AS n, coalesce(min(k), -1) AS least FROM sc
    UNION ALL SELECT 'none', 'structured_question_no_match', 0, -1
    UNION ALL SELECT 'overview', 'structured', count(*), min(k) FROM (SELECT k FROM c ORDER BY k % 9, k LIMIT 50)
    UNION ALL SELECT 'explicit', 'explicit_scope', count(*), min(k) FROM (SELECT k FROM c WHERE d = 1 ORDER BY k LIMIT 5)
    UNION ALL SELECT 'probe', 'probe', count(*), min(k) FROM (SELECT k FROM c WHERE d = 2 ORDER BY k LIMIT 5)
    UNION ALL SELECT 'nothing', 'no_strong_document_match', 0, -1
    UNION ALL SELECT 'passage', 'probe', count(*), coalesce(min(k), -1) FROM (SELECT k FROM c WHERE d = 1 ORDER BY k LIMIT 5) WHERE k % 4 + 1 = 2""")
def retrieval_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, out = _chunks(spark, sf_dir), None
    for name, request in _ARMS:
        one = _arm(name, *strategy.retrieve(chunks, request))
        out = one if out is None else out.unionByName(one)
    return out


# replies


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sources of the ladder's kind: the twelve first chunks."""
    return _chunks(spark, sf_dir).orderBy("position").limit(12)


_FIRST = f"(SELECT k FROM {K} ORDER BY k LIMIT 12)"
_SRC = "'Nguồn: f' || (k % 3) || '.pdf, trang ' || (k % 9 + 1) || '.'"


@add(f"""SELECT 'groups' AS kind, string_agg('about wine ' || k || chr(10) || chr(10) || {_SRC}, chr(10) || chr(10) ORDER BY k) AS reply FROM {_FIRST} WHERE k % 10 <> 0 AND k % 5 = 1
    UNION ALL SELECT 'questions', 'Nội dung câu hỏi:' || chr(10) || string_agg('- about wine ' || k || chr(10), '' ORDER BY k % 40 + 1, k) || chr(10) || arg_min({_SRC}, (k % 40 + 1, k)) FROM {_FIRST} WHERE k % 10 <> 0 AND k % 5 <> 1
    UNION ALL SELECT 'none', NULL""")
def reply_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _asked(spark, sf_dir)
    kinds = {"groups": rows, "questions": rows.where("unit_type <> 'question_group'"), "none": rows.where("unit_type = 'passage'")}
    out = None
    for name, some in kinds.items():
        one = replies.questions(some).select(F.lit(name).alias("kind"), "reply")
        out = one if out is None else out.unionByName(one)
    return out


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, position="k", chunk_index="k", source_file="'w.pdf'", pages="array(cast(k % 7 + 1 as int))", unit_type=pick_text("k", "writing_task", "sample_answer", "writing_task", "passage"), section_id=pick("k", "'s' || (k div 4) || '-task'", "'s' || (k div 4) || '-answer'", "'t' || k || '-task'", "null"), text=f"{NL} || ' Task ' || k || {NL} || 'more'")


@add(f"""WITH t AS (SELECT k, k % 7 + 1 AS page, k % 4 = 0 AND k + 1 IN (SELECT k FROM {K}) AS answered FROM {K} WHERE k % 4 IN (0, 2))
    SELECT 'Các đề và bài mẫu trong tài liệu:' || chr(10) || string_agg('- Trang ' || page || ': Task ' || k || CASE WHEN answered THEN ' (có bài mẫu)' ELSE ' (chưa thấy bài mẫu)' END, chr(10) ORDER BY page, k) || chr(10) || chr(10) || 'Nguồn: w.pdf, trang ' || arg_min(page, k) || '.' AS reply FROM t""")
def reply_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies.writing_inventory(_tasks(spark, sf_dir))


@add(f"SELECT 'Task ' || k || chr(10) || 'more' || chr(10) || chr(10) || 'Nguồn: w.pdf, trang ' || (k % 7 + 1) || '.' AS reply FROM {K} WHERE k % 4 IN (0, 2) ORDER BY k LIMIT 1")
def reply_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies.writing_prompt(_tasks(spark, sf_dir))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market tables, by name, as sources."""
    return _market(spark, sf_dir).withColumns({"position": F.length("table_id") * 100 + F.ascii("table_id"), "source_file": F.concat("table_id", F.lit(".pdf")), "pages": F.array(F.lit(1), F.lit(2))})


_FULL = f"""WITH {_MARKET}, full_table AS (SELECT table_id FROM c GROUP BY table_id ORDER BY count(DISTINCT row_idx) DESC, length(table_id) * 100 + ascii(table_id) LIMIT 1), own AS (SELECT c.* FROM c JOIN full_table USING (table_id))"""


@add(f"""{_FULL}, pp AS (SELECT row_idx, any_value(label) AS label, max(v) FILTER (col = 'Order Count 1996') AS a, max(v) FILTER (col = 'Order Count 1998') AS z FROM own GROUP BY row_idx), chg AS (SELECT *, z - a AS ch FROM pp WHERE a IS NOT NULL AND z IS NOT NULL)
    SELECT string_agg('- ' || label || ': ' || z || ' - ' || a || ' = ' || ch, chr(10) ORDER BY row_idx) || chr(10) || chr(10) || arg_max(label || ' có mức tăng lớn nhất: ' || ch || '.', (ch, -row_idx)) || chr(10) || chr(10) || 'Nguồn: ' || (SELECT table_id FROM full_table) || '.pdf, trang 1, 2.' AS reply FROM chg""")
def reply_calculation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies.table_calculation(_cells(spark, sf_dir), "How did the order count change from 1996 to 1998?")


@add(f"""WITH {_MARKET}, r AS (SELECT table_id, length(table_id) * 100 + ascii(table_id) AS p, v FROM c WHERE label = 'FRANCE' AND col = 'Order Count 1997') SELECT arg_min(v || chr(10) || chr(10) || 'Nguồn: ' || table_id || '.pdf, trang 1, 2.', p) AS reply FROM r""")
def reply_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies.table_cell(_cells(spark, sf_dir), "What is the order count 1997 of France?")


@add(f"SELECT 'Mình tìm thấy cấu trúc flowchart:' || chr(10) || '- n1: start ' || k || chr(10) || '- n2: Question 7 blank' || chr(10) || '- edge: n1 -> n2' || chr(10) || chr(10) || 'Nguồn: f.pdf.' AS reply FROM {K} WHERE k % 3 = 2 ORDER BY k LIMIT 1")
def reply_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = "cast(array() as array<struct<id:string,text:string,question_number:int>>)"
    nodes = f"case when k % 3 = 0 then {none} else array(named_struct('id', 'n1', 'text', 'start ' || k, 'question_number', cast(null as int)), named_struct('id', 'n2', 'text', '', 'question_number', 7)) end"
    edges = "case when k % 3 = 2 then array(named_struct('from', 'n1', 'to', 'n2')) else cast(array() as array<struct<from:string,to:string>>) end"
    return replies.flow_shown(made(spark, sf_dir, position="k", source_file="'f.pdf'", pages="cast(array() as array<int>)", nodes=nodes, edges=edges))


@add(f"""WITH n AS (SELECT k, row_number() OVER (ORDER BY k) AS n FROM {_FIRST}) SELECT string_agg('--- ' || CASE WHEN k % 10 = 0 THEN 'PASSAGE EVIDENCE' WHEN k % 5 = 1 THEN 'QUESTION INSTRUCTIONS' ELSE 'QUESTION' END || ' ' || n || ' ---' || chr(10) || 'File: f' || (k % 3) || '.pdf' || chr(10) || 'Pages: ' || (k % 9 + 1) || chr(10)
    || CASE WHEN length('about wine ' || k) > 11 THEN 'about wine ...' ELSE 'about wine ' || k END, chr(10) || chr(10) ORDER BY n) AS context FROM n""")
def reply_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies.context(_asked(spark, sf_dir), 11)


# catalogs


@add(f"""WITH e AS (SELECT k, row_number() OVER (ORDER BY k) AS n FROM (SELECT k FROM {K} ORDER BY k LIMIT 60)), l AS (SELECT k, n, '- D' || n || ': f' || k || '.pdf | document_types=type' || (k % 3) || CASE WHEN k % 2 = 0 THEN ' | section_titles=The Story of Wine ' || k || '; Rivers' ELSE '' END AS line FROM e),
    s AS (SELECT *, sum(length(line) + 1) OVER (ORDER BY n) + length('Most relevant uploaded document candidates:') AS total FROM l)
    SELECT 'D' || n AS reference, k AS document_id, line FROM s WHERE total <= 3000""")
def catalog_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = made(spark, sf_dir, source_file="'f' || k || '.pdf'", document_types="array('type' || (k % 3))", section_titles="case when k % 2 = 0 then array('Rivers', 'The Story of Wine ' || k) else cast(array() as array<string>) end").orderBy("k").limit(60).withColumn("rank", F.row_number().over(_by_key()))
    shown = catalog.rendered(entries, "tell me the story of wine", "k", "rank", {"document_types": "document_types", "section_titles": "section_titles"})
    return shown.select("reference", F.col("k").alias("document_id"), "line")


def _by_key():
    from pyspark.sql import Window

    return Window.orderBy("k")


@add(f"""WITH r AS (SELECT unnest(['D2', 'D9', 'D2', 'D3', 'X']) AS ref), e AS (SELECT 'D' || row_number() OVER (ORDER BY k) AS ref, k FROM (SELECT k FROM {K} ORDER BY k LIMIT 5)) SELECT DISTINCT r.ref AS reference, e.k AS document_id, e.k IS NOT NULL AND e.k % 2 = 0 AS allowed FROM r LEFT JOIN e USING (ref)""")
def resolve_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = made(spark, sf_dir).orderBy("k").limit(5).withColumn("reference", F.concat(F.lit("D"), F.row_number().over(_by_key()).cast("string")))
    return catalog.resolve_references(["D2", "D9", "D2", "D3", "X"], entries, "k", entries.where("k % 2 = 0").select("k")).withColumnRenamed("k", "document_id")


@add(f"""WITH v AS (SELECT p_partkey, array_to_string(regexp_extract_all(lower(p_name), '[a-z0-9]+'), ' ') AS t FROM part), tok AS (SELECT DISTINCT p_partkey, unnest(string_split(t, ' ')) AS token FROM v), w AS (SELECT token, 1.0::DOUBLE + ln(((SELECT count(*) FROM v WHERE t <> '') + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) AS weight FROM tok WHERE token <> '' GROUP BY token),
    m AS (SELECT string_split('please find ' || t, ' ') AS b, 'please find ' || t AS q FROM v WHERE p_partkey = 7), x AS (SELECT p_partkey, t, string_split(t, ' ') AS a, b, q FROM v, m WHERE t <> ''),
    runs AS (SELECT p_partkey, max(CASE WHEN contains(' ' || t || ' ', ' ' || array_to_string(b[i:j], ' ') || ' ') THEN j - i + 1 ELSE 0 END) AS run FROM (SELECT *, unnest(generate_series(1, len(b))) AS i FROM x), generate_series(1, 12) g(j) WHERE j >= i AND j <= len(b) GROUP BY p_partkey),
    s AS (SELECT p_partkey, any_value(t) AS t, any_value(q) AS q, any_value(b) AS b, any_value(a) AS a, sum(weight) AS total, sum(CASE WHEN list_contains(b, token) THEN weight ELSE 0 END) AS hit, count(*) FILTER (list_contains(b, token)) AS hits, count(*) FILTER (list_contains(b, token) AND weight > 1.15) AS rare, count(*) FILTER (list_contains(b, token) AND regexp_matches(token, '^[0-9]+$')) AS numbers
          FROM (SELECT p_partkey, t, q, a, b, unnest(list_distinct(a)) AS token FROM x) JOIN w USING (token) GROUP BY p_partkey),
    z AS (SELECT p_partkey, run, hit / greatest(1, total) AS coverage, hits, rare, numbers, len(a) AS n, contains(q, t) AND (len(a) >= 2 OR length(t) >= 5) AS whole FROM s JOIN runs USING (p_partkey))
    SELECT p_partkey, round(CASE WHEN whole THEN 140.0::DOUBLE + n ELSE 35 + coverage * 70 + run * 10 + rare * 4 + numbers * 4 END, 6) AS score FROM z WHERE whole OR (hits >= 2 AND (run >= 3 OR coverage >= 0.6 OR (run >= 2 AND (coverage >= 0.28 OR rare >= 2))))""")
def title_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = _titles(spark, sf_dir)
    scored = catalog.title_score(_message(spark, sf_dir), titles, catalog.token_weights(titles, "p_partkey", "t"), "p_partkey", "t")
    return scored.where("score > 0").select("p_partkey", F.round("score", 6).alias("score"))


_MODES = {"single": ([7], "auto"), "explicit_one": ([3], "explicit"), "explicit_more": ([3, 5], "explicit"), "gone": ([-1], "auto"), "all": (None, "auto")}


def _scope_sql(name: str, ids: list[int] | None, mode: str) -> str:
    some = f"WHERE p_partkey IN ({', '.join(map(str, ids))})" if ids else ""
    one = "explicit_single" if mode == "explicit" else "requested_single" if ids else "catalog_single"
    many = "explicit_multiple" if mode == "explicit" else "unresolved"
    return f"""SELECT '{name}' AS request, CASE WHEN {'n = 0' if ids else 'false'} THEN 'invalid_requested_scope' WHEN s1 >= 60 AND (scored = 1 OR s1 - s2 >= 10) THEN 'catalog_reference' WHEN n = 1 THEN '{one}' ELSE '{many}' END AS method,
        CASE WHEN s1 >= 60 AND (scored = 1 OR s1 - s2 >= 10) THEN CAST(k AS VARCHAR) WHEN n = 1 THEN CAST(k0 AS VARCHAR) ELSE '' END AS resolved
        FROM (SELECT count(*) AS n, count(*) FILTER (s > 0) AS scored, coalesce(max(s), 0) AS s1, coalesce((list(s ORDER BY s DESC))[2], 0) AS s2, arg_max(p_partkey, s) AS k, min(p_partkey) AS k0 FROM parts {some})"""


@add(f"WITH {_FIELD}, parts AS (SELECT p_partkey, coalesce(score * 5, 0) AS s FROM part LEFT JOIN fs USING (p_partkey)) " + " UNION ALL ".join(_scope_sql(n, *m) for n, m in _MODES.items()))
def scope_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scope that a message names among all parts, or those that a request gives."""
    scored = table(spark, sf_dir, "part").select("p_partkey").join(_field_scores(spark, sf_dir), "p_partkey", "left").select("p_partkey", F.coalesce(F.col("score") * 5, F.lit(0.0)).alias("score"))
    out = None
    for name, (ids, mode) in _MODES.items():
        one = catalog.resolve_scope(scored, ids, mode, key="p_partkey").select(F.lit(name).alias("request"), "method", F.array_join("resolved", ",").alias("resolved"))
        out = one if out is None else out.unionByName(one)
    return out


_ASK = "Summarize Exam Book 18 READING TEST 2, the pdf"
_FILES = {"'Exam Book 18 READING TEST 2.pdf'": 240.0, "'Exam Book 18 READING TEST ' || (k % 9 + 30) || '.pdf'": None, "'Notes on reading test two ' || k || '.png'": 0.0, "k || ' summarize exam book.txt'": 0.0}


@add(f"SELECT k, {pick('k', '240.0 + 180.0', '160.0 + 5 + 5 / 6.0::DOUBLE + 5 * 20 + 180', '0.0', '0.0')}::DOUBLE AS score FROM {K} WHERE k % 4 < 3")
def catalog_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's scores together: its name, its kind and its titles, of which there are none here."""
    rows = made(spark, sf_dir, source_file=pick("k", *_FILES), mime_types="array('application/octet-stream')").where("k % 4 < 3")
    none = rows.select("k", F.lit("").alias("t"))
    scored = catalog.catalog_scores(_ASK, rows, none, none.select(F.lit("").alias("token"), F.lit(1.0).alias("weight")).limit(0), "k", "t")
    return scored.select("k", F.col("score").cast("double").alias("score"))


# streams


@add(f"SELECT k, {pick('k', '4', '0', '8', '2', '1')} AS held FROM {K}")
def held_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, text=pick("k", "k || ' so <thi'", "'<think> done ' || k", "k || '</think>'", "k || ' and </'", "k || '<'"))
    return rows.select("k", limits.held_back_column(F.col("text"), ["<think>", "</think>"]).alias("held"))


# models


@add("SELECT doc_id, 64 AS n, CASE WHEN length(trim(text)) = 0 THEN 0 ELSE 1 END AS norm FROM documents")
def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), models.HashingEmbedder(64))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return rows.select("doc_id", F.size("embedding").alias("n"), F.round(norm).cast("int").alias("norm"))


@add(f"SELECT k, {pick_text('k', 'table', 'questions', 'other', 'other')} AS label, {pick('k', '1.0', '2 / 3.0::DOUBLE', '0.0', '0.0')} AS confidence, k % 4 > 1 AS fell_back FROM {K}")
def classify_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, text=pick("k", "'show the table ' || k", "'questions and more questions: answer row ' || k", "'hello ' || k", "null"))
    said = models.classify(rows, models.WordClassifier({"table": ["table", "row"], "questions": ["questions", "answer"]}), ["table", "questions"], "other")
    return said.select("k", "label", "confidence", "fell_back")


class _Scripted:
    """Answers as its prompts say: after the word `as`, or in the wrong language."""

    def answer(self, prompts: list[str]) -> list[str]:
        return [p.split(" as ", 1)[1] if " as " in p else "What is the answer to this and which words are they?" for p in prompts]


@add(f"""SELECT k, CASE WHEN k % 4 = 0 THEN 0 WHEN k % 4 = 3 THEN 0 ELSE 1 END AS attempt, {pick('k', '0', '0', '1', '1')} AS issues, CASE WHEN k % 4 = 3 THEN 'What is the answer to this and which words are they?' WHEN k % 4 = 2 THEN '2. của tôi và bạn ' || k ELSE '1. của tôi và bạn ' || k END AS text FROM {K}""")
def review_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right at once, right the second time, better the second time, wrong both times."""
    from ..operators import contracts

    contract = contracts.ResponseContract(language="Vietnamese", enforce_language=True, required_numbers=(1,))
    wrong = contracts.ResponseContract(language="Vietnamese", enforce_language=True)
    rows = made_long(spark, sf_dir, prompt=pick("k", "'say as 1. của tôi và bạn ' || k", "'say'", "'say'", "'say'"), retry_prompt=pick("k", "''", "'again as 1. của tôi và bạn ' || k", "'again as 2. của tôi và bạn ' || k", "'again'"))
    told = models.reviewed(rows.where("k % 4 < 3"), _Scripted(), contract).unionByName(models.reviewed(rows.where("k % 4 = 3"), _Scripted(), wrong))
    return told.select("k", "attempt", F.size("issues").alias("issues"), "text")


@add(f"SELECT 'c' || k AS chunk_id, 'd' || (k % 3) AS document_id, 'f' || (k % 3) || '.pdf' AS source_file, CAST(NULL AS VARCHAR) AS retrieval_method, CASE WHEN k % 10 = 0 THEN 'passage' WHEN k % 5 = 1 THEN 'question_group' ELSE 'question' END AS unit_type, CAST(k % 4 + 1 AS INTEGER) AS passage_number, CAST(NULL AS VARCHAR) AS parent_id, CAST(k % 9 + 1 AS VARCHAR) AS pages FROM {K}")
def compact_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = dispatch.compact(_chunks(spark, sf_dir))
    return told.select("chunk_id", "document_id", "source_file", "retrieval_method", "unit_type", "passage_number", "parent_id", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"))
