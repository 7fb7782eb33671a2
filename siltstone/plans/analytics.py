"""Queries over small tables, catalogs, text quality and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog, quality, sessions, tables
from .common import Registry, sql_tokens, table

REGISTRY = Registry()
add = REGISTRY.add

#: One table for each market segment: nations by (metric, year).
_YEARS = (1996, 1997, 1998)
_METRICS = {"Order Count": "count(*)", "Customer Count": "count(DISTINCT c_custkey)"}


def _market(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    facts = orders.where(F.col("year").isin(*_YEARS)).join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "c_nationkey", "year").agg(F.count("*").alias("m0"), F.countDistinct("c_custkey").alias("m1"))
    cells = facts.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_mktsegment").alias("table_id"), F.col("n_nationkey").alias("row_idx"), F.col("n_name").alias("label"), "year",
        F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(name).alias("metric"), F.col(f"m{i}").alias("v")) for i, name in enumerate(_METRICS)))).alias("x"),
    )
    return cells.select(
        "table_id", "row_idx", "label", (F.col("x.i") * len(_YEARS) + F.col("year") - _YEARS[0] + 1).cast("int").alias("col_idx"),
        F.concat(F.col("x.metric"), F.lit(" "), F.col("year").cast("string")).alias("column"), F.col("x.v").cast("string").alias("value"),
    )


_MARKET = """
    f AS (SELECT c_mktsegment AS table_id, n_nationkey AS row_idx, n_name AS label, year(o_orderdate) AS y, count(*) AS m0, count(DISTINCT c_custkey) AS m1
          FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE year(o_orderdate) IN (1996, 1997, 1998) GROUP BY ALL),
    c AS (SELECT table_id, row_idx, label, y - 1995 AS col_idx, 'Order Count ' || CAST(y AS VARCHAR) AS col, m0 AS v FROM f
          UNION ALL SELECT table_id, row_idx, label, y - 1992, 'Customer Count ' || CAST(y AS VARCHAR), m1 FROM f)"""
_CELL = "What was the Order Count of {label} in 1997?"
_LABEL_SQL = "(SELECT n_name FROM nation WHERE n_nationkey = 3)"


def _label(spark: SparkSession, sf_dir: str) -> str:
    return table(spark, sf_dir, "nation").where("n_nationkey = 3").first()["n_name"]


@add(f"""WITH {_MARKET} SELECT table_id, label, col AS "column", CAST(v AS VARCHAR) AS value, 10.0::DOUBLE + 7 AS score FROM c WHERE col = 'Order Count 1997' AND row_idx = 3""")
def table_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cell_value(_market(spark, sf_dir), _CELL.format(label=_label(spark, sf_dir))).select("table_id", "label", "column", "value", "score")


@add(f"""WITH {_MARKET} SELECT table_id, 17.0::DOUBLE AS structured_score FROM c GROUP BY table_id HAVING bool_or(row_idx = 3) AND bool_or(col = 'Order Count 1997')""")
def table_cell_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cell_lookup_score(_market(spark, sf_dir), _CELL.format(label=_label(spark, sf_dir)))


def _change_sql(order: str, direction: str) -> str:
    return f"""WITH {_MARKET}, p AS (SELECT table_id, row_idx, any_value(label) AS label, CAST(max(v) FILTER (col = 'Order Count 1998') AS DOUBLE) AS first, CAST(max(v) FILTER (col = 'Order Count 1996') AS DOUBLE) AS second FROM c GROUP BY table_id, row_idx)
    SELECT table_id, label, first, second, second - first AS change, row_number() OVER (PARTITION BY table_id ORDER BY second - first {order}, row_idx) = 1 AS winner, '{direction}' AS direction FROM p WHERE first IS NOT NULL AND second IS NOT NULL"""


@add(_change_sql("DESC", "increase"))
def table_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.changes(_market(spark, sf_dir), "How did the order count change from 1998 to 1996?").drop("row_idx")


@add(_change_sql("ASC", "decrease"))
def table_change_decrease(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.changes(_market(spark, sf_dir), "Which order count saw the largest decrease from 1998 to 1996?").drop("row_idx")


_SPANS = _MARKET + """,
    s AS (SELECT *, regexp_replace(col, ' [0-9]{4}$', '') AS metric, CAST(right(col, 4) AS INTEGER) AS yr FROM c),
    e AS (SELECT table_id, metric, min(yr) AS ya, max(yr) AS yz, min(col_idx) AS pos FROM s GROUP BY table_id, metric HAVING min(yr) <> max(yr)),
    r AS (SELECT s.table_id, s.metric, e.ya, e.yz, e.pos, s.row_idx, any_value(label) AS label, max(v) FILTER (yr = ya) AS a, max(v) FILTER (yr = yz) AS z
          FROM s JOIN e USING (table_id, metric) GROUP BY s.table_id, s.metric, e.ya, e.yz, e.pos, s.row_idx HAVING a IS NOT NULL AND z IS NOT NULL)"""


@add(f"""WITH {_SPANS} SELECT table_id, CAST(pos AS INTEGER) AS "at", metric || ': ' || a || ' (' || ya || ') → ' || z || ' (' || yz || '), ' || CASE WHEN z >= a THEN 'tăng ' ELSE 'giảm ' END || abs(z - a) || '.' AS fact FROM r WHERE row_idx = 3""")
def table_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.comparison_facts(_market(spark, sf_dir), f"Compare {_label(spark, sf_dir)} over the years").select("table_id", "at", "fact")


_SIGNED = "CASE WHEN {0} >= 0 THEN '+' ELSE '' END || CAST({0} AS VARCHAR)"


@add(f"""WITH {_SPANS} SELECT table_id, CAST(pos AS INTEGER) AS "at",
    metric || ', values from ' || ya || ' to ' || yz || ': ' || string_agg(label || ' ' || a || ' -> ' || z || ' (' || {_SIGNED.format('(z - a)')} || ')', '; ' ORDER BY row_idx) || '. Largest increase: '
        || first(label || ' (' || {_SIGNED.format('(z - a)')} || ')' ORDER BY z - a DESC, row_idx) || '.' AS changes FROM r GROUP BY table_id, metric, ya, yz, pos""")
def table_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.summary_facts(_market(spark, sf_dir)).select("table_id", "at", "changes")


@add(f"""WITH {_SPANS} SELECT table_id, CAST(pos AS INTEGER) AS "at",
    metric || ' ranking in ' || ya || ': ' || string_agg(label || ' ' || a, ' > ' ORDER BY a DESC, row_idx) || '. Ranking in ' || yz || ': ' || string_agg(label || ' ' || z, ' > ' ORDER BY z DESC, row_idx)
        || '. Highest final value in ' || metric || ' ' || yz || ': ' || first(label || ' (' || z || ')' ORDER BY z DESC, row_idx) || '.' AS rankings FROM r GROUP BY table_id, metric, ya, yz, pos""")
def table_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.summary_facts(_market(spark, sf_dir)).select("table_id", "at", "rankings")


@add(f"""WITH {_MARKET}, h AS (SELECT table_id, '|  | ' || string_agg(col, ' | ' ORDER BY col_idx) || ' |' AS top, '| --- | ' || string_agg('---', ' | ') || ' |' AS rule FROM (SELECT DISTINCT table_id, col_idx, col FROM c) GROUP BY table_id),
    p AS (SELECT t.table_id, t.row_idx, t.label, n.col_idx, max(c.v) AS v FROM (SELECT table_id, row_idx, any_value(label) AS label FROM c GROUP BY table_id, row_idx) t JOIN (SELECT DISTINCT table_id, col_idx FROM c) n ON n.table_id = t.table_id
          LEFT JOIN c ON c.table_id = t.table_id AND c.row_idx = t.row_idx AND c.col_idx = n.col_idx GROUP BY ALL),
    w AS (SELECT table_id, row_idx, '| ' || any_value(label) || ' | ' || string_agg(coalesce(CAST(v AS VARCHAR), ''), ' | ' ORDER BY col_idx) || ' |' AS line FROM p GROUP BY table_id, row_idx)
    SELECT table_id, any_value(top) || chr(10) || any_value(rule) || chr(10) || string_agg(line, chr(10) ORDER BY row_idx) AS markdown FROM w JOIN h USING (table_id) GROUP BY table_id""")
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.markdown(_market(spark, sf_dir))


# catalog


def _chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.lit("").alias("document_id"), F.col("source").alias("source_file"), F.col("doc_id").alias("position"), "lang", (F.col("doc_id") % 5).alias("page"), F.when(F.col("source").isin("src1", "src2"), F.concat(F.lit("2026-07-2"), (F.col("doc_id") % 5).cast("string"))).alias("ingested_at"))


_CATALOG = """SELECT source AS document_key, count(*) AS chunks, list_sort(list_distinct(list(lang))) AS unit_types, coalesce(list_sort(list_distinct(list(doc_id % 5) FILTER (doc_id % 5 <> 0))), []) AS pages,
    coalesce(max(CASE WHEN source IN ('src1', 'src2') THEN '2026-07-2' || CAST(doc_id % 5 AS VARCHAR) END), '') AS ingested_at, max(doc_id) AS last_position FROM documents GROUP BY source"""


@add(_CATALOG)
def catalog_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.catalog(_chunk_rows(spark, sf_dir), {"unit_types": "lang", "pages": "page"}).drop("source_file")


@add(f"SELECT document_key, last_position FROM ({_CATALOG}) ORDER BY ingested_at <> '' DESC, ingested_at DESC, last_position DESC LIMIT 5")
def catalog_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.by_recency(catalog.catalog(_chunk_rows(spark, sf_dir), {})).select("document_key", "last_position").limit(5)


@add("SELECT p_brand, list(w ORDER BY p) AS word FROM (SELECT p_brand, lower(p_type) AS l, min(p_partkey) AS p, arg_min(p_type, p_partkey) AS w FROM part GROUP BY ALL) GROUP BY p_brand")
def ordered_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_brand", F.col("p_type").alias("word"), "p_partkey")
    return catalog.ordered_unique(rows, ["p_brand"], "word", "p_partkey")


_FLAT = r"trim(regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'))"


@add(rf"""WITH d AS (SELECT doc_id, {_FLAT} AS flat FROM documents), e AS (SELECT doc_id, flat, regexp_extract(flat, '^(.*?[.!?])(\s|$)', 1) AS s FROM d), f AS (SELECT doc_id, CASE WHEN s = '' THEN flat ELSE s END AS x FROM e)
    SELECT doc_id, CASE WHEN length(x) > 220 THEN rtrim(left(x, 217)) || '...' ELSE x END AS descriptor FROM f""")
def target_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", catalog.target_descriptor(F.col("text")).alias("descriptor"))


_NORM = "array_to_string(regexp_extract_all(lower({0}), '[a-z0-9]+'), ' ')"
_IDF = f"""
    v AS (SELECT p_partkey, {_NORM.format('p_name')} AS t FROM part),
    tok AS (SELECT DISTINCT p_partkey, unnest(string_split(t, ' ')) AS token FROM v),
    w AS (SELECT token, count(*) AS df, 1.0::DOUBLE + ln(((SELECT count(*) FROM v WHERE t <> '') + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) AS weight FROM tok WHERE token <> '' GROUP BY token)"""


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.regexp_extract_all(F.lower("p_name"), F.lit("([a-z0-9]+)"), 1), " ").alias("t"))


@add(f"WITH {_IDF} SELECT token, df, round(weight, 9) AS weight FROM w")
def title_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.token_weights(_titles(spark, sf_dir), "p_partkey", "t").select("token", "df", F.round("weight", 9).alias("weight"))


def _message(spark: SparkSession, sf_dir: str) -> str:
    return "please find " + table(spark, sf_dir, "part").where("p_partkey = 7").first()["p_name"]


_MSG = f"(SELECT 'please find ' || {_NORM.format('p_name')} FROM part WHERE p_partkey = 7)"
_FIELD = f"""{_IDF}, m AS (SELECT {_MSG} AS q), tk AS (SELECT p_partkey, t, unnest(list_distinct(string_split(t, ' '))) AS token FROM v WHERE t <> ''),
    sc AS (SELECT p_partkey, t, sum(coalesce(weight, 1)) AS a, sum(CASE WHEN list_contains(string_split(q, ' '), token) THEN weight END) AS h, any_value(q) AS q FROM tk LEFT JOIN w USING (token), m GROUP BY p_partkey, t),
    fs AS (SELECT p_partkey, 22.0::DOUBLE * (h / greatest(1, a) + CASE WHEN contains(q, t) THEN 0.35::DOUBLE ELSE 0 END) AS score FROM sc WHERE h IS NOT NULL)"""


def _field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _titles(spark, sf_dir)
    return catalog.field_score(_message(spark, sf_dir), values, catalog.token_weights(values, "p_partkey", "t"), ["p_partkey"], "t", 22.0)


@add(f"WITH {_FIELD} SELECT p_partkey, round(score, 6) AS score FROM fs")
def metadata_field_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _field_scores(spark, sf_dir).select("p_partkey", F.round("score", 6).alias("score"))


@add(f"WITH {_FIELD} SELECT p_partkey, round(score, 6) AS score FROM fs ORDER BY score DESC, p_partkey IN (3, 5, 11) DESC, p_partkey LIMIT 10")
def rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _field_scores(spark, sf_dir).withColumn("score", F.round("score", 9)).withColumn("recency", F.col("p_partkey"))
    return catalog.rank_candidates(scored, 10, [3, 5, 11], key="p_partkey").select("p_partkey", F.round("score", 6).alias("score"))


@add(f"""WITH {_FIELD}, s AS (SELECT p_partkey, score * 5 AS s FROM fs), t AS (SELECT s, p_partkey, row_number() OVER (ORDER BY s DESC, p_partkey) AS r FROM s WHERE s > 0),
    b AS (SELECT max(s) FILTER (r = 1) AS s1, coalesce(max(s) FILTER (r = 2), 0) AS s2, max(p_partkey) FILTER (r = 1) AS k, count(*) AS n FROM t WHERE r <= 2)
    SELECT CASE WHEN s1 >= 60 AND (n = 1 OR s1 - s2 >= 10) THEN 'catalog_reference' ELSE 'unresolved' END AS method, CASE WHEN s1 >= 60 AND (n = 1 OR s1 - s2 >= 10) THEN [CAST(k AS VARCHAR)] ELSE [] END AS resolved FROM b""")
def scope_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _field_scores(spark, sf_dir).withColumn("score", F.col("score") * 5)
    return catalog.resolve_scope(scored, key="p_partkey")


@add(f"""WITH {_IDF}, m AS (SELECT {_MSG} AS q), x AS (SELECT p_partkey, t, q FROM v, m WHERE t <> '')
    SELECT p_partkey, 140.0::DOUBLE + len(string_split(t, ' ')) AS score FROM x WHERE contains(q, t) AND (len(string_split(t, ' ')) >= 2 OR length(t) >= 5)""")
def title_whole_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = _titles(spark, sf_dir)
    scored = catalog.title_score(_message(spark, sf_dir), titles, catalog.token_weights(titles, "p_partkey", "t"), "p_partkey", "t")
    return scored.where("score >= 140 and score = floor(score)")


@add(f"""WITH v AS (SELECT p_partkey, {_NORM.format('p_name')} AS t FROM part), m AS (SELECT {_MSG} AS q), x AS (SELECT p_partkey, t, q, string_split(t, ' ') AS a, string_split(q, ' ') AS b FROM v, m),
    runs AS (SELECT p_partkey, max(CASE WHEN contains(' ' || t || ' ', ' ' || array_to_string(b[i:j], ' ') || ' ') THEN j - i + 1 ELSE 0 END) AS run
             FROM (SELECT *, unnest(generate_series(1, len(b))) AS i FROM x), generate_series(1, 12) g(j) WHERE j >= i AND j <= len(b) GROUP BY p_partkey)
    SELECT p_partkey, CAST(t <> '' AND contains(q, t) AS INTEGER) AS whole, CAST(run AS INTEGER) AS run, CAST(len(list_intersect(list_distinct(a), list_distinct(b))) AS INTEGER) AS shared
    FROM x JOIN runs USING (p_partkey) ORDER BY whole DESC, run DESC, shared DESC, p_partkey LIMIT 20""")
def value_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.value_order(_message(spark, sf_dir), table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")
    return rows.select("p_partkey", "whole", "run", "shared").limit(20)


@add("SELECT source, doc_id FROM (SELECT source, doc_id, sum(least(n_chars, 360)) OVER (PARTITION BY source ORDER BY doc_id) AS s FROM documents) WHERE s <= 3000")
def catalog_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return catalog.within_budget(rows, ["doc_id"], F.least(F.col("n_chars"), F.lit(catalog.ENTRY_CHARS)), catalog.CATALOG_CHARS, ["source"]).select("source", "doc_id")


# text


@add(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[\x{200B}\x{200C}\x{200D}\x{FEFF}]', '', 'g'), '\r\n|\r', chr(10), 'g'), '[ \t\r\f\x0B]+', ' ', 'g'),
    '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text_sha256 FROM documents""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_text(F.col("text")), 256).alias("text_sha256"))


@add(f"SELECT doc_id, CAST(len(list_distinct({sql_tokens('text')})) AS INTEGER) AS terms FROM documents")
def term_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.term_set(F.col("text"))).alias("terms"))


@add("SELECT doc_id, CAST(greatest(1, length(text) // 4) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


_STRIP = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_READ = rf"CASE WHEN length({_STRIP}) = 0 THEN 0.0::DOUBLE ELSE length(regexp_replace({_STRIP}, '[^\p{{L}}\p{{N}}\s\x20-\x7E\x{{00C0}}-\x{{1EF9}}]', '', 'g')) / length({_STRIP})::DOUBLE END"
_CTRL = rf"CASE WHEN length({_STRIP}) = 0 THEN 1.0::DOUBLE ELSE (length({_STRIP}) - length(regexp_replace({_STRIP}, '[\x00-\x08\x0B-\x1F\x7F-\x9F\x{{00AD}}\x{{200B}}-\x{{200F}}\x{{FEFF}}]', '', 'g'))) / length({_STRIP})::DOUBLE END"
_REPEATED = r"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents), l AS (SELECT doc_id, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS x FROM lines),
    n AS (SELECT doc_id, x, count(*) AS c FROM l WHERE x <> '' GROUP BY doc_id, x),
    rep AS (SELECT doc_id, CASE WHEN sum(c) < 4 THEN 0.0::DOUBLE ELSE coalesce(sum(c) FILTER (c > 1), 0) / sum(c)::DOUBLE END AS repeated FROM n GROUP BY doc_id)"""


@add(f"SELECT doc_id, round({_READ}, 9) AS readable FROM documents")
def readable_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.readable_ratio(T.strip(F.col("text"))), 9).alias("readable"))


@add(f"SELECT doc_id, round({_CTRL}, 9) AS control FROM documents")
def control_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.control_ratio(T.strip(F.col("text"))), 9).alias("control"))


@add(f"WITH {_REPEATED} SELECT d.doc_id, round(coalesce(repeated, 0.0::DOUBLE), 9) AS repeated FROM documents d LEFT JOIN rep USING (doc_id)")
def repeated_line_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(quality.repeated_line_ratio(F.col("text")), 9).alias("repeated"))


@add(f"""WITH {_REPEATED}, q AS (SELECT doc_id, length({_STRIP}) AS n, {_READ} AS readable, {_CTRL} AS control, coalesce(repeated, 0.0::DOUBLE) AS repeated, doc_id % 12 AS blocks, (doc_id % 10) / 10.0::DOUBLE AS coverage FROM documents LEFT JOIN rep USING (doc_id)),
    s AS (SELECT *, coverage >= 0.65 AND blocks <= 1 AS scanned, list_filter([CASE WHEN n < 40 THEN 'too_few_chars' END, CASE WHEN readable < 0.82 THEN 'low_readable_ratio' END, CASE WHEN control > 0.03 THEN 'too_many_control_chars' END,
        CASE WHEN repeated > 0.35 THEN 'too_many_repeated_lines' END, CASE WHEN coverage >= 0.65 AND blocks <= 1 THEN 'likely_scanned_page' END, CASE WHEN blocks = 0 THEN 'no_text_blocks' END], lambda x: x IS NOT NULL) AS reasons FROM q),
    g AS (SELECT *, greatest(0.0, least(1.0, 1.0::DOUBLE - least(0.4, greatest(0, 40 - n) / 40.0::DOUBLE * 0.4) - least(0.25, greatest(0.0, 0.82::DOUBLE - readable)) - least(0.2, control * 4) - least(0.2, repeated) - CASE WHEN scanned THEN 0.25 ELSE 0 END)) AS score FROM s)
    SELECT doc_id, array_to_string(reasons, ',') AS reasons, CAST(round(score, 6) AS DOUBLE) AS score, len(reasons) = 0 OR (score >= 0.72 AND NOT scanned AND blocks <> 0) AS usable, blocks > 8 OR coverage > 0.35 AS requires_layout FROM g""")
def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 12).alias("text_block_count"), ((F.col("doc_id") % 10) / F.lit(10.0)).alias("image_coverage"))
    return quality.page_quality(pages).select("doc_id", F.array_join("reasons", ",").alias("reasons"), F.round("score", 6).alias("score"), "usable", "requires_layout")


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item as recognised text of the page that has the same number as native text."""
    native = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.lit("e1").alias("element_id"), F.lit("paragraph").alias("kind"), F.lit("native").alias("source"), "text")
    seen = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 3).alias("page_id"), F.lit("e2").alias("element_id"), F.lit("ocr_overlay").alias("kind"), F.lit("engine").alias("source"), "text")
    again = native.where("page_id % 4 = 1").select("page_id", F.lit("e3").alias("element_id"), F.lit("paragraph").alias("kind"), F.lit("OCR").alias("source"), F.concat("text", F.lit(" zusatz eins zwei")).alias("text"))
    return native.unionByName(seen).unionByName(again)


_ELEMENTS = f"""
    el AS (SELECT doc_id AS page_id, 'e1' AS element_id, 'paragraph' AS kind, false AS ocr, text FROM documents
           UNION ALL SELECT item_id * 3, 'e2', 'ocr_overlay', true, text FROM benchmark
           UNION ALL SELECT doc_id, 'e3', 'paragraph', true, text || ' zusatz eins zwei' FROM documents WHERE doc_id % 4 = 1),
    nt AS (SELECT page_id, list_distinct(flatten(list({sql_tokens('text')}))) AS nterms FROM el WHERE NOT ocr GROUP BY page_id),
    ov AS (SELECT el.*, nterms, list_distinct({sql_tokens('text')}) AS own FROM el LEFT JOIN nt USING (page_id)),
    mt AS (SELECT *, len(list_intersect(own, coalesce(nterms, []))) / greatest(len(own), 1)::DOUBLE AS token_overlap FROM ov),
    du AS (SELECT *, (len(own) - len(list_intersect(own, coalesce(nterms, [])))) / greatest(len(own), 1)::DOUBLE AS new_token_ratio FROM mt),
    rc AS (SELECT *, coalesce(ocr AND nterms IS NOT NULL AND token_overlap >= 0.92 AND new_token_ratio < 0.08, false) AS duplicate FROM du)"""


@add(f"WITH {_ELEMENTS} SELECT page_id, element_id, round(token_overlap, 9) AS token_overlap, round(new_token_ratio, 9) AS new_token_ratio FROM rc WHERE ocr")
def reconcile_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.reconcile(_elements(spark, sf_dir)).where("ocr")
    return rows.select("page_id", "element_id", F.round("token_overlap", 9).alias("token_overlap"), F.round("new_token_ratio", 9).alias("new_token_ratio"))


@add(f"WITH {_ELEMENTS} SELECT page_id, element_id, duplicate, CASE WHEN ocr AND nterms IS NOT NULL AND NOT duplicate THEN 'ocr_supplement' ELSE kind END AS kind_after FROM rc")
def reconcile_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.reconcile(_elements(spark, sf_dir)).select("page_id", "element_id", "duplicate", "kind_after")


@add(f"""WITH {_ELEMENTS} SELECT page_id, count(*) FILTER (NOT ocr) AS native_elements, count(*) FILTER (ocr) AS ocr_elements, count(*) FILTER (duplicate) AS duplicates_removed,
    'native' || CASE WHEN count(*) FILTER (NOT ocr) = 0 THEN '' WHEN count(*) FILTER (duplicate) > 0 THEN '_deduped' WHEN count(*) FILTER (ocr) > 0 THEN '_reconciled' ELSE '' END AS processing_route,
    coalesce(array_to_string(list_sort(list(DISTINCT CASE WHEN duplicate THEN NULL WHEN ocr AND nterms IS NOT NULL THEN 'ocr_supplement' ELSE kind END)), ','), '') AS element_types FROM rc GROUP BY page_id""")
def page_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.page_report(quality.reconcile(_elements(spark, sf_dir))).withColumn("element_types", F.array_join("element_types", ","))


@add(f"""WITH x AS (SELECT b.item_id, d.text AS n, b.text AS o FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)
    SELECT item_id, len(list_distinct({sql_tokens('o')})) - len(list_intersect(list_distinct({sql_tokens('o')}), list_distinct({sql_tokens('n')}))) >= 5 OR length(o) > length(n) * 1.1 AS adds FROM x""")
def ocr_adds_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("o")).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("n")), "item_id")
    return both.select("item_id", quality.ocr_adds_text(F.col("n"), F.col("o")).alias("adds"))


@add(None)
def ocr_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.reconcile(_elements(spark, sf_dir), with_similarity=True)
    return rows.where("ocr").select("page_id", "element_id", F.round("similarity", 4).alias("similarity"), "duplicate")


# sessions


@add("""WITH r AS (SELECT *, row_number() OVER w AS rn, sum(length(text)) OVER w AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))
    SELECT conv_id, turn, role FROM r WHERE rn <= 8 AND (s <= 12000 OR rn = 1)""")
def history_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.selected_history(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role")


_SPEAK = "CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END"


@add(f"""WITH r AS (SELECT *, row_number() OVER w AS rn, sum(length(text)) OVER w AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))
    SELECT conv_id, string_agg({_SPEAK} || text, chr(10) ORDER BY turn) AS history FROM r WHERE rn <= 8 AND (s <= 12000 OR rn = 1) GROUP BY conv_id""")
def format_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.format_history(table(spark, sf_dir, "conversations"))


@add(rf"""WITH r AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
    SELECT conv_id, string_agg({_SPEAK} || CASE WHEN length(t) > 600 THEN left(t, 297) || chr(10) || '...' || chr(10) || right(t, 297) ELSE t END, chr(10) ORDER BY turn) AS history FROM r WHERE rn <= 2 GROUP BY conv_id""")
def route_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.route_history(table(spark, sf_dir, "conversations"))


@add("SELECT conv_id, turn, CAST(length(text) AS INTEGER) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 4")
def history_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.last_messages(table(spark, sf_dir, "conversations"), 4).select("conv_id", "turn", F.length("text").alias("n"))


_FACTS = """l AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max((ts, event_id)) AS u FROM events GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY u DESC, event_type) AS rn FROM l)"""


@add(f"WITH {_FACTS} SELECT user_id, event_type, value FROM k WHERE rn <= 3")
def fact_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.merge_facts(table(spark, sf_dir, "events"), "user_id", "event_type", "value", ["ts", "event_id"], 3).select("user_id", "event_type", "value")


@add(f"""WITH {_FACTS}, n AS (SELECT user_id, u, event_type, rn, '- ' || event_type || ': ' || CAST(CAST(value AS BIGINT) AS VARCHAR) AS line FROM (SELECT user_id, event_type, floor(value) AS value, u, rn FROM k)),
    s AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY user_id ORDER BY rn) AS s FROM n WHERE rn <= 12) SELECT user_id, string_agg(line, chr(10) ORDER BY rn DESC) AS profile FROM s WHERE s <= 40 OR rn = 1 GROUP BY user_id""")
def fact_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "events").withColumn("value", F.floor("value"))
    return sessions.fact_lines(sessions.merge_facts(facts, "user_id", "event_type", "value", ["ts", "event_id"]), "user_id", "event_type", "value", 40)


@add("""WITH g AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) >= 1800000000 THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, CAST(coalesce(sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS session_no FROM g""")
def session_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.idle_sessions(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("event_id", "session_no")


@add("""WITH s AS (SELECT user_id, max(epoch_us(ts)) / 1e6 AS last_access, CASE WHEN user_id % 2 = 0 THEN max(epoch_us(ts)) / 1e6 + 60 END AS scheduled_at, user_id % 3 AS active, (SELECT max(epoch_us(ts)) / 1e6 FROM events) AS now FROM events GROUP BY user_id),
    o AS (SELECT *, coalesce(now >= scheduled_at + 300, false) OR now - last_access >= 1800 AS over FROM s) SELECT user_id, over AND active = 0 AS expired, over AND active > 0 AS delete_pending FROM o""")
def session_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max(seconds).alias("now"))
    rows = events.groupBy("user_id").agg(F.max(seconds).alias("last_access")).withColumns({"scheduled_at": F.when(F.col("user_id") % 2 == 0, F.col("last_access") + 60), "active": F.col("user_id") % 3})
    return sessions.expired(rows.join(F.broadcast(now)), F.col("now")).select("user_id", "expired", "delete_pending")


@add("""SELECT event_id, CAST(sum(CASE WHEN event_id % 3 <> 0 THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS open FROM events""")
def operations_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.operations_open(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_id") % 3 != 0).select("event_id", "open")


@add("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS in_window FROM events""")
def rate_window_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return sessions.rate_window_count(table(spark, sf_dir, "events"), ["user_id"], seconds, 3600).select("event_id", "in_window")


_LIMIT, _WINDOW = 3, 7200.0


@add("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) / 1e6, event_id) AS rn FROM events),
    f AS (SELECT user_id, rn, event_id, true AS accepted, 0 AS retry_after, [s] AS held FROM e WHERE rn = 1
      UNION ALL SELECT x.user_id, x.rn, x.event_id, x.n < 3, CASE WHEN x.n < 3 THEN 0 ELSE greatest(1, CAST(trunc(7200.0 - (x.s - x.live[1])) AS INTEGER) + 1) END, CASE WHEN x.n < 3 THEN list_append(x.live, x.s) ELSE x.live END
      FROM (SELECT e.user_id, e.rn, e.event_id, e.s, list_filter(f.held, lambda h: h > e.s - 7200.0) AS live, len(list_filter(f.held, lambda h: h > e.s - 7200.0)) AS n FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1) x)
    SELECT event_id, accepted, CAST(retry_after AS BIGINT) AS retry_after FROM f""")
def rate_limit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"))
    return sessions.rate_limit_log(events, ["user_id"], "seconds", "event_id", _LIMIT, _WINDOW).select("event_id", "accepted", "retry_after")


@add("""WITH e AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), p AS (SELECT *, lag(n) OVER (PARTITION BY user_id, event_type ORDER BY n) AS before, lead(n) OVER (PARTITION BY user_id, event_type ORDER BY n) AS after FROM e),
    d AS (SELECT a.event_id, a.user_id, a.n, a.event_type, any_value(a.before) AS before, count(DISTINCT b.event_type) FILTER (b.n > a.before) AS between_them FROM p a LEFT JOIN p b ON a.user_id = b.user_id AND b.n < a.n AND b.event_type <> a.event_type GROUP BY ALL),
    h AS (SELECT *, before IS NOT NULL AND between_them < 3 AS hit FROM d),
    g AS (SELECT h.event_id, h.hit, (SELECT x.event_type FROM p x WHERE x.user_id = h.user_id AND x.n < h.n AND x.event_type <> h.event_type AND (x.after IS NULL OR x.after >= h.n) ORDER BY x.n DESC LIMIT 1 OFFSET 2) AS victim FROM h)
    SELECT event_id, hit, CASE WHEN NOT hit THEN victim END AS evicted FROM g""")
def cache_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of three kinds of events for each user: by the kinds used between two uses of one."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return sessions.cache_log(events, "user_id", ["ts", "event_id"], "event_type", 3).select("event_id", "hit", "evicted")


@add("SELECT count(*) AS buckets, CAST(sum(n) AS BIGINT) AS events FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7200 SECOND GROUP BY ALL)")
def limiter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, seconds = table(spark, sf_dir, "events"), F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    now = events.agg(F.max(seconds)).first()[0]
    return sessions.bucket_stats(sessions.prune(events, seconds, now, 7200.0), ["user_id", "event_type"])


@add("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_paid FROM events""")
def state_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("last_paid", F.when(F.col("event_type") == "purchase", F.col("value")))
    return sessions.carry_forward(rows, "user_id", "event_id", ["last_paid"]).select("event_id", "last_paid")
