"""Queries over the store, retrieval and lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranges as R
from ..operators import lookup, search, store
from .common import Registry, chunks, query_text, query_vector, quoted, sql_dot, sql_terms, table, vectors

REGISTRY = Registry()
add = REGISTRY.add

_DENSE = f"""
    qv AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
    dense_all AS (SELECT vec_id, label, {sql_dot('embedding', 'q')} AS score FROM embeddings, qv)"""
_KEYWORD = f"""
    qt AS (SELECT {sql_terms('text')} AS qterms, lower(text) AS phrase FROM benchmark WHERE item_id = 0),
    dt AS (SELECT doc_id, lang, source, lower(text) AS low, {sql_terms('text')} AS terms FROM documents),
    kw_all AS (SELECT doc_id, lang, CAST(len(list_filter(qterms, lambda t: list_contains(terms, t))) + CASE WHEN contains(low, phrase) THEN 2 ELSE 0 END AS DOUBLE) AS keyword_score
               FROM dt, qt)"""
_FUSED = """
    d AS (SELECT vec_id AS chunk_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM dense_all WHERE score >= {least} {scope_d} ORDER BY score DESC, vec_id LIMIT {k}),
    k AS (SELECT doc_id AS chunk_id, keyword_score, row_number() OVER (ORDER BY keyword_score DESC, doc_id) AS r FROM kw_all WHERE keyword_score > 0 {scope_k} ORDER BY keyword_score DESC, doc_id LIMIT {k}),
    u AS (SELECT chunk_id, 0 AS n, r, score AS ds, 0.0 AS ks FROM d UNION ALL SELECT chunk_id, 1, r, 0.0, keyword_score FROM k),
    f AS (SELECT chunk_id, sum(1.0::DOUBLE / (60.0::DOUBLE + r)) AS rrf, max(ds) AS ds, max(ks) AS ks, min(n * 1000 + r) AS first,
                 CASE WHEN count(*) = 2 THEN 'dense,keyword' WHEN min(n) = 0 THEN 'dense' ELSE 'keyword' END AS methods FROM u GROUP BY chunk_id)"""


def _shown(fused: DataFrame) -> DataFrame:
    return fused.select("chunk_id", F.round("rrf_score", 9).alias("rrf_score"), F.round("dense_score", 6).alias("dense_score"), F.round("keyword_score", 6).alias("keyword_score"), F.array_join("methods", ",").alias("methods"))


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return vectors(spark, sf_dir), chunks(spark, sf_dir)


@add(f"WITH {_DENSE}, {_KEYWORD}, {_FUSED.format(least=0.35, k=10, scope_d='', scope_k='')} SELECT chunk_id, round(rrf, 9) AS rrf_score, round(ds, 6) AS dense_score, round(ks, 6) AS keyword_score, methods FROM f ORDER BY rrf DESC, ks DESC, ds DESC, first LIMIT 5")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense, text = _both(spark, sf_dir)
    query, vector = query_text(spark, sf_dir), query_vector(spark, sf_dir)
    return _shown(search.fuse(5, dense=search.dense_search(dense, vector, 10, search.HYBRID_MIN_SCORE), keyword=search.keyword_search(text, query, 10)))


@add(f"WITH {_DENSE}, {_KEYWORD}, {_FUSED.format(least=0.35, k=6, scope_d='', scope_k='')} SELECT chunk_id, round(rrf, 9) AS rrf_score, ks >= 2 OR ds >= 0.45 AS strong FROM f ORDER BY rrf DESC, ks DESC, ds DESC, first LIMIT 3")
def probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    store_rows = chunks(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id", "left").withColumns({"range_start": F.lit(None).cast("int"), "range_end": F.lit(None).cast("int")})
    found = search.probe(store_rows, query_text(spark, sf_dir), query_vector(spark, sf_dir))
    return found.select("chunk_id", F.round("rrf_score", 9).alias("rrf_score"), "strong")


@add(f"WITH {_DENSE}, {_KEYWORD}, {_FUSED.format(least=0.35, k=6, scope_d='', scope_k='')} SELECT coalesce(bool_or(ks > 0), false) AS has_lexical_hit FROM (SELECT * FROM f ORDER BY rrf DESC, ks DESC, ds DESC, first LIMIT 3)")
def lexical_hit_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense, text = _both(spark, sf_dir)
    k = 6
    return search.has_lexical_hit(search.fuse(3, dense=search.dense_search(dense, query_vector(spark, sf_dir), k, search.HYBRID_MIN_SCORE), keyword=search.keyword_search(text, query_text(spark, sf_dir), k)))


@add(f"WITH {_DENSE} SELECT vec_id, round(score, 6) AS score FROM dense_all WHERE score >= -1 ORDER BY score DESC, vec_id LIMIT 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.dense_search(vectors(spark, sf_dir), query_vector(spark, sf_dir), 10, -1.0).select(F.col("chunk_id").alias("vec_id"), F.round("score", 6).alias("score"))


@add(f"WITH {_DENSE} SELECT vec_id, round(score, 6) AS score FROM dense_all WHERE score >= 0.45 ORDER BY score DESC, vec_id LIMIT 50")
def dense_topk_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.dense_search(vectors(spark, sf_dir), query_vector(spark, sf_dir), 50).select(F.col("chunk_id").alias("vec_id"), F.round("score", 6).alias("score"))


@add(f"WITH {_DENSE} SELECT vec_id, round(score, 6) AS score FROM dense_all WHERE label IN (0, 1) AND score >= -1 ORDER BY score DESC, vec_id LIMIT 10")
def dense_topk_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.dense_search(vectors(spark, sf_dir), query_vector(spark, sf_dir), 10, -1.0, unit_types=["0", "1"]).select(F.col("chunk_id").alias("vec_id"), F.round("score", 6).alias("score"))


@add(f"""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query_id, vec_id, {sql_dot('embedding', 'q')} AS score FROM embeddings, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def dense_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    found = search.dense_search_batch(vectors(spark, sf_dir), queries, 5)
    return found.select("query_id", F.col("chunk_id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@add(f"WITH {_KEYWORD} SELECT doc_id, keyword_score FROM kw_all WHERE keyword_score > 0 ORDER BY keyword_score DESC, doc_id LIMIT 20")
def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.keyword_search(chunks(spark, sf_dir), query_text(spark, sf_dir), 20).select(F.col("chunk_id").alias("doc_id"), "keyword_score")


@add(f"WITH {_KEYWORD} SELECT doc_id, keyword_score FROM kw_all WHERE keyword_score > 0 AND lang = 'en' ORDER BY keyword_score DESC, doc_id LIMIT 20")
def keyword_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.keyword_search(chunks(spark, sf_dir), query_text(spark, sf_dir), 20, unit_types=["en"]).select(F.col("chunk_id").alias("doc_id"), "keyword_score")


@add("SELECT doc_id, lang, source FROM documents WHERE doc_id IN (1, 2, 3, 5, 8, 13, 21) AND lang IN ('en', 'de')")
def candidate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.candidates(chunks(spark, sf_dir), document_ids=["1", "2", "3", "5", "8", "13", "21"], unit_types=["en", "de"])
    return rows.select(F.col("chunk_id").alias("doc_id"), F.col("unit_type").alias("lang"), F.col("source_file").alias("source"))


@add("SELECT doc_id FROM documents WHERE false")
def empty_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.candidates(chunks(spark, sf_dir), document_ids=[]).select(F.col("chunk_id").alias("doc_id"))


_LINES = """WITH o AS (SELECT l_orderkey AS k, min(l_linenumber) AS a, max(l_linenumber) AS b, count(*) AS n FROM lineitem GROUP BY l_orderkey)"""


@add(f"""{_LINES}, q AS (SELECT * FROM (VALUES (1, 2, 3), (2, 5, 6), (3, 4, 4)) t(qid, s, e))
    SELECT qid, count(*) AS met, CAST(sum(least(b, e) - greatest(a, s) + 1) AS BIGINT) AS overlap FROM o JOIN q ON greatest(a, s) <= least(b, e) GROUP BY qid""")
def range_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("b"))
    asked = spark.createDataFrame([(1, 2, 3), (2, 5, 6), (3, 4, 4)], "qid int, s int, e int")
    met = R.meeting(spans, "a", "b", asked, "s", "e")
    return met.groupBy("qid").agg(F.count("*").alias("met"), F.sum(R.overlap_size(F.col("a"), F.col("b"), F.col("s"), F.col("e"))).cast("bigint").alias("overlap"))


@add(f"""{_LINES}, s AS (SELECT k, n, CASE WHEN greatest(a, 2) <= least(b, 4) THEN 30.0::DOUBLE + (least(b, 4) - greatest(a, 2) + 1) + CASE WHEN a = 2 AND b = 4 THEN 20 ELSE 0 END + CASE WHEN n > 3 THEN 8 ELSE 4 END ELSE 0.0::DOUBLE END AS sc FROM o)
    SELECT k AS chunk_id, sc AS question_score FROM s WHERE sc > 0 ORDER BY sc DESC, k LIMIT 25""")
def question_range_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.question_range_search(_ordered(spark, sf_dir), "questions 2-4", 25).select("chunk_id", "question_score")


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as groups over the numbers of their lines."""
    spans = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("range_start"), F.max("l_linenumber").alias("range_end"), F.count("*").alias("n"))
    return spans.select(
        F.col("l_orderkey").alias("chunk_id"), F.col("l_orderkey").alias("position"), F.col("l_orderkey").cast("string").alias("document_id"), "range_start", "range_end",
        F.when(F.col("n") > 3, "question_group").otherwise("question").alias("unit_type"), F.lit("").alias("text"),
    )


@add(f"""{_LINES}, s AS (SELECT k, n, CASE WHEN greatest(a, 2) <= least(b, 4) THEN (least(b, 4) - greatest(a, 2) + 1) + CASE WHEN a = 2 AND b = 4 THEN 100.0::DOUBLE WHEN a <= 2 AND 4 <= b THEN 70 ELSE 30 END + CASE WHEN n > 3 THEN 15 ELSE 8 END ELSE 0.0::DOUBLE END AS sc FROM o)
    SELECT k AS chunk_id, sc AS structured_score, 'structured_question' AS retrieval_method FROM s WHERE sc > 0 ORDER BY sc DESC, k LIMIT 25""")
def question_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.question_lookup(_ordered(spark, sf_dir), [(2, 4)], 25).select("chunk_id", "structured_score", "retrieval_method")


@add(f"""{_LINES}, s AS (SELECT k, 40.0::DOUBLE + 60 + CASE WHEN k % 2 = 0 THEN 20 ELSE 0 END AS sc FROM o WHERE n > 3 AND greatest(a, 5) <= least(b, 6))
    SELECT k AS chunk_id, sc AS structured_score FROM s ORDER BY sc DESC, k LIMIT 20""")
def visual_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ordered(spark, sf_dir).withColumns({"unit_type": F.when(F.col("unit_type") == "question_group", "flowchart").otherwise("passage"), "question_type": F.lit(None).cast("string"), "has_visual": F.col("chunk_id") % 2 == 0})
    return lookup.visual_lookup(rows, [(5, 6)], "flowchart", "flowchart_completion", 20).select("chunk_id", "structured_score")


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).where("chunk_id % 10 = 3").withColumn("text", F.lit("replacement")).select("document_id", "source_file", "text")


_INCOMING = "SELECT CAST(doc_id AS VARCHAR) AS document_id, source AS source_file, 'replacement' AS text FROM documents WHERE doc_id % 10 = 3"
_STORE = "SELECT CAST(doc_id AS VARCHAR) AS document_id, source AS source_file, text FROM documents"


@add(f"SELECT document_id, source_file, sha256(text) AS text_sha256 FROM ({_STORE} WHERE doc_id % 10 <> 3 UNION ALL {_INCOMING})")
def upsert_replace_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.upsert(chunks(spark, sf_dir).select("document_id", "source_file", "text"), _incoming(spark, sf_dir), "", by_document=True)
    return rows.select("document_id", "source_file", F.sha2("text", 256).alias("text_sha256"))


@add(f"SELECT document_id, source_file, sha256(text) AS text_sha256 FROM ({_STORE} WHERE source <> 'src8' UNION ALL SELECT NULL, 'src8', 'replacement')")
def upsert_replace_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = spark.createDataFrame([(None, "src8", "replacement")], "document_id string, source_file string, text string")
    rows = store.upsert(chunks(spark, sf_dir).select("document_id", "source_file", "text"), new, "src8", by_document=False)
    return rows.select("document_id", "source_file", F.sha2("text", 256).alias("text_sha256"))


@add("SELECT doc_id, source FROM documents WHERE source <> 'src9'")
def delete_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.delete_source(chunks(spark, sf_dir), "src9").select(F.col("chunk_id").alias("doc_id"), F.col("source_file").alias("source"))


@add(f"SELECT count(DISTINCT document_id) AS documents, count(*) AS chunks FROM ({_STORE} WHERE doc_id % 10 <> 3 UNION ALL {_INCOMING})")
def projected_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.projected_stats(chunks(spark, sf_dir), _incoming(spark, sf_dir), "", by_document=True)


@add("SELECT count(DISTINCT source) AS documents, count(*) AS chunks FROM documents")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.stats(chunks(spark, sf_dir).withColumn("document_id", F.lit("")))


@add("SELECT source AS session_id, count(DISTINCT doc_id) AS documents, count(*) AS chunks FROM documents GROUP BY source")
def fleet_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.stats(chunks(spark, sf_dir).withColumn("session_id", F.col("source_file")), "session_id")


@add("SELECT source AS session_id, count(*) AS documents, count(*) AS chunks, count(*) > 30 AS documents_exceeded, count(*) > 15000 AS chunks_exceeded, NOT (count(*) > 30 OR count(*) > 15000) AS accepted FROM documents GROUP BY source")
def quota_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.quota_guard(store.stats(chunks(spark, sf_dir).withColumn("session_id", F.col("source_file")), "session_id"))


@add("SELECT a.user_id, b.v - a.v AS delta FROM (SELECT user_id, count(*) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1) a JOIN (SELECT user_id, count(*) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1) b USING (user_id)")
def resource_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    a, b = (events.where(F.col("event_id") % 2 == i).groupBy("user_id").agg(F.count("*").alias("value")) for i in (0, 1))
    return store.resource_delta(a, b, "user_id")


_PAGES = "SELECT doc_id, source, n_chars, greatest(1, length(text) // 4) AS token_count, doc_id % 7 AS page FROM documents"


@add(f"""WITH d AS ({_PAGES}), c AS (SELECT * FROM d WHERE token_count >= 80 OR (SELECT count(*) FROM d WHERE token_count >= 80) = 0)
    SELECT doc_id AS chunk_id, 'overview_fallback' AS retrieval_method, 1.0::DOUBLE AS structured_score FROM c ORDER BY page, doc_id LIMIT 8""")
def overview_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).withColumns({"pages": F.array(F.col("chunk_id") % 7), "token_count": F.greatest(F.lit(1), F.floor(F.length("text") / 4)), "passage_number": F.lit(None).cast("int")})
    return lookup.overview(rows, 8).select("chunk_id", "retrieval_method", "structured_score")


@add("""WITH d AS (SELECT doc_id, source, lang, doc_id % 3 AS passage FROM documents),
    o AS (SELECT doc_id, 'overview' AS m, 1.0::DOUBLE AS s, 0 AS tier FROM d WHERE lang = 'es' ORDER BY doc_id LIMIT 12),
    p AS (SELECT min(doc_id) AS doc_id, 'overview_passage' AS m, 0.8::DOUBLE AS s, 1 AS tier FROM d WHERE lang = 'en' GROUP BY source, passage)
    SELECT doc_id AS chunk_id, m AS retrieval_method, s AS structured_score FROM (SELECT * FROM o UNION ALL SELECT * FROM p) ORDER BY tier, doc_id LIMIT 12""")
def overview_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("unit_type") == "es", "document_outline").when(F.col("unit_type") == "en", "passage").otherwise("question")
    rows = chunks(spark, sf_dir).withColumns({"document_id": F.col("source_file"), "passage_number": F.col("chunk_id") % 3, "unit_type": unit, "pages": F.array(F.lit(1)), "token_count": F.lit(1)})
    return lookup.overview(rows, 12).select("chunk_id", "retrieval_method", "structured_score")


@add("SELECT doc_id AS chunk_id, lang AS unit_type, 'structured_unit' AS retrieval_method FROM documents WHERE lang IN ('de', 'fr') ORDER BY doc_id LIMIT 30")
def unit_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.unit_lookup(chunks(spark, sf_dir), ["de", "fr"], 30).select("chunk_id", "unit_type", "retrieval_method")


@add("SELECT doc_id AS chunk_id, 'explicit_scope' AS retrieval_method FROM documents WHERE CAST(doc_id AS VARCHAR) IN ('4', '7', '19', '30') ORDER BY doc_id LIMIT 3")
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.document_chunks(chunks(spark, sf_dir), 3, ["4", "7", "19", "30"]).select("chunk_id", "retrieval_method")


@add("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn <= 3")
def first_n_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.first_per_key(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], 3).select("conv_id", "turn", "role")


@add("SELECT min(doc_id) AS doc_id, sha256(text) AS text_sha256 FROM documents GROUP BY text")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    return lookup.dedupe_first(rows, ["text_sha256"], "doc_id")


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as groups, their lines as questions."""
    columns = {"document_id": F.lit("d"), "range_start": F.col("o_orderkey").cast("int"), "range_end": F.col("o_orderkey").cast("int")}
    groups = table(spark, sf_dir, "orders").select(F.concat(F.lit("d-"), F.col("o_orderkey").cast("string")).alias("chunk_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("question_group").alias("unit_type"), F.col("o_orderkey").alias("chunk_index"), *(v.alias(k) for k, v in columns.items()))
    lines = table(spark, sf_dir, "lineitem").withColumn("o_orderkey", F.col("l_orderkey")).select(
        F.concat(F.lit("d-"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("chunk_id"), F.col("l_orderkey").cast("string").alias("parent_id"), F.lit("question").alias("unit_type"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_index"), *(v.alias(k) for k, v in columns.items()),
    )
    return groups.unionByName(lines).withColumn("position", F.col("chunk_index"))


@add("""WITH w AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 1)
    SELECT DISTINCT 'd-' || CAST(o_orderkey AS VARCHAR) AS chunk_id, 'parent_question_group' AS retrieval_method FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM w)""")
def parent_child_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tree(spark, sf_dir)
    sources = rows.where("unit_type = 'question' and chunk_id like '%-1'")
    return lookup.question_context(sources, rows, None).select("chunk_id", "retrieval_method")


@add("""SELECT 'd-' || CAST(o_orderkey AS VARCHAR) AS chunk_id, 'parent_question_group' AS retrieval_method FROM orders
    UNION SELECT 'd-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR), 'child_question' FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)""")
def child_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tree(spark, sf_dir)
    return lookup.question_context(rows.where("unit_type = 'question_group'"), rows, None).select("chunk_id", "retrieval_method").distinct()


@add("""SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role = 'assistant' AND conv_id IN (SELECT conv_id FROM conversations WHERE role = 'user' AND turn = 1)) WHERE rn <= 3""")
def passage_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lit("d").alias("document_id"), (F.col("conv_id") + 1).alias("passage_number"), F.col("turn").alias("chunk_index"), F.col("turn").alias("position"))
    sources = turns.where("role = 'user' and turn = 1")
    found = lookup.passage_context(sources, turns.where("role = 'assistant'").withColumn("unit_type", F.lit("passage")))
    return found.select("conv_id", "turn")


@add("""WITH f AS (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2 ORDER BY l_orderkey LIMIT 1)
    SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT * FROM f) ORDER BY l_linenumber LIMIT 4""")
def sibling_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit("d").alias("document_id"), F.col("l_orderkey").cast("string").alias("parent_id"), F.lit("writing_task").alias("unit_type"), F.col("l_linenumber").alias("chunk_index"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))
    return lookup.sibling_context(lines.where("l_linenumber = 2"), lines).select("l_orderkey", "l_linenumber")


_M = "lambda m: contains(low, m)"


@add(f"""WITH t AS (SELECT conv_id, turn, lower(text) AS low FROM conversations)
    SELECT conv_id, turn, len(list_filter({quoted(search.DOCUMENT_MARKERS)}, {_M})) > 0 AS document_intent,
           len(list_filter({quoted(search.OVERVIEW_MARKERS)}, {_M})) > 0 OR (len(list_filter({quoted(search.CONTENT_WORDS)}, {_M})) > 0 AND len(list_filter({quoted(search.DOCUMENT_WORDS)}, {_M})) > 0 AND len(list_filter({quoted(search.REFERENCE_WORDS)}, {_M})) > 0) AS overview FROM t""")
def query_classifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", search.has_document_intent(F.col("text")).alias("document_intent"), search.is_overview_query(F.col("text")).alias("overview"))
