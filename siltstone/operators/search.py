"""Retrieval over a chunk table: filtered dense top-k, lexical top-k, numbered ranges, reciprocal-rank fusion.

A chunk table has chunk_id, position (its place in the store, the last tiebreak everywhere) and whatever an operator
reads: text, retrieval_text, embedding, document_id, unit_type, passage_number, range_start, range_end. Queries are
parameters. Filters are plain predicates below the scores, so they reach the scan; a top-k is an ordered limit, which
Spark runs as a heap in each task.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import header_ranges, overlap_size, overlaps, ranges_of
from ..functions.text import query_terms, search_terms

RRF_K = 60
MIN_SCORE = 0.45
HYBRID_MIN_SCORE = 0.35
MOST = 50


def candidates(chunks: DataFrame, document_ids: list | None = None, unit_types: list | None = None, passage_numbers: list | None = None) -> DataFrame:
    """No ids given: all; an empty list of ids: nothing; empty units or passages: all."""
    if document_ids is not None and not document_ids:
        return chunks.limit(0)
    if document_ids:
        chunks = chunks.where(F.col("document_id").isin(document_ids))
    if unit_types:
        chunks = chunks.where(F.col("unit_type").isin(unit_types))
    if passage_numbers:
        chunks = chunks.where(F.col("passage_number").isin(passage_numbers))
    return chunks


def dot(vector: Column, query: list[float]) -> Column:
    """In doubles, so that engines agree."""
    given = F.lit([float(x) for x in query])
    products = F.zip_with(vector, given, lambda a, b: a.cast("double") * b)
    return F.aggregate(products, F.lit(0.0), lambda a, b: a + b)


def dense_search(chunks: DataFrame, query: list[float], top_k: int = 5, min_score: float = MIN_SCORE, **scope) -> DataFrame:
    """Adds score; the best top_k of at least min_score, ties in store order."""
    scored = candidates(chunks, **scope).withColumn("score", dot(F.col("embedding"), query))
    return scored.where(F.col("score") >= min_score).orderBy(F.desc("score"), "position").limit(min(max(top_k, 1), MOST))


#: Queries of a batch that are sent to every task at a time.
QUERY_BLOCK = 1024


def dense_search_batch(chunks: DataFrame, queries: DataFrame, top_k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """queries: query_id, query_embedding; a stated set. Adds query_id, score, rank.

    The set is gone through in blocks of about `block` queries, by a hash of the id, so what is sent to the tasks at a
    time has that bound whatever the set's size. Each task keeps its own best before the ranking: what is shuffled is
    tasks x queries x top_k rows.
    """
    blocks = -(-queries.count() // block)
    score = F.aggregate(F.zip_with("embedding", "query_embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, b: a + b)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "position")
    out = chunks.withColumns({"query_id": F.lit(None).cast(queries.schema["query_id"].dataType), "score": F.lit(0.0), "rank": F.lit(0)}).limit(0)
    for k in range(blocks):
        some = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
        pairs = chunks.join(F.broadcast(some)).withColumn("score", score).drop("query_embedding")
        out = out.unionByName(pairs.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top_k))
    return out


def keyword_score(text: Column, query: str) -> Column:
    """Query terms found in the text, each as often as the query has it, and 2 if the whole query occurs in it.

    The text is lower-cased once and not split: a term is looked for as a substring first, and as a whole word only
    where it is one.
    """
    counts = Counter(query_terms(query))
    if not counts:
        return F.lit(0.0)

    def score(low: Column) -> Column:
        out = F.when(F.contains(low, F.lit(query.lower())), 2).otherwise(0)
        for term, n in counts.items():
            whole = F.regexp_like(low, F.lit(rf"(?<![\p{{L}}\p{{N}}_])\Q{term}\E(?![\p{{L}}\p{{N}}_])"))
            out = out + F.when(F.contains(low, F.lit(term)) & whole, n).otherwise(0)
        return out.cast("double")

    return F.get(F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), score), F.lit(0))


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """withColumn, but worked out once a row: a filter on the column is not pushed below, where it would work it out
    again."""
    return rows.withColumn(name, F.explode(F.array(value)))


def keyword_search(chunks: DataFrame, query: str, top_k: int = 5, **scope) -> DataFrame:
    text = F.coalesce(F.nullif(F.col("retrieval_text"), F.lit("")), F.col("text")) if "retrieval_text" in chunks.columns else F.col("text")
    if not query_terms(query):
        return chunks.limit(0).withColumn("keyword_score", F.lit(0.0))
    scored = once(candidates(chunks, **scope), "keyword_score", keyword_score(text, query))
    return scored.where("keyword_score > 0").orderBy(F.desc("keyword_score"), "position").limit(top_k)


def keyword_scores(chunks: DataFrame, queries: DataFrame, text: str = "text") -> DataFrame:
    """queries: query_id, query. keyword_score of every chunk for every query that has a term or the whole query in it,
    by joins on terms: query_id, chunk_id, position, score. Query ids are unique. Equi-joins with partial sums; no chunk meets a query that
    it shares nothing with."""
    wanted = queries.select("query_id", F.explode(search_terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("n"))
    own = chunks.select("chunk_id", "position", F.explode(F.array_distinct(search_terms(F.col(text)))).alias("term"))
    shared = own.join(wanted, "term").groupBy("query_id", "chunk_id", "position").agg(F.sum("n").alias("score"))
    lowered = lambda x: F.lower(F.coalesce(F.col(x), F.lit("")))
    whole = containing(chunks.select("chunk_id", lowered(text).alias("source")), "chunk_id", queries.select("query_id", lowered("query").alias("part")), "query_id", "part")
    phrase = whole.join(chunks.select("chunk_id", "position"), "chunk_id").select("query_id", "chunk_id", "position", F.lit(2).cast("long").alias("score"))
    # a query without terms scores nothing, whatever contains it
    phrase = phrase.join(wanted.select("query_id").distinct(), "query_id", "left_semi")
    return shared.unionByName(phrase).groupBy("query_id", "chunk_id", "position").agg(F.sum("score").cast("double").alias("score"))


#: Inner words of a part that are its key.
KEY_WORDS = 3


def containing(sources: DataFrame, key: str, parts: DataFrame, part_key: str, part: str) -> DataFrame:
    """sources: key, source; parts: part_key, part. Pairs (key, part_key) where the source contains the part.

    Words stand between single characters that are neither letters nor digits. A part's inner words stand whole in any
    text that contains it, so up to KEY_WORDS of them, after the first, are a key: an equi-join on hashed keys finds
    candidates, and the strings are compared only for those. Parts of one or two words have no inner word; they are a
    stated few, compared with every source.
    """
    words = lambda x: F.regexp_extract_all(F.col(x), F.lit(r"([\p{L}\p{N}]+)"), 1)
    split = parts.select(part_key, part, words(part).alias("__w"))
    keyed = split.where(F.size("__w") > 2).withColumn("__n", F.least(F.lit(KEY_WORDS), F.size("__w") - 2)).withColumn("__h", F.xxhash64(F.array_join(F.slice("__w", F.lit(2), F.col("__n")), " ")))
    lengths = [r["__n"] for r in keyed.select("__n").distinct().collect()]  # at most KEY_WORDS
    own = sources.withColumn("__w", words("source"))
    out = None
    for n in lengths:
        at = F.when(F.size("__w") >= n, F.sequence(F.lit(1), F.size("__w") - n + 1)).otherwise(F.array().cast("array<int>"))
        hashes = F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(F.col("__w"), i, n), " "))))  # noqa: B023
        grams = own.select(key, F.explode(hashes).alias("__h"))
        found = grams.join(keyed.where(F.col("__n") == n).select(part_key, "__h"), "__h").select(key, part_key)
        out = found if out is None else out.unionByName(found)
    short = split.where((F.size("__w") <= 2) & (F.col(part) != "")).select(part_key, part)
    near = None if out is None else out.distinct().join(parts.select(part_key, part), part_key).join(sources, key).where(F.contains("source", F.col(part))).select(key, part_key)
    few = None if short.isEmpty() else sources.join(short, F.contains(F.col("source"), F.col(part))).select(key, part_key)
    both = [x for x in (near, few) if x is not None]
    if not both:
        return sources.join(parts.limit(0).select(part_key), F.lit(False)).select(key, part_key)
    return both[0] if len(both) == 1 else both[0].unionByName(both[1])


def question_score(ranges: list[tuple[int, int]], start: Column, end: Column, unit: Column, text: Column) -> tuple[Column, Column, Column]:
    """Scores by the chunk's own range, by headers in its text, and by single numbers in it."""
    own, header, numbers = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    lowered = F.lower(F.coalesce(text, F.lit("")))
    for a, b in ranges:
        x, y = F.lit(a), F.lit(b)
        exact = F.when((start == a) & (end == b), 20.0).otherwise(0.0)
        by_unit = F.when(unit == "question_group", 8.0).when(unit == "question", 4.0).otherwise(0.0)
        own = own + F.when(overlaps(x, y, start, end), 30.0 + overlap_size(x, y, start, end) + exact + by_unit).otherwise(0.0)
        header = header + F.aggregate(
            F.filter(header_ranges(text), lambda r: overlaps(x, y, r["start"], r["end"])),  # noqa: B023
            F.lit(0.0),
            lambda s, r: s + 20.0 + F.when((r["start"] == x) & (r["end"] == y), 4.0).otherwise(0.0),  # noqa: B023
        )
        for n in range(a, b + 1):
            numbers = numbers + F.when(lowered.rlike(rf"(?<!\d){n}\s*[.)]") | F.contains(lowered, F.lit(f"({n})")), 1.0).otherwise(0.0)
    return own, header, numbers


def question_range_search(chunks: DataFrame, query: str, top_k: int = 5, document_ids: list | None = None) -> DataFrame:
    """Chunks that a query's numbered ranges name. Those that only mention a number count if no other does."""
    ranges = ranges_of(query)
    if not ranges:
        return chunks.limit(0).withColumn("question_score", F.lit(0.0))
    own, header, numbers = question_score(ranges, F.col("range_start"), F.col("range_end"), F.col("unit_type"), F.col("text"))
    scored = candidates(chunks, document_ids).withColumns({"__named": own + header, "question_score": own + header + numbers}).where("question_score > 0")
    best = scored.orderBy(F.desc(F.col("__named") > 0), F.desc("question_score"), "position").limit(top_k)
    # of at most top_k rows
    return best.withColumn("__any", F.max(F.col("__named") > 0).over(Window.partitionBy(F.lit(0)))).where(~F.col("__any") | (F.col("__named") > 0)).drop("__named", "__any")


METHODS = {"dense": "score", "keyword": "keyword_score", "question": "question_score"}


def fuse(top_k: int, **lists: DataFrame) -> DataFrame:
    """lists: dense, keyword, question; each chunk_id, position and its method's score, at most a few dozen rows.
    Returns chunk_id, rrf_score, the three scores (0 where absent) and methods, best first."""
    ranked = None
    for n, (method, score) in enumerate(METHODS.items()):
        if method not in lists:
            continue
        order = Window.partitionBy(F.lit(0)).orderBy(F.desc(score), "position")
        one = lists[method].select(
            "chunk_id", "position", F.lit(n).alias("n"), F.lit(method).alias("method"), F.row_number().over(order).alias("rank"),
            *(F.col(score).cast("double").alias(f"{m}_score") if m == method else F.lit(0.0).alias(f"{m}_score") for m in METHODS),
        )
        ranked = one if ranked is None else ranked.unionByName(one)
    if ranked is None:
        raise ValueError("no ranked list given")
    fused = ranked.groupBy("chunk_id").agg(
        F.sum(1.0 / (F.lit(float(RRF_K)) + F.col("rank"))).alias("rrf_score"),
        *(F.max(f"{m}_score").alias(f"{m}_score") for m in METHODS),
        F.transform(F.array_sort(F.collect_set(F.struct("n", "method"))), lambda x: x["method"]).alias("methods"),
        F.min(F.struct("n", "rank")).alias("first"),
    )
    return fused.orderBy(F.desc("rrf_score"), F.desc("question_score"), F.desc("keyword_score"), F.desc("dense_score"), "first").limit(top_k).drop("first")


def hybrid_search(chunks: DataFrame, query: str, vector: list[float], top_k: int = 5, **scope) -> DataFrame:
    """Dense and lexical candidates, twice top_k each (50 at most), fused by reciprocal rank."""
    k = min(top_k * 2, MOST)
    return fuse(top_k, dense=dense_search(chunks, vector, k, HYBRID_MIN_SCORE, **scope), keyword=keyword_search(chunks, query, k, **scope))


def probe(chunks: DataFrame, query: str, vector: list[float] | None, top_k: int = 3, document_ids: list | None = None) -> DataFrame:
    """Dense, lexical and range candidates fused, with strong: whether any hit is strong enough to answer from."""
    k = min(max(top_k * 2, top_k), MOST)
    lists = {"keyword": keyword_search(chunks, query, k, document_ids=document_ids), "question": question_range_search(chunks, query, k, document_ids)}
    if vector is not None:
        lists["dense"] = dense_search(chunks, vector, k, HYBRID_MIN_SCORE, document_ids=document_ids)
    strong = (F.col("keyword_score") >= 2) | (F.col("question_score") >= 1) | (F.col("dense_score") >= MIN_SCORE)
    return fuse(top_k, **lists).withColumn("strong", strong)


def has_lexical_hit(sources: DataFrame) -> DataFrame:
    """One row: whether any source has a lexical or range score."""
    return sources.agg(F.coalesce(F.bool_or((F.col("keyword_score") > 0) | (F.col("question_score") > 0)), F.lit(False)).alias("has_lexical_hit"))


#: Words by which a query asks for documents, and for their overview.
DOCUMENT_MARKERS = ["tài liệu", "file", "pdf", "docx", "trong bài", "bài đọc", "passage", "question", "questions", "câu hỏi", "trang", "page", "bảng", "table", "flow", "nội dung", "ảnh", "hình", "image", "writing", "task 1", "task 2", "đề trên", "đề writing", "tỷ lệ", "giá trị", "số liệu", "có nhắc đến", "đã tải", "uploaded"]
OVERVIEW_MARKERS = ["nội dung tài liệu", "nội dung của tài liệu", "nội dung tài liệu trên", "nội dung file", "nội dung của file", "tài liệu là gì", "tài liệu trên là gì", "tài liệu này là gì", "tài liệu này nói gì", "tài liệu trên nói gì", "file này là gì", "file trên là gì", "pdf này là gì", "pdf trên là gì", "tóm tắt tài liệu", "tổng quan tài liệu", "summary of the document", "summarize the document"]
CONTENT_WORDS, DOCUMENT_WORDS, REFERENCE_WORDS = ["nội dung", "tóm tắt", "tổng quan"], ["tài liệu", "file", "pdf", "document"], ["này", "trên", "đó", "uploaded", "đã tải"]


def mentions(text: Column, markers: list[str]) -> Column:
    """Whether the lower-cased text has any of them."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(lowered, m))


def has_document_intent(query: Column) -> Column:
    return mentions(query, DOCUMENT_MARKERS)


def is_overview_query(query: Column) -> Column:
    return mentions(query, OVERVIEW_MARKERS) | (mentions(query, CONTENT_WORDS) & mentions(query, DOCUMENT_WORDS) & mentions(query, REFERENCE_WORDS))
