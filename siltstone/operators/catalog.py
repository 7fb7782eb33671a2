"""Catalog of documents: aggregation over chunks, weights, scores, ranking, and the scope that a message names."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, normalize_reference, normalize_reference_text
from .store import document_key

#: Weights of the metadata fields, thresholds of scope resolution, and sizes of descriptors.
FIELD_WEIGHTS = {"document_types": 18.0, "task_types": 24.0, "visual_types": 18.0, "table_columns": 28.0, "target_descriptors": 22.0, "unit_types": 8.0, "mime_types": 8.0}
MIN_MATCH, MARGIN, DISTINCTIVE, PHRASE_BONUS, MODALITY = 60.0, 10.0, 1.15, 0.35, 180.0
DESCRIPTOR_CHARS, CATALOG_CHARS, ENTRY_CHARS = 220, 3000, 360
IMAGE_SUFFIX = r"(?i)\.(bmp|gif|jpe?g|png|tiff?|webp)$"


def catalog(chunks: DataFrame, sets: dict[str, str]) -> DataFrame:
    """One row per document: chunks, sorted sets of the named columns (empty values skipped), newest ingested_at,
    last position, recency (0 the newest: with a time first, then by time, then by position)."""
    skip = lambda c: F.when(F.col(c).cast("string").isin("", "0"), None).otherwise(F.col(c))
    entries = chunks.groupBy(document_key().alias("document_key")).agg(
        F.count("*").alias("chunks"), F.min_by("source_file", "position").alias("source_file"), *(F.array_sort(F.collect_set(skip(c))).alias(name) for name, c in sets.items()),
        F.coalesce(F.max("ingested_at"), F.lit("")).alias("ingested_at"), F.max("position").alias("last_position"),
    )
    return entries


def by_recency(entries: DataFrame) -> DataFrame:
    """A catalog in order; its rank is worked out where it is read, after a limit if there is one."""
    return entries.orderBy(F.desc(F.col("ingested_at") != ""), F.desc("ingested_at"), F.desc("last_position"))


def ordered_unique(values: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """For each key the values without regard to case, in order, each in its first spelling."""
    rows = values.withColumn("__v", collapse(F.col(value).cast("string"))).where("__v <> ''")
    first = rows.groupBy(*keys, F.lower("__v").alias("__low")).agg(F.min(F.struct(F.col(position).alias("p"), F.col("__v").alias("v"))).alias("x"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias(value))


def target_descriptor(text: Column, sentences: int = 1, limit: int = DESCRIPTOR_CHARS) -> Column:
    """The first sentences, cut to the limit with three dots."""
    flat = collapse(text)
    ended = F.regexp_extract(flat, rf"^((?:.*?[.!?](?=\s|$)){{1,{sentences}}})", 1)
    out = F.trim(F.when(ended == "", flat).otherwise(ended))
    return F.when(F.length(out) > limit, F.concat(F.rtrim(F.substring(out, 1, limit - 3)), F.lit("..."))).otherwise(out)


def inherit_descriptors(tasks: DataFrame, answers: DataFrame) -> DataFrame:
    """Untitled tasks take the first descriptor of an answer with the same document and parent."""
    first = answers.where("descriptor <> ''").groupBy("document_id", "parent_id").agg(F.min_by("descriptor", "position").alias("inherited"))
    return tasks.join(first, ["document_id", "parent_id"], "left")


def token_weights(values: DataFrame, key: str, text: str) -> DataFrame:
    """values: one row a value. weight = 1 + ln((N + 1) / (df + 1)) over distinct (key, token); N counts the keys
    that have a token. The total comes as a column, so weights need no second scan."""
    tokens = values.select(key, F.explode(F.array_distinct(F.split(F.col(text), " "))).alias("token")).where("token <> ''").distinct()
    total = values.where(F.col(text) != "").agg(F.countDistinct(key).alias("n"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("df"))
    return counts.join(F.broadcast(total)).select("token", "df", (1.0 + F.log((F.col("n") + 1.0) / (F.col("df") + 1.0))).alias("weight"))


def longest_contiguous(query: list[str], tokens: Column) -> Column:
    """The longest run of the query's tokens that the array has. The runs are the query's, so their number is fixed."""
    padded = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    runs = sorted({(i - j, " ".join(query[j:i])) for j in range(len(query)) for i in range(j + 1, len(query) + 1)})
    if not runs:
        return F.lit(0)
    found = F.filter(F.array(*(F.struct(F.lit(n).alias("n"), F.contains(padded, F.lit(f" {run} ")).alias("has")) for n, run in runs)), lambda r: r["has"])
    return F.coalesce(F.array_max(found)["n"], F.lit(0))


def field_score(message: str, values: DataFrame, weights: DataFrame, key: list[str], text: str, field_weight: Column | float) -> DataFrame:
    """values: key, normalised text. For each key the best value's weighted coverage by the message, and a bonus if
    the whole value is in it."""
    query = normalize_reference_text(message)
    terms = F.array(*map(F.lit, sorted(set(query.split())))).cast("array<string>")
    rows = values.where(F.col(text) != "").select(*key, text).distinct()
    tokens = rows.select(*key, text, F.explode(F.array_distinct(F.split(F.col(text), " "))).alias("token")).join(weights.select("token", "weight"), "token", "left")
    weight = F.coalesce("weight", F.lit(1.0))
    scored = tokens.groupBy(*key, text).agg(F.sum(weight).alias("all"), F.sum(F.when(F.array_contains(terms, F.col("token")), weight)).alias("hit")).where("hit is not null")
    bonus = F.when(F.contains(F.lit(query), F.col(text)), PHRASE_BONUS).otherwise(0.0)
    w = field_weight if isinstance(field_weight, Column) else F.lit(float(field_weight))
    return scored.groupBy(*key).agg(F.max(w * (F.col("hit") / F.greatest(F.lit(1.0), F.col("all")) + bonus)).alias("score"))


def filename_scores(message: str, files: DataFrame, source_file: str = "source_file") -> DataFrame:
    """Adds filename_score: 240 for the whole stem in the message; 0 if both have numbers and share none; else for a shared phrase of three
    words or more 160 and the shared terms, their share of the stem's, and 20 a word of the phrase."""
    query = normalize_reference_text(message)
    words = query.split()
    files = files.withColumn("__stem", normalize_reference(F.regexp_replace(F.regexp_replace(source_file, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")))
    stem = F.col("__stem")
    tokens = F.split(stem, " ")
    own = F.array(*map(F.lit, sorted(set(words)))).cast("array<string>")
    shared = F.size(F.array_intersect(F.array_distinct(tokens), own))
    numbers = F.array(*map(F.lit, sorted({w for w in words if w.isdigit()}))).cast("array<string>")
    file_numbers = F.filter(tokens, lambda t: t.rlike(r"^\d+$"))
    no_number = (F.size(numbers) > 0) & (F.size(file_numbers) > 0) & ~F.arrays_overlap(numbers, file_numbers)
    phrase = longest_contiguous(words, tokens)
    whole = F.contains(F.lit(f" {query} "), F.concat(F.lit(" "), stem, F.lit(" ")))
    score = 160.0 + shared + shared / F.greatest(F.lit(1), F.size(F.array_distinct(tokens))) + phrase * 20.0
    return files.withColumn("filename_score", F.when(stem == "", 0.0).when(whole, 240.0).when(no_number | (phrase < 3), 0.0).otherwise(score)).drop("__stem")


def title_score(message: str, titles: DataFrame, weights: DataFrame, key: str, text: str) -> DataFrame:
    """titles: key, normalised title. For each key the best of its titles: 140 and its words if the message has all of
    it, else by weighted coverage, phrase, distinctive terms and numbers, if they suffice."""
    query = normalize_reference_text(message)
    words = query.split()
    terms = F.array(*map(F.lit, sorted(set(words)))).cast("array<string>")
    rows = titles.where(F.col(text) != "").select(key, text).distinct()
    tokens = rows.select(key, text, F.explode(F.array_distinct(F.split(F.col(text), " "))).alias("token")).join(weights.select("token", "weight"), "token", "left")
    weight, hit = F.coalesce("weight", F.lit(1.0)), F.array_contains(terms, F.col("token"))
    sums = tokens.groupBy(key, text).agg(
        F.sum(weight).alias("all"), F.coalesce(F.sum(F.when(hit, weight)), F.lit(0.0)).alias("matched"), F.count_if(hit).alias("hits"),
        F.count_if(hit & (weight > DISTINCTIVE)).alias("distinctive"), F.count_if(hit & F.col("token").rlike(r"^\d+$")).alias("numbers"),
    )
    run = longest_contiguous(words, F.split(F.col(text), " "))
    coverage = F.col("matched") / F.greatest(F.lit(1.0), F.col("all"))
    n = F.size(F.split(F.col(text), " "))
    whole = F.contains(F.lit(query), F.col(text)) & ((n >= 2) | (F.length(text) >= 5))
    enough = (run >= 3) | (coverage >= 0.6) | ((run >= 2) & ((coverage >= 0.28) | (F.col("distinctive") >= 2)))
    score = 35.0 + coverage * 70.0 + run * 10.0 + F.col("distinctive") * 4.0 + F.col("numbers") * 4.0
    return sums.select(key, F.when(whole, 140.0 + n).when((F.col("hits") >= 2) & enough, score).otherwise(0.0).alias("s")).groupBy(key).agg(F.max("s").alias("score"))


def modalities(message: str) -> set[str]:
    words = re.findall(r"\w+", unicodedata.normalize("NFC", message.casefold()))
    found = set()
    image = any(w == "ảnh" and words[i + 1 : i + 2] != ["hưởng"] for i, w in enumerate(words))
    if image or {"image", "photo", "picture", "screenshot"} & set(words):
        found.add("image")
    if "pdf" in words:
        found.add("pdf")
    return found


def modality_score(message: str, mime_types: Column, source_file: Column) -> Column:
    asked = modalities(message)
    mime = F.transform(mime_types, F.lower)
    has = F.lit(False)
    if "image" in asked:
        has = has | F.exists(mime, lambda m: F.startswith(m, F.lit("image/"))) | source_file.rlike(IMAGE_SUFFIX)
    if "pdf" in asked:
        has = has | F.array_contains(mime, "application/pdf") | source_file.rlike(r"(?i)\.pdf$")
    return F.when(has, MODALITY).otherwise(0.0)


def rank_candidates(scored: DataFrame, most: int, preferred: list | None = None, key: str = "document_key") -> DataFrame:
    """Best score first, then preferred ones, then the newest (recency ascending)."""
    prefer = F.col(key).isin(preferred) if preferred else F.lit(False)
    return scored.orderBy(F.desc("score"), F.desc(prefer), "recency").limit(max(0, most))


def resolve_scope(scored: DataFrame, requested: list | None = None, mode: str = "auto", key: str = "document_key") -> DataFrame:
    """scored: key, score, of the allowed entries. One row: method and resolved (keys). The best entry is taken if it
    reaches MIN_MATCH and leads by MARGIN."""
    allowed = scored.where(F.col(key).isin(requested)) if requested else scored
    figures = allowed.agg(F.count("*").alias("n"), F.min(key).alias("only"), F.slice(F.sort_array(F.collect_list(F.when(F.col("score") > 0, F.struct("score", key))), asc=False), 1, 2).alias("top")) if requested else _top_two(allowed, key)
    first = F.get("top", F.lit(0))
    second = F.coalesce(F.get("top", F.lit(1))["score"], F.lit(0.0))
    unique = (F.size("top") > 0) & (first["score"] >= MIN_MATCH) & ((F.size("top") == 1) | (first["score"] - second >= MARGIN))
    one = "explicit_single" if mode == "explicit" else "requested_single" if requested else "catalog_single"
    method = F.when(F.lit(bool(requested)) & (F.col("n") == 0), "invalid_requested_scope").when(unique, "catalog_reference").when(F.col("n") == 1, one).when(F.lit(mode == "explicit") & (F.col("n") > 1), "explicit_multiple").otherwise("unresolved")
    none = F.array().cast("array<string>")
    return figures.select(method.alias("method"), F.when(unique, F.array(first[key].cast("string"))).when(F.col("n") == 1, F.array(F.col("only").cast("string"))).otherwise(none).alias("resolved"))


def _top_two(scored: DataFrame, key: str) -> DataFrame:
    """Two rows from an ordered limit, and the count; nothing larger meets in one task."""
    best = scored.where("score > 0").orderBy(F.desc("score"), key).limit(2).agg(F.sort_array(F.collect_list(F.struct("score", key)), asc=False).alias("top"))
    return scored.agg(F.count("*").alias("n"), F.min(key).alias("only")).join(F.broadcast(best))


def value_order(message: str, values: DataFrame, text: str, position: str) -> DataFrame:
    """Adds whole (the value is in the message), run, shared: the most relevant values come first by them."""
    query = normalize_reference_text(message)
    words = query.split()
    values = values.withColumn("__value", normalize_reference(F.col(text)))
    value = F.col("__value")
    tokens = F.split(value, " ")
    shared = F.size(F.array_intersect(F.array_distinct(tokens), F.array(*map(F.lit, sorted(set(words)))).cast("array<string>")))
    rows = values.withColumns({"whole": ((value != "") & F.contains(F.lit(query), value)).cast("int"), "run": longest_contiguous(words, tokens), "shared": shared})
    return rows.drop("__value").orderBy(F.desc("whole"), F.desc("run"), F.desc("shared"), position)


def within_budget(rows: DataFrame, order: list, length: Column, budget: int, partition: list[str]) -> DataFrame:
    """The longest prefix of each partition whose lengths fit; partitions are small."""
    running = F.sum(length).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__sum", running).where(F.col("__sum") <= budget).drop("__sum")


def catalog_scores(message: str, entries: DataFrame, titles: DataFrame, weights: DataFrame, key: str, title: str) -> DataFrame:
    """entries: key, source_file, mime_types; titles: key and normalised titles. The sum of a file's name, kind and
    title scores as `score`."""
    named = filename_scores(message, entries).withColumn("__m", modality_score(message, F.col("mime_types"), F.col("source_file")))
    by_title = title_score(message, titles, weights, key, title).withColumnRenamed("score", "__t")
    rows = named.join(by_title, key, "left")
    return rows.withColumn("score", F.col("filename_score") + F.col("__m") + F.coalesce("__t", F.lit(0.0))).drop("__m", "__t")


#: What a catalog's text begins with, and what is asked where several documents fit.
CATALOG_HEAD, NO_CATALOG = "Most relevant uploaded document candidates:", "Available uploaded documents: none"
FITTING = "Các file phù hợp nhất:"


def rendered(entries: DataFrame, message: str, key: str, rank: str, fields: dict[str, str], entry_chars: int = ENTRY_CHARS, all_chars: int = CATALOG_CHARS) -> DataFrame:
    """The candidates of a message as lines of text: key, reference (D and the rank), line. Of each field's values, the
    most relevant first, as many are shown as fit the entry; entries are shown up to the first that does not fit all."""
    rows = entries.withColumn("reference", F.concat(F.lit("D"), F.col(rank).cast("string")))
    line = F.concat(F.lit("- "), F.col("reference"), F.lit(": "), F.coalesce("source_file", F.lit("unknown")))
    for label, column in fields.items():
        line = _with_field(line, label, relevant_first(message, F.col(column)), entry_chars)
    rows = rows.withColumn("line", line)
    w = Window.partitionBy(F.lit(0)).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)  # of the few candidates of a message
    total = F.sum(F.length("line") + 1).over(w) + len(CATALOG_HEAD)
    return rows.withColumn("__total", total).where(F.col("__total") <= all_chars).select(key, "reference", "line")


def _with_field(line: Column, label: str, values: Column, most: int) -> Column:
    """The line with the longest prefix of the values that keeps it within its size."""
    said = lambda n: F.concat(line, F.lit(f" | {label}="), F.array_join(F.slice(values, F.lit(1), n), "; "))
    fits = F.size(F.filter(F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values))).otherwise(F.array().cast("array<int>")), lambda n: F.length(said(n)) <= most))
    return F.when(fits > 0, said(fits)).otherwise(line)


def relevant_first(message: str, values: Column) -> Column:
    """value_order() within an array: whole values first, then the longest run, then shared words; stable."""
    query = normalize_reference_text(message)
    words = query.split()
    own = F.array(*map(F.lit, sorted(set(words)))).cast("array<string>")

    def rank(v: Column, i: Column) -> Column:
        plain = _plain_reference(v)
        tokens = F.split(plain, " ")
        whole = ((plain != "") & F.contains(F.lit(query), plain)).cast("int")
        return F.struct((-whole).alias("a"), (-longest_contiguous(words, tokens)).alias("b"), (-F.size(F.array_intersect(F.array_distinct(tokens), own))).alias("c"), i.alias("i"), v.alias("v"))

    return F.transform(F.array_sort(F.transform(values, rank)), lambda x: x["v"])


def _plain_reference(value: Column) -> Column:
    """normalize_reference without a Python step, for metadata in ASCII and Latin letters."""
    marked, bare = "àáảãạâầấẩẫậăằắẳẵặèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ", "aaaaaaaaaaaaaaaaaeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyy"
    return F.array_join(F.regexp_extract_all(F.translate(F.lower(value), marked, bare), F.lit("([a-z0-9]+)"), 1), " ")


def resolve_references(references: list[str], entries: DataFrame, key: str, allowed: DataFrame) -> DataFrame:
    """references: as a caller's model names them (a few). One row each, once: the entry's key if there is one, and
    whether it is allowed."""
    spark = entries.sparkSession
    asked = spark.createDataFrame([(r,) for r in dict.fromkeys(references)], "reference string")
    rows = asked.join(entries.select("reference", key), "reference", "left")
    fine = allowed.select(F.col(key).alias("__k")).distinct()
    return rows.join(fine, F.col(key) == F.col("__k"), "left").select("reference", key, F.col("__k").isNotNull().alias("allowed"))


def clarification(entries: DataFrame, rank: str, question: str, most: int = 3) -> DataFrame:
    """One row: the question with the names of the first candidates, each once; null without any."""
    names = entries.groupBy("source_file").agg(F.min(rank).alias("r")).orderBy("r").limit(most)
    listed = names.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "source_file"))), lambda x: F.concat(F.lit("- "), x["source_file"])), "\n").alias("l"))
    return listed.select(F.when(F.col("l") != "", F.concat(F.lit(f"{question}\n\n{FITTING}\n"), F.col("l"))).alias("reply"))
