"""What the queries share: tables, registration, the chunk view of the test tables, SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries with their SQL; None where SQL has no form."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None) -> Callable[[Query], Query]:
        def take(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql is not None:
                self.sql[query.__name__] = sql
            return query

        return take


#: Tables with long texts, on which a query spends its time row by row.
TEXTS = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder. One file of texts is dealt to all cores first: its few row groups would keep few busy. A
    table of many files, as any large one is, is read as it lies."""
    return dealt(spark, sf_dir, name) if name in TEXTS else spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table, or some of its columns, dealt to all cores if it is one file: for work that takes long on each row."""
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    return df.repartition(spark.sparkContext.defaultParallelism) if is_file(spark, path) else df


def is_file(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile()


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: the id is the position, the source is the file."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("position"), F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("source_file"),
        F.col("lang").alias("unit_type"), "text", F.col("doc_id").alias("chunk_index"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("position"), "embedding", F.col("label").cast("string").alias("unit_type"))


def query_text(spark: SparkSession, sf_dir: str, item: int = 0) -> str:
    """One row: the query is a parameter of the search."""
    return table(spark, sf_dir, "benchmark").where(F.col("item_id") == item).first()["text"]


def query_vector(spark: SparkSession, sf_dir: str, vec: int = 0) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec).first()["embedding"]]


def quoted(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


def sql_terms(x: str) -> str:
    return rf"list_filter({sql_tokens(x)}, lambda t: (length(t) > 1 OR regexp_matches(t, '^[0-9]$')) AND NOT list_contains({quoted(STOPWORDS)}, t))"


def sql_plain_terms(x: str) -> str:
    return rf"list_distinct(list_filter({sql_tokens(x)}, lambda t: length(t) > 1 OR regexp_matches(t, '^[0-9]$')))"


def sql_dot(a: str, b: str) -> str:
    return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
