"""A chunk store that replaces by key, its figures, and its table on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The store's quotas.
MOST_DOCUMENTS, MOST_CHUNKS = 30, 15_000


def document_key() -> Column:
    """document_id unless it is empty, then source_file."""
    return F.coalesce(F.nullif(F.col("document_id"), F.lit("")), F.col("source_file"))


def upsert(store: DataFrame, incoming: DataFrame, source_file: str, by_document: bool) -> DataFrame:
    """Rows of the same documents go (by_document: incoming rows have document ids; rows without one survive), else
    rows of the same source; incoming rows come last. The caller says which, so that no job runs to find out. Rows
    without text are rejected before."""
    if by_document:
        keys = incoming.where("document_id <> ''").select("document_id").distinct()
        left = store.join(keys, "document_id", "left_anti")
    else:
        left = store.where(~F.col("source_file").eqNullSafe(source_file))
    return left.unionByName(incoming, allowMissingColumns=True)


def has_document_ids(incoming: DataFrame) -> bool:
    return not incoming.where("document_id <> ''").isEmpty()


def delete_source(store: DataFrame, source_file: str) -> DataFrame:
    return store.where(~F.col("source_file").eqNullSafe(source_file))


def stats(store: DataFrame, *by: str) -> DataFrame:
    return store.groupBy(*by).agg(F.countDistinct(document_key()).alias("documents"), F.count("*").alias("chunks"))


def projected_stats(store: DataFrame, incoming: DataFrame, source_file: str, by_document: bool) -> DataFrame:
    columns = ["document_id", "source_file"]
    return stats(upsert(store.select(*columns), incoming.select(*columns), source_file, by_document))


def quota_guard(figures: DataFrame, documents: int = MOST_DOCUMENTS, chunks: int = MOST_CHUNKS) -> DataFrame:
    return figures.withColumns({"documents_exceeded": F.col("documents") > documents, "chunks_exceeded": F.col("chunks") > chunks}).withColumn("accepted", ~(F.col("documents_exceeded") | F.col("chunks_exceeded")))


def resource_delta(start: DataFrame, end: DataFrame, key: str) -> DataFrame:
    """Differences of gauges that both snapshots have as numbers."""
    return start.join(end.withColumnRenamed("value", "after"), key).where("value is not null and after is not null").select(key, (F.col("after") - F.col("value")).alias("delta"))


#: Folders of a store: a document's chunks lie in one of them, by a hash of its key.
BUCKETS = 256


def save(store: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """A folder for each bucket of documents. Writing again replaces the buckets that it has rows for, so it takes all
    documents of a bucket, as upsert() of a loaded store gives them."""
    spark = store.sparkSession
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        store.withColumn("bucket", bucket_of(buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    finally:
        spark.conf.set(mode, before)


def bucket_of(buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(document_key()), F.lit(buckets)).cast("int")


def load(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def replace_documents(path: str, incoming: DataFrame, buckets: int = BUCKETS) -> None:
    """Upsert by document into a saved store: only the buckets of incoming documents are read and written again, by way
    of a new folder, so that nothing is read and overwritten at a time."""
    spark = incoming.sparkSession
    touched = [r["b"] for r in incoming.select(bucket_of(buckets).alias("b")).distinct().collect()]  # at most `buckets`
    old = spark.read.parquet(path)
    new = upsert(old.where(F.col("bucket").isin(touched)).drop("bucket"), incoming, "", by_document=True)
    fresh = f"{path.rstrip('/')}-next"
    new.withColumn("bucket", bucket_of(buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(fresh)
    save(spark.read.parquet(fresh).drop("bucket"), path, buckets)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(fresh)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
