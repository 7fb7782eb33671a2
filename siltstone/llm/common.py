"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that a Python function handles at a time; bounds its memory together with the batch's own bytes.
ROWS_AT_A_TIME = 512
#: Words whose hashes a worker remembers before it starts anew.
CACHE_ENTRIES = 200_000
_own_dir: list[str] = []
_written: list[list[str]] = []


#: Rows that a scan and an Arrow batch hold at a time. Texts are long, and the defaults are made for short rows: with
#: them an executor's JVM takes 1.5 GB for texts of 3 KB, with these 0.9 GB in the same time.
BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": "512", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def small_batches(docs: DataFrame) -> DataFrame:
    """docs, after the session's batch sizes were set to BATCHES, but for those that its configuration sets itself."""
    spark = docs.sparkSession
    given = spark.sparkContext.getConf()
    for key, value in BATCHES.items():
        if not given.contains(key):
            spark.conf.set(key, value)
    return docs


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local master may go without: then a folder of this machine
    serves, which all its tasks can see."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="siltstone-"))
    return _own_dir[0]


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def delete_at_exit(spark: SparkSession, path: str) -> None:
    files, place = _place(spark, path)
    files.deleteOnExit(place)


def delete(spark: SparkSession, path: str) -> None:
    files, place = _place(spark, path)
    files.delete(place, True)


#: Bytes of a file, for tables that are known not to be larger than some number of bytes.
FILE_BYTES = 16 << 20


def cut(df: DataFrame, name: str, size: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and a lost executor costs no
    recomputation. size: a bound in bytes, where one is known; a small table then lies in a few files and not in one a
    task."""
    spark = df.sparkSession
    if size is not None:
        df = df.coalesce(max(1, -(-size // FILE_BYTES)))
    place = f"{shared_dir(spark)}/siltstone-{uuid.uuid4().hex}"
    path = f"{place}/{name}"
    delete_at_exit(spark, place)
    for written in _written:
        written.append(place)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siltstone_path = path
    return out


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """cut() of what make gives, after which all tables that it wrote on the way are deleted."""
    _written.append([])
    try:
        out = cut(make(), name)
    finally:
        places = _written.pop()
    for place in places[:-1]:
        delete(spark, place)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote, once nothing reads them any more."""
    for df in tables:
        delete(df.sparkSession, df._siltstone_path)


def utf8(column: str = "text") -> F.Column:
    """Text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def by_rows(function: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = ROWS_AT_A_TIME) -> Callable:
    """For mapInArrow: apply function to slices of a few rows."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield function(batch.slice(at, rows))

    return over


def by_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices whose values of a column, strings or binaries, have `most` bytes together; a larger value comes alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


class Remembered(dict):
    """What a worker remembers by key between tasks: at most `most` entries, then it starts anew. Workers go from one
    operator's tasks to another's, so making a value of one kind forgets the others."""

    kinds: list["Remembered"] = []
    last: "Remembered | None" = None

    def __init__(self, most: int = CACHE_ENTRIES) -> None:
        super().__init__()
        self.most = most
        Remembered.kinds.append(self)

    def value(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        if Remembered.last is not self:
            for other in Remembered.kinds:
                if other is not self:
                    other.clear()
            Remembered.last = self
        if len(self) >= self.most:
            self.clear()
        self[key] = out = self.value(key)
        return out


class WordHashes(Remembered):
    """XXH64 by word (bytes)."""

    def value(self, word: bytes) -> int:
        return xxhash.xxh64_intdigest(word)


def word_hashes(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class RollingHashes:
    """Hashes of all runs of k consecutive items, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, multiplier: int = 0x9E3779B97F4A7C15) -> None:
        self.size, self.multiplier = 0, multiplier

    def grow(self, n: int) -> None:
        if n > self.size:
            self.size = 1 << n.bit_length()
            inverse = pow(self.multiplier, -1, 1 << 64)
            one = np.ones(self.size, np.uint64)
            for name, factor in (("up", self.multiplier), ("down", inverse)):
                powers = one.copy()
                powers[1:] = factor
                setattr(self, name, np.multiply.accumulate(powers))

    def prefix(self, items: np.ndarray) -> np.ndarray:
        self.grow(len(items) + 1)
        out = np.zeros(len(items) + 1, np.uint64)
        np.cumsum(items * self.up[: len(items)], out=out[1:])
        return out

    def runs(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Of the k items from each position on; empty if there are fewer."""
        n = len(prefix) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((prefix[k:] - prefix[:n]) * self.down[:n])
