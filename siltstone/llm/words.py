"""Documents as positions in the word lists of their blocks, and values joined to the words.

A block is what one task reads, up to BLOCK_WORDS words. Its distinct words are listed once; its documents become
positions in that list. Values that are global to a word (its token ids, its count) are worked out once for each
distinct word and joined back to the blocks by position. What is shuffled for that is each block's distinct words,
packed by hash bucket, and the values, packed alike; the documents lie in a table bucketed by block and never move.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, delete_at_exit, shared_dir

BLOCK_WORDS = 1_500_000
#: Distinct words of a block and their bytes; with BLOCK_WORDS they bound a worker's memory. One text is never split.
BLOCK_DISTINCT = 200_000
BLOCK_BYTES = 8 << 20
#: Buckets of words: for each shuffle partition, and as many as the input has of BUCKET_INPUT bytes. A bucket's packed
#: words are what a task holds at a time, so their number grows with the input.
BUCKETS_A_PARTITION = 8
BUCKET_INPUT = 16 << 20
#: Words of a batch that are numbered together.
CHUNK = 200_000
#: Words whose values a worker remembers where values need no counts.
VALUES_KEPT = 100_000
SCHEMA = "block long, kind int, doc_id long, flag boolean, body binary, places binary, counts binary, at int, n long"
#: No word contains it, so it stands between words.
BETWEEN = b"\n"


class Numbers(dict):
    """Numbers words in the order they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        return out


def pack(x: np.ndarray) -> bytes:
    """32-bit numbers a byte plane at a time: the high planes of small numbers compress to nothing."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack(body: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pack_rising(x: np.ndarray) -> bytes:
    return pack(np.diff(x.astype(np.int64), prepend=0))


def squeeze(body: bytes) -> bytes:
    """Compressed, after its length."""
    return len(body).to_bytes(4, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unsqueeze(body: bytes) -> bytes:
    return pa.decompress(memoryview(body)[4:], int.from_bytes(body[:4], "little"), codec="zstd", asbytes=True)


def pack64(x: np.ndarray) -> bytes:
    """64-bit numbers a byte plane at a time."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack64(body: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def unpack_rising(body: bytes) -> np.ndarray:
    return np.cumsum(unpack(body).astype(np.int64))


def block_rows(split: Callable[[bytes], list[bytes]] | None, end: bytes | None, flagged: bool, buckets: int, extra: Callable | None = None, limits: tuple[int, int, int] | None = None) -> Callable:
    """mapInArrow from doc_id, text, flag to rows of SCHEMA: kind 0 a document, kind 1 the words of a bucket, kind 2
    what extra gives. Texts are split by split, or are lists of words already; end, if given, follows each text as a word
    of its own.

    Words are numbered by falling frequency in the block, then in order, so that most positions are small and
    neighbours alike. Counts are of occurrences in documents whose flag is set, if flagged, and in all else. limits
    are those of a block: words, distinct words, bytes of distinct words.
    """
    most_words, most_distinct, most_bytes = limits or (BLOCK_WORDS, BLOCK_DISTINCT, BLOCK_BYTES)

    def flush(block: int, docs: list, words: Numbers) -> Iterator[pa.RecordBatch]:
        if not docs:
            return
        listed = list(words)
        lengths = np.array([len(x[2]) for x in docs], np.int64)
        raw = np.concatenate([x[2] for x in docs])
        marks = np.repeat(np.array([bool(x[1]) for x in docs]), lengths)
        often = np.bincount(raw, minlength=len(listed))
        order = np.array(sorted(range(len(listed)), key=listed.__getitem__), np.int64)
        order = order[np.argsort(-often[order], kind="stable")]
        place = np.empty(len(listed), np.uint32)
        place[order] = np.arange(len(listed), dtype=np.uint32)
        raw = place[raw]
        ends = np.cumsum(lengths)
        for at in range(0, len(docs), 500):
            some = docs[at : at + 500]
            yield rows(block, 0, doc_id=[x[0] for x in some], flag=[x[1] for x in some], body=[pack(raw[e - n : e]) for e, n in zip(ends[at : at + 500].tolist(), lengths[at : at + 500].tolist(), strict=True)], n=lengths[at : at + 500])
        docs.clear()
        listed = [listed[i] for i in order.tolist()]
        counts = np.bincount(raw[marks], minlength=len(listed)) if flagged else None
        bucket = np.fromiter(map(xxhash.xxh64_intdigest, listed), np.uint64, len(listed)) % np.uint64(buckets)
        by_bucket = np.argsort(bucket, kind="stable")
        full, bounds = np.unique(bucket[by_bucket], return_index=True)
        bounds = [*bounds.tolist(), len(listed)]
        for at in range(0, len(full), 500):
            some = [by_bucket[a:b] for a, b in zip(bounds[at : at + 500], bounds[at + 1 :], strict=False)]
            given = {"at": full[at : at + 500].astype(np.int32), "body": [squeeze(BETWEEN.join(map(listed.__getitem__, x.tolist()))) for x in some], "places": [pack_rising(x) for x in some], "n": [len(x) for x in some]}
            yield rows(block, 1, **given, **({"counts": [pack(counts[x]) for x in some]} if flagged else {}))
        if extra:
            found = extra(raw, marks, ends, listed)
            while some := list(islice(found, 500)):
                yield rows(block, 2, at=[x[0] for x in some], body=[x[1] for x in some], n=[x[2] for x in some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, docs, words, total, size = TaskContext.get().partitionId() << 32, [], Numbers(), 0, 0
        after = [] if end is None else [end]
        for batch in batches:
            doc_ids, flags = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for at, to, texts in listed_texts(batch.column(1)) if split is None else whole_texts(batch.column(1)):
                known = len(words)
                if split is None:
                    coded = texts.flatten().dictionary_encode()
                    number = np.fromiter(map(words.__getitem__, coded.dictionary.cast(pa.binary()).to_pylist()), np.uint32)
                    lengths = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
                    codes = np.split(number[coded.indices.to_numpy(zero_copy_only=False)], np.cumsum(lengths)[:-1])
                else:
                    own = [*split(texts), *after]
                    codes = [np.fromiter(map(words.__getitem__, own), np.uint32, len(own))]
                docs += zip(doc_ids[at:to], flags[at:to], codes, strict=True)
                total += sum(map(len, codes))
                size += sum(map(len, islice(reversed(words), len(words) - known)))
                if total >= most_words or len(words) >= most_distinct or size >= most_bytes:
                    yield from flush(block, docs, words)
                    block, docs, words, total, size = block + 1, [], Numbers(), 0, 0
        yield from flush(block, docs, words)

    return run


def whole_texts(texts: pa.Array) -> Iterator[tuple[int, int, bytes]]:
    for i, text in enumerate(texts):
        yield i, i + 1, text.as_py()


def listed_texts(lists: pa.Array) -> Iterator[tuple[int, int, pa.Array]]:
    """Slices of lists with CHUNK words together; a longer list comes alone."""
    ends, at = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(lists):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
        yield at, to, lists.slice(at, to - at)
        at = to


def rows(block: int, kind: int, **given) -> pa.RecordBatch:
    types = {"doc_id": pa.int64(), "flag": pa.bool_(), "body": pa.binary(), "places": pa.binary(), "counts": pa.binary(), "at": pa.int32(), "n": pa.int64()}
    size = len(next(iter(given.values())))
    columns = [pa.array(np.full(size, block, np.int64)), pa.array(np.full(size, kind, np.int32))]
    columns += [pa.array(given[k], t) if k in given else pa.nulls(size, t) for k, t in types.items()]
    return pa.RecordBatch.from_arrays(columns, ["block", "kind", *types])


def input_bytes(docs: DataFrame) -> int:
    """About how large docs is: the planner's figure, or the texts' own size where it has none."""
    known = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 60 else docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0


def buckets_for(docs: DataFrame) -> int:
    return max(BUCKETS_A_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(docs) // BUCKET_INPUT))


class Blocks:
    """The rows of block_rows in a table bucketed by block and split by kind. Used as a context, which takes it
    out of the catalog and the shared folder at its end."""

    def __init__(self, docs: DataFrame, split: Callable[[bytes], list[bytes]] | None, end: bytes | None = None, flagged: bool = False, extra: Callable | None = None, limits: tuple[int, int, int] | None = None) -> None:
        """docs: doc_id, text (binary, or an array of words without split), flag."""
        self.spark = spark = docs.sparkSession
        self.name = f"siltstone_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(spark)}/{self.name}"
        docs = docs.select("doc_id", "text", "flag")
        blocks = docs.mapInArrow(block_rows(split, end, flagged, buckets_for(docs), extra, limits), SCHEMA)
        delete_at_exit(spark, self.path)
        try:
            self._save(blocks)
        except BaseException:
            self.remove()
            raise
        self.table = spark.table(self.name)

    def _save(self, blocks: DataFrame) -> None:
        spark = self.spark
        blocks.write.format("parquet").option("compression", "zstd").option("path", self.path).partitionBy("kind").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").saveAsTable(self.name)

    def __enter__(self) -> "Blocks":
        return self

    def __exit__(self, *_) -> None:
        self.remove()

    def remove(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


def word_values(blocks: Blocks, value: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """A value for each distinct word, worked out once a bucket and handed to every block that has the word.

    With value, value(word); without, the sum of the word's counts. Returns block, places, body (of values: their
    lengths, then the values one after the other; of counts: 64-bit numbers), fresh: on the first row of each bucket
    the number of its words that were counted. Values are streamed; for counts a bucket's packed words are held.
    """
    names = ["block", "places", "body", "fresh"]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names)

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                out = []
                for block, _, body, places, _ in zip(*(c.to_pylist() for c in batch.slice(at, 100).columns), strict=True):
                    words = unsqueeze(body).split(BETWEEN)
                    if len(known) > VALUES_KEPT:
                        known.clear()
                    for w in words:
                        if w not in known:
                            known[w] = value(w)
                    own = list(map(known.__getitem__, words))
                    out.append((block, places, squeeze(pack(np.fromiter(map(len, own), np.uint32, len(own))) + b"".join(own)), 0))
                yield batch_of(out)

    def close(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        number, summed = Numbers(), []
        for _, _, body, _, counts in held:
            at = np.fromiter(map(number.__getitem__, unsqueeze(body).split(BETWEEN)), np.int64)
            summed.append((at.astype(np.uint32), unpack(counts)))
        totals = np.zeros(len(number), np.int64)
        for at, counts in summed:
            totals[at] += counts  # a word comes once in a block
        fresh = int((totals > 0).sum())
        del number
        for begin in range(0, len(held), 100):
            yield batch_of([(held[i][0], held[i][3], pack64(totals[summed[i][0]]), fresh if i == 0 else 0) for i in range(begin, min(begin + 100, len(held)))])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][1] != x[1]:
                    yield from close(held)
                    held = []
                held.append(x)
        if held:
            yield from close(held)

    words = blocks.table.where("kind = 1").select("block", "at", "body", "places", "counts")
    return words.repartition("at").sortWithinPartitions("at").mapInArrow(counted if value is None else valued, "block long, places binary, body binary, fresh long")


def values_of(joined: pa.Table) -> list[bytes]:
    """The values of a block by position."""
    where, values = [], []
    for a, b in zip(joined.column("places").to_pylist(), map(unsqueeze, joined.column("body").to_pylist()), strict=True):
        begin = len(a)
        ends = np.cumsum(unpack(b[:begin]).astype(np.int64)) + begin
        where.append(unpack_rising(a))
        for e in ends.tolist():
            values.append(b[begin:e])
            begin = e
    return _placed(where, values)


def counts_of(joined: pa.Table) -> np.ndarray:
    """The counts of a block by position."""
    where = [unpack_rising(x) for x in joined.column("places").to_pylist()]
    out = np.zeros(sum(map(len, where)), np.int64)
    for at, body in zip(where, joined.column("body").to_pylist(), strict=True):
        out[at] = unpack64(body)
    return out


def _placed(where: list[np.ndarray], values: list[bytes]) -> list[bytes]:
    out = [b""] * len(values)
    for i, v in zip(np.concatenate(where).tolist() if where else [], values, strict=True):
        out[i] = v
    return out


def placed_words(listed: pa.Table) -> list[bytes]:
    """The words of a block by position, of its rows of kind 1."""
    return _placed([unpack_rising(x) for x in listed.column("places").to_pylist()], [w for x in listed.column("body").to_pylist() for w in unsqueeze(x).split(BETWEEN)])


def with_values(blocks: Blocks, values: DataFrame, function: Callable[..., pa.Table], schema: str, words: bool = False, more: DataFrame | None = None) -> DataFrame:
    """function(documents of a block, its rows of values) -> pa.Table of schema; with words, the words by position
    come third, and the block's rows of more (block, at, body), if given, last. Only the values and more are shuffled."""

    more_given = more is not None  # a frame itself can't go to the workers

    def run(own: pa.Table, joined: pa.Table) -> pa.Table:
        extra = []
        if more_given:
            first = joined.column("at").is_null()
            extra, joined = [joined.filter(pc.invert(first))], joined.filter(first)
        if not words:
            return function(own, joined)
        kind = own.column("kind").to_numpy()
        return function(own.filter(pa.array(kind == 0)), joined, placed_words(own.filter(pa.array(kind == 1))), *extra)

    left = blocks.table.where("kind in (0, 1)" if words else "kind = 0").select("block", "doc_id", "flag", "body", "n", *["kind", "places"] * words)
    right = values.select("block", "places", "body")
    if more_given:
        right = right.withColumn("at", F.lit(None).cast("int")).unionByName(more.select("block", F.lit(None).cast("binary").alias("places"), "body", "at"))
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(run, schema)
