"""Best-fit packing by planning over a histogram of lengths.

Documents become token pieces in one pass that writes (length, number within the task's pieces of that length). The
plan is made over counts by length, at most `size` of them, however many documents there are: best fit, longest first,
placing whole runs of equal pieces into whole runs of equal sequences. A piece's rank within its length is its number
within its task plus the pieces of that length in earlier tasks, so no length, however common, is ranked in one task;
the rank then picks the slot.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import Remembered, cut, small_batches, utf8

SIZE = 2048
END = 0
#: Distinct words whose ids a worker remembers before it starts anew.
WORDS_KEPT = 400_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, number long"


class _Ids(Remembered):
    def __init__(self, path: str) -> None:
        super().__init__(WORDS_KEPT)
        self.encoder = encoder(path)

    def value(self, word: bytes) -> bytes:
        return self.encoder.word(word)


_ids: dict[str, _Ids] = {}


def token_ids(text: bytes, path: str) -> bytes:
    """Little-endian 32-bit ids, the end included."""
    known = _ids.get(path)
    if known is None:
        known = _ids[path] = _Ids(path)
    return b"".join([*map(known.__getitem__, text.split()), END.to_bytes(4, "little")])


def cut_pieces(path: str, size: int, texts: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "number", *["ids"] * texts]
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, numbers = TaskContext.get().partitionId(), [0] * (size + 1)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = token_ids(text.as_py(), path)
                for k, start in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[start : start + 4 * size]
                    n = len(own) // 4
                    out.append((doc_id, k, start // 4, n, zlib.crc32(own), part, numbers[n], *[np.frombuffer(own, "<u4").tolist()] * texts))
                    numbers[n] += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=False)], names)

    return run


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int]]:
    """counts: pieces by length. Best fit, longest first. Returns (length, first rank, first sequence, offset): the
    pieces of that length from that rank on, up to the next entry's, take the same offset in consecutive sequences."""
    slots, room, new = [], {}, 0  # room: runs of sequences (first, how many) by the space left
    spaces: list[int] = []  # ascending keys of room
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, many = room[space].pop()
                take = min(many, left)
                if take < many:
                    room[space].append((first + take, many - take))
                if not room[space]:
                    del room[space], spaces[at]
            else:
                # as many new sequences as the pieces need when each is filled with this length alone
                space, first = size, new
                take = -(-left // (size // length))
                new += take
            slots.append((length, rank, first, size - space))
            rank, left = rank + take, left - take
            if space > length:
                if space - length not in room:
                    room[space - length] = []
                    bisect.insort(spaces, space - length)
                room[space - length].append((first, take))
    return slots


def pack(docs: DataFrame, path: str, size: int = SIZE, texts: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with texts also ids.

    A document is its token ids and then id 0, so a null or empty text is one token. Only documents longer than a
    sequence are cut. Repeated rows and null ids are packed as documents of their own. Other columns are ignored; an
    empty table gives an empty table.
    """
    spark = docs.sparkSession
    schema = PIECES + ", ids array<int>" * texts
    pieces = cut(small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(cut_pieces(path, size, texts), schema), "pieces")
    by_task = cut(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    ranks: dict[int, list] = {}
    for length, rank, first, offset in plan(counts, size):
        ranks.setdefault(length, []).append((rank, first, offset))
    slots = spark.createDataFrame([(k, v) for k, v in ranks.items()], "length long, runs array<struct<rank:long,first:long,offset:long>>")
    # a few thousand rows for each length: one for each task
    before = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.join(F.broadcast(slots), "length").select("length", "part", F.coalesce("before", F.lit(0)).alias("before"), "n", "runs")
    # of the runs of a length, a task's pieces need those that their ranks reach
    reached = F.expr("filter(runs, (r, i) -> r.rank < before + n and (i = size(runs) - 1 or runs[i + 1].rank > before))")
    placed = pieces.join(before.select("length", "part", "before", reached.alias("runs")), ["length", "part"]).withColumn("rank", F.col("before") + F.col("number"))
    placed = placed.withColumn("run", F.expr("element_at(filter(runs, r -> r.rank <= rank), -1)"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("run.first") + F.col("rank") - F.col("run.rank")).alias("sequence_id"), F.col("run.offset").alias("offset"), *["ids"] * texts)
