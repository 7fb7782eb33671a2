"""Document fingerprints by one-permutation MinHash.

A document's five-word shingles are hashed once and binned by their high bits; a bin keeps its smallest hash. Empty
bins are filled by optimal densification: each draws bins by its own two-universal sequence until it meets a filled
one, however long that takes. Of each bin's value the low bits of a hash that depends on the bin are packed into the fingerprint, and likeness
is corrected for the matches that chance gives so few bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHashes, WordHashes, mix, small_batches, word_hashes

SHINGLE = 5
BINS = 512
BITS = 4
_cache, _rolling = WordHashes(), RollingHashes()


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Of runs of `shingle` words (ASCII white space between); of all words where there are fewer."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    return _rolling.runs(_rolling.prefix(word_hashes(words, _cache)), min(shingle, len(words)))


#: Draws of all bins, by the number of bins, a block of TRIES at a time; more blocks are made when a text needs them.
_drawn: dict[int, list[np.ndarray]] = {}
TRIES = 64


def draws(bins: int, block: int) -> np.ndarray:
    """Row t: the bins that the bins draw at try block * TRIES + t."""
    known = _drawn.setdefault(bins, [])
    while len(known) <= block:
        tries = np.arange(len(known) * TRIES, (len(known) + 1) * TRIES, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        known.append((mix(np.arange(1, bins + 1, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93) + tries) % np.uint64(bins)).astype(np.int16))
    return known[block]


def signature(hashes: np.ndarray, bins: int = BINS, bits: int = BITS) -> np.ndarray | None:
    """The low bits of each bin; None for no shingles."""
    if not len(hashes):
        return None
    shift = np.uint64(64 - (bins.bit_length() - 1))
    low = np.full(bins, ~np.uint64(0))
    filled = np.zeros(bins, bool)
    place = (hashes >> shift).astype(np.int64)
    filled[place] = True
    np.minimum.at(low, place, hashes & ((np.uint64(1) << shift) - np.uint64(1)))
    empty = np.nonzero(~filled)[0]
    out, block = low.copy(), 0
    while len(empty):
        drawn = draws(bins, block)[:, empty]
        hit = filled[drawn]
        found = hit.any(axis=0)
        out[empty[found]] = low[drawn[hit.argmax(axis=0)[found], np.nonzero(found)[0]]]
        empty, block = empty[~found], block + 1
    # the bin's number goes in, so that values that fill many bins match by chance in each for itself
    return (mix(out * np.uint64(2) + np.uint64(1) ^ mix(np.arange(1, bins + 1, dtype=np.uint64))) & np.uint64((1 << bits) - 1)).astype(np.uint8)


def packed(low: np.ndarray | None, bits: int = BITS) -> str:
    """Hexadecimal, the bins' bits one after the other; the empty string for no shingles."""
    if low is None:
        return ""
    return np.packbits(np.unpackbits(low[:, None], axis=1)[:, 8 - bits :].ravel()).tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None, bits: int = BITS) -> float:
    """Estimated Jaccard similarity: the share of equal bins, less what chance gives. No shingles: 1 with none, else 0."""
    if a is None or b is None:
        return float(a is None and b is None)
    chance = 0.5**bits
    return float(min(1.0, max(0.0, ((a == b).mean() - chance) / (1 - chance))))


def edited(text: str, after: str) -> str:
    """The last half, rounded down, gives way to as many code points from the start of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, doc_id, text, extra; sorted by bucket, then extras last. A row waits for the one after it."""
    waiting: tuple | None = None
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]

    def finish(row: tuple, after: str, low_after: np.ndarray | None) -> tuple:
        _, doc_id, text, low = row
        new = edited(text, after)
        raw = new.encode()
        low_new = signature(shingle_hashes(raw))
        return doc_id, len(text), hashlib.sha256(raw).hexdigest(), packed(low), packed(low_new), likeness(low, low_new), likeness(low, low_after)

    for batch in batches:
        out = []
        for i, (bucket, doc_id, extra) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True)):
            text = batch.column(2)[i].as_py()
            if waiting and waiting[0] == bucket:
                low = signature(shingle_hashes(text.encode()))
                out.append(finish(waiting, text, low))
                waiting = None if extra else (bucket, doc_id, text, low)
            elif not extra:
                waiting = (bucket, doc_id, text, signature(shingle_hashes(text.encode())))
            if len(out) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the next row by (doc_id, text), null ids first; the last one's is the first. A document alone
    is its own next. Null texts count as empty; a text without words has an empty fingerprint, whose likeness is 1 to
    another such and else 0. Other columns are ignored; an empty table gives an empty table.

    Rows are dealt into as many ranges of doc_id as there are shuffle partitions, at the borders that a
    repartitionByRange of the ids alone finds; each range also gets the first row of the next one, so the whole order
    costs one shuffle of the texts. What goes to the workers is one border for each partition, whatever the input.
    """
    spark = docs.sparkSession
    lowest = -(1 << 63)
    source = small_batches(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("id"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = source.select("id").repartitionByRange(partitions, "id").groupBy(F.spark_partition_id()).agg(F.min("id").alias("first"))
    firsts = np.array(sorted(r["first"] for r in ranges.collect()), np.int64)  # at most one for each partition

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            own = np.searchsorted(firsts, ids, side="right") - 1
            # a range's first row also goes to the range before it, and the very first to the last range
            twice = np.nonzero(firsts[own] == ids)[0]
            rows = pa.array(np.concatenate([np.arange(len(ids)), twice]))
            extra = np.concatenate([np.zeros(len(ids), bool), np.ones(len(twice), bool)])
            buckets = np.concatenate([own, (own[twice] - 1) % len(firsts)])
            yield pa.RecordBatch.from_arrays([pa.array(buckets), batch.column(1).take(rows), batch.column(2).take(rows), pa.array(extra)], ["bucket", "doc_id", "text", "extra"])

    dealt = source.mapInArrow(deal, "bucket long, doc_id long, text string, extra boolean")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.repartitionById(partitions, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "extra", "doc_id", "text").mapInArrow(_ranges, schema)
