"""SimHash near-dedup with bit-sliced comparison.

Fingerprints are taken document by document. Equal ones become one node first, so copies cost nothing further. Two
fingerprints that differ in at most 3 of 64 bits agree in one of four 16-bit blocks, and then in one of four 12-bit
blocks of the other 48 bits: 16 tables with 28-bit keys bring together every pair that has to be compared. Inside a
bucket the fingerprints are stored as bit planes; distances of many lanes at once are counted by carry-save adders
that overflow exactly beyond the radius, and a block is left as soon as all its lanes have overflowed. A bucket hands
on a spanning forest of its links, never its pairs. Buckets over TILE rows are cut into tiles that different tasks
compare, so none is too large for a task and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_rows, cut, small_batches, utf8
from .components import connected_components

RADIUS = 3
SHINGLE = 3
SEED = 42
TILE = 2048
SMALL = 64
BLOCKS = 4


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Of lower-cased words (A-Z only, ASCII white space between); no words: 0. Unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    parts = zip(*(words[i : i + n] for i in range(shingle)), strict=True) if len(words) >= shingle else [words]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, parts), repeat(SEED)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batch: pa.RecordBatch) -> pa.RecordBatch:
    prints = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def planes_of(prints: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all fingerprints, 64 lanes a word."""
    lanes = -(-len(prints) // 64) * 64
    bits = np.zeros((64, lanes), np.uint8)
    bits[:, : len(prints)] = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def lanes_within(planes: np.ndarray, flips: np.ndarray | None, radius: int = RADIUS) -> np.ndarray:
    """planes: 64 x words of bit planes. flips: queries x 64 of 0 or all ones, the queries' bits, or None where the
    planes hold differences already. Returns words (queries x words) whose set lanes are within the radius."""
    width = radius.bit_length()
    shape = (1 if flips is None else len(flips), planes.shape[1])
    full = ~np.uint64(0)
    # counters start at 2**width - 1 - radius, so that the carry out of the top says "over the radius"
    start = (1 << width) - 1 - radius
    counter = [np.full(shape, full if start >> i & 1 else 0, np.uint64) for i in range(width)]
    over = np.zeros(shape, np.uint64)
    for b in range(64):
        carry = planes[b][None, :] if flips is None else planes[b][None, :] ^ flips[:, b : b + 1]
        for i in range(width):
            counter[i], carry = counter[i] ^ carry, counter[i] & carry
        over |= carry
        if b % 8 == 7 and (over == full).all():
            break
    return ~over


def _lanes(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.astype("<u8").view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")[:, :n]


def links_of_large(prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the fingerprints of one bucket, as index pairs."""
    planes, n = planes_of(prints), len(prints)
    label = np.arange(n)
    u, v = [], []
    full = ~np.uint64(0)
    step = max(1, (1 << 16) // planes.shape[1])
    for at in range(0, n, step):
        own = prints[at : at + step]
        flips = np.where(own[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1), full, np.uint64(0))
        # only lanes from this block on: earlier blocks have met it already
        first = at // 64
        q, lane = np.nonzero(_lanes(lanes_within(planes[:, first:], flips, radius), n - first * 64))
        a, b = q + at, lane + first * 64
        keep = a < b
        for x, y in zip(*shrink(label[a[keep]], label[b[keep]]), strict=True):
            u.append(x), v.append(y)
        if keep.any():
            label = settle(label, np.array(u), np.array(v))
    return np.array(u, np.int64), np.array(v, np.int64)


def shrink(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links a-b as a star forest: (node, smallest node of its component)."""
    if not len(a):
        return a, b
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = both[: len(a)], both[len(a) :]
    label = settle(np.arange(len(nodes)), i, j)
    moved = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[moved], nodes[label[moved]]


def settle(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest label of each component under the links i-j."""
    label = label.copy()
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links_of_runs(run: np.ndarray, prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """run: bucket numbers in ascending order. Links inside the buckets, as index pairs, a forest."""
    sizes = np.bincount(run)
    large = sizes > SMALL
    some = np.nonzero(~large[run])[0]
    u, v = [], []
    k = 1
    while len(some) > k:
        left = some[:-k][run[some[:-k]] == run[some[k:]]]
        if not len(left):
            break
        right = left + k
        for at in range(0, len(left), 1 << 18):
            a, b = left[at : at + (1 << 18)], right[at : at + (1 << 18)]
            near = _lanes(lanes_within(planes_of(prints[a] ^ prints[b]), None, radius), len(a))[0].astype(bool)
            u.append(a[near]), v.append(b[near])
        k += 1
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for r in np.nonzero(large)[0]:
        a, b = links_of_large(prints[starts[r] : starts[r + 1]], radius)
        u.append(a + starts[r]), v.append(b + starts[r])
    if not u:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return shrink(np.concatenate(u).astype(np.int64), np.concatenate(v).astype(np.int64))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket (long) and fp; a bucket may go on in the next batch."""
    rest_key, rest_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        run = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        u, v = links_of_runs(run, fp.view(np.uint64))
        u, v = fp[u], fp[v]
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        key = np.concatenate([rest_key, batch.column(0).to_numpy()])
        fp = np.concatenate([rest_fp, batch.column(1).to_numpy()])
        if len(key):
            whole = int(np.searchsorted(key, key[-1]))
            if whole:
                yield out(key[:whole], fp[:whole])
            rest_key, rest_fp = key[whole:].copy(), fp[whole:].copy()
    if len(rest_key):
        yield out(rest_key, rest_fp)


def _tables(fp: str) -> F.Column:
    """The 16 keys of a fingerprint: a 16-bit block, then a 12-bit block of the other 48 bits, with the table's number."""
    keys = []
    width, inner = 64 // BLOCKS, (64 - 64 // BLOCKS) // BLOCKS
    for i in range(BLOCKS):
        block = f"(shiftrightunsigned({fp}, {i * width}) & {(1 << width) - 1})"
        low = f"({fp} & {(1 << (i * width)) - 1})" if i else "0L"
        high = f"shiftleft(shiftrightunsigned({fp}, {(i + 1) * width}), {i * width})" if i < BLOCKS - 1 else "0L"
        other = f"({low} | {high})"
        for j in range(BLOCKS):
            sub = f"(shiftrightunsigned({other}, {j * inner}) & {(1 << inner) - 1})"
            keys.append(f"shiftleft({i * BLOCKS + j}L, 28) | shiftleft({block}, 12) | {sub}")
    return F.expr(f"array({', '.join(keys)})")


def near_links(prints: DataFrame, tile: int = TILE) -> DataFrame:
    """prints: distinct fp (long). Returns u, v: links whose components are those of all pairs within the radius."""
    keyed = prints.select("fp", F.explode(_tables("fp")).alias("key"))
    hot = cut(keyed.groupBy("key").count().where(f"count > {tile}").select("key", F.ceil(F.col("count") / tile).alias("tiles")), "hot")
    bucket = F.xxhash64("key", F.lit(0))
    if hot.isEmpty():
        work = keyed.select(bucket.alias("bucket"), "fp")
    else:
        joined = keyed.join(hot, "key", "left")
        own = F.pmod(F.xxhash64("fp"), F.col("tiles"))
        tiles = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda o: F.xxhash64("key", F.least(o, own), F.greatest(o, own)))
        work = joined.select(F.explode(F.when(F.col("tiles").isNull(), F.array(bucket)).otherwise(F.array_distinct(tiles))).alias("bucket"), "fp")
    return work.repartition("bucket").sortWithinPartitions("bucket", "fp").mapInArrow(_links, "u long, v long")


def simhash_near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id of the
    documents reachable over links of at most 3 differing bits).

    Null and wordless texts have fingerprint zero and link like any other. A null doc_id never names a component
    unless all of its documents have none. Repeated rows are rows of their own. Other columns are ignored; an empty
    table gives an empty table.
    """
    prints = cut(small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(by_rows(_fingerprints), "doc_id long, fp long"), "prints")
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    roots = connected_components(near_links(nodes.select("fp")))
    rooted = cut(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "rooted")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lows, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
