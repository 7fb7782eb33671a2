"""Language-model scoring by a log-frequency Bloom filter.

Counts of word pairs are quantised to q = 1 + floor(log2 count) and kept in a Bloom filter as the q elements
(pair, 1) .. (pair, q); probing (pair, 1), (pair, 2) .. until one is missing gives q back, never too low. The filter is
made of shards by the pair's hash; each is built where its counts are summed. Its size follows the number of distinct
pairs. Up to MOST_BYTES all shards are broadcast together; beyond that none leaves its task: the blocks send each shard
the distinct pairs they have in it and get their levels back, so the scores are those that the broadcast would give.
Counts of single words are exact: each distinct word is counted once and the counts are joined back to the documents'
blocks (words.py), whatever the size of the vocabulary.

The model is P(w | v) = (c(v, w) + MU * P(w)) / (c(v) + MU) with P(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)); the word
before the first is the end of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, mix, small_batches, utf8
from .words import Blocks, counts_of, input_bytes, pack, pack64, placed_words, unpack, unpack64, with_values, word_values

#: No word contains white space, so this is none.
END = b" "
MU = 100.0
BITS_AN_ENTRY = 10
PROBES = 6
#: Filters up to this size are broadcast, larger ones probed shard by shard.
MOST_BYTES = 256 << 20
#: Shards: at least so many, four for each shuffle partition, and one for so many bytes of input.
LEAST_SHARDS, SHARD_INPUT = 256, 8 << 20
#: Shards whose pairs are counted to size the filter: one in so many.
SIZED_BY = 16
#: Positions that are scored, and pairs that are probed, at a time.
CHUNK = 500_000


def lower_words(text: bytes) -> list[bytes]:
    return text.lower().split()


def _hash_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + mix(second))


def before(positions: np.ndarray, ends: np.ndarray, end: int) -> np.ndarray:
    """The position of the word before each; of a text's first word, the end's."""
    out = np.empty_like(positions)
    out[1:] = positions[:-1]
    starts = np.concatenate([[0], ends[:-1]])
    out[starts[starts < len(out)]] = end
    return out


def pack_pairs(x: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as differences."""
    return pack64(np.diff(x, prepend=np.uint64(0)))


def unpack_pairs(body: bytes) -> np.ndarray:
    return np.cumsum(unpack64(body), dtype=np.uint64)


def starts_of_runs(x: np.ndarray) -> np.ndarray:
    """Where values of the ascending x first come."""
    return np.nonzero(np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]))[0]


def tally(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and how often they come."""
    x = np.sort(x)
    first = starts_of_runs(x)
    return x[first], np.diff(first, append=len(x))


def pair_counts(shards: int):
    """For block_rows: the block's distinct training pairs with their counts, a row for each shard."""

    def extra(positions: np.ndarray, marks: np.ndarray, ends: np.ndarray, words: list[bytes]) -> Iterator[tuple[int, bytes, int]]:
        hashes = _hash_of(words)
        prior = before(positions, ends, words.index(END))
        pairs, counts = tally(pair_hashes(hashes[prior[marks]], hashes[positions[marks]]))
        for s, a, b in by_shard(pairs, shards):
            yield s, pack_pairs(pairs[a:b]) + pack(counts[a:b]), b - a

    return extra


def by_shard(pairs: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    """Of ascending pairs: each shard that has some, with where they begin and end."""
    shift = np.uint64(64 - (shards.bit_length() - 1))
    bounds = np.searchsorted(pairs >> shift, np.arange(shards + 1).astype(np.uint64)).tolist()
    return ((s, a, b) for s, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if a < b)


def block_pairs(own: pa.Table) -> np.ndarray:
    """The distinct pairs of a block's documents, in training or not, ascending."""
    kind = own.column("kind").to_numpy()
    listed = own.filter(pa.array(kind == 1))
    words = placed_words(listed)
    bodies = [unpack(x) for x in own.filter(pa.array(kind == 0)).column("body").to_pylist()]
    return distinct_pairs(np.concatenate(bodies), np.cumsum([len(x) for x in bodies]), words)


def distinct_pairs(positions: np.ndarray, ends: np.ndarray, words: list[bytes]) -> np.ndarray:
    hashes = _hash_of(words)
    return tally(pair_hashes(hashes[before(positions, ends, words.index(END))], hashes[positions]))[0]


def merged(bodies: list[bytes], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of one shard and their counts in all blocks."""
    pairs = np.concatenate([unpack_pairs(x[: 8 * n]) for x, n in zip(bodies, sizes, strict=True)])
    counts = np.concatenate([unpack(x[8 * n :]) for x, n in zip(bodies, sizes, strict=True)]).astype(np.int64)
    order = np.argsort(pairs)
    pairs, counts = pairs[order], counts[order]
    first = starts_of_runs(pairs)
    return pairs[first], np.add.reduceat(counts, first)


def levels(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 count)."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def _element(pairs: np.ndarray, level: int) -> np.ndarray:
    return mix(pairs + np.uint64(level * 0xD6E8FEB86659FD93 & (1 << 64) - 1))


def places(pairs: np.ndarray, level: int, bits: int) -> Iterator[np.ndarray]:
    """Bit by bit, where the elements (pair, level) are in a shard of so many bits."""
    one = _element(pairs, level)
    step = mix(one) | np.uint64(1)
    for _ in range(PROBES):
        yield (one % np.uint64(bits)).astype(np.int64)
        one = one + step


def shard_filter(pairs: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    marks = np.zeros(bits, bool)
    q = levels(counts)
    for level in range(1, int(q.max(initial=0)) + 1):
        for at in places(pairs[q >= level], level, bits):
            marks[at] = True
    return np.packbits(marks, bitorder="little").tobytes()


class PairFilter:
    """top: no level is above it."""

    def __init__(self, shards: int, bits: int, bodies: dict[int, bytes], top: int = 63) -> None:
        self.shards, self.bits, self.top = shards, bits, top
        self.body = np.zeros((shards, bits // 8), np.uint8)
        for s, x in bodies.items():
            self.body[s] = np.frombuffer(x, np.uint8)

    def counts(self, pairs: np.ndarray) -> np.ndarray:
        """The lower edge of each pair's quantised count; 0 for none."""
        shard = (pairs >> np.uint64(64 - (self.shards.bit_length() - 1))).astype(np.int64) if self.shards > 1 else np.zeros(len(pairs), np.int64)
        out = np.zeros(len(pairs), np.int64)
        going = np.arange(len(pairs))
        level = 1
        while len(going) and level <= self.top:
            left = going
            for probe in range(PROBES):
                # probes are few for most, so each is worked out only for those still in
                one = _element(pairs[left], level)
                at = ((one + np.uint64(probe) * (mix(one) | np.uint64(1))) % np.uint64(self.bits)).astype(np.int64)
                left = left[(self.body[shard[left], at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
                if not len(left):
                    break
            out[left] = 1 << (level - 1)
            going, level = left, level + 1
        return out


def answers(parts: DataFrame, blocks: Blocks, shards: int, bits: int, top: int) -> DataFrame:
    """block, at, body: a byte for each distinct pair that the block has in shard `at`, in order: the pair's level.

    A task builds the filter of one shard at a time and answers the blocks' pairs as they stream by.
    """

    def ask(own: pa.Table) -> pa.Table:
        pairs = block_pairs(own)
        found = [(s, pack_pairs(pairs[a:b])) for s, a, b in by_shard(pairs, shards)]
        return pa.table({"block": pa.array([own.column("block")[0].as_py()] * len(found), pa.int64()), "at": pa.array([x[0] for x in found], pa.int32()), "body": pa.array([x[1] for x in found], pa.binary()), "n": pa.array([len(x[1]) // 8 for x in found], pa.int64())})

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, bodies, sizes, probed, waiting = None, [], [], None, []

        def say() -> pa.RecordBatch:
            found = probed.counts(np.concatenate([x for _, x in waiting]))
            said = np.where(found > 0, levels(found), 0).astype(np.uint8)
            parts = np.split(said, np.cumsum([len(x) for _, x in waiting])[:-1])
            out = [pa.array([k for k, _ in waiting], pa.int64()), pa.array([shard] * len(waiting), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())]
            waiting.clear()
            return pa.RecordBatch.from_arrays(out, ["block", "at", "body"])

        for batch in batches:
            for row in range(batch.num_rows):
                block, at, body, n = (batch.column(k)[row].as_py() for k in range(4))
                if at != shard:
                    if waiting:
                        yield say()
                    shard, bodies, sizes, probed = at, [], [], None
                if block is None:
                    bodies.append(body)
                    sizes.append(n)
                    continue
                if probed is None:
                    probed = PairFilter(1, bits, {0: shard_filter(*merged(bodies, sizes), bits)} if bodies else {}, top)
                    bodies, sizes = [], []
                waiting.append((block, unpack_pairs(body)))
                if sum(len(x) for _, x in waiting) >= CHUNK // 4:
                    yield say()
        if waiting:
            yield say()

    asked = blocks.table.where("kind in (0, 1)").select("block", "kind", "places", "body").groupBy("block").applyInArrow(ask, "block long, at int, body binary, n long")
    rows = parts.select(F.lit(None).cast("long").alias("block"), "at", "body", "n").unionByName(asked)
    return rows.repartition("at").sortWithinPartitions("at", F.col("block").asc_nulls_first()).mapInArrow(answer, "block long, at int, body binary")


def score(docs: DataFrame, held_out: F.Column, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = MOST_BYTES, limits: tuple[int, int, int] | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows that are not held out. Tokens are words (ASCII white space between, A-Z lower-cased) and one end
    a text, so a null or empty text is one token. Repeated rows count as often as they occur; with nothing to learn
    from, N and V are 0 and nothing is known. Other columns are ignored; an empty table gives an empty table. Filters
    of up to most_bytes are broadcast. limits are those of a block (words.py),
    chunk the positions of a block that are scored at a time.
    """
    spark = docs.sparkSession
    source = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"), (~held_out).alias("flag"))
    wanted = max(LEAST_SHARDS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(source) // SHARD_INPUT)
    shards = 1 << (wanted - 1).bit_length()
    with Blocks(source, lower_words, END, flagged=True, extra=pair_counts(shards), limits=limits) as blocks:
        return _scored(spark, blocks, shards, most_bytes, chunk)


def _scored(spark: SparkSession, blocks: Blocks, shards: int, most_bytes: int, chunk: int) -> DataFrame:
    table = blocks.table
    values = cut(word_values(blocks), "counts")
    total = table.where("kind = 0 and flag").agg(F.sum("n")).first()[0] or 0
    distinct = values.agg(F.sum("fresh")).first()[0] or 0

    parts = table.where("kind = 2").select("at", "body", "n")

    def count(own: pa.Table) -> pa.Table:
        pairs, counts = merged(own.column("body").to_pylist(), own.column("n").to_pylist())
        return pa.table({"entries": pa.array([int(levels(counts).sum())], pa.int64())})

    some = max(1, shards // SIZED_BY)
    entries = (parts.where(F.col("at") < some).groupBy("at").applyInArrow(count, "entries long").agg(F.sum("entries")).first()[0] or 0) * shards // some
    size = max(1 << 16, entries * BITS_AN_ENTRY // 8)
    top = int(levels(np.array([total]))[0])  # no pair occurs more often than all tokens
    bits = -(-size * 8 // shards // 8) * 8

    def build(own: pa.Table) -> pa.Table:
        body = shard_filter(*merged(own.column("body").to_pylist(), own.column("n").to_pylist()), bits)
        return pa.table({"at": own.column("at").slice(0, 1), "filter": pa.array([body], pa.binary())})

    shared = asked = None
    if size <= most_bytes:
        # written first, so that shards are built side by side; they then come to the driver a file at a time
        written = cut(parts.groupBy("at").applyInArrow(build, "at int, filter binary"), "filter")
        whole = PairFilter(shards, bits, {}, top)
        for r in written.toLocalIterator():
            whole.body[r["at"]] = np.frombuffer(r["filter"], np.uint8)
        shared = spark.sparkContext.broadcast(whole)  # at most most_bytes
        drop(written)
    else:
        asked = answers(parts, blocks, shards, bits, top)

    def finish(own: pa.Table, joined: pa.Table, words: list[bytes], said: pa.Table | None = None) -> pa.Table:
        counts = counts_of(joined)
        hashes = _hash_of(words)
        single = (counts + 0.5) / (total + 0.5 * (distinct + 1))
        logs = np.log10(single)
        end = words.index(END)
        bodies = [unpack(x).astype(np.int64) for x in own.column("body").to_pylist()]
        lengths = np.array([len(x) for x in bodies], np.int64)  # none is 0: every text has its end
        ends = np.cumsum(lengths)
        positions = np.concatenate(bodies)
        prior = before(positions, ends, end)
        known = counts[positions] > 0
        if said is not None:
            asked_pairs = distinct_pairs(positions, ends, words)
            told = np.frombuffer(b"".join(said.sort_by("at").column("body").to_pylist()), np.uint8)
        base, scores, n_known = np.zeros(len(bodies)), np.zeros(len(bodies)), np.zeros(len(bodies), np.int64)
        for at in range(0, len(positions), chunk):
            here, prev = positions[at : at + chunk], prior[at : at + chunk]
            pairs, place = np.unique(pair_hashes(hashes[prev], hashes[here]), return_inverse=True)
            if said is None:
                found = shared.value.counts(pairs)
            else:
                level = told[np.searchsorted(asked_pairs, pairs)].astype(np.int64)
                found = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
            seen = np.minimum(found[place], np.minimum(counts[here], counts[prev]))
            p = (seen + MU * single[here]) / (counts[prev] + MU)
            # texts that begin before this chunk go on with their first words in it
            first = int(np.searchsorted(ends, at, side="right"))
            last = int(np.searchsorted(ends, at + len(here), side="left")) + 1
            starts = np.maximum((ends - lengths)[first:last] - at, 0)
            base[first:last] += np.add.reduceat(logs[here], starts)
            scores[first:last] += np.add.reduceat(np.log10(p), starts)
            n_known[first:last] += np.add.reduceat(known[at : at + chunk].astype(np.int64), starts)
        return pa.table(
            {
                "doc_id": own.column("doc_id"),
                "held_out": pa.array([not x for x in own.column("flag").to_pylist()], pa.bool_()),
                "n_tokens": own.column("n"),
                "n_known": pa.array(n_known),
                "train_tokens": pa.array(np.full(len(bodies), total, np.int64)),
                "base_score": pa.array(base),
                "score": pa.array(scores),
            }
        )

    scored = with_values(blocks, values, finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", words=True, more=asked)
    out = cut(scored, "scores")
    if shared is not None:
        shared.destroy()
    drop(values)
    return out
