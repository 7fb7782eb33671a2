"""Substring dedup by seed and extend.

Seeds: of the k-word grams in every window of `words` words the smallest hash is the window's anchor (winnowing), so
two documents that share a window share its anchor. One aggregation finds the anchors that occur in more than one
document; only their smallest and largest doc_id are kept, whatever the number of copies.
Extension: a document that holds a shared anchor extends it both ways over every placement of a window round it. The
placements are hashed twice, with independent multipliers over independent word hashes, so that windows count as equal
by 64 and 24 bits (of 10**13 windows, 100 TB of text, 0.2 pairs are then expected to match falsely). One aggregation gives the smallest doc_id
that holds a window; a window that a smaller doc_id holds too is a repeat, and overlapping repeats merge into maximal
ones, whose words go. The rule asks for any smaller document, not for one partner, so extending against one other
document at a time would lose repeats; that is why placements are grouped and not pairs compared.
No pair of documents is formed at any point, so a passage that a third of all documents share costs a row for each
occurrence and no more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHashes, WordHashes, cut, drop, mix, small_batches, utf8, word_hashes

WORDS = 50
GRAM = 20
#: Words of a batch that are worked on together.
CHUNK = 400_000
_cache, _rolling, _second = WordHashes(), RollingHashes(), RollingHashes(0xD1342543DE82EF95)


def sliding_minimum(x: np.ndarray, k: int) -> np.ndarray:
    """Of the k items from each position on."""
    span = 1
    while span * 2 <= k:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (k - span)], x[k - span :]) if span < k else x


class Windows:
    """Windows of some documents laid end to end: starts, documents, anchors and hashes of those inside one document."""

    def __init__(self, words: list[list[bytes]], size: int = WORDS, gram: int = GRAM) -> None:
        lengths = np.array([len(w) for w in words], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        items = np.concatenate([word_hashes(w, _cache) for w in words]) if words else np.zeros(0, np.uint64)
        self.items, self.prefix, self.size = items, _rolling.prefix(items), size
        counts = np.maximum(lengths - size + 1, 0)
        self.doc = np.repeat(np.arange(len(words)), counts)
        self.at = np.arange(len(self.doc)) - np.repeat(np.cumsum(counts) - counts, counts) + self.offsets[self.doc]
        grams = _rolling.runs(self.prefix, gram)
        self.anchor = sliding_minimum(grams, size - gram + 1)[self.at].view(np.int64) if len(self.at) else np.zeros(0, np.int64)

    def hashes(self, which: np.ndarray) -> np.ndarray:
        return _rolling.runs(self.prefix, self.size)[self.at[which]].view(np.int64) if len(which) else np.zeros(0, np.int64)

    def checks(self, which: np.ndarray) -> np.ndarray:
        """Second hashes, independent of the first."""
        if not len(which):
            return np.zeros(0, np.int64)
        return _second.runs(_second.prefix(mix(self.items ^ np.uint64(0xA0761D6478BD642F))), self.size)[self.at[which]].view(np.int64)


def chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Rows whose texts have about CHUNK words together, and their words; a long text comes alone."""
    for batch in batches:
        at, words, total = 0, [], 0
        for i in range(batch.num_rows):
            text = batch.column(column)[i].as_py()
            words.append(text.split() if text else [])
            total += len(words[-1])
            if total >= CHUNK or i == batch.num_rows - 1:
                yield batch.slice(at, i + 1 - at), words
                at, words, total = i + 1, [], 0


def _anchors(size: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in chunks(batches, 1):
            w = Windows(words, size, gram)
            if len(w.doc):
                first = np.concatenate([[True], (w.anchor[1:] != w.anchor[:-1]) | (w.doc[1:] != w.doc[:-1])])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(w.doc[first])), pa.array(w.anchor[first])], ["doc_id", "anchor"])

    return run


def _member(values: np.ndarray, groups: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """Whether values[i] is in lists[groups[i]]; groups ascend."""
    out = np.zeros(len(values), bool)
    bounds = np.searchsorted(groups, np.arange(len(lists) + 1))
    for g, some in enumerate(lists):
        if len(some) and bounds[g] < bounds[g + 1]:
            out[bounds[g] : bounds[g + 1]] = np.isin(values[bounds[g] : bounds[g + 1]], some)
    return out


def _lists(column: pa.Array) -> list[np.ndarray]:
    return [np.zeros(0, np.int64) if x is None else np.array(x, np.int64) for x in column.to_pylist()]


def _extend(size: int, gram: int):
    """doc_id, text, provided, wanted: the document's shared anchors in which it is the first, or a later document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in chunks(batches, 1):
            w = Windows(words, size, gram)
            later = _member(w.anchor, w.doc, _lists(batch.column(3)))
            which = np.nonzero(later | _member(w.anchor, w.doc, _lists(batch.column(2))))[0]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(w.doc[which])), pa.array(w.hashes(which)), pa.array((w.checks(which) & 0xFFFFFF).astype(np.int32)), pa.array(later[which])], ["doc_id", "window", "check", "later"])

    return run


def _remove(size: int, gram: int, texts: bool, carried: tuple[str, ...]):
    """doc_id, text, wanted, repeats (window hashes), and what is carried along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in chunks(batches, 1):
            lists = _lists(batch.column(3))
            n_removed, digests, kept_texts, spans = [], [], [], []
            busy = [i for i, x in enumerate(lists) if len(x)]
            hit = {}
            if busy:
                w = Windows([words[i] for i in busy], size, gram)
                wanted = _lists(batch.column(2))
                which = np.nonzero(_member(w.anchor, w.doc, [wanted[i] for i in busy]))[0]
                which = which[_member(w.hashes(which), w.doc[which], [lists[i] for i in busy])]
                mark = np.zeros(w.offsets[-1] + 1, np.int64)
                np.add.at(mark, w.at[which], 1)
                np.add.at(mark, w.at[which] + size, -1)
                covered = np.cumsum(mark)[:-1] > 0
                hit = {i: covered[w.offsets[j] : w.offsets[j + 1]] for j, i in enumerate(busy)}
            for i, own in enumerate(words):
                gone = hit.get(i)
                if gone is None:
                    gone, left = np.zeros(0, bool), own
                else:
                    left = [x for x, g in zip(own, gone.tolist(), strict=True) if not g]
                edges = np.nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))[0].reshape(-1, 2)
                spans.append([{"start": int(a), "length": int(b - a)} for a, b in edges])
                text = b" ".join(left)
                n_removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(text).hexdigest())
                if texts:
                    kept_texts.append(text.decode() if len(left) < len(own) else batch.column(1)[i].as_py().decode())
            n_words = [len(x) for x in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))), *[pa.array(kept_texts, pa.string())] * texts, *batch.columns[4:]],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "repeats", *["kept_text"] * texts, *carried],
            )

    return run


def substring_dedup(docs: DataFrame, words: int = WORDS, gram: int = GRAM, texts: bool = False, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, repeats (maximal removed spans, in words), and
    with texts also kept_text, the kept words joined by one space, or the text itself where nothing goes. Columns
    named in carry follow; they must not have the names of the others.

    A word goes if a window of `words` consecutive words that covers it also starts in a document with a smaller
    doc_id; all windows are judged on the input. Null texts have no words; texts shorter than a window keep all. Rows
    with a null doc_id lose nothing and take nothing from others. Rows that repeat a doc_id are one document as to
    what others lose, and lose what smaller ids hold. Windows are compared by 88 bits of hashes. Other columns are
    ignored; an empty table gives an empty table.
    """
    if clash := {"doc_id", "n_words", "n_removed", "kept_sha256", "repeats", "kept_text"} & set(carry):
        raise ValueError(f"carried columns have names of the result's: {sorted(clash)}")
    texts_of = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("body"), *carry)
    seeds = cut(texts_of.where("doc_id is not null").select("doc_id", "body").mapInArrow(_anchors(words, gram), "doc_id long, anchor long"), "seeds")
    # counts are written before they are joined: a join of plain tables is one whose hot keys Spark can split
    shared = cut(seeds.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor", "low"), "shared")
    mine = seeds.join(shared, "anchor").groupBy("doc_id").agg(
        F.collect_set(F.when(F.col("doc_id") == F.col("low"), F.col("anchor"))).alias("provided"), F.collect_set(F.when(F.col("doc_id") != F.col("low"), F.col("anchor"))).alias("wanted")
    )
    joined = cut(texts_of.join(mine, "doc_id", "left").select("doc_id", "body", "provided", "wanted", *carry), "seeded")
    drop(seeds, shared)
    held = cut(joined.where("wanted is not null").select("doc_id", "body", "provided", "wanted").mapInArrow(_extend(words, gram), "doc_id long, window long, check int, later boolean"), "held")
    first = cut(held.groupBy("window", "check").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("window", "check", "low"), "first")
    gone = cut(held.where("later").join(first, ["window", "check"]).where("low < doc_id").groupBy("doc_id").agg(F.collect_set("window").alias("gone")), "gone")
    drop(held, first)
    schema = ", ".join(["doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<start:int,length:int>>", *["kept_text string"] * texts, *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)])
    whole = joined.where("wanted is null or size(wanted) = 0").select("doc_id", "body", "wanted", F.lit(None).cast("array<long>").alias("gone"), *carry)
    some = joined.where("size(wanted) > 0").join(gone, "doc_id", "left").select("doc_id", "body", "wanted", "gone", *carry)
    remove = _remove(words, gram, texts, tuple(carry))
    return whole.mapInArrow(remove, schema).unionByName(some.mapInArrow(remove, schema))
