"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Texts and templates become five-word shingles of lower-cased words without the punctuation round them. Windows of 1, 2,
4, 16 or 64 shingles, a quarter of their length apart, get the minima of BANDS * ROWS hash functions; a window whose
minima agree with a template window's in all rows of a band is a candidate. Template windows start at every shingle and
are the widest that any text span with 0.8 of the template's shingles must hold whole, so a copy that contains 0.8 of a
template in one run holds a text window equal to one of them, and a window pair of Jaccard similarity 0.8 collides with
probability 1 - (1 - 0.8**ROWS)**BANDS = 0.9997. The similarity of windows of one shingle is 0 or 1; one band tells.
Candidates are verified on the words themselves: the share of the template's shingles that one span of the text, a
quarter longer than the template, contains. Where spans of found templates meet, the one with the greatest share stays,
of equal ones the longest template, then the first by name, so that a licence is not reported as its sister too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, RollingHashes, mix, small_batches, utf8
from .license_templates import TEMPLATES
from .substring_dedup import chunks, sliding_minimum

SHINGLE = 5
LEAST = 0.8
ROWS, BANDS = 2, 8
WIDTHS = (1, 2, 4, 16, 64)
SPARE = 1.25
_PUNCTUATION = b".,;:!?()[]{}<>\"'`*#/-_=|"

def plain(word: bytes) -> bytes:
    return word.lower().strip(_PUNCTUATION)


class _PlainHashes(Remembered):
    def value(self, word: bytes) -> int:
        return xxhash.xxh64_intdigest(plain(word))


_cache, _rolling = _PlainHashes(), RollingHashes()


def shingles(words: list[bytes]) -> np.ndarray:
    """Hashes of all runs of five of the words laid end to end."""
    return _rolling.runs(_rolling.prefix(np.fromiter(map(_cache.__getitem__, words), np.uint64, len(words))), SHINGLE)


_FACTORS = mix(np.arange(1, 2 * ROWS * BANDS + 1, dtype=np.uint64))


def band_keys(hashes: np.ndarray, starts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each band, the keys of the windows of `width` shingles at starts."""
    for band in range(BANDS if width > 1 else 1):
        key = np.zeros(len(starts), np.uint64)
        for row in range(ROWS):
            i = 2 * (band * ROWS + row)
            low = sliding_minimum((hashes ^ _FACTORS[i]) * (_FACTORS[i + 1] | np.uint64(1)), width)
            key = mix(key * np.uint64(31) + low[starts])
        yield key


def width_of(n: int) -> int:
    """The widest windows of which a run of 0.8 of a template's n shingles holds one whole, a step apart."""
    return max(w for w in WIDTHS if w == 1 or w + max(1, w // 4) - 1 <= math.ceil(LEAST * n))


class Scanner:
    def __init__(self, templates: dict[str, str]) -> None:
        self.names = sorted(templates)
        self.words = [[plain(w) for w in templates[k].encode().split()] for k in self.names]
        if short := [k for k, w in zip(self.names, self.words, strict=True) if len(w) < SHINGLE]:
            raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
        self.sets = [{tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)} for w in self.words]
        found: dict[tuple[int, int], list] = {}
        for t, words in enumerate(self.words):
            own = shingles(words)
            width = width_of(len(own))
            for band, keys in enumerate(band_keys(own, np.arange(len(own) - width + 1), width)):
                found.setdefault((width, band), []).extend((k, t) for k in keys.tolist())
        self.keys = {}
        for at, pairs in found.items():
            pairs = sorted(set(pairs))
            self.keys[at] = np.array([k for k, _ in pairs], np.uint64), np.array([t for _, t in pairs])

    def candidates(self, words: list[list[bytes]]) -> set[tuple[int, int]]:
        """(document, template) pairs that share a band."""
        lengths = np.array([len(w) for w in words])
        ends = np.cumsum(lengths)
        hashes = shingles([x for w in words for x in w])
        out: set[tuple[int, int]] = set()
        for width in WIDTHS:
            if (width, 0) not in self.keys:
                continue
            step = max(1, width // 4)
            counts = np.maximum(0, -(-(lengths - SHINGLE + 1 - width + 1) // step))
            doc = np.repeat(np.arange(len(words)), counts)
            starts = (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * step + (ends - lengths)[doc]
            if not len(starts):
                continue
            for band, keys in enumerate(band_keys(hashes, starts, width)):
                known, templates = self.keys[width, band]
                first = np.searchsorted(known, keys)
                hit = np.nonzero(known[np.minimum(first, len(known) - 1)] == keys)[0]
                last = np.searchsorted(known, keys[hit], side="right")
                for d, a, b in zip(doc[hit].tolist(), first[hit].tolist(), last.tolist(), strict=True):
                    out.update((d, t) for t in templates[a:b].tolist())
        return out

    def verify(self, own: list[bytes], template: int) -> tuple[float, int, int]:
        """own: plain words. The greatest share of the template's shingles in one span, where the first such span
        starts, and the words from there to its last shingle's end."""
        wanted = self.sets[template]
        span = math.ceil(len(wanted) * SPARE)
        places = [(i, x) for i in range(len(own) - SHINGLE + 1) if (x := tuple(own[i : i + SHINGLE])) in wanted]
        best, where, stop, low, held = 0, 0, 0, 0, {}
        for i, x in places:
            held[x] = held.get(x, 0) + 1
            while places[low][0] <= i - span:
                y = places[low][1]
                held[y] -= 1
                if not held[y]:
                    del held[y]
                low += 1
            if len(held) > best:
                best, where, stop = len(held), places[low][0], i + SHINGLE
        return best / len(wanted), where, stop

    def found(self, words: list[bytes], templates: list[int], least: float) -> list[tuple[int, float, int]]:
        """Template, share and first word of those of at least that share whose spans no better one has."""
        own = [plain(w) for w in words]
        hits = []
        for t in templates:
            share, where, stop = self.verify(own, t)
            if share >= least:
                hits.append((-share, -len(self.sets[t]), self.names[t], t, where, stop))
        kept: list[tuple] = []
        for hit in sorted(hits):
            if all(hit[5] <= k[4] or k[5] <= hit[4] for k in kept):
                kept.append(hit)
        return [(t, -share, where) for share, _, _, t, where, _ in kept]


@lru_cache(4)
def scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(dict(templates))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and template found in it: doc_id, license (a template's name up to a slash), template,
    containment (least to 1), first_word (where its best span starts, from 0).

    Words are lower-cased (A-Z) and stripped of punctuation. Null, empty and short texts hold no template. Repeated
    rows and null ids give rows of their own. Other columns are ignored; an empty table gives an empty table. Templates
    are a fixed list that goes to every task.
    """
    given = tuple(sorted((TEMPLATES if templates is None else templates).items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(given)
        for batch, words in chunks(batches, 1):
            out = []
            by_document: dict[int, list[int]] = {}
            for d, t in sorted(own.candidates(words)):
                by_document.setdefault(d, []).append(t)
            for d, some in by_document.items():
                for t, share, where in own.found(words[d], some, least):
                    out.append((batch.column(0)[d].as_py(), own.names[t].split("/")[0], own.names[t], share, where))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64()), strict=True)], ["doc_id", "license", "template", "containment", "first_word"])

    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(run, "doc_id long, license string, template string, containment double, first_word long")
