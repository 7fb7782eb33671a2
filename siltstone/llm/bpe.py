"""BPE encoding and decoding by a table of distinct words.

Documents are split at ASCII white space; the blocks of words.py hold each distinct word once, every distinct word of
the corpus is encoded once, and its ids are joined back by position. Decoding joins the ids to the vocabulary's pieces,
a table whose size is the vocabulary's. The tokenizer splits at white space itself, so a text's ids are those of its
words; a tokenizer for which that does not hold is refused.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .words import Blocks, unpack, values_of, with_values, word_values

#: Pieces of words that a worker remembers before it starts anew.
PIECES_KEPT = 250_000
#: Blocks may be larger than the usual: only their positions and distinct words are held.
LIMITS = (6_000_000, 700_000, 32 << 20)
#: Composed Latin letters and signs, without white space and without the one letter whose lower case is two characters.
LATIN = regex.compile("[!-~\u00a1-\u012f\u0131-\u024f]*")


def _byte_letters() -> dict[int, int]:
    """The letters that stand for bytes: printable ones for themselves, the others from U+0100 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: 0x100 + i for i, b in enumerate(x for x in range(0x100) if x not in printable)}


def little(ids) -> bytes:
    """Little-endian 32-bit numbers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordEncoder:
    """Ids of single words (bytes without white space), by a tokenizers file whose pre-tokenizer drops white space."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        split = next((x for x in said["pre_tokenizer"].get("pretokenizers", []) if x["type"] == "Split"), None)
        byte_level = any(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in said["pre_tokenizer"].get("pretokenizers", []))
        if not byte_level or not split or split["behavior"] != "Removed" or not split["invert"] or said["post_processor"] or said["decoder"]:
            raise ValueError(f"{path}: not a tokenizer that drops white space and decodes to joined pieces")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split = regex.compile(split["pattern"]["Regex"])
        self.added = [x["content"] for x in said["added_tokens"]]
        self.openings = {x[0] for x in self.added}
        self.model = self.tokenizer.model
        self.byte_level = str.maketrans(_byte_letters())
        self.pieces: dict[str, bytes] = {}
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = self.ends_apart()

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: bytes) -> bytes:
        """Little-endian 32-bit ids."""
        known = self.pieces
        if word.isalpha():  # of bytes: ASCII letters
            low = word.lower().decode()
            return known.get(low) or self.piece(low)
        stem, last = word[:-1], word[-1:]
        if last in self.ends and stem.isalpha():
            low = stem.lower().decode()
            return (known.get(low) or self.piece(low)) + self.ends[last]
        text = word.decode()
        # normalisation changes nothing but the case of these letters, so their pieces can be remembered one by one
        simple = text.isprintable() if text.isascii() else LATIN.fullmatch(text)
        if not simple or (not self.openings.isdisjoint(text) and any(x in text for x in self.added)):
            return self.plain(text)
        low = text.lower()
        if low.isalpha():
            return known.get(low) or self.piece(low)
        return b"".join([known.get(x) or self.piece(x) for x in self.split.findall(low)])

    def piece(self, piece: str) -> bytes:
        """Ids of what the pre-tokenizer leaves whole, by the merges alone."""
        if len(self.pieces) >= PIECES_KEPT:
            self.pieces.clear()
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.byte_level)
        ids = self.pieces[piece] = little([x.id for x in self.model.tokenize(letters)])
        return ids

    def ends_apart(self) -> dict[bytes, bytes]:
        """Signs that the pre-tokenizer parts from letters before them, with their ids."""
        apart = [c for c in ".,;:!?)" if all(self.split.findall(stem + c) == [stem, c] for stem in ("a", "zz", "words")) and not any(c in x for x in self.added)]
        return {c.encode(): self.plain(c) for c in apart}


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@lru_cache(2)
def pieces(path: str) -> list[bytes]:
    """The id-to-piece table."""
    own = encoder(path)
    return [(own.tokenizer.id_to_token(i) or "").encode() for i in range(own.size)]


def encode_decode(docs: DataFrame, path: str, texts: bool = False, id_col: str = "doc_id", text_col: str = "text", limits: tuple[int, int, int] = LIMITS) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256 (little-endian 32-bit ids), decoded_sha256, and with
    texts also ids and decoded.

    Null counts as empty: no ids, decoded to the empty text. Repeated rows and null ids are kept as they are; other
    columns are ignored; an empty table gives an empty table. limits are those of a block (words.py).
    """
    split = F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), "")
    source = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), split.alias("text"), F.lit(True).alias("flag"))
    # ids that fit are halved for the shuffle
    width = "<u2" if encoder(path).size <= 1 << 16 else "<u4"

    def finish(own: pa.Table, joined: pa.Table) -> pa.Table:
        ids, table = values_of(joined), pieces(path)
        decoded = [b" ".join(map(table.__getitem__, np.frombuffer(x, width).tolist())) for x in ids]
        ids = [np.frombuffer(x, width).astype("<u4").tobytes() for x in ids]
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": [], "decoded": []} if texts else {})
        for body in own.column("body").to_pylist():
            at = unpack(body).tolist()
            all_ids = b"".join(map(ids.__getitem__, at))
            text = b" ".join(filter(None, map(decoded.__getitem__, at)))  # words of other white space have no ids
            out["n_tokens"].append(len(all_ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(all_ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(text).hexdigest())
            if texts:
                out["ids"].append(np.frombuffer(all_ids, "<u4").tolist())
                out["decoded"].append(text.decode())
        types = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "ids": pa.list_(pa.int32()), "decoded": pa.string()}
        return pa.table([own.column("doc_id").cast(pa.int64())] + [pa.array(v, types[k]) for k, v in out.items()], ["doc_id", *out])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * texts
    with Blocks(source, None, limits=limits) as blocks:
        values = word_values(blocks, lambda word: np.frombuffer(encoder(path).word(word), "<u4").astype(width).tobytes())
        return cut(with_values(blocks, values, finish, schema), "encoded")
