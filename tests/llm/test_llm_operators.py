"""The operators of the llm subpackage against brute force, on awkward rows and on the smallest tables."""

import hashlib
import math
import random
import re
import sys
import unicodedata
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from compare import duck_rows, spark_rows  # noqa: E402

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
_RNG = random.Random(5)
_VOCABULARY = ["".join(_RNG.choices("abcdefgh", k=_RNG.randint(1, 6))) for _ in range(300)]
PASSAGE = " ".join(_RNG.choices(_VOCABULARY, k=70))


def words(n):
    return " ".join(_RNG.choices(_VOCABULARY, k=n))


LONG = words(30_000)
TEXTS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one  two"), (6, "one\ttwo"), (7, "ONE TWO"), (8, LONG), (9, LONG + " end"), (10, LONG), (10, LONG), (11, words(40) + " " + PASSAGE + " " + words(30)),
    (12, PASSAGE), (13, PASSAGE + " " + words(5)), (14, words(120)), (14, words(120)), (None, "no id here"), (None, "one two"), (15, "x" * 70_000), (16, "café CAFÉ İstanbul ΣΑΣ don't we'll 42 <|endoftext|>x"),
    (17, "日本語 テキスト 🙂🙂 a b\x1cc ́x"), (18, "Licensed under the Apache License, Version 2.0."), (19, "see: licensed under the Apache license version 2.0"), (20, "1234 --- !!!"), (21, PASSAGE[:200]), (22, PASSAGE[:200]),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, kept string, rest string, window int, block string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if (i or 0) % 2 else None, "src", len(t or ""), "x", "y", "z", 1, "b") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_exact_dedup(docs, empty):
    from siltstone.llm.exact_dedup import exact_dedup

    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), i == keep, sha(t)) for i in ids)
    assert of(exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    assert exact_dedup(empty).count() == 0


def test_exact_dedup_of_many_rounds(spark, monkeypatch):
    """Groups that part late, among rows without ids and with one id, and a group that holds a third of all rows."""
    from siltstone.llm import exact_dedup as m

    monkeypatch.setattr(m, "FIRST_BLOCK", 2)
    stems = ["a" * 40, "a" * 39 + "b", "a" * 40 + "c", "a", "aa", "", "\u00e9" * 20, "\u00e9" * 20 + "x"]
    rows = [(i, t) for t in stems for i in (None, None, 5, 5, 9)] + [(100 + i, "a" * 30 + "hot") for i in range(30)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), i == keep, sha(t)) for i in ids)
    got = m.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert of(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want




def test_chat(spark):
    from siltstone.llm import chat

    says = "</s>[INST] ok [/INST] \\ <|image:3|> \\\\[INST]"
    assert chat.unescape(chat.escape(says)) == says
    assert not any(c in chat.escape(says) for c in chat.CONTROL)
    rows = [(-7, 0, "user", says), (-7, 1, "assistant", says), (1, 1, "assistant", None), (1, 0, "system", "s"), (1, 1, "assistant", "z"), (None, 0, None, "x"), (2, None, "user", "late"), (2, 0, "[INST]", "odd role")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    formatted = chat.format_conversations(turns)
    got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t, r or "", x or ""))
    for c, own in by.items():
        own.sort(key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(own), sha("".join(f"{r}\n{x}\n" for _, _, r, x in own)))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))
    whole = "".join(r["formatted"] for r in formatted.where("conv_id = -7").orderBy("ordinal").collect())
    assert got[-7]["formatted_chars"] == len(whole)
    assert [(r, c) for r, c, _, _ in chat.split_turns(whole)] == [("user", says), ("assistant", says)]
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


def test_chat_parts(spark):
    from siltstone.llm import chat

    parts = '[{"type":"text","text":"look [INST]"},{"type":"image","ref":"a.png","width":1024,"height":513},{"type":"audio","ref":"b.wav","seconds":2.5},{"type":"document","ref":"c.pdf","pages":3}]'
    rows = chat.format_conversations(spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", '[{"type":"image","ref":"d"}]')], "conv_id long, turn long, role string, text string"), parts=True).orderBy("ordinal").collect()
    assert rows[0]["formatted"] == "<s>user[INST]look [\\INST]<|image:0|><|audio:1|><|document:2|>[/INST]</s>"
    assert [(a["number"], a["kind"], a["ref"], a["tokens"]) for a in rows[0]["attachments"]] == [(0, "image", "a.png", 4 * 256), (1, "audio", "b.wav", 63), (2, "document", "c.pdf", 1800)]
    assert rows[1]["attachments"][0]["number"] == 3
    with pytest.raises(ValueError):
        chat.Flattener().visit({"type": "video"})


def brute_components(prints, radius=3):
    ids = sorted(prints, key=lambda k: (k is None, k or 0))
    label = {p: p for p in set(prints.values())}

    def root(p):
        while label[p] != p:
            p = label[p]
        return p

    every = list(label)
    for i, a in enumerate(every):
        for b in every[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                label[root(a)] = root(b)
    low = defaultdict(list)
    for k in ids:
        low[root(prints[k])].append(k)
    return {p: min(x for x in low[root(p)] if x is not None) if any(x is not None for x in low[root(p)]) else None for p in every}


def fingerprint(text):
    own = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", own)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(docs, empty, small):
    from siltstone.llm.simhash import simhash_near_dedup

    for df in (docs.where("doc_id is not null"), small):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        prints = {(i, n): fingerprint(t) for n, (i, t) in enumerate(rows)}
        named = brute_components(prints)
        want = Counter((k[0], f"{p:016x}", named[p][0]) for k, p in prints.items())
        assert of(simhash_near_dedup(df), "doc_id", "fingerprint", "component_id") == want
    assert simhash_near_dedup(docs.where("doc_id is null")).where("component_id is null").count() == 2
    assert simhash_near_dedup(empty).count() == 0


@pytest.mark.parametrize("tile", [8, 2048])
def test_simhash_links(spark, tile):
    from siltstone.llm.components import connected_components
    from siltstone.llm.simhash import near_links

    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 12).astype(np.uint64)
    flips = sum(np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64) for _ in range(2))
    prints = np.unique(np.concatenate([centres[rng.integers(0, 12, 400)] ^ flips, rng.integers(0, 1 << 63, 50).astype(np.uint64)]))
    signed = [int(x) for x in prints.view(np.int64)]
    roots = {r["node"]: r["root"] for r in connected_components(near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), tile)).collect()}
    label = dict(zip(signed, signed, strict=True))
    changed = True
    close = [(signed[i], signed[j]) for i in range(len(prints)) for j in range(i) if int(prints[i] ^ prints[j]).bit_count() <= 3]
    while changed:
        changed = False
        for a, b in close:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    assert {x: roots.get(x, x) for x in signed} == label


def test_bit_slices():
    from siltstone.llm.simhash import lanes_within, links_of_large, planes_of, settle

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(0, 1 << 63, 100).astype(np.uint64), np.arange(60, dtype=np.uint64)])
    for radius in (0, 1, 3, 5):
        flips = np.where(x[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1), ~np.uint64(0), np.uint64(0))
        lanes = np.unpackbits(lanes_within(planes_of(x), flips, radius).view(np.uint8), axis=1, bitorder="little")[:, : len(x)]
        near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
        assert (lanes.astype(bool) == near).all()
        u, v = links_of_large(x, radius)
        assert (settle(np.arange(len(x)), u, v) == settle(np.arange(len(x)), *np.nonzero(near))).all()


def test_fingerprints(docs, empty, spark):
    from siltstone.llm.minhash import edit_fingerprints, edited, likeness, signature

    rows = sorted(((i is not None, i or 0, t or "", i) for i, t in TEXTS))
    want = Counter((i, len(t), sha(edited(t, rows[(k + 1) % len(rows)][2]))) for k, (_, _, t, i) in enumerate(rows))
    got = edit_fingerprints(docs).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fingerprint"] == by[3]["fingerprint"] == "" and by[21]["fingerprint"] == by[22]["fingerprint"]
    assert by[21]["near_next"] == 1.0 and by[1]["near_next"] == 1.0
    assert edit_fingerprints(empty).count() == 0
    alone = edit_fingerprints(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == sha("a b a b")
    rng = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.9):
        a = rng.integers(0, 1 << 63, 4000).astype(np.uint64) * np.uint64(2)
        b = np.concatenate([a[: int(4000 * share)], rng.integers(0, 1 << 63, 4000 - int(4000 * share)).astype(np.uint64) * np.uint64(2)])
        assert abs(likeness(signature(a), signature(b)) - share / (2 - share)) < 0.1


def shingle_set(text):
    words = text.encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def exact_likeness(a, b):
    x, y = shingle_set(a), shingle_set(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_fingerprints_against_exact_likeness(small):
    from siltstone.llm.minhash import edit_fingerprints, edited

    rows = sorted((r["doc_id"], r["text"] or "") for r in small.select("doc_id", "text").collect())
    after = {i: rows[(k + 1) % len(rows)][1] for k, (i, _) in enumerate(rows)}
    texts, got = dict(rows), edit_fingerprints(small).collect()
    off = [r["near_edited"] - exact_likeness(texts[r["doc_id"]], edited(texts[r["doc_id"]], after[r["doc_id"]])) for r in got]
    off += [r["near_next"] - exact_likeness(texts[r["doc_id"]], after[r["doc_id"]]) for r in got]
    long = [x for x, r in zip(off, got * 2, strict=True) if len(texts[r["doc_id"]].split()) > 60]
    assert len(got) == len(rows) and abs(np.mean(off)) < 0.03 and np.abs(long).max() < 0.2 and np.abs(long).mean() < 0.03


def test_densification_of_few_shingles():
    from siltstone.llm.minhash import signature

    one = np.array([1 << 40], np.uint64)
    assert (signature(one) == signature(np.repeat(one, 3))).all() and len(signature(one)) == 512
    rng, same = np.random.default_rng(4), []
    for _ in range(300):
        a, b, c = rng.integers(0, 1 << 63, 3).astype(np.uint64) * np.uint64(2)
        same.append((signature(np.array([a, b])) == signature(np.array([a, c]))).mean())
    assert abs((np.mean(same) - 1 / 16) / (15 / 16) - 1 / 3) < 0.06


def removed(rows, size):
    own = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in own:
        for s in range(len(w) - size + 1 if i is not None else 0):
            k = tuple(w[s : s + size])
            first[k] = min(first.get(k, i), i)
    for i, w in own:
        gone = [False] * len(w)
        for s in range(len(w) - size + 1 if i is not None else 0):
            if first[tuple(w[s : s + size])] < i:
                gone[s : s + size] = [True] * size
        yield i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))


def first_windows(rows, size=50):
    first = {}
    for j, x in rows:
        w = (x or "").encode().split()
        for s in range(len(w) - size + 1 if j is not None else 0):
            k = tuple(w[s : s + size])
            first[k] = min(first.get(k, j), j)
    return first


def left_words(first, i, t, size=50):
    """The words of the text t of document i that stay."""
    w = t.encode().split()
    gone = [False] * len(w)
    for s in range(len(w) - size + 1 if i is not None else 0):
        if first[tuple(w[s : s + size])] < i:
            gone[s : s + size] = [True] * size
    return [x.decode() for x, g in zip(w, gone, strict=True) if not g]


def test_substring_dedup(docs, empty):
    from siltstone.llm.substring_dedup import substring_dedup

    rows = [(i, t if t != LONG and t != LONG + " end" else " ".join(t.split()[:400])) for i, t in TEXTS]
    df = docs.sparkSession.createDataFrame(rows, "doc_id long, text string").withColumns({"window": F.lit(1), "body": F.lit("x")})
    got = substring_dedup(df, texts=True)
    assert of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == Counter(removed(rows, 50))
    by = {r["doc_id"]: r for r in got.where("doc_id = 13").collect()}
    assert [tuple(x) for x in by[13]["repeats"]] == [(0, 70)]
    assert of(substring_dedup(df, words=20, gram=7), "doc_id", "n_words", "n_removed", "kept_sha256") == Counter(removed(rows, 20))
    assert substring_dedup(empty).count() == 0
    whole = {r["doc_id"]: r["n_removed"] for r in substring_dedup(docs.where("doc_id in (8, 9, 10)")).collect()}
    assert whole == {8: 0, 9: 30_000, 10: 30_000}


def library(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_packing(docs, empty):
    from siltstone.llm.packing import pack, plan

    got = pack(docs, PATH).collect()
    texts = Counter()
    for i, t in TEXTS:
        ids = [*library(t or ""), 0]
        texts.update((i, k, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 2048)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == texts
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 2048) + 1
    assert pack(empty, PATH).count() == 0
    assert plan({}) == []
    assert len({s for _, _, s, _ in plan({3: 1, 5: 1, 8: 1}, 8)}) == 2


def test_language_model(small, docs, empty):
    from siltstone.llm import language_model as m

    def held(i):
        return i is not None and zlib.crc32(str(i).encode()) % 5 == 1

    ask = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    for df in (docs, small):
        rows = [(r["doc_id"], [*(r["text"] or "").encode().lower().split(), b" "]) for r in df.collect()]
        c, pairs = Counter(), Counter()
        for i, x in rows:
            if not held(i):
                c.update(x)
                pairs.update(zip([b" ", *x[:-1]], x, strict=True))
        total, distinct = sum(c.values()), len(c)
        p = lambda w: (c[w] + 0.5) / (total + 0.5 * (distinct + 1))  # noqa: E731, B023
        want = Counter((i, held(i), len(x), sum(c[w] > 0 for w in x), total, round(sum(math.log10(p(w)) for w in x), 5)) for i, x in rows)
        got = m.score(df, ask).collect()
        assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
        exact = sum(math.log10((min(1 << (n.bit_length() - 1), c[v], c[w]) if (n := pairs[v, w]) else 0) + m.MU * p(w)) - math.log10(c[v] + m.MU) for _, x in rows for v, w in zip([b" ", *x[:-1]], x, strict=True))
        assert exact <= sum(r["score"] for r in got) <= exact + 0.02 * sum(len(x) for _, x in rows)
    assert m.score(empty, ask).count() == 0


def test_pair_filter():
    from siltstone.llm import language_model as m

    rng = np.random.default_rng(2)
    pairs = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    counts = rng.integers(1, 40, len(pairs))
    shard = pairs >> np.uint64(60)
    bits = int(m.levels(counts).sum()) * m.BITS_AN_ENTRY // 16 // 8 * 8
    built = m.PairFilter(16, bits, {s: m.shard_filter(pairs[shard == s], counts[shard == s], bits) for s in range(16)})
    got = built.counts(pairs)
    assert (got >= 2 ** (m.levels(counts) - 1)).all()
    assert (got == 2 ** (m.levels(counts) - 1)).mean() > 0.9
    assert (built.counts(rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2) + np.uint64(1)) > 0).mean() < 0.05
    both = m.merged([m.pack_pairs(pairs[:9]) + m.pack(counts[:9])] * 2, [9, 9])
    assert (both[0] == pairs[:9]).all() and (both[1] == 2 * counts[:9]).all()


def test_language_model_of_large_filters(small, docs):
    """A filter too large for one broadcast, and blocks of a few words, give the scores that the broadcast gives."""
    from siltstone.llm import language_model as m

    ask = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    for df in (docs, small):
        want = of(m.score(df, ask), *names)
        assert of(m.score(df, ask, most_bytes=0), *names) == want
    want = of(m.score(docs, ask), *names)
    for limits in ((10, 1 << 20, 1 << 20), (1 << 20, 10, 1 << 20), (1 << 20, 1 << 20, 50)):
        for most_bytes in (0, m.MOST_BYTES):
            assert of(m.score(docs, ask, most_bytes=most_bytes, limits=limits), *names) == want
    rounded = lambda df: Counter((*(r[c] for c in names[:5]), *(round(r[c], 7) for c in names[5:])) for r in df.collect())
    assert rounded(m.score(docs, ask, chunk=7)) == rounded(m.score(docs, ask))


def test_full_pair_filter_ends():
    from siltstone.llm import language_model as m

    pairs = np.arange(1, 9, dtype=np.uint64)
    assert (m.PairFilter(1, 64, {0: b"\xff" * 8}, 5).counts(pairs) == 16).all()


def test_language_id(spark, docs, empty):
    from siltstone.llm.langid import ByteGRU, grid, language_id, predict

    ask = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    right = language_id(df, ask).join(df.select("doc_id", "lang"), "doc_id").groupBy("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"))
    assert all(r["a"] > 0.95 for r in right.collect())
    odd = {r["doc_id"]: r for r in language_id(docs, ask).collect()}
    assert [odd[i]["lang_pred"] for i in (1, 2, 3, 20)] == ["und"] * 4 and odd[4]["lang_pred"] == "en"
    assert language_id(empty, ask).count() == 0
    assert {r["lang_pred"] for r in predict(docs, None).collect()} == {"und"}
    model = ByteGRU(["a", "b"], hidden=3, embed=2)
    x, there = grid([b"abc", b"z"])
    y = np.array([0, 1])
    _, g = model.gradients(x, there, y)
    for name, at in (("E", (97, 1)), ("Uf", (1, 2)), ("Rb", (2, 0)), ("Wb", (1, 4)), ("V", (4, 1)), ("bf", (7,))):
        w, step = model.w[name], 1e-2
        old = w[at]
        w[at] = old + step
        up = model.gradients(x, there, y)[0]
        w[at] = old - step
        down = model.gradients(x, there, y)[0]
        w[at] = old
        assert abs((up - down) / (2 * step) - g[name][at]) < 2e-3


def plain_reading(model, data):
    """Probabilities of every position, one number after the other."""
    w, h, sides = {k: v.astype(float) for k, v in model.w.items()}, model.hidden, {}
    for d in "fb":
        state, seen = np.zeros(h), {}
        for t in range(len(data)) if d == "f" else reversed(range(len(data))):
            a = w["E"][data[t]] @ w[f"W{d}"] + w[f"b{d}"]
            z, r = (1 / (1 + np.exp(-(a[k * h : k * h + h] + state @ w[f"U{d}"][:, k * h : k * h + h]))) for k in (0, 1))
            state = (1 - z) * state + z * np.tanh(a[2 * h :] + (r * state) @ w[f"R{d}"])
            seen[t] = state
        sides[d] = seen
    scores = [np.concatenate([sides["f"][t], sides["b"][t]]) @ w["V"] + w["c"] for t in range(len(data))]
    return np.array([np.exp(s) / np.exp(s).sum() for s in scores])


def test_network_against_plain_reading():
    from siltstone.llm.langid import ByteGRU, document_sums

    model = ByteGRU(["a", "b", "c"], seed=3, hidden=4, embed=3)
    texts = [b"x", words(9).encode(), "日本語 テキスト".encode() * 3, b"ab" * 40, words(3).encode()]
    for piece, margin in ((512, 16), (7, 3), (1, 0), (80, 2)):
        got = document_sums(model, texts, piece, margin)
        for i, t in enumerate(texts):
            want = np.zeros(3)
            for at in range(0, len(t), piece):
                low = max(0, at - margin)
                want += plain_reading(model, t[low : at + piece + margin])[at - low : at - low + piece].sum(axis=0)
            assert np.abs(got[i] - want).max() < 1e-3 * len(t) and abs(got[i].sum() - len(t)) < 1e-3 * len(t)
    # a margin is enough run-in: pieces say about what one reading of the whole says
    long = [words(400).encode()]
    assert np.abs(document_sums(model, long, 64, 16) - document_sums(model, long, 1 << 20, 0)).max() < 0.02 * len(long[0])


def test_noise_is_rejected(spark):
    import corpus_pipeline as c
    from siltstone.llm.langid import predict, train

    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(8)
    letters = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=600)) for _ in range(10)]
    shuffled = ["".join(rng.sample(t, len(t))) for t in (r["text"] for r in df.where("n_chars > 500").limit(10).collect())]
    noise = spark.createDataFrame(list(enumerate(letters + shuffled)), "doc_id long, text string")
    model = train(df)
    said = {r["doc_id"]: r["noise"] for r in predict(noise, model).collect()}
    assert min(said[i] for i in range(10)) > c.REJECT and min(said.values()) > 0.6, said  # shuffled prose keeps its letters
    kept = c.language(spark, df.select(*c.COLUMNS), "")
    lettered = {r["doc_id"] for r in df.collect() if any(x.isalpha() for x in r["text"] or "")}
    assert {r["doc_id"] for r in kept.collect()} == lettered


def plain_words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w).strip(".,;:!?()[]{}<>\"'`*#/-_=|") for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def brute_licenses(text, templates):
    """Every template against every span of the text, then the best of those that meet."""
    own, hits = plain_words(text), []
    at = [" ".join(own[i : i + 5]) for i in range(len(own) - 4)]
    for name, t in templates.items():
        w = plain_words(t)
        wanted = {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}
        if not wanted & set(at):
            continue
        span = math.ceil(len(wanted) * 1.25)
        shares = {}
        for i in range(len(at)):
            held = [k for k in range(max(0, i - span + 1), i + 1) if at[k] in wanted]
            if at[i] in wanted:
                shares[i] = (len({at[k] for k in held}) / len(wanted), held[0])
        stop = min(shares, key=lambda i: (-shares[i][0], i))
        if shares[stop][0] >= 0.8:
            hits.append((-shares[stop][0], -len(wanted), name, shares[stop][1], stop + 5))
    kept = []
    for h in sorted(hits):
        if all(h[4] <= k[3] or k[4] <= h[3] for k in kept):
            kept.append(h)
    return [(h[2], -h[0], h[3]) for h in kept]


def test_licenses(docs, small, empty):
    from siltstone.llm.licenses import TEMPLATES, Scanner, license_scan

    assert len(TEMPLATES) > 150 and all(len(plain_words(t)) >= 5 for t in TEMPLATES.values())
    edited = TEMPLATES["MIT/grant"].split()
    edited[20:22], edited[60] = ["some", "odd"], "words"
    rows = [(100, words(300) + " " + " ".join(edited) + " " + words(50)), (101, TEMPLATES["Apache-2.0/notice"]), (102, TEMPLATES["MIT/text"] * 2), (103, "licensed under CC BY")]
    rows += [(1000 + k, words(9) + "\n// " + t.replace(" ", "  ").upper() + " " + words(7)) for k, t in enumerate(TEMPLATES.values())]
    extra = docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
    for df in (docs, small, extra):
        want = Counter((r["doc_id"], n.split("/")[0], n, round(share, 9), where) for r in df.collect() for n, share, where in brute_licenses(r["text"], TEMPLATES))
        assert Counter((r["doc_id"], r["license"], r["template"], round(r["containment"], 9), r["first_word"]) for r in license_scan(df).collect()) == want
    found = {r["doc_id"]: r["license"] for r in license_scan(extra).collect()}
    assert all(1000 + k in found for k in range(len(TEMPLATES))) and found[101] == "Apache-2.0" and 103 not in found
    assert license_scan(empty).count() == 0
    with pytest.raises(ValueError):
        Scanner({"short": "two words"})


def test_bpe(spark, docs, empty):
    from siltstone.llm.bpe import encode_decode
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in TEXTS:
        ids = library(t or "")
        want[i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tokenizer.decode(ids, skip_special_tokens=False))] += 1
    assert of(encode_decode(docs, PATH), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    for limits in ((10, 1 << 20, 1 << 20), (1 << 20, 10, 1 << 20), (1 << 20, 1 << 20, 50)):
        assert of(encode_decode(docs, PATH, limits=limits), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("siltstone_")]
    one = encode_decode(docs.where("doc_id = 16"), PATH, texts=True).first()
    assert one["ids"] == library(dict(TEXTS)[16]) and unicodedata.normalize("NFC", "é") not in one["decoded"]
    assert encode_decode(empty, PATH).count() == 0
    with pytest.raises(ValueError):
        from siltstone.llm.bpe import WordEncoder

        WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_of_other_white_space(spark):
    """White space that is not ASCII makes words without ids, which leave nothing in the decoded text."""
    from siltstone.llm.bpe import encode_decode
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    spaces = ("\u00a0", "\u0085", "\u3000")
    texts = [t for s in spaces for t in (s, f"{s} foo bar", f"foo {s} bar", f"foo bar {s}", f"{s} {s} foo {s} {s} bar", f"foo{s}bar")]
    got = {r["doc_id"]: r for r in encode_decode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, texts=True).collect()}
    for i, t in enumerate(texts):
        ids = library(t)
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert (got[i]["ids"], got[i]["decoded"], got[i]["decoded_sha256"]) == (ids, decoded, sha(decoded)), t


def test_queries_match_sql(spark, duck):
    from siltstone.llm.queries import ORACLE_SQL, QUERIES

    for name, sql in ORACLE_SQL.items():
        assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(duck, sql), name
    assert len(QUERIES) == 10


def test_pipeline(spark, docs):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["language id", "exact dedup", "simhash near-dedup", "substring dedup", "best-fit packing"]
    rows = docs.select(*c.COLUMNS)
    said = c.language(spark, rows, "")
    assert {1, 2, 3, 20}.isdisjoint(r["doc_id"] for r in said.collect())
    kept = of(c.exact(spark, rows, ""), "doc_id")
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    low = defaultdict(set)
    for i, t in TEXTS:
        low[normal(t)].add(i)
    want = Counter((min(x for x in ids if x is not None) if ids != {None} else None,) for ids in low.values())
    assert kept == want
    with_id = rows.where("doc_id is not null")
    prints = {(r["doc_id"], n): fingerprint(r["text"]) for n, r in enumerate(with_id.collect())}
    assert {r["doc_id"] for r in c.near(spark, with_id, "").collect()} == {x[0] for x in set(brute_components(prints).values())} | {14}
    cleaned = {r["doc_id"]: r for r in c.substrings(spark, with_id.where("doc_id in (11, 12, 14)"), "").collect()}
    assert cleaned[12]["text"] == "" and cleaned[12]["n_chars"] == 0 and cleaned[11]["text"] == dict(TEXTS)[11]


def test_whole_pipeline_against_brute_force(spark, small, empty, tmp_path):
    """All stages chained: the rows of run(), sequence numbers apart, and that sequences are filled without gaps."""
    import corpus_pipeline as c

    real = {r["doc_id"]: r["text"] for r in small.where("lang = 'en'").collect()}
    text = max(real.values(), key=len)
    passage = " ".join(text.split()[10:90])
    more = [(None, text[:900]), (None, text[:900]), (1000, text), (1000, text), (1000, text + " "), (1001, passage), (1002, f"{text[-500:]} {passage}\n{text[100:700]}"), (1003, (text + " ") * 12), (1004, None), (1005, ""), (1006, "12 34"), (1007, "q x" * 400)]
    extra = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in more], "doc_id long, text string, lang string, source string, n_chars long")
    given = small.select(*c.COLUMNS).withColumn("n_chars", F.col("n_chars").cast("long")).unionByName(extra)
    for name, df in (("some", given), ("none", empty.select(*c.COLUMNS))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    left = [(r["doc_id"], r["text"]) for r in c.language(spark, spark.read.parquet(f"{tmp_path}/some/documents.parquet"), "").collect()]
    assert len(left) > 190 and not {1004, 1005, 1006} & {i for i, _ in left}
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, t in sorted(left, key=lambda x: order(x[0])):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (i, t))
    # of a document's equal rows the least stays, so it is the least text of those that normalise alike
    left = [(i, min(t for j, t in left if j == i and re.sub(r"[\x20\x09-\x0D]+", " ", t) == n)) for n, (i, _) in first.items()]
    prints = [fingerprint(t) for _, t in left]
    roots = brute_components(dict(enumerate(prints)))
    low = defaultdict(list)
    for (i, _), x in zip(left, prints, strict=True):
        low[roots[x]].append(i)
    left = [x for x, y in zip(left, prints, strict=True) if x[0] == min(low[roots[y]], key=order)]
    first, cleaned = first_windows(left), []
    for i, t in left:
        kept = left_words(first, i, t)
        cleaned.append((i, t if len(kept) == len(t.split()) else " ".join(kept)))
    assert any(t not in dict(left).values() for _, t in cleaned)
    want = Counter()
    for i, t in cleaned:
        ids = [*library(t), 0]
        want.update((i, k, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 2048)))
    got = c.run(spark, f"{tmp_path}/some").collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    filled = defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in filled.values():
        x.sort()
        assert [a for a, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))] and sum(n for _, n in x) <= 2048
    assert c.run(spark, f"{tmp_path}/none").count() == 0


def test_reading_is_the_same_without_a_tape():
    """read() and run() give the same states, for lanes of any length."""
    from siltstone.llm.langid import ByteGRU, grid

    model = ByteGRU(["a", "b", "c"], seed=5, hidden=4, embed=3)
    x, there = grid([b"some bytes", b"", b"x", b"others, longer than these"])
    for d in "fb":
        plain = [(t, s.copy()) for t, s in model.run(x, there, d)]
        read = [(t, s.copy()) for t, s in model.read(x, there, d)]
        assert [t for t, _ in plain] == [t for t, _ in read]
        for (_, a), (_, b) in zip(plain, read, strict=True):
            np.testing.assert_allclose(a, b, atol=1e-5)
