"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's bytes both ways, white space and all, and labels every position; a document's probability
of each language is the mean over all its positions. So that long texts keep memory bounded and short ones run side by
side, a text is read in pieces of PIECE bytes, each with MARGIN bytes of what stands before and after it: their states
run in from there, and only the piece's own positions count. No text is cut short and every position is labelled once.
Beside the languages the network learns noise (characters of real windows in random order, and random letters), by which a
caller may reject documents that are in no learned language. Training is backpropagation through time, in numpy, on
the driver, over a bounded sample of windows of labelled rows; prediction needs the weights only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, small_batches, utf8

HIDDEN = 12
EMBED = 8
STEPS = 300
BATCH = 384
RATE = 0.02
PIECE, MARGIN = 512, 16
#: Pieces that are read side by side, and bytes of texts that a worker takes at a time; a longer text comes alone.
LANES, TAKEN = 1024, 1 << 21
#: The sample that training sees: labelled rows of each language, about, and windows of each row, spread over its whole
#: text, of so many bytes.
SAMPLE_ROWS, SAMPLE_WINDOWS, WINDOW = 300, 8, 64
NOISE = "\0noise"
#: Positions that every text is given as language before its noise is averaged, so that a short text is never rejected
#: for a few odd words.
PRIOR = 30


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class ByteGRU:
    """Bidirectional gated recurrent units; numbers are float32. x is steps x lanes of bytes, there says which of them
    are in a lane's text (its first ones); what lies beyond is not read by the backward run and not counted."""

    def __init__(self, labels: list[str], seed: int = 7, hidden: int = HIDDEN, embed: int = EMBED) -> None:
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden

        def init(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.w = {"E": rng.standard_normal((256, embed)).astype(np.float32) * 0.5, "V": init(2 * hidden, len(labels)), "c": np.zeros(len(labels), np.float32)}
        for d in "fb":
            self.w |= {f"W{d}": init(embed, 3 * hidden), f"U{d}": init(hidden, 2 * hidden), f"R{d}": init(hidden, hidden), f"b{d}": np.zeros(3 * hidden, np.float32)}

    def run(self, x: np.ndarray, there: np.ndarray, d: str, tape: list | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """Each step and the states after it, first step first or last step first."""
        w, h = self.w, self.hidden
        project = w["E"] @ w[f"W{d}"] + w[f"b{d}"]
        state = np.zeros((x.shape[1], h), np.float32)
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            a = project[x[t]]
            gates = _sigmoid(a[:, : 2 * h] + state @ w[f"U{d}"])
            z, r = gates[:, :h], gates[:, h:]
            n = np.tanh(a[:, 2 * h :] + (r * state) @ w[f"R{d}"])
            new = state + z * (n - state)
            if d == "b":
                new *= there[t, :, None]
            if tape is not None:
                tape.append((t, state, z, r, n))
            state = new
            yield t, state

    def read(self, x: np.ndarray, there: np.ndarray, d: str) -> Iterator[tuple[int, np.ndarray]]:
        """As run() without a tape, for prediction. Numbers of one gate lie together, steps reuse their memory (a state
        holds until the next one is asked for), and the gates' weights have their sign turned: exp needs no negation."""
        w, h, lanes = self.w, self.hidden, x.shape[1]
        project = w["E"] @ w[f"W{d}"] + w[f"b{d}"]
        inputs = [np.ascontiguousarray(s * project[:, k * h : (k + 1) * h]) for k, s in enumerate((-1, -1, 1))]
        gate = np.ascontiguousarray(-w[f"U{d}"].reshape(h, 2, h).transpose(1, 0, 2))
        gates, moved, part, new = np.empty((2, lanes, h), np.float32), np.empty((2, lanes, h), np.float32), np.empty((lanes, h), np.float32), np.empty((lanes, h), np.float32)
        z, r = gates
        state, whole = np.zeros((lanes, h), np.float32), there.all(axis=1)
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            for k, to in enumerate((z, r, new)):
                np.take(inputs[k], x[t], axis=0, out=to, mode="clip")
            np.matmul(state, gate, out=moved)
            gates += moved
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            r *= state
            np.matmul(r, w[f"R{d}"], out=part)
            new += part
            np.tanh(new, out=new)
            new -= state
            new *= z
            state += new
            if d == "b" and not whole[t]:
                state *= there[t, :, None]
            yield t, state

    def sums(self, x: np.ndarray, there: np.ndarray, own: np.ndarray) -> np.ndarray:
        """lanes x labels: probabilities summed over the positions that are a lane's own."""
        h = self.hidden
        ahead, back, bias = np.ascontiguousarray(self.w["V"][:h].T), np.ascontiguousarray(self.w["V"][h:].T), self.w["c"][:, None]
        front = np.empty((len(x), len(self.labels), x.shape[1]), np.float32)
        for t, state in self.read(x, there, "f"):
            np.matmul(ahead, state.T, out=front[t])
        front += bias
        out, counted = np.zeros((len(self.labels), x.shape[1]), np.float64), own.any(axis=1)
        for t, state in self.read(x, there, "b"):
            if counted[t]:
                p = front[t]
                p += back @ state.T
                p -= p.max(axis=0)
                np.exp(p, out=p)
                p *= own[t] / p.sum(axis=0)
                out += p
        return out.T

    def gradients(self, x: np.ndarray, there: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Cross-entropy at all positions, by backpropagation through time."""
        w, h = self.w, self.hidden
        both, tapes = np.zeros((*x.shape, 2 * h), np.float32), {"f": [], "b": []}
        for d, side in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            for t, state in self.run(x, there, d, tapes[d]):
                both[t, :, side] = state
        p = _softmax(both @ w["V"] + w["c"])
        scale = (there / there.sum()).astype(np.float32)
        loss = float(-(np.log(np.maximum(p[:, np.arange(len(y)), y], 1e-9)) * scale).sum())
        delta = p.copy()
        delta[:, np.arange(len(y)), y] -= 1
        delta *= scale[:, :, None]
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["V"] = np.einsum("twh,twl->hl", both, delta)
        g["c"] = delta.sum((0, 1))
        back = delta @ w["V"].T
        for d, side in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            W, U, R = w[f"W{d}"], w[f"U{d}"], w[f"R{d}"]
            carry = np.zeros((x.shape[1], h), np.float32)
            pre = np.zeros((256, 3 * h), np.float32)
            for t, state, z, r, n in reversed(tapes[d]):
                ds = back[t][:, side] + carry
                if d == "b":
                    ds = ds * there[t, :, None]
                dn = ds * z * (1 - n * n)
                dz = ds * (n - state) * z * (1 - z)
                drs = dn @ R.T
                dr = drs * state * r * (1 - r)
                dg = np.concatenate([dz, dr], axis=1)
                carry = ds * (1 - z) + drs * r + dg @ U.T
                g[f"R{d}"] += (r * state).T @ dn
                g[f"U{d}"] += state.T @ dg
                np.add.at(pre, x[t], np.concatenate([dg, dn], axis=1))
            g[f"b{d}"] = pre.sum(0)
            g[f"W{d}"] = w["E"].T @ pre
            g["E"] += pre @ W.T
        return loss, g

    def fit(self, windows: list[list[bytes]], steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 11) -> float:
        """windows: of each label but the last, which is noise. Adam over batches in which labels are equally often.
        Returns the last batches' mean loss."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        losses = []
        for step in range(1, steps + 1):
            y = rng.integers(0, len(self.labels), batch)
            some = []
            for label in y.tolist():
                of = label if label < len(windows) else int(rng.integers(len(windows)))
                window = windows[of][int(rng.integers(len(windows[of])))]
                some.append(window if label < len(windows) else noise_like(window, rng))
            x, there = grid(some)
            loss, g = self.gradients(x, there, y)
            losses.append(loss)
            now = rate * 0.5 * (1 + np.cos(np.pi * step / steps))
            for k, v in g.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.01 * (v * v - second[k])
                self.w[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return float(np.mean(losses[-20:]))


def noise_like(window: bytes, rng: np.random.Generator) -> bytes:
    """The window's characters in random order, or as many random letters, or random printable characters."""
    kind = int(rng.integers(3))
    if kind == 0:
        return "".join(rng.permutation(list(window.decode(errors="ignore"))).tolist()).encode() or window
    low, high = ((97, 123), (33, 127))[kind - 1]
    return rng.integers(low, high, len(window)).astype(np.uint8).tobytes()


def grid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """steps x lanes."""
    lengths = np.array([len(w) for w in texts])
    there = np.arange(max(1, int(lengths.max(initial=0))))[None, :] < lengths[:, None]
    x = np.zeros(there.shape, np.uint8)
    x[there] = np.frombuffer(b"".join(texts), np.uint8)
    return np.ascontiguousarray(x.T), np.ascontiguousarray(there.T)


def document_sums(model: ByteGRU, texts: list[bytes], piece: int = PIECE, margin: int = MARGIN) -> np.ndarray:
    """texts x labels: probabilities summed over all bytes of each text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(lengths) - lengths
    counts = -(-lengths // piece)
    text = np.repeat(np.arange(len(texts)), counts)
    at = (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * piece
    low, high = np.maximum(at - margin, 0), np.minimum(at + piece + margin, lengths[text])
    order = np.argsort(high - low, kind="stable")
    out = np.zeros((len(texts), len(model.labels)), np.float64)
    for k in range(0, len(order), LANES):
        some = order[k : k + LANES]
        step = np.arange(int((high - low)[some].max()))[:, None]
        there = step < (high - low)[some]
        place = low[some] + step
        own = there & (place >= at[some]) & (place < at[some] + piece)
        x = data[np.minimum(begins[text[some]] + place, len(data) - 1)]
        np.add.at(out, text[some], model.sums(x, there, own))
    return out


def train(docs: DataFrame, label: str = "lang", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, windows: int = SAMPLE_WINDOWS, window: int = WINDOW) -> ByteGRU | None:
    """From the given rows, which must be training rows only. Of each label about `rows` rows are taken, by a hash of
    the id, and of each row at most `windows` windows of `window` bytes, evenly over its whole text; they come to the
    driver, so many bytes for each label at most, whatever the input. None if nothing is labelled."""
    counts = {str(r[label]): r["n"] for r in docs.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    labels = sorted(counts)
    shares = F.create_map(*(x for k in labels for x in (F.lit(k), F.lit(min(1.0, rows / counts[k])))))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(3)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    size, body = F.octet_length("text"), F.col("text")
    # evenly: the k-th of m windows begins at k / m of the text; texts of a window or less are taken whole
    many = F.least(F.lit(windows), F.greatest(F.lit(1), F.floor(size / window).cast("int")))
    sample = docs.where(F.col(label).isNotNull() & (draw < shares[F.col(label).cast("string")])).select(F.col(label).cast("string").alias("label"), F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    taken = sample.withColumn("many", many).withColumn("k", F.explode(F.expr("sequence(0, many - 1)"))).select("label", "id", "k", F.substring(body, (F.floor(size * F.col("k") / F.col("many")) + 1).cast("int"), F.lit(window)).alias("window"))
    seen: list[list[bytes]] = [[] for _ in labels]
    for r in taken.where("octet_length(window) > 0").orderBy("label", "id", "k", "window").collect():
        seen[labels.index(r["label"])].append(bytes(r["window"]))
    labels, seen = [k for k, x in zip(labels, seen, strict=True) if x], [x for x in seen if x]
    if not labels:
        return None
    model = ByteGRU([*labels, NOISE])
    model.fit(seen)
    return model


def predict(docs: DataFrame, model: ByteGRU | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep's columns (the id unless given), lang_pred, score (the language's share of all languages' probability),
    noise (mean probability that it is noise, over the text's positions and PRIOR more that are not). A null text, a text without a letter, and all texts where
    there is no model are `und`, score 0, noise 0. Only the text is looked at, all of it; ties go to the label that
    sorts first; an empty table gives an empty table and other columns are ignored."""
    keep = keep or [id_col]
    weights = None if model is None else docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    at_text = keep.index(text_col) if text_col in keep else len(keep)  # a text that is kept is not sent twice

    def labelled(texts: list[bytes | None]) -> tuple[list, list, list]:
        own = weights.value if weights else None
        busy = [i for i, t in enumerate(texts) if t and own and any(map(str.isalpha, t.decode()))]
        labels, scores, noise = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if busy:
            sums = document_sums(own, [texts[i] for i in busy])
            languages = sums[:, :-1]
            best = languages.argmax(axis=1)
            share = languages.max(axis=1) / np.maximum(languages.sum(axis=1), 1e-300)
            for i, b, s, n in zip(busy, best.tolist(), share.tolist(), (sums[:, -1] / (sums.sum(axis=1) + PRIOR)).tolist(), strict=True):
                labels[i], scores[i], noise[i] = own.labels[b], min(1.0, s), min(1.0, n)
        return labels, scores, noise

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in by_bytes(batch, at_text, TAKEN):
                labels, scores, noise = labelled(some.column(at_text).cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(len(keep))), pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(noise, pa.float64())], [*keep, "lang_pred", "score", "noise"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string", "score double", "noise double"])
    return small_batches(docs).select(*keep, *[F.col(text_col).alias("__text")] * (text_col not in keep)).mapInArrow(run, schema)


def language_id(docs: DataFrame, held_out: F.Column) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, noise. Learns from rows that are not held out.

    Ties in a document's probabilities go to the label that sorts first. Repeated rows are rows of their own; other
    columns are ignored; an empty table gives an empty table, and a table without labels `und` throughout.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", held_out.alias("held_out"))
    model = train(own.where(~F.col("held_out")))
    return predict(own, model, keep=["doc_id", "held_out"])
