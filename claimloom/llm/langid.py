"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text as UTF-8 bytes in both directions, gives every byte position
probabilities of the languages, and a document the mean of its positions'. It is trained
here, in numpy, by backpropagation through time with Adam, on a bounded sample of labelled
texts, of which windows are drawn over their whole length. Texts of any length are read
whole, in windows that overlap: a window gives WINDOW positions, and reads MARGIN bytes more
on either side, so every position has seen what stands around it. Windows of all documents
of an Arrow batch are run side by side.

Defined cases. A null text, or one without a letter (a character of a category L), is `und`
with score 0. Null labels
are not learned from. Without any labelled row every text is `und`. An empty table gives
an empty table. Repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, small_batches

#: Bound on the sample of labelled rows, most windows drawn of each, the positions of a window and
#: the bytes read beside them, and the network's sizes.
SAMPLE, DRAWN, WINDOW, MARGIN, HIDDEN, STEPS, BATCH, RATE = 3000, 8, 128, 16, 8, 200, 192, 0.03
#: Windows that are run side by side.
BLOCK = 2048


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def init(n_langs: int, hidden: int = HIDDEN, seed: int = 1) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p["E" + d] = (0.3 * r.standard_normal((256, 3 * hidden))).astype(np.float32)
        p["U" + d] = (r.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        p["W" + d] = (0.3 * r.standard_normal((hidden, n_langs))).astype(np.float32)
    p["b"] = np.zeros(n_langs, np.float32)
    return p


def scan(x: np.ndarray, E: np.ndarray, U: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States after each byte; x: bytes by time and window. keep: gets what the way back needs."""
    h = U.shape[0]
    states = np.empty((x.shape[0], x.shape[1], h), np.float32)
    s = np.zeros((x.shape[1], h), np.float32)
    for t in range(x.shape[0]):
        a, g = E[x[t]], s @ U
        zr = _sigmoid(a[:, : 2 * h] + g[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        n = np.tanh(a[:, 2 * h :] + r * g[:, 2 * h :])
        if keep is not None:
            keep.append((s, z, r, n, g[:, 2 * h :]))
        s = n + z * (s - n)
        states[t] = s
    return states


def _back(x, U, kept, d_states, grads, d):
    """Adds the gradients of one direction."""
    h = U.shape[0]
    carry = np.zeros_like(d_states[0])
    inputs = np.empty((*x.shape, 3 * h), d_states.dtype)
    for t in range(x.shape[0] - 1, -1, -1):
        s, z, r, n, gn = kept[t]
        ds = d_states[t] + carry
        dn = ds * (1 - z) * (1 - n * n)
        dz = ds * (s - n) * z * (1 - z)
        dr = dn * gn * r * (1 - r)
        inputs[t] = np.concatenate([dz, dr, dn], 1)
        d_g = np.concatenate([dz, dr, dn * r], 1)
        grads["U" + d] += s.T @ d_g
        carry = ds * z + d_g @ U.T
    flat, at = inputs.reshape(-1, 3 * h), x.ravel()
    for i in range(3 * h):
        grads["E" + d][:, i] += np.bincount(at, flat[:, i], 256)


def _swept(x: np.ndarray, E: np.ndarray, U: np.ndarray, W: np.ndarray, out: np.ndarray, back: bool) -> None:
    """What scan(...) @ W gives, added to out, in buffers that stay in the processor's cache."""
    h, width = U.shape[0], x.shape[1]
    Ez, En, Uz, Un = (np.ascontiguousarray(v) for v in (0.5 * E[:, : 2 * h], E[:, 2 * h :], 0.5 * U[:, : 2 * h], U[:, 2 * h :]))
    z, gz = np.empty((2, width, 2 * h), np.float32)
    n, gn = np.empty((2, width, h), np.float32)
    s, add = np.zeros((width, h), np.float32), np.empty((width, W.shape[1]), np.float32)
    for t in range(len(x) - 1, -1, -1) if back else range(len(x)):
        np.take(Ez, x[t], 0, z, "clip")
        np.take(En, x[t], 0, n, "clip")
        z += np.matmul(s, Uz, gz)
        np.tanh(z, z)
        z += 1
        z *= 0.5
        np.matmul(s, Un, gn)
        gn *= z[:, h:]
        n += gn
        np.tanh(n, n)
        s -= n
        s *= z[:, :h]
        s += n
        out[t] += np.matmul(s, W, add)


def logits(x: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """Scores of the languages at every position; x: bytes by time and window."""
    out = np.empty((*x.shape, len(p["b"])), np.float32)
    out[:] = p["b"]
    _swept(x, p["Ef"], p["Uf"], p["Wf"], out, False)
    _swept(x, p["Eb"], p["Ub"], p["Wb"], out, True)
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = x - x.max(-1, keepdims=True)
    np.exp(e, e)
    e /= e.sum(-1, keepdims=True)
    return e


def loss_and_grads(x, y, mask, p) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over the positions in mask, and its gradients."""
    kf, kb = [], []
    f, b = scan(x, p["Ef"], p["Uf"], kf), scan(x[::-1], p["Eb"], p["Ub"], kb)[::-1]
    prob = softmax(f @ p["Wf"] + b @ p["Wb"] + p["b"])
    count = max(1.0, float(mask.sum()))
    picked = np.take_along_axis(prob, np.broadcast_to(y[None, :, None], (*x.shape, 1)), 2)[..., 0]
    loss = float(-(np.log(np.maximum(picked, 1e-9)) * mask).sum() / count)
    d = prob.copy()
    d[:, np.arange(len(y)), y] -= 1
    d = (d * (mask / count)[..., None]).astype(np.float32)
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    flat = d.reshape(-1, d.shape[-1])
    grads["b"] = flat.sum(0)
    grads["Wf"] = f.reshape(len(flat), -1).T @ flat
    grads["Wb"] = b.reshape(len(flat), -1).T @ flat
    _back(x, p["Uf"], kf, d @ p["Wf"].T, grads, "f")
    _back(x[::-1], p["Ub"], kb, (d @ p["Wb"].T)[::-1], grads, "b")
    return loss, grads


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes cut into windows that overlap: the bytes (window, time), which of them count in
    this window, and each window's text. A text's first window has nothing before it."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), counts)
    at = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * WINDOW
    start, left = np.maximum(at - MARGIN, 0), sizes[owner]
    place = start[:, None] + np.arange(WINDOW + 2 * MARGIN)
    flat = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
    inside = place < left[:, None]
    x = np.where(inside, flat[np.where(inside, (np.cumsum(sizes) - sizes)[owner][:, None] + place, 0)], 0).astype(np.uint8)
    return x, inside & (place >= at[:, None]) & (place < at[:, None] + WINDOW), owner


def train(samples: list[tuple[bytes, str]], seed: int = 1, hidden: int = HIDDEN, steps: int = STEPS) -> dict:
    """A model from (window of a text, language) pairs: parameters and the languages' names."""
    langs = sorted({lang for t, lang in samples if t})
    if not langs:
        return {"langs": [], "p": {}}
    p = init(len(langs), hidden, seed)
    names = {lang: i for i, lang in enumerate(langs)}
    cut, y = np.zeros((len(samples), WINDOW), np.uint8), np.array([names.get(lang, 0) for _, lang in samples])
    lengths = np.array([min(len(t), WINDOW) for t, _ in samples])
    for row, (t, _) in zip(cut, samples):
        row[: min(len(t), WINDOW)] = np.frombuffer(t[:WINDOW], np.uint8)
    r = np.random.default_rng(seed)
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = r.integers(0, len(cut), BATCH)
        x = np.ascontiguousarray(cut[pick].T)
        mask = (np.arange(WINDOW)[:, None] < lengths[pick][None, :]).astype(np.float32)
        _, g = loss_and_grads(x, y[pick], mask, p)
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        rate = RATE * (1 - step / (steps + 1))
        for k in p:
            v = g[k] * min(1.0, 1.0 / max(norm, 1e-9))
            m1[k] = 0.9 * m1[k] + 0.1 * v
            m2[k] = 0.99 * m2[k] + 0.01 * v * v
            p[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return {"langs": langs, "p": p}


def pooled(texts: list[bytes], model: dict) -> np.ndarray:
    """Probabilities of the languages for each text: the mean over its positions."""
    out = np.zeros((len(texts), len(model["langs"])))
    cut, counts, owner = windows(texts)
    for a in range(0, len(cut), BLOCK):
        x = np.ascontiguousarray(cut[a : a + BLOCK].T)
        prob = softmax(logits(x, model["p"]))
        prob *= counts[a : a + BLOCK].T[..., None]
        np.add.at(out, owner[a : a + BLOCK], prob.sum(0))
    return out / np.maximum([[len(t)] for t in texts], 1) if len(texts) else out


def predict(texts: list[str | None], model: dict) -> list[tuple[str, float]]:
    """(language, probability) of each text."""
    if not model["langs"]:
        return [("und", 0.0)] * len(texts)
    read = [i for i, t in enumerate(texts) if t is not None and has_letter(t)]
    out = [("und", 0.0)] * len(texts)
    for i, p in zip(read, pooled([texts[i].encode() for i in read], model) if read else []):
        best = int(p.argmax())
        out[i] = (model["langs"][best], float(min(1.0, max(0.0, p[best]))))
    return out


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", order: str = "doc_id", sample: int = SAMPLE) -> dict:
    """Train on `sample` rows of those that `learn` allows, the first by a hash of `order`. Of each,
    up to DRAWN windows take part, at places that its hash draws over the whole text."""
    small_batches(docs.sparkSession)
    data = F.col(text).cast("binary")
    rows = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    many = F.least(F.lit(DRAWN), F.ceil(F.octet_length(data) / WINDOW)).cast("int")
    place = lambda i: (F.pmod(F.xxhash64(F.lit(12), i, order, text), F.greatest(F.octet_length(data) - WINDOW, F.lit(0)) + 1) + 1).cast("int")
    drawn = F.transform(F.sequence(F.lit(1), many), lambda i: F.substring(data, place(i), F.lit(WINDOW)))
    picked = rows.select(F.col(order).alias("o"), F.xxhash64(text).alias("h"), drawn.alias("t"), F.col(lang).alias("l"))
    got = hash_sample(picked, sample, ["o", "h"], 11).collect()  # with the text, as many rows may share an id
    return train([(bytes(t), r["l"]) for r in got for t in r["t"]])


def identify(text: str | Column, model: dict) -> Column:
    """The prediction as a struct (lang, score)."""

    @F.arrow_udf("struct<lang:string,score:double>")
    def run(texts: pa.Array) -> pa.Array:
        got = predict(texts.to_pylist(), model)
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["lang", "score"])

    return run(text)


def held_out(fold: int = 2, folds: int = 4) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def language_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Learned without fold 2 of 4."""
    model = fit(docs, ~held_out())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), identify("text", model).alias("got"))
    return rows.select("doc_id", "held_out", F.col("got.lang").alias("lang_pred"), F.col("got.score").alias("score"))


def accepted(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of docs in a learned language with a score of `least` or more."""
    model = fit(docs, ~held_out())
    got = docs.withColumn("__got", identify("text", model))
    return got.filter((F.col("__got.lang") != "und") & (F.col("__got.score") >= least)).drop("__got")
