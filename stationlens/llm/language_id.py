"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text in windows of ``window`` bytes. A forward and a backward gated
recurrent layer run over each window; at every byte both states give the probabilities of
the labels, so every position is labelled. A document's probability of a label is the mean
over all bytes of the whole text, and its score is the largest one.

Training is plain numpy: backpropagation through time over batches of windows, with Adam,
on the driver. It learns from a bounded sample: ``sample_docs`` documents per label chosen
by the hash of their id, and of a text longer than ``sample_chars`` as many characters in
pieces of ``PIECE``, which begin anywhere in the whole text, again by hash. The state of
both layers starts anew in each window, whose length is a parameter. Prediction runs in tasks over
all bytes of all documents; windows of many documents go through the layers together.

Null texts and texts without a letter are ``und`` with score 0. Documents with null label
are never learned from. Repeated ids and rows are predicted one by one. If no labelled row
is left to learn from, everything is ``und``. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stationlens.llm.common import slices, utf8_buffers

UNKNOWN = "und"
#: One number stands for the bytes of no text (padding).
PAD = 256
#: Windows computed together.
TOGETHER = 4096
#: Characters of a piece of a sample text.
PIECE = 128


def init(labels: int, hidden: int, seed: int) -> dict[str, np.ndarray]:
    """Weights: per direction the input table, the recurrent matrix; then the output layer."""
    rng = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p[f"x{d}"] = rng.standard_normal((PAD + 1, 3 * hidden)) * 0.3
        p[f"u{d}"] = rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)
        p[f"o{d}"] = rng.standard_normal((hidden, labels)) * 0.3
    p["bias"] = np.zeros(labels)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def run_layer(x: np.ndarray, table: np.ndarray, u: np.ndarray, keep: bool = False):
    """States after each step for ``x`` (steps, windows); ``keep`` also returns what the way back needs."""
    steps, n = x.shape
    hidden = u.shape[0]
    states = np.zeros((steps + 1, n, hidden), np.float32)
    kept = []
    for t in range(steps):
        h = states[t]
        a = np.take(table, x[t], axis=0)
        v = h @ u
        gates = _sigmoid(a[:, : 2 * hidden] + v[:, : 2 * hidden])
        reset, update = gates[:, :hidden], gates[:, hidden:]
        inner = v[:, 2 * hidden :]
        new = np.tanh(a[:, 2 * hidden :] + reset * inner)
        np.subtract(new, h, out=states[t + 1])
        states[t + 1] *= update
        states[t + 1] += h
        if keep:
            kept.append((reset, update, inner, new))
    return states, kept


def _back_layer(x, u, states, kept, grad_out, grads, d):
    """Backpropagation through time: adds to ``grads`` of direction ``d``."""
    hidden = u.shape[0]
    carry = np.zeros_like(states[0])
    for t in range(len(x) - 1, -1, -1):
        reset, update, inner, new = kept[t]
        h = states[t]
        g = grad_out[t] + carry
        g_update = g * (new - h) * update * (1 - update)
        g_new = g * update * (1 - new * new)
        g_reset = g_new * inner * reset * (1 - reset)
        from_table = np.concatenate([g_reset, g_update, g_new], axis=1)
        to_state = np.concatenate([g_reset, g_update, g_new * reset], axis=1)
        np.add.at(grads[f"x{d}"], x[t], from_table)
        grads[f"u{d}"] += h.T @ to_state
        carry = g * (1 - update) + to_state @ u.T
    return None


def loss_and_grads(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray):
    """Mean cross-entropy over all labelled positions of ``x`` (steps, windows), and its gradient."""
    forward, kept_f = run_layer(x, p["xf"], p["uf"], keep=True)
    backward, kept_b = run_layer(x[::-1], p["xb"], p["ub"], keep=True)
    hf, hb = forward[1:], backward[1:][::-1]
    logits = hf @ p["of"] + hb @ p["ob"] + p["bias"]
    logits -= logits.max(-1, keepdims=True)
    probs = np.exp(logits)
    probs /= probs.sum(-1, keepdims=True)
    real = x != PAD
    count = max(1, int(real.sum()))
    picked = np.take_along_axis(probs, np.broadcast_to(y[None, :, None], (*x.shape, 1)), -1)[..., 0]
    loss = float(-(np.log(np.maximum(picked, 1e-12)) * real).sum() / count)
    g = probs.copy()
    g[:, np.arange(x.shape[1]), y] -= 1
    g *= real[..., None] / np.float32(count)
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    flat = g.reshape(-1, g.shape[-1])
    grads["of"] = hf.reshape(len(flat), -1).T @ flat
    grads["ob"] = hb.reshape(len(flat), -1).T @ flat
    grads["bias"] = flat.sum(0)
    _back_layer(x, p["uf"], forward, kept_f, g @ p["of"].T, grads, "f")
    _back_layer(x[::-1], p["ub"], backward, kept_b, (g @ p["ob"].T)[::-1], grads, "b")
    return loss, grads


def windows_of(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all rows as (windows, window) byte numbers, and the row of each."""
    sizes = np.diff(offsets)
    per_row = -(-sizes // window)
    row = np.repeat(np.arange(len(sizes)), per_row)
    first = np.cumsum(per_row) - per_row
    start = offsets[:-1][row] + (np.arange(len(row)) - first[row]) * window
    at = start[:, None] + np.arange(window)
    inside = at < offsets[1:][row][:, None]
    values = np.full(at.shape, PAD, np.int16)
    values[inside] = data[at[inside]]
    return values, row


def train(
    texts: list[str], labels: list[str], hidden: int = 8, window: int = 64, epochs: int = 6, batch: int = 256,
    rate: float = 0.02, seed: int = 7,
) -> tuple[dict[str, np.ndarray], list[str]]:
    """Weights and the label names in order."""
    names = sorted(set(labels))
    p = init(len(names), hidden, seed)
    data, offsets = utf8_buffers(pa.array(texts, pa.string()))
    x, row = windows_of(data, offsets, window)
    y = np.array([names.index(v) for v in labels], np.int64)[row]
    rng = np.random.default_rng(seed)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step, total = 0, epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            _, grads = loss_and_grads(p, np.ascontiguousarray(x[pick].T), y[pick])
            step += 1
            now = rate * (1 - step / (total + 1))
            for k, g in grads.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p[k] -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p, names


def label_positions(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Probabilities (steps, windows, labels) of every position of ``x`` (steps, windows)."""
    forward, _ = run_layer(x, p["xf"], p["uf"])
    backward, _ = run_layer(x[::-1], p["xb"], p["ub"])
    probs = forward[1:] @ p["of"]
    probs += backward[1:][::-1] @ p["ob"]
    probs += p["bias"]
    probs -= probs.max(-1, keepdims=True)
    np.exp(probs, out=probs)
    probs /= probs.sum(-1, keepdims=True)
    return probs


def pooled(p: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray, window: int) -> np.ndarray:
    """Mean probabilities of each row over all its bytes."""
    values, row = windows_of(data, offsets, window)
    sums = np.zeros((len(offsets) - 1, len(p["bias"])))
    for at in range(0, len(values), TOGETHER):
        x = np.ascontiguousarray(values[at : at + TOGETHER].T)
        probs = label_positions(p, x)
        if (x == PAD).any():
            probs *= (x != PAD)[..., None]
        np.add.at(sums, row[at : at + TOGETHER], probs.sum(0, dtype=np.float64))
    return sums / np.maximum(np.diff(offsets), 1)[:, None]


def learn(
    docs: DataFrame,
    sample_docs: int = 400,
    sample_chars: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    **options,
) -> tuple[dict[str, np.ndarray], list[str]] | None:
    """Train on a bounded sample of the labelled rows of ``docs``."""
    text = F.col(f"`{text_col}`").cast("string")
    room = F.length(text) - PIECE + 1
    start = lambda i: (F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.lit(i)), room) + 1).cast("int")
    pieces = F.concat_ws("\n", *[F.substring(text, start(i), F.lit(PIECE)) for i in range(max(1, sample_chars // PIECE))])
    known = docs.select(
        F.when(F.length(text) > sample_chars, pieces).otherwise(text).alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
        F.xxhash64(F.col(id_col).cast("string")).alias("order"),
    ).filter("lang is not null and text is not null and text <> ''")
    # Rows of one label are thinned by hash to about four samples before they are ranked.
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, max(1, n // (4 * sample_docs)))])
    thin = known.filter(F.pmod("order", share[F.col("lang")]) == 0)
    rank = F.row_number().over(W.partitionBy("lang").orderBy("order", "text"))
    rows = thin.withColumn("rank", rank).filter(F.col("rank") <= sample_docs).orderBy("lang", "rank").collect()
    return train([r["text"] for r in rows], [r["lang"] for r in rows], **options)


def identify(
    docs: DataFrame,
    model: tuple[dict[str, np.ndarray], list[str]] | None,
    window: int = 64,
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (columns of those names are replaced)."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    source = docs.select(F.col(f"`{text_col}`").cast("string").alias("_lang_text"), *[F.col(f"`{c}`") for c in names])
    schema = source.drop("_lang_text").schema.add("lang_pred", "string").add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value
        for batch in batches:
            texts = batch.column(0)
            has_letter = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            best, score = np.full(len(texts), -1), np.zeros(len(texts))
            data, offsets = utf8_buffers(texts)
            if learned is not None:
                for first, last in slices(offsets):
                    part = offsets[first : last + 1]
                    probs = pooled(learned[0], data[part[0] : part[-1]], part - part[0], window)
                    best[first:last], score[first:last] = probs.argmax(1), probs.max(1)
            known = has_letter & (best >= 0)
            predicted = [learned[1][b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
            scores = np.where(known, np.clip(score, 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(predicted, pa.string()), pa.array(scores)], names=schema.names
            )

    return source.mapInArrow(task, schema)
