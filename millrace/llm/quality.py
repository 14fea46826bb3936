"""A byte-level convolutional network for document quality, in numpy.

Bytes have learned vectors; learned filters slide over them, and their outputs are max-pooled over
overlapping chunks that cover the whole text. A small layer makes one value of each chunk, and the
mean, largest and smallest value of a text's chunks make one probability.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import raw, utf8
from .training import fitted, id_text, labelled_sample

#: Length of a byte's vector, width and step of filters, number of filters, units of the layer.
EMBED, WIDTH, STEP, FILTERS, HIDDEN = 8, 16, 4, 48, 24
#: Filter steps in a block; a chunk is CHUNK blocks, the next one starts HOP blocks later.
BLOCK, CHUNK, HOP = 32, 4, 3
#: Bytes of whole texts that pass through the filters at a time.
_SLICE = 1 << 19
#: Chunks of a text whose maxima, or gradients, are made at a time.
_CHUNKS = 1024
#: The sample: at most so many rows of each label. Epochs, texts a step, learning rate.
PER_CLASS, EPOCHS, BATCH, RATE = 800, 7, 16, 0.004


def start(seed: int = 0) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
    return {
        "embed": f(256, EMBED, scale=0.5),
        "filter": f(WIDTH * EMBED, FILTERS, scale=1 / np.sqrt(WIDTH * EMBED / 2)),
        "fbias": np.zeros(FILTERS, np.float32),
        "w1": f(FILTERS, HIDDEN, scale=1 / np.sqrt(FILTERS)),
        "b1": np.zeros(HIDDEN, np.float32),
        "w2": f(HIDDEN, scale=1 / np.sqrt(HIDDEN)),
        "b2": np.zeros(1, np.float32),
        "top": np.array([1, 0.5, 0.5, 0], np.float32),
    }


def _padded(text: bytes) -> np.ndarray:
    """The bytes with zeros up to a whole number of hops, so that chunks cover them all; never empty."""
    hop = HOP * BLOCK * STEP
    hops = max(1, -(-len(text) // hop))
    size = hops * hop + (CHUNK - HOP) * BLOCK * STEP + WIDTH - STEP
    return np.frombuffer(text.ljust(size, b"\0"), dtype=np.uint8)


def _blocks(p: dict, data: np.ndarray, where: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Largest output of each filter in each block, and in which step it is."""
    n = (len(data) - WIDTH) // STEP + 1
    vectors = p["embed"][data]
    view = np.lib.stride_tricks.as_strided(vectors, (n, WIDTH * EMBED), (STEP * EMBED * 4, 4), writeable=False)
    out = (view @ p["filter"]).reshape(-1, BLOCK, FILTERS)
    return out.max(axis=1), out.argmax(axis=1).astype(np.uint8) if where else None


def _chunked(p: dict, text: bytes, where: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Max-pooled filters of a text's chunks, the byte at which each maximum starts, and the bytes."""
    data = _padded(text)
    count = (len(data) - WIDTH + STEP) // (STEP * BLOCK)
    per = max(1, _SLICE // (STEP * BLOCK))
    parts = [_blocks(p, data[b * STEP * BLOCK : min(b + per, count) * STEP * BLOCK + WIDTH - STEP], where) for b in range(0, count, per)]
    value = np.concatenate([v for v, _ in parts])
    starts = np.arange(0, count - CHUNK + 1, HOP)
    steps = np.concatenate([w for _, w in parts]) if where else None
    del parts
    pooled, at = np.empty((len(starts), FILTERS), np.float32), np.empty((len(starts), FILTERS), np.int32) if where else None
    for a in range(0, len(starts), _CHUNKS):
        own = starts[a : a + _CHUNKS, None]
        around = value[own + np.arange(CHUNK)]
        pooled[a : a + _CHUNKS] = around.max(axis=1)
        if where:
            block = own + around.argmax(axis=1)
            at[a : a + _CHUNKS] = (block * BLOCK + steps[block, np.arange(FILTERS)]) * STEP
    return pooled, at, data


def _combined(p: dict, pooled: np.ndarray):
    h = np.maximum(pooled + p["fbias"], 0)
    u = h @ p["w1"] + p["b1"]
    z = np.maximum(u, 0) @ p["w2"] + p["b2"][0]
    return h, u, z, float(p["top"] @ np.array([z.mean(), z.max(), z.min(), 1], np.float32))


def probability(p: dict, text: str | bytes | None) -> float:
    """Of label 1, for the whole text; an empty one is one chunk of zeros."""
    logit = _combined(p, _chunked(p, raw(text))[0])[3] + float(p["shift"])
    return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def _gradients(p: dict, text: bytes, label: int) -> dict[str, np.ndarray]:
    """Of the loss of one whole text, summed over slices of its chunks (32 MB of text: 250 MB of memory)."""
    pooled, at, data = _chunked(p, text, where=True)
    h, u, z, logit = _combined(p, pooled)
    err = np.float32(1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label)
    g = {"top": err * np.array([z.mean(), z.max(), z.min(), 1], np.float32)}
    dz = np.full(len(z), err * p["top"][0] / len(z), np.float32)
    dz[z.argmax()] += err * p["top"][1]
    dz[z.argmin()] += err * p["top"][2]
    g["w2"], g["b2"] = dz @ np.maximum(u, 0), dz.sum(keepdims=True)
    du = dz[:, None] * p["w2"] * (u > 0)
    g["w1"], g["b1"] = h.T @ du, du.sum(axis=0)
    dh = (du @ p["w1"].T) * (pooled + p["fbias"] > 0)
    g["fbias"] = dh.sum(axis=0)
    g["filter"], g["embed"] = np.zeros_like(p["filter"]), np.zeros_like(p["embed"])
    for a in range(0, len(at), _CHUNKS):
        own = slice(a, a + _CHUNKS)
        seen = data[at[own, :, None] + np.arange(WIDTH)]  # bytes under each maximum
        vectors = p["embed"][seen].reshape(*seen.shape[:2], WIDTH * EMBED)
        g["filter"] += np.einsum("cf,cfk->kf", dh[own], vectors)
        dv = dh[own, :, None] * p["filter"].T[None]
        np.add.at(g["embed"], seen.ravel(), dv.reshape(-1, EMBED))
    return g


def fit(rows: pd.DataFrame, prior: float, label: str = "quality") -> dict[str, np.ndarray]:
    """Adam over the sample; ``prior``, the share of label 1 in all learnable rows, sets the level."""
    p, r, t = start(), np.random.default_rng(1), 0
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    texts = [raw(x) for x in rows["text"]]
    y = rows[label].to_numpy()
    steps = EPOCHS * -(-len(texts) // BATCH)
    for _ in range(EPOCHS):
        order = r.permutation(len(texts))
        for b in range(0, len(order), BATCH):
            batch = order[b : b + BATCH]
            grads = [_gradients(p, texts[i], y[i]) for i in batch]
            t += 1
            rate = RATE * (1 - 0.95 * t / steps)
            for k in p:
                g = sum(x[k] for x in grads) / len(batch)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = (p[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    return p | {"shift": np.float32(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))}


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text (null: 'null') divisible by 5."""
    return F.crc32(id_text(doc_id)) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict[str, np.ndarray]:
    learn = labels.where(~held_out() & F.col("quality").isin(0, 1))
    prior = learn.agg(F.avg("quality")).first()[0]
    sample = labelled_sample(docs, learn, "quality", per_class)
    return fitted(sample, lambda rows: fit(rows, prior)) or start() | {"shift": np.float32(0)}


def score(docs: DataFrame, model: dict[str, np.ndarray], threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; the score sees the text alone.

    Null texts count as empty. Without any labelled row the network is untrained, and scores say nothing.
    """

    @F.arrow_udf(T.DoubleType())
    def net(texts: pa.Array) -> pa.Array:
        return pa.array([probability(model, t) for t in utf8(texts)], pa.float64())

    rows = docs.select("doc_id", held_out().alias("held_out"), net("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
