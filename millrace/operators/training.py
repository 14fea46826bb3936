"""Training of probes with pooling, over bags that stay distributed.

``train_batches`` takes mini-batches with dropout: one barrier stage holds the bags, a batch's gradients
are summed over its tasks, and every task takes the same step. ``train`` takes whole-batch steps, one
job a step, for bags that the tasks of a barrier stage can't hold. In both, all fits of a grid (pooling,
seed, fold) advance together, no task needs all bags, and the driver gets parameters only. Poolers, heads
and losses are the usual ones of ``pooling``, with gradients written out.
"""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from multiprocessing.connection import Client, Listener

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalar import ERF, ERF_SCALE

from .metrics import average_precision

EPS = 1e-6
POOLERS = ("mean", "max", "lme", "linear_softmax", "attention")


@dataclass(frozen=True)
class Fit:
    """One fit: a probe (hidden = 0 is linear) under a pooler, its seed, held-out fold and regimes."""

    pooling: str = "mean"
    seed: int = 0
    fold: int = 0
    hidden: int = 0
    attention: int = 16
    r: float = 1.0
    learn_r: bool = False
    ordinal_weight: float = 0.0
    regimes: tuple[str, ...] | None = None

    @property
    def run_id(self) -> str:
        return f"{f'mlp{self.hidden}' if self.hidden else 'linear'}-{f'ord{self.ordinal_weight:g}' if self.ordinal_weight else 'bin'}"


@dataclass
class Settings:
    folds: int = 5
    epochs: int = 60
    check_every: int = 5
    patience: int = 10
    rate: float = 1e-2
    decay: float = 1e-2
    clip: float = 5.0
    batch: int = 256
    #: of train_batches: bags of a mini-batch, share of inputs that are dropped, tasks (None: by the session)
    mini: int = 32
    dropout: float = 0.2
    tasks: int | None = None
    extra: dict = field(default_factory=dict)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def start(fit: Fit, dim: int, classes: int, levels: int) -> dict[str, np.ndarray]:
    """Parameters by seed and fold, alike for every pooler."""
    r = np.random.default_rng([fit.seed, fit.fold])
    n = lambda *s: r.standard_normal(s) / np.sqrt(s[0])
    p = {"w": n(fit.hidden or dim, classes) * 0.1, "b": np.zeros(classes)}
    if fit.hidden:
        p |= {"w1": n(dim, fit.hidden), "b1": np.zeros(fit.hidden)}
    if fit.pooling == "attention":
        p |= {"v": n(dim, fit.attention), "vb": np.zeros(fit.attention), "u": n(dim, fit.attention), "ub": np.zeros(fit.attention), "g": n(fit.attention, classes), "gb": np.zeros(classes)}
    if fit.pooling == "lme" and fit.learn_r:
        p["log_r"] = np.array([math.log(fit.r)])
    if fit.ordinal_weight:
        p["gap"] = np.full((classes, levels - 1), 0.55)
    return p


def _erf(x):
    """The error function, right to 1.5e-7."""
    t, series = 1 / (1 + ERF_SCALE * np.abs(x)), 0.0
    for a in reversed(ERF):
        series = t * (series + a)
    return np.sign(x) * (1 - series * np.exp(-x * x))


def _gelu(x):
    """The form by the error function, and its slope."""
    below = 0.5 * (1 + _erf(x / math.sqrt(2)))
    return x * below, below + x * np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def _softmax(x, mask):
    e = np.where(mask, np.exp(x - np.where(mask, x, -np.inf).max(axis=1, keepdims=True)), 0.0)
    return e / e.sum(axis=1, keepdims=True)


def sharpness(fit: Fit, p: dict) -> float:
    """r of log-mean-exp: given, or learned as its logarithm; between 1e-3 and 1e3."""
    return float(np.clip(np.exp(p["log_r"][0]) if "log_r" in p else fit.r, 1e-3, 1e3))


def forward(fit: Fit, p: dict, x: np.ndarray, mask: np.ndarray, drop: tuple | None = None):
    """Bag logits [n, C] and what the backward pass needs. mask [n, N] is true in at least one place a bag.

    drop: factors of the probe's inputs [n, N, D] and of its hidden units [n, N, H] (None for a linear one).
    """
    keep, m = {}, mask[:, :, None]
    keep["x"] = x if drop is None else x * drop[0]
    if fit.hidden:
        keep["a"], keep["da"] = _gelu(keep["x"] @ p["w1"] + p["b1"])
        if drop is not None:
            keep["a"], keep["da"] = keep["a"] * drop[1], keep["da"] * drop[1]
        z = keep["a"] @ p["w"] + p["b"]
    else:
        z = keep["x"] @ p["w"] + p["b"]
    n = m.sum(axis=1)
    keep["z"] = z
    if fit.pooling == "mean":
        return np.where(m, z, 0).sum(axis=1) / n, keep
    if fit.pooling == "max":
        keep["at"] = np.where(m, z, -np.inf).argmax(axis=1)
        return np.take_along_axis(z, keep["at"][:, None], 1)[:, 0], keep
    if fit.pooling == "lme":
        top, r = np.where(m, z, -np.inf).max(axis=1), sharpness(fit, p)
        e = np.where(m, np.exp(r * np.minimum(z - top[:, None], 0)), 0)
        keep["weight"] = e / e.sum(axis=1, keepdims=True)
        keep["bag"] = top + np.log(e.sum(axis=1) / n) / r
        return keep["bag"], keep
    if fit.pooling == "linear_softmax":
        pr = np.where(m, sigmoid(z), 0)
        s1, s2 = np.maximum(pr.sum(axis=1), EPS), (pr * pr).sum(axis=1)
        q = np.clip(s2 / s1, EPS, 1 - EPS)
        keep |= {"pr": pr, "s1": s1, "s2": s2, "q": q}
        return np.log(q) - np.log1p(-q), keep
    if fit.pooling == "attention":
        keep["t"], keep["s"] = np.tanh(x @ p["v"] + p["vb"]), sigmoid(x @ p["u"] + p["ub"])
        keep["weight"] = _softmax((keep["t"] * keep["s"]) @ p["g"] + p["gb"], m)
        return (keep["weight"] * z).sum(axis=1), keep
    raise ValueError(fit.pooling)


def backward(fit: Fit, p: dict, x: np.ndarray, mask: np.ndarray, keep: dict, dl: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the parameters for the gradient dl [n, C] of the bag logits."""
    m, z, g = mask[:, :, None], keep["z"], {}
    d = dl[:, None, :]
    if fit.pooling == "mean":
        dz = np.where(m, d / m.sum(axis=1, keepdims=True), 0)
    elif fit.pooling == "max":
        dz = np.zeros_like(z)
        np.put_along_axis(dz, keep["at"][:, None], d, 1)
    elif fit.pooling == "linear_softmax":
        pr, s1, s2, q = keep["pr"], keep["s1"][:, None], keep["s2"][:, None], keep["q"][:, None]
        dz = np.where(m, d / (q * (1 - q)) * (2 * pr * s1 - s2) / (s1 * s1) * pr * (1 - pr), 0)
    else:
        dz = keep["weight"] * d
    if fit.pooling == "attention":
        da = z * d
        dg = keep["weight"] * (da - (keep["weight"] * da).sum(axis=1, keepdims=True))
        t, s = keep["t"], keep["s"]
        g["g"], g["gb"] = np.einsum("nih,nic->hc", t * s, dg), dg.sum(axis=(0, 1))
        dh = dg @ p["g"].T
        dv, du = dh * s * (1 - t * t), dh * t * s * (1 - s)
        g |= {"v": np.einsum("nid,nih->dh", x, dv), "vb": dv.sum(axis=(0, 1)), "u": np.einsum("nid,nih->dh", x, du), "ub": du.sum(axis=(0, 1))}
    if "log_r" in p:  # the slope of the bag's logit by log r is the weighted logit less the bag's
        inside = abs(p["log_r"][0]) < math.log(1e3)
        g["log_r"] = np.array([(dl * ((keep["weight"] * z).sum(axis=1) - keep["bag"])).sum() if inside else 0.0])
    g["b"], x = dz.sum(axis=(0, 1)), keep["x"]
    if fit.hidden:
        g["w"] = np.einsum("nih,nic->hc", keep["a"], dz)
        dh = (dz @ p["w"].T) * keep["da"]
        g["w1"], g["b1"] = np.einsum("nid,nih->dh", x, dh), dh.sum(axis=(0, 1))
    else:
        g["w"] = np.einsum("nid,nic->dc", x, dz)
    return g


def loss(fit: Fit, p: dict, x: np.ndarray, mask: np.ndarray, index: np.ndarray, weight: np.ndarray, level_weight: np.ndarray | None = None, drop: tuple | None = None):
    """Weighted cross entropy summed over bags, and gradients; with an ordinal head also over levels 2 and up.

    index [n, C] holds the levels, weight [C] and level_weight [C, L] the weights of positives.
    """
    logit, keep = forward(fit, p, x, mask, drop)
    y = (index > 0).astype(float)
    bce = lambda s, t, w: (w * t * np.logaddexp(0, -s) + (1 - t) * np.logaddexp(0, s)).sum()
    grad = lambda s, t, w: (1 - t) * sigmoid(s) - w * t * sigmoid(-s)
    total, dl, g = bce(logit, y, weight), grad(logit, y, weight), {}
    if fit.ordinal_weight:
        rise = np.logaddexp(0, p["gap"])
        under = np.cumsum(rise, axis=1)
        g["gap"] = np.zeros_like(p["gap"])
        for k in range(under.shape[1]):
            t, w = (index >= k + 2).astype(float), np.ones(y.shape[1]) if level_weight is None else level_weight[:, k + 1]
            s = logit - under[:, k]
            total += fit.ordinal_weight * bce(s, t, w)
            ds = fit.ordinal_weight * grad(s, t, w)
            dl = dl + ds
            g["gap"][:, : k + 1] -= ds.sum(axis=0)[:, None] * sigmoid(p["gap"][:, : k + 1])
    return total, g | backward(fit, p, x, mask, keep, dl)


def padded(vectors: list, mean: np.ndarray, sd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Standardised vectors [n, N, D] with a mask; only a batch is ever padded."""
    sizes = [len(v) for v in vectors]
    x, mask = np.zeros((len(vectors), max(sizes), len(mean))), np.zeros((len(vectors), max(sizes)), bool)
    for i, v in enumerate(vectors):
        x[i, : sizes[i]] = (np.stack([np.asarray(a, dtype=float) for a in v]) - mean) / sd
        mask[i, : sizes[i]] = True
    return x, mask


def role(fit: Fit, folds: int, fold: np.ndarray, regime: np.ndarray) -> np.ndarray:
    """test / val / train of rows; limited regimes leave other rows of train and val out, never of test."""
    out = np.where(fold == fit.fold, "test", np.where(fold == (fit.fold + 1) % folds, "val", "train"))
    return out if fit.regimes is None else np.where((out == "test") | np.isin(regime, fit.regimes), out, "none")


def _batches(pdf: pd.DataFrame, size: int) -> Iterator[pd.DataFrame]:
    for a in range(0, len(pdf), size):
        yield pdf.iloc[a : a + size]


def statistics(bags: DataFrame, fits: list[Fit], settings: Settings) -> dict:
    """Per fit: mean and sd of training windows, weights of positives; one aggregate over all bags, summed in tasks."""
    keys = list({(f.fold, f.regimes): f for f in fits}.values())

    def sums(batches):
        acc: dict = {}
        for pdf in batches:
            for i, f in enumerate(keys):
                mine = pdf[role(f, settings.folds, pdf["fold"].to_numpy(), pdf["regime"].to_numpy()) == "train"]
                if len(mine):
                    x = np.concatenate([np.stack([np.asarray(a, float) for a in v]) for v in mine["vectors"]])
                    index = np.stack(mine["index"].to_list())
                    levels = np.stack([(index >= k).sum(axis=0) for k in range(1, settings.extra["levels"] + 1)], axis=1)
                    new = np.concatenate([[len(x), len(mine)], x.sum(axis=0), (x * x).sum(axis=0), levels.ravel()])
                    acc[i] = acc.get(i, 0) + new
        if acc:
            yield pd.DataFrame({"i": list(acc), "s": [v.tolist() for v in acc.values()]})

    rows = _summed(bags.mapInPandas(sums, "i int, s array<double>"), settings.extra["tasks"])
    dim, levels, out = settings.extra["dim"], settings.extra["levels"], {}
    for i, f in enumerate(keys):
        s = rows[i]
        mean = s[2 : 2 + dim] / s[0]
        var = (s[2 + dim : 2 + 2 * dim] - s[0] * mean**2) / max(1, s[0] - 1)
        pos = s[2 + 2 * dim :].reshape(-1, levels)
        out[(f.fold, f.regimes)] = (mean, np.sqrt(np.maximum(var, 0)) + 1e-6, (s[1] - pos) / np.maximum(pos, 1))
    return out


#: Ways into which the arrays of a fit are dealt before they are added up.
SLOTS = 16


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    acc: dict = {}
    for pdf in batches:
        for i, s in zip(pdf["i"], pdf["s"], strict=True):
            acc[i] = acc.get(i, 0) + np.asarray(s)
    if acc:
        yield pd.DataFrame({"i": list(acc), "s": [v.tolist() for v in acc.values()]})


def _summed(parts: DataFrame, tasks: int) -> dict[int, np.ndarray]:
    """Sums of arrays by i, added whole; what comes back is as large as the parameters.

    The arrays of many tasks are added in two steps, those of few go to the driver as they are.
    """
    schema = "i int, s array<double>"
    if tasks > SLOTS:
        dealt = parts.withColumn("slot", F.spark_partition_id() % SLOTS).repartition("i", "slot").select("i", "s")
        parts = dealt.mapInPandas(_added, schema).repartition("i").mapInPandas(_added, schema)
    out: dict = {}
    for r in parts.collect():
        out[r["i"]] = out.get(r["i"], 0) + np.array(r["s"])
    return out


def _flat(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _shaped(flat: np.ndarray, like: dict) -> dict:
    out, a = {}, 0
    for k in sorted(like):
        out[k] = flat[a : a + like[k].size].reshape(like[k].shape)
        a += like[k].size
    return out


def scores(bags: DataFrame, fits: list[Fit], params: list[dict], stats: dict, settings: Settings) -> DataFrame:
    """fit, bag_id, split, class, y, level, score: probabilities of every bag under every fit."""
    folds, size = settings.folds, settings.batch

    def score(batches):
        for pdf in batches:
            for part in _batches(pdf, size):
                for i, f in enumerate(fits):
                    mean, sd, _ = stats[(f.fold, f.regimes)]
                    logit, _ = forward(f, params[i], *padded(part["vectors"].to_list(), mean, sd))
                    split, index = role(f, folds, part["fold"].to_numpy(), part["regime"].to_numpy()), np.stack(part["index"].to_list())
                    c = logit.shape[1]
                    yield pd.DataFrame({"fit": i, "bag_id": np.repeat(part["bag_id"].to_numpy(), c), "split": np.repeat(split, c), "class": np.tile(np.arange(c), len(part)), "y": (index > 0).astype(int).ravel(), "level": index.ravel(), "score": sigmoid(logit).ravel()})

    return bags.mapInPandas(score, "fit int, bag_id long, split string, class int, y int, level int, score double")


def train(bags: DataFrame, fits: list[Fit], settings: Settings) -> tuple[list[dict], dict, list[int]]:
    """(bag_id, fold, regime, index array<int>, vectors array<array<float>>) -> parameters, statistics, best epochs.

    bags should be cut or cached: each pass reads them once for all fits. The parameters kept are
    those of the first check with the best mean validation average precision of the classes.
    """
    first = bags.select(F.size("index").alias("c"), F.size(F.col("vectors")[0]).alias("d")).first()
    top = bags.select(F.max(F.array_max("index")).alias("m")).first()["m"]
    settings = replace(settings, extra={"dim": first["d"], "levels": max(2, top), "tasks": bags.rdd.getNumPartitions()})
    stats = statistics(bags, fits, settings)
    params = [start(f, first["d"], first["c"], settings.extra["levels"]) for f in fits]
    best = [(-1.0, p, 0) for p in params]
    moments = [[np.zeros(_flat(p).size)] * 2 for p in params]
    for epoch in range(1, settings.epochs + 1):
        live = [i for i in range(len(fits)) if epoch - best[i][2] <= max(settings.patience, settings.check_every)]
        if not live:
            break

        def step(batches, params=params, live=live):
            acc: dict = {}
            for pdf in batches:
                for i in live:
                    f = fits[i]
                    mean, sd, weight = stats[(f.fold, f.regimes)]
                    mine = pdf[role(f, settings.folds, pdf["fold"].to_numpy(), pdf["regime"].to_numpy()) == "train"]
                    for part in _batches(mine, settings.batch):
                        x, mask = padded(part["vectors"].to_list(), mean, sd)
                        value, g = loss(f, params[i], x, mask, np.stack(part["index"].to_list()), weight[:, 0], weight)
                        acc[i] = acc.get(i, 0) + np.concatenate([[value, len(part)], _flat(g)])
            if acc:
                yield pd.DataFrame({"i": list(acc), "s": [v.tolist() for v in acc.values()]})

        got = _summed(bags.mapInPandas(step, "i int, s array<double>"), settings.extra["tasks"])
        params = list(params)
        for i in live:
            g = got[i][2:] / got[i][1]
            g *= min(1.0, settings.clip / (np.linalg.norm(g) + 1e-12))
            m, v = moments[i] = [0.9 * moments[i][0] + 0.1 * g, 0.999 * moments[i][1] + 0.001 * g * g]
            flat = _flat(params[i])
            flat = flat - settings.rate * (m / (1 - 0.9**epoch) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8) + settings.decay * flat)
            params[i] = _shaped(flat, params[i])
        if epoch % settings.check_every == 0 or epoch == settings.epochs:
            val = scores(bags, [fits[i] for i in live], [params[i] for i in live], stats, settings).where("split = 'val'")
            aps = average_precision(val, ["fit", "class"]).groupBy("fit").agg(F.avg("ap").alias("ap")).collect()
            for r in aps:
                i = live[r["fit"]]
                if r["ap"] is not None and r["ap"] > best[i][0]:
                    best[i] = (r["ap"], params[i], epoch)
    return [b[1] for b in best], stats, [b[2] for b in best]


class Held:
    """The bags that a task of the barrier stage holds: windows one after the other, rows in order of bag_id."""

    def __init__(self, batches: Iterator[pa.RecordBatch], dim: int):
        ids, fold, regime, index, sizes, flat = [], [], [], [], [], []
        for b in batches:
            vectors = b.column(4)
            ids += b.column(0).to_pylist()
            fold += b.column(1).to_pylist()
            regime += b.column(2).to_pylist()
            index += b.column(3).to_pylist()
            sizes += vectors.value_lengths().to_pylist()
            flat.append(vectors.flatten().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim))
        order = np.argsort(np.array(ids, dtype=np.int64), kind="stable")
        sizes = np.array(sizes, dtype=np.int64)
        begins = np.cumsum(sizes) - sizes
        self.ids, self.fold, self.regime = np.array(ids, dtype=np.int64)[order], np.array(fold, dtype=np.int64)[order], np.array(regime, dtype=object)[order]
        self.index = np.array(index, dtype=np.int64).reshape(len(ids), -1)[order]
        self.sizes, self.begins = sizes[order], begins[order]
        self.x = np.concatenate(flat) if flat else np.zeros((0, dim), np.float32)

    def padded(self, rows: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[rows]
        mask = np.arange(sizes.max()) < sizes[:, None]
        x = np.zeros((*mask.shape, self.x.shape[1]))
        x[mask] = (np.concatenate([self.x[a : a + n] for a, n in zip(self.begins[rows], sizes, strict=True)]) - mean) / sd
        return x, mask

    def batch_of(self, seed: int, epoch: int, batches: int) -> np.ndarray:
        """The batch of every bag, as ``runs.shuffled_batches`` deals them."""
        return np.array([int(hashlib.md5(f"{seed}:{epoch}:{i}".encode()).hexdigest()[:8], 16) * batches >> 32 for i in self.ids], dtype=np.int64)


def dropped(fit: Fit, epoch: int, ids: np.ndarray, mask: np.ndarray, dim: int, share: float) -> tuple | None:
    """Factors for ``forward``: 0 for a share of inputs and hidden units, the others made larger; by seed, epoch and bag."""
    if not share:
        return None
    widths = [dim, fit.hidden] if fit.hidden else [dim]
    out = [np.ones((*mask.shape, w)) for w in widths]
    for i, bag in enumerate(ids.tolist()):
        rng, n = np.random.default_rng([fit.seed, epoch, bag & 0xFFFFFFFFFFFFFFFF]), int(mask[i].sum())
        for o, w in zip(out, widths, strict=True):
            o[i, :n] = (rng.random((n, w)) >= share) / (1 - share)
    return out[0], out[1] if fit.hidden else None


#: Steps of a score between 0 and 1 that tell validation scores apart in ``train_batches``.
BINS = 2048


def _binned_ap(counts: np.ndarray) -> float | None:
    """Average precision of [2, BINS] counts of negatives and positives; scores of a bin are tied."""
    tp, n = counts[1][::-1], counts.sum(axis=0)[::-1]
    if not tp.sum():
        return None
    ctp, cn = np.cumsum(tp), np.cumsum(n)
    return float((tp * ctp / np.maximum(cn, 1)).sum() / tp.sum())


class Tasks:
    """Sums of arrays over the tasks of a barrier stage.

    A gather of the stage itself takes a second, so it only tells the tasks where the first one listens;
    that one then adds what the others send, in their order, and sends the sum back. If a task is lost
    its connection ends, the others fail, and Spark starts the stage again.
    """

    def __init__(self, context):
        rank, infos = context.partitionId(), context.getTaskInfos()
        listener = key = None
        if rank == 0:
            key = os.urandom(16)
            listener = Listener(("", 0), backlog=len(infos), authkey=key)
        said = context.allGather(f"{listener.address[1]} {key.hex()}" if listener else "")[0].split()
        self.first, self.others = None, []
        if listener is None:
            self.first = Client((infos[0].address.split(":")[0], int(said[0])), authkey=bytes.fromhex(said[1]))
            self.first.send(rank)
        else:
            peers = [listener.accept() for _ in infos[1:]]
            self.others = [p for _, p in sorted(((p.recv(), p) for p in peers), key=lambda x: x[0])]
            listener.close()

    def total(self, flat: np.ndarray) -> np.ndarray:
        if self.first is not None:
            self.first.send_bytes(flat.tobytes())
            return np.frombuffer(self.first.recv_bytes())
        for p in self.others:
            flat = flat + np.frombuffer(p.recv_bytes())
        for p in self.others:
            p.send_bytes(flat.tobytes())
        return flat


class Run:
    """The state of all fits in a task of the barrier stage; all tasks have the same one after every step."""

    def __init__(self, held: Held, fits: list[Fit], stats: dict, settings: Settings, tasks: Tasks):
        self.held, self.fits, self.stats, self.settings, self.tasks = held, fits, stats, settings, tasks
        s = settings.extra
        self.params = [start(f, s["dim"], s["classes"], s["levels"]) for f in fits]
        self.moments = [(np.zeros(_flat(p).size), np.zeros(_flat(p).size)) for p in self.params]
        self.steps = [0] * len(fits)
        self.best = [(-1.0, p, 0) for p in self.params]
        self.roles = [role(f, settings.folds, held.fold, held.regime) for f in fits]
        self.train = [np.flatnonzero(r == "train") for r in self.roles]
        self.batches = np.maximum(self.summed([np.array([len(t) for t in self.train], float)])[0] // settings.mini, 1).astype(int)

    def summed(self, arrays: list[np.ndarray]) -> list[np.ndarray]:
        """The arrays' sums over all tasks, added in the tasks' order, so that every task has the same bits."""
        total = self.tasks.total(np.concatenate([a.ravel() for a in arrays]))
        ends = np.cumsum([a.size for a in arrays])[:-1]
        return [t.reshape(a.shape) for t, a in zip(np.split(total, ends), arrays, strict=True)]

    def gradient(self, i: int, rows: np.ndarray, epoch: int) -> np.ndarray:
        """Number of bags and summed gradients of a part of a batch."""
        f, p = self.fits[i], self.params[i]
        if not len(rows):
            return np.zeros(1 + _flat(p).size)
        mean, sd, weight = self.stats[(f.fold, f.regimes)]
        x, mask = self.held.padded(rows, mean, sd)
        drop = dropped(f, epoch, self.held.ids[rows], mask, x.shape[2], self.settings.dropout)
        _, g = loss(f, p, x, mask, self.held.index[rows], weight[:, 0], weight, drop)
        return np.append(len(rows), _flat(g))

    def update(self, i: int, count: float, g: np.ndarray) -> None:
        """One step of AdamW with a clipped norm."""
        if not count:
            return
        s, (m, v) = self.settings, self.moments[i]
        g = g / count
        g *= min(1.0, s.clip / (np.linalg.norm(g) + 1e-12))
        self.steps[i] += 1
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        flat = _flat(self.params[i])
        flat = flat - s.rate * (m / (1 - 0.9 ** self.steps[i]) / (np.sqrt(v / (1 - 0.999 ** self.steps[i])) + 1e-8) + s.decay * flat)
        self.params[i], self.moments[i] = _shaped(flat, self.params[i]), (m, v)

    def epoch(self, epoch: int, live: list[int]) -> None:
        dealt = {(self.fits[i].seed, self.batches[i]): None for i in live}
        for seed, n in dealt:
            dealt[seed, n] = self.held.batch_of(seed, epoch, n)
        for step in range(max(self.batches[i] for i in live)):
            mine = [i for i in live if step < self.batches[i]]
            parts = []
            for i in mine:
                t = self.train[i]
                parts.append(self.gradient(i, t[dealt[self.fits[i].seed, self.batches[i]][t] == step], epoch))
            for i, total in zip(mine, self.summed(parts), strict=True):
                self.update(i, total[0], total[1:])

    def check(self, epoch: int, live: list[int]) -> None:
        """Keep the parameters of the fits whose validation precision, over all tasks, is the best so far."""
        counts = []
        for i in live:
            f, rows = self.fits[i], np.flatnonzero(self.roles[i] == "val")
            own = np.zeros((self.held.index.shape[1] if len(self.held.ids) else self.settings.extra["classes"], 2, BINS))
            for a in range(0, len(rows), self.settings.batch):
                part = rows[a : a + self.settings.batch]
                logit, _ = forward(f, self.params[i], *self.held.padded(part, *self.stats[(f.fold, f.regimes)][:2]))
                at = np.minimum((sigmoid(logit) * BINS).astype(int), BINS - 1)
                for c in range(own.shape[0]):
                    np.add.at(own[c], ((self.held.index[part, c] > 0).astype(int), at[:, c]), 1)
            counts.append(own)
        for i, total in zip(live, self.summed(counts), strict=True):
            aps = [ap for ap in map(_binned_ap, total) if ap is not None]
            if aps and np.mean(aps) > self.best[i][0]:
                self.best[i] = (float(np.mean(aps)), self.params[i], epoch)


def train_batches(bags: DataFrame, fits: list[Fit], settings: Settings) -> tuple[list[dict], dict, list[int]]:
    """As ``train``, by mini-batches of about ``settings.mini`` bags with dropout, in one barrier stage.

    A batch is made of the bags whose hash of seed and epoch says so, whatever task holds them; its
    gradients are summed over the tasks and every task takes the same AdamW step. So results are those
    of one task up to rounding, and the same on a rerun with as many tasks. Every fit of a seed sees
    the same batches and dropout. The parameters kept are those of the epoch with the best validation
    precision, in which scores of one of BINS steps are tied; a fit stops ``patience`` epochs after.

    The tasks (all at once, so no more than the session has slots) hold all windows in memory, in
    single precision; if a task is lost the stage starts again. What is exchanged in a step is as
    large as the live fits' parameters, times the tasks. A grid too large for that is for ``train``.
    """
    first = bags.select(F.size("index").alias("c"), F.size(F.col("vectors")[0]).alias("d")).first()
    top = bags.select(F.max(F.array_max("index")).alias("m")).first()["m"]
    tasks = settings.tasks or max(1, min(8, bags.sparkSession.sparkContext.defaultParallelism))
    settings = replace(settings, extra={"dim": first["d"], "classes": first["c"], "levels": max(2, top), "tasks": tasks})
    dealt = bags.select("bag_id", "fold", "regime", "index", "vectors").repartition(tasks, "bag_id")
    stats = statistics(dealt, fits, settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        r = Run(Held(batches, settings.extra["dim"]), fits, stats, settings, Tasks(context))
        for epoch in range(1, settings.epochs + 1):
            live = [i for i in range(len(fits)) if epoch - r.best[i][2] <= settings.patience]
            if not live:
                break
            r.epoch(epoch, live)
            r.check(epoch, live)
        if context.partitionId() == 0:
            rows = [(i, b[2], _flat(b[1]).tolist()) for i, b in enumerate(r.best)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.list_(pa.float64())), strict=True)], names=["fit", "epoch", "flat"])

    got = {x["fit"]: x for x in dealt.mapInArrow(run, "fit int, epoch int, flat array<double>", barrier=True).collect()}
    like = [start(f, settings.extra["dim"], settings.extra["classes"], settings.extra["levels"]) for f in fits]
    return [_shaped(np.array(got[i]["flat"]), p) for i, p in enumerate(like)], stats, [got[i]["epoch"] for i in range(len(fits))]


def window_weights(fit: Fit, p: dict, keep: dict, mask: np.ndarray) -> np.ndarray:
    """How much every window counts in its bag [n, N, C]; 0 where there is none."""
    m = mask[:, :, None]
    if fit.pooling == "mean":
        return np.broadcast_to(m / m.sum(axis=1, keepdims=True), keep["z"].shape)
    if fit.pooling == "max":
        out = np.zeros_like(keep["z"])
        np.put_along_axis(out, keep["at"][:, None], 1.0, 1)
        return out
    if fit.pooling == "linear_softmax":
        return keep["pr"] / keep["s1"][:, None]
    return keep["weight"]


def window_outputs(bags: DataFrame, fits: list[Fit], params: list[dict], stats: dict, settings: Settings) -> DataFrame:
    """fit, bag_id, win_idx, class, logit, weight: of every bag's windows under the fits that are tested on its fold.

    A bag meets the parameters of its own test fold only, so a window has one row for each pooler, seed
    and class. A bag without windows has no row; equal maxima give their weight to the first window.
    """
    of_fold: dict[int, list[int]] = {}
    for i, f in enumerate(fits):
        of_fold.setdefault(f.fold, []).append(i)

    def outputs(batches):
        for pdf in batches:
            pdf = pdf[pdf["vectors"].map(lambda v: v is not None and len(v) > 0)]
            for fold, rows in pdf.groupby("fold"):
                for part in _batches(rows, settings.batch):
                    for i in of_fold.get(int(fold), []):
                        f, (mean, sd, _) = fits[i], stats[(fits[i].fold, fits[i].regimes)]
                        x, mask = padded(part["vectors"].to_list(), mean, sd)
                        _, keep = forward(f, params[i], x, mask)
                        weight, c = window_weights(f, params[i], keep, mask), keep["z"].shape[2]
                        bag, win = np.nonzero(mask)
                        yield pd.DataFrame({
                            "fit": i, "bag_id": np.repeat(part["bag_id"].to_numpy()[bag], c), "win_idx": np.repeat(win, c), "class": np.tile(np.arange(c), len(bag)),
                            "logit": keep["z"][mask].ravel(), "weight": weight[mask].ravel(),
                        })

    return bags.select("bag_id", "fold", "vectors").mapInPandas(outputs, "fit int, bag_id long, win_idx int, class int, logit double, weight double")
