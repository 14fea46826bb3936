"""Masked pooling: from logits of a bag's instances to a logit of the bag and weights of instances.

Long tables (bag_id, win_idx, class, x) take the place of padded tensors: a masked instance is a
row that isn't there, so junk behind a mask can't matter. Every pooler is a grouped aggregate with
map-side partial sums; weights, of which each instance has one, are sums over a window of the bag. A
bag without instances has no row (null after an outer join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalar import EPS, safe_logit, sigmoid

KEYS = ("bag_id", "class")
#: Width of a step of exponents: sums of exp(_STEP / 2) don't overflow, and most bags have one step.
_STEP = 512.0


def _sharpness(r: float) -> float:
    return min(max(float(r), 1e-3), 1e3)


def pool(instances: DataFrame, r: float = 1.0, keys=KEYS) -> DataFrame:
    """keys, n, mean, max, lme, linear_softmax.

    lme = (log sum exp(r x) - log n) / r; linear_softmax = logit(sum p^2 / sum p), p = sigmoid(x).
    Exponents are summed in steps of r x, each less by the middle of its step so that none overflows.
    Of a bag only the two highest steps count: what lies below them is less than exp(-_STEP) of it.
    These are sums all the way, so a bag with very many instances is summed in many tasks; nearly all
    bags have one step.
    """
    r = _sharpness(r)
    p, x = sigmoid(F.col("x")), r * F.col("x")
    step = F.floor((x + _STEP / 2) / _STEP)
    sums = instances.groupBy(*keys, step.cast("long").alias("step")).agg(
        F.count("*").alias("n"), F.sum("x").alias("x"), F.max("x").alias("max"),
        F.sum(F.exp(x - step * _STEP)).alias("e"), F.sum(p).alias("p1"), F.sum(p * p).alias("p2"),
    )
    odd = F.col("step") % 2 != 0
    of = lambda side: F.max_by("e", F.when(side, F.col("step")))
    whole = sums.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("x").alias("x"), F.max("max").alias("max"), F.max("step").alias("top"), F.sum("p1").alias("p1"), F.sum("p2").alias("p2"),
        of(odd).alias("e_odd"), of(~odd).alias("e_even"), F.max(F.when(odd, F.col("step"))).alias("at_odd"), F.max(F.when(~odd, F.col("step"))).alias("at_even"),
    )
    part = lambda side: F.coalesce(F.col(f"e_{side}") * F.exp((F.col(f"at_{side}") - F.col("top")) * _STEP), F.lit(0.0))
    share = F.col("p2") / F.greatest(F.col("p1"), F.lit(EPS))
    lme = (F.col("top") * _STEP + F.ln(part("odd") + part("even")) - F.ln("n")) / r
    return whole.select(*keys, "n", (F.col("x") / F.col("n")).alias("mean"), "max", lme.alias("lme"), safe_logit(share).alias("linear_softmax"))


def weights(instances: DataFrame, r: float = 1.0, keys=KEYS, order: str = "win_idx") -> DataFrame:
    """keys, order, and w_mean, w_max, w_lme, w_linear_softmax; the first of equal maxima takes all."""
    r, bag = _sharpness(r), Window.partitionBy(*keys)
    p = sigmoid(F.col("x"))
    rows = instances.withColumns({"top": F.max("x").over(bag), "n": F.count("*").over(bag), "p1": F.sum(p).over(bag)})
    e = F.exp(r * (F.col("x") - F.col("top")))
    first = F.row_number().over(bag.orderBy(F.desc("x"), order)) == 1
    return rows.select(
        *keys, order, (1 / F.col("n")).alias("w_mean"), first.cast("double").alias("w_max"),
        (e / F.sum(e).over(bag)).alias("w_lme"), (p / F.greatest(F.col("p1"), F.lit(EPS))).alias("w_linear_softmax"),
    )


def long(pooled: DataFrame, names=("mean", "max", "lme", "linear_softmax"), keys=KEYS) -> DataFrame:
    """A row for each pooler: keys, pooling, logit."""
    return pooled.unpivot(list(keys), list(names), "pooling", "logit")


def truncated(instances: DataFrame, n: int, order: str = "win_idx") -> DataFrame:
    """Instances as if each bag had ended after n of them."""
    return instances.where(F.col(order) < n)


def gate(vector: str, v: list[list[float]], b: list[float], u: list[list[float]], c: list[float], w: list[float], d: float) -> Column:
    """Gated attention score of a vector: w . (tanh(V e + b) * sigmoid(U e + c)) + d, in built-in functions."""
    def linear(row: list[float], bias: float) -> Column:
        parts = F.zip_with(F.array(*map(F.lit, map(float, row))), F.col(vector), lambda a, x: a * x)
        return F.aggregate(parts, F.lit(float(bias)), lambda s, x: s + x)

    total = F.lit(float(d))
    for i, weight in enumerate(w):
        total = total + float(weight) * F.tanh(linear(v[i], b[i])) * sigmoid(linear(u[i], c[i]))
    return total


def attention(instances: DataFrame, keys=KEYS) -> DataFrame:
    """keys, attention: the sum of x weighted with the softmax of ``gate`` over the bag."""
    bag = Window.partitionBy(*keys)
    e = F.exp(F.col("gate") - F.max("gate").over(bag))
    return instances.withColumn("e", e).groupBy(*keys).agg((F.sum(F.col("e") * F.col("x")) / F.sum("e")).alias("attention"))


def prefixes(instances: DataFrame, r: float = 1.0, keys=KEYS, order: str = "win_idx") -> DataFrame:
    """keys, n, mean, max, lme, linear_softmax of the first n instances of a bag, for every n in one pass.

    With a column ``gate`` also attention, the mean of x weighted with exp(gate). Sums run along the bag;
    exponentials are summed within steps as in ``pool``, and of every prefix the two highest steps count.
    No bag is copied for a prefix. ``order`` tells the instances of a bag apart.
    """
    r, gated = _sharpness(r), "gate" in instances.columns
    upto = (Window.unboundedPreceding, Window.currentRow)
    bag = Window.partitionBy(*keys).orderBy(order).rowsBetween(*upto)
    p, n = sigmoid(F.col("x")), F.count("*").over(bag)
    parts = {"lme": r * F.col("x")} | ({"attention": F.col("gate")} if gated else {})
    rows = instances.withColumns({"_n": n, "_p": p} | {f"_k_{c}": F.floor((v + _STEP / 2) / _STEP) for c, v in parts.items()})
    sums = {}
    for c, v in parts.items():
        step = Window.partitionBy(*keys, f"_k_{c}").orderBy(order).rowsBetween(*upto)
        e = F.exp(v - F.col(f"_k_{c}") * _STEP)
        sums[f"_s_{c}"] = F.struct(F.col(f"_k_{c}").alias("k"), F.col("_n").alias("n"), F.sum(e).over(step).alias("e"), F.sum(e * F.col("x")).over(step).alias("ex"))
    rows = rows.withColumns(sums)
    last = {}
    for c in parts:  # the latest sums of the highest odd and of the highest even step so far
        odd = F.col(f"_k_{c}") % 2 != 0
        last |= {f"_odd_{c}": F.max(F.when(odd, F.col(f"_s_{c}"))).over(bag), f"_even_{c}": F.max(F.when(~odd, F.col(f"_s_{c}"))).over(bag)}
    p2, p1 = F.sum(F.col("_p") * F.col("_p")).over(bag), F.sum("_p").over(bag)
    rows = rows.withColumns(last | {"_mean": F.avg("x").over(bag), "_max": F.max("x").over(bag), "_share": p2 / F.greatest(p1, F.lit(EPS))})

    def whole(c: str, of: str) -> tuple[Column, Column]:
        """The highest step so far and the sum at it, of a part of the structs."""
        top = F.greatest(F.col(f"_odd_{c}.k"), F.col(f"_even_{c}.k"))
        one = lambda side: F.coalesce(F.col(f"_{side}_{c}.{of}") * F.exp((F.col(f"_{side}_{c}.k") - top) * _STEP), F.lit(0.0))
        return top, one("odd") + one("even")

    top, e = whole("lme", "e")
    out = [F.col("_n").alias("n"), F.col("_mean").alias("mean"), F.col("_max").alias("max"), ((top * _STEP + F.ln(e) - F.ln("_n")) / r).alias("lme"), safe_logit(F.col("_share")).alias("linear_softmax")]
    if gated:
        out.append((whole("attention", "ex")[1] / whole("attention", "e")[1]).alias("attention"))
    return rows.select(*keys, *out)
