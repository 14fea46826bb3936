"""Length buckets that waste the least padding, and token-budget batches inside each bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, with_repeats, word_count

BUCKETS, BUDGET = 16, 32_768
#: Rows of a slot, the part of a bucket that one task numbers.
SLOT = 50_000


def _best_cuts(best: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every b the a <= b of least best[a] + bounds[b-1] * (rows[b] - rows[a]), and that cost.

    The best a never falls as b rises, so all middles of a level of halvings are answered together, each
    between the answers of its neighbours on the levels before: n log n in all.
    """
    n = len(bounds)
    at, cost = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1)
    known = np.array([0, n + 1])  # answered b, with 0 and one past the end
    low = np.array([0, n])  # their answers
    while True:
        left, right = known[:-1], known[1:]
        wide = right - left > 1
        if not wide.any():
            return at, cost
        b = (left[wide] + right[wide]) // 2
        first, last = low[:-1][wide], np.minimum(low[1:][wide], b)
        size = last - first + 1
        ends = np.cumsum(size)
        a = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(first, size)
        each = best[a] + np.repeat(bounds[b - 1], size) * (np.repeat(rows[b], size) - rows[a])
        cost[b] = np.minimum.reduceat(each, ends - size)
        # the first of equal costs
        hit = np.flatnonzero(each == np.repeat(cost[b], size))
        of = np.searchsorted(ends, hit, side="right")
        at[b] = a[hit[np.unique(of, return_index=True)[1]]]
        order = np.argsort(np.concatenate([known, b]), kind="stable")
        known, low = np.concatenate([known, b])[order], np.concatenate([low, at[b]])[order]


def boundaries(bounds: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """Upper ends, some of ``bounds`` (rising lengths), of at most ``buckets`` buckets with the least padding.

    The padding is sum(counts * (end - bound)). Dynamic program over the histogram: best[b] of the
    first b lengths with one bucket more is the least of best[a] + bounds[b-1] * (rows in a..b) over a;
    the sum of all lengths is the same for any choice.
    """
    n = len(bounds)
    rows = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    best = np.concatenate([[0.0], bounds * rows[1:]])
    cuts = [np.zeros(n + 1, dtype=np.int64)]
    for _ in range(1, min(buckets, n)):
        at, best = _best_cuts(best, bounds, rows)
        cuts.append(at)
    ends, b = [], n
    for at in reversed(cuts):
        if b == 0:
            break
        if at[b] < b:
            ends.append(bounds[b - 1])
            b = at[b]
    return np.array(sorted(ends))


def pack(docs: DataFrame, tokens: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_tokens, bucket_len, batch_id, place, padding for every row of docs.

    A row goes to the first bucket whose length holds it; a batch has budget // bucket_len rows of one
    bucket, so no batch pads to more than the budget. Bucket lengths are lengths of rows, and no other
    choice of ``buckets`` of them pads less. A row longer than the budget is a batch of its own, padded
    to itself, and takes no part in that choice; the histogram of the others has ``budget`` entries at
    most. All batches of a bucket are full but its last one. Tokens are counted with ``tokens``, by
    default the words between ASCII white space; null texts have 0. Rows are whole, never cut; rows
    alike in ``keep`` and text count one by one. An empty table gives an empty one.

    A bucket is numbered in slots (by hash of the row and its ordinal among rows alike) of about SLOT
    rows, each offset by the rows of the slots before it, so that no bucket and no repeated row is
    sorted in one task.
    """
    n = word_count("text") if tokens is None else tokens
    nulls = (F.col(f"`{c}`").isNull() for c in keep)
    alike = F.xxhash64(*(F.col(f"`{c}`") for c in keep), *nulls, F.md5(F.coalesce("text", F.lit(""))))
    rows = cut(docs.select(*keep, n.cast("long").alias("n_tokens"), alike.alias("_alike")))
    histogram = rows.where(F.col("n_tokens") <= budget).groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").toPandas()
    lengths, counts = histogram["n_tokens"].to_numpy(dtype=np.float64), histogram["n"].to_numpy(dtype=np.float64)
    ends = boundaries(lengths, counts, buckets) if len(lengths) else np.array([])
    total = np.diff(np.concatenate([[0], np.cumsum(counts)[np.searchsorted(lengths, ends)]])) if len(lengths) else ends
    longer = rows.where(F.col("n_tokens") > budget).count()

    def bucket_of(length: Column, slot_rows: float, per_batch: int) -> Column:
        slots = int(max(1, -(-slot_rows // SLOT)))
        return F.struct(length.cast("long").alias("bucket_len"), F.lit(slots).alias("slots"), F.lit(per_batch).cast("long").alias("per_batch"))

    chosen = [F.when(F.col("n_tokens") <= int(e), bucket_of(F.lit(int(e)), c, int(max(1, budget // max(1, e))))) for e, c in zip(ends, total, strict=True)]
    rows = with_repeats(rows, "_alike", "_again").withColumn("_h", F.xxhash64("_alike", "_again"))
    rows = rows.withColumn("_b", F.coalesce(*chosen, bucket_of(F.col("n_tokens"), longer, 1))).select(*keep, "n_tokens", "_h", "_b.*")
    rows = rows.withColumn("_slot", F.pmod("_h", "slots").cast("int"))
    of = ["bucket_len", "_slot"]
    before = Window.partitionBy("bucket_len").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(of).agg(F.count("*").alias("n")).select(*of, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    in_slot = Window.partitionBy(of).orderBy("_h")
    numbered = rows.withColumn("_i", F.row_number().over(in_slot) - 1).join(broadcast_if_small(cut(offsets)), of)
    at = F.col("_i") + F.col("_offset")
    batch = F.floor(at / F.col("per_batch"))
    return numbered.select(
        *keep, "n_tokens", "bucket_len", F.concat_ws("-", "bucket_len", batch).alias("batch_id"),
        (at - batch * F.col("per_batch")).cast("long").alias("place"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
