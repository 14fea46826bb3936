"""Embedding near duplicates: random-hyperplane tables, exact cosine verification, components.

What is dealt to the tables is a sketch of each vector, its direction in bytes and a bound on the
rounding, not the vector. A pair whose sketches decide is linked or left at once; pairs in between,
few, meet again with their vectors and are decided by the cosine in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, cut
from .components import connected_components

#: Vectors of a bucket that one step compares; larger buckets are cut into chunks of about this size.
CHUNK = 2048
#: Vectors that share a bucket by chance, about: more mean fewer tables to move, and more comparisons.
BUCKET = 512
_SHIFTED = 32  # groups up to this size are compared by shifts, larger ones by a matrix product
_SLAB = 256
#: Where dim, table and code stand in the number of a bucket.
_DIM, _TABLE = 40, 28


def table_sizes(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """Bits a table and tables, so that a pair at ``cosine`` meets in some table with ``recall``.

    Bits grow with log2 of the number of vectors, which keeps buckets of unrelated vectors small.
    """
    bits = min(_TABLE, max(4, round(math.log2(max(n, 1) / BUCKET))))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def usable(vector: Column) -> Column:
    """True for vectors without nulls and non-finite components that aren't zero; never null."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(vectors: np.ndarray) -> np.ndarray:
    # scaled by the largest component first, so that squares neither overflow nor vanish
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))


def _sketch(vectors: np.ndarray) -> list[bytes]:
    """Of each vector: a step, the length of what rounding leaves (two float32), the direction in steps (int8)."""
    unit = _units(vectors.astype(np.float64))
    step = (np.abs(unit).max(axis=1) / 127).astype(np.float32)
    q = np.clip(np.rint(unit / step[:, None].astype(np.float64)), -127, 127)
    left = np.linalg.norm(unit - q * step[:, None].astype(np.float64), axis=1)
    left = np.nextafter(left.astype(np.float32) + np.float32(1e-7), np.float32(np.inf))
    head = np.column_stack([step, left]).astype("<f4")
    return [h.tobytes() + b.tobytes() for h, b in zip(head, q.astype(np.int8), strict=True)]


def sketched(vector: Column) -> Column:
    """Sketch of a usable vector; null for null."""

    @F.arrow_udf(T.BinaryType())
    def sketch(batch: pa.Array) -> pa.Array:
        out: list = [None] * len(batch)
        at = np.flatnonzero(batch.is_valid().to_numpy(zero_copy_only=False))
        full = batch.drop_null()
        values, offsets = full.flatten().to_numpy(zero_copy_only=False), full.offsets.to_numpy()
        offsets = offsets - offsets[0] if len(offsets) else offsets
        dims = np.diff(offsets)
        for d in np.unique(dims):
            of = np.flatnonzero(dims == d)
            rows = values[offsets[of][:, None] + np.arange(d)]
            for i, b in zip(at[of], _sketch(rows), strict=True):
                out[i] = b
        return pa.array(out, pa.binary())

    return sketch(vector)


def _opened(packed: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions (float, whole numbers), steps and remainders of sketches of one length."""
    whole = np.frombuffer(b"".join(packed.to_pylist()), dtype=np.uint8).reshape(len(packed), -1)
    head = np.ascontiguousarray(whole[:, :8]).view("<f4").astype(np.float64)
    dim = whole.shape[1] - 8
    # products of whole numbers are exact in either type, so every way to compare gives the same
    return np.ascontiguousarray(whole[:, 8:]).view(np.int8).astype(np.float32 if dim <= 1000 else np.float64), head[:, 0], head[:, 1]


def _codes(q: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """A row of ``tables`` codes for each direction; a bit is the side of a hyperplane it is on.

    Hyperplanes are random (fixed seed) with whole-number normals, so a side never depends on rounding.
    """
    # drawn one after the other, so that the first tables are the same whatever follows them
    planes = np.rint(np.random.default_rng(q.shape[1]).standard_normal((tables * bits, q.shape[1])) * 64)
    side = q.astype(np.float64) @ planes.T > 0
    return (side.reshape(len(q), tables, bits) << np.arange(bits)).sum(axis=2, dtype=np.int64)


def buckets(packed: Column, bits: int, tables: int) -> Column:
    """Array of the numbers of the ``tables`` buckets of a sketch: dim, table and code in one long."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def placed(batch: pa.Array) -> pa.Array:
        out: list = [None] * len(batch)
        sizes = np.array([len(b) for b in batch.to_pylist()])
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            number = _codes(_opened(batch.take(pa.array(at)))[0], bits, tables) | (np.arange(tables) << _TABLE) | (int(d - 8) << _DIM)
            for i, row in zip(at, number, strict=True):
                out[i] = row
        return pa.array(out, pa.list_(pa.int64()))

    return placed(packed)


def _candidates(group: np.ndarray, side: np.ndarray, q: np.ndarray, step: np.ndarray, left: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Slabs of (i, j, cosine of the sketches, bound on its error) of pairs that may reach the cosine.

    Rows of one group are compared; side is -1 in a group of one chunk, and in a group of two, where
    it is 0 or 1, only pairs across count.
    """

    def judged(i: np.ndarray, j: np.ndarray, dot: np.ndarray) -> tuple[np.ndarray, ...]:
        near, bound = dot.astype(np.float64) * (step[i] * step[j]), left[i] + left[j] + left[i] * left[j] + 1e-12
        some = near + bound >= cosine
        return i[some], j[some], near[some], bound[some]

    ends = np.append(np.nonzero(np.diff(group))[0] + 1, len(group))
    starts = np.append(0, ends[:-1])
    small = np.repeat(ends - starts <= _SHIFTED, ends - starts)
    for d in range(1, _SHIFTED):
        i = np.nonzero((group[:-d] == group[d:]) & small[:-d] & ((side[:-d] != side[d:]) | (side[:-d] < 0)))[0]
        if len(i):
            yield judged(i, i + d, np.einsum("ij,ij->i", q[i], q[i + d]))
    for a, b in zip(starts, ends, strict=True):
        if b - a <= _SHIFTED:
            continue
        rows = np.arange(a, b)
        first, second = (rows, rows) if side[a] < 0 else (rows[side[a:b] == 0], rows[side[a:b] == 1])
        if not (len(first) and len(second)):
            continue
        # a dot product below this can't reach the cosine with any partner
        most, widest = left[second].max(), step[second].max()
        least = (cosine - left[first] - most - left[first] * most - 1e-9) / step[first]
        least = np.where(least > 0, least / widest, least / step[second].min()) * (1 - 1e-6)
        for x in range(0, len(first), _SLAB):
            dot = q[first[x : x + _SLAB]] @ q[second].T
            i, j = np.nonzero(dot >= least[x : x + _SLAB, None] - 1)
            dot = dot[i, j]
            i, j = first[i + x], second[j]
            once = slice(None) if side[a] >= 0 else i < j
            yield judged(i[once], j[once], dot[once])


def _roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each row is connected with by ``root``, which holds that so far, and the pairs."""
    i, j = root[i], root[j]
    while True:
        was = root.copy()
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        root = root[root]
        if np.array_equal(was, root):
            return root


_SUMS = "id long, links long, root long"
_AGAIN = "bucket long, part long, weight long, packed binary"


def _compare(rows: pa.Table, bits: int, cosine: float, exact: bool) -> Iterator[pa.RecordBatch]:
    """Links of whole groups of one dim: a row for each vector with any, its weight of new links and its root.

    Without ``exact`` pairs that sketches leave open are not decided; their rows come back with their
    cell instead. With it only those are decided, by the vectors.
    """
    n = rows.num_rows
    col = lambda c: rows.column(c).to_numpy()
    bucket, part, weight, ids = col("bucket"), col("part"), col("weight"), col("id")
    packed = rows.column("packed").combine_chunks()
    q, step, left = _opened(packed)
    fresh = np.zeros(n, dtype=np.int64)
    fresh[1:] = (np.diff(bucket) != 0) | (np.diff(part) != 0)
    table = (bucket >> _TABLE) & ((1 << (_DIM - _TABLE)) - 1)
    codes = None
    unit = _units(rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)) if exact else None
    low, high = part >> 32, part & 0xFFFFFFFF
    links, open_, root = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool), np.arange(n)
    for i, j, near, bound in _candidates(np.cumsum(fresh), np.where(low == high, -1, weight & 1), q, step, left, cosine):
        if not len(i):
            continue
        if codes is None:
            codes = _codes(q, bits, int(table.max()) + 1)
        # a pair that met in an earlier table was counted there
        met = np.zeros(len(i), dtype=bool)
        for t in range(int(table[i].max())):
            met |= (codes[i, t] == codes[j, t]) & (t < table[i])
        i, j, near, bound = i[~met], j[~met], near[~met], bound[~met]
        sure = near - bound >= cosine
        if exact:
            i, j = i[~sure], j[~sure]
            link = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
        else:
            open_[i[~sure]] = open_[j[~sure]] = True
            link = sure
        i, j = i[link], j[link]
        np.add.at(links, i, weight[j] >> 1)
        np.add.at(links, j, weight[i] >> 1)
        root = _roots(root, i, j)
    at = np.flatnonzero(links)
    sums = [pa.array(ids[at]), pa.array(links[at]), pa.array(ids[root[at]])]
    if exact:
        yield pa.RecordBatch.from_arrays(sums, names=["id", "links", "root"])
        return
    none = [pa.nulls(len(at), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
    names = ["id", "links", "root", "bucket", "part", "weight", "packed"]
    yield pa.RecordBatch.from_arrays([*sums, *none], names=names)
    again = np.flatnonzero(open_)
    more = [pa.array(x[again]) for x in (bucket, part, weight)]
    yield pa.RecordBatch.from_arrays([pa.array(ids[again]), pa.nulls(len(again), pa.int64()), pa.nulls(len(again), pa.int64()), *more, packed.take(pa.array(again))], names=names)


def _compare_groups(bits: int, cosine: float, exact: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of a group that may go on in the next batch
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not rows.num_rows:
                continue
            bucket, part = (rows.column(c).to_numpy() for c in ("bucket", "part"))
            last = int(np.append(0, np.nonzero(np.diff(bucket) | np.diff(part))[0] + 1)[-1])
            for a, b in _runs(bucket[:last] >> _DIM):
                yield from _compare(rows.slice(a, b - a), bits, cosine, exact)
            held = rows.slice(last)
        if held is not None and held.num_rows:
            yield from _compare(held, bits, cosine, exact)

    return step


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(values):
        ends = np.append(np.nonzero(np.diff(values))[0] + 1, len(values))
        yield from zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.95, vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row; of its columns only vec_id and vector are read.

    Links are pairs with the cosine (double precision) or more; none below is ever made. ``recall``
    is the chance that a pair exactly at the cosine is found, nearer pairs are found more surely.
    Null or zero vectors and those with null or non-finite components link with nothing, vectors of
    different length neither. Equal vectors are one node with a count, so copies are never paired.
    A null vec_id never is the smallest; a component of nulls alone has a null id and is kept.

    A bucket with more than CHUNK vectors is cut into chunks; every two chunks meet in a cell of
    their own, so no task holds a bucket. A cell returns sums and one root for each vector. Vectors
    themselves move only for pairs that their sketches leave open, once for each cell of such a pair.
    """
    v = F.col(vector)
    keys = [F.when(usable(v), F.xxhash64(F.lit(i), v)).alias(f"key{i}") for i in (0, 1)]
    rows = vectors.select("vec_id", *keys, v.alias("vector"))
    key = ["key0", "key1"]
    sketches = rows.where("key0 is not null").select("vec_id", *key, sketched(F.col("vector")).alias("packed"))
    nodes = cut(sketches.groupBy(key).agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.first("packed").alias("packed")))
    # numbers of the rows of written partitions, the same whenever they are read
    nodes = nodes.withColumn("id", F.monotonically_increasing_id())
    bits, tables = table_sizes(nodes.count(), cosine, recall)
    placed = nodes.select("id", "n", "packed", F.explode(buckets(F.col("packed"), bits, tables)).alias("bucket"))
    large = nodes.select(F.explode(buckets(F.col("packed"), bits, tables)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("members")).where(F.col("members") > CHUNK)
    placed = placed.join(broadcast_if_small(cut(large)), "bucket", "left")
    placed = placed.withColumn("chunks", F.coalesce(F.ceil(F.col("members") / CHUNK), F.lit(1)).cast("long"))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    part = F.shiftleft(F.least("chunk", "other"), 32).bitwiseOR(F.greatest("chunk", "other"))
    weight = 2 * F.col("n") + (F.col("chunk") > F.col("other")).cast("long")
    cell = ["bucket", "part"]
    placed = placed.select("bucket", part.alias("part"), "id", weight.alias("weight"), "packed")
    dealt = lambda df: df.repartition(*cell).sortWithinPartitions(*cell)
    found = cut(dealt(placed).mapInArrow(_compare_groups(bits, cosine, False), f"{_SUMS}, {_AGAIN}"))
    # the vectors of the pairs left open: one for each node, whatever its copies
    again = found.where("bucket is not null").select("id", *cell, "weight", "packed")
    wanted = broadcast_if_small(cut(nodes.select("id", *key).join(broadcast_if_small(cut(again.select("id").distinct())), "id")))
    open_ = rows.where("key0 is not null").join(wanted, key).groupBy("id").agg(F.first("vector").alias("vector"))
    decided = dealt(again.join(open_, "id")).mapInArrow(_compare_groups(bits, cosine, True), _SUMS)
    sums = found.where("bucket is null").select("id", "links", "root").union(cut(decided))
    links = sums.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(sums.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
    named = cut(nodes.drop("packed").join(links, "id", "left").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id")))
    least = broadcast_if_small(cut(named.groupBy("component").agg(F.min("first").alias("component_id"))))
    named = named.join(least, "component").select(*key, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    done = rows.drop("vector").join(broadcast_if_small(cut(named)), key, "left")
    component = F.when(F.col("key0").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return done.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
