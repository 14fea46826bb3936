import hashlib
import re
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing, packing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes):
    """Raise the targets in proportion to the weights until the budget is spent; stopped sources drop out."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            budget -= target[s]
        open_ -= full
    return target


def check(df):
    rows = [(r["doc_id"], r["source"], size(r["text"])) for r in df.select("doc_id", "source", "text").collect()]
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    target = plain_targets(sizes)
    got = [tuple(r) for r in mixing.mix(df).collect()]
    key = lambda t: tuple((x is None, x) for x in t)
    want = sorted(((i, n, sizes[s], round(target[s], 6)) for i, s, n in rows), key=key)
    assert sorted(((i, n, s, round(t, 6)) for i, n, s, t, _ in got), key=key) == want
    assert all(taken in (0, n, 2 * n) for _, n, _, _, taken in got)
    return rows, target, got


def test_targets_and_words_taken(spark, sf):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows, target, got = check(df)
    source = {i: s for i, s, _ in rows}
    for s in set(source.values()):
        mine = [g for g in got if source[g[0]] == s]
        assert abs(sum(g[4] for g in mine) - target[s]) <= max(g[1] for g in mine)  # within a document
    assert sorted(got) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()))


def test_odd_rows(odd, clashing):
    check(odd)
    check(clashing)
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mixed(odd.limit(0)).count() == 0


def test_sources_without_words(spark):
    check(spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string"))


def test_mixed_rows_are_those_taken(odd, clashing):
    taken = {}
    for i, n, _, _, t in map(tuple, mixing.mix(odd).collect()):
        taken[(i, n)] = taken.get((i, n), 0) + (t // n if n else 0)
    got = {}
    for r in mixing.mixed(clashing).collect():
        k = (r["doc_id"], size(r["text"]))
        got[k] = got.get(k, 0) + 1
    assert {k: v for k, v in got.items() if k[1]} == {k: v for k, v in taken.items() if v}
    assert mixing.mixed(clashing).columns == clashing.columns


def test_same_as_sql(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = duck.execute(mixing.ORACLE).fetchall()
    got = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert sorted((a, b, c, round(d, 6), e) for a, b, c, d, e in want) == sorted((a, b, c, round(d, 6), e) for a, b, c, d, e in map(tuple, got))


def test_hash(spark):
    got = spark.createDataFrame([(5, "d"), (None, "d")], "doc_id long, digest string").select(mixing.row_hash(F.lit(0)).alias("h")).collect()
    assert [r["h"] for r in got] == [int(hashlib.md5(t.encode()).hexdigest()[:15], 16) for t in ("5:d:0", "null:d:0")]


def test_repeated_rows_are_taken_one_by_one(spark):
    rows = [(None, "same words in all of these", "a")] * 400 + [(7, "w " * 6, "b")] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(df).toPandas()
    for _, mine in got.groupby("source_size"):
        assert abs(mine.taken.sum() - mine.target.iloc[0]) <= mine["size"].max()
    assert sorted(map(tuple, mixing.mix(df.repartition(3)).select("size", "taken").collect())) == sorted(zip(got["size"], got.taken))
    assert mixing.mixed(df).count() == (got.taken // got["size"]).sum()


def test_many_sources_are_numbered_in_order(spark):
    r = np.random.default_rng(0)
    names = [f"s{i}" for i in r.permutation(300)] + [None]
    df = spark.createDataFrame([(i, "w " * int(n), s) for i, (s, n) in enumerate(zip(names, r.integers(0, 50, 301)))], "doc_id long, text string, source string")
    check(df)


@pytest.mark.parametrize("seed", range(5))
def test_boundaries_are_optimal(seed):
    r = np.random.default_rng(seed)
    for _ in range(40):
        n, k = int(r.integers(1, 9)), int(r.integers(1, 5))
        b, c = np.sort(r.choice(50, n, replace=False)).astype(float), r.integers(1, 9, n).astype(float)
        cost = lambda ends: sum(c[i] * (min(e for e in ends if e >= b[i]) - b[i]) for i in range(n))
        got = packing.boundaries(b, c, k)
        assert len(got) <= k and cost(got) == pytest.approx(min(cost([*x, b[-1]]) for m in range(min(k, n)) for x in combinations(b[:-1], m)))


@pytest.mark.parametrize(("slot", "budget"), [(50_000, 32_768), (7, 3000)])
def test_batches(spark, sf, monkeypatch, slot, budget):
    monkeypatch.setattr(packing, "SLOT", slot)
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = packing.pack(df, budget=budget).toPandas()
    assert sorted(got.doc_id) == sorted(r["doc_id"] for r in df.collect())
    n = {r["doc_id"]: size(r["text"]) for r in df.collect()}
    assert (got.n_tokens == got.doc_id.map(n)).all() and (got.padding == got.bucket_len - got.n_tokens).all() and (got.padding >= 0).all()
    long = got.n_tokens > budget
    assert (got.padding[long] == 0).all() and got.batch_id[long].is_unique
    ends = sorted(got.bucket_len[~long].unique())
    assert set(ends) <= set(n.values()) and len(ends) <= packing.BUCKETS
    assert all(t > max([e for e in ends if e < b], default=-1) for t, b in zip(got.n_tokens[~long], got.bucket_len[~long]))
    batches = got.groupby("batch_id").agg(n=("doc_id", "size"), length=("bucket_len", "first"), top=("place", "max"), places=("place", "nunique"))
    assert (batches.top == batches.n - 1).all() and (batches.places == batches.n).all()
    assert ((batches.n * batches.length <= budget) | (batches.n == 1)).all()
    full = (budget // batches.length.clip(lower=1)).clip(lower=1)
    assert (batches.assign(part=batches.n < full).groupby("length").part.sum() <= 1).all()


def test_padding_is_that_of_the_plain_program(spark):
    """The quadratic program over all exact lengths of a larger table."""
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = packing.pack(df, keep=("doc_id",)).select("n_tokens", "padding").toPandas()
    lengths, counts = np.unique(got.n_tokens[got.n_tokens <= packing.BUDGET], return_counts=True)
    rows = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    best = np.concatenate([[0.0], lengths * rows[1:]])
    for _ in range(1, packing.BUCKETS):
        cost = best[:, None] + np.concatenate([[0], lengths])[None, :] * (rows[None, :] - rows[:, None])
        cost[np.tril_indices(len(rows), -1)] = np.inf
        best = cost.min(axis=0)
    assert got.padding.sum() == best[-1] - (lengths * counts).sum()


def test_repeated_rows_are_dealt_to_slots(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLOT", 50)
    df = spark.createDataFrame([(None, "the same text")] * 500, "doc_id long, text string").repartition(4)
    got = packing.pack(df, budget=30).toPandas()
    assert len(got) == 500 and got.batch_id.nunique() == 50 and (got.groupby("batch_id").place.nunique() == 10).all()


def test_packing_odd_rows(odd, clashing):
    assert packing.pack(odd).count() == odd.count() and packing.pack(clashing).count() == odd.count()
    assert packing.pack(odd.limit(0)).count() == 0
