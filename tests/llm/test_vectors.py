import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.llm import embedding_dedup, mtree

ODD = [
    (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [1.0, float("nan")]), (4, [1.0, float("inf")]), (5, [1.0, 2.0]), (6, [1.0, 2.0]),
    (7, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (8, []), (100, [2.0, 1.0]), (100, [2.0, 1.0]), (200, [-1.0, 0.5]), (300, None), (400, [0.0, 0.0]),
]


def brute(ids, vectors, cosine=0.9):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= cosine
    links = near.sum(axis=1) - 1
    root = np.arange(len(ids))
    while True:
        new = np.where(near, root[None, :], len(ids)).min(axis=1)
        if (new == root).all():
            break
        root = new
    return links, np.array([min(ids[root == r]) for r in root])


@pytest.mark.parametrize(("chunk", "shifted"), [(2048, 32), (16, 32), (40, 4)])
def test_links_and_components(spark, monkeypatch, chunk, shifted):
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    monkeypatch.setattr(embedding_dedup, "_SHIFTED", shifted)
    monkeypatch.setattr(embedding_dedup, "_SLAB", 7)
    r = np.random.default_rng(0)
    centres = r.standard_normal((20, 16))
    v = [centres[i % 20] + r.standard_normal(16) * (0.05 if i % 3 else 0.3) for i in range(300)]
    v += [centres[0]] * 40 + list(r.standard_normal((100, 16)))
    v = np.array(v, dtype=np.float32).astype(float)
    ids = r.permutation(1000)[: len(v)]
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<float>")
    got = embedding_dedup.near_duplicates(df).toPandas().set_index("vec_id").loc[ids]
    links, comps = brute(ids, v)
    assert (got.n_links.to_numpy() <= links).all()
    assert got.n_links.sum() >= 0.9 * links.sum()
    assert (got.component_id.to_numpy() == comps).mean() > 0.95
    assert (got.kept == (got.index == got.component_id)).all()


def test_odd_vectors(spark):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<float>")
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(df).collect()), key=lambda t: (t[0] is None, t))
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 4, 7, 8, 200, 300, 400)]
    pair = [(100, 1, 100, True)] * 2  # [1, 2] and [2, 1] have cosine 0.8
    assert got == sorted([*alone, *pair, (5, 2, 5, True), (6, 2, 5, False)]) + [(None, 2, 5, False)]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    t = df.toPandas()
    links, comps = brute(t.vec_id.to_numpy(), np.stack(t.embedding).astype(float))
    got = embedding_dedup.near_duplicates(df).toPandas().set_index("vec_id").loc[t.vec_id]
    assert got.n_links.sum() >= 0.9 * links.sum() and (got.n_links.to_numpy() <= links).all()


def test_sketches_and_vectors_decide_as_plain_cosines(spark):
    """All in one bucket: every link is found and no other is made, also of pairs at the cosine itself."""
    r = np.random.default_rng(2)
    base = r.standard_normal((6, 24))
    v = np.repeat(base, 40, axis=0) + r.standard_normal((240, 24)) * 0.34  # cosines of a group scatter about 0.9
    v = np.concatenate([v, [[3.0, 4.0] + [0] * 22, [4.0, 3.0] + [0] * 22, [1.0] + [0] * 23, [0.9, np.sqrt(0.19)] + [0] * 22]]).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    links, comps = brute(np.arange(len(v)), v)
    got = embedding_dedup.near_duplicates(df, recall=0.999999).toPandas().set_index("vec_id").loc[range(len(v))]
    assert (got.n_links.to_numpy() == links).all() and (got.component_id.to_numpy() == comps).all()


def test_sketch_bounds_hold():
    r = np.random.default_rng(0)
    v = np.concatenate([r.standard_normal((300, 16)), r.standard_normal((50, 16)) * 1e-30, np.eye(16), r.standard_normal((50, 16)) * 1e30]).astype(np.float32)
    q, step, left = embedding_dedup._opened(embedding_dedup.pa.array(embedding_dedup._sketch(v)))
    unit = embedding_dedup._units(v.astype(float))
    assert (np.linalg.norm(unit - q * step[:, None], axis=1) <= left).all() and left.max() < 0.03


def test_recall_near_the_cosine(spark):
    """Pairs planted at cosines of 0.90 to 0.92 among the vectors of the largest table."""
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding").toPandas()
    v = np.stack(t.embedding).astype(float)
    r = np.random.default_rng(4)
    own = v[r.permutation(len(v))[:400]]
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    off = r.standard_normal(own.shape)
    off -= (off * own).sum(axis=1, keepdims=True) * own
    c = r.uniform(0.9005, 0.92, (400, 1))
    planted = c * own + np.sqrt(1 - c * c) * off / np.linalg.norm(off, axis=1, keepdims=True)
    everything = np.concatenate([v, own, planted]).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(everything)], "vec_id long, embedding array<float>")
    links, comps = brute(np.arange(len(everything)), everything)
    got = embedding_dedup.near_duplicates(df).toPandas().set_index("vec_id").loc[range(len(everything))]
    assert (got.n_links.to_numpy() <= links).all()
    n = len(v) + 400
    met = got.component_id.to_numpy()[n - 400 : n] == got.component_id.to_numpy()[n:]
    print("recall of planted pairs", met.mean(), "of all links", got.n_links.sum() / links.sum())
    assert met.mean() >= 0.93 and got.n_links.sum() >= 0.95 * links.sum()


def test_tree_is_exact():
    r = np.random.default_rng(0)
    for n in (1, 7, 40, 700):
        for kind in range(3):
            v = [r.integers(-1024, 1024, (n, 8)), r.integers(-3, 3, (n, 4)), np.ones((n, 4), int)][kind]
            ids = np.sort(r.permutation(10 * n)[:n])
            tree = mtree.Tree(v, float((v * v).sum(axis=1).max()))
            for q in range(0, n, max(1, n // 10)):
                at, _ = tree.search(v[q], np.inf, 10)
                got = sorted((-int(v[a] @ v[q]), ids[a]) for a in at)[:10]
                assert got == sorted((-int(v[a] @ v[q]), ids[a]) for a in range(n))[:10]


def test_tree_skips_pages():
    r = np.random.default_rng(0)
    v = (r.integers(-1000, 1000, (40, 4))[r.integers(0, 40, 4000)] + r.integers(-5, 5, (4000, 4))).astype(np.int64)
    v = v * 1000 // np.maximum(1, np.linalg.norm(v, axis=1).astype(int))[:, None]
    tree = mtree.Tree(v, float((v * v).sum(axis=1).max()))
    made = [tree.search(v[q], np.inf, 10)[1] for q in range(0, 4000, 400)]
    assert np.mean(made) < 2000


def visited(spark, v, monkeypatch, tree):
    """Visits planned with the k-th distance known, queries, trees."""
    monkeypatch.setattr(mtree, "TREE", tree)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, ints array<long>")
    rows = rows.withColumns({"dim": F.size("ints"), "norm": F.aggregate("ints", F.lit(0.0), lambda s, x: s + x.cast("double") * x)})
    pages = mtree._root_pages(rows)
    trees = mtree._in_trees(rows, pages, 10).select("pivot", "tree").distinct().count()
    longest = float((v * v).sum(axis=1).max())
    q = v[::50]
    kth = np.sort(q @ v.T, axis=1)[:, -11]
    known = np.sqrt(np.maximum(0, longest + (q * q).sum(axis=1) - 2 * kth))
    asked = spark.createDataFrame([(x.tolist(), float(b)) for x, b in zip(q, known)], "query array<long>, known double")
    plans = asked.select(mtree._planner(pages, 10)("query", "known").alias("v")).collect()
    assert all(sum(t["first"] for t in r["v"]) == 1 for r in plans)
    return sum(len(r["v"]) for r in plans), len(q), trees


def test_clustered_vectors_are_visited_in_few_trees(spark, monkeypatch):
    r = np.random.default_rng(3)
    centers = r.standard_normal((30, 16))
    centers *= 1000 / np.linalg.norm(centers, axis=1, keepdims=True)
    v = (centers[r.integers(0, 30, 3000)] + r.standard_normal((3000, 16)) * 4).astype(np.int64)
    visits, queries, trees = visited(spark, v, monkeypatch, 60)
    assert trees >= 30 and visits < 0.25 * queries * trees


def test_many_lengths_are_one_plan(spark):
    """Sixty lengths, some of a single vector, in as many jobs as one length takes."""
    r = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in r.standard_normal(i % 60)]) for i in range(0, 900)] + [(1000, [0.5] * 75)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert top(df) == plain_top(rows)


def test_embedding_sql_on_planted_clusters(spark):
    """op4 and its SQL on tables that do hold links: clusters, copies, chains, odd vectors."""
    import duckdb

    from millrace.llm import queries

    r = np.random.default_rng(6)
    v = np.repeat(r.standard_normal((40, 32)), 5, axis=0) + r.standard_normal((200, 32)) * 0.1
    v = np.concatenate([v, v[:20], r.standard_normal((300, 32))]).astype(np.float32)
    rows = pd.DataFrame({"vec_id": np.arange(len(v)), "embedding": [x.tolist() for x in v]})
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows).select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")), recall=0.999999).toPandas()
    con = duckdb.connect()
    con.register("raw", rows)
    con.execute("create view embeddings as select vec_id, embedding::float[] as embedding from raw")
    want = con.execute(queries.ORACLE_SQL["op4_embedding_dedup"]).df()
    columns = sorted(want.columns)
    assert want.n_links.sum() > 500
    assert sorted(map(tuple, got[columns].to_numpy().tolist())) == sorted(map(tuple, want[columns].to_numpy().tolist()))


def plain_top(rows, k=10):
    """Every row but the query's own is a candidate, whatever its vec_id."""
    ints = lambda v: tuple(int(np.floor(1024 * np.float64(np.float32(x)))) for x in v)
    ok = [(i, ints(v)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, a) in enumerate(ok):
        if q is not None and q % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i is None, i or 0) for n, (i, b) in enumerate(ok) if n != at and len(a) == len(b))[:k]
            out += [(q, n, None if none else i, -s) for n, (s, none, i) in enumerate(best, 1)]
    return sorted(out, key=lambda t: tuple((x is None, x) for x in t))


def top(df):
    return sorted(map(tuple, mtree.top_k(df).collect()), key=lambda t: tuple((x is None, x) for x in t))


@pytest.mark.parametrize("tree", [4096, 8])
def test_top_k(spark, monkeypatch, tree):
    monkeypatch.setattr(mtree, "TREE", tree)
    monkeypatch.setattr(mtree, "BLOCK", 4 if tree == 8 else 1024)
    r = np.random.default_rng(1)
    v = r.standard_normal((350, 6)).astype(np.float32)
    v[50:120] = v[50]  # a common vector: ties by id
    rows = [(int(i), [float(x) for x in v[n]]) for n, i in enumerate(r.permutation(1500)[:349])] + [(100 * j, [float(x) for x in v[50]]) for j in (20, 21)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert top(df) == plain_top(rows)


def test_top_k_odd(spark):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<float>")
    assert top(df) == plain_top(ODD)
    assert mtree.top_k(df.limit(0)).count() == 0
    clashing = df.select("*", *(F.lit("x").alias(c) for c in "ints dim norm copy pivot far tree block bound first query query_id missing score rank times key n codes vector".split()))
    assert top(clashing) == plain_top(ODD)
    assert embedding_dedup.near_duplicates(clashing).count() == len(ODD)


def test_top_k_of_repeated_rows(spark):
    """Repeated rows, queries too, rows without an id, zero queries that tie with all, empty vectors."""
    rows = [(1, [1.0, 2.0])] * 3 + [(100, [0.5, 1.0])] * 2 + [(100, [2.0, 2.0]), (200, [0.0, 0.0]), (None, [3.0, 1.0]), (None, [3.0, 1.0])]
    rows += [(i, [float(i % 7), 1.0]) for i in range(2, 40)] + [(300, []), (301, []), (300, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert top(df) == plain_top(rows)
    small = [(100, [1.0])] + [(5, [2.0])] * 3 + [(6, [1.0])]
    assert top(spark.createDataFrame(small, "vec_id long, embedding array<float>")) == [(100, 1, 5, 1024 * 2048), (100, 2, 5, 1024 * 2048), (100, 3, 5, 1024 * 2048), (100, 4, 6, 1024 * 1024)]
