"""Exact top-k inner products by best-first search in M-trees.

With one more component that makes all data vectors equally long, the largest inner products are
the nearest neighbours in Euclidean distance, a metric. A bounded sample of rows makes the upper two
levels: routing objects, and under each the leaves near it, with distances to it and covering radii.
Rows go to the nearest leaf under their nearest routing object. The rows of a leaf are an M-tree of pages that store, for every entry, the distance to its parent's routing object and, for
inner entries, a covering radius. A query visits pages in the order of their least possible
distance and stops when none can hold a better result. The nearest tree comes first; what it finds
bounds the query's visits of all other trees. Bounds only skip what can't be in the result; scores
are exact integers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, cut

#: Least and most leaves of the root pages of a length: a bounded sample (rows of smallest id hash), about
#: one for each tree's worth of rows between the two, of at most VALUES numbers; every row is indexed.
PIVOTS = 16, 65536
#: Numbers, and at most rows, of a tree: a visit is a row that is moved, so trees are as large as a
#: task can well hold. Queries that meet one copy of a tree, entries of a page.
VALUES, TREE, BLOCK, PAGE = 1 << 22, 65536, 65536, 128
#: Bounds are loosened by this share of the lengths, far above the rounding of doubles.
SLACK = 1e-9


class Tree:
    """An M-tree over integer rows, made equally long by one more component, loaded in bulk from the top down."""

    def __init__(self, ints: np.ndarray, longest: float):
        self.ints, self.longest = ints.astype(np.float64), longest
        self.rows = _augmented(ints, longest)
        #: per page: routing objects or rows (indices and integers), their distances to the page's own
        #: routing object, covering radii (0 in leaves) and child pages (-1 in leaves)
        self.pages: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.root = self._load(np.arange(len(ints)), None)

    def _from(self, center: int, at: np.ndarray) -> np.ndarray:
        d = self.rows[at] - self.rows[center]
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _page(self, at: np.ndarray, own: np.ndarray, radii: np.ndarray, children: np.ndarray) -> int:
        self.pages.append((at, self.ints[at], own, radii, children))
        return len(self.pages) - 1

    def _load(self, at: np.ndarray, parent: int | None) -> int:
        if len(at) <= PAGE:
            own = np.zeros(len(at)) if parent is None else self._from(parent, at)
            return self._page(at, own, np.zeros(len(at)), np.full(len(at), -1))
        # routing objects spread over the page's rows; each row goes to the nearest one
        routing = at[np.linspace(0, len(at) - 1, min(PAGE, -(-len(at) // PAGE))).astype(int)]
        far = np.stack([self._from(r, at) for r in routing])
        near = far.argmin(axis=0)
        if len(np.unique(near)) == 1:  # equal rows: any even split will do
            near = np.arange(len(at)) % len(routing)
        used = np.unique(near)
        radii = np.array([far[g, near == g].max() for g in used])
        children = np.array([self._load(at[near == g], int(routing[g])) for g in used])
        own = np.zeros(len(used)) if parent is None else self._from(parent, routing[used])
        return self._page(routing[used], own, radii, children)

    def search(self, query: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, int]:
        """The k nearest rows within ``bound`` and those that may tie with them; distances made.

        The squared distance of a query and a row is longest + |q|^2 - 2 q.row, a difference of
        integers that doubles hold, so small distances lose no digits.
        """
        query = query.astype(np.float64)
        base = self.longest + float(query @ query)
        loose = SLACK * np.sqrt(base)
        near, rows = np.empty(0), np.empty(0, dtype=np.int64)
        queue, made = [(0.0, self.root, None)], 0
        while queue:
            least, page, to_parent = heapq.heappop(queue)
            if least > bound + loose:
                break
            at, ints, own, radii, children = self.pages[page]
            if to_parent is not None:  # |d(q, parent) - d(entry, parent)| - radius bounds d from below
                keep = np.abs(to_parent - own) - radii <= bound + loose
                if not keep.all():
                    at, ints, radii, children = at[keep], ints[keep], radii[keep], children[keep]
            d = np.sqrt(np.maximum(base - 2 * (ints @ query), 0))
            made += len(at)
            if len(children) and children[0] >= 0:
                low = np.maximum(0.0, d - radii - loose)
                for i in np.flatnonzero(low <= bound + loose):
                    heapq.heappush(queue, (float(low[i]), int(children[i]), float(d[i])))
                continue
            some = d <= bound + loose
            if some.any():
                near, rows = np.concatenate([near, d[some]]), np.concatenate([rows, at[some]])
                if len(near) >= k:
                    bound = min(bound, float(np.partition(near, k - 1)[k - 1]))
                    # all that may tie with the k-th are kept; the exact scores decide among them
                    kept = near <= bound + loose
                    near, rows = near[kept], rows[kept]
        return rows, made


def integers(vector: Column) -> Column:
    """Array of floor(1024 * x); null for vectors that are null or hold null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(finite, F.transform(vector, lambda x: F.floor(1024 * x.cast("double"))))


def _augmented(vectors: np.ndarray, longest: float) -> np.ndarray:
    v = vectors.astype(np.float64)
    rest = np.maximum(longest - (v * v).sum(axis=1), 0)
    return np.column_stack([v, np.sqrt(rest)])


def _stack(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_list()).astype(np.int64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose vec_id is divisible by ``every``, the best other rows.

    Score: inner product of the integer vectors, exact while it fits 63 bits; ties go to the smaller
    vec_id, null last. Vectors that are null or hold null or non-finite components take no part; empty
    ones have score 0 with each other. Vectors are compared with those of their own length only. Every
    row but the query's own is a candidate: repeated rows, rows with the query's vec_id and rows
    without one count each, and a repeated query row gives its results again.

    Of rows with equal vectors, which tie everywhere, only the k + 1 smallest vec_ids can be in a
    result, so a very common vector does not gather anywhere. A query goes to its nearest tree first,
    then to all others that can hold a better row than the k it has found. A ball of too many rows is several
    trees, and each (tree, block of its queries) is a group of bounded size. Vectors of all lengths
    are searched in one plan.
    """
    rows = vectors.select("vec_id", integers(F.col(vector)).alias("ints")).where("ints is not null")
    rows = cut(rows.withColumns({"dim": F.size("ints"), "norm": F.aggregate("ints", F.lit(0.0), lambda s, x: s + x.cast("double") * x)}))
    pages = _root_pages(rows)
    data = _in_trees(rows, pages, k)

    distinct = cut(rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id"), F.col("ints").alias("query")).agg(F.count("*").alias("times")))
    of, visits = ["query_id", "query"], _planner(pages, k)
    planned = lambda q, known, first: q.select(*of, F.explode(F.filter(visits("query", known), lambda v: v["first"] == first)).alias("v")).select(*of, "v.*")
    found = cut(_searched(planned(distinct, F.lit(float("inf")), True), data, k))
    # the k-th distance found, loosened by far more than rounding; without k rows nothing is bounded
    norm = F.aggregate("query", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    kth = found.groupBy(of).agg(F.count("*").alias("n"), F.min("score").alias("worst"), F.first("longest").alias("longest"))
    far = F.sqrt(F.greatest(F.lit(0.0), F.col("longest") + norm - 2 * F.col("worst").cast("double"))) + 1e-6 * F.sqrt(F.col("longest") + norm)
    bounded = distinct.join(broadcast_if_small(cut(kth)), of, "left").withColumn("known", F.when(F.col("n") >= k, far).otherwise(float("inf")))
    more = _searched(planned(bounded.select(*of, "known"), F.col("known"), False), data, k)
    best = Window.partitionBy(of).orderBy(F.desc("score"), "missing", "vec_id")
    ranked = found.unionByName(more).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    times = broadcast_if_small(distinct.select(*of, "times"))
    ranked = ranked.join(times, of).withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return ranked.select("query_id", "rank", F.when(~F.col("missing"), F.col("vec_id")).alias("vec_id"), "score")


def _tree_rows(dim: int) -> int:
    return min(TREE, max(PAGE, VALUES // max(1, dim)))


class Page:
    """The root page and the one below it, for vectors of one length: routing objects, and under each its leaves.

    Leaves are sampled rows, a part of which are the routing objects; a leaf keeps its distance to
    its routing object, the radius that covers its rows and the number of trees that hold them.
    """

    def __init__(self, leaves: np.ndarray, longest: float):
        self.longest, self.offset = longest, 0
        roots = leaves[: int(np.ceil(np.sqrt(len(leaves))))]
        parent = _distances(leaves, roots).argmin(axis=1)
        order = np.argsort(parent, kind="stable")
        self.roots, self.leaves, self.parent = roots, leaves[order], parent[order]
        self.own = np.linalg.norm(self.leaves - roots[self.parent], axis=1)
        self.starts = np.searchsorted(self.parent, np.arange(len(roots) + 1))
        self.radius, self.trees = np.full(len(leaves), -1.0), np.zeros(len(leaves), dtype=int)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest leaf of the nearest routing object, and its distance, for each row."""
        root = _distances(rows, self.roots[np.diff(self.starts) > 0]).argmin(axis=1)
        used = np.flatnonzero(np.diff(self.starts) > 0)
        leaf = np.zeros(len(rows), dtype=np.int64)
        for r in np.unique(root):
            mine, a, b = root == r, self.starts[used[r]], self.starts[used[r] + 1]
            leaf[mine] = a + _distances(rows[mine], self.leaves[a:b]).argmin(axis=1)
        return leaf, np.linalg.norm(rows - self.leaves[leaf], axis=1)

    def plan(self, ints: np.ndarray, known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query the leaves that may hold a row within ``known``, its bound and its first leaf."""
        q = ints.astype(np.float64)
        # queries aren't on the sphere of the data: their last component is 0
        flat = np.column_stack([q, np.zeros(len(q))])
        to_roots = _distances(flat, self.roots)
        bound = known.copy()
        some = self.roots if len(self.roots) > k else self.leaves
        if len(some) > k:  # these are data: the k+1 nearest (one may be the query) bound the k-th distance from above
            near = some[np.argpartition(_distances(flat, some), k, axis=1)[:, : k + 1]] - flat[:, None, :]
            bound = np.minimum(bound, np.linalg.norm(near, axis=2).max(axis=1))
        # distances come from a difference of squares, which loses digits when they are small
        within = bound + 1e-6 * np.sqrt(self.longest + (q * q).sum(axis=1))
        hit = np.zeros((len(q), len(self.leaves)), dtype=bool)
        closest, first = np.full(len(q), np.inf), np.zeros(len(q), dtype=np.int64)
        last = to_roots.argmin(axis=1)  # the first leaf is looked for under the nearest routing object
        for r, (a, b) in enumerate(zip(self.starts[:-1], self.starts[1:], strict=True)):
            filled = self.trees[a:b] > 0
            if not filled.any():
                continue
            # |d(q, parent) - d(leaf, parent)| - radius bounds the distance of a leaf's rows from below
            may = (np.abs(to_roots[:, r, None] - self.own[a:b]) - self.radius[a:b] <= within[:, None]) & filled
            rows = np.flatnonzero(may.any(axis=1) | (last == r) | (closest == np.inf))
            if not len(rows):
                continue
            d = np.where(filled, _distances(flat[rows], self.leaves[a:b]), np.inf)
            hit[rows, a:b] = may[rows] & (d - self.radius[a:b] <= within[rows, None])
            best, at = d.min(axis=1), a + d.argmin(axis=1)
            better = (best < closest[rows]) | ((last[rows] == r) & np.isfinite(best))
            closest[rows[better]] = np.where(last[rows[better]] == r, -np.inf, best[better])
            first[rows[better]] = at[better]
        hit[np.arange(len(q)), first] = True
        return hit, bound, first


def _by_length(ints: pd.Series) -> list[tuple[int, np.ndarray]]:
    sizes = ints.map(len).to_numpy()
    return [(int(d), np.flatnonzero(sizes == d)) for d in np.unique(sizes)]


def _root_pages(rows: DataFrame) -> dict[int, Page]:
    """The pages of every length of vectors, from one sample of all lengths.

    A row is in the sample by its hash, about twice as many as leaves are wanted; equal rows are one.
    """
    sizes = {r["dim"]: r for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()}
    few = {d: min(max(PIVOTS[0], r["n"] // _tree_rows(d)), PIVOTS[1], max(PIVOTS[0], VALUES // max(1, d))) for d, r in sizes.items()}
    share = {d: min(1.0, 2 * few[d] / r["n"] + 16 / r["n"]) for d, r in sizes.items()}

    @F.pandas_udf("double")
    def wanted(dim: pd.Series) -> pd.Series:
        return dim.map(share).astype(float)

    at = F.xxhash64("vec_id", "ints")
    drawn = rows.select("dim", "ints", at.alias("at")).where(F.pmod("at", F.lit(1 << 30)) / float(1 << 30) < wanted("dim"))
    sample = drawn.distinct().toPandas().sort_values("at")
    pages, offset = {}, 0
    for d in sorted(sizes):
        mine = sample[sample["dim"] == d]["ints"]
        leaves = _augmented(_stack(mine), sizes[d]["longest"]) if len(mine) else np.zeros((1, d + 1))
        _, once = np.unique(leaves, axis=0, return_index=True)
        page = pages[d] = Page(leaves[np.sort(once)][: few[d]], sizes[d]["longest"])
        page.offset, offset = offset, offset + len(page.leaves)
    return pages


def _ids(df: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return df["missing"].to_numpy(dtype=bool), df["vec_id"].to_numpy()


def _searched(visits: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """query_id, query, score, missing, vec_id, longest: the k best rows of each tree for each of its visits.

    visits: query_id, query, pivot, tree, bound; data: vec_id, missing, ints, pivot, tree, longest. A tree is
    copied once for each BLOCK of its own visits.
    """
    tree = ["pivot", "tree"]
    n = cut(visits.groupBy(tree).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    n = broadcast_if_small(n)
    visits = visits.join(n, tree).withColumn("block", F.pmod(F.hash("query_id", "query"), "blocks"))
    data = data.join(n, tree).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    data = data.select("vec_id", "missing", "ints", "longest", *(F.col(c).alias(f"in_{c}") for c in (*tree, "block")))

    def search(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            rows = rows.sort_values(["missing", "vec_id"]).reset_index(drop=True)
            ints, (missing, ids) = _stack(rows["ints"]), _ids(rows)
            longest = float(rows["longest"].iloc[0])
            index = Tree(ints, longest)
            for q, v, bound in zip(queries["query_id"], queries["query"], queries["bound"], strict=True):
                v = np.asarray(v, dtype=np.int64)
                # one more than k, as one of them may be the query's own row
                at, _ = index.search(v, bound, k + 1)
                at.sort()
                own = np.flatnonzero((ids[at] == q) & ~missing[at] & (ints[at] == v).all(axis=1))
                at = np.delete(at, own[:1])
                score = ints[at] @ v
                best = np.argsort(-score, kind="stable")[:k]
                out += [(q, v, int(score[b]), bool(missing[at[b]]), int(ids[at[b]]), longest) for b in best]
        return pd.DataFrame(out, columns=["query_id", "query", "score", "missing", "vec_id", "longest"])

    keys = [*tree, "block"]
    schema = "query_id long, query array<long>, score long, missing boolean, vec_id long, longest double"
    return visits.groupBy(keys).cogroup(data.groupBy([f"in_{c}" for c in keys])).applyInPandas(search, schema)


def _in_trees(rows: DataFrame, pages: dict[int, Page], k: int) -> DataFrame:
    """vec_id, missing, ints, pivot, tree, longest of the rows that can be in a result; fills radii and trees of the pages."""
    few = Window.partitionBy("ints").orderBy(F.col("vec_id").asc_nulls_last())
    data = rows.withColumn("copy", F.row_number().over(few)).where(F.col("copy") <= k + 1)

    @F.pandas_udf("pivot int, far double")
    def nearest(ints: pd.Series) -> pd.DataFrame:
        pivot, far = np.zeros(len(ints), np.int32), np.zeros(len(ints))
        for dim, at in _by_length(ints):
            page = pages[dim]
            leaf, far[at] = page.nearest(_augmented(_stack(ints.iloc[at]), page.longest))
            pivot[at] = page.offset + leaf
        return pd.DataFrame({"pivot": pivot, "far": far})

    missing = F.col("vec_id").isNull()
    data = data.select(F.coalesce("vec_id", F.lit(0)).alias("vec_id"), missing.alias("missing"), "copy", "ints", "dim", nearest("ints").alias("p"))
    data = cut(data.select("vec_id", "missing", "copy", "ints", "dim", "p.*"))
    for r in data.groupBy("dim", "pivot").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect():  # a row for each leaf
        page = pages[r["dim"]]
        leaf = r["pivot"] - page.offset
        page.radius[leaf], page.trees[leaf] = r["radius"], -(-r["n"] // _tree_rows(r["dim"]))
    trees = np.concatenate([p.trees for p in pages.values()]) if pages else np.zeros(0, int)
    split = {int(i): int(trees[i]) for i in np.flatnonzero(trees > 1)}
    lengths = {d: p.longest for d, p in pages.items()}

    @F.pandas_udf("shares int, longest double")
    def facts(pivot: pd.Series, dim: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"shares": [split.get(p, 1) for p in pivot], "longest": [lengths[d] for d in dim]})

    data = data.withColumn("f", facts("pivot", "dim"))
    return data.select("vec_id", "missing", "ints", "pivot", F.pmod(F.hash("vec_id", "copy"), F.col("f.shares")).alias("tree"), F.col("f.longest").alias("longest"))


def _planner(pages: dict[int, Page], k: int):
    visit = T.ArrayType(T.StructType([T.StructField("pivot", T.IntegerType()), T.StructField("tree", T.IntegerType()), T.StructField("bound", T.DoubleType()), T.StructField("first", T.BooleanType())]))

    @F.pandas_udf(visit)
    def visits(ints: pd.Series, known: pd.Series) -> pd.Series:
        """The trees that may hold a row within ``known``; the first is that of the nearest leaf."""
        out: list = [[] for _ in range(len(ints))]
        for dim, at in _by_length(ints):
            page = pages[dim]
            for some in np.array_split(at, -(-len(at) // 256)):
                hits, bounds, firsts = page.plan(_stack(ints.iloc[some]), known.iloc[some].to_numpy(dtype=np.float64), k)
                for i, hit, bound, first in zip(some, hits, bounds, firsts, strict=True):
                    out[i] = [(int(page.offset + leaf), t, float(bound), bool(leaf == first and t == 0)) for leaf in np.flatnonzero(hit) for t in range(page.trees[leaf])]
        return pd.Series(out)

    return visits


ORACLE = """
with ints as (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select q.rid, q.vec_id as query_id, d.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])), 0)::bigint as score
  from ints q join ints d on q.rid <> d.rid and len(q.v) = len(d.v) where q.vec_id % 100 = 0),
ranked as (select *, row_number() over (partition by rid order by score desc, vec_id nulls last)::int as rank from scores)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""
