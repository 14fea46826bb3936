"""Prefix trie of rebuilt conversations, family by family.

Conversations of one base id are a family of a few dozen at most. A cogroup of its members with its base
rebuilds them and builds the family's small trie; what is shuffled after that are the families' nodes,
summed by the digest of their path. The sums go back to the families, each of which then knows the
nodes it owns (those whose smallest member it has) and adds up their subtrees along its own trie; an
owned node counts in one family only, so the families' sums add up to the corpus's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, word_count

#: Conversations of a base id: those from it up to the next multiple. Turns that may come from the base: SHARED - 1.
FAMILY, SHARED = 20, 4
#: A conversation of more turns is a family of its own, summed in parts of so many turns.
LONG = 20_000
#: Ends of a node that are in one family only are hashed there, others in pieces of this range of ids.
PIECE_BITS = 10
ROOT = bytes(16)
EMPTY = hashlib.sha256().hexdigest()

NODE = "home long, node int, parent int, key binary, depth long, n long, least long, words long, inner boolean, ends array<long>"
NODE_SCHEMA = pa.schema([
    ("home", pa.int64()), ("node", pa.int32()), ("parent", pa.int32()), ("key", pa.binary()), ("depth", pa.int64()), ("n", pa.int64()),
    ("least", pa.int64()), ("words", pa.int64()), ("inner", pa.bool_()), ("ends", pa.list_(pa.int64())),
])
SUMS = "key binary, whole boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _mixed(marks: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Four 32-bit numbers for each turn (16 bytes) at its depth; the key of a path is their sums."""
    x = marks.view("<u8").reshape(-1, 2) + depth.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    # the second half depends on the first, so the halves of equal turns differ by depth in both
    x = np.column_stack([x[:, 0] ^ (x[:, 1] << np.uint64(1)), x[:, 1]])
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.ascontiguousarray(x ^ (x >> np.uint64(31))).view("<u4").astype(np.int64)


def _marks(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, 2)


def _in_order(turns: pa.Table) -> pa.Table:
    keys = [("conv_id", "ascending"), ("turn", "ascending"), ("mark", "ascending")]
    return turns.take(pc.sort_indices(turns, sort_keys=keys, null_placement="at_start"))


def _family(key: tuple, members: pa.Table, base: pa.Table) -> pa.Table:
    """The nodes of a family's trie; ``base`` holds the base's turns, of a long one only the first (not own)."""
    base = _in_order(base)
    heads, head_words = _marks(base.column("mark"))[: SHARED - 1], base.column("words").to_numpy()[: SHARED - 1]
    turns = _in_order(pa.concat_tables([base.filter(base.column("own")), members.select(base.column_names)]))
    conv, h = turns.column("conv_id").to_numpy(), turns.column("h").to_numpy()
    if not len(conv):
        return NODE_SCHEMA.empty_table()
    ids, first, of = np.unique(conv, return_index=True, return_inverse=True)
    shared = np.minimum(h[first], len(heads))
    place = np.arange(len(conv)) - first[of]
    keep = place >= h
    # own turns after the first h, and before them what the base has
    borrowed = [np.flatnonzero(shared > d) for d in range(len(heads))]
    conv_at = np.concatenate([of[keep], *borrowed])
    depth = np.concatenate([(shared[of] + place - h + 1)[keep], *(np.full(len(b), d + 1) for d, b in enumerate(borrowed))])
    marks = np.concatenate([_marks(turns.column("mark"))[keep], *(np.repeat(heads[d : d + 1], len(b), axis=0) for d, b in enumerate(borrowed))])
    words = np.concatenate([turns.column("words").to_numpy()[keep], *(np.full(len(b), head_words[d]) for d, b in enumerate(borrowed))])
    order = np.lexsort((depth, conv_at))
    conv_at, depth, words = conv_at[order], depth[order], words[order]
    sums = np.cumsum(_mixed(np.ascontiguousarray(marks[order]), depth), axis=0)
    starts = np.flatnonzero(depth == 1)
    before = np.concatenate([np.zeros((1, 4), dtype=np.int64), sums])[starts]
    sums = (sums - np.repeat(before, np.diff(np.append(starts, len(depth))), axis=0)) & 0xFFFFFFFF
    keys, at, node = np.unique(sums.astype(">u4").view("<u8").reshape(-1, 2), axis=0, return_index=True, return_inverse=True)
    node = node.reshape(-1)
    root = len(keys)
    above = np.where(depth == 1, root, np.append(root, node[:-1]))
    parent = above[at]
    last = np.full(len(ids), root)
    last[conv_at] = node  # rows are in order of depth, so the deepest stays
    ends = [[] for _ in range(root + 1)]
    for c, n in zip(ids.tolist(), last.tolist(), strict=True):
        ends[n].append(c)
    inner = np.bincount(parent, minlength=root + 1) > 0
    raw = keys.tobytes()
    return pa.table({
        "home": np.full(root + 1, key[0].as_py()), "node": np.arange(root + 1, dtype=np.int32), "parent": pa.array([*parent.tolist(), None], pa.int32()),
        "key": pa.array([*(raw[i : i + 16] for i in range(0, len(raw), 16)), ROOT], pa.binary()), "depth": np.append(depth[at], 0),
        "n": np.append(np.bincount(node, minlength=root), len(ids)), "least": np.append(ids[conv_at[at]], ids[0]), "words": np.append(words[at], 0),
        "inner": inner, "ends": pa.array(ends, pa.list_(pa.int64())),
    })


def _digest(ends: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest()


def _subtrees(nodes: pa.Table) -> pa.Table:
    """SUMS of a family's nodes, what it owns of every subtree; nodes carry the corpus's conv_id, n_convs, some, n_ends."""
    nodes = nodes.sort_by("node")
    column = lambda c: nodes.column(c).to_numpy()
    root = len(nodes) - 1
    parent, depth = pc.fill_null(nodes.column("parent"), root).to_numpy(), column("depth")
    conv, n_convs = column("conv_id"), column("n_convs")
    own = column("least") == conv
    children = np.bincount(parent[:root][own[:root]], minlength=root + 1)
    sums = np.column_stack([own & ~column("some"), np.where(own, (n_convs - 1) * column("words"), 0)]).astype(np.int64)
    by_depth = np.argsort(-depth[:root], kind="stable")
    for level in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1):
        np.add.at(sums, parent[level], sums[level])
    shas = []
    for ends, total, mine in zip(nodes.column("ends").to_pylist(), column("n_ends").tolist(), own.tolist(), strict=True):
        shas.append(_digest(ends) if total and len(ends) == total else EMPTY if mine and not total else None)
    above = conv[parent].tolist()
    return pa.table({
        "key": nodes.column("key"), "whole": n_convs == column("n"), "conv_id": conv, "depth": depth,
        "parent_conv_id": pa.array([*above[:-1], None], pa.int64()), "n_convs": n_convs, "n_children": children,
        "n_leaves": sums[:, 0], "saved_tokens": sums[:, 1], "ends_sha256": pa.array(shas, pa.string()),
    })


def _along(rows: DataFrame, order: Column, sums: dict[str, Column], falling: bool = False) -> DataFrame:
    """rows (conv_id, part, ...) with running sums over each conversation, part by part; parts go up with ``order``."""
    step = F.desc if falling else F.asc
    of_part = rows.groupBy("conv_id", "part").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    before = Window.partitionBy("conv_id").orderBy(step("part")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = of_part.select("conv_id", "part", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums))
    within = Window.partitionBy("conv_id", "part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    with_offsets = rows.join(offsets, ["conv_id", "part"])
    return with_offsets.withColumns({n: F.sum(c).over(within) + F.col(f"_{n}") for n, c in sums.items()}).drop(*(f"_{n}" for n in sums))


def _numbered(turns: DataFrame, n: int) -> DataFrame:
    """Turns of long conversations with ``place`` from 0, cut into ranges so that none is in one task."""
    ordered = ["conv_id", F.col("turn").asc_nulls_first(), "mark", "tie"]
    ranged = turns.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(-(-n // LONG) + 1, *ordered)
    ranged = cut(ranged.withColumn("part", F.spark_partition_id()))
    order = F.struct(F.col("turn").isNotNull(), "turn", "mark", "tie").asc()
    return _along(ranged, order, {"place": F.lit(1)}).withColumn("place", F.col("place") - 1).drop("part", "tie")


def _lanes(mark: pd.Series, depth: pd.Series) -> pd.Series:
    marks = np.frombuffer(b"".join(map(bytes, mark)), dtype="<u8").reshape(-1, 2)
    return pd.Series(list(_mixed(marks, depth.to_numpy())))


def _long_nodes(turns: DataFrame, heads: DataFrame) -> DataFrame:
    """NODE rows of long conversations, each a trie of one path: numbered ``turns`` and the first turns of bases."""
    borrowed = turns.select("conv_id", "base", "h").distinct().join(heads.select(F.col("conv_id").alias("base"), "place", "mark", "words"), "base").where("place < h")
    lent = borrowed.groupBy("conv_id").agg(F.count("*").alias("lent"))
    own = turns.where("place >= h").join(lent, "conv_id", "left").withColumn("depth", F.coalesce("lent", F.lit(0)) + F.col("place") - F.col("h") + 1)
    path = own.select("conv_id", "depth", "mark", "words").unionByName(borrowed.select("conv_id", (F.col("place") + 1).cast("long").alias("depth"), "mark", "words"))
    path = path.withColumns({"part": F.floor(F.col("depth") / LONG), "lanes": F.pandas_udf(_lanes, "array<long>")("mark", "depth")})
    path = _along(path, F.asc("depth"), {f"k{i}": F.col("lanes")[i] for i in range(4)})
    four = [F.unhex(F.lpad(F.hex(F.pmod(f"k{i}", F.lit(1 << 32))), 8, "0")) for i in range(4)]
    length = turns.groupBy("conv_id").agg(F.max("place").alias("last"), F.max("h").alias("h")).join(lent, "conv_id", "left")
    length = length.select("conv_id", (F.coalesce("lent", F.lit(0)) + F.greatest(F.col("last") + 1 - F.col("h"), F.lit(0))).alias("length"))
    root = length.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("key"), F.lit(0).cast("long").alias("words"))
    path = path.select("conv_id", "depth", F.concat(*four).alias("key"), "words").unionByName(root).join(F.broadcast(length), "conv_id")
    none = F.lit(None).cast("int")
    ends = F.when(F.col("depth") == F.col("length"), F.array("conv_id")).otherwise(F.array().cast("array<long>"))
    return path.select(
        F.col("conv_id").alias("home"), none.alias("node"), none.alias("parent"), "key", "depth", F.lit(1).cast("long").alias("n"),
        F.col("conv_id").alias("least"), "words", (F.col("depth") < F.col("length")).alias("inner"), ends.alias("ends"),
    )


def _long_sums(nodes: DataFrame) -> DataFrame:
    """SUMS of long conversations' nodes: running sums from the deepest turn up."""
    own = F.col("least") == F.col("conv_id")
    nodes = cut(nodes.select(F.col("home").alias("id"), F.col("conv_id").alias("smallest"), "depth", "key", "n", "n_convs", "n_ends", "ends", "least", (own & ~F.col("some")).cast("long").alias("leaf"), F.when(own, (F.col("n_convs") - 1) * F.col("words")).otherwise(0).alias("saved"), own.alias("own")))
    parts = nodes.withColumnRenamed("id", "conv_id").withColumn("part", F.floor(F.col("depth") / LONG))
    summed = _along(parts, F.desc("depth"), {"n_leaves": F.col("leaf"), "saved_tokens": F.col("saved")}, falling=True)
    # the turn before and the turn after, by equality of depths
    before = nodes.select(F.col("id").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("smallest").alias("parent_conv_id"))
    after = nodes.where("depth > 0").select(F.col("id").alias("conv_id"), (F.col("depth") - 1).alias("depth"), F.col("own").cast("long").alias("child"))
    rows = summed.join(before, ["conv_id", "depth"], "left").join(after, ["conv_id", "depth"], "left")
    sha = F.when((F.col("n_ends") > 0) & (F.size("ends") == F.col("n_ends")), F.sha2(F.col("ends")[0].cast("string"), 256)).when(F.col("own") & (F.col("n_ends") == 0), EMPTY)
    return rows.select(
        "key", (F.col("n") == F.col("n_convs")).alias("whole"), F.col("smallest").alias("conv_id"), "depth", "parent_conv_id", "n_convs",
        F.coalesce("child", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", sha.alias("ends_sha256"),
    )


def _spread_ends(nodes: DataFrame) -> DataFrame:
    """key, sha of the nodes whose ends are in several families: texts of ranges of ids, hashed one after the other.

    A digest of one string is made in one task; it reads the pieces as a stream and holds none of them.
    """
    ends = nodes.where((F.size("ends") > 0) & (F.size("ends") < F.col("n_ends"))).select("key", F.explode("ends").alias("id"))
    pieces = ends.groupBy("key", F.shiftright("id", PIECE_BITS).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string")), ",").alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = sha = None
        for batch in batches:
            done = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    if sha is not None:
                        done.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["key", "sha"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([sha.hexdigest()])], names=["key", "sha"])

    return pieces.repartition("key").sortWithinPartitions("key", "piece").select("key", "text").mapInArrow(hashed, "key binary, sha string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    Turns are ordered by turn, null first, ties by the digest of role and text; null roles and texts are
    empty. Conversation c becomes the first h turns of conversation c - c % 20 (h = crc32 of the decimal
    id % 4; fewer if it has fewer) and its own turns after its first h. Nodes are the distinct sequences
    of first turns; the root is there if there is any conversation, and a conversation without turns ends
    there. Rows without conv_id belong to no conversation and are left out; repeated rows are turns of
    their own; very long texts are read for their digest and words only; other columns are not looked
    at; an empty table gives an empty one.

    Paths are told apart by 128-bit digests. A conversation of more than LONG turns is a family of its
    own: its turns are numbered, summed and hashed in parts, by windows over parts and their offsets.
    """
    spark, c = conversations.sparkSession, F.col("conv_id")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mark = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    base = c - c % FAMILY
    turns = conversations.where("conv_id is not null").select(
        c.cast("long").alias("conv_id"), base.cast("long").alias("base"), (F.crc32(c.cast("string")) % SHARED).cast("long").alias("h"),
        F.col("turn").cast("long").alias("turn"), mark.alias("mark"), word_count("text").alias("words"),
    )
    turns = cut(turns)
    long = cut(turns.groupBy("conv_id").agg(F.count("*").alias("turns")).where(F.col("turns") > LONG))
    n_long = long.agg(F.coalesce(F.sum("turns"), F.lit(0))).first()[0]
    columns = ["base", "conv_id", "turn", "mark", "words", "h"]
    usual, heads, long_turns = turns, None, None
    if n_long:
        usual = turns.join(long, "conv_id", "left_anti")
        long_turns = _numbered(turns.join(long, "conv_id", "left_semi"), n_long)
        long_turns = cut(long_turns)
        first = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "mark")
        bases = long_turns.select(F.col("base").alias("conv_id")).distinct()
        short_heads = usual.join(bases, "conv_id", "left_semi").withColumn("place", (F.row_number().over(first) - 1).cast("long"))
        heads = short_heads.select(*long_turns.columns).unionByName(long_turns).where(F.col("place") < SHARED - 1).where("base = conv_id")
    bases = usual.where("base = conv_id").select(*columns, F.lit(True).alias("own"))
    if n_long:
        of_long = heads.join(long, "conv_id", "left_semi").select(*columns, F.lit(False).alias("own"))
        bases = bases.unionByName(of_long)
    bases = bases.toDF(*(f"b_{c}" for c in bases.columns)).toDF(*bases.columns)  # names of its own beside members
    members = usual.where("base <> conv_id").select(*columns, F.lit(True).alias("own"))
    nodes = cut(members.groupBy("base").cogroup(bases.groupBy("base")).applyInArrow(_family, NODE))
    if n_long:
        long_nodes = cut(_long_nodes(long_turns, heads))
        nodes = nodes.unionByName(long_nodes)
    facts = nodes.groupBy("key").agg(F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), F.max("inner").alias("some"), F.sum(F.size("ends")).alias("n_ends"))
    known = nodes.join(facts, "key")
    if n_long:
        known = cut(known)
    sums = known.where("node is not null").groupBy("home").applyInArrow(_subtrees, SUMS)
    if n_long:
        sums = sums.unionByName(_long_sums(known.where("node is null")))
    sums = cut(sums)
    of_node = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    one = sums.where("whole").select(*of_node, "ends_sha256")
    several = sums.where("not whole").groupBy("key").agg(
        F.max("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_conv_id").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"),
        *(F.sum(x).cast("long").alias(x) for x in ("n_children", "n_leaves", "saved_tokens")), F.max("ends_sha256").alias("ends_sha256"),
    )
    several = several.join(_spread_ends(known), "key", "left").select(*of_node, F.coalesce("ends_sha256", "sha").alias("ends_sha256"))
    return one.unionByName(several)


ORACLE = """
with recursive named as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
ids as (select distinct conv_id, conv_id - conv_id % 20 as base, conv_id::varchar as s from named),
hashed as (select conv_id, base, xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, 8 * len(s)), lambda k: (k % 8) * 1000 + ascii(substr(s, (k // 8 + 1)::int, 1)))),
    lambda c, k: xor((case when k // 1000 = 0 then xor(c, k % 1000) else c end) >> 1, case when (case when k // 1000 = 0 then xor(c, k % 1000) else c end) % 2 = 1 then 3988292384::bigint else 0::bigint end))) % 4 as h from ids),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, md5(length(role)::varchar || ':' || role || text)) as i from named),
rebuilt as (select conv_id, row_number() over (partition by conv_id order by own, i) as depth, role, text from (
  select i.conv_id, 0 as own, p.i, p.role, p.text from hashed i join placed p on p.conv_id = i.base and p.i <= i.h
  union all select i.conv_id, 1, p.i, p.role, p.text from hashed i join placed p on p.conv_id = i.conv_id and p.i > i.h)),
walk as (
  select conv_id, 0::bigint as depth, '' as path, null::varchar as above, 0::bigint as words from ids
  union all select w.conv_id, r.depth, md5(w.path || length(r.role)::varchar || ':' || r.role || r.text), w.path, len(regexp_extract_all(r.text, '[^\\x20\\x09-\\x0D]+'))
  from walk w join rebuilt r on r.conv_id = w.conv_id and r.depth = w.depth + 1),
length as (select conv_id, max(depth) as length from walk group by conv_id),
nodes as (select path, min(above) as above, min(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, min(words) as words,
  sha256(coalesce(string_agg(case when depth = length then conv_id::varchar end, ',' order by conv_id), '')) as ends_sha256 from walk join length using (conv_id) group by path),
parents as (select above as path, count(*) as n from nodes where above is not null group by above),
sums as (select w.path, sum(case when p.n is null then 1 else 0 end)::bigint as n_leaves, sum((n.n_convs - 1) * n.words)::bigint as saved_tokens
  from nodes n join walk w on w.conv_id = n.conv_id and w.depth <= n.depth left join parents p on p.path = n.path group by w.path)
select n.conv_id, n.depth, u.conv_id as parent_conv_id, n.n_convs, coalesce(p.n, 0) as n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
from nodes n join sums s on s.path = n.path left join parents p on p.path = n.path left join nodes u on u.path = n.above
"""
