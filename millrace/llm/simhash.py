"""Near duplicates by SimHash fingerprints, found with covering bit masks.

``fingerprints`` makes a 64-bit fingerprint of every whole text. ``covering_masks`` gives
2**(r+1) - 1 masks so built that any two fingerprints that differ in r bits or fewer agree on all
bits of at least one mask: no pair within the radius is lost, whatever the data. ``components``
links fingerprints within the radius through those masks, ``near_duplicates`` adds documents.

``similar_groups`` adds a Jaccard similarity: texts meet where the fingerprints of whole texts agree
on a covering mask, and, because less similar texts differ in more bits, where fingerprints of min-wise
samples fall together, with a probability that rises with the similarity. Pairs that meet are
checked against both whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, cut, raw, stored, utf8
from .components import connected_components

BITS = 64
#: A bucket with more distinct fingerprints is linked through shared neighbours instead of pairs.
PAIRED_BUCKET = 16
_BLOCK = 1 << 16


def shingles(text: str | bytes | None, words: int) -> Iterator[bytes]:
    """The word shingles of a text, A-Z lower-cased; fewer words give one shingle, none give none."""
    # on bytes, lower() changes A-Z only and split() splits at \x20 and \x09-\x0D only
    w = raw(text).lower().split()
    if 0 < len(w) < words:
        return iter([b" ".join(w)])
    return map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))


def hashes(text: str | bytes | None, words: int) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(s, 42) for s in shingles(text, words)), dtype="<u8")


def majority(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; without hashes the result is 0."""
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), _BLOCK):
        part = np.ascontiguousarray(h[i : i + _BLOCK]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, words: int = 3) -> Column:
    """SimHash of a whole text as a signed long; null and blank texts give 0."""

    @F.arrow_udf(T.LongType())
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array([majority(hashes(t, words)) for t in utf8(texts)], pa.int64())

    return simhash(text)


def covering_masks(radius: int) -> list[int]:
    """Masks, as signed longs, of which every two 64-bit words within the radius share one value.

    Bit i has a nonzero vector of radius + 1 bits, dealt in turn; the mask of a nonzero v keeps the
    bits whose vector has an odd product with v. The vectors of the (at most radius) bits in which
    two words differ don't span the space, so some v is orthogonal to all: its mask keeps none.
    """
    top = 1 << (radius + 1)
    vector = [1 + i % (top - 1) for i in range(BITS)]
    masks = (sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() % 2) for v in range(1, top))
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (a, b), enough to connect all pairs within the radius.

    Buckets of up to PAIRED_BUCKET fingerprints are compared pair by pair. Those of larger buckets
    are linked through the words one bit away: two fingerprints differ in 2 bits or fewer exactly if
    such a word (or one of the two) is common to both, so 65 rows each replace the pairs, whatever
    the size of the bucket, and nothing is lost. This needs radius 2.
    """
    if radius != 2:
        raise ValueError("links() joins large buckets through words one bit away, which needs radius 2")
    masks = F.array(*(F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(covering_masks(radius))))
    keys = nodes.select("fp", F.inline(masks))
    # sizes are computed apart from the join with them, so that Spark may split a bucket of very many rows
    sizes = cut(keys.groupBy("table", "part").agg(F.count("*").alias("n")).where("n > 1"))
    shared = cut(keys.join(broadcast_if_small(sizes), ["table", "part"]))
    small = shared.where(F.col("n") <= PAIRED_BUCKET)
    pairs = (
        small.select("table", "part", F.col("fp").alias("a"))
        .join(small.select("table", "part", F.col("fp").alias("b")), ["table", "part"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
        .select("a", "b")
    )
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < BITS - 1 else -(1 << i))) for i in range(BITS)))
    near = shared.where(F.col("n") > PAIRED_BUCKET).select("fp").distinct().select("fp", F.explode(flips).alias("word"))
    first = near.groupBy("word").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    hubs = near.join(first, "word").where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b")
    return pairs.union(hubs).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id linked, itself included.

    One row per row of docs; of its columns only doc_id and text are read. Null, empty and blank
    texts have fingerprint 0 and link like any other. A null doc_id is kept but never is the
    smallest; a component of nulls alone has a null id. Equal fingerprints are one node, so copies
    are never paired.
    """
    rows = cut(docs.select("doc_id", fingerprint(F.col("text"), words).alias("fp")))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = connected_components(links(nodes.select("fp"), radius))
    named = cut(nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("label")))
    # a component may hold very many fingerprints, a fingerprint very many rows: sums apart from the joins
    least = broadcast_if_small(cut(named.groupBy("label").agg(F.min("first").alias("component_id"))))
    of_fp = broadcast_if_small(cut(named.join(least, "label").select("fp", "component_id")))
    return rows.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Tables and shingles a table of similar_groups: at similarity 0.8 a pair meets with probability 0.99.
TABLES, SAMPLE = 16, 6
#: Texts and shingles of a chunk, two of which are compared with each other in one cell.
CHUNK, CHUNK_SHINGLES = 128, 1 << 19
_SLAB = 2048


def sample_fingerprints(h: np.ndarray, tables: int, sample: int) -> list[int]:
    """SimHash of the ``sample`` smallest distinct hashes under each of ``tables`` permutations."""
    h = np.unique(h)
    out = []
    for t in range(tables):
        # an odd factor permutes the 64-bit words; the high bits are the mixed ones
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64((0x9E3779B97F4A7C15 + 0x632BE59BD9B4E01A * t) % (1 << 64) | 1)
        mixed ^= mixed >> np.uint64(32)
        out.append(majority(np.sort(mixed)[:sample] if len(h) <= sample else np.partition(mixed, sample - 1)[:sample]))
    return out


def _links_of_cell(cell: pa.Table, similarity: float) -> pa.Table:
    """Pairs (a, b) of components of which two texts of the cell reach the similarity."""
    names, of = np.unique(cell.column("component").to_numpy(zero_copy_only=False), return_inverse=True)
    lists = cell.column("hashes").combine_chunks()
    size, n = np.diff(lists.offsets.to_numpy()), cell.num_rows
    _, code, count = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    # a shingle of one text is common to none; the others are multiplied out a slab at a time
    owner = np.repeat(np.arange(n), size)[count[code] > 1]
    code = (np.cumsum(count > 1) - 1)[code[count[code] > 1]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    both = np.zeros((n, n))
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, _SLAB):
        a, b = np.searchsorted(code, (first, first + _SLAB))
        there = np.zeros((n, _SLAB), np.float32)
        there[owner[a:b], code[a:b] - first] = 1
        both += there @ there.T
    near = both / np.maximum(1, size[:, None] + size[None, :] - both) >= similarity
    i, j = np.nonzero(np.triu(near & (of[:, None] != of[None, :]), 1))
    pairs = np.unique(np.sort(np.column_stack([of[i], of[j]]), axis=1), axis=0)
    return pa.table({"a": pa.array(names[pairs[:, 0]], pa.string()), "b": pa.array(names[pairs[:, 1]], pa.string())})


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, text) of the wanted keys. Copies of a text are dropped in the tasks before they move."""
    wanted = cut(wanted)
    small = broadcast_if_small(wanted)
    if small is not wanted:
        return rows.join(small, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    # an inner join stays above the aggregate; a semi join would be pushed below it and meet all copies
    return rows.groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key")


def remaining(rows: DataFrame, named: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) of components that texts in one bucket make: (key, text), (key, table, part, component) -> all.

    Every two texts of different components that share a bucket are compared by the hashes of all their
    shingles. Most texts of a bucket are of one component, its largest, and needn't be compared with
    each other: the others meet it and themselves. Both are cut into chunks of about CHUNK texts or
    CHUNK_SHINGLES shingles; every two chunks meet in a cell of their own, so no task holds a bucket.
    """

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array([np.unique(hashes(t, words)).view(np.int64) for t in utf8(texts)], pa.list_(pa.int64()))

    bucket = ["table", "part"]
    parts = named.groupBy(*bucket, "component").agg(F.count("*").alias("texts"))
    major = parts.groupBy(bucket).agg(F.count("*").alias("components"), F.max_by("component", F.struct("texts", "component")).alias("major"))
    members = cut(named.join(broadcast_if_small(cut(major.where("components > 1").drop("components"))), bucket))
    texts = stored(_texts(rows, members.select("key").distinct()).select("key", hashed("text").alias("hashes")))
    members = members.select(*bucket, "key", "component", (F.col("component") != F.col("major")).alias("minor"))
    members = cut(members.join(texts.select("key", F.size("hashes").cast("long").alias("size")), "key"))

    def chunks(minor: bool, name: str) -> Column:
        mine = F.col("minor") == minor
        return F.greatest(F.ceil(F.count_if(mine) / CHUNK), F.ceil(F.coalesce(F.sum(F.when(mine, F.col("size"))), F.lit(0)) / CHUNK_SHINGLES)).cast("int").alias(name)

    members = members.join(broadcast_if_small(cut(members.groupBy(bucket).agg(chunks(False, "of_major"), chunks(True, "of_minor")))), bucket)
    # chunks of the largest component are numbered first; a text of it meets the others' chunks only
    own = F.when(F.col("minor"), F.col("of_major") + F.pmod(F.hash("key"), "of_minor")).otherwise(F.pmod(F.hash("key"), "of_major"))
    others = F.sequence(F.when(F.col("minor"), F.lit(0)).otherwise(F.col("of_major")), F.col("of_major") + F.col("of_minor") - 1)
    members = members.withColumn("chunk", own).withColumn("other", F.explode(others))
    cells = members.select("key", *bucket, F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "component")
    cell = [*bucket, "low", "high"]

    def links_of(group: pa.Table) -> pa.Table:
        return _links_of_cell(group, similarity)

    return cells.join(texts, "key").select(*cell, "component", "hashes").groupBy(cell).applyInArrow(links_of, "a string, b string").distinct()


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, tables: int = TABLES, sample: int = SAMPLE, radius: int | None = None) -> DataFrame:
    """Distinct texts, by md5 (key), -> (key, component): groups of similarity ``similarity`` or more.

    Two texts link if they meet in a bucket and the Jaccard similarity of their whole word shingles
    reaches ``similarity``; no pair that meets is left out. They meet where their sample fingerprints in one
    of ``tables`` are equal and, with a ``radius``, where the SimHash fingerprints of the whole texts, if they
    differ in no more bits, agree on a covering mask. First each bucket
    proposes, for every member, the bucket's hub (the member that meets most others in all tables,
    such as the text that the others were made from), which joins most groups in time linear in the
    members. Buckets that then still hold texts of several groups are compared whole (``remaining``).
    Texts without words take no part (they are grouped only if equal). Null texts count as empty.
    """

    masks = [] if radius is None else covering_masks(radius)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def sampled(texts: pa.Array) -> pa.Array:
        def of(h: np.ndarray) -> list[int]:
            fp = majority(h) if masks else 0
            return [*(fp & m for m in masks), *sample_fingerprints(h, tables, sample)]

        return pa.array([of(h) if len(h := hashes(t, words)) else [] for t in utf8(texts)], pa.list_(pa.int64()))

    @F.arrow_udf(T.DoubleType())
    def jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(utf8(a), utf8(b), strict=True):
            x, y = np.unique(hashes(x, words)), np.unique(hashes(y, words))
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / max(1, len(x) + len(y) - both))
        return pa.array(out, pa.float64())

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.md5(text).alias("key"), text.alias("text"))
    # a row for each text; its copies are dropped in the tasks before they are shuffled
    samples = stored(rows.select("key", sampled("text").alias("parts")).groupBy("key").agg(F.first("parts").alias("parts")))
    keys = samples.select("key", F.posexplode("parts").alias("table", "part"))
    bucket = ["table", "part"]
    # what a bucket holds is computed apart from the joins with it, so that Spark may split a large one
    sizes = cut(keys.groupBy(bucket).agg(F.count("*").alias("n")).where("n > 1"))
    shared = cut(keys.join(broadcast_if_small(sizes), bucket))
    met = shared.groupBy("key").agg(F.sum("n").alias("met"))
    hubs = cut(shared.join(met, "key").groupBy(bucket).agg(F.max_by("key", F.struct("met", "key")).alias("other")))
    proposed = cut(shared.join(broadcast_if_small(hubs), bucket).select("key", "other").where("key <> other").distinct())
    texts = stored(_texts(rows, proposed.select("key").union(proposed.select("other")).distinct()))
    checked = (
        proposed.join(texts, "key").withColumnRenamed("text", "text_a")
        .join(texts.toDF("other", "text_b"), "other")
        .where(jaccard("text_a", "text_b") >= similarity)
    )
    found = connected_components(checked.select(F.col("key").alias("a"), F.col("other").alias("b")))
    named = shared.join(broadcast_if_small(cut(found)), F.col("key") == F.col("node"), "left")
    named = cut(named.select("key", *bucket, F.coalesce("component", "key").alias("component")))
    further = connected_components(remaining(rows, named, words, similarity)).toDF("component", "whole")
    # the nodes of the second step are components of the first, each named by its smallest key
    labels = named.select("key", "component").distinct().join(broadcast_if_small(cut(further)), "component", "left")
    return labels.select("key", F.coalesce("whole", "component").alias("component"))


def keep_one(docs: DataFrame, radius: int = 2, **options) -> DataFrame:
    """docs without near duplicates: of each group of ``similar_groups`` the smallest doc_id stays.

    Whole texts within ``radius`` bits of each other by SimHash meet, as less similar ones do by their samples.

    Rows with equal texts are one group, empty and null texts too (null is not told from empty).
    A null doc_id stays only in a group without another; of rows alike in doc_id and text one stays,
    the first by its JSON. Rows are told by text and id together, so copies of one text never meet.
    """
    key = F.md5(F.coalesce("text", F.lit("")))
    ids = cut(docs.select(key.alias("key"), "doc_id").groupBy("key", "doc_id").agg(F.count("*").alias("rows")))
    found = similar_groups(docs, radius=radius, **options)
    grouped = ids.groupBy("key").agg(F.min("doc_id").alias("first")).join(found, "key", "left").withColumn("component", F.coalesce("component", "key"))
    # in each group the text whose smallest doc_id is smallest; nulls last, ties to the smaller key
    chosen = grouped.groupBy("component").agg(F.min_by(F.struct("key", "first"), F.struct(F.col("first").isNull(), "first", "key")).alias("c"))
    chosen = chosen.select(F.col("c.key").alias("k"), F.col("c.first").alias("first"))
    same = lambda a, b: (F.col("key") == F.col("k")) & F.col(a).eqNullSafe(F.col(b))
    chosen = cut(chosen.join(ids, same("doc_id", "first")).select("k", "first", "rows"))
    # what goes is less than what stays; where it is small no text is moved
    dropped = cut(ids.join(chosen.where("rows = 1"), same("doc_id", "first"), "left_anti").select(F.col("key").alias("k"), F.col("doc_id").alias("id")))
    whole = docs.select(key.alias("key"), F.struct(*docs.columns).alias("row"))
    kept = whole.join(broadcast_if_small(dropped), same("row.doc_id", "id"), "left_anti").select("row")
    repeated = chosen.where("rows > 1")
    if not repeated.isEmpty():
        alike = whole.join(broadcast_if_small(repeated), same("row.doc_id", "first"), "left_semi")
        kept = kept.union(alike.groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row"))
    return kept.select("row.*")
