"""Mixing sources to target weights by thresholds on a hash, without sorting and without Python."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, stored, with_repeats, word_count

#: Bits of a document's hash, and bits that each refinement looks at.
HASH_BITS, LEVEL_BITS, LEVELS = 60, 10, 3


def row_hash(again: Column) -> Column:
    """The first 60 bits of an md5 of id (null: 'null'), md5 of the text and ordinal, so any engine can repeat it."""
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("digest"), again.cast("string")))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def _sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, h of every row; rows alike in all have ordinals, so each has a hash of its own."""
    digest = F.md5(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", "source", word_count("text").alias("size"), digest.alias("digest"))
    rows = cut(rows.withColumn("alike", F.xxhash64("doc_id", F.col("doc_id").isNull(), "source", F.col("source").isNull(), "digest")))
    return with_repeats(rows, "alike", "again").select("doc_id", "source", "size", row_hash(F.col("again")).alias("h"))


def _in_order(sizes: DataFrame) -> DataFrame:
    """sizes with ``i``: 0, 1, ... by source in code point order, null last. Sorted in ranges, numbered in each."""
    ranges = cut(sizes.orderBy(F.col("source").asc_nulls_last())).withColumn("_part", F.spark_partition_id())
    # a row for each partition of the sort
    counts = sorted(tuple(r) for r in ranges.groupBy("_part").agg(F.count("*")).collect())
    before, total = {}, 0
    for part, n in counts:
        before[part], total = total, total + n
    offset = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("_part")) if before else F.lit(0)
    within = Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())
    return ranges.withColumn("i", (F.row_number().over(within) - 1 + offset).cast("long")).drop("_part")


def source_targets(sizes: DataFrame, share: float, weights: Sequence[int], most: int) -> DataFrame:
    """(source, source_size) -> target too: share of all words by weight, at most ``most`` times a size.

    Sources take the weights in turn by code point, null last. The budget is shared by weight at one
    level; sources whose limit lies under their share stop at it and leave the rest to the others,
    which raises the level, until none stops any more. Every round is one sum over the sources.
    """
    turn = (F.col("i") % len(weights) + 1).cast("int")
    weight = F.element_at(F.array(*map(F.lit, weights)), turn).cast("long")
    df = cut(_in_order(sizes).select("source", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("limit")))
    words, rest = df.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    budget, stopped, level = float(share) * words, 0, 0.0
    while rest:
        level = (budget - stopped) / rest
        full = F.col("limit") / F.col("weight") <= level
        at, left = df.agg(F.coalesce(F.sum(F.when(full, F.col("limit"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if (at, left) == (stopped, rest):
            break
        stopped, rest = at, left
    target = F.col("limit").cast("double") if not rest else F.least(F.col("limit").cast("double"), F.col("weight") * F.lit(level))
    return df.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, share: float = 1.5, weights: Sequence[int] = (5, 2, 1), most: int = 2) -> DataFrame:
    """(source, size, h) -> source, source_size, target, copies, below.

    A document is taken ``copies`` times, and once more if its hash is under ``below``. Words are
    summed by source and hash bucket (1024 a source); the bucket in which a source's budget ends is
    divided again, and only its rows are summed again, until buckets are 2**-30 of the hash range.
    That last bucket is taken if this comes nearer to the budget than leaving it.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = source_targets(sizes, share, weights, most)
    copies = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long")
    bounds = goal.withColumn("copies", copies).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    bounds = cut(bounds.withColumn("prefix", F.lit(0).cast("long")))
    kept = ("source", "source_size", "target", "copies")
    for level in range(1, LEVELS + 1):
        shift = HASH_BITS - level * LEVEL_BITS
        at = F.shiftright("h", shift)
        b = broadcast_if_small(bounds).select(F.col("source").alias("s"), *kept[1:], "budget", "prefix")
        inside = sized.join(b, sized["source"].eqNullSafe(b["s"]) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix")))
        sums = inside.groupBy(*kept, "budget", at.alias("bucket")).agg(F.sum("size").alias("words"))
        by_hash = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("words").over(by_hash))
        # the bucket in which the budget ends; the last one where rounding leaves none
        ends = (F.col("upto") > F.col("budget")) | F.lead("upto").over(by_hash).isNull()
        ends = sums.withColumn("ends", ends).where("ends").groupBy(*kept).agg(F.min_by(F.struct("bucket", "words", "upto", "budget"), "bucket").alias("e"))
        left = F.col("e.budget") - (F.col("e.upto") - F.col("e.words"))
        bounds = cut(ends.select(*kept, left.alias("budget"), F.col("e.bucket").alias("prefix"), F.col("e.words").alias("words")))
    last = F.when(F.col("words") - F.col("budget") <= F.col("budget"), 1).otherwise(0)
    return bounds.select(*kept, F.shiftleft(F.col("prefix") + last, HASH_BITS - LEVELS * LEVEL_BITS).alias("below"))


def _with_copies(sized: DataFrame, **options) -> DataFrame:
    found = broadcast_if_small(cut(thresholds(sized, **options))).withColumnRenamed("source", "s")
    times = F.col("copies") + (F.col("h") < F.col("below")).cast("long")
    return sized.join(found, sized["source"].eqNullSafe(found["s"])).withColumn("times", times)


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs.

    ``taken`` counts the words the mix takes of a row, repeats included; the row's text is taken
    whole 0, 1 or ``most`` times. Null texts have size 0; a null source is a source of its own. Rows
    alike in id, source and text are told apart by ordinals, so some may be taken and others not.
    An empty table gives an empty one.
    """
    done = _with_copies(cut(_sized(docs)), **options)
    return done.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes it, columns unchanged.

    Hashes are those of ``mix``. Texts are not moved; only rows alike in id, source and text, which
    need ordinals, are written out first.
    """
    digest = F.md5(F.coalesce("text", F.lit("")))
    alike = F.xxhash64("doc_id", F.col("doc_id").isNull(), "source", F.col("source").isNull(), digest)
    sized = cut(_sized(docs))
    found = broadcast_if_small(cut(thresholds(sized, **options))).withColumnRenamed("source", "s")
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.col("source").alias("_of"), digest.alias("digest"), alike.alias("alike"))
    several = cut(docs.select(alike.alias("alike")).groupBy("alike").agg(F.count("*").alias("n")).where("n > 1").select("alike"))
    if several.isEmpty():
        numbered = rows.withColumn("again", F.lit(0).cast("long"))
    else:
        known = broadcast_if_small(several)
        repeated = with_repeats(stored(rows.join(known, "alike", "left_semi")), "alike", "again")
        numbered = rows.join(known, "alike", "left_anti").withColumn("again", F.lit(0).cast("long")).unionByName(repeated)
    rows = numbered.select("row", "_of", row_hash(F.col("again")).alias("h"))
    times = (F.col("copies") + (F.col("h") < F.col("below")).cast("long")).cast("int")
    taken = rows.join(found, F.col("_of").eqNullSafe(F.col("s"))).withColumn("times", times).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")


ORACLE = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, '')) || ':'
                             || row_number() over (partition by doc_id, source, coalesce(text, '')) - 1), 1, 15))::bigint as h
  from documents),
sources as (
  select source, sum(size)::bigint as source_size,
         [5, 2, 1][1 + ((row_number() over (order by source nulls last) - 1) % 3)::int] as weight
  from sized group by source),
levels as (
  select *, (1.5::double * sum(source_size) over ()
             - coalesce(sum(2 * source_size) over (order by 2.0::double * source_size / weight, source nulls last
                                                   rows between unbounded preceding and 1 preceding), 0))::double
            / sum(weight) over (order by 2.0::double * source_size / weight, source nulls last
                                rows between current row and unbounded following) as level
  from sources),
targets as (
  select source, source_size, least(2.0::double * source_size, weight * max(level) over ()) as target from levels),
budgets as (
  select *, case when source_size > 0 then least(floor(target / source_size), 2) else 0 end::bigint as copies from targets),
buckets as (
  select s.source, h >> 30 as bucket, sum(size)::bigint as words from sized s group by 1, 2),
running as (
  select b.*, sum(words) over (partition by b.source order by bucket)::bigint as upto,
         lead(bucket) over (partition by b.source order by bucket) is null as final,
         g.target - g.copies * g.source_size as budget
  from buckets b join budgets g on b.source is not distinct from g.source),
bounds as (
  select source, min_by(case when words - (budget - (upto - words)) <= budget - (upto - words) then bucket + 1 else bucket end, bucket) << 30 as below
  from running where upto > budget or final group by source)
select s.doc_id, s.size, g.source_size, g.target, s.size * (g.copies + (s.h < b.below)::bigint) as taken
from sized s join budgets g on s.source is not distinct from g.source join bounds b on s.source is not distinct from b.source
"""
