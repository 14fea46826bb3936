"""The operators' inputs, made of the driver's tables, in DataFrames and as SQL.

A bag is an order, its instances are the line items; two logits come from quantity and from discount
and tax, two levels (0 to 3) from priority and customer. Events are a stream of recordings, documents
a listing of files, embeddings instances with vectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import bags as B
from millrace.operators import metrics, pooling
from millrace.session import stored, tasks
from millrace.sources.tables import table

FOLDS = 5


#: Line items that a task sorts or sums at a time.
LINES = 500_000


def parts(spark: SparkSession, d: str) -> int:
    """Partitions of line items by bag: as many as the session has, fewer of a small table, more of a large one.

    A set number isn't coalesced by Spark, so what a task sorts stays small at any size. Parquet's footers have the count.
    """
    return tasks(spark, table(spark, d, "lineitem").count(), LINES)


def wide_instances(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    return table(spark, d, "lineitem").repartition(parts(spark, d), "l_orderkey").select(
        F.col("l_orderkey").alias("bag_id"), (F.row_number().over(order) - 1).alias("win_idx"),
        ((F.col("l_quantity") - 25.5) / 8.0).alias("x0"), ((F.col("l_discount") - 0.05) * 40.0 + (F.col("l_tax") - 0.04) * 25.0).alias("x1"),
    )


def _by_class(wide: DataFrame) -> DataFrame:
    two = F.inline(F.array(*(F.struct(F.lit(c).alias("class"), F.col(f"x{c}").alias("x")) for c in (0, 1))))
    return wide.select("bag_id", "win_idx", two)


def instances(spark: SparkSession, d: str) -> DataFrame:
    return _by_class(wide_instances(spark, d))


INSTANCES = """
inst as (
  select l_orderkey as bag_id,
         (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) - 1)::int as win_idx,
         (l_quantity::double - 25.5::double) / 8.0::double as x0,
         (l_discount::double - 0.05::double) * 40.0::double + (l_tax::double - 0.04::double) * 25.0::double as x1
  from lineitem),
long as (select bag_id, win_idx, 0 as class, x0 as x from inst union all select bag_id, win_idx, 1, x1 from inst)"""


def bags(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("bag_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("regime"),
        F.greatest(F.lit(0), 4 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("idx0"),
        F.greatest(F.lit(0), (F.col("o_custkey") % 8).cast("int") - 4).alias("idx1"),
    )
    return B.with_blocks(rows, F.col("ts")).withColumn("fold", F.col("block") % FOLDS)


BAGS = """
bags as (
  select o_orderkey as bag_id, o_orderdate as ts, o_orderstatus as regime,
         greatest(0, 4 - substr(o_orderpriority, 1, 1)::int) as idx0, greatest(0, (o_custkey % 8)::int - 4) as idx1,
         floor(date_diff('day', min(o_orderdate) over (), o_orderdate) / 3.0)::int as block,
         (floor(date_diff('day', min(o_orderdate) over (), o_orderdate) / 3.0)::int % 5)::int as fold
  from orders)"""

POOLED = """
tops as (select *, max(x) over (partition by bag_id, class) as top from long),
pooled as (
  select bag_id, class, count(*) as n, avg(x) as mean, max(x) as max, max(x) + ln(avg(exp(x - top))) as lme,
         least(greatest(sum((1 / (1 + exp(-x))) ** 2) / greatest(sum(1 / (1 + exp(-x))), 1e-6::double), 1e-6::double), 1 - 1e-6::double) as q
  from tops group by bag_id, class),
pools as (select bag_id, class, n, mean, max, lme, ln(q) - ln(1 - q) as linear_softmax from pooled)"""


def level() -> Column:
    return F.when(F.col("class") == 0, F.col("idx0")).otherwise(F.col("idx1"))


POOLERS = ("mean", "max", "lme", "linear_softmax")


def _models(pools: DataFrame) -> DataFrame:
    return pooling.long(pools, POOLERS, [c for c in pools.columns if c not in POOLERS]).withColumnRenamed("logit", "score")


def _pools(spark: SparkSession, d: str) -> DataFrame:
    """bag columns, class, lvl, y and the poolers.

    Bags are small, so partial sums save nothing: lines move once, by bag, and pooling and the join with bags stay there.
    """
    rows = instances(spark, d)
    # joined before the poolers become rows, which keeps the rows where they are
    return pooling.pool(rows).drop("n").join(bags(spark, d), "bag_id").withColumn("lvl", level()).withColumn("y", (F.col("lvl") > 0).cast("int"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """bag columns, class, pooling, score, lvl, y: four poolers as four models."""
    return _models(_pools(spark, d))


def kept(spark: SparkSession, d: str, *keys: str | Column) -> DataFrame:
    """pooling, class, keys, y and score of ``scored``, pooled once and stored for queries that read them several times.

    As rows of one pooler: Spark runs a shuffle above ``unpivot`` or ``explode`` again for each side of a plan that reads it.
    """
    return stored(_models(_pools(spark, d).select("class", *keys, "y", *POOLERS)))


def tied(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    """pooling, class, keys, y, score (rounded) and n, the bags that share them; made once, for queries that read them several times."""
    return metrics.tied(scored(spark, d), ["pooling", "class", *keys, "y"])


SCORED = f"""{INSTANCES}, {BAGS}, {POOLED},
pool_long as (
  select bag_id, class, 'mean' as pooling, mean as score from pools union all select bag_id, class, 'max', max from pools
  union all select bag_id, class, 'lme', lme from pools union all select bag_id, class, 'linear_softmax', linear_softmax from pools),
scored as (
  select p.*, b.ts, b.regime, b.block, b.fold, b.idx0, b.idx1, case when class = 0 then idx0 else idx1 end as lvl,
         (case when class = 0 then idx0 else idx1 end > 0)::int as y
  from pool_long p join bags b using (bag_id))"""


def ap_sql(rows: str, keys: str, weight: str = "1.0::double", name: str = "aps") -> str:
    """CTEs ending in ``name``: tie-aware average precision of rows (keys, score, y)."""
    return f"""
{name}_g as (select {keys}, round(score, 9) as score, sum({weight} * y)::double as tp, sum({weight})::double as n from {rows} group by {keys}, round(score, 9)),
{name}_r as (
  select *, sum(tp) over (partition by {keys} order by score desc) as ctp, sum(n) over (partition by {keys} order by score desc) as cn,
         sum(tp) over (partition by {keys}) as ptp from {name}_g),
{name} as (select {keys}, sum(case when cn > 0 then tp / nullif(ptp, 0) * ctp / cn when ptp > 0 then 0 end) as ap from {name}_r group by {keys})"""


def clips(spark: SparkSession, d: str) -> DataFrame:
    """Events as recordings: start, sample_rate (one a period of days), duration_s, qc_ok, clip_frac."""
    return table(spark, d, "events").select(
        F.col("ts").alias("start"), F.when(F.dayofmonth("ts") <= 10, 8000).otherwise(44100).alias("sample_rate"),
        (F.col("value").cast("double") % 60).alias("duration_s"), (F.col("event_id") % 997 != 0).alias("qc_ok"), (F.col("value") / 1000).alias("clip_frac"), "event_id", "event_type",
    )


CLIPS = """
clips as (
  select ts as start, case when day(ts) <= 10 then 8000 else 44100 end as sample_rate, value::double % 60 as duration_s,
         event_id % 997 <> 0 as qc_ok, value / 1000 as clip_frac, event_id, event_type from events),
hours as (
  select date_trunc('hour', start)::timestamp as hour, count(*) as n_clips,
         case when count(distinct sample_rate) = 1 then min(sample_rate) else 0 end as sample_rate,
         round(sum(duration_s), 3) as bag_duration_s, max(clip_frac) as clip_frac_max, bool_and(qc_ok) as qc_ok
  from clips group by 1)"""


def files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a listing: hash (sometimes missing), size, path, name, doc_id."""
    i = F.col("doc_id")
    name = F.concat(F.lit("site_202401"), F.lpad((i % 28 + 1).cast("string"), 2, "0"), F.lit("_"), F.lpad((i % 24).cast("string"), 2, "0"), F.lpad((i % 60).cast("string"), 2, "0"), F.lit("00"), F.when(i % 31 == 0, ".txt").when(i % 29 == 0, ".WAV").otherwise(".wav"))
    folder = F.concat(F.when(i % 7 == 0, "12-04 10.00 - Up").otherwise(F.col("source")), F.when(i % 5 == 0, "/deep").otherwise(""))
    return table(spark, d, "documents").select("doc_id", F.when(i % 41 != 0, F.sha2("text", 256)).alias("hash"), F.col("n_chars").alias("size"), F.concat(folder, F.lit("/"), name).alias("path"), name.alias("name"))


FILES = """
files as (
  select doc_id, case when doc_id % 41 <> 0 then sha256(text) end as hash, n_chars as size,
         (case when doc_id % 7 = 0 then '12-04 10.00 - Up' else source end) || (case when doc_id % 5 = 0 then '/deep' else '' end) || '/' || name as path, name
  from (select *, 'site_202401' || lpad((doc_id % 28 + 1)::varchar, 2, '0') || '_' || lpad((doc_id % 24)::varchar, 2, '0') || lpad((doc_id % 60)::varchar, 2, '0') || '00'
                  || case when doc_id % 31 = 0 then '.txt' when doc_id % 29 = 0 then '.WAV' else '.wav' end as name from documents)),
local as (select name, hash from files where doc_id % 3 = 0),
replaced as (select hash from files where doc_id % 11 = 1),
wavs as (select * from files where lower(name) like '%.wav'),
ranked as (
  select hash, path, size, name, row_number() over (partition by hash order by regexp_matches(split_part(path, '/', 1), '^\\d+-.* - '), length(path) - length(replace(path, '/', '')), path, size) as i
  from wavs where hash is not null and hash not in (select hash from local where hash is not null) and hash not in (select hash from replaced where hash is not null)),
chosen as (
  select hash, path, size, name,
         case when not regexp_matches(name, '^(.+)_(\\d{8})_(\\d{6})\\.wav$') then 'bad_name' when name in (select name from local) then 'clash_local' end as early
  from ranked where i = 1),
compared as (
  select hash, path, size, name, coalesce(early, case when count(*) filter (where early is null) over (partition by name) > 1 then 'clash_remote' else 'new' end) as category from chosen
  union all
  select hash, path, size, name, case when hash is null then 'nohash' when hash in (select hash from local where hash is not null) then 'local' else 'replaced' end
  from wavs where hash is null or hash in (select hash from local where hash is not null) or hash in (select hash from replaced where hash is not null))"""
