"""Queries of guards, runs and reports, with their SQL; they join those of ``catalogue``."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import scalar as S
from millrace.operators import bags as B
from millrace.operators import bootstrap, calendar, guards, ingest, metrics, reports, runs
from millrace.session import cut, if_few
from millrace.sources.tables import table

from . import grounding as G
from .catalogue import _ALL_DRAWN, _BOOTS, FULL, _DRAWN, _NIGHTS, _VAL, _annotations, _drawn, _in_clusters, _night_columns, _RUNS, _runs, _seeded, _val_test, query, r6
from .grounding import ap_sql

# ---------------------------------------------------------------- guards


def _instances(spark, d):
    """Line items as instances; the third of each bag's windows is gone where the order divides by 50."""
    rows = G.wide_instances(spark, d).select("bag_id", "win_idx")
    rows = rows.where((F.col("bag_id") % 50 != 0) | (F.col("win_idx") != 2))
    return rows.withColumn("instance_id", F.concat_ws("-", "bag_id", "win_idx"))


_INST = f"""{G.INSTANCES}, held as (select bag_id, win_idx, bag_id || '-' || win_idx as instance_id from inst where bag_id % 50 <> 0 or win_idx <> 2),
cache as (select instance_id || case when bag_id % 97 = 0 then 'x' else '' end as instance_id, bag_id % 31 <> 0 as done from held where bag_id % 41 <> 0 union all select instance_id, true from held where bag_id % 89 = 0)"""


@query(f"""with {_INST}, c as (select instance_id, count(*) as copies, min(coalesce(done, false)::int) as done from cache group by 1),
f as (select case when c.instance_id is null then 'missing' when h.instance_id is null then 'unexpected' when copies > 1 then 'repeated' when done = 0 then 'not done' end as fault, h.bag_id as "at"
      from held h full join c on h.instance_id = c.instance_id)
select fault, "at", count(*) as n from f where fault is not null group by fault, "at"
union all select 'gap', bag_id, count(*) from held group by bag_id having min(win_idx) <> 0 or max(win_idx) <> count(*) - 1 or count(distinct win_idx) <> count(*)""")
def cache_faults(spark, d):
    held, i = _instances(spark, d), F.col("bag_id")
    cache = held.where(i % 41 != 0).select(F.concat("instance_id", F.when(i % 97 == 0, "x").otherwise("")).alias("instance_id"), (i % 31 != 0).alias("done"))
    return guards.cache_faults(held, cache.union(held.where(i % 89 == 0).select("instance_id", F.lit(True))), G.parts(spark, d))


@query(f"with {G.INSTANCES}, {G.BAGS} select bag_id from bags where bag_id not in (select bag_id from inst)")
def bags_without_windows(spark, d):
    return guards.bags_without_windows(G.bags(spark, d), G.wide_instances(spark, d))


@query(f"with {G.INSTANCES}, {G.BAGS} select bag_id, any_value(fold) as fold, count(*) as n_windows, round(sum((win_idx + 1) * x0), 6) as in_order from bags join inst using (bag_id) group by bag_id")
def load_bags(spark, d):
    """Bags with their windows' values in order, summed with their places; bags without windows would be an error."""
    windows = G.wide_instances(spark, d)
    there = G.bags(spark, d).join(windows.select("bag_id"), "bag_id", "left_semi")
    loaded = guards.load_bags(there, windows, "x0")
    placed = F.aggregate(F.transform("vectors", lambda x, i: (i + 1) * x), F.lit(0.0), lambda s, x: s + x)
    return loaded.select("bag_id", "fold", "n_windows", F.round(placed, 6).alias("in_order"))


@query(f"""with {G.SCORED}, p as (select pooling, class, case when pooling = 'max' and bag_id % 7 = 0 then 'other' else 'this' end as dataset_id, bag_id + case when pooling = 'lme' and bag_id % 5 = 0 then 100000000 else 0 end as bag_id from scored
  where pooling <> 'mean' or bag_id % 3 <> 0 union all select pooling, class, 'this', bag_id from scored where pooling = 'mean' and class = 1 and bag_id % 11 = 1 and bag_id % 3 <> 0),
known as (select distinct bag_id from inst), g as (select pooling, class, bag_id, count(*) as copies, count(*) filter (where dataset_id <> 'this') as other from p group by all),
s as (select pooling, class, count(k.bag_id) as found, count(*) filter (where k.bag_id is null) as n_extra, count(*) filter (where copies > 1) as n_repeated, sum(other)::bigint as n_other from g left join known k on k.bag_id = g.bag_id group by all)
select pooling, class, (select count(*) from known) - found as n_missing, n_extra, n_repeated, n_other from s where (select count(*) from known) - found + n_extra + n_repeated + n_other > 0""")
def model_faults(spark, d):
    s, i = G.scored(spark, d), F.col("bag_id")
    row = lambda dataset, bag: F.struct(dataset.alias("dataset_id"), bag.alias("bag_id"))
    bad = row(F.when((F.col("pooling") == "max") & (i % 7 == 0), "other").otherwise("this"), i + F.when((F.col("pooling") == "lme") & (i % 5 == 0), 100000000).otherwise(0))
    again = F.when(F.expr("pooling = 'mean' and class = 1 and bag_id % 11 = 1 and bag_id % 3 <> 0"), row(F.lit("this"), i))
    rows = F.array(F.when((F.col("pooling") != "mean") | (i % 3 != 0), bad), again)
    predictions = s.select("pooling", "class", F.inline(F.filter(rows, lambda r: r.isNotNull())))
    # a bag has a row for each of eight models
    return guards.model_faults(predictions, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("bag_id")), "this", ["pooling", "class"], 2 * G.parts(spark, d))


@query("select o_orderpriority as regime from orders where o_custkey % 3 = 0 except select o_orderpriority from orders where o_custkey % 3 = 1 and o_orderpriority not like '1%'")
def unknown_regimes(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderpriority", "regime")
    return guards.unknown(o.where("o_custkey % 3 = 0"), o.where("o_custkey % 3 = 1 and regime not like '1%'"), ["regime"])


@query(f"with {G.INSTANCES}, {G.BAGS} select bag_id, win_idx, fold from inst join bags using (bag_id) where idx0 > 0 and regime <> 'P'")
def subset_manifest(spark, d):
    b = G.bags(spark, d)
    return guards.subset(G.wide_instances(spark, d).select("bag_id", "win_idx"), b.where("idx0 > 0 and regime <> 'P'"), b).select("bag_id", "win_idx", "fold")


@query("select n_regionkey, array_to_string(list_filter(list(n_name order by n_name), lambda x: regexp_matches(x, '^(?:A|I.*[AN]$)')), ',') as chosen from nation group by n_regionkey")
def matching_columns(spark, d):
    names = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    return names.select("n_regionkey", F.array_join(guards.select_matching(F.col("names"), ["A", "I.*[AN]$"]), ",").alias("chosen"))


# ---------------------------------------------------------------- ingest

@query("""with t as (select doc_id, coalesce(text, '') as text, encode(coalesce(text, '')) as b from documents),
p as (select doc_id, i, sha256(b[i * 1000 + 1:(i + 1) * 1000]) as h from t, range((octet_length(b) + 999) // 1000) r(i))
select doc_id, sha256(unhex(coalesce(string_agg(h, '' order by i), ''))) as hash from t left join p using (doc_id) group by doc_id""")
def composite_hash(spark, d):
    """Hash of the texts as contents, in blocks of 1000 bytes."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", ingest.block_hash(F.coalesce("text", F.lit("")).cast("binary"), 1000).alias("hash"))


_SEED = f"""{G.FILES}, old as (select name, hash from files where doc_id % 3 <> 0 and hash is not null), there as (select distinct name, size, doc_id % 7 as mtime_ns, doc_id % 10 as ctime_ns from files where doc_id % 5 <> 0),
said as (select distinct hash, size + case when doc_id % 13 = 0 then 1 else 0 end as size from files where hash is not null)"""


@query(f"with {_SEED} select o.name, t.size, t.mtime_ns, o.hash from old o join there t on o.name = t.name where t.ctime_ns < 6 and exists (select 1 from said s where s.hash = o.hash and s.size = t.size)")
def seed_cache(spark, d):
    f, i = G.files(spark, d), F.col("doc_id")
    there = f.where(i % 5 != 0).select("name", "size", (i % 7).alias("mtime_ns"), (i % 10).alias("ctime_ns")).distinct()
    listing = f.select("hash", (F.col("size") + F.when(i % 13 == 0, 1).otherwise(0)).alias("size"))
    return ingest.seeded_cache(f.where((i % 3 != 0) & F.col("hash").isNotNull()).select("name", "hash"), 6, listing, there)


@query(f"with {G.FILES} select category, coalesce(nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), ''), '.') as folder, count(*) as files, count(distinct hash) as hashes, round(sum(size) / 1e9::double, 9) as gb from compared group by all")
def files_by_folder(spark, d):
    from .catalogue import _compared

    return ingest.by_folder(_compared(spark, d)[1], ["category"]).withColumn("gb", F.round("gb", 9))


@query(f"""with {G.FILES}, v as (select name, min(doc_id) % 4 <> 0 as ok, 'digital zero' as fail from files group by name having min(doc_id) % 9 <> 0), p as (select distinct name, case when name in (select name from local) then 'clash' else 'new' end as action from files),
r as (select p.name, case when v.name is null then 'not verified' when not ok then 'failed: ' || fail when action = 'clash' then 'would replace another file' end as reason from p left join v on p.name = v.name) select * from r where reason is not null""")
def merge_refusals(spark, d):
    f = G.files(spark, d)
    plan = ingest.plan_merge(f, f.where("doc_id % 3 = 0"))
    first = f.groupBy("name").agg(F.min("doc_id").alias("i")).where("i % 9 <> 0")
    return ingest.merge_refusals(first.select("name", (F.col("i") % 4 != 0).alias("ok"), F.lit("digital zero").alias("fail")), plan)


@query(f"""with {G.FILES}, q as (select distinct name, length(name) % 2 = 0 or doc_id % 3 <> 0 as qc_ok, 'clipping' as qc_reason from files where doc_id % 10 <> 0), n as (select distinct name from files), j as (select n.name, qc_ok, qc_reason from n left join q on n.name = q.name)
select name, reason from (select name, case when not regexp_matches(name, '^(.+)_(\\d{{8}})_(\\d{{6}})\\.wav$') then 'unparsed filename' when qc_ok is null then 'not checked' when not qc_ok then qc_reason end as reason from j) where reason is not null""")
def scan_rejects(spark, d):
    f, i = G.files(spark, d), F.col("doc_id")
    q = f.where(i % 10 != 0).select("name", ((F.length("name") % 2 == 0) | (i % 3 != 0)).alias("qc_ok"), F.lit("clipping").alias("qc_reason")).distinct()
    return ingest.rejects(f.select("name").distinct(), q)


@query("select distinct source as name, regexp_matches(source, '^[A-Za-z0-9][A-Za-z0-9._-]*$') as ok from (select source from documents union all select source || ' ' || lang from documents) where source is not null")
def batch_names(spark, d):
    docs = table(spark, d, "documents").where("source is not null")
    names = docs.select(F.col("source").alias("name")).union(docs.select(F.concat_ws(" ", "source", "lang"))).distinct()
    return names.select("name", ingest.is_batch_name(F.col("name")).alias("ok"))


# ---------------------------------------------------------------- runs

@query(f"""with {_RUNS}, g as (select h, w, f, p from (select distinct hidden as h from runs), (select distinct ordinal_weight as w from runs), (select distinct dataset % 2 = 0 as f from runs), (select distinct pooling as p from runs)),
a as (select '--hidden ' || h || ' --ordinal-weight ' || w || case when f then ' --balanced' else '' end || ' --pooling ' || p as arguments from g) select substr(sha256(arguments), 1, 12) as run, arguments from a""")
def sweep_grid(spark, d):
    """All combinations of the settings that runs have, as arguments."""
    factors = ["hidden", "ordinal_weight", "balanced", "pooling"]
    return runs.sweep(runs.grid(_runs(spark, d).withColumn("balanced", F.col("dataset") % 2 == 0), factors), factors).select("run", "arguments")


@query(f"with {_RUNS}, b as (select distinct o_orderstatus as s from orders) select model_id, 'model' as kind, hidden, pooling, 0 as rank_of_kind from runs union all select 'baseline/' || s, 'baseline', null, 'clock', 1 from b")
def models_and_baselines(spark, d):
    base = table(spark, d, "orders").select(F.concat(F.lit("baseline/"), "o_orderstatus").alias("model_id"), F.lit("clock").alias("pooling")).distinct()
    return runs.with_baselines(_runs(spark, d), base).select("model_id", "kind", "hidden", "pooling", "rank_of_kind")


@query(f"""with {_RUNS}
select model_id, (case when hidden > 0 then 64 * hidden + hidden else 0 end + case when hidden > 0 then hidden else 64 end * 2 + 2 + case when ordinal_weight > 0 then 4 else 0 end)::int as parameters from runs""")
def parameter_counts(spark, d):
    n = runs.parameter_count(F.lit(64), 2, F.col("hidden"), 3, F.col("ordinal_weight"), F.col("pooling"), 16)
    return _runs(spark, d).select("model_id", n.cast("int").alias("parameters"))


_FOLDS = f"with {G.SCORED}, {ap_sql('scored', 'pooling, class, fold')}"


@query(f"{_FOLDS} select pooling, class, count(*) as n_seeds, round(min(ap), 6) as lo, round(avg(ap), 6) as mean, round(max(ap), 6) as hi from aps group by pooling, class")
def seed_ranges(spark, d):
    aps = metrics.average_precision(G.scored(spark, d), ["pooling", "class", "fold"]).withColumnRenamed("fold", "seed")
    return runs.seed_ranges(aps, ["pooling", "class"]).select("pooling", "class", "n_seeds", r6("lo"), r6("mean"), r6("hi"))


_FLAGS = f"with {G.SCORED}, {_VAL}, flags as (select s.*, coalesce(round(score, 9) >= cutoff, false)::int * y as hit from scored s join cuts using (pooling, class, fold))"


@query(f"{_FLAGS}, r as (select pooling, class, sum(hit) / nullif(sum(y), 0)::double as recall from flags group by all), m as (select pooling, avg(recall) as recall from r group by pooling) select pooling, round(recall, 6) as recall, row_number() over (order by round(recall, 9) desc, pooling)::int as place from m")
def rank_by_recall(spark, d):
    recalls = metrics.recall_at_precision(*_val_test(spark, d), ["pooling", "class"], 0.25, weight=F.col("n"))
    return runs.ranked_by_recall(recalls, "pooling").select("pooling", r6("recall"), "place")


@query(f"""{_FLAGS}, {_ALL_DRAWN}, shares as (select pooling, class, b, sum(hit * count) / nullif(sum(y * count), 0)::double as share from flags join drawn on stratum = regime and cluster = block group by all)
select pooling, class, round(quantile_cont(share, 0.025), 6) as lo, round(quantile_cont(share, 0.975), 6) as hi from shares group by all""")
def recall_ci(spark, d):
    """Intervals of recall at a precision: flags are fixed by the validation cutoffs, clusters are drawn."""
    val, test = _val_test(spark, d, "regime", "block")
    cuts = cut(metrics.cutoff(val, ["pooling", "class", "fold"], 0.25, F.col("n")))
    flag = F.coalesce(metrics.to_digits(F.col("score")) >= F.col("cutoff"), F.lit(False)).cast("int")
    rows = _in_clusters(test.join(if_few(cuts), ["pooling", "class", "fold"], "left").withColumns({"hit": F.col("n") * flag * F.col("y"), "y": F.col("n") * F.col("y")}))
    shares = bootstrap.resampled_share(rows, _drawn(spark, d, FULL), ["pooling", "class"], "hit", "y")
    return bootstrap.interval(shares, ["pooling", "class"], "share").select("pooling", "class", r6("lo"), r6("hi"))


@query(f"with {G.SCORED}, {_VAL} select pooling, class, count(cutoff) as n, round(avg(cutoff), 6) as threshold from cuts group by all")
def threshold_means(spark, d):
    cuts = metrics.cutoff(_val_test(spark, d)[0], ["pooling", "class", "fold"], 0.25, F.col("n")).withColumnRenamed("cutoff", "threshold")
    return runs.threshold_means(cuts, ["pooling", "class"]).select("pooling", "class", "n", r6("threshold"))


@query(f"""with {G.SCORED}, {_VAL}, {_ALL_DRAWN}, levels(wanted, k) as (values (0.25::double, 1), (0.4::double, 2)),
all_cuts as (select pooling, class, f as fold, wanted, min(case when prec >= wanted then score end) as cutoff from val_r, levels group by pooling, class, f, wanted),
hits as (select s.pooling, s.class, c.wanted, s.regime, s.block, s.y, coalesce(round(score, 9) >= cutoff, false)::int * y as hit from scored s join all_cuts c using (pooling, class, fold)),
points as (select pooling, class, wanted, sum(hit) / nullif(sum(y), 0)::double as r from hits group by all),
boots as (select pooling, class, wanted, b, sum(hit * count) / nullif(sum(y * count), 0)::double as r from hits join drawn on stratum = regime and cluster = block group by all),
ends as (select pooling, class, wanted, quantile_cont(r, 0.025) as lo, quantile_cont(r, 0.975) as hi from boots group by all),
ds as (select m.pooling, m.class, m.wanted, m.r - s.r as x from boots m join boots s on s.pooling = 'mean' and m.class = s.class and m.wanted = s.wanted and m.b = s.b where m.pooling <> 'mean'),
de as (select pooling, class, wanted, quantile_cont(x, 0.025) as lo, quantile_cont(x, 0.975) as hi from ds group by all)
select p.pooling, p.class, p.wanted, round(p.r, 6) as recall, round(e.lo, 6) as lo, round(e.hi, 6) as hi, round(case when p.pooling <> 'mean' then p.r - s.r end, 6) as delta, round(de.lo, 6) as delta_lo, round(de.hi, 6) as delta_hi,
  case when p.pooling = 'mean' then null when de.lo > 0 then 'better' when de.hi < 0 then 'worse' else 'tied' end as verdict
from points p join ends e using (pooling, class, wanted) join points s on s.pooling = 'mean' and s.class = p.class and s.wanted = p.wanted left join de on de.pooling = p.pooling and de.class = p.class and de.wanted = p.wanted""")
def recall_table(spark, d):
    """Recall at two precisions with differences to the selected model, over 2000 resamples."""
    val, test = _val_test(spark, d, "regime", "block")
    rows = reports.recall_table(_in_clusters(val), _in_clusters(test), _drawn(spark, d, FULL), [0.25, 0.4], "mean", weight=F.col("n"))
    return rows.select("pooling", "class", F.col("at").alias("wanted"), *map(r6, ("recall", "lo", "hi", "delta", "delta_lo", "delta_hi")), "verdict")


@query()
def recall_full(spark, d):
    """The same as recall_table, which took 20 resamples once."""
    return recall_table(spark, d)


@query("""with f as (select c_custkey as fit, c_custkey % 3 as seed, c_custkey % 5 as fold, ['mean', 'lme'][c_custkey % 2 + 1] as pooling, list_transform(range(6), lambda i: ((c_custkey * 7 + i * 3) % 11 - 5) / 4.0::double) as v from customer),
t as (select fit, pooling, c::int as class, k::int + 2 as level, list_sum(list_transform(v[c * 3 + 1:c * 3 + k + 1], lambda x: ln(1 + exp(x)))) as t from f, range(2) c(c), range(3) k(k))
select pooling, class, level, count(*) as n, round(avg(t), 6) as threshold from t group by all""")
def learned_thresholds(spark, d):
    """Thresholds of ordinal heads from a table of stored weights, a fit for each customer, over seeds and folds."""
    c = F.col("c_custkey")
    gaps = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: (((c * 7 + i * 3) % 11) - 5) / F.lit(4.0))
    stored = table(spark, d, "customer").select(
        c.alias("fit"), F.lit("linear-ord0.5").alias("run_id"), F.when(c % 2 == 0, "mean").otherwise("lme").alias("pooling"), (c % 3).alias("seed"), (c % 5).alias("fold"),
        F.lit("gap").alias("name"), F.array(F.lit(2), F.lit(3)).alias("shape"), gaps.alias("values"),
    )
    return runs.threshold_means(runs.learned_thresholds(stored), ["pooling", "class", "level"]).select("pooling", "class", "level", "n", r6("threshold"))


_DAYS = range(1, 32)


@query(f"select hour(ts)::int as hour, {', '.join(f'count(*) filter (where day(ts) = {i}) as day_{i:02d}' for i in _DAYS)} from events group by 1")
def calendar_grid(spark, d):
    """Events by hour and day of the month, a column for each day whether it has any or not."""
    rows = table(spark, d, "events").select(F.hour("ts").alias("hour"), F.format_string("day_%02d", F.dayofmonth("ts")).alias("day"))
    return calendar.grid(rows, "hour", "day", [f"day_{i:02d}" for i in _DAYS], F.count("hour"))


@query(f"""with {G.BAGS}, n as (select fold, greatest(floor(count(*) / 256), 1) as k from bags group by fold)
select bag_id, fold, floor(('0x' || substr(md5('0:3:' || bag_id), 1, 8))::bigint * k / 4294967296.0::double)::int as batch from bags join n using (fold)""")
def shuffled_batches(spark, d):
    return runs.shuffled_batches(G.bags(spark, d), "bag_id", 256, 3, keys=["fold"]).select("bag_id", "fold", "batch")


# ---------------------------------------------------------------- report tables

_LEVELS = "case when lvl in (0, 1) then 'level:1' end, case when lvl in (0, 2) then 'level:2' end, case when lvl in (0, 3) then 'level:3' end"
_CELLED = f"""with {G.SCORED}, {_ALL_DRAWN.split('met as')[0].rstrip().rstrip(',')},
celled as (select s.*, c.c as cell from scored s, unnest(list_filter(['presence', 'regime:' || regime, {_LEVELS}], lambda x: x is not null)) c(c)),
met as (select pooling, class, cell, b, score, y, count as w from celled join drawn on stratum = regime and cluster = block),
{ap_sql('met', 'pooling, class, cell, b', 'w', 'boots')}, {ap_sql('celled', 'pooling, class, cell', name='points')},
ends as (select pooling, class, cell, quantile_cont(ap, 0.025) as lo, quantile_cont(ap, 0.975) as hi from boots group by all),
sizes as (select pooling, class, cell, count(*) as n_bags, sum(y)::bigint as n_pos from celled group by all)"""
_CELL_COLUMNS = "pooling, class, cell, n_bags, n_pos, round(n_pos / n_bags::double, 6) as chance, round(ap, 6) as ap, round(lo, 6) as lo, round(hi, 6) as hi from sizes join points using (pooling, class, cell) join ends using (pooling, class, cell)"


def _one_seed(spark, d):
    """One seed with regimes, levels, strata and clusters."""
    return G.kept(spark, d, "regime", "block", "lvl").withColumns({"seed": F.lit(0), "stratum": F.col("regime"), "cluster": F.col("block")})


def _statistics(rows, drawn, kind):
    """Points and resamples in the cells of level, of which a bag may be in several, or of regime, of which it is in one."""
    cells = reports.level_cells(3) if kind == "level" else None
    return reports.statistics(rows if cells else rows.withColumn("cell", F.concat(F.lit("regime:"), "regime")), drawn, ["pooling"], cells=cells)


def _cell_table(spark, d, kind, least):
    rows, n = _one_seed(spark, d), F.col("n")
    points, boots = _statistics(rows, _drawn(spark, d, FULL), kind)
    # bags are counted by level and regime before they are told by cell
    counts = rows.groupBy("pooling", "class", "seed", "lvl", "regime", "y").agg(F.count("*").alias("n"))
    out = reports.cell_table(reports.in_cells(counts, 3, kinds=[kind]), points, boots, ["pooling"], kind, least, n)
    return out.select("pooling", "class", "cell", "n_bags", "n_pos", *map(r6, ("chance", "ap", "lo", "hi")))


@query(f"{_CELLED} select {_CELL_COLUMNS} where cell like 'level:%' and n_pos >= 5")
def per_level(spark, d):
    return _cell_table(spark, d, "level", 5)


@query(f"{_CELLED} select {_CELL_COLUMNS} where cell like 'regime:%'")
def per_regime(spark, d):
    return _cell_table(spark, d, "regime", 0)


@query(f"""{_CELLED}, arms(model_id, reference, trained_on) as (values ('max', 'lme', ['F', 'O']), ('mean', 'lme', ['O']), ('lme', 'lme', null)),
r as (select model_id, class, a.cell[8:] as regime, a.ap, a.ap - p.ap as delta, trained_on, reference, a.cell from arms join points a on a.pooling = model_id join points p on p.pooling = reference and p.class = a.class and p.cell = a.cell where a.cell like 'regime:%'),
ds as (select model_id, a.class, a.cell, quantile_cont(a.ap - p.ap, 0.025) as lo, quantile_cont(a.ap - p.ap, 0.975) as hi from arms join boots a on a.pooling = model_id join boots p on p.pooling = reference and p.class = a.class and p.cell = a.cell and p.b = a.b group by model_id, a.class, a.cell)
select model_id, class, regime, round(ap, 6) as ap, round(delta, 6) as delta, round(lo, 6) as lo, round(hi, 6) as hi, coalesce(not list_contains(trained_on, regime), false) as unseen,
       case when coalesce(not list_contains(trained_on, regime), false) then '**' || printf('%.3f', ap) || '**' else printf('%.3f', ap) end as text from r join ds using (model_id, class, cell)""".replace("select model_id, class, a.cell[8:]", "select model_id, a.class, a.cell[8:]"))
def transfer_table(spark, d):
    points, boots = (x.withColumnRenamed("pooling", "model_id") for x in _statistics(_one_seed(spark, d), _drawn(spark, d, FULL), "regime"))
    boots = cut(boots)
    arms = spark.createDataFrame([("max", "lme", ["F", "O"]), ("mean", "lme", ["O"]), ("lme", "lme", None)], "model_id string, reference string, trained_on array<string>")
    out = reports.transfer_table(points, boots, arms)
    return out.select("model_id", "class", "regime", *map(r6, ("ap", "delta", "lo", "hi")), "unseen", "text")


_OVER = f"""with {G.SCORED}, {_DRAWN.split('met as')[0].rstrip().rstrip(',')},
seeds as (select pooling, class, t.t::int as seed, regime, block, fold, score + t.t * 0.05::double * (bag_id % 7) as score, y from scored s, range(2) t(t)),
met as (select pooling, class, seed, b, score, y, count as w from seeds join drawn on stratum = regime and cluster = block),
{ap_sql('met', 'pooling, class, seed, b', 'w', 'seed_boots')}, {ap_sql('seeds', 'pooling, class, seed', name='seed_points')}, vals as (select * from seeds where fold = 0), {ap_sql('vals', 'pooling, class, seed', name='val_points')},
boots as (select pooling, b, avg(ap) as ap from (select pooling, class, b, avg(ap) as ap from seed_boots group by all) group by all), ends as (select pooling, quantile_cont(ap, 0.025) as lo, quantile_cont(ap, 0.975) as hi from boots group by all),
macros as (select pooling, seed, avg(ap) as ap from seed_points group by all), points as (select pooling, count(*) as n_seeds, avg(ap) as ap, stddev_pop(ap) as sd from macros group by pooling),
val as (select pooling, avg(ap) as val_ap from val_points group by pooling)"""


@query(f"{_OVER} select pooling as model_id, n_seeds, round(ap, 6) as ap, round(lo, 6) as lo, round(hi, 6) as hi, round(sd, 6) as sd, round(val_ap, 6) as val_ap, row_number() over (order by round(val_ap, 9) desc, pooling) = 1 as selected from points join ends using (pooling) join val using (pooling)")
def overview_ci(spark, d):
    """The report's first table, made with all others of the set."""
    rows = _seeded(spark, d, "fold", "lvl").withColumnRenamed("pooling", "model_id").withColumn("regime", F.col("stratum"))
    aps = metrics.average_precision_of_stored(rows.where("fold = 0"), ["model_id", "class", "seed"])
    tables = reports.report_set(rows, _drawn(spark, d), aps.groupBy("model_id").agg(F.avg("ap").alias("val_ap")), 3)
    return tables["overview"].select("model_id", "n_seeds", *map(r6, ("ap", "lo", "hi", "sd", "val_ap")), "selected")


# ---------------------------------------------------------------- calendar and audio hours

@query(f"""with {_NIGHTS}, w as (select *, min("column") over (partition by o_custkey, segment) as a, min(case when day(night) = 1 then "column" end) over (partition by o_custkey, segment) as m from c)
select o_custkey, segment, night, "column" from w where day(night) = 1 or ("column" = a and (m is null or m - a > 12))""")
def month_ticks(spark, d):
    return calendar.month_ticks(_night_columns(spark, d), ["o_custkey"])


@query(f"with {G.FILES}, n as (select distinct name, case when regexp_matches(name, '^(.+)_(\\d{{8}})_(\\d{{6}})\\.wav$') then try_strptime(regexp_extract(name, '_(\\d{{8}}_\\d{{6}})', 1), '%Y%m%d_%H%M%S') end as t from files) select date_trunc('hour', t)::timestamp as hour, count(*) as n_files, string_agg(name, ',' order by name) as names from n where t is not null group by 1")
def audio_hours(spark, d):
    """Names of recordings by hour; those that don't parse are left out."""
    names = G.files(spark, d).select("name").distinct().withColumn("p", S.name_parts(F.col("name"))).where("p.start is not null")
    hour = F.date_trunc("hour", "p.start").cast("timestamp_ntz")
    return names.groupBy(hour.alias("hour")).agg(F.count("*").alias("n_files"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
