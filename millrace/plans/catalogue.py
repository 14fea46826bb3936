"""Queries and their SQL over the driver's tables, one entry for each operator of the survey."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import scalar as S
from millrace.operators import bags as B
from millrace.operators import baselines, bootstrap, calendar, folds, ingest, lineage, merge, metrics, pooling, reports, runs
from millrace.session import cut, shared_dir
from millrace.sources import audio
from millrace.sources.tables import made_folder, table

from . import grounding as G
from .grounding import ap_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def r6(c: str):
    return F.round(c, 6).alias(c)


# ---------------------------------------------------------------- pooling

for _p in ("mean", "max", "lme", "linear_softmax"):

    @query(f"with {G.INSTANCES}, {G.POOLED} select bag_id, class, n, round({_p}, 6) as logit from pools", f"pool_{_p}")
    def _pool(spark, d, p=_p):
        return pooling.pool(G.instances(spark, d)).select("bag_id", "class", "n", F.round(p, 6).alias("logit"))


@query(f"""with {G.INSTANCES},
w as (select *, max(x) over b as top, count(*) over b as n, sum(1 / (1 + exp(-x))) over b as p1, row_number() over (b order by x desc, win_idx) as i from long window b as (partition by bag_id, class))
select bag_id, class, win_idx, round(1.0::double / n, 6) as w_mean, (i = 1)::int::double as w_max,
       round(exp(x - top) / sum(exp(x - top)) over (partition by bag_id, class), 6) as w_lme, round(1 / (1 + exp(-x)) / greatest(p1, 1e-6::double), 6) as w_linear_softmax from w""")
def pool_weights(spark, d):
    w = pooling.weights(G.instances(spark, d))
    return w.select("bag_id", "class", "win_idx", r6("w_mean"), "w_max", r6("w_lme"), r6("w_linear_softmax"))


@query(f"with {G.INSTANCES.replace('), long as', '), long0 as').replace('long as (select', 'all_long as (select')}, long as (select * from all_long where win_idx < 2), {G.POOLED} select bag_id, class, n, round(mean, 6) as mean, round(max, 6) as max, round(lme, 6) as lme, round(linear_softmax, 6) as linear_softmax from pools")
def pool_truncated(spark, d):
    return pooling.pool(pooling.truncated(G.instances(spark, d), 2)).select("bag_id", "class", "n", *map(r6, ("mean", "max", "lme", "linear_softmax")))


@query(f"""with {G.INSTANCES},
pre as (select a.bag_id, a.class, a.win_idx + 1 as n, b.x from long a join long b on a.bag_id = b.bag_id and a.class = b.class and b.win_idx <= a.win_idx),
agg as (select bag_id, class, n, avg(x) as mean, max(x) as max, ln(avg(exp(x))) as lme, sum(x * exp(x / 2)) / sum(exp(x / 2)) as attention,
  least(greatest(sum((1 / (1 + exp(-x))) ** 2) / greatest(sum(1 / (1 + exp(-x))), 1e-6::double), 1e-6::double), 1 - 1e-6::double) as q from pre group by bag_id, class, n)
select bag_id, class, n, round(mean, 6) as mean, round(max, 6) as max, round(lme, 6) as lme, round(ln(q) - ln(1 - q), 6) as linear_softmax, round(attention, 6) as attention from agg""")
def pool_prefixes(spark, d):
    """Every prefix of every bag, pooled in one pass."""
    rows = pooling.prefixes(G.instances(spark, d).withColumn("gate", F.col("x") / 2))
    return rows.select("bag_id", "class", "n", *map(r6, ("mean", "max", "lme", "linear_softmax", "attention")))


_GATE = {"v": [[((i * 7 + j) % 5 - 2) / 4 for j in range(64)] for i in range(3)], "b": [0.1, 0.0, -0.1], "u": [[((i + j * 3) % 7 - 3) / 5 for j in range(64)] for i in range(3)], "c": [0.0, 0.2, 0.1], "w": [1.0, -0.5, 0.7], "d": 0.05}


def _gate_sql() -> str:
    def linear(row, bias):
        return f"({bias}::double + list_sum(list_transform(list_zip(embedding, {row}::double[]), lambda p: p[1]::double * p[2]::double)))"

    def tanh(x):
        return f"(1 - 2 / (exp(2 * {x}) + 1))"

    return f"{_GATE['d']}::double + " + " + ".join(f"({w}::double) * {tanh(linear(v, b))} / (1 + exp(-{linear(u, c)}))" for v, b, u, c, w in zip(*(_GATE[k] for k in "vbucw"), strict=True))


@query(f"""with i as (select vec_id // 8 as bag_id, embedding[1]::double * 3 as x, {_gate_sql()} as gate from embeddings),
e as (select *, exp(gate - max(gate) over (partition by bag_id)) as e from i) select bag_id, round(sum(e * x) / sum(e), 6) as attention from e group by bag_id""")
def pool_attention_fixed(spark, d):
    rows = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("bag_id"), (F.col("embedding")[0].cast("double") * 3).alias("x"), pooling.gate("embedding", **_GATE).alias("gate"))
    return pooling.attention(rows, ("bag_id",)).select("bag_id", r6("attention"))


@query(f"with {G.INSTANCES}, {G.POOLED} select bag_id, class, round(1 / (1 + exp(-mean)), 6) as p1, round(1 / (1 + exp(-(mean - ln(1 + exp(0.55::double))))), 6) as p2, round(1 / (1 + exp(-(mean - ln(1 + exp(0.55::double)) - ln(1 + exp(0.3::double))))), 6) as p3 from pools")
def pool_ordinal(spark, d):
    pools = pooling.pool(G.instances(spark, d))
    return pools.select("bag_id", "class", *(F.round(S.sigmoid(x), 6).alias(f"p{k}") for k, x in enumerate(S.ordinal_logits(F.col("mean"), [0.55, 0.3]), 1)))


@query(f"""with g as (select distinct l_linenumber::int as k, round(l_discount * 100)::int as s from lineitem), long as (select k::bigint * 100 + s as bag_id, 0 as class, i::int as win_idx, case when i < k then s / 2.0::double else -4.0::double end as x
from g, range(12) v(i)), {G.POOLED} select bag_id, round(mean, 6) as mean, round(max, 6) as max, round(lme, 6) as lme, round(linear_softmax, 6) as linear_softmax from pools""")
def pool_response_curve(spark, d):
    """What poolers make of a bag of 12 windows with k calls of strength s, for the pairs that line items have."""
    pairs = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("int").alias("k"), F.round(F.col("l_discount") * 100).cast("int").alias("s")).distinct()
    windows = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(11))))
    toy = windows.select((F.col("k").cast("long") * 100 + F.col("s")).alias("bag_id"), F.lit(0).alias("class"), F.col("i").alias("win_idx"), F.when(F.col("i") < F.col("k"), F.col("s") / 2).otherwise(-4.0).alias("x"))
    return pooling.pool(toy).select("bag_id", *map(r6, ("mean", "max", "lme", "linear_softmax")))


# ---------------------------------------------------------------- metrics

_PC = "pooling, class"


@query(f"with {G.SCORED}, {ap_sql('scored', _PC)} select pooling, class, round(ap, 6) as ap from aps")
def flagship_ap(spark, d):
    return metrics.average_precision(G.scored(spark, d), ["pooling", "class"]).select("pooling", "class", r6("ap"))


@query(ORACLE_SQL["flagship_ap"])
def ap_bucketed(spark, d):
    return metrics.average_precision(G.scored(spark, d), ["pooling", "class"], parts=16).select("pooling", "class", r6("ap"))


@query(f"with {G.SCORED}, leveled as (select pooling, class, l.l::int as level, score, y from scored, range(1, 4) l(l) where lvl in (0, l.l)), {ap_sql('leveled', 'pooling, class, level')} select pooling, class, level, round(ap, 6) as ap from aps")
def ap_by_level(spark, d):
    rows = G.scored(spark, d).withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(3)))).where(F.col("lvl").isin(0) | (F.col("lvl") == F.col("level")))
    return metrics.average_precision(rows, ["pooling", "class", "level"]).select("pooling", "class", "level", r6("ap"))


@query(f"with {G.SCORED}, {ap_sql('scored', 'pooling, class, regime')} select pooling, class, regime, round(ap, 6) as ap from aps")
def ap_by_regime(spark, d):
    return metrics.average_precision(G.scored(spark, d), ["pooling", "class", "regime"]).select("pooling", "class", "regime", r6("ap"))


@query(f"with {G.SCORED}, {ap_sql('scored', 'pooling, class, block')} select pooling, block, round(avg(ap), 6) as macro_skip, round(case when count(ap) = 2 then avg(ap) end, 6) as macro_all from aps group by pooling, block")
def macro_ap(spark, d):
    aps = metrics.average_precision(G.scored(spark, d), ["pooling", "class", "block"])
    return metrics.macro(aps, ["pooling", "block"], 2).select("pooling", "block", r6("macro_skip"), r6("macro_all"))


#: FULL is what a report takes; _B is left to block_draws, ap_weighted_boot, paired_delta and overview_ci.
_B, FULL = 20, 2000


def _draws_sql(resamples: int) -> str:
    return f"""
clusters as (select distinct regime as stratum, block as cluster from bags),
members as (select *, row_number() over (partition by stratum order by cluster) - 1 as i, count(*) over (partition by stratum) as size from clusters),
picks as (
  select b::int as b, stratum, floor(('0x' || substr(md5('0:' || b || ':' || stratum || ':' || i), 1, 8))::bigint * size / 4294967296.0::double)::int as i, count(*) as count
  from members, range({resamples}) t(b) group by all),
drawn as (select b, stratum, cluster, count from picks join members using (stratum, i)),
met as (select pooling, class, b, score, y, count as w from scored join drawn on stratum = regime and cluster = block)"""


_DRAWN, _ALL_DRAWN = _draws_sql(_B), _draws_sql(FULL)


def _drawn(spark, d, resamples=_B):
    return bootstrap.draws(G.bags(spark, d).select(F.col("regime").alias("stratum"), F.col("block").alias("cluster")), resamples)


def _in_clusters(rows):
    return rows.withColumnsRenamed({"regime": "stratum", "block": "cluster"})


def _boots(spark, d, resamples=_B):
    return bootstrap.resampled_ap(_in_clusters(G.kept(spark, d, "regime", "block")), _drawn(spark, d, resamples), ["pooling", "class"])


def _points_and_boots(spark, d, resamples=_B):
    """Both of one move of the scores."""
    return bootstrap.point_and_resamples(_in_clusters(G.kept(spark, d, "regime", "block")), _drawn(spark, d, resamples), ["pooling", "class"])


@query(f"with {G.SCORED}, {_DRAWN} select b, stratum, cluster, count from drawn")
def block_draws(spark, d):
    return _drawn(spark, d)


_BOOTS, _ALL_BOOTS = (f"with {G.SCORED}, {drawn}, {ap_sql('met', 'pooling, class, b', 'w', 'boots')}" for drawn in (_DRAWN, _ALL_DRAWN))


@query(f"{_BOOTS} select pooling, class, b, round(ap, 6) as ap from boots")
def ap_weighted_boot(spark, d):
    return _boots(spark, d).select("pooling", "class", "b", r6("ap"))


@query(f"{_ALL_BOOTS} select pooling, class, round(quantile_cont(ap, 0.025), 6) as lo, round(quantile_cont(ap, 0.975), 6) as hi from boots group by pooling, class")
def ap_ci(spark, d):
    """Intervals of 2000 resamples."""
    return bootstrap.interval(_boots(spark, d, FULL), ["pooling", "class"]).select("pooling", "class", r6("lo"), r6("hi"))


@query(f"""{_BOOTS}, {ap_sql('scored', _PC, name='points')},
ds as (select m.pooling, m.class, m.ap - r.ap as d from boots m join boots r on r.pooling = 'mean' and m.class = r.class and m.b = r.b where m.pooling <> 'mean'),
ends as (select pooling, class, quantile_cont(d, 0.025) as lo, quantile_cont(d, 0.975) as hi from ds group by pooling, class)
select e.pooling, e.class, round(p.ap - r.ap, 6) as delta, round(lo, 6) as lo, round(hi, 6) as hi, case when lo > 0 then 'better' when hi < 0 then 'worse' else 'tied' end as verdict
from ends e join points p using (pooling, class) join points r on r.pooling = 'mean' and r.class = e.class""")
def paired_delta(spark, d):
    points, boots = _points_and_boots(spark, d)
    out = bootstrap.paired(boots, points, F.col("pooling") == "mean", "pooling", ["class"])
    return out.select("pooling", "class", r6("delta"), r6("lo"), r6("hi"), "verdict")


@query()
def ap_ci_full(spark, d):
    """The same as ap_ci, which took 20 resamples once."""
    return ap_ci(spark, d)


@query()
def paired_delta_full(spark, d):
    """Paired differences and verdicts of 2000 resamples."""
    points, boots = _points_and_boots(spark, d, FULL)
    out = bootstrap.paired(boots, points, F.col("pooling") == "mean", "pooling", ["class"])
    return out.select("pooling", "class", r6("delta"), r6("lo"), r6("hi"), "verdict")


_SEEDED = f"""with {G.SCORED}, {_ALL_DRAWN},
seeded as (select s.*, t.t::int as seed, score + t.t * 0.05::double * (bag_id % 7) as noisy from scored s, range(2) t(t)),
seeds as (select pooling, class, seed, regime, block, noisy as score, y from seeded),
met2 as (select pooling, class, seed, b, score, y, count as w from seeds join drawn on stratum = regime and cluster = block),
{ap_sql('met2', 'pooling, class, seed, b', 'w', 'seed_boots')}, {ap_sql('seeds', 'pooling, class, seed', name='seed_points')},
boots as (select pooling, class, b, avg(ap) as ap from seed_boots group by all), points as (select pooling, class, avg(ap) as ap from seed_points group by all)"""


def _seeded(spark, d, *keys):
    """Two seeds of every model, scores with an offset that differs by seed and bag; stored once, before a bag becomes rows by model and seed."""
    rows = G.kept(spark, d, "regime", "block", *keys, (F.col("bag_id") % 7).alias("_of"))
    rows = rows.withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1))))
    return _in_clusters(rows.withColumn("score", F.col("score") + F.col("seed") * 0.05 * F.col("_of")).drop("_of"))


@query(f"{_SEEDED}, ends as (select pooling, class, quantile_cont(ap, 0.025) as lo, quantile_cont(ap, 0.975) as hi from boots group by all) select pooling, class, round(p.ap, 6) as ap, round(lo, 6) as lo, round(hi, 6) as hi from points p join ends using (pooling, class)")
def seed_mean_ci(spark, d):
    """Point and interval of the mean over seeds, resample by resample."""
    points, boots = bootstrap.point_and_resamples(_seeded(spark, d), _drawn(spark, d, FULL), ["pooling", "class", "seed"])
    points, boots = bootstrap.seed_mean(points, ["pooling", "class"]), bootstrap.seed_mean(boots, ["pooling", "class", "b"])
    return points.join(bootstrap.interval(boots, ["pooling", "class"]), ["pooling", "class"]).select("pooling", "class", r6("ap"), r6("lo"), r6("hi"))


_VAL = f"""
val as (select s.*, ((fold + 4) % 5)::int as f from scored s),
val_g as (select {_PC}, f, round(score, 9) as score, sum(y)::double as tp, count(*)::double as n from val group by all),
val_r as (select *, sum(tp) over (partition by {_PC}, f order by score desc) / sum(n) over (partition by {_PC}, f order by score desc) as prec from val_g),
cuts as (select {_PC}, f as fold, min(case when prec >= 0.25 then score end) as cutoff from val_r group by {_PC}, f)"""


def _val_test(spark, d, *keys):
    """Scores with fold and ``keys`` for validation and test, pooled once; n is the weight."""
    rows = G.kept(spark, d, "fold", *keys).withColumn("n", F.lit(1.0))
    return rows.withColumn("fold", F.pmod(F.col("fold") - 1, F.lit(G.FOLDS))), rows


@query(f"with {G.SCORED}, {_VAL} select pooling, class, fold, round(cutoff, 6) as cutoff from cuts")
def val_cutoff(spark, d):
    return metrics.cutoff(_val_test(spark, d)[0], ["pooling", "class", "fold"], 0.25, F.col("n")).select("pooling", "class", "fold", r6("cutoff"))


@query(f"""with {G.SCORED}, {_VAL}, flags as (select s.*, coalesce(round(score, 9) >= cutoff, false)::int as flag from scored s join cuts using (pooling, class, fold))
select pooling, class, round(sum(flag * y) / nullif(sum(y), 0)::double, 6) as recall, round(sum(flag * y) / nullif(sum(flag), 0)::double, 6) as precision, any_value(none) as no_cutoff
from flags join (select pooling, class, count(*) filter (where cutoff is null) as none from cuts group by all) using (pooling, class) group by pooling, class""")
def recall_at_precision(spark, d):
    return metrics.recall_at_precision(*_val_test(spark, d), ["pooling", "class"], 0.25, weight=F.col("n")).select("pooling", "class", r6("recall"), r6("precision"), "no_cutoff")


@query("""with t as (select lang, n_chars::double as score, toxic as y from labels join documents using (doc_id)),
r as (select *, rank() over (partition by lang order by score) + (count(*) over (partition by lang, score) - 1) / 2.0::double as rk from t)
select lang, round((sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0::double) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) as auc from r group by lang""")
def auc(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("lang", F.col("n_chars").cast("double").alias("score"), F.col("toxic").alias("y"))
    return metrics.auc(rows, ["lang"]).select("lang", r6("auc"))


@query("""with t as (select lang, 1 / (1 + exp(-(n_chars - 1500) / 1000.0::double)) as score, quality as y from labels join documents using (doc_id))
select lang, round((avg(case when y = 0 then (score < 0.5)::int end) + avg(case when y = 1 then (score >= 0.5)::int end)) / 2, 6) as balanced_accuracy from t group by lang""")
def balanced_accuracy(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("lang", S.sigmoid((F.col("n_chars") - 1500) / 1000).alias("score"), F.col("quality").alias("y"))
    return metrics.balanced_accuracy(rows, ["lang"]).select("lang", r6("balanced_accuracy"))


@query(f"""with {G.INSTANCES}, {G.POOLED},
r as (select class, rank() over (partition by class order by mean) + (count(*) over (partition by class, mean) - 1) / 2.0::double as ra, rank() over (partition by class order by max) + (count(*) over (partition by class, max) - 1) / 2.0::double as rb
      from (select class, round(mean, 9) as mean, round(max, 9) as max from pools)) select class, round(corr(ra, rb), 6) as rho from r group by class""")
def spearman(spark, d):
    rows = pooling.pool(G.instances(spark, d)).select("class", F.round("mean", 9).alias("mean"), F.round("max", 9).alias("max"))
    return metrics.spearman(rows, "mean", "max", ["class"]).select("class", r6("rho"))


_CELLS = f"""with {G.BAGS}, t as (select bag_id, regime, 0 as class, idx0 as lvl from bags union all select bag_id, regime, 1, idx1 from bags),
cells as (
  select 'presence' as kind, class, null::int as level, null as cell_regime, (lvl > 0)::int as y from t
  union all select 'regime', class, null, regime, (lvl > 0)::int from t
  union all select 'level', class, l::int, null, (lvl > 0)::int from t, range(1, 4) r(l) where lvl in (0, l))"""


@query(f"{_CELLS} select kind, class, level, cell_regime, count(*) as n, sum(y)::bigint as n_pos from cells group by all")
def cell_counts(spark, d):
    cells = metrics.cells(G.bags(spark, d), ["idx0", "idx1"], 3)
    return cells.groupBy("kind", "class", "level", "cell_regime").agg(F.count("*").alias("n"), F.sum("y").alias("n_pos"))


@query(f"{_CELLS} select class, level, sum(y)::bigint as n, round(sum(y) / count(*)::double, 6) as chance from cells where kind = 'level' group by class, level having sum(y) >= 5")
def level_chance(spark, d):
    return reports.level_table(metrics.cells(G.bags(spark, d), ["idx0", "idx1"], 3)).select("class", "level", "n", r6("chance"))


@query(f"{_CELLS} select class, cell_regime as regime, count(*) as n_bags, sum(y)::bigint as n_pos, round(avg(y), 6) as prevalence from cells where kind = 'regime' group by class, cell_regime")
def regime_prevalence(spark, d):
    return reports.regime_table(metrics.cells(G.bags(spark, d), ["idx0", "idx1"], 3)).select("class", "regime", "n_bags", "n_pos", r6("prevalence"))


@query(f"with {G.SCORED} select pooling, class, regime, round(quantile_cont(score, 0.95), 6) as tail from scored where y = 0 group by pooling, class, regime")
def silent_tail(spark, d):
    rows = G.scored(spark, d).where("y = 0").groupBy("pooling", "class", "regime")
    return rows.agg(F.round(F.expr("percentile(score, 0.95D)"), 6).alias("tail"))


@query(f"""with {G.SCORED}, spread as (select bag_id, stddev_pop(score) as sd, any_value(lvl) as lvl from scored where class = 0 and lvl > 0 group by bag_id)
select bag_id, round(sd, 6) as sd from spread order by (lvl = 1) desc, round(sd, 9) desc, bag_id limit 1""")
def most_disagreeing(spark, d):
    rows = G.scored(spark, d).where("class = 0").select("bag_id", "score", F.col("lvl").alias("index"))
    return reports.most_disagreeing(rows).select("bag_id", r6("sd"))


# ---------------------------------------------------------------- bags

@query(f"with {G.CLIPS} select hour, n_clips, sample_rate, round(bag_duration_s, 2) as bag_duration_s, clip_frac_max, qc_ok from hours")
def bag_hours(spark, d):
    return B.hours(G.clips(spark, d)).select("hour", "n_clips", "sample_rate", F.round("bag_duration_s", 2).alias("bag_duration_s"), "clip_frac_max", "qc_ok")


@query(f"""with {G.CLIPS}, usual as (
  select sample_rate, year(hour) as year, n_clips, row_number() over (partition by sample_rate, year(hour) order by count(*) desc, min(hour), n_clips) as i from hours group by sample_rate, year(hour), n_clips)
select hour, case when h.sample_rate = 0 then 'mixed' else case h.sample_rate when 44100 then '44k' else (h.sample_rate // 1000)::varchar || 'k' end || '-' || u.n_clips || 'clip' end as regime
from hours h join usual u on h.sample_rate = u.sample_rate and year(h.hour) = u.year and u.i = 1""")
def regime_mode(spark, d):
    return B.regimes(B.hours(G.clips(spark, d))).select("hour", "regime")


_ANN = """ann as (select date_trunc('hour', ts)::timestamp as hour, event_id as line, (value > 50)::int as idx0, user_id % 4 as idx1 from events where event_type = 'purchase'),
labels_ as (select *, row_number() over (partition by hour order by line desc) as i from ann)"""


def _annotations(spark, d):
    e = table(spark, d, "events").where("event_type = 'purchase'")
    return e.select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), F.col("event_id").alias("line"), (F.col("value") > 50).cast("int").alias("idx0"), (F.col("user_id") % 4).alias("idx1"))


@query(f"with {G.CLIPS}, {_ANN} select hour, n_clips, idx0, idx1 from hours join labels_ using (hour) where qc_ok and i = 1")
def labelled_hours(spark, d):
    return B.labelled(B.hours(G.clips(spark, d)), _annotations(spark, d)).select("hour", "n_clips", "idx0", "idx1")


@query(f"with {G.CLIPS}, {_ANN} select hour, n_clips from hours where hour not in (select hour from ann)")
def hours_without_labels(spark, d):
    return B.hours(G.clips(spark, d)).join(_annotations(spark, d), "hour", "left_anti").select("hour", "n_clips")


@query(f"with {G.BAGS} select bag_id, block, fold from bags")
def day_blocks(spark, d):
    return G.bags(spark, d).select("bag_id", "block", "fold")


_STATS = f"""with {G.BAGS}, modes as (select block, regime, row_number() over (partition by block order by count(*) desc, min(ts), regime) as i from bags group by block, regime),
stats as (select b.block, count(*) as bags, sum((idx0 > 0)::int)::bigint as p0, sum((idx1 > 0)::int)::bigint as p1, any_value(m.regime) as regime from bags b join modes m on b.block = m.block and m.i = 1 group by b.block)"""


def _stats(spark, d):
    rows = G.bags(spark, d).withColumns({f"p{c}": (F.col(f"idx{c}") > 0).cast("int") for c in (0, 1)})
    return B.block_stats(rows, ["p0", "p1"], "ts").select("block", "bags", "p0", "p1", "regime")


@query(f"{_STATS} select * from stats")
def block_stats(spark, d):
    return _stats(spark, d)


@query(f"with {G.BAGS} select f::int as f, case when fold = f then 'test' when fold = (f + 1) % 5 then 'val' else 'train' end as role, count(*) as n, sum(idx0)::bigint as s from bags, range(5) t(f) group by all")
def fold_roles(spark, d):
    return B.fold_roles(G.bags(spark, d), G.FOLDS).groupBy("f", "role").agg(F.count("*").alias("n"), F.sum("idx0").alias("s"))


@query(f"""{_STATS}, long as (select block, r.r as part, m, v from (select block, regime, unnest(['bags', 'p0', 'p1']) as m, unnest([bags, p0, p1]) as v from stats), unnest([null, regime]) r(r)),
got as (select t::bigint as deal, part, m, f, coalesce(sum(v) filter (where (block * (t + 1) + t) % 5 = f), 0) as got, sum(v) as total from long, range(6) a(t), range(5) b(f) group by all)
select deal, round(sum(case when m = 'bags' then 1 else 5 end * case when part is null then 1 else 0.5::double end * abs(got / total::double - 0.2::double)), 6) as score from got where total > 0 group by deal""")
def fold_objective(spark, d):
    stats = _stats(spark, d)
    deals = stats.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("deal")).withColumn("fold", ((F.col("block") * (F.col("deal") + 1) + F.col("deal")) % 5).cast("int"))
    return folds.objective(stats, deals, ["bags", "p0", "p1"], G.FOLDS).select("deal", r6("score"))


_TRIES = 2000
_DRAW = "('0x' || substr(md5('0:' || deal || ':' || {0}), 1, 8))::bigint"


@query(f"""{_STATS}, rolled as (
  select deal::bigint as deal, block, regime, bags, p0, p1,
         ((row_number() over (partition by deal, regime order by {_DRAW.format('block')}, block) - 1 + {_DRAW.format("'first:' || regime")}) % 5)::int as fold
  from stats, range({_TRIES}) t(deal)),
sums as (select deal, regime, fold, sum(bags) as bags, sum(p0) as p0, sum(p1) as p1 from rolled group by all),
long as (select deal, fold, part, m, sum(v) as got from (select deal, fold, r.r as part, unnest(['bags', 'p0', 'p1']) as m, unnest([bags, p0, p1]) as v from sums, unnest([null, regime]) r(r)) group by all),
shares as (select *, sum(got) over w as total, count(*) over w as seen from long window w as (partition by deal, part, m)),
scores as (
  select deal, sum(case when m = 'bags' then 1 else 5 end * case when part is null then 1 else 0.5::double end * (abs(got / total::double - 0.2::double) + (5 - seen) * 0.2::double / seen)) as score
  from shares where total > 0 group by deal)
select block, fold from rolled where deal = (select deal from scores order by round(score, 9), deal limit 1)""")
def fold_deal(spark, d):
    """The best of all deals, before the polish."""
    return folds.best_deal(_stats(spark, d), ["bags", "p0", "p1"], G.FOLDS, _TRIES)


@query()
def fold_search(spark, d):
    """Deals and polish over the three-day blocks that the bags use."""
    return folds.assign(_stats(spark, d), ["bags", "p0", "p1"], G.FOLDS, _TRIES)


@query("""with d as (select doc_id, n_chars::bigint as ms from documents), n as (select *, ms // 5000 + ((ms % 5000) * 2 >= 5000)::int as n from d)
select doc_id, i::int as win_idx, i * 5000 / 1000.0::double as start_s, least((i + 1) * 5000, ms) / 1000.0::double as end_s from n, range(n.n) t(i)""")
def windows_expand(spark, d):
    clips = table(spark, d, "documents").select("doc_id", (F.col("n_chars") / 1000).alias("duration_s"))
    return B.expand_windows(clips).select("doc_id", "win_idx", "start_s", "end_s")


@query("""select event_id, 'site_' || strftime(ts, '%Y%m%d_%H') || '_' || strftime(ts, '%H%M%S') || '_' || printf('%07.2f', (event_id % 12) * 5.0::double) as instance_id,
minute(ts) * 60 + second(ts) as offset_in_hour_s from events""")
def instance_id(spark, d):
    e = table(spark, d, "events")
    ids = B.instance_ids(F.concat(F.lit("site_"), F.date_format("ts", "yyyyMMdd_HH")), F.col("ts"), (F.col("event_id") % 12) * F.lit(5.0))
    return e.select("event_id", ids.alias("instance_id"), (F.minute("ts").cast("long") * 60 + F.second("ts")).alias("offset_in_hour_s"))


@query(f"with {G.FILES} select doc_id, regexp_matches(name, '^(.+)_(\\d{{8}})_(\\d{{6}})\\.wav$') as parsed, lower(name) like '%.wav' as wav, case when regexp_matches(name, '\\.wav$') then try_strptime(regexp_extract(name, '_(\\d{{8}}_\\d{{6}})', 1), '%Y%m%d_%H%M%S') end as start from files")
def parse_names(spark, d):
    f = G.files(spark, d).withColumn("p", S.name_parts(F.col("name")))
    return f.select("doc_id", F.col("p").isNotNull().alias("parsed"), S.is_wav(F.col("name")).alias("wav"), "p.start")


@query("""with p as (select o_orderkey // 1024 as piece, sha256(string_agg(o_orderkey::varchar, chr(10) order by o_orderkey)) as digest from orders group by 1)
select substr(sha256(string_agg(digest, chr(10) order by piece)), 1, 12) as hash from p""")
def dataset_hash(spark, d):
    return B.dataset_hash(table(spark, d, "orders"), "o_orderkey", "o_orderkey")


@query("""with p as (select label, generate_subscripts(embedding, 1) - 1 as dim, unnest(embedding)::double as v from embeddings)
select label, dim::int as dim, round(avg(v), 6) as mean, round(stddev_samp(v) + 1e-6::double, 6) as sd from p group by label, dim""")
def standardise(spark, d):
    return B.standardise_stats(table(spark, d, "embeddings"), ["label"], "embedding").select("label", "dim", r6("mean"), r6("sd"))


@query(f"with {G.BAGS} select fold, l::int as level, count(*) filter (where idx0 >= l) as n_pos, round(count(*) filter (where idx0 < l) / greatest(count(*) filter (where idx0 >= l), 1)::double, 6) as pos_weight from bags, range(1, 4) t(l) group by fold, l")
def cum_pos_weight(spark, d):
    return B.positive_weights(G.bags(spark, d), ["fold"], "idx0", 3).select("fold", "level", "n_pos", r6("pos_weight"))


@query(f"with {G.BAGS}, r as (select f, count(*) filter (where idx1 > 0) as p, count(*) as n from bags, range(5) t(f) where fold <> f and fold <> (f + 1) % 5 group by f) select f::int as f, p as n_pos, round((n - p) / greatest(p, 1)::double, 6) as pos_weight from r")
def pos_weight(spark, d):
    train = B.fold_roles(G.bags(spark, d), G.FOLDS).where("role = 'train'")
    return B.positive_weights(train, ["f"], "idx1", 1).select("f", "n_pos", r6("pos_weight"))


# ---------------------------------------------------------------- baselines

@query(f"""with {G.BAGS}, t as (select bag_id, fold, (idx0 > 0)::int as y, dayofweek(ts) as wd, month(ts) as mo from bags),
own as (select f, wd, mo, avg(y) as rate from t, range(5) r(f) where fold <> f group by all), prior as (select f, avg(y) as rate from t, range(5) r(f) where fold <> f group by all)
select bag_id, fold, y, round(coalesce(o.rate, p.rate), 6) as score from t join prior p on p.f = fold left join own o on o.f = fold and o.wd = t.wd and o.mo = t.mo""")
def clock_baseline(spark, d):
    rows = G.bags(spark, d).withColumns({"p": (F.col("idx0") > 0).cast("int"), "wd": F.dayofweek("ts"), "mo": F.month("ts")})
    return baselines.clock(rows, "p", ["wd", "mo"]).select("bag_id", "fold", "y", r6("score"))


@query("select vec_id // 8 as bag_id, round(max(greatest(embedding[1], embedding[4], embedding[10])::double), 6) as score from embeddings group by 1")
def zero_shot_max(spark, d):
    return baselines.zero_shot(table(spark, d, "embeddings"), F.floor(F.col("vec_id") / 8), "embedding", [0, 3, 9]).select("bag_id", r6("score"))


# ---------------------------------------------------------------- label statistics

@query(f"with {G.BAGS} select year(ts) as year, count(*) filter (where idx0 = 0) as l0, count(*) filter (where idx0 = 1) as l1, count(*) filter (where idx0 = 2) as l2, count(*) filter (where idx0 = 3) as l3, round(avg((idx0 > 0)::int), 6) as positive from bags group by 1")
def year_levels(spark, d):
    rows = G.bags(spark, d).groupBy(F.year("ts").cast("long").alias("year"))
    return rows.agg(*(F.count_if(F.col("idx0") == k).alias(f"l{k}") for k in range(4)), F.round(F.avg((F.col("idx0") > 0).cast("int")), 6).alias("positive"))


@query(f"with {G.BAGS} select m as month, count(bag_id) as n from range(1, 13) t(m) left join bags on month(ts) = m and idx0 = 3 group by m")
def month_hist(spark, d):
    counts = G.bags(spark, d).where("idx0 = 3").groupBy(F.month("ts").alias("m")).agg(F.count("*").alias("n"))
    return spark.range(1, 13).join(counts, F.col("id") == F.col("m"), "left").select(F.col("id").alias("month"), F.coalesce("n", F.lit(0)).alias("n"))


@query("select h as hour, count(event_id) as n from range(24) t(h) left join events on hour(ts) = h and event_type = 'purchase' group by h")
def hour_hist(spark, d):
    counts = table(spark, d, "events").where("event_type = 'purchase'").groupBy(F.hour("ts").alias("h")).agg(F.count("*").alias("n"))
    return spark.range(24).join(counts, F.col("id") == F.col("h"), "left").select(F.col("id").alias("hour"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"with {G.BAGS} select regime, count(*) filter (where idx0 > 0 and idx1 > 0) as both, count(*) filter (where idx0 > 0) as a, count(*) filter (where idx1 > 0) as b from bags group by regime")
def co_occurrence(spark, d):
    a, b = F.col("idx0") > 0, F.col("idx1") > 0
    return G.bags(spark, d).groupBy("regime").agg(F.count_if(a & b).alias("both"), F.count_if(a).alias("a"), F.count_if(b).alias("b"))


@query(f"with {G.CLIPS} select n_clips as clips, count(*) as hours, min(hour) as first, max(hour) as last, sum(n_clips)::bigint as files from hours group by n_clips")
def coverage(spark, d):
    h = B.hours(G.clips(spark, d)).groupBy(F.col("n_clips").alias("clips"))
    return h.agg(F.count("*").alias("hours"), F.min("hour").alias("first"), F.max("hour").alias("last"), F.sum("n_clips").alias("files"))


@query(f"with {G.BAGS} select year(ts) as year, min(ts) filter (where idx0 > 0) as first_0, min(ts) filter (where idx1 > 0) as first_1 from bags group by 1")
def first_positive(spark, d):
    rows = G.bags(spark, d).groupBy(F.year("ts").cast("long").alias("year"))
    return rows.agg(*(F.min(F.when(F.col(f"idx{c}") > 0, F.col("ts"))).alias(f"first_{c}") for c in (0, 1)))


@query(f"with {G.BAGS} select fold, regime, grouping_id(fold, regime)::bigint as level, count(*) as n, sum((idx0 > 0)::int)::bigint as p0 from bags group by grouping sets ((fold, regime), (fold), ())")
def fold_regime_counts(spark, d):
    rows = G.bags(spark, d).groupingSets([["fold", "regime"], ["fold"], []], "fold", "regime")
    return rows.agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum((F.col("idx0") > 0).cast("int")).alias("p0"))


# ---------------------------------------------------------------- ingest

def _compared(spark, d):
    f = G.files(spark, d)
    return f, ingest.diff(f.select("hash", "size", "path"), f.where("doc_id % 3 = 0").select("name", "hash"), f.where("doc_id % 11 = 1").select("hash"))


@query(f"with {G.FILES} select hash, path, size, name, category from compared")
def ingest_diff(spark, d):
    return _compared(spark, d)[1]


@query(f"""with {G.FILES}, r as (select hash, path, size, name, row_number() over (partition by hash order by regexp_matches(split_part(path, '/', 1), '^\\d+-.* - '), length(path) - length(replace(path, '/', '')), path, size) as i from files where hash is not null)
select hash, path, size, name from r where i = 1""")
def choose_copy(spark, d):
    return ingest.choose_copy(G.files(spark, d).where("hash is not null")).select("hash", "path", "size", "name")


@query(f"""with {G.FILES}, c as (select w.hash, path, w.size, w.name, row_number() over (partition by w.hash order by regexp_matches(split_part(path, '/', 1), '^\\d+-.* - '), length(path) - length(replace(path, '/', '')), path) as i
from wavs w where w.hash in (select hash from compared where category in ('new', 'clash_local')) and contains(regexp_extract(path, '^(.*)/[^/]*$', 1), 'src1')) select hash, path, size, name from c where i = 1""")
def select_for_pull(spark, d):
    f, compared = _compared(spark, d)
    return ingest.select_for_pull(f.select("hash", "size", "path"), compared, "src1", include_clashes=True).select("hash", "path", "size", "name")


@query(f"with {G.FILES} select name, count(*) as copies from chosen group by name having count(*) > 1")
def name_clashes(spark, d):
    compared = _compared(spark, d)[1].where("category not in ('nohash', 'local', 'replaced')")
    return compared.groupBy("name").agg(F.count("*").alias("copies")).where("copies > 1")


@query(f"with {G.FILES}, f as (select distinct doc_id, doc_id::varchar as name, size, doc_id % 7 as mtime_ns from files) select name, size, mtime_ns from f where not (doc_id % 4 = 0 or (doc_id % 4 = 1 and doc_id % 7 = 3))")
def stale_files(spark, d):
    f = G.files(spark, d).select(F.col("doc_id").cast("string").alias("name"), "size", (F.col("doc_id") % 7).alias("mtime_ns"), "hash", "doc_id")
    cache = f.where("doc_id % 4 < 2").withColumn("mtime_ns", F.when(F.col("doc_id") % 4 == 1, 3).otherwise(F.col("mtime_ns")).cast("long"))
    return ingest.stale(cache, f)


@query(f"with {G.FILES} select distinct name, case when name in (select name from local) then 'clash' else 'new' end as action from files")
def plan_merge(spark, d):
    f = G.files(spark, d)
    return ingest.plan_merge(f, f.where("doc_id % 3 = 0"))


@query("""with e as (select doc_id, doc_id || (case when doc_id % 31 = 0 then '.txt' else '_20240101_000000.wav' end) as name, sha256(text) as hash, n_chars as size from documents where doc_id % 5 <> 4),
f as (select doc_id, doc_id || (case when doc_id % 31 = 0 then '.txt' else '_20240101_000000.wav' end) as name, case when doc_id % 13 = 0 then 'x' else sha256(text) end as hash, n_chars + (doc_id % 17 = 0)::int as size, doc_id % 19 <> 0 as ok from documents where doc_id % 5 <> 3),
j as (select coalesce(e.name, f.name) as name, concat_ws('; ', case when f.name is null then 'missing' end, case when e.hash is not null and f.name is not null and e.hash <> f.hash then 'hash mismatch' end,
 case when e.size <> f.size then 'size mismatch' end, case when e.name is not null and e.name like '%.txt' then 'bad name' end, case when e.name is not null and f.name is not null and not f.ok then 'qc: digital zero' end,
 case when e.name is null and f.name like '%.wav' then 'unexpected' end) as fail from e full join f on e.name = f.name) select name, fail = '' as ok, fail from j""")
def verify_report(spark, d):
    docs, i = table(spark, d, "documents"), F.col("doc_id")
    base = docs.select("doc_id", F.concat(i.cast("string"), F.when(i % 31 == 0, ".txt").otherwise("_20240101_000000.wav")).alias("name"), F.sha2("text", 256).alias("hash"), F.col("n_chars").alias("size"))
    found = base.where("doc_id % 5 <> 3").select("name", F.when(i % 13 == 0, "x").otherwise(F.col("hash")).alias("hash"), (F.col("size") + (i % 17 == 0).cast("int")).alias("size"), (i % 19 != 0).alias("qc_ok"), F.lit("digital zero").alias("qc_reason"))
    return ingest.verify(base.where("doc_id % 5 <> 4"), found)


_MERGE = """
b as (select doc_id, source, doc_id || '_20240101_000000' || (case when doc_id % 31 = 0 then '.txt' else '.wav' end) as name, doc_id || '_20240101_000000' as stem, n_chars as size from documents),
r as (select doc_id, source, name, doc_id % 19 <> 0 as ok from b where doc_id % 5 <> 4 and doc_id % 31 <> 0),
s as (select doc_id, name, size, doc_id % 23 as changed from b where doc_id % 37 <> 3), l as (select doc_id, name, size + 1 as size from b where doc_id % 7 = 0), a as (select doc_id from b where doc_id % 49 = 0)"""


def _merge(spark, d):
    """report, staged, library, aside of documents as files."""
    i, stem = F.col("doc_id"), F.concat(F.col("doc_id").cast("string"), F.lit("_20240101_000000"))
    b = table(spark, d, "documents").select("doc_id", "source", F.concat(stem, F.when(i % 31 == 0, ".txt").otherwise(".wav")).alias("name"), stem.alias("stem"), F.col("n_chars").alias("size"))
    report = b.where("doc_id % 5 <> 4 and doc_id % 31 <> 0").select("source", "name", (i % 19 != 0).alias("ok"), F.when(i % 19 == 0, "qc: digital zero").otherwise("").alias("fail"))
    staged = b.where("doc_id % 37 <> 3").select("name", "size", (i % 23).alias("changed_at"))
    return report, staged, b.where("doc_id % 7 = 0").select("name", (F.col("size") + 1).alias("size")), b.where("doc_id % 49 = 0").select(F.concat("stem", F.lit(".replaced_d.wav")).alias("name"))


@query(f"""with {_MERGE},
j as (select coalesce(r.name, s.name) as name, r.name is not null as reported, r.ok, s.name is not null as there, s.changed, l.name is not null as here, a.doc_id is not null as taken
  from r full join s on r.name = s.name left join l on l.name = coalesce(r.name, s.name) left join a on a.doc_id = coalesce(r.doc_id, s.doc_id)),
k as (select replaced, name, case when reported and not ok then 'failed: qc: digital zero' when reported and not there then 'gone since verification' when not reported and name like '%.wav' then 'not verified'
  when there and changed >= 20 then 'changed since verification' when reported and here and not replaced then 'would replace another file' when reported and here and taken then 'place of the old copy is taken' end as reason from j, (values (true), (false)) v(replaced))
select * from k where reason is not null""")
def merge_recheck(spark, d):
    """Why staged files may not be merged, with and without replacing."""
    out = [merge.recheck(*_merge(spark, d), F.lit(20), "d", replace=r).withColumn("replaced", F.lit(r)) for r in (True, False)]
    return out[0].unionByName(out[1])


_MOVES = f"""{_MERGE},
m as (select 0 as step, r.source as batch, l.name, '/library/' || l.name as source, '/aside/' || l.doc_id || '_20240101_000000.replaced_d.wav' as target, l.size from l join r on l.name = r.name
  union all select 1, r.source, s.name, '/staging/' || s.name, '/library/' || s.name, s.size from s join r on s.name = r.name)"""


def _moves(spark, d):
    report, staged, library, _ = _merge(spark, d)
    return report, merge.moves(report, staged, library, merge.Roots("/staging", "/library", "/aside"), "d")


@query(f"with {_MOVES} select step, name, source, target, size from m")
def merge_moves(spark, d):
    return _moves(spark, d)[1]


@query(f"""with {_MOVES}, n as (select batch, count(*) filter (where step = 1) as n, count(*) filter (where step = 0) as k from m group by batch), w as (select source as batch, count(*) as w from r group by 1)
select batch, null::varchar as name, '2024-01-02' || ' moved ' || n || ' wavs (' || w || ' verified) from /staging to /library (' || case when k = 0 then 'no name collisions' when k = 1 then '1 name collision replaced' else k || ' name collisions replaced' end
  || '; all verified); left behind ' || (w - n) || '; library now ' || w || ' files' as line from n join w using (batch)
union all select batch, name, name || ' REPLACED: old copy moved to ' || target from m where step = 0""")
def merge_log(spark, d):
    """Log lines of merges, a batch for each source."""
    report, moved = _moves(spark, d)
    of = report.select(F.col("source").alias("batch"), "name")
    moved = moved.join(of, "name")
    w = of.groupBy("batch").agg(F.count("*").alias("w")).join(moved.groupBy("batch").agg(F.count_if(F.col("step") == merge.PUBLISH).alias("n")), "batch")
    text = w.select("batch", F.lit("2024-01-02").alias("at"), F.concat(F.col("w").cast("string"), F.lit(" verified")).alias("text"), F.lit("/staging").alias("source"), F.lit("/library").alias("library"), (F.col("w") - F.col("n")).alias("left"), F.col("w").alias("after"))
    return merge.log_entries(moved, text, ["batch"])


@query("""with w as (select doc_id as id, doc_id::varchar as instance_id, sha256(text) as s from documents where doc_id % 6 <> 5), c as (select doc_id::varchar as instance_id, case when doc_id % 8 = 0 then null when doc_id % 9 = 0 then 'old' else sha256(text) end as s, doc_id % 10 <> 0 as done from documents where doc_id % 6 <> 4)
select coalesce(w.instance_id, c.instance_id) as instance_id, case when w.instance_id is null then 'dropped' when not coalesce(c.done, false) then 'pending' when c.s is null or c.s = w.s then 'keep' else 'changed' end as status from w full join c on w.instance_id = c.instance_id""")
def rekey_status(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("instance_id"), F.sha2("text", 256).alias("file_sig"))
    sig = F.when(F.col("doc_id") % 8 == 0, None).when(F.col("doc_id") % 9 == 0, "old").otherwise(F.col("file_sig"))
    cached = rows.where("doc_id % 6 <> 4").select("instance_id", sig.alias("file_sig"), (F.col("doc_id") % 10 != 0).alias("done"))
    return ingest.rekey(rows.where("doc_id % 6 <> 5"), cached)


_RUNS = "with g as (select {k}, {t} as t, case when {t} - lag({t}) over (partition by {k} order by {t}) <= interval '{gap}' then 0 else 1 end as fresh from {src}), r as (select *, sum(fresh) over (partition by {k} order by t rows unbounded preceding) as run from g) select {k}, min(t) as first, max(t) as last, count(*) as n from r group by {k}, run"


@query(_RUNS.format(k="user_id", t="ts", gap="48 hours", src="events"))
def date_runs_48h(spark, d):
    return ingest.runs(table(spark, d, "events"), "ts", "48 hours", ["user_id"])


@query(_RUNS.format(k="o_custkey", t="o_orderdate", gap="7 days", src="orders"))
def night_segments(spark, d):
    return ingest.runs(table(spark, d, "orders"), "o_orderdate", "7 days", ["o_custkey"])


_MARKS = "with t as (select {0} as start from events), m as (select distinct strftime(start, '%M:%S') as m from t) select min(n) as fewest, max(n) as most, (select case when count(*) <= 6 then string_agg(m, ' ' order by m) end from m) as offsets from (select date_trunc('hour', start) as h, count(*) as n from t group by 1)"


@query(_MARKS.format("ts"))
def clips_per_hour(spark, d):
    return ingest.clips_per_hour(table(spark, d, "events").select(F.col("ts").alias("start")))


@query(_MARKS.format("date_trunc('hour', ts) + to_minutes((event_id % 4 * 15)::int)"))
def clip_offsets(spark, d):
    """Recordings that begin at four marks of the hour."""
    start = F.date_trunc("hour", "ts").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("event_id") % 4 * 15).cast("int"))
    return ingest.clips_per_hour(table(spark, d, "events").select(start.alias("start")))


@query(f"with {G.FILES} select category, count(*) as files, round(sum(size) / 1e6::double, 6) as mb, min(name) as first, max(name) as last from compared group by category")
def summarise_batch(spark, d):
    rows = _compared(spark, d)[1].groupBy("category")
    return rows.agg(F.count("*").alias("files"), F.round(F.sum("size") / 1e6, 6).alias("mb"), F.min("name").alias("first"), F.max("name").alias("last"))


# ---------------------------------------------------------------- nights and neighbours

@query("select cast(ts - interval 12 hours as date) as night, ((hour(ts) + 12) % 24)::int as slot, count(*) as n, count(*) filter (where event_type = 'purchase') as pos from events group by all")
def night_grid(spark, d):
    slot = F.pmod(F.hour("ts") + 12, F.lit(24)).cast("int")
    return table(spark, d, "events").groupBy(S.night(F.col("ts")).alias("night"), slot.alias("slot")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("pos"))


_NIGHTS = """n as (select distinct o_custkey, cast(o_orderdate - interval 12 hours as date) as night from orders),
j as (select *, date_diff('day', lag(night) over (partition by o_custkey order by night), night) as step from n),
c as (select o_custkey, night, sum((coalesce(step, 0) > 90)::int) over (partition by o_custkey order by night)::int as segment,
             sum(case when step > 90 then 4 else coalesce(step, 0) end) over (partition by o_custkey order by night)::int as "column" from j)"""


def _night_columns(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", S.night(F.col("o_orderdate")).alias("night"))
    return calendar.night_columns(rows, "night", ["o_custkey"], gap_days=90)


@query(f"with {_NIGHTS} select * from c")
def night_columns(spark, d):
    return _night_columns(spark, d)


@query(f"with {_NIGHTS}, e as (select o_custkey, segment, min(night) as a, max(night) as b from c group by all), l as (select *, lag(b) over (partition by o_custkey order by segment) as p from e) select o_custkey, segment, p + 1 as first_missing, a - 1 as last_missing from l where p is not null")
def night_breaks(spark, d):
    return calendar.breaks(_night_columns(spark, d), ["o_custkey"])


@query(f"with {G.BAGS} select cast(ts - interval 12 hours as date) as night, arg_min(fold, bag_id) as fold, arg_min(regime, bag_id) as regime from bags group by 1")
def first_of_night(spark, d):
    return calendar.first_of_night(G.bags(spark, d), S.night(F.col("ts")), "bag_id", "fold", "regime")


@query("""with f as (select event_type, ts, event_id % 900 as size, case when day(ts) <= 10 then '8' else '44.1' end || ' kHz ' || case event_id % 3 when 1 then 'mono' when 2 then 'stereo' else '3 ch' end || ' 60 s' as f from events),
h as (select event_type, min(n) as lo, max(n) as hi from (select event_type, date_trunc('hour', ts), count(*) as n from f group by all) group by 1),
g as (select event_type, string_agg(f || ' (' || n || ')', ' + ' order by n desc, f) as fs from (select event_type, f, count(*) as n from f group by all) group by 1)
select event_type, count(*) as files, round(sum(size) / 1e9::double, 9) as gb, strftime(min(ts), '%Y-%m-%d %H:%M') || ' -> ' || strftime(max(ts), '%Y-%m-%d %H:%M') || ', ' || any_value(case when lo = hi then lo::varchar else lo || '-' || hi end) || ' clips/hour, ' || any_value(fs) as text
from f join h using (event_type) join g using (event_type) group by event_type""")
def describe_batch(spark, d):
    files = table(spark, d, "events").select("event_type", F.col("ts").alias("start"), (F.col("event_id") % 900).alias("size"), F.when(F.dayofmonth("ts") <= 10, 8000).otherwise(44100).alias("rate"), F.when(F.col("event_id") % 3 == 0, 3).otherwise(F.col("event_id") % 3).cast("int").alias("channels"), F.lit(60.0).alias("seconds"))
    return calendar.describe(files, ["event_type"]).select("event_type", "files", F.round("gb", 9).alias("gb"), "text")


_POS = "h as (select date_trunc('hour', ts)::timestamp as hour, max((event_type = 'purchase' and value > 90)::int) as pos from events group by 1)"


def _hour_pos(spark, d):
    pos = ((F.col("event_type") == "purchase") & (F.col("value") > 90)).cast("int")
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.max(pos).alias("pos"))


@query(f"with {_POS} select hour, max(pos) over (partition by cast(hour - interval 12 hours as date)) as any_pos from h")
def same_night(spark, d):
    rows = _hour_pos(spark, d).withColumn("night", S.night(F.col("hour")))
    return rows.select("hour", F.max("pos").over(Window.partitionBy("night")).alias("any_pos"))


@query(f"with {_POS} select h.hour, greatest(coalesce(a.pos, 0), coalesce(b.pos, 0)) as near_pos from h left join h a on a.hour = h.hour - interval 1 hour left join h b on b.hour = h.hour + interval 1 hour")
def near_hour(spark, d):
    rows = _hour_pos(spark, d)
    # each hour is sent to its two neighbours: one shuffle by hour, no self-join twice over
    sent = rows.select(F.explode(F.array(*(F.struct((F.col("hour") + F.expr(f"interval {s} hour")).alias("hour"), F.col("pos").alias("near"), F.lit(None).cast("int").alias("own")) for s in (-1, 1)))).alias("s")).select("s.*")
    both = sent.unionByName(rows.select("hour", F.lit(None).cast("int").alias("near"), F.lit(1).alias("own")))
    return both.groupBy("hour").agg(F.max("own").alias("own"), F.coalesce(F.max("near"), F.lit(0)).alias("near_pos")).where("own = 1").drop("own")


@query(f"with {G.SCORED}, t as (select *, row_number() over (order by round(score, 9) desc, bag_id) as i, count(*) over () as n from scored where pooling = 'lme' and class = 0) select regime, count(*) as n_top, round(avg(y), 6) as positive from t where i <= ceil(0.05::double * n) group by regime")
def top_share(spark, d):
    rows = G.scored(spark, d).where("pooling = 'lme' and class = 0").select("bag_id", "regime", "y", F.round("score", 9).alias("score"))
    top = reports.top_share(rows, "score", 0.05, "bag_id").where("top")
    return top.groupBy("regime").agg(F.count("*").alias("n_top"), F.round(F.avg("y"), 6).alias("positive"))


@query(f"with {G.SCORED}, t as (select pooling, bag_id, row_number() over (partition by pooling order by round(score, 9) desc, bag_id) as i from scored where class = 1), k as (select * from t where i <= 200) select a.pooling as a, b.pooling as b, count(*) / 200.0::double as overlap from k a join k b on a.bag_id = b.bag_id and a.pooling < b.pooling group by all")
def topk_overlap(spark, d):
    rows = G.scored(spark, d).where("class = 1").select("pooling", "bag_id", F.round("score", 9).alias("score"))
    best = Window.partitionBy("pooling").orderBy(F.desc("score"), "bag_id")
    top = rows.withColumn("i", F.row_number().over(best)).where("i <= 200").groupBy("bag_id").agg(F.sort_array(F.collect_set("pooling")).alias("p"))
    pairs = top.select(F.explode("p").alias("a"), "p").select("a", F.explode("p").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg((F.count("*") / 200).alias("overlap"))


# ---------------------------------------------------------------- runs and reports

#: Orders as runs of models: settings from status, key and customer, who is the dataset.
_RUNS = """runs as (select o_orderkey::varchar as model_id, case when o_orderstatus = 'F' then 0 else 256 end as hidden, (o_orderkey % 3) * 0.25::double as ordinal_weight,
  ['mean', 'lme', 'max'][o_custkey % 3 + 1] as pooling, case when o_orderkey % 5 <> 0 then true end as flag, o_custkey as dataset from orders)"""


def _runs(spark, d):
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(
        key.cast("string").alias("model_id"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(256).alias("hidden"), ((key % 3) * F.lit(0.25)).alias("ordinal_weight"),
        F.element_at(F.array(*map(F.lit, ("mean", "lme", "max"))), (customer % 3 + 1).cast("int")).alias("pooling"), F.when(key % 5 != 0, True).alias("flag"), customer.alias("dataset"),
    )


@query(f"""with {_RUNS}
select a.model_id as model_a, b.model_id as model_b, a.pooling from runs a join runs b on a.pooling = b.pooling and a.hidden = b.hidden and a.flag is not distinct from b.flag and a.dataset = b.dataset and a.ordinal_weight = 0 and b.ordinal_weight <> 0""")
def controlled_pairs(spark, d):
    return reports.controlled_pairs(_runs(spark, d), "ordinal_weight", ["hidden", "ordinal_weight"], ["dataset", "flag"])


@query(f"""with {_RUNS}, a as (select dataset, max_by(hidden, model_id)::varchar as hidden, max_by(ordinal_weight, model_id) as w, max_by(coalesce(flag, false), model_id) as flag from runs group by dataset),
b as (select dataset, min_by(hidden, model_id)::varchar as hidden, min_by(ordinal_weight, model_id) as w, min_by(coalesce(flag, false), model_id) as flag from runs group by dataset)
select dataset, 'hidden' as field, a.hidden as stored, b.hidden as wanted from a join b using (dataset) where a.hidden is distinct from b.hidden
union all select dataset, 'ordinal_weight', a.w::varchar, b.w::varchar from a join b using (dataset) where a.w is distinct from b.w
union all select dataset, 'flag', a.flag::varchar, b.flag::varchar from a join b using (dataset) where a.flag is distinct from b.flag""")
def config_diff(spark, d):
    r = _runs(spark, d).withColumn("flag", F.coalesce("flag", F.lit(False)))
    pick = lambda f: r.groupBy("dataset").agg(*(f(c, "model_id").alias(c) for c in ("hidden", "ordinal_weight", "flag")))
    return reports.config_diff(pick(F.max_by), pick(F.min_by), "dataset", ["hidden", "ordinal_weight", "flag"])


@query(f"""with {_RUNS}
select model_id, case when hidden > 0 then 'mlp' || hidden else 'linear' end || '-' || case ordinal_weight when 0 then 'bin' when 0.25 then 'ord0.25' else 'ord0.5' end as run_id,
case when hidden > 0 then 'MLP-' || hidden else 'linear' end as probe, case ordinal_weight when 0 then 'binary' when 0.25 then 'ordinal (w=0.25)' else 'ordinal (w=0.5)' end as target from runs""")
def run_labels(spark, d):
    return reports.run_labels(_runs(spark, d)).select("model_id", "run_id", "probe", "target")


@query(f"""{_ALL_BOOTS}, {ap_sql('scored', _PC, name='points')}, pairs(model_a, model_b) as (values ('mean', 'lme'), ('max', 'lme'), ('mean', 'linear_softmax')),
ds as (select model_a, model_b, a.class, b.ap - a.ap as d from pairs join boots a on a.pooling = model_a join boots b on b.pooling = model_b and a.class = b.class and a.b = b.b)
select model_a, model_b, class, round(any_value(q.ap - p.ap), 6) as delta, round(quantile_cont(d, 0.025), 6) as lo, round(quantile_cont(d, 0.975), 6) as hi
from ds join points p on p.pooling = model_a and p.class = ds.class join points q on q.pooling = model_b and q.class = ds.class group by model_a, model_b, ds.class""".replace("select model_a, model_b, class, round(any_value", "select model_a, model_b, ds.class, round(any_value"))
def effect_table(spark, d):
    pairs = spark.createDataFrame([("mean", "lme"), ("max", "lme"), ("mean", "linear_softmax")], "model_a string, model_b string")
    points, boots = (x.withColumnRenamed("pooling", "model_id") for x in _points_and_boots(spark, d, FULL))
    out = reports.effects(pairs, cut(boots), points, ["class"])
    return out.select("model_a", "model_b", "class", r6("delta"), r6("lo"), r6("hi"))


@query(f"with {G.FILES}, a as (select name, hash from files where doc_id % 3 <> 0), b as (select name, hash from files where doc_id % 3 <> 1) select name, hash, 'a' as side from (select * from a except all select * from b) union all select name, hash, 'b' from (select * from b except all select * from a)")
def symmetric_difference(spark, d):
    f = G.files(spark, d)
    return reports.symmetric_difference(f.where("doc_id % 3 <> 0").select("name", "hash"), f.where("doc_id % 3 <> 1").select("name", "hash"))


_FOLD_AP = f"with {G.SCORED}, {ap_sql('scored', 'pooling, class, fold')}, models as (select pooling as model_id, fold as seed, avg(ap) as ap, avg(ap) as val_ap, (fold + 10) as epochs from aps group by pooling, fold)"


def _models(spark, d):
    aps = metrics.average_precision(G.scored(spark, d), ["pooling", "class", "fold"])
    return aps.groupBy(F.col("pooling").alias("model_id"), F.col("fold").alias("seed")).agg(F.avg("ap").alias("ap")).withColumns({"val_ap": F.col("ap"), "epochs": F.col("seed") + 10})


@query(f"{_FOLD_AP} select model_id, count(distinct seed) as n_seeds, round(avg(ap), 6) as ap, round(case when count(distinct seed) > 1 then stddev_pop(ap) end, 6) as sd, round(avg(val_ap), 6) as val_ap, avg(epochs) as epochs from models group by model_id")
def overview(spark, d):
    return reports.overview(_models(spark, d)).select("model_id", "n_seeds", r6("ap"), r6("sd"), r6("val_ap"), "epochs")


@query(f"{_FOLD_AP}, whole as (select model_id, round(avg(val_ap), 1) as val_ap from models group by model_id) select model_id, val_ap from whole order by (model_id = 'max'), val_ap desc, length(model_id) desc, model_id limit 1")
def val_selected(spark, d):
    """Values of one decimal, so that models tie and their positions decide."""
    whole = _models(spark, d).groupBy("model_id").agg(F.round(F.avg("val_ap"), 1).alias("val_ap"))
    rows = whole.withColumns({"position": -F.length("model_id"), "train_regimes": F.when(F.col("model_id") == "max", "F")})
    return reports.val_selected(rows)


@query(f"""with {G.SCORED}, roles as (select pooling, f::int as f, case when fold = f then 'test' when fold = (f + 1) % 5 then 'val' else 'train' end as split, score, y, class from scored, range(5) t(f)),
{ap_sql('roles', 'pooling, f, split, class')}, s as (select pooling as model_id, f, split, avg(ap) as ap from aps group by all), w as (select model_id, f, max(ap) filter (where split = 'train') as train, max(ap) filter (where split = 'val') as val, max(ap) filter (where split = 'test') as test from s group by all)
select model_id, round(avg(train), 6) as train_mean, round(stddev_samp(train), 6) as train_sd, round(avg(val), 6) as val_mean, round(stddev_samp(val), 6) as val_sd, round(avg(test), 6) as test_mean, round(stddev_samp(test), 6) as test_sd, round(avg(train - val), 6) as gap from w group by model_id""")
def split_fit(spark, d):
    # scores are summed before every fold takes its copy
    rows = B.fold_roles(G.tied(spark, d, "fold"), G.FOLDS)
    aps = metrics.average_precision(rows, ["pooling", "f", "role", "class"], F.col("n"))
    splits = aps.groupBy(F.col("pooling").alias("model_id"), F.lit(0).alias("seed"), F.col("f").alias("fold"), F.col("role").alias("split")).agg(F.avg("ap").alias("ap"))
    return reports.split_fit(splits).select("model_id", *map(r6, ("train_mean", "train_sd", "val_mean", "val_sd", "test_mean", "test_sd", "gap")))


@query(f"with {G.SCORED}, {ap_sql('scored', _PC)}, r as (select row_number() over (order by pooling, class) + 1 as i, '| ' || pooling || ' | ' || class || ' | ' || printf('%.3f', ap) || ' |' as line from aps) select 0 as line_no, '| pooling | class | ap |' as line union all select 1, '|---|---|---|' union all select i::int, line from r")
def md_table(spark, d):
    aps = metrics.average_precision(G.scored(spark, d), ["pooling", "class"]).withColumn("ap", S.cell(F.col("ap")))
    return reports.markdown(aps, ["pooling", "class", "ap"], ["pooling", "class"])


@query("""with o as (select o_custkey as dataset, row_number() over (partition by o_custkey order by o_orderkey)::int as position, o_orderkey as k, o_orderstatus as s, o_orderpriority as p from orders),
s as (select dataset, position, 'stage ' || p as stage, case when s = 'P' and k % 2 = 0 then 'no result' when k % 11 = 0 then 'never built'
  else nullif(array_to_string([case when k % 13 = 0 then 'audio changed' end, case when k % 7 = 0 then 'code changed' end], ', '), '') end as own from o)
select dataset, position, stage, max((own is not null)::int) over (partition by dataset order by position) = 1 as stale, coalesce(own, case when coalesce(max((own is not null)::int) over (partition by dataset order by position rows between unbounded preceding and 1 preceding), 0) = 1 then 'a stage before it is stale' else 'up to date' end) as reason from s""")
def staleness(spark, d):
    """A customer's orders as the stages of a dataset, with what they were built of and what there is now."""
    k, s, p = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    old = lambda n, now: F.when(k % n == 0, "old").otherwise(now)
    position = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    stages = table(spark, d, "orders").select(
        F.col("o_custkey").alias("dataset"), position.alias("position"), F.concat(F.lit("stage "), p).alias("stage"), (~((s == "P") & (k % 2 == 0))).alias("exists"), (k % 11 != 0).alias("built"),
        F.create_map(F.lit("code"), p, F.lit("audio"), s).alias("current"), F.create_map(F.lit("code"), old(7, p), F.lit("audio"), old(13, s)).alias("stamp"),
    )
    return lineage.stale_stages(stages, ["dataset"])


@query(f"""with {G.FILES}, d as (select sha256(name || chr(31) || coalesce(hash, chr(0)) || chr(31) || size) as d from files),
b as (select sha256(string_agg(d, chr(10) order by d)) as d from d group by substr(d, 1, 3)) select substr(sha256(string_agg(d, chr(10) order by d)), 1, 16) as fingerprint from b""")
def fingerprint(spark, d):
    return lineage.fingerprint(G.files(spark, d), ["name", "hash", "size"])


@query("with l as (select doc_id, case when doc_id % 5 = 0 then '' else sha256(text) end || chr(9) || n_chars || chr(9) || source || '/a b.wav' as v from documents) select doc_id, nullif(split_part(v, chr(9), 1), '') as hash, split_part(v, chr(9), 2)::bigint as size, split_part(v, chr(9), 3) as path from l")
def parse_listing(spark, d):
    from millrace.sources.tables import parse_listing as parse

    line = F.concat_ws("\t", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.sha2("text", 256)), "n_chars", F.concat("source", F.lit("/a b.wav")))
    return table(spark, d, "documents").select("doc_id", parse(line).alias("l")).select("doc_id", "l.*")


# ---------------------------------------------------------------- without SQL

def _wavs(spark, d, wanted=None):
    """hour, content: WAV files built of events: 16-bit, 500 frames an event, some truncated or silent.

    Files are handed on one by one. ``wanted`` (hour and more) names the hours to build and adds its columns.
    """
    import pyarrow as pa

    v = F.round(F.col("value").cast("double") % 300 * 100).cast("int").alias("v")
    e = table(spark, d, "events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_id", v)
    # files are much larger than the events they are of: a number of partitions that isn't coalesced
    e = e.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "hour")
    e = e.groupBy("hour").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "v"))), lambda x: x["v"]).alias("s"))
    if wanted is not None:
        e = e.join(wanted, "hour")
    others = [c for c in e.columns if c != "s"]

    def built(batches):
        import io
        import wave

        import numpy as np

        for batch in batches:
            for i in range(batch.num_rows):
                h, s = batch.column("hour")[i].as_py(), batch.column("s")[i].values.to_numpy()
                x = np.repeat(s.astype("<i2"), 500)
                x = np.concatenate([x, np.zeros(9000, "<i2")]) if h and h.hour == 3 else x
                f = io.BytesIO()
                with wave.open(f, "wb") as w:
                    w.setnchannels(1)
                    w.setsampwidth(2)
                    w.setframerate(8000)
                    w.writeframes(x)
                data = f.getvalue()[: -1000 if h and h.hour == 5 else None]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in others), pa.array([data], pa.binary())], names=[*others, "content"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in e.select(*others).schema)
    return e.select(*others, "s").mapInArrow(built, f"{schema}, content binary")


@query("""with e as (select date_trunc('hour', ts)::timestamp as hour, event_id, round(value::double % 300 * 100)::int as v from events),
g as (select *, sum((v <> 0)::int) over (partition by hour order by event_id rows unbounded preceding) as before, count(*) over (partition by hour) as n, sum((v <> 0)::int) over (partition by hour) as loud from e),
z as (select hour, before, loud, any_value(n) as n, count(*) filter (where v = 0) * 500 + case when hour(hour) = 3 and before = loud then 9000 else 0 end as zeros, sum(500 * (v / 32767.0::double) ** 2) as squares from g group by hour, before, loud),
f as (select hour, any_value(n) * 500 + case when hour(hour) = 3 then 9000 else 0 end as frames, greatest(max(zeros), case when hour(hour) = 3 then 9000 else 0 end) as run,
             greatest(coalesce(max(zeros) filter (where before = loud), 0), case when hour(hour) = 3 then 9000 else 0 end) as tail, sum(squares) as squares from z group by hour),
r as (select *, hour(hour) = 5 as cut from f)
select hour, 8000 as sample_rate, 1 as channels, 2 as sampwidth, round(frames / 8000.0::double, 3) as duration_s, cut as truncated,
       case when not cut then round(run / 8000.0::double, 3) end as zero_run_s, case when not cut then round(tail / 8000.0::double, 3) end as zero_tail_s, case when not cut then 0.0::double end as clip_frac,
       case when not cut then round(10 * log10(squares / frames), 2) end as rms_dbfs, not cut and run < 8000 as qc_ok,
       case when cut then 'truncated' when run >= 8000 then printf('digital zero for %.1f s', run / 8000.0::double) || case when run = tail then ' at the end' else '' end else '' end as qc_reason from r""")
def qc_wav(spark, d):
    """Quality of the WAV files."""
    return _wavs(spark, d).select("hour", audio.qc(F.col("content")).alias("qc")).select("hour", "qc.*")


_WAV_WINDOWS = """with e as (select date_trunc('hour', ts)::timestamp as hour, round(value::double % 300 * 100)::int as v, row_number() over (partition by date_trunc('hour', ts) order by event_id) - 1 as i from events),
f as (select hour, count(*) as n, count(*) * 500 + case when hour(hour) = 3 then 9000 else 0 end - case when hour(hour) = 5 then 500 else 0 end as frames from e group by hour),
w as (select hour, frames, round(frames / 8000.0::double * 1000)::bigint as d from f),
k as (select hour, frames, d, unnest(range(d // 1000 + ((d % 1000) * 2 >= 1000)::int))::int as win_idx from w),
p as (select e.hour, (i // 16)::int as win_idx, sum(500 * (v / 32768.0::double) ** 2) as energy, max(abs(v)) / 32768.0::double as peak from e join f using (hour) where not (hour(e.hour) = 5 and i = n - 1) group by all)
select hour, win_idx, win_idx::double as start_s, least((win_idx + 1) * 1000, d) / 1000.0::double as end_s, 8000 as n_samples, round(coalesce(energy, 0), 6) as energy, round(coalesce(peak, 0), 6) as peak from k left join p using (hour, win_idx)"""


@query(_WAV_WINDOWS)
def wav_windows(spark, d):
    """Windows of a second of the WAV files, the tail padded: samples, their energy and peak."""
    rows = audio.window_rows(_wavs(spark, d), ["hour"], 1.0)
    energy = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x * x)
    return rows.select("hour", "win_idx", "start_s", "end_s", F.size("samples").alias("n_samples"), F.round(energy, 6).alias("energy"), F.round(F.array_max(F.transform("samples", F.abs)), 6).alias("peak"))


@query(f"select hour, win_idx, win_idx % 5 = 0 as kept, case when win_idx % 5 = 0 then -1 else energy end as energy from ({_WAV_WINDOWS})")
def resumable_windows(spark, d):
    """Energy of windows of recordings through a cache: an earlier one is held against the files, then filled in batches.

    Of the earlier rows every fifth has no signature and stays, one is of another file and one isn't done.
    """
    from millrace.streaming import resumable

    root = made_folder(spark, f"{shared_dir(spark)}/resumable-{uuid.uuid4().hex}")
    # files are built again where their windows are wanted: tables of whole files are read and written many files at a time
    clips = _wavs(spark, d).withColumn("file_sig", F.sha2("content", 256))
    instance = F.concat_ws("_", F.date_format("hour", "yyyyMMddHH"), "win_idx")
    audio.window_grid(clips, ["hour", "file_sig"], 1.0).select(instance.alias("instance_id"), "file_sig", "hour", "win_idx").repartition(8, "instance_id").write.parquet(f"{root}/wanted")
    wanted = spark.read.parquet(f"{root}/wanted")
    part, payload = F.col("win_idx") % 5, "energy double"
    old = wanted.where(part < 3).select("instance_id", F.when(part == 1, "other").when(part == 2, F.col("file_sig")).alias("file_sig"), (part != 2).alias("done"), F.lit(-1.0).alias("energy"))
    old.write.parquet(f"{root}/cache/rows/run=earlier/batch=0")

    def compute(todo):
        of = todo.groupBy("hour").agg(F.collect_set("win_idx").alias("wins"))
        rows = audio.window_rows(_wavs(spark, d, of), ["hour"], 1.0, only="wins")
        energy = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x * x)
        return rows.select(instance.alias("instance_id"), energy.alias("energy"))

    resumable.fill(spark, f"{root}/wanted", wanted.schema, f"{root}/cache", f"{root}/state", payload, "energy of a second", compute, files_per_batch=3)
    found = resumable.standing(wanted, resumable.cached(spark, f"{root}/cache", payload))
    return wanted.join(found.select("instance_id", "energy", "run"), "instance_id").select("hour", "win_idx", (F.col("run") == "earlier").alias("kept"), r6("energy"))


def _vector_bags(spark, d):
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("bag_id"), F.col("vec_id"), "embedding", "label")
    # presence of a label in a bag's first half decides its level, so there is something to learn
    level = lambda c: (F.count_if(F.col("label") == c)).cast("int").alias(f"l{c}")
    g = e.groupBy("bag_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))), lambda s: s["embedding"]).alias("vectors"), level(0), level(1))
    return g.select("bag_id", (F.col("bag_id") % G.FOLDS).cast("int").alias("fold"), F.when(F.col("bag_id") % 2 == 0, "even").otherwise("odd").alias("regime"), F.array(F.least("l0", F.lit(3)), F.least("l1", F.lit(3))).alias("index"), "vectors")


@query()
def train_probe(spark, d):
    """Out-of-fold test scores of two poolers, linear probes: one of every bag, class and pooler."""
    from millrace.operators import training as T

    bags = cut(_vector_bags(spark, d))
    fits = [T.Fit(p, fold=f) for p in ("mean", "lme") for f in range(G.FOLDS)]
    settings = T.Settings()
    params, stats, _ = T.train_batches(bags, fits, settings)
    settings.extra = {}
    out = T.scores(bags, fits, params, stats, settings).where("split = 'test'")
    return out.withColumn("pooling", F.element_at(F.array(*(F.lit(f.pooling) for f in fits)), F.col("fit") + 1))


def _stored_fits(spark, d):
    """Linear probes with given weights for every pooler and fold, through the table that weights are stored in."""
    import numpy as np

    from millrace.operators import training as T

    fits = [T.Fit(p, fold=f) for p in ("mean", "max", "lme", "linear_softmax") for f in range(G.FOLDS)]
    at = lambda f: ((np.arange(64)[:, None] * 7 + np.arange(2) * 3 + f * 5) % 11 - 5) / 20
    table = cut(runs.weights_table(spark, fits, [{"w": at(f.fold), "b": np.array([0.0, 0.1])} for f in fits]))
    params = [runs.load_weights(table, f.run_id, f.pooling, f.seed, f.fold) for f in fits]
    stats = {(f.fold, f.regimes): (np.zeros(64), np.ones(64), None) for f in fits}
    return fits, params, stats, T.Settings()


_WINDOW_LOGITS = """
v as (select floor(vec_id / 8)::bigint as bag_id, row_number() over (partition by floor(vec_id / 8) order by vec_id) - 1 as win_idx, embedding as e from embeddings),
long as (select bag_id, win_idx::int as win_idx, c::int as class,
  list_sum(list_transform(range(64), lambda d: e[d + 1]::double * ((d * 7 + c * 3 + (bag_id % 5) * 5) % 11 - 5) / 20.0::double)) + 0.1::double * c as x from v, range(2) t(c))"""


@query(f"""with {_WINDOW_LOGITS},
w as (select *, max(x) over b as top, count(*) over b as n, sum(1 / (1 + exp(-x))) over b as p1, row_number() over (b order by x desc, win_idx) as i from long window b as (partition by bag_id, class)),
e as (select *, exp(x - top) / sum(exp(x - top)) over (partition by bag_id, class) as l from w)
select pooling, bag_id, win_idx, class, round(x, 6) as logit, round(case pooling when 'mean' then 1.0::double / n when 'max' then (i = 1)::int when 'lme' then l else 1 / (1 + exp(-x)) / greatest(p1, 1e-6::double) end, 6) as weight
from e, (values ('mean'), ('max'), ('lme'), ('linear_softmax')) p(pooling)""")
def window_outputs(spark, d):
    """Logits and weights of all windows, each bag under the stored probes of its own test fold."""
    from millrace.operators import training as T

    fits, params, stats, settings = _stored_fits(spark, d)
    rows = T.window_outputs(_vector_bags(spark, d), fits, params, stats, settings)
    name = F.element_at(F.array(*(F.lit(f.pooling) for f in fits)), F.col("fit") + 1)
    return rows.select(name.alias("pooling"), "bag_id", "win_idx", "class", r6("logit"), r6("weight"))


@query(f"""with {_WINDOW_LOGITS},
pre as (select a.bag_id, a.class, a.win_idx + 1 as n, b.x from long a join long b on a.bag_id = b.bag_id and a.class = b.class and b.win_idx <= a.win_idx),
agg as (select bag_id, class, n, avg(x) as mean, max(x) as max, ln(avg(exp(x))) as lme from pre group by bag_id, class, n)
select class, n, count(*) as n_bags, round(avg(1 / (1 + exp(-mean))), 6) as mean, round(avg(1 / (1 + exp(-max))), 6) as max, round(avg(1 / (1 + exp(-lme))), 6) as lme from agg group by class, n""")
def truncated_scores(spark, d):
    """Mean score of the bags cut off after n windows, each under the stored probe of its own test fold."""
    from millrace.operators import training as T

    fits, params, stats, settings = _stored_fits(spark, d)
    one = [i for i, f in enumerate(fits) if f.pooling == "lme"]
    rows = T.window_outputs(_vector_bags(spark, d), [fits[i] for i in one], [params[i] for i in one], stats, settings)
    cut_off = pooling.prefixes(rows.withColumnRenamed("logit", "x"))
    return cut_off.groupBy("class", "n").agg(F.count("*").alias("n_bags"), *(F.round(F.avg(S.sigmoid(F.col(c))), 6).alias(c) for c in ("mean", "max", "lme")))


def _decoded(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("key"), (F.floor(F.col("vec_id") / 8) % G.FOLDS).cast("int").alias("fold"), (F.col("label") < 3).cast("int").alias("y"), F.col("embedding").alias("vector"))


@query("""with r as (select vec_id, (floor(vec_id / 8)::bigint % 5)::int as fold, (label < 3)::int as y, substr(md5('0:' || vec_id), 1, 15) as place from embeddings),
t as (select f::int as trains, vec_id, y, place from r, range(5) f(f) where r.fold <> f),
c as (select trains, count(*) filter (where y = 0) as zero, count(*) filter (where y = 1) as one from t group by 1),
q as (select trains, least(one, greatest(50, 100 - zero)) as one, least(zero, 100 - least(one, greatest(50, 100 - zero))) as zero from c where one > 0 and zero > 0),
i as (select t.*, case y when 1 then q.one else q.zero end as quota, row_number() over (partition by trains, y order by place) as i from t join q using (trains))
select trains, vec_id, y from i where i <= quota""")
def decoding_sample(spark, d):
    """The rows that each fold's fit is made on, a hundred here, half of each class, drawn by the same places for all."""
    from millrace.operators import decoding

    drawn, _ = decoding.decoding_sample(_decoded(spark, d).drop("vector"), G.FOLDS, 100)
    return drawn.select(F.explode("trains").alias("trains"), F.col("key").cast("long").alias("vec_id"), "y")


@query()
def regime_decoding(spark, d):
    """Which of two groups of labels single vectors are of, in five held-out folds."""
    from millrace.operators import decoding

    return decoding.regime_decoding(_decoded(spark, d), G.FOLDS)


@query()
def incremental_append(spark, d):
    """Hourly counts of events through a file stream that takes all there is and ends."""
    from millrace.streaming.incremental import append_new

    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    table(spark, d, "events").select("ts", "event_id", "event_type").write.parquet(f"{root}/in")
    schema = "ts timestamp_ntz, event_id long, event_type string"
    append_new(spark, f"{root}/in", schema, f"{root}/out", f"{root}/state", lambda s: s.select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_id", "event_type"))
    return spark.read.parquet(f"{root}/out").groupBy("hour").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"))


ORACLE_SQL["incremental_append"] = "select date_trunc('hour', ts)::timestamp as hour, count(*) as n, count(distinct event_type) as kinds from events group by 1"
