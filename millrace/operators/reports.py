"""Report tables over models, seeds, folds and cells, and controlled comparison of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalar import markdown_row
from millrace.session import cut, if_few

from . import bootstrap
from .metrics import cutoffs, running, to_digits


def val_selected(models: DataFrame) -> DataFrame:
    """The model with the best mean val_ap; those trained on some regimes only if there is no other.

    (model_id, position, val_ap, train_regimes) -> model_id, val_ap; the first in position wins ties.
    """
    means = models.groupBy("model_id").agg(F.avg("val_ap").alias("val_ap"), F.min("position").alias("position"), F.max(F.col("train_regimes").isNotNull().cast("int")).alias("partial"))
    best = F.struct(-F.col("partial"), F.col("val_ap"), -F.col("position"))
    return means.agg(F.max_by(F.struct("model_id", "val_ap"), best).alias("m")).select("m.*")


def controlled_pairs(runs: DataFrame, factor: str, factors: Sequence[str], spec: Sequence[str]) -> DataFrame:
    """Pairs of runs alike in all of ``spec`` and in pooling, the factor falsy in a and truthy in b."""
    same = [c for c in (*spec, *factors) if c != factor]
    a, b = runs.alias("a"), runs.alias("b")
    on = F.col("a.pooling") == F.col("b.pooling")
    for c in same:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    truthy = lambda t: F.coalesce(F.col(f"{t}.{factor}") != 0, F.lit(False))
    return a.join(b, on & ~truthy("a") & truthy("b")).select(F.col("a.model_id").alias("model_a"), F.col("b.model_id").alias("model_b"), F.col("a.pooling").alias("pooling"))


def run_labels(runs: DataFrame) -> DataFrame:
    """runs with run_id, probe and target names made of hidden and ordinal_weight."""
    plain = F.regexp_replace(F.format_string("%.6f", F.col("ordinal_weight").cast("double")), r"\.?0+$", "")
    has, weighted = F.col("hidden") > 0, F.col("ordinal_weight") > 0
    return runs.withColumns({
        "run_id": F.concat(F.when(has, F.concat(F.lit("mlp"), "hidden")).otherwise("linear"), F.lit("-"), F.when(weighted, F.concat(F.lit("ord"), plain)).otherwise("bin")),
        "probe": F.when(has, F.concat(F.lit("MLP-"), "hidden")).otherwise("linear"),
        "target": F.when(weighted, F.concat(F.lit("ordinal (w="), plain, F.lit(")"))).otherwise("binary"),
    })


def effects(pairs: DataFrame, boots: DataFrame, points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(model_a, model_b) with boots (model_id, keys, b, ap) and points -> the paired change b - a, lo, hi."""
    side = lambda df, t, more: df.select(F.col("model_id").alias(f"model_{t}"), *keys, *more, F.col("ap").alias(f"ap_{t}"))
    change = pairs.join(side(boots, "a", ["b"]), "model_a").join(side(boots, "b", ["b"]), ["model_b", *keys, "b"])
    ends = F.expr("percentile(ap_b - ap_a, array(0.025D, 0.975D))")
    of = ["model_a", "model_b", *keys]
    point = pairs.join(side(points, "a", []), "model_a").join(side(points, "b", []), ["model_b", *keys])
    found = change.groupBy(*of).agg(ends.alias("e")).join(point.select(*of, (F.col("ap_b") - F.col("ap_a")).alias("delta")), of)
    return found.select(*of, "delta", F.col("e")[0].alias("lo"), F.col("e")[1].alias("hi"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table and not of the other (repeats count), with side a or b; empty if they are the same."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def config_diff(stored: DataFrame, wanted: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key, field, stored, wanted of every field that differs (null is a value)."""
    flat = lambda df, name: df.select(key, *(F.col(f).cast("string").alias(f) for f in fields)).unpivot([key], list(fields), "field", name)
    both = flat(stored, "stored").join(flat(wanted, "wanted"), [key, "field"])
    return both.where(~F.col("stored").eqNullSafe(F.col("wanted")))


def overview(scores: DataFrame) -> DataFrame:
    """(model_id, seed, ap, val_ap, epochs) -> model_id, n_seeds, ap, sd (population; null for one seed), val_ap, epochs."""
    n = F.count_distinct("seed")
    return scores.groupBy("model_id").agg(n.alias("n_seeds"), F.avg("ap").alias("ap"), F.when(n > 1, F.stddev_pop("ap")).alias("sd"), F.avg("val_ap").alias("val_ap"), F.avg("epochs").alias("epochs"))


def split_fit(splits: DataFrame) -> DataFrame:
    """(model_id, seed, fold, split, ap) -> mean and sample deviation of each split, and mean train - val."""
    wide = splits.groupBy("model_id", "seed", "fold").pivot("split", ["train", "val", "test"]).agg(F.first("ap"))
    stats = [f(c).alias(f"{c}_{n}") for c in ("train", "val", "test") for f, n in ((F.avg, "mean"), (F.stddev_samp, "sd"))]
    return wide.groupBy("model_id").agg(*stats, F.avg(F.col("train") - F.col("val")).alias("gap"))


def level_table(cells: DataFrame, least: int = 5) -> DataFrame:
    """class, level, n, chance of the level cells with at least ``least`` positives."""
    n = F.sum("y")
    out = cells.where("kind = 'level'").groupBy("class", "level").agg(n.alias("n"), (n / F.count("*")).alias("chance"))
    return out.where(F.col("n") >= least)


def regime_table(cells: DataFrame) -> DataFrame:
    """class, regime, n_bags, n_pos, prevalence."""
    out = cells.where("kind = 'regime'").groupBy("class", F.col("cell_regime").alias("regime"))
    return out.agg(F.count("*").alias("n_bags"), F.sum("y").alias("n_pos"), F.avg("y").alias("prevalence"))


def top_share(rows: DataFrame, score: str, fraction: float, *order: str) -> DataFrame:
    """rows with top: among the ceil(fraction * n) highest scores, ties by ``order``.

    The score at which the share ends is found by running sums over parts of the range; only its ties
    go on to the next column. Rows alike in all columns are in together. Nothing is sorted in one task.
    """
    top, tied, left = F.lit(False), F.lit(True), None
    for i, c in enumerate((score, *order)):
        falling = i == 0
        groups = cut(rows.where(tied).groupBy(c).agg(F.count("*").alias("_n")))
        if left is None:
            left = int(groups.select(F.ceil(F.coalesce(F.sum("_n"), F.lit(0)) * F.lit(fraction)).alias("k")).first()["k"])
        if left <= 0:
            return rows.withColumn("top", top)
        upto = running(groups, [], sums={"_upto": "_n"}, totals={}, score=c, falling=falling).where(F.col("_upto") >= left)
        end = upto.orderBy("_upto").select(c, "_n", (F.col("_upto") - F.col("_n")).alias("before")).first()
        beyond = F.col(c) > F.lit(end[c]) if falling else F.col(c) < F.lit(end[c])
        top = top | (tied & beyond)
        tied, left = tied & (F.col(c) == F.lit(end[c])), left - end["before"]
        if left == end["_n"]:  # all that tie are in
            break
    return rows.withColumn("top", F.coalesce(top | tied, F.lit(False)))


def most_disagreeing(scores: DataFrame) -> DataFrame:
    """The bag whose seed-mean scores differ most between poolers: (bag_id, pooling, score, index).

    Among bags with index 1, or with a positive index if there is none of those.
    """
    spread = scores.groupBy("bag_id", "index").agg(F.stddev_pop("score").alias("sd")).where(F.col("index") > 0)
    best = F.struct(F.col("index") == 1, F.col("sd"), -F.col("bag_id"))
    return spread.agg(F.max_by(F.struct("bag_id", "sd"), best).alias("b")).select("b.*")


def markdown(rows: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """line_no, line: a markdown table; for report tables, whose rows are few."""
    spark = rows.sparkSession
    head = spark.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))], "line_no int, line string")
    number = F.row_number().over(Window.orderBy(*order)) + 1
    return head.unionByName(rows.select(number.cast("int").alias("line_no"), markdown_row([F.col(c) for c in columns]).alias("line")))


def in_cells(scores: DataFrame, levels: int, level: str = "lvl", regime: str = "regime", kinds: Sequence[str] = ("presence", "regime", "level")) -> DataFrame:
    """scores with ``cell``, a row for each cell of the kinds that a bag is in: presence, its regime, and level L for index 0 or L."""
    of_level = [F.when(F.col(level).isin(0, n), f"level:{n}") for n in range(1, levels + 1)]
    of = {"presence": [F.lit("presence")], "regime": [F.concat(F.lit("regime:"), regime)], "level": of_level}
    cells = F.array(*(c for k in kinds for c in of[k]))
    return scores.withColumn("cell", F.explode(F.filter(cells, lambda c: c.isNotNull())))


def level_cells(levels: int, level: str = "lvl") -> dict[str, Column]:
    """The conditions of the level cells: L holds index 0 and L."""
    return {f"level:{n}": F.col(level).isin(0, n) for n in range(1, levels + 1)}


#: Cells that the bits of a row tell apart; where there are more, rows are copied for the cells they are in.
MOST_CELLS = 60


def bits_of_cells(scores: DataFrame, levels: int, level: str = "lvl", regime: str = "regime") -> dict[str, Column] | None:
    """The conditions of all cells of ``in_cells`` by name, those of the regimes there are; None if there are over MOST_CELLS."""
    of = F.col(regime).cast("string")
    found = [r[0] for r in scores.select(of).where(of.isNotNull()).distinct().limit(MOST_CELLS).collect()]
    cells = {"presence": F.lit(True)} | level_cells(levels, level) | {f"regime:{r}": of == r for r in sorted(found)}
    return cells if len(cells) <= MOST_CELLS else None


def statistics(celled: DataFrame, drawn: DataFrame, model: Sequence[str], weight: Column | None = None, cells: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(model, class, cell, seed, stratum, cluster, score, y) -> points (model, class, cell, ap) and boots (with b).

    Both are means over seeds, boots resample by resample. ``cells``: conditions by name in place of the column,
    so that no row is copied for the cells it is in.
    """
    of = [*model, "class", "cell"]
    keys = [*model, "class", "seed", *([] if cells else ["cell"])]
    points, boots = bootstrap.point_and_resamples(celled, drawn, keys, weight, cells)
    return bootstrap.seed_mean(points, of), bootstrap.seed_mean(boots, [*of, "b"])


def cell_table(celled: DataFrame, points: DataFrame, boots: DataFrame, model: Sequence[str], kind: str, least: int = 0, weight: Column | None = None) -> DataFrame:
    """model, class, cell, n_bags, n_pos, chance, ap, lo, hi of the cells of a kind (presence, level, regime).

    Counts are of bags, whatever the seeds; cells with fewer than ``least`` positives are left out.
    """
    of, w = [*model, "class", "cell"], F.lit(1) if weight is None else weight.cast("long")
    counts = celled.groupBy(*of, "seed").agg(F.sum(w).alias("n"), F.sum(w * F.col("y")).alias("p")).groupBy(*of).agg(F.max("n").alias("n_bags"), F.max("p").alias("n_pos"))
    rows = counts.where(F.startswith("cell", F.lit(kind)) & (F.col("n_pos") >= least))
    out = rows.join(points, of).join(bootstrap.interval(boots, of), of)
    return out.withColumn("chance", F.col("n_pos") / F.col("n_bags")).select(*of, "n_bags", "n_pos", "chance", "ap", "lo", "hi")


def macro_overview(seed_points: DataFrame, boots: DataFrame, validation: DataFrame) -> DataFrame:
    """model_id, n_seeds, ap, lo, hi, sd, val_ap, selected: macro precision with its interval, the best validation marked.

    seed_points: (model_id, seed, class, ap) of presence; boots: (model_id, class, cell, b, ap); validation: (model_id, val_ap).
    sd is that of the seeds' macro values in the population, null for one seed; ties go to the first name.
    """
    of_seed = seed_points.groupBy("model_id", "seed").agg(F.avg("ap").alias("macro"))
    n = F.count("*")
    seeds = of_seed.groupBy("model_id").agg(n.alias("n_seeds"), F.avg("macro").alias("ap"), F.when(n > 1, F.stddev_pop("macro")).alias("sd"))
    macro_boots = boots.where("cell = 'presence'").groupBy("model_id", "b").agg(F.avg("ap").alias("ap"))
    best = validation.agg(F.min(F.struct(-F.round("val_ap", 9), "model_id")).alias("m")).select(F.col("m.model_id").alias("best"))
    rows = seeds.join(bootstrap.interval(macro_boots, ["model_id"]), "model_id").join(validation, "model_id", "left").crossJoin(F.broadcast(best))
    return rows.select("model_id", "n_seeds", "ap", "lo", "hi", "sd", "val_ap", (F.col("model_id") == F.col("best")).alias("selected"))


def transfer_table(points: DataFrame, boots: DataFrame, arms: DataFrame) -> DataFrame:
    """model_id, class, regime, ap, delta, lo, hi, unseen, text: what models trained on some regimes lose in others.

    arms: (model_id, reference, trained_on array, null for all). delta is the paired difference to the
    reference in the regime; text is the precision, bold where the model never saw the regime.
    """
    only = lambda df: df.where(F.startswith("cell", F.lit("regime:"))).withColumn("regime", F.substring_index("cell", ":", -1))
    side = lambda df, name, more: only(df).select(F.col("model_id").alias(name), "class", "regime", *more, F.col("ap").alias(f"{name}_ap"))
    both = lambda df, more: arms.join(side(df, "model_id", more), "model_id").join(side(df, "reference", more), ["reference", "class", "regime", *more])
    of = ["model_id", "class", "regime"]
    change = both(boots, ["b"]).withColumn("d", F.col("model_id_ap") - F.col("reference_ap"))
    rows = both(points, []).join(bootstrap.interval(change, of, "d"), of)
    unseen = F.coalesce(~F.array_contains("trained_on", F.col("regime")), F.lit(False))
    shown = F.format_string("%.3f", F.col("model_id_ap"))
    text = F.when(unseen, F.concat(F.lit("**"), shown, F.lit("**"))).otherwise(shown)
    return rows.select(*of, F.col("model_id_ap").alias("ap"), (F.col("model_id_ap") - F.col("reference_ap")).alias("delta"), "lo", "hi", unseen.alias("unseen"), text.alias("text"))


def report_set(scores: DataFrame, drawn: DataFrame, validation: DataFrame, levels: int, least: int = 5, weight: Column | None = None) -> dict[str, DataFrame]:
    """The tables of a report by name: overview, vs_selected, per_level, per_regime.

    scores: (model_id, seed, class, regime, stratum, cluster, lvl, score, y); validation: (model_id, val_ap).
    ``weight``: rows that a row of scores stands for. Scores move once, for points and resamples of all cells, and are
    read several times: give stored ones.
    """
    cells = bits_of_cells(scores, levels)
    keys = ["model_id", "class", "seed", *([] if cells else ["cell"])]
    seed_points, seed_boots = bootstrap.point_and_resamples(scores if cells else in_cells(scores, levels), drawn, keys, weight, cells)
    of = ["model_id", "class", "cell"]
    points, boots = bootstrap.seed_mean(seed_points, of), bootstrap.seed_mean(seed_boots, [*of, "b"])
    seed_points = seed_points.where("cell = 'presence'").drop("cell")
    # bags are counted by level and regime before they are told by cell
    counts = scores.groupBy("model_id", "class", "seed", "lvl", "regime", "y").agg(F.sum(F.lit(1.0) if weight is None else weight).alias("n"))
    celled, n = in_cells(counts, levels), F.col("n")
    overview = macro_overview(seed_points, boots, validation)
    presence = lambda df: df.where("cell = 'presence'").drop("cell")
    chosen = F.broadcast(overview.where("selected").select(F.col("model_id").alias("_best")))
    mark = lambda df: df.crossJoin(chosen).withColumn("_ref", F.col("model_id") == F.col("_best")).drop("_best")
    against = bootstrap.paired(mark(presence(boots)), mark(presence(points)), F.col("_ref"), "model_id", ["class"])
    return {
        "overview": overview, "vs_selected": against,
        "per_level": cell_table(celled, points, boots, ["model_id"], "level", least, n), "per_regime": cell_table(celled, points, boots, ["model_id"], "regime", weight=n),
    }


def recall_table(val: DataFrame, test: DataFrame, drawn: DataFrame, precisions: Sequence[float], selected: str, model: str = "pooling", keys: Sequence[str] = ("class",), fold: str = "fold", weight: Column | None = None) -> DataFrame:
    """keys, model, at, recall, lo, hi, delta, delta_lo, delta_hi, verdict at each of several precisions.

    val and test: (model, keys, fold, stratum, cluster, score, y). Cutoffs are those of each fold's
    validation rows, flags are pooled over folds; recall and its paired difference to the selected
    model have intervals over resampled clusters. The selected model's differences are null.
    """
    of = [model, *keys]
    cuts = cutoffs(val, [*of, fold], precisions, weight)
    flag = F.coalesce(to_digits(F.col("score")) >= F.col("cutoff"), F.lit(False)).cast("int")
    w, of_cluster = F.lit(1) if weight is None else weight.cast("long"), [*of, "at", "stratum", "cluster"]
    # shares need sums by cluster only, so no row of a bag is kept
    rows = cut(test.join(if_few(cut(cuts)), [*of, fold]).groupBy(*of_cluster).agg(F.sum(w * flag * F.col("y")).alias("hit"), F.sum(w * F.col("y")).alias("y")))
    of = [*of, "at"]
    points = rows.groupBy(*of).agg((F.sum("hit") / F.nullif(F.sum("y"), F.lit(0))).alias("ap"))
    boots = cut(bootstrap.resampled_share(rows, drawn, of, "hit", "y").withColumnRenamed("share", "ap"))
    apart = bootstrap.paired(boots, points, F.col(model) == selected, model, [*keys, "at"])
    apart = apart.withColumnsRenamed({"lo": "delta_lo", "hi": "delta_hi"})
    return points.withColumnRenamed("ap", "recall").join(bootstrap.interval(boots, of), of).join(apart, of, "left")
