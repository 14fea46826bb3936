"""Ranking metrics that treat equal scores as one cut."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut, if_few, tasks

#: Digits of a score that count; scores are rounded before ties are formed.
DIGITS = 9
#: Distinct scores of a part of a key's range, which one task sorts, and the most parts.
PART, MOST_PARTS = 1_000_000, 256


def tie_groups(rows: DataFrame, keys: Sequence[str], weight: Column | None = None) -> DataFrame:
    """(keys, score, y) -> keys, score, tp, n: weighted positives and rows of each distinct score.

    A partial aggregate: what later windows sort is distinct scores, not rows.
    """
    w = F.lit(1.0) if weight is None else weight
    return rows.groupBy(*keys, to_digits(F.col("score")).alias("score")).agg(F.sum(w * F.col("y")).alias("tp"), F.sum(w).alias("n"))


def tied(rows: DataFrame, keys: Sequence[str], rounded: bool = True) -> DataFrame:
    """(keys, score) -> keys, score (rounded unless more is added to it), n: rows of each distinct score, made once for all that read them.

    With ``weight=F.col("n")`` metrics and resamples of it are those of the rows; y is one of the keys.
    """
    score = to_digits(F.col("score")) if rounded else F.col("score")
    return cut(rows.groupBy(*keys, score.alias("score")).agg(F.count("*").cast("double").alias("n")))


def beside(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """left with the columns of right, whose keys are renamed because both come from the same rows; null equals null."""
    named = right.select(*(F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in right.columns))
    if not on:
        return left.crossJoin(named)  # one row
    return left.join(named, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]).drop(*(f"_{c}" for c in on))


def rows_of_largest(groups: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the key that has most; groups should be cut."""
    sizes = groups.groupBy(*keys).agg(F.count("*").alias("_rows"))
    return sizes.agg(F.coalesce(F.max("_rows"), F.lit(0))).first()[0]


def to_digits(score: Column) -> Column:
    """The score in DIGITS digits; by doubles where they hold it exactly, because Spark's own round makes a decimal of each."""
    return F.when(F.abs(score) < 1e6, F.rint(score * 1e9) / 1e9 + 0.0).otherwise(F.round(score, DIGITS))


def with_part(rows: DataFrame, score: str = "score", most: int = MOST_PARTS) -> DataFrame:
    """rows with ``part``, how many of the rising ``_cuts`` (fewer than ``most``, or null) are below the score: halved, not counted one by one."""
    rows = rows.withColumn("part", F.lit(0))
    for i in reversed(range((most - 1).bit_length())):
        rows = rows.withColumn("part", F.col("part") + F.when(F.get("_cuts", F.col("part") + (1 << i) - 1) < F.col(score), 1 << i).otherwise(0))
    return rows.drop("_cuts")


def ranges(rows: DataFrame, keys: Sequence[str], each: int) -> tuple[DataFrame, int, int]:
    """One number, ``key``, for the keys, their rows and the cuts of their scores (for ``with_part``); all rows there are; the most parts of a key.

    A key has a part for each ``each`` of its rows, up to MOST_PARTS. Rows are read again for the quantiles.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_rows"))
    names = cut(sizes.withColumn("key", F.monotonically_increasing_id()))
    total, most = names.agg(F.coalesce(F.sum("_rows"), F.lit(0)), F.coalesce(F.max("_rows"), F.lit(0))).first()
    if most <= each:
        return names.withColumn("_cuts", F.lit(None).cast("array<double>")), total, 1
    wanted = F.least(F.ceil(F.col("_rows") / each), F.lit(MOST_PARTS)).cast("int")
    large = names.select(*keys, "key", wanted.alias("_wanted")).where("_wanted > 1")
    some = F.transform(F.sequence(F.lit(1), F.col("_wanted") - 1), lambda i: F.col("_all")[F.floor(i * MOST_PARTS / F.col("_wanted")).cast("int") - 1])
    found = beside(rows, if_few(large), keys).groupBy("key").agg(F.percentile_approx("score", [i / MOST_PARTS for i in range(1, MOST_PARTS)]).alias("_all"), F.first("_wanted").alias("_wanted"))
    return cut(names.join(found.select("key", some.alias("_cuts")), "key", "left")), total, MOST_PARTS


def ranked(rows: DataFrame, keys: Sequence[str], weight: Column | None = None) -> DataFrame:
    """(keys, score, y) -> keys, score, tp, n, ctp, cn: each distinct score with the sums from the highest score on.

    Rows move once, in parts of each key's range, and are summed, sorted and offset there; what the parts above
    hold is summed where rows are read. They are read several times, so give rows that are stored, not computed.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    names, total, most = ranges(rows, keys, PART)
    few = if_few(names.select(*keys, "key", "_cuts"))
    parted = beside(rows.select(*keys, to_digits(F.col("score")).alias("score"), (w * F.col("y")).alias("tp"), w.alias("n")), few, keys)
    parted = with_part(parted.select("key", "_cuts", "score", "tp", "n"), most=most)
    before = Window.partitionBy("key").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parted.groupBy("key", "part").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"))
    offsets = cut(offsets.select("key", "part", *(F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"_{c}") for c in ("tp", "n"))))
    moved = parted.repartition(tasks(rows.sparkSession, total), "key", "part").groupBy("key", "part", "score").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"))
    along = Window.partitionBy("key", "part").orderBy(F.desc("score"))
    at = moved.join(if_few(offsets), ["key", "part"]).select("key", "score", "tp", "n", (F.sum("tp").over(along) + F.col("_tp")).alias("ctp"), (F.sum("n").over(along) + F.col("_n")).alias("cn"))
    return at.join(if_few(names.select(*keys, "key")), "key").drop("key")


def in_parts(groups: DataFrame, keys: Sequence[str], score: str = "score", parts: int | None = None) -> DataFrame:
    """groups (cut) with ``part``, rising with the score: ranges of each key's scores, cut at approximate quantiles.

    A key has a part for each PART of its rows (up to MOST_PARTS), or ``parts`` if that is given, so
    that a key with billions of scores isn't sorted in one task. Quantiles are taken of the keys that
    need them only. Results don't depend on the cuts.
    """
    if parts is None and rows_of_largest(groups, keys) <= PART:
        return groups.withColumn("part", F.lit(0))
    fixed = parts or MOST_PARTS
    sizes = groups.groupBy(*keys).agg(F.count("*").alias("_rows"))
    wanted = F.lit(parts) if parts else F.least(F.ceil(F.col("_rows") / PART), F.lit(MOST_PARTS)).cast("int")
    large = beside(groups, sizes.select(*keys, wanted.alias("_wanted")).where("_wanted > 1"), keys)
    some = F.transform(F.sequence(F.lit(1), F.greatest(F.col("_wanted") - 1, F.lit(1))), lambda i: F.col("_all")[F.floor(i * fixed / F.col("_wanted")).cast("int") - 1])
    cuts = large.groupBy(*keys).agg(F.percentile_approx(score, [i / fixed for i in range(1, fixed)] or [0.5]).alias("_all"), F.first("_wanted").alias("_wanted"))
    cuts = cuts.select(*keys, some.alias("_cuts"))
    named = cuts.select(*(F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in cuts.columns))
    named = cut(named)
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys] or F.lit(True)
    return with_part(groups.join(if_few(named, named.count() * fixed), on, "left"), score, fixed).drop(*(f"_{c}" for c in keys))


def running(groups: DataFrame, keys: Sequence[str], parts: int | None = None, sums: dict[str, str] | None = None, totals: dict[str, str] | None = None, score: str = "score", falling: bool = True) -> DataFrame:
    """groups with running sums from the highest score (``falling``) or the lowest, and totals of the keys.

    By default ctp and cn of tp and n, and ptp, the total of tp. Groups are computed once. If no key
    has more than PART of them, one window does it; otherwise parts of a key's range are summed apart
    and offset by the parts before them. The result is the same for any number of parts.
    """
    sums = {"ctp": "tp", "cn": "n"} if sums is None else sums
    totals = {"ptp": "tp"} if totals is None else totals
    order = F.desc if falling else F.asc
    groups, whole = cut(groups), Window.partitionBy(*keys)
    if parts is None and rows_of_largest(groups, keys) <= PART:
        along = whole.orderBy(order(score))
        return groups.withColumns({o: F.sum(c).over(along) for o, c in sums.items()} | {o: F.sum(c).over(whole) for o, c in totals.items()})
    groups = cut(in_parts(groups, keys, score, parts))
    of_part = groups.groupBy(*keys, "part").agg(*(F.sum(c).alias(f"_sum_{o}") for o, c in (sums | totals).items()))
    before = whole.orderBy(order("part")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = [F.coalesce(F.sum(f"_sum_{o}").over(before), F.lit(0)).alias(f"_before_{o}") for o in sums]
    of_part = of_part.select(*keys, "part", *offsets, *(F.sum(f"_sum_{o}").over(whole).alias(o) for o in totals))
    rows = beside(groups, of_part, [*keys, "part"])
    along = Window.partitionBy(*keys, "part").orderBy(order(score))
    return rows.withColumns({o: F.sum(c).over(along) + F.col(f"_before_{o}") for o, c in sums.items()}).drop("part", *(f"_before_{o}" for o in sums))


def average_precision(rows: DataFrame, keys: Sequence[str], weight: Column | None = None, parts: int | None = None) -> DataFrame:
    """keys, ap: the sum over cuts of recall gained times precision; null without weighted positives."""
    at = running(tie_groups(rows, keys, weight), keys, parts)
    gain = F.when(F.col("cn") > 0, F.col("tp") / F.nullif(F.col("ptp"), F.lit(0.0)) * F.col("ctp") / F.col("cn")).otherwise(F.when(F.col("ptp") > 0, 0.0))
    return at.groupBy(*keys).agg(F.sum(gain).alias("ap"))


def average_precision_of_stored(rows: DataFrame, keys: Sequence[str], weight: Column | None = None) -> DataFrame:
    """``average_precision`` of rows that are stored: they move once, and nothing of them is stored again."""
    gain = F.coalesce(F.col("tp") * F.col("ctp") / F.nullif(F.col("cn"), F.lit(0.0)), F.lit(0.0))
    return ranked(rows, keys, weight).groupBy(*keys).agg((F.sum(gain) / F.nullif(F.sum("tp"), F.lit(0.0))).alias("ap"))


def macro(aps: DataFrame, keys: Sequence[str], classes: int) -> DataFrame:
    """keys, macro_skip (mean of the classes that have one), macro_all (null if any class has none)."""
    mean = F.avg("ap")
    return aps.groupBy(*keys).agg(mean.alias("macro_skip"), F.when(F.count("ap") == classes, mean).alias("macro_all"))


def cutoff(rows: DataFrame, keys: Sequence[str], precision: float, weight: Column | None = None) -> DataFrame:
    """keys, cutoff: the lowest score at which all rows above reach the precision; null if none does."""
    return cutoffs(rows, keys, [precision], weight).drop("at")


def cutoffs(rows: DataFrame, keys: Sequence[str], precisions: Sequence[float], weight: Column | None = None) -> DataFrame:
    """keys, at, cutoff at each of the precisions, of one ranking; rows are read several times."""
    lowest = [F.struct(F.lit(float(p)).alias("at"), F.min(F.when(F.col("ctp") / F.col("cn") >= p, F.col("score"))).alias("cutoff")) for p in precisions]
    return ranked(rows, keys, weight).groupBy(*keys).agg(F.array(*lowest).alias("_of")).select(*keys, F.inline("_of"))


def recall_at_precision(val: DataFrame, test: DataFrame, keys: Sequence[str], precision: float, fold: str = "fold", weight: Column | None = None) -> DataFrame:
    """keys, recall, precision, no_cutoff: cutoffs from each fold's validation rows, flags pooled over folds.

    Without a cutoff nothing is flagged, and the fold is counted; without flags precision is null.
    """
    w = F.lit(1.0) if weight is None else weight
    cuts = cut(cutoff(val, [*keys, fold], precision, weight))
    flag = (to_digits(F.col("score")) >= F.col("cutoff")) & F.col("cutoff").isNotNull()
    rows = test.join(if_few(cuts), [*keys, fold], "left").withColumn("flag", F.coalesce(flag, F.lit(False)).cast("int"))
    hit = F.sum(w * F.col("flag") * F.col("y"))
    done = rows.groupBy(*keys).agg((hit / F.nullif(F.sum(w * F.col("y")), F.lit(0.0))).alias("recall"), (hit / F.nullif(F.sum(w * F.col("flag")), F.lit(0.0))).alias("precision"))
    none = cuts.groupBy(*keys).agg(F.count_if(F.col("cutoff").isNull()).alias("no_cutoff"))
    return done.join(none, list(keys))


def average_rank(value: str, keys: Sequence[str] = ()) -> Column:
    """Rank from 1, ties with their mean."""
    by = Window.partitionBy(*keys)
    return F.rank().over(by.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2


def tie_ranks(rows: DataFrame, value: str, keys: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """keys, value, and its rank from 1 (ties share their mean), one row for each distinct value."""
    groups = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    at = running(groups, keys, sums={"_upto": "_n"}, totals={}, score=value, falling=False)
    return at.select(*keys, value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))


def auc(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, auc: of (keys, score, y), by the ranks of the positives; ties count half. Null with one class."""
    groups = rows.groupBy(*keys, "score").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    at = running(groups, keys, sums={"upto": "n"}, totals={}, falling=False)
    rank = F.col("upto") - (F.col("n") - 1) / 2
    sums = at.groupBy(*keys).agg(F.sum(rank * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    p, q = F.col("p"), F.col("n") - F.col("p")
    return sums.select(*keys, ((F.col("r") - p * (p + 1) / 2) / F.nullif(p * q, F.lit(0))).alias("auc"))


def balanced_accuracy(rows: DataFrame, keys: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """keys, balanced_accuracy: the mean of the shares of both classes on their side of the threshold."""
    hit = (F.col("score") >= threshold).cast("int") == F.col("y")
    rate = lambda c: F.avg(F.when(F.col("y") == c, hit.cast("double")))
    return rows.groupBy(*keys).agg(((rate(0) + rate(1)) / 2).alias("balanced_accuracy"))


def spearman(rows: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, rho: correlation of average ranks."""
    pairs = cut(rows.select(*keys, a, b))
    ranked = beside(beside(pairs, tie_ranks(pairs, a, keys, "ra"), [*keys, a]), tie_ranks(pairs, b, keys, "rb"), [*keys, b])
    return ranked.groupBy(*keys).agg(F.corr("ra", "rb").alias("rho"))


def cells(bags: DataFrame, indices: Sequence[str], levels: int, regimes: str = "regime") -> DataFrame:
    """A bag's rows in its (population, positive label) cells: bag columns, kind, class, level, cell_regime, y.

    presence: all bags; level L: those with index 0 or L; regime: those of it. One pass, no join.
    """
    out = []
    none = F.lit(None).cast("string")
    for c, name in enumerate(indices):
        i = F.col(name)
        yes = (i > 0).cast("int")
        make = lambda kind, level, regime, y, c=c: F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("class"), level.cast("int").alias("level"), regime.alias("cell_regime"), y.alias("y"))
        out += [make("presence", F.lit(None), none, yes), make("regime", F.lit(None), F.col(regimes), yes)]
        out += [F.when(i.isin(0, level), make("level", F.lit(level), none, yes)) for level in range(1, levels + 1)]
    return bags.select("*", F.inline(F.filter(F.array(*out), lambda s: s.isNotNull())))
