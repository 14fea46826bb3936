"""Nights in columns with long gaps collapsed, and short descriptions of file sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def night_columns(rows: DataFrame, night: str, keys: Sequence[str] = (), gap_days: int = 7, gap_columns: int = 3) -> DataFrame:
    """keys, night, segment, column: each distinct night's place on an axis of days.

    A run of more than ``gap_days`` days between two nights starts a new segment, set off by
    ``gap_columns`` columns; within a segment a day is a column. Nights are few beside rows.
    """
    nights = rows.select(*keys, F.col(night).alias("night")).distinct()
    by = Window.partitionBy(*keys).orderBy("night")
    before = F.lag("night").over(by)
    step = F.datediff("night", before)
    fresh = F.coalesce(step > gap_days, F.lit(False))
    jump = F.when(fresh, 1 + gap_columns).otherwise(F.coalesce(step, F.lit(0)))
    return nights.withColumns({"_fresh": fresh.cast("int"), "_jump": jump}).select(
        *keys, "night", F.sum("_fresh").over(by).cast("int").alias("segment"), F.sum("_jump").over(by).cast("int").alias("column"))


def month_ticks(columns: DataFrame, keys: Sequence[str] = (), near: int = 12) -> DataFrame:
    """keys, segment, night, column of axis ticks: firsts of months, and a segment's first night unless a month begins within ``near`` columns."""
    of = Window.partitionBy(*keys, "segment")
    monthly = F.dayofmonth("night") == 1
    start, month = F.min("column").over(of), F.min(F.when(monthly, F.col("column"))).over(of)
    opens = (F.col("column") == start) & (month.isNull() | (month - start > near))
    return columns.withColumn("_tick", monthly | opens).where("_tick").select(*keys, "segment", "night", "column")


def breaks(columns: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, segment, first_missing, last_missing: the nights left out before each segment but the first."""
    ends = columns.groupBy(*keys, "segment").agg(F.min("night").alias("first"), F.max("night").alias("last"))
    last = F.lag("last").over(Window.partitionBy(*keys).orderBy("segment"))
    out = ends.select(*keys, "segment", F.date_add(last, 1).alias("first_missing"), F.date_sub("first", 1).alias("last_missing"))
    return out.where("first_missing is not null")


def grid(rows: DataFrame, row: str, column: str, columns: Sequence, value: Column, keys: Sequence[str] = (), fill=0) -> DataFrame:
    """keys, row and a column for each of ``columns`` with ``value``, an aggregate; ``fill`` where there is nothing.

    The list of columns is given, so no pass over the data finds it, and a night without rows has its column.
    """
    wide = rows.groupBy(*keys, row).pivot(column, list(columns)).agg(value)
    return wide.na.fill(fill, [str(c) for c in columns])


def first_of_night(bags: DataFrame, night: Column, at: str, *columns: str) -> DataFrame:
    """night and the columns of its first bag."""
    first = F.min_by(F.struct(*columns), F.col(at))
    return bags.groupBy(night.alias("night")).agg(first.alias("f")).select("night", "f.*")


def format_label(rate: Column, channels: Column, seconds: Column) -> Column:
    """8 kHz mono 60 s"""
    khz = F.regexp_replace(F.format_string("%.3f", rate / 1000), r"\.?0+$", "")
    kind = F.when(channels == 1, "mono").when(channels == 2, "stereo").otherwise(F.concat(channels.cast("string"), F.lit(" ch")))
    return F.concat_ws(" ", khz, F.lit("kHz"), kind, F.format_string("%.0f s", seconds))


def describe(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, files, gb, text: time range, files an hour (fewest-most) and formats of each group.

    (start, size, rate, channels, seconds) with any of them null. Two-level aggregates; nothing is
    collected but a group's distinct formats.
    """
    hour = files.where("start is not null").groupBy(*keys, F.date_trunc("hour", "start").alias("h")).agg(F.count("*").alias("n"))
    per = hour.groupBy(*keys).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    label = F.when(F.col("rate") > 0, format_label(F.col("rate"), F.col("channels"), F.col("seconds")))
    formats = files.select(*keys, label.alias("f")).where("f is not null").groupBy(*keys, "f").agg(F.count("*").alias("n"))
    formats = formats.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "f"))).alias("fs"))
    listed = F.array_join(F.transform("fs", lambda s: F.concat(s["f"], F.lit(" ("), (-s["n"]).cast("string"), F.lit(")"))), " + ")
    fmt = F.when(F.size("fs") == 1, F.col("fs")[0]["f"]).otherwise(listed)
    whole = files.groupBy(*keys).agg(F.count("*").alias("files"), (F.sum("size") / 1e9).alias("gb"), F.min("start").alias("a"), F.max("start").alias("b"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    number = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", "lo", "hi"))
    rate = F.coalesce(F.concat(number, F.when(F.col("hi") > 1, " clips/hour").otherwise(" clip/hour")), F.lit("no dated files"))
    text = F.concat_ws(", ", F.concat(day("a"), F.lit(" -> "), day("b")), rate, fmt)
    return whole.join(per, list(keys), "left").join(formats, list(keys), "left").select(*keys, "files", "gb", text.alias("text"))


