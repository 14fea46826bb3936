"""Column expressions: numbers, names, times and text cells."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Probabilities stay this far from 0 and 1 before a logit.
EPS = 1e-6
# Fixed value: site_YYYYMMDD_HHMMSS.wav, case-sensitive
NAME = r"^(.+)_(\d{8})_(\d{6})\.wav$"


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def safe_logit(p: Column, eps: float = EPS) -> Column:
    p = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(p) - F.log1p(-p)


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


# A rational approximation of the error function, right to 1.5e-7.
ERF_SCALE = 0.3275911
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    """Spark has no error function; this one is right to 1.5e-7."""
    t = 1 / (1 + ERF_SCALE * F.abs(x))
    series = F.lit(0.0)
    for a in reversed(ERF):
        series = t * (series + a)
    return F.signum(x) * (1 - series * F.exp(-x * x))


def gelu(x: Column) -> Column:
    return 0.5 * x * (1 + erf(x / math.sqrt(2)))


def rate_label(rate: Column) -> Column:
    """8000 -> 8k, 44100 -> 44k, others with their decimals."""
    plain = F.regexp_replace(F.format_string("%.3f", rate / 1000), r"\.?0+$", "")
    return F.when(rate == 44100, "44k").otherwise(F.concat(plain, F.lit("k")))


def name_parts(name: Column) -> Column:
    """Struct site, start (timestamp without zone), offset_in_hour_s; null if the name is not of the form."""
    part = lambda i: F.regexp_extract(name, NAME, i)
    start = F.try_to_timestamp(F.concat(part(2), part(3)), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    fields = F.struct(part(1).alias("site"), start.alias("start"), (F.minute(start) * 60 + F.second(start)).alias("offset_in_hour_s"))
    return F.when(name.rlike(NAME) & start.isNotNull(), fields)


def is_wav(name: Column) -> Column:
    return F.lower(name).endswith(".wav")


def windows(duration_s: Column, width_s: float, drop_partial: bool = False) -> Column:
    """Array of (win_idx, start_s, end_s): contiguous windows; the tail stays if at least half full.

    In whole milliseconds, so that no width accumulates rounding. Null durations give null.
    """
    w = round(width_s * 1000)
    d = F.round(duration_s * 1000).cast("long")
    full = F.floor(d / w)
    tail = F.lit(0) if drop_partial else ((d - full * w) * 2 >= w).cast("int")
    n = (full + tail).cast("int")
    cell = lambda i: F.struct(i.alias("win_idx"), (i * w / 1000).alias("start_s"), (F.least((i + 1) * w, d) / 1000).alias("end_s"))
    none = F.array().cast("array<struct<win_idx:int,start_s:double,end_s:double>>")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), cell)).when(n.isNotNull(), none)


def block(day: Column, first: Column, days: int = 3) -> Column:
    return F.floor(F.datediff(day, first) / days).cast("int")


def night(ts: Column) -> Column:
    """Noon to noon: the date of the evening."""
    return F.to_date(ts - F.expr("interval 12 hours"))


def ordinal_logits(score: Column, gaps: list[float]) -> list[Column]:
    """Logits of level >= 1, 2, ...: the score less rising thresholds 0, softplus(g1), + softplus(g2) ..."""
    out, at = [score], F.lit(0.0)
    for g in gaps:
        at = at + softplus(F.lit(float(g)))
        out.append(score - at)
    return out


def cell(v: Column, lo: Column | None = None, hi: Column | None = None, star: Column | None = None) -> Column:
    """x.xxx, with [lo, hi] and a star if given; a dash for null."""
    s = F.format_string("%.3f", v) if lo is None else F.format_string("%.3f [%.3f, %.3f]", v, lo, hi)
    s = s if star is None else F.concat(s, F.when(star, "*").otherwise(""))
    return F.when(v.isNull(), "–").otherwise(s)


def delta_cell(v: Column, lo: Column, hi: Column) -> Column:
    """A signed difference with its interval; a star if that leaves out 0."""
    return F.concat(F.format_string("%+.3f [%+.3f, %+.3f]", v, lo, hi), F.when((lo > 0) | (hi < 0), "*").otherwise(""))


def markdown_row(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(c.cast("string"), F.lit("")) for c in cells)), F.lit(" |"))


def matches_any(name: Column, globs: list[str]) -> Column:
    """True if a name matches one of some shell patterns (* and ?)."""
    import fnmatch

    rules = [fnmatch.translate(g).replace(r"\z", r"\Z") for g in globs]
    return name.rlike("|".join(f"(?:{re.sub(r'^\(\?s:(.*)\)\\Z$', r'(?s:^\1$)', r)})" for r in rules)) if rules else F.lit(False)
