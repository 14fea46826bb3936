"""Queries of intervals take all resamples of a report, and so does their SQL."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import bootstrap, metrics, reports
from millrace.plans import catalogue, reporting


@pytest.mark.parametrize("name", ["ap_ci", "effect_table", "per_level", "per_regime", "recall_ci", "recall_table", "seed_mean_ci", "transfer_table"])
def test_takes_all_resamples(spark, sf, monkeypatch, name):
    drawn, draws = [], bootstrap.draws
    monkeypatch.setattr(bootstrap, "draws", lambda clusters, resamples, seed=0: drawn.append(resamples) or draws(clusters, 2, seed))
    assert catalogue.QUERIES[name](spark, sf).count() > 0
    assert drawn == [2000]
    assert "range(2000) t(b)" in catalogue.ORACLE_SQL[name]


def test_report_set_moves_a_row_once(spark, monkeypatch):
    """Scores aren't copied for seeds' points or for cells; tables are those of copied rows, which more cells than bits still have."""
    rng = np.random.default_rng(5)
    rows = [(m, s, c, "ab"[i % 2] if i % 9 else None, i // 4, int(rng.integers(0, 4)), float(round(rng.random(), 1))) for m in ("x", "y") for s in range(2) for c in range(2) for i in range(60)]
    df = spark.createDataFrame(rows, "model_id string, seed int, class int, regime string, cluster int, lvl int, score double")
    df = df.withColumns({"stratum": F.lit("s"), "y": (F.col("lvl") > 0).cast("int")})
    drawn, val = bootstrap.draws(df, 6), spark.createDataFrame([("x", 0.5), ("y", 0.4)], "model_id string, val_ap double")
    moved, move = [], bootstrap.point_and_resamples
    monkeypatch.setattr(bootstrap, "point_and_resamples", lambda rows, *a: moved.append(rows.count()) or move(rows, *a))
    once = reports.report_set(df, drawn, val, 3, least=1)
    assert moved == [len(rows)]
    monkeypatch.setattr(reports, "MOST_CELLS", 5)
    copied = reports.report_set(df, drawn, val, 3, least=1)
    assert moved[1] > len(rows)
    plain = lambda t: sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in t.collect())
    for name, table in once.items():
        assert plain(table) == plain(copied[name])
    macros = metrics.average_precision(df, ["model_id", "seed", "class"]).groupBy("model_id").agg(F.avg("ap").alias("ap")).collect()
    over = {r["model_id"]: r["ap"] for r in once["overview"].collect()}
    assert all(math.isclose(over[r["model_id"]], r["ap"], rel_tol=1e-9) for r in macros)


def test_precision_of_stored_rows_is_the_same(spark, monkeypatch):
    monkeypatch.setattr(metrics, "PART", 20)
    rng = np.random.default_rng(6)
    rows = [(f"k{i % 2}", float(round(rng.normal(), 1)), int(rng.random() < 0.3), float(rng.integers(0, 3))) for i in range(300)] + [("none", 0.5, 0, 1.0), ("zero", 0.5, 1, 0.0)]
    df = spark.createDataFrame(rows, "k string, score double, y int, w double")
    got, want = ({r["k"]: r["ap"] for r in f(df, ["k"], F.col("w")).collect()} for f in (metrics.average_precision_of_stored, metrics.average_precision))
    assert got.keys() == want.keys() and got["none"] is None
    assert all(got[k] == want[k] or math.isclose(got[k], want[k], rel_tol=1e-9) for k in got)
