"""Operators on small literal tables: invariants, ties, nulls and edges."""

import datetime as dt
import io
import math
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import scalar as S
from millrace.operators import bags, bootstrap, folds, guards, ingest, lineage, metrics, pooling, reports, runs, training
from millrace.plans import catalogue
from millrace.sources import audio, tables


def instances(spark, rows):
    return spark.createDataFrame(rows, "bag_id long, class int, win_idx int, x double")


def test_pooling_ignores_rows_that_are_not_there(spark):
    rng = np.random.default_rng(0)
    rows = [(b, c, w, float(rng.normal())) for b in range(4) for c in range(2) for w in range(6)]
    cut = [r for r in rows if not (r[0] == 1 and r[2] >= 4)]
    junk = [(1, c, w, 50.0) for c in range(2) for w in range(4, 7)]
    a = pooling.pool(instances(spark, cut)).orderBy("bag_id", "class").collect()
    b = pooling.pool(pooling.truncated(instances(spark, cut + junk), 4).where("bag_id = 1")).orderBy("bag_id", "class").collect()
    assert [r for r in a if r.bag_id == 1] == [r for r in b]


def test_pooling_values(spark):
    x = np.array([0.3, -1.2, 2.0])
    r = pooling.pool(instances(spark, [(1, 0, i, v) for i, v in enumerate(x.tolist())]), r=2.0).first()
    p = 1 / (1 + np.exp(-x))
    q = (p * p).sum() / p.sum()
    assert r["mean"] == pytest.approx(x.mean()) and r["max"] == 2.0
    assert r["lme"] == pytest.approx(np.log(np.exp(2 * x).mean()) / 2)
    assert r["linear_softmax"] == pytest.approx(np.log(q / (1 - q)))


def test_pooling_is_stable_for_large_logits(spark):
    r = pooling.pool(instances(spark, [(1, 0, 0, 900.0), (1, 0, 1, -900.0)])).first()
    assert r["lme"] == pytest.approx(900 - np.log(2)) and np.isfinite(r["linear_softmax"])


def test_weights_sum_to_one_and_first_maximum_wins(spark):
    w = pooling.weights(instances(spark, [(1, 0, 0, 1.0), (1, 0, 1, 2.0), (1, 0, 2, 2.0)])).orderBy("win_idx").toPandas()
    assert w.w_max.tolist() == [0, 1, 0]
    for c in ("w_mean", "w_lme", "w_linear_softmax"):
        assert w[c].sum() == pytest.approx(1)


def ap(y, s, w):
    """Average precision with one cut for equal scores, plainly."""
    total, seen, hit, pos = 0.0, 0.0, 0.0, float((w * y).sum())
    for v in sorted(set(s), reverse=True):
        gain = float((w * y)[s == v].sum())
        hit, seen = hit + gain, seen + float(w[s == v].sum())
        total += gain / pos * hit / seen if seen else 0
    return total if pos else None


@pytest.mark.parametrize("buckets", [1, 5, None])
def test_average_precision_with_ties_and_weights(spark, buckets, monkeypatch):
    monkeypatch.setattr(metrics, "PART", 3)
    rng = np.random.default_rng(1)
    y, s = (rng.random(300) < 0.15).astype(int), np.round(rng.random(300), 1)
    w = rng.integers(0, 3, (4, 300))
    rows = [(k, float(s[i]), int(y[i]), float(w[k, i])) for k in range(4) for i in range(300)] + [(9, 0.5, 0, 1.0), (None, 0.5, 1, 1.0)]
    df = spark.createDataFrame(rows, "k int, score double, y int, w double")
    got = {r["k"]: r["ap"] for r in metrics.average_precision(df, ["k"], F.col("w"), buckets).collect()}
    for k in range(4):
        assert got[k] == pytest.approx(ap(y, s, w[k]))
    assert got[9] is None and got[None] == 1.0


def test_two_macro_rules(spark):
    df = spark.createDataFrame([("a", 0, 0.5), ("a", 1, None), ("b", 0, 0.2), ("b", 1, 0.4)], "m string, class int, ap double")
    got = {r["m"]: (r["macro_skip"], r["macro_all"]) for r in metrics.macro(df, ["m"], 2).collect()}
    assert got["a"] == (0.5, None) and got["b"][1] == pytest.approx(0.3)


def test_cutoff_is_between_distinct_scores_and_null_without_one(spark):
    df = spark.createDataFrame([("a", 0.9, 1), ("a", 0.8, 0), ("a", 0.8, 1), ("a", 0.1, 0), ("b", 0.9, 0)], "k string, score double, y int")
    got = {r["k"]: r["cutoff"] for r in metrics.cutoff(df, ["k"], 0.6).collect()}
    assert got == {"a": 0.8, "b": None}


def test_auc_and_spearman(spark):
    df = spark.createDataFrame([("a", 0.1, 0), ("a", 0.4, 0), ("a", 0.4, 1), ("a", 0.9, 1), ("b", 0.3, 1)], "k string, score double, y int")
    got = {r["k"]: r["auc"] for r in metrics.auc(df, ["k"]).collect()}
    assert got["a"] == pytest.approx(3.5 / 4) and got["b"] is None
    rho = metrics.spearman(spark.createDataFrame([(1.0, 3.0), (2.0, 2.0), (2.0, 2.0), (3.0, 1.0)], "a double, b double"), "a", "b").first()["rho"]
    assert rho == pytest.approx(-1)


def test_draws_keep_strata_whole(spark):
    clusters = spark.createDataFrame([("a", i) for i in range(4)] + [("b", i) for i in range(4, 12)], "stratum string, cluster int")
    d = bootstrap.draws(clusters, 50).toPandas()
    sums = d.groupby(["b", "stratum"])["count"].sum().unstack()
    assert (sums["a"] == 4).all() and (sums["b"] == 8).all() and len(sums) == 50
    assert d[d.stratum == "a"].cluster.max() <= 3
    again = bootstrap.draws(clusters, 50).toPandas()
    assert sorted(map(tuple, again.to_numpy().tolist())) == sorted(map(tuple, d.to_numpy().tolist()))


@pytest.mark.parametrize(("seconds", "partial", "n", "end"), [(60.0, False, 12, 60.0), (59.995, False, 12, 59.995), (59.995, True, 11, 55.0), (62.0, False, 12, 60.0), (2.4, False, 0, None), (2.5, False, 1, 2.5)])
def test_windows(spark, seconds, partial, n, end):
    w = spark.range(1).select(S.windows(F.lit(seconds), 5.0, partial).alias("w")).first()["w"]
    assert len(w) == n and (not n or w[-1]["end_s"] == end)


def test_names(spark):
    names = ["Site_a_20200102_030405.wav", "x_20200102_030405.WAV", "x_20201302_030405.wav", None]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(S.name_parts(F.col("n")).alias("p"), S.is_wav(F.col("n")).alias("w"))
    a, b, c, d = df.collect()
    assert a["p"]["site"] == "Site_a" and a["p"]["start"] == dt.datetime(2020, 1, 2, 3, 4, 5) and a["p"]["offset_in_hour_s"] == 245
    assert b["p"] is None and b["w"] and c["p"] is None and d["p"] is None


def test_labels_and_cells(spark):
    r = spark.range(1).select(S.rate_label(F.lit(8000)).alias("a"), S.rate_label(F.lit(44100)).alias("b"), S.rate_label(F.lit(22050)).alias("c"), S.cell(F.lit(0.5), F.lit(0.1), F.lit(0.9)).alias("d"), S.delta_cell(F.lit(-0.1), F.lit(-0.2), F.lit(-0.05)).alias("e"), S.matches_any(F.lit("lin-1"), ["lin*", "x?"]).alias("f"), S.matches_any(F.lit("alin"), ["lin*"]).alias("g")).first()
    assert list(r) == ["8k", "44k", "22.05k", "0.500 [0.100, 0.900]", "-0.100 [-0.200, -0.050]*", True, False]


def test_mode_ties_go_to_the_first(spark):
    df = spark.createDataFrame([("a", 3, 5), ("a", 2, 1), ("a", 3, 6), ("a", 2, 9)], "k string, v int, t int")
    assert bags.most_common(df, ["k"], "v", "t").first()["v"] == 2


def test_folds(spark):
    rng = np.random.default_rng(0)
    rows = [(b, "ABC"[b // 15], 72, int(rng.integers(0, 9)), int(rng.integers(0, 9))) for b in range(40)]
    stats = spark.createDataFrame(rows, "block int, regime string, bags long, p0 long, p1 long")
    a = folds.assign(stats, ["bags", "p0", "p1"], 5, tries=30).toPandas()
    b = folds.assign(stats, ["bags", "p0", "p1"], 5, tries=30).toPandas()
    assert a.equals(b) and sorted(a.block) == list(range(40))
    t = a.merge(pd.DataFrame(rows, columns=["block", "regime", "bags", "p0", "p1"]))
    assert (t.groupby("regime").fold.nunique() == 5).all()
    deal = spark.createDataFrame([(0, int(x.block), int(x.fold)) for x in a.itertuples()], "deal long, block int, fold int")
    plain = folds._Deal(stats.toPandas(), ["bags", "p0", "p1"], 5).score(dict(zip(a.block, a.fold)))
    assert folds.objective(stats, deal, ["bags", "p0", "p1"], 5).first()["score"] == pytest.approx(plain)


def wav(x, width=2, rate=8000, channels=1):
    f = io.BytesIO()
    with wave.open(f, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(x)
    return f.getvalue()


def test_audio_quality(spark):
    rng = np.random.default_rng(0)
    whole = rng.integers(1, 3000, 2 * 8000 * 4).astype("<i2")
    tail = whole.copy()
    tail[-2 * 8000 * 2 :] = 0
    loud = np.full(16000, 32767, "<i2")
    cases = [wav(whole.tobytes(), channels=2), wav(tail.tobytes(), channels=2), wav(whole.tobytes(), channels=2)[:-1000], b"junk", None, wav(b""), wav(loud.tobytes())]
    df = spark.createDataFrame([(i, bytearray(c) if c is not None else None) for i, c in enumerate(cases)], "i int, c binary")
    r = [x["q"] for x in df.select("i", audio.qc(F.col("c")).alias("q")).orderBy("i").collect()]
    assert [x["qc_ok"] for x in r] == [True, False, False, False, False, False, True]
    assert r[1]["zero_run_s"] == 2.0 and r[1]["qc_reason"] == "digital zero for 2.0 s at the end"
    assert r[2]["truncated"] and r[3]["qc_reason"].startswith("unreadable") and r[5]["qc_reason"] == "empty"
    assert r[6]["qc_reason"] == "clipping" and r[0]["duration_s"] == 4.0


def test_quality_in_blocks(spark, monkeypatch):
    x = np.arange(1, 20001).astype("<i2")
    x[900:9000] = 0
    x[-2500:] = 0
    cases = [(0, bytearray(wav(x.tobytes()))), (1, bytearray(wav(np.zeros(9000, "<i2").tobytes()))), (2, bytearray(wav(x.tobytes())[:-1001]))]
    df = spark.createDataFrame(cases, "i int, c binary").select("i", audio.measured(F.col("c")).alias("m"))
    whole = df.select("i", "m.*").orderBy("i").collect()
    assert [(r["decoded"], r["zero_run"], r["zero_tail"]) for r in whole] == [(20000, 8100, 2500), (9000, 9000, 9000), (19499, 8100, 1999)]
    monkeypatch.setattr(audio, "BLOCK", 1000)
    parts = spark.createDataFrame(cases, "i int, c binary").select("i", audio.measured(F.col("c")).alias("m")).select("i", "m.*").orderBy("i").collect()
    exact = lambda r: tuple(v for k, v in r.asDict().items() if k != "square")
    assert list(map(exact, parts)) == list(map(exact, whole)) and [r["square"] for r in parts] == pytest.approx([r["square"] for r in whole], rel=1e-12)


def test_built_files_are_handed_on_one_by_one(spark, sf):
    """No batch of files is held by a Python function that evaluates a column."""
    plan = catalogue._wavs(spark, sf)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


def test_decode_widths():
    values = np.array([-5, 0, 7, 100])
    raw24 = b"".join(int(v).to_bytes(3, "little", signed=True) for v in values * 1000)
    assert audio.decode(raw24, 3, 1).ravel().tolist() == (values * 1000).tolist()
    assert audio.decode(bytes((values + 128).tolist()), 1, 2).tolist() == [[-5, 0], [7, 100]]
    assert audio.decode(values.astype("<i4").tobytes(), 4, 1).ravel().tolist() == values.tolist()


def test_resampling_keeps_a_tone():
    t = np.sin(2 * np.pi * 440 * np.arange(44100) / 44100)
    out = audio.band_limited(t, 44100, 8000, 32000)
    want = np.sin(2 * np.pi * 440 * np.arange(len(out)) / 32000)
    assert np.abs(out - want)[3000:-3000].max() < 1e-3
    high = np.sin(2 * np.pi * 6000 * np.arange(44100) / 44100)
    assert np.abs(audio.band_limited(high, 44100, 8000, 32000))[3000:-3000].max() < 1e-2
    assert audio.cut_windows(np.ones(10), 4, [0.0, 2.0], 1.0).tolist() == [[1, 1, 1, 1], [1, 1, 0, 0]]


LISTING = [
    ("h1", 1, "up/a_20200101_000000.wav"), ("h2", 1, "up/b_20200101_000000.wav"), ("h2", 1, "1-x - y/b_20200101_000000.wav"),
    ("h3", 1, "up/c_20200101_000000.wav"), ("h4", 1, "p/d_20200101_000000.wav"), ("h5", 1, "q/d_20200101_000000.wav"),
    ("h6", 1, "up/bad name.wav"), ("h7", 1, "up/e_20200101_000000.wav"), (None, 1, "up/f_20200101_000000.wav"), ("h8", 1, "up/notes.txt"), ("h9", 1, "up/g_20200101_000000.WAV"),
]


def test_diff_rules(spark):
    remote = spark.createDataFrame(LISTING, "hash string, size long, path string")
    local = spark.createDataFrame([("a_20200101_000000.wav", "h1"), ("c_20200101_000000.wav", "old")], "name string, hash string")
    replaced = spark.createDataFrame([("h7",)], "hash string")
    got = {(r["hash"], r["path"]): r["category"] for r in ingest.diff(remote, local, replaced).collect()}
    assert got == {
        ("h1", "up/a_20200101_000000.wav"): "local", ("h2", "up/b_20200101_000000.wav"): "new", ("h3", "up/c_20200101_000000.wav"): "clash_local",
        ("h4", "p/d_20200101_000000.wav"): "clash_remote", ("h5", "q/d_20200101_000000.wav"): "clash_remote", ("h6", "up/bad name.wav"): "bad_name",
        ("h7", "up/e_20200101_000000.wav"): "replaced", (None, "up/f_20200101_000000.wav"): "nohash", ("h9", "up/g_20200101_000000.WAV"): "bad_name",
    }
    pulled = ingest.select_for_pull(remote, ingest.diff(remote, local, replaced), "y")
    assert [r["path"] for r in pulled.collect()] == ["1-x - y/b_20200101_000000.wav"]


def test_gap_of_just_the_limit_stays(spark):
    t = dt.datetime(2020, 1, 1)
    df = spark.createDataFrame([(t,), (t + dt.timedelta(hours=48),), (t + dt.timedelta(hours=97),)], "ts timestamp_ntz")
    assert sorted(r["n"] for r in ingest.runs(df, "ts", "48 hours").collect()) == [1, 2]


def test_rekey_and_refresh(spark):
    old = spark.createDataFrame([("a1", "s", True), ("b1", "s", True), ("c1", "s", True)], "instance_id string, file_sig string, done boolean")
    new = spark.createDataFrame([("c1", "s"), ("a1", "CHANGED"), ("d1", "s")], "instance_id string, file_sig string")
    assert {tuple(r) for r in ingest.rekey(new, old).collect()} == {("c1", "keep"), ("a1", "changed"), ("d1", "pending"), ("b1", "dropped")}
    cache = spark.createDataFrame([("x", 1, 1, "hx"), ("y", 1, 1, "hy"), ("z", 1, 1, "hz")], "name string, size long, mtime_ns long, hash string")
    there = spark.createDataFrame([("x", 1, 1), ("y", 2, 1), ("w", 1, 1)], "name string, size long, mtime_ns long")
    assert {r["name"] for r in ingest.stale(cache, there).collect()} == {"y", "w"}
    hashed = spark.createDataFrame([("y", "h2"), ("w", "hw")], "name string, hash string")
    assert {(r["name"], r["hash"]) for r in ingest.refreshed(cache, there, hashed).collect()} == {("x", "hx"), ("y", "h2"), ("w", "hw")}


def test_listing_readers(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("\t5\tdir/a b.wav\nh\t7\tx\ty.wav\n")
    assert [tuple(r) for r in tables.listing(spark, str(tmp_path / "l.tsv")).collect()] == [(None, 5, "dir/a b.wav"), ("h", 7, "x\ty.wav")]
    df = spark.createDataFrame([("abc  two  blanks.wav",)], "v string").select(tables.parse_hashsum(F.col("v")).alias("h")).first()["h"]
    assert tuple(df) == ("abc", "two  blanks.wav")
    (tmp_path / "c.tsv").write_text("# /data\na\t1\t2\th\n")
    assert tables.hash_cache(spark, str(tmp_path / "c.tsv"), "/data").count() == 1
    with pytest.raises(ValueError, match="isn't that of"):
        tables.hash_cache(spark, str(tmp_path / "c.tsv"), "/other")
    (tmp_path / "a.csv").write_text("DateTime,A b,C,Temp\n2020-01-01 00:00:00,2.0,0,11\n")
    row = tables.annotations(spark, str(tmp_path / "a.csv"), ["A b", "C"]).first()
    assert row["hour"] == dt.datetime(2020, 1, 1) and (row["idx_0"], row["idx_1"], row["Temp"], row["RH%"]) == (2, 0, "11", None)


def test_selected_model_prefers_unrestricted(spark):
    rows = [("a", 0, 0.9, "x"), ("b", 1, 0.5, None), ("c", 2, 0.5, None)]
    df = spark.createDataFrame(rows, "model_id string, position int, val_ap double, train_regimes string")
    assert reports.val_selected(df).first()["model_id"] == "b"
    assert reports.val_selected(df.where("model_id = 'a'")).first()["model_id"] == "a"


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([("x", 1), ("y", None)], "n string, s int")
    b = spark.createDataFrame([("y", None), ("x", 1)], "n string, s int")
    assert lineage.fingerprint(a, ["n", "s"]).first() == lineage.fingerprint(b, ["n", "s"]).first()
    assert lineage.fingerprint(a.where("n = 'x'"), ["n", "s"]).first() != lineage.fingerprint(b, ["n", "s"]).first()


@pytest.mark.parametrize("pooling_name", training.POOLERS)
@pytest.mark.parametrize(("hidden", "ordinal"), [(0, 0.0), (4, 0.5)])
def test_gradients(pooling_name, hidden, ordinal):
    rng = np.random.default_rng(0)
    x, mask, index = rng.standard_normal((4, 5, 3)), np.ones((4, 5), bool), rng.integers(0, 4, (4, 2))
    mask[1, 2:] = False
    fit = training.Fit(pooling_name, hidden=hidden, attention=3, r=1.3, ordinal_weight=ordinal)
    p, w = training.start(fit, 3, 2, 3), np.array([1.5, 2.0])
    _, g = training.loss(fit, p, x, mask, index, w)
    for k in p:
        for i in np.ndindex(p[k].shape):
            up, down = ({a: b.copy() for a, b in p.items()} for _ in range(2))
            up[k][i] += 1e-6
            down[k][i] -= 1e-6
            slope = (training.loss(fit, up, x, mask, index, w)[0] - training.loss(fit, down, x, mask, index, w)[0]) / 2e-6
            assert slope == pytest.approx(g[k][i], abs=1e-6)


def test_probe_learns_what_is_planted(spark):
    rng = np.random.default_rng(0)
    rows = []
    for b in range(60):
        v = rng.standard_normal((4 + b % 3, 8))
        index = [int(b % 2), int(b % 3 == 0)]
        v[1, :2] += 4 * index[0]
        v[2, 2:4] += 4 * index[1]
        rows.append((b, (b // 4) % 5, "r", index, v.tolist()))
    df = spark.createDataFrame(rows, "bag_id long, fold int, regime string, index array<int>, vectors array<array<double>>").cache()
    fits = [training.Fit(p, fold=0) for p in ("mean", "max", "attention")]
    settings = training.Settings(epochs=30, check_every=10, rate=0.05)
    params, stats, _ = training.train(df, fits, settings)
    test = training.scores(df, fits, params, stats, settings).where("split = 'test'")
    got = metrics.average_precision(test, ["fit", "class"]).toPandas()
    assert got.ap.min() > 0.6 and got.ap.mean() > 0.85
    assert test.select("bag_id").distinct().count() == sum((b // 4) % 5 == 0 for b in range(60))


def planted(spark, n=60):
    rng, rows = np.random.default_rng(0), []
    for b in range(n):
        v = rng.standard_normal((4 + b % 3, 8))
        index = [int(b % 2), int(b % 3 == 0)]
        v[1, :2] += 4 * index[0]
        v[2, 2:4] += 4 * index[1]
        rows.append((b, (b // 4) % 5, "r", index, v.tolist()))
    return spark.createDataFrame(rows, "bag_id long, fold int, regime string, index array<int>, vectors array<array<double>>").cache()


def test_mini_batches_learn_the_same_in_any_number_of_tasks(spark):
    df, fits = planted(spark, 100), [training.Fit(p, fold=0, learn_r=True) for p in ("mean", "lme", "attention")]
    made = {}
    for tasks in (1, 2, 4, 4):
        settings = training.Settings(epochs=25, rate=0.05, mini=16, tasks=tasks)
        params, stats, best = training.train_batches(df, fits, settings)
        test = training.scores(df, fits, params, stats, settings).where("split = 'test'")
        aps = metrics.average_precision(test, ["fit", "class"]).orderBy("fit", "class").toPandas().ap.to_numpy()
        if tasks == 4 and 4 in made:
            assert all((a[k] == b[k]).all() for a, b in zip(params, made[4][0], strict=True) for k in a) and best == made[4][2]
        made[tasks] = params, aps, best
        assert aps.min() > 0.6 and aps.mean() > 0.85
    for tasks in (2, 4):
        assert np.abs(made[tasks][1] - made[1][1]).max() <= 0.02


def test_dropout_is_of_seed_epoch_and_bag(spark):
    mask = np.ones((2, 3), bool)
    mask[1, 2] = False
    fit = training.Fit(hidden=5, seed=3)
    a, h = training.dropped(fit, 2, np.array([7, 9]), mask, 400, 0.25)
    again, _ = training.dropped(fit, 2, np.array([9]), mask[1:], 400, 0.25)
    assert (a[1] == again[0]).all() and set(np.unique(a[0])) == {0.0, 1 / 0.75} and h.shape == (2, 3, 5)
    assert abs((a[0] == 0).mean() - 0.25) < 0.05 and (a[0] != training.dropped(fit, 3, np.array([7]), mask[:1], 400, 0.25)[0][0]).any()
    assert training.dropped(fit, 2, np.array([7]), mask[:1], 4, 0.0) is None


@pytest.mark.parametrize(("pooling_name", "hidden", "learn"), [("mean", 0, False), ("attention", 4, False), ("lme", 0, True), ("lme", 4, True)])
def test_gradients_under_dropout_and_of_a_learned_r(pooling_name, hidden, learn):
    rng = np.random.default_rng(1)
    x, mask, index = rng.standard_normal((4, 5, 3)), np.ones((4, 5), bool), rng.integers(0, 4, (4, 2))
    mask[1, 2:] = False
    fit = training.Fit(pooling_name, hidden=hidden, attention=3, r=1.3, learn_r=learn)
    p, w = training.start(fit, 3, 2, 3), np.array([1.5, 2.0])
    drop = training.dropped(fit, 1, np.arange(4), mask, 3, 0.3)
    _, g = training.loss(fit, p, x, mask, index, w, None, drop)
    assert ("log_r" in g) == learn
    for k in p:
        for i in np.ndindex(p[k].shape):
            up, down = ({a: b.copy() for a, b in p.items()} for _ in range(2))
            up[k][i] += 1e-6
            down[k][i] -= 1e-6
            slope = (training.loss(fit, up, x, mask, index, w, None, drop)[0] - training.loss(fit, down, x, mask, index, w, None, drop)[0]) / 2e-6
            assert slope == pytest.approx(g[k][i], abs=2e-6)


def test_batches_are_those_of_the_operator(spark):
    df = planted(spark, 40)
    held = training.Held(iter(df.coalesce(1).toArrow().select(["bag_id", "fold", "regime", "index", "vectors"]).to_batches()), 8)
    want = {r["bag_id"]: r["batch"] for r in runs.shuffled_batches(df.select("bag_id"), "bag_id", 10, 3, seed=2).collect()}
    assert dict(zip(held.ids.tolist(), held.batch_of(2, 3, 4).tolist(), strict=True)) == want


def test_window_outputs_give_back_the_bags(spark):
    df = planted(spark, 20)
    fits = [training.Fit(p, fold=f, hidden=h) for p in training.POOLERS for f in (0, 1) for h in (0, 3)]
    params = [training.start(f, 8, 2, 3) for f in fits]
    stats, settings = {(f, None): (np.zeros(8), np.ones(8), None) for f in (0, 1)}, training.Settings(extra={})
    out = training.window_outputs(df, fits, params, stats, settings).toPandas()
    bag = {(r["fit"], r["bag_id"], r["class"]): r["score"] for r in training.scores(df, fits, params, stats, settings).where("split = 'test'").collect()}
    for (i, b, c), rows in out.groupby(["fit", "bag_id", "class"]):
        assert rows.weight.sum() == pytest.approx(1) and rows.win_idx.tolist() == list(range(4 + b % 3))
        logit = np.log(bag[i, b, c] / (1 - bag[i, b, c]))
        if fits[i].pooling in ("mean", "max", "attention"):
            assert (rows.weight * rows.logit).sum() == pytest.approx(logit, abs=1e-6)
    assert len(out.groupby(["fit", "bag_id"])) == sum(fits[i].fold == (b // 4) % 5 for i in range(len(fits)) for b in range(20))


def test_prefixes_are_bags_cut_off(spark):
    rng = np.random.default_rng(2)
    rows = [(b, 0, w, float(v)) for b in range(6) for w, v in enumerate(rng.normal(0, 900 if b % 2 else 2, 9))]
    rows += [(9, 0, w, v) for w, v in enumerate((-2000.0, 255.9, 256.1, -700.0, 800.0))]
    df = instances(spark, rows).withColumn("gate", F.col("x") / 3)
    got = {(r["bag_id"], r["n"]): r for r in pooling.prefixes(df, 1.3).collect()}
    assert len(got) == len(rows)
    for n in range(1, 10):
        short = pooling.truncated(df, n)
        for r in pooling.pool(short, 1.3).join(pooling.attention(short), ["bag_id", "class"]).where(F.col("n") == n).collect():
            for c in ("mean", "max", "lme", "linear_softmax", "attention"):
                assert got[r["bag_id"], n][c] == pytest.approx(r[c], rel=1e-9, abs=1e-9), (r["bag_id"], n, c)


def wav_of(x, rate, channels=1, junk=b""):
    f = io.BytesIO()
    with wave.open(f, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.asarray(x, "<i2").tobytes())
    data = f.getvalue()
    return data[:12] + junk + data[12:]


@pytest.mark.parametrize(("target", "limit"), [(None, 0), (3200, 0), (4000, 1000)])
def test_window_rows_are_those_of_the_whole_file(spark, target, limit):
    rng = np.random.default_rng(0)
    files = {"a": (rng.integers(-9000, 9000, 8000 * 5 + 5000), 8000, 1), "b": (rng.integers(-9000, 9000, 2 * 4410 * 3), 4410, 2), "c": (rng.integers(-9, 9, 300), 8000, 1)}
    rows = [(k, wav_of(x, r, c, b"LIST\x03\x00\x00\x00abc\x00" if k == "b" else b"")) for k, (x, r, c) in files.items()]
    cut = rows[0][1][: -8000]
    df = spark.createDataFrame([*rows, ("cut", cut), ("none", None), ("junk", b"RIFFxxxx"), ("empty", b"")], "k string, content binary")
    got = {}
    for r in audio.window_rows(df, ["k"], 1.0, target, limit).collect():
        got.setdefault(r["k"], {})[r["win_idx"]] = np.array(r["samples"])
    assert set(got) == {"a", "b", "cut"} and len(got["a"]) == 6 and len(got["cut"]) == 5 and len(got["b"]) == 3
    for k in ("a", "b"):
        x, rate, channels = files[k]
        to = target or rate
        whole = audio.band_limited(x.reshape(-1, channels).mean(axis=1) / 32768, rate, limit, to)
        want = audio.cut_windows(whole, to, [float(i) for i in got[k]], 1.0)
        for i, w in enumerate(want):
            assert got[k][i] == pytest.approx(w, abs=1e-9)


def test_windows_leave_in_small_batches(spark, monkeypatch):
    """Files don't wait for an answer of Python, and the windows of one needn't leave together."""
    df = spark.createDataFrame([(k, bytearray(wav_of(np.arange(8000 * 5 + 4000 * k) % 999, 8000)), [0, 4, 5]) for k in range(3)], "k int, content binary, wins array<int>")
    once = sorted(map(tuple, audio.window_rows(df, ["k"], 1.0).collect()))
    assert [r[:2] for r in once] == [(k, i) for k in range(3) for i in range(5 + (k > 0))]
    assert [tuple(r) for r in audio.window_grid(df, ["k"], 1.0).orderBy("k", "win_idx").collect()] == [r[:4] for r in once]
    monkeypatch.setattr(audio, "OUT", 1)
    single = audio.window_rows(df, ["k"], 1.0)
    assert sorted(map(tuple, single.collect())) == once and "ArrowEvalPython" not in single._jdf.queryExecution().toString()
    assert sorted(r[:2] for r in map(tuple, audio.window_rows(df, ["k"], 1.0, only="wins").collect())) == [r[:2] for r in once if r[1] in (0, 4, 5)]


def test_shares_and_precision_in_blocks_of_resamples(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [("m", "ab"[i % 2], int(rng.integers(0, 9)), float(np.round(rng.random(), 2)), int(rng.random() < 0.4)) for i in range(200)]
    df = spark.createDataFrame(rows, "m string, stratum string, cluster int, score double, y int").withColumn("hit", F.when(F.col("score") > 0.5, F.col("y")).otherwise(0))
    drawn = bootstrap.draws(df, 11).cache()
    once = sorted(map(tuple, bootstrap.resampled_ap(df, drawn, ["m"]).collect())), sorted(map(tuple, bootstrap.resampled_share(df, drawn, ["m"], "hit", "y").collect()))
    joined = df.join(drawn, ["stratum", "cluster"]).groupBy("m", "b").agg((F.sum(F.col("hit") * F.col("count")) / F.sum(F.col("y") * F.col("count"))).alias("share"))
    assert once[1] == [(*t[:2], pytest.approx(t[2])) for t in sorted(map(tuple, joined.collect()))]
    monkeypatch.setattr(bootstrap, "COUNTS", 60)
    blocks = sorted(map(tuple, bootstrap.resampled_ap(df, drawn, ["m"]).collect())), sorted(map(tuple, bootstrap.resampled_share(df, drawn, ["m"], "hit", "y").collect()))
    assert blocks == once and len(once[0]) == 11


def test_quality_is_read_again_of_changed_files_only(spark, tmp_path):
    import os

    for name in "abc":
        (tmp_path / f"{name}.wav").write_bytes(wav_of(np.arange(1, 4000), 8000))
    first = audio.qc_refreshed(spark, str(tmp_path), None)
    first.write.parquet(str(tmp_path / "v1"))
    cache = spark.read.parquet(str(tmp_path / "v1"))
    assert cache.where("qc_ok").count() == 3
    # a's bytes are spoilt but its name, size and time stay, so nothing may have read it; b changes, c goes, d comes
    a, at = tmp_path / "a.wav", os.stat(tmp_path / "a.wav")
    a.write_bytes(b"x" * at.st_size)
    os.utime(a, ns=(at.st_atime_ns, at.st_mtime_ns))
    (tmp_path / "b.wav").write_bytes(wav_of(np.zeros(16000), 8000))
    (tmp_path / "c.wav").unlink()
    (tmp_path / "d.wav").write_bytes(wav_of(np.arange(1, 5000), 8000))
    got = {r["name"]: r["qc_ok"] for r in audio.qc_refreshed(spark, str(tmp_path), cache).collect()}
    assert got == {"a.wav": True, "b.wav": False, "d.wav": True}


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 8
    assert set(e.oracle_sql()) <= set(e.queries())


def test_resampled_ap_is_that_of_each_resample(spark, monkeypatch):
    """All resamples in one pass, with ties over clusters, many parts and small slabs, against one by one."""
    monkeypatch.setattr(metrics, "PART", 20)
    monkeypatch.setattr(bootstrap, "_SLAB", 7)
    rng = np.random.default_rng(3)
    rows = [(m, "ab"[i % 2], int(rng.integers(0, 9)), float(np.round(rng.random(), 2)), int(rng.random() < 0.2)) for m in ("x", None) for i in range(400)]
    rows += [("none", "a", 1, 0.5, 0)]
    df = spark.createDataFrame(rows, "m string, stratum string, cluster int, score double, y int")
    drawn = bootstrap.draws(df, 30)
    counts = {(r["b"], r["stratum"], r["cluster"]): r["count"] for r in drawn.collect()}
    got = {(r["m"], r["b"]): r["ap"] for r in bootstrap.resampled_ap(df, drawn, ["m"]).collect()}
    assert len(got) == 90
    for m in ("x", None, "none"):
        mine = [r for r in rows if r[0] == m]
        s, y = np.array([r[3] for r in mine]), np.array([r[4] for r in mine])
        for b in range(30):
            w = np.array([float(counts.get((b, r[1], r[2]), 0)) for r in mine])
            want = ap(y, s, w) if (w * y).sum() else None
            assert got[m, b] == (want if want is None else pytest.approx(want))


def test_sums_above_parts_take_no_row_of_counts_each(monkeypatch):
    """Memory goes with clusters and a block of resamples, not with rows times resamples."""
    import tracemalloc

    rng = np.random.default_rng(3)
    part, place = np.repeat(np.arange(40), 500), np.tile(np.arange(500), 40)
    pos, n, counts = rng.integers(0, 3, 20000).astype(float), np.ones(20000), rng.integers(0, 3, (500, 300)).astype(np.int16)
    monkeypatch.setattr(bootstrap, "_SUMS", 3000)
    tracemalloc.start()
    got = {p: (tp, cn) for p, tp, cn in bootstrap._above(part, place, pos, n, counts)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4e6 < 20000 * 300 and sorted(got) == list(range(40))
    for p in (0, 17, 39):
        over = part > p
        assert got[p][0] == pytest.approx(pos[over] @ counts[place[over]]) and got[p][1] == pytest.approx(n[over] @ counts[place[over]])


def test_lines_move_once_for_all_pooled_scores(spark, sf):
    from millrace.plans import grounding

    plan = grounding.scored(spark, sf)._jdf.queryExecution().executedPlan().toString()
    moves = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moves and not any("class#" in line for line in moves), plan


def test_top_share_breaks_ties_by_order(spark, monkeypatch):
    monkeypatch.setattr(metrics, "PART", 2)
    rng = np.random.default_rng(0)
    rows = [(i, int(rng.integers(0, 4)), float(rng.integers(0, 6))) for i in range(101)]
    df = spark.createDataFrame(rows, "i long, a int, score double")
    for f in (0.0, 0.05, 0.3, 1.0):
        want = {r[0] for r in sorted(rows, key=lambda r: (-r[2], r[1], r[0]))[: int(np.ceil(f * 101))]}
        assert {r["i"] for r in reports.top_share(df, "score", f, "a", "i").where("top").collect()} == want


def test_guards(spark):
    bags = spark.createDataFrame([(1, "a"), (2, "b")], "bag_id long, regime string")
    windows = spark.createDataFrame([(1, 1, [2.0]), (1, 0, [1.0])], "bag_id long, win_idx int, vector array<double>")
    with pytest.raises(ValueError, match="bags without windows: bag_id=2"):
        guards.load_bags(bags, windows)
    assert guards.load_bags(bags.where("bag_id = 1"), windows).first()["vectors"] == [[1.0], [2.0]]
    with pytest.raises(ValueError, match="regime=x"):
        guards.restricted(bags, ["a", "x"])
    assert guards.restricted(bags, ["a"]).count() == 1 and guards.restricted(bags, None).count() == 2
    good = [("d", "r", "mean", 0, 0, b, 0.5) for b in (1, 2)]
    schema = "dataset_id string, run_id string, pooling string, seed int, class int, bag_id long, score double"
    assert guards.load_models(spark.createDataFrame(good, schema), bags, "d").count() == 2
    for bad in (good[:1], good + good[:1], [("e", *good[0][1:]), good[1]], [*good, (*good[0][:5], 9, 0.1)]):
        with pytest.raises(ValueError, match="don't fit"):
            guards.load_models(spark.createDataFrame(bad, schema), bags, "d")
    scores = spark.createDataFrame([("m", 1, "test"), ("m", 2, "val"), ("k", 1, "test"), ("k", 2, "test"), ("k", 2, "test")], "model string, bag_id long, split string")
    assert {(r["model"], r["bag_id"], r["n"]) for r in guards.unscored(bags, scores, ["model"]).collect()} == {("m", 2, 0), ("k", 2, 2)}


def test_runs_are_kept_by_key(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    key = {"B": 20, "ids": ["a"]}
    assert runs.kept(spark, str(tmp_path), key, make).count() == 3 and runs.kept(spark, str(tmp_path), key, make).count() == 3 and len(made) == 1
    runs.kept(spark, str(tmp_path), {"B": 21}, make)
    assert len(made) == 2
    runs.archived(spark.range(2), str(tmp_path / "old"), "d1")
    with pytest.raises(Exception, match="exists"):
        runs.archived(spark.range(2), str(tmp_path / "old"), "d1")
    (tmp_path / "code").mkdir()
    (tmp_path / "code" / "a.py").write_text("x = 1")
    before = runs.code_version(spark, str(tmp_path / "code"))
    assert before == runs.code_version(spark, str(tmp_path / "code"))
    (tmp_path / "code" / "a.py").write_text("x = 2")
    assert before != runs.code_version(spark, str(tmp_path / "code"))


def test_weights_come_back_and_are_counted(spark):
    fits = [training.Fit("attention", hidden=4, ordinal_weight=0.5, fold=1), training.Fit("mean")]
    params = [training.start(f, 6, 2, 3) for f in fits]
    t = runs.weights_table(spark, fits, params)
    back = runs.load_weights(t, fits[0].run_id, "attention", 0, 1)
    assert set(back) == set(params[0]) and all((back[k] == params[0][k]).all() for k in back)
    with pytest.raises(KeyError):
        runs.load_weights(t, "linear-bin", "max", 0, 0)
    for f, p in zip(fits, params):
        n = runs.parameter_count(F.lit(6), 2, F.lit(f.hidden), 3, F.lit(f.ordinal_weight), F.lit(f.pooling), f.attention)
        assert spark.range(1).select(n.alias("n")).first()["n"] == sum(v.size for v in p.values())


def test_block_hash_is_that_of_blocks(spark):
    import hashlib

    data = bytes(range(256)) * 10
    want = hashlib.sha256(b"".join(hashlib.sha256(data[i : i + 100]).digest() for i in range(0, len(data), 100))).hexdigest()
    df = spark.createDataFrame([(bytearray(data),), (bytearray(),)], "c binary").select(ingest.block_hash(F.col("c"), 100).alias("h"))
    assert [r["h"] for r in df.collect()] == [want, hashlib.sha256(b"").hexdigest()]


def test_report_set(spark):
    rng = np.random.default_rng(0)
    rows = [(m, s, c, "ab"[i % 2], i // 4, int(rng.integers(0, 4)), float(rng.random())) for m in ("x", "y") for s in range(2) for c in range(2) for i in range(80)]
    df = spark.createDataFrame(rows, "model_id string, seed int, class int, regime string, cluster int, lvl int, score double")
    df = df.withColumns({"stratum": F.col("regime"), "y": (F.col("lvl") > 0).cast("int")})
    val = spark.createDataFrame([("x", 0.5), ("y", 0.4)], "model_id string, val_ap double")
    tables = reports.report_set(df, bootstrap.draws(df, 10), val, 3)
    over = {r["model_id"]: r for r in tables["overview"].collect()}
    assert over["x"]["selected"] and not over["y"]["selected"] and over["x"]["n_seeds"] == 2
    assert all(r["lo"] <= r["hi"] for r in over.values())
    assert {(r["model_id"], r["verdict"] in ("tied", "better", "worse")) for r in tables["vs_selected"].collect()} == {("y", True)}
    assert tables["per_regime"].count() == 2 * 2 * 2 and tables["per_level"].where("n_pos < 5").count() == 0


def test_gelu_is_exact_to_seven_digits(spark):
    import math

    x = np.linspace(-6, 6, 97)
    df = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", S.gelu(F.col("x")).alias("g"))
    assert all(abs(r["g"] - 0.5 * r["x"] * (1 + math.erf(r["x"] / math.sqrt(2)))) < 1e-6 for r in df.collect())


def test_decoding_tells_regimes_apart(spark):
    import datetime as dt

    from millrace.operators import decoding

    rng = np.random.default_rng(0)
    rows = [(i % 3, i % 2, (rng.standard_normal(4) + [2.5 * (i % 2), 0, 0, 0]).tolist(), dt.datetime(2020, 1 + i % 2 * (i % 4 // 2), 1)) for i in range(240)]
    df = spark.createDataFrame(rows, "fold int, y int, vector array<double>, ts timestamp_ntz")
    got = decoding.regime_decoding(df, 3).collect()
    assert len(got) == 3 and all(r["auc"] > 0.9 and r["balanced_accuracy"] > 0.8 and r["n"] == 80 for r in got)
    assert sum(r["n"] for r in decoding.regime_decoding(df, 3, months=[1]).collect()) == sum(r[3].month == 1 for r in rows)
    assert decoding.regime_decoding(df, 3, months=[7]).count() == 0


def test_weights_stand_for_rows(spark):
    """Metrics and resamples of summed rows are those of the rows; sums by cluster, and no row, go into a recall's shares."""
    rng = np.random.default_rng(8)
    rows = [("mk"[i % 2], i % 3, "ab"[i % 2], int(rng.integers(0, 6)), float(np.round(rng.random(), 1)), int(rng.random() < 0.4)) for i in range(240)]
    df = spark.createDataFrame(rows, "m string, fold int, stratum string, cluster int, score double, y int").withColumn("class", F.lit(0))
    keys, n = ["m", "class"], F.col("n")
    few = metrics.tied(df, [*keys, "fold", "stratum", "cluster", "y"])
    assert few.count() < 240 and few.agg(F.sum("n")).first()[0] == 240
    drawn = bootstrap.draws(df, 7)
    plain = lambda t: [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in sorted(map(tuple, t.collect()), key=str)]
    assert plain(metrics.cutoff(few, ["m"], 0.5, n)) == plain(metrics.cutoff(df, ["m"], 0.5))
    assert plain(metrics.recall_at_precision(few, few, keys, 0.5, weight=n)) == plain(metrics.recall_at_precision(df, df, keys, 0.5))
    assert plain(bootstrap.resampled_ap(few, drawn, keys, n)) == plain(bootstrap.resampled_ap(df, drawn, keys))
    assert plain(reports.recall_table(few, few, drawn, [0.4, 0.5], "m", "m", weight=n)) == plain(reports.recall_table(df, df, drawn, [0.4, 0.5], "m", "m"))


def test_tasks_hold_a_bounded_number_of_lines(spark, sf, monkeypatch):
    from millrace.plans import grounding

    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    monkeypatch.setattr(grounding, "LINES", lines // 10)
    assert grounding.wide_instances(spark, sf).rdd.getNumPartitions() >= 10


def test_seeded_cache_joins_by_size_too(spark):
    hashes = spark.createDataFrame([("a", "h1"), ("a", "h2"), ("b", "h1"), ("a", "h1")], "name string, hash string")
    files = spark.createDataFrame([("a", 1, 5, 1), ("a", 2, 6, 1), ("b", 1, 7, 9)], "name string, size long, mtime_ns long, ctime_ns long")
    listing = spark.createDataFrame([("h1", 1), ("h1", 1), ("h2", 2), (None, 1)], "hash string, size long")
    out = ingest.seeded_cache(hashes, 6, listing, files)
    assert sorted(map(tuple, out.collect())) == [("a", 1, 5, "h1"), ("a", 1, 5, "h1"), ("a", 2, 6, "h2")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan  # the join by name alone made every pair of files of a name


def test_points_cells_and_cutoffs_of_one_move(spark, monkeypatch):
    """Rows aren't copied for cells, points come with the resamples, and several precisions have one ranking; in many parts."""
    monkeypatch.setattr(bootstrap, "ROWS", 20)
    monkeypatch.setattr(metrics, "PART", 20)
    rng = np.random.default_rng(3)
    rows = [(f"m{i % 2}", "s", int(i % 9), int(i // 2 % 4), float(round(rng.normal(), 1)), int(rng.random() < 0.3)) for i in range(400)]
    df = spark.createDataFrame(rows, "m string, stratum string, cluster int, lvl int, score double, y int")
    drawn = bootstrap.draws(df.where("cluster < 8"), 5)  # cluster 8 is never drawn and counts for the points alone
    cells = reports.level_cells(3)
    points, boots = bootstrap.point_and_resamples(df, drawn, ["m"], cells=cells)
    celled = reports.in_cells(df, 3, regime="stratum", kinds=["level"])
    plain = lambda d, by: {tuple(r[c] for c in by): r["ap"] for r in d.collect()}
    for got, want, by in ((points, metrics.average_precision(celled, ["m", "cell"]), ["m", "cell"]), (boots, bootstrap.resampled_ap(celled, drawn, ["m", "cell"]), ["m", "cell", "b"])):
        got, want = plain(got, by), plain(want, by)
        assert got.keys() == want.keys() and len(got) == 6 * (5 if "b" in by else 1)
        assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in got)
    cuts = {(r["m"], r["at"]): r["cutoff"] for r in metrics.cutoffs(df, ["m"], [0.3, 0.4]).collect()}
    at = metrics.running(metrics.tie_groups(df, ["m"]), ["m"], 1)
    for p in (0.3, 0.4):
        for r in at.groupBy("m").agg(F.min(F.when(F.col("ctp") / F.col("cn") >= p, F.col("score"))).alias("c")).collect():
            assert cuts[r["m"], p] == r["c"]
    few = spark.createDataFrame([(s / 2, [0.0, 1.0, 1.0, 2.0]) for s in range(-2, 7)] + [(1.0, None)], "score double, _cuts array<double>")
    assert [r["part"] for r in metrics.with_part(few, most=5).collect()] == [0, 0, 0, 1, 1, 3, 3, 4, 4, 0]
