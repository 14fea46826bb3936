"""Merging verified files: refusals as of now, stops between two moves, nothing overwritten."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from millrace.operators import merge

LATER = dt.datetime(2100, 1, 1)


@pytest.fixture
def roots(tmp_path):
    r = merge.Roots(*(str(tmp_path / f) for f in ("staging", "library", "aside")))
    for f in (r.staging, r.library, r.aside):
        os.makedirs(f)
    return r


def put(folder, **files):
    for name, content in files.items():
        with open(f"{folder}/{name}.wav", "w") as f:
            f.write(content)


def there(folder):
    return {n: open(f"{folder}/{n}").read() for n in os.listdir(folder) if n.endswith(".wav")}


def report(spark, *names, ok=True):
    return spark.createDataFrame([(f"{n}.wav", ok, "" if ok else "qc: silent", f"h{n}") for n in names], "name string, ok boolean, fail string, hash string")


def test_files_move_and_old_copies_go_aside(spark, roots, tmp_path):
    put(roots.staging, a="new a", b="new b")
    put(roots.library, a="old", z="z")
    with pytest.raises(ValueError, match="a.wav, reason=would replace"):
        merge.merge(spark, report(spark, "a", "b"), F.lit(LATER).cast("timestamp"), roots, f"{tmp_path}/j1", "d")
    assert set(there(roots.staging)) == {"a.wav", "b.wav"}  # nothing has moved
    out = merge.merge(spark, report(spark, "a", "b"), F.lit(LATER).cast("timestamp"), roots, f"{tmp_path}/j2", "d", replace=True)
    assert {(r["step"], r["name"], r["outcome"]) for r in out.collect()} == {(0, "a.wav", "moved"), (1, "a.wav", "moved"), (1, "b.wav", "moved")}
    assert there(roots.library) == {"a.wav": "new a", "b.wav": "new b", "z.wav": "z"} and there(roots.aside) == {"a.replaced_d.wav": "old"}
    # a merge that is done is not done again
    put(roots.staging, a="newer a")
    merge.merge(spark, report(spark, "a", "b"), F.lit(LATER).cast("timestamp"), roots, f"{tmp_path}/j2", "d", replace=True)
    assert there(roots.library)["a.wav"] == "new a"


@pytest.mark.parametrize("stop", [0, 1, 2, 3, 4])
def test_stopped_between_two_moves(spark, roots, tmp_path, monkeypatch, stop):
    put(roots.staging, a="new a", b="new b", c="new c")
    put(roots.library, a="old a", b="old b")
    plain = merge.carry_out

    def stopped(plan):
        some = plan.orderBy("name").limit(max(0, stop - 2 * plan.where("step = 1").limit(1).count()))
        plain(some).collect()
        raise RuntimeError("stopped")

    def after_first(plan):
        return plain(plan) if plan.where("step = 0").count() and stop >= 2 else stopped(plan)

    monkeypatch.setattr(merge, "carry_out", after_first)
    verified = report(spark, "a", "b", "c")
    with pytest.raises(RuntimeError, match="stopped"):
        merge.merge(spark, verified, F.lit(LATER).cast("timestamp"), roots, f"{tmp_path}/j", "d", replace=True)
    assert len(there(roots.staging)) == (3 if stop < 3 else 3 - (stop - 2))
    monkeypatch.setattr(merge, "carry_out", plain)
    out = merge.merge(spark, verified, F.lit(LATER).cast("timestamp"), roots, f"{tmp_path}/j", "d", replace=True)
    assert {r["outcome"] for r in out.collect()} <= {"moved", "was moved"} and out.count() == 5
    assert there(roots.library) == {"a.wav": "new a", "b.wav": "new b", "c.wav": "new c"} and not there(roots.staging)
    assert there(roots.aside) == {"a.replaced_d.wav": "old a", "b.replaced_d.wav": "old b"}


def test_refused_moves_overwrite_nothing_and_can_be_tried_again(spark, roots, tmp_path, monkeypatch):
    put(roots.staging, a="new a")
    verified, real = report(spark, "a"), merge.moves
    monkeypatch.setattr(merge, "moves", lambda *x: (put(roots.library, a="someone's"), real(*x))[1].where("step = 1"))
    with pytest.raises(ValueError, match="refused: the target is there"):
        merge.merge(spark, verified, F.lit(LATER).cast("timestamp"), roots, f"{tmp_path}/j", "d")
    assert there(roots.library) == {"a.wav": "someone's"} and there(roots.staging) == {"a.wav": "new a"}
    os.rename(f"{roots.library}/a.wav", f"{tmp_path}/elsewhere")
    merge.merge(spark, verified, F.lit(LATER).cast("timestamp"), roots, f"{tmp_path}/j", "d")
    assert there(roots.library) == {"a.wav": "new a"}


def test_refusals_are_those_of_now(spark, roots, tmp_path):
    put(roots.staging, a="a", b="b")
    now = merge.listing(spark, roots.staging).where("name = 'a.wav'").first()["changed_at"]
    for names, at, ok, message in (
        ("ab", now, True, "changed since"), ("a", LATER, True, "b.wav, reason=not verified"),
        ("abc", LATER, True, "c.wav, reason=gone since"), ("ab", LATER, False, "failed: qc: silent"), ("", LATER, True, "nothing was verified"),
    ):
        with pytest.raises(ValueError, match=message):
            merge.merge(spark, report(spark, *names, ok=ok), F.lit(at).cast("timestamp"), roots, f"{tmp_path}/j", "d")
    put(roots.library, a="old")
    put(roots.aside, **{"a.replaced_d": "older"})
    with pytest.raises(ValueError, match="place of the old copy"):
        merge.merge(spark, report(spark, "a", "b"), F.lit(LATER).cast("timestamp"), roots, f"{tmp_path}/j", "d", replace=True)
    assert not os.path.exists(f"{tmp_path}/j/plan/_SUCCESS")


def test_log_and_cache(spark):
    moved = spark.createDataFrame([(1, "a.wav", "/l/a.wav"), (1, "b.wav", "/l/b.wav"), (0, "a.wav", "/o/a.replaced_d.wav")], "step int, name string, target string")
    text = spark.createDataFrame([("t", "8 kHz", "/s", "/x/l", 1, 7)], "at string, text string, source string, library string, left long, after long")
    assert {r["line"] for r in merge.log_entries(moved, text).collect()} == {
        "t moved 2 wavs (8 kHz) from /s to /x/l (1 name collision replaced; all verified); left behind 1; l now 7 files",
        "a.wav REPLACED: old copy moved to /o/a.replaced_d.wav",
    }
    assert "no name collisions" in merge.log_entries(moved.where("step = 1"), text).first()["line"]
    assert merge.log_entries(moved.where("step > 1"), text).count() == 0
    cache = spark.createDataFrame([("a.wav", 1, 1, "old"), ("z.wav", 2, 2, "hz")], "name string, size long, mtime_ns long, hash string")
    got = merge.cache_after(cache, spark.createDataFrame([("a.wav", 5, 9)], "name string, size long, mtime_ns long"), report(spark, "a", "b"))
    assert sorted(map(tuple, got.collect())) == [("a.wav", 5, 9, "ha"), ("z.wav", 2, 2, "hz")]
