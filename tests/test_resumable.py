"""The cache of computed rows: stops between and within batches, signatures, owners."""

import pytest
from pyspark.sql import functions as F

from millrace.streaming import resumable

WANTED, PAYLOAD = "instance_id string, file_sig string, x long", "square long"


def write(spark, path, rows):
    for r in rows:  # a file for each list
        spark.createDataFrame(r, WANTED).coalesce(1).write.mode("append").parquet(path)


def filled(spark, root, source, compute, identity="squares"):
    resumable.fill(spark, source, WANTED, f"{root}/cache", f"{root}/state", PAYLOAD, identity, compute, files_per_batch=1)


def squares(todo):
    return todo.select("instance_id", (F.col("x") * F.col("x")).alias("square"))


def test_stopped_and_taken_up_again(spark, tmp_path):
    files = [[(f"c{c}_{i}", "s", 10 * c + i) for c in range(3) for i in range(k, 6, 3)] for k in range(3)]  # every clip is in every file
    source = f"{tmp_path}/wanted"
    write(spark, source, files)
    calls, computed = [], []

    def faulty(todo):
        calls.append(1)
        computed.append({r["instance_id"] for r in todo.select("instance_id").collect()})
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return squares(todo)

    with pytest.raises(Exception, match="stopped"):
        filled(spark, tmp_path, source, faulty)
    rows = resumable.cached(spark, f"{tmp_path}/cache", PAYLOAD)
    assert rows.count() == 6  # a third of each clip
    assert all(len(r["run"]) == 36 for r in rows.select("run").collect())  # the stream's own id, so a new one can't replace old rows
    filled(spark, tmp_path, source, faulty)
    filled(spark, tmp_path, source, faulty)  # nothing left
    assert len(calls) == 4 and computed[1] == computed[2] and not computed[0] & computed[3]
    filled(spark, f"{tmp_path}/plain", source, squares)
    shown = lambda at: sorted(map(tuple, resumable.cached(spark, f"{at}/cache", PAYLOAD).select("instance_id", "file_sig", "done", "square").collect()))
    assert shown(tmp_path) == shown(f"{tmp_path}/plain") and len(shown(tmp_path)) == 18


def test_a_batch_that_ran_before_its_commit_was_logged_replaces_its_rows(spark, tmp_path):
    source = f"{tmp_path}/wanted"
    write(spark, source, [[("a", "s", 2), ("b", "s", 3)]])
    filled(spark, tmp_path, source, squares)
    # as if the stop came between the rows and the stream's own log
    for f in (tmp_path / "state" / "commits").iterdir():
        f.unlink()
    filled(spark, tmp_path, source, squares)
    rows = resumable.cached(spark, f"{tmp_path}/cache", PAYLOAD)
    assert sorted((r["instance_id"], r["square"]) for r in rows.collect()) == [("a", 4), ("b", 9)]


def test_signatures_failures_and_owners(spark, tmp_path):
    source, cache = f"{tmp_path}/wanted", f"{tmp_path}/cache"
    old = [("legacy", None, True, -1), ("same", "s", True, -2), ("changed", "r", True, -3), ("open", "s", False, None), ("both", None, True, -4), ("both", "s", True, -5), ("gone", "s", True, -6)]
    spark.createDataFrame(old, "instance_id string, file_sig string, done boolean, square long").write.parquet(f"{cache}/rows/run=old/batch=0")
    wanted = [(n, "s", 3) for n in ("legacy", "same", "changed", "open", "both", "unreadable", "same")]
    write(spark, source, [wanted])
    filled(spark, tmp_path, source, lambda todo: squares(todo.where("instance_id <> 'unreadable'")))
    df = spark.createDataFrame(wanted, WANTED)
    rows = resumable.cached(spark, cache, PAYLOAD)
    got = {r["instance_id"]: r["square"] for r in resumable.standing(df, rows).collect()}
    assert got == {"legacy": -1, "same": -2, "changed": 9, "open": 9, "both": -5}
    assert resumable.standing(df, rows).count() == 5
    assert [r["instance_id"] for r in resumable.to_compute(df, rows).collect()] == ["unreadable"]
    assert resumable.status(df, rows).first().asDict() == {"wanted": 6, "standing": 5, "missing": 1, "outdated": 5}
    with pytest.raises(ValueError, match="is of squares, not of cubes"):
        filled(spark, tmp_path, source, squares, "cubes")


def test_empty_tables(spark, tmp_path):
    rows = resumable.cached(spark, f"{tmp_path}/cache", PAYLOAD)
    none = spark.createDataFrame([], WANTED)
    assert rows.count() == 0 and resumable.standing(none, rows).count() == 0 and resumable.to_compute(none, rows).count() == 0


def test_no_table_of_whole_recordings_is_written(spark, sf):
    """A column of whole files in Parquet is written and read by the hundred; files are built again instead."""
    from pyspark.sql import DataFrameWriter

    from millrace.plans import catalogue

    written, write = [], DataFrameWriter.parquet
    try:
        DataFrameWriter.parquet = lambda self, path, *a, **b: (written.append(self._df.columns), write(self, path, *a, **b))[1]
        assert catalogue.QUERIES["resumable_windows"](spark, sf).count() > 0
    finally:
        DataFrameWriter.parquet = write
    assert written and not any("content" in c for c in written)
