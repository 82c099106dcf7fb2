import datetime as dt

import pytest

from strandline.streaming import jobs as J

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "user string, ts timestamp, value double"


def write(spark, rows, folder, n):
    spark.createDataFrame([(u, T0 + dt.timedelta(seconds=s), float(v)) for u, s, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}")


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path / "in")


def run(spark, frame, tmp_path, mode="append"):
    J.run_once(frame, str(tmp_path / "out"), str(tmp_path / "check"), mode)
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_dedup_over_runs(spark, folder, tmp_path):
    write(spark, [("a", 0, 1), ("a", 1, 1), ("b", 2, 2)], folder, 0)
    stream = lambda: J.incremental_dedup(J.tail_parquet(spark, folder, SCHEMA), ["user"])
    assert sorted(r.user for r in run(spark, stream(), tmp_path)) == ["a", "b"]
    write(spark, [("a", 9, 1), ("c", 3, 2)], folder, 1)
    assert sorted(r.user for r in run(spark, stream(), tmp_path)) == ["a", "b", "c"]
    assert sorted(r.user for r in run(spark, stream(), tmp_path)) == ["a", "b", "c"]


def test_windows_drop_late_rows(spark, folder, tmp_path):
    write(spark, [("a", 10, 1), ("a", 20, 2), ("a", 7200, 4)], folder, 0)
    stream = lambda: J.windowed(J.tail_parquet(spark, folder, SCHEMA), "ts", "1 minute", ["user"], "value", delay="10 minutes")
    run(spark, stream(), tmp_path)
    write(spark, [("a", 30, 100), ("a", 20_000, 8)], folder, 1)  # the first is late
    got = {r.w.start: (r.n, r.total) for r in run(spark, stream(), tmp_path)}
    assert got[T0] == (2, 3.0) and all(total < 100 for _, total in got.values())


def test_sessions_and_stalls(spark, folder, tmp_path):
    write(spark, [("a", 0, 1), ("a", 30, 1), ("a", 500, 1), ("b", 0, 1), ("z", 100_000, 1)], folder, 0)
    got = run(spark, J.session_counts(J.tail_parquet(spark, folder, SCHEMA), "ts", "user", "1 minute", "1 minute"), tmp_path)
    assert sorted((r.user, r.n) for r in got) == [("a", 1), ("a", 2), ("b", 1)]
    gaps = run(spark, J.stalls(J.tail_parquet(spark, folder, SCHEMA), "user", "ts", 100.0), tmp_path / "x")
    assert [(r.key, r.gap) for r in gaps] == [("a", 470.0)]


def test_tail_skips_broken_lines(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "m.jsonl").write_text('{"step": 1, "loss": 0.5}\n{"step": 2, "lo')
    got = run(spark, J.tail_json(spark, str(tmp_path / "log"), "step long, loss double"), tmp_path)
    assert [(r.step, r.loss) for r in got] == [(1, 0.5)]


def test_bounded_batches_take_up_where_they_stopped(spark, folder, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "check")
    stream = lambda: J.tail_parquet(spark, folder, SCHEMA, files_a_trigger=2)
    for n in range(5):
        write(spark, [("a", n, n)], folder, n)
    J.run_bounded(stream(), out, state)
    assert sorted(r.n for r in spark.read.parquet(out).groupBy("chunk").count().withColumnRenamed("count", "n").collect()) == [1, 2, 2]
    write(spark, [("b", 9, 9)], folder, 5)
    J.run_bounded(stream(), out, state)
    assert sorted(r.value for r in spark.read.parquet(out).collect()) == [0.0, 1.0, 2.0, 3.0, 4.0, 9.0]
