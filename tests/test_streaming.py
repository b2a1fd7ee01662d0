"""Windows kept up by a stream in several runs, with late rows, against the same windows over the table."""

from pyspark.sql import functions as F

from tidemark.scratch import shared_dir
from tidemark.streaming import windows


def test_runs_of_a_stream_add_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(windows, "TOGETHER", 2)  # changes are put together in between
    n = 6000
    rows = spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).cast("timestamp_ntz").alias("ts"), F.element_at(F.lit(["a", "b"]), (F.col("id") % 2 + 1).cast("int")).alias("event_type"), (F.col("id") % 10 / 4).alias("value"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    folder = shared_dir(spark)
    table, told = windows.events_in_parts(spark, str(tmp_path), folder)
    assert [t["read"] for t in told] == [1960, 1960, 1960, 120] and [t["late"] > 0 for t in told] == [False, False, False, True]
    assert sum(t["left"] for t in told) > 1000 and max(t["held"] for t in told) < 40  # what the watermark has passed isn't held
    got = {(r.window_start, r.event_type): (r.n, r.total) for r in table.read().collect()}
    mark = 1_700_000_000 + 60 * (n - 1) - 600
    twin = windows.windowed(rows.where("event_id % 50 <> 7")).collect()
    late = {(r.window_start, r.event_type): r for r in windows.windowed(rows.where("event_id % 50 = 7")).collect() if r.window_start + 1800 > mark}
    want = {(r.window_start, r.event_type): (r.n + (late[k].n if (k := (r.window_start, r.event_type)) in late else 0), round(r.total + (late[k].total if k in late else 0), 4)) for r in twin}
    assert {k: (v[0], round(v[1], 4)) for k, v in got.items()} == want and len(got) > 1000
    _, again = windows.advance(spark, f"{folder}/source", rows.schema, folder, windows.windowed, ["window_start", "event_type"])
    assert again["read"] == 0 and table.read().count() == len(got)  # nothing new changes nothing


def test_a_batch_that_is_run_again_changes_nothing(spark):
    table = windows.Upserts(spark, shared_dir(spark), spark.createDataFrame([], "k long, x string").schema, ["k"])
    for number, x in ((0, "old"), (1, "new"), (1, "new")):
        table.save(spark.createDataFrame([(1, x), (2 + number, x)], "k long, x string"), number)
    assert sorted(map(tuple, table.read().collect())) == [(1, "new"), (2, "old"), (3, "new")]
