import os
import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType
from test_metrics import T0, at, brute_runs, conditions

from lakekit.operators import tables
from lakekit.plans import readiness
from lakekit.sources.files import stream_path
from lakekit.streaming.alerts import stream_sustained
from lakekit.streaming.ingest import Derived, refresh, stream_listing, stream_sentinels, stream_to_table
from lakekit.sources.catalog import view_properties
from lakekit.streaming.rollups import Rollup, compact_rollup, refresh_rollup
from lakekit.streaming.upsert import foreach_batch_upsert
from lakekit.streaming.windows import stream_rate

IDS = StructType().add("id", LongType())


def test_append_starts_clean_and_restarts(spark, root):
    source = f"{root}/in"
    spark.range(5).write.parquet(source)
    run = lambda: stream_to_table(stream_path(spark, source, IDS), f"{root}/out", f"{root}/missing/checkpoint")
    run()
    run()
    assert spark.read.parquet(f"{root}/out").count() == 5
    spark.range(5, 8).write.mode("append").parquet(source)
    run()
    assert rows(spark.read.parquet(f"{root}/out")) == [(i,) for i in range(8)]


def test_refresh_incremental_and_full(spark, root, name):
    source = f"{root}/in"
    spark.range(5).write.parquet(source)
    spec = Derived(name, source, IDS, lambda df: df.filter("id % 2 = 0"), root)
    first = refresh(spark, spec)
    spark.range(5, 10).write.mode("append").parquet(source)
    assert refresh(spark, spec) == first
    assert rows(spark.table(name)) == [(0,), (2,), (4,), (6,), (8,)]
    assert refresh(spark, spec, full=True) != first
    assert rows(spark.table(name)) == [(0,), (2,), (4,), (6,), (8,)]
    refresh(spark, spec)
    assert spark.table(name).count() == 5


def test_refresh_of_an_empty_source(spark, root, name):
    os.makedirs(f"{root}/in".removeprefix("file:"))
    spec = Derived(name, f"{root}/in", IDS, lambda df: df, root)
    refresh(spark, spec)
    assert spark.table(name).count() == 0
    spark.range(2).write.mode("append").parquet(f"{root}/in")
    refresh(spark, spec)
    assert spark.table(name).count() == 2


def test_marker_feed_equals_batch(spark, root):
    months = f"{root}/cycle=2022/_months".removeprefix("file:")
    os.makedirs(months)
    for f in ("2022-01.done", "2022-02.done", "2022-03.tmp"):
        with open(f"{months}/{f}", "w") as marker:
            marker.write("x")
    feed = stream_sentinels(stream_listing(spark, f"{root}/cycle=*/_months"))
    stream_to_table(feed, f"{root}/out", f"{root}/checkpoint")
    from lakekit.sources.files import list_files

    batch = readiness.sentinels(list_files(spark, f"{root}/cycle=*/_months"))
    got = spark.read.parquet(f"{root}/out")
    assert rows(got, "cycle", "month") == rows(batch, "cycle", "month") == [(2022, "2022-01"), (2022, "2022-02")]
    assert got.filter(F.col("collected_at").isNull()).count() == 0


@pytest.mark.parametrize("slide", [None, "1 minute"])
def test_stream_rate_equals_batch_on_closed_windows(spark, root, slide):
    rnd = random.Random(4)
    df = spark.createDataFrame(
        [(rnd.choice("ab"), at(rnd.randrange(7200)), float(rnd.randrange(9))) for _ in range(300)], "k string, ts timestamp, v double"
    )
    df.write.parquet(f"{root}/in")
    batch = stream_rate(df, "k", "ts", "v", slide=slide)
    newest = df.agg(F.max("ts")).first()[0] - timedelta(minutes=10)
    stream = stream_rate(stream_path(spark, f"{root}/in", df.schema), "k", "ts", "v", slide=slide)
    stream_to_table(stream, f"{root}/out", f"{root}/checkpoint")
    assert rows(spark.read.parquet(f"{root}/out")) == rows(batch.filter(F.col("window_end") <= F.lit(newest)))


def test_late_rows_are_dropped(spark, root):
    schema = "k string, ts timestamp, v double"
    put = lambda *r: spark.createDataFrame([("a", at(s), 1.0) for s in r], schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    run = lambda: stream_to_table(
        stream_rate(stream_path(spark, f"{root}/in", spark.createDataFrame([], schema).schema), "k", "ts", "v"), f"{root}/out", f"{root}/checkpoint"
    )
    put(10, 20, 4000)
    run()
    put(30, 8000)
    run()
    first = spark.read.parquet(f"{root}/out").filter(F.col("window_start") == F.lit(T0)).collect()
    assert [r.samples for r in first] == [2]


def batches_of(samples, sizes):
    out, rest = [], list(samples)
    for n in sizes:
        out.append(rest[:n])
        rest = rest[n:]
    return [b for b in [*out, rest] if b]


def seconds(t):
    return None if t is None else int((t - T0).total_seconds())


class Alerts:
    """An alert stream over a folder to which samples are added between runs."""

    def __init__(self, spark, root, hold, delay):
        self.spark, self.root, self.hold, self.delay = spark, root, hold, delay
        self.schema = conditions(spark, []).schema

    def add(self, *samples):
        conditions(self.spark, samples).coalesce(1).write.mode("append").parquet(f"{self.root}/in")

    def run(self):
        source = stream_path(self.spark, f"{self.root}/in", self.schema)
        return stream_sustained(source, "k", "ts", "c", self.hold, f"{self.root}/a", self.delay)


def test_alert_stream_equals_the_batch_operator(spark, root):
    rnd = random.Random(8)
    samples = sorted(((rnd.choice("ab"), rnd.randrange(20000), rnd.random() < 0.85) for _ in range(250)), key=lambda x: x[1])
    # shuffled within the allowed delay
    samples.sort(key=lambda x: x[1] + rnd.randrange(500))
    alerts = Alerts(spark, root, "5 minutes", "10 minutes")
    for part in batches_of(samples, [40, 1, 90, 119]):
        alerts.add(*part)
        got = alerts.run()
    newest = max(s for _, s, _ in samples) - 600
    ready = [x for x in samples if x[1] + 1 <= newest]
    want = [(k, a, b, f) for k, a, b, f, _, is_open in brute_runs(ready, 300) if not is_open]
    closed = [(r.k, seconds(r.start), seconds(r.end), seconds(r.fired_at)) for r in got.filter("status = 'closed'").collect()]
    assert sorted(closed, key=str) == sorted(want, key=str)
    fired = got.filter("status = 'firing'").groupBy("k", "start").count()
    assert fired.filter("count > 1").count() == 0
    known = {(k, a) for k, a, _, f, _, _ in brute_runs(ready, 300) if f is not None}
    assert {(r.k, seconds(r.start)) for r in fired.collect()} <= known


def test_alert_fires_before_it_closes_and_late_samples_are_dropped(spark, root):
    alerts = Alerts(spark, root, "2 minutes", "1 second")
    alerts.add(("a", 0, True), ("a", 130, True), ("a", 200, True), (None, 130, True))
    assert rows(alerts.run(), "k", "status", "start", "end", "fired_at") == [("a", "firing", at(0), None, at(130))]
    alerts.add(("a", 260, True), ("a", 300, True))
    assert alerts.run().count() == 1
    alerts.add(("a", 20, False), ("a", 400, False), ("a", 500, False))
    assert rows(alerts.run(), "k", "status", "start", "end", "fired_at") == [
        ("a", "closed", at(0), at(300), at(130)), ("a", "firing", at(0), None, at(130)),
    ]


def test_equal_timestamps_hold_when_all_do(spark, root):
    alerts = Alerts(spark, root, "1 minute", "1 second")
    alerts.add(("a", 0, True), ("a", 70, True), ("a", 70, False), ("a", 80, True), ("a", 90, None), ("b", 5, True), ("b", 5, True), ("b", 300, False), ("a", 400, False), ("b", 500, False))
    got = rows(alerts.run(), "k", "status", "start", "end", "fired_at")
    assert got == [("a", "closed", at(0), at(0), None), ("a", "closed", at(80), at(80), None), ("b", "closed", at(5), at(5), None)]


def test_alert_stream_restarts_and_replays(spark, root):
    alerts = Alerts(spark, root, "1 minute", "1 second")
    alerts.add(("a", 0, True), ("a", 100, True), ("a", 300, True))
    assert rows(alerts.run(), "status") == [("firing",)]  # 300 still waits; the run up to 100 has fired
    alerts.add(("a", 400, False), ("a", 500, False))
    want = rows(alerts.run(), "status", "start", "end")
    assert want == [("closed", at(0), at(300)), ("firing", at(0), None)]
    # as after a crash behind the last write: the newest batch is not known to be done and runs again
    commits = f"{root}/a/checkpoint/commits".removeprefix("file:")
    newest = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for f in (str(newest), f".{newest}.crc"):
        os.path.exists(f"{commits}/{f}") and os.remove(f"{commits}/{f}")
    assert rows(alerts.run(), "status", "start", "end") == want
    assert str(newest) in os.listdir(commits)
    alerts.add(("a", 600, True), ("a", 700, True), ("a", 800, False), ("a", 900, False))
    assert ("closed", at(600), at(700)) in rows(alerts.run(), "status", "start", "end")


def test_upsert_replay_is_a_no_op(spark, root, name):
    schema = "k int, t int, v string"
    make = lambda *r: spark.createDataFrame(list(r), schema)
    tables.create_table(spark, name, make().schema, root)
    sink = foreach_batch_upsert(name, ["k"], newest_by="t")
    sink(make((1, 5, "a"), (2, 1, "x")), 0)
    sink(make((1, 4, "older"), (2, 2, "y"), (2, 3, "z"), (3, 1, "n")), 1)
    want = [(1, 5, "a"), (2, 3, "z"), (3, 1, "n")]
    assert rows(spark.table(name)) == want
    count = len(tables.versions(spark, name))
    sink(make((1, 9, "replayed with other rows")), 1)
    assert rows(spark.table(name)) == want and len(tables.versions(spark, name)) == count
    plain = foreach_batch_upsert(name, ["k"])
    plain(make((3, 0, "last write wins")), 2)
    assert (3, 0, "last write wins") in rows(spark.table(name))


def test_expiry_spares_the_live_generation(spark, root, name):
    spark.range(5).write.parquet(f"{root}/in")
    spec = Derived(name, f"{root}/in", spark.range(1).schema, lambda df: df, f"{root}/out")
    refresh(spark, spec)
    for _ in range(3):
        refresh(spark, spec, full=True)
    spark.range(5, 8).write.mode("append").parquet(f"{root}/in")
    refresh(spark, spec)
    assert len(tables.expire_versions(spark, name)) == 3
    assert rows(spark.table(name)) == [(i,) for i in range(8)]
    refresh(spark, spec)
    assert spark.table(name).count() == 8


def rollup_over(name, root, **more):
    measures = {"n": ("count", "*"), "total": ("sum", "id"), "least": ("min", "id"), "mean": ("avg", "id"), "kinds": ("distinct", "id % 7")}
    return Rollup(name, f"{root}/in", IDS, ["k"], measures, root, lambda df: df.withColumn("k", F.when(F.col("id") % 5 > 0, F.col("id") % 5)), **more)


def rollup_of(ids):
    out = []
    for k in {i % 5 or None for i in ids}:
        mine = [i for i in ids if (i % 5 or None) == k]
        out.append((k, len(mine), sum(mine), min(mine), sum(mine) / len(mine), len({i % 7 for i in mine})))
    return sorted(out, key=lambda r: (r[0] is not None, r[0]))


def test_rollup_reads_new_files_only_and_equals_the_rebuild(spark, root, name):
    spec = rollup_over(name, root, max_files_per_trigger=2)
    put = lambda a, b: spark.range(a, b, numPartitions=3).write.mode("append").parquet(f"{root}/in")
    put(0, 40)
    base = refresh_rollup(spark, spec)
    assert rows(spark.table(name)) == rollup_of(range(40))
    before = view_properties(spark, name)[tables.LOCATION_KEY]
    parts = set(os.listdir(before.removeprefix("file:")))
    put(40, 70)
    assert refresh_rollup(spark, spec) == base
    # earlier partials stay; new files gave new ones
    assert parts < set(os.listdir(before.removeprefix("file:")))
    assert rows(spark.table(name)) == rollup_of(range(70))
    refresh_rollup(spark, spec)
    assert rows(spark.table(name)) == rollup_of(range(70))
    assert compact_rollup(spark, spec) >= 4 and compact_rollup(spark, spec) == 0
    assert rows(spark.table(name)) == rollup_of(range(70)) and not os.path.exists(before.removeprefix("file:"))
    put(70, 75)
    refresh_rollup(spark, spec)
    assert rows(spark.table(name)) == rollup_of(range(75))
    assert refresh_rollup(spark, spec, full=True) != base
    assert rows(spark.table(name)) == rollup_of(range(75))


def test_rollup_batches_that_run_again_count_once(spark, root, name):
    spec = rollup_over(name, root)
    spark.range(20).write.parquet(f"{root}/in")
    base = refresh_rollup(spark, spec)
    commits = f"{base}/checkpoint/commits".removeprefix("file:")

    def forget_last_commit():
        newest = max(int(f) for f in os.listdir(commits) if f.isdigit())
        for f in (str(newest), f".{newest}.crc"):
            os.path.exists(f"{commits}/{f}") and os.remove(f"{commits}/{f}")

    forget_last_commit()
    refresh_rollup(spark, spec)
    assert rows(spark.table(name)) == rollup_of(range(20))
    spark.range(20, 30).write.mode("append").parquet(f"{root}/in")
    refresh_rollup(spark, spec)
    compact_rollup(spark, spec)
    # a batch that compaction has merged is not written once more
    forget_last_commit()
    refresh_rollup(spark, spec)
    assert rows(spark.table(name)) == rollup_of(range(30))


def test_rollup_of_an_empty_source(spark, root, name):
    os.makedirs(f"{root}/in".removeprefix("file:"))
    refresh_rollup(spark, rollup_over(name, root))
    assert spark.table(name).count() == 0
    assert compact_rollup(spark, rollup_over(name, root)) == 0
