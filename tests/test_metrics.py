import random
from datetime import datetime, timedelta, timezone

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakekit.operators import metrics, skew

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def series(spark, *samples):
    return spark.createDataFrame([(k, at(s), v) for k, s, v in samples], "k string, ts timestamp, v double")


# --- rates --------------------------------------------------------------------------------------


def brute_rates(samples, span=300):
    """`{(key, second): rate}` by looping; equal times collapse to the largest value."""
    out = {}
    for key in {k for k, _, _ in samples}:
        points = {}
        for k, s, v in samples:
            if k == key and v is not None:
                points[s] = max(v, points.get(s, v))
        times = sorted(points)
        for t in times:
            inside = [s for s in times if t - span < s <= t]
            if len(inside) < 2:
                out[(key, t)] = None
                continue
            steps = [points[b] - points[a] if points[b] >= points[a] else points[b] for a, b in zip(inside, inside[1:])]
            out[(key, t)] = sum(steps) / (inside[-1] - inside[0])
    return out


def got_rates(df):
    return {(r.k, int((r.ts - T0).total_seconds())): r.rate for r in df.collect()}


def assert_same(got, want):
    assert got.keys() == want.keys()
    for key, rate in want.items():
        assert (got[key] is None) == (rate is None), key
        assert rate is None or got[key] == pytest.approx(rate, rel=1e-9, abs=1e-9), key


def test_rate_edges(spark):
    samples = [
        ("a", 0, 10.0), ("a", 100, 20.0), ("a", 200, 5.0), ("a", 299, 6.0), ("a", 300, 8.0), ("a", 1000, 9.0),
        ("a", 1100, None), ("b", 50, 1.0), ("c", 10, 1.0), ("c", 10, 3.0), ("c", 20, 4.0), (None, 0, 1.0), (None, 10, 2.0),
    ]
    got = got_rates(metrics.counter_rate(series(spark, *samples), "k", "ts", "v"))
    assert_same(got, brute_rates(samples))
    assert got[("a", 200)] == pytest.approx((10 + 5) / 200) and got[("b", 50)] is None and got[("a", 1000)] is None
    assert got[("a", 300)] == pytest.approx((5 + 1 + 2) / 200)  # the sample at 0 is just outside


def test_rate_order_column_decides_ties(spark):
    df = spark.createDataFrame([("a", at(0), 0.0, 0), ("a", at(10), 9.0, 1), ("a", at(10), 4.0, 2)], "k string, ts timestamp, v double, o int")
    assert got_rates(metrics.counter_rate(df, "k", "ts", "v", order="o"))[("a", 10)] == pytest.approx(0.4)


def test_rate_across_slices_and_in_busy_ones(spark, monkeypatch):
    rnd = random.Random(5)
    samples = [("hot", rnd.randrange(4 * 3600), float(rnd.randrange(50))) for _ in range(900)]
    samples += [(k, rnd.randrange(4 * 3600), float(rnd.randrange(50))) for k in "xyz" for _ in range(40)]
    df, want = series(spark, *samples), brute_rates(samples)
    assert_same(got_rates(metrics.counter_rate(df, "k", "ts", "v")), want)
    monkeypatch.setattr(skew, "SLICE_ROWS", 30)
    assert_same(got_rates(metrics.counter_rate(df, "k", "ts", "v")), want)


# --- sustained ----------------------------------------------------------------------------------


def brute_runs(samples, hold):
    out = []
    for key in {k for k, _, _ in samples}:
        points = {}
        for k, s, c in samples:
            if k == key:
                points[s] = bool(c) and points.get(s, True)
        start = None
        times = sorted(points)
        for i, t in enumerate(times + [None]):
            if t is not None and points[t]:
                start = t if start is None else start
                continue
            if start is not None:
                end = times[i - 1]
                inside = [x for x in times if start <= x <= end]
                fired = next((x for x in inside if x - start >= hold), None)
                out.append((key, start, end, fired, len(inside), t is None))
            start = None
    return sorted(out, key=str)


def got_runs(df):
    s = lambda t: None if t is None else int((t - T0).total_seconds())
    return sorted([(r.k, s(r.start), s(r.end), s(r.fired_at), r.samples, r.open) for r in df.collect()], key=str)


def conditions(spark, samples):
    return spark.createDataFrame([(k, at(s), c) for k, s, c in samples], "k string, ts timestamp, c boolean")


def test_sustained_edges(spark):
    day = 86400
    samples = [
        ("a", 0, True), ("a", 60, True), ("a", 120, True), ("a", 180, None), ("a", 240, True),
        ("b", 0, False), ("c", 5, True), ("d", 10, True), ("d", 10, False), ("d", 20, True),
        # over three days, with a day of nothing but true samples
        ("e", day - 10, True), ("e", day + 5, True), ("e", 2 * day - 1, True), ("e", 2 * day + 7, True), ("e", 2 * day + 8, False),
    ]
    got = got_runs(metrics.sustained(conditions(spark, samples), "k", "ts", "c", "2 minutes"))
    assert got == brute_runs(samples, 120)
    assert ("a", 0, 120, 120, 3, False) in got and ("c", 5, 5, None, 1, True) in got
    assert ("e", day - 10, 2 * day + 7, 2 * day - 1, 4, False) in got


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 400), st.sampled_from([True, True, True, False, None])), max_size=60))
def test_sustained_agrees_with_a_loop(spark, samples):
    df = conditions(spark, samples)
    assert got_runs(metrics.sustained(df, "k", "ts", "c", "30 seconds", "1 minute")) == brute_runs(samples, 30)


def test_sustained_in_busy_slices(spark, monkeypatch):
    rnd = random.Random(6)
    samples = [("hot", rnd.randrange(3 * 86400), rnd.random() < 0.97) for _ in range(1500)]
    samples += [("cold", rnd.randrange(3 * 86400), rnd.random() < 0.8) for _ in range(50)]
    monkeypatch.setattr(skew, "SLICE_ROWS", 20)
    got = got_runs(metrics.sustained(conditions(spark, samples), "k", "ts", "c", "1 hour"))
    assert got == brute_runs(samples, 3600)


def test_rules(spark):
    heap, mine, other = "metrics_spark_connect_server_driver_jvm_heap_usage", {"job": "spark-connect"}, {"job": "other"}
    samples = spark.createDataFrame(
        [(at(s), "up", mine, 0.0) for s in (0, 60, 120)]
        + [(at(s), "up", other, 1.0) for s in (30, 90)]
        + [(at(s), heap, {}, v) for s, v in ((0, 0.95), (200, 0.9), (300, 0.99), (600, 0.99))],
        "ts timestamp, metric string, labels map<string,string>, value double",
    )
    rules = spark.createDataFrame(metrics.ALERT_RULES, metrics.RULE_SCHEMA)
    got = rows(metrics.evaluate_rules(samples, rules), "alert", "severity", "start", "fired_at")
    assert got == [("SparkConnectDown", "critical", at(0), at(120)), ("SparkConnectHighHeapUsage", "warning", at(300), at(600))]


# --- the rest -----------------------------------------------------------------------------------


def test_select_scale_panel_state(spark):
    df = spark.createDataFrame(
        [(at(0), "m_used_MB", {"job": "a"}, 2.0, "x"), (at(0), "m_used_MB2", {"job": "b"}, 1.0, "y"), (at(5), "m_used_MB", {}, 3.0, "x")],
        "ts timestamp, metric string, labels map<string,string>, value double, label string",
    )
    assert metrics.select_series(df, name_regex="m_.*_MB").count() == 2
    assert metrics.select_series(df, name_regex="m_.*", labels={"job": "a"}).count() == 1
    assert metrics.select_series(df, name="m").count() == 0
    assert rows(metrics.scale(df), "value")[0] == (1048576.0,)
    assert rows(metrics.panel(df, {"x": "used", "z": "none"}), "ts", "used", "none") == [(at(0), 2.0, None), (at(5), 3.0, None)]
    state = metrics.current_state(df, "metric", states={3: "high"})
    assert rows(state, "metric", "value", "state") == [("m_used_MB", 3.0, "high"), ("m_used_MB2", 1.0, None)]


def brute_retain(samples, max_age, max_n):
    out = []
    for key in {k for k, _, _ in samples}:
        mine = sorted([x for x in samples if x[0] == key], key=lambda x: (-x[1], x[2]))
        out += [x for i, x in enumerate(mine) if i == 0 or (i < max_n and x[1] > 1000 - max_age)]
    return sorted(out)


@pytest.mark.parametrize("busy", [False, True])
@pytest.mark.parametrize("max_age, max_n", [(300, 7), (10, 1000), (2000, 3), (2000, 150)])
def test_retain(spark, monkeypatch, max_age, max_n, busy):
    rnd = random.Random(max_n)
    samples = [(rnd.choice("aab"), rnd.randrange(950), i) for i in range(300)] + [("old", 1, 9), ("old", 1, 8)]
    df = spark.createDataFrame([(k, at(s), i) for k, s, i in samples], "k string, ts timestamp, i int")
    if busy:
        monkeypatch.setattr(skew, "SLICE_ROWS", 10)
    now = (T0 + timedelta(seconds=1000)).replace(tzinfo=timezone.utc)
    kept = metrics.retain(df, "k", "ts", now, f"{max_age} seconds", max_n, ["i"], "1 minute")
    got = sorted((r.k, int((r.ts - T0).total_seconds()), r.i) for r in kept.collect())
    assert got == brute_retain(samples, max_age, max_n)


@pytest.mark.parametrize("least", [1_000_000, 10])
def test_salted_joins_equal_a_join(spark, monkeypatch, least):
    monkeypatch.setattr(skew, "JOIN_ROWS", least)
    left = spark.range(500).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 20).alias("k"), "id")
    right = spark.range(10).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w")).unionAll(
        spark.sql("SELECT 0L AS k, 99L AS w")
    )
    want = rows(left.join(right, "k").select("k", "id", "w"))
    assert rows(skew.salted_join(left, right, ["k"]), "k", "id", "w") == want
    unique = left.groupBy("k").agg(F.max("id").alias("m"), F.count("*").alias("n"))
    looked = skew.lookup_join(left, unique, ["k"], "n", 500)
    assert rows(looked, "k", "id", "m") == rows(left.join(unique, "k").select("k", "id", "m"))


def test_server_panels(spark):
    from lakekit.plans.server import server_panels

    gc = "metrics_spark_x_driver_ExecutorMetrics_MinorGCTime_Value"
    used = "metrics_spark_x_driver_BlockManager_memory_memUsed_MB_Value"
    samples = spark.createDataFrame(
        [(at(0), "up", {"job": "spark-connect"}, 1.0), (at(30), "up", {"job": "spark-connect"}, 0.0), (at(60), "up", {"job": "other"}, 1.0),
         (at(0), gc, {}, 10.0), (at(30), gc, {}, 40.0), (at(0), used, {}, 2.0), (at(0), used + "_not", {}, 9.0)],
        "ts timestamp, metric string, labels map<string,string>, value double",
    )
    panels = server_panels(samples)
    assert rows(panels["Status"], "value", "state", "colour") == [(0.0, "DOWN", "red")]
    assert rows(panels["Memory Used"], "value") == [(2097152.0,)]
    assert rows(panels["GC Time Rate"], "ts", "label", "value") == [(at(0), "Minor GC Time", None), (at(30), "Minor GC Time", 1.0)]
    assert panels["Stages"].count() == 0 and panels["Active Jobs"].count() == 0


@pytest.mark.parametrize("minutes", [1, 5, 7, 8, 11, 13, 15])
@pytest.mark.parametrize("busy", [5, 50, 10**6])
def test_rate_does_not_depend_on_how_slices_are_cut(spark, monkeypatch, minutes, busy):
    monkeypatch.setattr(skew, "SLICE_ROWS", busy)
    rnd = random.Random(minutes)
    samples = [("a", rnd.randrange(3 * 3600), float(rnd.randrange(30))) for _ in range(700)]
    got = got_rates(metrics.counter_rate(series(spark, *samples), "k", "ts", "v", f"{minutes} minutes"))
    assert_same(got, brute_rates(samples, minutes * 60))


def test_series_of_two_instances_are_apart(spark):
    samples = [(at(s), "up", {"job": "j", "i": "a"}, 0.0) for s in range(0, 600, 30)]
    samples += [(at(s), "up", {"i": "b", "job": "j"}, 1.0) for s in range(0, 600, 30)]
    df = spark.createDataFrame(samples, "ts timestamp, metric string, labels map<string,string>, value double")
    rules = spark.createDataFrame([("Down", "up", "j", "equals", 0.0, 120, "critical")], metrics.RULE_SCHEMA)
    assert [r.labels for r in metrics.evaluate_rules(df, rules).collect()] == ["i=a,job=j"]
