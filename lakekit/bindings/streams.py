"""Streams over the events and orders, run to the end of the available input and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import buckets
from ..session import scratch_path
from ..sources.files import stream_path
from ..streaming.alerts import stream_sustained as run_alerts
from ..streaming.ingest import Derived, refresh, stream_sentinels, stream_to_table
from ..streaming import rollups
from ..streaming.rollups import Rollup
from ..streaming.upsert import foreach_batch_upsert
from ..streaming.windows import stream_rate as rate
from .common import fresh_table, table, zoneless


def _input(folder, name):
    # a glob, so that a table may be one file or a folder of files
    return f"{folder}/{name}.parque[t]"


def _stream(spark, folder, name):
    return stream_path(spark, _input(folder, name), table(spark, folder, name).schema)


def stream_append(spark, folder):
    path = scratch_path(spark, "stream-append")
    kept = _stream(spark, folder, "events").filter(F.col("event_type") != "view").drop("props")
    stream_to_table(kept, f"{path}/rows", f"{path}/checkpoint", partition_by=["event_type"])
    # a second run finds nothing new
    stream_to_table(kept, f"{path}/rows", f"{path}/checkpoint", partition_by=["event_type"])
    return spark.read.schema(kept.schema).parquet(f"{path}/rows")


def stream_clean_start(spark, folder):
    """A stream whose checkpoint and target do not exist yet, below folders that do not either; started twice."""
    path = f"{scratch_path(spark, 'stream-clean')}/not/there"
    errors = _stream(spark, folder, "events").filter(F.col("event_type") == "error").select("event_id", "user_id", "value")
    for _ in range(2):
        stream_to_table(errors, f"{path}/rows", f"{path}/deeper/checkpoint")
    return spark.read.schema(errors.schema).parquet(f"{path}/rows")


def _rates(spark, folder, window, slide):
    path = scratch_path(spark, "stream-rate")
    rates = rate(_stream(spark, folder, "events"), "event_type", "ts", "value", window, slide)
    stream_to_table(rates, f"{path}/rows", f"{path}/checkpoint")
    out = zoneless(spark.read.schema(rates.schema).parquet(f"{path}/rows"))
    return out.withColumn("total", F.round("total", 2)).withColumn("rate", F.round("rate", 5))


def stream_rate(spark, folder):
    return _rates(spark, folder, "5 minutes", None)


def stream_rate_sliding(spark, folder):
    return _rates(spark, folder, "5 minutes", "1 minute")


def stream_sentinel_feed(spark, folder):
    path = scratch_path(spark, "stream-sentinels")
    month = F.date_format("o_orderdate", "yyyy-MM")
    files = _stream(spark, folder, "orders").select(
        F.concat(
            F.lit("partitioned/cycle="), F.year("o_orderdate"), F.lit("/_months/"), month, F.lit("-"),
            F.col("o_orderkey"), F.when(F.col("o_orderstatus") == "F", ".done").otherwise(".part"),
        ).alias("path"),
        F.col("o_orderdate").alias("seen_at"),
    )
    feed = stream_sentinels(files, "seen_at")
    stream_to_table(feed, f"{path}/rows", f"{path}/checkpoint")
    return zoneless(spark.read.schema(feed.schema).parquet(f"{path}/rows"))


def stream_upsert(spark, folder):
    path = scratch_path(spark, "stream-upsert")
    events = _stream(spark, folder, "events")
    name, root = fresh_table(spark, "newest")
    buckets.create_keyed(spark, name, events.schema, root, ["user_id"])
    sink = foreach_batch_upsert(name, ["user_id"], newest_by="ts")
    query = (
        events.writeStream.foreachBatch(sink)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.table(name)


def stream_sustained(spark, folder):
    """Closed alert intervals; slices of a second that end in the last ten minutes still wait for the watermark."""
    path = scratch_path(spark, "stream-sustained")
    alerts = run_alerts(
        _stream(spark, folder, "events"), "event_type", "ts", F.col("value") > 5, "30 minutes", path
    )
    closed = alerts.filter(F.col("status") == "closed").drop("status")
    return zoneless(closed.withColumnsRenamed({"start": "started_at", "end": "ended_at"}))


def refresh_derived(spark, folder):
    root = scratch_path(spark, "refresh")
    spec = Derived(
        name=f"default.large_orders_{root[-12:]}",
        source=_input(folder, "orders"),
        source_schema=table(spark, folder, "orders").schema,
        transform=lambda df: df.filter(F.col("o_totalprice") > 250000).select("o_orderkey", "o_totalprice"),
        root=root,
    )
    refresh(spark, spec)
    refresh(spark, spec)
    refresh(spark, spec, full=True)
    return spark.table(spec.name)


def refresh_rollup(spark, folder):
    """Measures per flag and status from three lots of line items, each read once, merged in between."""
    lines = table(spark, folder, "lineitem")
    path = scratch_path(spark, "rollup")
    spec = Rollup(
        name=f"default.line_totals_{path[-12:]}",
        source=f"{path}/in",
        source_schema=lines.schema,
        keys=["l_returnflag", "l_linestatus"],
        measures={
            "lines": ("count", "*"), "discounted": ("count", "nullif(l_discount, 0)"), "quantity": ("sum", "l_quantity"),
            "first_ship": ("min", "l_shipdate"), "last_ship": ("max", "l_shipdate"), "tax": ("avg", "l_tax"),
            "orders": ("distinct", "l_orderkey"), "price": ("quantiles", "l_extendedprice"),
        },
        root=path,
        transform=lambda df: df.filter("l_quantity > 2"),
    )
    for lot in range(3):
        lines.filter(F.col("l_orderkey") % 3 == lot).write.mode("append").parquet(f"{path}/in")
        rollups.refresh_rollup(spark, spec)
        if lot == 1:
            rollups.compact_rollup(spark, spec)
    exact = table(spark, folder, "lineitem").filter("l_quantity > 2").groupBy("l_returnflag", "l_linestatus")
    exact = exact.agg(F.count_distinct("l_orderkey").alias("n"), F.percentile("l_extendedprice", [0.05, 0.5, 0.95]).alias("q"))
    # estimates are compared with what they estimate
    close = lambda a, b, share: F.abs(a - b) <= share * b
    near = [close(F.col("price")[i], F.col("q")[i], 0.1) for i in range(3)]
    return (
        spark.table(spec.name)
        .join(exact, ["l_returnflag", "l_linestatus"])
        .withColumn("estimates", close(F.col("orders"), F.col("n"), 0.05) & near[0] & near[1] & near[2])
        .withColumn("tax", F.round("tax", 9))
        .drop("orders", "price", "n", "q")
    )


QUERIES = {
    "stream_append": stream_append,
    "stream_clean_start": stream_clean_start,
    "stream_rate": stream_rate,
    "stream_rate_sliding": stream_rate_sliding,
    "stream_sentinels": stream_sentinel_feed,
    "stream_upsert": stream_upsert,
    "stream_sustained": stream_sustained,
    "refresh": refresh_derived,
    "refresh_rollup": refresh_rollup,
}

# a window is out once the watermark, ten minutes behind the newest event, has reached its end
_CLOSED = "window_end <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM events)"

SQL = {
    "stream_append": "SELECT * EXCLUDE (props) FROM events WHERE event_type <> 'view'",
    "stream_clean_start": "SELECT event_id, user_id, value FROM events WHERE event_type = 'error'",
    "stream_rate": f"""
        SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start,
               time_bucket(INTERVAL 5 MINUTES, ts) + INTERVAL 5 MINUTES AS window_end, event_type,
               count(*) AS samples, round(sum(value), 2) AS total, round(sum(value) / 300, 5) AS rate
        FROM events GROUP BY 1, 2, 3 HAVING {_CLOSED}""",
    "stream_rate_sliding": f"""
        SELECT window_start, window_start + INTERVAL 5 MINUTES AS window_end, event_type, count(*) AS samples,
               round(sum(value), 2) AS total, round(sum(value) / 300, 5) AS rate
        FROM (SELECT *, time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(unnest([0, 1, 2, 3, 4])) AS window_start FROM events)
        GROUP BY 1, 2, 3 HAVING {_CLOSED}""",
    "stream_sentinels": """
        SELECT o_orderdate AS collected_at, CAST(year(o_orderdate) AS INTEGER) AS cycle,
               strftime(o_orderdate, '%Y-%m') || '-' || o_orderkey AS month,
               'partitioned/cycle=' || year(o_orderdate) || '/_months/' || strftime(o_orderdate, '%Y-%m') || '-'
                   || o_orderkey || '.done' AS sentinel_key
        FROM orders WHERE o_orderstatus = 'F'""",
    "stream_upsert": """
        SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1""",
    "stream_sustained": """
        WITH ready AS (
            SELECT * FROM events WHERE date_trunc('second', ts) + INTERVAL 1 SECOND <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM events)),
        marked AS (
            SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts)
                      - row_number() OVER (PARTITION BY event_type, value > 5 ORDER BY ts) AS run,
                   max(ts) OVER (PARTITION BY event_type) AS newest
            FROM ready),
        started AS (SELECT *, min(ts) OVER (PARTITION BY event_type, run) AS started_at FROM marked WHERE value > 5)
        SELECT event_type, started_at, max(ts) AS ended_at,
               min(ts) FILTER (ts - started_at >= INTERVAL 30 MINUTES) AS fired_at
        FROM started GROUP BY event_type, started_at HAVING NOT bool_or(ts = newest)""",
    "refresh_rollup": """
        SELECT l_returnflag, l_linestatus, count(*) AS lines, count(nullif(l_discount, 0)) AS discounted, sum(l_quantity) AS quantity,
               min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, round(avg(l_tax), 9) AS tax, true AS estimates
        FROM lineitem WHERE l_quantity > 2 GROUP BY 1, 2""",
    "refresh": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000",
}
