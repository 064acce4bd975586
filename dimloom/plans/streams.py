"""Streaming queries: the events table read as a stream to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimloom.plans.catalog import query
from dimloom.plans.staging import TABLES, Staging, ntz
from dimloom.session import scratch_path
from dimloom.streaming import loads as S
from dimloom.streaming.unique import UniqueTable


PIECES = 3


def arrivals(t: Staging, name: str, piece, overlap: bool = False, files: int = 1) -> DataFrame:
    """The events as a stream of several batches.

    ``piece`` gives the number of the batch of each event, from 0. With ``overlap`` each event also comes in the batch after its
    own. A batch is written as ``files`` files; set more of them for more data.
    """
    path, batch = scratch_path(t.spark, name), F.col("_piece")
    rows = t.table("events").withColumn("_piece", piece)
    for i in range(PIECES):
        mine = batch.isin(i, (i - 1) % PIECES) if overlap else batch == i
        rows.where(mine).drop("_piece").repartition(files).write.mode("append").parquet(path)
    return S.read_stream(t.spark, path, T.StructType.fromDDL(TABLES["events"]), files_per_batch=files)


def shuffled(t: Staging, name: str, **kw) -> DataFrame:
    """Batches out of order: each holds events of all times, the first the ids that leave most over."""
    return arrivals(t, name, PIECES - 1 - F.pmod("event_id", F.lit(PIECES)), **kw)


def in_time(t: Staging, name: str) -> DataFrame:
    """Batches one after the other in event time."""
    days = t.table("events").agg(F.min("ts"), F.max("ts")).first()
    step = (days[1] - days[0]) / PIECES
    piece = F.lit(0)
    for i in range(1, PIECES):
        piece = piece + (F.col("ts") > ntz((days[0] + step * i).isoformat(" "))).cast("int")
    return arrivals(t, name, piece)


def place(t: Staging, name: str) -> tuple[str, str]:
    return scratch_path(t.spark, name), scratch_path(t.spark, f"{name}-progress")


USER = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("event_id", T.LongType()),
                     T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])


@query("stream_upsert", "X1 X2 M15", """
    SELECT user_id, event_id, event_type, value FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) x WHERE rn = 1""")
def stream_upsert(t: Staging) -> DataFrame:
    """The newest event per user, whatever order the batches come in."""
    path, progress = place(t, "upsert")
    log = S.UpsertLog(t.spark, path, USER, ["user_id"], ["-event_id"])
    S.run(shuffled(t, "upsert-in"), log.on_batch, progress)
    return log.current()


USER_DIM = "user_id bigint, event_type string, valid_from timestamp_ntz, valid_to timestamp_ntz, is_current boolean"


@query("stream_scd2", "X2 M8", """
    WITH changes AS (SELECT DISTINCT user_id, 'error' AS event_type, TIMESTAMP '2023-01-01' AS ts FROM events WHERE event_type = 'error'
                     UNION ALL SELECT user_id, event_type, ts FROM events),
    seen AS (SELECT *, ROW_NUMBER() OVER w AS pos, LAG(event_type) OVER w AS prev FROM changes WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    kept AS (SELECT * FROM seen WHERE pos = 1 OR event_type IS DISTINCT FROM prev)
    SELECT user_id, event_type, ts AS valid_from, LEAD(ts) OVER (PARTITION BY user_id ORDER BY ts) AS valid_to,
           LEAD(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL AS is_current FROM kept""")
def stream_scd2(t: Staging) -> DataFrame:
    """Users' event types as versions by event time, on top of an earlier state."""
    path, progress = place(t, "scd2")
    before = t.table("events").where("event_type = 'error'").select("user_id").distinct().select(
        "user_id", F.lit("error").alias("event_type"), ntz("2023-01-01 00:00:00").alias("valid_from"),
        F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit(True).alias("is_current"))
    schema = T.StructType.fromDDL(USER_DIM)
    dim = S.Scd2Stream(t.spark, path, schema, ["user_id"], {"event_type": "null_safe"}, "ts", before)
    S.run(in_time(t, "scd2-in").select("user_id", "event_type", "ts"), dim.on_batch, progress)
    return dim.read()


@query("stream_deduplicate", "X3 M13", "SELECT event_id, user_id, event_type, value FROM events")
def stream_deduplicate(t: Staging) -> DataFrame:
    """Every event arrives twice, in two batches, and leaves once; batches reach back to the oldest events."""
    path, progress = place(t, "dedup")
    table = UniqueTable(t.spark, path, T.StructType.fromDDL(TABLES["events"]), ["event_id"], ["ts"])
    S.run(shuffled(t, "dedup-in", overlap=True), table.on_batch, progress)
    return table.read().select("event_id", "user_id", "event_type", "value")


@query("stream_first_visits", "X3 M13", """
    SELECT user_id, event_type, event_id, value FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) x WHERE rn = 1""")
def stream_first_visits(t: Staging) -> DataFrame:
    """The first event of each kind per user, though the batches come in any order: later batches correct earlier ones."""
    path, progress = place(t, "first")
    table = UniqueTable(t.spark, path, T.StructType.fromDDL(TABLES["events"]), ["user_id", "event_type"], ["ts", "event_id"])
    S.run(shuffled(t, "first-in"), table.on_batch, progress)
    return table.read().select("user_id", "event_type", "event_id", "value")


@query("stream_append_new", "X5 M3", "SELECT user_id, event_id, event_type, value FROM events WHERE event_type <> 'view'")
def stream_append_new(t: Staging) -> DataFrame:
    """Append what an earlier load (the views) did not have."""
    path, progress = place(t, "append")
    loaded = t.table("events").where("event_type = 'view'")
    table = UniqueTable(t.spark, path, USER, ["event_id"], ["event_id"], corrections=False, loaded=loaded)
    S.run(shuffled(t, "append-in"), table.on_batch, progress)
    return table.read()


@query("stream_late_rows", "X4", """
    SELECT event_id, event_type, ts < (SELECT MAX(ts) FROM events) - INTERVAL 5 DAY AS is_late FROM events""")
def stream_late_rows(t: Staging) -> DataFrame:
    """Events more than five days behind the newest loaded one are kept apart, not lost. The newest event is loaded beforehand."""
    path, progress = place(t, "late")
    schema = T.StructType.fromDDL("event_id bigint, event_type string, ts timestamp_ntz")
    good, late = S.BatchTable(t.spark, f"{path}/good", schema), S.BatchTable(t.spark, f"{path}/late", schema)
    loaded = t.table("events").agg(F.max("ts").alias("ts"))
    S.run(shuffled(t, "late-in"), S.route_late(good, late, "ts", "5 days", loaded), progress)
    return good.read().select("event_id", "event_type", F.lit(False).alias("is_late")).unionByName(
        late.read().select("event_id", "event_type", F.lit(True).alias("is_late")))


@query("stream_change_feed", "X6", """
    WITH last AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) x WHERE rn = 1)
    SELECT COALESCE(l.user_id, c.c_custkey) AS user_id, CASE WHEN l.user_id IS NOT NULL THEN l.value ELSE -1 END AS value
    FROM customer c FULL JOIN last l ON l.user_id = c.c_custkey WHERE COALESCE(l.event_type, '') <> 'error'""")
def stream_change_feed(t: Staging) -> DataFrame:
    """Deletes and updates over several batches, out of order."""
    path, progress = place(t, "feed")
    start = t.table("customer").select(F.col("c_custkey").alias("user_id"), F.lit(-1.0).alias("value"))
    feed = S.ChangeFeed(t.spark, path, T.StructType.fromDDL("user_id bigint, value double"), ["user_id"], "event_id", "op", T.LongType(), start)
    changes = shuffled(t, "feed-in").select("user_id", "event_id", "value", F.when(F.col("event_type") == "error", "D").otherwise("U").alias("op"))
    S.run(changes, feed.on_batch, progress)
    return feed.current()


@query("stream_freshness", "X7 C10", """
    SELECT MAX(ts) AS max_loaded_at, date_sub('hour', MAX(ts), MAX(ts) + INTERVAL 30 HOUR) AS age_hours, 'warn' AS status FROM events""")
def stream_freshness(t: Staging) -> DataFrame:
    """Judged 30 hours after the newest event; the last batch speaks for all."""
    path, progress = place(t, "freshness")
    newest = t.table("events").agg(F.max("ts")).first()[0]
    now = ntz(newest.isoformat(" ")) + F.expr("interval 30 hours")
    table = S.BatchTable(t.spark, path, T.StructType.fromDDL("max_loaded_at timestamp_ntz, age_hours bigint, status string"))
    S.run(shuffled(t, "freshness-in"), S.monitor_freshness(table, "ts", now), progress)
    return table.read().where(F.col("batch") == table.batches()[-1]).drop("batch")
