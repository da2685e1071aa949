"""A synthetic capture over the driver's events: every event is an object that a publisher sends, a relay passes on and two subscribers receive.

The statements are plain SQL that reads the same everywhere; EPOCH stands for the microseconds of an event's time.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tracelane.plans.schema import CLOCK_RECOVERY, Tables
from tracelane.sources.load import census
from tracelane.sources.store import scratch

SPARK_EPOCH = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"

#: Of each event: when it is sent (t0), reaches the relay (t1), its track, group, number and size.
SENT = """
    SELECT event_id, track, trackno, grp, len, t0, t0 + 40000 + (event_id * 7919 % 20011) AS t1,
           CAST(row_number() OVER (PARTITION BY track, grp ORDER BY t0, event_id) - 1 AS BIGINT) AS oid
    FROM (SELECT event_id, event_type AS track, CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS BIGINT) AS trackno,
                 CAST(floor(event_id / 200) AS BIGINT) AS grp, CAST(round(value * 100) AS BIGINT) AS len, CAST(floor(EPOCH / 1000) AS BIGINT) AS t0 FROM events) e"""
#: When each subscriber's subscription to a track is confirmed; the second joins two minutes late.
OK = """
    SELECT s.sub, s.out_trace, m.track, m.trackno, m.first_t1 + s.late AS ok_at
    FROM (SELECT track, trackno, min(t1) AS first_t1 FROM sent GROUP BY track, trackno) m
    CROSS JOIN (SELECT 's1' AS sub, 3 AS out_trace, CAST(0 AS BIGINT) AS late UNION ALL SELECT 's2', 5, CAST(120000000 AS BIGINT)) s"""
#: As the relay sends it on (t2) and the subscriber receives it (t3); some are lost, and the second log ends early.
PASSED = """
    SELECT p.*, CASE WHEN event_id % 500 = 7 THEN t2 - 50 ELSE t2 + 30000 + (event_id * 15485863 % 9001) END AS t3,
           NOT (event_id % 97 = 3 OR (sub = 's2' AND t0 > last_t0 - 100000000)) AS arrives
    FROM (SELECT s.*, o.sub, o.out_trace, greatest(s.t1 + 100 + (s.event_id * 104729 % 3001), o.ok_at + s.event_id % 1000) AS t2, max(s.t0) OVER () AS last_t0
          FROM sent s JOIN ok o ON s.track = o.track) p"""
LOGGED = """
    SELECT 1 AS trace_id, 'created' AS direction, track, trackno, grp, oid, t0 AS time_us, len FROM sent
    UNION ALL SELECT 2, 'parsed', track, trackno, grp, oid, t1, len FROM sent
    UNION ALL SELECT out_trace, 'created', track, trackno, grp, oid, t2, len FROM passed
    UNION ALL SELECT out_trace + 1, 'parsed', track, trackno, grp, oid, t3, len FROM passed WHERE arrives"""
TRACE = """
    SELECT trace_id, cid, concat(cid, '_', vantage_point, '.mlog') AS filename, vantage_point, CAST(0 AS BIGINT) AS reference_us, 'logged' AS reference_time_source, 'logged' AS stream_id_source, 'relative' AS time_format
    FROM (SELECT 1 AS trace_id, 'pub' AS cid, 'client' AS vantage_point UNION ALL SELECT 2, 'pub', 'server' UNION ALL SELECT 3, 's1', 'server' UNION ALL SELECT 4, 's1', 'client' UNION ALL SELECT 5, 's2', 'server' UNION ALL SELECT 6, 's2', 'client') t"""
STREAM = """
    SELECT trace_id, (grp * 5 + trackno) * 4 + CASE direction WHEN 'created' THEN 3 ELSE 2 END AS stream_id, direction, min(time_us) - 1000 AS time_us, 'subgroup' AS header_type, trackno + 1 AS track_alias,
           grp AS group_id, CAST(0 AS BIGINT) AS subgroup_id, CAST(127 AS INT) AS publisher_priority
    FROM logged GROUP BY trace_id, direction, trackno, grp"""
OBJECT = """
    SELECT trace_id, (grp * 5 + trackno) * 4 + CASE direction WHEN 'created' THEN 3 ELSE 2 END AS stream_id, oid AS object_id, time_us, len AS payload_length, CAST(0 AS INT) AS extension_count FROM logged"""
#: Every trace subscribes to every track; the subscriber's confirmation bears the direction of its end.
CONTROL = """
    SELECT x.trace_id, o.ok_at + m.shift AS time_us, CASE WHEN (x.trace_id IN (3, 5)) = (m.message_type = 'subscribe_ok') THEN 'created' ELSE 'parsed' END AS direction, m.message_type, CAST(0 AS BIGINT) AS stream_id,
           o.trackno AS subscribe_id, CASE m.message_type WHEN 'subscribe_ok' THEN o.trackno + 1 END AS track_alias, CASE m.message_type WHEN 'subscribe' THEN '/events' END AS track_namespace,
           CASE m.message_type WHEN 'subscribe' THEN o.track END AS track_name
    FROM ok o
    JOIN (SELECT 1 AS trace_id, 3 AS out_trace UNION ALL SELECT 2, 3 UNION ALL SELECT 3, 3 UNION ALL SELECT 4, 3 UNION ALL SELECT 5, 5 UNION ALL SELECT 6, 5) x ON x.out_trace = o.out_trace
    CROSS JOIN (SELECT 'subscribe' AS message_type, CAST(-1000 AS BIGINT) AS shift UNION ALL SELECT 'subscribe_ok', 0) m"""

STEPS = {"sent": SENT, "ok": OK, "passed": PASSED, "logged": LOGGED, "trace": TRACE, "subgroup_stream": STREAM, "subgroup_object": OBJECT, "control_message": CONTROL}


def with_clause(names: list[str], epoch: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({STEPS[n].replace('EPOCH', epoch)})" for n in names)


_loaded: dict[tuple[str, str], str] = {}


def demo_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The tables of the synthetic capture, loaded once a session: written as Parquet, as a store of captures would hold them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _loaded:
        folder = scratch(spark)
        for name, frame in derived_tables(spark, sf_dir).items():
            frame.write.parquet(f"{folder}/{name}")
        _loaded[key] = folder
    return Tables(**{name: spark.read.parquet(f"{_loaded[key]}/{name}") for name in Tables.__dataclass_fields__})


def derived_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The tables as the statements above make them. Tracks are derived from the control messages, as a load does."""
    from tracelane.sources.load import tracks

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder, made = scratch(spark), {"events": events}

    def get(name: str, columns: str = "*") -> DataFrame:
        text = re.sub(r"\b(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in made else m[0], STEPS[name].replace("EPOCH", SPARK_EPOCH))
        used = {n: f for n, f in made.items() if f"{{{n}}}" in text}
        return spark.sql(f"SELECT {columns} FROM ({text})", **used)

    for name in ("sent", "ok", "passed", "logged"):
        get(name).write.parquet(f"{folder}/{name}")
        made[name] = spark.read.parquet(f"{folder}/{name}")
    control = get("control_message", "trace_id, time_us, direction, message_type, stream_id, subscribe_id, CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS STRING) AS request_kind, track_alias, track_namespace, track_name, map_from_arrays(array(), array()) AS parameters, CAST(NULL AS STRING) AS track_extensions")
    trace = get("trace", "trace_id, cid, filename, CAST(NULL AS TIMESTAMP) AS loaded_at, CAST(NULL AS STRING) AS title, CAST(NULL AS STRING) AS description, vantage_point, reference_us, reference_time_source, stream_id_source, CAST(NULL AS INT) AS stream_id_uncertain, CAST(NULL AS INT) AS stream_id_unresolved, time_format, CAST(NULL AS STRING) AS flush_policy, CAST(NULL AS STRING) AS qlog_version, CAST(NULL AS STRING) AS qlog_format, CAST(NULL AS ARRAY<STRING>) AS event_schemas")
    other = events.selectExpr("CAST(1 AS INT) AS trace_id", f"CAST(floor({SPARK_EPOCH} / 1000) AS BIGINT) AS time_us", "event_type AS name", "props AS data")
    shape = census(other.selectExpr("trace_id", "name", "time_us", "data"))
    return Tables(trace, control, get("subgroup_stream"), get("subgroup_object"), other, tracks(control), shape, spark.createDataFrame([], CLOCK_RECOVERY))


def without_clients(t: Tables) -> Tables:
    """The relay's logs alone."""
    keep = t.trace.where("vantage_point = 'server'")
    ids = [2, 3, 5]
    return t.with_(trace=keep, **{n: f.where(f.trace_id.isin(ids)) for n, f in t.items() if n not in ("trace", "clock_recovery")})


def without_clocks(t: Tables, shift_us: int = 5_000_000) -> Tables:
    """The relay's outgoing traces lose their reference time, and their times are off by a constant."""
    from pyspark.sql import functions as F

    out = F.col("trace_id").isin(3, 5)
    moved = lambda f: f.withColumn("time_us", F.when(out, F.col("time_us") + shift_us).otherwise(F.col("time_us")))
    trace = t.trace.withColumn("reference_time_source", F.when(out, "none").otherwise(F.col("reference_time_source")))
    return t.with_(trace=trace, control_message=moved(t.control_message), subgroup_stream=moved(t.subgroup_stream), subgroup_object=moved(t.subgroup_object))


def as_mlog(t: Tables) -> DataFrame:
    """filename, time_us, line: the tables' traces, messages, streams and objects written back as records."""
    from pyspark.sql import functions as F

    names = t.trace.select("trace_id", "filename")
    text = lambda c: F.to_json(c)
    head = t.trace.select("filename", F.lit(-1).cast("long").alias("time_us"), text(F.struct(F.lit("0.3").alias("qlog_version"), F.struct(F.struct(F.col("vantage_point").alias("type")).alias("vantage_point"), F.struct(F.lit("relative").alias("time_format"), (F.col("reference_us") / 1000).alias("reference_time")).alias("common_fields")).alias("trace"))).alias("line"))

    def record(rows: DataFrame, kind: str, data) -> DataFrame:
        named = rows.join(names, "trace_id")
        return named.select("filename", "time_us", text(F.struct((F.col("time_us") / 1000).alias("time"), F.concat(F.lit(f"moqt:{kind}_"), "direction").alias("name"), data.alias("data"))).alias("line"))

    control = record(t.control_message, "control_message", F.struct("message_type", "stream_id", "subscribe_id", "track_alias", "track_namespace", "track_name"))
    streams = record(t.subgroup_stream, "subgroup_header", F.struct("stream_id", "header_type", "track_alias", "group_id", "publisher_priority", "subgroup_id"))
    where = t.subgroup_stream.select("trace_id", "stream_id", "direction", "group_id", "subgroup_id")
    objects = record(t.subgroup_object.join(where, ["trace_id", "stream_id"]), "subgroup_object", F.struct("stream_id", "group_id", "subgroup_id", "object_id", F.array().cast("array<string>").alias("extension_headers"), F.col("payload_length").alias("object_payload_length")))
    return head.unionByName(control).unionByName(streams).unionByName(objects)
