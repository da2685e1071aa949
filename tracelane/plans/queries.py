"""The driver's queries: each measure over the synthetic capture of the table events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.operators import audit, clock, report, views
from tracelane.plans.capture import Capture
from tracelane.plans.demo import as_mlog, demo_tables, without_clients, without_clocks
from tracelane.plans.schema import OBJECT_KEY, Tables
from tracelane.sources.load import load_tables
from tracelane.sources.mlog import TraceSource
from tracelane.sources.store import Store, scratch
from tracelane.streaming.ingest import streamed_rates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
DIGITS = 6


def _rounded(df: DataFrame) -> DataFrame:
    """Fractions to a fixed number of digits, so that two engines' sums agree."""
    return df.select(*[F.round(c, DIGITS).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_open: dict[tuple, Capture] = {}


def _capture(spark: SparkSession, sf_dir: str, tables: Callable[[Tables], Tables]) -> Capture:
    """The capture of a session over these tables, opened once: what several measures read is written at its first use."""
    key = (spark.sparkContext.applicationId, sf_dir, tables)
    if key not in _open:
        _open[key] = Capture(tables(demo_tables(spark, sf_dir)))
    return _open[key]


def _whole(t: Tables) -> Tables:
    return t


def _recovered(t: Tables) -> Tables:
    return clock.recover_clocks(without_clocks(t))


def _query(f: Callable[[Capture], DataFrame], tables: Callable[[Tables], Tables] = _whole, name: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(f(_capture(spark, sf_dir, tables)))

    QUERIES[name or f.__name__] = run


def _measure(name: str):
    return lambda f: _query(f, name=name)


@_measure("object")
def _(c):
    return c.object


@_measure("capture_start")
def _(c):
    return views.capture_start(c.object)


@_measure("hop")
def _(c):
    return c.hop


@_measure("dwell")
def _(c):
    return c.dwell


@_measure("leg")
def _(c):
    return c.leg


@_measure("leg_summary")
def _(c):
    return views.leg_summary(c.leg)


@_measure("jitter")
def _(c):
    return c.jitter


@_measure("jitter_summary")
def _(c):
    return views.jitter_summary(c.jitter)


@_measure("jitter_series")
def _(c):
    return views.jitter_series(c.jitter, c.object)


@_measure("relay_series")
def _(c):
    return views.relay_series(c.leg, c.jitter, c.object)


@_measure("interarrival")
def _(c):
    return c.interarrival


@_measure("object_bitrate")
def _(c):
    return c.object_bitrate


@_measure("object_bitrate_series")
def _(c):
    return c.bitrate_series_frame


@_measure("object_bitrate_summary")
def _(c):
    return views.object_bitrate_summary(c.bitrate_series_frame)


@_measure("trust")
def _(c):
    return views.trust(c.object, c.hop, c.tables.trace)


@_measure("coverage")
def _(c):
    return views.coverage(c.object, c.tables.trace)


@_measure("recovery")
def _(c):
    return views.recovery(c.tables)


@_measure("distribution_sample")
def _(c):
    return c.distribution_sample


@_measure("distribution_summary")
def _(c):
    return views.distribution_summary(c.counted_sample)


@_measure("distribution_bin")
def _(c):
    sample = c.counted_sample
    return views.distribution_bin(sample, views.distribution_summary(sample))


@_measure("event")
def _(c):
    return c.event


@_measure("track")
def _(c):
    return c.tables.track


@_measure("shape_census")
def _(c):
    return c.tables.shape.withColumn("unconsumed", F.array_join("unconsumed", ", "))


@_measure("shape_drift")
def _(c):
    return c.shape_drift


@_measure("audit_duplicates")
def _(c):
    return audit.audit_duplicates(c.tables)


@_measure("leg_pivot")
def _(c):
    return report.leg_pivot(views.leg_summary(c.leg))


@_measure("received_tracks")
def _(c):
    return report.received_tracks(views.object_bitrate_summary(c.bitrate_series_frame))


@_measure("throughput_ends")
def _(c):
    return report.summarized_tracks(report.throughput_ends(views.object_bitrate_summary(c.bitrate_series_frame)))


@_measure("charted_tracks")
def _(c):
    return report.charted_tracks(c.bitrate_series_frame)


@_measure("delivery_totals")
def _(c):
    return report.delivery_totals(views.trust(c.object, c.hop, c.tables.trace))


@_measure("clock_totals")
def _(c):
    return report.clock_totals(views.trust(c.object, c.hop, c.tables.trace))


@_measure("not_joined")
def _(c):
    return report.not_joined(views.trust(c.object, c.hop, c.tables.trace))


def _relay(f, name):
    _query(f, without_clients, name)


_relay(lambda c: views.leg_summary(c.leg), "relay_only_leg_summary")
_relay(lambda c: views.trust(c.object, c.hop, c.tables.trace), "relay_only_trust")
_relay(lambda c: views.coverage(c.object, c.tables.trace), "relay_only_coverage")
_relay(lambda c: views.distribution_summary(c.counted_sample), "relay_only_distribution")

_query(lambda c: clock.clock_recovery(c.object, c.tables.trace), without_clocks, "clock_recovery")
_query(lambda c: c.dwell, _recovered, "recovered_dwell")
_query(lambda c: report.recovery_notice(views.recovery(c.tables)), _recovered, "recovery_notice")


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of JSON text: a number by path, the keys, and how many there are."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.array_join(F.json_object_keys("props"), ",").alias("keys"), F.get_json_object("props", "$.none").alias("missing"))


def _written(spark: SparkSession, t: Tables, bare: bool = False) -> list[TraceSource]:
    """The tables as log files in a scratch folder, one of few records a trace. bare: every stream id is 0."""
    folder, sources = scratch(spark), []
    lines = as_mlog(t)
    if bare:
        lines = lines.withColumn("line", F.regexp_replace("line", '"stream_id":[0-9]+', '"stream_id":0'))
    lines = Store(spark).keep(lines, "lines")
    for r in t.trace.select("filename", "cid").orderBy("trace_id").collect():
        at = f"{folder}/{r.filename}"
        lines.where(F.col("filename") == r.filename).coalesce(1).sortWithinPartitions("time_us", "line").select("line").write.text(at)
        path = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(at).select("path").first().path
        sources.append(TraceSource(r.filename, r.cid, path))
    return sources


def table_counts(t: Tables, store: Store) -> DataFrame:
    """The rows of each table and trace, and the sums of their times and sizes. Sums are exact: they are longs, as in the SQL, or decimals if one is beyond a long."""
    one = lambda name, f, *sums: f.groupBy("trace_id").agg(F.count("*").alias("n"), *[F.coalesce(F.sum(s.cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias(a) for s, a in sums]).withColumn("part", F.lit(name))
    c, nothing = F.col, F.lit(0)
    rows = one("subgroup_object", t.subgroup_object, (c("time_us"), "times"), (c("payload_length"), "sizes"))
    rows = rows.unionByName(one("subgroup_stream", t.subgroup_stream, (c("time_us"), "times"), (c("group_id"), "sizes")))
    rows = rows.unionByName(one("control_message", t.control_message, (c("time_us"), "times"), (c("subscribe_id"), "sizes")))
    rows = rows.unionByName(one("track", t.track, (nothing, "times"), (c("track_alias"), "sizes")))
    rows = rows.unionByName(one("trace", t.trace, (c("reference_us"), "times"), (nothing, "sizes"))).select("part", "trace_id", "n", "times", "sizes")
    rows = store.keep(rows, "counts")  # a few rows a trace
    beyond = rows.where(F.greatest(F.abs("times"), F.abs("sizes")) > (1 << 63) - 1).limit(1).count()
    return rows if beyond else rows.withColumns({a: c(a).cast("long") for a in ("times", "sizes")})


def mlog_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the capture as logs, loads them, and counts the rows of each table and their times and sizes."""
    store = Store(spark)
    return table_counts(load_tables(spark, _written(spark, demo_tables(spark, sf_dir)), store=store), store)


def streaming_bitrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rates of object_bitrate, from a stream over the objects in files."""
    t = demo_tables(spark, sf_dir)
    rows = views.objects(t).join(t.trace.select("trace_id", "cid", "vantage_point"), "trace_id").select("cid", "trace_id", "vantage_point", "direction", "track_namespace", "track_name", "wall_us", "payload_length")
    folder = scratch(spark)
    rows.repartitionByRange(4, "wall_us").write.parquet(f"{folder}/objects")
    return streamed_rates(spark, f"{folder}/objects", "cid string, trace_id int, vantage_point string, direction string, track_namespace string, track_name string, wall_us long, payload_length long", folder)


def stream_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object of the capture, logged without stream ids: how well the recovered ids part the streams of each trace.

    A row for each stream and each id that objects of it got; found_id is null for the objects of subgroups that cannot be cut into chains.
    """
    t = demo_tables(spark, sf_dir)
    back = load_tables(spark, _written(spark, t, bare=True))

    def placed(tables: Tables, name: str) -> DataFrame:
        streams = tables.subgroup_stream.select("trace_id", "stream_id", "group_id", "subgroup_id")
        return tables.subgroup_object.join(streams, ["trace_id", "stream_id"]).select("trace_id", F.col("stream_id").alias(name), "group_id", "subgroup_id", "object_id", "time_us", "payload_length")

    pairs = placed(t, "true_id").join(placed(back, "found_id"), ["trace_id", "group_id", "subgroup_id", "object_id", "time_us", "payload_length"], "left")
    return pairs.groupBy("trace_id", "true_id", "found_id").agg(F.count("*").alias("objects"))


def except_all_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects loaded from logs and those they were written from, less each other, both ways: rows that differ."""
    t = demo_tables(spark, sf_dir)
    back = load_tables(spark, _written(spark, t))
    a, b = (views.objects(x).select("trace_id", "direction", *OBJECT_KEY, "wall_us", "payload_length") for x in (t, back))
    return a.exceptAll(b).agg(F.count("*").alias("missing")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("added")))


for _f in (json_fields, mlog_roundtrip, streaming_bitrate, stream_ids, except_all_equivalence):
    QUERIES[_f.__name__] = _f
