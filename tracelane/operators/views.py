"""The measures, as functions from a capture's tables to frames. Times are integer microseconds.

Nothing here collects, caches or hints: joins with the small trace and track tables are left to the planner, which knows their
size, and those between objects are equi-joins on the object key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelane.plans.schema import LEGS, OBJECT_KEY, SHAPE_BASELINE, Tables


def second(us: Column) -> Column:
    return F.floor(us / 1_000_000).cast("long")


def _on(left: str, right: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (F.col(f"{left}.{k}") == F.col(f"{right}.{k}"))
    return out


#: Microseconds of a track that one task orders.
SLICE_US = 10_000_000


def _before(rows: DataFrame, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """rows with `before`: value of the row before in the order within keys, by slices of the first of order, a time. Each slice gets the last row of the
    slice before as its first, so a busy track is many tasks' work; only a row a slice is ordered by keys alone."""
    cut = rows.withColumn("_slice", F.floor(F.col(order[0]) / SLICE_US)).withColumn("_lead", F.lit(False))
    cut = cut.withColumn("_hash", F.xxhash64(*keys, "_slice"))  # the first of what rows are sorted by: keys are much alike
    place = ["_hash", *keys, "_slice"]
    last = cut.groupBy(*place).agg(F.max(F.struct(*order, value)).alias("m"))
    last = last.withColumn("_slice", F.lead("_slice").over(Window.partitionBy(*keys).orderBy("_slice"))).where("_slice IS NOT NULL").withColumn("_hash", F.xxhash64(*keys, "_slice"))
    leads = last.select(*place, *[F.col(f"m.{c}").alias(c) for c in [*order, value]], F.lit(True).alias("_lead"))
    both = cut.unionByName(leads, allowMissingColumns=True)
    w = Window.partitionBy(*place).orderBy(F.col("_lead").desc(), *order)
    return both.withColumn("before", F.lag(value).over(w)).where("NOT _lead").drop("_slice", "_lead", "_hash")


def _key_hash() -> Column:
    """One number for an object's key. Joins sort by it first: the strings of a key are the same in most rows."""
    return F.xxhash64(*OBJECT_KEY).alias("key_hash")


def wall(trace: DataFrame) -> DataFrame:
    """trace_id and how its event times become wall times: NULL unless they are relative."""
    return trace.select("trace_id", F.when(F.col("time_format") == "relative", F.col("reference_us")).alias("origin_us"))


def objects(t: Tables) -> DataFrame:
    """Every object, with its track and the time on the wall."""
    found = t.subgroup_object.select("trace_id", "stream_id", "object_id", "time_us", "payload_length", "extension_count")
    streams = t.subgroup_stream.select("trace_id", "stream_id", "direction", "track_alias", "group_id", "subgroup_id", "publisher_priority")
    named = found.join(streams, ["trace_id", "stream_id"]).join(t.track.drop("subscribe_id"), ["trace_id", "track_alias"], "left").join(wall(t.trace), "trace_id", "left")
    return named.select(
        "trace_id", "time_us", "direction", (F.col("origin_us") + F.col("time_us")).alias("wall_us"), "track_namespace", "track_name", "group_id", "subgroup_id",
        "publisher_priority", "object_id", "payload_length", "extension_count", "stream_id", "track_alias",
    )


def capture_start(obj: DataFrame) -> DataFrame:
    """sec: the second of the first wall time. One row."""
    return obj.agg(second(F.min("wall_us")).alias("sec"))


def _since_start(series: DataFrame, obj: DataFrame) -> DataFrame:
    return series.crossJoin(capture_start(obj).withColumnRenamed("sec", "start_sec")).withColumn("t_s", F.col("sec") - F.col("start_sec")).drop("start_sec")


def hops(obj: DataFrame, trace: DataFrame) -> DataFrame:
    """An object sent on a connection and the same object received at its other end. us is signed, and NULL unless both ends logged their
    clocks."""
    end = trace.where(F.col("cid").isNotNull()).select("trace_id", "cid", (F.col("reference_time_source") == "logged").alias("clock"))
    rows = obj.select("trace_id", "direction", _key_hash(), *OBJECT_KEY, "wall_us", "payload_length").join(end, "trace_id")
    s, r = rows.where("direction = 'created'").alias("s"), rows.where("direction = 'parsed'").alias("r")
    both = s.join(r, _on("s", "r", ["key_hash", "cid", *OBJECT_KEY]) & (F.col("s.trace_id") != F.col("r.trace_id")))
    us = F.when(F.col("s.clock") & F.col("r.clock"), F.col("r.wall_us") - F.col("s.wall_us"))
    return both.select(
        "s.cid", *[f"s.{k}" for k in OBJECT_KEY], F.col("s.trace_id").alias("send_trace"), F.col("r.trace_id").alias("recv_trace"),
        F.col("s.wall_us").alias("t_send"), F.col("r.wall_us").alias("t_recv"), us.alias("us"), "s.payload_length",
    )


def relay_pairs(obj: DataFrame, trace: DataFrame) -> DataFrame:
    """An object that came into the relay and the same object as it left on another connection: in_*, out_* and the key."""
    server = trace.where("vantage_point = 'server'").select("trace_id", "cid", F.col("reference_time_source").alias("clock"))
    rows = obj.select("trace_id", "direction", _key_hash(), *OBJECT_KEY, "wall_us", "payload_length").join(server, "trace_id")
    i, o = rows.where("direction = 'parsed'").alias("i"), rows.where("direction = 'created'").alias("o")
    both = i.join(o, _on("i", "o", ["key_hash", *OBJECT_KEY]) & (F.col("i.trace_id") != F.col("o.trace_id")))
    side = [F.col(f"{a}.{c}").alias(f"{n}_{c}") for a, n in (("i", "in"), ("o", "out")) for c in ("trace_id", "cid", "clock", "wall_us")]
    return both.select(*[f"i.{k}" for k in OBJECT_KEY], *side, "i.payload_length")


def subscribed_at(t: Tables) -> DataFrame:
    """When each trace first sent subscribe_ok for each track."""
    ok = t.control_message.where("message_type = 'subscribe_ok' AND direction = 'created'").select("trace_id", "track_alias", "time_us")
    named = ok.join(t.track.select("trace_id", "track_alias", "track_namespace", "track_name"), ["trace_id", "track_alias"]).join(t.trace.select("trace_id", "reference_us"), "trace_id")
    return named.groupBy("trace_id", "track_namespace", "track_name").agg((F.max("reference_us") + F.min("time_us")).alias("ok_at"))


def dwells(obj: DataFrame, t: Tables) -> DataFrame:
    """How long the relay held each object. held: it was there before the subscriber had subscribed to the track. A pair counts if both clocks were logged,
    or if the outgoing one was recovered against just this incoming trace."""
    matched = t.clock_recovery.select(F.col("trace_id").alias("out_trace_id"), F.col("in_trace").alias("in_trace_id"), F.lit(True).alias("recovered_pair"))
    pairs = relay_pairs(obj, t.trace).join(matched, ["out_trace_id", "in_trace_id"], "left")
    pairs = pairs.where("(in_clock = 'logged' AND out_clock = 'logged') OR (out_clock = 'recovered' AND recovered_pair)")
    ok = subscribed_at(t).withColumnRenamed("trace_id", "out_trace_id")
    pairs = pairs.join(ok, ["out_trace_id", "track_namespace", "track_name"], "left")
    return pairs.select(
        "in_cid", "out_cid", *OBJECT_KEY, F.col("in_trace_id").alias("relay_in_trace"), F.col("out_trace_id").alias("relay_out_trace"), F.col("in_wall_us").alias("t_in"),
        F.col("out_wall_us").alias("t_out"), (F.col("out_wall_us") - F.col("in_wall_us")).alias("us"), "payload_length", F.coalesce(F.col("in_wall_us") < F.col("ok_at"), F.lit(False)).alias("held"),
    )


def legs(dwell: DataFrame, hop: DataFrame, trace: DataFrame) -> DataFrame:
    """The legs of whole paths: into the relay, through it, and out. A connection whose client log is loaded must have the object at both
    ends; held objects are left out. Each path is read once and unrolled."""
    hop = hop.select("cid", _key_hash(), *OBJECT_KEY, "t_send", "t_recv", "us", "payload_length")
    clients = trace.where("vantage_point = 'client'").select("cid").distinct()
    d = dwell.where("NOT held").withColumn("key_hash", _key_hash()).alias("d")
    for side, leg in (("in_cid", "a"), ("out_cid", "b")):
        h, far = hop.alias(f"h{leg}"), clients.select(F.col("cid").alias(f"far_{leg}"))
        d = d.join(h, _on("d", f"h{leg}", ["key_hash", *OBJECT_KEY]) & (F.col(f"d.{side}") == F.col(f"h{leg}.cid")), "left")
        d = d.join(far, F.col(f"d.{side}") == F.col(f"far_{leg}"), "left")
        d = d.where(F.col(f"h{leg}.cid").isNotNull() | F.col(f"far_{leg}").isNull())

    def part(no: int, start: str, end: str, us: str, size: str) -> Column:
        return F.struct(F.lit(no).alias("leg_no"), F.lit(LEGS[no]).alias("leg"), F.col(start).alias("t_start"), F.col(end).alias("t_end"), F.col(us).alias("us"), F.col(size).alias("payload_length"))

    hop_part = lambda no, h: F.when(F.col(f"{h}.us").isNotNull(), part(no, f"{h}.t_send", f"{h}.t_recv", f"{h}.us", f"{h}.payload_length"))
    three = F.array(part(2, "d.t_in", "d.t_out", "d.us", "d.payload_length"), hop_part(1, "ha"), hop_part(3, "hb"))
    rows = d.select(F.col("d.out_cid").alias("sub_cid"), F.col("d.in_cid").alias("in_cid"), *[F.col(f"d.{k}").alias(k) for k in OBJECT_KEY], F.explode(three).alias("l"))
    return rows.where("l IS NOT NULL").select("sub_cid", "in_cid", "l.leg_no", "l.leg", *OBJECT_KEY, "l.t_start", "l.t_end", "l.us", "l.payload_length")


def leg_summary(leg: DataFrame) -> DataFrame:
    q = leg.groupBy("sub_cid", "leg_no", "leg").agg(F.count("*").alias("n"), F.avg("us").alias("mean"), F.percentile("us", [0.5, 0.95]).alias("q"))
    return q.select("sub_cid", "leg_no", "leg", "n", (F.col("mean") / 1000).alias("mean_ms"), (F.col("q")[0] / 1000).alias("median_ms"), (F.col("q")[1] / 1000).alias("p95_ms"))


def jitter(leg: DataFrame) -> DataFrame:
    """The change in transit time from each object to the next of its track, as RFC 3550 defines D, and its size."""
    d = _before(leg, "us", ["sub_cid", "leg_no", "track_namespace", "track_name"], ["t_end", "group_id", "subgroup_id", "object_id"])
    return d.withColumn("d_us", F.col("us") - F.col("before")).select("sub_cid", "leg_no", "leg", *OBJECT_KEY, "t_end", "payload_length", "d_us", F.abs("d_us").alias("jitter_us"))


def jitter_summary(jit: DataFrame) -> DataFrame:
    q = jit.where("jitter_us IS NOT NULL").groupBy("sub_cid", "leg_no", "leg")
    q = q.agg(F.count("*").alias("n"), F.avg("jitter_us").alias("mean"), F.percentile("jitter_us", [0.95, 0.99]).alias("q"), F.max("jitter_us").alias("most"))
    return q.select("sub_cid", "leg_no", "leg", "n", (F.col("mean") / 1000).alias("mean_ms"), (F.col("q")[0] / 1000).alias("p95_ms"), (F.col("q")[1] / 1000).alias("p99_ms"), (F.col("most") / 1000).alias("max_ms"))


def jitter_series(jit: DataFrame, obj: DataFrame) -> DataFrame:
    per = jit.where("jitter_us IS NOT NULL").groupBy("sub_cid", "leg_no", "leg", second(F.col("t_end")).alias("sec"))
    per = per.agg(F.count("*").alias("n"), (F.avg("jitter_us") / 1000).alias("mean_ms"), (F.max("jitter_us") / 1000).alias("max_ms"))
    return _since_start(per, obj).select("sub_cid", "leg_no", "leg", "sec", "t_s", "n", "mean_ms", "max_ms")


def relay_series(leg: DataFrame, jit: DataFrame, obj: DataFrame) -> DataFrame:
    """Per second: dwell and its jitter over all subscribers, and the jitter of each."""

    def series(rows: DataFrame, name: str, sub: Column, value: str) -> DataFrame:
        return rows.groupBy(F.lit(name).alias("series"), sub.alias("sub_cid"), second(F.col("t_end")).alias("sec")).agg(F.count("*").alias("n"), (F.avg(value) / 1000).alias("mean_ms"))

    nobody = F.lit(None).cast("string")
    moved = jit.where("jitter_us IS NOT NULL")
    per = series(leg.where("leg_no = 2"), "relay dwell", nobody, "us")
    per = per.unionByName(series(moved.where("leg_no = 2"), "relay egress jitter", nobody, "jitter_us"))
    per = per.unionByName(series(moved.where("leg_no = 3"), "subscriber jitter", F.col("sub_cid"), "jitter_us"))
    return _since_start(per, obj).select("series", "sub_cid", "sec", "t_s", "n", "mean_ms")


def interarrival(obj: DataFrame, trace: DataFrame) -> DataFrame:
    """Time from each received object of a track to the next at the same end; objects of one time follow their key."""
    rows = _before(obj.where("direction = 'parsed'"), "wall_us", ["trace_id", "track_namespace", "track_name"], ["time_us", "group_id", "subgroup_id", "object_id"])
    return rows.withColumn("us", F.col("wall_us") - F.col("before")).join(trace.select("trace_id", "cid", "vantage_point"), "trace_id").select("cid", "trace_id", "vantage_point", *OBJECT_KEY, "wall_us", "payload_length", "us")


def object_bitrate(obj: DataFrame, trace: DataFrame) -> DataFrame:
    """Objects, bytes and bits per second, end and track. Seconds without objects have no row."""
    per = obj.groupBy("trace_id", "direction", "track_namespace", "track_name", second(F.col("wall_us")).alias("sec"))
    per = per.agg(F.count("*").alias("objects"), F.sum("payload_length").alias("bytes"))
    named = per.join(trace.select("trace_id", "cid", "vantage_point"), "trace_id")
    return named.select("cid", "trace_id", "vantage_point", "direction", "track_namespace", "track_name", "sec", "objects", "bytes", (F.col("bytes") * 8).alias("bits"))


def object_bitrate_series(rate: DataFrame, obj: DataFrame) -> DataFrame:
    """Per second and end: of each track, and of all (scope)."""
    end = [F.col(c) for c in ("cid", "vantage_point", "direction")]
    sets = rate.groupingSets([[*end, F.col("track_namespace"), F.col("track_name"), F.col("sec")], [*end, F.col("sec")]], *end, F.col("track_namespace"), F.col("track_name"), F.col("sec"))
    per = sets.agg(F.grouping("track_name").alias("g"), F.sum("objects").alias("objects"), F.sum("bytes").alias("bytes"), (F.sum("bits") / 1000).alias("kbit_s"))
    per = per.withColumn("scope", F.when(F.col("g") == 1, "all").otherwise("track"))
    return _since_start(per, obj).select("cid", "vantage_point", "direction", "scope", "track_namespace", "track_name", "sec", "t_s", "objects", "bytes", "kbit_s")


def _with_ends(series: DataFrame) -> DataFrame:
    w = Window.partitionBy("cid", "vantage_point", "direction")
    edged = series.withColumn("first_sec", F.min("sec").over(w)).withColumn("last_sec", F.max("sec").over(w))
    return edged.withColumn("inside", (F.col("sec") > F.col("first_sec")) & (F.col("sec") < F.col("last_sec")))


def object_bitrate_summary(series: DataFrame) -> DataFrame:
    """Over the whole seconds of each end, its first and last left out; a second without data counts as nothing in the mean alone."""
    rate = F.when(F.col("inside"), F.col("kbit_s"))
    q = _with_ends(series).groupBy("cid", "vantage_point", "direction", "scope", "track_namespace", "track_name").agg(
        F.sum("bytes").alias("bytes"), F.count(F.when(F.col("inside"), 1)).alias("seconds"), F.greatest(F.max("last_sec") - F.max("first_sec") - 1, F.lit(0)).alias("span_s"),
        F.coalesce(F.sum(rate), F.lit(0.0)).alias("total"), F.percentile(rate, [0.05, 0.5, 0.95]).alias("q"), F.max(rate).alias("max_kbit_s"),
    )
    return q.select(
        "cid", "vantage_point", "direction", "scope", "track_namespace", "track_name", "bytes", "seconds", "span_s", F.when(F.col("span_s") > 0, F.col("total") / F.col("span_s")).alias("mean_kbit_s"),
        F.col("q")[0].alias("p5_kbit_s"), F.col("q")[1].alias("median_kbit_s"), F.col("q")[2].alias("p95_kbit_s"), "max_kbit_s",
    )


def trust(obj: DataFrame, hop: DataFrame, trace: DataFrame) -> DataFrame:
    """Per connection with objects: what was sent, received, joined, lost within the window of joined sends, and outside of it."""
    window = hop.groupBy("cid").agg(
        F.min("t_send").alias("first_send"), F.max("t_send").alias("last_send"), F.count("*").alias("w_joined"), F.count("us").alias("timed"), F.count(F.when(F.col("us") < 0, 1)).alias("negative"),
    )
    ends = trace.groupBy("cid").agg(F.count("*").alias("traces"))
    rows = obj.join(trace.select("trace_id", "cid", "vantage_point"), "trace_id")
    per = rows.groupBy("cid").agg(
        F.max(F.when(F.col("direction") == "created", F.col("vantage_point"))).alias("sender_is"), F.count(F.when(F.col("direction") == "created", 1)).alias("sent"), F.count(F.when(F.col("direction") == "parsed", 1)).alias("received"),
    )
    known = hop.select("cid", _key_hash(), *OBJECT_KEY)
    alone = rows.select("cid", _key_hash(), *OBJECT_KEY, "direction", "wall_us").join(known, ["key_hash", "cid", *OBJECT_KEY], "left_anti").join(window.select("cid", "first_send", "last_send"), "cid")
    inside = F.col("wall_us").between(F.col("first_send"), F.col("last_send"))
    missed = alone.groupBy("cid").agg(F.count(F.when(inside & (F.col("direction") == "created"), 1)).alias("n_lost"), F.count(F.when(~inside, 1)).alias("n_outside"))
    j = per.join(window, "cid", "left").join(ends, "cid", "left").join(missed, "cid", "left")
    two, none = F.col("traces") >= 2, F.lit(0)
    joined = F.coalesce("w_joined", none)
    untimed = (joined > 0) & (F.col("timed") == 0)
    return j.select(
        "cid", "sender_is", "sent", "received", F.when(two, joined).alias("joined"), F.when(F.col("w_joined").isNotNull(), F.coalesce("n_lost", none)).alias("lost"),
        F.when(F.col("w_joined").isNotNull(), F.coalesce("n_outside", none)).alias("outside_window"), F.when(two & ~F.coalesce(untimed, F.lit(False)), F.coalesce("negative", none)).alias("negative_hops"), "first_send", "last_send",
    )


def coverage(obj: DataFrame, trace: DataFrame) -> DataFrame:
    """Per connection: which ends were loaded, and which end sent."""
    sides = obj.select("trace_id", "direction").distinct().join(trace.where("vantage_point IN ('client', 'server')").select("trace_id", "cid", "vantage_point"), "trace_id")
    sender = F.when((F.col("vantage_point") == "client") == (F.col("direction") == "created"), "client").otherwise("server")
    senders = sides.groupBy("cid").agg(F.min(sender).alias("one"), F.max(sender).alias("other"))
    who = F.when(F.col("one") != F.col("other"), "both").otherwise(F.col("one"))
    ends = trace.groupBy("cid").agg(F.count(F.when(F.col("vantage_point") == "client", 1)).alias("client_traces"), F.count(F.when(F.col("vantage_point") == "server", 1)).alias("server_traces"))
    return ends.join(senders, "cid", "left").select("cid", "client_traces", "server_traces", who.alias("sender"))


def recovery(t: Tables) -> DataFrame:
    c = t.clock_recovery.select("trace_id", F.col("matched").alias("clock_matched"), F.col("near_floor").alias("clock_near_floor"))
    return t.trace.join(c, "trace_id", "left").select("cid", "filename", "vantage_point", "stream_id_source", "stream_id_uncertain", "stream_id_unresolved", "reference_time_source", "clock_matched", "clock_near_floor")


def _samples(obj: DataFrame, leg: DataFrame, gap: DataFrame, series: DataFrame, trace: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples of the three times, by track, and of the rates, by track and of all. If any client received an object, interarrival and bitrate are the clients';
    else the relay's."""
    clients = obj.where("direction = 'parsed'").join(trace.where("vantage_point = 'client'").select("trace_id"), "trace_id", "left_semi")
    at = clients.limit(1).agg(F.when(F.count("*") > 0, "subscriber").otherwise("relay").alias("at"))
    whole = leg.groupBy("sub_cid", *OBJECT_KEY).agg(F.count("*").alias("n"), F.sum("us").alias("us")).where("n = 3")
    track = ["track_namespace", "track_name"]
    ms = (F.col("us") / 1000).alias("value")
    times = whole.select(F.lit("end to end").alias("measure"), F.lit("subscriber").alias("measured_at"), *track, ms)
    times = times.unionByName(leg.where("leg_no = 2").select(F.lit("relay dwell").alias("measure"), F.lit("relay").alias("measured_at"), *track, ms))
    gaps = gap.where("us IS NOT NULL AND track_name IS NOT NULL").crossJoin(at).where(F.col("vantage_point") == F.when(F.col("at") == "subscriber", "client").otherwise("server"))
    times = times.unionByName(gaps.select(F.lit("interarrival").alias("measure"), F.col("at").alias("measured_at"), *track, ms))
    rates = _with_ends(series.crossJoin(at).where("(at = 'subscriber' AND vantage_point = 'client' AND direction = 'parsed') OR (at = 'relay' AND vantage_point = 'server' AND direction = 'created')"))
    rates = rates.where("inside AND (scope = 'all' OR track_name IS NOT NULL)")
    return times, rates.select(F.lit("bitrate").alias("measure"), F.lit("kbit/s").alias("unit"), F.col("at").alias("measured_at"), "scope", *track, F.col("kbit_s").alias("value"))


def _scoped(times: DataFrame, *more: str) -> DataFrame:
    """times of each track and of all."""
    both = times.withColumn("scope", F.explode(F.array(F.lit("track"), F.lit("all"))))
    return both.select("measure", F.lit("ms").alias("unit"), "measured_at", "scope", *[F.when(F.col("scope") == "track", F.col(c)).alias(c) for c in ("track_namespace", "track_name")], "value", *more)


def distribution_sample(*frames: DataFrame) -> DataFrame:
    """Samples of the four measures, of each track and of all."""
    times, rates = _samples(*frames)
    return _scoped(times).unionByName(rates)


def counted_sample(*frames: DataFrame) -> DataFrame:
    """distribution_sample() with a row a value and n, how often it occurs: counted by track before it is counted for all."""
    times, rates = _samples(*frames)
    times = times.groupBy(*times.columns).agg(F.count("*").alias("n"))
    counted = _scoped(times, "n").unionByName(rates.withColumn("n", F.lit(1).cast("long")))
    return counted.groupBy(*[c for c in counted.columns if c != "n"]).agg(F.sum("n").alias("n"))


def distribution_summary(sample: DataFrame) -> DataFrame:
    """sample: counted."""
    keys = ["measure", "unit", "measured_at", "scope", "track_namespace", "track_name"]
    q = sample.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.percentile("value", [0.01, 0.05, 0.5, 0.95, 0.99], F.col("n")).alias("q"))
    return q.select(*keys, "n", "min", *[F.col("q")[i].alias(c) for i, c in enumerate(("p1", "p5", "p50", "p95", "p99"))], "max")


def distribution_bin(sample: DataFrame, summary: DataFrame) -> DataFrame:
    """Histograms of a counted sample in bins of 1, 2 or 5 times a power of ten, at most about 20 up to the 99th percentile; the last reaches to the largest sample."""
    raw = F.coalesce(F.nullif(F.col("p99") - F.col("min"), F.lit(0.0)), F.col("max") - F.col("min")) / 20
    power = F.pow(F.lit(10.0), F.floor(F.log10("raw")))
    part = F.col("raw") / power
    width = F.when(F.col("raw") > 0, power * F.when(part <= 1, 1).when(part <= 2, 2).when(part <= 5, 5).otherwise(10))
    keys = ["measure", "scope", "track_namespace", "track_name"]
    e = summary.withColumn("raw", raw).withColumn("width", width)
    e = e.withColumn("first_edge", F.coalesce(F.floor(F.col("min") / F.col("width")), F.lit(0)))
    e = e.withColumn("last_edge", F.coalesce(F.least(F.ceil(F.col("p99") / F.col("width")), F.ceil(F.col("max") / F.col("width")) - 1), F.lit(0)))
    e = e.select(*keys, "min", "max", "width", "first_edge", "last_edge")
    same = lambda a, b, cols: F.expr(" AND ".join(f"{a}.{c} <=> {b}.{c}" for c in cols))
    bin_of = F.coalesce(F.least(F.floor(F.col("s.value") / F.col("e.width")), F.col("e.last_edge")) - F.col("e.first_edge"), F.lit(0)).cast("long")
    counted = sample.alias("s").join(e.alias("e"), same("s", "e", keys)).groupBy(*[F.col(f"e.{k}").alias(k) for k in keys], bin_of.alias("bin")).agg(F.sum("s.n").alias("count"))
    bins = e.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("last_edge") - F.col("first_edge")).cast("long"))))
    met = bins.alias("b").join(counted.alias("c"), same("b", "c", [*keys, "bin"]), "left")
    lo = F.when(F.col("b.bin") == 0, F.col("min")).otherwise((F.col("first_edge") + F.col("b.bin")) * F.col("width"))
    hi = F.when(F.col("first_edge") + F.col("b.bin") == F.col("last_edge"), F.col("max")).otherwise((F.col("first_edge") + F.col("b.bin") + 1) * F.col("width"))
    return met.select(*[f"b.{k}" for k in keys], "b.bin", lo.alias("lo"), hi.alias("hi"), F.coalesce("c.count", F.lit(0)).alias("count"))


def events(t: Tables) -> DataFrame:
    """Every event of every kind in one shape."""
    at = wall(t.trace)
    names = t.track.select("trace_id", "track_alias", F.col("track_name").alias("known_name"))

    def shaped(rows: DataFrame, name: Column, **cols: Column) -> DataFrame:
        full = {"stream_id": "long", "track_name": "string", "group_id": "long", "subgroup_id": "long", "object_id": "long", "payload_length": "long", "message_type": "string", "subscribe_id": "long"}
        wall_us = (F.col("origin_us") + F.col("time_us")).alias("wall_us")
        return rows.join(at, "trace_id", "left").select("trace_id", "time_us", wall_us, name.alias("name"), *[cols.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in full.items()])

    own = lambda *c: {x: F.col(x) for x in c}
    control = shaped(
        t.control_message.join(names, ["trace_id", "track_alias"], "left"), F.concat(F.lit("control_message_"), "direction"), track_name=F.coalesce("track_name", "known_name"), **own("stream_id", "message_type", "subscribe_id")
    )
    streams = shaped(t.subgroup_stream.join(names, ["trace_id", "track_alias"], "left"), F.concat(F.lit("subgroup_header_"), "direction"), track_name=F.col("known_name"), **own("stream_id", "group_id", "subgroup_id"))
    obj = shaped(objects(t).drop("wall_us"), F.concat(F.lit("subgroup_object_"), "direction"), **own("stream_id", "track_name", "group_id", "subgroup_id", "object_id", "payload_length"))
    other = shaped(t.event_other, F.col("name"), stream_id=F.get_json_object("data", "$.stream_id"))
    return control.unionByName(streams).unionByName(obj).unionByName(other)


def shape_drift(shape: DataFrame) -> DataFrame:
    """Shapes that are not in the baseline, or have keys that the loader doesn't read."""
    spark = shape.sparkSession
    base = spark.createDataFrame(list(SHAPE_BASELINE), "name string, fingerprint string").withColumn("known", F.lit(True))
    s = shape.join(base, ["name", "fingerprint"], "left")
    new, unread = F.col("known").isNull(), F.size("unconsumed") > 0
    keys = F.array_join("unconsumed", ", ")
    warning = F.when(new & unread, F.concat(F.lit("shape not in baseline, and these keys are not read: "), keys)).when(new, "shape not in baseline").otherwise(F.concat(F.lit("keys present but not read: "), keys))
    return s.where(new | unread).select("trace_id", "name", warning.alias("warning"), F.col("n").alias("lines"), "first_time_us", "fingerprint")
