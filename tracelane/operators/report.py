"""Figures that a report derives from the measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def leg_pivot(summary: DataFrame) -> DataFrame:
    """Per subscriber: the mean of each leg, and of the whole path (NULL if a leg is missing; means add up)."""
    mean = lambda k: F.max(F.when(F.col("leg_no") == k, F.col("mean_ms"))).alias(f"leg{k}_ms")
    p = summary.groupBy("sub_cid").agg(mean(1), mean(2), mean(3))
    return p.withColumn("end_to_end_ms", F.col("leg1_ms") + F.col("leg2_ms") + F.col("leg3_ms"))


def received_tracks(rate_summary: DataFrame) -> DataFrame:
    """Tracks that arrived in at least one whole second: at the clients, or, if none was loaded, at the relay."""
    rows = rate_summary.where("direction = 'parsed' AND scope = 'track' AND seconds > 0 AND track_name IS NOT NULL")
    any_client = rate_summary.where("vantage_point = 'client'").limit(1).agg((F.count("*") > 0).alias("far"))
    end = F.when(F.col("far"), "client").otherwise("server")
    return rows.crossJoin(any_client).where(F.col("vantage_point") == end).select("track_namespace", "track_name").distinct().orderBy("track_namespace", "track_name")


def throughput_ends(rates: DataFrame) -> DataFrame:
    """Rows of client ends, and of the relay's where a connection has none; traffic: sent or received, as the client sees it."""
    clients = rates.where("vantage_point = 'client'").select("cid").distinct()
    mine = rates.where("vantage_point = 'client'").unionByName(rates.where("vantage_point != 'client'").join(clients, "cid", "left_anti"))
    return mine.withColumn("traffic", F.when((F.col("direction") == "created") == (F.col("vantage_point") == "client"), "sent").otherwise("received"))


def charted_tracks(series: DataFrame) -> DataFrame:
    """Series of tracks with more than one second: a single one draws no line."""
    keys = ["cid", "vantage_point", "direction", "track_namespace", "track_name"]
    tracks = series.where("scope = 'track'")
    long = tracks.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    same = None
    for k in keys:
        one = F.col(f"s.{k}").eqNullSafe(F.col(f"l.{k}"))
        same = one if same is None else same & one
    return tracks.alias("s").join(long.alias("l"), same, "left_semi")


def summarized_tracks(summary: DataFrame) -> DataFrame:
    return summary.where("scope = 'all' OR seconds > 0")


def delivery_totals(trust: DataFrame) -> DataFrame:
    """Over the connections whose loss can be told: joined, outside the window, lost; how many can't be told. One row."""
    known = F.col("lost").isNotNull()
    of = lambda c: F.coalesce(F.sum(F.when(known, F.col(c))), F.lit(0)).alias(c)
    return trust.agg(of("joined"), of("outside_window"), of("lost"), F.count(F.when(known, 1)).alias("measured"), F.count(F.when(~known, 1)).alias("unmeasured"))


def clock_totals(trust: DataFrame) -> DataFrame:
    """Negative hops and joined objects over the connections whose hops have times. One row."""
    known = F.col("negative_hops").isNotNull()
    of = lambda c: F.coalesce(F.sum(F.when(known, F.col(c))), F.lit(0)).alias(c)
    return trust.agg(of("negative_hops"), of("joined"), F.count(F.when(known, 1)).alias("measured"))


def not_joined(trust: DataFrame) -> DataFrame:
    return trust.where("lost IS NOT NULL").select("cid", "lost", "outside_window", (F.col("lost") + F.col("outside_window")).alias("not_joined"))


WEAK_CLOCK = 2


def recovery_notice(recovery: DataFrame) -> DataFrame:
    """What was recovered, in one row; a clock on whose floor at most two objects lie is weak."""
    ids, clock = F.col("stream_id_source") == "recovered", F.col("reference_time_source") == "recovered"
    return recovery.agg(
        F.count(F.when(ids, 1)).alias("stream_id_traces"), F.coalesce(F.sum(F.when(ids, F.col("stream_id_uncertain"))), F.lit(0)).alias("uncertain"), F.coalesce(F.sum(F.when(ids, F.col("stream_id_unresolved"))), F.lit(0)).alias("unresolved"),
        F.count(F.when(clock, 1)).alias("clock_traces"), F.count(F.when(clock & (F.col("clock_near_floor") <= WEAK_CLOCK), 1)).alias("weak_clocks"),
    )


def opening_window(span_s: float) -> float:
    """Percent of a series that a chart opens with: all of two minutes; of more, a minute, but a tenth at least."""
    return 100.0 if span_s <= 120 else max(10.0, 6000.0 / span_s)
