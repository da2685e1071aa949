"""Recovering the clock of relay traces that lack a reference time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelane.operators.views import objects, relay_pairs
from tracelane.plans.schema import CLOCK_RECOVERY, Tables

NEAR_US = 50


def clock_recovery(obj: DataFrame, trace: DataFrame) -> DataFrame:
    """For each outgoing trace without a clock that a single incoming trace feeds: the least difference over the objects they share, how many
    they share, and how many come within NEAR_US of that least. The object that passed fastest is taken to have taken no time."""
    gap = relay_pairs(obj, trace).where("out_clock = 'none'").select("in_trace_id", "out_trace_id", (F.col("out_wall_us") - F.col("in_wall_us")).alias("us"))
    floor = gap.withColumn("least", F.min("us").over(Window.partitionBy("in_trace_id", "out_trace_id")))
    pair = floor.groupBy("out_trace_id", "in_trace_id").agg(F.max("least").alias("offset_us"), F.count("*").alias("matched"), F.count(F.when(F.col("us") - F.col("least") <= NEAR_US, 1)).alias("near_floor"))
    fed = pair.withColumn("feeds", F.count("*").over(Window.partitionBy("out_trace_id"))).where("feeds = 1")
    return fed.select(F.col("out_trace_id").alias("trace_id"), F.col("in_trace_id").alias("in_trace"), "offset_us", "matched", "near_floor")


def recover_clocks(t: Tables) -> Tables:
    """The tables with recovered reference times. A second call changes nothing: no trace it could recover is left without a clock."""
    spark = t.trace.sparkSession
    rows = clock_recovery(objects(t), t.trace).collect()  # one row a trace at most
    if not rows:
        return t
    found = spark.createDataFrame(rows, CLOCK_RECOVERY)
    shift = found.select("trace_id", "offset_us")
    j = t.trace.join(shift, "trace_id", "left")
    hit = F.col("offset_us").isNotNull() & (F.col("reference_time_source") == "none")
    j = j.withColumn("reference_us", F.when(hit, F.col("reference_us") - F.col("offset_us")).otherwise(F.col("reference_us")))
    j = j.withColumn("reference_time_source", F.when(hit, "recovered").otherwise(F.col("reference_time_source")))
    return t.with_(trace=j.select(*t.trace.columns), clock_recovery=t.clock_recovery.unionByName(found))
