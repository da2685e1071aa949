"""Checks of a loaded capture; no rows mean that it is clean."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelane.operators.views import events
from tracelane.plans.schema import Tables


def _repeated(rows: DataFrame, keys: list[str], check: str, detail: Column) -> DataFrame:
    found = rows.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")
    return found.select(F.lit(check).alias("check_name"), "trace_id", detail.alias("detail"), "copies")


def audit_duplicates(t: Tables, ev: DataFrame | None = None) -> DataFrame:
    """check_name, trace_id, detail, copies: identical rows, repeated object ids, times shared by several events, and a census that disagrees
    with what was loaded."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    as_text = lambda c: F.col(c).cast("string")
    ev = events(t) if ev is None else ev
    control = t.control_message.withColumn("parameters", F.to_json(F.array_sort(F.map_entries("parameters"))))
    pair = text("stream ", as_text("stream_id"), " object ", as_text("object_id"))
    shared = ev.groupBy("trace_id", "time_us").agg(F.count("*").alias("copies"), F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names")).where("copies > 1")
    loaded = ev.groupBy("trace_id").agg(F.count("*").alias("n"))
    census = t.shape.groupBy("trace_id").agg(F.sum("n").alias("c"))
    off = loaded.join(census, "trace_id").where("c != n")
    checks = [
        _repeated(control, control.columns, "control_message: identical rows", text(F.col("message_type"), " @ ", as_text("time_us"), "us")),
        _repeated(t.subgroup_object, t.subgroup_object.columns, "subgroup_object: identical rows", pair),
        _repeated(t.event_other, t.event_other.columns, "event_other: identical rows", text(F.col("name"), " @ ", as_text("time_us"), "us")),
        _repeated(t.subgroup_object, ["trace_id", "stream_id", "object_id"], "subgroup_object: repeated (stream_id, object_id)", pair),
        shared.select(F.lit("event: timestamp used more than once").alias("check_name"), "trace_id", text(F.col("names"), " @ ", as_text("time_us"), "us").alias("detail"), "copies"),
        off.select(F.lit("shape: census disagrees with loaded events").alias("check_name"), "trace_id", text("census ", as_text("c"), " vs ", as_text("n"), " events").alias("detail"), (F.col("c") - F.col("n")).alias("copies")),
    ]
    return reduce(DataFrame.unionByName, checks)
