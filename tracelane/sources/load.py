"""From records to the tables of a capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.functions.fingerprint import json_structure, skeleton
from tracelane.operators.streamids import is_stock, recover_stream_ids
from tracelane.plans import schema as S
from tracelane.sources.errors import CaptureError
from tracelane.sources.mlog import TraceSource, check_records, events_of, first_per, keyed, read_records
from tracelane.sources.store import Store


def _unsigned(text: Column, most: int, kind: str = "long") -> Column:
    """The number; an error if it is none that the column can hold."""
    n = text.cast("decimal(38,0)")
    return F.when(n.between(0, most), n.cast(kind)).when(n.isNotNull(), F.raise_error(F.concat(F.lit(f"out of range 0 to {most}: "), text)).cast(kind))


def _direction(name: Column) -> Column:
    return F.when(name.endswith("_created"), "created").otherwise("parsed")


def trace_rows(records: DataFrame) -> DataFrame:
    head = records.where("qlog_version IS NOT NULL")
    t = lambda path: F.get_json_object("trace", path)
    ms = t("$.common_fields.reference_time").cast("double")
    return head.select(
        "trace_id", "cid", "filename", F.current_timestamp().alias("loaded_at"), "title", "description", t("$.vantage_point.type").alias("vantage_point"),
        F.coalesce(F.rint(ms * 1000).cast("long"), F.lit(S.NO_REFERENCE_US)).alias("reference_us"), F.when(ms.isNull(), "none").otherwise("logged").alias("reference_time_source"),
        F.coalesce(t("$.moq_stream_id_source"), F.lit("logged")).alias("stream_id_source"), t("$.moq_stream_id_uncertain").cast("int").alias("stream_id_uncertain"), t("$.moq_stream_id_unresolved").cast("int").alias("stream_id_unresolved"),
        F.coalesce(t("$.common_fields.time_format"), F.when(ms.isNull(), "relative")).alias("time_format"), t("$.moq_rs_flush_policy").alias("flush_policy"), "qlog_version", "qlog_format",
        F.from_json(t("$.event_schemas"), "array<string>").alias("event_schemas"),
    )


def control_rows(events: DataFrame) -> DataFrame:
    n = lambda c: _unsigned(F.col(f"d.{c}"), S.UINT32).alias(c)
    pairs = F.transform(F.from_json("d.parameters", "array<array<string>>"), lambda p: F.struct(F.get(p, F.lit(0)).alias("key"), F.get(p, F.lit(1)).alias("value")))
    return events.where(F.col("name").isin(*S.CONTROL_EVENTS)).select(
        "trace_id", "time_us", _direction(F.col("name")).alias("direction"), "d.message_type", n("stream_id"), n("subscribe_id"), n("request_id"), "d.request_kind", n("track_alias"), "d.track_namespace", "d.track_name",
        F.map_from_entries(F.coalesce(pairs, F.array().cast("array<struct<key:string,value:string>>"))).alias("parameters"), "d.track_extensions",
    )


def stream_rows(events: DataFrame) -> DataFrame:
    n = lambda c: _unsigned(F.col(f"d.{c}"), S.UINT32).alias(c)
    rows = events.where(F.col("name").isin(*S.HEADER_EVENTS))
    return rows.select("trace_id", n("stream_id"), _direction(F.col("name")).alias("direction"), "time_us", "d.header_type", n("track_alias"), n("group_id"), n("subgroup_id"), _unsigned(F.col("d.publisher_priority"), S.UINT8, "int").alias("publisher_priority"))


def object_rows(events: DataFrame) -> DataFrame:
    n = lambda c: _unsigned(F.col(f"d.{c}"), S.UINT32)
    count = F.coalesce(F.json_array_length("d.extension_headers"), F.when(F.col("d.extension_headers").isNotNull(), 0)).cast("int")
    rows = events.where(F.col("name").isin(*S.OBJECT_EVENTS))
    return rows.select("trace_id", n("stream_id").alias("stream_id"), n("object_id").alias("object_id"), "time_us", n("object_payload_length").alias("payload_length"), count.alias("extension_count"))


def other_rows(events: DataFrame) -> DataFrame:
    return events.where(~F.col("name").isin(*S.CONTROL_EVENTS, *S.HEADER_EVENTS, *S.OBJECT_EVENTS)).select("trace_id", "time_us", "name", "data")


def tracks(control: DataFrame) -> DataFrame:
    """Each alias by its first subscribe_ok, named by the first subscribe of that id. Always derived from all messages of a trace."""
    ok = first_per(control.where("message_type = 'subscribe_ok' AND track_alias IS NOT NULL"), ["trace_id", "track_alias"], ["time_us", "subscribe_id"]).select("trace_id", "track_alias", "subscribe_id")
    sub = first_per(control.where("message_type = 'subscribe'"), ["trace_id", "subscribe_id"], ["time_us", "track_namespace", "track_name"]).select("trace_id", "subscribe_id", "track_namespace", "track_name")
    return ok.join(sub, ["trace_id", "subscribe_id"], "left").select("trace_id", "track_alias", "subscribe_id", "track_namespace", "track_name")


def census(events: DataFrame) -> DataFrame:
    """How often each shape of data occurs in each trace, and the keys of it that no column takes. Events are counted by their skeleton; only one text of each goes
    to Python."""
    lit = lambda keys: F.array(*[F.lit(k) for k in keys])
    few = events.groupBy("trace_id", "name", skeleton("data").alias("skeleton")).agg(F.count("*").alias("n"), F.min("time_us").alias("first_time_us"), F.any_value("data").alias("data"))
    keys = F.json_object_keys("data")
    known = F.when(F.col("name").isin(*S.CONTROL_EVENTS), lit(S.CONTROL_KEYS)).when(F.col("name").isin(*S.HEADER_EVENTS), lit(S.HEADER_KEYS)).when(F.col("name").isin(*S.OBJECT_EVENTS), lit(S.OBJECT_KEYS)).otherwise(keys)
    unread = F.filter(keys, lambda k: ~F.array_contains(known, k))
    per = few.select("trace_id", "name", "n", "first_time_us", json_structure("data").alias("fingerprint"), unread.alias("unconsumed"))
    return per.groupBy("trace_id", "name", "fingerprint").agg(F.sum("n").alias("n"), F.min("first_time_us").alias("first_time_us"), F.first("unconsumed", True).alias("unconsumed"))


def merge_census(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.unionByName(b).groupBy("trace_id", "name", "fingerprint")
    return both.agg(F.sum("n").alias("n"), F.min("first_time_us").alias("first_time_us"), F.first("unconsumed", True).alias("unconsumed"))


def guard(streams: DataFrame, names: dict[int, str]) -> None:
    """Refuses traces whose streams (trace_id, stream_id, direction; one for each header) share one id, and ids of streams of both directions."""
    one = streams.groupBy("trace_id").agg(F.count("*").alias("n"), F.count_distinct("stream_id").alias("ids")).where("n > 1 AND ids = 1").limit(1).collect()
    if one:
        raise CaptureError("load", "unsupported capture: every subgroup header carries the same stream_id (stock relays write 0 for all). Record with a relay build that plumbs real QUIC stream ids.", trace=names[one[0].trace_id])
    two = streams.groupBy("trace_id", "stream_id").agg(F.count_distinct("direction").alias("n")).where("n > 1").limit(1).collect()
    if two:
        raise CaptureError("load", f"unsupported capture: stream_id {two[0].stream_id} carries both a sent and a received subgroup header, so the stream cannot be attributed to one end. Expected disjoint QUIC stream id spaces.", trace=names[two[0].trace_id])


def check_keys(t: S.Tables, names: dict[int, str]) -> None:
    """Raises for a stream or track that occurs twice and for a stream without an id. The keys of the other tables hold by how they are made: one trace a file, one row
    a shape, one clock a trace."""
    for table, keys in (("subgroup_stream", ["trace_id", "stream_id"]), ("track", ["trace_id", "track_alias"])):
        bad = getattr(t, table).groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1).union(getattr(t, table).where(F.col(keys[1]).isNull()).select(*keys, F.lit(0).cast("long"))).limit(1).collect()
        if bad:
            wrong = "duplicate key" if bad[0].n > 1 and bad[0][keys[1]] is not None else f"NULL {keys[1]}"
            raise CaptureError("load", f"{wrong} in {table}: {bad[0].asDict()}", trace=names[bad[0].trace_id])


def _repaired(store: Store, events: DataFrame, trace: DataFrame) -> tuple[DataFrame, DataFrame]:
    """events with recovered ids and without those that got none, and trace rows that say so, for the stock traces."""
    stock = [r.trace_id for r in is_stock(events).collect()]  # at most one row a trace
    if not stock:
        return events, trace
    found = store.keep(recover_stream_ids(events.where(F.col("trace_id").isin(stock)), store), "stream-ids")
    stats = found.where("kind = 'object'").groupBy("trace_id").agg(F.count(F.when(F.col("certainty") == "uncertain", 1)).alias("u"), F.count(F.when(F.col("recovered_id").isNull(), 1)).alias("x"))
    # The keys of the data are read again after the join, which moves the data alone.
    j = events.drop("d").join(found.select("trace_id", "place", "kind", "recovered_id"), ["trace_id", "place"], "left").where("kind IS NULL OR recovered_id IS NOT NULL")
    changed = keyed(j).withColumn("d", F.when(F.col("recovered_id").isNotNull(), F.col("d").withField("stream_id", F.col("recovered_id").cast("string"))).otherwise(F.col("d")))
    t = trace.join(stats, "trace_id", "left")
    hit = F.col("trace_id").isin(stock)
    t = t.withColumn("stream_id_source", F.when(hit, "recovered").otherwise(F.col("stream_id_source")))
    for c, s in (("stream_id_uncertain", "u"), ("stream_id_unresolved", "x")):
        t = t.withColumn(c, F.when(hit, F.coalesce(F.col(s), F.lit(0)).cast("int")).otherwise(F.col(c)))
    return store.keep(changed.select(*events.columns), "events"), t.select(*trace.columns)


def load_tables(spark: SparkSession, sources: list[TraceSource], repair: bool = True, check: bool = True, store: Store | None = None) -> S.Tables:
    """The tables of the traces, numbered from 1 in the order given. repair: traces without stream ids get recovered ones; else they are refused.
    Guards run first; nothing is handed out if one raises. Records are parsed once, into `store`, which the tables read from."""
    if not sources:
        raise CaptureError("load", "no traces")
    store = store or Store(spark)
    records = store.keep(read_records(spark, sources), "records")
    names = {i + 1: s.name for i, s in enumerate(sources)}
    try:
        if check:
            check_records(records, sources)
        events, trace = events_of(records), trace_rows(records)
        if repair:
            events, trace = _repaired(store, events, trace)
        if check:
            guard(stream_rows(events), names)
        control = control_rows(events)
        t = S.Tables(
            trace=trace, control_message=control, subgroup_stream=stream_rows(events).sortWithinPartitions("time_us"), subgroup_object=object_rows(events).sortWithinPartitions("time_us"), event_other=other_rows(events),
            track=tracks(control), shape=census(events), clock_recovery=spark.createDataFrame([], S.CLOCK_RECOVERY),
        )
        if check:
            check_keys(t, names)
        return t
    except CaptureError:
        store.remove()
        raise
