"""Loading logs as they grow, and rates over a stream of objects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.plans import schema as S
from tracelane.sources.errors import CaptureError
from tracelane.sources.load import census, control_rows, guard, merge_census, object_rows, other_rows, stream_rows, trace_rows, tracks
from tracelane.sources.mlog import DATA, RECORD, check_headers, check_json
from tracelane.sources.store import Store, exists

#: Tables that a chunk only adds rows to.
GROWING = {"trace": S.TRACE, "control_message": S.CONTROL, "subgroup_stream": S.STREAM, "subgroup_object": S.OBJECT, "event_other": S.OTHER, "shape": S.SHAPE}


def parse_lines(lines: DataFrame) -> DataFrame:
    """Records of lines (filename, trace_id, cid, place, value), batch or streaming."""
    raw = lines.withColumn("raw", F.explode(F.split("value", "\x1e"))).where(F.trim("raw") != "")
    return raw.withColumn("r", F.from_json("raw", RECORD, {"columnNameOfCorruptRecord": "_bad"})).select("trace_id", "filename", "cid", "place", "raw", "r.*")


class ChunkedLoad:
    """Ingests a folder of chunk files <trace name>.<number> into Parquet tables under `store`, each file once.

    A chunk holds whole records; the header comes in a trace's first chunk. Each micro-batch appends under its own number, so one that
    runs again replaces what it wrote. Tracks and the shape census span chunks: tracks are derived from all messages at reading, and
    the census of the batches is merged then. A batch is checked against itself and what is stored before it is written: one header a trace and before all else, whole records,
    stream ids that tell streams apart. Traces without such ids can only be loaded whole.
    """

    def __init__(self, spark: SparkSession, chunks: str, store: str, traces: dict[str, tuple[int, str]]):
        self.spark, self.chunks, self.store, self.traces = spark, chunks, store, traces

    def _batch(self, lines: DataFrame, number: int) -> None:
        named = self.spark.createDataFrame([(n, i, c) for n, (i, c) in self.traces.items()], "filename string, trace_id int, cid string")
        lines = lines.join(named, "filename").withColumn("place", F.struct(F.lit(0).cast("long").alias("block"), F.monotonically_increasing_id().alias("line"), F.lit(0).alias("part")))
        store = Store(self.spark)
        records = store.keep(parse_lines(lines), "records")
        ms = F.col("time").cast("double")
        ev = records.where("name IS NOT NULL").select("trace_id", "place", "name", F.rint(ms * 1000).cast("long").alias("time_us"), "data").withColumn("d", F.from_json("data", DATA))
        made = {"trace": trace_rows(records), "control_message": control_rows(ev), "subgroup_stream": stream_rows(ev), "subgroup_object": object_rows(ev), "event_other": other_rows(ev), "shape": census(ev)}
        try:
            self._check(records, made["subgroup_stream"], number)
        except CaptureError:
            store.remove()
            raise
        for name, frame in made.items():
            frame.write.mode("overwrite").parquet(f"{self.store}/{name}/batch={number}")
        store.remove()

    def _stored(self, name: str, number: int) -> DataFrame:
        """What batches other than this one have stored."""
        if not exists(self.spark, f"{self.store}/{name}"):
            return self.spark.createDataFrame([], GROWING[name])
        return self.spark.read.schema(f"{GROWING[name]}, batch int").parquet(f"{self.store}/{name}").where(F.col("batch") != number).drop("batch")

    def _check(self, records: DataFrame, streams: DataFrame, number: int) -> None:
        check_json(records)
        here = records.groupBy("trace_id").agg(F.count("qlog_version").alias("headers"))
        before = self._stored("trace", number).groupBy("trace_id").agg(F.count("*").alias("stored"))
        name = {i: n for n, (i, _) in self.traces.items()}
        for r in here.join(before, "trace_id", "left").na.fill(0).collect():  # a row a trace of the batch
            check_headers(name[r.trace_id], r.headers + r.stored)
        ends = ["trace_id", "stream_id", "direction"]
        known = self._stored("subgroup_stream", number).join(here.select("trace_id"), "trace_id", "left_semi").select(*ends).unionByName(streams.select(*ends))
        guard(known, name)
        twice = known.groupBy("trace_id", "stream_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
        if twice:
            raise CaptureError("load", f"duplicate key in subgroup_stream: {twice[0].asDict()}", trace=name[twice[0].trace_id])

    def run(self, files_per_batch: int = 1) -> None:
        """Takes in the files that are there and not yet taken in, then stops."""
        lines = self.spark.readStream.option("maxFilesPerTrigger", files_per_batch).format("text").load(self.chunks)
        lines = lines.select("value", F.regexp_replace("_metadata.file_name", r"\.\d+$", "").alias("filename"))
        query = lines.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.store}/_checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    def tables(self) -> S.Tables:
        got = {n: self.spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(f"{self.store}/{n}") for n, kind in GROWING.items()}
        shape = merge_census(got["shape"], self.spark.createDataFrame([], S.SHAPE))
        return S.Tables(**(got | {"shape": shape}), track=tracks(got["control_message"]), clock_recovery=self.spark.createDataFrame([], S.CLOCK_RECOVERY))


def rates(objects: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Objects, bytes and bits per second, end and track of a stream of objects with their ends (cid, trace_id, vantage_point, direction, track_namespace, track_name,
    wall_us, payload_length). A second is final once the watermark has passed it; in complete or update mode running totals come earlier."""
    at = objects.withColumn("at", F.timestamp_micros("wall_us")).withWatermark("at", late)
    per = at.groupBy("cid", "trace_id", "vantage_point", "direction", "track_namespace", "track_name", F.window("at", "1 second").alias("w"))
    per = per.agg(F.count("*").alias("objects"), F.sum("payload_length").alias("bytes"))
    return per.select("cid", "trace_id", "vantage_point", "direction", "track_namespace", "track_name", F.unix_seconds("w.start").alias("sec"), "objects", "bytes", (F.col("bytes") * 8).alias("bits"))


def streamed_rates(spark: SparkSession, folder: str, schema: str, out: str, each: Callable[[DataFrame], DataFrame] = rates, late: str = "10 seconds") -> DataFrame:
    """Runs rates() over the Parquet files in a folder as a stream until none is left; the last totals, as a table under `out`."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(folder)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/totals")

    query = each(stream).writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/totals")


def hops_stream(sent: DataFrame, received: DataFrame, key: list[str], late: str = "10 minutes") -> DataFrame:
    """Hops of two streams of objects (cid, key, wall_us): a stream-stream join in which each side waits for the other no longer than `late`."""
    s = sent.withColumn("at", F.timestamp_micros("wall_us")).withWatermark("at", late).alias("s")
    r = received.withColumn("at", F.timestamp_micros("wall_us")).withWatermark("at", late).alias("r")
    same = F.expr(" AND ".join(f"s.{k} = r.{k}" for k in ["cid", *key]) + f" AND r.at BETWEEN s.at - INTERVAL {late} AND s.at + INTERVAL {late}")
    return s.join(r, same).select("s.cid", *[f"s.{k}" for k in key], F.col("s.wall_us").alias("t_send"), F.col("r.wall_us").alias("t_recv"), (F.col("r.wall_us") - F.col("s.wall_us")).alias("us"))


__all__ = ["ChunkedLoad", "hops_stream", "parse_lines", "rates", "streamed_rates"]
