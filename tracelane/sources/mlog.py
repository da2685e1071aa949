"""Reading event logs: JSON text sequences, one file a trace, plain or gzipped."""

from __future__ import annotations

import os
import re
import struct
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelane.sources.errors import CaptureError

_NAME = re.compile(r"^([A-Za-z0-9_-]+)_(client|server)\.mlog(\.gz)?$")
RECORD = "name string, time string, data string, qlog_version string, qlog_format string, title string, description string, trace string, _bad string"
DATA = (
    "stream_id string, message_type string, subscribe_id string, request_id string, request_kind string, track_alias string, track_namespace string, track_name string, parameters string, "
    "track_extensions string, header_type string, group_id string, subgroup_id string, publisher_priority string, object_id string, object_payload_length string, extension_headers string"
)


@dataclass(frozen=True)
class TraceSource:
    """A log file: the name and connection id it is loaded under, and where it is."""

    name: str
    cid: str | None
    path: str


def pick_files(paths: list[str]) -> tuple[list[TraceSource], list[tuple[str, str]]]:
    """The logs among files, in order of their names, and the files that are none, with reasons."""
    accepted: dict[str, TraceSource] = {}
    rejected = []
    for path in sorted(paths, key=os.path.basename):
        file = os.path.basename(path)
        name = file.removesuffix(".gz")
        if not (m := _NAME.match(file)):
            rejected.append((file, "the name is not <cid>_<client|server>.mlog or .mlog.gz"))
        elif name in accepted:
            rejected.append((file, f"gives the same trace as {os.path.basename(accepted[name].path)}"))
        else:
            accepted[name] = TraceSource(name, m[1], path)
    return list(accepted.values()), rejected


def pick_directory(folder: str) -> list[TraceSource]:
    """Every *.mlog.gz of a folder by name; the connection id is what stands before the first underscore."""
    files = sorted(f for f in os.listdir(folder) if f.endswith(".mlog.gz"))
    if not files:
        raise CaptureError("load", f"no *.mlog.gz in {folder}")
    return [TraceSource(f.removesuffix(".gz"), f.split("_")[0], os.path.join(folder, f)) for f in files]


def record_chunks(pieces, target: int = 4 << 20):
    """Yields pieces of bytes joined to chunks of whole records: each ends with a line end and has `target` bytes at least, but for the last, which is what is left."""
    held: list[bytes] = []
    size = 0
    for piece in pieces:
        cut = piece.rfind(b"\n") + 1
        if cut and size + cut >= target:
            yield b"".join([*held, piece[:cut]])
            held, size = [], 0
            piece = piece[cut:]
        if piece:
            held.append(piece)
            size += len(piece)
    if held:
        yield b"".join(held)


def plain_size(gz_tail: bytes) -> int:
    """Bytes that a gzip file holds unpacked (below 4 GiB), from its last four."""
    return struct.unpack("<I", gz_tail[-4:])[0]


def read_records(spark: SparkSession, sources: list[TraceSource]) -> DataFrame:
    """filename, cid, place (block, line; records of a file in order) and the record's top keys as text. A record ends at a line end or at a
    separator; blank ones are skipped. _bad is the text of a record that is no JSON object."""
    names = [os.path.basename(s.path) for s in sources]
    if len(set(names)) < len(names) or len({s.name for s in sources}) < len(sources):
        twice = next(s.name for i, s in enumerate(sources) if s.name in [x.name for x in sources[:i]] or names[i] in names[:i])
        raise CaptureError("load", f'a trace named "{twice}" is already loaded', trace=twice)
    known = spark.createDataFrame([(f, i + 1, s.name, s.cid) for i, (f, s) in enumerate(zip(names, sources))], "file string, trace_id int, filename string, cid string")
    lines = spark.read.text([s.path for s in sources]).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    parts = lines.select("file", "block", "line", F.posexplode(F.split("value", "\x1e")).alias("part", "raw")).where(F.trim("raw") != "")
    parsed = parts.withColumn("r", F.from_json("raw", RECORD, {"columnNameOfCorruptRecord": "_bad"}))
    place = F.struct("block", "line", "part").alias("place")
    return parsed.join(known, "file").select("trace_id", "filename", "cid", place, "r.*")


def check_json(records: DataFrame) -> None:
    """Raises for a record that is no JSON."""
    bad = records.where(F.col("_bad").isNotNull() & F.try_parse_json("_bad").isNull()).select("filename", F.left("_bad", F.lit(120)).alias("text")).limit(1).collect()
    if bad:
        raise CaptureError("load", f'Malformed JSON in file "{bad[0].filename}": {bad[0].text}', trace=bad[0].filename)


def check_headers(name: str, headers: int) -> None:
    """Raises for a trace without its one header."""
    if not headers:
        raise CaptureError("load", f'no trace row for "{name}": feed the chunk holding the mlog header first', trace=name)
    if headers > 1:
        raise CaptureError("load", f'more than one header in "{name}"', trace=name)


def check_records(records: DataFrame, sources: list[TraceSource]) -> None:
    """Raises for a record that is no JSON, and for traces without records or without their one header."""
    check_json(records)
    count = {r.filename: r for r in records.groupBy("filename").agg(F.count("*").alias("n"), F.count("qlog_version").alias("headers")).collect()}  # a row a trace
    for s in sources:
        if s.name not in count:
            raise CaptureError("load", "no records in the stream", trace=s.name)
        check_headers(s.name, count[s.name].headers)


def events_of(records: DataFrame) -> DataFrame:
    """trace_id, place, name, time_us, data and its keys as text: the records that have a name."""
    ms = F.col("time").cast("double")
    named = records.where("name IS NOT NULL").select("trace_id", "place", "name", F.rint(ms * 1000).cast("long").alias("time_us"), "data")
    return keyed(named)


def keyed(events: DataFrame) -> DataFrame:
    """events with d, the keys of their data as text."""
    return events.withColumn("d", F.from_json("data", DATA))


def first_per(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
