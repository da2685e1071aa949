from __future__ import annotations

import json
import os

import pytest
from logs import base_records, header, stream

from tracelane.sources.load import load_tables
from tracelane.sources.mlog import TraceSource, record_chunks
from tracelane.streaming.ingest import ChunkedLoad, hops_stream


def at_time(path, second, text):
    """Files are taken in the order of their times."""
    path.write_text(text)
    os.utime(path, (1_700_000_000 + second,) * 2)


@pytest.mark.parametrize("size", [1, 4, 100])
def test_chunks_equal_whole(spark, tmp_path, size):
    """A log in chunks loads to the same tables as the log at once."""
    lines = ["\x1e" + json.dumps(r) for r in base_records()]
    whole = tmp_path / "c_client.mlog"
    whole.write_text("\n".join(lines) + "\n")
    chunks = tmp_path / "chunks"
    chunks.mkdir()
    for k in range(0, len(lines), size):
        at_time(chunks / f"c_client.mlog.{k:04d}", k, "\n".join(lines[k : k + size]) + "\n")
    load = ChunkedLoad(spark, str(chunks), str(tmp_path / "store"), {"c_client.mlog": (1, "c")})
    load.run(files_per_batch=4)
    load.run()  # nothing new
    a, b = load.tables(), load_tables(spark, [TraceSource("c_client.mlog", "c", str(whole))])
    for (name, x), (_, y) in zip(a.items(), b.items()):
        cols = [c for c in y.columns if c != "loaded_at"]
        flat = lambda f: sorted(json.dumps({c: r[c] for c in cols}, sort_keys=True, default=str) for r in f.select(*cols).collect())
        assert flat(x) == flat(y), name


def chunked(spark, tmp_path, *chunks):
    folder = tmp_path / "chunks"
    folder.mkdir()
    for k, records in enumerate(chunks):
        at_time(folder / f"c_client.mlog.{k:04d}", k, "".join("\x1e" + (r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records))
    load = ChunkedLoad(spark, str(folder), str(tmp_path / "store"), {"c_client.mlog": (1, "c")})
    load.run()
    return load


@pytest.mark.parametrize(
    "chunks, text",
    [
        (([header("client")], ["{broken"]), "Malformed JSON"),
        (([stream(3, 2, 5, 7)], [header("client")]), "header first"),
        (([header("client")], [header("client")]), "more than one header"),
        (([header("client"), stream(3, 0, 5, 7)], [stream(4, 0, 5, 8)]), "every subgroup header"),
        (([header("client"), stream(3, 2, 5, 7), stream(3, 6, 5, 8)], [stream(4, 2, 5, 9, "created")]), "both a sent and a received"),
        (([header("client"), stream(3, 2, 5, 7), stream(3, 6, 5, 8)], [stream(4, 2, 5, 9)]), "duplicate key in subgroup_stream"),
    ],
)
def test_chunks_are_guarded(spark, tmp_path, chunks, text):
    """A later chunk is checked against what earlier ones stored; what was stored before it stays."""
    with pytest.raises(Exception, match=text):
        chunked(spark, tmp_path, *chunks)


@pytest.mark.parametrize("target", [1, 7, 100])
def test_record_chunks(target):
    text = b"ab\ncdef\n\ng\nhi"
    for width in (1, 3, 20):
        got = list(record_chunks([text[i : i + width] for i in range(0, len(text), width)], target))
        assert b"".join(got) == text and all(c.endswith(b"\n") and len(c) >= target for c in got[:-1])


def test_hops_of_streams(spark, tmp_path):
    """Objects that come in two streams meet once, across batches, and the late one doesn't."""
    schema = "cid string, track_namespace string, track_name string, group_id long, subgroup_id long, object_id long, wall_us long"
    t0, s = 1_700_000_000_000_000, 1_000_000
    sent = [("c", "n", "t", 1, 0, i, t0 + i * s) for i in range(8)]
    got = [("c", "n", "t", 1, 0, i, t0 + i * s + 40_000) for i in range(7)] + [("c", "n", "t", 1, 0, 7, t0 + 9_000 * s)]
    for name, rows in (("sent", sent), ("got", got)):
        for part in (rows[:3], rows[3:]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    read = lambda name: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    hops = hops_stream(read("sent"), read("got"), ["track_namespace", "track_name", "group_id", "subgroup_id", "object_id"])
    query = hops.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.object_id, r.us) for r in out.collect()) == [(i, 40_000) for i in range(7)]
