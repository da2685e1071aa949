"""Token-id files of length-delimited records with masked checksums and an offset index.

A record: the payload's length (8 bytes), the masked crc32 of those bytes (4), the payload, its masked
crc32 (4); all little-endian. The mask rotates a checksum right by 15 bits and adds a constant, so
that a checksum stored inside checksummed data doesn't check itself. The payload: a byte that says
whether the document has an id, its id (8 bytes, signed), the bytes per token id (1), the token ids. The
index holds 24 bytes a record: offset, payload length, token ids; 8 bytes each. Files are named in the
order of their documents; a reader that shuffles needs the index alone to draw a record.
"""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.llm.common import partitions, scratch, texts
from tracelane.llm.tokens import encoder

MASK = 0xA282EAD8


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The payload at an offset and the offset after it; ValueError where a checksum is wrong."""
    head = data[at : at + 8]
    if len(head) < 8 or struct.unpack_from("<I", data, at + 8)[0] != masked(head):
        raise ValueError(f"corrupt length at byte {at}")
    end = at + 12 + struct.unpack("<Q", head)[0]
    payload = data[at + 12 : end]
    if len(data) < end + 4 or struct.unpack_from("<I", data, end)[0] != masked(payload):
        raise ValueError(f"corrupt payload at byte {at}")
    return payload, end + 4


def pack_ids(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return struct.pack("<BqB", doc_id is not None, doc_id or 0, width) + ids.astype(f"<u{width}").tobytes()


def unpack_ids(payload: bytes) -> tuple[int | None, np.ndarray]:
    has, doc_id, width = struct.unpack_from("<BqB", payload)
    return doc_id if has else None, np.frombuffer(payload, f"<u{width}", offset=10).astype("<u4")


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text: str = "text", files: int | None = None) -> DataFrame:
    """Encodes every text, appends end_id and writes the records in ascending order of id (nulls first;
    rows that share an id in the order of their texts' hashes), one file per range of ids.

    Returns part, path, index_path, n_docs, n_tokens per file: as many rows as files. A task writes under a name of its
    attempt and renames at its end, so a task run again replaces its file. A null text is empty and holds
    end_id alone; an empty table gives no rows.
    """
    spark = docs.sparkSession

    def save(batches):
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        task = TaskContext.get()
        part = task.partitionId()
        name = f"{root}/part-{part:06d}"
        own = f"{name}.{task.taskAttemptId()}"
        enc, at, n_tokens, index = encoder(tokenizer, False), 0, 0, []
        with system.open_output_stream(f"{own}.rec") as out:
            for batch in batches:
                for doc_id, ids in zip(batch.column("id").to_pylist(), enc.encode(batch.column("text"), 8_000_000)):
                    record = frame(pack_ids(doc_id, np.append(ids, np.uint32(end_id))))
                    out.write(record)
                    index.append((at, len(record) - 16, len(ids) + 1))
                    at, n_tokens = at + len(record), n_tokens + len(ids) + 1
        with system.open_output_stream(f"{own}.idx") as out:
            out.write(np.array(index, "<u8").tobytes())
        if index:
            system.move(f"{own}.rec", f"{name}.rec")
            system.move(f"{own}.idx", f"{name}.idx")
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/part-{part:06d}.rec"], "index_path": [f"{folder}/part-{part:06d}.idx"], "n_docs": [len(index)], "n_tokens": [n_tokens]})
        else:
            system.delete_file(f"{own}.rec")
            system.delete_file(f"{own}.idx")

    rows = texts(docs, id_col, text=text).select(F.col(id_col).cast("long").alias("id"), "text")
    order = ["id", F.xxhash64("text")]
    ranged = rows.repartitionByRange(files or partitions(spark), *order).sortWithinPartitions(*order)
    done = ranged.mapInArrow(save, "part long, path string, index_path string, n_docs long, n_tokens long").collect()  # a row per file
    return spark.createDataFrame(done, "part long, path string, index_path string, n_docs long, n_tokens long")


def read(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The records of what write() returned, in files and checked: doc_id, start, n_tokens, ids_crc32, path, offset.
    start counts the ids of all documents before; ids_crc32 takes the ids as unsigned 32-bit integers."""
    listed = sorted(files.collect(), key=lambda r: r.part)  # a row per file
    ahead, before = {}, 0
    for r in listed:
        ahead[r.path] = before
        before += r.n_tokens

    def load(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield from _records(path)

    def _records(path):
        system, name = fs.FileSystem.from_uri(path)
        rows, start = [], ahead[path]
        with system.open_input_stream(name, buffer_size=1 << 20) as source:
            at = 0
            while head := source.read(12):
                size = struct.unpack("<Q", head[:8])[0]
                if struct.unpack("<I", head[8:])[0] != masked(head[:8]):
                    raise ValueError(f"{path}: corrupt length at byte {at}")
                body = source.read(size + 4)
                payload, _ = unframe(head + body)
                doc_id, ids = unpack_ids(payload)
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), path, at))
                at, start = at + size + 16, start + len(ids)
                if len(rows) == 10_000:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    paths = spark.createDataFrame([(r.path,) for r in listed], "path string").repartition(max(1, len(listed))) if listed else spark.createDataFrame([], "path string")
    return paths.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long, path string, offset long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "start", "n_tokens", "ids_crc32", "path", "offset"])


@functools.lru_cache(maxsize=64)
def _index(path: str) -> np.ndarray:
    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_stream(name) as source:
        return np.frombuffer(source.read(), "<u8").reshape(-1, 3)


def draw(path: str, index_path: str, k: int) -> tuple[int | None, np.ndarray]:
    """Record k of a file by its index, without reading those before: for shuffled reads."""
    offset, size, _ = _index(index_path)[k].tolist()
    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as source:
        source.seek(offset)
        payload, _ = unframe(source.read(size + 16))
    return unpack_ids(payload)


def token_records(docs: DataFrame, tokenizer: str, end_id: int = 0, **options) -> DataFrame:
    """write() into the shared folder, then read()."""
    spark = docs.sparkSession
    return read(spark, write(docs, scratch(spark, "records"), tokenizer, end_id, **options))
