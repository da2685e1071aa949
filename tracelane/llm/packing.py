"""Packing documents into training sequences along a space-filling curve."""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelane.llm.common import partitions, stage, texts
from tracelane.llm.tokens import encoder

#: Dimensions that document vectors are projected to, and bits of each in a curve key.
DIMS, BITS = 3, 10


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of each point (rows of unsigned integers below 2**bits) on the Hilbert curve: the
    bits are undone from the most significant down (exchange or invert the lower bits of the axes), then
    Gray-decoded and interleaved."""
    x = [c.astype(np.uint64) for c in points.T]
    one, n = np.uint64(1), len(x)
    for q in range(bits - 1, 0, -1):
        bit, low = one << np.uint64(q), (one << np.uint64(q)) - one
        for i in range(n):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low).astype(np.uint64)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for q in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint64(q)) & one, (one << np.uint64(q)) - one, 0).astype(np.uint64)
    key = np.zeros_like(x[0])
    for q in range(bits - 1, -1, -1):
        for c in x:
            key = (key << one) | (((c ^ flip) >> np.uint64(q)) & one)
    return key.astype(np.int64)


@functools.lru_cache(maxsize=2)
def _projection(dims: int, seed: int) -> np.ndarray:
    """Of each of the lower 16 bits of a token id, the vector that the id adds to its document's: the random vector of its hash, longer for later ids, which vocabularies by merges
    give to rarer tokens; else the commonest would decide the direction."""
    ids = np.arange(1 << 16, dtype=np.uint32)
    hashed = (ids * np.uint32(0x9E3779B1)) >> np.uint32(16)
    axes = np.random.default_rng(seed).standard_normal((dims, 1 << 16)).astype(np.float32)[:, hashed]
    return np.ascontiguousarray(axes * np.log2(2 + ids).astype(np.float32) ** 2)


def project(ids: np.ndarray, dims: int = DIMS, seed: int = 7) -> list[float]:
    """The direction of a document's hashed, weighted token counts in few dimensions."""
    low = (ids & 0xFFFF).astype(np.int64)
    at = [float(axis.take(low).sum(dtype=np.float64)) for axis in _projection(dims, seed)]
    length = math.sqrt(sum(x * x for x in at))
    return [x / length if length else 0.0 for x in at]


def curve_keys(units: list[list[float]], bits: int = BITS) -> np.ndarray:
    """The Hilbert key of each direction's cell."""
    cells = np.clip(((np.array(units).reshape(len(units), -1) + 1) / 2 * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1)
    return hilbert_key(cells, bits) if len(units) else np.zeros(0, np.int64)


def pack(docs: DataFrame, tokenizer: str, max_tokens: int = 2048, end_id: int = 1, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Cuts the documents, each followed by end_id and laid end to end along the Hilbert curve, into sequences of
    max_tokens; the last one alone is short. A row per piece: id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, curve_key, ids (their bytes, unsigned 32-bit little-endian).

    Null and empty texts hold end_id alone; rows of one id are packed each by itself; ties on the curve
    go by id, then by row. An empty table gives an empty one; columns not named are not read.

    Ids are computed once and staged. The order is found on narrow rows: range partitions by (key, id) and
    running sums in each, and a total per partition on the driver. The ids then meet their places in one join.
    """
    spark = docs.sparkSession

    def encode(batches):
        enc = encoder(tokenizer, True)
        for batch in batches:
            data, n, units = [], [], []
            for ids in enc.encode(batch.column("text")):
                ids = np.append(ids, np.uint32(end_id))
                units.append(project(ids))
                n.append(len(ids))
                data.append(ids.astype("<u2" if int(ids.max()) < 1 << 16 else "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(curve_keys(units)), pa.array(data, pa.binary())], ["id", "doc_tokens", "curve_key", "ids"])

    rows = texts(docs, id_col, text=text).withColumnRenamed(id_col, "id")
    kind = rows.schema["id"].dataType.simpleString()
    coded = stage(rows.mapInArrow(encode, f"id {kind}, doc_tokens long, curve_key long, ids binary").withColumn("row", F.monotonically_increasing_id()), "packing-ids")

    def running(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("doc_tokens").to_numpy()
            ends = at + np.cumsum(n)
            at = int(ends[-1]) if len(n) else at
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.full(len(n), part, np.int64)), pa.array(ends - n)], ["row", "part", "place"])

    order = ["curve_key", "id", "row"]
    ranged = coded.select("doc_tokens", *order).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    places = stage(ranged.mapInArrow(running, "row long, part long, place long").join(coded.select("row", "doc_tokens"), "row"), "packing-places")
    ahead, before = [], 0
    for r in places.groupBy("part").agg(F.sum("doc_tokens").alias("n")).orderBy("part").collect():  # a row per range partition
        ahead.append((r.part, before))
        before += r.n
    placed = places.drop("doc_tokens").join(F.broadcast(spark.createDataFrame(ahead, "part long, before long")), "part").select("row", (F.col("place") + F.col("before")).alias("place"))

    def cut(batches):
        for batch in batches:
            out = [[] for _ in range(9)]
            for doc_id, n, key, data, place in zip(*(batch.column(c).to_pylist() for c in ("id", "doc_tokens", "curve_key", "ids", "place"))):
                ids = np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4")
                at = 0
                while at < n:
                    offset = (place + at) % max_tokens
                    length = min(n - at, max_tokens - offset)
                    piece = ids[at : at + length].tobytes()
                    for column, value in zip(out, (doc_id, at, length, zlib.crc32(piece), n, (place + at) // max_tokens, offset, key, piece)):
                        column.append(value)
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, [batch.schema.field("id").type, *[pa.int64()] * 7, pa.binary()])], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve_key", "ids"])

    out = coded.join(placed, "row").mapInArrow(cut, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve_key long, ids binary")
    return out.withColumnRenamed("id", id_col)
