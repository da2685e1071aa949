"""Matroska: parsing media columns into packet tables, and writing payloads as PCM tracks.

The parser reads variable-length EBML elements, of known and unknown size, and gives a packet for every frame of every
block: track, timestamp, byte range in the file, lacing and cluster; and the cues.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelane.llm.common import texts

# Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS = 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469
TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS = 0xAE, 0xE1, 0xA0, 0xBB, 0xB7
TIMESTAMP_SCALE, TIMESTAMP, SIMPLE_BLOCK, BLOCK = 0x2AD7B1, 0xE7, 0xA3, 0xA1
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING, DEFAULT_DURATION = 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0x23E383
SAMPLING, CHANNELS, BIT_DEPTH = 0xB5, 0x9F, 0x6264
CUE_TIME, CUE_TRACK, CUE_CLUSTER = 0xB3, 0xF7, 0xF1
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION, MUXING_APP, WRITING_APP = 0x4282, 0x4287, 0x4285, 0x4D80, 0x5741
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

TOP = {INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS}
UNIT = 64
FRAME, FRAMES, BLOCKS, RATE = 512, 8, 32, 8000


def read_id(data, at: int) -> tuple[int, int]:
    if at >= len(data) or not data[at]:
        raise ValueError(f"no element id at byte {at}")
    n = 9 - data[at].bit_length()
    if n > 4 or at + n > len(data):
        raise ValueError(f"bad element id at byte {at}")
    return int.from_bytes(data[at : at + n]), at + n


def read_size(data, at: int) -> tuple[int | None, int, int]:
    """The value of a variable-length integer (None: all ones, an unknown size), the offset after it, its width."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no size at byte {at}")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise ValueError(f"cut size at byte {at}")
    value = int.from_bytes(data[at : at + n]) & ((1 << 7 * n) - 1)
    return None if value == (1 << 7 * n) - 1 else value, at + n, n


def size_of(n: int) -> bytes:
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width)


def element(ident: int, body: bytes | int | str) -> bytes:
    if isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8))
    elif isinstance(body, str):
        body = body.encode()
    return b"".join((ident.to_bytes((ident.bit_length() + 7) // 8), size_of(len(body)), body))


@dataclass
class Media:
    """packets: (track, timestamp in scale units, offset, size, lacing, keyframe, cluster); tracks: number to its fields;
    cues: (time, track, offset of the cluster in the segment); scale: nanoseconds."""

    packets: list[tuple] = field(default_factory=list)
    tracks: dict[int, dict] = field(default_factory=dict)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    scale: int = 1_000_000


def _children(data, at: int, end: int, ends_at: frozenset | set = frozenset()):
    """Elements in a range: id, start of body, end of body, start of element. One of unknown size ends before an element of
    ends_at or with its parent."""
    while at < end:
        begin = at
        ident, at = read_id(data, at)
        size, at, _ = read_size(data, at)
        stop = end if size is None else at + size
        if stop > end:
            raise ValueError(f"element at byte {begin} passes the end of its parent")
        if size is None and ident != SEGMENT:
            stop = at
            while stop < end:
                inner, body = read_id(data, stop)
                if inner in TOP:
                    break
                n, body, _ = read_size(data, body)
                if n is None or body + n > end:
                    raise ValueError(f"element at byte {stop} passes the end of its parent")
                stop = body + n
        yield ident, at, stop, begin
        at = stop


def _block(data, at: int, end: int, base: int, cluster: int, media: Media, simple: bool) -> None:
    track, at, _ = read_size(data, at)
    if at + 3 > end:
        raise ValueError(f"cut block at byte {at}")
    (relative,) = struct.unpack_from(">h", data, at)
    flags = data[at + 2]
    at += 3
    lacing = (flags >> 1) & 3
    sizes: list[int] = []
    if lacing == NO_LACING:
        sizes = [end - at]
    else:
        count = data[at] + 1
        at += 1
        if lacing == FIXED:
            if (end - at) % count:
                raise ValueError(f"uneven fixed lacing at byte {at}")
            sizes = [(end - at) // count] * count
        else:
            for k in range(count - 1):
                if lacing == XIPH:
                    n = 0
                    while data[at] == 255:
                        n, at = n + 255, at + 1
                    n, at = n + data[at], at + 1
                else:
                    value, at, width = read_size(data, at)
                    n = value if k == 0 else sizes[-1] + value - ((1 << (7 * width - 1)) - 1)
                sizes.append(n)
            sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"lacing passes the end of the block at byte {at}")
    # The block's time is its first frame's; the others follow by the track's duration of a frame, if it has one.
    each = media.tracks.get(track, {}).get(DEFAULT_DURATION, 0)
    for k, n in enumerate(sizes):
        media.packets.append((track, base + relative + k * each // media.scale, at, n, lacing, bool(flags & 0x80) if simple else None, cluster))
        at += n


def parse(data: bytes) -> Media:
    media = Media()
    top = list(_children(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise ValueError("no EBML head")
    number = lambda a, b: int.from_bytes(data[a:b])
    for ident, at, end, _ in top:
        if ident != SEGMENT:
            continue
        origin = at
        for kind, a, b, begin in _children(data, at, end):
            if kind == INFO:
                for k, x, y, _ in _children(data, a, b):
                    media.scale = number(x, y) if k == TIMESTAMP_SCALE else media.scale
            elif kind == TRACKS:
                for k, x, y, _ in _children(data, a, b):
                    if k == TRACK_ENTRY:
                        entry = {}
                        for f, u, v, _ in _children(data, x, y):
                            if f in (TRACK_NUMBER, TRACK_TYPE, TRACK_UID, FLAG_LACING, DEFAULT_DURATION):
                                entry[f] = number(u, v)
                            elif f == CODEC_ID:
                                entry[f] = bytes(data[u:v]).decode()
                        media.tracks[entry.get(TRACK_NUMBER, 0)] = entry
            elif kind == CLUSTER:
                base, index = 0, len(media.clusters)
                media.clusters.append(begin - origin)
                for k, x, y, _ in _children(data, a, b):
                    if k == TIMESTAMP:
                        base = number(x, y)
                    elif k == SIMPLE_BLOCK:
                        _block(data, x, y, base, index, media, True)
                    elif k == BLOCK_GROUP:
                        for f, u, v, _ in _children(data, x, y):
                            if f == BLOCK:
                                _block(data, u, v, base, index, media, False)
            elif kind == CUES:
                for k, x, y, _ in _children(data, a, b):
                    if k == CUE_POINT:
                        time, places = 0, []
                        for f, u, v, _ in _children(data, x, y):
                            if f == CUE_TIME:
                                time = number(u, v)
                            elif f == CUE_POSITIONS:
                                got = {g: number(p, q) for g, p, q, _ in _children(data, u, v)}
                                places.append((got.get(CUE_TRACK, 0), got.get(CUE_CLUSTER, 0)))
                        media.cues += [(time, *p) for p in places]
    return media


def _laced(frames: list[bytes], lacing: int) -> bytes:
    if lacing == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif lacing == EBML_LACING:
        sizes = [len(f) for f in frames[:-1]]
        head += size_of(sizes[0])
        for a, b in zip(sizes, sizes[1:]):
            width = 1
            while not -(1 << (7 * width - 1)) < b - a < (1 << (7 * width - 1)) - 1:
                width += 1
            head += (b - a + (1 << (7 * width - 1)) - 1 | 1 << 7 * width).to_bytes(width)
    return head + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """The payload as one track of 8-bit PCM at 8,000 samples a second, in laced blocks and clusters, with cues."""
    head = element(EBML, element(DOC_TYPE, "matroska") + element(DOC_TYPE_VERSION, 4) + element(DOC_TYPE_READ_VERSION, 2))
    info = element(INFO, element(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, "tracelane") + element(WRITING_APP, "tracelane"))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + element(CHANNELS, 1) + element(BIT_DEPTH, 8))
    track = element(TRACKS, element(TRACK_ENTRY, element(TRACK_NUMBER, 1) + element(TRACK_UID, 1) + element(TRACK_TYPE, 2) + element(FLAG_LACING, 1) + element(CODEC_ID, "A_PCM/INT/LIT") + audio))
    body, at, cues = [info, track], len(info) + len(track), []
    step = FRAME * FRAMES
    for c in range(0, len(payload), step * BLOCKS):
        base = c * 1000 // RATE
        blocks = [element(TIMESTAMP, base)]
        for k, b in enumerate(range(c, min(c + step * BLOCKS, len(payload)), step)):
            part = payload[b : b + step]
            frames = [part[i : i + FRAME] for i in range(0, len(part), FRAME)]
            even = len(part) % FRAME == 0
            lacing = NO_LACING if len(frames) == 1 else (EBML_LACING, XIPH, FIXED)[k % 3] if even else (EBML_LACING, XIPH)[k % 2]
            head_of = b"\x81" + struct.pack(">hB", b * 1000 // RATE - base, 0x80 | lacing << 1)
            if k % 4 == 3:
                blocks.append(element(BLOCK_GROUP, element(BLOCK, head_of[:3] + bytes([lacing << 1]) + _laced(frames, lacing))))
            else:
                blocks.append(element(SIMPLE_BLOCK, head_of + _laced(frames, lacing)))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, element(CUE_TIME, base) + element(CUE_POSITIONS, element(CUE_TRACK, 1) + element(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


def padded(text: bytes) -> bytes:
    """With zero bytes up to a positive multiple of UNIT."""
    return text + b"\0" * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def feature(media: Media, samples: np.ndarray) -> str:
    """Of the packet table and the samples: counts by lacing, duration and shape of the signal."""
    lacings = np.bincount([p[4] for p in media.packets], minlength=4)
    around = samples.astype(np.int16) - 128
    crossings = int((np.sign(around[1:]) != np.sign(around[:-1])).sum())
    shares = np.bincount(samples >> 5, minlength=8) * 1000 // max(1, len(samples))
    return f"tracks={len(media.tracks)};clusters={len(media.clusters)};cues={len(media.cues)};packets={len(media.packets)};lacing={'/'.join(map(str, lacings))};ms={len(samples) * 1000 // RATE};sum={int(samples.sum(dtype=np.int64))};crossings={crossings};permille={'/'.join(map(str, shares))}"


def packets(media: DataFrame, id_col: str, data: str) -> DataFrame:
    """The packet table of a binary column: id, packet, track, timestamp_ms, offset, size, lacing, keyframe, cluster, cue (a cue names the
    packet's cluster), error. A null value has no rows; one that is no whole Matroska file has one row with its error."""

    def read(batches):
        names = ["id", "packet", "track", "timestamp_ms", "offset", "size", "lacing", "keyframe", "cluster", "cue", "error"]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.bool_(), pa.string()]
        for batch in batches:
            kind = batch.schema.field("id").type
            for ident, body in zip(batch.column("id").to_pylist(), batch.column("data").to_pylist()):
                if body is None:
                    continue
                try:
                    m = parse(body)
                    cued = {c[2] for c in m.cues}
                    rows = [(ident, k, p[0], p[1] * m.scale / 1e6, *p[2:], m.clusters[p[6]] in cued, None) for k, p in enumerate(m.packets)]
                except (ValueError, IndexError, struct.error) as e:
                    rows = [(ident, *[None] * 9, str(e))]
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 10_000]), [kind, *kinds])], names)

    rows = media.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{data}`").alias("data"))
    out = rows.mapInArrow(read, f"id {rows.schema['id'].dataType.simpleString()}, packet long, track long, timestamp_ms double, offset long, size long, lacing int, keyframe boolean, cluster long, cue boolean, error string")
    return out.withColumnRenamed("id", id_col)


def stored(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores every text as media and reads it back: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, media.

    The payload is the text's UTF-8 and zero bytes up to a positive multiple of 64; a null text is empty. What follows n_bytes is computed from the packets
    of the parsed file. Equal texts give equal values; rows of one id stand apart; a null id is allowed; an empty table gives an empty one. No shuffle.
    """

    def write(batches):
        for batch in batches:
            cols = [[] for _ in range(8)]
            for body in batch.column("text").to_pylist():
                body = body.encode()
                media = mux(padded(body))
                seen = parse(media)
                payload = b"".join(media[p[2] : p[2] + p[3]] for p in seen.packets)
                row = (len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(seen, np.frombuffer(payload, np.uint8)), media)
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"])

    rows = texts(docs, id_col, text=text).withColumnRenamed(id_col, "id")
    out = rows.mapInArrow(write, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary")
    return out.withColumnRenamed("id", id_col)
