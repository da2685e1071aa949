"""Removing repeated byte strings: sampled suffixes, sorted by a distributed merge that knows common prefixes.

Every window of `length` bytes belongs to an anchor: the first place of its least k-byte hash. Equal windows have their anchors at the
same place, so the windows of one anchor, a run of adjacent ones, need comparing only with those of anchors of the same k bytes. The bytes that
an anchor's windows hold are its context: some 580, for 0.5% of all places. Two contexts with L equal bytes left and R right of
their anchors share windows if L + R >= length, and then all bytes from L left to R right occur twice in both. As
every window holds its anchor, the union over all others runs from the largest such L to the largest such R.

Equal contexts are one, with a count, before any text moves. Tasks sort the contexts of their documents as suffixes from the anchor on and
exchange the sorted runs front-coded: each suffix as the length it shares with the one before, and the rest. Runs are merged by a loser
tree whose nodes keep the common prefix of a loser with its winner: a comparison starts there, or is decided by it alone.

A string that many different contexts have at their anchors (a phrase of every third document) would be one task's work. Beyond GROUP
contexts each window of them stands for itself, keyed by its hash, after those are gone whose bytes common to STEP adjacent windows are
found in no other context.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelane.llm.common import partitions, stage, texts
from tracelane.llm.shingles import mix64

LENGTH, GRAM = 400, 32
#: Different contexts of one anchor string that a task compares; more are taken apart window by window, those of STEP adjacent ones together.
GROUP, STEP = 4096, 16
U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
HEAD = struct.Struct("<HHHHBqq")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for base in (BASE, inverse):
        x = np.full(n, base, U64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over x[i : i + w] for every i, by running values in blocks of w from both sides; x is padded with op's identity."""
    fill = np.iinfo(x.dtype).max if op is np.minimum else 0
    n = len(x)
    m = -(-(n + w) // w)
    padded = np.full(m * w, fill, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(m, w)
    ahead = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors in the bytes of texts laid in a row (starts: one more than texts): their places, where the first and the last of their windows start, and
    their gram hashes."""
    n, w = len(data), length - gram + 1
    if n < length:
        return *[np.zeros(0, np.int64)] * 3, np.zeros(0, U64)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(data * down[:n], out=sums[1:])
    h = mix64((sums[gram:] - sums[:-gram]) * up[: n - gram + 1]) | U64(1)
    least = _sliding(h, w, np.minimum)[: n - length + 1]
    ends = np.repeat(starts[1:], np.diff(starts))[: len(least)]
    inside = np.arange(len(least)) + length <= ends
    least[~inside] = 0
    # A run of windows ends where the least hash changes, and where its first place is left behind.
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (h[: len(least) - 1] == least[:-1])
    first = np.flatnonzero(inside & new)
    edges = np.append(np.flatnonzero(new), len(least))
    last = edges[np.searchsorted(edges, first, side="right")] - 1
    # Of the places that are least in some window, the first one of the wanted hash.
    padded = np.zeros(len(h), U64)
    padded[: len(least)] = least
    some = np.flatnonzero(_sliding(padded[::-1], w, np.maximum)[::-1] == h)
    k = np.searchsorted(some, first)
    wrong = np.arange(len(k))
    while len(wrong := wrong[h[some[k[wrong]]] != least[first[wrong]]]):
        k[wrong] += 1
    at = some[k]
    return at, first, last, h[at]


def shared(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix of a and b, which agree before `at`."""
    n = min(len(a), len(b))
    while at < n and a[at : at + 32] == b[at : at + 32]:
        at += 32
    if at >= n:
        return n
    x = int.from_bytes(a[at : at + 32].ljust(32, b"\0")) ^ int.from_bytes(b[at : at + 32].ljust(32, b"\0"))
    return min(n, at + (256 - x.bit_length()) // 8) if x else n


def front_code(records: list[tuple]) -> bytes:
    """records: (right, left, several, gram, context), sorted. A run of them, each but for what it shares with the one before."""
    out, r0, l0 = [], b"", b""
    for right, left, several, gram, context in records:
        r, s = shared(r0, right), shared(l0, left)
        out.append(HEAD.pack(r, len(right) - r, s, len(left) - s, several, gram, context) + right[r:] + left[s:])
        r0, l0 = right, left
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def decode(run: bytes):
    """Yields (right, length it shares with the one before, left, several, gram, context)."""
    data, at, right, left = zstandard.ZstdDecompressor().decompress(run), 0, b"", b""
    while at < len(data):
        r, more_r, s, more_l, several, gram, context = HEAD.unpack_from(data, at)
        at += HEAD.size
        right = right[:r] + data[at : at + more_r]
        at += more_r
        left = left[:s] + data[at : at + more_l]
        at += more_l
        yield right, r, left, several, gram, context


class LoserTree:
    """Merges sorted runs. Yields records with the prefix each shares with the one before it in the merge."""

    def __init__(self, runs: list):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.heads += [None] * (self.size - len(runs))
        self.lcp = [0 if h else -1 for h in self.heads]  # of each head with the record last yielded
        self.loser = [0] * self.size

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's prefix becomes the one it shares with the winner."""
        x, y = self.lcp[a], self.lcp[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t = self.heads[a][0], self.heads[b][0]
        n = shared(s, t, x)
        if n == len(s) or (n < len(t) and s[n] < t[n]):
            self.lcp[b] = n
            return a, b
        self.lcp[a] = n
        return b, a

    def __iter__(self):
        won = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            won[node], self.loser[node] = self._play(won[2 * node], won[2 * node + 1])
        top = won[1]
        while self.lcp[top] >= 0:
            yield self.heads[top], self.lcp[top]
            head = self.heads[top] = next(self.runs[top], None)
            self.lcp[top] = head[1] if head else -1
            node = (top + self.size) // 2
            while node:
                top, self.loser[node] = self._play(top, self.loser[node])
                node //= 2


class _Least:
    """Least of a range of adjacent common prefixes, by doubling tables."""

    def __init__(self, x: np.ndarray):
        self.tables = [x]
        while 2 << (len(self.tables) - 1) <= len(x):
            last, half = self.tables[-1], 1 << (len(self.tables) - 1)
            self.tables.append(np.minimum(last[:-half], last[half:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Between ranks a != b: the least of x[min(a, b) : max(a, b)]."""
        lo, n = np.minimum(a, b), np.abs(a - b)
        level = np.frompyfunc(int.bit_length, 1, 1)(n.astype(object)).astype(np.int64) - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            on = level == k
            t = self.tables[k]
            out[on] = np.minimum(t[lo[on]], t[lo[on] + n[on] - (1 << int(k))])
        return out


def _best(first: np.ndarray, second: _Least, rank: np.ndarray, most: np.ndarray, length: int) -> np.ndarray:
    """For members in the order in which `first` holds their adjacent common prefixes: the largest such prefix x with
    another member whose prefix y in the other order (ranks there: rank) gives x + y >= length; else 0. most: the
    largest y of each."""
    g = len(rank)
    best = np.zeros(g, np.int64)
    for way in (1, -1):
        at = np.arange(g)
        x = np.full(g, np.iinfo(np.int64).max)
        step = 0
        while len(at):
            inside = (at + way * (step + 1) < g) & (at + way * (step + 1) >= 0)
            at, x = at[inside], x[inside]
            x = np.minimum(x, first[at + step] if way > 0 else first[at - step - 1])
            step += 1
            hope = (x + most[at] >= length) & (x > best[at])
            at, x = at[hope], x[hope]
            if not len(at):
                break
            hit = x + second.of(rank[at], rank[at + way * step]) >= length
            best[at[hit]] = x[hit]
            at, x = at[~hit], x[~hit]
    return best


def covered(rights: list[bytes], lcps: list[int], lefts: list[bytes], length: int = LENGTH) -> list[tuple[int, int]]:
    """How far left and right of each of a group's anchors bytes occur again; (0, 0) if none. rights: sorted, lcps[i]: what i shares
    with i - 1."""
    g = len(rights)
    if g == 2:
        x, y = shared(lefts[0], lefts[1]), lcps[1]
        return [(x, y) if x + y >= length else (0, 0)] * 2
    right = np.array(lcps[1:], np.int64)
    order = sorted(range(g), key=lefts.__getitem__)
    left = np.array([shared(lefts[a], lefts[b]) for a, b in zip(order[:-1], order[1:])], np.int64)
    order = np.array(order)
    rank = np.empty(g, np.int64)
    rank[order] = np.arange(g)
    most = [np.maximum(np.append(x, 0), np.append(0, x)) for x in (right, left)]
    far = _best(right, _Least(left), rank, most[1][rank], length)
    near = _best(left, _Least(right), order, most[0][order], length)[rank]
    return list(zip(near.tolist(), far.tolist()))


def reaches(rights: list[bytes], lcps: list[int], lefts: list[bytes], several: list[bool], length: int = LENGTH) -> list[tuple[int, int]]:
    """covered() of different contexts; one that occurs several times covers all of itself."""
    found = covered(rights, lcps, lefts, length) if len(rights) > 1 else [(0, 0)]
    return [(len(lefts[i]), len(rights[i])) if several[i] else found[i] for i in range(len(rights))]


def _bytes(column) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), at


def crowded_reach(source: DataFrame, kinds: DataFrame, length: int, gram: int, step: int) -> DataFrame:
    """gram, context, near, far: reaches() of the contexts of anchor strings that have too many for one task, window by window.

    A window's hash is compared with those at the same place of other contexts. First the bytes that `step` adjacent windows have in common are; where no
    other context has those, the windows are not unrolled. Contexts differ, so no key is hot but by shared text, and counts combine before
    the exchange; the joins back are by whole keys, which adaptive execution splits.
    """
    spread = length - gram + 1
    by_doc = kinds.groupBy(F.col("rep.id").alias("of"), F.col("rep.digest").alias("of_digest")).agg(F.collect_list(F.struct("gram", "context", "rep.spot")).alias("places"))

    def unroll(batches):
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            cols = [[] for _ in range(5)]
            for body, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
                body = memoryview(body.encode())
                for place in places:
                    p, before, windows = _spot(place["spot"], spread)
                    lowest = before - windows  # of the distances from windows' starts to the anchor
                    for j in range(lowest // step, before // step + 1):
                        offsets = range(max(lowest, j * step), min(before, j * step + step - 1) + 1)
                        common = body[p - j * step : p - j * step - step + 1 + length]
                        hashes = [xxh3_64_intdigest(body[p - o : p - o + length]) for o in offsets]
                        for col, v in zip(cols, (place["gram"], place["context"], offsets[0], xxh3_64_intdigest(common, seed=j), hashes)):
                            col.append(v)
            grams, contexts, firsts, commons, hashes = cols
            each = pa.ListArray.from_arrays(np.cumsum([0, *map(len, hashes)], dtype=np.int32), pa.array(np.array([h for hs in hashes for h in hs], U64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.int64()), pa.array(contexts, pa.int64()), pa.array(firsts, pa.int32()), pa.array(np.array(commons, U64).view(np.int64)), each], ["gram", "context", "first", "common", "hashes"])

    met = source.join(by_doc, source.id.eqNullSafe(F.col("of")) & (source.digest == F.col("of_digest"))).select("text", "places")
    unrolled = stage(met.mapInArrow(unroll, "gram long, context long, first int, common long, hashes array<long>"), "repeats-windows")
    likely = stage(unrolled.groupBy("gram", "common").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeats-likely")
    windows = unrolled.join(likely, ["gram", "common"]).select("gram", "context", "first", F.posexplode("hashes").alias("nth", "window"))
    windows = stage(windows.select("gram", "context", (F.col("first") + F.col("nth")).alias("before"), "window"), "repeats-each")
    again = stage(windows.groupBy("gram", "before", "window").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeats-twice")
    found = windows.join(again, ["gram", "before", "window"]).groupBy("gram", "context").agg(F.max("before").alias("near"), (F.lit(length) - F.min("before")).alias("far"))
    several = kinds.where("n > 1").select("gram", "context", *_reach_of_all("rep.spot", length, spread))
    return found.select("gram", "context", F.col("near").cast("int").alias("near"), F.col("far").cast("int").alias("far")).unionByName(several).groupBy("gram", "context").agg(F.max("near").alias("near"), F.max("far").alias("far"))


def _spot(spot: int, spread: int) -> tuple[int, int, int]:
    """An anchor's place, how far before it its first window starts, and how many more windows it has."""
    rest, windows = divmod(spot, spread)
    place, before = divmod(rest, spread)
    return place, before, windows


def _reach_of_all(spot: str, length: int, spread: int) -> tuple:
    before, windows = F.expr(f"{spot} div {spread} % {spread}"), F.expr(f"{spot} % {spread}")
    return before.cast("int").alias("near"), (length - before + windows).cast("int").alias("far")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text: str = "text", group: int = GROUP, step: int = STEP) -> DataFrame:
    """Per row of docs: its id, n_bytes, n_removed, n_spans, kept_sha256, spans (of the removed bytes, start and end) and kept (the
    remaining bytes). Removed: every byte of the UTF-8 text in a string of `length` bytes that also starts
    elsewhere, in any row, overlaps included; judged on the input.

    Null texts are empty; rows of one id stand apart (an equal row repeats its whole text); a null id is allowed; an
    empty table gives an empty one; columns not named are not read. Ids are integers. Contexts of one anchor string are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    parts = 4 * partitions(spark)
    spread = length - gram + 1

    def sample(batches):
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            data, at = _bytes(batch.column("text"))
            grams, contexts, spots = [], [], []
            i = 0
            while i < len(at) - 1:
                j = max(i + 1, int(np.searchsorted(at, at[i] + (1 << 20))) - 1)
                raw = memoryview(data[at[i] : at[j]])
                place, first, last, h = anchors(data[at[i] : at[j]], at[i : j + 1] - at[i], length, gram)
                context = np.fromiter((xxh3_64_intdigest(raw[a : b + length], seed=p - a) for p, a, b in zip(place.tolist(), first.tolist(), last.tolist())), U64, len(place))
                edges = np.searchsorted(first, at[i : j + 1] - at[i])
                for k, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                    grams.append(h[x:y].view(np.int64))
                    contexts.append(context[x:y].view(np.int64))
                    spots.append(((place[x:y] - (at[i + k] - at[i])) * spread + place[x:y] - first[x:y]) * spread + last[x:y] - first[x:y])
                i = j
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), *[pa.array(x, kind) for x in (grams, contexts, spots)]], ["id", "digest", "grams", "contexts", "spots"])

    source = texts(docs, id_col, text=text).select(F.col(id_col).cast("long").alias("id"), F.xxhash64("text").alias("digest"), "text")
    marked = stage(source.mapInArrow(sample, "id long, digest long, grams array<long>, contexts array<long>, spots array<long>").where(F.size("grams") > 0), "repeats-anchors")
    each = marked.select("id", "digest", F.explode(F.arrays_zip("grams", "contexts", "spots")).alias("a")).select("id", "digest", F.col("a.grams").alias("gram"), F.col("a.contexts").alias("context"), F.col("a.spots").alias("spot"))
    # Staged, so that adaptive execution may split the join at a hot gram.
    again = stage(each.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "repeats-again")
    met = stage(each.join(again, "gram"), "repeats-met")
    kinds = stage(met.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("id", "digest", "spot")).alias("rep")), "repeats-contexts")
    crowded = stage(kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where(F.col("kinds") > group).select("gram"), "repeats-crowded")
    crowds = crowded.limit(1).count() > 0
    lone = kinds.join(crowded, "gram", "left_anti") if crowds else kinds
    wanted = lone.groupBy(F.col("rep.id").alias("of"), F.col("rep.digest").alias("of_digest")).agg(F.collect_list(F.struct("gram", "context", "rep.spot", (F.col("n") > 1).alias("several"))).alias("places"))
    same = source.id.eqNullSafe(F.col("of")) & (source.digest == F.col("of_digest"))

    def sort(batches):
        for batch in batches:
            runs: dict[int, list] = {}
            for body, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
                body = body.encode()
                for place in places:
                    p, before, windows = _spot(place["spot"], spread)
                    low = p - before
                    runs.setdefault(place["gram"] % parts, []).append((body[p : low + windows + length], body[low:p][::-1], place["several"], place["gram"], place["context"]))
            for records in runs.values():
                records.sort(key=lambda r: r[:2])
            yield pa.RecordBatch.from_arrays([pa.array(list(runs), pa.int32()), pa.array([front_code(r) for r in runs.values()], pa.binary())], ["part", "run"])

    runs = source.join(wanted, same).select("text", "places").mapInArrow(sort, "part int, run binary")

    def merge(batches):
        held, last = [], None
        for batch in batches:
            for part, run in zip(batch.column("part").to_pylist(), batch.column("run").to_pylist()):
                if part != last and held:
                    yield from judge(held)
                    held = []
                held.append(run)
                last = part
        if held:
            yield from judge(held)

    def judge(held):
        out: list[tuple] = []
        members: list[tuple] = []
        lcps: list[int] = []

        def flush():
            if len(members) > 1 or members and members[0][3]:
                reach = reaches([r[0] for r in members], lcps, [r[2] for r in members], [r[3] for r in members], length)
                out.extend((r[4], r[5], near, far) for r, (near, far) in zip(members, reach) if far)

        for record, lcp in LoserTree([decode(r) for r in held]):
            if lcp < gram:
                flush()
                members, lcps = [], []
            members.append(record)
            lcps.append(lcp)
        flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["gram", "context", "near", "far"])

    reach = runs.repartition(partitions(spark), "part").sortWithinPartitions("part").mapInArrow(merge, "gram long, context long, near int, far int")
    if crowds:
        reach = reach.unionByName(stage(crowded_reach(source, kinds.join(crowded, "gram"), length, gram, step), "repeats-crowds"))
    place = F.expr(f"spot div {spread * spread}")
    hit = met.join(reach, ["gram", "context"]).select("id", "digest", (place - F.col("near")).cast("int").alias("lo"), (place + F.col("far")).cast("int").alias("hi"))
    found = hit.groupBy(F.col("id").alias("of"), F.col("digest").alias("of_digest")).agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))

    def drop(batches):
        for batch in batches:
            cols = [[] for _ in range(6)]
            for body, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                body, spans = body.encode(), []
                for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges or ()):
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], hi)
                    else:
                        spans.append([lo, hi])
                edges = [0, *(x for s in spans for x in s), len(body)]
                kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))
                for col, v in zip(cols, (len(body), len(body) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in spans], kept)):
                    col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    out = source.join(found, same, "left").select("id", "text", "ranges")
    out = out.mapInArrow(drop, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumnRenamed("id", id_col)

