"""n-gram Jaccard self-join with Bayesian candidate pruning.

Documents with one shingle set are one representative. Banded MinHash values propose groups; in each, MinHash
values are compared a few at a time, and a pair goes as soon as the posterior probability that its similarity
reaches the threshold is below a tolerance. What is left links representatives to candidate components; inside a
component all pairs pass the same test, and those that survive are verified on their whole shingle sets.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelane.llm.common import partitions, stage, texts
from tracelane.llm.components import components
from tracelane.llm.shingles import minhash, set_key, shingle_sets

THRESHOLD, K = 0.8, 5
#: 25 bands of 5 rows propose a pair at similarity 0.8 but for 5 in 100,000; above, for fewer.
BANDS, ROWS, HASHES, STEP = 25, 5, 128, 16
#: Posterior probability below which a pair is dropped.
TOLERANCE = 1e-6
#: Representatives that a task holds of one group at a time.
BLOCK = 1024


@functools.lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float, hashes: int = HASHES, step: int = STEP) -> tuple[int, ...]:
    """After step, 2 * step, ... values: the fewest matches at which a pair stays. With a uniform prior on the similarity,
    P(S >= t | m of n match) is P(Bin(n + 1, t) <= m)."""
    out = []
    for n in range(step, hashes + 1, step):
        below, m = 0.0, 0
        while (below := below + math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < tolerance:
            m += 1
        out.append(m)
    return tuple(out)


def surviving_pairs(a: np.ndarray, b: np.ndarray | None, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of the value matrices (of a alone, each once, if b is None) that the posterior keeps."""
    least = least_matches(threshold, tolerance, a.shape[1])
    i_out, j_out = [], []
    other = a if b is None else b
    for at in range(0, len(a), 256):
        rows = a[at : at + 256]
        n = np.zeros((len(rows), len(other)), np.uint8)
        for c in range(STEP):
            n += rows[:, c, None] == other[None, :, c]
        keep = n >= least[0]
        if b is None:
            keep &= np.arange(len(other))[None, :] > (at + np.arange(len(rows)))[:, None]
        i, j = np.nonzero(keep)
        n = n[i, j].astype(np.int64)
        for s in range(1, len(least)):
            cols = slice(s * STEP, (s + 1) * STEP)
            n = n + (rows[i, cols] == other[j, cols]).sum(axis=1)
            keep = n >= least[s]
            i, j, n = i[keep], j[keep], n[keep]
        i_out.append(i + at)
        j_out.append(j)
    return np.concatenate(i_out), np.concatenate(j_out)


def intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets i and j: merged pair by pair, or all at once from the incidence of shingles
    that several sets hold where pairs are many."""
    if len(i) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist())], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[code] > 1
    owner, code = owner[shared], code[shared]
    _, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    total = np.zeros((len(sets), len(sets)), np.float32)  # exact: sets are far smaller than 2**24
    width = 4096
    edges = np.searchsorted(code, np.arange(0, (code[-1] if len(code) else 0) + width + 1, width))
    for k, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        part = np.zeros((len(sets), width), np.float32)
        part[owner[x:y], code[x:y] - k * width] = 1
        total += part @ part.T
    return total[i, j].astype(np.int64)


def star(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes its least node in the graph of pairs (i, j)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _groups(batches, key: list[str], limit: int | None = None):
    """Runs of equal keys in sorted batches, as tables."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in key]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        edges = [0, *change.tolist(), batch.num_rows]
        for x, y in zip(edges[:-1], edges[1:]):
            now = tuple(c[x] for c in cols)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(x, y - x))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _values(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), HASHES)


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: its id, class_id (least id of its class: rows joined by chains of links), n_links (other rows whose
    five-word shingle sets have Jaccard similarity of at least the threshold), n_copies (rows with an equal set, itself included), kept
    (one row of each class: the first of its least id), digest (of the text).

    Null texts are empty; texts without words equal each other alone; a text under five words is one shingle.
    Rows of one id are rows of their own; a null id is allowed. An empty table gives an empty one. Columns not named are not read.

    A set's whole group of copies travels as one representative with a count. Groups over BLOCK representatives skip the first
    test (they link to their least member) and are split into blocks for the second, each pair of blocks a task's work.
    """
    spark = docs.sparkSession

    def sketch(batches):
        for batch in batches:
            cols = [[] for _ in range(5)]
            for s in shingle_sets(batch.column("text"), K):
                h = minhash(s, HASHES)
                rows = h[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
                band = np.arange(BANDS, dtype=np.uint64)
                for c in range(ROWS):
                    band = (band ^ rows[:, c]) * np.uint64(0x9E3779B97F4A7C15)
                    band ^= band >> np.uint64(29)
                k1, k2 = set_key(s)
                for col, v in zip(cols, (k1, k2, len(s), band.view(np.int64) if len(s) else band[:0].view(np.int64), (h >> np.uint32(16)).astype(np.uint16).tobytes())):
                    col.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["id", "digest", "k1", "k2", "n", "bands", "sig"])

    source = texts(docs, id_col, text=text).withColumnRenamed(id_col, "id").withColumn("digest", F.xxhash64("text"))
    kind = source.schema["id"].dataType.simpleString()
    made = source.mapInArrow(sketch, f"id {kind}, digest long, k1 long, k2 long, n long, bands array<long>, sig binary")
    prints = stage(made.withColumn("row", F.monotonically_increasing_id()), "join-prints")
    # Tables that hot keys are joined from are staged on both sides, so that adaptive execution may split them.
    least = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    heads = prints.groupBy("k1", "k2").agg(F.min(F.struct("row", "id", "digest")).alias("rep"), F.count("*").alias("copies"), F.min(least).alias("least"))
    heads = stage(heads.select("k1", "k2", F.col("rep.row").alias("rep"), F.col("rep.id").alias("id"), F.col("rep.digest").alias("digest"), "copies", "least"), "join-heads")
    reps = heads.select("rep", "id", "digest", "copies")

    # Buckets of two representatives or more; of buckets with the same members, one.
    bands = prints.join(reps.select("rep"), F.col("row") == F.col("rep")).select("rep", F.explode("bands").alias("bucket"))
    bands = stage(bands, "join-bands")
    stats = bands.groupBy("bucket").agg(F.count("*").alias("size"), F.min("rep").alias("lead"), F.sum(F.xxhash64("rep").bitwiseAND(F.lit((1 << 40) - 1))).alias("sum"), F.bit_xor(F.xxhash64("rep")).alias("xor")).where("size > 1")
    chosen = stats.groupBy("size", "lead", "sum", "xor").agg(F.min("bucket").alias("bucket"))
    hits = stage(bands.join(chosen.select("bucket", "size", "lead"), "bucket"), "join-hits")
    wide = hits.where(F.col("size") > BLOCK).select(F.col("rep").alias("a"), F.col("lead").alias("b"))

    def test(batches):
        for group in _groups(batches, ["bucket"]):
            rep = group.column("rep").to_numpy()
            i, j = surviving_pairs(_values(group.column("sig")), None, threshold, tolerance)
            root = star(len(rep), i, j)
            a = np.flatnonzero(root != np.arange(len(rep)))
            yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[root[a]])], ["a", "b"])

    small = hits.where(F.col("size") <= BLOCK).join(prints.select(F.col("row").alias("rep"), "sig"), "rep").select("bucket", "rep", "sig")
    narrow = small.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(test, "a long, b long")
    found = components(wide.unionByName(narrow), "join-candidates")

    # Each component in blocks; each pair of blocks together once.
    sized = found.join(found.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "component")
    sized = sized.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    wanted = sized.join(reps.withColumnRenamed("rep", "node"), "node").join(prints.select(F.col("row").alias("node"), "sig"), "node")
    full = wanted.withColumnRenamed("id", "want").withColumnRenamed("digest", "want_digest").join(source, F.col("want").eqNullSafe(F.col("id")) & (F.col("want_digest") == F.col("digest")))
    paired = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    paired = paired.select("component", low.alias("lo"), high.alias("hi"), F.col("block"), F.col("node"), "copies", "sig", "text")

    def verify(batches):
        for group in _groups(batches, ["component", "lo", "hi"]):
            node = group.column("node").to_numpy()
            _, once = np.unique(node, return_index=True)  # equal rows of the table give one text several times
            group, node = group.take(once), node[once]
            copies, block = group.column("copies").to_numpy(), group.column("block").to_numpy()
            sig = _values(group.column("sig"))
            sets = list(shingle_sets(group.column("text").combine_chunks(), K))
            lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
            if lo == hi:
                i, j = surviving_pairs(sig, None, threshold, tolerance)
            else:
                x, y = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
                i, j = surviving_pairs(sig[x], sig[y], threshold, tolerance) if len(x) and len(y) else (x[:0], y[:0])
                i, j = x[i], y[j]
            if not len(i):
                continue
            n = np.array([len(s) for s in sets])
            both = intersections(sets, i, j)
            linked = both >= threshold * (n[i] + n[j] - both) - 1e-9
            i, j = i[linked], j[linked]
            links = np.zeros(len(node), np.int64)
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            root = star(len(node), i, j)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[root[some]]), pa.array(links[some])], ["a", "b", "links"])

    keys = ["component", "lo", "hi"]
    checked = stage(paired.repartition(partitions(spark), *keys).sortWithinPartitions(*keys).mapInArrow(verify, "a long, b long, links long"), "join-links")
    classes = components(checked, "join-classes").withColumnRenamed("node", "rep")
    links = checked.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    classed = heads.select("k1", "k2", "rep", "copies", "least").join(classes, "rep", "left").join(links, "rep", "left")
    classed = classed.select("k1", "k2", "copies", "least", F.coalesce("component", "rep").alias("class_row"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    classed = stage(classed, "join-classed")
    lead = stage(classed.groupBy("class_row").agg(F.min("least").alias("lead")), "join-leads")
    known = stage(classed.join(lead, "class_row").select("k1", "k2", "copies", "n_links", "lead"), "join-known")
    out = prints.select("row", "id", "digest", "k1", "k2").join(known, ["k1", "k2"])
    return out.select(F.col("id").alias(id_col), F.col("lead.id").alias("class_id"), "n_links", F.col("copies").alias("n_copies"), (F.col("row") == F.col("lead.row")).alias("kept"), "digest")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that jaccard_join() keeps: of each class the one of the least id, of equal rows one. Columns as in docs."""
    names = docs.columns
    work = docs.toDF(*[f"c{i}" for i in range(len(names))])
    ident, body = (f"c{names.index(c)}" for c in (id_col, text))
    found = jaccard_join(work, id_col=ident, text=body, **options).where("kept").select(F.col(ident).alias("of"), F.col("digest").alias("of_digest"))
    met = work.withColumn("digest", F.xxhash64(F.coalesce(F.col(body), F.lit("")))).join(found, F.col(ident).eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")), "left_semi")
    first = F.row_number().over(Window.partitionBy(ident, "digest").orderBy("digest"))
    return met.withColumn("nth", first).where("nth = 1").select(*work.columns).toDF(*names)
