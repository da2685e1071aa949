"""SpotSigs fingerprints: chains of content words that follow common words.

A common word (an anchor) and the next content words after it, common ones skipped, form a signature. Layout
and frames of pages rarely have such chains; running prose has one every few words. Fingerprints are sets of
signatures; by their lengths they fall into partitions such that sets in partitions that are not
adjacent cannot reach a threshold, and a comparison ends when the lengths or what is left rule it out.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelane.llm.common import partitions, texts
from tracelane.llm.shingles import mix64, word_hashes

# Common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in is was that for it as with by on are this be from or an at a he not they have "
    "der die das und in zu den von ist mit des auf für im dem nicht ein eine als auch es an "
    "le la les de des et en un une du que est pour dans par sur au pas plus avec il qui "
    "el los las y del se con una por para su al lo como más o pero sus"
).split()
CHAIN = 2
THRESHOLD = 0.8
U64 = np.uint64
_MARKS = r"[^\pL\pN]+"


def length_partition(n: int, threshold: float = THRESHOLD) -> int:
    """The partition of sets of n signatures. Each is as wide as the threshold allows: a set and one two partitions on
    differ in length by more than a factor of 1 / threshold."""
    return 0 if n < 1 else 1 + math.floor(math.log(n) / -math.log(threshold) + 1e-9)


def pruned_jaccard(a: np.ndarray, b: np.ndarray, threshold: float = 0.0) -> float:
    """Jaccard similarity of sorted sets, or 0 where it is below the threshold: lengths that cannot reach it end the comparison
    before any element is read, and the first of 4 stretches of the smaller set after which too few are left ends it early.
    Two empty sets are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) < threshold * len(large):
        return 0.0
    need = threshold / (1 + threshold) * (len(a) + len(b)) - 1e-9
    both, step = 0, -(-len(small) // 4)
    for at in range(0, len(small), step):
        part = small[at : at + step]
        place = np.minimum(np.searchsorted(large, part), len(large) - 1)
        both += int((large[place] == part).sum())
        if both + len(small) - at - len(part) < need:
            return 0.0
    return both / (len(a) + len(b) - both)


def signatures(bodies: list[str], chain: int = CHAIN) -> list[np.ndarray]:
    """The sorted 32-bit signatures of each text, in lower case and without marks. A text without a whole chain has those of its
    runs of words without anchors; one without as many words, those of its words; one without words, one of its marks."""
    import xxhash

    plain = pa.array(bodies, pa.large_string())
    words, at = word_hashes(pc.replace_substring_regex(plain, _MARKS, " "))
    common = np.sort(np.array([xxhash.xxh64_intdigest(w) for w in sorted(set(ANCHORS))], U64))
    is_anchor = common[np.minimum(np.searchsorted(common, words), len(common) - 1)] == words
    out = []
    content = np.flatnonzero(~is_anchor)
    ahead = np.concatenate([[0], np.cumsum(~is_anchor)])  # content words before each place
    spots = np.flatnonzero(is_anchor)
    spot_edges = np.searchsorted(spots, at)
    content_edges = np.searchsorted(content, at)
    chained = np.append(words[content], np.zeros(chain, U64))
    runs = np.zeros(len(content), U64)
    for j in range(chain):
        runs = mix64(runs + chained[j : j + len(content)])
    for k in range(len(bodies)):
        mine = spots[spot_edges[k] : spot_edges[k + 1]]
        first = ahead[mine]
        whole = first + chain <= content_edges[k + 1]
        sigs = mix64(runs[first[whole]] ^ words[mine[whole]])
        if not len(sigs):
            a, b = content_edges[k], content_edges[k + 1]
            if b - a >= chain:
                sigs = runs[a : b - chain + 1]
            elif at[k] < at[k + 1]:
                sigs = mix64(words[at[k] : at[k + 1]])
            else:
                sigs = np.array([xxhash.xxh64_intdigest(bodies[k], seed=1)], U64)
        out.append(np.unique((sigs >> U64(32)).astype("<u4")))
    return out


def alike(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> bool:
    """Whether two fingerprints reach the threshold: never from length partitions that aren't the same or adjacent; else by pruned_jaccard()."""
    return abs(length_partition(len(a), threshold) - length_partition(len(b), threshold)) < 2 and pruned_jaccard(a, b, threshold) >= threshold - 1e-9


def encoded(sigs: np.ndarray) -> str:
    """The fingerprint as text: its signatures in order, 4 bytes each, in base 64."""
    return base64.b64encode(sigs.tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def _cuts_above(column: str, cuts: list[int]) -> Column:
    """How many of the cuts, which fall, are above the column: by halving steps over one constant."""
    if not cuts:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<long>")
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*[F.lit(k) for k in steps]), F.lit(0), lambda at, step: F.when(F.try_element_at(table, at + step) > F.col(column), at + step).otherwise(at))


def with_next(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """bucket, copy, id, tie, text: rows so dealt and sorted that each is followed in its partition by the next one in descending order
    of id (ties by the hash of the text, null ids last, after the last the first). Buckets are ranges of ids; the first row of
    each is sent to the one before as well, as a copy that ends it. The cuts and first ids reach the driver: a few a partition.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = texts(docs, id_col, text=text).select(F.col(id_col).cast("long").alias("id"), F.xxhash64("text").alias("tie"), "text")
    cuts = rows.agg(F.percentile_approx("id", [i / (2 * n) for i in range(1, 2 * n)], 20 * n).alias("cuts")).first().cuts or []
    cuts = sorted(set(cuts), reverse=True)
    bucket = F.when(F.col("id").isNull(), len(cuts) + 1).otherwise(_cuts_above("id", cuts))
    dealt = rows.withColumn("bucket", bucket.cast("int"))
    first = dealt.groupBy("bucket").agg(F.max(F.struct(F.coalesce("id", F.lit(0)).alias("id"), "tie")).alias("m")).orderBy("bucket").collect()
    heads = [(r.bucket, r.m.id, r.m.tie, first[i - 1].bucket) for i, r in enumerate(first)]
    table = F.broadcast(spark.createDataFrame(heads, "b int, head long, head_tie long, before int"))
    known = dealt.join(table, F.col("bucket") == F.col("b"))
    leads = (F.coalesce("id", F.lit(0)) == F.col("head")) & (F.col("tie") == F.col("head_tie"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("copy"))
    sent = known.withColumn("to", F.explode(F.when(leads, F.array(own, F.struct(F.col("before").alias("bucket"), F.lit(1).alias("copy")))).otherwise(F.array(own))))
    out = sent.select("to.bucket", "to.copy", "id", "tie", "text").repartition(n, "bucket")
    return out.sortWithinPartitions("bucket", "copy", F.col("id").desc_nulls_last(), F.col("tie").desc())


def edited(body: str, following: str) -> str:
    """body with its last half replaced by as much of the start of the other text."""
    half = len(body) // 2
    return body[: len(body) - half] + following[:half]


def fingerprints(docs: DataFrame, chain: int = CHAIN, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: its id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures, length_partition, alike_edited, alike_next.

    near_*: Jaccard similarity of the row's fingerprint with that of its edited text (edited() with the next text) and with the next row's
    own; alike_*: alike() of the same two, by length partitions and pruning. Null texts are empty; an empty text's fingerprint is that of nothing and is like itself alone. Rows of one id follow each
    other by the hash of their texts; a null id comes last; ids are integers, or text that is one; in a table of one row it is its own next; an empty table gives an empty one;
    columns not named are not read.
    """

    def run(batches):
        pending: list[tuple] = []
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "copy", "id", "text"))))
            for at in range(0, len(rows), 512):
                pending += rows[at : at + 512]
                yield from judge(pending)
                pending = pending[-1:]

    def judge(rows):
        out = [[] for _ in range(11)]
        sets = signatures([r[3] for r in rows], chain)
        mine = [k for k in range(len(rows) - 1) if not rows[k][1]]
        changed = [edited(rows[k][3], rows[k + 1][3]) for k in mine]
        for k, other, after in zip(mine, changed, signatures(changed, chain)):
            own = sets[k]
            values = (rows[k][2], len(rows[k][3]), hashlib.sha256(other.encode()).hexdigest(), encoded(own), encoded(after), pruned_jaccard(own, after), pruned_jaccard(own, sets[k + 1]), len(own), length_partition(len(own)), alike(own, after), alike(own, sets[k + 1]))
            for column, value in zip(out, values):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_())
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_signatures", "length_partition", "alike_edited", "alike_next"]
        if mine:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    out = with_next(docs, id_col, text).select("bucket", "copy", "id", "text").mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long, length_partition int, alike_edited boolean, alike_next boolean")
    return out.withColumnRenamed("id", id_col)


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, chain: int = CHAIN, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: its id, class_id (least id of the rows joined by chains of fingerprints that reach the threshold), n_signatures, length_partition.

    Equal fingerprints are one. The inverted index holds, of each fingerprint, its first signatures in the order of their
    frequency, rare first: as many as two sets that reach the threshold must share one of. An entry stands under its length partition
    and under the next, so only sets of fitting lengths meet. Entries of one signature meet in blocks of at most BLOCK; blocks meet pairwise.
    Rows as in fingerprints().
    """
    from tracelane.llm.common import stage
    from tracelane.llm.components import components
    from tracelane.llm.similarity_join import BLOCK, _groups, star

    def sign(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = signatures(part.column("text").to_pylist(), chain)
                key = [hashlib.md5(s.tobytes()).hexdigest() for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(key), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "key", "sigs"])

    rows = texts(docs, id_col, text=text).select(F.col(id_col).cast("long").alias("id"), "text")
    signed = stage(rows.mapInArrow(sign, "id long, key string, sigs array<long>"), "spotsigs-signed")
    heads = stage(signed.groupBy("key").agg(F.first("sigs").alias("sigs")).withColumn("node", F.monotonically_increasing_id()), "spotsigs-heads")
    each = heads.select("node", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    often = each.groupBy("sig").agg(F.count("*").alias("often")).where("often > 1")
    ranked = each.join(often, "sig").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("often", "sig"))).alias("shared"))
    # Signatures that no other fingerprint has come first in the order of frequency; they meet none, but count.
    first = F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1 - (F.col("n") - F.size("shared"))
    chosen = ranked.where(first > 0).select("node", "n", F.explode(F.slice("shared", 1, first.cast("int"))).alias("s")).select("node", "n", "s.sig", "s.often")
    own = F.when(F.col("n") < 1, 0).otherwise(1 + F.floor(F.log("n") / -math.log(threshold) + 1e-9)).cast("int")
    entries = chosen.withColumn("own", own).withColumn("length_part", F.explode(F.array("own", F.col("own") + 1)))
    blocks = F.ceil(F.col("often") / BLOCK).cast("int")
    entries = entries.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    entries = entries.select("sig", "length_part", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "node")
    met = entries.join(heads.select("node", "sigs"), "node")

    def compare(batches):
        for group in _groups(batches, ["sig", "length_part", "lo", "hi"]):
            node, block = group.column("node").to_numpy(), group.column("block").to_numpy()
            if len(node) < 2:
                continue
            sets = [np.array(s, np.int64) for s in group.column("sigs").to_pylist()]
            lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
            pairs = [(i, j) for i in range(len(node)) for j in range(i) if (block[i] != block[j]) == (lo != hi) and pruned_jaccard(sets[i], sets[j], threshold) >= threshold - 1e-9]
            if pairs:
                i, j = (np.array(x) for x in zip(*pairs))
                root = star(len(node), i, j)
                some = np.flatnonzero(root != np.arange(len(node)))
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[root[some]])], ["a", "b"])

    keys = ["sig", "length_part", "lo", "hi"]
    linked = met.repartition(partitions(docs.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long")
    found = components(linked, "spotsigs")
    known = heads.select("key", "node", F.size("sigs").alias("n_signatures")).join(found, "node", "left").withColumn("class", F.coalesce("component", "node"))
    out = signed.select("id", "key").join(known, "key")
    least = out.groupBy("class").agg(F.min("id").alias("class_id"))
    part = F.when(F.col("n_signatures") < 1, 0).otherwise(1 + F.floor(F.log("n_signatures") / -math.log(threshold) + 1e-9)).cast("int")
    return out.join(least, "class").select(F.col("id").alias(id_col), "class_id", F.col("n_signatures").cast("long").alias("n_signatures"), part.alias("length_partition"))
