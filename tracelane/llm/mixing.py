"""Mixing sources to target weights with hash thresholds found on histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelane.llm.common import discard, stage

WORD = "[^\\x20\\x09-\\x0D]+"
#: Bits of the hash that one histogram resolves, and how many histograms refine the boundary bucket.
LEVEL_BITS, LEVELS = 12, 5
MAX_REPEATS = 3.0
#: Rows of a table of sources that is broadcast, some 100 bytes each.
BROADCAST = 20_000


def _ranked(per: DataFrame) -> DataFrame:
    """per with rank: the place of its source by code point, null last. Sorted in ranges; a count of each range reaches the driver."""
    spark = per.sparkSession
    at = F.monotonically_increasing_id()
    ordered = stage(per.orderBy(F.col("b_source").asc_nulls_last()).withColumn("at", at), "mixing-ordered")
    part = F.shiftright("at", 33)
    counts = {r.part: r.n for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    starts, before = [], 0
    for k in sorted(counts):
        starts.append((k, before))
        before += counts[k]
    table = F.broadcast(spark.createDataFrame(starts, "part long, start long"))
    return ordered.withColumn("part", part).join(table, "part").withColumn("rank", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "start", "at")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """b_source, b_rows, b_source_size, b_target per source.

    Sources in order of their code points, null last, take the weights in turn. They share `share` of all sizes; a
    target stops at max_repeats times its source's size, and the excess is shared again by weight until none is above. Each round finds the
    level (words per weight) of the sources that don't stop and stops those that it puts above; the level only rises, and the
    round that stops none more is the last. A round is one aggregation; three numbers of it reach the driver.
    """
    per = sizes.groupBy(F.col("source").alias("b_source")).agg(F.count("*").alias("b_rows"), F.sum("size").alias("b_source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    w = stage(_ranked(per).withColumn("weight", weight).withColumn("capacity", max_repeats * F.col("b_source_size")), "mixing-sources")
    total = share * (w.agg(F.sum("b_source_size").alias("n")).first().n or 0)
    level, stopped = 0.0, -1
    while True:
        stops = F.lit(level) * F.col("weight") > F.col("capacity")
        r = w.agg(F.count(F.when(stops, 1)).alias("n"), F.sum(F.when(stops, F.col("capacity"))).alias("full"), F.sum(F.when(~stops, F.col("weight"))).alias("free")).first()
        if r.n == stopped or not r.free:
            break
        stopped, level = r.n, (total - (r.full or 0.0)) / r.free
    target = F.when(F.lit(level) * F.col("weight") > F.col("capacity"), F.col("capacity")).otherwise(F.lit(level) * F.col("weight"))
    return w.select("b_source", "b_rows", "b_source_size", target.alias("b_target"))


def with_sources(rows: DataFrame, source: str, table: DataFrame, sources: int, total: int, limit: int = BROADCAST) -> DataFrame:
    """rows with the columns of their source in table (b_source, b_rows of a total, ...), which has a row for each of so many sources.

    A table of up to `limit` rows is broadcast. Of a larger one the sources with more than total / limit rows are, at most `limit`: no other
    is hot, so the rest is joined by key.
    """
    same = F.col(source).eqNullSafe(F.col("b_source"))
    if sources <= limit:
        return rows.join(F.broadcast(table), same)
    hot = F.col("b_rows") > total / limit
    rest = rows.join(F.broadcast(table.where(hot).select("b_source")), same, "left_anti")
    return rows.join(F.broadcast(table.where(hot)), same).unionByName(rest.join(table.where(~hot), same))


def thresholds(sizes: DataFrame, targets: DataFrame, sources: int, total: int, limit: int = BROADCAST) -> DataFrame:
    """Adds to targets: b_full (whole passes over the source), b_low (hashes below it are taken once more) and
    b_left (words then still wanted, from the rows at hash b_low).

    Each level sums sizes by source and bucket of the next hash bits, among the rows in the bucket that
    the level before left open, and keeps the bucket in which the running sum crosses the budget. Sums
    of a level are at most 2**LEVEL_BITS rows a source.
    """
    full = F.when(F.col("b_source_size") > 0, F.floor(F.col("b_target") / F.col("b_source_size"))).otherwise(0).cast("long")
    state = targets.withColumn("b_full", full)
    state = state.withColumn("b_left", F.greatest(F.round("b_target").cast("long") - F.col("b_full") * F.col("b_source_size"), F.lit(0))).withColumn("b_low", F.lit(0).cast("long"))
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        inside = sizes
        if level:
            inside = with_sources(sizes, "source", state.select("b_source", "b_rows", "b_low"), sources, total, limit).where(F.shiftright("hash", shift + LEVEL_BITS) == F.col("b_low"))
        hist = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        run = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        crossed = with_sources(hist, "source", state.select("b_source", "b_rows", "b_left"), sources, total, limit).withColumn("run", run).where(F.col("run") > F.col("b_left"))
        first = crossed.groupBy(F.col("source").alias("s")).agg(F.min("bucket").alias("bucket"), F.min(F.col("run") - F.col("words")).alias("before"))
        # No bucket crosses: the budget takes all that was open.
        after = state.join(first, F.col("b_source").eqNullSafe(F.col("s")), "left").drop("s")
        after = after.withColumn("b_left", F.when(F.col("bucket").isNull(), F.lit(0).cast("long")).otherwise(F.col("b_left") - F.col("before")))
        after = after.withColumn("b_low", F.coalesce(F.col("bucket"), (F.col("b_low") + 1) * (1 << LEVEL_BITS) if level else F.lit(1 << LEVEL_BITS))).drop("bucket", "before")
        before, state = state, stage(after, f"mixing-level{level}")
        if level:
            discard(before)
    return state


def _size(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def _hash(id_col: str) -> Column:
    """60 bits of the MD5 of the id as text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, LEVEL_BITS * LEVELS // 4), 16, 10).cast("long")


def budgets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, max_repeats: float = MAX_REPEATS, limit: int = BROADCAST) -> tuple[DataFrame, int, int]:
    """thresholds() of sizes (source, size, hash), with b_tied: the words of the rows at hash b_low; how many sources and rows there are."""
    targets = stage(source_targets(sizes, weights, share, max_repeats), "mixing-targets")
    count = targets.agg(F.count("*").alias("n"), F.sum("b_rows").alias("rows")).first()
    found = thresholds(sizes, targets, count.n, count.rows or 0, limit)
    at = with_sources(sizes, "source", found.select("b_source", "b_rows", "b_low"), count.n, count.rows or 0, limit).where("hash = b_low").groupBy(F.col("source").alias("s")).agg(F.sum("size").alias("b_tied"))
    tied = found.join(at, F.col("b_source").eqNullSafe(F.col("s")), "left").drop("s").withColumn("b_tied", F.coalesce("b_tied", F.lit(0)))
    return stage(tied, "mixing-budgets"), count.n, count.rows or 0


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, max_repeats: float = MAX_REPEATS, id_col: str = "doc_id", text: str = "text", source: str = "source", limit: int = BROADCAST) -> DataFrame:
    """Per row of docs: id, source, size, source_size, target, hash, taken.

    Every document is taken target // source_size times, and once more if its hash is below its
    source's threshold; the document at the threshold gives the words that the target still wants, so that a source
    meets its rounded target. Rows of one hash (repeated ids) stand together and share those words in proportion,
    rounded down. Null text: size 0; null source: a source of its own; null id: hashed as an empty one. No sort of
    documents; reruns agree, and a larger budget keeps all that a smaller one took. An empty table gives an empty one.
    """
    sizes = stage(docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), _size(text).alias("size"), _hash(id_col).alias("hash")), "mixing-sizes")
    out = with_sources(sizes, "source", *budgets(sizes, weights, share, max_repeats, limit), limit)
    part = F.when(F.col("b_tied") > 0, F.floor(F.col("size") * F.col("b_left") / F.col("b_tied"))).otherwise(0)
    extra = F.when(F.col("hash") < F.col("b_low"), F.col("size")).when(F.col("hash") == F.col("b_low"), part).otherwise(0)
    taken = (F.col("b_full") * F.col("size") + extra).cast("long").alias("taken")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source), "size", F.col("b_source_size").alias("source_size"), F.col("b_target").alias("target"), "hash", taken)


def mixed(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, max_repeats: float = MAX_REPEATS, id_col: str = "doc_id", text: str = "text", source: str = "source", limit: int = BROADCAST) -> DataFrame:
    """The rows of docs in the mix, whole, each as often as it is taken: as mix() but for the document at a
    threshold, which is taken if that comes nearer to the target. Columns as in docs."""
    names = docs.columns
    work = docs.toDF(*[f"c{i}" for i in range(len(names))])
    ident, body, origin = (f"c{names.index(c)}" for c in (id_col, text, source))
    sizes = stage(work.select(F.col(origin).alias("source"), _size(body).alias("size"), _hash(ident).alias("hash")), "mixing-sizes")
    out = with_sources(work.withColumn("hash", _hash(ident)), origin, *budgets(sizes, weights, share, max_repeats, limit), limit)
    once = (F.col("hash") < F.col("b_low")) | ((F.col("hash") == F.col("b_low")) & (2 * F.col("b_left") >= F.col("b_tied")))
    times = F.col("b_full") + once.cast("long")
    out = out.withColumn("times", times).where("times > 0").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return out.select(*work.columns).toDF(*names)
