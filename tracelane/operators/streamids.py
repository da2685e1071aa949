"""Recovering stream ids of traces whose relay wrote none.

Objects of one subgroup come on as many streams as it has headers. On each stream object ids are consecutive, and sizes stay near
those of one track. Sizes of a trace's direction are clustered into as many groups as it has tracks; each subgroup is then cut into
chains of least total deviation by dynamic programming over the open chains, and chains and headers are paired in the order of time.
Where every chain starts at object 0 it is known at each step which ids are next, and only the order of the clusters on them is open: the way back
is then a few sums over all orders. Clusters are fitted per trace and direction over its distinct sizes and how often each occurs, subgroups are
solved in parallel, by sorted batches, and ids are numbered by windows.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from itertools import combinations, permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelane.sources.store import Store

# The rounds of clustering, the least spread of a cluster, the margin below which a choice is uncertain, the cost of a chain that doesn't start
# at object 0, how many states a step keeps, and of how many clusters all orders are held.
ROUNDS, LEAST_SPREAD, MARGIN, LATE_START, BEAM, ORDERED = 25, 0.05, 1.0, 8.0, 8192, 6
SIDE = ["trace_id", "direction"]
BUCKET = [*SIDE, "group_id", "subgroup_id"]


def fit_clusters(log_sizes: np.ndarray, k: int, times: np.ndarray | None = None) -> list[tuple[float, float]]:
    """Centre and spread of k groups of sizes on a line: seeds at the middles of k equal shares of the sorted sizes; a tie goes to the lower group; an
    empty group stays where it is. times: how often each size occurs (once each)."""
    times = np.ones(len(log_sizes), np.int64) if times is None else times
    n = int(times.sum())
    k = min(max(k, 1), max(n, 1))
    if not n:
        return [(0.0, 1.0)]
    order = np.argsort(log_sizes, kind="stable")
    log_sizes, times = log_sizes[order], times[order]
    seeds = np.minimum(((np.arange(k) + 0.5) / k * n).astype(int), n - 1)
    centre = log_sizes[np.searchsorted(np.cumsum(times), seeds, side="right")].astype(float)
    for _ in range(ROUNDS):
        own = np.abs(log_sizes[:, None] - centre).argmin(axis=1)
        count = np.bincount(own, weights=times, minlength=k)
        total = np.bincount(own, weights=log_sizes * times, minlength=k)
        centre = np.where(count > 0, total / np.maximum(count, 1), centre)
    square = np.bincount(own, weights=(log_sizes - centre[own]) ** 2 * times, minlength=k)
    spread = np.sqrt(np.where(count > 1, square / np.maximum(count - 1, 1), 1.0))
    return [(float(c), max(float(s), LEAST_SPREAD)) for c, s in zip(centre, spread)]


def name_clusters(clusters: list[tuple[float, float]]) -> list[str]:
    """Video for the group of the largest and most varied sizes, audio for the other end; a guess for reading."""
    order = sorted(range(len(clusters)), key=lambda i: -sum(clusters[i]))
    names = ["unknown"] * len(clusters)
    if len(order) > 1:
        names[order[-1]] = "audio"
    if order:
        names[order[0]] = "video"
    return names


def cut_chains(ids: list[int], log_sizes: list[float], chains: int, clusters: list[tuple[float, float]]) -> tuple[list[int], list[bool], list[int]] | None:
    """Cuts objects in order of time into exactly `chains` chains of consecutive ids. Returns each object's chain (numbered as they open) and whether the
    choice was uncertain, and each chain's cluster; None if no cut exists."""
    count = Counter(ids)
    if sum(max(0, n - count[i - 1]) for i, n in list(count.items())) > chains:
        return None  # more ids begin a chain than there are chains
    if chains <= len(clusters) <= ORDERED and count[0] == chains and min(ids) == 0:
        return cut_from_zero(ids, log_sizes, clusters)
    return cut_by_search(ids, log_sizes, chains, clusters)


@functools.lru_cache(maxsize=ORDERED)
def _orders(k: int) -> tuple[np.ndarray, dict[tuple[int, int], np.ndarray]]:
    """Every order of k labels, and for two places the number of each order's like with these changed over."""
    orders = list(permutations(range(k)))
    number = {o: n for n, o in enumerate(orders)}
    swaps = {}
    for a, b in combinations(range(k), 2):
        to = list(range(k))
        to[a], to[b] = b, a
        swaps[a, b] = swaps[b, a] = np.array([number[tuple(o[i] for i in to)] for o in orders])
    return np.array(orders).T.copy(), swaps


def cut_from_zero(ids: list[int], log_sizes: list[float], clusters: list[tuple[float, float]]) -> tuple[list[int], list[bool], list[int]] | None:
    """cut_chains() for as many chains as there are objects 0, of a cluster each. All later objects continue a chain, so the next ids of the open chains don't
    depend on the choices made. A state is an order of the clusters over them; chains with equal next ids, and those not yet open, may change over."""
    k = len(clusters)
    orders, swaps = _orders(k)
    places, ties, holders, opened = [], [], {}, 0
    for oid in ids:
        if oid == 0:
            place, others = opened, tuple(range(opened + 1, k))
            opened += 1
        elif held := holders.get(oid):
            place = held.pop()
            others = tuple(held)
        else:
            return None
        places.append(place)
        ties.append(others)
        holders.setdefault(oid + 1, []).append(place)
    fits = np.abs(np.array(log_sizes, float)[:, None] - np.array([c for c, _ in clusters])) / np.array([s for _, s in clusters])
    rest, after = np.zeros(orders.shape[1]), {}
    for n in range(len(ids) - 1, -1, -1):
        cost = fits[n].take(orders[places[n]])
        cost += rest
        rest = cost
        if ties[n]:
            after[n] = cost
            for other in ties[n]:
                rest = np.minimum(rest, cost.take(swaps[places[n], other]))
    now, chain_of, picks, doubts = 0, {}, [], []
    for n, (oid, place) in enumerate(zip(ids, places)):
        doubt = False
        if ties[n]:
            ways = sorted((after[n][to], orders[place, to], to) for to in (now, *(swaps[place, other][now] for other in ties[n])))
            doubt = bool(ways[1][0] - ways[0][0] < MARGIN)
            now = ways[0][2]
        label = int(orders[place, now])
        picks.append(chain_of.setdefault(label, len(chain_of)))
        doubts.append(doubt)
    return picks, doubts, list(chain_of)


def cut_by_search(ids: list[int], log_sizes: list[float], chains: int, clusters: list[tuple[float, float]]) -> tuple[list[int], list[bool], list[int]] | None:
    """cut_chains() for any number of chains and any start.

    A state is the sorted (next id, cluster) of the open chains. Edges found on the way forward are kept with their steps, so that the way
    back only relaxes them. A choice is uncertain if another next step would cost less than MARGIN more in all, or if the chain it
    continues has a twin.
    """
    own_label = chains <= len(clusters)
    steps: list[dict[tuple, list[tuple]]] = []
    reached: dict[tuple, float] = {(): 0.0}
    for oid, size in zip(ids, log_sizes):
        fits = [abs(size - c) / s for c, s in clusters]
        edges: dict[tuple, list[tuple]] = {}
        after: dict[tuple, float] = {}
        for state, cost in reached.items():
            out = [(fits[label], label, False, tuple(sorted([*state[:i], (oid + 1, label), *state[i + 1 :]]))) for i, (want, label) in enumerate(state) if want == oid and (want, label) not in state[:i]]
            if len(state) < chains:
                used = {label for _, label in state} if own_label else ()
                start = 0.0 if oid == 0 else LATE_START
                out += [(start + fits[label], label, True, tuple(sorted([*state, (oid + 1, label)]))) for label in range(len(clusters)) if label not in used]
            edges[state] = out
            for price, _, _, to in out:
                after[to] = min(cost + price, after.get(to, math.inf))
        if len(after) > BEAM:
            limit = sorted(after.values())[BEAM - 1]
            after = {s: c for s, c in after.items() if c <= limit}
        steps.append(edges)
        reached = after
    rest = {s: 0.0 for s in reached if len(s) == chains}
    left: list[dict[tuple, float]] = [rest]
    for edges in reversed(steps):
        rest = {s: best for s, out in edges.items() if (best := min((p + rest[to] for p, _, _, to in out if to in rest), default=math.inf)) < math.inf}
        left.append(rest)
    left.reverse()
    if not all(left):
        return None
    state, open_chains, labels, picks, doubts = (), [], [], [], []
    for oid, edges, rest in zip(ids, steps, left[1:]):
        ways = sorted(((p + rest[to], k) for k, (p, _, _, to) in enumerate(edges[state]) if to in rest))
        if not ways:
            return None
        _, label, opens, to = edges[state][ways[0][1]]
        doubt = len(ways) > 1 and ways[1][0] - ways[0][0] < MARGIN
        if opens:
            open_chains.append([oid + 1, label])
            labels.append(label)
            pick = len(labels) - 1
        else:
            twins = [c for c, x in enumerate(open_chains) if x == [oid, label]]
            pick, doubt = twins[0], doubt or len(twins) > 1
            open_chains[pick][0] = oid + 1
        picks.append(pick)
        doubts.append(doubt)
        state = to
    return picks, doubts, labels


def is_stock(events: DataFrame) -> DataFrame:
    """trace_id of the traces whose first subgroup header has no real stream id: one of a unidirectional stream, with bit 1 set."""
    heads = events.where(F.col("name").isin("moqt:subgroup_header_created", "moqt:subgroup_header_parsed"))
    first = heads.groupBy("trace_id").agg(F.min_by(F.struct("data"), "place").alias("h"))
    ident = F.try_variant_get(F.try_parse_json("h.data"), "$.stream_id", "string")
    typed = F.schema_of_variant(F.try_variant_get(F.try_parse_json("h.data"), "$.stream_id", "variant"))
    number = F.when(~F.coalesce(typed, F.lit("")).isin("STRING", "BOOLEAN"), F.expr("try_cast(x AS double)"))
    real = first.withColumn("x", ident).withColumn("v", number)
    whole = (F.col("v") == F.floor("v")) & (F.floor(F.col("v") / 2) % 2 == 1)
    return real.where(~F.coalesce(whole, F.lit(False))).select("trace_id")


def recover_stream_ids(events: DataFrame, store: Store) -> DataFrame:
    """trace_id, place, direction, kind (object, header), recovered_id, certainty (certain, uncertain, unresolved) for the subgroup events of stock traces.

    events: trace_id, place, name, time_us, d (the keys of the data as text).
    """
    number = lambda c: F.expr(f"try_cast(d.{c} AS long)")
    kind = F.when(F.col("name").contains("subgroup_object_"), "object").when(F.col("name").contains("subgroup_header_"), "header")
    direction = F.when(F.col("name").endswith("_created"), "created").otherwise("parsed")
    rows = events.where(kind.isNotNull() & F.col("name").startswith("moqt:")).select(
        "trace_id", "place", kind.alias("kind"), direction.alias("direction"), "time_us", number("group_id").alias("group_id"), number("subgroup_id").alias("subgroup_id"), number("object_id").alias("object_id"),
        number("object_payload_length").alias("size"), number("track_alias").alias("alias"),
    )
    rows = store.keep(rows, "subgroup-events")  # read three times below: the data is parsed once
    placed = F.col("time_us").isNotNull() & F.col("group_id").isNotNull() & F.col("subgroup_id").isNotNull()
    sized = (F.col("kind") == "object") & F.col("object_id").isNotNull() & F.col("size").isNotNull()
    named = (F.col("kind") == "header") & F.col("alias").isNotNull()
    usable = placed & (sized | named)
    ok = events.where("name IN ('moqt:control_message_created', 'moqt:control_message_parsed') AND d.message_type = 'subscribe_ok' AND d.track_alias IS NOT NULL")
    tracks = ok.groupBy("trace_id").agg(F.count_distinct("d.track_alias").alias("tracks"))
    log_size = F.log(F.greatest("size", F.lit(1)).cast("double"))
    sizes = rows.where(placed & sized).groupBy(*SIDE, log_size.alias("log_size")).agg(F.count("*").alias("times"))
    counted = sizes.join(tracks, "trace_id", "left").select(*SIDE, "log_size", "times", F.coalesce("tracks", F.lit(2)).alias("tracks"))

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        found = fit_clusters(group.log_size.to_numpy(), int(group.tracks.iloc[0]), group.times.to_numpy())
        return pd.DataFrame([(*key, [c for c, _ in found], [s for _, s in found])], columns=[*SIDE, "centres", "spreads"])

    fitted = counted.groupBy(*SIDE).applyInPandas(fit, "trace_id int, direction string, centres array<double>, spreads array<double>")
    clusters = {(r.trace_id, r.direction): list(zip(r.centres, r.spreads)) for r in fitted.collect()}  # at most two rows a trace
    todo = rows.where(usable).select(*BUCKET, "place", "time_us", (F.col("kind") == "header").alias("head"), F.coalesce("object_id", F.lit(0)).alias("object_id"), F.coalesce(log_size, F.lit(0.0)).alias("log_size"))
    todo = todo.repartition(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), *BUCKET).sortWithinPartitions(*BUCKET, "time_us", "place")  # not to be coalesced

    def edges(batch: pa.RecordBatch) -> np.ndarray:
        """Where a bucket begins after the first."""
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in BUCKET]
        return np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1

    def cut_bucket(ids: list, log_sizes: list, times: list, head_times: list, side: tuple) -> tuple[list, list, int]:
        """The chain and the doubt of each object and then of each header, and the number of chains."""
        picks, doubts, start = [None] * len(ids), [False] * len(ids), {}
        if ids:
            chains = max(len(head_times), max(Counter(ids).values()))
            if found := cut_chains(ids, log_sizes, chains, clusters[side]):
                picks, doubts = found[:2]
                for pick, time in zip(picks, times):
                    start.setdefault(pick, time)
        # Headers and chains of a bucket, each in order of time, are paired by rank.
        order = sorted(start, key=lambda c: (start[c], -c))
        fits = bool(order) and len(order) == len(head_times)
        swaps = [fits and (i + 1 < len(head_times) and head_times[i + 1] <= start[order[i]] or i > 0 and head_times[i] <= start[order[i - 1]]) for i in range(len(head_times))]
        return [*picks, *(order if fits else [None] * len(head_times))], [*doubts, *swaps], len(start)

    def solve(batches):
        held: list[pa.RecordBatch] = []

        def whole() -> pa.RecordBatch:
            rows = pa.concat_batches(held)
            head, ids, sizes, times = [rows.column(c).to_numpy(zero_copy_only=False) for c in ("head", "object_id", "log_size", "time_us")]
            trace, direction = rows.column("trace_id"), rows.column("direction")
            chain, doubt, chains = np.empty(len(head), object), np.zeros(len(head), bool), np.zeros(len(head), np.int64)
            bounds = [0, *edges(rows).tolist(), len(head)]
            for a, b in zip(bounds[:-1], bounds[1:]):
                objects, heads = a + np.flatnonzero(~head[a:b]), a + np.flatnonzero(head[a:b])
                both = np.concatenate([objects, heads])
                chain[both], doubt[both], chains[a:b] = cut_bucket(ids[objects].tolist(), sizes[objects].tolist(), times[objects].tolist(), times[heads].tolist(), (trace[a].as_py(), direction[a].as_py()))
            names = [*BUCKET, "head", "place"]
            return pa.RecordBatch.from_arrays([*[rows.column(c) for c in names], pa.array(chain, pa.int64()), pa.array(doubt), pa.array(chains)], [*names, "chain", "doubt", "chains"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = edges(batch)
            last = int(new[-1]) if len(new) else 0
            same = bool(held) and all(batch.column(c)[0] == held[-1].column(c)[-1] for c in BUCKET)
            if last:
                held.append(batch.slice(0, last))
            if last or held and not same:
                yield whole()
                held = []
            held.append(batch.slice(last))
        if held:
            yield whole()

    cut = todo.mapInArrow(solve, "trace_id int, direction string, group_id long, subgroup_id long, head boolean, place struct<block:long,line:long,part:int>, chain long, doubt boolean, chains long")
    cut = store.keep(cut, "chains")
    # Chains are numbered through the buckets of a side.
    per = cut.groupBy(*BUCKET).agg(F.max("chains").alias("chains"))
    before = Window.partitionBy(*SIDE).orderBy("group_id", "subgroup_id").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*BUCKET, F.coalesce(F.sum("chains").over(before), F.lit(0)).alias("base"))
    ident = 4 * (2 * (F.col("base") + F.col("chain") + 1) - F.when(F.col("direction") == "created", 1).otherwise(0))
    certainty = F.when(F.col("chain").isNull(), "unresolved").when(F.col("doubt"), "uncertain").otherwise("certain")
    kind = F.when(F.col("head"), "header").otherwise("object").alias("kind")
    found = cut.join(per, BUCKET).select("trace_id", "place", "direction", kind, ident.alias("recovered_id"), certainty.alias("certainty"))
    rest = rows.where(~usable).select("trace_id", "place", "direction", "kind")
    return found.unionByName(rest.withColumn("recovered_id", F.lit(None).cast("long")).withColumn("certainty", F.lit("unresolved")))
