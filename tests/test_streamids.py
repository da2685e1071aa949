"""Recovery of stream ids over whole captures."""

from __future__ import annotations

import os
import time
from itertools import product

import numpy as np
import pytest
from logs import header, obj, stream, subscribe, subscribe_ok, write

import __spark_entry__ as entry
from tracelane.operators.streamids import cut_by_search, cut_chains, cut_from_zero, fit_clusters
from tracelane.plans.capture import open_capture
from tracelane.plans.demo import demo_tables

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_query_covers_the_capture(spark):
    """All objects of all streams of all traces are counted, and found ids are split by trace; an id stands for one subgroup."""
    t = demo_tables(spark, DATA)
    want = {(r.trace_id, r.stream_id): r["count"] for r in t.subgroup_object.groupBy("trace_id", "stream_id").count().collect()}
    group = {(r.trace_id, r.stream_id): r.group_id for r in t.subgroup_stream.collect()}
    got, found = {}, {}
    for r in entry.queries()["stream_ids"](spark, DATA).collect():
        key = (r.trace_id, r.true_id)
        got[key] = got.get(key, 0) + r.objects
        if r.found_id is not None:
            found.setdefault((r.trace_id, r.found_id), set()).add(group[key])
    assert got == want and len({k[0] for k in got}) == 6
    assert all(len(g) == 1 for g in found.values())
    assert {k[0] for k in found} == {1, 2, 3, 5}  # each subgroup of the others has lost objects, so no chains fit


def test_counted_sizes_fit_alike():
    rng = np.random.default_rng(5)
    for k in (1, 2, 5, 9):
        each = np.log(rng.integers(1, 40, 300).astype(float))
        sizes, times = np.unique(each, return_counts=True)
        assert np.allclose(fit_clusters(sizes, k, times), fit_clusters(each, k), rtol=0, atol=1e-9)


def least_cost(ids, sizes, chains, clusters):
    """The least deviation of any way to deal the objects to chains, each of one cluster and no two of the same."""
    best = None
    for picks in product(range(chains), repeat=len(ids)):
        parts = [[i for i, p in enumerate(picks) if p == c] for c in range(chains)]
        if all(parts) and all(ids[b] == ids[a] + 1 for part in parts for a, b in zip(part, part[1:])):
            for labels in product(range(len(clusters)), repeat=chains):
                if len(set(labels)) == chains:
                    cost = sum(8.0 * (ids[part[0]] > 0) + sum(abs(sizes[i] - clusters[x][0]) / clusters[x][1] for i in part) for part, x in zip(parts, labels))
                    best = cost if best is None else min(best, cost)
    return best


def test_chains_equal_brute_force():
    rng = np.random.default_rng(6)
    clusters = [(4.0, 0.5), (5.0, 0.5), (6.0, 0.5)]
    for _ in range(12):
        truth = [*range(3), *rng.integers(0, 3, 4)]
        ids = [truth[:i].count(c) for i, c in enumerate(truth)]
        sizes = [clusters[c][0] + rng.normal(0, 0.6) for c in truth]
        picks, _, labels = cut_chains(ids, sizes, 3, clusters)
        cost = sum(abs(s - clusters[labels[p]][0]) / clusters[labels[p]][1] for s, p in zip(sizes, picks)) + sum(8.0 * (ids[picks.index(c)] > 0) for c in range(3))
        assert abs(cost - least_cost(ids, sizes, 3, clusters)) < 1e-9


def test_chains_from_zero_equal_search():
    """All orders at once give what the search gives, choices, doubts and ties included; so do cuts that don't exist."""
    rng = np.random.default_rng(7)
    for _ in range(60):
        k = int(rng.integers(1, 6))
        chains = int(rng.integers(1, k + 1))
        clusters = [(float(c), 0.5) for c in rng.integers(3, 7, k)]
        truth = rng.permutation([*range(chains), *rng.integers(0, chains, 14)]).tolist()
        ids = [truth[:i].count(c) for i, c in enumerate(truth)]
        if rng.random() < 0.3:
            del ids[int(rng.integers(1, len(ids)))]
        sizes = [float(x) for x in rng.integers(3, 7, len(ids))]
        want = cut_by_search(ids, sizes, chains, clusters)
        assert cut_chains(ids, sizes, chains, clusters) == want
        if ids.count(0) == chains:
            assert cut_from_zero(ids, sizes, clusters) == want


def test_long_subgroup_is_cut():
    """Five chains of 5,000 objects whose sizes tell little: the search took over ten seconds for them."""
    rng = np.random.default_rng(8)
    truth = rng.permutation(np.repeat(np.arange(5), 5000)).tolist()
    seen = [0] * 5
    ids = [(seen[c], seen.__setitem__(c, seen[c] + 1))[0] for c in truth]
    began = time.process_time()
    picks, _, labels = cut_chains(ids, rng.normal(5, 1, len(ids)).tolist(), 5, [(4.0 + c / 2, 0.5) for c in range(5)])
    assert time.process_time() - began < 3
    assert len(labels) == 5 and all([i for i, p in zip(ids, picks) if p == c] == list(range(5000)) for c in range(5))


def test_tracks_one_after_another():
    """Five whole chains in turn, as a late subscriber gets them: chains that start late crowd the search's states until no cut is left."""
    rng = np.random.default_rng(3)
    lengths = (41, 36, 45, 38, 40)
    ids = [i for n in lengths for i in range(n)]
    sizes = np.log(rng.exponential(5000, len(ids)) + 1).tolist()
    picks, _, labels = cut_chains(ids, sizes, 5, fit_clusters(np.log(rng.exponential(5000, 20_000) + 1), 5))
    assert sorted(labels) == list(range(5))
    assert all([i for i, p in zip(ids, picks) if p == c] == list(range(picks.count(c))) for c in range(5))
    assert sorted(map(picks.count, range(5))) == sorted(lengths)


def test_planted_capture(spark, tmp_path):
    """Three tracks of far sizes over two groups and two traces: each stream is found whole; a subgroup that lost an object is left out, the other is not."""
    def log(name, vantage, direction, lost):
        records = [header(vantage)]
        for k, track in enumerate("abc"):
            records += [subscribe(1, 2 * k, track), subscribe_ok(2, 2 * k, k)]
        body = [stream(100 * g + 3 + k / 10, 0, k, g, direction) for g in (1, 2) for k in range(3)]
        for g, k, i in product((1, 2), range(3), range(5)):
            if (g, k, i) != lost:
                body.append(obj(100 * g + 10 + 10 * i + k, 0, i, 50 * 30**k + i, direction, group=g))
        return write(tmp_path, name, records + sorted(body, key=lambda r: r["time"]), name.split("_")[0])

    sources = [log("p_client.mlog", "client", "created", None), log("p_server.mlog", "server", "parsed", (2, 1, 2))]
    with open_capture(spark, sources) as c:
        got = {}
        for r in c.object.collect():
            got.setdefault((r.trace_id, r.group_id, r.track_name), set()).add((r.stream_id, r.object_id, r.payload_length))
    want = {(t, g, x): {(i, 50 * 30**k + i) for i in range(5)} for t, g in ((1, 1), (1, 2), (2, 1)) for k, x in enumerate("abc")}
    assert {k: {v[1:] for v in rows} for k, rows in got.items()} == want
    assert all(len({v[0] for v in rows}) == 1 for rows in got.values())
