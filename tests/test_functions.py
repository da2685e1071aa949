from __future__ import annotations

import json

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelane.functions.csv import csv_lines, to_csv
from tracelane.functions.fingerprint import skeleton, structure
from tracelane.operators import report
from tracelane.operators.streamids import cut_chains, fit_clusters, name_clusters
from tracelane.plans.schema import SHAPE_BASELINE


def test_structure():
    cases = {'{"a":1,"b":[],"c":[["x","y"]],"d":null}': '{"a":"UBIGINT","b":["NULL"],"c":[["VARCHAR"]],"d":"NULL"}', "[1,-2,3.5]": '["DOUBLE"]', '[{"a":1},{"b":"x"}]': '[{"a":"UBIGINT","b":"VARCHAR"}]', '[1,"x"]': '["JSON"]', '[true,null]': '["BOOLEAN"]'}
    assert {k: structure(k) for k in cases} == cases
    assert structure("{") is None and structure(None) is None


def test_skeleton(spark):
    """Texts of one skeleton have one structure."""
    texts = ['{"a":1,"b":"x"}', '{"a":2,"b":"y: 3"}', '{"a":-2,"b":"y"}', '{"a":-0,"b":"y"}', '{"a":2.5,"b":"y"}', '{"a":1e3,"b":""}', '{"b":"x","a":1}', '{"a1":1,"b":"x"}', '{"a":18446744073709551616,"b":"q"}', '{"a":9007199254740993,"b":"q"}', '[1,2]', '[1]', "[]", '{"k\\":":1}', '{"k\\":":"1"}', "tr", None, "", '{"a":01,"b":"x"}', '[true]', '[false]']
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", skeleton("t").alias("s")).collect()
    of = {}
    for r in got:
        of.setdefault(r.s, set()).add(structure(r.t))
    assert all(len(v) == 1 for v in of.values()) and len(of) <= len(texts) - 2


def test_slices(spark):
    """The row before is found across slices of time, within each key."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tracelane.operators import views

    rng = np.random.default_rng(2)
    rows = [(int(k) or None, int(t) if t % 11 else None, i, int(v) if v else None) for i, (k, t, v) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(-5, 60, 200) * 1_700_000, rng.integers(0, 9, 200)))]
    df = spark.createDataFrame(rows, "k int, t long, i int, v int")
    want = df.withColumn("before", F.lag("v").over(Window.partitionBy("k").orderBy("t", "i")))
    assert sorted(map(str, views._before(df, "v", ["k"], ["t", "i"]).select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_baseline():
    assert len(SHAPE_BASELINE) == len(set(SHAPE_BASELINE)) == 17 and all(json.loads(f) for _, f in SHAPE_BASELINE)


def test_csv(spark):
    assert to_csv(["a", "b"], [[None, ""], ['x"y', "1,2"], ["l\nm", 3]]) == 'a,b\n,""\n"x""y","1,2"\n"l\nm",3\n'
    df = spark.createDataFrame([(None, "", 1), ('q"', "a,b", None)], "a string, b string, c int")
    assert [r.line for r in csv_lines(df).collect()] == [',"",1', '"q""","a,b",']


def test_clusters():
    sizes = np.log(np.array([100.0] * 5 + [10000.0] * 5))
    (a, sa), (b, sb) = fit_clusters(sizes, 2)
    assert round(np.exp(a)) == 100 and round(np.exp(b)) == 10000 and sa == sb == 0.05
    assert name_clusters([(a, sa), (b, sb)]) == ["audio", "video"]
    assert fit_clusters(np.array([]), 2) == [(0.0, 1.0)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.floats(-0.5, 0.5)), min_size=2, max_size=24))
def test_chains_are_consecutive(choices):
    """Whatever the order in which two streams' objects come, each chain's ids run up by one and every object is in a chain."""
    clusters = [(5.0, 0.3), (9.0, 0.3)]
    nxt, ids, sizes, truth = [0, 0], [], [], []
    for which, noise in choices:
        ids.append(nxt[which])
        nxt[which] += 1
        sizes.append(clusters[which][0] + noise)
        truth.append(which)
    chains = len(set(truth))
    picks, _, labels = cut_chains(ids, sizes, chains, clusters)
    for c in range(chains):
        mine = [i for i, p in zip(ids, picks) if p == c]
        assert mine == list(range(len(mine)))
    assert [labels[p] for p in picks] == [int(t) for t in truth]


def test_no_cut():
    assert cut_chains([0, 2], [1.0, 1.0], 1, [(1.0, 1.0)]) is None


def test_opening_window():
    assert [report.opening_window(s) for s in (0, 20, 120, 240, 600, 6000)] == [100, 100, 100, 25, 10, 10]
