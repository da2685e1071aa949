from __future__ import annotations

import pytest
from logs import REFERENCE_MS, end, header, obj, one_path, stream, subscribe, subscribe_ok, two_tracks, write

from tracelane.operators import report
from tracelane.plans.capture import SPECS, Capture, open_capture, validate_rows
from tracelane.sources.errors import CaptureError
from tracelane.sources.mlog import pick_files, plain_size


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()] if cols else [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    with open_capture(spark, one_path(tmp_path_factory.mktemp("one"))) as c:
        yield c


@pytest.fixture(scope="module")
def two(spark, tmp_path_factory):
    with open_capture(spark, two_tracks(tmp_path_factory.mktemp("two"))) as c:
        yield c


def test_one_path(path):
    assert rows(path.leg_summary()) == [("sub1", 1, "pub -> relay", 3, 50, 50, 50), ("sub1", 2, "relay dwell", 3, 1, 1, 1), ("sub1", 3, "relay -> sub", 3, 39, 39, 39)]
    assert rows(path.trust()) == [("pub", "client", 3, 3, 3, 0, 0, 0), ("sub1", "server", 3, 3, 3, 0, 0, 0)]
    assert rows(path.coverage()) == [("pub", 1, 1, "client"), ("sub1", 1, 1, "server")]
    assert [r[3:] for r in rows(path.jitter_summary())] == [(2, 0, 0, 0, 0)] * 3
    assert [(r[1], *r[3:]) for r in rows(path.jitter_series())] == [(k, 0, 2, 0, 0) for k in (1, 2, 3)]
    assert rows(path.relay_series()) == [("relay dwell", None, 0, 3, 1), ("relay egress jitter", None, 0, 2, 0), ("subscriber jitter", "sub1", 0, 2, 0)]
    assert {r[6:] for r in rows(path.object_bitrate_series())} == {(0, 3, 3813, 30.504)} and path.object_bitrate_series().count() == 8
    assert {r[6:] for r in rows(path.object_bitrate_summary())} == {(3813, 0, 0, None, None, None, None, None)}


def test_distributions(path):
    seen = []
    path.prepare_distributions(seen.append)
    path.prepare_distributions(seen.append)
    assert seen == ["distribution_summary", "distribution_bin"]
    d = path.distribution("end to end")
    assert (d["n"], d["p50"], d["bins"]) == (3, 90, [{"lo": 90, "hi": 90, "count": 3}])
    assert path.distribution("relay dwell", ("/bbb", "1.m4s"))["measured_at"] == "relay"
    assert path.distribution("interarrival")["p50"] == 10
    assert path.distribution("bitrate") is None and path.distribution("relay dwell", ("/bbb", "x")) is None


def test_relay_only(spark, tmp_path):
    servers = [s for s in one_path(tmp_path) if "_server" in s.name]
    with open_capture(spark, servers) as c:
        assert [r[1] for r in rows(c.leg_summary())] == [2]
        assert rows(c.trust()) == [("pub", None, 0, 3, None, None, None, None), ("sub1", "server", 3, 0, None, None, None, None)]
        assert {r[1] for r in rows(c.coverage())} == {0}
        assert c.distribution("interarrival")["measured_at"] == "relay" and c.distribution("end to end") is None


def test_two_tracks(two):
    by = {(r.leg_no, r.track_name): [] for r in two.jitter.select("leg_no", "track_name").distinct().collect()}
    for r in two.jitter.orderBy("object_id").collect():
        by[r.leg_no, r.track_name].append(r.d_us)
    assert by == {(1, "1.m4s"): [None, 2000, -3000], (1, "2.m4s"): [None, 1000], (2, "1.m4s"): [None, 1000, -1000], (2, "2.m4s"): [None, 0], (3, "1.m4s"): [None, 2000, -1000], (3, "2.m4s"): [None, 1000]}
    assert [tuple(round(x, 3) for x in r[3:]) for r in rows(two.leg_summary())] == [(5, 50.4, 50, 51.8), (5, 1.2, 1, 1.8), (5, 1039.8, 1040, 1040.8)]
    assert [tuple(round(x, 3) for x in r[3:]) for r in rows(two.jitter_summary())] == [(3, 2, 2.9, 2.98, 3), (3, 0.667, 1, 1, 1), (3, 1.333, 1.9, 1.98, 2)]
    assert [(r[0], r[1], r[2], r[3], round(r[4], 3)) for r in rows(two.relay_series())] == [("relay dwell", None, 0, 5, 1.2), ("relay egress jitter", None, 0, 3, 0.667), ("subscriber jitter", "c2", 1, 3, 1.333)]
    pivot = report.leg_pivot(two.leg_summary()).first()
    assert round(pivot.end_to_end_ms, 3) == 1091.4


def test_invariants(two):
    jitter = {(r.sub_cid, r.leg_no): r for r in two.jitter_summary().collect()}
    assert all(r.p95_ms <= r.p99_ms <= r.max_ms for r in jitter.values())
    total = {}
    for r in two.jitter_series().collect():
        total[r.sub_cid, r.leg_no] = total.get((r.sub_cid, r.leg_no), 0) + r.n
    assert total == {k: r.n for k, r in jitter.items()}
    sizes = {}
    for r in two.object_bitrate_summary().collect():
        sizes[r.cid, r.vantage_point, r.scope] = sizes.get((r.cid, r.vantage_point, r.scope), 0) + r.bytes
    assert all(sizes[c, v, "all"] == sizes[c, v, "track"] for c, v, _ in sizes)


@pytest.mark.parametrize(
    "sends, recvs, want",
    [
        ([(10, 0), (20, 1), (30, 2)], [(60, 0), (80, 2)], (3, 2, 2, 1, 0, 0)),
        ([(10, 0), (20, 1), (30, 2)], [(60, 0)], (3, 1, 1, 0, 2, 0)),
        ([(10, 0)], [(5, 0)], (1, 1, 1, 0, 0, 1)),
        ([(10, 0), (20, 1)], [], (2, 0, 0, None, None, 0)),
        ([(10, 0), (20, 1)], None, (2, 0, None, None, None, None)),
    ],
)
def test_trust(spark, tmp_path, sends, recvs, want):
    log = lambda times: {"1.m4s": [(float(t), o, 100) for t, o in times]}
    traces = [end(tmp_path, "c1", "client", "created", 2, 5, log(sends), None)]
    if recvs is not None:
        traces.append(end(tmp_path, "c1", "server", "parsed", 2, 4, log(recvs), None))
    with open_capture(spark, traces) as c:
        assert rows(c.trust())[0][2:] == want


def test_held_objects(spark, tmp_path):
    t = lambda *times: {"1.m4s": [(float(x), i, 1) for i, x in enumerate(times)]}
    traces = [
        end(tmp_path, "c1", "client", "created", 2, 5, t(10, 60), None),
        end(tmp_path, "c1", "server", "parsed", 2, 4, t(50, 100), None),
        end(tmp_path, "c2", "server", "created", 3, 9, t(80, 110), None, "created", ok_at=70.0),
        end(tmp_path, "c2", "client", "parsed", 3, 3, t(120, 150), None),
    ]
    with open_capture(spark, traces) as c:
        assert sorted(rows(c.dwell, "object_id", "held", "us")) == [(0, True, 30000), (1, False, 10000)]
        assert {r[0] for r in rows(c.leg, "object_id")} == {1} and c.leg.count() == 3


def test_unnamed_tracks_join_nothing(spark, tmp_path):
    """Objects whose track never resolved have NULL names, and NULLs join nothing."""
    ends = []
    for name, d, t in (("c1_client.mlog", "created", 10.0), ("c1_server.mlog", "parsed", 60.0)):
        ends.append(write(tmp_path, name, [header(name[3:9]), stream(t - 1, 2, 5, 7, d), obj(t, 2, 0, direction=d)]))
    with open_capture(spark, ends) as c:
        assert c.object.count() == 2 and c.hop.count() == 0


def test_no_cid(spark, tmp_path):
    traces = [write(tmp_path, s.name, open(s.path).read().replace("\x1e", "").splitlines(), None) for s in one_path(tmp_path)[:2]]
    with open_capture(spark, traces) as c:
        assert c.hop.count() == 0


def test_bins(spark):
    from tracelane.operators.views import distribution_bin, distribution_summary

    values = [(float(v),) for v in range(101)] + [(1000.0,)]
    sample = spark.createDataFrame(values, "value double").selectExpr("'interarrival' AS measure", "'ms' AS unit", "'relay' AS measured_at", "'all' AS scope", "CAST(NULL AS STRING) AS track_namespace", "CAST(NULL AS STRING) AS track_name", "value", "1L AS n")
    summary = distribution_summary(sample)
    assert round(summary.first().p99, 2) == 99.99
    bins = [(r.lo, r.hi, r["count"]) for r in distribution_bin(sample, summary).orderBy("bin").collect()]
    assert bins == [(5.0 * i, 5.0 * i + 5, 5) for i in range(20)] + [(100, 1000, 2)]


def base(*more):
    return [header("client"), subscribe(1, 0, "1.m4s"), subscribe_ok(2, 0, 5), stream(3, 2, 5, 7), obj(4, 2, 0), *more]


def test_shapes(spark, tmp_path):
    with open_capture(spark, [write(tmp_path, "a_client.mlog", base())]) as c:
        assert c.tables.shape.count() == 4 and c.shape_drift.count() == 0 and c.audit().count() == 0
    odd = obj(5, 2, 1)
    odd["data"]["object_status"] = 1
    text = stream(6, 6, 5, 8)
    text["data"]["stream_id"] = "6"
    unknown = {"time": 7, "name": "moqt:fetch_header_parsed", "data": {"stream_id": 9, "fin": True}}
    with open_capture(spark, [write(tmp_path, "b_client.mlog", base(odd, text, unknown))]) as c:
        drift = {r.name: r for r in c.shape_drift.collect()}
        assert drift["moqt:subgroup_object_parsed"].warning == "shape not in baseline, and these keys are not read: object_status"
        assert drift["moqt:subgroup_header_parsed"].warning == "shape not in baseline"
        assert '"stream_id":"VARCHAR"' in drift["moqt:subgroup_header_parsed"].fingerprint and '"fin":"BOOLEAN"' in drift["moqt:fetch_header_parsed"].fingerprint
        assert c.object.count() == 2 and c.tables.event_other.count() == 1
        assert {r[0] for r in rows(c.event, "stream_id")} >= {9}


def test_separators_and_blank_lines(spark, tmp_path):
    plain = write(tmp_path, "p_client.mlog", [*base(), "", "   "], rs=False)
    with open_capture(spark, [plain]) as c:
        assert c.tables.subgroup_object.count() == 1 and c.tables.trace.first().title == "t"


def failure(spark, traces):
    with pytest.raises(CaptureError) as e:
        open_capture(spark, traces)
    return e.value.failure


def test_refusals(spark, tmp_path):
    assert "Malformed JSON in file" in failure(spark, [write(tmp_path, "m_client.mlog", base("{not json"))])["message"]
    assert "no records" in failure(spark, [write(tmp_path, "e_client.mlog", [])])["message"]
    assert "header first" in failure(spark, [write(tmp_path, "h_client.mlog", base()[1:])])["message"]
    both = write(tmp_path, "d_client.mlog", base(stream(5, 6, 5, 8, "created"), stream(6, 2, 5, 9, "created")))
    assert "both a sent and a received" in failure(spark, [both])["message"]
    nameless = stream(5, 6, 5, 8)
    del nameless["data"]["stream_id"]
    assert "NULL stream_id in subgroup_stream" in failure(spark, [write(tmp_path, "k_client.mlog", base(stream(5, 6, 5, 8), nameless))])["message"]
    assert "duplicate key in subgroup_stream" in failure(spark, [write(tmp_path, "t_client.mlog", base(stream(5, 6, 5, 8), stream(6, 6, 5, 9)))])["message"]
    one = write(tmp_path, "s_client.mlog", base())
    assert "already loaded" in failure(spark, [one, one])["message"]
    with pytest.raises(CaptureError):
        open_capture(spark, [one], into=Capture(None))


def test_no_reference_time(spark, tmp_path):
    with open_capture(spark, [write(tmp_path, "n_client.mlog", [header("client", None), *base()[1:]])]) as c:
        r = c.tables.trace.first()
        assert (r.reference_time_source, r.time_format, r.reference_us) == ("none", "relative", 946684800000000)
        assert c.object.first().wall_us == 946684800004000


def test_clock_recovery(spark, tmp_path):
    traces = one_path(tmp_path)
    late = {"1.m4s": [(5061.0, 0, 1271), (5071.2, 1, 1271), (5081.02, 2, 1271)]}
    (tmp_path / "x").mkdir()
    traces[2] = end(tmp_path / "x", "sub1", "server", "created", 3, 9, late, None, "created", reference=None)
    with open_capture(spark, traces) as c:
        r = [r for r in c.recovery().collect() if r.trace == "sub1_server.mlog"][0]
        assert (r.reference_time, r.clock_matched, r.clock_near_floor) == ("recovered", 3, 2)
        assert sorted(x[0] for x in rows(c.dwell, "us")) == [0, 20, 200]
        notice = report.recovery_notice(c.recovery().withColumnsRenamed({"stream_ids": "stream_id_source", "stream_ids_uncertain": "stream_id_uncertain", "stream_ids_unresolved": "stream_id_unresolved", "reference_time": "reference_time_source"})).first()
        assert (notice.clock_traces, notice.weak_clocks) == (1, 1)
    assert REFERENCE_MS


def test_stock_relay(spark, tmp_path):
    """All stream ids are 0; two tracks of one group are told apart by size."""
    records = [header("server"), subscribe(1, 0, "a"), subscribe_ok(2, 0, 0), subscribe(1, 2, "b"), subscribe_ok(2, 2, 2), stream(3, 0, 0, 7), stream(4.5, 0, 2, 7)]
    for i in range(6):
        records += [obj(4 + 10 * i, 0, i, 20000 + 100 * i), obj(5 + 10 * i, 0, i, 300 + i)]
    source = write(tmp_path, "stock_server.mlog", records)
    with pytest.raises(CaptureError, match="stream_id"):
        open_capture(spark, [source], repair=False)
    with open_capture(spark, [source]) as c:
        got = {}
        for r in c.object.collect():
            assert r.stream_id % 4 == 0 and r.stream_id > 0
            got.setdefault(r.track_name, []).append(r.payload_length)
        assert {k: (len(v), min(v) >= 20000) for k, v in got.items()} == {"a": (6, True), "b": (6, False)}
        assert c.recovery().first().stream_ids == "recovered"


def test_validate_rows():
    spec = SPECS["coverage"]
    good = {"cid": "a", "client_traces": 1, "server_traces": 0, "sender": None}
    assert validate_rows("coverage", spec, [good]) == [good]
    for bad in ({**good, "cid": None}, {**good, "client_traces": "1"}, {**good, "sender": "nobody"}, {**good, "x": 1}, {"cid": "a"}):
        with pytest.raises(CaptureError):
            validate_rows("coverage", spec, [bad])


def test_schemas(path):
    for name in SPECS:
        frame = getattr(path, name)() if hasattr(Capture, name) and not isinstance(getattr(Capture, name), property) and name not in ("distribution_summary", "distribution_bin") else None
        if frame is not None:
            assert frame.columns == list(SPECS[name])


def test_pick_files():
    good, bad = pick_files(["/x/b_client.mlog", "/x/a_b_server.mlog.gz", "/x/a_b_server.mlog", "/x/readme.md"])
    assert [(s.name, s.cid) for s in good] == [("a_b_server.mlog", "a_b"), ("b_client.mlog", "b")] and [b[0] for b in bad] == ["a_b_server.mlog.gz", "readme.md"]
    assert plain_size(b"....\x10\x00\x00\x00") == 16


def test_command_line(spark, tmp_path, capsys):
    """A folder's logs are loaded to tables, and a query's rows come as CSV; a folder without logs is an error."""
    import gzip

    from tracelane.__main__ import main
    from tracelane.sources.mlog import pick_directory

    folder = tmp_path / "logs"
    folder.mkdir()
    plain = write(tmp_path, "a_b_client.mlog", base())
    (folder / "a_b_client.mlog.gz").write_bytes(gzip.compress(open(plain.path, "rb").read()))
    (folder / "other.txt").write_text("")
    assert [(s.name, s.cid) for s in pick_directory(str(folder))] == [("a_b_client.mlog", "a")]
    assert main(["load", str(tmp_path / "out"), str(folder)]) == 0
    assert capsys.readouterr().out == "1 objects\n" and spark.read.parquet(str(tmp_path / "out" / "subgroup_stream")).count() == 1
    assert main(["query", "coverage", str(folder)]) == 0
    assert capsys.readouterr().out.splitlines() == ["cid,client_traces,server_traces,sender", "a,1,0,server"]
    (tmp_path / "none").mkdir()
    assert main(["query", "coverage", str(tmp_path / "none")]) == 1
