"""Small logs for tests."""

from __future__ import annotations

import json
import os

from tracelane.sources.mlog import TraceSource

REFERENCE_MS = 1788560083342.7483


def header(vantage: str | None, reference: float | None = REFERENCE_MS, **trace) -> dict:
    common = {"time_format": "relative"} | ({"reference_time": reference} if reference is not None else {})
    return {"qlog_version": "0.3", "qlog_format": "JSON-SEQ", "title": "t", "trace": {"vantage_point": {"type": vantage} if vantage else {}, **({"common_fields": common} if reference is not None else {}), **trace}}


def event(time: float, name: str, **data) -> dict:
    return {"time": time, "name": f"moqt:{name}", "data": data}


def subscribe(time, sid, name, ns="/bbb", direction="parsed"):
    return event(time, f"control_message_{direction}", event_type="control_message", stream_id=0, message_type="subscribe", subscribe_id=sid, track_namespace=ns, track_name=name, parameters=[])


def subscribe_ok(time, sid, alias, direction="parsed"):
    return event(time, f"control_message_{direction}", event_type="control_message", stream_id=0, message_type="subscribe_ok", subscribe_id=sid, track_alias=alias, parameters=[], track_extensions=[])


def stream(time, sid, alias, group, direction="parsed", subgroup=0):
    return event(time, f"subgroup_header_{direction}", event_type="subgroup_header", stream_id=sid, header_type="subgroup", track_alias=alias, group_id=group, publisher_priority=127, subgroup_id=subgroup)


def obj(time, sid, oid, size=1271, direction="parsed", group=7, subgroup=0):
    return event(time, f"subgroup_object_{direction}", event_type="subgroup_object", stream_id=sid, group_id=group, subgroup_id=subgroup, object_id=oid, extension_headers=[], object_payload_length=size)


def write(folder, name: str, records: list, cid: str | None = "from name", rs: bool = True) -> TraceSource:
    path = os.path.join(str(folder), name)
    with open(path, "w") as f:
        for r in records:
            f.write(("\x1e" if rs else "") + (r if isinstance(r, str) else json.dumps(r)) + "\n")
    return TraceSource(name, name.rsplit("_", 1)[0] if cid == "from name" else cid, path)


def end(folder, cid, vantage, direction, sid, alias, tracks, times, ok_direction="parsed", group=7, reference=REFERENCE_MS, sub_at=1.0, ok_at=2.0):
    """tracks: {name: [(time, object id, size), ...]} for one end; stream ids follow sid by 4."""
    records = [header(vantage, reference)]
    body = []
    for k, (name, rows) in enumerate(tracks.items()):
        records += [subscribe(sub_at, 2 * k, name), subscribe_ok(ok_at, 2 * k, alias + k, ok_direction)]
        if rows:
            body.append(stream(rows[0][0] - 1, sid + 4 * k, alias + k, group, direction))
        body += [obj(t, sid + 4 * k, o, n, direction, group) for t, o, n in rows]
    return write(folder, f"{cid}_{vantage}.mlog", records + sorted(body, key=lambda r: r["time"]), cid)


def one_path(folder):
    """A publisher, the relay and a subscriber; three objects."""
    rows = lambda *times: {"1.m4s": [(float(t), i, 1271) for i, t in enumerate(times)]}
    return [
        end(folder, "pub", "client", "created", 2, 5, rows(10, 20, 30), None),
        end(folder, "pub", "server", "parsed", 2, 4, rows(60, 70, 80), None),
        end(folder, "sub1", "server", "created", 3, 9, rows(61, 71, 81), None, "created"),
        end(folder, "sub1", "client", "parsed", 3, 3, rows(100, 110, 120), None),
    ]


def two_tracks(folder):
    """Two tracks over one path; the subscriber's clock is 1,000 ms ahead."""
    sizes = {"1.m4s": [40000, 1200, 1300], "2.m4s": [500, 600]}
    at = {
        "pub": {"1.m4s": [10, 20, 30], "2.m4s": [15, 25]}, "in": {"1.m4s": [60, 72, 79], "2.m4s": [65, 76]}, "out": {"1.m4s": [61, 74, 80], "2.m4s": [66, 77]}, "sub": {"1.m4s": [100, 115, 120], "2.m4s": [105, 117]},
    }
    rows = lambda where: {n: [(float(t), i, sizes[n][i]) for i, t in enumerate(ts)] for n, ts in at[where].items()}
    return [
        end(folder, "c1", "client", "created", 2, 5, rows("pub"), None),
        end(folder, "c1", "server", "parsed", 2, 4, rows("in"), None),
        end(folder, "c2", "server", "created", 3, 9, rows("out"), None, "created"),
        end(folder, "c2", "client", "parsed", 3, 3, rows("sub"), None, reference=REFERENCE_MS + 1000),
    ]


def base_records():
    records = [header("client"), subscribe(1, 0, "1.m4s"), subscribe_ok(2, 0, 5), stream(3, 2, 5, 7)]
    return records + [obj(4 + i, 2, i, 100 + i) for i in range(6)] + [stream(20, 6, 5, 8), obj(21, 6, 0, group=8)]
