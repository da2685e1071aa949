"""Tables of a capture, their columns, and the values that are fixed by the log format."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame

#: Identity of an object within a capture. Joins compare the columns one by one, so a NULL matches nothing.
OBJECT_KEY = ["track_namespace", "track_name", "group_id", "subgroup_id", "object_id"]

TRACE = (
    "trace_id int, cid string, filename string, loaded_at timestamp, title string, description string, vantage_point string, "
    "reference_us long, reference_time_source string, stream_id_source string, stream_id_uncertain int, stream_id_unresolved int, "
    "time_format string, flush_policy string, qlog_version string, qlog_format string, event_schemas array<string>"
)
CLOCK_RECOVERY = "trace_id int, in_trace int, offset_us long, matched long, near_floor long"
TRACK = "trace_id int, track_alias long, subscribe_id long, track_namespace string, track_name string"
CONTROL = (
    "trace_id int, time_us long, direction string, message_type string, stream_id long, subscribe_id long, request_id long, request_kind string, "
    "track_alias long, track_namespace string, track_name string, parameters map<string,string>, track_extensions string"
)
STREAM = "trace_id int, stream_id long, direction string, time_us long, header_type string, track_alias long, group_id long, subgroup_id long, publisher_priority int"
OBJECT = "trace_id int, stream_id long, object_id long, time_us long, payload_length long, extension_count int"
OTHER = "trace_id int, time_us long, name string, data string"
SHAPE = "trace_id int, name string, fingerprint string, n long, first_time_us long, unconsumed array<string>"

#: Microseconds of 2000-01-01 UTC, which stands in for a reference time that a log lacks.
NO_REFERENCE_US = 946_684_800_000_000
UINT32, UINT16, UINT8 = (1 << 32) - 1, (1 << 16) - 1, (1 << 8) - 1

# Event names of the format and the keys that the loader reads of each.
CONTROL_EVENTS = ("moqt:control_message_created", "moqt:control_message_parsed")
HEADER_EVENTS = ("moqt:subgroup_header_created", "moqt:subgroup_header_parsed")
OBJECT_EVENTS = ("moqt:subgroup_object_created", "moqt:subgroup_object_parsed")
CONTROL_KEYS = ("event_type", "stream_id", "message_type", "subscribe_id", "request_id", "request_kind", "track_namespace", "track_name", "track_alias", "parameters", "track_extensions")
HEADER_KEYS = ("event_type", "stream_id", "header_type", "track_alias", "group_id", "subgroup_id", "publisher_priority")
OBJECT_KEYS = ("event_type", "stream_id", "group_id", "subgroup_id", "object_id", "extension_headers", "object_payload_length")

# The shapes (event name, types by key) that logs are known to have.
_V, _U = '"VARCHAR"', '"UBIGINT"'
_HEAD = f'"event_type":{_V},"stream_id":{_U},'
_MESSAGE = _HEAD + f'"message_type":{_V},'
_SUBSCRIBED = _MESSAGE + f'"subscribe_id":{_U},"track_alias":{_U},'
_NONE, _PAIRS, _EXTENSIONS = '"parameters":["NULL"]', '"parameters":[["VARCHAR"]]', '"track_extensions":["NULL"]'
_SUBSCRIBE = _MESSAGE + f'"subscribe_id":{_U},"track_namespace":{_V},"track_name":{_V},{_NONE}'
_REQUEST = _MESSAGE + f'"request_id":{_U},"request_kind":{_V},{_NONE}'
_NAMESPACE = _MESSAGE + f'"request_id":{_U},"track_namespace":{_V},{_NONE}'
_STREAM = _HEAD + f'"header_type":{_V},"track_alias":{_U},"group_id":{_U},"publisher_priority":{_U},"subgroup_id":{_U}'
_PAYLOAD = _HEAD + f'"group_id":{_U},"subgroup_id":{_U},"object_id":{_U},"extension_headers":["NULL"],"object_payload_length":{_U}'
SHAPE_BASELINE = tuple(
    (name, "{" + body + "}")
    for names, body in (
        (CONTROL_EVENTS, _SUBSCRIBE),
        (CONTROL_EVENTS, _MESSAGE + _PAIRS),
        (CONTROL_EVENTS, _REQUEST),
        (CONTROL_EVENTS, _NAMESPACE),
        (CONTROL_EVENTS, f"{_SUBSCRIBED}{_NONE},{_EXTENSIONS}"),
        (CONTROL_EVENTS, f"{_SUBSCRIBED}{_PAIRS},{_EXTENSIONS}"),
        (CONTROL_EVENTS[:1], _MESSAGE + f'"subscribe_id":{_U}'),
        (HEADER_EVENTS, _STREAM),
        (OBJECT_EVENTS, _PAYLOAD),
    )
    for name in names
)

LEGS = {1: "pub -> relay", 2: "relay dwell", 3: "relay -> sub"}


@dataclass(frozen=True)
class Tables:
    """A capture's tables. Frames are immutable, so a load that fails leaves no part of itself behind."""

    trace: DataFrame
    control_message: DataFrame
    subgroup_stream: DataFrame
    subgroup_object: DataFrame
    event_other: DataFrame
    track: DataFrame
    shape: DataFrame
    clock_recovery: DataFrame

    def items(self):
        return [(f.name, getattr(self, f.name)) for f in fields(self)]

    def with_(self, **changes: DataFrame) -> Tables:
        return replace(self, **changes)
