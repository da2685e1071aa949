"""A capture: its tables and the queries over them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.operators import audit, clock, views
from tracelane.plans.schema import LEGS, Tables
from tracelane.sources.errors import CaptureError
from tracelane.sources.load import load_tables
from tracelane.sources.mlog import TraceSource
from tracelane.sources.store import Store


@dataclass(frozen=True)
class Col:
    """A column of a query's result: its type, whether it may be NULL, and the only values it may have."""

    type: str
    nullable: bool = False
    values: tuple = ()


_END = {"cid": Col("string"), "vantage_point": Col("string"), "direction": Col("string", values=("created", "parsed")), "scope": Col("string", values=("all", "track")), "track_namespace": Col("string", True), "track_name": Col("string", True)}
_LEG = {"sub_cid": Col("string"), "leg_no": Col("int", values=tuple(LEGS)), "leg": Col("string", values=tuple(LEGS.values()))}
_MEASURE = Col("string", values=("end to end", "relay dwell", "interarrival", "bitrate"))
_SCOPE = {"scope": _END["scope"], "track_namespace": Col("string", True), "track_name": Col("string", True)}
_D, _DN, _I, _IN = Col("double"), Col("double", True), Col("int"), Col("int", True)

#: What each query returns: exactly these columns, in this order.
SPECS: dict[str, dict[str, Col]] = {
    "leg_summary": _LEG | {"n": _I, "mean_ms": _D, "median_ms": _D, "p95_ms": _D},
    "jitter_summary": _LEG | {"n": _I, "mean_ms": _D, "p95_ms": _D, "p99_ms": _D, "max_ms": _D},
    "jitter_series": _LEG | {"t_s": _I, "n": _I, "mean_ms": _D, "max_ms": _D},
    "relay_series": {"series": Col("string", values=("relay dwell", "relay egress jitter", "subscriber jitter")), "sub_cid": Col("string", True), "t_s": _I, "n": _I, "mean_ms": _D},
    "object_bitrate_series": _END | {"t_s": _I, "objects": _I, "bytes": _D, "kbit_s": _D},
    "object_bitrate_summary": _END | {"bytes": _D, "seconds": _I, "span_s": _I, "mean_kbit_s": _DN, "p5_kbit_s": _DN, "median_kbit_s": _DN, "p95_kbit_s": _DN, "max_kbit_s": _DN},
    "trust": {"cid": Col("string"), "sender_is": Col("string", True), "sent": _I, "received": _I, "joined": _IN, "lost": _IN, "outside_window": _IN, "negative_hops": _IN},
    "coverage": {"cid": Col("string"), "client_traces": _I, "server_traces": _I, "sender": Col("string", True, ("client", "server", "both"))},
    "recovery": {
        "cid": Col("string"), "trace": Col("string"), "vantage_point": Col("string", True), "stream_ids": Col("string", values=("logged", "recovered")), "stream_ids_uncertain": _IN, "stream_ids_unresolved": _IN,
        "reference_time": Col("string", values=("logged", "recovered", "none")), "clock_matched": _IN, "clock_near_floor": _IN,
    },
    "distribution_summary": {"measure": _MEASURE, "unit": Col("string", values=("ms", "kbit/s")), "measured_at": Col("string", values=("subscriber", "relay")), **_SCOPE, "n": _I, **{c: _D for c in ("min", "p1", "p5", "p50", "p95", "p99", "max")}},
    "distribution_bin": {"measure": _MEASURE, **_SCOPE, "bin": _I, "lo": _D, "hi": _D, "count": _I},
}
ORDER = {
    "leg_summary": ["sub_cid", "leg_no"], "jitter_summary": ["sub_cid", "leg_no"], "jitter_series": ["sub_cid", "leg_no", "t_s"], "relay_series": ["series", "sub_cid", "t_s"], "object_bitrate_series": [*_END, "t_s"],
    "object_bitrate_summary": [*_END], "trust": ["cid"], "coverage": ["cid"], "recovery": ["cid", "vantage_point", "trace"], "distribution_summary": ["measure", *_SCOPE], "distribution_bin": ["measure", *_SCOPE, "bin"],
}

#: How far off dwell is when the relay's clock was recovered: it reads low by about this much.
RECOVERED_DWELL = {
    "typical_error_us": {"low": 3, "high": 9},
    "note": "The offset between logs without a reference time is taken from the object that passed the relay fastest, so dwell reads lower than it was. Differences, such as jitter, do not depend on it.",
}


def shaped(query: str, frame: DataFrame) -> DataFrame:
    """frame with a query's columns, types and order, NULLs last."""
    spec = SPECS[query]
    return frame.select(*[F.col(c).cast(k.type).alias(c) for c, k in spec.items()]).orderBy(*[F.col(c).asc_nulls_last() for c in ORDER[query]])


def validate_rows(query: str, spec: dict[str, Col], rows: list[dict]) -> list[dict]:
    """The rows, if they keep to the spec; CaptureError at the first that doesn't."""
    kinds = {"string": str, "int": int, "double": float}
    for i, row in enumerate(rows):
        for extra in row.keys() - spec.keys():
            raise CaptureError("row", "not in the spec", query=query, row=i, column=extra)
        for name, c in spec.items():
            if name not in row:
                raise CaptureError("row", "missing", query=query, row=i, column=name)
            v = row[name]
            if v is None:
                if not c.nullable:
                    raise CaptureError("row", f"NULL in a NOT NULL {c.type} column", query=query, row=i, column=name)
            elif not isinstance(v, kinds[c.type]) or isinstance(v, bool):
                raise CaptureError("row", f"expected {c.type}, got {type(v).__name__} {v!r}", query=query, row=i, column=name)
            elif c.values and v not in c.values:
                raise CaptureError("row", f"{v!r} is not one of {list(c.values)}", query=query, row=i, column=name)
    return rows


class Capture:
    """Queries over tables. Each measure is a lazy frame; what several of them read (objects, hops, legs, jitter, gaps, samples) is written once, at its first
    use. close() deletes all that was written; the frames are of no use then."""

    def __init__(self, tables: Tables, store: Store | None = None):
        self.tables = tables
        self._store = store
        self._distributions: tuple[list[dict], list[dict]] | None = None

    def _keep(self, frame: DataFrame, name: str) -> DataFrame:
        self._store = self._store or Store(frame.sparkSession)
        return self._store.keep(frame, name)

    def close(self) -> None:
        if self._store:
            self._store.remove()
        self._store = None
        for name in ("object", "hop", "dwell", "leg", "jitter", "interarrival", "bitrate_series_frame", "counted_sample"):
            self.__dict__.pop(name, None)

    def __enter__(self) -> Capture:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    @cached_property
    def object(self) -> DataFrame:
        return self._keep(views.objects(self.tables), "object")

    @cached_property
    def hop(self) -> DataFrame:
        return self._keep(views.hops(self.object, self.tables.trace), "hop")

    @cached_property
    def dwell(self) -> DataFrame:
        return self._keep(views.dwells(self.object, self.tables), "dwell")

    @cached_property
    def leg(self) -> DataFrame:
        return self._keep(views.legs(self.dwell, self.hop, self.tables.trace), "leg")

    @cached_property
    def jitter(self) -> DataFrame:
        return self._keep(views.jitter(self.leg), "jitter")

    @cached_property
    def interarrival(self) -> DataFrame:
        return self._keep(views.interarrival(self.object, self.tables.trace), "interarrival")

    @cached_property
    def bitrate_series_frame(self) -> DataFrame:
        return self._keep(views.object_bitrate_series(self.object_bitrate, self.object), "bitrate")

    @property
    def distribution_sample(self) -> DataFrame:
        return views.distribution_sample(*self._sampled)

    @cached_property
    def counted_sample(self) -> DataFrame:
        return self._keep(views.counted_sample(*self._sampled), "sample")

    @property
    def _sampled(self) -> tuple[DataFrame, ...]:
        return self.object, self.leg, self.interarrival, self.bitrate_series_frame, self.tables.trace

    @property
    def object_bitrate(self) -> DataFrame:
        return views.object_bitrate(self.object, self.tables.trace)

    @property
    def event(self) -> DataFrame:
        return views.events(self.tables)

    @property
    def shape_drift(self) -> DataFrame:
        return views.shape_drift(self.tables.shape)

    def leg_summary(self) -> DataFrame:
        return shaped("leg_summary", views.leg_summary(self.leg))

    def jitter_summary(self) -> DataFrame:
        return shaped("jitter_summary", views.jitter_summary(self.jitter))

    def jitter_series(self) -> DataFrame:
        return shaped("jitter_series", views.jitter_series(self.jitter, self.object))

    def relay_series(self) -> DataFrame:
        return shaped("relay_series", views.relay_series(self.leg, self.jitter, self.object))

    def object_bitrate_series(self) -> DataFrame:
        return shaped("object_bitrate_series", self.bitrate_series_frame)

    def object_bitrate_summary(self) -> DataFrame:
        return shaped("object_bitrate_summary", views.object_bitrate_summary(self.bitrate_series_frame))

    def trust(self) -> DataFrame:
        return shaped("trust", views.trust(self.object, self.hop, self.tables.trace))

    def coverage(self) -> DataFrame:
        return shaped("coverage", views.coverage(self.object, self.tables.trace))

    def recovery(self) -> DataFrame:
        names = {"filename": "trace", "stream_id_source": "stream_ids", "stream_id_uncertain": "stream_ids_uncertain", "stream_id_unresolved": "stream_ids_unresolved", "reference_time_source": "reference_time"}
        return shaped("recovery", views.recovery(self.tables).withColumnsRenamed(names))

    def audit(self) -> DataFrame:
        return audit.audit_duplicates(self.tables)

    def prepare_distributions(self, on_query=lambda name: None) -> None:
        """Runs the two queries behind distribution(), once; a run that fails is forgotten."""
        if self._distributions is None:
            summary = views.distribution_summary(self.counted_sample)
            rows = []
            for name, frame in (("distribution_summary", summary), ("distribution_bin", views.distribution_bin(self.counted_sample, summary))):
                on_query(name)
                rows.append(validate_rows(name, SPECS[name], [r.asDict() for r in shaped(name, frame).collect()]))  # a few rows a track
            self._distributions = (rows[0], rows[1])

    def distribution(self, measure: str, track: tuple[str, str] | None = None) -> dict | None:
        """A measure's quantiles and bins, over all or of one track (namespace, name); None if it has no samples."""
        self.prepare_distributions()
        scope = ("all", None, None) if track is None else ("track", *track)
        mine = lambda rows: [r for r in rows if r["measure"] == measure and (r["scope"], r["track_namespace"], r["track_name"]) == scope]
        summary, bins = (mine(rows) for rows in self._distributions)
        if not summary:
            return None
        head = {k: v for k, v in summary[0].items() if k not in ("scope", "track_namespace", "track_name")}
        return head | {"bins": [{k: b[k] for k in ("lo", "hi", "count")} for b in bins]}


def open_capture(spark: SparkSession, sources: list[TraceSource], into: Capture | None = None, repair: bool = True) -> Capture:
    """Loads traces in order, recovers stream ids of those that lack them and then clocks, and returns their queries. A capture holds one session's traces: its group ids
    mean nothing beside another's, so a capture that is in use takes no more."""
    if into is not None:
        raise CaptureError("engine-used", "this capture already holds traces; open another one")
    store = Store(spark)
    return Capture(clock.recover_clocks(load_tables(spark, sources, repair, store=store)), store)
