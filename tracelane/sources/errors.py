from __future__ import annotations


class CaptureError(Exception):
    """failure: a dict with kind (load, row, engine, engine-used) and what that kind tells."""

    def __init__(self, kind: str, message: str, **more: object):
        self.failure = {"kind": kind, "message": message, **more}
        where = more.get("trace") or more.get("query")
        super().__init__(f"{kind}: {where}: {message}" if where else f"{kind}: {message}")
