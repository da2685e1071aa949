"""The structure of a JSON value as text, in the notation of the shape baseline."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least upper bounds of scalar types; anything else that differs is JSON.
_NUMBERS = ["UBIGINT", "BIGINT", "DOUBLE"]


def _shape(value):
    """A type name, a list of one shape, or a dict of shapes."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "BOOLEAN"
    if isinstance(value, int):
        return ("UBIGINT" if value < 1 << 64 else "DOUBLE") if value >= 0 else ("BIGINT" if value >= -(1 << 63) else "DOUBLE")
    if isinstance(value, float):
        return "DOUBLE"
    if isinstance(value, str):
        return "VARCHAR"
    if isinstance(value, list):
        inner = "NULL"
        for v in value:
            inner = _join(inner, _shape(v))
        return [inner]
    return {k: _shape(v) for k, v in value.items()}


def _join(a, b):
    if a == b or b == "NULL":
        return a
    if a == "NULL":
        return b
    if isinstance(a, list) and isinstance(b, list):
        return [_join(a[0], b[0])]
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: _join(a.get(k, "NULL"), b.get(k, "NULL")) for k in [*a, *[k for k in b if k not in a]]}
    if a in _NUMBERS and b in _NUMBERS:
        return _NUMBERS[max(_NUMBERS.index(a), _NUMBERS.index(b))]
    return "JSON"


def structure(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return json.dumps(_shape(json.loads(text)), separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        return None


def json_structure(column: Column | str) -> Column:
    """structure() of each value; of each distinct value of a batch once."""

    @F.pandas_udf("string")
    def of(values: pd.Series) -> pd.Series:
        return values.map({v: structure(v) for v in values.unique()})

    return of(F.col(column) if isinstance(column, str) else column)


#: Names and strings whole, numbers, and every other character by itself.
_TOKENS = r'"(?:[^"\\]++|\\.)*+"\s*+:?+|-?\d[\d.eE+-]*+|[\s\S]'


def skeleton(column: Column | str) -> Column:
    """A JSON text without its strings and numbers, but for the kind of each: texts of one skeleton have one structure(). For grouping in the JVM before
    structure() sees one of each group."""
    text = F.col(column) if isinstance(column, str) else column
    def mark(t: Column) -> Column:
        # Numbers of up to 18 characters are in the range of their kind.
        number = F.when(t.rlike("[.eE]"), "#d").when((F.length(t) > 18) | (t == "-0"), t).when(t.startswith("-"), "#i").otherwise("#u")
        return F.when(t.rlike('^".*:$'), t).when(t.startswith('"'), "#s").when(t.rlike(r"^-?\d"), number).otherwise(t)

    return F.concat(F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)), mark), ""), F.when(F.try_parse_json(text).isNull(), "#").otherwise(""))
