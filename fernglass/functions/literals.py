"""Comparison of columns with JSON literals, in forms that reach the Parquet scan.

Numbers are compared exactly: a fractional bound on an integer column becomes an
integer bound, an integer beyond 2**53 is never rounded to a double, and a literal
outside a column's range decides the comparison by itself.
"""

from __future__ import annotations

import math
import struct
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RANGES = {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63}
_OPS = {
    "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "eq": lambda c, v: c == v,
}


def never() -> Column:
    return F.lit(False)


def is_number(value: object) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _integral(c: Column, bits: int, op: str, value: int | float, spark_type: str) -> Column:
    if isinstance(value, float):
        if value.is_integer():
            value = int(value)
        elif op == "eq":
            return never()
        else:
            up = op in ("gt", "gte")
            value, op = (math.ceil(value), "gte") if up else (math.floor(value), "lte")
    if value >= 1 << bits:
        return c.isNotNull() if op in ("lt", "lte") else never()
    if value < -(1 << bits):
        return c.isNotNull() if op in ("gt", "gte") else never()
    return _OPS[op](c, F.lit(value).cast(spark_type))


def _floating(c: Column, op: str, value: int | float, spark_type: str) -> Column:
    try:
        near = float(value)
    except OverflowError:
        return c.isNotNull() if (value > 0) == (op in ("lt", "lte")) and op != "eq" else never()
    if isinstance(value, int) and int(near) != value:  # no double equals it; its nearest one bounds it from one side
        if op == "eq":
            return never()
        below = near < value
        op = ("lte" if below else "lt") if op in ("lt", "lte") else ("gt" if below else "gte")
    return _OPS[op](c, F.lit(near).cast("float") if spark_type == "float" and _is_float32(near) else F.lit(near))


def _is_float32(value: float) -> bool:
    try:
        return struct.unpack("f", struct.pack("f", value))[0] == value
    except OverflowError:
        return False


def compare_number(c: Column, kind: T.DataType, op: str, value: int | float) -> Column:
    """``c op value`` for a numeric column of type ``kind``."""
    name = kind.simpleString()
    if name in _RANGES:
        return _integral(c, _RANGES[name], op, value, name)
    if isinstance(kind, T.DecimalType):
        exact = Decimal(value) if isinstance(value, int) else Decimal(repr(value))
        if exact.adjusted() >= 38:
            return c.isNotNull() if (exact > 0) == (op in ("lt", "lte")) and op != "eq" else never()
        if max(0, -exact.as_tuple().exponent) + max(1, exact.adjusted() + 1) > 38:
            return _OPS[op](c.cast("double"), F.lit(float(value)))
        return _OPS[op](c, F.lit(exact))
    return _floating(c, op, value, name)


def compare_time(c: Column, kind: T.DataType, op: str, value: str) -> Column:
    """``c op value`` for a date or timestamp column and an ISO 8601 string; other strings match nothing."""
    try:
        at = date.fromisoformat(value) if isinstance(kind, T.DateType) else datetime.fromisoformat(value)
    except ValueError:
        return never()
    return _OPS[op](c, F.lit(at))


def compare(c: Column, kind: T.DataType, op: str, value: object) -> Column:
    """``c op value`` for a typed column; a literal of another type matches nothing."""
    if isinstance(kind, T.NumericType):
        return compare_number(c, kind, op, value) if is_number(value) else never()
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return _OPS[op](c, F.lit(value)) if isinstance(value, str) else never()
    if isinstance(kind, T.BooleanType):
        return c == F.lit(value) if isinstance(value, bool) and op == "eq" else never()
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return compare_time(c, kind, op, value) if isinstance(value, str) else never()
    return never()


def compare_variant(v: Column, op: str, value: object) -> Column:
    """``v op value`` for a VARIANT: types are told apart before anything is extracted."""
    kind = F.schema_of_variant(v)
    get = lambda t: F.try_variant_get(v, "$", t)
    if isinstance(value, bool):
        return (kind == "BOOLEAN") & get("boolean").eqNullSafe(F.lit(value)) if op == "eq" else never()
    if isinstance(value, str):
        return (kind == "STRING") & _OPS[op](get("string"), F.lit(value))
    if is_number(value):
        whole = F.when(kind == "BIGINT", compare_number(get("bigint"), T.LongType(), op, value))
        whole = whole.when(kind.rlike(r"^DECIMAL\(\d+,0\)$"), compare_number(get("decimal(38,0)"), T.DecimalType(38, 0), op, value))
        whole = whole.when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), compare_number(get("double"), T.DoubleType(), op, value))
        return F.coalesce(whole, never())
    return never()
