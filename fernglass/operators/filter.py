"""JSON filters compiled to Spark columns.

A filter is an object of fields. A field's value is a literal (equality) or an
object of operators, all of which must hold: ``$lt $lte $gt $gte $ne $in $nin``.
All fields must hold; an empty filter matches every row. A dotted name is a path.

Decisions: a null literal equals null and missing; ``$ne`` and ``$nin`` are total
negations, so they keep null and missing; a literal of another type than the value
matches nothing; an object or list as a range operand matches nothing. Objects are
equal whatever the order of their keys, and numbers in them by value. Raised:
operators at the top level, unknown ``$`` names, operators mixed with plain keys,
a root that isn't an object, a non-list for ``$in`` and ``$nin``, repeated keys,
numbers that overflow a double.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernglass.errors import FilterError
from fernglass.functions.literals import compare, compare_variant, never

RANGE = {"$lt": "lt", "$lte": "lte", "$gt": "gt", "$gte": "gte"}
OPERATORS = {*RANGE, "$ne", "$in", "$nin"}


def parse_filter(text: str) -> dict:
    """A filter's JSON text, checked more strictly than JSON itself."""

    def unique(pairs: list[tuple[str, object]]) -> dict:
        out = dict(pairs)
        if len(out) < len(pairs):
            raise FilterError("a key is repeated")
        return out

    def constant(name: str) -> object:
        raise FilterError(f"{name} is not JSON")

    try:
        found = json.loads(text, object_pairs_hook=unique, parse_constant=constant)
    except (ValueError, RecursionError) as e:
        raise FilterError(f"not JSON: {e}") from None
    return check_filter(found)


def _check_value(value: object) -> None:
    if isinstance(value, float) and not math.isfinite(value):
        raise FilterError("a number overflows")
    if isinstance(value, list):
        for x in value:
            _check_value(x)
    elif isinstance(value, dict):
        for k, x in value.items():
            if not isinstance(k, str):
                raise FilterError("keys are strings")
            _check_value(x)
    elif not (value is None or isinstance(value, (bool, int, float, str))):
        raise FilterError(f"{type(value).__name__} is not a JSON value")


def check_filter(found: object) -> dict:
    if not isinstance(found, dict):
        raise FilterError("a filter is an object")
    for field, value in found.items():
        if not isinstance(field, str):
            raise FilterError("field names are strings")
        if field.startswith("$"):
            raise FilterError(f"{field} at the top level")
        _check_value(value)
        if isinstance(value, dict) and any(k.startswith("$") for k in value):
            if plain := [k for k in value if not k.startswith("$")]:
                raise FilterError(f"operators mixed with the plain key {plain[0]!r}")
            for op, operand in value.items():
                if op not in OPERATORS:
                    raise FilterError(f"unknown operator {op}")
                if op in ("$in", "$nin") and not isinstance(operand, list):
                    raise FilterError(f"{op} takes a list")
    return found


def same_json(v: Column, value: object) -> Column:
    """Whether a VARIANT is a JSON value; null where it is of another type."""
    if value is None:
        return F.is_variant_null(v)
    if isinstance(value, list):
        items = F.try_variant_get(v, "$", "array<variant>")
        return reduce(lambda a, b: a & b, [same_json(F.get(items, F.lit(i)), x) for i, x in enumerate(value)], F.size(items) == len(value))
    if isinstance(value, dict):
        held = F.try_variant_get(v, "$", "map<string,variant>")
        own = [F.map_contains_key(held, k) & same_json(F.try_element_at(held, F.lit(k)), x) for k, x in value.items()]
        return reduce(lambda a, b: a & b, own, F.size(held) == len(value))
    return compare_variant(v, "eq", value)


class _Field:
    """A resolved field: a typed column, a VARIANT (by a path below a root column), or nothing."""

    def __init__(self, column: Column | None, kind: T.DataType | None, root: Column | None = None, path: tuple[str, ...] = ()):
        self.column, self.kind, self.root, self.path = column, kind, root, path

    def equals(self, value: object) -> Column:
        """Equality that is never null where the column has a value."""
        if self.column is None:
            return F.lit(value is None)
        if value is None:
            if isinstance(self.kind, T.VariantType):
                return self.column.isNull() | F.is_variant_null(self.column)
            return self.column.isNull()
        if isinstance(value, (dict, list)):
            return self._nested(value)
        if isinstance(self.kind, T.VariantType):
            return compare_variant(self.column, "eq", value)
        return compare(self.column, self.kind, "eq", value)

    def _nested(self, value: dict | list) -> Column:
        if isinstance(self.kind, T.VariantType):
            held = self.column
        elif isinstance(self.kind, (T.ArrayType, T.MapType, T.StructType)):
            held = F.to_variant_object(self.column)
        else:
            return never()
        return F.coalesce(F.exists(F.array(held), lambda v: same_json(v, value)), never())

    def range(self, op: str, value: object) -> Column:
        if self.column is None or value is None or isinstance(value, (bool, dict, list)):
            return never()
        if isinstance(self.kind, T.VariantType):
            return compare_variant(self.column, op, value)
        return compare(self.column, self.kind, op, value)

    def differs(self, value: object) -> Column:
        if self.column is None or value is None:
            return ~self.equals(value)
        return self.column.isNull() | ~self.equals(value)

    def among(self, values: list) -> Column:
        return reduce(lambda a, b: a | b, [self.equals(v) for v in values], never()) if not self._plain(values) else self._isin(values)

    def outside(self, values: list) -> Column:
        if self._plain(values):
            rest = [v for v in values if v is not None]
            kept = ~self.column.isin(*self._cast(rest)) if rest else None
            if len(rest) < len(values):
                return self.column.isNotNull() if kept is None else self.column.isNotNull() & kept
            return F.lit(True) if kept is None else self.column.isNull() | kept
        if not values:
            return F.lit(True)
        return reduce(lambda a, b: a & b, [self.differs(v) for v in values])

    def _plain(self, values: list) -> bool:
        """Whether a plain IN list of the column's own type says it all."""
        own = {T.LongType: int, T.IntegerType: int, T.StringType: str}.get(type(self.kind))
        if own is None or self.column is None:
            return False
        bits = 31 if isinstance(self.kind, T.IntegerType) else 63
        return all(v is None or type(v) is own and (own is str or -(1 << bits) <= v < 1 << bits) for v in values)

    def _cast(self, values: list) -> list[Column]:
        return [F.lit(v).cast(self.kind) for v in values]

    def _isin(self, values: list) -> Column:
        rest = [v for v in values if v is not None]
        found = self.column.isin(*self._cast(rest)) if rest else never()
        return self.column.isNull() | found if len(rest) < len(values) else found


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def variant_path(parts: list[str]) -> str:
    return "$" + "".join("[" + json.dumps(p, ensure_ascii=False) + "]" for p in parts)


def resolve(df: DataFrame, name: str, variant: str | None = None, literal_keys: bool = False) -> _Field:
    """The column that a field name means: a path through structs, or into the VARIANT column."""
    parts = [name] if literal_keys else name.split(".")
    kind: T.DataType = df.schema
    column: Column | None = None
    for i, part in enumerate(parts):
        if isinstance(kind, T.VariantType):
            return _inside(column, parts[i:])
        names = kind.fieldNames() if isinstance(kind, T.StructType) else []
        if part not in names:
            if i == 0 and variant is not None:
                return _inside(df[_quoted(variant)], parts)
            return _Field(None, None)
        kind = kind[part].dataType
        column = df[_quoted(part)] if column is None else column.getField(part)
    return _inside(column, []) if isinstance(kind, T.VariantType) else _Field(column, kind)


def _inside(root: Column, parts: list[str]) -> _Field:
    return _Field(variant_get(root, parts), T.VariantType(), root, tuple(parts))


def variant_get(v: Column, parts: list[str] | tuple[str, ...], kind: str = "variant") -> Column:
    """What lies below a path of keys, of any characters."""
    if not parts:
        return v if kind == "variant" else F.try_variant_get(v, "$", kind)
    if any(c in p for p in parts for c in "\"'\\]"):  # no path can name such a key
        inner = F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(parts[0]))
        return variant_get(inner, parts[1:], kind)
    return F.try_variant_get(v, variant_path(parts), kind)


def _conditions(field: _Field, value: object) -> Column:
    """All that a filter asks of a field."""
    if not (isinstance(value, dict) and any(k.startswith("$") for k in value)):
        return field.equals(value)
    parts = []
    for op, operand in value.items():
        if op in RANGE:
            parts.append(field.range(RANGE[op], operand))
        elif op == "$ne":
            parts.append(field.differs(operand))
        else:
            parts.append(field.among(operand) if op == "$in" else field.outside(operand))
    return reduce(lambda a, b: a & b, parts)


def compile_filter(df: DataFrame, query: dict | str, variant: str | None = None, literal_keys: bool = False) -> Column:
    """The condition that a filter states over the columns of ``df``."""
    found = parse_filter(query) if isinstance(query, str) else check_filter(query)
    parts: list[Column] = []
    inside: dict[str, tuple[Column, list[tuple[tuple[str, ...], object]]]] = {}
    for name, value in found.items():
        field = resolve(df, name, variant, literal_keys)
        if field.root is None:
            parts.append(_conditions(field, value))
        else:
            inside.setdefault(str(field.root), (field.root, []))[1].append((field.path, value))

    def once(v: Column, path: tuple[str, ...], value: object) -> Column:
        # bound by a lambda, so that a field is extracted, and the JSON below it parsed, a single time
        return F.exists(F.array(variant_get(v, path)), lambda x: _conditions(_Field(x, T.VariantType()), value))

    def every(asked: list[tuple[tuple[str, ...], object]]) -> Callable[[Column], Column]:
        return lambda v: reduce(lambda a, b: a & b, [once(v, path, value) for path, value in asked])

    for root, asked in inside.values():
        parts.append(F.exists(F.array(root), every(asked)))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def find(df: DataFrame, query: dict | str, variant: str | None = None, literal_keys: bool = False) -> DataFrame:
    """The rows of ``df`` that match a filter."""
    return df.where(compile_filter(df, query, variant, literal_keys))
