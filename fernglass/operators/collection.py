"""A collection: named documents or rows with find, count, insert, update and delete.

A collection is a DataFrame behind a small facade. Changes give a new collection
over a rewritten plan; nothing is altered in place. ``save`` commits by one job.

Names are columns, dotted paths into structs, or, where a VARIANT column is named,
paths into its documents. Values of documents are ordered nulls and missing ones
first, then numbers, strings, booleans, then all else by its JSON text.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernglass.errors import OptionError
from fernglass.operators.filter import compile_filter, resolve


@dataclass(frozen=True)
class FindOptions:
    """What a find returns: columns or paths, order (name, ascending) and a number of rows."""

    select: tuple[str, ...] = ()
    order_by: tuple[tuple[str, bool], ...] = field(default=())
    limit: int | None = None
    skip: int = 0


@dataclass(frozen=True)
class UpdateResult:
    """The collection after an update, with the number of rows that matched."""

    collection: Collection
    matched: int


def variant_order(v: Column) -> list[Column]:
    """Sort keys of JSON values of any type."""
    kind = F.schema_of_variant(v)
    number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    rank = F.when(v.isNull() | F.is_variant_null(v), 0).when(number, 1).when(kind == "STRING", 2).when(kind == "BOOLEAN", 3).otherwise(4)
    whole = kind.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$")  # beyond 2**53 doubles tie
    return [rank, F.when(number, F.try_variant_get(v, "$", "double")), F.when(whole, F.try_variant_get(v, "$", "decimal(38,0)")), F.when(kind == "STRING", F.try_variant_get(v, "$", "string")), F.when(rank > 2, F.to_json(v))]


def set_path(v: Column, parts: list[str], new: Column) -> Column:
    """A document with a VARIANT put below a path of keys; what isn't an object on the way becomes one."""
    held = F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.from_json(F.lit("{}"), T.MapType(T.StringType(), T.StringType())).cast("map<string,variant>"))
    below = new if len(parts) == 1 else set_path(F.try_element_at(held, F.lit(parts[0])), parts[1:], new)
    rest = F.map_filter(held, lambda k, _: k != parts[0])
    return F.to_variant_object(F.map_concat(rest, F.create_map(F.lit(parts[0]), below)))


@dataclass(frozen=True)
class Collection:
    rows: DataFrame
    variant: str | None = None

    def _matches(self, query: dict | str) -> Column:
        return F.coalesce(compile_filter(self.rows, query, self.variant), F.lit(False))

    def _order(self, name: str, ascending: bool) -> list[Column]:
        found = resolve(self.rows, name, self.variant)
        if found.column is None:
            raise OptionError(f"no column {name}")
        keys = [found.column] if found.root is None else variant_order(found.column)
        return [k.asc_nulls_first() if ascending else k.desc_nulls_last() for k in keys]

    def _selected(self, name: str) -> Column:
        found = resolve(self.rows, name, self.variant)
        if found.column is None:
            raise OptionError(f"no column {name}")
        return found.column.alias(name)

    def find(self, query: dict | str, options: FindOptions = FindOptions()) -> DataFrame:
        if options.skip < 0 or options.limit is not None and options.limit < 0:
            raise OptionError("skip and limit are not negative")
        out = self.rows.where(compile_filter(self.rows, query, self.variant))
        if options.order_by:
            out = out.orderBy(*(k for name, ascending in options.order_by for k in self._order(name, ascending)))
        if options.skip:
            out = out.offset(options.skip)
        if options.limit is not None:
            out = out.limit(options.limit)
        return out.select(*map(self._selected, options.select)) if options.select else out

    def count(self, query: dict | str) -> int:
        return self.find(query).count()

    def insert(self, rows: DataFrame) -> Collection:
        return Collection(self.rows.unionByName(rows, allowMissingColumns=True), self.variant)

    def _document(self, value: Column | object) -> Column:
        """A value as a VARIANT."""
        if not isinstance(value, Column):
            return F.parse_json(F.lit(json.dumps(value)))
        kind = self.rows.select(value).schema[0].dataType
        if isinstance(kind, T.VariantType):
            return value
        return F.to_variant_object(value) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else value.cast("variant")

    def update(self, query: dict | str, values: dict[str, Column | object]) -> UpdateResult:
        """Sets columns of the matching rows, or paths of their documents; a value may be a Column over the old row."""
        hit = self._matches(query)
        new: dict[str, Column] = {}
        for name, value in values.items():
            if name in self.rows.columns:
                kind = self.rows.schema[name].dataType
                made = self._document(value) if isinstance(kind, T.VariantType) else (value if isinstance(value, Column) else F.lit(value)).cast(kind)
                new[name] = F.when(hit, made).otherwise(self.rows[f"`{name}`"])
                continue
            parts = name.split(".")
            root = self.variant
            if parts[0] in self.rows.columns and isinstance(self.rows.schema[parts[0]].dataType, T.VariantType):
                root, parts = parts[0], parts[1:]
            if root is None:
                raise OptionError(f"no column {name}")
            old = new.get(root, self.rows[f"`{root}`"])
            new[root] = F.when(hit, set_path(old, parts, self._document(value))).otherwise(old)
        return UpdateResult(Collection(self.rows.withColumns(new), self.variant), self.count(query))

    def delete(self, query: dict | str) -> Collection:
        return Collection(self.rows.where(~self._matches(query)), self.variant)

    def save(self, path: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
        writer = self.rows.write.mode(mode)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
