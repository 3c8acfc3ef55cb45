"""JSON documents as rows: an ``_id`` and a VARIANT of the other fields' object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.operators.filter import variant_get

DOC = "doc"


def parse_documents(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """(_id, doc) of every line that holds a JSON object; ``_id`` is the id's canonical JSON, null where missing.

    Lines that aren't JSON objects, or repeat a key, are left out (see ``rejected``).
    """
    rows = lines.select(F.try_parse_json(F.col(text_col)).alias(DOC)).where(F.schema_of_variant(DOC).startswith("OBJECT"))
    return rows.select(F.to_json(F.try_variant_get(DOC, "$._id", "variant")).alias("_id"), DOC)


def rejected(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """The lines that ``parse_documents`` leaves out."""
    doc = F.try_parse_json(F.col(text_col))
    return lines.where(~F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False)))


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Documents of JSON-lines files."""
    return parse_documents(spark.read.text(path))


def write_documents(docs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Documents as JSON-lines files."""
    docs.select(F.to_json(DOC).alias("value")).write.mode(mode).text(path)


def has_field(name: str) -> Column:
    """Whether a document has the field, be its value null."""
    return variant_get(F.col(DOC), [name]).isNotNull()


def shred(docs: DataFrame, fields: dict[str, str]) -> DataFrame:
    """``docs`` with typed columns for hot fields, so that filters on them reach the scan once written."""
    return docs.withColumns({name: variant_get(F.col(DOC), [name], kind) for name, kind in fields.items()})
