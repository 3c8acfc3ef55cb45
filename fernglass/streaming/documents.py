"""Documents that arrive as JSON lines: the engine's filters over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fernglass.operators.filter import find
from fernglass.sources.documents import DOC, parse_documents


def read_document_stream(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the JSON-lines files that are put in a folder."""
    return parse_documents(spark.readStream.text(path))


def find_stream(documents: DataFrame, query: dict | str) -> DataFrame:
    """The documents of a stream that match a filter; it keeps no state."""
    return find(documents, query, variant=DOC)
