"""Joins on keys of which a few may hold most rows.

A key with at least a thousandth of all rows is hot; so at most a thousand are, and
their side is broadcast. The others, each under a thousandth, shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 1000


def join_by_count(rows: DataFrame, keyed: DataFrame, keys: list[str], count_col: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keyed`` (unique in ``keys``; ``count_col`` is each key's rows)."""
    hot = F.broadcast(keyed.where(F.col(count_col) * SHARE >= total))
    cold = keyed.where(F.col(count_col) * SHARE < total)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


#: Ids that a broadcast may hold (8 bytes each); beyond, a semi-join shuffles.
BROADCAST_IDS = 2_000_000


def without(rows: DataFrame, ids: DataFrame, on: str, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The rows whose ``on`` isn't among ``ids``; rows with a null one stay."""
    few = ids.count() <= broadcast_ids
    return rows.join(F.broadcast(ids) if few else ids, on, "left_anti").select(*rows.columns)
