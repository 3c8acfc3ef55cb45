"""Connected components over an edge table, without collecting a group anywhere.

Each partition first contracts its own edges to a spanning star forest. Where the
forest is small (a checked size) one task finishes it; beyond that, alternating
large-star and small-star rounds run as distributed aggregations and joins, each
round written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialize

#: Edges (16 bytes each) that a single task may finish.
SINGLE_TASK_EDGES = 4_000_000


def min_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest vertex of each vertex's component; vertices are 0..n-1."""
    label = np.arange(n)
    while len(a):
        ra, rb = label[a], label[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label = nxt
    return label


def star_forest(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (vertex, smallest vertex of its component), the centres included."""
    ids, inv = np.unique(np.concatenate([src, dst]), return_inverse=True)
    label = min_labels(len(ids), inv[: len(src)], inv[len(src) :])
    return ids, ids[label]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    src, dst, held = np.zeros(0, np.int64), np.zeros(0, np.int64), 1 << 20
    for batch in batches:
        src = np.concatenate([src, batch.column(0).to_numpy(zero_copy_only=False)])
        dst = np.concatenate([dst, batch.column(1).to_numpy(zero_copy_only=False)])
        if len(src) > held:
            src, dst = star_forest(src, dst)
            held = max(1 << 20, 2 * len(src))
    if len(src):
        src, dst = star_forest(src, dst)
        for i in range(0, len(src), 1 << 16):
            yield pa.record_batch([pa.array(src[i : i + (1 << 16)]), pa.array(dst[i : i + (1 << 16)])], names=["src", "dst"])


def _stars(edges: DataFrame) -> DataFrame:
    """Alternate large-star and small-star until nothing changes."""
    while True:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
        large = both.join(least, "src").where(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst")
        least = down.groupBy("src").agg(F.min("dst").alias("m"))
        joined = down.join(least, "src")
        small = joined.select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(least.select("src", F.col("m").alias("dst"))).where("src <> dst").distinct()
        new = materialize(small, "stars")
        same = new.join(edges, ["src", "dst"], "left_anti").isEmpty() and edges.join(new, ["src", "dst"], "left_anti").isEmpty()
        edges = new
        if same:
            return edges


def connected_components(edges: DataFrame, single_task_edges: int = SINGLE_TASK_EDGES) -> DataFrame:
    """(id, component) for every vertex of ``edges`` (src long, dst long); component is its smallest vertex.

    Self-loops and repeated edges are harmless; rows with a null end are left out;
    no edges give no rows.
    """
    clean = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).dropna()
    forest = materialize(clean.mapInArrow(_contract, "src long, dst long"), "forest")
    if forest.count() <= single_task_edges:
        done = forest.coalesce(1).mapInArrow(_contract, "src long, dst long")
        return materialize(done.select(F.col("src").alias("id"), F.col("dst").alias("component")), "components")
    stars = _stars(materialize(forest.where("src <> dst").distinct(), "edges"))
    roots = stars.select(F.col("dst").alias("id")).distinct().select("id", F.col("id").alias("component"))
    found = stars.select(F.col("src").alias("id"), F.col("dst").alias("component")).unionByName(roots)
    alone = clean.where("src = dst").select(F.col("src").alias("id")).distinct().join(found, "id", "left_anti")
    return materialize(found.unionByName(alone.select("id", F.col("id").alias("component"))), "components")
