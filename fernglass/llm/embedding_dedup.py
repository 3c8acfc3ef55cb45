"""Embedding near-duplicates by int8 tile products with per-vector error bounds.

Vectors of equal label link where their cosine, in double precision, reaches the
threshold. A unit vector x is kept as int8 codes q and a scale s, with the exact norm
of its error e = x - q*s. Then |x.y - (q*s).(r*t)| <= |e||r*t| + |q*s||f| + |e||f|,
so a tile's integer products tell which pairs surely link, which surely don't, and
which may; only the last are computed again in full precision.

1. *Classes.* Equal vectors of a label become one class with a number of members.
2. *Cells.* A label's classes are spread by hash over cells of about ``CELL_ROWS``.
3. *Tiles.* Any two cells of a label, and each with itself, meet in one task. A tile
   returns links per class and a spanning forest, no pairs.

A label with a third of all rows is many cells, so many tiles. Codes are int8;
products of codes are integers below 2**24 within a block of 1,024 dimensions, so
single-precision products of them are exact.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite
component link with nothing, nor do those with a null label; vectors of unlike length
don't link. Rows that repeat a vec_id count as one vector and give one row; of those
that can link, the one with the least label, then hashes of its components, counts, so
a row that can't link takes nothing from another. A null vec_id gives a row without links and with a null
component for each row. Other columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._hot import join_by_count
from ._store import dispose, materialize, trimmed
from .components import connected_components, min_labels

#: Classes of one cell.
CELL_ROWS = 8192
#: Groups of several cells that a broadcast may hold (12 bytes each); beyond, the join shuffles.
BROADCAST_GROUPS = 1_000_000
#: Rows of a tile's block of products.
BLOCK = 256
#: Dimensions whose products are summed at once in single precision.
EXACT_DIMS = 1024
#: The side of a cell that meets itself.
SELF = 2
#: Rounding of double-precision products, far above it.
ROUND = 1e-9


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision, without overflow."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class Quantised:
    """Unit vectors with int8 codes, scales and error norms."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw.astype(np.float64)
        self.x = unit(self.raw)
        self.scale = np.abs(self.x).max(axis=1) / 127
        self.q = np.rint(self.x / self.scale[:, None]).astype(np.int8)
        kept = self.q * self.scale[:, None]
        self.error = np.sqrt(((self.x - kept) ** 2).sum(axis=1)) + ROUND
        self.norm = np.sqrt((kept**2).sum(axis=1)) + ROUND

    def __len__(self) -> int:
        return len(self.x)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 codes."""
    out = np.zeros((len(a), len(b)), np.float64 if a.shape[1] > EXACT_DIMS else np.float32)
    for d in range(0, a.shape[1], EXACT_DIMS):
        out += a[:, d : d + EXACT_DIMS].astype(np.float32) @ b[:, d : d + EXACT_DIMS].astype(np.float32).T
    return out


def links(a: Quantised, b: Quantised, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of a, rows of b) that link, block by block; within one cell each pair once."""
    for lo in range(0, len(a), BLOCK):
        hi = min(len(a), lo + BLOCK)
        first = lo if same else 0
        near = products(a.q[lo:hi], b.q[first:]).astype(np.float64) * a.scale[lo:hi, None] * b.scale[None, first:]
        slack = a.error[lo:hi, None] * (b.norm + b.error)[None, first:] + a.norm[lo:hi, None] * b.error[None, first:] + ROUND
        i, j = np.nonzero(near + slack >= threshold)
        sure = near[i, j] - slack[i, j] >= threshold
        i, j = i + lo, j + first
        if same:
            once = j > i
            i, j, sure = i[once], j[once], sure[once]
        open_ = np.flatnonzero(~sure)
        ok = sure.copy()
        for k in range(0, len(open_), 1 << 14):
            at = open_[k : k + (1 << 14)]
            ok[at] = cosine(a.raw[i[at]], b.raw[j[at]]) >= threshold
        yield i[ok], j[ok]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows in double precision."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def _matrix(values: pa.Array) -> np.ndarray:
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1) if len(values) else np.zeros((0, 1))


def _tile(threshold: float):
    def done(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        side = t.column("side").to_numpy()
        v = _matrix(t.column("v").combine_chunks())
        rep, mult = t.column("rep").to_numpy(), t.column("mult").to_numpy()
        same = bool((side == SELF).any())
        where = [np.flatnonzero(side == s) for s in ((SELF, SELF) if same else (0, 1))]
        if not len(where[0]) or not len(where[1]):  # the other cell is empty
            where = [where[0][:0], where[1][:0]]
        n, label = np.zeros(len(rep), np.int64), np.arange(len(rep))
        a = Quantised(v[where[0]]) if len(where[0]) else None
        b = a if same or a is None else Quantised(v[where[1]])
        for i, j in links(a, b, threshold, same) if a is not None else ():
            i, j = where[0][i], where[1][j]
            np.add.at(n, i, mult[j])
            np.add.at(n, j, mult[i])
            # joined to what is known so far: a forest, never a list of all pairs
            label = min_labels(len(rep), np.concatenate([np.arange(len(rep)), i]), np.concatenate([label, j]))
        some = np.flatnonzero((n > 0) | (label != np.arange(len(rep))))
        return pa.record_batch([pa.array(rep[some]), pa.array(n[some]), pa.array(rep[label[some]])], names=["rep", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            tile = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist(), len(tile)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if held and tile[lo] != now:
                    yield done(held)
                    held = []
                now = tile[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield done(held)

    return trimmed(run)


def _clean(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.when(fine, F.col(vector_col)).alias("v"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cell_rows: int = CELL_ROWS, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold is above 0 and at most 1")
    rows = _clean(vectors, id_col, vector_col, label_col)
    hashes = (F.xxhash64("v"), F.xxhash64(F.lit(1), "v"))
    idle = F.col("label").isNull() | F.col("v").isNull()
    members = rows.where("vec_id is not null").select("vec_id", F.struct(idle.alias("idle"), "label", F.when(F.col("v").isNotNull(), hashes[0]).alias("h1"), F.when(F.col("v").isNotNull(), hashes[1]).alias("h2"), F.size("v").alias("dims")).alias("s"))
    members = materialize(members.groupBy("vec_id").agg(F.min("s").alias("s")).select("vec_id", "s.*"), "members")
    linkable = members.where("not idle")
    keys = ["label", "h1", "h2", "dims"]
    classes = materialize(linkable.groupBy(*keys).agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")), "classes")
    own = rows.select(F.col("vec_id").alias("rep"), "label", "v", hashes[0].alias("h1"), hashes[1].alias("h2")).where("v is not null")
    reps = own.join(classes, ["rep", "label", "h1", "h2"]).dropDuplicates(["rep"])
    reps = materialize(reps.select("rep", "mult", "v", F.xxhash64("label", "dims").alias("group")), "vectors")
    tiles = _tiles_of(reps, cell_rows, broadcast_groups)
    linked = materialize(tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tile(threshold), "rep long, links long, root long"), "linked")
    dispose(reps)

    counts = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    forest = connected_components(linked.where("rep <> root").select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    answers = classes.join(counts, "rep", "left").join(forest.withColumnRenamed("id", "rep"), "rep", "left")
    answers = answers.select(*keys, "mult", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    found = join_by_count(linkable, answers, keys, "mult", linkable.count()).select("vec_id", "n_links", "component_id")
    alone = members.where("idle").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    nameless = rows.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = found.unionByName(alone).unionByName(nameless)
    return every.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _tiles_of(reps: DataFrame, cell_rows: int, broadcast_groups: int) -> DataFrame:
    """tile, side, rep, mult, v: the vectors of both cells of every pair of cells of a group."""
    sizes = reps.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows)
    parts = materialize(sizes.select("group", F.ceil(F.col("n") / cell_rows).cast("int").alias("parts")), "parts")
    few = parts.count() <= broadcast_groups  # a group of several cells has more than cell_rows vectors
    placed = reps.join(F.broadcast(parts) if few else parts, "group", "left")
    large = placed.where("parts is not null").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    cells = parts.select("group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    meets = cells.alias("a").join(cells.alias("b"), "group").where("b.part >= a.part").select("group", F.col("a.part").alias("p1"), F.col("b.part").alias("p2"))
    tile = F.xxhash64("group", "p1", "p2")
    left = meets.select("group", F.col("p1").alias("part"), tile.alias("tile"), F.when(F.col("p1") == F.col("p2"), F.lit(SELF)).otherwise(F.lit(0)).alias("side"))
    right = meets.where("p1 <> p2").select("group", F.col("p2").alias("part"), tile.alias("tile"), F.lit(1).alias("side"))
    whole = placed.where("parts is null").select(F.xxhash64("group").alias("tile"), F.lit(SELF).alias("side"), "rep", "mult", "v")
    return whole.unionByName(large.join(left.unionByName(right), ["group", "part"]).select("tile", "side", "rep", "mult", "v"))
