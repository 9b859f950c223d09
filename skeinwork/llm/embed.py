"""Near-duplicate vectors by lattice hashing.

Each of TABLES random projections takes a unit vector to eight dimensions, scaled so
that vectors at the threshold land within reach of one another; the point is decoded
to the nearest point of the E8 lattice, its cell. A class of equal vectors is filed
under its own cell of each table and looks into PROBES more cells: the lattice
neighbours nearest to its point. Pairs that meet are confirmed by their cosine in
double precision. Cells are keyed by label too, so no pair of different labels meets.

Defined results: a vector that is null, zero or holds null or non-finite components,
or whose label is null, links with nothing, not even its copies; vectors of different
length never meet; repeated ids: rows count one by one as links, and share the smallest
id; extra columns are ignored. Equal vectors of a label are one class, so that copies
are never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm import common, ragged

LEAST, TABLES, PROBES, CELL = 0.98, 6, 12, 0.4
#: Classes of a label and cell that meet those who look into it at one key; a larger cell is dealt out over several.
BLOCK = 256


def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    pairs = [(i, j) for i in range(8) for j in range(i)]
    whole = np.zeros((4 * len(pairs), 8))
    for k, (i, j) in enumerate(pairs):
        for m in range(4):
            whole[4 * k + m, i], whole[4 * k + m, j] = 1 - 2 * (m & 1), 1 - (m & 2)
    signs = 1 - 2 * ((np.arange(256)[:, None] >> np.arange(8)) & 1)
    return np.concatenate([whole, signs[(signs == -1).sum(axis=1) % 2 == 0] / 2])


def _d8(x: np.ndarray) -> np.ndarray:
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8: of D8 and its shift by one half, whichever is nearer."""
    whole, half = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1))[:, None], whole, half)


def cells(unit: np.ndarray, tables: int, probes: int, cell: float, seed: int = 7) -> np.ndarray:
    """Cell keys (vector, table, 1 + probes): its own cell first."""
    dim, shell = unit.shape[1], neighbours()
    out = np.empty((len(unit), tables, 1 + probes), dtype=np.int64)
    rng = np.random.default_rng([seed, dim])
    for t in range(tables):
        direction = rng.standard_normal((dim, 8))
        if dim >= 8:
            direction = np.linalg.qr(direction)[0] * np.sqrt(dim / 8)
        point = unit @ direction / cell
        own = decode(point)
        near = np.argsort(-((point - own) @ shell.T), axis=1, kind="stable")[:, :probes]
        lattice = np.concatenate([own[:, None, :], own[:, None, :] + shell[near]], axis=1)
        key = np.full(lattice.shape[:2], np.uint64(t + 1))
        for k in range(8):
            key = ragged.mix(key ^ np.rint(2 * lattice[:, :, k]).astype(np.int64).view(np.uint64))
        out[:, t] = key.view(np.int64)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64) for x in column.to_numpy(zero_copy_only=False)])


def filed(classes: DataFrame, tables: int, probes: int, cell: float) -> DataFrame:
    """(class, cells): own cell and probed cells of each table, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column(1)])
            for dim in np.unique(sizes):
                own = batch.filter(pa.array(sizes == dim))
                rows = _matrix(own.column(1))
                keys = cells(rows / np.linalg.norm(rows / np.abs(rows).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(rows).max(axis=1, keepdims=True), tables, probes, cell)
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(list(keys.reshape(len(keys), -1)), pa.list_(pa.int64()))], ["class", "cells"])

    return classes.select("class", "vector").mapInArrow(run, "class long, cells array<long>")


def linked_pairs(classes: DataFrame, least: float, tables: int, probes: int, cell: float) -> DataFrame:
    """Pairs of classes (a, b), a < b, that met in a cell and whose cosine is least or more."""
    seen = common.saved(filed(classes, tables, probes, cell).join(classes.select("class", "label"), "class"), "cells").select("label", "class", F.posexplode("cells"))
    key = F.xxhash64("label", "col")
    looking = seen.select(key.alias("key"), F.col("class").alias("p"))
    lying = seen.where(F.col("pos") % (1 + probes) == 0).select(key.alias("key"), F.col("class").alias("q"))
    crowded = common.saved(lying.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "crowded")
    if not crowded.isEmpty():
        blocks = F.coalesce("blocks", F.lit(1))
        dealt = lambda block: [F.xxhash64("key", block).alias("key")]
        lying = lying.join(crowded, "key", "left").select(*dealt(F.pmod(F.xxhash64("q"), blocks).cast("int")), "q")
        looking = looking.join(crowded, "key", "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).select(*dealt(F.col("block")), "p")
    met = looking.join(lying, "key").where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keep = np.zeros(batch.num_rows, dtype=bool)
            sizes = np.array([len(x) for x in batch.column(2)])
            same = sizes == np.array([len(x) for x in batch.column(3)])
            for dim in np.unique(sizes[same]):
                rows = np.flatnonzero(same & (sizes == dim))
                x, y = (_matrix(batch.column(k).take(pa.array(rows))) for k in (2, 3))
                x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
                keep[rows] = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1)) >= least
            yield batch.select([0, 1]).filter(pa.array(keep))

    left = classes.select(F.col("class").alias("a"), F.col("label").alias("la"), F.col("vector").alias("x"))
    right = classes.select(F.col("class").alias("b"), F.col("label").alias("lb"), F.col("vector").alias("y"))
    return met.join(left, "a").join(right, "b").where("la = lb").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, least: float = LEAST, tables: int = TABLES, probes: int = PROBES, cell: float = CELL) -> DataFrame:
    """(id, n_links, component, kept): one row a vector."""
    common.small_batches(df.sparkSession)
    rows = common.only(df, id=id_col, vector=vector_col, label=label_col).withColumn("id", F.col("id").cast("long"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    able = F.coalesce(F.col("label").isNotNull() & F.col("id").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("able", able)
    groups = common.saved(rows.where("able").groupBy("label", "vector").agg(F.min("id").alias("class"), F.count("*").alias("size")), "classes")
    links = common.saved(linked_pairs(groups, least, tables, probes, cell).distinct(), "links")
    sizes = groups.groupBy("class").agg(F.sum("size").alias("size"))
    both = links.union(links.select("b", "a"))
    more = both.join(sizes.select(F.col("class").alias("b"), "size"), "b").groupBy(F.col("a").alias("class")).agg(F.sum("size").alias("more"))
    labels = common.components(links).select(F.col("node").alias("class"), F.col("label").alias("component"))
    found = groups.join(more, "class", "left").join(labels, "class", "left").select(F.col("label"), "vector", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("component"))
    out = rows.where("able").join(found, ["label", "vector"]).select("id", "n_links", "component")
    alone = rows.where("not able").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return out.unionByName(alone).select("id", "n_links", "component", F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
