"""Shards of near equal bytes by a k-d tree over the metadata, with Spark expressions only.

Points are groups of equal texts, weighed by their bytes, so that copies share a shard;
a group of more than a PIECES-th of a shard is dealt by id into pieces, of which there
are at most PIECES a shard in all, a table of bounded size. A point's coordinates are
those of the smallest id in it: each metadata column by the place that a hash gives its
value, and the logarithm of a text's bytes, all scaled to 0..1.

All nodes of a level are split at once. The widest dimension of a node is found by one
grouping; then its points are dealt by ranges of (coordinate, digest, piece), the bytes
of each range are summed, and only the range that holds the weighted median is sorted
to find it. A node of n leaves is split n // 2 : n - n // 2, and is a leaf at one, when
its bytes have come down to those of a shard. Levels grow with the logarithm of the
shards; what is broadcast is a row a node and range.

Defined results: a null text has no bytes and weighs its 8; null metadata is a value of
its own; rows that share an id and a text stay together; slots follow the id (null ids
first), ties among equal rows in no order; fewer points than shards leave shards empty;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.llm import common
from skeinwork.operators import network

#: Bytes that a row has besides its text; pieces that a shard's bytes make at most.
ROW_BYTES, PIECES = 8, 64
KEYS = ("x", "digest", "piece")


def place(value: Column) -> Column:
    """A metadata value's place in 0..1."""
    return F.shiftrightunsigned(F.xxhash64(value.cast("string")), 11) / float(1 << 53)


def sized(df: DataFrame, id_col: str, text_col: str, dims: Sequence[str]) -> DataFrame:
    """(id, size, crc, digest, d0, d1, ...): what is needed of each row; texts are read once."""
    docs = common.only(df, id=id_col, text=text_col, **{f"m{k}": c for k, c in enumerate(dims)})
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + ROW_BYTES).cast("long")
    return common.saved(docs.select("id", size.alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("digest"), *[place(F.col(f"m{k}")).alias(f"d{k}") for k in range(len(dims))]), "sizes")


def points(rows: DataFrame, target: float, dims: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their piece, and the points (digest, piece, weight, d0, ..., size)."""
    large = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where((F.col("bytes") > target / PIECES) & (F.col("n") > 1))
    pieces = F.ceil(F.col("bytes") / F.lit(target / PIECES)).cast("int")
    dealt = rows.join(F.broadcast(large.select("digest", pieces.alias("pieces"))), "digest", "left")
    dealt = dealt.withColumn("piece", F.coalesce(F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"), F.lit(0))).drop("pieces")
    own = F.min(F.struct("id", *[f"d{k}" for k in range(dims)], "size"))
    found = dealt.groupBy("digest", "piece").agg(F.sum("size").alias("weight"), own.alias("own"))
    return dealt, found.select("digest", "piece", "weight", *[f"own.d{k}" for k in range(dims)], F.log2("own.size").alias(f"d{dims}"))


def split(state: DataFrame, dims: int) -> DataFrame:
    """The points one level further down: (first, leaves) of their node become those of the side they go to."""
    axes = [f"d{k}" for k in range(dims)]
    stats = state.groupBy("first", "leaves").agg(F.sum("weight").alias("total"), *[(F.max(d) - F.min(d)).alias(d) for d in axes])
    widest = F.array_position(F.array(*axes), F.greatest(*axes))
    nodes = stats.select("first", F.floor(F.col("leaves") / 2).cast("int").alias("left"), widest.alias("widest"), (F.col("total") * F.floor(F.col("leaves") / 2) / F.col("leaves")).alias("aim"))
    keyed = state.join(F.broadcast(nodes), "first").withColumn("x", F.element_at(F.array(*axes), F.col("widest").cast("int"))).drop("widest")
    dealt = common.saved(keyed.repartitionByRange("first", *KEYS).withColumn("part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("first", "part").agg(F.sum("weight").alias("own"))
    ahead = F.coalesce(F.sum("own").over(Window.partitionBy("first").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.join(F.broadcast(sums.withColumn("ahead", ahead)), ["first", "part"])
    whole = (F.col("ahead") + F.col("own") <= F.col("aim")) | (F.col("ahead") >= F.col("aim"))
    within = F.coalesce(F.sum("weight").over(Window.partitionBy("first", "part").orderBy(*KEYS).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A point goes to the side that has its middle.
    sides = placed.where(whole).withColumn("low", F.col("ahead") < F.col("aim")).unionByName(placed.where(~whole).withColumn("low", F.col("ahead") + within + F.col("weight") / 2 < F.col("aim")))
    first = F.when(F.col("low"), F.col("first")).otherwise(F.col("first") + F.col("left"))
    leaves = F.when(F.col("low"), F.col("left")).otherwise(F.col("leaves") - F.col("left"))
    return common.saved(sides.select("digest", "piece", "weight", *axes, first.cast("int").alias("first"), leaves.cast("int").alias("leaves")), "nodes")


def leaves(found: DataFrame, shards: int, dims: int) -> DataFrame:
    """(digest, piece, shard): points by the leaf they come to."""
    axes = [f"d{k}" for k in range(dims + 1)]
    ends = found.agg(F.min(axes[-1]).alias("lo"), F.max(axes[-1]).alias("hi")).first()
    scaled = (F.col(axes[-1]) - F.lit(ends.lo)) / F.lit(ends.hi - ends.lo) if ends.lo is not None and ends.hi > ends.lo else F.lit(0.0)
    state = common.saved(found.withColumns({axes[-1]: scaled, "first": F.lit(0), "leaves": F.lit(shards)}), "nodes")
    done = []
    for _ in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        done.append(state.where("leaves = 1"))
        state = split(state.where("leaves > 1"), len(axes))
    for more in done:
        state = state.unionByName(more)
    return state.select("digest", "piece", F.col("first").alias("shard"))


def kd_shards(df: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", dims: Sequence[str] = ("lang", "source")) -> DataFrame:
    """(id, size, crc, digest, shard, slot): every row with its shard; as many shards as given, or as target_bytes makes."""
    rows = sized(df, id_col, text_col, dims)
    total = rows.agg(F.sum("size")).first()[0] or 0
    shards = shards or max(1, math.ceil(total / target_bytes))
    dealt, found = points(rows, max(total / shards, 1.0), len(dims))
    found = common.saved(found, "points")
    placed = dealt.select("id", "size", "crc", "digest", "piece").join(leaves(found, shards, len(dims)), ["digest", "piece"])
    counted = network.numbered(placed.drop("piece"), "slot", "shard", "id", "digest")
    starts = counted.groupBy("shard").agg(F.min("slot").alias("start"))
    return counted.join(F.broadcast(starts), "shard").select("id", "size", "crc", "digest", "shard", (F.col("slot") - F.col("start")).alias("slot"))
