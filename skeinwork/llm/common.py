"""What the operators share: saved tables, batch sizes, joins that move few rows, and links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.operators import network
from skeinwork.operators.network import saved  # noqa: F401

#: Bits of the table that tells which rows a join has to move: 2 ** (FLAG_BITS - 6) rows of 64 bits at most.
FLAG_BITS = 24


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Names for columns of our own that df does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        out.append(stem)
    return out


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Bound what a Python worker gets at once, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def only(df: DataFrame, **named: str) -> DataFrame:
    """The columns an operator needs under its own names, so that no other column can clash."""
    return df.select([df[old].alias(new) for new, old in named.items()])


def _marked(df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, str]:
    """df with a column, and its name: false where a row's key is certainly not among keys. What is broadcast is a table of fixed size."""
    p, cell, bits, hit = unused(df, "p", "cell", "bits", "hit")

    def place(c: Column, kind: str) -> Column:
        return F.pmod(F.xxhash64(c if kind in ("string", "binary") else c.cast("long")), F.lit(1 << FLAG_BITS))

    kinds = dict(df.dtypes)[key], keys.dtypes[0][1]
    table = keys.select(place(keys[0], kinds[1]).alias("p")).groupBy(F.shiftright("p", 6).alias(cell)).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias(bits))
    placed = df.withColumn(p, place(df[key], kinds[0])).withColumn(cell, F.shiftright(p, 6))
    found = F.coalesce(F.expr(f"(shiftrightunsigned({bits}, cast({p} % 64 as int)) & 1) = 1"), F.lit(False))
    return placed.join(F.broadcast(table), cell, "left").withColumn(hit, found), hit


def likely(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of df whose key may be in the only column of keys: all that are, and few others. No row is moved for it."""
    marked, hit = _marked(df, key, keys)
    return marked.where(F.col(hit)).select(df.columns)


def among(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of df whose key is in the only column of keys (distinct): few others are moved for it."""
    return likely(df, key, keys).join(keys.select(keys[0].alias(key)), key, "left_semi").select(df.columns)


def without(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of df whose key is not in the only column of keys: rows that surely stay are not moved."""
    marked, hit = _marked(df, key, keys)
    doubtful = marked.where(F.col(hit)).select(df.columns).join(keys.select(keys[0].alias(key)), key, "left_anti")
    return marked.where(~F.col(hit)).select(df.columns).unionByName(doubtful.select(df.columns))


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of the links (a, b): (node, label). A node with many links is dealt out by the skewed join."""
    return network.components(edges.where("a <> b")).withColumnRenamed("component", "label")


def joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """The labels (node, label) after further links (a, b)."""
    if more.isEmpty():
        return labels
    return components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more.select("a", "b")))


def before(lengths: Column, chunk: int = 256, combine: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """What stands before each element of an array of integers, 0 or more, combined: their sum, or whatever combine makes of two. Arrays that grow stay about this short, so that work is linear but for very long arrays."""

    def short(xs: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, start, lambda acc, x: F.struct(combine(acc.at, x).alias("at"), F.concat(acc.out, F.array(acc.at)).alias("out")), lambda acc: acc.out)

    def long(xs: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / chunk).cast("int")), lambda k: F.slice(xs, k * chunk + 1, chunk))
        heads = short(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, b: combine(a, b))))
        return F.flatten(F.zip_with(chunks, heads, lambda c, head: F.transform(short(c), lambda x: combine(x, head))))

    return bound(lengths, lambda xs: F.when(F.size(xs) <= chunk, short(xs)).otherwise(long(xs)))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)
