"""Exact duplicates, combined in three steps that all compare the full content.

A group is keyed by (digest, content). Equal texts of a partition meet first (the
map side of the aggregate), then within a salt of their digest, then the winners of
all salts meet. A text that a third of all rows share thus reaches the last step as
SALTS rows at most. What goes back to the rows is (digest, winner, size); only where
two texts share a digest do the rows carry their text again.

Defined results: null text is empty and equals other empty texts; the largest id of
equal texts stays, null ids lose to any other (a group of null ids only keeps none by
id: keep is null and every row stays); repeated rows with the winning id all stay;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm import common

SALTS = 16


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def row_key(id_: Column, text: Column) -> Column:
    """Id and digest of a row's text, which no two different rows share; a null id and a null text have keys too."""
    return F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), F.sha2(F.coalesce(text, F.lit("")), 256))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, normalise: Callable[[Column], Column] | None = None, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """(id, row, digest, keep, size, kept): one row a document; keep is the id that stays of its group of size rows; row is its row_key."""
    docs = common.only(df, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    row = row_key(F.col("id"), F.col("text"))
    if normalise:
        docs = docs.withColumn("text", normalise(F.col("text")))
    docs = docs.withColumn("row", row).withColumn("digest", digest(F.col("text")))
    salted = docs.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    part = salted.groupBy("digest", "salt", "text").agg(F.max("id").alias("keep"), F.count("*").alias("size"))
    whole = part.groupBy("digest", "text").agg(F.max("keep").alias("keep"), F.sum("size").alias("size"))
    winners = common.saved(whole.groupBy("digest").agg(F.count("*").alias("texts"), F.max("keep").alias("keep"), F.max("size").alias("size")), "winners")
    out = docs.select("id", "row", "digest").join(winners.where("texts = 1").drop("texts"), "digest")
    clashes = winners.where("texts > 1").select("digest")
    if not clashes.isEmpty():
        out = out.unionByName(docs.join(clashes, "digest", "left_semi").join(whole, ["digest", "text"]).select("id", "row", "digest", "keep", "size"))
    return out.select("id", "row", "digest", "keep", "size", F.coalesce(F.col("id") == F.col("keep"), F.col("keep").isNull()).alias("kept"))
