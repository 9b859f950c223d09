"""Tables of a folder, and the network they stand for.

Customers are the entities, brands the items, part sizes the receptor groups. Each
function reads only the columns it needs, so filters and columns reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def records(spark: SparkSession, folder: str, order: bool = False) -> DataFrame:
    """(strain, q, rf, tax, brand, sz): one row a line item; with order also its order and line (o, l). part is broadcast only if Spark finds it small."""
    items = read(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_tax", *(["l_linenumber"] if order else []))
    orders = read(spark, folder, "orders").select("o_orderkey", "o_custkey")
    part = read(spark, folder, "part").select("p_partkey", F.substring("p_brand", 7, 9).cast("int").alias("brand"), F.col("p_size").alias("sz"))
    joined = items.join(part, items.l_partkey == part.p_partkey).join(orders, items.l_orderkey == orders.o_orderkey)
    return joined.select(F.col("o_custkey").alias("strain"), F.col("l_quantity").alias("q"), F.col("l_returnflag").alias("rf"), F.col("l_tax").alias("tax"), "brand", "sz", *([F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l")] if order else []))


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """(strain, kind, grp): the facts of made and taken from one reading of the records."""
    made = F.when(F.col("rf") == "R", F.struct(F.lit("made").alias("kind"), F.when(F.col("q") >= 48, F.col("brand")).otherwise(0).alias("grp")))
    taken = F.when(F.col("tax") >= 0.075, F.struct(F.lit("taken").alias("kind"), F.col("sz").alias("grp")))
    rows = records(spark, folder).where("rf = 'R' or tax >= 0.075").select("strain", F.explode(F.filter(F.array(made, taken), lambda x: x.isNotNull())).alias("x"))
    return rows.select("strain", "x.kind", "x.grp")


def fitting_facts(spark: SparkSession, folder: str, lookup: DataFrame) -> DataFrame:
    """(strain, kind, grp): those of facts() that the lookup (pyov, rec) has, and so all that groups rest on.

    Parts meet the lookup's few values first, so that only line items which count meet
    part and orders: about a tenth of the records that facts() takes there.
    """
    part = read(spark, folder, "part").select("p_partkey", F.substring("p_brand", 7, 9).cast("int").alias("brand"), F.col("p_size").alias("sz"))
    known = lookup.select(F.col("pyov").alias("brand"), F.lit(True).alias("makes")).distinct()
    fits = lookup.select(F.col("rec").alias("sz"), F.lit(True).alias("takes")).distinct()
    part = part.join(F.broadcast(known), "brand", "left").join(F.broadcast(fits), "sz", "left").where("makes or takes")
    marks = {"r": (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 48), "t": F.col("l_tax") >= 0.075}
    items = read(spark, folder, "lineitem").select("l_orderkey", "l_partkey", *[c.alias(n) for n, c in marks.items()]).where("r or t")
    made = F.when(F.col("r") & F.col("makes"), F.struct(F.lit("made").alias("kind"), F.col("brand").alias("grp")))
    taken = F.when(F.col("t") & F.col("takes"), F.struct(F.lit("taken").alias("kind"), F.col("sz").alias("grp")))
    met = items.join(part, items.l_partkey == part.p_partkey).where("(r and makes) or (t and takes)")
    rows = met.select("l_orderkey", F.explode(F.filter(F.array(made, taken), lambda x: x.isNotNull())).alias("x")).select("l_orderkey", "x.kind", "x.grp")
    orders = read(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("strain"))
    return rows.join(orders, rows.l_orderkey == orders.o_orderkey).select("strain", "kind", "grp")


def made(spark: SparkSession, folder: str) -> DataFrame:
    """(strain, grp): what an entity makes; 0 where it was not validated."""
    return records(spark, folder).where("rf = 'R'").select("strain", F.when(F.col("q") >= 48, F.col("brand")).otherwise(0).alias("grp"))


def taken(spark: SparkSession, folder: str) -> DataFrame:
    """(strain, grp): the receptor groups of an entity."""
    return records(spark, folder).where("tax >= 0.075").select("strain", F.col("sz").alias("grp"))


def pair_lists(spark: SparkSession, folder: str) -> DataFrame:
    """(pair_id, pyov, rec): arrays of items and receptor groups that fit; a handful of rows."""
    part = read(spark, folder, "part")
    brands = part.select(F.substring("p_brand", 7, 9).cast("int").alias("b")).distinct().where("b % 10 <= 3").groupBy(F.floor(F.col("b") / 10).cast("int").alias("pair_id")).agg(F.array_sort(F.collect_set("b")).alias("pyov"))
    sizes = part.select(F.col("p_size").alias("r")).distinct().where("r <= 30").groupBy((F.col("r") % 10).alias("pair_id")).agg(F.array_sort(F.collect_set("r")).alias("rec"))
    return brands.join(sizes, "pair_id")


def wide(spark: SparkSession, folder: str) -> DataFrame:
    """(agent, item): an irregular layer."""
    return records(spark, folder).where("rf = 'R' and q >= 46").select((F.col("strain") % 97).alias("agent"), F.col("sz").alias("item")).distinct()
