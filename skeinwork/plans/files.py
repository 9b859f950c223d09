"""Queries that write files into the shared folder and read them again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.operators.network import shared_folder
from skeinwork.plans.registry import query
from skeinwork.sources import files, records

S = SparkSession


def fresh(spark: S) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query("s6_read_csv", "select c_custkey, c_name, cast(c_acctbal as double) as c_acctbal, cast(null as bigint) as missing, cast('inf' as double) as unbounded from customer")
def s6(spark: S, d: str) -> DataFrame:
    """A CSV file with a header read by a stated schema; NA and Inf come back as they were."""
    path = fresh(spark)
    df = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"), F.lit("NA").alias("missing"), F.lit("Inf").alias("unbounded"))
    files.write_csv(df, path)
    return files.read_csv(spark, path, "c_custkey bigint, c_name string, c_acctbal double, missing bigint, unbounded double")


@query("s7_read_manifest", "select replace(r_name, ' ', '_') as key, r_regionkey::varchar as from_json, r_regionkey::varchar as from_lines from region union all select 'none', '7', '7'")
def s7(spark: S, d: str) -> DataFrame:
    """The regions as parameters, from JSON and from lines of key: value whose first counts, with a default."""
    paths = [fresh(spark), fresh(spark)]
    regions = spark.read.parquet(f"{d}/region.parquet").select(F.replace("r_name", F.lit(" "), F.lit("_")).alias("r_name"), F.col("r_regionkey").cast("string").alias("k"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("r_name", "k"))))
    regions.agg(F.to_json(F.named_struct(F.lit("regions"), entries)).alias("value")).write.text(paths[0])
    lines = regions.select(F.explode(F.array(F.concat("r_name", F.lit(": "), "k"), F.lit("# none"))).alias("value"))
    lines.coalesce(1).write.text(paths[1])
    parsed, plain = (files.read_manifest(spark, p) for p in paths)
    rows = [(k, str(files.parameter(parsed, f"regions.{k}", 7)), str(plain.get(k, 7))) for k in [*parsed["regions"], "none"]]
    return spark.createDataFrame(rows, "key string, from_json string, from_lines string")


def kept(spark: S, df: DataFrame, layout: str, rows: int = 1000) -> str:
    """Where a table is kept as files of binary matrices of so many rows at most."""
    records.use(spark)
    path = fresh(spark)
    df.write.format("records").option("layout", layout).option("rows", rows).mode("overwrite").save(path)
    return path


PARTS = "select p_partkey, p_name, p_brand, p_size, p_retailprice, {b} as bounds from part"
BOUNDS = "p_size::varchar || ',' || (p_size + 1)::varchar"


def parts(spark: S, d: str) -> DataFrame:
    bounds = F.array("p_size", F.col("p_size") + 1)
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice", bounds.alias("bounds"))


@query("k1_write_hdf5", PARTS.format(b=BOUNDS))
def k1(spark: S, d: str) -> DataFrame:
    """Every field of a record as a dataset, text as padded bytes, a pair of bounds as a matrix; all of it read back."""
    path = kept(spark, parts(spark, d), "hdf5")
    return spark.read.format("records").option("layout", "hdf5").load(path).withColumn("bounds", F.array_join("bounds", ","))


@query("s2_read_hdf5", "select n_nationkey, n_name, length(n_name) as n_letters from nation union all select p_partkey, p_name, length(p_name) from part")
def s2(spark: S, d: str) -> DataFrame:
    """Two datasets of a group out of several, by ranges of their rows; the schema that is asked for tells which are read."""
    nations = kept(spark, spark.read.parquet(f"{d}/nation.parquet").withColumn("n_nationkey", F.col("n_nationkey").cast("long")), "hdf5")
    read = lambda path, schema: spark.read.format("records").option("layout", "hdf5").option("split", 1 << 16).schema(schema).load(path)
    names = read(nations, "n_nationkey bigint, n_name string").unionByName(read(kept(spark, parts(spark, d), "hdf5"), "p_partkey bigint, p_name string").toDF("n_nationkey", "n_name"))
    return names.withColumn("n_letters", F.length("n_name"))


@query("k2_write_mat", PARTS.format(b=BOUNDS))
def k2(spark: S, d: str) -> DataFrame:
    """Records as deflated structs, text as cells; all of it read back."""
    path = kept(spark, parts(spark, d), "mat")
    return spark.read.format("records").option("layout", "mat").load(path).withColumn("bounds", F.array_join("bounds", ","))


@query("s1_read_mat", "select p_brand, count(*) as n, sum(p_size) as sizes, max(p_name) as last from part group by 1")
def s1(spark: S, d: str) -> DataFrame:
    """A struct's fields as columns, grouped."""
    path = kept(spark, parts(spark, d), "mat")
    found = spark.read.format("records").option("layout", "mat").schema("p_name string, p_brand string, p_size int").load(path)
    return found.groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("sizes"), F.max("p_name").alias("last"))


@query("k3_write_table", "select n_nationkey, n_name, n_regionkey from nation")
def k3(spark: S, d: str) -> DataFrame:
    path = fresh(spark)
    files.write_table(spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey"), path)
    return spark.read.parquet(path)


@query("k6_append_lines", "select r_name as value, 2 as times from region")
def k6(spark: S, d: str) -> DataFrame:
    """A log that two steps have added to."""
    path = fresh(spark)
    for _ in range(2):
        files.append_lines(spark.read.parquet(f"{d}/region.parquet").select("r_name"), path)
    return spark.read.text(path).groupBy("value").agg(F.count("*").alias("times"))


TABLES = ("customer", "lineitem", "orders", "part")


@query("k7_provenance", " union all ".join(f"select '{t}' as input, count(*) as n_rows, (select count(*) from (describe {t})) as n_columns, (select string_agg(column_name, ',' order by column_name) from (describe {t})) as columns from {t}" for t in TABLES))
def k7(spark: S, d: str) -> DataFrame:
    """What a result was made from: each input with its rows and columns. Versions and settings go to the log with it (files.provenance)."""
    out = None
    for name in TABLES:
        df = spark.read.parquet(f"{d}/{name}.parquet")
        own = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("input"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"), F.lit(",".join(sorted(df.columns))).alias("columns"))
        out = own if out is None else out.unionByName(own)
    path = fresh(spark)
    told = spark.createDataFrame(sorted(files.provenance(spark).items()), "key string, value string")
    files.append_lines(told.select(F.concat_ws(": ", "key", "value")), path)
    return out
