"""Node dictionaries, edges, degrees, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The spelling of node ids.
GROUP_ID, ENTITY_ID, ITEM_ID = "FG_%03d", "STR_%04d", "PYO_%02d"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a session on one machine gets a folder of that machine, and a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="steps-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def saved(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a step into the shared folder and read it from there: its lineage ends, and lost executors cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, order: Sequence[Column | str], by: Sequence[str] = (), sums: dict[str, Column] | None = None, mins: dict[str, Column] | None = None) -> DataFrame:
    """df with, by name, the sum (0 at first) or the least (null at first) of an expression over all earlier rows of the same group, in the order of keys.

    Rows are dealt by ranges of group and keys, so that a group of any size has many
    tasks. What meets elsewhere is a row a range of those groups that have several: what
    is before each range is broadcast, and a window within the range does the rest. Rows
    with equal keys are in no order of their own.
    """
    by, sums, mins = list(by), sums or {}, mins or {}
    dealt = saved(df.withColumns({f"__{n}": e for n, e in (sums | mins).items()}).repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()))
    total = lambda n: (F.sum if n in sums else F.min)(f"__{n}")
    several = dealt.groupBy(*by, "__part").agg(*[total(n).alias(f"__{n}") for n in sums | mins]).withColumn("__ranges", F.count("*").over(Window.partitionBy(*by))).where("__ranges > 1")
    earlier = lambda *group: Window.partitionBy(*group).rowsBetween(Window.unboundedPreceding, -1)
    ahead = several.select(*by, "__part", *[total(n).over(earlier(*by).orderBy("__part")).alias(f"__ahead_{n}") for n in sums | mins])
    both = dealt.join(F.broadcast(ahead), [*by, "__part"], "left")
    within = earlier(*by, "__part").orderBy(*order)
    zero = {n: F.coalesce(f"__ahead_{n}", F.lit(0)) + F.coalesce(total(n).over(within), F.lit(0)) for n in sums}
    out = both.withColumns(zero | {n: F.least(f"__ahead_{n}", total(n).over(within)) for n in mins})
    return out.drop("__part", *[f"__{n}" for n in sums | mins], *[f"__ahead_{n}" for n in sums | mins])


def item_index(lookup: DataFrame) -> DataFrame:
    """(item, matrix_index, node_id): validated items in order. There are as many rows as items."""
    index = F.row_number().over(Window.orderBy("item")).cast("long")
    items = lookup.select(F.col("pyov").alias("item")).distinct().select("item", index.alias("matrix_index"))
    return items.withColumn("node_id", F.format_string(ITEM_ID, "matrix_index"))


def group_nodes(groups: DataFrame) -> DataFrame:
    return groups.withColumns({"agent_id": F.format_string(GROUP_ID, "group_id"), "has_production": F.col("n_validated_groups") > 0, "has_utilization": F.col("n_usable_items") > 0})


def numbered(df: DataFrame, index: str, *keys: str, stable: bool = False) -> DataFrame:
    """df with a contiguous 1-based index in the order of its keys. A df that reads a saved table only is stable, and is not saved first.

    Rows are dealt by ranges of the keys; only the number of rows of each range meets in
    one place, so numbering does not pull the rows into one task.
    """
    dealt = saved((df if stable else saved(df)).repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()))
    before = dealt.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    return dealt.join(F.broadcast(before.select("__part", "__before")), "__part").withColumn(index, (within + F.col("__before")).cast("long")).drop("__part", "__before")


def first_seen(rows: DataFrame, key: str, place: str) -> DataFrame:
    """(key, place): the least place of each key."""
    return rows.groupBy(key).agg(F.min(place).alias(place))


def layer(agents: DataFrame, agent: str, items: str, index: DataFrame) -> DataFrame:
    """(agent, node_id): members of a set column that the index knows, without duplicates."""
    pairs = agents.select(F.col(agent).alias("agent"), F.explode(items).alias("item"))
    return pairs.join(index.select("item", "node_id"), "item").select("agent", "node_id").distinct()


def typed_edges(production: DataFrame, utilization: DataFrame, agent_type: str) -> DataFrame:
    """Agents point at what they make; items point at who uses them."""
    kinds = [F.lit(agent_type), F.lit("PYO")]
    out = production.select(F.col("agent").alias("source"), F.col("node_id").alias("target"), kinds[0].alias("source_type"), kinds[1].alias("target_type"), F.lit("production").alias("edge_type"))
    back = utilization.select(F.col("node_id").alias("source"), F.col("agent").alias("target"), kinds[1].alias("source_type"), kinds[0].alias("target_type"), F.lit("utilization").alias("edge_type"))
    return out.unionByName(back)


def edges_of(edges: DataFrame, edge_type: str) -> DataFrame:
    """(agent, item) of one layer, whichever way its edges point."""
    own = edges.where(F.col("edge_type") == edge_type)
    return own.select(F.col("source").alias("agent"), F.col("target").alias("item")) if edge_type == "production" else own.select(F.col("target").alias("agent"), F.col("source").alias("item"))


def inactive(nodes: DataFrame, made: DataFrame, used: DataFrame) -> DataFrame:
    """(node_id, makes, used): items of the dictionary that production or utilization lacks."""
    seen = made.select(F.col("item").alias("node_id"), F.lit(True).alias("makes"), F.lit(False).alias("used")).unionByName(used.select(F.col("item").alias("node_id"), F.lit(False).alias("makes"), F.lit(True).alias("used")))
    found = nodes.join(seen.groupBy("node_id").agg(F.max("makes").alias("makes"), F.max("used").alias("used")), "node_id", "left").na.fill(False, ["makes", "used"])
    return found.where("not (makes and used)")


def degrees(edges: DataFrame, side: str, nodes: DataFrame | None = None, node: str = "node", weight: Column | None = None) -> DataFrame:
    """(node, degree); with a dictionary of nodes, those without an edge have 0."""
    counted = edges.groupBy(F.col(side).alias("node")).agg((F.count("*") if weight is None else F.sum(weight)).cast("long").alias("degree"))
    if nodes is None:
        return counted
    return nodes.select(F.col(node).alias("node")).join(counted, "node", "left").select("node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degree_summary(df: DataFrame, *by: str) -> DataFrame:
    """Eleven statistics of a degree column; quartiles interpolate between neighbours."""
    d = F.col("degree")
    out = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.min(d).alias("min"), F.percentile(d, F.lit(0.25)).alias("q25"), F.percentile(d, F.lit(0.5)).alias("median"), F.percentile(d, F.lit(0.75)).alias("q75"),
        F.round(F.avg(d), 6).alias("mean"), F.max(d).alias("max"), F.round(F.stddev_samp(d), 6).alias("sd"), F.count_if(d == 0).alias("zeros"), F.count_if(d > 0).alias("nonzero"),
    )
    return out.withColumn("proportion_nonzero", F.round(F.col("nonzero") / F.col("n"), 6))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over links (a, b), either way.

    Each round takes the least label among a node's neighbours and then the label of
    that label, so that rounds grow with the logarithm of a path's length.
    """
    both = saved(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        step = saved(labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("component")))
        up = step.select(F.col("node").alias("component"), F.col("component").alias("up"))
        labels = saved(step.join(up, "component", "left").select("node", "old", F.least("component", F.coalesce("up", "component")).alias("component")))
        if labels.where("old <> component").isEmpty():
            return labels.select("node", "component")


def component_summary(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(n_nodes, n_components, giant_size, giant_proportion); a node without a link is a component of its own."""
    labels = nodes.select("node").join(components(links), "node", "left").select(F.coalesce("component", "node").alias("component"))
    sizes = labels.groupBy("component").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("n_nodes"), F.count("*").alias("n_components"), F.max("n").alias("giant_size")).withColumn("giant_proportion", F.round(F.col("giant_size") / F.col("n_nodes"), 6))
