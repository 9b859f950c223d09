"""The network that the driver tables stand for, as DataFrames and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions.sets import finite
from skeinwork.operators import inference, network, repertoire
from skeinwork.sources import tables

CTES = """
base as (
  select o_custkey as strain, l_quantity as q, l_returnflag as rf, l_tax as tax, cast(substr(p_brand, 7) as int) as brand, p_size as sz
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey),
syn as (select strain, case when q >= 48 then brand else 0 end as grp from base where rf = 'R'),
rec as (select strain, sz as grp from base where tax >= 0.075),
pairs as (
  select distinct cast(floor(b / 10) as int) as pair_id, b as pyov, r as rec
  from (select distinct cast(substr(p_brand, 7) as int) as b from part) cross join (select distinct p_size as r from part)
  where b % 10 <= 3 and r % 10 = cast(floor(b / 10) as int) and r <= 30),
prod as (select distinct strain, grp as p from syn where grp <> 0 and grp in (select pyov from pairs)),
util as (select distinct r.strain, pyov as p from rec r join pairs on r.grp = pairs.rec),
wide as (select distinct strain % 97 as agent, sz as item from base where rf = 'R' and q >= 46),
strains as (select distinct strain from (select strain from syn union all select strain from rec)),
rep as (
  select s.strain, coalesce(a.l, []) as pg, coalesce(b.l, []) as vg, coalesce(c.l, []) as rg, coalesce(d.l, []) as ug
  from strains s
  left join (select strain, list_sort(list(distinct grp)) as l from syn where grp <> 0 group by 1) a using (strain)
  left join (select strain, list_sort(list(p)) as l from prod group by 1) b using (strain)
  left join (select strain, list_sort(list(distinct grp)) as l from rec group by 1) c using (strain)
  left join (select strain, list_sort(list(p)) as l from util group by 1) d using (strain)),
sigs as (
  select *, len(pg) as np, len(vg) as nv, len(rg) as nr, len(ug) as nu,
    (case when len(vg) = 0 then '0' else array_to_string(vg, ',') end) || '|' || (case when len(ug) = 0 then 'none' else array_to_string(ug, ',') end) as signature from rep),
fg as (
  select row_number() over (order by signature) as group_id, signature, count(*) as strain_count, any_value(vg) as vg, any_value(ug) as ug, any_value(nv) as nv, any_value(nu) as nu
  from sigs where nv > 0 or nu > 0 group by signature),
strat as (
  select *, printf('FG_%03d', group_id) as agent_id,
    case when nv > 1 then 'Multi-producer' when nv = 1 and nu = 1 then 'Single-receptor producer' when nv = 1 and nu > 1 then 'Multi-receptor producer'
      when nv = 0 and nu > 0 then 'Nonproducer' when nv > 0 and nu = 0 then 'Producer-only (no utilization)' else 'Unconnected' end as strategy from fg),
items as (select p as item, row_number() over (order by p) as matrix_index, printf('PYO_%02d', row_number() over (order by p)) as node_id from (select distinct pyov as p from pairs)),
fgp as (select distinct group_id, agent_id as agent, item, node_id from (select group_id, agent_id, unnest(vg) as item from strat) join items using (item)),
fgu as (select distinct group_id, agent_id as agent, item, node_id from (select group_id, agent_id, unnest(ug) as item from strat) join items using (item)),
edges as (
  select agent as source, node_id as target, 'FG' as source_type, 'PYO' as target_type, 'production' as edge_type from fgp
  union all select node_id, agent, 'PYO', 'FG', 'utilization' from fgu)
"""


def sql(body: str, recursive: bool = False) -> str:
    """A query over the tables of CTES."""
    more = "," if body.lstrip().startswith(",") else ""
    body = body.lstrip().lstrip(",") if more else body
    return f"with {'recursive ' if recursive else ''}{CTES.strip()}{more}\n{body.strip()}"


def lookup(spark: SparkSession, folder: str) -> DataFrame:
    return repertoire.expanded(tables.pair_lists(spark, folder))


def repertoires(spark: SparkSession, folder: str) -> DataFrame:
    return repertoire.repertoires(tables.facts(spark, folder), lookup(spark, folder))


def grouped_entities(spark: SparkSession, folder: str) -> DataFrame:
    """The repertoires that groups rest on: entities with a validated or usable item, and of their facts those that the lookup has."""
    own = lookup(spark, folder)
    return repertoire.repertoires(tables.fitting_facts(spark, folder, own), own)


def prod(spark: SparkSession, folder: str) -> DataFrame:
    return repertoire.validated(tables.made(spark, folder), lookup(spark, folder))


def util(spark: SparkSession, folder: str) -> DataFrame:
    return repertoire.usable(tables.taken(spark, folder), lookup(spark, folder))


def groups(spark: SparkSession, folder: str) -> DataFrame:
    """Functional groups with strategy and node id. Saved once: all that follows works on these few rows."""
    return network.saved(repertoire.classified(network.group_nodes(repertoire.collapsed(grouped_entities(spark, folder)))))


def members(spark: SparkSession, folder: str, of: DataFrame) -> DataFrame:
    """(strain, signature, group_id) of the entities of groups."""
    return repertoire.members(grouped_entities(spark, folder), of)


def index(spark: SparkSession, folder: str) -> DataFrame:
    return network.item_index(lookup(spark, folder))


def layers(spark: SparkSession, folder: str, of: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups, and (agent, item) of production and utilization with node ids."""
    of = groups(spark, folder) if of is None else of
    own = index(spark, folder)
    made, used = (network.layer(of, "agent_id", c, own).select("agent", F.col("node_id").alias("item")) for c in ("validated_groups", "usable_items"))
    return of, made, used


def edge_table(spark: SparkSession, folder: str) -> DataFrame:
    _, made, used = layers(spark, folder)
    return network.typed_edges(made.withColumnRenamed("item", "node_id"), used.withColumnRenamed("item", "node_id"), "FG")


def joined(column: str) -> Column:
    """An array column as text, which both engines compare alike."""
    return F.array_join(column, ",")


def simpson_sql(f: str, low: str, high: str, steps: int = 2000) -> str:
    """The integral of f, an expression in t, by Simpson's rule."""
    weight = f"case when k in (0, {steps}) then 1 when k % 2 = 1 then 4 else 2 end"
    return f"(select sum({weight} * {f}) from (select k, ({low}) + k * (({high}) - ({low})) / {steps} as t from range(0, {steps + 1}) r(k))) * (({high}) - ({low})) / {3 * steps}"


def normal_p_sql(z: str) -> str:
    return f"least(2 / sqrt(pi()) * exp(-({z}) * ({z}) / 2) * {simpson_sql(f'exp(-t * t - sqrt(2) * abs({z}) * t)', '0', '7')}, 1)"


def normal_p(z: Column) -> Column:
    """The two-sided normal p as normal_p_sql has it: 1 where z is null, NaN or infinite."""
    return F.when(finite(z), inference.two_sided_normal_p(z)).otherwise(1.0)
