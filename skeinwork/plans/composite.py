"""Queries that combine operators end to end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinwork.functions import sets
from skeinwork.operators import checks, exploitation, metrics, network, repertoire
from skeinwork.plans import adapter
from skeinwork.plans.adapter import joined, sql
from skeinwork.plans.graph import LABELS, MODULE_EDGES, group_labels, item_labels, nodf_sql
from skeinwork.plans.registry import query
from skeinwork.sources import tables

S = SparkSession


@query("c1_overlap_report", sql("select count(*) filter (m and t) as in_both, count(*) filter (m and not t) as only_made, count(*) filter (t and not m) as only_taken, count(*) as total from (select strain, bool_or(m) as m, bool_or(t) as t from (select strain, true as m, false as t from syn where grp <> 0 union all select strain, false, true from rec) group by 1)"))
def c1(spark: S, d: str) -> DataFrame:
    made = tables.made(spark, d).where("grp <> 0").select("strain", F.lit(1).alias("m"), F.lit(0).alias("t"))
    both = made.unionByName(tables.taken(spark, d).select("strain", F.lit(0).alias("m"), F.lit(1).alias("t"))).groupBy("strain").agg(F.max("m").alias("m"), F.max("t").alias("t"))
    return both.agg(F.count_if((F.col("m") == 1) & (F.col("t") == 1)).alias("in_both"), F.count_if((F.col("m") == 1) & (F.col("t") == 0)).alias("only_made"), F.count_if((F.col("m") == 0) & (F.col("t") == 1)).alias("only_taken"), F.count("*").alias("total"))


@query("c2_lookup", sql("select pair_id, pyov, rec from pairs"))
def c2(spark: S, d: str) -> DataFrame:
    return adapter.lookup(spark, d)


@query("c3_repertoires", sql("select strain, array_to_string(pg, ',') as made, array_to_string(vg, ',') as valid, array_to_string(rg, ',') as taken, array_to_string(ug, ',') as usable, np, nv, nr, nu, nv > 0 as is_producer, nv > 1 as is_multi from sigs"))
def c3(spark: S, d: str) -> DataFrame:
    rep = adapter.repertoires(spark, d)
    lists = {"made": "production_groups", "valid": "validated_groups", "taken": "receptor_groups", "usable": "usable_items"}
    counts = {"np": "n_production_groups", "nv": "n_validated_groups", "nr": "n_receptor_groups", "nu": "n_usable_items"}
    return rep.select("strain", *[joined(c).alias(n) for n, c in lists.items()], *[F.col(c).alias(n) for n, c in counts.items()], "is_producer", F.col("is_multi_producer").alias("is_multi"))


@query("c4_quality_counts", sql("select count(*) as n, count(*) filter (np > 1) as many_raw, count(*) filter (nr > 0 and nu = 0) as none_usable, cast(sum(np - nv) as bigint) as not_valid, (select count(distinct grp) from rec where grp not in (select rec from pairs)) as excluded from sigs"))
def c4(spark: S, d: str) -> DataFrame:
    rep = adapter.repertoires(spark, d)
    counts = rep.agg(F.count("*").alias("n"), F.count_if(F.col("n_production_groups") > 1).alias("many_raw"), F.count_if((F.col("n_receptor_groups") > 0) & (F.col("n_usable_items") == 0)).alias("none_usable"), F.sum(F.col("n_production_groups") - F.col("n_validated_groups")).alias("not_valid"))
    excluded = tables.taken(spark, d).select("grp").distinct().join(adapter.lookup(spark, d).select(F.col("rec").alias("grp")), "grp", "left_anti").agg(F.count("*").alias("excluded"))
    return counts.crossJoin(F.broadcast(excluded))


@query("c5_raw_signatures", sql("select (case when np = 0 then '0' else array_to_string(pg, ',') end) || '|' || (case when nu = 0 then 'none' else array_to_string(ug, ',') end) as signature, count(*) as n from sigs group by 1"))
def c5(spark: S, d: str) -> DataFrame:
    return repertoire.signed(adapter.repertoires(spark, d), raw=True).groupBy("signature").agg(F.count("*").alias("n"))


@query("c6_collapse_and_map", sql("select s.strain, f.group_id, f.strain_count from sigs s join fg f using (signature)"))
def c6(spark: S, d: str) -> DataFrame:
    rep = network.saved(adapter.repertoires(spark, d).select("strain", "validated_groups", "usable_items", "n_validated_groups", "n_usable_items"))
    groups = repertoire.collapsed(rep)
    return repertoire.members(rep, groups).join(groups.select("group_id", "strain_count"), "group_id").select("strain", "group_id", "strain_count")


STRATEGY = """
select group_id, strategy, case when strategy like '%producer' and strategy <> 'Nonproducer' then 'Producer' when strategy = 'Nonproducer' then 'Nonproducer' else 'Other' end as strategy_category,
  'Production: ' || (case when nv > 0 then nv || ' validated groups' else 'none' end) || ' | Utilization: ' || (case when nu > 0 then nu || ' pyoverdines' else 'none' end) as strategy_description from strat
"""


@query("c7_strategies", sql(STRATEGY))
def c7(spark: S, d: str) -> DataFrame:
    return adapter.groups(spark, d).select("group_id", "strategy", "strategy_category", "strategy_description")


@query("c8_strategy_distribution", sql("select strategy, count(*) as n_groups, cast(sum(strain_count) as bigint) as n_strains, round(100.0 * count(*) / sum(count(*)) over (), 6) as pct_groups, round(100.0 * sum(strain_count) / sum(sum(strain_count)) over (), 6) as pct_strains from strat group by 1"))
def c8(spark: S, d: str) -> DataFrame:
    g = adapter.groups(spark, d).groupBy("strategy").agg(F.count("*").alias("n_groups"), F.sum("strain_count").alias("n_strains"))
    share = lambda c: F.round(100.0 * F.col(c) / F.sum(c).over(Window.partitionBy()), 6)
    return g.withColumns({"pct_groups": share("n_groups"), "pct_strains": share("n_strains")})


@query("c9_producer_categories", sql("select count(*) filter (np > 1 and nv >= 2) as multi, count(*) filter (np > 1 and nv <= 1) as single_or_none, count(*) filter (np > 0 and nv = 0) as only_unvalidated, round(100.0 * count(*) filter (np > 1 and nv >= 2) / count(*), 6) as multi_pct from sigs"))
def c9(spark: S, d: str) -> DataFrame:
    np_, nv = F.col("n_production_groups"), F.col("n_validated_groups")
    multi = F.count_if((np_ > 1) & (nv >= 2))
    return adapter.repertoires(spark, d).agg(multi.alias("multi"), F.count_if((np_ > 1) & (nv <= 1)).alias("single_or_none"), F.count_if((np_ > 0) & (nv == 0)).alias("only_unvalidated"), F.round(100.0 * multi / F.count("*"), 6).alias("multi_pct"))


@query("c10_agent_tables", sql("select agent_id, strain_count, nv > 0 as has_production, nu > 0 as has_utilization, array_to_string(vg, ',') as makes, array_to_string(ug, ',') as uses from strat"))
def c10(spark: S, d: str) -> DataFrame:
    return adapter.groups(spark, d).select("agent_id", "strain_count", "has_production", "has_utilization", joined("validated_groups").alias("makes"), joined("usable_items").alias("uses"))


@query("c10b_entity_table", sql("select printf('STR_%04d', row_number() over (order by strain)) as agent_id, strain, nv, nu from sigs where nv > 0 or nu > 0"))
def c10b(spark: S, d: str) -> DataFrame:
    kept = repertoire.conservative(adapter.repertoires(spark, d)).select("strain", F.col("n_validated_groups").alias("nv"), F.col("n_usable_items").alias("nu"))
    return network.numbered(kept, "index", "strain").select(F.format_string(network.ENTITY_ID, "index").alias("agent_id"), "strain", "nv", "nu")


DIFFERING = """
, facts as (select strain, list_sort(list(distinct p) filter (k = 'm')) as m, list_sort(list(distinct p) filter (k = 'u')) as u from (select strain, p, 'm' as k from prod union all select strain, p, 'u' from util) group by 1)
select count(distinct group_id) filter (array_to_string(coalesce(m, []), ',') <> array_to_string(vg, ',') or array_to_string(coalesce(u, []), ',') <> array_to_string(ug, ',')) as differing_groups, count(distinct group_id) as groups, count(*) as members
from (select s.strain, f.group_id, f.vg, f.ug from sigs s join fg f using (signature)) left join facts using (strain)
"""


@query("c11_consistency", sql(DIFFERING))
def c11(spark: S, d: str) -> DataFrame:
    """Recompute every member's sets from its facts, and count the groups where a member differs."""
    groups = adapter.groups(spark, d)
    members = network.saved(adapter.members(spark, d, groups).select("strain", "group_id"))
    differing = checks.differing_sets(groups, members, adapter.prod(spark, d), adapter.util(spark, d)).agg(F.count("*").alias("differing_groups"))
    return differing.crossJoin(members.agg(F.countDistinct("group_id").alias("groups"), F.count("*").alias("members")))


ITEM_COUNTS = """
select i.item, i.matrix_index, i.node_id, count(distinct p.group_id) > 0 as active_production, count(distinct u.group_id) > 0 as active_utilization,
  count(distinct p.group_id) as fg_production_count, count(distinct u.group_id) as fg_utilization_count,
  (select count(*) from prod where p = i.item) as strain_production_count, (select count(*) from util where p = i.item) as strain_utilization_count
from items i left join fgp p using (item) left join fgu u using (item) group by all
"""


def item_nodes(spark: S, d: str, groups: DataFrame) -> DataFrame:
    """The item dictionary with counts of groups and entities of each layer."""
    either = groups.select(F.explode("validated_groups").alias("item"), F.lit("p").alias("k"), "strain_count").unionByName(groups.select(F.explode("usable_items").alias("item"), F.lit("u").alias("k"), "strain_count"))
    counts = []
    for k, name in (("p", "production"), ("u", "utilization")):
        counts += [F.count_if(F.col("k") == k).alias(f"fg_{name}_count"), F.sum(F.when(F.col("k") == k, F.col("strain_count")).otherwise(0)).alias(f"strain_{name}_count")]
    index = adapter.index(spark, d).join(either.groupBy("item").agg(*counts), "item", "left").na.fill(0)
    return index.withColumns({"active_production": F.col("fg_production_count") > 0, "active_utilization": F.col("fg_utilization_count") > 0})


@query("c12_item_dictionary", sql(ITEM_COUNTS))
def c12(spark: S, d: str) -> DataFrame:
    return item_nodes(spark, d, adapter.groups(spark, d))


@query("c13_edges", sql("select edge_type, source, target from edges"))
def c13(spark: S, d: str) -> DataFrame:
    return adapter.edge_table(spark, d).select("edge_type", "source", "target")


@query("c13b_entity_edges", sql("select kind, strain, node_id from (select 'production' as kind, strain, p as item from prod union all select 'utilization', strain, p from util) join items using (item)"))
def c13b(spark: S, d: str) -> DataFrame:
    facts = adapter.prod(spark, d).withColumn("kind", F.lit("production")).unionByName(adapter.util(spark, d).withColumn("kind", F.lit("utilization")))
    return facts.join(adapter.index(spark, d).select(F.col("item").alias("p"), "node_id"), "p").select("kind", "strain", "node_id")


def layer_sql(level: str, kind: str, edges: str, agents: str, item: str, exists: str) -> str:
    n = f"{kind}_{level}"
    return f"""
select 'exists_adj_{n}' as name, (select count(*) from {edges}) > 0 as passed, '{exists}' as severity union all
select '{n}_agents_match_nodes', not exists (select 1 from {edges} where agent not in ({agents})), 'critical' union all
select '{n}_items_match_nodes', not exists (select 1 from {edges} where item not in (select {item} from items)), 'critical' union all
select 'binary_adj_{n}', coalesce((select max(n) from (select count(*) as n from {edges} group by agent, item)), 1) = 1, 'critical' union all
select 'no_null_adj_{n}', not exists (select 1 from {edges} where agent is null or item is null), 'critical' union all
"""


PREFLIGHT = (
    """
, ents as (select strain, nv, nu from sigs where nv > 0 or nu > 0),
lfp as (select agent, node_id as item from fgp), lfu as (select agent, node_id as item from fgu), lsp as (select strain as agent, p as item from prod), lsu as (select strain as agent, p as item from util),
"""
    + "pre as ("
    + "".join(layer_sql(level, kind, f"l{level[0]}{kind[0]}", "select agent_id from strat" if level == "fg" else "select strain from ents", "node_id" if level == "fg" else "item", "critical" if level == "fg" else "warning") for level in ("fg", "str") for kind in ("prod", "util"))
    + r"""
select 'prod_fg_agent_names_align', not exists (select 1 from lfp where not regexp_matches(agent, '^FG_\d{3,}$')), 'warning' union all
select 'prod_fg_item_names_align', not exists (select 1 from lfp where not regexp_matches(item, '^PYO_\d{2,}$')), 'warning' union all
select 'prod_str_agent_names_align', not exists (select 1 from lsp where not regexp_matches(cast(agent as varchar), '^\d+$')), 'warning' union all
select 'prod_str_item_names_align', not exists (select 1 from lsp where not regexp_matches(cast(item as varchar), '^\d+$')), 'warning' union all
select 'exists_nodes_fg', (select count(*) from strat) > 0, 'critical' union all select 'agent_ids_unique', (select count(*) = count(distinct agent_id) from strat), 'critical' union all
select 'exists_nodes_str', (select count(*) from ents) > 0, 'warning' union all select 'entity_ids_unique', (select count(*) = count(distinct strain) from ents), 'critical' union all
select 'exists_nodes_items', (select count(*) from items) > 0, 'critical' union all select 'item_ids_unique', (select count(*) = count(distinct node_id) from items), 'critical' union all
select 'names_disjoint', not exists (select agent_id from strat intersect select node_id from items), 'critical' union all
select 'exists_degree_seq', (select count(*) from strat) > 0, 'warning' union all
select 'degree_seq_fg_production_out_match', not exists (select 1 from strat s left join (select agent, count(*) as n from lfp group by 1) e on e.agent = s.agent_id where coalesce(n, 0) <> nv), 'warning' union all
select 'degree_seq_fg_utilization_in_match', not exists (select 1 from strat s left join (select agent, count(*) as n from lfu group by 1) e on e.agent = s.agent_id where coalesce(n, 0) <> nu), 'warning' union all
select 'every_group_connected', not exists (select 1 from strat where agent_id not in (select agent from lfp union select agent from lfu)), 'warning' union all
select 'group_sizes_add_up', (select sum(strain_count) from strat) = (select count(*) from ents), 'critical' union all
select 'entity_edges_match_weighted_group_edges', (select sum(strain_count) from (select agent from lfp union all select agent from lfu) join strat on agent_id = agent) = (select sum(nv + nu) from ents), 'critical' union all
select 'inactive_items_fg_level', not exists (select 1 from items where node_id not in (select item from lfp union select item from lfu)), 'info')
"""
)


def preflight(spark: S, d: str) -> DataFrame:
    rep = network.saved(repertoire.conservative(adapter.repertoires(spark, d)).select("strain", "validated_groups", "usable_items", "n_validated_groups", "n_usable_items"))
    groups, made, used = adapter.layers(spark, d, network.saved(repertoire.classified(network.group_nodes(repertoire.collapsed(rep)))))
    index = network.saved(adapter.index(spark, d))
    own = [rep.select(F.col("strain").alias("agent"), F.explode(c).alias("item")) for c in ("validated_groups", "usable_items")]
    return checks.preflight(groups, rep, index, network.saved(made), network.saved(used), *own)


@query("c14_preflight", sql(PREFLIGHT + "select name, passed, severity from pre"))
def c14(spark: S, d: str) -> DataFrame:
    return preflight(spark, d)


@query("c14b_preflight_verdict", sql(PREFLIGHT + "select count(*) as checks, count(*) filter (not passed and severity = 'critical') as critical, count(*) filter (not passed and severity = 'warning') as warnings from pre"))
def c14b(spark: S, d: str) -> DataFrame:
    return checks.verdict(preflight(spark, d))


DEGREES = """
, deg as (
  select 'producer' as role, s.agent_id as node, count(p.node_id) as d from strat s left join fgp p on p.agent = s.agent_id group by all union all
  select 'consumer', s.agent_id, count(p.node_id) from strat s left join fgu p on p.agent = s.agent_id group by all union all
  select 'item_in', i.node_id, count(p.agent) from items i left join fgp p on p.node_id = i.node_id group by all union all
  select 'item_out', i.node_id, count(p.agent) from items i left join fgu p on p.node_id = i.node_id group by all)
select role, count(*) as n, min(d) as min, quantile_cont(d, 0.25) as q25, quantile_cont(d, 0.5) as median, quantile_cont(d, 0.75) as q75, round(avg(d), 6) as mean, max(d) as max, round(stddev_samp(d), 6) as sd,
  count(*) filter (d = 0) as zeros, count(*) filter (d > 0) as nonzero, round(count(*) filter (d > 0) / count(*), 6) as proportion_nonzero from deg group by 1
"""


@query("c15_degree_report", sql(DEGREES))
def c15(spark: S, d: str) -> DataFrame:
    groups, made, used = adapter.layers(spark, d)
    items = adapter.index(spark, d)
    roles = [("producer", made, "agent", groups, "agent_id"), ("consumer", used, "agent", groups, "agent_id"), ("item_in", made, "item", items, "node_id"), ("item_out", used, "item", items, "node_id")]
    parts = [network.degrees(e, side, nodes, node).select(F.lit(role).alias("role"), "degree") for role, e, side, nodes, node in roles]
    return network.degree_summary(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]), "role")


TYPED = """
, typed as (
  select u.agent, u.node_id as item, s.strain_count, case when p.agent is not null then 'cooperator' when s.nv > 0 then 'crossfeeder' else 'nonproducer' end as user_type
  from fgu u join strat s on s.agent_id = u.agent left join fgp p on p.agent = u.agent and p.node_id = u.node_id)
"""


def agents_of(groups: DataFrame) -> DataFrame:
    return groups.select(F.col("agent_id").alias("agent"), "strain_count", "has_production")


@query("c16_user_types", sql(TYPED + "select agent, item, strain_count, user_type from typed"))
def c16(spark: S, d: str) -> DataFrame:
    groups, made, used = adapter.layers(spark, d)
    return exploitation.typed_users(used, made, agents_of(groups))


METRICS = (
    TYPED
    + LABELS
    + nodf_sql(MODULE_EDGES, "label")
    + """
, modules as (
  select label as module_id, na.n as module_fg_count, ni.n as module_pyo_count, round((coalesce(a.v, 0) + coalesce(i.v, 0)) / 2, 6) as module_nestedness, round(100.0 * coalesce(me.n, 0) / (na.n * ni.n), 6) as module_fill_pct
  from (select label, count(*) as n from la group by 1) na join (select label, count(*) as n from li group by 1) ni using (label) left join s_agent a using (label) left join s_item i using (label) left join (select label, count(*) as n from e group by 1) me using (label)
  where na.n >= 2 and ni.n >= 2),
dictionary as (""" + ITEM_COUNTS + """),
mk as (select p.node_id as item, count(*) as fg, sum(s.strain_count) as st from fgp p join strat s on s.agent_id = p.agent group by 1),
us as (
  select item, count(*) as fg, sum(strain_count) as st,
    """
    + ", ".join(f"count(*) filter (user_type = '{k}') as {k}s_fg, coalesce(sum(strain_count) filter (user_type = '{k}'), 0) as {k}s_strains" for k in exploitation.KINDS)
    + """ from typed group by 1),
metrics as (
  select i.node_id as pyo_id, i.pyo_label, i.item as original_pyov_id, cast(coalesce(mk.fg, 0) as bigint) as producers_fg_total, cast(coalesce(mk.st, 0) as bigint) as producers_strains_total,
    i.fg_production_count, i.strain_production_count, cast(coalesce(us.fg, 0) as bigint) as utilizers_fg_total, cast(coalesce(us.st, 0) as bigint) as utilizers_strains_total, i.fg_utilization_count, i.strain_utilization_count,
    """
    + ", ".join(f"case when coalesce({w}, 0) > 0 then round(coalesce({p}, 0) / {w}, 9) else 'Infinity'::double end as {n}_ratio" for n, p, w in (("fg_util_prod", "us.fg", "mk.fg"), ("strain_util_prod", "us.st", "mk.st"), ("fg_rec_syn", "i.fg_utilization_count", "i.fg_production_count"), ("strain_rec_syn", "i.strain_utilization_count", "i.strain_production_count")))
    + ","
    + ", ".join(f"cast({k}s_fg as bigint) as {k}s_fg, cast({k}s_strains as bigint) as {k}s_strains, round({k}s_fg / us.fg, 9) as {k}s_fg_frac, round({k}s_strains / us.st, 9) as {k}s_strain_frac" for k in exploitation.KINDS)
    + """,
    li.label as module_id, module_fg_count, module_pyo_count, module_nestedness, module_fill_pct,
    coalesce(module_fg_count >= 30, false) as is_large_module, coalesce(module_nestedness >= 50, false) as is_nested_module, coalesce(li.label in (0, 3, 8), false) as is_major_module
  from (select *, 'pyov_' || item as pyo_label from dictionary) i left join mk on mk.item = i.node_id left join us on us.item = i.node_id left join li on li.item = i.node_id left join modules on modules.module_id = li.label)
"""
)


def item_metrics(spark: S, d: str) -> DataFrame:
    """The flagship: who makes and uses each item, with ratios and the context of its module."""
    groups, made, used = adapter.layers(spark, d)
    made, used = network.saved(made), network.saved(used)
    la, li = group_labels(groups), network.saved(item_labels(spark, d))
    # Only modules of two agents and two items or more are measured; the others have neither counts nor nestedness.
    measured = metrics.within_modules(used, la, li).select(F.col("label").alias("module_id"), F.col("module_agents").alias("module_fg_count"), F.col("module_items").alias("module_pyo_count"), F.round("nodf_total", 6).alias("module_nestedness"), F.round("fill_percentage", 6).alias("module_fill_pct"))
    modules = li.select(F.col("item").alias("pyo_id"), F.col("label").alias("module_id")).join(measured, "module_id", "left")
    items = item_nodes(spark, d, groups).select(F.col("node_id").alias("pyo_id"), F.concat(F.lit("pyov_"), F.col("item").cast("string")).alias("pyo_label"), F.col("item").alias("original_pyov_id"), "fg_production_count", "strain_production_count", "fg_utilization_count", "strain_utilization_count")
    found = exploitation.item_metrics(used, made, agents_of(groups), items, modules)
    return found.withColumns({c: F.round(c, 9) for c in found.columns if c.endswith(("_frac", "_ratio"))})


@query("c17_exploitation_metrics", sql(METRICS + f"select {', '.join(exploitation.COLUMNS)} from metrics"))
def c17(spark: S, d: str) -> DataFrame:
    return item_metrics(spark, d)


@query("c18_high_exploitation", sql(METRICS + "select pyo_id, nonproducers_strain_frac, strain_util_prod_ratio from metrics where nonproducers_strain_frac >= 0.5 and utilizers_strains_total >= 10 order by nonproducers_strain_frac desc, strain_util_prod_ratio desc, pyo_id limit 20"))
def c18(spark: S, d: str) -> DataFrame:
    return exploitation.high_exploitation(item_metrics(spark, d)).select("pyo_id", "nonproducers_strain_frac", "strain_util_prod_ratio")


@query("c18b_high_ratio", sql(METRICS + "select pyo_id, strain_util_prod_ratio, utilizers_strains_total from metrics where strain_util_prod_ratio >= 5 and utilizers_strains_total >= 20 order by strain_util_prod_ratio desc, utilizers_strains_total desc, pyo_id limit 20"))
def c18b(spark: S, d: str) -> DataFrame:
    return exploitation.high_ratio(item_metrics(spark, d)).select("pyo_id", "strain_util_prod_ratio", "utilizers_strains_total")


TOPS = {"ratio": "strain_util_prod_ratio", "nonproducers": "nonproducers_strain_frac", "group_ratio": "fg_util_prod_ratio"}


@query("c18c_top_tens", sql(METRICS + " union all ".join(f"select * from (select '{n}' as list, pyo_id, cast({c} as double) as value from metrics order by {c} desc nulls last, pyo_id limit 10)" for n, c in TOPS.items())))
def c18c(spark: S, d: str) -> DataFrame:
    """Three lists of ten, the report's own limit."""
    found = network.saved(item_metrics(spark, d).select("pyo_id", *TOPS.values()))
    tops = [found.select(F.lit(n).alias("list"), "pyo_id", F.col(c).cast("double").alias("value")).orderBy(F.desc_nulls_last("value"), "pyo_id").limit(10) for n, c in TOPS.items()]
    return tops[0].union(tops[1]).union(tops[2])


@query("c18d_summary_counts", sql(METRICS + "select count(*) as items, count(*) filter (nonproducers_strain_frac >= 0.5) as exploited, count(*) filter (strain_util_prod_ratio >= 10) as unbalanced, count(*) filter (is_major_module) as in_major_modules from metrics"))
def c18d(spark: S, d: str) -> DataFrame:
    return exploitation.summary_counts(item_metrics(spark, d))


@query("p10_exploitation_thresholds", sql(METRICS + "select pyo_id from metrics where nonproducers_strain_frac >= 0.1 and utilizers_strains_total >= 10"))
def p10(spark: S, d: str) -> DataFrame:
    """At a share of 0.1, as few items of the stand-in network reach the report's 0.5."""
    return item_metrics(spark, d).where("nonproducers_strain_frac >= 0.1 and utilizers_strains_total >= 10").select("pyo_id")


@query("p11_ratio_thresholds", sql(METRICS + "select pyo_id from metrics where strain_util_prod_ratio >= 5 and utilizers_strains_total >= 20"))
def p11(spark: S, d: str) -> DataFrame:
    return item_metrics(spark, d).where("strain_util_prod_ratio >= 5 and utilizers_strains_total >= 20").select("pyo_id")


def resolve_sql(offers: str) -> str:
    """offers: (item, candidate, evidence)."""
    return f""", sup as (select item, candidate, count(distinct evidence) as support from ({offers}) where candidate is not null group by all),
best as (select *, row_number() over (partition by item order by support desc, candidate) as k, count(*) over (partition by item) as candidates from sup)"""


@query("c19_resolve_pairs", sql(resolve_sql("select pyov as item, pair_id as candidate, rec as evidence from pairs") + " select node_id, i.item, candidate as pair_id, support, candidates > 1 as conflict from items i left join (select * from best where k = 1) using (item)"))
def c19(spark: S, d: str) -> DataFrame:
    """Each item's best pair by its number of receptor groups; items of no pair stay with nulls."""
    offers = adapter.lookup(spark, d).select(F.col("pyov").alias("item"), F.col("pair_id").alias("candidate"), F.col("rec").alias("evidence"))
    best, _ = repertoire.resolved(offers)
    return adapter.index(spark, d).select("node_id", "item").join(best, "item", "left").select("node_id", "item", F.col("candidate").alias("pair_id"), "support", "conflict")


SOLD = "select cast(substr(p_brand, 7) as int) as item, s_nationkey as candidate, l_suppkey as evidence from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey"


@query("c19b_conflict_log", sql(resolve_sql(SOLD) + " select item, candidate, support, k = 1 as chosen from best where candidates > 1"))
def c19b(spark: S, d: str) -> DataFrame:
    """The log of all candidates of items that several offer: each brand's nations by the number of suppliers, as pairs of the stand-in network never conflict."""
    lines, part, supplier = (tables.read(spark, d, t) for t in ("lineitem", "part", "supplier"))
    sold = lines.select("l_partkey", "l_suppkey").join(part.select("p_partkey", F.substring("p_brand", 7, 9).cast("int").alias("item")), F.col("l_partkey") == F.col("p_partkey")).select("item", "l_suppkey").distinct()
    offers = sold.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("item", F.col("s_nationkey").alias("candidate"), F.col("l_suppkey").alias("evidence"))
    return repertoire.resolved(offers)[1]


SUMMARY = """
, kv as (select pair_id, count(distinct pyov) as n_syn_groups, count(distinct rec) as n_rec_groups, array_to_string(list_sort(list(distinct pyov)), ';') as syn_groups_csv, array_to_string(list_sort(list(distinct rec)), ';') as rec_groups_csv from pairs group by 1)
select i.node_id, 'pyov_' || i.item as pyov_label, i.item, kv.*,
  (select count(distinct strain) from syn where grp = i.item) as syn_strains, (select count(*) from syn where grp = i.item) as syn_records, (select min(strain) from syn where grp = i.item) as example,
  (select count(distinct strain) from rec r join pairs q on q.rec = r.grp where q.pyov = i.item) as rec_strains
from items i left join (select distinct pyov, pair_id from pairs) p on p.pyov = i.item left join kv using (pair_id)
"""


@query("c20_item_summary", sql(SUMMARY))
def c20(spark: S, d: str) -> DataFrame:
    """Each item with its pair's groups as text, and how many records and entities make it or have a receptor for it."""
    lookup = network.saved(adapter.lookup(spark, d))
    kv = lookup.groupBy("pair_id").agg(sets.gathered(F.col("pyov")).alias("s"), sets.gathered(F.col("rec")).alias("r"))
    kv = kv.select("pair_id", *[F.size(c).cast("long").alias(f"n_{n}_groups") for c, n in (("s", "syn"), ("r", "rec"))], *[F.array_join(c, ";").alias(f"{n}_groups_csv") for c, n in (("s", "syn"), ("r", "rec"))])
    made = tables.made(spark, d).where("grp <> 0").groupBy(F.col("grp").alias("item")).agg(F.countDistinct("strain").alias("syn_strains"), F.count("*").alias("syn_records"), F.min("strain").alias("example"))
    users = repertoire.usable(tables.taken(spark, d), lookup).groupBy(F.col("p").alias("item")).agg(F.count("*").alias("rec_strains"))
    pair = lookup.select(F.col("pyov").alias("item"), "pair_id").distinct()
    out = network.item_index(lookup).join(pair, "item", "left").join(kv, "pair_id", "left").join(made, "item", "left").join(users, "item", "left").na.fill(0, ["syn_strains", "syn_records", "rec_strains"])
    return out.select("node_id", F.concat(F.lit("pyov_"), F.col("item").cast("string")).alias("pyov_label"), "item", *kv.columns, "syn_strains", "syn_records", "example", "rec_strains")


@query("c20b_syn_detail", sql("select node_id, grp, count(*) as records, count(distinct strain) as strains, min(strain) as example from items join syn on grp = item group by all"))
def c20b(spark: S, d: str) -> DataFrame:
    """What makes each item: records, entities and an example of its group."""
    found = tables.made(spark, d).groupBy("grp").agg(F.count("*").alias("records"), F.countDistinct("strain").alias("strains"), F.min("strain").alias("example"))
    return adapter.index(spark, d).select("node_id", F.col("item").alias("grp")).join(found, "grp").select("node_id", "grp", "records", "strains", "example")


@query("c20c_rec_detail", sql("select node_id, grp, count(*) as records, count(distinct strain) as strains, min(strain) as example from items join pairs on pyov = item join rec on grp = pairs.rec group by all"))
def c20c(spark: S, d: str) -> DataFrame:
    """The receptor groups of each item: counted by group first, so that the lookup widens few rows."""
    found = tables.taken(spark, d).groupBy("grp").agg(F.count("*").alias("records"), F.countDistinct("strain").alias("strains"), F.min("strain").alias("example"))
    lookup = network.saved(adapter.lookup(spark, d))
    fits = network.item_index(lookup).join(lookup.select(F.col("pyov").alias("item"), F.col("rec").alias("grp")).distinct(), "item")
    return fits.join(found, "grp").select("node_id", "grp", "records", "strains", "example")


@query("c21_largest_group", sql("select signature, strain_count, prefix, count(*) as n from (select f.signature, f.strain_count, substr(c_name, 1, 14) as prefix from fg f join sigs s using (signature) join customer on c_custkey = s.strain where f.strain_count = (select max(strain_count) from fg)) group by all"))
def c21(spark: S, d: str) -> DataFrame:
    rep = network.saved(adapter.repertoires(spark, d).select("strain", "validated_groups", "usable_items", "n_validated_groups", "n_usable_items"))
    groups = repertoire.collapsed(rep).select("signature", "strain_count", "group_id")
    largest = groups.join(F.broadcast(groups.agg(F.max("strain_count").alias("strain_count"))), "strain_count")
    names = tables.read(spark, d, "customer").select(F.col("c_custkey").alias("strain"), F.substring("c_name", 1, 14).alias("prefix"))
    return repertoire.members(rep, largest).join(names, "strain").groupBy("signature", "prefix").agg(F.count("*").alias("n")).join(largest, "signature").select("signature", "strain_count", "prefix", "n")


@query("c21b_receptor_frequencies", sql("select grp, count(*) as n, round(100.0 * count(*) / (select strain_count from fg order by strain_count desc, group_id limit 1), 6) as pct from (select strain, unnest(rg) as grp from sigs where signature = (select signature from fg order by strain_count desc, group_id limit 1)) group by 1"))
def c21b(spark: S, d: str) -> DataFrame:
    rep = network.saved(repertoire.signed(adapter.repertoires(spark, d)))
    first = repertoire.collapsed(rep.drop("signature")).orderBy(F.desc("strain_count"), "group_id").limit(1).select("signature", "strain_count")
    members = rep.join(F.broadcast(first), "signature").select("strain_count", F.explode("receptor_groups").alias("grp"))
    return members.groupBy("grp", "strain_count").agg(F.count("*").alias("n")).select("grp", "n", F.round(100.0 * F.col("n") / F.col("strain_count"), 6).alias("pct"))


@query("c22_size_distribution", sql("select strain_count as size, count(*) as n_groups, cast(sum(strain_count) as bigint) as n_strains, round(sum(sum(strain_count)) over (order by strain_count desc) / sum(sum(strain_count)) over (), 6) as covered from fg group by 1"))
def c22(spark: S, d: str) -> DataFrame:
    sizes = adapter.groups(spark, d).groupBy(F.col("strain_count").alias("size")).agg(F.count("*").alias("n_groups"), F.sum("strain_count").alias("n_strains"))
    run = network.running(sizes, [F.desc("size")], sums={"ahead": F.col("n_strains")}).crossJoin(F.broadcast(sizes.agg(F.sum("n_strains").alias("whole"))))
    return run.select("size", "n_groups", "n_strains", F.round((F.col("ahead") + F.col("n_strains")) / F.col("whole"), 6).alias("covered"))


DEEP = """
, one as (select * from strat order by strain_count desc, group_id limit 1),
own as (select 'production' as kind, unnest(vg) as item from one union all select 'utilization', unnest(ug) from one)
select kind, own.item, node_id, pair_id, (select count(*) from fgp where fgp.item = own.item) as making_groups, (select count(*) from fgu where fgu.item = own.item) as using_groups, (select strain_count from one) as strain_count
from own join items using (item) left join (select distinct pyov as item, pair_id from pairs) using (item)
"""


@query("c22b_group_deep_dive", sql(DEEP))
def c22b(spark: S, d: str) -> DataFrame:
    """The items of the largest group, with their pairs and how many groups make or use them."""
    groups = adapter.groups(spark, d)
    counts = item_nodes(spark, d, groups).select("item", "node_id", F.col("fg_production_count").alias("making_groups"), F.col("fg_utilization_count").alias("using_groups"))
    one = groups.orderBy(F.desc("strain_count"), "group_id").limit(1)
    own = one.select("strain_count", F.lit("production").alias("kind"), F.explode("validated_groups").alias("item")).unionByName(one.select("strain_count", F.lit("utilization").alias("kind"), F.explode("usable_items").alias("item")))
    pair = adapter.lookup(spark, d).select(F.col("pyov").alias("item"), "pair_id").distinct()
    return own.join(counts, "item").join(pair, "item", "left").select("kind", "item", "node_id", "pair_id", "making_groups", "using_groups", "strain_count")


@query("c23_strategy_samples", sql("select strategy, group_id from (select strategy, group_id, row_number() over (partition by strategy order by strain_count desc, group_id) as k from strat) where k <= 3"))
def c23(spark: S, d: str) -> DataFrame:
    """Three groups of each strategy, the report's own limit."""
    rank = F.row_number().over(Window.partitionBy("strategy").orderBy(F.desc("strain_count"), "group_id"))
    return adapter.groups(spark, d).withColumn("k", rank).where("k <= 3").select("strategy", "group_id")


@query("c24_group_digest", sql("select grp, count(*) as n, count(distinct strain) as n_strains, min(strain) as example, min(substr(c_name, 1, 12)) as snippet from syn join customer on c_custkey = strain group by 1"))
def c24(spark: S, d: str) -> DataFrame:
    """Every group, 0 included: records, entities, an example and a snippet of its name."""
    names = tables.read(spark, d, "customer").select(F.col("c_custkey").alias("strain"), F.substring("c_name", 1, 12).alias("snippet"))
    return tables.made(spark, d).join(names, "strain").groupBy("grp").agg(F.count("*").alias("n"), F.countDistinct("strain").alias("n_strains"), F.min("strain").alias("example"), F.min("snippet").alias("snippet"))


def majority_sql(name: str, edges: str, node: str, other: str, labels: str) -> str:
    return f"{name} as (select {node}, label from (select {node}, label, row_number() over (partition by {node} order by count(*) desc, label) as k from {edges} join {labels} using ({other}) group by {node}, label) where k = 1)"


COMPARED = (
    LABELS
    + ", "
    + ", ".join(majority_sql(f"a{x}", f"e{x}", "agent", "item", "li") + ", " + majority_sql(f"i{x}", f"e{x}", "item", "agent", f"a{x}") for x in "pu")
    + " select node_type, prod_module, util_module, count(*) as n from (select 'FG' as node_type, p.label as prod_module, u.label as util_module from ap p join au u using (agent) union all select 'PYO', p.label, u.label from ip p join iu u using (item)) group by all"
)


@query("c28_module_comparison", sql(COMPARED))
def c28(spark: S, d: str) -> DataFrame:
    """Nodes by their modules in production and in utilization: one round of majority labels from the items' pairs in each layer."""
    _, made, used = adapter.layers(spark, d)
    items = network.saved(item_labels(spark, d))
    parts = {}
    for kind, edges in (("prod_module", network.saved(made)), ("util_module", network.saved(used))):
        a, i = metrics.brim(edges, None, items, iterations=1, until_stable=False)
        parts[kind] = a.select(F.col("agent").alias("node"), F.lit("FG").alias("node_type"), "label").union(i.select("item", F.lit("PYO"), "label"))
    return metrics.compared(parts["prod_module"], parts["util_module"])


def entropy_sql(n: str) -> str:
    return f"ln(sum({n})) - sum({n} * ln({n})) / sum({n})"


@query("x1_entropy", sql(f"select round({entropy_sql('strain_count')}, 9) as h, round(({entropy_sql('strain_count')}) / ln(count(*)), 9) as evenness from fg"))
def x1(spark: S, d: str) -> DataFrame:
    n: Column = F.col("strain_count").cast("double")
    return adapter.groups(spark, d).agg(F.round(metrics.entropy(n), 9).alias("h"), F.round(metrics.entropy(n) / F.log(F.count("*").cast("double")), 9).alias("evenness"))


@query("x3_without_largest", sql("select count(*) as n_edges, count(distinct agent) as n_agents from fgu where group_id <> (select group_id from fg order by strain_count desc, group_id limit 1)"))
def x3(spark: S, d: str) -> DataFrame:
    groups = adapter.groups(spark, d)
    largest = groups.orderBy(F.desc("strain_count"), "group_id").limit(1).select("group_id")
    _, _, used = adapter.layers(spark, d, groups.join(F.broadcast(largest), "group_id", "left_anti"))
    return used.agg(F.count("*").alias("n_edges"), F.countDistinct("agent").alias("n_agents"))


@query("x3b_item_subset", sql("select kind, count(*) as n_edges, count(distinct agent) as n_agents, count(distinct node_id) as n_items from (select 'production' as kind, agent, item, node_id from fgp union all select 'utilization', agent, item, node_id from fgu) where item in (select p from prod group by 1 having count(*) >= (select avg(n) from (select count(*) as n from prod group by p))) group by 1"))
def x3b(spark: S, d: str) -> DataFrame:
    """Both layers collapsed to the items that are made at least as often as the mean item."""
    groups = adapter.groups(spark, d)
    counts = adapter.prod(spark, d).groupBy("p").agg(F.count("*").alias("n"))
    kept = counts.crossJoin(F.broadcast(counts.agg(F.avg("n").alias("mean")))).where("n >= mean").select(F.col("p").alias("item"))
    index = adapter.index(spark, d).join(kept, "item")
    layers = [network.layer(groups, "agent_id", c, index).withColumn("kind", F.lit(k)) for c, k in (("validated_groups", "production"), ("usable_items", "utilization"))]
    return layers[0].unionByName(layers[1]).groupBy("kind").agg(F.count("*").alias("n_edges"), F.countDistinct("agent").alias("n_agents"), F.countDistinct("node_id").alias("n_items"))


@query("x4_weighted_degrees", sql("select node_id as node, cast(sum(strain_count) as bigint) as degree from fgu join strat using (group_id) group by 1"))
def x4(spark: S, d: str) -> DataFrame:
    groups, _, used = adapter.layers(spark, d)
    return network.degrees(used.join(groups.select(F.col("agent_id").alias("agent"), "strain_count"), "agent"), "item", weight=F.col("strain_count"))
