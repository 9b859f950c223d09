"""Queries for sources, filters, joins, aggregates, windows, set operations and functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinwork.functions import sets
from skeinwork.operators import inference, network, repertoire
from skeinwork.plans import adapter
from skeinwork.plans.adapter import joined, simpson_sql, sql
from skeinwork.plans.registry import query
from skeinwork.schema import first_present, present
from skeinwork.sources import files, tables

S = SparkSession


# Sources and reports.


@query("s3_decode_cells", "select p_partkey, trim(p_name) as name, length(p_name) as n from part")
def s3(spark: S, d: str) -> DataFrame:
    cells = tables.read(spark, d, "part").select("p_partkey", F.encode(F.rpad("p_name", 64, " "), "UTF-8").alias("cell"))
    return cells.select("p_partkey", files.decoded(F.col("cell")).alias("name")).withColumn("n", F.length("name").cast("long"))


@query("s4_parse_json", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def s4(spark: S, d: str) -> DataFrame:
    return tables.read(spark, d, "events").select("event_id", F.from_json("props", "k bigint").k.alias("k"))


@query("s5_first_existing_path", "select r_regionkey, r_name from region")
def s5(spark: S, d: str) -> DataFrame:
    return files.read_first(spark, [f"{d}/no_such_table.parquet", f"{d}/region.parquet"]).select("r_regionkey", "r_name")


@query("s8_list_files", "select table_name as name from information_schema.tables where table_name in ('region', 'nation')")
def s8(spark: S, d: str) -> DataFrame:
    listed = files.read_listed(spark, d, "{region,nation}.parquet")
    return listed.select(F.regexp_extract("path", r"(region|nation)\.parquet", 1).alias("name")).distinct()


@query("s9_zip_vectors", "select l_orderkey, l_linenumber, l_quantity from lineitem")
def s9(spark: S, d: str) -> DataFrame:
    """Records of equally long vectors, one an order, as rows."""
    lines = tables.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("r"))
    vectors = lines.select("l_orderkey", F.col("r.l_linenumber").alias("l_linenumber"), F.col("r.l_quantity").alias("l_quantity"))
    return files.zipped(vectors, l_linenumber="l_linenumber", l_quantity="l_quantity", keep=["l_orderkey"])


def event_records(spark: S, d: str) -> DataFrame:
    """Events as text records: what props holds, and a field that only some have."""
    own = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "value", F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("even_user"), F.struct(F.from_json("props", "k int").getField("k").alias("k")).alias("props")))
    return tables.read(spark, d, "events").select(own.alias("record"))


@query("s9b_common_fields", "select event_id as id, event_type as kind, cast(json_extract_string(props, '$.k') as bigint) as props_k, value from events")
def s9b(spark: S, d: str) -> DataFrame:
    """Records as a table of the fields that all of them share, at any depth, by the types they have."""
    return files.shared_fields(event_records(spark, d), "record")


S10 = """
with e as (select event_id as id, event_type as kind, value, case when user_id % 2 = 0 then user_id end as even_user, cast(json_extract_string(props, '$.k') as bigint) as k, [event_type, 'x'] as tags from events)
select 'e.id' as path, 'bigint' as class, count(id) as size, count(*) - count(id) as missing, min(id)::varchar as head from e
union all select 'e.kind', 'string', count(kind), count(*) - count(kind), min(kind) from e
union all select 'e.even_user', 'bigint', count(even_user), count(*) - count(even_user), min(even_user)::varchar from e
union all select 'e.props.k', 'bigint', count(k), count(*) - count(k), min(k)::varchar from e
union all select 'e', 'struct', count(*), 0, null from e union all select 'e.props', 'struct', count(*), 0, null from e
union all select 'tags', 'array', count(tags), 0, null from e union all select 'tags[]', 'string', sum(len(tags))::bigint, 0, min(t) from e, (select unnest(tags) as t from e) group by all having false
union all select 'tags[]', 'string', 2 * count(*), 0, least(min(kind), 'x') from e
"""


@query("s10_inspect_source", S10)
def s10(spark: S, d: str) -> DataFrame:
    """Every path of a nested source with its class, how many values it has and lacks, and its least value, in one pass."""
    e = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("even_user"), F.struct(F.from_json("props", "k bigint").getField("k").alias("k")).alias("props"))
    nested = tables.read(spark, d, "events").select(e.alias("e"), F.array("event_type", F.lit("x")).alias("tags"))
    return files.inspected(nested)


@query("k4_flatten_lists", sql("select pair_id, array_to_string(list_sort(list(distinct pyov)), ',') as pyov, array_to_string(list_sort(list(distinct rec)), ',') as rec from pairs group by 1"))
def k4(spark: S, d: str) -> DataFrame:
    return files.flat(tables.pair_lists(spark, d))


REPORT = """
select 'groups' as section, 'n_groups' as metric, cast(count(*) as double) as value from fg union all
select 'groups', 'mean_size', round(avg(strain_count), 6) from fg union all select 'groups', 'max_size', max(strain_count) from fg union all
select 'network', 'production_edges', count(*) from fgp union all select 'network', 'utilization_edges', count(*) from fgu
"""


@query("k5_report", sql(REPORT))
def k5(spark: S, d: str) -> DataFrame:
    groups, made, used = adapter.layers(spark, d)
    size = F.col("strain_count")
    wide = groups.agg(F.count("*").cast("double").alias("n_groups"), F.round(F.avg(size), 6).alias("mean_size"), F.max(size).cast("double").alias("max_size"))
    edges = made.agg(F.count("*").cast("double").alias("production_edges")).crossJoin(used.agg(F.count("*").cast("double").alias("utilization_edges")))

    def long(df: DataFrame, section: str) -> DataFrame:
        return df.select(F.lit(section).alias("section"), F.explode(F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(c))])).alias("metric", "value"))

    return long(wide, "groups").unionByName(long(edges, "network"))


# Projection, filter, predicate.


@query("p1_nonzero_groups", sql("select strain, grp, count(*) as n from syn where grp <> 0 group by all"))
def p1(spark: S, d: str) -> DataFrame:
    return tables.made(spark, d).where("grp <> 0").groupBy("strain", "grp").agg(F.count("*").alias("n"))


@query("p2_non_null_groups", sql("select strain, grp, count(*) as n from rec where grp is not null group by all"))
def p2(spark: S, d: str) -> DataFrame:
    return tables.taken(spark, d).where("grp is not null").groupBy("strain", "grp").agg(F.count("*").alias("n"))


@query("p3_conservative_filter", sql("select strain, nv, nu from sigs where nv > 0 or nu > 0"))
def p3(spark: S, d: str) -> DataFrame:
    return repertoire.conservative(adapter.repertoires(spark, d)).select("strain", F.col("n_validated_groups").alias("nv"), F.col("n_usable_items").alias("nu"))


@query("p4_member_of_list", "select p_partkey, p_size from part where p_size in (3, 8, 30)")
def p4(spark: S, d: str) -> DataFrame:
    return tables.read(spark, d, "part").where(F.col("p_size").isin(3, 8, 30)).select("p_partkey", "p_size")


@query("p5_member_of_column", sql("select strain, grp, grp in (select pyov from pairs) as known from (select distinct strain, grp from syn where grp <> 0)"))
def p5(spark: S, d: str) -> DataFrame:
    known = adapter.lookup(spark, d).select(F.col("pyov").alias("grp")).distinct().withColumn("k", F.lit(True))
    return tables.made(spark, d).where("grp <> 0").distinct().join(known, "grp", "left").select("strain", "grp", F.coalesce("k", F.lit(False)).alias("known"))


@query("p6_split_edges", sql("select source, target from edges where edge_type = 'production' and source_type = 'FG' and target_type = 'PYO'"))
def p6(spark: S, d: str) -> DataFrame:
    return adapter.edge_table(spark, d).where("edge_type = 'production' and source_type = 'FG' and target_type = 'PYO'").select("source", "target")


@query("p7_flip_orientation", sql("select target as agent, source as item from edges where edge_type = 'utilization'"))
def p7(spark: S, d: str) -> DataFrame:
    return network.edges_of(adapter.edge_table(spark, d), "utilization")


@query("p8_project_rename", "select c_custkey as customer_id, c_name as label, c_acctbal * 2 as twice from customer")
def p8(spark: S, d: str) -> DataFrame:
    return tables.read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").withColumnsRenamed({"c_custkey": "customer_id", "c_name": "label"}).withColumn("twice", F.col("c_acctbal") * 2).drop("c_acctbal")


@query("p9_pick_present_columns", "select n_name, n_regionkey from nation")
def p9(spark: S, d: str) -> DataFrame:
    return present(tables.read(spark, d, "nation"), "n_label", "n_name", "n_regionkey")


@query("p12_positive_filter", sql("select p, count(*) as degree from util group by p having count(*) > 0"))
def p12(spark: S, d: str) -> DataFrame:
    return network.degrees(adapter.util(spark, d), "p").where("degree > 0").withColumnRenamed("node", "p")


@query("p13_regex_predicate", "select p_partkey, p_type from part where regexp_matches(p_type, '(?i)^eco.*y$')")
def p13(spark: S, d: str) -> DataFrame:
    return tables.read(spark, d, "part").where(F.col("p_type").rlike("(?i)^eco.*y$")).select("p_partkey", "p_type")


@query("p14_prefix_type", sql("select node, case when starts_with(node, 'FG_') then 'FG' when starts_with(node, 'PYO_') then 'PYO' else 'UNKNOWN' end as node_type from (select source as node from edges union select target from edges)"))
def p14(spark: S, d: str) -> DataFrame:
    edges = adapter.edge_table(spark, d)
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    return nodes.withColumn("node_type", F.when(F.col("node").startswith("FG_"), "FG").when(F.col("node").startswith("PYO_"), "PYO").otherwise("UNKNOWN"))


@query("p15_finite_filter", "select event_id from events where value / nullif(value - round(value), 0) is not null")
def p15(spark: S, d: str) -> DataFrame:
    off = F.col("value") - F.round("value")
    x = F.when(off != 0, F.col("value") / off).when(F.col("value") > 0, float("inf")).otherwise(float("nan"))
    return tables.read(spark, d, "events").withColumn("x", x).where(sets.finite(F.col("x"))).select("event_id")


@query("p16_count_by_predicate", sql("select count(*) filter (np > 0) as raw, count(*) filter (nv > 0) as validated, count(*) filter (nv > 1) as multi, count(*) filter (nu > 0) as usable from sigs"))
def p16(spark: S, d: str) -> DataFrame:
    rep = adapter.repertoires(spark, d)
    return rep.agg(F.count_if(F.col("n_production_groups") > 0).alias("raw"), F.count_if("is_producer").alias("validated"), F.count_if("is_multi_producer").alias("multi"), F.count_if(F.col("n_usable_items") > 0).alias("usable"))


# Joins.


@query("j1_left_one_to_one", sql("select s.strain, coalesce(a.n, 0) as n_made, coalesce(b.n, 0) as n_taken from strains s left join (select strain, count(*) as n from syn group by 1) a using (strain) left join (select strain, count(*) as n from rec group by 1) b using (strain)"))
def j1(spark: S, d: str) -> DataFrame:
    made, taken = (f(spark, d).groupBy("strain").agg(F.count("*").alias(n)) for f, n in ((tables.made, "n_made"), (tables.taken, "n_taken")))
    return made.join(taken, "strain", "full").select("strain", F.coalesce("n_made", F.lit(0)).alias("n_made"), F.coalesce("n_taken", F.lit(0)).alias("n_taken"))


@query("j2_left_many_to_one", sql("select s.strain, f.group_id from sigs s left join fg f using (signature)"))
def j2(spark: S, d: str) -> DataFrame:
    signed = repertoire.signed(adapter.repertoires(spark, d)).select("strain", "signature")
    return signed.join(adapter.groups(spark, d).select("signature", "group_id"), "signature", "left").select("strain", "group_id")


@query("j3_left_many_to_many", sql("select r.strain, r.grp, p.pyov, count(*) as n from (select distinct strain, grp from rec) r left join pairs p on p.rec = r.grp group by all"))
def j3(spark: S, d: str) -> DataFrame:
    pairs = adapter.lookup(spark, d).select(F.col("rec").alias("grp"), "pyov")
    return tables.taken(spark, d).distinct().join(pairs, "grp", "left").groupBy("strain", "grp", "pyov").agg(F.count("*").alias("n"))


@query("j4_translate_receptors", sql("select strain, array_to_string(ug, ',') as usable from rep where len(ug) > 0"))
def j4(spark: S, d: str) -> DataFrame:
    return adapter.util(spark, d).groupBy("strain").agg(sets.gathered(F.col("p")).alias("u")).select("strain", joined("u").alias("usable"))


@query("j5_two_key_flag", sql("select u.agent, u.node_id as item, p.agent is not null as makes from fgu u left join fgp p on p.agent = u.agent and p.node_id = u.node_id"))
def j5(spark: S, d: str) -> DataFrame:
    _, made, used = adapter.layers(spark, d)
    return used.join(made.withColumn("m", F.lit(True)), ["agent", "item"], "left").select("agent", "item", F.coalesce("m", F.lit(False)).alias("makes"))


@query("j6_left_differing_keys", "select c_custkey, n_name from customer left join nation on c_nationkey = n_nationkey")
def j6(spark: S, d: str) -> DataFrame:
    c, n = tables.read(spark, d, "customer"), tables.read(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select("c_custkey", "n_name")


@query("j7_chain_of_left_joins", "select o_orderkey, c_name, n_name, r_name from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def j7(spark: S, d: str) -> DataFrame:
    o, c, n, r = (tables.read(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    return o.join(c, o.o_custkey == c.c_custkey, "left").join(n, F.col("c_nationkey") == n.n_nationkey, "left").join(r, F.col("n_regionkey") == r.r_regionkey, "left").select("o_orderkey", "c_name", "n_name", "r_name")


@query("j8_inner_merge", sql("select p.agent, p.node_id as item from fgp p join fgu u on p.agent = u.agent and p.node_id = u.node_id"))
def j8(spark: S, d: str) -> DataFrame:
    _, made, used = adapter.layers(spark, d)
    return made.join(used, ["agent", "item"])


@query("j9_two_lookups_of_one_dictionary", sql("select e.source, e.target, a.k as source_rank, b.k as target_rank from edges e join nodes a on a.node = e.source join nodes b on b.node = e.target".replace("select", ", nodes as (select node, row_number() over (order by node) as k from (select source as node from edges union select target from edges)) select", 1)))
def j9(spark: S, d: str) -> DataFrame:
    edges = network.saved(adapter.edge_table(spark, d))
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    nodes = network.saved(network.numbered(nodes, "k", "node"))
    a, b = (nodes.select(F.col("node").alias(side), F.col("k").alias(f"{side}_rank")) for side in ("source", "target"))
    return edges.join(a, "source").join(b, "target").select("source", "target", "source_rank", "target_rank")


@query("j10_repeated_keys", sql("select strain, grp from (select distinct strain, grp from rec) where strain in (select strain from (select distinct strain, grp from rec) group by 1 having count(*) > 1)"))
def j10(spark: S, d: str) -> DataFrame:
    rows = tables.taken(spark, d).distinct()
    return rows.join(rows.groupBy("strain").agg(F.count("*").alias("n")).where("n > 1"), "strain", "left_semi").select("strain", "grp")


@query("j11_unresolved", sql("select distinct grp from rec where grp not in (select rec from pairs)"))
def j11(spark: S, d: str) -> DataFrame:
    return tables.taken(spark, d).select("grp").distinct().join(adapter.lookup(spark, d).select(F.col("rec").alias("grp")), "grp", "left_anti")


@query("j12_first_match", sql("select r.grp, min(p.pair_id) as pair_id from (select distinct grp from rec) r left join pairs p on p.rec = r.grp group by 1"))
def j12(spark: S, d: str) -> DataFrame:
    first = adapter.lookup(spark, d).groupBy(F.col("rec").alias("grp")).agg(F.min("pair_id").alias("pair_id"))
    return tables.taken(spark, d).select("grp").distinct().join(first, "grp", "left")


@query("j13_cross_product_of_pairs", sql("select pair_id, pyov, rec from pairs"))
def j13(spark: S, d: str) -> DataFrame:
    return adapter.lookup(spark, d)


@query("j16_self_producers", sql("select p.agent, string_agg(p.node_id, ',' order by p.node_id) as items from fgp p join fgu u on p.agent = u.agent and p.node_id = u.node_id group by 1"))
def j16(spark: S, d: str) -> DataFrame:
    _, made, used = adapter.layers(spark, d)
    both = made.join(used, ["agent", "item"]).groupBy("agent").agg(F.array_sort(F.collect_list("item")).alias("i"))
    return both.select("agent", joined("i").alias("items"))


# Aggregates.


@query("a1_distinct_set", sql("select strain, array_to_string(list_sort(list(distinct grp)), ',') as grps, count(distinct grp) as n from syn where grp <> 0 group by 1"))
def a1(spark: S, d: str) -> DataFrame:
    g = tables.made(spark, d).where("grp <> 0").groupBy("strain").agg(sets.gathered(F.col("grp")).alias("g"))
    return g.select("strain", joined("g").alias("grps"), F.size("g").cast("long").alias("n"))


@query("a2_collapse", sql("select group_id, signature, strain_count, nv, nu from fg"))
def a2(spark: S, d: str) -> DataFrame:
    return repertoire.collapsed(adapter.repertoires(spark, d)).select("group_id", "signature", "strain_count", F.col("n_validated_groups").alias("nv"), F.col("n_usable_items").alias("nu"))


@query("a3_member_lists", sql("select signature, string_agg(strain, ',' order by strain) as strains, count(*) as n from sigs where nv > 0 or nu > 0 group by 1"))
def a3(spark: S, d: str) -> DataFrame:
    """The lists are the operator's result: a row holds a group's members here, and nowhere else."""
    own = repertoire.signed(repertoire.conservative(adapter.repertoires(spark, d))).groupBy("signature").agg(F.array_sort(F.collect_list("strain")).alias("strains"))
    return own.select("signature", joined("strains").alias("strains"), F.size("strains").cast("long").alias("n"))


@query("a4_consistency_audit", "select p_brand, count(distinct p_type) as n_types, count(distinct p_size) as n_sizes from part group by 1 having count(distinct p_type) > 1 or count(distinct p_size) > 1")
def a4(spark: S, d: str) -> DataFrame:
    return tables.read(spark, d, "part").groupBy("p_brand").agg(F.countDistinct("p_type").alias("n_types"), F.countDistinct("p_size").alias("n_sizes")).where("n_types > 1 or n_sizes > 1")


@query("a5_conditional_sums", "select o_custkey, count(*) filter (o_orderstatus = 'F') as n_f, coalesce(sum(case when o_orderstatus = 'O' then 1 else 0 end), 0)::bigint as n_o, round(sum(case when o_orderstatus = 'F' then o_totalprice else 0 end), 4) as total_f from orders group by 1")
def a5(spark: S, d: str) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    return tables.read(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(done).alias("n_f"), F.sum(F.when(F.col("o_orderstatus") == "O", 1).otherwise(0)).alias("n_o"), F.round(F.sum(F.when(done, F.col("o_totalprice")).otherwise(0.0)), 4).alias("total_f"))


@query("a6_weighted_counts", sql("select u.node_id as item, count(distinct u.agent) as n_groups, cast(sum(s.strain_count) as bigint) as n_strains from fgu u join strat s on s.agent_id = u.agent group by 1"))
def a6(spark: S, d: str) -> DataFrame:
    groups, _, used = adapter.layers(spark, d)
    return used.join(groups.select(F.col("agent_id").alias("agent"), "strain_count"), "agent").groupBy("item").agg(F.countDistinct("agent").alias("n_groups"), F.sum("strain_count").alias("n_strains"))


@query("a7_value_counts", "select event_type, count(*) as n from events group by 1 order by n desc, event_type")
def a7(spark: S, d: str) -> DataFrame:
    return tables.read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@query("a8_share_of_total", "select event_type, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as pct from events group by 1")
def a8(spark: S, d: str) -> DataFrame:
    counts = tables.read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("a9_degrees_with_zeros", sql("select s.agent_id as node, count(p.node_id) as degree from strat s left join fgp p on p.agent = s.agent_id group by 1"))
def a9(spark: S, d: str) -> DataFrame:
    groups, made, _ = adapter.layers(spark, d)
    return network.degrees(made, "agent", groups, "agent_id")


@query("a10_degree_summary", sql("select count(*) as n, min(d) as min, quantile_cont(d, 0.25) as q25, quantile_cont(d, 0.5) as median, quantile_cont(d, 0.75) as q75, round(avg(d), 6) as mean, max(d) as max, round(stddev_samp(d), 6) as sd, count(*) filter (d = 0) as zeros, count(*) filter (d > 0) as nonzero, round(count(*) filter (d > 0) / count(*), 6) as proportion_nonzero from (select s.strain, count(u.p) as d from strains s left join util u using (strain) group by 1)"))
def a10(spark: S, d: str) -> DataFrame:
    rep = adapter.repertoires(spark, d).select(F.col("n_usable_items").alias("degree"))
    return network.degree_summary(rep)


@query("a11_first_value", "select c_nationkey, min(c_name) as example, min_by(c_name, c_acctbal) as poorest from customer group by 1")
def a11(spark: S, d: str) -> DataFrame:
    """The first name of each nation and its poorest customer; of equal balances the one with the least key, which is first in the table."""
    known = F.col("c_name").isNotNull() & F.col("c_acctbal").isNotNull()
    return tables.read(spark, d, "customer").groupBy("c_nationkey").agg(F.min("c_name").alias("example"), F.min_by("c_name", F.when(known, F.struct("c_acctbal", "c_custkey"))).alias("poorest"))


@query("a12_support_count", sql("select pyov, pair_id, count(distinct case when rec > 5 then rec end) as support from pairs group by all"))
def a12(spark: S, d: str) -> DataFrame:
    return adapter.lookup(spark, d).groupBy("pyov", "pair_id").agg(F.countDistinct(F.when(F.col("rec") > 5, F.col("rec"))).alias("support"))


ACTIVITY = """
select pair_id, count(*) as n, count(*) filter (active) as n_active, round(count(*) filter (active) / count(*), 6) as proportion,
  array_to_string(list_sort(list(pyov))[1:10], ',') as sample
from (select distinct pair_id, pyov, pyov in (select p from prod) as active from pairs) group by 1
"""


@query("a13_pair_activity", sql(ACTIVITY))
def a13(spark: S, d: str) -> DataFrame:
    active = adapter.prod(spark, d).select(F.col("p").alias("pyov")).distinct().withColumn("a", F.lit(True))
    items = adapter.lookup(spark, d).select("pair_id", "pyov").distinct().join(active, "pyov", "left").withColumn("a", F.coalesce("a", F.lit(False)))
    return items.groupBy("pair_id").agg(F.count("*").alias("n"), F.count_if("a").alias("n_active"), F.round(F.count_if("a") / F.count("*"), 6).alias("proportion"), F.array_join(F.slice(F.array_sort(F.collect_list("pyov")), 1, 10), ",").alias("sample"))


COVERAGE = """
, cov as (
  select distinct pair_id, group_id, strain_count, kind from (
    select x.pair_id, s.group_id, s.strain_count, 'p' as kind from strat s join fgp e using (group_id) join (select distinct pair_id, pyov from pairs) x on x.pyov = e.item
    union all select x.pair_id, s.group_id, s.strain_count, 'u' from strat s join fgu e using (group_id) join (select distinct pair_id, pyov from pairs) x on x.pyov = e.item))
select pair_id, count(*) filter (kind = 'p') as producing_groups, cast(coalesce(sum(strain_count) filter (kind = 'p'), 0) as bigint) as producing_strains,
  count(*) filter (kind = 'u') as using_groups, cast(coalesce(sum(strain_count) filter (kind = 'u'), 0) as bigint) as using_strains from cov group by 1
"""


@query("a14_pair_coverage", sql(COVERAGE))
def a14(spark: S, d: str) -> DataFrame:
    groups = adapter.groups(spark, d)
    pair = adapter.lookup(spark, d).select("pair_id", F.col("pyov").alias("item")).distinct()
    either = groups.select("group_id", "strain_count", F.lit("p").alias("kind"), F.explode("validated_groups").alias("item")).union(groups.select("group_id", "strain_count", F.lit("u"), F.explode("usable_items")))
    own = either.join(pair, "item").select("pair_id", "group_id", "strain_count", "kind").distinct()
    parts = [x for k, n in (("p", "producing"), ("u", "using")) for x in (F.count_if(F.col("kind") == k).alias(f"{n}_groups"), F.sum(F.when(F.col("kind") == k, F.col("strain_count")).otherwise(0)).alias(f"{n}_strains"))]
    return own.groupBy("pair_id").agg(*parts)


@query("a15_global_aggregates", sql("select count(*) as n_groups, cast(sum(strain_count) as bigint) as n_strains, round(avg(strain_count), 6) as mean_size, max(strain_count) as max_size, min(strain_count) as min_size from fg"))
def a15(spark: S, d: str) -> DataFrame:
    size = F.col("strain_count")
    return adapter.groups(spark, d).agg(F.count("*").alias("n_groups"), F.sum(size).alias("n_strains"), F.round(F.avg(size), 6).alias("mean_size"), F.max(size).alias("max_size"), F.min(size).alias("min_size"))


@query("a16_union_of_lists", sql("select distinct unnest(ug) as item from rep"))
def a16(spark: S, d: str) -> DataFrame:
    return adapter.repertoires(spark, d).select(F.explode("usable_items").alias("item")).distinct()


SEGMENTS = ("automobile", "building", "furniture", "household", "machinery")


@query("a17_cross_table", "select c_nationkey, " + ", ".join(f"count(*) filter (lower(c_mktsegment) = '{s}') as {s}" for s in SEGMENTS) + " from customer group by 1")
def a17(spark: S, d: str) -> DataFrame:
    """A column for every segment that there is, in order."""
    customers = tables.read(spark, d, "customer").select("c_nationkey", F.lower("c_mktsegment").alias("segment"))
    return customers.groupBy("c_nationkey").pivot("segment").count().na.fill(0)


@query("a18_fixed_histogram", sql("select cast(floor(d) as bigint) as bin, count(*) as n from (select count(*) as d from util group by strain) group by 1"))
def a18(spark: S, d: str) -> DataFrame:
    return network.degrees(adapter.util(spark, d), "strain").groupBy(F.floor("degree").alias("bin")).agg(F.count("*").alias("n"))


LOG_BINS = """
, deg as (select count(*) as d from util group by strain), lo as (select floor(log10(min(d)) / 0.2) * 0.2 as lo from deg)
select cast(greatest(ceil(round((log10(d) - lo) / 0.2, 9)), 1) as bigint) as bin, count(*) as n, round(pow(10, lo + 0.2 * (greatest(ceil(round((log10(d) - lo) / 0.2, 9)), 1) - 0.5)), 6) as mid
from deg, lo where d > 0 group by all
"""


@query("a19_log_histogram", sql(LOG_BINS))
def a19(spark: S, d: str) -> DataFrame:
    deg = network.degrees(adapter.util(spark, d), "strain").where("degree > 0")
    low = deg.agg((F.floor(F.log10(F.min("degree").cast("double")) / 0.2) * F.lit(0.2)).alias("lo"))
    bin_ = F.greatest(F.ceil(F.round((F.log10(F.col("degree").cast("double")) - F.col("lo")) / 0.2, 9)), F.lit(1))
    placed = deg.crossJoin(F.broadcast(low)).select(bin_.cast("long").alias("bin"), "lo")
    return placed.groupBy("bin", "lo").agg(F.count("*").alias("n")).select("bin", "n", F.round(F.pow(F.lit(10.0), F.col("lo") + 0.2 * (F.col("bin") - 0.5)), 6).alias("mid"))


REPS = "select item as replicate, count(*) / 97.0 as x from wide group by item"


def replicate_series(spark: S, d: str) -> DataFrame:
    """(replicate, x): a value between 0 and 1 for each of the few items of the wide layer, in the place of replicates of a null model."""
    return tables.wide(spark, d).groupBy(F.col("item").alias("replicate")).agg((F.count("*") / F.lit(97.0)).alias("x"))


@query("a20_replicate_summary", sql(f"select round(avg(x), 9) as mean, round(stddev_samp(x), 9) as sd, round(min(x), 9) as min, round(max(x), 9) as max from ({REPS})"))
def a20(spark: S, d: str) -> DataFrame:
    x = F.col("x")
    return replicate_series(spark, d).agg(*[F.round(f(x), 9).alias(n) for n, f in (("mean", F.avg), ("sd", F.stddev_samp), ("min", F.min), ("max", F.max))])


@query("a21_median_range", sql(f"select round(quantile_cont(x, 0.5), 9) as median, round(max(x) - min(x), 9) as range from ({REPS})"))
def a21(spark: S, d: str) -> DataFrame:
    return replicate_series(spark, d).agg(F.round(F.percentile("x", F.lit(0.5)), 9).alias("median"), F.round(F.max("x") - F.min("x"), 9).alias("range"))


@query("a22_joined_values", "select n_regionkey, string_agg(n_name, ',' order by n_name) as nations from nation group by 1")
def a22(spark: S, d: str) -> DataFrame:
    return tables.read(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("nations"))


# Windows and order.


@query("w1_dense_group_id", sql("select signature, group_id from fg"))
def w1(spark: S, d: str) -> DataFrame:
    return repertoire.collapsed(adapter.repertoires(spark, d)).select("signature", "group_id")


@query("w2_formatted_id", sql("select group_id, agent_id from strat"))
def w2(spark: S, d: str) -> DataFrame:
    return adapter.groups(spark, d).select("group_id", "agent_id")


@query("w3_contiguous_index", sql("select item, matrix_index, node_id from items"))
def w3(spark: S, d: str) -> DataFrame:
    return adapter.index(spark, d)


FIRST_SEEN = """
, log as (select o_custkey as strain, l_orderkey as o, l_linenumber as l, l_returnflag as rf, l_tax as tax from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey),
seen as (select strain, 0 as k, o, l from log where rf = 'R' union all select strain, 1, o, l from log where tax >= 0.075),
firsts as (select strain, k, o, l from (select *, row_number() over (partition by strain order by k, o, l) as r from seen) where r = 1)
select strain, printf('STR_%04d', row_number() over (order by k, o, l)) as agent_id from firsts where strain in (select strain from sigs where nv > 0 or nu > 0)
"""


@query("w4_entity_numbers", sql(FIRST_SEEN))
def w4(spark: S, d: str) -> DataFrame:
    """Entities numbered as they first appear: among what is made first, then among what is taken, each in the order of its records."""
    log = tables.records(spark, d, order=True)
    place = lambda k: F.struct(F.lit(k).alias("k"), "o", "l").alias("place")
    seen = log.where("rf = 'R'").select("strain", place(0)).unionByName(log.where("tax >= 0.075").select("strain", place(1)))
    kept = repertoire.conservative(adapter.repertoires(spark, d)).select("strain")
    first = network.first_seen(seen, "strain", "place").join(kept, "strain", "left_semi")
    return network.numbered(first, "index", "place").select("strain", F.format_string(network.ENTITY_ID, "index").alias("agent_id"))


@query("w5_cumulative_share", sql("select group_id, row_number() over w as rank, cast(sum(strain_count) over w as bigint) as running, round(sum(strain_count) over w / sum(strain_count) over (), 6) as share from fg window w as (order by strain_count desc, group_id rows unbounded preceding)"))
def w5(spark: S, d: str) -> DataFrame:
    groups = adapter.groups(spark, d).select("group_id", "strain_count", (-F.col("strain_count")).alias("falling"))
    run = network.running(groups, ["falling", "group_id"], sums={"ahead": F.col("strain_count"), "above": F.lit(1).cast("long")})
    whole = groups.agg(F.sum("strain_count").alias("whole"))
    running = F.col("ahead") + F.col("strain_count")
    return run.crossJoin(F.broadcast(whole)).select("group_id", (F.col("above") + 1).alias("rank"), running.alias("running"), F.round(running / F.col("whole"), 6).alias("share"))


@query("w6_argmax_per_group", sql("select grp, pair_id, support from (select *, row_number() over (partition by grp order by support desc, pair_id) as k from (select p.rec % 7 as grp, p.pair_id, count(distinct p.pyov) as support from pairs p group by all)) where k = 1"))
def w6(spark: S, d: str) -> DataFrame:
    support = adapter.lookup(spark, d).groupBy((F.col("rec") % 7).alias("grp"), "pair_id").agg(F.countDistinct("pyov").alias("support"))
    return support.withColumn("k", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("support"), "pair_id"))).where("k = 1").drop("k")


@query("w7_majority_label", "select c_nationkey, c_mktsegment as label from (select c_nationkey, c_mktsegment, row_number() over (partition by c_nationkey order by count(*) desc, c_mktsegment) as k from customer group by 1, 2) where k = 1")
def w7(spark: S, d: str) -> DataFrame:
    counts = tables.read(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    best = counts.groupBy("c_nationkey").agg(F.min(F.struct((-F.col("n")).alias("n"), "c_mktsegment")).alias("b"))
    return best.select("c_nationkey", F.col("b.c_mktsegment").alias("label"))


@query("w8_ccdf", sql("select d, round(row_number() over (order by d desc) / count(*) over (), 9) as p from (select count(*) as d from util group by strain)"))
def w8(spark: S, d: str) -> DataFrame:
    """The k-th largest of n degrees has p = k / n. Degrees are counted first, so only distinct degrees meet in one task."""
    counts = network.degrees(adapter.util(spark, d), "strain").groupBy(F.col("degree").alias("d")).agg(F.count("*").alias("c"))
    above = F.coalesce(F.sum("c").over(Window.orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.select("d", "c", above.alias("above"), F.sum("c").over(Window.partitionBy()).alias("n"))
    return ranked.select("d", "n", F.explode(F.sequence(F.col("above") + 1, F.col("above") + F.col("c"))).alias("k")).select("d", F.round(F.col("k") / F.col("n"), 9).alias("p"))


@query("w9_degree_order", sql("select agent, row_number() over (order by count(*) desc, agent) as position from wide group by 1"))
def w9(spark: S, d: str) -> DataFrame:
    deg = network.degrees(tables.wide(spark, d), "agent")
    return network.numbered(deg.withColumn("falling", -F.col("degree")), "position", "falling", "node").select(F.col("node").alias("agent"), "position")


@query("w10_module_order", sql("select group_id, row_number() over (order by group_id % 4 = 3, group_id % 4, strain_count desc, group_id) as position from fg"))
def w10(spark: S, d: str) -> DataFrame:
    m = F.col("group_id") % 4
    keyed = adapter.groups(spark, d).select("group_id", (m == 3).alias("last"), m.alias("module"), (-F.col("strain_count")).alias("falling"))
    return network.numbered(keyed, "position", "last", "module", "falling", "group_id").select("group_id", "position")


@query("w11_autocorrelation", sql(f"select round(corr(x, y), 9) as r from (select x, lag(x) over (order by replicate) as y from ({REPS}))"))
def w11(spark: S, d: str) -> DataFrame:
    return replicate_series(spark, d).select("x", F.lag("x").over(Window.orderBy("replicate")).alias("y")).where("y is not null").agg(F.round(inference.correlated(F.col("x"), F.col("y")), 9).alias("r"))


@query("w12_half_means", sql(f"select half, round(avg(x), 9) as mean from (select x, ntile(2) over (order by replicate) as half from ({REPS})) group by 1"))
def w12(spark: S, d: str) -> DataFrame:
    return replicate_series(spark, d).select("x", F.ntile(2).over(Window.orderBy("replicate")).alias("half")).groupBy("half").agg(F.round(F.avg("x"), 9).alias("mean"))


@query("o1_sort_many_keys", "select c_custkey, c_nationkey, c_acctbal from customer order by c_nationkey, c_acctbal desc nulls last, c_custkey")
def o1(spark: S, d: str) -> DataFrame:
    return tables.read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal").orderBy("c_nationkey", F.desc_nulls_last("c_acctbal"), "c_custkey")


@query("o2_top_k", sql("select group_id, strain_count from fg order by strain_count desc, group_id limit 10"))
def o2(spark: S, d: str) -> DataFrame:
    return adapter.groups(spark, d).select("group_id", "strain_count").orderBy(F.desc("strain_count"), "group_id").limit(10)


@query("o3_largest_rows", sql("select group_id, strain_count from fg where strain_count = (select max(strain_count) from fg)"))
def o3(spark: S, d: str) -> DataFrame:
    groups = adapter.groups(spark, d).select("group_id", "strain_count")
    return groups.join(F.broadcast(groups.agg(F.max("strain_count").alias("strain_count"))), "strain_count").select("group_id", "strain_count")


@query("o4_seeded_sample")
def o4(spark: S, d: str) -> DataFrame:
    """Ten rows drawn by a hash of key and seed: the same rows however the table is dealt."""
    return tables.read(spark, d, "customer").select("c_custkey", "c_name").orderBy(F.xxhash64("c_custkey", F.lit(42)), "c_custkey").limit(10)


# Set operations.


@query("u1_union_distinct", sql("select strain from syn union select strain from rec"))
def u1(spark: S, d: str) -> DataFrame:
    return tables.made(spark, d).select("strain").union(tables.taken(spark, d).select("strain")).distinct()


@query("u2_intersect", sql("select strain from syn where grp <> 0 intersect select strain from rec"))
def u2(spark: S, d: str) -> DataFrame:
    return tables.made(spark, d).where("grp <> 0").select("strain").intersect(tables.taken(spark, d).select("strain"))


@query("u3_except_both_ways", sql("select 'made' as side, strain from (select strain from syn where grp <> 0 except select strain from rec) union all select 'taken', strain from (select strain from rec except select strain from syn where grp <> 0)"))
def u3(spark: S, d: str) -> DataFrame:
    a, b = tables.made(spark, d).where("grp <> 0").select("strain"), tables.taken(spark, d).select("strain")
    return a.subtract(b).select(F.lit("made").alias("side"), "strain").union(b.subtract(a).select(F.lit("taken"), "strain"))


@query("u4_bag_union", sql("select kind, count(*) as n from (select 'prod' as kind, strain, p from prod union all select 'util', strain, p from util) group by 1"))
def u4(spark: S, d: str) -> DataFrame:
    both = adapter.prod(spark, d).withColumn("kind", F.lit("prod")).unionByName(adapter.util(spark, d).withColumn("kind", F.lit("util")))
    return both.groupBy("kind").agg(F.count("*").alias("n"))


@query("u5_distinct", "select distinct c_nationkey, c_mktsegment from customer")
def u5(spark: S, d: str) -> DataFrame:
    return tables.read(spark, d, "customer").select("c_nationkey", "c_mktsegment").dropDuplicates()


@query("u6_disjoint_names", sql("select count(*) = 0 as disjoint from (select agent_id from strat intersect select node_id from items)"))
def u6(spark: S, d: str) -> DataFrame:
    shared = adapter.groups(spark, d).select("agent_id").intersect(adapter.index(spark, d).select("node_id"))
    return shared.agg((F.count("*") == 0).alias("disjoint"))


@query("u7_either_layer", sql("select agent, node_id as item from fgp union select agent, node_id from fgu"))
def u7(spark: S, d: str) -> DataFrame:
    _, made, used = adapter.layers(spark, d)
    return made.union(used).distinct()


# Functions.


@query("f1_signature", sql("select strain, (case when np = 0 then '0' else array_to_string(pg, ',') end) || '|' || (case when nu = 0 then 'none' else array_to_string(ug, ',') end) as raw, signature from sigs"))
def f1(spark: S, d: str) -> DataFrame:
    rep = adapter.repertoires(spark, d)
    return repertoire.signed(repertoire.signed(rep, raw=True).withColumnRenamed("signature", "raw")).select("strain", "raw", "signature")


@query("f2_intersect_with_valid", sql("select strain, array_to_string(list_sort(list_intersect(pg, vg)), ',') as valid from rep"))
def f2(spark: S, d: str) -> DataFrame:
    return adapter.repertoires(spark, d).select("strain", F.array_join(F.array_sort(F.array_intersect("production_groups", "validated_groups")), ",").alias("valid"))


@query("f3_overlap", sql("select strain, list_has_any(vg, ug) as overlaps, array_to_string(list_sort(list_intersect(vg, ug)), ',') as both from rep"))
def f3(spark: S, d: str) -> DataFrame:
    return adapter.repertoires(spark, d).select("strain", F.arrays_overlap("validated_groups", "usable_items").alias("overlaps"), F.array_join(F.array_sort(F.array_intersect("validated_groups", "usable_items")), ",").alias("both"))


@query("f4_list_length", sql("select strain, len(rg) as n from rep"))
def f4(spark: S, d: str) -> DataFrame:
    return adapter.repertoires(spark, d).select("strain", sets.count_of(F.col("receptor_groups")).cast("long").alias("n"))


@query("f5_null_to_empty", sql("select s.strain, len(coalesce(l, [])) as n from strains s left join (select strain, list(p) as l from prod group by 1) using (strain)"))
def f5(spark: S, d: str) -> DataFrame:
    lists = adapter.prod(spark, d).groupBy("strain").agg(F.collect_list("p").alias("l"))
    everyone = tables.made(spark, d).select("strain").union(tables.taken(spark, d).select("strain")).distinct()
    return everyone.join(lists, "strain", "left").select("strain", F.size(sets.canonical(F.col("l"))).cast("long").alias("n"))


@query("f6_unnest_keep_empty", sql("select strain, unnest(case when len(vg) = 0 then [null] else vg end) as item from rep"))
def f6(spark: S, d: str) -> DataFrame:
    return adapter.repertoires(spark, d).select("strain", F.explode_outer("validated_groups").alias("item"))


@query("f7_flatten_nested", sql("select pair_id, unnest(flatten([list_sort(list(distinct pyov)), list_sort(list(distinct rec))])) as x from pairs group by 1"))
def f7(spark: S, d: str) -> DataFrame:
    return tables.pair_lists(spark, d).select("pair_id", F.explode(F.transform(F.flatten(F.array("pyov", "rec")), lambda x: x.cast("string").try_cast("int"))).alias("x"))


@query("f8_split_to_integers", "select p_partkey, try_cast(part as int) as n from (select p_partkey, unnest(string_split(p_brand || '#x', '#')) as part from part) where try_cast(part as int) is not null")
def f8(spark: S, d: str) -> DataFrame:
    return tables.read(spark, d, "part").select("p_partkey", F.explode(sets.parsed(F.concat("p_brand", F.lit("#x")), "#")).alias("n"))


@query("f9_first_match_case", sql("select group_id, strategy from strat"))
def f9(spark: S, d: str) -> DataFrame:
    return adapter.groups(spark, d).select("group_id", "strategy")


COLOURS = {"Multi-producer": "magenta", "Single-receptor producer": "blue", "Multi-receptor producer": "green", "Nonproducer": "red"}


@query("f10_label_map", sql("select group_id, case strategy " + " ".join(f"when '{k}' then '{v}'" for k, v in COLOURS.items()) + " else 'grey' end as colour from strat"))
def f10(spark: S, d: str) -> DataFrame:
    colour = F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])
    return adapter.groups(spark, d).select("group_id", F.coalesce(F.try_element_at(colour, F.col("strategy")), F.lit("grey")).alias("colour"))


@query("f11_formatting", sql("select printf('FG_%03d', group_id) as id, concat_ws(' / ', strategy, cast(strain_count as varchar)) as label from strat"))
def f11(spark: S, d: str) -> DataFrame:
    return adapter.groups(spark, d).select(F.format_string("FG_%03d", "group_id").alias("id"), F.concat_ws(" / ", "strategy", F.col("strain_count").cast("string")).alias("label"))


@query("f12_prefix_counts", "select substr(c_name, 1, 10) as prefix, count(*) as n from customer group by 1")
def f12(spark: S, d: str) -> DataFrame:
    return tables.read(spark, d, "customer").groupBy(F.substring("c_name", 1, 10).alias("prefix")).agg(F.count("*").alias("n"))


@query("f13_trim_lower", "select p_partkey, lower(trim('  ' || p_type || ' ')) as t from part")
def f13(spark: S, d: str) -> DataFrame:
    return tables.read(spark, d, "part").select("p_partkey", F.lower(F.trim(F.concat(F.lit("  "), "p_type", F.lit(" ")))).alias("t"))


@query("f14_coalesce", "select c_custkey, coalesce(nullif(c_nationkey, 2), -1) as nation from customer")
def f14(spark: S, d: str) -> DataFrame:
    return tables.read(spark, d, "customer").select("c_custkey", F.coalesce(F.nullif("c_nationkey", F.lit(2)), F.lit(-1)).alias("nation"))


RATIO = "select i.item, coalesce(u.n, 0) as users, coalesce(p.n, 0) as makers, case when coalesce(p.n, 0) > 0 then round(coalesce(u.n, 0) / p.n, 9) else 'Infinity'::double end as ratio from items i left join (select p as item, count(*) as n from util group by 1) u using (item) left join (select p as item, count(*) as n from prod group by 1) p using (item)"


@query("f15_guarded_ratio", sql(RATIO))
def f15(spark: S, d: str) -> DataFrame:
    users = adapter.util(spark, d).groupBy(F.col("p").alias("item")).agg(F.count("*").alias("users"))
    makers = adapter.prod(spark, d).groupBy(F.col("p").alias("item")).agg(F.count("*").alias("makers"))
    out = adapter.index(spark, d).select("item").join(users, "item", "left").join(makers, "item", "left").na.fill(0, ["users", "makers"])
    return out.withColumn("ratio", F.round(sets.ratio(F.col("users"), F.col("makers")), 9))


@query("f16_fraction", "select o_custkey, round(count(*) filter (o_orderstatus = 'F') / nullif(count(*) filter (o_orderstatus <> 'P'), 0), 9) as share from orders group by 1")
def f16(spark: S, d: str) -> DataFrame:
    counts = tables.read(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") != "P").alias("n"))
    return counts.select("o_custkey", F.round(sets.fraction(F.col("f"), F.col("n")), 9).alias("share"))


@query("f17_math", sql("select group_id, round(greatest(3, 2 * sqrt(strain_count)), 9) as size, round(log10(strain_count), 9) as lg, least(nv, nu) as lo, abs(nv - nu) as gap from fg"))
def f17(spark: S, d: str) -> DataFrame:
    n, v, u = (F.col(c) for c in ("strain_count", "n_validated_groups", "n_usable_items"))
    return adapter.groups(spark, d).select("group_id", F.round(F.greatest(F.lit(3.0), 2 * F.sqrt(n.cast("double"))), 9).alias("size"), F.round(F.log10(n.cast("double")), 9).alias("lg"), F.least(v, u).alias("lo"), F.abs(v - u).alias("gap"))


@query("f18_shorten_segments", "select o_orderkey, round(x + 0.03 * dx, 6) as x1, round(y + 0.03 * dy, 6) as y1, round(x + 0.9 * dx, 6) as x2, round(y + 0.9 * dy, 6) as y2 from (select o_orderkey, o_custkey % 10 as x, o_custkey % 7 as y, o_orderkey % 13 - o_custkey % 10 as dx, o_orderkey % 11 - o_custkey % 7 as dy from orders)")
def f18(spark: S, d: str) -> DataFrame:
    o = tables.read(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 10).alias("x"), (F.col("o_custkey") % 7).alias("y"), (F.col("o_orderkey") % 13 - F.col("o_custkey") % 10).alias("dx"), (F.col("o_orderkey") % 11 - F.col("o_custkey") % 7).alias("dy"))
    at = lambda c, s: F.round(F.col(c) + s * F.col(f"d{c}"), 6)
    return o.select("o_orderkey", at("x", 0.03).alias("x1"), at("y", 0.03).alias("y1"), at("x", 0.9).alias("x2"), at("y", 0.9).alias("y2"))


@query("f20_pearson", "select round(corr(l_quantity, l_extendedprice), 6) as r from lineitem")
def f20(spark: S, d: str) -> DataFrame:
    return tables.read(spark, d, "lineitem").agg(F.round(inference.correlated(F.col("l_quantity"), F.col("l_extendedprice")), 6).alias("r"))


PEARSON = f"""
, c as (select i.item, coalesce(u.n, 0) as users, coalesce(p.n, 0) as makers from items i left join (select p, count(*) as n from util group by 1) u on u.p = i.item left join (select p, count(*) as n from prod group by 1) p on p.p = i.item),
r as (select count(*) as n, corr(users, makers) as r from c),
a as (select n, r, atan(abs(r * sqrt((n - 2) / (1 - r * r))) / sqrt(n - 2)) as a from r)
select n, round(r, 9) as r, round({simpson_sql("pow(greatest(cos(t), 0), n - 3)", "a", "pi() / 2")} / ({simpson_sql("pow(greatest(cos(t), 0), n - 3)", "0", "pi() / 2")}), 6) as p from a
"""


@query("f20b_pearson_p", sql(PEARSON))
def f20b(spark: S, d: str) -> DataFrame:
    """r with its two-sided p over the few items: users against makers."""
    users = adapter.util(spark, d).groupBy(F.col("p").alias("item")).agg(F.count("*").alias("users"))
    makers = adapter.prod(spark, d).groupBy(F.col("p").alias("item")).agg(F.count("*").alias("makers"))
    both = adapter.index(spark, d).select("item").join(users, "item", "left").join(makers, "item", "left").na.fill(0)
    return inference.correlation(both, "users", "makers").select("n", F.round("r", 9).alias("r"), F.round("p", 6).alias("p"))


@query("f21_trend", sql(f"select round(corr(replicate, x), 9) as r from ({REPS})"))
def f21(spark: S, d: str) -> DataFrame:
    return replicate_series(spark, d).agg(F.round(inference.correlated(F.col("replicate"), F.col("x")), 9).alias("r"))


@query("f22_first_present_column", "select c_custkey, c_name as entity from customer")
def f22(spark: S, d: str) -> DataFrame:
    """The column of the first of several names that the table has."""
    customers = tables.read(spark, d, "customer")
    return customers.select("c_custkey", F.col(first_present(customers, "strain", "entity", "c_name", "c_custkey")).alias("entity"))


@query("f23_context_flags", sql("select group_id, coalesce(strain_count >= 30, false) as large, group_id % 12 in (0, 3, 8) as major from fg"))
def f23(spark: S, d: str) -> DataFrame:
    return adapter.groups(spark, d).select("group_id", F.coalesce(F.col("strain_count") >= 30, F.lit(False)).alias("large"), (F.col("group_id") % 12).isin(0, 3, 8).alias("major"))
