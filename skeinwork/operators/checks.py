"""Checks of a network before it is measured, each a row (name, passed, severity).

A layer is a table of edges (agent, item); its dictionaries say which agents and items
there are. All checks of a layer come from one grouping of its edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions import sets


def told(df: DataFrame, *checks: tuple[str, Column, str]) -> DataFrame:
    """The aggregate conditions (name, condition, severity) over df, a row each; what is null has not passed."""
    one = df.agg(*[F.coalesce(passed, F.lit(False)).alias(f"c{k}") for k, (_, passed, _) in enumerate(checks)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"c{k}").alias("passed"), F.lit(severity).alias("severity")) for k, (name, _, severity) in enumerate(checks)])))


def layer_checks(edges: DataFrame, agents: DataFrame, items: DataFrame, level: str, kind: str, exists: str) -> DataFrame:
    """Checks of one layer against its dictionaries agents (agent) and items (item)."""
    name = f"{kind}_{level}"
    cells = edges.groupBy("agent", "item").agg(F.count("*").alias("n"))
    known = cells.join(agents.select("agent", F.lit(True).alias("is_agent")).distinct(), "agent", "left").join(items.select("item", F.lit(True).alias("is_item")).distinct(), "item", "left")
    return told(
        known,
        (f"exists_adj_{name}", F.count("*") > 0, exists),
        (f"{name}_agents_match_nodes", F.count_if(F.col("agent").isNotNull() & F.col("is_agent").isNull()) == 0, "critical"),
        (f"{name}_items_match_nodes", F.count_if(F.col("item").isNotNull() & F.col("is_item").isNull()) == 0, "critical"),
        (f"binary_adj_{name}", F.coalesce(F.max("n"), F.lit(1)) == 1, "critical"),
        (f"no_null_adj_{name}", F.count_if(F.col("agent").isNull() | F.col("item").isNull()) == 0, "critical"),
    )


def spelling(edges: DataFrame, level: str, agent: str, item: str) -> DataFrame:
    """Whether the ids of a layer are spelled as its dictionaries spell them."""
    return told(
        edges,
        (f"prod_{level}_agent_names_align", F.count_if(~F.col("agent").cast("string").rlike(agent)) == 0, "warning"),
        (f"prod_{level}_item_names_align", F.count_if(~F.col("item").cast("string").rlike(item)) == 0, "warning"),
    )


def preflight(groups: DataFrame, entities: DataFrame, index: DataFrame, fg_made: DataFrame, fg_used: DataFrame, str_made: DataFrame, str_used: DataFrame) -> DataFrame:
    """All checks of groups, entities, item dictionary and four layers: of groups by node ids, of entities by their own ids and items."""
    agents, members = groups.select(F.col("agent_id").alias("agent")), entities.select(F.col("strain").alias("agent"))
    nodes, items = index.select(F.col("node_id").alias("item")), index.select("item")
    layers = [(fg_made, agents, nodes, "fg", "prod", "critical"), (fg_used, agents, nodes, "fg", "util", "critical"), (str_made, members, items, "str", "prod", "warning"), (str_used, members, items, "str", "util", "warning")]
    parts = [layer_checks(*x) for x in layers]
    parts += [spelling(fg_made, "fg", r"^FG_\d{3,}$", r"^PYO_\d{2,}$"), spelling(str_made, "str", r"^\d+$", r"^\d+$")]
    # Nodes: there are some, and their ids are their own.
    n = F.count("*")
    parts += [
        told(groups.groupBy("agent_id").agg(n.alias("n")), ("exists_nodes_fg", n > 0, "critical"), ("agent_ids_unique", F.max("n") == 1, "critical")),
        told(entities.groupBy("strain").agg(n.alias("n")), ("exists_nodes_str", n > 0, "warning"), ("entity_ids_unique", F.max("n") == 1, "critical")),
        told(index.groupBy("node_id").agg(n.alias("n")), ("exists_nodes_items", n > 0, "critical"), ("item_ids_unique", F.max("n") == 1, "critical")),
        told(groups.select("agent_id").intersect(index.select("node_id")), ("names_disjoint", n == 0, "critical")),
    ]
    # Degrees: what the groups say of themselves against their edges.
    either = fg_made.select("agent", F.lit(1).alias("p"), F.lit(0).alias("u")).unionByName(fg_used.select("agent", F.lit(0).alias("p"), F.lit(1).alias("u"))).groupBy("agent").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    own = groups.select(F.col("agent_id").alias("agent"), "strain_count", F.col("n_validated_groups").alias("np"), F.col("n_usable_items").alias("nu")).join(either, "agent", "left").na.fill(0, ["p", "u"])
    both = fg_made.select("item").union(fg_used.select("item")).distinct()
    weight = F.col("strain_count")
    totals = own.agg(F.sum("strain_count").alias("members"), F.sum(weight * (F.col("p") + F.col("u"))).alias("weighted")).crossJoin(entities.agg(n.alias("entities"), F.sum(F.col("n_validated_groups") + F.col("n_usable_items")).alias("direct")))
    parts += [
        told(own, ("exists_degree_seq", n > 0, "warning"), ("degree_seq_fg_production_out_match", F.count_if(F.col("np") != F.col("p")) == 0, "warning"), ("degree_seq_fg_utilization_in_match", F.count_if(F.col("nu") != F.col("u")) == 0, "warning"), ("every_group_connected", F.count_if(F.col("p") + F.col("u") == 0) == 0, "warning")),
        told(totals, ("group_sizes_add_up", F.max(F.col("members") == F.col("entities")), "critical"), ("entity_edges_match_weighted_group_edges", F.max(F.col("weighted") == F.col("direct")), "critical")),
        told(nodes.join(both, "item", "left_anti"), ("inactive_items_fg_level", n == 0, "info")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def verdict(found: DataFrame) -> DataFrame:
    """(checks, critical, warnings): how many checks there are, and how many of each weight failed."""
    return found.agg(F.count("*").alias("checks"), *[F.count_if(~F.col("passed") & (F.col("severity") == s)).alias(n) for s, n in (("critical", "critical"), ("warning", "warnings"))])


def differing_sets(groups: DataFrame, members: DataFrame, made: DataFrame, used: DataFrame) -> DataFrame:
    """(group_id): groups with a member (strain, group_id) whose facts (strain, p) are not the group's sets."""
    facts = made.select("strain", "p", F.lit("m").alias("k")).unionByName(used.select("strain", "p", F.lit("u").alias("k"))).groupBy("strain").agg(*[sets.gathered(F.when(F.col("k") == k, F.col("p"))).alias(k) for k in "mu"])
    own = members.select("strain", "group_id").join(facts, "strain", "left").select("group_id", sets.canonical(F.col("m")).alias("m"), sets.canonical(F.col("u")).alias("u")).distinct()
    want = groups.select("group_id", sets.canonical(F.col("validated_groups")).alias("wm"), sets.canonical(F.col("usable_items")).alias("wu"))
    return own.join(want, "group_id").where("m <> wm or u <> wu").select("group_id").distinct()
