"""Modularity, label propagation and nestedness of bipartite edges (agent, item).

Every function takes the columns that tell replicates or modules apart in `by`, and
works on all of them in one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.operators import inference
from skeinwork.operators.network import numbered, saved


def barber(edges: DataFrame, agents: DataFrame, items: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(*by, m, numerator, q): Barber's modularity of labels (agent, label) and (item, label).

    Within a module c of L edges, D agent stubs and E item stubs, m * L - D * E counts;
    the sum over modules is an integer, and q is that over m squared.
    """
    by = list(by)
    w = F.lit(1) if weight is None else F.col(weight)
    own = [c for c in by if c in edges.columns]
    marked = edges.withColumn("__w", w).join(agents.withColumnRenamed("label", "__a"), [*own, "agent"]).join(items.withColumnRenamed("label", "__i"), [*by, "item"])
    # One row an edge and end: which module, and what it adds there.
    ends = marked.select(*by, F.explode(F.array(F.struct(F.col("__a").alias("c"), F.col("__w").alias("d"), F.lit(0).alias("e"), F.when(F.col("__a") == F.col("__i"), F.col("__w")).otherwise(0).alias("l")), F.struct(F.col("__i").alias("c"), F.lit(0).alias("d"), F.col("__w").alias("e"), F.lit(0).alias("l")))).alias("x"))
    modules = ends.groupBy(*by, "x.c").agg(*[F.sum(f"x.{k}").cast("long").alias(k) for k in "del"])
    total = modules.groupBy(*by).agg(F.sum("d").alias("m"), F.sum("l").alias("l"), F.sum(F.col("d") * F.col("e")).alias("de"))
    return total.select(*by, "m", (F.col("m") * F.col("l") - F.col("de")).alias("numerator")).withColumn("q", F.col("numerator") / (F.col("m") * F.col("m")))


def majority(edges: DataFrame, side: str, other: str, labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, side, label): the most frequent label among a node's neighbours, the smallest on ties."""
    shared = [c for c in by if c in edges.columns]
    counts = edges.join(labels, [*shared, other]).groupBy(*by, side, "label").agg(F.count("*").alias("n"))
    return counts.groupBy(*by, side).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))


def brim(edges: DataFrame, agents: DataFrame | None, items: DataFrame, *, iterations: int, by: Sequence[str] = (), until_stable: bool = True) -> tuple[DataFrame, DataFrame]:
    """Labels of agents and items after alternating majority steps from the given labels of the items.

    In an iteration all agents take the majority of their items, then all items that of
    their agents' new labels; it stops when nothing changes. With by, each of its values
    stops for itself: what has settled is set aside and no later iteration touches it.
    """
    by = list(by)
    settled = []
    for _ in range(iterations):
        new_agents = majority(edges, "agent", "item", items, by)
        new_agents = saved(new_agents) if until_stable else new_agents
        new_items = majority(edges, "item", "agent", new_agents, by)
        if not until_stable:
            agents, items = new_agents, new_items
            continue
        new_items = saved(new_items)
        was, was_items = agents.select(*by, "agent", F.col("label").alias("was")), items.select(*by, "item", F.col("label").alias("was"))
        new = new_agents.join(was, [*by, "agent"]).where("label <> was").select(*by, F.lit(1).alias("x")).union(new_items.join(was_items, [*by, "item"]).where("label <> was").select(*by, F.lit(1)))
        agents, items = new_agents, new_items
        if not by:
            if new.isEmpty():
                break
            continue
        moving = saved(new.select(*by).distinct())
        settled.append((agents.join(F.broadcast(moving), by, "left_anti"), items.join(F.broadcast(moving), by, "left_anti")))
        agents, items = (x.join(F.broadcast(moving), by, "left_semi") for x in (agents, items))
        if moving.isEmpty():
            break
        if all(c in edges.columns for c in by):
            edges = edges.join(F.broadcast(moving), by, "left_semi")
    for a, i in settled:
        agents, items = agents.unionByName(a), items.unionByName(i)
    return agents, items


# How many modules a random start has: a third of the smaller side, within these bounds.
FEWEST, MOST, SHARE = 2, 15, 3


def starting_modules(n_agents: int, n_items: int) -> int:
    least = min(n_agents, n_items)
    return min(MOST, max(FEWEST, least // SHARE)) if least >= SHARE else least


def random_labels(nodes: DataFrame, node: str, replicates: DataFrame, modules: int, seed: int) -> DataFrame:
    """(replicate, node, label): labels drawn by a hash of seed, replicate and node, the same however rows are dealt."""
    return nodes.select(node).distinct().crossJoin(F.broadcast(replicates.select("replicate"))).withColumn("label", F.pmod(F.xxhash64(F.lit(seed), F.lit(node), "replicate", F.col(node)), F.lit(modules)))


def random_vectors(nodes: DataFrame, node: str, seed: int) -> DataFrame:
    """(replicate, node, v): for each start s from 0 the label that random_labels draws for replicate first + s. nodes has (replicate, first, starts, modules, node)."""
    draw = lambda s: F.struct(s.cast("int").alias("s"), F.pmod(F.xxhash64(F.lit(seed), F.lit(node), F.col("first") + s, F.col(node)), F.col("modules")).alias("l"))
    return nodes.select("replicate", node, F.transform(F.sequence(F.lit(0).cast("long"), F.col("starts") - 1), draw).alias("v"))


def majorities(edges: DataFrame, side: str, other: str, vectors: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, side, v): majority() of every start at once; an edge meets its other end once, with all labels that it has."""
    counts = edges.join(vectors, [*by, other]).select(*by, side, F.inline("v")).groupBy(*by, side, "s", "l").agg(F.count("*").alias("n"))
    told = counts.groupBy(*by, side).agg(F.sort_array(F.collect_list(F.struct("s", (-F.col("n")).alias("n"), "l"))).alias("x"))
    first = F.filter("x", lambda x, k: (k == 0) | (x.s != F.get("x", k - 1).s))
    return told.select(*by, side, F.transform(first, lambda x: F.struct(x.s.alias("s"), x.l.alias("l"))).alias("v"))


#: Steps after which it is looked which starts still move.
LOOK = 3


def search(edges: DataFrame, agents: DataFrame, items: DataFrame, by: Sequence[str], iterations: int = 30) -> tuple[DataFrame, DataFrame]:
    """Label vectors of agents and items (*by, node, v) after alternating majority steps of all starts.

    Every LOOK steps a start of one of by's values that no longer moves is taken out of the
    vectors and saved apart; edges of which no start moves are left out of later steps.
    The edges themselves are written nowhere.
    """
    by, settled, moving = list(by), [], None
    for k in range(1, iterations + 1):
        own = edges if moving is None else edges.join(F.broadcast(moving), by, "left_semi")
        a = majorities(own, "agent", "item", items, by)
        look = k % LOOK == 0 or k == iterations
        a = saved(a) if look else a
        was, items = items, saved(majorities(own, "item", "agent", a, by))
        if not look:
            continue
        # A start whose items have kept their labels in a step stays as it is.
        both = items.join(was.withColumnRenamed("v", "was"), [*by, "item"])
        changed = both.select(*by, F.explode(F.filter(F.zip_with("v", "was", lambda x, y: F.when(x.l != y.l, x.s)), lambda s: s.isNotNull())).alias("s"))
        moving = saved(changed.distinct().groupBy(*by).agg(F.collect_set("s").alias("on")))
        ends, on = [], []
        for new, node in ((a, "agent"), (items, "item")):
            told = new.join(F.broadcast(moving), by, "left")
            rest = told.select(*by, node, F.filter("v", lambda x: F.coalesce(~F.array_contains("on", x.s), F.lit(True))).alias("v"))
            ends.append(saved(rest.where(F.size("v") > 0)))
            on.append(told.where("on is not null").select(*by, node, F.filter("v", lambda x: F.array_contains("on", x.s)).alias("v")))
        settled.append(ends)
        agents, items = on
        if moving.isEmpty():
            break
    out = []
    for k, (node, left) in enumerate((("agent", agents), ("item", items))):
        for ends in settled:
            left = left.unionByName(ends[k])
        out.append(left.groupBy(*by, node).agg(F.sort_array(F.flatten(F.collect_list("v"))).alias("v")))
    return out[0], out[1]


# Below this density a single module is dealt out anew, into a third of the larger side, within these bounds.
SPARSE, FEWEST_DEALT, MOST_DEALT = 0.01, 2, 5


def finished(edges: DataFrame, agents: DataFrame, items: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The vectors with modules numbered from 0 without gaps. Where a start has left one module in a layer of a density below SPARSE, nodes are dealt to modules in turn, in the order of their names."""
    by = list(by)
    ends = agents.select(*by, F.inline("v")).union(items.select(*by, F.inline("v"))).groupBy(*by, "s").agg(F.sort_array(F.collect_set("l")).alias("labels"))
    sizes = edges.groupBy(*by).agg(F.countDistinct("agent").alias("na"), F.countDistinct("item").alias("ni"), F.countDistinct("agent", "item").alias("m"))
    third = F.floor(F.greatest("na", "ni") / SHARE)
    dealt = F.when(F.col("m") / (F.col("na") * F.col("ni")) < SPARSE, F.greatest(F.lit(FEWEST_DEALT), F.least(F.lit(MOST_DEALT), third)))
    told = ends.join(sizes, by).select(*by, "s", "labels", F.when(F.size("labels") == 1, dealt).alias("dealt"))
    told = saved(told.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("s", "labels", "dealt"))).alias("told")))
    spread = told.where(F.exists("told", lambda t: t.dealt.isNotNull())).select(*by)
    out = []
    for node, vectors in (("agent", agents), ("item", items)):
        place = numbered(vectors.join(F.broadcast(spread), by, "left_semi").select(*by, node), "k", *by, node)
        starts = place.groupBy(*by).agg(F.min("k").alias("k0"))
        place = place.join(F.broadcast(starts), by).select(*by, node, (F.col("k") - F.col("k0")).alias("k"))
        both = vectors.join(F.broadcast(told), by).join(place, [*by, node], "left")
        label = lambda x, t: F.coalesce(F.pmod(F.col("k"), t.dealt), F.array_position(t.labels, x.l) - 1)
        out.append(both.select(*by, node, F.zip_with("v", "told", lambda x, t: F.struct(x.s.alias("s"), label(x, t).cast("long").alias("l"))).alias("v")))
    return out[0], out[1]


def barbers(edges: DataFrame, agents: DataFrame, items: DataFrame, by: Sequence[str], weight: str | None = None) -> DataFrame:
    """(*by, s, q, n_modules): barber() of every start of label vectors."""
    by = list(by)
    w = edges.withColumn("w", F.lit(1).cast("long") if weight is None else F.col(weight))
    met = w.join(agents.withColumnRenamed("v", "va"), [*by, "agent"]).join(items.withColumnRenamed("v", "vi"), [*by, "item"])
    inside = met.select(*by, "w", F.inline(F.zip_with("va", "vi", lambda x, y: F.struct(x.s.alias("s"), (x.l == y.l).alias("same")))))
    inside = inside.groupBy(*by, "s").agg(F.sum("w").alias("m"), F.sum(F.when(F.col("same"), F.col("w")).otherwise(0)).alias("l"))
    sides = []
    for node, vectors, own in (("agent", agents, "d"), ("item", items, "e")):
        degree = w.groupBy(*by, node).agg(F.sum("w").alias("k"))
        sides.append(degree.join(vectors, [*by, node]).select(*by, "k", F.inline("v")).groupBy(*by, "s", F.col("l").alias("c")).agg(F.sum("k").alias(own)))
    modules = sides[0].join(sides[1], [*by, "s", "c"], "full").groupBy(*by, "s").agg(F.sum(F.coalesce("d", F.lit(0)) * F.coalesce("e", F.lit(0))).alias("de"), F.count("*").alias("n_modules"))
    q = (F.col("m") * F.col("l") - F.col("de")) / (F.col("m") * F.col("m"))
    return inside.join(modules, [*by, "s"]).select(*by, "s", q.alias("q"), "n_modules")


def labels_of(vectors: DataFrame, best: DataFrame, by: Sequence[str], node: str) -> DataFrame:
    """(*by, node, label): each node's label in the start that best (*by, s) names."""
    found = vectors.join(F.broadcast(best.select(*by, F.col("s").alias("best"))), list(by))
    return found.select(*by, node, F.get(F.filter("v", lambda x: x.s == F.col("best")), F.lit(0)).l.alias("label"))


def compared(one: DataFrame, other: DataFrame) -> DataFrame:
    """(node_type, prod_module, util_module, n): nodes (node, node_type, label) of two layers that both have, by their two modules."""
    return one.withColumnRenamed("label", "prod_module").join(other.withColumnRenamed("label", "util_module"), ["node", "node_type"]).groupBy("node_type", "prod_module", "util_module").agg(F.count("*").alias("n"))


def _side(edges: DataFrame, node: str, other: str, by: list[str]) -> DataFrame:
    """(*by, n, numerator, pairs) of one side: sums over pairs of nodes of unequal degree.

    A pair's overlap over its lesser degree, summed over all pairs, is a sum over the
    other side's nodes x: each neighbour of degree d meets, at x, the neighbours of
    larger degree and adds 1 / d for each. So no pair is ever formed: neighbours are
    counted by (x, degree), and a running sum over the degrees at x does the rest.
    """
    degree = edges.groupBy(*by, node).agg(F.count("*").alias("d"))
    at = edges.join(degree, [*by, node]).groupBy(*by, other, "d").agg(F.count("*").alias("c"))
    larger = F.coalesce(F.sum("c").over(Window.partitionBy(*by, other).orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = at.withColumn("g", F.col("c") * larger).groupBy(*by, "d").agg(F.sum("g").alias("g")).groupBy(*by).agg(F.sum(100.0 * F.col("g") / F.col("d")).alias("numerator"))
    sizes = degree.groupBy(*by, "d").agg(F.count("*").alias("k")).groupBy(*by).agg(F.sum("k").alias("n"), F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("tied"))
    sizes = sizes.withColumn("pairs", F.col("n") * (F.col("n") - 1) / 2 - F.col("tied")).withColumn("all_pairs", F.col("n") * (F.col("n") - 1) / 2)
    return sizes.join(met, by) if by else sizes.crossJoin(met)


def nodf(edges: DataFrame, by: Sequence[str] = (), ties: str = "skip") -> DataFrame:
    """(*by, n_agents, n_items, n_edges, nodf_rows, nodf_cols, nodf_total, fill_percentage) of distinct edges.

    ties: skip leaves pairs of equal degree out; count keeps them in the denominator.
    """
    if ties not in ("skip", "count"):
        raise ValueError("ties: skip or count")
    by = list(by)
    edges = edges.select(*by, "agent", "item").distinct()
    pairs = F.col("pairs" if ties == "skip" else "all_pairs")
    sides = []
    for node, other, name in (("agent", "item", "rows"), ("item", "agent", "cols")):
        value = F.when(pairs > 0, F.col("numerator") / pairs).otherwise(0.0)
        sides.append(_side(edges, node, other, by).select(*by, F.col("n").alias(f"n_{node}s"), value.alias(f"nodf_{name}")))
    total = edges.groupBy(*by).agg(F.count("*").alias("n_edges"))
    out = sides[0].join(sides[1], by).join(total, by) if by else sides[0].crossJoin(sides[1]).crossJoin(total)
    small = (F.col("n_agents") < 2) | (F.col("n_items") < 2)
    rows, cols = (F.when(small, 0.0).otherwise(F.col(c)) for c in ("nodf_rows", "nodf_cols"))
    fill = 100.0 * F.col("n_edges") / (F.col("n_agents") * F.col("n_items"))
    return out.select(*by, "n_agents", "n_items", "n_edges", rows.alias("nodf_rows"), cols.alias("nodf_cols"), ((rows + cols) / 2).alias("nodf_total"), fill.alias("fill_percentage"))


def pooled_nodf(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, nodf_pooled): the mean over all pairs of agents and all pairs of items together; pairs of equal degree count as 0."""
    by = list(by)
    edges = edges.select(*by, "agent", "item").distinct()
    sides = [_side(edges, *names, by).select(*by, "numerator", "all_pairs") for names in (("agent", "item"), ("item", "agent"))]
    total = sides[0].unionByName(sides[1]).groupBy(*by).agg(F.sum("numerator").alias("n"), F.sum("all_pairs").alias("p"))
    return total.select(*by, F.when(F.col("p") > 0, F.col("n") / F.col("p")).otherwise(0.0).alias("nodf_pooled"))


def within_modules(edges: DataFrame, agents: DataFrame, items: DataFrame) -> DataFrame:
    """NODF of the edges inside each module (label) with two agents and two items or more that it holds.

    A module's nodes count even where all their edges leave it; nodes without an edge
    inside take part in no pair.
    """
    inner = edges.join(agents, "agent").join(items, ["item", "label"])
    held = agents.groupBy("label").agg(F.count("*").alias("module_agents")).join(items.groupBy("label").agg(F.count("*").alias("module_items")), "label").where("module_agents >= 2 and module_items >= 2")
    found = nodf(inner, ["label"])
    out = held.join(found, "label", "left")
    fill = 100.0 * F.coalesce("n_edges", F.lit(0)) / (F.col("module_agents") * F.col("module_items"))
    return out.select("label", "module_agents", "module_items", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("nodf_total", "nodf_rows", "nodf_cols")], fill.alias("fill_percentage"))


def module_summary(whole: DataFrame, modules: DataFrame) -> DataFrame:
    """(n_modules, mean, sd, observed, z_score, p_value): the nestedness of the whole against its modules' mean and sd, with a normal p; z and p are null without an sd."""
    found = modules.agg(F.count("*").alias("n_modules"), F.avg("nodf_total").alias("mean"), F.stddev_samp("nodf_total").alias("sd")).crossJoin(F.broadcast(whole.select(F.col("nodf_total").alias("observed"))))
    found = found.withColumn("z_score", F.when(F.col("sd") > 0, (F.col("observed") - F.col("mean")) / F.col("sd")))
    return found.withColumn("p_value", inference.two_sided_normal_p(F.col("z_score")))


def density(edges: DataFrame) -> DataFrame:
    """(n_agents, n_items, n_edges, density) of distinct edges."""
    out = edges.select("agent", "item").distinct().agg(F.countDistinct("agent").alias("n_agents"), F.countDistinct("item").alias("n_items"), F.count("*").alias("n_edges"))
    return out.withColumn("density", F.col("n_edges") / (F.col("n_agents") * F.col("n_items")))


def entropy(counts: Column) -> Column:
    """Aggregate: Shannon entropy of the counts of a group, in nats."""
    return F.log(F.sum(counts)) - F.sum(F.when(counts > 0, counts * F.log(counts)).otherwise(0)) / F.sum(counts)
