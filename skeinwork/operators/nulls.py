"""Null models of bipartite edges (agent, item), all replicates in one plan.

Randomness depends on seed, replicate and edge alone, so a lost task draws the same again.
No step gathers a large replicate in one task: stubs are numbered by ranges, and the agents
that a round pairs up are dealt into buckets of bounded size first, drawn anew each
round, so any two agents can meet. Edges with a column layer meet the replicates of their
layer, so that the nulls of several layers are one plan too.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinwork.operators.network import numbered, running, saved

#: Agents that a bucket is to pair up on average; edges of a replicate that one task may hold; rounds without a swap that end a replicate.
BUCKET, BUCKET_EDGES, ROUNDS = 1000, 20_000, 10


def replicates(spark: SparkSession, n: int, seed: int = 42, layer: int = 0, step: int = 10_000_000) -> DataFrame:
    """(replicate, seed): one row a replicate; layers are a step of seeds apart."""
    first = seed + layer * step
    return spark.range(n).select(F.col("id").cast("long").alias("replicate"), (F.lit(first) + F.col("id")).alias("seed"))


def layered(spark: SparkSession, n: int, names: list[str], seed: int = 42) -> DataFrame:
    """(replicate, seed, layer): n replicates of each layer, numbered on from layer to layer."""
    out = None
    for k, name in enumerate(names):
        own = replicates(spark, n, seed, k).select((F.col("replicate") + k * n).alias("replicate"), "seed", F.lit(name).alias("layer"))
        out = own if out is None else out.unionByName(own)
    return out


def _of(edges: DataFrame, reps: DataFrame) -> DataFrame:
    """(replicate, seed, agent, item) of the distinct edges, for every replicate, or every one of their layer."""
    if "layer" in edges.columns:
        return edges.select("layer", "agent", "item").distinct().join(F.broadcast(reps), "layer").select("replicate", "seed", "agent", "item")
    return edges.select("agent", "item").distinct().crossJoin(F.broadcast(reps.select("replicate", "seed"))).select("replicate", "seed", "agent", "item")


def _order(*salt: object) -> Column:
    return F.xxhash64(*[F.lit(x) if not isinstance(x, Column) else x for x in salt])


def configuration(edges: DataFrame, reps: DataFrame, *, duplicates: str = "keep", drop_diagonal: bool = False) -> DataFrame:
    """(replicate, agent, item, weight): item stubs shuffled against agent stubs, which keeps both degree sequences.

    All stubs of all replicates are numbered in two orders, by agent and at random, both
    of them replicate by replicate; the k-th of one order meets the k-th of the other.
    duplicates: keep leaves a weight over 1 where stubs meet again, collapse makes it 1.
    drop_diagonal leaves out edges between the k-th agent and the k-th item, as published
    runs did; degrees then are no longer kept.
    """
    own = saved(_of(edges, reps))
    rows = numbered(own.select("replicate", "agent", "item"), "k", "replicate", "agent", "item", stable=True).select("k", "replicate", "agent")
    drawn = own.select("replicate", _order(F.col("seed"), F.col("agent"), F.col("item")).alias("h"), "agent", "item")
    cols = numbered(drawn, "k", "replicate", "h", "agent", "item", stable=True).select("k", "item")
    out = rows.join(cols, "k").groupBy("replicate", "agent", "item").agg(F.count("*").alias("weight"))
    if duplicates == "collapse":
        out = out.withColumn("weight", F.lit(1).cast("long"))
    if drop_diagonal:
        place = {c: numbered(edges.select(c).distinct(), f"__{c}", c) for c in ("agent", "item")}
        out = out.join(place["agent"], "agent").join(place["item"], "item").where("__agent <> __item").drop("__agent", "__item")
    return out


def _largest(now: DataFrame) -> int:
    """Edges of the largest replicate."""
    return now.groupBy("replicate").agg(F.count("*").alias("m")).agg(F.max("m")).first()[0] or 0


def swapped(edges: DataFrame, reps: DataFrame, *, swaps: int, tries: int | None = None, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(replicate, agent, item) after so many successful degree-preserving swaps, and (replicate, swaps, tries): how many there were.

    A swap takes two edges (a, x), (b, y) at random and makes them (a, y), (b, x), unless
    one of these is an edge already. A replicate ends with its last swap, or after tries
    attempts, 10 a wanted swap and 1,000 at least. Replicates of up to BUCKET_EDGES edges
    make their swaps one after another, each in one task. Larger ones do so in rounds of
    disjoint pairs of edges, which are rows and joins only (swaps_by_joins), so that an
    agent of any number of edges is no row of its own.
    """
    tries = max(10 * swaps, 1000) if tries is None else tries
    now = saved(_of(edges, reps))
    if _largest(now) <= BUCKET_EDGES:
        return swaps_in_tasks(now, swaps, tries)
    return swaps_by_joins(now, swaps, tries, rounds)


def swaps_in_tasks(now: DataFrame, swaps: int, tries: int) -> tuple[DataFrame, DataFrame]:
    """swapped() of replicates (replicate, seed, agent, item) of bounded size, one a group."""
    kinds = {c: now.schema[c].dataType.simpleString() for c in ("agent", "item")}

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["agent", "item"], ignore_index=True)
        rng = np.random.default_rng(int(rows["seed"][0]) & (2**63 - 1))
        agent, _ = pd.factorize(rows["agent"])
        item, names = pd.factorize(rows["item"])
        item, has, m = item.tolist(), set(zip(agent.tolist(), item.tolist(), strict=True)), len(rows)
        agent = agent.tolist()
        made = tried = 0
        while made < swaps and tried < tries:
            for i, j in rng.integers(0, m, (min(1024, tries - tried), 2)).tolist():
                one, two = (agent[i], item[j]), (agent[j], item[i])
                tried += 1
                if one not in has and two not in has:
                    has -= {(agent[i], item[i]), (agent[j], item[j])}
                    has |= {one, two}
                    item[i], item[j] = item[j], item[i]
                    made += 1
                    if made == swaps:
                        break
        first = np.arange(m) == 0
        return pd.DataFrame({"replicate": rows["replicate"], "agent": rows["agent"], "item": np.asarray(names)[item], "made": np.where(first, made, 0), "tried": np.where(first, tried, 0)})

    done = saved(now.groupBy("replicate").applyInPandas(run, f"replicate long, agent {kinds['agent']}, item {kinds['item']}, made long, tried long"))
    told = done.groupBy("replicate").agg(F.sum("made").alias("swaps"), F.sum("tried").alias("tries"))
    return done.select("replicate", "agent", "item"), told


def swaps_by_joins(now: DataFrame, swaps: int, tries: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """swapped() in rounds: all edges of a replicate (replicate, seed, agent, item) are paired at random, and each pair is a try.

    A try fails if an edge that it would make is one already, or if an earlier try of the
    round makes it too; what is counted is the tries up to the last swap that is wanted.
    It stops for a replicate that has its swaps or tries, or after rounds without any.
    """
    told = saved(now.select("replicate").distinct().select("replicate", F.lit(0).cast("long").alias("swaps"), F.lit(0).cast("long").alias("tries")))
    k = idle = 0
    while idle < rounds:
        open_ = told.where((F.col("swaps") < swaps) & (F.col("tries") < tries))
        if open_.isEmpty():
            break
        moving = now.join(F.broadcast(open_), "replicate").withColumn("h", _order(F.col("seed"), k, F.col("agent"), F.col("item")))
        at = running(moving, ["h", "agent", "item"], ["replicate"], sums={"k": F.lit(1).cast("long")}).withColumn("p", F.floor(F.col("k") / 2))
        at = saved(at.select("replicate", "agent", "item", "p", (F.col("k") % 2).alias("side"), "swaps", "tries"))
        side = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}{s}")
        pairs = at.groupBy("replicate", "p", "swaps", "tries").agg(*[side(c, s) for c in ("agent", "item") for s in (0, 1)]).where("agent1 is not null")
        new = pairs.select("replicate", "p", F.inline(F.array(F.struct(F.col("agent0").alias("agent"), F.col("item1").alias("item")), F.struct(F.col("agent1").alias("agent"), F.col("item0").alias("item")))))
        made = new.groupBy("replicate", "agent", "item").agg(F.min("p").alias("p"))  # the first try that makes an edge
        made = made.join(now.select("replicate", "agent", "item"), ["replicate", "agent", "item"], "left_anti").groupBy("replicate", "p").agg(F.count("*").alias("good"))
        tried = saved(pairs.select("replicate", "p", "swaps", "tries").join(made, ["replicate", "p"], "left").select("replicate", "p", "swaps", "tries", (F.coalesce("good", F.lit(0)) == 2).cast("long").alias("ok")))
        ends = tried.groupBy("replicate", "swaps", "tries").agg(F.sum("ok").alias("s"), F.count("*").alias("t"))
        if ends.where((F.col("swaps") + F.col("s") > swaps) | (F.col("tries") + F.col("t") > tries)).head(1):  # some replicate ends within the round
            tried = saved(running(tried, ["p"], ["replicate"], sums={"before": F.col("ok"), "tried": F.lit(1).cast("long")}).where((F.col("swaps") + F.col("before") < swaps) & (F.col("tries") + F.col("tried") < tries)))
        both = at.join(pairs.select("replicate", "p", "item0", "item1"), ["replicate", "p"], "left").join(tried.where("ok = 1").select("replicate", "p", "ok"), ["replicate", "p"], "left")
        item = F.when(F.col("ok").isNull(), F.col("item")).when(F.col("side") == 0, F.col("item1")).otherwise(F.col("item0"))
        seeds = now.select("replicate", "seed").distinct()
        done = both.select("replicate", "agent", item.alias("item")).join(F.broadcast(seeds), "replicate").select("replicate", "seed", "agent", "item")
        now = saved(now.join(F.broadcast(open_.select("replicate")), "replicate", "left_anti").select("replicate", "seed", "agent", "item").unionByName(done))
        more = tried.groupBy("replicate").agg(F.sum("ok").alias("s"), F.count("*").alias("t"))
        was, told = told, saved(told.join(more, "replicate", "left").select("replicate", (F.col("swaps") + F.coalesce("s", F.lit(0))).alias("swaps"), (F.col("tries") + F.coalesce("t", F.lit(0))).alias("tries")))
        idle = 0 if told.agg(F.sum("swaps")).first()[0] > was.agg(F.sum("swaps")).first()[0] else idle + 1
        k += 1
    return now.select("replicate", "agent", "item"), told


def _paired(agents: DataFrame, buckets: int, k: int) -> DataFrame:
    """(replicate, seed, agent, ..., bucket, pair, side, other): agents (replicate, seed, agent, ...) in pairs that are drawn at random in round k; the odd one of a bucket has no other."""
    dealt = agents.withColumn("h", _order(F.col("seed"), k, F.col("agent"))).withColumn("bucket", F.pmod(_order(F.col("h"), 1), F.lit(buckets)))
    w = Window.partitionBy("replicate", "bucket").orderBy("h", "agent")
    dealt = dealt.withColumns({"n": F.row_number().over(w) - 1, "next": F.lead("agent").over(w), "last": F.lag("agent").over(w)})
    side = F.col("n") % 2
    carried = [c for c in agents.columns if c not in ("replicate", "seed", "agent")]
    return dealt.select("replicate", "seed", "agent", *carried, "bucket", F.floor(F.col("n") / 2).alias("pair"), side.alias("side"), F.when(side == 0, F.col("next")).otherwise(F.col("last")).alias("other"))


def curveball(edges: DataFrame, reps: DataFrame, *, rounds: int = 20) -> DataFrame:
    """(replicate, agent, item): edges after rounds of trades between agents.

    A round pairs the agents at random. Of the items that only one of a pair has, each
    gets as many as before, drawn at random, so both degree sequences stay. Pairs share
    no agent, so all trades of a round happen at once. The odd agent of a bucket waits
    for the next round. An agent of a replicate of up to BUCKET_EDGES edges is a row with
    its items; in larger ones all is rows (trades_by_rows), whatever an agent has.
    """
    now = saved(_of(edges, reps))
    agents = now.select("replicate", "seed", "agent").distinct()
    most = agents.groupBy("replicate").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    buckets = max(1, -(-most // BUCKET))
    if _largest(now) > BUCKET_EDGES:
        return trades_by_rows(now, saved(agents), buckets, rounds)
    now = now.groupBy("replicate", "seed", "agent").agg(F.sort_array(F.collect_list("item")).alias("items"))
    for k in range(rounds):
        met = _paired(now, buckets, k)
        e = F.sort_array(F.collect_list(F.struct("side", "agent", "items")))
        met = met.groupBy("replicate", "seed", "bucket", "pair").agg(e.alias("e"))
        left, right = F.get("e", F.lit(0)), F.get("e", F.lit(1))
        own = F.array_except(left["items"], right["items"])
        pool = F.concat(own, F.array_except(right["items"], left["items"]))
        drawn = F.transform(F.sort_array(F.transform(pool, lambda x: F.struct(_order(F.col("seed"), k, F.col("bucket"), F.col("pair"), x).alias("h"), x.alias("x")))), lambda s: s.x)
        both, n = F.array_intersect(left["items"], right["items"]), F.size(own)
        mine, theirs = F.concat(both, F.slice(drawn, F.lit(1), n)), F.concat(both, F.slice(drawn, n + 1, F.size(drawn)))
        traded = F.array(F.struct(left.agent.alias("agent"), mine.alias("items")), F.struct(right.agent.alias("agent"), theirs.alias("items")))
        alone = F.transform("e", lambda x: F.struct(x.agent.alias("agent"), x["items"].alias("items")))
        step = met.select("replicate", "seed", F.explode(F.when(F.size("e") == 2, traded).otherwise(alone)).alias("m")).select("replicate", "seed", "m.agent", "m.items")
        now = saved(step)
    return now.select("replicate", "agent", F.explode("items").alias("item"))


def trades_by_rows(now: DataFrame, agents: DataFrame, buckets: int, rounds: int) -> DataFrame:
    """curveball() of replicates (replicate, seed, agent, item) of any size: what only one of a pair has is ranked at random, over ranges of rows, and the first go to the first."""
    key = ["replicate", "bucket", "pair"]
    for k in range(rounds):
        met = now.drop("seed").join(_paired(agents, buckets, k), ["replicate", "agent"])
        ends = [F.when(F.col("side") == s, F.col("agent")).otherwise(F.col("other")).alias(f"a{s}") for s in (0, 1)]
        held = met.select(*key, "seed", "item", "side", *ends).groupBy(*key, "item").agg(F.count("*").alias("n"), F.min("side").alias("side"), *[F.first(c).alias(c) for c in ("seed", "a0", "a1")])
        held = saved(held)
        kept = held.where("n = 2").select("replicate", "seed", F.explode(F.array("a0", "a1")).alias("agent"), "item")
        loose = held.where("n = 1")
        own = loose.where("side = 0").groupBy(*key).agg(F.count("*").alias("own"))
        h = _order(F.col("seed"), k, F.col("bucket"), F.col("pair"), F.col("item"))
        ranked = running(loose.withColumn("h", h), ["h", "item"], key, sums={"k": F.lit(1).cast("long")}).join(own, key, "left")
        agent = F.when(F.col("k") < F.coalesce("own", F.lit(0)), F.col("a0")).otherwise(F.col("a1"))
        now = saved(kept.unionByName(ranked.select("replicate", "seed", agent.alias("agent"), "item")))
    return now.select("replicate", "agent", "item")


def degrees_kept(edges: DataFrame, nulls: DataFrame, weight: str | None = None) -> DataFrame:
    """(replicate, changed): nodes of a replicate whose degree differs from the observed one."""
    w = F.lit(1) if weight is None else F.col(weight)
    changed = []
    for side in ("agent", "item"):
        was = edges.select("agent", "item").distinct().groupBy(F.col(side).cast("string").alias("node")).agg(F.count("*").alias("was"))
        now = nulls.groupBy("replicate", F.col(side).cast("string").alias("node")).agg(F.sum(w).alias("now"))
        reps = nulls.select("replicate").distinct()
        both = was.crossJoin(F.broadcast(reps)).join(now, ["replicate", "node"], "full")
        changed.append(both.select("replicate", (~F.col("was").eqNullSafe(F.col("now"))).cast("int").alias("c")))
    return changed[0].unionByName(changed[1]).groupBy("replicate").agg(F.sum("c").alias("changed"))
