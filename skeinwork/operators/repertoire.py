"""From records to repertoires, functional groups and strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions import sets
from skeinwork.operators import network
from skeinwork.schema import require_columns


def expanded(pairs: DataFrame) -> DataFrame:
    """(pair_id, pyov, rec): every combination within a pair, duplicates kept."""
    require_columns(pairs, "pair_id", "pyov", "rec")
    return pairs.select("pair_id", F.explode("pyov").alias("pyov"), "rec").select("pair_id", "pyov", F.explode("rec").alias("rec"))


def validated(made: DataFrame, lookup: DataFrame) -> DataFrame:
    """(strain, p): distinct items that an entity makes and that some pair has."""
    return made.where("grp <> 0").distinct().join(lookup.select(F.col("pyov").alias("grp")).distinct(), "grp", "left_semi").select("strain", F.col("grp").alias("p"))


def usable(taken: DataFrame, lookup: DataFrame) -> DataFrame:
    """(strain, p): distinct items that an entity's receptor groups fit. Receptors are made distinct before the join widens them."""
    return taken.where("grp is not null").distinct().join(lookup.select(F.col("rec").alias("grp"), F.col("pyov").alias("p")).distinct(), "grp").select("strain", "p").distinct()


def facts(made: DataFrame, taken: DataFrame) -> DataFrame:
    """(strain, kind, grp) of two tables (strain, grp); kind is made or taken."""
    return made.select("strain", F.lit("made").alias("kind"), "grp").unionByName(taken.select("strain", F.lit("taken").alias("kind"), "grp"))


def repertoires(records: DataFrame, lookup: DataFrame) -> DataFrame:
    """One row an entity of the facts (strain, kind, grp): what it makes, raw and validated, its receptors and usable items, as sets, counts and flags.

    Facts are made distinct once, meet the lookup once and are grouped by entity once.
    A group of null or 0 adds nothing to the sets, but its entity stays.
    """
    known = lookup.select(F.lit("made").alias("kind"), F.col("pyov").alias("grp"), F.col("pyov").alias("p"))
    fits = lookup.select(F.lit("taken").alias("kind"), F.col("rec").alias("grp"), F.col("pyov").alias("p"))
    met = records.distinct().join(known.unionByName(fits).distinct(), ["kind", "grp"], "left")
    made = (F.col("kind") == "made") & (F.col("grp") != 0)
    taken = F.col("kind") == "taken"
    sets_of = {"production_groups": (made, "grp"), "receptor_groups": (taken, "grp"), "usable_items": (taken, "p"), "validated_groups": (made, "p")}
    grouped = met.groupBy("strain").agg(*[sets.gathered(F.when(which, F.col(c))).alias(n) for n, (which, c) in sets_of.items()])
    out = grouped.select("*", *[F.size(n).cast("long").alias(f"n_{n}") for n in sets_of])
    return out.withColumns({"is_producer": F.col("n_validated_groups") > 0, "is_multi_producer": F.col("n_validated_groups") > 1})


def signed(rep: DataFrame, raw: bool = False) -> DataFrame:
    """The repertoires with their canonical signature, production|utilization."""
    made = sets.signature(F.col("production_groups" if raw else "validated_groups"), "0")
    return rep.withColumn("signature", F.concat(made, F.lit("|"), sets.signature(F.col("usable_items"), "none")))


def conservative(rep: DataFrame) -> DataFrame:
    """Entities that make a validated item or can use one."""
    return rep.where((F.col("n_validated_groups") > 0) | (F.col("n_usable_items") > 0))


def collapsed(rep: DataFrame) -> DataFrame:
    """One row a signature: id in the order of signatures, size and sets. Members stay rows of their own, see members()."""
    groups = signed(conservative(rep)).groupBy("signature").agg(F.count("*").alias("strain_count"), F.first("validated_groups").alias("validated_groups"), F.first("usable_items").alias("usable_items"))
    return numbered(groups).withColumns({"n_validated_groups": F.size("validated_groups").cast("long"), "n_usable_items": F.size("usable_items").cast("long")})


def members(rep: DataFrame, groups: DataFrame) -> DataFrame:
    """(strain, signature, group_id): one row an entity of a group. A group that many entities share is a skewed join, which adaptive execution splits."""
    return signed(conservative(rep)).select("strain", "signature").join(groups.select("signature", "group_id"), "signature")


def numbered(groups: DataFrame) -> DataFrame:
    return network.numbered(groups, "group_id", "signature")


# The strategies with their conditions on validated groups p and usable items u, in the order in which they count, their categories, and the wording of descriptions.
def classified(groups: DataFrame) -> DataFrame:
    """Groups with strategy, category and description. The first case that holds counts."""
    p, u = F.col("n_validated_groups"), F.col("n_usable_items")
    strategy = (
        F.when(p > 1, "Multi-producer")
        .when((p == 1) & (u == 1), "Single-receptor producer")
        .when((p == 1) & (u > 1), "Multi-receptor producer")
        .when((p == 0) & (u > 0), "Nonproducer")
        .when((p > 0) & (u == 0), "Producer-only (no utilization)")
        .otherwise("Unconnected")
    )
    category = F.when(F.col("strategy").isin("Multi-producer", "Single-receptor producer", "Multi-receptor producer"), "Producer").when(F.col("strategy") == "Nonproducer", "Nonproducer").otherwise("Other")
    made = F.when(p > 0, F.concat(p.cast("string"), F.lit(" validated groups"))).otherwise("none")
    used = F.when(u > 0, F.concat(u.cast("string"), F.lit(" pyoverdines"))).otherwise("none")
    return groups.withColumn("strategy", strategy).withColumn("strategy_category", category).withColumn("strategy_description", F.concat(F.lit("Production: "), made, F.lit(" | Utilization: "), used))


def resolved(offers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the offers (item, candidate, evidence): (item, candidate, support, conflict), each item's candidate of most distinct evidence, the smallest on ties;
    and the log (item, candidate, support, chosen) of all candidates of items that have several."""
    support = offers.where("candidate is not null").groupBy("item", "candidate").agg(F.countDistinct("evidence").alias("support"))
    best = support.groupBy("item").agg(F.min(F.struct((-F.col("support")).alias("n"), "candidate")).alias("b"), (F.count("*") > 1).alias("conflict"))
    best = best.select("item", "b.candidate", (-F.col("b.n")).alias("support"), "conflict")
    log = support.join(best.where("conflict").select("item", F.col("candidate").alias("first")), "item").select("item", "candidate", "support", (F.col("candidate") == F.col("first")).alias("chosen"))
    return best, log


def from_signatures(groups: DataFrame, signature: str = "signature") -> DataFrame:
    """Sets and counts back from a signature column."""
    parts = F.split(signature, r"\|")
    out = groups.withColumns({"validated_groups": F.filter(sets.parsed(parts[0]), lambda x: x != 0), "usable_items": sets.parsed(parts[1])})
    return out.withColumns({"n_validated_groups": F.size("validated_groups").cast("long"), "n_usable_items": F.size("usable_items").cast("long")})
