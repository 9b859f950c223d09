"""Who uses an item without making it: metrics of every item of a network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions import sets

KINDS = ("cooperator", "crossfeeder", "nonproducer")


def typed_users(users: DataFrame, makers: DataFrame, agents: DataFrame) -> DataFrame:
    """(agent, item, strain_count, user_type) of every use; agents has (agent, strain_count, has_production).

    A cooperator makes the item itself, a crossfeeder makes others, a nonproducer none.
    """
    makes = makers.select("agent", "item").distinct().withColumn("makes", F.lit(True))
    known = users.join(agents, "agent", "left").join(makes, ["agent", "item"], "left")
    kind = F.when(F.coalesce("makes", F.lit(False)), "cooperator").when(F.col("has_production"), "crossfeeder").when(~F.col("has_production"), "nonproducer").otherwise("unknown")
    return known.select("agent", "item", "strain_count", kind.alias("user_type"))


# The names of the columns of item_metrics, in order.
COLUMNS = (
    "pyo_id", "pyo_label", "original_pyov_id", "producers_fg_total", "producers_strains_total", "fg_production_count", "strain_production_count",
    "utilizers_fg_total", "utilizers_strains_total", "fg_utilization_count", "strain_utilization_count", "fg_util_prod_ratio", "strain_util_prod_ratio", "fg_rec_syn_ratio", "strain_rec_syn_ratio",
    *(f"{k}s_fg" for k in KINDS), *(f"{k}s_strains" for k in KINDS), *(f"{k}s_fg_frac" for k in KINDS), *(f"{k}s_strain_frac" for k in KINDS),
    "module_id", "module_fg_count", "module_pyo_count", "module_nestedness", "module_fill_pct", "is_large_module", "is_nested_module", "is_major_module",
)


def item_metrics(users: DataFrame, makers: DataFrame, agents: DataFrame, items: DataFrame, modules: DataFrame, *, large: int = 30, nested: float = 50.0, major: tuple[int, ...] = (0, 3, 8)) -> DataFrame:
    """The COLUMNS of every item: makers, users by type, ratios, fractions, module context.

    items is the dictionary (pyo_id, pyo_label, original_pyov_id and the four counts of
    groups and strains in each layer); modules has (pyo_id, module_id, module_fg_count,
    module_pyo_count, module_nestedness, module_fill_pct). Uses and makings are stacked
    and grouped once, so the item is shuffled once. Items that nobody uses have no counts
    of users by type; their totals are 0.
    """
    uses = typed_users(users, makers, agents).select("item", "strain_count", "user_type")
    made = makers.join(agents.select("agent", "strain_count"), "agent", "left").select("item", "strain_count", F.lit("maker").alias("user_type"))
    kind, n = F.col("user_type"), F.col("strain_count")
    sums = [F.count_if(kind == "maker").alias("producers_fg_total"), F.sum(F.when(kind == "maker", n).otherwise(0)).alias("producers_strains_total"), F.count_if(kind != "maker").alias("utilizers_fg_total"), F.sum(F.when(kind != "maker", n).otherwise(0)).alias("utilizers_strains_total")]
    used = F.count_if(kind != "maker") > 0
    for k in KINDS:
        sums += [F.when(used, F.count_if(kind == k)).alias(f"{k}s_fg"), F.when(used, F.sum(F.when(kind == k, n).otherwise(0))).alias(f"{k}s_strains")]
    out = items.join(uses.unionByName(made).groupBy(F.col("item").alias("pyo_id")).agg(*sums), "pyo_id", "left").join(modules, "pyo_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("producers_fg_total", "producers_strains_total", "utilizers_fg_total", "utilizers_strains_total")})
    ratios = {"fg_util_prod_ratio": ("utilizers_fg_total", "producers_fg_total"), "strain_util_prod_ratio": ("utilizers_strains_total", "producers_strains_total"), "fg_rec_syn_ratio": ("fg_utilization_count", "fg_production_count"), "strain_rec_syn_ratio": ("strain_utilization_count", "strain_production_count")}
    more = {name: sets.ratio(F.col(part), F.col(whole)) for name, (part, whole) in ratios.items()}
    more |= {f"{k}s_fg_frac": sets.fraction(F.col(f"{k}s_fg"), F.col("utilizers_fg_total")) for k in KINDS} | {f"{k}s_strain_frac": sets.fraction(F.col(f"{k}s_strains"), F.col("utilizers_strains_total")) for k in KINDS}
    more |= {"is_large_module": F.coalesce(F.col("module_fg_count") >= large, F.lit(False)), "is_nested_module": F.coalesce(F.col("module_nestedness") >= nested, F.lit(False)), "is_major_module": F.coalesce(F.col("module_id").isin(*major), F.lit(False))}
    return out.withColumns(more).select(*COLUMNS)


def high_exploitation(metrics: DataFrame, *, share: float = 0.5, least: int = 10, top: int = 20) -> DataFrame:
    """The items that nonproducers use most; the limit is the report's."""
    found = metrics.where((F.col("nonproducers_strain_frac") >= share) & (F.col("utilizers_strains_total") >= least))
    return found.orderBy(F.desc_nulls_last("nonproducers_strain_frac"), F.desc_nulls_last("strain_util_prod_ratio"), "pyo_id").limit(top)


def high_ratio(metrics: DataFrame, *, ratio: float = 5.0, least: int = 20, top: int = 20) -> DataFrame:
    """The items with most users for their makers; the limit is the report's."""
    found = metrics.where((F.col("strain_util_prod_ratio") >= ratio) & (F.col("utilizers_strains_total") >= least))
    return found.orderBy(F.desc_nulls_last("strain_util_prod_ratio"), F.desc_nulls_last("utilizers_strains_total"), "pyo_id").limit(top)


def summary_counts(metrics: DataFrame, *, share: float = 0.5, ratio: float = 10.0) -> DataFrame:
    """(items, exploited, unbalanced, in_major_modules): how many items there are, and how many reach each limit."""
    return metrics.agg(F.count("*").alias("items"), F.count_if(F.col("nonproducers_strain_frac") >= share).alias("exploited"), F.count_if(F.col("strain_util_prod_ratio") >= ratio).alias("unbalanced"), F.count_if("is_major_module").alias("in_major_modules"))
