"""Schemas, and a check that fails fast where a column is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame

NODES = "node_id string, module_id int, node_type string, layer string"
EDGES = "source string, target string, source_type string, target_type string, edge_type string"
GROUPS = "functional_group_id int, conservative_canonical_signature string, strain_count int, n_validated_production_groups int, n_usable_pyoverdines int, strategy string, strategy_category string, strategy_description string"


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """df, or a ValueError that names what is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def first_present(df: DataFrame, *names: str) -> str:
    """The first of the names that df has."""
    for n in names:
        if n in df.columns:
            return n
    raise ValueError(f"none of {', '.join(names)}")


def present(df: DataFrame, *names: str) -> DataFrame:
    """The columns of df that are among the names, in their order."""
    return df.select([n for n in names if n in df.columns])
