"""Queries on series without any spread, and on ties: the wide layer is full, so that all its items have as many users."""

from __future__ import annotations

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from skeinwork.functions import sets
from skeinwork.operators import inference, repertoire
from skeinwork.plans import adapter
from skeinwork.sources import tables
from tests import compare

SF = "/root/testdata/sf0.001"


def folder(path, **tables):
    """The smallest tables, but for some."""
    for t in compare.TABLES:
        if t in tables:
            old = pq.read_schema(f"{SF}/{t}.parquet")
            rows = tables[t]
            pq.write_table(pa.table({f.name: pa.array(rows[f.name], f.type) if f.name in rows else pa.nulls(len(next(iter(rows.values()))), f.type) for f in old}), path / f"{t}.parquet")
        else:
            os.symlink(f"{SF}/{t}.parquet", path / f"{t}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def full(tmp_path_factory):
    """97 agents, each with all 50 items."""
    agents, sizes = range(97), range(1, 51)
    part = {"p_partkey": list(sizes), "p_brand": [f"Brand#{1 + s % 5}{1 + s // 5 % 5}" for s in sizes], "p_size": list(sizes)}
    orders = {"o_orderkey": list(agents), "o_custkey": list(agents)}
    lines = [(a, s) for a in agents for s in sizes]
    lineitem = {"l_orderkey": [a for a, _ in lines], "l_partkey": [s for _, s in lines], "l_linenumber": [s for _, s in lines], "l_quantity": [50.0] * len(lines), "l_extendedprice": [1.0] * len(lines), "l_tax": [0.08] * len(lines), "l_returnflag": ["R"] * len(lines)}
    return folder(tmp_path_factory.mktemp("full"), part=part, orders=orders, lineitem=lineitem)


def both(spark, name: str, path: str) -> tuple[list, list]:
    """Our rows and those of the SQL, as text in order: a NaN is equal to a NaN."""
    told = lambda names, rows: sorted(str([(n, compare.plain(x)) for n, x in sorted(zip(names, r, strict=True))]) for r in rows)
    df = entry_point.queries()[name](spark, path)
    cur = compare.connection(path).execute(entry_point.oracle_sql()[name])
    return told(df.columns, df.collect()), told([c[0] for c in cur.description], cur.fetchall())


def test_division_as_in_ieee(spark):
    rows = [(1.0, 2.0), (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (float("nan"), 0.0), (None, 0.0), (1.0, None)]
    got = spark.createDataFrame(rows, "a double, b double").select(sets.divided(F.col("a"), F.col("b")).alias("q")).collect()
    assert str([r["q"] for r in got]) == "[0.5, inf, -inf, nan, nan, None, None]"


def test_normal_p(spark, full):
    got, want = both(spark, "f19_normal_p", full)
    assert got == want


def test_trend(spark, full):
    got, want = both(spark, "f21_trend", full)
    assert got == want


def test_pearson_without_spread(spark, full):
    got, want = both(spark, "f20_pearson", full)
    assert got == want
    cases = {"nan": [(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], "none": [(None, 1.0)], "one": [(1.0, 2.0), (None, 5.0), (3.0, 6.0), (4.0, None)], "some": [(1.0, 1.0), (2.0, 3.0), (3.0, 2.0)]}
    found = {k: inference.correlation(spark.createDataFrame(rows, "x double, y double"), "x", "y").first() for k, rows in cases.items()}
    assert str([found["nan"]["r"], found["nan"]["p"], found["none"]["r"], found["none"]["p"]]) == "[nan, nan, None, None]"
    assert [found["one"]["r"], found["some"]["r"]] == pytest.approx([1.0, 0.5]) and found["some"]["p"] == pytest.approx(2 / 3)


def test_autocorrelation(spark, full):
    got, want = both(spark, "w11_autocorrelation", full)
    assert got == want


def test_equal_balances(spark, tmp_path):
    rows = [(0, None, 0, -5.0), (1, "b", 0, 1.0), (2, "a", 0, 1.0), (3, "c", 0, None), (4, "z", 1, 2.0), (5, "y", 1, 2.0), (6, "x", 1, 3.0), (7, "w", 2, None)]
    path = folder(tmp_path, customer=dict(zip(("c_custkey", "c_name", "c_nationkey", "c_acctbal"), map(list, zip(*rows, strict=True)), strict=True)))
    got, want = both(spark, "a11_first_value", path)
    assert got == want
    again = entry_point.queries()["a11_first_value"](spark, path)
    assert sorted((r["c_nationkey"], r["poorest"]) for r in again.collect()) == [(0, "b"), (1, "z"), (2, None)]


def test_whole_against_modules(spark, full):
    got, want = both(spark, "g17b_whole_against_modules", full)
    assert got == want


def test_upper_tail(spark, full):
    got, want = both(spark, "n6_upper_tail", full)
    assert got == want


def test_two_tails(spark, full):
    got, want = both(spark, "n7_two_tails", full)
    assert got == want


def test_deviation_plus_one(spark, full):
    got, want = both(spark, "n8_deviation_plus_one", full)
    assert got == want


def test_groups_rest_on_fitting_facts_alone(spark):
    lookup = adapter.lookup(spark, SF)
    fits = lookup.select(F.lit("made").alias("kind"), F.col("pyov").alias("grp")).union(lookup.select(F.lit("taken"), "rec")).distinct()
    every = tables.facts(spark, SF)
    want, got = every.join(fits, ["kind", "grp"]).select(every.columns), tables.fitting_facts(spark, SF, lookup)
    assert 0 < got.count() < every.count() / 3
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    rep = adapter.repertoires(spark, SF)
    groups, plain = adapter.groups(spark, SF), repertoire.collapsed(rep)
    assert groups.select(plain.columns).exceptAll(plain).isEmpty() and groups.count() == plain.count() > 0
    assert adapter.members(spark, SF, groups).exceptAll(repertoire.members(rep, plain)).isEmpty()
