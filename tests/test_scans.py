"""Running values over ranges, label vectors, nulls with hubs, shared fields, inspection."""

from __future__ import annotations

import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from skeinwork.operators import inference, metrics, network, nulls
from skeinwork.plans import registry
from skeinwork.sources import files
from tests.test_network import layer

SF = "/root/testdata/sf0.001"


def test_running_values_of_groups(spark):
    """Groups of one row to hundreds, one of them most rows, over more ranges than groups."""
    rng = random.Random(3)
    rows = [("hub" if k % 3 else f"g{k % 11}", k, rng.randint(-50, 50)) for k in range(900)]
    df = spark.createDataFrame(rows, "g string, k int, x int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r["k"]: r for r in network.running(df, ["k"], ["g"], sums={"s": F.col("x")}, mins={"m": F.col("x")}).collect()}
        falling = {r["k"]: r["s"] for r in network.running(df, [F.desc("k")], sums={"s": F.lit(1).cast("long")}).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in {r[0] for r in rows}:
        seen = []
        for _, k, x in sorted(r for r in rows if r[0] == g):
            assert (found[k]["s"], found[k]["m"]) == (sum(seen), min(seen, default=None))
            seen.append(x)
    assert falling == {k: 899 - k for k in range(900)}


def test_adjusted_values_with_ties(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice([0.001, 0.02, 0.02, 0.3, 1.0, rng.random()])) for g in "ab" for _ in range(60)] + [("a", None)]
    got = sorted(tuple(r) for r in inference.adjusted(spark.createDataFrame(rows, "g string, p double"), "p", ["g"]).where("p is not null").collect())
    want = []
    for g in "ab":
        own = sorted(p for h, p in rows if h == g and p is not None)
        n = len(own)
        want += [(g, p, min(1.0, *(q * n / sum(x <= q for x in own) for q in own if q >= p))) for p in own]
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want])
    assert inference.adjusted(spark.createDataFrame(rows, "g string, p double"), "p").count() == len(rows)


def test_moments_of_prefixes(spark):
    rng = random.Random(7)
    values = [1e6 + rng.random() for _ in range(60)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)] + [(99, float("nan")), (98, None)], "k int, x double").repartition(4)
    got = {r["n"]: r for r in inference.prefixes(df, "x", "k", steps=[1, 2, 30, 60]).collect()}
    assert sorted(got) == [1, 2, 30, 60] and got[1]["sd"] is None
    for n in (2, 30, 60):
        assert got[n]["mean"] == pytest.approx(statistics.mean(values[:n]), rel=1e-12) and got[n]["sd"] == pytest.approx(statistics.stdev(values[:n]), rel=1e-6)
        assert (got[n]["low"], got[n]["high"]) == (min(values[:n]), max(values[:n]))


def test_label_vectors_are_as_single_starts(spark):
    edges = network.saved(layer(spark, {(a, i) for a in range(9) for i in range(9) if (a * i + a) % 4 < 2}))
    reps = nulls.replicates(spark, 5)
    a, i = (network.saved(metrics.random_labels(edges, c, reps, 3, 1)) for c in ("agent", "item"))
    together = metrics.brim(edges, a, i, iterations=30, by=["replicate"])
    own = edges.withColumn("replicate", F.lit(0).cast("long"))
    nodes = {"first": F.lit(0).cast("long"), "starts": F.lit(5).cast("long"), "modules": F.lit(3)}
    vectors = [metrics.random_vectors(own.select("replicate", c).distinct().withColumns(nodes), c, 1) for c in ("agent", "item")]
    found = [network.saved(x) for x in metrics.search(own, *map(network.saved, vectors), ["replicate"])]
    for one, many, node in zip(together, found, ("agent", "item"), strict=True):
        assert {(r["replicate"], r[node], r["label"]) for r in one.collect()} == {(r["s"], r[node], r["l"]) for r in many.select(node, F.inline("v")).collect()}
    q = {r["replicate"]: r["q"] for r in metrics.barber(edges, *together, ["replicate"]).collect()}
    assert {r["s"]: r["q"] for r in metrics.barbers(own, *found, ["replicate"]).collect()} == pytest.approx(q)
    ended = [network.saved(x) for x in metrics.finished(own, *found, ["replicate"])]
    assert {r["s"]: r["q"] for r in metrics.barbers(own, *ended, ["replicate"]).collect()} == pytest.approx(q)
    for s in range(5):
        labels = {x["l"] for v in ended for r in v.collect() for x in r["v"] if x["s"] == s}
        assert labels == set(range(len(labels)))


def test_a_sparse_layer_of_one_module_is_dealt_out(spark):
    """150 agents and items, an edge each: one label everywhere, a density of 1 / 150; in a dense layer it stays one."""
    sparse = [(0, f"a{k:03d}", f"i{k:03d}") for k in range(150)]
    dense = [(1, f"a{k}", f"i{j}") for k in range(4) for j in range(4)]
    edges = spark.createDataFrame(sparse + dense, "replicate long, agent string, item string")
    same = F.array(F.struct(F.lit(0).alias("s"), F.lit(7).cast("long").alias("l")), F.struct(F.lit(1).alias("s"), F.when(F.col("replicate") == 0, F.lit(3)).otherwise(2).cast("long").alias("l")))
    a, i = (edges.select("replicate", c).distinct().withColumn("v", same) for c in ("agent", "item"))
    ended = metrics.finished(edges, a, i, ["replicate"])
    for node, found in zip(("agent", "item"), ended, strict=True):
        rows = found.collect()
        names = sorted(r[node] for r in rows if r["replicate"] == 0)
        assert all([x["l"] for x in r["v"]] == [names.index(r[node]) % 5] * 2 for r in rows if r["replicate"] == 0)
        assert all([x["l"] for x in r["v"]] == [0, 0] for r in rows if r["replicate"] == 1)
    got = {(r["replicate"], r["s"]): r["n_modules"] for r in metrics.barbers(edges, *ended, ["replicate"]).collect()}
    assert got == {(0, 0): 5, (0, 1): 5, (1, 0): 1, (1, 1): 1}


def test_module_comparison(spark):
    """What two layers' labels give, nodes of one layer alone left out."""
    one = spark.createDataFrame([("FG_001", "FG", 0), ("FG_002", "FG", 0), ("FG_003", "FG", 1), ("PYO_01", "PYO", 1), ("FG_009", "FG", 1)], "node string, node_type string, label long")
    two = spark.createDataFrame([("FG_001", "FG", 2), ("FG_002", "FG", 2), ("FG_003", "FG", 2), ("PYO_01", "PYO", 0), ("FG_008", "FG", 0)], "node string, node_type string, label long")
    assert sorted(tuple(r) for r in metrics.compared(one, two).collect()) == [("FG", 0, 2, 2), ("FG", 1, 2, 1), ("PYO", 1, 0, 1)]


@pytest.mark.parametrize("limit", [20_000, 10])
def test_nulls_of_a_layer_with_a_hub(spark, monkeypatch, limit):
    """An agent with a third of all edges; by tasks, and by rows and joins."""
    monkeypatch.setattr(nulls, "BUCKET_EDGES", limit)
    monkeypatch.setattr(nulls, "BUCKET", 8)
    rng = random.Random(2)
    edges = {("hub", i) for i in range(60)} | {(a, i) for a in range(20) for i in rng.sample(range(80), 6)}
    own = network.saved(layer(spark, {(str(a), i) for a, i in edges}))
    reps = nulls.replicates(spark, 2)
    made, told = nulls.swapped(own, reps, swaps=100)
    counts = told.collect()
    assert {r["swaps"] for r in counts} == {100} and all(100 <= r["tries"] <= 1000 for r in counts)
    ball = nulls.curveball(own, reps, rounds=3)
    for found in (made, ball):
        found = network.saved(found)
        assert nulls.degrees_kept(own, found).where("changed > 0").isEmpty()
        assert found.count() == found.distinct().count() == 2 * len(edges)
        moved = {r["replicate"]: r["count"] for r in found.join(own, ["agent", "item"], "left_anti").groupBy("replicate").count().collect()}
        assert len(moved) == 2 and min(moved.values()) > len(edges) / 8
    again = nulls.curveball(own, reps, rounds=3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, ball.collect()))
    none, told = nulls.swapped(own.where("item = 'i1'"), nulls.replicates(spark, 1), swaps=5, tries=30)
    assert told.first()["swaps"] == 0 and none.count() == own.where("item = 'i1'").count()


def test_fields_that_all_records_share(spark):
    rows = [{"a": 1, "b": {"c": "x", "d": [1]}, "e": 2.5}, {"a": 2, "b": {"c": "y"}, "e": 3, "f": True}, {"a": 3, "b": {"c": "z", "g": None}, "e": -1}]
    got = files.shared_fields(spark.createDataFrame([(json.dumps(r),) for r in rows], "r string"), "r")
    assert got.columns == ["a", "b_c", "e"] and sorted((r["a"], r["b_c"], float(r["e"])) for r in got.collect()) == [(1, "x", 2.5), (2, "y", 3.0), (3, "z", -1.0)]
    assert files.shared_fields(spark.createDataFrame([], "r string"), "r").columns == []


def test_inspection_walks_nested_sources(spark):
    df = spark.sql("select 1 as a, named_struct('x', 'q', 'y', array(3, null, 2)) as s, array(named_struct('z', 5), null) as l union all select null, null, array(named_struct('z', 4))")
    got = {r["path"]: tuple(r)[1:] for r in files.inspected(df).collect()}
    assert got == {
        "a": ("int", 1, 1, "1"), "s": ("struct", 1, 1, None), "s.x": ("string", 1, 1, "q"), "s.y": ("array", 1, 1, None), "s.y[]": ("int", 2, 1, "2"),
        "l": ("array", 2, 0, None), "l[]": ("struct", 2, 1, None), "l[].z": ("int", 2, 1, "4"),
    }


def test_first_rows_of_a_group_are_limited_early(spark):
    plan = registry.queries()["c23_strategy_samples"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
