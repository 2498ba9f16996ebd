"""Pairs of rows with values in common: all of them, dealt out by their number."""

import math
import os
from collections import Counter

import pytest

import arcweave as aw
from arcweave import col
from arcweave.operators import pairs
from arcweave.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


def things(spark):
    nan, odd = float("nan"), [(900, "x", 0.0), (901, "x", -0.0), (902, "y", float("nan")), (903, "y", float("nan")), (904, None, 1.0), (905, "x", None)]
    rows = [(i, "hot", float(i % 2)) for i in range(60)] + [(100 + i, "abc"[i % 3], nan if i % 5 == 0 else float(i % 4)) for i in range(40)] + odd
    return rows, aw.Hypergraph.connect("memory://", spark).with_nodes("Thing", spark.createDataFrame(rows, "_id long, k string, v double"))


def test_meet_gives_every_pair_in_many_tasks(spark, monkeypatch):
    """Groups larger than a block too, nulls not at all, one zero, one NaN."""
    monkeypatch.setattr(pairs, "BLOCK", 7)
    monkeypatch.setattr(pairs, "TASK", 100)
    rows, g = things(spark)
    equal = lambda x, y: x is not None and y is not None and (x == y or (x != x and y != y))
    want = Counter((a[0], b[0]) for a in rows for b in rows if equal(a[1], b[1]) and equal(a[2], b[2]))
    out = g.nodes("Thing", alias="a").meet(g.nodes("Thing", alias="b"), [("a.k", "b.k"), ("a.v", "b.v")]).select(a=col("a.id"), b=col("b.id"))
    df = out.to_df()
    assert Counter((r[0], r[1]) for r in df.collect()) == want and (900, 901) in want and (902, 903) in want
    sizes = df.rdd.glom().map(len).collect()
    assert len(sizes) == math.floor(sum(want.values()) / 100) + 1 and max(sizes) < sum(want.values()) / 4


def test_meet_of_nothing_and_of_other_types(spark):
    _, g = things(spark)
    a, b = g.nodes("Thing", alias="a"), g.nodes("Thing", alias="b")
    assert a.meet(b.filter(col("b.k") == "none"), [("a.k", "b.k")]).count() == 0
    with pytest.raises(TypeError):
        a.meet(b, [("a.k", "b._id")])
    with pytest.raises(ValueError):
        a.meet(a, [("a.k", "a.k")])


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_any_shared_value_is_dealt_by_pairs(spark, monkeypatch):
    monkeypatch.setattr(pairs, "TASK", 20)
    df = QUERIES["any_shared_value"](spark, FOLDER)
    assert df.rdd.getNumPartitions() > 10 and df.count() == df.distinct().count()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_cycle_by_nation_is_dealt_by_pairs(spark, monkeypatch):
    monkeypatch.setattr(pairs, "TASK", 5)
    assert QUERIES["cycle_by_nation"](spark, FOLDER).rdd.getNumPartitions() > 10
