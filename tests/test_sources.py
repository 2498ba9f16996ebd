"""Frames out to files and back."""

import pytest

import arcweave as aw
from arcweave import col
from arcweave.sources.tables import read_any


@pytest.mark.parametrize("format,schema", [("parquet", None), ("orc", None), ("json", "i long, s string"), ("csv", "i long, s string")])
def test_write_and_read(spark, tmp_path, format, schema):
    rows = spark.createDataFrame([(1, "a"), (2, "b|c"), (3, None)], "_id long, s string")
    aw.Hypergraph(spark).with_nodes("N", rows).nodes("N").select(i=col("id"), s=col("s")).write(str(tmp_path / "x"), format=format)
    got = read_any(spark, str(tmp_path / "x"), format, schema)
    assert sorted((r.i, r.s) for r in got.collect() if r.s) == [(1, "a"), (2, "b|c")] and got.count() == 3


def test_sources_join_a_graph(spark, tmp_path):
    spark.createDataFrame([(1, 2)], "a long, b long").write.orc(str(tmp_path / "e"))
    g = aw.connect("memory://", spark).with_nodes("N", spark.createDataFrame([(1,), (2,)], "_id long")).with_edges("E", read_any(spark, str(tmp_path / "e"), "orc"), ("N", "a"), ("N", "b"))
    assert g.nodes("N").expand("E", as_="x").select(x=col("x.id")).collect() == [{"x": 2}]
    assert g.edge_properties("E") == [] and g.node_properties("N") == []
