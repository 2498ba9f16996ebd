"""Small graphs with answers that can be checked by eye."""

import pytest
from pyspark.sql import functions as F

import arcweave as aw
from arcweave import col


@pytest.fixture(scope="module")
def crew(spark):
    """Sailors who teach each other, with two ways from Ilse to Mina, a circle of Juno, Mina and Nils, and a loop at Kofi."""
    g = aw.Hypergraph.connect("memory://", spark)
    rows = [(1, "Ilse", "Bergen", 30), (2, "Juno", "Cork", 44), (3, "Kofi", "Cork", 19), (4, "Lars", "Brest", 52), (5, "Mina", "Bergen", 36), (6, "Nils", "Bergen", 27), (7, "Zed", None, None), (8, "NULL", "a|b", 1)]
    g = g.with_nodes("Sailor", spark.createDataFrame(rows, "_id long, name string, port string, age int"))
    g = g.with_nodes(["Boat", "Vessel"], spark.createDataFrame([(1, "Gull"), (21, "Tern")], "_id long, name string"))
    teaches = [(50, 1, 2), (51, 1, 3), (52, 1, 4), (53, 2, 5), (54, 3, 5), (55, 4, 6), (56, 5, 6), (57, 6, 2), (58, 3, 3)]
    g = g.with_edges("TEACHES", spark.createDataFrame(teaches, "_id long, a long, b long"), ("Sailor", "a"), ("Sailor", "b"), id="_id")
    sails = [(70, 1, 1, 1998), (71, 4, 21, 2003), (72, 4, 21, 2009)]
    g = g.with_edges("SAILS_ON", spark.createDataFrame(sails, "_id long, a long, b long, since int"), ("Sailor", "a"), ("Boat", "b"), id="_id")
    inc = [(80, 0, "skipper", "node", "Sailor", 2), (80, 1, "mate", "node", "Sailor", 3), (80, 2, "mate", "node", "Sailor", 5), (80, 3, "after", "hyperedge", "VOYAGE", 81), (81, 0, "skipper", "node", "Sailor", 6), (81, 1, "ship", "node", "Boat", 21)]
    inc = spark.createDataFrame(inc, "edge_id long, ord int, role string, target_kind string, target_label string, target_id long")
    return g.with_hyperedges("VOYAGE", spark.createDataFrame([(80, "race"), (81, "survey")], "_id long, topic string"), incidence=inc)


def names(frame, column="name"):
    return sorted(r[column] for r in frame.select(**{column: col(column)}).collect())


def test_out_in_both(crew):
    one = lambda n: crew.nodes("Sailor").filter(col("name") == n)
    assert names(one("Ilse").expand("TEACHES", to="Sailor", as_="x").select(name=col("x.name"))) == ["Juno", "Kofi", "Lars"]
    assert names(one("Mina").expand("TEACHES", direction="in", to="Sailor", as_="x").select(name=col("x.name"))) == ["Juno", "Kofi"]
    assert names(one("Juno").expand("TEACHES", direction="both", to="Sailor", as_="x").select(name=col("x.name"))) == ["Ilse", "Mina", "Nils"]


def test_a_loop_counts_once(crew):
    kofi = crew.nodes("Sailor").filter(col("name") == "Kofi").expand("TEACHES", direction="both", to="Sailor", as_="x")
    assert names(kofi.select(name=col("x.name"))) == ["Ilse", "Kofi", "Mina"]


def test_parallel_edges_and_same_ids_of_two_labels(crew):
    f = crew.nodes("Sailor").expand("SAILS_ON", as_="c", edge_as="e").select(p=col("Sailor.name"), c=col("c.name"), since=col("e.since"))
    assert sorted(map(tuple, (r.values() for r in f.collect()))) == [("Ilse", "Gull", 1998), ("Lars", "Tern", 2003), ("Lars", "Tern", 2009)]
    assert crew.nodes("Vessel").count() == 2
    assert crew.node_labels() == ["Boat", "Sailor", "Vessel"]


def test_two_hops_and_walks(crew):
    ilse = crew.nodes("Sailor").filter(col("name") == "Ilse")
    assert names(ilse.expand("TEACHES", hops=2, to="Sailor", as_="x").select(name=col("x.name"))) == ["Kofi", "Mina", "Mina", "Nils"]
    both = [ilse.expand("TEACHES", hops=h, to="Sailor", as_="x").count() for h in (1, 2, (1, 2))]
    assert both[2] == both[0] + both[1]
    start = ilse.expand("TEACHES", hops=(0, 1), to="Sailor", as_="x")
    assert names(start.select(name=col("x.name"))) == ["Ilse", "Juno", "Kofi", "Lars"]


def test_unbounded_walks_end_since_edges_are_not_repeated(crew):
    """The longest one: over the loop at Kofi, then once around."""
    for name, longest in (("Ilse", 6), ("Nils", 3)):
        walks = crew.nodes("Sailor").filter(col("name") == name).expand("TEACHES", hops=(1, None), to="Sailor", as_="x")
        assert max(r["n"] for r in walks.select(n=aw.path_length(col("_path"))).collect()) == longest


def test_shortest_and_all_paths(crew):
    i, j, m, n, z = (crew.nodes("Sailor").filter(col("name") == x) for x in ("Ilse", "Juno", "Mina", "Nils", "Zed"))
    found = aw.shortest_path(i, m, "TEACHES", direction="out")
    assert [r["length"] for r in found.select("length").collect()] == [2, 2]
    young = found.filter(aw.all_(aw.nodes(col("_path")), col("age") < 40))
    assert [[x["_id"] for x in r["p"]] for r in young.select(p=aw.nodes(col("_path"))).collect()] == [[1, 3, 5]]
    assert aw.shortest_path(j, n, "TEACHES", direction="out").select("length").collect() == [{"length": 2}]
    assert aw.shortest_path(j, n, "TEACHES", direction="both").select("length").collect() == [{"length": 1}]
    assert aw.shortest_path(i, z, "TEACHES").count() == 0
    assert aw.all_paths(i, m, "TEACHES", max_hops=4, direction="out").count() == 4


def test_optional_expand_keeps_rows(crew):
    f = crew.nodes("Sailor").optional_expand("SAILS_ON", to="Boat", as_="c").group_by(name=col("Sailor.name")).agg(n=aw.count(col("c.name")))
    got = {r["name"]: r["n"] for r in f.collect()}
    assert got["Lars"] == 2 and got["Zed"] == 0


def test_filter_after_expand_equals_filter_before(crew):
    p = crew.nodes("Sailor")
    before = p.filter(col("age") > 30).expand("TEACHES", to="Sailor", as_="x").select(a=col("Sailor.id"), b=col("x.id"))
    after = p.expand("TEACHES", to="Sailor", as_="x").filter(col("Sailor.age") > 30).select(a=col("Sailor.id"), b=col("x.id"))
    assert before.data.exceptAll(after.data).count() == after.data.exceptAll(before.data).count() == 0


def test_groups_nulls_and_empty(crew):
    p = crew.nodes("Sailor")
    got = {r["port"]: r["count"] for r in p.group_by("port").count().collect()}
    assert got == {"Bergen": 3, "Cork": 2, "Brest": 1, None: 1, "a|b": 1}
    none = p.filter(col("age") > 1000)
    assert none.agg(n=aw.count()).collect() == [{"n": 0}]
    assert none.group_by("port").count().collect() == []
    assert p.limit(0).count() == 0 and p.offset(100).count() == 0


def test_exists(crew):
    p = crew.nodes("Sailor")
    works = p.expand("SAILS_ON")
    assert names(p.filter(aw.exists(works))) == ["Ilse", "Lars"]
    assert names(p.filter(~aw.exists(works) & (col("age") > 30))) == ["Juno", "Mina"]
    assert names(p.filter(aw.exists(works) | (col("name") == "Zed"))) == ["Ilse", "Lars", "Zed"]
    with pytest.raises(ValueError, match="on="):
        p.filter(aw.exists(crew.nodes("Boat")))


def test_hyperedges_of_an_incidence_table(crew):
    m = crew.hyperedges("VOYAGE")
    assert m.roles() == ["after", "mate", "ship", "skipper"]
    rows = m.expand("skipper", as_="h").expand("mate", as_="g").select(t=col("topic"), h=col("h.name"), g=col("g.name"))
    assert sorted(map(tuple, (r.values() for r in rows.collect()))) == [("race", "Juno", "Kofi"), ("race", "Juno", "Mina")]
    assert {r["_arity"] for r in m.select("_arity").collect()} == {2, 4}
    assert m.where_role("mate", 3).count() == 1 and m.where_role("mate", crew.nodes("Sailor").filter(col("age") > 100)).count() == 0
    assert names(crew.nodes("Sailor").filter(col("name") == "Kofi").expand_role("VOYAGE", "mate", "mate", as_="x").select(name=col("x.name"))) == ["Mina"]
    assert crew.nodes("Sailor").hyperedges_of("VOYAGE", as_="m").count() == 4


def test_names(crew):
    p = crew.nodes("Sailor").expand("TEACHES", to="Sailor", as_="x")
    with pytest.raises(aw.AmbiguousColumn):
        p.select("name")
    with pytest.raises(aw.ColumnNotFound):
        p.select("salary")
    with pytest.raises(TypeError):
        crew.nodes("Sailor").filter(col("age") == "30")
    with pytest.raises(ValueError):
        crew.nodes("Sailor").select("name", name=col("port"))
    with pytest.raises(TypeError):
        aw.lit(object())
    out = p.group_by(col("Sailor.name")).agg(n=aw.count()).select("Sailor.name", "n")
    assert out.schema().column_names() == ["Sailor.name", "n"]


def test_three_valued_logic(spark, crew):
    p = crew.nodes("Sailor")
    assert names(p.filter((col("age") > 30) | (col("name") == "Zed"))) == ["Juno", "Lars", "Mina", "Zed"]
    assert "Zed" not in names(p.filter(~(col("age") > 30)))
    assert p.filter((col("age") > 30).is_unknown()).count() == 1


def test_parameters_udfs_and_wildcards(crew):
    p = crew.nodes("Sailor")
    assert names(p.bind(least=50).filter(col("age") > aw.param("least"))) == ["Lars"]
    aw.register_udf("shout", lambda x: F.concat(F.upper(x), F.lit("!")))
    assert p.filter(col("_id") == 1).select(s=aw.udf("shout", col("name"))).collect() == [{"s": "ILSE!"}]
    assert p.select("Sailor.*").schema().has_column("Sailor.name")
    with pytest.raises(ValueError):
        p.filter(col("age") > aw.param("nothing"))


def test_explain_and_pushdown(spark, crew, tmp_path):
    crew.nodes("Sailor").to_df().toDF("id", "labels", "label", "name", "port", "age").write.parquet(str(tmp_path / "p"))
    g = aw.Hypergraph(spark).with_nodes("Sailor", spark.read.parquet(str(tmp_path / "p")), "id")
    f = g.nodes("Sailor").filter(col("age") > 30).select("name")
    assert f.explain("logical").splitlines()[0].startswith("Project")
    plan = f.explain("physical")
    assert "GreaterThan(age,30)" in plan and "port" not in plan.split("ReadSchema")[1].split("\n")[0]
    for mode in ("optimized", "cost"):
        assert f.explain(mode)
    with pytest.raises(ValueError):
        f.explain("magic")


def test_inference(crew):
    rule = aw.Rule(("NEAR", "x", "z"), (("TEACHES", "x", "y"), ("TEACHES", "y", "z")), "two")
    near = crew.infer([rule], mode="standard").edges("NEAR")
    assert (1, 5) in {(r["s"], r["d"]) for r in near.select(s=col("_src"), d=col("_dst")).collect()}
    reach = [aw.Rule(("REACH", "x", "y"), (("TEACHES", "x", "y"),)), aw.Rule(("REACH", "x", "z"), (("REACH", "x", "y"), ("REACH", "y", "z")))]
    assert crew.infer(reach).edge_count("REACH") == 21
    with pytest.raises(ValueError):
        aw.Rule(("A", "x", "q"), (("TEACHES", "x", "y"),))
    with pytest.raises(ValueError):
        crew.infer([aw.Rule(("A", "x", "y"), (("NOPE", "x", "y"),))])


def test_subgraph_and_degree(crew):
    sub = crew.subgraph({"Sailor": "age < 40"})
    assert sub.node_count("Sailor") == 5 and sub.edge_count("TEACHES") == 4 and sub.hyperedge_count() == 1
    got = {r["name"]: r["d"] for r in crew.nodes("Sailor").degree("TEACHES", "out", as_="d").select("name", "d").collect()}
    assert got["Ilse"] == 3 and got["Zed"] == 0


def test_pandas_arrow_iteration(crew):
    p = crew.nodes("Sailor").select("name").order_by("name")
    assert len(p.collect(as_pandas=True)) == 8 and p.collect(as_arrow=True).num_rows == 8
    assert next(iter(p))["name"] == "Ilse" and p.first()["name"] == "Ilse" and len(p) == 8 and p.exists()


def test_edges_of_two_role_hyperedges(spark):
    rows = spark.createDataFrame([(1, 2, 9.0)], "a long, b long, w double")
    g = aw.Hypergraph(spark).with_nodes("N", spark.createDataFrame([(1,), (2,)], "_id long")).with_hyperedges("LINK", rows, [("source", "N", "a"), ("target", "N", "b")])
    assert g.edge_types() == ["LINK"]
    assert g.nodes("N").expand("LINK", to="N", as_="x", edge_as="e").select(x=col("x.id"), w=col("e.w")).collect() == [{"x": 2, "w": 9.0}]


def test_profile_tags_and_executors(spark, crew):
    assert crew.nodes("Sailor").profile()["rows"] == 8
    with crew.tagged("mine"):
        assert "mine" in spark.getTags()
    assert "mine" not in spark.getTags()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    aw.connect("memory://", spark, executor=aw.Executor.local(parallelism=3))
    assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ids_of_hyperedges(spark):
    """Those of the table, which the incidence rows name; without any there's nothing they could name."""
    data, inc = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "_id long, t string"), spark.createDataFrame([(1, 0, "r", "node", "N", 5)], "edge_id long, ord int, role string, target_kind string, target_label string, target_id long")
    g = aw.Hypergraph(spark).with_nodes("N", spark.createDataFrame([(5,)], "_id long")).with_hyperedges("H", data, incidence=inc)
    assert [r["t"] for r in g.hyperedges("H").where_role("r", 5).select("t").collect()] == ["x", "x"]
    with pytest.raises(ValueError, match="id column"):
        aw.Hypergraph(spark).with_hyperedges("H", data.drop("_id"), incidence=inc)
