"""Snapshots and transactions."""

import pytest

import arcweave as aw
from arcweave import col
from arcweave.sources.store import Store


def test_snapshots_travel_in_time(spark, tmp_path):
    g = aw.create(f"file://{tmp_path}/g", spark)
    with g.transaction() as t:
        a, b = t.create_node("Person", name="A", age=1), t.create_node("Person", name="B", age=2)
        t.create_edge("KNOWS", ("Person", a), ("Person", b), since=2020)
        t.create_hyperedge("MEETING", [("host", "Person", a), ("guest", "Person", b)], topic="x")
        assert t.pending_count() == 4
    first = t.result
    assert first.store[1] == 1 and first.node_count() == 2 and first.hyperedge_count() == 1
    second = first.transaction()
    second.update("Person", a, age=10, city="X")
    second.delete_node("Person", b)
    third = second.commit(name="after")
    assert third.edge_count() == 0 and third.hyperedge_count() == 0
    assert third.nodes("Person").select("name", "age", "city").collect() == [{"name": "A", "age": 10, "city": "X"}]
    old = aw.connect(f"file://{tmp_path}/g", spark, snapshot=1)
    assert old.edge_count() == 1 and old.nodes("Person").expand("KNOWS", to="Person", as_="x").count() == 1
    named = aw.connect(f"file://{tmp_path}/g", spark, snapshot="after")
    assert named.store[1] == 2
    store = Store(spark, f"file://{tmp_path}/g")
    assert [s["snapshot"] for s in store.snapshots()] == [0, 1, 2]
    with pytest.raises(KeyError):
        store.open("never")


def test_unchanged_tables_are_not_written_again(spark, tmp_path):
    g = aw.create(f"file://{tmp_path}/g", spark)
    t = g.transaction()
    t.insert_nodes("A", spark.range(5).withColumnRenamed("id", "_id"))
    t.create_node("B", x=1.5)
    g = t.commit()
    t = g.transaction()
    t.create_node("B", x=2.5)
    g = t.commit()
    m = Store(spark, f"file://{tmp_path}/g").manifest(2)
    assert {n["labels"][0]: n["path"].split("/")[1] for n in m["nodes"]} == {"A": "1", "B": "2"}
    assert g.node_count("A") == 5 and g.node_count("B") == 2


def test_rollback_and_closed(spark):
    g = aw.connect("memory://", spark)
    with pytest.raises(ZeroDivisionError):
        with g.transaction() as t:
            t.create_node("A", x=1)
            1 / 0
    assert t.result is None and not t.is_active()
    with pytest.raises(RuntimeError):
        t.create_node("A", x=1)
    with pytest.raises(ValueError):
        g.transaction().create_hyperedge("H", [("a", "A", 1)])


def test_namespaces(spark):
    g = aw.connect("memory://", spark).with_nodes("A", spark.range(3).withColumnRenamed("id", "_id"))
    other = g.with_namespace("other")
    assert other.node_labels() == [] and other.with_namespace(None).node_count("A") == 3


def test_schema(spark):
    g = aw.Hypergraph(spark).with_nodes("A", spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "_id long, k string"))
    g = g.with_edges("E", spark.createDataFrame([(1, 9)], "a long, b long"), ("A", "a"), ("A", "b"))
    s = aw.GraphSchema(nodes={"A": {"k": aw.Property("string", nullable=False, unique=True)}, "B": {}}, edges={"E": {}}, strict=True, references=True)
    got = sorted((r.kind, r.property) for r in g.with_schema(s).violations().collect())
    assert got == [("DanglingReference", "_dst"), ("MissingEntity", None), ("NotUnique", "k"), ("NotUnique", "k"), ("NullNotAllowed", "k")]
    assert g.nodes("A").filter(col("k") == "x").count() == 2


def test_entities_by_what_create_gave(spark):
    t = aw.connect("memory://", spark).transaction()
    a, b = t.create_node("A", x=1), t.create_node("B", x=2)
    e = t.create_edge("E", a, b)
    h = t.create_hyperedge("H", {"left": a, "right": b}, w=1.0)
    t.update(a, x=5)
    t.delete_edge(e)
    g = t.commit()
    assert g.nodes("A").select("x").collect() == [{"x": 5}] and g.edge_count("E") == 0
    assert g.hyperedges("H").expand("right", as_="r").select(i=col("r.id"), x=col("r.x")).collect() == [{"i": b, "x": 2}]
    t = g.transaction()
    t.delete_hyperedge(h)
    assert t.commit().hyperedge_count("H") == 0
    with pytest.raises(TypeError):
        g.transaction().create_edge("E", 1, 2)
