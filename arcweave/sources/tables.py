"""The star-schema tables as a hypergraph, without copying them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..graph import Hypergraph


#: Schemas of tables by application and path, the last ones: they are inferred once; files are listed by each query.
_SCHEMAS: dict[tuple[str, str], StructType] = {}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        while len(_SCHEMAS) >= 100:
            _SCHEMAS.pop(next(iter(_SCHEMAS)))
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def read_any(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """Any built-in source of Spark: parquet, orc, json, csv, text, binaryFile, jdbc."""
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def distinct(rows: DataFrame, part: int = 1 << 20) -> DataFrame:
    """Distinct rows, dealt out by all columns to a partition for each so many bytes that the optimiser takes rows for.

    Adaptive execution would join small partitions up to as few as there are cores, and the hash tables of one task would grow with the
    table: compressed pairs of numbers take some thirty times their size in them.
    """
    parts = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // part
    # Where one would do, and where there is no estimate (then it is the largest number), Spark chooses.
    return (rows.repartition(parts, *rows.columns) if 1 < parts < 1_000_000 else rows).distinct()


def bound_parts(spark: SparkSession, most: int = 8 << 20) -> None:
    """Adaptive execution joins shuffled partitions of this session up to so many bytes at most, for the same reason as in distinct()."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > most:
        spark.conf.set(name, str(most))


def star(spark: SparkSession, folder: str) -> Hypergraph:
    """The hypergraph of a folder of tables; see build_star."""
    bound_parts(spark)
    return build_star(spark, folder)


def build_star(spark: SparkSession, folder: str) -> Hypergraph:
    """Nodes Region, Nation, Customer, Supplier, Part, Order, User, Document, Vector, Page and Turn; edges IN_REGION,
    IN_NATION, PLACED, SUPPLIES, DID and NEXT_TURN; hyperedges LINE_ITEM of roles order, part and supplier.

    Only tables that a query reaches are read, and of those only its columns.
    """
    t = lambda name: read(spark, folder, name)
    g = Hypergraph(spark)
    for label, name, key in (
        ("Region", "region", "r_regionkey"), ("Nation", "nation", "n_nationkey"), ("Customer", "customer", "c_custkey"), ("Supplier", "supplier", "s_suppkey"),
        ("Part", "part", "p_partkey"), ("Order", "orders", "o_orderkey"), ("Document", "documents", "doc_id"), ("Vector", "embeddings", "vec_id"), ("Page", "pages", "page_id"),
    ):
        g = g.with_nodes(label, t(name), key)
    events, talk = t("events"), t("conversations")
    turns = talk.withColumn("turn_id", F.col("conv_id") * 1_000_000 + F.col("turn"))
    g = g.with_nodes("User", events.select("user_id").distinct(), "user_id").with_nodes("Turn", turns, "turn_id")
    after = F.lead("turn_id").over(Window.partitionBy("conv_id").orderBy("turn"))
    lines = t("lineitem")
    return (
        g.with_edges("IN_REGION", t("nation"), ("Nation", "n_nationkey"), ("Region", "n_regionkey"), id="n_nationkey", properties=[])
        .with_edges("IN_NATION", t("customer"), ("Customer", "c_custkey"), ("Nation", "c_nationkey"), id="c_custkey", properties=[])
        .with_edges("IN_NATION", t("supplier"), ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), id="s_suppkey", properties=[])
        .with_edges("PLACED", t("orders"), ("Customer", "o_custkey"), ("Order", "o_orderkey"), id="o_orderkey", properties=["o_orderdate", "o_orderpriority"])
        .with_edges("SUPPLIES", distinct(lines.select("l_suppkey", "l_partkey")), ("Supplier", "l_suppkey"), ("Part", "l_partkey"))
        .with_edges("NEXT_TURN", turns.select("turn_id", after.alias("next_id")), ("Turn", "turn_id"), ("Turn", "next_id"), id="turn_id")
        .with_hyperedges("LINE_ITEM", lines, [("order", "Order", "l_orderkey"), ("part", "Part", "l_partkey"), ("supplier", "Supplier", "l_suppkey")])
    )
