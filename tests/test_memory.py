"""What a task holds stays as it is when tables grow."""

from arcweave.sources.tables import bound_parts, distinct


def test_distinct_rows_are_dealt_out_by_the_size_of_the_table(spark, tmp_path):
    for n in (1, 4):
        spark.range(n * 40_000).selectExpr("xxhash64(id) as a", "id % 7 as b", "xxhash64(id, 1) as c").union(spark.sql("select 1L, 1L, 1L")).repartition(1).write.parquet(f"{tmp_path}/{n}")
    small, large = (spark.read.parquet(f"{tmp_path}/{n}") for n in (1, 4))
    again = large.union(large).select("a", "b")
    few, many = (distinct(x, 1 << 17).rdd.getNumPartitions() for x in (small.select("a", "b"), large.select("a", "b")))
    assert 2 <= few < many and 3 * few <= many <= 6 * few
    assert sorted(distinct(again, 1 << 17).collect()) == sorted(large.select("a", "b").distinct().collect())
    assert distinct(small.limit(0).select("a")).count() == 0


def test_partitions_are_joined_up_to_a_bound(spark):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    try:
        for value, want in (("64m", 8 << 20), ("64MB", 8 << 20), ("1m", 1 << 20)):
            spark.conf.set(name, value)
            bound_parts(spark)
            assert spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) == want
    finally:
        spark.conf.set(name, before)
