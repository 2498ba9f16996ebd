"""Tables that loops write on the way, in the folder that the cluster shares."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="arcweave-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/arcweave-{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_cleaned(spark: SparkSession):
    """Shuffle files of the queries that end in here go with them, and don't wait for the driver's garbage collection."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends here, and so do its shuffle files."""
    path = new_path(df.sparkSession, name)
    with shuffles_cleaned(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def together(parts: list[DataFrame]) -> DataFrame:
    """Stashed tables of one schema as one scan, so the plan stays as short however many there are."""
    out = parts[0].sparkSession.read.schema(parts[0].schema)
    return out.parquet(*[p._stash_path for p in parts])


def unstash(df: DataFrame) -> None:
    """Remove the files of a stashed table that nothing reads any more."""
    path = getattr(df, "_stash_path", None)
    if path:
        delete(df.sparkSession, path)


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it takes it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)
