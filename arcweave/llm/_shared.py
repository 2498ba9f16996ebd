"""Helpers shared by the operators: shared storage, lineage cuts, word splitting."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import new_path, shared_dir, shuffles_cleaned, stash, unstash

__all__ = ["UPPER", "ascii_lower", "bound_batches", "forget", "kept", "new_path", "release", "release_executors", "sample_ids", "shared_dir", "shuffles_cleaned", "stash", "table", "texts_of", "trim", "unstash", "words"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: What a worker keeps from task to task: of one operator at a time, so that stages don't add up.
_KEPT: dict = {}


def kept(name: str, make):
    """On a worker: what `make` made under the name when a task first asked, until another operator runs there."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def forget() -> None:
    """On a worker: drop what other operators kept, and give the memory back."""
    _KEPT.clear()
    trim()


def trim() -> None:
    """Give memory that is free back to the machine, where its C library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    pa.default_memory_pool().release_unused()


def release(spark: SparkSession) -> None:
    """On the driver: let go of the plans and results of queries that have ended, and of the memory that they took."""
    gc.collect()
    trim()
    spark._jvm.System.gc()


def release_executors(spark: SparkSession) -> None:
    """On executors: collect garbage, after which a heap shrinks to what lives. A task for each core, so every executor
    that is free gets one or more; one that gets none stays as it is. The driver has release()."""
    if not spark.sparkContext.master.startswith("local["):
        cores = spark.sparkContext.defaultParallelism
        spark.range(0, cores, 1, cores).selectExpr("java_method('java.lang.System', 'gc')").write.format("noop").mode("overwrite").save()


def bound_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Arrow batches of this session hold at most so many bytes: rows alone don't bound them where texts are long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, "64m").lower().rstrip("b").replace("m", "0" * 6)) > most:
        spark.conf.set(name, str(most))


def ascii_lower(col):
    return F.translate(col, UPPER, UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, as UTF-8.

    bytes.lower touches only A-Z and bytes.split only those six white-space bytes.
    """
    return text.encode().lower().split() if text else []


def sample_ids(rows: DataFrame, total: int, most: int, salt: int) -> list:
    """At most `most` distinct values of rows' one column, those with the smallest hashes.

    Only values below a hash that about twice as many meet are sorted, so no task or driver gets
    more rows than that, however many rows there are.
    """
    key = rows.columns[0]
    place = F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 40))
    limit = min(1 << 40, int((2 * most + 100) / max(1, total) * (1 << 40)))
    found = rows.filter(place < limit).distinct().orderBy(place, key).limit(most)
    return [r[0] for r in found.collect()]


def texts_of(docs: DataFrame, ids: list, id_col: str, text_col: str) -> list[tuple]:
    """(id, text) of the rows with the ids of a bounded sample, in the order of ids and texts; distinct."""
    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.sparkSession.createDataFrame([(i,) for i in sorted(set(ids))], f"__id {kind}")
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return sorted({(r[0], r[1] or "") for r in rows.join(F.broadcast(chosen), "__id").collect()})
