"""Line dedup: a suffix array over line ids by distributed prefix doubling; later copies of repeated runs go."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import bound_batches, forget, stash, unstash
from .bitmap import bitmap, bits_for, filtered


def _reach(text: str | None, min_words: int) -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
    """Of each line: its 128-bit id in two halves, and how many lines it takes, from it on and back from
    it, to have min_words words; 0 where the text ends before."""
    lines = (text or "").encode().split(b"\n")
    w = np.fromiter((len(x.split()) for x in lines), np.int64, len(lines))
    total = np.concatenate(([0], np.cumsum(w)))
    at = np.arange(len(lines))
    end = np.searchsorted(total, total[:-1] + min_words)  # lines up to end - 1
    start = np.searchsorted(total, total[1:] - min_words, side="right") - 1  # from line start on
    ids = [xxhash.xxh3_128_intdigest(x) for x in lines]
    half = (1 << 64) - 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(x >> 64) for x in ids], [signed(x & half) for x in ids], np.where(end <= len(lines), end - at, 0), np.where(total[1:] >= min_words, at + 1 - start, 0)


def line_table(docs: DataFrame, min_words: int) -> DataFrame:
    """(id, u, line, hi, lo, ahead, behind) of every line of columns id, u, text."""

    def run(batches):
        forget()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                hi, lo, ahead, behind, size = [], [], [], [], []
                for t in part.column(2).to_pylist():
                    a, b, c, d = _reach(t, min_words)
                    hi += a
                    lo += b
                    ahead.append(c)
                    behind.append(d)
                    size.append(len(a))
                row = pa.array(np.repeat(np.arange(part.num_rows), size))
                line = np.concatenate([np.arange(n) for n in size]).astype(np.int32)
                flat = [pa.array(np.concatenate(x).astype(np.int32)) for x in (ahead, behind)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), pa.array(line), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), *flat], ["id", "u", "line", "hi", "lo", "ahead", "behind"])
        forget()

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, u long, line int, hi long, lo long, ahead int, behind int")


def _ranked(classes: DataFrame, keys: list[str]) -> DataFrame:
    """Classes with a rank in the order of their keys: sorted by range, numbered by partition and place."""
    rows = classes.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stash(rows.withColumn("rank", F.monotonically_increasing_id()), "ranks")


def doubling(lines: DataFrame, most: int) -> list[DataFrame]:
    """By level k, (id, u, line, rank) of the suffixes whose first 2^k lines occur more than once.

    The rank orders suffixes by their first 2^k lines: it is the place among the sorted pairs of the ranks of
    the first and the second half of those. Suffixes that are alone up to there can't be part of a
    repeated run and fall out, so each round handles fewer; rounds end when a run of `most` lines is covered or none is left.
    """
    many = lines.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("hi", "lo")
    ranks = _ranked(many, ["hi", "lo"])
    level = stash(lines.join(ranks, ["hi", "lo"]).select("id", "u", "line", "rank").dropDuplicates(["id", "u", "line"]), "level")
    unstash_later, out, h = [ranks], [level], 1
    while 2 * h <= most:
        second = level.select(F.col("id").alias("i2"), F.col("u").alias("u2"), (F.col("line") - h).alias("l2"), F.col("rank").alias("r2"))
        pairs = level.join(second, (F.col("id").eqNullSafe(F.col("i2"))) & (F.col("u") == F.col("u2")) & (F.col("line") == F.col("l2"))).select("id", "u", "line", F.col("rank").alias("r1"), "r2")
        ranks = _ranked(pairs.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("r1", "r2"), ["r1", "r2"])
        unstash_later.append(ranks)
        level = stash(pairs.join(ranks, ["r1", "r2"]).select("id", "u", "line", "rank"), "level")
        if level.isEmpty():
            unstash(level)
            break
        out.append(level)
        h *= 2
    for df in unstash_later:
        unstash(df)
    return out


def repeated_blocks(lines: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(id, u, first, size) of the blocks that occur at an earlier place too.

    A block is the shortest run of lines with enough words that starts, or that ends, at a line. Every repeated run
    with enough words is the union of such blocks, which are all repeated, and no other run is. A
    block of m lines is an interval of equal prefixes in the suffix array: the suffixes with the same rank of their first
    2^k lines and, m - 2^k lines on, the same again, for the largest 2^k up to m.
    """
    blocks = lines.filter("ahead > 0").select("id", "u", F.col("line").alias("first"), F.col("ahead").alias("size")).unionByName(
        lines.filter("behind > 0").select("id", "u", (F.col("line") - F.col("behind") + 1).alias("first"), F.col("behind").alias("size"))
    )
    parts = []
    for k, level in enumerate(levels):
        h = 1 << k
        mine = blocks.filter(f"size >= {h} and size < {2 * h}")
        a = level.select(F.col("id").alias("ia"), F.col("u").alias("ua"), F.col("line").alias("la"), F.col("rank").alias("ra"))
        one = mine.join(a, F.col("id").eqNullSafe(F.col("ia")) & (F.col("u") == F.col("ua")) & (F.col("first") == F.col("la")))
        one = one.select("id", "u", "first", "size", "ra")
        if k:
            b = level.select(F.col("id").alias("ib"), F.col("u").alias("ub"), F.col("line").alias("lb"), F.col("rank").alias("rb"))
            one = one.join(b, F.col("id").eqNullSafe(F.col("ib")) & (F.col("u") == F.col("ub")) & (F.col("first") + F.col("size") - h == F.col("lb")))
        else:
            one = one.withColumn("rb", F.col("ra"))
        parts.append(one.select("id", "u", "first", "size", "ra", "rb"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = stash(found.distinct(), "blocks")
    keys = ["size", "ra", "rb"]
    earliest = found.groupBy(*keys).agg(F.min(F.struct("id", "u", "first")).alias("e"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    earliest = stash(earliest, "earliest")
    # Intervals of more than a thousandth of the blocks, at most a thousand, come to the blocks; the others are met by key.
    hot = F.broadcast(earliest.filter(F.col("c") > found.count() // 1000).select(*keys, "e"))
    late = found.join(hot, keys).unionByName(found.join(hot, keys, "left_anti").join(earliest.select(*keys, "e"), keys))
    return late.filter(F.struct("id", "u", "first") > F.col("e")).select("id", "u", "first", "size")


def repeated_runs(blocks: DataFrame) -> DataFrame:
    """(id, u, first, end) of the runs that blocks (id, u, first, size) cover, in the order of lines: no two of a text touch."""
    ends = blocks.groupBy("id", "u", "first").agg(F.max(F.expr("first + size")).alias("end"))
    before = Window.partitionBy("id", "u").orderBy("first")
    ends = ends.withColumn("new", F.coalesce(F.col("first") > F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int"))
    ends = ends.withColumn("run", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return ends.groupBy("id", "u", "run").agg(F.min("first").alias("first"), F.max("end").alias("end")).drop("run")


def line_dedup(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text of later copies cut out, and __n_lines, __n_removed.

    A run of whole lines (split at line feeds, compared byte by byte through 128-bit ids) of min_words words or more
    that also occurs earlier, in the order of ids and lines, goes; in the same text too, so of a line that repeats on and on
    one stays. The first copy of everything stays, and so do shorter repeats: texts without such runs are not changed.
    Removed lines leave no empty line behind. Null texts stay null (no lines). Null ids come before all
    others. Ids that repeat with other texts are ordered by a hash of the text; rows that repeat both are one
    document, and each loses the same lines. Columns keep their names, types and order; the two added names
    replace columns of docs so named. An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("__n_lines", "__n_removed")]
    names = {c: f"c{i}" for i, c in enumerate(own)}  # no name of a column of docs meets one of ours
    whole = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    key, kind = F.col(names[id_col]), docs.schema[text_col].dataType
    text = F.col(names[text_col]).cast("string")
    whole = whole.withColumns({"id": key, "u": F.xxhash64(F.lit(5), text)})
    rows = whole.select("id", "u", text.alias("text")).filter("text is not null")
    lines = stash(line_table(rows, min_words), "lines")
    most = lines.agg(F.greatest(F.max("ahead"), F.max("behind")).alias("m")).first().m or 0
    levels = doubling(lines, most)
    late = repeated_blocks(lines, levels)
    cuts = stash(repeated_runs(late).groupBy("id", "u").agg(F.sort_array(F.collect_list(F.struct("first", "end"))).alias("cuts")), "cuts")
    for df in (lines, *levels):
        unstash(df)
    # Most texts lose nothing: a map of those that do keeps the others from being dealt out.
    bits = bits_for(cuts.count())
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(cuts, bits, "id", "u"))
    right = cuts.select(F.col("id").alias("id2"), F.col("u").alias("u2"), "cuts")
    some = filtered(whole, sent, bits, ["id", "u"]).join(right, F.col("id").eqNullSafe(F.col("id2")) & (F.col("u") == F.col("u2")), "left")
    others = filtered(whole, sent, bits, ["id", "u"], keep=False).withColumn("cuts", F.lit(None).cast(cuts.schema["cuts"].dataType))
    out = some.select(*whole.columns, "cuts").unionByName(others)
    out = out.withColumn("parts", F.split(text, "\n", -1))  # a column, so that each use doesn't split anew
    parts = F.col("parts")
    # What lies before, between and after the runs, in one go over the lines.
    start = lambda j: F.when(j > 0, F.get("cuts", j - 1)["end"]).otherwise(0)
    stop = lambda j: F.coalesce(F.get("cuts", j)["first"], F.size(parts))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("cuts")), lambda j: F.slice(parts, start(j) + 1, stop(j) - start(j))))
    out = out.withColumns({"lines": F.when(text.isNull(), 0).otherwise(F.size(parts)), "kept": F.when(F.col("cuts").isNotNull(), kept)})
    removed = F.when(F.col("cuts").isNull(), 0).otherwise(F.col("lines") - F.size("kept"))
    fresh = F.when(F.col("cuts").isNull(), F.col(names[text_col])).otherwise(F.array_join("kept", "\n").cast(kind))
    return out.select(*[(fresh if c == text_col else F.col(n)).alias(c) for c, n in names.items()], F.col("lines").alias("__n_lines"), removed.alias("__n_removed"))
