"""Mixing sources to target weights by Pfair scheduling of blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OTHER = ""


def pfair_period(shares: dict[str, int]) -> list[str]:
    """One period of the schedule: the stream that each of sum(shares) slots goes to.

    Block j of a stream with share p of q has release floor(j q / p) and deadline
    ceil((j + 1) q / p). Of the released blocks, the one with the earliest deadline takes the slot
    (ties by name). The weights sum to one, so no deadline is missed: after each slot every stream
    is within one block of its target.
    """
    q, done, out = sum(shares.values()), dict.fromkeys(shares, 0), []
    for t in range(q):
        ready = [(-((-(done[s] + 1) * q) // p), s) for s, p in shares.items() if done[s] < p and done[s] * q // p <= t]
        out.append(min(ready)[1])
        done[out[-1]] += 1
    return out


def phases(blocks: dict[str, int], shares: dict[str, int]) -> list[tuple]:
    """(stream, first block, last block, first slot, period, share, slots in the period).

    A phase ends with the slot in which a stream runs out; the others go on with the same shares
    among themselves. There are at most as many phases as streams.
    """
    left, at, out = {s: n for s, n in blocks.items() if n}, 0, []
    used = dict.fromkeys(left, 0)
    while left:
        now = {s: shares[s] for s in left}
        g = math.gcd(*now.values())
        now = {s: p // g for s, p in now.items()}
        q, order = sum(now.values()), pfair_period(now)
        slots = {s: [t for t, x in enumerate(order) if x == s] for s in now}
        slot = lambda s, j: j // now[s] * q + slots[s][j % now[s]]
        end = min(slot(s, n - 1) for s, n in left.items()) + 1
        for s in list(left):
            n = end // q * now[s] + sum(t < end % q for t in slots[s])
            if n:
                out.append((s, used[s], used[s] + n - 1, at, q, now[s], slots[s]))
            used[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        at += end
    return out


def row_tie(docs: DataFrame) -> Column:
    """A hash of all columns, which orders rows of the same id."""
    return F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])))


def mix_sources(
    docs: DataFrame, shares: dict[str, int], id_col: str = "doc_id", source_col: str = "source", block: int = 16, other_share: int = 1, tie_col: str | None = None
) -> DataFrame:
    """docs with __stream, __block, __slot, __pos: rows in the order of __pos are the mixture.

    __pos is __slot * block + the place in the block; a stream's last block may leave a gap there.

    shares: whole numbers, the target weights by source; their sum, the schedule's period, and their
    number bound what the driver holds. Sources without a share, null ones included, form one more
    stream with other_share. A stream's rows are dealt into blocks of `block` rows in an order
    that is as good as random: by hash, id and a hash of all columns, or tie_col, a column with row_tie of the rows
    that these were made from; it goes. The last block of a stream may be short.
    No row is dropped or repeated: once a stream has run out, the rest go on by their shares.

    Ranks within a stream come from about sqrt(rows) hash buckets: rows are numbered inside a bucket and
    buckets are summed up, so neither a hot source nor the sums meet in one large task. Rows equal in
    every column may swap places; nothing else is left open. Any column may be null. Empty in, empty
    out. Columns of docs keep their names; those with one of the four names above are replaced.
    """
    if block < 1 or other_share < 1 or not all(isinstance(p, int) and p > 0 for p in shares.values()):
        raise ValueError("shares, other_share and block are whole numbers from 1")
    spark = docs.sparkSession
    total = docs.count()
    k = max(1, math.isqrt(total))
    own = [c for c in docs.columns if c not in ("__stream", "__block", "__slot", "__pos", tie_col)]
    names = {c: f"c{i}" for i, c in enumerate(own)}  # no name of a column of docs meets one of ours
    tie = F.col(f"`{tie_col}`") if tie_col else row_tie(docs.select(*[F.col(f"`{c}`") for c in own]))
    kept = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], tie.alias("tie"))
    key, src = F.col(names[id_col]).cast("string"), F.col(names[source_col]).cast("string")
    named = F.when(src.isin(*shares), src).otherwise(F.lit(OTHER)) if shares else F.lit(OTHER)
    rows = kept.withColumns({"stream": named, "h": F.xxhash64(F.lit(4), key)}).withColumn("b", F.pmod("h", F.lit(k)))
    sizes = rows.groupBy("stream", "b").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("stream").orderBy("b")
    starts = sizes.withColumn("before", F.sum("n").over(before) - F.col("n")).drop("n")
    counts = {r[0]: r[1] for r in sizes.groupBy("stream").agg(F.sum("n")).collect()}
    plan = phases({s: -(-n // block) for s, n in counts.items()}, dict(shares) | {OTHER: other_share})
    plan = spark.createDataFrame(plan, "s string, lo long, hi long, at long, q long, p long, slots array<long>")
    inside = Window.partitionBy("stream", "b").orderBy("h", key, "tie")
    ranked = rows.withColumn("i", F.row_number().over(inside) - 1)
    # Buckets times streams; past a bound on that they're joined by shuffling.
    starts = F.broadcast(starts) if k * (len(shares) + 1) <= 100_000 else starts
    ranked = ranked.join(starts, ["stream", "b"]).withColumn("r", F.col("before") + F.col("i")).withColumn("block", F.expr(f"r div {block}"))
    out = ranked.join(F.broadcast(plan), (F.col("stream") == F.col("s")) & F.col("block").between(F.col("lo"), F.col("hi")))
    slot = F.expr("at + ((block - lo) div p) * q + element_at(slots, cast((block - lo) % p + 1 as int))")
    out = out.withColumn("slot", slot).withColumn("pos", F.col("slot") * block + F.expr(f"r % {block}"))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], F.col("stream").alias("__stream"), F.col("block").alias("__block"), F.col("slot").alias("__slot"), F.col("pos").alias("__pos"))


def mixed(docs: DataFrame, shares: dict[str, int], **more) -> DataFrame:
    """The columns of docs, in the order of the mixture: files and rows follow one another by place."""
    out = mix_sources(docs, shares, **more)
    return out.repartitionByRange("__pos").sortWithinPartitions("__pos").select(*[F.col(f"`{c}`") for c in docs.columns])
