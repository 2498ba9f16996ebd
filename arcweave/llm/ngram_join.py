"""N-gram Jaccard join: adaptive multi-match prefixes find candidates, word shingles verify them."""

from __future__ import annotations

import math
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bound_batches, forget, release, shuffles_cleaned, stash, unstash, words
from .bitmap import bitmap, bits_for, filtered, place, within
from .components import components

#: Counters that the order of shingles comes from, the same number at every size: 16 MB that all workers are sent.
COUNTERS, PIECES = 1 << 22, 64
#: The longest extra prefix that is weighed.
LONGEST = 8
#: Rows of a token that meet at a time, about; longer lists are dealt out in blocks.
BLOCK = 256
#: How often rows of long lists, dealt anew, look for a neighbour, before all remaining pairs are made.
ROUNDS = 4
SKETCH = 512


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct n-word shingles; a shorter text is one shingle, an empty one none."""
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def prefix(s: np.ndarray, counts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int]:
    """(prefix, matches it must share) of a set, in the order of rarest shingles first.

    A set x that overlaps a partner in t = ceil(num |x| / den) shingles or more shares at least l of its
    first |x| - t + l with the first ones of the partner. A longer prefix costs longer lists, here
    the sum of its shingles' counts, but fewer partners share l of them, at most sum / l, each
    of which costs a verification; l is where the two are least.
    """
    c = counts[(s & np.uint64(len(counts) - 1)).astype(np.int64)]
    order = np.argsort(c, kind="stable")  # of equal counts, by hash, as s is sorted
    t = -(-num * len(s) // den)
    most = min(LONGEST, t)
    lists = np.cumsum(c[order].astype(float))
    ells = np.arange(1, most + 1)
    reach = lists[len(s) - t + ells - 1]
    ell = int(ells[np.argmin(reach + reach / ells * max(1.0, len(s) / 16))])
    return s[order[: len(s) - t + ell]], ell


def sketch(s: np.ndarray) -> bytes:
    """Parities of the number of hashes in 512 bins: two sketches differ in no more bits than the sets in shingles."""
    bins = ((s >> np.uint64(20)) & np.uint64(SKETCH - 1)).astype(np.int64)
    return np.packbits((np.bincount(bins, minlength=SKETCH) & 1).astype(np.uint8)).tobytes()


def shingle_counts(texts: DataFrame, n: int) -> np.ndarray:
    """Documents per shingle, in counters that shingles share: of all documents, whole texts."""
    size, part = COUNTERS, COUNTERS // PIECES

    def packed(x):
        """Small numbers as bytes, the few larger ones beside them."""
        big = np.flatnonzero(x > 254).astype(np.uint32)
        return zlib.compress(np.uint32(len(big)).tobytes() + big.tobytes() + x[big].astype(np.uint32).tobytes() + np.minimum(x, 255).astype(np.uint8).tobytes(), 1)

    def unpacked(blob):
        raw = zlib.decompress(blob)
        m = int(np.frombuffer(raw, np.uint32, 1)[0])
        x = np.frombuffer(raw, np.uint8, part, 4 + 8 * m).astype(np.uint64)
        x[np.frombuffer(raw, np.uint32, m, 4)] = np.frombuffer(raw, np.uint32, m, 4 + 4 * m)
        return x

    def count(batches):
        forget()
        total = np.zeros(size, np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                got = [shingles(t, n) for t in batch.column(0).slice(at, 1024).to_pylist()]
                if got:
                    np.add.at(total, (np.concatenate(got) & np.uint64(size - 1)).astype(np.int64), 1)
        blobs = [packed(x) for x in np.split(total, PIECES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array(blobs, pa.binary())], ["piece", "blob"])

    def add(batches):
        total = {}
        for batch in batches:
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[k] = total.get(k, 0) + unpacked(b.as_py())
        for k, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed(np.minimum(x, (1 << 32) - 1))], pa.binary())], ["piece", "blob"])

    # In two steps, so that no task reads a blob of each other one: first about the root of their number.
    groups = max(1, math.isqrt(texts.rdd.getNumPartitions()))
    parts = texts.mapInArrow(count, "piece int, blob binary").withColumn("g", F.pmod(F.spark_partition_id(), F.lit(groups)))
    parts = parts.repartition(PIECES * groups, "piece", "g").select("piece", "blob").mapInArrow(add, "piece int, blob binary")
    parts = parts.repartition(PIECES, "piece").mapInArrow(add, "piece int, blob binary")
    out = np.zeros(size, np.uint32)
    with shuffles_cleaned(texts.sparkSession):
        found = parts.collect()  # PIECES rows of a bounded size
    for k, blob in found:
        out[k * part : (k + 1) * part] = unpacked(blob)
    usual = np.uint32(np.median(out))
    for at in range(0, size, part):  # in place: the driver holds one copy
        out[at : at + part] -= np.minimum(out[at : at + part], usual)
    return out


def _close(ham: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of a and b shingles that differ in ham may have num / den in common, of their union."""
    return (den + num) * ham <= (den - num) * (a + b)


#: Pairs that are looked at in one go.
STEP = 1 << 19
NAMES = ("token", "id", "comp", "n", "ell", "part", "side")


def _ranges(cols: dict, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the rows that each row is held against: of its group, those of other components after its own, or
    where a group has two sides those of the other side. Rows are in the order of groups, sides and components."""
    size = np.diff(np.append(first, len(cols["id"])))
    end = np.repeat(first + size, size)
    group = np.repeat(np.arange(len(first)), size)
    new = np.concatenate(([True], (group[1:] != group[:-1]) | (cols["side"][1:] != cols["side"][:-1])))
    runs = np.flatnonzero(new)  # of equal sides; a group of two sides has two
    run = np.cumsum(new) - 1
    two = np.bincount(group[runs], minlength=len(first)) == 2
    other = np.append(runs, len(group))[run + 1]
    new |= np.concatenate(([True], cols["comp"][1:] != cols["comp"][:-1]))
    own = np.append(np.flatnonzero(new), len(group))[np.cumsum(new)]
    # Of two sides, the second is held against nothing more; of one, sides 0 and 1 are those of a group that has no other.
    start = np.where(two[group], other, np.where(cols["side"] < 0, own, end))
    return np.minimum(start, end), end


def _pairs(cols: dict, first: np.ndarray, num: int, den: int):
    """(i, j, bits in which their sketches differ) of the rows held against one another whose sizes and sketches allow a link."""
    start, end = _ranges(cols, first)
    count = end - start
    done = np.concatenate(([0], np.cumsum(count)))
    at = 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(done, done[at] + STEP, side="right")) - 1)
        i = np.repeat(np.arange(at, to), count[at:to])
        j = np.arange(done[to] - done[at]) - np.repeat(done[at:to] - done[at], count[at:to]) + np.repeat(start[at:to], count[at:to])
        a, b = cols["n"][i], cols["n"][j]
        ok = (cols["comp"][i] != cols["comp"][j]) & (den * np.minimum(a, b) >= num * np.maximum(a, b))
        i, j = i[ok], j[ok]
        ham = np.bitwise_count(cols["sketch"][i] ^ cols["sketch"][j]).sum(axis=1, dtype=np.int64)
        ok = _close(ham, cols["n"][i], cols["n"][j], num, den)
        yield i[ok], j[ok], ham[ok]
        at = to


def _met(rows: DataFrame, out, schema: str) -> DataFrame:
    """Apply out(columns, starts of the groups) to rows (token, part, side, ...) whose groups (token, part) meet in a task."""
    rows = rows.repartition("token", "part").sortWithinPartitions("token", "part", "side", "comp")

    def run(batches):
        held = None
        for batch in batches:
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in NAMES}
            cols["sketch"] = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH // 64)
            if held is not None:
                cols = {c: np.concatenate([held[c], cols[c]]) for c in cols}
            if not len(cols["id"]):
                continue
            # The last group may go on in the next batch; a group has two blocks at most.
            first = np.flatnonzero(np.concatenate(([True], (cols["token"][1:] != cols["token"][:-1]) | (cols["part"][1:] != cols["part"][:-1]))))
            cut = int(first[-1])
            held = {c: v[cut:] for c, v in cols.items()}
            if cut:
                yield from out({c: v[:cut] for c, v in cols.items()}, first[:-1])
        if held is not None:
            yield from out(held, np.zeros(1, np.int64))

    return rows.select(*NAMES, "sketch").mapInArrow(run, schema)


def neighbours(lists: DataFrame, marks: DataFrame, num: int, den: int, salt: int) -> DataFrame:
    """Pairs (a, b), a < b, of different components: of each row at most two, with the closest sketch and with the smallest id that it meets.

    A row meets those of its block of a token's list, about BLOCK, and the smallest of the whole list: the work is in
    proportion to the rows, however long a list is. lists: token, id, list (rows of the token); marks: id, comp, n, ell, sketch.
    """
    blocks = F.expr(f"cast((list + {BLOCK - 1}) div {BLOCK} as int)")
    plain = ("token", "id", "comp", "n", "ell", "sketch")
    rows = lists.withColumn("part", F.pmod(F.xxhash64("id", "token", F.lit(salt)), blocks).cast("int")).join(marks, "id").select(*plain, "part")
    leads = lists.filter(f"list > {BLOCK}").groupBy("token").agg(F.min("id").alias("id"), F.max(blocks).alias("k"))
    leads = leads.join(marks, "id").select(*plain, F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"))
    rows = rows.unionByName(leads).withColumn("side", F.lit(-1))

    def out(cols, first):
        for i, j, ham in _pairs(cols, first, num, den):
            me, you, ham = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([ham, ham])
            me, you = cols["id"][me], cols["id"][you]
            near, least = np.lexsort((you, ham, me)), np.lexsort((you, me))
            pick = np.unique(np.concatenate([o[np.concatenate(([True], me[o][1:] != me[o][:-1]))] for o in (near, least)])) if len(me) else near
            yield pa.RecordBatch.from_arrays([pa.array(x[pick]) for x in (me, you, ham)], ["me", "you", "ham"])

    met = _met(rows, out, "me long, you long, ham long")
    best = met.groupBy("me").agg(F.min(F.struct("ham", "you"))["you"].alias("near"), F.min("you").alias("least"))
    pairs = best.select("me", F.explode(F.array_distinct(F.array("near", "least"))).alias("you"))
    return pairs.select(F.least("me", "you").alias("a"), F.greatest("me", "you").alias("b")).distinct()


def across(lists: DataFrame, marks: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs (a, b, need), once a shared token, of rows that share tokens, are of different components and may be linked.

    Lists of one component make none and fall out. Of the others, the rows of the largest component are held
    against the rest alone, and those against one another, in blocks: a group of copies costs its rows, not its pairs.
    """
    sizes = lists.join(marks.select("id", "comp"), "id").groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
    tops = sizes.groupBy("token").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("rows")).filter("rows > top.c")
    tops = tops.select("token", "rows", F.col("top.comp").alias("big"), F.expr(f"cast((top.c + {BLOCK - 1}) div {BLOCK} as int)").alias("bigs"), F.expr(f"cast((rows - top.c + {BLOCK - 1}) div {BLOCK} as int)").alias("rests"))
    tops = stash(tops, "tops")
    bits = bits_for(tops.count())
    sent = lists.sparkSession.sparkContext.broadcast(bitmap(tops, bits, "token"))
    some = filtered(lists.select("token", "id"), sent, bits, ["token"])
    # Lists of more than a thousandth of the rows, at most a thousand, come to the rows; the others are met by token.
    hot = F.broadcast(tops.filter(F.col("rows") > lists.count() // 1000))
    rows = some.join(hot, "token").unionByName(some.join(hot, "token", "left_anti").join(tops, "token")).join(marks, "id")
    own = lambda n: F.pmod(F.xxhash64("id", "token"), F.col(n)).cast("int")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    spot = lambda x, y, side: F.struct((x * (F.col("bigs") + F.col("rests")) + y).alias("part"), side.cast("int").alias("side"))
    # Places in a grid: rests against bigs, then rests against rests; a block against itself has one side, -1.
    mine = F.transform(each("rests"), lambda y: spot(own("bigs") + F.col("rests"), y, F.lit(0)))
    others = F.transform(each("bigs"), lambda x: spot(x + F.col("rests"), own("rests"), F.lit(1)))
    among = F.transform(each("rests"), lambda y: spot(F.least(own("rests"), y), F.greatest(own("rests"), y), F.when(own("rests") == y, -1).when(own("rests") < y, 0).otherwise(1)))
    places = F.when(F.col("comp") == F.col("big"), mine).otherwise(F.concat(others, among))
    rows = rows.select("token", "id", "comp", "n", "ell", "sketch", F.explode(places).alias("p")).select("token", "id", "comp", "n", "ell", "sketch", "p.part", "p.side")

    def out(cols, first):
        for i, j, _ in _pairs(cols, first, num, den):
            a, b = cols["id"][i], cols["id"][j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.minimum(cols["ell"][i], cols["ell"][j]).astype(np.int32))], ["a", "b", "need"])

    return _met(rows, out, "a long, b long, need int")


def verified(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose texts' sets have a Jaccard similarity of num / den or more, exactly.

    Texts travel compressed: they are a third of the size of their hashed sets.
    """
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("packed").alias("x")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("packed").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            keep, known = [], {}
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                for z in (x, y):
                    if z not in known:
                        if len(known) > 500:
                            known.clear()
                        known[z] = shingles(zlib.decompress(z).decode(), n)
                x, y = (known[z] if z in known else shingles(zlib.decompress(z).decode(), n) for z in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def ngram_join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row: documents link at a Jaccard similarity of num / den or more.

    A document's set is that of its distinct n-word shingles (words: A-Z lower-cased, split at ASCII white space);
    with fewer words, the whole sequence is one shingle. component_id is the smallest id that links
    reach. No link between different sets is lost:

    1. Counters of all documents' shingles give an order, rarest first, and each set its prefix.
       Rows with the same set are one from here on, under their smallest id.
    2. Tokens of prefixes that more than one set has make lists. Long lists are dealt out in blocks.
    3. Each row is verified against the closest and the smallest partner that it meets in its blocks, and the links make first
       components: groups of copies are one now, without their pairs having been made.
    4. All remaining pairs, of different components, that share as many tokens as the shorter extra
       prefix of the two asks for and whose sketches allow a link, are verified.

    Ids are whole numbers. Rows with null or empty texts have no shingles and are linked with nothing:
    component_id is their own id. A null id takes no part and has a null component_id. Rows that repeat
    an id and text get the same result; an id that comes with several
    texts gets each text's n_shingles and one component_id, as those texts are linked through it. Other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError("ids must be whole numbers")
    if not 0 < num <= den:
        raise ValueError("the similarity is a share num / den, above 0")
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    sent = spark.sparkContext.broadcast(shingle_counts(docs.select("t"), n))

    def prepare(batches):
        forget()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for t in part.column(1).to_pylist():
                    s = shingles(t, n)
                    if len(s):
                        p, ell = prefix(s, sent.value, num, den)
                        rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), p.view(np.int64), ell, sketch(s)))
                    else:
                        rows.append((0, None, None, 0, None))
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["id", "n", "sig", "prefix", "ell", "sketch"])

    known = stash(docs.mapInArrow(prepare, "id long, n long, sig binary, prefix array<long>, ell int, sketch binary"), "sets")
    sent.destroy()
    release(spark)
    firsts = known.filter("sig is not null and id is not null").groupBy("sig").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("c"))
    own = known.filter("sig is not null").join(firsts.select("sig", "id"), ["sig", "id"]).dropDuplicates(["sig", "id"])
    own = stash(own.select("id", "n", "ell", "sketch", "prefix"), "own")
    whole, known = known, stash(known.select("id", "n", "sig"), "rows")
    firsts = known.filter("sig is not null and id is not null").groupBy("sig").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("c"))
    unstash(whole)
    shared = stash(own.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("list")).filter("list > 1"), "shared")
    bits = bits_for(shared.count())
    common = spark.sparkContext.broadcast(bitmap(shared, bits, "token"))

    # Most tokens are of one set: the map keeps them from being dealt out again.
    tokens = filtered(own.select("id", F.explode("prefix").alias("token")), common, bits, ["token"])
    lists = stash(tokens.join(shared, "token").select("token", "id", "list"), "lists")
    marks = stash(own.select("id", "n", "ell", "sketch"), "marks")
    common.destroy()
    for df in (own, shared):
        unstash(df)

    first = stash(neighbours(lists, marks.withColumn("comp", F.col("id")), num, den, 0), "first")
    # Whoever has a partner at all is in one of these pairs, or in a list of several blocks.
    partners = first.select(F.explode(F.array("a", "b")).alias("id")).union(lists.filter(f"list > {BLOCK}").select("id")).distinct()
    spots = bits_for(partners.count())
    having = spark.sparkContext.broadcast(bitmap(partners, spots, "id"))

    def pack(batches):
        for batch in batches:
            part = batch.filter(pa.array(within(having.value, batch.column(2).to_numpy())))
            packed = [zlib.compress((t or "").encode(), 1) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], ["id", "packed"])

    texts = stash(docs.filter("id is not null").select("id", "t", place(spots, "id").alias("h")).mapInArrow(pack, "id long, packed binary"), "texts")
    links = [stash(verified(first, texts, n, num, den), "links")]
    comps = components(links[0])
    rest = filtered(lists, having, spots, ["id"])
    placed = lambda: marks.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    for salt in range(1, ROUNDS):
        more = stash(neighbours(rest.filter(f"list > {BLOCK}"), placed(), num, den, salt), "pairs")
        if more.isEmpty():
            unstash(more)
            break
        links.append(stash(verified(more, texts, n, num, den), "links"))
        unstash(more)
        if links[-1].isEmpty():
            break
        comps = components(reduce(DataFrame.unionByName, links))
    release(spark)
    more = across(rest, placed(), num, den).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("need").alias("need")).filter("shared >= need")
    links.append(stash(verified(more.select("a", "b"), texts, n, num, den), "links"))
    for df in (lists, marks, first, texts):
        unstash(df)
    having.destroy()
    final = components(reduce(DataFrame.unionByName, links)).select(F.col("id").alias("first"), F.col("comp"))
    groups = stash(firsts.withColumnRenamed("id", "first").join(final, "first", "left").select("sig", "c", F.coalesce("comp", "first").alias("comp")), "groups")
    for df in links:
        unstash(df)
    # Rows meet their group's component. Groups of more than a thousandth of the rows, at most a thousand, come to the rows;
    # so do rows without shingles, which are in none.
    rows, alone = known.select("id", "n", "sig"), F.col("sig").isNull()
    hot = F.broadcast(groups.filter(F.col("c") > known.count() // 1000).select("sig", "comp"))
    parts = [
        rows.filter(alone).withColumn("comp", F.lit(None).cast("long")),
        rows.filter(~alone).join(hot, "sig"),
        rows.filter(~alone).join(hot, "sig", "left_anti").join(groups.select("sig", "comp"), "sig", "left"),
    ]
    out = reduce(DataFrame.unionByName, parts)
    comp = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id"))
    return out.select(F.col("id").cast(kind).alias("doc_id"), F.col("n").alias("n_shingles"), comp.cast(kind).alias("component_id"))
