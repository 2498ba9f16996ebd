"""Language-model scoring: interpolated modified Kneser-Ney n-grams in memory-mapped, sorted hash arrays."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import bound_batches, forget, kept, new_path, stash, unstash, words

#: Stand-in for a text's end, a word like others; words are hashed. Ids are from 1 on, 0 stands for a text's beginning.
END, BEGIN = np.uint64(2), np.uint64(0)
#: Tokens that a task counts at a time, and that are looked up at a time, at least.
CHUNK, LOOKUP = 3_000_000, 400_000
#: Bytes of text whose n-grams, or whose words, make a shard.
GRAM_BYTES, WORD_BYTES = 12 << 20, 64 << 20
#: A context with this share of the tokens has its n-grams spread over all shards.
HOT = 1 / 500
#: Entries of a sorted array that share a place in its directory, about.
BUCKET = 16


# --- n-grams as columns of word ids


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def chain(cols: list[np.ndarray]) -> np.ndarray:
    """64-bit key of an n-gram or a context: its words' ids, mixed one after the other."""
    out = np.full(len(cols[0]), len(cols), np.uint64)
    for c in cols:
        out = (out + c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def shard_of(key: np.ndarray, n: int) -> np.ndarray:
    return ((key * np.uint64(0xA24BAED4963EE407) >> np.uint64(24)) % np.uint64(n)).astype(np.int64)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, an END after each text; tokens of each text)."""
    flat, sizes, end = [np.empty(0, np.uint64)], [], np.array([END], np.uint64)
    for t in texts:
        w = word_hashes(words(t))
        flat += [w, end]
        sizes.append(len(w) + 1)
    return np.concatenate(flat), np.array(sizes, np.int64)


def windows(ids: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """Columns w1..wn of every token's n-gram, BEGIN before a text's first."""
    first = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64) if len(sizes) else np.empty(0, np.int64)
    out = [ids]
    for back in range(1, order):
        col = np.empty_like(ids)
        col[back:], col[:back] = ids[:-back], BEGIN
        for k in range(back):
            at = first + k
            col[at[k < sizes]] = BEGIN
        out.insert(0, col)
    return out


def folded(cols: list[np.ndarray], counts: np.ndarray, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """N-grams sorted by ids of so many bits, and summed. Where ids take more than 64 bits in all, some n-grams
    may come several times: it is the folding after the shuffle that counts."""
    key, left = np.zeros(len(counts), np.uint64), 64
    for c in cols:
        take = min(bits, left)
        if take:
            key = (key << np.uint64(take % 64) if take < 64 else key) | (c >> np.uint64(bits - take))
            left -= take
    order = np.argsort(key)
    cols, counts = [c[order] for c in cols], counts[order]
    return _runs(cols, counts, _changes(cols))


def _changes(cols: list[np.ndarray]) -> np.ndarray:
    if not len(cols[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(cols[0]), bool)
    new[0] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _runs(cols: list[np.ndarray], counts: np.ndarray, first: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    return [c[first] for c in cols], np.add.reduceat(counts, first) if len(first) else counts


def _capped(x: np.ndarray) -> list[np.ndarray]:
    """Small numbers as bytes; places and values of rows with others beside them."""
    big = np.flatnonzero((x > 254).any(axis=tuple(range(1, x.ndim))))
    return [np.minimum(x, 255).astype(np.uint8), big.astype(np.uint32), x[big].astype(np.uint32)]


def _uncapped(small: np.ndarray, at: np.ndarray, value: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = small[rows].astype(np.int64)
    full = np.flatnonzero((out == 255).any(axis=tuple(range(1, out.ndim))))
    if len(full):
        out[full] = value[np.searchsorted(at, rows[full])]
    return out


def pack(cols: list[np.ndarray], counts: np.ndarray, bits: int) -> bytes:
    """Sorted n-grams: ids byte by byte, the first as steps; compressed."""
    wide = (bits + 7) // 8
    small, at, value = _capped(counts)
    parts = [np.array([len(counts), len(at), wide], np.int64).tobytes()]
    for k, c in enumerate(cols):
        c = np.diff(c, prepend=np.uint64(0)) if k == 0 else c
        parts.append(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes())
    return zstandard.ZstdCompressor(1).compress(b"".join([*parts, small.tobytes(), at.tobytes(), value.tobytes()]))


def unpack(blob: bytes, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m, wide = (int(x) for x in np.frombuffer(raw, np.int64, 3))
    cols, at = [], 24
    for k in range(width):
        c = np.zeros((n, 8), np.uint8)
        c[:, :wide] = np.frombuffer(raw, np.uint8, n * wide, at).reshape(wide, n).T
        c, at = c.view("<u8").ravel(), at + n * wide
        cols.append(np.cumsum(c, dtype=np.uint64) if k == 0 else c)
    counts = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
    counts[np.frombuffer(raw, np.uint32, m, at + n)] = np.frombuffer(raw, np.uint32, m, at + n + 4 * m)
    return cols, counts


# --- files


@dataclass(frozen=True)
class Files:
    """Files of a model: a folder that all machines mount, or one of another file system, from which a worker copies
    each file that it needs, once, to map it."""

    root: str
    system: pafs.FileSystem | None = None

    def write(self, name: str, arrays: list[np.ndarray]) -> None:
        """Arrays in one file, written beside and renamed: a task that runs again replaces what a lost one left."""
        head = json.dumps([[a.dtype.str, list(a.shape)] for a in arrays]).encode()
        parts = [np.int64(len(head)).tobytes(), head, bytes(-len(head) % 8)]
        for a in arrays:
            parts += [np.ascontiguousarray(a).tobytes(), bytes(-a.nbytes % 8)]
        tmp = f"{self.root}/.{name}.{os.getpid()}.{np.random.default_rng().integers(1 << 60)}"
        with open(tmp, "wb") if self.system is None else self.system.open_output_stream(tmp) as f:
            for p in parts:
                f.write(p)
        os.replace(tmp, f"{self.root}/{name}") if self.system is None else self.system.move(tmp, f"{self.root}/{name}")

    def read(self, name: str) -> list[np.ndarray]:
        """The arrays, memory-mapped. A file that isn't there raises: every shard has one, empty or not."""
        path = f"{self.root}/{name}"
        if self.system is not None:
            copy = tempfile.NamedTemporaryFile(prefix="lm-")  # goes with the worker
            with self.system.open_input_stream(path) as f:
                while part := f.read(1 << 22):
                    copy.write(part)
            copy.flush()
            path = copy.name
        raw = np.memmap(path, np.uint8, "r")
        size = int(raw[:8].view(np.int64)[0])
        at, out = 8 + size + -size % 8, []
        for kind, shape in json.loads(bytes(raw[8 : 8 + size])):
            n = int(np.prod(shape)) * np.dtype(kind).itemsize
            out.append(raw[at : at + n].view(kind).reshape(shape))
            at += n + -n % 8
        return out


def files_in(spark: SparkSession, folder: str | None, system: pafs.FileSystem | None = None) -> Files:
    folder = folder or new_path(spark, "lm")
    url = urlparse(folder)
    if system is None and url.scheme not in ("", "file"):
        try:
            system, path = pafs.FileSystem.from_uri(folder)
        except Exception as e:
            raise ValueError(f"{url.scheme}:// can't be reached from Python here; give a folder that all machines mount, or its file system") from e
    else:
        path = url.path
    os.makedirs(path, exist_ok=True) if system is None else system.create_dir(path)
    return Files(path, system)


def hashed(key: np.ndarray) -> list[np.ndarray]:
    """Sorted keys as a directory of their first bits and the 32 bits that follow."""
    bits = min(31, (len(key) // BUCKET).bit_length())
    top = key >> np.uint64(64 - bits) if bits else np.zeros(len(key), np.uint64)
    starts = np.searchsorted(top, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.uint32)
    return [starts, (key >> np.uint64(32 - bits)).astype(np.uint32)]


def locate(starts: np.ndarray, rest: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each key, whether it is there), all keys halving their ranges in step."""
    bits = (len(starts) - 1).bit_length() - 1
    top = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
    want = (key >> np.uint64(32 - bits)).astype(np.uint32)
    low, end = starts[top].astype(np.int64), starts[top + 1].astype(np.int64)
    if not len(rest):
        return low, np.zeros(len(key), bool)
    high = end.copy()
    for _ in range(int((high - low).max(initial=0)).bit_length()):
        mid = (low + high) >> 1
        less = (rest[np.minimum(mid, len(rest) - 1)] < want) & (low < high)
        low, high = np.where(less, mid + 1, low), np.where(less, high, mid)
    at = np.minimum(low, len(rest) - 1)
    return at, (low < end) & (rest[at] == want)


# --- the model


@dataclass
class Level:
    """What is known of n-grams of one order besides the files: contexts whose n-grams lie in all shards, and their sums."""

    discounts: tuple[float, float, float]
    hot: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    hot_stats: np.ndarray = field(default_factory=lambda: np.empty((0, 4), np.int64))


@dataclass
class Model:
    """files: words-<shard> holds sorted hashes, ranks and counts, 1-<shard> the continuation counts of the same words, and
    <n>-<shard> n-grams and contexts. levels: by order, from 1.

    base: total, n1, n2, n3 of the continuation counts; tokens and types: N and V of the training tokens;
    word_shards, shards: of words and of n-grams; ids: a word's id is below.
    """

    files: Files
    order: int
    levels: list[Level]
    base: tuple[int, int, int, int]
    tokens: int
    types: int
    word_shards: int
    shards: int
    ids: int


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from the counts of counts.

    Small corpora may lack some counts; a discount then falls back to the plain one, kept inside (0, count).
    """
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = [k - (k + 1) * y * (above / here) if here and above else y * k for k, here, above in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


class Vocabulary:
    """A worker's view of the words; files are mapped when first needed."""

    def __init__(self, files: Files, shards: int, unknown: int):
        self.files, self.shards, self.unknown, self.maps = files, shards, unknown, {}

    def file(self, name: str) -> list[np.ndarray]:
        if name not in self.maps:
            self.maps[name] = self.files.read(name)
        return self.maps[name]

    def find(self, hashes: np.ndarray, counts: bool = False) -> list[np.ndarray]:
        """[ids] of distinct words, `unknown` where there is none; with counts also their plain and continuation counts."""
        out = [np.full(len(hashes), self.unknown, np.uint64), *[np.zeros(len(hashes), np.int64) for _ in range(2 * counts)]]
        for s, i in _by_shard((hashes % np.uint64(self.shards)).astype(np.int64), self.shards):
            have, rank, *raw = self.file(f"words-{s}")
            if len(have):
                pos = np.minimum(np.searchsorted(have, hashes[i]), len(have) - 1)
                hit = have[pos] == hashes[i]
                i, pos = i[hit], pos[hit]
                out[0][i] = rank[pos].astype(np.uint64) * np.uint64(self.shards) + np.uint64(s + 1)
                if counts:
                    out[1][i] = _uncapped(*raw, pos)
                    out[2][i] = _uncapped(*self.file(f"1-{s}"), pos)
        return out


def _by_shard(at: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(at.astype(np.int16 if n < 1 << 15 else np.int32), kind="stable")
    ends = np.searchsorted(at[order], np.arange(n + 1))
    for s in np.flatnonzero(np.diff(ends)):
        yield int(s), order[ends[s] : ends[s + 1]]


def _grouped(rows: DataFrame, shards: int, columns: str, finish) -> DataFrame:
    """Blobs of a shard meet in one task, one shard after the other; finish(shard, blobs) gives rows (shard, blob, key, s)."""
    every = rows.sparkSession.range(shards).selectExpr("cast(id as int) shard", "cast(null as binary) blob")  # each shard has a file
    dealt = rows.select("shard", "blob").unionByName(every).repartitionById(shards, F.pmod("shard", F.lit(shards)).cast("int")).sortWithinPartitions("shard")

    def run(batches):
        forget()
        now, held = None, []
        for batch in batches:
            for s, b in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if s != now and now is not None:
                    yield from finish(now, held)
                    held = []
                now = s
                if b.is_valid:
                    held.append(b.as_py())
        if now is not None:
            yield from finish(now, held)

    return dealt.mapInArrow(run, columns)


ROWS = "shard int, blob binary, key array<long>, s array<long>"


def _batch(shard: list, blob: list, key: list, s: list) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((shard, blob, key, s), kinds, strict=True)], ["shard", "blob", "key", "s"])


def _chunks(batches, most: int) -> Iterator[list[str | None]]:
    """Texts of a task, in lists of about `most` tokens; a text is never cut."""
    held, size = [], 0
    for batch in batches:
        for t in batch.column(0).to_pylist():
            held.append(t)
            size += len(t or "") // 6
            if size > most:
                yield held
                held, size = [], 0
    if held:
        yield held


def _count_words(texts: DataFrame, files: Files, shards: int, order: int) -> DataFrame:
    """Writes the words; rows (-1, key (length of the vocabulary's part), s (words, tokens)) and, of contexts
    that may be hot, (-2, key (words' hashes), s (count))."""

    def count(batches):
        forget()
        for held in _chunks(batches, CHUNK):
            flat, sizes = tokens(held)
            have, where, c = np.unique(flat, return_inverse=True, return_counts=True)
            out = [(s, zstandard.ZstdCompressor(1).compress(have[i].tobytes() + c[i].astype(np.uint32).tobytes())) for s, i in _by_shard((have % np.uint64(shards)).astype(np.int64), shards)]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], ["shard", "blob"])
            # A context is no more frequent than its rarest word. All that have half of HOT here are passed on, so none that has HOT in all is missed.
            least = max(10, HOT / 2 * len(flat))
            number = np.where(c >= least, np.arange(1, len(c) + 1), 0).astype(np.int64)[where]
            cols = windows(np.where(number > 0, number, -1).astype(np.int64).view(np.uint64), sizes, order)
            for n in range(2, order + 1):
                part = cols[order - n : order - 1]
                often = np.all([p.view(np.int64) >= 0 for p in part], axis=0)
                part = np.stack([p[often] for p in part], axis=1).astype(np.int64)
                kinds, c2 = np.unique(part, axis=0, return_counts=True) if len(part) else (part, np.empty(0, np.int64))
                for k, m in zip(kinds[c2 >= least], c2[c2 >= least], strict=True):
                    key = np.where(k > 0, have.view(np.int64)[np.maximum(k, 1) - 1], 0)
                    blob = np.concatenate(([m], key)).astype(np.int64).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([-2 - int(m % 7)], pa.int32()), pa.array([blob], pa.binary())], ["shard", "blob"])

    def finish(shard, blobs):
        if shard < 0:
            got = [np.frombuffer(b, np.int64) for b in blobs]
            yield _batch([-2] * len(got), [None] * len(got), [x[1:].tolist() for x in got], [x[:1].tolist() for x in got])
            return
        parts = [zstandard.ZstdDecompressor().decompress(b) for b in blobs]
        flat = np.concatenate([np.frombuffer(p, np.uint64, len(p) // 12) for p in parts] or [np.empty(0, np.uint64)])
        c = np.concatenate([np.frombuffer(p, np.uint32, len(p) // 12, len(p) // 12 * 8) for p in parts] or [np.empty(0, np.uint32)]).astype(np.int64)
        order_ = np.argsort(flat, kind="stable")
        (have,), c = _runs([flat[order_]], c[order_], _changes([flat[order_]]))
        rank = np.empty(len(have), np.uint32)
        rank[np.argsort(-c, kind="stable")] = np.arange(len(have))  # frequent words have small ids
        files.write(f"words-{shard}", [have, rank, *_capped(c)])
        yield _batch([-1], [None], [[len(have)]], [[len(have), int(c.sum())]])

    return _grouped(texts.mapInArrow(count, "shard int, blob binary"), shards, ROWS, finish)


def train(docs: DataFrame, order: int = 3, text_col: str = "text", folder: str | None = None, system: pafs.FileSystem | None = None) -> Model:
    """Count the n-grams of all texts and write them as sorted hash arrays.

    Words are counted first; their ids, small ones for frequent words, make n-grams short to shuffle. Each task
    folds its tokens' n-grams before the shuffle. A shard holds all n-grams of a context, but those of hot contexts, at
    most 2 / HOT of an order, go to shards by n-gram, their few sums to the driver: no shard grows with a common
    word. From the distinct n-grams of an order come the continuation counts of the next lower one
    (n-grams that begin a text keep their own counts). The number of shards follows the bytes of
    text, GRAM_BYTES each. Of contexts with one token in all nothing is stored: that they occur at all is known
    from the next lower order. folder: a place that all machines mount, or of a file system that Python reaches, or of `system`.
    """
    if order < 2:
        raise ValueError("order is 2 or more")
    spark = docs.sparkSession
    bound_batches(spark)
    files = files_in(spark, folder, system)
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("t"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first().n
    shards, word_shards = max(8, size // GRAM_BYTES), max(8, size // WORD_BYTES)
    made = stash(_count_words(texts, files, word_shards, order), "lm-words")
    most, types, total = made.filter("shard = -1").agg(F.max(F.col("s")[0]), F.sum(F.col("s")[0]), F.sum(F.col("s")[1])).first()
    often = made.filter("shard = -2").groupBy("key").agg(F.sum(F.col("s")[0]).alias("c")).filter(F.col("c") >= max(20, HOT / 2 * total)).collect()
    unstash(made)
    ids = most * word_shards + 2
    bits, unknown = (ids - 1).bit_length(), ids - 1
    hot = _hot_keys(spark, files, word_shards, unknown, [r.key for r in often], order)
    rows = _count_grams(texts, files, word_shards, unknown, bits, hot[order], shards, order)
    levels: list[Level] = []
    for n in range(order, 0, -1):
        last = rows
        finish = _finish_words(files, word_shards) if n == 1 else _finish_grams(files, n, bits, hot[n], hot.get(n - 1, hot[n][:0]), word_shards if n == 2 else shards)
        made = stash(_grouped(rows, word_shards if n == 1 else shards, ROWS, finish), f"lm-{n}")
        if n < order:
            unstash(last)
        sums = [F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(6)]
        found = made.filter("shard < 0").groupBy("shard", "key").agg(*sums).collect()  # one row, and one of each hot context
        stats = next(r for r in found if r.shard == -1)
        level = Level(discounts(*(stats[f"s{i}"] for i in range(4))), hot.get(n, np.empty(0, np.uint64)))
        at = {r.key[0]: tuple(r[f"s{i}"] for i in range(4)) for r in found if r.shard == -2}
        level.hot_stats = np.array([at.get(k, (0, 0, 0, 0)) for k in level.hot.view(np.int64).tolist()], np.int64).reshape(-1, 4)
        levels.insert(0, level)
        rows = made.filter("shard >= 0")
        rows._stash_path = made._stash_path
    unstash(made)
    base = (stats.s4, stats.s0, stats.s1, stats.s5)
    return Model(files, order, levels, base, total, types, word_shards, shards, ids)


def _hot_keys(spark: SparkSession, files: Files, word_shards: int, unknown: int, contexts: list[list[int]], order: int) -> dict[int, np.ndarray]:
    """Sorted keys of contexts that are given by their words' hashes, by order; looked up where the files are."""
    out = {n: np.empty(0, np.uint64) for n in range(2, order + 1)}
    if not contexts:
        return out

    def look(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            flat = np.array([x for k in keys for x in k], np.int64).view(np.uint64)
            ids = np.where(flat == 0, BEGIN, Vocabulary(files, word_shards, unknown).find(flat)[0])
            at, got = 0, []
            for k in keys:
                got.append(int(chain([ids[at + i : at + i + 1] for i in range(len(k))]).view(np.int64)[0]))
                at += len(k)
            yield pa.RecordBatch.from_arrays([pa.array([len(k) + 1 for k in keys], pa.int32()), pa.array(got, pa.int64())], ["n", "key"])

    found = spark.createDataFrame([(k,) for k in contexts], "key array<long>").coalesce(1).mapInArrow(look, "n int, key long").collect()
    for n in out:
        out[n] = np.unique(np.array([r.key for r in found if r.n == n], np.int64).view(np.uint64))
    return out


def _dealt(cols: list[np.ndarray], counts: np.ndarray, bits: int, hot: np.ndarray, shards: int) -> pa.RecordBatch:
    """Sorted n-grams by shard: by context, so that its sums are made in one place; by n-gram where the context is hot.
    Single words go to the shard that has them."""
    if len(cols) == 1:
        at = ((cols[0] - np.uint64(1)) % np.uint64(shards)).astype(np.int64)
    else:
        at = place(chain(cols[:-1]), chain(cols), hot, shards)
    out = [(s, pack([c[i] for c in cols], counts[i], bits)) for s, i in _by_shard(at, shards)]
    return _batch([s for s, _ in out], [b for _, b in out], [None] * len(out), [None] * len(out))


def place(ctx: np.ndarray, key: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    return shard_of(np.where(np.isin(ctx, hot), key, ctx) if len(hot) else ctx, shards)


def _count_grams(texts: DataFrame, files: Files, word_shards: int, unknown: int, bits: int, hot: np.ndarray, shards: int, order: int) -> DataFrame:
    def count(batches):
        forget()
        known = Vocabulary(files, word_shards, unknown)
        for held in _chunks(batches, CHUNK):
            flat, sizes = tokens(held)
            have, where = np.unique(flat, return_inverse=True)
            ids = known.find(have)[0][where]
            del flat, have, where
            cols, counts = folded(windows(ids, sizes, order), np.ones(len(ids), np.int64), bits)
            yield _dealt(cols, counts, bits, hot, shards)

    return texts.mapInArrow(count, ROWS)


def _finish_grams(files: Files, n: int, bits: int, hot: np.ndarray, hot_below: np.ndarray, shards_below: int):
    """Writes a shard of order n: n-grams with counts, contexts of two tokens or more with their sums. Rows: its
    counts of counts, sums of hot contexts, and n-grams of order n - 1."""

    def finish(shard, blobs):
        parts = [unpack(b, n) for b in blobs]
        cols = [np.concatenate([np.empty(0, np.uint64), *[p[0][k] for p in parts]]) for k in range(n)]
        c = np.concatenate([np.empty(0, np.int64), *[p[1] for p in parts]])
        del parts
        key = chain(cols)
        order = np.argsort(key)
        key = key[order]
        first = _changes([key])
        c = np.add.reduceat(c[order], first) if len(first) else c
        key, cols = key[first], [x[order[first]] for x in cols]
        ctx = chain(cols[:-1])
        by = np.argsort(ctx)
        first = _changes([ctx[by]])
        keys, cs = ctx[by][first], c[by]
        stats = np.stack([np.add.reduceat(x.astype(np.int64), first) for x in (cs, cs == 1, cs == 2, cs > 2)], axis=1) if len(first) else np.empty((0, 4), np.int64)
        is_hot = np.isin(keys, hot)
        many = ~is_hot & (stats[:, 0] > 1)
        files.write(f"{n}-{shard}", [*hashed(key), *_capped(c), *hashed(keys[many]), *_capped(stats[many])])
        sums = [int(np.sum(c == k)) for k in (1, 2, 3, 4)] + [int(c.sum()), int(np.sum(c > 2))]
        hots = np.flatnonzero(is_hot)
        yield _batch([-1] + [-2] * len(hots), [None] * (1 + len(hots)), [[0]] + [[int(k)] for k in keys[hots].view(np.int64)], [sums] + [[int(x) for x in stats[h]] for h in hots])
        own = np.where(cols[1] == BEGIN, c, 1) if n > 2 else np.ones(len(c), np.int64)
        low, own = folded(cols[1:], own, bits)
        yield _dealt(low, own, bits, hot_below, shards_below)

    return finish


def _finish_words(files: Files, shards: int):
    """Writes the continuation counts of a shard of words, in the order of its hashes."""

    def finish(shard, blobs):
        have, rank, *_ = files.read(f"words-{shard}")
        by_rank = np.zeros(len(have), np.int64)
        for b in blobs:
            (ids,), own = unpack(b, 1)
            np.add.at(by_rank, ((ids - np.uint64(1)) // np.uint64(shards)).astype(np.int64), own)
        c = by_rank[rank]
        files.write(f"1-{shard}", _capped(c))
        yield _batch([-1], [None], [[0]], [[int(np.sum(c == k)) for k in (1, 2, 3, 4)] + [int(c.sum()), int(np.sum(c > 2))]])

    return finish


class Reader:
    """A worker's view of a model."""

    def __init__(self, model: Model):
        self.model = model
        self.words = Vocabulary(model.files, model.word_shards, model.ids - 1)

    def counts(self, n: int, at: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Counts of n-grams, each in its shard; 0 where there is none."""
        out = np.zeros(len(key), np.int64)
        for s, i in _by_shard(at, self.model.shards):
            f = self.words.file(f"{n}-{s}")
            pos, hit = locate(f[0], f[1], key[i])
            out[i[hit]] = _uncapped(f[2], f[3], f[4], pos[hit])
        return out

    def sums(self, n: int, ctx: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """(sum, ones, twos, more) of contexts; those that are seen, but not stored, have one token."""
        level, out = self.model.levels[n - 1], np.zeros((len(ctx), 4), np.int64)
        out[seen] = (1, 1, 0, 0)
        for s, i in _by_shard(shard_of(ctx, self.model.shards), self.model.shards):
            f = self.words.file(f"{n}-{s}")
            pos, hit = locate(f[5], f[6], ctx[i])
            out[i[hit]] = _uncapped(f[7], f[8], f[9], pos[hit])
        if len(level.hot):
            k = np.minimum(np.searchsorted(level.hot, ctx), len(level.hot) - 1)
            out = np.where((level.hot[k] == ctx)[:, None], level.hot_stats[k], out)
        return out

    def log10(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, plain count) of every token of texts, given as words' hashes."""
        m = self.model
        have, where = np.unique(flat, return_inverse=True)
        ids, raw, c = (x[where] for x in self.words.find(have, counts=True))
        begins = np.zeros(len(flat), bool)
        begins[np.cumsum(sizes) - sizes] = True
        out, step = np.empty(len(flat)), max(LOOKUP, min(5 * LOOKUP, 256 * m.shards))
        cols = windows(ids, sizes, m.order)
        for a in range(0, len(flat), step):  # a text may be longer than memory likes
            b = max(0, a - 1)  # one token more, from which the next one's context is known
            got = self._part([x[b : a + step] for x in cols], raw[b : a + step], c[b : a + step], begins[b : a + step])
            out[a : a + step] = got[a - b :]
        return out, raw

    def _part(self, cols: list[np.ndarray], raw: np.ndarray, c: np.ndarray, begins: np.ndarray) -> np.ndarray:
        m, below = self.model, raw
        total, *ones = m.base
        d = m.levels[0].discounts
        spare = sum(x * y for x, y in zip(d, ones, strict=True)) / max(1, total) if total else 1.0
        p = np.maximum(0, c - _cut(c, d)) / max(1, total) + spare / (m.types + 1)
        for n in range(2, m.order + 1):
            level, part = m.levels[n - 1], cols[m.order - n :]
            ctx, key = chain(part[:-1]), chain(part)
            seen = np.where(begins, m.tokens > 0, np.concatenate(([0], below[:-1])) > 0)
            c = self.counts(n, place(ctx, key, level.hot, m.shards), key)
            stats = self.sums(n, ctx, seen)
            sums = np.maximum(1, stats[:, 0])
            spare = stats[:, 1:] @ np.array(level.discounts) / sums
            p = np.where(stats[:, 0] > 0, np.maximum(0, c - _cut(c, level.discounts)) / sums + spare * p, p)
            below = c
        return np.log10(p)


def _cut(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3)]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row's whole text; null text is empty.

    score is the sum of log10 of the tokens' probabilities, the end included; base_score that of the
    unigram model with 0.1 added to each count. Null and repeated ids stay; an untrained model (no texts) gives every token the chance 1.
    Long texts are looked up part by part. Other columns, whatever their names, are ignored; an empty table gives none.
    A file of the model that a worker can't read raises.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        reader = kept(f"lm {m.files.root}", lambda: Reader(m))

        def flush(ids, texts):
            flat, sizes = tokens(texts)
            logs, raw = reader.log10(flat, sizes)
            base = np.log10((raw + 0.1) / (m.tokens + 0.1 * (m.types + 1)))
            first = np.cumsum(sizes) - sizes
            got = [np.add.reduceat(x, first) for x in ((raw > 0).astype(np.int64), base, logs)]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(sizes), *map(pa.array, got)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

        ids, texts, size, most = [], [], 0, max(LOOKUP, min(5 * LOOKUP, 256 * m.shards))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids.append(part.column(0))
                texts += part.column(1).to_pylist()
                size += sum(len(t or "") for t in texts[-part.num_rows :]) // 6
                if size > most:
                    yield flush(ids, texts)
                    ids, texts, size = [], [], 0
        if texts:
            yield flush(ids, texts)

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double")


def score_corpus(docs: DataFrame, train_on: Column, order: int = 3, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> tuple[DataFrame, Model]:
    """Train on the rows that meet a condition and score all rows."""
    model = train(docs.filter(train_on), order, text_col, folder)
    return score(docs, model, id_col, text_col), model
