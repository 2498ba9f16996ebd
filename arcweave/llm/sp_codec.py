"""SentencePiece encoding and decoding by a streaming Viterbi search."""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bound_batches, kept, trim

SPACE = "▁"
WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
LETTER = re.compile(r"[^\W\d_]")
#: Words and parts kept in a worker's memo, and pairs of pieces. When it is full it becomes the old memo, from which words that come
#: again are taken over, and the old one before goes.
MEMO = 200_000


class Codec:
    """Pieces of a SentencePiece model; encodes and decodes as the library does.

    A lattice position is the end of a piece. For unigram models, the survivor at a position is the
    predecessor with the best sum of scores. For BPE models, it is the one predecessor whose last
    piece BPE would leave next to the new piece: every prefix of a text has exactly one such path, and
    merges of higher rank never reach back across it. Characters without a piece are cuts that every
    path crosses; they fall back to bytes.
    """

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str], bpe: bool, dummy_prefix: bool = True):
        self.bpe, self.dummy_prefix, self.pieces = bpe, dummy_prefix, pieces
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "normal"}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "byte"}
        self.unk = kinds.index("unknown") if "unknown" in kinds else 0
        self.kinds, self.scores = kinds, scores
        self.longest = max(map(len, self.ids), default=1)
        self.inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)  # pieces that cross a word's end
        self.low = min((scores[i] for i in self.ids.values()), default=0.0) - 10.0
        order = sorted(self.ids, key=lambda p: (-scores[self.ids[p]], self.ids[p]))
        self.rank = {p: r for r, p in enumerate(order)}
        self.held = {c for p in self.ids for c in p}  # characters of pieces
        self.automaton = ahocorasick.Automaton()
        for p in self.held | set(self.ids):
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.words = self._cuts()
        self.splits: dict[str, tuple[str, str] | None] = {}
        several = Counter(scores[i] for i in self.ids.values())
        self.tied = {p for p, i in self.ids.items() if several[scores[i]] > 1}
        self.fits: dict[str, dict[str, bool]] = {}
        self.n_fits = 0
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.out = [self._surface(i) for i in range(len(pieces))]

    @classmethod
    def load(cls, path: str) -> Codec:
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        if m.normalizer_spec.name != "identity" or m.normalizer_spec.remove_extra_whitespaces or m.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models with the identity normaliser and all white space kept")
        names = {1: "normal", 2: "unknown", 3: "control", 4: "user", 5: "unused", 6: "byte"}
        kinds = [names[p.type] for p in m.pieces]
        if "user" in kinds:
            raise ValueError("models with user-defined pieces are not supported")
        return cls([p.piece for p in m.pieces], [p.score for p in m.pieces], kinds, m.trainer_spec.model_type == 2, m.normalizer_spec.add_dummy_prefix)

    def _cuts(self) -> re.Pattern:
        """Parts of a text that no piece crosses out of: a word, up to white space or a sign that follows
        a letter in no piece; line ends and tabs on their own, if they are in no piece."""
        after = "".join(sorted({b for p in self.ids for a, b in zip(p, p[1:], strict=False) if LETTER.match(a) and not LETTER.match(b)} - {SPACE}))
        alone = "".join(c for c in "\n\t" if c not in self.held)
        sign, run = f"(?![{SPACE}{alone}])[\\W\\d_]", f"{LETTER.pattern}++"
        inner = f"|{run}(?=[{re.escape(after)}])" if after else ""
        return re.compile((f"[{alone}]|" if alone else "") + f"{SPACE}*+(?:{sign}{inner})*+(?:{run})?+")

    # --- BPE: which pieces stay side by side

    def merges(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Symbols that BPE leaves of a text, and the last merge; a heap, n log n."""
        sym: list[str | None] = list(text)
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, str, str]] = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n and (r := self.rank.get(sym[i] + sym[j])) is not None:
                heapq.heappush(heap, (r, i, sym[i], sym[j]))

        # Equal scores rank alike; then the leftmost pair is first.
        for i in range(n - 1):
            offer(i)
        last = None
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            last, sym[i], sym[j] = (a, b), a + b, None
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            offer(i)
            if prv[i] >= 0:
                offer(prv[i])
        return [s for s in sym if s is not None], last

    def split(self, piece: str) -> tuple[str, str] | None:
        """The merge that makes a piece; None for single characters and pieces that BPE can't make."""
        if piece not in self.splits:
            left, last = self.merges(piece)
            self.splits[piece] = last if len(left) == 1 else None
        return self.splits[piece]

    def stay(self, a: str, b: str) -> bool:
        """Whether BPE of a + b is [a, b], by undoing the merges that touch the border, latest first."""
        rank, limit, x, y, ok = self.rank, len(self.rank), a, b, True
        equal = a in self.tied and b in self.tied  # among equal scores places decide, so merges are done and not undone
        if equal:
            ok = self.merges(a + b)[0] == [a, b]
        while not equal:
            if rank.get(x + y, limit) < limit:
                ok = False
                break
            sx, sy = (self.split(x) if len(x) > 1 else None), (self.split(y) if len(y) > 1 else None)
            if sx is None and sy is None:
                break
            # On equal ranks the left merge comes first, so the right one is undone first.
            if sy is None or (sx is not None and rank[x] > rank[y]):
                limit, x = rank[x], sx[1]
            else:
                limit, y = rank[y] + 1, sy[0]
        return ok

    # --- the search

    def stream(self, text: str) -> Iterator[int]:
        """Ids of a text without spaces to escape, given out as soon as all surviving paths share them.

        Positions are settled from left to right, each from the pieces that end there, which an automaton
        finds. The window reaches back from what the longest piece can still start at to the last
        border that all surviving paths cross; ids before it are given out and forgotten.
        """
        for ids in self.search(text):
            yield from ids

    def search(self, text: str) -> Iterator[list[int]]:
        """As stream, in lists; the one search there is, for texts of any length."""
        return self._best_neighbours(text) if self.bpe else self._best_sums(text)

    def _best_neighbours(self, text: str) -> Iterator[list[int]]:
        fits, base, size, check = self.fits, 0, 1, 4 * self.longest
        # Of base + i: the piece that ends there ("": the start, None: no path), and what is known of pieces after it. All paths cross base.
        last: list[str | None] = [""]
        after: list[dict[str, bool] | None] = [fits.setdefault("", {})]
        for end, p in self.automaton.iter(text):  # by ends, the longest first
            at = end + 1 - base
            if at < size:
                continue
            while at > size:  # passed over
                c = text[base + size - 1]
                if c in self.held:
                    last.append(None)
                    after.append(None)
                    size += 1
                else:  # no piece holds it, so every path is cut here
                    yield self._path(last, size - 1) + self._unknown(c)
                    base += size
                    last, after, size, at, check = [""], [fits.setdefault("", {})], 1, end + 1 - base, 4 * self.longest
            known = after[at - len(p)]
            if known is None:
                continue
            ok = known.get(p)
            if ok is None:
                known[p] = ok = self._fit(last[at - len(p)], p)
            if ok:
                last.append(p)
                after.append(fits[p] if p in fits else fits.setdefault(p, {}))
                size += 1
                if size > check:
                    if cut := self._common(last):
                        yield self._path(last, cut)
                        last, after, base, size = last[cut:], after[cut:], base + cut, size - cut
                    check = max(4 * self.longest, 2 * size)
        yield self._path(last, size - 1)
        for c in text[base + size - 1 :]:
            yield self._unknown(c)

    def _fit(self, prev: str, p: str) -> bool:
        """Whether a piece, or a character that pieces hold, comes out of merges, and next to the piece before it."""
        ok = (len(p) == 1 or p in self.ids and self.split(p) is not None) and (not prev or self.stay(prev, p))
        self.n_fits += 1
        if self.n_fits >= 2 * MEMO:
            self.n_fits = 0
            self.fits.clear()
        return ok

    def _best_sums(self, text: str) -> Iterator[list[int]]:
        base, check, last, best = 0, 4 * self.longest, [""], [0.0]
        for end, p in self.automaton.iter(text):
            while len(last) < end + 2 - base:
                last.append(text[base + len(last) - 1])  # at worst, a character on its own
                best.append(best[-1] + self.low)
            at = end + 1 - base
            i = self.ids.get(p)
            score = best[at - len(p)] + (self.low if i is None else self.scores[i])
            if score > best[at]:
                last[at], best[at] = p, score
            if at > check:
                if cut := self._common(last[:at]):
                    yield self._path(last, cut)
                    last, best, base = last[cut:], best[cut:], base + cut
                check = max(4 * self.longest, 2 * len(last))
        for c in text[base + len(last) - 1 :]:
            last.append(c)
        yield self._path(last, len(last) - 1)

    def _common(self, last: list[str | None]) -> int:
        """The last place that all paths cross: those to where the longest piece may still start, and to all places after."""
        live = {j for j in range(max(0, len(last) - self.longest), len(last)) if last[j] is not None}
        while len(live) > 1:
            j = max(live)
            live.remove(j)
            live.add(j - len(last[j]))
        return live.pop() if live else 0

    def _path(self, last: list[str | None], end: int) -> list[int]:
        """Ids of the path to end."""
        ids, parts = self.ids, []
        while end:
            p = last[end]
            i = ids.get(p)
            parts.append(self._unknown(p) if i is None else i)
            end -= len(p)
        out = []
        for x in reversed(parts):
            if type(x) is int:
                out.append(x)
            else:
                out += x
        return out

    def _unknown(self, c: str) -> list[int]:
        if not self.bytes:
            return [self.unk]
        return [self.bytes[b] for b in c.encode()]

    def chunk(self, c: str) -> bytes:
        """Ids of a chunk, packed as 32-bit numbers."""
        found = list(self.search(c))
        return array("i", found[0]).tobytes() if len(found) == 1 else b"".join([array("i", ids).tobytes() for ids in found])

    def rest(self) -> None:
        """Drop the memos, so that a worker without a task holds the model alone."""
        self.memo, self.old, self.n_fits = {}, {}, 0
        self.fits.clear()
        trim()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text. No piece crosses certain borders (_cuts), so all paths meet there: what
        lies between them is searched one by one and its ids kept in a memo."""
        if not text:
            return np.empty(0, np.int32)
        text = (SPACE * self.dummy_prefix + text).replace(" ", SPACE)
        if self.inner:
            return np.frombuffer(self.chunk(text), np.int32)
        chunks, memo = WORD.findall(text), self.memo
        out = list(map(memo.get, chunks))
        if None in out:
            for k, c in enumerate(chunks):
                if out[k] is None:
                    got = self.memo.get(c)
                    out[k] = self._learn(c) if got is None else got
        return np.frombuffer(b"".join(out), np.int32)

    def _learn(self, word: str) -> bytes:
        """Ids of a word, from those of its parts; both go to the memo."""
        if len(self.memo) >= MEMO:
            self.memo, self.old = {}, self.memo
        memo, old = self.memo, self.old
        ids = old.get(word)
        if ids is None:
            got, parts = [], self.words.findall(word)
            for c in parts:
                ids = memo.get(c)
                if ids is None:
                    ids = old.get(c)
                    if ids is None:
                        ids = self.chunk(c)
                    if len(c) <= 64:
                        memo[c] = ids
                got.append(ids)
            ids = b"".join(got)
        if len(word) <= 64:
            memo[word] = ids
        return ids

    def _surface(self, i: int) -> bytes:
        kind = self.kinds[i]
        if kind == "byte":
            return bytes([int(self.pieces[i][3:5], 16)])
        if kind == "control":
            return b""
        return " ⁇ ".encode() if kind == "unknown" else self.pieces[i].replace(SPACE, " ").encode()

    def decode(self, ids) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD. An id out of range raises."""
        out = self.out
        text = b"".join([out[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


def _sent(df: DataFrame, model: str):
    m = Codec.load(model)
    parts = (m.pieces, m.scores, m.kinds, m.bpe, m.dummy_prefix)
    return hashlib.sha256(repr(parts).encode()).hexdigest(), df.sparkSession.sparkContext.broadcast(parts)


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, str] | None = None, packed: bool = False, check: bool = True) -> DataFrame:
    """doc_id, n_ids, ids, round_trip, for every row and whole text, then the columns of `keep` ({name: name in the result}).

    model: path of a SentencePiece model on the driver; its pieces, bounded by the vocabulary, are
    broadcast. round_trip tells whether decoding gives the text again; it's false only for texts
    that hold U+2581 itself, which the format can't tell from a space. Null and empty texts have no
    ids and round_trip true. Ids may be null or repeated: rows are independent of one another.
    A word without end goes through the search in a bounded window, as all do. Columns not in `keep` are ignored,
    whatever their names; an empty table gives an empty result. packed: ids are a binary of little-endian 32-bit numbers, which
    passes between Python and the JVM as it is, and not number by number. Without check, round_trip is left out.
    """
    bound_batches(docs.sparkSession)
    digest, parts = _sent(docs, model)
    more = keep or {}

    def run(batches):
        codec = kept(f"codec {digest}", lambda: Codec(*parts.value))
        codec.rest()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                got = [codec.encode(t) for t in texts]
                sizes = np.array([len(g) for g in got], np.int32)
                if packed:
                    ids = pa.array([g.astype("<i4", copy=False).tobytes() for g in got], pa.binary())
                else:
                    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                    flat = np.concatenate(got) if got else np.empty(0, np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                same = [pa.array([codec.decode(g.tolist()) == (t or "") for g, t in zip(got, texts, strict=True)])] if check else []
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), ids, *same, *part.columns[2:]], ["doc_id", "n_ids", "ids", *["round_trip"][: len(same)], *more.values()])
        codec.rest()

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in more.items()])
    kind = rows.schema["doc_id"].dataType.simpleString()
    kinds = "".join(f", `{n}` {rows.schema[n].dataType.simpleString()}" for n in more.values())
    return rows.mapInArrow(run, f"doc_id {kind}, n_ids int, ids {'binary' if packed else 'array<int>'}{', round_trip boolean' if check else ''}{kinds}")


def id_lists(column: pa.Array) -> Iterator[list[int] | None]:
    """The ids of each row of a column of lists or of packed ids, taken from Arrow's buffers."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return (np.frombuffer(x.as_buffer(), "<i4").tolist() if x.is_valid else None for x in column)
    return (x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else None for x in column)


def decode_documents(coded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the texts of ids, in lists or packed. Null ids give a null text, none an empty one."""
    bound_batches(coded.sparkSession)
    digest, parts = _sent(coded, model)

    def run(batches):
        codec = kept(f"codec {digest}", lambda: Codec(*parts.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [None if x is None else codec.decode(x) for x in id_lists(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = coded.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
