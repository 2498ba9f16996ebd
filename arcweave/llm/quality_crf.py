"""Quality classifier: a linear-chain conditional random field labels the lines of a text good or bad."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import bound_batches, forget, sample_ids, texts_of

UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: Names of a line's own features; the neighbours' are the same ones of the lines before and after.
OWN = ("words", "short", "upper", "symbols", "exclaims", "pipes", "digits", "marked words", "repeats of words", "stutter", "word length", "ends a sentence", "line again", "empty")


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features of every line, its length in bytes); a text has a line at least."""
    lines = (text or "").encode().split(b"\n")
    seen: dict[bytes, int] = {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    out, size = np.zeros((len(lines), len(OWN)), np.float32), np.empty(len(lines))
    known: dict[bytes, tuple] = {}
    for i, x in enumerate(lines):
        n = size[i] = len(x)
        got = known.get(x)
        if got is None:
            found = x.split()
            k = len(found)
            if not k:
                got = (0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1)
            else:
                up, low = n - len(x.translate(None, UPPER)), n - len(x.translate(None, LOWER))
                distinct = len(set(found))
                marked = sum(w[-1:] in b"*$%&#!|@~^=" for w in found)
                got = (
                    min(1.0, k / 50), k < 3, up / (up + low + 1), min(1.0, 8 * (n - len(x.translate(None, b"*$%&#@~^=<>{}\\"))) / n), min(1.0, 8 * x.count(b"!") / k / 2),
                    min(1.0, 4 * x.count(b"|") / k), min(1.0, 4 * (n - len(x.translate(None, b"0123456789"))) / n), marked / k,
                    max(0.0, 1 - distinct / k - 0.3) * (k > 5), min(1.0, 2 * sum(map(bytes.__eq__, found, found[1:])) / k),
                    min(1.0, n / k / 20), x.rstrip()[-1:] in b".?:;\"'", (seen[x] > 1) * 1.0, 0,
                )
            known[x] = got
        out[i] = got
    return out, size + 1


def with_neighbours(own: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A column of ones, a line's own features, those of the line before and after (0 at a text's ends)."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[starts[:-1]] = 0
    after[starts[1:] - 1] = 0
    return np.concatenate([np.ones((len(own), 1), np.float32), own, before, after], axis=1)


def forward_backward(e: np.ndarray, trans: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the lines' two states, and the expected number of each transition.

    e: (lines, 2) scores of the states; texts are walked side by side, a line of each at a time.
    """
    size = np.diff(starts)
    order = np.argsort(-size, kind="stable")
    first, long = starts[:-1][order], size[order]
    active = np.searchsorted(-long, -np.arange(1, long[0] + 1), side="right")  # texts with more than t lines
    a, b = np.empty_like(e), np.zeros_like(e)
    a[first] = e[first]
    for t in range(1, long[0]):
        i = first[: active[t]] + t
        p = a[i - 1]
        a[i] = e[i] + np.logaddexp(p[:, :1] + trans[0], p[:, 1:] + trans[1])
    for t in range(long[0] - 1, 0, -1):
        i = first[: active[t]] + t
        n = e[i] + b[i]
        b[i - 1] = np.logaddexp(n[:, :1] + trans[:, 0], n[:, 1:] + trans[:, 1])
    z = np.repeat(np.logaddexp(*a[starts[1:] - 1].T), size)[:, None]
    inner = np.ones(len(e), bool)
    inner[starts[:-1]] = False
    i = np.flatnonzero(inner)
    moves = np.exp(a[i - 1][:, :, None] + trans + (e[i] + b[i] - z[i])[:, None, :]).sum(axis=0)
    return np.exp(a + b - z), moves


@dataclass
class Model:
    """Weights of the state 'good' against 'bad', transitions, and the line that maps a text's quality to its score."""

    weight: np.ndarray
    trans: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def marginals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chance that a line is good, its length, starts of the texts)."""
        parts = [line_features(t) for t in texts]
        starts = np.concatenate(([0], np.cumsum([len(n) for _, n in parts])))
        x = with_neighbours(np.concatenate([f for f, _ in parts]), starts)
        return self._good(x, starts), np.concatenate([n for _, n in parts]), starts

    def _good(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return forward_backward(np.stack([np.zeros(len(x)), x @ self.weight], axis=1), self.trans, starts)[0][:, 1]

    def quality(self, texts: list[str | None]) -> np.ndarray:
        """Share of a text that is good: the marginals, weighted by the lines' lengths."""
        p, n, starts = self.marginals(texts)
        return np.add.reduceat(p * n, starts[:-1]) / np.add.reduceat(n, starts[:-1])

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * _logit(self.quality(texts)) + self.offset)))


def _logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-3, 1 - 1e-3)
    return np.log(q / (1 - q))


def train(texts: list[str], good: np.ndarray, turns: int = 3, rounds: int = 60, rate: float = 0.2, decay: float = 1e-3) -> Model:
    """Fit the field to texts that are known to be good or bad as a whole.

    All lines of good texts are good. Bad texts hold lines of both kinds: at first all count as bad,
    then, for some turns, those that the field finds good are so, except the worst of each text.
    """
    parts = [line_features(t) for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(n) for _, n in parts])))
    x, length = with_neighbours(np.concatenate([f for f, _ in parts]), starts).astype(float), np.concatenate([n for _, n in parts])
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))
    model = Model(np.zeros(x.shape[1]), np.zeros((2, 2)))
    y = good[doc].astype(bool)
    # Either kind weighs the same however many texts or lines it has.
    share = np.where(good[doc], 0.5 / max(1, good[doc].sum()), 0.5 / max(1, (~good[doc]).sum()))
    inner = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    for turn in range(turns):
        mw, vw, mt, vt = (np.zeros_like(z) for z in (model.weight, model.weight, model.trans, model.trans))
        for t in range(1, rounds + 1):
            p, moves = forward_backward(np.stack([np.zeros(len(x)), x @ model.weight], axis=1), model.trans, starts)
            gw = x.T @ ((y - p[:, 1]) * share) - decay * model.weight
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
            gt = (seen - moves) / max(1, len(inner)) - decay * model.trans
            mw, vw, mt, vt = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw**2, 0.9 * mt + 0.1 * gt, 0.99 * vt + 0.01 * gt**2
            fix = lambda m, v: m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)  # noqa: B023, E731
            model.weight = model.weight + rate * fix(mw, vw)
            model.trans = np.clip(model.trans + rate * fix(mt, vt), -3, 3)
        if turn + 1 < turns:
            p = model._good(x, starts)
            worst = np.minimum.reduceat(p, starts[:-1])[doc]
            y = good[doc] | (p > 0.5) & (p > worst)
    q = _logit(np.add.reduceat(model._good(x, starts) * length, starts[:-1]) / np.add.reduceat(length, starts[:-1]))
    k, c = 1.0, 0.0
    for _ in range(300):
        err = good - 1 / (1 + np.exp(-(k * q + c)))
        k, c = k + 0.2 * ((err * q).mean() - 0.01 * (k - 1)), c + 0.5 * err.mean()
    model.slope, model.offset = float(max(k, 0.05)), float(c)
    return model


def fit(docs: DataFrame, labels: DataFrame, train_on: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_each: int = 2500) -> Model:
    """Fit on at most max_each labelled texts of either kind, by the order of a hash of the id.

    train_on: a condition on id_col that rows to learn from meet. Rows with a null id or label aren't
    learnt from. With one kind of label only, or none, the model scores every text the same: by the share of
    good labels, 0.5 without any. The sample's texts go to the driver; its bound holds at any size.
    """
    key = F.col(f"`{id_col}`")
    cond = F.lit(True) if train_on is None else train_on
    known = labels.select(key, F.col(f"`{label_col}`").cast("int").alias("y")).filter(cond & key.isNotNull() & F.col("y").isNotNull())
    sizes = dict(known.filter("y in (0, 1)").groupBy("y").count().collect())
    got = {y: sample_ids(known.filter(F.col("y") == y).select(key), sizes.get(y, 0), max_each, 13) for y in (0, 1)}
    rows = texts_of(docs, got[0] + got[1], id_col, text_col)
    best = set(got[1])
    good = np.array([i in best for i, _ in rows], bool)
    if len(rows) == 0 or good.all() or not good.any():
        share = float(np.clip(good.mean() if len(rows) else 0.5, 0.01, 0.99))
        return Model(np.zeros(1 + 3 * len(OWN)), np.zeros((2, 2)), 0.0, float(np.log(share / (1 - share))))
    return train([t for _, t in rows], good)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row, whole texts. Null text is empty, which is one empty line; null and
    repeated ids stay. Rows are scored in Arrow batches of up to 256 texts, long ones whole; columns besides
    the two are ignored, whatever their names, and an empty table gives an empty result."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        forget()
        m = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(m.score(part.column(1).to_pylist()))], ["doc_id", "score"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
