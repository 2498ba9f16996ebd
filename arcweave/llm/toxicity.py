"""Toxicity: non-negative positive-unlabelled learning over hashed words and word beginnings."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import bound_batches, forget, sample_ids, texts_of, trim

WORD = re.compile(r"\w+")
BITS = 20
HEADS = (4, 5, 6, 7)
#: Texts that a feature is thought to be in besides, in the usual proportion.
SMOOTH = 20.0
#: Words kept in a worker's memo; it is emptied when full.
MEMO = 250_000


def word_features(word: str) -> list[int]:
    """Hashed features of a lower-cased word: the whole, and its beginnings."""
    mask = (1 << BITS) - 1
    return [zlib.crc32(b"=" + word.encode()) & mask, *(zlib.crc32(word[:n].encode()) & mask for n in HEADS if len(word) > n)]


def sparse(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row starts, feature, value): value is the share of the text's words that have the feature, times 100, at most 5."""
    starts, ids, vals, memo = [0], [], [], {}
    for t in texts:
        found = WORD.findall(t.lower()) if t else []
        flat = []
        for w in found:
            got = memo.get(w)
            if got is None:
                got = memo[w] = word_features(w)
            flat += got
        f, n = np.unique(np.array(flat, np.int32), return_counts=True)
        ids.append(f)
        vals.append(np.minimum(5.0, n * (100.0 / max(20, len(found)))).astype(np.float32))
        starts.append(starts[-1] + len(f))
    return np.array(starts), np.concatenate(ids or [np.empty(0, np.int32)]), np.concatenate(vals or [np.empty(0, np.float32)])


@dataclass
class Model:
    """weight by feature, and the bias; several fits are averaged into one, since all are linear."""

    weight: np.ndarray
    bias: float

    def word(self, w: str) -> float:
        return float(self.weight[word_features(w)].sum())


def nnpu(starts, ids, vals, positive: np.ndarray, prior: float, unlabelled: np.ndarray | None = None, rounds: int = 150, rate: float = 0.15, decay: float = 5e-4, seed: int = 0, fits: int = 3) -> Model:
    """Fit linear classifiers by the non-negative risk estimator with the logistic loss.

    risk = prior * P[loss(+)] + max(0, U[loss(-)] - prior * P[loss(-)]). While the second part is
    below zero, a step goes up its gradient instead, which stops unlabelled positives from being learnt as
    negatives. unlabelled: the sample of all texts, of which `prior` are positive, confirmed ones among
    them; by default, those that aren't confirmed. Each fit sees a random part; Adam steps on full batches.
    """
    unlabelled = ~positive if unlabelled is None else unlabelled
    n, size = len(starts) - 1, 1 << BITS
    # Features count by how much more often they are in positives than in unlabelled texts, smoothed
    # so that those of few texts, which can't be told from chance, hardly count.
    rows = np.repeat(np.arange(n), np.diff(starts))
    in_pos, in_all = np.bincount(ids[positive[rows]], minlength=size), np.bincount(ids, minlength=size)
    n_pos, n_all = max(1, positive.sum()), max(1, n)
    lift = (in_pos + SMOOTH * n_pos / n_all) / (in_all + SMOOTH) * (n_all / n_pos)
    trust = np.where(in_pos >= 2, np.maximum(0.0, np.log(lift)), 0.0)
    keep = trust[ids] > 0.2
    rows, ids, vals = rows[keep], ids[keep], vals[keep] * trust[ids[keep]]
    used, cols = np.unique(ids, return_inverse=True)
    total, bias_sum = np.zeros(size), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(fits):
        mine = rng.random(n) < 0.9
        p, u = mine & positive, mine & unlabelled
        if not p.any() or not u.any():
            p, u = positive, unlabelled
        np_, nu = max(1, p.sum()), max(1, u.sum())
        w, b = np.zeros(len(used)), np.log(prior / (1 - prior))
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for t in range(1, rounds + 1):
            g = np.bincount(rows, vals * w[cols], n) + b
            up = 1 / (1 + np.exp(-np.clip(g, -30, 30)))  # slope of loss(-); that of loss(+) is up - 1
            neg = np.logaddexp(0, g)
            gap = neg[u].sum() / nu - prior * neg[p].sum() / np_
            slope = np.where(p, prior * (up - 1) / np_, 0.0)
            part = np.where(u, up / nu, 0.0) - np.where(p, prior * up / np_, 0.0)
            slope = slope + part if gap >= 0 else -part
            gw = np.bincount(cols, vals * slope[rows], len(used)) + decay * w
            gb = slope.sum()
            m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
        total[used] += w * trust[used] / fits
        bias_sum += b / fits
    return Model(total, float(bias_sum))


def score_texts(model: Model, texts: list[str | None], memo: dict[str, float]) -> np.ndarray:
    """Score, 0 to 1, of every text; whole texts, empty ones too."""
    out = np.empty(len(texts))
    for k, t in enumerate(texts):
        found = WORD.findall(t.lower()) if t else []
        got = list(map(memo.get, found))
        if None in got:
            for i, w in enumerate(found):
                if got[i] is None:
                    x = memo.get(w)
                    if x is None:
                        x = model.word(w)
                        if len(memo) >= MEMO:
                            memo.clear()
                        if len(w) <= 64:
                            memo[w] = x
                    got[i] = x
        out[k] = sum(got) * (100.0 / max(20, len(found))) + model.bias
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positive: int = 3000, max_unlabelled: int = 6000) -> Model:
    """Fit on at most max_positive confirmed toxic texts and max_unlabelled others, by the order of a hash of the id.

    train: a condition on id_col that rows to learn from meet. The class prior is the share of
    positives among the labels met, between 0.001 and 0.5. With no positive, or no text of one, the model is
    the constant 0.001. Texts of the sample go to the driver; the two bounds hold at any size.
    """
    key = F.col(f"`{id_col}`")
    train = F.lit(True) if train is None else train
    known = labels.select(key, F.col(f"`{label_col}`").cast("int").alias("y")).filter(train & key.isNotNull() & F.col("y").isNotNull())
    stats = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p")).first()
    constant = Model(np.zeros(1 << BITS), float(np.log(0.001 / 0.999)))
    if not stats.p:
        return constant
    prior = min(0.5, max(0.001, stats.p / stats.n))
    confirmed = sample_ids(known.filter("y = 1").select(key), stats.p, max_positive, 11)
    others = sample_ids(docs.select(key).filter(train & key.isNotNull()), docs.count(), max_unlabelled, 12)
    rows = texts_of(docs, [*confirmed, *others], id_col, text_col)
    confirmed, others = set(confirmed), set(others)
    marks = np.array([(i in confirmed, i in others) for i, _ in rows], bool).reshape(-1, 2)
    if not marks[:, 0].any():
        return constant
    features = sparse([t for _, t in rows])
    del rows
    out = nnpu(*features, marks[:, 0], prior, marks[:, 1])
    del features
    trim()
    return out


def _scorer(docs: DataFrame, model: Model):
    """A function that makes, for a task, a function which scores texts, with a memo of its own."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.weight.astype(np.float32), model.bias))

    def start():
        forget()
        mine, memo = Model(*sent.value), {}
        return lambda texts: score_texts(mine, texts, memo)

    return start


def reject(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose texts score below the threshold; null and odd rows as in score."""
    start, at = _scorer(docs, model), docs.columns.index(text_col)

    def run(batches):
        scores = start()
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                yield part.filter(pa.array(scores(part.column(at).to_pylist()) < threshold))
        forget()

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows as (doc_id, score), in any order; null text is the empty text, null and repeated ids stay.

    Rows are scored one by one in Arrow batches, long texts whole; the model has a fixed size of 2^20 numbers. Other
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    start = _scorer(docs, model)

    def run(batches):
        scores = start()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores(part.column(1).to_pylist()))], ["doc_id", "score"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
