"""The language model against counts made in plain Python."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from arcweave.llm import kn_lm
from arcweave.llm._shared import words


def brute(texts, order):
    """(log10 of an n-gram, plain counts): interpolated modified Kneser-Ney, straight from its definition."""
    grams = [collections.Counter() for _ in range(order + 1)]
    raw = [collections.Counter() for _ in range(order + 1)]
    for t in texts:
        w = ["<s>"] * (order - 1) + words(t) + ["</s>"]
        for i in range(order - 1, len(w)):
            for n in range(1, order + 1):
                raw[n][tuple(w[i - n + 1 : i + 1])] += 1
    grams[order] = raw[order]
    for n in range(order - 1, 0, -1):
        for g in raw[n + 1]:
            grams[n][g[1:]] += raw[n + 1][g] if n > 1 and g[1] == "<s>" else 1
    levels = []
    for n in range(1, order + 1):
        sizes = collections.Counter(grams[n].values())
        sums = collections.defaultdict(lambda: [0, 0, 0, 0])
        for g, c in grams[n].items():
            sums[g[:-1]][0] += c
            sums[g[:-1]][min(c, 3)] += 1
        levels.append((grams[n], kn_lm.discounts(*(sizes[k] for k in (1, 2, 3, 4))), sums))

    def p(g, n):
        if n == 0:
            return 1 / (len(raw[1]) + 1)
        counts, d, sums = levels[n - 1]
        g = g[len(g) - n :]
        if g[:-1] not in sums:
            return p(g, n - 1)
        total, *kinds = sums[g[:-1]]
        c = counts.get(g, 0)
        return max(0, c - (0, *d)[min(c, 3)]) / total + sum(x * y for x, y in zip(d, kinds, strict=True)) / total * p(g, n - 1)

    return p, raw[1]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_against_brute_force(spark, order):
    rng = random.Random(order)
    vocab = [f"w{i}" for i in range(40)] + ["the"] * 40
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 25)))) for i in range(300)]
    rows += [(1000, None), (1001, "The THE unseen"), (1002, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out, model = kn_lm.score_corpus(df, F.col("doc_id") % 10 != 0, order)
    p, counts = brute([t for i, t in rows if i % 10], order)
    total, types = sum(counts.values()), len(counts)
    assert (model.tokens, model.types) == (total, types) and len(model.levels[1].hot)
    got = {r.doc_id: r for r in out.collect()}
    for i, t in rows:
        w = ["<s>"] * (order - 1) + words(t) + ["</s>"]
        last = w[order - 1 :]
        assert got[i].n_tokens == len(last) and got[i].n_known == sum(x in {g[0] for g in counts} for x in last)
        assert math.isclose(got[i].score, sum(math.log10(p(tuple(w[k - order + 1 : k + 1]), order)) for k in range(order - 1, len(w))), rel_tol=1e-9)
        assert math.isclose(got[i].base_score, sum(math.log10((counts.get((x,), 0) + 0.1) / (total + 0.1 * (types + 1))) for x in last), rel_tol=1e-9)


def test_folders_that_cannot_be_reached_raise(spark):
    with pytest.raises(ValueError, match="mount"):
        kn_lm.train(spark.createDataFrame([("a",)], "text string"), 2, folder="nowhere://x/y")


def _texts(spark):
    return spark.createDataFrame([(i, f"one two three w{i % 7} w{i % 3}") for i in range(60)], "doc_id long, text string").repartition(3)


def test_a_file_that_is_missing_raises(spark, tmp_path):
    """Whichever it is: no n-gram of it counts as unseen."""
    docs = _texts(spark)
    out, model = kn_lm.score_corpus(docs, F.lit(True), 3, folder=str(tmp_path / "m"))
    whole = {r.doc_id: r.score for r in out.collect()}
    names = sorted(p.name for p in (tmp_path / "m").iterdir())
    assert len(names) == 2 * model.word_shards + 2 * model.shards
    for kind in ("words-", "1-", "2-", "3-"):
        gone = max((p for p in (tmp_path / "m").iterdir() if p.name.startswith(kind)), key=lambda p: p.stat().st_size)
        gone.rename(tmp_path / "away")
        copy = kn_lm.Model(**vars(model) | {"files": kn_lm.Files(f"{tmp_path}/./m/{'/.' * len(kind)}")})  # nothing a worker has mapped
        with pytest.raises(Exception, match="FileNotFoundError"):
            kn_lm.score(docs, copy).collect()
        (tmp_path / "away").rename(gone)
    assert whole == pytest.approx({r.doc_id: r.score for r in kn_lm.score(docs, model).collect()})


def test_folder_of_another_file_system(spark, tmp_path):
    """Written through it, copied by workers and mapped there."""
    from pyarrow import fs

    (tmp_path / "far").mkdir()
    far = fs.SubTreeFileSystem(str(tmp_path / "far"), fs.LocalFileSystem())
    docs = _texts(spark)
    model = kn_lm.train(docs, 3, folder="m", system=far)
    near = kn_lm.train(docs, 3)
    a, b = ({r.doc_id: r.score for r in kn_lm.score(docs, m).collect()} for m in (model, near))
    assert len(a) == 60 and a == pytest.approx(b)


def test_packed_grams_come_back():
    rng = random.Random(5)
    for bits in (3, 20, 33, 64):
        cols = [kn_lm.np.array([rng.randrange(1 << bits) for _ in range(500)], kn_lm.np.uint64) for _ in range(3)]
        cols, counts = kn_lm.folded([c % kn_lm.np.uint64(1 << min(bits, 2)) if i < 2 else c for i, c in enumerate(cols)], kn_lm.np.array([rng.choice([1, 254, 255, 70000]) for _ in range(500)]), bits)
        got, back = kn_lm.unpack(kn_lm.pack(cols, counts, bits), 3)
        assert all((a == b).all() for a, b in zip(cols, got, strict=True)) and (back == counts).all() and counts.sum() > 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out, model = kn_lm.score_corpus(docs, F.lit(True), 3)
    assert out.collect() == [] and (model.tokens, model.types) == (0, 0)
    got = kn_lm.score(spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string"), model).collect()
    assert {(r.doc_id, r.n_tokens, r.score) for r in got} == {(1, 3, 0.0), (None, 1, 0.0)}
