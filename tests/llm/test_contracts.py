"""Contracts of the registered queries without SQL, and odd rows in the pipeline's stages."""

import math
import os
import re
import zlib
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arcweave.llm.queries import QUERIES, SHARES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.mark.parametrize(("name", "n", "held", "least", "label"), [("op1_toxicity", 4, 2, 0.3, "toxic"), ("op3_quality_crf", 3, 1, 0.5, "quality")])
def test_classifiers(spark, tmp_path, name, n, held, least, label):
    """Folds and thresholds; labels of the held-out fold, turned round, change no score."""
    rows = QUERIES[name](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())
    for r in rows:
        assert r.held_out == (crc(r.doc_id, n) == held) and 0 <= r.score <= 1 and r.predicted == int(r.score >= least)
    assert any(r.held_out for r in rows) and {r.predicted for r in rows} == {0, 1}
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    kind = labels.schema[label].dataType
    turned = F.when(F.crc32(F.col("doc_id").cast("string")) % n == held, 1 - F.col(label)).otherwise(F.col(label)).cast(kind)
    labels.withColumn(label, turned).write.parquet(str(tmp_path / "labels.parquet"))
    os.symlink(f"{FOLDER}/documents.parquet", tmp_path / "documents.parquet")
    again = QUERIES[name](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.score for r in again} == pytest.approx({r.doc_id: r.score for r in rows})


def test_language_model_counts(spark):
    """Folds, training tokens and the base score, counted again."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = {i: [*re.findall("[^\x20\x09-\x0d]+", t.translate(lower)), None] for i, t in docs.items()}
    c = Counter(w for i, ws in tokens.items() if crc(i, 10) for w in ws)
    total, kinds = sum(c.values()), len(c)
    rows = QUERIES["op6_kneser_ney"](spark, FOLDER).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(r.doc_id, 10) == 0, len(ws), sum(w in c for w in ws), total)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws))


def simulated(blocks, shares):
    """Slot by slot: of the blocks that are released, the one with the earliest deadline. After a stream has run out, all begin anew."""
    left, out, t0 = {s: n for s, n in blocks.items() if n}, [], 0
    given = dict.fromkeys(left, 0)
    while left:
        q, done, t, ended = sum(shares[s] for s in left), dict.fromkeys(left, 0), 0, False
        while not ended:
            ready = [(math.ceil(Fraction((done[s] + 1) * q, shares[s])), s) for s in left if math.floor(Fraction(done[s] * q, shares[s])) <= t]
            s = min(ready)[1]
            out.append((s, given[s], t0 + t))
            done[s], given[s], left[s], t = done[s] + 1, given[s] + 1, left[s] - 1, t + 1
            if not left[s]:
                del left[s]
                ended = True
        t0 += t
    return out


def test_mixture(spark):
    """Blocks and slots of the registered query against a schedule made slot by slot."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "source").collect()
    rows = QUERIES["op4_source_mix"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs)
    stream = {r.doc_id: r.source if r.source in SHARES else "" for r in docs}
    assert all(r.stream == stream[r.doc_id] for r in rows)
    sizes = Counter(stream.values())
    want = simulated({s: -(-n // 16) for s, n in sizes.items()}, SHARES | {"": 1})
    assert {(r.stream, r.block, r.slot) for r in rows} == set(want)
    assert len({r.pos for r in rows}) == len(rows) and all(r.pos // 16 == r.slot for r in rows)
    fill = Counter((r.stream, r.block) for r in rows)
    assert all(n == min(16, sizes[s] - 16 * b) for (s, b), n in fill.items())


KINDS = "doc_id long, text string, source string, n_chars long, score string, __key string, __hash string, __tie string, __source string, __n_removed string, __pos string, comp string"
EXTRA = ("a", "b", "c", "d", "e", "f", "g", "h")
ODD = [
    (None, "a line\nof a document without an id", "src1", 34, *EXTRA),
    (1, None, "src1", None, *EXTRA),
    (2, "", None, 0, *EXTRA),
    (3, "words of three", "src0", 14, *EXTRA),
    (3, "words of three", "src0", 14, *EXTRA),
    (4, "w " * 60_000, "else", 120_000, *EXTRA),
    (5, None, None, None, *[None] * 8),
]


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_odd_rows(spark, name, stage):
    """Nulls, empty and long texts, repeated rows and columns of any name: clean rows stay, as they were. Empty in, empty out."""
    docs = spark.createDataFrame(ODD, KINDS)
    got = stage(spark, docs, FOLDER)
    if name == "sentencepiece":
        assert got.columns == ["doc_id", "n_ids", "ids", "round_trip", "pos"]
        assert sorted((r.doc_id for r in got.collect()), key=repr) == sorted((r[0] for r in ODD), key=repr)
    else:
        assert got.columns == docs.columns
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(ODD, key=repr)
    none = stage(spark, docs.limit(0), FOLDER)
    assert none.columns == got.columns and none.count() == 0


@pytest.mark.parametrize("name", ["op1_toxicity", "op3_quality_crf", "op4_source_mix", "op6_kneser_ney", "op10_sentencepiece"])
def test_empty_documents(spark, tmp_path, name):
    """Labels without documents: no rows, with the columns of any result."""
    spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    os.symlink(f"{FOLDER}/labels.parquet", tmp_path / "labels.parquet")
    got = QUERIES[name](spark, str(tmp_path))
    assert got.count() == 0 and "doc_id" in got.columns


@pytest.mark.parametrize("name", ["op1_toxicity", "op3_quality_crf", "op4_source_mix", "op6_kneser_ney", "op9_ngram_join", "op7_exact_dedup", "op10_sentencepiece"])
def test_odd_documents(spark, tmp_path, name):
    """The odd rows as the whole table: one result for each of them, or for each id where ids are what is grouped."""
    spark.createDataFrame(ODD, KINDS).write.parquet(str(tmp_path / "documents.parquet"))
    os.symlink(f"{FOLDER}/labels.parquet", tmp_path / "labels.parquet")
    got = [r.doc_id for r in QUERIES[name](spark, str(tmp_path)).collect()]
    assert {*got} == {r[0] for r in ODD} and len(got) in (len(ODD), len(ODD) - 1)
