"""Registered queries against their SQL, and the pipeline's stages."""

import os

import duckdb
import pytest

import corpus_pipeline
from arcweave.llm import kn_lm
from arcweave.llm.queries import ORACLE_SQL, QUERIES, remainder

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    rel = c.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(x) for x in cols]
    assert sorted((tuple(r[x] for x in cols) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count() and "doc_id" in df.columns


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names, seen = [], {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.schema == docs.schema or out.columns == docs.columns
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= seen
        names.append(name)
        seen, docs = set(ids), spark.createDataFrame(out.collect(), docs.schema)
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in got} == seen and all(r.round_trip for r in got)


def test_language_model_sees_two_words_back(spark):
    """The registered query's scores are those of order 3, and not of order 2."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r.doc_id: r.score for r in QUERIES["op6_kneser_ney"](spark, FOLDER).collect()}
    two, three = ({r.doc_id: r.score for r in kn_lm.score_corpus(docs, remainder(10) != 0, n)[0].collect()} for n in (2, 3))
    assert got == pytest.approx(three) and got != pytest.approx(two)


def test_pipeline_keeps_the_mixture(spark, tmp_path):
    """Over several files of unequal size, which Spark reads largest first."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = corpus_pipeline.mix(spark, docs, FOLDER).collect()
    for a, b in ((0, 5), (5, 30), (30, len(rows))):
        spark.createDataFrame(rows[a:b], docs.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "x"))
    read = spark.read.parquet(str(tmp_path / "x"))
    want = [r.doc_id for r in rows]
    assert [r.doc_id for r in read.collect()] != want
    assert [r.doc_id for r in corpus_pipeline.encode(spark, read, FOLDER).orderBy("pos").collect()] == want

    got = corpus_pipeline.run(spark, FOLDER).orderBy("pos").collect()
    left = docs.filter(docs.doc_id.isin([r.doc_id for r in got]))
    assert len({r.pos for r in got}) == len(got) and [r.doc_id for r in got] == [r.doc_id for r in corpus_pipeline.mix(spark, left, FOLDER).collect()]


def test_pipeline_drops_what_op1_calls_toxic(spark, monkeypatch):
    """The same fit and threshold: scores from 0.3 on go."""
    docs = spark.createDataFrame([(1, 0.1), (2, 0.29), (3, 0.3), (4, 0.49), (5, 0.5)], "doc_id long, score double")
    monkeypatch.setattr(corpus_pipeline.toxicity, "fit", lambda docs, labels: None)
    monkeypatch.setattr(corpus_pipeline.toxicity, "reject", lambda docs, model, at: docs.filter(docs.score < at))
    assert {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, FOLDER).collect()} == {1, 2}


def test_pipeline_keeps_an_ids_other_text(spark):
    """Id 2 has a near copy of id 1 and a text of its own; id 4 has two near copies of each other."""
    text = lambda a: " ".join(f"{a}{i}" for i in range(60))
    rows = [(1, text("a")), (2, text("a") + " end"), (2, text("b")), (2, text("b")), (3, text("b") + " end"), (4, text("c")), (4, text("c") + " end"), (None, text("a")), (None, None), (5, None), (6, "")]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), FOLDER)
    assert got.columns == ["doc_id", "text"]
    left = [tuple(r) for r in got.collect()]
    fours = [r for r in left if r[0] == 4]
    assert len(fours) == 1 and sorted((r for r in left if r[0] != 4), key=repr) == sorted([rows[0], rows[2], rows[3], *rows[7:]], key=repr)
