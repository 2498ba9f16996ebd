"""A training corpus from `documents`: five stages, each with one operator of arcweave.llm."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.llm import toxicity
from arcweave.llm._shared import release, release_executors, stash, table
from arcweave.llm.line_dedup import line_dedup
from arcweave.llm.ngram_join import ngram_join
from arcweave.llm.queries import MODEL, SHARES, TOXIC
from arcweave.llm.source_mix import mix_sources, mixed, row_tie
from arcweave.llm.sp_codec import encode_documents


def _begin(spark: SparkSession) -> None:
    """Memory that earlier stages took goes back first, so that stages of one session don't add up."""
    release(spark)
    release_executors(spark)


#: Columns that stages know.
KNOWN = ("doc_id", "text", "source", "n_chars")


def _apart(stage: Callable[[SparkSession, DataFrame, str], DataFrame]):
    """The stage with other columns under names of our own while it runs, so that none meets a name that it uses."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ours = {c: f"__other_{i}" for i, c in enumerate(docs.columns) if c not in KNOWN}
        theirs = {n: c for c, n in ours.items()}
        out = stage(spark, docs.toDF(*[ours.get(c, c) for c in docs.columns]), sf_dir)
        return out.toDF(*[theirs.get(c, c) for c in out.columns])

    return run


@_apart
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the classifier doesn't find toxic; it learns from the confirmed ones in `labels`.

    Null and empty texts are scored as empty ones, long ones whole; null and repeated ids stay or go by their texts. Without
    confirmed labels nothing is rejected; an empty table gives an empty result.
    """
    _begin(spark)
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), TOXIC)


@_apart
def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of lines of 50 words or more.

    A document that is nothing but such copies goes; one that loses some lines keeps the rest, with
    n_chars counted anew. Documents that lose nothing are as they were, empty ones too.
    """
    _begin(spark)
    out = line_dedup(docs, min_words=50)
    cut = F.col("__n_removed") > 0
    out = out.filter(~cut | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


@_apart
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group that links of 0.8 on 5-word shingles make: the one with the smallest id.

    Documents with a null id are in no group and stay. Rows that repeat an id and text stay or go
    together; an id that comes with several texts is treated text by text, by keys in the order of ids and hashes of texts.
    """
    _begin(spark)
    rows = docs.withColumns({"__hash": F.xxhash64("text"), "__key": F.col("doc_id")})
    texts = rows.filter("doc_id is not null").select("doc_id", "__hash")
    if texts.groupBy("doc_id").agg((F.min("__hash") < F.max("__hash")).alias("several")).filter("several").limit(1).count():
        ranges = texts.distinct().repartitionByRange("doc_id", "__hash").sortWithinPartitions("doc_id", "__hash")
        keys = stash(ranges.withColumn("__key", F.monotonically_increasing_id()), "keys")
        rows = stash(rows.drop("__key").join(keys, ["doc_id", "__hash"], "left"), "keyed")
    groups = ngram_join(rows, n=5, num=80, den=100, id_col="__key")
    gone = groups.filter("component_id < doc_id").select(F.col("doc_id").alias("__key")).distinct()
    return rows.join(gone, "__key", "left_anti").select(*docs.columns)


@_apart
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture: by files and rows, blocks of sources follow their target weights.

    Spark may read several files in another order; the last stage's pos has the mixture's. Null sources, and those
    without a weight, form a stream of their own; null ids and texts, and repeated rows, stay. Empty in, empty out.
    """
    _begin(spark)
    return mixed(docs, SHARES)


@_apart
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids, round_trip and pos of every document: by pos, the documents are the mixture.

    Places follow from the documents and the shares alone, so they are those that the mixing stage gave. Ids, and not
    texts, are dealt out for that, after they were written. A null text has no ids; a null id or source, repeated rows and
    long texts are treated as any; an empty table gives an empty result.
    """
    _begin(spark)
    coded = encode_documents(docs.withColumn("__tie", row_tie(docs)), MODEL, keep={"source": "__source", "__tie": "__tie"})
    placed = mix_sources(stash(coded, "coded"), SHARES, source_col="__source", tie_col="__tie")
    return placed.select("doc_id", "n_ids", "ids", "round_trip", F.col("__pos").alias("pos"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("source_mix", mix),
    ("sentencepiece", encode),
]

#: Two stages rest on a trained model and a vocabulary file, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
