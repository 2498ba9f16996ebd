"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kn_lm, quality_crf, toxicity
from ._shared import UPPER, table
from .exact_dedup import exact_dedup
from .kdtree import top_k
from .line_dedup import line_dedup
from .ngram_join import ngram_join
from .source_mix import mix_sources
from .sp_codec import decode_documents, encode_documents
from .url_filter import oracle as url_oracle
from .url_filter import url_filter

#: Place of the SentencePiece model; a parameter, the file isn't part of the repository.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"

#: Rules of the page filter: (verdict, host, path).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

#: Score from which a text is called toxic, here and in the pipeline.
TOXIC = 0.3

#: Order of the language model.
LM_ORDER = 3

#: Target weights of the sources, in thousandths.
SHARES = {f"src{i}": 100 if i == 0 else 60 if i < 10 else 36 for i in range(20)}


def remainder(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.score(docs, toxicity.fit(docs, labels, remainder(4) != 2))
    return out.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), lambda x: x % 20 == 0, k=20, scale=64)


def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality_crf.score(docs, quality_crf.fit(docs, labels, remainder(3) != 1))
    return out.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=50)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, model = kn_lm.score_corpus(table(spark, sf_dir, "documents"), remainder(10) != 0, LM_ORDER)
    held = F.coalesce(remainder(10) == 0, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"), SHARES)
    return out.select("doc_id", F.col("__stream").alias("stream"), F.col("__block").alias("block"), F.col("__slot").alias("slot"), F.col("__pos").alias("pos"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), RULES)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), MODEL)


def decode_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids turned into texts again."""
    out = decode_documents(encode_documents(table(spark, sf_dir, "documents"), MODEL, packed=True, check=False), MODEL)
    return out.select("doc_id", F.sha2("text", 256).alias("text_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_top_k, op3_quality_crf, op4_source_mix, op5_line_dedup, op6_kneser_ney, op7_exact_dedup, op8_url_filter, op9_ngram_join, op10_sentencepiece, decode_sentencepiece)}

ORACLE_SQL: dict[str, str] = {
    "decode_sentencepiece": "select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents",
    "op2_top_k": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) p from embeddings
          where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.p, c.p), lambda z: z[1] * z[2]))::bigint score
          from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from s)
        select query_id, n::int as rank, vec_id, score from r where n <= 20""",
    "op5_line_dedup": """
        with l as materialized (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i from documents where text is not null),
        w as materialized (select *, len(list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) n from l),
        c as materialized (select *, sum(n) over (partition by doc_id order by i) t from w),
        e as (select a.doc_id, a.i first, min(b.i) last from c a join c b on a.doc_id = b.doc_id and b.i >= a.i and b.t - a.t + a.n >= 50 group by all
          union select a.doc_id, max(b.i), a.i from c a join c b on a.doc_id = b.doc_id and b.i <= a.i and a.t - b.t + b.n >= 50 group by a.doc_id, a.i),
        b as (select e.doc_id, first, last, list(line order by i) x from e join c on c.doc_id = e.doc_id and i between first and last group by all),
        f as (select *, min((doc_id, first)) over (partition by x) as m from b),
        cut as (select distinct f.doc_id, c.i from f join c on c.doc_id = f.doc_id and c.i between first and last where (f.doc_id, first) > m)
        select d.doc_id, coalesce(len(string_split(text, chr(10))), 0)::int as n_lines, coalesce(g.n, 0)::int as n_removed,
          sha256(coalesce(case when g.n is null then text else g.kept end, '')) as kept_sha256
        from documents d left join (select c.doc_id, count(cut.i) n, coalesce(string_agg(line, chr(10) order by c.i) filter (cut.i is null), '') kept
          from c left join cut on cut.doc_id = c.doc_id and cut.i = c.i group by c.doc_id having count(cut.i) > 0) g on g.doc_id = d.doc_id""",
    "op7_exact_dedup": """
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
          doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window w as (partition by coalesce(text, ''))""",
    "op8_url_filter": url_oracle(RULES),
    "op9_ngram_join": f"""
        with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws from documents),
        s as materialized (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 3 then [ws]
            else list_transform(range(1, len(ws) - 1), lambda i: ws[i : i + 2]) end) sh from w),
        n as (select doc_id, count(*) n from s group by doc_id),
        p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by all),
        l as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
        reach as (select doc_id, doc_id as r from documents union select reach.doc_id, l.b from reach join l on l.a = reach.r)
        select d.doc_id, coalesce(n.n, 0) as n_shingles, m.r as component_id from documents d left join n using (doc_id)
        join (select doc_id, min(r) r from reach group by doc_id) m using (doc_id)""",
}
