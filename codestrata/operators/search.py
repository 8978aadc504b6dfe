"""Lexical, vector and fused retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from codestrata.functions import scalar as S

# The usual parameters of the lexical score and of rank fusion.
K1, B, RRF_K = 1.2, 0.75, 60


def terms_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): lower-case words and their counts. Null texts have none."""
    t = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("([a-z0-9]+)"), 1)).alias("term"))
    return t.groupBy("key", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, key: str, text: str, query: list[str], top: int | None = 10) -> DataFrame:
    """(key, score) of the documents that hold a query word, best first. Only the query's words are ever shuffled.

    Document lengths and frequencies cover the whole table. Ties go to the lesser key.
    """
    q = sorted({w.lower() for w in query})
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit("([a-z0-9]+)"), 1)
    d = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), words.alias("w")).select("key", F.size("w").alias("len"), F.filter("w", lambda x: x.isin(*q)).alias("w"))
    stats = d.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    tf = d.where(F.size("w") > 0).select("key", "len", F.explode("w").alias("term")).groupBy("key", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    j = tf.join(F.broadcast(df), "term").join(F.broadcast(stats), F.lit(True))  # at most one row per query word, and one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    s = j.groupBy("key").agg(F.round(F.sum(part), 6).alias("score"))
    return s.orderBy(F.desc("score"), "key").limit(top) if top else s


def nearest(vectors: DataFrame, key: str, vector: str, query: list[float], top: int | None = 10) -> DataFrame:
    """(key, score) by cosine to a query vector; brute force, one pass, in generated code. Null vectors are passed over."""
    q = F.array(*[F.lit(float(x)) for x in query])
    s = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.round(S.cosine(F.col(vector), q), 6).alias("score"))
    return s.orderBy(F.desc("score"), "key").limit(top) if top else s


def fuse(lists: list[DataFrame], top: int = 10) -> DataFrame:
    """Reciprocal rank fusion of (key, score) lists: the lists are top-k lists, so ranking them in one task is bounded."""
    ranked = [d.select("key", F.row_number().over(W.orderBy(F.desc("score"), "key")).alias("rank")) for d in lists]
    out = ranked[0]
    for r in ranked[1:]:
        out = out.unionByName(r)
    return out.groupBy("key").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("score")).orderBy(F.desc("score"), "key").limit(top)
