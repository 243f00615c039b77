"""Relevance of matched phrases, and top-k per query.

``score = sum over phrases of sqrt(tf) * idf^2 / sqrt(length)``, where a phrase's
idf is the sum over its tokens of ``1 + ln(N / (df + 1))`` and the length counts
the text's tokens without stop words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions.text import STOP_EN, content_tokens, tokens


def text_lengths(df: DataFrame, key: str, text: str, stop: list[str] | None = None) -> DataFrame:
    return df.select(key, F.size(content_tokens(F.col(text), STOP_EN if stop is None else stop)).alias("length"))


def phrase_idf(df: DataFrame, text: str, phrases: DataFrame) -> DataFrame:
    """``name, idf`` of each phrase; only tokens of the dictionary are counted in the texts."""
    n = df.count()
    wanted = phrases.select(F.explode("phrase").alias("term")).distinct()
    seen = df.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).join(wanted, "term")
    df_term = wanted.join(seen.groupBy("term").agg(F.count("*").alias("df")), "term", "left")
    idf = df_term.select("term", (F.lit(1.0) + F.log(F.lit(float(n)) / (F.coalesce("df", F.lit(0)) + 1))).alias("idf"))
    parts = phrases.select("name", "phrase").distinct().select("name", F.explode("phrase").alias("term"))
    return parts.join(idf, "term").groupBy("name").agg(F.sum("idf").alias("idf"))


def phrase_scores(hits: DataFrame, key: str, idf: DataFrame, lengths: DataFrame) -> DataFrame:
    """``key, name, tf, part``: what each phrase adds to a text's score."""
    tf = hits.groupBy(key, "name").agg(F.countDistinct("pos").alias("tf"))
    return tf.join(idf, "name").join(lengths, key).select(key, "name", "tf", (F.sqrt("tf") * F.col("idf") * F.col("idf") / F.sqrt("length")).alias("part"))


def top_k(df: DataFrame, query: list[str], score: str, tie: list[str], k: int) -> DataFrame:
    """The ``k`` best rows of each query; Catalyst keeps only ``k`` per task before the shuffle."""
    w = Window.partitionBy(*query).orderBy(F.desc(score), *tie)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
