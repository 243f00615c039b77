"""Dictionary and phrase matching over token positions.

A dictionary phrase is looked for where its first token stands: an equi-join of
token positions with the phrases' first tokens, then a check of the following
tokens. No text is compared with all phrases, and a join with the small
dictionary needs no shuffle of the texts once Spark broadcasts it by its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.functions.text import tokens


def token_rows(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """``key, pos, term``: a row per token."""
    return df.select(*key, F.posexplode(tokens(F.col(text))).alias("pos", "term"))


def phrase_hits(df: DataFrame, key: list[str], text: str, phrases: DataFrame) -> DataFrame:
    """``key, pos, n, name, id, kind``: every place where a phrase stands, overlaps included.

    Each token carries only as many following tokens as the longest phrase has, so
    the rows of a long text stay small.
    """
    longest = phrases.agg(F.max("n")).first()[0] or 1
    listed = df.select(*key, tokens(F.col(text)).alias("_all"))
    ahead = F.transform("_all", lambda t, i: F.struct(t.alias("first"), F.slice("_all", i + 1, longest).alias("ahead")))
    placed = listed.select(*key, F.posexplode(ahead).alias("pos", "_w")).select(*key, "pos", "_w.first", "_w.ahead")
    hit = placed.join(phrases, "first").filter(F.slice("ahead", F.lit(1), F.col("n")) == F.col("phrase"))
    return hit.select(*key, "pos", "n", "name", "id", "kind")


def leftmost_longest(spans: DataFrame, key: list[str]) -> DataFrame:
    """``key, pos, n``: of overlapping spans the leftmost, of equal starts the longest, none overlapping."""
    longest = spans.groupBy(*key, "pos").agg(F.max("n").alias("n"))
    per_text = longest.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("s"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<pos:int,n:int>>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        return F.when(
            x["pos"] >= acc["end"],
            F.struct((x["pos"] + x["n"]).alias("end"), F.concat(acc["kept"], F.array(F.struct(x["pos"].alias("pos"), x["n"].alias("n")))).alias("kept")),
        ).otherwise(acc)

    return per_text.select(*key, F.explode(F.aggregate("s", start, step)["kept"]).alias("k")).select(*key, "k.pos", "k.n")


def dictionary_match(df: DataFrame, key: list[str], text: str, phrases: DataFrame) -> DataFrame:
    """``key, pos, n, name, id, kind`` of the leftmost-longest matches."""
    hits = phrase_hits(df, key, text, phrases)
    return hits.join(leftmost_longest(hits, key), [*key, "pos", "n"])


def texts_with_all(df: DataFrame, key: list[str], text: str, terms: list[str]) -> DataFrame:
    """Texts that hold every one of the terms, in any order."""
    have = tokens(F.col(text))
    cond = F.lit(True)
    for t in terms:
        cond = cond & F.array_contains(have, t)
    return df.filter(cond).select(*key)
