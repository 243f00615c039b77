"""Entities and qualities that stand together in one text unit.

The pairs come from a self-join of the matches on the unit, so the cost follows
the matches per unit, not the number of names times the number of names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.operators.matching import phrase_hits
from sylva.operators.ranking import phrase_idf, phrase_scores, text_lengths, top_k
from sylva.session import cut


def pairs(matches: DataFrame, key: str, left: str = "entity", right: str = "quality") -> DataFrame:
    """``key, e_name, e_id, q_name, q_id`` of each distinct pair of a unit."""
    m = matches.select(key, "name", "id", "kind").distinct()
    e = m.filter(F.col("kind") == left).select(key, F.col("name").alias("e_name"), F.col("id").alias("e_id"))
    q = m.filter(F.col("kind") == right).select(key, F.col("name").alias("q_name"), F.col("id").alias("q_id"))
    return e.join(q, key)


def scored_pairs(df: DataFrame, key: str, text: str, phrases: DataFrame, k: int = 1000) -> DataFrame:
    """``key, e_name, e_id, q_name, q_id, score``: the ``k`` best units of each pair."""
    hits = cut(phrase_hits(df, [key], text, phrases))  # read twice
    parts = phrase_scores(hits, key, phrase_idf(df, text, phrases), text_lengths(df, key, text)).select(key, "name", "part")
    named = hits.select(key, "name", "id", "kind").distinct().join(parts, [key, "name"])
    e = named.filter(F.col("kind") == "entity").select(key, F.col("name").alias("e_name"), F.col("id").alias("e_id"), F.col("part").alias("e_part"))
    q = named.filter(F.col("kind") == "quality").select(key, F.col("name").alias("q_name"), F.col("id").alias("q_id"), F.col("part").alias("q_part"))
    both = e.join(q, key).select(key, "e_name", "e_id", "q_name", "q_id", F.round(F.col("e_part") + F.col("q_part"), 6).alias("score"))
    return top_k(both, ["e_id", "q_id"], "score", [key], k).drop("rank")


def single_phrase_hits(df: DataFrame, key: str, text: str, phrases: DataFrame, k: int = 1000) -> DataFrame:
    """``key, name, id, score``: the ``k`` best units of each phrase."""
    hits = phrase_hits(df, [key], text, phrases)
    parts = phrase_scores(hits, key, phrase_idf(df, text, phrases), text_lengths(df, key, text))
    named = hits.select(key, "name", "id").distinct().join(parts, [key, "name"]).select(key, "name", "id", F.round("part", 6).alias("score"))
    return top_k(named, ["id"], "score", [key], k).drop("rank")


def tagged_fragments(df: DataFrame, key: str, text: str, spans: DataFrame, per_unit: int = 50) -> DataFrame:
    """``key, e_name, q_name, fragment``: the text with an entity span and a quality span that don't
    overlap set between ``<E>`` and ``<Q>`` tags.

    ``spans``: ``key, start, length, name, kind``, start from 0 in characters.
    """
    e = spans.filter(F.col("kind") == "entity").select(key, F.col("start").alias("es"), F.col("length").alias("el"), F.col("name").alias("e_name"))
    q = spans.filter(F.col("kind") == "quality").select(key, F.col("start").alias("qs"), F.col("length").alias("ql"), F.col("name").alias("q_name"))
    both = e.join(q, key).filter((F.col("es") + F.col("el") <= F.col("qs")) | (F.col("qs") + F.col("ql") <= F.col("es")))
    kept = top_k(both.withColumn("_gap", -F.abs(F.col("es") - F.col("qs"))), [key], "_gap", ["es", "qs", "e_name", "q_name"], per_unit)
    t = kept.join(df.select(key, F.col(text).alias("_t")), key)
    cut = lambda a, b: F.substring(F.col("_t"), a + 1, b - a)
    end = F.length("_t")
    first_e = F.concat(
        cut(F.lit(0), F.col("es")), F.lit("<E>"), cut(F.col("es"), F.col("es") + F.col("el")), F.lit("</E>"), cut(F.col("es") + F.col("el"), F.col("qs")),
        F.lit("<Q>"), cut(F.col("qs"), F.col("qs") + F.col("ql")), F.lit("</Q>"), cut(F.col("qs") + F.col("ql"), end),
    )
    first_q = F.concat(
        cut(F.lit(0), F.col("qs")), F.lit("<Q>"), cut(F.col("qs"), F.col("qs") + F.col("ql")), F.lit("</Q>"), cut(F.col("qs") + F.col("ql"), F.col("es")),
        F.lit("<E>"), cut(F.col("es"), F.col("es") + F.col("el")), F.lit("</E>"), cut(F.col("es") + F.col("el"), end),
    )
    return t.select(key, "e_name", "q_name", F.when(F.col("es") < F.col("qs"), first_e).otherwise(first_q).alias("fragment"))


def name_spans(df: DataFrame, key: str, text: str, phrases: DataFrame) -> DataFrame:
    """``key, start, length, name, kind``: the first place, in characters, of each matched phrase."""
    hits = phrase_hits(df, [key], text, phrases).select(key, "name", "kind").distinct()
    at = hits.join(df.select(key, F.lower(F.col(text)).alias("_t")), key)
    return at.select(key, (F.instr(F.col("_t"), F.col("name")) - 1).alias("start"), F.length("name").alias("length"), "name", "kind").filter("start >= 0")
