"""Gazetteers: names with their identifiers, built from hierarchies, aliases, word lists and glossaries.

A gazetteer is a long table (name, id, kind, source); names and values never
share state, so an addition to one name can't leak into another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions.names import kind_of
from sylva.functions.text import tokens


def from_terms(terms: DataFrame, prefixes: dict[str, str], source: str = "terms") -> DataFrame:
    """Names, synonyms and quoted references; an obsolete term's name leads to its replacement.

    The replacement counts for the term's own name; its synonyms keep the old id.
    """
    own = F.coalesce(F.col("replaced_by"), F.col("id"))
    empty = F.array().cast("array<string>")
    labels = F.concat(
        F.array(F.struct(F.col("name").alias("name"), own.alias("id"))),
        F.transform(F.concat(F.coalesce("synonyms", empty), F.coalesce("xrefs", empty)), lambda s: F.struct(s.alias("name"), F.col("id").alias("id"))),
    )
    rows = terms.select(F.inline(labels)).filter(F.col("name").isNotNull() & (F.trim("name") != ""))
    return rows.select("name", "id", kind_of(F.col("id"), prefixes).alias("kind"), F.lit(source).alias("source")).distinct()


def union(*gazetteers: DataFrame) -> DataFrame:
    out = gazetteers[0]
    for g in gazetteers[1:]:
        out = out.unionByName(g)
    return out.distinct()


def add_to_aliases(gaz: DataFrame) -> DataFrame:
    """Names that end in " to" are also found without; only where the shorter name isn't there yet."""
    short = gaz.filter(F.col("name").endswith(" to")).select(F.replace("name", F.lit(" to"), F.lit("")).alias("name"), "id", "kind", F.lit("alias").alias("source"))
    return gaz.unionByName(short.join(gaz.select("name").distinct(), "name", "left_anti")).distinct()


def add_lexicon(gaz: DataFrame, words: DataFrame, english: str = "english", others: tuple[str, ...] = ("french", "french_pretty")) -> DataFrame:
    """The identifiers of an English name also for its translations of more than one letter."""
    pairs = words.select(F.col(english).alias("name"), F.explode(F.array(*[F.trim(F.col(c)) for c in others])).alias("other")).filter(F.length("other") > 1)
    made = gaz.join(pairs, "name").select(F.col("other").alias("name"), "id", "kind", F.lit("lexicon").alias("source"))
    return gaz.unionByName(made).distinct()


def merge_synonyms(gaz: DataFrame, groups: DataFrame) -> DataFrame:
    """All names of one group (``group_id``, ``name``) get the union of their identifiers."""
    keyed = groups.select("group_id", F.lower(F.trim("name")).alias("name")).filter(F.col("name") != "").distinct()
    low = gaz.select(F.lower("name").alias("name"), "id", "kind")
    shared = keyed.join(low, "name").select("group_id", "id", "kind").distinct()
    made = keyed.join(shared, "group_id").select("name", "id", "kind", F.lit("glossary").alias("source"))
    return gaz.unionByName(made).distinct()


def ids_per_name(gaz: DataFrame) -> DataFrame:
    """name with its sorted identifiers."""
    return gaz.groupBy("name").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def name_per_id(gaz: DataFrame, order: str) -> DataFrame:
    """id with the name given last."""
    return gaz.groupBy("id").agg(F.max_by("name", order).alias("name"))


def dictionary(gaz: DataFrame, min_length: int = 3) -> DataFrame:
    """Phrases to look for: lower-case, of at least ``min_length`` letters, with their tokens."""
    rows = gaz.select(F.lower(F.trim("name")).alias("name"), "id", "kind").filter(F.length("name") >= min_length).distinct()
    rows = rows.withColumn("phrase", tokens(F.col("name"))).filter(F.size("phrase") > 0)
    return rows.select("name", "id", "kind", "phrase", F.size("phrase").alias("n"), F.get("phrase", F.lit(0)).alias("first"))


def coverage(gaz: DataFrame, groups: DataFrame, prefix: str) -> DataFrame:
    """Glossary names without any identifier of the wanted prefix: group, name and what ids there are."""
    named = groups.select("group_id", F.lower(F.trim("name")).alias("name")).filter(F.col("name") != "").distinct()
    low = gaz.select(F.lower("name").alias("name"), "id").distinct()
    seen = named.join(low, "name", "left").groupBy("group_id", "name").agg(
        F.coalesce(F.bool_or(F.col("id").startswith(prefix)), F.lit(False)).alias("covered"), F.array_join(F.array_sort(F.collect_set("id")), ",").alias("ids")
    )
    return seen.filter(~F.col("covered")).drop("covered")
