"""Queries p1, p6, p7, p8, p9 and p10 over whole tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm import canon, leaks, mixing, mojibake, sentences, together
from sylva.session import cut
from sylva.tables import once, spread, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of every description and habitat, with their places."""
    raw = table(spark, folder, "accounts")
    columns = ["description", "habitat"]
    model = sentences.train(raw, columns, "account_id")
    return sentences.sentences(spread(once(raw, "account_id", columns), raw), columns, ["account_id"], model)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The trait each typed character class means."""
    rows = once(table(spark, folder, "class_entries"), "entry_id", ["cclass"]).filter(F.trim(F.regexp_replace("cclass", "\\s+", " ")) != "")
    mapped = canon.map_to_list(rows, "cclass", canon.reference_entries(table(spark, folder, "trait_terms")))
    return rows.join(mapped, rows["cclass"] == mapped["value"]).select("entry_id", F.col("goal").alias("term_id"))


def _baskets(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """The non-empty baskets, and the number of records."""
    rows = table(spark, folder, "sentences").select("taxon", "description").filter(F.col("description").isNotNull())
    records = cut(together.distinct_records(rows, ["taxon", "description"]))
    return cut(together.baskets_of_terms(records, "description", table(spark, folder, "term_list"))), records.count()


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of terms, scored against the null, that are found together at least five times and three times as often as chance."""
    t = together.surprise(*_baskets(spark, folder))
    return t.filter((F.col("n_ab") >= 5) & (F.col("n_ab") * F.col("n") >= 3 * F.col("n_a") * F.col("n_b"))).select("term_a", "term_b")


def p7_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of terms found together, with the counts that lift needs."""
    return together.lift_table(*_baskets(spark, folder))


def p7_surprise(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair found together, against the configuration null."""
    return together.surprise(*_baskets(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold twelve or more consecutive words of a test item."""
    return leaks.find_leaks(spread(table(spark, folder, "documents").select("doc_id", "text")), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen documents with their repeat counts."""
    plan = mixing.Plan(spread(table(spark, folder, "documents").select("doc_id", "source", "text")), table(spark, folder, "mix_targets"))
    return plan.chosen().select("doc_id", "source", "n_tokens", "repeats")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of every source."""
    plan = mixing.Plan(spread(table(spark, folder, "documents").select("doc_id", "source", "text")), table(spark, folder, "mix_targets"))
    return plan.report(plan.chosen())


def p9_order(spark: SparkSession, folder: str) -> DataFrame:
    """Every use of a chosen document at its training position."""
    plan = mixing.Plan(spread(table(spark, folder, "documents").select("doc_id", "source", "text")), table(spark, folder, "mix_targets"))
    return plan.schedule(plan.chosen())


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold wrongly decoded text, with the MD5 of the restored text."""
    return mojibake.restore(spread(table(spark, folder, "documents").select("doc_id", "text")), "text", ["doc_id"], md5="restored_md5")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_counts": p7_counts,
    "p7_surprise": p7_surprise,
    "p8_found": p8_found,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_order": p9_order,
    "p10_found": p10_found,
}

_PAIRS = r"""
records AS (
  SELECT row_number() OVER () AS r, lower(description) AS d, ' ' || regexp_replace(lower(description), '[^\p{L}]', ' ', 'g') || ' ' AS padded
  FROM (SELECT DISTINCT taxon, description FROM sentences WHERE description IS NOT NULL)),
names AS (SELECT term_id, lower(trim(name)) AS nm, ' ' || regexp_replace(lower(trim(name)), '[^\p{L}]', ' ', 'g') || ' ' AS padded FROM term_list),
found AS (SELECT r, term_id FROM records, names WHERE contains(records.padded, names.padded) AND contains(d, nm)),
single AS (SELECT term_id, count(*) AS k FROM found GROUP BY 1),
pairs AS (SELECT a.term_id AS term_a, b.term_id AS term_b, count(*) AS n_ab FROM found a JOIN found b ON a.r = b.r AND a.term_id < b.term_id GROUP BY 1, 2),
counts AS (
  SELECT term_a, term_b, n_ab, x.k AS n_a, y.k AS n_b, (SELECT count(*) FROM records) AS n
  FROM pairs JOIN single x ON x.term_id = term_a JOIN single y ON y.term_id = term_b)
"""

SQL: dict[str, str] = {
    "p7_found": f"WITH {_PAIRS} SELECT term_a, term_b FROM counts WHERE n_ab >= 5 AND n_ab * n >= 3 * n_a * n_b",
    "p7_counts": f"WITH {_PAIRS} SELECT * FROM counts",
    "p8_found": r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(replace(lower(strip_accents(text)), 'ß', 'ss'), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
item_words AS (
  SELECT item_id, regexp_extract_all(replace(lower(strip_accents(text)), 'ß', 'ss'), '[\p{L}\p{N}]+') AS w FROM eval_items),
item_spans AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM item_words)),
doc_spans AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM doc_words))
SELECT DISTINCT doc_id, item_id FROM doc_spans JOIN item_spans USING (s)
""",
}
