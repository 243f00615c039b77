"""Queries p2, p3, p4 and p5 over whole tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.operators import packed, rejects, shred, units
from sylva.tables import once, spread, table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Alternative names of each glossary row, one per row, where there are two or more."""
    return packed.unpack(table(spark, folder, "vocab"), "names", ["vocab_id"], "name_value", "pos", min_values=2)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that fail to parse, with the first reason."""
    return rejects.parse_lines(table(spark, folder, "fdac_lines"), "line", ["line_id"]).filter(F.col("reason").isNotNull()).select("line_id", "reason")


def p3_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The lines that parse, as typed rows."""
    good, _ = rejects.split_rejects(rejects.parse_lines(table(spark, folder, "fdac_lines"), "line", ["line_id"]))
    return good


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every number that states a length or a mass, in µm or µg."""
    raw = table(spark, folder, "accounts")
    rows = once(raw, "account_id", ["description", "habitat"])
    return units.quantities(spread(rows, raw), ["description", "habitat"], ["account_id"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of nom, name, feature and char with the links to their parents."""
    raw = table(spark, folder, "treatments")
    return shred.shred(spread(once(raw, "treatment_id", ["body"]), raw), "body", ["treatment_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_loaded": p3_loaded,
    "p4_found": p4_found,
    "p5_found": p5_found,
}

_P3_FIELDS = r"""
lines AS (
  SELECT line_id, coalesce(line, '') AS line,
    regexp_full_match(coalesce(line, ''), '(?s)(?:(?:\s*"(?:[^"]|"")*"\s*|\s*(?:[^"\s|][^|]*)?)\|)*(?:\s*"(?:[^"]|"")*"\s*|\s*(?:[^"\s|][^|]*)?)') AS closed
  FROM fdac_lines),
cut AS (
  SELECT *, CASE WHEN closed THEN regexp_extract_all(line || '|', '(?s)((?:\s*"(?:[^"]|"")*"\s*|[^|]*))\|', 1) ELSE [] END AS raw FROM lines),
f AS (
  SELECT *, list_transform(raw, lambda x: trim(replace(regexp_replace(trim(x, E' \t\r\n'), '(?s)^"(.*)"$', '\1'), '""', '"'), E' \t\r\n')) AS v FROM cut),
g AS (
  SELECT *, CASE WHEN NOT closed THEN 'broken_quote' WHEN len(v) <> 22 THEN 'column_count'
    WHEN NOT (regexp_full_match(v[1], '[0-9]+') AND try_cast(v[1] AS DOUBLE) > 0 AND v[3] <> '')
      OR NOT (v[9] = '' OR regexp_full_match(v[9], '[0-9]{4}') AND try_cast(v[9] AS DOUBLE) BETWEEN 1700 AND 2026)
      OR NOT (v[10] = '' OR regexp_full_match(v[10], '[0-9]+') AND try_cast(v[10] AS DOUBLE) > 0)
      OR NOT (v[11] = '' OR regexp_full_match(v[11], '[0-9]+') AND try_cast(v[11] AS DOUBLE) > 0)
      OR NOT (v[15] = '' OR regexp_full_match(v[15], '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(v[15] AS DATE) IS NOT NULL)
      OR NOT (v[16] = '' OR regexp_full_match(v[16], '[+-]?[0-9]+(\.[0-9]+)?') AND try_cast(v[16] AS DOUBLE) BETWEEN -90 AND 90)
      OR NOT (v[17] = '' OR regexp_full_match(v[17], '[+-]?[0-9]+(\.[0-9]+)?') AND try_cast(v[17] AS DOUBLE) BETWEEN -180 AND 180)
      OR NOT (v[18] = '' OR regexp_full_match(v[18], '[+-]?[0-9]+(\.[0-9]+)?') AND try_cast(v[18] AS DOUBLE) BETWEEN -500 AND 9000)
      OR NOT (v[19] = '' OR regexp_full_match(v[19], '[0-9]+') AND try_cast(v[19] AS DOUBLE) BETWEEN 1 AND 12)
      OR NOT (v[20] = '' OR regexp_full_match(v[20], '[0-9]+') AND try_cast(v[20] AS DOUBLE) BETWEEN 1 AND 12)
    THEN 'bad_value' END AS reason FROM f)
"""

SQL: dict[str, str] = {
    "p2_found": r"""
WITH pieces AS (
  SELECT vocab_id, list_filter(list_transform(
    regexp_extract_all(names, '(?s)(?:"(?:[^"]|"")*"|“[^”]*”|\([^()]*\)|\[[^\[\]]*\]|[0-9]+(?:[,/][0-9]+)+|[^;,/|=\t\n\r•、；，])+'),
    lambda x: trim(x, E' \t\r\n')), lambda x: x <> '') AS v
  FROM vocab WHERE names IS NOT NULL)
SELECT vocab_id, CAST(i - 1 AS INTEGER) AS pos,
  CASE WHEN regexp_full_match(v[i], '(?s)"(?:[^"]|"")*"') THEN replace(v[i][2:-2], '""', '"')
       WHEN regexp_full_match(v[i], '(?s)“[^“”]*”') THEN v[i][2:-2] ELSE v[i] END AS name_value
FROM (SELECT vocab_id, v, unnest(range(1, len(v) + 1)) AS i FROM pieces WHERE len(v) >= 2)
""",
    "p3_found": f"WITH {_P3_FIELDS} SELECT line_id, reason FROM g WHERE reason IS NOT NULL",
    "p3_loaded": "WITH "
    + _P3_FIELDS
    + " SELECT line_id, "
    + ", ".join(
        {
            "text": "nullif(v[{i}], '')", "whole": "try_cast(nullif(v[{i}], '') AS BIGINT)",
            "decimal": "try_cast(nullif(v[{i}], '') AS DOUBLE)", "date": "try_cast(nullif(v[{i}], '') AS DATE)",
        }[f.kind].format(i=i)
        + f" AS {f.name}"
        for i, f in enumerate(rejects.DESCRIPTION_FIELDS, 1)
    )
    + " FROM g WHERE reason IS NULL",
}
