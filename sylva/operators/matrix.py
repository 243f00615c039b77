"""Sparse character matrices: long tables inside, text only at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions.names import symbol


def last_values(rows: DataFrame, order: str) -> DataFrame:
    """(taxon, character, value): the value given last."""
    return rows.groupBy("taxon", "character").agg(F.max_by("value", order).alias("value"))


def with_symbols(cells: DataFrame) -> DataFrame:
    """Each cell with the symbol of its value: A, B, ... in the order of the character's values.

    Distinct values are ranked, not cells: the window sees a character's values only.
    """
    values = cells.select("character", "value").distinct()
    ranked = values.withColumn("symbol", symbol(F.row_number().over(Window.partitionBy("character").orderBy("value"))))
    return cells.join(ranked, ["character", "value"]).select("taxon", "character", "value", "symbol")


def taxa_with(cells: DataFrame, least: int) -> DataFrame:
    """Cells of taxa that have at least ``least`` characters."""
    enough = cells.groupBy("taxon").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("taxon")
    return cells.join(enough, "taxon", "left_semi")


def matrix_rows(cells: DataFrame, missing: str = "?") -> DataFrame:
    """(taxon, states): one symbol per character, in the order of characters.

    The list of characters is one row of the size of the character set, not of the cells.
    """
    characters = cells.select("character").distinct().agg(F.array_sort(F.collect_list("character")).alias("all"))
    listed = characters.first()["all"]
    have = cells.groupBy("taxon").agg(F.map_from_entries(F.collect_list(F.struct("character", "symbol"))).alias("m"))
    cell = F.transform(F.array(*[F.lit(c) for c in listed]), lambda c: F.coalesce(F.col("m")[c], F.lit(missing)))
    return have.select("taxon", F.array_join(cell, "").alias("states"))


def nexus(cells: DataFrame) -> DataFrame:
    """(ord, line) of a NEXUS document: sorted taxa in labels and matrix alike."""
    spark = cells.sparkSession
    rows = matrix_rows(cells)
    characters = [r[0] for r in cells.select("character").distinct().orderBy("character").collect()]
    states = cells.select("character", "symbol", "value").distinct()
    per = {r[0]: r[1] for r in states.groupBy("character").agg(F.array_sort(F.collect_set(F.concat("symbol", F.lit("="), "value"))).alias("v")).collect()}
    clean = lambda c: F.regexp_replace(c, "[^\\p{L}\\p{N}]+", "_")
    ntax = rows.count()
    head = ["#NEXUS", "BEGIN TAXA;", f"DIMENSIONS NTAX={ntax};", "TAXLABELS"]
    mid = [";", "END;", "BEGIN CHARACTERS;", f"DIMENSIONS NCHAR={len(characters)};", 'FORMAT DATATYPE=STANDARD MISSING=? SYMBOLS="A~Z a~z";', "CHARSTATELABELS"]
    mid += [f"{i} '{c}' / {' '.join(per[c])}{',' if i < len(characters) else ''}" for i, c in enumerate(characters, 1)]
    mid += [";", "MATRIX"]
    place = F.row_number().over(Window.orderBy("taxon")).cast("long")  # one row per taxon of a document
    numbered = rows.withColumn("_n", place)
    step = 10**9
    lit = lambda lines, base: spark.createDataFrame([(base + i, s) for i, s in enumerate(lines)], "ord long, line string")
    labels = numbered.select((F.col("_n") + step).alias("ord"), clean(F.col("taxon")).alias("line"))
    body = numbered.select((F.col("_n") + 3 * step).alias("ord"), F.concat(clean(F.col("taxon")), F.lit(" "), "states").alias("line"))
    return lit(head, 0).unionByName(labels).unionByName(lit(mid, 2 * step)).unionByName(body).unionByName(lit([";", "END;"], 4 * step))
