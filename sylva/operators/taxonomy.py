"""Rank names carried down ordered records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks from highest to lowest.
RANKS = ("family", "subfamily", "tribe", "genus", "subgenus", "section", "species", "subspecies", "variety", "form")


def forward_fill(df: DataFrame, part: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each column filled with its last value that isn't null, plainly."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select("*", *[F.last(c, ignorenulls=True).over(w).alias(f"{c}_filled") for c in columns])


def fill_ranks(df: DataFrame, part: list[str], order: list[str], ranks: list[str], keep_stale: bool = False) -> DataFrame:
    """Rank columns, highest first, filled downwards. A new name at one rank clears the lower
    ranks; with ``keep_stale`` they stay, as in a plain fill."""
    if keep_stale:
        return forward_fill(df, part, order, ranks)
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df
    for i, r in enumerate(ranks):
        higher: Column = reduce(lambda a, b: a | b, [F.col(h).isNotNull() for h in ranks[:i]], F.lit(False))
        out = out.withColumn(f"_era_{i}", F.sum(F.when(higher, 1).otherwise(0)).over(w))
        inner = Window.partitionBy(*part, f"_era_{i}").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn(f"{r}_filled", F.last(r, ignorenulls=True).over(inner))
    return out.drop(*[f"_era_{i}" for i in range(len(ranks))])


def inherit(rows: DataFrame, parent_rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The values of each row and of every row of a higher rank with the same ``keys``.

    ``rows``: keys, node, rank_pos; ``parent_rows``: keys, rank_pos, value. A range
    condition on the rank rides on the equi-join of the keys.
    """
    p = parent_rows.select(*keys, F.col("rank_pos").alias("_above"), value)
    return rows.join(p, keys).filter(F.col("_above") <= F.col("rank_pos")).select(*keys, "node", value).distinct()
