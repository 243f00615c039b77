"""Reading the tables of a folder, and small helpers shared by operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def position(df: DataFrame, name: str) -> int:
    """The place of a column: by exact name, else ignoring case; the first of several."""
    names = df.columns
    for i, c in enumerate(names):
        if c == name:
            return i
    for i, c in enumerate(names):
        if c.lower() == name.lower():
            return i
    raise KeyError(f"no column {name!r} among {names}")


def pick(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Just these columns, whatever other columns there are and however their names clash."""
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_{position(df, n)}").alias(n) for n in names])


def inputs(df: DataFrame, keep: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """The kept columns as ``k0, k1, ...`` and the texts as strings ``t0, t1, ...``."""
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    kept = [F.col(f"_{position(df, n)}").alias(f"k{i}") for i, n in enumerate(keep)]
    return flat.select(*kept, *[F.col(f"_{position(df, n)}").cast("string").alias(f"t{i}") for i, n in enumerate(texts)])


def kinds(df: DataFrame, keep: Sequence[str]) -> dict[str, T.DataType]:
    """The types of the kept columns."""
    return {n: df.schema.fields[position(df, n)].dataType for n in keep}


def once(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row per ``key`` (deliveries repeated under one key hold the same content);
    rows without a key are told apart by their content.

    Partial aggregation runs before the shuffle, so a key that holds a large
    part of all rows reaches its reducer as one row per map task.
    """
    rest = [c for c in columns if c != key]
    content = F.when(F.col(f"`{key}`").isNull(), F.xxhash64(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(0))
    return pick(df, [key, *rest]).withColumn("_content", content).dropDuplicates([key, "_content"]).drop("_content")


def spread(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Rows dealt out to all cores ahead of costly work per row, where the source has fewer splits than there are cores.

    A source that small is cheap to shuffle; larger ones have splits enough and are
    left alone. ``source``: the plain scan to judge by, if ``df`` isn't one.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = (source if source is not None else df).rdd.getNumPartitions()
    return df.repartition(cores) if splits < cores else df


def names_apart(kept: Iterable[str], produced: Iterable[str]) -> dict[str, str]:
    """New names for kept input columns; one that clashes with an output column
    (in any letter case) gets the suffix ``_in``, repeated as often as needed."""
    taken = {p.lower() for p in produced}
    out: dict[str, str] = {}
    for k in kept:
        name = k
        while name.lower() in taken:
            name += "_in"
        taken.add(name.lower())
        out[k] = name
    return out


def quoted(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")
