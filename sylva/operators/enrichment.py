"""Tables for enrichment tests, their results, and the hypergeometric test itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def membership(phenotypes: DataFrame, environments: DataFrame) -> DataFrame:
    """(phenotype, taxon, env, member): for each phenotype every taxon's environments, 1 if the taxon has it.

    ``phenotypes``: taxon, phenotype; ``environments``: taxon, env. The result is
    this large by definition; the list of phenotypes is exploded into each row
    when it is small enough, so no cross join is planned.
    """
    have = phenotypes.select("taxon", "phenotype").distinct().withColumn("_m", F.lit(1))
    listed = phenotypes.select("phenotype").distinct().agg(F.array_sort(F.collect_list("phenotype"))).first()[0] or []
    grid = environments.select("taxon", "env").distinct().select("taxon", "env", F.explode(F.array(*[F.lit(p) for p in listed]) if listed else F.array().cast("array<string>")).alias("phenotype"))
    return grid.join(have, ["taxon", "phenotype"], "left").select("phenotype", "taxon", "env", F.coalesce("_m", F.lit(0)).alias("member"))


def significant(results: DataFrame, level: float = 0.05) -> DataFrame:
    """Rows over or under represented at the level."""
    return results.filter((F.col("over") < level) | (F.col("under") < level))


def enriched_counts(results: DataFrame, level: float = 0.05) -> DataFrame:
    """(group, n_over, n_under) of the significant rows."""
    return results.groupBy("group").agg(F.count_if(F.col("over") < level).alias("n_over"), F.count_if(F.col("under") < level).alias("n_under"))


def labelled(rows: DataFrame, names: DataFrame, key: str, out: str) -> DataFrame:
    """Rows with the name of ``key`` as ``out``; null if unknown. ``names``: id, name."""
    return rows.join(names.select(F.col("id").alias(key), F.col("name").alias(out)), key, "left")


def hypergeometric(counts: DataFrame) -> DataFrame:
    """Adds ``over`` and ``under``: P(X >= k) and P(X <= k) for k of n drawn, K marked among N.

    ``counts``: k, n, marked, total. Sums of log-gamma terms, vectorised by batch.
    """
    import math
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql import types as T

    schema = T.StructType([*counts.schema.fields, T.StructField("over", T.DoubleType()), T.StructField("under", T.DoubleType())])

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            over, under = [], []
            for k, n, m, t in zip(b["k"], b["n"], b["marked"], b["total"], strict=True):
                whole = log_choose(t, n)
                lo, hi = max(0, n + m - t), min(n, m)
                p = [math.exp(log_choose(m, i) + log_choose(t - m, n - i) - whole) for i in range(lo, hi + 1)]
                over.append(min(1.0, sum(p[max(0, k - lo) :])))
                under.append(min(1.0, sum(p[: k - lo + 1])))
            yield b.assign(over=over, under=under)

    return counts.mapInPandas(run, schema)
