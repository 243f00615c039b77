"""Items that appear together: exact pair counts against a null that honours item frequency and basket size.

Names are found by a join of the text's tokens with the first tokens of the
names, so that names of any number are found wherever they stand, also one
inside another. Pairs are counted exactly, with partial counts before the
shuffle. The null is the bipartite configuration model of largest entropy: item
i lies in basket r with probability x_i y_r / (1 + x_i y_r), with x and y such
that the expected frequency of every item and the expected size of every basket
are the ones seen. Baskets of one size share y and items of one frequency share
x, so the fit needs only the number of items of each frequency and of baskets of
each size: both at most the root of twice the incidences, and nothing per item
or basket leaves the executors. Items that lie in every basket, and baskets that
hold every item, are certain and stand outside the fit.

Under the null a pair's count is a sum of independent trials. Its upper tail
(Poisson-binomial) is computed from the exact distribution, tilted so that the
count seen is its mean and turned over by a discrete Fourier transform, by the
same formula at every size. The false discovery rate is controlled over all
possible pairs; ranks come from range-partitioned rows with one offset per
partition, so no task sees all pairs.

Defined results: an item counts once per basket; an empty table has no pairs;
pairs that never occur together are not listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.session import cut
from sylva.tables import pick


def distinct_records(sentences: DataFrame, parts: list[str]) -> DataFrame:
    """One row per distinct combination of ``parts`` (null is a value of its own)."""
    return pick(sentences, parts).dropDuplicates()


def _pieces(text):  # noqa: ANN001, ANN202
    """Runs of letters, or single other characters, each with the blanks before it."""
    return F.regexp_extract_all(F.lower(text), F.lit("(\\s*(?:\\p{L}+|[^\\s\\p{L}]))"), F.lit(1))


def baskets_of_terms(records: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """``record, items``: for each record that holds any, the sorted ids of the terms that stand in
    its text, in any letter case and not next to another letter.

    ``terms``: ``term_id``, ``name``. ``record`` is a 128-bit hash of all columns of the record.
    A piece of text carries only as many following pieces as the longest name has.
    """
    named = pick(terms, ["term_id", "name"]).select(F.col("term_id").cast("string").alias("term_id"), F.lower(F.trim("name")).alias("name"))
    named = named.filter((F.col("name") != "") & F.col("term_id").isNotNull()).distinct().withColumn("_p", _pieces(F.col("name")))
    named = named.select("term_id", "name", F.size("_p").alias("n"), F.get("_p", F.lit(0)).alias("first"))
    longest = named.agg(F.max("n")).first()[0] or 1
    columns = [F.col(f"`{c}`") for c in records.columns]
    rid = F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))
    split = records.select(rid.alias("record"), _pieces(F.col(text)).alias("_p"))
    ahead = F.transform("_p", lambda t, i: F.struct(F.ltrim(t).alias("first"), F.slice("_p", i + 1, longest + 1).alias("ahead"), F.when(i > 0, F.get(F.col("_p"), i - 1)).alias("before")))
    placed = split.select("record", F.explode(ahead).alias("_w")).select("record", "_w.*")
    hit = placed.join(named, "first")
    letter = "\\p{L}"
    stands = F.ltrim(F.array_join(F.slice("ahead", F.lit(1), F.col("n")), "")) == F.col("name")
    # A name that begins or ends with another sign must not touch a letter either.
    free = ~(F.col("name").rlike(f"^(?!{letter})") & ~F.get("ahead", F.lit(0)).rlike("^\\s") & F.coalesce(F.col("before"), F.lit("")).rlike(f"{letter}$"))
    behind = F.coalesce(F.get("ahead", F.col("n")), F.lit(""))
    loose = ~(F.col("name").rlike(f"(?<!{letter})$") & behind.rlike(f"^{letter}"))
    return hit.filter(stands & free & loose).groupBy("record").agg(F.array_sort(F.collect_set("term_id")).alias("items"))


def pair_counts(baskets: DataFrame, items: str = "items") -> DataFrame:
    """(term_a, term_b, n_ab) with term_a < term_b, from sorted arrays of distinct items."""
    pairs = F.flatten(
        F.transform(F.col(items), lambda a, i: F.transform(F.slice(F.col(items), i + 2, F.size(F.col(items))), lambda b: F.struct(a.alias("term_a"), b.alias("term_b"))))
    )
    return baskets.filter(F.size(items) > 1).select(F.explode(pairs).alias("p")).groupBy("p.term_a", "p.term_b").agg(F.count("*").alias("n_ab"))


def _single(baskets: DataFrame) -> DataFrame:
    return baskets.select(F.explode("items").alias("term")).groupBy("term").agg(F.count("*").alias("k"))


def lift_table(baskets: DataFrame, n: int) -> DataFrame:
    """(term_a, term_b, n_ab, n_a, n_b, n): pairs with the counts of both items and of all ``n`` records."""
    single = _single(baskets)
    a = single.select(F.col("term").alias("term_a"), F.col("k").alias("n_a"))
    b = single.select(F.col("term").alias("term_b"), F.col("k").alias("n_b"))
    return pair_counts(baskets).join(a, "term_a").join(b, "term_b").withColumn("n", F.lit(n).cast("bigint"))


def fit_null(freqs: np.ndarray, items: np.ndarray, sizes: np.ndarray, baskets: np.ndarray, rounds: int = 100_000, close: float = 1e-11) -> tuple[np.ndarray, np.ndarray]:
    """x of each frequency and y of each basket size; ``items`` and ``baskets`` say how many there are of each.

    inf stands for what is certain. Raises if the fit doesn't settle within ``rounds``.
    """
    x, y = np.zeros(len(freqs)), np.zeros(len(sizes))
    f, s = freqs.astype(float).copy(), sizes.astype(float).copy()
    in_f, in_s = np.ones(len(f), bool), np.ones(len(s), bool)
    while True:  # what is certain is taken out; the rest is then a smaller table
        full_f = in_f & (f >= baskets[in_s].sum()) if in_s.any() else np.zeros(len(f), bool)
        if full_f.any():
            x[full_f] = np.inf
            in_f &= ~full_f
            s[in_s] -= items[full_f].sum()
        full_s = in_s & (s >= items[in_f].sum()) & (s > 0) if in_f.any() else np.zeros(len(s), bool)
        if full_s.any():
            y[full_s] = np.inf
            in_s &= ~full_s
            f[in_f] -= baskets[full_s].sum()
        if not full_f.any() and not full_s.any():
            break
    in_f, in_s = in_f & (f > 0), in_s & (s > 0)
    if not in_f.any() or not in_s.any():
        return x, y
    f, s, ni, nb = f[in_f], s[in_s], items[in_f].astype(float), baskets[in_s].astype(float)
    total = float((f * ni).sum())
    a, b = f / math.sqrt(total), s / math.sqrt(total)
    step = 1 << 22

    def over(u: np.ndarray, w: np.ndarray, many: np.ndarray) -> np.ndarray:
        """sum over k of many[k] w[k] / (1 + u[i] w[k]), in runs of bounded memory."""
        rows = max(1, step // max(1, len(w)))
        return np.concatenate([(many * w / (1 + np.outer(u[i : i + rows], w))).sum(axis=1) for i in range(0, len(u), rows)])

    for _ in range(rounds):
        new_a = f / over(a, b, nb)
        new_b = s / over(b, new_a, ni)
        moved = max(np.abs(new_a / a - 1).max(), np.abs(new_b / b - 1).max())
        a, b = new_a, new_b
        if moved < close:
            break
    else:
        raise RuntimeError(f"the null did not settle within {rounds} rounds (last step {moved:.2g})")
    x[in_f], y[in_s] = a, b
    return x, y


def probability(x: float | np.ndarray, y: np.ndarray) -> np.ndarray:
    """x y / (1 + x y); what is infinite is certain, also beside what has nothing left to give."""
    certain = np.isinf(x) | np.isinf(y)
    xy = np.where(np.isinf(x), 0.0, x) * np.where(np.isinf(y), 0.0, y)
    return np.where(certain, 1.0, xy / (1 + xy))


def log_upper_tail(q: np.ndarray, n: np.ndarray, seen: int) -> float:
    """log P(X >= seen) for a sum of n[k] trials of probability q[k] for each k.

    The tilted trials have their mean at ``seen`` where that is in the upper tail; their
    distribution is inverted on a window many deviations wide, where it is exact to rounding.
    """
    sure = q >= 1
    seen -= int(n[sure].sum())
    live = (q > 0) & ~sure
    q, n = q[live], n[live]
    if seen <= 0:
        return 0.0
    top = float(n.sum())
    if seen > top:
        return -math.inf
    if seen == top:
        return float((n * np.log(q)).sum())
    mean = float((n * q).sum())
    s, odds = 0.0, np.log(q) - np.log1p(-q)
    if seen > mean:
        lo, hi = 0.0, 1.0
        at = lambda z: float((n / (1 + np.exp(-np.clip(odds + z, -700, 700)))).sum())
        while at(hi) < seen:
            hi *= 2
        for _ in range(200):
            s = (lo + hi) / 2
            lo, hi = (s, hi) if at(s) < seen else (lo, s)
    t = 1 / (1 + np.exp(-np.clip(odds + s, -700, 700)))
    log_m = float((n * (np.log1p(-q) - np.log1p(-t))).sum())
    deviation = math.sqrt(float((n * t * (1 - t)).sum()))
    centre = seen if s > 0 else int(round(mean))
    width = 1 << max(6, math.ceil(math.log2(20 * deviation + 40)))
    start = centre - width // 2
    theta = 2 * math.pi * np.arange(width // 2 + 1) / width  # the other half is its mirror image
    log_phi = -1j * theta * start
    turn = np.exp(1j * theta) - 1
    for p, c in zip(t, n, strict=True):
        log_phi += c * np.log(1 + p * turn)
    mass = np.fft.irfft(np.conj(np.exp(log_phi)), width)
    j = start + np.arange(width)
    mass = np.where((j >= 0) & (j <= top), np.maximum(mass, 0.0), 0.0)
    upper = j >= seen
    tail = float((mass[upper] * np.exp(-s * (j[upper] - seen))).sum())
    if tail <= 0:
        return -math.inf
    return min(0.0, math.log(tail) + log_m - s * seen)


def _q_values(scored: DataFrame, possible: int, rate: float) -> DataFrame:
    """Benjamini-Hochberg over all possible pairs, without a task that sees all rows."""
    spark = scored.sparkSession
    parts = cut(scored.repartitionByRange(F.col("log10_p"), F.col("term_a"), F.col("term_b")).withColumn("_part", F.spark_partition_id()))
    before, offsets = 0, []
    for r in parts.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # one row per partition
        offsets.append((r["_part"], before))
        before += r["n"]
    offset = spark.createDataFrame(offsets, "_part int, _before long")
    order = Window.partitionBy("_part").orderBy("log10_p", "term_a", "term_b")
    ranked = parts.join(F.broadcast(offset), "_part").withColumn("_r", F.row_number().over(order) + F.col("_before"))
    ranked = cut(ranked.withColumn("_raw", F.least(F.lit(0.0), F.col("log10_p") + F.log10(F.lit(float(max(possible, 1)))) - F.log10("_r"))))
    least, later = 0.0, []
    for r in ranked.groupBy("_part").agg(F.min("_raw").alias("m")).orderBy(F.desc("_part")).collect():
        later.append((r["_part"], least))
        least = min(least, r["m"])
    back = Window.partitionBy("_part").orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranked.join(F.broadcast(spark.createDataFrame(later, "_part int, _later double")), "_part")
    out = out.withColumn("log10_q", F.least(F.min("_raw").over(back), F.col("_later")))
    return out.withColumn("surprising", F.col("log10_q") <= math.log10(rate))


def surprise(baskets: DataFrame, n: int, rate: float = 0.05) -> DataFrame:
    """Pairs found together with their counts, the expected count under the null, log10 of the tail,
    q-value over all possible pairs and whether they pass ``rate``.

    ``baskets``: the non-empty ones, read several times; ``n``: the number of all records.
    """
    spark = baskets.sparkSession
    single = cut(_single(baskets))
    by_freq = single.groupBy("k").agg(F.count("*").alias("items")).orderBy("k").collect()  # at most sqrt(2 * incidences) rows
    by_size = baskets.groupBy(F.size("items").alias("s")).agg(F.count("*").alias("c")).orderBy("s").collect()
    freqs, items = (np.array([r[i] for r in by_freq], float) for i in range(2))
    sizes, many = (np.array([r[i] for r in by_size if r["s"] > 0], float) for i in range(2))
    x, y = fit_null(freqs, items, sizes, many)
    sent = spark.sparkContext.broadcast((dict(zip(freqs.astype(int).tolist(), x.tolist(), strict=True)), y, many))
    kinds = int(items.sum())

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, ys, counts = sent.value
        names = ["term_a", "term_b", "n_ab", "n_a", "n_b", "expected", "log10_p"]
        for batch in batches:
            seen, na, nb = (batch.column(i).to_pylist() for i in (2, 3, 4))
            expected, logs = [], []
            known: dict[tuple[int, int, int], tuple[float, float]] = {}
            for k, i, j in zip(seen, na, nb, strict=True):
                got = known.get((k, i, j))
                if got is None:
                    q = probability(of[i], ys) * probability(of[j], ys)
                    got = known[k, i, j] = (float((q * counts).sum()), log_upper_tail(q, counts, k) / math.log(10))
                expected.append(got[0])
                logs.append(got[1])
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(5)], pa.array(expected, pa.float64()), pa.array(logs, pa.float64())], names=names)

    # Tails are costly and rows few: dealt out, whatever the size of the table.
    counted = lift_table(baskets, n).select("term_a", "term_b", "n_ab", "n_a", "n_b")
    counted = counted.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "term_a", "term_b")
    scored = counted.mapInArrow(tails, "term_a string, term_b string, n_ab bigint, n_a bigint, n_b bigint, expected double, log10_p double")
    out = _q_values(cut(scored), kinds * (kinds - 1) // 2, rate)
    return out.select(
        "term_a", "term_b", "n_ab", "n_a", "n_b", F.lit(n).cast("bigint").alias("n"), F.round("expected", 6).alias("expected"),
        F.round("log10_p", 4).alias("log10_p"), F.round("log10_q", 4).alias("log10_q"), "surprising",
    )
