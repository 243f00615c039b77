from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pytest

from sylva.llm import together as G


def test_baskets_and_pairs(spark):
    terms = spark.createDataFrame([("A", "fruit wall", "e"), ("B", "wall thick", "q"), ("C", "red", "q"), ("D", "a+b", "q"), (None, "thick", "q"), ("E", None, "q")], "term_id string, name string, kind string")
    rows = [("t", "Fruit wall thick, RED"), ("t", "Fruit wall thick, RED"), (None, "Fruit wall thick, RED"), ("u", "redder fruit walls; a+b red."), ("u", None), ("u", ""), ("v", "sparse text")]
    df = spark.createDataFrame(rows, "taxon string, description string")
    rec = G.distinct_records(df.filter("description is not null"), ["taxon", "description"])
    n = rec.count()
    assert n == 5
    b = G.baskets_of_terms(rec, "description", terms)
    assert sorted(list(r["items"]) for r in b.collect()) == [["A", "B", "C"], ["A", "B", "C"], ["C", "D"]]
    got = {(r["term_a"], r["term_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n"]) for r in G.lift_table(b, n).collect()}
    assert got == {("A", "B"): (2, 2, 2, 5), ("A", "C"): (2, 2, 3, 5), ("B", "C"): (2, 2, 3, 5), ("C", "D"): (1, 3, 1, 5)}
    assert G.surprise(b, n).count() == 4
    empty = G.baskets_of_terms(rec.limit(0), "description", terms)
    assert G.lift_table(empty, 0).count() == 0 and G.surprise(empty, 0).count() == 0
    assert G.baskets_of_terms(rec, "description", terms.limit(0)).count() == 0


def test_long_text(spark):
    terms = spark.createDataFrame([("A", "red"), ("B", "blue")], "term_id string, name string")
    df = spark.createDataFrame([("x " * 100000 + "red blue",)], "description string")
    assert G.pair_counts(G.baskets_of_terms(df, "description", terms)).first()["n_ab"] == 1


def test_more_names_than_any_limit(spark):
    """The former limit was 20,000 names; a name inside another is found too."""
    terms = spark.range(30_000).selectExpr("concat('T', id) as term_id", "concat('name', translate(cast(id as string), '0123456789', 'abcdefghij')) as name")
    terms = terms.unionByName(spark.createDataFrame([("X", "leaf"), ("Y", "leaf blade"), ("Z", "blade")], "term_id string, name string"))
    df = spark.createDataFrame([("namebjjjj leaf blade, nameca",), ("leaf",), ("nothing",)], "description string")
    b = G.baskets_of_terms(df, "description", terms)
    assert sorted(list(r["items"]) for r in b.collect()) == [["T19999", "T20", "X", "Y", "Z"], ["X"]]
    assert G.surprise(b, 3).count() == 10


def test_null_keeps_frequencies_and_sizes():
    freqs, items, sizes, many = np.array([50.0, 20, 5, 25]), np.ones(4), np.array([1.0, 2, 3]), np.array([40.0, 15, 10])
    x, y = G.fit_null(freqs, items, sizes, many)
    p = np.array([G.probability(v, y) for v in x])
    assert np.allclose((p * many).sum(axis=1), freqs, rtol=1e-6)
    assert np.allclose(p.sum(axis=0), sizes, rtol=1e-6)


def test_items_of_one_frequency_share_a_row():
    sizes, many = np.array([1.0, 2, 4]), np.array([10.0, 20, 5])
    x1, y1 = G.fit_null(np.array([12.0, 12, 12, 34]), np.ones(4), sizes, many)
    x2, y2 = G.fit_null(np.array([12.0, 34]), np.array([3.0, 1]), sizes, many)
    assert np.allclose(x1[[0, 3]], x2) and np.allclose(y1, y2)


def test_certain_items_and_baskets():
    """An item in every basket, and a basket with every item."""
    x, y = G.fit_null(np.array([5.0, 3, 2]), np.array([1.0, 1, 1]), np.array([1.0, 2, 3]), np.array([1.0, 3, 1]))
    assert np.isinf(x[0]) and np.isinf(y[2])
    p = np.array([G.probability(v, y) for v in x])
    assert np.allclose((p * [1, 3, 1]).sum(axis=1), [5, 3, 2]) and np.allclose(p.sum(axis=0), [1, 2, 3])
    x, y = G.fit_null(np.array([2.0]), np.array([1.0]), np.array([1.0]), np.array([2.0]))
    assert G.probability(x[0], y)[0] == 1
    with pytest.raises(RuntimeError, match="settle"):
        G.fit_null(np.array([50.0, 20, 5, 25]), np.ones(4), np.array([1.0, 2, 3]), np.array([40.0, 15, 10]), rounds=2)


def exact_tail(q, n, seen):
    dist = [1.0]
    for p, c in zip(q, n, strict=True):
        for _ in range(int(c)):
            dist = [(dist[i] if i < len(dist) else 0) * (1 - p) + (dist[i - 1] * p if i else 0) for i in range(len(dist) + 1)]
    return math.log(sum(dist[seen:]))


@pytest.mark.parametrize("seen", [1, 5, 12, 20, 35, 60, 120])
def test_tail_is_exact(seen):
    q, n = np.array([0.01, 0.05, 0.2]), np.array([300.0, 100, 50])
    assert G.log_upper_tail(q, n, seen) == pytest.approx(exact_tail(q, n, seen), rel=1e-8, abs=1e-10)


def test_tail_of_many_trials():
    """A binomial of a million trials against sums of log-gamma terms."""
    n, p, seen = 10**6, 1e-4, 160
    terms = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(seen, seen + 400)]
    assert G.log_upper_tail(np.array([p]), np.array([float(n)]), seen) == pytest.approx(max(terms) + math.log(sum(math.exp(t - max(terms)) for t in terms)), rel=1e-7)


def test_tail_limits():
    q, n = np.array([0.5]), np.array([3.0])
    assert G.log_upper_tail(q, n, 0) == 0.0
    assert G.log_upper_tail(q, n, 4) == -math.inf
    assert G.log_upper_tail(q, n, 3) == pytest.approx(math.log(0.125))
    assert G.log_upper_tail(np.array([1.0, 0.5]), np.array([2.0, 1.0]), 3) == pytest.approx(math.log(0.5))


def test_surprise_equals_brute(spark):
    """Expected counts, tails and false discovery rate against plain loops over items and baskets."""
    rnd = np.random.default_rng(3)
    sets = [sorted({f"i{int(k)}" for k in rnd.zipf(1.5, 4) if k <= 12}) for _ in range(200)] + [["i1", "i9"]] * 6
    sets = [s for s in sets if s]
    df = spark.createDataFrame([(s,) for s in sets], "items array<string>")
    got = {(r["term_a"], r["term_b"]): r for r in G.surprise(df, 300).collect()}
    names = sorted({i for s in sets for i in s})
    freq, size = np.array([sum(i in s for s in sets) for i in names], float), np.array([len(s) for s in sets], float)
    x, y = freq / math.sqrt(freq.sum()), size / math.sqrt(freq.sum())
    for _ in range(20000):  # every item and every basket on its own
        x = freq / (y / (1 + np.outer(x, y))).sum(axis=1)
        y = size / (x[:, None] / (1 + np.outer(x, y))).sum(axis=0)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    tails = {}
    for a, b in itertools.combinations(range(len(names)), 2):
        k = sum(names[a] in s and names[b] in s for s in sets)
        pair = tuple(sorted((names[a], names[b])))
        assert (pair in got) == (k > 0)
        if k:
            q = p[a] * p[b]
            tails[pair] = exact_tail(q, np.ones(len(q)), k) / math.log(10)
            assert got[pair]["n_ab"] == k and got[pair]["expected"] == pytest.approx(q.sum(), rel=1e-4, abs=1e-5)
            assert got[pair]["log10_p"] == pytest.approx(tails[pair], rel=1e-3, abs=2e-4)
    m, least = len(names) * (len(names) - 1) / 2, 0.0
    order = sorted(tails, key=lambda t: (got[t]["log10_p"], t))
    for r in range(len(order), 0, -1):
        least = min(least, tails[order[r - 1]] + math.log10(m) - math.log10(r))
        assert got[order[r - 1]]["log10_q"] == pytest.approx(least, abs=2e-3)
        assert got[order[r - 1]]["surprising"] == (got[order[r - 1]]["log10_q"] <= math.log10(0.05))


def test_matching_equals_regex(spark):
    names = {"A": "leaf", "B": "old leaf margin", "C": "été", "D": "b.c", "E": "+x", "F": "leaf margin", "G": "9"}
    texts = ["Leaf, leaflet; old leaf margin", "ÉTÉ b.c bxc", "leaf-margin", "9leaf9", "old  leaf margin", "étéé", "a+x", "a +x", "+xy", "b.cd 9 99"]
    terms = spark.createDataFrame(list(names.items()), "term_id string, name string")
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = sorted(tuple(r["items"]) for r in G.baskets_of_terms(df, "t", terms).collect())
    want = [tuple(k for k, n in names.items() if re.search(rf"(?<![^\W\d_]){re.escape(n)}(?![^\W\d_])", t.lower())) for t in texts]
    assert got == sorted(w for w in want if w)
