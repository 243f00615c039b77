from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sylva.llm import mixing

pytest.importorskip("tiktoken")
import os  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isfile(mixing.DEFAULT_TOKENIZER), reason="vocabulary is not here")


def tables(spark, n=400):
    rows = [(i, f"word{i} " * (5 + i % 7), "Big_Source " if i % 4 else " small source") for i in range(n)]
    rows += [(9001, rows[1][1], "big source"), (9002, "lost text", None), (9003, "other text", "unlisted"), (9004, None, "big source"), (9005, "", "big source")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("SHARE", F.lit(1))
    targets = spark.createDataFrame([("big source", 0.4, 1), ("small_source", 0.5, 5), ("empty", 0.1, 2), (None, 0.1, 1), ("none", None, None)], "source string, target_share double, max_repeats int")
    return docs, targets


def test_shares_caps_and_copies(spark):
    docs, targets = tables(spark)
    plan = mixing.Plan(docs, targets)
    chosen = plan.chosen(block=37)
    got = {r["doc_id"]: r for r in chosen.collect()}
    assert not {9001, 9002, 9003, 9004, 9005} & set(got)
    assert max(r["repeats"] for r in got.values() if r["source"] == "big source") == 1
    assert max(r["repeats"] for r in got.values()) <= 5
    rep = {r["source"]: r for r in plan.report(chosen).collect()}
    assert set(rep) == {"big source", "small_source", "empty", "none"}
    assert rep["small_source"]["actual_share"] / rep["big source"]["actual_share"] == pytest.approx(0.5 / 0.4, rel=0.02)
    assert rep["empty"]["actual_share"] == 0 and rep["empty"]["capped"]


def test_larger_total_is_capped(spark):
    docs, targets = tables(spark)
    plan = mixing.Plan(docs, targets, total_tokens=10**9)
    chosen = plan.chosen()
    assert {r["repeats"] for r in chosen.filter("source = 'small_source'").collect()} == {5}
    assert all(r["capped"] for r in plan.report(chosen).collect() if r["target_share"] > 0)


def test_positions_follow_schedule(spark):
    docs, targets = tables(spark, 2000)
    plan = mixing.Plan(docs, targets)
    order = plan.schedule(plan.chosen())
    got = [tuple(r) for r in order.select("position", "source", "n_tokens", "doc_id", "use_no").collect()]
    assert [g[0] for g in got] == sorted(g[0] for g in got) and 0 <= got[0][0] and got[-1][0] <= 1
    assert len({g[3:] for g in got}) == len(got)
    for p in plan.sources:
        if not p["tokens"]:
            continue
        total = sum(g[2] for g in got if g[1] == p["source"])
        half = sum(g[2] for g in got if g[1] == p["source"] and g[0] <= 0.5)
        assert half / total == pytest.approx(0.5 + p["ramp"] * (0.25 - 0.5), abs=0.03)


def test_empty(spark):
    docs, targets = tables(spark, 8)
    plan = mixing.Plan(docs.limit(0), targets)
    assert plan.chosen().count() == 0 and plan.schedule(plan.chosen()).count() == 0
    assert {r["actual_share"] for r in plan.report(plan.chosen()).collect()} == {0.0}
    none = mixing.Plan(docs, targets.limit(0))
    assert none.chosen().count() == 0 and none.report(none.chosen()).count() == 0


def test_long_text(spark):
    docs = spark.createDataFrame([(1, "long text " * 50000, "a")], "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mixing.Plan(docs, t).chosen().first()["n_tokens"] > 50000
