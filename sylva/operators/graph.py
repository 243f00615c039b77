"""Short paths between words, and ancestors in term hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.session import cut


def token_chain(token_rows: DataFrame, key: str) -> DataFrame:
    """Edges from each token to the next; stands in where no dependency edges are given."""
    w = Window.partitionBy(key).orderBy("pos")
    return token_rows.select(key, F.col("pos").alias("gov"), F.lead("pos").over(w).alias("dep")).filter(F.col("dep").isNotNull())


def within_hops(edges: DataFrame, key: str, starts: DataFrame, hops: int = 2) -> DataFrame:
    """``key, src, dst, dist``: the least directed distance, up to ``hops`` edges, from each start.

    ``edges``: key, gov, dep; ``starts``: key, src. Unweighted paths of bounded
    length are joins; all-pairs shortest paths aren't needed.
    """
    e = edges.select(key, F.col("gov").alias("at"), F.col("dep").alias("next"))
    level = starts.select(key, "src").distinct().select(key, "src", F.col("src").alias("at"))
    out = level.select(key, "src", F.col("at").alias("dst"), F.lit(0).alias("dist"))
    for d in range(1, hops + 1):
        level = level.join(e, [key, "at"]).select(key, "src", F.col("next").alias("at")).distinct()
        out = out.unionByName(level.select(key, "src", F.col("at").alias("dst"), F.lit(d).alias("dist")))
    return out.groupBy(key, "src", "dst").agg(F.min("dist").alias("dist"))


def vertices_of(token_rows: DataFrame, key: str, hits: DataFrame, min_length: int = 3) -> DataFrame:
    """Vertices whose word contains a matched name of its text, or is contained in it."""
    both = token_rows.filter(F.length("term") >= min_length).join(hits.select(key, "name", "id", "kind").distinct(), key)
    return both.filter((F.instr(F.col("term"), F.col("name")) > 0) | (F.instr(F.col("name"), F.col("term")) > 0)).select(key, "pos", "name", "id", "kind")


def closure(edges: DataFrame, max_depth: int = 64, reflexive: bool = False) -> DataFrame:
    """``child, ancestor, depth``: every pair of the hierarchy with its least depth.

    Semi-naive: each round joins only the pairs found last, new ones alone go on,
    so a cycle ends. Rounds are cut by a checkpoint.
    """
    e = cut(edges.select("child", "parent").filter("child is not null and parent is not null and child <> parent").distinct())
    found = e.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    fresh = found
    for depth in range(2, max_depth + 1):
        step = fresh.select("child", F.col("ancestor").alias("_at")).join(e.select(F.col("child").alias("_at"), "parent"), "_at")
        step = step.select("child", F.col("parent").alias("ancestor")).filter("child <> ancestor").distinct()
        fresh = cut(step.join(found.select("child", "ancestor"), ["child", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)))
        if fresh.isEmpty():
            break
        found = cut(found.unionByName(fresh))
    if reflexive:
        nodes = e.select(F.col("child").alias("n")).union(e.select("parent")).distinct()
        found = found.unionByName(nodes.select(F.col("n").alias("child"), F.col("n").alias("ancestor"), F.lit(0).alias("depth")))
    return found


def nearest(nodes: DataFrame, edges: DataFrame, targets: DataFrame, max_depth: int = 64) -> DataFrame:
    """``node, target, depth``: the nearest wanted ancestor of each node, the node itself if wanted.

    The search of each node is its own and stops below the first target met on a
    path; ties go to the smallest identifier.
    """
    t = cut(targets.select(F.col("id").alias("at")).distinct())
    e = cut(edges.select(F.col("child").alias("at"), "parent").filter("at is not null and parent is not null").distinct())
    front = nodes.select("node").distinct().select("node", F.col("node").alias("at"))
    seen = front
    hits: DataFrame | None = None
    for depth in range(max_depth + 1):
        hit = front.join(t, "at", "left_semi").select("node", F.col("at").alias("target"), F.lit(depth).alias("depth"))
        hits = hit if hits is None else hits.unionByName(hit)
        go = front.join(t, "at", "left_anti").join(hits.select("node").distinct(), "node", "left_anti")
        new = go.join(e, "at").select("node", F.col("parent").alias("at")).distinct().join(seen, ["node", "at"], "left_anti")
        front = cut(new)
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
        hits = cut(hits)
    best = hits.groupBy("node").agg(F.min(F.struct("depth", "target")).alias("b"))
    return best.select("node", F.col("b.target").alias("target"), F.col("b.depth").alias("depth"))
