"""Positions in the plane for the nodes of a graph, by stress majorisation over rows of pairs.

``pairs`` are rows (a, b, d): the distance that two nodes should have; any subset of all pairs
will do, so the work is linear in them.  Stress is the sum over pairs of (|x_a - x_b| - d)**2
/ d**2.  A round moves each node half the way to the weighted mean of where its partners want
it, which is the minimum of a function that lies above the stress and touches it at the present
positions; so stress never rises.  A round is two joins and one aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyquilt.operators.tables import dropped, written


def _directed(pairs: DataFrame) -> DataFrame:
    """(a, b, d, w) both ways; pairs that are null, of one node or not above 0 apart count nothing."""
    own = pairs.select("a", "b", F.col("d").cast("double").alias("d")).filter("a <> b AND d > 0")
    both = own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    return both.withColumn("w", 1 / (F.col("d") * F.col("d")))


def _met(pairs: DataFrame, at: DataFrame) -> DataFrame:
    """Directed pairs with both positions and their present distance."""
    p, q = at.select(F.col("node").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay")), at.select(F.col("node").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    met = pairs.join(p, "a").join(q, "b")
    gap = lambda c: (F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}"))
    return met.withColumn("now", F.sqrt(gap("x") + gap("y")))


def step(pairs: DataFrame, at: DataFrame) -> DataFrame:
    """(node, x, y) after one round; nodes without pairs stay, partners on one spot do not push each other."""
    push = F.when(F.col("now") > 0, F.col("d") / F.col("now")).otherwise(0.0)
    want = lambda c: F.sum(F.col("w") * (F.col(f"b{c}") + push * (F.col(f"a{c}") - F.col(f"b{c}")))) / F.sum("w")
    moved = _met(_directed(pairs), at).groupBy(F.col("a").alias("node")).agg(want("x").alias("_x"), want("y").alias("_y"))
    half = lambda c: F.coalesce((F.col(c) + F.col(f"_{c}")) / 2, F.col(c)).alias(c)
    return at.join(moved, "node", "left").select("node", half("x"), half("y"))


def layout(pairs: DataFrame, start: DataFrame, rounds: int) -> DataFrame:
    """(node, x, y) after ``rounds`` from the positions ``start``."""
    own, at = written(pairs.select("a", "b", "d")), written(start.select("node", "x", "y"))
    for _ in range(rounds):
        last, at = at, written(step(own, at))
        dropped(last)
    dropped(own)
    return at


def stress(pairs: DataFrame, at: DataFrame) -> DataFrame:
    """One row (stress)."""
    met = _met(_directed(pairs), at)
    return met.agg((F.coalesce(F.sum(F.col("w") * (F.col("now") - F.col("d")) * (F.col("now") - F.col("d"))), F.lit(0.0)) / 2).alias("stress"))


def align(at: DataFrame, target: DataFrame) -> DataFrame:
    """``at`` (node, x, y) turned, mirrored if that fits better, and moved onto ``target`` with the least squares, from sums over the nodes of both.

    Lengths stay.  Where the sums leave the turn open (one node, say), there is none.
    """
    both = at.join(target.select("node", F.col("x").alias("u"), F.col("y").alias("v")), "node")
    mean = both.agg(*[F.avg(c).alias(f"m{c}") for c in "xyuv"])  # one row
    own = both.join(F.broadcast(mean))
    x, y, u, v = (F.col(c) - F.col(f"m{c}") for c in "xyuv")
    sums = own.agg(F.sum(x * u + y * v).alias("c1"), F.sum(x * v - y * u).alias("s1"), F.sum(x * u - y * v).alias("c2"), F.sum(x * v + y * u).alias("s2"))
    size = lambda k: F.sqrt(F.col(f"c{k}") * F.col(f"c{k}") + F.col(f"s{k}") * F.col(f"s{k}"))
    flip = size(2) > size(1)
    r = F.when(flip, size(2)).otherwise(size(1))
    turn = sums.select(flip.alias("_flip"), F.when(r > 0, F.when(flip, F.col("c2")).otherwise(F.col("c1")) / r).otherwise(1.0).alias("_c"), F.when(r > 0, F.when(flip, F.col("s2")).otherwise(F.col("s1")) / r).otherwise(0.0).alias("_s"))
    every = at.join(F.broadcast(mean)).join(F.broadcast(turn))
    x, y = F.col("x") - F.col("mx"), F.when(F.col("_flip"), F.col("my") - F.col("y")).otherwise(F.col("y") - F.col("my"))
    return every.select("node", (F.col("_c") * x - F.col("_s") * y + F.col("mu")).alias("x"), (F.col("_s") * x + F.col("_c") * y + F.col("mv")).alias("y"))
