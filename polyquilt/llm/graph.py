"""Connected components as DataFrame rounds: alternating large-star and small-star.

Nothing is collected; each round's edges are written to the shared folder.  Edges that
are stars already, each pointing to its least member, need no round, and a component of
any size settles in a number of rounds that is logarithmic in its diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyquilt.llm import common


#: Edges for which a task is worth while.
EDGES = 1 << 17


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u's neighbours.  The rebalanced side lets a hub's rows be split in the join."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).hint("rebalance")
    return edges.join(least.hint("merge"), "u")


def _stars(edges: DataFrame) -> bool:
    """Whether the edges (u > v) are settled: each u has one v, which is no other edge's u."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.node", "e.up")
    ends = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return not ends.agg(F.max((F.col("ups") > 1) | (F.col("ups") > 0) & (F.col("least") == 0))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the undirected edges (a, b); component is the least node reachable.

    Edges with a null end, loops and repeated edges are allowed and add nothing; no edges give no rows.
    """
    e = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    n = edges.count()  # no round makes more edges than there are; edges come as a table, which tells its rows
    e = common.cut(common.few(e, n, EDGES), sweep=False)
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u <> v").distinct()
        near = _with_least(large)
        small = near.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        last, e = e, common.cut(common.few(small, 2 * n, EDGES), sweep=False)
        common.free(last)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def merged(found: DataFrame | None, edges: DataFrame) -> DataFrame:
    """The components that ``found`` (node, component; None at first) and more ``edges`` (a, b) give together, as a table.

    Only what the edges join is worked on: they are contracted to the components of their ends first.
    """
    if found is None:
        return common.cut(common.few(components(edges), 2 * edges.count(), EDGES))
    ends = edges
    for end in ("a", "b"):
        known = found.toDF(end, "_component").hint("merge")
        ends = ends.join(known, end, "left").withColumn(end, F.coalesce("_component", end)).drop("_component")
    ends = common.cut(common.few(ends.filter("a <> b").distinct(), edges.count(), EDGES), sweep=False)
    if not (n := ends.count()):
        return found
    moved = common.cut(common.few(components(ends), 2 * n, EDGES), sweep=False)
    old = found.join(moved.toDF("component", "_to").hint("merge"), "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    new = moved.join(found.select("node").hint("merge"), "node", "left_anti")
    out = common.cut(common.few(old.unionByName(new), found.count() + 2 * n, EDGES))
    common.free(ends, moved, found)
    return out
