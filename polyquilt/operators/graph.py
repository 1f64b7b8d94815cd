"""G1, G4 and G11 on graphs that are tables: partition refinement to its fixpoint, components, distances.

Edges are undirected rows (a, b), repeated ones and loops allowed, null ends ignored.  Each
round is a few joins and partial aggregations over written tables; nothing is collected but
whether a round changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from polyquilt.operators.tables import dropped, numbered, written


def _ends(edges: DataFrame) -> DataFrame:
    """(u, v) both ways."""
    own = edges.filter("a IS NOT NULL AND b IS NOT NULL")
    return own.select(F.col("a").alias("u"), F.col("b").alias("v"), *own.columns[2:]).unionByName(own.select(F.col("b").alias("u"), F.col("a").alias("v"), *own.columns[2:]))


#: The largest primes below 2**31: two whole 64-bit numbers that differ agree by at most two of them.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563)


def _weights_into(near: DataFrame, moved: DataFrame) -> DataFrame:
    """(node, x): for each node whose weights of ``near`` (u, v, w) into the classes of ``moved`` (node, c) are not all 0, a fingerprint of them.

    Whole weights are taken times a hash of their neighbour's class and summed, modulo several
    primes: that is linear, so it needs no sums by class before, and any edges of one node add up map-side.
    Other weights are summed by class and hashed then.
    """
    if isinstance(near.schema["w"].dataType, IntegralType):
        met = near.join(moved.select(F.col("node").alias("v"), *[F.pmod(F.xxhash64(F.lit(k), "c"), F.lit(p)).alias(f"h{k}") for k, p in enumerate(PRIMES)]), "v")
        lanes = [F.pmod(F.sum(F.pmod(F.col("w"), F.lit(p)) * F.col(f"h{k}") % F.lit(p)), F.lit(p)).alias(f"x{k}") for k, p in enumerate(PRIMES)]
        seen = met.groupBy(F.col("u").alias("node")).agg(*lanes)
        return seen.filter(" OR ".join(f"x{k} <> 0" for k in range(len(PRIMES)))).select("node", F.array(*[f"x{k}" for k in range(len(PRIMES))]).alias("x"))
    met = near.join(moved.toDF("v", "to"), "v").groupBy("u", "to").agg(F.sum("w").alias("w")).filter("w <> 0")
    lane = lambda seed: F.sum(F.xxhash64(F.lit(seed), "to", "w").cast("decimal(38,0)"))
    return met.groupBy(F.col("u").alias("node")).agg(F.array(lane(1), lane(2)).alias("x"))


def refine(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, least, size): the coarsest partition of ``nodes`` (node, colour) that refines the colours and is stable under ``edges`` (a, b, w).

    Nodes of one class have, for each class, the same total weight of edges into it.  A class
    is named by its least node.  Null nodes are ignored, and a null colour is a colour.

    A round looks only at the neighbours of nodes whose class is new, and of these at members
    of classes of two or more.  Within a class they are split by their weights into the new
    classes; members without such a neighbour stay, else the largest part does.  What stays
    needs no look later: its weights are the rest of sums that were equal before.  Weights into
    the new classes are compared by fingerprints, see ``_weights_into``: two different ones are
    taken as equal with a chance of about 1e-46 a pair (1e-28 if they differ by multiples of two
    of the primes, 1e-38 if they are not whole numbers), and a hub's neighbours are aggregated, never listed.
    """
    way = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    near = edges.filter("a IS NOT NULL AND b IS NOT NULL").select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("e"), "w")
    near = written(near.select("e.u", "e.v", "w"))
    own = nodes.filter("node IS NOT NULL").select("node", "colour")
    first = own.groupBy("colour").agg(F.min("node").alias("k")).withColumnRenamed("colour", "_colour")
    named = lambda r, key: F.struct(F.lit(r).alias("r"), key.alias("k"))
    state = written(own.join(first, F.col("colour").eqNullSafe(F.col("_colour"))).select("node", named(0, F.col("k")).alias("c")))
    moved, r, seen_from = state, 0, None
    while not moved.isEmpty():
        r += 1
        sizes = state.groupBy("c").agg(F.count("*").alias("size")).filter("size > 1")
        undecided = written(state.join(sizes, "c"))
        n = undecided.count()
        if not n:
            break
        if seen_from is not None and 4 * n < seen_from:  # most nodes are classes of their own: their edges are left behind
            last, near = near, written(near.join(undecided.select(F.col("node").alias("u")), "u", "left_semi"))
            dropped(last)
            seen_from = n
        seen_from = seen_from or n
        touched = written(undecided.join(_weights_into(near, moved), "node"))
        parts = touched.groupBy("c", "x").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.first("size").alias("size"))
        whole = parts.groupBy("c").agg(F.sum("n").alias("met"), F.max(F.struct("n", "least")).alias("largest"))
        stays = (F.col("met") == F.col("size")) & (F.col("largest.least") == F.col("least"))
        split = written(parts.join(whole, "c").filter(~stays).select("c", "x", named(r, F.col("least")).alias("to")))
        if moved is not state:
            dropped(moved)
        last, moved = state, written(touched.join(split, ["c", "x"]).select("node", F.col("to").alias("c")))
        state = written(last.join(moved.withColumnRenamed("c", "_c"), "node", "left").select("node", F.coalesce("_c", "c").alias("c")))
        dropped(touched, split, undecided, last)
    dropped(near)
    own = state.groupBy("c").agg(F.min("node").alias("least"), F.count("*").alias("size"))
    return state.join(own, "c").select("node", "least", "size")


def class_numbers(classes: DataFrame) -> DataFrame:
    """(node, colour, size): dense numbers 0, 1, ... for the classes of ``refine`` in order of their least nodes."""
    order = numbered(classes.select("least").distinct(), [], [F.col("least")])
    return classes.join(order, "least").select("node", F.col("idx").alias("colour"), "size")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable from each node of ``nodes`` (node) by ``edges`` (a, b).

    Every node hooks onto its least neighbour if that is less, hooks are followed to their
    ends by doubling, and edges are contracted to the ends; rounds are logarithmic.
    """
    label = written(nodes.select("node").filter("node IS NOT NULL").distinct().withColumn("component", F.col("node")))
    rest = written(_ends(edges.select("a", "b")).filter("u <> v").distinct())
    while not rest.isEmpty():
        hooks = written(rest.groupBy("u").agg(F.min("v").alias("_v")).select(F.col("u").alias("node"), F.least("u", "_v").alias("to")))
        while True:
            ahead = hooks.select(F.col("node").alias("to"), F.col("to").alias("_next"))
            further = written(hooks.join(ahead, "to").select("node", F.col("_next").alias("to"), (F.col("_next") != F.col("to")).alias("_moved")))
            dropped(hooks)
            hooks = further
            if further.filter("_moved").isEmpty():
                break
        hooks = hooks.select("node", "to")
        last_label, last_rest = label, rest
        label = written(label.join(hooks.toDF("component", "_to"), "component", "left").select("node", F.coalesce("_to", "component").alias("component")))
        rest = written(rest.join(hooks.toDF("u", "_u"), "u").join(hooks.toDF("v", "_v"), "v").select(F.col("_u").alias("u"), F.col("_v").alias("v")).filter("u <> v").distinct())
        dropped(last_label, last_rest, further)
    return label


def distances(edges: DataFrame, sources: DataFrame, limit: float | None = None) -> DataFrame:
    """(source, node, distance): lengths of shortest paths by ``edges`` (a, b, w >= 0) from each of ``sources`` (source), to nodes within ``limit``.

    Each round relaxes the edges of nodes whose distance fell.  The table has a row for each
    source and node that it reaches, so the sources should be a bounded set.  A source without
    edges reaches itself.
    """
    near = written(_ends(edges.select("a", "b", "w")).filter("u <> v").groupBy("u", "v").agg(F.min("w").alias("w")))
    start = sources.select("source").filter("source IS NOT NULL").distinct()
    state = written(start.select("source", F.col("source").alias("node"), F.lit(0).cast(near.schema["w"].dataType).alias("distance")))
    frontier = state
    while True:
        tried = frontier.join(near.withColumnRenamed("u", "node"), "node").select("source", F.col("v").alias("node"), (F.col("distance") + F.col("w")).alias("_d"))
        tried = tried if limit is None else tried.filter(F.col("_d") <= limit)
        best = tried.groupBy("source", "node").agg(F.min("_d").alias("_d"))
        fell = written(best.join(state, ["source", "node"], "left").filter("distance IS NULL OR _d < distance").select("source", "node", F.col("_d").cast(state.schema["distance"].dataType).alias("distance")))
        if frontier is not state:
            dropped(frontier)
        if fell.isEmpty():
            break
        last, frontier = state, fell
        state = written(state.join(fell.withColumnRenamed("distance", "_d"), ["source", "node"], "full").select("source", "node", F.coalesce("_d", "distance").alias("distance")))
        dropped(last)
    dropped(near)
    return state
