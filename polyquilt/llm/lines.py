r"""Fuzzy line dedup by MinHash, in DataFrame expressions only.

A line is what lies between ``\n``; one without a word (``[^\x20\x09-\x0D]+``) stays where it
is and takes no part.  A line's set holds its character shingles, lower-cased: the ``SHINGLE``
characters from each of its places on, spaces included; a line too short for one equals
only itself.  Two lines are linked if 100 * intersection >= 75 * union; of each
connected component the line that comes first (by document id, then place) stays.

1. A line's shingle hashes, sorted, stand on a ring.  For a fixed point of the ring the
   hash that follows it is a MinHash: two lines agree there with a chance of their
   Jaccard similarity.  A band is the ``ROWS`` hashes that follow one of ``BANDS`` points;
   a line of no more shingles than that has a band from each of them.  Equal lines
   collapse, map-side first, to their first place.
2. Lines that agree on a band share a bucket.  In each bucket all members are compared
   with two of them, its first one and one picked by a hash (stars, not all pairs), on
   their full sets, and components are found by distributed rounds.
3. A bucket whose members still fall in several components is looked at again without its
   centre.  One within ``BLOCK`` members and ``BLOCK_BYTES`` is compared across its
   components, and only linked components leave it.  The members of larger ones are dealt
   to finer buckets, of more hashes a band and more bands (``FINER``), and step 2 follows
   for these; the finest are compared within ``LAST_BLOCK`` members, and larger ones stay as
   they are and lose centres only, until all of their members are linked or compared.
4. Places other than their component's first one go, and texts are put together again.

A pair at the threshold shares no bucket with a chance of (1 - 0.75**3) ** 9 = 0.7 % at
most, 0.08 % at 0.825.  Where all buckets that it shares are larger than ``BLOCK``, it shares
no finer one with a chance of 0.9 % at the threshold, and, if those are too, no finest one
with 14 %, 0.01 % at 0.85.

A line of any length travels as one value and is compared whole; lines that tie, being
equal, are one line, whose first place is decided by document id and then place, so no two
places tie.  An empty table gives an empty table.
null texts are empty and stay null where texts are returned; a row with a null id keeps its
lines and is no one's copy; rows of one id are one document and share its removals; columns
with clashing names are untouched.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquilt.llm import common, graph

SHINGLE = 12
PERCENT = 75
BANDS, ROWS = 9, 3
#: Members, and bytes of their lines, that are compared with each other in one row.
BLOCK, BLOCK_BYTES = 256, 1 << 20
#: The same for the finest buckets.
LAST_BLOCK, LAST_BYTES = 4096, 8 << 20
#: Bands and rows of the finer buckets that the members of larger ones are dealt to, round by round.
FINER = ((24, 6), (60, 12))
#: Least hashes of a set that are looked at before all of them, and how many must be common: of a pair at the
#: threshold 36 and 96 are on average, and fewer than these with a chance of 1e-6 each.
SKETCHES = ((48, 21), (128, 73))
WORD = r"[^\x20\x09-\x0D]"
#: Captures each shingle of a lower-cased line; ``_each`` gives the same without a regex.
PATTERN = rf"(?s)(?=(.{{{SHINGLE}}}))."

#: Points of the ring for the bands, and others for each round of finer buckets.
_POINTS = [-(1 << 63) + b * ((1 << 64) // BANDS) for b in range(BANDS)]
_MORE = [sorted(int(x) for x in np.random.default_rng((77, level)).integers(-(1 << 63), (1 << 63) - 1, bands)) for level, (bands, _) in enumerate(FINER)]


def _place(key: str, pos: Column) -> Column:
    """One number that orders places by document id, then line."""
    return (F.col(key).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + pos.cast("decimal(10,0)")).cast("decimal(38,0)")


def _codes(line: Column) -> Column:
    """The line in four bytes a character, so that a shingle is cut without a walk from the line's start."""
    return F.encode(F.lower(line), "UTF-32")


def _each(codes: Column) -> Column:
    """Where the shingles begin; null if there is none."""
    size = F.octet_length(codes)
    return F.when(size >= 4 * SHINGLE, F.sequence(F.lit(1), size - (4 * SHINGLE - 1), F.lit(4)))


def _hash(codes: Column, at: Column) -> Column:
    return F.xxhash64(F.substring(codes, at, F.lit(4 * SHINGLE)))


def shingles(line: Column) -> Column:
    """The fingerprints of a line's distinct shingles."""
    # the outer lambda names a value that is to be computed once
    found = F.transform(F.array(_codes(line)), lambda c: F.transform(F.coalesce(_each(c), F.array().cast("array<int>")), lambda i: _hash(c, i)))
    return F.array_distinct(F.get(found, F.lit(0)))


def ring(df: DataFrame, points: list[int], rows: int, name: str) -> DataFrame:
    """``df`` with ``name``: for each point the fingerprint of the ``rows`` hashes that follow it among the line's, null without shingles; ``line`` is dropped.

    A line of no more shingles than points starts from each of its hashes instead.
    """
    out = df.withColumn("_set", shingles(F.col("line"))).drop("line").withColumn("_ring", F.sort_array("_set")).drop("_set")
    out = out.withColumn("_with", F.sort_array(F.concat("_ring", F.array(*[F.lit(p) for p in points]))))
    n = F.greatest(F.size("_ring"), F.lit(1))
    at = F.array(*[F.when(n <= len(points), k).otherwise((F.array_position("_with", F.lit(p)) - (k + 1)).cast("int")) for k, p in enumerate(points)])
    # lambdas keep these out of the aggregate's generated method, which would be too long to be compiled
    out = out.withColumn("_at", F.transform(at, lambda i: F.pmod(i, F.greatest(F.size("_ring"), F.lit(1)))))
    after = lambda i, r: F.get("_ring", F.when(i + r < F.size("_ring"), i + r).otherwise(F.pmod(i + r, F.size("_ring"))))
    return out.withColumn(name, F.when(F.size("_ring") > 0, F.transform("_at", lambda i: F.xxhash64(*[after(i, r) for r in range(rows)])))).drop("_ring", "_with", "_at")


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, place, k1, k2, line) of each line with a word, of rows with an id."""
    own = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    own = own.filter(F.col("line").rlike(WORD))
    return own.select("key", "pos", _place("key", F.col("pos")).alias("place"), F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"), "line")


def distinct_lines(lines: DataFrame) -> DataFrame:
    """(k1, k2, place, n, bands): each distinct line's first place, number of places and band keys."""
    h = ring(lines.select("k1", "k2", "place", "line"), _POINTS, ROWS, "bands")
    h = h.select("k1", "k2", "place", *[F.get("bands", F.lit(b)).alias(f"b{b}") for b in range(BANDS)])
    found = h.groupBy("k1", "k2").agg(F.min("place").alias("place"), F.count("*").alias("n"), *[F.min(f"b{b}").alias(f"b{b}") for b in range(BANDS)])
    return found.select("k1", "k2", "place", "n", F.when(F.col("b0").isNotNull(), F.array_sort(F.array_distinct(F.array(*[f"b{b}" for b in range(BANDS)])))).alias("bands"))


def alike(n: Column, m: Column, percent: int = PERCENT) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)


def similar(x: Column, y: Column, percent: int = PERCENT) -> Column:
    """Whether two arrays of distinct shingles are similar enough; their sizes alone can tell that they are not."""
    sizes = alike(F.size(x), F.size(y), percent)
    both = F.size(F.array_intersect(x, y))
    return sizes & (both > 0) & (F.lit(100) * both >= F.lit(percent) * (F.size(x) + F.size(y) - both))


def likely(x: Column, y: Column, most: int, least: int) -> Column:
    """Whether two sets' ``most`` least hashes have ``least`` in common; shorter sets are for the full test."""
    return (F.size(x) < most) | (F.size(y) < most) | (F.size(F.array_intersect(x, y)) >= least)


def stars(members: DataFrame, texts: DataFrame, level: int) -> DataFrame:
    """(a, b): the links between the members (bucket, place, comp) of each bucket and its two centres; what is in one component needs none."""
    picks = [F.min("place").alias("c0"), F.min_by("place", F.xxhash64("place", F.lit(level))).alias("c1")]
    comps = [F.min_by("comp", "place").alias("d0"), F.min_by("comp", F.xxhash64("place", F.lit(level))).alias("d1")]
    met = members.join(members.groupBy("bucket").agg(*picks, *comps).hint("rebalance").hint("merge"), "bucket")
    pairs = met.select("place", "comp", F.explode(F.array(F.struct(F.col("c0").alias("c"), F.col("d0").alias("d")), F.struct(F.col("c1").alias("c"), F.col("d1").alias("d")))).alias("s")).filter("place <> s.c AND comp <> s.d")
    pairs = pairs.select(F.col("place").alias("a"), F.col("s.c").alias("b")).distinct()
    # few centres meet many members: theirs are the sets that are made once, and members bring their texts
    sets = texts.join(pairs.select(F.col("b").alias("place")).distinct().hint("merge"), "place", "left_semi").select(F.col("place").alias("b"), shingles(F.col("line")).alias("y"))
    met = pairs.join(texts.toDF("a", "x").hint("merge"), "a").join(sets.hint("merge"), "b")
    return common.cut(met.filter(F.exists(F.array(shingles(F.col("x"))), lambda x: similar(x, F.col("y")))).select("a", "b"))


def across(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): the linked pairs of components of each (small) bucket's members (bucket, place, comp).

    A pair is compared only in the first of these buckets that it shares; a place is in as many as there are bands at most.
    """
    buckets = members.groupBy("place").agg(F.array_sort(F.collect_set("bucket")).alias("buckets"))
    members = members.join(buckets.hint("merge"), "place")
    # buckets hold few bytes and cost much time, so they are dealt by number and not coalesced by bytes
    tasks = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), members.sparkSession.sparkContext.defaultParallelism)
    groups = members.join(texts.hint("merge"), "place").repartition(tasks, "bucket").groupBy("bucket").agg(F.mode("comp").alias("most"), F.collect_list(F.struct("comp", "buckets", "line")).alias("m"))
    sets = F.transform("m", lambda x: F.struct(x["comp"].alias("comp"), x["buckets"].alias("buckets"), F.sort_array(shingles(x["line"])).alias("s")))
    few = [lambda x, n=n: F.slice(x["s"], 1, n) for n, _ in SKETCHES]
    groups = groups.select("bucket", "most", F.transform(sets, lambda x: F.struct(x["comp"].alias("comp"), x["buckets"].alias("buckets"), *[f(x).alias(f"s{k}") for k, f in enumerate(few)], x["s"].alias("s"))).alias("m"))
    here = lambda x, y: F.get(F.array_intersect(x["buckets"], y["buckets"]), F.lit(0)) == F.col("bucket")
    apart = lambda x, y: (x["comp"] < y["comp"]) | (y["comp"] == F.col("most"))

    def linked(x: Column, y: Column) -> Column:
        # cheapest first: sizes alone tell most pairs apart
        test = apart(x, y) & alike(F.size(x["s"]), F.size(y["s"])) & here(x, y)
        for k, (most, least) in enumerate(SKETCHES):
            test = test & likely(x[f"s{k}"], y[f"s{k}"], most, least)
        return test & similar(x["s"], y["s"])

    # members of the largest component need not be compared with each other: those outside it are with all;
    # the outer lambda names the sets, which the inner ones would else make anew for each member
    rest = lambda m: F.filter(m, lambda x: x["comp"] != F.col("most"))
    found = F.transform(F.array("m"), lambda m: F.transform(rest(m), lambda x: F.array_distinct(F.transform(F.filter(m, lambda y: linked(x, y)), lambda y: F.struct(x["comp"].alias("a"), y["comp"].alias("b"))))))
    return common.cut(groups.select(F.explode(F.array_distinct(F.flatten(F.flatten(found)))).alias("p")).select("p.a", "p.b").distinct())


def finer(members: DataFrame, texts: DataFrame, level: int) -> DataFrame:
    """The shared finer buckets (bucket, place) of the places in ``members``."""
    own = texts.join(members.select("place").distinct().hint("merge"), "place", "left_semi")
    own = ring(own, _MORE[level], FINER[level][1], "subs").select("place", F.explode(F.array_distinct("subs")).alias("sub"))
    return shared(own.select("place", F.xxhash64("sub", F.lit(level)).alias("bucket")))


def shared(members: DataFrame) -> DataFrame:
    """The members (bucket, place) of buckets with two of them or more."""
    more = members.groupBy("bucket").agg(F.count("*").alias("_m")).filter("_m > 1").select("bucket")
    return members.join(more.hint("merge"), "bucket").select("bucket", "place")


def with_component(members: DataFrame, found: DataFrame) -> DataFrame:
    """``members`` with ``comp``, the component of their place."""
    met = members.join(found.toDF("place", "_component").hint("merge"), "place", "left")
    return met.withColumn("comp", F.coalesce("_component", "place")).drop("_component")


def components(lines: DataFrame) -> DataFrame:
    """(k1, k2, root) of each distinct line that has copies, or is not the first of its component: the component's first place."""
    own = common.cut(distinct_lines(lines))
    members = common.cut(shared(own.select("place", F.explode("bands").alias("bucket"))).withColumn("comp", F.col("place")))
    texts = common.cut(lines.select("place", "line").join(members.select("place").distinct().hint("merge"), "place", "left_semi"))
    found, level = None, 0
    while True:
        edges = stars(members, texts, level)
        found = graph.merged(found, edges)
        common.free(edges)
        # centres have met all others of their bucket
        centres = members.groupBy("bucket").agg(F.min("place").alias("c0"), F.min_by("place", F.xxhash64("place", F.lit(level))).alias("c1"), F.count("*").alias("m")).filter("m > 2")
        rest = members.join(centres.hint("rebalance").hint("merge"), "bucket").filter("place <> c0 AND place <> c1").select("bucket", "place")
        rest = common.cut(with_component(rest, found))
        sizes = rest.join(texts.select("place", F.octet_length("line").cast("long").alias("bytes")).hint("merge"), "place").groupBy("bucket").agg(F.min("comp").alias("d0"), F.max("comp").alias("d1"), F.count("*").alias("m"), F.sum("bytes").alias("bytes")).filter("d0 < d1")
        most, most_bytes = (BLOCK, BLOCK_BYTES) if level < len(FINER) else (LAST_BLOCK, LAST_BYTES)
        sizes = common.cut(sizes.select("bucket", ((F.col("m") <= most) & (F.col("bytes") <= most_bytes)).alias("small")), sweep=False)
        edges = across(rest.join(sizes.filter("small").hint("merge"), "bucket"), texts)
        found = graph.merged(found, edges)
        large = common.cut(rest.join(sizes.filter("NOT small").hint("merge"), "bucket").select("bucket", "place"))
        common.free(members, rest, sizes, edges)
        if large.isEmpty():
            break
        if level < len(FINER):
            large = finer(large, texts, level)
        members = common.cut(with_component(large, found))
        level += 1
    ends = own.select("k1", "k2", "place", "n").join(found.toDF("place", "component").hint("merge"), "place", "left")
    roots = common.cut(ends.withColumn("root", F.coalesce("component", "place")).filter("n > 1 OR root <> place").select("k1", "k2", "root"))
    common.free(own, texts, found)
    return roots


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, removed): the places in each document whose lines go, for documents that lose any."""
    lines = lines_of(docs, key, text)
    gone = lines.select("key", "pos", "place", "k1", "k2").join(components(lines).hint("merge"), ["k1", "k2"]).filter("place <> root")
    return gone.groupBy("key").agg(F.collect_set("pos").alias("removed"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with their texts less the lines that go; a text that loses nothing is returned as it is."""
    gone = common.cut(removals(docs, key, text)).toDF("_dedup_key", "_dedup_removed")
    met = docs.join(gone.hint("merge"), F.col(key) == F.col("_dedup_key"), "left").withColumn("_dedup_lines", F.when(F.col("_dedup_removed").isNotNull(), F.split(F.col(text), "\n")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_dedup_lines") - 1), F.col("_dedup_removed"))
    left = F.array_join(F.transform(kept, lambda i: F.get("_dedup_lines", i)), "\n")
    return met.select(*[(F.when(F.col("_dedup_removed").isNull(), F.col(text)).otherwise(left).alias(text) if c == text else F.col(c)) for c in docs.columns])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` after line dedup: lines with a word, lines removed, and the text's digest."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    count = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: x.rlike(WORD))).cast("long")
    out = dedup(docs.withColumn("n_lines", count(F.col("text"))))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - count(F.col("text"))).alias("n_removed"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))
