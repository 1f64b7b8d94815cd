"""Reconciliation of chunked stores as joins and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyquilt.operators.tables import written


def chunks_of(rows: DataFrame, key: str, width: int) -> DataFrame:
    """(chunk_id, first_entry, entry_count): rows cut into id ranges of ``width``."""
    own = rows.select(F.floor(F.col(key) / width).cast("long").alias("chunk_id"), key)
    return own.groupBy("chunk_id").agg(F.min(key).alias("first_entry"), F.count("*").alias("entry_count"))


def lookup(rows: DataFrame, key: str, chunks: DataFrame, width: int) -> DataFrame:
    """J1 + W7: each row with its chunk and its place in it, by an equi-join on the chunk id."""
    own = rows.withColumn("chunk_id", F.floor(F.col(key) / width).cast("long"))
    return own.join(chunks, "chunk_id").withColumn("ordinal", F.col(key) - F.col("first_entry"))


def mismatches(chunks: DataFrame, entries: DataFrame) -> DataFrame:
    """Chunks whose stored count differs from the entries that point to them."""
    counted = entries.groupBy("chunk_id").agg(F.count("*").alias("found"))
    met = chunks.join(counted, "chunk_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return met.filter("found <> entry_count").select("chunk_id", "entry_count", "found")


def _met_so_far(points: DataFrame, marks: DataFrame) -> DataFrame:
    """``points`` (at, ...) with ``most``: the greatest value of the ``marks`` (at, value) at or before each; null if none.

    Both are sorted together by ranges.  A range's maximum is carried to those behind it by
    a window over one row for each range; within a range a window runs over its own rows.
    """
    from pyspark.sql import Window as W

    kind = marks.schema["value"].dataType
    both = marks.select("at", F.lit(0).alias("_point"), "value").unionByName(points.withColumns({"_point": F.lit(1), "value": F.lit(None).cast(kind)}), allowMissingColumns=True)
    spread = both.repartitionByRange("at", "_point").sortWithinPartitions("at", "_point")
    own = written(spread.withColumn("_place", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_place", 33))
    inside = F.max("value").over(W.partitionBy("_part").orderBy("_place").rowsBetween(W.unboundedPreceding, 0))
    tops = own.groupBy("_part").agg(F.max("value").alias("_top"))
    before = tops.select("_part", F.max("_top").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    out = own.withColumn("_inside", inside).filter("_point = 1").join(before, "_part")
    return out.select(*points.columns, F.greatest("_inside", "_before").alias("most"))


def uncovered(points: DataFrame, key: str, ranges: DataFrame) -> DataFrame:
    """Points that no range (first_entry, entry_count) covers; ranges of any length, overlapping ones too.

    A point is covered if the furthest end of the ranges that begin at or before it lies
    beyond it, so no range is cut into pieces.  A null point is covered by none.
    """
    own = points.withColumn("at", F.col(key))
    ends = ranges.filter("entry_count > 0").select(F.col("first_entry").alias("at"), (F.col("first_entry") + F.col("entry_count")).alias("value")).dropna()
    return _met_so_far(own, ends).filter(F.col("at").isNull() | F.col("most").isNull() | (F.col("most") <= F.col("at"))).select(*points.columns)


def floor_lookup(points: DataFrame, key: str, starts: DataFrame, start: str) -> DataFrame:
    """The greatest start at or below each point (null if none, or for a null point)."""
    own = points.select(F.col(key), F.col(key).alias("at"))
    marks = starts.select(F.col(start).alias("at"), F.col(start).alias("value")).dropna()
    return _met_so_far(own, marks).select(key, F.when(F.col(key).isNotNull(), F.col("most")).alias("floor"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a whose key b has too."""
    return a.join(b.select(key), key, "left_semi")


def two_sided(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with the side."""
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Changes replace rows of their key and add the rest; two passes over keys, no update in place."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes)


def first_of_each(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """(form, kept, copies): of equal forms the one that is first in ``order``, by partial aggregation."""
    return rows.groupBy(key.alias("form")).agg(F.min(order).alias("kept"), F.count("*").alias("copies"))


def bucket_of(digest: Column) -> Column:
    """U4: the upper six bits of a hex digest."""
    return F.shiftright(F.conv(F.substring(digest, 1, 2), 16, 10).cast("int"), 2)


def misplaced(rows: DataFrame, digest: str, bucket: str) -> DataFrame:
    """U8: rows whose stored bucket is not their digest's."""
    return rows.filter(bucket_of(F.col(digest)) != F.col(bucket))


def unfinished(units: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Planned units that are not done."""
    return units.join(done.select(key), key, "left_anti")


def plan_units(counts: list[tuple[str, int, int]], capacity: int) -> list[tuple[str, int, int, int]]:
    """Per combo, runs of the 64 buckets that hold at most ``capacity``, as (combo, low, high, estimate) on 32-bit prefixes; a larger bucket is split evenly."""
    step = 1 << 26
    out: list[tuple[str, int, int, int]] = []
    for combo in sorted({c for c, _, _ in counts}):
        sizes = {b: n for c, b, n in counts if c == combo}
        low, held = 0, 0
        for b in range(64):
            n = sizes.get(b, 0)
            if held and held + n > capacity:
                out.append((combo, low * step, b * step, held))
                low, held = b, 0
            if n > capacity:
                pieces = -(-n // capacity)
                edges = [b * step + step * i // pieces for i in range(pieces + 1)]
                if low < b:
                    out.append((combo, low * step, b * step, held))
                out += [(combo, x, y, -(-n // pieces)) for x, y in zip(edges, edges[1:], strict=False)]
                low, held = b + 1, 0
            else:
                held += n
        if low < 64:
            out.append((combo, low * step, 64 * step, held))
    return out
