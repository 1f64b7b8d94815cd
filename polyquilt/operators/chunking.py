"""Cutting sorted rows into chunks by cumulative bytes and change of key.

The rule is sequential: a chunk is closed when the key changes, or when the bytes held and
the next row's size would exceed the target; a held row counts its size and its framing.
So a row that is larger than the target stands in a chunk of its own or ends one that has
just been opened by it.

Here the rule becomes pointers: from running sums each row knows where a chunk that starts
with it would end, by an equi-join on ranges of the running sum.  The chunks that really
start are reached from each key's first row by doubling those pointers, in a number of
rounds that is logarithmic in the chunks of a key.  No task sees all rows of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from polyquilt.operators.tables import dropped, numbered, written


def next_breaks(rows: DataFrame, target: int) -> DataFrame:
    """(key, idx, next): the row at which a chunk that starts with row ``idx`` ends; null where it lasts to the key's end.

    ``rows`` are (key, idx, size, more, before): bytes, framing (1 at least) and the running
    sum of both.  ``reach`` = before + size never falls, so the break is the first later row
    whose reach exceeds the start's ``before`` + target.
    """
    own = rows.select("key", "idx", "before", (F.col("before") + F.col("size")).alias("reach"))
    last = own.select("key", (F.col("idx") + 1).alias("idx"), F.col("reach").alias("_from"))
    bucket = lambda x: F.floor(x / target).cast("long")
    # a row stands in every bucket of sums for which it is the first to reach beyond
    held = own.join(last, ["key", "idx"], "left").withColumn("bucket", F.explode(F.sequence(bucket(F.coalesce("_from", F.lit(0))), bucket(F.col("reach")))))
    asked = own.withColumn("at", F.col("before") + target).withColumn("bucket", bucket(F.col("at")))
    both = held.select("key", "bucket", F.col("reach").alias("at"), F.lit(1).alias("kind"), F.col("idx").alias("found"), F.lit(None).cast("long").alias("idx"))
    both = both.unionByName(asked.select("key", "bucket", "at", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("found"), "idx"))
    beyond = W.partitionBy("key", "bucket").orderBy(F.desc("at"), "kind").rowsBetween(W.unboundedPreceding, -1)  # at most ``target`` bytes of rows
    out = both.withColumn("_n", F.min("found").over(beyond)).filter("kind = 0")
    return out.select("key", "idx", F.greatest("_n", F.when(F.col("_n").isNotNull(), F.col("idx") + 1)).alias("next"))


def starts(pointers: DataFrame) -> DataFrame:
    """(key, idx): the rows that a chain of ``pointers`` (key, idx, next) from each key's row 0 meets."""
    jump = pointers.filter("next IS NOT NULL")
    found = written(pointers.filter("idx = 0").select("key", "idx"))
    while not jump.isEmpty():
        more = found.join(jump, ["key", "idx"]).select("key", F.col("next").alias("idx"))
        ahead = jump.select("key", F.col("idx").alias("next"), F.col("next").alias("_far"))
        twice = written(jump.join(ahead, ["key", "next"]).select("key", "idx", F.col("_far").alias("next")))
        last, found = found, written(found.unionByName(more))
        dropped(last, jump)
        jump = twice
    return found


def chunks(rows: DataFrame, key: Column, order: Column, size: Column, more: Column, target: int) -> DataFrame:
    """(key, chunk, first, n_rows, n_bytes): the chunks of ``rows`` sorted by ``key`` and ``order``, numbered within their key.

    ``size`` is what the rule adds to the bytes held when it looks at a row (null: 0), ``more``
    the framing that a held row adds besides, 1 at least.  ``order`` should be total in a key.
    A null key is a key; an empty table has no chunks.
    """
    own = rows.select(key.alias("key"), order.alias("order"), F.coalesce(size.cast("long"), F.lit(0)).alias("size"), F.greatest(F.coalesce(more.cast("long"), F.lit(1)), F.lit(1)).alias("more"))
    names = own.select("key").distinct()
    group = F.coalesce(F.concat(F.lit("k"), F.col("key").cast("string")), F.lit("-"))  # joins below need a key without nulls
    placed = written(numbered(own.withColumn("key", group), ["key"], [F.col("order")], {"before": F.col("size") + F.col("more")}))
    pointers = written(next_breaks(placed, target))
    begun = written(starts(pointers))
    ends = placed.groupBy("key").agg(F.count("*").alias("_rows"), F.sum(F.col("size") + F.col("more")).alias("_bytes"))
    own = begun.join(pointers, ["key", "idx"]).join(placed.select("key", "idx", F.col("order").alias("first"), "before"), ["key", "idx"])
    after = placed.select("key", F.col("idx").alias("next"), F.col("before").alias("_after"))
    own = own.join(after, ["key", "next"], "left").join(ends, "key")
    out = own.select("key", "idx", "first", (F.coalesce("next", "_rows") - F.col("idx")).alias("n_rows"), (F.coalesce("_after", "_bytes") - F.col("before")).alias("n_bytes"))
    out = numbered(out.withColumnRenamed("idx", "_start"), ["key"], [F.col("_start")]).withColumnRenamed("idx", "chunk")
    back = names.select(F.col("key").alias("_name"), group.alias("key"))
    return out.join(back, "key").select(F.col("_name").alias("key"), "chunk", "first", "n_rows", "n_bytes")

