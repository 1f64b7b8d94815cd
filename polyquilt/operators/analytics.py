"""A4-A17, W1-W9 and K14 as DataFrame expressions over any relation of the right shape.

A *membership* relation has a group column (k), a row id and a member; it stands for the
vertex types of results, or for any bag of labels per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BASE = r"\([0-9]+(?:,[0-9]+)*\)"


def base_symbols(signature: Column) -> Column:
    """the configurations of a signature in order, each as often as its ``xN`` says."""
    found = F.regexp_extract_all(signature, F.lit(rf"({BASE})[A-Za-z0-9]*"), F.lit(1))
    times = F.transform(F.regexp_extract_all(signature, F.lit(rf"{BASE}(?:[SRAF][0-9]?[ab]?)?(x[0-9]+)?"), F.lit(1)), lambda x: F.coalesce(F.try_to_number(F.substring(x, 2, 10), F.lit("999999999")).cast("int"), F.lit(1)))
    return F.flatten(F.zip_with(found, times, lambda s, n: F.array_repeat(s, n)))


def distinct_members(rows: DataFrame) -> DataFrame:
    """A4: (k, m, n): rows of k with m distinct members."""
    return rows.groupBy("k", "id").agg(F.count_distinct("member").alias("m")).groupBy("k", "m").agg(F.count("*").alias("n"))


def multiplicities(rows: DataFrame) -> DataFrame:
    """(k, id, member, c): how often each row has a member."""
    return rows.groupBy("k", "id", "member").agg(F.count("*").alias("c"))


def profiles(rows: DataFrame) -> DataFrame:
    """A5: (k, profile, n): multiplicities of a row in falling order, joined by +."""
    own = multiplicities(rows).groupBy("k", "id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("c"), False), lambda x: x.cast("string")), "+").alias("profile"))
    return own.groupBy("k", "profile").agg(F.count("*").alias("n"))


def frequency(rows: DataFrame, *by: str) -> DataFrame:
    """(by, member, n): rows that have a member, each once."""
    return rows.select("k", "id", "member").distinct().groupBy(*by, "member").agg(F.count("*").alias("n"))


def mean_entropy(rows: DataFrame) -> DataFrame:
    """(k, entropy): mean over rows of the Shannon entropy (log2) of their members, to six places."""
    c = multiplicities(rows)
    per = c.groupBy("k", "id").agg(F.sum("c").alias("t"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return per.groupBy("k").agg(F.round(F.avg(F.log2("t") - F.col("s") / F.col("t")), 6).alias("entropy"))


def max_multiplicity(rows: DataFrame) -> DataFrame:
    """(k, top, n)."""
    return multiplicities(rows).groupBy("k", "id").agg(F.max("c").alias("top")).groupBy("k", "top").agg(F.count("*").alias("n"))


def prevalence(rows: DataFrame, top: int | None = None) -> DataFrame:
    """A10 + W2: (k, member, n, share, place): the members of each k by falling frequency, ties by name; the ``top`` first ones, or all."""
    totals = rows.groupBy("k").agg(F.count_distinct("id").alias("total"))
    found = frequency(rows, "k").withColumn("place", F.row_number().over(W.partitionBy("k").orderBy(F.desc("n"), "member")))
    found = found if top is None else found.filter(F.col("place") <= top)
    return found.join(totals, "k").select("k", "member", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), "place")


def growth(counts: DataFrame, key: str, value: str) -> DataFrame:
    """Each count by the one before it; null for the first.  One row a key, so a single task's window is bounded by the keys."""
    w = W.partitionBy(F.lit(0)).orderBy(key)
    return counts.select(key, value, F.round(F.try_divide(F.col(value), F.lag(value).over(w)), 6).alias("ratio"))


def histogram_pivot(rows: DataFrame, values: list[int] | None = None) -> DataFrame:
    """A4 in wide form, a column for each of ``values`` (None: 1 up to the greatest that occurs, which is looked up)."""
    own = distinct_members(rows)
    if values is None:
        values = list(range(1, (own.agg(F.max("m")).first()[0] or 0) + 1))
    wide = own.groupBy("k").pivot("m", values).agg(F.sum("n")) if values else own.select("k").distinct()
    return wide.select("k", *[F.coalesce(F.col(str(v)), F.lit(0)).cast("long").alias(f"m{v}") for v in values])


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def match_cardinality(left: DataFrame, right: DataFrame, on: list[str], key: str) -> DataFrame:
    """J3 + A17: each left row as unmatched, matched (once) or ambiguous, by equi-join counted before it meets."""
    counted = right.groupBy(*on).agg(F.count("*").alias("matches"))
    met = left.join(counted, on, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return met.select(key, "matches", F.when(F.col("matches") == 0, "unmatched").when(F.col("matches") == 1, "matched").otherwise("ambiguous").alias("status"))


def sliding_rate(rows: DataFrame, by: str, ts: str, interval: str, order: str) -> DataFrame:
    """Events a second over the ``interval`` up to each row; 0 where the frame's times differ by half a second or less.

    Rows are taken by time, then by ``order``.  A frame never has less than two rows: with
    none but the row itself within the interval, the one before it counts, however old.
    """
    own = rows.withColumn("_row", F.row_number().over(W.partitionBy(by).orderBy(ts, order)))
    frame = f"OVER (PARTITION BY {by} ORDER BY {ts} RANGE BETWEEN INTERVAL {interval} PRECEDING AND CURRENT ROW)"
    last = W.partitionBy(by).orderBy(ts, order)
    out = own.withColumns({"_first": F.expr(f"min(_row) {frame}"), "_since": F.expr(f"min({ts}) {frame}"), "_before": F.lag(ts).over(last)})
    alone = (F.col("_first") == F.col("_row")) & F.col("_before").isNotNull()
    since = F.when(alone, F.col("_before")).otherwise(F.col("_since"))
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(since.cast("timestamp"))
    frame_rows = F.when(alone, 2).otherwise(F.col("_row") - F.col("_first") + 1).cast("long")
    out = out.withColumn("in_frame", frame_rows).withColumn("rate", F.when(seconds <= 500_000, F.lit(0.0)).otherwise(F.round((F.col("in_frame") - 1) * 1e6 / seconds, 9)))
    return out.drop("_row", "_first", "_since", "_before")


def ewma(values: Column, alpha: float = 0.3) -> Column:
    """Exponentially weighted mean of an array in order, started anew from the next value where it is 0."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: F.when(acc == 0, x).otherwise(F.lit(alpha) * x + F.lit(1 - alpha) * acc))


def eta_class(queue: Column, rate: Column, growth: Column, text: Callable[[Column], Column]) -> Column:
    """When a queue will be empty, as a duration that ``text`` writes.

    -- for an empty queue and .. below a rate that means anything (10 a second at most); a
    queue that shrinks by more than 100 a second has a time of its own, at the rate less the
    growth; any other has > before what its present length takes at the rate.
    """
    left = F.when(growth < -100, text(queue / (rate - growth))).otherwise(F.concat(F.lit(">"), text(queue / rate)))
    return F.when(queue == 0, "--").when(rate <= 10, "..").otherwise(left)


def running_index(rows: DataFrame, by: str, order: str) -> DataFrame:
    """W6."""
    return rows.withColumn("index", F.row_number().over(W.partitionBy(by).orderBy(order)))


def deltas(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Each value less the one before it (the first one stands as it is)."""
    w = W.partitionBy(by).orderBy(value)
    return rows.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))


def not_ascending(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Rows whose value does not exceed the one before it."""
    w = W.partitionBy(by).orderBy(order)
    return rows.withColumn("before", F.lag(value).over(w)).filter(F.col(value) <= F.col("before"))
