"""Queries of the report and of small operators, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquilt.operators import report as P


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lpad((F.col("user_id") % 12).cast("string"), 2, "0"), F.lit("_"), "event_type").alias("combo"))


def size_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 + F63."""
    return P.size_signatures(_combos(spark, sf_dir))


SIZES = "SELECT (user_id % 12)::INTEGER AS k, event_type AS sizes, count(*) AS n FROM events GROUP BY ALL"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.lit(0).alias("k"), F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 5).alias("member"))


def type_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of an order's suppliers, as text."""
    return P.histograms(_members(spark, sf_dir), 5).select(F.array_join(F.transform("histogram", lambda x: x.cast("string")), ",").alias("histogram"), "n")


HISTOGRAMS = "SELECT histogram, count(*) AS n FROM (SELECT l_orderkey, " + " || ',' || ".join(f"(count(*) FILTER (l_suppkey % 5 = {t}))::VARCHAR" for t in range(5)) + " AS histogram FROM lineitem GROUP BY l_orderkey) GROUP BY histogram"


def type_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the digits of an order's key as types."""
    digits = F.transform(F.split(F.col("o_orderkey").cast("string"), ""), lambda x: x.cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(P.type_counts(digits, 10), lambda x: x.cast("string")), ",").alias("digits"))


VECTORS = "SELECT o_orderkey, " + " || ',' || ".join(f"(length(o_orderkey::VARCHAR) - length(replace(o_orderkey::VARCHAR, '{t}', '')))::VARCHAR" for t in range(10)) + " AS digits FROM orders"


def overall_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty parts that most orders have."""
    return P.overall_top(table(spark, sf_dir, "lineitem").select(F.lit(0).alias("k"), F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("member")), 20)


OVERALL = "SELECT l_partkey AS member, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, member LIMIT 20"


def signature_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F17 + F18: configurations of signatures made of an order's keys."""
    sign = F.concat(*[F.concat(F.lit("(3,"), (F.col("o_custkey") % m).cast("string"), F.lit(")A")) for m in (3, 4, 5)])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(P.base_set(sign), " ").alias("symbols"))


SYMBOLS = "SELECT o_orderkey, list_aggregate(list_sort(list_distinct([" + ", ".join(f"'(3,' || o_custkey % {m} || ')'" for m in (3, 4, 5)) + "])), 'string_agg', ' ') AS symbols FROM orders"


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    return o.filter("o_orderstatus <> 'F'").select("o_custkey"), o.filter("o_orderstatus = 'F'").select("o_custkey")


def first_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten customers on one side only."""
    return P.first_differences(*_two(spark, sf_dir))


_SIDE = "(SELECT o_custkey, '{0}' AS side FROM (SELECT o_custkey FROM orders WHERE {1} EXCEPT SELECT o_custkey FROM orders WHERE {2}) ORDER BY o_custkey LIMIT 10)"
FIRST = _SIDE.format("left", "o_orderstatus <> 'F'", "o_orderstatus = 'F'") + " UNION ALL " + _SIDE.format("right", "o_orderstatus = 'F'", "o_orderstatus <> 'F'")


def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers less those that have a finished order of high priority."""
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
    return P.delete(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), gone.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


DELETE = "SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH'))"


def counter_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter of each nation raised by its customers."""
    start = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").cast("long").alias("n"))
    return P.add_counts(start, table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")), "nation", "n")


COUNTERS = "SELECT coalesce(n_nationkey, nation) AS nation, coalesce(n_regionkey, 0)::BIGINT + coalesce(m, 0) AS n FROM nation FULL JOIN (SELECT c_nationkey AS nation, count(*) AS m FROM customer GROUP BY ALL) ON n_nationkey = nation"


def seeded_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of all orders."""
    return P.seeded_pick(table(spark, sf_dir, "orders"), "o_orderkey", 7)


PICK = "SELECT arg_min(o_orderkey, md5('7:' || o_orderkey)) AS o_orderkey FROM orders"


def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F61 + F64 of order keys times powers."""
    x = F.col("o_orderkey").cast("long")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        P.duration_text(x / 4).alias("duration"),
        P.count_text(x * 997).alias("count"),
        P.rate_text(x / 8).alias("rate"),
        P.byte_text(x).alias("bytes"),
        F.bit_count(x).cast("int").alias("ones"),
        P.lowest_bit(x).cast("int").alias("low"),
    )


_COUNT = "CASE WHEN {0} < 10000 THEN ({0})::VARCHAR WHEN {0} < 1000000 THEN ({0}) // 1000 || 'K' ELSE ({0}) // 1000000 || '.' || ({0}) // 100000 % 10 || 'M' END"
TEXTS = f"""SELECT o_orderkey,
CASE WHEN x < 4 THEN '<1s' WHEN x // 4 < 60 THEN x // 4 || 's' WHEN x // 4 < 3600 THEN x // 240 || 'm' || x // 4 % 60 || 's' ELSE x // 14400 || 'h' || x // 4 % 3600 // 60 || 'm' END AS duration,
{_COUNT.format("x * 997")} AS count,
CASE WHEN x < 8000 THEN x // 8 || '/s' ELSE x // 8000 || 'K/s' END AS rate,
{_COUNT.format("x * 1024")} || 'B' AS bytes,
bit_count(x)::INTEGER AS ones, CASE WHEN x <> 0 THEN bit_count((x & -x) - 1)::INTEGER END AS low
FROM (SELECT o_orderkey, o_orderkey::BIGINT AS x FROM orders)"""

REPORT: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "size_signatures": (size_signatures, SIZES),
    "type_histograms": (type_histograms, HISTOGRAMS),
    "type_vectors": (type_vectors, VECTORS),
    "overall_top": (overall_top, OVERALL),
    "signature_symbols": (signature_symbols, SYMBOLS),
    "first_differences": (first_differences, FIRST),
    "delete_rows": (delete_rows, DELETE),
    "counter_update": (counter_update, COUNTERS),
    "seeded_pick": (seeded_pick, PICK),
    "number_texts": (number_texts, TEXTS),
}
