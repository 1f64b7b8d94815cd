"""A store of lattice records with numbered entries, failures beside them and a mark of completeness.

A store is a folder with three tables: ``records`` in order of their entries, ``failures``
(name, error), and ``about``, one row, which is written last: what has no ``about`` has not
been published.  An existing store is never written over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquilt.functions import codec
from polyquilt.operators.tables import numbered
from polyquilt.sources import tilings

RECORD = ("entry_id", "k", "stable_id", "t1", "t2", "seeds", "seed_count")


class IncompleteStore(ValueError):
    """A store that holds failures."""


def write(rows: DataFrame, target: str) -> None:
    """K5: ``rows`` (k, stable_id, t1, t2, seeds, and name and error of failures) as a store.

    Rows without an ``error`` are records, of which one of each stable id is kept, the least;
    they are numbered from 1 in order of k and stable id.  Scans of an entry or of a range read few files,
    as the records are written in ranges of their entries.
    """
    failed = rows.filter("error IS NOT NULL").select("name", "error")
    good = rows.filter("error IS NULL")
    one = good.groupBy("k", "stable_id").agg(F.min(F.struct("t1", "t2", "seeds")).alias("r")).select("k", "stable_id", "r.t1", "r.t2", "r.seeds", F.size("r.seeds").cast("long").alias("seed_count"))
    placed = numbered(one, [], [F.col("k"), F.col("stable_id")]).withColumn("entry_id", F.col("idx") + 1)
    placed.select(*RECORD).repartitionByRange("entry_id").sortWithinPartitions("entry_id").write.option("compression", "zstd").parquet(f"{target}/records")
    failed.write.parquet(f"{target}/failures")
    spark = rows.sparkSession
    counts = spark.read.parquet(f"{target}/records").agg(F.count("*").alias("entries")).join(spark.read.schema("name string, error string").parquet(f"{target}/failures").agg(F.count("*").alias("failures")))
    counts.withColumn("complete", F.col("failures") == 0).coalesce(1).write.parquet(f"{target}/about")


def is_complete(spark: SparkSession, target: str) -> bool:
    return spark.read.parquet(f"{target}/about").first()["complete"]


def import_json(spark: SparkSession, path: str, target: str, legacy_domain: bytes | None = None) -> int:
    """The records of JSON files as a store; the number of entries.

    What fails is kept in the store, which is incomplete then, and raises once all is written.
    """
    write(tilings.from_json(spark, path, legacy_domain), target)
    about = spark.read.parquet(f"{target}/about").first()
    if not about["complete"]:
        some = [f"{r['name']}: {r['error']}" for r in failures(spark, target).orderBy("name").limit(3).collect()]
        raise IncompleteStore(f"{about['failures']} records failed, {about['entries']} are stored; {'; '.join(some)}")
    return about["entries"]


def records(spark: SparkSession, target: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Entries in order, from ``first`` to ``last``; the bounds reach the scan."""
    rows = spark.read.parquet(f"{target}/records")
    if first is not None:
        rows = rows.filter(F.col("entry_id") >= first)
    if last is not None:
        rows = rows.filter(F.col("entry_id") <= last)
    return rows.orderBy("entry_id")


def failures(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema("name string, error string").parquet(f"{target}/failures")


def read_by_id(spark: SparkSession, target: str, entry_id: int) -> DataFrame:
    """The entry of that number, if there is one."""
    return records(spark, target, entry_id, entry_id)


def read_by_stable_id(spark: SparkSession, target: str, hex_id: str, k: int | None = None) -> DataFrame:
    """The entries of that id, of one k or of any."""
    rows = spark.read.parquet(f"{target}/records").filter(F.col("stable_id") == F.unhex(F.lit(codec.parse_hex_id(hex_id).hex())))
    return rows if k is None else rows.filter(F.col("k") == k)


def lookup(ids: DataFrame, target: str) -> DataFrame:
    """S12 for many: rows of ``ids`` (entry_id) with their entries, by an equi-join; those without one have nulls."""
    return ids.join(ids.sparkSession.read.parquet(f"{target}/records"), "entry_id", "left")


def export_json(spark: SparkSession, target: str, path: str) -> None:
    """A complete store as lines of JSON; an incomplete one is refused."""
    if not is_complete(spark, target):
        raise IncompleteStore("an incomplete store is not exported")
    tilings.to_json(spark.read.parquet(f"{target}/records")).write.text(path)
