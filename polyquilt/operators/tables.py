"""Tables between jobs, and numbers for sorted rows without a task that sees them all.

Iterative operators write each round's rows to the folder that driver and executors share
and read them back: that cuts the lineage at a copy which outlives any executor.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local master without one gets a temporary folder, a cluster must name it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"{tempfile.gettempdir()}/polyquilt-tables"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/polyquilt-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def dropped(*tables: DataFrame | None) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for t in tables:
        if t is not None and (path := getattr(t, "_written_to", None)):
            delete_path(t.sparkSession, path)


def numbered(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with ``idx`` (0, 1, ... within ``by``, in ``order``) and, for each of ``sums``, the running sum of all rows before.

    Rows are sorted by ranges; ranges are numbered by themselves and shifted by what stands
    before them in their group, so a group of any size is shared by many tasks.  ``order``
    should be total: rows that it ties get their numbers in any order.
    """
    sums = sums or {}
    keys = [F.col(b) for b in by]
    spread = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    own = written(spread.withColumn("_place", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_place", 33))
    cut = [*by, "_part"]
    inside = W.partitionBy(*cut).orderBy("_place").rowsBetween(W.unboundedPreceding, -1)
    own = own.withColumns({"_n": F.row_number().over(W.partitionBy(*cut).orderBy("_place")) - 1} | {name: F.coalesce(F.sum(x).over(inside), F.lit(0).cast("long")) for name, x in sums.items()})
    ends = own.groupBy(*cut).agg(F.count("*").alias("_rows"), *[F.sum(x).cast("long").alias(f"_sum_{name}") for name, x in sums.items()])
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row for each range of a group
    starts = ends.select(*[F.col(c).alias(f"_k_{c}") for c in cut], *[F.coalesce(F.sum(x).over(before), F.lit(0).cast("long")).alias(f"_b{x}") for x in ["_rows", *[f"_sum_{name}" for name in sums]]])
    met = own.join(starts, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in cut])
    out = met.withColumns({"idx": F.col("_n") + F.col("_b_rows")} | {name: F.col(name) + F.col(f"_b_sum_{name}") for name in sums})
    return out.select(*rows.columns, "idx", *sums)
