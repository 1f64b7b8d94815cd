"""U9 + K6: a global dedup in units that can be stopped at any point and resumed.

The input is staged once, cut into units by ranges of its forms' digests (columns that the
dedup needs only), with a row for each unit that says how many rows it has.  Each unit is
then a job of its own that reads its own files, and is published by one commit of Spark's
writer; a ledger row follows.  A resumed run does the units without a ledger row, over what
a broken attempt may have left.  The result is given only if the ledger covers the input.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquilt.operators.reconcile import first_of_each


def unit_of(digest: Column, units: int) -> Column:
    """The unit of a hex digest: equal ranges of its first 32 bits."""
    return F.shiftright(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * units, 32).cast("int")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, empty where nothing has been published yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _published(spark: SparkSession, path: str) -> bool:
    """Whether Spark's writer has committed ``path``."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def stage(rows: DataFrame, digest: Column, order: str, target: str, units: int) -> None:
    """Write (form, kept) by unit, and the plan (unit, rows); nothing is done where the plan has been published.

    Null digests are a form of the last unit.  ``units`` is fixed by the first call.
    """
    spark = rows.sparkSession
    if _published(spark, f"{target}/plan"):
        return
    own = rows.select(digest.alias("form"), F.col(order).alias("kept"))
    own = own.withColumn("unit", F.coalesce(unit_of(F.col("form"), units), F.lit(units - 1)))
    own.write.mode("overwrite").partitionBy("unit").parquet(f"{target}/staged")
    counted = spark.read.schema(own.schema).parquet(f"{target}/staged").groupBy(F.col("unit").cast("int").alias("unit")).agg(F.count("*").alias("rows"))
    every = spark.range(units).select(F.col("id").cast("int").alias("unit"))
    every.join(counted, "unit", "left").select("unit", F.coalesce("rows", F.lit(0).cast("long")).alias("rows")).write.mode("overwrite").parquet(f"{target}/plan")


def waiting(spark: SparkSession, target: str) -> list[int]:
    """Units that have rows and no ledger row, in order; the plan has a row for each unit, so this is a bounded list."""
    plan = spark.read.schema("unit int, rows long").parquet(f"{target}/plan").filter("rows > 0")
    return [r.unit for r in plan.join(ledger(spark, target), "unit", "left_anti").orderBy("unit").collect()]


def ledger(spark: SparkSession, target: str) -> DataFrame:
    """(unit, seen, forms) of the units that are done; a unit recorded twice counts once."""
    return _read(spark, f"{target}/ledger", "unit int, seen long, forms long").dropDuplicates(["unit"])


def work(spark: SparkSession, target: str, most: int | None = None) -> int:
    """Do units that are waiting, ``most`` at most; the number done."""
    todo = waiting(spark, target)[:most]
    for unit in todo:
        own = spark.read.parquet(f"{target}/staged").filter(F.col("unit") == unit).drop("unit")
        path = f"{target}/done/unit={unit}"
        first_of_each(own, F.col("form"), "kept").write.mode("overwrite").parquet(path)
        made = spark.read.parquet(path)
        made.agg(F.lit(unit).alias("unit"), F.coalesce(F.sum("copies"), F.lit(0)).alias("seen"), F.count("*").alias("forms")).write.mode("append").parquet(f"{target}/ledger")
    return len(todo)


def result(spark: SparkSession, target: str) -> DataFrame:
    """(form, kept, copies) of all units; an error where a unit is missing or has not seen all rows of the plan."""
    plan = spark.read.schema("unit int, rows long").parquet(f"{target}/plan").filter("rows > 0")
    short = plan.join(ledger(spark, target), "unit", "left").filter("seen IS NULL OR seen <> rows")
    lacking = [r.unit for r in short.select("unit").orderBy("unit").limit(5).collect()]
    if lacking:
        raise ValueError(f"units that do not cover their rows yet: {lacking}")
    if plan.isEmpty():
        return spark.createDataFrame([], "form string, kept long, copies long")
    return spark.read.parquet(f"{target}/done").drop("unit")
