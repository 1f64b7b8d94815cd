"""2.11: documents to lattice records as a stream, with a dead-letter table and exactly-once batches.

A batch writes its good and bad rows under its own number, replacing what an earlier try
left there, so that a batch that runs twice counts once.  ``retry`` converts the dead
letters again; what succeeds is written, and what fails anew stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from polyquilt.sources import tilings


def start(spark: SparkSession, source: str, target: str, dead: str, checkpoint: str, fingerprint: str = "", fail_fast: bool = False) -> StreamingQuery:
    """Convert all documents that ``source`` has and stop; a later start goes on from the checkpoint's offsets."""
    rows = spark.readStream.schema(tilings.DOCUMENT).parquet(source)

    def batch(part: DataFrame, number: int) -> None:
        made = tilings.convert(part, fingerprint).persist()
        try:
            bad = made.filter("error IS NOT NULL").select("id", "error")
            if fail_fast and (first := bad.orderBy("id").first()):
                raise ValueError(f"document {first['id']}: {first['error']}")
            failed = part.join(bad, "id")
            made.filter("error IS NULL").drop("error").write.mode("overwrite").parquet(f"{target}/batch={number}")
            failed.write.mode("overwrite").parquet(f"{dead}/batch={number}")
        finally:
            made.unpersist()

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watermark(spark: SparkSession, target: str) -> int:
    """The highest source id converted."""
    return spark.read.parquet(target).agg(F.coalesce(F.max("source_id"), F.lit(0))).first()[0]


def retry(spark: SparkSession, target: str, dead: str, number: int, fingerprint: str = "") -> DataFrame:
    """Convert the dead letters that no earlier try has converted; gives those that still fail.

    ``number`` (0, 1, ...) names the attempt.  Its outcome is written once, to a folder of its own beside the
    dead letters, and read back from there; what succeeded then goes to the target under a
    negative batch number, which no stream uses.  An attempt that exists is refused.
    """
    if number < 0:
        raise ValueError("attempts count from 0")
    done = spark.read.parquet(target).select("id")
    waiting = spark.read.parquet(dead).drop("batch", "error").dropDuplicates(["id"]).join(done, "id", "left_anti")
    outcome = f"{dead.rstrip('/')}-attempts/{number}"
    tilings.convert(waiting, fingerprint).write.mode("errorifexists").parquet(outcome)
    made = spark.read.parquet(outcome)
    made.filter("error IS NULL").drop("error").write.mode("errorifexists").parquet(f"{target}/batch={-1 - number}")
    return made.filter("error IS NOT NULL").select("id", "error")


def distinct_stream(rows: DataFrame, key: str, seen: str, delay: str) -> DataFrame:
    """First rows of each key of a stream; state older than the watermark goes, as a capped set would forget."""
    return rows.withWatermark(seen, delay).dropDuplicatesWithinWatermark([key])


def windowed_rate(rows: DataFrame, ts: str, length: str, slide: str, delay: str) -> DataFrame:
    """W3 on a stream: events in sliding windows."""
    return rows.withWatermark(ts, delay).groupBy(F.window(ts, length, slide)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")
