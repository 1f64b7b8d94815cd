"""X14, T1-T6 over event streams: dedup with a bounded memory, and sliding windows with a table of late rows.

Both streams read what a folder has got and stop; a later start goes on from the checkpoint,
with its state.  Sinks are files that Spark commits once for each batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class CappedSet(StatefulProcessor):
    """Passes on the first row of each form; the forms of a key are forgotten all at once when ``cap`` of them are held.

    A batch's rows are taken in the order of ``order``.  The set is cleared before the next
    row is looked at, so a form may pass again after ``cap`` others.  A key's state is ``cap``
    forms at most, read once and written once a batch.
    """

    def __init__(self, form: str, order: str, cap: int, form_type: str):
        self._form, self._order, self._cap, self._type = form, order, cap, form_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getMapState("seen", f"form {self._type}", "one boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self._order, kind="stable")
        stored = {k[0] for k in self._seen.keys()} if self._seen.exists() else set()
        held, keep = set(stored), []
        for form in batch[self._form]:
            if len(held) >= self._cap:
                held = set()
            keep.append(form not in held)
            held.add(form)
        for form in stored - held:
            self._seen.removeKey((form,))
        for form in held - stored:
            self._seen.updateValue((form,), (True,))
        yield batch[keep]

    def close(self) -> None:
        pass


def capped_dedup(rows: DataFrame, key: str, form: str, order: str, cap: int) -> DataFrame:
    """The rows of a stream whose form is not among those remembered for their key (see ``CappedSet``).

    Work is shared by ``key``: take a hash bucket of the form where all equal forms should
    meet.  Rows with a null form are one form; ``order`` should be total within a batch.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = rows.schema[form].dataType.simpleString()
    return rows.groupBy(key).transformWithStateInPandas(CappedSet(form, order, cap, kind), rows.schema, "Append", "None")


def drain(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append what there is of a stream to files in ``target``, and stop."""
    return rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)


def follow(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


# --- sliding windows ---


def windows(rows: DataFrame, ts: str, by: str, length: str, step: str, delay: str) -> DataFrame:
    """2.11: (by, start, n): rows in sliding windows, each passed on once the watermark has passed its end."""
    marked = rows.withWatermark(ts, delay)
    return marked.groupBy(F.window(ts, length, step).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")


def late_rows(rows: DataFrame, ts: str, length: str, step: str, delay: str, target: str, checkpoint: str) -> StreamingQuery:
    """Rows that came after the end of some of their windows, with the number of windows that missed them, in ``target``/late.

    The watermark of a batch is the greatest time of earlier batches (whole milliseconds)
    less ``delay``, as the engine has it; each batch notes its own in ``target``/seen.  Both
    are written under the batch's number, so a batch that runs again replaces its own.
    """

    def batch(part: DataFrame, number: int) -> None:
        spark = part.sparkSession
        part.agg(F.max(ts).alias("top")).withColumn("number", F.lit(number)).write.mode("overwrite").parquet(f"{target}/seen/{number}")
        before = spark.read.schema("top timestamp, number int").option("recursiveFileLookup", True).parquet(f"{target}/seen").filter(F.col("number") < number)
        mark = before.agg((F.date_trunc("millisecond", F.max("top")) - F.expr(f"INTERVAL {delay}")).alias("_mark"))  # one row
        own = part.withColumn("_row", F.monotonically_increasing_id())
        missed = own.select("*", F.window(ts, length, step).alias("_w")).join(F.broadcast(mark), F.col("_w.end") <= F.col("_mark"))
        counted = missed.groupBy(*own.columns).agg(F.count("*").alias("missed")).drop("_row")
        counted.write.mode("overwrite").parquet(f"{target}/late/{number}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
