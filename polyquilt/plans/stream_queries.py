"""Streams, units of work and table functions over the given tables, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquilt.operators import alike, units
from polyquilt.operators.tables import new_path
from polyquilt.sources.datasource import RecordFiles
from polyquilt.streaming import online

#: Forms that are remembered for a user, and parts in which the events arrive.
CAP, PARTS = 3, 3
LENGTH, STEP, DELAY = "24 hours", "6 hours", "12 hours"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time as an instant, whatever the session's zone, and the third of ids they are in."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    top = e.agg((F.max("event_id") + 1).alias("_top"))  # one row
    own = e.select("event_id", "user_id", "event_type", F.timestamp_micros(micros).alias("ts")).join(F.broadcast(top))
    return own.withColumn("part", F.floor(F.col("event_id") * PARTS / F.col("_top")).cast("int")).drop("_top")


def stream_capped_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a type that their user's set of at most three types does not hold, from a stream in three parts."""
    own, base = _events(spark, sf_dir), new_path(spark)
    rows = own.drop("part")
    for part in range(PARTS):
        own.filter(F.col("part") == part).drop("part").write.mode("append").parquet(f"{base}/in")
        stream = online.follow(spark, f"{base}/in", rows.schema)
        online.drain(online.capped_dedup(stream, "user_id", "event_type", "event_id", CAP), f"{base}/out", f"{base}/offsets").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/out").select("event_id", "user_id", "event_type")


CAPPED = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT user_id, 0::BIGINT AS i, []::VARCHAR[] AS seen, false AS fresh FROM e WHERE i = 1 UNION ALL
SELECT e.user_id, e.i, CASE WHEN len(r.seen) >= {CAP} THEN [e.event_type] WHEN list_contains(r.seen, e.event_type) THEN r.seen ELSE list_append(r.seen, e.event_type) END,
  len(r.seen) >= {CAP} OR NOT list_contains(r.seen, e.event_type) FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT event_id, e.user_id, event_type FROM e JOIN r ON e.user_id = r.user_id AND e.i = r.i WHERE fresh"""


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.11: sliding windows of events by type, closed by a watermark, and the rows that came too late for some, as kinds of one result.

    Every fiftieth event arrives a part late.
    """
    own, base = _events(spark, sf_dir), new_path(spark)
    own = own.withColumn("part", F.least(F.lit(PARTS - 1), F.col("part") + F.when(F.col("event_id") % 50 == 7, 1).otherwise(0)))
    rows = own.drop("part")
    for part in range(PARTS):
        own.filter(F.col("part") == part).drop("part").write.mode("append").parquet(f"{base}/in")
        stream = online.follow(spark, f"{base}/in", rows.schema)
        online.drain(online.windows(stream, "ts", "event_type", LENGTH, STEP, DELAY), f"{base}/out", f"{base}/offsets").awaitTermination()
        online.late_rows(stream, "ts", LENGTH, STEP, DELAY, f"{base}/missed", f"{base}/late-offsets").awaitTermination()
    closed = spark.read.schema("event_type string, start timestamp, n long").parquet(f"{base}/out").select(F.lit("window").alias("kind"), "event_type", F.unix_seconds("start").alias("at"), "n")
    late = spark.read.schema("event_id long, event_type string, missed long").option("recursiveFileLookup", True).parquet(f"{base}/missed/late")
    return closed.unionByName(late.select(F.lit("late").alias("kind"), "event_type", F.col("event_id").alias("at"), F.col("missed").alias("n")))


WINDOWS = f"""WITH e AS (SELECT *, epoch_us(ts) AS us, least({PARTS - 1}, floor(event_id * {PARTS} / (SELECT max(event_id) + 1 FROM events))::BIGINT + (event_id % 50 = 7)::BIGINT) AS part FROM events),
w AS (SELECT event_id, event_type, part, us // 21600000000 * 21600 - 21600 * k AS start FROM e, range(0, 4) t(k)),
m AS (SELECT part, max(us) AS top FROM e GROUP BY part), c AS (SELECT p.part, max(m.top) // 1000 * 1000 - 43200000000 AS mark FROM range(0, {PARTS + 1}) p(part) JOIN m ON m.part < p.part GROUP BY p.part),
j AS (SELECT w.*, coalesce((start + 86400) * 1000000 <= mark, false) AS late FROM w LEFT JOIN c ON w.part = c.part)
SELECT 'window' AS kind, event_type, start AS "at", count(*) AS n FROM j WHERE NOT late AND (start + 86400) * 1000000 <= (SELECT mark FROM c WHERE part = {PARTS}) GROUP BY ALL
UNION ALL SELECT 'late' AS kind, event_type, event_id AS "at", count(*) AS n FROM j WHERE late GROUP BY ALL"""


def resumed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U9 + K6: the dedup of documents in eight units by digest, stopped after three and resumed."""
    target = f"{new_path(spark)}/units"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    units.stage(docs, F.sha2("text", 256), "doc_id", target, 8)
    units.work(spark, target, most=3)
    units.stage(docs, F.sha2("text", 256), "doc_id", target, 8)  # as a new run would
    units.work(spark, target)
    return units.result(spark, target)


RESUMED = "SELECT sha256(text) AS form, min(doc_id) AS kept, count(*) AS copies FROM documents GROUP BY sha256(text)"


def alike_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order that are alike: marked by their flag, each leads to the lines whose supplier has the next higher number."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.min("l_returnflag").alias("flag"))
    own = li.select("l_orderkey", F.col("l_linenumber").alias("a"), "s")
    other = li.select("l_orderkey", F.col("l_linenumber").alias("b"), F.col("s").alias("t"))
    edges = own.join(other, "l_orderkey").filter("s < t")  # a few lines an order
    return alike.alike_rows(li, edges, "l_orderkey", "l_linenumber", "flag")


def _alike_rounds(n: int) -> str:
    step = """a{1} AS MATERIALIZED (SELECT g, x, y FROM a{0} p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.g = p.g AND e.a = p.x AND NOT EXISTS (SELECT 1 FROM e f JOIN a{0} q ON q.g = f.g AND q.y = f.b AND q.x = e.b WHERE f.g = p.g AND f.a = p.y))
    AND NOT EXISTS (SELECT 1 FROM e WHERE e.g = p.g AND e.a = p.y AND NOT EXISTS (SELECT 1 FROM e f JOIN a{0} q ON q.g = f.g AND q.x = f.b AND q.y = e.b WHERE f.g = p.g AND f.a = p.x)))"""
    return ",\n".join(step.format(k, k + 1) for k in range(n))


ALIKE = f"""WITH l AS MATERIALIZED (SELECT l_orderkey AS g, l_linenumber AS x, min(l_suppkey) AS s, min(l_returnflag) AS flag FROM lineitem GROUP BY ALL),
e AS MATERIALIZED (SELECT p.g, p.x AS a, q.x AS b FROM l p JOIN l q ON p.g = q.g AND p.s < q.s),
a0 AS MATERIALIZED (SELECT p.g, p.x, q.x AS y FROM l p JOIN l q ON p.g = q.g AND p.flag = q.flag),
{_alike_rounds(8)}
SELECT g AS l_orderkey, x AS l_linenumber, min(y) AS least, count(*) AS n FROM a8 GROUP BY g, x"""


def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as record files of both layouts and read back, long ones of each by a pushed filter."""
    spark.dataSource.register(RecordFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "n_chars", "text")
    out = None
    for layout in ("text", "packed"):
        path = f"{new_path(spark)}/{layout}"
        docs.write.format("polyquilt_records").option("layout", layout).option("splitBytes", 4 << 20).mode("append").save(path)
        back = spark.read.format("polyquilt_records").schema(docs.schema).option("layout", layout).option("splitBytes", 4 << 20).option("push", "true").load(path)
        own = back.filter(F.col("n_chars") > 500).select(F.lit(layout).alias("layout"), "doc_id", "lang", "n_chars", F.sha2("text", 256).alias("digest"))
        out = own if out is None else out.unionByName(own)
    return out


RECORDS = "SELECT unnest(['text', 'packed']) AS layout, doc_id, lang, n_chars, sha256(text) AS digest FROM documents WHERE n_chars > 500"


STREAMS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "stream_capped_dedup": (stream_capped_dedup, CAPPED),
    "stream_windows": (stream_windows, WINDOWS),
    "resumed_dedup": (resumed_dedup, RESUMED),
    "alike_lines": (alike_lines, ALIKE),
    "record_files": (record_files, RECORDS),
}
