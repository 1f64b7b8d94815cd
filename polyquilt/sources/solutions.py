"""Readers and writers of complete states.

Parquet partitioned by k and combo, with a six-bit bucket of the code's digest, is the
engine's own form; text and binary files are read for exchange.  gzip and zstd files are
decompressed by the reader, and a damaged one is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquilt.functions import states, text
from polyquilt.functions.states import STATE_SCHEMA, frame
from polyquilt.operators import canon
from polyquilt.operators.reconcile import bucket_of

HEADER = "Number of polygons:"
PARSED = "vertices string, signature string, title string, conway string, cycles array<string>, assembled string, error string"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """S3: one row a record of a text file; a record cut short has its ``error`` and no other doubtful fields.

    Spark splits files at the header line, so that a large file is read in parallel.
    """
    raw = spark.read.option("lineSep", HEADER).text(path).filter(F.trim(F.translate("value", "\r\n\t", "   ")) != "")
    lines = F.split("value", "\r?\n")
    own = raw.select(lines.alias("l"), F.array_position(lines, "---").cast("int").alias("end"))
    at = lambda i: F.get("l", F.lit(i))
    error = F.when(F.size("l") < 5, "truncated header").when(F.col("end") < 6, "truncated cycles").when(F.coalesce(F.get("l", F.col("end")), F.lit("")) == "", "missing assembled text")
    cycles = F.when(F.col("end") > 5, F.slice("l", 6, F.col("end") - 6))
    return own.select(at(1).alias("vertices"), at(2).alias("signature"), at(3).alias("title"), at(4).alias("conway"), cycles.alias("cycles"), F.get("l", F.col("end")).alias("assembled"), error.alias("error"))


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        types, glue, errors = [], [], []
        for v, c, e in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            state = None if e or v is None or c is None else text.decode(v, c)
            types.append(list(state[0]) if state else None)
            glue.append(state[1] if state else None)
            errors.append(e or (None if state else "vertex line and Conway text do not fit"))
        yield pa.RecordBatch.from_arrays([pa.array(types, pa.list_(pa.int32())), pa.array(glue, pa.list_(pa.int32())), pa.array(errors, pa.string())], names=["types", "glue", "error"])


def decode_text(records: DataFrame) -> DataFrame:
    """F14 over a table: (types, glue, error)."""
    return records.select("vertices", "conway", "error").mapInArrow(_decoded, STATE_SCHEMA + ", error string")


def records(data: bytes, complete: bool = True) -> Iterator[tuple[list[int], list[int]]]:
    """The packed states of a binary file end to end; anything left over is an error."""
    at = 0
    while at < len(data):
        wide = data[at] == 0
        if len(data) < at + (6 if wide else 2):
            raise ValueError("truncated state header")
        k, n = (int.from_bytes(data[at + 2 : at + 4], "little"), int.from_bytes(data[at + 4 : at + 6], "little")) if wide else (data[at], data[at + 1])
        size = (6 if wide else 2) + k + 2 * n
        types, glue = states.unpack(data[at : at + size])
        if complete and -1 in glue:
            raise ValueError("solution has a free dart")
        yield types, glue
        at += size


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(types, glue) of binary files; a file is one task's, as its records have no marks to split at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                found = list(records(data.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.list_(pa.int32())), pa.array([g for _, g in found], pa.list_(pa.int32()))], names=["types", "glue"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, STATE_SCHEMA)


def invalid(rows: DataFrame) -> DataFrame:
    """F16 in expressions: rows whose glue is no involution within bounds."""
    n = F.size("glue")
    inside = F.forall("glue", lambda g: (g >= -1) & (g < n))
    back = F.forall(F.zip_with("glue", F.sequence(F.lit(0), n - 1), lambda g, i: F.when(g < 0, True).otherwise(F.get("glue", g) == i)), lambda x: F.coalesce(x, F.lit(False)))
    return rows.filter(~F.coalesce(inside & back, F.lit(False)))


TEXT_FIELDS = "vertices string, signature string, file_signature string, count_signature string, conway string"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(tuple(t), g) for t, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        fields = [(text.vertex_line(t), text.signature(t), text.file_signature(t), text.count_signature(t), text.conway(frame(t), g)) for t, g in rows]
        columns = [pa.array([x[k] for x in fields], pa.string()) for k in range(5)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "vertices", "signature", "file_signature", "count_signature", "conway"])


def with_texts(rows: DataFrame) -> DataFrame:
    """F4-F10 over (types, glue, ...): built for survivors only, after dedup."""
    rest = [c for c in rows.columns if c not in ("types", "glue")]
    own = rows.select("types", "glue", *rest)
    return own.mapInArrow(_texts, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema) + ", " + TEXT_FIELDS)


def write(rows: DataFrame, path: str) -> None:
    """K1, K2, K7: partitioned Parquet, published whole by the output committer; an existing path is refused."""
    own = rows.withColumn("bucket", bucket_of(F.sha2("code", 256)))
    own.repartition("k", "combo").sortWithinPartitions("k", "combo", "bucket").write.option("compression", "zstd").partitionBy("k", "combo").parquet(path)


def read(spark: SparkSession, path: str, combo: str | None = None, buckets: tuple[int, int] | None = None) -> DataFrame:
    """Pruned by partition (combo) and by row-group statistics (bucket)."""
    rows = spark.read.parquet(path)
    if combo is not None:
        rows = rows.filter(F.col("combo") == combo)
    return rows if buckets is None else rows.filter((F.col("bucket") >= buckets[0]) & (F.col("bucket") < buckets[1]))


def to_text(rows: DataFrame) -> DataFrame:
    """One text a result of (types, glue, vertices, signature, count_signature, file_signature, conway), with its document's cycles and assembled Conway text.

    A result whose polygons make no document is an error, as its text would lack them.
    """
    from polyquilt.functions.text import faces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [faces(frame(tuple(t)), g) for t, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array([lines for _, _, lines in made], pa.list_(pa.string())), pa.array([x for _, x, _ in made], pa.string())], names=[*names, "cycles", "assembled"])

    names = ["vertices", "signature", "count_signature", "file_signature", "conway"]
    own = rows.select("types", "glue", *names).mapInArrow(run, ", ".join(f"{n} string" for n in names) + ", cycles array<string>, assembled string")
    # fixed values: the order of the lines, and what stands before the count signature and after the cycles
    lines = ("vertices", "signature", F.concat(F.lit("Count type: "), "count_signature"), F.concat(F.lit("eu "), "file_signature"), "conway")
    return own.select(F.concat(F.concat_ws("\n", *lines, "cycles"), F.lit("\n---\n"), F.col("assembled"), F.lit("\n")).alias("value"))


def wl_unique(rows: DataFrame, rounds: int = 100, trust_hash: bool = False) -> DataFrame:
    """One row for each isomorphism class of (k, types, glue): by WL hash, confirmed pair by pair unless the hash is trusted.

    Representatives of one hash stay in a list; every hash is its own group, and groups of one are the rule.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [canon.wl_hash(frame(tuple(t)), g, rounds) for t, g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h, pa.binary())], names=["k", "types", "glue", "wl"])

    def confirmed(table: pa.Table) -> pa.Table:
        kept: list[int] = []
        forms = [(frame(tuple(t)), g) for t, g in zip(table["types"].to_pylist(), table["glue"].to_pylist(), strict=True)]
        for i, (f, g) in enumerate(forms):
            if not any(canon.isomorphic(f, g, *forms[j]) for j in kept):
                kept.append(i)
        return table.select(["k", "types", "glue"]).take(pa.array(kept, pa.int64()))

    own = rows.select(F.col("k").cast("int"), "types", "glue").mapInArrow(hashed, "k int, " + STATE_SCHEMA + ", wl binary")
    if trust_hash:
        return own.groupBy("k", "wl").agg(F.min(F.struct("types", "glue")).alias("s")).select("k", "s.types", "s.glue")
    return own.groupBy("k", "wl").applyInArrow(confirmed, "k int, " + STATE_SCHEMA)


def word_unique(rows: DataFrame) -> DataFrame:
    """One row for each breadth-first word."""

    def worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = [canon.word(frame(tuple(t)), g) for t, g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(w, pa.list_(pa.int32()))], names=["k", "types", "glue", "word"])

    own = rows.select(F.col("k").cast("int"), "types", "glue").mapInArrow(worded, "k int, " + STATE_SCHEMA + ", word array<int>")
    return own.groupBy("k", "word").agg(F.min(F.struct("types", "glue")).alias("s")).select("k", "s.types", "s.glue")
