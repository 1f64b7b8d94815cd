"""Document and lattice stores as Parquet tables, and JSON exchange."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquilt.functions import codec, geometry, text
from polyquilt.functions.geometry import Record
from polyquilt.functions.states import frame

DOCUMENT = "id bigint, combo string, signature string, filename string, document string"
POINT = "array<bigint>"
LATTICE = f"k int, stable_id binary, t1 {POINT}, t2 {POINT}, seeds array<{POINT}>, seed_count bigint, signature string, source_id bigint"


def documents(results: DataFrame) -> DataFrame:
    """(k, combo, signature, document, cycles, error) of complete states (k, combo, types, glue)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, g in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                t = tuple(t)
                try:
                    tiling, pairs, lines = text.faces(frame(t), g)
                    out.append((text.signature(t), text.render_document(tiling, pairs, text.signature(t)), lines, None))
                except (ValueError, OverflowError) as e:
                    out.append((text.signature(t), None, None, str(e)))
            kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds))], names=["k", "combo", "signature", "document", "cycles", "error"])

    return results.select(F.col("k").cast("int"), "combo", "types", "glue").mapInArrow(run, "k int, combo string, signature string, document string, cycles array<string>, error string")


def write_documents(rows: DataFrame, path: str) -> None:
    """K4: (id, combo, signature, filename, document) by combo, in id order, as zstd Parquet."""
    rows.repartition("combo").sortWithinPartitions("combo", "id").write.option("compression", "zstd").partitionBy("combo").parquet(path)


def documents_after(spark: SparkSession, path: str, start: int, with_documents: bool = True, before: int | None = None) -> DataFrame:
    """Rows with an id over ``start`` (and up to ``before``), in order; documents are read only if asked for."""
    rows = spark.read.parquet(path).filter(F.col("id") > start)
    if before is not None:
        rows = rows.filter(F.col("id") <= before)
    names = ["id", "combo", "signature", "filename"] + ["document"] * with_documents
    return rows.select(*names).orderBy("id")


def identity(rows: DataFrame) -> dict[str, object]:
    """Entry count, greatest id and logical fingerprint; rows stream to the driver in id order, one partition at a time."""
    count, top, low = rows.agg(F.count("*"), F.max("id"), F.min("id")).first()
    if count and low <= 0:
        raise ValueError("ids must be positive")
    ordered = rows.select("id", "combo", "signature", "filename", "document").orderBy("id").toLocalIterator()
    return {"entries": count, "max_id": top or 0, "fingerprint": codec.fingerprint(map(tuple, ordered))}


def extract(rows: DataFrame, folder: str) -> None:
    """One file a row in a local folder; names that leave it, links and existing files are refused; names that clash get `` [id]``."""
    named = rows.withColumn("_twice", F.expr("count(*) OVER (PARTITION BY filename)"))

    def run(part: Iterator) -> None:
        for r in part:
            name = r["filename"] or f"{r['id']}.tes"
            if os.path.basename(name) != name or name in (".", "..") or "\0" in name:
                raise ValueError(f"unsafe file name {name!r}")
            if r["_twice"] > 1:
                stem, dot, end = name.rpartition(".")
                name = f"{stem} [{r['id']}].{end}" if dot else f"{name} [{r['id']}]"
            with open(os.open(os.path.join(folder, name), os.O_WRONLY | os.O_CREAT | os.O_EXCL | os.O_NOFOLLOW, 0o644), "w") as f:
                f.write(r["document"])

    os.makedirs(folder, exist_ok=True)
    named.foreachPartition(run)


def convert_one(document: str | None, combo: str | None) -> tuple[int | None, Record | None, str | None]:
    """F56 on one row: (k, record, error)."""
    try:
        return text.combo_k(combo or ""), geometry.develop(text.parse_document(document or "")), None
    except (ValueError, OverflowError) as e:
        return None, None, str(e)


def convert(rows: DataFrame, fingerprint: str = "") -> DataFrame:
    """Lattice rows of documents, with ``id`` and ``error``: good and bad rows in one table, to be split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, combos, signatures, docs = (batch.column(k).to_pylist() for k in range(4))
            out = [convert_one(d, c) for d, c in zip(docs, combos, strict=True)]
            good = [r is not None for _, r, _ in out]
            point = pa.list_(pa.int64())
            columns = [
                pa.array(ids, pa.int64()),
                pa.array([k for k, _, _ in out], pa.int32()),
                pa.array([codec.document_id(fingerprint, i) if g else None for i, g in zip(ids, good, strict=True)], pa.binary()),
                pa.array([list(r.t1) if r else None for _, r, _ in out], point),
                pa.array([list(r.t2) if r else None for _, r, _ in out], point),
                pa.array([[list(s) for s in r.seeds] if r else None for _, r, _ in out], pa.list_(point)),
                pa.array([len(r.seeds) if r else None for _, r, _ in out], pa.int64()),
                pa.array(signatures, pa.string()),
                pa.array(ids, pa.int64()),
                pa.array([e for _, _, e in out], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "k", "stable_id", "t1", "t2", "seeds", "seed_count", "signature", "source_id", "error"])

    return rows.select(F.col("id").cast("long"), "combo", "signature", "document").mapInArrow(run, "id bigint, " + LATTICE + ", error string")


def check(rows: DataFrame) -> DataFrame:
    """F57 over a table: ``rows`` with the reason why their record is refused, or null."""

    @F.pandas_udf("string")
    def reason(t1, t2, seeds):  # noqa: ANN001, ANN202
        import pandas as pd

        out = [geometry.error_of(Record(tuple(map(int, a)), tuple(map(int, b)), tuple(tuple(map(int, x)) for x in s))) for a, b, s in zip(t1, t2, seeds, strict=True)]
        return pd.Series(out, dtype="object")

    return rows.withColumn("error", reason("t1", "t2", "seeds"))


def by_stable_id(rows: DataFrame, hex_id: str) -> DataFrame:
    """A point lookup that reaches the scan."""
    return rows.filter(F.col("stable_id") == F.unhex(F.lit(codec.parse_hex_id(hex_id).hex())))


def to_json(rows: DataFrame) -> DataFrame:
    """One line of JSON a record, keyed ``kNN_<hex id>``."""
    key = F.concat(F.lit("k"), F.lpad(F.col("k").cast("string"), 2, "0"), F.lit("_"), F.lower(F.hex("stable_id")))
    return rows.select(F.to_json(F.create_map(key, F.struct(F.col("t1").alias("T1"), F.col("t2").alias("T2"), F.col("seeds").alias("Seed")))).alias("value"))


JSON = f"map<string, struct<T1: {POINT}, T2: {POINT}, Seed: array<{POINT}>>>"
_KEY = re.compile(r"k([0-9]{2,})_([0-9a-f]{64})")


def from_json(spark: SparkSession, path: str, legacy_domain: bytes | None = None) -> DataFrame:
    """(name, k, stable_id, t1, t2, seeds, error) of JSON objects, a line or a file each; ``_failures`` become rows with their message.

    Records under older names get ids in ``legacy_domain``, that of the store which they belong to; without it they are errors.
    """
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.filter(F.split("value", r"\n(?=\{)"), lambda x: F.trim(x) != "")).alias("value"))
    # the failures have another shape than records, so they are read apart
    failures = raw.select(F.explode(F.from_json(F.get_json_object("value", "$._failures"), "map<string, string>")).alias("name", "error"))
    bare = F.regexp_replace("value", r',?\s*"_failures"\s*:\s*\{[^{}]*\}', "")
    found = raw.select(F.explode(F.from_json(F.regexp_replace(bare, r"\{\s*,", "{"), JSON, {"mode": "FAILFAST"})).alias("name", "r")).select("name", "r.T1", "r.T2", "r.Seed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, a, b, seeds in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                try:
                    if a is None or b is None or seeds is None or any(len(p) != 4 or None in p for p in (a, b, *seeds)):
                        raise ValueError("a point has four integers")
                    t1, t2 = geometry.normal_basis(tuple(a), tuple(b))
                    r = Record(t1, t2, tuple(sorted(geometry.reduce(tuple(s), t1, t2) for s in seeds)))
                    geometry.check(r)
                    m = _KEY.fullmatch(name)
                    if not m and legacy_domain is None:
                        raise ValueError("an older name needs its store's domain")
                    k, own = (int(m[1]), bytes.fromhex(m[2])) if m else (text.legacy_k(name), codec.legacy_id(name, r, domain=legacy_domain))
                    out.append((k, own, list(t1), list(t2), [list(s) for s in r.seeds], None))
                except (ValueError, OverflowError) as e:
                    out.append((None, None, None, None, None, str(e)))
            point = pa.list_(pa.int64())
            kinds = (pa.int32(), pa.binary(), point, point, pa.list_(point), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds))], names=["name", "k", "stable_id", "t1", "t2", "seeds", "error"])

    good = found.mapInArrow(run, f"name string, k int, stable_id binary, t1 {POINT}, t2 {POINT}, seeds array<{POINT}>, error string")
    return good.unionByName(failures, allowMissingColumns=True)


def matches(generated: DataFrame, references: DataFrame) -> DataFrame:
    """J3 + A17: (id, status, refs): each generated record against references of its k, size and area, then by exact equivalence.

    Both sides have (id, k, t1, t2, seeds); singular references take no part.
    """
    area = F.udf(lambda a, b: list(geometry.area(Record(tuple(a), tuple(b), ()))), "array<bigint>")
    key = lambda d: d.withColumns({"n": F.size("seeds"), "area": area("t1", "t2")})
    left, right = key(generated), key(references).filter("area <> array(0L, 0L)")

    @F.udf("boolean")
    def same(a1, a2, s, b1, b2, u):  # noqa: ANN001, ANN202
        record = lambda x, y, z: Record(tuple(x), tuple(y), tuple(map(tuple, z)))
        return geometry.equivalent(record(a1, a2, s), record(b1, b2, u))

    met = left.join(right.select(F.col("id").alias("ref"), "k", "n", "area", F.col("t1").alias("u1"), F.col("t2").alias("u2"), F.col("seeds").alias("v")), ["k", "n", "area"])
    hits = met.filter(same("t1", "t2", "seeds", "u1", "u2", "v")).groupBy("id").agg(F.sort_array(F.collect_list("ref")).alias("refs"))
    out = left.select("id").join(hits, "id", "left")
    count = F.coalesce(F.size("refs"), F.lit(0))
    return out.select("id", F.when(F.col("refs").isNull(), "unmatched").when(count == 1, "matched").otherwise("ambiguous").alias("status"), "refs")
