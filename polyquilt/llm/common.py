"""Shared pieces of the training-data operators: paths, block iteration, byte-level hashing.

Every operator reads whole texts.  Work in Python runs over *blocks*: slices of
an Arrow batch that hold a bounded number of text bytes (a single longer text is
a block of its own), so a worker's memory does not follow the partition size.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes of one block.
BLOCK_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_POWERS: dict[str, np.ndarray] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Where the session names none, it is one under the warehouse, which a cluster shares
    too; only a local master, whose one machine is driver and executor, gets a temporary one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        found = f"{tempfile.gettempdir()}/polyquilt-checkpoints" if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/polyquilt-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame, sweep: bool = True) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage at a copy that outlives any executor, and lets Spark
    drop the shuffle files behind it (``sweep``: at once; small tables need not).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/polyquilt-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    del df
    if sweep:
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # Spark drops a plan's shuffle files once the driver has collected the plan
    return out


def few(df: DataFrame, rows: int, each: int) -> DataFrame:
    """``df`` in no more last tasks than ``rows`` are worth at ``each`` a task, nor fewer than there are cores.

    A small table is then written as few files, however many partitions a shuffle has; a large one keeps all its tasks.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def free(*tables: DataFrame | None) -> None:
    """Delete tables of ``cut`` that nothing will read any more."""
    for t in tables:
        if t is not None and (path := getattr(t, "_cut_path", None)):
            jvm = t.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def blocks(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``max_bytes`` of ``text``, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = np.cumsum(_lengths(batch.column(batch.schema.get_field_index(text))))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, done + max_bytes, "right")))
            yield batch.slice(at, end - at)
            at = end
    pa.default_memory_pool().release_unused()  # a worker waits for its next task with what it holds


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and n + 1 offsets; null counts as empty."""
    if pa.types.is_large_string(column.type):
        kind, width = np.int64, pa.large_string()
    else:
        kind, width = np.int32, pa.string()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(width)
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def powers(n: int) -> np.ndarray:
    """BASE**i mod 2**64 for i < n."""
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        step = np.full(size, _BASE | np.uint64(1), dtype=np.uint64)
        step[0] = 1
        have = _POWERS["p"] = np.cumprod(step, dtype=np.uint64)
        inverse = np.full(size, np.uint64(pow(int(_BASE | np.uint64(1)), -1, 1 << 64)), dtype=np.uint64)
        inverse[0] = 1
        _POWERS["i"] = np.cumprod(inverse, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multiplications, wrapping."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: The bytes that separate words: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and n + 1 offsets of the texts into the words.

    No separator is part of a longer UTF-8 sequence, so bytes can be split as they are.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit fingerprint of each word: its polynomial in BASE over the bytes, from prefix sums, mixed."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    p = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1 + seed)) * p[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _POWERS["i"][starts] + np.uint64(seed))


def window_hashes(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Rabin-Karp fingerprints of all windows of ``width`` consecutive words (the caller masks text edges)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p = powers(width)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += words[k : k + n] * p[width - 1 - k]
    return mix(out + np.uint64(seed))


def window_texts(word_offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window that lies in one text: the index of its first word, and the text's index."""
    counts = np.maximum(np.diff(word_offsets) - width + 1, 0)
    texts = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return word_offsets[texts] + within, texts


def longs(column: pa.Array, null: int) -> np.ndarray:
    """An integer column as int64; null as ``null``."""
    return np.asarray(column.cast(pa.int64()).fill_null(null), dtype=np.int64)


def no_clash(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with only the columns named (None where it lacks one), free of other columns' names."""
    return df.select(*[F.col(f"`{n}`") if n in df.columns else F.lit(None).alias(n) for n in names])
