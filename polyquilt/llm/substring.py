r"""Substring dedup: Rabin-Karp fingerprints of every 13-word window, counted over all documents.

A window of a document goes if its word sequence also starts in a document with a
smaller id; the words that removed windows cover go, so overlapping windows merge into
maximal removal intervals.  Windows are judged on the input.

1. Each block of texts sends its distinct (window, document) pairs to fingerprint
   ranges, packed by document, 8 bytes a window.  Of a window that several of the
   block's documents hold only the smallest id is sent; the others are already decided.
   A passage of a third of all documents so sends one entry a block.
2. Each range finds every window's smallest document and answers the other documents
   with the fingerprints to remove.
   Answers travel packed: one row from each range to each part of the documents.
3. Documents meet their answers in their part and drop the covered words.

Fingerprints have 64 bits: with n distinct windows some two collide with a chance of
about n * n / 3.7e19 (0.05 % at 1.4e8 windows).

A text of any length is a block of its own where it is long, and is read whole; an empty
table gives no rows; null texts and texts under 13 words keep all words; a null id counts as larger than all
others (such a row gives way and removes nothing); rows of one id never remove each
other's windows; columns besides key and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquilt.llm import common

WIDTH = 13
NULL_ID = (1 << 63) - 1
#: Text bytes of a block of windows; and of a fingerprint range, from the input's size.
BLOCK_BYTES = 3 << 20
RANGE_BYTES = 12 << 20


def ranges_for(docs: DataFrame, text: str = "text") -> int:
    """So many fingerprint ranges that one holds a bounded share of the input, by the scan's size estimate; where Spark has none, the texts are measured."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 60:
        size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / RANGE_BYTES))


def _windows(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of all windows, the text of each, and offsets of the texts into the words."""
    starts, ends, words = common.word_spans(data, offsets)
    hashes = common.word_hashes(data, starts, ends)
    first, texts = common.window_texts(words, width)
    return common.window_hashes(hashes, width)[first] if len(first) else np.zeros(0, np.uint64), texts, words


def _pack(ids: np.ndarray, hashes: np.ndarray) -> bytes:
    """Entries in order of ids as: number of ids, ids, entries of each, fingerprints."""
    own, counts = np.unique(ids, return_counts=True)
    return np.int64(len(own)).tobytes() + own.tobytes() + counts.astype(np.uint32).tobytes() + hashes.tobytes()


def _unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(payload, np.int64, 1)[0])
    own = np.frombuffer(payload, np.int64, n, 8)
    counts = np.frombuffer(payload, np.uint32, n, 8 + 8 * n)
    return np.repeat(own, counts), np.frombuffer(payload, np.uint64, int(counts.sum()), 8 + 12 * n)


def _sent(width: int, ranges: int, key: str, text: str):
    shift = np.uint64(40)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, text, BLOCK_BYTES):
            ids = common.longs(block.column(0), NULL_ID)
            order = np.argsort(ids, kind="stable")
            block = block.take(pa.array(order))
            ids = ids[order]
            h, texts, _ = _windows(*common.raw(block.column(1)), width)
            if not len(h):
                continue
            sort = np.argsort(h, kind="stable")  # ids ascend within a fingerprint
            h, own = h[sort], ids[texts[sort]]
            new = np.r_[True, h[1:] != h[:-1]]
            least = np.repeat(own[new], np.diff(np.r_[np.flatnonzero(new), len(h)]))
            later = own > least
            later &= np.r_[True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])]
            out: list[tuple[int, bool, bytes]] = []
            # equal parts of the fingerprints' upper 24 bits
            part = ((h >> shift) * np.uint64(ranges)) >> np.uint64(24)
            for decided, pick in ((False, new), (True, later)):
                p, hs, di = part[pick], h[pick], own[pick]
                edges = np.searchsorted(p, np.arange(ranges + 1, dtype=np.uint64))
                for k in np.flatnonzero(np.diff(edges)):
                    a, b = edges[k], edges[k + 1]
                    by = np.argsort(di[a:b], kind="stable")
                    out.append((int(k), decided, _pack(di[a:b][by], hs[a:b][by])))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out]), pa.array([x[2] for x in out], pa.binary())], names=["part", "decided", "payload"])

    return run


def _document_parts(ids: np.ndarray, parts: int) -> np.ndarray:
    return (common.mix(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _answers(parts: int):
    """Of one fingerprint range: for each part of the documents, the fingerprints that its documents lose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple[np.ndarray, np.ndarray]] = []
        gone: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for decided, payload in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                (gone if decided else got).append(_unpack(payload.as_py()))
        if got:
            ids, h = (np.concatenate(x) for x in zip(*got, strict=True))
            got.clear()
            sort = np.argsort(h)
            ids, h = ids[sort], h[sort]
            new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            least = np.repeat(np.minimum.reduceat(ids, new), np.diff(np.r_[new, len(h)]))
            late = ids > least
            gone.append((ids[late], h[late]))
        if gone:
            ids, h = (np.concatenate(x) for x in zip(*gone, strict=True))
            part = _document_parts(ids, parts)
            sort = np.lexsort((ids, part))
            ids, h = ids[sort], h[sort]
            edges = np.searchsorted(part[sort], np.arange(parts + 1))
            own = np.flatnonzero(np.diff(edges))
            packed = [_pack(ids[edges[k] : edges[k + 1]], h[edges[k] : edges[k + 1]]) for k in own]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(packed, pa.binary())], names=["part", "payload"])

    return run


def _squeezed(parts: int):
    """Texts, compressed for their way to their answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            part = _document_parts(common.longs(batch.column(1), NULL_ID), parts)
            own = [pack((t or "").encode()) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(part.astype(np.int32)), pa.array(own, pa.binary())], names=["key", "id", "part", "payload"])

    return run


def removal_intervals(flags: np.ndarray, width: int) -> np.ndarray:
    """Which words the flagged windows cover; runs of covered words are the maximal intervals."""
    cover = np.zeros(len(flags) + width, np.int64)
    at = np.flatnonzero(flags)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return np.cumsum(cover)[:-1] > 0


def _kept(width: int):
    """Of one part of the documents, its answers first: what the documents keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        answers: list[tuple[np.ndarray, np.ndarray]] = []
        ids, gone = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            document = np.asarray(batch.column(3).to_numpy(zero_copy_only=False), bool)
            answers += [_unpack(x.as_py()) for x in batch.column(2).filter(pa.array(~document))]
            batch = batch.filter(pa.array(document))
            if not batch.num_rows:
                continue
            if answers:
                ids, gone = (np.concatenate(x) for x in zip(*answers, strict=True))
                answers = []
                sort = np.argsort(ids, kind="stable")
                ids, gone = ids[sort], gone[sort]
            own = common.longs(batch.column(1), NULL_ID)
            first, last = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
            n_words, n_removed, kept = [], [], []
            for z, a, b in zip(batch.column(2), first.tolist(), last.tolist(), strict=True):
                text = unpack(z.as_py())
                words = text.split()  # bytes split at [\x20\x09-\x0D]
                n_words.append(len(words))
                if b > a and len(words) >= width:
                    data = np.frombuffer(text, np.uint8)
                    h, _, _ = _windows(data, np.array([0, len(data)]), width)
                    cover = removal_intervals(np.isin(h, gone[a:b]), width)
                    words = [w for w, out in zip(words, cover.tolist(), strict=True) if not out]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["key", "n_words", "n_removed", "kept"])

    return run


def removed_windows(docs: DataFrame, parts: int, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(part, payload): ids and fingerprints of the windows that the documents of a part lose, packed; a row from each range."""
    sent = docs.select(F.col(key).cast("long"), text).mapInArrow(_sent(width, parts, key, text), "part int, decided boolean, payload binary")
    return sent.repartitionById(parts, F.col("part")).mapInArrow(_answers(parts), "part int, payload binary")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, n_words, n_removed, kept) of every row: kept words joined by one space."""
    parts = ranges_for(docs, text)
    answers = common.cut(removed_windows(docs, parts, key, text, width))
    own = docs.select(F.col(key).alias("key"), F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    kind = own.schema["key"].dataType.simpleString()
    own = own.mapInArrow(_squeezed(parts), f"key {kind}, id bigint, part int, payload binary").withColumn("document", F.lit(True))
    both = own.unionByName(answers.withColumn("document", F.lit(False)), allowMissingColumns=True)
    met = both.repartitionById(parts, F.col("part")).sortWithinPartitions("document").select("key", "id", "payload", "document")
    return met.mapInArrow(_kept(width), f"key {kind}, n_words bigint, n_removed bigint, kept string").withColumnRenamed("key", key)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left in every whole text of ``documents``."""
    out = dedup(common.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def oracle_sql() -> str:
    return r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
    c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS m FROM g) WHERE m < doc_id),
    w AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS w FROM d),
    k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS kept, count(*) AS n FROM w ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
    SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
    """
