"""Token-ID output: best-fit-decreasing packing into id matrices.

Documents are tokenised, dealt to blocks of about ``BLOCK_DOCS`` documents by a hash of
id, length and place in the input, so that rows of one id, or without one, spread like
others; each block is packed by itself, so no task holds more than its block.  In a block:

* a document of more than ``capacity`` tokens is split into full pieces and a rest, in
  order and without loss;
* pieces go, longest first (then by id and piece), to the bin with the least free room
  that holds them.  A segment tree over free room 1..capacity counts the bins at each
  value; descending it finds the best fit in log(capacity) steps;
* each bin becomes a row of ``capacity`` ids, padded with ``pad``.

A row carries ``doc_ids`` and ``pieces`` (whose segment, which piece), ``cu_seqlens``
(0, then the end of each segment), and the matrix row in ``ids`` and ``positions``: 4-byte
and 2-byte little-endian unsigned integers in binary columns, which NumPy reads as they are
(``matrix``).  Positions restart at 0 in each segment (0 in the padding).  Rows of a
document, by piece, give its ids back.

null and empty texts have no tokens and no segment; a null id is carried along;
repeated rows are packed each by itself; a very long text is split, never cut; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquilt.llm import bpe, common

CAPACITY = 2048
BLOCK_DOCS = 4096


class RoomTree:
    """Bins by free room, with the least room of at least n found from a segment tree of counts."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: dict[int, list[int]] = {}

    def put(self, room: int, which: int) -> None:
        self.bins.setdefault(room, []).append(which)
        node = room + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, bin) with the least room >= need, or None."""
        node, count = need + self.size, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.size
        which = self.bins[room].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return room, which


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices into ``sizes``, which must be in descending order and at most ``capacity``."""
    tree, bins = RoomTree(capacity), []
    for k, n in enumerate(sizes):
        found = tree.take(n)
        if found is None:
            bins.append([k])
            room, which = capacity - n, len(bins) - 1
        else:
            room, which = found[0] - n, found[1]
            bins[which].append(k)
        if room:
            tree.put(room, which)
    return bins


def _tokenised(path: str, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "text", bpe.BLOCK_BYTES):
            flat, offsets = bpe.encode_texts(path, block.column(2))
            flat = flat.astype(width)
            own = [flat[a:b].tobytes() for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(own, pa.binary())], names=["block", "key", "ids"])

    return run


def _packed(capacity: int, pad: int, width: str, kind: pa.DataType):
    def run(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        key = table["key"].to_pylist()
        ids = [np.frombuffer(x, width) for x in table["ids"].to_pylist()]
        pieces = [(min(capacity, len(own) - at), k, at // capacity) for k, own in enumerate(ids) for at in range(0, len(own), capacity)]
        rank = sorted(range(len(key)), key=lambda k: (key[k] is None, key[k] or 0, ids[k].tobytes()))
        order = np.empty(len(key), np.int64)
        order[rank] = np.arange(len(key))
        pieces.sort(key=lambda p: (-p[0], order[p[1]], p[2]))
        bins = best_fit([p[0] for p in pieces], capacity)
        matrix = np.full((len(bins), capacity), pad, "<u4")
        places = np.zeros((len(bins), capacity), "<u2")
        who, which, ends, used = [], [], [], []
        steps = np.arange(capacity, dtype="<u2")
        for row, members in enumerate(bins):
            at, cu = 0, [0]
            for n, k, piece in (pieces[m] for m in members):
                matrix[row, at : at + n] = ids[k][piece * capacity : piece * capacity + n]
                places[row, at : at + n] = steps[:n]
                at += n
                cu.append(at)
            who.append([key[pieces[m][1]] for m in members])
            which.append([pieces[m][2] for m in members])
            ends.append(cu)
            used.append(at)
        return pa.table(
            {
                "block": pa.array([block] * len(bins), pa.int32()),
                "pack": pa.array(range(len(bins)), pa.int32()),
                "n_tokens": pa.array(used, pa.int32()),
                "doc_ids": pa.array(who, pa.list_(kind)),
                "pieces": pa.array(which, pa.list_(pa.int32())),
                "cu_seqlens": pa.array(ends, pa.list_(pa.int32())),
                "ids": pa.array([r.tobytes() for r in matrix], pa.binary()),
                "positions": pa.array([r.tobytes() for r in places], pa.binary()),
            }
        )

    return run


def matrix(rows: list[bytes], kind: str = "<u4") -> np.ndarray:
    """The ids (or, with ``<u2``, positions) of packed rows as a matrix."""
    return np.stack([np.frombuffer(r, kind) for r in rows]) if rows else np.zeros((0, 0), kind)


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, pad: int = 0, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(block, pack, n_tokens, doc_ids, pieces, cu_seqlens, ids, positions): the packed rows."""
    if not 0 < capacity <= 65536:
        raise ValueError("capacity must fit two-byte positions")
    blocks = max(1, math.ceil(docs.count() / block_docs))
    width = "<u2" if bpe.vocabulary(path).base < 1 << 16 else "<u4"
    own = docs.select(F.pmod(F.xxhash64(key, F.length(text), F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block"), F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    tokens = own.mapInArrow(_tokenised(path, width), "block int, key bigint, ids binary").filter(F.length("ids") > 0)
    schema = "block int, pack int, n_tokens int, doc_ids array<bigint>, pieces array<int>, cu_seqlens array<int>, ids binary, positions binary"
    return tokens.groupBy("block").applyInArrow(_packed(capacity, pad, width, pa.int64()), schema)


def op8_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` packed into rows of 2,048 token ids."""
    return pack(common.read(spark, sf_dir, "documents"), bpe.word_vocabulary_path())
