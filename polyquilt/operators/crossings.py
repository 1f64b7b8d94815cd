"""Properly crossing pairs of segments, by their meeting in the cells of a grid.

Segments are rows (by, id, x1, y1, x2, y2) with whole coordinates within +-2**28.  Two of one
``by`` cross if each one's ends lie strictly on different sides of the other's line, which is
decided exactly by the signs of integer determinants; touching, overlapping and equal
segments do not cross.  A segment is laid into the cells that it runs through, so a long one
costs its length and not its box.  A pair counts in one cell only, that of the crossing
point, found by division (exactly where it is near an edge); so no pair is made distinct later.
Pairs are as many as the square of a cell's segments, so they are made in tasks, by array steps of
a bounded number of pairs; tasks are dealt by their pairs, and a large cell by pairs of its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Segments of a cell that meet in one group with each other, and with as many of another block.
BLOCK = 4096
#: Pairs of a task, about, and of a step in it.
PAIRS, STEP = 20_000_000, 1 << 19


def cells(segments: DataFrame, size: int) -> DataFrame:
    """``segments`` once for each cell (cx, cy) of width ``size`` that they may run through."""
    c = F.lit(size).cast("long")
    down = lambda x: F.floor(x / c).cast("long")
    low, high = F.least("x1", "x2"), F.greatest("x1", "x2")
    own = segments.withColumn("cx", F.explode(F.sequence(down(low), down(high))))
    left, right = F.greatest(low, F.col("cx") * c), F.least(high, (F.col("cx") + 1) * c)
    slope = (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))
    at = lambda x: F.when(F.col("x1") != F.col("x2"), F.col("y1") + (x - F.col("x1")) * slope)
    ends = [F.coalesce(at(left), F.least("y1", "y2")), F.coalesce(at(right), F.greatest("y1", "y2"))]
    bottom = F.greatest(F.least(*ends) - 1, F.least("y1", "y2"))  # a unit of room for rounding
    top = F.least(F.greatest(*ends) + 1, F.greatest("y1", "y2"))
    return own.withColumn("cy", F.explode(F.sequence(down(bottom), down(top))))


def _dealt(laid: DataFrame) -> DataFrame:
    """``laid`` dealt to groups (by, cx, cy, i, j), sorted: each two of a cell's blocks of ``o`` meet in one group.  A cell of up to ``BLOCK`` segments is one block."""
    cell = ["by", "cx", "cy"]
    counts = laid.groupBy(*cell).agg(F.count("*").alias("n"))
    pairs = counts.agg(F.sum(F.col("n").cast("double") * F.col("n") / 2)).first()[0] or 0
    tasks = max(2 * laid.sparkSession.sparkContext.defaultParallelism, int(pairs / PAIRS) + 1)  # by pairs: Spark would deal them by bytes, of which there are few
    large = counts.filter(F.col("n") > BLOCK).select(*cell, F.ceil(F.col("n") / BLOCK).alias("k"))
    met = laid.join(large, cell, "left").withColumn("k", F.coalesce("k", F.lit(1)).cast("int")).withColumn("o", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    met = met.withColumn("_r", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumns({"i": F.least("o", "_r"), "j": F.greatest("o", "_r")})
    group = [*cell, "i", "j"]
    return met.select(*group, "o", "id", "x1", "y1", "x2", "y2").repartition(tasks, *group).sortWithinPartitions(*group, "o", "id")


def _cell(at: np.ndarray, to: np.ndarray, n: np.ndarray, m: np.ndarray, size: int) -> np.ndarray:
    """The cell of at + (to - at) * n / (n + m), in floating point but within a millionth of an edge."""
    about = (at + (to - at) * (n / (n.astype(float) + m))) / size
    out = np.floor(about).astype(np.int64)
    for k in np.flatnonzero(np.abs(about - np.rint(about)) < 1e-6).tolist():
        a, d = int(at[k]), int(n[k]) + int(m[k])
        out[k] = (a * d + (int(to[k]) - a) * int(n[k])) // (d * size)
    return out


def _crossed(rows: pa.Table, size: int) -> Iterator[pa.Table]:
    """(by, a, b) of whole groups, in steps of about ``STEP`` pairs."""
    keys = [np.asarray(rows["by"].combine_chunks().dictionary_encode().indices), *[np.asarray(rows[c]) for c in ("cx", "cy", "i", "j")]]
    cx, cy, i, j = keys[1:]
    o, x1, y1, x2, y2 = (np.asarray(rows[c]) for c in ("o", "x1", "y1", "x2", "y2"))
    ids = rows["id"].to_numpy()
    new = np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]
    heads = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    end = np.r_[heads[1:], len(new)][group]
    # where a group joins two blocks, those of the first meet the second's
    split = end - np.bincount(group, weights=o == j, minlength=len(heads)).astype(np.int64)[group]
    start = np.where(i == j, np.arange(len(new)) + 1, np.where(o == i, split, end))
    sums = np.cumsum(end - start)
    at = 0
    while at < len(new):
        upto = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + STEP, "right")))
        n = (end - start)[at:upto]
        p = np.repeat(np.arange(at, upto), n)
        q = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[at:upto], n)
        at = upto
        for one, other in ((0, 1), (1, 0)):  # ends of the second on both sides of the first's line, and the other way about
            u, v = (p, q)[one], (p, q)[other]
            dx, dy = (x2 - x1)[u], (y2 - y1)[u]
            s1, s2 = dx * (y1[v] - y1[u]) - dy * (x1[v] - x1[u]), dx * (y2[v] - y1[u]) - dy * (x2[v] - x1[u])
            on = ((s1 < 0) & (s2 > 0)) | ((s1 > 0) & (s2 < 0))
            p, q, n, m = p[on], q[on], np.abs(s1[on]), np.abs(s2[on])
        here = (_cell(x1[p], x2[p], n, m, size) == cx[p]) & (_cell(y1[p], y2[p], n, m, size) == cy[p]) & (ids[p] != ids[q])
        p, q = p[here], q[here]
        a = np.where(ids[p] < ids[q], p, q)
        yield pa.table({"by": rows["by"].take(pa.array(p)), "a": rows["id"].take(pa.array(a)), "b": rows["id"].take(pa.array(p + q - a))})


def _pairs(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last group may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            group = lambda b, k: [b.column(c)[k].as_py() for c in range(5)]
            if held and group(held[-1], held[-1].num_rows - 1) == group(batch, 0) == group(batch, batch.num_rows - 1):
                held.append(batch)
                continue
            rows = pa.Table.from_batches([*held, batch])
            last = group(batch, batch.num_rows - 1)
            low, high = 0, batch.num_rows - 1  # where the last group begins in the batch
            while low < high:
                mid = (low + high) // 2
                low, high = (low, mid) if group(batch, mid) == last else (mid + 1, high)
            whole = rows.num_rows - batch.num_rows + low
            if low == 0 and held and group(held[-1], held[-1].num_rows - 1) == last:
                whole = 0
            for out in _crossed(rows.slice(0, whole), size) if whole else ():
                yield from out.to_batches()
            held = rows.slice(whole).combine_chunks().to_batches()
        if held:
            for out in _crossed(pa.Table.from_batches(held), size):
                yield from out.to_batches()

    return run


def crossing_pairs(segments: DataFrame, size: int) -> DataFrame:
    """(by, a, b), a < b: ids of the segments of one ``by`` that cross properly; rows with a null are ignored."""
    whole = segments.select("by", "id", *[F.col(c).cast("long") for c in ("x1", "y1", "x2", "y2")]).dropna()
    kind = {f.name: f.dataType for f in whole.schema}
    out = StructType([StructField("by", kind["by"]), StructField("a", kind["id"]), StructField("b", kind["id"])])
    return _dealt(cells(whole, size)).mapInArrow(_pairs(size), out)


def cell_size(segments: DataFrame) -> int:
    """A width near the segments' mean extent: one aggregation, one number."""
    span = F.avg(F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1")))
    return max(1, int(segments.agg(span).first()[0] or 1))
