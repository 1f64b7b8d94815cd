"""Rows of a graph that no observation tells apart, for many small graphs at once.

Two rows of a graph are alike if they have the same mark and each row next to the one has an
alike row next to the other, and the reverse: the greatest bisimulation.  Each graph keeps,
for every row, a bit for every other row that may still be like it, packed 8 to a byte; bits
are cleared until none changes.  A round clears all rows at once: ``near @ alike`` says which
rows have a neighbour that may be like which row, so what fails is found by a few products
of bit matrices instead of a loop over pairs.

Edges may carry labels; then each label's steps must match by themselves.  A graph is held by
one task at a time (its rows squared, in bits, must fit); graphs are spread over the cluster
by their key, and a task takes them from its sorted rows one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def greatest_bisimulation(marks: list, edges: list[tuple]) -> np.ndarray:
    """Packed alias rows (n x bytes) of ``n`` marked rows and directed, labelled ``edges`` (label, from, to)."""
    n = len(marks)
    number = {m: k for k, m in enumerate(dict.fromkeys(marks))}
    kinds = np.array([number[m] for m in marks])
    steps = {}
    for label, a, b in edges:
        steps.setdefault(label, np.zeros((n, n), np.float32))[a, b] = 1
    alike = np.packbits(kinds[:, None] == kinds[None, :], axis=1)
    waiting = np.ones(n, bool)
    while waiting.any():
        at = np.flatnonzero(waiting)  # rows next to one whose bits were cleared
        before = np.unpackbits(alike, axis=1, count=n).astype(bool)
        after = before.copy()
        for near in steps.values():
            # i follows j if each row next to j is like one next to i; and the reverse
            reach = (near[at] @ before.astype(np.float32)) > 0
            after[at] &= (reach.astype(np.float32) @ near.T) >= near.sum(1)[None, :]
        after &= after.T
        alike = np.packbits(after, axis=1)
        lost = (before != after).any(1)
        waiting = lost.copy()
        for near in steps.values():
            waiting |= near[:, lost].any(1)
        if not lost.any():
            break
    return alike


def least_alike(marks: tuple, edges: tuple) -> list[tuple[int, int]]:
    """Of each row the least row that is like it, and how many are."""
    bits = [np.unpackbits(line, count=len(marks)) for line in greatest_bisimulation(list(marks), list(edges))] if marks else []
    return [(int(b.argmax()), int(b.sum())) for b in bits]


#: Rows of a graph whose answer is kept: small graphs repeat.
SMALL = 12


@lru_cache(maxsize=20_000)
def _kept(marks: tuple, edges: tuple) -> list[tuple[int, int]]:
    return least_alike(marks, edges)


def alike_rows(rows: DataFrame, edges: DataFrame, graph: str, row: str, mark: str) -> DataFrame:
    """(graph, row, least, n): for each row the least row that is like it, and how many are, itself included.

    ``rows`` are (graph, row, mark), ``edges`` (graph, a, b, label; the label may be left out) between
    rows of one graph.  Repeated rows and edges count once; ends that are no rows, and graphs,
    rows and ends that are null, are ignored; a null mark is a mark, a null label a label.
    """
    own = rows.select(F.col(graph).alias("g"), F.col(row).alias("a"), F.col(mark).cast("string").alias("m")).dropna(subset=["g", "a"]).dropDuplicates(["g", "a"])
    label = F.col("label").cast("string") if "label" in edges.columns else F.lit(None).cast("string")
    links = edges.select(F.col(graph).alias("g"), "a", "b", label.alias("m")).dropna(subset=["g", "a", "b"])
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    both = own.select("g", "a", F.lit(None).cast(kinds["a"]).alias("b"), "m").unionByName(links)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: dict[str, pa.DataType] = {}

        def stream() -> Iterator[tuple]:
            for batch in batches:
                types.update({f.name: f.type for f in batch.schema})
                yield from zip(*(c.to_pylist() for c in batch.columns))

        def out(found: list[tuple]) -> pa.RecordBatch:
            cols = zip(*found)
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (types["g"], types["a"], types["a"], pa.int64()))], names=["g", "a", "least", "n"])

        found: list[tuple] = []
        for g, part in groupby(stream(), key=lambda r: r[0]):
            nodes, lines = [], []
            for _, a, b, m in part:
                nodes.append((a, m)) if b is None else lines.append((m, a, b))
            nodes.sort(key=lambda x: x[0])
            place = {a: k for k, (a, _) in enumerate(nodes)}
            number = {m: k for k, m in enumerate(dict.fromkeys(m for _, m in nodes))}
            names = {m: k for k, m in enumerate(dict.fromkeys(m for m, _, _ in lines))}
            steps = tuple(sorted({(names[m], place[a], place[b]) for m, a, b in lines if a in place and b in place}))
            answer = (_kept if len(nodes) <= SMALL else least_alike)(tuple(number[m] for _, m in nodes), steps)
            found += [(g, a, nodes[least][0], n) for (a, _), (least, n) in zip(nodes, answer)]
            if len(found) > 10_000:
                yield out(found)
                found = []
        if found:
            yield out(found)

    made = both.repartition("g").sortWithinPartitions("g").mapInArrow(solve, f"g {kinds['g']}, a {kinds['a']}, least {kinds['a']}, n long")
    return made.select(F.col("g").alias(graph), F.col("a").alias(row), "least", "n")
