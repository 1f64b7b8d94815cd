"""The dart map that tiling documents describe, as rows.

A pattern edge of a polygon has two darts, one for each sense in which the polygon can be
walked (side 1 and -1).  A plain pair joins darts of one side, a mirrored pair those of
different sides.  The dart to the right of one is the partner of the edge before it, in the
sense of its side; its mirror image is the other dart of its edge.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyquilt.functions.text import parse_document

DARTS = "tile int, edge int, side int, size int, glue_tile int, glue_edge int, glue_side int, right_tile int, right_edge int, right_side int"


def darts(documents: DataFrame, key: str = "id", document: str = "document") -> DataFrame:
    """(key, tile, edge, side, size, glue_*, right_*): each dart with its partner and its right neighbour, as (tile, edge, side) each.

    Null documents have none, wrong ones are errors.  A dart's neighbours stand in its own document, so each is read once and no rows meet.
    """
    kind = documents.schema[key].dataType.simpleString()
    names = ["key", *(c.split()[0] for c in DARTS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = parse_document(text)
                for tile, meets in enumerate(t.meets):
                    for edge in range(len(meets)):
                        for side in (1, -1):
                            near = [(*at, -side if mirrored else side) for *at, mirrored in (meets[edge], meets[(edge - side) % len(meets)])]
                            rows.append((tile, edge, side, t.sides[tile], *near[0], *near[1]))
                keys += [own] * (len(rows) - len(keys))
            columns = list(zip(*rows)) or [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), *(pa.array(c, pa.int32()) for c in columns)], names=names)

    own = documents.select(F.col(key).alias("key"), F.col(document).alias("document")).filter("document IS NOT NULL")
    return own.mapInArrow(run, f"key {kind}, {DARTS}").withColumnRenamed("key", key)
