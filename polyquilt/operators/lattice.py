"""A18 + F53 over rows: the lattice that whole vectors generate, as a mergeable aggregate.

A lattice is kept as its Hermite normal form: rows in echelon form, pivots positive, entries
above a pivot reduced to 0 .. pivot - 1.  The form is unique, so the order of rows and of
merges does not matter.  Each task reduces its rows to forms, one a group for every ``HELD``
rows at most; forms are then merged by group, those of many groups at once and pairwise, so
steps over arrays are as many as digits and the logarithm of the largest group.  Arithmetic
is in 64 bits while products fit, else in whole numbers of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task reduces at a time before it passes their forms on.
HELD = 50_000
#: What a product in 64 bits may be.
ROOM = 4e18

Form = list[list[int]]


def insert(form: Form, vector: list[int]) -> None:
    """Add a vector to an echelon form, in place: at each pivot Euclid's steps leave the gcd and a shorter vector."""
    v, at = list(vector), 0
    for place in range(len(v)):
        if not v[place]:
            if at < len(form) and form[at][place]:
                at += 1
            continue
        if at == len(form) or not form[at][place]:
            form.insert(at, [-x for x in v] if v[place] < 0 else v)
            return
        row = form[at]
        while v[place]:
            q = row[place] // v[place]
            row, v = v, [a - q * b for a, b in zip(row, v)]
        form[at] = [-x for x in row] if row[place] < 0 else row
        at += 1


def reduced(form: Form) -> Form:
    """The unique form: entries above each pivot in 0 .. pivot - 1."""
    out = [list(r) for r in form]
    for k, row in enumerate(out):
        pivot = next(i for i, x in enumerate(row) if x)
        for above in out[:k]:
            q = above[pivot] // row[pivot]
            above[:] = [a - q * b for a, b in zip(above, row)]
    return out


def hermite(vectors: list[list[int]]) -> Form:
    form: Form = []
    for v in vectors:
        insert(form, v)
    return reduced(form)


def _less(rows: np.ndarray, times: np.ndarray, others: np.ndarray) -> np.ndarray:
    """rows - times * others, row by row; an error where 64 bits may not hold it."""
    if rows.dtype != object and len(rows) and (np.abs(times.astype(float))[:, None] * np.abs(others.astype(float)) + np.abs(rows.astype(float))).max() > ROOM:
        raise OverflowError
    return rows - times[:, None] * others


def insert_all(forms: np.ndarray, vectors: np.ndarray) -> None:
    """``insert`` of one vector into each of many forms (n x c x c, the row of pivot k in place k or 0), in place; vectors are used up."""
    for place in range(forms.shape[1]):
        while len(at := np.flatnonzero(vectors[:, place] != 0)):
            row, v = forms[at, place], vectors[at]
            vectors[at] = _less(row, row[:, place] // v[:, place], v)
            forms[at, place] = v
        turned = np.flatnonzero(forms[:, place, place] < 0)
        forms[turned, place] = -forms[turned, place]


def merge_all(codes: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One reduced form for each of the ascending ``codes``: neighbours of a group are merged two by two until one is left."""
    width = forms.shape[1]
    while len(codes) and (codes[1:] == codes[:-1]).any():
        heads = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        place = np.arange(len(codes)) - np.repeat(heads, np.diff(np.r_[heads, len(codes)]))
        odd = np.flatnonzero(place % 2 == 1)
        mine = forms[odd - 1]
        for k in range(width):
            insert_all(mine, forms[odd, k].copy())
        forms[odd - 1] = mine
        stay = place % 2 == 0
        codes, forms = codes[stay], forms[stay]
    for k in range(width):
        for above in range(k):
            at = np.flatnonzero(forms[:, k, k] != 0)
            forms[at, above] = _less(forms[at, above], forms[at, above, k] // forms[at, k, k], forms[at, k])
    return codes, forms


def _combined(table: pa.Table, width: int) -> pa.RecordBatch:
    """(by, form) of the rows' groups, in order of first rows; values are vectors of ``width`` or forms of its square."""
    keys = table.column(0).combine_chunks().dictionary_encode(null_encoding="encode")
    codes = np.asarray(keys.indices)
    values = table.column(1).combine_chunks().flatten()
    order = np.argsort(codes, kind="stable")
    per = len(values) // max(len(codes), 1)

    def merged(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        numbers = numbers.reshape(len(codes), per)[order]
        if per == width * width and width > 1:
            return merge_all(codes[order], numbers.reshape(-1, width, width))
        forms = np.zeros((len(codes), width, width), numbers.dtype)
        insert_all(forms, numbers.copy())
        return merge_all(codes[order], forms)

    try:
        numbers = np.array(values.cast(pa.int64()))
        if len(numbers) and np.abs(numbers.astype(float)).max() > ROOM:
            raise OverflowError
        own, forms = merged(numbers)
        flat = pa.array(forms.ravel()).cast(pa.decimal128(38, 0))
    except (OverflowError, pa.ArrowInvalid):
        own, forms = merged(np.array([int(x) for x in values.to_pylist()], object))
        flat = pa.array(forms.ravel().tolist(), pa.decimal128(38, 0))
    offsets = pa.array(np.arange(len(own) + 1, dtype=np.int32) * width * width)
    return pa.record_batch([keys.dictionary.take(pa.array(own)), pa.ListArray.from_arrays(offsets, flat)], names=["by", "form"])


def basis(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, rank, basis): for each group the Hermite form of its vectors' lattice, rows as arrays of decimals.

    A vector with a null is ignored (a group of such has rank 0); values must be whole.
    """
    width = len(columns)
    kind = rows.schema[by].dataType.simpleString()
    schema = f"by {kind}, form array<decimal(38,0)>"
    short = all(rows.schema[c].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") for c in columns)
    number = "bigint" if short else "decimal(38,0)"
    known = F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
    own = rows.select(F.col(by).alias("by"), F.array(*[F.when(known, F.col(c).cast(number)).otherwise(F.lit(0).cast(number)) for c in columns]).alias("form"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= HELD:
                yield _combined(pa.Table.from_batches(held), width)
                held = []
        if any(b.num_rows for b in held):
            yield _combined(pa.Table.from_batches(held), width)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches sorted by group: the last group of each waits for the next."""
        waiting: pa.RecordBatch | None = None
        for batch in batches:
            if batch.num_rows:
                batch = batch.cast(pa.schema([("by", batch.schema.field(0).type), ("form", pa.list_(pa.decimal128(38, 0)))]))
                made = _combined(pa.Table.from_batches([batch] if waiting is None else [waiting, batch]), width)
                waiting = made.slice(made.num_rows - 1).cast(batch.schema)
                yield made.slice(0, made.num_rows - 1)
        if waiting is not None:
            yield waiting

    met = own.mapInArrow(part, schema).repartition("by").sortWithinPartitions("by").mapInArrow(last, schema)
    lines = F.array_compact(F.array(*[F.when(F.col("form")[k * width + k] != 0, F.slice("form", k * width + 1, width)) for k in range(width)]))
    return met.select(F.col("by").alias(by), lines.alias("basis")).select(by, F.size("basis").alias("rank"), "basis")
