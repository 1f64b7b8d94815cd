"""Exhaustive search over gluings.

A *ring* is the run of corners around one face: corner i is followed by the partner of
its right neighbour.  An open ring begins at a free dart and ends at one; a closed ring
returns to its start.

``expand`` makes the children of one state; ``leaves`` walks a whole subtree.  Over a
table, ``solutions`` fans out by rounds until there are enough subtrees, drops subtrees
whose typed partial form was met before, deals the rest and walks each in its own row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquilt.functions import catalog
from polyquilt.functions.states import STATE_SCHEMA, Frame, frame, seed
from polyquilt.operators import canon

State = tuple[tuple[int, ...], list[int]]


def open_rings(f: Frame, glue: list[int]) -> list[tuple[int, int, int, int]] | None:
    """(least dart, first dart, last dart, slack) of each open ring, by least dart; None if any ring is invalid."""
    right, size = f.right, f.size
    seen = bytearray(len(glue))
    out = []
    for begin, partner in enumerate(glue):
        if partner != -1:
            continue
        at, count, least = begin, 0, begin
        wanted = size[right[begin]]
        while True:
            seen[at] = 1
            count += 1
            least = min(least, at)
            end = right[at]
            if size[end] != wanted:
                return None
            if glue[end] == -1:
                break
            at = glue[end]
        if count > wanted:
            return None
        out.append((least, begin, end, wanted - count))
    for begin in range(len(glue)):
        if seen[begin]:
            continue
        at, count = begin, 0
        wanted = size[right[begin]]
        while not seen[at]:
            seen[at] = 1
            count += 1
            if size[right[at]] != wanted:
                return None
            at = glue[right[at]]
        if wanted % count:
            return None
    out.sort()
    return out


def compatible(f: Frame, a: int, b: int) -> bool:
    """Whether two free darts may be glued."""
    return f.selfm[a] == f.selfm[b] and f.size[a] == f.size[f.right[b]] and f.size[b] == f.size[f.right[a]]


def join(f: Frame, glue: list[int], a: int, b: int) -> bool:
    """Glue a to b and their mirrors to each other; False if a mirror is taken otherwise."""
    ma, mb = f.mirror[a], f.mirror[b]
    glue[a], glue[b] = b, a
    if not f.selfm[a]:
        if glue[ma] not in (-1, mb) or glue[mb] not in (-1, ma):
            return False
        glue[ma], glue[mb] = mb, ma
    return True


def settle(f: Frame, glue: list[int], full: bool) -> bool:
    """Close rings without slack and, once all vertices are there, glue darts with one partner, until nothing moves."""
    while True:
        rings = open_rings(f, glue)
        if rings is None:
            return False
        forced = next(((a, b) for _, a, b, slack in rings if slack == 0), None)
        if forced is None and full:
            free = [i for i, g in enumerate(glue) if g == -1]
            for a in free:
                partners = [b for b in free if compatible(f, a, b)]
                if not partners:
                    return False
                if len(partners) == 1:
                    forced = (a, partners[0])
                    break
        if forced is None:
            return True
        a, b = forced
        if f.selfm[a] != f.selfm[b] or not join(f, glue, a, b):
            return False


@cache
def attachments() -> dict[tuple[int, int, bool], list[tuple[int, int]]]:
    """The slots that new vertices offer, by the sizes they need on the other side."""
    out: dict[tuple[int, int, bool], list[tuple[int, int]]] = {}
    for t in catalog.vertex_types():
        for s in range(t.attach_limit):
            out.setdefault((t.size[t.right[s]], t.size[s], t.mirror[s] == s), []).append((t.type_id, s))
    return out


def branch(f: Frame, glue: list[int]) -> int | None:
    """The free dart to settle next: the start of the tightest open ring, or its mirror if that is written starred."""
    rings = open_rings(f, glue)
    best, tightest = None, 13
    for _, begin, _, slack in rings or ():
        if slack < tightest:
            best, tightest = begin, slack
    if best is not None and f.labels[best].startswith("*"):
        best = f.mirror[best]
    return best


def expand(types: tuple[int, ...], glue: list[int], k_max: int) -> Iterator[State]:
    """Children of a state: its branching dart glued to a free dart, or to a slot of a new vertex."""
    f = frame(types)
    a = branch(f, glue)
    if a is None:
        return
    full = len(types) >= k_max
    for b, partner in enumerate(glue):
        if partner == -1 and compatible(f, a, b):
            child = glue.copy()
            if join(f, child, a, b) and settle(f, child, full):
                yield types, child
    if full:
        return
    full = len(types) + 1 >= k_max
    for t, s in attachments().get((f.size[a], f.size[f.right[a]], f.selfm[a]), ()):
        if t < types[0]:
            continue
        wider = (*types, t)
        g = frame(wider)
        child = glue + [-1] * (len(g) - len(f))
        if join(g, child, a, len(f) + s) and settle(g, child, full):
            yield wider, child


def complete(glue: list[int]) -> bool:
    """X15."""
    return -1 not in glue


def leaves(types: tuple[int, ...], glue: list[int], k_max: int) -> Iterator[State]:
    """The complete states of a subtree, depth first; the stack holds one branch's siblings."""
    todo = [(types, glue)]
    while todo:
        state = todo.pop()
        if complete(state[1]):
            yield state
        else:
            todo.extend(expand(*state, k_max))


def _batch(states: list[State], minimal: list[bool] | None = None, codes: list[bytes] | None = None) -> pa.RecordBatch:
    columns = [pa.array([list(t) for t, _ in states], pa.list_(pa.int32())), pa.array([g for _, g in states], pa.list_(pa.int32()))]
    names = ["types", "glue"]
    if codes is not None:
        columns += [pa.array(minimal, pa.bool_()), pa.array(codes, pa.binary())]
        names += ["minimal", "code"]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _states(batch: pa.RecordBatch) -> Iterator[State]:
    for t, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        yield tuple(t), g


CODED = STATE_SCHEMA + ", minimal boolean, code binary"


def _children(k_max: int):
    """One round of X1; complete states pass through.  Rows carry the typed partial form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[State] = []
            for types, glue in _states(batch):
                out.extend([(types, glue)] if complete(glue) else expand(types, glue, k_max))
            forms = [canon.form(frame(t), g, t) for t, g in out]
            yield _batch(out, [m for m, _ in forms], [c for _, c in forms])

    return run


def _finished(k_max: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for state in _states(batch):
                found = list(leaves(*state, k_max))
                forms = [canon.form(frame(t), g) for t, g in found]
                yield _batch(found, [m for m, _ in forms], [c for _, c in forms])

    return run


def seeds(spark: SparkSession) -> DataFrame:
    """One state a type."""
    return spark.createDataFrame([(list(t), g) for t, g in map(seed, range(len(catalog.vertex_types())))], STATE_SCHEMA)


def expand_table(states: DataFrame, k_max: int) -> DataFrame:
    """X1 + X12 over a table: all children, one for each typed partial form."""
    made = states.select("types", "glue").mapInArrow(_children(k_max), CODED)
    return made.groupBy("code").agg(F.min(F.struct("types", "glue")).alias("s")).select("s.types", "s.glue")


def fan_out(spark: SparkSession, k_max: int, target: int) -> DataFrame:
    """Rounds of X1 until there are ``target`` states or all are complete."""
    states = seeds(spark)
    while True:
        count, free = states.agg(F.count("*"), F.count_if(F.array_contains("glue", -1))).first()
        if not free or count >= target:
            return states
        states = expand_table(states, k_max).persist()


def solutions(spark: SparkSession, k_max: int, target: int = 200, tasks: int | None = None) -> DataFrame:
    """(k, combo, types, glue, minimal, code) of all complete states with up to ``k_max`` vertices.

    Subtrees differ much in size, so there are several for each task and they are dealt in turn.
    """
    tasks = tasks or 4 * spark.sparkContext.defaultParallelism
    found = fan_out(spark, k_max, max(target, 2 * tasks)).repartition(tasks).mapInArrow(_finished(k_max), CODED)
    return found.select(F.size("types").alias("k"), combo_column(F.col("types")).alias("combo"), "types", "glue", "minimal", "code")


def combo_column(types: Column) -> Column:
    """two-digit k and the corner sizes present, 12 as c."""
    held = {s: [t.type_id for t in catalog.vertex_types() if s in t.size] for s in (3, 4, 6, 12)}
    marks = [F.when(F.arrays_overlap(types, F.array(*map(F.lit, ids))), "c" if s == 12 else str(s)).otherwise("") for s, ids in held.items()]
    return F.concat(F.lpad(F.size(types).cast("string"), 2, "0"), F.lit("_"), *marks)


def unique(found: DataFrame) -> DataFrame:
    """G2 + U1: one row for each minimal form of a combo; of equal forms the least state stays, whatever the order of rows."""
    best = found.filter("minimal").groupBy("k", "combo", "code").agg(F.min(F.struct("types", "glue")).alias("s"))
    return best.select("k", "combo", "code", "s.types", "s.glue")


def counts(spark: SparkSession, k_max: int) -> DataFrame:
    """A1: unique results for each k."""
    return unique(solutions(spark, k_max)).groupBy("k").agg(F.count("*").alias("n"))
