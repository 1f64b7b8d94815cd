"""The vertex catalogue: 44 vertex types with their slots, built from a rule.

A type is a corner configuration (c0, ..., c(d-1)) with a symmetry kind.  Its slots are
the edge ends around the vertex, up to the vertex's own symmetry:

* kind F has no symmetry and R only turns: ``period`` slots and their mirror images;
* kinds A and S have a mirror line: ``period`` slots, of which i and (axis - i) modulo
  the period mirror each other.

A turn of order n leaves period = d / n.  Walking right goes around the vertex; mirror
images are walked the other way round, and see the corner on their other side.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from string import ascii_lowercase

from pyspark.sql import DataFrame, SparkSession

#: The types in catalogue order as configuration, kinds, and the mirror axis of kinds A and S.
TYPES = (
    ((3, 12, 12), "A2 F"),
    ((4, 6, 12), ""),
    ((6, 6, 6), "S3:0 R3 A0 F"),
    ((3, 3, 4, 12), ""),
    ((3, 4, 3, 12), "A1 F"),
    ((3, 3, 6, 6), "A2 F"),
    ((3, 6, 3, 6), "S2:1 R2 A3 A1 F"),
    ((3, 4, 4, 6), ""),
    ((3, 4, 6, 4), "A1 F"),
    ((4, 4, 4, 4), "S4:0 R4 S2:0 S2:1 R2 A0 A1 F"),
    ((3, 3, 3, 3, 6), "A1 F"),
    ((3, 3, 3, 4, 4), "A2 F"),
    ((3, 3, 4, 3, 4), "A3 F"),
    ((3, 3, 3, 3, 3, 3), "S6:0 R6 S3:0 S3:1 R3 S2:0 R2 A0 A5 F"),
)


@dataclass(frozen=True)
class VertexType:
    """One type; slots are numbered from 0."""

    type_id: int
    symbol: str
    code: str
    labels: tuple[str, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]
    mirror: tuple[int, ...]
    size: tuple[int, ...]
    attach_limit: int

    @property
    def slots(self) -> int:
        return len(self.labels)


def _suffixes(kinds: list[str], config: tuple[int, ...]) -> list[str]:
    """Names of a configuration's kinds: a number where a letter alone is ambiguous, a and b for the axes of one turn."""
    letters = [k[0] for k in kinds]
    out = []
    for k in kinds:
        letter, rest = k[0], k[1:]
        order = rest.split(":")[0] if letter in "SR" else ""
        same = [x for x in kinds if x[0] == letter]
        name = letter
        if letter in "SR" and letters.count(letter) > 1:
            name += order
            twins = [x for x in same if x[1:].split(":")[0] == order]
            if len(twins) > 1:
                name += "ab"[twins.index(k)]
        elif letter == "A" and len(same) > 1:
            name += str(same.index(k) + 1)
        out.append(name)
    return out


def _slots(config: tuple[int, ...], kind: str) -> tuple[list[str], list[int], list[int], list[int], list[int]]:
    """Labels, left, right, mirror and corner sizes of a type's slots."""
    corners = [config[0], *config[:0:-1]]
    if config == (3, 4, 6, 4):  # this configuration is numbered from its second corner
        corners = corners[1:] + corners[:1]
    letter = kind[:1] or "F"
    order = int(kind[1:].split(":")[0]) if letter in "SR" else 1
    q = len(config) // order
    base = corners[:q]
    if letter in "FR":
        labels = [str(i) for i in range(q)] + [f"*{i}" for i in range(q)]
        right = [(i + 1) % q for i in range(q)] + [q + (i - 1) % q for i in range(q)]
        mirror = [q + i for i in range(q)] + list(range(q))
        size = base + [base[(i + 1) % q] for i in range(q)]
    else:
        axis = int(kind.split(":")[1]) if letter == "S" else int(kind[1:])
        mirror = [(axis - i) % q for i in range(q)]
        labels = [str(i) if i <= m else f"*{m}" for i, m in enumerate(mirror)]
        right = [(i + 1) % q for i in range(q)]
        size = base
    left = [right.index(i) for i in range(len(right))]
    return labels, left, right, mirror, size


def _symmetries(left: list[int], right: list[int], mirror: list[int], size: list[int]) -> int:
    """How many relabellings of the slots keep every relation and size: images of slot 0 that extend to all."""
    found = 0
    for image in range(len(size)):
        where, todo = {0: image}, [0]
        good = True
        while todo and good:
            i = todo.pop()
            good = size[i] == size[where[i]]
            for step in (left, right, mirror):
                a, b = step[i], step[where[i]]
                if a not in where:
                    where[a] = b
                    todo.append(a)
                good = good and where[a] == b
        found += good
    return found


@cache
def vertex_types() -> tuple[VertexType, ...]:
    out: list[VertexType] = []
    seen: dict[int, int] = {}
    for config, spec in TYPES:
        kinds = spec.split() or [""]
        for kind, suffix in zip(kinds, _suffixes([k for k in kinds if k] or ["F"], config) if spec else [""], strict=True):
            labels, left, right, mirror, size = _slots(config, kind)
            symbol = f"({','.join(map(str, config))}){suffix}"
            limit = len(labels) // _symmetries(left, right, mirror, size)
            if symbol in ("(3,6,3,6)A1", "(3,6,3,6)A2"):  # fixed: these two try all their slots
                limit = len(labels)
            n = seen.setdefault(len(config), 0)
            seen[len(config)] += 1
            out.append(VertexType(len(out), symbol, f"{len(config)}{ascii_lowercase[n]}", tuple(labels), tuple(left), tuple(right), tuple(mirror), tuple(size), limit))
    return tuple(out)


def type_rows() -> list[tuple]:
    return [(t.type_id, t.symbol, t.code, t.attach_limit, t.slots) for t in vertex_types()]


def slot_rows() -> list[tuple]:
    return [(t.type_id, s, t.labels[s], t.left[s], t.right[s], t.mirror[s], t.size[s]) for t in vertex_types() for s in range(t.slots)]


TYPE_SCHEMA = "type_id int, symbol string, code string, attach_limit int, slots int"
SLOT_SCHEMA = "type_id int, slot int, label string, left_n int, right_n int, mirror int, polygon_size int"


def type_table(spark: SparkSession) -> DataFrame:
    """One row a type.  44 rows whatever the data, so it may be broadcast."""
    return spark.createDataFrame(type_rows(), TYPE_SCHEMA)


def slot_table(spark: SparkSession) -> DataFrame:
    """One row a slot.  217 rows whatever the data, so it may be broadcast."""
    return spark.createDataFrame(slot_rows(), SLOT_SCHEMA)
