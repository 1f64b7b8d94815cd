"""States: partial or complete gluings of vertex types.

A state is stored as two arrays, its vertex types and, dart by dart, the glued partner
(-1 while free); everything else follows from the catalogue.  ``Frame`` holds those
derived arrays for one sequence of types and is shared by all states that have it.
"""

from __future__ import annotations

from functools import lru_cache

from polyquilt.functions import catalog

STATE_SCHEMA = "types array<int>, glue array<int>"
MAX_DARTS = 32767


class Frame:
    """Neighbour, mirror and corner arrays of the darts of a sequence of types."""

    __slots__ = ("labels", "left", "mirror", "offsets", "right", "selfm", "size", "tile", "types")

    def __init__(self, types: tuple[int, ...]):
        self.types = types
        self.left: list[int] = []
        self.right: list[int] = []
        self.mirror: list[int] = []
        self.size: list[int] = []
        self.labels: list[str] = []
        self.tile: list[int] = []
        self.offsets: list[int] = []
        for k, t in enumerate(types):
            v, at = catalog.vertex_types()[t], len(self.size)
            self.offsets.append(at)
            self.left += [at + x for x in v.left]
            self.right += [at + x for x in v.right]
            self.mirror += [at + x for x in v.mirror]
            self.size += v.size
            self.labels += v.labels
            self.tile += [k] * v.slots
        self.selfm = [m == i for i, m in enumerate(self.mirror)]

    def __len__(self) -> int:
        return len(self.size)


@lru_cache(maxsize=2_000)
def frame(types: tuple[int, ...]) -> Frame:
    return Frame(types)


def seed(type_id: int) -> tuple[tuple[int, ...], list[int]]:
    """The state of one vertex, all free."""
    return (type_id,), [-1] * catalog.vertex_types()[type_id].slots


def problem(types: list[int] | None, glue: list[int] | None) -> str | None:
    """F16: what is wrong with a stored state, or None."""
    known = catalog.vertex_types()
    if not types or glue is None:
        return "no vertex types, or no gluing"
    if strange := set(types).difference(range(len(known))):
        return f"vertex types that the catalogue lacks: {strange}"
    slots = sum(known[t].slots for t in types)
    if len(glue) != slots or slots > MAX_DARTS:
        return f"{len(glue)} glued darts for {slots} slots, of {MAX_DARTS} at most"
    joined = {(i, g) for i, g in enumerate(glue) if g != -1}
    return None if joined == {(g, i) for i, g in joined} else "darts that are not glued to each other"


def pack(types: list[int], glue: list[int]) -> bytes:
    """A zero byte, the version 2, two counts of two bytes, then a byte a type and two a dart, little-endian."""
    if why := problem(types, glue):
        raise ValueError(why)
    if len(types) > 65535:
        raise ValueError(f"{len(types)} vertices do not fit into two bytes")
    head = b"\x00\x02" + len(types).to_bytes(2, "little") + len(glue).to_bytes(2, "little")
    return head + bytes(types) + b"".join(g.to_bytes(2, "little", signed=True) for g in glue)


def unpack(data: bytes) -> tuple[list[int], list[int]]:
    """The reverse of ``pack``; also the older form, whose header is two one-byte counts."""
    old = data[:1] not in (b"", b"\x00")
    width = 1 if old else 2
    at = 2 * width if old else 6
    if len(data) < at or not (old or data[1] == 2):
        raise ValueError(f"no header of a packed state: {data[:6].hex()}")
    k, n = (int.from_bytes(data[x : x + width], "little") for x in (at - 2 * width, at - width))
    if not (k and 0 < n <= MAX_DARTS) or len(data) != at + k + 2 * n:
        raise ValueError(f"{len(data)} bytes are not a state of {k} vertices and {n} darts")
    types = list(data[at : at + k])
    glue = [int.from_bytes(data[at + k + 2 * i : at + k + 2 * i + 2], "little", signed=True) for i in range(n)]
    if why := problem(types, glue):
        raise ValueError(why)
    return types, glue
