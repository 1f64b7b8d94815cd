"""Labels, signatures, Conway texts and tiling documents."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from polyquilt.functions import catalog
from polyquilt.functions.states import Frame, frame

SIZES = (3, 4, 6, 12)
INT_MAX = 2**31 - 1


def tile_suffix(tile: int) -> str:
    """Up to three apostrophes, beyond that @ and the number."""
    return "'" * tile if tile <= 3 else f"@{tile}"


def label(f: Frame, dart: int) -> str:
    """F7."""
    return f.labels[dart] + tile_suffix(f.tile[dart]) if 0 <= dart < len(f) else "?"


def combo(types: tuple[int, ...]) -> str:
    """F2."""
    held = {s for t in types for s in catalog.vertex_types()[t].size}
    return f"{len(types):02d}_" + "".join("c" if s == 12 else str(s) for s in SIZES if s in held)


def _counted(types: tuple[int, ...], name, times, between: str) -> str:
    return between.join(name(t) + (times(n) if n > 1 else "") for t in sorted(set(types)) for n in [types.count(t)])


def signature(types: tuple[int, ...]) -> str:
    """F4."""
    return _counted(types, lambda t: catalog.vertex_types()[t].symbol, lambda n: f"x{n}", ", ")


def file_signature(types: tuple[int, ...]) -> str:
    """F5."""
    return _counted(types, lambda t: catalog.vertex_types()[t].code, str, " ")


def vertex_line(types: tuple[int, ...]) -> str:
    """F6."""
    return ", ".join(catalog.vertex_types()[t].symbol for t in types)


def count_signature(types: tuple[int, ...]) -> str:
    """F10."""
    base = [s[: s.index(")") + 1] for s in (catalog.vertex_types()[t].symbol for t in types)]
    times = sorted((base.count(b) for b in set(base)), reverse=True)
    return str(len(times)) + (f" ({''.join({10: 'a', 11: 'b'}.get(n, chr(48 + n)) for n in times)})" if times[0] > 1 else "")


def pair_symbol(a: str, b: str) -> str:
    """F8: round brackets if both or neither label is starred, else square ones."""
    x, y = a.removeprefix("*"), b.removeprefix("*")
    opening, closing = "()" if a.startswith("*") == b.startswith("*") else "[]"
    return opening + (x if x == y else f"{x} {y}") + closing


def conway(f: Frame, glue: list[int]) -> str:
    """each pair of glued darts once, mirrors included."""
    seen: set[int] = set()
    out = []
    for i, g in enumerate(glue):
        if g != -1 and i not in seen:
            out.append(pair_symbol(label(f, i), label(f, g)))
            seen |= {i, g, f.mirror[i], glue[f.mirror[i]]}
    return "".join(out)


def split_symbol(symbol: str) -> tuple[str, str]:
    """the two labels; a square bracket stars the second."""
    m = re.fullmatch(r"[(\[]([^ )\]]+)(?: ([^)\]]+))?[)\]]", symbol)
    if not m:
        raise ValueError(f"invalid pair {symbol!r}")
    second = m[2] or m[1]
    return m[1], "*" + second if symbol[0] == "[" else second


def parse_label(text: str) -> tuple[bool, int, int]:
    """(starred, number, tile)."""
    m = re.match(r"(\*?)([0-9]*)('*)(?:@([0-9]*))?", text)
    return bool(m[1]), int(m[2] or 0), len(m[3]) + int(m[4] or 0)


def parse_conway(text: str, types: tuple[int, ...]) -> list[int]:
    """the glue that a Conway text describes; darts it does not name stay free."""
    f = frame(types)
    where = {(f.labels[i], f.tile[i]): i for i in reversed(range(len(f)))}
    glue = [-1] * len(f)
    for symbol in re.findall(r"[(\[][^)\]]*[)\]]", text):
        ends = []
        for part in split_symbol(symbol):
            starred, number, tile = parse_label(part)
            at = where.get((("*" if starred else "") + str(number), tile))
            if at is None:
                return glue
            ends.append(at)
        a, b = ends
        glue[a], glue[b] = b, a
        glue[f.mirror[a]], glue[f.mirror[b]] = f.mirror[b], f.mirror[a]
    return glue


def decode(vertices: str, text: str) -> tuple[tuple[int, ...], list[int]] | None:
    """the complete state of a vertex line and a Conway text, or None where they do not fit."""
    number = {t.symbol: t.type_id for t in catalog.vertex_types()}
    names = vertices.rstrip("\r\n").split(", ")
    if any(n not in number for n in names):
        return None
    types = tuple(number[n] for n in names)
    glue = parse_conway(text.rstrip("\r\n"), types)
    return None if -1 in glue else (types, glue)


def combo_k(name: str) -> int:
    """k of a combo, strictly two parts and positive."""
    m = re.fullmatch(r"([0-9]+)_[346c]*", name)
    if not m or not 0 < int(m[1]) <= INT_MAX:
        raise ValueError(f"invalid combo {name!r}")
    return int(m[1])


def legacy_k(name: str) -> int:
    """k of an older record name: its type codes' multiplicities added up; the last part is an index."""
    m = re.fullmatch(r"eu_(?:raw_)?((?:[^_]+_)+)[0-9]+", name)
    codes = {t.code for t in catalog.vertex_types()}
    k = 0
    for part in m[1].rstrip("_").split("_") if m else ():
        times = part[2:] or "1"
        if part[:2] not in codes or not times.isdigit() or int(times) < 1:
            raise ValueError(f"invalid legacy name {name!r}")
        k += int(times)
    if not 0 < k <= INT_MAX:
        raise ValueError(f"invalid legacy name {name!r}")
    return k


def parse_range(spec: str, most: int = 20) -> list[int]:
    """The distinct numbers of a list like 1-3,5, in order, each from 1 to ``most``."""
    out: set[int] = set()
    for part in spec.split(","):
        m = re.fullmatch(r"\s*([0-9]+)(?:-([0-9]+))?\s*", part)
        if not m:
            raise ValueError(f"invalid range {part!r}")
        a, b = int(m[1]), int(m[2] or m[1])
        if not 1 <= a <= b <= most:
            raise ValueError(f"range {part!r} is not within 1..{most}")
        out |= set(range(a, b + 1))
    return sorted(out)


# --- tiling descriptions ---


@dataclass
class Tiling:
    """Polygons with their sides and repeats; each pattern edge meets (polygon, pattern edge, mirrored)."""

    sides: list[int]
    repeats: list[int]
    meets: list[list[tuple[int, int, bool] | None]] = field(default_factory=list)

    def pattern(self, tile: int, edge: int) -> int:
        return edge % (self.sides[tile] // self.repeats[tile])


def parse_reference(text: str) -> tuple[int, int]:
    """(tile, edge) of a reference like 3'' or 3@7."""
    m = re.fullmatch(r"([0-9]+)(?:@([0-9]+)|('*))", text)
    if not m:
        raise ValueError(f"invalid edge reference {text!r}")
    edge, tile = int(m[1]), int(m[2]) if m[2] else len(m[3] or "")
    if max(edge, tile) > INT_MAX:
        raise ValueError("number is out of range")
    return tile, edge


#: A pair of a Conway text: one or two references in round brackets, or in square ones where it is mirrored.
_PAIR = re.compile(r"\s*(?:\(\s*(?P<plain>[^()\[\]]*?)\s*\)|\[\s*(?P<mirrored>[^()\[\]]*?)\s*\])")


def make_tiling(sides: list[int], repeats: list[int] | None, pairs: str) -> Tiling:
    """A checked description from polygon sides, repeats and a Conway text."""
    repeats = repeats or [1] * len(sides)
    if not sides or len(sides) != len(repeats):
        raise ValueError(f"{len(sides)} polygons with {len(repeats)} repeats")
    odd = [(s, r) for s, r in zip(sides, repeats, strict=True) if s not in (3, 4, 6, 12) or r < 1 or s % r]
    if odd:
        raise ValueError(f"polygons (sides, repeat) that cannot be developed: {odd}")
    free = {(tile, edge) for tile, (s, r) in enumerate(zip(sides, repeats, strict=True)) for edge in range(s // r)}
    t = Tiling(sides, repeats, [[None] * (s // r) for s, r in zip(sides, repeats, strict=True)])
    at, text = 0, pairs.rstrip()
    while at < len(text):
        m = _PAIR.match(text, at)
        if not m:
            raise ValueError(f"no pair of references at {at} of the Conway text")
        at = m.end()
        ends = [parse_reference(x) for x in (m["plain"] or m["mirrored"] or "").split()]
        if not 1 <= len(ends) <= 2:
            raise ValueError(f"{m[0].strip()} joins {len(ends)} edges")
        if not free.issuperset(ends):
            raise ValueError(f"{m[0].strip()} names an edge that no polygon has or that is joined already")
        free.difference_update(ends)
        for (tile, edge), other in zip(ends, ends[::-1], strict=True):
            t.meets[tile][edge] = (*other, m["mirrored"] is not None)
    if free:
        raise ValueError(f"edges that nothing meets: {sorted(free)}")
    return t


#: What may stand between two tokens: blanks, and comments to the end of their line.
_GAP = r"(?:\s|##[^\n]*+)*+"
#: The directives of a document, token by token.
_FORMS = {
    "e2": ("e2", r"\."),
    "angleunit": ("angleunit", r"\(", "deg", r"\)"),
    "unittile": ("unittile", r"\(", rf"([0-9]+(?:{_GAP},{_GAP}[0-9]+)*)", r"\)"),
    "conway": ("conway", r"\(", r'"([^"\\]*)"', r"\)"),
    "repeat": ("repeat", r"\(", "([0-9]+)", ",", "([0-9]+)", r"\)"),
}
_FORMS_RE = {name: re.compile(_GAP.join(tokens)) for name, tokens in _FORMS.items()}
#: How often a document has each directive: at least, at most (None: any number).
_TIMES = {"e2": (1, 1), "angleunit": (1, 1), "unittile": (1, None), "conway": (1, 1), "repeat": (0, None)}


def _directives(document: str) -> dict[str, list[tuple[str, ...]]]:
    """The arguments of each directive, in order of the document."""
    found: dict[str, list[tuple[str, ...]]] = {name: [] for name in _FORMS}
    gap = re.compile(_GAP)
    at = gap.match(document).end()
    while at < len(document):
        for name, form in _FORMS_RE.items():
            if m := form.match(document, at):
                break
        else:
            raise ValueError(f"no directive of a document at {at}: {document[at : at + 20]!r}")
        found[name].append(m.groups())
        at = gap.match(document, m.end()).end()
    return found


def parse_document(document: str) -> Tiling:
    """strict parser: e2., angleunit(deg), unittile(...)..., conway("..."), repeat(i,n)."""
    found = _directives(document)
    for name, (least, most) in _TIMES.items():
        if len(found[name]) < least or (most is not None and len(found[name]) > most):
            raise ValueError(f"{name} stands {len(found[name])} times in a document")
    regular = {",".join([str(180 - 360 // s)] * s): s for s in SIZES}
    angles = [re.sub(_GAP + "," + _GAP, ",", a) for (a,) in found["unittile"]]
    angles = [",".join(str(int(x)) for x in a.split(",")) for a in angles]
    if unknown := [a for a in angles if a not in regular]:
        raise ValueError(f"angles of no regular polygon that can be developed: {unknown[0]}")
    repeats = dict((int(tile), int(n)) for tile, n in found["repeat"])
    if len(repeats) < len(found["repeat"]) or any(tile >= len(angles) for tile in repeats):
        raise ValueError("a repeat of a polygon that has one already or is not there")
    return make_tiling([regular[a] for a in angles], [repeats.get(k, 1) for k in range(len(angles))], found["conway"][0][0])


def parse_document_leniently(document: str) -> dict[str, object]:
    """sides, repeats and pairs as far as they can be found."""
    tiles = [len(x.split(",")) for x in re.findall(r"unittile\(([^)]*)\)", document)]
    repeats = {int(a): int(b) for a, b in re.findall(r"repeat\(\s*([0-9]+)\s*,\s*([0-9]+)\s*\)", document)}
    found = re.search(r'conway\("([^"]*)"\)', document)
    return {"sides": tiles, "repeats": [repeats.get(k, 1) for k in range(len(tiles))], "pairs": re.findall(r"[(\[][^)\]]*[)\]]", found[1]) if found else []}


def render_document(t: Tiling, pairs: str, title: str) -> str:
    """F29."""
    lines = [f"## Euclidean, {title}", "e2.", "angleunit(deg)"]
    lines += [f"unittile({','.join([str(180 - 360 // s)] * s)})" for s in t.sides]
    lines.append(f'conway("{pairs}")')
    lines += [f"repeat({k},{r})" for k, r in enumerate(t.repeats) if r > 1]
    return "\n".join(lines) + "\n"


def faces(f: Frame, glue: list[int]) -> tuple[Tiling, str, list[str]]:
    """the polygons of a complete state, the Conway text over their edges, and a line for each.

    A polygon is an orbit of corners under the step to the next one; it is named by its least
    corner, and stands beside its mirror image in the order of the lesser name of both.
    Where no polygon is its own image, one of each two is enough, and edges of a polygon and
    of an image are joined by a mirrored pair.
    """
    step = [glue[r] for r in f.right]
    orbit: dict[int, list[int]] = {}  # name: corners from the least on
    name = [-1] * len(step)
    for corner in range(len(step)):
        if name[corner] < 0:
            orbit[corner] = []
            while name[corner] < 0:
                name[corner] = next(reversed(orbit))
                orbit[name[corner]].append(corner)
                corner = step[corner]
    image = {a: name[f.mirror[f.right[a]]] for a in orbit}
    chiral = all(a != b for a, b in image.items())
    order = sorted(orbit, key=lambda a: (min(a, image[a]), a))
    size = {a: f.size[f.right[a]] for a in orbit}

    def head(place: int, a: int) -> str:
        if image[a] == a:
            return f"{place}: "
        first = place if a < image[a] else place - 1
        text = f"{first // 2}: " if chiral else f"{first}/{first + 1}: "
        return text if first == place else " " * len(text)

    lines = []
    for place, a in enumerate(order):
        times = size[a] // len(orbit[a])
        body = "-".join(f"{label(f, c)}/{label(f, f.right[c])}({f.size[f.right[c]]})" for c in orbit[a])
        lines.append(head(place, a) + (body if times == 1 else f"[{body}]x{times}"))

    kept = [a for a in order if not chiral or a < image[a]]
    # an edge runs from the dart on the right of the corner before to its own corner
    edges = [(f.right[orbit[a][e - 1]], orbit[a][e], f"{e}{tile_suffix(tile)}") for tile, a in enumerate(kept) for e in range(len(orbit[a]))]
    ending, starting = {end: n for _, end, n in edges}, {start: n for start, _, n in edges}
    joined: set[str] = set()
    text = ""
    for start, _, own in edges:
        if own in joined:
            continue
        other = ending.get(start)
        mirrored = other is None
        if mirrored:
            other = starting[f.mirror[start]]
        joined |= {own, other}
        inside = own if own == other else f"{own} {other}"
        text += f"[{inside}]" if mirrored else f"({inside})"
    return make_tiling([size[a] for a in kept], [size[a] // len(orbit[a]) for a in kept], text), text, lines
