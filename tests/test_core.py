"""Catalogue, states, search, canonical forms, texts, geometry and codecs, without Spark."""

import random
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st

from polyquilt.functions import catalog, codec, geometry, states, text
from polyquilt.functions.states import frame, seed
from polyquilt.operators import canon, reconcile, search


def test_catalogue_checksums():
    types = catalog.vertex_types()
    assert len(types) == 44 and sum(t.slots for t in types) == 217 and sum(t.attach_limit for t in types) == 128
    assert Counter(s for t in types for s in t.size) == {3: 109, 4: 56, 6: 39, 12: 13}
    assert sum(t.mirror[i] == i for t in types for i in range(t.slots)) == 19
    assert sum(x.startswith("*") for t in types for x in t.labels) == 99
    assert len({t.symbol for t in types}) == len({t.code for t in types}) == 44
    assert len({t.symbol[: t.symbol.index(")")] for t in types}) == 14
    assert len(search.attachments()) == 20
    for t in types:
        for i in range(t.slots):
            assert t.right[t.left[i]] == i == t.mirror[t.mirror[i]] and t.right[t.mirror[i]] == t.mirror[t.left[i]]


def all_leaves(k):
    for vt in range(44):
        yield from search.leaves(*seed(vt), k)


@pytest.fixture(scope="module")
def unique():
    found = {}
    for types, glue in all_leaves(3):
        minimal, code = canon.form(frame(types), glue)
        if minimal:
            found.setdefault((len(types), code), (types, glue))
    return found


def test_published_counts(unique):
    assert Counter(k for k, _ in unique) == {1: 10, 2: 20, 3: 61}


def naive(types, glue, k_max):
    """Breadth-first, one child at a time, without forced moves."""
    todo, out = [(types, glue)], set()
    while todo:
        types, glue = todo.pop()
        f = frame(types)
        rings = search.open_rings(f, glue)
        if rings is None:
            continue
        if -1 not in glue:
            minimal, code = canon.form(f, glue)
            if minimal:
                out.add((len(types), code))
            continue
        a = glue.index(-1)
        for b in range(len(glue)):
            if glue[b] == -1 and search.compatible(f, a, b):
                child = glue.copy()
                if search.join(f, child, a, b):
                    todo.append((types, child))
        if len(types) < k_max:
            for t in range(types[0], 44):
                wide = (*types, t)
                g = frame(wide)
                for s in range(len(g) - len(f)):
                    if search.compatible(g, a, len(f) + s):
                        child = glue + [-1] * (len(g) - len(f))
                        if search.join(g, child, a, len(f) + s):
                            todo.append((wide, child))
    return out


@pytest.mark.parametrize("vt", [0, 3, 8, 12, 20, 28, 34, 36])
def test_search_against_naive_expansion(vt):
    found = set()
    for types, glue in search.leaves(*seed(vt), 2):
        minimal, code = canon.form(frame(types), glue)
        if minimal:
            found.add((len(types), code))
    assert found == naive(*seed(vt), 2)


def shuffled(types, glue, rnd):
    """The same structure with its vertices in another order."""
    order = list(range(len(types)))
    rnd.shuffle(order)
    f, g = frame(types), frame(tuple(types[k] for k in order))
    where = {}
    for new, old in enumerate(order):
        for s in range(catalog.vertex_types()[types[old]].slots):
            where[f.offsets[old] + s] = g.offsets[new] + s
    out = [0] * len(glue)
    for i, p in enumerate(glue):
        out[where[i]] = where[p]
    return g.types, out


def test_forms_hashes_and_isomorphism_do_not_depend_on_numbering(unique):
    rnd = random.Random(5)
    picked = rnd.sample(sorted(unique.items(), key=lambda x: (x[0], x[1][0])), 25)
    for (_, code), (types, glue) in picked:
        other = shuffled(types, glue, rnd)
        f, g = frame(types), frame(other[0])
        assert canon.form(g, other[1])[1] == code
        assert canon.word(f, glue) == canon.word(g, other[1])
        assert canon.wl_hash(f, glue) == canon.wl_hash(g, other[1])
        assert canon.isomorphic(f, glue, g, other[1])
    for ((ka, _), a), ((kb, _), b) in zip(picked, picked[1:], strict=False):
        assert not canon.isomorphic(frame(a[0]), a[1], frame(b[0]), b[1])
    small = [(c, s) for (k, c), s in unique.items() if k == 1]
    assert len({canon.wl2_hash(frame(t), g) for _, (t, g) in small}) == len(small)


#: A published id and a published checksum, with the rows that it is of.
STABLE_ID = "8f9e3b66cd530bb42e0fd8c91f3d4d70942b11e52933f27bfb49408e956a94de"
ROWS = [(1, "01_3", "alpha", "first.tes", "first document"), (2, "02_4", "middle", "middle.tes", "mid\0document"), (3, "03_6", "omega", "last.tes", "last document")]
ROWS_SHA256 = "a66371bdea7486ed9919826ecaedca94a28a601d1aaa7467d4f86be5dd4ec0ae"


def test_published_stable_id():
    assert canon.stable_id(frame((0,)), [-1] * 3).hex() == STABLE_ID


def test_vertex_cycles():
    assert [len(c) for c in canon.vertex_cycles(frame((1, 0)))] == [3, 3, 3]


def test_text_round_trips(unique):
    for types, glue in unique.values():
        f = frame(types)
        back = text.decode(text.vertex_line(types), text.conway(f, glue))
        assert back is not None and canon.form(frame(back[0]), back[1]) == canon.form(f, glue)


def test_every_result_develops_and_none_are_equivalent(unique):
    records = []
    for types, glue in unique.values():
        tiling, pairs, lines = text.faces(frame(types), glue)
        assert lines and text.parse_document(text.render_document(tiling, pairs, "x")) == tiling
        records.append(geometry.develop(tiling))
        assert codec.decode_record(codec.encode_record(records[-1])) == records[-1]
    for i, a in enumerate(records):
        for b in records[:i]:
            if len(a.seeds) == len(b.seeds) and geometry.area(a) == geometry.area(b):
                assert not geometry.equivalent(a, b)
        assert geometry.equivalent(a, geometry.image(a, 5, True))


def moved(r, rnd):
    """The record's point set after a turn or reflection and a shift, under another basis of its lattice."""
    out = geometry.image(r, rnd.randrange(12), rnd.random() < 0.5)
    shift = tuple(rnd.randrange(-5, 6) for _ in range(4))
    t1, t2 = out.t1, out.t2
    for _ in range(4):
        t1, t2 = (t2, t1) if rnd.random() < 0.5 else (geometry.add(t1, geometry.scale(rnd.randrange(-2, 3), t2)), t2)
    return geometry.Record(t1, t2, tuple(geometry.add(s, shift) for s in out.seeds))


@pytest.fixture(scope="module")
def tilings_and_records(unique):
    made = []
    for types, glue in unique.values():
        tiling, pairs, _ = text.faces(frame(types), glue)
        made.append((tiling, pairs, geometry.develop(tiling)))
    return made


def test_moves_keep_records_valid_and_equivalent(tilings_and_records):
    rnd = random.Random(3)
    for _, _, r in tilings_and_records:
        other = geometry.canonical(moved(r, rnd))
        assert geometry.error_of(r) is None and geometry.error_of(other) is None
        assert geometry.equivalent(r, other) and geometry.same_lattice(r, geometry.Record(other.t1, other.t2, ())) == geometry.same_lattice(other, geometry.Record(r.t1, r.t2, ()))


def test_damaged_records_are_refused(tilings_and_records):
    rnd = random.Random(4)
    for _, _, r in tilings_and_records:
        stray = geometry.canonical(geometry.Record(r.t1, r.t2, (*r.seeds, geometry.add(r.seeds[0], (0, 7, 0, 3)))))
        fewer = geometry.Record(r.t1, r.t2, tuple(s for s in r.seeds if s != rnd.choice(r.seeds)))
        swapped = geometry.Record(r.t2, r.t1, r.seeds)
        outside = geometry.Record(r.t1, r.t2, (*r.seeds[1:], geometry.add(r.seeds[0], r.t1)))
        flat = geometry.Record(r.t1, geometry.scale(3, r.t1), r.seeds)
        for bad in (swapped, outside, flat, geometry.Record(r.t1, r.t2, (*r.seeds, r.seeds[0])), geometry.Record(r.t1, r.t2, ())):
            assert geometry.error_of(bad)
        if len(stray.seeds) > len(r.seeds):
            assert geometry.error_of(stray) and not geometry.equivalent(r, stray)
        if len(r.seeds) > 1 and len(fewer.seeds) not in (0, len(r.seeds)):
            assert not geometry.equivalent(r, fewer)
        double = geometry.Record(r.t1, geometry.scale(2, r.t2), r.seeds)
        assert not geometry.same_lattice(r, double) and not geometry.equivalent(r, double) and not geometry.equivalent(r, flat)


def test_the_result_of_most_polygons_survives_its_document(tilings_and_records):
    tiling, pairs, r = max(tilings_and_records, key=lambda x: len(x[0].sides))
    back = text.parse_document(text.render_document(tiling, pairs, "the widest"))
    assert len(back.sides) > 3 and geometry.develop(back) == r
    assert text.parse_document_leniently(text.render_document(tiling, pairs, "x"))["sides"] == tiling.sides


def test_damaged_documents_are_refused(tilings_and_records):
    """Each directive left out, doubled or renamed, and each kind of number moved out of its range."""
    for tiling, pairs, _ in tilings_and_records[::9]:
        whole = text.render_document(tiling, pairs, "x").split("\n")
        bad = []
        for directive in ("e2.", "angleunit", "conway"):
            k = next(k for k, line in enumerate(whole) if line.startswith(directive))
            bad += [whole[:k] + whole[k + 1 :], whole[:k] + [whole[k]] + whole[k:], whole[:k] + ["un" + whole[k]] + whole[k + 1 :]]
        bad.append([line for line in whole if not line.startswith("unittile")])
        k = next(k for k, line in enumerate(whole) if line.startswith("unittile"))
        bad += [whole[:k] + [whole[k].replace("(", "(7,", 1)] + whole[k + 1 :], whole[:k] + [whole[k].replace(")", "")] + whole[k + 1 :]]
        bad += [[*whole, f"repeat({len(tiling.sides)},2)"], [*whole, f"repeat(0,{1 << 40})"], [*whole, "repeat(0,1)", "repeat(0,1)"]]
        bad.append([line.replace('conway("', f'conway("({12 * 99})') for line in whole])
        for lines in bad:
            with pytest.raises(ValueError):
                text.parse_document("\n".join(lines))


def record(a, b, seeds):
    return geometry.Record(tuple(a), tuple(b), tuple(map(tuple, seeds)))


@given(st.tuples(*[st.integers(-60, 60)] * 4), st.tuples(*[st.integers(-9, 9)] * 4), st.tuples(*[st.integers(-9, 9)] * 4))
def test_reduction_is_idempotent_and_keeps_the_class(p, a, b):
    if geometry.independent(a, b):
        r = geometry.reduce(p, a, b)
        assert geometry.reduce(r, a, b) == r == geometry.reduce(geometry.add(p, geometry.subtract(a, geometry.scale(3, b))), a, b)


@given(st.integers(-(10**9), 10**9), st.integers(-(10**9), 10**9), st.integers(-999, 999), st.integers(-999, 999))
def test_exact_floor(a, b, c, d):
    if (c, d) != (0, 0):
        q = geometry.floor_ratio((a, b), (c, d))
        rest = (a - q * c, b - q * d)
        over = (rest[0] - c, rest[1] - d)
        s = geometry.sign((c, d))
        assert geometry.sign(rest) * s >= 0 and geometry.sign(over) * s < 0


@given(st.integers(-(1 << 63), (1 << 63) - 1))
def test_varints(n):
    assert codec.unzigzag(codec.zigzag(n)) == n
    data = codec.varint(codec.zigzag(n))
    assert codec.read_varint(data, 0) == (codec.zigzag(n), len(data))


@pytest.mark.parametrize("data", [b"", b"\x80", b"\x80\x00", b"\xff" * 9 + b"\x02", b"\xff" * 11])
def test_bad_varints(data):
    with pytest.raises(ValueError):
        codec.read_varint(data, 0)


def test_record_codec_sorts_and_refuses_damage():
    rnd = random.Random(12)
    for _ in range(20):
        side = lambda: [rnd.randrange(-300, 300) for _ in range(4)]
        seeds = [side() for _ in range(rnd.randrange(1, 9))]
        data = codec.encode_record(record(side(), side(), seeds))
        assert sorted(codec.decode_record(data).seeds) == sorted(map(tuple, seeds))
        assert codec.encode_record(codec.decode_record(data)) == data
        cut = rnd.randrange(len(data))
        for bad in (data[:cut], data + bytes([rnd.randrange(256)]), bytes([data[0] + 1]) + data[1:]):
            with pytest.raises(ValueError):
                codec.decode_record(bad)


def test_fingerprint_and_checksums():
    assert codec.fingerprint(ROWS) == ROWS_SHA256
    assert codec.crc32c(b"123456789") == 0xE3069283
    assert codec.document_id("a", 1) != codec.document_id("a", 2)


def test_packed_states():
    rnd = random.Random(9)
    for k in (1, 2, 7, 120, 400):
        types = [rnd.randrange(44) for _ in range(k)]
        n = sum(catalog.vertex_types()[t].slots for t in types)
        glue = [-1] * n
        free = rnd.sample(range(n), n)
        while len(free) > n // 3:  # some darts glued to each other or to themselves, others free
            a = free.pop()
            b = free.pop() if free and rnd.random() < 0.8 else a
            glue[a], glue[b] = b, a
        data = states.pack(types, glue)
        assert states.unpack(data) == (types, glue)
        for cut in {0, 1, 5, rnd.randrange(len(data)), len(data) - 1}:
            with pytest.raises(ValueError):
                states.unpack(data[:cut])
        with pytest.raises(ValueError):
            states.unpack(data + b"\x00")
    slots = catalog.vertex_types()[5].slots
    older = bytes([1, slots, 5]) + b"\xff\xff" * slots
    assert states.unpack(older) == ([5], [-1] * slots)
    for at, value in ((0, 2), (1, slots + 1), (2, 200), (3, slots)):
        with pytest.raises(ValueError):
            states.unpack(older[:at] + bytes([value]) + (b"\x00" if at == 3 else older[at + 1 : at + 2]) + older[at + 2 :])
    for glue in ([1] + [-1] * (slots - 1), [None] * slots, [-2] * slots, [slots] + [-1] * (slots - 1)):
        assert states.problem([5], glue)


def test_names_and_ranges():
    assert text.combo((0, 20)) == "02_34c" and text.combo_k("05_34") == 5
    assert text.signature((28, 28, 42)) == "(3,3,3,3,6)Ax2, (3,3,3,3,3,3)A2" and text.file_signature((28, 28, 42)) == "5a2 6i"
    assert text.count_signature((28, 29, 42)) == "2 (21)" and text.count_signature((0, 3)) == "2"
    assert text.pair_symbol("*0", "0") == "[0]" and text.pair_symbol("*1'", "*2") == "(1' 2)" and text.split_symbol("[1 2']") == ("1", "*2'")
    assert text.parse_label("*3@12") == (True, 3, 12) and text.parse_label("4''") == (False, 4, 2)
    assert text.legacy_k("eu_raw_5a_12") == 1 and text.legacy_k("eu_5a3_6i2_40") == 5
    for bad in ("eu_raw_zz_3", "eu_0q_2", "un_5a_1", "eu_5a_last"):
        with pytest.raises(ValueError):
            text.legacy_k(bad)
    rnd = random.Random(4)
    for _ in range(30):
        parts = [(a, rnd.randrange(a, 21)) for a in (rnd.randrange(1, 21) for _ in range(rnd.randrange(1, 5)))]
        spec = ",".join(str(a) if a == b else f"{a}-{b}" for a, b in parts)
        assert text.parse_range(spec) == sorted({n for a, b in parts for n in range(a, b + 1)})
        a, b = parts[0]
        for bad in (f"{spec},", f"{b + 1}-{a}", f"{spec},{b + 20}", f"{spec};{a}"):
            with pytest.raises(ValueError):
                text.parse_range(bad)


def test_unit_plan_covers_all_prefixes_once():
    counts = [("05_34", b, 10 + 300 * (b == 7)) for b in range(64)] + [("06_3", 5, 3)]
    units = reconcile.plan_units(counts, 100)
    for combo in ("05_34", "06_3"):
        own = sorted((lo, hi) for c, lo, hi, _ in units if c == combo)
        assert own[0][0] == 0 and own[-1][1] == 1 << 32 and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
    assert all(n <= 100 for *_, n in units)
