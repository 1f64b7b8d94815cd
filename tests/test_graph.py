"""Graph, geometry, chunking and lattice operators against plain Python."""

import heapq
import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from polyquilt.functions import hooks
from polyquilt.operators import chunking, crossings, graph, lattice, layout
from polyquilt.operators.tables import numbered


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def frame(spark, data, schema):
    return spark.createDataFrame(list(data), schema)


# --- refinement ---


def coarsest(colour, edges):
    weight = Counter()
    for a, b, w in edges:
        weight[a, b] += w
        weight[b, a] += w
    near = defaultdict(list)
    for (a, b), w in weight.items():
        near[a].append((b, w))
    c = dict(colour)
    while True:
        sums = {}
        for n in c:
            seen = Counter()
            for m, w in near[n]:
                seen[c[m]] += w
            sums[n] = (c[n], tuple(sorted(seen.items())))
        names = {s: k for k, s in enumerate(sorted(set(sums.values())))}
        new = {n: names[s] for n, s in sums.items()}
        if len(set(new.values())) == len(set(c.values())):
            break
        c = new
    groups = defaultdict(list)
    for n in c:
        groups[c[n]].append(n)
    return sorted(((n, min(g), len(g)) for g in groups.values() for n in g), key=repr)


GRAPHS = {
    "path": ([(k, 0) for k in range(12)], [(k, k + 1, 1) for k in range(11)]),
    "cycle with one marked": ([(k, int(k == 5)) for k in range(11)], [(k, (k + 1) % 11, 1) for k in range(11)]),
    "cycles alike": ([(k, 0) for k in range(12)], [(k, (k + 1) % 6, 1) for k in range(6)] + [(6 + k, 6 + (k + 1) % 3, 1) for k in range(3)] + [(9 + k, 9 + (k + 1) % 3, 1) for k in range(3)]),
    "star and lone": ([(k, 0) for k in range(9)], [(0, k, 1 + k % 2) for k in range(1, 8)]),
    "binary tree": ([(k, 0) for k in range(1, 16)], [(k, k // 2, 1) for k in range(2, 16)]),
    "loops and repeats": ([(k, 0) for k in range(6)], [(0, 0, 1), (1, 1, 1), (2, 3, 1), (2, 3, 1), (4, 5, 2)]),
}


@pytest.mark.parametrize("name", GRAPHS)
def test_refinement_reaches_the_coarsest_stable_partition(spark, name):
    colour, edges = GRAPHS[name]
    made = graph.refine(frame(spark, colour, "node long, colour int"), frame(spark, edges, "a long, b long, w long"))
    assert rows(made) == coarsest(colour, edges)


def test_refinement_of_a_random_graph_and_odd_rows(spark):
    rnd = random.Random(5)
    colour = [(k, None if k % 7 == 0 else k % 2) for k in range(60)]
    edges = [(rnd.randrange(60), rnd.randrange(60), 1) for _ in range(45)]
    odd = [(None, 3, 1), (3, None, 1)]
    nodes = frame(spark, [*colour, (None, 1)], "node long, colour int")
    made = graph.refine(nodes, frame(spark, [*edges, *odd], "a long, b long, w long"))
    assert rows(made) == coarsest([(n, str(c)) for n, c in colour], edges)
    numbers = {n: c for n, c, _ in graph.class_numbers(made).collect()}
    leasts = {n: low for n, low, _ in rows(made)}
    order = sorted(set(leasts.values()))
    assert numbers == {n: order.index(low) for n, low in leasts.items()}
    assert rows(graph.refine(nodes.limit(0), frame(spark, [], "a long, b long, w long"))) == []


def test_refinement_by_weights_of_any_size(spark):
    """Weights of opposite signs cancel out; ones that differ by a prime of the fingerprint, very large ones and fractions are told apart."""
    p = graph.PRIMES[0]
    ends = {1: [5, -5], 2: [], 3: [1], 4: [1 + p], 5: [1], 6: [1 + p * graph.PRIMES[1]], 7: [-(1 << 62)], 8: [-(1 << 62) + 1]}
    nodes = frame(spark, [(0, 0), *[(k, 1) for k in ends]], "node long, colour int")
    edges = [(k, 0, w) for k, ws in ends.items() for w in ws]
    want = [(0, 0, 1), (1, 1, 2), (2, 1, 2), (3, 3, 2), (4, 4, 1), (5, 3, 2), (6, 6, 1), (7, 7, 1), (8, 8, 1)]
    assert rows(graph.refine(nodes, frame(spark, edges, "a long, b long, w long"))) == want
    parts = [(k, 0, w / 8) for k, w in ((1, 3), (2, 3), (3, 4))]
    assert rows(graph.refine(frame(spark, [(k, 0) for k in range(4)], "node long, colour int"), frame(spark, parts, "a long, b long, w double"))) == [(0, 0, 1), (1, 1, 2), (2, 1, 2), (3, 3, 1)]


def test_refinement_leaves_settled_nodes_alone(spark, monkeypatch):
    """Edges of nodes that are classes of their own are left behind, and no round looks at them again."""
    looked, into = [], graph._weights_into
    monkeypatch.setattr(graph, "_weights_into", lambda near, moved: looked.append(near.count()) or into(near, moved))
    star = [(0, k, k) for k in range(1, 30)]
    made = graph.refine(frame(spark, [(k, 0) for k in range(30)], "node long, colour int"), frame(spark, star, "a long, b long, w long"))
    assert rows(made) == sorted(((k, k, 1) for k in range(30)), key=repr) and looked == [58]
    twins = [*star, (0, 40, 99), (0, 41, 99)]
    made = graph.refine(frame(spark, [(k, 0) for k in [*range(30), 40, 41]], "node long, colour int"), frame(spark, twins, "a long, b long, w long"))
    assert rows(made) == sorted([*[(k, k, 1) for k in range(30)], (40, 40, 2), (41, 40, 2)], key=repr) and looked[1:] == [62, 2]


# --- components and distances ---


def test_components(spark):
    rnd = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100 + rnd.randrange(50), 100 + rnd.randrange(50)) for _ in range(40)] + [(300, 300), (None, 4), (200, 299), (299, 201)]
    nodes = {*range(41), *range(100, 150), 200, 201, 299, 300, 400}
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        if a is not None:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    made = graph.components(frame(spark, [(n,) for n in nodes] * 2 + [(None,)], "node long"), frame(spark, edges * 2, "a long, b long"))
    assert rows(made) == sorted(((n, root(n)) for n in nodes), key=repr)
    assert rows(graph.components(frame(spark, [(1,)], "node long"), frame(spark, [], "a long, b long"))) == [(1, 1)]


def test_distances(spark):
    rnd = random.Random(8)
    edges = [(rnd.randrange(40), rnd.randrange(40), rnd.randrange(0, 9)) for _ in range(70)] + [(None, 1, 1), (1, 2, 30), (1, 2, 1)]
    near = defaultdict(list)
    for a, b, w in edges:
        if a is not None:
            near[a].append((b, w))
            near[b].append((a, w))

    def dijkstra(s):
        best, heap = {}, [(0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            if u not in best:
                best[u] = d
                for v, w in near[u]:
                    heapq.heappush(heap, (d + w, v))
        return best

    sources = [0, 1, 77]
    own = frame(spark, edges, "a long, b long, w long")
    want = [(s, n, d) for s in sources for n, d in dijkstra(s).items()]
    starts = frame(spark, [(s,) for s in [*sources, 0, None]], "source long")
    assert rows(graph.distances(own, starts)) == sorted(want, key=repr)
    assert rows(graph.distances(own, starts, limit=5)) == sorted((r for r in want if r[2] <= 5), key=repr)


# --- crossings ---


def crossing(p, q):
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    a, b, c, d = p[:2], p[2:], q[:2], q[2:]
    return turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_crossings_are_counted_once_on_any_grid(spark, size):
    rnd = random.Random(size)
    lines = [tuple(rnd.randrange(-30, 31) for _ in range(4)) for _ in range(60)]
    lines += [(0, -20, 0, 20), (-20, 0, 20, 0), (-7, -7, 7, 7), (-7, 7, 7, -7), (0, 0, 0, 0), (-14, 7, 14, 7), (7, -14, 7, 14), (0, -20, 0, 20)]
    data = [(k % 2, k, *x) for k, x in enumerate(lines)] + [(0, 900, None, 1, 2, 3), (None, 901, -9, -9, 9, 9)]
    want = sorted((k % 2, k, j) for k, j in itertools.combinations(range(len(lines)), 2) if k % 2 == j % 2 and crossing(lines[k], lines[j]))
    made = crossings.crossing_pairs(frame(spark, data, "by int, id int, x1 int, y1 int, x2 int, y2 int"), size)
    assert sorted(map(tuple, made.collect())) == want and len(want) > 100
    assert "CartesianProduct" not in made._jdf.queryExecution().toString() and "BroadcastNestedLoop" not in made._jdf.queryExecution().toString()


def test_crossings_of_one_path_are_dealt_over_tasks(spark, monkeypatch):
    """One path in one cell is met by pairs of its blocks, in several tasks, and counts each crossing once."""
    for name, n in (("BLOCK", 5), ("PAIRS", 40), ("STEP", 7)):
        monkeypatch.setattr(crossings, name, n)
    rnd = random.Random(4)
    lines = [[rnd.randrange(-40, 40) for _ in range(4)] for _ in range(60)]
    want = [(k, j) for k, j in itertools.combinations(range(60), 2) if crossing(lines[k], lines[j])]
    made = crossings.crossing_pairs(frame(spark, [(1, k, *x) for k, x in enumerate(lines)], "by int, id int, x1 int, y1 int, x2 int, y2 int"), 1000)
    tasks = made.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["a"], r["b"]) for r in tasks) == want
    assert len({r["task"] for r in tasks}) > 5


def test_crossings_of_far_points_are_exact(spark):
    """Two lines that miss each other by one part in 2**28 do not cross."""
    big = (1 << 28) - 1
    lines = [(-big, -big, big, big), (-big, -big + 1, big, big - 1), (-big, -big + 1, big, big)]
    data = [(0, k, *x) for k, x in enumerate(lines)]
    made = crossings.crossing_pairs(frame(spark, data, "by int, id int, x1 long, y1 long, x2 long, y2 long"), 1 << 24)
    assert sorted((a, b) for _, a, b in made.collect()) == [(a, b) for a, b in itertools.combinations(range(3), 2) if crossing(lines[a], lines[b])] == [(0, 1)]


# --- numbers and chunks ---


def test_numbers_run_within_groups(spark):
    data = [(k % 3 or None, k, k % 5) for k in range(200)]
    made = numbered(frame(spark, data, "g int, o int, v int").repartition(6), ["g"], [F.col("o")], {"s": F.col("v")})
    for g in (None, 1, 2):
        own = sorted((r for r in made.collect() if r.g == g), key=lambda r: r.o)
        total = 0
        for k, r in enumerate(own):
            assert (r.idx, r.s) == (k, total)
            total += r.v


def greedy(data, target):
    out = []
    held = None
    for key, order, size, more in sorted(data, key=lambda r: (str(r[0]), r[1])):
        size = size or 0
        if held is None or held[0] != key or held[4] + size > target:
            held = [key, 0 if held is None or held[0] != key else held[1] + 1, order, 0, 0]
            out.append(held)
        held[3] += 1
        held[4] += size + more
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("target", [1, 10, 64, 100000])
def test_chunks_follow_the_sequential_rule(spark, target):
    rnd = random.Random(target)
    data = [(rnd.choice(["a", "b", None]), k, rnd.choice([None, 0, 1, 3, 9, 10, 11, 40, 700]), rnd.choice([1, 2])) for k in range(300)]
    own = frame(spark, data, "k string, o int, s int, m int").repartition(5)
    made = chunking.chunks(own, F.col("k"), F.col("o"), F.col("s"), F.col("m"), target)
    assert rows(made) == greedy(data, target)


def test_no_rows_give_no_chunks(spark):
    own = frame(spark, [], "k string, o int, s int")
    assert rows(chunking.chunks(own, F.col("k"), F.col("o"), F.col("s"), F.lit(1), 5)) == []


# --- lattices ---


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(-12, 12), min_size=3, max_size=3), max_size=6), st.randoms())
def test_the_hermite_form_is_unique(vectors, rnd):
    form = lattice.hermite(vectors)
    mixed = [list(v) for v in vectors]
    rnd.shuffle(mixed)
    for k in range(1, len(mixed)):
        mixed[k] = [a + 3 * b for a, b in zip(mixed[k], mixed[k - 1])]
    assert lattice.hermite(mixed) == form
    assert lattice.hermite(form + vectors) == form
    pivots = [next(i for i, x in enumerate(r) if x) for r in form]
    assert pivots == sorted(set(pivots)) and all(r[p] > 0 for r, p in zip(form, pivots))
    full = [v for v in itertools.combinations(vectors, 3)]
    det = lambda a, b, c: a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])
    whole = math.gcd(*[det(*v) for v in full])
    assert (math.prod(r[p] for r, p in zip(form, pivots)) if len(form) == 3 else 0) == whole


def test_lattices_by_group(spark):
    rnd = random.Random(2)
    data = [(k % 40 or None, 6 * rnd.randrange(-9, 9), 4 * rnd.randrange(-9, 9)) for k in range(600)] + [(99, None, 3), (98, 0, 0), (97, 1 << 60, 3)]
    groups = defaultdict(list)
    for g, x, y in data:
        groups[g] += [[x, y]] if x is not None else []
    made = {r[0]: (r[1], [[int(x) for x in v] for v in r[2]]) for r in lattice.basis(frame(spark, data, "g int, x long, y long").repartition(9), "g", ["x", "y"]).collect()}
    assert made == {g: (len(lattice.hermite(v)), lattice.hermite(v)) for g, v in groups.items()}


def test_lattices_pass_on_full_tables(spark, monkeypatch):
    monkeypatch.setattr(lattice, "HELD", 3)
    data = [(k % 11, k, k * k) for k in range(90)]
    made = {r[0]: [[int(x) for x in v] for v in r[2]] for r in lattice.basis(frame(spark, data, "g int, x int, y int"), "g", ["x", "y"]).collect()}
    assert made == {g: lattice.hermite([[x, y] for h, x, y in data if h == g]) for g in range(11)}


# --- layout and table functions ---


def test_stress_never_rises_and_settles(spark):
    rnd = random.Random(1)
    nodes = {k: (rnd.random(), rnd.random()) for k in range(8)}
    points = {k: (rnd.random() * 3, rnd.random() * 3) for k in range(8)}
    pairs = frame(spark, [(a, b, math.dist(points[a], points[b])) for a, b in itertools.combinations(range(8), 2)] + [(1, 1, 2.0), (0, 1, None), (2, 3, 0.0)], "a int, b int, d double")
    at = frame(spark, [(k, *p) for k, p in nodes.items()] + [(50, 9.0, 9.0)], "node int, x double, y double")
    seen = [layout.stress(pairs, at).first().stress]
    for _ in range(4):
        at = layout.layout(pairs, at, 1)
        seen.append(layout.stress(pairs, at).first().stress)
    assert all(b < a for a, b in itertools.pairwise(seen))
    assert {r.node: (r.x, r.y) for r in at.collect()}[50] == (9.0, 9.0)
    exact = frame(spark, [(k, *p) for k, p in points.items()], "node int, x double, y double")
    moved = {r.node: (r.x, r.y) for r in layout.step(pairs, exact).collect()}
    assert all(math.dist(moved[k], points[k]) < 1e-9 for k in points) and layout.stress(pairs, exact).first().stress < 1e-18


@pytest.mark.parametrize("mirror", [1, -1])
def test_align_undoes_a_turn_and_a_mirror(spark, mirror):
    target = [(k, math.cos(k) * k, math.sin(2 * k)) for k in range(9)]
    c, s = math.cos(0.7), math.sin(0.7)
    turned = [(k, c * x - s * y * mirror + 5, s * x + c * y * mirror - 2) for k, x, y in target]
    schema = "node int, x double, y double"
    made = layout.align(frame(spark, [*turned, (99, 0.0, 0.0)], schema), frame(spark, target, schema))
    got = {r.node: (r.x, r.y) for r in made.collect()}
    assert all(math.dist(got[k], (x, y)) < 1e-9 for k, x, y in target) and 99 in got


def test_gap_runs_from_sql(spark):
    hooks.register(spark, "gap_runs", hooks.GapRuns)
    data = [("a", 1), ("a", 3), ("a", 10), ("a", None), ("b", 7), (None, 4), (None, 5), ("c", None)]
    frame(spark, data, "key string, at long").createOrReplaceTempView("steps")
    made = spark.sql("SELECT * FROM gap_runs(TABLE(steps) PARTITION BY (key) ORDER BY (at), 2L)")
    assert rows(made) == sorted([("a", 0, 1, 3, 2), ("a", 1, 10, 10, 1), ("b", 0, 7, 7, 1), (None, 0, 4, 5, 2)], key=repr)
    for call, text in (("TABLE(SELECT 1 AS at), 2L", "needs the columns"), ("TABLE(steps)", "takes 1 constants"), ("1, 2", "takes a table")):
        with pytest.raises(Exception, match=text):
            spark.sql(f"SELECT * FROM gap_runs({call})")


def test_forms_of_many_groups_at_once():
    """Array steps give what one form at a time gives, within 64 bits and beyond, over pivots that are missing."""
    import pyarrow as pa

    rnd = random.Random(9)
    for size in (3, 40, 10**9, 10**17):
        for width in (1, 2, 3):
            data = [(rnd.randrange(30), [rnd.randint(-size, size) * rnd.randint(0, 1) for _ in range(width)]) for _ in range(200)]
            table = pa.table({"by": pa.array([g for g, _ in data]), "form": pa.array([v for _, v in data], pa.list_(pa.int64()))})
            try:
                made = lattice._combined(table, width)
            except pa.ArrowInvalid:
                assert size == 10**17  # a form of over 38 digits
                continue
            for g, flat in zip(made.column(0).to_pylist(), made.column(1).to_pylist(), strict=True):
                rows = [[int(x) for x in flat[k * width : (k + 1) * width]] for k in range(width)]
                assert [r for r in rows if any(r)] == lattice.hermite([v for h, v in data if h == g])


def test_small_graphs_that_repeat(spark):
    """Graphs of one shape are worked on once, and each keeps its own rows' names."""
    from polyquilt.operators import alike

    shape = ((0, 0, 1), ((0, 0, 2), (0, 1, 2)))
    alike._kept.cache_clear()
    assert [alike._kept(*shape) for _ in range(5)] == [[(0, 2), (0, 2), (2, 1)]] * 5
    assert alike._kept.cache_info().misses == 1
    rows = [(g, 10 * g + k, f"{g}{m}") for g in range(40) for k, m in enumerate(shape[0])]
    edges = [(g, 10 * g + a, 10 * g + b) for g in range(40) for _, a, b in shape[1]]
    got = alike.alike_rows(frame(spark, rows, "g int, a int, m string"), frame(spark, edges, "g int, a int, b int"), "g", "a", "m").collect()
    assert {tuple(r) for r in got} == {(g, 10 * g + k, 10 * g + least, n) for g in range(40) for k, (least, n) in enumerate([(0, 2), (0, 2), (2, 1)])}
