"""State queries over many orders of few states."""

import uuid

from polyquilt.operators import darts
from polyquilt.plans import state_queries


def lineitem(spark, folder, rows):
    made = spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_suppkey bigint")
    made.write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_a_state_is_worked_on_once(spark, tmp_path):
    """Orders of one state come together; a repeated line counts by its least supplier."""
    rows = [(o, line, 3 + 12 * (o % 5)) for o in range(600) for line in (1, 2)] + [(o, 2, 900) for o in range(0, 600, 7)] + [(1000, 1, 4)]
    folder = lineitem(spark, tmp_path, rows)
    got = state_queries._over_states(spark, folder, "token string", lambda types, glue: (uuid.uuid4().hex,)).collect()
    assert len(got) == len({r["l_orderkey"] for r in got}) == 601
    assert len({r["token"] for r in got}) == 2


def test_classes_work_on_pairs_of_types(spark, tmp_path):
    folder = lineitem(spark, tmp_path, [(o, line, o % 3 + line) for o in range(90) for line in (1, 2, 3)])
    got = state_queries.state_classes(spark, folder)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    at = plan.index("MapInArrow")
    assert plan[at:].splitlines()[1].strip(" +-:").startswith("Aggregate [a#")
    assert {(r["l_orderkey"], r["first_word"], r["first_wl2"]) for r in got.collect()} == {(o, o % 3, o % 3) for o in range(90)}


def test_darts_meet_no_rows(spark):
    """A document's darts come from its own row: no join, no exchange."""
    square = '## Euclidean, x\ne2.\nangleunit(deg)\nunittile(90,90,90,90)\nconway("(0 2)(1 3)")\n'
    got = darts.darts(spark.createDataFrame([(1, square), (2, None)], "id bigint, document string"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = {(r["edge"], r["side"]): tuple(r)[5:] for r in got.collect()}
    assert len(rows) == 8
    assert rows[0, 1] == (0, 2, 1, 0, 1, 1) and rows[0, -1] == (0, 2, -1, 0, 3, -1)


def test_floor_of_exact_quotients(spark):
    """As the plain function has it, whole quotients and close ones too; null by 0."""
    import random

    from pyspark.sql import functions as F

    from polyquilt.functions import geometry

    rnd = random.Random(5)
    rows = [tuple(rnd.randint(-60, 60) for _ in range(4)) for _ in range(300)]
    rows += [(k * a, k * b, a, b) for k in range(-3, 4) for a, b in ((7, -4), (26, -15), (97, -56), (0, 1), (-5, 0))] + [(97, -56, 1, 0), (-97, 56, 1, 0), (3, 2, 0, 0)]
    c = [F.col(x) for x in ("n0", "n1", "d0", "d1")]
    got = state_queries.with_floor_ratio(spark.createDataFrame(rows, "n0 long, n1 long, d0 long, d1 long"), "q", (c[0], c[1]), (c[2], c[3])).collect()
    assert len(got) == len(rows)
    for r in got:
        d = (r["d0"], r["d1"])
        assert r["q"] == (None if d == (0, 0) else geometry.floor_ratio((r["n0"], r["n1"]), d)), r


def test_geometry_of_triples_is_an_expression(spark):
    """Python sees pairs of vectors and points, not lines: its input has no more rows than their digits allow."""
    plan = state_queries.exact_geometry(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = [plan[k + 1] for k, line in enumerate(plan) if "MapInArrow" in line]
    assert len(below) == 2 and all("Aggregate" in line and "_l_" in line for line in below)
