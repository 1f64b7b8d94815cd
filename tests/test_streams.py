"""Streams, resumable units, bisimulation."""

import random

import pytest
from pyspark.sql import functions as F

from polyquilt.operators import alike, units
from polyquilt.operators.tables import new_path
from polyquilt.streaming import online


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("cap", [1, 2, 5])
def test_capped_dedup_is_the_sequential_rule(spark, cap):
    """Equal to one pass in order, over three starts of a stream; null forms are a form."""
    rnd = random.Random(cap)
    data = [(k, k % 2, rnd.choice(["a", "b", "c", "d", None])) for k in range(60)]
    base, schema = new_path(spark), "id int, g int, form string"
    for part in range(3):
        spark.createDataFrame(data[20 * part : 20 * part + 20], schema).repartition(3).write.mode("append").parquet(f"{base}/in")
        stream = online.follow(spark, f"{base}/in", spark.createDataFrame([], schema).schema)
        online.drain(online.capped_dedup(stream, "g", "form", "id", cap), f"{base}/out", f"{base}/ck").awaitTermination()
    want, held = [], {0: set(), 1: set()}
    for k, g, form in data:
        if len(held[g]) >= cap:
            held[g] = set()
        if form not in held[g]:
            want.append((k, g, form))
        held[g].add(form)
    assert rows(spark.read.parquet(f"{base}/out").select("id", "g", "form")) == sorted(want, key=repr)


def test_late_rows_are_kept_apart(spark):
    base, schema = new_path(spark), "id int, by string, ts timestamp"
    parts = [[(1, "x", 0), (2, "x", 100)], [(3, "x", 5), (4, "x", 95), (5, "x", 200)], [(6, "x", 100), (7, "y", 199), (8, "x", 400)]]
    for part in parts:
        own = spark.createDataFrame(part, "id int, by string, s long").select("id", "by", F.timestamp_seconds("s").alias("ts"))
        own.write.mode("append").parquet(f"{base}/in")
        stream = online.follow(spark, f"{base}/in", own.schema)
        online.drain(online.windows(stream, "ts", "by", "20 seconds", "10 seconds", "30 seconds"), f"{base}/out", f"{base}/ck").awaitTermination()
        online.late_rows(stream, "ts", "20 seconds", "10 seconds", "30 seconds", f"{base}/missed", f"{base}/ck2").awaitTermination()
    late = spark.read.schema("id int, missed long").option("recursiveFileLookup", True).parquet(f"{base}/missed/late")
    # marks are 70 and 170: row 3 missed [-10, 10) and [0, 20), row 6 [90, 110) and [100, 120)
    assert rows(late) == [(3, 2), (6, 2)]
    closed = {(r.by, int(r.start.timestamp())): r.n for r in spark.read.parquet(f"{base}/out").collect()}
    assert closed["x", 90] == 2 and closed["x", 80] == 1 and ("x", 390) not in closed and closed["y", 190] == 1
    assert sum(closed.values()) == 2 * 7 - 4  # each row is in two windows; the last row's are open


def test_units_stop_and_resume(spark, monkeypatch):
    data = [(k, f"text {k % 37}" if k % 11 else None) for k in range(200)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    target = f"{new_path(spark)}/units"
    units.stage(docs, F.sha2("text", 256), "doc_id", target, 8)
    with pytest.raises(ValueError, match="do not cover"):
        units.result(spark, target)
    assert units.work(spark, target, most=2) == 2
    # a unit that broke after its files and before its ledger row is done again, over them
    todo = units.waiting(spark, target)
    spark.createDataFrame([("0" * 64, 5, 5)], "form string, kept long, copies long").write.parquet(f"{target}/done/unit={todo[0]}")
    with pytest.raises(ValueError, match="do not cover"):
        units.result(spark, target)
    # a later call with other rows changes nothing: the plan is published
    units.stage(docs.limit(1), F.sha2("text", 256), "doc_id", target, 8)
    assert units.work(spark, target) == len(todo)
    assert units.work(spark, target) == 0
    want = docs.groupBy(F.sha2("text", 256).alias("form")).agg(F.min("doc_id"), F.count("*"))
    assert rows(units.result(spark, target)) == rows(want)


def test_units_of_an_empty_table(spark):
    target = f"{new_path(spark)}/units"
    units.stage(spark.createDataFrame([], "doc_id long, text string"), F.sha2("text", 256), "doc_id", target, 4)
    assert units.work(spark, target) == 0 and rows(units.result(spark, target)) == []


def fixpoint(nodes, edges):
    like = {(a, b) for a, m in nodes for b, n in nodes if m == n}
    out = {}
    for label, a, b in edges:
        out.setdefault(a, []).append((label, b))
    while True:
        keep = {(a, b) for a, b in like if all(any(p == q and (x, y) in like for q, y in out.get(b, [])) for p, x in out.get(a, [])) and all(any(p == q and (x, y) in like for p, x in out.get(a, [])) for q, y in out.get(b, []))}
        if keep == like:
            return like
        like = keep


def test_alike_rows(spark):
    rnd = random.Random(4)
    nodes, edges, want = [], [], []
    for g in range(25):
        n = rnd.randrange(1, 9)
        own = [(k, rnd.choice(["x", None])) for k in range(n)]
        lines = [(rnd.choice("pq") if g % 2 else None, rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randrange(0, 9))]
        like = fixpoint(own, lines)
        want += [(g, a, min(b for x, b in like if x == a), sum(x == a for x, _ in like)) for a, _ in own]
        nodes += [(g, *r) for r in own] * 2
        edges += [(g, a, b, label) for label, a, b in lines] * 2 + [(g, 0, 99, "p"), (g, None, 0, "p")]
    left = spark.createDataFrame([*nodes, (None, 1, "x"), (3, None, "x")], "g int, node int, mark string")
    right = spark.createDataFrame([*edges, (500, 1, 2, "p")], "g int, a int, b int, label string")
    assert rows(alike.alike_rows(left, right, "g", "node", "mark")) == sorted(want, key=repr)
    assert rows(alike.alike_rows(left.limit(0), right, "g", "node", "mark")) == []
