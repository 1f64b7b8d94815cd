import re
from itertools import combinations

import numpy as np

from polyquilt.llm import graph, neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    """{id: component} over rows (id, text)."""
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for (a, x), (b, y) in combinations(sets, 2):
        both = len(x & y)
        if both and 100 * both >= 75 * (len(x) + len(y) - both):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i in root}


def check(spark, rows):
    got = neardup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert {r["id"]: r["component"] for r in got if r["id"] is not None} == want
    assert all(r["component"] is None for r in got if r["id"] is None)
    return got


def test_hard_rows(spark, hard_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in hard_docs.collect()]
    got = check(spark, rows)
    texts = dict(rows)
    assert all(r["n"] == len(shingles(texts[r["id"]])) for r in got if r["id"] is not None)
    kept = neardup.keep_one(hard_docs)
    assert kept.schema == hard_docs.schema
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 in ids and not {2, 3, 12} & set(ids) and ids.count(None) == 2 and ids.count(4) == 2
    assert neardup.classes(no_docs).count() == neardup.keep_one(no_docs).count() == 0


def test_chains_and_passages(spark, prose):
    """Drifting copies whose ends are not similar, and documents that share a long passage only."""
    rows, words = [], prose(100, 1).split()
    for k in range(25):
        rows.append((100 - k, " ".join(words)))
        for p in range(3):
            words[(7 * k + 30 * p) % 100] = f"new{k}x{p}"
    passage = prose(60, 2)
    rows += [(200 + k, prose(8 + k, 300 + k) + " " + passage) for k in range(30)]
    check(spark, rows)


def test_miss_table():
    assert neardup.least_matches(32) < 24 and neardup.least_matches(160) > neardup.least_matches(32)
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 1 << 16, (2000, 160), dtype=np.uint16)
    for share, least, most in ((0.75, 1.0, 1.0), (0.2, 0.0, 0.001)):
        b = np.where(rnd.random(a.shape) < share, a, rnd.integers(0, 1 << 16, a.shape, dtype=np.uint16))
        assert least <= neardup.plausible(a, b).mean() <= most


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(5, 5), (None, 3), (200, 201), (201, 202), (202, 200), (200, 201)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200, 202: 200}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_finer_buckets_and_what_lies_beyond(spark, prose, monkeypatch):
    """With blocks of a few members a family of documents with one long passage goes through the finer levels and on, and gives what brute force gives."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    passage = prose(140, 1)
    rows = []
    for k in range(12):
        own = prose(36, 500 + k)
        rows += [(2 * k, f"{passage} {own}"), (2 * k + 1, f"{passage} {own} more{k}")]
    want = brute(rows)
    got = {r["id"]: r["component"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want
    assert 1 < len(set(want.values())) < len(rows)


def test_members_of_large_buckets_that_share_no_finer_one(spark, prose, monkeypatch):
    """Pairs that no finer bucket holds are found on their shingles; texts of one id and sets of other sizes too."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    none = spark.createDataFrame([], "bucket bigint, id bigint")
    monkeypatch.setattr(neardup, "finer", lambda members, sigs, level: none)
    passage = prose(140, 1)
    rows = []
    for k in range(12):
        own = prose(36, 500 + k)
        rows += [(2 * k, f"{passage} {own}"), (2 * k + 1, f"{passage} {own} {prose(3 * k, 700 + k)}")]
    want = brute(rows)
    got = {r["id"]: r["component"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want
    assert 1 < len(set(want.values())) < len(rows)


def test_stars_need_no_round(spark, monkeypatch):
    """Edges that point to the least member of their component are written once; a chain still takes its rounds."""
    written, cut = [], neardup.common.cut
    monkeypatch.setattr(graph.common, "cut", lambda df, sweep=True: written.append(1) or cut(df, sweep))
    stars = [(0, k) for k in range(1, 30)] + [(k, 100) for k in range(101, 120)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(stars, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(30), 0), **dict.fromkeys(range(100, 120), 100)} and len(written) == 1
    chain = [(k, k + 1) for k in range(6)] + [(6, 3), (2, 9)]
    assert {r["component"] for r in graph.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()} == {0} and len(written) > 2


def test_an_id_meets_its_component_once(spark):
    """However many buckets an id is in, one row of it is joined with the components."""
    members = spark.createDataFrame([(b, k) for k in range(50) for b in range(40)], "bucket bigint, id bigint")
    found = spark.createDataFrame([(k, 0) for k in range(0, 50, 2)], "node bigint, component bigint")
    got = neardup.with_component(members, found)
    assert sorted(map(tuple, got.select("bucket", "id", "comp").collect())) == sorted((b, k, k if k % 2 else 0) for k in range(50) for b in range(40))
    todo, made = [got._jdf.queryExecution().executedPlan().finalPhysicalPlan()], []
    while todo:
        plan = todo.pop()
        todo += [plan.children().apply(k) for k in range(plan.children().size())]
        if plan.nodeName().endswith("QueryStage"):
            todo.append(plan.plan())
        if "Join" in plan.nodeName():
            made.append(plan.logicalLink().get().toString().count("collect_list"))
    assert made and all(made)


def _families(prose):
    """Pairs that are linked, among documents that share one long passage."""
    passage = prose(140, 1)
    rows = []
    for k in range(12):
        own = prose(36, 500 + k)
        rows += [(2 * k, f"{passage} {own}"), (2 * k + 1, f"{passage} {own} more{k}")]
    return rows


def test_large_buckets_go_to_the_exact_join_at_once(spark, prose, monkeypatch):
    """Members of a large bucket are not dealt to finer ones where the exact join meets few pairs, and lose no link."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "finer", None)
    rows = _families(prose)
    check(spark, rows)


def test_finer_buckets_where_the_exact_join_has_too_much_to_do(spark, prose, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "MEETS", 0)
    levels, finer = [], neardup.finer
    monkeypatch.setattr(neardup, "finer", lambda members, sigs, level: levels.append(level) or finer(members, sigs, level))
    check(spark, _families(prose))
    assert levels


def test_small_tables_are_few_files(spark):
    """Components of a few edges are not written by a task for each partition of a shuffle."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(9)], "a bigint, b bigint")
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 97)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        found = graph.merged(None, edges)
        assert {tuple(r) for r in found.collect()} == {(k, 0) for k in range(10)}
        assert len(found.inputFiles()) <= spark.sparkContext.defaultParallelism < 97
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
