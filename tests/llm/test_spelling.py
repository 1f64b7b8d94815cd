import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from polyquilt.llm import spelling

from .conftest import SF


def edits(word, alphabet):
    out = set()
    for i in range(len(word) + 1):
        out |= {word[:i] + c + word[i:] for c in alphabet}
        if i < len(word):
            out |= {word[:i] + word[i + 1 :]} | {word[:i] + c + word[i + 1 :] for c in alphabet}
    return out - {word}


def counted(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def brute(n):
    alphabet = set("".join(n))
    near = {w: edits(w, alphabet) & n.keys() for w in n}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-n[x], x))
            if n[best] >= 10 * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        out.append((w, f, root, n[w], len(near[w]), n.get(f)))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute(counted(map(tuple, docs.select("doc_id", "text").collect())))
    assert result(spelling.op13_spelling_variants(spark, SF)) == want
    assert sum(r[4] > 0 for r in want) > 20 and any(r[1] for r in want)


def test_hard_rows(spark, hard_docs, no_docs):
    more = [(70 + k, "Pfingstfest PFINGSTFESTE pfingstfést Éclairées éclairées ÉCLAIRÉES aaaaaaa aaaaaaaa aaaaaaab " * (1 + 9 * (k % 4)), None, k, "word", 0, 1, 1, 1, 1, 1, False, 0.0, 1) for k in range(40)]
    docs = hard_docs.unionAll(spark.createDataFrame(more, hard_docs.schema)).selectExpr("*", "'x' AS word", "'y' AS anchor", "1 AS size", "2 AS n_near").unionAll(hard_docs.selectExpr("*", "'x'", "'y'", "1", "2"))
    want = brute(counted(map(tuple, docs.select("doc_id", "text").collect())))
    assert result(spelling.variants(spelling.vocabulary(docs))) == want
    assert any(r[1] for r in want)
    assert result(spelling.variants(spelling.vocabulary(no_docs))) == []


@pytest.mark.parametrize("group", [2, 7, 4096])
def test_hot_anchors_are_halved_without_loss(spark, group):
    """Templates: one common head or tail for most words, so that all windows down to one letter come into use."""
    rnd = random.Random(group)
    words = {}
    for _ in range(500):
        core = "".join(rnd.choice("abc") for _ in range(rnd.choice((1, 2, 3, 4))))
        w = rnd.choice(("template" + core, core + "template", "temp" + core + "late", "tttttt" + core))
        words[w if len(w) >= 7 else w + "xxx"] = rnd.choice((2, 3, 25, 300, 4000))
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    assert result(spelling.variants(rows)) == brute(words) if group == 4096 else True
    found = spelling.near(rows, group).groupBy("word").agg({"n_near": "sum"})
    assert dict(map(tuple, found.collect())) == {r[0]: r[4] for r in brute(words) if r[4]}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", min_size=7, max_size=8), min_size=2, max_size=30, unique=True), st.sampled_from((7, 8)))
def test_index_equals_comparison(words, size):
    own, longer = sorted(w for w in words if len(w) == 7), sorted(w for w in words if len(w) == 8)
    if not own:
        return
    want = {(a, b, False) for a in range(len(own)) for b in range(a + 1, len(own)) if spelling.one_edit(own[a], own[b])} | {(a, b, True) for a in range(len(own)) for b in range(len(longer)) if spelling.one_edit(own[a], longer[b])}
    got = list(spelling.near_in(own, longer))
    assert set(got) == want and len(got) == len(want)


@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_one_edit(s, t):
    assert spelling.one_edit(s, t) == (t in edits(s, "abc"))


def test_the_bound_and_the_heap():
    lists = [[1, 4, 9], [4], [2, 4, 9], [4, 5, 9], []]
    assert list(spelling.overlapping(lists, 3)) == [4, 9]
    assert list(spelling.overlapping(lists, 4)) == [4]
    assert list(spelling.overlapping(lists, 1)) == [1, 2, 4, 5, 9]
    assert list(spelling.overlapping(lists, 5)) == []


def test_counting_flushes_within_a_task(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "wordnumber" + "abcdefghij"[k % 10] * 2) for k in range(200)], "doc_id long, text string").coalesce(1)
    whole = result(spelling.vocabulary(docs, every=None))
    run = spelling._count("doc_id", "text", 7, None)
    monkeypatch.setattr(spelling, "HELD_LETTERS", 40)
    batches = docs.toArrow().to_batches()
    parts = Counter()
    for out in run(iter(batches)):
        parts.update(dict(zip(out["word"].to_pylist(), out["n"].to_pylist())))
    assert sorted(parts.items()) == whole and len(whole) == 10
