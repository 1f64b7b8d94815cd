import re

import numpy as np

from polyquilt.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width=13):
    """(id, n_words, n_removed, kept) for each row, in order."""
    least = {}
    top = substring.NULL_ID
    split = [(top if i is None else i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            least[g] = min(least.get(g, top), i)
    out = []
    for i, w in split:
        gone = {p for k in range(len(w) - width + 1) if least[tuple(w[k : k + width])] < i for p in range(k, k + width)}
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((len(w), len(w) - len(kept), " ".join(kept)))
    return out


def check(spark, rows):
    got = substring.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = brute(rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept"]) for r in got) == sorted((i is None, i or 0, *w) for (i, _), w in zip(rows, want, strict=True))


def test_hard_rows(spark, hard_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in hard_docs.collect()]
    check(spark, rows)
    assert substring.dedup(hard_docs).count() == len(rows)
    assert substring.dedup(no_docs).count() == 0


def test_passages(spark, prose, monkeypatch):
    passage, edge = prose(60, 1), prose(13, 2)
    rows = [(k, f"{prose(30, 10 + k)} {passage} {prose(5, 50 + k)} {edge}") for k in range(20)]
    rows += [(30, passage), (31, " ".join(passage.split()[:12])), (32, passage + "\t" + passage), (32, passage), (5, edge + "\x0b" + edge)]
    check(spark, rows)


def test_blocks_do_not_matter(spark, prose, monkeypatch):
    rows = [(k, prose(50, k % 7) + " " + prose(20, k)) for k in range(60)]
    monkeypatch.setattr(substring, "BLOCK_BYTES", 700)
    check(spark, rows)


def test_intervals_merge():
    flags = np.array([0, 1, 1, 0, 0, 0, 0, 0, 1, 0], bool)
    assert np.flatnonzero(substring.removal_intervals(flags, 3)).tolist() == [1, 2, 3, 4, 8, 9, 10]
