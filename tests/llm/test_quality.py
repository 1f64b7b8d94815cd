import re
from collections import Counter

from polyquilt.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_counts_against_brute_force(spark, hard_docs):
    texts = {r["doc_id"]: r["text"] for r in hard_docs.collect()}
    got = quality.judge(hard_docs).collect()
    assert len(got) == hard_docs.count()
    for r in got:
        if r["doc_id"] is not None:
            want = brute(texts[r["doc_id"]])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert not (r["kept"] and r["base_failed"])


def test_verdicts(spark, prose):
    good = prose(200, 3)
    rows = [(1, good), (2, " ".join(w + "%%%" for w in good.split())), (3, " | ".join(good.split())), (4, good.upper()), (5, "the of and " * 100), (6, "\n".join([good[:300]] * 4))]
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}


def test_filter_keeps_columns(hard_docs, no_docs):
    out = quality.keep_good(hard_docs)
    assert out.schema == hard_docs.schema
    assert {r["doc_id"] for r in out.collect()} >= {1, 2, 3, 4}
    assert quality.keep_good(no_docs).count() == quality.judge(no_docs).count() == 0
