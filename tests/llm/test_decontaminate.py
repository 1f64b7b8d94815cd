import random

import numpy as np

from polyquilt.llm import decontaminate as D


def edit_distance(item, text):
    """Least edits of item to any run of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        before, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (a != b))
    return min(row)


def test_distances_against_brute_force():
    """All rows at once: items of one lane and of several, runs of all lengths, runs without enough of the words."""
    rnd = random.Random(3)
    items = [" ".join(rnd.choice("abcdef") for _ in range(rnd.choice([1, 2, 5, 30, 62, 63, 64, 90, 126, 127, 200]))) for _ in range(60)]
    index = D.Index(list(enumerate(dict.fromkeys(items))))
    items = list(dict.fromkeys(items))
    texts = []
    for item in items:
        words = item.split()
        for _ in range(rnd.randrange(len(words) // 3 + 1)):
            p = rnd.randrange(len(words)) if words else 0
            words[p : p + 1] = rnd.choice([[rnd.choice("abcdefx")], [], ["a", "b"]])
        texts.append([rnd.choice("abcx") for _ in range(rnd.randrange(9))] + words + [rnd.choice("abcx") for _ in range(rnd.randrange(30))])
    words, _ = D.words_of(np.frombuffer(" ".join(w for t in texts for w in t).encode(), np.uint8), np.array([0, sum(len(w) + 1 for t in texts for w in t) - 1]))
    ends = np.cumsum([len(t) for t in texts])
    got = index.distances(words, np.arange(len(items)), ends - [len(t) for t in texts], ends)
    for k, (item, text) in enumerate(zip(items, texts)):
        want = edit_distance(item.split(), text)
        assert got[k] == want or (want > index.edits[k] and got[k] == len(item.split()) + 1), (k, got[k], want)
    assert sum(got <= index.edits) > 30


def planted(items, prose, rate, seed):
    rnd = random.Random(seed)
    docs = []
    for k, item in enumerate(items):
        words = item.split()
        for _ in range(int(rate * len(words))):
            p = rnd.randrange(len(words))
            words[p : p + 1] = rnd.choice([["edited"], [], [words[p], "added"]])
        docs.append((k, prose(rnd.randrange(5, 200), 5000 + k) + " " + ", ".join(words).upper() + "! " + prose(30, 9000 + k)))
    return docs


def test_recall_and_clean_documents(spark, prose):
    items = [prose(n, 100 + n) for n in range(11, 80)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    for rate in (0.0, 0.1):
        docs = planted(items, prose, rate, 1) + [(1000 + k, prose(200, 20000 + k)) for k in range(50)]
        got = D.matches(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()
        assert {r["doc_id"] for r in got} <= set(range(len(items)))
        assert sum(r["doc_id"] == r["item_id"] for r in got) >= D.TARGET_RECALL * len(items)
        assert all(r["edits"] <= r["item_words"] * D.EDITS_PERCENT // 100 for r in got)


def test_short_and_odd_items(spark, hard_docs, no_docs, prose):
    bench = spark.createDataFrame([(1, "one"), (2, None), (3, ""), (4, "!!!"), (None, prose(120, 1)), (5, prose(120, 1)), (5, prose(120, 1))], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.matches(hard_docs, bench).collect()}
    assert {(10, 1), (11, 1), (1, 5), (2, 5), (3, 5), (12, 5), (None, 5), (1, None)} <= got
    assert not {d for d, _ in got} & {4, 5, 6, 7, 15}
    kept = D.keep_clean(hard_docs, bench)
    assert kept.schema == hard_docs.schema and kept.count() == hard_docs.count() - 7
    assert D.matches(no_docs, bench).count() == D.keep_clean(no_docs, bench).count() == 0
    assert D.matches(hard_docs, bench.filter("false")).count() == 0


def test_blocks_of_items_give_the_same(spark, hard_docs, prose, monkeypatch):
    bench = spark.createDataFrame([(k, prose(120, k)) for k in range(6)], "item_id bigint, text string")
    want = sorted(map(str, D.matches(hard_docs, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_ITEMS", 2)
    assert sorted(map(str, D.matches(hard_docs, bench).collect())) == want


def edited(words, kind, rnd):
    """``words`` after as many edits as an item of their number may have, each at another place."""
    words = list(words)
    for p in sorted(rnd.sample(range(len(words)), len(words) * D.EDITS_PERCENT // 100), reverse=True):
        words[p : p + 1] = {"deleted": [], "swapped": ["edited"], "added": [words[p], "added"]}[kind if kind != "mixed" else rnd.choice(["deleted", "swapped", "added"])]
    return words


def test_all_width_classes_at_the_most_edits(prose):
    """At 20 % edits of each kind nothing is missed, in items of each width class, short and long ones."""
    rnd = random.Random(20)
    sizes = list(dict.fromkeys([1, 3, 5, 7, 9, 10, 14, *[w + x for w in (8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512) for x in (3, 6)], 640]))
    items = [prose(n, 30000 + n) for n in sizes]
    index = D.Index(list(enumerate(items)))
    for kind in ("deleted", "swapped", "added", "mixed"):
        for k, item in enumerate(items):
            texts = [" ".join([prose(rnd.randrange(60), rnd.random()), *edited(item.split(), kind, rnd), prose(20, rnd.random())]) for _ in range(4)]
            blob = [t.encode() for t in texts]
            got = index.search(np.frombuffer(b"".join(blob), np.uint8), np.r_[0, np.cumsum([len(b) for b in blob])])
            assert [t for t in range(4) if (t, k) in got] == [0, 1, 2, 3], (kind, sizes[k])
            if sizes[k] < 70:
                assert got[0, k] == edit_distance(item.split(), texts[0].split())


def blob(texts):
    own = [t.encode() for t in texts]
    return np.frombuffer(b"".join(own), np.uint8), np.r_[0, np.cumsum([len(b) for b in own])]


def test_hits_come_through_the_embedding(prose):
    """Without its keys the index finds nothing, and with fewer repetitions it finds less."""
    rnd = random.Random(6)
    items = [prose(n, 700 + n) for n in range(13, 63)]
    index = D.Index(list(enumerate(items)))
    texts = [" ".join([prose(30, n), *edited(i.split(), "mixed", rnd)]) for n, i in enumerate(items)]
    whole = index.search(*blob(texts))
    assert len([1 for k in range(len(items)) if (k, k) in whole]) == len(items)
    classes = index.classes
    index.classes = [(*own, tables[:1]) for *own, tables in classes]
    some = index.search(*blob(texts))
    assert set(some) < set(whole) and all(whole[p] == d for p, d in some.items())
    index.classes = []
    assert index.search(*blob(texts)) == {}


def test_repetitions_follow_the_measured_agreement():
    """Longer walks agree less and take more keys; more windows take fewer; items without edits take one."""
    assert D.repetitions(4, 0, 4, 1) == 1
    assert D.repetitions(15, 3, 8, 4) > D.repetitions(30, 6, 8, 4) > D.repetitions(90, 18, 8, 4)
    assert [D.width_of(n, n // 5)[0] for n in (5, 12, 13, 37, 59, 100, 640)] == [5, 12, 8, 12, 16, 24, 64]
    assert list(D.AGREES.values()) == sorted(D.AGREES.values(), reverse=True)


def test_templates_and_equal_items_are_cheap(prose):
    """3,000 items of one template against one document: all of them, in well under a second; equal items once."""
    import time

    template = prose(38, 77).split()
    items = [(k, " ".join([*template[:20], f"name{k}", *template[20:]])) for k in range(3000)] + [(9000 + k, " ".join(template)) for k in range(50)]
    index = D.Index(items)
    assert len(index.items) == 3001 and index.ids[3000] == list(range(9000, 9050))
    text = prose(150, 78) + " " + " ".join([*template[:20], "other", *template[20:]]) + " " + prose(150, 79)
    started = time.perf_counter()
    got = index.search(*blob([text]))
    assert time.perf_counter() - started < 3
    assert got == {(0, k): 1 for k in range(3001)}


def test_ids_of_any_type(spark, prose):
    bench = spark.createDataFrame([("q-1", prose(30, 1)), ("q-2", prose(30, 1)), (None, prose(40, 2))], "item_id string, text string")
    docs = spark.createDataFrame([("a", prose(30, 1)), ("b", prose(40, 2)), ("c", prose(90, 3))], "doc_id string, text string")
    assert sorted(map(str, ((r.doc_id, r.item_id, r.edits) for r in D.matches(docs, bench).collect()))) == sorted(map(str, [("a", "q-1", 0), ("a", "q-2", 0), ("b", None, 0)]))
