import zlib

import numpy as np
import pyarrow as pa
import pytest

from polyquilt.llm import classifier, common

from .conftest import SF


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


def loud(prose, k):
    text = prose(60 + k % 90, k)
    return "\n".join(w.upper() + "!!" for w in text.split()) if k % 3 == 0 else text + "\n" + prose(70, k + 5000)


@pytest.fixture(scope="module")
def labelled(spark, prose):
    docs = spark.createDataFrame([(k, loud(prose, k)) for k in range(240)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 != 0), 0) for k in range(240)], "doc_id long, quality int, toxic int")
    return docs, labels, classifier.fit(docs, labels)


def test_held_out_rows(spark):
    """Rows that were not learned from are told apart; each row is returned once, whole."""
    rows = classifier.op12_quality_classifier(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert all(r.held_out == held(r.doc_id) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    quality = dict(map(tuple, spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect()))
    own = [(r.score, quality[r.doc_id]) for r in rows if r.held_out and r.doc_id in quality]
    assert auc(own) > 0.95
    assert all(r.predicted for r in rows if r.held_out and quality.get(r.doc_id) == 1)


def test_a_block_is_the_plain_model(labelled, prose):
    """Chunks, blocks and segment sums give what a loop over passages gives."""
    _, _, model = labelled
    texts = ["", " \n", prose(10, 1), prose(3000, 2), "X" * 9000, loud(prose, 3), prose(64, 4), prose(65, 5)]
    data, offsets = common.raw(pa.array(texts))
    got = classifier.score_block(model, data, offsets)
    for text, score in zip(texts, got):
        own = np.frombuffer(text.encode(), np.uint8)
        starts, ends, _ = classifier.passages(own, np.array([0, len(own)]))
        hs, es = [], []
        for s, e in zip(starts, ends):
            x = classifier.encode(own, np.array([s]), np.array([e]))[0]
            h = np.tanh(x @ model["W"] + model["b"])
            hs.append(h)
            es.append((np.tanh(h @ model["V"]) * (1 / (1 + np.exp(-(h @ model["U"]))))) @ model["w"])
        a = np.exp(np.array(es) - max(es))
        z = (a / a.sum()) @ np.array(hs)
        assert abs(1 / (1 + np.exp(-(z @ model["c"] + model["d"][0]))) - score) < 1e-4


def test_passages_cover_the_text(prose):
    text = "\n ".join([prose(200, 1), "X" * 9000, prose(65, 2)])
    own = np.frombuffer(text.encode(), np.uint8)
    starts, ends, of = classifier.passages(own, np.array([0, len(own)]))
    assert starts[0] == 0 and ends[-1] == len(own) and (starts[1:] == ends[:-1]).all() and of[-1] == len(starts)
    assert (ends - starts).max() <= classifier.PASSAGE_BYTES


def test_gradients():
    rnd = np.random.default_rng(3)
    model = {k: v.astype(np.float64) for k, v in classifier._start(rnd).items()}
    x, offsets, y = rnd.random((7, classifier.WIDTH)), np.array([0, 1, 4, 7]), np.array([1.0, 0.0, 1.0])
    _, grads = classifier.gradients(model, x, offsets, y)
    for name, values in model.items():
        at = tuple(rnd.integers(0, s) for s in values.shape)
        for step, sign in ((1e-5, 1), (-2e-5, -1)):
            values[at] += step
            loss = classifier.gradients(model, x, offsets, y)[0]
            high = loss if sign == 1 else high
        values[at] += 1e-5
        assert abs((high - loss) / 2e-5 - grads[name][at]) < 1e-4, name


def test_attention_finds_the_bad_passage(labelled, prose):
    """A loud passage among clean ones weighs more than they do on average, and lowers the score."""
    _, _, model = labelled
    clean = [prose(64, 900 + k) for k in range(4)]
    bad = "\n".join(w.upper() + "!!" for w in prose(64, 950).split())
    data, offsets = common.raw(pa.array(["\n".join(clean), "\n".join([*clean, bad, bad, bad, bad])]))
    a, b = classifier.score_block(model, data, offsets)
    assert a > 0.5 and b < a


def test_hard_rows(spark, labelled, hard_docs, no_docs):
    docs, labels, _ = labelled
    clash = hard_docs.selectExpr("*", "'x' AS k", "'y' AS t", "1 AS score2", "0 AS y", "1 AS quality")
    same = docs.selectExpr("doc_id + 1000 AS doc_id", "text", "'k' AS k", "'t' AS t", "0 AS y", "1 AS size")
    odd = labels.selectExpr("doc_id + 1000 AS doc_id", "quality", "toxic", "'k' AS k", "'t' AS text").unionAll(spark.sql("SELECT NULL, 1, 1, 'a', 'b' UNION ALL SELECT 1003L, NULL, 1, 'a', 'b' UNION ALL SELECT 1003L, 0, 1, 'a', 'b' UNION ALL SELECT 1006L, 7, 1, 'a', 'b' UNION ALL SELECT 5L, 1, 1, 'a', 'b'"))
    model = classifier.fit(same.unionAll(same), odd)
    rows = classifier.scored(clash, model).collect()
    assert len(rows) == clash.count() and all(0 <= r.score <= 1 for r in rows)
    found = {}
    for r, d in zip(sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id, r.score)), sorted(hard_docs.collect(), key=lambda d: (d.doc_id is None, d.doc_id))):
        found.setdefault(d.text, set()).add(round(r.score, 5)) if d.doc_id is not None else None
    assert all(len(s) == 1 for s in found.values())
    assert classifier.scored(no_docs, model).count() == 0
    # one label only, or none: a constant
    assert classifier.fit(docs, labels.filter("quality = 1")) > 0.9
    assert classifier.fit(docs, labels.filter("false")) == 0.5
    assert classifier.fit(no_docs, labels) == 0.5
    assert [r.score for r in classifier.scored(docs.limit(1), 0.5).collect()] == [0.5]


def test_the_sample_is_bounded(spark, labelled):
    docs, labels, model = labelled
    assert isinstance(classifier.fit(docs, labels, fit_docs=1), float)
    assert isinstance(classifier.fit(docs, labels, fit_bytes=10), float)
    again = classifier.fit(docs.repartition(7), labels.repartition(3))
    assert all((again[k] == model[k]).all() for k in model)
