import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from polyquilt.llm import bpe, packing

PATH = bpe.word_vocabulary_path()


def brute(sizes, capacity):
    rooms, bins = [], []
    for k, n in enumerate(sizes):
        fit = [(r, -b) for b, r in enumerate(rooms) if r >= n]
        if fit:
            b = -min(fit)[1]
            rooms[b] -= n
            bins[b].append(k)
        else:
            rooms.append(capacity - n)
            bins.append([k])
    return bins


@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_against_brute_force(sizes):
    sizes = sorted(sizes, reverse=True)
    got, want = packing.best_fit(sizes, 64), brute(sizes, 64)
    assert sorted(k for b in got for k in b) == list(range(len(sizes)))
    assert sorted(sum(sizes[k] for k in b) for b in got) == sorted(sum(sizes[k] for k in b) for b in want)


def test_round_trip(spark, hard_docs, no_docs):
    library = Tokenizer.from_file(PATH)
    rows = packing.pack(hard_docs, PATH, capacity=64, pad=9, block_docs=5).collect()
    found = {}
    assert packing.matrix([r["ids"] for r in rows]).shape == packing.matrix([r["positions"] for r in rows], "<u2").shape == (len(rows), 64)
    for r in (r.asDict() | {"ids": np.frombuffer(r["ids"], "<u4").tolist(), "positions": np.frombuffer(r["positions"], "<u2").tolist()} for r in rows):
        assert len(r["ids"]) == len(r["positions"]) == 64 and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] <= 64
        assert set(r["ids"][r["n_tokens"] :]) <= {9} and not any(r["positions"][r["n_tokens"] :])
        for d, piece, a, b in zip(r["doc_ids"], r["pieces"], r["cu_seqlens"][:-1], r["cu_seqlens"][1:], strict=True):
            assert r["positions"][a:b] == list(range(b - a))
            found.setdefault(d, []).append((piece, r["ids"][a:b]))
    want = {}
    for r in hard_docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.setdefault(r["doc_id"], []).extend([ids] if ids else [])
    for d, texts in want.items():
        if len(texts) == 1:
            pieces = sorted(found[d])
            assert [p for p, _ in pieces] == list(range(len(pieces))) and [i for _, x in pieces for i in x] == texts[0]
    assert sum(len(x) for v in found.values() for _, x in v) == sum(len(x) for v in want.values() for x in v)
    assert packing.pack(no_docs, PATH).count() == 0


def test_rows_are_well_filled(spark):
    rows = packing.pack(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), PATH).collect()
    assert np.mean([r["n_tokens"] for r in rows]) > 0.97 * packing.CAPACITY


def test_rows_of_one_id_spread_over_blocks(spark):
    rows = [(None, "the same few words in every row")] * 3000 + [(5, "and others under one id")] * 1000
    out = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), bpe.word_vocabulary_path(), block_docs=100)
    per = {r["block"]: r["n"] for r in out.selectExpr("block", "size(doc_ids) AS n").groupBy("block").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert sum(per.values()) == 4000 and len(per) == 40 and max(per.values()) < 200
