import hashlib
import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from polyquilt.llm import bpe
from tests.llm.conftest import SF

PATH = bpe.word_vocabulary_path()
LIBRARY = Tokenizer.from_file(PATH)


def expect(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def both(text):
    column = pa.array([text, None, text])
    n, _, again = bpe.count_texts(PATH, column).tolist()
    ids, none, same = bpe.encoded(PATH, column)
    assert n == again and ids == same and none == b""
    return n, np.frombuffer(ids, "<u4").tolist(), bpe.decode_ids(bpe.vocabulary(PATH), ids).decode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs", "Cn"]), st.sampled_from("abcdeéßİıΣ'st <|>\n\x1c\x85\xa0")), max_size=40))
def test_any_text_is_tokenised_as_the_library_does(text):
    n, ids, decoded = both(text)
    want, back = expect(text)
    assert (n, ids, decoded) == (len(want), want, back)


def test_special_strings_and_long_chunks():
    for text in ("a<|endoftext|>b <|startoftext|>", "<|endoftext|", "aaaa" * 999 + "!!!" * 333, "it's we'll 'S", "thththth" * 50):
        n, ids, decoded = both(text)
        want, back = expect(text)
        assert (n, ids, decoded) == (len(want), want, back)


def test_table_of_ranks():
    v = bpe.vocabulary(PATH)
    import json

    spec = json.load(open(PATH))["model"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["merges"]]
    left, right = (np.array([spec["vocab"][p[k]] for p in pairs]) for k in (0, 1))
    assert v.ranks(left, right).tolist() == list(range(len(pairs)))
    assert set(v.ranks(right[:50] * 0 - 1, left[:50]).tolist()) == {int(bpe.NO_RANK)}


def test_hard_rows(hard_docs, no_docs):
    texts = {r["doc_id"]: r["text"] for r in hard_docs.collect()}
    counted = bpe.count_tokens(hard_docs, PATH).collect()
    digests = bpe.encode_digest(hard_docs, PATH).collect()
    assert len(counted) == len(digests) == hard_docs.count()
    for r in counted:
        if r["doc_id"] is not None:
            n = len(expect(texts[r["doc_id"]])[0])
            assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((texts[r["doc_id"]] or "").encode()), n > 2048)
    for r in digests:
        if r["doc_id"] is not None:
            ids, back = expect(texts[r["doc_id"]])
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    assert bpe.count_tokens(no_docs, PATH).count() == bpe.encode_digest(no_docs, PATH).count() == 0


def test_queries_on_the_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in bpe.op2_token_counts(spark, SF).join(bpe.op10_bpe(spark, SF).withColumnRenamed("n_tokens", "m"), "doc_id").collect():
        ids, _ = expect(texts[r["doc_id"]])
        assert r["n_tokens"] == r["m"] == len(ids)


def test_full_memo_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 3)
    for text in ("alpha beta gamma", "beta delta", "epsilon zeta eta theta alpha", "beta alpha"):
        n, ids, _ = both(text)
        assert ids == expect(text)[0] and n == len(ids)


def test_long_chunks_are_not_kept():
    """Unspaced texts leave nothing in a worker's memos, and spaced ones no more than their bound."""
    path = bpe.word_vocabulary_path()
    rnd = random.Random(5)
    long = ["".join(rnd.choice("abcdefghij") for _ in range(1500)) for _ in range(40)]
    short = [f"word{k}" for k in range(50)]
    bpe._SIZES.clear(), bpe._IDS.clear()
    for text in (long, short, long):
        column = pa.array([" ".join(text)])
        bpe.count_texts(path, column), bpe.encode_texts(path, column)
    for memos in (bpe._SIZES, bpe._IDS):
        kept = [c for memo in memos[path] for c in memo]
        assert set(map(bytes.decode, kept)) == set(short)
