import hashlib
import zlib

import pytest

from polyquilt.llm import merkle

from .conftest import SF


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def frame(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def brute(rows):
    """{(doc_id, leaf): (subroot, root, proof digest, folded root)} of (doc_id, source, lang, n_chars, text) rows."""
    groups = {}
    for r in rows:
        leaf = H(*map(frame, r))
        tampered = leaf
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
            tampered = H(*map(frame, (*r[:4], r[4].replace("\n", ""))))
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf, tampered, r[0]))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[2] for x in sorted(groups[s])]) for s in order}
    top = levels_of([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, _, leaf, tampered, doc) in enumerate(sorted(groups[s])):
            node, proof = tampered, ""
            for tree, at in ((trees[s], i), (top, k)):
                for level in tree[:-1]:
                    run = level[at - at % 3 : at - at % 3 + 3]
                    proof += "".join(run[: at % 3] + run[at % 3 + 1 :])
                    node = H(*run[: at % 3], node, *run[at % 3 + 1 :])
                    at //= 3
            out.append((doc, leaf, trees[s][-1][0], top[-1][0], H(proof), node, node == top[-1][0]))
    return sorted(out, key=repr)


def query(spark, docs, path):
    docs.write.parquet(f"{path}/documents.parquet")
    return sorted(map(tuple, merkle.op11_merkle_manifest(spark, str(path)).collect()), key=repr)


def fields(docs):
    return [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_blocks_of_any_height_give_the_same_tree(spark, tmp_path, monkeypatch, levels):
    """Groups below, at and above a block's size, and more groups than a block holds."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    sizes = {None: 1, "": 2, "a": 3, "B": 9, "é": 10, "c": 28, "d": 82, "e": 4, "f": 1, "g": 1, "h": 1}
    rows, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            k += 7
            rows.append((k % 1009, source, None if k % 5 == 0 else "en", k, f"line {k}\nmore" if k % 3 else f"line {k}"))
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert query(spark, docs, tmp_path) == brute(rows)


def test_hard_rows(spark, hard_docs, tmp_path):
    docs = hard_docs.selectExpr("*", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN '-' ELSE 'idx' END AS source", "n AS n_chars", "1 AS idx", "'x' AS g", "2 AS block", "'y' AS node", "'z' AS root")
    assert query(spark, docs, tmp_path) == brute(fields(docs))


def test_no_rows(spark, no_docs, tmp_path):
    assert query(spark, no_docs.selectExpr("*", "key AS source", "n AS n_chars"), tmp_path) == []


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, merkle.op11_merkle_manifest(spark, SF).collect()), key=repr)
    assert got == brute(fields(docs))
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_a_changed_sibling_breaks_the_fold():
    nodes = [hashlib.sha256(bytes([k])).digest() for k in range(8)]
    root, proofs = merkle.walk(nodes, merkle.height(8))
    for k, (node, proof) in enumerate(zip(nodes, proofs)):
        assert merkle.fold(node, k, 8, bytes(proof)) == (root, len(proof))
        spoilt = bytes([proof[0] ^ 1]) + bytes(proof[1:])
        assert merkle.fold(node, k, 8, spoilt)[0] != root


