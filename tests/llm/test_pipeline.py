import random

import corpus_pipeline
from polyquilt.llm import bpe, decontaminate, lines, neardup, quality
from tests.llm.conftest import SF
from tests.llm.test_bpe import expect
from tests.llm.test_decontaminate import edit_distance, edited
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_neardup import brute as brute_classes


def test_stages_one_by_one(spark):
    """Each stage on all that the one before kept, against brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "bpe_ids"]
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "bpe_ids":
            assert out.columns == docs.columns
            out = spark.createDataFrame(out.collect(), docs.schema)
        seen.append((name, {r["doc_id"]: r["text" if name != "bpe_ids" else "decoded"] for r in out.collect()}))
        docs = out
    kept = dict(seen)
    verdict = {r["doc_id"]: r["kept"] for r in quality.judge(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert kept["quality_rules"] == {d: t for d, t in rows.items() if verdict[d]}
    assert kept["line_dedup"] == brute_lines(list(kept["quality_rules"].items()))
    classes = brute_classes(list(kept["line_dedup"].items()))
    assert set(kept["near_dedup"]) == {d for d, c in classes.items() if c == d}
    assert set(kept["decontamination"]) <= set(kept["near_dedup"])
    assert kept["bpe_ids"] == {d: expect(t)[1] for d, t in kept["decontamination"].items()}
    whole = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {d: len(expect(t)[0]) for d, t in kept["decontamination"].items()}
    assert all((bpe, decontaminate, lines, neardup))


def test_decontamination_against_exact_edit_distance(spark, prose, tmp_path):
    """The stage and op1 on passages with up to 20 % edits, and some just beyond, against the distance to any run of words."""
    rnd = random.Random(8)
    items = [(k, prose(n, 40000 + k)) for k, n in enumerate([4, 9, 10, 12, 16, 21, 30, 38, 52, 70])]
    docs = [(1000 + k, prose(60, 50000 + k)) for k in range(5)]
    for k, item in items:
        for more, kind in ((0, "mixed"), (0, "deleted"), (2, "swapped")):
            words = edited(item.split(), kind, rnd)
            for p in rnd.sample(range(len(words)), min(more, len(words))):
                words[p] = "beyond"
            docs.append((len(docs), " ".join([prose(rnd.randrange(40), rnd.random()), *words, prose(20, rnd.random())])))
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = {}
    for d, t in docs:
        for k, item in items:
            edits = edit_distance(item.split(), t.split())
            if 5 * edits <= len(item.split()):
                want[d, k] = edits
    assert 20 <= len(want) < 3 * len(items)
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.op1_decontaminate(spark, str(tmp_path)).collect()}
    assert got == want
    kept = {r["doc_id"] for r in corpus_pipeline.decontamination(spark, table, str(tmp_path)).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_hard_rows(spark, hard_docs, no_docs):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns: every stage keeps the columns and its rules hold; an empty table stays empty."""
    docs = hard_docs.selectExpr("*", "'s' AS source", "length(text) AS n_chars", "'x' AS line", "1 AS bands", "'y' AS ids", "0 AS component")
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        kept[name] = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
    # null, empty, short and upper-case texts fail a rule; copies of a row are judged alike
    assert {i for i, _ in kept["quality_rules"]} == {1, 2, 3, 4, 8, 9, None}
    assert [i for i, _ in kept["quality_rules"]].count(4) == 2
    texts = dict(kept["line_dedup"])
    # the first of equal or near lines stays, in the document of the least id; a row without an id keeps its lines
    assert texts[2] == texts[3] == "" and texts[1] and texts[None] == texts[1]
    assert {i for i, _ in kept["near_dedup"]} >= {1, 4, 8, 9, None}
    assert set(kept["decontamination"]) <= set(kept["near_dedup"])
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted((r["doc_id"], r["decoded"], r["n_tokens"]) for r in last if r["doc_id"] is not None) == sorted((i, expect(t)[1], len(expect(t)[0])) for i, t in kept["decontamination"] if i is not None)
    empty = no_docs.selectExpr("*", "'s' AS source", "n AS n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, SF)
        assert out.count() == 0 and (name == "bpe_ids" or out.columns == empty.columns)
