"""The commands, one after the other."""

import json

import pytest

from polyquilt.__main__ import main
from polyquilt.functions import text


def test_commands(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    assert main(["count", "--k-max", "2"], spark) == 0
    assert capsys.readouterr().out.split("\n")[:2] == ["k=1: 10", "k=2: 20"]
    assert main(["solve", "--k-max", "2", "--out", at("found")], spark) == 0
    assert spark.read.parquet(at("found")).count() == 30
    assert main(["report", "--solutions", at("found"), "--out", at("report")], spark) == 0
    assert sorted(r[:2] for r in map(tuple, spark.read.option("header", True).csv(at("report") + "/growth").collect())) == [("1", "10"), ("2", "20")]
    assert main(["texts", "--solutions", at("found"), "--k", "2", "--out", at("texts")], spark) == 0
    assert spark.read.option("lineSep", "\n\n").text(at("texts")).count() == 20
    assert main(["documents", "--solutions", at("found"), "--k", "1", "--out", at("documents")], spark) == 0
    docs = spark.read.parquet(at("documents")).collect()
    assert len({r.filename for r in docs}) == len(docs) == 10 and all(text.parse_document(r.document) for r in docs)
    assert main(["lattices", "--solutions", at("found"), "--out", at("store")], spark) == 0
    assert main(["export", "--store", at("store"), "--out", at("json")], spark) == 0
    assert main(["import", "--json", at("json"), "--out", at("again")], spark) == 0
    assert spark.read.parquet(at("again") + "/records").count() == spark.read.parquet(at("store") + "/records").count() == 30
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text(json.dumps({"_failures": {"lost": "why"}}))
    assert main(["import", "--json", at("bad"), "--out", at("partial")], spark) == 1
    assert "lost: why" in capsys.readouterr().err


def test_wrong_calls(spark, capsys):
    for argv in ([], ["solve"], ["solve", "--k-max", "x", "--out", "y"], ["nothing"]):
        with pytest.raises(SystemExit):
            main(argv, spark)
