"""The report over the engine's own results, file listings and logs."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from polyquilt.functions import catalog
from polyquilt.operators import report, search


@pytest.fixture(scope="module")
def found(spark):
    out = search.unique(search.solutions(spark, 2)).persist()
    yield out
    out.unpersist()


def test_report_of_results(spark, found, tmp_path):
    rows = found.collect()
    base = {t.type_id: t.symbol[: t.symbol.index(")") + 1] for t in catalog.vertex_types()}
    members = report.result_members(found)
    report.write_report(members, found, str(tmp_path / "r"))
    read = lambda name: [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "r" / name)).collect()]
    sizes = Counter((str(r["k"]), r["combo"].split("_")[1], ) for r in rows)
    assert sorted(read("polygon_signatures")) == sorted((k, s, str(n)) for (k, s), n in sizes.items())
    uses = Counter(b for r in rows for b in {base[t] for t in r["types"]})
    assert [(b, str(n)) for b, n in sorted(uses.items(), key=lambda x: (-x[1], x[0]))[:20]] == [(b, str(n)) for b, n in map(tuple, report.overall_top(members, 20).collect())]
    by_k = Counter((str(r["k"]), b) for r in rows for b in {base[t] for t in r["types"]})
    totals = Counter(str(r["k"]) for r in rows)
    assert sorted((k, b, n, float(share)) for k, b, n, share in read("configuration_prevalence")) == sorted((k, b, str(n), round(n / totals[k], 6)) for (k, b), n in by_k.items())
    spread = Counter((str(r["k"]), len({base[t] for t in r["types"]})) for r in rows)
    assert sorted(read("m_distribution")) == [(k, str(spread[k, 1]), str(spread[k, 2]), str(totals[k])) for k in sorted(totals)]
    assert sum(int(n) for *_, n in read("reuse_statistics")) == len(rows) == 30
    assert {k: t for k, t, *_ in read("reuse_statistics")} == {k: str(n) for k, n in totals.items()}
    assert sorted(read("growth")) == [("1", "10", None), ("2", "20", "2.0")]
    with pytest.raises(Exception, match="(?i)exists"):
        report.write_report(members, found, str(tmp_path / "r"))


def test_empty_and_null(spark):
    none = spark.createDataFrame([], "k int, id long, member string, combo string")
    assert report.overall_top(none, 3).count() == report.size_signatures(none).count() == report.seeded_pick(none, "id", 1).count() == 0
    row = spark.sql("SELECT cast(NULL AS bigint) AS x").select(report.duration_text(F.col("x")).alias("a"), report.count_text(F.col("x")).alias("b"), report.rate_text(F.col("x")).alias("c"), report.byte_text(F.col("x")).alias("d"), report.lowest_bit(F.col("x")).alias("e")).first()
    assert list(row) == [None] * 5


def test_texts(spark):
    row = spark.sql("SELECT 7325.9D AS s, 1234567L AS n, 0L AS z").select(report.duration_text(F.col("s")), report.count_text(F.col("n")), report.rate_text(F.col("s")), report.byte_text(F.col("z")), report.lowest_bit(F.col("z"))).first()
    assert list(row) == ["2h2m", "1.2M", "7K/s", "0B", None]


def test_listing(spark, tmp_path):
    for name in ("run_02_34.bin.zst", "run_02_34.bin", "part_10.bin", "part_9.bin", "other.txt"):
        (tmp_path / name).write_bytes(b"abc")
    got = {r["path"].rsplit("/", 1)[1]: (r["length"], r["combo"], r["number"]) for r in report.listing(spark, str(tmp_path), "*.bin*", "run_").collect()}
    assert got == {"run_02_34.bin.zst": (3, "02_34", 34), "run_02_34.bin": (3, "02_34", 34), "part_10.bin": (3, "part_10", 10), "part_9.bin": (3, "part_9", 9)}


def test_phase_times(spark):
    logs = spark.createDataFrame([(1, "Solver phase: 1.5s (42 partials)"), (1, "Pruner phase: 0.25s"), (1, None), (2, "Solver phase: 2s"), (2, "Solver phase: 3s")], "run int, line string")
    assert sorted(tuple(r) for r in report.phase_times(logs).collect()) == [(1, 1.5, 0.25, 42), (2, None, None, None)]


def test_pick_is_among_all_orders(spark, tmp_path):
    """The least draw decides, whatever an order's status."""
    from hashlib import md5

    from polyquilt.plans import report_queries

    orders = [(k, "FP"[k % 2]) for k in range(1, 60)]
    for last in (20, 40, 60):
        folder = tmp_path / str(last)
        spark.createDataFrame(orders[: last - 1], "o_orderkey bigint, o_orderstatus string").write.parquet(f"{folder}/orders.parquet")
        want = min((md5(f"7:{k}".encode()).hexdigest(), k) for k, _ in orders[: last - 1])[1]
        assert [r["o_orderkey"] for r in report_queries.seeded_pick(spark, str(folder)).collect()] == [want]
