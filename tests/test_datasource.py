"""Record files: splits, pushed filters, commit and abort."""

import glob
import io
import json
import os

import pytest
from pyspark.sql import functions as F

from polyquilt.sources import datasource as D

SCHEMA = "id long, name string, x double, ok boolean"
ROWS = [(k, None if k % 7 == 0 else f"line {k}\nNumber of polygons:\n\r {'é' * (k % 40)}  ", None if k % 5 == 0 else k / 3, k % 2 == 0) for k in range(300)]


@pytest.fixture
def source(spark):
    spark.dataSource.register(D.RecordFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def load(spark, path, layout, split=900, push="false"):
    return spark.read.format("polyquilt_records").schema(SCHEMA).option("layout", layout).option("splitBytes", split).option("push", push).load(path)


@pytest.mark.parametrize("layout", ["text", "packed"])
def test_round_trip_and_filters(spark, source, tmp_path, layout):
    path = str(tmp_path / "r")
    source.write.format("polyquilt_records").option("layout", layout).option("splitBytes", 3000).mode("append").save(path)
    back = load(spark, path, layout)
    assert sorted(map(tuple, back.collect())) == ROWS
    assert back.rdd.getNumPartitions() > 5
    for text, keep in {
        "id > 17 AND id <= 30": lambda r: 17 < r[0] <= 30,
        "name IS NULL": lambda r: r[1] is None,
        "x IS NOT NULL AND x < 9.5": lambda r: r[2] is not None and r[2] < 9.5,
        "id IN (1, 2, 999) OR ok": lambda r: r[0] in (1, 2) or r[3],
        "ok = true AND id >= 290": lambda r: r[3] and r[0] >= 290,
        "name <=> NULL AND id IN (7, 8)": lambda r: r[0] == 7,
        "length(name) > 40 AND id < 200": lambda r: r[1] is not None and len(r[1]) > 40 and r[0] < 200,
    }.items():
        for own in (back, load(spark, path, layout, push="true")):
            assert sorted(map(tuple, own.filter(text).collect())) == [r for r in ROWS if keep(r)], text
    source.limit(1).write.format("polyquilt_records").option("layout", layout).mode("append").save(path)
    assert load(spark, path, layout).count() == 301
    source.filter("id < 5").write.format("polyquilt_records").option("layout", layout).mode("overwrite").save(path)
    assert load(spark, path, layout).count() == 5 and os.path.exists(f"{path}/_SUCCESS")


def test_the_reader_tests_what_is_pushed(spark, source, tmp_path):
    path = str(tmp_path / "r")
    source.write.format("polyquilt_records").mode("append").save(path)
    reader = D.RecordReader(source.schema, {"path": path, "push": "true"})
    left = list(reader.pushFilters([D.EqualTo(("ok",), True), D.GreaterThan(("id",), 280), D.EqualTo(("other",), 1)]))
    assert left == [D.EqualTo(("other",), 1)]
    rows = [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(rows) == [r for r in ROWS if r[3] and r[0] > 280]
    assert len(list(D.RecordReader(source.schema, {"path": path}).pushFilters([D.IsNull(("x",))]))) == 1


def test_every_split_of_a_text_gives_each_record_once(tmp_path):
    data = b"".join(D.MARK + b"\n" + json.dumps(r[0]).encode() + b"\n" + json.dumps(r[1]).encode() + b"\n" for r in ROWS[:30])
    for step in (1, 2, 7, 50, 10_000):
        found = [v for a in range(0, len(data), step) for v in D.text_records(io.BytesIO(data), a, min(a + step, len(data)), 2)]
        assert found == [list(r[:2]) for r in ROWS[:30]]


@pytest.mark.parametrize("layout", ["text", "packed"])
def test_an_aborted_write_leaves_nothing(spark, source, tmp_path, layout):
    path = str(tmp_path / "r")
    source.filter("id < 9").write.format("polyquilt_records").option("layout", layout).mode("append").save(path)
    before = sorted(os.listdir(path))
    bad = source.withColumn("id", F.when(F.col("id") == 250, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("long"))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("polyquilt_records").option("layout", layout).option("splitBytes", 500).mode("append").save(path)
    assert sorted(os.listdir(path)) == before and load(spark, path, layout).count() == 9


def test_damaged_files_and_wrong_calls(spark, source, tmp_path):
    for layout in ("text", "packed"):
        path = str(tmp_path / layout)
        source.coalesce(1).write.format("polyquilt_records").option("layout", layout).mode("append").save(path)
        (name,) = glob.glob(f"{path}/part-*")
        whole = open(name, "rb").read()
        for data in (whole[:-40], whole + (b"\x00" if layout == "packed" else D.MARK + b"\n1\n"), whole[:5]):
            with open(name, "wb") as f:
                f.write(data)
            if layout == "text" and data == whole[:5]:
                continue  # a text that lacks its first line whole is no record
            with pytest.raises(Exception, match="ends early|goes on|values instead|JSON|Unterminated|Expecting"):
                load(spark, path, layout, 1 << 20).collect()
    with pytest.raises(Exception, match="layout"):
        load(spark, path, "other").collect()
    with pytest.raises(Exception, match="give a schema"):
        spark.read.format("polyquilt_records").load(path)
    with pytest.raises(Exception, match="plain types"):
        source.select(F.array("id").alias("a")).write.format("polyquilt_records").mode("append").save(path)
