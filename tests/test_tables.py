"""Search, stores, conversion and streaming over tables."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from polyquilt.functions import codec, geometry, text
from polyquilt.functions.states import frame, pack
from polyquilt.operators import analytics, reconcile, report, search
from polyquilt.sources import lattices, solutions, tilings
from polyquilt.streaming import convert


@pytest.fixture(scope="module")
def results(spark):
    return search.unique(search.solutions(spark, 2)).persist()


@pytest.fixture(scope="module")
def documents(spark, results):
    made = tilings.documents(results)
    assert made.filter("error IS NOT NULL").count() == 0
    ids = F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("k", "combo", "document"))
    return made.select(ids.cast("long").alias("id"), "combo", "signature", F.concat(F.lit("eu "), "signature", F.lit(".tes")).alias("filename"), "document").persist()


def test_counts_do_not_depend_on_fan_out(spark, results):
    assert {r["k"]: r["n"] for r in results.groupBy("k").agg(F.count("*").alias("n")).collect()} == {1: 10, 2: 20}
    wide = search.unique(search.solutions(spark, 2, target=100_000))
    assert sorted(map(tuple, wide.select("k", F.hex("code")).collect())) == sorted(map(tuple, results.select("k", F.hex("code")).collect()))


def test_other_dedups_agree(spark, results):
    found = search.solutions(spark, 2).filter("minimal")
    for rows in (solutions.wl_unique(found), solutions.wl_unique(found, trust_hash=True), solutions.word_unique(found)):
        assert {r["k"]: r["n"] for r in rows.groupBy("k").agg(F.count("*").alias("n")).collect()} == {1: 10, 2: 20}


def test_combo_column(results):
    for r in results.collect():
        assert r["combo"] == text.combo(tuple(r["types"]))


def test_text_files_round_trip(spark, results, tmp_path):
    rows = solutions.with_texts(results).collect()
    blocks = [f"Number of polygons: {r['k']}\n{r['vertices']}\n{r['signature']}\neu raw {r['file_signature']} 1.tes\n{r['conway']}\n0: cycle\n---\n(0)\n\n" for r in rows]
    (tmp_path / "a.txt").write_text("".join(blocks[:20]))
    (tmp_path / "b.txt").write_text("".join(blocks[20:]) + "Number of polygons: 1\n(6,6,6)S\n")
    read = solutions.read_text(spark, str(tmp_path))
    assert read.filter("error IS NULL").count() == 30 and read.filter("error IS NOT NULL").count() == 1
    back = solutions.decode_text(read)
    assert back.filter("error IS NULL").count() == 30 and solutions.invalid(back.filter("error IS NULL")).count() == 0
    texts = [r.value.split("\n") for r in solutions.to_text(solutions.with_texts(results)).collect()]
    assert len(texts) == 30
    for own in texts:
        cut = own.index("---")
        assert own[2].startswith("Count type: ") and own[3].startswith("eu ") and 0 < len(own[5:cut]) and own[cut + 2 :] == [""]
        state = text.decode(own[0], own[4])
        assert state and text.faces(frame(state[0]), state[1])[1:] == (own[cut + 1], own[5:cut])


def test_binary_files(spark, results, tmp_path):
    rows = results.collect()
    (tmp_path / "a.bin").write_bytes(b"".join(pack(r["types"], r["glue"]) for r in rows))
    assert solutions.read_binary(spark, str(tmp_path)).count() == 30
    with pytest.raises(ValueError):
        list(solutions.records(pack([0], [-1] * 3)))
    with pytest.raises(ValueError):
        list(solutions.records(pack(rows[0]["types"], rows[0]["glue"])[:-1]))


def test_invalid_states_are_found(spark):
    bad = spark.createDataFrame([([0], [1, 2, 0]), ([0], [7, -1, -1]), ([0], [-1, -1, -1])], "types array<int>, glue array<int>")
    assert solutions.invalid(bad).count() == 2


def test_result_store_is_pruned(spark, results, tmp_path):
    path = str(tmp_path / "store")
    solutions.write(results, path)
    one = solutions.read(spark, path, combo="01_4")
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(combo" in plan and one.count() == results.filter("combo = '01_4'").count()
    ranged = solutions.read(spark, path, buckets=(0, 32))
    assert "PushedFilters: [IsNotNull(bucket)" in ranged._jdf.queryExecution().toString()
    assert ranged.count() + solutions.read(spark, path, buckets=(32, 64)).count() == 30
    assert reconcile.misplaced(spark.read.parquet(path).withColumn("d", F.sha2("code", 256)), "d", "bucket").count() == 0
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        solutions.write(results, path)


def test_document_store(spark, documents, tmp_path):
    path = str(tmp_path / "documents")
    tilings.write_documents(documents, path)
    after = tilings.documents_after(spark, path, 20)
    assert [r["id"] for r in after.collect()] == list(range(21, 31))
    narrow = tilings.documents_after(spark, path, 20, with_documents=False)
    assert "document" not in narrow._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    a, b = tilings.identity(documents), tilings.identity(spark.read.parquet(path).repartition(7))
    assert a == b and a["entries"] == a["max_id"] == 30
    tilings.extract(documents.filter("id <= 4"), str(tmp_path / "files"))
    assert len(os.listdir(tmp_path / "files")) == 4
    with pytest.raises(Exception, match="File exists"):
        tilings.extract(documents.filter("id <= 4"), str(tmp_path / "files"))
    with pytest.raises(Exception, match="unsafe"):
        tilings.extract(documents.filter("id = 1").withColumn("filename", F.lit("../x")), str(tmp_path / "more"))
    twice = documents.filter("id <= 2").withColumn("filename", F.lit("same.tes"))
    tilings.extract(twice, str(tmp_path / "twice"))
    assert sorted(os.listdir(tmp_path / "twice")) == ["same [1].tes", "same [2].tes"]


def test_conversion_and_json(spark, documents, tmp_path):
    made = tilings.convert(documents, "f" * 64).persist()
    assert made.filter("error IS NOT NULL").count() == 0
    assert tilings.check(made.drop("error")).filter("error IS NOT NULL").count() == 0
    one = made.filter("id = 3").first()
    assert tilings.by_stable_id(made, one["stable_id"].hex()).count() == 1
    tilings.to_json(made).write.text(str(tmp_path / "json"))
    back = tilings.from_json(spark, str(tmp_path / "json"))
    assert back.filter("error IS NOT NULL").count() == 0
    key = lambda d: sorted((r["stable_id"].hex(), r["k"], r["seeds"]) for r in d.collect())
    assert key(back) == key(made)
    cell = {"T1": [0, 0, 1, 0], "T2": [1, 0, 0, 0], "Seed": [[0, 0, 0, 0]]}
    digest = hashlib.sha256(b"some record").hexdigest()
    old = {"eu_raw_5a_12": cell, "eu_5a3_6i2_40": cell, "eu_raw_zz_3": cell, f"k02_{digest}": {**cell, "Seed": [[0, 0, 0, 0], [0, 0, 1, 0]]}, "_failures": {"eu_raw_6i_9": "gave up"}}
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "a.json").write_text(json.dumps(old))
    read = {r["name"]: r for r in tilings.from_json(spark, str(tmp_path / "old"), legacy_domain=b"some store").collect()}
    assert (read["eu_raw_5a_12"]["k"], read["eu_5a3_6i2_40"]["k"]) == (1, 5)
    assert read["eu_raw_5a_12"]["stable_id"] != read["eu_5a3_6i2_40"]["stable_id"]
    assert {n for n, r in read.items() if r["error"]} == {"eu_raw_zz_3", f"k02_{digest}", "eu_raw_6i_9"}
    assert all(r["error"] for r in tilings.from_json(spark, str(tmp_path / "old")).collect())


def test_matching(spark):
    """Rectangular cells of different areas as references, and copies of them changed by known moves."""
    schema = "id string, k int, t1 array<bigint>, t2 array<bigint>, seeds array<array<bigint>>"
    cell = lambda w, h: geometry.Record((w, 0, 0, 0), (0, 0, 0, h), ((0, 0, 0, 0), (1, 0, 0, 1)))
    row = lambda name, k, r: (name, k, list(r.t1), list(r.t2), [list(x) for x in r.seeds])
    sheared = lambda r: geometry.Record(geometry.add(r.t1, geometry.scale(2, r.t2)), geometry.negate(r.t2), r.seeds)
    mine = [row("turned", 3, geometry.image(cell(5, 7), 4, True)), row("sheared", 4, sheared(cell(4, 9))), row("same area", 3, cell(1, 35)), row("other k", 5, cell(5, 7))]
    refs = [row("r1", 3, cell(5, 7)), row("r2", 4, cell(4, 9)), row("r3", 4, geometry.image(cell(4, 9), 1, False)), row("flat", 3, geometry.Record((1, 0, 0, 0), (3, 0, 0, 0), ((0, 0, 0, 0),)))]
    got = {r["id"]: (r["status"], r["refs"]) for r in tilings.matches(spark.createDataFrame(mine, schema), spark.createDataFrame(refs, schema)).collect()}
    assert got == {"turned": ("matched", ["r1"]), "sheared": ("ambiguous", ["r2", "r3"]), "same area": ("unmatched", None), "other k": ("unmatched", None)}


def test_stream_converts_once_and_retries(spark, documents, tmp_path):
    source, target, dead, point = (str(tmp_path / x) for x in ("in", "out", "dead", "checkpoint"))
    documents.filter("id <= 5").write.parquet(source)
    broken = documents.filter("id = 6").withColumn("document", F.lit("no document"))
    broken.write.mode("append").parquet(source)
    convert.start(spark, source, target, dead, point).awaitTermination()
    assert spark.read.parquet(target).count() == 5 and convert.watermark(spark, target) == 5
    assert [r["id"] for r in spark.read.parquet(dead).collect()] == [6]
    documents.filter("id > 6 AND id <= 9").write.mode("append").parquet(source)
    convert.start(spark, source, target, dead, point).awaitTermination()
    assert spark.read.parquet(target).select("id").distinct().count() == spark.read.parquet(target).count() == 8
    assert [r["id"] for r in convert.retry(spark, target, dead, 0).collect()] == [6]
    # two dead letters become good one after the other: no try loses what another wrote
    for number, good in ((1, 6), (2, 10)):
        mended = documents.filter(F.col("id") == good)
        letter = mended if good == 6 else mended.unionByName(documents.filter("id = 11").withColumn("document", F.lit("broken")))
        fresh = str(tmp_path / f"dead{number}")
        letter.write.parquet(fresh)
        left = convert.retry(spark, target, fresh, number)
        assert [r["id"] for r in left.collect()] == ([] if good == 6 else [11])
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == list(range(1, 11))
    with pytest.raises(Exception, match="(?i)already.exists"):
        convert.retry(spark, target, dead, 0)
    with pytest.raises(Exception, match="document 6"):
        convert.start(spark, source, str(tmp_path / "x"), str(tmp_path / "y"), str(tmp_path / "z"), fail_fast=True).awaitTermination()


def test_stable_ids_are_framed_by_source():
    assert codec.document_id("f" * 64, 3).hex() != codec.document_id("e" * 64, 3).hex() and len(frame((0,))) == 3


def test_a_rate_keeps_two_rows(spark):
    """Equal to a queue that drops its oldest rows but two."""
    from datetime import datetime, timedelta

    seconds = [0, 5, 5, 40, 4000, 4000, 4001, 90000, 90000.2]
    own = spark.createDataFrame([(1, k, datetime(2024, 1, 1) + timedelta(seconds=s)) for k, s in enumerate(seconds)], "g int, i int, t timestamp")
    got = {r.i: (r.in_frame, r.rate) for r in analytics.sliding_rate(own, "g", "t", "30 SECONDS", "i").collect()}
    held, want = [], {}
    for k, s in enumerate(seconds):
        held.append(s)
        while len(held) > 2 and s - held[0] > 30:
            held.pop(0)
        want[k] = (len(held), round((len(held) - 1) / (s - held[0]), 9) if s - held[0] > 0.5 else 0.0)
    assert got == want


def test_eta_classes(spark):
    rows = spark.createDataFrame([(0, 50.0, 0.0), (100, 10.0, 0.0), (7300, 20.0, -100.0), (7300, 20.0, -101.0), (5, 11.0, 5.0), (None, 50.0, 1.0)], "q long, r double, g double")
    got = [r[0] for r in rows.select(analytics.eta_class(F.col("q"), F.col("r"), F.col("g"), report.duration_text)).collect()]
    assert got == ["--", "..", ">6m5s", "1m0s", "><1s", None]


def test_ranges_and_floors_of_any_length(spark):
    """Against loops: long, nested, empty and touching ranges; points and starts that tie; nulls."""
    import random

    rnd = random.Random(11)
    points = [rnd.randrange(-50, 2000) for _ in range(300)] + [None, 5, 5]
    ranges = [(rnd.randrange(-60, 2000), rnd.choice([0, 1, 3, 40, 400])) for _ in range(25)] + [(None, 3), (3, None), (-10**12, 5)]
    p = spark.createDataFrame([(x,) for x in points], "x long").repartition(5)
    got = [r.x for r in reconcile.uncovered(p, "x", spark.createDataFrame(ranges, "first_entry long, entry_count long")).collect()]
    covered = lambda x: x is not None and any(a is not None and n is not None and a <= x < a + n for a, n in ranges)
    assert sorted(got, key=repr) == sorted((x for x in points if not covered(x)), key=repr) and len(got) < 280
    starts = [rnd.randrange(0, 1900) for _ in range(40)] + [None, 5]
    found = reconcile.floor_lookup(p, "x", spark.createDataFrame([(x,) for x in starts], "s long"), "s").collect()
    want = [(x, max((s for s in starts if s is not None and x is not None and s <= x), default=None)) for x in points]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    none = spark.createDataFrame([], "first_entry long, entry_count long")
    assert reconcile.uncovered(p, "x", none).count() == len(points)


def test_lattice_store(spark, results, tmp_path):
    """Import, lookups and export; failures are kept, mark the store and stop the export."""
    own = tilings.documents(results).withColumn("id", F.monotonically_increasing_id()).select("id", "combo", "signature", "document")
    made = tilings.convert(own, "f" * 64)
    tilings.to_json(made).write.text(str(tmp_path / "json"))
    target = str(tmp_path / "store")
    assert lattices.import_json(spark, str(tmp_path / "json"), target) == 30 and lattices.is_complete(spark, target)
    rows = lattices.records(spark, target).collect()
    assert [r.entry_id for r in rows] == list(range(1, 31))
    assert [(r.k, bytes(r.stable_id)) for r in rows] == sorted((r.k, bytes(r.stable_id)) for r in made.collect())
    assert lattices.read_by_id(spark, target, 7).collect() == [rows[6]] and lattices.read_by_id(spark, target, 31).count() == 0
    assert lattices.read_by_stable_id(spark, target, rows[3].stable_id.hex()).collect() == [rows[3]]
    assert lattices.read_by_stable_id(spark, target, rows[3].stable_id.hex(), 9).count() == 0
    assert [r.entry_id for r in lattices.records(spark, target, 5, 8).collect()] == [5, 6, 7, 8]
    found = lattices.lookup(spark.createDataFrame([(2,), (99,)], "entry_id long"), target).collect()
    assert {r.entry_id: r.k for r in found} == {2: rows[1].k, 99: None}
    lattices.export_json(spark, target, str(tmp_path / "again"))
    lines = lambda name: sorted(r.value for r in spark.read.text(str(tmp_path / name)).collect())
    assert lattices.import_json(spark, str(tmp_path / "again"), str(tmp_path / "second")) == 30
    lattices.export_json(spark, str(tmp_path / "second"), str(tmp_path / "third"))
    assert lines("again") == lines("third")
    with pytest.raises(Exception, match="(?i)exists"):
        lattices.import_json(spark, str(tmp_path / "json"), target)

    (tmp_path / "bad").mkdir()
    good, key = json.loads(lines("again")[0]), "k01_" + "0" * 64
    other = next(iter(good.values()))
    (tmp_path / "bad" / "x.json").write_text(json.dumps(good | {key: other | {"T2": other["T1"]}, "_failures": {"lost": "why"}}))
    with pytest.raises(lattices.IncompleteStore, match="2 records failed, 1 are stored"):
        lattices.import_json(spark, str(tmp_path / "bad"), str(tmp_path / "partial"))
    assert {r.name for r in lattices.failures(spark, str(tmp_path / "partial")).collect()} == {"lost", key}
    assert lattices.records(spark, str(tmp_path / "partial")).count() == 1 and not lattices.is_complete(spark, str(tmp_path / "partial"))
    with pytest.raises(lattices.IncompleteStore):
        lattices.export_json(spark, str(tmp_path / "partial"), str(tmp_path / "never"))
