"""Queries of the engine and their oracle SQL.

Oracles are of three classes: R, the same question put to the other engine; G, published
counts, while the query really enumerates; N, none, where SQL cannot express the query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquilt.functions import catalog, codec, geometry
from polyquilt.functions.states import frame
from polyquilt.operators import analytics as A
from polyquilt.operators import canon, report, search
from polyquilt.operators import reconcile as R
from polyquilt.plans.graph_queries import GRAPH
from polyquilt.plans.report_queries import REPORT
from polyquilt.plans.state_queries import STATES
from polyquilt.plans.stream_queries import STREAMS
from polyquilt.sources import solutions, tilings

Query = Callable[[SparkSession, str], DataFrame]

#: Unique results for k = 1, 2, ...
UNIQUE_COUNTS = (10, 20, 61, 151, 332, 673)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(rows: list[tuple], columns: str) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + f") AS v({columns})"


SLOTS = _values(catalog.slot_rows(), "type_id, slot, label, left_n, right_n, mirror, polygon_size")
TYPES = _values(catalog.type_rows(), "type_id, symbol, code, attach_limit, slots")


# --- catalogue and enumeration ---


def enum_counts(k_max: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.counts(spark, k_max).select(F.col("k").cast("int").alias("k"), "n")

    return run


def enum_counts_sql(k_max: int) -> str:
    return "SELECT k::INTEGER AS k, n::BIGINT AS n FROM " + _values([(k + 1, n) for k, n in enumerate(UNIQUE_COUNTS[:k_max])], "k, n")


def enum_combo_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: unique results of each combo, k <= 3."""
    return search.unique(search.solutions(spark, 3)).groupBy("combo").agg(F.count("*").alias("n"))


def catalog_slot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = catalog.slot_table(spark)
    return s.groupBy("polygon_size").agg(F.count("*").alias("slots"), F.count_if(F.col("mirror") == F.col("slot")).alias("self_mirror"), F.count_if(F.col("label").startswith("*")).alias("starred"))


SLOT_STATS = f"SELECT polygon_size, count(*) AS slots, count(*) FILTER (mirror = slot) AS self_mirror, count(*) FILTER (label LIKE '*%') AS starred FROM {SLOTS} GROUP BY ALL"


def _sides(spark: SparkSession) -> DataFrame:
    s = catalog.slot_table(spark)
    right = s.select("type_id", F.col("slot").alias("right_n"), F.col("polygon_size").alias("right_size"))
    return s.join(F.broadcast(right), ["type_id", "right_n"]).select("type_id", "slot", F.col("polygon_size").alias("left_size"), "right_size", (F.col("mirror") == F.col("slot")).alias("self_mirror"))


_SIDES = f"(SELECT a.type_id, a.slot, a.polygon_size AS left_size, b.polygon_size AS right_size, a.mirror = a.slot AS self_mirror FROM (FROM {SLOTS}) a JOIN (FROM {SLOTS}) b ON a.type_id = b.type_id AND a.right_n = b.slot)"


def catalog_attach_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of new vertices by sizes."""
    own = _sides(spark).join(F.broadcast(catalog.type_table(spark).select("type_id", "attach_limit")), "type_id").filter("slot < attach_limit")
    return own.groupBy("left_size", "right_size", "self_mirror").agg(F.count("*").alias("n"), F.min("type_id").alias("first_type"))


ATTACH = f"SELECT left_size, right_size, self_mirror, count(*) AS n, min(s.type_id) AS first_type FROM {_SIDES} s JOIN (FROM {TYPES}) t ON s.type_id = t.type_id WHERE slot < attach_limit GROUP BY ALL"


def catalog_seam_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X6 + J2: gluable slots by type, as an equi-join on swapped sizes."""
    a = _sides(spark)
    b = a.select(F.col("type_id").alias("other"), F.col("right_size").alias("left_size"), F.col("left_size").alias("right_size"), "self_mirror")
    return a.join(F.broadcast(b), ["left_size", "right_size", "self_mirror"]).groupBy("type_id", "other").agg(F.count("*").alias("n"))


SEAMS = f"SELECT a.type_id, b.type_id AS other, count(*) AS n FROM {_SIDES} a JOIN {_SIDES} b ON a.left_size = b.right_size AND a.right_size = b.left_size AND a.self_mirror = b.self_mirror GROUP BY ALL"


def base_config_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F17 + A6: types of each base configuration."""
    t = catalog.type_table(spark)
    return t.select(F.regexp_extract("symbol", A.BASE, 0).alias("base"), "slots").groupBy("base").agg(F.count("*").alias("n"), F.sum("slots").cast("long").alias("slots"))


BASES = rf"SELECT regexp_extract(symbol, '\([0-9,]+\)') AS base, count(*) AS n, sum(slots)::BIGINT AS slots FROM {TYPES} GROUP BY base"


def vertex_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orbits of the right-hand walk around a type, by least-label propagation (12 slots at most)."""
    s = catalog.slot_table(spark).select("type_id", "slot", "right_n")
    low = s.select("type_id", "slot", "right_n", F.col("slot").alias("root"))
    for _ in range(4):  # labels travel twice as far in each round
        step = low.select("type_id", F.col("slot").alias("right_n"), F.col("right_n").alias("then"), F.col("root").alias("far"))
        low = low.join(F.broadcast(step), ["type_id", "right_n"]).select("type_id", "slot", F.col("then").alias("right_n"), F.least("root", "far").alias("root"))
    return low.groupBy("type_id", "root").agg(F.count("*").alias("size"))


CYCLES = f"""WITH RECURSIVE s AS (SELECT type_id, slot, right_n FROM {SLOTS}),
walk AS (SELECT type_id, slot, slot AS here FROM s UNION SELECT w.type_id, w.slot, s.right_n FROM walk w JOIN s ON w.type_id = s.type_id AND w.here = s.slot),
low AS (SELECT type_id, slot, min(here) AS root FROM walk GROUP BY ALL)
SELECT type_id, root, count(*) AS size FROM low GROUP BY ALL"""


# --- analytics: an order's lines stand for a result's vertices ---


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, id, member): suppliers of an order's lines, modulo 25 so that they repeat; k is the number of lines."""
    li = table(spark, sf_dir, "lineitem")
    k = li.groupBy("l_orderkey").agg(F.count("*").cast("int").alias("k"))
    return li.select("l_orderkey", (F.col("l_suppkey") % 5).alias("member")).join(k, "l_orderkey").select("k", F.col("l_orderkey").alias("id"), "member")


_MEMBERS = "m AS (SELECT (count(*) OVER (PARTITION BY l_orderkey))::INTEGER AS k, l_orderkey AS id, l_suppkey % 5 AS member FROM lineitem)"
_COUNTS = _MEMBERS + ", c AS (SELECT k, id, member, count(*) AS c FROM m GROUP BY ALL)"

M_DISTRIBUTION = f"WITH {_MEMBERS} SELECT k, m, count(*) AS n FROM (SELECT k, id, count(DISTINCT member) AS m FROM m GROUP BY ALL) GROUP BY k, m"
PROFILE = f"WITH {_COUNTS} SELECT k, profile, count(*) AS n FROM (SELECT k, id, string_agg(c::VARCHAR, '+' ORDER BY c DESC) AS profile FROM c GROUP BY k, id) GROUP BY k, profile"
FREQUENCY = f"WITH {_COUNTS} SELECT k, member, count(*) AS n FROM c GROUP BY k, member"
ENTROPY = f"WITH {_COUNTS} SELECT k, round(avg(e), 6) AS entropy FROM (SELECT k, id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM c GROUP BY k, id) GROUP BY k"
TOP = f"WITH {_COUNTS} SELECT k, top, count(*) AS n FROM (SELECT k, id, max(c) AS top FROM c GROUP BY k, id) GROUP BY k, top"
PREVALENCE = f"""WITH {_COUNTS}, f AS (SELECT k, member, count(*) AS n FROM c GROUP BY k, member), t AS (SELECT k, count(DISTINCT id) AS total FROM c GROUP BY k)
SELECT k, member, n, round(n / total, 6) AS share, (row_number() OVER (PARTITION BY k ORDER BY n DESC, member))::INTEGER AS place FROM f JOIN t USING (k) QUALIFY place <= 3"""
PIVOT = f"""WITH {_MEMBERS}, d AS (SELECT k, id, count(DISTINCT member) AS m FROM m GROUP BY ALL)
SELECT k, count(*) FILTER (m = 1) AS m1, count(*) FILTER (m = 2) AS m2, count(*) FILTER (m = 3) AS m3, count(*) FILTER (m = 4) AS m4, count(*) FILTER (m = 5) AS m5 FROM d GROUP BY k"""


ALL_PREVALENCE = f"""WITH {_COUNTS}, f AS (SELECT k, member, count(*) AS n FROM c GROUP BY k, member), t AS (SELECT k, count(DISTINCT id) AS total FROM c GROUP BY k)
SELECT k, member, n, round(n / total, 6) AS share FROM f JOIN t USING (k)"""
DISTRIBUTION = PIVOT.replace(" FROM d GROUP BY k", ", count(*) AS total FROM d GROUP BY k")
REUSE = f"""WITH {_COUNTS}, p AS (SELECT k, id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e, max(c) AS top FROM c GROUP BY k, id),
t AS (SELECT k, count(*) AS total, round(avg(e), 6) AS entropy FROM p GROUP BY k)
SELECT k, total, entropy, top, count(*) AS n FROM p JOIN t USING (k) GROUP BY ALL"""


def report_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each number of lines, and their ratio to those of the number before."""
    totals = _members(spark, sf_dir).groupBy("k").agg(F.count_distinct("id").alias("total"))
    return A.growth(totals, "k", "total")


REPORT_GROWTH = f"WITH {_MEMBERS}, t AS (SELECT k, count(DISTINCT id) AS total FROM m GROUP BY k) SELECT k, total, round(total / lag(total) OVER (ORDER BY k), 6) AS ratio FROM t"


def growth_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    return A.growth(years, "y", "n")


GROWTH = "SELECT y, n, round(n / lag(n) OVER (ORDER BY y), 6) AS ratio FROM (SELECT year(o_orderdate)::INTEGER AS y, count(*) AS n FROM orders GROUP BY ALL)"


def median_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.median("l_quantity").alias("med_quantity"), F.median("l_extendedprice").alias("med_price"))


MEDIAN = "SELECT l_returnflag, l_linestatus, median(l_quantity) AS med_quantity, median(l_extendedprice) AS med_price FROM lineitem GROUP BY ALL"


def global_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: global counts, clamps and sums with defaults."""
    o = table(spark, sf_dir, "orders")
    return o.agg(F.count("*").alias("n"), F.coalesce(F.max("o_orderkey"), F.lit(0)).alias("top"), F.greatest(F.lit(1000), F.coalesce(F.min("o_custkey"), F.lit(0))).alias("floor_cust"), F.least(F.lit(10), F.coalesce(F.max("o_custkey"), F.lit(0))).alias("cap_cust"))


BOUNDS = "SELECT count(*) AS n, coalesce(max(o_orderkey), 0) AS top, greatest(1000, coalesce(min(o_custkey), 0)) AS floor_cust, least(10, coalesce(max(o_custkey), 0)) AS cap_cust FROM orders"


def count_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of distinct members, with falling multiplicities in brackets if any exceeds one."""
    c = A.multiplicities(_members(spark, sf_dir)).groupBy("k", "id").agg(F.sort_array(F.collect_list("c"), False).alias("c"))
    digits = F.array_join(F.transform("c", lambda x: F.when(x == 10, "a").when(x == 11, "b").otherwise(x.cast("string"))), "")
    own = c.select("k", F.concat(F.size("c").cast("string"), F.when(F.get("c", F.lit(0)) > 1, F.concat(F.lit(" ("), digits, F.lit(")"))).otherwise("")).alias("signature"))
    return own.groupBy("k", "signature").agg(F.count("*").alias("n"))


COUNT_SIGNATURE = f"""WITH {_COUNTS} SELECT k, signature, count(*) AS n FROM (SELECT k, id, count(*) || CASE WHEN max(c) > 1 THEN ' (' || string_agg(CASE c WHEN 10 THEN 'a' WHEN 11 THEN 'b' ELSE c::VARCHAR END, '' ORDER BY c DESC) || ')' ELSE '' END AS signature FROM c GROUP BY k, id) GROUP BY k, signature"""


# --- dedup and hashing ---


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return R.first_of_each(d, F.sha2("text", 256), "doc_id")


DEDUP = "SELECT sha256(text) AS form, min(doc_id) AS kept, count(*) AS copies FROM documents GROUP BY sha256(text)"


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.repeated_keys(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("form")), "form")


def hash_bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", R.bucket_of(F.sha2("text", 256)).alias("bucket"))
    return d.groupBy("source", "bucket").agg(F.count("*").alias("n"))


BUCKETS = "SELECT source, (('0x' || substr(sha256(text), 1, 2))::INTEGER >> 2) AS bucket, count(*) AS n FROM documents GROUP BY ALL"


# --- joins, set operations, changes ---

WIDTH = 512


def _chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return e, R.chunks_of(e, "event_id", WIDTH)


_CHUNKS = f"ch AS (SELECT (event_id // {WIDTH})::BIGINT AS chunk_id, min(event_id) AS first_entry, count(*) AS entry_count FROM events GROUP BY ALL)"


def chunk_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, chunks = _chunks(spark, sf_dir)
    return R.lookup(e, "event_id", chunks, WIDTH).groupBy("chunk_id", "event_type").agg(F.count("*").alias("n"), F.max("ordinal").alias("last_ordinal"))


CHUNK_JOIN = f"WITH {_CHUNKS} SELECT chunk_id, event_type, count(*) AS n, max(event_id - first_entry) AS last_ordinal FROM events JOIN ch ON event_id // {WIDTH} = chunk_id GROUP BY ALL"


def chunk_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks against entries of which every seventh user's are missing."""
    e, chunks = _chunks(spark, sf_dir)
    left = e.filter(F.col("user_id") % 7 != 0).select(F.floor(F.col("event_id") / WIDTH).cast("long").alias("chunk_id"))
    return R.mismatches(chunks, left)


RECONCILE = f"WITH {_CHUNKS} SELECT chunk_id, entry_count, count(event_id) AS found FROM ch LEFT JOIN (SELECT * FROM events WHERE user_id % 7 <> 0) e ON event_id // {WIDTH} = chunk_id GROUP BY ALL HAVING count(event_id) <> entry_count"


def _ranges(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.col("chunk_id") % 3 != 1).select((F.col("first_entry") + 5).alias("first_entry"), F.col("entry_count"))


def range_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that no stored range covers."""
    e, chunks = _chunks(spark, sf_dir)
    return R.uncovered(e.select("event_id"), "event_id", _ranges(chunks))


RANGE_ANTI = f"WITH {_CHUNKS}, r AS (SELECT first_entry + 5 AS first_entry, entry_count FROM ch WHERE chunk_id % 3 <> 1) SELECT event_id FROM events WHERE NOT EXISTS (SELECT 1 FROM r WHERE event_id >= first_entry AND event_id < first_entry + entry_count)"


def range_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges that reach past a point."""
    _, chunks = _chunks(spark, sf_dir)
    return chunks.filter(F.col("first_entry") + F.col("entry_count") > 4321)


RANGE_OVERLAP = f"WITH {_CHUNKS} SELECT * FROM ch WHERE first_entry + entry_count > 4321"


def floor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order key the greatest customer key at or below it."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    c = table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 9 == 2).select("c_custkey")
    return R.floor_lookup(o, "o_orderkey", c, "c_custkey")


FLOOR = "SELECT o_orderkey, c_custkey AS floor FROM orders ASOF LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 9 = 2) c ON o_orderkey >= c_custkey"


def _keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("key"))
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_quantity") > 45).select(F.col("l_orderkey").alias("key"))
    return o, li


_KEYS = "o AS (SELECT o_orderkey AS key FROM orders WHERE o_orderstatus = 'F'), li AS (SELECT l_orderkey AS key FROM lineitem WHERE l_quantity > 45)"


def both_sides_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.two_sided(*_keys(spark, sf_dir))


TWO_SIDED = f"WITH {_KEYS} SELECT key, 'left' AS side FROM (FROM o EXCEPT FROM li) UNION ALL SELECT key, 'right' AS side FROM (FROM li EXCEPT FROM o)"


def chained_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = _keys(spark, sf_dir)
    urgent = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").alias("key"))
    return o.subtract(li).subtract(urgent)


CHAINED = f"WITH {_KEYS} FROM o EXCEPT FROM li EXCEPT SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%'"


def union_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = _keys(spark, sf_dir)
    return o.unionAll(li).groupBy("key").agg(F.count("*").alias("n"))


UNION = f"WITH {_KEYS} SELECT key, count(*) AS n FROM (FROM o UNION ALL FROM li) GROUP BY key"


def semi_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.overlap(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), table(spark, sf_dir, "labels"), "doc_id")


SEMI = "SELECT doc_id, lang, source FROM documents WHERE EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)"


def match_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = lambda c: F.floor(F.col(c) / 500).cast("long").alias("band")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), band("c_acctbal"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), band("s_acctbal"))
    return A.match_cardinality(c, s, ["nation", "band"], "c_custkey")


CARDINALITY = """SELECT c_custkey, coalesce(matches, 0) AS matches, CASE WHEN matches IS NULL THEN 'unmatched' WHEN matches = 1 THEN 'matched' ELSE 'ambiguous' END AS status
FROM customer LEFT JOIN (SELECT s_nationkey, floor(s_acctbal / 500) AS band, count(*) AS matches FROM supplier GROUP BY ALL) s ON s_nationkey = c_nationkey AND band = floor(c_acctbal / 500)"""


def upsert_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changes = o.filter(F.col("o_orderkey") % 5 == 0).select(F.when(F.col("o_orderkey") % 10 == 0, F.col("o_orderkey")).otherwise(-F.col("o_orderkey")).alias("o_orderkey"), F.lit("X").alias("o_orderstatus"), F.lit(0.0).alias("o_totalprice"))
    return R.upsert(o, changes, "o_orderkey")


UPSERT = """WITH n AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey ELSE -o_orderkey END AS o_orderkey, 'X' AS o_orderstatus, 0.0::DOUBLE AS o_totalprice FROM orders WHERE o_orderkey % 5 = 0)
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ANTI JOIN n USING (o_orderkey) UNION ALL FROM n"""


# --- ordered analytics over events ---


def sliding_rate_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return A.sliding_rate(e, "user_id", "ts", "1 DAY", "event_id").select("event_id", "in_frame", "rate")


SLIDING = """WITH o AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT p.user_id, p.i, min(q.i) AS low FROM o p JOIN o q ON p.user_id = q.user_id AND q.i <= p.i AND q.ts >= p.ts - INTERVAL 1 DAY GROUP BY ALL),
g AS (SELECT user_id, i, greatest(least(low, i - 1), 1) AS low FROM f)
SELECT p.event_id, p.i - g.low + 1 AS in_frame, CASE WHEN date_diff('microsecond', q.ts, p.ts) <= 500000 THEN 0.0 ELSE round((p.i - g.low) * 1e6 / date_diff('microsecond', q.ts, p.ts), 9) END AS rate
FROM o p JOIN g ON p.user_id = g.user_id AND p.i = g.i JOIN o q ON q.user_id = g.user_id AND q.i = g.low"""


def ewma_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("v"))
    return e.select("user_id", F.round(A.ewma(F.transform("v", lambda x: x["value"])), 6).alias("ewma"))


EWMA = "SELECT user_id, round(list_reduce(list_prepend(0.0::DOUBLE, list(value ORDER BY event_id)), lambda a, x: CASE WHEN a = 0 THEN x ELSE 0.3::DOUBLE * x + 0.7::DOUBLE * a END), 6) AS ewma FROM events GROUP BY user_id"


def eta_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as queues, with lengths, rates and growths from their events."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("s"))
    queue = F.when(F.col("s") % 7 == 0, 0).otherwise(F.col("s") * F.col("n"))
    rate, growth = (F.col("n") % 8 * 6).cast("double"), ((F.col("s") % 9 - 6) * 50).cast("double")
    return e.select("user_id", A.eta_class(queue, rate, growth, report.duration_text).alias("eta"))


ETA = """WITH u AS (SELECT user_id, count(*) AS n, sum((regexp_extract(props, '"k": *(-?[0-9]+)', 1))::BIGINT)::BIGINT AS s FROM events GROUP BY user_id),
q AS (SELECT user_id, CASE WHEN s % 7 = 0 THEN 0 ELSE s * n END AS q, (n % 8 * 6)::DOUBLE AS r, ((s % 9 - 6) * 50)::DOUBLE AS g FROM u),
t AS (SELECT *, CASE WHEN q = 0 OR r <= 10 THEN 0 WHEN g < -100 THEN q / (r - g) ELSE q / r END AS x, floor(x)::BIGINT AS f FROM q)
SELECT user_id, CASE WHEN q = 0 THEN '--' WHEN r <= 10 THEN '..' ELSE CASE WHEN g < -100 THEN '' ELSE '>' END ||
CASE WHEN x < 1 THEN '<1s' WHEN f < 60 THEN f || 's' WHEN f < 3600 THEN f // 60 || 'm' || f % 60 || 's' ELSE f // 3600 || 'h' || f % 3600 // 60 || 'm' END END AS eta FROM t"""


def delta_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.deltas(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "event_id")


DELTA = "SELECT event_id, user_id, event_id - coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS delta FROM events"


def ascending_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.not_ascending(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "user_id", "event_id", "value")


ASCENDING = "SELECT event_id, user_id, value, before FROM (SELECT event_id, user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE value <= before"


def running_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.running_index(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_type", "event_id").select("event_id", "index")


RUNNING = "SELECT event_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id))::INTEGER AS index FROM events"


def range_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct numbers of a range list, in order."""
    parts = spark.createDataFrame([("1-3,5,3,17-20",)], "spec string").select(F.explode(F.split("spec", ",")).alias("p")).select(F.split("p", "-").alias("p"))
    span = parts.select(F.explode(F.sequence(F.get("p", F.lit(0)).cast("int"), F.element_at("p", -1).cast("int"))).alias("n")).distinct()
    return span.select("n", F.assert_true((F.col("n") >= 1) & (F.col("n") <= 20)).alias("checked")).drop("checked").orderBy("n")


RANGE_SPEC = "SELECT DISTINCT unnest(range(a, b + 1))::INTEGER AS n FROM (VALUES (1, 3), (5, 5), (3, 3), (17, 20)) v(a, b)"


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return e.groupBy("event_type").agg(F.count("p.k").alias("n"), F.sum("p.k").alias("total"), F.max("p.k").alias("top"))


JSON = "SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, max(k) AS top FROM (SELECT event_type, (regexp_extract(props, '\"k\": *(-?[0-9]+)', 1))::BIGINT AS k FROM events) GROUP BY event_type"


def multi_key_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: types of orders by number of lines, then by falling frequency."""
    own = A.distinct_members(_members(spark, sf_dir))
    return own.orderBy("k", F.desc("n"), "m")


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1 + O2: the ten dearest orders, ties by key."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


TOP_ORDERS = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"


# --- results, documents and lattices (class N: our own tests stand in for an oracle) ---


def _lattices(spark: SparkSession, k_max: int) -> tuple[DataFrame, DataFrame]:
    """Documents of all results up to ``k_max``, and their converted records; ids follow from the canonical code."""
    found = search.unique(search.solutions(spark, k_max))
    made = tilings.documents(found).withColumn("id", F.abs(F.xxhash64("document")) + 1)
    own = made.select("id", "k", "combo", "signature", "document")
    return own, tilings.convert(own, "0" * 64)


def result_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertex lines, signatures and Conway texts of all results, k <= 3."""
    return solutions.with_texts(search.unique(search.solutions(spark, 3))).drop("types", "glue", "code")


def tiling_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lattices(spark, 3)[0]


def lattice_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact lattices of all results, k <= 3, with the reason where there is none."""
    return _lattices(spark, 3)[1].drop("stable_id")


def geometry_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F57 over developed records: how many pass, by k."""
    checked = tilings.check(_lattices(spark, 2)[1].drop("error"))
    return checked.groupBy("k").agg(F.count("*").alias("n"), F.count_if(F.col("error").isNull()).alias("valid"))


GEOMETRY_VALIDATE = "SELECT k::INTEGER AS k, n::BIGINT AS n, n::BIGINT AS valid FROM (VALUES (1, 10), (2, 20)) v(k, n)"


def catalog_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 + A17: every record against turned, reflected copies of all: each must match itself alone."""
    own = _lattices(spark, 2)[1].select(F.col("id").cast("string").alias("id"), "k", "t1", "t2", "seeds")

    @F.udf("struct<t1: array<bigint>, t2: array<bigint>, seeds: array<array<bigint>>>")
    def turned(t1, t2, seeds):  # noqa: ANN001, ANN202
        r = geometry.image(geometry.Record(tuple(t1), tuple(t2), tuple(map(tuple, seeds))), 1, True)
        return list(r.t2), list(r.t1), [list(s) for s in r.seeds]

    other = own.select("id", "k", turned("t1", "t2", "seeds").alias("r")).select("id", "k", "r.*")
    return tilings.matches(own, other).groupBy("status").agg(F.count("*").alias("n"))


CATALOG_MATCH = "SELECT 'matched' AS status, 30::BIGINT AS n"


def wl_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique results by WL hash and isomorphism."""
    return solutions.wl_unique(search.solutions(spark, 3).filter("minimal")).groupBy("k").agg(F.count("*").alias("n"))


def word_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique results by breadth-first word."""
    return solutions.word_unique(search.solutions(spark, 3).filter("minimal")).groupBy("k").agg(F.count("*").alias("n"))


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G7 of every type's initial state."""
    rows = [(t.symbol, canon.stable_id(frame((t.type_id,)), [-1] * t.slots).hex()) for t in catalog.vertex_types()]
    return spark.createDataFrame(rows, "symbol string, stable_id string").filter("symbol = '(3,12,12)A'")


STABLE_IDS = "SELECT '(3,12,12)A' AS symbol, '8f9e3b66cd530bb42e0fd8c91f3d4d70942b11e52933f27bfb49408e956a94de' AS stable_id"


def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records through the byte codec: how many come back as they were."""

    @F.udf("boolean")
    def same(t1, t2, seeds):  # noqa: ANN001, ANN202
        r = geometry.Record(tuple(t1), tuple(t2), tuple(map(tuple, seeds)))
        return codec.decode_record(codec.encode_record(r)) == r

    return _lattices(spark, 2)[1].groupBy("k").agg(F.count("*").alias("n"), F.count_if(same("t1", "t2", "seeds")).alias("same"))


CODEC_ROUNDTRIP = "SELECT k::INTEGER AS k, n::BIGINT AS n, n::BIGINT AS same FROM (VALUES (1, 10), (2, 20)) v(k, n)"


def on_members(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(_members(spark, sf_dir))


ALL: dict[str, tuple[Query, str | None]] = {
    **{f"enum_counts_k{k}": (enum_counts(k), enum_counts_sql(k)) for k in (1, 2, 3, 4, 5)},
    "enum_combo_counts": (enum_combo_counts, None),
    "wl_dedup": (wl_dedup, enum_counts_sql(3)),
    "word_dedup": (word_dedup, enum_counts_sql(3)),
    "result_texts": (result_texts, None),
    "tiling_documents": (tiling_documents, None),
    "lattice_records": (lattice_records, None),
    "geometry_validate": (geometry_validate, GEOMETRY_VALIDATE),
    "catalog_match": (catalog_match, CATALOG_MATCH),
    "codec_roundtrip": (codec_roundtrip, CODEC_ROUNDTRIP),
    "stable_ids": (stable_ids, STABLE_IDS),
    "catalog_slot_stats": (catalog_slot_stats, SLOT_STATS),
    "catalog_attach_buckets": (catalog_attach_buckets, ATTACH),
    "catalog_seam_pairs": (catalog_seam_pairs, SEAMS),
    "base_config_counts": (base_config_counts, BASES),
    "vertex_cycles": (vertex_cycles, CYCLES),
    "m_distribution": (on_members(A.distinct_members), M_DISTRIBUTION),
    "multiplicity_profile": (on_members(A.profiles), PROFILE),
    "member_frequency": (on_members(lambda m: A.frequency(m, "k")), FREQUENCY),
    "mean_entropy": (on_members(A.mean_entropy), ENTROPY),
    "max_multiplicity": (on_members(A.max_multiplicity), TOP),
    "prevalence_topk": (on_members(lambda m: A.prevalence(m, 3)), PREVALENCE),
    "distribution_pivot": (on_members(lambda m: A.histogram_pivot(m, [1, 2, 3, 4, 5])), PIVOT),
    "report_prevalence": (on_members(lambda m: A.prevalence(m).drop("place")), ALL_PREVALENCE),
    "report_distribution": (on_members(report.distribution), DISTRIBUTION),
    "report_reuse": (on_members(report.reuse), REUSE),
    "report_growth": (report_growth, REPORT_GROWTH),
    "count_signature": (count_signature, COUNT_SIGNATURE),
    "multi_key_sort": (multi_key_sort, M_DISTRIBUTION),
    "growth_ratio": (growth_ratio, GROWTH),
    "median_by_group": (median_by_group, MEDIAN),
    "global_bounds": (global_bounds, BOUNDS),
    "exact_dedup": (exact_dedup, DEDUP),
    "duplicate_groups": (duplicate_groups, "SELECT sha256(text) AS form, count(*) AS n FROM documents GROUP BY form HAVING count(*) > 1"),
    "hash_bucket_counts": (hash_bucket_counts, BUCKETS),
    "chunk_join": (chunk_join, CHUNK_JOIN),
    "chunk_reconcile": (chunk_reconcile, RECONCILE),
    "range_anti_join": (range_anti_join, RANGE_ANTI),
    "range_overlap": (range_overlap, RANGE_OVERLAP),
    "floor_lookup": (floor_lookup, FLOOR),
    "both_sides_diff": (both_sides_diff, TWO_SIDED),
    "chained_except": (chained_except, CHAINED),
    "union_ids": (union_ids, UNION),
    "semi_overlap": (semi_overlap, SEMI),
    "match_cardinality": (match_cardinality, CARDINALITY),
    "upsert_rewrite": (upsert_rewrite, UPSERT),
    "sliding_rate_1d": (sliding_rate_1d, SLIDING),
    "ewma_rate": (ewma_rate, EWMA),
    "eta_classes": (eta_classes, ETA),
    "delta_encode": (delta_encode, DELTA),
    "ascending_check": (ascending_check, ASCENDING),
    "running_index": (running_index, RUNNING),
    "range_spec": (range_spec, RANGE_SPEC),
    "json_props": (json_props, JSON),
    "top_orders": (top_orders, TOP_ORDERS),
    **REPORT,
    **GRAPH,
    **STREAMS,
    **STATES,
}
