"""Graph, geometry, chunking and lattice queries with their oracle SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyquilt.functions import hooks
from polyquilt.operators import chunking, crossings, graph, lattice, layout
from polyquilt.operators.tables import written


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def refine_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 + G4: classes of the part-supplier graph of ``lineitem``, weighted by lines, from the two kinds of nodes to the fixpoint.

    Parts are even numbers and suppliers odd ones while classes are sought; names, by which classes are ordered, come last.
    """
    lines = _t(spark, sf_dir, "lineitem").select((F.col("l_partkey").cast("long") * 2).alias("a"), (F.col("l_suppkey").cast("long") * 2 + 1).alias("b"))
    nodes = lines.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    found = graph.refine(nodes.select("node", F.pmod("node", F.lit(2)).alias("colour")), lines.groupBy("a", "b").agg(F.count("*").alias("w")))
    name = F.concat(F.when(F.pmod("node", F.lit(2)) == 0, "p").otherwise("s"), F.shiftright("node", 1))
    named = written(found.select(name.alias("node"), F.col("least").alias("_class"), "size"))
    first = named.groupBy("_class").agg(F.min("node").alias("least"))
    return graph.class_numbers(named.join(first, "_class").select("node", "least", "size"))


def _rounds(n: int) -> str:
    step = "c{1} AS MATERIALIZED (SELECT u AS node, md5(any_value(o.c) || ':' || string_agg(p.c || 'x' || w, ',' ORDER BY p.c, w)) AS c FROM b JOIN c{0} o ON o.node = u JOIN c{0} p ON p.node = v GROUP BY u)"
    return ", ".join(step.format(k, k + 1) for k in range(n))


COLOURS = f"""WITH e AS (SELECT 'p' || l_partkey AS u, 's' || l_suppkey AS v, count(*) AS w FROM lineitem GROUP BY ALL), b AS MATERIALIZED (FROM e UNION ALL SELECT v, u, w FROM e),
c0 AS (SELECT DISTINCT u AS node, substr(u, 1, 1) AS c FROM b), {_rounds(6)},
k AS (SELECT c, min(node) AS least, count(*) AS size FROM c6 GROUP BY c)
SELECT node, dense_rank() OVER (ORDER BY least) - 1 AS colour, size FROM c6 JOIN k USING (c)"""


def _local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and the suppliers of their own nation that they bought from."""
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("c_nationkey"))
    bought = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
    met = bought.join(c, "o_custkey").join(s, ["l_suppkey", "c_nationkey"])
    return met.select(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"), F.lit(1).cast("long").alias("w"))


_LOCAL = """e AS MATERIALIZED (SELECT DISTINCT 'c' || c_custkey AS a, 's' || s_suppkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey),
b AS MATERIALIZED (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e)"""


def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of each customer and supplier in the graph of sales within a nation."""
    nodes = _t(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node")).unionAll(_t(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey")))
    return graph.components(nodes, _local(spark, sf_dir))


COMPONENTS = f"""WITH RECURSIVE {_LOCAL}, n AS (SELECT 'c' || c_custkey AS node FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier),
r AS (SELECT node, node AS here FROM n UNION SELECT r.node, b.v FROM r JOIN b ON r.here = b.u) SELECT node, min(here) AS component FROM r GROUP BY node"""


def graph_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps from each nation's first supplier to the customers and suppliers of that graph that it reaches."""
    first = _t(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s"))  # one a nation
    return graph.distances(_local(spark, sf_dir), first.select(F.concat(F.lit("s"), "s").alias("source")))


DISTANCES = f"""WITH RECURSIVE {_LOCAL}, s AS (SELECT 's' || min(s_suppkey) AS source FROM supplier GROUP BY s_nationkey),
r AS (SELECT source, source AS node, 0::BIGINT AS distance FROM s UNION SELECT source, b.v, distance + 1 FROM r JOIN b ON r.node = b.u WHERE distance < 12)
SELECT source, node, min(distance) AS distance FROM r GROUP BY source, node"""


# --- crossings, chunks, lattices ---


def segment_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each user's path of (value, k) in the order of events crosses itself."""
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", F.round(F.col("value") * 100).cast("long").alias("x"), (F.get_json_object("props", "$.k").cast("long") * 100).alias("y"))
    w = Window.partitionBy("user_id").orderBy("event_id")
    path = e.select(F.col("user_id").alias("by"), F.col("event_id").alias("id"), F.lag("x").over(w).alias("x1"), F.lag("y").over(w).alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2")).filter("x1 IS NOT NULL")
    pairs = crossings.crossing_pairs(path, crossings.cell_size(path))
    return pairs.groupBy(F.col("by").alias("user_id")).agg(F.count("*").alias("crossings"), F.count_distinct("a").alias("segments"), F.min("a").alias("first_a"), F.max("b").alias("last_b"))


CROSSINGS = """WITH e AS (SELECT event_id, user_id, round(value * 100)::BIGINT AS x, (regexp_extract(props, '"k": *(-?[0-9]+)', 1))::BIGINT * 100 AS y FROM events),
s AS MATERIALIZED (SELECT user_id, event_id AS id, lag(x) OVER w AS x1, lag(y) OVER w AS y1, x AS x2, y AS y2 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id) QUALIFY x1 IS NOT NULL),
p AS (SELECT p.user_id, p.id AS a, q.id AS b,
  sign((p.x2 - p.x1) * (q.y1 - p.y1) - (p.y2 - p.y1) * (q.x1 - p.x1)) * sign((p.x2 - p.x1) * (q.y2 - p.y1) - (p.y2 - p.y1) * (q.x2 - p.x1)) AS f,
  sign((q.x2 - q.x1) * (p.y1 - q.y1) - (q.y2 - q.y1) * (p.x1 - q.x1)) * sign((q.x2 - q.x1) * (p.y2 - q.y1) - (q.y2 - q.y1) * (p.x2 - q.x1)) AS g
  FROM s p JOIN s q ON p.user_id = q.user_id AND p.id < q.id)
SELECT user_id, count(*) AS crossings, count(DISTINCT a) AS segments, min(a) AS first_a, max(b) AS last_b FROM p WHERE f < 0 AND g < 0 GROUP BY user_id"""

#: Bytes of a chunk, and of a row's framing.
CHUNK, FRAME = 64 << 10, 3


def byte_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of ``documents`` by language, in order of ids, of at most 64 KiB."""
    out = chunking.chunks(_t(spark, sf_dir, "documents"), F.col("lang"), F.col("doc_id"), F.octet_length("text"), F.lit(FRAME), CHUNK)
    return out.select(F.col("key").alias("lang"), "chunk", F.col("first").alias("first_doc"), "n_rows", "n_bytes")


BYTE_CHUNKS = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT lang, doc_id, coalesce(strlen(text), 0) AS size, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents),
r AS (SELECT lang, i, size + {FRAME} AS held, 0::BIGINT AS chunk FROM d WHERE i = 1 UNION ALL
SELECT d.lang, d.i, CASE WHEN held + size > {CHUNK} THEN 0 ELSE held END + size + {FRAME}, chunk + (held + size > {CHUNK})::BIGINT FROM r JOIN d ON d.lang IS NOT DISTINCT FROM r.lang AND d.i = r.i + 1)
SELECT r.lang, chunk, min(doc_id) AS first_doc, count(*) AS n_rows, sum(size + {FRAME})::BIGINT AS n_bytes FROM r JOIN d ON d.lang IS NOT DISTINCT FROM r.lang AND d.i = r.i GROUP BY r.lang, chunk"""


def _flat(made: DataFrame, by: str) -> DataFrame:
    """(by, rank, g, b, d): the basis (g, b), (0, d); missing rows as 0."""
    cell = lambda r, c: F.coalesce(F.get(F.get("basis", F.lit(r)), F.lit(c)).cast("long"), F.lit(0))
    first = F.when(cell(0, 0) == 0, 0)
    return made.select(by, "rank", cell(0, 0).alias("g"), F.coalesce(F.when(cell(0, 0) != 0, cell(1, 1)), cell(0, 1), first).cast("long").alias("d"))


def lattice_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18 + F53: rank, first pivot and last pivot of the lattice of each order's (part, supplier) vectors."""
    return _flat(lattice.basis(_t(spark, sf_dir, "lineitem"), "l_orderkey", ["l_partkey", "l_suppkey"]), "l_orderkey")


def _minors(rows: str, by: str) -> str:
    """By gcds: of the first entries, of all minors, and, where those are 0, of the second entries."""
    g = "list_reduce(list_prepend(0::BIGINT, list({0})), lambda a, b: gcd(a, b))"
    return f"""WITH v AS MATERIALIZED ({rows}),
    m AS (SELECT p.{by}, {g.format('abs(p.x * q.y - p.y * q.x)')} AS m FROM v p JOIN v q ON p.{by} = q.{by} AND (p.x, p.y) < (q.x, q.y) GROUP BY p.{by}),
    s AS (SELECT {by}, {g.format('abs(x)')} AS g, {g.format('abs(y)')} AS h FROM v GROUP BY {by})
    SELECT {by}, (CASE WHEN coalesce(m, 0) <> 0 THEN 2 WHEN g <> 0 OR h <> 0 THEN 1 ELSE 0 END)::INTEGER AS rank, g, (CASE WHEN g = 0 THEN h ELSE coalesce(m, 0) // g END)::BIGINT AS d FROM s LEFT JOIN m USING ({by})"""


LATTICE_ORDER = _minors("SELECT DISTINCT l_orderkey, l_partkey AS x, l_suppkey AS y FROM lineitem", "l_orderkey")


def lattice_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18 + F53: the lattice of the vectors (12 quantity + 8 line, 30 line) of all orders of a priority."""
    li = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    v = li.select("o_orderpriority", (F.col("l_quantity") * 12 + F.col("l_linenumber") * 8).cast("long").alias("x"), (F.col("l_linenumber") * 30).cast("long").alias("y"))
    return _flat(lattice.basis(v, "o_orderpriority", ["x", "y"]), "o_orderpriority")


LATTICE_PRIORITY = _minors("SELECT DISTINCT o_orderpriority, (l_quantity * 12 + l_linenumber * 8)::BIGINT AS x, l_linenumber::BIGINT * 30 AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey", "o_orderpriority")


#: Rounds of the layout.
ROUNDS = 6


def _trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations a < b with a distance that falls with the lines sold between them, and a circle of all nations."""
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("p"))
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("q"))
    sold = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.count("*").alias("n"))
    between = sold.join(c, "o_custkey").join(s, "l_suppkey").filter("p <> q").groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.sum("n").alias("n"))
    turn = F.col("n_nationkey") * F.lit(2 * math.pi / 25)
    return between.select("a", "b", (F.lit(400.0) / (F.col("n") + 100)).alias("d")), _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.cos(turn).alias("x"), F.sin(turn).alias("y"))


def stress_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations laid out by trade in a few rounds from a circle, and turned back onto it."""
    pairs, circle = _trade(spark, sf_dir)
    made = layout.align(layout.layout(pairs, circle, ROUNDS), circle)
    return made.select("node", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _layout_rounds(n: int) -> str:
    step = """p{1} AS MATERIALIZED (SELECT p.node, (p.x + coalesce(x, p.x)) / 2 AS x, (p.y + coalesce(y, p.y)) / 2 AS y FROM p{0} p LEFT JOIN (
  SELECT a.node, sum(w * (b.x + CASE WHEN now > 0 THEN d / now ELSE 0 END * (a.x - b.x))) / sum(w) AS x, sum(w * (b.y + CASE WHEN now > 0 THEN d / now ELSE 0 END * (a.y - b.y))) / sum(w) AS y
  FROM e JOIN p{0} a ON a.node = e.a JOIN p{0} b ON b.node = e.b, LATERAL (SELECT sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS now) GROUP BY a.node) m ON m.node = p.node)"""
    return ",\n".join(step.format(k, k + 1).replace("coalesce(x, p.x)", "coalesce(m.x, p.x)").replace("coalesce(y, p.y)", "coalesce(m.y, p.y)") for k in range(n))


LAYOUT = f"""WITH t AS (SELECT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b, 400.0::DOUBLE / (count(*) + 100) AS d
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b, d, 1 / (d * d) AS w FROM t UNION ALL SELECT b, a, d, 1 / (d * d) FROM t),
p0 AS MATERIALIZED (SELECT n_nationkey AS node, cos(n_nationkey * {2 * math.pi / 25!r}::DOUBLE) AS x, sin(n_nationkey * {2 * math.pi / 25!r}::DOUBLE) AS y FROM nation),
{_layout_rounds(ROUNDS)},
z AS (SELECT avg(p.x) AS mx, avg(p.y) AS my, avg(q.x) AS mu, avg(q.y) AS mv FROM p{ROUNDS} p JOIN p0 q USING (node)),
k AS (SELECT p.node, p.x - mx AS x, p.y - my AS y, q.x - mu AS u, q.y - mv AS v FROM p{ROUNDS} p JOIN p0 q USING (node), z),
s AS (SELECT sum(x * u + y * v) AS c1, sum(x * v - y * u) AS s1, sum(x * u - y * v) AS c2, sum(x * v + y * u) AS s2 FROM k),
r AS (SELECT *, c2 * c2 + s2 * s2 > c1 * c1 + s1 * s1 AS flip FROM s),
o AS (SELECT flip, CASE WHEN flip THEN c2 / sqrt(c2 * c2 + s2 * s2) ELSE c1 / sqrt(c1 * c1 + s1 * s1) END AS c, CASE WHEN flip THEN s2 / sqrt(c2 * c2 + s2 * s2) ELSE s1 / sqrt(c1 * c1 + s1 * s1) END AS s FROM r)
SELECT node, round(c * x - s * CASE WHEN flip THEN -y ELSE y END + mu, 6) AS x, round(s * x + c * CASE WHEN flip THEN -y ELSE y END + mv, 6) AS y FROM k, o, z"""


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.12: runs of a user's events with no pause over two hours, by a table function called from SQL."""
    hooks.register(spark, "gap_runs", hooks.GapRuns)
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("at"))
    out = spark.sql("SELECT * FROM gap_runs(TABLE({e}) PARTITION BY (key) ORDER BY (at), 7200000000)", e=e)
    return out.select(F.col("key").alias("user_id"), "run", "first", "last", "n")


RUNS = """WITH e AS (SELECT user_id, epoch_us(ts) AS u, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 7200000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT user_id, u, (sum(fresh) OVER (PARTITION BY user_id ORDER BY u) - 1)::BIGINT AS run FROM e)
SELECT user_id, run, min(u) AS first, max(u) AS last, count(*) AS n FROM r GROUP BY user_id, run"""


GRAPH: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "refine_colours": (refine_colours, COLOURS),
    "graph_components": (graph_components, COMPONENTS),
    "graph_distances": (graph_distances, DISTANCES),
    "segment_crossings": (segment_crossings, CROSSINGS),
    "byte_chunks": (byte_chunks, BYTE_CHUNKS),
    "lattice_by_order": (lattice_by_order, LATTICE_ORDER),
    "stress_layout": (stress_layout, LAYOUT),
    "event_runs": (event_runs, RUNS),
    "lattice_by_priority": (lattice_by_priority, LATTICE_PRIORITY),
}
