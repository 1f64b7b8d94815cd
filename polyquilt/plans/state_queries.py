"""States, their texts and hashes, and exact geometry, over rows of the given tables, with oracle SQL.

An order is a state: each line is a vertex whose type follows from its supplier, in order of
line numbers.  Vertices of one type are glued two by two, dart to dart; of the others a
third is free, a third is glued to its own mirror images and a third to itself.  All of
``lineitem`` is read, and the work grows with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from polyquilt.functions import catalog, codec, geometry, states, text
from polyquilt.functions.states import frame
from polyquilt.operators import canon, darts, search

#: Types that vertices have: a dozen, so that equal ones meet in an order.
SPREAD = 12


def _over(rows: DataFrame, schema: str, one: Callable[..., tuple]) -> DataFrame:
    """``one`` over each row of ``rows``; its result has the columns of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [one(*row) for row in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(fields)], schema=fields)

    return rows.mapInArrow(run, schema)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o, vertices): of each order three times the type, plus the rule, of each vertex, in order of lines; an order has a few."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("s"))
    v = li.groupBy("o").agg(F.sort_array(F.collect_set(F.struct("line", F.col("s").isNull().alias("none"), "s"))).alias("v"))
    # a line's least supplier stands first
    first = F.expr("filter(v, (x, i) -> i = 0 OR NOT v[i - 1].line <=> x.line)")
    return v.select("o", F.transform(first, lambda x: ((x["s"] % SPREAD * 3 + 7) * 3 + (x["s"] + x["line"]) % 3).cast("int")).alias("vertices"))


def state(vertices: list[int]) -> tuple[list[int], list[int]]:
    """Types and glue of the state that ``vertices`` of ``_orders`` describe."""
    types = [v // 3 for v in vertices]
    f = frame(tuple(types))
    other: dict[int, int] = {}
    for t in set(types):
        same = [tile for tile, own in enumerate(types) if own == t]
        for x, y in zip(same[::2], same[1::2]):
            other[x], other[y] = y, x
    glue = []
    for tile, v in enumerate(vertices):
        low = f.offsets[tile]
        slots = range(low, low + catalog.vertex_types()[types[tile]].slots)
        if tile in other:
            glue += range(f.offsets[other[tile]], f.offsets[other[tile]] + len(slots))
        else:
            glue += ([-1] * len(slots), [f.mirror[i] for i in slots], slots)[v % 3]
    return types, glue


def _over_states(spark: SparkSession, sf_dir: str, schema: str, one: Callable[[list[int], list[int]], tuple]) -> DataFrame:
    """(l_orderkey, ...): ``one`` over the types and glue of each order's state.

    Orders of one state are brought together, and ``one`` is called once for those of a batch.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(f"l_orderkey bigint, {schema}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = batch.column(1).dictionary_encode()
            out = [one(*state([int(v) for v in text.split()])) for text in met.dictionary.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in out], f.type).take(met.indices) for k, f in enumerate(list(fields)[1:]))], schema=fields)

    own = _orders(spark, sf_dir).select("o", F.array_join(F.col("vertices").cast("array<string>"), " ", "null").alias("vertices"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return own.repartition(parts, "vertices").sortWithinPartitions("vertices").mapInArrow(run, f"l_orderkey bigint, {schema}")


def _rows(rows: list[tuple], columns: str) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + f") AS v({columns})"


_DARTS = f"""li AS (SELECT l_orderkey AS o, l_linenumber AS line, min(l_suppkey) AS s FROM lineitem GROUP BY ALL),
v0 AS (SELECT o, row_number() OVER (PARTITION BY o ORDER BY line) - 1 AS tile, s % {SPREAD} * 3 + 7 AS type, (s + line) % 3 AS rule FROM li),
v1 AS (SELECT *, row_number() OVER (PARTITION BY o, type ORDER BY tile) - 1 AS place FROM v0),
v AS MATERIALIZED (SELECT *, CASE WHEN place % 2 = 0 THEN lead(tile) OVER w ELSE lag(tile) OVER w END AS other FROM v1 WINDOW w AS (PARTITION BY o, type ORDER BY tile)),
t AS (FROM {_rows(catalog.type_rows(), "type_id, symbol, code, attach_limit, slots")}), sl AS (FROM {_rows(catalog.slot_rows(), "type_id, slot, label, left_n, right_n, mirror, polygon_size")}),
pl AS (SELECT v.*, symbol, code, slots, coalesce(sum(slots) OVER (PARTITION BY o ORDER BY tile ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS low FROM v JOIN t ON type = type_id),
d AS MATERIALIZED (SELECT a.o, a.tile, a.type, a.low + slot AS i, a.low + right_n AS r, a.low + mirror AS m, polygon_size AS size, sl.label,
  CASE WHEN b.o IS NOT NULL THEN b.low + slot WHEN a.rule = 0 THEN -1 WHEN a.rule = 1 THEN a.low + mirror ELSE a.low + slot END AS g
  FROM pl a JOIN sl ON a.type = sl.type_id LEFT JOIN pl b ON b.o = a.o AND b.tile = a.other)"""


# --- texts ---


def state_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combo, signatures, vertex line, Conway text and packed form of each order's state."""

    def one(types: list[int], glue: list[int]) -> tuple:
        if (why := states.problem(types, glue)) or states.unpack(data := states.pack(types, glue)) != (types, glue):
            raise ValueError(why or "a packed state is another")
        t = tuple(types)
        return text.combo(t), text.signature(t), text.file_signature(t), text.vertex_line(t), text.count_signature(t), text.conway(frame(t), glue), data.hex()

    return _over_states(spark, sf_dir, "combo string, signature string, file_signature string, vertices string, count_signature string, conway string, packed string", one)


_LE2 = "printf('%02x%02x', ({0}) % 256, ({0}) // 256 % 256)"
STATE_TEXTS = f"""WITH {_DARTS},
c AS (SELECT o, type, symbol, code, count(*) AS n FROM pl GROUP BY ALL),
b AS (SELECT o, regexp_extract(symbol, '^[^)]*[)]') AS base, count(*) AS n FROM pl GROUP BY ALL),
x AS (SELECT o, count(*) || CASE WHEN max(n) > 1 THEN ' (' || string_agg(CASE n WHEN 10 THEN 'a' WHEN 11 THEN 'b' ELSE n::VARCHAR END, '' ORDER BY n DESC) || ')' ELSE '' END AS count_signature FROM b GROUP BY o),
s AS (SELECT o, string_agg(symbol || CASE WHEN n > 1 THEN 'x' || n ELSE '' END, ', ' ORDER BY type) AS signature, string_agg(code || CASE WHEN n > 1 THEN n::VARCHAR ELSE '' END, ' ' ORDER BY type) AS file_signature FROM c GROUP BY o),
k AS (SELECT o, count(*) AS k, string_agg(symbol, ', ' ORDER BY tile) AS vertices, string_agg(printf('%02x', type), '' ORDER BY tile) AS packed_types FROM pl GROUP BY o),
z AS (SELECT o, string_agg(CASE size WHEN 12 THEN 'c' ELSE size::VARCHAR END, '' ORDER BY size) AS sizes FROM (SELECT DISTINCT o, size FROM d) GROUP BY o),
l AS (SELECT *, label || CASE WHEN tile <= 3 THEN repeat('''', tile::BIGINT) ELSE '@' || tile END AS name FROM d),
q AS (SELECT a.o, a.i, ltrim(a.name, '*') AS x, ltrim(b.name, '*') AS y, starts_with(a.name, '*') = starts_with(b.name, '*') AS round FROM l a JOIN l b ON b.o = a.o AND b.i = a.g JOIN d e ON e.o = a.o AND e.i = a.m
  WHERE a.i <= least(a.g, a.m, e.g)),
w AS (SELECT o, string_agg(CASE WHEN round THEN '(' ELSE '[' END || x || CASE WHEN x = y THEN '' ELSE ' ' || y END || CASE WHEN round THEN ')' ELSE ']' END, '' ORDER BY i) AS conway FROM q GROUP BY o),
p AS (SELECT o, count(*) AS n, string_agg({_LE2.format("CASE WHEN g < 0 THEN 65535 ELSE g END")}, '' ORDER BY i) AS packed_glue FROM d GROUP BY o)
SELECT k.o AS l_orderkey, printf('%02d', k.k) || '_' || sizes AS combo, signature, file_signature, vertices, count_signature, coalesce(conway, '') AS conway,
  '0002' || {_LE2.format("k.k")} || {_LE2.format("p.n")} || packed_types || packed_glue AS packed
FROM k JOIN s USING (o) JOIN x USING (o) JOIN z USING (o) JOIN p USING (o) LEFT JOIN w USING (o)"""


# --- rings, seams, offers ---


def state_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the rings of each order's state are valid, and, if so, how many are open, the tightest slack and the dart to settle next."""

    def one(types: list[int], glue: list[int]) -> tuple:
        f = frame(tuple(types))
        rings = search.open_rings(f, glue)
        if rings is None:
            return False, None, None, None
        return True, len(rings), min((slack for *_, slack in rings), default=None), search.branch(f, glue)

    return _over_states(spark, sf_dir, "valid boolean, n_open int, slack int, dart int", one)


STATE_RINGS = f"""WITH RECURSIVE {_DARTS},
e AS MATERIALIZED (SELECT a.o, a.i, a.r, a.g, a.m, a.label, b.size AS rsize, b.g AS next FROM d a JOIN d b ON b.o = a.o AND b.i = a.r),
w AS (SELECT o, i AS b, i AS here, 1 AS n, i AS least, rsize AS wanted, true AS ok, next FROM e WHERE g = -1
  UNION ALL SELECT w.o, b, e.i, n + 1, least(least, e.i), wanted, ok AND rsize = wanted, e.next FROM w JOIN e ON e.o = w.o AND e.i = w.next),
op AS (SELECT o, b, n, least, wanted - n AS slack, ok AND n <= wanted AS good FROM w WHERE next = -1),
c AS (SELECT o, i AS b, i AS here, 1 AS n, rsize AS wanted, true AS ok, next FROM e WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.o = e.o AND w.here = e.i)
  UNION ALL SELECT c.o, b, e.i, n + 1, wanted, ok AND rsize = wanted, e.next FROM c JOIN e ON e.o = c.o AND e.i = c.next WHERE c.next <> b),
cl AS (SELECT o, ok AND wanted % n = 0 AS good FROM c WHERE next = b),
y AS (SELECT o, bool_and(good) AS valid FROM (SELECT o, good FROM op UNION ALL SELECT o, good FROM cl) GROUP BY o),
f AS (SELECT op.o, count(*) OVER (PARTITION BY op.o) AS n_open, slack, CASE WHEN starts_with(label, '*') THEN m ELSE b END AS dart, row_number() OVER (PARTITION BY op.o ORDER BY slack, least) AS place FROM op JOIN e ON e.o = op.o AND e.i = op.b)
SELECT y.o AS l_orderkey, valid, CASE WHEN valid THEN coalesce(n_open, 0) END::INTEGER AS n_open, CASE WHEN valid THEN slack END::INTEGER AS slack, CASE WHEN valid THEN dart END::INTEGER AS dart FROM y LEFT JOIN f ON f.o = y.o AND place = 1"""


def state_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order whose state is closed and valid the document, read back by both parsers, and the lines of its polygons."""

    def one(types: list[int], glue: list[int]) -> tuple:
        f = frame(tuple(types))
        if -1 in glue or search.open_rings(f, glue) is None:
            return None, None
        tiling, pairs, lines = text.faces(f, glue)
        document = text.render_document(tiling, pairs, text.signature(tuple(types)))
        loose = text.parse_document_leniently(document)
        if text.parse_document(document) != tiling or (loose["sides"], loose["repeats"], "".join(loose["pairs"])) != (tiling.sides, tiling.repeats, pairs):
            raise ValueError("a document that is read as another")
        return document, "\n".join(lines)

    return _over_states(spark, sf_dir, "document string, cycles string", one).filter("document IS NOT NULL")


STATE_DOCUMENTS = f"""WITH RECURSIVE {_DARTS},
e AS MATERIALIZED (SELECT a.o, a.i, a.r, a.m, a.size, a.label || CASE WHEN a.tile <= 3 THEN repeat('''', a.tile::BIGINT) ELSE '@' || a.tile END AS name, b.size AS rsize, b.m AS rm, b.g AS next, a.g
  FROM d a JOIN d b ON b.o = a.o AND b.i = a.r WHERE a.o NOT IN (SELECT o FROM d WHERE g = -1)),
c AS (SELECT o, i AS b, i AS here, 0 AS n, next, rsize AS wanted, true AS ok FROM e UNION ALL SELECT c.o, b, e.i, n + 1, e.next, wanted, ok AND rsize = wanted FROM c JOIN e ON e.o = c.o AND e.i = c.next WHERE c.next <> b),
z AS (SELECT o FROM (SELECT o, b, bool_and(ok) AS ok, count(*) AS n, any_value(wanted) AS wanted FROM c GROUP BY o, b) GROUP BY o HAVING bool_and(ok AND wanted % n = 0)),
q AS MATERIALIZED (SELECT o, b AS i, min(here) AS a, count(*) AS n FROM c WHERE o IN (FROM z) GROUP BY o, b),
h AS (SELECT q.o, q.a, q.n, e.rsize AS size, p.a AS img FROM q JOIN e ON e.o = q.o AND e.i = q.i JOIN q p ON p.o = q.o AND p.i = e.rm WHERE q.a = q.i),
k AS (SELECT *, bool_and(a <> img) OVER (PARTITION BY o) AS chiral, row_number() OVER (PARTITION BY o ORDER BY least(a, img), a) - 1 AS place FROM h),
t1 AS (SELECT *, CASE WHEN a < img THEN place ELSE place - 1 END AS first FROM k),
hd AS (SELECT *, CASE WHEN a = img THEN place || ': ' WHEN chiral THEN first // 2 || ': ' ELSE first || '/' || (first + 1) || ': ' END AS title FROM t1),
bd AS (SELECT c.o, c.b AS a, string_agg(x.name || '/' || y.name || '(' || x.rsize || ')', '-' ORDER BY c.n) AS body FROM c JOIN e x ON x.o = c.o AND x.i = c.here JOIN e y ON y.o = c.o AND y.i = x.r GROUP BY c.o, c.b),
ln AS (SELECT hd.o, string_agg(CASE WHEN a <= img THEN title ELSE repeat(' ', length(title)) END || CASE WHEN size = hd.n THEN body ELSE '[' || body || ']x' || size // hd.n END, chr(10) ORDER BY place) AS cycles FROM hd JOIN bd USING (o, a) GROUP BY hd.o),
kp AS MATERIALIZED (SELECT o, a, n, size, row_number() OVER (PARTITION BY o ORDER BY place) - 1 AS tile FROM hd WHERE NOT chiral OR a < img),
ed AS MATERIALIZED (SELECT kp.o, row_number() OVER (PARTITION BY kp.o ORDER BY tile, c.n) AS at, c.here AS finish, x.r AS begin, y.m AS mirrored, c.n || CASE WHEN tile <= 3 THEN repeat('''', tile::BIGINT) ELSE '@' || tile END AS own, tile, c.n AS e, kp.n AS len, kp.size
  FROM kp JOIN c ON c.o = kp.o AND c.b = kp.a JOIN c w ON w.o = kp.o AND w.b = kp.a AND w.n = (c.n + kp.n - 1) % kp.n JOIN e x ON x.o = kp.o AND x.i = w.here JOIN e y ON y.o = kp.o AND y.i = x.r),
pr AS (SELECT u.o, u.at AS a, coalesce(v.at, m.at) AS b, u.own AS x, coalesce(v.own, m.own) AS y, v.at IS NULL AS square FROM ed u LEFT JOIN ed v ON v.o = u.o AND v.finish = u.begin LEFT JOIN ed m ON m.o = u.o AND m.begin = u.mirrored),
cw AS (SELECT o, string_agg(CASE WHEN square THEN '[' ELSE '(' END || x || CASE WHEN a = b THEN '' ELSE ' ' || y END || CASE WHEN square THEN ']' ELSE ')' END, '' ORDER BY a) AS pairs FROM pr WHERE a <= b GROUP BY o),
ut AS (SELECT o, string_agg('unittile(' || array_to_string([180 - 360 // size for j in range(0, size)], ',') || ')', chr(10) ORDER BY tile) AS tiles, string_agg(CASE WHEN size > n THEN 'repeat(' || tile || ',' || size // n || ')' || chr(10) ELSE '' END, '' ORDER BY tile) AS repeats FROM kp GROUP BY o),
sg AS (SELECT o, string_agg(symbol || CASE WHEN n > 1 THEN 'x' || n ELSE '' END, ', ' ORDER BY type) AS signature FROM (SELECT o, type, symbol, count(*) AS n FROM pl GROUP BY ALL) GROUP BY o)
SELECT cw.o AS l_orderkey, '## Euclidean, ' || signature || chr(10) || 'e2.' || chr(10) || 'angleunit(deg)' || chr(10) || tiles || chr(10) || 'conway("' || pairs || '")' || chr(10) || repeats AS document, cycles
FROM cw JOIN ut USING (o) JOIN sg USING (o) JOIN ln USING (o)"""


def document_darts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The darts that those documents describe, with their partners and right neighbours."""
    return darts.darts(state_documents(spark, sf_dir), "l_orderkey")


DOCUMENT_DARTS = STATE_DOCUMENTS[: STATE_DOCUMENTS.index("pr AS (")] + """g AS (SELECT u.o, u.tile, u.e, u.len, u.size, side, coalesce(v.tile, m.tile) AS gt, coalesce(v.e, m.e) AS ge, CASE WHEN v.at IS NULL THEN -side ELSE side END AS gs
  FROM ed u LEFT JOIN ed v ON v.o = u.o AND v.finish = u.begin LEFT JOIN ed m ON m.o = u.o AND m.begin = u.mirrored, (VALUES (1), (-1)) s(side))
SELECT g.o AS l_orderkey, g.tile::INTEGER AS tile, g.e::INTEGER AS edge, g.side, g.size::INTEGER AS size, g.gt::INTEGER AS glue_tile, g.ge::INTEGER AS glue_edge, g.gs AS glue_side, r.gt::INTEGER AS right_tile, r.ge::INTEGER AS right_edge, r.gs AS right_side
FROM g JOIN g r ON r.o = g.o AND r.tile = g.tile AND r.side = g.side AND r.e = (g.e - g.side + g.len) % g.len"""


def state_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of free darts of each order's state that may be glued, darts with one such partner, and slots that new vertices offer to its free darts."""

    def one(types: list[int], glue: list[int]) -> tuple:
        f = frame(tuple(types))
        free = [i for i, g in enumerate(glue) if g == -1]
        partners = [sum(search.compatible(f, a, b) for b in free) for a in free]
        offers = search.attachments()
        return len(free), sum(partners), sum(p == 1 for p in partners), sum(len(offers.get((f.size[a], f.size[f.right[a]], f.selfm[a]), ())) for a in free)

    return _over_states(spark, sf_dir, "n_free int, n_pairs int, n_forced int, n_offers int", one)


STATE_SEAMS = f"""WITH {_DARTS},
f AS MATERIALIZED (SELECT a.o, a.i, a.size, b.size AS rsize, a.m = a.i AS own FROM d a JOIN d b ON b.o = a.o AND b.i = a.r WHERE a.g = -1),
p AS (SELECT a.o, a.i, count(*) AS n FROM f a JOIN f b ON a.o = b.o AND a.own = b.own AND a.size = b.rsize AND b.size = a.rsize GROUP BY ALL),
h AS (SELECT b.polygon_size AS rsize, a.polygon_size AS size, a.mirror = a.slot AS own, count(*) AS n FROM sl a JOIN sl b ON a.type_id = b.type_id AND b.slot = a.right_n JOIN t ON t.type_id = a.type_id WHERE a.slot < attach_limit GROUP BY ALL),
k AS (SELECT DISTINCT o FROM d)
SELECT k.o AS l_orderkey, count(f.i)::INTEGER AS n_free, coalesce(sum(p.n), 0)::INTEGER AS n_pairs, count(*) FILTER (p.n = 1)::INTEGER AS n_forced, coalesce(sum(h.n), 0)::INTEGER AS n_offers
FROM k LEFT JOIN f USING (o) LEFT JOIN p ON p.o = f.o AND p.i = f.i LEFT JOIN h ON h.rsize = f.size AND h.size = f.rsize AND h.own = f.own GROUP BY k.o"""


# --- hashes and ids ---


def state_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose first two vertices, glued at their first darts, are the same state up to numbering: by hash, by pair hash, by word and by id.

    The vertices stand in either order, so equal classes come from different numberings.
    """
    own = _orders(spark, sf_dir).filter(F.size("vertices") > 1).select("o", *[F.floor(F.col("vertices")[k] / 3).cast("int").alias(c) for k, c in enumerate("ab")])
    # all orders of two types have one state, so there are as many states as pairs of types at most
    pairs = own.groupBy("a", "b").agg(F.min("o").alias("o"))

    def one(a: int, b: int, o: int) -> tuple:
        types = (a, b)
        f = frame(types)
        glue = list(range(len(f)))
        x, y = 0, f.offsets[1]
        glue[x], glue[y] = y, x
        if f.mirror[x] != x and f.mirror[y] != y:
            glue[f.mirror[x]], glue[f.mirror[y]] = f.mirror[y], f.mirror[x]
        word = ",".join(map(str, canon.word(f, glue)))
        return a, b, o, canon.wl_hash(f, glue), canon.wl2_hash(f, glue), word, canon.stable_id(f, glue)

    made = _over(pairs, "a int, b int, o bigint, wl binary, wl2 binary, word string, id binary", one)
    # an order of a class is named by the class's first order
    named = made.select("a", "b", *[F.min("o").over(W.partitionBy(c)).alias(f"first_{c}") for c in ("wl", "wl2", "word", "id")])
    return own.join(F.broadcast(named), ["a", "b"]).select(F.col("o").alias("l_orderkey"), "first_wl", "first_wl2", "first_word", "first_id")


STATE_CLASSES = f"""WITH {_DARTS},
k AS (SELECT o, min(type) AS a, max(type) AS b FROM v WHERE tile IN (0, 1) GROUP BY o HAVING count(*) = 2),
f AS (SELECT o, min(o) OVER (PARTITION BY a, b) AS first FROM k)
SELECT o AS l_orderkey, first AS first_wl, first AS first_wl2, first AS first_word, first AS first_id FROM f"""


def hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash steps of order and customer keys, and the id of an order as an entry of its customer's source, in hex."""

    def one(o: int, c: int) -> tuple:
        digest = codec.document_id(f"{c:016x}", o)
        shown = digest.hex()
        if codec.parse_hex_id(shown) != digest:
            raise ValueError("an id that is read as another")
        return o, str(canon.fnv64(o, c)), str(canon.mix64(o * 0x9E3779B97F4A7C15 & canon.WORD64)), shown

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    return _over(orders, "o_orderkey bigint, step string, mixed string, source_id string", one)


_WORD = "18446744073709551616::UHUGEINT"
_SHOWN = "array_to_string([printf('%02x', (v // (256::UHUGEINT ** j)::UHUGEINT % 256::UHUGEINT)::BIGINT) for j in range(0, 8)], '')"


def _mixed(x: str) -> str:
    """The 64-bit finaliser in steps, each a subquery."""
    x = f"SELECT xor({x}, {x} // 1073741824::UHUGEINT) * {0xBF58476D1CE4E5B9}::UHUGEINT % {_WORD} AS a"
    x = f"SELECT xor(a, a // 134217728::UHUGEINT) * {0x94D049BB133111EB}::UHUGEINT % {_WORD} AS b FROM ({x})"
    return f"(SELECT xor(b, b // 2147483648::UHUGEINT)::VARCHAR FROM ({x}))"


_LANES = ", ".join(f"list_reduce(list_prepend({seed}::UHUGEINT, x), lambda h, b: xor(h, b + {0x9D * k}::UHUGEINT) * {codec.PRIME}::UHUGEINT % {_WORD}) AS l{k}" for k, seed in enumerate(codec.LANES))
HASH_IDS = f"""WITH o AS (SELECT o_orderkey, o_custkey, 'tes-source-v1:' || printf('%016x', o_custkey) || ':' || o_orderkey AS t, o_orderkey::UHUGEINT * {0x9E3779B97F4A7C15}::UHUGEINT % {_WORD} AS m FROM orders),
b AS (SELECT *, list_transform(range(1, strlen(t) + 1), lambda i: ascii(substr(t, i, 1))::UHUGEINT) AS x FROM o),
l AS (SELECT *, {_LANES} FROM b)
SELECT o_orderkey, (xor(o_orderkey::UHUGEINT, o_custkey::UHUGEINT) * 1099511628211::UHUGEINT % {_WORD})::VARCHAR AS step, {_mixed("m")} AS mixed, {" || ".join(_SHOWN.replace("(v //", f"(l{k} //") for k in range(4))} AS source_id FROM l"""


# --- exact geometry ---


#: What the digits of a line's numbers hang on: the least number that they all divide, in all, for the two vectors and for the point.
_RESIDUES = {"l_partkey": (260, 20, 13), "l_suppkey": (35, 35, None), "l_quantity": (340, 20, 17), "l_linenumber": (9, 3, 9), "l_orderkey": (33, 3, 11)}


def _digits(row: Callable[[str], Column]) -> tuple[list[Column], list[Column], list[Column]]:
    """The vectors a and b and the point p of a line."""
    digit = lambda c, n, low: row(c) % n - low
    a = [digit("l_partkey", 5, 2), digit("l_suppkey", 7, 3), digit("l_quantity", 4, 1), digit("l_linenumber", 3, 1)]
    b = [digit("l_suppkey", 5, 2), digit("l_quantity", 5, 2), digit("l_partkey", 4, 2), digit("l_orderkey", 3, 1)]
    p = [digit("l_orderkey", 11, 5), digit("l_partkey", 13, 6), digit("l_linenumber", 9, 0), digit("l_quantity", 17, 8)]
    return a, b, p


def _area(a: list[Column], b: list[Column]) -> tuple[Column, Column]:
    """F43 as expressions."""
    (ax, ay), (bx, by) = (((2 * v[0] + v[2], v[1]), (v[1] + 2 * v[3], v[2])) for v in (a, b))
    times = lambda x, y: (x[0] * y[0] + 3 * x[1] * y[1], x[0] * y[1] + x[1] * y[0])
    return tuple(x - y for x, y in zip(times(ax, by), times(ay, bx), strict=True))


def with_floor_ratio(rows: DataFrame, name: str, n: tuple[Column, Column], d: tuple[Column, Column]) -> DataFrame:
    """``rows`` with the floor of n / d: a floating quotient, put right by the exact sign of what it leaves; null where d is 0."""
    norm = d[0] * d[0] - 3 * d[1] * d[1]
    way = F.signum(norm.cast("double")).cast("long")
    rows = rows.withColumns({"_x": (n[0] * d[0] - 3 * n[1] * d[1]) * way, "_y": (n[1] * d[0] - n[0] * d[1]) * way, "_norm": F.abs(norm)})
    x, y, norm, near = (F.col(c) for c in ("_x", "_y", "_norm", "_near"))
    rows = rows.withColumn("_near", F.when(norm > 0, F.floor((x + y * F.sqrt(F.lit(3.0))) / F.when(norm > 0, norm))))

    def reaches(k: Column) -> Column:
        rest = x - k * norm
        one, two = rest * rest, 3 * y * y
        return F.when((rest >= 0) & (y >= 0), True).when((rest < 0) & (y < 0), False).when(rest >= 0, one >= two).otherwise(two >= one)

    fixed = F.when(~reaches(near), near - 1).when(reaches(near + 1), near + 1).otherwise(near)
    return rows.withColumn(name, fixed).drop("_x", "_y", "_norm", "_near")


def exact_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two vectors and a point of the ring from each line: sums, turns, mirror images, determinant, sign, independence, the reduced point and the normal basis.

    What two vectors or a point give alone is worked out once for each of them, and the ranges of digits
    bound how many there are; what all three give, by expressions over the distinct triples.
    """
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    whole = lambda c: F.col(c).cast("long")
    # remainders by a number tell those by its divisors
    triples = li.select(*[(whole(c) % n).alias(c) for c, (n, _, _) in _RESIDUES.items()]).groupBy(*_RESIDUES).agg(F.count("*").alias("n"))
    pair_keys = {f"_{c}2": whole(c) % n for c, (_, n, _) in _RESIDUES.items()}
    point_keys = {f"_{c}1": whole(c) % n for c, (_, _, n) in _RESIDUES.items() if n}
    text = lambda v: " ".join(map(str, v))

    def two(*row) -> tuple:
        *keys, a, b = row
        a, b = tuple(a), tuple(b)
        d = geometry.determinant(a, b)
        free = geometry.independent(a, b)
        low = abs(d[0] or d[1])
        basis = text(x for v in geometry.normal_basis(a, b) for x in v) if free else None
        return *keys, text(a), text(b), text(geometry.add(a, geometry.scale(3, b))), *d, geometry.sign(d), free, [k for k in range(1, low + 1) if low % k == 0], basis

    def one(*row) -> tuple:
        *keys, p = row
        p = tuple(p)
        x, y = geometry.cartesian(p)
        return *keys, text(p), text(geometry.turn(p, 5)), text(geometry.mirrored(p)), text(geometry.step(p[2])), round(x, 6), round(y, 6)

    a, b, p = _digits(whole)
    typed = lambda keys: ", ".join(f"{k} bigint" for k in keys)
    lines = lambda keys, **more: li.select(*[x.alias(k) for k, x in keys.items()], *[F.array(*v).alias(k) for k, v in more.items()]).distinct()
    pairs = _over(lines(pair_keys, a2=a, b2=b), f"{typed(pair_keys)}, a string, b string, total string, det bigint, radical bigint, sign int, free boolean, divisors array<bigint>, basis string", two)
    points = _over(lines(point_keys, p1=p), f"{typed(point_keys)}, p string, turned string, mirrored string, step string, x double, y double", one)
    met = triples
    for keys, table in ((pair_keys, pairs), (point_keys, points)):
        own = table.toDF(*[f"{c}_" if c in keys else c for c in table.columns])
        met = met.withColumns(keys).join(F.broadcast(own), [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]).drop(*keys, *own.columns[: len(keys)])

    d = F.col("det"), F.col("radical")
    met = met.withColumns({"s0": (same := _area(p, b))[0], "s1": same[1], "t0": (other := _area(a, p))[0], "t1": other[1]})
    met = with_floor_ratio(met, "m", (F.col("s0"), F.col("s1")), d)
    met = with_floor_ratio(met, "k", (F.col("t0"), F.col("t1")), d)
    # a rational quotient is that of the parts, of which one is not 0
    top, low = F.when(d[0] != 0, F.col("s0")).otherwise(F.col("s1")), F.when(d[0] != 0, d[0]).otherwise(d[1])
    rational = F.col("free") & (F.col("s1") * d[0] == F.col("s0") * d[1])
    met = met.withColumns({"top": F.when(rational, F.when(low < 0, -top).otherwise(top)), "low": F.abs(low)})
    met = met.withColumn("divisor", F.when(rational, F.array_max(F.filter("divisors", lambda k: F.col("top") % k == 0))))
    share = lambda c: F.expr(f"{c} div divisor").cast("string")
    ratio = F.when(F.col("divisor") == F.col("low"), share("top")).otherwise(F.concat(share("top"), F.lit("/"), share("low")))
    joined = lambda v: F.concat_ws(" ", *[x.cast("string") for x in v])
    reduced = F.when(F.col("free"), joined([z - F.col("m") * x - F.col("k") * y for x, y, z in zip(a, b, p, strict=True)]))
    less = joined([z - x for x, z in zip(a, p, strict=True)])
    return met.select("n", "a", "b", "p", "total", less.alias("less"), "turned", "mirrored", "step", reduced.alias("reduced"), "det", "radical", "sign", "free", "x", "y", ratio.alias("ratio"), "basis")


def _line(x: str) -> str:
    return f"array_to_string({x}, ' ')"


def _det(a: str, b: str) -> tuple[str, str]:
    """Four times the oriented area as rational part and part of the square root of 3."""
    x = lambda v: (f"(2 * {v}[1] + {v}[3])", f"{v}[2]")
    y = lambda v: (f"({v}[2] + 2 * {v}[4])", f"{v}[3]")
    (ax, ar), (ay, as_), (bx, br), (by, bs) = x(a), y(a), x(b), y(b)
    return f"({ax} * {by} + 3 * {ar} * {bs} - {ay} * {bx} - 3 * {as_} * {br})", f"({ax} * {bs} + {ar} * {by} - {ay} * {br} - {as_} * {bx})"


_D, _R = _det("a", "b")
_PD, _PR = _det("p", "b")
_QD, _QR = _det("a", "p")
_V = "({0} + {1} * sqrt(3::DOUBLE))"
#: p - m a - n b by parts of a cell; a thousandth of a millionth keeps whole quotients whole.
_FLOOR = f"floor({_V.format('{0}', '{1}')} / {_V.format('det', 'radical')} + 1e-9)::BIGINT"
_SIGNED = "[{0}, [-x for x in {0}]]"
_BASES = "list_min(list_concat(" + ", ".join(f"flatten([[x || y for y in {_SIGNED.format(q)}] for x in {_SIGNED.format(p)}])" for p, q in ("ab", "ba")) + "))"
_TURN = "[-{0}[4], {0}[1], {0}[2] + {0}[4], {0}[3]]"
GEOMETRY = f"""WITH l AS (SELECT [l_partkey % 5 - 2, l_suppkey % 7 - 3, l_quantity::BIGINT % 4 - 1, (l_linenumber % 3 - 1)::BIGINT] AS a, [l_suppkey % 5 - 2, l_quantity::BIGINT % 5 - 2, l_partkey % 4 - 2, l_orderkey % 3 - 1] AS b,
  [l_orderkey % 11 - 5, l_partkey % 13 - 6, (l_linenumber % 9)::BIGINT, l_quantity::BIGINT % 17 - 8] AS p FROM lineitem),
g AS (SELECT a, b, p, count(*) AS n, {_D} AS det, {_R} AS radical, {_PD} AS pd, {_PR} AS pr, {_QD} AS qd, {_QR} AS qr FROM l GROUP BY a, b, p),
t1 AS (SELECT *, {_TURN.format("p")} AS u FROM g), t2 AS (SELECT * REPLACE ({_TURN.format("u")} AS u) FROM t1), t3 AS (SELECT * REPLACE ({_TURN.format("u")} AS u) FROM t2), t4 AS (SELECT * REPLACE ({_TURN.format("u")} AS u) FROM t3), t5 AS (SELECT * REPLACE ({_TURN.format("u")} AS u) FROM t4),
h AS (SELECT *, det <> 0 OR radical <> 0 AS free, det * det - 3 * radical * radical AS norm, pd * det - 3 * pr * radical AS num FROM t5),
i AS (SELECT *, CASE WHEN free THEN {_FLOOR.format("pd", "pr")} END AS m, CASE WHEN free THEN {_FLOOR.format("qd", "qr")} END AS q, CASE WHEN free AND pr * det = pd * radical THEN gcd(abs(num), abs(norm)) END AS c FROM h)
SELECT n, {_line("a")} AS a, {_line("b")} AS b, {_line("p")} AS p, {_line("[a[k] + 3 * b[k] for k in range(1, 5)]")} AS total, {_line("[p[k] - a[k] for k in range(1, 5)]")} AS less, {_line("u")} AS turned,
  {_line("[p[1] + p[3], p[2], -p[3], -p[2] - p[4]]")} AS mirrored,
  ['1 0 0 0', '0 1 0 0', '0 0 1 0', '0 0 0 1', '-1 0 1 0', '0 -1 0 1', '-1 0 0 0', '0 -1 0 0', '0 0 -1 0'][p[3] + 1] AS step,
  CASE WHEN free THEN {_line("[p[k] - m * a[k] - q * b[k] for k in range(1, 5)]")} END AS reduced, det, radical, sign({_V.format("det", "radical")})::INTEGER AS sign, free,
  round(p[1] + sqrt(3::DOUBLE) * p[2] / 2 + p[3] / 2::DOUBLE, 6) AS x, round(p[2] / 2::DOUBLE + sqrt(3::DOUBLE) * p[3] / 2 + p[4], 6) AS y,
  CASE WHEN c IS NOT NULL THEN (sign(norm)::BIGINT * num // c)::VARCHAR || CASE WHEN abs(norm) = c THEN '' ELSE '/' || (abs(norm) // c)::VARCHAR END END AS ratio,
  CASE WHEN free THEN {_line(_BASES)} END AS basis FROM i"""

STATES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "state_texts": (state_texts, STATE_TEXTS),
    "state_rings": (state_rings, STATE_RINGS),
    "state_documents": (state_documents, STATE_DOCUMENTS),
    "document_darts": (document_darts, DOCUMENT_DARTS),
    "state_seams": (state_seams, STATE_SEAMS),
    "state_classes": (state_classes, STATE_CLASSES),
    "hash_ids": (hash_ids, HASH_IDS),
    "exact_geometry": (exact_geometry, GEOMETRY),
}
