r"""A Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups, and a proof for each row.

A row's leaf is H of its fields, a node is H of ``FAN`` consecutive nodes (the last run may
be shorter, one even), and a group's last node is its subroot; the subroots, in order of
their group, give the root alike.  H is the lowercase hex SHA-256 of its concatenated inputs.

Work is distributed by *aligned blocks* of ``FAN ** LEVELS`` consecutive nodes of a group.  A
task walks a block in postorder: each call returns its subtree's digest, and while it unwinds
it appends the siblings that it met to the leaves below.  Block roots are the nodes of the
next such traversal, which is distributed in the same way, until each group has one node.
No task holds more than a block, however large a group is; a proof is put together from the
parts that the traversals appended, by equi-joins on (group, block).

Defined results: a null field counts as ``-``; null keys come first in their group, the null
group first among the groups; rows with equal keys stand in order of their leaves, and full
copies are leaves of their own; empty and very long texts are hashed whole like all others;
an empty table has no rows and no root; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquilt.llm import common

FAN = 3
#: Levels of one block's traversal: 2,187 nodes.
LEVELS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def framed(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(fields: list[Column]) -> Column:
    """A leaf's 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(framed, fields)).cast("binary"), 256))


def _sha(nodes: list[bytes]) -> bytes:
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


def height(n: int) -> int:
    """Levels from ``n`` nodes to one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def walk(nodes: list[bytes], levels: int) -> tuple[bytes, list[bytearray]]:
    """A block's root after ``levels`` levels, and for each node its siblings, lowest level first."""
    proofs = [bytearray() for _ in nodes]

    def visit(low: int, high: int, level: int) -> bytes:
        if level == 0:
            return nodes[low]
        width = FAN ** (level - 1)
        starts = range(low, high, width)
        children = [visit(at, min(at + width, high), level - 1) for at in starts]
        for k, at in enumerate(starts):
            siblings = b"".join(children[:k] + children[k + 1 :])
            for leaf in range(at, min(at + width, high)):
                proofs[leaf] += siblings
        return _sha(children)

    return visit(0, len(nodes), levels), proofs


def fold(node: bytes, place: int, n: int, proof: bytes, at: int = 0) -> tuple[bytes, int]:
    """The root over ``n`` nodes from the one at ``place`` and its proof from byte ``at``; and where the rest of the proof starts."""
    while n > 1:
        mine = place % FAN
        others = min(FAN, n - (place - mine)) - 1
        siblings = [proof[at + 32 * k : at + 32 * k + 32] for k in range(others)]
        node = _sha(siblings[:mine] + [node] + siblings[mine:])
        place, n, at = place // FAN, -(-n // FAN), at + 32 * others
    return node, at


def ranked(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """``rows`` with ``idx`` (0, 1, ... in each group, by ``order``) and ``n`` (the group's rows).

    Sorted ranges are numbered by themselves and shifted by what stands before them, so no
    task sees a whole group.
    """
    spread = rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    own = common.cut(spread.withColumn("_place", F.monotonically_increasing_id()), sweep=False)
    part = F.shiftright("_place", 33)
    runs = own.groupBy(group, part.alias("_part")).agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    ends = F.expr(f"sum(_rows) OVER (PARTITION BY `{group}` ORDER BY _part)")
    runs = runs.select(group, "_part", "_first", (ends - F.col("_rows")).alias("_before"), F.expr(f"sum(_rows) OVER (PARTITION BY `{group}`)").alias("n"))
    both = own.withColumn("_part", part).join(runs, [group, "_part"])
    return both.withColumn("idx", F.col("_place") - F.col("_first") + F.col("_before")).drop("_place", "_first", "_part", "_before")


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, from batches sorted by them; the last run of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        last = [c[batch.num_rows - 1] for c in cols]
        start = batch.num_rows - 1
        while start > 0 and all(c[start - 1] == x for c, x in zip(cols, last)):
            start -= 1
        if start == 0 and (not held or all(held[-1].column(held[-1].schema.get_field_index(k))[held[-1].num_rows - 1] == x for k, x in zip(keys, last))):
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, start)])
        held = [batch.slice(start)]
    if held:
        yield pa.Table.from_batches(held)


def _traverse(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, ("g", "block")):
            groups, blocks, nodes, totals = (table[c].to_pylist() for c in ("g", "block", "node", "n"))
            proofs: list[bytes] = []
            roots: list[tuple] = []
            at = 0
            while at < len(nodes):
                end = at + 1
                while end < len(nodes) and blocks[end] == blocks[at] and groups[end] == groups[at]:
                    end += 1
                alone = totals[at] <= FAN**LEVELS
                root, own = walk(nodes[at:end], height(end - at) if alone else LEVELS)
                proofs += map(bytes, own)
                roots.append((groups[at], blocks[at], -(-totals[at] // FAN**LEVELS), root))
                at = end
            rows = table.append_column("proof", pa.array(proofs, pa.binary())).append_column("root", pa.nulls(len(nodes), pa.binary()))
            tops = {"g": [r[0] for r in roots], "block": [r[1] for r in roots], "n": [r[2] for r in roots], "root": [r[3] for r in roots]}
            more = pa.table([pa.array(tops[f.name], f.type) if f.name in tops else pa.nulls(len(roots), f.type) for f in schema], schema=schema)
            for out in (rows.select(schema.names).cast(schema), more):
                yield from out.combine_chunks().to_batches()

    return run


def _tier(nodes: DataFrame) -> DataFrame:
    """One distributed traversal of nodes (g, idx, n, node, ...): its rows with their part of the proof, and a row with ``root`` for each block."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, StructField, StructType

    rows = nodes.withColumn("block", F.floor(F.col("idx") / FAN**LEVELS).cast("long"))
    schema = StructType([StructField(f.name, f.dataType) for f in rows.schema] + [StructField("proof", BinaryType()), StructField("root", BinaryType())])
    spread = rows.repartition("g", "block").sortWithinPartitions("g", "block", "idx")
    return common.cut(spread.mapInArrow(_traverse(to_arrow_schema(schema)), schema))


def _climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From ranked nodes (g, idx, n, node, ...): the first tier; (g, block, above), what a proof goes on with; (g, subroot)."""
    tiers = [_tier(nodes)]
    done = None
    while True:
        tops = tiers[-1].filter("root IS NOT NULL").select("g", F.col("block").alias("idx"), "n", F.col("root").alias("node"))
        ends = tops.filter("n = 1").select("g", F.col("node").alias("subroot"))
        done = ends if done is None else done.unionByName(ends)
        more = tops.filter("n > 1")
        if more.isEmpty():
            break
        tiers.append(_tier(more))
    above = None
    for tier in reversed(tiers[1:]):
        own = tier.filter("root IS NULL").select("g", F.col("idx").alias("block"), F.col("block").alias("_up"), "proof")
        if above is not None:
            own = own.join(above.select("g", F.col("block").alias("_up"), "above"), ["g", "_up"], "left").withColumn("proof", F.concat("proof", F.coalesce("above", F.lit(b""))))
        above = own.select("g", "block", F.col("proof").alias("above"))
    tops = tiers[0].filter("root IS NOT NULL").select("g", "block")
    above = tops.withColumn("above", F.lit(b"")) if above is None else tops.join(above, ["g", "block"], "left").withColumn("above", F.coalesce("above", F.lit(b"")))
    return tiers[0].filter("root IS NULL").drop("root"), above, done


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "source", other: Column | None = None) -> DataFrame:
    """(key, leaf, subroot, root, proof, idx, n, group_idx, n_groups, other): one row for each of ``docs``, digests as bytes.

    ``proof`` holds the siblings' digests from the leaf's level to the root; a leaf has place
    ``idx`` of ``n`` in its group, which has place ``group_idx`` of ``n_groups``.  ``other``, an
    expression over ``docs``, comes along (a leaf of changed content, for ``folded``).
    """
    leaf = digest([F.col(f"`{f}`") for f in fields])
    leaves = common.cut(docs.select(F.col(f"`{key}`").alias("key"), framed(F.col(f"`{group}`")).alias("g"), leaf.alias("node"), (F.lit(None).cast("binary") if other is None else other).alias("other")))
    order = (F.col("key").asc_nulls_first(), F.col("node"))
    rows, above, subroots = _climb(ranked(leaves, "g", *order))
    common.free(leaves)
    name = F.when(F.col("g") != "-", F.expr("substring(g, instr(g, ':') + 1)"))
    groups = ranked(subroots.select(F.lit("").alias("g"), F.col("g").alias("group"), name.alias("name"), F.col("subroot").alias("node")), "g", F.col("name").asc_nulls_first())
    top, over, root = _climb(groups)
    # one row for each block of leaves: what their proofs go on with, and where their group stands
    path = top.join(over.select("block", "above"), "block").join(F.broadcast(root.toDF("g", "root")), "g")  # the root is one row
    path = path.select(F.col("group").alias("g"), F.col("idx").alias("group_idx"), F.col("n").alias("n_groups"), F.col("node").alias("subroot"), F.concat("proof", "above").alias("_over"), "root")
    blocks = common.cut(above.join(path, "g").withColumn("above", F.concat("above", "_over")).drop("_over"))
    out = rows.join(blocks, ["g", "block"])
    return out.select(F.col("key").alias(key), F.col("node").alias("leaf"), "subroot", "root", F.concat("proof", "above").alias("proof"), "idx", "n", "group_idx", "n_groups", "other")


def folded(made: DataFrame, leaf: Column, out: str = "folded") -> DataFrame:
    """``made`` (as ``manifest`` gives it) with the root that ``leaf`` and the row's proof lead to, as bytes."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    rows = made.withColumn(out, leaf)
    at = {c: rows.columns.index(c) for c in ("idx", "n", "group_idx", "n_groups", "proof", out)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {c: batch.column(k).to_pylist() for c, k in at.items()}
            found = []
            for node, place, n, group, groups, proof in zip(cols[out], cols["idx"], cols["n"], cols["group_idx"], cols["n_groups"], cols["proof"]):
                node, rest = fold(node, place, n, proof)
                found.append(fold(node, group, groups, proof, rest)[0])
            yield batch.set_column(at[out], out, pa.array(found, batch.schema.field(at[out]).type))

    return rows.mapInArrow(run, StructType([StructField(f.name, f.dataType if f.name != out else BinaryType()) for f in rows.schema]))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and the root that its (for half of them tampered) content leads to."""
    docs = common.read(spark, sf_dir, "documents")
    text = F.col("text")
    changed = digest([F.replace(text, F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in FIELDS])
    tampered = F.when((F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains(text, F.lit("\n")), changed)
    made = folded(manifest(docs, other=tampered), F.coalesce("other", "leaf"))
    low = lambda c: F.lower(F.hex(c))
    return made.select(
        "doc_id", low("leaf").alias("leaf"), low("subroot").alias("subroot"), low("root").alias("root"), F.sha2(low("proof").cast("binary"), 256).alias("proof_sha256"),
        low("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


def sql_crc32(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes, in DuckDB."""
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    data = f"list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: {step}), 4294967295)"


def oracle_sql() -> str:
    def frame(x: str) -> str:
        return f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(frame(text if f == "text" else f) for f in FIELDS) + ")"

    def tree(name: str, start: str) -> str:
        """Levels of trees with nodes (g, lv, i, n, node)."""
        return f"""{name} AS ({start} UNION ALL
          SELECT g, lv + 1, i // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(node, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY g, lv, i // {FAN}, n)"""

    def proofs(name: str, nodes: str, levels: str) -> str:
        """(r, g, p): the siblings' hex digests of each row (r, g, i)."""
        return f"""{name} AS (SELECT r, any_value(d.g) AS g, coalesce(string_agg(t.node, '' ORDER BY t.lv, t.i), '') AS p FROM {nodes} d
          LEFT JOIN {levels} t ON t.g = d.g AND t.n > 1 AND d.i // pow({FAN}, t.lv)::BIGINT <> t.i AND d.i // pow({FAN}, t.lv + 1)::BIGINT = t.i // {FAN} GROUP BY r)"""

    def folds(name: str, start: str, levels: str) -> str:
        """Rows (r, g, lv, i, n, node) climbing with their own digest among the tree's siblings."""
        return f"""{name} AS ({start} UNION ALL
          SELECT f.r, f.g, f.lv + 1, f.i // {FAN}, (f.n + {FAN - 1}) // {FAN}, sha256(string_agg(CASE WHEN t.i = f.i THEN f.node ELSE t.node END, '' ORDER BY t.i))
          FROM {name} f JOIN {levels} t ON t.g = f.g AND t.lv = f.lv AND t.i // {FAN} = f.i // {FAN} WHERE f.n > 1 GROUP BY f.r, f.g, f.lv, f.i, f.n)"""

    return f"""
    WITH RECURSIVE a AS (SELECT doc_id, source, {frame('source')} AS g, {leaf('text')} AS leaf,
        CASE WHEN {sql_crc32('doc_id::VARCHAR')} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS used FROM documents),
    d AS MATERIALIZED (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM a),
    {tree('t', 'SELECT g, 0::BIGINT AS lv, i, n, leaf AS node FROM d')},
    s AS MATERIALIZED (SELECT g, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM (SELECT g, node FROM t WHERE n = 1) JOIN (SELECT DISTINCT g, source FROM d) USING (g)),
    {tree('u', "SELECT '' AS g, 0::BIGINT AS lv, i, n, node FROM s")},
    {proofs('p', 'd', 't')},
    {proofs('q', "(SELECT '' AS g, g AS r, i FROM s)", 'u')},
    {folds('f', 'SELECT r, g, 0::BIGINT AS lv, i, n, used AS node FROM d', 't')},
    {folds('h', "SELECT f.r, '' AS g, 0::BIGINT AS lv, s.i, s.n, f.node FROM f JOIN s ON f.g = s.g WHERE f.n = 1", 'u')}
    SELECT d.doc_id, d.leaf, s.node AS subroot, root.node AS root, sha256(p.p || q.p) AS proof_sha256, h.node AS folded_root, h.node = root.node AS verified
    FROM d JOIN s ON d.g = s.g JOIN p ON d.r = p.r JOIN q ON d.g = q.r JOIN h ON d.r = h.r AND h.n = 1, (SELECT node FROM u WHERE n = 1) root
    """
