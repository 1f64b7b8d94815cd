r"""MinHash near-dedup: banded candidates, sequential Bayesian verification, exact confirmation.

A document's set holds its distinct 5-word shingles (A-Z lower-cased, words
``[^\x20\x09-\x0D]+``); with fewer words the whole sequence is its one shingle.  Two
documents are linked if 100 * intersection >= 75 * union.

1. One signature of ``BANDS * ROWS`` minima for each distinct word sequence: copies
   collapse, map-side first, to the least id.
2. A bucket is the sequences that agree on all rows of a band.  Each bucket links its
   members to its least one (a star, not all pairs); a pair counts once over all bands.
3. Signatures of a candidate pair are compared in batches of ``BATCH``; after each the
   pair goes if P(similarity >= threshold | matches so far) < ``MISS`` under a uniform
   prior.  Survivors are confirmed on their full sets.
4. A bucket whose members still fall in several components holds pairs that no star has
   compared.  One of at most ``BLOCK`` members (without its centre) is compared across its
   components by the same test, carried on to ``MOST`` minima; each pair counts in the
   first such bucket that it shares, and survivors are confirmed with those of step 5.
5. Members of larger buckets that are still in several components are joined on all
   their shingles by prefixes, which misses nothing: two sets that are similar enough share
   one of the rarest shingles of each, so early that what follows it can still be enough.
   These pairs are confirmed without pruning.
6. Where that join would meet more than ``MEETS`` pairs a row, the members are dealt to finer
   buckets first, of more rows a band and more bands (``FINER``), whose stars link most of
   what belongs together (steps 2 and 3), as sets of one component need not meet.

At the threshold a pair misses all bands with a chance of (1 - 0.75**4) ** 40 = 2.5e-7.

A document of any length is one set; ties of ids are one document (see below), and an
empty table gives an empty table.

null and empty texts have an empty set and stay alone.  A row with a null id stays
alone too, with a null component, and is kept.  Rows of one id are one document that
is linked where any of their texts is.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyquilt.llm import common, graph

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 40, 4
BATCH = 32
MISS = 1e-6
#: Minima that pairs inside unsettled buckets are compared by, and so many more a batch.
MOST, MORE = 1024, 96
#: Members of a bucket that are compared with each other in one task.
BLOCK = 1024
#: Pairs of shingles that the exact join may meet for each of its rows before finer buckets link more members.
MEETS = 256
#: Documents for which a task is worth while.
EACH = 4096
#: Bands and rows of the finer buckets.
FINER = ((64, 8), (128, 16))

_RNG = np.random.default_rng(20240229)
_FLIP = _RNG.integers(0, 1 << 32, MOST, dtype=np.uint32)
_TIMES = _RNG.integers(0, 1 << 31, MOST, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased texts: distinct shingle fingerprints, each one's text (ascending), and two sequence fingerprints a text."""
    data = common.LOWER[data]
    starts, ends, words = common.word_spans(data, offsets)
    hashes = common.word_hashes(data, starts, ends)
    first, texts = common.window_texts(words, width)
    h = common.window_hashes(hashes, width)[first] if len(first) else np.zeros(0, np.uint64)
    counts = np.diff(words)
    # sequence fingerprints: sums of words times powers of their places, in two lanes
    place = np.arange(len(hashes)) - np.repeat(words[:-1], counts)
    p = common.powers(int(counts.max(initial=0)) + 2)
    lanes = []
    for seed in (1, 2):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(common.mix(hashes + np.uint64(seed)) * p[place + 1], out=sums[1:])
        lanes.append(common.mix(sums[words[1:]] - sums[words[:-1]] + counts.astype(np.uint64)))
    few = np.flatnonzero((counts > 0) & (counts < width))
    h, texts = np.r_[h, lanes[0][few]], np.r_[texts, few]
    order = np.lexsort((h, texts))
    h, texts = h[order], texts[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (texts[1:] != texts[:-1])][: len(h)]
    return h[new], texts[new], lanes[0], lanes[1]


def signatures(h: np.ndarray, heads: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """uint32 minima, one row a hash function, one column a set; ``heads``: where each (non-empty) set begins."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((size, len(heads)), np.uint32)
    for k in range(size):
        out[k] = np.minimum.reduceat((x ^ _FLIP[k]) * _TIMES[k], heads)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """int64 keys, one row a set, one column a band."""
    keys = np.empty((sig.shape[1], BANDS), np.uint64)
    for b in range(BANDS):
        k = np.full(sig.shape[1], b + 1, np.uint64)
        for r in range(ROWS):
            k = common.mix(k * np.uint64(0x9E3779B97F4A7C15) + sig[b * ROWS + r])
        keys[:, b] = k
    return keys.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in common.blocks(batches, "text"):
        n = block.num_rows
        h, texts, fp1, fp2 = shingles(*common.raw(block.column(1)))
        counts = np.bincount(texts, minlength=n)
        full = np.flatnonzero(counts)
        sig: list = [None] * n
        lists: list = [None] * n
        if len(full):
            s = signatures(h, np.flatnonzero(np.r_[True, texts[1:] != texts[:-1]]))
            bands = band_keys(s)
            small = np.ascontiguousarray(s.T.astype(np.uint16))
            for k, t in enumerate(full.tolist()):
                sig[t] = small[k].tobytes()
                lists[t] = bands[k]
        yield pa.RecordBatch.from_arrays(
            [block.column(0), pa.array(counts, pa.int64()), pa.array(fp1.view(np.int64)), pa.array(fp2.view(np.int64)), pa.array(lists, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
            names=["id", "n", "fp1", "fp2", "bands", "sig"],
        )


def least_matches(n: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """The fewest matches of n compared minima at which P(similarity >= percent / 100) >= miss, by the Beta posterior."""
    x = (np.arange(20_000) + 0.5) / 20_000
    least, most = 0, n
    while least < most:  # the posterior grows with the matches
        m = (least + most) // 2
        logs = m * np.log(x) + (n - m) * np.log1p(-x)
        weight = np.exp(logs - logs.max())
        if weight[x >= percent / 100].sum() / weight.sum() >= miss:
            most = m
        else:
            least = m + 1
    return least


#: After so many minima so many matches are needed.
_LEAST = [(k, least_matches(k)) for k in (*range(BATCH, BANDS * ROWS + 1, BATCH), *range(BANDS * ROWS + MORE, MOST + 1, MORE))]


def plausible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two signature matrices survive the sequential test."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    done = 0
    for upto, least in _LEAST:
        if upto > a.shape[1] or not len(alive):
            break
        matches[alive] += (a[alive, done:upto] == b[alive, done:upto]).sum(1)
        alive = alive[matches[alive] >= least]
        done = upto
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            stay = plausible(_matrix(batch.column(2)), _matrix(batch.column(3)))
            yield batch.select([0, 1]).filter(pa.array(stay))


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n, sig): all ``MOST`` minima of each text that has a set."""
    for block in common.blocks(batches, "text", common.BLOCK_BYTES // 4):
        h, texts, _, _ = shingles(*common.raw(block.column(1)))
        full, heads, counts = np.unique(texts, return_index=True, return_counts=True)
        if len(full):
            small = np.ascontiguousarray(signatures(h, heads, MOST).T.astype(np.uint16))
            yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(full)), pa.array(counts, pa.int64()), pa.array([x.tobytes() for x in small], pa.binary())], names=["id", "n", "sig"])


def _across(table: pa.Table) -> pa.Table:
    """Of one small bucket: pairs of different components that sizes allow, that share no smaller such bucket, and that survive the sequential test."""
    table = table.combine_chunks()
    here = table["bucket"][0].as_py()
    ids, comp, n = (np.asarray(table[c].cast(pa.int64())) for c in ("id", "comp", "n"))
    sig = _matrix(table["sig"].combine_chunks())
    before = [np.array([x for x in own if x < here], np.int64) for own in table["buckets"].to_pylist()]
    owner = np.repeat(np.arange(len(ids)), [len(x) for x in before])
    flat = np.concatenate(before) if before else np.zeros(0, np.int64)
    kinds, counts = np.unique(comp, return_counts=True)
    most = kinds[counts.argmax()]
    left, right = [], []
    # members of the largest component are compared with those outside it only
    for i in np.flatnonzero(comp != most).tolist():
        others = np.flatnonzero((comp > comp[i]) | (comp == most))
        others = others[(ids[others] != ids[i]) & (100 * np.minimum(n[i], n[others]) >= PERCENT * np.maximum(n[i], n[others]))]
        met = np.zeros(len(ids), bool)
        met[owner[np.isin(flat, before[i])]] = True
        others = others[~met[others]]
        if len(others):
            others = others[plausible(np.broadcast_to(sig[i], (len(others), sig.shape[1])), sig[others])]
            left.append(np.full(len(others), ids[i]))
            right.append(ids[others])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


def _dealt(bands: int, rows: int, level: int):
    pick = np.random.default_rng((31, level)).integers(0, BANDS * ROWS, (bands, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _matrix(batch.column(1)).astype(np.uint64)
            keys = np.empty((len(sig), bands), np.uint64)
            for b in range(bands):
                k = np.full(len(sig), 1 + b + 1000 * level, np.uint64)
                for r in pick[b]:
                    k = common.mix(k * np.uint64(0x9E3779B97F4A7C15) + sig[:, r])
                keys[:, b] = k
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(keys.view(np.int64)), pa.list_(pa.int64()))], names=["id", "buckets"])

    return run


def finer(members: DataFrame, sigs: DataFrame, level: int) -> DataFrame:
    """The shared finer buckets (bucket, id) of the ids in ``members``."""
    own = sigs.join(members.select("id").distinct().hint("merge"), "id", "left_semi").select("id", "sig")
    return shared(own.mapInArrow(_dealt(*FINER[level], level), "id bigint, buckets array<bigint>").select("id", F.explode("buckets").alias("bucket")).distinct())


def shared(members: DataFrame) -> DataFrame:
    """The members (bucket, id) of buckets with two of them or more."""
    more = members.groupBy("bucket").agg(F.count("*").alias("_m")).filter("_m > 1").select("bucket")
    return members.join(more.hint("merge"), "bucket").select("bucket", "id")


def with_component(members: DataFrame, found: DataFrame) -> DataFrame:
    """``members`` (bucket, id) with ``comp``, the component of their id: an id, with its bounded number of buckets, is one row that meets its component."""
    own = members.groupBy("id").agg(F.collect_list("bucket").alias("buckets"))
    met = own.join(found.toDF("id", "_component").hint("merge"), "id", "left")
    return met.select(F.explode("buckets").alias("bucket"), "id", F.coalesce("_component", "id").alias("comp"))


def across(near: DataFrame, texts: DataFrame, docs: int) -> DataFrame:
    """Candidate pairs (a, b) between the components of each small bucket of ``near`` (bucket, id, comp); ``docs``: how many documents there are."""
    buckets = near.groupBy("id").agg(F.collect_set("bucket").alias("buckets"))  # as many as there are bands at most
    wide = texts.join(near.select("id").distinct().hint("merge"), "id", "left_semi").mapInArrow(_wide, "id bigint, n bigint, sig binary").distinct()
    wide = common.cut(common.few(wide, docs, EACH))
    met = near.join(wide.join(buckets.hint("merge"), "id").hint("merge"), "id")
    out = met.select("bucket", "id", "comp", "n", "sig", "buckets").groupBy("bucket").applyInArrow(_across, "a bigint, b bigint").distinct()
    out = common.cut(common.few(out, docs, EACH))
    common.free(wide)
    return out


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, own, n, token): each shingle of a set, with the set's size."""
    for whole in batches:
        for at in range(0, whole.num_rows, 200):  # sets may be long
            batch = whole.slice(at, 200)
            sets = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
            n = np.array([len(x) for x in sets], np.int64)
            rows = pa.array(np.repeat(np.arange(len(sets)), n))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets))], names=["id", "own", "n", "token"])


def remaining(own: DataFrame, texts: DataFrame, docs: int, meets: int | None = None) -> DataFrame | None:
    """All pairs (a, b) of different components among the members ``own`` (bucket, id, comp) of unsettled buckets whose sets may be similar enough.

    None if more than ``meets`` pairs would meet for each early shingle of a set.

    Shingles are ordered from the rarest on.  The first one that two sets share stands, in
    each, among the first n - ceil(n * PERCENT / 100) + 1, and no more of them can follow than
    both sets have left.  Of a shingle's sets those in its largest component meet the others only.
    """
    unsettled = own.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 < c1").select("bucket")
    ids = common.cut(common.few(own.join(unsettled.hint("merge"), "bucket").select("id", "comp").distinct(), docs, EACH))
    sets = _sets_in(texts, ids.select("id"))
    # rows of one id may have several texts: ``own`` tells their sets
    tokens = sets.filter("octet_length(shingles) > 0").select("id", F.xxhash64("shingles").alias("own"), "shingles").distinct().mapInArrow(_tokens, "id bigint, own bigint, n bigint, token bigint")
    tokens = common.cut(common.few(tokens, docs, EACH))
    often = tokens.groupBy("token").agg(F.count("*").alias("often"))
    ranked = tokens.join(often.hint("merge"), "token").withColumn("place", F.row_number().over(Window.partitionBy("id", "own").orderBy("often", "token")) - 1)
    early = ranked.filter(f"often > 1 AND 100 * (n - place) >= {PERCENT} * n").join(ids.hint("merge"), "id").select("token", "id", "comp", "n", "place")
    early = common.cut(common.few(early, docs, EACH))
    most = early.groupBy("token", "comp").agg(F.count("*").alias("m")).groupBy("token").agg(F.max_by("comp", F.struct("m", "comp")).alias("most"), F.max("m").alias("m"), F.sum("m").alias("sets"), F.count("*").alias("_comps"))
    most = common.cut(common.few(most.filter("_comps > 1").select("token", "most", "m", "sets"), docs, EACH))
    # sets outside a shingle's largest component meet all of its sets
    if meets is not None and (most.agg(F.sum((F.col("sets") - F.col("m")).cast("double") * F.col("sets"))).first()[0] or 0) > meets * early.count():
        common.free(ids, tokens, early, most)
        return None
    named = early.join(most.select("token", "most").hint("merge"), "token")
    x = named.filter("comp <> most").select("token", *[F.col(c).alias(f"{c}_x") for c in ("id", "comp", "n", "place")])
    y = named.select("token", "most", *[F.col(c).alias(f"{c}_y") for c in ("id", "comp", "n", "place")])
    met = x.join(y.hint("merge"), "token").filter(
        f"(comp_y > comp_x OR comp_y = most) AND comp_x <> comp_y AND id_x <> id_y AND 100 * least(n_x, n_y) >= {PERCENT} * greatest(n_x, n_y)"
        f" AND {100 + PERCENT} * least(n_x - place_x, n_y - place_y) >= {PERCENT} * (n_x + n_y)"
    )
    out = common.cut(common.few(met.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct(), docs, EACH))
    common.free(ids, tokens, early, most)
    return out


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two ascending arrays of distinct shingles are similar enough."""
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in common.blocks(batches, "text"):
        h, texts, _, _ = shingles(*common.raw(block.column(1)))
        edges = np.searchsorted(texts, np.arange(block.num_rows + 1))
        yield pa.RecordBatch.from_arrays([block.column(0), pa.array([h[edges[k] : edges[k + 1]].tobytes() for k in range(block.num_rows)], pa.binary())], names=["id", "shingles"])


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = [_linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(stay, pa.bool_()))

    return run


def _sets_in(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the rows of ``texts`` (id, text) whose id is in ``ids``."""
    return texts.join(ids.hint("merge"), "id", "left_semi").mapInArrow(_sets, "id bigint, shingles binary")


def confirm(pairs: DataFrame, texts: DataFrame, docs: int, percent: int = PERCENT) -> DataFrame:
    """The candidate pairs (a, b) that the full sets of ``texts`` (id, text) confirm."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = common.cut(common.few(_sets_in(texts, ids), docs, EACH))
    met = pairs.join(sets.toDF("a", "x").hint("merge"), "a").join(sets.toDF("b", "y").hint("merge"), "b").select("a", "b", "x", "y")
    out = common.cut(common.few(met.mapInArrow(_confirmed(percent), "a bigint, b bigint").distinct(), docs, EACH))
    common.free(sets)
    return out


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, component) of every row of ``docs``."""
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    signed = common.cut(texts.mapInArrow(_signed, "id bigint, n bigint, fp1 bigint, fp2 bigint, bands array<bigint>, sig binary"))
    reps = signed.filter("n > 0 AND id IS NOT NULL").groupBy("fp1", "fp2").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.min_by("bands", "id").alias("bands"), F.min_by("sig", "id").alias("sig"))
    rows = signed.count()
    put = lambda df: common.cut(common.few(df, rows, EACH))
    reps = put(reps)
    sigs = reps.select(F.col("rep").alias("id"), "sig")
    members = reps.select(F.col("rep").alias("id"), F.explode("bands").alias("bucket"))
    found, level, pending, exact = None, 0, [], None
    while True:
        lead = [F.min("id").alias("centre"), F.count("*").alias("m")] + ([F.min_by("comp", "id").alias("d")] if level else [])
        centres = members.groupBy("bucket").agg(*lead).filter("m > 1")
        met = members.join(centres.hint("rebalance").hint("merge"), "bucket").filter("id <> centre")
        met = put(met if level else met.withColumns({"comp": F.col("id"), "d": F.col("centre")}))
        tested = met.filter("comp <> d").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
        likely = tested.join(sigs.toDF("a", "x").hint("merge"), "a").join(sigs.toDF("b", "y").hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(_pruned, "a bigint, b bigint")
        likely = put(likely)
        edges = confirm(likely, texts, rows)
        last, found = found, graph.merged(found, edges)
        common.free(members, likely, edges)

        # buckets whose members are not all connected yet; their stars are compared already
        rest = met.filter("m > 2").select("bucket", "id", "comp")
        if found is not last:
            rest = with_component(rest.select("bucket", "id"), found)
        sizes = rest.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("size")).filter("c0 < c1")
        sizes = sizes.select("bucket", (F.col("size") <= BLOCK).alias("small"))
        unsettled = put(rest.join(sizes.hint("merge"), "bucket"))
        large = unsettled.filter("NOT small").drop("small")
        if level == 0:  # pairs of later levels are among the members of this one's large buckets
            pending.append(across(unsettled.filter("small").drop("small"), texts, rows))
            # finer buckets only where the exact join has too much to do
            first, known, kept, some = large, found, unsettled, not large.isEmpty()
            exact = remaining(large, texts, rows, MEETS) if some else None
        common.free(met)
        if level == len(FINER) or exact is not None or large.isEmpty():
            break
        members = put(with_component(finer(large, sigs, level), found))
        if unsettled is not kept:
            common.free(unsettled)
        level += 1
    if unsettled is not kept:
        common.free(unsettled)
    if some:
        pending.append(remaining(first if found is known else with_component(first.select("bucket", "id"), found), texts, rows) if exact is None else exact)
    more = reduce(DataFrame.unionByName, pending).distinct() if len(pending) > 1 else pending[0]
    edges = confirm(more, texts, rows)
    found = graph.merged(found, edges)
    common.free(kept, edges, *pending)

    ranked = reps.select("fp1", "fp2", "rep").join(found.toDF("rep", "component"), "rep", "left").select("fp1", "fp2", F.coalesce("component", "rep").alias("component")).hint("rebalance")
    out = signed.select("id", "n", "fp1", "fp2").join(ranked, ["fp1", "fp2"], "left")
    alone = (F.col("n") == 0) | F.col("id").isNull()
    return out.select("id", "n", F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component"))


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of ``documents``."""
    out = classes(common.read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose class has a smaller id; rows that repeat an id share its fate."""
    gone = classes(docs, key, text).filter("component < id").select(F.col("id").alias("_gone")).distinct()
    return docs.join(gone, F.col(key).cast("long") == F.col("_gone"), "left_anti")


def oracle_sql() -> str:
    return r"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    p AS (SELECT doc_id, ws, unnest(CASE WHEN len(ws) >= 5 THEN range(1, len(ws) - 3) WHEN len(ws) > 0 THEN [1] ELSE []::BIGINT[] END) AS i FROM d),
    s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM p),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
    r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.root = l.a),
    m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
    """
