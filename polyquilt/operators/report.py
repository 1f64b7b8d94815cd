"""A7, A16, F3, F18, F20, F61, F63, F64, K14, O7, O9-O11, S14, S16 and W2 over the engine's results or any relation like them.

Null keys form a group of their own, as in ``groupBy``; null texts and numbers give null; an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquilt.functions import catalog
from polyquilt.operators import analytics as A
from polyquilt.operators.tables import dropped, written

#: The lines of a run's log that state its phases.
SOLVER_LINE = r"^Solver phase:\s*([0-9.]+)s(?:\s*\(([0-9]+) partials)?"
PRUNER_LINE = r"^Pruner phase:\s*([0-9.]+)s"


def result_members(found: DataFrame) -> DataFrame:
    """(k, id, member): the base configurations of each unique result, one row a vertex; the id is the canonical code."""
    names = catalog.type_table(found.sparkSession).select(F.col("type_id").alias("t"), F.regexp_extract("symbol", A.BASE, 0).alias("member"))
    return found.select("k", F.col("code").alias("id"), F.explode("types").alias("t")).join(F.broadcast(names), "t").select("k", "id", "member")


def base_set(signature: Column) -> Column:
    """the distinct configurations of a signature, sorted."""
    return F.array_sort(F.array_distinct(A.base_symbols(signature)))


def type_counts(types: Column, size: int) -> Column:
    """how often an array has each of 0 .. size - 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda t: F.size(F.filter(types, lambda x: x == t)))


def histograms(rows: DataFrame, size: int) -> DataFrame:
    """(histogram, n): rows with each histogram of members 0 .. size - 1, by conditional counts and so without lists."""
    own = rows.groupBy("k", "id").agg(F.array(*[F.count_if(F.col("member") == t) for t in range(size)]).alias("histogram"))
    return own.groupBy("histogram").agg(F.count("*").alias("n"))


def combo_number(combo: Column) -> Column:
    """the digits before the first underscore; null where a combo does not start so."""
    return F.regexp_extract(combo, r"^(\d+)_", 1).try_cast("int")


def size_signatures(rows: DataFrame) -> DataFrame:
    """(k, sizes, n): results of each polygon-size signature, which is what follows a combo's first underscore."""
    sizes = F.regexp_extract("combo", r"^\d+_(.*)$", 1)
    return rows.select(combo_number(F.col("combo")).alias("k"), sizes.alias("sizes")).groupBy("k", "sizes").agg(F.count("*").alias("n"))


def overall_top(rows: DataFrame, top: int) -> DataFrame:
    """The ``top`` members that most rows have, over all k; ties by name."""
    return A.frequency(rows).orderBy(F.desc("n"), "member").limit(top)


def reuse(rows: DataFrame) -> DataFrame:
    """A8 + A9: (k, total, entropy, top, n): rows of each k, their mean entropy, and how many have which highest multiplicity."""
    top = A.max_multiplicity(rows)
    totals = top.groupBy("k").agg(F.sum("n").alias("total"))
    return totals.join(A.mean_entropy(rows), "k").join(top, "k").select("k", "total", "entropy", "top", "n")


def distribution(rows: DataFrame) -> DataFrame:
    """(k, m1, m2, ..., total), up to the greatest m that occurs."""
    wide = A.histogram_pivot(rows)
    counts = [c for c in wide.columns if c != "k"]
    return wide.withColumn("total", sum((F.col(c) for c in counts), F.lit(0).cast("long")))


def report(members: DataFrame, combos: DataFrame) -> dict[str, DataFrame]:
    """The six tables of the report by name, whole; the growth of totals by k among them."""
    totals = members.groupBy("k").agg(F.count_distinct("id").alias("total"))
    return {
        "m_distribution": distribution(members),
        "multiplicity_profiles": A.profiles(members),
        "configuration_prevalence": A.prevalence(members).drop("place"),
        "polygon_signatures": size_signatures(combos),
        "reuse_statistics": reuse(members),
        "growth": A.growth(totals, "k", "total"),
    }


def write_report(members: DataFrame, combos: DataFrame, target: str) -> None:
    """Each table as a folder of CSV files with a header; an existing folder is an error.

    The inputs may be whole enumerations, so each is computed once, as a table.
    """
    own, found = written(members), written(combos.select("combo"))
    for name, rows in report(own, found).items():
        rows.write.option("header", True).csv(f"{target}/{name}")
    dropped(own, found)


def first_differences(a: DataFrame, b: DataFrame, top: int = 10) -> DataFrame:
    """Rows of one side only with their side, the first ``top`` of each side in the order of their columns."""
    one = lambda x, y, side: x.subtract(y).orderBy(*x.columns).limit(top).withColumn("side", F.lit(side))
    return one(a, b, "left").unionByName(one(b, a, "right"))


def delete(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``base`` whose key is not among ``keys``; null keys stay."""
    return base.join(keys.select(key), key, "left_anti")


def add_counts(counters: DataFrame, events: DataFrame, key: str, value: str) -> DataFrame:
    """Counters raised by the number of events of their key; a key that has none yet starts at zero."""
    new = events.groupBy(key).agg(F.count("*").alias("_more"))
    return counters.join(new, key, "full").select(key, (F.coalesce(value, F.lit(0)) + F.coalesce("_more", F.lit(0))).alias(value))


def seeded_pick(rows: DataFrame, key: str, seed: int, among: Column | None = None) -> DataFrame:
    """One row's key, of the rows that ``among`` allows (of a combo, say): the least by the MD5 of seed and key, and so the same in every engine and partitioning; none of no rows."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    own = rows if among is None else rows.filter(among)
    return own.agg(F.min(F.struct(draw, F.col(key).alias("key"))).alias("s")).filter("s IS NOT NULL").select(F.col("s.key").alias(key))


def at_most(rows: DataFrame, k_max: int) -> DataFrame:
    """O11."""
    return rows.filter(F.col("k") <= k_max)


def duration_text(seconds: Column) -> Column:
    """<1s, seconds, minutes and seconds, or hours and minutes."""
    s = F.floor(seconds).cast("long")
    text = lambda big, small, a, b: F.concat(F.floor(s / big).cast("string"), F.lit(a), F.floor(s % big / small).cast("string"), F.lit(b))
    return F.when(seconds < 1, "<1s").when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, text(60, 1, "m", "s")).when(s.isNotNull(), text(3600, 60, "h", "m"))


def count_text(n: Column) -> Column:
    """below ten thousand as it is, then whole thousands, then millions to one place, all cut."""
    whole = lambda d: F.floor(n / d).cast("long").cast("string")
    return F.when(n < 10_000, n.cast("long").cast("string")).when(n < 1_000_000, F.concat(whole(1000), F.lit("K"))).when(n.isNotNull(), F.concat(whole(1_000_000), F.lit("."), F.floor(n / 100_000 % 10).cast("long").cast("string"), F.lit("M")))


def rate_text(rate: Column) -> Column:
    """a second, in whole thousands from a thousand on."""
    return F.when(rate < 1000, F.concat(F.floor(rate).cast("long").cast("string"), F.lit("/s"))).when(rate.isNotNull(), F.concat(F.floor(rate / 1000).cast("long").cast("string"), F.lit("K/s")))


def byte_text(kib: Column) -> Column:
    """kibibytes as a count of bytes."""
    return F.concat(count_text(kib * 1024), F.lit("B"))


def lowest_bit(x: Column) -> Column:
    """F64: the place of the lowest set bit of a positive number, by the population count below it; null for zero."""
    return F.when(x != 0, F.bit_count(x.bitwiseAND(-x) - 1))


def combo_of_path(path: Column, prefix: str) -> Column:
    """a file's name without folders, ``prefix``, .zst and one more ending."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    name = F.when(name.startswith(prefix), F.substring(name, len(prefix) + 1, 1 << 30)).otherwise(name) if prefix else name
    return F.regexp_replace(F.regexp_replace(name, r"\.zst$", ""), r"\.[^.]*$", "")


def listing(spark: SparkSession, folder: str, glob: str, prefix: str = "") -> DataFrame:
    """(path, length, combo, number) of files that match; contents are not read, and ``number`` (the last digits of a name) sorts chunks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "length")
    return files.select("path", "length", combo_of_path(F.col("path"), prefix).alias("combo"), F.regexp_extract("path", r"([0-9]+)[^0-9/]*$", 1).try_cast("long").alias("number"))


def phase_times(logs: DataFrame) -> DataFrame:
    """Of (run, line): the phases' seconds and the partial count of each run; null seconds unless a phase is stated just once."""
    solver, pruner = F.regexp_extract("line", SOLVER_LINE, 1), F.regexp_extract("line", PRUNER_LINE, 1)
    once = lambda x, to: F.when(F.count_if(x != "") == 1, F.max(x.try_cast(to)))
    return logs.groupBy("run").agg(once(solver, "double").alias("solver"), once(pruner, "double").alias("pruner"), F.max(F.regexp_extract("line", SOLVER_LINE, 2).try_cast("long")).alias("partials"))
