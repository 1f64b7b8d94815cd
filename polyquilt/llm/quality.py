r"""Quality rules: a threshold table compiled into Spark projections, without user functions.

Words are ``[^\x20\x09-\x0D]+`` and lines what lies between ``\n``; a line counts if it
has a word.  Each rule compares two integer expressions over a document's counts, so
both sides are exact.  null and empty texts have no words and fail the base rules;
very long texts take the same path (all steps are linear or n log n in the words);
repeated rows are judged each by itself, and equal ones alike; an empty table gives an
empty table; columns besides key and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquilt.llm import common

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

#: Common function words of English, German, French and Spanish, in lower case.
STOP_WORDS = (
    "the of and to in is that it was for be by with on are this an as at or from "
    "der die das und den dem von zu ist mit ein eine auf für nicht sich "
    "le la les de des du et un une que qui pour par sur au en "
    "el los las y con del por se no lo su"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails if ``times_left * left > times_right * right``; both sides are names of counts."""

    name: str
    times_left: int
    left: str
    times_right: int
    right: str


#: Fails of these make ``base_failed``.
BASE = (
    Rule("too_few_words", 50, "one", 1, "n_words"),
    Rule("repeated_windows", 100, "n_repeat_words", 50, "n_words"),
)
#: The method's own verdict.
RULES = (
    Rule("symbol_ratio", 10, "n_symbols", 1, "n_words"),
    Rule("short_words", 3, "n_words", 1, "word_chars"),
    Rule("long_words", 1, "word_chars", 10, "n_words"),
    Rule("repeated_lines", 100, "n_dup_lines", 50, "n_lines"),
    Rule("stop_words", 8, "n_words", 100, "n_stop_words"),
    Rule("bullet_lines", 100, "n_bullet_lines", 90, "n_lines"),
    Rule("ellipsis_lines", 100, "n_ellipsis_lines", 30, "n_lines"),
)


def _fails(rules: tuple[Rule, ...]) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | (F.lit(r.times_left).cast("long") * F.col(r.left) > F.lit(r.times_right).cast("long") * F.col(r.right))
    return out


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts that rules can name; its own columns should not clash (see ``judge``)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_words", F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)))
    out = out.withColumn("_lines", F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD)))
    stop = r"(?<![^\x20\x09-\x0D])(?:" + "|".join(STOP_WORDS) + r")(?![^\x20\x09-\x0D.,])"
    out = out.withColumns(
        {
            "one": F.lit(1).cast("long"),
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.regexp_replace(whole, r"[\x20\x09-\x0D]+", "")).cast("long"),
            "n_symbols": F.regexp_count(whole, F.lit(SYMBOL)).cast("long"),
            "n_stop_words": F.regexp_count(whole, F.lit(stop)).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_bullet_lines": F.size(F.filter("_lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).cast("long"),
            "n_ellipsis_lines": F.size(F.filter("_lines", lambda x: x.rlike(r"(?:\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long"),
            # 3-word windows as (fingerprint, place), sorted: equal windows stand side by side
            "_windows": F.when(
                F.size("_words") > 2,
                F.sort_array(F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.struct(F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i")))),
            ),
        }
    )
    out = out.withColumn("_twice", F.sort_array(F.transform(F.filter("_windows", lambda x, i: (F.get("_windows", i - 1)["h"] == x["h"]) | (F.get("_windows", i + 1)["h"] == x["h"])), lambda x: x["i"])))
    # each repeated window adds the words up to the next repeated one, three at most
    gaps = F.transform("_twice", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("_twice", i + 1) - x, F.lit(3))))
    out = out.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")))
    return out.drop("_words", "_lines", "_windows", "_twice")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row."""
    out = measure(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text")
    base = out.withColumn("base_failed", _fails(BASE))
    return base.select(F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~_fails(RULES)).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass all rules, with the columns they came with."""
    own = {c: f"_own{k}" for k, c in enumerate(docs.columns)}
    # the filter must not sink below the projections that it needs, where each would be written out and evaluated many times
    stays = F.monotonically_increasing_id() >= 0
    judged = measure(docs.toDF(*own.values()), own[text]).withColumn("_stays", ~_fails(BASE) & ~_fails(RULES) & stays)
    return judged.filter("_stays").select(*own.values()).toDF(*own)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the rules over every whole text of ``documents``."""
    return judge(common.read(spark, sf_dir, "documents"))


def _sql_fails(rules: tuple[Rule, ...]) -> str:
    return " OR ".join(f"{r.times_left} * {r.left} > {r.times_right} * {r.right}" for r in rules)


def oracle_sql() -> str:
    space = r"[\x20\x09-\x0D]"
    stop = "'" + "','".join(STOP_WORDS) + "'"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
    g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
    r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1) GROUP BY rid),
    m AS (
      SELECT doc_id, 1 AS one, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{space}+', '', 'g'))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '{SYMBOL}'))::BIGINT AS n_symbols, len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(ws, lambda x: regexp_extract(x, '^([^.,]+)', 1) IN ({stop}))) AS n_stop_words,
        len(list_filter(ls, lambda x: regexp_matches(x, '^{space}*[-*\x{{2022}}]'))) AS n_bullet_lines,
        len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}}){space}*$'))) AS n_ellipsis_lines
      FROM w LEFT JOIN r USING (rid))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({_sql_fails(BASE)}) AS base_failed, NOT ({_sql_fails(BASE)}) AND NOT ({_sql_fails(RULES)}) AS kept FROM m
    """
