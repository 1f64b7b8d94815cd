r"""URL filters: allow and block rules, and a character language-model ratio where no rule fits.

Two variable-order Markov models (contexts of 0 to 2 characters, interpolated from
the shorter to the longer with ``BETA`` pseudo-counts) are counted over all accepted
and all rejected URLs outside the held-out fold.  A URL's score is the difference of
its log-likelihoods divided by its length, as an integer number of micro-nats, so
sums do not depend on their order.  The threshold is calibrated on the held-out fold:
where the balanced accuracy is best, in the middle of the scores between which it stays
so: on a grid of ``GRID`` micro-nats, halfway between the last bin to block and the first
to allow.  Whole hosts are held out, so that no URL is judged by its siblings.

Characters are mapped to a fixed alphabet (a-z, one digit sign, RFC 3986 marks, one
sign for the rest), so the model has at most ``len(alphabet) ** 3`` entries whatever
the input: that bound is why it may be broadcast.

All steps are DataFrame expressions.  null URLs and URLs without ``://`` have an empty
host and path, no rule, and are judged by the model ('' scores 0); repeated rows are
judged alike; a URL of any length is scored whole, in one group of its own characters;
scores that tie with the threshold allow; without any labelled URL the threshold is 0 and
every score 0, which means allow; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquilt.llm import common

BETA = 4
GRID = 10_000
HELD_OUT = ("0", "1", "2")


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("net", "/", False),
    UrlRule("example.net", "/en/", True),
    UrlRule("example.com", "/de/", False),
    UrlRule("org", "/fr/", True),
)
_ASCII_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*://([^/?#]*)", 1)
    return F.translate(found, *_ASCII_LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*://[^/?#]*(/[^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> tuple[Column, Column]:
    """The name of the longest rule that fits, else null, and whether it allows."""
    name, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, allow = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.allow)).otherwise(allow)
    return name, allow


def normal(url: Column) -> Column:
    """The URL over the model's alphabet, with two start signs in front."""
    low = F.translate(F.coalesce(url, F.lit("")), *_ASCII_LOWER)
    low = F.regexp_replace(low, r"[0-9]", "0")
    return F.concat(F.lit("^^"), F.regexp_replace(low, r"[^a-z0\-._~:/?#\[\]@!$&'()*+,;=%]", "^"))


def grams(df: DataFrame, *keep: str) -> DataFrame:
    """One row for each character of ``u`` with the two before it; an empty URL has none.

    The alphabet is ASCII, so bytes are characters and a gram is cut without a walk from the URL's start.
    """
    places = F.when(F.length("u") > 2, F.sequence(F.lit(1), F.length("u") - 2))
    own = df.select(*keep, F.col("u").cast("binary").alias("u"), F.explode(places).alias("i"))
    return own.select(*keep, F.substring(F.col("u"), F.col("i"), F.lit(3)).cast("string").alias("g"))


def model(counts: DataFrame) -> DataFrame:
    """(g, score) from (g, yes, no): micro-nats that the last character of g adds to the ratio."""
    size = 53  # signs of the alphabet
    c, ctx1, ctx2 = F.substring("g", 3, 1), F.substring("g", 2, 1), F.substring("g", 1, 2)
    rows = counts.withColumns({"c": c, "x1": ctx1, "x2": ctx2})
    tables = {
        "0": rows.groupBy("c").agg(*[F.sum(s).alias(f"c0_{s}") for s in ("yes", "no")]),
        "1": rows.groupBy("x1", "c").agg(*[F.sum(s).alias(f"c1_{s}") for s in ("yes", "no")]),
        "x1": rows.groupBy("x1").agg(*[F.sum(s).alias(f"n1_{s}") for s in ("yes", "no")]),
        "x2": rows.groupBy("x2").agg(*[F.sum(s).alias(f"n2_{s}") for s in ("yes", "no")]),
    }
    total = rows.groupBy().agg(*[F.sum(s).alias(f"n0_{s}") for s in ("yes", "no")]).withColumn("k", F.lit(1))
    out = rows.join(tables["0"], "c").join(tables["1"], ["x1", "c"]).join(tables["x1"], "x1").join(tables["x2"], "x2").withColumn("k", F.lit(1)).join(F.broadcast(total), "k")
    logs = {}
    for s in ("yes", "no"):
        p0 = (F.col(f"c0_{s}") + F.lit(BETA / size)) / (F.col(f"n0_{s}") + BETA)
        p1 = (F.col(f"c1_{s}") + BETA * p0) / (F.col(f"n1_{s}") + BETA)
        logs[s] = F.log((F.col(s) + BETA * p1) / (F.col(f"n2_{s}") + BETA))
    return out.select("g", F.round((logs["yes"] - logs["no"]) * 1_000_000).cast("long").alias("score"))


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """(key, host, path, rule, verdict, score) of every row; score is null where a rule judges."""
    own = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"))
    own = own.withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    name, allow = best_rule(F.col("host"), F.col("path"), rules)
    own = own.withColumns({"rule": name, "by_rule": allow, "u": normal(F.col("_url"))}).withColumn("uid", F.md5("u"))
    own = own.withColumn("held", F.substring(F.md5("host"), 1, 1).isin(*HELD_OUT))

    # counts over all URLs; a gram that only unjudged URLs have counts 0 on both sides
    train = ~F.col("held")
    counts = grams(own.withColumns({"yes": (train & F.coalesce("by_rule", F.lit(False))).cast("long"), "no": (train & ~F.coalesce("by_rule", F.lit(True))).cast("long")}), "yes", "no")
    counts = counts.groupBy("g").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    scores = common.cut(model(counts))

    def score(urls: DataFrame) -> DataFrame:
        """(uid, llr): each distinct URL's score by its length; its digest stands for it, as a long URL has as many grams."""
        summed = grams(urls.select("uid", "u").distinct(), "uid").join(F.broadcast(scores), "g").groupBy("uid").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
        return summed.select("uid", F.floor(F.col("s") / F.col("n")).cast("long").alias("llr"))

    scored = common.cut(score(own.filter(F.col("by_rule").isNull() | F.col("held"))))
    checked = own.filter(F.col("held") & F.col("by_rule").isNotNull()).join(scored, "uid")
    bins = checked.groupBy(F.floor(F.col("llr") / GRID).alias("b")).agg(F.sum(F.col("by_rule").cast("long")).alias("y"), F.sum((~F.col("by_rule")).cast("long")).alias("n"))
    threshold = best_threshold([(r["b"], r["y"], r["n"]) for r in bins.collect()])  # at most 2 * 20e6 / GRID bins: a log ratio of characters is bounded
    llr = F.coalesce(F.col("llr"), F.lit(0))
    judged = own.join(scored, "uid", "left").withColumn("allowed", F.coalesce("by_rule", llr >= threshold))
    return judged.select(F.col("_key").alias(key), "host", "path", "rule", F.when(F.col("allowed"), "allow").otherwise("block").alias("verdict"), F.when(F.col("by_rule").isNull(), llr).alias("score"))


def best_threshold(bins: list[tuple[int, int, int]]) -> int:
    """From (bin, accepted, rejected): the middle of the first gap between bins that splits them best.

    Where blocking or allowing all is best, the threshold is one bin beyond them.
    """
    yes, no = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not yes or not no:
        return 0
    best, threshold = -1, 0
    below_yes = below_no = 0
    last = None
    for b, y, n in sorted(bins):
        right = (yes - below_yes) * no + below_no * yes
        if right > best:
            best, threshold = right, (b * GRID if last is None else (last + 1 + b) * GRID // 2)
        below_yes, below_no, last = below_yes + y, below_no + n, b
    if no * yes > best:
        threshold = (last + 1) * GRID
    return int(threshold)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every url of ``pages``."""
    return judge(common.read(spark, sf_dir, "pages").select("page_id", "url"))


def oracle_sql(rules: tuple[UrlRule, ...] = RULES) -> str:
    fits = {r: f"(host = '{r.host}' OR suffix(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in sorted(rules, key=lambda r: -len(r.name))}
    name = "CASE " + " ".join(f"WHEN {c} THEN '{r.name}'" for r, c in fits.items()) + " END"
    allow = "CASE " + " ".join(f"WHEN {c} THEN {str(r.allow).lower()}" for r, c in fits.items()) + " END"
    upper, lower = _ASCII_LOWER
    odds = lambda s: f"ln((t.{s} + {BETA} * ((c1.{s} + {BETA} * ((c0.{s} + {BETA / 53!r}) / (n.{s} + {BETA}))) / (x1.{s} + {BETA}))) / (x2.{s} + {BETA}))"
    sums = "sum(yes)::DOUBLE AS yes, sum(no)::DOUBLE AS no"
    return rf"""
    WITH p AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS s FROM pages),
    h AS (SELECT *, CASE WHEN s > 0 THEN substr(url, s + 3) ELSE '' END AS rest FROM p),
    k AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM h),
    own AS (SELECT *, {name} AS rule, {allow} AS by_rule, substr(md5(host), 1, 1) IN {HELD_OUT} AS held,
      '^^' || regexp_replace(regexp_replace(translate(url, '{upper}', '{lower}'), '[0-9]', '0', 'g'), '[^a-z0\-._~:/?#\[\]@!$&''()*+,;=%]', '^', 'g') AS u FROM k),
    g AS (SELECT u, substr(u, i, 3) AS g, yes, no FROM (SELECT u, unnest(range(1, length(u) - 1)) AS i, (NOT held AND coalesce(by_rule, false))::INT AS yes, (NOT held AND NOT coalesce(by_rule, true))::INT AS no FROM own)),
    t AS (SELECT g, substr(g, 3, 1) AS c, substr(g, 2, 1) AS a, substr(g, 1, 2) AS ba, {sums} FROM g GROUP BY g),
    c0 AS (SELECT c, {sums} FROM t GROUP BY c), c1 AS (SELECT a, c, {sums} FROM t GROUP BY a, c), x1 AS (SELECT a, {sums} FROM t GROUP BY a), x2 AS (SELECT ba, {sums} FROM t GROUP BY ba), n AS (SELECT {sums} FROM t),
    score AS (SELECT t.g, round(({odds("yes")} - {odds("no")}) * 1000000)::BIGINT AS score FROM t JOIN c0 USING (c) JOIN c1 USING (a, c) JOIN x1 USING (a) JOIN x2 USING (ba), n),
    llr AS (SELECT u, floor(sum(score) / count(*))::BIGINT AS llr FROM (SELECT u, unnest(range(1, length(u) - 1)) AS i FROM (SELECT DISTINCT u FROM own)) JOIN score ON score.g = substr(u, i, 3) GROUP BY u),
    bins AS (SELECT floor(llr / {GRID}) AS b, count(*) FILTER (by_rule) AS y, count(*) FILTER (NOT by_rule) AS n FROM own JOIN llr USING (u) WHERE held AND by_rule IS NOT NULL GROUP BY b),
    cuts AS (SELECT b, sum(y) OVER () AS yes, sum(n) OVER () AS no, coalesce(sum(y) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS byes, coalesce(sum(n) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bno FROM bins),
    ranked AS (SELECT b, (lag(b) OVER (ORDER BY b)) AS a, (yes - byes) * no + bno * yes AS hits FROM cuts WHERE yes > 0 AND no > 0 UNION ALL SELECT max(b) + 1, NULL, max(no) * max(yes) FROM cuts WHERE yes > 0 AND no > 0),
    threshold AS (SELECT coalesce((SELECT CASE WHEN a IS NULL THEN b * {GRID} ELSE floor((a + 1 + b) * {GRID} / 2) END FROM ranked WHERE hits IS NOT NULL ORDER BY hits DESC, b LIMIT 1), 0) AS least)
    SELECT page_id, host, path, rule, CASE WHEN coalesce(by_rule, coalesce(llr, 0) >= least) THEN 'allow' ELSE 'block' END AS verdict, CASE WHEN by_rule IS NULL THEN coalesce(llr, 0) END AS score
    FROM own LEFT JOIN llr USING (u), threshold
    """
