r"""Spelling variants: pairs of words at exactly one edit, found through positional q-gram postings.

Two words s, t within one inserted, deleted or replaced code point share at least
``max(len) - Q + 1 - Q`` of their positional q-grams, at places that differ by no more than
their lengths, and their lengths differ by one at most.  A task holds an inverted index
(gram, place) -> word numbers; each word merges the shortest postings of its grams by a heap,
looks the others up by bisection, and keeps partners above the bound; these are then verified.

An index is *anchored*: its words have one length, and equal letters outside a window of
places that holds the edit.  One edit leaves the first or the second half of a word as it
was, so two anchors for each length (and for words longer by one) bring every pair together.
Where an anchor holds more than ``GROUP`` words, their windows are halved again, down to one
letter, so a hot prefix or suffix (an anchor of a third of all words, say) is split by its
own letters without loss; at a window of one letter a group's size is bounded by the square
of the alphabet.  A pair that several anchors hold is given by one of them only: the window
that its common prefix leads to.

Defined results: a null text has no words; a null id counts as an empty one in the hash that
picks letters to delete; repeated rows count as often as they stand; words are compared by
code points; ties between forms go to the smaller word; very long runs are words like others;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquilt.llm import common
from polyquilt.llm.merkle import sql_crc32

#: Letters of a gram, and the least code points of a word.
Q = 2
LEAST = 7
#: An occurrence loses a letter if this divides its hash.
DELETE_EVERY = 31
#: A form has so many times the occurrences of its variant.
TIMES = 10
#: Words of one anchored index, at most.
GROUP = 4096
#: Letters of the distinct words that a counting task keeps before it passes them on.
HELD_LETTERS = 4_000_000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


# --- words ---


def _count(key: str, text: str, least: int, every: int | None):
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")  # shorter runs give no word

    def flush(found: dict[str, int]) -> pa.RecordBatch:
        return pa.record_batch({"word": pa.array(found.keys(), pa.string()), "n": pa.array(found.values(), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, int] = {}
        letters = 0
        for block in common.blocks(batches, text):
            at = {name: block.column(block.schema.get_field_index(name)) for name in (key, text)}
            for doc, whole in zip(at[key].to_pylist(), at[text].to_pylist()):
                if not whole:
                    continue
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(runs.findall(whole.encode().translate(_LOWER).decode())).items():
                    if every and (h := zlib.crc32(word.encode(), start)) % every == 0:
                        place = h % len(word)
                        word = word[:place] + word[place + 1 :]
                        if len(word) < least:
                            continue
                    if word in found:
                        found[word] += n
                    else:
                        found[word] = n
                        letters += len(word) + 16
                if letters > HELD_LETTERS:
                    yield flush(found)
                    found, letters = {}, 0
        if found:
            yield flush(found)

    return run


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, least_n: int = 2, every: int | None = DELETE_EVERY) -> DataFrame:
    """(word, n): lower-cased runs of letters with ``least`` code points or more, and how often they occur (``least_n`` times or more).

    Of occurrences whose hash with the document's id ``every`` divides, one letter is deleted
    (None: of none).  Tasks count before the shuffle.
    """
    own = common.no_clash(docs, key, text)
    counted = own.mapInArrow(_count(key, text, least, every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


# --- anchored indexes ---


def one_edit(s: str, t: str) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced code point."""
    if len(s) > len(t):
        s, t = t, s
    if len(t) - len(s) > 1 or s == t:
        return False
    at = common_prefix(s, t)
    return s[at + (len(s) == len(t)) :] == t[at + 1 :]


def common_prefix(s: str, t: str) -> int:
    at = 0
    for a, b in zip(s, t):
        if a != b:
            break
        at += 1
    return at


def grams(word: str) -> list[str]:
    return [word[i : i + Q] for i in range(len(word) - Q + 1)]


def bound(a: int, b: int) -> int:
    """Positional grams that words of ``a`` and ``b`` letters at one edit share at least."""
    return max(a, b) - Q + 1 - Q


def overlapping(postings: list[list[int]], need: int) -> Iterator[int]:
    """Numbers that stand in at least ``need`` (1 or more) of the ascending ``postings``: a heap merges the short ones, the ``need - 1`` longest are bisected."""
    postings = sorted(filter(None, postings), key=len)
    if len(postings) < need:
        return
    cut = len(postings) - need + 1
    short, long = postings[:cut], postings[cut:]
    for number, run in groupby(short[0] if len(short) == 1 else heapq.merge(*short)):
        have = sum(1 for _ in run)
        for left, p in zip(range(len(long), 0, -1), long):
            if have >= need or have + left < need:
                break
            at = bisect_left(p, number)
            have += at < len(p) and p[at] == number
        if have >= need:
            yield number


def near_in(words: list[str], longer: list[str]) -> Iterator[tuple[int, int, bool]]:
    """(a, b, False) for words a < b of one length at one edit, (a, c, True) for ``longer[c]`` with one letter more than word a."""
    index: dict[tuple[str, int], list[int]] = {}
    length = len(words[0])
    for number, word in enumerate(words):
        own = [index.setdefault((g, p), []) for p, g in enumerate(grams(word))]  # a replaced letter moves no gram
        need = bound(length, length)
        for other in overlapping(own, need) if need > 0 else range(number):
            if one_edit(words[other], word):
                yield other, number, False
        for p in own:
            p.append(number)
    need = bound(length, length + 1)
    none: list[int] = []
    for number, word in enumerate(longer):
        lists = []
        for place, g in enumerate(grams(word)):  # an inserted letter moves grams by one at most
            here, before = index.get((g, place), none), index.get((g, place - 1), none)
            lists.append(list(heapq.merge(here, before)) if here and before else here or before)
        for other in overlapping(lists, need) if need > 0 else range(len(words)):
            if one_edit(words[other], word):
                yield other, number, True


#: An anchored row: window [head, size - tail) of words of ``size`` letters; ``anchor`` is a hash of all that fixes it.
_ROW = "anchor long, size int, head int, tail int, word string, n long"


def _anchored(rows: DataFrame) -> DataFrame:
    letters = F.length("word")
    ends = F.struct(F.substring("word", F.lit(1), F.col("head")).alias("a"), F.when(F.col("tail") > 0, F.substring("word", letters - F.col("tail") + 1, F.col("tail"))).otherwise("").alias("b"))
    return rows.withColumn("_e", ends).select(F.xxhash64("size", "head", "tail", "_e.a", "_e.b").alias("anchor"), "size", "head", "tail", "word", "n")


def _halved(rows: DataFrame) -> DataFrame:
    """Each row's window [head, size - tail) as its two halves."""
    half = F.floor((F.col("size") - F.col("head") - F.col("tail")) / 2).cast("int")
    two = F.array(F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail")), F.struct(F.col("head").alias("head"), (F.col("size") - F.col("head") - half).alias("tail")))
    return _anchored(rows.withColumn("_w", F.explode(two)).select("size", "_w.head", "_w.tail", "word", "n"))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word of a run of equal anchors: how many near words it has there, and the best of them."""
    held: list[tuple] = []

    def solve(run: list[tuple]) -> Iterator[tuple]:
        _, size, head, tail, _, _ = run[0]
        words = [(r[4], r[5]) for r in run if len(r[4]) == size]
        longer = [(r[4], r[5]) for r in run if len(r[4]) > size]
        if not words or len(run) < 2:
            return
        counts: dict[str, list] = {}
        for a, b, more in near_in([w for w, _ in words], [w for w, _ in longer]):
            (s, n), (t, m) = words[a], (longer if more else words)[b]
            same = common_prefix(s, t)
            # only the window that the common prefix leads to gives the pair; equal hashes of other anchors are no anchor
            if same < head or (tail and (same >= size - tail or s[size - tail :] != t[len(t) - tail :])):
                continue
            for word, best in ((s, (-m, t)), (t, (-n, s))):
                if word in counts:
                    c = counts[word]
                    c[0] += 1
                    c[1] = min(c[1], best)
                else:
                    counts[word] = [1, best]
        for word, (near, (less, best)) in counts.items():
            yield word, near, -less, best

    def out(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * 4
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "best_n", "best"])

    found: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][:4] != row[:4]:
                if len(held) > 1:
                    found += solve(held)
                held = []
            held.append(row)
        if found:
            yield out(found)
            found = []
    if len(held) > 1:
        yield out(list(solve(held)))


def near(words: DataFrame, group: int | None = None) -> DataFrame:
    """(word, n_near, best_n, best): for distinct ``words`` (word, n) with near ones, partial counts and the best near word of each part.

    Add up ``n_near`` and take the least (-best_n, best) for each word.
    """
    group = group or GROUP
    letters = F.length("word")
    sizes = F.explode(F.array(letters, letters - 1))  # as one of its length, and as one letter longer than others
    whole = words.withColumn("size", sizes).filter("size >= 1").select("size", F.lit(0).alias("head"), F.lit(0).alias("tail"), "word", "n")
    rows, parts = _halved(whole), []
    while True:
        hot = rows.filter("size - head - tail > 1").groupBy("anchor").agg(F.count("*").alias("_n")).filter(F.col("_n") > group).select("anchor")
        hot = common.cut(hot, sweep=False)
        if hot.isEmpty():
            parts.append(rows)
            break
        # a window of one letter stays as it is: its anchor may not be hot by its own rows
        narrow = F.col("size") - F.col("head") - F.col("tail") <= 1
        marked = rows.join(hot.withColumn("_hot", F.lit(True)), "anchor", "left").withColumn("_hot", F.col("_hot").isNotNull() & ~narrow)
        marked = common.cut(marked, sweep=False)
        parts.append(marked.filter("NOT _hot").drop("_hot"))
        rows = _halved(marked.filter("_hot").drop("_hot"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    order = ("anchor", "size", "head", "tail", "word")
    return whole.repartition("anchor").sortWithinPartitions(*order).mapInArrow(_neighbours, "word string, n_near long, best_n long, best string")


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct ``words`` (word, n).

    A word's form is its most frequent near word (ties: the smaller) where that occurs
    ``TIMES`` as often or more; its root is where forms lead.  Occurrences grow tenfold with
    each step, so chains are short; pointers are doubled until none moves.
    """
    words = common.cut(words)
    found = near(words).unionByName(words.select("word", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best")))
    best = F.min(F.when(F.col("best_n").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))))
    each = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b")).join(words.hint("merge"), "word")
    form = F.when(-F.col("_b.less") >= F.col("n") * TIMES, F.col("_b.best"))
    each = common.cut(each.select("word", "n", "n_near", form.alias("form"), F.when(form.isNotNull(), -F.col("_b.less")).alias("form_n")))
    steps = common.cut(each.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), sweep=False)
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = common.cut(steps.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), sweep=False)
        common.free(steps)
        steps = moved.select("word", "root")
        steps._cut_path = moved._cut_path
        if moved.filter("_moved").isEmpty():
            break
    out = each.join(steps.hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their forms and roots."""
    return variants(vocabulary(common.read(spark, sf_dir, "documents")))


def oracle_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
    WITH RECURSIVE r AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), '{upper}', '{lower}') AS w FROM documents),
    o AS (SELECT w, count(*) AS c, d || ':' || w AS k FROM r WHERE length(w) >= {LEAST} GROUP BY d, w),
    h AS (SELECT w, c, {sql_crc32('k')} AS h FROM o),
    v AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM (SELECT CASE WHEN h % {DELETE_EVERY} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM h)
      WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(c) >= 2),
    x AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
    e AS (SELECT DISTINCT a.word AS a, b.word AS b FROM x a JOIN x b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
      UNION SELECT x.word, v.word FROM x JOIN v ON x.less = v.word UNION SELECT v.word, x.word FROM x JOIN v ON x.less = v.word),
    p AS (SELECT e.a, e.b, v.n, row_number() OVER (PARTITION BY e.a ORDER BY v.n DESC, e.b) AS place, count(*) OVER (PARTITION BY e.a) AS n_near FROM e JOIN v ON e.b = v.word),
    f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN p.n >= {TIMES} * v.n THEN p.b END AS form, CASE WHEN p.n >= {TIMES} * v.n THEN p.n END AS form_n FROM v LEFT JOIN p ON p.a = v.word AND place = 1),
    c AS (SELECT word, word AS here, 0 AS step FROM f UNION ALL SELECT c.word, f.form, step + 1 FROM c JOIN f ON c.here = f.word WHERE f.form IS NOT NULL)
    SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, max_by(here, step) AS root FROM c GROUP BY word) USING (word)
    """
