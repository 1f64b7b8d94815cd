"""Benchmark decontamination: CGK embeddings, repeated bit sampling over item-sized windows, exact edit distance.

Texts are sequences of words: runs of letters and digits (every byte above ASCII
counts as a letter), A-Z lower-cased.  A document is contaminated by an item of n words
if some run of its words is within ``floor(EDITS_PERCENT * n / 100)`` word edits of it.

* The CGK embedding of a window walks over its words: at step j it writes the word it
  stands on and moves on if bit j of that word's fingerprint is set.  Windows a few
  edits apart fall into step again and so differ in few places.
* Repetition t has its own walk and writes a few sampled steps into one key.  Steps
  are sampled from the first ``width`` ones, where walks have lost each other least often.
* An item's windows have a width by its size.  All of them are indexed, a document's only at
  every ``STRIDE``-th word: an occurrence holds such a window whatever its place and edits.
  Items too short for that are indexed whole and met at every word.
* ``repetitions`` gives how many keys an item needs for the target recall: from the share of
  steps that agree at the full 20 % edits, measured for each width over deletions, insertions,
  replacements and mixtures (``AGREES``), and from the number of windows that each occurrence
  holds.  Long walks lose each other at so many edits, so the width is the widest of
  ``WIDTHS`` that needs at most ``MOST`` keys, or else the one that needs the fewest.
* A window with more words foreign to all items of its width than the least edited window
  of an occurrence may have edits is not embedded; every occurrence keeps such a window.
* Every hit is confirmed by exact word edit distance, for many hits at a time: a bit
  vector for each hit's column of the dynamic program, all moved by one word a step.
  Items of equal words are one.

The benchmark is read in blocks of ``BLOCK_ITEMS`` items and ``BLOCK_TEXT`` bytes; each
block's index, of a size these bound, is broadcast for one pass over the documents.

null and empty texts and items without a word match nothing; a very long text is
searched whole; repeated rows and items are judged alike, so ties give each of them; a null
id is carried along, ids may be of any type; no rows on either side give no matches; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from polyquilt.llm import common

EDITS_PERCENT = 20
STRIDE = 4
WIDTHS = (8, 12, 16, 24, 32, 64)
#: Steps in a key: of windows among others in an item, and of short items that are indexed whole.
SAMPLES, SAMPLES_WHOLE = 4, 2
MOST = 16
TARGET_RECALL = 0.999
#: Share of the first steps (as many as a window has words) at which two windows agree at 20 % edits, measured; by width.
AGREES = {8: 0.7, 12: 0.62, 16: 0.55, 24: 0.5, 32: 0.41, 64: 0.29}
BLOCK_ITEMS = 50_000
BLOCK_TEXT = 4 << 20

MARKS = np.zeros(256, bool)
MARKS[:128] = [not chr(b).isalnum() for b in range(128)]


def width_of(n: int, edits: int) -> tuple[int, int]:
    """Width and stride of the windows of an item of n words."""
    fit = {w: repetitions(n, edits, w, STRIDE) for w in WIDTHS if w <= n - edits - STRIDE + 1}
    if not fit:
        return n, 1
    few = [w for w, times in fit.items() if times <= MOST]
    return (max(few) if few else min(fit, key=fit.get)), STRIDE


def repetitions(n: int, edits: int, width: int, stride: int, recall: float = TARGET_RECALL) -> int:
    """Keys for an item of n words: that all windows of an occurrence miss in all of them is as rare as ``recall`` asks."""
    if not edits:
        return 1
    same = next((share for w, share in AGREES.items() if width <= w), min(AGREES.values()))
    windows = (n - edits - stride + 1 - width) // stride + 1 if stride > 1 else 1
    return math.ceil(math.log(1 - recall) / math.log(1 - same ** samples(width, stride)) / windows)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word fingerprints of the texts, and the texts' offsets into them."""
    data = common.LOWER[data]
    starts, ends, words = common.word_spans(data, offsets, MARKS)
    return common.word_hashes(data, starts, ends), words


_TIMES = np.uint64(0x9E3779B97F4A7C15)


def samples(width: int, stride: int) -> int:
    return min(width, SAMPLES if stride > 1 else max(SAMPLES_WHOLE, width // 4))


def sampled_steps(width: int, stride: int, t: int) -> np.ndarray:
    return np.sort(np.random.default_rng((width, stride, t, 7)).choice(width, samples(width, stride), replace=False))


def keys(words: np.ndarray, starts: np.ndarray, width: int, stride: int, t: int, walk: dict[int, np.ndarray]) -> np.ndarray:
    """Key of repetition t for the window of ``width`` words at each start; ``walk`` keeps the words' bits for other widths.

    A walk is never further than its step, so within the window for all sampled steps.
    """
    steps = sampled_steps(width, stride, t)
    at = starts.copy()
    out = np.full(len(starts), np.uint64((width << 16) + (stride << 10) + t), np.uint64)
    for j in range(int(steps[-1]) + 1):
        if j in steps:
            out = (out ^ words[at]) * _TIMES
        if j < steps[-1]:
            if t not in walk:
                walk[t] = common.mix(words + np.uint64(1_000_003 * t + 1))
            at += ((walk[t][at] >> np.uint64(j)) & np.uint64(1)).astype(np.int64)
    return out ^ (out >> np.uint64(29))


class Sieve:
    """Sorted keys with a table of bits in front: most keys that are not there are told apart by one look."""

    def __init__(self, key: np.ndarray):
        self.key = key
        self.mask = np.uint64((1 << max(10, min(24, int(8 * len(key)).bit_length()))) - 1)
        self.there = np.zeros(int(self.mask) + 1, bool)
        self.there[(key & self.mask).astype(np.int64)] = True

    def maybe(self, key: np.ndarray) -> np.ndarray:
        return self.there[(key & self.mask).astype(np.int64)]


class Index:
    """Keys of all windows of a block of items."""

    def __init__(self, items: list[tuple], percent: int = EDITS_PERCENT):
        blob = b"\n".join((t or "").encode() for _, t in items)
        sizes = [len((t or "").encode()) + 1 for _, t in items]
        offsets = np.r_[0, np.cumsum(sizes)]
        offsets[-1] -= 1
        words, at = words_of(np.frombuffer(blob, np.uint8), np.maximum(offsets, 0))
        # items of equal words are one: ``ids`` has those of each
        found: dict[bytes, int] = {}
        self.ids: list[list] = []
        starts, ends = [], []
        for k, (i, _) in enumerate(items):
            if at[k] == at[k + 1]:
                continue
            own = found.setdefault(words[at[k] : at[k + 1]].tobytes(), len(self.ids))
            if own == len(self.ids):
                self.ids.append([])
                starts.append(at[k])
                ends.append(at[k + 1])
            self.ids[own].append(i)
        self.starts, self.sizes = np.array(starts, np.int64), np.array(ends, np.int64) - np.array(starts, np.int64)
        self.edits = percent * self.sizes // 100
        self.items = [words[a:b] for a, b in zip(starts, ends)]
        self.vocabulary = Sieve(np.unique(words))
        #: (width, stride, words of a window that may be foreign, the items' words, [(keys in order, item, shift)] by repetition)
        self.classes: list[tuple[int, int, int, Sieve, list[tuple[Sieve, np.ndarray, np.ndarray]]]] = []
        groups: dict[tuple[int, int], list[int]] = {}
        walk: dict[int, np.ndarray] = {}
        for k, (n, e) in enumerate(zip(self.sizes.tolist(), self.edits.tolist())):
            groups.setdefault(width_of(n, e), []).append(k)
        for (width, stride), members in sorted(groups.items()):
            item = np.concatenate([np.full(self.sizes[k] - width + 1, k, np.int32) for k in members])
            shift = np.concatenate([np.arange(self.sizes[k] - width + 1, dtype=np.int32) for k in members])
            times = np.zeros(len(self.items), np.int64)
            times[members] = [repetitions(int(self.sizes[k]), int(self.edits[k]), width, stride) for k in members]
            tables = []
            for t in range(times.max()):
                pick = times[item] > t
                key = keys(words, self.starts[item[pick]] + shift[pick], width, stride, t, walk)
                order = np.argsort(key, kind="stable")
                tables.append((Sieve(key[order]), item[pick][order], shift[pick][order]))
            vocabulary = Sieve(np.unique(np.concatenate([self.items[k] for k in members])))
            self.classes.append((width, stride, max(self._foreign(k, width, stride) for k in members), vocabulary, tables))
        self._bits()

    def _foreign(self, k: int, width: int, stride: int) -> int:
        """Edits of the least edited of the windows side by side that every occurrence of item k holds."""
        n, e = int(self.sizes[k]), int(self.edits[k])
        return e // max(1, (n - e - stride + 1) // width) if stride > 1 else e

    def _bits(self) -> None:
        """For each item and word, in order of one key, the places of the word in the item as bits, 63 to a lane."""
        self.lanes = int(-(-max(self.sizes, default=1) // 63))
        keys_of, masks = [], []
        for k, w in enumerate(self.items):
            distinct, place = np.unique(w, return_inverse=True)
            own = np.zeros((len(distinct), self.lanes), np.uint64)
            j = np.arange(len(w))
            np.bitwise_or.at(own, (place, j // 63), np.uint64(1) << (j % 63).astype(np.uint64))
            keys_of.append(self._pair(np.full(len(distinct), k), distinct))
            masks.append(own)
        key = np.concatenate(keys_of) if keys_of else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.bit_keys = Sieve(key[order])
        self.bit_masks = np.concatenate(masks)[order] if masks else np.zeros((0, 1), np.uint64)

    @staticmethod
    def _pair(item: np.ndarray, word: np.ndarray) -> np.ndarray:
        return common.mix(word ^ common.mix(item.astype(np.uint64) + np.uint64(1)))

    def distances(self, words: np.ndarray, item: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Least word edit distance of each item to any run within words[begin:end]; item size + 1 where too few of its words are there.

        Bit-parallel dynamic programming, one step a word for all rows at once.  An item's
        places are bits of lanes of 63, so that a sum's carry stays in its word and is handed on.
        """
        out = self.sizes[item] + 1
        length = end - begin
        order = np.argsort(length, kind="stable")
        at = 0
        while at < len(order):
            # rows of like length together, so many that their words fit into a bounded table
            to = at + 1
            while to < len(order) and (to + 1 - at) * int(length[order[to]]) * self.lanes <= 1 << 20:
                to += 1
            rows = order[at:to]
            at = to
            steps = int(length[rows].max(initial=0))
            if not steps:
                continue
            place = begin[rows][:, None] + np.arange(steps)
            inside = place < end[rows][:, None]
            w = words[np.minimum(place, len(words) - 1)]
            pair = common.mix(w ^ common.mix(item[rows].astype(np.uint64) + np.uint64(1))[:, None])
            least = self.sizes[item[rows]] - self.edits[item[rows]]
            enough = (self.bit_keys.maybe(pair) & inside).sum(1) >= least
            if not enough.any():
                continue
            rows, inside, pair, least = rows[enough], inside[enough], pair[enough], least[enough]
            found = np.minimum(np.searchsorted(self.bit_keys.key, pair), len(self.bit_keys.key) - 1)
            known = (self.bit_keys.key[found] == pair) & inside
            enough = known.sum(1) >= least
            rows, inside, known, found = rows[enough], inside[enough], known[enough], found[enough]
            if not len(rows):
                continue
            out[rows] = self._run(item[rows], known, inside, found)
        return out

    def _run(self, item: np.ndarray, known: np.ndarray, inside: np.ndarray, found: np.ndarray) -> np.ndarray:
        n, lanes, one, full = len(item), self.lanes, np.uint64(1), np.uint64((1 << 63) - 1)
        size = self.sizes[item]
        top_lane, top = (size - 1) // 63, one << ((size - 1) % 63).astype(np.uint64)
        every = np.arange(n)
        up, down = np.full((n, lanes), full), np.zeros((n, lanes), np.uint64)
        score, best = size.copy(), size.copy()
        for j in range(known.shape[1]):
            eq = np.where(known[:, j, None], self.bit_masks[found[:, j]], np.uint64(0))
            x = eq | down
            d = np.empty_like(x)
            carry = np.zeros(n, np.uint64)
            for lane in range(lanes):
                total = (x[:, lane] & up[:, lane]) + up[:, lane] + carry
                carry = total >> np.uint64(63)
                d[:, lane] = ((total ^ up[:, lane]) | x[:, lane]) & full
            plus, minus = (down | ~(d | up)) & full, up & d
            live = inside[:, j]
            score = score + (live & (plus[every, top_lane] & top > 0)) - (live & (minus[every, top_lane] & top > 0))
            best = np.minimum(best, np.where(live, score, best))
            for m in (plus, minus):
                over = m >> np.uint64(62)
                m <<= one
                m &= full
                m[:, 1:] |= over[:, :-1]
            up = (minus | ~(d | plus)) & full
            down = plus & d
        return best

    def search(self, data: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], int]:
        """{(text, item): edits} of all confirmed hits."""
        words, at = words_of(data, offsets)
        if not len(words) or not self.items:
            return {}
        walk: dict[int, np.ndarray] = {}
        hits: list[np.ndarray] = []
        for width, stride, foreign, vocabulary, tables in self.classes:
            upto = np.r_[0, np.cumsum(vocabulary.maybe(words))]
            starts, texts = common.window_texts(at, width)
            pick = ((starts - at[texts]) % stride == 0) & (upto[starts + width] - upto[starts] >= width - foreign)
            starts, texts = starts[pick], texts[pick]
            if not len(starts):
                continue
            for t, (sieve, item, shift) in enumerate(tables):
                own = keys(words, starts, width, stride, t, walk)
                there = np.flatnonzero(sieve.maybe(own))
                own = own[there]
                lo, hi = np.searchsorted(sieve.key, own, "left"), np.searchsorted(sieve.key, own, "right")
                n = hi - lo
                if not n.any():
                    continue
                x = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                # (item, begin) as one number; a begin before its text is the text's first word
                begin = np.maximum(np.repeat(starts[there], n) - shift[x], np.repeat(at[texts[there]], n))
                hits.append(np.unique(item[x].astype(np.int64) * len(words) + begin))
        if not hits:
            return {}
        k, begin = np.divmod(np.unique(np.concatenate(hits)), len(words))
        text = np.searchsorted(at, begin, "right") - 1
        # hits of one text and item whose runs overlap are one run
        slack, size = self.edits[k], self.sizes[k]
        a, b = np.maximum(at[text], begin - slack), np.minimum(at[text + 1], begin + size + slack)
        upto = np.r_[0, np.cumsum(self.vocabulary.maybe(words))]
        pick = upto[b] - upto[a] >= size - slack
        text, k, a, b = text[pick], k[pick], a[pick], b[pick]
        if not len(text):
            return {}
        fresh = np.ones(len(text), bool)
        fresh[1:] = (text[1:] != text[:-1]) | (k[1:] != k[:-1]) | (a[1:] > b[:-1])
        first = np.flatnonzero(fresh)
        text, k, a, b = text[first], k[first], a[first], np.maximum.reduceat(b, first)
        found = self.distances(words, k, a, b)
        out: dict[tuple[int, int], int] = {}
        good = np.flatnonzero(found <= self.edits[k])
        for r in good.tolist():
            pair = (int(text[r]), int(k[r]))
            out[pair] = min(int(found[r]), out.get(pair, int(found[r])))
        return out


def item_blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[list[tuple]]:
    """The benchmark in blocks of bounded size, in order of ids."""
    block: list[tuple] = []
    size = 0
    for r in benchmark.select(F.col(key).alias("i"), F.col(text).alias("t")).filter("t IS NOT NULL").orderBy("i", "t").toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or size + len(r["t"]) > BLOCK_TEXT):
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += len(r["t"])
    yield block


def _matches(shared, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for block in common.blocks(batches, "text"):
            found = index.search(*common.raw(block.column(1)))
            rows = [(t, i, int(index.sizes[k]), found[t, k]) for t, k in sorted(found) for i in index.ids[k]]
            yield pa.RecordBatch.from_arrays(
                [
                    block.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                    pa.array([r[1] for r in rows], item_type),
                    pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([r[3] for r in rows], pa.int64()),
                ],
                names=["key", "item", "item_words", "edits"],
            )

    return run


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_key, item_words, edits): each contaminated row with each of its items."""
    spark = docs.sparkSession
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind, item = own.schema["key"].dataType.simpleString(), benchmark.schema[item_key].dataType
    out = None
    for block in item_blocks(benchmark, item_key, item_text):
        found = own.mapInArrow(_matches(spark.sparkContext.broadcast(Index(block)), to_arrow_type(item)), f"key {kind}, item {item.simpleString()}, item_words bigint, edits bigint")
        out = found if out is None else out.unionByName(found)
    return out.withColumnsRenamed({"key": key, "item": item_key})


def _clean(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, text):
            found = shared.value.search(*common.raw(block.column(block.schema.get_field_index(text))))
            stay = [True] * block.num_rows
            for t, _ in found:
                stay[t] = False
            yield block.filter(pa.array(stay))

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns."""
    spark = docs.sparkSession
    for block in item_blocks(benchmark, item_key, item_text):
        docs = docs.mapInArrow(_clean(spark.sparkContext.broadcast(Index(block)), text), docs.schema)
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` that holds an item of ``benchmark``, with that item and its edits."""
    return matches(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
