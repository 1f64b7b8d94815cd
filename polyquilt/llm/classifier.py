r"""Quality classifier: attention-based multiple-instance learning over a document's passages.

A document is a bag of passages of ``PASSAGE`` words; only the bag has a label.  A passage is
encoded as hashed counts of its byte trigrams and of its letters' shapes, with a few ratios,
and projected by a learned layer to h.  Gated attention, softmax over w . (tanh(V h) *
sigmoid(U h)), weighs the passages, and a logistic layer scores the weighted sum of h.  All
layers are learned together from the documents' labels by gradient descent.

Learning takes a bounded sample of labelled rows: of at most ``FIT_DOCS`` ids (those of least
hash), whole texts up to ``FIT_BYTES`` in all.  Everything else covers every row: scoring runs
in ``mapInArrow`` over bounded chunks of passages, of which only h and the attention value are
kept until a document's end, so a very long text needs some 100 bytes a passage.

Defined results: null and empty texts are one empty passage and are scored like others; a null
id is never held out and never learned from; of an id's several labels the lowest counts;
equal texts get equal scores; without labels of both kinds the score is (ones + 1) / (labels
+ 2) for all; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquilt.llm import common

#: Words of a passage, and letters at most (a longer word is cut there).
PASSAGE, PASSAGE_BYTES = 64, 4096
#: Buckets of hashed byte trigrams and of hashed shape trigrams.
TRIGRAMS, SHAPES = 384, 128
#: Passages that are encoded at a time.
CHUNK = 512
#: Sizes of h and of the attention layer.
HIDDEN, GATE = 16, 8
#: Bounds of the sample that is learned from.
FIT_DOCS, FIT_BYTES = 4000, 16_000_000
#: Gradient steps, whatever the sample's size, each over BATCH whole documents.
STEPS, BATCH, RATE, DECAY = 1250, 64, 0.01, 1e-4
#: Scores from here on predict 1.
THRESHOLD = 0.3
#: Of the ids' hash classes modulo FOLDS, class 0 is held out.
FOLDS = 5

#: Shapes of bytes: lower, upper, digit, space, newline, others by themselves; bytes of longer characters count as lower.
_SHAPE = np.arange(256, dtype=np.int64)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 97, 65, 48, 97
_SHAPE[[9, 11, 12, 13]] = 32
_KINDS = {"upper": np.arange(65, 91), "digit": np.arange(48, 58), "mark": np.array([c for c in range(33, 127) if not chr(c).isalnum()]), "line": np.array([10]), "high": np.arange(128, 256)}
_KIND = np.zeros((256, len(_KINDS)), np.float32)
for _k, _bytes in enumerate(_KINDS.values()):
    _KIND[_bytes, _k] = 1
RATIOS = len(_KINDS) + 4
WIDTH = TRIGRAMS + SHAPES + RATIOS


# --- passages ---


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each passage, and n + 1 offsets of the texts into the passages; a text without words is one empty passage.

    A passage runs from its first word to the next passage, so every byte between words is in one.
    """
    starts, _, words = common.word_spans(data, offsets)
    firsts, ends, counts = [], [], []
    for k in range(len(offsets) - 1):
        low, high = offsets[k], offsets[k + 1]
        own = starts[words[k] : words[k + 1] : PASSAGE]
        edges = np.concatenate((own, [high])) if len(own) else np.array([low, low])
        sizes = np.diff(edges)
        if (sizes > PASSAGE_BYTES).any():
            edges = np.concatenate([np.arange(a, b, PASSAGE_BYTES) for a, b in zip(edges[:-1], edges[1:])] + [[high]])
        firsts.append(edges[:-1])
        ends.append(edges[1:])
        counts.append(len(edges) - 1)
    return np.concatenate(firsts), np.concatenate(ends), np.concatenate(([0], np.cumsum(counts)))


def encode(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of ``WIDTH`` features for each passage."""
    n = len(starts)
    sizes = ends - starts
    out = np.zeros((n, WIDTH), np.float32)
    if not sizes.sum():
        return out
    row = np.repeat(np.arange(n), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    own = data[at].astype(np.int64)
    whole = row[2:] == row[:-2]  # trigrams of one passage
    for low, high, letters, seed in ((0, TRIGRAMS, common.LOWER[own].astype(np.int64), 1), (TRIGRAMS, TRIGRAMS + SHAPES, _SHAPE[own], 7)):
        key = (letters[:-2] << 16 | letters[1:-1] << 8 | letters[2:])[whole]
        bucket = (common.mix(key.astype(np.uint64) + np.uint64(seed)) % np.uint64(high - low)).astype(np.int64)
        counts = np.bincount(row[2:][whole] * (high - low) + bucket, minlength=n * (high - low)).reshape(n, high - low)
        part = np.sqrt(counts.astype(np.float32))
        out[:, low:high] = part / np.maximum(np.sqrt((part * part).sum(1, keepdims=True)), 1)
    ratios = np.zeros((n, RATIOS), np.float32)
    length = np.maximum(sizes, 1).astype(np.float32)
    for k in range(len(_KINDS)):
        ratios[:, k] = np.bincount(row, _KIND[own, k], n) / length
    first, last, texts = common.word_spans(own.astype(np.uint8), np.concatenate(([0], np.cumsum(sizes))))
    count = np.diff(texts)
    hashes = common.word_hashes(own.astype(np.uint8), first, last)
    of = np.repeat(np.arange(n), count)
    order = np.lexsort((hashes, of))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order], fresh, n)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    words = np.maximum(count, 1)
    ratios[:, -4] = distinct / words
    ratios[:, -3] = np.bincount(of, same, n) / words
    ratios[:, -2] = np.minimum(np.bincount(of, last - first, n) / words / 20, 2)
    ratios[:, -1] = np.minimum(count / PASSAGE, 1)
    out[:, TRIGRAMS + SHAPES :] = ratios
    return out


# --- the model ---


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _start(rnd: np.random.Generator) -> dict[str, np.ndarray]:
    draw = lambda *shape: (rnd.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    return {"W": draw(WIDTH, HIDDEN) * 3, "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE), "c": draw(HIDDEN), "d": np.zeros(1, np.float32)}


def instances(model: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of encoded passages: h, both gates, and the attention before the softmax."""
    h = np.tanh(x @ model["W"] + model["b"])
    t, g = np.tanh(h @ model["V"]), _sigmoid(h @ model["U"])
    return h, t, g, (t * g) @ model["w"]


def bags(h: np.ndarray, e: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The attention weights of all passages, and each bag's weighted sum of h."""
    low = offsets[:-1]
    own = np.repeat(np.arange(len(low)), np.diff(offsets))
    a = np.exp(e - np.maximum.reduceat(e, low)[own])
    a = a / np.add.reduceat(a, low)[own]
    return a, np.add.reduceat(a[:, None] * h, low)


def gradients(model: dict[str, np.ndarray], x: np.ndarray, offsets: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean log loss of the bags and its gradients."""
    h, t, g, e = instances(model, x)
    a, z = bags(h, e, offsets)
    own = np.repeat(np.arange(len(y)), np.diff(offsets))
    p = _sigmoid(z @ model["c"] + model["d"])
    loss = float(-np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)))
    dp = ((p - y) / len(y)).astype(np.float32)
    dz = dp[:, None] * model["c"]
    da = (h * dz[own]).sum(1)
    de = a * (da - np.add.reduceat(a * da, offsets[:-1])[own])
    dt, dg = de[:, None] * model["w"] * g * (1 - t * t), de[:, None] * model["w"] * t * g * (1 - g)
    dh = (a[:, None] * dz[own] + dt @ model["V"].T + dg @ model["U"].T) * (1 - h * h)
    return loss, {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ dp, "d": dp.sum(keepdims=True)}


def learn(x: np.ndarray, offsets: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 1) -> dict[str, np.ndarray]:
    """A model of encoded bags, by Adam over shuffled batches of whole bags."""
    rnd = np.random.default_rng(seed)
    model = _start(rnd)
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    step = 0
    while step < steps:
        order = rnd.permutation(len(y))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            sizes = offsets[chosen + 1] - offsets[chosen]
            rows = np.concatenate([np.arange(offsets[k], offsets[k + 1]) for k in chosen])
            _, grads = gradients(model, x[rows], np.concatenate(([0], np.cumsum(sizes))), y[chosen])
            step += 1
            for k, v in model.items():
                own = grads[k] + DECAY * v
                first[k] = 0.9 * first[k] + 0.1 * own
                second[k] = 0.999 * second[k] + 0.001 * own * own
                model[k] = (v - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def score_block(model: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Scores of whole texts."""
    starts, ends, of = passages(data, offsets)
    h, e = np.zeros((len(starts), HIDDEN), np.float32), np.zeros(len(starts), np.float32)
    for at in range(0, len(starts), CHUNK):
        h[at : at + CHUNK], _, _, e[at : at + CHUNK] = instances(model, encode(data, starts[at : at + CHUNK], ends[at : at + CHUNK]))
    _, z = bags(h, e, of)
    return _sigmoid((z @ model["c"] + model["d"]).astype(np.float64))


# --- jobs ---


def _class(key: Column) -> Column:
    return F.crc32(key.cast("string")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", fit_docs: int = FIT_DOCS, fit_bytes: int = FIT_BYTES) -> dict[str, np.ndarray] | float:
    """A model from the labelled rows outside the held-out class; a constant where only one label is there."""
    known = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & (_class(F.col("k")) != 0))
    known = known.groupBy("k").agg(F.min("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("k"), "k").limit(fit_docs)
    own = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).filter(F.col("k").isNotNull())
    met = own.join(F.broadcast(chosen), "k")  # fit_docs rows at most
    # copies of an id are one example; sizes first, so that what is fetched has a bound
    sizes = met.groupBy("k", "y").agg(F.min(F.coalesce(F.octet_length("t"), F.lit(0))).alias("size")).orderBy(F.xxhash64("k"), "k").collect()
    taken, room = [], fit_bytes
    for row in sizes:
        if row["size"] <= room:
            taken.append((row["k"], row["y"]))
            room -= row["size"]
    ones = sum(y for _, y in taken)
    if not 0 < ones < len(taken):
        return (ones + 1) / (len(taken) + 2)
    ids = docs.sparkSession.createDataFrame(taken, met.select("k", "y").schema)
    texts = own.join(F.broadcast(ids), "k").groupBy("k", "y").agg(F.min_by("t", F.struct(F.coalesce(F.octet_length("t"), F.lit(0)), "t")).alias("t")).orderBy(F.xxhash64("k"), "k").select("y", "t").toArrow()
    x, counts = [], []
    for batch in texts.to_batches():
        for block in common.blocks(iter([batch]), "t"):
            data, offsets = common.raw(block.column(1))
            starts, ends, of = passages(data, offsets)
            x += [encode(data, starts[at : at + CHUNK], ends[at : at + CHUNK]) for at in range(0, len(starts), CHUNK)]
            counts.append(np.diff(of))
    return learn(np.concatenate(x), np.concatenate(([0], np.cumsum(np.concatenate(counts)))), np.asarray(texts["y"], dtype=np.float32))


def scored(docs: DataFrame, model: dict[str, np.ndarray] | float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""
    own = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    if isinstance(model, float):
        return own.select(F.col("k").alias(key), F.lit(model).alias("score"))
    kind = own.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "t"):
            found = score_block(model, *common.raw(block.column(1)))
            yield pa.record_batch([block.column(0), pa.array(found, pa.float64())], names=["k", "score"])

    return own.mapInArrow(run, f"k {kind}, score double").select(F.col("k").alias(key), "score")


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from the labels outside the held-out class."""
    docs = common.read(spark, sf_dir, "documents")
    out = scored(docs, fit(docs, common.read(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(_class(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
