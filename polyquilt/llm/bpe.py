"""Word-level BPE: token counts by rank-synchronous merging, encoding by a segment tree, decoding.

The vocabulary is a ``tokenizers`` JSON file whose path is a parameter.  Both
operators split a text at ASCII white space, which the file's normaliser and
pre-tokeniser can never merge across, and tokenise each distinct chunk once per
worker; a chunk memo bounded in entries and bytes holds the results, so a
text costs little more than one look-up per chunk.

* null and empty texts have no tokens; very long texts and chunks take the same
  path; repeated rows and ids that tie give a result each; an empty table gives no
  rows; extra columns are ignored.
* special strings inside texts are taken as the library takes them by default.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from polyquilt.llm import common

#: Entries of a worker's chunk memo; when it is full it becomes the older memo, which is asked before work is done anew.
MEMO_ENTRIES = 200_000
#: Bytes of a chunk that is kept in a memo: with its ids an entry takes some 500 bytes at most, both memos 200 MB.
MEMO_BYTES = 64
NO_RANK = np.int64(1) << 40
#: Marks that never join a contraction.
MARKS = frozenset((b".", b",", b"!", b"?", b";", b":"))
#: Text bytes of a block.
BLOCK_BYTES = 3 << 20


def byte_signs() -> str:
    """The sign of each byte in byte-level vocabularies: itself if it is a visible Latin-1 sign, else the next from U+0100 on."""
    out, extra = [], 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return "".join(out)


def latin_pieces():
    """A pre-tokeniser for lower-cased texts of characters under U+0180, whose classes no Unicode version changed."""
    kinds: dict[str, list[str]] = {"L": [], "N": []}
    for c in map(chr, range(0x180)):
        kinds.get(unicodedata.category(c)[0], []).append(re.escape(c))
    letters, digits = "".join(kinds["L"]), "".join(kinds["N"])
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{letters}{digits}\t-\r \x85\xa0]+").findall


class Vocabulary:
    """Ranks, merge products and pre-tokenisation of one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self.base = max(self.tokens) + 1
        self.names = [self.tokens.get(i, "").encode() for i in range(self.base)]
        signs = byte_signs()
        self.inner = np.array([ids[c] for c in signs], np.int32)
        self.last = np.array([ids[c + end] for c in signs], np.int32)
        self.unsigned = str.maketrans(signs, bytes(range(256)).decode("latin-1"))
        left, right, made = [], [], []
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            left.append(ids[a])
            right.append(ids[b])
            made.append(ids[a + b])
        self.made = np.array(made, np.int32)
        self._table(np.array(left, np.int64) * self.base + np.array(right, np.int64))
        self.prefix = os.path.commonprefix(list(self.special))
        self.split = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.latin = latin_pieces()

    def _table(self, keys: np.ndarray) -> None:
        """An open-addressing table of merge ranks by pair."""
        self.bits = max(4, (8 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NO_RANK, np.int64)
        left, self.probes = np.arange(len(keys)), 0
        while len(left):
            at = (self._slot(keys[left]) + self.probes) & ((1 << self.bits) - 1)
            free = self.slots[at] == -1
            self.slots[at[free][::-1]] = keys[left[free]][::-1]
            won = self.slots[at] == keys[left]
            self.rank[at[won]] = left[won]
            left = left[~won]
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, NO_RANK where there is none; a symbol below 0 never merges."""
        key = left.astype(np.int64) * self.base + right
        key[(left < 0) | (right < 0)] = -2
        slot = self._slot(key)
        out = np.where(self.slots[slot] == key, self.rank[slot], NO_RANK)
        for k in range(1, self.probes):
            rest = np.flatnonzero((out == NO_RANK) & (self.slots[slot] != -1) & (key >= 0))
            if not len(rest):
                break
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            won = rest[self.slots[slot[rest]] == key[rest]]
            out[won] = self.rank[slot[won]]
        return out

    def pieces(self, raw: bytes) -> list[bytes | int]:
        """The pre-tokens of a chunk as UTF-8 bytes; a special token as its id."""
        if raw.isalpha():  # ASCII letters alone are one pre-token, and so are those before a mark
            return [raw.lower()]
        if raw[-1:] in MARKS and raw[:-1].isalpha():
            return [raw[:-1].lower(), raw[-1:]]
        chunk = raw.decode()
        if self.special and self.prefix in chunk:
            out: list[bytes | int] = []
            for part in self.split.split(chunk):
                if part in self.special:
                    out.append(self.special[part])
                elif part:
                    out += self._plain(part)
            return out
        return self._plain(chunk)

    def _plain(self, part: str) -> list[bytes]:
        if part.isascii() or max(part) < "\u0180" and "\u0130" not in part:
            return [p.encode() for p in self.latin(part.lower())]
        text = self.library.normalizer.normalize_str(part)
        return [p.translate(self.unsigned).encode("latin-1") for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def symbols(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The first symbols of all pieces end to end, and the pieces' sizes."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sym = self.inner[data]
        ends = np.cumsum(size) - 1
        sym[ends] = self.last[data[ends]]
        return sym, size


def merged_sizes(vocabulary: Vocabulary, pieces: list[bytes]) -> np.ndarray:
    """Tokens of each pre-token by rank-synchronous merging.

    All pre-tokens lie end to end in one ragged array.  In each round every
    sequence applies its own lowest-rank pair at all places at once (of
    overlapping places the left one); a merge's product is made by no other merge,
    so no pair of a lower rank can arise meanwhile and the order is that of
    one-by-one merging.  Rounds end when no sequence has a pair.
    """
    if not pieces:
        return np.zeros(0, np.int64)
    sym, size = vocabulary.symbols(pieces)
    out = size.copy()
    seq = np.repeat(np.arange(len(pieces)), size)
    while len(sym) > 1:
        same = seq[:-1] == seq[1:]
        rank = np.where(same, vocabulary.ranks(sym[:-1], sym[1:]), NO_RANK)
        heads = np.flatnonzero(np.r_[True, ~same])
        least = np.minimum.reduceat(np.r_[rank, NO_RANK], heads)
        lowest = np.repeat(least, np.diff(np.r_[heads, len(sym)]))
        hit = (rank == lowest[:-1]) & (rank < NO_RANK)
        if not hit.any():
            break
        run = np.flatnonzero(hit & ~np.r_[False, hit[:-1]])  # of overlapping places every other one
        start = np.zeros(len(hit), np.int64)
        start[run] = run
        hit &= (np.arange(len(hit)) - np.maximum.accumulate(start)) % 2 == 0
        at = np.flatnonzero(hit)
        sym[at] = vocabulary.made[rank[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        # finished sequences leave the array
        alive = np.zeros(len(pieces), bool)
        alive[seq[at]] = True
        out -= np.bincount(seq[at], minlength=len(out))
        keep &= alive[seq]
        sym, seq = sym[keep], seq[keep]
    return out


def merged_ids(vocabulary: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pre-tokens end to end, and their numbers, by a segment tree over adjacent pair ranks.

    A leaf holds ``rank * capacity + place`` of the pair that begins at its place,
    so the root is the leftmost pair of the lowest rank.  A merge updates three
    leaves and their paths to the root.  Trees of one capacity are rows of a
    matrix and take their steps together; a row leaves when its root is empty.
    """
    if not pieces:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    flat, size = vocabulary.symbols(pieces)
    begin = np.cumsum(size) - size
    caps = 1 << np.maximum(2, np.ceil(np.log2(size)).astype(np.int64))
    out = flat.copy()
    count = size.copy()
    for cap in np.unique(caps[size > 1]).tolist():
        members = np.flatnonzero((caps == cap) & (size > 1))
        step = max(1, (1 << 17) // cap)
        for at in range(0, len(members), step):
            part = members[at : at + step]
            n = size[part]
            row = np.repeat(np.arange(len(part)), n)
            column = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            sym = np.full((len(part), cap + 1), -1, np.int32)
            sym[row, column] = flat[begin[part][row] + column]
            _merge_trees(vocabulary, sym, cap)
            left = sym >= 0
            count[part] = n = left.sum(1)
            row = np.repeat(np.arange(len(part)), n)
            column = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out[begin[part][row] + column] = sym[left]
    row = np.repeat(np.arange(len(pieces)), count)
    return out[begin[row] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)], count


def _merge_trees(vocabulary: Vocabulary, sym: np.ndarray, cap: int) -> None:
    """Merge each row of ``sym`` (padded with -1) to its end; a merged pair stays at its left place, -1 at its right one."""
    n = len(sym)
    none = NO_RANK * cap
    after = np.tile(np.arange(1, cap + 2, dtype=np.int32), (n, 1))
    before = np.tile(np.arange(-1, cap, dtype=np.int32), (n, 1))
    tree = np.full((n, 2 * cap), none, np.int64)
    rank = vocabulary.ranks(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, cap)
    tree[:, cap:] = np.where(rank < NO_RANK, rank * cap + np.arange(cap), none)
    for level in range(cap.bit_length() - 1, 0, -1):
        lo = 1 << (level - 1)
        tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
    live = np.flatnonzero(tree[:, 1] < none)
    while len(live):
        root = tree[live, 1]
        place = root % cap
        right = after[live, place]
        now = vocabulary.made[root // cap]
        sym[live, place] = now
        sym[live, right] = -1
        beyond = np.minimum(after[live, right], cap)
        after[live, place] = beyond
        before[live, beyond] = place
        prior = before[live, place]
        there = np.maximum(prior, 0)
        rank = vocabulary.ranks(np.r_[now, np.where(prior >= 0, sym[live, there], -1)], np.r_[sym[live, beyond], now])
        own, last = rank[: len(live)], rank[len(live) :]
        # the right part's pair is gone, the product's pair is new, and so is the pair before it
        tree[live, right + cap] = none
        tree[live, place + cap] = np.where(own < NO_RANK, own * cap + place, none)
        has = np.flatnonzero(prior >= 0)
        tree[live[has], prior[has] + cap] = np.where(last[has] < NO_RANK, last[has] * cap + prior[has], none)
        _climb(tree, live, right, cap)
        _climb(tree, live, place, cap)
        _climb(tree, live[has], prior[has], cap)
        live = live[tree[live, 1] < none]


def _climb(tree: np.ndarray, rows: np.ndarray, place: np.ndarray, cap: int) -> None:
    node = place + cap
    while cap > 1:
        node = node >> 1
        tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
        cap >>= 1


_LOADED: dict[str, Vocabulary] = {}
#: By path: the memo of chunks, and the one before it.
_SIZES: dict[str, tuple[dict[bytes, int], dict[bytes, int]]] = {}
_IDS: dict[str, tuple[dict[bytes, bytes], dict[bytes, bytes]]] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


class Chunks:
    """The chunks of a block's texts: distinct ones, which of them each place holds, and the texts' offsets into the places."""

    def __init__(self, column: pa.Array):
        if column.null_count:
            column = column.fill_null("")
        lists = pc.ascii_split_whitespace(column)  # at runs of [\x20\x09-\x0D]; a chunk at an end may be empty
        self.offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        coded = pc.dictionary_encode(lists.flatten())
        self.distinct: list[bytes] = coded.dictionary.cast(pa.large_binary() if pa.types.is_large_string(coded.dictionary.type) else pa.binary()).to_pylist()
        self.which = np.asarray(coded.indices)


def _missing(memos: dict, path: str, found: list[bytes]) -> tuple[dict, list[bytes]]:
    """The memo, with what an older one has of the chunks, and the chunks that neither has."""
    memo, old = memos.get(path, ({}, {}))
    if len(memo) + len(found) > MEMO_ENTRIES:
        memo, old = {}, memo
    memos[path] = memo, old
    new = []
    for c in found:
        if c not in memo:
            if (have := old.get(c)) is None:
                new.append(c)
            else:
                memo[c] = have
    return memo, new


def _found(memo: dict, made: dict, found: list[bytes]) -> list:
    """What ``made`` and the memo have of the chunks; short ones go into the memo, long ones with their block."""
    memo.update((c, x) for c, x in made.items() if len(c) <= MEMO_BYTES)
    return [made[c] if c in made else memo[c] for c in found]


def _split(v: Vocabulary, chunks: list[bytes]) -> tuple[list[list[bytes | int]], dict[bytes, int]]:
    """The pieces of each chunk, and the distinct pieces' numbers."""
    split = [v.pieces(c) for c in chunks]
    place: dict[bytes, int] = {}
    for pieces in split:
        for p in pieces:
            if p not in place and type(p) is bytes:
                place[p] = len(place)
    return split, place


def chunk_sizes(path: str, found: list[bytes]) -> list[int]:
    """The token count of each of the distinct chunks."""
    v = vocabulary(path)
    memo, new = _missing(_SIZES, path, found)
    split, place = _split(v, new)
    size = dict(zip(place, merged_sizes(v, list(place)).tolist(), strict=True))
    made = {}
    for c, pieces in zip(new, split, strict=True):
        made[c] = size[pieces[0]] if len(pieces) == 1 and type(pieces[0]) is bytes else sum(size[p] if type(p) is bytes else 1 for p in pieces)
    return _found(memo, made, found)


def chunk_ids(path: str, found: list[bytes]) -> list[bytes]:
    """The ids (little-endian uint32) of each of the distinct chunks."""
    v = vocabulary(path)
    memo, new = _missing(_IDS, path, found)
    split, place = _split(v, new)
    flat, count = merged_ids(v, list(place))
    blob, ends = flat.astype("<u4").tobytes(), np.cumsum(4 * count).tolist()
    ids = {p: blob[a:b] for p, a, b in zip(place, [0, *ends], ends, strict=False)}
    made = {}
    for c, pieces in zip(new, split, strict=True):
        made[c] = ids[pieces[0]] if len(pieces) == 1 and type(pieces[0]) is bytes else b"".join([ids[p] if type(p) is bytes else p.to_bytes(4, "little") for p in pieces])
    return _found(memo, made, found)


def count_texts(path: str, column: pa.Array) -> np.ndarray:
    """Tokens of each text of a column."""
    chunks = Chunks(column)
    size = np.array(chunk_sizes(path, chunks.distinct) or [0], np.int64)
    upto = np.r_[0, np.cumsum(size[chunks.which])]
    return np.diff(upto[chunks.offsets])


def encode_texts(path: str, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts of a column end to end (uint32), and the texts' offsets into them."""
    chunks = Chunks(column)
    parts = chunk_ids(path, chunks.distinct)
    flat = np.frombuffer(b"".join(parts), "<u4")
    size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    begin = np.cumsum(size) - size
    count = size[chunks.which]
    upto = np.r_[0, np.cumsum(count)]
    at = np.repeat(begin[chunks.which] - upto[:-1], count)
    at += np.arange(len(at))
    return flat[at], upto[chunks.offsets]


def decode_ids(v: Vocabulary, ids: bytes) -> bytes:
    """The text of little-endian uint32 ids: the file names no decoder, so tokens are joined by one space."""
    return b" ".join(map(v.names.__getitem__, memoryview(ids).cast("I")))


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row; ``n_tokens > limit`` is over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, text, BLOCK_BYTES):
            tokens = count_texts(path, block.column(1))
            _, offsets = common.raw(block.column(1))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def encoded(path: str, column: pa.Array) -> Iterator[bytes]:
    """The ids of each text, as little-endian uint32."""
    flat, offsets = encode_texts(path, column)
    for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        yield flat[a:b].tobytes()


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded) of every row: ids as little-endian uint32 in one binary, decoded as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for block in common.blocks(batches, text, BLOCK_BYTES):
            ids = list(encoded(path, block.column(1)))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(ids, pa.binary()), pa.array([decode_ids(v, i).decode() for i in ids], pa.string())], names=[key, "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids binary, decoded string")


def encode_digest(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What ``encode`` gives, as (key, n_tokens, ids_sha256, decoded_sha256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for block in common.blocks(batches, text, BLOCK_BYTES):
            n, ids, decoded = [], [], []
            for own in encoded(path, block.column(1)):
                n.append(len(own) // 4)
                ids.append(hashlib.sha256(own).hexdigest())
                decoded.append(hashlib.sha256(decode_ids(v, own)).hexdigest())
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def word_vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text of ``documents``, by rank-synchronous array merging."""
    return count_tokens(common.read(spark, sf_dir, "documents"), word_vocabulary_path())


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding of every whole text of ``documents``, by segment trees over pair ranks."""
    return encode_digest(common.read(spark, sf_dir, "documents"), word_vocabulary_path())
