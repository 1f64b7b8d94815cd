"""Byte codecs and identifiers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from functools import cache

from polyquilt.functions.geometry import INT64, Point, Record
from polyquilt.operators.canon import WORD64

CODEC_VERSION = 1
#: Start states of the four lanes, and the multiplier of a step.
LANES = (14695981039346656037, 0x9AE16A3B2F90404F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
PRIME = 1099511628211


def zigzag(n: int) -> int:
    """signed to unsigned, small magnitudes first."""
    return (n << 1 ^ n >> 63) & WORD64


def unzigzag(n: int) -> int:
    return n >> 1 ^ -(n & 1)


def varint(n: int) -> bytes:
    """seven bits a byte, low ones first."""
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, next position); truncated, overflowing and padded forms are refused."""
    value = shift = 0
    while True:
        if at >= len(data):
            raise ValueError("truncated varint")
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if value > WORD64 or shift > 63:
            raise ValueError("overflowing varint")
        if byte < 0x80:
            if shift and not byte:
                raise ValueError("non-canonical varint")
            return value, at
        shift += 7


def _wrapped(n: int) -> int:
    return (n + INT64 & WORD64) - INT64


def encode_record(r: Record) -> bytes:
    """version, both translations, the number of seeds, and the sorted seeds as differences."""
    out = [varint(CODEC_VERSION), *(varint(zigzag(x)) for p in (r.t1, r.t2) for x in p), varint(len(r.seeds))]
    last: Point = (0, 0, 0, 0)
    for s in sorted(r.seeds):
        out += [varint(zigzag(_wrapped(x - y))) for x, y in zip(s, last, strict=True)]
        last = s
    return b"".join(out)


def decode_record(data: bytes) -> Record:
    at = 0

    def number() -> int:
        nonlocal at
        value, at = read_varint(data, at)
        return value

    if number() != CODEC_VERSION:
        raise ValueError("unsupported record version")
    t1, t2 = (tuple(unzigzag(number()) for _ in range(4)) for _ in range(2))
    count = number()
    if count > len(data) // 4:
        raise ValueError("invalid seed count")
    seeds: list[Point] = []
    last: Point = (0, 0, 0, 0)
    for _ in range(count):
        s = tuple(_wrapped(y + unzigzag(number())) for y in last)
        if seeds and s < last:
            raise ValueError("non-canonical seed order")
        seeds.append(s)
        last = s
    if at != len(data):
        raise ValueError("trailing bytes in record")
    return Record(t1, t2, tuple(seeds))


def lane_hash(data: bytes) -> bytes:
    """32 bytes of four lanes, each with its own offset a byte."""
    lanes = list(LANES)
    for byte in data:
        for k in range(4):
            lanes[k] = (lanes[k] ^ byte + 0x9D * k) * PRIME & WORD64
    return b"".join(x.to_bytes(8, "little") for x in lanes)


def document_id(fingerprint: str, entry: int) -> bytes:
    """the id of a converted document, from its source's fingerprint and its row."""
    # fixed value: the domain of such ids
    return lane_hash(f"tes-source-v1:{fingerprint}:{entry}".encode())


def legacy_id(name: str, record: Record | None = None, *, domain: bytes) -> bytes:
    """the id of a record under an older name.

    ``domain`` sets it apart from other uses of the hash.  Ids equal those of an existing
    store only under that store's own domain, so there is no default.
    """
    return lane_hash(domain + name.encode() + (encode_record(record) if record else b""))


def framed(parts: Iterable[bytes]) -> Iterable[bytes]:
    """each field behind its length in eight bytes, high ones first."""
    for p in parts:
        yield len(p).to_bytes(8, "big")
        yield p


def fingerprint(entries: Iterable[tuple[int, str, str, str, str]]) -> str:
    """Logical fingerprint of (id, combo, signature, filename, document) rows in id order, whatever their layout."""
    h = hashlib.sha256()
    # fixed values: the domain, format and compression that a fingerprint states
    for x in framed((b"tes-source-fingerprint-v2", b"1", b"zstd")):
        h.update(x)
    for i, *fields in entries:
        for x in framed((i.to_bytes(8, "big", signed=True), *(f.encode() for f in fields))):
            h.update(x)
    return h.hexdigest()


@cache
def _crc_table() -> tuple[int, ...]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0x82F63B78 if i & 1 else 0)
        out.append(i)
    return tuple(out)


def crc32c(data: bytes) -> int:
    """Castagnoli's polynomial."""
    crc, table = 0xFFFFFFFF, _crc_table()
    for byte in data:
        crc = crc >> 8 ^ table[(crc ^ byte) & 0xFF]
    return crc ^ 0xFFFFFFFF


def masked_crc(data: bytes) -> int:
    crc = crc32c(data)
    return (crc >> 15 | crc << 17) + 0xA282EAD8 & 0xFFFFFFFF


def parse_hex_id(text: str) -> bytes:
    """64 lower-case hex digits."""
    if len(text) != 64 or not set(text) <= set("0123456789abcdef"):
        raise ValueError("an id has 64 lower-case hex digits")
    return bytes.fromhex(text)
