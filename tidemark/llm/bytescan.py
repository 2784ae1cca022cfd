"""Vectorised scanning of UTF-8 text straight from Arrow buffers.

Texts are never turned into Python strings here: word boundaries, word hashes
and shingle hashes come from whole-buffer numpy operations, a few nanoseconds a
byte.  Work is cut into chunks of about ``CHUNK`` bytes (a single longer text
is a chunk of its own), so memory follows the chunk, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MARKS = _SPACE.copy()  # everything in ASCII that is neither a letter nor a digit
_MARKS[[c for c in range(128) if not chr(c).isalnum()]] = True

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, grown by doubling and kept."""
    for slot, base in ((0, _BASE), (1, _BASE_INV)):
        table = _powers[slot]
        while len(table) < n:
            step = np.uint64(pow(base, len(table), 1 << 64))
            table = np.concatenate([table, table * step])
        _powers[slot] = table
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def mix_int(x: int) -> int:
    """``mix`` of one Python integer."""
    return int(mix(np.array([x & _MASK], np.uint64))[0])


@dataclass
class Words:
    """Words of a chunk: hashes, and for each document where its words begin."""

    hashes: np.ndarray  #: uint64, one a word
    offsets: np.ndarray  #: int64, documents + 1
    starts: np.ndarray  #: int64, first byte of each word within the chunk
    ends: np.ndarray  #: int64, byte after each word


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1, valid) of a string column; null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    n = len(column)
    valid = np.ones(n, bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    _, offs, data = column.buffers()
    if offs is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), valid
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets, valid


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, document offsets within them) for runs of whole texts."""
    raw, offsets, valid = text_buffers(column)
    n, i = len(valid), 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        part = raw[offsets[i] : offsets[j]]
        bounds = offsets[i : j + 1] - offsets[i]
        if not valid[i:j].all() and len(part):
            lengths = np.where(valid[i:j], np.diff(bounds), 0)
            if int(lengths.sum()) != len(part):  # a null slot that still holds bytes
                part = part[np.repeat(valid[i:j], np.diff(bounds))]
                bounds = np.concatenate([[0], np.cumsum(lengths)])
        yield i, j, part, bounds
        i = j


def words(part: np.ndarray, bounds: np.ndarray, marks_too: bool = False) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, hashed to 64 bits each.

    ``marks_too``: ASCII punctuation and control bytes separate words as well.
    """
    n = len(part)
    if n > 2 * CHUNK:
        return _long_words(part, bounds, marks_too)
    return _bounded_words(part, bounds, marks_too)


def _bounded_words(part: np.ndarray, bounds: np.ndarray, marks_too: bool) -> Words:
    n = len(part)
    if not n:
        return Words(np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    inside = ~(_MARKS if marks_too else _SPACE)[part]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = bounds[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power_tables(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    value = _LOWER[part].astype(np.uint64)
    value += np.uint64(1)
    value *= power
    np.cumsum(value, out=total[1:])
    hashes = (total[ends] - total[starts]) * inverse[starts]
    return Words(mix(hashes), np.searchsorted(starts, bounds).astype(np.int64), starts, ends)


def _long_words(part: np.ndarray, bounds: np.ndarray, marks_too: bool) -> Words:
    """``words`` of a very long text in pieces that end between words, so that tables and intermediate arrays stay small.

    A word's hash does not hang on its place.  Only a single word of more than a
    piece makes a longer piece.
    """
    apart = _MARKS if marks_too else _SPACE
    found: list[Words] = []
    edges = set(bounds.tolist())
    begin = 0
    while begin < len(part):
        end = min(begin + CHUNK, len(part))
        while end < len(part) and not apart[part[end]] and end not in edges:
            end += 1
        inner = bounds[(bounds > begin) & (bounds < end)] - begin
        w = _bounded_words(part[begin:end], np.concatenate([[0], inner, [end - begin]]), marks_too)
        found.append(Words(w.hashes, w.offsets, w.starts + begin, w.ends + begin))
        begin = end
    starts = np.concatenate([w.starts for w in found])
    return Words(np.concatenate([w.hashes for w in found]), np.searchsorted(starts, bounds).astype(np.int64), starts, np.concatenate([w.ends for w in found]))


def word_hash(word: bytes) -> int:
    """The hash that ``words`` gives to one word."""
    part = np.frombuffer(word, np.uint8)
    return int(words(part, np.array([0, len(part)])).hashes[0])


def sequence_hashes(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each document's word sequence (128 bits together)."""
    power, inverse = _power_tables(max(len(w.hashes), 1))
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.zeros(len(w.hashes) + 1, np.uint64)
        np.cumsum(mix(w.hashes ^ np.uint64(salt)) * power[: len(w.hashes)], out=total[1:])
        begin, end = w.offsets[:-1], w.offsets[1:]
        at = np.minimum(begin, max(len(w.hashes) - 1, 0))
        h = (total[end] - total[begin]) * inverse[at]
        out.append(mix(h + (end - begin).astype(np.uint64)))
    return out[0], out[1]


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of k-word shingles in text order, offsets by document).

    A document with 1 to k - 1 words has one shingle, its whole sequence; one
    without words has none.  Repeats are kept.
    """
    counts = np.diff(w.offsets)
    per = np.where(counts == 0, 0, np.maximum(counts - k + 1, 1))
    offsets = np.concatenate([[0], np.cumsum(per)]).astype(np.int64)
    total = int(offsets[-1])
    if not total:
        return np.zeros(0, np.uint64), offsets
    at = np.arange(total, dtype=np.int64) + np.repeat(w.offsets[:-1] - offsets[:-1], per)
    short = np.repeat(counts < k, per)
    padded = np.concatenate([w.hashes, np.zeros(k, np.uint64)])
    h = np.zeros(total, np.uint64)
    width = np.repeat(np.minimum(counts, k), per)
    for j in range(k):
        multiplier = np.uint64(((0xD6E8FEB86659FD93 * (2 * j + 3)) | 1) & _MASK)
        piece = padded[at + j] * multiplier
        if j and short.any():
            piece[j >= width] = 0
        h += piece
        h ^= h >> np.uint64(29)
    return mix(h + width.astype(np.uint64)), offsets


def distinct(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document, and their offsets."""
    out, sizes = [], np.zeros(len(offsets) - 1, np.int64)
    for d in range(len(sizes)):
        part = np.sort(h[offsets[d] : offsets[d + 1]])
        if len(part) > 1:
            part = part[np.concatenate([[True], part[1:] != part[:-1]])]
        out.append(part)
        sizes[d] = len(part)
    return (np.concatenate(out) if out else h[:0]), np.concatenate([[0], np.cumsum(sizes)])
