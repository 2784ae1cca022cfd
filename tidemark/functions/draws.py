"""Random draws as a function of seed, stream and counter, the same in numpy and in SQL.

A stream is 32 bits of a digest of seed and names; the n-th draw of a stream is
a mixed multiple of n added to it.  No draw depends on another, so draws can be
dealt over tasks in any way, and repeat in any engine with integers.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: The step of counters and the multipliers of a 32-bit integer mixer.
STEP, FIRST, SECOND = 0x9E3779B9, 0x7FEB352D, 0x846CA68B


def stream(*parts: object) -> int:
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def hashes(streams: np.ndarray | int, counters: np.ndarray) -> np.ndarray:
    """uint32 draws; streams and counters are broadcast."""
    x = (np.asarray(streams, np.uint64) + np.asarray(counters, np.uint64) * np.uint64(STEP)).astype(np.uint32)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(FIRST)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(SECOND)
    return x ^ (x >> np.uint32(16))


def below(h: np.ndarray, n: int) -> np.ndarray:
    """Integers from 0 to n - 1."""
    return (h.astype(np.uint64) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def stream_sql(*parts: str) -> str:
    """Of SQL expressions of strings or integers."""
    return "(('0x' || substr(md5(" + " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "), 1, 8))::BIGINT)"


def hash_sql(stream: str, counter: str) -> str:
    """The draw of a stream at a counter, both SQL integers; steps are bound one in another."""

    def times(c: int) -> str:  # the product modulo 2^32, in halves, within 64 bits
        return f"lambda v: ((((v >> 16) * {c} & 65535) << 16) + (v & 65535) * {c}) & 4294967295"

    def shifted(n: int) -> str:
        return f"lambda v: xor(v, v >> {n})"

    out = f"[(({stream}) + ({counter})::BIGINT * {STEP}) & 4294967295]"
    for step in (shifted(16), times(FIRST), shifted(15), times(SECOND), shifted(16)):
        out = f"list_transform({out}, {step})"
    return f"({out})[1]"


def below_sql(h: str, n: str) -> str:
    return f"(({h}) * ({n}) >> 32)"
