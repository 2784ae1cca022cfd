"""The prefix trie against one built by hand, with collisions forced on it."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefixes

TURNS = "conv_id long, turn long, role string, text string, pos long, f long, depth long"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], TURNS)


def brute(rows, draw=4):
    """Ties of turn do not occur in rows, or are equal rows."""
    own = defaultdict(list)
    for conv, _, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[conv].append((role or "", text or ""))
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % draw
        base = c - int(np.fmod(c, 20))
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    for path, ids in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += (len(ids) - 1) * words
    out = []
    for path, ids in members.items():
        ends = ",".join(str(c) for c in ids if built[c] == path)
        out.append((ids[0], len(path), members[path[:-1]][0] if path else None, len(ids), kids.get(path, 0), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **how):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in prefixes.trie(spark, table(spark, rows), **how).select(*cols).collect()), key=str)


def corpus(seed, convs=90, longest=9):
    rng = np.random.default_rng(seed)
    rows = []
    for c in [*range(-25, convs), 10**12]:
        if rng.random() < 0.15:
            continue
        n = int(rng.integers(1, longest))
        for k in range(n):
            rows.append((c, [None, *range(1, 40)][k], [None, "", "user", "bot"][rng.integers(0, 4)], ["a b", " c\td ", "", None, "é f"][min(4, int(5 * rng.random() ** 2))]))
    rng.shuffle(rows)
    return [(None if r[0] is None else int(r[0]), None if r[1] is None else int(r[1]), r[2], r[3]) for r in rows]


def test_trie_equals_one_built_by_hand(spark):
    rows = corpus(3) + [(None, 1, "user", "x"), (41, 50, "bot", "same"), (41, 50, "bot", "same")]
    want = brute(rows)
    assert any(n > 3 and d > 2 for _, d, _, n, *_ in want) and got(spark, rows) == want
    assert got(spark, rows, draw=1) == brute(rows, draw=1)
    assert got(spark, []) == [] and got(spark, [(None, 1, "user", "x")]) == []


@pytest.mark.parametrize("kind", ["fingerprints", "turns", "both"])
def test_collisions_are_split(spark, kind):
    rows = corpus(4, convs=60)
    how = {} if kind == "turns" else {"primes": (3, 2)}
    if kind != "fingerprints":
        how["digest"] = lambda role, text: F.length(text) % 2
    seen = []
    keep = prefixes._split
    prefixes._split = lambda *a: seen.append(1) or keep(*a)
    try:
        assert got(spark, rows, **how) == brute(rows)
    finally:
        prefixes._split = keep
    assert bool(seen) == (kind != "turns")


def test_turnless_and_long_conversations(spark):
    # conversations of one turn without a base may keep none; one conversation is cut by every range
    rows = [(c, 1, "user", "x y") for c in range(101, 119)] + [(200, k, "u", f"t{k % 7}") for k in range(2500)] + [(201, k, "u", f"t{k % 7}") for k in range(2300)]
    want = brute(rows)
    assert any(d == 0 and e != hashlib.sha256(b"").hexdigest() for _, d, *_, e in want)
    assert got(spark, rows) == want


def test_scan_and_exchange_of_fingerprints():
    lanes = prefixes.Lanes()
    rng = np.random.default_rng(1)
    t, v = rng.integers(-(2**62), 2**62, 40), rng.integers(0, 3, 40)
    at = np.r_[np.arange(17), np.arange(23)]
    f = lanes.pack(lanes.scan(lanes.turns(t, v), at))
    for lane, p, base in ((0, *[(int(lanes.primes[0]), int(lanes.bases[0]))][0]), (1, int(lanes.primes[1]), int(lanes.bases[1]))):
        value, turns = 0, lanes.turns(t, v)[lane]
        for k in range(40):
            value = (0 if at[k] == 0 else value) * base + int(turns[k])
            value %= p
            assert int(lanes.unpack(f)[lane][k]) == value
    above = lanes.pack(lanes.before(lanes.unpack(f), lanes.turns(t, v)))
    assert (above[1:17] == f[:16]).all() and above[0] == 0 and above[17] == 0


def test_ids_of_a_node_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "PACK", 100)
    rows = [(c, 1, "u", "hello") for c in range(-3, 3000)]
    assert got(spark, rows, draw=1) == brute(rows, draw=1)
