"""Spelling variants against all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import spelling

DOCS = "doc_id long, text string, word string, id long, n long"


def slips(doc, text):
    for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
        run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
        h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
        if h % 199 == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    count = Counter(w for d, t in rows for w in slips(d, t))
    count = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    out, form = {}, {}
    for w, n in count.items():
        near = [v for v in count if v != w and one_apart(v, w)]
        best = min(near, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= 5 * n else None
        out[w] = (n, len(near), count[best] if form[w] else None)
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, *out[w])
    return out


def got(spark, rows, **how):
    table = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], DOCS)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(spark, table, **how).collect()}


def corpus(seed, count=900):
    rng = np.random.default_rng(seed)
    stems = ["".join(rng.choice(list("abÀÿ"), rng.integers(5, 9))) for _ in range(60)]
    rows = []
    for d in range(count):
        words = [stems[int(len(stems) * rng.random() ** 4)] for _ in range(30)]
        for k in range(len(words)):
            if rng.random() < 0.3:
                w, i = words[k], int(rng.integers(0, len(words[k])))
                words[k] = [w[:i] + w[i + 1 :], w[:i] + "b" + w[i:], w[:i] + "à" + w[i + 1 :]][rng.integers(0, 3)]
        rows.append((d if d % 7 else None, " ".join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in words) + "…9"))
    return rows


@pytest.mark.parametrize("exact", [64, 6, 0])
def test_variants_equal_all_pairs(spark, exact):
    rows = corpus(5)
    want = brute(rows)
    assert len(want) > 300 and sum(v[0] is not None for v in want.values()) > 50 and any(v[1] != v[0] for v in want.values() if v[0])
    assert got(spark, rows, exact=exact) == want


def test_awkward_texts(spark):
    long = "ab" * 30_000
    rows = [(i, t) for i in range(6) for t in (None, "", "12 ;;", "naïveté×÷ naïvete", "NAÏVET", long, long[:-1] + "c", long + "b", long[:-3] + long[-2:])] + [(9, "naïvet " * 4)]
    want = {w: v for w, v in brute([r for r in rows if len(r[1] or "") < 100]).items()}
    found = got(spark, rows)
    assert {w: v for w, v in found.items() if len(w) < 100} == want
    lengthy = sorted((len(w), v[2], v[3]) for w, v in found.items() if len(w) > 100)
    # of the four, the last two are an insertion from the first and one letter from each other's neighbours only where one_apart says so
    words = [w for w in found if len(w) > 100]
    assert lengthy == sorted((len(w), 6, sum(one_apart(w, v) for v in words if v != w)) for w in words) and len(words) >= 3
    assert got(spark, []) == {}


def test_fingerprints_tell_what_strings_tell():
    rng = np.random.default_rng(8)
    words = {"".join(rng.choice(list("ab"), rng.integers(1, 9))) for _ in range(200)}
    for kind in (0, 1):
        same = {}
        for w in words:
            for short, lengthy in zip(spelling.word_keys(w, 64)[kind], spelling.word_keys(w, 0)[kind], strict=True):
                assert same.setdefault(short, lengthy) == lengthy
        assert len(set(same.values())) == len(same)
