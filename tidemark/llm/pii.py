"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns give the base spans.  The field then labels a document's candidate
tokens (white-space separated words that look like one of the kinds, or that
recur where one was found).  Neighbouring candidates share a chain potential.
However far apart, tokens share a skip potential if they are equal once
punctuation is stripped, if they or the base spans that they begin have the same
digits, if they are two edits or fewer apart, or if they have the same shape
after the same word.  Tokens inside base spans are observed.  Loopy sum-product
passes messages until the beliefs settle, so that one form gets one label
throughout a document; tokens believed to be of a kind beyond the base spans
become further spans.

Node weights and the potentials of the five kinds of link, one for each label
that both ends may share, are fitted together by penalised
pseudo-likelihood on a bounded sample of documents labelled by the patterns.
Half of the labelled tokens are masked: their form is hidden, so that their
links must tell.  A token outside the base spans that a skip link ties to one is
no target, as the patterns may have missed it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.store import prepare

KINDS = ("email", "ip", "card", "phone")
SAMPLE_ROWS = 2000  #: distinct texts with candidates learned from, about, chosen by hash of the text
BELIEF = 0.9  #: marginal from which a token becomes a span
ROUNDS = 400  #: of messages, at most, whatever the size of a document; they end when none moves by 1e-6
EDITS = 2
LINKS = ("chain", "equal", "digits", "near", "context")
#: Log potentials that the fit starts from and is drawn to: what the links are taken to mean where a sample says nothing of them.
PRIOR = (0.0, 4.0, 4.0, 0.0, 0.0)

_DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_TRIM = "\"'()[]{}<>,;:!?|"


def _luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if n % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            yield start, done
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            yield m.span()


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start and then kind."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            found += [(a, 1, b) for a, b in _ips(text)]
        found += [(a, 2, b) for a, b in _cards(text)]
        if "+" in text:
            found += [(a, 3, b) for a, b in _phones(text)]
    return sorted(found)


def _bare(token: str) -> str:
    return token.strip(_TRIM).rstrip(".").lower()


def _shape(token: str) -> np.ndarray:
    """Node features of a token's form."""
    bare = _bare(token)
    digits = sum(c in "0123456789" for c in bare)
    return np.array(
        [1.0, "@" in bare[1:], bare.count(".") == 3 and digits >= 4, bare.startswith("+"), digits >= 14, 10 <= digits < 14, 7 <= digits < 10, 0 < digits < 7, digits == len(bare), any(c.isalpha() for c in bare), "." in bare, len(bare) > 30],
        float,
    )


def _looks(token: str) -> bool:
    bare = _bare(token)
    if "@" in bare[1:-1]:
        return True
    digits = sum(c in "0123456789" for c in bare)
    return digits >= 7 and digits >= len(bare) * 0.6 or (bare.count(".") == 3 and digits >= 4 and digits + 3 == len(bare))


def _edits(a: str, b: str, most: int = EDITS) -> int:
    """Edit distance of two forms, or most + 1 if it is above ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def _overlapping(by_kind: list[list[tuple[int, int, int]]], start: int, end: int) -> int:
    """The first base span that overlaps a token; spans of one kind are in order and apart."""
    found = -1
    for spans in by_kind:
        k = bisect_right(spans, start, key=lambda s: s[1])  # the first that ends after the token starts
        if k < len(spans) and spans[k][0] < end:
            found = spans[k][2] if found < 0 else min(found, spans[k][2])
    return found


class Candidates:
    """A document's candidate tokens with their observed labels and their links (i, j, kind of link)."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]) -> None:
        tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
        label: dict[int, int] = {}
        inside = 0
        for start, kind, end in base:
            while inside > 0 and tokens[inside][0] > start:
                inside -= 1
            while inside < len(tokens) and tokens[inside][1] <= start:
                inside += 1
            at = inside
            while at < len(tokens) and tokens[at][0] < end:
                label.setdefault(at, kind)
                at += 1
        forms = {_bare(text[tokens[n][0] : tokens[n][1]]) for n in label}
        whole = {re.sub(r"[^0-9]", "", text[a:b]): a for a, k, b in reversed(base) if k in (2, 3)}
        chosen = [n for n, (a, b) in enumerate(tokens) if n in label or _looks(t := text[a:b]) or (len(f := _bare(t)) >= 6 and f in forms)]
        self.tokens = [tokens[n] for n in chosen]
        self.observed = [label.get(n, -1) for n in chosen]
        self.x = np.array([_shape(text[a:b]) for a, b in self.tokens]) if chosen else np.zeros((0, 12))
        self.bare = [_bare(text[a:b]) for a, b in self.tokens]
        before = [_bare(text[tokens[n - 1][0] : tokens[n - 1][1]]) if n else "" for n in chosen]
        #: the tokens of each base span, which are masked together
        by_kind = [[(s, e, at) for at, (s, k, e) in enumerate(base) if k == kind] for kind in range(len(KINDS))]
        self.span = [_overlapping(by_kind, a, b) if k >= 0 else -1 for (a, b), k in zip(self.tokens, self.observed, strict=True)]
        self.links: list[tuple[int, int, int]] = [(i, i + 1, 0) for i in range(len(chosen) - 1) if chosen[i] + 1 == chosen[i + 1]]
        linked = {(i, j) for i, j, _ in self.links}

        def link(i: int, j: int, kind: int) -> None:
            if i != j and (i, j) not in linked and (j, i) not in linked:
                linked.add((i, j))
                self.links.append((i, j, kind))

        # stars and runs: as many links as tokens, however often one recurs
        first: dict[str, int] = {}
        for i, f in enumerate(self.bare):
            if len(f) >= 3:
                link(first.setdefault(f, i), i, 1)
        at = {a: i for i, (a, _) in enumerate(self.tokens)}
        digits: dict[str, int] = {d: at[a] for d, a in whole.items() if len(d) >= 7 and a in at}
        for i, f in enumerate(self.bare):
            if len(d := re.sub(r"[^0-9]", "", f)) >= 7:
                link(digits.setdefault(d, i), i, 2)
        near: dict[tuple, int] = {}
        for f, i in first.items():
            if len(f) >= 8:
                third = len(f) // 3
                # two edits leave one of three parts whole
                for key in (("a", f[:third]), ("b", f[third : len(f) - third]), ("c", f[len(f) - third :])):
                    j = near.get(key)
                    if j is not None and self.bare[j] != f and _edits(self.bare[j], f) <= EDITS:
                        link(j, i, 3)
                    near[key] = i
        alike: dict[tuple[str, str], int] = {}
        for i, f in enumerate(self.bare):
            key = (re.sub(r"[a-z]+", "a", re.sub(r"[0-9]", "9", f)), before[i])
            if before[i]:
                link(alike.get(key, i), i, 4)
                alike[key] = i


class Field:
    """Node weights [features, kinds + 1] and log potentials [kinds of link, kinds + 1] of agreeing on a label; label 4 is none."""

    def __init__(self, documents: list[Candidates], steps: int = 400) -> None:
        n = len(KINDS) + 1
        self.weights = np.zeros((12, n))
        self.weights[0, n - 1] = 2.0
        self.links = np.repeat(np.array(PRIOR)[:, None], n, 1)
        x, y, masked, target, ends, kinds = [], [], [], [], [], []
        shift = 0
        for number, d in enumerate(documents):
            tied = {a for i, j, k in d.links if k for a, b in ((i, j), (j, i)) if d.observed[a] < 0 <= d.observed[b]}
            for i, k in enumerate(d.observed):
                x.append(d.x[i])
                y.append(k if k >= 0 else n - 1)
                masked.append(k >= 0 and (number + max(d.span[i], 0)) % 2 == 0 or k < 0 and (number + i) % 2 == 0)
                target.append(i not in tied)
            ends += [(i + shift, j + shift) for i, j, _ in d.links]
            kinds += [k for *_, k in d.links]
            shift += len(d.observed)
        if not any(target):
            return
        x, y = np.array(x), np.array(y)
        x[np.array(masked), 1:] = 0.0
        use = np.array(target, float)
        agree = np.zeros((len(LINKS), len(y), n))  # how many neighbours of each kind have each label
        for (i, j), k in zip(ends, kinds, strict=True):
            if target[j]:
                agree[k, i, y[j]] += 1
            if target[i]:
                agree[k, j, y[i]] += 1
        truth = np.eye(n)[y] * use[:, None]
        start, prior = self.weights.copy(), self.links.copy()
        w, a = self.weights, self.links
        mw, vw, ma, va = np.zeros_like(w), np.zeros_like(w), np.zeros_like(a), np.zeros_like(a)
        for step in range(1, steps + 1):  # Adam on the penalised pseudo-likelihood
            z = x @ w + np.einsum("kj,kij->ij", a, agree)
            p = np.exp(z - z.max(1, keepdims=True))
            p *= use[:, None] / p.sum(1, keepdims=True)
            gw = x.T @ (p - truth) + 0.1 * (w - start)
            ga = np.einsum("kij,ij->kj", agree, p - truth) + 1.0 * (a - prior)
            mw, vw, ma, va = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw * gw, 0.9 * ma + 0.1 * ga, 0.99 * va + 0.01 * ga * ga
            rate = 0.1 / (1 + step / 100)
            w = w - rate * (mw / (1 - 0.9**step)) / (np.sqrt(vw / (1 - 0.99**step)) + 1e-8)
            a = a - rate * (ma / (1 - 0.9**step)) / (np.sqrt(va / (1 - 0.99**step)) + 1e-8)
        self.weights, self.links = w, a

    def beliefs(self, d: Candidates) -> np.ndarray:
        """[tokens, kinds + 1] marginals after loopy sum-product."""
        n = len(KINDS) + 1
        z = d.x @ self.weights
        unary = np.exp(np.clip(z - z.max(1, keepdims=True), -40, 0)) if len(z) else z
        unary /= unary.sum(1, keepdims=True)
        for i, k in enumerate(d.observed):
            if k >= 0:
                unary[i] = 1e-12
                unary[i, k] = 1.0
        if not d.links:
            return unary
        ends = np.array([(i, j) for i, j, _ in d.links])
        src, dst = ends.reshape(-1), ends[:, ::-1].reshape(-1)
        strength = np.exp(np.repeat(self.links[[k for *_, k in d.links]], 2, axis=0))
        back = np.arange(len(src)) ^ 1
        message = np.full((len(src), n), 1.0 / n)
        damping = 0.0
        for number in range(ROUNDS):
            log = np.log(message)
            total = np.log(unary)
            np.add.at(total, dst, log)
            out = total[src] - log[back]
            out = np.exp(out - out.max(1, keepdims=True))
            new = out.sum(1, keepdims=True) + (strength - 1) * out
            new /= new.sum(1, keepdims=True)
            moved = np.abs(new - message).max()
            message = damping * message + (1 - damping) * new
            if moved < 1e-6:
                break
            damping = 0.5 if number > 20 else 0.0  # loops that swing
        total = np.log(unary)
        np.add.at(total, dst, np.log(message))
        total = np.exp(total - total.max(1, keepdims=True))
        return total / total.sum(1, keepdims=True)

    def more_spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans beyond the base ones: tokens whose belief in one kind reaches BELIEF."""
        if not base and "@" not in text and not _DIGIT.search(text):
            return []
        d = Candidates(text, base)
        if all(k >= 0 for k in d.observed):
            return []
        out = []
        belief = self.beliefs(d)
        for i, (a, b) in enumerate(d.tokens):
            kind = int(belief[i].argmax())
            if d.observed[i] >= 0 or kind == len(KINDS) or belief[i, kind] < BELIEF:
                continue
            token = text[a:b]
            left = len(token) - len(token.lstrip(_TRIM))
            right = len(token.rstrip(_TRIM + "."))
            if right > left:
                out.append((a + left, kind, a + right))
        return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def train(spark: SparkSession, docs: DataFrame) -> Field:
    """A field fitted on a bounded hash sample of the distinct texts that hold digits or an at sign."""
    usable = docs.where(F.col("text").isNotNull() & F.col("text").rlike("[0-9]{7}|@|[0-9]\\.[0-9]+\\.[0-9]"))
    n = usable.agg(F.approx_count_distinct("text")).first()[0]
    span = 1 << 30
    limit = int(min(1.0, SAMPLE_ROWS / max(n, 1)) * span)
    # by text, so that copies and rows of one doc_id, however many, are one candidate
    rows = usable.where(F.pmod(F.xxhash64("text", F.lit(29)), F.lit(span)) < limit).select("text").distinct().toArrow().column(0).to_pylist()
    return Field([Candidates(t, base_spans(t)) for t in sorted(rows)])


def find(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of ``docs`` (doc_id, text, ...).

    Positions count code points, ends are exclusive.  Counts and base_sha256
    cover the base spans, ``spans`` all of them, each by start and then kind.
    Defined cases: null and empty texts have no spans, and the hash of the empty
    string; spans of different kinds may overlap; equal rows give equal results;
    further columns are ignored.
    """
    prepare(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    field = spark.sparkContext.broadcast(train(spark, source))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digest, spans = [], [], []
            for x in batch.column(1):
                text = x.as_py() or ""
                base = base_spans(text)
                count = Counter(k for _, k, _ in base)
                counts.append([count[k] for k in range(4)])
                digest.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(sorted([*base, *field.value.more_spans(text, base)])))
            table = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(table[:, k]) for k in range(4)), pa.array(digest), pa.array(spans)], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return source.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
