"""Main text of web pages from flat text blocks.

A page is read once into flat blocks: runs of text between block-level tags.
Each block is described by its word count and link density, those of the blocks
before and after it, and what its surroundings say of themselves: element
names, ARIA roles and names of frame parts (``role``), and, outside of what is
marked as the article, weaker class names (``hint``).  A decision tree, grown on
the blocks of a small labelled table in this module, tells article blocks from
the rest.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.store import prepare

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<(script|style|textarea)\b(?:\"[^\"]*+\"|'[^']*+'|[^'\">]++){0,999}+>(?:.*?</\1\s*>|.*)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*+\"|'[^']*+'|[^'\">]++){0,999}+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>"
    r"|<[!?/][^>]*+>"
    r"|[^<]++|<",
    re.S | re.I,
)
_UNENDED = re.compile(r"<[a-zA-Z/!?]")
#: A whole attribute: its name, and its value however it is quoted, so that no name is seen inside another or inside a value.
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
SKIPPED = frozenset("noscript template select svg math iframe object head title".split())  #: with all that they hold, up to their own end tags
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
ASIDE_TAGS = frozenset("nav aside footer form button dialog menu fieldset label legend details".split())
CHOICES = frozenset(["option", "optgroup"])  #: never shown as text
MAIN_TAGS = frozenset(["article", "main"])
#: Names of frame parts; a class or id counts as a whole: each of its parts must be one of these or of the next two lists.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored sponsors promo promotion promoted menu nav navbar navigation topnav sidebar sidenav aside rail footer masthead topbar comment comments commentlist disqus discussion reply replies cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup login signin share sharing related recommended recommendations widget widgets breadcrumb breadcrumbs pagination pager toolbar tagcloud paywall".split()
)
#: Names that frame parts and articles both bear: a hint outside the article, nothing inside it.
WEAK_WORDS = frozenset("header foot side social search register respond response responses alert legal copyright disclaimer skip hidden toc byline meta form poll survey teaser feedback links tags contact about".split())
FRAME_WORDS = frozenset("site page main global top bottom left right primary secondary post article entry story content box block section area list item inner outer wrapper wrap container row col column bar slot the module panel thread body text title head heading link button icon js no".split())
MAIN_WORDS = frozenset("article post entry story content main prose maincontent articlebody bodytext".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())


@lru_cache(4096)
def _named(name: str) -> int:
    """Of one class or id: -2 a frame part, -1 perhaps one, 1 perhaps the article, 0 says nothing."""
    parts = _PART.findall(_CAMEL.sub("-", name).lower())
    whole = "".join(parts)
    if whole in ASIDE_WORDS:
        return -2
    if not parts or not all(p in ASIDE_WORDS or p in WEAK_WORDS or p in FRAME_WORDS or p in MAIN_WORDS for p in parts):
        return 1 if whole in MAIN_WORDS else 0
    if any(p in ASIDE_WORDS for p in parts):
        return -2
    if any(p in WEAK_WORDS for p in parts):
        return -1
    return int(any(p in MAIN_WORDS for p in parts))


def _role(tag: str, attributes: str, above: tuple[int, int]) -> tuple[int, int] | None:
    """(role, hint), each -1 beside the article, 1 in it, 0 unknown; None: not shown.  Without a sign of its own an element is as its parent."""
    if tag in CHOICES:
        return None
    parent, hint = above
    named, stated = 0, 0
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key = m[1].lower()
            if key == "hidden":
                return None
            value = m[2] or m[3] or m[4] or ""
            if (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _UNSEEN.search(value)):
                return None
            if key == "role":
                stated = -1 if value.lower() in ASIDE_ROLES else 1 if value.lower() in ("main", "article") else stated
            elif key in ("class", "id") and tag not in ("html", "body"):
                found = [_named(x) for x in value.split()]
                named = min([named, *found]) if min(found, default=0) < 0 else max([named, *found]) if named >= 0 else named
    if parent == -1 or stated == -1 or named == -2:
        return -1, -1
    if stated == 1 or tag in MAIN_TAGS:
        return 1, 1
    if tag in ASIDE_TAGS or (tag == "header" and parent != 1):
        return -1, -1
    return parent, hint if parent == 1 or named == 0 else named


def _skips(tokens: list[re.Match]) -> dict[int, int]:
    """{start tag: end tag} of the SKIPPED elements, by place among the tokens.  Without an end tag of its own an element is only its start tag."""
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    held: Counter[str] = Counter()
    for at, m in enumerate(tokens):
        tag = m[3] or m[6]
        if tag is None:
            continue
        tag = tag.lower()
        if (m[2] or m[5]) == "/":
            if held[tag]:  # those opened inside it have no end tag
                while True:
                    name, start = stack.pop()
                    held[name] -= 1
                    if name == tag:
                        break
                out[start] = at
        elif tag in SKIPPED:
            if not (tag in ("svg", "math") and (m[4] or m[7] or "").endswith("/")):
                stack.append((tag, at))
                held[tag] += 1
        elif stack and tag in BLOCKS and stack[-1][0] == "head":  # text and its elements end the head
            stack.pop()
            held["head"] -= 1
    return out


def blocks(page: str) -> list[tuple[str, int, int, int, int, int]]:
    """(text, words, words in links, role, hint, heading) of each block of a page, in order; blocks without text are left out."""
    out: list[tuple[str, int, int, int, int, int]] = []
    stack: list[tuple[str, tuple[int, int] | None]] = [("", (0, 0))]
    pieces: list[str] = []
    linked: list[str] = []
    link_depth = 0
    untold = False  # in the text of a title without an end tag

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            words = "".join(pieces).split()
            if words and stack[-1][1] is not None:
                tag = stack[-1][0]
                out.append((" ".join(words), len(words), min(len(words), sum(len(x.split()) for x in linked)), *stack[-1][1], int(len(tag) == 2 and tag[0] == "h" and tag[1] in "123456")))
            pieces, linked = [], []

    # past the last ">" no tag ends: what has begun there is dropped, so that every "<" ahead finds an end
    last = page.rfind(">") + 1
    open_tag = _UNENDED.search(page, last)
    tokens = [*_TOKEN.finditer(page, 0, last), *_TOKEN.finditer(page, last, open_tag.start() if open_tag else len(page))]
    skips = _skips(tokens)
    resume = 0
    for at, m in enumerate(tokens):
        if at < resume:
            continue
        token = m[0]
        if token[0] != "<" or token == "<":
            if untold:
                continue
            text = html.unescape(token) if "&" in token else token
            pieces.append(text)
            if link_depth:
                linked.append(text)
            continue
        tag = m[3] or m[6]
        untold = False
        if tag is None:
            if m[1]:
                pieces.append(" ") if m[1].lower() != "script" and pieces else None
            continue
        tag, closing = tag.lower(), (m[2] or m[5]) == "/"
        if tag in SKIPPED:
            if pieces:
                pieces.append(" ")
            resume = skips.get(at, at) + 1
            untold = tag == "title" and not closing and at not in skips
            continue
        if tag in ("br", "hr"):
            pieces.append(" ")
            if tag == "br":
                continue
        if tag == "a":
            link_depth = 0 if closing else len(stack)
            continue
        if tag not in BLOCKS:
            continue
        flush()
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    del stack[depth:]
                    break
            if link_depth > len(stack):
                link_depth = 0
        elif tag not in VOID:
            while len(stack) > 1 and (stack[-1][0] in _SELF_CLOSING.get(tag, ()) or (stack[-1][0] == "p" and tag != "p") or (stack[-1][0] in CHOICES and tag not in CHOICES)):
                stack.pop()
            above = stack[-1][1]
            stack.append((tag, None if above is None else _role(tag, m[4] or m[7] or "", above)))
            if link_depth > len(stack):
                link_depth = 0
    flush()
    return out


FEATURES = ("role", "hint", "page_has_main", "page_has_hint", "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "heading")


def features(found: list[tuple[str, int, int, int, int, int]]) -> np.ndarray:
    """One row a block, columns as FEATURES; before the first and after the last block stands one of no words."""
    x = np.zeros((len(found), len(FEATURES)))
    if not found:
        return x
    words, linked, role, hint, heading = np.array([b[1:] for b in found], float).T
    density = linked / words
    x[:, :6] = np.stack([role, hint, np.full(len(x), (role > 0).any()), np.full(len(x), (hint > 0).any()), words, density], 1)
    x[1:, 6], x[1:, 7] = words[:-1], density[:-1]
    x[:-1, 8], x[:-1, 9] = words[1:], density[1:]
    x[:, 10] = heading
    return x


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 3):
    """A decision tree by Gini impurity: a float (share of label 1) or (feature, threshold, at most, above)."""
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return share
    best = (2 * share * (1 - share) * len(y) - 1e-9, None, None)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        value, ones = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(value[1:] > value[:-1])  # a cut after each of these
        at = at[(at + 1 >= least) & (len(y) - at - 1 >= least)]
        if not len(at):
            continue
        n, k = at + 1.0, ones[at]
        m, j = len(y) - n, ones[-1] - k
        impurity = 2 * k * (1 - k / n) + 2 * j * (1 - j / m)
        low = int(np.argmin(impurity))
        if impurity[low] < best[0]:
            best = (float(impurity[low]), f, float((value[at[low]] + value[at[low] + 1]) / 2))
    if best[1] is None:
        return share
    below = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[below], y[below], depth - 1, least), grow(x[~below], y[~below], depth - 1, least)


def _decide(tree, row) -> float:
    while not isinstance(tree, float):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


_WORDS = "the committee met on tuesday and agreed that new rules for small boats should apply from next spring after a long debate about costs".split()


def labelled_pages(count: int = 240, seed: int = 20240701) -> list[str]:
    """The labelled table: pages whose article blocks hold the mark §, laid out in the three ways that pages are.

    One third marks the article by elements, one third by class names, one third
    not at all; frames hold menus, notices, comments, footers and adverts.
    """
    rng = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join(rng.choice(_WORDS) for _ in range(rng.randint(low, high)))

    def link(low: int, high: int) -> str:
        return f"<a href='/x'>{words(low, high)}</a>"

    def menu() -> str:
        return "".join(f"<li>{link(1, 4)}</li>" for _ in range(rng.randint(3, 8)))

    def article() -> str:
        out = [rng.choice(["h1", "h2"])]
        out[0] = f"<{out[0]}>§{words(2, 9)}</{out[0]}>"
        for _ in range(rng.randint(3, 9)):
            kind = rng.random()
            if kind < 0.6:
                out.append(f"<p>§{words(18, 90)}</p>")
            elif kind < 0.75:
                out.append(f"<p>§{words(1, 9)}</p><p>§{words(20, 70)}</p>")
            elif kind < 0.85:
                out.append(f"<p>§{words(15, 50)} {link(1, 6)}.</p>")
            elif kind < 0.92:
                out.append(f"<p>§{words(14, 40)}</p><p>{link(1, 1).replace('>', '>§', 1)}</p><p>§{words(14, 40)}</p>")
            elif kind < 0.96:
                out.append(f"<ul><li>§{words(6, 20)}</li><li>§{words(6, 20)}</li></ul><p>§{words(20, 60)}</p>")
            else:
                out.append(f"<ul>{menu()}</ul><p>§{words(20, 60)}</p>")  # a menu within the article
        return "".join(out)

    def frame(name: str, tag: str) -> str:
        text = rng.choice([words(4, 70), words(8, 40), f"{words(2, 9)} {link(1, 4)} {words(2, 8)}", f"{link(1, 3)} | {link(1, 3)} | {link(1, 3)}", words(1, 6)])
        more = f"<p>{words(3, 60)}</p>" if rng.random() < 0.5 else ""
        return f"<{tag} class='{name}'><p>{text}</p>{more}</{tag}>" if name else f"<{tag}><p>{text}</p>{more}</{tag}>"

    def line() -> str:
        """A short line of a frame that nothing marks."""
        return rng.choice([f"<div>{words(1, 5)}</div>", f"<div>{link(1, 3)}</div>", f"<p>{link(1, 3)} | {link(1, 3)}</p>", f"<div>{words(1, 3)} {link(1, 3)}</div>", f"<p>{words(2, 8)} {link(2, 5)} {link(1, 4)}</p>"])

    names = ["cookie-notice", "comments", "sidebar", "footer", "ad", "share-box", "newsletter", "comment-list", "banner"]
    pages = []
    for n in range(count):
        chrome = [frame(rng.choice(names), "div") for _ in range(rng.randint(2, 5))]
        rng.shuffle(chrome)
        cut = rng.randint(0, len(chrome))
        if n % 3 == 0:
            tag = rng.choice(["article", "main"])
            loose = "".join(rng.choice([line(), f"<div>{words(5, 60)}</div>"]) for _ in range(rng.randint(0, 3)))
            body = f"<nav><ul>{menu()}</ul></nav>{''.join(chrome[:cut])}<{tag}>{article()}</{tag}>{loose}{frame('', rng.choice(['footer', 'aside', 'form']))}{''.join(chrome[cut:])}"
        elif n % 3 == 1:
            weak = rng.choice(sorted(WEAK_WORDS))
            loose = f"<div class='{weak}'>{words(1, 9)}</div><div class='{weak}'>{words(1, 4)} {link(1, 4)}</div>"
            body = f"<ul>{menu()}</ul>{''.join(chrome[:cut])}{loose}<div class='{rng.choice(sorted(MAIN_WORDS))}'>{article()}</div>{''.join(line() for _ in range(rng.randint(0, 3)))}{''.join(chrome[cut:])}"
        else:
            lines = ["".join(line() for _ in range(rng.randint(1, 5))) for _ in range(2)]
            weak = f"<div class='{rng.choice(sorted(WEAK_WORDS))}'><p>§{words(20, 70)}</p></div>" if rng.random() < 0.3 else ""
            lists = f"<ul>{menu()}</ul>" if rng.random() < 0.7 else ""
            body = f"{lists}{lines[0]}{''.join(chrome[:cut]) if n % 2 else ''}{article()}{weak}{f'<p>§{words(15, 60)}</p>'}{lines[1]}{''.join(chrome[cut:]) if n % 2 else ''}"
        pages.append(f"<body>{body}</body>")
    return pages


@lru_cache(1)
def model():
    """The tree grown on the labelled table."""
    found = [blocks(page) for page in labelled_pages()]
    return grow(np.concatenate([features(f) for f in found]), np.array([float("§" in b[0]) for f in found for b in f]))


def shown(tree, depth: int = 0) -> str:
    """The tree as indented lines."""
    pad = "  " * depth
    if isinstance(tree, float):
        return f"{pad}{tree:.2f}\n"
    return f"{pad}{FEATURES[tree[0]]} <= {tree[1]:g}\n{shown(tree[2], depth + 1)}{pad}else\n{shown(tree[3], depth + 1)}"


def main_text(page: str | None, tree=None) -> str:
    """The article's blocks, each with white space as single spaces, joined by one space; empty for null."""
    if not page:
        return ""
    found = blocks(page)
    tree = tree or model()
    return " ".join(b[0] for b, row in zip(found, features(found).tolist(), strict=True) if _decide(tree, row) >= 0.5)


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html, ...).

    Defined cases: null or empty html gives an empty text and 0 characters, as
    does a page without article blocks; unclosed or stray tags end where their
    surroundings do; repeated rows give equal rows; further columns are ignored.
    """
    prepare(spark)
    tree = model()  # grown once, here; it travels with the function

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(x.as_py(), tree) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
