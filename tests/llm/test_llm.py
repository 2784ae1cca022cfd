"""The training-data operators against brute force, on small tables with awkward rows."""

import math
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bytescan, decontaminate, extract, licenses, minhash, mixing, neighbours, pii, ppm, tokens, toxicity
from tidemark.llm.components import connected_components
from tidemark.llm.store import Workspace

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, bands string"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def awkward(spark, texts, start=0):
    """Rows with clashing further columns."""
    return spark.createDataFrame([(n + start, t, "en", "s", 0, 7, "x") for n, t in enumerate(texts)], DOCS)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def least_reachable(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- shared parts


def test_word_hashes_know_boundaries():
    texts = ["Ab cd", "", "cd\tAB\n", "ab", "x" * 5000, "é Ö"]
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    w = bytescan.words(np.frombuffer(b"".join(raw), np.uint8), bounds)
    got = [w.hashes[w.offsets[i] : w.offsets[i + 1]].tolist() for i in range(len(texts))]
    assert got == [[bytescan.word_hash(x.lower().encode() if x.isascii() else x.encode()) for x in t.split()] for t in texts]


@pytest.mark.parametrize("marks", [False, True])
def test_long_texts_are_scanned_in_pieces(monkeypatch, marks):
    rng = np.random.default_rng(61)
    raw = bytes(rng.choice(list(b"abAB ,.\t\n\xc3\xa9"), 4000).tolist()) + b"x" * 900 + b" y"
    bounds = np.array([0, 0, 37, 1200, 1200, 3333, len(raw)])
    part = np.frombuffer(raw, np.uint8)
    whole = bytescan.words(part, bounds, marks)
    monkeypatch.setattr(bytescan, "CHUNK", 100)
    cut = bytescan.words(part, bounds, marks)
    assert all((getattr(whole, a) == getattr(cut, a)).all() for a in ("hashes", "offsets", "starts", "ends")) and len(whole.hashes) > 500


def test_components_of_paths_stars_and_noise(spark):
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(200, 200 + i) for i in range(1, 50)] + [(int(a), int(b)) for a, b in rng.integers(300, 400, (90, 2))] + [(5, 5), (8, 7), (7, 8)]
    got = dict(connected_components(Workspace(spark, "t"), spark.createDataFrame(links, "u long, v long")).collect())
    want = least_reachable({x for e in links for x in e}, links)
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in links)}
    assert connected_components(Workspace(spark, "t"), spark.createDataFrame([], "u long, v long")).count() == 0


# --- 1 extraction


def test_main_text_leaves_the_frame_out():
    page = """<html><head><title>T</title><script>var a="</p>";</script></head><body class="post"><header>Site</header>
    <div id="sideBar"><p>Popular things here now</p></div><nav><ul><li><a href=/>Home</a></li></ul></nav>
    <article><header><h1>Big &amp; small</h1></header><p>One  two<br>three <b>fo</b>ur.<p>Five<!-- x --> six
    <aside>Buy this</aside><div class="share-box">Share</div><ul><li>a<li>b</ul><section class="comments"><article>I disagree with it</article></section>
    <form>Mail <input></form></article><footer>&copy; me</footer></body></html>"""
    assert extract.main_text(page) == "Big & small One two three four. Five six a b"
    assert extract.main_text(None) == extract.main_text("") == ""
    assert extract.main_text("<p>" * 5000) == ""


def test_extraction_without_an_article_element():
    body = " ".join(["word"] * 60)
    page = f"<body><p><a href='/'>Home</a> | <a href='/b'>B</a></p><div>{body}</div><div>{body}.</div><p><a href='/x'>Terms</a></p></body>"
    assert extract.main_text(page) == f"{body} {body}."


@pytest.mark.parametrize("tag", "head template select svg math iframe object noscript title".split())
def test_elements_without_an_end_tag_do_not_swallow_the_article(tag):
    body = "<article><p>One two three.</p><p>Four five six.</p></article>"
    text = "One two three. Four five six."
    assert extract.main_text(f"<html><body><{tag}>{body}</body></html>") == text
    assert extract.main_text(f"<html><body><div><{tag}></div>{body}<{tag}>hidden words</{tag}></body></html>") == text
    assert extract.main_text(f"<html><body><{tag}><p>hidden words</p></{tag}>{body}</body></html>") == text


def test_an_open_head_ends_at_the_body():
    rest = "<article><p>One two three.</p></article>"
    for page in (f"<head><title>x</title><body>{rest}", f"<head><meta charset=a><title>x{rest}", f"<head><title>x</title>{rest}</head>", f"<head><title>x</title><style>p{{}}</style></head><body>{rest}"):
        assert extract.main_text(page) == "One two three."
    assert extract.main_text("<article><p>a b<select><option>c<option>d<p>e f<svg/>g<svg><svg></svg>h</svg> i</article>") == "a b e f g i"


def test_frames_of_a_page_without_an_article_element_go():
    long = "the committee met on tuesday and agreed that new rules for small boats should apply from next spring after a long debate"
    frame = "".join(f"<{tag}><p>{long} {long}</p><p>{long}</p></{tag.split()[0]}>" for tag in ("div class='cookie-notice'", "div class='comments'", "footer", "aside", "div id='sideBar'", "div class='site-footer'", "form"))
    assert extract.main_text(f"<body><h1>Small boats</h1><div>{long}</div><div>{long}.</div>{frame}</body>") == f"Small boats {long} {long}."


def test_names_count_as_a_whole_and_elements_before_them():
    page = "<article><p class='social-policy'>One two.</p><div id='legal-history'>Three.</div><div class='register'>Four five.</div><div class='comments'>I object.</div></article>"
    assert extract.main_text(page) == "One two. Three. Four five."
    assert extract.main_text("<main><h1>Title here</h1></main><article class='response'><p>One two.</p></article>") == "Title here One two."


def test_attribute_names_are_read_at_their_boundaries():
    page = "<article><p title='a hidden gem'>One.</p><p data-hidden=\"false\">Two.</p><p hidden>No.</p><p data-class='ad' class=\"x\">Three.</p><p style='display: none'>No.</p><p title=\"x class='ad' y\">Four.</p></article>"
    assert extract.main_text(page) == "One. Two. Three. Four."


def test_the_tree_uses_neighbours_and_tells_frames_from_the_unknown():
    shown = extract.shown(extract.model())
    assert all(name in shown for name in ("words_before", "words_after", "link_density_before", "role <= -0.5", "hint"))
    right = total = 0
    for page in extract.labelled_pages(60, seed=5):  # pages that the tree was not grown on
        found = extract.blocks(page)
        said = [extract._decide(extract.model(), row) >= 0.5 for row in extract.features(found).tolist()]
        right, total = right + sum(a == ("§" in b[0]) for a, b in zip(said, found, strict=True)), total + len(found)
    assert right / total > 0.98
    # the same short block between long texts and between short lines
    long = " ".join(["word"] * 40)
    between = f"<p>{long}</p><p>Nobody did.</p><p>{long}</p>"
    assert "Nobody did." in extract.main_text(f"<body>{between}</body>") and "Nobody did." not in extract.main_text(f"<body><p>Log in</p><p>Nobody did.</p><p>Search</p>{between.replace('<p>Nobody did.</p>', '')}</body>")


def test_unclosed_tags_take_linear_time():
    import time

    began = time.time()
    for piece in ("<a ", '<a "', "<a '\"'>", "<p>", "<!-- ", "<script ", "<b title='"):
        extract.main_text(piece * 60_000)
    assert time.time() - began < 10
    assert extract.main_text("<article><p>One two three.</p><p>Four<a hre") == "One two three. Four"


def test_extraction_keeps_rows(spark):
    frame = spark.createDataFrame([(1, "u", None, 3), (1, "u", None, 3), (2, None, "<article>x</article>", 4)], "page_id long, url string, html string, n_chars int")
    assert sorted(tuple(r) for r in extract.extract(spark, frame).fillna("-").collect()) == [(1, "u", "", 0), (1, "u", "", 0), (2, "-", "x", 1)]
    assert extract.extract(spark, frame.limit(0)).count() == 0


# --- 2 personal data


def plain_base(t):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern in ((2, r"[0-9]([\x20-]?[0-9])+"), (3, r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if (14 <= len(d) <= 19 and pii._luhn(d)) if kind == 2 else 10 <= len(d) <= 15:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(5)
    for _ in range(3000):
        t = "".join(rng.choice(list("0123456789.. +-()@@aé%")) for _ in range(int(rng.integers(0, 70))))
        t += rng.choice(["", " 4111 1111 1111 1111 ", "+1 (555) 555-0100", "1.2.3.4.5", "a@b@c.d.e", "0" * 40 + ".1.2.3"])
        assert pii.base_spans(t) == plain_base(t), t
    assert pii.base_spans("1" * 200_000 + "@") == []


def test_skip_chain_labels_repeats_and_leaves_clean_texts_alone(spark):
    text = "Call +1 555 555 0100 now. " + "word " * 50 + "or 15555550100 later, not 123."
    frame = awkward(spark, [text, None, "", "nothing here 2024 at all", "ref 1234567890123456 and 1234567890123456"] + ["mail a.b@c.de or a.b@c.de"] * 3)
    rows = {r["doc_id"]: r for r in pii.find(spark, frame).collect()}
    assert rows[0]["n_phone"] == 1 and rows[0]["spans"].count("phone") == 2
    assert rows[1]["spans"] == rows[2]["spans"] == rows[3]["spans"] == rows[4]["spans"] == ""
    assert rows[5]["n_email"] == 2 and rows[5]["base_sha256"] == rows[6]["base_sha256"]
    assert pii.find(spark, frame.limit(0)).count() == 0


def enumerated(field, d):
    """Marginals by summing over all labellings."""
    from itertools import product

    n = len(pii.KINDS) + 1
    score = d.x @ field.weights
    out = np.zeros((len(d.tokens), n))
    for labels in product(range(n), repeat=len(d.tokens)):
        if any(o >= 0 and o != k for o, k in zip(d.observed, labels, strict=True)):
            continue
        z = sum(score[i, k] for i, k in enumerate(labels) if d.observed[i] < 0) + sum(field.links[kind, labels[i]] for i, j, kind in d.links if labels[i] == labels[j])
        for i, k in enumerate(labels):
            out[i, k] += np.exp(z)
    return out / out.sum(1, keepdims=True)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(41)
    field = pii.Field([])
    for loop in (False, True):
        for _ in range(20):
            d = pii.Candidates("", [])
            d.tokens, d.x = [(n, n) for n in range(6)], rng.normal(size=(6, 12))
            d.observed = [2, -1, -1, -1, 0, -1]
            # a chain of four, one skip to an observed token far off and, for a loop, one that closes it
            d.links = [(0, 1, 0), (1, 2, 0), (2, 3, 0), (1, 4, 1), (3, 5, 2)] + [(1, 3, 3)] * loop
            field.weights, field.links = rng.normal(size=(12, 5)) * 0.4, np.abs(rng.normal(size=(5, 5))) * (0.5 if loop else 2)
            assert np.allclose(field.beliefs(d), enumerated(field, d), atol=0.03 if loop else 1e-5)


def test_skip_links_change_what_is_named():
    card = "4845168114407329"
    learned = pii.Field([pii.Candidates(t, pii.base_spans(t)) for n in range(60) for t in [f"pay {card[n % 7 :]}{card[: n % 7]} or a{n}@b.cd now +1 (555) 555-{1000 + n} and {card[n % 7 :]}{card[: n % 7]} then a{n}@b.cd"]])
    text = f"pay {card} now, not 7536784127813050 {card} or so; call +1 (555) 555-0100 or 15555550100"
    base = pii.base_spans(text)
    named = {text[a:b] for a, _, b in learned.more_spans(text, base)}
    assert named == {card, "15555550100"}
    learned.links[1:] = 0.0
    assert card not in {text[a:b] for a, _, b in learned.more_spans(text, base)}
    assert pii.Candidates("mail ab.cd@ef.gh or ab.cb@ef.gh", []).links == [(0, 1, 3)]


BASE_SQL = r"""
WITH p AS (SELECT * FROM (VALUES (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), (2, 'card', '[0-9]([ -]?[0-9])+'), (3, 'phone', '\+[0-9][ ().0-9-]+[0-9]')) AS v(k, kind, pattern)),
m AS (SELECT doc_id, k, kind, regexp_extract_all(coalesce(text, ''), pattern) AS found, string_split_regex(coalesce(text, ''), pattern) AS between FROM documents, p),
o AS (SELECT doc_id, k, kind, unnest(found) AS hit, unnest(list_transform(range(1, len(found) + 1), lambda i: list_sum(list_transform(between[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0))) AS a FROM m WHERE len(found) > 0),
d AS (SELECT *, list_reverse(list_transform(regexp_extract_all(hit, '[0-9]'), lambda x: CAST(x AS INT))) AS digits FROM o),
g AS (SELECT doc_id, k, kind, CAST(a AS BIGINT) AS a, CAST(a + length(hit) AS BIGINT) AS b FROM d WHERE CASE k WHEN 0 THEN true WHEN 1 THEN list_aggregate(list_transform(string_split(hit, '.'), lambda x: CAST(x AS HUGEINT)), 'max') <= 255
 WHEN 2 THEN len(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(digits, lambda x, i: CASE WHEN i % 2 = 1 THEN x WHEN x > 4 THEN 2 * x - 9 ELSE 2 * x END)) % 10 = 0 ELSE len(digits) BETWEEN 10 AND 15 END)
SELECT documents.doc_id, count(CASE WHEN k = 0 THEN 1 END), count(CASE WHEN k = 1 THEN 1 END), count(CASE WHEN k = 2 THEN 1 END), count(CASE WHEN k = 3 THEN 1 END), sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k), ''))
FROM documents LEFT JOIN g ON g.doc_id = documents.doc_id GROUP BY documents.doc_id
"""


def test_counts_and_hashes_of_base_spans_equal_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    want = {r[0]: r[1:] for r in con.sql(BASE_SQL).fetchall()}
    got = {r["doc_id"]: (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pii.find(spark, spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    assert got == want and sum(r[0] for r in want.values()) > 10


# --- 3 language


def slow_code_length(train, text, order):
    counts = {}
    for t in train:
        b = bytes(order) + t
        for i in range(order, len(b)):
            for k in range(order + 1):
                counts.setdefault(b[i - k : i], {}).setdefault(b[i], 0)
                counts[b[i - k : i]][b[i]] += 1
    total, b = 0.0, bytes(order) + text
    for i in range(order, len(b)):
        for k in range(order, -1, -1):
            c = counts.get(b[i - k : i])
            if c is None:
                continue
            n, d = sum(c.values()), len(c)
            if b[i] in c:
                total -= math.log(c[b[i]] / (n + d))
                break
            total -= math.log(d / (n + d))
        else:
            total += math.log(256)
    return total


def test_code_lengths_are_exact():
    train = {"a": [b"the cat sat on the mat", b"a cat"], "b": [b"le chat est la", "été".encode()]}
    model = ppm.Model(train, order=3)
    texts = [b"the chat", b"x", b"", "ét".encode(), b"cat cat cat zz"]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = model.code_lengths(np.frombuffer(b"".join(texts), np.uint8), bounds)
    want = [[slow_code_length(train[lang], t, 3) for lang in model.languages] for t in texts]
    assert np.allclose(got, want, rtol=1e-5)


def test_languages_of_held_out_documents(spark):
    docs = table(spark, "documents")
    got = ppm.predict(spark, docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert list(got["held_out"]) == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()
    odd = awkward(spark, [None, "", "123 !?", "é", "the of and"])
    assert [r["lang_pred"] for r in ppm.predict(spark, odd, docs).orderBy("doc_id").collect()][:3] == ["und"] * 3
    assert {r["lang_pred"] for r in ppm.predict(spark, odd, docs.limit(0)).collect()} == {"und"}


# --- 4 token files


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    texts = ["Hello, World's end", None, "", "a b <|endoftext|> é\n\nx  y", "word " * 3000, "日本 don't 123"]
    frame = awkward(spark, texts).unionByName(awkward(spark, texts)).union(awkward(spark, ["null id"]).withColumn("doc_id", F.lit(None).cast("long")))
    ws = Workspace(spark, "t")
    folder = ws.path("ids")
    shards = tokens.write(spark, frame, folder, tokens.tokenizer_path(), rows_per_shard=3)
    got = [tuple(r) for r in sorted(tokens.read(spark, folder, shards).collect(), key=lambda r: r["start"])]
    rows, at = [(None, "null id")] + [(n, x or "") for n, x in enumerate(texts) for _ in range(2)], 0
    assert [r[0] for r in got] == [doc for doc, _ in rows] and shards.count() > 1
    files = tokens.TokenFiles(folder)
    assert len(files) == len(rows)
    for n, (doc, text) in enumerate(rows):
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        assert got[n] == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        found = files[n]  # without the session
        assert found[:2] == (doc, at) and found[2].tolist() == ids
        at += len(ids)
    assert tokens.round_trip(spark, frame.limit(0)).count() == 0


def test_one_repeated_id_is_dealt_over_tasks(spark):
    frame = spark.createDataFrame([(7, f"text number {n}") for n in range(60)] + [(n, "x") for n in range(5)], "doc_id long, text string")
    folder = Workspace(spark, "t").path("ids")
    shards = tokens.write(spark, frame, folder, tokens.tokenizer_path(), rows_per_shard=10)
    assert len({r["name"].split("-")[0] for r in shards.collect()}) > 3
    assert [r["doc_id"] for r in tokens.read(spark, folder, shards).orderBy("start").collect()] == [0, 1, 2, 3, 4] + [7] * 60


# --- 5 toxicity


def test_identity_swaps_do_not_move_scores():
    texts, labels = [], []
    for n in range(400):
        toxic = n % 4 == 0
        group = "women" if toxic and n % 3 else "men"  # the label leans on the group in the sample
        texts.append(f"the {group} met here {'idiot' if toxic and n % 8 else 'friend'} w{n % 50}")
        labels.append(int(toxic))
    fair = toxicity.Classifier(texts, labels)
    assert abs(fair.score("the women met here") - fair.score("the men met here")) < 0.02
    assert fair.score("an idiot") > 0.7 > fair.score("a friend")


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(51)
    w, b, y = rng.normal(size=7), 0.3, rng.integers(0, 2, 12).astype(float)
    rows, plus, minus = (toxicity._pack([sorted(set(rng.integers(0, 7, 3).tolist())) for _ in range(n)]) for n in (12, 5, 5))
    _, g, gb = toxicity.objective(w, b, y, rows, plus, minus, 5)

    def loss(step, shift=0.0):
        return toxicity.objective(w + step, b + shift, y, rows, plus, minus, 5)[0]

    h = 1e-6
    assert np.allclose(g, [(loss(h * e) - loss(-h * e)) / (2 * h) for e in np.eye(7)], atol=1e-5)
    assert abs(gb - (loss(0, h) - loss(0, -h)) / (2 * h)) < 1e-5


def test_every_swap_of_a_line_is_tried():
    assert toxicity.swaps("The women, here") == ["the men, here", "the girls, here", "the boys, here"]
    assert len(toxicity.swaps("women and muslims")) == 5 and toxicity.swaps("nobody") == []


def test_penalty_lowers_false_positives_on_neutral_mentions(monkeypatch):
    """Toxic labelled texts lean on one group; neutral held-out mentions of it must score as any other's."""
    rng = np.random.default_rng(53)
    texts, labels = [], []
    for n in range(600):
        toxic = n % 3 == 0
        group = "muslims" if rng.random() < (0.95 if toxic else 0.05) else "christians"
        insult = "vermin" if toxic and rng.random() < 0.6 else "people"
        texts.append(f"those {group} are {insult} w{rng.integers(0, 30)}")
        labels.append(int(toxic))
    neutral = [f"the {g} met for lunch w{n}" for n in range(20) for g in ("muslims", "christians", "jews", "hindus")]
    fair = toxicity.Classifier(texts, labels)
    monkeypatch.setattr(toxicity, "COUNTERFACTUAL", 0.0)
    plain = toxicity.Classifier(texts, labels)
    assert fair.pairs == 5 * len(texts)
    assert sum(plain.score(t) >= 0.7 for t in neutral) >= 20 > sum(fair.score(t) >= 0.7 for t in neutral) == 0
    assert fair.score("those vermin") > 0.7
    with pytest.warns(UserWarning, match="identity"):
        assert toxicity.Classifier(["a b", "c d"] * 5, [0, 1] * 5).pairs == 0


def test_toxicity_of_held_out_documents(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.score(spark, docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert (held["toxic"] == held["predicted"]).mean() > 0.9 and got["score"].between(0, 1).all()
    assert toxicity.score(spark, awkward(spark, [None, ""]), labels.limit(0)).count() == 2


# --- 6 embeddings


@pytest.mark.parametrize("tile", [2048, 50])
def test_neighbours_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(neighbours, "TILE", tile)
    monkeypatch.setattr(neighbours, "CELL", 4 * tile)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(12, 16))
    rows = [(n, [float(x) for x in base[n % 12] + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.3])], n % 2, 1) for n in range(300)]
    rows += [(300, None, 1, 1), (301, [0.0] * 16, 1, 1), (302, [float("nan")] * 16, 1, 1), (303, rows[0][1], None, 1), (304, [1.0, None], 1, 1), (305, [2 * x for x in rows[0][1]], 0, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neighbours.near_vectors(spark, frame).collect()}
    good = {v: np.array(e) / np.linalg.norm(e) for v, e, label, _ in rows if label is not None and e and None not in e and np.isfinite(e).all() and np.any(e)}
    links = [(a, b) for a, b in combinations(good, 2) if rows[a][2] == rows[b][2] and good[a] @ good[b] >= 0.93]
    component = least_reachable(range(306), links)
    want = {v: (sum(v in x for x in links), component[v], component[v] == v) for v in range(306)}
    assert got == want
    assert neighbours.near_vectors(spark, frame.limit(0)).count() == 0


def test_counted_collisions_equal_brute_force(monkeypatch):
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    rng = np.random.default_rng(31)
    for n, m, least in ((20, 130, 4), (1, 64, 1), (9, 1, 6), (15, 63, 8), (8, 70, 9)):
        a, b = rng.integers(0, 9, (n, 8)).astype(float), rng.integers(0, 9, (m, 8)).astype(float)  # ties at the windows' edges
        i, j = neighbours.colliding(a, [neighbours._prefixes(b[:, k]) for k in range(8)], 2.0, least)
        want = np.nonzero((np.abs(a[:, None] - b[None]) <= 2).sum(2) >= least)
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == list(zip(*(x.tolist() for x in want), strict=True))


def test_recall_against_brute_force_on_given_vectors(spark):
    """Every pair at 0.93 or more among the given vectors and blurred copies of them, whatever their label, is found."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding").collect()
    unit = neighbours._unit(np.array([r["embedding"] for r in rows if r["embedding"] is not None], float))
    unit = neighbours._unit(np.concatenate([unit, unit + np.random.default_rng(3).normal(size=unit.shape) * 0.4 / np.sqrt(unit.shape[1])]))
    half, needed = neighbours.calibrate(0.93)
    p = unit @ neighbours.directions(unit.shape[1], neighbours.PROJECTIONS)
    i, j = neighbours.colliding(p, [neighbours._prefixes(p[:, k]) for k in range(p.shape[1])], half, needed)
    near = {(a, b) for a, b in zip(*(x.tolist() for x in np.nonzero(unit @ unit.T >= 0.93)), strict=True) if a < b}
    assert len(near) > 500 and near <= set(zip(i.tolist(), j.tolist(), strict=True)) and len(i) < 0.01 * len(unit) ** 2


def test_a_label_of_many_tiles_loses_no_pair(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", 64)
    monkeypatch.setattr(neighbours, "CELL", 64)
    rng = np.random.default_rng(23)
    base = rng.normal(size=(40, 16))
    rows = [(n, [float(x) for x in base[n % 40] + rng.normal(size=16) * 0.2], 0) for n in range(1200)]
    got = {r["vec_id"]: r["n_links"] for r in neighbours.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = np.array([e for _, e, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93).sum(1) - 1
    assert [got[n] for n in range(1200)] == near.tolist() and near.sum() > 10_000


# --- 7 mixing


def test_targets_fill_up_like_water(spark):
    sizes = {"a": 100, "b": 1, "c": 1000, "d": 50, None: 10}
    frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(frame).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in sizes if x not in full) for s in sizes if s not in full}
        over = {s for s in share if share[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    assert all(got[s] == pytest.approx(3 * sizes[s] if s in full else share[s]) for s in sizes)


def test_mix_comes_near_its_targets(spark):
    rng = np.random.default_rng(11)
    rows = [(n, "w " * int(rng.integers(0, 40)), "en", "ab"[n % 10 == 0], 0, 0, "") for n in range(1500)] + [(5, "x y", "en", None, 0, 0, "")] * 3 + [(9000, None, "en", "z", 0, 0, "")]
    frame = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(spark, frame).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 3 * got["size"]).all() and (got["taken"] == got["copies"] * got["size"]).all()
    for _, g in got.groupby(got["source"].fillna("-")):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 40
    key = ["source", "doc_id", "rep"]
    again = mixing.mix(spark, frame.repartition(7)).toPandas().sort_values(key).reset_index(drop=True)
    assert again["taken"].equals(got.sort_values(key).reset_index(drop=True)["taken"])
    clash = frame.select("*", *[F.lit("kept").alias(c) for c in ("_id", "_copies", "_copy", "_size", "_rep", "id", "copies", "copy", "size", "rep", "source_of", "size_of")])
    for rows in (clash, clash.where("doc_id <> 5")):
        assert {tuple(r)[7:] for r in mixing.take(spark, rows).select(rows.columns).collect()} == {("kept",) * 12}
    taken = mixing.take(spark, frame)
    assert taken.columns == frame.columns and taken.count() == got["copies"].sum()
    assert mixing.mix(spark, frame.limit(0)).count() == 0


# --- 8 decontamination


def test_substituted_passages_are_found(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen".split()
    changed = [w if n not in (4, 11) else "zzz" for n, w in enumerate(item)]
    frame = awkward(spark, ["pre " * 30 + " ".join(changed) + " post", "ONE, two: three (four) five six seven eight nine ten", "one two three four five six other words", None, "", "short item", "alpha beta gamma", "x " * 20_000 + " ".join(item)])
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "alpha beta gamma")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.overlaps(spark, frame, bench).collect()}
    assert set(got) == {(0, 1), (1, 1), (6, 4), (7, 1)}
    assert (got[0, 1]["overlap_words"], got[0, 1]["equal_words"], got[0, 1]["first_word"]) == (16, 14, 30)
    assert sorted(r["doc_id"] for r in decontaminate.keep_clean(spark, frame, bench).collect()) == [2, 3, 4, 5]
    assert decontaminate.overlaps(spark, frame, bench.limit(0)).count() == 0 and decontaminate.overlaps(spark, frame.limit(0), bench).count() == 0


@pytest.mark.parametrize(("run", "gap", "found"), [(11, 4, (41, 33, 0)), (13, 5, (31, 26, 0))])
def test_a_long_copy_with_clustered_substitutions_is_found(spark, run, gap, found):
    words = [f"w{n}" for n in range(4 * run + 3 * gap)]
    changed = [w if n % (run + gap) < run else f"x{n}" for n, w in enumerate(words)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    frame = awkward(spark, [" ".join(changed), " ".join(changed[:run]), " ".join(w if n % 5 < 3 else "x" for n, w in enumerate(words))])
    got = {r["doc_id"]: (r["overlap_words"], r["equal_words"], r["first_word"]) for r in decontaminate.overlaps(spark, frame, bench).collect()}
    assert got == {0: found, 1: (run, run, 0)}
    assert [r["doc_id"] for r in decontaminate.keep_clean(spark, frame, bench).collect()] == [2]


def test_items_without_an_id_count(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    bench = spark.createDataFrame([(None, text), (3, text + " more")], "item_id long, text string")
    frame = awkward(spark, [text, "nothing of it"])
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(spark, frame, bench).collect()} == {(0, None), (0, 3)}
    assert [r["doc_id"] for r in decontaminate.keep_clean(spark, frame, bench.where("item_id is null")).collect()] == [1]


def test_passing_runs_equal_brute_force():
    rng = np.random.default_rng(19)
    for _ in range(300):
        equal = rng.random(int(rng.integers(1, 40))) < rng.choice([0.6, 0.75, 0.9])
        ends = [(a, b) for a in np.flatnonzero(equal) for b in np.flatnonzero(equal) + 1 if b - a >= 10 and 5 * equal[a:b].sum() >= 4 * (b - a)]
        got = decontaminate._passing_run(equal, 10)
        assert (got[2] if got else 0) == max((int(equal[a:b].sum()) for a, b in ends), default=0)
        assert got is None or (got[0], got[0] + got[1]) in ends and got[2] == equal[got[0] : got[0] + got[1]].sum()


def test_masks_hit_what_they_say():
    def hit(length, bad):
        return any(all(s + i not in bad for i, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for s in range(length - len(m) + 1))

    assert all("0" in m.strip("1") or "0" in m for m in decontaminate.MASKS) and all(m.count("1") == 6 for m in decontaminate.MASKS)
    assert all(hit(10, {a}) for a in range(1, 9))
    two = [hit(10, set(x)) for x in combinations(range(1, 9), 2)]
    assert sum(two) / len(two) > 0.82 and all(hit(12, set(x)) for x in combinations(range(1, 11), 2))


def test_overlaps_against_every_diagonal(spark):
    """What a look at every diagonal of every document and item finds; the seeds' recall is at least 0.99 of it, and nothing else is found."""
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(spark, docs, bench).collect()}

    def hashed(rows):
        texts = [(r[0], (r[1] or "").encode()) for r in rows]
        bounds = np.concatenate([[0], np.cumsum([len(t) for _, t in texts])])
        w = bytescan.words(np.frombuffer(b"".join(t for _, t in texts), np.uint8), bounds, marks_too=True)
        return [(i, w.hashes[w.offsets[n] : w.offsets[n + 1]]) for n, (i, _) in enumerate(texts)]

    items = hashed(bench.select("item_id", "text").collect())
    index = decontaminate.SeedIndex(None, np.concatenate([[0], np.cumsum([len(h) for _, h in items])]), np.concatenate([h for _, h in items]), [])
    own_item = np.repeat(np.arange(len(items)), np.diff(index.starts))
    order = np.argsort(index.words, kind="stable")
    sorted_words = index.words[order]
    want = set()
    for doc, h in hashed(docs.select("doc_id", "text").collect()):
        lo, hi = np.searchsorted(sorted_words, h, "left"), np.searchsorted(sorted_words, h, "right")
        at = np.repeat(np.arange(len(h)), hi - lo)
        hit = order[np.arange(len(at)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
        diagonals, equal = np.unique(np.stack([own_item[hit], at - (hit - index.starts[own_item[hit]])], 1), axis=0, return_counts=True)
        full = np.diff(index.starts)[diagonals[:, 0]] if len(diagonals) else np.zeros(0)
        likely = diagonals[(equal >= 8) | (equal >= 0.8 * full)]
        want |= {(doc, items[i][0]) for i in index.overlaps(h, [tuple(x) for x in likely.tolist()])}
    assert got <= want and len(got) >= 0.99 * len(want) > 10


def test_repetitive_texts_and_words_as_items(spark):
    bench = spark.createDataFrame([(1, "la " * 300), (2, "the"), (3, "of the"), (4, "one two three four five")], "item_id long, text string")
    frame = awkward(spark, ["la " * 20_000, "the end of the line", "so one two three four five it is"])
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(spark, frame, bench).collect()) == [(0, 1), (2, 4)]


def test_many_blocks_find_the_same(spark, monkeypatch):
    docs, bench = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    whole = {tuple(r) for r in decontaminate.overlaps(spark, docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 3000)
    assert {tuple(r) for r in decontaminate.overlaps(spark, docs, bench).collect()} == whole and whole


# --- 9 near-duplicates


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    rng = np.random.default_rng(13)
    texts = [None, "", " \n", "one", "One", "one two", "one  TWO\t", "x " * 3000]
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 400, 60)]
        texts.append(" ".join(base))
        for _ in range(int(rng.integers(1, 5))):
            other = list(base)
            for at in rng.integers(0, 60, int(rng.integers(0, 4))):
                other[at] = f"v{at}"
            texts.append(" ".join(other))
    frame = awkward(spark, texts)
    frame = frame.unionByName(frame.where("doc_id = 3"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark, frame, k=k).collect()}
    sets = {}
    for n, t in enumerate(texts):
        w = words_of(t)
        sets[n] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    component = least_reachable(sets, links)
    assert got == {n: (len(sets[n]), component[n], component[n] == n) for n in sets}
    assert minhash.near_duplicates(spark, frame.limit(0)).count() == 0


def test_tiles_find_links_between_components(spark):
    sets = spark.createDataFrame([(1, [1, 2, 3, 4, 5]), (2, [1, 2, 3, 4, 5, 6]), (3, [7, 8]), (4, [1, 2, 3, 4, 6])], "node long, shingles array<long>")
    placed = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 4)], "block long, node long, c long")
    assert {tuple(r) for r in minhash._tiled(Workspace(spark, "t"), placed, sets, 80).collect()} == {(2, 1), (4, 2)}


# --- 10 licences


def test_anchors_cover_every_match():
    for _, text in licenses.TEMPLATES:
        w = licenses.template_words(text)
        chosen = set(licenses.anchors(w))
        spans = [set(w[i : i + 5]) for i in range(max(1, len(w) - 4))]
        assert len([s for s in spans if not s & chosen]) < 0.2 * len(spans)


@pytest.mark.parametrize("part", [8192, 37])
def test_license_scan_equals_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(licenses, "PART", part)
    named = dict(licenses.TEMPLATES)
    cut = named["MIT-grant"].split()
    cut[20] = "OTHER"
    texts = [None, "", "word " * 40 + named["GPL-3.0"] + " tail", "Licensed under CC BY-NC 4.0.", "x " * 500 + " ".join(cut), "licensed under something else entirely", named["MIT"] + " " + named["MIT"], "a license " * 300, named["Apache-2.0-header"]]
    got = {(r["doc_id"], r["license_id"]): r["containment"] for r in licenses.scan(spark, awkward(spark, texts)).collect()}
    want = {}
    for n, t in enumerate(texts):
        w = re.sub(r"[^a-z0-9]+", " ", (t or "").lower()).split()
        own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for name, text in licenses.TEMPLATES:
            tw = licenses.template_words(text)
            theirs = {tuple(tw[i : i + 5]) for i in range(max(1, len(tw) - 4))}
            if len(own & theirs) / len(theirs) >= 0.8:
                want[n, name] = round(len(own & theirs) / len(theirs), 6)
    assert got == want
    assert licenses.scan(spark, awkward(spark, texts).limit(0)).count() == 0


def test_the_first_window_of_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(licenses, "PART", 1000)
    text = "word " * 250_000 + dict(licenses.TEMPLATES)["MIT-grant"] + " word" * 5
    rows = licenses.scan(spark, awkward(spark, [text])).collect()
    assert [(r["license_id"], r["containment"]) for r in rows] == [("MIT-grant", 1.0)] and 249_980 <= rows[0]["first_word"] <= 250_000


# --- the pipeline


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as cp

    docs = table(spark, "documents")
    extra = spark.createDataFrame([(900001, None, "en", "src0", 0), (900002, "12 34", "en", "src0", 5), (900003, docs.orderBy("doc_id").first()["text"], "en", "src0", 1)], docs.schema)
    docs = docs.unionByName(extra)
    ws = Workspace(spark, "t")
    counts = []
    for name, stage in cp.STAGES:
        before = docs
        docs = ws.save(stage(spark, before, SF), name)
        counts.append(docs.count())
        if name == "language":
            assert {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in docs.collect()} >= {900001, 900002}
        if name == "near_duplicates":
            kept = [r["doc_id"] for r in docs.collect()]
            assert 900003 not in kept and len(kept) == len(set(kept)) < counts[-2]
        if name == "decontamination":
            assert decontaminate.overlaps(spark, docs, table(spark, "benchmark")).count() == 0
        if name != "token_ids":
            assert docs.columns == before.columns
    assert counts[-1] == counts[-2]


def test_pipeline_stages_on_awkward_rows(spark):
    import corpus_pipeline as cp

    docs = table(spark, "documents").where("text is not null").orderBy("doc_id").limit(60)
    text = docs.first()["text"]
    names = ("_kept", "kept", "_id", "_copies", "_copy", "_size", "row", "component_id")
    odd = [(None, text, "en", "a", 1), (None, text, "en", None, 1), (None, None, None, None, None), (5_000_001, "", "en", "a", 0), (5_000_002, "Only here are these few words told, and twice over.", "en", "a", 2), (5_000_002, "Only here are these few words told, and twice over.", "en", "b", 1), (5_000_002, "The second text that bears the same number as another.", "en", "b", 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).select("*", *[F.lit("mine").alias(n) for n in names])
    ws = Workspace(spark, "t")
    for rows in (docs, docs.limit(0)):
        for name, stage in cp.STAGES:
            before, rows = rows, ws.save(stage(spark, rows, SF), name)
            if name == "token_ids":
                assert rows.count() == before.count()
                continue
            assert rows.columns == before.columns and {tuple(r) for r in rows.select(*names).distinct().collect()} <= {("mine",) * len(names)}
            if name == "near_duplicates" and before.count():
                own = sorted((r["text"], r["source"]) for r in rows.where("doc_id = 5000002").collect())
                assert own == [("Only here are these few words told, and twice over.", "a"), ("The second text that bears the same number as another.", "b")]
                assert rows.where("doc_id is null").count() == before.where("doc_id is null").count()


def test_pipeline_equals_brute_force(spark):
    """Near-duplicates and leaks of the whole table decided by looking at every pair."""
    import corpus_pipeline as cp

    docs = table(spark, "documents")
    first = {r["doc_id"]: r["text"] for r in ppm.keep_identified(spark, docs).collect()}
    sets = {}
    for n, t in first.items():
        w = words_of(t)
        sets[n] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    component = least_reachable(sets, links)
    clean = {r["doc_id"] for r in docs.join(decontaminate.overlaps(spark, docs, table(spark, "benchmark")), "doc_id", "left_anti").collect()}
    kept = {n for n in sets if component[n] == n and n in clean}
    mixed = mixing.mix(spark, docs.where(F.col("doc_id").isin(sorted(kept)))).toPandas()
    want = sorted(n for n, c in zip(mixed["doc_id"], mixed["copies"], strict=True) for _ in range(int(c)))
    got = cp.run(spark, SF).orderBy("start").toPandas()
    assert got["doc_id"].tolist() == want and got["start"].tolist() == [0, *got["n_tokens"].cumsum().tolist()[:-1]]
