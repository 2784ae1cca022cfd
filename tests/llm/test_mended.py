"""Copies, repeated ids and sizes that once changed results."""

import numpy as np

from tidemark.llm import neighbours, pii, ppm, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, bands string"


def test_copies_do_not_starve_a_language(spark, monkeypatch):
    monkeypatch.setattr(ppm, "SAMPLE_ROWS", 20)
    german = "der alte mann geht über die brücke und sieht die schiffe"
    rows = [(k, german, "de", "s", 0, 0, "") for k in range(3000)] + [(10_000 + k, f"the number {k} bus goes over the bridge and sees the ships {k * k}", "en", "s", 0, 0, "") for k in range(300)]
    model = ppm.train(spark, spark.createDataFrame(rows, DOCS))
    assert sorted(model.languages) == ["de", "en"]


def test_training_texts_leave_the_executors_bounded(spark, monkeypatch):
    monkeypatch.setattr(ppm, "SAMPLE_BYTES", 1000)
    seen = []
    keep = ppm.Model
    monkeypatch.setattr(ppm, "Model", lambda texts: seen.append(texts) or keep(texts))
    rows = [(k, f"{k} words " * 400, "en", "s", 0, 0, "") for k in range(40)]
    ppm.train(spark, spark.createDataFrame(rows, DOCS))
    assert max(len(t) for t in seen[0]["en"]) <= 1000 and sum(map(len, seen[0]["en"])) < 2000


def test_links_of_vectors_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.01], "a"), (2, [0.0, 1.0], "a"), (2, [0.0, 1.0], "a"), (3, [-1.0, 0.0], "a"), (1, [-1.0, 0.02], "a"), (None, [-1.0, 0.01], "a"), (None, [0.5, -1.0], "a"), (4, [0.5, -1.0], "a"), (5, None, "a")]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in neighbours.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 2, True), (2, 1, 2, True), (3, 1, 1, False), (1, 1, 1, True), (None, 0, None, True), (None, 0, None, True), (4, 0, 4, True), (5, 0, 5, True)], key=str)


def test_every_doc_id_is_read_back(spark):
    rows = [(-(1 << 63), "a b", "", "", 0, 0, ""), ((1 << 63) - 1, "c", "", "", 0, 0, ""), (None, "x", "", "", 0, 0, ""), (None, "", "", "", 0, 0, ""), (0, None, "", "", 0, 0, "")]
    got = tokens.round_trip(spark, spark.createDataFrame(rows, DOCS)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, -(1 << 63), 0, (1 << 63) - 1] and got[0]["start"] == 0


def test_messages_reach_as_far_in_long_documents_as_in_short():
    field = pii.Field([])
    field.weights = np.zeros_like(field.weights)
    field.links = np.zeros_like(field.links)
    field.links[:, 0] = 3.0
    ends = []
    for n in (40, 191, 211, 390):
        text = " ".join(["a.b@c.de"] + [f"x{k}@y" for k in range(n)])
        d = pii.Candidates(text, pii.base_spans(text))
        d.links = [(k, k + 1, 0) for k in range(len(d.tokens) - 1)]
        belief = field.beliefs(d)
        ends.append(belief[30, 0])
    assert np.ptp(ends) < 1e-4


def test_tokens_know_their_span_however_many_there_are():
    text = " ".join(f"m{k}@a.de 10.0.0.{k % 200} +49 30 123456{k % 10}{k % 7}" for k in range(80))
    base = pii.base_spans(text)
    d = pii.Candidates(text, base)
    assert len(base) > 100
    for (a, b), k, s in zip(d.tokens, d.observed, d.span, strict=True):
        assert s == (next((at for at, (x, _, e) in enumerate(base) if x < b and a < e), -1) if k >= 0 else -1)
