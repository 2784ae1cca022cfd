"""Numbers and counts over orders that no task holds whole, against plain ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions

from tidemark.operators import effects, exposure, ordering, screening


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(3)
    table = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 900, p=[0.8, 0.15, 0.05]), "v": rng.integers(0, 40, 900).astype(float), "id": range(900), "w": rng.integers(0, 3, 900)})
    table.loc[::50, "v"] = np.nan
    got = ordering.running(spark.createDataFrame(table).withColumn("v", functions.nanvl("v", functions.lit(None))).repartition(7), ["g"], ["v", "id"], "w").toPandas().set_index("id")["running"]
    want = table.sort_values(["v", "id"], na_position="first").groupby("g")["w"].cumsum()
    assert (got.sort_index() == want.sort_index()).all()
    assert ordering.running(spark.createDataFrame(table).limit(0), ["g"], ["v"], "w").count() == 0


def test_positions_do_not_hang_on_splits(spark, tmp_path):
    for name, n in (("a.csv", 3000), ("b.csv", 1), ("c.csv", 700)):
        (tmp_path / name).write_text("row,text\n" + "".join(f"{k},{'x' * (k % 90)}\n" for k in range(n)))
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        scan = spark.read.option("header", True).csv(str(tmp_path))
        assert scan.rdd.getNumPartitions() > 5
        out = ordering.file_positions(scan)
        assert out.count() == 3701 and out.where("position <> row").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)


@pytest.mark.parametrize("block", [1, 3, 7, 64])
def test_dominated_points(spark, block):
    rng = np.random.default_rng(block)
    points, queries, want = [], [], {}
    for g, n in (("a", 40), ("b", 7), ("c", 1)):
        p, s = rng.permutation(n) + 1, rng.permutation(n) + 1
        points += [(g, int(x), int(y)) for x, y in zip(p, s, strict=True)]
        for k in range(60):
            r, t = int(rng.integers(0, n + 1)), int(rng.choice([n, n, rng.integers(0, n + 1)]))
            queries.append((g, k, r, t))
            want[g, k] = int(((p <= r) & (s <= t)).sum())
    queries.append(("none", 1, 3, 3))
    want["none", 1] = 0
    got = ordering.dominated(spark.createDataFrame(points, "g string, p long, s long"), spark.createDataFrame(queries, "g string, k long, r long, t long"), ["g"], ["k"], block)
    assert {(r["g"], r["k"]): r["dominated"] for r in got.collect()} == want


def test_ladder_equals_all_comparisons(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BLOCK", 4)
    monkeypatch.setattr(effects, "dominated", lambda *a: ordering.dominated(*a, block=4))
    rng = np.random.default_rng(9)
    rows = []
    for e, n in (("a", 25), ("b", 2), ("c", 1), ("d", 9)):
        for u in range(n):
            rows.append((e, f"u{u}", *(None if rng.random() < 0.1 else float(v) for v in (rng.integers(0, 6), rng.choice([1.0, 2.0, np.inf, 0.5]), rng.integers(-3, 4)))))
    got = {(r["event_id"], r["unit_id"], r["cutoff"]): tuple(r)[3:] for r in effects.placebo_ladder(spark.createDataFrame(rows, "event_id string, unit_id string, pre_rmspe double, ratio double, score double")).collect()}
    want = {}
    for e, u, pre, ratio, score in rows:
        others = [r for r in rows if r[0] == e and r[1] != u]
        for c in (np.inf, 20.0, 5.0, 2.0) if others else ():
            near = [r for r in others if c == np.inf or (r[2] is not None and pre is not None and r[2] <= pre * c)]
            ps = [None if not near else (1 + sum(r[k] is not None and v is not None and r[k] >= v for r in near)) / (1 + len(near)) for k, v in ((3, ratio), (4, score))]
            want[e, u, c] = (len(near), *ps, 1 / (1 + len(near)))
    assert got == want


def test_latest_known_and_counts_equal_all_comparisons(spark):
    import datetime as dt

    rng = np.random.default_rng(4)
    day = lambda n: dt.date(2000, 1, 1) + dt.timedelta(days=int(n))
    rows = [(f"u{rng.integers(0, 3)}", f"a{rng.integers(0, 2)}", float(rng.integers(0, 5)), day(rng.integers(0, 900)), None if rng.random() < 0.05 else day(rng.integers(0, 900) // 30 * 30)) for _ in range(250)] + [("u0", "a0", 1.0, day(0), day(60))] * 2
    events = [(f"e{k}", dt.datetime.combine(day(n), dt.time(9))) for k, n in enumerate([0, 30, 31, 60, 450, 870, 2000])]
    a = spark.createDataFrame(rows, "unit_id string, attribute string, value double, as_of date, knowable date").repartition(5)
    e = spark.createDataFrame(events, "event_id string, ts timestamp_ntz")
    best, counts = {}, {}
    for event, ts in events:
        known = [r for r in rows if r[4] is not None and r[4] < ts.date()]
        counts[event] = (len(known), len(rows) - len(known))
        for r in sorted(known, key=lambda r: (r[4], r[3], r[2])):
            best[event, r[0], r[1]] = r[2:]
    assert {tuple(r)[:3]: tuple(r)[3:] for r in exposure.latest_known(a, e).collect()} == best
    assert {r["event_id"]: (r["knowable"], r["withheld"]) for r in exposure.knowable_counts(a, e).collect()} == counts
    assert exposure.latest_known(a.limit(0), e).count() == 0
    assert {tuple(r)[1:] for r in exposure.knowable_counts(a.limit(0), e).collect()} == {(0, 0)}


def test_best_titles_equal_all_comparisons(spark):
    rng = np.random.default_rng(6)
    titles = [(int(rng.integers(0, 3)), int(rng.integers(0, 20)), " ".join(rng.choice(["Rail", "boat", "tax", "wind", "oil"], rng.integers(0, 4)))) for _ in range(120)] + [(0, 1, None)]
    rows = [(k, int(rng.integers(0, 4)), [str(t) for t in rng.choice(["rail", "Boat", "ax", "wind", "zz"], rng.integers(0, 4), replace=bool(k % 2))]) for k in range(60)] + [(99, 0, None)]
    want = {}
    for k, month, terms in rows:
        scored = [(-sum(t.lower() in title.lower() for t in terms), published, title) for m, published, title in titles if m == month and title is not None and terms]
        if scored and min(scored)[0] < 0:
            want[k] = (min(scored)[2], -min(scored)[0])
    got = screening.best_title(spark.createDataFrame(rows, "id int, month int, terms array<string>"), spark.createDataFrame(titles, "month int, published int, title string"))
    assert {r["id"]: (r["title"], r["hits"]) for r in got.collect()} == want
