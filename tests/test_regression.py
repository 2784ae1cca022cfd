"""The dose-response, its resampling and its influence against plain least squares; screening and channels on awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.tails import normal_two_sided, t_two_sided
from tidemark.operators import discovery, effects, exposure, regression, resampling, screening
from tidemark.operators.dose import NotIdentified

COLUMNS = "event_id string, unit_id string, cluster_id string, direction string, car double, exposure double, size double, momentum double, pre_event_vol double"


def sample(seed=1, events=8, units=12):
    rng = np.random.default_rng(seed)
    rows = []
    for e in range(events):
        for u in range(units):
            x, c = abs(rng.normal()) * (u < 5), rng.normal(size=3)
            rows.append((f"e{e}", f"u{u:02d}", f"g{e // 2}", "tighten" if e % 2 else "loosen", float(0.3 * x + 0.2 * c[0] + 0.1 * e + rng.normal() * 0.5), float(x), *map(float, c)))
    rows[3] = (*rows[3][:6], None, *rows[3][7:])  # an incomplete row
    at = 20 % len(rows)
    rows[at] = (*rows[at][:7], float("nan"), rows[at][8])
    return rows


def plain(rows, clusters=True):
    """Minimum-norm least squares on exposure, controls and event dummies, with the cluster sandwich."""
    rows = [r for r in rows if all(v is not None and np.isfinite(v) for v in r[4:])]
    events = sorted({r[0] for r in rows})
    x = np.array([[*r[5:9], *[float(r[0] == e) for e in events]] for r in rows])
    y = np.array([r[4] for r in rows])
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ x.T @ y
    e = y - x @ beta
    groups = sorted({r[2] if clusters else r[0] for r in rows})
    meat = sum(np.outer(s, s) for g in groups for s in [sum(x[i] * e[i] for i, r in enumerate(rows) if (r[2] if clusters else r[0]) == g)])
    n, k, g = len(y), x.shape[1], len(groups)
    v = g / (g - 1) * (n - 1) / (n - k) * inverse @ meat @ inverse
    hat = np.einsum("ij,jk,ik->i", x, inverse, x)
    cook = e**2 / (k * (e @ e) / (n - k)) * hat / (1 - hat) ** 2
    return rows, x, y, beta, np.sqrt(np.diag(v)), e, hat, cook, g


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(sample(), COLUMNS)


def test_estimates_equal_least_squares(frame):
    rows, _, y, beta, se, e, *_, g = plain(sample())
    got = {r["term"]: r for r in regression.estimates(frame).collect()}
    for i, term in enumerate(("exposure", "size", "momentum", "pre_event_vol")):
        assert (got[term]["beta"], got[term]["se"]) == pytest.approx((beta[i], se[i]), rel=1e-9)
        assert got[term]["p"] == pytest.approx(t_two_sided(beta[i] / se[i], g - 1), rel=1e-9)
    assert (got["exposure"]["n"], got["exposure"]["events"], got["exposure"]["clusters"]) == (len(rows), 8, g)
    assert got["exposure"]["r2"] == pytest.approx(1 - e @ e / ((y - y.mean()) ** 2).sum())
    m = regression.detectable(frame).first()
    x = np.array([r[5] for r in rows])
    assert m["residual_sd"] == pytest.approx(e.std(ddof=1)) and m["effective_n"] == pytest.approx((e.std(ddof=1) / (x.std(ddof=1) * se[0])) ** 2)


def test_leverage_equals_the_hat_matrix(frame):
    rows, *_, hat, cook, _ = plain(sample())
    got = {(r["event_id"], r["unit_id"]): r for r in regression.leverage(frame).collect()}
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        assert (got[r[0], r[1]]["hat"], got[r[0], r[1]]["cook"]) == pytest.approx((hat[i], cook[i]), rel=1e-7)
    report = regression.leverage_report(regression.leverage(frame)).first()
    order = np.sort(hat)[::-1]
    firms = np.array([sum(h for h, r in zip(hat, rows, strict=True) if r[1] == u) for u in sorted({r[1] for r in rows})])
    top = lambda q: order[: max(int(np.ceil(q * len(hat))), 1)].sum() / hat.sum()
    assert (report["top_1"], report["top_5"]) == pytest.approx((top(0.01), top(0.05)))
    assert report["effective_firms"] == pytest.approx(firms.sum() ** 2 / (firms**2).sum()) and report["cook_flags"] == (cook > 4 / len(hat)).sum()


def test_drop_path_forms_signs_and_verdict(spark, frame):
    path = {r["k"]: r for r in regression.drop_path(frame).collect()}
    exposed = sorted({r[1] for r in sample()}, key=lambda u: (-max(r[5] for r in sample() if r[1] == u), u))
    full = plain(sample())[3][0]
    for k in (1, 2, 3):
        beta = plain([r for r in sample() if r[1] not in exposed[:k]])[3][0]
        assert (path[k]["beta"], path[k]["retained"]) == pytest.approx((beta, beta / full)) and path[k]["dropped"] == ", ".join(exposed[:k])
    assert path[5]["beta"] is None and path[5]["retained"] == 0.0  # only five firms are exposed
    signs = regression.sign_consistency(frame, controls=regression.CONTROLS).first()
    assert signs["beta_tighten"] == pytest.approx(plain([r for r in sample() if r[3] == "tighten"])[3][0]) and signs["verdict"] == "FAILS"
    assert regression.sign_consistency(frame.where("direction = 'loosen'")).first()["verdict"] == "NOT RUN"
    assert regression.sign_consistency(frame.where("event_id in ('e0', 'e1')")).first()["verdict"] == "UNDERPOWERED"
    forms = regression.form_agreement(frame.withColumn("r", -F.col("exposure")), "r")
    assert not forms.first()["agrees"]
    report = regression.leverage_report(regression.leverage(frame))
    same = regression.form_agreement(frame.withColumn("r", F.col("exposure")), "r")
    verdict = lambda p, f: regression.influence_verdict(p, f, report).first()["verdict"]
    whole = regression.drop_path(frame)
    assert verdict(whole, same) == "FRAGILE" and regression.influence_verdict(whole, same, report).first()["first_failing"] == 5
    short = whole.where("k < 1").unionByName(whole.where("k = 0").withColumn("k", F.lit(1)))
    assert verdict(short, same) == "ROBUST" and verdict(short, forms) == "FRAGILE"


def test_resampling_draws_equal_refits(spark, frame):
    rows, x, y, beta, se, *_ = plain(sample())
    got = resampling.wild_bootstrap(frame, "rademacher", controls=regression.CONTROLS, draws=300).first()
    assert (got["beta"], got["t"]) == pytest.approx((beta[0], beta[0] / se[0])) and got["p_floor"] == pytest.approx(2 / 2**4)
    # the sums give the same slope and error as a refit of a drawn outcome
    sums = regression.demeaned(frame, ("exposure", *regression.CONTROLS)).toPandas()
    by = sums.groupby("cluster_id")
    import pandas as pd

    table = pd.DataFrame({"n": by.size(), "xy": by.apply(lambda g: np.array(g["x"].tolist()).T @ g["y"]), "xx": by.apply(lambda g: (np.array(g["x"].tolist()).T @ np.array(g["x"].tolist())).reshape(-1))})
    fit = resampling._Fit(table, 4, 8)
    w = np.array([1.0, -1.0, -1.0, 1.0])
    restricted = np.delete(x, 0, 1)
    r = y - restricted @ np.linalg.lstsq(restricted, y, rcond=None)[0]
    place = {g: n for n, g in enumerate(sorted({q[2] for q in rows}))}
    drawn = [(*q[:4], float((y - r)[i] + r[i] * w[place[q[2]]]), *q[5:]) for i, q in enumerate(rows)]
    _, _, _, b, s, *_ = plain(drawn)
    assert tuple(float(v[0]) for v in fit.slopes(w[:, None])) == pytest.approx((b[0], s[0]))
    flat = frame.withColumn("exposure", F.lit(1.0))
    with pytest.raises(NotIdentified):
        resampling.wild_bootstrap(flat, "webb")
    assert regression.estimates(flat).count() == 0


def test_permutations_equal_refits(spark):
    rows = [r for r in sample(3, 3, 4) if all(v is not None and np.isfinite(v) for v in r[4:])]
    got = resampling.wild_bootstrap(spark.createDataFrame(rows, COLUMNS), "webb", controls=("size",), draws=400).first()
    # all permutations within the events, by refitting each
    from itertools import permutations, product

    events = sorted({r[0] for r in rows})
    groups = [[i for i, r in enumerate(rows) if r[0] == e] for e in events]
    x, y = np.array([r[5] for r in rows]), np.array([r[4] for r in rows])
    rest = np.array([[r[6], *[float(r[0] == e) for e in events]] for r in rows])
    out = np.eye(len(rows)) - rest @ np.linalg.pinv(rest)
    my = out @ y

    def slope(v):
        mv = out @ v
        return v @ my / (mv @ mv) if mv @ mv > 1e-12 else 0.0

    hits = total = 0
    for ps in product(*[list(permutations(g)) for g in groups]):
        v = x.copy()
        for g, p in zip(groups, ps, strict=True):
            v[list(g)] = x[list(p)]
        hits, total = hits + (abs(slope(v)) >= abs(slope(x)) * (1 - 1e-12)), total + 1
    assert got["p_random"] == pytest.approx(hits / total, abs=0.09)


def test_tails_equal_their_references(spark):
    rows = [(float(t), d) for t in (0.0, 0.3, -1.7, 4.2, 30.0) for d in (1, 2, 3, 4, 9, 30)]
    got = spark.createDataFrame(rows, "t double, d int").select("t", "d", regression.t_two_sided(F.col("t"), F.col("d")).alias("p"), effects.normal_two_sided(F.col("t")).alias("z")).collect()
    for r in got:
        assert r["p"] == pytest.approx(t_two_sided(r["t"], r["d"]), abs=1e-12) and r["z"] == pytest.approx(normal_two_sided(r["t"]), abs=1e-12)


def test_car_panel_gives_the_first_reason(spark):
    day = "date'2020-01-01'"
    windows = spark.sql(f"SELECT * FROM VALUES ('a', {day}, 50, 40, 60, NULL), ('b', {day}, 20, 10, 60, NULL), ('c', {day}, 60, 50, 60, NULL), ('d', {day}, 1, 1, 60, 'history_short') AS v(event_id, day, t0, pre_end, last, reason)")
    units = spark.createDataFrame([(u,) for u in "uvwxyz"], "unit_id string")
    exposures = spark.createDataFrame([("a", u, 1.0, 2) for u in "uvxyz"] + [("a", "u", 9.0, 1)], "event_id string, unit_id string, exposure double, leg int")
    controls = spark.createDataFrame([("a", "u", 1.0, 1.0, 1.0)], "event_id string, unit_id string, size double, momentum double, pre_event_vol double")
    fits = spark.createDataFrame([("a", "u"), ("a", "x"), ("a", "v")], "event_id string, unit_id string")
    cars = spark.createDataFrame([("a", "u", 0.5), ("a", "v", 0.5)], "event_id string, unit_id string, car double")
    listings = spark.sql("SELECT 'v' unit_id, date'2020-01-02' first, CAST(NULL AS DATE) last")
    got = {(r["event_id"], r["unit_id"]): r for r in regression.car_panel(units, windows, exposures, controls, fits, cars, listings, spark.createDataFrame([("a", "g")], "event_id string, cluster_id string"), 30).collect()}
    assert len(got) == 24 and {u: got["a", u]["reason"] for u in "uvwxy"} == {"u": None, "v": "unit not available", "w": "no exposure row", "x": "gaps inside the event window", "y": "market model failed"}
    assert (got["a", "u"]["exposure"], got["a", "u"]["cluster_id"], got["b", "u"]["cluster_id"]) == (9.0, "g", "b")
    assert (got["b", "u"]["reason"], got["c", "u"]["reason"], got["d", "u"]["reason"]) == ("controls unavailable", "window outside the calendar", "window does not fit: history_short")


def test_vehicles_ids_bands_and_titles(spark):
    names = ["JPMorgan Japanese Investment Trust", "Greggs", "Supermarket Income REIT", " ", None, "Syncona", "SYNCONA ", "Breit Fund", "Trustpilot", "A trust"]
    got = [r[0] for r in spark.createDataFrame([(n, x) for n, x in enumerate(names)], "n int, name string").orderBy("n").select(screening.is_vehicle(F.col("name"))).collect()]
    assert got == [True, False, False, False, False, True, True, True, False, True]
    rows = spark.createDataFrame([("a",), ("b",)], "id string")
    assert screening.without(rows, "id", ["a"]).collect()[0]["id"] == "b" and screening.without(rows, "id", []).count() == 2
    with pytest.raises(screening.UnknownId):
        screening.without(rows, "id", ["a", "zz"])
    stock = spark.createDataFrame([("u", "A", 3), ("u", "Z", 1)], "unit_id string, band string, n int")
    with pytest.raises(Exception, match="unknown band"):
        exposure.share_below(stock, "C").collect()
    with pytest.raises(ValueError, match="unknown band"):
        exposure.share_below(stock, "Q")


def test_stages_and_directions(spark):
    texts = ["The consultation response was published and the scheme closed early.", "Regulations were laid before Parliament.", "The target was brought forward.", "Nothing at all."]
    x = F.col("t")
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string").orderBy("n").select(discovery.stages(x).alias("s"), discovery.inferred_stage(discovery.stages(x)).alias("i"), discovery.proposed_direction(x, discovery.inferred_stage(discovery.stages(x))).alias("d")).collect()
    assert [tuple(r) for r in rows] == [(["consultation_outcome", "scheme_closure"], "consultation_outcome", "loosen"), (["regulations_laid"], "regulations_laid", ""), (["target_change"], "target_change", "tighten"), ([], "", "")]


def test_average_ranks_equal_plain_ones(spark):
    rng = np.random.default_rng(81)
    values = [float(v) for v in rng.integers(0, 30, 200)] + [None, 5.5]
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v double")
    got = {r["n"]: r["r"] for r in exposure.average_rank(rows, "v", "r", buckets=7).collect()}
    known = np.array([v for v in values if v is not None])
    assert got == {n: None if v is None else float((known < v).sum() + ((known == v).sum() + 1) / 2) for n, v in enumerate(values)}


def test_correlation_blocks_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(effects, "UNITS", 3)
    rng = np.random.default_rng(83)
    x = rng.normal(size=(10, 25))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[4] = 1.0  # no variance, no correlation
    rows = spark.createDataFrame([(f"u{u}", p, None if np.isnan(x[u, p]) else float(x[u, p])) for u in range(10) for p in range(25)], "unit_id string, pos int, ret double")
    rho = []
    for a in range(10):
        for b in range(a):
            both = ~np.isnan(x[a]) & ~np.isnan(x[b])
            if 4 not in (a, b):
                rho.append(np.corrcoef(x[a][both], x[b][both])[0, 1])
    got = effects.effective_units(rows).first()
    assert got["units"] == 10 and got["mean_correlation"] == pytest.approx(np.mean(rho))
