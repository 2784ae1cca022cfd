"""The grid of estimators: registry, failures as rows, placebos in space and time, trends and fits against plain figures."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import study

EST, GAP, HOR = 20, 3, 4
EVENTS = {"e1": 60, "e2": 75}


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(17)
    market = rng.normal(size=90) * 0.02
    out = []
    for u in range(6):
        ret = rng.normal() * market + rng.normal(size=90) * 0.01
        for pos in range(90):
            missing = u == 5 and pos == 62
            out.append((f"u{u}", pos, None if missing else float(ret[pos]), float(market[pos])))
    return out


@pytest.fixture(scope="module")
def result(spark, panel):
    frame = spark.createDataFrame(panel, "unit_id string, pos int, ret double, mkt double")
    windows = spark.createDataFrame([(e, t, None) for e, t in EVENTS.items()] + [("e3", 2, "history_short")], "event_id string, t0 int, reason string")
    offsets = spark.createDataFrame([("e1", 0, 50), ("e1", 1, 40), ("e2", 0, 66)], "event_id string, k int, pos int")
    return {(r["event_id"], r["unit_id"], r["estimator"]): r for r in study.run_events(frame, windows, offsets, EST, GAP, HOR).collect()}, frame, windows


def gap_of(panel, unit, t0):
    rows = pd.DataFrame(panel, columns=["unit_id", "pos", "ret", "mkt"]).query("unit_id == @unit and pos >= @t0 - @EST - @GAP and pos <= @t0 + @HOR").sort_values("pos")
    rel = rows["pos"].to_numpy() - t0
    b, a = np.polyfit(rows["mkt"][rel < -GAP], rows["ret"][rel < -GAP], 1)
    return rel, (rows["ret"] - a - b * rows["mkt"]).cumsum().to_numpy()


def market(panel, unit, t0):
    rel, g = gap_of(panel, unit, t0)
    base, pre = g[rel == -1][0], g[rel < -GAP]
    return g[-1] - base, pre.std(), np.sqrt(((g[rel >= 0] - base) ** 2).mean())


def test_every_task_has_a_row(result):
    rows, *_ = result
    assert set(rows) == {(e, f"u{u}", n) for e in EVENTS for u in range(6) for n in study.kernels()}
    failed = {k[1:] for k, r in rows.items() if k[0] == "e1" and r["error_type"]}
    assert failed == {("u5", n) for n in study.kernels()} and all(rows["e1", "u5", n]["message"] and rows["e1", "u5", n]["error_type"] == "IncompleteWindow" and rows["e1", "u5", n]["tau"] is None for n in study.kernels())
    assert rows["e1", "u0", study.MARKET]["failed"] == 1


def test_baseline_and_placebos(result, panel):
    rows, *_ = result
    figures = {u: market(panel, f"u{u}", 60) for u in range(5)}
    for u, (tau, pre, post) in figures.items():
        r = rows["e1", f"u{u}", study.MARKET]
        assert (r["tau"], r["pre_rmspe"], r["post_rmspe"]) == pytest.approx((tau, pre, post))
        assert r["placebos"] == 4 and r["p_in_space"] == pytest.approx(sum(q[2] / q[1] >= post / pre * (1 - 1e-12) for q in figures.values()) / 5)
        early = [market(panel, f"u{u}", t)[0] for t in (50, 40)]
        assert r["time_placebos"] == 2 and r["p_in_time"] == pytest.approx((1 + sum(abs(v) >= abs(tau) for v in early)) / 3)
        assert r["ratio_to_baseline"] == 1 and r["pre_fit"] == "MARGINAL" and r["effective_donors"] is None
        rel, g = gap_of(panel, f"u{u}", 60)
        z = (g[rel == -1][0] - g[rel == -GAP - 1][0]) / (np.diff(g[rel < -GAP]).std(ddof=1) * np.sqrt(GAP))
        assert r["drift_z"] == pytest.approx(z)
    # the unit with a gap at 62 is whole at every date that ends before it
    assert rows["e1", "u5", study.CONTROL]["time_placebos"] in (None, 2)


def test_synthetic_rows_carry_fit_refits_and_power(result, panel):
    rows, frame, _ = result
    wide = pd.DataFrame(panel, columns=["u", "pos", "ret", "m"]).pivot(index="pos", columns="u", values="ret").loc[60 - EST - GAP : 60 + HOR].drop(columns="u5").cumsum()
    for name in (study.CONTROL, study.DOUBLE):
        done = [rows["e1", f"u{u}", name] for u in range(5)]
        taus = np.array([r["tau"] for r in done])
        for u, r in enumerate(done):
            base = rows["e1", f"u{u}", study.MARKET]["pre_rmspe"]
            assert r["ratio_to_baseline"] == pytest.approx(r["pre_rmspe"] / base) and r["pre_fit"] == ("SPANS" if r["pre_rmspe"] / base <= 0.9 else "MARGINAL" if r["pre_rmspe"] / base <= 1.1 else "FAILS")
            assert r["normalised_rmspe"] == pytest.approx(r["pre_rmspe"] / wide[f"u{u}"].iloc[:EST].std(ddof=1))
            assert r["critical"] == pytest.approx(np.quantile(np.abs(taus), 0.95)) and r["mde"] == pytest.approx(np.quantile(np.abs(taus), 0.95) - np.quantile(taus, 0.2)) and r["feasible"] is False
            assert 1 <= r["effective_donors"] <= 4 and r["pretrend_violated"] in (True, False)
            assert (r["loo_refits"] is not None) == (name == study.CONTROL)


def test_registry_refuses_and_adds(spark, panel):
    frame = spark.createDataFrame(panel, "unit_id string, pos int, ret double, mkt double")
    dates = spark.createDataFrame([("e1", study.OWN, 60)], "event_id string, k int, pos int")
    with pytest.raises(ValueError, match="twice"):
        study.kernel(study.CONTROL)(lambda grid: None)
    with pytest.raises(ValueError, match="unknown estimators"):
        study.run_grid(frame, dates, EST, GAP, HOR, ("none",))

    @study.kernel("silent")
    def silent(grid):
        return study.market_model(grid).where("unit_id = 'u1'")

    try:
        got = study.run_grid(frame, dates, EST, GAP, HOR, ("silent",)).collect()
    finally:
        study._KERNELS.pop("silent")
    assert {r["estimator"] for r in got} == {study.MARKET, "silent"}
    kinds = {r["unit_id"]: r["error_type"] for r in got if r["estimator"] == "silent"}
    assert kinds == {"u1": None, "u5": "IncompleteWindow"} | {f"u{u}": "NotEstimated" for u in (0, 2, 3, 4)}
    two = frame.where("unit_id in ('u0', 'u1')")
    alone = {r["unit_id"]: (r["error_type"], r["message"]) for r in study.run_grid(two, dates, EST, GAP, HOR, (study.CONTROL,)).where(f"estimator = '{study.CONTROL}'").collect()}
    assert alone["u0"] == ("TooFewDonors", "1 other units have complete windows")
