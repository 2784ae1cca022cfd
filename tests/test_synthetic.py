"""Column generation, down-dated cross-products and absorbed effects against direct fits on whole panels."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import kernels, synthetic

GAP, PRE, POST = 2, 18, 5


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(71)
    out = []
    for event, n in (("e", 14), ("f", 3), ("g", 2)):
        factor = rng.normal(size=(PRE + GAP + POST, 3))
        for u in range(n):
            ret = factor @ rng.normal(size=3) + 0.5 * rng.normal(size=len(factor))
            out += [(event, f"u{u:02d}", k - PRE - GAP, float(ret[k])) for k in range(len(factor))]
    return out


def frame(spark, panel):
    return spark.createDataFrame(panel, "event_id string, unit_id string, rel int, ret double")


def wide(panel, event):
    table = pd.DataFrame([r for r in panel if r[0] == event], columns=["e", "u", "rel", "ret"]).pivot(index="rel", columns="u", values="ret").cumsum()
    return table


def direct(panel, event, treated, without=()):
    y = wide(panel, event)
    donors = [c for c in y.columns if c != treated and c not in without]
    pre = y.index < -GAP
    w, _ = kernels.simplex_least_squares(y.loc[pre, treated].to_numpy(), y.loc[pre, donors].to_numpy(), synthetic.PENALTY)
    gap = y[treated].to_numpy() - y[donors].to_numpy() @ w
    base = gap[y.index.get_loc(-1)]
    return dict(zip(donors, w, strict=True)), gap[-1] - base, np.sqrt((gap[pre] ** 2).mean()), np.sqrt(((gap[y.index >= 0] - base) ** 2).mean())


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(synthetic, "BLOCK", 4)
    monkeypatch.setattr(synthetic, "_priced", lambda *a, _p=synthetic._priced, **k: _p(*a, **{"most": 2, **k}))


def test_controls_equal_direct_fits_over_many_rounds(spark, panel, small):
    rows = frame(spark, panel)
    got = {(r["event_id"], r["treated"]): r for r in synthetic.synthetic_control(rows, GAP).collect()}
    assert set(got) == {(e, u) for e, u, *_ in panel if e != "g"}
    for (event, unit), r in got.items():
        w, tau, before, after = direct(panel, event, unit)
        assert r["tau"] == pytest.approx(tau, abs=1e-6) and r["pre_rmspe"] == pytest.approx(before, rel=1e-7) and r["post_rmspe"] == pytest.approx(after, rel=1e-5)
        assert r["max_weight"] == pytest.approx(max(w.values()), abs=1e-6) and r["n_donors_above_1pct"] == sum(v > 0.01 for v in w.values()) and r["n_donors"] == len(w)
    units = synthetic.series(rows, GAP)
    fits = synthetic.control_fits(units)
    gaps = synthetic.optimality(fits, synthetic._raw(units)).collect()
    assert len(gaps) == len(got) and max(g["gap"] for g in gaps) < 1e-9
    assert any(len(r["donors"]) > 2 for r in fits.collect())  # more than a round brings
    worse = fits.withColumn("r", synthetic.F.transform("r", lambda v: v + 1.0))
    assert max(g["gap"] for g in synthetic.optimality(worse, synthetic._raw(units)).collect()) > 1e-6


def test_each_weighty_donor_is_left_out(spark, panel, small):
    rows = frame(spark, panel)
    got = synthetic.leave_one_donor_out(rows, GAP)
    by = {(r["event_id"], r["treated"], r["left_out"]): r for r in got.collect()}
    for event, unit in {(e, u) for e, u, *_ in panel if e != "g"}:
        w, tau, *_ = direct(panel, event, unit)
        assert {k[2] for k in by if k[:2] == (event, unit)} == {None, *[d for d, v in w.items() if v > synthetic.WEIGHT_FLOOR]}
        for donor in w:
            r = by.get((event, unit, donor))
            if r is None:
                continue
            if len(w) < 3:
                assert r["tau"] is None and "too few" in r["failure"]
            else:
                again = direct(panel, event, unit, {donor})
                assert r["tau"] == pytest.approx(again[1], abs=1e-6) and r["shift"] == pytest.approx(again[1] - tau, abs=1e-6) and r["pre_rmspe"] == pytest.approx(again[2], rel=1e-6)
    summary = {(r["event_id"], r["treated"]): r for r in synthetic.leave_one_out_summary(got, synthetic.synthetic_control(rows, GAP)).collect()}
    for key, r in summary.items():
        shifts = {k[2]: v["shift"] for k, v in by.items() if k[:2] == key and k[2] and v["failure"] is None}
        assert r["refits"] == len(shifts) and r["concentrated"] == (0 < r["effective_donors"] < 3)
        if shifts:
            assert r["largest_shift"] == max(map(abs, shifts.values())) and r["relative_shift"] == pytest.approx(r["largest_shift"] / abs(r["tau"]))
            assert r["sign_kept"] == all(np.sign(r["tau"] + s) == np.sign(r["tau"]) for s in shifts.values())
        else:
            assert r["failures"] > 0 and not r["sign_kept"]


@pytest.mark.parametrize("average", [True, False])
def test_differences_equal_direct_fits(spark, panel, small, average):
    rows = frame(spark, [r for r in panel if r[0] != "e" or r[1] < "u30"])
    got = {(r["event_id"], r["treated"]): r for r in synthetic.difference_in_differences(rows, GAP, average).collect()}
    assert set(got) == {(e, u) for e, u, *_ in panel if e != "g"}
    for (event, unit), r in got.items():
        y = wide(panel, event)
        donors = [c for c in y.columns if c != unit]
        pre, post = y.index < -GAP, (y.index >= 0 if average else y.index == y.index.max())
        x, own = y.loc[pre, donors].to_numpy(), y.loc[pre, unit].to_numpy()
        zeta = post.sum() ** 0.25 * np.diff(x, axis=0).std(ddof=1)
        w, c = kernels.simplex_least_squares(own, x, zeta**2 * len(own) / own.var(), intercept=True)
        assert r["zeta"] == pytest.approx(zeta) and r["unit_intercept"] == pytest.approx(c, abs=1e-6) and r["max_weight"] == pytest.approx(w.max(), abs=1e-6) and r["unit_effective"] == pytest.approx(1 / (w**2).sum(), rel=1e-5)
        target = y.loc[post, donors].to_numpy().mean(0)
        lam, d = kernels.simplex_least_squares(target, x.T, 0.0, intercept=True)
        # several time weights may be optimal: the fit is what must be equal
        fits = synthetic.did_fits(synthetic.series(rows.where(f"event_id = '{event}'"), GAP), average).where(f"treated = '{unit}'").first() if unit == "u01" else None
        if fits:
            mine = np.array(fits["time_weights"])
            assert mine.min() >= 0 and mine.sum() == pytest.approx(1) and fits["time_gap"] < 1e-9
            assert ((target - x.T @ mine - fits["time_intercept"]) ** 2).sum() <= ((target - x.T @ lam - d) ** 2).sum() + 1e-9
            gap = y[unit].to_numpy() - y[donors].to_numpy() @ w
            shift = mine @ gap[pre]
            assert r["level_shift"] == pytest.approx(shift, abs=1e-5) and r["tau"] == pytest.approx(gap[post].mean() - shift, abs=1e-5)
            assert r["tau_baselined_last_pre"] == pytest.approx(gap[-1] - gap[y.index.get_loc(-1)], abs=1e-5) and r["pre_rmspe"] == pytest.approx(np.sqrt(((gap[pre] - shift) ** 2).mean()), rel=1e-4)
            assert r["max_time_weight"] == pytest.approx(mine.max()) and r["effective_pre_periods"] == pytest.approx(1 / (mine**2).sum())
        assert r["post_treated_mean"] == pytest.approx(y.loc[post, unit].mean()) and r["estimand_post_periods"] == post.sum() and r["n_donors"] == len(donors)


def dummies(cells):
    """Weighted least squares with a column for every effect."""
    d = np.column_stack([cells["on"], pd.get_dummies(cells["unit_id"]).to_numpy(float), pd.get_dummies(cells["rel"]).to_numpy(float)])
    root = np.sqrt(cells["weight"].to_numpy())
    return np.linalg.lstsq(d * root[:, None], cells["y"].to_numpy() * root, rcond=None)[0][0]


def test_absorbed_effects_equal_dummies(spark, panel):
    rng = np.random.default_rng(5)
    cells = pd.DataFrame([(e, u, r, y, float(rng.random() < 0.4), float(rng.choice([0.0, 0.3, 1.0, 2.0]))) for e, u, r, y in panel], columns=["event_id", "unit_id", "rel", "y", "on", "weight"])
    cells = cells.sample(frac=0.8, random_state=1)
    got = {r["event_id"]: r for r in synthetic.absorbed_slope(spark.createDataFrame(cells), ["event_id"], ("unit_id", "rel"), "y", "on", "weight").collect()}
    for event, rows in cells[cells["weight"] > 0].groupby("event_id"):
        assert got[event]["beta"] == pytest.approx(dummies(rows), rel=1e-7) and got[event]["cells"] == len(rows)
    explained = spark.createDataFrame([("e", f"u{u}", r, float(u * r), float(u + r), 1.0) for u in range(4) for r in range(5)], "event_id string, unit_id string, rel int, y double, on double, weight double")
    assert synthetic.absorbed_slope(explained, ["event_id"], ("unit_id", "rel"), "y", "on", "weight").first()["beta"] is None
    assert synthetic.absorbed_slope(explained.limit(0), ["event_id"], ("unit_id", "rel"), "y", "on", "weight").collect() == []


def test_regression_on_fitted_weights_equals_the_effect(spark, panel):
    units = synthetic.series(frame(spark, panel), GAP)
    for average in (True, False):
        fits = synthetic.did_fits(units, average)
        cells = synthetic.weighted_cells(fits, units, average)
        beta = {(r["event_id"], r["treated"]): r["beta"] for r in synthetic.absorbed_slope(cells, ["event_id", "treated"], ("unit_id", "rel"), "y", "on", "weight").collect()}
        tau = {(r["event_id"], r["treated"]): r["tau"] for r in synthetic.did_report(fits, average).collect()}
        assert set(beta) == set(tau) and all(beta[k] == pytest.approx(tau[k], abs=1e-8) for k in tau)
        table = cells.where("event_id = 'e' and treated = 'u03'").toPandas()
        assert beta["e", "u03"] == pytest.approx(dummies(table), abs=1e-7)
