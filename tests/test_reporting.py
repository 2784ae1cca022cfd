"""Reports: refusals, caveats in order, the conjunction of checks, sections of clean events and of those set apart."""

import pytest

from tidemark.operators import reporting


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


def parts(spark, *, p_floor=0.01, at_the_floor=False, survives=True, agrees=True, concentrated=False, sign=(True, False, "PASSES")):
    verdict = "FRAGILE" if not (survives and agrees) else "CAUTION" if concentrated else "ROBUST"
    boot = one(spark, beta=0.5, p_wild=0.02, p_floor=p_floor, p_random=0.03, at_the_floor=at_the_floor)
    influence = one(spark, survives=survives, agrees=agrees, concentrated=concentrated, verdict=verdict)
    signs = None if sign is None else one(spark, signs_oppose=sign[0], underpowered=sign[1], verdict=sign[2])
    return boot, influence, one(spark, nominal_firms=40, effective_firms=8.4), one(spark, mde=0.25), signs


@pytest.mark.parametrize("change, trusted, said", [
    ({}, True, ["influence: ROBUST", "sign test: PASSES"]), ({"p_floor": 0.125}, False, ["p has a floor of 0.1250, above the level: no effect of any size could be significant", "influence: ROBUST", "sign test: PASSES"]),
    ({"at_the_floor": True}, False, ["p is at its floor, which tells the design's resolution and not how small p is", "influence: ROBUST", "sign test: PASSES"]),
    ({"survives": False}, False, ["influence: FRAGILE, the slope rests on its most exposed firms", "sign test: PASSES"]), ({"agrees": False}, False, ["influence: FRAGILE, its forms disagree in sign", "sign test: PASSES"]),
    ({"concentrated": True}, True, ["influence: CAUTION, leverage is concentrated in 8 of 40 firms", "sign test: PASSES"]), ({"sign": (False, False, "FAILS")}, False, ["influence: ROBUST", "sign test: FAILS"]),
    ({"sign": (False, True, "UNDERPOWERED")}, True, ["influence: ROBUST", "sign test: UNDERPOWERED"]), ({"sign": None}, True, ["influence: ROBUST", "the sign test was not run, and the pooled slope stands without it"]),
])
def test_a_slope_is_trusted_only_if_every_check_passes(spark, change, trusted, said):
    head = reporting.dose_headline(*parts(spark, **change))
    assert head.first()["trustworthy"] is trusted
    assert [r["note"] for r in reporting.dose_caveats(head).orderBy("place").collect()] == said


def test_dose_report_and_its_refusal(spark):
    boot, influence, leverage, mde, sign = parts(spark)
    for nothing in (None, influence.limit(0)):
        with pytest.raises(reporting.MissingInfluence):
            reporting.dose_headline(boot, nothing, leverage, mde, sign)
    path = spark.createDataFrame([(3, "a, b, c", 0.4), (0, "", 0.5)], "k int, dropped string, beta double")
    text = reporting.dose_report("Slope", reporting.dose_headline(boot, influence, leverage, mde, sign), path, leverage, sign)
    assert text.startswith("# Slope\n\nAn effect of 0.25 would") and text.index("| 0 |") < text.index("| 3 |") and text.rstrip().endswith("- sign test: PASSES")


EVENTS = [("e2", "2020-02-02", True, "tighten", "low", "", ""), ("e1", "2020-01-01", False, "loosen", "High ", "", "briefed"), ("e3", "2020-03-03", True, "tighten", "medium", "budget", "trailed"), ("e4", "2020-04-04", True, "tighten", "low", None, None)]


def test_study_report(spark):
    events = spark.createDataFrame(EVENTS, "event_id string, announced string, time_known boolean, direction string, risk string, confounder string, leak_note string")
    notes = {}
    for r in reporting.event_caveats(events).orderBy("event_id", "place").collect():
        notes.setdefault(r["event_id"], []).append(r["note"].split(":")[0])
    assert notes == {"e1": ["anticipated", "curator"], "e3": ["confounded on its day by", "leaked"]}
    names = "event_id string, unit_id string, estimator string, tau double, ratio double, placebos long, p_in_space double, p_in_time double, p_floor double, pre_rmspe double, pre_fit string, pretrend_violated boolean, loo_sign_stable boolean, loo_relative_shift double, effective_donors double, critical double, mde double, feasible boolean, error_type string, message string"
    rows = [
        ("e2", "u", "market_model", 0.02, 1.5, 24, 0.04, None, 0.04, 0.1, "MARGINAL", False, None, None, None, 0.05, 0.09, True, None, None),
        ("e2", "u", "synthetic_control", None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, "TooFewDonors", "1 other units have complete windows"),
        ("e1", "u", "market_model", 0.02, 1.5, 4, 0.2, None, 0.2, 0.1, "MARGINAL", True, None, None, None, 0.05, 0.09, False, None, None),
    ]
    frame = spark.createDataFrame(rows, names)
    text = reporting.study_report("Study", events, frame)
    clean, apart = text.split("## Events reported separately")
    assert "### e2" in clean and "### e1" not in clean and "### e1" in apart and "> anticipated" in apart and "> curator: briefed" in apart and "### e4" not in text and "_1 events_" in clean
    assert "24 placebos: +5.00 % would be in the tail, +9.00 % would mostly be found, +2.00 % was seen" in clean and "TooFewDonors: 1 other units" in clean and "4 placebos allow no p under 0.200: nothing could be significant" in apart
    with pytest.raises(reporting.MissingPlacebos, match="e2"):
        reporting.study_report("Study", events, frame.withColumn("placebos", frame["placebos"] * 0))
