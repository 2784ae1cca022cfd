"""Properties of the numerical kernels, guards, sources and sinks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.tails import inverse_normal, normal_two_sided, t_two_sided
from tidemark.operators import checks, dose, kernels, reporting, resampling, timing
from tidemark.sources import readers, sinks
from tidemark.streaming.bars import windowed_counts


def test_tails_against_published_values():
    assert t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert t_two_sided(12.706205, 1) == pytest.approx(0.05, abs=1e-6)
    assert normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert inverse_normal(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert math.isnan(t_two_sided(1.0, 0))


def test_simplex_weights_are_recovered():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8))
    w = np.array([0.5, 0.3, 0.2, 0, 0, 0, 0, 0])
    got, c = kernels.simplex_least_squares(x @ w + 3.0, x, intercept=True)
    assert np.allclose(got, w, atol=1e-4) and c == pytest.approx(3.0, abs=1e-3)
    assert got.sum() == pytest.approx(1.0) and (got >= 0).all()


def test_leverage_sums_to_the_rank(spark):
    rng = np.random.default_rng(1)
    rows = [(f"e{e}", f"u{u}", float(rng.normal()), float(rng.normal())) for e in range(4) for u in range(20)]
    frame = spark.createDataFrame(rows, "event_id string, unit_id string, car double, exposure double")
    assert kernels.leverage(frame).agg(F.sum("hat")).collect()[0][0] == pytest.approx(5.0)


def test_fixed_effects_slope_equals_dummies(spark):
    rng = np.random.default_rng(2)
    rows = [(f"e{e}", f"u{u}", float(e + 0.5 * x + rng.normal() * 0.1), float(x)) for e in range(5) for u, x in enumerate(rng.normal(size=30))]
    frame = spark.createDataFrame(rows, "event_id string, unit_id string, car double, exposure double")
    got = dose.cluster_error(frame).collect()[0]
    x = np.array([r[3] for r in rows])
    d = np.array([[r[0] == f"e{e}" for e in range(5)] for r in rows], float)
    design, y = np.column_stack([x, d]), np.array([r[2] for r in rows])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    e = y - design @ beta
    g = np.linalg.inv(design.T @ design)
    scores = np.stack([(design * e[:, None])[d[:, k] == 1].sum(0) for k in range(5)])
    v = 5 / 4 * (len(y) - 1) / (len(y) - 6) * g @ (scores.T @ scores) @ g
    assert got["beta"] == pytest.approx(beta[0], rel=1e-9) and got["se"] == pytest.approx(math.sqrt(v[0, 0]), rel=1e-9)
    again = resampling.wild_bootstrap(frame, "webb", draws=200).collect()[0]
    assert again["p_wild"] < 0.05 and again["p_floor"] == pytest.approx(max(2 / 6**5, 1 / 201))
    with pytest.raises(dose.NotIdentified):
        dose.check_identified(frame.withColumn("exposure", F.lit(1.0)))


def test_groups_split_at_exactly_fourteen_days(spark):
    rows = [("a", "2020-01-01 00:00:00"), ("b", "2020-01-14 23:00:00"), ("c", "2020-01-28 23:00:00"), ("d", "2020-02-05 00:00:00")]
    frame = spark.createDataFrame(rows, "event_id string, t string").select("event_id", F.col("t").cast("timestamp").alias("ts"))
    assert dict(timing.group_events(frame).select("event_id", "group_id").collect()) == {"a": "grp:a", "b": "grp:a", "c": "grp:c", "d": "grp:c"}


def test_summer_time_sessions(spark):
    days = spark.sql("SELECT DATE '2024-07-17' AS dt UNION ALL SELECT DATE '2024-01-17'")
    opens = {str(r["dt"]): str(r["opens"]) for r in timing.sessions(days).collect()}
    assert opens == {"2024-07-17": "2024-07-17 07:00:00", "2024-01-17": "2024-01-17 08:00:00"}


def test_guards_refuse(spark):
    issues = spark.createDataFrame([("a", "c", "m", True)], "event_id string, column string, message string, fatal boolean")
    with pytest.raises(checks.ValidationRefused):
        checks.refuse_if_fatal(issues)
    estimates = spark.createDataFrame([("e1",), ("e2",)], "event_id string")
    with pytest.raises(reporting.MissingPlacebos):
        reporting.require_placebos(estimates, estimates.where("event_id = 'e1'"), "event_id")
    with pytest.raises(reporting.MissingInfluence):
        reporting.dose_section(estimates, None)
    with pytest.raises(ValueError):
        resampling.wild_bootstrap(estimates, "normal")


def test_csv_keeps_blanks_and_checks_columns(spark, tmp_path):
    p = str(tmp_path / "a.csv")
    open(p, "w").write("id,name\n1,\nNA,x\n")
    rows = readers.csv_strings(spark, p, ("id",), ("note",)).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", "", ""), ("NA", "x", "")]
    with pytest.raises(readers.MissingColumns):
        readers.csv_strings(spark, p, ("gone",))
    sinks.write_template(str(tmp_path / "t.csv"), ("a", "b"))
    with pytest.raises(FileExistsError):
        sinks.write_template(str(tmp_path / "t.csv"), ("a", "b"))


def test_vintage_reports_the_absent(spark, tmp_path):
    p = str(tmp_path / "v")
    sinks.write_vintage(spark.createDataFrame([("A", "v1", 1.0), ("B", "v2", 2.0)], "source_ticker string, vintage string, close double"), p)
    rows, absent = readers.vintage(spark, p, "v1", spark.createDataFrame([("A",), ("B",)], "source_ticker string"))
    assert rows.count() == 1 and [r[0] for r in absent.collect()] == ["B"]


def test_batch_verdicts(spark):
    schema = "ticker string, rows int, error string"
    assert readers.batch_verdict(spark.createDataFrame([("A", 3, None)], schema)) == "complete"
    with pytest.raises(ValueError, match="B"):
        readers.batch_verdict(spark.createDataFrame([("A", 3, None), ("B", 0, None)], schema))
    with pytest.raises(readers.SourceUnreachable):
        readers.batch_verdict(spark.createDataFrame([("A", 0, None), ("B", 0, None)], schema))


def test_partition_check_and_markdown(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "unit_id string")
    bad = checks.check_partition(wanted, wanted.where("unit_id <> 'c'"), wanted.where("unit_id = 'a'"))
    assert {tuple(r) for r in bad.collect()} == {("a", "repeated"), ("c", "missing")}
    assert sinks.markdown(spark.createDataFrame([(1.5, None)], "x double, y string")).endswith("| 1.5000 | — |")
    assert sinks.markdown(wanted.limit(0)) == "_(no rows)_"
    assert sinks.markdown(spark.range(5).toDF("x"), 3).endswith("_(2 more rows)_")


def test_stream_counts_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").agg(F.sum("n")).collect()[0][0] == events.count()


def test_active_set_equals_projected_gradient(monkeypatch):
    rng = np.random.default_rng(79)
    for n, rows, penalty, intercept in ((2, 30, 0.0, False), (8, 40, 1e-6, False), (24, 250, 1e-6, True), (40, 30, 0.3, True), (12, 12, 0.0, False)):
        x = rng.normal(size=(rows, n)).cumsum(0)
        y = x @ rng.dirichlet(np.full(n, 0.3)) + rng.normal(size=rows)
        w, c = kernels.simplex_least_squares(y, x, penalty, intercept)
        with monkeypatch.context() as m:
            m.setattr(kernels, "_active_set", lambda *_: None)
            v, d = kernels.simplex_least_squares(y, x, penalty, intercept, steps=200_000)

        def loss(w, c):
            return ((y - c - x @ w) ** 2).sum() + penalty * y.var() * (w @ w)

        assert w.min() >= 0 and w.sum() == pytest.approx(1) and loss(w, c) <= loss(v, d) * (1 + 1e-9) and np.abs(w - v).max() < 1e-4
        assert kernels._active_set(x.T @ x, x.T @ y) is not None
    same = np.ones((5, 3))
    assert kernels.simplex_least_squares(np.ones(5), same)[0].sum() == pytest.approx(1)  # equal donors


def test_synthetic_weights_equal_a_grid_search():
    rng = np.random.default_rng(73)
    for _ in range(10):
        x, y = rng.normal(size=(9, 3)), rng.normal(size=9)
        w, _ = kernels.simplex_least_squares(y, x)
        grid = np.array([(a, b, 100 - a - b) for a in range(101) for b in range(101 - a)]) / 100
        best = ((y[:, None] - x @ grid.T) ** 2).sum(0)
        assert ((y - x @ w) ** 2).sum() <= best.min() + 1e-9 and np.abs(grid[best.argmin()] - w).max() < 0.011


def test_registered_bootstraps_draw_as_often_as_the_floor_says(spark):
    from tidemark.plans import dose_queries

    assert dose_queries.wild_bootstrap_p(spark, "/root/testdata/sf0.01").first()["draws"] == 2000
    ar = spark.createDataFrame([("e", "u", n - 30, float(math.sin(n * n))) for n in range(36)], "event_id string, unit_id string, rel int, ar double")
    p = kernels.block_bootstrap(ar, 10, 5).first()["p"] * 2000
    assert p == pytest.approx(round(p)) and p % 4
