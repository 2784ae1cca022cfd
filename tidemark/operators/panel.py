"""Return panels: returns, the calendar spine, completeness, screens and controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _own(order: str = "dt"):
    return Window.partitionBy("unit_id").orderBy(order)


def point_in_time_returns(prices: DataFrame, dividend: str | None = None, split: str | None = None) -> DataFrame:
    """(..., ret): (k * P + D) / previous P - 1 on the unit's own calendar; a split ratio of 0 counts as 1.

    Null, and no ratio, where there is no previous price or it is zero.
    """
    k = F.when(F.col(split) == 0, 1.0).otherwise(F.coalesce(F.col(split), F.lit(1.0))) if split else F.lit(1.0)
    d = F.coalesce(F.col(dividend), F.lit(0.0)) if dividend else F.lit(0.0)
    before = F.lag("px").over(_own())
    return prices.withColumn("ret", (k * F.col("px").cast("double") + d) / F.nullif(before.cast("double"), F.lit(0.0)) - 1)


def padded_returns(prices: DataFrame, column: str = "px") -> DataFrame:
    """(..., ret): change of an adjusted series whose gaps repeat the last known value."""
    known = F.last(column, ignorenulls=True).over(_own().rowsBetween(Window.unboundedPreceding, 0))
    filled = prices.withColumn("_known", known.cast("double"))
    return filled.withColumn("ret", F.col("_known") / F.nullif(F.lag("_known").over(_own()), F.lit(0.0)) - 1).drop("_known")


def lag_late_markets(returns: DataFrame, late: Column) -> DataFrame:
    """Units that close late get their return one step later on their own calendar, before any join to the spine."""
    return returns.withColumn("ret", F.when(late, F.lag("ret").over(_own())).otherwise(F.col("ret")))


def market_spine(prices: DataFrame) -> DataFrame:
    """(dt, pos, mkt): the market's dates, numbered from 0, with its return.

    One row a date: the calendar is small whatever the panel, so its single
    ordered window is over an aggregate, never over panel rows.
    """
    market = prices.groupBy("dt").agg(F.sum("px").alias("p"))
    order = Window.orderBy("dt")
    return market.select("dt", (F.row_number().over(order) - 1).alias("pos"), (F.col("p").cast("double") / F.lag("p").over(order) - 1).alias("mkt"))


def align(returns: DataFrame, spine: DataFrame) -> DataFrame:
    """(unit_id, dt, pos, mkt, ret): every unit on every spine date; missing returns stay null."""
    units = returns.select("unit_id").distinct()
    # unit x calendar is the panel itself: the product of its two dimensions
    return spine.crossJoin(units).join(returns.select("unit_id", "dt", "ret"), ["unit_id", "dt"], "left").select("unit_id", "dt", "pos", "mkt", "ret")


def window(panel: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of dates from start to end, both included."""
    return panel.where(F.col("dt").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def complete_units(panel: DataFrame) -> DataFrame:
    """(unit_id): units without a missing return on the panel's dates."""
    return panel.groupBy("unit_id").agg(F.count("*").alias("days"), F.count("ret").alias("known")).where("known = days").select("unit_id")


def cumulative(panel: DataFrame, log: bool = False) -> DataFrame:
    """(..., cum): running sum of returns (or of log returns); null where the return is null, resuming after it."""
    step = F.log1p("ret") if log else F.col("ret")
    total = F.sum(step).over(_own("pos").rowsBetween(Window.unboundedPreceding, 0))
    return panel.withColumn("cum", F.when(F.col("ret").isNotNull(), total))


def equal_weighted(panel: DataFrame) -> DataFrame:
    """(dt, ret, units): mean return of the units that have one."""
    return panel.groupBy("dt").agg(F.avg("ret").alias("ret"), F.count("ret").alias("units"))


def liquidity_screen(prices: DataFrame, floor: float, start: str, end: str, scale: float = 1.0) -> DataFrame:
    """(unit_id, turnover, screened_out): mean px * vol in the window, both ends included, against a floor."""
    inside = F.col("dt").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    turnover = F.avg(F.when(inside, F.col("px").cast("double") * F.col("vol"))) * scale
    return prices.groupBy("unit_id").agg(turnover.alias("turnover")).withColumn("screened_out", F.coalesce(F.col("turnover") < floor, F.lit(True)))


def history_screen(candidates: DataFrame, prices: DataFrame, least_rows: int, end: str, floor: float, days: int = 365) -> DataFrame:
    """(unit_id, status, reason): ordered reasons, first that holds wins; every candidate has one row."""
    recent = F.col("dt").between(F.date_sub(F.lit(end).cast("date"), days), F.lit(end).cast("date"))
    stats = prices.groupBy("unit_id").agg(F.count("*").alias("n"), F.count(F.when(recent, 1)).alias("recent"), (F.avg(F.when(recent, F.col("px").cast("double") * F.col("vol"))) / 100).alias("turnover"))
    reason = F.when(F.col("n").isNull(), "no_data").when(F.col("n") < least_rows, "short_history").when(F.col("recent") == 0, "no_recent_rows").when(F.col("turnover") < floor, "illiquid")
    status = F.when(reason.isNull(), "admitted").when(F.col("n").isNull(), "no_data").otherwise("rejected")
    return candidates.join(stats, "unit_id", "left").select("unit_id", status.alias("status"), reason.alias("reason"))


def build_panel(listings: DataFrame, prices: DataFrame, spine: DataFrame, floor: float, screen_start: str, screen_end: str) -> DataFrame:
    """(unit_id, dt, pos, mkt, ret, turnover, screened_out): source series to the panel that estimators read.

    ``listings`` unit_id, source_ticker, first, last, late; ``prices``
    source_ticker, dt, px, vol.  Returns are taken on each series' own calendar,
    series of late markets lagged a step, then given to every unit of the series
    within its listing, laid on the spine, and units marked whose turnover in the
    screening window is below ``floor`` or not known.  A unit without a price
    keeps its rows.
    """
    from tidemark.operators.screening import listed_returns

    returns = point_in_time_returns(prices.withColumnRenamed("source_ticker", "unit_id"))
    late = listings.groupBy("source_ticker").agg(F.max("late").alias("late")).withColumnRenamed("source_ticker", "unit_id")
    lagged = lag_late_markets(returns.join(late, "unit_id"), F.col("late")).select(F.col("unit_id").alias("source_ticker"), "dt", "ret")
    own = listed_returns(listings, lagged)
    grid = spine.crossJoin(listings.select("unit_id"))  # the panel itself: its two dimensions
    screened = liquidity_screen(prices.withColumnRenamed("source_ticker", "unit_id"), floor, screen_start, screen_end).withColumnRenamed("unit_id", "source_ticker")
    marks = listings.select("unit_id", "source_ticker").join(screened, "source_ticker", "left").select("unit_id", "turnover", F.coalesce("screened_out", F.lit(True)).alias("screened_out"))
    return grid.join(own, ["unit_id", "dt"], "left").join(marks, "unit_id").select("unit_id", "dt", "pos", "mkt", "ret", "turnover", "screened_out")


def controls(panel: DataFrame, prices: DataFrame | None, windows: DataFrame, momentum: int = 252, skip: int = 21, pence: Column | None = None) -> DataFrame:
    """(event_id, unit_id, size, momentum, pre_event_vol, size_is_fallback) over each event's estimation window.

    size: log of mean px * vol, a hundredth of it for units quoted in ``pence``
    (a condition on unit_id), or without ``prices`` the log of the returns'
    variance, which is a weaker stand-in and says so; momentum: compounded return of ``momentum``
    steps that end ``skip`` steps before the window's last, end excluded;
    volatility: yearly sample deviation.  Short histories give null.
    """
    rows = panel.withColumns({"px": F.lit(None).cast("double"), "vol": F.lit(None).cast("double")}) if prices is None else panel.join(prices.select("unit_id", "dt", "px", "vol"), ["unit_id", "dt"], "left")
    # positions are spelt out, so that windows meet the panel by an equi-join on the calendar ordinal
    first = F.least("pre_start", F.col("pre_end") - 1 - skip - momentum)
    spans = windows.select("event_id", "pre_start", "pre_end", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.col("pre_end") - 1)).alias("pos"))
    last = F.col("pre_end") - 1
    pre = F.col("pos") >= F.col("pre_start")
    mom = (F.col("pos") >= last - skip - momentum) & (F.col("pos") < last - skip)
    joined = rows.join(spans, "pos")
    out = joined.groupBy("event_id", "unit_id").agg(
        F.avg(F.when(pre, F.col("px").cast("double") * F.col("vol"))).alias("_turnover"), F.var_samp(F.when(pre, F.col("ret"))).alias("_variance"),
        F.expm1(F.sum(F.when(mom, F.log1p("ret")))).alias("momentum"),
        F.count(F.when(mom, F.lit(1))).alias("_m"),
        (F.stddev_samp(F.when(pre, F.col("ret"))) * F.sqrt(F.lit(252.0))).alias("pre_event_vol"),
    )
    turnover = F.col("_turnover") / F.when(F.coalesce(pence, F.lit(False)), 100.0).otherwise(1.0) if pence is not None else F.col("_turnover")
    of = F.col("_variance") if prices is None else turnover
    size = F.when(of > 0, F.log(of))
    return out.select("event_id", "unit_id", size.alias("size"), F.when(F.col("_m") == momentum, F.col("momentum")).alias("momentum"), "pre_event_vol", F.lit(prices is None).alias("size_is_fallback"))
