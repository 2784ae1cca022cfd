"""Panels derived from the star-schema tables: weekly unit prices stand for traded series.

Money is summed as exact integers (cents times hundredths), so that any engine
gets the same figures.  Dates are cast to DATE at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Window lengths in weeks: estimation, embargo, horizon.
ESTIMATION, GAP, HORIZON = 250, 30, 20

#: (event_id, announced, time_known, direction, risk, brand, confounder, leak_note)
ANNOUNCEMENTS = (
    ("a1", "1999-03-08 09:00:00", True, "tighten", "low", "Brand#11", "", ""),
    ("a2", "2000-06-05 09:00:00", True, "tighten", "low", "Brand#12", "", ""),
    ("a3", "2000-06-14 12:30:00", True, "loosen", "medium", "Brand#13", "", ""),
    ("a4", "2000-06-23 07:59:00", True, "tighten", "high", "Brand#21", "", "briefed"),
    ("a5", "2000-09-04 00:00:00", False, "tighten", "low", "Brand#22", "budget", ""),
    ("a6", "2000-09-18 00:00:00", False, "loosen", "low", "Brand#23", "", ""),
    ("a7", "2001-01-15 08:00:00", True, "tighten", "medium", "Brand#31", "", ""),
    ("a8", "2001-04-02 16:30:00", True, "loosen", "low", "Brand#32", "", ""),
    ("a9", "2001-09-03 10:00:00", True, "tighten", "high", "Brand#33", "", ""),
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def weekly_prices(spark: SparkSession, folder: str) -> DataFrame:
    """(unit_id, dt, px, vol): net revenue and quantity of a nation's suppliers by week."""
    # amounts are whole cents but for the last bits of a double, so the nearest whole number needs no decimal rounding
    cents = F.rint(F.col("l_extendedprice") * 100).cast("long") * (100 - F.rint(F.col("l_discount") * 100).cast("long"))
    lines = table(spark, folder, "lineitem").select("l_suppkey", F.trunc(F.to_date("l_shipdate"), "week").alias("dt"), cents.alias("cents"), F.col("l_quantity").cast("long").alias("quantity"))
    # the nation of a supplier is a small dimension, which Catalyst broadcasts by its size: the one shuffle has a row a unit, week and task
    units = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("unit_id"), F.col("n_regionkey").alias("region"))
    return lines.join(units, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("unit_id", "region", "dt").agg(F.sum("cents").alias("px"), F.sum("quantity").alias("vol"))


def announcements(spark: SparkSession) -> DataFrame:
    names = "event_id string, announced string, time_known boolean, direction string, risk string, brand string, confounder string, leak_note string"
    return spark.createDataFrame(list(ANNOUNCEMENTS), names).withColumn("ts", F.to_timestamp_ntz(F.col("announced"), F.lit("yyyy-MM-dd HH:mm:ss")))


def attributes(spark: SparkSession, folder: str) -> DataFrame:
    """(unit_id, attribute, value, as_of, knowable): a unit's yearly revenue share by brand, published 75 days after year's end.

    Each year's report also restates the year before, so an as-of date has two publications.
    """
    lines = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey", F.year("l_shipdate").alias("y"), F.rint(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    brands = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    units = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("unit_id"))
    sums = lines.join(brands, "l_partkey").join(units, "l_suppkey").groupBy("unit_id", "y", "brand").agg(F.sum("cents").alias("c"))
    total = sums.groupBy("unit_id", "y").agg(F.sum("c").alias("t"))
    share = sums.join(total, ["unit_id", "y"]).select("unit_id", F.concat(F.lit("revenue_share_"), "brand").alias("attribute"), (F.col("c") / F.col("t")).alias("value"), F.make_date("y", F.lit(12), F.lit(31)).alias("as_of"))
    first = share.withColumn("knowable", F.date_add("as_of", 75))
    again = share.withColumn("knowable", F.date_add(F.add_months("as_of", 12), 75))
    return first.unionByName(again)


def cte(*names: str) -> str:
    """WITH clause of the named fixtures and of all that they need, for the SQL statements of the same results."""
    done: list[str] = []

    def add(name: str) -> None:
        for other in _NEEDS.get(name, ()):
            add(other)
        if name not in done:
            done.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({_SQL[n]})" for n in done) + "\n"


_NEEDS = {"spine": ("px",), "rets": ("px",), "panel": ("spine", "rets", "units"), "units": ("px",), "ev": ("ann", "spine"), "fit": ("panel", "ev"), "ar": ("fit",), "car": ("ar",), "expo": ("attr", "ann"), "dose": ("car", "expo")}

_SQL = {
    "px": """SELECT n_name AS unit_id, n_regionkey AS region, CAST(date_trunc('week', l_shipdate) AS DATE) AS dt,
  CAST(SUM(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))) AS BIGINT) AS px,
  CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS vol
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3""",
    "units": "SELECT DISTINCT unit_id, region FROM px",
    "spine": """SELECT dt, pos, CAST(p AS DOUBLE) / lag(p) OVER (ORDER BY dt) - 1 AS mkt FROM
  (SELECT dt, CAST(SUM(px) AS BIGINT) AS p, CAST(row_number() OVER (ORDER BY dt) - 1 AS INT) AS pos FROM px GROUP BY dt)""",
    "rets": "SELECT unit_id, dt, CAST(px AS DOUBLE) / lag(px) OVER (PARTITION BY unit_id ORDER BY dt) - 1 AS ret FROM px",
    "panel": """SELECT units.unit_id, region, spine.dt, pos, mkt, ret FROM spine CROSS JOIN units
  LEFT JOIN rets ON rets.unit_id = units.unit_id AND rets.dt = spine.dt""",
    "ann": "SELECT * FROM (VALUES " + ", ".join("('{}', TIMESTAMP '{}', {}, '{}', '{}', '{}', '{}', '{}')".format(a, t, str(k).lower(), *rest) for a, t, k, *rest in ANNOUNCEMENTS) + ") AS v(event_id, ts, time_known, direction, risk, brand, confounder, leak_note)",
    "ev": f"""SELECT event_id, direction, t0, CASE WHEN t0 < {ESTIMATION + GAP} THEN 'history_short' WHEN t0 + {HORIZON} > last THEN 'post_short' END AS reason,
  t0 - {ESTIMATION + GAP} AS pre_start, t0 - {GAP} AS pre_end, t0 + {HORIZON} AS post_end
  FROM (SELECT event_id, direction, (SELECT min(pos) FROM spine WHERE spine.dt >= CAST(ann.ts AS DATE)) AS t0, (SELECT max(pos) FROM spine) AS last FROM ann)""",
    "fit": f"""SELECT event_id, unit_id, t0, regr_slope(ret, mkt) AS beta, regr_intercept(ret, mkt) AS alpha, regr_r2(ret, mkt) AS r2, CAST(count(ret) AS BIGINT) AS n
  FROM panel JOIN ev ON pos >= pre_start AND pos < pre_end WHERE reason IS NULL GROUP BY 1, 2, 3 HAVING count(ret) = {ESTIMATION}""",
    "ar": f"""SELECT fit.event_id, fit.unit_id, fit.t0, pos - fit.t0 AS rel, ret, mkt, ret - alpha - beta * mkt AS ar FROM fit
  JOIN panel ON panel.unit_id = fit.unit_id AND pos >= fit.t0 - {ESTIMATION + GAP} AND pos <= fit.t0 + {HORIZON}""",
    "car": "SELECT event_id, unit_id, SUM(ar) AS car FROM ar WHERE rel BETWEEN 0 AND 1 GROUP BY 1, 2 HAVING count(ar) = 2",
    "attr": """SELECT unit_id, attribute, value, as_of, CAST(as_of + INTERVAL 75 DAY AS DATE) AS knowable FROM shares
  UNION ALL SELECT unit_id, attribute, value, as_of, CAST(make_date(year(as_of) + 1, 12, 31) + INTERVAL 75 DAY AS DATE) FROM shares""",
    "shares": """SELECT unit_id, concat('revenue_share_', p_brand) AS attribute, CAST(c AS DOUBLE) / SUM(c) OVER (PARTITION BY unit_id, y) AS value, make_date(y, 12, 31) AS as_of FROM
  (SELECT n_name AS unit_id, CAST(year(l_shipdate) AS INT) AS y, p_brand, CAST(SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS c
   FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3)""",
    "expo": """SELECT event_id, direction, unit_id, value AS exposure FROM (
  SELECT ann.event_id, direction, attr.unit_id, value, row_number() OVER (PARTITION BY ann.event_id, attr.unit_id ORDER BY knowable DESC, as_of DESC) AS k
  FROM ann JOIN attr ON attr.attribute = concat('revenue_share_', ann.brand) AND attr.knowable < CAST(ann.ts AS DATE)) WHERE k = 1""",
    "dose": "SELECT car.event_id, car.unit_id, direction, car, exposure FROM car JOIN expo ON car.event_id = expo.event_id AND car.unit_id = expo.unit_id",
}
_NEEDS["attr"] = ("shares",)
