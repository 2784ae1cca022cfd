"""Run each named query beside its SQL, as the driver does: rows, columns and values, order aside."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return "null"
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, (int, float)) or hasattr(x, "dtype"):
            return repr(float(x)) if float(x) != int(float(x)) or abs(float(x)) > 1e15 else str(int(x)) if abs(float(x)) < 1e15 else repr(float(x))
        if hasattr(x, "isoformat"):
            return str(pd.Timestamp(x))
        return str(x)

    return sorted(tuple("null" if v is None else cell(v) for v in row) for row in frame.astype(object).itertuples(index=False, name=None))


def differences(spark, build, sql: str, folder: str, con) -> str:
    got = build(spark, folder).toPandas()
    want = con.execute(sql).fetchdf()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} against {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if not a:
        return "no rows"
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} of {len(a)} rows differ: {bad[:2]}" if bad else ""


def main(folder: str, names: list[str]) -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = entry.oracle_sql()
    for name, build in entry.queries().items():
        if name in oracles and (not names or any(n in name for n in names)):
            began = time.time()
            try:
                said = differences(spark, build, oracles[name], folder, con)
            except Exception as e:  # noqa: BLE001
                said = f"{type(e).__name__}: {str(e)[:400]}"
            print(f"{'ok ' if not said else 'BAD'} {name} {time.time() - began:.1f}s {said}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
