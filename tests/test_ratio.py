"""Ratios divide as floating point does and round as their SQL does."""

import math
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from barloom.operators import bars
from barloom.plans import oracles, queries

START = datetime(2024, 1, 1)
#: Values of view and of click in one hour each: zeros on either side, signs, halves at the ninth digit, quotients of many digits.
HOURS = [(0.41, 51.20), (1.69, 51.20), (5.0, 0.0), (0.0, 0.0), (-5.0, 0.0), (0.0, 3.0), (0.0, -3.0), (-0.41, 51.20), (41.0, 51.20), (1.0, 3.0), (123456789.12, 0.07)]


@pytest.mark.parametrize("kind", ["bigint", "double", "decimal(12,2)"])
def test_over_zero_as_floating_point(spark, kind):
    sides = [spark.createDataFrame([("s", START + timedelta(hours=i), pair[j]) for i, pair in enumerate([(5, 0), (-5, 0), (0, 0), (None, 0), (5, None), (3, 2)])], "stream_id string, ts timestamp_ntz, p long") for j in (0, 1)]
    a, b = (x.select("stream_id", "ts", *[F.col("p").cast(kind).alias(c) for c in bars.PRICES], F.lit(1.0).alias("volume")) for x in sides)
    got = bars.ratio(a, b, "a/b").orderBy("ts").collect()
    for c in bars.PRICES:
        values = [r[c] for r in got]
        assert values[:2] == [math.inf, -math.inf] and math.isnan(values[2]) and values[3:] == [None, None, 1.5]


def test_query_has_the_rows_of_its_sql(spark, tmp_path):
    rows = [(2 * i + j, START + timedelta(hours=i, minutes=j), 1, kind, HOURS[i][j], "{}") for i in range(len(HOURS)) for j, kind in enumerate(("view", "click"))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(oracles.oracle_sql()["ratio_bars"])
    got = queries.queries()["ratio_bars"](spark, str(tmp_path))
    assert got.columns == want.columns
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, want.fetchall()))
