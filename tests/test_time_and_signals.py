import pytest
from pyspark.sql import functions as F

from rayscape import constants as K
from rayscape.functions import gnss
from rayscape.functions import time as T
from rayscape.operators.features import process_raw

E = K.GPS_EPOCH
DAY = K.DAY


def column(spark, values, kind="long"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i")


def results(df, *exprs):
    return [tuple(r) for r in df.select(*exprs).collect()]


def test_leap_seconds(spark):
    days = [1_420_070_399, 1_483_228_799, 1_483_228_800]
    df = column(spark, [d * K.SECOND for d in days] + [None])
    assert [r[0] for r in results(df, T.leap_seconds(F.col("v")))] == [None, 17, 18, None]


def test_gps_and_utc(spark):
    gps, utc = 1167264018 * K.SECOND, 1_483_228_800 * K.SECOND
    df = column(spark, [gps, gps + 1, None])
    assert [r[0] for r in results(df, T.gps_to_utc(F.col("v")))] == [utc, utc + 1, None]
    df = column(spark, [utc, utc + 1, None])
    assert [r[0] for r in results(df, T.utc_to_gps(F.col("v")))] == [gps, gps + 1, None]
    # the inserted second falls on the midnight after it, and leap seconds can be told from GPS time alone
    around = column(spark, [gps + k * K.SECOND // 2 for k in range(-6, 7)])
    assert [a == b for a, b in results(around, T.leap_seconds(T.gps_to_utc(F.col("v"))), T.leap_seconds_at_gps(F.col("v")))] == [True] * 13


def test_days_and_weeks(spark):
    df = column(spark, [1, 2, None])
    assert results(df, *T.gps_to_doy(F.col("v"))) == [("1980006", 1), ("1980006", 2), (None, None)]
    dates = column(spark, ["1980006", "1981366", "1980366", "x", None], "string")
    got = [r[0] for r in results(dates, T.doy_to_gps(F.col("v"), F.lit(5)))]
    assert got == [5, None, 360 * DAY + 5, None, None]
    week = column(spark, [604800 * 2000 * K.SECOND + 10**7])
    assert results(week, *T.gps_to_gpsweek(F.col("v"))) == [(2000, 0, 10**7)]
    assert results(week, T.gpsweek_to_gps(F.lit(2000), F.lit(0), F.lit(10**7)))[0][0] == 604800 * 2000 * K.SECOND + 10**7


def test_ambiguity_and_identifiers(spark):
    df = column(spark, [k * 10**8 + k for k in range(6, 11)])
    assert [r[0] for r in results(df, gnss.ambiguity(F.col("v")))] == [k * 10**8 for k in range(6, 11)]
    df = column(spark, [1, 32, 106])
    assert [r[0] for r in results(df, gnss.svid(F.lit("R"), F.col("v")))] == ["R01", "R32", "R106"]
    df = column(spark, ["R93", "R94", "R05", "G01", None], "string")
    assert [r[0] for r in results(df, gnss.slots(F.col("v")))] == [["R10", "R14"], ["R94"], ["R05"], ["G01"], [None]]
    assert [r[0] for r in results(column(spark, ["G32", "G33", "E36", "J01", "R00"], "string"), gnss.is_supported(F.col("v")))] == [True, False, True, False, False]


def test_versions_and_platforms(spark):
    df = column(spark, ["v1.3", "v1.4", "2.0.0.10", "1.10", None], "string")
    assert [r[0] for r in results(df, gnss.version_at_least(F.col("v"), F.lit("1.4.0.0")))] == [False, True, True, True, None]
    df = column(spark, ["6", "M", "7", "N", "O", "10", None], "string")
    assert [r[0] for r in results(df, gnss.platform_at_least(F.col("v")))] == [False, False, True, True, True, True, False]


@pytest.mark.parametrize("sent", [10**7, -(10**7)])
def test_transmit_time_and_roll_over(spark, sent):
    """A signal that left in the week before is put back there."""
    rx = K.WEEK * 2000 + 10**8
    received = (rx - 9 * 10**7 if sent > 0 else rx - 10**8 - 10**7) % K.WEEK
    raw = spark.createDataFrame([(1, 1, rx, 0, received, 9), (9, 1, rx, 0, received, 9), (1, 1, rx, 0, received, 8)], "ConstellationType long, Svid long, TimeNanos long, FullBiasNanos long, ReceivedSvTimeNanos long, State long")
    rows = process_raw(raw).collect()
    assert rows[0].svid == "G01" and rows[0].tx == (K.WEEK * 2000 + 10**7 if sent > 0 else K.WEEK * 2000 - 10**7)
    assert rows[0].pr == pytest.approx((rx - rows[0].tx) * 1e-9 * 299792458)
    assert rows[1].svid is None and rows[1].tx is None and rows[2].tx is None
