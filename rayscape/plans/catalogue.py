"""Each operator as a query over the benchmark tables, with the same result in SQL.

The tables hold no measurements, so inputs are derived from them by whole-number arithmetic that both engines share.
Results that pass through transcendental functions are compared in whole millionths.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rayscape import constants as K
from rayscape import schemas
from rayscape.functions import diffraction, fourpl, geodesy, gnss, planar
from rayscape.functions import time as T
from rayscape.operators import logistic, orbit, simulate, spatial
from rayscape.operators import predict as heights
from rayscape.operators.asof import asof_join, discarded, receiver_positions
from rayscape.operators.features import process_raw
from rayscape.sources import geo, gnsslogger, orbits, sp3

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micro(c: Column) -> Column:
    """Whole millionths."""
    return F.round(c * F.lit(1e6)).cast("long")


# -- time ----------------------------------------------------------------------------

_UTC = "(epoch_us(ts) * 1000 - (event_id % 5) * 94672800000000000)"
_LEAP = "(case when {u} >= 1483228800000000000 then 18 when {u} >= 1435708800000000000 then 17 end)"
_GPS = "(epoch_us(ts) * 1000 - 315964800000000000 + event_id)"


def events_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of four different years, before and in the leap table."""
    return table(spark, sf_dir, "events").select("event_id", (T.utc_ns(F.col("ts")) - (F.col("event_id") % 5) * F.lit(94672800000000000)).alias("utc"))


def events_gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", (T.utc_ns(F.col("ts")) - F.lit(K.GPS_EPOCH) + F.col("event_id")).alias("gps"))


@query(f"select event_id, {_LEAP.format(u=_UTC)} as leap from events")
def leap_seconds(spark, sf_dir):
    return events_utc(spark, sf_dir).select("event_id", T.leap_seconds(F.col("utc")).alias("leap"))


@query(f"select event_id, ({_UTC} + {_LEAP.format(u=_UTC)}::bigint * 1000000000 - 315964800000000000) // 1000000 as gps_ms from events")
def utc_to_gps(spark, sf_dir):
    return events_utc(spark, sf_dir).select("event_id", T.floor_div(T.utc_to_gps(F.col("utc")), 1_000_000).alias("gps_ms"))


@query(f"select event_id, {_GPS} + 315964800000000000 - 18000000000 as utc from events")
def gps_to_utc(spark, sf_dir):
    return events_gps(spark, sf_dir).select("event_id", T.gps_to_utc(F.col("gps")).alias("utc"))


@query(f"select event_id, strftime(make_timestamp(({_GPS} + 315964800000000000) // 1000), '%Y%j') as date, ({_GPS} + 315964800000000000) % 86400000000000 as ns from events")
def gps_to_doy(spark, sf_dir):
    date, ns = T.gps_to_doy(F.col("gps"))
    return events_gps(spark, sf_dir).select("event_id", date.alias("date"), ns.alias("ns"))


@query(f"select event_id, {_GPS} as gps from events")
def doy_to_gps(spark, sf_dir):
    date, ns = T.gps_to_doy(F.col("gps"))
    return events_gps(spark, sf_dir).select("event_id", date.alias("date"), ns.alias("ns")).select("event_id", T.doy_to_gps(F.col("date"), F.col("ns")).alias("gps"))


@query(f"select event_id, {_GPS} // 604800000000000 as week, {_GPS} // 86400000000000 % 7 as day, {_GPS} % 86400000000000 as ns from events")
def gps_to_gpsweek(spark, sf_dir):
    week, day, ns = T.gps_to_gpsweek(F.col("gps"))
    return events_gps(spark, sf_dir).select("event_id", week.alias("week"), day.alias("day"), ns.alias("ns"))


@query("select o_orderkey, ((o_orderkey % 3000) * 7 + o_custkey % 7) * 86400000000000 + o_orderkey as gps from orders")
def gpsweek_to_gps(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.gpsweek_to_gps(F.col("o_orderkey") % 3000, F.col("o_custkey") % 7, F.col("o_orderkey")).alias("gps"))


# -- logs ----------------------------------------------------------------------------


@query("""
with v as (select p_partkey, 'v' || (p_partkey % 4) || '.' || (p_size % 10) || '.' || (p_partkey % 3) || '.10' as version from part)
select p_partkey, version, (p_partkey % 4, p_size % 10, p_partkey % 3, 10) >= (1, 4, 0, 0) as fits
from (select v.*, p_size from v join part using (p_partkey))
""")
def version_gate(spark, sf_dir):
    version = F.concat(F.lit("v"), F.col("p_partkey") % 4, F.lit("."), F.col("p_size") % 10, F.lit("."), F.col("p_partkey") % 3, F.lit(".10"))
    return table(spark, sf_dir, "part").select("p_partkey", version.alias("version"), gnss.version_at_least(version, F.lit(K.MINIMUM_VERSION)).alias("fits"))


@query("""
select p_partkey, ['6', '7', 'M', 'N', 'O', 'P', '10'][1 + p_partkey % 7] as platform,
       ['6', '7', 'M', 'N', 'O', 'P', '10'][1 + p_partkey % 7] in ('7', 'N', 'O', 'P', '10') as fits from part
""")
def platform_gate(spark, sf_dir):
    platform = F.get(F.array(*map(F.lit, ("6", "7", "M", "N", "O", "P", "10"))), (F.col("p_partkey") % 7).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", platform.alias("platform"), gnss.platform_at_least(platform).alias("fits"))


@query("""
select event_id as line, epoch_us(ts) * 1000 as TimeNanos, case when event_id % 10 = 0 then null else -event_id * 1000003 end as FullBiasNanos,
       event_id % 32 + 1 as Svid, value as Cn0DbHz from events
""")
def log_scan(spark, sf_dir):
    """Lines of a log, with its heading, blanks and missing values, as typed rows."""
    events = table(spark, sf_dir, "events")
    bias = F.when(F.col("event_id") % 10 == 0, F.lit("")).otherwise((-F.col("event_id") * 1000003).cast("string"))
    body = F.concat_ws(",", F.lit("Raw"), F.col("event_id").cast("string"), F.concat(F.lit(" "), T.utc_ns(F.col("ts")).cast("string")), bias, (F.col("event_id") % 32 + 1).cast("string"), F.col("value").cast("string"))
    raw = events.select(F.lit("log").alias("log_id"), F.col("event_id").alias("line_no"), body.alias("value"))
    head = spark.createDataFrame([("log", -1, "# Raw,ElapsedRealtimeNanos,TimeNanos,FullBiasNanos,Svid,Cn0DbHz")], raw.schema)
    found = gnsslogger.records(raw.unionByName(head), "Raw", gnsslogger.RAW)
    return found.select(F.col("ElapsedRealtimeNanos").alias("line"), "TimeNanos", "FullBiasNanos", "Svid", "Cn0DbHz")


@query("""
select 'log' || p_partkey as log_id, (p_partkey % 4) || '.' || (p_size % 10) || '.0.' || (p_partkey % 3) as version, ['N', 'O', '7', 'Q'][1 + p_partkey % 4] as platform from part
""")
def log_header(spark, sf_dir):
    """Versions and platforms from the comments of many logs."""
    k = F.col("p_partkey")
    version = F.concat(k % 4, F.lit("."), F.col("p_size") % 10, F.lit(".0."), k % 3)
    platform = F.get(F.array(*map(F.lit, ("N", "o", "7", "Q"))), (k % 4).cast("int"))
    comment = F.concat(F.lit("# Version: v"), version, F.lit(" Platform: "), platform, F.lit(" Manufacturer: x Model: y"))
    text = table(spark, sf_dir, "part").select(F.concat(F.lit("log"), k).alias("log_id"), F.posexplode(F.array(F.lit("# "), F.lit("# Header Description:"), comment, F.lit("Raw,1,2"))).alias("line_no", "value"))
    return gnsslogger.header(text)


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    time = T.utc_ns(F.col("ts")) - F.lit(K.GPS_EPOCH)
    bias = -(i % 1000) * 1000003
    return table(spark, sf_dir, "events").select(
        i.alias("line_no"), F.get(F.array(*map(F.lit, (1, 3, 5, 6, 2))), (F.col("user_id") % 5).cast("int")).cast("long").alias("ConstellationType"),
        (i % 32 + 1).alias("Svid"), ((i * 37) % 4096).alias("State"), time.alias("TimeNanos"), bias.alias("FullBiasNanos"),
        F.pmod(time - bias - 70000000 - (i % 7) * 1000000, F.lit(K.WEEK)).alias("ReceivedSvTimeNanos"),
    )


_RAW_SQL = """
with a as (
  select event_id as line_no, [1, 3, 5, 6, 2][1 + user_id % 5] as con, event_id % 32 + 1 as num, (event_id * 37) % 4096 as state,
         epoch_us(ts) * 1000 - 315964800000000000 + (event_id % 1000) * 1000003 as rx, event_id from events),
b as (
  select *, (rx - 70000000 - (event_id % 7) * 1000000) % 604800000000000 as received,
         case con when 1 then 'G' when 3 then 'R' when 5 then 'C' when 6 then 'E' end as letter,
         case con when 3 then 86400000000000 when 6 then 100000000 when 1 then 604800000000000 when 5 then 604800000000000 end as period,
         case con when 1 then 9 when 3 then 137 when 5 then 9 when 6 then 2057 end as mask,
         case con when 3 then -10800000000000 when 5 then 14000000000 else 0 end as epoch from a),
c as (
  select *, case when state & mask = mask then
         received - (case when con = 6 then received - received % 100000000 else 0 end) + rx - rx % period + epoch + (case when con = 3 then 18000000000 else 0 end) end as sent from b),
d as (select *, case when rx > sent then sent else sent - period end as tx from c)
"""


@query(_RAW_SQL + """
select line_no, letter || lpad(num::varchar, 2, '0') as svid, rx, rx - tx as travel_ns, rx + 315964800000000000 - 18000000000 as time_ns,
       (rx + 315964800000000000 - 18000000000) // 1000000 as time_ms, round((rx - tx)::double * 1e-9 * 299792458e0 * 1e3)::bigint as pr_mm from d
""")
def raw_features(spark, sf_dir):
    found = process_raw(raw_lines(spark, sf_dir))
    return found.select("line_no", "svid", "rx", (F.col("rx") - F.col("tx")).alias("travel_ns"), "time_ns", "time_ms", F.round(F.col("pr") * F.lit(1e3)).cast("long").alias("pr_mm"))


@query(_RAW_SQL + "select min(rx - tx) as least, max(rx - tx) as greatest, count(*) filter (where rx - tx <= 0 or rx - tx >= 1000000000) as implausible from d")
def pseudorange_report(spark, sf_dir):
    from rayscape.operators.features import pseudorange_report as report

    return report(process_raw(raw_lines(spark, sf_dir)))


_PLACED = _RAW_SQL + """, r as (select *, (rx + 315964800000000000 - 18000000000) // 1000000 as ms from d where event_id % 3 <> 0),
f as (select event_id, (epoch_us(ts) * 1000 - 18000000000) // 1000000 as ms from events where event_id % 3 = 0),
p as (select r.event_id as line_no, f.event_id as fix, row_number() over (partition by r.event_id order by abs(r.ms - f.ms), f.ms, f.event_id desc) as k from r join f on abs(r.ms - f.ms) <= 600000)
"""


def receiver_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(measurements, those with the position fix nearest to them) of one log."""
    features = process_raw(raw_lines(spark, sf_dir).filter("line_no % 3 <> 0")).withColumn("log_id", F.lit("log"))
    i = F.col("event_id")
    fix = table(spark, sf_dir, "events").filter("event_id % 3 = 0").select(F.lit("log").alias("log_id"), i.alias("line_no"), (i % 7).cast("double").alias("Longitude"), (i % 11).cast("double").alias("Latitude"), i.cast("double").alias("Altitude"), T.floor_div(T.utc_ns(F.col("ts")) - F.lit(18 * K.SECOND), 1_000_000).alias("(UTC)TimeInMs"))
    return features, receiver_positions(features, fix, 600_000)


@query(_PLACED + "select line_no, (fix % 7)::double as x, (fix % 11)::double as y, fix::double as z from p where k = 1")
def receiver_points(spark, sf_dir):
    return receiver_log(spark, sf_dir)[1].select("line_no", "x", "y", "z")


@query(_PLACED + "select (select count(*) from r) as measurements, count(*) as placed, (select count(*) from r) - count(*) as discarded from p where k = 1")
def discarded_measurements(spark, sf_dir):
    return discarded(*receiver_log(spark, sf_dir))


def asof_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events").withColumn("ms", T.floor_div(F.unix_micros(F.col("ts").cast("timestamp")), 1000))
    left = events.filter("event_id % 3 <> 0").select("user_id", F.col("event_id").alias("left_id"), F.col("ms").alias("left_ms"))
    right = events.filter("event_id % 3 = 0").select("user_id", F.col("event_id").alias("right_id"), F.col("ms").alias("right_ms"), F.col("value").alias("right_value"))
    return left, right


_ASOF = """
with e as (select *, epoch_us(ts) // 1000 as ms from events),
p as (select l.user_id, l.event_id as left_id, l.ms as left_ms, r.event_id as right_id, r.ms as right_ms, r.value as right_value,
             row_number() over (partition by l.event_id order by abs(l.ms - r.ms), r.ms, r.event_id desc) as n
      from e l join e r on l.user_id = r.user_id and l.event_id % 3 <> 0 and r.event_id % 3 = 0 and {near})
select user_id, left_id, left_ms, right_id, right_ms, right_value from p where n = 1
"""


@query(_ASOF.format(near="abs(l.ms - r.ms) <= 3600000"))
def asof_nearest(spark, sf_dir):
    return asof_join(*asof_sides(spark, sf_dir), "left_ms", "right_ms", 3_600_000, by=["user_id"], order="right_id")


@query(_ASOF.format(near="l.ms - r.ms between 0 and 3600000"))
def asof_backward(spark, sf_dir):
    return asof_join(*asof_sides(spark, sf_dir), "left_ms", "right_ms", 3_600_000, by=["user_id"], order="right_id", direction="backward")


@query(_ASOF.format(near="r.ms - l.ms between 0 and 3600000"))
def asof_forward(spark, sf_dir):
    return asof_join(*asof_sides(spark, sf_dir), "left_ms", "right_ms", 3_600_000, by=["user_id"], order="right_id", direction="forward")


# -- satellites ----------------------------------------------------------------------

_SLOTS = ", ".join(f"('R{c}', 'R{s:02d}')" for c, pair in K.CHANNEL_SLOTS.items() for s in pair)


@query(f"""
with s as (select event_id, 'R' || (90 + event_id % 20) as sv from events), t(ch, slot) as (values {_SLOTS})
select event_id, coalesce(slot, sv) as svid from s left join t on sv = ch
""")
def fcn_expand(spark, sf_dir):
    from rayscape.operators.observe import expand_channels

    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("R"), (F.lit(90) + F.col("event_id") % 20).cast("string")).alias("svid"))
    return expand_channels(rows)


def svids(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = F.get(F.array(*map(F.lit, ("G", "R", "C", "E", "J"))), (F.col("user_id") % 5).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", gnss.svid(letter, F.col("event_id") % 110).alias("svid"))


_SVIDS = "select event_id, ['G', 'R', 'C', 'E', 'J'][1 + user_id % 5] as letter, event_id % 110 as num, ['G', 'R', 'C', 'E', 'J'][1 + user_id % 5] || lpad((event_id % 110)::varchar, greatest(2, length((event_id % 110)::varchar))::int, '0') as svid from events"


@query(f"select event_id, svid from ({_SVIDS}) where num between 1 and case letter when 'G' then 32 when 'R' then 24 when 'C' then 37 when 'E' then 36 else 0 end")
def supported_svid_filter(spark, sf_dir):
    return svids(spark, sf_dir).filter(gnss.is_supported(F.col("svid")))


@query(f"select letter as constellation, count(*) as n from ({_SVIDS}) group by letter")
def constellation_counts(spark, sf_dir):
    from rayscape.operators.observe import constellation_sizes

    return constellation_sizes(svids(spark, sf_dir))


@query(f"select distinct letter as constellation from ({_SVIDS}) where letter not in ('G', 'R', 'C', 'E')")
def unsupported_constellations(spark, sf_dir):
    from rayscape.operators.observe import unsupported

    return unsupported(svids(spark, sf_dir))


def orbit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cubic path for each supplier: 25 epochs of five minutes on the first day of 2024."""
    i, k = F.col("s_suppkey"), F.col("epoch")
    cubic = lambda a, b, c, d: (a + b * k + c * k * k + d * k * k * k).cast("double")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))))
    return rows.select("epoch", F.lit("2024001").alias("date"), (k * F.lit(300 * K.SECOND)).alias("time"), i.cast("string").alias("svid"), cubic(20000000 + i, 1000 + i, F.lit(7), F.lit(3)).alias("x"), cubic(-15000000 + i, 3 * i, F.lit(-11), F.lit(2)).alias("y"), cubic(F.lit(9000000), -i, F.lit(5), F.lit(-1)).alias("z"), F.lit(0.0).alias("clockerror"))


@query("""
with k as (select unnest(generate_series(0, 24)) as epoch)
select epoch::bigint as epoch, '2024001' as date, epoch::bigint * 300000000000 as time, 'G' || lpad((s_suppkey % 100)::varchar, 2, '0') as svid,
       round(1000 * (20000 + s_suppkey + epoch / 8e0))::bigint as x, round(1000 * (s_suppkey - epoch * 3e0))::bigint as y, round(1000 * 9000.5e0)::bigint as z
from supplier, k
""")
def sp3_parse(spark, sf_dir):
    """Text of an orbit file as rows; its seconds have a fraction, which is dropped, and its last lines are of no epoch's."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("epoch"))
    number = lambda c: F.lpad(F.call_function("format_number", c, F.lit("0.000000")), 14, " ")
    name = F.concat(F.lit("PG"), F.lpad((F.col("s_suppkey") % 100).cast("string"), 2, " "))
    body = F.concat(name, number(F.col("s_suppkey") + 20000 + F.col("epoch") / 8.0), number(F.col("s_suppkey") - F.col("epoch") * 3.0), number(F.lit(9000.5)), number(F.lit(999999.999999)))
    minutes = F.col("epoch") * 5
    head = F.concat(F.lit("*  2024  1  1 "), F.lpad(F.floor(minutes / 60).cast("string"), 2, " "), F.lit(" "), F.lpad((minutes % 60).cast("string"), 2, " "), F.lit("  0.99999999"))
    text = rows.select((F.col("epoch").cast("long") * 10**9 + F.col("s_suppkey")).alias("n"), body.alias("value"))
    text = text.unionByName(rows.select("epoch").distinct().select((F.col("epoch").cast("long") * 10**9).alias("n"), head.alias("value"))).unionByName(spark.createDataFrame([(-1, "#cP2024  1  1"), (10**12, "EOF")], "n long, value string"))
    whole = lambda c: F.round(c).cast("long").alias(c)
    return sp3.parse_lines(text.withColumn("file", F.lit("f"))).select("epoch", "date", "time", "svid", whole("x"), whole("y"), whole("z"))


_DAY = "1388102400000000000"  # GPS nanoseconds of 2024-01-01 on its own scale


@query(f"""
select '2024001' as date, s_suppkey::varchar as svid, {_DAY} + i * 300000000000 as mid, {_DAY} + (i - 3) * 300000000000 as lb, {_DAY} + (i + 4) * 300000000000 as ub
from supplier, (select unnest([3, 7, 11, 15, 19, 20]) as i)
""")
def orbit_windows(spark, sf_dir):
    return orbit.windows(orbit_table(spark, sf_dir)).select("date", "svid", "mid", "lb", "ub")


@query(f"""
with w as (select s_suppkey as i, k * 60 as sec from supplier, (select unnest(generate_series(-2, 122)) as k)),
u as (select i, sec, (sec / 300e0) as u from w)
select i::varchar as svid, {_DAY} + sec * 1000000000 as gps_ns,
       case when sec between 0 and 7200 then round(20000000 + i + (1000 + i) * u + 7 * u * u + 3 * u * u * u)::bigint end as sv_x,
       case when sec between 0 and 7200 then round(-15000000 + i + 3 * i * u - 11 * u * u + 2 * u * u * u)::bigint end as sv_y,
       case when sec between 0 and 7200 then round(9000000 - i * u + 5 * u * u - u * u * u)::bigint end as sv_z
from u where sec >= 0
""")
def orbit_locate(spark, sf_dir):
    times = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("svid"), F.explode(F.sequence(F.lit(0), F.lit(122))).alias("k"))
    wanted = times.select("svid", F.lit("2024001").alias("date"), (F.lit(int(_DAY)) + F.col("k").cast("long") * F.lit(60 * K.SECOND)).alias("gps_ns"))
    found = orbit.locate(wanted, orbit.windows(orbit_table(spark, sf_dir)))
    return found.select("svid", "gps_ns", *[F.round(f"sv_{c}").cast("long").alias(f"sv_{c}") for c in "xyz"])


@query(f"""
with t as (select distinct {_DAY} + (event_id % 48) * 3600000000000 as gps_ns from events)
select gps_ns, strftime(make_timestamp((gps_ns + 315964800000000000) // 1000), '%Y%j') as date, s_suppkey::varchar as svid
from t join supplier on strftime(make_timestamp((gps_ns + 315964800000000000) // 1000), '%Y%j') = '2024001'
""")
def sv_candidates(spark, sf_dir):
    times = table(spark, sf_dir, "events").select((F.lit(int(_DAY)) + (F.col("event_id") % 48) * F.lit(3600 * K.SECOND)).alias("gps_ns"))
    return orbit.candidates(times, orbit.windows(orbit_table(spark, sf_dir)))


@query("""
with p as (select s_suppkey, (2024001 + s_suppkey % 5)::varchar as date, ['final', 'rapid', 'ultra'][1 + s_suppkey % 3] as product from supplier),
b as (select date, min(case product when 'final' then 1 when 'rapid' then 2 else 3 end) as best from p group by date)
select s_suppkey, date, product from p join b using (date) where best = case product when 'final' then 1 when 'rapid' then 2 else 3 end
""")
def product_fallback(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.lit(2024001) + k % 5).cast("string").alias("date"), F.get(F.array(*map(F.lit, sp3.PRIORITY)), (k % 3).cast("int")).alias("product"))
    return sp3.best_product(rows).select("s_suppkey", "date", "product")


@query("select distinct strftime(ts, '%Y%j') as date from events where strftime(ts, '%Y%j') not in (select strftime(ts, '%Y%j') from events where event_id % 1000 = 0)")
def missing_days(spark, sf_dir):
    day = F.concat(F.year("ts").cast("string"), F.lpad(F.dayofyear("ts").cast("string"), 3, "0"))
    days = table(spark, sf_dir, "events").select("event_id", day.alias("date"))
    return orbits.missing_dates(days, days.filter("event_id % 1000 = 0").select("date").distinct())


# -- geodesy -------------------------------------------------------------------------

_LON, _LAT = "((c_custkey * 37) % 36000) / 100e0 - 180", "((c_custkey * 53) % 17000) / 100e0 - 85"
_N = "(6378137e0 / sqrt(1 - 0.0066943799901413165e0 * sin(radians(lat)) ** 2))"
_SITE = f"with g as (select c_custkey, {_LON} as lon, {_LAT} as lat, c_acctbal as h from customer), e as (select *, ({_N} + h) * cos(radians(lat)) * cos(radians(lon)) as x, ({_N} + h) * cos(radians(lat)) * sin(radians(lon)) as y, ({_N} * (1 - 0.0066943799901413165e0) + h) * sin(radians(lat)) as z from g)"


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", (((k * 37) % 36000) / F.lit(100.0) - 180).alias("lon"), (((k * 53) % 17000) / F.lit(100.0) - 85).alias("lat"), F.col("c_acctbal").alias("h"))


def geocentric(df: DataFrame) -> DataFrame:
    x, y, z = geodesy.to_crs(F.col("lon"), F.col("lat"), F.col("h"), K.LLA, K.ECEF)
    return df.withColumns({"x": x, "y": y, "z": z})


@query(_SITE + " select c_custkey, round(x * 1e3)::bigint as x_mm, round(y * 1e3)::bigint as y_mm, round(z * 1e3)::bigint as z_mm from e")
def ecef_from_lla(spark, sf_dir):
    return geocentric(sites(spark, sf_dir)).select("c_custkey", *[F.round(F.col(c) * F.lit(1e3)).cast("long").alias(f"{c}_mm") for c in "xyz"])


@query(f"select c_custkey, round(({_LON}) * 1e6)::bigint as lon, round(({_LAT}) * 1e6)::bigint as lat, round(c_acctbal * 1e3)::bigint as h_mm from customer")
def lla_from_ecef(spark, sf_dir):
    lon, lat, h = geodesy.to_crs(F.col("x"), F.col("y"), F.col("z"), K.ECEF, K.LLA)
    return geocentric(sites(spark, sf_dir)).select("c_custkey", micro(lon).alias("lon"), micro(lat).alias("lat"), F.round(h * F.lit(1e3)).cast("long").alias("h_mm"))


@query("""
select c_custkey, ((c_custkey * 37) % 600) * 10000 as lon, 50000000 + ((c_custkey * 53) % 800) * 10000 as lat from customer
""")
def crs_roundtrip(spark, sf_dir):
    """To a UTM zone and to web Mercator, and back."""
    k = F.col("c_custkey")
    lon, lat = ((k * 37) % 600) / F.lit(100.0), ((k * 53) % 800) / F.lit(100.0) + 50
    rows = table(spark, sf_dir, "customer").select("c_custkey", lon.alias("x"), lat.alias("y"), F.lit(0.0).alias("z"))
    for source, target in ((K.LLA, "EPSG:32631"), ("EPSG:32631", K.LLA), (K.LLA, "EPSG:3857"), ("EPSG:3857", K.LLA)):
        rows = rows.withColumn("p", geodesy.packed(geodesy.to_crs(F.col("x"), F.col("y"), F.col("z"), source, target))).select("c_custkey", "p.*")
    return rows.select("c_custkey", micro(F.col("x")).alias("lon"), micro(F.col("y")).alias("lat"))


_SAT = "20000000e0 * cos(radians(c_custkey % 360)) as sx, 20000000e0 * sin(radians(c_custkey % 360)) as sy, ((c_custkey % 41) - 20) * 500000e0 as sz"
_ELEVATION = _SITE + f""", s as (select *, {_SAT} from e),
d as (select *, ((sx - x) * cos(radians(lat)) * cos(radians(lon)) + (sy - y) * cos(radians(lat)) * sin(radians(lon)) + (sz - z) * sin(radians(lat)))
      / sqrt((sx - x) ** 2 + (sy - y) ** 2 + (sz - z) ** 2) as sine from s),
f as (select *, degrees(asin(greatest(-1e0, least(1e0, sine)))) as elevation from d)"""


def lines_of_sight(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    angle = F.radians(k % 360)
    s = planar.point(F.lit(2e7) * F.cos(angle), F.lit(2e7) * F.sin(angle), (k % 41 - 20) * F.lit(500000.0))
    return geocentric(sites(spark, sf_dir)).select("c_custkey", planar.point(F.col("x"), F.col("y"), F.col("z")).alias("r"), s.alias("s"))


def _ends(*names: str) -> list[tuple[Column, Column, Column]]:
    return [tuple(F.col(f"{n}.{c}") for c in "xyz") for n in names]


@query(_ELEVATION + " select c_custkey, round(elevation * 1e6)::bigint as elevation from f")
def elevation(spark, sf_dir):
    return lines_of_sight(spark, sf_dir).select("c_custkey", micro(geodesy.elevation(*_ends("r", "s"))).alias("elevation"))


@query(_ELEVATION + " select c_custkey from f where elevation between 0 and 85")
def elevation_filter(spark, sf_dir):
    from rayscape.operators.observe import filter_elevation

    return filter_elevation(lines_of_sight(spark, sf_dir)).select("c_custkey")


@query(_ELEVATION + """ select c_custkey, round((x + least(1e0, 1000e0 / sqrt((sx - x) ** 2 + (sy - y) ** 2)) * (sx - x)) * 1e3)::bigint as x_mm,
 round((y + least(1e0, 1000e0 / sqrt((sx - x) ** 2 + (sy - y) ** 2)) * (sy - y)) * 1e3)::bigint as y_mm,
 round((z + least(1e0, 1000e0 / sqrt((sx - x) ** 2 + (sy - y) ** 2)) * (sz - z)) * 1e3)::bigint as z_mm from f""")
def ray_build(spark, sf_dir):
    end = geodesy.cut_ray(*_ends("r", "s"), K.RAY_LENGTH)
    return lines_of_sight(spark, sf_dir).select("c_custkey", *[F.round(v * F.lit(1e3)).cast("long").alias(f"{c}_mm") for c, v in zip("xyz", end)])


_SKY = _SITE + f""", v as (select i, ['G', 'R', 'C', 'E'][1 + i % 4] || lpad((1 + i // 4)::varchar, 2, '0') as svid from (select unnest(generate_series(0, 79)) as i)),
w as (select c_custkey, svid, radians(c_custkey % 90 + 0e0) as lon_, x, y, z, lon, lat, i,
             2.6e7 * cos(radians(i * 9e0)) * cos(radians((i % 7) * 12e0 - 36)) as sx, 2.6e7 * sin(radians(i * 9e0)) * cos(radians((i % 7) * 12e0 - 36)) as sy, 2.6e7 * sin(radians((i % 7) * 12e0 - 36)) as sz from e, v),
d as (select *, ((sx - x) * cos(radians(lat)) * cos(radians(lon)) + (sy - y) * cos(radians(lat)) * sin(radians(lon)) + (sz - z) * sin(radians(lat)))
      / sqrt((sx - x) ** 2 + (sy - y) ** 2 + (sz - z) ** 2) as sine from w),
u as (select *, degrees(asin(greatest(-1e0, least(1e0, sine)))) as elevation from d where substring(svid, 1, 1) in ('G', 'R', 'E')),
o as (select o_orderkey, o_custkey as c_custkey, o_orderkey % 160 as k from orders),
j as (select o_orderkey, c_custkey, ['G', 'R', 'C', 'E'][1 + k % 4] || lpad((1 + k // 8)::varchar, 2, '0') as svid from o)
select u.svid, round(x * 1e3)::bigint as rx_mm, round(z * 1e3)::bigint as rz_mm, o_orderkey, round(elevation * 1e5)::bigint as elevation
from u semi join o using (c_custkey) left join j using (c_custkey, svid) where elevation between 0 and 85
"""


@query(_SKY)
def observe_all(spark, sf_dir):
    """All satellites of three constellations above each customer's place at one time, with the orders that measured them: several of one satellite fan out."""
    from rayscape.operators.observe import observe

    i = F.col("id")
    letter = F.get(F.array(*map(F.lit, "GRCE")), (i % 4).cast("int"))
    up = F.radians((i % 7) * F.lit(12.0) - 36)
    still = spark.range(80).select(gnss.svid(letter, (F.floor(i / 4) + 1).cast("long")).alias("svid"), *[(F.lit(2.6e7) * c).alias(n) for n, c in (("x", F.cos(F.radians(i * F.lit(9.0))) * F.cos(up)), ("y", F.sin(F.radians(i * F.lit(9.0))) * F.cos(up)), ("z", F.sin(up)))])
    day = still.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long")))).select("epoch", F.lit("2024001").alias("date"), (F.col("epoch") * F.lit(300 * K.SECOND)).alias("time"), "svid", "x", "y", "z", F.lit(0.0).alias("clockerror"))
    k = F.col("o_orderkey") % 160
    seen = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", gnss.svid(F.get(F.array(*map(F.lit, "GRCE")), (k % 4).cast("int")), (F.floor(k / 8) + 1).cast("long")).alias("svid"))
    utc = F.lit(int(_DAY) + K.GPS_EPOCH - 18 * K.SECOND) + (F.col("c_custkey") % 90) * F.lit(60 * K.SECOND)
    points = seen.join(sites(spark, sf_dir), "c_custkey").select(utc.alias("time_ns"), F.col("lon").alias("x"), F.col("lat").alias("y"), F.col("h").alias("z"), "svid", "o_orderkey")
    found = observe(points, orbit.windows(day), {"G", "R", "E"}, elevation="elevation")
    if (n := found.agg(F.count("*") - F.count_distinct("obs_id")).first()[0]) != 0:
        raise AssertionError(f"{n} observations share an id")
    return found.select("svid", *[F.round(F.col(f"r.{c}") * F.lit(1e3)).cast("long").alias(f"r{c}_mm") for c in "xz"], "o_orderkey", F.round(F.col("elevation") * F.lit(1e5)).cast("long").alias("elevation"))


# -- rays and buildings --------------------------------------------------------------

_MAP = "m as (select p_partkey as building_id, (p_partkey % 50) * 40e0 as x0, (p_partkey // 50) * 40e0 as y0, (p_partkey % 50) * 40e0 + 10 + p_size % 20 as x1, (p_partkey // 50) * 40e0 + 10 + p_size % 20 as y1, p_size::double as height from part)"
_RAYS = "q as (select o_orderkey as ray_id, (o_custkey % 50) * 40e0 - 7.25e0 as rx, (o_custkey // 50) * 40e0 + (o_orderkey % 37) + 0.5e0 as ry, (o_orderkey % 3)::double as rz, (o_custkey % 61) + 0.125e0 as dx, (o_orderkey % 41) - 20.0625e0 as dy, 1 + (o_orderkey % 50)::double as dz from orders)"
_CROSS = f"""
with {_MAP}, {_RAYS},
p as (select * from q join m on least(rx, rx + dx) <= x1 and greatest(rx, rx + dx) >= x0 and least(ry, ry + dy) <= y1 and greatest(ry, ry + dy) >= y0),
c as (select ray_id, building_id, height, rx, ry, rz, dx, dy, dz,
  unnest([case when (x1 - rx) / dx between 0 and 1 and ry + (x1 - rx) / dx * dy between y0 and y1 then (x1 - rx) / dx end,
          case when (x0 - rx) / dx between 0 and 1 and ry + (x0 - rx) / dx * dy between y0 and y1 then (x0 - rx) / dx end,
          case when (y1 - ry) / dy between 0 and 1 and rx + (y1 - ry) / dy * dx between x0 and x1 then (y1 - ry) / dy end,
          case when (y0 - ry) / dy between 0 and 1 and rx + (y0 - ry) / dy * dx between x0 and x1 then (y0 - ry) / dy end]) as t from p),
h as (select ray_id, building_id, any_value(height) as height, min(rz + t * dz) as z, min(t) as t from c where t is not null group by ray_id, building_id)
"""


def city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square building for each part, on a street grid."""
    k, size = F.col("p_partkey"), F.col("p_size")
    x, y = (k % 50) * F.lit(40.0), T.floor_div(k, 50) * F.lit(40.0)
    return table(spark, sf_dir, "part").select(k.alias("building_id"), planar.box(x, y, x + 10 + size % 20, y + 10 + size % 20).alias("ring"), size.cast("double").alias("height"))


def rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    place, order = F.col("o_custkey"), F.col("o_orderkey")
    x, y, z = (place % 50) * F.lit(40.0) - 7.25, T.floor_div(place, 50) * F.lit(40.0) + order % 37 + 0.5, (order % 3).cast("double")
    end = planar.point(x + place % 61 + 0.125, y + order % 41 - 20.0625, z + 1 + order % 50)
    return table(spark, sf_dir, "orders").select(order.alias("ray_id"), planar.point(x, y, z).alias("r"), end.alias("s"))


@query(_CROSS + "select ray_id, building_id, round(z * 1e6)::bigint as z from h")
def proj_height(spark, sf_dir):
    return spatial.projected_height(rays(spark, sf_dir), city(spark, sf_dir)).select("ray_id", "building_id", micro(F.col("z")).alias("z"))


@query(_CROSS + "select ray_id, building_id from h where z <= height")
def ray_hits(spark, sf_dir):
    return spatial.ray_hits(rays(spark, sf_dir), city(spark, sf_dir))


@query(_CROSS + ", n as (select count(*) as n from m), s as (select ray_id, count(*) as k from h where z <= height group by ray_id) select ray_id, coalesce(k, 0) = n as is_los from q left join s using (ray_id), n")
def los_all(spark, sf_dir):
    return spatial.hits_all(rays(spark, sf_dir), city(spark, sf_dir))


_ROW = "o as (select r_regionkey as building_id, 100e0 + 20 * r_regionkey as x0, 1 + r_regionkey % 3 as height from region)"


@query(f"with {_ROW}, q as (select o_orderkey as ray_id, (o_orderkey % 90)::double as rx, (o_orderkey % 7) * .5e0 as z from orders), "
       "s as (select ray_id, count(*) filter (where z <= height) as k from q, o group by ray_id) select ray_id, k = (select count(*) from o) as is_los from s")
def los_row(spark, sf_dir):
    """Level rays along a row of buildings, of which the low ones hit all."""
    k, order = F.col("r_regionkey"), F.col("o_orderkey")
    x = F.lit(100.0) + k * 20
    row = table(spark, sf_dir, "region").select(k.alias("building_id"), planar.box(x, F.lit(0.0), x + 10, F.lit(10.0)).alias("ring"), (k % 3 + 1).cast("double").alias("height"))
    z = (order % 7) * F.lit(0.5)
    level = table(spark, sf_dir, "orders").select(order.alias("ray_id"), planar.point(order % 90, F.lit(5.0), z).alias("r"), planar.point(F.lit(300.0), F.lit(5.0), z).alias("s"))
    return spatial.hits_all(level, row)


@query(_CROSS + "select ray_id from q where ray_id not in (select ray_id from h where z <= height)")
def los_clear(spark, sf_dir):
    return spatial.clear_los(rays(spark, sf_dir), city(spark, sf_dir)).select("ray_id")


@query(f"with {_MAP}, {_RAYS} select ray_id as point_id from q where not exists (select 1 from m where rx + dx between x0 and x1 and ry + dy between y0 and y1)")
def is_outside(spark, sf_dir):
    points = rays(spark, sf_dir).select(F.col("ray_id").alias("point_id"), "s.x", "s.y")
    return spatial.outside(points, city(spark, sf_dir)).select("point_id")


@query(_CROSS + "select ray_id, " + ", ".join(f"round(max(case when building_id = {b} then z end) * 1e6)::bigint as b{b}" for b in (1, 2, 3)) + " from h where building_id <= 3 group by ray_id")
def height_matrix(spark, sf_dir):
    wide = spatial.height_matrix(spatial.projected_height(rays(spark, sf_dir), city(spark, sf_dir)), [1, 2, 3]).dropna(how="all", subset=["1", "2", "3"])
    return wide.select("ray_id", *[micro(F.col(f"`{b}`")).alias(f"b{b}") for b in (1, 2, 3)])


@query(_CROSS + ", d as (select ray_id, building_id, z, 0 as copy from h union all select ray_id, building_id, z, 1 from h where ray_id % 3 = 0) "
       "select ray_id * 2 + copy as obs_id, building_id, round(z * 1e6)::bigint as z, (ray_id % 50 + copy)::double as ss from d")
def height_pairs(spark, sf_dir):
    """Rays that cross buildings with their strengths; a third of them were measured twice."""
    twice = rays(spark, sf_dir).withColumn("copy", F.explode(F.when(F.col("ray_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    seen = twice.select((F.col("ray_id") * 2 + F.col("copy")).alias("obs_id"), "r", "s", (F.col("ray_id") % 50 + F.col("copy")).cast("double").alias("Cn0DbHz"))
    return heights.prepare(seen, city(spark, sf_dir)).select("obs_id", "building_id", micro(F.col("height")).alias("z"), "ss")


_SHAPE = "[(100e0, 100e0), (700e0, 100e0), (700e0, 900e0), (401e0, 300e0), (100e0, 900e0), (100e0, 100e0)]"


@query(f"""
with {_RAYS}, c as (select unnest({_SHAPE}) as p, unnest(generate_series(0, 5)) as i), e as (select a.p[1] as ex, a.p[2] as ey, b.p[1] as fx, b.p[2] as fy from c a join c b on b.i = a.i + 1)
select ray_id as point_id, count(*) filter (where (ey > ry) <> (fy > ry) and rx < (fx - ex) * (ry - ey) / (fy - ey) + ex) % 2 = 1 as inside from q, e group by ray_id
""")
def inside_polygon(spark, sf_dir):
    """Whether points are strictly inside a polygon that isn't convex."""
    corners = [(100.0, 100.0), (700.0, 100.0), (700.0, 900.0), (401.0, 300.0), (100.0, 900.0), (100.0, 100.0)]
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in corners])
    return rays(spark, sf_dir).select(F.col("ray_id").alias("point_id"), planar.contains(ring, F.col("r.x"), F.col("r.y")).alias("inside"))


_MERCATOR = "round(6378137e0 * radians({x}) * 1e3)::bigint"
_MERCATOR_Y = "round(6378137e0 * ln(tan(pi() / 4 + radians({y}) / 2)) * 1e3)::bigint"


@query(f"with {_MAP} select building_id, {_MERCATOR.format(x='x1 / 1e3')} as x_mm, {_MERCATOR_Y.format(y='50 + y1 / 1e3')} as y_mm, round(height * 1e3)::bigint as h_mm from m")
def map_reproject(spark, sf_dir):
    """First corners and heights of a map in degrees, in web Mercator."""
    degrees = city(spark, sf_dir).withColumn("ring", F.transform("ring", lambda c: F.struct((c["x"] / 1e3).alias("x"), (F.lit(50.0) + c["y"] / 1e3).alias("y"))))
    moved, mm = spatial.reproject_map(degrees, K.LLA, "EPSG:3857"), lambda c: F.round(c * F.lit(1e3)).cast("long")
    first = F.element_at("ring", 1)
    return moved.select("building_id", mm(first["x"]).alias("x_mm"), mm(first["y"]).alias("y_mm"), mm(F.col("height")).alias("h_mm"))


@query("select 'missing_height' as failure where exists (select 1 from part where p_partkey % 500 = 0) union all select 'not_polygons' where exists (select 1 from part where p_partkey % 700 = 0) union all select 'open_rings' where exists (select 1 from part where p_partkey % 700 = 0)")
def check_map(spark, sf_dir):
    """What is wrong with a map of which some buildings have no height and others no last corners."""
    k = F.col("building_id")
    wrong = city(spark, sf_dir).withColumns({"height": F.when(k % 500 != 0, F.col("height")), "ring": F.when(k % 700 == 0, F.slice("ring", 1, 3)).otherwise(F.col("ring"))})
    return spark.createDataFrame([(x,) for x in schemas.failures(wrong, "map")], "failure string")


_J = "-(case when {v} < -1 then 0e0 when {v} < 0 then 20 * ln(0.5e0 - 0.62e0 * {v}) when {v} < 1 then 20 * ln(0.5e0 * exp(-0.95e0 * {v})) when {v} < 2.4e0 then 20 * ln(0.4e0 - sqrt(0.1184e0 - (0.38e0 - 0.1e0 * {v}) ** 2)) else 20 * ln(0.225e0 / {v}) end)"


@query(f"with v as (select l_orderkey, l_linenumber, l_quantity / 10e0 - 2 as v from lineitem) select l_orderkey, l_linenumber, round({_J.format(v='v')} * 1e6)::bigint as loss from v")
def fresnel_integral(spark, sf_dir):
    v = F.col("l_quantity") / F.lit(10.0) - 2
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", micro(diffraction.fresnel_loss(v)).alias("loss"))


@query(f"with {_RAYS} select ray_id, round((5 - (rz + 0.25e0 * dz)) * sqrt(2e0 / (0.1903e0 * 0.25e0 * sqrt(dx * dx + dy * dy))) * 1e6)::bigint as v from q")
def fresnel_param(spark, sf_dir):
    r, s = F.col("r"), F.col("s")
    edge = planar.point(r["x"] + (s["x"] - r["x"]) * 0.25, r["y"] + (s["y"] - r["y"]) * 0.25, F.lit(5.0))
    return rays(spark, sf_dir).select("ray_id", micro(diffraction.fresnel_parameter(r, s, edge)).alias("v"))


@query(_CROSS + """, f as (select ray_id, min(building_id) as building_id from h where z <= height group by ray_id),
e as (select q.*, h.height, h.t from q left join f using (ray_id) left join h using (ray_id, building_id)),
v as (select ray_id, t, (height - (rz + t * dz)) * sqrt(2e0 / (0.1903e0 * nullif(t, 0) * sqrt(dx * dx + dy * dy))) as v from e)
select ray_id, round((case when t is null or v is null then 0e0 else """ + _J.format(v="v") + """ end) * 1e4)::bigint as loss from v""")
def fresnel_loss(spark, sf_dir):
    found = spatial.fresnel(rays(spark, sf_dir), city(spark, sf_dir), multi_edge="first")
    return found.select("ray_id", F.round(F.col("fresnel") * F.lit(1e4)).cast("long").alias("loss"))


@query(_CROSS + """, n as (
  select ray_id, 1 as part, z, building_id, rx + t * dx as x, ry + t * dy as y, height as top from h join q using (ray_id) where z <= height
  union all select ray_id, 0, null, 0, rx, ry, rz from q union all select ray_id, 2, null, 0, rx + dx, ry + dy, rz + dz from q),
w as (select *, lag(x) over o as px, lag(y) over o as py, lag(top) over o as pz, lead(x) over o - lag(x) over o as wx, lead(y) over o - lag(y) over o as wy, lead(top) over o - lag(top) over o as wz
      from n window o as (partition by ray_id order by part, z, building_id)),
a as (select *, sqrt(wx * wx + wy * wy) as far from w where part = 1),
d as (select *, nullif(greatest(0e0, least(far, ((x - px) * wx + (y - py) * wy) / nullif(far, 0))), 0) as d from a),
v as (select *, (top - (pz + d / far * wz)) * sqrt(2e0 / (0.1903e0 * d)) as v from d),
l as (select ray_id, sum(coalesce(case when v is not null then """ + _J.format(v="v") + """ end, 0e0)) as loss from v group by ray_id)
select ray_id, round(coalesce(loss, 0e0) * 1e4)::bigint as loss from q left join l using (ray_id)""")
def fresnel_chain(spark, sf_dir):
    """Losses over all roofs that a ray passes below, each between its neighbours."""
    found = spatial.fresnel(rays(spark, sf_dir), city(spark, sf_dir))
    return found.select("ray_id", F.round(F.col("fresnel") * F.lit(1e4)).cast("long").alias("loss"))


@query(f"with {_MAP} select building_id, round((x0 + x1) / 2 * 1e6)::bigint as cx, round((y0 + y1) / 2 * 1e6)::bigint as cy, round((x1 - x0) * (y1 - y0) * 1e6)::bigint as area from m")
def ring_centroid(spark, sf_dir):
    cx, cy = planar.centroid(F.col("ring"))
    return city(spark, sf_dir).select("building_id", micro(cx).alias("cx"), micro(cy).alias("cy"), micro(F.abs(planar.area2(F.col("ring"))) / 2).alias("area"))


@query(f"with {_MAP} select building_id, 5 as corners, x1 as first_x, y1 as first_y from m")
def geojson_rings(spark, sf_dir):
    """Rings as GeoJSON text, and back."""
    text = city(spark, sf_dir).select("building_id", F.to_json(geo.ring_geometry(F.col("ring"))).alias("g"))
    ring = F.element_at(F.from_json("g", "struct<type:string,coordinates:array<array<array<double>>>>")["coordinates"], 1)
    first = F.element_at(ring, 1)
    return text.select("building_id", F.size(ring).alias("corners"), F.element_at(first, 1).alias("first_x"), F.element_at(first, 2).alias("first_y"))


@query(f"with {_MAP} select building_id, height from m where x1 >= 100 and x0 <= 700 and y1 >= 100 and y0 <= 500 order by building_id limit 20 offset 5")
def layer_slice(spark, sf_dir):
    """A box of a layer, and a run of its rows: what limits are for."""
    df = city(spark, sf_dir).withColumns(planar.bounds(F.col("ring")))
    return geo.layer(df, bbox=(100.0, 100.0, 700.0, 500.0), rows=slice(5, 25)).select("building_id", "height")


# -- the logistic curve --------------------------------------------------------------

_P = ".9e0, .002e0, 30000e0, .1e0"
_F = "1 / (1 + exp(-(.002e0 * (l_extendedprice - 30000e0))))"


def _params() -> tuple[Column, ...]:
    return tuple(F.lit(v) for v in (0.9, 0.002, 30000.0, 0.1))


def _curve(f) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", f(F.col("l_extendedprice")).alias("y"))


_LINES = "select l_orderkey, l_linenumber, {y} as y from lineitem"
for _name, _f, _sql in (
    ("fourpl_prob", lambda z: micro(fourpl.prob(z, *_params())), f"round((.1e0 + .8e0 * {_F}) * 1e6)::bigint"),
    ("fourpl_predict", lambda z: fourpl.predict(z, *_params()), "case when l_extendedprice > 30000 then 1 else 0 end"),
    ("fourpl_deriv", lambda z: micro(fourpl.deriv(z, *_params()) * 1e6), f"round(.8e0 * .002e0 * ({_F}) * (1 - {_F}) * 1e12)::bigint"),
    ("fourpl_dderiv", lambda z: micro(fourpl.dderiv(z, *_params()) * 1e6), f"round(.8e0 * .002e0 * .002e0 * ({_F}) * (1 - {_F}) * (1 - 2 * {_F}) * 1e12)::bigint"),
    ("fourpl_inv", lambda z: micro(fourpl.inverse(F.pmod(z, F.lit(1.0)) * 0.7 + 0.15, *_params())), "round((30000e0 + ln(((l_extendedprice % 1e0) * .7e0 + .15e0 - .1e0) / (.9e0 - .1e0) / (1 - ((l_extendedprice % 1e0) * .7e0 + .15e0 - .1e0) / (.9e0 - .1e0))) / .002e0) * 1e6)::bigint"),
):
    QUERIES[_name], SQL[_name] = _curve(_f), _LINES.format(y=_sql)


@query("select p_partkey, p_retailprice as lower_bound, (p_retailprice + (p_retailprice + 3e0 / p_size)) / 2e0 as mid_point, p_retailprice + 3e0 / p_size as upper_bound from part")
def height_bounds(spark, sf_dir):
    bounds = fourpl.height_bounds(F.col("p_size").cast("double"), F.col("p_retailprice"))
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(k) for k, c in bounds.items()])


@query("select ceil(l_quantity / 5e0)::bigint - 1 as bin, count(*) as n, count(*) filter (where l_returnflag = 'R') as hits from lineitem group by 1")
def los_proportion_hist(spark, sf_dir):
    """Counts in bins that are closed on the right."""
    return heights.share_by_bin(table(spark, sf_dir, "lineitem"), F.col("l_quantity"), F.col("l_returnflag") == "R", 5.0).select("bin", "n", "hits")


@query("select event_type, median(case when event_id % 7 = 0 then null else value end) as middle from events group by event_type")
def nan_median(spark, sf_dir):
    """Exact medians; values that aren't numbers count as missing."""
    value = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    events = table(spark, sf_dir, "events").select("event_type", value.alias("Cn0DbHz"))
    kinds = [r[0] for r in events.select("event_type").distinct().collect()]  # a handful
    rows = [(k, heights.median_of(*heights.strengths(events.filter(F.col("event_type") == k))[1:3])) for k in kinds]
    return spark.createDataFrame(rows, "event_type string, middle double")


_STEP_SQL = """
f as (select g, z, y, a, b, c, d, 1 / (1 + exp(-b * (z - c))) as f from {rows}),
k as (select *, d + (a - d) * f as p, (a - d) * f * (1 - f) as bend from f),
{name} as (select g, greatest(.501e0, least(.999e0, any_value(a) - .01e0 * avg((p - y) / (p * (1 - p)) * f))) as a, greatest(.01e0, any_value(b) - .0001e0 * avg((p - y) / (p * (1 - p)) * bend * (z - c))) as b,
  greatest(.001e0, any_value(c) + 1e0 * avg((p - y) / (p * (1 - p)) * bend * b)) as c, greatest(.001e0, least(.499e0, any_value(d) - .01e0 * avg((p - y) / (p * (1 - p)) * (1 - f)))) as d from k group by g)
"""
_LEARN = "x as (select l_suppkey as g, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) as i, l_quantity::double as z, case when l_returnflag = 'R' then 1e0 else 0e0 end as y from lineitem)"
_SHOW = ", ".join(f"round({c} * 1e6)::bigint as {c}" for c in "abcd")


def learned(spark: SparkSession, sf_dir: str, fit) -> DataFrame:
    """Parameters of each supplier's curve of returns by quantity, from its rows in order."""

    def per_supplier(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["l_orderkey", "l_linenumber"])
        p = fit(rows["z"].to_numpy(float), rows["y"].to_numpy(float), np.array([0.8, 0.1, 20.0, 0.2]), np.array([0.01, 0.0001, 1.0, 0.01]))
        return pd.DataFrame([(rows["g"].iloc[0], *p)], columns=["g", *"abcd"])

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), "l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("z"), (F.col("l_returnflag") == "R").cast("double").alias("y"))
    found = rows.groupBy("g").applyInPandas(per_supplier, f"g {rows.schema['g'].dataType.simpleString()}, a double, b double, c double, d double")
    return found.select("g", *[micro(F.col(c)).alias(c) for c in "abcd"])


@query("with " + _LEARN + ", i as (select g, z, y, .8e0 as a, .1e0 as b, 20e0 as c, .2e0 as d from x), " + _STEP_SQL.format(rows="i", name="one") + f" select g, {_SHOW} from one")
def fourpl_step(spark, sf_dir):
    return learned(spark, sf_dir, lambda z, y, p, rate: logistic.step(p, z, y, rate))


@query("with " + _LEARN + ", h as (select g, (count(*) + 1) // 2 as n from x group by g), i1 as (select g, z, y, .8e0 as a, .1e0 as b, 20e0 as c, .2e0 as d from x join h using (g) where i <= n), "
       + _STEP_SQL.format(rows="i1", name="one") + ", i2 as (select x.g, z, y, a, b, c, d from x join h using (g) join one using (g) where i > n), "
       + _STEP_SQL.format(rows="i2", name="two").replace("f as (", "f2 as (").replace("from f)", "from f2)").replace("k as (", "k2 as (").replace("from k ", "from k2 ") + f" select g, {_SHOW} from two")
def fourpl_online(spark, sf_dir):
    """Two batches in order of arrival, the second from where the first one ends."""
    return learned(spark, sf_dir, lambda z, y, p, rate: logistic.fit_online(z, y, p, rate, batch=(len(z) + 1) // 2)[-1])


# -- simulation and fits -------------------------------------------------------------


@query("""
with s as (select c_custkey as parent, (c_custkey % 97)::double as x0, (c_custkey % 89)::double as y0 from customer),
d as (select *, sqrt((100 - x0) ** 2 + (50 - y0) ** 2) as far from s),
n as (select *, greatest(1, ceil(far / 1.5e0)::int) as n from d)
select parent, k as step, round((case when k = n - 1 then 100 else x0 + (k + 1) * 1.5e0 / far * (100 - x0) end) * 1e6)::bigint as x,
       round((case when k = n - 1 then 50 else y0 + (k + 1) * 1.5e0 / far * (50 - y0) end) * 1e6)::bigint as y
from (select *, unnest(generate_series(0, n - 1)) as k from n)
""")
def guided_walk(spark, sf_dir):
    k = F.col("c_custkey")
    starts = table(spark, sf_dir, "customer").select(k.alias("parent"), (k % 97).cast("double").alias("x"), (k % 89).cast("double").alias("y"))
    return simulate.guided_walk(starts, (100.0, 50.0), 1.5).select("parent", F.col("step").cast("long").alias("step"), micro(F.col("x")).alias("x"), micro(F.col("y")).alias("y"))


@query("select c_custkey as parent, unnest(generate_series(0, c_custkey % 5)) as step, 1400000 as length from customer")
def random_walk(spark, sf_dir):
    """Lengths of the steps of random walks, the first one's from the start on."""
    k = F.col("c_custkey")
    starts = table(spark, sf_dir, "customer").select(k.alias("parent"), (k % 97).cast("double").alias("x"), (k % 89).cast("double").alias("y"), (k % 5 + 1).cast("int").alias("duration"))
    moved = simulate.walk(starts, "random", 1.4, seed=5).join(starts.select("parent", F.col("x").alias("x0"), F.col("y").alias("y0")), "parent")
    before = Window.partitionBy("parent").orderBy("step")
    dx, dy = (F.col(c) - F.coalesce(F.lag(c).over(before), F.col(f"{c}0")) for c in "xy")
    return moved.select("parent", F.col("step").cast("long").alias("step"), micro(F.sqrt(dx * dx + dy * dy)).cast("int").alias("length"))


@query("select i as parent, true as inside from (select unnest(generate_series(0, 999)) as i)")
def uniform_parents(spark, sf_dir):
    """A thousand single points, all inside their box and time."""
    found = simulate.clusters(spark, (10.0, 20.0, 30.0, 60.0), 5 * K.SECOND, 9 * K.SECOND, 1000, seed=4)
    inside = F.col("x").between(10, 30) & F.col("y").between(20, 60) & F.col("time_ns").between(5 * K.SECOND, 9 * K.SECOND)
    return found.select("parent", inside.alias("inside"))


@query("select o_orderkey as obs_id, case when 35e0 - o_custkey % 40 > 10 then 35e0 - o_custkey % 40 end as ss from orders")
def sample_strengths(spark, sf_dir):
    """Strengths without noise: what the loss leaves, where it is over the least."""
    seen = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("obs_id"), (F.col("o_custkey") % 40).cast("double").alias("fresnel"))
    return simulate.sample(seen, noise=0.0).select("obs_id", F.col("Cn0DbHz").alias("ss"))


@query()
def simulate_points(spark, sf_dir):
    """Walks among the buildings; random, so there is no SQL for it."""
    return simulate.point_process(city(spark, sf_dir), (0.0, 0.0, 2000.0, 1600.0), 0, 3600 * K.SECOND, 500, cluster="random", seed=7)


@query()
def fit_predict(spark, sf_dir):
    """Heights of all buildings from all rays; an iterative fit, so there is no SQL for it."""
    seen = rays(spark, sf_dir).withColumnRenamed("ray_id", "obs_id")
    loss = spatial.fresnel(seen.withColumnRenamed("obs_id", "ray_id"), city(spark, sf_dir)).withColumnRenamed("ray_id", "obs_id")
    return heights.predict(city(spark, sf_dir), simulate.sample(seen.join(loss, "obs_id"), seed=3))
