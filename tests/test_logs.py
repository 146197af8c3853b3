import pytest
from pyspark.sql import functions as F

from rayscape import read_gnsslogger
from rayscape.operators.asof import asof_join
from rayscape.operators.features import process_raw, pseudorange_report
from rayscape.sources import gnsslogger

HEAD = """#
# Version: {version} Platform: {platform} Manufacturer: x Model: y
#
# Raw,ElapsedRealtimeNanos,TimeNanos,FullBiasNanos,Svid,State,ReceivedSvTimeNanos,Cn0DbHz,CarrierFrequencyHz,ConstellationType,CarrierFrequencyHz
# Fix,Provider,Latitude,Longitude,Altitude,Speed,Accuracy,(UTC)TimeInMs,ElapsedRealtimeNanos
"""
TIME = 180000000000


def log(folder, version="v2.0.0.1", platform="9", extra=()):
    rx = 1265446185999559028
    lines = [HEAD.format(version=version, platform=platform).rstrip()]
    for k in range(4):
        gap = 80647622
        lines.append(f"Raw, {k},{TIME},{TIME - rx - k * 10**9},{k + 1},9,{(rx + k * 10**9 - gap) % 604800000000000},3{k}.5,1.5,1,2.5")
    lines += [f"Fix,gps,51.5,-0.13,114.8,0,8,{1581410967999 + 1000 * k},1" for k in range(2)] + ["Fix,gps,,,,0,8,1581410970500,1", *extra]
    (folder / "log.txt").write_text("\n".join(lines) + "\n")
    return str(folder / "log.txt")


def test_read(spark, tmp_path):
    points = read_gnsslogger(spark, log(tmp_path)).orderBy("line_no").collect()
    assert [p.svid for p in points] == ["G01", "G02"]  # those of the last two seconds have no fix within 990 ms
    assert points[0].time_ns == 1581410967999559028 and points[0].rx - points[0].tx == 80647622
    assert (points[0].x, points[0].y, points[0].z) == (-0.13, 51.5, 114.8)
    assert points[0]["CarrierFrequencyHz.1"] == 2.5 and points[0].CarrierFrequencyHz == 1.5


def test_missing_values_stay_exact(spark, tmp_path):
    path = log(tmp_path, extra=[f"Raw,9,,-1265446151445559028,5,9,1,NaN,,1,", "Raw,10,12.0,-1,,,,,,,"])
    raw, _ = gnsslogger.read_raw_and_fix(spark, path)
    last = raw.orderBy(F.desc("line_no")).limit(2).collect()
    assert last[1].FullBiasNanos == -1265446151445559028 and last[1].TimeNanos is None and last[1].Cn0DbHz is None
    assert last[0].TimeNanos == 12 and last[0].Svid is None
    report = pseudorange_report(process_raw(raw)).first()
    assert report.least == report.greatest == 80647622 and report.implausible == 0


def test_gates(spark, tmp_path):
    with pytest.raises(ValueError, match="version"):
        read_gnsslogger(spark, log(tmp_path, version="v1.3.9.9"))
    with pytest.warns(UserWarning, match="platform"):
        read_gnsslogger(spark, log(tmp_path, platform="6"))


def brute(left, right, tolerance, ok):
    out = {}
    for i, t in left:
        near = [(abs(t - u), u, -j) for j, u in right if t is not None and u is not None and abs(t - u) <= tolerance and ok(t, u)]
        if near:
            out[i] = -min(near)[2]
    return out


@pytest.mark.parametrize("direction", ["nearest", "backward", "forward"])
def test_asof_equals_brute_force(spark, direction):
    import random

    rng = random.Random(1)
    left = [(i, rng.choice([None, rng.randrange(20000)])) for i in range(200)]
    right = [(j, rng.choice([None, rng.randrange(0, 20000, 7), 5000])) for j in range(80)]
    a, b = spark.createDataFrame(left, "i int, t long").repartition(3), spark.createDataFrame(right, "j int, u long").repartition(2)
    ok = {"nearest": lambda t, u: True, "backward": lambda t, u: u <= t, "forward": lambda t, u: u >= t}[direction]
    found = asof_join(a, b, "t", "u", 990, order="j", direction=direction)
    assert {r.i: r.j for r in found.collect()} == brute(left, right, 990, ok)
    assert asof_join(a, b, "t", "u", 990, order="j", direction=direction, how="left").count() == 200


def test_asof_rejects(spark):
    a = spark.createDataFrame([(1, 1)], "i int, t long")
    with pytest.raises(ValueError):
        asof_join(a, a, "t", "t", 1)
    with pytest.raises(ValueError):
        asof_join(a, a, "t", "t", 1, direction="sideways")


def most_rows(spark, df):
    """The most rows that any step of a plan made."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.collect()
        todo, most = [df._jdf.queryExecution().executedPlan()], 0
        while todo:
            node = todo.pop()
            if node.metrics().contains("numOutputRows"):
                most = max(most, node.metrics().apply("numOutputRows").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return most
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("direction", ["nearest", "backward", "forward"])
def test_asof_makes_no_pairs(spark, direction):
    a = spark.range(2000).selectExpr("id as i", "id * 3 as t").union(spark.range(100).selectExpr("id + 2000 as i", "3000L as t"))
    b = spark.range(2000).selectExpr("id as j", "(id div 2) * 5 as u")
    found = asof_join(a, b, "t", "u", 6000, order="j", direction=direction)
    assert most_rows(spark, found) < 20_000
    rows = {r.i: (r.t, r.u, r.j) for r in found.collect()}
    best = {"nearest": lambda t: min(range(0, 5000, 5), key=lambda u: (abs(t - u), u)), "backward": lambda t: min(t // 5 * 5, 4995), "forward": lambda t: -(-t // 5) * 5}[direction]
    late = {r.i for r in a.filter("t > 4995").collect()} if direction == "forward" else set()
    assert set(rows) == set(range(2100)) - late
    assert all(u == best(t) and j == u // 5 * 2 + 1 for t, u, j in rows.values())
