import math
import random

import pytest
from pyspark.sql import functions as F

from rayscape import constants as K
from rayscape.functions import diffraction, geodesy, planar
from rayscape.operators import orbit, predict, spatial
from rayscape.operators.observe import filter_elevation, observe
from rayscape.sources import geo, orbits, sp3

RING = [(528010.0, 183010.0), (528010.0, 183000.0), (528000.0, 183000.0), (528000.0, 183010.0), (528010.0, 183010.0)]
MAP = "building_id long, ring array<struct<x:double,y:double>>, height double"
RAYS = "ray_id long, r struct<x:double,y:double,z:double>, s struct<x:double,y:double,z:double>"


def canyon(spark):
    return spark.createDataFrame([(3, RING, 10.0), (4, [(x + 20, y) for x, y in RING], 10.0)], MAP)


def rays(spark, *ends):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(ends, 1)], RAYS)


def heights(df):
    return {(r.ray_id, r.building_id): round(r.z, 9) for r in df.collect()}


def test_crossings(spark):
    level = [((527990.0, 183005.0, 0.0), (528019.0, 183005.0, 14.5)), ((528005.0, 183005.0, 10.0), (528015.0, 183005.0, 20.0)), ((527990.0, 183015.0, 10.0), (528020.0, 183015.0, 25.0)), ((528000.0, 182990.0, 3.0), (528000.0, 183020.0, 6.0)), ((528000.0, 183020.0, 6.0), (528000.0, 182990.0, 3.0))]
    found = heights(spatial.projected_height(rays(spark, *level), canyon(spark)))
    assert found == {(1, 3): 5.0, (2, 3): 15.0, (4, 3): 4.0, (5, 3): 4.0}  # the third passes by; the last two run along a wall


def test_grid_equals_all_pairs(spark):
    rng = random.Random(4)
    boxes = [(i, x, y, x + rng.uniform(1, 300), y + rng.uniform(1, 300)) for i in range(40) for x, y in [(rng.uniform(-500, 500), rng.uniform(-500, 500))]]
    m = spark.createDataFrame(boxes, "building_id long, a double, b double, c double, d double").select("building_id", planar.box(*map(F.col, "abcd")).alias("ring"), F.lit(10.0).alias("height"))
    ends = [tuple((rng.uniform(-600, 600), rng.uniform(-600, 600), rng.uniform(0, 20)) for _ in range(2)) for _ in range(60)]
    q = rays(spark, *ends)
    full = q.crossJoin(m).withColumn("c", planar.lowest_crossing(F.col("ring"), F.col("r"), F.col("s"))).filter("c is not null").select("ray_id", "building_id", "c.z")
    assert heights(spatial.projected_height(q, m)) == heights(full)
    points = q.select(F.col("ray_id").alias("point_id"), "r.x", "r.y")
    inside = points.crossJoin(m).filter(planar.contains(F.col("ring"), F.col("x"), F.col("y"), True)).select("point_id").distinct()
    assert {r[0] for r in spatial.inside_any(points, m).collect()} == {r[0] for r in inside.collect()}
    assert spatial.outside(points, m).count() == 60 - inside.count()


def test_sight(spark):
    q = rays(spark, ((527990.0, 183005.0, 0.0), (528015.0, 183005.0, 12.5)), ((527990.0, 183005.0, 10.0), (528015.0, 183005.0, 22.5)), ((527990.0, 183005.0, 5.0), (528050.0, 183005.0, 5.0)))
    every = {r.ray_id: r.is_los for r in spatial.hits_all(q, canyon(spark)).collect()}
    assert every == {1: False, 2: False, 3: True}
    assert {r.ray_id for r in spatial.clear_los(q, canyon(spark)).collect()} == {2}
    wide = {r.ray_id: (r["3"], r["4"]) for r in spatial.height_matrix(spatial.projected_height(q, canyon(spark)), [3, 4]).collect()}
    assert wide[3] == (5.0, 5.0) and wide[1] == (5.0, None)


def test_boundary_counts_as_inside(spark):
    p = spark.createDataFrame([(1, 528000.0, 183005.0), (2, 528005.0, 183005.0), (3, 527999.0, 183005.0)], "point_id long, x double, y double")
    assert {r.point_id for r in spatial.outside(p, canyon(spark)).collect()} == {3}
    area, cx = canyon(spark).filter("building_id = 3").select(planar.area2(F.col("ring")), planar.centroid(F.col("ring"))[0]).first()
    assert abs(area) == 200 and cx == 528005


def test_fresnel(spark):
    values = [-1.0, 0.0, 1.0, 2.4, -2.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = [-20 * math.log(1.12), -20 * math.log(0.5), -20 * math.log(0.4 - (0.1184 - 0.28**2) ** 0.5), -20 * math.log(0.225 / 2.4), 0]
    assert [r[0] for r in df.select(diffraction.fresnel_loss(F.col("v"))).collect()] == pytest.approx(want)
    q = rays(spark, ((527990.0, 183005.0, 0.0), (528020.0, 183005.0, 15.0)))
    one = spatial.fresnel(q, canyon(spark).filter("building_id = 3")).first().fresnel
    v = 5 * (2 / (0.1903 * 10)) ** 0.5
    assert one == pytest.approx(-20 * math.log(0.225 / v))
    flat = rays(spark, ((527990.0, 183005.0, 5.0), (528050.0, 183005.0, 5.0)))
    both, first = (spatial.fresnel(flat, canyon(spark), multi_edge=m).first().fresnel for m in ("all", "first"))
    assert both > first > 0
    with pytest.raises(ValueError):
        spatial.fresnel(flat, canyon(spark), multi_edge="some")


@pytest.mark.parametrize(("crs", "lon", "lat", "xy"), [("EPSG:27700", -0.1276, 51.5072, (530043, 180358)), ("EPSG:32631", 3.0, 45.0, (500000.0, 4982950.400)), ("EPSG:3857", 10.0, 50.0, (1113194.908, 6446275.841)), ("EPSG:32733", 15.5, -20.0, None), ("EPSG:4978", 100.0, -45.0, None)])
def test_reprojection_round_trip(spark, crs, lon, lat, xy):
    df = spark.createDataFrame([(lon, lat, 55.0)], "x double, y double, z double")
    there = df.select(geodesy.packed(geodesy.to_crs(F.col("x"), F.col("y"), F.col("z"), K.LLA, crs)).alias("p")).select("p.*")
    got = there.first()
    if xy:
        assert (got.x, got.y) == pytest.approx(xy, abs=2.0 if crs == "EPSG:27700" else 0.01)
    back = there.select(*[c.alias(n) for n, c in zip("xyz", geodesy.to_crs(F.col("x"), F.col("y"), F.col("z"), crs, K.LLA))]).first()
    assert tuple(back) == pytest.approx((lon, lat, 55.0), abs=1e-6)
    with pytest.raises(ValueError):
        geodesy.to_crs(F.col("x"), F.col("y"), F.col("z"), "EPSG:1", crs)


def test_ray_cut_and_elevation(spark):
    q = rays(spark, ((0.0, 0.0, 0.0), (10000.0, 0.0, 0.0)), ((6378137.0, 0.0, 0.0), (6378137.0 + 1113.19, 1113.19, 0.0)))
    r, s = ([F.col(f"{e}.{c}") for c in "xyz"] for e in "rs")
    rows = q.select(geodesy.packed(geodesy.cut_ray(r, s, 1000.0)).alias("p"), geodesy.elevation(r, s).alias("e")).collect()
    assert tuple(rows[0].p) == (1000.0, 0.0, 0.0) and 44 < rows[1].e < 46
    assert filter_elevation(q.filter("ray_id = 2"), 40, 50).count() == 1 and filter_elevation(q.filter("ray_id = 2"), 50, 60).count() == 0
    with pytest.raises(ValueError):
        filter_elevation(q, 50, 40)


def circular(spark, svids=("G01", "G02", "R10")):
    """A day of five-minute epochs on circular orbits that pass over longitude 0."""
    rows = []
    for n, sv in enumerate(svids):
        for k in range(289):
            a = 2 * math.pi * (k * 300 / 43200) + n * 0.1
            rows.append((k, "2020042", k * 300 * K.SECOND, sv, 26.5e6 * math.cos(a), 26.5e6 * math.sin(a), 1e6 * n, 0.0))
    return spark.createDataFrame(rows, "epoch long, date string, time long, svid string, x double, y double, z double, clockerror double")


def test_orbits(spark, tmp_path):
    table = circular(spark, ("G01",))
    w = orbit.windows(table)
    assert w.count() == 72 and orbit.windows(table.filter("epoch < 8")).count() == 0
    small = [r.mid for r in orbit.windows(table.filter("epoch < 25")).orderBy("mid").collect()]
    assert [(m - small[0]) // (300 * K.SECOND) + 3 for m in small] == [3, 7, 11, 15, 19, 20]
    start = small[0] - 3 * 300 * K.SECOND
    wanted = spark.createDataFrame([(start + 1234 * K.SECOND, "2020042", "G01"), (start - 1, "2020042", "G01"), (start, "2020042", "G09")], "gps_ns long, date string, svid string")
    rows = {(r.gps_ns, r.svid): r for r in orbit.locate(wanted, w).collect()}
    a = 2 * math.pi * 1234 / 43200
    got = rows[(start + 1234 * K.SECOND, "G01")]
    assert (got.sv_x, got.sv_y) == pytest.approx((26.5e6 * math.cos(a), 26.5e6 * math.sin(a)), abs=1e-3)
    assert rows[(start - 1, "G01")].sv_x is None and rows[(start, "G09")].sv_x is None
    store = f"{tmp_path}/store"
    assert orbits.stored_dates(spark, store).count() == 0
    assert orbits.update(spark, store, table).count() == 72 and orbits.update(spark, store, table).count() == 72
    orbits.export_json(orbits.read(spark, store), f"{tmp_path}/json")
    back = orbits.import_json(spark, f"{tmp_path}/json")
    assert sorted(map(str, back.select(*orbits.SCHEMA.names).collect())) == sorted(map(str, orbits.read(spark, store).select(*orbits.SCHEMA.names).collect()))


def test_sp3_files(spark, tmp_path):
    table = circular(spark, ("G01", "R10")).filter("epoch < 12")
    sp3.write(table, f"{tmp_path}/sp3")
    back = sp3.parse(spark, f"{tmp_path}/sp3/*/*.txt")
    key = lambda r: (r.date, r.epoch, r.svid, r.time, round(r.x), round(r.y))
    assert sorted(map(key, back.collect())) == sorted(map(key, table.collect()))
    assert sp3.file_name("2020042") == "ESA0MGNFIN_20200420000_01D_05M_ORB.SP3.gz" and sp3.file_name("2020042", "ultra") == "esu20922_00.sp3.Z"
    assert sp3.available("2020042", str(tmp_path)) is None


def test_observe(spark):
    w = orbit.windows(circular(spark))
    noon = int(w.filter("svid = 'G01'").agg(F.min("mid")).first()[0])
    utc = noon + K.GPS_EPOCH - 18 * K.SECOND
    points = spark.createDataFrame([(1, utc, "G01", 40.0, 5.0, 10.0, 50.0), (1, utc, "R93", 33.0, 5.0, 10.0, 50.0), (1, utc, "J01", 1.0, 5.0, 10.0, 50.0)], "point_id long, time_ns long, svid string, Cn0DbHz double, x double, y double, z double")
    with pytest.warns(UserWarning, match="J"):
        rows = {r.svid: r for r in observe(points, w, low=0, high=90).collect()}
    assert set(rows) == {"G01", "G02", "R10"}
    assert rows["G01"].Cn0DbHz == 40 and rows["R10"].Cn0DbHz == 33 and rows["G02"].Cn0DbHz is None
    with pytest.raises(ValueError):
        observe(points.filter("svid = 'J01'"), w)


def test_observe_gives_elevations(spark):
    """A satellite's own elevation, which the end of its ray, a thousand metres away, tells to ten digits only."""
    w = orbit.windows(circular(spark))
    noon = int(w.filter("svid = 'G01'").agg(F.min("mid")).first()[0])
    lon, lat = 5.0, 10.0
    points = spark.createDataFrame([(noon + K.GPS_EPOCH - 18 * K.SECOND, lon, lat, 50.0)], "time_ns long, x double, y double, z double")
    rows = observe(points, w, {"G", "R"}, low=0, high=90, elevation="elevation").collect()
    sats = {r.svid: (r.sv_x, r.sv_y, r.sv_z) for r in orbit.locate(w.select(F.lit(noon).alias("gps_ns"), "date", "svid").distinct(), w).collect()}
    up = (math.cos(math.radians(lat)) * math.cos(math.radians(lon)), math.cos(math.radians(lat)) * math.sin(math.radians(lon)), math.sin(math.radians(lat)))
    assert rows
    for r in rows:
        d = [a - b for a, b in zip(sats[r.svid], (r.r.x, r.r.y, r.r.z))]
        sine = sum(a * b for a, b in zip(d, up)) / math.sqrt(sum(a * a for a in d))
        assert r.elevation == pytest.approx(math.degrees(math.asin(sine)), abs=1e-12)


def test_two_frequencies(spark):
    """Two measurements of one satellite are two observations with ids of their own: pairs and losses count each once."""
    w = orbit.windows(circular(spark, ("G01",)))
    utc = int(w.agg(F.min("mid")).first()[0]) + K.GPS_EPOCH - 18 * K.SECOND
    points = spark.createDataFrame([(utc, "G01", 40.0, 5.0, 10.0, 50.0), (utc, "G01", 35.0, 5.0, 10.0, 50.0)], "time_ns long, svid string, Cn0DbHz double, x double, y double, z double")
    seen = observe(points, w, low=0, high=90)
    assert sorted(r.Cn0DbHz for r in seen.collect()) == [35, 40] and seen.select("obs_id").distinct().count() == 2
    ray = spark.createDataFrame([("a", (527990.0, 183005.0, 0.0), (528019.0, 183005.0, 14.5), 40.0), ("b", (527990.0, 183005.0, 0.0), (528019.0, 183005.0, 14.5), 35.0)], "obs_id string, r struct<x:double,y:double,z:double>, s struct<x:double,y:double,z:double>, Cn0DbHz double")
    pairs = predict.prepare(ray, canyon(spark)).collect()
    assert sorted((r.obs_id, r.ss) for r in pairs) == [("a", 40), ("b", 35)]
    one = ray.select(F.lit("same").alias("ray_id"), "r", "s")
    once, twice = (sorted(r.fresnel for r in spatial.fresnel(x, canyon(spark)).collect()) for x in (one.limit(1), one))
    assert twice == once * 2


def test_old_archives(spark, tmp_path):
    """Files of every product are read, from the best one there is, and days that are stored aren't read again."""
    table = circular(spark, ("G01", "R10")).filter("epoch < 12")
    sp3.write(table, f"{tmp_path}/sp3")
    body = next((tmp_path / "sp3").glob("*/*.txt")).read_bytes()
    (tmp_path / "files").mkdir()
    for most in (12, 9):
        packed = compress(body * 3, most)
        assert sp3.lzw(packed) == body * 3
    (tmp_path / "files" / sp3.file_name("2020042", "ultra")).write_bytes(compress(body, 16))
    store, files = f"{tmp_path}/store", f"{tmp_path}/files"
    with pytest.warns(UserWarning, match="2020042 have no final|2020043 have no orbits"):
        assert orbits.update(spark, store, files, ["2020042", "2020043"]).select("svid").distinct().count() == 2
    (tmp_path / "files" / sp3.file_name("2020042", "ultra")).write_bytes(b"not read again")
    assert orbits.update(spark, store, files, ["2020042"]).select("svid").distinct().count() == 2


def compress(data, most):
    """A writer of .Z files, for the test of their reader."""
    out, table, n, width, first, word = bytearray(b"\x1f\x9d" + bytes([0x80 | most])), {bytes([k]): k for k in range(256)}, 0, 9, 257, b""
    bits, codes = 0, 0

    def put(code):
        nonlocal bits, n, codes
        bits |= code << n
        n += width
        codes += 1

    def align():
        nonlocal n, codes
        n += (-codes % 8) * width
        codes = 0

    free = first
    for k in range(len(data)):
        if word + data[k : k + 1] in table:
            word += data[k : k + 1]
            continue
        put(table[word])
        if free < 1 << most:
            table[word + data[k : k + 1]] = free
            free += 1
        if free > 1 << width and width < most:
            align()
            width += 1
        word = data[k : k + 1]
    put(table[word])
    return bytes(out) + bits.to_bytes(-(-n // 8), "little")


def test_planes_and_collections(spark, tmp_path):
    flat = canyon(spark)
    deep = flat.withColumn("ring", F.transform("ring", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), F.lit(1.0).alias("z"))))
    with pytest.warns(UserWarning, match="dropped"):
        assert spatial.drop_z(deep).schema["ring"].dataType.elementType.names == ["x", "y"]
    geo.write_collection(flat, geo.ring_geometry(F.col("ring")), f"{tmp_path}/c", ["building_id", "height"])
    assert sorted(r.height for r in geo.read_map(spark, f"{tmp_path}/c").collect()) == sorted(r.height for r in flat.collect())


def test_geojson(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"height":7},"geometry":{"type":"Polygon","coordinates":[[[0,0],[0,2],[2,2],[2,0],[0,0]]]}},{"type":"Feature","properties":{"height":null},"geometry":{"type":"Point","coordinates":[1,2,3]}}]}')
    m = geo.read_map(spark, str(path))
    assert m.select("height").first()[0] == 7 and geo.read_points(spark, str(path)).select("x", "y", "z").first() == (1, 2, 3)
    geo.write_features(m, geo.ring_geometry(F.col("ring")), f"{tmp_path}/out", ["building_id", "height"])
    assert geo.read_sequence(spark, f"{tmp_path}/out", "struct<building_id:bigint,height:double>", "array<array<array<double>>>").first().height == 7
    geo.write_layer(canyon(spark), f"{tmp_path}/layer")
    assert geo.read_layer(spark, f"{tmp_path}/layer", bbox=(528015.0, 0.0, 528100.0, 1e6)).count() == 1
    assert geo.read_layer(spark, f"{tmp_path}/layer", rows=slice(1, 2)).first().building_id == 4
    assert geo.read_layer(spark, f"{tmp_path}/layer", mask=[(528009.0, 183009.0), (528009.0, 183011.0), (528011.0, 183011.0), (528011.0, 183009.0), (528009.0, 183009.0)]).count() == 1
