import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rayscape import constants as K
from rayscape import predict, schemas
from rayscape.functions import fourpl
from rayscape.operators import logistic as L
from rayscape.operators import predict as heights
from rayscape.operators import simulate, spatial
from rayscape.streaming import ONLINE, fit_online

MAP = "building_id long, ring array<struct<x:double,y:double>>, height double"


def square(x, y, size=10.0):
    return [(x + size, y + size), (x + size, y), (x, y), (x, y + size), (x + size, y + size)]


def test_curve(spark):
    p = np.array([0.95, 1.0, 1.0, 0.05])
    assert L.curve(p, np.array([1.0, 1e6, -1e6])) == pytest.approx([0.5, 0.95, 0.05])
    df = spark.createDataFrame([(1.0,), (1.001,), (None,), (float("nan"),)], "z double")
    a, b, c, d = map(F.lit, map(float, p))
    rows = df.select(fourpl.prob(F.col("z"), a, b, c, d).alias("p"), fourpl.predict(F.col("z"), a, b, c, d).alias("k"), fourpl.inverse(fourpl.curve(F.col("z"), a, b, c, d), a, b, c, d).alias("i")).collect()
    assert [r.p for r in rows] == pytest.approx([0.5, 0.5 + 0.9 / 4 * 0.001, 0, 0]) and [r.k for r in rows] == [0, 1, 0, 0] and rows[1].i == pytest.approx(1.001)
    assert L.predict(p, np.array([np.nan, 1.0, 1.001])).tolist() == [0, 0, 1]


def test_step():
    p, rate = np.array([0.95, 1.0, 1.0, 0.05]), np.array([0.01, 0.01, 0.01, 0.01])
    got = L.step(p, np.array([1.0, 1.0]), np.array([0.0, 0.0]), rate)
    assert got == pytest.approx([0.94, 1.0, 1.0045, 0.04])


def test_gradient():
    rng = np.random.default_rng(0)
    z, y, w = rng.uniform(0, 60, 50), rng.integers(0, 2, 50).astype(float), rng.uniform(0.5, 2, 50)
    p = np.array([0.8, 0.2, 30.0, 0.1])
    for likelihood in (True, False):
        _, grad = L.loss(p, z, y, w, likelihood)
        for k in range(4):
            q = p.copy()
            q[k] += 1e-6
            assert (L.loss(q, z, y, w, likelihood)[0] - L.loss(p, z, y, w, likelihood)[0]) / 1e-6 == pytest.approx(grad[k], rel=1e-3, abs=1e-4)


@pytest.mark.parametrize("seed", range(5))
def test_offline_fit_is_below_a_grid(seed):
    rng = np.random.default_rng(seed)
    z, y = np.arange(100.0), rng.permutation(np.arange(100) % 2).astype(float)
    p = L.fit_offline(z, y, np.array(L.START))
    grid = min(L.loss(np.array([a, b, c, d]), z, y, np.ones(100), True)[0] for a in (0.501, 0.6, 0.8, 0.95) for b in (0.01, 0.1, 1) for c in range(0, 100, 10) for d in (0.01, 0.2, 0.4))
    assert L.loss(p, z, y, np.ones(100), True)[0] <= grid + 1e-3


def test_offline_fit_recovers():
    rng = np.random.default_rng(1)
    true = np.array([0.85, 0.3, 47.0, 0.1])
    z = rng.uniform(0, 90, 20_000)
    p = L.fit_offline(z, (rng.random(20_000) < L.curve(true, z)).astype(float), np.array(L.START))
    assert p == pytest.approx(true, abs=1.0) and p[2] == pytest.approx(47, abs=0.5)
    both = np.concatenate([z[:50], z[:50]]), np.ones(100)
    y = np.tile((z[:50] > 40).astype(float), 2)
    assert L.fit_offline(both[0], y, np.array(L.START)) == pytest.approx(L.fit_offline(z[:50], y[:50], np.array(L.START), np.full(50, 2.0)), rel=1e-2, abs=0.2)


def test_online_history_and_bootstrap_shape():
    z = np.array([1.0, np.nan, 2.0, 3.0, 4.0])
    out = L.fit_online(z, np.array([0.0, 0.0, 1.0, 1.0, 1.0]), np.array(L.START), np.full(4, 0.01), batch=2)
    assert out.shape == (5, 4) and (out[0] == out[1]).all() and (out[2] != out[1]).any()
    assert L.batches(np.array([1.0, 5.0, np.nan, 9.0]), np.array([20.0, np.nan, 30.0, 40.0]), 4, 3).shape == (12, 2, 4)
    with pytest.raises(ValueError):
        L.batches(np.zeros(2), np.zeros(3))


def scene(spark, n=400, seed=0):
    """Rays across one 20 m building, weak below its roof; a second building that no ray crosses."""
    rng = np.random.default_rng(seed)
    z = rng.uniform(1, 40, n)
    ss = np.where(z < 20, rng.normal(18, 2, n), rng.normal(38, 2, n))
    rows = [(i, (-20.0, 5.0, float(h)), (15.0 - 10.001, 5.0, float(h)), float(s)) for i, (h, s) in enumerate(zip(z, ss))] + [(n + 1, (-20.0, 80.0, 1.0), (-10.0, 80.0, 1.0), None)]
    obs = spark.createDataFrame(rows, "obs_id long, r struct<x:double,y:double,z:double>, s struct<x:double,y:double,z:double>, Cn0DbHz double")
    return spark.createDataFrame([(1, square(0.0, 0.0), 20.0), (2, square(500.0, 500.0), 5.0)], MAP), obs


def test_predict(spark):
    buildings, obs = scene(spark)
    rows = {r.building_id: r for r in predict(buildings, obs).collect()}
    assert rows[1].lower_bound == pytest.approx(20, abs=1.5) and rows[1].lower_bound <= rows[1].mid_point <= rows[1].upper_bound
    assert rows[2].lower_bound is None
    edge = heights.fit_edge(heights.prepare(obs, buildings)).first()
    assert edge.lower_bound == pytest.approx(20, abs=3)


def test_walks(spark):
    start = spark.createDataFrame([(0, 0.0, 0.0), (1, 2.0, 1.0)], "parent long, x double, y double")
    rows = simulate.guided_walk(start, (2.0, 1.0), 1.25**0.5).orderBy("parent", "step").collect()
    assert [(r.x, r.y) for r in rows] == [pytest.approx((1.0, 0.5)), (2.0, 1.0), (2.0, 1.0)]
    w = simulate.walk(start.withColumn("duration", F.lit(5)), "random", 2.0, 3).orderBy("parent", "step").collect()
    assert len(w) == 10 and np.hypot(w[1].x - w[0].x, w[1].y - w[0].y) == pytest.approx(2.0)
    for bad in (lambda: simulate.walk(start, "x", 1.0), lambda: simulate.clusters(spark, (0, 0, 1, 1), 0, 1, 1, "x"), lambda: simulate.clusters(spark, (0, 0, 1, 1), 0, 1, 1, "guided")):
        with pytest.raises(ValueError):
            bad()


def test_points_and_samples(spark):
    m = spark.createDataFrame([(1, square(0.0, 0.0), 5.0)], MAP)
    for cluster in ("none", "random", "levy"):
        p = simulate.point_process(m, (-10.0, 0.0, 10.0, 10.0), 0, 3600 * K.SECOND, 200, cluster=cluster, seed=1).collect()
        assert p and all(-10 < r.x < 10 and 0 < r.y < 10 and r.z == 1 and not (0 <= r.x <= 10 and 0 <= r.y <= 10) for r in p)
    again = simulate.uniform_points(spark, (0, 0, 1, 1), 50, 9)
    assert sorted(map(str, again.collect())) == sorted(map(str, again.repartition(7).collect()))
    obs = spark.range(10_000).select(F.col("id").alias("obs_id"), F.when(F.col("id") % 2 == 0, 0.0).otherwise(35.0).alias("fresnel"))
    got = simulate.sample(obs, mu=45.0).groupBy((F.col("obs_id") % 2).alias("k")).agg(F.avg("Cn0DbHz").alias("m"), F.min("Cn0DbHz").alias("low"), F.count("Cn0DbHz").alias("n")).orderBy("k").collect()
    assert got[0].m == pytest.approx(45, abs=0.3) and got[0].n == 5000 and got[1].low > 10 and got[1].n < 3500
    with pytest.raises(AttributeError):
        simulate.sample(obs.drop("fresnel"))


def test_checks(spark):
    m = spark.createDataFrame([(1, square(0.0, 0.0), 5.0)], MAP)
    assert schemas.validate(m, "map") is m and schemas.infer_kind(m) == "map"
    assert schemas.failures(spark.createDataFrame([(1, square(0.0, 0.0)[:3], None)], MAP), "map") == ["not_polygons", "open_rings", "missing_height"]
    with pytest.raises(AttributeError, match="column_height"):
        schemas.validate(m.drop("height"), "map")
    with pytest.raises(ValueError):
        schemas.failures(m, "maps")
    assert spatial.reproject_map(m, "EPSG:32631", "EPSG:32631") is m


def test_warnings(spark):
    with pytest.warns(UserWarning, match="heights"):
        schemas.warn_of_plane_crs("EPSG:27700")
    with pytest.warns(UserWarning, match="digits"):
        schemas.warn_of_inexact_times(spark.createDataFrame([(1.0,)], "time_ns double"))


def test_stream_fit(spark, tmp_path):
    """Two micro-batches update a building's state; the output is its history."""
    schema = "building_id long, obs_id long, time_ns long, height double, ss double"
    for k in range(2):
        spark.createDataFrame(pd.DataFrame({"building_id": [1] * 20, "obs_id": range(20), "time_ns": range(20), "height": np.linspace(1, 40, 20), "ss": np.linspace(10, 45, 20)}), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = fit_online(stream).writeStream.format("memory").queryName("history").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(120)
    rows = spark.table("history").orderBy("n", "model").collect()
    assert [(r.n, r.model) for r in rows] == [(20, "height"), (20, "strength"), (40, "height"), (40, "strength")]
    assert rows[0].c != rows[2].c and ONLINE.startswith("building_id")


def test_online_bootstrap_counts_every_observation():
    """A row that stands for many observations steps the strength model as often as they would."""
    height, ss, w = np.array([30.0, np.nan]), np.array([25.0, 25.0]), np.array([1.0, 4999.0])
    n = w.astype(int)
    one = L.bootstrap(height, ss, w, 2, height_start=L.START, online=True)
    every = L.bootstrap(np.repeat(height, n), np.repeat(ss, n), None, 2, height_start=L.START, ss_middle=25.0, online=True)
    np.testing.assert_allclose(one[:, 0], every[:, 0], rtol=0.01)
    zero = L.bootstrap(np.append(height, np.nan), np.append(ss, 90.0), np.append(w, 0.0), 2, height_start=L.START, ss_middle=25.0, online=True)
    np.testing.assert_allclose(zero, one)


def test_common_strengths_are_summed_by_few_nodes():
    """A fit among many strengths is that over all of them, though flat curves meet a few nodes only."""
    rng = np.random.default_rng(3)
    values = np.unique(np.round(rng.normal(33, 6, 6000), 4))
    counts = rng.integers(1, 30, len(values))
    common = L.Condensed(values, counts)
    assert common.levels and len(common.at(0.1)[1]) < 200 and len(common.at(100.0)[1]) == len(values)
    for p in ([0.9, 0.02, 30.0, 0.1], [0.7, 0.3, 40.0, 0.01], [0.6, 1.7, 35.0, 0.3], [0.99, 20.0, 33.0, 0.2]):
        _, z, w = common.at(p[1])
        many, few = (L.loss(np.array(p), a, np.zeros(len(a)), b.astype(float), True) for a, b in ((values, counts), (z, w)))
        assert few[0] == pytest.approx(many[0], rel=1e-9) and few[1] == pytest.approx(many[1], rel=1e-7, abs=1e-12)
    own = rng.integers(0, len(values), 12)
    ss, height, left = values[own], rng.uniform(0, 50, 12), counts.copy()
    np.subtract.at(left, own, 1)
    start = {"height_start": np.array([0.8, 0.1, 25.0, 0.2]), "ss_middle": 33.0}
    plain = L.bootstrap(np.concatenate([height, np.full(len(values), np.nan)]), np.concatenate([ss, values]), np.concatenate([np.ones(12), left]), 2, **start)
    assert L.bootstrap(height, ss, None, 2, common=common, taken=ss, **start)[:, 1] == pytest.approx(plain[:, 1], rel=1e-6)


@pytest.mark.parametrize("decimals", [4, 0])
def test_many_fits_are_those_of_each_alone(decimals):
    """Height models of all buildings at once are those of the whole bootstrap; only buildings with one of the strongest rays need their strength models."""
    rng = np.random.default_rng(5)
    ss = np.round(rng.normal(33, 6, 9000), decimals)
    values, counts = np.unique(ss, return_counts=True)
    common = L.Condensed(values, counts)
    weak = L.Weak(common, counts.astype(float), 0.0)
    n = rng.integers(1, 20, 150)
    height, own = rng.uniform(0, 50, (150, 19)), rng.choice(ss, (150, 19))
    own[rng.random(own.shape) < 0.5] = np.nan
    own[:3, 0] = values[-1], values[-3], np.nan
    own[2] = np.nan
    gone = np.arange(19) >= n[:, None]
    height[gone] = own[gone] = np.nan
    strongest = np.where(np.isnan(own), -1, np.searchsorted(values, own)).max(axis=1)
    starts = np.tile((0.8, 0.1, 0.0, 0.2), (150, 1))
    starts[:, 2] = np.nanmedian(height, axis=1)
    found, sure = L.bootstrap_heights(height, own, n, strongest, weak, starts, 33.0)
    assert not sure[0] and sure[2] and sure.mean() > 0.8
    for i in np.flatnonzero(sure)[:60]:
        h, s = height[i, : n[i]], own[i, : n[i]]
        alone = L.bootstrap(h, s, None, 4, common=common, taken=s[~np.isnan(s)], height_start=starts[i], ss_middle=33.0)
        assert not any(L.predict(a, s).any() for a, _ in alone[:3])
        ones = [L.loss(p, h, np.zeros(n[i]), np.ones(n[i]), True)[0] for p in (found[i], alone[-1][1])]
        assert ones[0] == pytest.approx(ones[1], rel=1e-6, abs=1e-8)


def test_predict_is_the_last_step_of_fit(spark, monkeypatch):
    """Buildings that are fitted together, in many batches or few, have the bounds of their own fits; one with the map's strongest rays keeps its strength model."""
    rng = np.random.default_rng(1)
    rows = [(i, (-20.0, 20.0 * k + 5, float(z)), (4.999, 20.0 * k + 5, float(z)), float(s)) for i, (k, z, s) in enumerate(zip(rng.integers(0, 12, 900).tolist(), rng.uniform(1, 40, 900), rng.normal(30, 5, 900)))]
    rows += [(2000 + i, (-20.0, 245.0, float(i)), (4.999, 245.0, float(i)), 25.0 if i < 20 else 60.0) for i in range(40)]
    obs = spark.createDataFrame(rows, "obs_id long, r struct<x:double,y:double,z:double>, s struct<x:double,y:double,z:double>, Cn0DbHz double")
    buildings = spark.createDataFrame([(k, square(0.0, 20.0 * k), 20.0) for k in range(14)], MAP)
    last = {r.building_id: r for r in heights.fit(obs, buildings).filter("model = 'height' and step = 3").collect()}
    for least in (100_000, 40):
        monkeypatch.setattr(heights, "AT_ONCE", least)
        found = {r.building_id: r for r in predict(buildings, obs).collect()}
        assert sorted(found) == list(range(14)) and sorted(last) == list(range(13)) and found[13].lower_bound is None
        for k, p in last.items():
            assert (found[k].lower_bound, found[k].upper_bound) == pytest.approx((p.c, p.c + 3 / p.b), rel=1e-4)


def test_groups_keep_buildings_whole():
    ids = np.repeat(np.arange(6), [1, 7, 2, 30, 1, 3])
    rows = pd.DataFrame({"building_id": ids, "x": np.arange(len(ids))})
    for size, least in ((1, 4), (5, 4), (100, 4), (5, 1000)):
        parts = list(heights.groups((rows[i : i + size] for i in range(0, len(rows), size)), least))
        assert pd.concat(parts)["x"].tolist() == rows["x"].tolist() and sum(p["building_id"].nunique() for p in parts) == 6
    assert list(heights.groups(iter(()), 4)) == []
    n = np.array([1, 300, 2, 2, 9000, 40, 1])
    assert sorted(np.concatenate(list(heights.alike(n)))) == list(range(7)) and all(len(k) == 1 or n[k].max() <= max(16, 2 * n[k].min()) for k in heights.alike(n))
