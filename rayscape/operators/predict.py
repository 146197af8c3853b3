"""Building heights from rays and signal strengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rayscape.functions.fourpl import height_bounds
from rayscape.operators import logistic
from rayscape.operators.spatial import CELL, projected_height
from rayscape.session import once

STRENGTHS = 50_000  # different strengths of rays that miss a building, about, which a task takes one by one
STEPS = (0.0, *(10.0**k for k in range(-6, 300, 1)))  # widths of bins, of which the least that leaves so few is taken; 0: no bins
AT_ONCE, PLACES = 100_000, 400_000  # rays of buildings that are fitted together, about, and padded places of a step
RESULT = "building_id bigint, step int, model string, a double, b double, c double, d double"


def prepare(observations: DataFrame, buildings: DataFrame, cell: float = CELL) -> DataFrame:
    """(building_id, obs_id, height, ss) of the rays that cross a building's outline, a row for each observation; all other pairs have no height."""
    rays = observations.select(F.col("obs_id").alias("ray_id"), "r", "s", F.col("Cn0DbHz").alias("ss"))
    crossed = projected_height(rays, buildings, cell, keep=["ss"])
    return crossed.select(F.col("ray_id").alias("obs_id"), "building_id", F.col("z").alias("height"), "ss")


def bin_of(value: Column, width: float) -> Column:
    """The bin of a strength, as a number; the strength itself where there are no bins."""
    return F.floor(value / F.lit(width)).cast("double") if width else value


def strengths(observations: DataFrame, most: int = STRENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(bins, mean strengths in them, how often, width of a bin) of all signal strengths there are.

    Receivers' logs have a few hundred different values, which are taken as they are (width 0). Only where there are over ``most`` do neighbours share a bin, of the
    least power of ten that leaves so few, and count by their mean.
    """
    value = F.nanvl("Cn0DbHz", F.lit(None).cast("double"))
    tried = [w for w in STEPS if w <= 1e6]
    several = observations.agg(*[F.approx_count_distinct(bin_of(value, w)) for w in tried]).first()
    width = next((w for w, n in zip(tried, several) if n <= most), tried[-1])
    rows = observations.select(bin_of(value, width).alias("b"), value.alias("v")).filter("v is not null").groupBy("b").agg(F.avg("v").alias("v"), F.count("*").alias("n")).orderBy("b").collect()
    return np.array([r.b for r in rows], float), np.array([r.v for r in rows], float), np.array([r.n for r in rows], float), width


def median_of(values: np.ndarray, counts: np.ndarray) -> float:
    """Median of values that come so often each; NaN without any."""
    if not len(values):
        return float("nan")
    ends, n = np.cumsum(counts), counts.sum()
    return float(np.mean([values[np.searchsorted(ends, k, "right")] for k in ((n - 1) // 2, n // 2)]))


def fit(observations: DataFrame, buildings: DataFrame, iterations: int = 4, online: bool = False, cell: float = CELL) -> DataFrame:
    """Parameters of both models of each building after each iteration: ``building_id, step, model, a, b, c, d``.

    All observations count for every building: those that miss it are alike but for their strength, so they come as a table of strengths
    and counts, less the building's own, of which flat curves are summed by quadrature. A building that no ray crosses has no rows.
    """
    bins, values, counts, width = strengths(observations)
    middle = median_of(values, counts)
    common = None if online else logistic.Condensed(values, counts)

    def per_building(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("obs_id")
        h, s = group["height"].to_numpy(float), group["ss"].to_numpy(float)
        heard = s[~np.isnan(s)]
        own = np.searchsorted(bins, np.floor(heard / width) if width else heard)
        start = np.array([0.8, 0.1, np.nanmedian(h), 0.2])
        how = {"height_start": start, "ss_middle": middle if np.isfinite(middle) else 20.0}
        if common is not None:
            return table(group, logistic.bootstrap(h, s, None, iterations, common=common, taken=values[own], **how))
        rest = counts.copy()
        np.subtract.at(rest, own, 1)
        height = np.concatenate([h, np.full(len(values), np.nan)])
        strength, weight = np.concatenate([s, values]), np.concatenate([np.ones(len(h)), rest])
        return table(group, logistic.bootstrap(height, strength, weight, iterations, online=online, **how))

    def table(group: pd.DataFrame, done: np.ndarray) -> pd.DataFrame:
        rows = [(int(group["building_id"].iloc[0]), k, name, *map(float, p)) for k, both in enumerate(done) for name, p in zip(("strength", "height"), both)]
        return pd.DataFrame(rows, columns=["building_id", "step", "model", "a", "b", "c", "d"])

    # fits cost far more than their rows weigh, so they are dealt to as many tasks as there are shuffle partitions at least, uncoalesced
    pairs = prepare(observations, buildings, cell)
    tasks = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * pairs.sparkSession.sparkContext.defaultParallelism)
    return pairs.repartition(tasks, "building_id").groupBy("building_id").applyInPandas(per_building, RESULT)


def groups(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Rows that come by building, about ``least`` at a time, with all rows of each building together."""
    kept, n, enough = [], 0, least
    for some in batches:
        kept.append(some)
        n += len(some)
        if n >= enough:
            rows = pd.concat(kept, ignore_index=True)
            ends = np.flatnonzero(np.diff(rows["building_id"].to_numpy())) + 1
            if len(ends):
                yield rows.iloc[: ends[-1]]
                rows = rows.iloc[ends[-1] :]
            kept, n, enough = [rows], len(rows), max(least, 2 * len(rows))  # a building of so many rows waits for as many again
    if n:
        yield pd.concat(kept, ignore_index=True)


def last_heights(observations: DataFrame, buildings: DataFrame, iterations: int = 4, cell: float = CELL) -> DataFrame:
    """``building_id, a, b, c, d``: the last height models of ``fit``, of all buildings of a batch at once.

    A strength model matters here for its labels only, and bounds tell for nearly all buildings that it labels none; the others are fitted one by one.
    """
    bins, values, counts, width = strengths(observations)
    middle = median_of(values, counts)
    common = logistic.Condensed(values, counts)
    weak, ss_middle = logistic.Weak(common, counts, width), middle if np.isfinite(middle) else 20.0

    def fits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in groups(batches, AT_ONCE):
            ids, first, n = np.unique(rows["building_id"].to_numpy(), return_index=True, return_counts=True)
            h, s = rows["height"].to_numpy(float), rows["ss"].to_numpy(float)
            bin_at = np.searchsorted(bins, np.floor(s / width) if width else s)
            found = np.zeros((len(ids), 4))
            for some in alike(n):
                at = first[some][:, None] + np.arange(n[some].max())
                mine = at < (first[some] + n[some])[:, None]
                at = np.where(mine, at, 0)
                height, ss = np.where(mine, h[at], np.nan), np.where(mine, s[at], np.nan)
                strongest = np.where(np.isnan(ss), -1, bin_at[at]).max(axis=1)
                starts = np.tile((0.8, 0.1, 0.0, 0.2), (len(some), 1))
                starts[:, 2] = np.nanmedian(height, axis=1)
                found[some], sure = logistic.bootstrap_heights(height, ss, n[some], strongest, weak, starts, ss_middle, iterations)
                for i in some[~sure]:
                    z, own = h[first[i] : first[i] + n[i]], s[first[i] : first[i] + n[i]]
                    start = np.array([0.8, 0.1, np.nanmedian(z), 0.2])
                    taken = values[bin_at[first[i] : first[i] + n[i]][~np.isnan(own)]]
                    found[i] = logistic.bootstrap(z, own, None, iterations, common=common, taken=taken, height_start=start, ss_middle=ss_middle)[-1][1]
            yield pd.DataFrame({"building_id": ids} | dict(zip("abcd", found.T)))

    pairs = prepare(observations, buildings, cell)
    # a fit costs far more than its rows weigh, and many at once far less than one by one: a few tasks for each core, and more where there are more rays
    tasks = max(2 * pairs.sparkSession.sparkContext.defaultParallelism, int(counts.sum()) // 100_000)
    dealt = pairs.repartition(tasks, "building_id").sortWithinPartitions("building_id", "obs_id").select("building_id", "height", "ss")
    return dealt.mapInPandas(fits, "building_id bigint, a double, b double, c double, d double")


def alike(n: np.ndarray) -> Iterator[np.ndarray]:
    """Places of buildings in runs of like numbers of rows, which pad little and stay below PLACES."""
    order = np.argsort(n, kind="stable")
    while len(order):
        size = n[order]
        take = max(1, int(np.searchsorted((size > np.maximum(16, 2 * size[0])) | (size * np.arange(1, len(size) + 1) > PLACES), True)))
        yield order[:take]
        order = order[take:]


def predict(buildings: DataFrame, observations: DataFrame, iterations: int = 4, online: bool = False, cell: float = CELL) -> DataFrame:
    """``building_id, lower_bound, mid_point, upper_bound`` of every building; NULL for those that no ray crosses."""
    observations = once(observations.select("obs_id", "r", "s", "Cn0DbHz"))
    if online or not iterations:
        params = fit(observations, buildings, iterations, online, cell).filter("model = 'height'")
        last = params.groupBy("building_id").agg(F.max_by(F.struct("b", "c"), "step").alias("p"))
    else:
        last = last_heights(observations, buildings, iterations, cell).select("building_id", F.struct("b", "c").alias("p"))
    bounds = height_bounds(F.col("p.b"), F.col("p.c"))
    return buildings.select("building_id").join(last, "building_id", "left").select("building_id", *[c.alias(k) for k, c in bounds.items()])


def fit_edge(pairs: DataFrame, start: tuple[float, ...] = (40.0, 0.1, 40.0, 10.0)) -> DataFrame:
    """Bounds by a least-squares curve of strength on height, for each building of (building_id, height, ss)."""

    def per_building(group: pd.DataFrame) -> pd.DataFrame:
        p = logistic.fit_offline(group["height"].to_numpy(float), group["ss"].to_numpy(float), np.array(start), likelihood=False)
        return pd.DataFrame({"building_id": group["building_id"].iloc[:1].array, "a": [p[0]], "b": [p[1]], "c": [p[2]], "d": [p[3]]})

    fitted = pairs.groupBy("building_id").applyInPandas(per_building, "building_id bigint, a double, b double, c double, d double")
    return fitted.select("building_id", *[c.alias(k) for k, c in height_bounds(F.col("b"), F.col("c")).items()])


def share_by_bin(rows: DataFrame, value: Column, hit: Column, width: float) -> DataFrame:
    """(bin, n, hits, share): how many rows have ``hit`` in each bin of ``value``; bins are closed on the right, so bin k holds k * width < value <= (k + 1) * width."""
    binned = rows.filter(value.isNotNull() & ~F.isnan(value)).groupBy((F.ceil(value / F.lit(float(width))) - 1).cast("long").alias("bin"))
    return binned.agg(F.count("*").alias("n"), F.count_if(hit).alias("hits")).withColumn("share", F.col("hits") / F.col("n"))
