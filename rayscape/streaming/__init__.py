"""The same operators on streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rayscape.functions.time import timestamp
from rayscape.operators import logistic
from rayscape.operators.features import process_raw
from rayscape.schemas import RAW


def read_features(spark: SparkSession, path: str, names: list[str], files_per_trigger: int = 100) -> DataFrame:
    """Measurements from Raw lines of logs that arrive in a folder; ``names`` are the fields of their heading, which all logs share."""
    text = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).filter(F.col("value").startswith("Raw,"))
    fields = F.split(F.regexp_replace("value", r"[ \r]", ""), ",")
    place = {n: i + 1 for i, n in enumerate(names)}

    def field(name, to):
        if name not in place:
            return F.lit(None).cast(to)
        return F.nullif(F.nullif(F.get(fields, F.lit(place[name])), F.lit("")), F.lit("NaN")).try_cast(to)

    rows = text.select(*[field(f.name, f.dataType).alias(f.name) for f in RAW])
    features = process_raw(rows)
    return features.withColumn("time", timestamp(F.col("time_ns")))


def asof_candidates(left: DataFrame, right: DataFrame, left_time: str, right_time: str, tolerance_ms: int, late: str = "2 seconds") -> DataFrame:
    """Pairs of rows of two streams whose timestamps lie within the tolerance; watermarks bound what is kept of either.

    The nearest of a left row's pairs can be taken downstream, in each batch or table.
    """
    a, b = left.withWatermark(left_time, late), right.withWatermark(right_time, late)
    near = F.expr(f"{right_time} between {left_time} - interval {tolerance_ms} milliseconds and {left_time} + interval {tolerance_ms} milliseconds")
    return a.join(b, near & (a["log_id"] == b["right_log_id"]) if "right_log_id" in right.columns else near)


def windowed_strength(observations: DataFrame, time: str = "time", width: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """Count and mean signal strength per satellite and time window; late rows are dropped by the watermark."""
    return observations.withWatermark(time, late).groupBy(F.window(time, width), "svid").agg(F.count("*").alias("n"), F.avg("Cn0DbHz").alias("mean_cn0"))


ONLINE = "building_id bigint, n bigint, model string, a double, b double, c double, d double"
_STATE = "n bigint, strength array<double>, height array<double>"


def fit_online(pairs: DataFrame, rate: tuple = (0.001, 0.001, 0.1, 0.001), start: tuple = logistic.START) -> DataFrame:
    """Parameters of each building, updated by every micro-batch of (building_id, obs_id, time_ns, height, ss).

    State is two sets of four parameters a building. Rows of a batch are taken in order of (time_ns, obs_id); each batch gives one
    row for each model, so the output is the true history.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, a, b = state.get if state.exists else (0, list(start), list(start))
        a, b = np.array(a, float), np.array(b, float)
        rows = pd.concat(list(frames)).sort_values(["time_ns", "obs_id"])
        h, s = rows["height"].to_numpy(float), rows["ss"].to_numpy(float)
        label = logistic.predict(a, s)
        known = ~np.isnan(h)
        if known.any():
            b = logistic.step(b, h[known], label[known], np.array(rate))
        label = np.where(np.isnan(h), 0.0, (np.nan_to_num(h) > b[2]).astype(float))
        heard = ~np.isnan(s)
        if heard.any():
            a = logistic.step(a, s[heard], label[heard], np.array(rate))
        n += len(rows)
        state.update((n, a.tolist(), b.tolist()))
        yield pd.DataFrame([(key[0], n, m, *map(float, p)) for m, p in (("strength", a), ("height", b))], columns=["building_id", "n", "model", "a", "b", "c", "d"])

    return pairs.groupBy("building_id").applyInPandasWithState(update, ONLINE, _STATE, "append", GroupStateTimeout.NoTimeout)
