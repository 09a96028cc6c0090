"""Position reports as streams: incremental ingest, online track splitting, and daily traffic counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fairway.functions import expr as X

SPLIT = "mmsi long, t timestamp, lon double, lat double, sog double, is_break int, sub_id long"
LAST = "t_s double, lon double, lat double, sog double, sub_id long"


def one_per_time(reports: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first report of a vessel and time that comes; those later than the delay are dropped with their state."""
    return reports.withWatermark("t", delay).dropDuplicatesWithinWatermark(["mmsi", "t"])


def split(reports: DataFrame, max_gap_s: float = 3600.0, speed_tolerance: float = 0.3, speed_floor_kn: float = 1.0) -> DataFrame:
    """Reports with is_break and sub_id, by the rule of the batch splitter; a vessel's last report is its state.

    A report not after the vessel's last one is dropped.
    """
    import math

    def metres(lon1, lat1, lon2, lat2) -> float:
        a, b = math.radians(lat1), math.radians(lat2)
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
        return 2 * X.EARTH_M * math.asin(math.sqrt(min(1.0, max(0.0, h))))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values("t", kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            t = r.t.timestamp()
            if last is not None:
                dt = t - last[0]
                if dt <= 0:
                    continue
                speed = metres(last[1], last[2], r.lon, r.lat) / dt * X.MS_KNOT_AIS
                cut = int(dt > max_gap_s or speed > (r.sog + last[3]) / 2 * (1 + speed_tolerance) + speed_floor_kn)
                sub = last[4] + cut
            else:
                cut, sub = 0, 0
            last = (t, float(r.lon), float(r.lat), float(r.sog), int(sub))
            out.append((key[0], r.t, r.lon, r.lat, r.sog, cut, sub))
        if last is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=["mmsi", "t", "lon", "lat", "sog", "is_break", "sub_id"])

    return reports.select("mmsi", "t", "lon", "lat", "sog").groupBy("mmsi").applyInPandasWithState(run, SPLIT, LAST, "append", GroupStateTimeout.NoTimeout)


def changes(states: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (mmsi, t, *columns) of a vessel whose values differ from those before."""
    fields = ", ".join(f"{c} string" for c in columns)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = tuple(state.get) if state.exists else None
        out = []
        for r in pd.concat(list(frames)).sort_values("t", kind="stable").itertuples(index=False):
            now = tuple(None if pd.isna(getattr(r, c)) else str(getattr(r, c)) for c in columns)
            if now != last:
                out.append((key[0], r.t, *now))
                last = now
        state.update(last)
        yield pd.DataFrame(out, columns=["mmsi", "t", *columns])

    rows = states.select("mmsi", "t", *[F.col(c).cast("string").alias(c) for c in columns])
    return rows.groupBy("mmsi").applyInPandasWithState(run, f"mmsi long, t timestamp, {fields}", fields, "append", GroupStateTimeout.NoTimeout)


def daily_counts(passages: DataFrame, delay: str = "1 day") -> DataFrame:
    """Passages per day, leg, direction, type and size; a day comes out once it is over by the delay."""
    keys = [c for c in ("leg_id", "dir_idx", "ship_type", "size_bin") if c in passages.columns]
    return passages.withWatermark("t", delay).groupBy(F.window("t", "1 day"), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), *keys, "n")
