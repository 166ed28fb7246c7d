"""Sessions by time and place."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwise.functions import constants as K
from shelfwise.functions.vectors import epoch_us, haversine_km

ROLL_SCHEMA = "library_id string, session long, members array<long>, start_at timestamp_ntz, end_at timestamp_ntz, n long, lat double, lon double"


def by_gap(assets: DataFrame, gap_s: int = K.ROLL_GAP_S) -> DataFrame:
    """Adds ``session``, a running number in each library; a gap of exactly ``gap_s`` continues.

    Rows are ordered within days of a library only; days are stitched together by their last times and their
    counts of sessions, so a library with a large share of all rows is many tasks. A missing date starts a
    session of its own.
    """
    at = epoch_us(F.col("creation_date"))
    rows = assets.withColumn("at_", at).withColumn("day_", F.coalesce(F.floor(F.col("at_") / 86_400_000_000), F.lit(-1_000_000)))
    days = Window.partitionBy("library_id").orderBy("day_")
    last = rows.groupBy("library_id", "day_").agg(F.max("at_").alias("last_")).withColumn("last_", F.lag("last_").over(days))
    w = Window.partitionBy("library_id", "day_").orderBy("creation_date", "asset_id")
    rows = rows.join(last, ["library_id", "day_"]).withColumn("before_", F.when(F.row_number().over(w) == 1, F.col("last_")).otherwise(F.lag("at_").over(w)))
    rows = rows.withColumn("new_", F.when(F.col("at_") - F.col("before_") <= gap_s * 1_000_000, 0).otherwise(1))
    starts = rows.groupBy("library_id", "day_").agg(F.sum("new_").alias("n_")).select("library_id", "day_", F.coalesce(F.sum("n_").over(days.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset_"))
    rows = rows.withColumn("k_", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0))).join(starts, ["library_id", "day_"])
    return rows.select(*[F.col(c) for c in assets.columns], (F.col("offset_") + F.col("k_")).alias("session"))


def haversine(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    h = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def split_rolls(rows: list[tuple], gap_s: float = K.ROLL_GAP_S, km: float = K.ROLL_KM) -> Iterator[tuple[list, float | None, float | None]]:
    """(members, mean latitude, mean longitude) of rolls over (id, seconds, lat, lon) in order of time."""
    members: list = []
    last = slat = slon = 0.0
    count = 0
    for row in rows:
        _, at, lat, lon = row
        if members:
            near = lat is None or not count or haversine(slat / count, slon / count, lat, lon) <= km
            if at - last > gap_s or not near:
                yield members, slat / count if count else None, slon / count if count else None
                members, slat, slon, count = [], 0.0, 0.0, 0
        members.append(row)
        last = at
        if lat is not None:
            slat, slon, count = slat + lat, slon + lon, count + 1
    if members:
        yield members, slat / count if count else None, slon / count if count else None


def event_rolls(images: DataFrame, least: int = K.ROLL_ITEMS, span_s: float = K.ROLL_SPAN_S) -> DataFrame:
    """Rolls of pictures close in time and place, with at least ``least`` members over ``span_s`` seconds.

    The fold over the running centroid depends on order, so each time session (which a gap always starts) is
    one group; sessions bound what a task holds.
    """

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by([("creation_date", "ascending"), ("asset_id", "ascending")])
        at = [x / 1e6 for x in table.column("creation_date").cast(pa.int64()).to_pylist()]
        rows = list(zip(table.column("asset_id").to_pylist(), at, table.column("latitude").to_pylist(), table.column("longitude").to_pylist(), strict=True))
        out = [r for r in split_rolls(rows) if len(r[0]) >= least and r[0][-1][1] - r[0][0][1] >= span_s]
        us = pa.timestamp("us")
        return pa.table(
            {
                "library_id": pa.array([table.column("library_id")[0].as_py()] * len(out), pa.string()), "session": pa.array([table.column("session")[0].as_py()] * len(out), pa.int64()),
                "members": pa.array([[m[0] for m in r[0]] for r in out], pa.list_(pa.int64())), "start_at": pa.array([round(r[0][0][1] * 1e6) for r in out], pa.int64()).cast(us), "end_at": pa.array([round(r[0][-1][1] * 1e6) for r in out], pa.int64()).cast(us),
                "n": pa.array([len(r[0]) for r in out], pa.int64()), "lat": pa.array([None if r[1] is None else round(r[1], 6) for r in out], pa.float64()), "lon": pa.array([None if r[2] is None else round(r[2], 6) for r in out], pa.float64()),
            }
        )

    rows = by_gap(images.select("library_id", "asset_id", "creation_date", "latitude", "longitude"))
    return rows.groupBy("library_id", "session").applyInArrow(fold, ROLL_SCHEMA)


def nearest_place(points: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """The nearest place within a degree's cells; points without coordinates or neighbours get none."""
    step = F.array(*[F.lit(x) for x in (-1, 0, 1)])
    cells = places.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).select("place_id", "locality", "country", F.col("lat").alias("plat"), F.col("lon").alias("plon"), (F.floor("lat") + F.col("dx")).alias("cy"), (F.floor("lon") + F.col("dy")).alias("cx"))
    near = points.withColumn("cy", F.floor("lat")).withColumn("cx", F.floor("lon")).join(cells, ["cy", "cx"])
    far = F.round(haversine_km(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon")), 6)
    name = F.nullif(F.concat_ws(", ", "locality", "country"), F.lit(""))
    return near.groupBy(*keys).agg(F.min_by(name, F.struct(far, "place_id")).alias("place"))


class Fold:
    """:func:`split_rolls` over rows that come in order, a part at a time: of what is behind it holds the open roll's ids only."""

    def __init__(self, ids: bytes = b"", first: float = 0.0, last: float = 0.0, lat: float = 0.0, lon: float = 0.0, count: int = 0):
        self.pieces, self.first, self.last, self.lat, self.lon, self.count = [np.frombuffer(ids, np.int64)] if ids else [], first, last, lat, lon, count

    def state(self) -> tuple:
        return b"".join(p.tobytes() for p in self.pieces), self.first, self.last, self.lat, self.lon, self.count

    def add(self, ids: np.ndarray, at: np.ndarray, lat: np.ndarray, lon: np.ndarray, gap_s: float = K.ROLL_GAP_S, km: float = K.ROLL_KM) -> Iterator[tuple]:
        """(members, first, last, mean latitude, mean longitude) of the rolls that these rows end."""
        for lo in range(0, len(ids), 1 << 16):
            part, start = ids[lo : lo + (1 << 16)], 0
            for k, (t, y, x) in enumerate(zip(*(c[lo : lo + (1 << 16)].tolist() for c in (at, lat, lon)), strict=True)):
                nowhere = y != y
                if self.pieces or k > start:
                    near = nowhere or not self.count or haversine(self.lat / self.count, self.lon / self.count, y, x) <= km
                    if t - self.last > gap_s or not near:
                        self.pieces.append(part[start:k])
                        yield self.end()
                        start = k
                if not self.pieces and k == start:
                    self.first = t
                self.last = t
                if not nowhere:
                    self.lat, self.lon, self.count = self.lat + y, self.lon + x, self.count + 1
            self.pieces.append(part[start:])

    def end(self) -> tuple:
        """The open roll, which ends."""
        mean = (self.lat / self.count, self.lon / self.count) if self.count else (None, None)
        out = (np.concatenate(self.pieces), self.first, self.last, *mean)
        self.pieces, self.lat, self.lon, self.count = [], 0.0, 0.0, 0
        return out


def parted(frame: pd.DataFrame) -> list[np.ndarray]:
    """Ids, seconds, latitudes and longitudes of a pandas frame, unknown places as NaN; rows without an id only move the time on."""
    frame = frame[frame.asset_id.notna()]
    return [frame.asset_id.to_numpy(np.int64), *(frame[c].to_numpy(np.float64, na_value=np.nan) for c in ("seconds", "latitude", "longitude"))]
