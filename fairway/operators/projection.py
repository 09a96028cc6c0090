"""Transverse Mercator: places of each scenario in metres of the UTM zone of its centroid, and back.

Krüger's series to the fourth order in the third flattening; there and back agree to far less than a millimetre.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairway.functions.expr import num

#: The WGS 84 ellipsoid, the scale on the central meridian and the false origin (fixed values).
AXIS_M, FLATTENING, SCALE, EAST_M, SOUTH_M = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = AXIS_M / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)


def forward(lon: str, lat: str, zone: str, south: str) -> tuple[str, str]:
    """SQL of easting and northing of a place in degrees."""
    e = num(2 * _N**0.5 / (1 + _N))
    s, d = f"sin(radians({lat}))", f"radians(({lon}) - (({zone}) * 6e0 - 183e0))"
    t = f"sinh(atanh({s}) - {e} * atanh({e} * {s}))"
    xi, eta = f"atan2({t}, cos({d}))", f"atanh(sin({d}) / sqrt(1e0 + {t} * {t}))"
    x = " + ".join([eta, *(f"{num(a)} * cos({num(2 * j)} * {xi}) * sinh({num(2 * j)} * {eta})" for j, a in enumerate(_ALPHA, 1))])
    y = " + ".join([xi, *(f"{num(a)} * sin({num(2 * j)} * {xi}) * cosh({num(2 * j)} * {eta})" for j, a in enumerate(_ALPHA, 1))])
    return f"({num(EAST_M)} + {num(SCALE * _RADIUS)} * ({x}))", f"(CASE WHEN {south} THEN {num(SOUTH_M)} ELSE 0e0 END + {num(SCALE * _RADIUS)} * ({y}))"


def backward(x: str, y: str, zone: str, south: str) -> tuple[str, str]:
    """SQL of longitude and latitude of a place in metres."""
    v, u = f"((({x}) - {num(EAST_M)}) / {num(SCALE * _RADIUS)})", f"((({y}) - CASE WHEN {south} THEN {num(SOUTH_M)} ELSE 0e0 END) / {num(SCALE * _RADIUS)})"
    eta = "(" + " - ".join([v, *(f"{num(b)} * cos({num(2 * j)} * {u}) * sinh({num(2 * j)} * {v})" for j, b in enumerate(_BETA, 1))]) + ")"
    xi = "(" + " - ".join([u, *(f"{num(b)} * sin({num(2 * j)} * {u}) * cosh({num(2 * j)} * {v})" for j, b in enumerate(_BETA, 1))]) + ")"
    chi = f"asin(sin({xi}) / cosh({eta}))"
    lat = " + ".join([chi, *(f"{num(d)} * sin({num(2 * j)} * {chi})" for j, d in enumerate(_DELTA, 1))])
    return f"(({zone}) * 6e0 - 183e0 + degrees(atan2(sinh({eta}), cos({xi}))))", f"degrees({lat})"


def zones(places: DataFrame) -> DataFrame:
    """scenario_id, zone, south: the UTM zone of the mean of all places (scenario_id, lon, lat) of a scenario."""
    mean = places.groupBy("scenario_id").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    return mean.select("scenario_id", (F.floor((F.col("lon") + 180.0) / 6.0) + 1).cast("int").alias("zone"), (F.col("lat") < 0).alias("south"))


def to_metres(df: DataFrame, zones: DataFrame, **points: tuple[str, str]) -> DataFrame:
    """Adds name_x, name_y in the scenario's zone for each name = (lon column, lat column); feeds corridors, rays and cascade."""
    out = df.join(zones, "scenario_id")
    for name, (lon, lat) in points.items():
        x, y = forward(lon, lat, "zone", "south")
        out = out.withColumn(f"{name}_x", F.expr(x)).withColumn(f"{name}_y", F.expr(y))
    return out.drop("zone", "south")


def to_degrees(df: DataFrame, zones: DataFrame, **points: tuple[str, str]) -> DataFrame:
    """Adds name_lon, name_lat for each name = (x column, y column)."""
    out = df.join(zones, "scenario_id")
    for name, (x, y) in points.items():
        lon, lat = backward(x, y, "zone", "south")
        out = out.withColumn(f"{name}_lon", F.expr(lon)).withColumn(f"{name}_lat", F.expr(lat))
    return out.drop("zone", "south")
