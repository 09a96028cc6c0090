"""Column formulas as SQL text, the same in Spark and in the oracle: pass them to F.expr.

All literals are written as doubles.
"""

from __future__ import annotations

#: Metres: the mean Earth radius of position reports, and the one of route reports.
EARTH_M, EARTH_ROUTE_M = 6371008.8, 6371000.0
KNOT_MS = 1852.0 / 3600.0
#: Knots per metre a second, as position reports are converted (fixed value).
MS_KNOT_AIS = 1 / 0.514444
YEAR_S = 365.25 * 86400.0


def num(x: float) -> str:
    """A double literal."""
    s = repr(float(x))
    return s if "e" in s else s + "e0"


def haversine(lon1: str, lat1: str, lon2: str, lat2: str, radius: float = EARTH_M) -> str:
    """Great-circle distance in metres between two points in degrees."""
    h = f"(pow(sin(radians(({lat2}) - ({lat1})) / 2e0), 2e0) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians(({lon2}) - ({lon1})) / 2e0), 2e0))"
    return f"(2e0 * {num(radius)} * asin(sqrt(least(1e0, greatest(0e0, {h})))))"


def modulo(x: str, m: float) -> str:
    """x modulo m in [0, m)."""
    return f"(({x}) - {num(m)} * floor(({x}) / {num(m)}))"


def bearing(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """Initial great-circle bearing in degrees, clockwise from north, in [0, 360)."""
    d = f"radians(({lon2}) - ({lon1}))"
    y = f"sin({d}) * cos(radians({lat2}))"
    x = f"cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos({d})"
    return modulo(f"degrees(atan2({y}, {x})) + 360e0", 360)


def outward(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """Flat bearing in degrees from the first to the second point, in [0, 360)."""
    return modulo(f"degrees(atan2(({lon2}) - ({lon1}), ({lat2}) - ({lat1}))) + 360e0", 360)


def turn(a: str, b: str) -> str:
    """Smallest angle between two directions, in [0, 180]."""
    return f"(180e0 - abs(180e0 - {modulo(f'abs(({a}) - ({b}))', 360)}))"


def destination_lat(lat: str, azimuth: str, metres: str, radius: float = EARTH_M) -> str:
    """Latitude reached from a point along an azimuth."""
    d = f"(({metres}) / {num(radius)})"
    return f"degrees(asin(sin(radians({lat})) * cos({d}) + cos(radians({lat})) * sin({d}) * cos(radians({azimuth}))))"


def destination_lon(lon: str, lat: str, azimuth: str, metres: str, radius: float = EARTH_M) -> str:
    """Longitude reached from a point along an azimuth."""
    d = f"(({metres}) / {num(radius)})"
    to = f"radians({destination_lat(lat, azimuth, metres, radius)})"
    return f"(({lon}) + degrees(atan2(sin(radians({azimuth})) * sin({d}) * cos(radians({lat})), cos({d}) - sin(radians({lat})) * sin({to}))))"


#: Coefficients of the rational form of the normal integral in Hart (1968) as given by West (2005); fixed values.
_UP = (220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383, 6.37396220353165, 0.700383064443688, 3.52624965998911e-02)
_LOW = (440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674, 86.7807322029461, 16.064177579207, 1.75566716318264, 8.83883476483184e-02)


def phi(x: str) -> str:
    """Distribution function of the standard normal, in double precision."""
    a = f"abs({x})"
    horner = lambda cs: "".join("(" for _ in cs[1:]) + num(cs[-1]) + "".join(f" * {a} + {num(c)})" for c in reversed(cs[:-1]))
    tail = f"(CASE WHEN {a} > 37e0 THEN 0e0 WHEN {a} < 7.07106781186547e0 THEN exp(-{a} * {a} / 2e0) * {horner(_UP)} / {horner(_LOW)} ELSE exp(-{a} * {a} / 2e0) / ({a} + 1e0 / ({a} + 2e0 / ({a} + 3e0 / ({a} + 4e0 / ({a} + 0.65e0))))) / 2.506628274631e0 END)"
    return f"(CASE WHEN ({x}) > 0e0 THEN 1e0 - {tail} ELSE {tail} END)"


def not_repaired(kind: str, tau: str, shape: float, loc: float, scale: float) -> str:
    """Probability that a repair takes longer than tau hours; certain for tau <= 0 or no scale."""
    if scale <= 0:
        return "1e0"
    z = f"((({tau}) - {num(loc)}) / {num(scale)})"
    body = {
        "lognormal": f"(CASE WHEN {z} <= 0e0 THEN 1e0 ELSE 1e0 - {phi(f'ln(greatest({z}, 1e-300)) / {num(shape)}')} END)",
        "normal": f"(1e0 - {phi(z)})",
        "weibull": f"(CASE WHEN {z} <= 0e0 THEN 1e0 ELSE exp(-pow(greatest({z}, 0e0), {num(shape)})) END)",
    }[kind]
    return f"(CASE WHEN ({tau}) <= 0e0 THEN 1e0 ELSE {body} END)"


def overlap(mu: str, sigma: str, width: str) -> str:
    """Chance that a normal lateral distance is within +-width; with no spread, whether the mean is."""
    z = lambda s: phi(f"(({mu}) {s} ({width})) / greatest({sigma}, 1e-12)")
    return f"(CASE WHEN ({sigma}) <= 0e0 THEN (CASE WHEN abs({mu}) <= ({width}) THEN 1e0 ELSE 0e0 END) ELSE {z('+')} - {z('-')} END)"
