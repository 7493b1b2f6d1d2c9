"""Column expressions for numbers, time bases, geometry and score vectors."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DATENUM_UNIX_EPOCH = 719529  # datenum day of 1970-01-01
# WGS-84 ellipsoid.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
# Fixed values: (longitude, latitude, elevation m) of the glide-slope aim, localizer aim and approach start.
GLIDESLOPE_ORIGIN = (-71.2964, 42.4715, 37.4)
LOCALIZER_ORIGIN = (-71.26841, 42.46887, 37.4)
APPROACH_START = (-71.5843, 42.4976, 1314.0)


def finite(c: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def to_number(c: Column) -> Column:
    return finite(c.try_cast("double"))


def datenum_to_micros(c: Column) -> Column:
    return F.round((c - DATENUM_UNIX_EPOCH) * 86400e6).cast("long")


def datenum_to_ts(c: Column) -> Column:
    return F.timestamp_micros(datenum_to_micros(c))


def ts_to_datenum(ts: Column) -> Column:
    return F.unix_micros(ts) / 86400e6 + DATENUM_UNIX_EPOCH


def bound(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def rounded_class(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(3), F.rint(c).cast("int") - 1))


def row_mean(cols: Sequence[Column]) -> Column:
    """Mean of the non-NULL columns of a row."""
    present = F.array_compact(F.array(*cols))
    total = F.aggregate(present, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(present) > 0, total / F.size(present))


def softmax(scores: Column, temperature: float = 1.0, classes: int = 4) -> list[Column]:
    """Class shares from a score array; written out per class so it stays in generated code."""
    each = [F.get(scores, F.lit(i)) for i in range(classes)]
    top = F.greatest(*each)
    e = [F.exp((s - top) / temperature) for s in each]
    total = e[0]
    for x in e[1:]:
        total = total + x
    return [x / total for x in e]


def softmax_expectation(scores: Column, temperature: float = 1.0, classes: int = 4) -> Column:
    """Expected level sum(p_i * i), levels counted from 1."""
    shares = softmax(scores, temperature, classes)
    out = shares[0]
    for i, p in enumerate(shares[1:], start=2):
        out = out + p * i
    return out


def argmax_low(scores: Column) -> Column:
    """Index of the largest score; equal scores go to the lowest index."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def margin(scores: Column) -> Column:
    ordered = F.sort_array(scores, asc=False)
    return F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1))


def margin_and_runner_up(scores: Column, label: Column) -> Column:
    """struct(margin of the true class over the best other class, index of that class)."""
    others = F.transform(scores, lambda s, i: F.when(i == label, F.lit(float("-inf"))).otherwise(s))
    return F.struct(
        (F.get(scores, label) - F.array_max(others)).alias("margin"), argmax_low(others).alias("runner_up")
    )


def gaze_2d(x: Column, y: Column, z: Column) -> Column:
    """Screen position of a 3-D gaze direction."""
    def slope_degrees(a: Column, b: Column) -> Column:
        upright = F.when(a != 0, F.signum(a) * 90.0)  # a/0 is a right angle, 0/0 unknown
        return F.when(b == 0, upright).otherwise(F.degrees(F.atan(F.try_divide(a, b))))

    theta = slope_degrees(y, x)
    theta = F.when(theta < 0, theta + 180).otherwise(theta)
    phi = slope_degrees(y, z)
    phi = F.when(phi < 0, phi + 180).otherwise(phi)
    phi = F.when(phi > 90, phi - 180).otherwise(phi)
    return F.struct((1440 * ((theta - 90) / 90)).alias("gaze_x"), (1600 * phi / 90).alias("gaze_y"))


def _ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    e2 = WGS84_F * (2 - WGS84_F)
    sin_lat, cos_lat = F.sin(F.radians(lat)), F.cos(F.radians(lat))
    n = WGS84_A / F.sqrt(1 - e2 * sin_lat * sin_lat)
    return (
        (n + alt) * cos_lat * F.cos(F.radians(lon)),
        (n + alt) * cos_lat * F.sin(F.radians(lon)),
        (n * (1 - e2) + alt) * sin_lat,
    )


def geodetic_ned(lat: Column, lon: Column, alt: Column, origin: tuple[float, float, float]) -> Column:
    """struct(north, east, down) in metres from ``origin`` = (lon, lat, elevation)."""
    lon0, lat0, alt0 = origin
    x, y, z = _ecef(lat, lon, alt)
    x0, y0, z0 = _ecef(F.lit(lat0), F.lit(lon0), F.lit(alt0))
    dx, dy, dz = x - x0, y - y0, z - z0
    sl, cl = math.sin(math.radians(lat0)), math.cos(math.radians(lat0))
    so, co = math.sin(math.radians(lon0)), math.cos(math.radians(lon0))
    return F.struct(
        (-sl * co * dx - sl * so * dy + cl * dz).alias("north"),
        (-so * dx + co * dy).alias("east"),
        (-(cl * co * dx + cl * so * dy + sl * dz)).alias("down"),
    )


def approach_errors(lat: Column, lon: Column, alt: Column, localizer_deflection: Column, airspeed: Column) -> Column:
    """struct of glide-slope, localizer and airspeed errors, each clamped to [-3, 3]."""
    g = geodetic_ned(lat, lon, alt, GLIDESLOPE_ORIGIN)
    distance = F.sqrt(g["north"] ** 2 + g["east"] ** 2 + g["down"] ** 2)
    glideslope = -3 * (F.degrees(F.asin(F.try_divide(g["down"], distance))) + 3)
    loc = geodetic_ned(lat, lon, alt, LOCALIZER_ORIGIN)
    start = geodetic_ned(
        F.lit(APPROACH_START[1]), F.lit(APPROACH_START[0]), F.lit(LOCALIZER_ORIGIN[2]), LOCALIZER_ORIGIN
    )
    dot = loc["north"] * start["north"] + loc["east"] * start["east"]
    norms = F.sqrt(loc["north"] ** 2 + loc["east"] ** 2) * F.sqrt(start["north"] ** 2 + start["east"] ** 2)
    localizer = F.degrees(F.acos(bound(F.try_divide(dot, norms), -1.0, 1.0))) * F.signum(localizer_deflection)
    past = lon > LOCALIZER_ORIGIN[0]
    return F.struct(
        F.when(past, 3.0).otherwise(bound(glideslope, -3.0, 3.0)).alias("glideslope_error"),
        F.when(past, 3.0).otherwise(bound(localizer, -3.0, 3.0)).alias("localizer_error"),
        bound((airspeed - 115) / 10, -3.0, 3.0).alias("airspeed_error"),
    )
