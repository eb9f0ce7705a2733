"""Scalar geography as columns: projection, distances, wrapping, easing, number texts."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
CUTOFF = 85.0
_MERC_CUTOFF = math.degrees(math.asinh(math.tan(math.radians(CUTOFF))))
_SCALE = 180.0 / (_MERC_CUTOFF + (90.0 - CUTOFF))


def mercator(lat: Column) -> Column:
    """Latitude to map y: Mercator up to 85 degrees, linear beyond, 90 becomes 180; input is clamped."""
    x = F.least(F.greatest(lat, F.lit(-90.0)), F.lit(90.0))
    middle = F.degrees(F.asinh(F.tan(F.radians(x))))
    outer = F.signum(x) * (F.lit(_MERC_CUTOFF) + F.abs(x) - CUTOFF)
    return F.when(F.abs(x) <= CUTOFF, middle).otherwise(outer) * _SCALE


def inverse_mercator(y: Column) -> Column:
    m = F.least(F.greatest(y, F.lit(-180.0)), F.lit(180.0)) / _SCALE
    middle = F.degrees(F.atan(F.sinh(F.radians(m))))
    outer = F.signum(m) * (F.abs(m) - _MERC_CUTOFF + CUTOFF)
    return F.when(F.abs(m) <= _MERC_CUTOFF, middle).otherwise(outer)


def grouping_xy(lng: Column, lat: Column) -> tuple[Column, Column]:
    """Web Mercator on a world of 100 by 100."""
    half = 50.0 / math.pi
    y = half * (math.pi - F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)))
    return half * (F.radians(lng) + math.pi), y


def wrap_lng(x: Column) -> Column:
    """Longitude into -180..180 by whole turns; both ends stay."""
    return F.when(x > 180, x - 360 * F.ceil((x - 180) / 360)).when(x < -180, x + 360 * F.ceil((-180 - x) / 360)).otherwise(x)


def haversine_m(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))  # least() would skip a null


def metres_to_degrees(metres: Column, lat: Column) -> Column:
    """Half a width in degrees of longitude at a latitude."""
    phi = F.radians(lat)
    return metres * ((1 + 0.00001120378 * (F.cos(2 * phi) - 1)) / F.cos(phi) / 111319.491 / 2)


def planar_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def angle_of_three(x1: Column, y1: Column, x2: Column, y2: Column, x3: Column, y3: Column) -> Column:
    """Angle at the middle point in degrees, 0 to 180."""
    turn = F.abs(F.degrees(F.atan2(y3 - y2, x3 - x2) - F.atan2(y1 - y2, x1 - x2)))
    return F.when(turn > 180, 360 - turn).otherwise(turn)


def cosine_ease(x: Column, stops: list[tuple[float, float]]) -> Column:
    """Piecewise value between stops (position, value), eased by a cosine; null outside them."""
    out = F.lit(None).cast("double")
    for (x0, v0), (x1, v1) in reversed(list(zip(stops, stops[1:]))):
        t = (x - x0) / (x1 - x0)
        out = F.when((x >= x0) & (x <= x1), v0 + (v1 - v0) * (1 - F.cos(math.pi * t)) / 2).otherwise(out)
    return out


def continuous_lng(lngs: Column) -> Column:
    """Array of longitudes shifted by whole turns so that no step is over 180 degrees."""
    step = lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(copy_near(x, F.element_at(acc, -1)))))
    return F.aggregate(lngs, F.array().cast("array<double>"), step)


def copy_near(x: Column, to: Column) -> Column:
    """A longitude moved by whole turns to at most half a turn from another."""
    d = x - to
    return F.when(d > 180, x - 360 * F.ceil((d - 180) / 360)).when(d < -180, x + 360 * F.ceil((-d - 180) / 360)).otherwise(x)


def midpoint(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return (x1 + x2) / 2, (y1 + y2) / 2


def great_circle_midpoint(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> tuple[Column, Column]:
    turn, a, b = F.radians(lng2 - lng1), F.radians(lat1), F.radians(lat2)
    x, y = F.cos(b) * F.cos(turn), F.cos(b) * F.sin(turn)
    return lng1 + F.degrees(F.atan2(y, F.cos(a) + x)), F.degrees(F.atan2(F.sin(a) + F.sin(b), F.sqrt(F.pow(F.cos(a) + x, 2) + F.pow(y, 2))))


def rotated(x: Column, y: Column, degrees: Column) -> tuple[Column, Column]:
    t = F.radians(degrees)
    return x * F.cos(t) - y * F.sin(t), x * F.sin(t) + y * F.cos(t)


def unit_vector(x: Column, y: Column) -> tuple[Column, Column]:
    """Null for the zero vector."""
    size = F.nullif(F.sqrt(x * x + y * y), F.lit(0.0))
    return x / size, y / size


def box_centre(bbox: Column) -> tuple[Column, Column]:
    """Centre of a box of four numbers; two numbers are a point; null else."""
    at = lambda i, j: F.when(F.size(bbox) == 2, F.get(bbox, i)).when(F.size(bbox) == 4, (F.get(bbox, i) + F.get(bbox, j)) / 2)
    return at(0, 2), at(1, 3)


def distance_label(metres: Column, imperial: bool = False) -> Column:
    """Distance text: no decimals from 100 km, one from 10, two from 1, metres (or feet) below."""
    big = metres / 1000 * (0.621371 if imperial else 1.0)
    unit, small_unit, small = ("mi", "ft", metres * 3.28084) if imperial else ("km", "m", metres)
    text = lambda n, x, u: F.format_string(f"%.{n}f {u}", F.round(x, n))
    return F.when(big >= 100, text(0, big, unit)).when(big >= 10, text(1, big, unit)).when(big >= 1, text(2, big, unit)).otherwise(text(0, small, small_unit))


def position_text(lng: Column, lat: Column) -> Column:
    return F.format_string("%.7f, %.7f", lat, wrap_lng(lng))


def significant(x: Column, digits: int = 7) -> Column:
    """Half-up rounding to significant digits; 0 stays 0."""
    power = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * power) / power)


def ingest_lng(x: Column) -> Column:
    """Longitudes west of the working window go once round; 7 significant digits."""
    return significant(F.when(x < -138, x + 360).otherwise(x))


def zoom_of_area(area_km2: Column, lat: Column) -> Column:
    """Least zoom at which a label of this area shows."""
    return F.floor(F.log2(10000 / F.sqrt(area_km2 / F.cos(F.radians(lat))))).cast("int")


def label_angle(width: Column, height: Column, angle: Column) -> Column:
    """Text angle of an oriented box: flat for compact boxes and for less than 10 degrees."""
    a = F.round(angle - 90)
    return F.when((height / width < 1.5) | ((a > -10) & (a < 10)), F.lit(0.0)).otherwise(a)


def ring_area(xs: Column, ys: Column) -> Column:
    """Signed planar area of a ring given as arrays of coordinates."""
    n = F.size(xs)
    terms = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(xs, i) * F.element_at(ys, (i % n) + 1) - F.element_at(xs, (i % n) + 1) * F.element_at(ys, i))
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + t) / 2


def planar_area(coords: Column) -> Column:
    """Area of rings with the inside on their left: holes count negative."""
    cross = lambda r: F.aggregate(F.sequence(F.lit(1), F.size(r) - 1), F.lit(0.0), lambda a, i: a + r[i - 1][0] * r[i][1] - r[i][0] * r[i - 1][1]) / 2
    return F.aggregate(F.transform(F.flatten(coords), cross), F.lit(0.0), lambda a, x: a + x)


#: The ellipsoid of WGS 84: half of its greater axis in km, and its eccentricity.
AXIS_KM, ECCENTRICITY = 6378.137, 0.00669437999014**0.5
#: Places and weights of Gauss's rule on an edge from 0 to 1.
GAUSS = tuple(((x + 1) / 2, w / 2) for x, w in zip(*(v.tolist() for v in np.polynomial.legendre.leggauss(4))))


def zone(lat: Column) -> Column:
    """Twice the area between the equator and a latitude, for a radian of longitude and an axis of one: the authalic function of the ellipsoid."""
    e, s = ECCENTRICITY, F.sin(F.radians(lat))
    return (1 - e * e) * (s / (1 - (e * s) * (e * s)) + F.log((1 + e * s) / (1 - e * s)) / (2 * e))


def area_km2(coords: Column) -> Column:
    """Area on the ellipsoid of polygons whose edges are straight in longitude and latitude; null for null."""
    edge = lambda a, b: (b[0] - a[0]) * sum((w * zone(a[1] + t * (b[1] - a[1])) for t, w in GAUSS), F.lit(0.0))
    ring = lambda r: F.abs(F.aggregate(F.sequence(F.lit(1), F.size(r) - 1), F.lit(0.0), lambda total, i: total + edge(F.get(r, i - 1), F.get(r, i))))
    part = lambda rings: F.aggregate(F.transform(rings, lambda r, k: F.when(k == 0, ring(r)).otherwise(-ring(r))), F.lit(0.0), lambda total, x: total + x)
    whole = F.aggregate(F.transform(coords, part), F.lit(0.0), lambda total, x: total + x)
    return F.when(coords.isNotNull(), F.greatest(whole, F.lit(0.0)) * (AXIS_KM * AXIS_KM / 2 * 3.141592653589793 / 180))
