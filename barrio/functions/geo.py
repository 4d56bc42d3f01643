"""Positions: distances, grid arithmetic, projections, guards."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 ellipsoid.
SEMI_MAJOR_M = 6378137.0
FLATTENING = 1 / 298.257223563
ECC2 = FLATTENING * (2 - FLATTENING)

# Sanity boxes per source.
MADRID_UTM = {"x": (420000.0, 470000.0), "y": (4460000.0, 4495000.0)}
BOXES = {
    "barcelona": {"lat": (41.2, 41.5), "lng": (1.9, 2.3)},
    "diba": {"lat": (40.0, 42.5), "lng": (0.3, 3.2)},
    "andalucia": {"lat": (35.8, 39.0), "lng": (-7.7, -1.4)},
    "spain": {"lat": (27.5, 43.9), "lng": (-18.3, 4.4)},
}


def distance_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Local ellipsoidal distance in metres, meant for pairs up to a few kilometres."""
    mid = F.radians((lat1 + lat2) / F.lit(2.0))
    w = F.lit(1.0) - F.lit(ECC2) * F.sin(mid) * F.sin(mid)
    meridian = F.lit(SEMI_MAJOR_M * (1 - ECC2)) / (w * F.sqrt(w))
    normal = F.lit(SEMI_MAJOR_M) / F.sqrt(w)
    dy = meridian * F.radians(lat2 - lat1)
    dx = normal * F.cos(mid) * F.radians(lng2 - lng1)
    return F.sqrt(dx * dx + dy * dy)


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    half_lat = F.sin(F.radians(lat2 - lat1) / F.lit(2.0))
    half_lng = F.sin(F.radians(lng2 - lng1) / F.lit(2.0))
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return F.lit(2.0 * 6371.0) * F.asin(F.sqrt(h))


def in_box(lat: Column, lng: Column, box: dict) -> Column:
    """Both coordinates present and inside a closed box."""
    return F.coalesce(lat.between(*box["lat"]) & lng.between(*box["lng"]), F.lit(False))


def in_madrid_utm(x: Column, y: Column) -> Column:
    """Projected coordinates inside the municipality's box."""
    return F.coalesce(x.between(*MADRID_UTM["x"]) & y.between(*MADRID_UTM["y"]), F.lit(False))


def utm30_to_wgs84(x: Column, y: Column) -> tuple[Column, Column]:
    """(lng, lat) of a UTM zone 30 north position, by the sixth-order Krüger series."""
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR_M / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96,
        n**2 / 48 + n**3 / 15,
        17 * n**3 / 480,
    )
    delta = (
        2 * n - 2 * n**2 / 3 - 2 * n**3,
        7 * n**2 / 3 - 8 * n**3 / 5,
        56 * n**3 / 15,
    )
    xi = y / F.lit(0.9996 * radius)
    eta = (x - F.lit(500000.0)) / F.lit(0.9996 * radius)
    xi0, eta0 = xi, eta
    for j, b in enumerate(beta, 1):
        xi0 = xi0 - F.lit(b) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
        eta0 = eta0 - F.lit(b) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + F.lit(d) * F.sin(F.lit(2.0 * j) * chi)
    lng = F.lit(-3.0) + F.degrees(F.atan2(F.sinh(eta0), F.cos(xi0)))
    return lng, F.degrees(lat)


def geometry_mean_point(coordinates: Column) -> tuple[Column, Column]:
    """(lng, lat) mean of every coordinate pair in a JSON coordinates text.

    Only innermost arrays of exactly two numbers count; without any the result is null.
    """
    number = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
    pair = rf"\[\s*({number})\s*,\s*({number})\s*\]"
    means = []
    for group in (1, 2):
        values = F.transform(
            F.regexp_extract_all(coordinates, F.lit(pair), F.lit(group)),
            lambda v: v.try_cast("double"),
        )
        total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
        means.append(F.when(F.size(values) > 0, total / F.nullif(F.size(values), F.lit(0))))
    return means[0], means[1]


def lat_step(size_m: float) -> float:
    """Degrees of latitude that are at least `size_m` long anywhere."""
    return size_m / 110574.0


def lng_step(row: Column, size_m: float) -> Column:
    """Degrees of longitude at least `size_m` long throughout grid row `row` and its neighbours."""
    step = lat_step(size_m)
    edge = F.least((F.abs(row) + 2) * F.lit(step), F.lit(89.0))
    return F.lit(size_m / (math.pi * SEMI_MAJOR_M / 180.0)) / F.cos(F.radians(edge))
