"""Keys on the globe: web map tiles, the 100 m standard mesh, Web Mercator and transverse Mercator."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LAT = 85.05112878
# Ellipsoid GRS80 and the origin of the Japanese plane system IX (EPSG:6677).
GRS80_A, GRS80_F = 6378137.0, 1 / 298.257222101
IX_LAT, IX_LON, IX_SCALE = 36.0, 139 + 50 / 60, 0.9999


def tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """(x, y) of the tile that holds a point; latitudes beyond the map are held at its edge."""
    n = 2**zoom
    phi = F.radians(F.least(F.greatest(lat, F.lit(-MAX_LAT)), F.lit(MAX_LAT)))
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.ln(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * n)
    hold = lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(n - 1)).cast("int")
    return hold(x), hold(y)


def tile_west(x: Column, zoom: int) -> Column:
    return x / 2**zoom * 360 - 180


def tile_north(y: Column, zoom: int) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / 2**zoom))))


def tile_id(x: Column, y: Column, zoom: int) -> Column:
    return F.format_string(f"{zoom}/%d/%d", x, y)


def mesh100(lon: Column, lat: Column) -> Column:
    """Ten-digit code of the 100 m mesh cell; null outside longitudes 100 to 180 and latitudes 0 to 66.67."""
    ok = (lon >= 100) & (lon < 180) & (lat >= 0) & (lat < 66.6666666667)
    hold = lambda v, top: F.least(F.greatest(v, F.lit(0)), F.lit(top)).cast("int")

    def places(first: Column, whole: Column) -> list[Column]:
        a = (first - whole) * 8
        c = (a - F.floor(a)) * 10
        e = (c - F.floor(c)) * 10
        return [hold(F.floor(a), 7), hold(F.floor(c), 9), hold(F.floor(e), 9)]

    scaled = lat * 1.5
    down, along = places(scaled, F.floor(scaled)), places(lon, F.floor(lon))
    head = [F.floor(scaled).cast("int"), (F.floor(lon) - 100).cast("int")]
    return F.when(ok, F.format_string("%02d%02d%d%d%d%d%d%d", *head, down[0], along[0], down[1], along[1], down[2], along[2]))


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(x, y) in metres, EPSG:3857."""
    return F.radians(lon) * GRS80_A, F.ln(F.tan(math.pi / 4 + F.radians(lat) / 2)) * GRS80_A


def transverse_mercator(lon: Column, lat: Column, lat0: float = IX_LAT, lon0: float = IX_LON, scale: float = IX_SCALE) -> tuple[Column, Column]:
    """(easting, northing) in metres on GRS80 by Kruger's series to the third order; millimetres within some degrees."""
    f = GRS80_F
    n = f / (2 - f)
    radius = GRS80_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    s0 = math.sin(math.radians(lat0))
    t0 = math.sinh(math.atanh(s0) - e * math.atanh(e * s0))
    xi0 = math.atan(t0)
    north0 = scale * radius * (xi0 + sum(a * math.sin(2 * j * xi0) for j, a in enumerate(alpha, 1)))
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    d = F.radians(lon - lon0)
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return east * (scale * radius), north * (scale * radius) - north0
