"""Geometry and geodesy as column expressions. Latitudes and longitudes are degrees, heights metres."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres a degree of latitude, and of longitude at the city's latitude.
M_LAT = 111000.0
M_LON = 91280.04047475605
#: WGS 84.
WGS_A = 6378137.0
WGS_E2 = (1 / 298.257223563) * (2 - 1 / 298.257223563)


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once a row, however often it stands there, within functions of elements too."""
    return F.get(F.transform(F.array(value), use), 0)


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Halves go up, also for negative numbers."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k


def plane_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dy, dx = (lat1 - lat2) * M_LAT, (lon1 - lon2) * M_LON
    return F.sqrt(dy * dy + dx * dx)


def grid_cell(lat: Column, lon: Column, north: float, west: float, res: float, width: int) -> tuple[Column, Column, Column]:
    """Row, column and cell number of a point in a grid whose first row is the northernmost."""
    row, col = F.floor((F.lit(north) - lat) / res), F.floor((lon - F.lit(west)) / res)
    return row, col, row * width + col


def mesh_code(lat: Column, lon: Column) -> Column:
    """Third-level mesh: two digits each of 40' rows and degrees, then eighths, then tenths of those."""
    a, b = lat * 1.5, lon - 100
    p, u = F.floor(a), F.floor(b)
    a8, b8 = (a - p) * 8, (b - u) * 8
    q, v = F.floor(a8), F.floor(b8)
    return F.concat(*[x.cast("string") for x in (p, u, q, v, F.floor((a8 - q) * 10), F.floor((b8 - v) * 10))])


def mesh_bounds(code: Column) -> dict[str, Column]:
    d = [F.substring(code, *at).cast("int") for at in ((1, 2), (3, 2), (5, 1), (6, 1), (7, 1), (8, 1))]
    south, west = d[0] / 1.5 + d[2] / 12 + d[4] / 120, d[1] + 100 + d[3] / 8 + d[5] / 80
    return {"south": south, "west": west, "north": south + 1 / 120, "east": west + 1 / 80}


def ecef(lat: Column, lon: Column, h: Column) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates of a geodetic position."""
    sin, cos = F.sin(F.radians(lat)), F.cos(F.radians(lat))
    n = F.lit(WGS_A) / F.sqrt(1 - WGS_E2 * sin * sin)
    return (n + h) * cos * F.cos(F.radians(lon)), (n + h) * cos * F.sin(F.radians(lon)), (n * (1 - WGS_E2) + h) * sin


def geodetic(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Latitude, longitude and height of earth-centred coordinates, in closed form (Bowring)."""
    b = WGS_A * math.sqrt(1 - WGS_E2)
    ep2 = WGS_E2 / (1 - WGS_E2)
    p = F.sqrt(x * x + y * y)
    t = F.atan2(z * WGS_A, p * b)
    lat = F.atan2(z + ep2 * b * F.pow(F.sin(t), 3), p - WGS_E2 * WGS_A * F.pow(F.cos(t), 3))
    n = F.lit(WGS_A) / F.sqrt(1 - WGS_E2 * F.sin(lat) * F.sin(lat))
    return F.degrees(lat), F.degrees(F.atan2(y, x)), p / F.cos(lat) - n


def local_enu(lat: Column, lon: Column, h: Column, lat0: Column, lon0: Column) -> tuple[Column, Column, Column]:
    """East, north and up metres from the ground point (lat0, lon0)."""
    x, y, z = ecef(lat, lon, h)
    x0, y0, z0 = ecef(lat0, lon0, F.lit(0.0))
    dx, dy, dz = x - x0, y - y0, z - z0
    sl, cl, so, co = F.sin(F.radians(lat0)), F.cos(F.radians(lat0)), F.sin(F.radians(lon0)), F.cos(F.radians(lon0))
    return -so * dx + co * dy, -sl * co * dx - sl * so * dy + cl * dz, cl * co * dx + cl * so * dy + sl * dz


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd test: a ray to the east crosses an odd number of edges. A ring's last edge leads to its first point."""
    n = F.size(ring)

    def crosses(a: Column, i: Column) -> Column:
        b = F.get(ring, F.when(i == 0, n - 1).otherwise(i - 1))
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        return F.when(spans, lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]).otherwise(F.lit(False))

    return F.coalesce(F.size(F.filter(F.transform(ring, crosses), lambda x: x)) % 2 == 1, F.lit(False))


def in_any_ring(lat: Column, lon: Column, rings: Column) -> Column:
    return F.exists(rings, lambda r: in_ring(lat, lon, r))


def ring_area(ring: Column) -> Column:
    """Area in plane square metres, by the shoelace sum."""
    n = F.size(ring)

    def term(p: Column, i: Column) -> Column:
        q = F.get(ring, F.when(i == n - 1, F.lit(0)).otherwise(i + 1))
        return (p["lon"] * M_LON) * (q["lat"] * M_LAT) - (q["lon"] * M_LON) * (p["lat"] * M_LAT)

    return F.abs(F.aggregate(F.transform(ring, term), F.lit(0.0), lambda s, x: s + x)) / 2


def rings_area(rings: Column) -> Column:
    return F.aggregate(F.transform(rings, ring_area), F.lit(0.0), lambda s, x: s + x)


def largest_ring(rings: Column) -> Column:
    """The ring of the greatest area, the first of equals."""
    return named(F.array_max(F.transform(rings, ring_area)), lambda most: F.get(F.filter(rings, lambda r: ring_area(r) == most), 0))


def ring_mean(ring: Column, field: str) -> Column:
    return F.aggregate(F.transform(ring, lambda p: p[field]), F.lit(0.0), lambda s, x: s + x) / F.size(ring)


def ring_bounds(ring: Column) -> dict[str, Column]:
    lat, lon = F.transform(ring, lambda p: p["lat"]), F.transform(ring, lambda p: p["lon"])
    return {"s": F.array_min(lat), "w": F.array_min(lon), "n": F.array_max(lat), "e": F.array_max(lon)}


def newell_normal(ring: Column) -> tuple[Column, Column, Column]:
    """Normal of a closed polygon of points (x, y, z); twice its area long."""
    n = F.size(ring)

    def part(a: str, b: str) -> Column:
        def term(p: Column, i: Column) -> Column:
            q = F.get(ring, F.when(i == n - 1, F.lit(0)).otherwise(i + 1))
            return (p[a] - q[a]) * (p[b] + q[b])

        return F.aggregate(F.transform(ring, term), F.lit(0.0), lambda s, x: s + x)

    return part("y", "z"), part("z", "x"), part("x", "y")


def dropped_axis(nx: Column, ny: Column, nz: Column) -> Column:
    """The axis (0, 1, 2) to leave out when a polygon is laid flat; null for a polygon without an area."""
    ax, ay, az = F.abs(nx), F.abs(ny), F.abs(nz)
    size = F.sqrt(nx * nx + ny * ny + nz * nz)
    return F.when(size >= 1e-6, F.when((ax > ay) & (ax > az), 0).when(ay > az, 1).otherwise(2))


def clamped_steps(x: Column, step: float, most: int = 32767) -> Column:
    """Nearest whole number of steps, within +-most."""
    return F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(x / step + 0.5))).cast("int")


def quantized_position(east: Column, north: Column, up: Column, step: float = 0.05, most: int = 32767) -> Column:
    """Steps along the axes of a y-up frame (east, up, south); a position out of range fails the job."""
    q = F.transform(F.array(east, up, -north), lambda v: F.floor(v / step + 0.5).cast("int"))
    return F.when(F.exists(q, lambda v: F.abs(v) > most), F.raise_error(F.lit("position out of quantization range"))).otherwise(q)


def offset_position(lat: Column, lon: Column, north_m: Column, east_m: Column) -> tuple[Column, Column]:
    return lat + north_m / 111320.0, lon + east_m / (111320.0 * F.cos(F.radians(lat)))


def step_position(lat: Column, lon: Column, heading: Column, way: Column, step: Column) -> tuple[Column, Column, Column]:
    """Latitude, longitude and metres upwards after one step: forward, back, left or right of the heading (w, s, a, d), up or down (e, q)."""
    sin, cos = F.sin(F.radians(heading)), F.cos(F.radians(heading))
    east = F.when(way == "w", sin).when(way == "s", -sin).when(way == "a", -cos).when(way == "d", cos).otherwise(0.0) * step
    north = F.when(way == "w", cos).when(way == "s", -cos).when(way == "a", sin).when(way == "d", -sin).otherwise(0.0) * step
    up = F.when(way == "e", step).when(way == "q", -step).otherwise(0.0)
    return *offset_position(lat, lon, north, east), up


def compass_point(heading: Column, names: tuple[str, ...]) -> Column:
    step = 360.0 / len(names)
    at = F.pmod(F.floor(F.pmod(heading.cast("double"), F.lit(360.0)) / step + 0.5), F.lit(len(names)))
    return F.get(F.array(*[F.lit(n) for n in names]), at.cast("int"))


def device_vectors(alpha: Column, beta: Column, gamma: Column, screen: Column) -> tuple[Column, Column]:
    """Viewing direction and upward vector of a device in east, north, up.

    The device is turned about z by alpha, then x by beta, then y by gamma; its back looks along -z.
    """
    ca, sa, cb, sb, cg, sg = (f(F.radians(v)) for v in (alpha, beta, gamma) for f in (F.cos, F.sin))
    s, c = F.sin(F.radians(screen)), F.cos(F.radians(screen))
    look = F.array(-(ca * sg + sa * sb * cg), -(sa * sg - ca * sb * cg), -(cb * cg))
    up = F.array((ca * cg - sa * sb * sg) * s - sa * cb * c, (sa * cg + ca * sb * sg) * s + ca * cb * c, -cb * sg * s + sb * c)
    return look, up
