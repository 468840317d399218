"""Geometry by column functions: distances, boxes, segments and rings over lists of points struct(lat, lon) in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres of a quarter of the meridian make the radius of the sphere.
QUARTER = 10_000_000.0


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres between two points in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    cosine = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(lon2 - lon1))
    near = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    angle = F.when(cosine > 0.9999, 2 * F.asin(F.sqrt(F.least(near, F.lit(1.0))))).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    return angle * F.lit(QUARTER * 2) / F.pi()


def pairs(points: Column | str) -> Column:
    """Segments struct(a, b) of a list of points."""
    points = F.col(points) if isinstance(points, str) else points
    n = F.size(points)
    return F.zip_with(F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def length(points: Column | str) -> Column:
    step = F.transform(pairs(points), lambda s: distance(s["a"]["lat"], s["a"]["lon"], s["b"]["lat"], s["b"]["lon"]))
    return F.aggregate(step, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def segment_meets_box(s: Column, south: float, west: float, north: float, east: float) -> Column:
    """Whether a segment (not over the antimeridian) touches a box: clipping by the four sides."""
    ax, ay, bx, by = s["a"]["lon"], s["a"]["lat"], s["b"]["lon"], s["b"]["lat"]
    dx, dy = bx - ax, by - ay
    low, high = F.lit(0.0), F.lit(1.0)
    miss = F.lit(False)
    for d, near, far in ((dx, west - ax, east - ax), (dy, south - ay, north - ay)):
        t0, t1 = F.try_divide(near, d), F.try_divide(far, d)
        miss = miss | ((d == 0) & ((near > 0) | (far < 0)))
        low = F.when(d == 0, low).otherwise(F.greatest(low, F.least(t0, t1)))
        high = F.when(d == 0, high).otherwise(F.least(high, F.greatest(t0, t1)))
    return ~miss & (low <= high)


def point_in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Inclusive; a box whose east is less than its west crosses the antimeridian."""
    within = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return lat.between(south, north) & within


def on_segment(lat: Column, lon: Column, s: Column) -> Column:
    cross = (s["b"]["lon"] - s["a"]["lon"]) * (lat - s["a"]["lat"]) - (s["b"]["lat"] - s["a"]["lat"]) * (lon - s["a"]["lon"])
    inside = lat.between(F.least(s["a"]["lat"], s["b"]["lat"]), F.greatest(s["a"]["lat"], s["b"]["lat"])) & lon.between(F.least(s["a"]["lon"], s["b"]["lon"]), F.greatest(s["a"]["lon"], s["b"]["lon"]))
    return (F.abs(cross) < 1e-12) & inside


def in_ring(lat: Column, lon: Column, segments: Column, border: bool = True) -> Column:
    """Even-odd rule over the segments of closed rings; points on a border count if wished."""
    crossed = F.size(
        F.filter(segments, lambda s: ((s["a"]["lon"] <= lon) != (s["b"]["lon"] <= lon)) & (lat > s["a"]["lat"] + (lon - s["a"]["lon"]) * F.try_divide(s["b"]["lat"] - s["a"]["lat"], s["b"]["lon"] - s["a"]["lon"])))
    )
    touched = F.exists(segments, lambda s: on_segment(lat, lon, s))
    inside = crossed % 2 == 1
    return inside | touched if border else inside & ~touched


def bounds(points: Column | str) -> Column:
    """struct(minlat, minlon, maxlat, maxlon) of a list of points; null if it is empty."""
    points = F.col(points) if isinstance(points, str) else points
    lat, lon = points["lat"], points["lon"]
    return F.when(F.size(points) > 0, F.struct(F.array_min(lat).alias("minlat"), F.array_min(lon).alias("minlon"), F.array_max(lat).alias("maxlat"), F.array_max(lon).alias("maxlon")))


def center(box: Column) -> Column:
    return F.struct(((box["minlat"] + box["maxlat"]) / 2).alias("lat"), ((box["minlon"] + box["maxlon"]) / 2).alias("lon"))


def point(lat: Column, lon: Column) -> Column:
    return F.array(F.array(F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))))


def line(*points: Column) -> Column:
    """A line from point geometries."""
    return F.array(F.flatten(F.array(*[F.flatten(p) for p in points])))


def polygon(*lines: Column) -> Column:
    """Rings from line geometries; each is closed and turned so that the inside is on its left (outer rings) by its area."""
    rings = F.flatten(F.array(*lines))

    def turned(r: Column) -> Column:
        ring = F.when(F.get(r, F.lit(0)) == F.get(r, F.size(r) - 1), r).otherwise(F.concat(r, F.slice(r, 1, 1)))
        area = F.aggregate(pairs(ring), F.lit(0.0), lambda acc, s: acc + (s["b"]["lon"] - s["a"]["lon"]) * (s["b"]["lat"] + s["a"]["lat"]))
        return F.when(area > 0, F.reverse(ring)).otherwise(ring)

    return F.transform(rings, turned)


def trace(parts: Column) -> Column:
    """The distinct segments of a geometry, without direction, in order."""
    segments = F.flatten(F.transform(parts, pairs))
    ordered = F.transform(segments, lambda s: F.when(s["a"] <= s["b"], F.array(s["a"], s["b"])).otherwise(F.array(s["b"], s["a"])))
    return F.array_sort(F.array_distinct(ordered))


def hull(points: Column) -> Column:
    """The convex hull in the plane of latitude and longitude, as a closed ring (monotone chain in a fold)."""
    ordered = F.array_sort(F.array_distinct(points))

    def half(ps: Column) -> Column:
        def turn(o: Column, a: Column, b: Column) -> Column:
            return (a["lat"] - o["lat"]) * (b["lon"] - o["lon"]) - (a["lon"] - o["lon"]) * (b["lat"] - o["lat"])

        def add(chain: Column, p: Column) -> Column:
            # the longest beginning of the chain whose last turn with p is to the left
            keep = F.array_max(F.concat(F.array(F.least(F.size(chain), F.lit(1))), F.filter(F.transform(chain, lambda _, i: i + 1), lambda k: (k >= 2) & F.coalesce(turn(F.get(chain, k - 2), F.get(chain, k - 1), p) > 0, F.lit(False)))))
            return F.concat(F.slice(chain, F.lit(1), keep), F.array(p))

        return F.aggregate(ps, F.slice(ps, 1, 0), add)

    low, high = half(ordered), half(F.reverse(ordered))
    ring = F.concat(F.slice(low, F.lit(1), F.greatest(F.size(low) - 1, F.lit(0))), high)
    return F.when(F.size(ordered) < 3, ordered).otherwise(ring)


def angle(a: Column, b: Column, c: Column) -> Column:
    """The signed turn at b from a to c in degrees; null where a segment has no length."""

    def vector(p: Column) -> tuple[Column, Column, Column]:
        lat, lon = F.radians(p["lat"]), F.radians(p["lon"])
        return F.sin(lat), F.cos(lat) * F.sin(lon), F.cos(lat) * F.cos(lon)

    (x0, y0, z0), (x1, y1, z1), (x2, y2, z2) = vector(a), vector(b), vector(c)
    ux, uy, uz = y0 * z1 - z0 * y1, z0 * x1 - x0 * z1, x0 * y1 - y0 * x1
    vx, vy, vz = y1 * z2 - z1 * y2, z1 * x2 - x1 * z2, x1 * y2 - y1 * x2
    size = F.sqrt((ux * ux + uy * uy + uz * uz) * (vx * vx + vy * vy + vz * vz))
    cosine = F.try_divide(ux * vx + uy * vy + uz * vz, size)
    sign = F.signum(x1 * (uy * vz - uz * vy) + y1 * (uz * vx - ux * vz) + z1 * (ux * vy - uy * vx))
    return F.when(size > 1e-20, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))) * F.when(sign < 0, -1.0).otherwise(1.0))
