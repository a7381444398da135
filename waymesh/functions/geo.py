"""Column functions on pixels, coordinates, vectors and segments.

Points are (x, y) = (column, row), y grows downward. One pixel is a metre,
1/111111 degree. A null argument gives null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

METRES = 111111.0
LAT0, LON0 = 41.0, -71.0
#: Width of a degree of longitude at the anchor.
COS0 = math.cos(math.radians(LAT0))


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x) if not isinstance(x, str) else F.col(x)


def geo_to_pixel(lon, lat, a, c, e, f, size: int = 1300) -> tuple[Column, Column]:
    """(x, y) of a position by the inverse of a north-up affine; index `size` is the last pixel."""

    def index(v, step, origin):
        i = F.floor((_c(v) - _c(origin)) / _c(step)).cast("int")
        return F.when(i == size, size - 1).otherwise(i)

    return index(lon, a, c), index(lat, e, f)


def rowcol_to_latlon(row, col) -> tuple[Column, Column]:
    """Latitude falls with the row; longitude grows with the column at the anchor's width."""
    return F.lit(LAT0) - _c(row) / METRES, F.lit(LON0) + _c(col) / METRES / COS0


def xy_to_latlon(x, y) -> tuple[Column, Column]:
    """The other convention: x drives latitude, y longitude."""
    return F.lit(LAT0) - _c(x) / METRES, F.lit(LON0) + _c(y) / METRES / COS0


def deg_distance(lat1, lon1, lat2, lon2) -> Column:
    """Distance in degrees, longitude scaled by the first point's latitude."""
    a, b = _c(lat1) - _c(lat2), (_c(lon1) - _c(lon2)) * F.cos(F.radians(_c(lat1)))
    return F.sqrt(a * a + b * b)


def gps_distance(lat1, lon1, lat2, lon2) -> Column:
    """deg_distance in metres."""
    return deg_distance(lat1, lon1, lat2, lon2) * METRES


def euclidean(x1, y1, x2, y2) -> Column:
    """Distance in pixels."""
    a, b = (_c(x1) - _c(x2)).cast("double"), (_c(y1) - _c(y2)).cast("double")
    return F.sqrt(a * a + b * b)


def unit_vec(dlat, dlon, lat: float = 40.0) -> tuple[Column, Column]:
    """Unit vector of a step in degrees at a fixed latitude; null for a zero step."""
    a, b = _c(dlat), _c(dlon) * math.cos(math.radians(lat))
    n = F.nullif(F.sqrt(a * a + b * b), F.lit(0.0))
    return a / n, b / n


def point_segment_distance(px, py, ax, ay, bx, by) -> Column:
    """Distance of a point to a segment."""
    px, py, ax, ay, bx, by = (_c(v).cast("double") for v in (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(n, F.lit(0.0)))))
    return F.sqrt((px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2)


def angle_distance(ax, ay, bx, by) -> Column:
    """Length of the difference of two unit vectors; 100000 where one has no length."""
    ax, ay, bx, by = (_c(v).cast("double") for v in (ax, ay, bx, by))
    n, m = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by)
    p, q = F.nullif(n, F.lit(0.0)), F.nullif(m, F.lit(0.0))
    return F.when((n == 0) | (m == 0), 100000.0).otherwise(F.sqrt((ax / p - bx / q) ** 2 + (ay / p - by / q) ** 2))


def in_bounds(lat, lon, region: float, margin: float) -> Column:
    """Whether a position is inside the square region, more than `margin` metres off its sides, longitude at the anchor's width."""
    low, left = LAT0 - region / METRES, LON0
    right, edge = LON0 + region / METRES / COS0, margin / METRES
    inside_lat = (_c(lat) > low + edge) & (_c(lat) < LAT0 - edge)
    return inside_lat & (_c(lon) > left + edge / COS0) & (_c(lon) < right - edge / COS0)


def grid_key(lat, lon, cell: float = 2.0) -> tuple[Column, Column]:
    """Cell of `cell` metres, truncating toward zero."""
    return (_c(lat) * METRES / cell).cast("long"), (_c(lon) * METRES / cell).cast("long")


def fine_key(lat, lon) -> tuple[Column, Column]:
    """Coordinates as integers of 1e-7 degrees."""
    return F.rint(_c(lat) * 1e7).cast("long"), F.rint(_c(lon) * 1e7).cast("long")


def angle_deg(sin, cos) -> Column:
    """Degrees in [0, 360)."""
    d = F.degrees(F.atan2(_c(sin), _c(cos)))
    return F.when(d < 0, d + 360).otherwise(d)


def vector_angle(ax, ay, bx, by, eps: float = 1e-8) -> Column:
    """Angle in degrees between two vectors, its cosine clipped."""
    ax, ay, bx, by = (_c(v).cast("double") for v in (ax, ay, bx, by))
    c = (ax * bx + ay * by) / F.greatest(F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by), F.lit(eps))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def ray_distance(px, py, ox, oy, dx, dy, penalty: float = 1e4) -> Column:
    """Distance of a point to a ray's line; `penalty` behind its origin. (dx, dy) is a unit vector."""
    px, py, ox, oy, dx, dy = (_c(v).cast("double") for v in (px, py, ox, oy, dx, dy))
    ahead = (px - ox) * dx + (py - oy) * dy
    return F.when(ahead < 0, penalty).otherwise(F.abs((px - ox) * dy - (py - oy) * dx))


def lerp_clamped(d, near: float, far: float, at_near: float, at_far: float) -> Column:
    """A threshold that goes linearly from at_near to at_far between two distances."""
    d = _c(d)
    return F.when(d <= near, at_near).when(d >= far, at_far).otherwise(at_near + (d - near) * ((at_far - at_near) / (far - near)))


def clip_segment(ax, ay, bx, by, left, top, right, bottom) -> Column:
    """Array of integer points where a segment meets a rectangle's boundary, from (ax, ay) on.

    Each side is met at its parameter; a segment along a side meets the sides
    next to it at their ends. Coordinates round half to even.
    """
    ax, ay, bx, by, left, top, right, bottom = (_c(v).cast("double") for v in (ax, ay, bx, by, left, top, right, bottom))
    dx, dy = bx - ax, by - ay

    def side(along, start, at, other, step, lo, hi, vertical):
        t = (at - start) / F.nullif(along, F.lit(0.0))
        o = other + t * step
        ok = t.between(0, 1) & o.between(lo, hi)
        x, y = (at, o) if vertical else (o, at)
        return F.when(ok, F.struct(t.alias("t"), F.rint(x).cast("int").alias("x"), F.rint(y).cast("int").alias("y")))

    hits = F.array(
        side(dx, ax, left, ay, dy, top, bottom, True),
        side(dx, ax, right, ay, dy, top, bottom, True),
        side(dy, ay, top, ax, dx, left, right, False),
        side(dy, ay, bottom, ax, dx, left, right, False),
    )
    met = F.array_sort(F.filter(hits, lambda h: h.isNotNull()))
    return F.array_distinct(F.transform(met, lambda h: F.struct(h["x"].alias("x"), h["y"].alias("y"))))


def ray_segment(ox, oy, dx, dy, ax, ay, bx, by) -> tuple[Column, Column, Column]:
    """(x, y, length) where a ray meets a segment; zeros where parallel, behind or beside it."""
    ox, oy, dx, dy, ax, ay, bx, by = (_c(v).cast("double") for v in (ox, oy, dx, dy, ax, ay, bx, by))
    ex, ey = bx - ax, by - ay
    det = F.nullif(dx * ey - dy * ex, F.lit(0.0))
    t = ((ax - ox) * ey - (ay - oy) * ex) / det
    s = ((ax - ox) * dy - (ay - oy) * dx) / det
    ok = F.coalesce((t >= 0) & s.between(0, 1), F.lit(False))
    return tuple(F.when(ok, v).otherwise(0.0) for v in (ox + t * dx, oy + t * dy, t * F.sqrt(dx * dx + dy * dy)))


def window_index(lat, lon, min_lat, min_lon, max_lat, max_lon, size_x: int, size_y: int) -> tuple[Column, Column]:
    """(row, column) of a position in a window of size_x rows and size_y columns: size_x less the truncated step count from min_lat, and the truncated one from min_lon."""
    return (
        F.lit(size_x) - ((_c(lat) - _c(min_lat)) / ((_c(max_lat) - _c(min_lat)) / size_x)).cast("int"),
        ((_c(lon) - _c(min_lon)) / ((_c(max_lon) - _c(min_lon)) / size_y)).cast("int"),
    )


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def standardise(x, mean: float, std: float) -> Column:
    """(x / 255 - mean) / std of an 8-bit band."""
    return (_c(x) / 255.0 - mean) / std


def simple_scale(x) -> Column:
    """An 8-bit band as -1 to 1."""
    return _c(x) / 127.5 - 1


def step_vector(x1, y1, x2, y2) -> tuple[Column, Column]:
    """(sin, cos) of the direction from one node to another; null for equal nodes."""
    n = F.nullif(euclidean(x1, y1, x2, y2), F.lit(0.0))
    return (_c(y2) - _c(y1)) / n, (_c(x2) - _c(x1)) / n


def pair_cost(dist, angle_sum, line_sum, angle_range=(44.99, 45.0), line_range=(70.0, 140.0), loc_range=(0.0, 448.0), scale=(0.0, 1.0), scale_range=(0.0, 448.0), reject: float = 1000.0) -> Column:
    """Cost of joining two directions: the sum of their line distances, scaled by the keypoints' distance; `reject` at or beyond the interpolated angle or line limit."""
    near, far = loc_range
    bad = (_c(angle_sum) >= lerp_clamped(dist, near, far, *angle_range)) | (_c(line_sum) >= lerp_clamped(dist, near, far, *line_range))
    return F.when(bad, reject).otherwise(_c(line_sum) * lerp_clamped(dist, *scale_range, *scale))


def designed_distance(dist, vector_gap, size: float) -> Column:
    """100 times the distance of two keypoints over the shorter image side, times the least length of the sum of two of their directions."""
    return 100 * _c(dist) / size * _c(vector_gap)


def line_pixels(x1, y1, x2, y2) -> Column:
    """Array of the pixels of a leg, first included and last dropped; halves round to even."""
    dx, dy = _c(x2) - _c(x1), _c(y2) - _c(y1)
    n = F.greatest(F.abs(dx), F.abs(dy))
    walk = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    return F.when(n > 0, F.transform(walk, lambda i: F.struct(F.rint(_c(x1) + dx * i / n).cast("int").alias("x"), F.rint(_c(y1) + dy * i / n).cast("int").alias("y"))))
