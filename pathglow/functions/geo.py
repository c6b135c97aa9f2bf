"""Geographic and planar scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the sphere of the web map projection, and the mean radius for true distances, in metres.
MERCATOR_RADIUS, EARTH_RADIUS = 6378137.0, 6371000.0


def lonlat_to_tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Tile column and row; fractions are cut off towards zero."""
    n = float(1 << zoom)
    return ((lon + 180) / 360 * n).cast("int"), ((1 - F.asinh(F.tan(F.radians(lat))) / F.pi()) / 2 * n).cast("int")


def tile_to_lonlat(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    """Upper left corner of a tile."""
    n = float(1 << zoom)
    return x / n * 360 - 180, F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * y / n))))


def lon_to_x(lon: Column) -> Column:
    return F.radians(lon) * MERCATOR_RADIUS


def lat_to_y(lat: Column) -> Column:
    return F.log(F.tan(F.pi() / 4 + F.radians(lat) / 2)) * MERCATOR_RADIUS


def x_to_lon(x: Column) -> Column:
    return F.degrees(x / MERCATOR_RADIUS)


def y_to_lat(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / MERCATOR_RADIUS)) - F.pi() / 2)


def to_pixel(x: Column, y: Column, min_x: Column, max_y: Column, width: Column, height: Column, pixels: int) -> tuple[Column, Column]:
    """Pixel column and row in a box; halves go to the even neighbour."""
    return F.bround((x - min_x) / width * pixels).cast("int"), F.bround((max_y - y) / height * pixels).cast("int")


def from_pixel(row: Column, col: Column, min_x: Column, max_y: Column, width: Column, height: Column, pixels: int) -> tuple[Column, Column]:
    """Upper left corner of a pixel in the plane."""
    return min_x + col / pixels * width, max_y - row / pixels * height


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def line_width(distance: Column, pixel_size: Column) -> Column:
    """Odd width in pixels of a line that masks ``distance`` on either side."""
    return (F.bround(distance / pixel_size) * 2 + 1).cast("int")


def axis_angle(dx1: Column, dy1: Column, dx2: Column, dy2: Column) -> Column:
    """Angle of two undirected directions in degrees; null where one has no length."""
    norm = F.sqrt(dx1 * dx1 + dy1 * dy1) * F.sqrt(dx2 * dx2 + dy2 * dy2)
    return F.when(norm > 0, F.degrees(F.acos(F.least(F.lit(1.0), F.abs(dx1 * dx2 + dy1 * dy2) / norm))))


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a segment, by the projection clamped to its ends."""
    length = (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / length))).otherwise(0.0)
    dx, dy = px - (x1 + t * (x2 - x1)), py - (y1 + t * (y2 - y1))
    return F.sqrt(dx * dx + dy * dy)


def crosses_ray(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether a ray from the point to the right crosses the edge; an odd count over a ring's edges means inside."""
    return ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)


def elongation(major: Column, minor: Column, most: float = 1e6) -> Column:
    """Ratio of the variances along the axes, at most ``most``; null where there is no extent."""
    return F.when(major <= 1e-12, F.lit(None)).when(minor <= 1e-12, F.lit(most)).otherwise(F.least(major / minor, F.lit(most)))


def band(value: Column, low: Column, high: Column, names: tuple[str, str, str]) -> Column:
    """The third of [low, high] that a value lies in."""
    third = (high - low) / 3
    return F.when(value < low + third, names[0]).when(value < low + 2 * third, names[1]).otherwise(names[2])
