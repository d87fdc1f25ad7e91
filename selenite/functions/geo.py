"""Column builders for coordinates, rigid motions and camera geometry.

All of them are plain expressions, so they stay inside whole-stage code and
are null where an input is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = Sequence[Column]


def lon_lat_radius_to_xyz(lon: Column, lat: Column, radius: Column) -> list[Column]:
    """Degrees and a radius to Cartesian coordinates on a sphere."""
    a, b = F.radians(lon), F.radians(lat)
    return [radius * F.cos(b) * F.cos(a), radius * F.cos(b) * F.sin(a), radius * F.sin(b)]


def xyz_to_lon_lat_radius(p: Vec) -> list[Column]:
    r = norm(p)
    return [F.degrees(F.atan2(p[1], p[0])), F.degrees(F.asin(p[2] / r)), r]


def geodetic_to_xyz(lon: Column, lat: Column, height: Column, semi_major: float) -> list[Column]:
    """Height above a spherical datum."""
    return lon_lat_radius_to_xyz(lon, lat, height + F.lit(semi_major))


def xyz_to_geodetic(p: Vec, semi_major: float) -> list[Column]:
    lon, lat, r = xyz_to_lon_lat_radius(p)
    return [lon, lat, r - F.lit(semi_major)]


def pixel_to_lon_lat(x: Column, y: Column, h00: Column, h02: Column, h11: Column, h12: Column) -> list[Column]:
    return [h00 * x + h02, h11 * y + h12]


def lon_lat_to_pixel(lon: Column, lat: Column, h00: Column, h02: Column, h11: Column, h12: Column) -> list[Column]:
    return [(lon - h02) / h00, (lat - h12) / h11]


def wrap_longitude(lon: Column) -> Column:
    """Into -180 to 180."""
    return F.when(lon < -180, lon + 360).when(lon > 180, lon - 360).otherwise(lon)


def dot(a: Vec, b: Vec) -> Column:
    return sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))


def cross(a: Vec, b: Vec) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def scale(a: Vec, k: Column) -> list[Column]:
    return [x * k for x in a]


def add(a: Vec, b: Vec) -> list[Column]:
    return [x + y for x, y in zip(a, b, strict=True)]


def sub(a: Vec, b: Vec) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def rows(matrix: Sequence[Sequence[float]]) -> list[list[Column]]:
    return [[F.lit(float(v)) for v in r] for r in matrix]


def apply_matrix(matrix: Sequence[Sequence[float]], p: Vec) -> list[Column]:
    return [dot(r, p) for r in rows(matrix)]


def rigid(p: Vec, rotation: Sequence[Sequence[float]], translation: Sequence[float], center: Sequence[float] = (0, 0, 0)) -> list[Column]:
    """R (p - c) + c + t."""
    c = [F.lit(float(v)) for v in center]
    t = [F.lit(float(v)) for v in translation]
    return add(add(apply_matrix(rotation, sub(p, c)), c), t)


def inverse_rigid(p: Vec, rotation: Sequence[Sequence[float]], translation: Sequence[float]) -> list[Column]:
    """R' (p - t)."""
    transposed = [list(r) for r in zip(*rotation, strict=True)]
    return apply_matrix(transposed, sub(p, [F.lit(float(v)) for v in translation]))


def homography(matrix: Sequence[Sequence[float]], x: Column, y: Column) -> list[Column]:
    """With the division by the third coordinate; pixels are cut to integers."""
    a, b, w = apply_matrix(matrix, [x, y, F.lit(1.0)])
    return [(a / w).cast("int"), (b / w).cast("int")]


def affine(matrix: Sequence[Sequence[float]], x: Column, y: Column) -> list[Column]:
    """Without the division by the third coordinate."""
    return apply_matrix(matrix, [x, y, F.lit(1.0)])[:2]


def translation_in_metres(dx: Column, dy: Column, lon: Column, lat: Column, radius: float) -> list[Column]:
    """What a step of (dx, dy) degrees is on the ground: R tan(step)."""
    return [F.lit(radius) * F.tan(F.radians(dx - lon)), F.lit(radius) * F.tan(F.radians(dy - lat))]


def pixels_per_degree(n_rows: Column, top: Column, bottom: Column) -> Column:
    return n_rows / F.abs(top - bottom)


def pan_tilt(p: Vec) -> list[Column]:
    return [F.atan2(p[0], p[1]), F.atan2(-p[2], F.sqrt(p[0] * p[0] + p[1] * p[1]))]


def pan_tilt_to_vector(pan: Column, tilt: Column) -> list[Column]:
    return [F.cos(tilt) * F.sin(pan), F.cos(tilt) * F.cos(pan), -F.sin(tilt)]


def quaternion_to_rotation(w: Column, x: Column, y: Column, z: Column) -> list[list[Column]]:
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def rotate(rotation: Sequence[Vec], p: Vec) -> list[Column]:
    return [dot(r, p) for r in rotation]


def cahv_project(p: Vec, c: Vec, a: Vec, h: Vec, v: Vec) -> list[Column]:
    d = sub(p, c)
    return [dot(d, h) / dot(d, a), dot(d, v) / dot(d, a)]


def cahv_to_pinhole(a: Vec, h: Vec, v: Vec, width: Column, height: Column) -> dict[str, Column]:
    """Optical centre, focal scales and fields of view of a CAHV camera."""
    hc, vc = dot(a, h), dot(a, v)
    hs, vs = norm(cross(a, h)), norm(cross(a, v))
    return {"hc": hc, "vc": vc, "hs": hs, "vs": vs, "fov_x": 2 * F.atan2(width, 2 * hs), "fov_y": 2 * F.atan2(height, 2 * vs)}


def euler_xyz(r: Sequence[Vec]) -> list[Column]:
    """Angles about x, y, z in degrees of a rotation given as rows of columns."""
    return [F.degrees(F.atan2(r[2][1], r[2][2])), F.degrees(F.asin(-r[2][0])), F.degrees(F.atan2(r[1][0], r[0][0]))]


def quad_digits(h: Column, v: Column, levels: int) -> Column:
    """Quad-tree digits of a tile, least significant first: bit of h plus twice the bit of v."""
    return F.array(
        *(F.shiftright(h, k).bitwiseAND(F.lit(1)) + 2 * F.shiftright(v, k).bitwiseAND(F.lit(1)) for k in range(levels))
    )


def axis_angle(r: Sequence[Vec]) -> list[Column]:
    """A rotation's axis and its angle in radians, 0 to pi; without a turn the axis is null."""
    turn = [r[2][1] - r[1][2], r[0][2] - r[2][0], r[1][0] - r[0][1]]
    size = norm(turn)
    angle = F.atan2(size, r[0][0] + r[1][1] + r[2][2] - 1)
    return [*(F.when(size > 0, c / size) for c in turn), angle]
