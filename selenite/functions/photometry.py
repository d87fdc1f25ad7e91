"""Column builders for photometry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from selenite.functions import geo

#: The phase polynomial of the lunar-Lambertian law, in degrees.
PHASE = (1.0, -0.019, 2.42e-4, -1.46e-6)


def face_normal(p1: geo.Vec, p2: geo.Vec, p3: geo.Vec) -> list[Column]:
    """Unit normal of a triangle, turned outwards."""
    n = geo.cross(geo.sub(p2, p1), geo.sub(p3, p1))
    return geo.scale(n, -1 / geo.norm(n))


def lunar_lambertian(mu0: Column, mu: Column, phase_degrees: Column) -> Column:
    """Reflectance from the cosines of incidence and emission and the phase angle.

    0 where the sun is below the horizon or both cosines vanish; never negative.
    """
    weight = sum((F.lit(c) * F.pow(phase_degrees, F.lit(float(i))) for i, c in enumerate(PHASE)), F.lit(0.0))
    up = F.greatest(mu, F.lit(0.0))
    value = 2 * weight * mu0 / (mu0 + up) + (1 - weight) * mu0
    return F.when((mu0 < 0) | (mu0 + up == 0), F.lit(0.0)).otherwise(F.greatest(value, F.lit(0.0)))


def angles(point: geo.Vec, normal: geo.Vec, light: Sequence[float], camera: Sequence[float]) -> list[Column]:
    """Cosines of incidence and emission and the phase in degrees, of a surface point seen from ``camera`` under ``light``."""
    to_light = geo.sub([F.lit(float(v)) for v in light], point)
    to_camera = geo.sub([F.lit(float(v)) for v in camera], point)
    far, near = geo.norm(to_light), geo.norm(to_camera)
    phase = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), geo.dot(to_light, to_camera) / (far * near)))))
    return [geo.dot(normal, to_light) / far, geo.dot(normal, to_camera) / near, phase]


def reflectance(point: geo.Vec, normal: geo.Vec, light: Sequence[float], camera: Sequence[float]) -> Column:
    """Lunar-Lambertian reflectance of a surface point."""
    return lunar_lambertian(*angles(point, normal, light, camera))


def gain_bias(reflectance: Column, gain: Column, bias: Column) -> Column:
    """At most 1."""
    return F.least(F.lit(1.0), reflectance * gain + bias)


def foreground_weight(distance: Column, back_accuracy: Column) -> Column:
    """Weight of the foreground from its accuracy (squared distance over 300) and the background's."""
    fore = distance * distance / 300
    return back_accuracy / (fore + back_accuracy)


def blend(weight: Column, fore: Column, back: Column) -> Column:
    return weight * fore + (1 - weight) * back


def blended_accuracy(weight: Column, fore: Column, back: Column) -> Column:
    return 1 / (weight / fore + (1 - weight) / back)


def to_eight_bits(value: Column, largest: Column) -> Column:
    """Scaled by 255 over the largest value, clamped and cut to an integer."""
    return F.least(F.lit(255), F.greatest(F.lit(0), (value * 255 / largest).cast("int")))


def depth_to_metres(raw: Column, k1: float = 1.1863, k2: float = 2842.5, k3: float = 0.1236) -> Column:
    """A range camera's raw disparity as a distance."""
    return F.lit(k3) * F.tan(raw / k2 + k1)
