"""Vector geometry as column expressions: distances, angles, planes, labels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def at(prefix: str = "") -> Vector:
    return F.col(prefix + "x"), F.col(prefix + "y"), F.col(prefix + "z")


def of(struct: Column) -> Vector:
    return struct["x"], struct["y"], struct["z"]


def minus(a: Vector, b: Vector) -> Vector:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def d2(a: Vector, b: Vector) -> Column:
    """Squared distance; comparing it with r*r avoids the root."""
    v = minus(a, b)
    return dot(v, v)


def distance(a: Vector, b: Vector) -> Column:
    return F.sqrt(d2(a, b))


def clamped(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c))


def angle(u: Vector, v: Vector, degenerate: float | None = None) -> Column:
    """Angle of two vectors in degrees; ``degenerate`` where one has no length (0 for site
    geometry, null for residue analysis)."""
    n = norm(u) * norm(v)
    return F.when(n > 0, F.degrees(F.acos(clamped(dot(u, v) / n)))).otherwise(F.lit(degenerate))


def vertex_angle(a: Vector, vertex: Vector, b: Vector, degenerate: float | None = None) -> Column:
    return angle(minus(a, vertex), minus(b, vertex), degenerate)


def dihedral(p0: Vector, p1: Vector, p2: Vector, p3: Vector) -> Column:
    """Signed torsion in degrees; null where a plane is degenerate."""
    b1, b2, b3 = minus(p1, p0), minus(p2, p1), minus(p3, p2)
    n1, n2 = cross(b1, b2), cross(b2, b3)
    y = norm(b2) * dot(b1, n2)
    return F.when((dot(n1, n1) > 0) & (dot(n2, n2) > 0) & (dot(b2, b2) > 0), F.degrees(F.atan2(y, dot(n1, n2))))


def tetra_volume(a: Vector, b: Vector, c: Vector, d: Vector) -> Column:
    return F.abs(dot(minus(a, d), cross(minus(b, d), minus(c, d)))) / 6


def rotated(v: Vector, axis: Vector, degrees: Column | float) -> Vector:
    """Rodrigues rotation about a unit axis."""
    t = F.radians(degrees if isinstance(degrees, Column) else F.lit(degrees))
    k, c, s = cross(axis, v), F.cos(t), F.sin(t)
    d = dot(axis, v) * (1 - c)
    return tuple(v[i] * c + k[i] * s + axis[i] * d for i in range(3))


def smallest_eigenvalue(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> Column:
    """Smallest eigenvalue of a symmetric 3x3 matrix in closed form."""
    q = (xx + yy + zz) / 3
    p = F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6)
    a, b, c, d, e, f = (xx - q) / p, (yy - q) / p, (zz - q) / p, xy / p, xz / p, yz / p
    r = (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2
    root = q + 2 * p * F.cos(F.acos(clamped(r)) / 3 + 2 * math.pi / 3)
    return F.when(p > 0, root).otherwise(q)


def plane_normal(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column, low: Column) -> Column:
    """Unit normal of the best plane: the longest cross product of rows of C - low * I.
    Not unique where the smallest eigenvalue repeats."""
    r = (xx - low, xy, xz), (xy, yy - low, yz), (xz, yz, zz - low)
    best = F.array_max(F.array(*[F.struct(dot(c, c).alias("q"), *[v.alias(k) for k, v in zip("xyz", c, strict=True)]) for c in (cross(r[0], r[1]), cross(r[0], r[2]), cross(r[1], r[2]))]))
    n = F.sqrt(best["q"])
    return F.when(n > 0, F.struct(*[(best[k] / n).alias(k) for k in "xyz"]))


def label(cn: Column, planar: Column, axial: Column, top_angle: Column) -> Column:
    """Geometry label before distortion, by coordination number."""
    return (
        F.when(cn == 2, F.when(top_angle >= 160, "LIN").otherwise("BEN"))
        .when(cn == 3, F.when(planar, "TP").otherwise("TS"))
        .when(cn == 4, F.when(planar, "SQP").otherwise("TD"))
        .when(cn == 5, F.when(axial & planar, "SPY").otherwise("TBP"))
        .when(cn == 6, "OH")
        .when(cn > 6, "HCN")
        .otherwise("UNK")
    )


#: Ideal angle that each label's deviation is measured against.
IDEAL = {"LIN": 180.0, "BEN": 120.0, "TP": 120.0, "TS": 90.0, "SQP": 90.0, "TD": 109.47, "SPY": 90.0, "TBP": 109.47, "OH": 90.0}


def ideal_angle(name: Column) -> Column:
    out = F.lit(None).cast("double")
    for k, v in IDEAL.items():
        out = F.when(name == k, v).otherwise(out)
    return out
