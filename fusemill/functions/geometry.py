"""Camera geometry as column expressions; poses are arrays of 16 doubles, row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rigid_inverse(p: Column) -> Column:
    """Transposed rotation, and minus it times the translation."""
    rows = []
    for i in range(3):
        rows += [p[4 * j + i] for j in range(3)]
        rows.append(-(p[i] * p[3] + p[4 + i] * p[7] + p[8 + i] * p[11]))
    return F.array(*rows, *(F.lit(float(v)) for v in (0, 0, 0, 1)))


def affine_inverse(p: Column) -> Column:
    """General inverse of an affine matrix by cofactors; null where it is singular."""
    m = lambda i, j: p[4 * i + j]
    cof = lambda i, j: m((i + 1) % 3, (j + 1) % 3) * m((i + 2) % 3, (j + 2) % 3) - m((i + 1) % 3, (j + 2) % 3) * m((i + 2) % 3, (j + 1) % 3)
    det = m(0, 0) * cof(0, 0) + m(0, 1) * cof(0, 1) + m(0, 2) * cof(0, 2)
    inv = [[F.try_divide(cof(j, i), det) for j in range(3)] for i in range(3)]
    rows = []
    for i in range(3):
        rows += [*inv[i], -(inv[i][0] * p[3] + inv[i][1] * p[7] + inv[i][2] * p[11])]
    return F.array(*rows, *(F.lit(float(v)) for v in (0, 0, 0, 1)))


def matmul4(a: Column, b: Column) -> Column:
    return F.array(*(sum((a[4 * i + k] * b[4 * k + j] for k in range(1, 4)), a[4 * i] * b[j]) for i in range(4) for j in range(4)))


def pose(r: list[Column], t: list[Column]) -> Column:
    """16 values of a rotation (nine columns) and a translation."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(*r[:3], t[0], *r[3:6], t[1], *r[6:9], t[2], zero, zero, zero, one)


def apply(p: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return tuple(p[4 * i] * x + p[4 * i + 1] * y + p[4 * i + 2] * z + p[4 * i + 3] for i in range(3))


def project(p_inv: Column, x: Column, y: Column, z: Column, fx, fy, cx, cy) -> tuple[Column, Column, Column]:
    """Pixel column and row (truncated toward zero; null where they are no numbers) and camera depth."""
    a, b, c = apply(p_inv, x, y, z)
    u = (fx * a + cx * c) / (c + F.lit(1e-6))
    v = (fy * b + cy * c) / (c + F.lit(1e-6))
    return u.try_cast("int"), v.try_cast("int"), c


def backproject(p: Column, u: Column, v: Column, depth: Column, fx, fy, cx, cy) -> tuple[Column, Column, Column]:
    return apply(p, (u - cx) * depth / fx, (v - cy) * depth / fy, depth)


def rotvec_to_matrix(rx: Column, ry: Column, rz: Column) -> list[Column]:
    """Nine values of the rotation about (rx, ry, rz) by its length; the identity for a zero vector."""
    angle = F.sqrt(rx * rx + ry * ry + rz * rz)
    safe = F.when(angle == 0, 1.0).otherwise(angle)
    k = [rx / safe, ry / safe, rz / safe]
    s, c1 = F.sin(angle), 1 - F.cos(angle)
    cross = [[F.lit(0.0), -k[2], k[1]], [k[2], F.lit(0.0), -k[0]], [-k[1], k[0], F.lit(0.0)]]
    out = []
    for i in range(3):
        for j in range(3):
            square = k[i] * k[j] - (k[0] * k[0] + k[1] * k[1] + k[2] * k[2] if i == j else F.lit(0.0))
            out.append((1.0 if i == j else 0.0) + s * cross[i][j] + c1 * square)
    return out


def finite(p: Column) -> Column:
    """True if all values are numbers."""
    return F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def box_iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of boxes given by x0, y0, x1, y1."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    area = lambda q: (q["x1"] - q["x0"]) * (q["y1"] - q["y0"])
    inter = side("x0", "x1") * side("y0", "y1")
    return F.try_divide(inter, area(a) + area(b) - inter)


def normalize_color(value: Column, mean: float, std: float) -> Column:
    return (value / 255 - mean) / std


def fov_intrinsics(w: Column, h: Column, degrees: float = 90.0) -> tuple[Column, Column, Column, Column]:
    f = w / 2 / F.tan(F.radians(F.lit(degrees)) / 2)
    return f, f, (w - 1) / 2, (h - 1) / 2
