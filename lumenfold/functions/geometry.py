"""Rotations and rigid motions as Column expressions. Quaternions are (w, x, y, z) arrays, 3 x 3
matrices arrays of nine by rows, vectors arrays of three."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

EPS = 1e-15


def unit(q: Column, n: int = 4) -> Column:
    length = lambda q: F.sqrt(sum((q[i] * q[i] for i in range(1, n)), q[0] * q[0]))
    return let(q, lambda q: let(length(q), lambda d: F.transform(q, lambda v: F.try_divide(v, d))))


def dot(a: Column, b: Column, n: int) -> Column:
    return sum((a[i] * b[i] for i in range(1, n)), a[0] * b[0])


def conjugate(q: Column) -> Column:
    return F.array(q[0], -q[1], -q[2], -q[3])


def product(a: Column, b: Column) -> Column:
    """Hamilton product."""
    return F.array(
        a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3], a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
        a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1], a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0],
    )


def standard_sign(q: Column) -> Column:
    return let(q, lambda q: F.when(q[0] < 0, F.transform(q, lambda v: -v)).otherwise(q))


def matrix(q: Column) -> Column:
    """Rotation matrix of a unit quaternion."""

    def of(q: Column) -> Column:
        w, x, y, z = (q[i] for i in range(4))
        return F.array(
            1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
            2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
        )

    return let(q, of)


def quaternion(m: Column) -> Column:
    """Unit quaternion of a rotation matrix, by its largest component, with w >= 0."""

    def of(m: Column) -> Column:
        c = lambda i, j: m[3 * i + j]
        t = [1 + c(0, 0) + c(1, 1) + c(2, 2), 1 + c(0, 0) - c(1, 1) - c(2, 2), 1 - c(0, 0) + c(1, 1) - c(2, 2), 1 - c(0, 0) - c(1, 1) + c(2, 2)]
        by = [
            F.array(t[0], c(2, 1) - c(1, 2), c(0, 2) - c(2, 0), c(1, 0) - c(0, 1)), F.array(c(2, 1) - c(1, 2), t[1], c(1, 0) + c(0, 1), c(0, 2) + c(2, 0)),
            F.array(c(0, 2) - c(2, 0), c(1, 0) + c(0, 1), t[2], c(2, 1) + c(1, 2)), F.array(c(1, 0) - c(0, 1), c(0, 2) + c(2, 0), c(2, 1) + c(1, 2), t[3]),
        ]
        return let(F.greatest(*t), lambda most: F.when(t[0] == most, by[0]).when(t[1] == most, by[1]).when(t[2] == most, by[2]).otherwise(by[3]))

    return standard_sign(unit(let(m, of)))


def rotate(m: Column, v: Column) -> Column:
    return F.array(*[m[3 * i] * v[0] + m[3 * i + 1] * v[1] + m[3 * i + 2] * v[2] for i in range(3)])


def transpose(m: Column) -> Column:
    return F.array(*[m[3 * j + i] for i in range(3) for j in range(3)])


def matmul(a: Column, b: Column) -> Column:
    return F.array(*[a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)])


def add(a: Column, b: Column) -> Column:
    return F.array(*[a[i] + b[i] for i in range(3)])


def sub(a: Column, b: Column) -> Column:
    return F.array(*[a[i] - b[i] for i in range(3)])


def inverse_pose(m: Column, t: Column) -> tuple[Column, Column]:
    """Of x -> m x + t."""
    back = transpose(m)
    return back, F.transform(rotate(back, t), lambda v: -v)


def relative_pose(m1: Column, t1: Column, m2: Column, t2: Column) -> tuple[Column, Column]:
    """Second pose after undoing the first: m2 m1', t2 - m2 m1' t1."""
    m = matmul(m2, transpose(m1))
    return m, sub(t2, rotate(m, t1))


def rotation_error(p: Column, q: Column) -> Column:
    """Degrees between two unit quaternions, whichever their signs."""
    loss = F.greatest(1 - F.pow(dot(p, q, 4), F.lit(2.0)), F.lit(EPS))
    return F.degrees(F.acos(F.greatest(1 - 2 * loss, F.lit(-1.0))))


def translation_error(p: Column, q: Column) -> Column:
    """Degrees between two directions, opposite ones being equal; a million if undefined."""
    length = lambda v: F.sqrt(dot(v, v, 3))
    c = F.try_divide(dot(p, q, 3), length(p) * length(q))
    loss = F.greatest(1 - c * c, F.lit(EPS))
    return F.coalesce(F.degrees(F.acos(F.sqrt(F.greatest(1 - loss, F.lit(0.0))))), F.lit(1e6))


def unproject(u: Column, v: Column, depth: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """Camera point of a pixel with depth."""
    return F.array((u - cx) / fx * depth, (v - cy) / fy * depth, depth)


def project(p: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """Pixel of a camera point; null behind the camera."""
    return F.when(p[2] > 0, F.array(p[0] / p[2] * fx + cx, p[1] / p[2] * fy + cy))


def lerp(a: Column, b: Column, s: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + (y - x) * s)


def ray(u: Column, v: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """Unit direction of a pixel from the camera."""
    from .binding import let

    return let(F.array((u - cx) / fx, (v - cy) / fy, F.lit(1.0)), lambda d: F.transform(d, lambda x: x / F.sqrt(dot(d, d, 3))))


def turned_intrinsics(fx: Column, fy: Column, cx: Column, cy: Column, width: Column, height: Column, quarters: int) -> Column:
    """(fx, fy, cx, cy, width, height) of an image turned by quarter turns clockwise."""
    for _ in range(quarters % 4):
        fx, fy, cx, cy, width, height = fy, fx, height - 1 - cy, cx, height, width
    return F.struct(*[c.alias(n) for c, n in zip((fx, fy, cx, cy, width, height), ("fx", "fy", "cx", "cy", "width", "height"), strict=True)])


def projection_camera(r: Column, t: Column, scale: float = 1.0) -> tuple[Column, Column]:
    """Rotation and shift (x right, y down) of a camera given with x left and y up and its rotation by
    columns; lengths are divided by `scale`."""
    turned = F.array(*[(-1 if j < 2 else 1) * r[3 * i + j] for j in range(3) for i in range(3)])
    return turned, F.array(*[(-1 if i < 2 else 1) * t[i] / scale for i in range(3)])


def projection_intrinsics(focal: Column, principal: Column, width: Column, height: Column) -> Column:
    """(fx, fy, cx, cy) in pixels of a focal length and a principal point given in halves of the shorter side."""
    half = F.least(width, height) / 2.0
    return F.struct(*[(focal[i] * half).alias(n) for i, n in enumerate(("fx", "fy"))], *[(size / 2.0 - principal[i] * half).alias(n) for i, (size, n) in enumerate(((width, "cx"), (height, "cy")))])


def axes_cycled(pose: Column) -> tuple[Column, Column]:
    """(x, y, z, qx, qy, qz, qw) with z forward and y down from x forward and z down: quaternion (w, x, y, z)
    and shift with each axis in the place of the one behind it."""
    return F.array(pose[6], pose[4], pose[5], pose[3]), F.array(pose[1], pose[2], pose[0])


#: Axes of a game engine's world (x forward, y right, z up) to a camera's (x right, y down, z forward).
ENGINE_AXES = (0, 1, 0, 0, 0, -1, 1, 0, 0)


def engine_camera(pose: Column, unit_: float = 100.0) -> tuple[Column, Column]:
    """Rotation and shift of a camera from (x, y, z, qx, qy, qz, qw) in the engine's axes and centimetres."""
    axes = F.array(*[F.lit(float(v)) for v in ENGINE_AXES])
    m = let(matrix(F.array(pose[6], pose[3], pose[4], pose[5])), lambda m: let(matmul(axes, m), lambda a: matmul(a, transpose(axes))))
    return m, let(F.array(*[pose[i] / unit_ for i in range(3)]), lambda t: rotate(axes, t))


def cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def look_at(camera: Column, target: Column) -> tuple[Column, Column]:
    """World-to-camera rotation and shift of a camera that looks at a point, y being up in the world and
    down in the image."""

    # each axis is named, as the next ones use it many times
    named = lambda v: lambda body: let(unit(v, 3), body)
    down = lambda x, z: lambda y: F.concat(x, F.transform(y, lambda v: -v), z)
    aside = lambda z: lambda x: named(cross(x, z))(down(x, z))
    m = named(sub(target, camera))(lambda z: named(cross(z, F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))))(aside(z)))
    return m, let(m, lambda m: F.transform(rotate(m, camera), lambda v: -v))


def shifted_intrinsics(k: Column, by: float) -> Column:
    """(fx, fy, cx, cy) with the principal point moved: by 0.5 from pixel centres at whole numbers to ones
    at halves, by -0.5 back."""
    return F.struct(k["fx"].alias("fx"), k["fy"].alias("fy"), (k["cx"] + by).alias("cx"), (k["cy"] + by).alias("cy"))


def pixel_grid(width: Column, height: Column, x0: int = 0, y0: int = 0) -> Column:
    """(x, y) of all pixels, line by line."""
    lines = F.transform(F.sequence(F.lit(y0), height - 1 + y0), lambda y: F.transform(F.sequence(F.lit(x0), width - 1 + x0), lambda x: F.named_struct(F.lit("x"), x, F.lit("y"), y)))
    return F.flatten(lines)


def transformed(m: Column, p: Column, n: int, norm: bool = False) -> Column:
    """A point of n numbers under a matrix of n by n or n + 1 by n + 1, by rows; the last column of the
    larger one shifts. norm: divided by its last number."""
    larger = F.size(m) == (n + 1) * (n + 1)
    at = lambda i, j: F.when(larger, F.get(m, F.lit(i * (n + 1) + j))).otherwise(F.get(m, F.lit(i * n + j)))
    out = [sum((at(i, j) * p[j] for j in range(1, n)), at(i, 0) * p[0]) + F.when(larger, F.get(m, F.lit(i * (n + 1) + n))).otherwise(0.0) for i in range(n)]
    return let(F.array(*out), lambda v: F.transform(v, lambda x: x / v[n - 1])) if norm else F.array(*out)


def turned_camera(k: Column, m: Column, width: Column, height: Column, clockwise: bool) -> tuple[Column, Column]:
    """Intrinsics (fx, fy, cx, cy) and camera-to-world rotation of an image turned by a quarter, pixels being
    counted from their corners; the camera's place stays."""
    cx, cy = (height - k["cy"], k["cx"]) if clockwise else (k["cy"], width - k["cx"])
    s = 1 if clockwise else -1
    rows = [[s * m[3 + j] for j in range(3)], [-s * m[j] for j in range(3)], [m[6 + j] for j in range(3)]]
    return F.struct(k["fy"].alias("fx"), k["fx"].alias("fy"), cx.alias("cx"), cy.alias("cy")), F.array(*[v for r in rows for v in r])
