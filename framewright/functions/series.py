"""Chunks and resampling of time series held as arrays, and rotations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def window_count(length: Column, chunk: int, step: Column) -> Column:
    """Windows of chunk samples, step apart, that fit length: starts are half a window apart."""
    span = F.lit(chunk - 1) * step + 1
    start = F.greatest(F.lit(1), F.expr("0") + F.floor(step * F.lit(chunk) / 2))
    return F.when(length < span, 0).otherwise(F.floor((length - span) / start) + 1).cast("long")


def chunk_count(length: Column, chunk: int, step: int) -> Column:
    """Chunks that cover a whole series, the last one moved back to end with it; one for a short series."""
    over = F.greatest(F.lit(0), length - chunk)
    return (F.floor(over / step) + 1 + F.when(over % step != 0, 1).otherwise(0)).cast("long")


def chunk_starts(length: Column, chunk: int, step: int) -> Column:
    last = F.greatest(F.lit(0), length - chunk).cast("long")
    return F.transform(F.sequence(F.lit(0).cast("long"), chunk_count(length, chunk, step) - 1), lambda k: F.least(k * step, last))


def gather(series: Column, start: Column, step: Column, chunk: int) -> Column:
    """chunk samples from start, step apart; past the end the last one."""
    return F.transform(F.sequence(F.lit(0), F.lit(chunk - 1)), lambda k: F.get(series, F.least(start + k * step, F.size(series) - 1).cast("int")))


def pad_to(series: Column, n: int) -> Column:
    """At least n samples, the last repeated."""
    return F.concat(series, F.array_repeat(F.element_at(series, -1), F.greatest(F.lit(0), F.lit(n) - F.size(series))))


def resampled_length(n: Column, source: Column, target: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(n * target / source, 0).cast("int"))


def resample(series: Column, source: Column, target: Column, n: Column, linear: bool = True) -> Column:
    """n samples at target's rate from a series at source's: between neighbours, or the nearest (half-even)."""
    top = (F.size(series) - 1).cast("double")
    place = lambda k: F.least(top, k * source / target)
    if not linear:
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.get(series, F.bround(place(k), 0).cast("int")))

    def between(k):
        low = F.floor(place(k)).cast("int")
        a, b, w = F.get(series, low), F.get(series, F.least(low + 1, top.cast("int"))), place(k) - low
        return a * (1 - w) + b * w

    return F.transform(F.sequence(F.lit(0), n - 1), between)


def delta_to_first(series: Column) -> Column:
    return F.transform(series, lambda x: x - F.get(series, F.lit(0)))


def covering_slice(start: Column, end: Column, n: Column, source: Column, target: Column) -> Column:
    """The source samples that target samples [start, end) need: first, last (exclusive), and the offset of the first target sample within them."""
    ratio = source / target
    first = F.floor(start * ratio).cast("long")
    last = F.least(n, F.greatest(F.ceil((end - 1) * ratio).cast("long") + 2, first + 1))
    return F.struct(first.alias("first"), last.alias("last"), (start * ratio - first).alias("offset"))


def finer(series: Column, times: int) -> Column:
    """A series on a grid times as fine, between its first and last sample, by straight lines."""
    if times == 1:
        return series
    grid = F.sequence(F.lit(0), (F.size(series) - 1) * times)

    def at(k):
        low, w = F.floor(k / times).cast("int"), (k % times) / times
        return F.get(series, low) * (1 - w) + F.coalesce(F.get(series, low + 1), F.lit(0.0)) * w

    return F.transform(grid, at)


def in_frames(index: Column, n: Column) -> Column:
    """The index; one outside of [0, n) is an error where it's met."""
    return F.when((index >= 0) & (index < n), index).otherwise(F.raise_error(F.concat(F.lit("frame out of range: "), index.cast("string"))).cast("long"))


def _dot(a, b):
    return sum((x * y for x, y in zip(a, b)), F.lit(0.0))


def _cross(a, b):
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def quat_to_matrix(q: Column) -> Column:
    """Row-major 3x3 from x, y, z, w."""
    return let(q, _quat_to_matrix)


def _quat_to_matrix(q: Column) -> Column:
    x, y, z, w = (F.get(q, F.lit(k)) for k in range(4))
    n = x * x + y * y + z * z + w * w
    s = F.lit(2.0) / n
    return F.array(
        1 - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w), s * (x * y + z * w), 1 - s * (x * x + z * z), s * (y * z - x * w),
        s * (x * z - y * w), s * (y * z + x * w), 1 - s * (x * x + y * y),
    )


def matrix_to_rot6d(m: Column) -> Column:
    """The first two columns, row by row."""
    return let(m, _matrix_to_rot6d)


def _matrix_to_rot6d(m: Column) -> Column:
    return F.array(*[F.get(m, F.lit(3 * r + c)) for r in range(3) for c in range(2)])


def rot6d_to_matrix(r: Column, eps: float = 1e-9) -> Column:
    """Gram-Schmidt of the two columns, and their cross product."""
    return let(r, lambda v: _rot6d_to_matrix(v, eps))


def _rot6d_to_matrix(r: Column, eps: float = 1e-9) -> Column:
    part = lambda v: [F.get(v, F.lit(k)) for k in range(3)]
    unit = lambda v: F.transform(v, lambda x: x / F.greatest(F.sqrt(_dot(part(v), part(v))), F.lit(eps)))
    first, second = (F.array(*[F.get(r, F.lit(2 * k + c)) for k in range(3)]) for c in range(2))
    upright = lambda a: let(let(second, lambda v: F.zip_with(v, a, lambda y, x: y - _dot(part(a), part(v)) * x)), unit)
    rows = lambda a, b: F.array(*[v[k] for k in range(3) for v in (part(a), part(b), _cross(part(a), part(b)))])
    return let(let(first, unit), lambda a: let(upright(a), lambda b: rows(a, b)))


def rotvec_to_matrix(v: Column) -> Column:
    """Rodrigues' formula."""
    return let(v, _rotvec_to_matrix)


def _rotvec_to_matrix(v: Column) -> Column:
    x, y, z = (F.get(v, F.lit(k)) for k in range(3))
    t = F.sqrt(x * x + y * y + z * z)
    s, c = F.when(t < 1e-8, 1.0).otherwise(F.sin(t) / t), F.when(t < 1e-8, 0.5).otherwise((1 - F.cos(t)) / (t * t))
    return F.array(
        1 - c * (y * y + z * z), c * x * y - s * z, c * x * z + s * y, c * x * y + s * z, 1 - c * (x * x + z * z), c * y * z - s * x,
        c * x * z - s * y, c * y * z + s * x, 1 - c * (x * x + y * y),
    )


def quat_to_rotvec(q: Column) -> Column:
    """Axis times angle, of x, y, z, w with w clipped to [-1, 1]; the sign is kept as it is."""
    return let(q, _quat_to_rotvec)


def _quat_to_rotvec(q: Column) -> Column:
    w = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.get(q, F.lit(3))))
    size = F.sqrt(1 - w * w)
    return F.transform(F.slice(q, 1, 3), lambda x: F.when(size < 1e-8, 0.0).otherwise(x * 2 * F.acos(w) / size))


def matmul(a: Column, b: Column, transpose: bool = False) -> Column:
    """a b, or a's transpose times b, row-major 3x3."""
    return let(a, lambda x: let(b, lambda y: _matmul(x, y, transpose)))


def _matmul(a: Column, b: Column, transpose: bool = False) -> Column:
    at = lambda m, r, c: F.get(m, F.lit(3 * r + c))
    return F.array(*[sum((at(a, k, r) if transpose else at(a, r, k)) * at(b, k, c) for k in range(3)) for r in range(3) for c in range(3)])


def _at(m: Column, r: int, c: int) -> Column:
    return F.get(m, F.lit(3 * r + c))


def euler_to_matrix(e: Column, order: str) -> Column:
    """Row-major 3x3 of angles about fixed axes, applied in order (xyz or zyx)."""
    return let(e, lambda v: _euler_to_matrix(v, order))


def _euler_to_matrix(e: Column, order: str) -> Column:
    a, b, c = (F.get(e, F.lit(k)) for k in range(3))
    x, y, z = (a, b, c) if order == "xyz" else (c, b, a)
    sx, cx, sy, cy, sz, cz = (f(t) for t in (x, y, z) for f in (F.sin, F.cos))
    if order == "xyz":
        return F.array(cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx, sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx, -sy, cy * sx, cy * cx)
    return F.array(cy * cz, -cy * sz, sy, cx * sz + sx * sy * cz, cx * cz - sx * sy * sz, -sx * cy, sx * sz - cx * sy * cz, sx * cz + cx * sy * sz, cx * cy)


def matrix_to_euler(m: Column, order: str) -> Column:
    """The angles of euler_to_matrix; where the first and last axis fall together the last angle is 0."""
    return let(m, lambda v: _matrix_to_euler(v, order))


def _matrix_to_euler(m: Column, order: str) -> Column:
    unit = lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))
    if order == "xyz":
        middle, locked = F.asin(unit(-_at(m, 2, 0))), F.abs(_at(m, 2, 0)) > 1 - 1e-7
        first, last = F.atan2(_at(m, 2, 1), _at(m, 2, 2)), F.atan2(_at(m, 1, 0), _at(m, 0, 0))
        alone = F.when(_at(m, 2, 0) < 0, F.atan2(_at(m, 0, 1), _at(m, 1, 1))).otherwise(F.atan2(-_at(m, 0, 1), _at(m, 1, 1)))
    else:
        middle, locked = F.asin(unit(_at(m, 0, 2))), F.abs(_at(m, 0, 2)) > 1 - 1e-7
        first, last = F.atan2(-_at(m, 0, 1), _at(m, 0, 0)), F.atan2(-_at(m, 1, 2), _at(m, 2, 2))
        alone = F.atan2(_at(m, 1, 0), _at(m, 1, 1))
    return F.array(F.when(locked, alone).otherwise(first), middle, F.when(locked, 0.0).otherwise(last))


def matrix_to_quat(m: Column) -> Column:
    """x, y, z, w, by the largest of the four: no division by a small number."""
    return let(m, _matrix_to_quat)


def _matrix_to_quat(m: Column) -> Column:
    xx, yy, zz = (_at(m, k, k) for k in range(3))
    w2, x2, y2, z2 = 1 + xx + yy + zz, 1 + xx - yy - zz, 1 - xx + yy - zz, 1 - xx - yy + zz
    most = F.greatest(w2, x2, y2, z2)
    s = 2 * F.sqrt(most)
    d = lambda a, b, c, e, sign: (_at(m, a, b) + sign * _at(m, c, e)) / s
    rx, ry, rz = d(2, 1, 1, 2, -1), d(0, 2, 2, 0, -1), d(1, 0, 0, 1, -1)
    xy, xz, yz = d(0, 1, 1, 0, 1), d(0, 2, 2, 0, 1), d(1, 2, 2, 1, 1)
    return (
        F.when(most == w2, F.array(rx, ry, rz, s / 4)).when(most == x2, F.array(s / 4, xy, xz, rx))
        .when(most == y2, F.array(xy, s / 4, yz, ry)).otherwise(F.array(xz, yz, s / 4, rz))
    )


def slerp(a: Column, b: Column, w: Column) -> Column:
    """The rotation a share w of the way from quaternion a to b, the short way round."""
    return let(a, lambda x: let(b, lambda y: _slerp(x, y, w)))


def _slerp(a: Column, b: Column, w: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    sign, near = F.when(dot < 0, -1.0).otherwise(1.0), F.least(F.lit(1.0), F.abs(dot))
    angle = F.acos(near)
    u = F.when(angle < 1e-9, 1 - w).otherwise(F.sin((1 - w) * angle) / F.sin(angle))
    v = F.when(angle < 1e-9, w).otherwise(F.sin(w * angle) / F.sin(angle)) * sign
    return F.zip_with(a, b, lambda x, y: x * u + y * v)


def matrix_to_rotvec(m: Column) -> Column:
    """Axis times angle, by the trace, which is kept a little within its bounds."""
    return let(m, _matrix_to_rotvec)


def _matrix_to_rotvec(m: Column) -> Column:
    cosine = F.greatest(F.lit(-1 + 1e-7), F.least(F.lit(1 - 1e-7), (_at(m, 0, 0) + _at(m, 1, 1) + _at(m, 2, 2) - 1) / 2))
    angle = F.acos(cosine)
    scale = F.when(F.abs(angle) < 1e-6, 0.5).otherwise(angle / (2 * F.greatest(F.sin(angle), F.lit(1e-8))))
    return F.array((_at(m, 2, 1) - _at(m, 1, 2)) * scale, (_at(m, 0, 2) - _at(m, 2, 0)) * scale, (_at(m, 1, 0) - _at(m, 0, 1)) * scale)


def relative_pose(r1: Column, t1: Column, r2: Column, t2: Column) -> Column:
    """Of two camera poses (row-major rotation and translation, world to camera) the second after the first undone: rotation vector and translation, six numbers."""
    return let(r1, lambda a: let(t1, lambda p: let(r2, lambda b: let(t2, lambda q: _relative_pose(a, p, b, q)))))


def _relative_pose(r1: Column, t1: Column, r2: Column, t2: Column) -> Column:
    turned = F.array(*[sum(_at(r2, r, k) * _at(r1, c, k) for k in range(3)) for r in range(3) for c in range(3)])
    moved = lambda m: F.array(*[F.get(t2, F.lit(r)) - sum(_at(m, r, k) * F.get(t1, F.lit(k)) for k in range(3)) for r in range(3)])
    return let(turned, lambda m: F.concat(matrix_to_rotvec(m), moved(m)))
