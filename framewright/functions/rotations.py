"""Rotations in any form, by the form's name: conversions, differences, sums and series at another rate. All forms meet in unit quaternions (x, y, z, w)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright.functions import series as fs
from framewright.functions.series import let

#: The names of forms, and how many numbers each has. Euler angles are about fixed axes.
FORMS = {"euler_xyz": 3, "euler_zyx": 3, "quat_xyzw": 4, "quat_wxyz": 4, "rot_6d": 6, "rot_vec": 3}


def _known(form: str) -> str:
    if form not in FORMS:
        raise ValueError(f"unknown form of rotation: {form}; known are {', '.join(FORMS)}")
    return form


def _parts(v: Column, n: int) -> list[Column]:
    return [F.get(v, F.lit(k)) for k in range(n)]


def _unit(q: Column) -> Column:
    return let(F.sqrt(F.aggregate(q, F.lit(0.0), lambda s, x: s + x * x)), lambda n: F.transform(q, lambda x: x / n))


def _of_vector(v: Column) -> Column:
    """cos and sin of half the angle; near no angle at all the sine's series."""
    half = lambda n: F.when(n < 1e-3, 0.5 - n * n / 48 + n * n * n * n / 3840).otherwise(F.sin(n / 2) / n)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return let(norm, lambda n: F.concat(F.transform(v, lambda x: x * half(n)), F.array(F.cos(n / 2))))


def _of_angles(v: Column, order: str) -> Column:
    """The three turns' quaternions multiplied: the first angle's turn comes first."""
    x, y, z = _parts(v, 3) if order == "xyz" else reversed(_parts(v, 3))
    (sx, cx), (sy, cy), (sz, cz) = ((F.sin(a / 2), F.cos(a / 2)) for a in (x, y, z))
    s = 1 if order == "xyz" else -1
    return F.array(sx * cy * cz - s * (cx * sy * sz), cx * sy * cz + s * (sx * cy * sz), cx * cy * sz - s * (sx * sy * cz), cx * cy * cz + s * (sx * sy * sz))


def to_quat(value: Column, form: str) -> Column:
    """A rotation as a unit quaternion x, y, z, w. Signs are kept: of a quaternion its own, of angles and vectors that of half the angle. A null rotation, or numbers of no length, are null or NaN."""
    match _known(form):
        case "quat_xyzw":
            return let(value, _unit)
        case "quat_wxyz":
            return let(value, lambda q: _unit(F.concat(F.slice(q, 2, 3), F.slice(q, 1, 1))))
        case "rot_6d":
            return fs.matrix_to_quat(fs.rot6d_to_matrix(value))
        case "rot_vec":
            return let(value, _of_vector)
    return let(value, lambda v: _of_angles(v, form.removeprefix("euler_")))


def _vector(q: Column) -> Column:
    """Axis times angle, of the two the shorter way round: at most half a turn."""
    x, y, z, w = _parts(q, 4)
    sign, size = F.when(w < 0, -1.0).otherwise(1.0), F.sqrt(x * x + y * y + z * z)
    angle = 2 * F.atan2(size, F.abs(w))
    scale = F.when(angle < 1e-3, 2 + angle * angle / 12 + 7 * angle * angle * angle * angle / 2880).otherwise(angle / size)
    return let(sign * scale, lambda s: F.transform(F.slice(q, 1, 3), lambda a: a * s))


def from_quat(quat: Column, form: str) -> Column:
    """A unit quaternion x, y, z, w in another form."""
    match _known(form):
        case "quat_xyzw":
            return quat
        case "quat_wxyz":
            return let(quat, lambda q: F.concat(F.slice(q, 4, 1), F.slice(q, 1, 3)))
        case "rot_6d":
            return fs.matrix_to_rot6d(fs.quat_to_matrix(quat))
        case "rot_vec":
            return let(quat, _vector)
    return fs.matrix_to_euler(fs.quat_to_matrix(quat), form.removeprefix("euler_"))


def converted(value: Column, source: str, target: str) -> Column:
    """A rotation in another form; in its own it stays as it is, to the last bit. A form that isn't known is an error."""
    if _known(source) == _known(target):
        return value
    return from_quat(to_quat(value, source), target)


def to_matrix(value: Column, form: str) -> Column:
    """Row-major 3x3."""
    return fs.rot6d_to_matrix(value) if _known(form) == "rot_6d" else fs.quat_to_matrix(to_quat(value, form))


def from_matrix(matrix: Column, form: str) -> Column:
    return fs.matrix_to_rot6d(matrix) if _known(form) == "rot_6d" else from_quat(fs.matrix_to_quat(matrix), form)


def difference(value: Column, form: str, state: Column, state_form: str) -> Column:
    """What turns the state into the rotation, in the rotation's form: the state's transpose times it."""
    return from_matrix(fs.matmul(to_matrix(state, state_form), to_matrix(value, form), True), form)


def together(delta: Column, form: str, state: Column, state_form: str) -> Column:
    """The state turned by a difference, in the difference's form."""
    return from_matrix(fs.matmul(to_matrix(state, state_form), to_matrix(delta, form)), form)


def vector_to_rot6d(vector: Column, layout: str = "interleaved") -> Column:
    """A rotation vector as six numbers: the matrix's first two columns row by row (interleaved), or one after the other (legacy)."""
    if layout not in ("interleaved", "legacy"):
        raise ValueError(f"unknown layout of six numbers: {layout}")
    six = converted(vector, "rot_vec", "rot_6d")
    return six if layout == "interleaved" else let(six, lambda v: F.array(*[F.get(v, F.lit(k)) for k in (0, 2, 4, 1, 3, 5)]))


def resampled(rotations: Column, form: str, source: Column, target: Column, n: Column, offset: Column | None = None) -> Column:
    """n rotations at target's rate from a series at source's, the first one offset source samples in: between neighbours the short way round, past both ends
    the last ones there; a series of one rotation is repeated as it is. rotations: an array of a form's arrays, which must not be empty."""
    start = F.lit(0.0) if offset is None else offset
    top = F.size(rotations) - 1

    def between(quats):
        def at(k):
            place = F.greatest(F.lit(0.0), F.least(top.cast("double"), start + k * source / target))
            low = F.floor(place).cast("int")
            return from_quat(fs.slerp(F.get(quats, low), F.get(quats, F.least(low + 1, top)), place - low), form)

        return F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), at)

    alone = F.array_repeat(F.get(rotations, F.lit(0)), n.cast("int"))
    return F.when(top == 0, alone).otherwise(let(F.transform(rotations, lambda v: to_quat(v, form)), between))
