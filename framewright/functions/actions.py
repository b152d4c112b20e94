"""Actions of robots with up to two arms as rows of 81 numbers, and back: fixed slots, a mask, normalisation and states by a schema.

An action or a state is a dict of columns by field: an array of doubles, null where the robot has no such field. A schema is a map column by field, null or without a
key where the robot has no such field, of structs: dim int, is_relative boolean, allow_relative boolean, and mean, std, min, max, q01, q99 (arrays of doubles, as long
as dim). So robots of many kinds stand in one table, each row with its robot's schema joined to it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright.functions import rotations as fr
from framewright.functions import series as fs
from framewright.functions.scalar import denormalize, normalize
from framewright.functions.series import let

#: The slots of an action's fields, [first, end).
SLOTS = {
    "left_arm_joint_position": (0, 7),
    "right_arm_joint_position": (7, 14),
    "left_arm_eef_position": (14, 17),
    "left_arm_eef_rotation": (17, 23),
    "right_arm_eef_position": (23, 26),
    "right_arm_eef_rotation": (26, 32),
    "left_gripper": (32, 33),
    "right_gripper": (33, 34),
    "left_hand": (34, 54),
    "right_hand": (54, 74),
    "torso": (74, 78),
    "head": (78, 81),
}
WIDTH = 81
#: What stands in a rotation's slot that nothing fills, no turn at all.
NO_TURN = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
STATISTICS = ("mean", "std", "min", "max", "q01", "q99")
SCHEMA = "map<string, struct<dim: int, is_relative: boolean, allow_relative: boolean, " + ", ".join(f"{s}: array<double>" for s in STATISTICS) + ">>"


def is_rotation(field: str) -> bool:
    return field.endswith("_rotation")


def _error(message: str, kind: str) -> Column:
    return F.raise_error(F.lit(message)).cast(kind)


def _known(fields: dict[str, Column]) -> dict[str, Column]:
    if unknown := fields.keys() - SLOTS.keys():
        raise ValueError(f"no slots for {', '.join(sorted(unknown))}")
    return fields


def _leaf(schema: Column, field: str) -> Column:
    return F.try_element_at(schema, F.lit(field))


def _by_place(value: Column, leaf: Column, method: str, rule) -> Column:
    """A rule with each number's own statistics; without a leaf the value as it is. Statistics of another length than the value are an error."""
    names = [s for s in STATISTICS if (s in ("mean", "std") if method == "mean_std" else s in ("q01", "q99") if method == "q01_q99" else s in ("min", "max"))]
    if method not in ("mean_std", "min_max", "min_max_sym", "q01_q99"):
        raise ValueError(f"unknown normalisation: {method}")
    long = F.coalesce(*[F.when(F.coalesce(F.size(leaf[s]) != F.size(value), F.lit(True)), F.lit(s)) for s in names])

    def at(v, k):
        return rule(v, method, F.struct(*[F.get(leaf[s], k).alias(s) for s in names]))

    return F.when(leaf.isNull() | value.isNull(), value).when(long.isNotNull(), _error(f"statistics for {method} don't fit the field", "array<double>")).otherwise(F.transform(value, at))


def _first(n: Column, width: int) -> Column:
    """width booleans, of which the first n are true."""
    return let(n, lambda count: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: k < count))


def _pairs(fields: dict[str, Column]) -> Column:
    """True; an arm with a position and no rotation of its end, or the other way round, is an error."""
    fine = F.lit(True)
    for arm in ("left_arm", "right_arm"):
        have = [fields[f].isNotNull() if f in fields else F.lit(False) for f in (f"{arm}_eef_position", f"{arm}_eef_rotation")]
        fine = fine & F.when(have[0] == have[1], True).otherwise(_error(f"{arm}: position and rotation of its end belong together", "boolean"))
    return fine


def flattened(fields: dict[str, Column], schema: Column, method: str = "mean_std", form: str = "rot_6d") -> Column:
    """A struct of values (81 numbers) and mask (81 booleans, true where a field fills the slot).

    Rotations (in the given form) become six numbers; then every field that the schema has is normalised, the others stay as they are. What nothing fills is 0, in the slots of
    rotations no turn. A field longer than its slot is an error, as is a field without a slot.
    """
    _known(fields)
    values, masks = [], []
    for field, (first, end) in SLOTS.items():
        width, empty = end - first, NO_TURN if is_rotation(field) else [0.0] * (end - first)
        blank, off = F.array(*map(F.lit, empty)), F.array_repeat(F.lit(False), width)
        if field not in fields:
            values, masks = [*values, blank], [*masks, off]
            continue
        value = fr.converted(fields[field], form, "rot_6d") if is_rotation(field) else fields[field]
        value = _by_place(value, _leaf(schema, field), method, normalize)
        size = F.size(fields[field]) if not is_rotation(field) else F.lit(6)
        fits = lambda filled, kind: F.when(fields[field].isNotNull() & (size > width), _error(f"{field} is longer than its {width} slots", kind)).otherwise(filled)  # noqa: B023, E731
        values.append(F.coalesce(fits(F.concat(value, F.array_repeat(F.lit(0.0), F.lit(width) - size)), "array<double>"), blank))
        masks.append(F.coalesce(F.when(fields[field].isNotNull(), _first(size, width)), off))
    return F.when(_pairs(fields), F.struct(F.concat(*values).alias("values"), F.concat(*masks).alias("mask")))


def slot_mask(schema: Column) -> Column:
    """The mask of a robot's actions by its schema alone; a rotation's slots go with the position of that arm's end."""
    masks = []
    for field, (first, end) in SLOTS.items():
        leaf = _leaf(schema, field.replace("_rotation", "_position"))
        dim = F.when(leaf.isNull(), 0).otherwise(F.lit(6) if is_rotation(field) else leaf["dim"])
        masks.append(_first(dim, end - first))
    return F.concat(*masks)


def unflattened(values: Column, schema: Column, method: str = "mean_std") -> dict[str, Column]:
    """The fields that a schema has, out of 81 numbers: denormalised, rotations as six numbers whose columns are at right angles and of length 1."""
    out = {}
    for field, (first, _) in SLOTS.items():
        leaf = _leaf(schema, field)
        part = F.when(leaf.isNotNull(), F.slice(values, F.lit(first + 1), F.lit(6) if is_rotation(field) else leaf["dim"]))
        part = _by_place(part, leaf, method, denormalize)
        out[field] = F.when(part.isNotNull(), fs.matrix_to_rot6d(fs.rot6d_to_matrix(part))) if is_rotation(field) else part
    return out


def _paired(field: str, a: Column, b: Column, rule) -> Column:
    """A rule number by number; an action and a state of other lengths are an error."""
    fits = F.coalesce(F.size(a) == F.size(b), F.lit(True))
    return F.when(fits, F.zip_with(a, b, rule)).otherwise(_error(f"{field}: action and state differ in length", "array<double>"))


def relative(fields: dict[str, Column], state: dict[str, Column], allowed: dict[str, Column], form: str = "rot_6d", state_form: str = "rot_6d") -> dict[str, Column]:
    """Fields less the state's: positions subtracted, rotations by what turns the state into them. A field that isn't allowed (a boolean a field; without an entry it is), or that
    the state lacks, stays absolute."""
    out = {}
    for field, value in _known(fields).items():
        other = state.get(field)
        if other is None:
            out[field] = value
            continue
        less = fr.difference(value, form, other, state_form) if is_rotation(field) else _paired(field, value, other, lambda a, b: a - b)
        out[field] = F.when(F.coalesce(allowed.get(field, F.lit(True)), F.lit(True)) & other.isNotNull(), less).otherwise(value)
    return out


def absolute(fields: dict[str, Column], state: dict[str, Column], schema: Column, form: str = "rot_6d", state_form: str = "rot_6d") -> dict[str, Column]:
    """Fields (rotations in the given form) and the state put together, rotations then in the state's form. A field whose schema doesn't allow it, or that the state lacks, stays as it is; one that is allowed but not
    relative is an error."""
    out = {}
    for field, value in _known(fields).items():
        other, leaf = state.get(field), _leaf(schema, field)
        whole = fr.converted(value, form, state_form) if is_rotation(field) else value
        if other is None:
            out[field] = whole
            continue
        both = fr.converted(fr.together(value, form, other, state_form), form, state_form) if is_rotation(field) else _paired(field, value, other, lambda a, b: a + b)
        due = F.coalesce(leaf["allow_relative"], F.lit(True)) & other.isNotNull() & value.isNotNull()
        wrong = _error(f"{field} is absolute already", "array<double>")
        out[field] = F.when(due & ~F.coalesce(leaf["is_relative"], F.lit(False)), wrong).when(due, both).otherwise(whole)
    return out


def previous(fields: dict[str, Column], state: dict[str, Column], schema: Column, method: str = "mean_std", form: str = "rot_6d", state_form: str = "rot_6d") -> Column:
    """Absolute actions of before as a model reads them: less the state where the schema's fields are relative, then flattened."""
    allowed = {f: F.when(_leaf(schema, f).isNotNull(), F.coalesce(_leaf(schema, f)["is_relative"], F.lit(False))) for f in fields}
    return flattened(relative(fields, state, allowed, form, state_form), schema, method, form)


def restored(values: Column, schema: Column, state: dict[str, Column], method: str = "mean_std", state_form: str = "rot_6d") -> dict[str, Column]:
    """What a model gives, as absolute actions: unflattened, put together with the state, rotations in the state's form."""
    return absolute(unflattened(values, schema, method), state, schema, "rot_6d", state_form)
