"""Names, paths, captions and small numeric rules as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: View roles in order; the position is the role's number.
ROLES = ["head", "left_wrist", "right_wrist", "front_third", "side_left", "side_right"]
#: Aspect buckets (name, height, width); ties go to the earlier.
BUCKETS = [("wide", 256, 448), ("square", 336, 336), ("tall", 448, 256)]


def or_default(value: Column, default) -> Column:
    """value, where it is neither null nor zero nor empty; else default. NaN counts as a value."""
    empty = "" if isinstance(default, str) else 0
    return F.coalesce(F.nullif(value, F.lit(empty)), F.lit(default))


def stride(fps: Column, seconds: float, pair_stride: Column) -> Column:
    """Steps between samples seconds apart: half-even rounding, at least 1."""
    return F.greatest(F.lit(1), F.bround(fps * F.lit(seconds) / F.greatest(F.lit(1), pair_stride), 0).cast("int"))


#: The scheme of members of an indexed archive, and suffixes of videos that can be decoded.
TAR_SCHEME = "rovidx_tar://"
VIDEO_SUFFIXES = ".mp4 .mkv .avi .mov .webm .m4v .ts .mpg .mpeg".split()


def source_suffix(path: Column) -> Column:
    """The suffix of a path's last part, with its dot, or nothing; a leading dot begins no suffix."""
    return F.regexp_extract(path, r"[^./][^/]*?(\.[^./]*)$", 1)


def source_kind(path: Column) -> Column:
    """tar, hdf5, video, zarr (no suffix: a candidate) or unsupported, by scheme and suffix."""
    suffix = F.lower(source_suffix(path))
    return (
        F.when(F.startswith(path, F.lit(TAR_SCHEME)), "tar").when(suffix.isin(".hdf5", ".h5"), "hdf5")
        .when(suffix.isin(VIDEO_SUFFIXES), "video").when(suffix == "", "zarr").otherwise("unsupported")
    )


def is_safe_name(name: Column, nested: bool = False) -> Column:
    """Not empty, not absolute, no backslash, no . or .. as a part; with parts only if nested."""
    parts = F.split(name, "/")
    fine = (name != "") & ~F.contains(name, F.lit("\\")) & ~F.exists(parts, lambda p: p.isin("", ".", ".."))
    return F.coalesce(fine if nested else fine & (F.size(parts) == 1), F.lit(False))


def rewrite_prefix(path: Column, rules: list[tuple[str, str]]) -> Column:
    """The first rule whose prefix ends at a / rewrites it."""
    out = path
    for old, new in reversed(rules):
        out = F.when((path == old) | F.startswith(path, F.lit(old.rstrip("/") + "/")), F.concat(F.lit(new), F.substr(path, F.lit(len(old.rstrip("/")) + 1)))).otherwise(out)
    return out


def role_id(view: Column) -> Column:
    """The number of a view's role, or null."""
    return F.nullif(F.array_position(F.array(*[F.lit(r) for r in ROLES]), view) - 1, F.lit(-1)).cast("int")


#: Cameras by view name, and of older manifests by dataset and camera.
VIEW_ROLES = {"head": "head", "wrist_left": "left_wrist", "wrist_right": "right_wrist", "global": "front_third", "side": "side_left"}
LEGACY_ROLES = {
    "EgoDex/ego": "head", "EPIC_KITCHENS/main": "head", "RDT-1B/cam_high": "head", "SthSthV2/main": "front_third", "RoboMind/camera_top_rgb_images": "head",
    "RoboMind/camera_left_rgb_images": "left_wrist", "RoboMind/camera_right_rgb_images": "right_wrist", "RoboMind/camera_front_rgb_images": "front_third",
    "RoboMind/camera_front_external_rgb_images": "front_third", "RoboMind/camera_left_external_rgb_images": "side_left", "RoboMind/camera_right_external_rgb_images": "side_right",
}
#: Cameras in scene ids that have another name, view classes, and families of datasets.
SCENE_ALIASES = {"exterior_image_1_left": "global", "exterior_image_2_left": "side", "wrist_image_left": "wrist_left"}
VIEW_CLASSES = ["head", "wrist_left", "wrist_right", "global", "side", "other"]
DOMAINS = {
    "real": "robomind robocoin agibot-beta rdt-1b galaxea droid interndata-a1 agibotworld2026 openx-embodiment rovid-x molmoact2 robomind2.0 table30 table30v2 bridgev2 dreamdojo-eval wmbench gr1_robot".split(),
    "sim": "behavior-1k robotwin2.0 robocasa libero_plus robodojo vlabench robotwin_unified".split(),
    "human": "egovid howto100m epic_kitchens egodex egoverse sthsthv2".split(),
    "other": [],
}


def _mapped(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def view_role(view: Column, dataset: Column | None = None) -> Column:
    """The number of a view's role by its name, or null; with a dataset the older names come first."""
    role = _mapped(VIEW_ROLES)[view]
    if dataset is not None:
        role = F.coalesce(_mapped(LEGACY_ROLES)[F.concat_ws("/", dataset, view)], role)
    return role_id(role)


def scene_role(scene: Column) -> Column:
    """The camera that a scene's id ends with."""
    last = F.element_at(F.split(scene, "/"), -1)
    return F.coalesce(_mapped(SCENE_ALIASES)[last], last)


def scene_view(scene: Column) -> Column:
    """The class of a scene's camera: its place among the view classes, the last for any other."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(v) for v in VIEW_CLASSES]), scene_role(scene)), F.lit(0)) - 1, F.lit(len(VIEW_CLASSES) - 1)).cast("int")


def scene_domain(scene: Column) -> Column:
    """The family of the dataset that a scene's id begins with: its place among the domains."""
    table = {d: k for k, names in enumerate(DOMAINS.values()) for d in names}
    return F.coalesce(_mapped(table)[F.lower(F.element_at(F.split(scene, "/"), 1))], F.lit(len(DOMAINS) - 1)).cast("int")


def path_variant(variant: Column, path: Column, known: list[str]) -> Column:
    """The stated variant, else the first known one that is a part of the path, else null."""
    parts = F.split(path, "/+")
    return F.coalesce(F.nullif(variant, F.lit("")), *[F.when(F.array_contains(parts, v), v) for v in known])


def normal_path(path: Column) -> Column:
    """An absolute path without . and .. and empty parts, by its text alone."""
    step = lambda a, p: F.when(p.isin("", "."), a).when(p == "..", F.slice(a, F.lit(1), F.greatest(F.lit(0), F.size(a) - 1))).otherwise(F.concat(a, F.array(p)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def is_inside(path: Column, root: str) -> Column:
    """Whether a path lies in root (or is root), by its text alone."""
    top = normal_path(F.lit(root))
    inner = normal_path(path)
    return (inner == top) | F.startswith(inner, F.concat(F.rtrim(top, F.lit("/")), F.lit("/")))


def same_under_mounts(a: Column, b: Column, least: int = 3) -> Column:
    """Whether two paths end in at least so many equal parts, whatever they are mounted on."""
    ends = lambda p: F.reverse(F.filter(F.split(p, "/"), lambda x: x != ""))
    return F.coalesce((F.size(ends(a)) >= least) & (F.size(ends(b)) >= least) & (F.slice(ends(a), 1, least) == F.slice(ends(b), 1, least)), F.lit(False))


def cameras(have: Column, wanted: list[str] | None) -> Column:
    """The cameras to use: those wanted, in that order; by default all, sorted."""
    return F.array_sort(have) if wanted is None else F.filter(F.array(*[F.lit(w) for w in wanted]), lambda w: F.array_contains(have, w))


#: What stands before the scene's own path, the first that a path has counts.
SCENE_KEYWORDS = ["split_videos/", "egodex_unzipped/", "video/RDT-1B/", "RoboCOIN/", "RoboMIND/"]


def scene_folder(video: Column) -> Column:
    """A video's path after its keyword (all of it without one), without the suffix."""
    found = F.coalesce(*[F.when(F.contains(video, F.lit(k)), F.substring_index(video, k, -1)) for k in SCENE_KEYWORDS], video)
    return F.substr(found, F.lit(1), F.length(found) - F.length(source_suffix(found)))


def caption_or(caption: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(caption), F.lit("")), F.lit(default))


def part_name(dataset: Column, shard: Column, n_shards: int) -> Column:
    """A part's file name; the number of shards is in it, so parts of two shardings never mix."""
    return F.format_string(f"%s.n{n_shards}.shard%04d.jsonl", dataset, shard)


def part_shard(name: Column, n_shards: int) -> Column:
    """The shard in a part's name, or null for another sharding's."""
    return F.nullif(F.regexp_extract(name, rf"\.n{n_shards}\.shard(\d+)\.jsonl$", 1), F.lit("")).cast("int")


def chunk_path(template: str, episode: Column, chunk: int, **more: Column) -> Column:
    """A path by a template with {chunk} and {episode} (three and six digits) and named columns."""
    out = F.replace(F.replace(F.lit(template), F.lit("{chunk}"), F.lpad((F.floor(episode / chunk)).cast("string"), 3, "0")), F.lit("{episode}"), F.lpad(episode.cast("string"), 6, "0"))
    for name, value in more.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def camera_prompt(labels: Column, task: Column) -> Column:
    """Camera labels in order, then the task."""
    return F.concat_ws(" ", F.transform(labels, lambda c, i: F.concat((i + 1).cast("string"), F.lit(": "), c, F.lit(";"))), task)


def aspect_bucket(height: Column, width: Column) -> Column:
    """The bucket of the nearest log ratio."""
    far = [F.struct(F.abs(F.ln(height / width) - F.ln(F.lit(h / w))).alias("far"), F.lit(k).alias("k"), F.lit(n).alias("name")) for k, (n, h, w) in enumerate(BUCKETS)]
    return F.array_min(F.array(*far))["name"]


def join_caption(parts: Column, most: int) -> Column:
    """parts: array of (start_time, description). In order of time (ties as given), stripped, each text once, joined by spaces,
    and cut at the last space within most characters (hard, where there's none)."""
    placed = F.transform(parts, lambda p, i: F.struct(p["start_time"].alias("t"), i.alias("i"), F.trim(p["description"]).alias("d")))
    text = F.array_join(F.array_distinct(F.filter(F.transform(F.array_sort(placed), lambda p: p["d"]), lambda d: d != "")), " ")
    head = F.substring(text, 1, most)
    # a word that ends just at the limit is whole
    cut = F.when(F.substring(text, most + 1, 1) == " ", head).otherwise(F.rtrim(F.regexp_replace(head, r"[^ ]+$", "")))
    return F.when(F.length(text) <= most, text).when(cut == "", head).otherwise(cut)


def strip_task_prefix(task: Column) -> Column:
    return F.regexp_replace(F.trim(task), r"^(primitive|composite):\s*", "")


def variant_robot(variant: Column) -> Column:
    """The robot type in a variant's name."""
    return F.regexp_replace(F.get(F.split(variant, "_"), F.lit(0)), "-", "_")


def norm_coefficients(method: str, stats: Column) -> tuple[Column, Column]:
    """(offset, scale) of a method over a struct of mean, std, min, max, q01, q99."""
    eps = F.lit(1e-8)
    if method == "mean_std":
        return stats["mean"], stats["std"] + eps
    low, high = ("q01", "q99") if method == "q01_q99" else ("min", "max")
    half = (stats[high] - stats[low] + eps) / 2
    return (stats[low], half) if method == "min_max" else ((stats[low] + stats[high]) / 2, half)


def normalize(value: Column, method: str, stats: Column) -> Column:
    """(value - offset) / scale; without stats the value as it is."""
    offset, scale = norm_coefficients(method, stats)
    return F.when(stats.isNull(), value).otherwise((value - offset) / scale)


def denormalize(value: Column, method: str, stats: Column) -> Column:
    offset, scale = norm_coefficients(method, stats)
    return F.when(stats.isNull(), value).otherwise(value * scale + offset)


def digest(*columns: Column) -> Column:
    """sha256 of the canonical JSON of the columns, in hex."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
