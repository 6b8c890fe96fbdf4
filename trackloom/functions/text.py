"""Identifiers, labels and tolerant parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import finite

NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
WIDE, NARROW = "".join(chr(0xFF01 + k) for k in range(94)) + "　", "".join(chr(0x21 + k) for k in range(94)) + " "
#: Texts by which candidate tables are known, and names of projections and viewer engines.
CANDIDATE_MARKS = ("360 detection candidates", "360 poi clusters", "all_classes", "poi_candidates_360", "poi_candidates", "poi_clusters")
SPHERE_NAMES, FLAT_NAMES = ("sphere", "360", "equirectangular", "pano"), ("flat", "pinhole", "front")
MORE_SPHERE_NAMES, MORE_FLAT_NAMES = ("panorama",), ("normal",)
PREFIX, OLD_PREFIX, LONG_PREFIX = "POI:", "360 POI Clusters:", "360 Detection Candidates"
AUTO_SOURCES = ("yolo_candidate", "auto_point", "yolo_pinhole")
ENGINES = {"krpano": ("krpano",), "psv": ("psv", "photo-sphere-viewer", "photosphere", "photo_sphere_viewer")}


def narrow(x: Column) -> Column:
    """Full-width ASCII and spaces in their usual width: the part of compatibility normalisation that numbers and names need."""
    return F.translate(x, WIDE, NARROW)


def parse_float(x: Column) -> Column:
    """A finite number, after full-width forms and thousands commas; null for anything else."""
    plain = F.replace(F.trim(narrow(x)), F.lit(","), F.lit(""))
    return F.when(plain.rlike(NUMBER), finite(plain.try_cast("double")))


def opt_float(x: Column) -> Column:
    return F.trim(x).try_cast("double")


def parse_bool(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x)).isin("1", "true", "yes", "on"), F.lit(False))


def parse_frame(x: Column) -> Column:
    """A whole number of at least 0, written without a fraction."""
    return F.when(F.trim(x).rlike(r"^\+?[0-9]+$"), F.trim(x).try_cast("bigint"))


def parse_frame_tolerant(x: Column) -> Column:
    """Any finite number, cut to a whole one."""
    return parse_float(x).cast("bigint")


def normalize_field(x: Column) -> Column:
    """Column names in one spelling: lower case, runs of separators as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(narrow(F.coalesce(x, F.lit(""))))), r"[\s:./()\[\]-]+", "_"), r"^_+|_+$", "")


def normalize_gpx_field(x: Column) -> Column:
    """As above for tags: without their namespace, and parentheses stay."""
    plain = F.regexp_replace(F.coalesce(x, F.lit("")), r"^.*\}", "")
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(narrow(plain))), r"[\s:./-]+", "_"), r"^_+|_+$", "")


def base_name(path: Column) -> Column:
    """A file's name without folders and extension, as an output stem."""
    name = F.regexp_replace(F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    stem = F.regexp_replace(F.regexp_replace(name, r"[^0-9A-Za-z_.-]+", "_"), "^_+|_+$", "")
    return F.when(stem == "", "video_gpx").otherwise(stem)


def safe_layer(x: Column) -> Column:
    """A lower-case table name of at most 63 ASCII characters that doesn't begin with a digit."""
    plain = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "[^0-9A-Za-z_]+", "_"), "^_+|_+$", ""))
    named = F.when(plain == "", "video_gpx_points").otherwise(plain)
    return F.left(F.when(named.rlike("^[0-9]"), F.concat(F.lit("layer_"), named)).otherwise(named), F.lit(63))


def class_key(x: Column) -> Column:
    """A class name without its prefix, as lower-case words joined by underscores."""
    tail = F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), "^[^:]*:", "")
    return F.regexp_replace(F.regexp_replace(tail, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def class_alias(x: Column, aliases: dict[str, str]) -> Column:
    """The display name of a class: by itself, in lower case, by its key, or by what follows its first colon; else unchanged."""
    if not aliases:
        return x
    table = F.create_map(*[F.lit(v) for pair in aliases.items() for v in pair])
    tail = F.trim(F.regexp_replace(x, "^[^:]*:", ""))
    tries = [F.try_element_at(table, k) for k in (x, F.lower(x), class_key(x), tail)]
    return F.coalesce(*tries, x)


def class_unalias(x: Column, aliases: dict[str, str]) -> Column:
    if not aliases:
        return x
    table = F.create_map(*[F.lit(v) for key, name in aliases.items() for v in (name, key)])
    return F.coalesce(F.try_element_at(table, x), x)


def is_candidate_name(x: Column) -> Column:
    return F.coalesce(F.lower(x).rlike("|".join(CANDIDATE_MARKS)), F.lit(False))


def video_name_error(x: Column) -> Column:
    """Why a video name is refused; null if it is fine."""
    name = F.trim(F.coalesce(x, F.lit("")))
    return F.when(name == "", "empty").when(name.rlike(r"[/\\:]"), "path").when(~F.lower(name).endswith(".mp4"), "extension")


def frame_path(frame: Column) -> Column:
    """The image of a frame, in a folder for each thousand."""
    return F.format_string("%04d/frame_%07d.jpg", F.floor(frame / 1000).cast("bigint"), frame.cast("bigint"))


def cache_name(stem: Column, frame: Column, version: str, purpose: str, width: int, quality: int, progressive: bool) -> Column:
    return F.format_string(f"%s_frame_%06d_{version}_{purpose}_w{width}_q{quality}_p{int(progressive)}.jpg", stem, frame.cast("bigint"))


def snapshot_name(x: Column, fallback: str = "snapshot") -> Column:
    plain = F.left(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "[^0-9A-Za-z_.-]+", "_"), "^[._]+|[._]+$", ""), F.lit(80))
    return F.when(plain == "", fallback).otherwise(plain)


def format_distance(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string("%.3f", x)).otherwise("")


def format_size(n: Column) -> Column:
    """Bytes in the largest unit that leaves at least 1."""
    size = n.cast("double")
    return (
        F.when(size < 1024, F.concat(n.cast("bigint").cast("string"), F.lit(" B")))
        .when(size < 1024**2, F.format_string("%.1f KB", size / 1024))
        .when(size < 1024**3, F.format_string("%.1f MB", size / 1024**2))
        .otherwise(F.format_string("%.1f GB", size / 1024**3))
    )


def compact(x: Column, most: int = 160, head: int = 112, tail: int = 44) -> Column:
    return F.when(F.length(x) > most, F.concat(F.left(x, F.lit(head)), F.lit(" ... "), F.right(x, F.lit(tail)))).otherwise(x)


def format_meters(x: Column) -> Column:
    return F.when(x >= 10, F.format_string("%.0fm", x)).otherwise(F.format_string("%.1fm", x))


def locale(x: Column, supported: tuple[str, ...] = ("en", "ja"), default: str = "en") -> Column:
    code = F.lower(F.regexp_extract(F.coalesce(x, F.lit("")), "^[^_-]+", 0))
    return F.when(code.isin(*supported), code).otherwise(default)


def projection_name(x: Column, default: str = "sphere", more: bool = False) -> Column:
    """sphere or flat. ``more`` also takes the names that only the map side knows."""
    name = F.lower(F.trim(x))
    sphere, flat = SPHERE_NAMES + MORE_SPHERE_NAMES * more, FLAT_NAMES + MORE_FLAT_NAMES * more
    return F.when(name.isin(*sphere), "sphere").when(name.isin(*flat), "flat").otherwise(default)


def engine_name(x: Column, default: str = "krpano") -> Column:
    name = F.lower(F.trim(x))
    chosen = F.when(F.lit(False), "")
    for engine, names in ENGINES.items():
        chosen = chosen.when(name.isin(*names), engine)
    return chosen.otherwise(default)


def error_list(errors: Column) -> Column:
    """The first five messages, and how many more there are."""
    more = F.size(errors) - 5
    return F.concat(F.array_join(F.slice(errors, 1, 5), "; "), F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(""))


def is_marking_mode(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x)).isin("marking", "picked"), F.lit(False))


def display_prefix(x: Column) -> Column:
    """A table's display text with the present prefix in place of the old one."""
    text = F.trim(F.coalesce(x, F.lit("")))
    tail = F.trim(F.substring(text, len(OLD_PREFIX) + 1, 1 << 30))
    return F.when(text.startswith(OLD_PREFIX), F.when(tail != "", F.concat(F.lit(f"{PREFIX} "), tail)).otherwise(PREFIX.rstrip(":"))).otherwise(text)


def display_name(layer: Column, identifier: Column) -> Column:
    """How a candidate table is shown: by its own text if it has one, else by its name."""
    own, name = F.trim(F.coalesce(identifier, F.lit(""))), F.trim(F.coalesce(layer, F.lit("")))
    plain = F.when((name == "") | (name == "poi_candidates_360"), LONG_PREFIX).when(F.lower(name) == "all_classes", f"{PREFIX} All_Classes")
    plain = plain.when(name.startswith("poi_clusters"), F.concat(F.lit(f"{PREFIX} "), name)).otherwise(F.concat(F.lit(f"{LONG_PREFIX}: "), name))
    return F.when(own != "", display_prefix(own)).otherwise(plain)


def display_alias(shown: Column, name: Column, alias: Column) -> Column:
    """The display text of a table of one class under the class's alias, with its prefix kept."""
    base = display_prefix(shown)
    same = (F.trim(F.coalesce(shown, F.lit(""))) == "") | (F.coalesce(F.trim(name), F.lit("")) == "") | (F.coalesce(alias, F.lit("")) == "") | (alias == F.trim(name))
    return F.when(same, base).when(base.startswith(PREFIX), F.concat(F.lit(f"{PREFIX} "), alias)).when(base.startswith(f"{LONG_PREFIX}:"), F.concat(F.lit(f"{LONG_PREFIX}: "), alias)).otherwise(alias)


def cache_stem(path: Column) -> Column:
    """A video's name without folders and extension, as the stem of cached images."""
    name = F.regexp_replace(F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    stem = F.regexp_replace(F.regexp_replace(name, r"[^0-9A-Za-z_.-]+", "_"), "^_+|_+$", "")
    return F.when(stem == "", "video").otherwise(stem)


def missing_keys(base: Column, other: Column) -> Column:
    """The keys of a catalogue that another lacks, sorted."""
    return F.sort_array(F.array_except(base, other))


def unique_ordered(values: Column) -> Column:
    """The different values in the order of their first places."""
    return F.array_distinct(values)


def is_auto_target(source: Column, marker: Column, candidate: Column, semantic_class: Column) -> Column:
    """Whether a target was made by a detector."""
    named = lambda x: F.coalesce(x, F.lit("")) != ""
    return F.coalesce(F.lower(F.trim(source)).isin(*AUTO_SOURCES), F.lit(False)) | F.coalesce(marker == "target_point", F.lit(False)) | named(candidate) | named(semantic_class)


def same_frame(video: Column, frame: Column, other_video: Column, other_frame: Column) -> Column:
    """Whether two states show one frame of one video; not where a frame isn't a whole number."""
    return F.coalesce((video == other_video) & (frame.try_cast("bigint") == other_frame.try_cast("bigint")), F.lit(False))


def frame_in_range(frame: Column, count: Column) -> Column:
    """Whether a frame is one of the video's; where the number of frames isn't known, any from 0 on."""
    return F.coalesce((frame >= 0) & F.coalesce((frame < count) | (count <= 0), F.lit(True)), F.lit(False))


def message(key: Column, code: Column, catalogue: dict[str, dict[str, str]], values: dict[str, Column], default: str = "en") -> Column:
    """The text of a key in a language, else in the default one, else the key; ``{name}`` of a known value is filled in, any other stays."""
    table = F.create_map(*[F.lit(x) for language, texts in catalogue.items() for k, v in texts.items() for x in (f"{language}:{k}", v)])
    at = lambda language: F.try_element_at(table, F.concat(language, F.lit(":"), key))
    text = F.coalesce(at(code), at(F.lit(default)), key)
    for name, value in values.items():
        text = F.replace(text, F.lit(f"{{{name}}}"), F.coalesce(value.cast("string"), F.lit("")))
    return text


def build_digest(*files: tuple[str, Column]) -> Column:
    """SHA-256 over the name, a zero byte and the bytes of each file."""
    return F.sha2(F.concat(*[F.concat(F.lit(name).cast("binary"), F.lit("\0").cast("binary"), content.cast("binary")) for name, content in files]), 256)
