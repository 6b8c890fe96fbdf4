"""Checks of settings as columns: each gives what is wrong as (field, rule, low, high), one row of the array for each field in the order of the arguments, and never fails.

Rules: ``missing``, ``unreadable`` (not a number, or not a whole one where that is asked for), ``range`` (outside low..high, null where there is no such limit), ``choice`` (none of the
values that are allowed), ``kind`` (a file of another kind). A number that is missing or unreadable counts as its default for its range.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Navigation modes, radar offsets, and (default, low, high, whole) of each number.
MODES = ("frame", "layer", "kp", "marking", "picked", "detect")
OFFSETS = (0, 90, 180, 270)
NUMBERS = {
    "nav_step": (1, 1, None, True), "nav_fast_step": (30, 1, None, True),
    "radar_range_m": (5, 1, 500, False), "radar_scale": (1, 0.1, 20, False), "calibration_fov_deg": (90, 1, 179, False), "calibration_distance_m": (5, 0.1, 500, False), "radar_offset_deg": (0, None, None, True),
    "frame_shift": (0, -1_000_000, 1_000_000, True), "reference_tolerance_m": (5, 0, None, False), "frame": (0, 0, None, True),
    "port": (8181, 1, 65535, True), "jpeg_quality": (90, 1, 100, True), "max_width": (3072, 0, None, True), "camera_height_m": (1.5, 0.1, 20, False), "hud_scale": (1, 0.1, 5, False),
}


def problem(field: str, rule: str, low: float | None = None, high: float | None = None) -> Column:
    limit = lambda x: F.lit(x).cast("double")
    return F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule"), limit(low).alias("low"), limit(high).alias("high"))


def read_number(x: Column, whole: bool) -> Column:
    """A finite number, or a whole one; null for anything else."""
    text = F.trim(x.cast("string"))
    if whole:
        return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint")).cast("double")
    value = text.try_cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def number(x: Column, field: str, among: tuple[float, ...] = ()) -> Column:
    default, low, high, whole = NUMBERS[field]
    read = read_number(x, whole)
    value = F.coalesce(read, F.lit(float(default)))
    found = F.when(x.isNotNull() & read.isNull(), problem(field, "unreadable"))
    if among:
        return found.when(~value.isin(*[float(a) for a in among]), problem(field, "choice"))
    outside = [value < limit if k == 0 else value > limit for k, limit in enumerate((low, high)) if limit is not None]
    return found.when(outside[0] if len(outside) == 1 else outside[0] | outside[1], problem(field, "range", low, high))


def choice(x: Column, field: str, among: tuple[str, ...]) -> Column:
    return F.when(~F.trim(F.coalesce(x, F.lit(""))).isin(*among), problem(field, "choice"))


def given(x: Column, field: str, extension: str | None = None, required: bool = True) -> Column:
    """A text, or the name of a file of some kind; whether the file exists is for its reader to tell."""
    text = F.trim(F.coalesce(x, F.lit("")))
    found = F.when(text == "", problem(field, "missing") if required else F.lit(None).cast("struct<field:string,rule:string,low:double,high:double>"))
    return found.when(~F.lower(text).endswith(extension), problem(field, "kind")) if extension else found


def problems(*checks: Column) -> Column:
    return F.array_compact(F.array(*checks))


def navigation_errors(mode: Column, step: Column, fast_step: Column) -> Column:
    return problems(choice(mode, "nav_mode", MODES), number(step, "nav_step"), number(fast_step, "nav_fast_step"))


def radar_errors(range_m: Column, scale: Column, view: Column, distance: Column, offset: Column) -> Column:
    return problems(number(range_m, "radar_range_m"), number(scale, "radar_scale"), number(view, "calibration_fov_deg"), number(distance, "calibration_distance_m"), number(offset, "radar_offset_deg", OFFSETS))


def process_errors(gpx: Column, video: Column, reference: Column, shift: Column, tolerance: Column) -> Column:
    return problems(given(gpx, "gpx", ".gpx"), given(video, "video", ".mp4"), given(reference, "reference_csv", ".csv", required=False), number(shift, "frame_shift"), number(tolerance, "reference_tolerance_m"))


def extract_errors(video: Column, frame: Column) -> Column:
    return problems(given(video, "video", ".mp4"), number(frame, "frame"))


def viewer_errors(host: Column, port: Column, quality: Column, width: Column, height: Column, scale: Column) -> Column:
    return problems(given(host, "host"), number(port, "port"), number(quality, "jpeg_quality"), number(width, "max_width"), number(height, "camera_height_m"), number(scale, "hud_scale"))
