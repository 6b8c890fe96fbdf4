"""Angles, positions and ground projection as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import clamp, clamp_or, finite, let, num, or_one

HAVERSINE_RADIUS, EARTH_RADIUS = 6_371_000.0, 6_378_137.0
MIN_RADIUS, MAX_RINGS, CIRCLE_STEP = 1.0, 250, 8


def norm_yaw(x: Column) -> Column:
    """An angle in [0, 360)."""
    return F.pmod(x, F.lit(360.0))


def signed_yaw(x: Column) -> Column:
    """An angle in [-180, 180)."""
    return F.pmod(x + 180.0, F.lit(360.0)) - 180.0


def signed_delta(a: Column, b: Column) -> Column:
    """The turn from a to b, in [-180, 180)."""
    return signed_yaw(num(b) - num(a))


def heading_delta(a: Column, b: Column) -> Column:
    return F.abs(signed_yaw(num(a) - num(b)))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a1, a2 = F.radians(lat1), F.radians(lat2)
    s1, s2 = F.sin((a2 - a1) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return 2 * HAVERSINE_RADIUS * F.asin(F.sqrt(s1 * s1 + F.cos(a1) * F.cos(a2) * s2 * s2))


def local_vector(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> tuple[Column, Column]:
    """Metres east and north between two near points."""
    east = F.radians(lon2 - lon1) * EARTH_RADIUS * F.cos(F.radians((lat1 + lat2) / 2))
    return east, F.radians(lat2 - lat1) * EARTH_RADIUS


def heading(east: Column, north: Column) -> Column:
    """Degrees clockwise from north."""
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def destination(lat: Column, lon: Column, bearing: Column, distance: Column) -> Column:
    """struct(lon, lat) of the point at a bearing and distance on the sphere; longitudes aren't wrapped."""
    turn, arc, a, b = F.radians(bearing), distance / EARTH_RADIUS, F.radians(lat), F.radians(lon)
    sine = F.sin(a) * F.cos(arc) + F.cos(a) * F.sin(arc) * F.cos(turn)
    lat2 = F.asin(sine)
    lon2 = b + F.atan2(F.sin(turn) * F.sin(arc) * F.cos(a), F.cos(arc) - F.sin(a) * F.sin(lat2))
    return F.struct(F.degrees(lon2).alias("lon"), F.degrees(lat2).alias("lat"))


def fov(zoom: Column) -> Column:
    """The horizontal field of view of a zoom; a missing or zero zoom is 1."""
    return clamp(90.0 / F.greatest(or_one(zoom), F.lit(0.01)), 1, 179)


def zoom_multiplier(zoom: Column) -> Column:
    return clamp(1.0 / F.greatest(or_one(zoom), F.lit(0.01)), 0.25, 8)


def calibrated_distance(view: Column, calibration_fov: Column | float = 90.0, distance: Column | float = 5.0, scale: Column | float = 1.0) -> Column:
    """The distance at which a calibrated object stands in a field of view; 1 m at least."""
    half = F.tan(F.radians(clamp(num(calibration_fov), 1, 179) / 2))
    return F.greatest(F.lit(MIN_RADIUS), num(distance) * num(scale) * F.tan(F.radians(view / 2)) / half)


def bearing(heading_deg: Column, offset: Column | float, yaw: Column) -> Column:
    return F.pmod(heading_deg + num(offset) + norm_yaw(F.coalesce(yaw, F.lit(0.0))), F.lit(360.0))


def camera_height(height: Column, scale: Column) -> Column:
    return clamp_or(height, 0.1, 20, 1.5) * clamp_or(scale, 0.1, 5, 1)


def ground_from_pitch(pitch: Column, height: Column) -> Column:
    """The ground distance of a point seen at a downward pitch; null from the horizon up and straight down."""
    return F.when((pitch > 0.1) & (pitch < 89.9), height / F.tan(F.radians(pitch)))


def positive(distance: Column) -> Column:
    return F.when(finite(distance) > 0, distance)


def distance_quality(distance: Column) -> Column:
    return F.when(distance <= 5, "trusted").when(distance <= 10, "usable").when(distance > 10, "far")


def valid_gps(lat: Column, lon: Column) -> Column:
    return F.coalesce((F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.lit(False))


def front_offset(x: Column) -> Column:
    return signed_yaw(finite(x))


def infer_projection(width: Column, height: Column) -> Column:
    """Frames about twice as wide as high are spherical; so are frames of unknown size."""
    ratio = width.cast("double") / F.nullif(height.cast("double"), F.lit(0.0))
    return F.when(F.abs(ratio - 2.0) > 0.03, "flat").otherwise("sphere")


def circle(lat: Column, lon: Column, radius: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(360), F.lit(CIRCLE_STEP)), lambda a: destination(lat, lon, a.cast("double"), radius))


def grid_radii(inner: Column, outer: Column) -> Column:
    """Whole metres below the outer radius, without the two radii themselves; 250 at most."""
    most = F.floor(F.greatest(F.lit(0.0), outer)).cast("int")
    whole = F.when(most >= 1, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    kept = F.filter(whole, lambda r: (F.abs(r - inner) >= 0.001) & (F.abs(r - outer) >= 0.001))
    return F.slice(F.transform(kept, lambda r: r.cast("double")), 1, MAX_RINGS)


def sector(lat: Column, lon: Column, bearing_deg: Column, view: Column, radius: Column) -> Column:
    """Centre, an arc of max(8, int(fov / 4)) + 1 points, centre."""
    n = F.greatest(F.lit(8), (view / 4).cast("int"))
    centre = F.array(F.struct(lon.alias("lon"), lat.alias("lat")))
    arc = F.transform(F.sequence(F.lit(0), n), lambda k: destination(lat, lon, bearing_deg - view / 2 + view * (k / n), radius))
    return F.concat(centre, arc, centre)


def direction(lat: Column, lon: Column, bearing_deg: Column, radius: Column) -> tuple[Column, Column, Column]:
    """The tip of the view direction, and the two ends of the line across it."""
    tip = destination(lat, lon, bearing_deg, radius)
    ends = [destination(tip["lat"], tip["lon"], bearing_deg + side, radius * 0.3) for side in (-90.0, 90.0)]
    return tip, ends[0], ends[1]


def dms(x: Column) -> Column:
    """Degrees, minutes and seconds as (num, den) pairs, seconds in millionths."""
    size = F.abs(x)
    d = F.floor(size)
    m = F.floor((size - d) * 60)
    s = F.rint(((size - d) * 60 - m) * 60 * 1_000_000).cast("bigint")
    pair = lambda n, den: F.struct(n.cast("bigint").alias("num"), F.lit(den).cast("bigint").alias("den"))
    return F.array(pair(d, 1), pair(m, 1), pair(s, 1_000_000))


def rotate_yaw(x: Column, y: Column, z: Column, yaw: Column) -> tuple[Column, Column, Column]:
    """A vector (right, up, forward) turned about the vertical axis."""
    c, s = F.cos(F.radians(yaw)), F.sin(F.radians(yaw))
    return x * c + z * s, y, z * c - x * s


def rotate_pitch(x: Column, y: Column, z: Column, pitch: Column) -> tuple[Column, Column, Column]:
    """A vector (right, up, forward) turned about the axis to the right."""
    c, s = F.cos(F.radians(pitch)), F.sin(F.radians(pitch))
    return x, y * c + z * s, z * c - y * s


def vertical_fov(view_h: Column, width: Column, height: Column) -> Column:
    return clamp(F.degrees(F.atan(F.tan(F.radians(view_h / 2)) * (height / width))) * 2, 1, 179)


def ground_to_screen(azimuth: Column, distance: Column, height: Column, yaw: Column, pitch: Column, view_h: Column, width: Column, stage_height: Column) -> Column:
    """struct(x, y) in pixels of a ground point at an azimuth; null behind the camera or far outside the stage."""
    point = distance * F.sin(F.radians(azimuth)), -height, distance * F.cos(F.radians(azimuth))
    x, y, z = rotate_pitch(*rotate_yaw(*point, -yaw), pitch)
    nx = x / z / F.tan(F.radians(view_h / 2))
    ny = -y / z / F.tan(F.radians(vertical_fov(view_h, width, stage_height) / 2))
    seen = (z > 0.01) & (F.abs(nx) <= 2.2) & (F.abs(ny) <= 2.2)
    return F.when(seen, F.struct(((nx + 1) / 2 * width).alias("x"), ((ny + 1) / 2 * stage_height).alias("y")))


def click_flat(x_ratio: Column, y_ratio: Column, view_h: Column, view_v: Column) -> tuple[Column, Column]:
    """Yaw and pitch from the view direction of a click on a flat image, by its place in the image."""
    yaw = F.degrees(F.atan((clamp(x_ratio, 0, 1) - 0.5) * 2 * F.tan(F.radians(view_h / 2))))
    return yaw, -F.degrees(F.atan((clamp(y_ratio, 0, 1) - 0.5) * 2 * F.tan(F.radians(view_v / 2))))


def psv_level(zoom: Column, least: float = 30.0, most: float = 90.0) -> Column:
    """The viewer's 0..100 zoom level between its widest and its narrowest field of view."""
    view = clamp(90.0 / F.greatest(or_one(zoom), F.lit(0.01)), least, most)
    return clamp((most - view) / (most - least) * 100, 0, 100)


def psv_zoom(level: Column, least: float = 30.0, most: float = 90.0) -> Column:
    view = most + clamp(level, 0, 100) / 100 * (least - most)
    return F.greatest(F.lit(0.01), 90.0 / clamp(view, 1, most))


def ground_search_limit(outer: Column, range_m: Column, calibration: Column) -> Column:
    return clamp(F.greatest(outer, range_m * 2, calibration * 2, F.lit(20.0)), 5, 200)


def fit_scale(width: Column, height: Column, box_width: Column, box_height: Column) -> Column:
    """The largest scale at which an image lies within a box."""
    return F.least(box_width / width, box_height / height)


def click_view(x_ratio: Column, y_ratio: Column, yaw: Column, pitch: Column, zoom: Column, width: Column, height: Column) -> Column:
    """struct(yaw_delta, pitch_delta, yaw, pitch) of a click on a view in perspective, by its place on the stage."""
    view_h = fov(zoom)
    view_v = vertical_fov(view_h, width, height)
    across, down = (clamp(x_ratio, 0, 1) - 0.5) * 2, (clamp(y_ratio, 0, 1) - 0.5) * 2
    delta, rise = F.degrees(F.atan(across * F.tan(F.radians(view_h / 2)))), -F.degrees(F.atan(down * F.tan(F.radians(view_v / 2))))
    return F.struct(signed_yaw(delta).alias("yaw_delta"), rise.alias("pitch_delta"), norm_yaw(yaw + delta).alias("yaw"), clamp(pitch + rise, -90, 90).alias("pitch"))


def ground_distance(azimuth: Column, x: Column, y: Column, height: Column, yaw: Column, pitch: Column, view_h: Column, width: Column, stage_height: Column, most: Column) -> Column:
    """The distance along an azimuth whose ground point is nearest to a place on the stage: 361 tries, then 41 around the best; the first of equals.

    Null if no try is on the stage, or the best is farther off than 80 pixels and 12 % of the stage's shorter side.
    """
    least, tries, again = 0.05, 360, 40
    turns = {"az": azimuth, "yaw": -yaw, "pitch": pitch}
    waves = [f(F.radians(angle)).alias(f"{kind}_{name}") for name, angle in turns.items() for kind, f in (("sin", F.sin), ("cos", F.cos))]
    halves = [F.tan(F.radians(view_h / 2)).alias("half_h"), F.tan(F.radians(vertical_fov(view_h, width, stage_height) / 2)).alias("half_v")]
    # what a row's tries share, once a row: the tries themselves are sums and products, in the order of ground_to_screen
    row = F.struct(*waves, *halves, *[v.alias(n) for n, v in {"x": x, "y": y, "height": height, "width": width, "stage": stage_height, "most": most}.items()])
    return let(row, lambda r: _nearest_try(r, least, tries, again))


def _nearest_try(r: Column, least: float, tries: int, again: int) -> Column:
    most, width, stage_height = r["most"], r["width"], r["stage"]

    def tried(low: Column, step: Column, count: int) -> Column:
        def one(k: Column) -> Column:
            return let(low + step * k, lambda metres: F.struct(error(metres).alias("error"), k.alias("k"), metres.alias("metres")))

        return F.array_min(F.filter(F.transform(F.sequence(F.lit(0), F.lit(count)), one), lambda t: t["error"].isNotNull()))

    def error(metres: Column) -> Column:
        x, z = metres * r["sin_az"], metres * r["cos_az"]
        turned = F.struct((x * r["cos_yaw"] + z * r["sin_yaw"]).alias("x"), (z * r["cos_yaw"] - x * r["sin_yaw"]).alias("z"))

        def on_stage(p: Column) -> Column:
            y = -r["height"]
            return let(p["z"] * r["cos_pitch"] - y * r["sin_pitch"], lambda z: F.when(z > 0.01, let(F.struct((p["x"] / z / r["half_h"]).alias("x"), (-(y * r["cos_pitch"] + p["z"] * r["sin_pitch"]) / z / r["half_v"]).alias("y")), off)))

        def off(n: Column) -> Column:
            apart = F.struct(((n["x"] + 1) / 2 * width - r["x"]).alias("x"), ((n["y"] + 1) / 2 * stage_height - r["y"]).alias("y"))
            return F.when((F.abs(n["x"]) <= 2.2) & (F.abs(n["y"]) <= 2.2), let(apart, lambda d: d["x"] * d["x"] + d["y"] * d["y"]))

        return let(turned, on_stage)

    step = (most - least) / tries
    coarse = F.transform(F.array(tried(F.lit(least), step, tries)), lambda t: F.struct(t["error"].alias("error"), t["metres"].alias("metres")))

    def refined(t: Column) -> Column:
        low, high = F.greatest(F.lit(least), t["metres"] - step), F.least(most, t["metres"] + step)
        fine = tried(low, (high - low) / again, again)
        better = fine["error"] < t["error"]
        limit = F.greatest(F.lit(80.0), F.least(width, stage_height) * 0.12)
        error = F.when(better, fine["error"]).otherwise(t["error"])
        return F.when(error <= limit * limit, F.when(better, fine["metres"]).otherwise(t["metres"]))

    return F.get(F.transform(coarse, refined), F.lit(0))


def hud_radii(range_m: Column, outer_m: Column, sector_m: Column, view: Column, distance_m: Column, scale: Column, zoom: Column, ground_m: Column, low: Column, high: Column) -> Column:
    """struct(outer, inner, marker, label_y) in pixels of the radar overlay; null without ranges."""
    z = F.greatest(or_one(zoom), F.lit(0.01))
    limits = lambda v: F.greatest(low, F.least(high, v))
    wide = F.when(view > 0, limits(view / (90.0 / z))).otherwise(limits(z))
    base = F.when(distance_m > 0, distance_m).otherwise(range_m)
    pixels = lambda metres, least: clamp(metres / base * sector_m * or_one(scale) * wide, least, 100)
    marker = pixels(F.when(ground_m > 0, ground_m).otherwise(range_m), 2)
    known = range_m.isNotNull() & sector_m.isNotNull() & (outer_m > 0)
    return F.when(known, F.struct(pixels(outer_m, 4).alias("outer"), pixels(range_m, 2).alias("inner"), marker.alias("marker"), clamp(clamp(104 - marker, 4, 104) - 8, 12, 96).alias("label_y")))


def hud_payload(range_m: Column, view: Column, distance_m: Column, scale: Column) -> Column:
    """The distances that the viewer's radar overlay is drawn from."""
    return F.struct(
        range_m.alias("range_m"), (range_m * 2.0).alias("outer_range_m"), (distance_m * scale).alias("base_sector_radius_m"), view.alias("calibration_fov_deg"), distance_m.alias("calibration_distance_m"),
        scale.alias("manual_scale"), F.lit(MIN_RADIUS).alias("min_sector_radius_m"), F.lit(0.25).alias("min_zoom_multiplier"), F.lit(8.0).alias("max_zoom_multiplier"),
    )


def offset_from_targets(heading_deg: Column, targets: Column) -> Column:
    """The offset that the first target with both map_bearing and yaw implies; null without one."""
    both = F.filter(targets, lambda t: t["map_bearing"].isNotNull() & t["yaw"].isNotNull())
    first = F.get(both, F.lit(0))
    return signed_yaw(first["map_bearing"] - heading_deg - first["yaw"])


def current_fov(video: Column, state_video: Column, zoom: Column) -> Column:
    """The field of view of the last state, if it is of this video or either names none; null without a zoom."""
    other = (F.coalesce(video, F.lit("")) != "") & (F.coalesce(state_video, F.lit("")) != "") & (video != state_video)
    return F.when(~F.coalesce(other, F.lit(False)) & finite(zoom).isNotNull(), fov(zoom))
