"""Where directions show on a stage of some width and height: markers, and the guide line from the foot of the stage to its edge. Points are structs of x, y in pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import signed_delta
from .numbers import clamp, finite, let, num

#: Directions this far from the view's are not drawn in perspective; markers may lie this far beyond the stage's edge, guides end this near to it.
STEEP, BEYOND, WITHIN = 89.0, 1.2, 0.92


def point(x: Column, y: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def view_of(zoom: Column, narrowest: float = 1.0, widest: float = 179.0, full: Column | float = 90.0) -> Column:
    """The horizontal angle of view: the full one over the zoom, where that is a positive number."""
    known = finite(zoom)
    return clamp(num(full) / F.when(known > 0, known).otherwise(1.0), narrowest, widest)


def in_view(yaw: Column, pitch: Column, view_yaw: Column, view_pitch: Column, view_h: Column, width: Column, height: Column) -> tuple[Column, Column, Column]:
    """The turn from the view to a direction, and the direction's place in the view: -1 to 1 from left to right and from top to bottom.

    A perspective division of each angle by itself: of the angle's tangent by that of half the view. The places are null for steep turns.
    """
    turn = signed_delta(view_yaw, yaw)
    rise = clamp(pitch, -90, 90) - clamp(F.coalesce(finite(view_pitch), F.lit(0.0)), -90, 90)
    half = F.tan(F.radians(view_h / 2))
    ahead = F.abs(turn) < STEEP
    return turn, F.when(ahead, finite(F.tan(F.radians(turn)) / half)), F.when(ahead, finite(-F.tan(F.radians(rise)) / (half * height / width)))


def on_stage(across: Column, down: Column, width: Column, height: Column) -> Column:
    return point((across + 1) / 2 * width, (down + 1) / 2 * height)


def staged(width: Column, height: Column, at: Column) -> Column:
    """Nothing shows on a stage without width or height."""
    return F.when((width > 0) & (height > 0), at)


def ratio_point(x_ratio: Column, y_ratio: Column, width: Column, height: Column) -> Column:
    """The point of an image at these parts of its width and height; null if one isn't known."""
    return point(clamp(finite(x_ratio), 0, 1) * width, clamp(finite(y_ratio), 0, 1) * height)


def marker(
    yaw: Column, pitch: Column, view_yaw: Column, view_pitch: Column, zoom: Column, width: Column, height: Column,
    *, flat: Column | bool = False, x_ratio: Column | None = None, y_ratio: Column | None = None, auto: Column | bool = False,
    own_yaw: Column | None = None, own_pitch: Column | None = None, own_zoom: Column | None = None,
) -> Column:
    """Where a target's marker is drawn; null where it isn't.

    In flat mode a target with image ratios is drawn there, an automatic one without them is hidden, and any other is seen in the view it was made in
    (own_*), where all of that is known. Otherwise it is seen in the view, and hidden where it lies far beyond the edge or steeply aside.
    """
    none = F.lit(None).cast("double")
    flat, auto = (x if isinstance(x, Column) else F.lit(x) for x in (flat, auto))
    own = [finite(x) if x is not None else none for x in (own_yaw, own_pitch, own_zoom)]
    its = flat & own[0].isNotNull() & own[1].isNotNull() & own[2].isNotNull()
    seen = [F.when(its, x).otherwise(y) for x, y in zip(own, (view_yaw, view_pitch, zoom), strict=True)]
    _, across, down = in_view(yaw, pitch, seen[0], seen[1], view_of(seen[2]), width, height)
    place = F.struct(across.alias("x"), down.alias("y"))
    drawn = let(place, lambda at: F.when((F.abs(at["x"]) <= BEYOND) & (F.abs(at["y"]) <= BEYOND), on_stage(at["x"], at["y"], width, height)))
    image = F.when(flat, ratio_point(none if x_ratio is None else x_ratio, none if y_ratio is None else y_ratio, width, height))
    return staged(width, height, F.when(image.isNotNull(), image).when(~(flat & auto), drawn))


def toward(yaw: Column, pitch: Column, view_yaw: Column, view_pitch: Column, view_h: Column, width: Column, height: Column) -> Column:
    """The point that a guide aims at: a direction ahead where it shows, drawn in if it lies outside; one behind at the foot of its side, the farther the more so."""
    turn, across, down = in_view(yaw, pitch, view_yaw, view_pitch, view_h, width, height)
    rise = clamp(pitch, -90, 90) - clamp(F.coalesce(finite(view_pitch), F.lit(0.0)), -90, 90)

    def ahead(x: Column, y: Column) -> Column:
        y = F.when((F.abs(x) < 0.001) & (F.abs(y) < 0.001), -0.001).otherwise(y)
        pull = F.least(F.lit(1.0), WITHIN / F.greatest(F.abs(x), F.abs(y), F.lit(0.001)))
        return on_stage(x * pull, y * pull, width, height)

    def rear(turn: Column) -> Column:
        behind = clamp((F.abs(turn) - 90) / 90, 0, 1)
        side = F.when(turn >= 0, 1).otherwise(-1)
        return point(width / 2 + side * width * (0.18 + 0.28 * behind), height * (0.78 + 0.12 * behind))

    def beside(right: Column, low: Column) -> Column:
        low = F.when((F.abs(right) < 0.001) & (F.abs(low) < 0.001), -1.0).otherwise(low)
        far = F.hypot(right, low)
        return point(width / 2 + right / far * 100, height / 2 + low / far * 100)

    def aimed(x: Column) -> Column:
        seen = F.when(x["across"].isNotNull() & x["down"].isNotNull(), ahead(x["across"], x["down"]))
        return F.when(seen.isNotNull(), seen).when(F.abs(x["turn"]) > 90, rear(x["turn"])).otherwise(beside(F.sin(F.radians(x["turn"])), -F.sin(F.radians(x["rise"]))))

    return let(F.struct(turn.alias("turn"), across.alias("across"), down.alias("down"), rise.alias("rise")), aimed)


def to_edge(from_x: Column, from_y: Column, to: Column, width: Column, height: Column) -> Column:
    """Where the ray from a point of the stage towards another leaves the stage: the nearest of its crossings with the four sides."""
    zero = F.lit(0.0)

    def leave(way: Column) -> Column:
        cross = lambda side, start, step: F.when(F.abs(step) > 0.001, (side - start) / step)
        right, low = way["right"], way["low"]
        crossings = F.array(cross(zero, from_x, right), cross(width, from_x, right), cross(zero, from_y, low), cross(height, from_y, low))
        first = F.coalesce(F.array_min(F.filter(crossings, lambda t: t > 0)), F.lit(1.0))
        return let(first, lambda t: point(F.greatest(zero, F.least(width, from_x + right * t)), F.greatest(zero, F.least(height, from_y + low * t))))

    right, low = to["x"] - from_x, to["y"] - from_y
    short = F.hypot(right, low) < 1
    return let(F.struct(F.when(short, 0.0).otherwise(right).alias("right"), F.when(short, -1.0).otherwise(low).alias("low")), leave)


def guide(
    yaw: Column, pitch: Column, view_yaw: Column, view_pitch: Column, view_h: Column, width: Column, height: Column,
    *, has_target: Column | bool = True, flat: Column | bool = False, x_ratio: Column | None = None, y_ratio: Column | None = None,
) -> Column:
    """The end of the guide line that starts at the middle of the stage's foot; null where none is drawn.

    Without a target it goes straight up; in flat mode it aims at the target's place in the image; a target without a direction has none.
    """
    none = F.lit(None).cast("double")
    flat, has_target = (x if isinstance(x, Column) else F.lit(x) for x in (flat, has_target))
    image = ratio_point(none if x_ratio is None else x_ratio, none if y_ratio is None else y_ratio, width, height)
    known = finite(yaw).isNotNull() & finite(pitch).isNotNull()
    at = F.when(~has_target, point(width / 2, height / 2)).when(flat, image).when(known, toward(yaw, pitch, view_yaw, view_pitch, view_h, width, height))
    return staged(width, height, let(at, lambda to: F.when(to.isNotNull(), to_edge(width / 2, height * 1.0, to, width, height))))
