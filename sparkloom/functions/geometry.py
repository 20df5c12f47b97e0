"""Plane geometry as column expressions.

A view maps content to the screen: screen = content * scale + (tx, ty). A rect
has a centre, two unit axes u and v, and half lengths along them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low, high) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.least(high, F.greatest(low, value))


def short_side(half_u: Column, half_v: Column) -> Column:
    return 2 * F.least(half_u, half_v)


def grown_by(half_u: Column, half_v: Column, ratio: Column) -> Column:
    """By how much each half grows when area times ratio is spread over the perimeter; 0 without a perimeter."""
    perimeter = 4 * (half_u + half_v)
    return F.when(perimeter == 0, F.lit(0.0)).otherwise(4 * half_u * half_v * ratio / perimeter)


def corners(cx, cy, ux, uy, vx, vy, half_u, half_v) -> Column:
    """The corners (-,-), (+,-), (+,+), (-,+)."""
    at = lambda a, b: F.struct((cx + a * half_u * ux + b * half_v * vx).alias("x"), (cy + a * half_u * uy + b * half_v * vy).alias("y"))
    return F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1))


def cross(ax, ay, bx, by) -> Column:
    return ax * by - ay * bx


def fit_scale(view_w, view_h, content_w, content_h) -> Column:
    return F.least(view_w / content_w, view_h / content_h)


def visible_region(scale, tx, ty, view_w, view_h, content_w, content_h) -> Column:
    """Whole content pixels that the view shows."""
    x0, y0 = clamp(F.floor(-tx / scale), 0, content_w), clamp(F.floor(-ty / scale), 0, content_h)
    x1, y1 = clamp(F.ceil((view_w - tx) / scale), 0, content_w), clamp(F.ceil((view_h - ty) / scale), 0, content_h)
    return F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("width"), (y1 - y0).alias("height"))


def clamp_view(scale, tx, ty, view_w, view_h, content_w, content_h, most) -> Column:
    """A scale from fit to ``most``; per axis, content smaller than the view is centred, larger content covers it."""
    s = clamp(scale, fit_scale(view_w, view_h, content_w, content_h), most)
    axis = lambda t, view, content: F.when(content * s <= view, (view - content * s) / 2).otherwise(clamp(t, view - content * s, 0))
    return F.struct(s.alias("scale"), axis(tx, view_w, content_w).alias("tx"), axis(ty, view_h, content_h).alias("ty"))


def zoom_at(scale, tx, ty, factor, x, y) -> Column:
    """The view scaled about the screen point (x, y), which stays."""
    return F.struct((scale * factor).alias("scale"), (x - (x - tx) * factor).alias("tx"), (y - (y - ty) * factor).alias("ty"))


def pan_by(scale, tx, ty, dx, dy) -> Column:
    return F.struct(scale.alias("scale"), (tx + dx).alias("tx"), (ty + dy).alias("ty"))


def to_screen(scale, tx, ty, x, y) -> Column:
    return F.struct((x * scale + tx).alias("x"), (y * scale + ty).alias("y"))


def live_view(view_w, view_h, content_w, content_h, zoom) -> Column:
    """The content fitted to the view and zoomed about its centre."""
    scale = fit_scale(view_w, view_h, content_w, content_h) * zoom
    return F.struct(scale.alias("scale"), (view_w / 2 - content_w / 2 * scale).alias("tx"), (view_h / 2 - content_h / 2 * scale).alias("ty"))


def resize_view(scale, tx, ty, old_w, old_h, new_w, new_h, content_w, content_h) -> Column:
    """The view after the screen changed its size: the same zoom relative to fit, and what was in the centre stays there; unclamped."""
    new = scale / fit_scale(old_w, old_h, content_w, content_h) * fit_scale(new_w, new_h, content_w, content_h)
    at = lambda t, old, size: size / 2 - (old / 2 - t) / scale * new
    return F.struct(new.alias("scale"), at(tx, old_w, new_w).alias("tx"), at(ty, old_h, new_h).alias("ty"))


def wheel_factor(delta: Column) -> Column:
    """By how much a turn of the wheel zooms."""
    return F.exp(-delta / 300)


def css_transform(scale, tx, ty) -> Column:
    """A view as a CSS matrix."""
    s, x, y = (c.cast("string") for c in (scale, tx, ty))
    return F.concat(F.lit("matrix("), s, F.lit(", 0, 0, "), s, F.lit(", "), x, F.lit(", "), y, F.lit(")"))


def point(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(a, b) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def crop_frame(quad: Column) -> Column:
    """How an upright crop lies in its source: crop (x, y) is at origin + x * r + y * a.

    ``quad`` is top left, top right, bottom right, bottom left. Its sides are
    rounded to whole pixels, one at least; quads one and a half times as high
    as wide are vertical text and turned by a quarter.
    """
    tl, tr, br, bl = (quad[k] for k in range(4))
    side = lambda p, q, r, s: F.greatest(F.lit(1), F.floor(F.greatest(distance(p, q), distance(r, s)) + 0.5)).cast("double")
    w, h = side(tl, tr, bl, br), side(tl, bl, tr, br)
    part = lambda p, q, n: point((q["x"] - p["x"]) / n, (q["y"] - p["y"]) / n)
    frame = lambda origin, r, a, width, height, vertical: F.struct(origin.alias("origin"), r.alias("r"), a.alias("a"), width.cast("int").alias("width"), height.cast("int").alias("height"), F.lit(vertical).alias("vertical"))
    return F.when(h >= 1.5 * w, frame(tr, part(tl, bl, h), part(tr, tl, w), h, w, True)).otherwise(frame(tl, part(tl, tr, w), part(tl, bl, h), w, h, False))


def frame_quad(frame: Column, x0: Column, x1: Column) -> Column:
    """The source quad, in reading order, of a crop's columns from x0 to x1."""
    at = lambda x, y: point(frame["origin"]["x"] + x * frame["r"]["x"] + y * frame["a"]["x"], frame["origin"]["y"] + x * frame["r"]["y"] + y * frame["a"]["y"])
    top, bottom = F.lit(0.0), frame["height"].cast("double")
    return F.array(at(x0, top), at(x1, top), at(x1, bottom), at(x0, bottom))


def ordered_quad(points: Column) -> Column:
    """Four corners as top left, top right, bottom right, bottom left: the two leftmost by y, then the two rightmost; near equals (1e-9) keep their order."""
    keyed = lambda ps, c: F.array_sort(F.transform(ps, lambda p, k: F.struct(F.round(p[c], 9).alias("key"), k.alias("k"), p.alias("p"))))
    by_x = F.transform(keyed(points, "x"), lambda s: s["p"])
    left, right = (F.transform(keyed(F.slice(by_x, start, 2), "y"), lambda s: s["p"]) for start in (1, 3))
    return F.array(left[0], right[0], right[1], left[1])


def inside_quad(corners: list[tuple[Column, Column]], x: Column, y: Column) -> Column:
    """Whether a point is in a convex quad, given by its corners in order, or on its edge."""
    pairs = zip(corners, corners[1:] + corners[:1])
    sides = [cross(bx - ax, by - ay, x - ax, y - ay) for (ax, ay), (bx, by) in pairs]
    return (F.least(*sides) >= 0) | (F.greatest(*sides) <= 0)


def detector_size(width: Column, height: Column, long_side: int) -> Column:
    """Both sides scaled so that the longer is ``long_side``, rounded to a multiple of 32, 32 at least."""
    side = lambda n: F.greatest(F.lit(32), F.floor(n * (F.lit(float(long_side)) / F.greatest(width, height)) / 32 + 0.5) * 32)
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def batch_width(width, height, line_height: int = 48, least: int = 320, most: int = 3200) -> Column:
    """Aggregate: the width of a batch of lines scaled to one height, a multiple of 8 within limits; multiplies before dividing."""
    widest = F.max(line_height * width / height)
    return F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(widest / 8) * 8)).cast("long")


def label_strip(x, y, width, font, centred: bool = True, pad: float = 0.15, text_height: float = 1.2) -> Column:
    """The box that a label's strip covers; (x, y) is its top centre, or its top left."""
    left = x - width / 2 if centred else x
    return F.struct((left - pad * font).alias("x0"), (y - pad * font).alias("y0"), (left + width + pad * font).alias("x1"), (y + (text_height + pad) * font).alias("y1"))


def fitted_font(height, width, measured_per_size, share: float = 0.45, widest: float = 0.9) -> Column:
    """Font size of a label: a share of the character's height, less if its text would be too wide."""
    font = share * height
    natural = measured_per_size * font
    return F.when(natural > widest * width, font * widest * width / natural).otherwise(font)
