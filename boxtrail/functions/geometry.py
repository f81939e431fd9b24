"""Box, region and line arithmetic as plain Spark columns."""

from __future__ import annotations

from collections import namedtuple

from pyspark.sql import Column, functions as F

Box = namedtuple("Box", "x1 y1 x2 y2")


def box(alias: str | None = None, suffix: str = "") -> Box:
    """Columns x1..y2 of an aliased frame (``box("d")``) or with a name suffix."""
    dot = f"{alias}." if alias else ""
    return Box(*(F.col(f"{dot}{name}{suffix}") for name in Box._fields))


def field_box(struct: Column) -> Box:
    return Box(*(struct[name] for name in Box._fields))


def num(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def clamp(value: Column, low=0.0, high=1.0) -> Column:
    return F.greatest(num(low), F.least(num(high), value))


def center(b: Box) -> tuple[Column, Column]:
    return (b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2


def area(b: Box) -> Column:
    return (b.x2 - b.x1) * (b.y2 - b.y1)


def xywh_to_xyxy(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return Box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def xyxy_to_xywh(b: Box) -> dict[str, Column]:
    cx, cy = center(b)
    return {"cx": cx, "cy": cy, "w": b.x2 - b.x1, "h": b.y2 - b.y1}


def intersection(a: Box, b: Box) -> Column:
    wide = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    high = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), high)


def iou(a: Box, b: Box, guard: str = "zero") -> Column:
    """Intersection over union. ``guard`` is the empty-union rule: zero, epsilon or floor."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    if guard == "epsilon":
        return inter / (union + 1e-7)
    if guard == "floor":
        return inter / F.greatest(union, F.lit(1e-9))
    return F.when(union > 0, inter / union).otherwise(0.0)


def square_iou(x: Column, y: Column, side, b: Box) -> Column:
    half = num(side) / 2
    square = Box(x - half, y - half, x + half, y + half)
    return iou(square, b, guard="floor")


def circle_overlap(x1, y1, r1, x2, y2, r2) -> Column:
    """1-d/(r1+r2) for crossing circles, squared radius ratio when one lies inside the other."""
    d = F.hypot(x1 - x2, y1 - y2)
    small, large = F.least(r1, r2), F.greatest(r1, r2)
    return (
        F.when(d >= r1 + r2, 0.0)
        .when(d <= F.abs(r1 - r2), small * small / F.greatest(F.lit(1.0), large * large))
        .otherwise(F.greatest(F.lit(0.0), 1 - d / F.greatest(F.lit(1.0), r1 + r2)))
    )


def half_even(value: Column) -> Column:
    return F.rint(value).cast("long")


def scaled_roi(width: Column, height: Column, cfg: dict) -> Box:
    """Reference-frame region scaled to a frame size; a region outside the frame raises."""
    sx, sy = width / cfg["reference_width"], height / cfg["reference_height"]
    raw = Box(
        half_even(cfg["x"] * sx),
        half_even(cfg["y"] * sy),
        half_even((cfg["x"] + cfg["width"]) * sx),
        half_even((cfg["y"] + cfg["height"]) * sy),
    )
    inside = (
        (raw.x1 >= 0) & (raw.x1 < raw.x2) & (raw.x2 <= width) & (raw.y1 >= 0) & (raw.y1 < raw.y2) & (raw.y2 <= height)
    )
    bad = F.raise_error(F.lit("region lies outside the frame")).cast("long")
    return Box(*(F.when(inside, c).otherwise(bad) for c in raw))


def unrotate(b: Box, degrees: Column) -> Box:
    """Undo a counter-clockwise region rotation of 0, 90 or 270 degrees (normalized box)."""
    turned = {90: (1 - b.y2, b.x1, 1 - b.y1, b.x2), 270: (b.y1, 1 - b.x2, b.y2, 1 - b.x1), 0: tuple(b)}
    bad = F.raise_error(F.lit("rotation must be 0, 90 or 270 degrees")).cast("double")

    def pick(i):
        return (
            F.when(degrees == 0, turned[0][i]).when(degrees == 90, turned[90][i]).when(degrees == 270, turned[270][i])
        ).otherwise(bad)

    return Box(*(pick(i) for i in range(4)))


def region_to_frame(b: Box, roi: Box) -> Box:
    """Normalized region box to whole frame pixels."""
    w, h = roi.x2 - roi.x1, roi.y2 - roi.y1
    return Box(
        half_even(roi.x1 + b.x1 * w),
        half_even(roi.y1 + b.y1 * h),
        half_even(roi.x1 + b.x2 * w),
        half_even(roi.y1 + b.y2 * h),
    )


def letterbox(b: Box, scale_x, scale_y, offset_x, offset_y) -> Box:
    return Box(
        b.x1 * scale_x + offset_x, b.y1 * scale_y + offset_y, b.x2 * scale_x + offset_x, b.y2 * scale_y + offset_y
    )


def unletterbox(b: Box, roi: Box, content_w, content_h, offset_x, offset_y) -> tuple[Box, Column]:
    """Box on the padded canvas to the frame, and whether its center lies in the content area."""
    sx, sy = (roi.x2 - roi.x1) / content_w, (roi.y2 - roi.y1) / content_h
    cx, cy = center(b)
    inside = (cx >= offset_x) & (cx < num(offset_x) + content_w) & (cy >= offset_y) & (cy < num(offset_y) + content_h)
    mapped = Box(
        roi.x1 + clamp(b.x1 - offset_x, 0.0, content_w) * sx,
        roi.y1 + clamp(b.y1 - offset_y, 0.0, content_h) * sy,
        roi.x1 + clamp(b.x2 - offset_x, 0.0, content_w) * sx,
        roi.y1 + clamp(b.y2 - offset_y, 0.0, content_h) * sy,
    )
    return mapped, inside


def patch_to_frame(bx, by, bw, bh, droplet_x, droplet_y, patch_size) -> dict[str, Column]:
    half = num(patch_size) / 2
    return {
        "frame_x": half_even(droplet_x - half + bx),
        "frame_y": half_even(droplet_y - half + by),
        "frame_w": F.greatest(F.lit(1).cast("long"), bw.cast("long")),
        "frame_h": F.greatest(F.lit(1).cast("long"), bh.cast("long")),
    }


def clip_to_crop(b: Box, crop: Box, min_visible: float, min_side: float = 2.0) -> dict[str, Column]:
    """Crop-relative box plus ``keep`` and ``fragment`` flags (both false: no overlap at all)."""
    cut = Box(F.greatest(b.x1, crop.x1), F.greatest(b.y1, crop.y1), F.least(b.x2, crop.x2), F.least(b.y2, crop.y2))
    w = F.greatest(F.lit(0.0), cut.x2 - cut.x1)
    h = F.greatest(F.lit(0.0), cut.y2 - cut.y1)
    full = F.greatest(F.lit(0.0), b.x2 - b.x1) * F.greatest(F.lit(0.0), b.y2 - b.y1)
    touches = (w * h > 0) & (full > 0)
    cx, cy = center(b)
    central = cx.between(crop.x1, crop.x2) & cy.between(crop.y1, crop.y2)
    visible = central | (w * h / full >= min_visible)
    keep = touches & visible & (w >= min_side) & (h >= min_side)
    return {
        "keep": keep,
        "fragment": touches & ~keep,
        "x1": cut.x1 - crop.x1,
        "y1": cut.y1 - crop.y1,
        "x2": cut.x2 - crop.x1,
        "y2": cut.y2 - crop.y1,
    }


def crop_by_center(b: Box, region: Box, min_side: float = 1.0) -> dict[str, Column]:
    cx, cy = center(b)
    half_open = (cx >= region.x1) & (cx < region.x2) & (cy >= region.y1) & (cy < region.y2)
    x1, x2 = (clamp(v, region.x1, region.x2) - region.x1 for v in (b.x1, b.x2))
    y1, y2 = (clamp(v, region.y1, region.y2) - region.y1 for v in (b.y1, b.y2))
    return {
        "keep": half_open & (x2 - x1 >= min_side) & (y2 - y1 >= min_side),
        "x1": x1,
        "y1": y1,
        "x2": x2,
        "y2": y2,
    }


def translate_label(cx: Column, w: Column, delta, min_visible: float = 0.25) -> dict[str, Column]:
    """Horizontal shift of a normalized label; ``keep`` needs enough of the width still visible."""
    left, right = clamp(cx - w / 2 + delta), clamp(cx + w / 2 + delta)
    seen = right - left
    return {"keep": (seen > 0) & (seen >= w * min_visible), "cx": (left + right) / 2, "w": seen}


def coco_to_yolo(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    x1, y1 = clamp(x, 0.0, width), clamp(y, 0.0, height)
    x2, y2 = clamp(x + w, 0.0, width), clamp(y + h, 0.0, height)
    return {
        "keep": (x2 - x1 > 0) & (y2 - y1 > 0),
        "cx": (x1 + x2) / 2 / width,
        "cy": (y1 + y2) / 2 / height,
        "w": (x2 - x1) / width,
        "h": (y2 - y1) / height,
    }


def calibrate_box(b: Box, width_scale=1.0, height_scale=1.0, center_x_offset=0.0, center_y_offset=0.0) -> Box:
    cx, cy = center(b)
    cx, cy = cx + center_x_offset, cy + center_y_offset
    w, h = (b.x2 - b.x1) * width_scale, (b.y2 - b.y1) * height_scale
    return Box(*(clamp(v) for v in xywh_to_xyxy(cx, cy, w, h)))


def touches_edge(b: Box, frame: Box, margin) -> Column:
    return (
        (b.x1 <= frame.x1 + margin)
        | (b.y1 <= frame.y1 + margin)
        | (b.x2 >= frame.x2 - margin)
        | (b.y2 >= frame.y2 - margin)
    )


def unit_frame() -> Box:
    return Box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))


def in_expanded_box(px: Column, py: Column, b: Box, expansion) -> Column:
    cx, cy = center(b)
    hw, hh = (b.x2 - b.x1) * expansion / 2, (b.y2 - b.y1) * expansion / 2
    return px.between(cx - hw, cx + hw) & py.between(cy - hh, cy + hh)


def in_margin_box(px: Column, py: Column, b: Box, margin) -> Column:
    w, h = b.x2 - b.x1, b.y2 - b.y1
    return px.between(b.x1 - w * margin, b.x2 + w * margin) & py.between(b.y1 - h * margin, b.y2 + h * margin)


def in_any_box(px: Column, py: Column, boxes: Column, margin) -> Column:
    """True inside any box of an array column, and also when the array is empty."""
    return (F.size(boxes) == 0) | F.exists(boxes, lambda b: in_margin_box(px, py, field_box(b), margin))


def line_side(x: Column, line, hysteresis) -> Column:
    return F.when(x <= num(line) - hysteresis, -1).when(x >= num(line) + hysteresis, 1).otherwise(0)
