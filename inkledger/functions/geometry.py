"""Pixel boxes, physical units and viewports as Column expressions.

A box is a struct ``(x0, y0, x1, y1)`` of ints, half open.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _num(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def round_int(value: Column) -> Column:
    """Round half to even, as int."""
    return F.bround(value).cast("int")


def inches_to_px(inches: Column | float, dpi: Column | float) -> Column:
    """Whole pixels, never below one."""
    return F.greatest(F.lit(1), round_int(_num(inches) * _num(dpi)))


def px_to_inches(px: Column, dpi: Column) -> Column:
    return px / dpi


def factor_for_dpi(dpi: Column, target: float) -> Column:
    """Integer decimation that lands nearest to ``target`` dpi."""
    return F.greatest(F.lit(1), round_int(_num(dpi) / F.lit(float(target))))


def effective_dpi(dpi: Column, factor: Column) -> Column:
    return dpi / factor


def factor_for_scale(scale: Column) -> Column:
    """Largest power of two that is not coarser than the display scale."""
    wanted = F.greatest(F.lit(1), F.floor(F.lit(1.0) / scale).cast("int"))
    return F.when(scale >= 1, F.lit(1)).otherwise(
        F.call_function("shiftleft", F.lit(1), F.length(F.bin(wanted)) - 1)
    )


# ----------------------------------------------------------------------- boxes

def make_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    names = ("x0", "y0", "x1", "y1")
    return F.struct(*[v.cast("int").alias(n) for n, v in zip(names, (x0, y0, x1, y1))])


def centered(cx: Column, cy: Column, half: Column) -> Column:
    return make_box(
        round_int(cx - half), round_int(cy - half), round_int(cx + half), round_int(cy + half)
    )


def width(box: Column) -> Column:
    return box["x1"] - box["x0"]


def height(box: Column) -> Column:
    return box["y1"] - box["y0"]


def center_x(box: Column) -> Column:
    return (box["x0"] + box["x1"]) / F.lit(2.0)


def center_y(box: Column) -> Column:
    return (box["y0"] + box["y1"]) / F.lit(2.0)


def expand(box: Column, px: Column | int) -> Column:
    px = _num(px)
    return make_box(box["x0"] - px, box["y0"] - px, box["x1"] + px, box["y1"] + px)


def shift(box: Column, dx: Column | int, dy: Column | int) -> Column:
    dx, dy = _num(dx), _num(dy)
    return make_box(box["x0"] + dx, box["y0"] + dy, box["x1"] + dx, box["y1"] + dy)


def clip(box: Column, page_width: Column | int, page_height: Column | int) -> Column:
    w, h = _num(page_width), _num(page_height)

    def hold(value: Column, limit: Column) -> Column:
        return F.greatest(F.lit(0), F.least(value, limit))

    return make_box(
        hold(box["x0"], w), hold(box["y0"], h), hold(box["x1"], w), hold(box["y1"], h)
    )


def is_empty(box: Column) -> Column:
    return (width(box) <= 0) | (height(box) <= 0)


def viewport_box(
    vx: Column, vy: Column, scale: Column, vw: Column, vh: Column,
    page_width: Column, page_height: Column,
) -> Column:
    """Native pixels that a ``vw`` x ``vh`` screen shows at ``scale``."""
    step = F.lit(1.0) / F.greatest(scale, F.lit(1e-12))
    return clip(
        make_box(
            F.floor(vx), F.floor(vy),
            F.ceil(vx + F.greatest(F.lit(1), vw) * step),
            F.ceil(vy + F.greatest(F.lit(1), vh) * step),
        ),
        page_width, page_height,
    )


def clipped_by_page(
    box: Column, cx: Column, cy: Column, radius: Column, page_width: Column, page_height: Column
) -> Column:
    """The circle leaves the page on a side that the crop box touches."""
    return (
        ((box["x0"] == 0) & (cx - radius < 0))
        | ((box["x1"] == page_width) & (cx + radius > page_width))
        | ((box["y0"] == 0) & (cy - radius < 0))
        | ((box["y1"] == page_height) & (cy + radius > page_height))
    )
