"""Screen and image geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_image(client: Column, corner: Column, offset: Column, scale: Column) -> Column:
    return (client - corner - offset) / scale


def to_screen(value: Column, scale: Column, offset: Column) -> Column:
    return value * scale + offset


def fit(width: Column, height: Column, view_w: Column, view_h: Column) -> tuple[Column, Column, Column]:
    """Scale that shows a whole image with 5 % to spare, and the offsets that centre it."""
    scale = F.least(view_w / width, view_h / height) * 0.95
    return scale, (view_w - width * scale) / 2, (view_h - height * scale) / 2


def zoomed(scale: Column, factor: Column) -> Column:
    """The scale after a zoom step, kept between 0.05 and 20."""
    return F.greatest(F.lit(0.05), F.least(F.lit(20.0), scale * factor))


def anchored(offset: Column, at: Column, before: Column, after: Column) -> Column:
    """The offset that keeps the point under `at` in its place."""
    return at - (at - offset) * (after / before)


def rectangle(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column, Column, Column]:
    """Left, top, width and height."""
    return F.least(x1, x2), F.least(y1, y2), F.abs(x2 - x1), F.abs(y2 - y1)


def cropped(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """A selection in whole pixels inside the image."""
    left, top = F.greatest(F.lit(0), F.floor(x + 0.5)), F.greatest(F.lit(0), F.floor(y + 0.5))
    return left, top, F.least(width - left, F.floor(w + 0.5)), F.least(height - top, F.floor(h + 0.5))


def crop_accepted(w: Column, h: Column) -> Column:
    return (w > 10) & (h > 10)


def marker_scale(scale: Column) -> Column:
    return F.least(F.lit(1.0), 1 / scale)


def thumbnail(width: Column, height: Column, most: int = 120) -> tuple[Column, Column]:
    ratio = F.least(most / width, most / height)
    return F.floor(width * ratio), F.floor(height * ratio)
