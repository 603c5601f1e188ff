"""Colour and pixel arithmetic as column expressions. Channels are integers from 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance2(r: Column, g: Column, b: Column, to: tuple) -> Column:
    """Squared Euclidean distance to a colour (numbers or columns); whole numbers, so tolerances compare without a root."""
    return (r - to[0]) * (r - to[0]) + (g - to[1]) * (g - to[1]) + (b - to[2]) * (b - to[2])


def distance(r: Column, g: Column, b: Column, to: tuple) -> Column:
    return F.sqrt(distance2(r, g, b, to).cast("double"))


def brightness(r: Column, g: Column, b: Column) -> Column:
    return (r + g + b) / F.lit(3.0)


def saturation(r: Column, g: Column, b: Column) -> Column:
    high = F.greatest(r, g, b)
    return F.when(high == 0, F.lit(0.0)).otherwise((high - F.least(r, g, b)) / F.nullif(high.cast("double"), F.lit(0.0)))


def spread(r: Column, g: Column, b: Column) -> Column:
    """The largest difference of two channels."""
    return F.greatest(F.abs(r - g), F.abs(g - b), F.abs(r - b))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def rounded(x: Column) -> Column:
    """Half up, as browsers round."""
    return F.floor(x + 0.5).cast("long")


def matches(r: Column, g: Column, b: Column, a: Column, to: tuple, tolerance) -> Column:
    """Opaque enough (alpha from 128) and nearer than the tolerance."""
    return (a >= 128) & (distance2(r, g, b, to) < tolerance * tolerance)


def blue_gray(r: Column, g: Column, b: Column) -> Column:
    """The colour of anti-aliased legend text."""
    return (b > g) & (g > r) & r.between(100, 125) & g.between(130, 150) & b.between(165, 185) & (saturation(r, g, b) < 0.35)


def coloured(r: Column, g: Column, b: Column) -> Column:
    """Neither near white nor near black, not gray, not text."""
    shade = brightness(r, g, b)
    return (shade > 30) & (shade < 240) & (spread(r, g, b) > 10) & ~blue_gray(r, g, b)


def grayish(r: Column, g: Column, b: Column) -> Column:
    """A mean colour that is gray: less than 15 apart, between 50 and 220."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    return (high - low < 15) & (high > 50) & (high < 220)


def inked(r: Column, g: Column, b: Column) -> Column:
    shade = brightness(r, g, b)
    return (shade > 20) & (shade < 240)


def extreme(r: Column, g: Column, b: Column) -> Column:
    """Paper or line: all channels above 240, or all below 15. Left out of colour samples."""
    return ((r > 240) & (g > 240) & (b > 240)) | ((r < 15) & (g < 15) & (b < 15))
