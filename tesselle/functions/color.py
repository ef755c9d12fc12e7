"""Colour tests and channel arithmetic, all integer but the luminance: of Columns or their names, or of numpy arrays alike."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Channel = Column | str | np.ndarray

#: The alpha from which a pixel counts, and the lead of green over the other channels.
MIN_ALPHA, GREEN_LEAD = 30, 25
#: Hue bounds in degrees, and the value that 20 % of 255 is.
HUE_FROM, HUE_TO, VALUE_ABOVE = 70, 170, 51


def _c(c: Channel) -> Column | np.ndarray:
    return F.col(c) if isinstance(c, str) else c


def _greatest(*channels):
    return np.maximum.reduce(channels) if isinstance(channels[0], np.ndarray) else F.greatest(*channels)


def _least(*channels):
    return np.minimum.reduce(channels) if isinstance(channels[0], np.ndarray) else F.least(*channels)


def _pick(condition, yes, no):
    return np.where(condition, yes, no) if isinstance(condition, np.ndarray) else F.when(condition, yes).otherwise(no)


def unpack(argb: Column | str) -> tuple[Column, Column, Column, Column]:
    """Alpha, red, green and blue of a packed 32-bit value."""
    argb = _c(argb)
    return tuple(F.shiftright(argb, n).bitwiseAND(255).cast("int").alias(name) for name, n in (("a", 24), ("r", 16), ("g", 8), ("b", 0)))


def pack(a: Column | str, r: Column | str, g: Column | str, b: Column | str) -> Column:
    """The packed 32-bit value of four channels."""
    parts = [F.shiftleft(_c(c).cast("int"), n) for c, n in ((a, 24), (r, 16), (g, 8), (b, 0))]
    return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2]).bitwiseOR(parts[3])


def luminance(r: Channel = "r", g: Channel = "g", b: Channel = "b"):
    """Weighted grey in double precision, cut off to an integer; decimals or rounding would differ for many colours."""
    if isinstance(r, np.ndarray):
        return ((0.299 * r + 0.587 * g) + 0.114 * b).astype(np.int32)
    return ((F.lit(0.299) * _c(r) + F.lit(0.587) * _c(g)) + F.lit(0.114) * _c(b)).cast("int")


def hsv(r: Column | str = "r", g: Column | str = "g", b: Column | str = "b") -> tuple[Column, Column, Column]:
    """Hue in degrees (null for greys), saturation and value in 0..1, as doubles."""
    n, d, top = _hue_parts(_c(r), _c(g), _c(b))
    return F.when(d > 0, F.lit(60.0) * n / d), F.when(top > 0, d / top).otherwise(F.lit(0.0)), top / F.lit(255.0)


def _hue_parts(r, g, b) -> tuple:
    """Hue as sixths n of d = the largest less the smallest channel, d, and the largest channel."""
    top, d = _greatest(r, g, b), _greatest(r, g, b) - _least(r, g, b)
    n = _pick(r == top, g - b, _pick(g == top, 2 * d + b - r, 4 * d + r - g))
    return _pick(n < 0, n + 6 * d, n), d, top


def is_opaque(a: Channel = "a"):
    return _c(a) >= MIN_ALPHA


def leads_green(r: Channel = "r", g: Channel = "g", b: Channel = "b"):
    return (_c(g) > _c(r) + GREEN_LEAD) & (_c(g) > _c(b) + GREEN_LEAD)


def is_green_hue(r: Channel = "r", g: Channel = "g", b: Channel = "b"):
    """Hue within the bounds, saturation and value over a fifth: in integers, the same for every colour as in floating point."""
    n, d, top = _hue_parts(_c(r), _c(g), _c(b))
    return (d > 0) & (60 * n >= HUE_FROM * d) & (60 * n <= HUE_TO * d) & (5 * d > top) & (top > VALUE_ABOVE)


def is_green(a: Channel = "a", r: Channel = "r", g: Channel = "g", b: Channel = "b"):
    return is_opaque(a) & (leads_green(r, g, b) | is_green_hue(r, g, b))


# The bounds of the channels of each kind of road, and of their differences.


def is_orange(r: Channel = "r", g: Channel = "g", b: Channel = "b"):
    r, g, b = _c(r), _c(g), _c(b)
    return (r >= 210) & (g >= 130) & (g <= 220) & (b >= 50) & (b <= 165) & (r - g >= 15)


def is_yellow(r: Channel = "r", g: Channel = "g", b: Channel = "b"):
    r, g, b = _c(r), _c(g), _c(b)
    return (r >= 220) & (g >= 200) & (b >= 100) & (b <= 210) & (r - g <= 35) & (g - r <= 35) & (r - b >= 30)


def is_white(r: Channel = "r", g: Channel = "g", b: Channel = "b"):
    return _least(_c(r), _c(g), _c(b)) >= 240


def is_road(r: Channel = "r", g: Channel = "g", b: Channel = "b"):
    return is_orange(r, g, b) | is_yellow(r, g, b) | is_white(r, g, b)


def road_class(r: Column | str = "r", g: Column | str = "g", b: Column | str = "b") -> Column:
    """The first that fits of orange, yellow and white, else null."""
    return F.when(is_orange(r, g, b), "orange").when(is_yellow(r, g, b), "yellow").when(is_white(r, g, b), "white")
