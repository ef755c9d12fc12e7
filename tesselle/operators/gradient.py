"""Sobel gradients of the luminance."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import KEY
from .packed import unpack
from .planes import Planes, gradients, per_image
from .tiled import on_windows, picture


def _sobel(planes: Planes) -> Planes:
    return dict(zip(("gx", "gy"), gradients(planes["r"], planes["g"], planes["b"]), strict=True))


def _sobel_beside(planes: Planes) -> Planes:
    return planes | _sobel(planes)


def sobel(pixels: DataFrame, wide: bool = False) -> DataFrame:
    """``pixels`` with gx and gy, null on the image's edge: a difference along one axis and a weighted sum along the other.

    With ``wide`` only image_id, x, y and the channels are kept of other columns.
    """
    if not wide:
        return per_image(pixels, _sobel, ["r", "g", "b"], {"gx": "int", "gy": "int"})
    made = on_windows(picture(pixels), _sobel_beside, ["argb"], dict.fromkeys(("a", "r", "g", "b", "gx", "gy"), "int"), 1)
    kept = [c for c in pixels.columns if c in "argb"]
    return unpack(made, {c: c for c in (*kept, "gx", "gy")})


def threshold(sensitivity: float) -> int:
    """The least magnitude of an edge: 75 over the sensitivity, in single precision and cut off, at least 30 (fixed values)."""
    single = lambda v: struct.unpack("f", struct.pack("f", v))[0]
    return max(30, int(single(75.0 / single(sensitivity))))


def edges(pixels: DataFrame, sensitivity: float, wide: bool = False) -> DataFrame:
    """Mask of the inner pixels whose gradient is as large as the threshold; squares are compared, so no root is taken."""
    t = threshold(sensitivity)
    strong = F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") >= t * t
    return sobel(pixels.select(*KEY, "r", "g", "b"), wide).select(*KEY, F.coalesce(strong, F.lit(False)).alias("active"))
