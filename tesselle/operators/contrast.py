"""Local contrast of the luminance."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame

from ..functions.color import luminance
from ..schema import KEY
from .packed import unpack
from .planes import Planes, per_image, spread
from .tiled import on_windows, picture

#: Fixed value: the level over which all channels of a white road lie where its surroundings count too.
WHITE_OVER = 230


def _range(planes: Planes, radius: int) -> Planes:
    return {"range": spread(luminance(planes["r"], planes["g"], planes["b"]), radius)}


def _on(pixels: DataFrame, function, made: dict[str, str], radius: int, wide: bool) -> DataFrame:
    if wide:
        return unpack(on_windows(picture(pixels), function, ["argb"], made, radius), {c: c for c in made})
    return per_image(pixels, function, ["r", "g", "b"], made, [*KEY])


def local_range(pixels: DataFrame, radius: int = 2, wide: bool = False) -> DataFrame:
    """image_id, x, y and range: the largest less the smallest luminance of the square around each pixel, cut at the image's edge. The cost does not
    depend on the radius."""
    return _on(pixels, partial(_range, radius=radius), {"range": "int"}, radius, wide)


def _white(planes: Planes, radius: int, least: int) -> Planes:
    white = (planes["r"] > WHITE_OVER) & (planes["g"] > WHITE_OVER) & (planes["b"] > WHITE_OVER)
    return {"active": white & (_range(planes, radius)["range"] >= least)}


def white_with_contrast(pixels: DataFrame, radius: int = 2, least: int = 20, wide: bool = False) -> DataFrame:
    """Mask of white pixels around which the luminance ranges over at least ``least``: a white road on other ground, not the middle of white ground."""
    return _on(pixels, partial(_white, radius=radius, least=least), {"active": "boolean"}, radius, wide)
