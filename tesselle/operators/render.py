"""Masks and pixels to output pixels."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import KEY
from .morphology import on_bits
from .packed import PLACE
from .planes import Planes, alphas, distances, eroded, together
from .tiled import by_tile, masks, on_windows, picture, pixels_of

#: Alpha of the ring between the eroded and the whole mask.
RING_ALPHA = 160


def mask_image(mask: DataFrame) -> DataFrame:
    """White where active, else black; opaque."""
    level = F.when(F.col("active"), 255).otherwise(0)
    return mask.select(*KEY, F.lit(255).alias("a"), *(level.alias(c) for c in "rgb"))


_ARGB = {c: "int" for c in "argb"}


def cut(planes: Planes, alpha: np.ndarray) -> Planes:
    """The channels with an alpha, nothing where that is 0."""
    return {"a": alpha, **{c: np.where(alpha > 0, planes[c], 0).astype(np.int32) for c in "rgb"}}


def cut_smooth(pixels: Planes, mask: Planes, radius: int) -> Planes:
    return cut(pixels, alphas(mask["active"], eroded(mask["active"], radius), RING_ALPHA))


def _cut_progressive(pixels: Planes, mask: Planes, radius: int) -> Planes:
    depth = np.minimum(distances(mask["active"]), radius + 1)
    return cut(pixels, depth * 255 // (radius + 1))


def clipped_tiles(pictures: DataFrame, tiles: DataFrame, function: Callable[..., Planes], radius: int) -> DataFrame:
    """Tiles with ``argb`` clipped by tiles with ``bits``; tiles without a mask are inactive."""
    both = by_tile(pictures, tiles.select(*PLACE, "bits"), "left")
    return on_windows(both, partial(_cut_window, function=function, radius=radius), ["argb", "bits"], {"argb": "argb"}, radius)


def _cut_window(planes: Planes, function: Callable[..., Planes], radius: int) -> Planes:
    made = function(planes, {"active": planes["bits"]}, radius=radius)
    return {"argb": np.stack([made[c] for c in "argb"], -1)}


def _clip(pixels: DataFrame, mask: DataFrame, function: Callable[..., Planes], radius: int, wide: bool) -> DataFrame:
    if wide:
        return pixels_of(clipped_tiles(picture(pixels), masks(mask), function, radius))
    return together(pixels, mask, partial(function, radius=radius), (["r", "g", "b"], ["active"]), _ARGB, [*KEY])


def clip_hard(pixels: DataFrame, mask: DataFrame, wide: bool = False) -> DataFrame:
    """Pixels opaque where the mask is active and gone elsewhere; their own alpha is not used."""
    return _clip(pixels, mask, cut_smooth, 0, wide)


def clip_smooth(pixels: DataFrame, mask: DataFrame, radius: int = 1, wide: bool = False) -> DataFrame:
    """As :func:`clip_hard`, with a half-transparent ring ``radius`` wide within the mask's edge."""
    return _clip(pixels, mask, cut_smooth, max(radius, 0), wide)


def clip_progressive(pixels: DataFrame, mask: DataFrame, radius: int = 2, wide: bool = False) -> DataFrame:
    """As :func:`clip_hard`, with alpha rising from the mask's edge over ``radius`` rings to opaque; a cell's ring is its distance from the edge, so their number costs nothing."""
    return _clip(pixels, mask, _cut_progressive, max(radius, 0), wide)


def _laid_over(pixels: Planes, overlay: Planes, strength: float) -> Planes:
    k = strength * overlay["a"] / 255.0
    return {c: np.floor(overlay[c] * k + pixels[c] * (1.0 - k) + 0.5).astype(np.int32) for c in "rgb"}


def overlay_preview(pixels: DataFrame, overlay: DataFrame | None, strength: float = 0.45, wide: bool = False) -> DataFrame:
    """The overlay laid over the pixels at a strength times its own alpha; without one, the pixels."""
    if overlay is None:
        return pixels.select(*KEY, "a", "r", "g", "b")
    if not wide:
        return together(pixels, overlay, partial(_laid_over, strength=strength), (["r", "g", "b"], ["a", "r", "g", "b"]), {c: "int" for c in "rgb"}, [*KEY, "a", "r", "g", "b"])
    top = overlay.select(*KEY, *(F.col(c).alias(f"o{c}") for c in "argb"))
    k = F.lit(strength) * F.coalesce("oa", F.lit(0)) / F.lit(255.0)
    mixed = [F.floor(F.coalesce(f"o{c}", F.lit(0)) * k + F.col(c) * (F.lit(1.0) - k) + F.lit(0.5)).cast("int").alias(c) for c in "rgb"]
    return pixels.join(top, list(KEY), "left").select(*KEY, "a", *mixed)


def _rim(mask: np.ndarray) -> np.ndarray:
    return mask & ~eroded(mask, 1, "ignore")


def rim(mask: DataFrame, wide: bool = False) -> DataFrame:
    """Active cells next to one that is not."""
    return on_bits(mask.select(*KEY, "active"), _rim, 1, wide)


def checkerboard(cells: DataFrame, side: int = 12) -> DataFrame:
    """Squares of light grey and white, as shown behind transparent pixels."""
    level = F.when((F.expr(f"x div {side}") + F.expr(f"y div {side}")) % 2 == 0, 220).otherwise(255)
    return cells.select(*KEY, F.lit(255).alias("a"), *(level.alias(c) for c in "rgb"))


def fit(width: Column, height: Column, view_width: int, view_height: int) -> tuple[Column, Column, Column]:
    """Scale, left and top at which an image lies centred in a view, with a margin of 10 beside and 20 above and below."""
    scale = F.least((F.lit(view_width) - 20) / width, (F.lit(view_height) - 40) / height)
    left = ((F.lit(view_width) - (width * scale).cast("int")) / 2).cast("int")
    top = ((F.lit(view_height) - (height * scale).cast("int")) / 2).cast("int")
    return scale, left, top
