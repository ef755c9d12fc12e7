"""Dilation, erosion, closing and opening with a square of side 2r + 1.

Masks go through as bit planes: of whole images, or with ``wide=True`` of tiles with halos, whose windows reach as far as an operator does.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import KEY
from .packed import pack, unpack
from .planes import Planes, closed, dilated, eroded, opened
from .tiled import masks, on_windows


def _apply(planes: Planes, operator: Callable) -> Planes:
    return {"bits": operator(planes["bits"])}


def on_bits(mask: DataFrame, operator: Callable, halo: int, wide: bool = False, column: str = "active") -> DataFrame:
    """``mask`` with a column replaced by what ``operator`` makes of its plane; ``halo`` is how far a cell's result looks."""
    tiles = masks(mask.select(*KEY, F.col(column).alias("active"))) if wide else pack(mask, column=column)
    made = unpack(on_windows(tiles, partial(_apply, operator=operator), ["bits"], {"bits": "boolean"}, halo if wide else 0), {"bits": column})
    others = [c for c in mask.columns if c not in (*KEY, column)]
    return (mask.select(*KEY, *others).join(made, list(KEY)) if others else made).select(*mask.columns)


def dilate(mask: DataFrame, radius: int, column: str = "active", wide: bool = False) -> DataFrame:
    """Cells with an active one in their square; the square is cut at the image's edge. A radius of 0 or less changes nothing."""
    return on_bits(mask, partial(dilated, radius=radius), radius, wide, column) if radius > 0 else mask


def erode(mask: DataFrame, radius: int, column: str = "active", border: str = "inactive", wide: bool = False) -> DataFrame:
    """Cells whose whole square is active. Outside the image counts as inactive, or with ``border="ignore"`` does not count."""
    return on_bits(mask, partial(eroded, radius=radius, border=border), radius, wide, column) if radius > 0 else mask


def close(mask: DataFrame, radius: int, column: str = "active", border: str = "inactive", wide: bool = False) -> DataFrame:
    """Dilation, then erosion. With an inactive border cells near the image's edge are lost."""
    return on_bits(mask, partial(closed, radius=radius, border=border), 2 * radius, wide, column) if radius > 0 else mask


def open_(mask: DataFrame, radius: int, column: str = "active", border: str = "inactive", wide: bool = False) -> DataFrame:
    """Erosion, then dilation."""
    return on_bits(mask, partial(opened, radius=radius, border=border), 2 * radius, wide, column) if radius > 0 else mask
