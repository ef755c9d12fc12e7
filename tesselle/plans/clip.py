"""From a map and a rough green overlay to the clipped region.

An image goes through all steps in one task, from pixels (:func:`stages`) or straight from its bytes (:func:`clip_images`), which never become
rows of pixels. Images too large for a task take ``wide=True``: every step then works on tiles with halos.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ClipConfig
from ..operators import tiled
from ..operators.gradient import threshold
from ..operators.grid import count_active
from ..operators.packed import unpack
from ..operators.planes import Planes, alphas, closed, decoded, eroded, greens, outline, per_image, raw_road_cells, rows_of, summed, together
from ..operators.region import snapped
from ..operators.render import RING_ALPHA, clipped_tiles, cut, cut_smooth, mask_image
from ..schema import KEY, dealt
from ..sources.images import png

MADE = "image_id long, width int, height int, n_green long, n_roads long, n_region long, n_open long, n_sides long, region binary, mask binary"
_MADE = pa.schema([("image_id", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), *((n, pa.int64()) for n in ("n_green", "n_roads", "n_region", "n_open", "n_sides")), ("region", pa.binary()), ("mask", pa.binary())])


def _greens(planes: Planes) -> Planes:
    return {"active": greens(planes)}


def _as_bits(planes: Planes, function) -> Planes:
    return {"bits": function(planes)["active"]}


def green_tiles(pictures: DataFrame) -> DataFrame:
    """The green cells of tiles with ``argb``, without specks."""
    return tiled.on_windows(pictures, partial(_as_bits, function=_greens), ["argb"], {"bits": "boolean"}, 2)


def road_tiles(pictures: DataFrame, level: int, radius: int, border: str) -> DataFrame:
    """The road network of tiles with ``argb``."""
    one = partial(_roads, level=level, radius=radius, border=border)
    return tiled.on_windows(pictures, partial(_as_bits, function=one), ["argb"], {"bits": "boolean"}, 1 + 2 * radius)


def extract_green(pixels: DataFrame, wide: bool = False) -> DataFrame:
    """The green pixels, without specks."""
    if wide:
        return unpack(green_tiles(tiled.picture(pixels)))
    return per_image(pixels, _greens, ["a", "r", "g", "b"], {"active": "boolean"}, [*KEY])


def _roads(planes: Planes, level: int, radius: int, border: str) -> Planes:
    return {"active": closed(raw_road_cells(planes, level), radius, border)}


def raw_roads(pixels: DataFrame, config: ClipConfig | None = None, wide: bool = False) -> DataFrame:
    """Pixels of a road's colour or with a strong edge."""
    config = config or ClipConfig()
    t = threshold(config.road_sensitivity)
    if wide:
        return unpack(road_tiles(tiled.picture(pixels), t, 0, config.border))
    return per_image(pixels, partial(_roads, level=t, radius=0, border=config.border), ["r", "g", "b"], {"active": "boolean"}, [*KEY])


def detect_roads(pixels: DataFrame, config: ClipConfig | None = None, wide: bool = False) -> DataFrame:
    """The road network, small gaps closed."""
    config = config or ClipConfig()
    if wide:
        return unpack(road_tiles(tiled.picture(pixels), threshold(config.road_sensitivity), config.closing_radius, config.border))
    one = partial(_roads, level=threshold(config.road_sensitivity), radius=config.closing_radius, border=config.border)
    return per_image(pixels, one, ["r", "g", "b"], {"active": "boolean"}, [*KEY])


class Clip(NamedTuple):
    green: DataFrame
    roads: DataFrame
    region: DataFrame
    clipped: DataFrame
    mask: DataFrame


def _stages(pixels: Planes, overlay: Planes, config: ClipConfig) -> Planes:
    """All stages of one image: green, roads, active (the grown region), core (it, eroded by the smoothing radius), and the clipped channels."""
    green = greens(overlay)
    roads = closed(raw_road_cells(pixels, threshold(config.road_sensitivity)), config.closing_radius, config.border)
    region = snapped(green, roads, config)
    core = eroded(region, config.smooth_radius)
    return {"green": green, "roads": roads, "active": region, "core": core, **cut(pixels, alphas(region, core, RING_ALPHA))}


def stages(pixels: DataFrame, overlay: DataFrame, config: ClipConfig | None = None) -> DataFrame:
    """Cells of every image of ``pixels`` with green, roads, active, core, and a, r, g, b of the clipped picture, each image once in one task.

    An image without an overlay, or one without green, gives an empty region: see :func:`without_green`.
    """
    made = {"green": "boolean", "roads": "boolean", "active": "boolean", "core": "boolean"} | {c: "int" for c in "argb"}
    return together(pixels, overlay, partial(_stages, config=config or ClipConfig()), (["r", "g", "b"], ["a", "r", "g", "b"]), made, [*KEY])


def clip(pixels: DataFrame, overlay: DataFrame, config: ClipConfig | None = None, wide: bool = False) -> Clip:
    """Masks and pictures of every image of ``pixels`` with its overlay. They are columns of one relation, :func:`stages`: who needs several
    of them writes that once. Images without green give empty masks: see :func:`without_green`."""
    config = config or ClipConfig()
    if wide:
        shown = tiled.picture(pixels)
        green, roads = green_tiles(tiled.picture(overlay)), road_tiles(shown, threshold(config.road_sensitivity), config.closing_radius, config.border)
        region = tiled.snap(green, roads, config)
        clipped = tiled.pixels_of(clipped_tiles(shown, region, cut_smooth, config.smooth_radius))
        return Clip(unpack(green), unpack(roads), unpack(region), clipped, mask_image(unpack(region)))
    made = stages(pixels, overlay, config)
    as_mask = lambda c: made.select(*KEY, F.col(c).alias("active"))
    return Clip(as_mask("green"), as_mask("roads"), as_mask("active"), made.select(*KEY, "a", "r", "g", "b"), mask_image(as_mask("active")))


def without_green(green: DataFrame) -> DataFrame:
    """Images whose overlay selects nothing."""
    return count_active(green).where("n_active = 0").select("image_id")


def _counts(pixels: Planes, overlay: Planes, config: ClipConfig) -> dict[str, int]:
    made = _stages(pixels, overlay, config)
    numbers = {"n_green": made["green"], "n_roads": made["roads"], "n_region": made["active"], "n_opaque": made["core"], "n_ring": made["active"] & ~made["core"]}
    return {name: plane.sum() for name, plane in numbers.items()}


def counts(pixels: DataFrame, overlay: DataFrame, config: ClipConfig | None = None) -> DataFrame:
    """Active cells of each stage of :func:`clip`, and opaque and half-transparent pixels of the result, for each image."""
    schema = "image_id long, n_green long, n_roads long, n_region long, n_opaque long, n_ring long"
    return summed(pixels, overlay, partial(_counts, config=config or ClipConfig()), (["r", "g", "b"], ["a", "r", "g", "b"]), schema)


def _clipped(batches: Iterator[pa.RecordBatch], config: ClipConfig) -> Iterator[pa.RecordBatch]:
    for row in rows_of(batches):
        size, other = (row["width"], row["height"]), (row["over_width"], row["over_height"])
        if size != other:
            raise ValueError(f"sizes differ: {size[0]}x{size[1]} and {other[0]}x{other[1]} (image {row['image_id']})")
        made = _stages(decoded(size[0], row["n_channels"], row["data"]), decoded(size[0], row["over_channels"], row["over_data"]), config)
        region = png(np.stack([made[c] for c in "rgba"], -1))
        mask = png(np.repeat(np.where(made["active"], 255, 0)[..., None], 3, -1))
        sides = [int(n.sum()) for n in outline(made["active"], made["roads"])]
        values = (row["image_id"], *size, *(int(made[c].sum()) for c in ("green", "roads", "active")), sides[2], sum(sides), region, mask)
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _MADE, strict=True)], schema=_MADE)


def clip_images(maps: DataFrame, overlays: DataFrame, config: ClipConfig | None = None) -> DataFrame:
    """image_id, width, height, n_green, n_roads, n_region, n_open of n_sides (of the region's outline, see :func:`~tesselle.operators.region.open_outline`)
    and the PNGs ``region`` and ``mask`` of each of ``maps`` that has one of ``overlays``.

    Both are ``images``; two sizes for one image are an error. No row of a pixel is made.
    """
    over = overlays.select("image_id", *(F.col(c).alias(f"over_{n}") for c, n in (("width", "width"), ("height", "height"), ("n_channels", "channels"), ("data", "data"))))
    # whole images are never sent to all machines, however few they are thought to be
    rows = dealt(maps.select("image_id", "width", "height", "n_channels", "data"), "image_id").join(dealt(over, "image_id").hint("merge"), "image_id")
    return rows.mapInArrow(partial(_clipped, config=config or ClipConfig()), MADE)
