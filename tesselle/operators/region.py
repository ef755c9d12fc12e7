"""Regions: seeds, zones, 4-connected components and growth under a barrier.

The growth needs no iteration over pixels: with D the allowed cells that are no barrier, the result is those 4-connected components of D
that hold a seed. An image's components are found in one task from runs of cells (:func:`~tesselle.operators.planes.labels`), or with
``wide=True`` tile by tile, the tiles' labels being linked where they meet.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ClipConfig
from ..schema import KEY
from . import tiled
from .morphology import dilate, on_bits
from .packed import PLACE, pack, unpack
from .planes import Planes, dilated, grown, labels, largest, outline, seeded, seeded_each, summed, together


def _components(planes: Planes) -> Planes:
    return {"bits": planes["bits"], "component": np.ma.masked_less(labels(planes["bits"]), 0)}


def components(mask: DataFrame, wide: bool = False) -> DataFrame:
    """``mask`` with ``component``: the smallest y * width + x of the cell's 4-connected component, null where inactive."""
    if wide:
        return tiled.component_cells(tiled.masks(mask))
    made = tiled.on_windows(pack(mask), _components, ["bits"], {"bits": "boolean", "component": "int"}, 0)
    return unpack(made, {"bits": "active", "component": "component"}).withColumn("component", F.col("component").cast("long"))


def largest_component(mask: DataFrame, wide: bool = False) -> DataFrame:
    """Each image's largest component alone; of equal ones, the one with the smallest place."""
    return unpack(tiled.largest(tiled.masks(mask))) if wide else on_bits(mask.select(*KEY, "active"), largest, 0)


def adaptive_seed(mask: DataFrame, radius: int, border: str = "inactive", wide: bool = False, each: bool = False) -> DataFrame:
    """The mask eroded by the largest of ``radius`` and its halves that leaves a cell of the image; where none does, the mask itself.

    With ``each`` the radius is found for each component by itself.
    """
    if wide:
        return unpack(tiled.seeds(tiled.masks(mask), radius, border=border, each=each), {"seed": "active"})
    return on_bits(mask.select(*KEY, "active"), partial(seeded_each if each else seeded, radius=radius, border=border), 0)


def allowed_zone(mask: DataFrame, distance: int, wide: bool = False) -> DataFrame:
    """How far the selection may grow: a square around each of its cells."""
    return dilate(mask, distance, wide=wide)


def snapped(rough: np.ndarray, barrier: np.ndarray, config: ClipConfig) -> np.ndarray:
    """The region that grows from the seed of a rough selection, on the planes of one image."""
    seed = (seeded_each if config.seed_policy == "stroke" else seeded)(rough, config.seed_erosion_radius, config.border)
    return grown(seed, dilated(rough, config.snap_distance), barrier, config.seed_policy, rough)


def _snapped(rough: Planes, barrier: Planes, config: ClipConfig) -> Planes:
    return {"active": snapped(rough["active"], barrier["active"], config)}


def snap(rough: DataFrame, barrier: DataFrame, config: ClipConfig | None = None, wide: bool = False) -> DataFrame:
    """The rough selection grown from its core to the barrier, no farther than the snap distance; a cell the barrier does not have is free.

    With ``wide``, rough selection and barrier of an image must have one size.
    """
    config = config or ClipConfig()
    if wide:
        return unpack(tiled.snap(tiled.masks(rough), tiled.masks(barrier), config))
    return together(rough, barrier, partial(_snapped, config=config), (["active"], ["active"]), {"active": "boolean"}, [*KEY, "active"])


def _sides(planes: Planes) -> Planes:
    return dict(zip(("at_barrier", "at_edge", "open"), outline(planes["bits"], planes["wall"]), strict=True))


def _side_counts(region: Planes, barrier: Planes) -> dict[str, int]:
    found = outline(region["active"], barrier["active"])
    return {n: plane.sum() for n, plane in zip(("at_barrier", "at_edge", "open"), found, strict=True)}


def open_share(at_barrier: Column, at_edge: Column, open_: Column) -> Column:
    """The part of an outline that ends at neither; 0 without an outline."""
    total = at_barrier + at_edge + open_
    return F.when(total > 0, open_ / total).otherwise(F.lit(0.0))


def open_outline(region: DataFrame, barrier: DataFrame, wide: bool = False) -> DataFrame:
    """image_id, at_barrier, at_edge, open and share: how many sides of a region's cells end at a barrier, at the image's edge, and at neither, where the
    growth only stopped at the snap distance because the barrier is broken or absent; and the part that these are of all."""
    if wide:
        walls = tiled.masks(barrier).select(*PLACE, F.col("bits").alias("wall"))
        both = tiled.by_tile(tiled.masks(region), walls, "left")
        sides = tiled.on_windows(both, _sides, ["bits", "wall"], dict.fromkeys(("at_barrier", "at_edge", "open"), "int"), 1)
        summed_up = lambda c: F.sum(F.aggregate(c, F.lit(0).cast("long"), lambda s, n: s + n)).alias(c)
        counts = sides.groupBy("image_id").agg(*map(summed_up, ("at_barrier", "at_edge", "open")))
    else:
        counts = summed(region, barrier, _side_counts, (["active"], ["active"]), "image_id long, at_barrier long, at_edge long, open long")
    return counts.withColumn("share", open_share(F.col("at_barrier"), F.col("at_edge"), F.col("open")))
