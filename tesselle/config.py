"""Settings of a clip."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED_POLICIES = ("stroke", "largest", "all")
BORDERS = ("inactive", "ignore")


@dataclass(frozen=True)
class ClipConfig:
    """How far a rough selection may move, what counts as a road, and how the edge is made.

    ``seed_policy`` says which parts of the eroded selection grow: of each ``stroke`` (each component of the selection) the largest, which is also
    eroded by itself; the ``largest`` of all alone; or ``all``.
    ``border`` says whether erosion takes what lies outside the image as ``inactive`` or leaves it out of account (``ignore``).
    """

    # The defaults.
    snap_distance: int = 40
    road_sensitivity: float = 1.0
    smooth_radius: int = 1
    seed_erosion_radius: int = 8
    closing_radius: int = 2
    seed_policy: str = "stroke"
    border: str = "inactive"

    def __post_init__(self) -> None:
        if self.snap_distance <= 0:
            raise ValueError(f"snap_distance must be over 0, not {self.snap_distance}")
        if not self.road_sensitivity > 0:
            raise ValueError(f"road_sensitivity must be over 0, not {self.road_sensitivity}")
        for name in ("smooth_radius", "seed_erosion_radius", "closing_radius"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must be at least 0, not {getattr(self, name)}")
        if self.seed_policy not in SEED_POLICIES:
            raise ValueError(f"seed_policy must be one of {SEED_POLICIES}")
        if self.border not in BORDERS:
            raise ValueError(f"border must be one of {BORDERS}")


def with_defaults(settings: DataFrame) -> DataFrame:
    """Rows of settings, a column each, with the default where a value is null or its column is missing; other columns are kept."""
    made = {f.name: F.coalesce(F.col(f.name), F.lit(f.default)) if f.name in settings.columns else F.lit(f.default) for f in fields(ClipConfig)}
    return settings.withColumns(made)


def error() -> Column:
    """What is wrong with a row of settings, as :class:`ClipConfig` says it; null where nothing is."""
    first = F.when(F.col("snap_distance") <= 0, F.concat(F.lit("snap_distance must be over 0, not "), F.col("snap_distance").cast("string")))
    first = first.when(~(F.col("road_sensitivity") > 0) | F.isnan("road_sensitivity"), F.concat(F.lit("road_sensitivity must be over 0, not "), F.col("road_sensitivity").cast("string")))
    for name in ("smooth_radius", "seed_erosion_radius", "closing_radius"):
        first = first.when(F.col(name) < 0, F.concat(F.lit(f"{name} must be at least 0, not "), F.col(name).cast("string")))
    first = first.when(~F.col("seed_policy").isin(*SEED_POLICIES), f"seed_policy must be one of {SEED_POLICIES}")
    return first.when(~F.col("border").isin(*BORDERS), f"border must be one of {BORDERS}")
