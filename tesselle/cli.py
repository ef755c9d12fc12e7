"""Clips one map with one overlay: ``python -m tesselle.cli --map M --mask O --output P``."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ClipConfig
from .plans.clip import clip_images
from .sources.images import check_same_size, save_pair, scan

#: The share of an outline that may meet no road before a warning.
OPEN_SHARE = 0.05

HELP = """usage: tesselle --map MAP --mask OVERLAY [options]

Clips a region out of a map, its rough outline snapped to roads. Names of options may be in any case.

  --map FILE               the map image
  --mask FILE              the overlay, whose green pixels are the rough selection
  --output FILE            the clipped region (clipped_output.png)
  --mask-out FILE          the final mask (mask_output.png)
  --snap-distance N        how far the outline may move (40)
  --road-sensitivity X     over 1 finds weaker edges (1.0)
  --smooth N               width of the half-transparent edge (1)
  --help, -h               this text
"""


def option(args: list[str], name: str, default: str | None = None) -> str | None:
    """What follows an option, whatever it is; the default where the option is missing or last."""
    return next((args[i + 1] for i in range(len(args) - 1) if args[i].lower() == name), default)


def number(args: list[str], name: str, default: float, read: Callable[[str], float]) -> float:
    """A number that follows an option; a warning and the default where it is none."""
    given = option(args, name)
    try:
        return default if given is None else read(given)
    except ValueError:
        print(f"warning: {name} {given} is no number, {default} is taken", file=sys.stderr)
        return default


def option_of(args: Column, name: str) -> Column:
    """:func:`option` for rows of arguments: what follows the first place of an option, null where it is missing or last."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(args) - 1, F.lit(1))), lambda i: (i < F.size(args)) & (F.lower(F.element_at(args, i)) == name))
    return F.when(F.size(places) > 0, F.try_element_at(args, F.try_element_at(places, F.lit(1)) + 1))


def number_of(args: Column, name: str, default: float, kind: str) -> Column:
    """:func:`number` for rows of arguments, of a type of Spark's."""
    return F.coalesce(option_of(args, name).try_cast(kind), F.lit(default).cast(kind))


def _one(images: DataFrame) -> DataFrame:
    return images.withColumn("image_id", F.lit(0).cast("long"))


def _place(path: str) -> tuple[str, str]:
    """Folder and name of a path or URI."""
    folder, _, name = (path if "://" in path else str(Path(path).absolute())).rpartition("/")
    return folder, name


def run(args: list[str], spark: SparkSession | None = None) -> int:
    """Exit code: 0, or 1 after a message on the error stream."""
    if not args or any(a.lower() in ("--help", "-h") for a in args):
        print(HELP)
        return 0 if args else 1
    shown_at, over_at = option(args, "--map"), option(args, "--mask")
    if not shown_at or not over_at:
        print(f"error: --map and --mask are needed\n{HELP}", file=sys.stderr)
        return 1
    output = option(args, "--output", "clipped_output.png")
    mask_out = option(args, "--mask-out", "mask_output.png")
    try:
        default = ClipConfig()
        config = ClipConfig(number(args, "--snap-distance", default.snap_distance, int), number(args, "--road-sensitivity", default.road_sensitivity, float), number(args, "--smooth", default.smooth_radius, int))
        spark = spark or SparkSession.builder.appName("tesselle").getOrCreate()
        for path in (shown_at, over_at):
            if "://" not in path and not Path(path).is_file():
                raise FileNotFoundError(f"no such file: {path}")
        shown, over = _one(scan(spark, shown_at)), _one(scan(spark, over_at))
        check_same_size(shown, over)
        made = clip_images(shown, over, config).persist()  # one image, asked for its numbers and for two files
        try:
            numbers = made.select("n_green", "n_roads", "n_region", "n_open", "n_sides").first()
            if numbers.n_green == 0:
                print("warning: the overlay has no green pixel, nothing is written", file=sys.stderr)
                return 1
            if numbers.n_roads == 0:
                print("warning: no road was found; the region ends at the snap distance", file=sys.stderr)
            elif numbers.n_open > OPEN_SHARE * numbers.n_sides:
                print(f"warning: {numbers.n_open * 100 // numbers.n_sides} % of the outline meets no road; the network is broken there and the region ends at the snap distance", file=sys.stderr)
            places = [(column, *_place(path)) for column, path in (("region", output), ("mask", mask_out))]
            save_pair(made, places)
        finally:
            made.unpersist()
        print(f"green {numbers.n_green}, roads {numbers.n_roads}, region {numbers.n_region} pixels")
    except (OSError, ValueError, PySparkException) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
