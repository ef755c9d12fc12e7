"""A query for every operator, and the SQL that gives the same rows."""

from __future__ import annotations

import contextlib
import io
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli, streaming
from ..config import ClipConfig, error, with_defaults
from ..functions import color
from ..operators import contrast, gradient, grid, morphology, packed, planes, region, render, tiled
from ..schema import KEY, shared_folder
from ..sources import images, tiles
from . import clip

CONFIG = ClipConfig()
LITERAL, LARGEST = ClipConfig(seed_policy="all"), ClipConfig(seed_policy="largest")
SPLIT = ClipConfig(snap_distance=12, seed_erosion_radius=4, seed_policy="largest")
SPLIT_ALL = ClipConfig(snap_distance=12, seed_erosion_radius=4, seed_policy="all")
STROKES = ClipConfig(snap_distance=6, seed_erosion_radius=4)
STROKES_LARGEST = ClipConfig(snap_distance=6, seed_erosion_radius=4, seed_policy="largest")
Query = Callable[[SparkSession, str], DataFrame]


def _per_pixel(source: Callable[[SparkSession, str], DataFrame], **columns) -> Query:
    return lambda spark, sf: source(spark, sf).select(*KEY, *(make().alias(name) for name, make in columns.items()))


def _mask(operator: Callable[[DataFrame], DataFrame], source=tiles.patches) -> Query:
    return lambda spark, sf: operator(source(spark, sf)).select(*KEY, "active")


def _pair(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: operator(tiles.scattered(spark, sf), tiles.striped(spark, sf))


def _rough(spark: SparkSession, sf: str) -> DataFrame:
    return clip.extract_green(tiles.overlays(spark, sf))


def _roads(spark: SparkSession, sf: str) -> DataFrame:
    return clip.detect_roads(tiles.maps(spark, sf), CONFIG)


def _snap(config: ClipConfig) -> Query:
    return lambda spark, sf: region.snap(_rough(spark, sf), _roads(spark, sf), config)


def _snap_split(config: ClipConfig, wide: bool = False) -> Query:
    return lambda spark, sf: region.snap(tiles.split_rough(spark, sf), tiles.split_barrier(spark, sf), config, wide)


def _snap_strokes(config: ClipConfig, wide: bool = False) -> Query:
    return lambda spark, sf: region.snap(tiles.two_strokes(spark, sf), tiles.strokes_barrier(spark, sf), config, wide)


def _outline(wide: bool = False) -> Query:
    def made(spark: SparkSession, sf: str) -> DataFrame:
        barrier = tiles.strokes_barrier(spark, sf)
        return region.open_outline(region.snap(tiles.two_strokes(spark, sf), barrier, STROKES), barrier, wide)

    return made


def _clip_counts(spark: SparkSession, sf: str) -> DataFrame:
    return clip.counts(tiles.maps(spark, sf), tiles.overlays(spark, sf), CONFIG)


def _greeting(spark: SparkSession, sf: str) -> DataFrame:
    """A line for each region, numbered from 1."""
    i = (F.col("r_regionkey") + 1).cast("int")
    return spark.read.parquet(f"{sf}/region.parquet").select(i.alias("i"), F.concat(F.lit("i = "), i.cast("string")).alias("line"))


def _blanks(spark: SparkSession, sf: str) -> DataFrame:
    sized = tiles.images(spark, sf).select("image_id", (F.col("image_id") % 7 + 1).cast("int").alias("width"), (F.col("image_id") % 5 + 1).cast("int").alias("height"))
    return grid.blanks(sized)


def _wrapped(spark: SparkSession, sf: str) -> DataFrame:
    """Masks of arrays of values, one for each supplier."""
    sized = tiles.images(spark, sf).select("image_id", (F.col("image_id") % 7 + 1).cast("int").alias("width"), F.lit(4).alias("height"))
    return grid.wrapped(sized.withColumn("values", F.expr("transform(sequence(0, width * height - 1), i -> (i + image_id) % 3 = 0)")))


def _settings(spark: SparkSession, sf: str) -> DataFrame:
    """Settings of which each supplier has some, good and bad."""
    given = {
        "snap_distance": "nullif(cast(s_suppkey % 7 as int), 6)",
        "road_sensitivity": "nullif(cast(s_suppkey % 5 - 0.5 as double), 3.5D)",
        "smooth_radius": "nullif(cast(s_suppkey % 4 - 1 as int), 2)",
        "seed_policy": "case when s_suppkey % 3 = 0 then 'all' when s_suppkey % 11 = 1 then 'none' end",
    }
    return spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("id"), *(F.expr(e).alias(n) for n, e in given.items()))


def _checked_settings(spark: SparkSession, sf: str) -> DataFrame:
    return with_defaults(_settings(spark, sf)).withColumn("error", error()).withColumn("road_sensitivity", F.col("road_sensitivity").cast("double"))


def _arguments(spark: SparkSession, sf: str) -> DataFrame:
    """Options of the command line in many orders, read from a row for each supplier."""
    pieces = ["'--SNAP-distance'", "concat('', s_suppkey % 9)", "'--Road-Sensitivity'", "if(s_suppkey % 2 = 0, 'x1', concat(s_suppkey % 3, '.5'))", "'--output'", "'--smooth'", "if(s_suppkey % 4 = 0, '--mask', '2')", "if(s_suppkey % 5 = 0, '--OUTPUT', '--mask')"]
    args = F.expr(f"slice(array({', '.join(pieces)}), 1 + cast(s_suppkey % 3 as int), 8)")
    rows = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("id"), args.alias("args"))
    read = {"snap_distance": cli.number_of(F.col("args"), "--snap-distance", 40, "int"), "road_sensitivity": cli.number_of(F.col("args"), "--road-sensitivity", 1.0, "double"), "smooth": cli.number_of(F.col("args"), "--smooth", 1, "int")}
    return rows.select("id", *(c.alias(n) for n, c in read.items()), cli.option_of(F.col("args"), "--output").alias("output"), cli.option_of(F.col("args"), "--mask").alias("mask"))


def _packed_points(spark: SparkSession, sf: str) -> DataFrame:
    at = tiles.images(spark, sf).select("image_id", F.explode(F.array(*[F.lit(v) for v in (-3, 0, 17, 100, 149, 170)])).alias("x"), F.lit(65).alias("y"))
    return packed.get(tiled.written(packed.pack(tiles.large(spark, sf), 64)), at)


def _packed_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of (scattered or striped) and not patches, and of its complement with one cell set, counted without any row of a cell in between."""
    a, b, c = (packed.pack(source(spark, sf)) for source in (tiles.scattered, tiles.striped, tiles.patches))
    made = packed.difference(packed.union(a, b), c)
    other = packed.set_cell(packed.complement(made), 3, 5, True, 1)
    return packed.count_active(made).join(packed.count_active(other).withColumnRenamed("n_active", "n_rest"), "image_id")


def _grey_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Files of one channel, written and read again."""
    folder = f"{shared_folder(spark)}/tesselle-grey-{uuid.uuid4().hex}"
    images.save(images.encode(tiles.colours(spark, sf), channels="r"), folder)
    found = images.scan(spark, folder).withColumn("image_id", F.regexp_extract("origin", "([0-9]+)[.]png$", 1).cast("long"))
    return images.pixels(found)


def _points(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of a mask at points of which some lie outside."""
    at = tiles.images(spark, sf).select("image_id", F.explode(F.array(*[F.lit(v) for v in (-3, 0, 17, 40, 70)])).alias("x"), F.lit(9).alias("y"))
    return grid.get(tiles.scattered(spark, sf), at).select(*KEY, "active")


def _size_check(spark: SparkSession, sf: str) -> DataFrame:
    return grid.compared(tiles.images(spark, sf), tiles.images(spark, sf, tiles.SPLIT_SIDE))


def _mask_size_check(spark: SparkSession, sf: str) -> DataFrame:
    return grid.compared(grid.sizes(tiles.patches(spark, sf)), grid.sizes(tiles.scattered(spark, sf)))


def _bounds(spark: SparkSession, sf: str) -> DataFrame:
    at = tiles.images(spark, sf).select("image_id", "width", "height", F.explode(F.array(*[F.lit(v) for v in (-1, 0, 63, 64)])).alias("x"))
    at = at.select("*", F.explode(F.array(*[F.lit(v) for v in (-5, 0, 31, 63, 64)])).alias("y"))
    return at.select(*KEY, grid.inside(F.col("x"), F.col("y"), F.col("width"), F.col("height")).alias("inside"))


def _fitted(spark: SparkSession, sf: str) -> DataFrame:
    sized = tiles.images(spark, sf).select("image_id", (64 + F.col("image_id") % 70).cast("int").alias("width"), F.lit(48).alias("height"))
    scale, left, top = render.fit(F.col("width"), F.col("height"), 220, 140)
    return sized.select("image_id", "width", "height", scale.alias("scale"), left.alias("left"), top.alias("top"))


def _hsv(spark: SparkSession, sf: str) -> DataFrame:
    hue, saturation, value = color.hsv()
    return tiles.colours(spark, sf).select(*KEY, hue.alias("hue"), saturation.alias("saturation"), value.alias("value"))


def _thin(spark: SparkSession, sf: str) -> DataFrame:
    """A mask of lines that no erosion leaves anything of."""
    return grid.cells(tiles.images(spark, sf)).withColumn("active", F.expr("(x + image_id) % 5 < 2"))


def _files(spark: SparkSession, pixels: DataFrame, alpha: bool = True) -> tuple[DataFrame, str]:
    """PNG files of pixels in a folder of their own: what was written, and where."""
    folder = f"{shared_folder(spark)}/tesselle-png-{uuid.uuid4().hex}"
    return images.save(images.encode(pixels, alpha), folder), folder


def _sink(spark: SparkSession, sf: str) -> DataFrame:
    return _files(spark, tiles.colours(spark, sf))[0]


def _scan(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels written as PNG files and read again; a file's name is its image's id."""
    _, folder = _files(spark, tiles.colours(spark, sf))
    found = images.scan(spark, folder).withColumn("image_id", F.regexp_extract("origin", "([0-9]+)[.]png$", 1).cast("long"))
    return images.pixels(found)


def _command(spark: SparkSession, sf: str) -> DataFrame:
    """The command line on the files of the first tile: the pixels of its two outputs."""
    first = spark.read.parquet(f"{sf}/supplier.parquet").agg(F.min("s_suppkey")).first()[0]
    folder = f"{shared_folder(spark)}/tesselle-cli-{uuid.uuid4().hex}"
    for name, pixels in (("map", tiles.maps(spark, sf)), ("overlay", tiles.overlays(spark, sf))):
        images.save(images.encode(pixels.where(F.col("image_id") == first), False), folder, F.lit(f"{name}.png"))
    with contextlib.redirect_stdout(io.StringIO()):
        code = cli.run(["--map", f"{folder}/map.png", "--mask", f"{folder}/overlay.png", "--output", f"{folder}/out.png", "--mask-out", f"{folder}/mask_out.png"], spark)
    read = lambda name: images.pixels(images.scan(spark, f"{folder}/{name}.png").withColumn("image_id", F.lit(first).cast("long")))
    return read("out").join(read("mask_out").select(*KEY, F.col("r").alias("mask")), list(KEY)).withColumn("code", F.lit(code))


def _as_images(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return images.gathered(tiles.maps(spark, sf), False), images.gathered(tiles.overlays(spark, sf), False)


def _clip_images(spark: SparkSession, sf: str) -> DataFrame:
    return clip.clip_images(*_as_images(spark, sf), CONFIG).drop("region", "mask", "n_open", "n_sides")


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """Maps that arrive before their overlays."""
    folder = f"{shared_folder(spark)}/tesselle-stream-{uuid.uuid4().hex}"
    for role, rows in zip(("map", "overlay"), _as_images(spark, sf), strict=True):
        rows.withColumn("role", F.lit(role)).write.mode("append").parquet(f"{folder}/in")
        streaming.clip_stream(spark, f"{folder}/in", f"{folder}/out", f"{folder}/state", CONFIG).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("image_id", "n_active")


def _unpacked(spark: SparkSession, sf: str) -> DataFrame:
    packed = tiles.colours(spark, sf).select(*KEY, color.pack("a", "r", "g", "b").alias("argb"))
    return packed.select(*KEY, "argb", *color.unpack("argb"))


def _inner(spark: SparkSession, sf: str) -> DataFrame:
    return grid.cells(tiles.images(spark, sf)).where(F.col("x").between(1, tiles.SIDE - 2) & F.col("y").between(1, tiles.SIDE - 2))


def _rim(spark: SparkSession, sf: str) -> DataFrame:
    """White pixels next to a cell that is not white."""
    return render.rim(tiles.warm(spark, sf).select(*KEY, (F.least("r", "g", "b") > 230).alias("active")))


def _wide_clip(spark: SparkSession, sf: str) -> DataFrame:
    return clip.clip(tiles.maps(spark, sf), tiles.overlays(spark, sf), CONFIG, wide=True).clipped


def _preview(spark: SparkSession, sf: str) -> DataFrame:
    return render.overlay_preview(tiles.maps(spark, sf), tiles.colours(spark, sf))


def _rendered(operator) -> Query:
    return lambda spark, sf: operator(tiles.colours(spark, sf), tiles.patches(spark, sf))


def _small_tiles(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives with tiles of 64 cells, so that the pictures of these tables are cut too."""
    whole, tiled.SIDE = tiled.SIDE, packed.WORD
    try:
        return make()
    finally:
        tiled.SIDE = whole


def queries() -> dict[str, Query]:
    colours, warm = tiles.colours, tiles.warm
    return {
        "greeting_loop": _greeting,
        "pixel_unpack": _unpacked,
        "size_check": _size_check,
        "luminance": _per_pixel(colours, lum=color.luminance),
        "opaque": _per_pixel(colours, active=color.is_opaque),
        "rgb_green": _per_pixel(colours, active=color.leads_green),
        "hsv_green": _per_pixel(colours, active=color.is_green_hue),
        "green_raw": _per_pixel(colours, active=color.is_green),
        "green_mask": lambda spark, sf: clip.extract_green(colours(spark, sf)),
        "road_orange": _per_pixel(warm, active=color.is_orange),
        "road_yellow": _per_pixel(warm, active=color.is_yellow),
        "road_white": _per_pixel(warm, active=color.is_white),
        "road_class": _per_pixel(warm, road=color.road_class),
        "road_white_contrast": lambda spark, sf: contrast.white_with_contrast(warm(spark, sf), 2, 20),
        "road_white_rim": _rim,
        "local_range": lambda spark, sf: contrast.local_range(colours(spark, sf), 3),
        "road_raw": lambda spark, sf: clip.raw_roads(tiles.maps(spark, sf), CONFIG),
        "sobel_gx_gy": lambda spark, sf: gradient.sobel(colours(spark, sf)).select(*KEY, "gx", "gy"),
        "sobel_mask": lambda spark, sf: gradient.edges(colours(spark, sf), 0.5),
        "road_barrier": _roads,
        "hsv": _hsv,
        "fit_scale": _fitted,
        "bounds_check": _bounds,
        "interior_cells": _inner,
        "mask_size_check": _mask_size_check,
        "mask_blank": _blanks,
        "mask_wrap": _wrapped,
        "mask_copy": lambda spark, sf: grid.copy(tiles.scattered(spark, sf)),
        "image_scan": _scan,
        "png_sink": _sink,
        "image_scan_grey": _grey_scan,
        "config_defaults": lambda spark, sf: _checked_settings(spark, sf).drop("error"),
        "config_checked": lambda spark, sf: _checked_settings(spark, sf).select("id", "error"),
        "cli_clip": _command,
        "cli_options": _arguments,
        "clip_pipeline": lambda spark, sf: clip.clip(tiles.maps(spark, sf), tiles.overlays(spark, sf), CONFIG).clipped,
        "clip_pipeline_mask": lambda spark, sf: clip.clip(tiles.maps(spark, sf), tiles.overlays(spark, sf), CONFIG).mask,
        "clip_images": _clip_images,
        "clip_stream": _stream,
        "seed_fallback": lambda spark, sf: region.adaptive_seed(_thin(spark, sf), 8),
        "snap_strokes": _snap_strokes(STROKES),
        "snap_strokes_largest": _snap_strokes(STROKES_LARGEST),
        "open_outline": _outline(),
        "mask_packed_chain": _packed_chain,
        "mask_packed_get": _packed_points,
        # Forms for images too large for one task.
        "open_outline_wide": _outline(True),
        "snap_strokes_wide": _snap_strokes(STROKES, True),
        "clip_pipeline_wide": _wide_clip,
        "components_wide": lambda spark, sf: _small_tiles(lambda: region.components(tiles.large(spark, sf), wide=True)),
        "largest_component_wide": lambda spark, sf: _small_tiles(lambda: region.largest_component(tiles.large(spark, sf), wide=True)),
        "close_r2_wide": lambda spark, sf: _small_tiles(lambda: morphology.close(tiles.large(spark, sf), 2, wide=True)),
        "local_range_wide": lambda spark, sf: contrast.local_range(colours(spark, sf), 3, wide=True),
        "road_barrier_wide": lambda spark, sf: clip.detect_roads(tiles.maps(spark, sf), CONFIG, wide=True),
        "sobel_gx_gy_wide": lambda spark, sf: gradient.sobel(colours(spark, sf), wide=True).select(*KEY, "gx", "gy"),
        "mask_or_wide": lambda spark, sf: grid.union(tiles.scattered(spark, sf), tiles.striped(spark, sf), wide=True),
        "dilate_r40_wide": _mask(lambda m: morphology.dilate(m, 40, wide=True), tiles.split_rough),
        "erode_r1_wide": _mask(lambda m: morphology.erode(m, 1, wide=True)),
        "seed_adaptive_wide": _mask(lambda m: region.adaptive_seed(m, 8, wide=True)),
        "snap_wide": _snap_split(SPLIT, wide=True),
        "clip_smooth_wide": lambda spark, sf: render.clip_smooth(tiles.colours(spark, sf), tiles.patches(spark, sf), wide=True),
        "mask_get": _points,
        "mask_set": lambda spark, sf: grid.set_cell(tiles.scattered(spark, sf), 3, 5, True, 1),
        "mask_or": _pair(grid.union),
        "mask_and": _pair(grid.intersection),
        "mask_and_not": _pair(grid.difference),
        "mask_not": _mask(grid.complement, tiles.scattered),
        "mask_count": lambda spark, sf: grid.count_active(tiles.scattered(spark, sf)),
        "dilate_r1": _mask(lambda m: morphology.dilate(m, 1), tiles.scattered),
        "dilate_r40": _mask(lambda m: morphology.dilate(m, 40), tiles.split_rough),
        "erode_r1": _mask(lambda m: morphology.erode(m, 1)),
        "erode_r1_ignore_border": _mask(lambda m: morphology.erode(m, 1, border="ignore")),
        "erode_r6": _mask(lambda m: morphology.erode(m, 6), tiles.split_rough),
        "close_r2": _mask(lambda m: morphology.close(m, 2)),
        "open_r1": _mask(lambda m: morphology.open_(m, 1)),
        "seed_adaptive": _mask(lambda m: region.adaptive_seed(m, 8)),
        "allowed_zone": lambda spark, sf: region.allowed_zone(tiles.split_rough(spark, sf), 9),
        "connected_components": lambda spark, sf: region.components(tiles.patches(spark, sf)),
        "largest_component": _mask(region.largest_component),
        "snap_all": _snap(LITERAL),
        "snap_largest": _snap(LARGEST),
        "snap_all_split": _snap_split(SPLIT_ALL),
        "snap_largest_split": _snap_split(SPLIT),
        "clip_hard": _rendered(render.clip_hard),
        "clip_smooth": _rendered(render.clip_smooth),
        "clip_progressive": _rendered(render.clip_progressive),
        "clip_progressive_r10": lambda spark, sf: render.clip_progressive(colours(spark, sf), tiles.two_strokes(spark, sf), 10),
        "mask_image": lambda spark, sf: render.mask_image(tiles.patches(spark, sf)),
        "overlay_preview": _preview,
        "checkerboard": lambda spark, sf: render.checkerboard(grid.cells(tiles.images(spark, sf))),
        "clip_pipeline_counts": _clip_counts,
    }


# The SQL side.

_SHAPE = "supplier s, range({n}) u(x), range({n}) v(y)"


def _from(expr: str, side: int = tiles.SIDE) -> str:
    return f"(select s_suppkey::bigint as image_id, x::int as x, y::int as y, {expr} from {_SHAPE.format(n=side)})"


_ID = "s_suppkey"
_SCATTERED = _from(f"((x * 7 + y * 13 + {_ID} * 5) % 11 < 4) as active")
_STRIPED = _from(f"((x * 5 + y * 3 + {_ID}) % 7 < 3) as active")
_PATCHES = _from(f"((x // 9 + y // 7 + {_ID}) % 3 <> 0) as active")
_SPLIT_ROUGH = _from("(x between 6 and 30 and y between 10 and 24) as active", tiles.SPLIT_SIDE)
_SPLIT_BARRIER = _from(f"(x = 20 + {_ID} % 3) as active", tiles.SPLIT_SIDE)
_STROKES = _from(f"(x between 8 and 34 and (y between 6 and 22 or y between 40 and 48 + {_ID} % 9)) as active")
_STROKES_BARRIER = _from(f"(x = 20 + {_ID} % 3 and (y < 44 or {_ID} % 4 <> 0)) as active")
_LARGE = _from(f"((x + y // 3 + {_ID}) % 17 < 9 and (y % 31 < 27 or x % 50 < 6)) as active", tiles.WIDE_SIDE)
_COLOURS = _from(f"((x * 13 + y * 17 + {_ID}) % 256)::int as a, ((x * 37 + {_ID} * 11) % 256)::int as r, ((y * 53 + {_ID} * 29) % 256)::int as g, ((x * y * 7 + {_ID} * 3) % 256)::int as b")
_WARM = _from(f"255 as a, (200 + (x * 7 + {_ID}) % 56)::int as r, (120 + (y * 5 + {_ID} * 3) % 136)::int as g, (40 + (x * 3 + y * 11) % 216)::int as b")


def _sql_colour(*choices) -> str:
    out = ["255 as a"]
    for i, c in enumerate("rgb"):
        whens = " ".join(f"when {condition} then {colour[i]}" for condition, colour in choices[:-1])
        out.append(f"(case {whens} else {choices[-1][i]} end)::int as {c}")
    return ", ".join(out)


_MAPS = _from(_sql_colour((f"x between 12 + {_ID} % 5 and 15 + {_ID} % 5 or x between 50 and 53", tiles.ORANGE), ("y between 12 and 15 or y between 50 and 53", tiles.YELLOW), tiles.GROUND))
_OVERLAYS = _from(_sql_colour(("x between 22 + s_nationkey % 6 and 44 and y between 22 and 46", tiles.GREEN), (0, 0, 0)))

_N = "(case when r = greatest(r,g,b) then g - b when g = greatest(r,g,b) then 2 * (greatest(r,g,b) - least(r,g,b)) + b - r else 4 * (greatest(r,g,b) - least(r,g,b)) + r - g end)"
_D = "(greatest(r,g,b) - least(r,g,b))"
_HUE = f"(case when {_N} < 0 then {_N} + 6 * {_D} else {_N} end)"
_LEADS = "(g > r + 25 and g > b + 25)"
_GREEN_HUE = f"({_D} > 0 and 60 * {_HUE} >= 70 * {_D} and 60 * {_HUE} <= 170 * {_D} and 5 * {_D} > greatest(r,g,b) and greatest(r,g,b) > 51)"
_GREEN = f"(a >= 30 and ({_LEADS} or {_GREEN_HUE}))"
_ORANGE = "(r >= 210 and g between 130 and 220 and b between 50 and 165 and r - g >= 15)"
_YELLOW = "(r >= 220 and g >= 200 and b between 100 and 210 and abs(r - g) <= 35 and r - b >= 30)"
_WHITE = "(least(r,g,b) >= 240)"
_LUM = "trunc((0.299::double * r + 0.587::double * g) + 0.114::double * b)::int"


def _select(source: str, columns: str) -> str:
    return f"select image_id, x, y, {columns} from {source}"


def _active(source: str, condition: str) -> str:
    return f"({_select(source, f'{condition} as active')})"


def _axis(source: str, line: str, along: str, radius: int, decide: str) -> str:
    over = f"over (partition by image_id, {line} order by {along} range between {radius} preceding and {radius} following)"
    return f"(select image_id, x, y, {decide.format(over=over)} as active from {source})"


def _sql_dilate(source: str, radius: int) -> str:
    for line, along in (("y", "x"), ("x", "y")):
        source = _axis(source, line, along, radius, "bool_or(active) {over}")
    return source


def _sql_erode(source: str, radius: int, ignore: bool = False) -> str:
    decide = "bool_and(active) {over}" + ("" if ignore else f" and count(*) {{over}} = {2 * radius + 1}")
    for line, along in (("y", "x"), ("x", "y")):
        source = _axis(source, line, along, radius, decide)
    return source


def _sql_sobel(source: str) -> str:
    lum = f"(select *, {_LUM} as lum from {source})"
    row, column = "(partition by image_id, y order by x)", "(partition by image_id, x order by y)"
    first = f"(select *, lead(lum) over {row} - lag(lum) over {row} as d, lag(lum) over {row} + 2 * lum + lead(lum) over {row} as s from {lum})"
    return f"(select *, (lag(d) over {column} + 2 * d + lead(d) over {column})::int as gx, (lead(s) over {column} - lag(s) over {column})::int as gy from {first})"


def _sql_edges(t: int) -> str:
    return f"coalesce(gx * gx + gy * gy >= {t * t}, false)"


_RAW_ROADS = _active(_sql_sobel(_MAPS), f"({_ORANGE} or {_YELLOW} or {_WHITE} or {_sql_edges(75)})")
_BARRIER = _sql_erode(_sql_dilate(_RAW_ROADS, 2), 2)
_ROUGH = _sql_dilate(_sql_erode(_active(_OVERLAYS, _GREEN), 1), 1)


def _sql_seed(source: str, first: int) -> str:
    """A with clause that ends in ``seed``."""
    tried = planes.radii(first)
    parts = [f"s0 as materialized (select * from {source})"] + [f"s{r} as materialized (select * from {_sql_erode('s0', r)})" for r in tried]
    joins = " ".join(f"join s{r} using (image_id, x, y)" for r in tried)
    parts.append(f"tried as materialized (select s0.image_id, s0.x, s0.y, s0.active as a0, {', '.join(f's{r}.active as a{r}' for r in tried)} from s0 {joins})")
    parts.append(f"chosen as (select image_id, {', '.join(f'bool_or(a{r}) as any{r}' for r in tried)} from tried group by image_id)")
    parts.append(f"seed as (select image_id, x, y, case {' '.join(f'when any{r} then a{r}' for r in tried)} else a0 end as active from tried join chosen using (image_id))")
    return ", ".join(parts)


_STEPS = "(values (1, 0), (-1, 0), (0, 1), (0, -1)) step(dx, dy)"


def _sql_snap(rough: str, barrier: str, config: ClipConfig, side: int) -> str:
    """Growth by reachability, each cell once; components of the seed, and of the selection, by way of runs."""
    zone = f"free as materialized (select z.image_id, z.x, z.y from {_sql_dilate('rough', config.snap_distance)} z join wall using (image_id, x, y) where z.active and not wall.active)"
    start = "start as materialized (select seed.image_id, seed.x, seed.y from seed join wall using (image_id, x, y) where seed.active and not wall.active)"
    head = f"with recursive rough as materialized (select * from {rough}), wall as materialized (select * from {barrier})"
    on = "(select r.image_id, r.x, r.y, s.x is not null as active from rough r left join start s using (image_id, x, y))"
    first = "start"
    if config.seed_policy == "stroke":
        tried = planes.radii(config.seed_erosion_radius)
        seed = f"{_sql_components('rough', side, 'r')}, {', '.join(f's{r} as materialized (select * from {_sql_erode('rough', r)})' for r in tried)}"
        joins = " ".join(f"join s{r} using (image_id, x, y)" for r in tried)
        seed += f", tried as materialized (select n.image_id, n.x, n.y, n.component, {', '.join(f's{r}.active as a{r}' for r in tried)} from rnamed n {joins} where n.active)"
        seed += f", chosen as (select image_id, component, {', '.join(f'bool_or(a{r}) as any{r}' for r in tried)} from tried group by all)"
        seed += f", seed as materialized (select image_id, x, y, component as stroke, case {' '.join(f'when any{r} then a{r}' for r in tried)} else true end as active from tried join chosen using (image_id, component))"
        parts = f"{_sql_components(on, side, 'p')}, ranked as (select image_id, stroke, component, row_number() over (partition by image_id, stroke order by count(*) desc, component) as k from pnamed join (select image_id, x, y, stroke from seed) using (image_id, x, y) where active group by image_id, stroke, component)"
    else:
        seed = _sql_seed("rough", config.seed_erosion_radius)
        parts = f"{_sql_components(on, side, 'p')}, ranked as (select image_id, component, row_number() over (partition by image_id order by count(*) desc, component) as k from pnamed where active group by image_id, component)"
    seeds = f"{head}, {seed}, {zone}, {start}"
    if config.seed_policy != "all":
        seeds += f", {parts}, best as (select p.image_id, p.x, p.y from pnamed p join ranked k on k.image_id = p.image_id and k.component = p.component and k.k = 1 where p.active)"
        first = "best"
    seeds += f", reached as (select image_id, x, y from {first} join free using (image_id, x, y) union select f.image_id, f.x, f.y from reached r, {_STEPS}, free f where f.image_id = r.image_id and f.x = r.x + dx and f.y = r.y + dy)"
    return f"{seeds} select rough.image_id, rough.x, rough.y, reached.x is not null as active from rough left join reached using (image_id, x, y)"


def _sql_components(source: str, side: int, p: str = "") -> str:
    """Components by way of runs: few enough that the runs that reach each other can be listed. Cells are in ``named``; names begin with ``p``."""
    return (
        f"{p}m as materialized (select * from {source}), {p}line as (select image_id, y, x, x - row_number() over (partition by image_id, y order by x) as part from {p}m where active), "
        f"{p}run as materialized (select image_id, y, min(x) as x0, max(x) as x1 from {p}line group by image_id, y, part), "
        f"{p}near as materialized (select a.image_id, a.y as ay, a.x0 as ax, b.y as by_, b.x0 as bx from {p}run a join {p}run b on a.image_id = b.image_id and abs(a.y - b.y) = 1 and a.x0 <= b.x1 and b.x0 <= a.x1), "
        f"{p}met as (select image_id, y, x0, y as ry, x0 as rx from {p}run union select n.image_id, n.by_, n.bx, t.ry, t.rx from {p}met t join {p}near n on n.image_id = t.image_id and n.ay = t.y and n.ax = t.x0), "
        f"{p}root as (select image_id, y, x0, min(ry * {side} + rx)::bigint as component from {p}met group by all), "
        f"{p}named as materialized (select m.image_id, m.x, m.y, m.active, t.component from {p}m m left join {p}run r on m.active and r.image_id = m.image_id and r.y = m.y and m.x between r.x0 and r.x1 left join {p}root t on t.image_id = r.image_id and t.y = r.y and t.x0 = r.x0)"
    )


def _sql_outline(snapped: str, barrier: str, side: int) -> str:
    sides = "count(*) filter (wall) as at_barrier, count(*) filter (edge) as at_edge, count(*) filter (not wall and not edge) as open"
    at = f"select r.image_id, coalesce(b.active and not o.active, false) as wall, (r.x + dx not between 0 and {side - 1} or r.y + dy not between 0 and {side - 1}) as edge from region r, {_STEPS} left join region o on o.image_id = r.image_id and o.x = r.x + dx and o.y = r.y + dy left join {barrier} b on b.image_id = r.image_id and b.x = r.x + dx and b.y = r.y + dy where r.active and not coalesce(o.active, false)"
    return f"with region as materialized ({snapped}), counted as (select image_id, {sides} from ({at}) group by image_id) select image_id, coalesce(at_barrier, 0) as at_barrier, coalesce(at_edge, 0) as at_edge, coalesce(open, 0) as open, case when at_barrier + at_edge + open > 0 then open::double / (at_barrier + at_edge + open)::double else 0.0::double end as share from (select distinct image_id from region) left join counted using (image_id)"


def _sql_range(source: str, radius: int) -> str:
    """Cells with the least and the greatest luminance of their square."""
    frame = f"rows between {radius} preceding and {radius} following"
    lum = f"(select *, {_LUM} as lum from {source})"
    lines = f"(select *, min(lum) over (partition by image_id, y order by x {frame}) as lo, max(lum) over (partition by image_id, y order by x {frame}) as hi from {lum})"
    return f"(select image_id, x, y, r, g, b, max(hi) over (partition by image_id, x order by y {frame}) - min(lo) over (partition by image_id, x order by y {frame}) as range from {lines})"


def _sql_argument(name: str) -> str:
    places = f"list_filter(range(1, len(args)), lambda i: lower(args[i]) = '{name}')"
    return f"(case when len({places}) > 0 then args[{places}[1] + 1] end)"


def _sql_clip(alpha: str, source: str) -> str:
    shown = ", ".join(f"(case when {alpha} > 0 then c.{k} else 0 end)::int as {k}" for k in "rgb")
    return f"select c.image_id, c.x, c.y, ({alpha})::int as a, {shown} from {_COLOURS} c join {source} m using (image_id, x, y)"


def oracle_sql() -> dict[str, str]:
    plain = lambda source: _select(source, "active")
    pair = lambda op: f"select image_id, x, y, (p.active {op} q.active) as active from {_SCATTERED} p join {_STRIPED} q using (image_id, x, y)"
    core = f"(select p.*, c.active as core from {_PATCHES} p join {_sql_erode(_PATCHES, 1)} c using (image_id, x, y))"
    deep = f"(select p.*, c.active as one, d.active as two from {_PATCHES} p join {_sql_erode(_PATCHES, 1)} c using (image_id, x, y) join {_sql_erode(_PATCHES, 2)} d using (image_id, x, y))"
    white = _active(_WARM, "(least(r,g,b) > 230)")
    k = "(0.45::double * o.a / 255.0::double)"
    mixed = ", ".join(f"floor(o.{c} * {k} + m.{c} * (1.0::double - {k}) + 0.5::double)::int as {c}" for c in "rgb")
    level = ", ".join(f"(case when (x // 12 + y // 12) % 2 = 0 then 220 else 255 end)::int as {c}" for c in "rgb")
    white_black = ", ".join(f"(case when active then 255 else 0 end)::int as {c}" for c in "rgb")
    parts, large_parts = (f"with recursive {_sql_components(source, side)}" for source, side in ((_PATCHES, tiles.SIDE), (_LARGE, tiles.WIDE_SIDE)))
    ranked = "ranked as (select image_id, component, row_number() over (partition by image_id order by count(*) desc, component) as k from named where active group by image_id, component) select n.image_id, n.x, n.y, (n.active and r.k = 1) as active from named n left join ranked r on r.image_id = n.image_id and r.component = n.component"
    strokes = _sql_snap(_STROKES, _STROKES_BARRIER, STROKES, tiles.SIDE)
    ten = ", ".join(f"e{r} as materialized (select * from {_sql_erode('whole', r)})" for r in range(1, 11))
    depth = " + ".join(["m.active::int", *(f"e{r}.active::int" for r in range(1, 11))])
    ten_rings = f"with whole as materialized (select * from {_STROKES}), {ten}, ring as (select m.image_id, m.x, m.y, ({depth}) * 255 // 11 as alpha from whole m {' '.join(f'join e{r} using (image_id, x, y)' for r in range(1, 11))})"
    settings = "select s_suppkey::bigint as id, coalesce(nullif((s_suppkey % 7)::int, 6), 40) as snap_distance, coalesce(nullif((s_suppkey % 5)::double - 0.5, 3.5), 1.0) as road_sensitivity, coalesce(nullif((s_suppkey % 4 - 1)::int, 2), 1) as smooth_radius, 8 as seed_erosion_radius, 2 as closing_radius, case when s_suppkey % 3 = 0 then 'all' when s_suppkey % 11 = 1 then 'none' else 'stroke' end as seed_policy, 'inactive' as border from supplier"
    args = "select s_suppkey::bigint as id, ['--SNAP-distance', (s_suppkey % 9)::varchar, '--Road-Sensitivity', case when s_suppkey % 2 = 0 then 'x1' else (s_suppkey % 3) || '.5' end, '--output', '--smooth', case when s_suppkey % 4 = 0 then '--mask' else '2' end, case when s_suppkey % 5 = 0 then '--OUTPUT' else '--mask' end][1 + s_suppkey % 3:] as args from supplier"
    chain = f"select image_id, count(*) filter (made) as n_active, count(*) filter (not made or (image_id = 1 and x = 3 and y = 5)) as n_rest from (select p.image_id, p.x, p.y, ((p.active or q.active) and not o.active) as made from {_SCATTERED} p join {_STRIPED} q using (image_id, x, y) join {_PATCHES} o using (image_id, x, y)) group by image_id"
    linear = "(case when r / 255.0::double <= 0.0031308 then 12.92::double * (r / 255.0::double) else 1.055::double * pow(r / 255.0::double, 1.0::double / 2.4::double) - 0.055::double end)"
    grey = ", ".join(f"floor(255.0::double * {linear} + 0.5::double)::int as {c}" for c in "rgb")
    snapped = _sql_snap(_ROUGH, _BARRIER, CONFIG, tiles.SIDE)
    counted = (
        f"with region as materialized ({snapped}), core as (select * from {_sql_erode('region', 1)}), green as (select image_id, count(*) filter (active) as n_green from {_ROUGH} group by all), "
        f"roads as (select image_id, count(*) filter (active) as n_roads from {_BARRIER} group by all), "
        "ends as (select image_id, count(*) filter (region.active) as n_region, count(*) filter (core.active) as n_opaque, count(*) filter (region.active and not core.active) as n_ring from region join core using (image_id, x, y) group by all) "
        "select * from green join roads using (image_id) join ends using (image_id)"
    )
    finished = f"with region as materialized ({snapped}), core as (select * from {_sql_erode('region', 1)}), made as (select m.image_id, m.x, m.y, case when core.active then 255 when region.active then 160 else 0 end as a, m.r, m.g, m.b, region.active from {_MAPS} m join region using (image_id, x, y) join core using (image_id, x, y))"
    shown = ", ".join(f"(case when a > 0 then {c} else 0 end)::int as {c}" for c in "rgb")
    thin = _from(f"((x + {_ID}) % 5 < 2) as active")
    sizes = lambda source, w, h: f"(select image_id, max(x) + 1 as {w}, max(y) + 1 as {h} from {source} group by image_id)"
    return {
        "greeting_loop": "select (r_regionkey + 1)::int as i, 'i = ' || (r_regionkey + 1)::int as line from region",
        "pixel_unpack": _select(_COLOURS, "((case when a > 127 then a - 256 else a end)::bigint * 16777216 + r * 65536 + g * 256 + b)::int as argb, a, r, g, b"),
        "size_check": f"select s_suppkey::bigint as image_id, {tiles.SIDE} as width, {tiles.SIDE} as height, {tiles.SPLIT_SIDE} as other_width, {tiles.SPLIT_SIDE} as other_height, false as same from supplier",
        "luminance": _select(_COLOURS, f"{_LUM} as lum"),
        "opaque": _select(_COLOURS, "a >= 30 as active"),
        "rgb_green": _select(_COLOURS, f"{_LEADS} as active"),
        "hsv_green": _select(_COLOURS, f"{_GREEN_HUE} as active"),
        "green_raw": _select(_COLOURS, f"{_GREEN} as active"),
        "green_mask": plain(_sql_dilate(_sql_erode(_active(_COLOURS, _GREEN), 1), 1)),
        "road_orange": _select(_WARM, f"{_ORANGE} as active"),
        "road_yellow": _select(_WARM, f"{_YELLOW} as active"),
        "road_white": _select(_WARM, f"{_WHITE} as active"),
        "road_class": _select(_WARM, f"case when {_ORANGE} then 'orange' when {_YELLOW} then 'yellow' when {_WHITE} then 'white' end as road"),
        "road_white_contrast": f"select image_id, x, y, (least(r,g,b) > 230 and range >= 20) as active from {_sql_range(_WARM, 2)}",
        "local_range": f"select image_id, x, y, range from {_sql_range(_COLOURS, 3)}",
        "local_range_wide": f"select image_id, x, y, range from {_sql_range(_COLOURS, 3)}",
        "road_white_rim": f"select image_id, x, y, (w.active and not c.active) as active from {white} w join {_sql_erode(white, 1, True)} c using (image_id, x, y)",
        "road_raw": plain(_RAW_ROADS),
        "sobel_gx_gy": _select(_sql_sobel(_COLOURS), "gx, gy"),
        "sobel_mask": _select(_sql_sobel(_COLOURS), f"{_sql_edges(150)} as active"),
        "road_barrier": plain(_BARRIER),
        "hsv": _select(_COLOURS, f"case when {_D} > 0 then (60.0::double * {_HUE}) / {_D}::double end as hue, case when greatest(r,g,b) > 0 then {_D}::double / greatest(r,g,b)::double else 0.0::double end as saturation, greatest(r,g,b)::double / 255.0::double as value"),
        "fit_scale": "select *, trunc((220 - trunc(width * scale)::int) / 2.0)::int as left, trunc((140 - trunc(height * scale)::int) / 2.0)::int as top from (select *, least(200.0::double / width, 100.0::double / height) as scale from (select s_suppkey::bigint as image_id, (64 + s_suppkey % 70)::int as width, 48 as height from supplier))",
        "bounds_check": "select s_suppkey::bigint as image_id, x::int as x, y::int as y, (x between 0 and 63 and y between 0 and 63) as inside from supplier, (values (-1), (0), (63), (64)) t(x), (values (-5), (0), (31), (63), (64)) u(y)",
        "mask_size_check": f"select image_id, width, height, other_width, other_height, (width = other_width and height = other_height) as same from {sizes(_PATCHES, 'width', 'height')} full join {sizes(_SCATTERED, 'other_width', 'other_height')} using (image_id)",
        "mask_blank": "select s_suppkey::bigint as image_id, x::int as x, y::int as y, false as active from supplier, range(7) u(x), range(5) v(y) where x <= s_suppkey % 7 and y <= s_suppkey % 5",
        "mask_wrap": "select s_suppkey::bigint as image_id, x::int as x, y::int as y, ((y * (s_suppkey % 7 + 1) + x + s_suppkey) % 3 = 0) as active from supplier, range(7) u(x), range(4) v(y) where x <= s_suppkey % 7",
        "mask_copy": _select(_SCATTERED, "active"),
        "image_scan": _select(_COLOURS, "a, r, g, b"),
        "png_sink": "select s_suppkey::bigint as image_id, s_suppkey || '.png' as name from supplier",
        "image_scan_grey": f"select image_id, x, y, 255 as a, {grey} from {_COLOURS}",
        "config_defaults": settings,
        "config_checked": f"select id, case when snap_distance <= 0 then 'snap_distance must be over 0, not ' || snap_distance when not road_sensitivity > 0 then 'road_sensitivity must be over 0, not ' || road_sensitivity when smooth_radius < 0 then 'smooth_radius must be at least 0, not ' || smooth_radius when seed_policy not in ('stroke', 'largest', 'all') then 'seed_policy must be one of (''stroke'', ''largest'', ''all'')' end as error from ({settings})",
        "cli_clip": f"{finished} select image_id, x, y, a, {shown}, (case when active then 255 else 0 end)::int as mask, 0 as code from made where image_id = (select min(s_suppkey) from supplier)",
        "cli_options": f"select id, coalesce(try_cast({_sql_argument('--snap-distance')} as int), 40) as snap_distance, coalesce(try_cast({_sql_argument('--road-sensitivity')} as double), 1.0::double) as road_sensitivity, coalesce(try_cast({_sql_argument('--smooth')} as int), 1) as smooth, {_sql_argument('--output')} as output, {_sql_argument('--mask')} as mask from ({args})",
        "snap_strokes": strokes,
        "snap_strokes_wide": strokes,
        "snap_strokes_largest": _sql_snap(_STROKES, _STROKES_BARRIER, STROKES_LARGEST, tiles.SIDE),
        "open_outline": _sql_outline(strokes, _STROKES_BARRIER, tiles.SIDE),
        "open_outline_wide": _sql_outline(strokes, _STROKES_BARRIER, tiles.SIDE),
        "mask_packed_chain": chain,
        "mask_packed_get": f"select p.image_id, p.x, p.y, coalesce(m.active, false) as active from (select s_suppkey::bigint as image_id, x::int as x, 65 as y from supplier, (values (-3), (0), (17), (100), (149), (170)) t(x)) p left join {_LARGE} m using (image_id, x, y)",
        "clip_pipeline_wide": f"{finished} select image_id, x, y, a::int as a, {shown} from made",
        "components_wide": f"{large_parts} select * from named",
        "largest_component_wide": f"{large_parts}, {ranked}",
        "close_r2_wide": plain(_sql_erode(_sql_dilate(_LARGE, 2), 2)),
        "clip_progressive_r10": f"{ten_rings} select c.image_id, c.x, c.y, alpha::int as a, {', '.join(f'(case when alpha > 0 then c.{k} else 0 end)::int as {k}' for k in 'rgb')} from {_COLOURS} c join ring using (image_id, x, y)",
        "clip_pipeline": f"{finished} select image_id, x, y, a::int as a, {shown} from made",
        "clip_pipeline_mask": f"{finished} select image_id, x, y, 255 as a, {white_black} from made",
        "clip_images": f"select image_id, {tiles.SIDE} as width, {tiles.SIDE} as height, n_green, n_roads, n_region from ({counted})",
        "clip_stream": f"select image_id, n_region as n_active from ({counted})",
        "seed_fallback": f"with {_sql_seed(thin, 8)} select * from seed",
        "road_barrier_wide": plain(_BARRIER),
        "sobel_gx_gy_wide": _select(_sql_sobel(_COLOURS), "gx, gy"),
        "mask_or_wide": pair("or"),
        "dilate_r40_wide": plain(_sql_dilate(_SPLIT_ROUGH, 40)),
        "erode_r1_wide": plain(_sql_erode(_PATCHES, 1)),
        "seed_adaptive_wide": f"with {_sql_seed(_PATCHES, 8)} select * from seed",
        "snap_wide": _sql_snap(_SPLIT_ROUGH, _SPLIT_BARRIER, SPLIT, tiles.SPLIT_SIDE),
        "clip_smooth_wide": _sql_clip("case when m.core then 255 when m.active then 160 else 0 end", core),
        "interior_cells": f"select image_id, x, y from {_SCATTERED} where x between 1 and 62 and y between 1 and 62",
        "mask_get": f"select p.image_id, p.x, p.y, coalesce(m.active, false) as active from (select s_suppkey::bigint as image_id, x::int as x, 9 as y from supplier, (values (-3), (0), (17), (40), (70)) t(x)) p left join {_SCATTERED} m using (image_id, x, y)",
        "mask_set": _select(_SCATTERED, "(active or (image_id = 1 and x = 3 and y = 5)) as active"),
        "mask_or": pair("or"),
        "mask_and": pair("and"),
        "mask_and_not": pair("and not"),
        "mask_not": _select(_SCATTERED, "not active as active"),
        "mask_count": f"select image_id, count(*) filter (active) as n_active from {_SCATTERED} group by image_id",
        "dilate_r1": plain(_sql_dilate(_SCATTERED, 1)),
        "dilate_r40": plain(_sql_dilate(_SPLIT_ROUGH, 40)),
        "erode_r1": plain(_sql_erode(_PATCHES, 1)),
        "erode_r1_ignore_border": plain(_sql_erode(_PATCHES, 1, True)),
        "erode_r6": plain(_sql_erode(_SPLIT_ROUGH, 6)),
        "close_r2": plain(_sql_erode(_sql_dilate(_PATCHES, 2), 2)),
        "open_r1": plain(_sql_dilate(_sql_erode(_PATCHES, 1), 1)),
        "seed_adaptive": f"with {_sql_seed(_PATCHES, 8)} select * from seed",
        "allowed_zone": plain(_sql_dilate(_SPLIT_ROUGH, 9)),
        "connected_components": f"{parts} select * from named",
        "largest_component": f"{parts}, {ranked}",
        "snap_all": _sql_snap(_ROUGH, _BARRIER, LITERAL, tiles.SIDE),
        "snap_largest": _sql_snap(_ROUGH, _BARRIER, LARGEST, tiles.SIDE),
        "snap_all_split": _sql_snap(_SPLIT_ROUGH, _SPLIT_BARRIER, SPLIT_ALL, tiles.SPLIT_SIDE),
        "snap_largest_split": _sql_snap(_SPLIT_ROUGH, _SPLIT_BARRIER, SPLIT, tiles.SPLIT_SIDE),
        "clip_hard": _sql_clip("case when m.active then 255 else 0 end", _PATCHES),
        "clip_smooth": _sql_clip("case when m.core then 255 when m.active then 160 else 0 end", core),
        "clip_progressive": _sql_clip("(m.active::int + m.one::int + m.two::int) * 85", deep),
        "mask_image": _select(_PATCHES, f"255 as a, {white_black}"),
        "overlay_preview": f"select image_id, x, y, m.a, {mixed} from {_MAPS} m join {_COLOURS} o using (image_id, x, y)",
        "checkerboard": _select(_SCATTERED, f"255 as a, {level}"),
        "clip_pipeline_counts": counted,
    }
