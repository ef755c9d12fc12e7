"""Masks as rows of cells: construction, points, counts and algebra, which works on bit planes (:mod:`~tesselle.operators.packed`)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import KEY, MASK
from . import packed, tiled


def cells(images: DataFrame) -> DataFrame:
    """Every cell (image_id, x, y) of ``images`` (image_id, width, height); its partitions are kept, so no cell is shuffled."""
    rows = images.select("image_id", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"), "width")
    return rows.select("image_id", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"), "y")


def check_size(width: int, height: int) -> None:
    if width <= 0 or height <= 0:
        raise ValueError(f"a mask needs a positive size, not {width}x{height}")


def blank(spark: SparkSession, width: int, height: int, image_id: int = 0) -> DataFrame:
    """A mask without active cells."""
    check_size(width, height)
    flat = spark.range(width * height)
    return flat.select(F.lit(image_id).cast("long").alias("image_id"), (F.col("id") % width).cast("int").alias("x"), F.expr(f"cast(id div {width} as int)").alias("y"), F.lit(False).alias("active"))


def wrap(spark: SparkSession, width: int, height: int, values: Sequence[bool], image_id: int = 0) -> DataFrame:
    """A mask of row-by-row values."""
    check_size(width, height)
    if len(values) != width * height:
        raise ValueError(f"{len(values)} values do not fill {width}x{height}")
    return spark.createDataFrame([(image_id, i % width, i // width, bool(v)) for i, v in enumerate(values)], MASK)


def blanks(images: DataFrame) -> DataFrame:
    """A mask without active cells for each of ``images`` (image_id, width, height); a size that is not positive raises when it is reached."""
    bad = F.raise_error(F.concat(F.lit("a mask needs a positive size, not "), F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"))).cast("int")
    checked = images.withColumn("width", F.when((F.col("width") > 0) & (F.col("height") > 0), F.col("width")).otherwise(bad))
    return cells(checked).withColumn("active", F.lit(False))


def wrapped(rows: DataFrame) -> DataFrame:
    """A mask of the row-by-row ``values`` (an array of booleans) of each row (image_id, width, height, values); an array of another length
    than width * height raises when it is reached, a null value is inactive."""
    bad = F.raise_error(F.concat(F.size("values").cast("string"), F.lit(" values do not fill "), F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"))).cast("array<boolean>")
    fits = (F.col("width") > 0) & (F.col("height") > 0) & (F.size("values") == F.col("width") * F.col("height"))
    at = rows.select("image_id", "width", F.posexplode(F.when(fits, F.col("values")).otherwise(bad)).alias("i", "value"))
    return at.select("image_id", (F.col("i") % F.col("width")).cast("int").alias("x"), F.expr("cast(i div width as int)").alias("y"), F.coalesce("value", F.lit(False)).alias("active"))


def sizes(mask: DataFrame) -> DataFrame:
    """Width and height of each image's mask, from its largest cell."""
    return mask.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def inside(x: Column | int, y: Column | int, width: Column | int, height: Column | int) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    x, y = as_column(x), as_column(y)
    return (x >= 0) & (x < as_column(width)) & (y >= 0) & (y < as_column(height))


def get(mask: DataFrame, points: DataFrame) -> DataFrame:
    """``points`` (image_id, x, y) with ``active``; false outside the mask."""
    return points.join(mask.select(*KEY, "active"), list(KEY), "left").withColumn("active", F.coalesce("active", F.lit(False)))


def set_cell(mask: DataFrame, x: int, y: int, value: bool, image_id: int = 0) -> DataFrame:
    """The mask with one cell set; outside it nothing changes."""
    here = (F.col("image_id") == image_id) & (F.col("x") == x) & (F.col("y") == y)
    return mask.withColumn("active", F.when(here, F.lit(value)).otherwise(F.col("active")))


def count_active(mask: DataFrame) -> DataFrame:
    """Active cells of each image."""
    return mask.groupBy("image_id").agg(F.count_if("active").alias("n_active"))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """image_id, width, height, other_width, other_height and ``same`` for each image of two relations with sizes; one that lacks it has nulls."""
    right = b.select("image_id", F.col("width").alias("other_width"), F.col("height").alias("other_height"))
    return a.select("image_id", "width", "height").join(right, "image_id", "full").withColumn("same", F.expr("width <=> other_width and height <=> other_height"))


def check_same_size(a: DataFrame, b: DataFrame) -> None:
    """Raises where an image of one mask is missing in the other or has another size there."""
    bad = compared(sizes(a), sizes(b)).where("not same").first()
    if bad is not None:
        raise ValueError(f"masks differ in size: {bad.width}x{bad.height} and {bad.other_width}x{bad.other_height} (image {bad.image_id})")


def _paired(a: DataFrame, b: DataFrame, operator: Callable[[DataFrame, DataFrame], DataFrame], wide: bool) -> DataFrame:
    """Both masks as bit planes, word by word. An image of two sizes, or one that a mask lacks, raises when it is reached."""
    side = tiled.SIDE if wide else None
    return packed.unpack(operator(packed.pack(a, side), packed.pack(b, side)))


def union(a: DataFrame, b: DataFrame, wide: bool = False) -> DataFrame:
    """Cells active in either; masks of different sizes are an error."""
    return _paired(a, b, packed.union, wide)


def intersection(a: DataFrame, b: DataFrame, wide: bool = False) -> DataFrame:
    """Cells active in both; masks of different sizes are an error."""
    return _paired(a, b, packed.intersection, wide)


def difference(a: DataFrame, b: DataFrame, wide: bool = False) -> DataFrame:
    """Cells active in the first alone; masks of different sizes are an error."""
    return _paired(a, b, packed.difference, wide)


def copy(mask: DataFrame) -> DataFrame:
    """The same cells: a DataFrame never changes, so a copy is the mask itself."""
    return mask.select(*KEY, "active")


def complement(mask: DataFrame) -> DataFrame:
    return mask.withColumn("active", ~F.col("active"))
