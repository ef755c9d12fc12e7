"""Tiles derived from the supplier table, one for each row, so that their number follows the scale.

The small rows are dealt out by image before they grow to pixels: no pixel is shuffled, and all later windows
by line and column find their images whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import cells
from ..schema import by_image

SIDE, SPLIT_SIDE, WIDE_SIDE = 64, 40, 150
#: Colours of the ground, of the two kinds of road, and of the overlay.
GROUND, ORANGE, YELLOW, GREEN = (230, 226, 219), (245, 165, 100), (250, 230, 140), (0, 220, 0)


def images(spark: SparkSession, sf_dir: str, side: int = SIDE) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("image_id"), F.col("s_nationkey").cast("int").alias("nation"))
    return by_image(rows.select("image_id", "nation", F.lit(side).alias("width"), F.lit(side).alias("height")))


def _cells(spark: SparkSession, sf_dir: str, side: int = SIDE) -> DataFrame:
    """Cells with their image's nation."""
    rows = images(spark, sf_dir, side).select("image_id", "nation", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"), "width")
    return rows.select("image_id", "nation", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"), "y")


def _colour(df: DataFrame, *choices) -> DataFrame:
    """Opaque pixels of the first colour whose condition holds; the last has none."""
    level = {}
    for i, c in enumerate("rgb"):
        value = F.lit(choices[-1][i])
        for condition, colour in reversed(choices[:-1]):
            value = F.when(condition, colour[i]).otherwise(value)
        level[c] = value
    return df.select("image_id", "x", "y", F.lit(255).alias("a"), *(level[c].alias(c) for c in "rgb"))


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground crossed by two orange and two yellow roads."""
    k = (F.col("image_id") % 5).cast("int")
    x, y = F.col("x"), F.col("y")
    return _colour(_cells(spark, sf_dir), (x.between(12 + k, 15 + k) | x.between(50, 53), ORANGE), (y.between(12, 15) | y.between(50, 53), YELLOW), GROUND)


def overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A green rectangle on black."""
    here = F.col("x").between(22 + F.col("nation") % 6, 44) & F.col("y").between(22, 46)
    return _colour(_cells(spark, sf_dir), (here, GREEN), (0, 0, 0))


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of many colours and alphas."""
    parts = {"a": "x * 13 + y * 17 + image_id", "r": "x * 37 + image_id * 11", "g": "y * 53 + image_id * 29", "b": "x * y * 7 + image_id * 3"}
    return cells(images(spark, sf_dir)).select("image_id", "x", "y", *(F.expr(f"cast(({e}) % 256 as int)").alias(c) for c, e in parts.items()))


def warm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of road-like colours."""
    parts = {"a": "255", "r": "200 + (x * 7 + image_id) % 56", "g": "120 + (y * 5 + image_id * 3) % 136", "b": "40 + (x * 3 + y * 11) % 216"}
    return cells(images(spark, sf_dir)).select("image_id", "x", "y", *(F.expr(f"cast({e} as int)").alias(c) for c, e in parts.items()))


def scattered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask of scattered cells."""
    return cells(images(spark, sf_dir)).withColumn("active", F.expr("(x * 7 + y * 13 + image_id * 5) % 11 < 4"))


def striped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another, of stripes."""
    return cells(images(spark, sf_dir)).withColumn("active", F.expr("(x * 5 + y * 3 + image_id) % 7 < 3"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask of patches with gaps."""
    return cells(images(spark, sf_dir)).withColumn("active", F.expr("(x div 9 + y div 7 + image_id) % 3 != 0"))


def split_rough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rough selection that lies on both sides of :func:`split_barrier`."""
    return cells(images(spark, sf_dir, SPLIT_SIDE)).withColumn("active", F.expr("x between 6 and 30 and y between 10 and 24"))


def split_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(images(spark, sf_dir, SPLIT_SIDE)).withColumn("active", F.expr("x = 20 + image_id % 3"))


def two_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rough selection of two strokes, each on both sides of :func:`strokes_barrier`."""
    return cells(images(spark, sf_dir)).withColumn("active", F.expr("x between 8 and 34 and (y between 6 and 22 or y between 40 and 40 + 8 + image_id % 9)"))


def strokes_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A road through both strokes, broken in some images."""
    return cells(images(spark, sf_dir)).withColumn("active", F.expr("x = 20 + image_id % 3 and (y < 44 or image_id % 4 != 0)"))


def large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask of winding bands on a square that is not a multiple of any tile."""
    return cells(images(spark, sf_dir, WIDE_SIDE)).withColumn("active", F.expr("(x + y div 3 + image_id) % 17 < 9 and (y % 31 < 27 or x % 50 < 6)"))
