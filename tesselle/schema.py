"""The relations that stand for rasters.

``images`` has a row for each raster, its bytes row by row; ``pixels`` a row for each pixel; ``mask`` one for each cell.
Pixels and masks are dense: false cells have rows too, without which complement and erosion would be wrong.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGES = "image_id long, origin string, width int, height int, n_channels int, data binary"
PIXELS = "image_id long, x int, y int, a int, r int, g int, b int"
MASK = "image_id long, x int, y int, active boolean"
KEY = ("image_id", "x", "y")
#: Cells of a partition that :func:`by_image` makes: no fewer, and beyond four partitions for each core no more.
FEW_CELLS, MANY_CELLS = 1 << 18, 1 << 22


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, which the cluster names; a session on one machine may do without and gets a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return (named or "file:///tmp/tesselle").rstrip("/")


def prepare(spark: SparkSession) -> None:
    """Let joins by cell use the partitions by image that their sides already have, instead of dealing both out anew."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def by_image(df: DataFrame) -> DataFrame:
    """Rows of images (with width and height) dealt out so that all of an image are in one partition: every window over its lines and columns then
    needs no further exchange.

    There are as many partitions as the cells call for that the rows grow to, as Spark sees the few bytes of the rows alone and would put them
    all together. For images too large for one task leave this out; the windows then exchange by line and by column.
    """
    prepare(df.sparkSession)
    cells = df.agg(F.sum(F.col("width").cast("long") * F.col("height"))).first()[0] or 0
    least = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(-(-cells // FEW_CELLS), max(least, -(-cells // MANY_CELLS)))), "image_id")


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt out by columns for work that their bytes do not tell of (images that compress well, say), which Spark would put in few tasks."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *columns)
