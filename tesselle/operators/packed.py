"""Masks as bit planes: a row for each image, or for each tile of one, with its cells in 64-bit words.

    image_id, width, height    the image and its size
    x0, y0, w, h               the tile's place and size; an image in one piece is a tile of its own
    bits                       array of longs, line by line; a line begins a new word, and its cell x is bit x % 64 of its word x div 64

Algebra, counts and points work on words, 64 cells at a time, as expressions of the JVM: no cell becomes a row and nothing goes through
Python. Bits past a line's end are 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEY

TILE = ("image_id", "width", "height", "x0", "y0", "w", "h")
TILE_KINDS = "image_id long, width int, height int, x0 int, y0 int, w int, h int"
PLACE = ("image_id", "x0", "y0")
WORD = 64
#: Longs of a run of WORD pixels, two pixels in each, and how many of them are put together at once.
LONGS, AT_ONCE = 32, 8


def line_words(width: Column | int) -> Column | int:
    """Words of a line."""
    return F.floor((width + (WORD - 1)) / WORD).cast("int") if isinstance(width, Column) else -(-width // WORD)


def to_plane(words: np.ndarray, width: int, height: int) -> np.ndarray:
    """A tile's words as a 2-D boolean array."""
    lines = np.ascontiguousarray(words, "<i8").view(np.uint8).reshape(height, line_words(width) * 8)
    return np.unpackbits(lines, axis=1, count=width, bitorder="little").astype(bool)


def to_words(plane: np.ndarray) -> np.ndarray:
    """A 2-D boolean array as a tile's words."""
    height, width = plane.shape
    lines = np.zeros((height, line_words(width) * 8), np.uint8)
    lines[:, : -(-width // 8)] = np.packbits(plane, axis=1, bitorder="little")
    return lines.reshape(-1).view("<i8")


def pack(mask: DataFrame, side: int | None = None, column: str = "active") -> DataFrame:
    """The cells of ``mask`` as bit planes: of whole images, or of tiles of ``side``, a multiple of 64.

    Words are put together before they move, and a mask whose images lie in one partition each moves nothing. Null and missing cells are
    inactive; an image is as large as its largest cell says.
    """
    if side is not None and side % WORD:
        raise ValueError(f"a tile's side must be a multiple of {WORD}, not {side}")
    at = lambda c: F.expr(f"{c} div {side}").cast("int") if side else F.lit(0)
    cells = mask.select("image_id", at("x").alias("tx"), at("y").alias("ty"), "x", "y", F.expr(f"cast(x div {WORD} as int)").alias("k"), F.when(F.col(column), F.expr(f"shiftleft(1L, x % {WORD})")).otherwise(0).alias("bit"))
    words = cells.groupBy("image_id", "tx", "ty", "y", "k").agg(F.bit_or("bit").alias("word"), F.max("x").alias("x"))
    tiles = words.groupBy("image_id", "tx", "ty").agg(F.array_sort(F.collect_list(F.struct("y", "k", "word"))).alias("words"), F.max("x").alias("right"), F.max("y").alias("bottom"))
    image = Window.partitionBy("image_id")  # over its tiles
    left, top = F.col("tx") * (side or 0), F.col("ty") * (side or 0)
    sized = tiles.select("*", (F.max("right").over(image) + 1).cast("int").alias("width"), (F.max("bottom").over(image) + 1).cast("int").alias("height")) if side else tiles.select("*", (F.col("right") + 1).cast("int").alias("width"), (F.col("bottom") + 1).cast("int").alias("height"))
    size = lambda whole, first: F.least(F.lit(side), F.col(whole) - first).cast("int") if side else F.col(whole)
    placed = sized.select("image_id", "width", "height", left.cast("int").alias("x0"), top.cast("int").alias("y0"), size("width", left).alias("w"), size("height", top).alias("h"), "words")
    each = line_words(F.col("w"))
    whole = F.size("words") == F.col("h") * each
    # where words are missing, each place is looked up
    found = "transform(sequence(0, h * n - 1), i -> coalesce(get(filter(words, e -> (e.y - y0) * n + e.k - x0 div 64 = i), 0).word, 0L))"
    return placed.withColumn("n", each).select(*TILE, F.when(whole, F.transform("words", lambda e: e["word"])).otherwise(F.expr(found)).alias("bits"))


def unpack(tiles: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """The cells (image_id, x, y) of every tile with a boolean of each column of bits, by default ``bits`` as ``active``.

    ``columns`` gives the name of a cell's value for each column; a column that is no array of longs has a value for each cell, line by line.
    """
    columns = columns or {"bits": "active"}
    packed = {c: dict(tiles.dtypes)[c] == "array<bigint>" for c in columns}
    each = {c: F.col("n") if packed[c] else F.col("w") for c in columns}
    lines = tiles.withColumn("n", line_words(F.col("w"))).select("image_id", "x0", "y0", "w", "n", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("row"), *columns)
    lines = lines.select("image_id", "x0", (F.col("y0") + F.col("row")).alias("y"), "w", *(F.slice(F.col(c), F.col("row") * each[c] + 1, each[c]).alias(c) for c in columns))
    cells = lines.select("image_id", "x0", "y", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("c"), *columns)
    bit = lambda c: F.expr(f"shiftright({c}[cast(c div {WORD} as int)], c % {WORD}) & 1L") == 1
    return cells.select("image_id", (F.col("x0") + F.col("c")).alias("x"), "y", *((bit(c) if packed[c] else F.col(c)[F.col("c")]).alias(name) for c, name in columns.items()))


def runs(pixels: DataFrame, side: int | None = None) -> DataFrame:
    """Dense pixels as a row for each image, or for each of its tiles: image_id, x0, y0, ``right`` and ``bottom`` (its last cells) and ``runs`` of
    pixels, four bytes each; a channel that is not there is 255, a null one 0.

    Pixels are put together before Python sees them, where a row costs the same however little it holds. Pixels that lie in one partition for each
    image do not move.
    """
    if side is not None and side % WORD:
        raise ValueError(f"a tile's side must be a multiple of {WORD}, not {side}")
    at = lambda c: F.expr(f"{c} div {side} * {side}").cast("int") if side else F.lit(0)
    value = F.lit(0)
    for i, c in enumerate("argb"):
        level = F.coalesce(F.col(c).cast("int"), F.lit(0)).bitwiseAND(255) if c in pixels.columns else F.lit(255)
        value = value.bitwiseOR(F.shiftleft(level, 8 * i))
    few, parts = 2 * AT_ONCE, LONGS // AT_ONCE
    cells = pixels.select("image_id", at("x").alias("x0"), at("y").alias("y0"), "x", "y", F.expr(f"cast(x div {few} as int)").alias("k"), value.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)).alias("argb"))
    longs = [F.bit_or(F.expr(f"if(x % {few} div 2 = {j}, shiftleft(argb, cast(32 * (x % 2) as int)), 0L)")).alias(f"u{j}") for j in range(AT_ONCE)]
    lines = cells.groupBy("image_id", "x0", "y0", "y", "k").agg(*longs, F.max("x").alias("x"))
    longs = [F.bit_or(F.expr(f"if(k % {parts} = {i}, u{j}, 0L)")).alias(f"v{i * AT_ONCE + j}") for i in range(parts) for j in range(AT_ONCE)]
    lines = lines.groupBy("image_id", "x0", "y0", "y", F.expr(f"cast(k div {parts} as int)").alias("k")).agg(*longs, F.max("x").alias("x"))
    run = F.struct("y", "k", *(f"v{j}" for j in range(LONGS)))
    return lines.groupBy("image_id", "x0", "y0").agg(F.collect_list(run).alias("runs"), F.max("x").cast("int").alias("right"), F.max("y").cast("int").alias("bottom"))


def pictures(rows: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The pixels of each row of :func:`runs`, (h, w, 4) bytes in the order of argb."""
    column = rows.column("runs")
    first, flat = column.offsets.to_numpy(), column.values
    y, k = (flat.field(c).to_numpy() for c in ("y", "k"))
    pixels = np.stack([flat.field(f"v{j}").to_numpy() for j in range(LONGS)], 1).astype("<i8").view(np.uint8).reshape(-1, WORD, 4)
    for i, (x0, y0, right, bottom) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("x0", "y0", "right", "bottom")), strict=True)):
        own = slice(first[i], first[i + 1])
        out = np.zeros((bottom + 1 - y0, (right - x0) // WORD + 1, WORD, 4), np.uint8)
        out[y[own] - y0, k[own] - x0 // WORD] = pixels[own]
        yield out.reshape(len(out), -1, 4)[:, : right + 1 - x0]


def _paired(a: DataFrame, b: DataFrame, word: Callable[[Column, Column], Column]) -> DataFrame:
    right = b.select(*PLACE, *(F.col(c).alias(f"__{c}") for c in ("width", "height", "bits")))
    both = a.select(*TILE, "bits").join(right, list(PLACE), "full")
    apart = F.expr("not (width <=> __width and height <=> __height)")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    raised = F.raise_error(F.concat(F.lit("sizes differ: "), text("width"), F.lit("x"), text("height"), F.lit(" and "), text("__width"), F.lit("x"), text("__height"), F.lit(" (image "), text("image_id"), F.lit(")")))
    return both.select(*TILE, F.when(apart, raised.cast("array<bigint>")).otherwise(F.zip_with("bits", "__bits", word)).alias("bits"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells active in either. Images of two sizes, or that only one has, raise when they are reached; tiles must be cut alike."""
    return _paired(a, b, lambda p, q: p.bitwiseOR(q))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells active in both; sizes as for :func:`union`."""
    return _paired(a, b, lambda p, q: p.bitwiseAND(q))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells active in the first alone; sizes as for :func:`union`."""
    return _paired(a, b, lambda p, q: p.bitwiseAND(F.bitwise_not(q)))


def complement(tiles: DataFrame) -> DataFrame:
    """Cells that are not active; bits past a line's end stay 0."""
    past = F.expr(f"if(w % {WORD} = 0, -1L, ~shiftleft(-1L, w % {WORD}))")
    cut = tiles.withColumn("__n", line_words(F.col("w"))).withColumn("__past", past)
    flipped = F.expr("transform(bits, (word, i) -> if((i + 1) % __n = 0, ~word & __past, ~word))")
    return cut.withColumn("bits", flipped).drop("__n", "__past")


def active_cells(bits: Column | str = "bits") -> Column:
    """How many cells of a tile are active."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, word: s + F.bit_count(word))


def count_active(tiles: DataFrame) -> DataFrame:
    """Active cells of each image."""
    return tiles.groupBy("image_id").agg(F.sum(active_cells()).alias("n_active"))


def sizes(tiles: DataFrame) -> DataFrame:
    """Width and height of each image."""
    return tiles.select("image_id", "width", "height").distinct()


def get(tiles: DataFrame, points: DataFrame) -> DataFrame:
    """``points`` (image_id, x, y) with ``active``; false outside the mask. Only the tile of a point is looked at."""
    cut = tiles.select(*PLACE, F.col("w").alias("__w"), F.col("h").alias("__h"), "bits")
    # a tile has its place on a lattice whose step is the first tile's size: points are sent to the tiles of their own lattice place
    step = tiles.groupBy("image_id").agg(F.max("w").alias("__sx"), F.max("h").alias("__sy"))
    # words are never sent to all machines, however few they are thought to be
    at = points.join(step.hint("merge"), "image_id", "left")
    at = at.withColumn("__x0", F.expr("cast(floor(x / __sx) * __sx as int)")).withColumn("__y0", F.expr("cast(floor(y / __sy) * __sy as int)"))
    found = at.join(cut.hint("merge"), [at.image_id == cut.image_id, F.col("__x0") == F.col("x0"), F.col("__y0") == F.col("y0")], "left").drop(cut.image_id)
    here = F.expr(f"x - x0 between 0 and __w - 1 and y - y0 between 0 and __h - 1 and (shiftright(bits[cast((y - y0) * ((__w + {WORD - 1}) div {WORD}) + (x - x0) div {WORD} as int)], (x - x0) % {WORD}) & 1L) = 1")
    return found.select(*(at[c] for c in points.columns), F.coalesce(here, F.lit(False)).alias("active"))


def set_cell(tiles: DataFrame, x: int, y: int, value: bool, image_id: int = 0) -> DataFrame:
    """The mask with one cell set; outside it nothing changes."""
    inside = (F.col("image_id") == image_id) & F.lit(x).between(F.col("x0"), F.col("x0") + F.col("w") - 1) & F.lit(y).between(F.col("y0"), F.col("y0") + F.col("h") - 1)
    place = F.expr(f"cast(({y} - y0) * ((w + {WORD - 1}) div {WORD}) + ({x} - x0) div {WORD} as int)")
    bit = F.expr(f"shiftleft(1L, ({x} - x0) % {WORD})")
    changed = F.transform("bits", lambda word, i: F.when(i == place, word.bitwiseOR(bit) if value else word.bitwiseAND(F.bitwise_not(bit))).otherwise(word))
    return tiles.withColumn("bits", F.when(inside, changed).otherwise(F.col("bits")))


def cells_of(mask: DataFrame) -> DataFrame:
    return mask.select(*KEY, "active")
