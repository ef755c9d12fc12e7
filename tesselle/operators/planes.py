"""Images whole in one task: their rows of cells become planes, which one function of planes takes through as many steps as it needs.

An image of some hundred million cells fits in a task. Larger ones are cut into tiles (``wide=True``, :mod:`~tesselle.operators.tiled`), which
go through the same functions of planes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.color import is_green, is_road, luminance
from ..schema import KEY

Planes = dict[str, np.ndarray]
_TYPES = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType()}


class Cells:
    """One image's cells, in any order."""

    def __init__(self, table: pa.Table):
        self.table = table
        self.x, self.y = (table.column(c).to_numpy() for c in ("x", "y"))
        self.shape = (int(self.y.max()) + 1, int(self.x.max()) + 1) if len(self.x) else (0, 0)

    def plane(self, column: str, shape: tuple[int, int] | None = None) -> np.ndarray:
        """A column as a plane, of another shape if one is given; nulls and missing cells are false or 0."""
        height, width = shape or self.shape
        values = self.table.column(column)
        values = (values.fill_null(False) if pa.types.is_boolean(values.type) else values.fill_null(0)).to_numpy()
        out = np.zeros((height, width), values.dtype)
        inside = (self.x < width) & (self.y < height)
        if inside.all():
            out[self.y, self.x] = values
        else:
            out[self.y[inside], self.x[inside]] = values[inside]
        return out

    def planes(self, columns: list[str], shape: tuple[int, int] | None = None) -> Planes:
        return {c: self.plane(c, shape) for c in columns}

    def with_planes(self, made: Planes, types: dict[str, str], names: list[str]) -> pa.Table:
        """The cells' rows with a column of each plane; of a masked plane the masked cells are null."""
        columns = []
        for name in names:
            if name in made:
                values = made[name][self.y, self.x]
                hidden = np.ma.getmaskarray(values) if isinstance(values, np.ma.MaskedArray) else None
                columns.append(pa.array(np.asarray(values), to_arrow_type(_TYPES[types[name]]), mask=hidden))
            else:
                columns.append(self.table.column(name))
        return pa.Table.from_arrays(columns, names)


def _schema(df: DataFrame, kept: list[str], made: dict[str, str]) -> T.StructType:
    fields = {f.name: f for f in df.schema.fields}
    return T.StructType([T.StructField(n, _TYPES[made[n]]) if n in made else fields[n] for n in [*kept, *(m for m in made if m not in kept)]])


def per_image(df: DataFrame, function: Callable[[Planes], Planes], columns: list[str], made: dict[str, str], kept: list[str] | None = None) -> DataFrame:
    """``df`` (or its ``kept`` columns) with the columns ``made`` (name and type), planes that ``function`` makes of those of ``columns``."""
    schema = _schema(df, df.columns if kept is None else kept, made)
    needed = list(dict.fromkeys([*KEY, *(n for n in schema.names if n not in made), *columns]))
    names = schema.names
    return df.select(needed).groupBy("image_id").applyInArrow(lambda table: _one(table, function, columns, made, names), schema)


def _one(table: pa.Table, function: Callable, columns: list[str], made: dict[str, str], names: list[str]) -> pa.Table:
    cells = Cells(table)
    return cells.with_planes(function(cells.planes(columns)), made, names)


def same_shape(a: Cells, b: Cells) -> None:
    """Raises where the images differ in size or one of them is missing."""
    if a.shape != b.shape:
        raise ValueError(f"sizes differ: {a.shape[1]}x{a.shape[0]} and {b.shape[1]}x{b.shape[0]}")


def together(a: DataFrame, b: DataFrame, function: Callable[[Planes, Planes], Planes], columns: tuple[list[str], list[str]], made: dict[str, str], kept: list[str], exact: bool = False) -> DataFrame:
    """The ``kept`` columns of ``a`` with columns ``made`` from planes of ``a`` and of ``b``, image by image.

    With ``exact`` an image of another size in ``b``, or one that only either has, is an error; else missing cells of ``b`` are false or 0
    and images that only ``b`` has are left out.
    """
    schema = _schema(a, kept, made)
    left = a.select(list(dict.fromkeys([*KEY, *(n for n in schema.names if n not in made), *columns[0]]))).groupBy("image_id")
    right = b.select(list(dict.fromkeys([*KEY, *columns[1]]))).groupBy("image_id")
    return left.cogroup(right).applyInArrow(partial(_two, function=function, columns=columns, made=made, names=schema.names, exact=exact), schema)


def _two(left: pa.Table, right: pa.Table, function: Callable, columns: tuple[list[str], list[str]], made: dict[str, str], names: list[str], exact: bool) -> pa.Table:
    a, b = Cells(left), Cells(right)
    if exact:
        same_shape(a, b)
    if not left.num_rows:
        return a.with_planes({n: np.zeros((0, 0)) for n in made}, made, names)
    return a.with_planes(function(a.planes(columns[0]), b.planes(columns[1], a.shape)), made, names)


def summed(a: DataFrame, b: DataFrame, function: Callable[[Planes, Planes], dict[str, int]], columns: tuple[list[str], list[str]], schema: str) -> DataFrame:
    """A row for each image of ``a``: its id and the numbers that ``function`` finds in its planes and those of ``b``."""
    left, right = (df.select(list(dict.fromkeys([*KEY, *c]))).groupBy("image_id") for df, c in zip((a, b), columns, strict=True))
    return left.cogroup(right).applyInArrow(partial(_sum, function=function, columns=columns), schema)


def _sum(left: pa.Table, right: pa.Table, function: Callable, columns: tuple[list[str], list[str]]) -> pa.Table:
    a, b = Cells(left), Cells(right)
    numbers = function(a.planes(columns[0]), b.planes(columns[1], a.shape))
    row = {"image_id": left.column("image_id").slice(0, 1), **{n: [int(v)] for n, v in numbers.items()}}
    return pa.table(row) if left.num_rows else pa.table(row).slice(0, 0)


# What is done with planes.


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of those of 0..n-1 that each is connected with by links (a, b)."""
    root = np.arange(n)
    while True:  # hook the larger root under the smaller, then shorten all paths
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (shorter := root[root] != root).any():
            root = np.where(shorter, root[root], root)


def labels(domain: np.ndarray) -> np.ndarray:
    """4-connected components of a 2-D boolean array: the smallest row-by-row place of a cell's component, -1 off the domain."""
    height, width = domain.shape
    flat = np.zeros((height, width + 1), bool)
    flat[:, :-1] = domain
    steps = np.diff(np.concatenate(([False], flat.ravel(), [False])).astype(np.int8))
    first, last = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)  # runs, in lines of width + 1
    out = np.full((height, width), -1, np.int64)
    if not len(first):
        return out
    # a run meets those of the line above whose columns overlap its own
    low = np.searchsorted(last, first - (width + 1), "right")
    high = np.searchsorted(first, last - (width + 1), "left")
    count = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(first)), count)
    b = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    root = joined(len(first), a, b)
    start = first // (width + 1) * width + first % (width + 1)
    out[domain] = np.repeat(start[root], last - first)
    return out


def in_square(mask: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Active cells in the square around each cell, and how many cells of it lie in the image; by running sums."""
    height, width = mask.shape
    sums = np.zeros((height + 1, width + 1), np.int64)
    sums[1:, 1:] = mask.cumsum(0).cumsum(1)
    y, x = np.arange(height), np.arange(width)
    top, bottom = np.maximum(y - radius, 0)[:, None], np.minimum(y + radius + 1, height)[:, None]
    left, right = np.maximum(x - radius, 0)[None, :], np.minimum(x + radius + 1, width)[None, :]
    lines = sums[bottom[:, 0]] - sums[top[:, 0]]
    return np.take(lines, right[0], 1) - np.take(lines, left[0], 1), (bottom - top) * (right - left)


def dilated(mask: np.ndarray, radius: int) -> np.ndarray:
    return in_square(mask, radius)[0] > 0 if radius > 0 else mask


def eroded(mask: np.ndarray, radius: int, border: str = "inactive") -> np.ndarray:
    if radius <= 0:
        return mask
    found, cells = in_square(mask, radius)
    return found == ((2 * radius + 1) ** 2 if border == "inactive" else cells)


def closed(mask: np.ndarray, radius: int, border: str = "inactive") -> np.ndarray:
    return eroded(dilated(mask, radius), radius, border)


def opened(mask: np.ndarray, radius: int, border: str = "inactive") -> np.ndarray:
    return dilated(eroded(mask, radius, border), radius)


def radii(first: int) -> list[int]:
    """A radius and its halves, down to 1."""
    out = []
    while first > 0:
        out.append(first)
        first //= 2
    return out


def seeded(mask: np.ndarray, radius: int, border: str = "inactive") -> np.ndarray:
    """The mask eroded by the largest of :func:`radii` that leaves a cell, or unchanged if none does."""
    return next((s for r in radii(radius) if (s := eroded(mask, r, border)).any()), mask)


def seeded_each(mask: np.ndarray, radius: int, border: str = "inactive") -> np.ndarray:
    """As :func:`seeded`, with the radius found for each component by itself."""
    parts = labels(mask)
    left, out = mask, np.zeros(mask.shape, bool)
    for r in radii(radius):  # a square within the mask lies within one component
        core = eroded(mask, r, border) & left
        out |= core
        left = left & ~np.isin(parts, np.unique(parts[core]))
    return out | left


def largest(mask: np.ndarray) -> np.ndarray:
    """The largest component alone; of equal ones, the one with the smallest place."""
    return largest_within(mask, mask[:0]) if mask.any() else mask


def largest_within(mask: np.ndarray, strokes: np.ndarray) -> np.ndarray:
    """Of each component of ``strokes`` the largest component of ``mask`` in it, of equal ones that with the smallest place; without strokes, of all."""
    if not mask.any():
        return mask
    parts = labels(mask)
    names, first, sizes = np.unique(parts[mask], return_index=True, return_counts=True)
    of = labels(strokes)[mask][first] if strokes.size else np.zeros(len(names), np.int64)
    order = np.lexsort((names, -sizes, of))
    best = order[np.concatenate(([True], of[order][1:] != of[order][:-1]))]
    return np.isin(parts, names[best])


def grown(seed: np.ndarray, allowed: np.ndarray, barrier: np.ndarray, policy: str, strokes: np.ndarray | None = None) -> np.ndarray:
    """The components of allowed cells off the barrier that hold a seed: of the seed's largest component alone with ``largest``, of the
    largest in each component of ``strokes`` with ``stroke``, else of all."""
    free, seed = allowed & ~barrier, seed & ~barrier
    if policy == "largest":
        seed = largest(seed)
    elif policy == "stroke":
        seed = largest_within(seed, strokes)
    region = labels(free)
    return np.isin(region, np.unique(region[seed & free])) & free


def distances(mask: np.ndarray) -> np.ndarray:
    """How far each cell is from the nearest inactive one or from outside the image, in steps to any of eight neighbours; 0 where inactive.

    Exact, in one pass down and one up: a line follows from its neighbour, and along a line the least sum with the way is a running minimum.
    """
    height, width = mask.shape
    out = np.zeros((height + 2, width + 2), np.int32)  # with a line of outside on each side
    out[1:-1, 1:-1] = np.where(mask, np.int32(height + width), 0)
    along = np.arange(width + 2, dtype=np.int32)
    for lines in (range(1, height + 1), range(height, 0, -1)):
        for y in lines:
            near = out[y - 1] if lines.step > 0 else out[y + 1]
            line = np.minimum(out[y], near + 1)
            line[1:] = np.minimum(line[1:], near[:-1] + 1)
            line[:-1] = np.minimum(line[:-1], near[1:] + 1)
            line[0] = line[-1] = 0
            line = np.minimum.accumulate(line - along) + along
            line = (np.minimum.accumulate((line + along)[::-1]) - along[::-1])[::-1]
            out[y] = np.where(out[y] > 0, line, 0)
    return out[1:-1, 1:-1]


def extreme(values: np.ndarray, radius: int, of: np.ufunc) -> np.ndarray:
    """The minimum or maximum (``of``) of the square around each cell, cut at the edge: along each axis the running extremes of blocks from both ends,
    three comparisons a cell whatever the radius."""
    side = 2 * radius + 1
    for _ in range(2):
        height, width = values.shape
        rest = np.iinfo(values.dtype).max if of is np.minimum else np.iinfo(values.dtype).min
        padded = np.full((height, -(-(width + 2 * radius) // side) * side), rest, values.dtype)
        padded[:, radius : radius + width] = values
        blocks = padded.reshape(height, -1, side)
        ahead = of.accumulate(blocks, axis=2).reshape(height, -1)
        back = of.accumulate(blocks[:, :, ::-1], axis=2)[:, :, ::-1].reshape(height, -1)
        values = of(back[:, :width], ahead[:, side - 1 : side - 1 + width]).T
    return values


def spread(values: np.ndarray, radius: int) -> np.ndarray:
    """The largest less the smallest value of the square around each cell."""
    return extreme(values, radius, np.maximum) - extreme(values, radius, np.minimum)


def outline(region: np.ndarray, barrier: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many sides of each cell of a region end at the barrier, at the image's edge, and elsewhere."""
    on, wall = np.pad(region, 1), np.pad(barrier & ~region, 1)
    outside = np.pad(np.zeros(region.shape, bool), 1, constant_values=True)
    counts = [np.zeros(region.shape, np.int32) for _ in range(3)]
    for dy, dx in ((0, 1), (2, 1), (1, 0), (1, 2)):
        at = (slice(dy, dy + region.shape[0]), slice(dx, dx + region.shape[1]))
        ends = region & ~on[at]
        for count, kind in zip(counts, (wall[at], outside[at], ~wall[at] & ~outside[at]), strict=True):
            count += ends & kind
    return tuple(counts)


def gradients(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> tuple[np.ma.MaskedArray, np.ma.MaskedArray]:
    """Sobel gradients of the luminance along lines and along columns, masked on the edge."""
    lum = luminance(r, g, b)
    out = [np.ma.masked_all(lum.shape, np.int32) for _ in "xy"]
    if min(lum.shape) > 2:
        across, weighted = lum[:, 2:] - lum[:, :-2], lum[:, :-2] + 2 * lum[:, 1:-1] + lum[:, 2:]
        out[0][1:-1, 1:-1] = across[:-2] + 2 * across[1:-1] + across[2:]
        out[1][1:-1, 1:-1] = weighted[2:] - weighted[:-2]
    return out[0], out[1]


def strong(r: np.ndarray, g: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
    """Inner cells whose gradient is as large as the threshold."""
    gx, gy = (v.filled(0).astype(np.int64) for v in gradients(r, g, b))
    inner = np.zeros(gx.shape, bool)
    inner[1:-1, 1:-1] = True
    return inner & (gx * gx + gy * gy >= threshold * threshold)


def greens(p: Planes) -> np.ndarray:
    return opened(is_green(p["a"], p["r"], p["g"], p["b"]), 1)


def raw_road_cells(p: Planes, threshold: int) -> np.ndarray:
    return is_road(p["r"], p["g"], p["b"]) | strong(p["r"], p["g"], p["b"], threshold)


def alphas(active: np.ndarray, core: np.ndarray, ring: int) -> np.ndarray:
    return np.where(core, 255, np.where(active, ring, 0)).astype(np.int32)


def decoded(width: int, n: int, data: bytes) -> Planes:
    """Channels of an image's bytes, blue, green, red and perhaps alpha, row by row; without alpha a pixel is opaque."""
    samples = np.frombuffer(data, np.uint8).reshape(-1, width, n).astype(np.int32)
    return {"a": samples[..., 3] if n == 4 else np.full(samples.shape[:2], 255, np.int32), "r": samples[..., 2], "g": samples[..., 1], "b": samples[..., 0]}


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of batches, one at a time, as each can hold whole images."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}
