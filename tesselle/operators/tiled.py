"""Images cut into tiles with halos: every operator on images of any size.

A tile sends its neighbours the strips that their windows need, in one exchange by tile; a window is then what an image in one piece is to
an operator on planes, and of what comes out the tile itself is kept. A window ends at the image's edge or so far from its tile that
nothing wrong reaches it. Tiles have the columns of :mod:`~tesselle.operators.packed`, with ``bits`` (a mask) or ``argb`` (four bytes a pixel).

Components are found tile by tile. Their labels are places (y * width + x), unique in an image; where tiles meet, labels of touching cells
are linked, and only these few links are put together for an image.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ClipConfig
from ..schema import KEY, dealt, shared_folder
from .packed import PLACE, TILE, TILE_KINDS, pack, pictures, runs, to_plane, to_words, unpack
from .planes import Planes, dilated, eroded, joined, labels, radii

#: Cells of a tile's side, a multiple of 64, and of a batch of strips or tiles that a task hands on.
SIDE, BATCH_CELLS = 1024, 1 << 18
#: How a made plane is stored: booleans as words, channels as bytes, others as numbers, null where masked.
KINDS = {"boolean": "array<long>", "int": "array<int>", "argb": "binary"}


class Area(NamedTuple):
    """Where a window lies in its image, and the image's size."""

    left: int
    top: int
    right: int
    bottom: int
    width: int
    height: int


# What is done within a task.


def _plane(name: str, value: pa.Scalar, w: int, h: int) -> np.ndarray:
    """A stored plane: (h, w) booleans, or (h, w, 4) bytes."""
    if name == "argb":
        return np.frombuffer(value.as_buffer(), np.uint8).reshape(h, w, 4)
    return to_plane(value.values.to_numpy(zero_copy_only=False), w, h)


def _stored(name: str, planes: list[np.ndarray]) -> pa.Array:
    """Planes as a column, a row each."""
    if name == "argb":
        return pa.array([np.ascontiguousarray(p, np.uint8).tobytes() for p in planes], pa.binary())
    if planes[0].dtype == bool:
        values = [to_words(p) for p in planes]
        flat = pa.array(np.concatenate(values))
    else:
        values = [np.ma.getdata(p).ravel().astype(np.int32) for p in planes]
        hidden = [np.ma.getmaskarray(p).ravel() if isinstance(p, np.ma.MaskedArray) else np.zeros(p.size, bool) for p in planes]
        flat = pa.array(np.concatenate(values), pa.int32(), mask=np.concatenate(hidden))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(v) for v in values]))), pa.int32()), flat)


def _batch(places: list[tuple], names: list[str], planes: dict[str, list[np.ndarray]]) -> pa.RecordBatch:
    """Rows of places, of which the first number is an image's id, and of planes."""
    kinds = [pa.int64()] + [pa.int32()] * (len(names) - 1)
    columns = [pa.array(c, k) for c, k in zip(zip(*places, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*columns, *(_stored(c, p) for c, p in planes.items())], names=[*names, *planes])


def _tile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.RecordBatch, int]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in TILE}, batch, i


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, which follow each other, as a table."""
    waiting, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        new[0] = True
        for first, end in zip(starts := np.flatnonzero(new).tolist(), [*starts[1:], batch.num_rows], strict=True):
            if waiting and (first or last != tuple(c[0] for c in columns)):
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(first, end - first))
        last = tuple(c[-1] for c in columns)
    if waiting:
        yield pa.Table.from_batches(waiting)


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str], function: Callable) -> Iterator[pa.RecordBatch]:
    yield from function(_groups(batches, keys))


def in_groups(df: DataFrame, keys: list[str], function: Callable[[Iterator[pa.Table]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``function`` makes of the rows of each key, one after the other: many small groups cost a task little more than their rows."""
    return dealt(df, *keys).sortWithinPartitions(*keys).mapInArrow(partial(_grouped, keys=keys, function=function), schema)


def by_tile(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Both by the place of tiles. Tiles are neither sent to all machines nor put in few tasks, however few bytes they are thought to be."""
    return dealt(a, *PLACE).join(dealt(b, *PLACE).hint("merge"), list(PLACE), how)


def _strips(batches: Iterator[pa.RecordBatch], columns: list[str], side: int, halo: int) -> Iterator[pa.RecordBatch]:
    """Each tile itself, and for each tile near it the part of it that lies in that one's window."""
    reach, names = -(-halo // side), [*TILE, "px", "py", "pw", "ph"]
    places, cut, size = [], {c: [] for c in columns}, 0
    for tile, batch, row in _tile_rows(batches):
        planes = {c: _plane(c, batch.column(c)[row], tile["w"], tile["h"]) for c in columns}
        x0, y0, x1, y1 = tile["x0"], tile["y0"], tile["x0"] + tile["w"], tile["y0"] + tile["h"]
        for dy in range(-reach, reach + 1):
            for dx in range(-reach, reach + 1):
                tx, ty = x0 + dx * side, y0 + dy * side
                if not (0 <= tx < tile["width"] and 0 <= ty < tile["height"]):
                    continue
                left, right = max(x0, tx - halo), min(x1, tx + side + halo)
                top, bottom = max(y0, ty - halo), min(y1, ty + side + halo)
                if left >= right or top >= bottom:
                    continue
                places.append((tile["image_id"], tile["width"], tile["height"], tx, ty, min(side, tile["width"] - tx), min(side, tile["height"] - ty), left, top, right - left, bottom - top))
                for c in columns:
                    cut[c].append(planes[c][top - y0 : bottom - y0, left - x0 : right - x0])
                size += (right - left) * (bottom - top)
        if size > BATCH_CELLS:
            yield _batch(places, names, cut)
            places, cut, size = [], {c: [] for c in columns}, 0
    if places:
        yield _batch(places, names, cut)


def _window(rows: pa.Table, columns: list[str], side: int, halo: int) -> tuple[dict, Area, Planes]:
    """The window of a tile, put together of its strips."""
    tile = {c: rows.column(c)[0].as_py() for c in TILE}
    area = Area(max(tile["x0"] - halo, 0), max(tile["y0"] - halo, 0), min(tile["x0"] + side + halo, tile["width"]), min(tile["y0"] + side + halo, tile["height"]), tile["width"], tile["height"])
    shape = (area.bottom - area.top, area.right - area.left)
    planes = {c: np.zeros((*shape, 4), np.uint8) if c == "argb" else np.zeros(shape, bool) for c in columns}
    for i in range(rows.num_rows):
        px, py, pw, ph = (rows.column(c)[i].as_py() for c in ("px", "py", "pw", "ph"))
        for c in columns:
            if (value := rows.column(c)[i]).is_valid:
                planes[c][py - area.top : py - area.top + ph, px - area.left : px - area.left + pw] = _plane(c, value, pw, ph)
    return tile, area, planes


def channels(planes: Planes) -> Planes:
    """``argb`` as the four planes of numbers that operators take, beside the other planes."""
    out = {c: p for c, p in planes.items() if c != "argb"}
    if "argb" in planes:
        out |= {c: planes["argb"][..., i].astype(np.int32) for i, c in enumerate("argb")}
    return out


def _batches(tiles: Iterator[tuple[dict, Planes]], made: list[str]) -> Iterator[pa.RecordBatch]:
    """Tiles with their planes ``made``, several in a batch."""
    places, planes, size = [], {c: [] for c in made}, 0
    for tile, found in tiles:
        places.append(tuple(tile.values()))
        for c in made:
            planes[c].append(found[c])
        size += tile["w"] * tile["h"]
        if size > BATCH_CELLS:
            yield _batch(places, list(TILE), planes)
            places, planes, size = [], {c: [] for c in made}, 0
    if places:
        yield _batch(places, list(TILE), planes)


def _windows(groups: Iterator[pa.Table], function: Callable, columns: list[str], made: dict[str, str], side: int, halo: int) -> Iterator[pa.RecordBatch]:
    def cut() -> Iterator[tuple[dict, Planes]]:
        for rows in groups:
            tile, area, planes = _window(rows, columns, side, halo)
            left, top = tile["x0"] - area.left, tile["y0"] - area.top
            found = function(channels(planes))
            yield tile, {c: found[c][top : top + tile["h"], left : left + tile["w"]] for c in made}

    yield from _batches(cut(), list(made))


def _one_tile(batches: Iterator[pa.RecordBatch], function: Callable, columns: list[str], made: dict[str, str]) -> Iterator[pa.RecordBatch]:
    whole = lambda tile, batch, row: channels({c: _plane(c, batch.column(c)[row], tile["w"], tile["h"]) for c in columns})
    yield from _batches(((tile, function(whole(tile, batch, row))) for tile, batch, row in _tile_rows(batches)), list(made))


# Tiles.


def _kind(columns: list[str]) -> str:
    return "".join(f", {c} {KINDS['argb' if c == 'argb' else 'boolean']}" for c in columns)


def on_windows(tiles: DataFrame, function: Callable[[Planes], Planes], columns: list[str], made: dict[str, str], halo: int, side: int | None = None) -> DataFrame:
    """Tiles with the planes ``made`` (name and kind) of what ``function`` makes of windows that reach ``halo`` cells beyond their tile.

    One exchange, by tile; with a halo of 0 none.
    """
    side = side or SIDE
    schema = TILE_KINDS + "".join(f", {c} {KINDS[k]}" for c, k in made.items())
    given = tiles.select(*TILE, *columns)
    if halo <= 0:
        return given.mapInArrow(partial(_one_tile, function=function, columns=columns, made=made), schema)
    strips = given.mapInArrow(partial(_strips, columns=columns, side=side, halo=halo), f"{TILE_KINDS}, px int, py int, pw int, ph int{_kind(columns)}")
    return in_groups(strips, list(PLACE), partial(_windows, function=function, columns=columns, made=made, side=side, halo=halo), schema)


def _drawn(batches: Iterator[pa.RecordBatch], side: int) -> Iterator[pa.RecordBatch]:
    def drawn() -> Iterator[tuple[dict, Planes]]:
        for batch in batches:
            for row, found in enumerate(pictures(batch)):
                tile = {c: batch.column(c)[row].as_py() for c in ("image_id", "width", "height", "x0", "y0")}
                tile |= {"w": min(side, tile["width"] - tile["x0"]), "h": min(side, tile["height"] - tile["y0"])}
                argb = np.zeros((tile["h"], tile["w"], 4), np.uint8)
                argb[: found.shape[0], : found.shape[1]] = found
                yield tile, {"argb": argb}

    yield from _batches(drawn(), ["argb"])


def picture(pixels: DataFrame, side: int | None = None) -> DataFrame:
    """Dense pixels as tiles with ``argb``."""
    side = side or SIDE
    size = pixels.groupBy("image_id").agg((F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"))
    cut = runs(pixels, side).join(size, "image_id").select("image_id", "width", "height", "x0", "y0", "right", "bottom", "runs")
    return cut.mapInArrow(partial(_drawn, side=side), f"{TILE_KINDS}, argb binary")


def _cut(batches: Iterator[pa.RecordBatch], side: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            image_id, width, height, n = (batch.column(c)[i].as_py() for c in ("image_id", "width", "height", "n_channels"))
            samples = np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8).reshape(height, width, n)
            for y0 in range(0, height, side):
                for x0 in range(0, width, side):
                    part = samples[y0 : y0 + side, x0 : x0 + side]
                    argb = np.concatenate([part[..., 3:] if n == 4 else np.full((*part.shape[:2], 1), 255, np.uint8), part[..., 2::-1]], 2)
                    place = (image_id, width, height, x0, y0, part.shape[1], part.shape[0])
                    yield _batch([place], list(TILE), {"argb": [argb]})


def cut_images(images: DataFrame, side: int | None = None) -> DataFrame:
    """``images`` as tiles with ``argb``; no row of a pixel is made."""
    return images.select("image_id", "width", "height", "n_channels", "data").mapInArrow(partial(_cut, side=side or SIDE), f"{TILE_KINDS}, argb binary")


def _pixels(planes: Planes) -> Planes:
    return {c: planes[c] for c in "argb"}


def pixels_of(tiles: DataFrame) -> DataFrame:
    """The pixels of tiles with ``argb``."""
    return unpack(on_windows(tiles, _pixels, ["argb"], dict.fromkeys("rgb", "int") | {"a": "int"}, 0), dict(zip("argb", "argb", strict=True)))


def masks(mask: DataFrame, side: int | None = None) -> DataFrame:
    return pack(mask, side or SIDE)


# Components.

_PARTS = f"{TILE_KINDS}, labels array<long>, counts array<long>, axis array<int>, line array<int>, at array<int>, label array<long>"


def global_labels(plane: np.ndarray, tile: dict) -> np.ndarray:
    """Components of a tile, each labelled by the place in the image of its first cell, line by line; -1 off the mask."""
    found = labels(plane)
    w = plane.shape[1]
    place = (found // w + tile["y0"]) * tile["width"] + found % w + tile["x0"]
    return np.where(found < 0, -1, place)


def _part_rows(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of places and of six lists."""
    lists = []
    for i in range(len(TILE), len(TILE) + 6):
        values = [row[i] for row in rows]
        lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(v) for v in values]))), pa.int32()), pa.array(np.concatenate(values))))
    places = [pa.array([row[i] for row in rows], pa.int64() if i == 0 else pa.int32()) for i in range(len(TILE))]
    return pa.RecordBatch.from_arrays([*places, *lists], names=[*TILE, "labels", "counts", "axis", "line", "at", "label"])


def _parts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for tile, batch, row in _tile_rows(batches):
        found = global_labels(_plane(column, batch.column(column)[row], tile["w"], tile["h"]), tile)
        names, counts = np.unique(found[found >= 0], return_counts=True)
        edges = []
        for axis, line, cells, first in (
            (0, tile["x0"], found[:, 0], tile["y0"]),
            (0, tile["x0"] + tile["w"], found[:, -1], tile["y0"]),
            (1, tile["y0"], found[0], tile["x0"]),
            (1, tile["y0"] + tile["h"], found[-1], tile["x0"]),
        ):
            if 0 < line < tile["width" if axis == 0 else "height"]:
                on = np.flatnonzero(cells >= 0)
                edges.append(np.stack([np.full(len(on), axis), np.full(len(on), line), on + first, cells[on]]))
        axis, line, at, label = np.concatenate(edges, 1) if edges else np.zeros((4, 0), np.int64)
        rows.append((*tile.values(), names, counts, axis.astype(np.int32), line.astype(np.int32), at.astype(np.int32), label))
        size += tile["w"] * tile["h"]
        if size > BATCH_CELLS:
            yield _part_rows(rows)
            rows, size = [], 0
    if rows:
        yield _part_rows(rows)


def _united(groups: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    """The smallest label that each linked label of an image is connected with."""
    for rows in groups:
        a, b = (rows.column(c).to_numpy() for c in ("a", "b"))
        names, where = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = joined(len(names), where[: len(a)], where[len(a) :])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), rows.column("image_id")[0].as_py(), np.int64)), pa.array(names), pa.array(names[root])], names=["image_id", "label", "root"])


def written(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def components(tiles: DataFrame, column: str = "bits") -> DataFrame:
    """image_id, x0, y0, label, root and n: the parts of components that lie in each tile, with the component's smallest place and the part's cells."""
    parts = written(tiles.select(*TILE, column).mapInArrow(partial(_parts, column=column), _PARTS))
    edge = parts.select("image_id", F.explode(F.arrays_zip("axis", "line", "at", "label")).alias("e")).select("image_id", "e.*")
    # of two touching cells one lies on either side of the line
    met = edge.groupBy("image_id", "axis", "line", "at").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("n"))
    links = met.where("n = 2 and a != b").select("image_id", "a", "b").distinct()
    roots = in_groups(links, ["image_id"], _united, "image_id long, label long, root long")
    own = parts.select(*PLACE, F.explode(F.arrays_zip("labels", "counts")).alias("e")).select(*PLACE, F.col("e.labels").alias("label"), F.col("e.counts").alias("n"))
    return own.join(roots.hint("merge"), ["image_id", "label"], "left").select(*PLACE, "label", F.coalesce("root", "label").alias("root"), "n")


def _roots(found: np.ndarray, label: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The root of each cell, line by line; -1 where inactive."""
    flat, order = found.ravel(), np.argsort(label)
    on = flat >= 0
    values = np.full(len(flat), -1, np.int64)
    values[on] = root[order][np.searchsorted(label[order], flat[on])]
    return values


def _chosen(found: np.ndarray, label: np.ndarray, root: np.ndarray) -> np.ndarray:
    return to_words(np.isin(found, label))


def _named(batches: Iterator[pa.RecordBatch], column: str, function: Callable, made: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 64):
            part, values = batch.slice(first, 64), []
            for tile, _, row in _tile_rows([part]):
                found = global_labels(_plane(column, part.column(column)[row], tile["w"], tile["h"]), tile)
                label, root = (np.zeros(0, np.int64) if part.column(c)[row].values is None else part.column(c)[row].values.to_numpy() for c in ("__label", "__root"))
                values.append(function(found, label, root))
            flat = np.concatenate(values)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(v) for v in values]))), pa.int32()), pa.array(flat, pa.int64(), mask=flat < 0 if function is _roots else None))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in TILE), lists], names=[*TILE, made])


def _with_names(tiles: DataFrame, names: DataFrame, column: str, function: Callable, made: str, kind: str) -> DataFrame:
    """Tiles with what ``function`` makes of the labels of ``column`` and of the names that each tile has."""
    own = dealt(names.select(*PLACE, "label", "root"), *PLACE).groupBy(*PLACE).agg(F.collect_list(F.struct("label", "root")).alias("__names"))
    both = dealt(tiles.select(*TILE, column), *PLACE).join(own.hint("merge"), list(PLACE), "left")
    return both.select(*TILE, column, F.col("__names.label").alias("__label"), F.col("__names.root").alias("__root")).mapInArrow(partial(_named, column=column, function=function, made=made), f"{TILE_KINDS}, {made} {kind}")


def component_cells(tiles: DataFrame) -> DataFrame:
    """Cells with active and component, the smallest place of the cell's component, null where inactive."""
    tiles = written(tiles)
    named = _with_names(tiles, components(tiles), "bits", _roots, "roots", "array<long>")
    lines = named.select("image_id", "x0", "y0", "w", F.posexplode("roots").alias("i", "component"))
    return lines.select("image_id", (F.col("x0") + F.col("i") % F.col("w")).cast("int").alias("x"), (F.col("y0") + F.expr("i div w")).cast("int").alias("y"), F.col("component").isNotNull().alias("active"), "component")


def selected(tiles: DataFrame, names: DataFrame, column: str = "bits") -> DataFrame:
    """Tiles with ``bits``: the parts of components of ``column`` that ``names`` (image_id, x0, y0, label) lists."""
    return _with_names(tiles, names.withColumn("root", F.col("label")), column, _chosen, "bits", "array<long>")


def largest(tiles: DataFrame) -> DataFrame:
    """Each image's largest component alone; of equal ones, the one with the smallest place."""
    tiles = written(tiles)
    parts = written(components(tiles))
    best = parts.groupBy("image_id", "root").agg(F.sum("n").alias("n")).groupBy("image_id").agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("root"))
    return selected(tiles, parts.join(best.hint("merge"), ["image_id", "root"], "left_semi"))


# Growth.


def _tried(planes: Planes, tried: list[int], border: str, distance: int) -> Planes:
    mask = planes["bits"]
    return {f"e{r}": eroded(mask, r, border) for r in tried} | {"allowed": dilated(mask, distance), "bits": mask}


def seeds(tiles: DataFrame, radius: int, distance: int = 0, border: str = "inactive", each: bool = False, side: int | None = None) -> DataFrame:
    """Tiles with bits, allowed (dilated by ``distance``) and seed: eroded by the largest of :func:`radii` that leaves a cell of the image, or unchanged
    if none does. With ``each`` that radius is found for each component by itself.

    All radii are tried in the windows of one exchange; what they leave is told by a few numbers for each tile.
    """
    tried = radii(radius)
    made = {"bits": "boolean", "allowed": "boolean"} | {f"e{r}": "boolean" for r in tried}
    out = written(on_windows(tiles, partial(_tried, tried=tried, border=border, distance=distance), ["bits"], made, max([distance, *tried]), side))
    if each:
        return _seeds_of_each(out, tried)
    left = lambda r: F.exists(F.col(f"e{r}"), lambda word: word != 0)
    flags = out.groupBy("image_id").agg(*(F.max(left(r)).alias(f"any{r}") for r in tried)) if tried else None
    seed = F.col("bits")
    for r in reversed(tried):
        seed = F.when(F.col(f"any{r}"), F.col(f"e{r}")).otherwise(seed)
    return (out.join(flags, "image_id") if tried else out).select(*TILE, "bits", "allowed", seed.alias("seed"))


def _held(batches: Iterator[pa.RecordBatch], column: str, others: list[str]) -> Iterator[pa.RecordBatch]:
    """For each part of a tile, how many cells of every other mask it holds."""
    for tile, batch, row in _tile_rows(batches):
        found = global_labels(_plane(column, batch.column(column)[row], tile["w"], tile["h"]), tile)
        names, where = np.unique(found, return_inverse=True)
        where = where.reshape(found.shape)
        counts = [np.bincount(where[_plane(c, batch.column(c)[row], tile["w"], tile["h"])], minlength=len(names)) for c in others]
        real = names >= 0
        n = int(real.sum())
        yield pa.RecordBatch.from_arrays([*(pa.array([tile[c]] * n, k) for c, k in zip(PLACE, (pa.int64(), pa.int32(), pa.int32()), strict=True)), pa.array(names[real]), *(pa.array(c[real].astype(np.int64)) for c in counts)], names=[*PLACE, "label", *others])


def held(tiles: DataFrame, column: str, others: list[str]) -> DataFrame:
    return tiles.select(*TILE, column, *others).mapInArrow(partial(_held, column=column, others=others), "image_id long, x0 int, y0 int, label long" + "".join(f", {c} long" for c in others))


def _seeds_of_each(tiles: DataFrame, tried: list[int]) -> DataFrame:
    parts = written(components(tiles))
    inside = parts.join(held(tiles, "bits", [f"e{r}" for r in tried]).hint("merge"), [*PLACE, "label"])
    totals = inside.groupBy("image_id", "root").agg(*(F.sum(f"e{r}").alias(f"e{r}") for r in tried)) if tried else parts.select("image_id", "root").distinct()
    chosen = reduce(lambda rest, r: F.when(F.col(f"e{r}") > 0, r).otherwise(rest), reversed(tried), F.lit(0))
    radius = written(parts.join(totals.select("image_id", "root", chosen.alias("radius")).hint("merge"), ["image_id", "root"]))
    out = dealt(tiles, *PLACE).withColumn("__none", F.transform("bits", lambda word: F.lit(0).cast("long")))
    seed = F.col("__none")
    for r in [*tried, 0]:  # of the parts with that radius, what it leaves
        of = selected(tiles, radius.where(F.col("radius") == r)).select(*PLACE, F.col("bits").alias(f"__of{r}"))
        out = out.join(dealt(of, *PLACE).hint("merge"), list(PLACE))
        here = F.zip_with(F.col(f"e{r}") if r else F.col("bits"), f"__of{r}", lambda p, q: p.bitwiseAND(q))
        seed = F.zip_with(seed, here, lambda p, q: p.bitwiseOR(q))
    return out.select(*TILE, "bits", "allowed", seed.alias("seed"))


def snap(rough: DataFrame, barrier: DataFrame, config: ClipConfig, side: int | None = None) -> DataFrame:
    """The rough selection grown from its core to the barrier, no farther than the snap distance, as tiles with ``bits`` and ``allowed``; what the barrier
    does not have is free."""
    each = config.seed_policy == "stroke"
    zones = seeds(rough, config.seed_erosion_radius, config.snap_distance, config.border, each, side)
    walls = barrier.select(*PLACE, F.col("w").alias("__w"), F.col("h").alias("__h"), F.col("bits").alias("__wall"))
    apart = F.raise_error(F.concat(F.lit("sizes differ in image "), F.col("image_id").cast("string"))).cast("array<long>")
    unwalled = F.when(F.col("__wall").isNull(), F.transform("bits", lambda word: F.lit(0).cast("long"))).when(F.expr("w != __w or h != __h"), apart).otherwise(F.col("__wall"))
    both = by_tile(zones, walls, "left").withColumn("wall", unwalled)
    free = lambda c: F.zip_with(c, "wall", lambda p, q: p.bitwiseAND(F.bitwise_not(q)))
    both = written(both.select(*TILE, F.col("bits").alias("rough"), "allowed", free("allowed").alias("free"), free("seed").alias("start")))
    grounds = written(components(both, "free"))
    if config.seed_policy == "all":
        starts = held(both, "free", ["start"]).where("start > 0")
    else:
        parts = written(components(both, "start"))
        sizes = parts.groupBy("image_id", "root").agg(F.sum("n").alias("n"))
        if each:  # of each stroke the largest part of its seed
            strokes = components(both, "rough").select(*PLACE, F.col("label").alias("stroke_label"), F.col("root").alias("stroke"))
            lies = _lying(both, "start", "rough").join(strokes.hint("merge"), [*PLACE, "stroke_label"]).join(parts.hint("merge"), [*PLACE, "label"]).select("image_id", "stroke", "root").distinct()
            best = lies.join(sizes.hint("merge"), ["image_id", "root"]).groupBy("image_id", "stroke").agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("root")).select("image_id", "root")
        else:
            best = sizes.groupBy("image_id").agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("root"))
        seed = selected(both, parts.join(best.hint("merge"), ["image_id", "root"], "left_semi"), "start").select(*PLACE, F.col("bits").alias("seed"))
        starts = held(by_tile(both, seed), "free", ["seed"]).where("seed > 0")
    reached = grounds.join(starts.hint("merge"), [*PLACE, "label"], "left_semi").select("image_id", "root").distinct()
    grown = selected(both, grounds.join(reached.hint("merge"), ["image_id", "root"], "left_semi"), "free")
    return by_tile(grown, both.select(*PLACE, "allowed"))


def _lie(batches: Iterator[pa.RecordBatch], inner: str, outer: str) -> Iterator[pa.RecordBatch]:
    for tile, batch, row in _tile_rows(batches):
        a, b = (global_labels(_plane(c, batch.column(c)[row], tile["w"], tile["h"]), tile) for c in (inner, outer))
        pairs = np.unique(np.stack([a[(a >= 0) & (b >= 0)], b[(a >= 0) & (b >= 0)]], 1), axis=0)
        yield pa.RecordBatch.from_arrays([*(pa.array([tile[c]] * len(pairs), k) for c, k in zip(PLACE, (pa.int64(), pa.int32(), pa.int32()), strict=True)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=[*PLACE, "label", "stroke_label"])


def _lying(tiles: DataFrame, inner: str, outer: str) -> DataFrame:
    """Which part of ``outer`` each part of ``inner`` lies in, tile by tile: the overlap table of their components."""
    return tiles.select(*TILE, inner, outer).mapInArrow(partial(_lie, inner=inner, outer=outer), "image_id long, x0 int, y0 int, label long, stroke_label long")
