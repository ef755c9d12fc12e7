"""Image files to pixels and back."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import compared
from ..operators.packed import pictures, runs
from ..schema import IMAGES, PIXELS
from .sink import write_files

#: Pixels of one record batch.
BATCH = 1 << 18


def scan(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``images`` of the image files at a path. A file that cannot be read or decoded raises when it is reached.

    Samples of files of one channel are linear greys, and become the levels of three equal channels that such a grey is shown with.
    """
    if not path:
        raise ValueError("a path is needed")
    raw = spark.read.format("image").load(path).select("image.*")
    bad = lambda why: F.raise_error(F.concat(F.lit(f"{why}: "), F.col("origin")))
    checked = F.when(F.col("width") <= 0, bad("not an image")).when(~F.col("nChannels").isin(1, 3, 4), bad("only one, three or four channels are read")).otherwise(F.col("data"))
    found = raw.select(F.xxhash64("origin").alias("image_id"), "origin", "width", "height", F.col("nChannels").alias("n_channels"), checked.alias("data"))
    return found.mapInArrow(_coloured, IMAGES)


def grey_level(sample: int) -> int:
    """The level of each channel that a linear grey of 8 bits is shown with: the transfer curve of sRGB (fixed values)."""
    v = sample / 255
    return int(255 * (12.92 * v if v <= 0.0031308 else 1.055 * v ** (1 / 2.4) - 0.055) + 0.5)


GREYS = np.array([grey_level(v) for v in range(256)], np.uint8)


def _coloured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Images of one channel as such of three."""
    for batch in batches:
        grey = [n == 1 for n in batch.column("n_channels").to_pylist()]
        if not any(grey):
            yield batch
            continue
        for i, is_grey in enumerate(grey):
            row = batch.slice(i, 1)
            if is_grey:
                data = np.repeat(GREYS[np.frombuffer(row.column("data")[0].as_buffer(), np.uint8)], 3).tobytes()
                columns = [pa.array([3], pa.int32()) if n == "n_channels" else pa.array([data], pa.binary()) if n == "data" else row.column(n) for n in row.schema.names]
                row = pa.RecordBatch.from_arrays(columns, names=row.schema.names)
            yield row


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for image_id, width, n, data in zip(*(batch.column(c) for c in ("image_id", "width", "n_channels", "data")), strict=True):
            width, n = width.as_py(), n.as_py()
            samples = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, n)  # blue, green, red and perhaps alpha
            for at in range(0, len(samples), BATCH):
                part = samples[at : at + BATCH].astype(np.int32)
                place = np.arange(at, at + len(part))
                alpha = part[:, 3] if n == 4 else np.full(len(part), 255, np.int32)
                columns = [np.full(len(part), image_id.as_py(), np.int64), (place % width).astype(np.int32), (place // width).astype(np.int32), alpha, part[:, 2], part[:, 1], part[:, 0]]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["image_id", "x", "y", "a", "r", "g", "b"])


def pixels(images: DataFrame) -> DataFrame:
    """A row for each pixel of ``images``; without alpha a pixel is opaque."""
    return images.select("image_id", "width", "n_channels", "data").mapInArrow(_decode, PIXELS)


def check_same_size(images: DataFrame, others: DataFrame) -> None:
    """Raises where an image and the other of its id differ in size, or one has no other; names both sizes."""
    bad = compared(images, others).where("not same").first()
    if bad is not None:
        raise ValueError(f"sizes differ: {bad.width}x{bad.height} and {bad.other_width}x{bad.other_height}")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(samples: np.ndarray) -> bytes:
    """A PNG of 8-bit samples of shape (height, width, 1, 3 or 4)."""
    height, width, n = samples.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), samples.astype(np.uint8).reshape(height, width * n)], 1)
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


#: The columns that a picture is made of.
_RUNS = ("x0", "y0", "right", "bottom", "runs")


def _samples(rows: pa.RecordBatch, channels: str) -> Iterator[np.ndarray]:
    """Samples of rows of :func:`~tesselle.operators.packed.runs`."""
    chosen = ["argb".index(c) for c in channels]
    return (picture[..., chosen] for picture in pictures(rows))


def encode(pixels: DataFrame, alpha: bool = True, channels: str | None = None) -> DataFrame:
    """(image_id, png) of dense pixels, an image in a task: of four channels or three, or of those named (one is written as grey samples).

    The PNG is a column by itself: who takes the ids alone has nothing encoded.
    """
    channels = channels or ("rgba" if alpha else "rgb")

    @F.arrow_udf("binary")
    def encoded(*columns: pa.Array) -> pa.Array:
        return pa.array([png(samples) for samples in _samples(pa.RecordBatch.from_arrays(list(columns), names=list(_RUNS)), channels)], pa.binary())

    return runs(pixels).select("image_id", encoded(*_RUNS).alias("png"))


_IMAGES = pa.schema([("image_id", pa.int64()), ("origin", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("n_channels", pa.int32()), ("data", pa.binary())])


def _raws(batches: Iterator[pa.RecordBatch], channels: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for image_id, samples in zip(batch.column("image_id").to_pylist(), _samples(batch, channels), strict=True):
            values = (image_id, None, samples.shape[1], samples.shape[0], samples.shape[2], samples.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _IMAGES, strict=True)], schema=_IMAGES)


def gathered(pixels: DataFrame, alpha: bool = True) -> DataFrame:
    """``images`` of dense pixels, an image in a task; their origin is null."""
    return runs(pixels).mapInArrow(partial(_raws, channels="bgra" if alpha else "bgr"), IMAGES)


def save(encoded: DataFrame, base: str, name=None) -> DataFrame:
    """Writes each PNG under ``base`` (a URI or an absolute path that all machines share), by default as its id: all of them or none.
    Gives (image_id, name) of what was written."""
    named = encoded.withColumn("name", name if name is not None else F.concat(F.col("image_id").cast("string"), F.lit(".png")))
    write_files(named.select("name", F.col("png").alias("content")), base)
    return named.select("image_id", "name")


def save_pair(made: DataFrame, places: list[tuple[str, str, str]]) -> None:
    """Writes columns of PNGs of one row, each (column, folder, name) to its place. Files of one folder appear together, or none of them."""
    for folder in dict.fromkeys(folder for _, folder, _ in places):
        here = [F.struct(F.lit(name).alias("name"), F.col(column).alias("content")) for column, to, name in places if to == folder]
        write_files(made.select(F.inline(F.array(*here))), folder)
