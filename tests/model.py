"""A plain numpy model of the raster algebra, a picture at a time, and helpers to move pictures in and out of Spark."""

import numpy as np

BG, ORANGE, YELLOW = (230, 226, 219), (245, 165, 100), (250, 230, 140)


def rect(width, height, *boxes, picture=None):
    """A mask, or a picture, with boxes (x, y, w, h[, colour]) filled in turn."""
    out = np.zeros((height, width), bool) if picture is None else np.full((height, width, 3), picture, np.int32)
    for x, y, w, h, *colour in boxes:
        out[y : y + h, x : x + w] = colour[0] if colour else True
    return out


def frame(spark, mask, image_id=0):
    rows = [(image_id, x, y, bool(mask[y, x])) for y in range(mask.shape[0]) for x in range(mask.shape[1])]
    return spark.createDataFrame(rows, "image_id long, x int, y int, active boolean")


def pixel_frame(spark, picture, image_id=0, alpha=255):
    rows = [(image_id, x, y, alpha, *map(int, picture[y, x])) for y in range(picture.shape[0]) for x in range(picture.shape[1])]
    return spark.createDataFrame(rows, "image_id long, x int, y int, a int, r int, g int, b int")


def plane(df, column="active", image_id=0):
    rows = [r for r in df.collect() if r.image_id == image_id]
    out = np.zeros((max(r.y for r in rows) + 1, max(r.x for r in rows) + 1), type(rows[0][column] or 0))
    for r in rows:
        out[r.y, r.x] = r[column] if r[column] is not None else -1
    return out


def dilate(m, r):
    out = np.zeros_like(m)
    for y, x in zip(*np.nonzero(m), strict=True):
        out[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1] = True
    return out


def erode(m, r, ignore=False):
    out = np.zeros_like(m)
    for y in range(m.shape[0]):
        for x in range(m.shape[1]):
            if ignore or (y >= r and x >= r and y + r < m.shape[0] and x + r < m.shape[1]):
                out[y, x] = m[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].all()
    return out


def flood(free, starts):
    out, todo = np.zeros_like(free), [p for p in starts if free[p]]
    while todo:
        y, x = todo.pop()
        if 0 <= y < free.shape[0] and 0 <= x < free.shape[1] and free[y, x] and not out[y, x]:
            out[y, x] = True
            todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return out


def snap(rough, barrier, distance, radius, policy):
    seed, r = rough, radius
    while r > 0:
        if erode(rough, r).any():
            seed = erode(rough, r)
            break
        r //= 2
    seed = seed & ~barrier
    if policy == "largest" and seed.any():
        best = None
        left = seed.copy()
        for y, x in zip(*np.nonzero(seed), strict=True):
            if left[y, x]:
                part = flood(seed, [(y, x)])
                left &= ~part
                if best is None or part.sum() > best.sum():
                    best = part
        seed = best
    return flood(dilate(rough, distance) & ~barrier, list(zip(*np.nonzero(seed), strict=True)))
