"""Bit planes and tiles with halos against planes of numpy, on sizes around words and tiles."""

import numpy as np
import pytest
from model import BG, ORANGE, YELLOW, dilate, erode, frame, pixel_frame, plane, rect
from pyspark.sql import functions as F

from tesselle.config import ClipConfig
from tesselle.operators import contrast, gradient, grid, morphology, packed, planes, region, render, tiled
from tesselle.plans import clip

SIZES = [(1, 1), (3, 63), (5, 64), (4, 65), (2, 130)]


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(tiled, "SIDE", 64)


@pytest.mark.parametrize("size", SIZES)
def test_words_there_and_back(size):
    mask = np.random.default_rng(1).random(size) < 0.5
    words = packed.to_words(mask)
    assert len(words) == size[0] * packed.line_words(size[1]) and (packed.to_plane(words, size[1], size[0]) == mask).all()


@pytest.mark.parametrize("side", [None, 64])
def test_packed_algebra(spark, side):
    rng = np.random.default_rng(7)
    shapes = [*SIZES, (70, 150)]  # one tile and several
    pairs = [(rng.random(s) < 0.5, rng.random(s) < 0.3) for s in shapes]
    a, b = (packed.pack(_frames(spark, [p[k] for p in pairs]).coalesce(2), side).cache() for k in (0, 1))
    expected = {
        packed.union: lambda p, q: p | q,
        packed.intersection: lambda p, q: p & q,
        packed.difference: lambda p, q: p & ~q,
    }
    for operator, model in expected.items():
        made = packed.unpack(operator(a, b)).toPandas()
        for i, (p, q) in enumerate(pairs):
            assert (_plane(made, i) == model(p, q)).all()
    off = packed.complement(a)
    counts = {r.image_id: r.n_active for r in packed.count_active(off).collect()}
    assert counts == {i: int((~p).sum()) for i, (p, _) in enumerate(pairs)}
    assert (_plane(packed.unpack(off).toPandas(), 5) == ~pairs[5][0]).all()
    assert {(r.image_id, r.height, r.width) for r in packed.sizes(a).collect()} == {(i, *s) for i, s in enumerate(shapes)}
    at = spark.createDataFrame([(i, x, y) for i in range(7) for x in (-1, 0, 62, 63, 64, 129, 149, 150) for y in (-1, 0, 1, 69, 70)], "image_id long, x int, y int")
    for r in packed.get(a, at).collect():
        p = pairs[r.image_id][0] if r.image_id < 6 else np.zeros((0, 0), bool)
        assert r.active == bool(0 <= r.x < (p.shape[1] if p.size else 0) and 0 <= r.y < p.shape[0] and p[r.y, r.x])
    for x, y in ((64, 3), (150, 0)):
        for value in (True, False):
            p = pairs[5][0].copy()
            if x < 150:
                p[y, x] = value
            assert (_plane(packed.unpack(packed.set_cell(a, x, y, value, 5)).toPandas(), 5) == p).all()


def _frames(spark, masks):
    rows = [(i, x, y, bool(v)) for i, mask in enumerate(masks) for (y, x), v in np.ndenumerate(mask)]
    return spark.createDataFrame(rows, "image_id long, x int, y int, active boolean")


def _plane(pdf, image_id, column="active"):
    rows = pdf[pdf.image_id == image_id]
    out = np.zeros((rows.y.max() + 1, rows.x.max() + 1), bool)
    out[rows.y, rows.x] = rows[column]
    return out


def test_missing_and_null_cells_are_inactive(spark):
    rows = [(0, 0, 0, True), (0, 70, 0, True), (0, 5, 3, None), (0, 69, 4, True)]
    mask = spark.createDataFrame(rows, "image_id long, x int, y int, active boolean")
    for side in (None, 64):
        got = _plane(packed.unpack(packed.pack(mask, side)).toPandas(), 0)
        assert got.shape == (5, 71) and sorted(zip(*np.nonzero(got), strict=True)) == [(0, 0), (0, 70), (4, 69)]
    with pytest.raises(ValueError):
        packed.pack(mask, 50)
    assert packed.unpack(packed.pack(mask.where("false"))).count() == 0


def test_algebra_runs_on_words_in_the_jvm(spark):
    a, b = (packed.pack(frame(spark, rect(9, 9, (i, 0, 3, 3)))) for i in (0, 2))
    made = packed.count_active(packed.complement(packed.union(a, b)))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Arrow", "Python", "Pandas", "explode")) and made.first().n_active == 81 - 15


def _random(size, seed, share):
    return np.random.default_rng(seed).random(size) < share


@pytest.mark.parametrize("size", [(150, 140)])
def test_tiles_and_planes_agree(spark, small_tiles, size):
    """Every operator on tiles gives what it gives on whole images."""
    rng = np.random.default_rng(size[0])
    colours = np.array([BG, BG, BG, ORANGE, YELLOW, (0, 220, 0), (250, 250, 250), (20, 180, 80)])
    block = lambda n: colours[np.kron(rng.integers(0, 8, (size[0] // n + 1, size[1] // n + 1)), np.ones((n, n), int))[: size[0], : size[1]]]
    shown, over = (pixel_frame(spark, block(n)).repartition(2).cache() for n in (9, 17))
    dense, sparse = (frame(spark, _random(size, 3, share)).cache() for share in (0.97, 0.01))
    config = ClipConfig(snap_distance=5, seed_erosion_radius=3)
    all_of = lambda *c: (*("image_id", "x", "y"), F.struct(*c).alias("active"))
    pairs = {
        "dilate over several tiles": lambda w: morphology.dilate(sparse, 70, wide=w),
        "erode": lambda w: morphology.erode(dense, 2, wide=w),
        "erode without border": lambda w: morphology.erode(dense, 2, border="ignore", wide=w),
        "close": lambda w: morphology.close(dense, 3, wide=w),
        "open": lambda w: morphology.open_(dense, 1, wide=w),
        "rim": lambda w: render.rim(dense, wide=w),
        "or": lambda w: grid.union(dense, sparse, wide=w),
        "sobel": lambda w: gradient.sobel(shown, wide=w).select(*all_of("gx", "gy")),
        "range": lambda w: contrast.local_range(shown, 4, wide=w).select(*all_of("range")),
        "white": lambda w: contrast.white_with_contrast(shown, 2, 20, wide=w),
        "seed": lambda w: region.adaptive_seed(dense, 8, wide=w),
        "seed of each": lambda w: region.adaptive_seed(clip.extract_green(over), 8, wide=w, each=True),
        "components": lambda w: region.components(dense, wide=w).select(*all_of("active", "component")),
        "largest": lambda w: region.largest_component(dense, wide=w),
        "roads": lambda w: clip.detect_roads(shown, config, wide=w),
        "region": lambda w: clip.clip(shown, over, config, wide=w).region,
        "clipped": lambda w: clip.clip(shown, over, config, wide=w).clipped.select(*all_of("a", "r", "g", "b")),
        "rings": lambda w: render.clip_progressive(shown, dense, 3, wide=w).select(*all_of("a", "r", "g", "b")),
    }
    for name, make in pairs.items():
        one, other = (sorted((r.x, r.y, str(r.active)) for r in make(w).collect()) for w in (False, True))
        assert one == other, name


@pytest.mark.parametrize("policy", ["stroke", "largest", "all"])
def test_growth_on_tiles(spark, small_tiles, policy):
    rough = dilate(_random((90, 140), 5, 0.0012), 6)
    barrier = _random((90, 140), 6, 0.12)
    config = ClipConfig(snap_distance=3, seed_erosion_radius=4, seed_policy=policy)
    one, other = (plane(region.snap(frame(spark, rough), frame(spark, barrier), config, wide=w)) for w in (False, True))
    assert (one == other).all() and (one == region.snapped(rough, barrier, config)).all() and one.any()
    outlines = [region.open_outline(frame(spark, one), frame(spark, barrier), wide=w).first().asDict() for w in (False, True)]
    assert outlines[0] == outlines[1]


def test_a_snake_through_many_tiles(spark, small_tiles):
    snake = np.ones((200, 200), bool)
    snake[1::4, :-1] = snake[3::4, 1:] = False
    got = plane(region.components(frame(spark, snake), wide=True), "component")
    assert (got[snake] == 0).all() and (got[~snake] == -1).all()


def test_images_cut_without_pixel_rows(spark, small_tiles):
    from tesselle.sources import images

    picture = np.random.default_rng(2).integers(0, 256, (70, 130, 3))
    pixels = pixel_frame(spark, picture)
    cut = tiled.cut_images(images.gathered(pixels, False))
    assert cut.count() == 6
    rows = lambda df: sorted(map(tuple, df.select("image_id", "x", "y", "a", "r", "g", "b").collect()))
    assert rows(tiled.pixels_of(cut)) == rows(tiled.pixels_of(tiled.picture(pixels))) == rows(pixels)


def test_one_exchange_by_tile_and_no_window_of_an_image(spark, small_tiles):
    rows = spark.createDataFrame([(i, 150, 150) for i in range(3)], "image_id long, width int, height int").repartition("image_id")
    tiles = packed.pack(grid.cells(rows).withColumn("active", F.col("x") > 3), 64).cache()
    made = tiled.on_windows(tiles, lambda p: {"bits": planes.closed(p["bits"], 2)}, ["bits"], {"bits": "boolean"}, 4)
    plan = made._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(image_id" in plan and "x0" in plan and "Window" not in plan


def test_sizes_of_wide_masks_must_agree(spark, small_tiles):
    a, b = frame(spark, rect(70, 70, (3, 3, 50, 50))), frame(spark, rect(80, 70))
    with pytest.raises(Exception, match="sizes differ"):
        grid.union(a, b, wide=True).collect()
    with pytest.raises(Exception, match="sizes differ"):
        region.snap(a, b, ClipConfig(snap_distance=3, seed_erosion_radius=2), wide=True).collect()


# What is done with planes.


@pytest.mark.parametrize("seed", range(20))
def test_distances_rings_and_spread(seed):
    rng = np.random.default_rng(seed)
    mask = rng.random((rng.integers(1, 14), rng.integers(1, 14))) < rng.choice([0.5, 0.9, 1.0])
    assert (planes.distances(mask) == mask + sum(erode(mask, r).astype(int) for r in range(1, 15))).all()
    values = rng.integers(0, 255, mask.shape).astype(np.int32)
    for radius in (0, 1, 2, 5):
        got = planes.spread(values, radius)
        for (y, x), v in np.ndenumerate(got):
            box = values[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1]
            assert v == box.max() - box.min()


def test_strokes(spark):
    """Two strokes on one road: the largest alone loses one of them, each keeps its own larger side."""
    rough = rect(80, 60, (10, 5, 31, 15), (10, 35, 31, 15))
    wall = rect(80, 60, (30, 0, 1, 60))
    config = ClipConfig(snap_distance=4, seed_erosion_radius=4)
    got = plane(region.snap(frame(spark, rough), frame(spark, wall), config))
    assert got[10, 20] and got[40, 20] and not got[10, 35] and not got[40, 35]
    one = plane(region.snap(frame(spark, rough), frame(spark, wall), ClipConfig(snap_distance=4, seed_erosion_radius=4, seed_policy="largest")))
    assert one[10, 20] != one[40, 20] and (one <= got).all()
    # a small stroke beside a large one is eroded by what it can bear
    both = rect(80, 60, (5, 5, 40, 40), (60, 10, 4, 4))
    assert plane(region.adaptive_seed(frame(spark, both), 8, each=True))[11:13, 61:63].all()
    assert not plane(region.adaptive_seed(frame(spark, both), 8))[:, 60:].any()


def test_outline(spark):
    made = region.open_outline(frame(spark, rect(6, 5, (0, 1, 3, 3))), frame(spark, rect(6, 5, (3, 0, 1, 3)))).first()
    # three sides at the image's edge, two at the wall, the rest open
    assert (made.at_edge, made.at_barrier, made.open) == (3, 2, 7) and made.share == 7 / 12
    none = region.open_outline(frame(spark, rect(3, 3)), frame(spark, rect(3, 3))).first()
    assert (none.at_edge, none.at_barrier, none.open, none.share) == (0, 0, 0, 0.0)
