"""Scenes with known counts, and random masks against the numpy model."""

import numpy as np
import pytest
from model import BG, ORANGE, YELLOW, dilate, erode, frame, pixel_frame, plane, rect, snap
from pyspark.sql import functions as F

from tesselle.config import ClipConfig
from tesselle.functions import color
from tesselle.operators import gradient, grid, morphology, planes, region, render
from tesselle.plans import clip


def test_config():
    c = ClipConfig()
    assert (c.snap_distance, c.road_sensitivity, c.smooth_radius, c.seed_erosion_radius, c.closing_radius) == (40, 1.0, 1, 8, 2)
    for bad in ({"snap_distance": 0}, {"road_sensitivity": 0}, {"smooth_radius": -1}, {"seed_erosion_radius": -1}, {"closing_radius": -1}, {"seed_policy": "x"}, {"border": "x"}):
        with pytest.raises(ValueError):
            ClipConfig(**bad)


def test_mask_points_and_counts(spark):
    empty = grid.blank(spark, 10, 20)
    assert grid.count_active(empty).first().n_active == 0 and empty.count() == 200
    one = grid.set_cell(grid.blank(spark, 5, 5), 2, 3, True)
    assert grid.count_active(one).first().n_active == 1
    assert grid.count_active(grid.set_cell(one, 2, 3, False)).first().n_active == 0
    assert grid.count_active(grid.set_cell(one, 9, 9, True)).first().n_active == 1
    points = spark.createDataFrame([(0, 2, 3), (0, -1, 0), (0, 5, 5)], "image_id long, x int, y int")
    assert {(r.x, r.y): r.active for r in grid.get(one, points).collect()} == {(2, 3): True, (-1, 0): False, (5, 5): False}
    for size in ((0, 10), (10, -5)):
        with pytest.raises(ValueError):
            grid.blank(spark, *size)
    with pytest.raises(ValueError):
        grid.wrap(spark, 2, 2, [True])


def test_mask_algebra(spark):
    a, b = grid.wrap(spark, 2, 2, [1, 1, 0, 0]), grid.wrap(spark, 2, 2, [0, 1, 0, 1])
    n = lambda m: grid.count_active(m).first().n_active
    assert (n(grid.union(a, b)), n(grid.intersection(a, b)), n(grid.complement(a)), n(grid.difference(a, b))) == (3, 1, 2, 1)
    grid.check_same_size(a, b)
    other = grid.wrap(spark, 3, 1, [0, 0, 0])
    with pytest.raises(ValueError, match="2x2 and 3x1"):
        grid.check_same_size(a, other)
    for operator in (grid.union, grid.intersection, grid.difference):
        assert plane(operator(a, b, wide=True)).tolist() == plane(operator(a, b)).tolist()
        with pytest.raises(Exception, match="sizes differ: 2x2 and 3x1"):
            operator(a, other).collect()
        with pytest.raises(Exception, match="sizes differ"):
            operator(a, other, wide=True).collect()
        for lone in (a.limit(0), grid.wrap(spark, 2, 2, [0, 0, 0, 0], image_id=5)):
            with pytest.raises(Exception, match="sizes differ"):
                operator(a, lone).collect()


@pytest.mark.parametrize(
    ("mask", "operator", "count"),
    [
        (rect(7, 7, (3, 3, 1, 1)), lambda m: morphology.dilate(m, 1), 9),
        (rect(7, 7, (2, 2, 3, 3)), lambda m: morphology.erode(m, 1), 1),
        (rect(10, 10, (0, 5, 4, 1), (6, 5, 4, 1)), lambda m: morphology.close(m, 2), 6),
        (rect(10, 10, (1, 1, 1, 1), (4, 4, 4, 4)), lambda m: morphology.open_(m, 1), 16),
        (rect(7, 7, (3, 3, 1, 1)), lambda m: morphology.erode(morphology.dilate(m, 0), -1), 1),
    ],
)
def test_morphology_scenes(spark, mask, operator, count):
    assert plane(operator(frame(spark, mask))).sum() == count


@pytest.mark.parametrize("radius", [1, 3, 5, 12])
def test_morphology_against_model(spark, radius):
    mask = np.random.default_rng(radius).random((17, 23)) < (0.05 if radius < 5 else 0.01)
    full = ~mask
    assert (plane(morphology.dilate(frame(spark, mask), radius)) == dilate(mask, radius)).all()
    assert (plane(morphology.erode(frame(spark, full), radius)) == erode(full, radius)).all()
    assert (plane(morphology.erode(frame(spark, full), radius, border="ignore")) == erode(full, radius, True)).all()


def test_greens(spark):
    scenes = [(rect(50, 50, (10, 10, 30, 30, (0, 220, 0)), picture=(255, 255, 255)), 900), (rect(30, 30, (5, 5, 10, 10, (20, 180, 80)), picture=(0, 0, 0)), 100), (rect(20, 20, picture=(255, 0, 0)), 0)]
    for picture, count in scenes:
        assert plane(clip.extract_green(pixel_frame(spark, picture))).sum() == count
    assert plane(clip.extract_green(pixel_frame(spark, scenes[0][0], alpha=29))).sum() == 0


def test_roads(spark):
    scenes = [
        (rect(40, 40, (18, 0, 4, 40, ORANGE), picture=BG), 236, 216),
        (rect(40, 40, (0, 18, 40, 4, YELLOW), picture=BG), 160, 144),
        (rect(50, 50, (20, 0, 4, 23, ORANGE), (20, 26, 4, 24, ORANGE), picture=BG), 286, 276),
    ]
    for picture, raw, closed in scenes:
        pixels = pixel_frame(spark, picture)
        assert plane(clip.raw_roads(pixels)).sum() == raw
        assert plane(clip.detect_roads(pixels)).sum() == closed


def test_thresholds():
    assert [gradient.threshold(s) for s in (0.5, 1.0, 2.0, 2.5, 9)] == [150, 75, 37, 30, 30]


def test_luminance_is_cut_off_in_double_precision(spark):
    greys = spark.range(256).select(F.col("id").cast("int").alias("v")).select("v", color.luminance("v", "v", "v").alias("l"))
    got = {r.v: r.l for r in greys.collect()}
    assert [got[v] for v in (1, 2, 4, 8)] == [0, 1, 3, 7] and sum(got[v] == v - 1 for v in got) == 65


def test_colour_counts_over_a_lattice(spark):
    """Integer hue against a floating-point one on every fifth level, and packing there and back."""
    import colorsys

    levels = spark.range(52).select((F.col("id") * 5).cast("int").alias("v"))
    all_ = levels.select(F.col("v").alias("r")).crossJoin(levels.select(F.col("v").alias("g"))).crossJoin(levels.select(F.col("v").alias("b")))
    rows = all_.select("r", "g", "b", color.is_green_hue().alias("green"), color.pack(F.lit(200), "r", "g", "b").alias("p")).select("*", *color.unpack("p")[:1]).sample(0.1, 3).collect()
    for x in rows:
        h, s, v = colorsys.rgb_to_hsv(x.r / 255, x.g / 255, x.b / 255)
        near = min(abs(h * 360 - 70), abs(h * 360 - 170)) < 1e-6 or abs(s - 0.2) < 1e-9 or abs(v - 0.2) < 1e-9
        assert near or x.green == (70 <= h * 360 <= 170 and s > 0.2 and v > 0.2)
        assert x.a == 200 and x.p & 0xFFFFFF == x.r << 16 | x.g << 8 | x.b


def test_snap_scenes(spark):
    frame_wall = rect(60, 60, (15, 15, 31, 31)) & ~rect(60, 60, (16, 16, 29, 29))
    rough = rect(60, 60, (22, 22, 17, 17))
    for policy in ("all", "largest"):
        got = plane(region.snap(frame(spark, rough), frame(spark, frame_wall), ClipConfig(snap_distance=20, seed_erosion_radius=2, seed_policy=policy)))
        assert got.sum() == 841 and got[30, 30] and got[18, 18] and not got[30, 10]
    rough, wall = rect(60, 60, (10, 15, 31, 31)), rect(60, 60, (30, 0, 1, 60))
    for policy, count in (("all", 3540), ("largest", 1800)):
        got = plane(region.snap(frame(spark, rough), frame(spark, wall), ClipConfig(snap_distance=25, seed_erosion_radius=4, seed_policy=policy)))
        assert got.sum() == count and got[30, 20] and got[30, 35] == (policy == "all")


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("wide", [False, True])
def test_snap_against_model(spark, seed, wide):
    rng = np.random.default_rng(seed)
    rough = dilate(rng.random((16, 21)) < 0.03, 2)
    barrier = rng.random((16, 21)) < 0.25
    for policy in ("all", "largest"):
        config = ClipConfig(snap_distance=3, seed_erosion_radius=2, seed_policy=policy)
        got = plane(region.snap(frame(spark, rough), frame(spark, barrier), config, wide=wide))
        assert (got == snap(rough, barrier, 3, 2, policy)).all()
        assert not (got & barrier).any() and not (got & ~dilate(rough, 3)).any()


def test_labels_of_a_snake():
    snake = np.ones((41, 41), bool)
    snake[1::4, :-1] = snake[3::4, 1:] = False
    assert (planes.labels(snake)[snake] == 0).all()
    assert (planes.labels(np.zeros((3, 3), bool)) == -1).all()


def test_renders(spark):
    blue = pixel_frame(spark, rect(10, 10, picture=(0, 0, 255)))
    mask = frame(spark, rect(10, 10, (5, 5, 1, 1)))
    hard = plane(render.clip_smooth(blue, mask, 0), "a")
    assert hard[5, 5] == 255 and hard[0, 0] == 0 and hard.sum() == 255
    shown = plane(render.mask_image(frame(spark, rect(10, 10, (2, 2, 1, 1)))), "r")
    assert shown[2, 2] == 255 and shown[0, 0] == 0
    square = frame(spark, rect(10, 10, (2, 2, 6, 6)))
    smooth = plane(render.clip_smooth(blue, square, 1), "a")
    assert (smooth == 255).sum() == 16 and (smooth == 160).sum() == 20
    rings = plane(render.clip_progressive(blue, square, 2), "a")
    assert sorted(set(rings.ravel())) == [0, 85, 170, 255]
    assert plane(render.overlay_preview(blue, None), "b").min() == 255
    scale = spark.range(1).select(*render.fit(F.lit(100), F.lit(50), 220, 140)).first()
    assert tuple(scale) == (2.0, 10, 20)
    board = plane(render.checkerboard(frame(spark, rect(30, 30))), "r")
    assert board[0, 0] == 220 and board[0, 12] == 255 and board[12, 12] == 220


def test_no_exchange_of_pixels(spark, tmp_path):
    """From dealt-out image rows, no cell is exchanged on its way through bit planes and back."""
    rows = spark.createDataFrame([(i, 8, 8) for i in range(6)], "image_id long, width int, height int").repartition("image_id")
    m = morphology.close(grid.cells(rows).withColumn("active", F.col("x") > 3), 2)
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("size", [(1, 1), (2, 5), (13, 19)])
def test_windows_and_planes_agree(spark, size):
    """Every operator of an image in a task gives what its windows give, on random pictures and overlays."""
    rng = np.random.default_rng(size[0])
    colours = np.array([BG, ORANGE, YELLOW, (0, 220, 0), (250, 250, 250), (20, 180, 80)])
    shown, over = (pixel_frame(spark, colours[rng.integers(0, 6, size)]) for _ in range(2))
    mask = frame(spark, rng.random(size) < 0.8)
    config = ClipConfig(snap_distance=2, seed_erosion_radius=1)
    pairs = {
        "dilate": lambda w: morphology.dilate(mask, 1, wide=w),
        "open": lambda w: morphology.open_(mask, 1, wide=w),
        "close": lambda w: morphology.close(mask, 2, border="ignore", wide=w),
        "edges": lambda w: gradient.edges(shown, 1.0, wide=w),
        "gx": lambda w: gradient.sobel(shown, wide=w).select("image_id", "x", "y", F.struct("gx", "gy").alias("active")),
        "green": lambda w: clip.extract_green(over, wide=w),
        "roads": lambda w: clip.detect_roads(shown, config, wide=w),
        "seed": lambda w: region.adaptive_seed(mask, 8, wide=w),
        "region": lambda w: clip.clip(shown, over, config, wide=w).region,
        "clipped": lambda w: clip.clip(shown, over, config, wide=w).clipped.select("image_id", "x", "y", F.struct("a", "r", "g", "b").alias("active")),
        "rings": lambda w: render.clip_progressive(shown, mask, wide=w).select("image_id", "x", "y", F.struct("a", "r", "g", "b").alias("active")),
        "preview": lambda w: render.overlay_preview(shown, over, wide=w).select("image_id", "x", "y", F.struct("a", "r", "g", "b").alias("active")),
    }
    for name, make in pairs.items():
        one, other = (sorted((r.x, r.y, str(r.active)) for r in make(w).collect()) for w in (False, True))
        assert one == other, name
