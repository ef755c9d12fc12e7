"""Image files, the command line and the stream."""

import numpy as np
import pytest
from model import frame, pixel_frame, plane, rect
from pyspark.sql import functions as F

from tesselle import cli
from tesselle.schema import IMAGES
from tesselle.sources import images
from tesselle.streaming import clip_stream


def _write(path, picture):
    path.write_bytes(images.png(np.asarray(picture)))
    return str(path)


def test_round_trip(spark, tmp_path):
    picture = np.random.default_rng(1).integers(0, 256, (9, 13, 4))
    pixels = pixel_frame(spark, picture[..., :3], 7).join(spark.createDataFrame([(x, y, int(picture[y, x, 3])) for y in range(9) for x in range(13)], "x int, y int, alpha int"), ["x", "y"]).withColumn("a", F.col("alpha"))
    written = images.save(images.encode(pixels), str(tmp_path / "new" / "folder")).collect()
    assert [(r.image_id, r.name) for r in written] == [(7, "7.png")]
    back = images.pixels(images.scan(spark, str(tmp_path / "new" / "folder" / "7.png")).withColumn("image_id", F.lit(0).cast("long")))
    for i, c in enumerate("rgba"):
        assert (plane(back, c) == picture[..., i]).all()


def test_bad_files(spark, tmp_path):
    (tmp_path / "x.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="not an image"):
        images.scan(spark, str(tmp_path / "x.png")).collect()
    with pytest.raises(ValueError):
        images.scan(spark, "")
    with pytest.raises(Exception, match="exist"):
        images.scan(spark, str(tmp_path / "none.png")).collect()
    a, b = (images.scan(spark, _write(tmp_path / f"{w}.png", np.zeros((100, w, 3)))).withColumn("image_id", F.lit(0)) for w in (200, 150))
    images.check_same_size(a, a)
    with pytest.raises(ValueError, match="200x100 and 150x100"):
        images.check_same_size(a, b)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    black = np.zeros((30, 30, 3), int)
    green = rect(30, 30, (5, 5, 20, 20, (0, 220, 0)), picture=(0, 0, 0))
    shown, over, none = _write(tmp_path / "map.png", black), _write(tmp_path / "over.png", green), _write(tmp_path / "none.png", black)
    out = tmp_path / "made" / "out.png"
    assert cli.run(["--map", shown, "--mask", over, "--output", str(out), "--snap-distance", "15"], spark) == 0
    made = plane(images.pixels(images.scan(spark, str(out)).withColumn("image_id", F.lit(0).cast("long"))), "a")
    assert ((made == 255).sum(), (made == 160).sum()) == (784, 116) and (tmp_path / "mask_output.png").exists()
    assert "green 400, roads 0, region 900" in capsys.readouterr().out
    assert cli.run(["--map", shown, "--mask", none, "--output", str(tmp_path / "no.png")], spark) == 1 and not (tmp_path / "no.png").exists()
    assert cli.run([], spark) == 1 and cli.run(["--help"], spark) == 0 and cli.run(["--map", shown], spark) == 1
    assert cli.run(["--map", shown, "--mask", str(tmp_path / "gone.png")], spark) == 1
    assert cli.run(["--map", shown, "--mask", over, "--snap-distance", "0"], spark) == 1
    capsys.readouterr()
    assert cli.run(["--MAP", shown, "--Mask", over, "--output", str(tmp_path / "two.png"), "--mask-out", str(tmp_path / "m.png"), "--snap-distance", "far", "--smooth"], spark) == 0
    told = capsys.readouterr()
    assert "far is no number, 40 is taken" in told.err and "no road" in told.err and "region 900" in told.out
    assert (tmp_path / "two.png").exists() and (tmp_path / "m.png").exists()
    small = _write(tmp_path / "small.png", np.zeros((20, 30, 3), int))
    assert cli.run(["--map", shown, "--mask", small], spark) == 1 and "30x30 and 30x20" in capsys.readouterr().err


def test_stream(spark, tmp_path):
    green = rect(30, 30, (5, 5, 20, 20, (0, 220, 0)), picture=(0, 0, 0))
    rows = [(1, "m", 30, 30, 3, bytes(2700), "map"), (1, "o", 30, 30, 3, green[..., ::-1].astype(np.uint8).tobytes(), "overlay")]
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame(rows, IMAGES + ", role string").coalesce(1).write.parquet(source)
    for _ in range(2):  # the second run finds nothing new
        clip_stream(spark, source, target, checkpoint).awaitTermination()
    got = spark.read.parquet(target).collect()
    assert [(r.image_id, r.n_active) for r in got] == [(1, 900)] and got[0].region[:4] == b"\x89PNG"


def test_stream_waits_for_the_other_side(spark, tmp_path):
    """A map and its overlay that come in different batches meet; what has no partner stays in sight."""
    green = rect(30, 30, (5, 5, 20, 20, (0, 220, 0)), picture=(0, 0, 0))
    over = lambda i: (i, "o", 30, 30, 3, green[..., ::-1].astype(np.uint8).tobytes(), "overlay")
    shown = lambda i: (i, "m", 30, 30, 3, bytes(2700), "map")
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    for rows in ([shown(1), shown(2), (9, "?", 1, 1, 3, bytes(3), None)], [over(1), shown(3), over(3)], [over(2), over(4)]):
        spark.createDataFrame(rows, IMAGES + ", role string").coalesce(1).write.mode("append").parquet(source)
        clip_stream(spark, source, target, checkpoint).awaitTermination()
    got = spark.read.parquet(target).collect()
    assert sorted((r.image_id, r.n_active) for r in got) == [(1, 900), (2, 900), (3, 900)]
    assert spark.read.parquet(f"{target}_unmatched").count() == 0


def test_stream_gives_up_waiting_and_keeps_no_state(spark, tmp_path):
    """A lone side comes out after its time, once, and a partner that comes later still finds one of its own."""
    green = rect(30, 30, (5, 5, 20, 20, (0, 220, 0)), picture=(0, 0, 0))
    over = lambda i: (i, "o", 30, 30, 3, green[..., ::-1].astype(np.uint8).tobytes(), "overlay")
    shown = lambda i, origin="m": (i, origin, 30, 30, 3, bytes(2700), "map")
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    for rows in ([shown(1), shown(2), shown(2, "b")], [shown(3), over(3), over(3)], [over(1), over(5)], [shown(5), shown(1)]):
        spark.createDataFrame(rows, IMAGES + ", role string").coalesce(1).write.mode("append").parquet(source)
        clip_stream(spark, source, target, checkpoint, wait_ms=1).awaitTermination()
    got = spark.read.parquet(target).collect()
    lone = spark.read.parquet(f"{target}_unmatched").collect()
    assert sorted((r.image_id, r.n_active) for r in got) == [(1, 900), (3, 900), (5, 900)]
    # of image 2 the smaller row of one batch waited and came out once, with its bytes
    assert sorted((r.image_id, r.role, r.origin, len(r.data)) for r in lone) == [(1, "map", "m", 2700), (2, "map", "b", 2700)]


def test_wide_frames(spark):
    from tesselle.operators.grid import sizes

    assert tuple(sizes(frame(spark, rect(4, 3))).first()) == (0, 4, 3)
