"""Files that appear at commit only, files of one channel, and options and settings read from rows."""

import numpy as np
import pytest
from model import pixel_frame, rect
from pyspark.sql import functions as F

from tesselle import cli
from tesselle.config import ClipConfig, error, with_defaults
from tesselle.operators import grid
from tesselle.sources import images, sink


def files_in(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file())


def test_files_appear_together(spark, tmp_path):
    rows = spark.range(20).select(F.concat(F.lit("a/"), F.col("id"), F.lit(".bin")).alias("name"), F.col("id").cast("string").cast("binary").alias("content")).repartition(4)
    sink.write_files(rows, str(tmp_path))
    assert files_in(tmp_path) == sorted(f"a/{i}.bin" for i in range(20)) and (tmp_path / "a/7.bin").read_bytes() == b"7"
    sink.write_files(rows.where("false"), str(tmp_path))
    sink.write_files(rows.limit(1).select(F.lit("none").alias("name"), F.lit(None).cast("binary").alias("content")), str(tmp_path))
    assert len(files_in(tmp_path)) == 20 and [p.name for p in tmp_path.iterdir()] == ["a"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    bad = F.when(F.col("id") == 17, F.raise_error(F.lit("no such picture")).cast("binary")).otherwise(F.lit(b"x"))
    rows = spark.range(20).repartition(5).select(F.col("id").cast("string").alias("name"), bad.alias("content"))
    with pytest.raises(Exception, match="no such picture"):
        sink.write_files(rows, str(tmp_path))
    assert not [n for n in files_in(tmp_path) if not n.startswith("_staging")]
    writer = sink.FilesWriter(f"file://{tmp_path / 'b'}")
    writer.abort([])
    assert list((tmp_path / "b").iterdir()) == []
    with pytest.raises(OSError):  # a task that outlives its write
        writer.write(iter([]))


def test_only_committed_attempts_count(tmp_path):
    """A task that ran twice: what the lost attempt wrote goes with the staging folder."""
    from pyspark.sql.types import Row

    writer = sink.FilesWriter(f"file://{tmp_path}")
    rows = [Row(name=f"{i}.png", content=b"new") for i in range(3)]
    writer.write(iter(rows[:2]))
    kept = writer.write(iter(rows))
    assert files_in(tmp_path) and not any(n.endswith(".png") for n in files_in(tmp_path))
    writer.commit([kept, None])
    assert files_in(tmp_path) == ["0.png", "1.png", "2.png"]


def test_two_files_of_one_name_are_refused(spark, tmp_path):
    rows = spark.range(2).select(F.lit("x.png").alias("name"), F.lit(b"x").alias("content"))
    with pytest.raises(Exception, match="one name"):
        sink.write_files(rows, str(tmp_path))
    assert list(tmp_path.iterdir()) == []


def test_a_pair_or_none(spark, tmp_path):
    made = spark.createDataFrame([(b"region", b"mask")], "region binary, mask binary")
    images.save_pair(made, [("region", str(tmp_path), "out.png"), ("mask", str(tmp_path), "mask.png")])
    assert files_in(tmp_path) == ["mask.png", "out.png"]
    broken = made.withColumn("mask", F.raise_error(F.lit("broken")).cast("binary"))
    with pytest.raises(Exception, match="broken"):
        images.save_pair(broken, [("region", str(tmp_path / "b"), "out.png"), ("mask", str(tmp_path / "b"), "mask.png")])
    assert files_in(tmp_path) == ["mask.png", "out.png"]


def test_grey_files(spark, tmp_path):
    levels = np.arange(256).reshape(16, 16)
    (tmp_path / "grey.png").write_bytes(images.png(levels[..., None]))
    (tmp_path / "rgb.png").write_bytes(images.png(np.stack([levels] * 3, -1)))
    found = images.scan(spark, str(tmp_path))
    assert {r.n_channels for r in found.collect()} == {3}
    got = {(r.origin.rsplit("/", 1)[-1], r.y * 16 + r.x): (r.a, r.r, r.g, r.b) for r in images.pixels(found).join(found.select("image_id", "origin"), "image_id").collect()}
    assert got["grey.png", 100] == (255, 168, 168, 168) and got["grey.png", 0] == (255, 0, 0, 0) and got["grey.png", 255] == (255, 255, 255, 255)
    assert got["rgb.png", 100] == (255, 100, 100, 100) and len(got) == 512
    (tmp_path / "bad.png").write_bytes(b"no picture")
    with pytest.raises(Exception, match="not an image"):
        images.scan(spark, str(tmp_path)).collect()


def test_options_of_rows_are_the_command_lines(spark):
    cases = [[], ["--map"], ["--MAP", "a"], ["--map", "--mask", "b"], ["--mask", "x", "--map", "y", "--map", "z"], ["--smooth", "3", "--Smooth", "4"], ["--smooth", "3x"], ["--smooth", ""], ["a", "--smooth"]]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "id int, args array<string>")
    got = {r.id: r for r in rows.select("id", cli.option_of(F.col("args"), "--map").alias("map"), cli.number_of(F.col("args"), "--smooth", 1, "int").alias("smooth")).collect()}
    for i, args in enumerate(cases):
        assert (got[i].map, got[i].smooth) == (cli.option(args, "--map"), cli.number(args, "--smooth", 1, int))


def test_settings_of_rows_are_the_configs(spark):
    cases = [(None, None, None), (0, None, None), (5, 0.0, None), (5, float("nan"), None), (5, 1.0, -1), (5, 2.5, 0), (-3, -1.0, -1)]
    rows = spark.createDataFrame(cases, "snap_distance int, road_sensitivity double, smooth_radius int")
    for given, r in zip(cases, with_defaults(rows).withColumn("error", error()).collect(), strict=True):
        named = {n: v for n, v in zip(("snap_distance", "road_sensitivity", "smooth_radius"), given, strict=True) if v is not None}
        try:
            config, why = ClipConfig(**named), None
            assert (r.snap_distance, r.seed_policy, r.closing_radius) == (config.snap_distance, "stroke", 2)
        except ValueError as e:
            why = str(e)
        assert (r.error or "").lower() == (why or "").lower()


def test_masks_of_rows(spark):
    rows = spark.createDataFrame([(1, 2, 2, [True, None, False, True])], "image_id long, width int, height int, values array<boolean>")
    assert {(r.x, r.y): r.active for r in grid.wrapped(rows).collect()} == {(0, 0): True, (1, 0): False, (0, 1): False, (1, 1): True}
    for bad in ([True], [True] * 5):
        with pytest.raises(Exception, match="do not fill 2x2"):
            grid.wrapped(rows.withColumn("values", F.array(*[F.lit(v) for v in bad]))).collect()
    assert grid.blanks(rows).where("not active").count() == 4
    with pytest.raises(Exception, match="positive size"):
        grid.blanks(rows.withColumn("width", F.lit(0))).collect()


def test_warning_where_the_road_network_is_broken(spark, tmp_path, capsys):
    """One road closes one side of the selection, the others end at the snap distance."""
    over = rect(60, 60, (20, 20, 20, 20, (0, 220, 0)), picture=(0, 0, 0))
    for name, boxes, broken in (("open", [(44, 0, 4, 60, (245, 165, 100))], True), ("closed", [(14, 0, 4, 60, (245, 165, 100)), (44, 0, 4, 60, (245, 165, 100)), (0, 14, 60, 4, (245, 165, 100)), (0, 44, 60, 4, (245, 165, 100))], False)):
        folder = tmp_path / name
        for file, picture in (("map", rect(60, 60, *boxes, picture=(230, 226, 219))), ("over", over)):
            images.save(images.encode(pixel_frame(spark, picture), False), str(folder), F.lit(f"{file}.png"))
        args = ["--map", f"{folder}/map.png", "--mask", f"{folder}/over.png", "--output", f"{folder}/out.png", "--mask-out", f"{folder}/mask.png", "--snap-distance", "12"]
        assert cli.run(args, spark) == 0
        said = capsys.readouterr().err
        assert ("meets no road" in said) == broken, (name, said)
        assert {"out.png", "mask.png"} <= set(files_in(folder))
