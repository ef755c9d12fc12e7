"""What keeps the raster queries whole on many images: few rows that grow are dealt out, and images never travel to every machine."""

import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

from tesselle import streaming  # noqa: E402
from tesselle.operators import tiled  # noqa: E402
from tesselle.plans import clip, queries  # noqa: E402
from tesselle.schema import by_image  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_images_are_dealt_out_by_their_cells(spark):
    """A few small rows that grow to many cells are not left in one partition."""
    sized = spark.createDataFrame([(i, 1024, 1024) for i in range(64)], "image_id long, width int, height int")
    assert by_image(sized).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert by_image(sized.where("false")).count() == 0


def test_clip_images_sends_no_image_to_all(spark):
    made = clip.clip_images(*queries._as_images(spark, DATA))
    assert "Broadcast" not in plan(made) and made.count() == 10


def test_the_names_of_saved_files_encode_nothing_again(spark):
    """What was written is told without a second encoding, which would double the work."""
    told = queries._sink(spark, DATA)
    assert "Python" not in plan(told) and "Arrow" not in plan(told)
    assert sorted(map(tuple, told.collect())) == [(i, f"{i}.png") for i in range(10)]


def test_packed_points_send_no_mask_to_all(spark):
    """Neither the words of masks nor the steps of their lattices are broadcast, whose size Spark does not know."""
    assert "Broadcast" not in plan(queries._packed_points(spark, DATA))


@pytest.mark.parametrize("cuts", [[3, 7], [1, 2, 3, 4, 5, 6, 7, 8, 9], [], [10]])
def test_groups_go_on_over_batches(cuts):
    """Rows of a key that a batch's end parts are one group."""
    keys = np.array([4, 4, 4, 4, 7, 7, 2, 9, 9, 9])
    whole = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.arange(10))], names=["image_id", "v"])
    bounds = [0, *cuts, 10]
    found = list(tiled._groups((whole.slice(a, b - a) for a, b in zip(bounds, bounds[1:])), ["image_id"]))
    assert [t.column("v").to_pylist() for t in found] == [[0, 1, 2, 3], [4, 5], [6], [7, 8, 9]]


@pytest.mark.parametrize("name", ["components_wide", "largest_component_wide", "clip_smooth_wide", "clip_pipeline_wide"])
def test_tiles_are_not_sent_to_all_nor_grouped_one_by_one(spark, name):
    """A small tile costs a task little more than its cells: no group in Python for each, and no broadcast of tiles."""
    made = plan(queries.queries()[name](spark, DATA))
    assert "Groups" not in made and made.count("BroadcastHashJoin") <= made.count("max(x")  # sizes of images alone are small


def test_arriving_pairs_are_not_sent_to_all(spark):
    """The two sides of a stream's batch, as it clips them: rows of whole images, however few they are thought to be."""
    rows = spark.createDataFrame([(1, None, 2, 2, 3, bytes(12), role) for role in streaming.ROLES], streaming.ARRIVING)
    made = clip.clip_images(*streaming.sides(rows))
    assert "Broadcast" not in plan(made) and made.count() == 1
