"""Clips of images as they arrive.

What has no partner yet waits as state of its image, with a timer: when the other side comes the pair is clipped and the state goes; when the time
is over the lone row comes out as unmatched and the state goes too. A batch costs what arrives in it, not what waits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..config import ClipConfig
from ..plans.clip import clip_images
from ..schema import IMAGES

ARRIVING = IMAGES + ", role string"
ROLES = ("map", "overlay")
#: A side as it waits and comes out.
_SIDE = "origin string, width int, height int, n_channels int, data binary"
_OUT = f"image_id long, matched boolean, role string, {_SIDE}"
_FIELDS = ["origin", "width", "height", "n_channels", "data"]
#: How long a side waits for the other, in milliseconds.
WAIT_MS = 3_600_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Pairing(StatefulProcessor):
    """One side of an image is kept until the other comes or the time is over; of several rows of a side the one that came first counts, within a batch
    the smallest by origin and bytes."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", f"role string, {_SIDE}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        had = self.waiting.get() if self.waiting.exists() else None
        sides = {} if had is None else {had[0]: tuple(had[1:])}
        came: dict[str, tuple] = {}
        arrived = 0
        for frame in rows:
            arrived = max(arrived, int(frame["arrived"].max().timestamp() * 1000))
            for role, *values in frame[["role", *_FIELDS]].itertuples(index=False, name=None):
                side = (None if values[0] is None else str(values[0]), *map(int, values[1:4]), bytes(values[4]))
                if role not in came or (side[0] or "", side[4]) < (came[role][0] or "", came[role][4]):
                    came[role] = side
        sides = came | sides
        if len(sides) == 2:
            self._clear()
            yield self._rows(key, True, sides)
        elif had is None:
            role, side = next(iter(sides.items()))
            self.waiting.update((role, *side))
            self.handle.registerTimer(arrived + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waiting.exists():
            role, *side = self.waiting.get()
            self._clear()
            yield self._rows(key, False, {role: tuple(side)})

    def _clear(self) -> None:
        self.waiting.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def _rows(self, key, matched: bool, sides: dict[str, tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], matched, role, *side) for role, side in sorted(sides.items())], columns=["image_id", "matched", "role", *_FIELDS])

    def close(self) -> None:
        pass


def sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The maps and the overlays of paired rows."""
    return rows.where("role = 'map'"), rows.where("role = 'overlay'")


def clip_stream(spark: SparkSession, source: str, target: str, checkpoint: str, config: ClipConfig | None = None, unmatched: str | None = None, wait_ms: int = WAIT_MS) -> StreamingQuery:
    """Clips each map of a Parquet folder of ``images`` rows with ``role`` as soon as its overlay is there too; a restart goes on where it was.

    Rows that no partner came for within ``wait_ms`` go to ``unmatched`` (by default beside ``target``) after the first batch that arrives later. Rows without
    an id, or of another role, are left out. Batches are written under their number, so that one that runs again replaces itself.
    The session keeps states in RocksDB from then on.
    """
    unmatched = unmatched or f"{target.rstrip('/')}_unmatched"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = spark.readStream.schema(ARRIVING).option("maxFilesPerTrigger", 64).parquet(source)
    known = rows.where(F.col("role").isin(*ROLES) & F.col("image_id").isNotNull())
    # the clock is the arrival of batches, so that a restart finds it where it was
    timed = known.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", "0 seconds")
    paired = timed.groupBy("image_id").transformWithStateInPandas(Pairing(wait_ms), _OUT, "append", "EventTime")

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()  # the state's output, read for pairs and for lone rows
        try:
            maps, overlays = sides(batch.where("matched").drop("matched"))
            clipped = clip_images(maps, overlays, config).select("image_id", "region", "mask", F.col("n_region").alias("n_active"))
            clipped.write.mode("overwrite").parquet(f"{target}/batch={number}")
            batch.where("not matched").drop("matched").write.mode("overwrite").parquet(f"{unmatched}/batch={number}")
        finally:
            batch.unpersist()

    return paired.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
