"""Quality selection by importance resampling.

Word n-grams are hashed to buckets. One bucket distribution is fitted to target text, one to the raw
text; a document's log weight is the sum of the buckets' log ratios over its n-grams. Adding Gumbel noise
to the log weights and keeping the k largest samples k documents without replacement in proportion to the
weights. The noise is a hash of the id, so a rerun selects the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import FOLDED, U, between, grams, mix, passes, prefix, text_bytes, words
from .labelled import sample_ids
from .scratch import saved

BUCKETS = 10_000
ORDERS = (1, 2)
#: Most target rows that the target distribution is fitted on.
TARGET = 20_000
#: Share of the documents to select.
KEEP = 0.8
_WORD = np.ones(256, bool)
_WORD[[32, *range(9, 14)]] = False
COUNTS = "target int, bucket int, n long"
SCORES = "doc_id long, n_grams long, log_weight double, draw long"


def bucketed(batch: pa.RecordBatch, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every n-gram of the lower-cased, white-space separated words of ``text``."""
    data, bounds = text_bytes(batch.column("text"))
    starts, ends, rows = words(data, bounds, _WORD)
    hashes = between(prefix(data, FOLDED), starts, ends)
    found = [grams(hashes, rows, n) for n in orders]
    return (np.concatenate([h for h, _ in found]) % U(buckets)).astype(np.int64), np.concatenate([r for _, r in found])


def _count(batches: Iterator[pa.RecordBatch], target: np.ndarray, buckets: int, orders: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros((2, buckets), np.int64)
    for whole in batches:
        for batch in passes(whole):
            bucket, row = bucketed(batch, buckets, orders)
            totals[0] += np.bincount(bucket, minlength=buckets)
            ids = np.array(batch.column("doc_id").fill_null(-1).to_pylist(), np.int64)
            if (chosen := np.isin(ids, target) & np.array(batch.column("doc_id").is_valid())).any():
                totals[1] += np.bincount(bucket[chosen[row]], minlength=buckets)
    kind, bucket = np.nonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(totals[kind, bucket])], names=["target", "bucket", "n"])


def fit(docs: DataFrame, target_ids: list[int], buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """Log ratio of each bucket, target over raw, each count raised by one. Raw counts are those of all rows."""
    counts = docs.select("doc_id", "text").mapInArrow(partial(_count, target=np.array(target_ids, np.int64), buckets=buckets, orders=orders), COUNTS)
    totals = np.ones((2, buckets))
    for r in counts.groupBy("target", "bucket").agg(F.sum("n").alias("n")).collect():  # at most two rows a bucket
        totals[r.target, r.bucket] += r.n
    return np.log(totals[1] / totals[1].sum()) - np.log(totals[0] / totals[0].sum())


def _weigh(batches: Iterator[pa.RecordBatch], ratio: np.ndarray, orders: tuple[int, ...], seed: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in passes(whole):
            bucket, row = bucketed(batch, len(ratio), orders)
            weight = np.bincount(row, ratio[bucket], batch.num_rows)
            ids = np.array(batch.column("doc_id").fill_null(-1).to_pylist(), np.int64)
            u = ((mix(mix(ids.view(U)) ^ U(seed)) >> U(11)).astype(float) + 0.5) / 2.0**53
            bits = (weight - np.log(-np.log(u)) + 0.0).view(np.int64)
            # an integer in the order of the floating-point key
            draw = np.where(bits >= 0, bits, bits ^ np.int64(0x7FFFFFFFFFFFFFFF))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.bincount(row, minlength=batch.num_rows).astype(np.int64)), pa.array(weight), pa.array(draw)], names=["doc_id", "n_grams", "log_weight", "draw"])


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column, by four counts of 16 bits each; None if k is 0."""
    if k <= 0:
        return None
    top: Column = F.shiftright(F.col(column), 48)
    known, left = None, k
    for shift in (48, 32, 16, 0):
        here = df if known is None else df.where(F.shiftright(F.col(column), shift + 16) == known)
        digit = top if shift == 48 else F.shiftright(F.col(column), shift).bitwiseAND(0xFFFF)
        for r in sorted(here.groupBy(digit.alias("d")).count().collect(), key=lambda r: -r.d):  # 65,536 rows at most
            if left <= r["count"]:
                known = r.d if known is None else known * 65536 + r.d
                break
            left -= r["count"]
    return known


def resample(docs: DataFrame, target_ids: list[int], keep: float = KEEP, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS, seed: int = 11) -> DataFrame:
    """doc_id, n_grams, log_weight, selected (boolean) for each row of ``docs`` (doc_id, text).

    ``ceil(keep * rows)`` rows are selected; rows that tie with the last one (repeated rows do) are selected too.
    A null or empty text has weight 0 by no n-grams; a null id is never a target and draws the noise of id -1; an empty table gives no rows.
    """
    ratio = fit(docs, target_ids, buckets, orders)
    weighed = saved(docs.select("doc_id", "text").mapInArrow(partial(_weigh, ratio=ratio, orders=orders, seed=seed), SCORES), "weights")
    rows = weighed.count()
    last = kth_largest(weighed, "draw", min(rows, -int(-(keep * rows) // 1)))
    chosen = F.lit(False) if last is None else F.col("draw") >= F.lit(last)
    return weighed.select("doc_id", "n_grams", "log_weight", chosen.alias("selected"))


def select(docs: DataFrame, labels: DataFrame, keep: float = KEEP, target: int = TARGET) -> DataFrame:
    """:func:`resample` towards the rows labelled ``quality`` 1, of which a bounded sample is the target text."""
    return resample(docs, sample_ids(labels, "quality", 1, target, learnable=False), keep)
