"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of crc32(doc_id as text) modulo this, remainder 0 is held out of every fit.
FOLDS = 5


def fold() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))


def sample_ids(labels: DataFrame, column: str, value: int, most: int, learnable: bool = True) -> list[int]:
    """At most ``most`` ids that carry the label, taken by a hash of the id. The held-out fold does not enter if they are to be
    learnt from (``learnable``)."""
    rows = labels.where((F.col(column) == value) & F.col("doc_id").isNotNull())
    rows = rows.where(fold() != 0) if learnable else rows
    return [r[0] for r in rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]
