"""Token counts of flat token files by a scan for separators.

A token file is a flat run of ids, cut into blocks, in which an end-of-document id ends each document and
nothing says where documents begin. Blocks are searched alone and vectorised; a prefix scan over the
blocks' few numbers then tells each block how many documents ended before it and how many tokens of an
unfinished one it continues.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashing import passes
from .tokens import encoder

BLOCK_TOKENS = 1 << 16
FILES = "file_id long, block long, content binary, first_ordinal long, doc_ids array<long>"
SUMMARY = "file_id long, block long, n_tokens long, n_ends long, last_end long, lengths array<long>"
_ARROW = pa.schema([("file_id", pa.int64()), ("block", pa.int64()), ("content", pa.binary()), ("first_ordinal", pa.int64()), ("doc_ids", pa.list_(pa.int64()))])


def _write(batches: Iterator[pa.RecordBatch], path: str, end_id: int, width: str, block: int) -> Iterator[pa.RecordBatch]:
    encode, file = encoder(path, specials_as_text=True), TaskContext.get().partitionId()
    end, size = np.array([end_id], width).tobytes(), block * np.dtype(width).itemsize
    blocks, ordinal, waiting = 0, 0, bytearray()
    for whole in batches:
        for batch in passes(whole):
            for ids in encode(batch.column("text").to_pylist()):
                waiting += np.frombuffer(ids, "<u4").astype(width).tobytes() + end
            rows = []
            while len(waiting) >= size:
                rows.append((blocks, bytes(waiting[:size])))
                del waiting[:size]
                blocks += 1
            ids = batch.column("doc_id").to_pylist()
            rows = [{"file_id": file, "block": b, "content": c} for b, c in rows] + [{"file_id": file, "first_ordinal": ordinal, "doc_ids": ids}]
            ordinal += len(ids)
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
    if waiting:
        yield pa.RecordBatch.from_pylist([{"file_id": file, "block": blocks, "content": bytes(waiting)}], schema=_ARROW)


def token_files(docs: DataFrame, tokenizer: str, end_id: int, width: str = "<u2", block: int = BLOCK_TOKENS) -> DataFrame:
    """Flat token files of ``docs``, one for each partition, as rows of blocks.

    Rows with ``doc_ids`` list, in file order, which documents were written; the scan does not read them.
    """
    if end_id >= 1 << 8 * np.dtype(width).itemsize:
        raise ValueError("the end-of-document id does not fit the width")
    return docs.select("doc_id", "text").mapInArrow(partial(_write, path=tokenizer, end_id=end_id, width=width, block=block), FILES)


def _scan(batches: Iterator[pa.RecordBatch], end_id: int, width: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("file_id", "block", "n_tokens", "n_ends", "last_end", "lengths")}
        for file, block, content in zip(*(batch.column(c) for c in ("file_id", "block", "content")), strict=True):
            ids = np.frombuffer(content.as_buffer() if content.is_valid else b"", width)
            ends = np.flatnonzero(ids == end_id)
            row = (file.as_py(), block.as_py(), len(ids), len(ends), int(ends[-1]) + 1 if len(ends) else None, np.diff(ends, prepend=-1) - 1)
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.int64()) for k in list(out)[:-1]] + [("lengths", pa.list_(pa.int64()))]))


def count_tokens(blocks: DataFrame, end_id: int, width: str = "<u2") -> DataFrame:
    """One row for each document of the files: file_id, ordinal (from 0), n_tokens (without
    the separator), ended (false for tokens after a file's last separator).

    ``blocks`` has file_id, block (counted from 0 without gaps) and content; a null content is an empty block. Two separators in a
    row enclose an empty document. Blocks may be cut anywhere between ids.
    """
    parts = blocks.select("file_id", "block", "content").mapInArrow(partial(_scan, end_id=end_id, width=width), SUMMARY)
    before = Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_tokens").over(before), F.lit(0))
    known = parts.withColumn("at", start).withColumn("ordinal0", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
    known = known.withColumn("open_at", F.coalesce(F.max(F.col("at") + F.col("last_end")).over(before), F.lit(0)))
    known = known.withColumn("after", F.lead("block").over(Window.partitionBy("file_id").orderBy("block")))
    closed = known.select("file_id", "at", "ordinal0", "open_at", F.posexplode("lengths").alias("k", "length")).select(
        "file_id",
        (F.col("ordinal0") + F.col("k")).alias("ordinal"),
        F.when(F.col("k") == 0, F.col("length") + F.col("at") - F.col("open_at")).otherwise(F.col("length")).alias("n_tokens"),
        F.lit(True).alias("ended"),
    )
    tail_at = F.coalesce(F.col("at") + F.col("last_end"), F.col("open_at"))
    tail = known.where(F.col("after").isNull()).select("file_id", (F.col("ordinal0") + F.col("n_ends")).alias("ordinal"), (F.col("at") + F.col("n_tokens") - tail_at).alias("n_tokens"), F.lit(False).alias("ended"))
    return closed.unionByName(tail.where("n_tokens > 0"))
