"""How the sources of each language differ in their terms: sketch-prefiltered counting and sparse pair joins.

A first pass over the texts adds every document's distinct terms to a count-min sketch of document frequencies, one a task; the tasks' sketches
are merged in rounds and the whole is broadcast, at most ``DEPTH << MOST_BITS`` bytes. It never underestimates, so a term below the least
document frequency in it is impossible, and the second pass drops it before anything is shuffled. Survivors are counted exactly, by their text.

Pairs of sources are summed without a row for a term that a source does not have: sums over a source's own terms follow from how many of its terms have each
count, and only terms that both have are joined, each pair of sources once. All arithmetic is on integers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hashing import FOLDED, LOWER, U, between, mix, passes, prefix, text_bytes, trimmed, words
from .scratch import drop, saved

#: Documents of a language that must hold a term, and the ranks of terms that are reported.
LEAST_DOCS, RANKS = 3, 200
#: The integer that stands for a share of 1.
ONE = 1_000_000_000
#: Rows of the sketch; bits of a row's size, by the bytes of all texts; counters of a slice; sketches or merged sketches that a round merges.
DEPTH, LEAST_BITS, MOST_BITS, SLICE, FAN = 4, 12, 24, 1 << 16, 64
BYTES_A_COUNTER = 1024
#: Rows of counts that a task holds before it hands them on.
HELD = 200_000
#: Terms are runs of letters and of bytes from 128 on, which no ASCII separator cuts.
MEMBER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
COUNTS = "lang string, source string, term string, n long, docs long"


def filled(docs: DataFrame) -> DataFrame:
    """lang, source and text of every row, null taken as empty."""
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


# What is done within a task.


def terms(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms of a batch; and for each distinct term of a row: the row, the term's number, and how often it stands there."""
    data, bounds = text_bytes(batch.column("text"))
    starts, ends, rows = words(data, bounds, MEMBER)
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    values = LOWER[data[MEMBER[data]]]
    all_ = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(values)]).dictionary_encode()
    codes = all_.indices.to_numpy()
    pairs, counts = np.unique(rows * max(len(all_.dictionary), 1) + codes, return_counts=True)
    return all_.dictionary, pairs // max(len(all_.dictionary), 1), pairs % max(len(all_.dictionary), 1), counts


def _hashes(column: pa.Array, table: np.ndarray = FOLDED) -> np.ndarray:
    column = column.cast(pa.large_string()) if not pa.types.is_large_binary(column.type) else column.view(pa.large_string())
    data, bounds = text_bytes(column)
    return between(prefix(data, table), bounds[:-1], bounds[1:])


def _keys(languages: np.ndarray, names: np.ndarray, rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of (lang, term)."""
    with np.errstate(over="ignore"):
        return mix(languages[rows] * U(3) + names[codes])


def places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The counter of each key in each row of the sketch."""
    for row in range(DEPTH):
        with np.errstate(over="ignore"):
            yield (mix(keys + U(0x9E3779B97F4A7C15) * U(row + 1)) >> U(64 - bits)).astype(np.int64)


def add(sketch: np.ndarray, keys: np.ndarray) -> None:
    """Counts each key once more; a counter stops at its greatest value."""
    for row, at in zip(sketch, places(keys, sketch.shape[1].bit_length() - 1), strict=True):
        where, n = np.unique(at, return_counts=True)
        row[where] = np.minimum(row[where] + n, np.iinfo(sketch.dtype).max)


def estimate(sketch: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """At least as often as each key was counted, up to the greatest value of a counter."""
    return np.minimum.reduce([row[at] for row, at in zip(sketch, places(keys, sketch.shape[1].bit_length() - 1), strict=True)])


@trimmed
def _sketched(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    sketch = np.zeros((DEPTH, 1 << bits), np.uint8)
    for batch in batches:
        for part in passes(batch):
            names, rows, codes, _ = terms(part)
            add(sketch, _keys(_hashes(part.column("lang")), _hashes(names), rows, codes))
    flat = sketch.ravel()
    for k in range(0, len(flat), SLICE):
        if flat[k : k + SLICE].any():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([k // SLICE], pa.int32()), pa.array([zlib.compress(flat[k : k + SLICE].tobytes(), 1)], pa.binary())], names=["part", "slice", "counters"])


def _merged(key: tuple, rows: pa.Table) -> pa.Table:
    total = None
    for packed in rows.column("counters"):
        more = np.frombuffer(zlib.decompress(packed.as_buffer()), np.uint8).astype(np.int64)
        total = more if total is None else np.minimum(total + more, 255)
    return pa.table({"part": pa.array([key[1].as_py()], pa.int64()), "slice": pa.array([key[0].as_py()], pa.int32()), "counters": pa.array([zlib.compress(total.astype(np.uint8).tobytes(), 1)], pa.binary())})


def _summed(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return out.rename_columns([c.removesuffix("_sum") for c in out.column_names]).select(["lang", "source", "term", "n", "docs"])


@trimmed
def _counted(batches: Iterator[pa.RecordBatch], sketch: Broadcast) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for part in passes(batch):
            names, rows, codes, counts = terms(part)
            possible = estimate(sketch.value, _keys(_hashes(part.column("lang")), _hashes(names), rows, codes)) >= LEAST_DOCS
            rows, codes, counts = rows[possible], codes[possible], counts[possible]
            if not len(rows):
                continue
            # a group is a lang and a source: the first row that has them stands for it
            groups, first = {}, []
            of = np.empty(part.num_rows, np.int64)
            for i, pair in enumerate(zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)):
                if pair not in groups:
                    groups[pair] = len(first)
                    first.append(i)
                of[i] = groups[pair]
            keys, where = np.unique(of[rows] * len(names) + codes, return_inverse=True)
            n, docs = np.bincount(where, counts).astype(np.int64), np.bincount(where)
            here = part.select(["lang", "source"]).take(pa.array(np.array(first)[keys // len(names)]))
            term = names.take(pa.array(keys % len(names))).cast(pa.large_string()).cast(pa.string())
            held.append(pa.table({"lang": here.column("lang"), "source": here.column("source"), "term": term, "n": pa.array(n), "docs": pa.array(docs)}))
            size += len(keys)
            if size > HELD:
                held = [_summed(held)]
                size = held[0].num_rows
                if size > HELD // 2:
                    yield from held.pop().to_batches()
                    size = 0
    if held:
        yield from _summed(held).to_batches()


# Sketch and counts.


def frequencies(texts: DataFrame) -> np.ndarray:
    """The merged sketch of the document frequencies of (lang, term); its size follows the bytes of the texts, up to a bound."""
    spark = texts.sparkSession
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max((total // BYTES_A_COUNTER).bit_length(), LEAST_BITS), MOST_BITS)
    kinds = "part long, slice int, counters binary"
    written = parts = saved(texts.select("lang", "text").mapInArrow(lambda batches: _sketched(batches, bits), kinds), "sketches")
    left = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = parts.groupBy("slice", F.expr(f"part div {FAN}").alias("__into")).applyInArrow(_merged, kinds)
        left = -(-left // FAN)
        if left == 1:
            break
    out = np.zeros(DEPTH << bits, np.uint8)
    for r in parts.toLocalIterator():
        counters = np.frombuffer(zlib.decompress(r.counters), np.uint8)
        out[r.slice * SLICE : r.slice * SLICE + len(counters)] = counters
    drop(written)
    return out.reshape(DEPTH, -1)


def kept_counts(texts: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), total (in the lang) and head (one row of each term) of the terms that enough documents of a lang hold."""
    spark = texts.sparkSession
    sketch = spark.sparkContext.broadcast(frequencies(texts))
    counted = texts.mapInArrow(lambda batches: _counted(batches, sketch), COUNTS)
    # counts are summed within tasks; one exchange serves the sums, the document frequencies and the totals
    summed = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    ranked = summed.select("*", F.sum("docs").over(term).alias("df"), F.sum("n").over(term).alias("total"), (F.row_number().over(term.orderBy("source")) == 1).alias("head"))
    return saved(ranked.where(F.col("df") >= LEAST_DOCS).select("lang", "source", "term", "n", "total", "head"), "counts")


# Shares and divergences.


def share(n: Column | str, of: Column | str, kinds: Column | str) -> Column:
    """1 + floor(ONE * (n + 1) / (of + kinds)); null where that is no number."""
    n, of, kinds = (F.col(c) if isinstance(c, str) else c for c in (n, of, kinds))
    exact = lambda c: c.cast("decimal(20,0)")
    whole = F.call_function("div", exact(n + 1) * F.lit(ONE).cast("decimal(10,0)"), F.nullif(exact(of + kinds), F.lit(0).cast("decimal(20,0)")))
    return F.lit(1).cast("bigint") + whole


def gap(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank: how far each source's terms are from every other source's of its lang (part ``pair``), and the terms
    of which it has more than its lang (part ``term``), the first :data:`RANKS`.

    Null lang, source and text count as empty; repeated rows count as often as they stand; a group without terms has pairs too, and a lang
    without kept terms pairs of value 0; ties are ranked by the item's bytes; an empty table gives no rows. Other columns are not read.
    """
    texts = filled(docs)
    kept = kept_counts(texts)
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("has"))
    whole = kept.groupBy("lang").agg(F.sum("n").alias("lang_size"), F.count_if("head").alias("kinds"))
    names = texts.select("lang", "source").distinct()
    groups = names.join(own, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0, ["size", "has", "lang_size", "kinds"])
    groups = saved(groups.withColumn("p0", share(F.lit(0), "size", "kinds")), "groups")
    rows = kept.join(groups.select("lang", "source", "size", "kinds", "lang_size", "p0"), ["lang", "source"]).withColumn("p", share("n", "size", "kinds"))

    # of a lang's sources each with each other: sums over own terms by count, as if the other had none of them
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("has").alias("item_has"))
    alone = rows.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("m")).join(other, "lang").where("source != item")
    alone = alone.select("lang", "source", "item", (F.col("m") * gap("p", "q0")).alias("there"), (F.col("m") * gap("q0", "p")).alias("back"))
    alone = alone.groupBy("lang", "source", "item").agg(F.sum("there").alias("there"), F.sum("back").alias("back"))
    first = alone.select("lang", "source", "item", F.col("there").alias("value"))
    second = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value"))
    # and what terms that both have differ from that
    a = rows.select("lang", "term", "source", "p", "p0")
    b = rows.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = a.join(b, ["lang", "term"]).where("source < item").select("lang", "source", "item", (gap("p", "q") - gap("p", "q0") - gap("p0", "q") + gap("p0", "q0")).alias("there"), (gap("q", "p") - gap("q0", "p") - gap("q", "p0") + gap("q0", "p0")).alias("back"))
    both = both.groupBy("lang", "source", "item").agg(F.sum("there").alias("there"), F.sum("back").alias("back"))
    third = both.select("lang", F.inline(F.array(F.struct("source", "item", F.col("there").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))))
    # terms that neither has
    empty = groups.join(other, "lang").where("source != item").select("lang", "source", "item", F.coalesce((F.col("kinds") - F.col("has") - F.col("item_has")) * gap("p0", "q0"), F.lit(0)).alias("value"))
    pairs = first.unionByName(second).unionByName(third).unionByName(empty).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    best = rows.withColumn("q", share("total", "lang_size", "kinds")).where("p > q").select("lang", "source", F.col("term").alias("item"), gap("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(best, "term").where(F.col("rank") <= RANKS))
