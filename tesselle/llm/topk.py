"""Exact top-k inner products by Fagin's threshold algorithm over blocks.

Vectors of like direction are put together and cut into blocks. In a block every dimension has a list of all its rows in
order of their component. A query reads the lists of its dimensions side by side, from the end that its sign asks for; each row met
for the first time is scored whole. No row that is still unread can score more than the sum of the components where reading
stands, each times the query's, so reading stops when that bound cannot beat the k-th best score so far.

The query set meets the blocks as blocks: neither grows with the other, and only a query's best of a block leave it. A query goes
to a block only where the largest and smallest component of each dimension let it reach a score that k rows of a bounded sample, an eighth
of the table at most, do; the vectors of the two meet after that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, saved

SCALE = 64
EVERY = 20
K = 20
#: Rows of a data block and of a query block.
BLOCK, QUERIES = 8192, 256
#: Rows of the sample that gives first bounds, at most and for how many rows of the table one, and those that the directions are fitted on.
SAMPLE, ONE_IN, FITTED, DIRECTIONS = 16384, 8, 2048, 32
#: Query blocks, and edges of data blocks, that one task compares at once.
QUERY_PAGE, EDGE_PAGE = 32, 1024
#: Places of each list that are read at first; every time as many more as have been read.
STEP = 4
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
BLOCKS = "block long, n long, dims long, ids binary, vectors binary"
ASKED = "block long, qpage long, q_n long, q_ids binary, q_vectors binary, low binary"
FOUND = "query_id long, vec_id long, score long"
_BLOCKS = pa.schema([*((n, pa.int64()) for n in ("block", "n", "dims")), *((n, pa.binary()) for n in ("ids", "vectors"))])
_ASKED = pa.schema([*((n, pa.int64()) for n in ("block", "qpage", "q_n")), *((n, pa.binary()) for n in ("q_ids", "q_vectors", "low"))])
_FOUND = pa.schema([(n, pa.int64()) for n in ("query_id", "vec_id", "score")])


def whole(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and vectors floor(scale * x) of the rows that take part: no null id, no null or empty vector, no null or non-finite component."""
    ids, lists = batch.column(0), batch.column(1)
    if not len(ids):
        return np.zeros(0, np.int64), []
    bounds = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null is no number
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    keep = np.array(lists.is_valid()) & np.array(ids.is_valid()) & (bounds[1:] > bounds[:-1]) & (bad[bounds[1:]] == bad[bounds[:-1]])
    scaled = np.floor(scale * values)
    rows = np.flatnonzero(keep)
    return ids.take(pa.array(rows)).to_numpy().astype(np.int64), [scaled[a:b] for a, b in zip(bounds[rows], bounds[rows + 1], strict=True)]


def stacked(vectors: list[np.ndarray], dims: int) -> np.ndarray:
    """One matrix; shorter vectors are continued with zeros, which change no inner product."""
    out = np.zeros((len(vectors), dims))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def packed(matrix: np.ndarray) -> bytes:
    """The matrix in 2 bytes a component where they suffice, else in 8; the first byte tells."""
    small = not matrix.size or np.abs(matrix).max() < 32768
    return (b"s" if small else b"w") + matrix.astype("<i2" if small else "<f8").tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    kind = "<i2" if data[:1] == b"s" else "<f8"
    return np.frombuffer(data, kind, offset=1).reshape(n, -1).astype(np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products as integers; those beyond 64 bits become the outermost value."""
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] if a.size and b.size else 0
    if most < 2**53:  # no sum can be more than floating point holds
        return (a @ b.T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = np.vectorize(int, otypes=[object])
    return np.clip(exact(a) @ exact(b).T, LOWEST, HIGHEST).astype(np.int64)


def _rows(batches: Iterator[pa.RecordBatch], scale: int, centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, vectors = whole(batch, scale)
        if len(ids):
            near = np.argmax(stacked([v[: centres.shape[1]] for v in vectors], centres.shape[1]) @ centres.T, 1)
            yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(ids), pa.array([packed(v) for v in vectors], pa.binary())], names=["near", "vec_id", "vector"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One query of each id: of different vectors the first by its components."""
    for batch in batches:
        queries = [min(vectors, key=lambda v: unpacked(v, 1)[0].tolist()) for vectors in batch.column("vectors").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("near"), batch.column("vec_id"), pa.array(queries, pa.binary())], names=["near", "vec_id", "vector"])


def _blocks(batches: Iterator[pa.RecordBatch], size: int, dims: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    base, made = TaskContext.get().partitionId() << 32, 0
    ids: list[int] = []
    vectors: list[bytes] = []

    def out() -> pa.RecordBatch:
        nonlocal made
        made += 1
        matrix = stacked([unpacked(v, 1)[0] for v in vectors[:size]], dims)
        row = [base + made - 1, len(ids[:size]), dims, np.array(ids[:size], np.int64).tobytes(), packed(matrix)]
        del ids[:size], vectors[:size]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCKS, strict=True)], schema=_BLOCKS)

    for batch in batches:
        ids += batch.column("vec_id").to_pylist()
        vectors += batch.column("vector").to_pylist()
        while len(ids) >= size:
            yield out()
    if ids:
        yield out()


def _with_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the largest and the smallest component of each dimension."""
    for batch in batches:
        edges = []
        for n, data in zip(batch.column("n").to_pylist(), batch.column("vectors").to_pylist(), strict=True):
            matrix = unpacked(data, n)
            edges.append(packed(np.stack([matrix.max(0), matrix.min(0)])))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(edges, pa.binary())], names=[*batch.schema.names, "edges"])


def best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -score))[:k]


def _first_bounds(batches: Iterator[pa.RecordBatch], sample, k: int) -> Iterator[pa.RecordBatch]:
    """Each query of a block with a score that k rows of the sample, itself left out, reach; the lowest of all without a sample."""
    for batch in batches:
        for row in batch.to_pylist():
            own = np.frombuffer(row["ids"], np.int64)
            low = np.full(len(own), LOWEST)
            if sample is not None:
                ids, matrix = sample.value
                scores = products(unpacked(row["vectors"], row["n"]), matrix)
                for i in range(len(own)):
                    s = scores[i][ids != own[i]]
                    if len(s) >= k:
                        low[i] = np.partition(s, len(s) - k)[len(s) - k]
            yield pa.RecordBatch.from_pylist([row | {"low": low.tobytes()}], schema=_BLOCKS.append(pa.field("low", pa.binary())))


def _reaching(key: tuple, queries: pa.Table, edges: pa.Table) -> pa.Table:
    """For each data block of a page, of each query block of a page the queries that it may hold a row for."""
    out = []
    blocks, dims = edges.column("block").to_pylist(), 0
    if blocks:
        edge = np.stack([unpacked(e, 2) for e in edges.column("edges").to_pylist()])
        dims = edge.shape[2]
        edge = edge.reshape(len(edge), 2 * dims)
    for row in queries.to_pylist() if blocks else []:
        q, ids, low = unpacked(row["vectors"], row["n"]), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["low"], np.int64)
        most = products(np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], 1), edge)
        for at, block in enumerate(blocks):
            open_ = most[:, at] >= low
            if open_.any():
                out.append((block, row["qpage"], int(open_.sum()), ids[open_].tobytes(), packed(q[open_]), low[open_].tobytes()))
    return pa.Table.from_pydict(dict(zip(_ASKED.names, map(list, zip(*out, strict=True)), strict=True)), schema=_ASKED) if out else _ASKED.empty_table()


class Lists:
    """A block with a sorted list of all its rows for every dimension."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.matrix = ids, matrix
        self.rising = np.argsort(matrix, 0, kind="stable").T.astype(np.int32)
        self.falling = self.rising[:, ::-1]
        self.reads = 0

    def search(self, own: int, query: np.ndarray, low: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows of the block that reach ``low``, ``own`` left out; ``reads`` counts places of lists."""
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        weights = query[np.concatenate([up, down])][None, :]
        n, depth, seen = len(self.ids), 0, self.ids == own
        new, ids, scores = np.zeros(n, bool), self.ids[:0], np.zeros(0, np.int64)
        if not weights.size and low <= 0:  # all rows score 0 and no list tells them apart
            places = np.flatnonzero(~seen)
            top = best(self.ids[places], np.zeros(len(places), np.int64), k)
            return self.ids[places[top]], np.zeros(len(top), np.int64)
        while depth < n and not seen.all():
            upto = min(n, max(STEP, 2 * depth))
            places = np.concatenate([self.falling[up, depth:upto].ravel(), self.rising[down, depth:upto].ravel()])
            self.reads += len(places)
            new[:] = False
            new[places] = True
            places = np.flatnonzero(new & ~seen)
            seen[places] = True
            score = products(query[None, :], self.matrix[places])[0] if len(places) else np.zeros(0, np.int64)
            keep = score >= low
            ids, scores = np.concatenate([ids, self.ids[places][keep]]), np.concatenate([scores, score[keep]])
            top = best(ids, scores, k)
            ids, scores = ids[top], scores[top]
            if len(ids) == k:
                low = max(low, int(scores[-1]))
            edge = np.concatenate([self.matrix[self.falling[up, upto - 1], up], self.matrix[self.rising[down, upto - 1], down]])
            if products(weights, edge[None, :])[0, 0] < low:  # an unread row can no longer be among the best, not even tie
                break
            depth = upto
        return ids, scores


def _search(key: tuple, data: pa.Table, asked: pa.Table, k: int, counted: tuple[Accumulator, ...] | None) -> pa.Table:
    """The best rows of a data block for each query that a page of queries has for it."""
    found = []
    for block in data.to_pylist():
        lists = Lists(np.frombuffer(block["ids"], np.int64), unpacked(block["vectors"], block["n"]))
        pairs = rows = 0
        for row in asked.to_pylist():
            ids, low = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["low"], np.int64)
            for i, query in enumerate(unpacked(row["q_vectors"], row["q_n"])):
                other, score = lists.search(int(ids[i]), query, int(low[i]), k)
                pairs, rows = pairs + 1, rows + len(lists.ids) * int(np.count_nonzero(query))
                found.append((np.full(len(other), ids[i]), other, score))
        if counted is not None:
            for counter, value in zip(counted, (pairs, lists.reads, rows), strict=True):
                counter.add(value)
    return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], schema=_FOUND) if found else _FOUND.empty_table()


def _centres(matrix: np.ndarray, n: int = DIRECTIONS, rounds: int = 5) -> np.ndarray:
    """Unit directions that the sample's rows gather around."""
    unit = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)
    centres = unit[:: max(1, len(unit) // n)][:n]
    for _ in range(rounds):
        near = np.argmax(unit @ centres.T, 1)
        sums = np.array([unit[near == c].sum(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centres


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = K, scale: int = SCALE, counted: tuple[Accumulator, ...] | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each row whose id is divisible by ``every``, the k rows of highest integer inner
    product of floor(scale * x), the query's own id left out; all, if fewer; ties go to the smaller id.

    Null ids, and vectors that are null, empty or hold a null or non-finite component, take no part. Shorter vectors are continued with
    zeros. Repeated rows each count as candidates, and a repeated query is asked once; where an id stands with different vectors, the
    query is the row whose vector comes first by its components, and all its rows stay candidates of others. A score beyond 64 bits is the outermost one. An
    empty table gives no rows. ``counted`` are three accumulators: pairs of a query and a block, places read in lists, places there were.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vec_id is not null and vector is not null")
    dims = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().combine_chunks()
    ids, found = whole(taken.to_batches()[0], scale) if taken.num_rows else (np.zeros(0, np.int64), [])
    if not dims or not len(ids):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    matrix = stacked(found, dims)
    near = saved(rows.mapInArrow(partial(_rows, scale=scale, centres=_centres(matrix[:FITTED])), "near long, vec_id long, vector binary"), "vectors")
    n = near.count()
    some = min(len(ids), n // ONE_IN)
    sample = spark.sparkContext.broadcast((ids[:some], matrix[:some])) if some >= k else None
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    make = lambda df, size, parts: df.repartitionByRange(max(1, min(tasks, parts)), "near", "vec_id").sortWithinPartitions("near", "vec_id").select("vec_id", "vector").mapInArrow(partial(_blocks, size=size, dims=dims), BLOCKS)
    data = saved(make(near, BLOCK, n // BLOCK + 1).mapInArrow(_with_edges, f"{BLOCKS}, edges binary"), "blocks")
    each = near.where(f"vec_id % {every} = 0").groupBy("vec_id").agg(F.min("near").alias("near"), F.collect_set("vector").alias("vectors"))
    asked = each.mapInArrow(_asked, "near long, vec_id long, vector binary")
    queries = saved(make(asked, QUERIES, n // every // QUERIES + 1).mapInArrow(partial(_first_bounds, sample=sample, k=k), f"{BLOCKS}, low binary"), "queries")
    page = lambda df, size: -(-df.count() // size) or 1
    epages, qpages = page(data.select("block"), EDGE_PAGE), page(queries.select("block"), QUERY_PAGE)
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    edges = data.select("block", "edges", F.pmod(F.xxhash64("block"), F.lit(epages)).alias("epage")).withColumn("qpage", all_of(qpages))
    paged = queries.withColumn("qpage", F.pmod(F.xxhash64("block"), F.lit(qpages))).withColumn("epage", all_of(epages))
    asks = saved(paged.groupBy("epage", "qpage").cogroup(edges.groupBy("epage", "qpage")).applyInArrow(_reaching, ASKED), "asks")
    meets = asks.select(F.col("block").alias("at"), F.col("qpage").alias("page")).distinct()
    sides = data.select("block", "n", "ids", "vectors").join(meets, F.col("block") == F.col("at")).drop("at")
    searched = sides.groupBy("block", "page").cogroup(asks.groupBy("block", "qpage")).applyInArrow(partial(_search, k=k, counted=counted), FOUND)
    out = saved(searched, "found")
    for table in (near, data, queries, asks):
        drop(table)
    best_first = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(best_first).cast("int")).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
