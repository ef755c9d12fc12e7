"""Similarity join of word n-gram sets by partition-and-enumerate signatures.

Sets whose sizes lie in one band, or in two bands that follow each other, differ in at most k elements if they are
similar enough. The domain of hashed n-grams is cut into first-level partitions, few enough that in one of them at
most one element differs; that one is cut again, and every choice of all but one of its parts (of two, so each) is a signature.
Sets that are similar enough thus share a signature. Sets that share one are compared on their whole elements.

Parts without elements say nothing, and unrelated sets would share them, so a signature that keeps only such parts is left out. There are
spare first-level partitions for those that lose one by that: with m of them, m + 1 have at most one differing element in any similar pair.
A set in which more than m partitions have an empty signature, of whatever size, lets these go on with an element instead: the smallest that
two similar sets have in common is, in either, preceded by no more elements than the other may lack, so such a set puts one signature for
each of its first elements in the empty one's place (:func:`signatures`).

Copies are one set from the start. Within the sets that share a signature not all pairs are made: each set is compared with one
that leads a signature of its own, then twice with the nearest one of another component; only where that leaves several components are
all pairs across them compared, unless a parity sketch proves that they differ too much. So no link that joins two components is lost.
Signatures of more than BLOCK sets are cut into blocks there, and each two blocks meet in a task of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .hashing import FOLDED, U, between, grams, mix, passes, prefix, signed, text_bytes, trimmed, words
from .scratch import bucketed, drop, free, release, saved

SHINGLE = 4
PERCENT = 85
#: Second-level parts of a partition; a signature leaves out one.
PARTS = 2
#: Bits of the table that keeps most sets without candidates out of the second pass.
FILTER_BITS = 24
#: Members of a signature compared at once with as many others.
BLOCK = 512
#: Words of 64 bits of a parity sketch.
SKETCH = 16
#: Rounds in which a set is compared with the nearest one of another component, before all others are.
NEAREST = 2
_WORD = np.ones(256, bool)
_WORD[[32, *range(9, 14)]] = False


def shingle_sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each row with its sorted distinct hashed n-grams; a text of fewer words has its whole sequence as one, without words none."""
    data, bounds = text_bytes(batch.column("text"))
    starts, ends, rows = words(data, bounds, _WORD)
    hashes = between(prefix(data, FOLDED), starts, ends)
    found, owner = grams(hashes, rows, size)
    at = np.searchsorted(owner, np.arange(batch.num_rows + 1))
    word_at = np.searchsorted(rows, np.arange(batch.num_rows + 1))
    for row in range(batch.num_rows):
        if at[row] < at[row + 1]:
            yield row, np.unique(found[at[row] : at[row + 1]])
        elif n := word_at[row + 1] - word_at[row]:
            own = hashes[word_at[row] : word_at[row + 1]]
            yield row, grams(own, np.zeros(n, np.int64), int(n))[0]
        else:
            yield row, found[:0]


def set_id(elements: np.ndarray) -> int:
    """A 64-bit name of the set; equal sets have equal names."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(elements).sum(dtype=U) + U(len(elements))], U)).view(np.int64)[0])


@cache
def bands(percent: int, most: int) -> list[int]:
    """Lower ends of the size bands up to ``most``: sets similar enough lie in one band or in neighbours."""
    ends = [1]
    while ends[-1] <= most:
        ends.append(ends[-1] * 100 // percent + 1)
    return ends


@cache
def differing(percent: int, largest: int) -> int:
    """How many elements similar sets differ in at most, the smaller having at most ``largest``."""
    other = largest * 100 // percent
    return (largest + other) * (100 - percent) // (100 + percent)


@cache
def partitions(percent: int, smallest: int, k: int) -> tuple[int, int]:
    """First-level partitions for sets of ``smallest`` elements or more that differ in at most k, and how many of these are spare.

    As many are spare as give the fewest signatures, their own parts and those of first elements taken together: the number of partitions
    with an empty signature is taken as normal about its mean. Right results do not depend on how many are spare.
    """
    least = k // 2 + 1  # of so many partitions one has at most one differing element
    firsts = smallest + percent * smallest // -100 + 1
    best, spare = math.inf, 0
    for more in range(least + 1 if k else 0):
        if PARTS * more >= best:
            break
        mean = smallest / (least + more)
        empty = (least + more) * (PARTS * math.exp(mean / PARTS - mean) - (PARTS - 1) * math.exp(-mean))
        cost = PARTS * more + empty * firsts * math.erfc((more + 0.5 - empty) / math.sqrt(2 * empty)) / 2
        if cost < best:
            best, spare = cost, more
    return least + spare, spare


def signatures(elements: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of a sorted set in the instances of its band and of the band below; each is of one element at least.

    No pair is lost. Of two similar sets at least ``spare`` + 1 partitions have at most one differing element, and leaving out its part gives
    both the same signature there. Either it is not empty in one of these partitions, and both have it; or it is empty in all of them, in
    both sets, so both have more than ``spare`` partitions with an empty signature, and both have these with each of their first elements, so
    far as they may differ and one further: the smallest element they share is among these in both.
    """
    n, out = len(elements), []
    ends = bands(percent, 1 << max(4, n.bit_length()))
    band = int(np.searchsorted(ends, n, "right")) - 1
    value = mix(elements ^ U(0x5BD1E995))
    high, low = (value >> U(32)).astype(float), (value & U(0xFFFFFFFF)).astype(float)
    for instance in (band, band - 1):
        if instance < 0:
            continue
        k = differing(percent, ends[instance + 1] - 1)
        first, spare = partitions(percent, ends[instance], k)
        parts = 1 if k == 0 else PARTS
        place = (elements % U(first * parts)).astype(np.int64)
        sums = (np.bincount(place, high, first * parts).astype(U) << U(32)) + np.bincount(place, low, first * parts).astype(U)
        sums = sums.reshape(first, parts)
        kept = sums if parts == 1 else sums.sum(1, dtype=U, keepdims=True) - sums
        number = np.arange(first * parts, dtype=U) + U((instance + 1) << 40)
        own = mix(mix(kept.ravel()) + mix(number))
        empty = kept == 0  # no elements have the sum 0
        if int(empty.any(1).sum()) > spare:
            firsts = value[: n + percent * n // -100 + 1]
            out.append(mix(own[empty.ravel()][:, None] + firsts[None, :]).ravel())
        out.append(own[~empty.ravel()])
    return np.concatenate(out)


def sketch(elements: np.ndarray) -> np.ndarray:
    """Parities of the counts of elements in 64 * SKETCH cells: two sketches differ in no more bits than the sets in elements."""
    odd = np.bincount((mix(elements) % U(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_sketch(elements: np.ndarray) -> bytes:
    """As :func:`sketch`, with four to eight cells an element, a power of two of them: halves laid over each other are the sketch of half the cells."""
    cells = 1 << max(6, (4 * len(elements) - 1).bit_length())
    odd = np.bincount((mix(elements) % U(cells)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _apart(a: bytes, b: bytes) -> int:
    """In how many cells two wide sketches differ, at the size of the smaller."""
    x, y = (np.frombuffer(v, np.uint8) for v in (a, b))
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


@trimmed
def _close(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs that their wide sketches do not rule out."""
    for batch in batches:
        total = (batch.column("na").to_numpy() + batch.column("nb").to_numpy()).tolist()
        ok = [_apart(a.as_buffer(), b.as_buffer()) * (100 + percent) <= t * (100 - percent) for a, b, t in zip(batch.column("wa"), batch.column("wb"), total, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


@trimmed
def _named(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in passes(whole):
            sets = [s for _, s in shingle_sets(batch, size)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64())], names=["doc_id", "key", "n_shingles", "sid"])


@trimmed
def _signed(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in passes(whole):
            seen: dict[int, np.ndarray] = {}
            for _, s in shingle_sets(batch, size):
                if len(s) and (sid := set_id(s)) not in seen:
                    seen[sid] = signatures(s, percent)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(list(seen.values())))), pa.array(np.repeat(np.array(list(seen), np.int64), [len(x) for x in seen.values()]))], names=["sig", "sid"])


def larger(batches: Iterator[pa.RecordBatch], rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The batches put together to at least so many rows, the last aside; none is empty."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Columns of sorted batches, cut where ``key`` changes: the rows of one key or more."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        last = int(np.searchsorted(now[key], now[key][-1]))
        if last or (held and held[-1][key][-1] != now[key][0]):
            parts = [*held, {n: v[:last] for n, v in now.items()}]
            yield {n: np.concatenate([p[n] for p in parts]) for n in now}
            held = []
        held.append({n: v[last:] for n, v in now.items()})
    if held:
        yield {n: np.concatenate([p[n] for p in held]) for n in held[0]}


@trimmed
def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (sig, sid): those whose signature several sets have, with the smallest of these. One row is remembered."""
    before: tuple[int, int, int] | None = None  # the last row's signature, set and smallest set
    waiting = False  # whether that row is its signature's only one so far
    for batch in larger(batches):
        sig, sid = batch.column("sig").to_numpy(), batch.column("sid").to_numpy()
        same = np.zeros(len(sig), bool)
        same[1:] = (sig[1:] == sig[:-1]) & (sid[1:] == sid[:-1])
        same[0] = before is not None and (sig[0], sid[0]) == before[:2]
        sig, sid = sig[~same], sid[~same]
        if not len(sig):
            continue
        head = np.ones(len(sig), bool)
        head[1:] = sig[1:] != sig[:-1]
        head[0] = before is None or sig[0] != before[0]
        at = np.maximum.accumulate(np.where(head, np.arange(len(sig)), -1))
        lead = np.where(at >= 0, sid[at], before[2] if before else 0)
        kept = ~head | np.append(~head[1:], False)
        rows = [x[kept] for x in (sig, sid, lead)]
        if waiting and not head[0]:
            rows = [np.append(x, v) for x, v in zip(rows, (before[0], before[2], before[2]), strict=True)]
        before, waiting = (sig[-1], sid[-1], lead[-1]), bool(head[-1])
        if len(rows[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["sig", "sid", "lead"])


@trimmed
def _elements(batches: Iterator[pa.RecordBatch], size: int, wanted) -> Iterator[pa.RecordBatch]:
    table = wanted.value
    for whole in batches:
        for batch in passes(whole):
            seen: dict[int, np.ndarray] = {}
            for _, s in shingle_sets(batch, size):
                if len(s):
                    sid = set_id(s)
                    at = sid & ((1 << FILTER_BITS) - 1)
                    if sid not in seen and table[at >> 6] >> U(at & 63) & U(1):
                        seen[sid] = s
            if seen:
                sketches = np.array([sketch(s) for s in seen.values()])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(seen), pa.int64()), pa.array([len(s) for s in seen.values()], pa.int64()), *(pa.array(sketches[:, i]) for i in range(SKETCH)), pa.array([wide_sketch(s) for s in seen.values()], pa.binary()), pa.array([signed(s) for s in seen.values()], pa.list_(pa.int64()))],
                    names=["sid", "n", *(f"k{i}" for i in range(SKETCH)), "wide", "elements"],
                )


@trimmed
def _across(batches: Iterator[pa.RecordBatch], percent: int, nearest: bool) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by ``meet``, those of a block of a signature and of another or the same: pairs of sets in different components
    whose sizes and sketches do not rule them out; or of each set of the first block the nearest such set alone."""
    for now in runs(larger(batches), "meet"):
        meet, roots = now["meet"], now["root"]
        cuts = np.flatnonzero(meet[1:] != meet[:-1]) + 1
        start, end = np.append(0, cuts), np.append(cuts, len(meet))
        mixed = np.minimum.reduceat(roots, start) != np.maximum.reduceat(roots, start)
        bits = np.column_stack([now[f"k{i}"] for i in range(SKETCH)]).view(U)
        for a, b in zip(start[mixed].tolist(), end[mixed].tolist(), strict=True):
            n, root, sid, block, own = now["n"][a:b], roots[a:b], now["sid"][a:b], now["block"][a:b], bits[a:b]
            first = block == block.min()
            x, y = (first, first) if first.all() else (first, ~first)
            total = n[x][:, None] + n[y][None, :]
            apart = np.zeros(total.shape, np.int64)
            for c in range(SKETCH):
                apart += np.bitwise_count(own[x, c][:, None] ^ own[y, c][None, :])
            ok = (root[x][:, None] != root[y][None, :]) & (apart * (100 + percent) <= total * (100 - percent))
            ok &= np.minimum(n[x][:, None], n[y][None, :]) * 100 >= np.maximum(n[x][:, None], n[y][None, :]) * percent
            if nearest:
                left = np.flatnonzero(ok.any(1))
                right = np.where(ok[left], apart[left], 1 << 40).argmin(1)
            else:
                left, right = np.nonzero(np.triu(ok, 1) if first.all() else ok)
            if len(left):
                p, q = sid[x][left], sid[y][right]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(apart[left, right])], names=["a", "b", "apart"])


def in_blocks(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of signatures (sig, sid, count) with the block each is in and ``meet``, a key for each two blocks of a signature that must meet."""
    blocks = F.ceil(F.col("count") / block).cast("long")
    own = members.withColumn("block", F.pmod(F.xxhash64("sid"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return own.withColumn("meet", F.xxhash64("sig", F.least("block", "other"), F.greatest("block", "other"))).drop("other", "count")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by exact integer arithmetic on whole sets, which only pairs that wide sketches leave open fetch."""
    sizes = [sets.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"w{x}")) for x in "ab"]
    pairs = pairs.join(sizes[0], "a").join(sizes[1], "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b", "na", "nb", "wa", "wb")
    pairs = pairs.mapInArrow(partial(_close, percent=percent), "a long, b long")
    left = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("elements").alias("ea"))
    right = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("elements").alias("eb"))
    both = F.size(F.array_intersect("ea", "eb"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.where(both * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b")


def distinct_groups(shared: DataFrame) -> DataFrame:
    """Of signatures (sig, sid, lead) that the very same sets share, one alone: similar sets share many, and each would compare them anew.

    Groups are told apart by their size and by 128 bits of hashes of their sets.
    """
    marks = shared.groupBy("sig").agg(F.bit_xor(F.xxhash64("sid")).alias("f"), F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("g"), F.count("*").alias("n"))
    return shared.join(marks.groupBy("f", "g", "n").agg(F.min("sig").alias("sig")).select("sig"), "sig", "left_semi")


def stars(shared: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """For each set, the smallest set (a) of one of its signatures whose sketch is nearest to its own (b), unless all are too far.

    Any choice will do, as what it leaves apart is compared later; a near one joins most.
    """
    of = lambda name: sets.select(F.col("sid").alias(name), F.col("n").alias(f"n{name}"), *(F.col(f"k{i}").alias(f"{name}{i}") for i in range(SKETCH)))
    pairs = shared.where("sid != lead").select(F.col("lead").alias("a"), F.col("sid").alias("b")).distinct().join(of("a"), "a").join(of("b"), "b")
    apart = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(1, SKETCH)), F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))))
    near = pairs.select("a", "b", apart.alias("apart"), (F.col("na") + F.col("nb")).alias("total")).where(F.col("apart") * (100 + percent) <= F.col("total") * (100 - percent))
    return near.groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("a")).select("a", "b")


def bit_table(ids: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A table of 2**bits bits in which those of the ids are set: at most 2**(bits - 6) rows reach the driver."""
    low = F.col("sid").bitwiseAND((1 << bits) - 1)
    cells = ids.select(F.shiftright(low, 6).alias("cell"), F.expr(f"shiftleft(1L, cast((sid & {(1 << bits) - 1}) & 63 as int))").alias("bit")).groupBy("cell").agg(F.expr("bit_or(bit)").alias("bits"))
    table = np.zeros(1 << bits - 6, np.int64)
    found = cells.toArrow()
    table[found.column("cell").to_numpy()] = found.column("bits").to_numpy()
    return table.view(U)


def linked(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, its own included) for each row of ``docs``.

    Two rows link where 100 * intersection >= percent * union of their sets of ``size``-word n-grams. A null or empty text, or
    one without words, links with nothing. Repeated rows link with each other. A null id is never the smallest; a component of
    null ids alone has a null component_id. An empty table gives no rows; other columns are ignored.
    """
    return _classes(docs, size, percent).select("doc_id", "n_shingles", "component_id")


def _classes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """As :func:`linked`, with ``key``, a hash of the row's text, and ``root``, which the rows of a component share; without words that is the key."""
    spark, texts = docs.sparkSession, docs.select("doc_id", "text")
    keyed = texts.withColumn("key", F.xxhash64("text"))
    named = saved(keyed.mapInArrow(partial(_named, size=size), "doc_id long, key long, n_shingles long, sid long"), "sets")
    signs = texts.select("doc_id", "text").mapInArrow(partial(_signed, size=size, percent=percent), "sig long, sid long")
    dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = saved(signs.repartition(dealt, "sig").sortWithinPartitions("sig", "sid").mapInArrow(_shared, "sig long, sid long, lead long"), "shared")
    del signs
    release(spark)  # the signatures' exchange is by far the largest
    every, shared = shared, saved(distinct_groups(shared), "groups")
    drop(every)
    wanted = spark.sparkContext.broadcast(bit_table(shared.select("sid")))
    columns = {"n": "long"} | {f"k{i}": "long" for i in range(SKETCH)} | {"wide": "binary", "elements": "array<long>"}
    found = texts.mapInArrow(partial(_elements, size=size, wanted=wanted), ", ".join(f"{n} {t}" for n, t in ({"sid": "long"} | columns).items()))
    sets = bucketed(found.groupBy("sid").agg(*[F.first(c).alias(c) for c in columns]), "elements", "sid")
    del found
    release(spark)
    small = sets.drop("wide", "elements")

    def across(roots: DataFrame, nearest: bool) -> DataFrame:
        members = shared.select("sig", "sid").join(roots, F.col("sid") == F.col("node"), "left").select("sig", "sid", F.coalesce("root", "sid").alias("root"))
        mixed = members.groupBy("sig").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("count")).where("x != y").select("sig", "count")
        rest = in_blocks(members.join(mixed, "sig")).join(small, "sid").repartition(dealt, "meet").sortWithinPartitions("meet", "sid")
        found = rest.mapInArrow(partial(_across, percent=percent, nearest=nearest), "a long, b long, apart long")
        if not nearest:
            return found.select("a", "b").distinct()
        return found.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b"))

    links = saved(verified(stars(shared, sets, percent), sets, percent), "pairs")
    final = components(links)
    for nearest in (*[True] * NEAREST, False):
        more = saved(verified(across(final, nearest), sets, percent), "pairs")
        if not more.isEmpty():
            links, old = saved(links.unionByName(more), "pairs"), links
            final = components(links)
            drop(old)
        drop(more)
        release(spark)
    for table in (shared, sets, links):
        drop(table)

    root = named.join(final, F.col("sid") == F.col("node"), "left").select("doc_id", "key", "n_shingles", F.coalesce("root", "sid").alias("root"))
    some = root.where("n_shingles > 0")
    least = saved(some.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")  # a table, so that rows of a frequent root can be split
    none = root.where("n_shingles = 0").withColumn("root", F.col("key")).withColumn("component_id", F.col("doc_id"))
    return some.join(least, "root").select("doc_id", "key", "n_shingles", "component_id", "root").unionByName(none)


def without_copies(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Of each component of :func:`linked` the row of ``docs`` with the smallest doc_id, with all its columns.

    Rows of one doc_id are judged each by its own text: of those with the smallest id that one component holds, one stays (of texts the
    one of the smallest hash), and texts in no other component stay as well. Rows with a null doc_id stay, and so do those without words,
    of those equal in doc_id and text one.
    """
    names, own, key, twice = docs.columns, free(docs, "__doc"), free(docs, "__text"), free(docs, "__again")
    rows = _classes(docs, size, percent).where("doc_id is not null").select(F.col("doc_id").alias(own), F.col("key").alias(key), "component_id", "root")
    same = (F.col("doc_id") == F.col(own)) & (F.xxhash64("text") == F.col(key))
    kept = docs.join(rows.where(F.col(own) != F.col("component_id")).select(own, key).distinct(), same, "left_anti")
    again = saved(docs.select("doc_id").where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(twice)), "again")
    if again.isEmpty():
        return kept
    single = kept.join(again, F.col("doc_id") == F.col(twice), "left_anti")
    several = rows.join(again, F.col(own) == F.col(twice), "left_semi").groupBy(own, "root").agg(F.min(key).alias(key)).select(own, key)
    return single.unionByName(kept.join(several, same, "left_semi").dropDuplicates(["doc_id", "text"])).select(*[F.col(f"`{n}`") for n in names])
