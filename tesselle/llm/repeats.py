"""Removal of byte strings that occur more than once, over all documents, by suffix sorting.

Every stretch of ``length`` bytes picks the least of its short substrings (by hash); equal stretches pick the same one at
the same place, so they meet where picks meet. A pick owns the run of stretches that picked it, and so the bytes these span. Picks that
occur once are done with. Where all that picks own is equal, all their stretches repeat. Where it differs, one of each kind is sent,
with its bytes, to the shard of its pick. Stretches that lie alike about their pick share a core of bytes with those that begin a few places
from them; whose core no other context has about that pick cannot repeat and stays out. The suffixes of all the rest are put in order by induced sorting, and the
stretches whose neighbour in that order begins with the same ``length`` bytes repeat.

Rows of a pick are read as a sorted stream with one row of memory. All different contexts of a pick meet in one shard, however many they are:
a shard's text, and all that is made in sorting it, are files (:mod:`.induced`), so that its task needs time and disk for it but no memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import U, between, mix, passes, prefix, signed, text_bytes, trimmed
from .induced import MEMORY, Files, suffixes
from .scratch import free, saved

LENGTH = 200
#: Bytes of a pick.
PICK = 48
#: Bytes of text that a shard is planned for; a frequent pick can make one larger.
SHARD = 1 << 21
#: Bytes of text of one vectorised pass.
PASS = 1 << 18
#: Bits of the table of kinds to send, eight for each at least up to this power of two; beyond it, more is sent than need be.
MOST_BITS = 28
#: First bits of the parts of an id that set a bit each in its word of that table.
PARTS = (0, 58, 52, 46)
#: Places before a pick whose stretches share a core.
STEP = 20
PICKS = "pick long, kind long, key long, start long, stop long, sure boolean"
_PICK_NAMES = ["pick", "kind", "key", "start", "stop"]


def row_keys(batch: pa.RecordBatch, data: np.ndarray, bounds: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """A key of each row's id and text; rows equal in both are one document's copies and share all results."""
    ids = np.array(batch.column("doc_id").fill_null(-(1 << 62)).to_pylist(), np.int64).view(U)
    with np.errstate(over="ignore"):
        return mix(mix(ids) + between(sums, bounds[:-1], bounds[1:]) + U(1) * (bounds[1:] - bounds[:-1]).astype(U))


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n = len(values)
    pad = -n % width
    grid = np.concatenate([values, np.full(pad, np.iinfo(U).max, U)]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def picks(data: np.ndarray, bounds: np.ndarray, sums: np.ndarray, length: int = LENGTH, pick: int = PICK) -> tuple[np.ndarray, ...]:
    """Row, place of the pick, first and last owned stretch, all as places in ``data``."""
    none = (np.zeros(0, np.int64),) * 4
    n = len(data)
    if n < length:
        return none
    hashes = between(sums, np.arange(n - pick + 1), np.arange(pick, n + 1))
    bits = int(n).bit_length()
    ranked = (hashes >> U(bits) << U(bits)) | np.arange(len(hashes), dtype=U)
    chosen = (least_of(ranked, length - pick + 1) & U((1 << bits) - 1)).astype(np.int64)
    row = np.searchsorted(bounds, np.arange(len(chosen)), "right") - 1
    whole = np.arange(len(chosen)) + length <= bounds[row + 1]
    at = np.flatnonzero(whole)
    if not len(at):
        return none
    chosen, row = chosen[at], row[at]
    first = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1]))))
    last = np.append(first[1:], len(at)) - 1
    return row[first], chosen[first], at[first], at[last]


def _owned(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, ...]:
    """Bytes, bounds, pick hash, kind hash, row key, and the owned bytes [start, stop) in the batch, with their rows and the pick's place."""
    data, bounds = text_bytes(batch.column("text"))
    sums = prefix(data)
    row, place, first, last = picks(data, bounds, sums, length)
    pick = between(sums, place, place + PICK)
    with np.errstate(over="ignore"):
        kind = mix(between(sums, first, last + length) + (place - first).astype(U) * U(3) + (last - first).astype(U))
    return data, bounds, signed(pick), signed(kind), signed(row_keys(batch, data, bounds, sums)[row]), row, first, last + length, place


@trimmed
def _picked(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """What the picks own. Of equal kinds that one pass sees, one meets the other passes' under its pick; all are known to repeat
    at once (``sure``) and go wherever there is room, so that a pick that is everywhere sends each task few rows."""
    for whole in batches:
        for batch in passes(whole, most=PASS):
            _, bounds, pick, kind, key, row, start, stop, _ = _owned(batch, length)
            if not len(pick):
                continue
            own = np.stack([pick, kind, key, start - bounds[row], stop - bounds[row]])[:, np.lexsort((kind, pick))]
            same = (own[0, 1:] == own[0, :-1]) & (own[1, 1:] == own[1, :-1])
            head, sure = np.append(True, ~same), np.append(same, False) | np.append(False, same)
            known = own[:, sure]
            known[0] = sent_id(*known[:4])
            rows = np.concatenate([own[:, head], known], 1)
            yield pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(np.arange(rows.shape[1]) >= head.sum())], names=[*_PICK_NAMES, "sure"])


def sent_id(pick: np.ndarray, kind: np.ndarray, key: np.ndarray, start: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return signed(mix(mix(pick.view(U) + U(7) * kind.view(U)) + mix(key.view(U)) + start.view(U)))


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key`` and its bytes for rows that are sure, and of the others, sorted by (pick, kind): ``key`` and its bytes for those of which there are several of a kind, ``sent`` for one of each
    kind where a pick has several kinds. One row of each is remembered from batch to batch."""
    held: dict[str, np.ndarray] | None = None  # the last row, which the next may resemble
    alone: np.ndarray | None = None  # a pick's first kind, as long as it has no other
    alone_pick, before = None, (None, None)

    def out(now: dict[str, np.ndarray], following: tuple) -> pa.RecordBatch | None:
        nonlocal alone, alone_pick, before
        pick, kind = now["pick"], now["kind"]
        n = len(pick)
        same_pick, same_kind = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        same_pick[1:-1] = pick[1:] == pick[:-1]
        same_pick[0], same_pick[n] = pick[0] == before[0], pick[-1] == following[0]
        same_kind[1:-1] = same_pick[1:-1] & (kind[1:] == kind[:-1])
        same_kind[0], same_kind[n] = same_pick[0] and kind[0] == before[1], same_pick[n] and kind[-1] == following[1]
        several = same_kind[:-1] | same_kind[1:]
        heads = np.flatnonzero(~same_kind[:-1])
        sent = []
        if len(heads):
            ids = sent_id(pick[heads], kind[heads], now["key"][heads], now["start"][heads])
            linked = np.concatenate(([alone_pick is not None and pick[heads[0]] == alone_pick], pick[heads[1:]] == pick[heads[:-1]]))
            also = np.append(linked[1:], False)
            if linked[0] and alone is not None:
                sent.append(alone)
            sent.append(ids[linked | also])
            alone_pick = pick[heads[-1]]
            alone = None if linked[-1] else ids[-1:]
        before = (pick[-1], kind[-1])
        ids = np.concatenate(sent) if sent else np.zeros(0, np.int64)
        m = int(several.sum())
        nothing = np.zeros(len(ids), np.int64)
        if m + len(ids) == 0:
            return None
        columns = [np.concatenate([now[c][several], nothing]) for c in ("key", "start", "stop")]
        known = np.concatenate([np.zeros(m, np.int64), ids])
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(known, mask=np.arange(m + len(ids)) < m)], names=["key", "start", "stop", "sent"])

    for batch in batches:
        if not batch.num_rows:
            continue
        known = batch.filter(batch.column("sure"))
        if known.num_rows:
            yield pa.RecordBatch.from_arrays([*(known.column(c) for c in ("key", "start", "stop")), pa.nulls(known.num_rows, pa.int64())], names=["key", "start", "stop", "sent"])
        batch = batch.filter(pc.invert(batch.column("sure")))
        if not batch.num_rows:
            continue
        now = {c: batch.column(c).to_numpy() for c in _PICK_NAMES}
        if held is not None:
            now = {c: np.concatenate([held[c], now[c]]) for c in now}
        held = {c: v[-1:] for c, v in now.items()}
        now = {c: v[:-1] for c, v in now.items()}
        if len(now["pick"]) and (made := out(now, (held["pick"][0], held["kind"][0]))):
            yield made
    if held is not None and (made := out(held, (None, None))):
        yield made


def wanted_ids(sent: DataFrame, kinds: int) -> np.ndarray:
    """A table of the ids in ``sent``, words in which each sets a bit for each of ``PARTS``."""
    bits = min(MOST_BITS, max(16, (8 * kinds).bit_length()))
    cell = F.shiftright(F.col("sent").bitwiseAND((1 << bits) - 1), 6)
    own = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned(sent, {part}) & 63 as int))" for part in PARTS)
    cells = sent.select(cell.alias("cell"), F.expr(own).alias("own")).groupBy("cell").agg(F.expr("bit_or(own)").alias("bits")).toArrow()
    table = np.zeros(1 << bits - 6, np.int64)
    table[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()
    return table.view(U)


def is_wanted(table: np.ndarray, sent: np.ndarray) -> np.ndarray:
    """Whether all bits of each id are set: for all that the table was made of, and a few others."""
    sent, bits = sent.view(U), np.zeros(len(sent), U)
    for part in PARTS:
        bits |= U(1) << (sent >> U(part) & U(63))
    return table[(sent >> U(6) & U(len(table) - 1)).astype(np.int64)] & bits == bits


@trimmed
def _contexts(batches: Iterator[pa.RecordBatch], length: int, wanted) -> Iterator[pa.RecordBatch]:
    table = wanted.value
    for whole in batches:
        for batch in passes(whole, most=PASS):
            data, bounds, pick, kind, key, row, start, stop, place = _owned(batch, length)
            if not len(pick):
                continue
            keep = np.flatnonzero(is_wanted(table, sent_id(pick, kind, key, start - bounds[row])))
            if len(keep):
                raw = data.tobytes()
                text = [raw[a:b] for a, b in zip(start[keep].tolist(), stop[keep].tolist(), strict=True)]
                rows = [pick[keep], key[keep], (start - bounds[row])[keep], (place - start)[keep].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(text, pa.binary())], names=["pick", "key", "start", "place", "bytes"])


def repeated(text: np.ndarray, owned: np.ndarray, length: int, files: Files) -> np.ndarray:
    """Which places are owned and begin ``length`` bytes that also begin at another owned place: those whose neighbour among the owned
    suffixes in order has as long a prefix in common, which is the least common prefix on the way there."""
    out = files.array(len(text), bool)
    last, least = -1, length
    for suffix, common in suffixes(text, length, files):
        at = np.flatnonzero(owned[suffix])
        if not len(at):
            least = min(least, int(common.min()))
            continue
        between_ = np.minimum.reduceat(common[: at[-1] + 1], np.append(0, at[:-1] + 1))
        own = suffix[at]
        before = np.append(last, own[:-1])
        alike = between_ >= length
        alike[0] = last >= 0 and min(least, int(between_[0])) >= length
        out[own[alike]] = True
        out[before[alike]] = True
        last, least = int(own[-1]), int(common[at[-1] + 1 :].min(initial=length))
    return out


def _true(flags: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """First and last places of the runs of true flags, a block at a time."""
    before, start = False, None
    for at in range(0, len(flags), block):
        part = flags[at : at + block]
        step = np.diff(part.astype(np.int8), prepend=np.int8(before))
        first, last = at + np.flatnonzero(step == 1), at + np.flatnonzero(step == -1) - 1
        if start is not None:
            first = np.append(start, first)
        before, start = bool(part[-1]), None
        if before:
            start, first = first[-1], first[:-1]
        if len(first):
            yield first, last
    if start is not None:
        yield np.array([start]), np.array([len(flags) - 1])


def cores(data: np.ndarray, begin: np.ndarray, size: np.ndarray, place: np.ndarray, pick: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Context, first and last stretch (places in the context) and a hash for each group of stretches that share a core.

    Of a pick's contexts, stretches are equal only if they begin as many places before it. Groups are stretches of the same ``STEP`` such
    numbers of places; the core, which every one of a group covers, lies between the last one's start and the first one's end, for each context
    at the same places about the pick. Contexts with an equal stretch so have the core of its group in common.
    """
    sums = prefix(data)
    low = place - (size - length)  # places between the last stretch and the pick
    groups = place // STEP - low // STEP + 1
    of = np.repeat(np.arange(len(size)), groups)
    group = np.arange(len(of)) - np.repeat(np.cumsum(groups) - groups, groups) + (low // STEP)[of]
    least, most = group * STEP, np.minimum(group * STEP + STEP, length - PICK + 1) - 1
    at = (begin + place)[of]
    with np.errstate(over="ignore"):
        tag = mix(between(sums, at - least, at - most + length) + mix(pick[of].view(U) + group.astype(U)))
    return of, np.maximum(place[of] - most, 0), np.minimum(place[of] - least, (size - length)[of]), tag


def shared(tags: np.ndarray, files: Files) -> Iterator[np.ndarray]:
    """Whether each tag occurs again, a block at a time, by tables of at least 32 places a tag; where memory allows fewer, some that do not are taken to."""
    cells = 1 << max(9, min((32 * len(tags)).bit_length(), (files.memory // 16).bit_length()))
    once, again = np.zeros(cells, bool), np.zeros(cells, bool)
    blocks = [tags[at : at + files.block] for at in range(0, len(tags), files.block)]
    for tag in blocks:
        cell, times = np.unique(tag & U(cells - 1), return_counts=True)
        again[cell] |= once[cell] | (times > 1)
        once[cell] = True
    for tag in blocks:
        yield again[tag & U(cells - 1)]


def _gathered(batches: Iterator[pa.RecordBatch], length: int, files: Files) -> tuple[np.ndarray, ...]:
    """Of all contexts, as files: bytes, groups of stretches (place in the bytes, number of stretches, key, start in the row), their tags."""
    paths, at = [files.path() for _ in range(3)], 0
    with open(paths[0], "wb") as raw, open(paths[1], "wb") as groups, open(paths[2], "wb") as tags:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("bytes")
            bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            data = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
            pick, key, start, place = (batch.column(c).to_numpy().astype(np.int64) for c in ("pick", "key", "start", "place"))
            begin = bounds[:-1] - bounds[0]
            of, first, last, tag = cores(data, begin, np.diff(bounds), place, pick, length)
            raw.write(data)
            groups.write(np.stack([at + begin[of] + first, last - first + 1, key[of], start[of] + first], 1).tobytes())
            tags.write(tag.tobytes())
            at += len(data)
    return tuple(files.mapped(path, kind) if at else np.zeros(0, kind) for path, kind in zip(paths, (np.uint8, np.int64, U), strict=True))


def _kept(batches: Iterator[pa.RecordBatch], length: int, files: Files) -> tuple[np.ndarray, ...]:
    """As files: the text to sort, its owned places, and of each run of stretches in it where it begins, its key and its start in the row.

    Stretches whose core occurs once are left out; groups that follow each other make one run.
    """
    raw, groups, tags = _gathered(batches, length, files)
    groups = groups.reshape(-1, 4)
    paths, at, row, few = [files.path() for _ in range(3)], 0, 0, files.block // length + 1
    with open(paths[0], "wb") as text, open(paths[1], "wb") as owned, open(paths[2], "wb") as known:
        for again in shared(tags, files):
            kept = groups[row : row + len(again)][again]
            row += len(again)
            if not len(kept):
                continue
            kept = kept[np.argsort(kept[:, 0])]
            follows = (kept[1:, 0] == kept[:-1, 0] + kept[:-1, 1]) & (kept[1:, 2] == kept[:-1, 2]) & (kept[1:, 3] == kept[:-1, 3] + kept[:-1, 1])
            head = np.flatnonzero(np.append(True, ~follows))
            begin, count = kept[head], np.add.reduceat(kept[:, 1], head)
            for lo in range(0, len(begin), few):
                own, some = begin[lo : lo + few], count[lo : lo + few]
                size = some + length  # with a byte between
                to = np.cumsum(size) - size
                within = np.arange(int(size.sum())) - np.repeat(to, size)
                out = raw[np.minimum(np.repeat(own[:, 0], size) + within, len(raw) - 1)]
                out[to + size - 1] = 255  # in no UTF-8 text
                text.write(out)
                owned.write((within < np.repeat(some, size)).tobytes())
                known.write(np.stack([at + to, own[:, 2], own[:, 3]], 1).tobytes())
                at += len(out)
    for read in (raw, groups, tags):
        files.free(read)
    return tuple(files.mapped(path, kind) if at else np.zeros(0, kind) for path, kind in zip(paths, (np.uint8, bool, np.int64), strict=True))


@trimmed
def _shard(batches: Iterator[pa.RecordBatch], length: int, memory: int) -> Iterator[pa.RecordBatch]:
    """Suffix-sorts the bytes of a shard, kept in files, and gives the bytes [start, stop) of ``key`` that repeat."""
    files = Files(memory)
    try:
        text, owned, known = _kept(batches, length, files)
        begin, key, start = known.reshape(-1, 3).T
        for first, last in _true(repeated(text, owned, length, files), files.block):
            which = np.searchsorted(begin, first, "right") - 1
            offset = start[which] - begin[which]
            yield pa.RecordBatch.from_arrays([pa.array(key[which]), pa.array(first + offset), pa.array(last + offset + length)], names=["key", "start", "stop"])
    finally:
        files.close()


def spans(texts: DataFrame, length: int = LENGTH, memory: int = MEMORY) -> DataFrame:
    """(key, start, stop): bytes of ``texts`` (doc_id, text) covered by strings of ``length`` bytes that start more than once."""
    spark = texts.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = texts.mapInArrow(partial(_picked, length=length), PICKS).repartition(tasks, "pick").sortWithinPartitions("pick", "kind")
    out = saved(found.mapInArrow(_sorted_out, "key long, start long, stop long, sent long"), "picks")
    sent = out.where("sent is not null").select("sent")
    kinds = sent.count()
    wanted = spark.sparkContext.broadcast(wanted_ids(sent, kinds))
    context = texts.mapInArrow(partial(_contexts, length=length, wanted=wanted), "pick long, key long, start long, place int, bytes binary")
    shards = max(tasks, kinds * (length + length // 2) // SHARD + 1)
    sorted_ = context.repartition(shards, "pick").mapInArrow(partial(_shard, length=length, memory=memory), "key long, start long, stop long")
    repeats = saved(sorted_, "repeats")
    return out.where("sent is null").select("key", "start", "stop").unionByName(repeats)


@trimmed
def _keyed(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in passes(whole, most=PASS):
            data, bounds = text_bytes(batch.column("text"))
            key = signed(row_keys(batch, data, bounds, prefix(data)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], names=[*batch.schema.names, name])


def merged(listed: list[int] | None) -> list[tuple[int, int]]:
    """Maximal runs of the bytes of flat [start, stop) pairs."""
    out: list[list[int]] = []
    pairs = sorted(zip(listed[::2], listed[1::2], strict=True)) if listed else []
    for a, b in pairs:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _rest(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in runs:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


def _digest(batches: Iterator[pa.RecordBatch], spans: str) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for batch in batches:
        rows = []
        for doc, text, listed in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", spans)), strict=True):
            raw, runs = (text or "").encode(), merged(listed)
            rows.append((doc, len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(_rest(raw, runs)).hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "kept_sha256" else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)


def _cut(batches: Iterator[pa.RecordBatch], names: list[str], count: str | None, spans: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        listed = batch.column(spans).to_pylist()
        texts = [t if not s else _rest(t.encode(), merged(s)).decode(errors="ignore") for t, s in zip(batch.column("text").to_pylist(), listed, strict=True)]
        columns = []
        for n in names:
            column = batch.column(n)
            if n == "text":
                column = pa.array(texts, column.type)
            elif n == count:
                column = pa.array([old if not s else len(t) for old, s, t in zip(column.to_pylist(), listed, texts, strict=True)], column.type)
            columns.append(column)
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _marked(docs: DataFrame, length: int, memory: int) -> tuple[DataFrame, str]:
    """``docs`` with the flat list of its repeated bytes, or null, and the name of that column."""
    key, of, spans_ = (free(docs, f"__{n}") for n in ("key", "of", "spans"))
    found = spans(docs.select("doc_id", "text"), length, memory)
    pair: Column = F.array("start", "stop")
    listed = found.groupBy(F.col("key").alias(of)).agg(F.flatten(F.collect_set(pair)).alias(spans_))  # a document's own spans
    keyed = T.StructType([*docs.schema.fields, T.StructField(key, T.LongType())])
    return docs.mapInArrow(partial(_keyed, name=key), keyed).join(listed, F.col(key) == F.col(of), "left").drop(of, key), spans_


def digest(docs: DataFrame, length: int = LENGTH, memory: int = MEMORY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs``.

    A byte is removed if a string of ``length`` bytes that covers it starts anywhere else too, in any row or the same; strings are
    judged on the input. A null text is empty. Repeated rows repeat each other's bytes. Null ids are kept; an empty table gives no
    rows; other columns are ignored.
    """
    marked, name = _marked(docs.select("doc_id", "text"), length, memory)
    return marked.mapInArrow(partial(_digest, spans=name), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH, memory: int = MEMORY, count: str | None = "n_chars") -> DataFrame:
    """``docs`` without the bytes that :func:`digest` removes, all rows and columns kept.

    Where a cut goes through a character its other bytes go too. ``count`` names the column, if there is one, that holds the characters of
    the text; it is renewed where the text changes.
    """
    marked, name = _marked(docs, length, memory)
    return marked.mapInArrow(partial(_cut, names=docs.columns, count=count, spans=name), docs.schema)
