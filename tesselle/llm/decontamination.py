"""Benchmark decontamination by edit distance.

A text holds an item where some stretch of it is within a tenth of the item's length in edits. Windows of texts and of items, one from each
place where a word begins, are embedded by a random walk that repeats a byte or goes on by a rule of the step and the byte, so that
windows a few edits apart agree in most places. Each of several samples of the places is a bucket. Where windows of a text
fall into buckets of an item's windows often enough, at shifts no further apart than the allowed edits move them, the exact edit
distance decides, over all that such a stretch can cover.

An item that allows one edit is found without buckets: one of its halves stands as it is (:data:`HALF`). Buckets that many items share say little of any
of them: they are left out where an item has others enough (:data:`COMMON`).

Any other item is as many windows as it has words: a window is about 24 bytes, fewer for shorter items (:data:`KINDS`), because
of long windows with a tenth of edits the walks part for good. What the buckets find was measured against the exact distance (README): it is a
search with a recall, and no item is found that is not within the limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import LOWER, U, mix, passes, text_bytes, trimmed

#: Edits allowed, in parts of the item's characters.
SHARE = 0.1
#: Items that one pass over the texts looks for; more take more passes.
ITEMS = 10_000
#: Kinds of items, by the characters they have at least: steps of the walk, places of a sample, buckets in common that call for the exact distance.
KINDS = ((128, 48, 10, 3), (64, 32, 8, 3), (24, 20, 7, 2), (10, 12, 5, 1))
#: Buckets in common that call for the exact distance, as a share of the item's, where that is more. At the limit of edits three times as many are met.
MET = 0.05
#: Samples of the places of a window.
SAMPLES = 8
#: Bytes at both ends of a half of an item with one edit, by which it is sought at every place.
HALF = 5
#: Items that share a bucket from which on it is common, and the share of an item's buckets that are kept however common they are, the rarest first.
COMMON, LEAST_KEPT = 32, 0.4
#: Bytes of a word after which windows also begin within it, at bytes that their surroundings choose.
RUN = 12
#: Bytes of the character that each byte begins; of a byte within one, 1.
_WIDTH = np.repeat(np.array([1, 2, 3, 4]), [0xC0, 0x20, 0x10, 0x10])
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[97:123] = _LETTER[128:] = True
_draw = np.random.default_rng(20)
#: Whether the walk goes on after a byte, at each step.
WALK = _draw.integers(0, 2, (KINDS[0][1], 256)).astype(np.int32)
#: For each kind the places of each sample, and what their bytes are multiplied by.
PLACES = [[np.sort(_draw.choice(steps, size, replace=False)) for _ in range(SAMPLES)] for _, steps, size, _ in KINDS]
_MULTIPLY = _draw.integers(1, 2**63, (SAMPLES, KINDS[0][2])).astype(U) * U(2) + U(1)


class Item(NamedTuple):
    item_id: int
    text: str
    raw: np.ndarray
    edits: int


def plain(text: str) -> str:
    """A-Z folded, runs of white space as one space, none at the ends."""
    data = np.frombuffer(text.encode(), np.uint8)
    return folded(data, np.array([0, len(data)]))[0].tobytes().decode().strip(" ")


def folded(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows' bytes with A-Z folded and each run of white space as one space, and the new bounds."""
    if not len(data):
        return data, bounds
    space = _SPACE[data]
    again = np.concatenate(([False], space[1:] & space[:-1]))
    again[bounds[:-1][bounds[:-1] < bounds[1:]]] = False
    out = LOWER[data]
    out[space] = 32
    kept = np.concatenate(([0], np.cumsum(~again)))
    return out[~again], kept[bounds]


def nearest(pattern: str, text: str) -> int:
    """The smallest edit distance of the pattern to a stretch of the text, by bit-parallel dynamic programming."""
    m = len(pattern)
    if not m:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, score, least = full, 0, m, m
    for c in text:
        match = masks.get(c, 0)
        carry = (((match & up) + up) ^ up) | match | down
        rise, fall = down | ~(carry | up) & full, up & carry
        score += bool(rise & top) - bool(fall & top)
        rise, fall = rise << 1 & full, fall << 1 & full
        up, down = fall | ~((match | down) | rise) & full, rise & (match | down)
        least = min(least, score)
    return least


def begins(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places where windows begin: where a word or a run of other marks does, at every character of three bytes or more, and in long words at some bytes."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    letter, solid = _LETTER[data], data != 32
    fresh = np.zeros(n, bool)
    fresh[bounds[:-1][bounds[:-1] < n]] = True
    before = lambda x: np.append(False, x[:-1]) & ~fresh
    word = letter & ~before(letter)
    out = word | (solid & ~before(solid)) | (data >= 0xE0)
    start = np.maximum.accumulate(np.where(word, np.arange(n), 0))
    inner = np.flatnonzero(letter & (np.arange(n) - start >= RUN))
    inner = inner[inner + 2 < n]
    out[inner[(data[inner] * 31 + data[inner + 1] * 17 + data[inner + 2] * 7 & 7) == 0]] = True
    return np.flatnonzero(out & (data & 0xC0 != 0x80))


def embedded(data: np.ndarray, at: np.ndarray, steps: int) -> np.ndarray:
    """The walk of each window: the byte at each step, by steps and windows."""
    padded = np.concatenate([data, np.zeros(steps + 1, np.uint8)])
    out, place = np.empty((steps, len(at)), np.uint8), at.astype(np.int32)
    for step in range(steps):
        now = padded[place]
        out[step] = now
        place = place + WALK[step][now]
    return out


def buckets(walks: np.ndarray, kind: int) -> np.ndarray:
    """The bucket of each window in each sample of a kind."""
    out = np.zeros((SAMPLES, walks.shape[1]), U)
    with np.errstate(over="ignore"):
        for sample, places in enumerate(PLACES[kind]):
            for k, place in enumerate(places):
                out[sample] += walks[place] * _MULTIPLY[sample, k]
            out[sample] = mix(out[sample] + U(sample + 1 + SAMPLES * kind))
    return out


def _ends(data: np.ndarray) -> np.ndarray:
    """The next :data:`HALF` bytes of each place as one number."""
    out = np.zeros(len(data) - HALF + 1, U)
    for k in range(HALF):
        out = out << U(8) | data[k : len(data) - HALF + 1 + k].astype(U)
    return out


def _halves(text: str) -> list[tuple[int, int, int, int]]:
    """Of both halves of a text: its offset, the numbers of its first and its last bytes, and how far these are apart; none where a half has too few bytes."""
    middle = len(text) // 2
    halves = [np.frombuffer(h.encode(), np.uint8) for h in (text[:middle], text[middle:])]
    if any(len(h) < HALF for h in halves):
        return []
    return [(at, int(_ends(h)[0]), int(_ends(h)[-1]), len(h) - HALF) for at, h in zip((0, len(halves[0])), halves, strict=True)]


def _told_apart(keys: np.ndarray, owner: np.ndarray, items: int) -> np.ndarray:
    """Which places of the index are kept: those whose bucket is not common, and of each item the rarest in any case."""
    if not len(keys):
        return np.zeros(0, bool)
    pairs = np.unique(np.stack([keys, owner.astype(U)], 1), axis=0)
    names, spread = np.unique(pairs[:, 0], return_counts=True)
    shared = spread[np.searchsorted(names, keys)]
    order = np.lexsort((shared, owner))
    total = np.bincount(owner, minlength=items)
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.arange(len(keys)) - (np.cumsum(total) - total)[owner[order]]
    return (shared < COMMON) | (rank < np.ceil(LEAST_KEPT * total[owner]))


class Finder:
    """Finds the items in batches of texts."""

    def __init__(self, rows: list[tuple[int, str]], share: float = SHARE):
        self.items = []
        for item_id, text in rows:
            text = plain(text or "")
            if text:
                self.items.append(Item(item_id, text, np.frombuffer(text.encode(), np.uint8), int(share * len(text))))
        self.sizes = np.array([len(i.raw) for i in self.items], np.int64)
        self.edits = np.array([i.edits for i in self.items], np.int64)
        self.wide = np.array([max(len(c.encode()) for c in i.text) for i in self.items], np.int64)
        kind = [next((k for k, x in enumerate(KINDS) if len(i.text) >= x[0]), -1) if i.edits else -1 for i in self.items]
        self.exact = [i for i, k in enumerate(kind) if k < 0 and not self.edits[i]]  # these stand in a text as they are
        self.often = np.array([KINDS[k][3] if k >= 0 else 1 for k in kind], np.int64)
        halves = [(number, *h) for number, item in enumerate(self.items) if item.edits == 1 for h in _halves(item.text)]
        halved = {number for number, *_ in halves}
        self.kinds = sorted({k for i, k in enumerate(kind) if i not in halved and i not in self.exact and k >= 0} | ({len(KINDS) - 1} if any(k < 0 and i not in halved and i not in self.exact for i, k in enumerate(kind)) else set()))
        keys, owner, offset = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for number, item in enumerate(self.items):
            if number in self.exact or number in halved:
                continue
            own = kind[number] if kind[number] >= 0 else len(KINDS) - 1
            steps = KINDS[own][1]
            at = begins(item.raw, np.array([0, len(item.raw)]))
            whole = at[at + steps // 2 <= len(item.raw)]  # a walk reads about half as many bytes as it has steps
            at = whole if len(whole) else at[:1]
            found = buckets(embedded(item.raw, at, steps), own)
            keys.append(found.ravel())
            owner.append(np.full(found.size, number))
            offset.append(np.tile(at, SAMPLES))
        keys, owner, offset = (np.concatenate(x) for x in (keys, owner, offset))
        kept = _told_apart(keys, owner, len(self.items))
        keys, owner, offset = keys[kept], owner[kept], offset[kept]
        self.often = np.maximum(self.often, (MET * np.bincount(owner, minlength=len(self.items))).astype(np.int64))
        self.often[list(halved)] = 1
        order = np.argsort(keys, kind="stable")
        # the ends of halves follow the buckets as places in the index
        first = np.array([h[2] for h in halves], U)
        sorted_ = np.argsort(first, kind="stable")
        pick = lambda k: np.array([h[k] for h in halves], np.int64)[sorted_]
        self.keys, self.first = keys[order], first[sorted_]
        self.last, self.apart = np.array([h[3] for h in halves], U)[sorted_], pick(4)
        self.owner, self.offset = np.concatenate([owner[order], pick(0)]), np.concatenate([offset[order], pick(1)])
        self.table_bits = min(26, max(20, (8 * len(self.keys)).bit_length()))
        self.table = np.zeros(1 << self.table_bits, bool)
        self.table[self._cell(self.keys)] = True

    def _cell(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> U(64 - self.table_bits)).astype(np.int64)

    def hits(self, text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the text and place in the index for each bucket of a window of the text that a window of an item shares."""
        at = begins(text, bounds)
        place, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(at) and self.kinds and len(self.keys):
            walks = embedded(text, at, max(KINDS[k][1] for k in self.kinds))
            for kind in self.kinds:
                for keys in buckets(walks, kind):
                    hit = np.flatnonzero(self.table[self._cell(keys)])
                    low = np.searchsorted(self.keys, keys[hit])
                    hit, low = (x[self.keys[np.minimum(low, len(self.keys) - 1)] == keys[hit]] for x in (hit, low))
                    count = np.searchsorted(self.keys, keys[hit], "right") - low
                    place.append(np.repeat(at[hit], count))
                    found.append(np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum())))
        if len(self.first) and len(text) >= HALF:
            ends = _ends(text)
            low = np.searchsorted(self.first, ends)
            hit = np.flatnonzero(self.first[np.minimum(low, len(self.first) - 1)] == ends)
            low, count = low[hit], np.searchsorted(self.first, ends[hit], "right") - low[hit]
            at, index = np.repeat(hit, count), np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            other = at + self.apart[index]
            both = other < len(ends)
            both[both] = ends[other[both]] == self.last[index[both]]
            place.append(at[both])
            found.append(len(self.keys) + index[both])
        return np.concatenate(place), np.concatenate(found)

    def stretches(self, text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, item, start and end of the stretches that cover all places where an item's buckets are met often enough; they do not overlap."""
        place, found = self.hits(text, bounds)
        row = np.searchsorted(bounds, place, "right") - 1
        item, shift = self.owner[found], place - self.offset[found]
        key = np.sort((row * len(self.items) + item) << 32 | (shift + (1 << 30)))
        pair, shift = key >> 32, (key & 0xFFFFFFFF) - (1 << 30)
        row, item = pair // max(1, len(self.items)), pair % max(1, len(self.items))
        # an edit moves what follows by a character of the item or of the text at most
        wide, full = np.ones(len(bounds) - 1, np.int64), bounds[:-1] < bounds[1:]
        if full.any():
            wide[full] = np.maximum.reduceat(_WIDTH[text], bounds[:-1][full])
        reach = np.maximum(self.wide[item], wide[row]) * self.edits[item]
        last = np.arange(len(key)) + self.often[item] - 1
        enough = last < len(key)
        enough[enough] = key[last[enough]] - key[enough] <= reach[enough]
        pair, row, item, shift, reach = (x[enough] for x in (pair, row, item, shift, reach))
        # the least shift is no further from the stretch's start, nor the start from where its end would be
        start, end = np.maximum(bounds[row], shift - reach), np.minimum(bounds[row + 1], shift + self.sizes[item] + 2 * reach)
        head = np.ones(len(pair), bool)
        head[1:] = (pair[1:] != pair[:-1]) | (start[1:] > end[:-1])
        tail = np.append(head[1:], True)[: len(head)]
        return row[head], item[head], start[head], end[tail]

    def __call__(self, batch: pa.RecordBatch) -> dict[tuple[int, int], int]:
        """Edit distance by (row, number of the item)."""
        text, bounds = folded(*text_bytes(batch.column("text")))
        out: dict[tuple[int, int], int] = {}
        for r, i, a, b in zip(*(x.tolist() for x in self.stretches(text, bounds)), strict=True):
            least = nearest(self.items[i].text, text[a:b].tobytes().decode(errors="ignore"))
            if least <= self.items[i].edits:
                out[r, i] = min(least, out.get((r, i), least))
        whole = text.tobytes() if self.exact else b""
        for i in self.exact:
            sought, at = self.items[i].raw.tobytes(), -1
            while (at := whole.find(sought, at + 1)) >= 0:
                r = int(np.searchsorted(bounds, at, "right")) - 1
                if at + len(sought) <= bounds[r + 1]:
                    out[r, i] = 0
        return out


@trimmed
def _find(batches: Iterator[pa.RecordBatch], finder) -> Iterator[pa.RecordBatch]:
    find = finder.value
    for whole in batches:
        for batch in passes(whole):
            if hits := find(batch):
                ids = batch.column("doc_id")
                rows = [(ids[r].as_py(), find.items[i].item_id, d, find.items[i].edits, len(find.items[i].text)) for (r, i), d in sorted(hits.items())]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "item_id", "distance", "allowed", "item_chars"])


@trimmed
def _clean(batches: Iterator[pa.RecordBatch], finder) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in passes(whole):
            hit = np.zeros(batch.num_rows, bool)
            hit[[r for r, _ in finder.value(batch)]] = True
            yield batch.filter(pa.array(~hit))


def finders(benchmark: DataFrame, most: int = ITEMS, share: float = SHARE) -> Iterator:
    """A broadcast finder for every ``most`` items, so that what is sent at once has a bound however many there are."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    parts = max(1, -(-items.count() // most))
    for part in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        yield spark.sparkContext.broadcast(Finder([(r.item_id, r.text) for r in own.orderBy("item_id", "text").collect()], share))


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, distance, allowed, item_chars for each row of ``docs`` and item that its whole text holds within ``share`` edits.

    A-Z and a-z are the same and so is all white space. Null and empty texts and items match nothing; a repeated row or an item
    with several texts has a row for each; null ids stay null; without items or rows there are none. Items of fewer than ten characters
    allow no edit and are found wherever they stand; of others about all are found (README), and none that is not within the limit.
    """
    out = None
    for finder in finders(benchmark, share=share):
        found = docs.select("doc_id", "text").mapInArrow(partial(_find, finder=finder), "doc_id long, item_id long, distance long, allowed long, item_chars long")
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    for finder in finders(benchmark, share=share):
        docs = docs.mapInArrow(partial(_clean, finder=finder), docs.schema)
    return docs
