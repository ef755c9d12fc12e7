"""Hierarchical packing of documents into sequences of several lengths.

Each partition packs its own documents, so nothing is shuffled. A document's full long windows stand
alone; the rest of it goes to the smallest tier that holds it. A tier's pieces each open a window of the
tier's size; what they leave free is filled by whole pieces of shorter tiers, the largest first, and the
last gap by cutting one. Windows are thus exactly full; only the last of a partition can be padded.
Sequences of a tier are dealt to groups of one step, so that each group has about the same attention cost.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .hashing import passes, trim, trimmed
from .tokens import encoder

TIERS = (256, 512, 1024, 2048)
#: Tokens of a step group.
STEP_TOKENS = 16384
#: Ids end with this one.
END_ID = 1
#: Documents packed at once.
WAITING = 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
_ARROW = pa.schema([(n, pa.int32() if t == "int" else pa.int64()) for n, t in (x.split() for x in SCHEMA.split(", "))])

#: A piece: document, its key, start, ids as bytes (4 a token), tokens of the document.
Piece = tuple[int, int | None, int, bytes, int]


class Packer:
    """Packs pieces into sequences; :meth:`add` and :meth:`finish` give those that are complete."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        if list(tiers) != sorted(set(tiers)) or any(t & (t - 1) or t < 1 for t in tiers):
            raise ValueError("tiers must be powers of two in rising order")
        self.tiers, self.count = tiers, 0
        self.pools: list[list[tuple[int, int, Piece]]] = [[] for _ in tiers]

    def _put(self, piece: Piece) -> None:
        size = len(piece[3]) // 4
        tier = next(i for i, t in enumerate(self.tiers) if size <= t)
        insort(self.pools[tier], (size, self.count, piece))
        self.count += 1

    def _fill(self, gap: int, below: int) -> list[Piece]:
        """Pieces of the tiers under ``below`` that fill the gap as far as they go, and exactly if there are enough."""
        out = []
        for pool in reversed(self.pools[:below]):
            while gap and (i := bisect_right(pool, (gap, float("inf"), ()))):
                size, _, piece = pool.pop(i - 1)
                out.append(piece)
                gap -= size
        if gap and (pool := next((p for p in self.pools[:below] if p), None)):
            _, _, (doc, key, start, ids, total) = pool.pop()
            out.append((doc, key, start, ids[: 4 * gap], total))
            self._put((doc, key, start + gap, ids[4 * gap :], total))
        return out

    def add(self, pieces: Iterable[Piece]) -> Iterator[tuple[int, list[Piece]]]:
        """Takes whole documents; yields full sequences with their tier."""
        top = self.tiers[-1]
        for doc, key, start, ids, total in pieces:
            while len(ids) >= 4 * top:
                yield top, [(doc, key, start, ids[: 4 * top], total)]
                start, ids = start + top, ids[4 * top :]
            if ids:
                self._put((doc, key, start, ids, total))
        for tier in range(len(self.tiers) - 1, -1, -1):
            pool, size = self.pools[tier], self.tiers[tier]
            free = sum(x[0] for p in self.pools[: tier + 1] for x in p)
            while pool and free >= size:
                first = pool.pop()
                # the base tier's own pieces also fill its windows
                row = [first[2], *self._fill(size - first[0], max(tier, 1))]
                if sum(len(p[3]) for p in row) < 4 * size:  # only pieces of this tier are left
                    for piece in row[1:]:
                        self._put(piece)
                    other = pool.pop() if pool else None
                    if other is None:
                        self._put(first[2])
                        break
                    gap = size - first[0]
                    doc, key, start, ids, total = other[2]
                    row = [first[2], (doc, key, start, ids[: 4 * gap], total)]
                    self._put((doc, key, start + gap, ids[4 * gap :], total))
                free -= size
                yield size, row

    def finish(self) -> Iterator[tuple[int, list[Piece]]]:
        """What is left, as windows of falling size; the last alone can be less than full, and is padded to the longest."""
        left = [p for pool in reversed(self.pools) for _, _, p in reversed(pool)]
        self.pools = [[] for _ in self.tiers]
        total = sum(len(p[3]) // 4 for p in left)
        while total:
            size = next((t for t in reversed(self.tiers) if t <= total), 0)
            need, row = size or total, []
            while need:
                doc, key, start, ids, tokens = left.pop(0)
                cut = ids[: 4 * need]
                row.append((doc, key, start, cut, tokens))
                if len(cut) < len(ids):
                    left.insert(0, (doc, key, start + need, ids[4 * need :], tokens))
                need -= len(cut) // 4
            total -= size or total
            yield size or self.tiers[-1], row


def grouped(sequences: list[tuple[int, list[Piece]]], step_tokens: int, first: int) -> tuple[list[int], int]:
    """A step group for each sequence: groups hold one tier's sequences, and costs are dealt back and forth to even them out."""
    out = [0] * len(sequences)
    for tier in sorted({t for t, _ in sequences}):
        own = [i for i, (t, _) in enumerate(sequences) if t == tier]
        n = max(1, -(-len(own) * tier // step_tokens))
        own.sort(key=lambda i: -sum((len(p[3]) // 4) ** 2 for p in sequences[i][1]))
        for k, i in enumerate(own):
            turn, place = divmod(k, n)
            out[i] = first + (place if turn % 2 == 0 else n - 1 - place)
        first += n
    return out, first


@trimmed
def _pack(batches: Iterator[pa.RecordBatch], tokenizer: str, tiers: tuple[int, ...], end_id: int, step_tokens: int) -> Iterator[pa.RecordBatch]:
    encode, packer = encoder(tokenizer), Packer(tiers)
    base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    end = end_id.to_bytes(4, "little")
    made, groups, docs = 0, 0, 0
    waiting: list[Piece] = []

    def out(sequences: list[tuple[int, list[Piece]]]) -> pa.RecordBatch:
        nonlocal made, groups
        steps, groups = grouped(sequences, step_tokens, groups)
        columns: list[list] = [[] for _ in _ARROW.names]
        for (tier, row), step in zip(sequences, steps, strict=True):
            offset = 0
            for _, key, start, ids, total in row:
                values = (key, start, len(ids) // 4, zlib.crc32(ids), total, base + made, offset, tier, base + step)
                for c, v in zip(columns, values, strict=True):
                    c.append(v)
                offset += len(ids) // 4
            made += 1
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    for whole in batches:
        for batch in passes(whole):
            for key, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                waiting.append((docs, key, 0, ids + end, len(ids) // 4 + 1))
                docs += 1
            if len(waiting) >= WAITING:
                if rows := list(packer.add(waiting)):
                    yield out(rows)
                waiting, rows = [], []
                trim()
    if rows := [*packer.add(waiting), *packer.finish()]:
        yield out(rows)


def pack(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) in sequences of at most the longest tier.

    A null or empty text is a document of the end id alone. Null and repeated ids are packed row by row; an
    empty table gives no rows; other columns are ignored. sequence_id is unique over all partitions, offset is
    gapless in a sequence, tier is the sequence's window (a sequence under its window is the partition's last).
    """
    return docs.select("doc_id", "text").mapInArrow(partial(_pack, tokenizer=tokenizer, tiers=tiers, end_id=end_id, step_tokens=step_tokens), SCHEMA)
