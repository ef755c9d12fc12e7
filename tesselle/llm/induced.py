"""External suffix sorting by induction, with common prefixes.

The suffixes at the leftmost places of falling-to-rising turns (LMS) are sorted first, all others are induced from them: the falling ones in a
sweep over symbols upwards, the rising ones in a sweep downwards. What a suffix induces, the suffix one place before it, waits in a
queue ordered by symbol and then by arrival. The same two sweeps, begun from LMS places in no order, sort and name the pieces between LMS
places; the string of names, a third as long at most as a rule, is sorted by recursion until no name repeats or a string is so short that all
of its sorting fits in memory, where doubling of ranks ends it.

Tuples of the queue carry what they have in common with the tuple before them of the same symbol: while names are made, whether their
pieces are equal so far; in the last sweeps, the length of the common prefix, up to a bound. That is one more than the least common
prefix among the suffixes between the two that induced them. Only those of the LMS suffixes are found by comparing text.

Places, names, orders and the queue are read and written in blocks, and are files beyond what ``memory`` allows to be held of them, whatever
the length of the text; each is given up once it is read. The text is a file of the caller's.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

#: Bytes that may be held in memory.
MEMORY = 64 << 20
#: Symbols up to which each has a queue of its own, in texts of so many times as many suffixes; else symbols share queues, up to so many.
SINGLE, LONG, SHARED = 512, 64, 1024
#: Suffixes that a shared queue is meant for.
TOGETHER = 5000
#: Bytes of memory that sorting a short string in memory takes for each symbol.
IN_MEMORY = 64
#: Bytes of memory for a record of a block.
PER_RECORD = 1024


class Block(NamedTuple):
    """Suffixes in order; of each, what it carries, and whether it was induced in this sweep."""

    suffix: np.ndarray
    carry: np.ndarray
    induced: np.ndarray


class Files:
    """Arrays of a sorting: in memory up to half of what may be held, beyond that on disk in a folder of their own."""

    def __init__(self, memory: int):
        self.folder, self.count, self.memory, self.left = tempfile.mkdtemp(prefix="tesselle-"), 0, memory, memory // 2
        self.block = max(512, memory // PER_RECORD)
        self.kept: dict[int, tuple[str | None, int]] = {}  # by array: its file, or its bytes in memory

    def path(self) -> str:
        self.count += 1
        return os.path.join(self.folder, str(self.count))

    def mapped(self, path: str, dtype: type, mode: str = "r", size: int | None = None) -> np.ndarray:
        """The array that is a file."""
        out = np.memmap(path, dtype, mode, shape=None if size is None else (size,))
        self.kept[id(out)] = (path, 0)
        return out.view(np.ndarray)

    def _held(self, out: np.ndarray) -> np.ndarray:
        self.left -= out.nbytes
        self.kept[id(out)] = (None, out.nbytes)
        return out.view(np.ndarray)

    def array(self, size: int, dtype: type) -> np.ndarray:
        """An array of zeros."""
        if size * np.dtype(dtype).itemsize <= self.left:
            return self._held(np.zeros(size, dtype))
        return self.mapped(self.path(), dtype, "w+", size)

    def written(self, parts: Iterator[np.ndarray], dtype: type) -> np.ndarray:
        """The parts one after another, each an array of records of one length."""
        path, width, file, held, total = self.path(), 1, None, [], 0
        for part in parts:
            width = part.shape[1] if part.ndim > 1 else 1
            held.append(np.array(part, dtype).ravel())
            total += held[-1].nbytes
            if file is not None or total > self.left:
                file = file or open(path, "wb")  # noqa: SIM115
                for h in held:
                    file.write(h.tobytes())
                held = []
        if file is not None:
            file.close()
            out = self.mapped(path, dtype)
        else:
            out = self._held(np.concatenate(held) if held else np.zeros(0, dtype))
        return out.reshape(-1, width) if width > 1 else out

    def free(self, array: np.ndarray) -> None:
        """Forgets an array that nothing will read any more."""
        while isinstance(array.base, np.ndarray):
            array = array.base
        path, size = self.kept.pop(id(array), (None, 0))
        self.left += size
        if path:
            os.remove(path)

    def close(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


def place(n: int) -> type:
    """The type of places in a text."""
    return np.int32 if n < 2**31 else np.int64


class Waiting:
    """A monotone priority queue of (symbol, suffix, carry): by symbol, then by arrival; on disk beyond ``memory`` bytes.

    Few symbols of a long text each have a queue of their own, which is read in blocks; others share queues, which are read whole.
    """

    def __init__(self, files: Files, symbols: int, n: int):
        self.files, self.width = files, 1 if symbols <= SINGLE and n > LONG * symbols else -(-symbols // min(SHARED, max(8, n // TOGETHER)))
        self.parts: list[list[np.ndarray]] = [[] for _ in range(-(-symbols // self.width))]
        self.paths: dict[int, list] = {}  # queue: path, and how many bytes of it are read
        self.new: list[np.ndarray] = []  # pushed and not dealt to queues yet
        self.later: list[np.ndarray] = []  # as these, and not for the queue that is being read
        self.held, self.limit = 0, files.memory // 4
        self.at = -1  # the queue that is being read

    def push(self, records: np.ndarray) -> None:
        """Adds rows of (symbol, suffix, carry), each to the end of its queue."""
        if len(records):
            self.new.append(records)
            self.held += records.nbytes
            if self.held > self.limit:
                self.new = self.later + self.new
                self.later = []
                self._deal()
                self._spill()

    def _deal(self) -> None:
        if not self.new:
            return
        records = np.concatenate(self.new)
        queue = records[:, 0] // self.width
        order = np.argsort(queue, kind="stable")
        records, queue, self.new = records[order], queue[order], []
        cuts = np.flatnonzero(queue[1:] != queue[:-1]) + 1
        for part, q in zip(np.split(records, cuts), queue[np.append(0, cuts)].tolist(), strict=True):
            self.parts[q].append(part)

    def _spill(self) -> None:
        for q, parts in enumerate(self.parts):
            if parts:
                known = self.paths.setdefault(q, [self.files.path(), 0])
                with open(known[0], "ab") as f:
                    for part in parts:
                        f.write(part.tobytes())
                self.parts[q] = []
        self.held = 0

    def pop(self, queue: int, most: int | None = None) -> np.ndarray:
        """The first records of a queue, at most ``most`` or all. Queues are read one after another."""
        if queue != self.at or most is not None:
            self.new = self.later + self.new
            self.later = []
            self._deal()
        elif self.new:  # of what has come since, only this queue's part is looked for
            for records in self.new:
                own = records[:, 0] < (queue + 1) * self.width
                if own.any():
                    self.parts[queue].append(records[own])
                    records = records[~own]
                if len(records):
                    self.later.append(records)
            self.new = []
        self.at = queue
        out = []
        left = most if most is not None else 1 << 60
        if queue in self.paths:
            path, at = self.paths[queue]
            found = np.fromfile(path, np.int64, 3 * left if most is not None else -1, offset=at).reshape(-1, 3)
            if at + found.nbytes >= os.path.getsize(path):
                del self.paths[queue]
                os.remove(path)
            else:
                self.paths[queue][1] = at + found.nbytes
            out.append(found)
            left -= len(found)
        while left and queue not in self.paths and self.parts[queue]:
            part = self.parts[queue].pop(0)
            if len(part) > left:
                self.parts[queue].insert(0, part[left:])
                part = part[:left]
            self.held -= part.nbytes
            out.append(part)
            left -= len(part)
        return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low .. high] for each pair, from a table of the least of each power of two in a row."""
    out = np.empty(len(low), values.dtype)
    level = np.frexp(high - low + 1)[1] - 1
    table = values
    most = int(level.max(initial=-1))
    for k in range(most + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k) + 1])
        if k < most:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


class Sweep:
    """One sweep over symbols. Upwards (``sign`` 1) it takes LMS suffixes and induces falling ones, downwards (-1) falling ones and induces rising ones.

    ``carries`` is "" (nothing), "equal" (numbers that differ where pieces do) or "common" (common prefixes of up to ``length``).
    """

    def __init__(self, files: Files, text: np.ndarray, symbols: int, sign: int, carries: str = "", length: int = 0):
        self.files, self.text, self.symbols, self.sign, self.carries, self.length = files, text, symbols, sign, carries, length
        self.queue = Waiting(files, symbols, len(text))
        self.last: tuple[int, int, int] | None = None  # symbol, kind and carry of the suffix before, for numbers
        self.number = -1
        self.before: tuple[int, int, bool] | None = None  # suffix, symbol and kind of the suffix before, for common prefixes
        self.since = np.full(symbols if carries == "common" else 0, length, np.int64)  # least common prefix since a symbol's last push
        self.pushed = np.zeros(len(self.since), bool)

    def of(self, suffix: np.ndarray) -> np.ndarray:
        symbol = self.text[suffix].astype(np.int64)
        return symbol if self.sign > 0 else self.symbols - 1 - symbol

    def _run(self, suffix: int) -> int:
        """How often the suffix begins with its first symbol, up to ``length``."""
        window = self.text[suffix : suffix + self.length]
        other = np.flatnonzero(window != window[0])
        return int(other[0]) if len(other) else len(window)

    def run(self, records: np.ndarray) -> Block:
        """As :meth:`take`, for induced suffixes of one symbol that are all there is of it: those that they induce at that symbol itself, again and
        again, follow them wave by wave, each wave in the order of the one before."""
        most, symbol = 4 * self.files.block + len(records), int(records[0, 0])
        waves, place = [records[:, 1]], [np.arange(len(records))]
        total, whole = len(records), False
        while not whole and total <= most:
            on = waves[-1] > 0
            on[on] = self.of(waves[-1][on] - 1) == symbol
            whole = not on.any()
            if not whole:
                waves.append(waves[-1][on] - 1)
                place.append(place[-1][on])
                total += len(place[-1])
        if len(waves) == 1 and whole:
            return self.take(records[:, 1], records[:, 0], records[:, 2], np.ones(len(records), bool))
        wave = np.repeat(np.arange(len(waves)), [len(w) for w in waves])
        suffix, place = np.concatenate(waves), np.concatenate(place)
        carry = records[:, 2][place]
        if self.carries == "common":
            later = np.flatnonzero((wave[1:] > 0) & (wave[1:] == wave[:-1])) + 1
            carry[later] = np.minimum(_least(records[:, 2], place[later - 1] + 1, place[later]) + wave[later], self.length)
            for k in (np.flatnonzero(wave[1:] != wave[:-1]) + 1).tolist():  # one more of the symbol than all of the wave before have
                carry[k] = self._run(int(suffix[k - 1]))
        return self.take(suffix, np.full(total, symbol), carry, np.ones(total, bool), wave, not whole)

    def take(self, suffix: np.ndarray, symbol: np.ndarray, carry: np.ndarray, induced: np.ndarray, wave: np.ndarray | None = None, more: bool = True) -> Block:
        """Goes through sources in order: what each carries from now on, and the push of what they induce. Of waves, none but the last
        (and that if there is ``more``) has its symbol's own suffixes to push."""
        if self.carries == "equal":
            now = np.stack([symbol, induced, carry] if wave is None else [symbol, induced, carry, wave])
            first = np.ones(len(suffix), bool)
            first[1:] = (now[:, 1:] != now[:, :-1]).any(0)
            first[0] = self.last is None or self.last != tuple(now[:3, 0].tolist())
            self.last = tuple(now[:3, -1].tolist()) if wave is None or not wave[-1] else None
            carry = self.number + np.cumsum(first)
            self.number = int(carry[-1])
        elif self.carries == "common":
            other = np.append(self.before[1] if self.before else -1, symbol[:-1]) != symbol
            turn = ~other & (np.append(self.before[2] if self.before else False, induced[:-1]) != induced)
            carry = np.where(other, 0, carry)
            for k in np.flatnonzero(turn).tolist():  # a falling and a rising suffix have their first symbol's run in common, no more
                carry[k] = min(self._run(int(suffix[k])), self._run(int(suffix[k - 1]) if k else self.before[0]), self.length)
            self.before = (int(suffix[-1]), int(symbol[-1]), bool(induced[-1]))
        at = np.flatnonzero(suffix > 0)
        earlier = suffix[at] - 1
        to = self.of(earlier)
        ok = (to > symbol[at]) | ((to == symbol[at]) & induced[at])
        at, earlier, to = at[ok], earlier[ok], to[ok]
        if self.carries == "equal":
            given = carry[at]
        elif self.carries == "common":
            given = self._given(carry, at, to)
        else:
            given = np.zeros(len(at), np.int64)
        pushed = np.stack([to, earlier, given], 1)
        if wave is not None:
            pushed = pushed[(to != symbol[at]) | (more & (wave[at] == wave[-1]))]
        self.queue.push(pushed)
        return Block(suffix, carry, induced)

    def _given(self, gap: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        """The common prefix of each induced suffix with the one induced before it at the same symbol."""
        out = np.zeros(len(at), np.int64)
        order = np.argsort(to, kind="stable")
        k, q = at[order], to[order]
        head = np.ones(len(k), bool)
        head[1:] = q[1:] != q[:-1]
        if len(k):
            upto = np.minimum.accumulate(gap)
            found = np.zeros(len(k), np.int64)
            found[head] = np.where(self.pushed[q[head]], np.minimum(self.since[q[head]], upto[k[head]]) + 1, 0)
            inner = np.flatnonzero(~head)
            found[inner] = _least(gap, k[inner - 1] + 1, k[inner]) + 1
            out[order] = np.minimum(found, self.length)
        rest = np.append(np.minimum.accumulate(gap[::-1])[::-1], self.length)
        self.since = np.minimum(self.since, rest[0])
        tail = np.append(head[1:], True)[: len(head)]
        self.since[q[tail]] = rest[k[tail] + 1]
        self.pushed[q[tail]] = True
        return out

    def blocks(self, feed: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[Block]:
        """All suffixes of the sweep in order; ``feed`` gives blocks of (suffix, carry), in order of their symbols."""
        feed = _Feed(feed, self)
        for queue in range(len(self.queue.parts)):
            if self.queue.width == 1:
                alone = True
                while len(now := self.queue.pop(queue, self.files.block)):
                    alone = alone and len(now) < self.files.block
                    yield self.run(now) if alone else self.take(now[:, 1], now[:, 0], now[:, 2], np.ones(len(now), bool))
                while (fed := feed.below(queue + 1, self.files.block)) is not None:
                    yield self.take(fed[:, 1], fed[:, 0], fed[:, 2], np.zeros(len(fed), bool))
            else:
                yield from self._shared(queue, feed)

    def _shared(self, queue: int, feed: _Feed) -> Iterator[Block]:
        """A queue of several symbols: all of those up to the first symbol that they induce themselves are gone through at once."""
        end = (queue + 1) * self.queue.width
        fed = [np.zeros((0, 3), np.int64)]
        while (more := feed.below(end, None)) is not None:
            fed.append(more)
        rows = np.concatenate(fed)
        induced, to = np.zeros(len(rows), bool), self._to(rows, False)
        while True:
            new = self.queue.pop(queue)
            if len(new):  # after what is induced of the same symbol, before what is fed
                new = new[np.argsort(new[:, 0], kind="stable")]
                at = np.searchsorted(rows[:, 0] * 2 + ~induced, new[:, 0] * 2, "right") + np.arange(len(new))
                old = np.ones(len(rows) + len(new), bool)
                old[at] = False
                for now, (known, added) in enumerate(((rows, new), (to, self._to(new, True)), (induced, True))):
                    both = np.empty((len(old), *known.shape[1:]), known.dtype)
                    both[old], both[at] = known, added
                    rows, to, induced = (both, to, induced) if now == 0 else (rows, both, induced) if now == 1 else (rows, to, both)
            if not len(rows):
                return
            symbol = rows[:, 0]
            clash = symbol >= np.minimum.accumulate(to)
            upto = int(clash.argmax()) if clash.any() else len(rows)  # from here on a symbol is one that was induced before
            if 0 < upto < len(rows):
                upto = int(np.searchsorted(symbol, symbol[upto]))  # all of a symbol or none
            if upto:
                yield self.take(rows[:upto, 1], symbol[:upto], rows[:upto, 2], induced[:upto])
            else:  # the least symbol's own suffixes induce more of it, which come before those that are fed
                upto = int(np.searchsorted(symbol * 2 + ~induced, symbol[0] * 2, "right"))
                if upto:
                    yield self.run(rows[:upto])
                else:
                    upto = int(np.searchsorted(symbol, symbol[0], "right"))
                    yield self.take(rows[:upto, 1], symbol[:upto], rows[:upto, 2], induced[:upto])
            rows, to, induced = rows[upto:], to[upto:], induced[upto:]

    def _to(self, rows: np.ndarray, induced: bool) -> np.ndarray:
        """The symbol that each induces a suffix at, or more than any."""
        earlier = rows[:, 1] - 1
        to = self.of(np.maximum(earlier, 0))
        to[(earlier < 0) | ((to < rows[:, 0]) if induced else (to <= rows[:, 0]))] = self.symbols
        return to


class _Feed:
    """Blocks of (suffix, carry) as records, up to a symbol."""

    def __init__(self, blocks: Iterator[tuple[np.ndarray, np.ndarray]], sweep: Sweep):
        self.blocks, self.sweep, self.ready = blocks, sweep, np.zeros((0, 3), np.int64)

    def below(self, end: int, most: int | None) -> np.ndarray | None:
        if not len(self.ready):
            for suffix, carry in self.blocks:
                if len(suffix):
                    self.ready = np.stack([self.sweep.of(suffix), suffix.astype(np.int64), carry.astype(np.int64)], 1)
                    break
            else:
                return None
        cut = int(np.searchsorted(self.ready[:, 0], end))
        cut = cut if most is None else min(cut, most)
        out, self.ready = self.ready[:cut], self.ready[cut:]
        return out if cut else None


def turns(files: Files, text: np.ndarray) -> np.ndarray:
    """The LMS places, in rising order: rising suffixes with a falling one before them."""

    def parts() -> Iterator[np.ndarray]:
        rising_after, end = False, len(text)  # the last suffix falls, to the end of the text
        while end > 0:
            start = max(0, end - files.block)
            part = text[start : min(end + 1, len(text))].astype(np.int64)
            step = np.sign(part[1:] - part[:-1])
            if end == len(text):
                step = np.append(step, -1)
            step[-1] = step[-1] or (1 if rising_after else -1)
            known = np.flatnonzero(step)
            rising = np.repeat(step[known] > 0, np.diff(known, prepend=-1))
            found = start + 1 + np.flatnonzero(np.append(rising[1:], rising_after) & ~rising)
            rising_after = bool(rising[0])
            yield found[found < len(text)][::-1].astype(np.int64)
            end = start

    return files.written(parts(), place(len(text)))[::-1]


def _blocks_of(array: np.ndarray, block: int, backwards: bool = False) -> Iterator[np.ndarray]:
    starts = range(0, len(array), block)
    for at in reversed(starts) if backwards else starts:
        part = np.asarray(array[at : at + block])
        yield part[::-1] if backwards else part


def _by_symbol(files: Files, text: np.ndarray, places: np.ndarray, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in order of their symbols alone."""
    queue = Waiting(files, symbols, len(text))
    for part in _blocks_of(places, files.block):
        queue.push(np.stack([text[part].astype(np.int64), part, np.zeros(len(part), np.int64)], 1))
    for q in range(len(queue.parts)):
        while len(now := queue.pop(q, files.block if queue.width == 1 else None)):
            now = now[np.argsort(now[:, 0], kind="stable")]
            yield now[:, 1], now[:, 2]


def _falling(files: Files, sweep: Sweep, feed: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The upward sweep: falling suffixes in order, with what they carry."""
    n = len(sweep.text)
    sweep.queue.push(np.array([[int(sweep.text[n - 1]), n - 1, -1 if sweep.carries == "equal" else 0]], np.int64))
    if sweep.carries == "common":
        sweep.pushed[int(sweep.text[n - 1])] = True
        sweep.since[int(sweep.text[n - 1])] = 0
    return files.written((np.stack([b.suffix[b.induced], b.carry[b.induced]], 1) for b in sweep.blocks(feed)), place(n))


def _downwards(falling: np.ndarray, block: int, shift: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Falling suffixes backwards; a common prefix then belongs to the smaller of the two that have it."""
    after = 0
    for part in _blocks_of(falling, block, backwards=True):
        suffix, carry = part[:, 0], part[:, 1]
        if shift:
            carry = np.append(after, carry[:-1])
            after = int(part[-1, 1])
        yield suffix, carry


def _common(files: Files, text: np.ndarray, seeds: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted suffixes with the common prefix of each with the one before, found in the text eight bytes at a time."""
    n, before = len(text), -1
    eights = np.ndarray((max(0, n - 7),), "<u8", text, 0, (1,)) if n > 7 else np.zeros(0, np.uint64)
    for part in _blocks_of(seeds, files.block):
        part = part.astype(np.int64)
        a = np.append(before, part[:-1])
        out, alike, depth = np.zeros(len(part), np.int64), np.flatnonzero(a >= 0), 0
        while len(alike) and depth < length:
            x, y = a[alike] + depth, part[alike] + depth
            inside = np.maximum(x, y) < len(eights)
            for k in alike[~inside].tolist():  # the last few of the text
                i, j, d = int(a[k]), int(part[k]), depth
                while d < length and max(i, j) + d < n and text[i + d] == text[j + d]:
                    d += 1
                out[k] = d
            alike, x, y = alike[inside], x[inside], y[inside]
            apart = eights[x] ^ eights[y]
            other = apart != 0
            low = apart[other]
            out[alike[other]] = depth + np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)) // 8
            alike = alike[~other]
            depth += 8
        out[alike] = length
        before = int(part[-1])
        yield part, np.minimum(out, length)


def doubled(text: np.ndarray) -> np.ndarray:
    """The suffixes of a short string in order, by doubling ranks; only suffixes that still tie take part in a round."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    fresh = np.concatenate(([True], text[order[1:]] != text[order[:-1]]))
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    size, places = 1, np.arange(n)
    while True:
        own = rank[order[places]]
        first = np.concatenate(([True], own[1:] != own[:-1]))
        alone = first & np.concatenate((first[1:], [True]))
        places = places[~alone]
        if not len(places) or size > n:
            return order
        own, suffix = own[~alone], order[places]
        after = rank[np.minimum(suffix + size, n)]
        by = np.lexsort((after, own))
        suffix, own, after = suffix[by], own[by], after[by]
        order[places] = suffix
        fresh = np.concatenate(([True], (own[1:] != own[:-1]) | (after[1:] != after[:-1])))
        rank[suffix] = places[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        size *= 2


def sorted_seeds(files: Files, text: np.ndarray, symbols: int) -> np.ndarray:
    """The LMS places of the text in order of their suffixes."""
    places = turns(files, text)
    if len(places) < 2:
        return places
    up = Sweep(files, text, symbols, 1, "equal")
    falling = _falling(files, up, _by_symbol(files, text, places, symbols))
    # of the downward sweep, LMS places with their pieces' numbers; an LMS place is at least two after the one before
    names = files.array(len(text) // 2 + 1, place(len(text)))
    down = Sweep(files, text, symbols, -1, "equal")

    def named() -> Iterator[np.ndarray]:
        number, last = 0, None
        for b in down.blocks(_downwards(falling, files.block, False)):
            suffix, carry = b.suffix[b.induced], b.carry[b.induced]
            some = suffix > 0
            suffix, carry = suffix[some], carry[some]
            turn = text[suffix - 1] > text[suffix]
            suffix, carry = suffix[turn], carry[turn]
            if not len(suffix):
                continue
            fresh = np.append(last is not None and carry[0] != last, carry[1:] != carry[:-1])
            number_of = number + np.cumsum(fresh)
            number, last = int(number_of[-1]), int(carry[-1])
            names[suffix // 2] = number_of + 1
            yield suffix
        nonlocal different
        different = number + 1

    different = 0
    backwards = files.written(named(), place(len(text)))
    files.free(falling)
    if different == len(places):
        files.free(names)
        files.free(places)
        return backwards[::-1]
    files.free(backwards)
    # numbers rise downwards: the names of the string rise upwards
    string = files.written((different - part[part > 0] for part in _blocks_of(names, files.block)), place(len(text)))
    files.free(names)
    if len(string) * IN_MEMORY <= files.memory:
        order = iter([doubled(string)])
    else:
        order = sorted_all(files, string, different, sorted_seeds(files, string, different))
    seeds = files.written((places[part] for part in order), place(len(text)))
    files.free(string)
    files.free(places)
    return seeds


def sorted_all(files: Files, text: np.ndarray, symbols: int, seeds: np.ndarray) -> Iterator[np.ndarray]:
    """All suffixes in order, from the sorted LMS places, which are freed."""
    falling = _falling(files, Sweep(files, text, symbols, 1), ((part, np.zeros(len(part), np.int64)) for part in _blocks_of(seeds, files.block)))
    files.free(seeds)
    down = files.written((b.suffix for b in Sweep(files, text, symbols, -1).blocks(_downwards(falling, files.block, False))), place(len(text)))
    files.free(falling)
    yield from _blocks_of(down, files.block, backwards=True)
    files.free(down)


def suffixes(text: np.ndarray, length: int, files: Files) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of suffixes of a text of bytes, from the greatest down, with the common prefix of each with the one before, up to ``length``."""
    if not len(text):
        return
    seeds = sorted_seeds(files, text, 256)
    falling = _falling(files, Sweep(files, text, 256, 1, "common", length), _common(files, text, seeds, length))
    files.free(seeds)
    for b in Sweep(files, text, 256, -1, "common", length).blocks(_downwards(falling, files.block, True)):
        yield b.suffix, b.carry
    files.free(falling)


def suffix_order(text: np.ndarray, memory: int = MEMORY) -> np.ndarray:
    """The suffixes of ``text``, non-negative integers, in order; the end of the text is less than any symbol."""
    files = Files(memory)
    try:
        if not len(text):
            return np.zeros(0, np.int64)
        symbols = int(text.max()) + 1
        return np.concatenate(list(sorted_all(files, text, symbols, sorted_seeds(files, text, symbols))))
    finally:
        files.close()
