"""External induced suffix sorting with common-prefix values.

The text's suffixes are typed L or S. Suffixes at S-after-L places are put in
order by their substrings' names, by recursion on the names if two are equal.
Then all L suffixes are induced in ascending order and all S suffixes in
descending order: a suffix taken from the queue pushes its left neighbour,
under the neighbour's first symbol. What is pushed under one symbol comes in
order, so the priority queue is a heap of symbols with one first-in-first-out
list each. A queue that holds more entries than its limit writes those that
are needed last to a file, as a sorted run, and merges its runs when their
symbols' turn comes.

Queue entries carry the position and the length of the prefix that it has in
common with the entry before it under the same symbol: one more than the least
such length between the two suffixes that induced them, found on a stack of
the lengths seen. Lengths count up to `cap`.

A text of no more symbols than the limit is sorted in lists. For a longer one
all that grows with the text is in files: types, places, names, substrings
(sorted in runs that are merged), queues and results, which are mapped, so that
the system can drop their pages. What a task holds of its own then depends on
the limit and the alphabet. Files are the task's own and go with it, in the
folder that Spark gives its workers for such; a lost task begins anew.
"""

from __future__ import annotations

import heapq
import mmap
import os
import pickle
import tempfile
from array import array
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import numpy as np

LIMIT = 4_000_000


def scratch_file():
    """A file without a name, in the worker's own Spark folder if there is one."""
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)


def disk_array(n: int, dtype) -> np.ndarray:
    """An array in a mapped file, of zeros."""
    size = max(1, n * np.dtype(dtype).itemsize)
    with scratch_file() as f:
        f.truncate(size)
        return np.frombuffer(mmap.mmap(f.fileno(), size), dtype, n)


class DiskList:
    """Numbers appended to a mapped file, `most` at the most."""

    def __init__(self, most: int, dtype):
        self.values, self.n = disk_array(most, dtype), 0
        self.view = memoryview(self.values)

    def append(self, x: int) -> None:
        self.view[self.n] = x
        self.n += 1

    def __getitem__(self, k: int) -> int:
        return self.view[k]

    def __len__(self) -> int:
        return self.n


class SpillingQueue:
    """A priority queue of (place, common length) for symbols taken in one direction; under one symbol, first in, first out."""

    def __init__(self, descending: bool = False, limit: int = LIMIT):
        self.sign, self.limit = -1 if descending else 1, limit
        self.heap: list[int] = []
        self.lists: dict[int, deque[tuple[int, int]]] = {}
        #: For each run its place in the file, entries that are left, and the next of them (symbol, place, common length).
        self.runs: list[list] = []
        self.heads: list[tuple[int, int]] = []
        self.file = self.current = None

    def list_of(self, symbol: int) -> deque[tuple[int, int]]:
        """Where to append for a symbol that has no list yet."""
        self.lists[symbol] = out = deque()
        heapq.heappush(self.heap, symbol * self.sign)
        return out

    def spill(self) -> None:
        """Write the lists that are needed last to a run, until half of the limit is left."""
        held = sum(map(len, self.lists.values()))
        if held <= self.limit:
            return
        self.file = self.file or scratch_file()
        gone = []
        for symbol in sorted(self.lists, key=lambda k: -k * self.sign):
            if held <= self.limit // 2:
                break
            if symbol != self.current:
                gone.append(symbol)
                held -= len(self.lists[symbol])
        self.file.seek(0, 2)
        at, n = self.file.tell(), 0
        for symbol in reversed(gone):
            entries = self.lists.pop(symbol)
            array("q", [x for place, common in entries for x in (symbol, place, common)]).tofile(self.file)
            n += len(entries)
        self.heap = [symbol * self.sign for symbol in self.lists]
        heapq.heapify(self.heap)
        if n:
            self.runs.append([at, n, deque()])
            self._advance(len(self.runs) - 1)

    def _advance(self, k: int) -> None:
        """Put run k's next entry among the heads."""
        at, n, ready = run = self.runs[k]
        if not ready and n:
            take = min(n, max(8, self.limit // (4 * len(self.runs))))  # all runs' entries that are in memory stay within the limit
            self.file.seek(at)
            part = array("q")
            part.fromfile(self.file, 3 * take)
            run[0], run[1] = at + 24 * take, n - take
            ready.extend(zip(part[::3], part[1::3], part[2::3], strict=True))
        if ready:
            heapq.heappush(self.heads, (ready[0][0] * self.sign, k))

    def next_symbol(self) -> int | None:
        while self.heap and not self.lists.get(self.heap[0] * self.sign):
            self.lists.pop(heapq.heappop(self.heap) * self.sign, None)
        if self.heads and (not self.heap or self.heads[0][0] <= self.heap[0]):
            return self.heads[0][0] * self.sign
        return self.heap[0] * self.sign if self.heap else None

    def drain(self, symbol: int) -> Iterator[tuple[int, int]]:
        """All entries of a symbol, also those that come in meanwhile: earlier runs first, then what is held."""
        self.current = symbol
        while self.heads and self.heads[0][0] == symbol * self.sign:
            _, k = heapq.heappop(self.heads)
            ready = self.runs[k][2]
            while True:
                _, place, common = ready.popleft()
                yield place, common
                if not ready or ready[0][0] != symbol:
                    break
            self._advance(k)
        if (held := self.lists.get(symbol)) is not None:
            take = held.popleft
            while held:
                yield take()


def _chunks(n: int, size: int) -> Iterator[tuple[int, int]]:
    return ((a, min(a + size, n)) for a in range(0, n, size))


def _types(text: np.ndarray, limit: int) -> np.ndarray:
    """Whether each suffix is of type S; the last is of type L, before an end that is least."""
    n = len(text)
    out, after = np.zeros(n, bool) if n <= limit else disk_array(n, bool), False
    for a, b in reversed(list(_chunks(n, max(1, limit)))):
        part = text[a : min(b + 1, n)]
        differs = np.flatnonzero(part[:-1] != part[1:])
        small = np.full(b - a, after)
        if len(differs):
            at = np.searchsorted(differs, np.arange(b - a))
            known = at < len(differs)
            nxt = differs[np.minimum(at, len(differs) - 1)]
            small[known] = (part[nxt] < part[nxt + 1])[known]
        out[a:b], after = small, bool(small[0])
    return out


def _common(text, a: int, b: int, cap: int) -> int:
    """How many of the next `cap` symbols, four bytes each, are the same."""
    x, y = text[4 * a : 4 * (a + cap)], text[4 * b : 4 * (b + cap)]
    if x == y:
        return len(x) // 4
    low, high = 0, min(len(x), len(y)) // 4
    while low < high:
        mid = (low + high + 1) // 2
        if x[: 4 * mid] == y[: 4 * mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _starts(small: np.ndarray, limit: int) -> np.ndarray:
    """The places of the S suffixes that follow an L suffix."""
    if len(small) <= limit:
        return np.flatnonzero(small[1:] & ~small[:-1]) + 1
    found = [(a, np.flatnonzero(small[a + 1 : b + 1] & ~small[a : min(b, len(small) - 1)])) for a, b in _chunks(len(small) - 1, limit)]
    out, n = disk_array(sum(len(x) for _, x in found), np.int64), 0
    for a, x in found:
        out[n : n + len(x)] = x + a + 1
        n += len(x)
    return out


def _substrings(text: np.ndarray, small: np.ndarray, starts: np.ndarray, a: int, b: int) -> list[bytes]:
    """Substrings a to b, from a start to the next one inclusive, in bytes that sort like them; types make none the beginning of another."""
    ends = np.append(starts[a + 1 : b + 1] + 1, len(text) if b == len(starts) else [])[: b - a].astype(np.int64)
    low, high = int(starts[a]), int(ends[-1])
    raw = (2 * text[low:high].astype(np.int64) + small[low:high]).astype(">u4").tobytes()
    return [raw[4 * x : 4 * y] for x, y in zip((starts[a:b] - low).tolist(), (ends - low).tolist(), strict=True)]


def _in_order(text: np.ndarray, small: np.ndarray, starts: np.ndarray, limit: int) -> Iterator[tuple[bytes, int]]:
    """The substrings, sorted, with their numbers; those of a long text by way of sorted runs in files."""
    if len(text) <= limit:
        parts = _substrings(text, small, starts, 0, len(starts))
        yield from ((parts[k], k) for k in sorted(range(len(parts)), key=parts.__getitem__))
        return

    def load(f) -> Iterator[tuple[bytes, int]]:
        f.seek(0)
        while rows := pickle.load(f):
            yield from rows

    files, a, each = [], 0, max(8, limit * limit // len(text))
    while a < len(starts):
        b = min(len(starts), max(a + 1, int(np.searchsorted(starts, starts[a] + limit))))
        rows = sorted(zip(_substrings(text, small, starts, a, b), range(a, b), strict=True))
        files.append(f := scratch_file())
        for x, y in _chunks(len(rows), each):
            pickle.dump(rows[x:y], f)
        pickle.dump([], f)
        a = b
    yield from heapq.merge(*map(load, files))


def _starts_in_order(text: np.ndarray, small: np.ndarray, limit: int) -> np.ndarray:
    """The S suffixes that follow an L suffix, in order."""
    starts = _starts(small, limit)
    n = len(starts)
    if n < 2:
        return starts
    new = (lambda: np.zeros(n, np.int64)) if len(text) <= limit else (lambda: disk_array(n, np.int64))
    names, order, name, before, before_k = new(), new(), -1, None, -1
    view, place = memoryview(names), memoryview(order)
    for at, (part, k) in enumerate(_in_order(text, small, starts, limit)):
        if part != before or n - 1 in (k, before_k):  # the last runs to the end and equals no other
            name += 1
        before, before_k = part, k
        view[k], place[at] = name, k
    if name + 1 < n:
        order = suffix_order(names, limit)
    out = new()
    for a, b in _chunks(n, max(1, limit)):
        out[a:b] = starts[order[a:b]]
    return out


class _Sweep:
    """One direction of the induction; `take` visits a suffix and queues its left neighbour if that is of the wanted type."""

    def __init__(self, values: list[int], wanted: list[bool], cap: int, limit: int, descending: bool):
        self.queue = SpillingQueue(descending, limit)
        queue, lists, list_of = self.queue, self.queue.lists, self.queue.list_of
        ranks, lengths, last = [-1], [0], {}  # the stack of lengths: each is less than all above it
        rank, pushed, check = 0, 0, max(1, limit // 4)

        def take(at: int, common: int) -> None:
            nonlocal rank, pushed
            if cap:
                while lengths and lengths[-1] >= common:
                    lengths.pop()
                    ranks.pop()
                lengths.append(common)
                ranks.append(rank)
            if at and wanted[at - 1]:
                at -= 1
                symbol = values[at]
                shared = 0
                if cap:
                    was = last.get(symbol)
                    if was is not None:
                        shared = 1 + lengths[bisect_right(ranks, was)]
                        if shared > cap:
                            shared = cap
                    last[symbol] = rank
                held = lists.get(symbol)
                if held is None:
                    held = list_of(symbol)
                held.append((at, shared))
                pushed += 1
                if pushed == check:
                    pushed = 0
                    queue.spill()
            rank += 1

        self.take = take


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, cap: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    n, raw = len(text), b""
    if n <= limit:
        values, is_small, is_large, seeds = text.tolist(), small.tolist(), (~small).tolist(), seeds.tolist()
        raw = text.astype(">u4").tobytes() if cap else b""
        large, large_common, out, out_common = array("q"), array("i"), array("q"), array("i")
    else:
        values, is_small, is_large, seeds = (memoryview(x) for x in (text, small.view(np.uint8), disk_array(n, np.uint8), seeds))
        for a, b in _chunks(n, limit):
            np.asarray(is_large)[a:b] = ~small[a:b]
        if cap:
            wide = disk_array(n, ">u4")
            for a, b in _chunks(n, limit):
                wide[a:b] = text[a:b]
            raw = memoryview(wide.view(np.uint8))
        large, large_common, out, out_common = (DiskList(n, t) for t in (np.int64, np.int32, np.int64, np.int32))

    # ascending: L suffixes from the end, from L suffixes and from seeds; of one symbol the L suffixes come first
    sweep = _Sweep(values, is_large, cap, limit, False)
    take, queue = sweep.take, sweep.queue
    take(n, 0)
    k, before = 0, n
    while True:
        symbol = queue.next_symbol()
        if symbol is None or (k < len(seeds) and values[seeds[k]] < symbol):
            if k == len(seeds):
                break
            symbol = values[seeds[k]]
        if symbol == queue.next_symbol():
            for at, common in queue.drain(symbol):
                large.append(at)
                large_common.append(common)
                take(at, common)
                before = at
        while k < len(seeds) and values[seeds[k]] == symbol:
            at = seeds[k]
            take(at, _common(raw, before, at, cap) if cap and before < n and values[before] == symbol else 0)
            before = at
            k += 1

    # descending: S suffixes from L and S suffixes; of one symbol the S suffixes come first. A length is shared with the suffix taken before
    sweep = _Sweep(values, is_small, cap, limit, True)
    take, queue = sweep.take, sweep.queue
    k, after = len(large) - 1, -1
    while True:
        symbol = queue.next_symbol()
        if symbol is None or (k >= 0 and values[large[k]] > symbol):
            if k < 0:
                break
            symbol = values[large[k]]
        if symbol == queue.next_symbol():
            for at, common in queue.drain(symbol):
                out.append(at)
                out_common.append(common)
                take(at, common)
                after = at
        while k >= 0 and values[large[k]] == symbol:
            at = large[k]
            if after < 0 or values[after] != symbol:
                common = 0
            elif is_small[after]:
                common = _common(raw, at, after, cap) if cap else 0
            else:
                common = large_common[k + 1]
            out.append(at)
            out_common.append(common)
            take(at, common)
            after = at
            k -= 1
    order, before = (np.frombuffer(x, t) if n <= limit and n else np.zeros(0, t) if not n else x.values[: len(x)] for x, t in ((out, np.int64), (out_common, np.int32)))
    common = np.zeros(n, np.int32) if n <= limit else disk_array(n, np.int32)
    common[1:] = before[::-1][:-1]  # a length is shared with the suffix taken before, which comes after
    return order[::-1], common


def suffix_order(text: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    small = _types(text, limit)
    return _induce(text, small, _starts_in_order(text, small, limit), 0, limit)[0]


def suffix_array(text: np.ndarray, cap: int, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a text of symbols from 0 in order, and the length of the prefix that each shares with the one before, up to `cap`.

    A text of more than `limit` symbols is sorted in files; it may be in one
    itself, and so are the results then.
    """
    small = _types(text, limit)
    return _induce(text, small, _starts_in_order(text, small, limit), cap, limit)
