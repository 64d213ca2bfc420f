"""External induced sorting of the suffixes of a shard of segments, to a bounded depth, with common-prefix values.

The seeds are the suffixes at local minima (an S-type position after an L-type one). They are dealt out by their bytes, recursively until a
part fits memory, and sorted there. Then the order is induced: the L-type suffixes from left to right, the S-type ones from right
to left, each pushed by its successor onto the queue of its first byte. Together the queues are a priority queue on (first byte, rank of the
successor): tuples are pushed in the order of their successors, so a queue is a sequence that is appended to and read in order. A
tuple is a position and the length of the prefix it shares with the tuple before it in its queue: one more than the least such value among
the successors in between. What is beyond the memory bound lies in files: tuples, seeds, the text and its flags; blocks of the
queues are worked off vectorised, and the result is given out block by block.
"""

from __future__ import annotations

import os
import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

PAD = 80
TUPLE = np.dtype([("at", "<i8"), ("lcp", "u1")])


class Queues:
    """A sequence of tuples (position, common prefix) for each key; once ``limit`` tuples are held in all, they go to files."""

    def __init__(self, folder: str, limit: int):
        self.folder = tempfile.mkdtemp(dir=folder)
        self.limit, self.held = limit, 0
        self.tail: dict[int, list] = defaultdict(list)
        self.filed: dict[int, int] = defaultdict(int)
        self.size: dict[int, int] = defaultdict(int)

    def push(self, key: int, at: np.ndarray, lcp: np.ndarray) -> None:
        self.tail[key].append((at, lcp))
        self.size[key] += len(at)
        self.held += len(at)
        if self.held > self.limit:
            for k, parts in self.tail.items():
                with open(os.path.join(self.folder, str(k)), "ab") as f:
                    for x, y in parts:
                        rows = np.empty(len(x), TUPLE)
                        rows["at"], rows["lcp"] = x, y
                        f.write(rows.tobytes())
                self.filed[k] = self.size[k]
            self.tail.clear()
            self.held = 0

    def read(self, key: int, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The tuples [begin, end) of a sequence."""
        done, parts = self.filed[key], []
        if begin < done:
            rows = np.fromfile(os.path.join(self.folder, str(key)), TUPLE, min(end, done) - begin, offset=begin * TUPLE.itemsize)
            parts.append((rows["at"].copy(), rows["lcp"].copy()))
        if end > done:
            tail = self.tail[key]
            if len(tail) > 1:
                tail[:] = [tuple(np.concatenate(x) for x in zip(*tail, strict=True))]
            parts.append(tuple(x[max(begin - done, 0) : end - done] for x in tail[0]))
        return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def forward(self, key: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The blocks of a sequence, also of what is appended meanwhile."""
        at = 0
        while at < self.size[key]:
            end = min(self.size[key], at + most)
            yield self.read(key, at, end)
            at = end

    def backward(self, key: int, most: int, first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The blocks of a sequence from its end, each reversed, so that every tuple has the prefix it shares with the one read before it; ``first``: that of
        the last tuple."""
        end = self.size[key]
        while end > 0:
            begin = max(0, end - most)
            at, lcp = self.read(key, begin, end)
            yield at[::-1], np.concatenate([np.array([first], np.uint8), lcp[:0:-1]])
            first, end = int(lcp[0]), begin

    def last(self, key: int) -> int:
        return int(self.read(key, self.size[key] - 1, self.size[key])[0][0])


def room(folder: str, n: int, kind, memory: int) -> np.ndarray:
    """A zeroed array, in a file if it is larger than the memory bound."""
    if n <= memory:
        return np.zeros(n, kind)
    handle, path = tempfile.mkstemp(dir=folder)
    os.close(handle)
    return np.memmap(path, kind, "w+", shape=(n,))


def spill_folder() -> str | None:
    """Where Spark lets an executor spill; a task's files live as long as the task."""
    return os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None


def words(text: np.ndarray, at: np.ndarray, k: int, size: int = 8) -> np.ndarray:
    """Big-endian word k of the bytes at each position; its last 8 - ``size`` bytes count as 0."""
    out = np.zeros(len(at), np.uint64)
    for b in range(size):
        out |= text[at + (8 * k + b)].astype(np.uint64) << np.uint64(56 - 8 * b)
    return out


def chunk(memory: int) -> int:
    """Positions worked on at a time."""
    return max(1 << 12, min(1 << 18, memory))


def flags(text: np.ndarray, starts: np.ndarray, folder: str, memory: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each position whether it is S-type (the next byte that differs is larger; the end counts as smaller), a seed, and needed: between a
    start and the first seed after it. Worked out chunk by chunk."""
    n, step = len(text), chunk(memory)
    small, seed, needed = (room(folder, n, bool, memory) for _ in range(3))
    for a in range((n - 1) // step * step, -1, -step):
        b = min(n, a + step)
        part = text[a : min(n, b + 1)]
        last = np.flatnonzero(part[1:] != part[:-1])  # last positions of runs, and of the chunk
        last = np.append(last[last < b - a - 1], b - a - 1)
        up = np.zeros(len(last), bool)
        inner = last < len(part) - 1
        up[inner] = part[last[inner]] < part[last[inner] + 1]
        if b < n and part[-2] == part[-1]:
            up[-1] = small[b]
        small[a:b] = np.repeat(up, np.diff(np.append(-1, last)))
    count, since = 0, -1  # seeds so far, and how many there were at the last start
    for a in range(0, n, step):
        b = min(n, a + step)
        own = np.array(small[a:b])
        own[1:] &= ~small[a : b - 1]
        own[0] = own[0] and a > 0 and not small[a - 1]
        seed[a:b] = own
        total = count + np.cumsum(own)
        begun = np.flatnonzero(starts[a:b])
        at = np.searchsorted(begun, np.arange(b - a), "right") - 1
        before = np.where(at >= 0, total[begun[np.maximum(at, 0)]] if len(begun) else 0, since)
        needed[a:b] = (total - own <= before) & (before >= 0)
        count = int(total[-1])
        if len(begun):
            since = int(total[begun[-1]])
    return small, seed, needed


def sorted_seeds(text: np.ndarray, seeds: np.ndarray, depth: int) -> np.ndarray:
    """Seeds by their first ``depth`` bytes at least; ties are refined a word at a time."""
    key = words(text, seeds, 0)
    order = np.argsort(key, kind="stable")
    seeds, key = seeds[order], key[order]
    new = np.ones(len(seeds), bool)
    new[1:] = key[1:] != key[:-1]
    for k in range(1, -(-depth // 8)):
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(new)[at]
        own = seeds[at]
        key = words(text, own, k)
        order = np.lexsort((key, group))
        seeds[at] = own[order]
        key = key[order]
        same = np.zeros(len(at), bool)
        same[1:] = (group[1:] == group[:-1]) & (key[1:] == key[:-1])
        new[at] = ~same
    return seeds


def shared(text: np.ndarray, x: np.ndarray, y: np.ndarray, depth: int) -> np.ndarray:
    """The lengths of the common prefixes of pairs of suffixes, up to ``depth``."""
    out, live = np.full(len(x), depth, np.int64), np.arange(len(x))
    for k in range(-(-depth // 8)):
        if not len(live):
            break
        d = words(text, x[live], k) ^ words(text, y[live], k)
        odd = d != 0
        equal = sum(((d[odd] >> np.uint64(56 - 8 * b)) == 0).astype(np.int64) for b in range(8))
        out[live[odd]] = np.minimum(8 * k + equal, depth)
        live = live[~odd]
    return out.astype(np.uint8)


def runs(text: np.ndarray, held: Queues, key: int, level: int, depth: int, folder: str, memory: int) -> Iterator[np.ndarray]:
    """The seeds of a sequence in order: sorted if they fit memory, else dealt out by their byte ``level``, and so on."""
    if held.size[key] <= memory:
        if held.size[key]:
            yield sorted_seeds(text, held.read(key, 0, held.size[key])[0].copy(), depth)
        return
    if level >= depth:
        yield from (at for at, _ in held.forward(key, memory))
        return
    parts = Queues(folder, memory)
    for at, lcp in held.forward(key, memory):
        deal(parts, np.asarray(text[at + level]), at, lcp)
    for c in range(256):
        yield from runs(text, parts, c, level + 1, depth, folder, memory)


def deal(queues: Queues, byte: np.ndarray, at: np.ndarray, lcp: np.ndarray) -> None:
    """Push tuples onto the queues of their bytes, in order."""
    if not len(at):
        return
    by = np.argsort(byte, kind="stable")
    byte, at, lcp = byte[by], at[by], lcp[by]
    cut = np.append(0, np.flatnonzero(byte[1:] != byte[:-1]) + 1)
    for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(byte)], strict=True):
        queues.push(int(byte[i]), at[i:j], lcp[i:j])


class Inducer:
    """Pushes the predecessors of sorted tuples onto the queues of their first bytes, with the prefixes that they share."""

    def __init__(self, text: np.ndarray, small: np.ndarray, needed: np.ndarray, queues: Queues, kind: bool, depth: int):
        self.text, self.small, self.needed, self.queues, self.kind, self.depth = text, small, needed, queues, kind, depth
        #: The least common prefix among the tuples since the last one that pushed onto a queue; -1: none did.
        self.least = np.full(256, -1, np.int64)

    def __call__(self, at: np.ndarray, lcp: np.ndarray) -> None:
        n, before = len(at), at - 1
        k = np.flatnonzero(before >= 0)
        k = k[self.needed[before[k]] & (self.small[before[k]] == self.kind)]
        some = self.least >= 0
        if not len(k):
            self.least[some] = np.minimum(self.least[some], int(lcp.min()))
            return
        byte = np.asarray(self.text[before[k]])
        by = np.argsort(byte, kind="stable")
        k, byte = k[by], byte[by]
        first = np.ones(len(k), bool)
        first[1:] = byte[1:] != byte[:-1]
        start = np.empty_like(k)
        start[1:] = k[:-1] + 1
        start[first] = 0
        table = Least(lcp)
        value = table(start, k + 1)
        head = byte[first]
        value[first] = np.minimum(value[first], self.least[head])
        at_, lcp_ = before[k], np.minimum(value + 1, self.depth).astype(np.uint8)
        cut = np.flatnonzero(first)
        for i, j, c in zip(cut.tolist(), [*cut[1:].tolist(), len(k)], head.tolist(), strict=True):
            self.queues.push(c, at_[i:j], lcp_[i:j])
        self.least[some] = np.minimum(self.least[some], int(lcp.min()))
        tail = k[np.append(cut[1:], len(k)) - 1] + 1
        self.least[head] = np.where(tail < n, table(np.minimum(tail, n - 1), np.full(len(tail), n)), self.depth)


class Least:
    """Least values of ranges, from the least values of runs whose lengths are powers of two."""

    def __init__(self, x: np.ndarray):
        self.rows = [x]
        while 1 << len(self.rows) <= len(x):
            y, half = self.rows[-1], 1 << len(self.rows) - 1
            self.rows.append(np.minimum(y[:-half], y[half:]))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start), np.int64)
        level = np.frexp((end - start).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            own = np.flatnonzero(level == k)
            out[own] = np.minimum(self.rows[k][start[own]], self.rows[k][end[own] - (1 << k)])
        return out


def order(text: np.ndarray, starts: np.ndarray, depth: int = 50, memory: int = 1 << 21, folder: str | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (position, common prefix with the one before, up to ``depth``) of ``starts`` (a boolean mask over ``text``) in the order of
    their suffixes to ``depth`` bytes. The text must end as ``END``."""
    with tempfile.TemporaryDirectory(dir=folder or spill_folder()) as own:
        if len(text) > memory and not isinstance(text, np.memmap):
            path = os.path.join(own, "text")
            text.tofile(path)
            text = np.memmap(path, np.uint8, "r")
        small, seed, needed = flags(text, starts, own, memory)
        pair = lambda x, y: int(shared(text, np.array([x]), np.array([y]), depth)[0])
        raw = Queues(own, memory)
        step = chunk(memory)
        for a in range(0, len(text), step):
            at = a + np.flatnonzero(seed[a : a + step] & needed[a : a + step])
            deal(raw, np.asarray(text[at]), at, np.zeros(len(at), np.uint8))
        left, right = Queues(own, memory), Queues(own, memory)
        induce = Inducer(text, small, needed, left, False, depth)
        for c in range(256):
            for at, lcp in left.forward(c, memory):
                induce(at, lcp)
            last = left.last(c) if left.size[c] else None
            for at in runs(text, raw, c, 1, depth, own, memory):
                lcp = np.zeros(len(at), np.uint8)
                lcp[1:] = shared(text, at[:-1], at[1:], depth)
                lcp[0] = pair(last, at[0]) if last is not None else 0
                induce(at, lcp)
                last = int(at[-1])
        induce = Inducer(text, small, needed, right, True, depth)
        for c in range(255, -1, -1):
            for at, lcp in right.forward(c, memory):
                induce(at, lcp)
            for at, lcp in left.backward(c, memory, pair(right.last(c), left.last(c)) if right.size[c] and left.size[c] else 0):
                induce(at, lcp)
        least = 0
        for c in range(256):
            bound = pair(left.last(c), right.last(c)) if right.size[c] and left.size[c] else 0
            for source in (left.forward(c, memory), right.backward(c, memory, bound)):
                for at, lcp in source:
                    k = np.flatnonzero(starts[at])
                    if not len(k):
                        least = min(least, int(lcp.min()))
                        continue
                    value = np.minimum.reduceat(lcp[: k[-1] + 1], np.append(0, k[:-1] + 1)).astype(np.int64)
                    value[0] = min(least, value[0])
                    yield at[k], value
                    least = int(lcp[k[-1] + 1 :].min()) if k[-1] + 1 < len(lcp) else depth


#: Every text ends so: a seed after all others, and bytes to read over.
END = bytes([255, 0, 1]) + bytes(PAD)


def padded(parts: list[bytes]) -> np.ndarray:
    """Segments joined, with their end."""
    return np.frombuffer(b"".join([*parts, END]), np.uint8)
