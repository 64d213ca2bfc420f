"""Exact Jaccard join of word n-gram sets with signature trees.

1. Equal sets are one: their rows are pre-aggregated to the smallest id.
2. Routing loses no link: two sets at 90 % similarity differ in at most d = (|x| + |y|) / 19 elements, so of more
   than d parts of the hash space some part of both is equal. Each set sends a hash of every part (of its size
   level, and of the next where its size can meet it), without the elements that very many sets of some task hold, so that
   a line that many documents share brings none of them together. Linked sets share more parts than chance or a common
   passage makes equal, so a set with fewer shared parts than any link of its level needs (``sent``) is out. The other sets that share a
   part form a group around one that holds it; groups with the same centre are one group.
3. Each group is searched by signature trees: nodes hold the OR (and AND) of their token
   bitmaps and their size range, and a dual traversal drops node pairs whose largest possible
   overlap is too small or that are linked already. What is left is verified on the sets.
4. A group of more than ``block`` rows is searched in blocks that share leading rows. Pairs across blocks meet by what they deviate in: with D(x) the
   symmetric difference of x and the set M of elements that most leading rows hold, a linked pair
   shares at least (|D(x)| + |D(y)| - d) / 2 deviating elements, so it meets in a subgroup of one of the first few
   (``deviations``), elements outside M first. Only groups that the blocks' links leave in several components have subgroups, and only around
   elements of rows outside the largest one (``met``). Subgroups whose rows are linked already are dropped; the others are searched
   alike, and those still larger than ``block`` block against block for the rows outside their largest component.

Edge cases: null or empty text has no set and links with nothing; fewer words than n are one
element, the whole sequence; equal rows share a component; a row without an id has the component
of an equal set, if there is one, else none;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.llm import scratch, streams, textbatch
from voltlake.llm.components import components

#: Words are lower-cased A-Z; white space is these bytes (fixed values).
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORDS = textbatch.BYTE_WORDS.copy()
_WORDS[65:91] = _WORDS[97:123]
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def sets(data: np.ndarray, off: np.ndarray, n: int = 3) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text of a chunk."""
    starts, ends, doc = textbatch.spans(~_SPACE[data], off)
    empty = np.zeros(0, np.uint64)
    if not len(starts):
        return [empty] * (len(off) - 1)
    w = textbatch.ranges_hash(data, starts, ends, _WORDS)
    first = np.searchsorted(doc, np.arange(len(off)))
    count = len(w) - n + 1
    grams = np.zeros(max(count, 0), np.uint64)
    for k in range(n):
        grams += w[k : k + len(grams)] * _C[k % 5] ** np.uint64(1 + k // 5)
    grams = textbatch.mix(grams)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                h = textbatch.mix(h * _C[3] + w[k : k + 1])
            out.append(h)
        else:
            out.append(empty)
    return out


_LEVELS: dict[int, np.ndarray] = {}


def levels(keep: int) -> np.ndarray:
    """Lower bounds of the size levels: partners at ``keep`` % are on the same level or the next."""
    if keep not in _LEVELS:
        out = [1]
        while out[-1] < 1 << 40:
            out.append(max(out[-1] + 1, int(out[-1] * 103 / keep) + 1))
        _LEVELS[keep] = np.array(out)
    return _LEVELS[keep]


_BOUNDS: dict[int, np.ndarray] = {}


def bounds(m: int) -> np.ndarray:
    """The lower bounds of m equal parts of the hash space."""
    if m not in _BOUNDS:
        _BOUNDS[m] = np.array([((k << 64) + m - 1) // m for k in range(m)], np.uint64)
    return _BOUNDS[m]


def cut(level: int, keep: int) -> int:
    """The number of parts at a size level: one more than two partners can differ in, and ``spare`` ones."""
    differ = (2 * (int(levels(keep)[level + 1]) - 1) * (100 - keep)) // (100 + keep)
    return differ + 1 + spare(differ)


def spare(differ: int) -> int:
    return 1 + differ // 4


def spare_of(level: int, keep: int) -> int:
    return spare((2 * (int(levels(keep)[level + 1]) - 1) * (100 - keep)) // (100 + keep))


SLOTS = 1 << 20


def parts(s: np.ndarray, keep: int = 90, hot: np.ndarray | None = None) -> np.ndarray:
    """A set's part hashes at its own level and, where a partner may be there, the next. ``hot``: a mask of SLOTS by the low bits of elements that are left out.

    Partners without their hot elements differ in no more elements than before, so more of their parts are equal than there are spare ones.
    Empty parts say nothing: where a set has no more of them than spare parts, some part that isn't empty equals the
    partner's, and only such are sent. Other sets, of mostly hot elements, send the parts of the whole set too. Of two partners of that kind the
    same holds for their whole sets; with more empty parts than spare ones there as well both send them."""
    return sent(s, keep, hot)[0]


#: A part's code: whether it is of the next level, and how many parts of its level a linked set shares at least.
NEXT, NEED = 1 << 15, (1 << 15) - 1


def sent(s: np.ndarray, keep: int, hot: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """``parts`` and their codes. Linked sets have 1 + spare equal parts at a common level; a set with e empty ones shares 1 + spare - e others, and 1 at least."""
    rare = s if hot is None else s[~hot[(s & np.uint64(SLOTS - 1)).astype(np.int64)]]
    size, lower = len(s), levels(keep)
    own = int(np.searchsorted(lower, size, "right")) - 1
    out, code = [], []
    for level in (own, own + 1):
        if level > own and size * 100 < keep * lower[level]:
            break
        m = cut(level, keep)
        room = m - spare_of(level, keep)
        value, full = hashed(rare, m, level)
        need = max(1, 1 + int(full.sum()) - room)
        out.append(value[full])
        if full.sum() < room:
            if len(rare) < size:
                value, full = hashed(s, m, level)
            out.append(value[full] if full.sum() >= room else value)
        code.append(np.full(sum(map(len, out)) - sum(map(len, code)), min(need, NEED) + NEXT * (level > own), np.uint16))
    return np.concatenate(out), np.concatenate(code)


def hashed(s: np.ndarray, m: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the m parts of a set at a level, and which of them aren't empty."""
    at = np.searchsorted(s, bounds(m))
    sums = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(textbatch.mix(s), out=sums[1:])
    end = np.append(at[1:], len(s))
    value = textbatch.mix(sums[end] - sums[at] + np.arange(m, dtype=np.uint64) * _C[1] + np.full(m, level + 1, np.uint64) * _C[2])
    return value, end > at


def measured(docs: DataFrame, n: int = 3, share: int = 256, least: int = 16) -> DataFrame:
    """doc_id, n_shingles and a 128-bit hash of the set of every document; and rows with n_shingles -1 and, as h1, the slots of elements that one of ``share``
    different sets of a task, and ``least`` at least, hold."""

    def run(batches):
        count, total, seen = np.zeros(SLOTS, np.int32), 0, set()
        for b in batches:
            ids = b.column(0)
            for i, j, data, off in textbatch.chunks(b.column(1)):
                got = sets(data, off, n)
                one = [int(textbatch.mix(s).sum().astype(np.int64)) for s in got]
                two = [int(textbatch.mix(s ^ _C[4]).sum().astype(np.int64)) for s in got]
                for s, h in zip(got, one, strict=True):
                    if len(s) and h not in seen:
                        seen.add(h)
                        total += 1
                        count[np.unique(s & np.uint64(SLOTS - 1)).astype(np.int64)] += 1
                if len(seen) > 200_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([ids[i:j], pa.array([len(s) for s in got], pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())], names)
        slots = np.flatnonzero(count >= max(least, total // share))
        if len(slots):
            none = np.zeros(len(slots), np.int64)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(slots), pa.int64()), pa.array(none - 1), pa.array(slots), pa.array(none)], names)
        scratch.tidy()

    names = ["doc_id", "n_shingles", "h1", "h2"]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long")


def planes(columns: list[np.ndarray], widths: list[int]) -> bytes:
    """Columns of one length as bytes: of each the lowest ``width`` bytes of all rows, byte by byte, as what rows have in common then compresses."""
    return b"".join(c.view(np.uint8).reshape(len(c), c.itemsize)[:, :w].T.tobytes() for c, w in zip(map(np.ascontiguousarray, columns), widths, strict=True))


def unplaned(blob: bytes, kinds: list[type], widths: list[int]) -> list[np.ndarray]:
    n = len(blob) // sum(widths)
    out, at = [], 0
    for kind, w in zip(kinds, widths, strict=True):
        raw = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
        raw[:, :w] = np.frombuffer(blob, np.uint8, n * w, at).reshape(w, n).T
        out.append(raw.view(kind).ravel())
        at += n * w
    return out


def summed(keys: list[np.ndarray], count: np.ndarray) -> list[np.ndarray]:
    """The distinct rows of ``keys`` and the sums of their counts."""
    order = np.lexsort(keys[::-1])
    keys, count = [k[order] for k in keys], count[order]
    new = np.ones(len(count), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return [*(k[new] for k in keys), np.add.reduceat(count, np.flatnonzero(new)) if len(count) else count]


#: What is sent: parts by 40 bits (with the bucket about 50; equal ones of unlike sets only cost a comparison), ids and codes; and pairs with counts.
_PART = ([np.uint64, np.int64, np.uint16], [5, 8, 2])
_PAIR = ([np.int64, np.int64, np.uint16, np.uint32], [8, 8, 2, 4])


def stars(docs: DataFrame, n: int, keep: int, hot: np.ndarray) -> DataFrame:
    """Distinct (centre, doc_id): the documents that share enough part hashes with others for a link, by one that holds such a hash, maybe themselves."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(hot)

    def dealt_out(to: np.ndarray, columns: list[np.ndarray], widths: list[int]):
        order = np.argsort(to, kind="stable")
        columns, at = [c[order] for c in columns], np.searchsorted(to[order], np.arange(buckets + 1))
        own = [k for k in range(buckets) if at[k] < at[k + 1]]
        return own, [planes([c[at[k] : at[k + 1]] for c in columns], widths) for k in own], [int(columns[1][at[k] : at[k + 1]].min()) for k in own]

    def send(batches, most: int = 300_000):
        held: list[tuple] = []
        ids: list[np.ndarray] = []
        seen: dict[bytes, int] = {}

        def flush():
            sig, code = (np.concatenate(x) for x in zip(*held, strict=True))
            doc = np.concatenate(ids)
            held.clear()
            ids.clear()
            seen.clear()
            own, blobs, lead = dealt_out(((sig >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32), [sig, doc, code], _PART[1])
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(lead, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "lead", "data"])

        size = 0
        for b in batches:
            doc = b.column(0).to_numpy(zero_copy_only=False)
            for i, _, data, off in textbatch.chunks(b.column(1)):
                for k, s in enumerate(sets(data, off, n)):
                    if not len(s):
                        continue
                    # Of equal sets near each other only the smallest id is sent.
                    key = textbatch.mix(s).sum().tobytes() + textbatch.mix(s ^ _C[4]).sum().tobytes()
                    place = seen.setdefault(key, len(held))
                    if place < len(held):
                        ids[place][:] = min(ids[place][0], doc[i + k])
                        continue
                    held.append(sent(s, keep, shared.value))
                    ids.append(np.full(len(held[-1][0]), doc[i + k], np.int64))
                    size += len(ids[-1])
                if size > most:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()
        scratch.tidy()

    def meet(batches, most: int = 500_000):
        # One centre for each value is kept, so that a value that very many documents hold needs no more memory than a rare one.
        # ``told``: whether the value was counted for its centre.
        known, centre, codes, told = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint16), np.zeros(0, bool)

        def flush():
            nonlocal known, centre, codes, told
            sig, doc, code = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((doc, sig))
            sig, doc, code = sig[order], doc[order], code[order]
            new = np.ones(len(sig), bool)
            new[1:] = sig[1:] != sig[:-1]
            value, first, first_code, was = sig[new], doc[new], code[new], np.zeros(new.sum(), bool)
            at = np.minimum(np.searchsorted(known, value), max(len(known) - 1, 0))
            old = known[at] == value if len(known) else np.zeros(len(value), bool)
            if old.any():
                first[old], first_code[old], was[old] = centre[at[old]], codes[at[old]], told[at[old]]
            by = first[np.cumsum(new) - 1]
            far = by != doc
            now = np.logical_or.reduceat(far, np.flatnonzero(new))
            own = now & ~was
            if far.any():
                pairs = [np.append(by[far], first[own]), np.append(doc[far], first[own]), np.append(code[far], first_code[own])]
                yield from packed(summed(pairs, np.ones(len(pairs[0]), np.uint32)))
            if old.any():
                told[at[old]] |= now[old]
            known, centre, codes, told = np.append(known, value[~old]), np.append(centre, first[~old]), np.append(codes, first_code[~old]), np.append(told, now[~old])
            order = np.argsort(known, kind="stable")
            known, centre, codes, told = known[order], centre[order], codes[order], told[order]

        held: list[list] = []
        for b in batches:
            for x in b.column("data").to_pylist():
                held.append(unplaned(x, *_PART))
                if sum(len(s) for s, _, _ in held) > most:
                    yield from flush()
        if held:
            yield from flush()
        scratch.tidy()

    def packed(pairs: list[np.ndarray]):
        """Pairs packed by the bucket of their document: near copies share many parts, so a pair comes from many tasks, and these meet in one."""
        to = (textbatch.mix(pairs[1].view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        own, blobs, _ = dealt_out(to, pairs, _PAIR[1])
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "data"])

    def once(batches, most: int = 500_000):
        held, size = [], 0
        for b in batches:
            for x in b.column("data").to_pylist():
                held.append(unplaned(x, *_PAIR))
                size += len(held[-1][0])
                if size > most:
                    *keys, count = (np.concatenate(c) for c in zip(*held, strict=True))
                    held = [summed(keys, count)]
                    size, most = len(held[0][0]), max(most, 2 * len(held[0][0]))
        if held:
            *keys, count = (np.concatenate(c) for c in zip(*held, strict=True))
            centre, doc, code, count = summed(keys, count.astype(np.int64))
            order = np.lexsort((code, doc))
            centre, doc, code, count = centre[order], doc[order], code[order], count[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
            enough = (np.add.reduceat(count, np.flatnonzero(new)) >= (code[new] & NEED))[np.cumsum(new) - 1]
            both = np.unique(np.stack([centre[enough], doc[enough]], axis=1), axis=0)
            for i in range(0, len(both), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(both[i : i + (1 << 16), k].copy()) for k in (0, 1)], ["centre", "doc_id"])
        scratch.tidy()

    text = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sent_ = text.mapInArrow(send, "bucket int, lead long, data binary")
    dealt = sent_.repartition(buckets, "bucket").sortWithinPartitions("bucket", "lead")
    met_ = dealt.select("data").mapInArrow(meet, "bucket int, data binary")
    return met_.repartition(buckets, "bucket").select("data").mapInArrow(once, "centre long, doc_id long")


class Forest:
    """Union-find over the rows of a group."""

    def __init__(self, labels: np.ndarray):
        self.up = np.arange(len(labels))
        seen: dict[int, int] = {}
        for k, x in enumerate(labels.tolist()):
            if x in seen:
                self.up[k] = seen[x]
            else:
                seen[x] = k

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = int(self.up[k])
        return k

    def flat(self) -> np.ndarray:
        while (self.up != self.up[self.up]).any():
            self.up = self.up[self.up]
        return self.up


class Tree:
    """Signature tree: levels of nodes over rows in order; level 0 is the rows. ``root``: what each row is linked to already."""

    def __init__(self, rows: list[np.ndarray], root: np.ndarray, fan: int = 8):
        size = np.array([len(r) for r in rows])
        bits = 1 << min(14, max(11, int(8 * size.max()).bit_length()))
        bitmap = np.zeros((len(rows), bits), bool)
        for k, r in enumerate(rows):
            bitmap[k, (r & np.uint64(bits - 1)).astype(np.int64)] = True
        any_ = np.packbits(bitmap, axis=1).view(np.uint64)
        self.any, self.all, self.low, self.high = [any_], [any_], [size], [size]
        self.root = [(root, root)]
        while len(self.low[-1]) > 1:
            at = np.arange(0, len(self.low[-1]), fan)
            self.any.append(np.bitwise_or.reduceat(self.any[-1], at, axis=0))
            self.all.append(np.bitwise_and.reduceat(self.all[-1], at, axis=0))
            self.low.append(np.minimum.reduceat(self.low[-1], at))
            self.high.append(np.maximum.reduceat(self.high[-1], at))
            self.root.append((np.minimum.reduceat(self.root[-1][0], at), np.maximum.reduceat(self.root[-1][1], at)))
        self.fan = fan

    def may(self, level: int, a: np.ndarray, b: np.ndarray, keep: int) -> np.ndarray:
        """Whether node pairs of a level can hold a new link: they aren't linked whole, the size ranges allow it and what
        either side surely lacks leaves enough overlap."""
        lo, hi = self.low[level], self.high[level]
        one, other = self.root[level]
        ok = (100 * hi[a] >= keep * lo[b]) & (100 * hi[b] >= keep * lo[a]) & ~((one[a] == other[a]) & (one[b] == other[b]) & (one[a] == one[b]))
        at = np.flatnonzero(ok)
        a, b = a[at], b[at]
        lack = np.bitwise_count(self.all[level][a] & ~self.any[level][b]).sum(axis=1, dtype=np.int64)
        lack += np.bitwise_count(self.all[level][b] & ~self.any[level][a]).sum(axis=1, dtype=np.int64)
        ok[at] = lack * (100 + keep) <= (hi[a] + hi[b]) * (100 - keep)
        return ok


def overlap(flat: np.ndarray, begin: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The size of the intersection of x with each of the sets in ``flat`` that start at ``begin``; none is empty."""
    at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
    return np.add.reduceat((x[at] == flat).astype(np.int64), begin)


def similar(x: np.ndarray, y: np.ndarray, keep: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= keep * (len(x) + len(y) - both)


def search(rows: list[np.ndarray], ids: np.ndarray, labels: np.ndarray, keep: int, left: np.ndarray | None = None, leads: int = 1) -> list[tuple[int, int]]:
    """Links that join all rows reachable by links. ``labels``: equal ones are joined already. ``left``: only pairs with at
    least one of these rows are sought. The ``leads`` smallest ids are compared with all rows at once, then the trees are traversed."""
    forest, links = Forest(labels), []
    if left is None:
        size = np.array([len(r) for r in rows])
        flat, begin = np.concatenate(rows), np.cumsum(size) - size
        for p in np.argsort(ids, kind="stable")[: len(rows) if len(rows) <= 24 else leads].tolist():
            both = overlap(flat, begin, rows[p])
            for j in np.flatnonzero(100 * both >= keep * (size + size[p] - both)).tolist():
                x, y = forest.root(p), forest.root(j)
                if x != y:
                    forest.up[y] = x
                    links.append((int(ids[p]), int(ids[j])))
    root = forest.flat()
    if len(rows) <= 24 and left is None or (root == root[0]).all():
        return links
    order = np.lexsort((np.array([r[0] for r in rows]), np.array([len(r) for r in rows]), root))
    rows, ids = [rows[k] for k in order], ids[order]
    left = left[order] if left is not None else None
    forest = Forest(root[order])
    tree = Tree(rows, root[order])
    top = len(tree.low) - 1
    stack = [(top, np.array([0]), np.array([0]))]
    while stack:
        level, a, b = stack.pop()
        if not len(a):
            continue
        ok = tree.may(level, a, b, keep)
        a, b = a[ok], b[ok]
        if level:
            n, fan = len(tree.low[level - 1]), tree.fan
            x = (a[:, None, None] * fan + np.arange(fan)[None, :, None]) + np.zeros((1, 1, fan), int)
            y = (b[:, None, None] * fan + np.arange(fan)[None, None, :]) + np.zeros((1, fan, 1), int)
            x, y = x.ravel(), y.ravel()
            fine = (x < n) & (y < n) & (x <= y) if level > 1 else (x < n) & (y < n) & (x < y)
            x, y = x[fine], y[fine]
            if level == 1:
                if left is not None:
                    some = left[x] | left[y]
                    x, y = x[some], y[some]
                roots = forest.flat()
                new = roots[x] != roots[y]
                x, y = x[new], y[new]
            for k in range(0, len(x), 4096):
                stack.append((level - 1, x[k : k + 4096], y[k : k + 4096]))
            continue
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            p, q = forest.root(i), forest.root(j)
            if p != q and similar(rows[i], rows[j], keep):
                forest.up[q] = p
                links.append((int(ids[i]), int(ids[j])))
    return links


def deviations(rows: list[np.ndarray], lead: np.ndarray, key: int, keep: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(subgroup, row): where rows of different blocks of a group meet. ``lead``: the rows that every block holds.

    M holds the elements of most leads, q is the lead nearest to M (the more leads, the nearer), D(x) what x and M differ in, A(x, y) what linked sets may differ in at most. A linked pair
    shares at least (|D(x)| + |D(y)| - A) / 2 elements of D. Is that none or less, then either both are linked to q, or one is
    not and the other has |D| < |D(q)| (1 + c) / (1 - c) =: inner by the triangle inequality (c = A / (|x| + |y|)), so that A is at most
    c (|x| + |M| + inner), and neither |D| is over A: these meet in one subgroup of their own. Otherwise the pair meets in the subgroup of one of the first |D| - least + 1 elements of
    both (rare ones outside M, hot ones, then those of M), if ``least`` shared ones are sure: |D(x)| - A of any x, and for x linked to q (|D(x)| - |D(q)| + c (|q| - |x|)) / 2, as y then isn't."""
    c = (100 - keep) / (100 + keep)
    u, count = np.unique(np.concatenate([rows[k] for k in lead]), return_counts=True)
    main = u[2 * count > len(lead)]
    size = np.array([len(r) for r in rows])
    begin = np.cumsum(size) - size
    flat = np.concatenate(rows)
    both = overlap(flat, begin, main) if len(main) else np.zeros(len(rows), np.int64)
    off = size + len(main) - 2 * both
    q = int(lead[np.argmin(off[lead])])
    shared = overlap(flat, begin, rows[q])
    tied = 100 * shared >= keep * (size + size[q] - shared)
    most = c * size * (1 + 100 / keep) + 1e-6
    least = np.where(tied, np.ceil((off - off[q] + c * (size[q] - size)) / 2 - 1e-6), np.ceil(off - most))
    first = np.maximum(off - np.maximum(least, 1) + 1, 0).astype(np.int64)
    base = textbatch.mix(np.full(1, key, np.int64).view(np.uint64) * _C[1])
    keys, at = [], []
    for k, r in enumerate(rows):
        if off[k]:
            more, less = np.setdiff1d(r, main, assume_unique=True), np.setdiff1d(main, r, assume_unique=True)
            often = hot[(more & np.uint64(SLOTS - 1)).astype(np.int64)] if hot is not None else np.zeros(len(more), bool)
            own = np.concatenate([more[~often], more[often], less])[: first[k]]
            keys.append(textbatch.mix(own ^ base))
            at.append(np.full(len(own), k))
    inner = off[q] * (1 + c) / (1 - c) + 1e-6
    near = np.flatnonzero((off <= most) & ((~tied & (off <= c * (size + len(main) + inner) + 1e-6)) | (off < inner)))
    keys.append(np.repeat(textbatch.mix(base + _C[2]), len(near)))
    at.append(near)
    return np.concatenate(keys).view(np.int64), np.concatenate(at)


_FIELDS = ("grp", "block", "to", "doc_id", "label", "lead", "rest", "data")


def _blocks(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*_FIELDS).repartition(n, "grp", "block", "to").sortWithinPartitions("grp", "block", "to")


def _block(t: pa.Table) -> tuple[np.ndarray, list[np.ndarray], dict[str, np.ndarray]]:
    """Ids, sets and the other columns of a block, each id once."""
    ids, once = np.unique(t.column("doc_id").to_numpy(), return_index=True)
    data = t.column("data").to_pylist()
    return ids, [np.frombuffer(data[k], np.uint64) for k in once], {k: t.column(k).to_numpy(zero_copy_only=False)[once] for k in ("label", "lead", "rest")}


def _searched(rows: DataFrame, keep: int) -> DataFrame:
    """Links (a, b) within each block of ``rows`` (grp, block, to, doc_id, label, lead, rest, data). Where ``to`` isn't -1, only pairs with a row that is ``rest`` are sought."""

    def run(batches):
        for (_, _, to), t in streams.groups(batches, ["grp", "block", "to"]):
            ids, own, of = _block(t)
            if len(own) < 2:
                continue
            left = of["rest"].astype(bool) if to >= 0 else None
            got = search(own, ids, of["label"], keep, left, min(8, max(1, int(of["lead"].sum()))))
            if got:
                a, b = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        scratch.tidy()

    return _blocks(rows).mapInArrow(run, "a long, b long")


#: Subgroup, id and whether the row is outside its group's largest component.
_MEMBER = ([np.int64, np.int64, np.uint8], [8, 8, 1])


def met(rows: DataFrame, keep: int, hot) -> DataFrame:
    """Distinct (grp, doc_id): the subgroups of blocks with leads (``rows`` as for ``_searched``) that hold a row that is ``rest`` and another. ``hot``: a broadcast mask."""
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(batches):
        for (grp, _, _), t in streams.groups(batches, ["grp", "block", "to"]):
            ids, own, of = _block(t)
            key, at = deviations(own, np.flatnonzero(of["lead"].astype(bool)), grp, keep, hot.value)
            to = (textbatch.mix(key.view(np.uint64) ^ _C[3]) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            key, at, ends = key[order], at[order], np.searchsorted(to[order], np.arange(buckets + 1))
            full = [k for k in range(buckets) if ends[k] < ends[k + 1]]
            blobs = [planes([key[i:j], ids[at[i:j]], of["rest"][at[i:j]].astype(np.uint8)], _MEMBER[1]) for i, j in ((ends[k], ends[k + 1]) for k in full)]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "data"])
        scratch.tidy()

    def meet(batches):
        held = [unplaned(x, *_MEMBER) for b in batches for x in b.column("data").to_pylist()]
        if held:
            key, doc, rest = (np.concatenate(c) for c in zip(*held, strict=True))
            key, doc, rest = summed([key, doc], rest.astype(np.int64))
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(start, len(key)))
            use = np.repeat((np.add.reduceat(rest, start) > 0) & (size > 1), size)
            key, doc = key[use], doc[use]
            for i in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(key[i : i + (1 << 16)]), pa.array(doc[i : i + (1 << 16)])], ["grp", "doc_id"])
        scratch.tidy()

    sent_ = _blocks(rows).mapInArrow(send, "bucket int, data binary")
    return sent_.repartition(buckets, "bucket").select("data").mapInArrow(meet, "grp long, doc_id long")


def placed(members: DataFrame, block: int, leads: int) -> DataFrame:
    """``members`` (grp, doc_id, label) of groups of two or more, with blocks, block, lead, rest and to. The smallest ids of a group of several
    blocks are in every block."""
    count = members.groupBy("grp").agg(F.count("*").alias("size")).where("size > 1").select("grp", F.ceil(F.col("size") / block).cast("long").alias("blocks"))
    own = scratch.table(members.join(count, "grp"), "groups")
    plain = own.withColumns({"block": F.pmod(F.xxhash64("doc_id"), "blocks"), "lead": F.lit(False)})
    large = own.where("blocks > 1")
    first = large.join(least_of(large, ["grp"], leads), ["grp", "doc_id"])
    first = first.withColumns({"block": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)), "lead": F.lit(True)})
    both = plain.unionByName(first).groupBy("grp", "blocks", "block", "doc_id").agg(F.first("label").alias("label"), F.max("lead").alias("lead"))
    return both.withColumns({"rest": F.lit(False), "to": F.lit(-1).cast("long")})


def least_of(rows: DataFrame, group: list[str], k: int) -> DataFrame:
    """(group, doc_id): the k smallest ids of each group, kept as they are merged."""
    few = rows.groupBy(*group, F.pmod(F.xxhash64("doc_id"), F.lit(1024)).alias("salt")).agg(F.min("doc_id").alias("doc_id"))
    return few.groupBy(*group).agg(F.slice(F.array_sort(F.collect_list("doc_id")), 1, k).alias("ids")).select(*group, F.explode("ids").alias("doc_id"))


def largest(members: DataFrame) -> DataFrame:
    """(grp, main, k): the most frequent label of each group with several."""
    weight = members.groupBy("grp", "label").agg(F.count("*").alias("w"))
    return weight.groupBy("grp").agg(F.max_by("label", F.struct("w", "label")).alias("main"), F.count("*").alias("k")).where("k > 1")


def across(members: DataFrame, data: DataFrame, keep: int, block: int) -> DataFrame:
    """Links of ``members`` (grp, doc_id, label, blocks) of groups of several blocks, whose blocks are searched: rows
    outside the largest component meet every block."""
    main = scratch.table(largest(members), "main")
    tagged = scratch.table(members.join(main, "grp").withColumns({"rest": F.col("label") != F.col("main"), "own": F.pmod(F.xxhash64("doc_id"), "blocks")}), "tagged")
    rest = tagged.where("rest")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    more = rest.select("grp", "doc_id", "label", "rest", every.alias("block"), F.col("own").alias("to"))
    tos = rest.groupBy("grp").agg(F.collect_set("own").alias("tos"))
    own = tagged.join(tos, "grp").select("grp", "doc_id", "label", F.lit(False).alias("rest"), F.col("own").alias("block"), F.explode("tos").alias("to"))
    tasks = more.unionByName(own).groupBy("grp", "block", "to", "doc_id").agg(F.first("label").alias("label"), F.max("rest").alias("rest"))
    return _searched(tasks.withColumn("lead", F.lit(False)).join(data, "doc_id"), keep)


def links(docs: DataFrame, known: DataFrame, hot: np.ndarray, n: int, keep: int, block: int = 1024, leads: int = 64) -> DataFrame:
    """(doc_id, component) of the documents with a link to another set. ``known``: doc_id and rep, the smallest id with the same set."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rep = known.where("doc_id = rep").select("doc_id").distinct()
    # Copies have the parts of the row that stands for them; a count shows whether their ids can be broadcast.
    copies = scratch.table(known.where("doc_id <> rep").select("doc_id").distinct().join(rep, "doc_id", "left_anti"), "copies")
    alone = text.join(F.broadcast(copies), "doc_id", "left_anti") if copies.limit(1_000_001).count() <= 1_000_000 else text
    star = stars(alone, n, keep, hot).join(rep, "doc_id", "left_semi").join(known.select(F.col("doc_id").alias("centre"), F.col("rep").alias("grp")).distinct(), "centre")
    star = scratch.table(star.select("grp", "doc_id").distinct(), "stars")
    rows = scratch.table(placed(star.withColumn("label", F.col("doc_id")), block, leads), "blocks")
    ids = scratch.table(rows.select("doc_id").distinct(), "candidates")

    def encode(batches):
        for b in batches:
            for i, j, data, off in textbatch.chunks(b.column("text")):
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[i:j], pa.array([s.tobytes() for s in sets(data, off, n)], pa.binary())], ["doc_id", "data"])
        scratch.tidy()

    data = scratch.table(text.join(scratch.checked(ids), "doc_id").select("doc_id", "text").mapInArrow(encode, "doc_id long, data binary"), "sets")
    near = scratch.table(_searched(rows.join(data, "doc_id"), keep), "found")
    linked = components(near)
    joined = linked.select(F.col("node").alias("doc_id"), "component")
    scratch.drop(star, ids, copies)
    large = rows.where("blocks > 1").drop("label", "rest").join(joined, "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component")
    tagged = scratch.table(large.join(largest(large), "grp").withColumn("rest", F.col("label") != F.col("main")), "tagged")
    if tagged.isEmpty():
        scratch.drop(data, near, rows, tagged)
        return joined
    apart = met(tagged.join(data, "doc_id"), keep, docs.sparkSession.sparkContext.broadcast(hot))
    apart = scratch.table(apart.join(joined, "doc_id", "left").select("grp", "doc_id", F.coalesce("component", "doc_id").alias("label")), "apart")
    open_ = apart.groupBy("grp").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("grp")
    sub = scratch.table(placed(apart.join(open_, "grp", "left_semi"), block, leads), "subgroups")
    late = scratch.table(_searched(sub.join(data, "doc_id"), keep), "late")
    every = near.union(late)
    wide = sub.where("blocks > 1")
    if not wide.isEmpty():
        now = components(every).select(F.col("node").alias("doc_id"), "component")
        wide = wide.select("grp", "doc_id", "blocks").distinct().join(now, "doc_id", "left").select("grp", "doc_id", "blocks", F.coalesce("component", "doc_id").alias("label"))
        every = every.union(across(scratch.table(wide, "wide"), data, keep, block))
    got = components(every)
    scratch.drop(data, near, linked, rows, tagged, apart, late)
    return got.select(F.col("node").alias("doc_id"), "component")


def join(docs: DataFrame, n: int = 3, keep: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    with scratch.small_batches(docs.sparkSession):
        return _join(docs, n, keep)


def _join(docs: DataFrame, n: int, keep: int) -> DataFrame:
    stored = scratch.table(measured(docs, n), "measured")
    base, hot = stored.where("n_shingles >= 0"), np.zeros(SLOTS, bool)
    hot[[r["h1"] for r in stored.where("n_shingles = -1").select("h1").distinct().collect()]] = True  # at most SLOTS
    full = base.where("n_shingles > 0 and doc_id is not null")
    reps = scratch.table(full.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep")), "reps")
    known = scratch.table(base.join(reps, ["h1", "h2", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "known")
    scratch.drop(stored, reps)
    linked = links(docs, known.where("n_shingles > 0 and doc_id is not null").select("doc_id", "rep"), hot, n, keep)
    got = known.join(linked.select(F.col("doc_id").alias("rep"), "component"), "rep", "left")
    return got.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def op9(spark, sf_dir: str) -> DataFrame:
    """Three-word shingles of every document, linked at a Jaccard similarity of 0.9."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def keep_one(docs: DataFrame, n: int = 3, keep: int = 90) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its linked group; rows without an id stay."""
    other = join(docs.select("doc_id", "text"), n, keep).where("doc_id <> component_id").select("doc_id").distinct()
    other = scratch.table(other, "later-rows")
    few = other.limit(2_000_001).count() <= 2_000_000
    return docs.join(F.broadcast(other) if few else other, "doc_id", "left_anti")
