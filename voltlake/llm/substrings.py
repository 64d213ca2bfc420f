"""Removal of long byte strings that also start in an earlier document, by suffix sorting.

1. Copies of a whole text are found by hash, pre-aggregated: all but the smallest id lose
   everything (if at least ``depth`` bytes), and only the first takes part below.
2. Every ``depth``-byte string has a minimizer: the least hash among its 25-byte strings. Equal
   strings have equal minimizers, so those that occur in one document only rule out all strings around them. Their
   hashes are dealt out by value, pre-aggregated per task and group of documents.
3. Segments around the other minimizers (all strings that share one) are dealt out by the minimizer:
   equal strings meet in one shard. Equal segments of a group of documents are
   sent once; later documents' copies are removed at once. Segments of a minimizer that very many documents hold are split in two, by the 13
   bytes before or after it that all their strings share, and dealt out by these too.
4. Each shard orders its strings by external induced sorting (``induced``), whose common-prefix values tell runs of equal strings:
   these give the smallest document id, and every other document's strings in the run are removed. What a shard holds in memory is
   bounded, but for 24 bytes a segment and the run at hand.
5. The runs meet their texts once more.

Edge cases: null text counts as empty; texts under ``depth`` bytes stay; strings never cross
documents; repeated rows of an id never remove from each other, and of several texts under one id the one with the
least hash is the document, the others stay whole and count for nothing; a row without an id stays whole; overlapping strings count; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.llm import induced, scratch, textbatch

GRAM = 25
_ROW = "g int, kind int, doc_id long, data binary"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 25 bytes from each position, by doubling."""
    h = textbatch.BYTE_WORDS[data]
    n = len(h)
    m = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]
    long = h
    for k, step in enumerate((1, 2, 4, 8)):
        long = long[:-step] * m[k] + long[step:]
        long ^= long >> np.uint64(29)
    # Each now covers 16 bytes; two that overlap cover 25.
    out = long[: n - GRAM + 1] * m[0] + long[9 : n - GRAM + 10]
    return textbatch.mix(out)


def minimizers(data: np.ndarray, off: np.ndarray, depth: int):
    """(doc index, first string, end string, hash, place of the minimizer) of each maximal run of strings of a document with
    the same minimizer occurrence; positions are within the chunk."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    wide = depth - GRAM + 1
    if len(data) < depth:
        return none
    h = gram_hashes(data)
    bits = max(1, int(len(h)).bit_length())
    low = (h & ~np.uint64((1 << bits) - 1)) | np.arange(len(h), dtype=np.uint64)
    best, span = low, 1
    while span < wide:
        step = min(span, wide - span)
        best = np.minimum(best[:-step], best[step:])
        span += step
    last = off[1:] - depth  # the last string of each document
    ok = np.zeros(len(best) + 1, np.int32)
    own = last >= off[:-1]
    np.add.at(ok, off[:-1][own], 1)
    np.subtract.at(ok, last[own] + 1, 1)
    valid = np.cumsum(ok[:-1]) > 0
    new = np.ones(len(best), bool)
    new[1:] = best[1:] != best[:-1]
    new[off[:-1][(off[:-1] < len(best))]] = True
    at = np.flatnonzero(new)
    at_end = np.append(at[1:], len(best))
    doc = np.searchsorted(off, at, "right") - 1
    at_end = np.minimum(at_end, off[doc + 1] - depth + 1)
    fine = valid[at] & (at_end > at)
    at, at_end, doc = at[fine], at_end[fine], doc[fine]
    where = (best[at] & np.uint64((1 << bits) - 1)).astype(np.int64)
    return doc, at, at_end, h[where], where


def split(data: np.ndarray, at: np.ndarray, end: np.ndarray, h: np.ndarray, where: np.ndarray, depth: int):
    """(row, first string, end string, hash): each run in two, those strings that hold ``side`` bytes after the minimizer and those that hold as many before it,
    with a hash of the minimizer and these bytes. Equal strings get equal hashes."""
    side = (depth - GRAM + 1) // 2
    edge = np.clip(where - (depth - GRAM - side), at, end)
    rows, parts = [], []
    for k, (a, b, s) in enumerate(((edge, end, where + GRAM), (at, edge, where - side))):
        own = np.flatnonzero(a < b)
        context = textbatch.ranges_hash(data, s[own], s[own] + side)
        rows.append(own)
        parts.append((a[own], b[own], textbatch.mix(h[own] * np.uint64(0x9E3779B97F4A7C15) + context + np.uint64(k))))
    return np.concatenate(rows), *(np.concatenate([p[i] for p in parts]) for i in range(3))


def groups(ids: np.ndarray, n: int) -> np.ndarray:
    """The group of each document id."""
    return (textbatch.mix(ids.astype(np.uint64) + np.uint64(11)) >> np.uint64(33)).astype(np.int64) % n


def _rows(g, kind, doc, data) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(kind, pa.int32()), pa.array(doc, pa.int64()), pa.array(data, pa.binary())], ["g", "kind", "doc_id", "data"])


def _dealt(to: np.ndarray, n: int, kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    """A row for each destination: its part of every column, packed."""
    by = np.argsort(to, kind="stable")
    to, columns = to[by], [c[by] for c in columns]
    at = np.searchsorted(to, np.arange(n + 1))
    own = [k for k in range(n) if at[k] < at[k + 1]]
    blobs = [b"".join([(int(at[k + 1] - at[k])).to_bytes(8, "little"), *(c[at[k] : at[k + 1]].tobytes() for c in columns)]) for k in own]
    return _rows(own, [kind] * len(own), [None] * len(own), blobs)


def _packed(blob: bytes, *kinds) -> list[np.ndarray]:
    n, at, out = int.from_bytes(blob[:8], "little"), 8, []
    for kind in kinds:
        size = n * np.dtype(kind).itemsize
        out.append(np.frombuffer(blob[at : at + size], kind))
        at += size
    return out


def shared_hashes(docs: DataFrame, depth: int, n: int, often: int) -> DataFrame:
    """(g, data): for each group of documents the minimizer hashes that another document has too, odd if ``often`` groups of tasks
    hold them."""

    def send(batches, most: int = 1_000_000):
        held, size = [], 0

        def flush():
            g, h, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            by = np.lexsort((doc, h, g))
            g, h, doc = g[by], h[by], doc[by]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            at = np.flatnonzero(new)
            many = np.maximum.reduceat(doc, at) != doc[at]
            g, h = g[at], (h[at] & ~np.uint64(1)) | many.astype(np.uint64)
            yield _dealt(((h >> np.uint64(40)) % np.uint64(n)).astype(np.int64), n, 0, h, g.astype(np.int32))

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i, j, data, off in textbatch.chunks(b.column(1)):
                doc, _, _, h, _ = minimizers(data, off, depth)
                if len(h):
                    own = ids[i:j][doc]
                    held.append((groups(own, n), h, own))
                    size += len(h)
                if size > most:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    def meet(batches):
        got = [_packed(x, np.uint64, np.int32) for b in batches for x in b.column("data").to_pylist()]
        if got:
            h, g = (np.concatenate(x) for x in zip(*got, strict=True))
            bare = h & ~np.uint64(1)
            by = np.argsort(bare, kind="stable")
            h, bare, g = h[by], bare[by], g[by]
            new = np.ones(len(h), bool)
            new[1:] = bare[1:] != bare[:-1]
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(h)))
            many = (count > 1) | (np.maximum.reduceat(h & np.uint64(1), at) > 0)
            keep = np.repeat(many, count)
            hot = np.repeat(count >= often, count)[keep].astype(np.uint64)
            bare, g = bare[keep] | hot, g[keep].astype(np.int64)
            if len(bare):
                yield _dealt(g, n, 0, bare)
        scratch.tidy()

    sent = docs.select("doc_id", "text").mapInArrow(send, _ROW)
    return sent.select("g", "data").repartition(n, "g").mapInArrow(meet, _ROW)


def _by_group(batches):
    """Rows come sorted by (g, kind); yields (g, blobs of kind 0, text batches)."""
    now, blobs, texts = None, [], []
    for b in batches:
        g = b.column("g").to_numpy(zero_copy_only=False)
        kind = b.column("kind").to_numpy(zero_copy_only=False)
        cut = np.flatnonzero((g[1:] != g[:-1]) | (kind[1:] != kind[:-1])) + 1
        for i, j in zip(np.append(0, cut), np.append(cut, len(g)), strict=True):
            if i == j:
                continue
            if g[i] != now:
                now, blobs = int(g[i]), []
            if kind[i] == 0:
                blobs += b.column("data")[i:j].to_pylist()
            else:
                yield now, blobs, b.slice(i, j - i)


def _with_texts(rows: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """Rows (g, kind, doc_id, data) dealt to groups, joined by the group's texts (kind 1)."""

    def tag(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            yield _rows(groups(ids, n).astype(np.int32), np.ones(len(ids), np.int32), b.column(0), b.column(1).cast(pa.binary()))

    texts = docs.select("doc_id", "text").mapInArrow(tag, _ROW)
    return rows.select("g", "kind", "doc_id", "data").union(texts).repartition(n, "g").sortWithinPartitions("g", "kind")


def segments(shared: DataFrame, docs: DataFrame, depth: int, n: int, shards: int) -> DataFrame:
    """Rows of kind 2 (to a shard: segments) and kind 0 (to a group: runs)."""

    def cut(batches):
        held, size = [], 0

        def flush():
            doc, pos, count, h, key, raw = (np.concatenate([x[k] for x in held]) if k < 5 else [y for x in held for y in x[5]] for k in range(6))
            held.clear()
            # Equal segments: later documents lose theirs here.
            by = np.lexsort((doc, key))
            new = np.ones(len(by), bool)
            new[1:] = key[by][1:] != key[by][:-1]
            least = doc[by][new][np.cumsum(new) - 1]
            late = np.zeros(len(by), bool)
            late[by] = doc[by] > least
            if late.any():
                d, p, e = doc[late], pos[late], pos[late] + count[late] + depth - 1
                yield from _runs(d, p, e, n)
            go = np.flatnonzero(~late)
            to = ((h[go] >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)
            go = go[np.argsort(to, kind="stable")]
            to = np.sort(to, kind="stable")
            at = np.searchsorted(to, np.arange(shards + 1))
            own = [k for k in range(shards) if at[k] < at[k + 1]]
            blobs = []
            for k in own:
                x = go[at[k] : at[k + 1]]
                blobs.append(b"".join([len(x).to_bytes(8, "little"), doc[x].tobytes(), pos[x].tobytes(), count[x].tobytes(), *(raw[i] for i in x.tolist())]))
            yield _rows(own, [2] * len(own), [None] * len(own), blobs)

        for _, blobs, b in _by_group(batches):
            known = known_of(blobs)
            if not len(known):
                continue
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for i, _, data, off in textbatch.chunks(b.column("data")):
                doc, at, end, h, where = minimizers(data, off, depth)
                h &= ~np.uint64(1)
                k = np.minimum(np.searchsorted(known & ~np.uint64(1), h), len(known) - 1)
                hit = known[k] & ~np.uint64(1) == h
                if not hit.any():
                    continue
                hot = (known[k] & np.uint64(1)).astype(bool) & hit
                if hot.any():
                    row, a, b, x = split(data, at[hot], end[hot], h[hot], where[hot], depth)
                    rest = hit & ~hot
                    doc, at, end, h = (np.concatenate(x) for x in ((doc[rest], doc[hot][row]), (at[rest], a), (end[rest], b), (h[rest], x)))
                else:
                    doc, at, end, h = doc[hit], at[hit], end[hit], h[hit]
                key = textbatch.ranges_hash(data, at, end + depth - 1)
                flat = data.tobytes()
                raw = [flat[s:e] for s, e in zip(at.tolist(), (end + depth - 1).tolist(), strict=True)]
                held.append((ids[i + doc], at - off[doc], end - at, h, key, raw))
                size += sum(map(len, raw))
                if size > 1 << 23:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()
        scratch.tidy()

    last: dict[int, np.ndarray] = {}

    def known_of(blobs):
        if id(blobs) not in last:
            last.clear()
            last[id(blobs)] = np.unique(np.concatenate([_packed(x, np.uint64)[0] for x in blobs])) if blobs else np.zeros(0, np.uint64)
        return last[id(blobs)]

    return _with_texts(shared, docs, n).mapInArrow(cut, _ROW)


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Runs joined where they touch or overlap, by document."""
    by = np.lexsort((start, doc))
    doc, start, end = doc[by], start[by], end[by]
    new = np.ones(len(doc), bool)
    # The running maximum of ends within a document: documents are told apart by a shift.
    _, rank = np.unique(doc, return_inverse=True)
    shift = rank.astype(np.int64) * (int(end.max()) + 1 if len(end) else 1)
    top = np.maximum.accumulate(end + shift)
    new[1:] = (start + shift)[1:] > top[:-1]
    new[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(new)
    return doc[at], start[at], np.maximum.reduceat(end, at) if len(at) else end


def _runs(doc, start, end, n: int):
    doc, start, end = merged(doc, start, end)
    yield _dealt(groups(doc, n), n, 0, doc, start, end)


def with_runs(runs: DataFrame, n: int) -> DataFrame:
    """doc_id of each document with runs, once: the runs of a document meet in its group."""

    def run(batches):
        held = [np.zeros(0, np.int64)]
        for b in batches:
            held += [_packed(x, np.int64, np.int64, np.int64)[0] for x in b.column("data").to_pylist()]
            if sum(map(len, held)) > 1 << 20:
                held = [np.unique(np.concatenate(held))]
        ids = np.unique(np.concatenate(held))
        yield pa.RecordBatch.from_arrays([pa.array(ids)], ["doc_id"])

    return runs.select("g", "data").repartition(n, "g").select("data").mapInArrow(run, "doc_id long")


def sort_shards(rows: DataFrame, depth: int, n: int, shards: int, memory: int = 1 << 23) -> DataFrame:
    """Runs (kind 0) that each shard's sorted strings remove; those found before pass through."""

    def shard(batches):
        with tempfile.TemporaryDirectory(dir=induced.spill_folder()) as own:
            held = Shard(own, memory)
            for b in batches:
                is_segment = pc.equal(b.column("kind"), 2)
                known = b.filter(pc.invert(is_segment))
                if known.num_rows:
                    yield known
                for x in b.column("data").filter(is_segment).to_pylist():
                    held.add(x)
            for doc, start in held.later(depth):
                yield from _runs(doc, start, start + depth, n)
        scratch.tidy()

    return rows.repartition(shards, "g").mapInArrow(shard, _ROW)


class Shard:
    """The segments of a shard; their text goes to a file once it is longer than the memory bound."""

    def __init__(self, folder: str, memory: int):
        self.folder, self.memory = folder, memory
        self.rows: list[tuple] = []
        self.parts: list[bytes] = []
        self.held, self.path = 0, None

    def add(self, blob: bytes) -> None:
        d, p, c = _packed(blob, np.int64, np.int64, np.int64)
        self.rows.append((d.copy(), p.copy(), c.copy()))
        self.parts.append(blob[8 + 24 * len(d) :])
        self.held += len(self.parts[-1])
        if self.held > self.memory:
            self.write()

    def write(self) -> None:
        self.path = os.path.join(self.folder, "segments")
        with open(self.path, "ab") as f:
            f.writelines(self.parts)
        self.parts.clear()
        self.held = 0

    def text(self) -> np.ndarray:
        self.parts.append(induced.END)
        if self.path is None:
            text = np.frombuffer(b"".join(self.parts), np.uint8)
            self.parts.clear()
            return text
        self.write()
        return np.memmap(self.path, np.uint8, "r")

    def later(self, depth: int, most: int = 1 << 20):
        """(doc, start) of the strings that a smaller document has too, in batches."""
        if not self.rows:
            return
        doc, pos, count = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        self.rows.clear()
        text = self.text()
        begin = np.cumsum(count + depth - 1) - (count + depth - 1)
        starts = induced.room(self.folder, len(text), bool, self.memory)
        step = induced.chunk(self.memory) >> 8
        for a in range(0, len(begin), step):
            own = slice(a, a + step)
            starts[np.repeat(begin[own] - np.cumsum(count[own]) + count[own], count[own]) + np.arange(int(count[own].sum()))] = True
        none = np.zeros(0, np.int64)
        ids, place, new = none, none, np.zeros(0, bool)  # of the strings at hand, the last run of which may go on
        out, size = [], 0
        for at, fresh in buffered(induced.order(text, starts, depth, self.memory, self.folder), depth, induced.chunk(self.memory) // 4):
            row = np.searchsorted(begin, at, "right") - 1
            ids, place, new = np.append(ids, doc[row]), np.append(place, pos[row] + at - begin[row]), np.append(new, fresh)
            new[0] = True
            last = int(np.flatnonzero(new)[-1])
            if last:
                out.append(_later(ids[:last], place[:last], new[:last]))
                size += len(out[-1][0])
            ids, place, new = ids[last:], place[last:], new[last:]
            if size > most:
                yield tuple(np.concatenate(x) for x in zip(*out, strict=True))
                out, size = [], 0
        out.append(_later(ids, place, new))
        both = tuple(np.concatenate(x) for x in zip(*out, strict=True))
        if len(both[0]):
            yield both


def _later(ids: np.ndarray, place: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings of whole runs whose document isn't the smallest of the run."""
    at = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(ids, at), np.diff(np.append(at, len(ids))))
    return ids[ids > least], place[ids > least]


def buffered(blocks, depth: int, least: int):
    """(positions, whether each begins a run) of blocks, joined until they are worth a step."""
    held, size = [], 0
    for at, lcp in blocks:
        held.append((at, lcp < depth))
        size += len(at)
        if size >= least:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def snapped(data: bytes, start: np.ndarray, end: np.ndarray) -> str:
    """The text without its runs, each narrowed to whole characters."""
    out, at = [], 0
    for s, e in zip(start.tolist(), end.tolist(), strict=True):
        while s < e and s < len(data) and data[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(data) and data[e] & 0xC0 == 0x80:
            e -= 1
        out.append(data[at:s])
        at = max(s, e)
    return (b"".join(out) + data[at:]).decode("utf-8", "replace")


def apply_runs(runs: DataFrame, docs: DataFrame, n: int, with_text: bool) -> DataFrame:
    """doc_id, n_removed, n_spans, kept_sha256 (and kept_text) of the documents with runs."""

    def run(batches):
        seen, table = None, {}
        for _, blobs, b in _by_group(batches):
            if blobs is not seen:
                seen, table = blobs, {}
                if blobs:
                    doc, start, end = (np.concatenate(x) for x in zip(*(_packed(x, np.int64, np.int64, np.int64) for x in blobs), strict=True))
                    doc, start, end = merged(doc, start, end)
                    at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                    for i, j in zip(at, np.append(at[1:], len(doc)), strict=True):
                        table[int(doc[i])] = (start[i:j], end[i:j])
            rows = []
            for d, data in zip(b.column("doc_id").to_pylist(), b.column("data").to_pylist(), strict=True):
                if d in table:
                    start, end = table[d]
                    kept, last = hashlib.sha256(), 0
                    for s, e in zip(start.tolist(), end.tolist(), strict=True):
                        kept.update(data[last:s])
                        last = e
                    kept.update(data[last:])
                    rows.append((d, int((end - start).sum()), len(start), kept.hexdigest(), snapped(data, start, end) if with_text else None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    rows = _with_texts(runs, docs, n)
    return rows.mapInArrow(run, "doc_id long, n_removed long, n_spans long, kept_sha256 string, kept_text string")


def dedup(docs: DataFrame, depth: int = 50, with_text: bool = False, often: int = 256) -> DataFrame:
    """See ``_dedup``; its Python stages run on small Arrow batches."""
    with scratch.small_batches(docs.sparkSession):
        return _dedup(docs, depth, with_text, often)


def _dedup(docs: DataFrame, depth: int, with_text: bool, often: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; ``with_text`` adds kept_text
    (runs narrowed to whole characters)."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = 4 * n
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keys = scratch.table(base.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "texts")
    own = keys.groupBy("doc_id").agg(F.min("sha").alias("own"), F.max("sha").alias("other")).where("own <> other and doc_id is not null").select("doc_id", "own")
    odd = scratch.table(own, "several-texts")
    if odd.isEmpty():
        keys = keys.withColumn("named", F.lit(True))
    else:
        keys = scratch.table(keys.join(odd, "doc_id", "left").withColumn("named", F.coalesce(F.col("own") == F.col("sha"), F.lit(True))).drop("own"), "named")
        base = base.join(odd, "doc_id", "left").where(F.coalesce(F.col("own") == F.sha2("text", 256), F.lit(True))).drop("own")
    first = scratch.table(keys.where("named").groupBy("sha").agg(F.min("doc_id").alias("first")), "first-texts")
    tagged = scratch.table(keys.join(first, "sha", "left"), "tagged")
    part = tagged.where((F.col("doc_id") == F.col("first")) & F.col("named") & (F.col("n_bytes") >= depth)).select("doc_id").distinct()
    held = base.join(scratch.checked(part), "doc_id", "left_semi")
    runs = sort_shards(segments(shared_hashes(held, depth, n, often), held, depth, n, shards), depth, n, shards)
    runs = scratch.table(runs, "runs")
    ids = scratch.table(with_runs(runs, n), "run-ids")
    changed = apply_runs(runs, base.join(scratch.checked(ids), "doc_id", "left_semi"), n, with_text)
    changed = scratch.table(changed.dropDuplicates(["doc_id"]).withColumn("named", F.lit(True)), "changed")
    scratch.drop(runs, ids)
    copy = F.col("named") & (F.col("doc_id") > F.col("first")) & (F.col("n_bytes") >= depth)
    got = tagged.join(changed, ["doc_id", "named"], "left").select(
        "doc_id", "n_bytes", "sha",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
    )
    return got if with_text else got.drop("kept_text", "sha")


def op5(spark, sf_dir: str) -> DataFrame:
    """Every document without the 50-byte strings that an earlier one holds."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_first(docs: DataFrame, depth: int = 50) -> DataFrame:
    """``docs`` with what ``dedup`` leaves of every text, and n_chars to match."""
    kept, sha = scratch.free(docs.columns, "kept_text", "sha")
    got = dedup(docs, depth, with_text=True).where("n_removed > 0").select("doc_id", F.col("sha").alias(sha), F.col("kept_text").alias(kept)).distinct()
    out = docs.withColumn(sha, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    out = out.join(scratch.table(got, "kept-texts"), ["doc_id", sha], "left").withColumn("text", F.coalesce(kept, "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(kept).isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
