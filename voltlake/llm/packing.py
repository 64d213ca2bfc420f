"""Best-fit packing: token pieces into as few fixed-length sequences as possible.

The plan is a configuration linear program over the histogram of piece lengths. A
configuration is a multiset of lengths that fits a sequence. Multiplicative weights price
the lengths; a knapsack dynamic program over the prices gives, for every length, the
dearest configuration that holds it; lengths that get too few configurations become dearer.
The averaged configurations are rounded down to whole multiplicities, and a best-fit pass over
the histogram of what is left (run lengths, not items) closes the plan.

Only the histogram reaches the driver: at most ``capacity`` counts, and one more for each ``share`` pieces. Pieces are assigned where
they lie: a full piece is a sequence of its own; any other piece's rank among those of its length
picks its slot in the plan. Ranks are counted within salts of about ``share`` pieces, so that no length is too frequent for a task.

Edge cases: a null or empty text is one piece that holds the end id alone; ties and
repeated rows are pieces of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from voltlake.llm import scratch

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class ByteBpe:
    """Ids of a byte-level BPE file, through a bounded cache of space-led chunks.

    Text is cut before each space; the file's pattern never joins a chunk with the next as
    long as no two spaces meet, so equal chunks have equal ids. Other texts, and texts that hold the
    end-of-text marker, go to the tokenizer whole.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str, entries: int = 600_000):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(json_path)
        self.cache: dict[str, bytes] = {}
        self.entries = entries

    def chunk(self, text: str) -> bytes:
        got = self.cache.get(text)
        if got is None:
            got = np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
            if len(text) <= 64:
                if len(self.cache) >= self.entries:
                    self.cache.clear()
                self.cache[text] = got
        return got

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        if "<|endoftext|>" in text:
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if "  " in text or text.endswith(" "):
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        parts = text.split(" ")
        get, chunk = self.cache.get, self.chunk
        out = [chunk(parts[0])] if parts[0] else []
        out += [get(k) or chunk(k) for k in [" " + p for p in parts[1:]]]
        return b"".join(out)


_ENCODERS: dict[tuple, ByteBpe] = {}


def encoder(json_path: str | None = None, ranks_path: str | None = None) -> ByteBpe:
    """The encoder of this process; paths default to the box's public vocabulary."""
    import public_tokenizers as P

    key = (json_path or P.path("byte_bpe_50k.json"), ranks_path or P.path("byte_bpe_50k.tiktoken"))
    if key not in _ENCODERS:
        _ENCODERS[key] = ByteBpe(*key, P.PATTERN)
    return _ENCODERS[key]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a
    first one that may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32."""

    def run(batches):
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            enc = encoder(json_path, ranks_path)
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(text.as_py() or "") + end
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc_id, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def priced(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: best value for each capacity, and the last length taken (0: none)."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for w in range(1, capacity + 1):
        gain = value[1 : w + 1] + best[w - 1 :: -1][:w]
        k = int(gain.argmax())
        if gain[k] > best[w - 1]:
            best[w], last[w] = gain[k], k + 1
        else:
            best[w], last[w] = best[w - 1], -1
    return best, last


def fill(last: np.ndarray, room: int) -> list[int]:
    """The lengths of the dearest configuration for ``room``."""
    out = []
    while room > 0 and last[room]:
        if last[room] < 0:
            room -= 1
        else:
            out.append(int(last[room]))
            room -= int(last[room])
    return out


def configurations(counts: np.ndarray, capacity: int, rounds: int = 24, rate: float = 0.5) -> dict[tuple[int, ...], float]:
    """Fractional multiplicities of configurations, averaged over the rounds."""
    lengths = np.flatnonzero(counts)
    weight = np.ones(capacity + 1)
    total: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        value = np.full(capacity + 1, -1.0)
        value[lengths] = weight[lengths] * lengths / capacity
        _, last = priced(value, capacity)
        covered = np.zeros(capacity + 1)
        for n in lengths[::-1]:
            need = counts[n] - covered[n]
            if need <= 0:
                continue
            config = tuple(sorted([int(n), *fill(last, capacity - int(n))], reverse=True))
            share = need / config.count(int(n))
            total[config] = total.get(config, 0.0) + share / rounds
            for m in set(config):
                covered[m] += share * config.count(m)
        over = covered[lengths] / counts[lengths]
        weight[lengths] *= np.exp(-rate * np.clip(over - 1, -1, 3))
        weight[lengths] = np.clip(weight[lengths] / weight[lengths].max(), 1e-3, 1.0)
    return total


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: equal bins are one entry with a count."""
    rooms: list[int] = []
    open_: dict[int, list[list]] = {}
    done: list[tuple[tuple[int, ...], int]] = []

    def put(room: int, config: tuple[int, ...], copies: int) -> None:
        if not room:
            done.append((config, copies))
            return
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append([config, copies])

    for n in np.flatnonzero(left)[::-1]:
        n, need = int(n), int(left[n])
        while need:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                each = capacity // n
                config, copies, room = (), max(1, need // each), capacity
            else:
                room = rooms[at]
                config, copies = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
                each = room // n
            each = min(each, need)
            use = min(copies, need // each)
            if config and use < copies:
                put(room, config, copies - use)
            put(room - each * n, config + (n,) * each, use)
            need -= each * use
    for room in rooms:
        done += [(c, k) for c, k in open_[room]]
    return done


def plan(counts: np.ndarray, capacity: int, rounds: int = 24) -> list[tuple[tuple[int, ...], int]]:
    """Configurations with whole multiplicities that hold every piece exactly once."""
    found = configurations(counts.astype(float), capacity, rounds) if counts.any() else {}
    order = sorted(found.items(), key=lambda x: (sum(x[0]) != capacity, -sum(x[0]), -x[1], x[0]))
    plans = [rounded(order, counts, capacity, full) for full in (1.0, 0.998, 0.99, 0.98)]
    return min(plans, key=lambda p: sum(copies for _, copies in p))


def rounded(order: list, counts: np.ndarray, capacity: int, full: float) -> list[tuple[tuple[int, ...], int]]:
    """Whole multiplicities of the configurations that fill at least ``full`` of a sequence, and a best fit of the rest."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    for config, share in order:
        if sum(config) < full * capacity:
            continue
        own = {n: config.count(n) for n in set(config)}
        copies = min(int(share), *(int(left[n]) // k for n, k in own.items()))
        if copies > 0:
            out.append((config, copies))
            for n, k in own.items():
                left[n] -= k * copies
    return out + best_fit(left, capacity)


def slots(config_plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, copies, first sequence, offset), by length and rank."""
    rows, used, base = [], {}, 0
    for config, copies in config_plan:
        offset = 0
        for n in config:
            rows.append((n, used.get(n, 0), copies, base, offset))
            used[n] = used.get(n, 0) + copies
            offset += n
        base += copies
    out = np.array(rows, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def pack(cuts: DataFrame, capacity: int = 2048, share: int = 250_000, rounds: int = 24) -> DataFrame:
    """Assign pieces (any columns; ``doc_id``, ``piece`` and ``length`` <= capacity) to sequences:
    adds sequence_id (negative for full pieces) and offset, in place of columns so named. ``cuts`` should be stored, as it is read three times."""
    spark = cuts.sparkSession
    keep = [c for c in cuts.columns if c.lower() not in ("sequence_id", "offset")]
    cuts = cuts.select(*keep)
    salt, rank, salts, cell, size = scratch.free(keep, "salt", "rank", "salts", "cell", "size")
    full, part = cuts.where(F.col("length") == capacity), cuts.where(F.col("length") < capacity)
    counts = np.zeros(capacity + 1, np.int64)
    for r in part.groupBy("length").agg(F.count("*").alias(size)).collect():
        counts[r["length"]] = r[size]
    per = -(-counts // share)
    base = np.cumsum(per) - per
    cells = spark.createDataFrame([(int(n), int(per[n]), int(base[n])) for n in np.flatnonzero(counts)], f"length long, {salts} int, {cell} long")
    salted = part.withColumn("length", F.col("length").cast("long")).join(F.broadcast(cells), "length")
    salted = salted.withColumn(cell, F.col(cell) + F.pmod(F.xxhash64("doc_id", "piece"), F.col(salts)))
    own = np.zeros(int(per.sum()), np.int64)
    for r in salted.groupBy(cell).agg(F.count("*").alias(size)).collect():
        own[r[cell]] = r[size]
    before = np.cumsum(own) - own
    first = before - np.repeat(np.cumsum(counts) - counts, per)
    shared = spark.sparkContext.broadcast((first, slots(plan(counts, capacity, rounds))))
    ranked = salted.withColumn(rank, F.row_number().over(Window.partitionBy(cell).orderBy("doc_id", "piece")))
    names = [*keep, "sequence_id", "offset"]

    def run(batches):
        start, rows = shared.value
        key = rows[:, 0] * (1 << 42) + rows[:, 1] if len(rows) else np.zeros(0, np.int64)
        for b in batches:
            n, c, k = (b.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("length", cell, rank))
            k = k - 1 + start[c]
            at = np.searchsorted(key, n * (1 << 42) + k, "right") - 1
            got = rows[at] if len(at) else np.zeros((0, 5), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(x).cast(kinds[x]) for x in keep] + [pa.array(got[:, 3] + k - got[:, 1]), pa.array(got[:, 4])], names)

    kinds = {f.name: to_arrow_type(f.dataType) for f in cuts.schema}
    schema = T.StructType([*cuts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    placed = ranked.select(*keep, cell, rank).mapInArrow(run, schema)
    alone = full.select(*keep, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(alone)


def op10(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequence and offset (2048 tokens a sequence)."""
    return pack(scratch.table(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")), "pieces"))
