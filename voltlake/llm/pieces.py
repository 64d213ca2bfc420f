"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Text is a sequence of characters with spaces as U+2581 and one before the first; adjacent symbols
that make a piece enter an agenda (best score, then leftmost). A candidate taken from the agenda is skipped if
a keyed hash of (seed, variant, document, word's place in the text, place in the word, piece) falls under ``dropout``; so
segmentations differ between documents and between a word's occurrences, and are the same in every run. What no piece covers is
written in byte pieces, U+2581 of the text itself too, so decoding gives the text back.

No piece joins a character with a following space (asserted on loading), so words are segmented one by one: the agendas of all words of a
batch that are about equally long are worked off together, a candidate of each word at a time. Every occurrence is merged anew; a word of
more than ``LONG`` characters has a heap of its own.

Edge cases: null text encodes like the empty one, as no ids; dropout 0 is the model's own encoding;
repeated rows (equal id and text) are encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
LONG = 48
_SPACE = ord(SPACE)
_M = (1 << 32) - 1
_NONE = np.int32((1 << 31) - 1)  # no piece
_LENGTHS = (4, 6, 8, 10, 12, 14, 16, 20, 24, 32, LONG)


def ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` from each start, one after another."""
    end = np.cumsum(size)
    return flat[np.repeat(start - end + size, size) + np.arange(int(end[-1]) if len(end) else 0)]


def _at(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The keys of words at places of a text."""
    h = key ^ place.astype(np.uint32) * np.uint32(0x9E3779B1)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x7FEB352D)
    h = (h ^ h >> np.uint32(15)) * np.uint32(0x846CA68B)
    return h ^ h >> np.uint32(16)


class Pieces:
    def __init__(self, path: str, dropout: float = 0.1, seed: int = 1):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.dropout, self.seed, n = int(dropout * (1 << 32)), seed, model.get_piece_size()
        score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        raw, byte = [], [0] * 256
        for k in range(n):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                value = int(piece[3:5], 16)
                byte[value] = k
                raw.append(bytes([value]))
            elif model.is_control(k) or model.is_unknown(k):
                raw.append(b"")
            else:
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError("a piece joins a character with a following space")
                self.ids[piece], score[piece] = k, model.get_score(k)
                raw.append(piece.replace(SPACE, " ").encode())
        order = {v: r for r, v in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {piece: order[v] for piece, v in score.items()}  # 0 merges first
        self.byte, self.n = np.array(byte, np.int32), n
        self.raw_size = np.array([len(x) for x in raw])
        self.raw_start, self.raw = np.cumsum(self.raw_size) - self.raw_size, np.frombuffer(b"".join(raw), np.uint8)
        # A symbol is a piece's id, or n and the code point of a character that is no piece.
        self.symbol = np.arange(0x110000, dtype=np.int32) + n
        for piece, k in self.ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = k
        number = lambda s: int(self.symbol[ord(s)]) if len(s) == 1 else self.ids.get(s, -1)
        made = {(number(p[:i]) << 32 | number(p[i:])): k for p, k in self.ids.items() for i in range(1, len(p)) if number(p[:i]) >= 0 and number(p[i:]) >= 0}
        self.pairs = np.array(sorted(made), np.int64)
        self.made = np.array([made[k] for k in self.pairs.tolist()], np.int32)
        rank = np.full(n, _NONE, np.int32)
        for piece, k in self.ids.items():
            rank[k] = self.rank[piece]
        self.made_rank = rank[self.made]

    def base(self, doc: int | None, variant: int) -> int:
        return zlib.crc32(str(doc).encode(), self.seed * 0x9E3779B1 + variant * 0x85EBCA77 & _M)

    def joined(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, id) of the pieces that symbols make with the next ones; _NONE where there is no such piece."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.made_rank[at], _NONE), self.made[at]

    def merge(self, sym: np.ndarray, key: np.ndarray) -> None:
        """Works off the agendas of the words in the rows of ``sym`` in place: symbols that are merged into the one before become -1, as
        is what lies behind a word's end; the last column is -1."""
        n, width = sym.shape
        nxt = np.tile(np.arange(1, width + 1, dtype=np.int16), (n, 1))
        prv = np.tile(np.arange(-1, width - 1, dtype=np.int16), (n, 1))
        rank, made = self.joined(sym[:, :-1], sym[:, 1:])
        rank[(sym[:, :-1] < 0) | (sym[:, 1:] < 0)] = _NONE
        rows = np.arange(n)
        while True:
            now = rank[rows]
            i = now.argmin(axis=1)
            least = now[np.arange(len(rows)), i]
            on = least != _NONE
            if not on.any():
                return
            rows, i, least = rows[on], i[on], least[on]
            r, c = rows, i
            if self.dropout:
                h = key[rows] ^ (i.astype(np.uint32) * np.uint32(0x9E3779B1) ^ least.astype(np.uint32) * np.uint32(0x85EBCA77))
                skip = ((h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D) ^ h << np.uint32(7)) < self.dropout
                rank[rows[skip], i[skip]] = _NONE
                r, c = rows[~skip], i[~skip]
            j = nxt[r, c]
            k = nxt[r, j]
            sym[r, c] = own = made[r, c]
            sym[r, j] = -1
            inner = j < width - 1
            rank[r[inner], j[inner]] = _NONE
            nxt[r, c], prv[r, np.minimum(k, width - 1)] = k, c
            after = sym[r, np.minimum(k, width - 1)]
            rank[r, c], made[r, c] = self.joined(own, after)
            rank[r[after < 0], c[after < 0]] = _NONE
            p = prv[r, c]
            some = p >= 0
            r, p = r[some], p[some]
            rank[r, p], made[r, p] = self.joined(sym[r, p], own[some])

    def long(self, symbols: list[str], key: int) -> list[str]:
        """The symbols of one word after its agenda, a heap, is done."""
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple] = []

        def offer(i: int, j: int) -> None:
            both = symbols[i] + symbols[j]
            if both in self.rank:
                heapq.heappush(heap, (self.rank[both], i, j, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            least, i, j, both = heapq.heappop(heap)
            if not symbols[i] or right[i] != j or symbols[i] + symbols[j] != both:
                continue
            if self.dropout:
                h = (key ^ i * 0x9E3779B1 ^ least * 0x85EBCA77) & _M
                if ((h ^ h >> 15) * 0x2C1B3C6D ^ h << 7) & _M < self.dropout:
                    continue
            symbols[i], symbols[j] = both, ""
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                offer(i, k)
            if left[i] >= 0:
                offer(left[i], i)
        return [s for s in symbols if s]

    def words(self, texts: list[str], docs: list, variants: list[int]) -> tuple[np.ndarray, ...]:
        """(code points, start of each word, end, text, key) of all words of some texts; U+2581 of a text itself is a word, with the code 0x110000."""
        code = np.frombuffer("".join([SPACE + t if t else "" for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(t) + 1 if t else 0 for t in texts])
        mark = code == _SPACE
        mark[(np.cumsum(size) - size)[size > 0]] = False
        code = np.where(code == 32, np.uint32(_SPACE), code)
        begin = np.cumsum(size) - size
        space = (code == _SPACE) & ~mark
        new = np.zeros(len(code), bool)
        new[begin[size > 0]] = True
        new[1:] |= (space[1:] & ~space[:-1]) | mark[1:] | mark[:-1]
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(code))
        text = np.searchsorted(begin, start, "right") - 1
        place = np.arange(len(start)) - np.searchsorted(start, begin)[text]
        base = np.array([self.base(d, v) for d, v in zip(docs, variants, strict=True)], np.uint32)
        code[mark] = 0x110000
        return code, start, end, text, _at(base[text], place)

    def encode(self, texts: list[str], docs: list, variants: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if not any(texts):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        code, start, end, text, key = self.words(texts, docs, variants)
        size = end - start
        marked = code > 0x10FFFF
        sym = self.symbol[np.where(marked, 0, code)]
        sym[marked] = self.n + _SPACE  # its own bytes, not a piece
        out = np.full(len(sym), -1, np.int32)
        low = 0
        for width in _LENGTHS:
            own = np.flatnonzero((size > low) & (size <= width))
            low = width
            for k in range(0, len(own), 1 << 15):
                at = own[k : k + (1 << 15)]
                where = start[at][:, None] + np.arange(width)
                inside = np.arange(width) < size[at][:, None]
                grid = np.full((len(at), width + 1), -1, np.int32)
                grid[:, :-1][inside] = sym[where[inside]]
                self.merge(grid, key[at])
                out[where[inside]] = grid[:, :-1][inside]
        for k in np.flatnonzero(size > LONG).tolist():
            s = start[k]
            for x in self.long([chr(c) for c in code[s : end[k]].tolist()], int(key[k])):
                out[s], s = self.ids[x] if x in self.ids else self.n + ord(x), s + len(x)
        alive = np.flatnonzero(out >= 0)
        own = out[alive]
        owner = text[np.searchsorted(start, alive, "right") - 1]
        odd = own >= self.n
        if odd.any():
            # Characters that are no piece, as bytes.
            runs = [self.byte[list(chr(c).encode("utf-8", "surrogatepass"))] for c in (own[odd] - self.n).tolist()]
            count = np.ones(len(own), np.int64)
            count[odd] = [len(x) for x in runs]
            owner, own = np.repeat(owner, count), np.repeat(own, count)
            own[own >= self.n] = np.concatenate(runs)
        return own, np.bincount(owner, minlength=len(texts))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a text, from its ids."""
        return ragged(self.raw, self.raw_start[ids], self.raw_size[ids]).tobytes()[1:]


def variant_of(doc_id: int | None, seed: int, variants: int) -> int:
    return zlib.crc32(f"{seed}:{doc_id}".encode()) % variants


_LOADED: dict[tuple, Pieces] = {}


def loaded(path: str | None, dropout: float, seed: int) -> Pieces:
    import public_tokenizers as P

    key = (path or P.path("piece_bpe_32k.model"), dropout, seed)
    if key not in _LOADED:
        _LOADED[key] = Pieces(*key)
    return _LOADED[key]


def stretches(texts: list[str], limit: int = 1 << 20):
    """(first, end) of runs of texts of about ``limit`` characters together."""
    a, total = 0, 0
    for k, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield a, k
            a, total = k, 0
        total += len(t)
    if a < len(texts):
        yield a, len(texts)


def encode(docs: DataFrame, dropout: float = 0.1, seed: int = 1, variants: int = 2, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, variant, n_ids, ids_crc32, lossless (decoding gave the text back); ``with_ids`` adds
    the ids. ``variants``: how many keys documents are dealt to, beside their own."""

    def run(batches):
        p = loaded(path, dropout, seed)
        for b in batches:
            every, ids = [t or "" for t in b.column(1).to_pylist()], b.column(0).to_pylist()
            for i, j in stretches(every):
                texts, doc = every[i:j], ids[i:j]
                variant = [variant_of(d, seed, variants) for d in doc]
                flat, count = p.encode(texts, doc, variant)
                cut = np.append(0, np.cumsum(count)).tolist()
                own = [flat[x:y] for x, y in zip(cut, cut[1:], strict=False)]
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in own]
                same = [p.decode(x) == t.encode("utf-8", "surrogatepass") for x, t in zip(own, texts, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat)) if with_ids else pa.nulls(len(texts), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(variant, pa.int32()), pa.array(count, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_()), lists], ["doc_id", "variant", "n_ids", "ids_crc32", "lossless", "ids"])

    got = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, variant int, n_ids long, ids_crc32 long, lossless boolean, ids array<int>")
    return got if with_ids else got.drop("ids")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids."""

    def run(batches):
        p = loaded(path, 0.0, 0)
        for b in batches:
            texts = [p.decode(np.array(x or [], np.int64)).decode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def op6(spark, sf_dir: str) -> DataFrame:
    """Every document encoded with a tenth of the merges dropped, and decoded again."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
