"""Language identification with bit-sliced Bloom filters of n-grams.

One table of bitmasks per n (a machine word, or several where there are more than 64 languages): bit l of a slot belongs to language l,
so the masks at an n-gram's slots, ANDed, tell all languages that hold it. Per-language popcounts
over a text, less the false positives that each language's fill predicts, decide.

The filters are learned from a bounded, hashed sample of ``per_language`` texts of each
language (a documented parameter); every text is classified whole.

Edge cases: null text or text without a letter gives ``und`` and score 0; a text of which no
n-gram is known gives the most frequent learned language and score 0; ties go to
the more frequent language, then the smaller name; an empty table gives an empty
result, and with nothing to learn from every prediction is ``und``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltlake.llm import textbatch

LETTER = re.compile(r"[^\W\d_]")
SIZES = (3, 4, 5)


@dataclass
class Filters:
    langs: list[str]
    tables: dict[int, np.ndarray]
    rates: dict[int, np.ndarray]  # false positives of each language, by n


def _bytes_table() -> np.ndarray:
    """Bytes below 128 that are not letters become one space; others stay."""
    t = np.arange(256, dtype=np.uint64)
    low = np.arange(128)
    t[:128][~(((low >= 97) & (low <= 122)))] = 32
    return t


_CLEAN = _bytes_table()


def grams(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash at each position, whether an n-gram of its own text starts there)."""
    b = _CLEAN[data]
    value = np.zeros(len(b), np.uint64)
    for k in range(n):
        value[: len(b) - k] |= b[k:] << np.uint64(8 * k)
    there = np.ones(len(b), bool)
    for k in range(1, n):
        at = off[1:] - k
        there[at[at >= off[:-1]]] = False
    there &= ~((b == 32) & (np.append(b[1:], 32) == 32))
    return textbatch.mix(value * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)), there


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    m = np.uint64((1 << bits) - 1)
    return (h & m).astype(np.int64), ((h >> np.uint64(32)) & m).astype(np.int64)


def learn(texts: dict[str, list[str]], bits: int = 20, least: int = 2) -> Filters:
    """Filters of the n-grams that occur ``least`` times in a language's texts."""
    langs = list(texts)
    kind = np.uint8 if len(langs) <= 8 else np.uint64
    wide = np.dtype(kind).itemsize * 8
    tables, rates = {}, {}
    for n in SIZES:
        table = np.zeros((-(-len(langs) // wide), 1 << bits), kind)
        fill = np.zeros(len(langs))
        for k, lang in enumerate(langs):
            data, off = textbatch.buffers(pc.utf8_lower(pa.array(texts[lang], pa.large_string())))
            h, there = grams(data, off, n)
            known, count = np.unique(h[there], return_counts=True)
            for at in _slots(known[count >= least], bits):
                table[k // wide, at] |= kind(1 << k % wide)
            fill[k] = ((table[k // wide] >> kind(k % wide)) & kind(1)).mean()
        tables[n], rates[n] = table, fill**2
    return Filters(langs, tables, rates)


def classify(f: Filters, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language index, score) of each text of a chunk."""
    total = np.zeros((len(off) - 1, len(f.langs)))
    full = np.flatnonzero(off[1:] > off[:-1])
    if len(full):
        for n in SIZES:
            table = f.tables[n]
            wide = table.dtype.itemsize * 8
            h, there = grams(data, off, n)
            a, b = _slots(h, table.shape[1].bit_length() - 1)
            mask = table[:, a] & table[:, b]
            mask[:, ~there] = 0
            number = np.add.reduceat(there.astype(np.int64), off[full])
            for k in range(len(f.langs)):
                hits = np.add.reduceat(((mask[k // wide] >> mask.dtype.type(k % wide)) & mask.dtype.type(1)).astype(np.int64), off[full])
                rate = f.rates[n][k]
                total[full, k] += n * np.maximum(0, (hits - number * rate) / (1 - rate))
    best = total.argmax(axis=1)
    top = total[np.arange(len(best)), best]
    return best, np.divide(top, total.sum(axis=1), out=np.zeros(len(best)), where=top > 0)


def sample(docs: DataFrame, per_language: int) -> dict[str, list[str]]:
    """At most ``per_language`` texts of each language, the most frequent language first. The ids are
    chosen by hash on narrow columns; only the chosen texts are gathered."""
    known = docs.where("lang is not null and text is not null")
    langs = [r["lang"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = known.select("doc_id", "lang").withColumn("place", place).where(F.col("place") <= per_language).select("doc_id", "lang").distinct()
    out: dict[str, list[str]] = {lang: [] for lang in langs}
    rows = known.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").select("doc_id", "lang", "text").collect()
    for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"])):
        if len(out[r["lang"]]) < per_language:
            out[r["lang"]].append(r["text"])
    return {lang: own for lang, own in out.items() if own}


def identify(docs: DataFrame, train: DataFrame, per_language: int = 300) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs``; ``train`` has doc_id, text, lang."""
    texts = sample(train, per_language)
    shared = docs.sparkSession.sparkContext.broadcast(learn(texts) if texts else None)

    def run(batches):
        f = shared.value
        for batch in batches:
            column = batch.column(1)
            lower = pc.utf8_lower(column)
            lang, score = [], []
            for a, b, data, off in textbatch.chunks(lower):
                letters = [t is not None and bool(LETTER.search(t)) for t in column[a:b].to_pylist()]
                if f is None:
                    best, value = np.zeros(b - a, int), np.zeros(b - a)
                else:
                    best, value = classify(f, data, off)
                for ok, k, v in zip(letters, best, value, strict=True):
                    lang.append(f.langs[k] if ok and f else "und")
                    score.append(float(v) if ok and f else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op7(spark, sf_dir: str) -> DataFrame:
    """The predicted language of every document; rows whose id's crc32 leaves 1 by 3 are held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    got = identify(docs, docs.where(~out))
    return got.select("doc_id", out.alias("held_out"), "lang_pred", "score")
