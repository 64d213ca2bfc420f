"""Kernels against plain versions; no Spark."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voltlake.llm import graphs, induced, jaccard, langid, neardup_vectors, neighbours, packing, pieces, substrings, textbatch, toxicity

P = pytest.importorskip("public_tokenizers")


@settings(max_examples=80, deadline=None)
@given(st.binary(min_size=1, max_size=300), st.integers(0, 1000), st.sampled_from([3, 8, 50]), st.sampled_from([1, 9, 60, 100_000]), st.sampled_from([1, 2, 4, 256]))
def test_induced_order(data, seed, depth, memory, letters):
    rng = random.Random(seed)
    data = bytes(b % letters for b in data)
    text = induced.padded([data])
    starts = np.zeros(len(text), bool)
    starts[[i for i in range(len(data)) if rng.random() < 0.5]] = True
    blocks = list(induced.order(text, starts, depth, memory))
    got, common = (np.concatenate([b[k] for b in blocks]).tolist() if blocks else [] for k in (0, 1))
    raw = text.tobytes()
    keys = [raw[i : i + depth] for i in got]
    assert sorted(got) == np.flatnonzero(starts).tolist() and keys == sorted(keys)
    assert common[1:] == [next((k for k in range(depth) if x[k] != y[k]), depth) for x, y in zip(keys, keys[1:], strict=False)]


def test_a_shard_far_larger_than_its_memory(tmp_path):
    """Strings equal to brute force, with the memory bound at a hundredth of the shard; arrays of the shard's length stay out of memory."""
    import tracemalloc

    rng = np.random.default_rng(4)
    base, memory = rng.integers(97, 101, 400_000).astype(np.uint8), 4_000
    seen: dict[bytes, int] = {}
    rows = [(k, base[a : a + 200].tobytes()) for k, a in enumerate(rng.integers(0, len(base) // 2, len(base) // 200))]
    for k, part in rows:
        for i in range(151):
            seen.setdefault(part[i : i + 50], k)

    def shard(name):
        (tmp_path / name).mkdir()
        out = substrings.Shard(str(tmp_path / name), memory)
        for k, part in rows:
            out.add((1).to_bytes(8, "little") + b"".join(np.array([x], np.int64).tobytes() for x in (k, 7, 151)) + part)
        return out

    got = [(int(d), int(p)) for doc, place in shard("a").later(50, 1000) for d, p in zip(doc, place, strict=True)]
    assert sorted(got) == sorted((k, 7 + i) for k, part in rows for i in range(151) if seen[part[i : i + 50]] < k) and got
    again = shard("b")
    tracemalloc.start()
    n = sum(len(doc) for doc, _ in again.later(50, 1000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(got) and peak < 4 * len(base)  # the positions of all suffixes alone would take twice as much


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab ", max_size=150), max_size=8))
def test_minimizers_cover_all_strings(texts):
    raw = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    _, at, end, h, where = substrings.minimizers(data, off, 50)
    by: dict[bytes, set] = {}
    for a, b, x in zip(at, end, h, strict=True):
        for p in range(a, b):
            by.setdefault(data[p : p + 50].tobytes(), set()).add(int(x))
    assert sum(b - a for a, b in zip(at, end, strict=True)) == sum(max(0, len(r) - 49) for r in raw)
    assert all(len(v) == 1 for v in by.values())
    row, a, b, x = substrings.split(data, at, end, h, where, 50)
    parts: dict[bytes, set] = {}
    for i, j, y in zip(a, b, x, strict=True):
        for p in range(i, j):
            parts.setdefault(data[p : p + 50].tobytes(), set()).add(int(y))
    assert (b - a).sum() == (end - at).sum() and all(len(v) == 1 for v in parts.values()) and all(at[r] <= i < j <= end[r] for r, i, j in zip(row, a, b, strict=True))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aB \n\té", max_size=40), max_size=6), st.sampled_from([3, 5]))
def test_sets(texts, n):
    data, off = textbatch.buffers(pa.array(texts, pa.string()))
    got = jaccard.sets(data, off, n)
    want = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", t.encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
        want.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    assert [len(s) for s in got] == [len(s) for s in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.integers(0, 10_000), st.sampled_from([80, 90]))
def test_similar_sets_share_a_part(n, lost, added, seed, keep):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
    y = np.unique(np.concatenate([x[min(lost, len(x) - 1) :], rng.integers(0, 1 << 63, added).astype(np.uint64)]))
    if jaccard.similar(x, y, keep):
        for share in (0.0, 0.05, 0.5, 0.95, 1.0):
            hot = rng.random(jaccard.SLOTS) < share
            assert set(jaccard.parts(x, keep, hot).tolist()) & set(jaccard.parts(y, keep, hot).tolist())


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.integers(0, 10_000), st.sampled_from([80, 90]))
def test_similar_sets_share_as_many_parts_as_each_needs(n, lost, added, seed, keep):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
    y = np.unique(np.concatenate([x[min(lost, len(x) - 1) :], rng.integers(0, 1 << 63, added).astype(np.uint64)]))
    if jaccard.similar(x, y, keep):
        for share in (0.0, 0.05, 0.5, 0.95, 1.0):
            hot = rng.random(jaccard.SLOTS) < share
            levels = []
            for s in (x, y):
                value, code = jaccard.sent(s, keep, hot)
                levels.append([(value[code == c], int(c) & jaccard.NEED) for c in np.unique(code)])
            assert any(len(np.intersect1d(a, b)) >= max(m, k) for a, m in levels[0] for b, k in levels[1])


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 60), st.integers(0, 10_000))
def test_signature_tree_joins_what_links_join(n, seed):
    rng = np.random.default_rng(seed)
    base = [np.unique(rng.integers(0, 1 << 62, rng.integers(1, 60)).astype(np.uint64)) for _ in range(5)]
    rows = []
    for _ in range(n):
        b = base[rng.integers(5)]
        rows.append(np.unique(np.concatenate([b[rng.random(len(b)) > 0.04], rng.integers(0, 1 << 62, rng.integers(0, 2)).astype(np.uint64)])))
    rows = [r if len(r) else np.array([1], np.uint64) for r in rows]

    def labels(pairs):
        up = list(range(n))
        for a, b in pairs:
            x, y = up[a], up[b]
            up = [min(x, y) if u in (x, y) else u for u in up]
        return up

    got = labels(jaccard.search(rows, np.arange(n), np.arange(n), 90))
    want = labels([(i, j) for i in range(n) for j in range(i) if jaccard.similar(rows[i], rows[j], 90)])
    assert got == want


@pytest.mark.parametrize("seed", range(6))
def test_linked_rows_of_two_blocks_share_a_subgroup(seed):
    rng = np.random.default_rng(seed)
    keep, base, rows = (80, 90)[seed % 2], rng.integers(0, 1 << 62, 20 + 25 * seed, dtype=np.uint64), []
    for _ in range(120):
        x = rows[rng.integers(len(rows))].copy() if rows and rng.random() < 0.4 else base.copy()
        hit = rng.random(len(x)) < 0.25 * rng.random()
        x[hit] = rng.integers(0, 1 << 62, hit.sum(), dtype=np.uint64)
        rows.append(x)
    rows = [np.unique(r) for r in rows]
    linked = {(i, j) for i in range(120) for j in range(i) if jaccard.similar(rows[i], rows[j], keep)}
    found, keys = [], {}
    for block in (0, 1):
        at = np.array([*range(6), *range(6 + block, 120, 2)])
        own = [rows[k] for k in at]
        found += jaccard.search(own, at, at, keep, None, 6)
        for x, k in zip(*jaccard.deviations(own, np.arange(6), -5, keep), strict=True):
            keys.setdefault(int(x), set()).add(int(at[k]))
    up = list(range(120))
    for a, b in found:
        x, y = up[a], up[b]
        up = [min(x, y) if u in (x, y) else u for u in up]
    assert linked and all(up[i] == up[j] or any(i in m and j in m for m in keys.values()) for i, j in linked)


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_piece(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(129, np.int64)
    np.add.at(counts, rng.integers(1, 129, 400 * seed), 1)
    plan = packing.plan(counts, 128, 8)
    held = np.zeros(129, np.int64)
    for config, copies in plan:
        assert copies > 0 and sum(config) <= 128
        for n in config:
            held[n] += copies
    assert (held == counts).all()
    bins, least = sum(c for _, c in plan), -(-int((counts * np.arange(129)).sum()) // 128)
    assert bins <= least * 1.03 + 1


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(3, 4) == [(0, 3)]


TEXTS = ["", " ", "a  b", "Hello, world! It's\n\n fine \t ok", "naïve café über 12 345", " lead", "trail ", "x  y", "日本語 text 😀", "<|endoftext|> in text", "don't we'll\r\n\r\n done.\n Next"]


def test_byte_bpe_equals_the_library():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    enc = packing.encoder()
    for t in TEXTS * 2:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def encoded(model, texts, docs=None, variant=0):
    """The ids of each text as a list."""
    flat, count = model.encode(texts, docs or [None] * len(texts), [variant] * len(texts))
    cut = np.append(0, np.cumsum(count))
    return [flat[i:j].tolist() for i, j in zip(cut, cut[1:], strict=False)]


def test_pieces_without_dropout_equal_the_library():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    own = pieces.Pieces(P.path("piece_bpe_32k.model"), 0.0)
    texts = [*TEXTS, "a" * 200, "word" * 40]
    assert encoded(own, texts) == [lib.encode(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=80), max_size=5))
def test_pieces_round_trip(texts):
    assert [MODEL.decode(np.array(x, np.int64)).decode() for x in encoded(MODEL, texts, None, 1)] == texts


MODEL = pieces.Pieces(P.path("piece_bpe_32k.model"), 0.3)


def plain(model, text, doc, variant):
    """Merge-dropout by scanning the symbols of each word again and again."""
    out = []
    for n, w in enumerate(re.findall("▁*[^▁]+|▁+", "▁" + text.replace(" ", "▁")) if text else []):
        h = (model.base(doc, variant) ^ n * 0x9E3779B1) & 0xFFFFFFFF
        h = (h ^ h >> 16) * 0x7FEB352D & 0xFFFFFFFF
        h = (h ^ h >> 15) * 0x846CA68B & 0xFFFFFFFF
        key, symbols, skipped = h ^ h >> 16, [(k, c) for k, c in enumerate(w)], set()
        while True:
            found = [(model.rank[x + y], i) for i, ((p, x), (_, y)) in enumerate(zip(symbols, symbols[1:], strict=False)) if x + y in model.rank and (p, x, y) not in skipped]
            if not found:
                break
            least, i = min(found)
            (p, x), (_, y) = symbols[i], symbols[i + 1]
            h = (key ^ p * 0x9E3779B1 ^ least * 0x85EBCA77) & 0xFFFFFFFF
            if ((h ^ h >> 15) * 0x2C1B3C6D ^ h << 7) & 0xFFFFFFFF < model.dropout:
                skipped.add((p, x, y))
            else:
                symbols[i : i + 2] = [(p, x + y)]
        for _, x in symbols:
            out += [model.ids[x]] if x in model.ids else model.byte[list(x.encode())].tolist()
    return out


def test_batched_agendas_equal_plain_ones():
    rng = random.Random(8)
    texts = [*TEXTS, "b" * 90 + " interesting", *(" ".join(rng.choice(["interesting", "schedules", "a", "élan", "neighbourhood's", "x", ""]) for _ in range(40)) for _ in range(20))]
    assert encoded(MODEL, texts, list(range(len(texts))), 1) == [plain(MODEL, t, k, 1) for k, t in enumerate(texts)]


def test_dropout_varies_by_variant_document_and_place():
    t = " ".join(["interesting"] * 200)
    ids = encoded(MODEL, [t], [1])[0]
    assert ids == encoded(MODEL, ["other", t], [7, 1])[1] and MODEL.decode(np.array(ids)).decode() == t
    assert ids != encoded(MODEL, [t], [1], 1)[0] and ids != encoded(MODEL, ["interesting"], [1])[0] * 200
    assert len({tuple(x) for x in encoded(MODEL, [t] * 50, list(range(50)))}) == 50
    assert len({tuple(x) for x in encoded(MODEL, ["interesting"] * 200, list(range(200)))}) > 3


@pytest.mark.parametrize(("keep", "size", "least"), [(80, 170, 32), (80, 400, 64), (90, 400, 32), (90, 800, 64)])
def test_large_sets_at_the_threshold_share_a_part(keep, size, least):
    rng = np.random.default_rng(size)
    apart = size * (100 - keep) // (100 + keep)
    assert 2 * size * (100 - keep) // (100 + keep) + 1 >= least
    for _ in range(50):
        x = rng.integers(0, 1 << 63, size + apart, dtype=np.uint64)
        a, b = np.sort(x[:size]), np.sort(x[apart:])
        assert np.intersect1d(jaccard.parts(a, keep), jaccard.parts(b, keep)).size


def test_bloom_filters_tell_languages_apart():
    own = {"aa": ["lamo remo tamo lamo remo"] * 5, "bb": ["zuk drek wuk zuk drek"] * 5}
    f = langid.learn(own, bits=12)
    data, off = textbatch.buffers(pa.array(["remo lamo", "drek zuk", ""], pa.string()))
    best, score = langid.classify(f, data, off)
    assert [f.langs[k] for k in best[:2]] == ["aa", "bb"] and (score[:2] > 0.6).all() and score[2] == 0


def test_composition_equals_its_parts():
    machine = toxicity.grammar()
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.choice(toxicity.CLASSES) for _ in range(rng.randint(0, 6))]
        marks = set(machine.run(s)[0])
        hard = [k for k, x in enumerate(s) if x in ("insult", "threat")]
        want = {x for x in ("insult", "threat", "target") if x in s}
        want |= {x for x in ("negation", "reported") if x in s and hard and s.index(x) < hard[-1]}
        assert marks == want, s


def test_clauses_are_scored_not_words():
    rows = [("what a moron you are", 1), ("you moron", 1), ("moron here, moron there", 1), ("a moron again", 1), ("moron they said", 1)] + [(f"clean text number {k} about trees", 0) for k in range(40)]
    m = toxicity.fit(rows)
    assert m.score("he is a moron.") > 0.5 > m.score("trees") and m.score(None) == m.score("") < 0.1
    assert m.score("kill the lights") < 0.5


def test_robust_prune_keeps_the_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8))
    g = neardup_vectors.flat_graph(x)
    d = graphs.squared(x, x)
    np.fill_diagonal(d, np.inf)
    assert (g == d.argmin(1)[:, None]).any(1).all()


def test_small_world_recall():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16))
    w = neighbours.SmallWorld(x)
    q = rng.normal(size=(50, 16))
    got = w.search(q, 60)[:, :10]
    true = graphs.nearest(graphs.squared(q, x), 10)
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(got, true, strict=True)]) >= 0.9
