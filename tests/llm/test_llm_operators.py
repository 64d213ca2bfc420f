"""Operators against brute force on small tables, with nulls, empty texts, ties, repeats and odd columns."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltlake.llm import components, jaccard, langid, neardup_vectors, neighbours, packing, pieces, quality, substrings, toolcalls, toxicity

pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(rng.choice(["ren", "tal", "moki", "sed", "vor", "lup", "gant", "pem", "zor", "bil"]) + rng.choice("abcdefgh") for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Texts with copies, near copies, shared passages, nulls, empty and long ones; extra columns with clashing names."""
    rng = random.Random(5)
    passage = words(rng, 20)
    texts = [words(rng, rng.randint(1, 120)) for _ in range(60)]
    texts += [texts[3], texts[3], texts[7] + " end", "", None, "a", "one two", "One  TWO", passage, words(rng, 9) + " " + passage + " " + words(rng, 9), passage + words(rng, 5), words(rng, 4000)]
    near = words(rng, 100).split()
    for k in range(12):
        t = list(near)
        t[k * 7] = "swap"
        texts.append(" ".join(t))
    rows = [(k, t, rng.choice(["en", "de", None]), f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    rows.append(rows[5])
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({"g": F.lit(1), "kind": F.lit("x"), "label": F.lit(0), "h1": F.lit(2), "component": F.lit("c"), "_salt": F.lit(None).cast("string")}), rows


def find(n, pairs):
    up = {k: k for k in n}
    for a, b in pairs:
        x, y = up[a], up[b]
        up = {k: min(x, y) if v in (x, y) else v for k, v in up.items()}
    return up


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(100 + k, 101 + k) for k in range(40)] + [(200, 201 + k) for k in range(50)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == find({x for p in pairs for x in p}, pairs)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n, keep, block", [(3, 90, 512), (5, 80, 512), (3, 90, 4)])
def test_jaccard(spark, docs, n, keep, block, monkeypatch):
    df, rows = docs
    if block != 512:
        monkeypatch.setattr(jaccard.links, "__defaults__", (block, 2))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df, n, keep).collect()}
    sets = {}
    for k, t, *_ in rows:
        w = (t or "").lower().split()
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= keep * len(sets[a] | sets[b])]
    up = find(sets, pairs)
    assert got == {k: (len(s), up[k]) for k, s in sets.items()}
    assert jaccard.join(df, n, keep).count() == len(rows)


def test_a_common_passage_makes_no_candidates(spark):
    rng = random.Random(8)
    passage = words(rng, 60)
    texts = [words(rng, 240) + " " + passage for _ in range(60)]
    texts += [texts[4] + " more", "even " + texts[9]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["centre"], r["doc_id"]) for r in jaccard.stars(df, 5, 80, np.zeros(jaccard.SLOTS, bool)).collect()}
    assert {(4, 4), (4, 60), (9, 9), (9, 61)} <= got and {d for _, d in got} == {4, 9, 60, 61}


@pytest.mark.parametrize("apart", [False, True])
def test_subgroups_only_where_blocks_leave_rows_apart(spark, apart, monkeypatch):
    rng = random.Random(3)
    base, rows = words(rng, 200).split(), []
    for k in range(40):
        rows.append([*base[: 5 * k], f"swap{k}", *base[5 * k + 1 :]])
    if apart:  # each 18 further words away, linked to one another in a chain only
        for j in range(1, 6):
            rows.append([f"other{k}" if k % 11 < j else w for k, w in enumerate(base)])
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], "doc_id long, text string")
    stored, table = [], jaccard.scratch.table
    monkeypatch.setattr(jaccard.scratch, "table", lambda df, name: stored.append(name) or table(df, name))
    monkeypatch.setattr(jaccard.links, "__defaults__", (8, 2))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(df, 1, 80).collect()}
    own = [set(w) for w in rows]
    pairs = [(a, b) for a in got for b in got if a < b and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b])]
    assert got == find(set(got), pairs)
    assert ("apart" in stored) == apart


def test_keep_one(spark, docs):
    df, rows = docs
    kept = jaccard.keep_one(df, 3, 90)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 3 in ids and 60 not in ids and 61 not in ids and ids.count(5) == 2


def removed(rows):
    seen, out = {}, {}
    for k, t, *_ in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            seen[b[i : i + 50]] = min(k, seen.get(b[i : i + 50], k))
    for k, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if seen[b[i : i + 50]] < k:
                gone[i : i + 50] = True
        edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
        out[k] = (len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize("often", [256, 1])
def test_substrings(spark, docs, often):
    df, rows = docs
    got = substrings.dedup(df, often=often)
    assert got.count() == len(rows)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()} == removed(rows)


def test_substrings_of_other_scripts(spark):
    rng = random.Random(2)
    base = "".join(rng.choice("äöü日本é ") for _ in range(400))
    rows = [(1, base, None, None, 0), (2, "x" + base[50:200] + "y", None, None, 0), (3, "é" * 300, None, None, 0), (4, "é" * 200, None, None, 0)]
    df = spark.createDataFrame(rows, DOCS)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.dedup(df).collect()} == removed(rows)
    kept = {r["doc_id"]: r["text"] for r in substrings.keep_first(df).collect()}
    assert kept[1] == base and "�" not in kept[2] and kept[2].startswith("x") and kept[2].endswith("y")


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    import public_tokenizers as P

    df, rows = docs
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    cap = 64
    table = packing.pieces(df, cap).cache()
    got = packing.pack(table, cap, share=7).collect()
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= cap
    total = sum(r["length"] for r in got)
    assert len(by) <= -(-total // cap) * 1.03 + 1
    for k, t, *_ in rows[:20] + rows[60:70]:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == k})
        assert own == [(i, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for i, (s, n) in enumerate(packing.cut(len(ids), cap))]


@pytest.fixture(scope="module")
def vecs(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    hub = rng.normal(size=16)
    x[100:160] = hub + 0.12 * rng.normal(size=(60, 16))
    x[200:210] = x[10]
    rows = [(k, [float(v) for v in r], k) for k, r in enumerate(x)]
    odd = [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, [None] + [1.0] * 15, 0), (304, [1.0, 2.0], 0), (305, [], 0), (306, [float("inf")] * 16, 0)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int"), x


def test_neardup_vectors(spark, vecs):
    df, x = vecs
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    got = {r["vec_id"]: r for r in neardup_vectors.dedup(df, shard_rows=120).collect()}
    assert len(got) == 307
    true = link.sum(1)
    assert sum(got[k]["n_links"] for k in range(300)) >= 0.97 * true.sum() and all(got[k]["n_links"] <= true[k] for k in range(300))
    up = find(range(300), [(int(a), int(b)) for a, b in zip(*np.nonzero(link), strict=True) if a < b])
    assert np.mean([got[k]["component_id"] == up[k] for k in range(300)]) > 0.99
    assert all(got[k]["kept"] == (got[k]["component_id"] == k) for k in got) and all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(300, 307))
    assert neardup_vectors.audit(df, spark.createDataFrame([(k, int(r["n_links"])) for k, r in got.items()], "vec_id long, n_links long"), queries=100) >= 0.97


def test_neardup_vectors_of_a_large_group(spark):
    """A third of the rows is one group at a cosine of about 0.95, far larger than a shard; every link counts."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=64)
    centre /= np.linalg.norm(centre)
    x = np.concatenate([centre + rng.normal(size=(1000, 64)) * 0.029, rng.normal(size=(2000, 64))])
    x[1000] = x[0]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in neardup_vectors.dedup(df, shard_rows=60, block_rows=200).collect()}
    assert [got[k]["n_links"] for k in range(3000)] == link.sum(1).tolist()
    assert all(got[k]["component_id"] == 0 for k in range(1001)) and all(got[k]["component_id"] == k for k in range(1001, 3000))


def test_neighbours(spark, vecs):
    df, x = vecs
    got = {}
    for r in neighbours.search(df, F.col("id") % 20 == 0, k=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 300, 20))
    hits = 0
    for q, rows in got.items():
        rows.sort()
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(300), -s))[:20]
        assert [r[0] for r in rows] == list(range(1, 21)) and q not in [r[1] for r in rows]
        assert all(abs(v - x[i] @ x[q]) < 1e-9 for _, i, v in rows)
        hits += len(set(best) & {i for _, i, _ in rows})
    assert hits >= 0.9 * 20 * len(got)
    few = df.where("vec_id < 5 or vec_id >= 300")
    assert neighbours.search(few, F.col("id") % 20 == 0, k=20).count() == 4


def test_language(spark):
    rng = random.Random(4)
    make = {"aa": lambda: words(rng, 30), "bb": lambda: " ".join(rng.choice(["xiq", "wuy", "qee", "yax"]) + rng.choice("ou") for _ in range(30))}
    rows = [(k, make[["aa", "bb"][k % 2]](), ["aa", "bb"][k % 2], "s", 0) for k in range(80)] + [(100, None, "aa", "s", 0), (101, "", "aa", "s", 0), (102, "12 !!", "bb", "s", 0), (103, "日本", None, "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, df.where("doc_id % 3 <> 1"), 20).collect()}
    assert all(got[k][0] == ["aa", "bb"][k % 2] for k in range(80))
    assert [got[k][0] for k in (100, 101, 102)] == ["und"] * 3 and got[103][0] in ("aa", "bb") and got[103][1] == 0
    assert langid.identify(df.where("false"), df).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df, df.where("false")).collect()} == {"und"}


def labelled(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(300):
        t, toxic, good = words(rng, 40), int(k % 5 == 0), int(k % 7 != 0)
        if toxic:
            t = t.replace(" ", rng.choice([" moron ", " scum "]), 1)
        if not good:
            t = " ".join(w.upper() + "!!" for w in t.split())
        rows.append((k, t, "en", f"src{k % 4}", len(t)))
        labels.append((k, good, toxic))
    rows += [(300, None, None, None, 0), (301, "", "en", "src1", 0)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    df, labels = labelled(spark)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, toxicity.train(df, labels)).collect()}
    held = [k for k in range(300) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all((got[k] >= 0.5) == (k % 5 == 0) for k in held) and got[300] < 0.5 and got[301] < 0.5
    kept = toxicity.keep_clean(df, toxicity.train(df, labels))
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {k for k in range(302) if k % 5 or k >= 300}
    assert toxicity.score(df, toxicity.train(df, labels.where("false"))).count() == 302


def test_quality(spark):
    df, labels = labelled(spark)
    host, path = F.col("source"), F.concat_ws("/", "source", "lang")
    got = {r["doc_id"]: r for r in quality.classify(df, labels, host, path).collect()}
    assert len(got) == 302 and all(got[k]["kept"] == (k % 7 != 0) for k in range(300))
    kept = quality.keep_good(df, labels, host, path)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if r["kept"]}
    assert quality.classify(df, labels.where("false"), host, path).where("kept").count() == 302
    assert quality.keep_good(df.where("false"), labels, host, path).count() == 0


def test_shrinkage(spark):
    ev = spark.createDataFrame([(k, "big", "big/a", 4.0 if k % 10 else -4.0) for k in range(500)] + [(1000, "tiny", "tiny/a", -4.0)], "doc_id long, host string, path string, logit double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = {r["host"]: r["path_posterior"] for r in quality.posteriors(ev, none).collect()}
    assert abs(got["big"] - 0.88) < 0.03 and abs(got["tiny"] - got["big"]) < 0.05


def test_pieces(spark, docs):
    df, rows = docs
    got = pieces.encode(df, with_ids=True)
    assert got.where("not lossless").count() == 0 and got.count() == len(rows)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(got).collect()}
    assert back == {k: t or "" for k, t, *_ in rows}


def test_tool_calls(spark):
    call = "id string, scope long, ord long, name string, arguments string, parents array<string>"
    ok = json.dumps({"turn": 1, "text": "x", "role": "user"})
    calls = spark.createDataFrame(
        [("a", 1, 0, "reply", ok, []), ("b", 1, 1, "reply", '{"text":"","role":"bot","turn":-1}', ["a"]), ("c", 2, 0, "reply", ok, ["d"]), ("d", 2, 1, "other", "{bad", ["e"]), ("e", 2, 2, "reply", "{}", []), ("f", 3, 0, "reply", ok, ["g"]), ("g", 3, 1, "reply", ok, ["f", "none"]), (None, 4, 0, "reply", ok, None)], call,
    )
    results = spark.createDataFrame([("a", 2, 'say "hi"\n'), ("a", 3, "late"), ("z", 1, "stray"), (None, 1, "none")], "id string, turn long, content string")
    got = {(r["call_id"], r["status"]): r for r in toolcalls.link(calls, results).collect()}
    assert {k for k in got if k[0]} == {("a", "linked"), ("b", "no result"), ("c", "no result"), ("d", "no result"), ("e", "no result"), ("f", "no result"), ("g", "no result"), ("z", "stray result")}
    by = {k[0]: r for k, r in got.items()}
    assert (by["a"]["topo_order"], by["b"]["topo_order"]) == (0, 1) and by["e"]["topo_order"] < by["d"]["topo_order"] < by["c"]["topo_order"] and by["f"]["topo_order"] is None
    assert by["a"]["argument_errors"] == "" and by["b"]["argument_errors"] == "role: not allowed; text: too short; turn: too small"
    assert by["d"]["argument_errors"] == "not an object; unknown tool" and "missing" in by["e"]["argument_errors"]
    assert by["a"]["n_results"] == 2 and by["a"]["canonical_json"] == '{"arguments":{"role":"user","text":"x","turn":1},"id":"a","name":"reply","result":"say \\"hi\\"\\n"}'
    plan = toolcalls.link(calls, results)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_tables(spark, docs):
    df = docs[0].where("false")
    assert jaccard.join(df).count() == 0 and substrings.dedup(df).count() == 0 and pieces.encode(df).count() == 0
    assert packing.pack(packing.pieces(df).cache()).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert neardup_vectors.dedup(none).count() == 0 and neighbours.search(none, F.col("id") % 20 == 0).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert toolcalls.link(*toolcalls.from_turns(turns)).count() == 0
