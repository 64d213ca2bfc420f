"""The registered queries themselves on a folder of small tables, against plain versions; and cases that tables can hold."""

import hashlib
import json
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voltlake.llm import jaccard, langid, neardup_vectors, neighbours, packing, quality, registry, substrings, textbatch, toxicity

pytest.importorskip("public_tokenizers")
FOLDER = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
here = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables, with odd rows: null, empty and very long texts, a repeated row, vectors of other kinds."""
    root = str(tmp_path_factory.mktemp("tables"))
    d = spark.read.parquet(f"{FOLDER}/documents.parquet")
    long = " ".join(f"word{k % 977} and" for k in range(60_000))
    odd = spark.createDataFrame([(10_001, None, None, None, 0), (10_002, "", "en", "a", 0), (10_003, "12 !!", "en", "a", 5), (10_004, long, None, "a", len(long)), (10_005, long + " x", None, "b", 1)], DOCS)
    d = d.select(*[F.col(f.name).cast(f.dataType) for f in odd.schema])
    d.union(odd).union(d.limit(3)).write.parquet(f"{root}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(f"{root}/labels.parquet")
    spark.read.parquet(f"{FOLDER}/conversations.parquet").write.parquet(f"{root}/conversations.parquet")
    e = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    first = e.orderBy("vec_id").first()["embedding"]
    more = [(90_000, first), (90_000, first), (90_020, None), (90_040, [0.0] * len(first)), (90_060, [1.0, 2.0, 3.0]), (90_061, [2.0, 4.0, 6.1]), (90_080, [float("nan")] + [1.0] * (len(first) - 1))]
    e.union(spark.createDataFrame(more, e.schema)).write.parquet(f"{root}/embeddings.parquet")
    return root


@pytest.fixture(scope="module")
def answers(spark, folder):
    got: dict = {}

    def ask(name):
        if name not in got:
            df = registry.queries()[name](spark, folder)
            got[name] = (df.columns, df.collect())
        return got[name]

    return ask


@pytest.fixture(scope="module")
def docs(spark, folder):
    return [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def crc(k):
    return zlib.crc32(str(k).encode())


@here
def test_op1(spark, folder, answers, docs):
    columns, rows = answers("op1_toxicity")
    assert columns[:4] == ["doc_id", "held_out", "score", "predicted"] and sorted(r["doc_id"] for r in rows) == sorted(k for k, *_ in docs)
    assert all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    own = [r for r in rows if r["held_out"] and toxic.get(r["doc_id"]) is not None]
    assert sum(r["predicted"] == toxic[r["doc_id"]] for r in own) >= 0.95 * len(own) > 0


@here
def test_op3(spark, folder, answers, docs):
    _, rows = answers("op3_quality")
    assert sorted(r["doc_id"] for r in rows) == sorted(k for k, *_ in docs) and all(0 <= r["quality_score"] <= 1 for r in rows)
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    own = [r for r in rows if good.get(r["doc_id"]) is not None and crc(r["doc_id"]) % 5 == 0]
    assert sum(r["kept"] == bool(good[r["doc_id"]]) for r in own) >= 0.9 * len(own) > 0


@here
def test_op4(spark, folder, answers):
    _, rows = answers("op4_embedding_neardup")
    vec = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r["embedding"] is not None}
    ok = [k for k, v in vec.items() if np.isfinite(v).all() and v.any()]
    near = {k: {j for j in ok if j != k and len(vec[j]) == len(vec[k]) and vec[k] @ vec[j] >= 0.9 * np.linalg.norm(vec[k]) * np.linalg.norm(vec[j])} for k in ok}
    got = {r["vec_id"]: r for r in rows}
    assert len(rows) == spark.read.parquet(f"{folder}/embeddings.parquet").count() and all(r["kept"] == (r["component_id"] == r["vec_id"]) for r in rows)
    assert all(got[k]["n_links"] <= len(near.get(k, ())) for k in got) and sum(r["n_links"] for r in got.values()) >= 0.99 * sum(map(len, near.values())) > 0
    assert got[90_060]["n_links"] == 1 and got[90_061]["component_id"] == 90_060 and 90_000 in near and got[90_000]["n_links"] == len(near[90_000])


@here
def test_recall_of_op4_and_op8(spark):
    e = spark.read.parquet(f"{LARGER}/embeddings.parquet")
    assert neardup_vectors.audit(e, neardup_vectors.op4(spark, LARGER), queries=300) >= 0.99
    rows = e.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got: dict = {}
    for r in neighbours.op8(spark, LARGER).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(got[int(ids[q])] & set(ids[np.lexsort((ids, -s))[:20]].tolist())) / 20)
    assert np.mean(hits) >= 0.9


@here
def test_op5(answers, docs):
    seen, want = {}, {}
    once = sorted({(k, t or "") for k, t, _ in docs})
    for k, t in once:
        b = t.encode()
        for i in range(len(b) - 49):
            seen.setdefault(hash(b[i : i + 50]), k)
    for k, t in once:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if seen[hash(b[i : i + 50])] < k:
                gone[i : i + 50] = True
        edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
        want[k] = (len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    columns, rows = answers("op5_suffix_dedup")
    assert columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and len(rows) == len(docs)
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == want


@here
def test_op6(answers, docs):
    _, rows = answers("op6_pieces")
    assert len(rows) == len(docs) and all(r["lossless"] for r in rows)
    assert all((r["n_ids"] == 0) == (not t) for r, (_, t, _) in zip(sorted(rows), sorted(docs, key=lambda d: d[0]), strict=True))


@here
def test_op7(answers, docs):
    columns, rows = answers("op7_language_id")
    assert columns == ["doc_id", "held_out", "lang_pred", "score"] and len(rows) == len(docs)
    assert all(r["held_out"] == (crc(r["doc_id"]) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    lang, got = {k: v for k, _, v in docs}, {r["doc_id"]: r for r in rows}
    assert {got[k]["lang_pred"] for k in (10_001, 10_002, 10_003)} == {"und"} and {r["lang_pred"] for r in rows} <= {v for v in lang.values() if v} | {"und"}
    own = [r for r in rows if r["held_out"] and lang[r["doc_id"]]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in own) >= 0.9 * len(own) > 0


@here
def test_op8(spark, folder, answers):
    _, rows = answers("op8_neighbours")
    vec = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r["embedding"] is not None}
    ok = [k for k, v in vec.items() if np.isfinite(v).all() and v.any()]
    by: dict = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append(r)
    assert sorted(by) == sorted(k for k in ok if k % 20 == 0 and any(j != k and len(vec[j]) == len(vec[k]) for j in ok))
    hits = []
    for q, found in by.items():
        best = sorted((-float(vec[j] @ vec[q]), j) for j in ok if j != q and len(vec[j]) == len(vec[q]))[:20]
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, len(best) + 1)) and len({r["vec_id"] for r in found}) == len(found) and q not in {r["vec_id"] for r in found}
        assert [(-r["score"], r["vec_id"]) for r in found] == sorted((-r["score"], r["vec_id"]) for r in found)
        assert all(math.isclose(r["score"], vec[r["vec_id"]] @ vec[q], rel_tol=1e-12, abs_tol=1e-12) for r in found)
        hits.append(len({r["vec_id"] for r in found} & {j for _, j in best}) / len(best))
    assert np.mean(hits) >= 0.9


@here
def test_op9(answers, docs):
    sets = {}
    for k, t, _ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    up = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = up[a], up[b]
                up = {k: min(x, y) if v in (x, y) else v for k, v in up.items()}
    columns, rows = answers("op9_jaccard_join")
    assert columns == ["doc_id", "n_shingles", "component_id"] and len(rows) == len(docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == {k: (len(s), up[k]) for k, s in sets.items()}


@here
def test_op10(answers, docs):
    from tokenizers import Tokenizer

    import public_tokenizers as P

    _, rows = answers("op10_best_fit_packing")
    lib, by = Tokenizer.from_file(P.path("byte_bpe_50k.json")), {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r["length"] for r in rows) // 2048) * 1.02 + 1
    want = []
    for k, t, _ in docs:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(k, i, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for i, (s, n) in enumerate(packing.cut(len(ids), 2048))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)


@here
def test_op2(spark, folder, answers):
    import duckdb

    _, rows = answers("op2_tool_calls")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet/*.parquet')")
    columns = ["call_id", "status", "topo_order", "argument_errors", "n_results", "canonical_json"]
    want = c.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()['op2_tool_calls']})").fetchall()
    assert sorted(map(repr, (tuple(r[k] for k in columns) for r in rows))) == sorted(map(repr, want))
    assert all(json.loads(r["canonical_json"]) for r in rows)


def test_scores_equal_plain_rules():
    """Clauses by sets of words, patterns by order, and the noisy-or of their weights."""
    words = toxicity.closed_words() | {"moron": "insult", "scum": "insult"}
    weights = {("insult",): 2.0, ("insult", "target"): 4.0, ("insult", "negation"): -1.0, ("threat", "target"): 1.5}
    m = toxicity.Model(words, ("imbec",), weights)
    rng = random.Random(3)
    pool = ["moron", "scum", "imbecile", "kill", "you", "not", "said", "tree", "house"]
    for _ in range(300):
        clauses = [[rng.choice(pool) for _ in range(rng.randint(0, 5))] for _ in range(rng.randint(0, 4))]
        clean = 1 - 1 / (1 + math.exp(4.0))
        for c in clauses:
            kind = ["insult" if w in ("moron", "scum", "imbecile") else words.get(w) for w in c]
            hard = [k for k, x in enumerate(kind) if x in ("insult", "threat")]
            if hard:
                marks = tuple(x for x in ("insult", "threat", "target") if x in kind) + tuple(x for x in ("negation", "reported") if x in kind and kind.index(x) < hard[-1])
                if marks in weights:
                    w = weights[marks]
                elif marks[0] == "threat" and "target" not in marks:
                    w = -4.0
                else:
                    w = sum({"insult": 3.0, "threat": 0.5, "target": 0.5, "negation": -1.0, "reported": -1.5}[x] for x in marks)
                clean *= 1 - 1 / (1 + math.exp(-w))
        assert math.isclose(m.score(". ".join(" ".join(c) for c in clauses)), 1 - clean, abs_tol=1e-12)


def test_posteriors_equal_plain_sums(spark):
    rng = random.Random(5)
    rows = [(k, f"h{k % 7}", f"h{k % 7}/p{k % 3}", rng.uniform(-3, 3) + (k % 7) / 2) for k in range(400)]
    labels = [(k, int(rng.random() < 0.6)) for k in range(0, 400, 3)]
    got = {(r["host"], r["path"]): r for r in quality.posteriors(spark.createDataFrame(rows, "doc_id long, host string, path string, logit double"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    own = dict(labels)
    paths: dict = {}
    for k, h, p, z in rows:
        v, w = (own[k], 1.0) if k in own else (1 / (1 + math.exp(-z)), 0.1)
        g = paths.setdefault((h, p), [0.0, 0.0])
        g[0] += v * w
        g[1] += w
    hosts: dict = {}
    for (h, _), (g, n) in paths.items():
        x = hosts.setdefault(h, [0.0, 0.0])
        x[0] += g
        x[1] += n
    g0 = sum(g for g, _ in hosts.values()) / sum(n for _, n in hosts.values())

    def strength(groups):
        n = sum(x for _, x, _ in groups)
        spread = sum(x * (g / x - m) ** 2 for g, x, m in groups) / n - g0 * (1 - g0) * len(groups) / n
        return min(10_000, max(20, g0 * (1 - g0) / max(spread, 1e-9) - 1))

    kh = strength([(g, n, g0) for g, n in hosts.values()])
    hp = {h: (g + kh * g0) / (n + kh) for h, (g, n) in hosts.items()}
    kp = strength([(g, n, hp[h]) for (h, _), (g, n) in paths.items()])
    for (h, p), (g, n) in paths.items():
        assert math.isclose(got[h, p]["host_posterior"], hp[h], rel_tol=1e-9) and math.isclose(got[h, p]["path_posterior"], (g + kp * hp[h]) / (n + kp), rel_tol=1e-9)


@pytest.mark.parametrize("langs", [3, 70])
def test_filters_equal_plain_sets(langs):
    """Counts by sets of n-grams; also with more languages than a machine word has bits."""
    rng = random.Random(langs)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{k:02}": ["".join(rng.choice(letters) for _ in range(3)) for _ in range(12)] for k in range(langs)}
    texts = {k: [" ".join(rng.choice(w) for _ in range(60)) for _ in range(6)] for k, w in own.items()}
    f = langid.learn(texts)

    def grams(t, n):
        b = bytes(c if c > 127 or 97 <= c <= 122 else 32 for c in t.lower().encode())
        return [b[i : i + n] for i in range(len(b) - n + 1) if not (b[i] == 32 and (i + 1 == len(b) or b[i + 1] == 32))]

    known = {}
    for k, ts in texts.items():
        for n in (3, 4, 5):
            count: dict = {}
            for g in (g for t in ts for g in grams(t, n)):
                count[g] = count.get(g, 0) + 1
            known[k, n] = {g for g, c in count.items() if c >= 2}
    asked = [" ".join(rng.choice(own[k]) for _ in range(20)) for k in own]
    data, off = textbatch.buffers(pa.array(asked, pa.string()))
    best, _ = langid.classify(f, data, off)
    want = []
    for t in asked:
        total = {k: sum(n * sum(g in known[k, n] for g in grams(t, n)) for n in (3, 4, 5)) for k in own}
        want.append(max(total, key=total.get))
    assert [f.langs[k] for k in best] == want == list(own)


def test_clashing_names(spark):
    rows = [(k, "the same passage of words that is surely longer than fifty bytes " + "x" * (k % 3), "en", f"s{k % 2}", 0) for k in range(30)]
    d = spark.createDataFrame(rows, DOCS)
    odd = d.select("*", *[F.lit("mine").alias(c) for c in ("_salt", "kept_text", "sha", "Host", "path", "logit", "site_logit", "_h", "salt", "rank", "cell", "size", "named", "label", "grp", "offset")])
    kept = substrings.keep_first(odd)
    assert kept.columns == odd.columns and {r["kept_text"] for r in kept.collect()} == {"mine"}
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, quality int")
    good = quality.keep_good(odd, labels, F.col("source"), F.concat_ws("/", "source", "lang"))
    assert good.columns == odd.columns and {(r["Host"], r["_h"], r["logit"]) for r in good.collect()} <= {("mine", "mine", "mine")}
    cuts = packing.pieces(d).select("*", *[F.lit("mine").alias(c) for c in ("_salt", "salt", "rank", "cell", "offset", "size")]).cache()
    got = packing.pack(cuts)
    assert got.count() == 30 and {(r["salt"], r["rank"], r["cell"]) for r in got.collect()} == {("mine",) * 3} and got.columns.count("offset") == 1
    assert jaccard.keep_one(odd, 5, 80).columns == odd.columns and toxicity.keep_clean(odd, toxicity.fit([])).columns == odd.columns


def test_several_texts_under_one_id(spark):
    a, b = "first text with a passage that is longer than fifty bytes, surely it is", "another one: a passage that is longer than fifty bytes, surely it is"
    d = spark.createDataFrame([(1, a, None, None, 0), (1, b, None, None, 0), (2, b + "!", None, None, 0)], DOCS)
    rows = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in substrings.dedup(d).collect())
    own = min((a, b), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    common = len(b) if own == b else len(" a passage that is longer than fifty bytes, surely it is")
    assert rows[:2] == [(1, len(b), 0), (1, len(a), 0)] and rows[2] == (2, len(b) + 1, common)


def test_repeated_vectors_count_once(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(3, [float(v) for v in x[3]])] * 3 + [(100, [float(v) for v in x[3]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in neardup_vectors.dedup(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got[3]["n_links"] == ((u @ u[3]) >= 0.9).sum() and got[100]["component_id"] == min(np.flatnonzero(u @ u[3] >= 0.9))
    near = [r for r in neighbours.search(df, F.col("id") % 20 == 0, k=10).collect() if r["query_id"] == 100]
    assert [r["rank"] for r in sorted(near)] == list(range(1, 11)) and len({r["vec_id"] for r in near}) == 10
