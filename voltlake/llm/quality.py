"""Quality classification by hierarchical empirical Bayes.

Evidence of three kinds adds up on the log-odds scale: a document classifier over form
features, the posterior of the document's host, and that of its path below the host. Hosts and
paths are beta posteriors from grouped counts of labelled rows and classifier means of the rest (an
unlabelled row counts ``weak`` of a labelled one); a path shrinks towards its host and a host
towards the global rate, each with a strength that the method of moments takes from the groups.

The groups are pre-aggregated before their shuffle, so a host with a third of all rows is a few
partial sums. Group posteriors are joined, not collected.

Edge cases: null text counts as empty; a null host or path is a group of its own; a
group without evidence has the posterior of its parent; without labels every document is kept
(probability 1 - prior odds of nothing); repeated rows count as often as they occur.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlake.llm import scratch, textbatch

NAMES = ("log_len", "upper", "symbol", "digit", "pipe", "distinct", "repeat", "space", "word_len", "letters")


def _class(pred) -> np.ndarray:
    return np.array([pred(chr(b)) if b < 128 else False for b in range(256)], np.int64)


_UPPER = _class(str.isupper)
_DIGIT = _class(str.isdigit)
_SPACE = _class(str.isspace)
_PIPE = _class(lambda c: c == "|")
_SYMBOL = _class(lambda c: c in "!#$%&*@^~=<>{}[]\\_+")
_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)], np.int64)


def form(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The form features of each text of a chunk, a row each."""
    n = np.diff(off)
    out = np.zeros((len(n), len(NAMES)))
    full = np.flatnonzero(n > 0)
    if not len(full):
        return out
    at, size = off[full], n[full]
    for k, table in ((1, _UPPER), (2, _SYMBOL), (3, _DIGIT), (4, _PIPE), (7, _SPACE), (9, _LETTER)):
        out[full, k] = np.add.reduceat(table[data], at) / size
    out[:, 0] = np.log1p(n) / 10
    starts, ends, doc = textbatch.spans(~_SPACE[data].astype(bool), off)
    if len(starts):
        h = textbatch.ranges_hash(data, starts, ends)
        words = np.bincount(doc, minlength=len(n))
        some = words > 0
        order = np.lexsort((h, doc))
        hs, ds = h[order], doc[order]
        new = np.ones(len(hs), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
        distinct = np.bincount(ds[new], minlength=len(n))
        same = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=len(n))
        out[some, 5] = distinct[some] / words[some] ** 0.9
        out[some, 6] = same[some] / words[some]
        out[some, 8] = (n[some] / words[some]).clip(0, 30) / 10
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    pull = np.full(len(w), ridge)
    pull[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + pull * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def expand(x: np.ndarray) -> np.ndarray:
    """Features with their squares and presence, for a linear model."""
    return np.hstack([x, np.sqrt(np.maximum(x[:, [1, 2, 3, 4, 6]], 0)), (x[:, [2, 4, 6]] > 0.02)])


def featured(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the array of form features of every document."""

    def run(batches):
        for b in batches:
            parts = [form(data, off) for *_, data, off in textbatch.chunks(b.column(len(keys)))]
            x = np.vstack(parts) if parts else np.zeros((0, len(NAMES)))
            column = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1] or 1), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keys))), column], [*keys, "x"])

    base = docs.select(*keys, F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    return base.mapInArrow(run, f"{kinds}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, bound: int = 8000) -> np.ndarray | None:
    """The document classifier, from at most ``bound`` labelled rows chosen by hash."""
    ids = labels.select("doc_id", "quality").where("quality is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(bound)
    own = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    rows = featured(own, ["doc_id", "quality"]).orderBy("doc_id").limit(2 * bound).collect()
    y = np.array([r["quality"] for r in rows], float)
    if len(rows) < 20 or y.min() == y.max():
        return None
    return logistic(expand(np.array([r["x"] for r in rows])), y)


def evidence(docs: DataFrame, weights: np.ndarray | None, keys: list[str]) -> DataFrame:
    """``keys`` and the classifier's log-odds of quality of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        for b in batches:
            parts = [form(data, off) for *_, data, off in textbatch.chunks(b.column(len(keys)))]
            x = np.vstack(parts) if parts else np.zeros((0, len(NAMES)))
            z = expand(x) @ w[:-1] + w[-1] if w is not None and len(x) else np.full(len(x), 3.0)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keys))), pa.array(np.clip(z, -20.0, 20.0))], [*keys, "logit"])

    base = docs.select(*keys, F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    return base.mapInArrow(run, f"{kinds}, logit double")


def _logit(p):
    return F.log(p / (1 - p))


def posteriors(ev: DataFrame, labels: DataFrame, weak: float = 0.1) -> DataFrame:
    """(host, path, site_logit): what a document's place adds to its own evidence.

    ``ev`` has doc_id, host, path, logit. Counts are grouped by path, then by host; the
    strengths of shrinkage come from the spread of the group means.
    """
    y = labels.where("quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    p = 1 / (1 + F.exp(-F.col("logit")))
    rows = ev.join(y, "doc_id", "left").select("host", "path", F.coalesce("y", p).alias("v"), F.when(F.col("y").isNull(), F.lit(weak)).otherwise(1.0).alias("w"))
    paths = scratch.table(rows.groupBy("host", "path").agg(F.sum(F.col("v") * F.col("w")).alias("good"), F.sum("w").alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("good").alias("h_good"), F.sum("n").alias("h_n"))
    total = hosts.agg(F.sum("h_good").alias("g"), F.sum("h_n").alias("n")).first()
    g0 = min(0.999, max(0.001, (total["g"] or 0.0) / total["n"])) if total["n"] else 0.5

    def strength(groups, good, n, mean):
        """Prior counts by the method of moments, between 20 and 10,000."""
        r = groups.agg(F.sum(F.col(n) * (F.col(good) / F.col(n) - mean) ** 2).alias("s"), F.sum(n).alias("n"), F.count("*").alias("k")).first()
        if not r["n"] or r["k"] < 2:
            return 10_000.0
        spread = r["s"] / r["n"] - g0 * (1 - g0) * r["k"] / r["n"]
        return float(min(10_000, max(20, g0 * (1 - g0) / max(spread, 1e-9) - 1)))

    kh = strength(hosts, "h_good", "h_n", F.lit(g0))
    hosts = hosts.withColumn("h_p", (F.col("h_good") + kh * g0) / (F.col("h_n") + kh)).withColumnRenamed("host", "_host")
    both = paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    kp = strength(both, "good", "n", F.col("h_p"))
    both = both.withColumn("p_p", (F.col("good") + kp * F.col("h_p")) / (F.col("n") + kp))
    return both.select("host", "path", F.col("h_p").alias("host_posterior"), F.col("p_p").alias("path_posterior"), (_logit(F.col("p_p")) - F.lit(float(np.log(g0 / (1 - g0))))).alias("site_logit"))


def classify(docs: DataFrame, labels: DataFrame, host, path, site_weight: float = 0.5) -> DataFrame:
    """doc_id, host, path, the parts of the evidence and the probability of quality."""
    # Learned from rows that are not held out (crc32 of the id leaves 0 by 5).
    own = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    w = fit(docs, own)
    ev = evidence(docs.select("doc_id", host.alias("host"), path.alias("path"), "text"), w, ["doc_id", "host", "path"])
    ev = scratch.table(ev, "quality-evidence")
    site = posteriors(ev, own)
    site = site.withColumnsRenamed({"host": "_host", "path": "_path"})
    got = ev.join(F.broadcast(site) if site_bound(ev) else site, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")), "left").drop("_host", "_path")
    z = F.col("logit") + site_weight * F.coalesce("site_logit", F.lit(0.0))
    return got.select("doc_id", "host", "path", "logit", "host_posterior", "path_posterior", (1 / (1 + F.exp(-z))).alias("quality_score")).withColumn("kept", F.col("quality_score") >= 0.5)


def keep_good(docs: DataFrame, labels: DataFrame, host, path, site_weight: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    own = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    w = fit(docs, own)
    ev = evidence(docs.select("doc_id", host.alias("host"), path.alias("path"), "text"), w, ["doc_id", "host", "path"])
    ev = scratch.table(ev, "quality-evidence")
    names, at = docs.columns, docs.columns.index("text")
    logit, h, p, site_h, site_p, site_logit = scratch.free(names, "logit", "host", "path", "site_host", "site_path", "site_logit")
    site = posteriors(ev, own).select(F.col("host").alias(site_h), F.col("path").alias(site_p), F.col("site_logit").alias(site_logit))
    site = scratch.table(site, "sites")
    scratch.drop(ev)
    shared = docs.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        w = shared.value
        for b in batches:
            parts = [form(data, off) for *_, data, off in textbatch.chunks(b.column(at))]
            x = np.vstack(parts) if parts else np.zeros((0, len(NAMES)))
            z = expand(x) @ w[:-1] + w[-1] if w is not None and len(x) else np.full(len(x), 3.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.clip(z, -20.0, 20.0))], [*names, logit])
        scratch.tidy()

    kinds = T.StructType([*docs.schema.fields, T.StructField(logit, T.DoubleType())])
    scored = docs.mapInArrow(run, kinds).withColumns({h: host, p: path})
    site = F.broadcast(site) if site.limit(20_001).count() <= 20_000 else site
    got = scored.join(site, F.col(h).eqNullSafe(F.col(site_h)) & F.col(p).eqNullSafe(F.col(site_p)), "left")
    return got.where(F.col(logit) + site_weight * F.coalesce(site_logit, F.lit(0.0)) >= 0).select(*names)


def site_bound(ev: DataFrame, most: int = 20_000) -> bool:
    """Whether the groups are few enough to broadcast, by an exact count of at most most + 1."""
    return ev.select("host", "path").distinct().limit(most + 1).count() <= most


def op3(spark, sf_dir: str) -> DataFrame:
    """The quality of every document; its source is the host, its language the path below."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"))
