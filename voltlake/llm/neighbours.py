"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph for
each shard, stored as flat neighbour arrays, and the shards' results merged.

Inner products become distances by one more component (the length that each vector lacks to the longest
one), so the graph is built and searched by distance. Nodes are inserted in blocks: a block searches the
graph so far and compares its own rows, then the usual heuristic picks neighbours. Equal
vectors are one node that keeps all its ids. Every query visits every shard; shards
grow in number with the table, and each sends its best ``k`` only.

Edge cases: null, zero and non-finite vectors, and null ids, take no part; vectors of different lengths are no candidates of each other, and
each length is a pass of its own; repeated rows of an id are one row, and of several vectors under one id the
least (by its components in order) is taken; fewer candidates than k are all returned; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltlake.llm import graphs, scratch, streams, textbatch, vectors


class SmallWorld:
    """Flat neighbour arrays, one for each layer; layer 0 holds all rows."""

    def __init__(self, x: np.ndarray, degree: int = 16, beam: int = 64, block: int = 256):
        self.x, self.degree, self.beam = x.astype(np.float32), degree, beam
        n = len(x)
        u = (textbatch.mix(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(11)).astype(float) / 2.0**53
        self.level = np.minimum((-np.log(np.maximum(u, 1e-12)) / math.log(degree)).astype(int), 6)
        self.entry = int(self.level.argmax())
        top = int(self.level.max()) if n else 0
        self.layers = [self._layer(np.flatnonzero(self.level >= l), 2 * degree if l == 0 else degree, block) for l in range(top + 1)]

    def _layer(self, own: np.ndarray, width: int, block: int):
        """(rows, position of each row or -1, neighbours by position) of a layer."""
        own = own[np.argsort(-self.level[own], kind="stable")]
        x, n = self.x[own], len(own)
        nbrs = np.full((n, width), -1, np.int64)
        size = 0
        while size < n:
            at = np.arange(size, min(n, size + max(32, min(block, size))))
            # Within the block, then in the graph so far.
            cand = at[0] + graphs.nearest(graphs.squared(x[at], x[at]), min(width + 1, len(at)))
            if size:
                starts = np.unique(np.linspace(0, size - 1, min(size, 4)).astype(int))
                pool, _ = graphs.search(x[:size], nbrs[:size], x[at], np.tile(starts, (len(at), 1)), max(self.beam, width))
                cand = np.concatenate([pool, cand], 1)
            nbrs[at] = graphs.robust_prune(x, at, cand, width, 1.0)
            # Reverse edges: neighbours choose anew among the old ones and the new.
            local = nbrs[at]
            to, by = local.ravel(), np.repeat(at, width)
            by, to = by[to >= 0], to[to >= 0]
            order = np.argsort(to, kind="stable")
            to, by = to[order], by[order]
            rank = np.arange(len(to)) - np.searchsorted(to, to)
            some = np.unique(to)
            extra = np.full((len(some), int(rank.max()) + 1 if len(rank) else 1), -1, np.int64)
            extra[np.searchsorted(some, to), rank] = by
            extra = extra[:, : 2 * width]
            room = (nbrs[some] < 0).sum(1) >= (extra >= 0).sum(1)
            cand = np.concatenate([nbrs[some], extra], 1)
            if room.any():
                by_ = np.argsort(cand[room] < 0, axis=1, kind="stable")
                nbrs[some[room]] = np.take_along_axis(cand[room], by_, 1)[:, :width]
            if (~room).any():
                nbrs[some[~room]] = graphs.robust_prune(x, some[~room], cand[~room], width, 1.0)
            size = int(at[-1]) + 1
        place = np.full(len(self.x), -1, np.int64)
        place[own] = np.arange(n)
        return own, place, nbrs

    def search(self, q: np.ndarray, k: int, block: int = 256) -> np.ndarray:
        """Rows of the ``k`` nearest found of each query, nearest first (-1: none)."""
        out = np.full((len(q), k), -1, np.int64)
        for i in range(0, len(q), block):
            own_q = q[i : i + block].astype(np.float32)
            start = np.full((len(own_q), 1), self.entry)
            for l in range(len(self.layers) - 1, -1, -1):
                own, place, nbrs = self.layers[l]
                at = np.where(start >= 0, place[np.maximum(start, 0)], -1)
                pool, _ = graphs.search(self.x[own], nbrs, own_q, at, k if l == 0 else 8)
                start = np.where(pool >= 0, own[np.maximum(pool, 0)], -1)
            out[i : i + block, : start.shape[1]] = start[:, :k]
        return out


def search(df: DataFrame, queries, k: int = 20, id_col: str = "vec_id", vec: str = "embedding", shard_rows: int = 8192, least_shards: int = 8, reach: int = 140) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of largest inner product found for each row that the
    condition ``queries`` (on ``id``) holds for."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("x")).where("id is not null")
    rows = scratch.table(vectors.usable(rows, "x").groupBy("id").agg(F.min("x").alias("x")), "usable")
    found = None
    for length, n in vectors.lengths(rows, "x"):
        got = _found(rows.where(F.size("x") == length), n, queries, k, shard_rows, least_shards, reach)
        found = got if found is None else found.union(got)
    if found is None:
        found = rows.select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _found(rows: DataFrame, n: int, queries, k: int, shard_rows: int, least_shards: int, reach: int) -> DataFrame:
    """(query_id, vec_id, score): the best of each shard for each query among ``n`` equally long vectors."""
    shards = max(least_shards, math.ceil(n / shard_rows))
    # Equal vectors share a shard, where they become one node.
    base = rows.select(F.pmod(F.xxhash64("x"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("block"), "id", "x")
    asked = rows.where(queries).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), F.pmod(F.xxhash64("id"), F.lit(math.ceil(n / 65_536) or 1)).alias("block"), "id", "x")

    def run(batches):
        shard, graph = None, None
        for (s, kind, _), t in streams.groups(batches, ["shard", "kind", "block"]):
            x, asker = vectors.matrix(t.column("x")), t.column("id").to_numpy()
            if kind == 0:
                ids = asker  # in order of id
                full, which = np.unique(x, axis=0, return_inverse=True)
                members = np.argsort(which.ravel(), kind="stable")
                first = np.searchsorted(which.ravel()[members], np.arange(len(full) + 1))
                longest = float((full * full).sum(1).max())
                lack = np.sqrt(np.maximum(longest - (full * full).sum(1), 0))
                shard, graph = s, SmallWorld(np.hstack([full, lack[:, None]]))
            elif shard == s and graph is not None:
                got = graph.search(np.hstack([x, np.zeros((len(x), 1))]), max(reach, k + 1))
                out: list[tuple] = []
                for q in range(len(x)):
                    near = got[q][got[q] >= 0]
                    value = full[near] @ x[q]
                    best: list[tuple] = []
                    for v, node in sorted(zip(-value, near.tolist(), strict=True))[: k + 1]:
                        best += [(v, int(ids[m])) for m in members[first[node] : min(first[node + 1], first[node] + k + 1)] if ids[m] != asker[q]]
                    out += [(int(asker[q]), i, -v) for v, i in sorted(best)[:k]]
                cols = list(zip(*out, strict=True)) if out else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    # Ranges deal the shards evenly to tasks; a shard's graph serves the queries that follow it.
    both = base.union(asked).repartitionByRange(shards, "shard").sortWithinPartitions("shard", "kind", "block", "id")
    return both.mapInArrow(run, "query_id long, vec_id long, score double")


def op8(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row whose id is divisible by 20."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)
