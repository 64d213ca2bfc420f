"""Near-duplicate vectors by a robust-pruned flat graph.

Equal vectors are one node with a count of ids. Nodes are dealt to the ``overlap`` nearest of the centroids
that k-means finds on a bounded sample (``sample`` rows, a documented parameter; at most ``most`` centroids, so that beyond
``most * shard_rows`` rows shards grow); dense
regions get centroids in proportion, which bounds the shards but splits a large group over many. Each shard gets a flat graph by robust pruning;
the adjacency lists of a node from all its shards are united, and every node is searched for, from
the shard's medoid, over the united lists: a greedy search first, which then expands all
neighbours in range until none is new. The search goes on beyond the shard: what is in range of a node in range is compared too, in rounds
of joins over the links found, until none is new. Links are the distinct verified pairs, so counts and components agree.
Nodes with a fifteenth of a shard or more in range within one shard are dense: their links are not taken from the
shards but by ``meet``, exactly, block against block of all nodes that the angle to a block's centre does not rule out.
Links are verified by their cosine in double precision. ``audit`` measures the recall.

Edge cases: null, zero and non-finite vectors link with nothing; vectors of different lengths do not link, and each length is a
pass of its own; ties follow from the definition; rows repeated with their id are one vector and each get its result; of several vectors under
one id each is compared, and the id counts once for those that are equal; an empty table gives an empty result; a null id takes no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.llm import graphs, scratch, streams, vectors
from voltlake.llm.components import components


def centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spread rows of a hashed sample."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.sqrt((total * total).sum(1))
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def flat_graph(x: np.ndarray, degree: int = 24, width: int = 48, alpha: float = 1.2, block: int = 512) -> np.ndarray:
    """Robust-pruned neighbours (with reverse edges) of the vectors of a shard."""
    n = len(x)
    out = np.full((n, degree), -1, np.int64)
    for i in range(0, n, block):
        at = np.arange(i, min(i + block, n))
        d = graphs.squared(x[at], x)
        near = graphs.nearest(d, min(width // 2, n))
        spread = (at[:, None] * 7919 + np.arange(1, 1 + width // 2)[None] * (n // (width // 2 + 1) + 1)) % n
        out[at] = graphs.robust_prune(x, at, np.concatenate([near, spread], 1), degree, alpha)
    back = graphs.reverse_edges(out, degree)
    for i in range(0, n, block):
        at = np.arange(i, min(i + block, n))
        out[at] = graphs.robust_prune(x, at, np.concatenate([out[at], back[at]], 1), degree, alpha)
    return out


def in_range(x: np.ndarray, nbrs: np.ndarray, least: float, ask: np.ndarray, beam: int = 32, block: int = 256):
    """Pairs (i, j), i < j, of nodes in the mask ``ask`` with an inner product of at least ``least``, found on the graph."""
    n = len(x)
    medoid = int((x @ x.mean(axis=0)).argmax())
    found, asked = [], np.flatnonzero(ask)
    for i in range(0, len(asked), block):
        at = asked[i : i + block]
        pool, _ = graphs.search(x, nbrs, x[at], np.full((len(at), 1), medoid), beam)
        seen = np.zeros((len(at), n), bool)
        q, j = np.nonzero(pool >= 0)
        new = pool[q, j]
        # Each query's own node is expanded too, so a search that ends elsewhere still sees its surroundings.
        q, new = np.concatenate([q, np.arange(len(at))]), np.concatenate([new, at])
        while len(q):
            fresh = ~seen[q, new]
            q, new = q[fresh], new[fresh]
            key = np.unique(q * n + new)
            q, new = key // n, key % n
            seen[q, new] = True
            step = []
            for s in range(0, len(q), 65_536):
                step.append((x[at[q[s : s + 65_536]]] * x[new[s : s + 65_536]]).sum(1) >= least)
            hit = np.concatenate(step) if step else np.zeros(0, bool)
            q, new = q[hit], new[hit]
            far = (at[q] != new) & ask[new]
            found.append(np.stack([np.minimum(at[q], new), np.maximum(at[q], new)], 1)[far])
            more = nbrs[new]
            q, new = np.repeat(q, more.shape[1])[more.ravel() >= 0], more.ravel()[more.ravel() >= 0]
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    key = np.unique(pairs[:, 0] * n + pairs[:, 1])
    return key // n, key % n


def bound(hit: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ids a (rows of ``hit``) and b (columns) the least id of what each hangs together with."""
    la, lb = a.copy(), b.copy()
    new = hit.any(axis=1)
    while new.any():
        rows, cols = np.zeros(len(a), bool), np.zeros(len(b), bool)
        front = np.flatnonzero(new)[:1]
        while len(front):
            rows[front] = True
            fresh = hit[front].any(axis=0) & ~cols
            cols |= fresh
            front = np.flatnonzero(hit[:, fresh].any(axis=1) & ~rows)
        la[rows] = lb[cols] = min(a[rows].min(), b[cols].min())
        new &= ~rows
    return la, lb


def leaders(c: np.ndarray, size: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Centroids that lead others, and the leader of each one with rows (``size``): the nearest within ``least``."""
    lead, own = np.zeros((0, c.shape[1])), np.full(len(c), -1)
    for i in np.argsort(-size, kind="stable"):
        if not size[i]:
            break
        cos = lead @ c[i]
        if len(cos) and cos.max() >= least:
            own[i] = cos.argmax()
        else:
            own[i], lead = len(lead), np.vstack([lead, c[i] / np.sqrt((c[i] ** 2).sum())])
    return lead, own


BAND = math.pi / 12


def meet(flagged: DataFrame, c: np.ndarray, least: float, block_rows: int, stripe: int = 512) -> DataFrame | None:
    """node, links, root of all links with a dense end, each pair compared once.

    Dense nodes form groups by the leader of their centroid and the band of their angle to it, groups are cut into blocks, and every
    node meets the blocks of each group whose band its own angle to the leader reaches within the link angle."""
    spark = flagged.sparkSession
    sizes = {r["home"]: r["count"] for r in flagged.where("dense").groupBy("home").count().collect()}
    if not sizes:
        return None
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lead, own = leaders(c, np.array([sizes.get(i, 0) for i in range(len(c))]), least)
    shared = spark.sparkContext.broadcast((lead, own))

    def angles(x, to):
        return np.arccos(np.clip(x @ to.T, -1, 1))

    def locate(batches):
        lead, own = shared.value
        for b in batches:
            if b.num_rows:
                at = own[b.column("home").to_numpy()]
                angle = np.arccos(np.clip((vectors.unit(vectors.matrix(b.column("x"))) * lead[at]).sum(1), -1, 1))
                grp = at * 16 + (angle / BAND).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("node", "copies", "x")), pa.array(grp), pa.array(angle)], ["node", "copies", "x", "grp", "angle"])

    dense = scratch.table(flagged.where("dense").mapInArrow(locate, "node long, copies long, x array<double>, grp long, angle double"), "dense")
    groups = dense.groupBy("grp").agg(F.count("*").alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi")).orderBy("grp").collect()
    reach, slack = math.acos(least), 1e-6
    name = np.array([g["grp"] for g in groups])
    lo, hi = (np.array([g[k] for g in groups]) for k in ("lo", "hi"))
    rings = spark.sparkContext.broadcast((name, lead[name // 16], lo - reach - slack, hi + reach + slack))

    def visited(batch):
        name, centre, lo, hi = rings.value
        x = vectors.unit(vectors.matrix(batch.column("x")))
        for i in range(0, len(x), stripe):
            angle = angles(x[i : i + stripe], centre)
            row, col = np.nonzero((angle >= lo) & (angle <= hi))
            yield row + i, name[col]

    def beside(batches):
        for b in batches:
            if b.num_rows:
                for row, grp in visited(b):
                    yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(row)) for k in ("node", "copies", "x")), pa.array(grp)], ["node", "copies", "x", "grp"])

    def pairs(batches):
        for b in batches:
            if b.num_rows:
                mine = b.column("grp").to_numpy()
                for row, grp in visited(b):
                    got = np.unique(np.sort(np.stack([mine[row], grp], 1), axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["g", "h"])

    others = scratch.table(flagged.where("not dense").mapInArrow(beside, "node long, copies long, x array<double>, grp long"), "beside")
    near = {r["grp"]: r["count"] for r in others.groupBy("grp").count().collect()}
    chunks: dict[tuple, range] = {}
    total = 0
    for kind, counts in ((0, {g["grp"]: g["n"] for g in groups}), (1, near)):
        for g, n in counts.items():
            chunks[kind, g] = range(total, total := total + math.ceil(n / block_rows))
    todo = [(i, j) for r in dense.mapInArrow(pairs, "g long, h long").distinct().collect() for i in chunks[0, r["g"]] for j in chunks[0, r["h"]] if r["g"] != r["h"] or i <= j]
    todo += [(i, j) for g in near for i in chunks[0, g] for j in chunks[1, g]]
    # An even task is a block with itself.
    sides = [row for t, (i, j) in enumerate(todo) for row in (((2 * t, i, 0),) if i == j else ((2 * t + 1, i, 0), (2 * t + 1, j, 1)))]
    sides = F.broadcast(spark.createDataFrame(sides, "task long, chunk long, side int"))
    cut = F.broadcast(spark.createDataFrame([(kind, g, r.start, len(r)) for (kind, g), r in chunks.items()], "kind int, grp long, start long, parts long"))
    rows = dense.select("node", "copies", "x", "grp", F.lit(0).alias("kind")).union(others.select("node", "copies", "x", "grp", F.lit(1).alias("kind")))
    rows = rows.join(cut, ["kind", "grp"]).select("node", "copies", "x", (F.col("start") + F.pmod(F.xxhash64("node"), F.col("parts"))).alias("chunk")).join(sides, "chunk")

    def compare(batches):
        for (task,), t in streams.groups(batches, ["task"]):
            side = t.column("side").to_numpy()
            ids, copies = t.column("node").to_numpy(), t.column("copies").to_numpy().astype(np.float64)
            x = vectors.unit(vectors.matrix(t.column("x")))
            alone = task % 2 == 0
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if alone else 1))
            if not len(a) or not len(b):
                continue
            xb = np.ascontiguousarray(x[b].T)
            hit = np.zeros((len(a), len(b)), bool)
            links = np.zeros(len(ids))
            for i in range(0, len(a), stripe):
                at = a[i : i + stripe]
                h = x[at] @ xb >= least
                if alone:
                    h[np.arange(len(at)), np.arange(i, i + len(at))] = False
                else:
                    links[b] += copies[at] @ h
                links[at] += h @ copies[b]
                hit[i : i + stripe] = h
            ra, rb = bound(hit, ids[a], ids[b])
            node, root = np.concatenate([ids[a], ids[b]]), np.concatenate([ra, rb])
            count = np.concatenate([links[a], np.zeros(len(b)) if alone else links[b]]).astype(np.int64)
            some = (count > 0) | (node != root)
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(count[some]), pa.array(root[some])], ["node", "links", "root"])

    return rows.select("task", "side", "node", "copies", "x").repartition(tasks, "task").sortWithinPartitions("task", "side", "node").mapInArrow(compare, "node long, links long, root long")


def prepared(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """One row per distinct vector: node (smallest id), copies (distinct ids), x (unit vector is taken later)."""
    own = vectors.usable(df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("x")).where("id is not null"), "x")
    return own.distinct().groupBy("x").agg(F.min("id").alias("node"), F.count("*").alias("copies"))


def dedup(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", least: float = 0.9, shard_rows: int = 1500, overlap: int = 3, sample: int = 20_000, block_rows: int = 4096, most: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    nodes = scratch.table(prepared(df, id_col, vec), "nodes")
    every = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("x"))
    result = None
    for length, _ in vectors.lengths(nodes, "x"):
        got = linked(nodes.where(F.size("x") == length), least, shard_rows, overlap, sample, block_rows, most)
        result = got if result is None else result.union(got)
    if result is None:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    out = every.join(result, F.when(F.col("vec_id").isNotNull(), every["x"]) == result["x"], "left")
    comp_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("vec_id") == comp_id, F.lit(True)).alias("kept"))


def linked(nodes: DataFrame, least: float, shard_rows: int, overlap: int, sample: int, block_rows: int, most: int) -> DataFrame:
    """x, n_links, component_id of all nodes; their vectors are equally long."""
    spark = nodes.sparkSession
    n = nodes.count()
    rows = nodes.select("node", "x").orderBy(F.xxhash64("node", "x"), "node").limit(sample).collect()
    x = vectors.unit(np.array([r["x"] for r in rows]))
    k = min(len(x), most, max(1, math.ceil(n * overlap / shard_rows)))
    c = centroids(x, k)
    shared, crowd = spark.sparkContext.broadcast(c), max(1, shard_rows // 15)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def assign(batches):
        c = shared.value
        for b in batches:
            if b.num_rows:
                x = vectors.unit(vectors.matrix(b.column("x")))
                near = np.concatenate([graphs.nearest(-(x[i : i + 1024] @ c.T), overlap) for i in range(0, len(x), 1024)])
                home, near = pa.array(near[:, 0].astype(np.int32)), np.sort(near, axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1]), pa.int32()), pa.array(near.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("node"), b.column("copies"), b.column("x"), lists, home], ["node", "copies", "x", "shards", "home"])

    placed = scratch.table(nodes.select("node", "copies", "x").mapInArrow(assign, "node long, copies long, x array<double>, shards array<int>, home int"), "placed")
    dealt = placed.withColumn("shard", F.explode("shards"))

    def build(batches):
        for (_,), t in streams.groups(batches, ["shard"]):
            ids = t.column("node").to_numpy()
            x = vectors.unit(vectors.matrix(t.column("x")))
            g = flat_graph(x)
            near = np.concatenate([(x[i : i + 512] @ x.T >= least).sum(1) - 1 for i in range(0, len(x), 512)])
            flat = np.where(g >= 0, ids[np.maximum(g, 0)], -1)
            at = np.append(0, np.cumsum((g >= 0).sum(1)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat[flat >= 0])), pa.array(near)], ["node", "nbrs", "near"])

    built = dealt.select("shard", "node", "x").repartition(tasks, "shard").sortWithinPartitions("shard", "node").mapInArrow(build, "node long, nbrs array<long>, near long")
    united = scratch.table(built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("nbrs"), (F.max("near") >= crowd).alias("dense")), "united")

    def find(batches):
        for (_,), t in streams.groups(batches, ["shard"]):
            ids, dense = t.column("node").to_numpy(), t.column("dense").to_numpy()
            x = vectors.unit(vectors.matrix(t.column("x")))
            lists = t.column("nbrs").combine_chunks()
            size = np.diff(np.asarray(lists.offsets))
            flat = np.asarray(lists.flatten())
            at = np.searchsorted(ids, flat)
            there = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == flat)
            row = np.repeat(np.arange(len(ids)), size)[there]
            col = np.arange(len(row)) - np.searchsorted(row, row)
            nbrs = np.full((len(ids), int(col.max()) + 1 if len(col) else 1), -1, np.int64)
            nbrs[row, col] = at[there]
            a, b = in_range(x, nbrs, least, ~dense)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    held = dealt.join(united, "node").select("shard", "node", "x", "nbrs", "dense")
    got = held.repartition(tasks, "shard").sortWithinPartitions("shard", "node").mapInArrow(find, "a long, b long")
    found = scratch.table(got.distinct(), "pairs")
    found = beyond(found, placed.join(united.where("not dense").select("node"), "node", "left_semi").select("node", "x"), least)
    flagged = scratch.table(placed.join(united.select("node", "dense"), "node").select("node", "copies", "x", "home", "dense"), "flagged")
    exact = meet(flagged, c, least, block_rows)
    copies = nodes.select("node", "copies")
    both = found.union(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    count = both.join(copies, both["b"] == copies["node"]).groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("links"))
    edges = found.select(F.col("a").alias("node"), F.col("b").alias("to"))
    if exact is not None:
        exact = scratch.table(exact, "dense-links")
        count = count.union(exact.groupBy("node").agg(F.sum("links").alias("links"))).groupBy("node").agg(F.sum("links").alias("links"))
        edges = edges.union(exact.where("node <> root").select("node", "root"))
    comp = components(edges, "node", "to")
    result = nodes.select("node", "x", "copies").join(count, "node", "left").join(comp, "node", "left")
    got = scratch.table(result.select("x", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "node").alias("component_id")), "linked-vectors")
    scratch.drop(placed, united, flagged)
    return got


def beyond(pairs: DataFrame, x: DataFrame, least: float) -> DataFrame:
    """``pairs`` (a < b) and all further links that lie two links apart, round by round until none is new; ``x``: node, x."""
    new = pairs
    while not new.isEmpty():
        ends = lambda p: p.union(p.select(F.col("b").alias("a"), F.col("a").alias("b")))
        there = ends(pairs).select(F.col("a").alias("middle"), F.col("b").alias("other"))
        two = ends(new).select(F.col("a").alias("middle"), F.col("b").alias("one")).join(there, "middle").where("one <> other")
        two = two.select(F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
        two = two.join(x.withColumnsRenamed({"node": "a", "x": "xa"}), "a").join(x.withColumnsRenamed({"node": "b", "x": "xb"}), "b")

        def verified(batches):
            for t in batches:
                if t.num_rows:
                    own = (vectors.unit(vectors.matrix(t.column("xa"))) * vectors.unit(vectors.matrix(t.column("xb")))).sum(1) >= least
                    yield t.select(["a", "b"]).filter(pa.array(own))

        new = scratch.table(two.mapInArrow(verified, "a long, b long"), "new-pairs")
        if not new.isEmpty():
            pairs = scratch.table(pairs.union(new), "pairs")
    return pairs


def audit(df: DataFrame, result: DataFrame, least: float = 0.9, queries: int = 200) -> float:
    """The share of the true links of a hashed set of queries (of the most frequent length) that ``result`` counts, by brute force in blocks."""
    own = vectors.usable(df.select("vec_id", F.col("embedding").cast("array<double>").alias("x")), "x")
    own = own.where(F.size("x") == vectors.lengths(own, "x")[0][0])
    q = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(queries).collect()
    x = vectors.unit(np.array([r["x"] for r in q]))

    def count(batches):
        total = np.zeros(len(x), np.int64)
        for b in batches:
            if b.num_rows:
                total += (x @ vectors.unit(vectors.matrix(b.column("x"))).T >= least).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array([r["vec_id"] for r in q], pa.int64()), pa.array(total)], ["vec_id", "n"])

    true = own.mapInArrow(count, "vec_id long, n long").groupBy("vec_id").agg((F.sum("n") - 1).alias("n"))
    r = true.join(result, "vec_id").agg(F.sum(F.least("n", "n_links")).alias("got"), F.sum("n").alias("all")).first()
    return r["got"] / r["all"] if r["all"] else 1.0


def op4(spark, sf_dir: str) -> DataFrame:
    """All embeddings, linked at a cosine of 0.9."""
    return dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
