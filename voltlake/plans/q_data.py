"""Queries over joins, quality checks and publishing, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voltlake.operators import boxes as B
from voltlake.operators import gate as V
from voltlake.operators import lookups as L
from voltlake.operators import publish as P
from voltlake.sources.tables import table

Q: dict = {}
S: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return keep


ALIASES = [("AUTOMOBILE", "Cars", "canonical", None), ("automobile", "Motor", "alias", None), ("Building", "Building", "canonical", None), ("furniture", "Home", "alias", None), ("HOUSEHOLD", "Home", "alias", None), ("machinery", None, "unusable", "too broad")]


@query("alias_canon", """WITH a(key, canonical, kind, reason) AS (VALUES ('AUTOMOBILE', 'Cars', 0, NULL), ('automobile', 'Motor', 1, NULL), ('Building', 'Building', 0, NULL), ('furniture', 'Home', 1, NULL), ('HOUSEHOLD', 'Home', 1, NULL), ('machinery', NULL, 2, 'too broad')),
b AS (SELECT lower(key) AS k, arg_min(struct_pack(c := canonical, kind := kind, r := reason), kind) AS a FROM a GROUP BY 1), c AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'unseen' WHEN c_custkey % 3 = 0 THEN '  ' || lower(c_mktsegment) || ' ' ELSE c_mktsegment END AS seg FROM customer)
SELECT c_custkey, CASE WHEN a.kind < 2 THEN a.c END AS canonical, CASE WHEN b.k IS NULL THEN 'unrecognised' WHEN a.kind = 2 THEN a.r END AS reason FROM c LEFT JOIN b ON b.k = lower(trim(c.seg))""")
def alias_canon(spark, sf):
    aliases = spark.createDataFrame(ALIASES, "key string, canonical string, kind string, reason string")
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    c = table(spark, sf, "customer").select("c_custkey", F.when(k % 10 == 0, "unseen").when(k % 3 == 0, F.concat(F.lit("  "), F.lower(seg), F.lit(" "))).otherwise(seg).alias("seg"))
    return L.canonicalise(c, aliases, "seg").select("c_custkey", "canonical", "reason")


@query("uncanonical_share", """WITH c AS (SELECT c_nationkey, c_custkey % 10 = 0 OR lower(c_mktsegment) = 'machinery' AS bare FROM customer) SELECT c_nationkey, count(*) FILTER (WHERE bare) AS bare, count(*) AS n, CASE WHEN count(*) FILTER (WHERE bare) = 0 THEN 'pass' WHEN count(*) FILTER (WHERE bare)::DOUBLE / count(*) > 0.25 THEN 'reject' ELSE 'quarantine' END AS verdict FROM c GROUP BY 1""")
def uncanonical_share(spark, sf):
    bare = (F.col("c_custkey") % 10 == 0) | (F.lower("c_mktsegment") == "machinery")
    g = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count_if(bare).alias("bare"), F.count("*").alias("n"))
    return g.withColumn("verdict", F.when(F.col("bare") == 0, "pass").when(F.col("bare") / F.col("n") > 0.25, "reject").otherwise("quarantine"))


@query("novel_keys", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def novel_keys(spark, sf):
    return L.novel(table(spark, sf, "customer"), table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey")


NEW = "new AS (SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey % 3 <> 0), prev AS (SELECT s_suppkey, 'old ' || s_name AS s_name, s_acctbal FROM supplier WHERE s_suppkey % 2 = 0)"


def versions(spark, sf):
    s = table(spark, sf, "supplier")
    return s.where("s_suppkey % 3 <> 0").select("s_suppkey", "s_name", "s_acctbal"), s.where("s_suppkey % 2 = 0").select("s_suppkey", F.concat(F.lit("old "), "s_name").alias("s_name"), "s_acctbal")


@query("carry_forward", f"WITH {NEW} SELECT *, false AS carried FROM new UNION ALL SELECT *, true FROM prev WHERE s_suppkey NOT IN (SELECT s_suppkey FROM new)")
def carry_forward(spark, sf):
    return L.carry_forward(*versions(spark, sf), "s_suppkey")


@query("upsert_rows", f"WITH {NEW} SELECT * FROM prev WHERE s_suppkey NOT IN (SELECT s_suppkey FROM new) UNION ALL SELECT * FROM new")
def upsert_rows(spark, sf):
    new, prev = versions(spark, sf)
    return L.upsert(prev, new, "s_suppkey")


@query("coalesce_previous", f"WITH {NEW}, n AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_name END AS s_name, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_acctbal END AS s_acctbal FROM new) SELECT n.s_suppkey, coalesce(n.s_name, p.s_name) AS s_name, coalesce(n.s_acctbal, p.s_acctbal) AS s_acctbal FROM n LEFT JOIN prev p USING (s_suppkey)")
def coalesce_previous(spark, sf):
    new, prev = versions(spark, sf)
    k = F.col("s_suppkey")
    n = new.select("s_suppkey", F.when(k % 5 != 0, F.col("s_name")).alias("s_name"), F.when(k % 4 != 0, F.col("s_acctbal")).alias("s_acctbal"))
    return L.keep_previous(n, prev, "s_suppkey", ["s_name", "s_acctbal"])


@query("dim_left_defaults", "SELECT n_name, coalesce(r_name, 'UNKNOWN') AS r_name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 2) r ON upper(trim(CAST(n_regionkey AS VARCHAR))) = upper(trim(CAST(r_regionkey AS VARCHAR))) LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")
def dim_left_defaults(spark, sf):
    n, r, s = (table(spark, sf, t) for t in ("nation", "region", "supplier"))
    j = L.with_defaults(n, r.where("r_regionkey <> 2"), F.col("n_regionkey").cast("string"), F.col("r_regionkey").cast("string"), {"r_name": "UNKNOWN"})
    return j.join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name", "r_name").agg(F.count("s_suppkey").alias("suppliers"))


BOXES = "cells AS (SELECT l_orderkey, l_linenumber, l_quantity AS x0, l_quantity + 4 AS x1, l_discount * 100 AS top, l_discount * 100 + 3 AS bottom FROM lineitem), rects AS (SELECT l_orderkey, l_quantity + 1 + l_tax * 20 AS x0, l_quantity + 6 AS x1, l_discount * 100 - 1 AS top, l_discount * 100 + 2.5 AS bottom FROM lineitem)"


def boxes(spark, sf):
    l = table(spark, sf, "lineitem")
    q, d = F.col("l_quantity"), F.col("l_discount") * 100
    cells = l.select("l_orderkey", "l_linenumber", q.alias("x0"), (q + 4).alias("x1"), d.alias("top"), (d + 3).alias("bottom"))
    rects = l.select("l_orderkey", (q + 1 + F.col("l_tax") * 20).alias("x0"), (q + 6).alias("x1"), (d - 1).alias("top"), (d + 2.5).alias("bottom"))
    return cells, rects


@query("rect_overlap_semi", f"WITH {BOXES} SELECT l_orderkey, l_linenumber FROM cells c WHERE EXISTS (SELECT 1 FROM rects r WHERE r.l_orderkey = c.l_orderkey AND greatest(0, least(c.x1, r.x1) - greatest(c.x0, r.x0)) > 0.55::DOUBLE * (c.x1 - c.x0) AND greatest(0, least(c.bottom, r.bottom) - greatest(c.top, r.top)) > 0.55::DOUBLE * (c.bottom - c.top))")
def rect_overlap_semi(spark, sf):
    return B.marked(*boxes(spark, sf), ["l_orderkey"]).select("l_orderkey", "l_linenumber")


@query("midpoint_in_box", f"WITH {BOXES} SELECT c.l_orderkey, c.l_linenumber, count(*) AS n FROM cells c JOIN rects r USING (l_orderkey) WHERE r.x0 <= (c.x0 + c.x1) / 2 AND (c.x0 + c.x1) / 2 < r.x1 AND r.top <= (c.top + c.bottom) / 2 AND (c.top + c.bottom) / 2 < r.bottom GROUP BY 1, 2")
def midpoint_in_box(spark, sf):
    return B.in_boxes(*boxes(spark, sf), ["l_orderkey"]).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("positional_zip", """WITH a AS (SELECT o_custkey, list(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey END ORDER BY o_orderkey) AS a, list(o_totalprice ORDER BY o_orderkey) AS b FROM orders GROUP BY 1), z AS (SELECT o_custkey, unnest(a) AS k, unnest(b) AS v, o_custkey % 5 AS m FROM a)
SELECT o_custkey, k, v FROM z WHERE k IS NOT NULL AND m <> 0""")
def positional_zip(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("s"))
    keys = F.transform("s", lambda x: F.when(x["o_orderkey"] % 4 != 0, x["o_orderkey"]))
    # A detected list of another length is refused.
    values = F.when(F.col("o_custkey") % 5 != 0, F.transform("s", lambda x: x["o_totalprice"])).otherwise(F.array(F.lit(0.0)).cast("array<double>"))
    o = o.withColumns({"a": keys, "b": values}).where((F.size("s") > 1) | (F.col("o_custkey") % 5 != 0))
    return o.select("o_custkey", F.explode(B.zipped(F.col("a"), F.col("b"))).alias("z")).select("o_custkey", F.col("z.a").alias("k"), F.col("z.b").alias("v"))


@query("dup_rows", "SELECT CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey, l_linenumber)")
def dup_rows(spark, sf):
    return V.duplicates(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey", "l_linenumber"])


FINDINGS = """g AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_quantity > 48) AS heavy, count(*) FILTER (WHERE l_discount > 0.09) AS cheap, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1),
f AS (SELECT l_suppkey, 'reject' AS verdict, 'time-sanity' AS "check", CAST(heavy AS VARCHAR) AS detail FROM g WHERE heavy > 20 UNION ALL SELECT l_suppkey, 'quarantine', 'empty-claims', CAST(cheap AS VARCHAR) FROM g WHERE cheap > 40
UNION ALL SELECT l_suppkey, CASE WHEN r::DOUBLE / n > 0.34 THEN 'reject' ELSE 'quarantine' END, 'canonical-division', CAST(r AS VARCHAR) FROM g WHERE r > 0)"""


def findings(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 48).alias("heavy"), F.count_if(F.col("l_discount") > 0.09).alias("cheap"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    share = F.when(F.col("r") / F.col("n") > 0.34, "reject").otherwise("quarantine")
    found = V.rows(g, "l_suppkey", F.col("heavy") > 20, "reject", "time-sanity", F.col("heavy"))
    found = found.unionByName(V.rows(g, "l_suppkey", F.col("cheap") > 40, "quarantine", "empty-claims", F.col("cheap")))
    return found.unionByName(V.rows(g, "l_suppkey", F.col("r") > 0, share, "canonical-division", F.col("r")))


@query("dq_findings", f'WITH {FINDINGS} SELECT l_suppkey, verdict, "check", detail FROM f')
def dq_findings(spark, sf):
    return findings(spark, sf)


@query("dq_verdict", f"WITH {FINDINGS} SELECT s_suppkey AS l_suppkey, CASE coalesce(max(CASE verdict WHEN 'reject' THEN 2 WHEN 'quarantine' THEN 1 END), 0) WHEN 2 THEN 'reject' WHEN 1 THEN 'quarantine' ELSE 'pass' END AS verdict FROM supplier LEFT JOIN f ON l_suppkey = s_suppkey GROUP BY 1")
def dq_verdict(spark, sf):
    return V.verdict(findings(spark, sf), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey")


@query("dq_histogram", f'WITH {FINDINGS} SELECT verdict, "check", count(*) AS n FROM f GROUP BY 1, 2')
def dq_histogram(spark, sf):
    return V.histogram(findings(spark, sf))


@query("volume_drop", """WITH m AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS month, count(*) AS n FROM orders GROUP BY 1, 2), p AS (SELECT *, lag(n) OVER (PARTITION BY o_custkey ORDER BY month) AS before FROM m)
SELECT o_custkey, CAST(month AS DATE) AS month, n, before, coalesce(before >= 2 AND n < 0.5 * before + 0.5, false) AS dropped FROM p""")
def volume_drop(spark, sf):
    m = table(spark, sf, "orders").groupBy("o_custkey", F.trunc("o_orderdate", "month").alias("month")).agg(F.count("*").alias("n"))
    p = m.withColumn("before", F.lag("n").over(Window.partitionBy("o_custkey").orderBy("month")))
    return p.withColumn("dropped", F.coalesce((F.col("before") >= 2) & (F.col("n") < 0.5 * F.col("before") + 0.5), F.lit(False)))


@query("date_regression", """WITH v AS (SELECT o_custkey, o_orderkey, o_orderdate, max(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS active FROM orders) SELECT o_custkey, o_orderkey, coalesce(o_orderdate < active, false) AS refused FROM v""")
def date_regression(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.coalesce(F.col("o_orderdate") < F.max("o_orderdate").over(w), F.lit(False)).alias("refused"))


@query("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@query("hash_of_hashes", "WITH h AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: sha256(x)) AS h FROM documents) SELECT doc_id, sha256(array_to_string(list_sort(h), '|')) AS hash FROM h")
def hash_of_hashes(spark, sf):
    # The parts of a document are its lines: a group that its row bounds.
    parts = F.transform(F.split("text", "\n"), lambda x: F.sha2(x, 256))
    return table(spark, sf, "documents").select("doc_id", P.hash_of_parts(parts).alias("hash"))


@query("tree_hash", "WITH h AS (SELECT source, sha256(text) AS h FROM documents), b AS (SELECT source, left(h, 3) AS b, sha256(string_agg(h, '|' ORDER BY h)) AS h FROM h GROUP BY 1, 2) SELECT source, sha256(string_agg(b || ':' || h, '|' ORDER BY b)) AS hash FROM b GROUP BY source")
def tree_hash(spark, sf):
    return P.tree_hash(table(spark, sf, "documents").select("source", F.sha2("text", 256).alias("part")), ["source"], "part")


@query("change_detect", "SELECT doc_id FROM documents WHERE doc_id % 5 = 0 OR length(text) > 2000")
def change_detect(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    # The active version lacks long documents and differs in a fifth of the others.
    active = d.where(F.char_length("text") <= 2000).withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    return P.changed(d, active, "doc_id", ["text", "lang"]).select("doc_id")


_CONTENT = "substr(md5(o_orderstatus || '|' || o_orderpriority || '|' || printf('%.2f', o_totalprice)), 1, 8)"


@query("landing_dedupe", f"WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, {_CONTENT} AS hash8 FROM orders) SELECT DISTINCT o_custkey, o_orderdate, hash8 FROM o b WHERE o_orderkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM o a WHERE (a.o_orderkey % 2 = 1 OR a.o_orderkey % 6 = 0) AND a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate AND a.hash8 = b.hash8)")
def landing_dedupe(spark, sf):
    # A third of the batch has landed before.
    content = F.concat_ws("|", "o_orderstatus", "o_orderpriority", F.format_string("%.2f", "o_totalprice"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.substring(F.md5(content), 1, 8).alias("hash8"))
    keys = ["o_custkey", "o_orderdate", "hash8"]
    return P.landed(o.where("o_orderkey % 2 = 0").drop("o_orderkey"), o.where("o_orderkey % 2 = 1 or o_orderkey % 6 = 0"), keys)


FEEDS = """feeds AS (SELECT s_suppkey AS feed, s_suppkey % 3 <> 0 AS ok, s_suppkey % 4 <> 0 AS live, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(s_suppkey % 7 AS INTEGER) END AS weekday, s_suppkey % 2 = 0 AS has_last, s_suppkey % 11 = 0 AS link_only, s_suppkey % 6 AS sources FROM supplier),
st AS (SELECT *, CASE WHEN link_only THEN 'link-only' WHEN ok AND live AND (weekday IS NULL OR weekday = 2) THEN 'fresh' WHEN ok OR has_last THEN 'stale' ELSE 'unavailable' END AS status FROM feeds)"""


def feeds(spark, sf):
    k = F.col("s_suppkey")
    f = table(spark, sf, "supplier").select(k.alias("feed"), (k % 3 != 0).alias("ok"), (k % 4 != 0).alias("live"), F.when(k % 5 != 0, (k % 7).cast("int")).alias("weekday"), (k % 2 == 0).alias("has_last"), (k % 11 == 0).alias("link_only"), (k % 6).alias("sources"))
    return f.withColumn("status", P.feed_status(F.col("ok"), F.col("live"), F.col("weekday"), 2, F.col("has_last"), F.col("link_only")))


@query("status_order", f"WITH {FEEDS} SELECT feed, status, CAST(row_number() OVER (ORDER BY status <> 'fresh', feed) AS INTEGER) AS pos FROM st")
def status_order(spark, sf):
    # The feed index has a row per utility; a single ordered pass is its size.
    return feeds(spark, sf).select("feed", "status", F.row_number().over(Window.orderBy(*P.index_order(F.col("status"), F.col("feed")))).alias("pos"))


@query("coverage_level", f"WITH {FEEDS} SELECT feed, CASE WHEN status IN ('fresh', 'stale') THEN 'feeder' WHEN status = 'link-only' THEN 'link' WHEN sources > 0 THEN 'registered' ELSE 'none' END AS level FROM st")
def coverage_level(spark, sf):
    return feeds(spark, sf).select("feed", P.coverage_level(F.col("status"), F.col("sources")).alias("level"))


@query("last_good", f"WITH {FEEDS} SELECT feed, CASE WHEN ok THEN 'new' WHEN has_last THEN 'last' END AS version, status FROM st WHERE ok OR has_last")
def last_good(spark, sf):
    f = feeds(spark, sf)
    new = f.where("ok").select("feed", F.lit("new").alias("version"), "status")
    old = f.where("has_last").select("feed", F.lit("last").alias("version"), "status")
    return L.carry_forward(new, old, "feed").drop("carried")


@query("heartbeat", f"WITH {FEEDS} SELECT feed % 4 AS run, count(*) FILTER (WHERE ok) AS changed, NOT (feed % 4 > 1) OR count(*) FILTER (WHERE ok AND feed % 8 = 1) > 0 AS writes FROM st GROUP BY 1")
def heartbeat(spark, sf):
    g = feeds(spark, sf).groupBy((F.col("feed") % 4).alias("run")).agg(F.count_if("ok").alias("changed"), F.count_if(F.col("ok") & (F.col("feed") % 8 == 1)).alias("c"))
    return g.select("run", "changed", P.is_heartbeat(F.col("c"), F.col("run") > 1).alias("writes"))


@query("summary_counts", f"WITH {FEEDS} SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS reachable, count(*) FILTER (WHERE status = 'fresh') AS fresh, count(*) FILTER (WHERE status = 'stale') AS stale, bool_and(live) AS all_live FROM st")
def summary_counts(spark, sf):
    return feeds(spark, sf).agg(F.count("*").alias("total"), F.count_if("ok").alias("reachable"), F.count_if(F.col("status") == "fresh").alias("fresh"), F.count_if(F.col("status") == "stale").alias("stale"), F.bool_and("live").alias("all_live"))


@query("recolour", f"WITH {FEEDS} SELECT feed, coalesce(CASE feed % 4 WHEN 0 THEN 'red' WHEN 1 THEN 'blue' END, status) AS colour FROM st")
def recolour(spark, sf):
    colours = F.create_map(F.lit(0).cast("long"), F.lit("red"), F.lit(1).cast("long"), F.lit("blue"))
    return feeds(spark, sf).select("feed", F.coalesce(F.try_element_at(colours, F.col("feed") % 4), F.col("status")).alias("colour"))


@query("member_upper", "SELECT c_custkey FROM customer WHERE upper(c_mktsegment) IN ('BUILDING', 'MACHINERY')")
def member_upper(spark, sf):
    return table(spark, sf, "customer").where(F.upper("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey")


@query("doc_stats", "SELECT o_orderstatus, o_orderpriority, count(*) AS claims, count(DISTINCT o_custkey) AS feeders, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,2))), 2) AS DOUBLE) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def doc_stats(spark, sf):
    # The rollup is an extension: subtotals by status.
    return table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("claims"), F.countDistinct("o_custkey").alias("feeders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("grid_summary", "WITH g AS (SELECT o_custkey, count(*) AS n, list_sort(list_distinct(list(o_orderstatus))) AS s, bool_and(o_totalprice > 1000) AS all_ok FROM orders GROUP BY 1) SELECT max(n) AS widest, count(DISTINCT array_to_string(s, ',')) AS grids, bool_and(all_ok) AS all_ok FROM g")
def grid_summary(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ",").alias("s"), F.bool_and(F.col("o_totalprice") > 1000).alias("ok"))
    return g.agg(F.max("n").alias("widest"), F.countDistinct("s").alias("grids"), F.bool_and("ok").alias("all_ok"))


@query("set_algebra", "WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier) SELECT k, 'both' AS side FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT k, 'left' FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'any' FROM (SELECT k FROM a UNION SELECT k FROM b)")
def set_algebra(spark, sf):
    a = table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).distinct()
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    side = lambda df, s: df.withColumn("side", F.lit(s))
    return side(a.intersect(b), "both").union(side(a.exceptAll(b), "left")).union(side(a.union(b).distinct(), "any"))


@query("union_missing", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::VARCHAR AS area FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, 'north' FROM supplier")
def union_missing(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("north").alias("area"))
    return c.unionByName(s, allowMissingColumns=True)


@query("otsu_threshold", """WITH b AS (SELECT user_id % 5 AS sheet, least(255, CAST(floor(value) AS INTEGER)) AS bin FROM events), h AS (SELECT sheet, bin, count(*)::DOUBLE AS n FROM b GROUP BY 1, 2),
c AS (SELECT sheet, bin, sum(n) OVER w AS w0, sum(n * bin) OVER w AS s0, sum(n) OVER (PARTITION BY sheet) AS w, sum(n * bin) OVER (PARTITION BY sheet) AS s, max(bin) OVER (PARTITION BY sheet) - min(bin) OVER (PARTITION BY sheet) AS spread FROM h WINDOW w AS (PARTITION BY sheet ORDER BY bin)),
v AS (SELECT *, CASE WHEN w0 < w THEN w0 * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2) ELSE 0 END AS between_var FROM c) SELECT sheet, CAST(max_by(bin, (round(between_var, 3), -bin)) AS INTEGER) AS threshold, max(spread) > 18 AS usable FROM v GROUP BY sheet""")
def otsu_threshold(spark, sf):
    from voltlake.operators.sheets import otsu

    return otsu(table(spark, sf, "events").select((F.col("user_id") % 5).alias("sheet"), F.col("value").alias("mean")), ["sheet"], "mean")


@query("column_roles", """WITH n AS (SELECT s_nationkey AS sheet, count(*) AS n FROM supplier GROUP BY 1), r AS (SELECT 'area' AS role, 1 AS col, 1 AS least UNION ALL SELECT 'name', 0, 2 UNION ALL SELECT 'code', 2, 2 UNION ALL SELECT 'load', 3, 2)
SELECT CAST(sheet AS VARCHAR) AS doc_id, role, col FROM n JOIN r ON n.n >= r.least""")
def column_roles(spark, sf):
    from voltlake.operators.sheets import column_roles as roles

    # A sheet for each nation, a row for each supplier: a name with its voltage, a long area, a code and a load, read in two languages.
    k = F.col("s_suppkey")
    texts = [("ben", F.lit("ফিডার ১১ কেভি")), ("ben", F.concat(F.lit("ঢাকা মিরপুর গুলশান নয়াপল্টন এলাকা "), F.repeat(F.lit("বাজার "), (k % 3 + 1).cast("int")))), ("eng", F.concat(F.lit("A"), F.lpad((k % 900 + 100).cast("string"), 3, "0"))), ("eng", F.concat((k % 9 + 1).cast("string"), F.lit(".5")))]
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.lit(lang).alias("lang"), t.alias("text")) for c, (lang, t) in enumerate(texts)])
    read = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("doc_id"), k.alias("row"), F.explode(cells).alias("c")).select("doc_id", "row", "c.*")
    widths = read.select("doc_id", "col").distinct().withColumn("width_px", F.when(F.col("col") == 1, 400).when(F.col("col") == 0, 200).otherwise(60))
    return roles(read, widths, ["কেভি"])


@query("canonical_row", """WITH m AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS h FROM events), r AS (SELECT user_id, day, list_sort(list_distinct(list(h))) AS hours FROM m GROUP BY 1, 2), d AS (SELECT *, CASE WHEN user_id % 9 = 0 THEN 'header' WHEN user_id % 10 = 0 THEN 'no feeder' WHEN len(list_filter(hours, lambda x: x >= 6)) = 0 THEN 'no marks' END AS drop_reason FROM r)
SELECT drop_reason, count(*) AS n, CAST(sum(len(list_filter(hours, lambda x: x >= 6))) AS BIGINT) AS marks FROM d GROUP BY 1""")
def canonical_row(spark, sf):
    from voltlake.operators.sheets import canonical_cells, drop_reason

    m = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set(F.hour("ts")).alias("hours"))
    u = F.col("user_id")
    label = F.when(u % 9 == 0, "Feeder Name").when(u % 10 == 0, "").otherwise(F.concat(F.lit("F"), u.cast("string")))
    hours = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.when(F.array_contains("hours", h) & (h >= 6), "0").otherwise(""))
    cells = F.concat(F.array(F.lit("Division"), F.lit("area")), F.array(label, F.lit("")), hours)
    row = m.withColumn("row", canonical_cells(cells, F.lit(4)))
    row = row.withColumns({"drop_reason": drop_reason(F.col("row")), "marks": F.size(F.filter(F.slice("row", 6, 24), lambda c: F.trim(c) != ""))})
    return row.groupBy("drop_reason").agg(F.count("*").alias("n"), F.sum("marks").alias("marks"))
