"""Queries over names, tokens, links and files, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voltlake.functions import geo as G
from voltlake.functions import ranking as R
from voltlake.functions import text as X
from voltlake.operators import intervals as I
from voltlake.sources import scans
from voltlake.sources.tables import located, table

Q: dict = {}
S: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return keep


WS = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def ws_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}', ' ', 'g'))"


def slug_sql(c: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown')"


def fold_sql(c: str) -> str:
    t = f"translate(lower({c}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
    t = f"regexp_replace({t}, '[^a-z0-9ঀ-৿ ]+', ' ', 'g')"
    for pair in ("kh", "gh", "th", "dh", "bh", "sh", "ch"):
        t = f"replace({t}, '{pair}', '{pair[0]}')"
    t = f"replace({t}, 'ph', 'f')"
    for letter in "abcdefghijklmnopqrstuvwxyz":
        t = f"regexp_replace({t}, '{letter}{letter}+', '{letter}', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '[wy]', '', 'g'), '[aeiou]+', 'a', 'g')"
    return f"trim(regexp_replace({t}, ' +', ' ', 'g'))"


@query("slug_ws", f"SELECT p_partkey, {ws_sql('p_name')} AS name, {slug_sql('p_name')} AS slug, {slug_sql(chr(39) + '---' + chr(39))} AS none FROM part")
def slug_ws(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.collapse_ws(F.col("p_name")).alias("name"), X.slug_ascii(F.col("p_name")).alias("slug"), X.slug_ascii(F.lit("---")).alias("none"))


@query("fold_names", f"SELECT p_partkey, {fold_sql('p_name')} AS fold FROM part")
def fold_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.fold_latin(F.col("p_name")).alias("fold"))


@query("fold_texts", f"SELECT doc_id, md5({fold_sql('text')}) AS fold FROM documents")
def fold_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.fold_latin(F.col("text"))).alias("fold"))


ADDRESS = "CASE CAST(event_id % 5 AS INTEGER) WHEN 0 THEN format('Road {:d}, Sector {:d}, Uttora', event_id % 40, event_id % 15) WHEN 1 THEN format('blk {} House-{:d} under Kallyanpur', chr(CAST(97 + event_id % 6 AS INTEGER)), event_id % 200) WHEN 2 THEN 'the Dhaka area' WHEN 3 THEN format('ave. {:d} Gulsan rd 7 rd 7', event_id % 9) ELSE format('Mirpore {:d}', event_id % 12) END"


def address():
    k = F.col("event_id")
    return (
        F.when(k % 5 == 0, F.format_string("Road %d, Sector %d, Uttora", k % 40, k % 15)).when(k % 5 == 1, F.format_string("blk %s House-%d under Kallyanpur", F.chr(97 + k % 6), k % 200))
        .when(k % 5 == 2, "the Dhaka area").when(k % 5 == 3, F.format_string("ave. %d Gulsan rd 7 rd 7", k % 9)).otherwise(F.format_string("Mirpore %d", k % 12))
    )


_UNIT_SQL = X.UNIT.replace("\\b", r"\b")


def unit_sql(c: str) -> str:
    kinds, values = (f"regexp_extract_all(lower({c}), '{_UNIT_SQL}', {k})" for k in (1, 2))
    canon = "CASE x[1] WHEN 'sec' THEN 'sector' WHEN 'rd' THEN 'road' WHEN 'blk' THEN 'block' WHEN 'ave' THEN 'avenue' ELSE x[1] END || ':' || x[2]"
    return f"list_transform(list_zip({kinds}, {values}), lambda x: {canon})"


@query("unit_tokens", f"WITH a AS (SELECT event_id, {ADDRESS} AS t FROM events) SELECT event_id, array_to_string(list_sort(list_distinct({unit_sql('t')})), ' ') AS units FROM a")
def unit_tokens(spark, sf):
    return table(spark, sf, "events").select("event_id", F.array_join(F.array_sort(X.unit_tokens(address())), " ").alias("units"))


_DRIFT_SQL = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in X.DRIFT.items()) + " ELSE w END"
_STOP_SQL = ", ".join(f"'{w}'" for w in X.STOP)


def tokens_sql(c: str) -> str:
    words = f"list_transform(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9ঀ-৿]+'), lambda w: length(w) >= 3 AND NOT list_contains([{_STOP_SQL}], w) AND NOT regexp_full_match(w, '[0-9]+')), lambda w: {_DRIFT_SQL})"
    folded = f"list_transform(list_filter({words}, lambda v: {fold_sql('v')} <> '' AND {fold_sql('v')} <> v), lambda v: '~' || {fold_sql('v')})"
    return f"list_distinct(list_concat(list_concat({unit_sql(c)}, {words}), {folded}))"


@query("address_tokens", f"WITH a AS (SELECT event_id, {ADDRESS} AS t FROM events) SELECT event_id, array_to_string(list_sort({tokens_sql('t')}), ' ') AS tokens FROM a")
def address_tokens(spark, sf):
    return table(spark, sf, "events").select("event_id", F.array_join(F.array_sort(X.tokens(address())), " ").alias("tokens"))


@query("token_coverage", f"""WITH a AS (SELECT event_id, user_id, {ADDRESS} AS t FROM events), k AS (SELECT event_id, user_id, {tokens_sql('t')} AS t FROM a), e AS (SELECT user_id + 1 AS user_id, list_distinct(flatten(list({tokens_sql('t')}))) AS e FROM a GROUP BY 1),
j AS (SELECT k.event_id, k.t, coalesce(e.e, []) AS e FROM k LEFT JOIN e USING (user_id)), w AS (SELECT event_id, list_transform(t, lambda x: CASE WHEN contains(x, ':') THEN 2.0 WHEN starts_with(x, '~') THEN 0.5 ELSE 1.0 END) AS all_w, list_transform(list_filter(t, lambda x: list_contains(e, x)), lambda x: CASE WHEN contains(x, ':') THEN 2.0 WHEN starts_with(x, '~') THEN 0.5 ELSE 1.0 END) AS hit_w FROM j)
SELECT event_id, CASE WHEN len(all_w) = 0 THEN 0.0::DOUBLE ELSE round(coalesce(list_sum(hit_w), 0)::DOUBLE / list_sum(all_w)::DOUBLE, 6) END AS coverage FROM w""")
def token_coverage(spark, sf):
    a = table(spark, sf, "events").select("event_id", "user_id", address().alias("t"))
    claims = a.select("event_id", "user_id", X.tokens(F.col("t")).alias("t"))
    # A claim is held against what is known of the next user's place.
    words = a.select((F.col("user_id") + 1).alias("user_id"), F.explode(X.tokens(F.col("t"))).alias("w")).groupBy("user_id").agg(F.collect_set("w").alias("e"))
    j = claims.join(words, "user_id", "left")
    return j.select("event_id", F.round(R.token_coverage(F.col("t"), F.coalesce("e", F.array().cast("array<string>"))), 6).alias("coverage"))


_BN = "['ঢাকা', 'মিরপুর ১০', 'নয়ামাটি', 'গুলশান-২', 'Plain 12']"


def _bn():
    return F.element_at(F.array(*[F.lit(x) for x in ("ঢাকা", "মিরপুর ১০", "নয়ামাটি", "গুলশান-২", "Plain 12")]), (F.col("doc_id") % 5 + 1).cast("int"))


def translit_sql(c: str) -> str:
    t = c
    for base, one in (("য", "য়"), ("ড", "ড়"), ("ঢ", "ঢ়")):
        t = f"replace({t}, '{base}়', '{one}')"
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in X.LATIN.items())
    one = f"CASE c {cases} ELSE CASE WHEN regexp_full_match(c, '[A-Za-z0-9]') THEN lower(c) WHEN regexp_full_match(c, '[ ,.()/-]') THEN c ELSE '' END END"
    return f"trim(regexp_replace(array_to_string(list_transform(regexp_extract_all({t}, '(?s).'), lambda c: {one}), ''), '\\s+', ' ', 'g'))"


_CLEAN_TAIL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace({t}, '|', ' '), '৷', ','), '\\s+', ' ', 'g'), ' ?, ?', ', ', 'g'), '(, ?)+', ', ', 'g'), '^[ ,.।-]+|[ ,.।-]+$', '', 'g')"


@query("clean_split", f"WITH p AS (SELECT doc_id, list_transform(regexp_split_to_array(text, '[,،৷/\\n]'), lambda x: {_CLEAN_TAIL.format(t='x')}) AS parts FROM documents) SELECT doc_id, md5(array_to_string(list_sort(list_distinct(list_filter(parts, lambda x: length(x) >= 2 AND regexp_matches(x, '[A-Za-zঀ-৿]')))), '|')) AS areas FROM p")
def clean_split(spark, sf):
    """The areas of whole texts, line by line."""
    return table(spark, sf, "documents").select("doc_id", F.md5(F.array_join(F.array_sort(X.split_areas(F.translate("text", "\n", ","))), "|")).alias("areas"))


@query("script_ratio", f"WITH d AS (SELECT doc_id, text || ' ' || ({_BN})[CAST(doc_id % 5 AS INTEGER) + 1] AS t FROM documents), n AS (SELECT *, len(regexp_extract_all(t, '[ঀ-৿]')) AS b, length(replace(t, ' ', '')) AS n FROM d) SELECT doc_id, coalesce(round(b::DOUBLE / n, 6), 0) AS ratio, b >= 3 AS name, b >= 2 AND b::DOUBLE / n > 0.6 AS plausible FROM n")
def script_ratio(spark, sf):
    t = F.concat("text", F.lit(" "), _bn())
    return table(spark, sf, "documents").select("doc_id", F.round(X.bengali_ratio(t), 6).alias("ratio"), X.looks_like_a_name(t).alias("name"), X.is_plausible_bangla(t).alias("plausible"))


@query("translit", f"WITH d AS (SELECT doc_id, text || ' ' || ({_BN})[CAST(doc_id % 5 AS INTEGER) + 1] AS t FROM documents) SELECT doc_id, md5({translit_sql('t')}) AS latin, md5(translate(t, '০১২৩৪৫৬৭৮৯', '0123456789')) AS digits FROM d")
def translit(spark, sf):
    t = F.concat("text", F.lit(" "), _bn())
    return table(spark, sf, "documents").select("doc_id", F.md5(X.transliterate(t)).alias("latin"), F.md5(X.ascii_digits(t)).alias("digits"))


PLACES = f"""places AS (SELECT p_partkey AS place_id, p_name AS name, p_type AS kind, {fold_sql('p_name')} AS fold, 88.0::DOUBLE + CAST((p_partkey * 7919) % 4700 AS DOUBLE) / 1000 AS lon, 20.5::DOUBLE + CAST((p_partkey * 104729) % 6200 AS DOUBLE) / 1000 AS lat FROM part),
q AS (SELECT DISTINCT fold AS q FROM places)"""


@query("place_search", f"""WITH {PLACES}, m AS (SELECT q, place_id, name, kind, CASE WHEN fold = q THEN 100 WHEN starts_with(fold, q) THEN 70 WHEN contains(fold, ' ' || q) THEN 55 WHEN contains(fold, q) THEN 35 END AS base, least(10.0, abs(length(fold) - length(q)) / 2) AS gap,
12742.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - 23.78) / 2), 2) + cos(radians(23.78)) * cos(radians(lat)) * pow(sin(radians(lon - 90.40) / 2), 2)))) AS km FROM q JOIN places ON left(q, 1) = left(fold, 1)),
s AS (SELECT q, place_id, name || '|' || kind AS key, base - gap + 26.0 * exp(-km / 45) AS score FROM m WHERE base IS NOT NULL), u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY q, key ORDER BY round(score, 6) DESC, place_id) = 1)
SELECT q, CAST(row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, place_id) AS INTEGER) AS rank, place_id, round(score, 4) AS score FROM u QUALIFY rank <= 7""")
def place_search(spark, sf):
    part = located(table(spark, sf, "part"), "p_partkey")
    places = part.select(F.col("p_partkey").alias("place_id"), F.concat_ws("|", "p_name", "p_type").alias("key"), X.fold_latin(F.col("p_name")).alias("fold"), "lat", "lon")
    # Every distinct folded name is a query. It meets the places that hold its first characters anywhere: names are indexed by their
    # runs of as many characters, so the infix rule is an equi-join too.
    q = places.select(F.col("fold").alias("q")).distinct().withColumn("k", F.least(F.lit(8), F.char_length("q")))
    sizes = [r["k"] for r in q.select("k").distinct().collect()]  # at most 9
    runs = lambda k: F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("fold") - k + 1), lambda i: F.struct(F.lit(k).alias("k"), F.substr("fold", i, F.lit(k)).alias("gram"))))
    grams = [F.when(F.char_length("fold") >= k, runs(k)).otherwise(F.array().cast("array<struct<k:int,gram:string>>")) for k in sizes if k]
    indexed = places.withColumn("g", F.explode(F.concat(*grams))).select("*", "g.k", "g.gram").drop("g")
    q = q.where("k > 0").withColumn("gram", F.left("q", F.col("k")))
    m = indexed.join(q, ["k", "gram"]).where(F.left("q", F.lit(1)) == F.left("fold", F.lit(1)))
    km = G.haversine_km(F.lit(23.78), F.lit(90.40), F.col("lat"), F.col("lon"))
    s = m.withColumn("score", R.place_score(F.col("fold"), F.col("q"), F.lit(0), km)).where("score is not null").withColumn("r", F.round("score", 6))
    u = I.first_per_key(s, ["q", "key"], F.desc("r"), F.col("place_id"))
    top = u.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("r"), "place_id"))).where("rank <= 7")
    return top.select("q", "rank", "place_id", F.round("score", 4).alias("score"))


@query("href_scan", """WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) SELECT href, count(*) AS n, count(DISTINCT page_id) AS pages, max(page_id) AS last_page FROM h GROUP BY href""")
def href_scan(spark, sf):
    h = table(spark, sf, "pages").select("page_id", F.explode(scans.links(F.col("html"))).alias("href"))
    return h.groupBy("href").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"), F.max("page_id").alias("last_page"))


@query("label_near", """WITH h AS (SELECT page_id, html, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l, regexp_split_to_array(html, 'href="[^"]*"') AS p FROM pages), u AS (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM h),
a AS (SELECT page_id, html, CAST(i - 1 AS INTEGER) AS pos, l[i] AS href, CAST(1 + list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(l[1:i - 1], lambda x: length(x) + 7)), 0) AS BIGINT) AS here FROM u),
t AS (SELECT page_id, pos, href, trim(regexp_replace(regexp_replace(substring(html, greatest(1, here - 300), least(300, here - 1)), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM a) SELECT page_id, pos, href, right(t, 90) AS label FROM t""")
def label_near(spark, sf):
    """Every link of a page with its own label."""
    p = table(spark, sf, "pages").select("page_id", "html", scans.links(F.col("html")).alias("l"), F.split("html", r'href="[^"]*"').alias("p"))
    h = p.select("*", F.posexplode("l").alias("pos", "href"))
    size = lambda c, n, more: F.aggregate(F.slice(c, F.lit(1), n), F.lit(0), lambda s, x: s + F.char_length(x) + more)
    at = size("p", F.col("pos") + 1, 0) + size("l", F.col("pos"), 7) + 1
    return h.withColumn("at", at).select("page_id", "pos", "href", scans.label_at(F.col("html"), F.col("at")).alias("label"))


@query("tag_strip", "SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS text_hash FROM pages")
def tag_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(F.trim(F.regexp_replace(X.strip_tags(F.col("html")), r"\s+", " "))).alias("text_hash"))


@query("sniff_format", """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'pdf' WHEN page_id % 4 = 1 THEN 'html' WHEN page_id % 4 = 2 THEN 'json' WHEN regexp_extract(lower(url), '\\.([a-z0-9]{2,4})(?:[?#].*)?$', 1) IN ('pdf', 'html', 'json', 'csv', 'xlsx', 'png', 'jpg') THEN regexp_extract(lower(url), '\\.([a-z0-9]{2,4})(?:[?#].*)?$', 1) ELSE 'bin' END AS format FROM pages""")
def sniff_format(spark, sf):
    k = F.col("page_id") % 4
    body = F.when(k == 0, F.lit("%PDF-1.4")).when(k == 1, F.col("html")).otherwise(F.lit("{}"))
    kind = F.when(k == 2, "application/json").otherwise("application/octet-stream")
    return table(spark, sf, "pages").select("page_id", scans.sniff(body, kind, F.col("url")).alias("format"))


PROBES = "probes AS (SELECT page_id, url, CASE WHEN page_id % 6 = 0 THEN 404 WHEN page_id % 11 = 0 THEN NULL ELSE 200 END AS status, starts_with(url, 'https') AS tls_ok, CASE WHEN page_id % 5 = 0 THEN 'pdf' ELSE 'html' END AS declared, 'html' AS observed, length(html) AS bytes, page_id % 3 AS slug, page_id % 17 AS rev FROM pages)"


def probes(spark, sf):
    k = F.col("page_id")
    return table(spark, sf, "pages").select(
        "page_id", "url", F.when(k % 6 == 0, 404).when(k % 11 != 0, 200).alias("status"), F.startswith("url", F.lit("https")).alias("tls_ok"),
        F.when(k % 5 == 0, "pdf").otherwise("html").alias("declared"), F.lit("html").alias("observed"), F.char_length("html").alias("bytes"), (k % 3).alias("slug"), (k % 17).alias("rev"),
    )


@query("probe_status", f"WITH {PROBES} SELECT page_id, coalesce(status = 200 AND bytes > 0, false) AS ok, CASE WHEN status IS NULL THEN 'unreachable' WHEN status <> 200 THEN 'status ' || status WHEN declared <> observed THEN 'declared ' || declared || ', observed ' || observed END AS error FROM probes")
def probe_status(spark, sf):
    p = probes(spark, sf)
    error = F.when(F.col("status").isNull(), "unreachable").when(F.col("status") != 200, F.concat(F.lit("status "), F.col("status").cast("string"))).when(F.col("declared") != F.col("observed"), F.concat(F.lit("declared "), F.col("declared"), F.lit(", observed "), F.col("observed")))
    return p.select("page_id", F.coalesce((F.col("status") == 200) & (F.col("bytes") > 0), F.lit(False)).alias("ok"), error.alias("error"))


@query("top_revision", f"WITH {PROBES} SELECT slug, max(rev) AS rev, max_by(url, (rev, page_id)) AS url FROM probes WHERE status = 200 AND declared = 'html' GROUP BY slug")
def top_revision(spark, sf):
    live = probes(spark, sf).where((F.col("status") == 200) & (F.col("declared") == "html"))
    return live.groupBy("slug").agg(F.max("rev").alias("rev"), F.max_by("url", F.struct("rev", "page_id")).alias("url"))


@query("fixed_width", """WITH l AS (SELECT event_id, rpad('u' || user_id, 12, ' ') || lpad(CAST(event_id % 100 AS VARCHAR), 4, ' ') || '    ' || lpad(CASE WHEN event_id % 3 = 0 THEN 'x' ELSE CAST(user_id % 50 AS VARCHAR) END, 4, ' ') AS line FROM events)
SELECT event_id, CAST(event_id % 100 AS INTEGER) AS a, TRY_CAST(nullif(regexp_extract(substring(line, 18, 10), '([0-9]+)', 1), '') AS INTEGER) AS b FROM l""")
def fixed_width(spark, sf):
    k = F.col("event_id")
    line = F.concat(F.rpad(F.concat(F.lit("u"), F.col("user_id").cast("string")), 12, " "), F.lpad((k % 100).cast("string"), 4, " "), F.lit("    "), F.lpad(F.when(k % 3 == 0, "x").otherwise((F.col("user_id") % 50).cast("string")), 4, " "))
    cells = scans.fixed_width(line, [(13, 16), (20, 24)])
    return table(spark, sf, "events").select("event_id", cells.alias("c")).select("event_id", F.col("c")[0].alias("a"), F.col("c")[1].alias("b"))


@query("columnar_decode", "SELECT CAST(n_regionkey AS INTEGER) AS region, n_name AS name, CAST(n_nationkey AS VARCHAR) AS code FROM nation")
def columnar_decode(spark, sf):
    one = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("a"))
    wire = one.select("n_regionkey", F.array_join(F.transform("a", lambda x: x["n_name"]), "|").alias("n"), F.array_join(F.transform("a", lambda x: x["n_nationkey"].cast("string")), "|").alias("k"))
    back = wire.select("n_regionkey", F.explode(scans.delimited({"name": F.col("n"), "code": F.col("k")})).alias("r"))
    return back.select(F.col("n_regionkey").cast("int").alias("region"), "r.name", "r.code")


@query("json_prop", "SELECT event_id, TRY_CAST(props->>'$.k' AS INTEGER) AS k FROM events")
def json_prop(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("load_band", """WITH t AS (SELECT l_orderkey, l_linenumber, CASE CAST(l_linenumber AS INTEGER) % 5 WHEN 0 THEN printf('%.1f', l_quantity / 5) WHEN 1 THEN printf('%.0f', l_quantity) WHEN 2 THEN replace(printf('%.1f', l_quantity / 5), '.', ',') WHEN 3 THEN replace(printf('%.2f', l_quantity / 9), '.', ' . ') ELSE 'abc' END AS t FROM lineitem),
v AS (SELECT *, TRY_CAST(nullif(regexp_extract(t, '([0-9]{1,3}\\.[0-9]{1,2})', 1), '') AS DOUBLE) AS v FROM t) SELECT l_orderkey, l_linenumber, CASE WHEN v BETWEEN 0.2 AND 15 THEN round(v, 2) END AS plausible, TRY_CAST(regexp_replace(t, '\\s+', '', 'g') AS DOUBLE) AS lenient, trim(t) <> '' AS marked FROM v""")
def load_band(spark, sf):
    n, q = F.col("l_linenumber") % 5, F.col("l_quantity")
    t = F.when(n == 0, F.format_string("%.1f", q / 5)).when(n == 1, F.format_string("%.0f", q)).when(n == 2, F.replace(F.format_string("%.1f", q / 5), F.lit("."), F.lit(","))).when(n == 3, F.replace(F.format_string("%.2f", q / 9), F.lit("."), F.lit(" . "))).otherwise("abc")
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", t.alias("t"))
    return l.select("l_orderkey", "l_linenumber", X.load_plausible(F.col("t")).alias("plausible"), X.load_lenient(F.col("t")).alias("lenient"), (F.trim("t") != "").alias("marked"))


@query("title_ids", f"SELECT p_partkey, array_to_string(list_transform(string_split(regexp_replace({slug_sql('p_name')}, '[-_]+', ' ', 'g'), ' '), lambda w: upper(left(w, 1)) || substring(w, 2)), ' ') AS title, lower(p_brand) || ':' || {slug_sql('p_type')} || ':' || {slug_sql('p_name')} AS id FROM part")
def title_ids(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.title_case(X.slug_ascii(F.col("p_name"))).alias("title"), X.feeder_id(F.col("p_brand"), F.col("p_type"), F.col("p_name")).alias("id"))


@query("name_pair", "WITH n AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN 'ঢাকা' WHEN n_nationkey % 7 = 0 THEN NULL ELSE n_name END AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS en, CASE WHEN n_nationkey % 5 = 0 THEN 'মিরপুর' END AS bn FROM nation) SELECT k, coalesce(en, CASE WHEN NOT regexp_matches(name, '[ঀ-৿]') THEN name END) AS latin, coalesce(bn, CASE WHEN regexp_matches(name, '[ঀ-৿]') THEN name END) AS bengali FROM n")
def name_pair(spark, sf):
    k = F.col("n_nationkey")
    n = table(spark, sf, "nation").select(k.alias("k"), F.when(k % 3 == 0, "ঢাকা").when(k % 7 != 0, F.col("n_name")).alias("name"), F.when(k % 2 == 0, F.col("n_name")).alias("en"), F.when(k % 5 == 0, "মিরপুর").alias("bn"))
    own = F.col("name").rlike(f"[{X.BENGALI}]")
    return n.select("k", F.coalesce("en", F.when(~own, F.col("name"))).alias("latin"), F.coalesce("bn", F.when(own, F.col("name"))).alias("bengali"))


@query("first_wins", "WITH f AS (SELECT p_brand, p_name, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) = 1), l AS (SELECT p_brand, list(p_name ORDER BY p_partkey) AS names FROM f GROUP BY p_brand) SELECT p_brand, array_to_string(names[1:3], ', ') || CASE WHEN len(names) > 3 THEN format(' +{:d} more', len(names) - 3) ELSE '' END AS said FROM l")
def first_wins(spark, sf):
    f = I.first_per_key(table(spark, sf, "part").select("p_brand", "p_name", "p_partkey"), ["p_brand", "p_name"], F.col("p_partkey"))
    # Three names and a count are kept for each brand, not all.
    three = f.withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))).withColumn("n", F.count("*").over(Window.partitionBy("p_brand"))).where("r <= 3")
    g = three.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "p_name"))), lambda x: x["p_name"]), ", ").alias("head"), F.max("n").alias("n"))
    return g.select("p_brand", F.when(F.col("n") > 3, F.concat("head", F.format_string(" +%d more", F.col("n") - 3))).otherwise(F.col("head")).alias("said"))


@query("escape_html", "SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS h FROM documents")
def escape_html(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.html_escape(F.col("text"))).alias("h"))
