"""Queries over windows, clocks and ordered rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voltlake.functions import timewin as T
from voltlake.operators import intervals as I
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


def marks(spark, sf):
    """(user_id, day, hour) marks of the events."""
    return table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"))


MARKS = "marks AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hour FROM events)"
HOURS = f"""{MARKS}, isl AS (SELECT *, hour - row_number() OVER (PARTITION BY user_id, day ORDER BY hour) AS i FROM marks),
wins AS (SELECT user_id, day, CAST(min(hour) * 60 AS INTEGER) AS start_min, CAST((max(hour) + 1) * 60 AS INTEGER) AS end_min FROM isl GROUP BY user_id, day, i)"""


@query("hour_windows", f"WITH {HOURS} SELECT user_id, day, start_min, end_min, format('{{:02d}}:{{:02d}}', end_min // 60, end_min % 60) AS end_text FROM wins")
def hour_windows(spark, sf):
    return I.merge_hours(marks(spark, sf), ["user_id", "day"]).withColumn("end_text", T.format_minutes(F.col("end_min")))


def spans(spark, sf):
    ev = table(spark, sf, "events")
    start = F.hour("ts") * 60 + F.minute("ts")
    return ev.select("user_id", F.to_date("ts").alias("day"), start.alias("s"), F.least(F.lit(1440), start + (F.floor("value") % 90).cast("int")).alias("e"))


SPANS = """spans AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS s,
CAST(least(1440, hour(ts) * 60 + minute(ts) + CAST(floor(value) AS BIGINT) % 90) AS INTEGER) AS e FROM events)"""


def _merge_sql(new: str) -> str:
    return f"""WITH {SPANS}, f AS (SELECT *, CASE WHEN {new} THEN 0 ELSE 1 END AS n FROM spans WHERE e > s
WINDOW w AS (PARTITION BY user_id, day ORDER BY s, e), p AS (PARTITION BY user_id, day ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(n) OVER (PARTITION BY user_id, day ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM f)
SELECT user_id, day, min(s) AS s, max(e) AS e FROM g GROUP BY user_id, day, g"""


@query("touch_merge", _merge_sql("lag(e) OVER w = s"))
def touch_merge(spark, sf):
    return I.merge_intervals(spans(spark, sf), ["user_id", "day"], "s", "e", "touch")


@query("overlap_merge", _merge_sql("max(e) OVER p >= s"))
def overlap_merge(spark, sf):
    return I.merge_intervals(spans(spark, sf), ["user_id", "day"], "s", "e")


@query("active_next_window", f"""WITH {HOURS} SELECT user_id, day, CAST(sum(end_min - start_min) AS BIGINT) AS total_min, bool_or(start_min <= 750 AND end_min > 750) AS active,
max(CASE WHEN start_min <= 750 AND end_min > 750 THEN end_min - 750 END) AS left_min, min(CASE WHEN start_min > 750 THEN start_min END) AS next_start FROM wins GROUP BY user_id, day""")
def active_next_window(spark, sf):
    return I.active_next(I.merge_hours(marks(spark, sf), ["user_id", "day"]), ["user_id", "day"], 750)


@query("row_windows", f"""WITH {HOURS} SELECT user_id, day, CAST(count(*) AS INTEGER) AS n_windows, CAST(sum(end_min - start_min) AS BIGINT) AS total_min FROM wins GROUP BY user_id, day""")
def row_windows(spark, sf):
    m = marks(spark, sf).groupBy("user_id", "day").agg(F.collect_list(F.struct((F.col("hour") * 60).alias("start_min"), (F.col("hour") * 60 + 60).alias("end_min"))).alias("w"))
    merged = m.withColumn("w", T.merge_windows(F.col("w")))
    total = F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + (x["end_min"] - x["start_min"]))
    return merged.select("user_id", "day", F.size("w").alias("n_windows"), total.alias("total_min"))


@query("weekday_fallback", """WITH r AS (SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 AND user_id % 3 <> 0 THEN NULL ELSE CAST(user_id % 7 AS INTEGER) END AS weekday FROM events),
p AS (SELECT *, CASE WHEN weekday = 2 THEN 0 WHEN weekday IS NULL THEN 1 ELSE 2 END AS p FROM r), b AS (SELECT *, min(p) OVER (PARTITION BY user_id) AS b FROM p)
SELECT event_id, user_id, weekday, CASE p WHEN 0 THEN 'today' WHEN 1 THEN 'undated' ELSE 'other' END AS match FROM b WHERE p = b""")
def weekday_fallback(spark, sf):
    undated = (F.col("event_id") % 7 == 0) & (F.col("user_id") % 3 != 0)
    r = table(spark, sf, "events").select("event_id", "user_id", F.when(~undated, (F.col("user_id") % 7).cast("int")).alias("weekday"))
    return I.weekday_fallback(r, ["user_id"], 2)


ZONE = f"""{HOURS}, loads AS (SELECT user_id, day, start_min, end_min, user_id % 26 AS zone, CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 11 = 0 THEN 0.0::DOUBLE ELSE (user_id % 40)::DOUBLE / 8 END AS load_mw FROM wins),
live AS (SELECT *, start_min <= 750 AND end_min > 750 AS on_now FROM loads)"""


def claims_now(spark, sf):
    w = I.merge_hours(marks(spark, sf), ["user_id", "day"])
    u = F.col("user_id")
    load = F.when(u % 7 == 0, F.lit(None).cast("double")).when(u % 11 == 0, F.lit(0.0)).otherwise((u % 40).cast("double") / 8)
    return w.select("user_id", "day", (u % 26).alias("zone"), load.alias("load_mw"), ((F.col("start_min") <= 750) & (F.col("end_min") > 750)).alias("on_now"))


def or_default(load, default: float = 0.5):
    """A missing or zero load counts as the default."""
    return F.when(load.isNull() | (load == 0), F.lit(default)).otherwise(load)


@query("zone_loads", f"""WITH {ZONE}, zones AS (SELECT CAST(unnest(range(30)) AS BIGINT) AS zone),
agg AS (SELECT day, zone, round(sum(CASE WHEN load_mw IS NULL OR load_mw = 0 THEN 0.5 ELSE load_mw END), 4) AS mw, count(*) AS claims FROM live WHERE on_now GROUP BY day, zone)
SELECT z.zone, coalesce(a.mw, 0) AS mw, a.day, coalesce(a.claims, 0) AS claims, a.zone IS NOT NULL AS shedding FROM zones z LEFT JOIN agg a ON a.zone = z.zone""")
def zone_loads(spark, sf):
    agg = claims_now(spark, sf).where("on_now").groupBy("day", "zone").agg(F.round(F.sum(or_default(F.col("load_mw"))), 4).alias("mw"), F.count("*").alias("claims"))
    zones = spark.range(30).withColumnRenamed("id", "zone")
    # Zones without claims keep the defaults; 30 rows, broadcast by size.
    out = F.broadcast(zones).join(agg.withColumnRenamed("zone", "z"), F.col("zone") == F.col("z"), "left")
    return out.select("zone", F.coalesce("mw", F.lit(0.0)).alias("mw"), "day", F.coalesce("claims", F.lit(0).cast("long")).alias("claims"), F.col("z").isNotNull().alias("shedding"))


@query("off_totals", f"WITH {ZONE} SELECT day, count(*) FILTER (WHERE on_now) AS off_now, count(*) AS windows, round(sum(CASE WHEN on_now THEN CASE WHEN load_mw IS NULL OR load_mw = 0 THEN 0.5 ELSE load_mw END ELSE 0 END), 4) AS mw FROM live GROUP BY day")
def off_totals(spark, sf):
    load = F.when(F.col("on_now"), or_default(F.col("load_mw"))).otherwise(F.lit(0.0))
    return claims_now(spark, sf).groupBy("day").agg(F.count_if("on_now").alias("off_now"), F.count("*").alias("windows"), F.round(F.sum(load), 4).alias("mw"))


@query("gap_clusters", """WITH o AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS o FROM events), f AS (SELECT *, CASE WHEN o - lag(o) OVER (PARTITION BY user_id ORDER BY o) <= 1800 THEN 0 ELSE 1 END AS n FROM o),
c AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY o RANGE UNBOUNDED PRECEDING) AS c FROM f) SELECT user_id, CAST(c AS INTEGER) AS cluster, count(*) AS n, CAST(floor(avg(o)) AS BIGINT) AS centre FROM c GROUP BY user_id, c""")
def gap_clusters(spark, sf):
    ev = table(spark, sf, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("o"))
    return I.gap_clusters(ev, ["user_id"], F.col("o"), 1800).groupBy("user_id", "cluster").agg(F.count("*").alias("n"), F.floor(F.avg("o")).alias("centre"))


@query("topk_margin", """WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER w AS INTEGER) AS rank, o_totalprice - coalesce(lead(o_totalprice) OVER w, 0.0) AS m FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)) SELECT o_custkey, o_orderkey, rank, round(m, 4) AS margin FROM r WHERE rank <= 3""")
def topk_margin(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return I.with_margin(o, ["o_custkey"], "o_totalprice", 3, "o_orderkey").select("o_custkey", "o_orderkey", "rank", F.round("margin", 4).alias("margin"))


@query("latest_version", "SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey")
def latest_version(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"), F.max("o_orderdate").alias("o_orderdate"))


@query("retain_7", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 7")
def retain_7(spark, sf):
    return I.newest(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], 7, F.desc("o_orderdate"), F.col("o_orderkey")).drop("o_orderdate")


@query("running_delta", """WITH d AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS o FROM events), e AS (SELECT *, o - coalesce(lag(o) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS delta FROM d)
SELECT user_id, event_id, delta, CAST(sum(delta) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS value FROM e""")
def running_delta(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("o"))
    return I.undelta(I.delta(ev, ["user_id"], "event_id", "o"), ["user_id"], "event_id").drop("o")


@query("header_run", f"""WITH {MARKS}, i AS (SELECT *, hour - row_number() OVER (PARTITION BY user_id, day ORDER BY hour) AS i FROM marks), r AS (SELECT user_id, day, min(hour) AS first, count(*) AS n FROM i GROUP BY user_id, day, i)
SELECT user_id, day, min(first) AS first_hour, max(n) AS run FROM r WHERE n >= 2 GROUP BY user_id, day""")
def header_run(spark, sf):
    runs = I.merge_hours(marks(spark, sf), ["user_id", "day"]).withColumn("n", ((F.col("end_min") - F.col("start_min")) / 60).cast("long")).where("n >= 2")
    return runs.groupBy("user_id", "day").agg((F.min("start_min") / 60).cast("int").alias("first_hour"), F.max("n").alias("run"))


@query("forward_frame", """WITH h AS (SELECT CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT day, median(n) AS typical FROM h GROUP BY day),
f AS (SELECT day, hour, bool_and(abs(n - typical) <= typical / 2) OVER w AS steady, count(*) OVER w AS k FROM h JOIN m USING (day) WINDOW w AS (PARTITION BY day ORDER BY hour ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))
SELECT day, min(hour) AS first_hour FROM f WHERE steady AND k = 3 GROUP BY day""")
def forward_frame(spark, sf):
    h = marks(spark, sf).groupBy("day", "hour").agg(F.count("*").alias("n"))
    typical = h.groupBy("day").agg(F.median("n").alias("typical"))
    w = Window.partitionBy("day").orderBy("hour").rowsBetween(1, 3)
    steady = h.join(typical, "day").select("day", "hour", F.bool_and(F.abs(F.col("n") - F.col("typical")) <= F.col("typical") / 2).over(w).alias("steady"), F.count("*").over(w).alias("k"))
    return steady.where("steady and k = 3").groupBy("day").agg(F.min("hour").alias("first_hour"))


@query("clock_parts", """WITH l AS (SELECT event_id, ts + INTERVAL 6 HOUR AS t FROM events) SELECT event_id, CAST(t AS DATE) AS local_date, strftime(t, '%H:%M') AS hhmm, CAST(hour(t) * 60 + minute(t) AS INTEGER) AS minutes, CAST(dayofweek(t) AS INTEGER) AS weekday FROM l""")
def clock_parts(spark, sf):
    t = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Dhaka")
    return table(spark, sf, "events").select("event_id", F.to_date(t).alias("local_date"), F.date_format(t, "HH:mm").alias("hhmm"), T.local_minutes(F.col("ts").cast("timestamp")).alias("minutes"), T.weekday_index(t).alias("weekday"))


CLOCK_TEXT = "CASE event_id % 6 WHEN 0 THEN format('{:02d}:{:02d}', event_id % 26, event_id % 61) WHEN 1 THEN format('{:d}:{:02d}', event_id % 24, event_id % 60) WHEN 2 THEN '24:00' WHEN 3 THEN '24:30' WHEN 4 THEN 'aa:10' ELSE format('{:02d}:{:02d}', event_id % 24, event_id % 60) END"


def clock_text():
    k = F.col("event_id")
    two = lambda a, b: F.format_string("%02d:%02d", k % a, k % b)
    return F.when(k % 6 == 0, two(26, 61)).when(k % 6 == 1, F.format_string("%d:%02d", k % 24, k % 60)).when(k % 6 == 2, "24:00").when(k % 6 == 3, "24:30").when(k % 6 == 4, "aa:10").otherwise(two(24, 60))


def _parse_sql(col: str, digits: str) -> str:
    h, m = (f"TRY_CAST(regexp_extract({col}, '^([0-9]{digits}):([0-9]{{2}})$', {k}) AS INTEGER)" for k in (1, 2))
    return f"CASE WHEN {m} <= 59 AND ({h} <= 23 OR ({h} = 24 AND {m} = 0)) THEN {h} * 60 + {m} END"


@query("minutes_codec", f"""WITH t AS (SELECT event_id, {CLOCK_TEXT} AS t FROM events), p AS (SELECT *, {_parse_sql('t', '{2}')} AS strict, {_parse_sql('t', '{1,2}')} AS lenient FROM t)
SELECT event_id, t, strict, lenient, format('{{:02d}}:{{:02d}}', lenient // 60, lenient % 60) AS back, format('{{:02d}}:{{:02d}}', (lenient % 1440) // 60, lenient % 60) AS wrapped FROM p""")
def minutes_codec(spark, sf):
    t = table(spark, sf, "events").select("event_id", clock_text().alias("t"))
    p = t.withColumns({"strict": T.hhmm_strict(F.col("t")), "lenient": T.hhmm_lenient(F.col("t"))})
    some = F.col("lenient").isNotNull()
    return p.withColumns({"back": F.when(some, T.format_minutes(F.col("lenient"))), "wrapped": F.when(some, T.wrap_minutes(F.col("lenient")))})


@query("fmt_window", f"""WITH {HOURS}, f AS (SELECT *, start_min % 1440 AS a, end_min % 1440 AS b, end_min - start_min AS d FROM wins)
SELECT user_id, day, start_min, format('{{:d}}:{{:02d}} {{}}', CASE WHEN (a // 60) % 12 = 0 THEN 12 ELSE (a // 60) % 12 END, a % 60, CASE WHEN a < 720 THEN 'AM' ELSE 'PM' END) AS from_text,
format('{{:d}}:{{:02d}} {{}}', CASE WHEN (b // 60) % 12 = 0 THEN 12 ELSE (b // 60) % 12 END, b % 60, CASE WHEN b < 720 THEN 'AM' ELSE 'PM' END) AS to_text,
CASE WHEN d < 60 THEN format('{{:d}} min', d) WHEN d % 60 = 0 THEN format('{{:d}} h', d // 60) ELSE format('{{:d}} h {{:d}} min', d // 60, d % 60) END AS lasts FROM f""")
def fmt_window(spark, sf):
    w = I.merge_hours(marks(spark, sf), ["user_id", "day"])
    return w.select("user_id", "day", "start_min", T.twelve_hour(F.col("start_min")).alias("from_text"), T.twelve_hour(F.col("end_min")).alias("to_text"), T.duration_text(F.col("end_min") - F.col("start_min")).alias("lasts"))


@query("tz_shift", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS utc_text, strftime(ts - INTERVAL 6 HOUR, '%Y%m%dT%H%M%SZ') AS calendar_text, CAST(floor(epoch(ts)) AS BIGINT) AS parsed FROM events""")
def tz_shift(spark, sf):
    ts = F.col("ts").cast("timestamp")
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf, "events").select("event_id", text.alias("utc_text"), F.date_format(F.to_utc_timestamp(ts, "Asia/Dhaka"), "yyyyMMdd'T'HHmmss'Z'").alias("calendar_text"), F.unix_seconds(F.to_timestamp(text, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("parsed"))


@query("freshness", """WITH a AS (SELECT user_id, epoch(TIMESTAMP '2024-01-31 12:00:00') - floor(epoch(max(ts))) AS s FROM events GROUP BY user_id), b AS (SELECT user_id, CASE WHEN user_id % 13 = 0 THEN NULL ELSE round(s / 3600.0, 4) + (user_id % 5) * 30 END AS age_hours FROM a)
SELECT user_id, age_hours, CASE WHEN age_hours IS NULL THEN 'unknown' WHEN age_hours > 144 THEN 'very-stale' WHEN age_hours > 36 THEN 'stale' ELSE 'fresh' END AS state FROM b""")
def freshness(spark, sf):
    age = (F.unix_seconds(F.lit("2024-01-31 12:00:00").cast("timestamp")) - F.unix_seconds(F.max("ts").cast("timestamp"))) / 3600.0
    a = table(spark, sf, "events").groupBy("user_id").agg(F.round(age, 4).alias("h"))
    a = a.select("user_id", F.when(F.col("user_id") % 13 != 0, F.col("h") + (F.col("user_id") % 5) * 30).alias("age_hours"))
    return a.withColumn("state", T.freshness(F.col("age_hours")))


@query("malformed_windows", f"""WITH t AS (SELECT event_id, user_id, {CLOCK_TEXT} AS t FROM events), p AS (SELECT user_id, {_parse_sql('t', '{2}')} AS s, CAST(CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1440 END AS INTEGER) AS e, event_id % 9 = 0 AS none FROM t)
SELECT user_id, count(*) FILTER (WHERE NOT none AND (s IS NULL OR e <= s)) AS malformed, count(*) FILTER (WHERE none) AS windowless FROM p GROUP BY user_id""")
def malformed_windows(spark, sf):
    t = table(spark, sf, "events").select("event_id", "user_id", clock_text().alias("t"))
    s, e, none = T.hhmm_strict(F.col("t")), F.when(F.col("event_id") % 4 == 0, 0).otherwise(1440), F.col("event_id") % 9 == 0
    return t.groupBy("user_id").agg(F.count_if(~none & (s.isNull() | (e <= s))).alias("malformed"), F.count_if(none).alias("windowless"))


@query("hour_tokens", """WITH t AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'blank' ELSE format('{:02d}-{:02d}', event_id % 24, (event_id + 1) % 24) END AS token FROM events),
p AS (SELECT *, TRY_CAST(regexp_extract(token, '^([0-9]{1,2})-([0-9]{1,2})$', 1) AS INTEGER) AS h_start, TRY_CAST(regexp_extract(token, '^([0-9]{1,2})-([0-9]{1,2})$', 2) AS INTEGER) AS e FROM t)
SELECT event_id, token, h_start, CASE WHEN e = 0 THEN 24 ELSE e END AS h_end FROM p""")
def hour_tokens(spark, sf):
    k = F.col("event_id")
    t = table(spark, sf, "events").select("event_id", F.when(k % 5 == 0, "blank").otherwise(F.format_string("%02d-%02d", k % 24, (k + 1) % 24)).alias("token"))
    s, e = T.hour_token(F.col("token"))
    return t.withColumns({"h_start": s, "h_end": e})


@query("weekday_word", """WITH w AS (SELECT doc_id, lang, source, ['Sunday', 'MONDAY', ' tuesday ', 'Wednesday', 'thursday', 'Friday', 'saturday', 'holiday'][CAST(doc_id % 8 AS INTEGER) + 1] AS word FROM documents)
SELECT doc_id, word, CASE WHEN list_position(['sunday', 'monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday'], lower(trim(word))) > 0 THEN CAST(list_position(['sunday', 'monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday'], lower(trim(word))) - 1 AS INTEGER) END AS weekday FROM w""")
def weekday_word(spark, sf):
    words = F.array(*[F.lit(w) for w in ("Sunday", "MONDAY", " tuesday ", "Wednesday", "thursday", "Friday", "saturday", "holiday")])
    d = table(spark, sf, "documents").select("doc_id", F.element_at(words, (F.col("doc_id") % 8 + 1).cast("int")).alias("word"))
    return d.withColumn("weekday", T.weekday_of_word(F.col("word")))


@query("priority_choice", """SELECT o_custkey, min_by(o_orderkey, (CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey)) AS chosen, count(*) AS candidates FROM orders GROUP BY o_custkey""")
def priority_choice(spark, sf):
    prio = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(prio, F.col("o_orderkey"))).alias("chosen"), F.count("*").alias("candidates"))
