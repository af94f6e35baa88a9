"""Queries over sources, sinks and streams. They write to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewarden.functions.scores import first_of
from tracewarden.operators import bayes
from tracewarden.operators.chains import CHAIN_PHASES
from tracewarden.operators.joins import range_lookup
from tracewarden.operators.timeline import micros
from tracewarden.plans.chains import CHAIN_OF, ORDERED, PREV10, _wmean, case, mapped
from tracewarden.plans.knowledge import DAYS, GEO_SQL, as_of, ranges
from tracewarden.plans.registry import EVENTS_SQL, events, query, table
from tracewarden.plans.windows import frame, hours
from tracewarden.session import new_path
from tracewarden.sources import files, logs
from tracewarden.sources.state import VersionedTable
from tracewarden.streaming import runner, trackers
from tracewarden.streaming import windows as sw



# ---- sources and sinks ---------------------------------------------------------------------

@query("s1_block_log", f"""
WITH {EVENTS_SQL} SELECT epoch_us(date_trunc('second', ts)) AS us, 'u' || user_id AS ip, '/' || event_type AS uri, 'hit ' || k AS msg
FROM ev WHERE {DAYS} AND event_type <> 'view' AND event_type <> 'click'""")
def _(spark, d):
    # Clicks have a bar in the URI and views no message: neither is a block line.
    t = F.col("event_type")
    path = new_path(spark, "blocks")
    logs.write_block_log(events(spark, d), path, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), F.concat(F.lit("u"), F.col("user_id").cast("string")),
                         F.concat(F.lit("/"), t, F.when(t == "click", "|x").otherwise("")), F.when(t == "view", "").otherwise(F.concat(F.lit("hit "), F.col("k").cast("string"))))
    r = logs.read_block_log(spark, path, as_of())
    return r.select(micros(F.col("ts")).alias("us"), "ip", "uri", "msg")


@query("s2_request_scan", f"WITH {EVENTS_SQL} SELECT event_id AS request_id, us, 'u' || user_id AS ip, '/' || event_type AS uri, 'k' AS name, CAST(k AS VARCHAR) AS value FROM ev")
def _(spark, d):
    path = new_path(spark, "requests")
    e = events(spark, d)
    e.select(F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("ip"),
             F.lit("GET").alias("method"), F.concat(F.lit("/"), "event_type").alias("uri"),
             F.array(F.struct(F.lit("query").alias("position"), F.lit("k").alias("name"), F.col("k").cast("string").alias("value"))).alias("params")) \
        .write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    r = logs.read_requests(spark, path)
    return r.select("request_id", micros(F.col("ts")).alias("us"), "ip", "uri", F.explode("params").alias("p")).select("request_id", "us", "ip", "uri", "p.name", "p.value")


@query("s3_pair_lines", f"WITH {EVENTS_SQL} SELECT 'u' || user_id AS ip, us // 1000000 AS expire FROM ev WHERE event_type IN ('error', 'view', 'signup')")
def _(spark, d):
    path = new_path(spark, "bans")
    t = F.col("event_type")
    ip = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    expire = F.floor(F.col("us") / 1_000_000).cast("string")
    events(spark, d).select(first_of([(t == "click", ip), (t == "purchase", F.concat(ip, F.lit("|soon")))], F.concat_ws("|", ip, expire)).alias("value")).write.text(path)
    return logs.read_pairs(spark, path)


@query("s4_state_map", f"WITH {EVENTS_SQL} SELECT md5(event_type || '/' || k) AS id, '/' || event_type || '/' || k AS path, count(*) AS count, max(us) AS last_seen FROM ev GROUP BY event_type, k")
def _(spark, d):
    path = new_path(spark, "state")
    name = F.concat_ws("/", "event_type", F.col("k").cast("string"))
    g = events(spark, d).groupBy("event_type", "k").agg(F.count("*").alias("count"), F.max("us").alias("last_seen"))
    g.select(F.create_map(F.md5(name), F.struct(F.concat(F.lit("/"), name).alias("path"), "count", "last_seen")).alias("patterns")).write.json(path)
    return logs.read_state_map(spark, path, "patterns", "struct<path:string,count:bigint,last_seen:bigint>")


@query("s5_file_inventory", """
SELECT page_id % 5 AS folder, sum(strlen(html) + 1)::BIGINT AS bytes FROM pages WHERE page_id % 5 <> 4 GROUP BY 1""")
def _(spark, d):
    path = new_path(spark, "tree")
    table(spark, d, "pages").select(F.col("html").alias("value"), (F.col("page_id") % 5).alias("folder")).write.partitionBy("folder").text(path)
    inv = files.inventory(spark, path, "*.txt", excluded=["folder=4"])
    return inv.groupBy(F.regexp_extract("path", r"folder=(\d+)", 1).cast("bigint").alias("folder")).agg(F.sum("size").alias("bytes"))


@query("s6_daily_append", f"WITH {EVENTS_SQL} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS dt, event_id FROM ev")
def _(spark, d):
    path = new_path(spark, "verdicts")
    e = events(spark, d).select("event_id", "value", F.date_format("ts", "yyyy-MM-dd").alias("dt"))
    for part in (e.filter("value >= 90"), e.filter("value < 90 OR value IS NULL")):
        logs.append_daily(part.select("event_id", "dt"), path)
    return spark.read.schema("event_id bigint, dt string").parquet(path)


@query("s7_state_upsert", f"""
WITH {EVENTS_SQL}, o AS (SELECT user_id, max(us) AS last, count(*) AS n FROM ev WHERE value < 100 GROUP BY 1), w AS (SELECT user_id, max(us) AS last, count(*) AS n FROM ev WHERE value >= 100 GROUP BY 1)
SELECT * FROM w UNION ALL SELECT * FROM o WHERE user_id NOT IN (SELECT user_id FROM w)""")
def _(spark, d):
    e = events(spark, d)
    old, new = (e.filter(c).groupBy("user_id").agg(F.max("us").alias("last"), F.count("*").alias("n")) for c in ("value < 100", "value >= 100"))
    t = VersionedTable(spark, new_path(spark, "clients"), old.schema)
    return t.write(logs.upserted(t.write(old, 0), new, ["user_id"]), 1)


@query("s9_alerts", f"WITH {EVENTS_SQL} SELECT event_id, 'client ' || user_id || ' ' || event_type || ' over limit' AS message FROM ev WHERE value >= 200")
def _(spark, d):
    path = new_path(spark, "alerts")
    msg = F.concat(F.lit("client "), F.col("user_id").cast("string"), F.lit(" "), "event_type", F.lit(" over limit"))
    logs.write_alerts(logs.alerts(events(spark, d), "value", 200, msg).select("event_id", "message"), path)
    return spark.read.parquet(path)


# ---- streams -------------------------------------------------------------------------------

def arriving(spark, d, name):
    """A given table as a stream, whether it is one file or a folder of files."""
    return runner.file_stream(spark, f"{d}/{name}.parquet", table(spark, d, name).schema, "*")


def stream(spark, d):
    """The events as a stream with a proper event time."""
    s = arriving(spark, d, "events")
    return s.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("us", micros(F.col("ts"))).withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


CUTS = ["us < 1704931200000000", "us >= 1704931200000000 and us < 1705795200000000", "us >= 1705795200000000"]


def replayed(spark, d, cuts=CUTS, cols=("event_id", "ts", "us", "user_id", "event_type", "value", "k"), shape=lambda e: e):
    """The events cut by time, one arrival after the other."""
    e = shape(events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).select(*cols))
    return runner.Arrivals([e.filter(cut) for cut in cuts])


DELAY_US = hours(1)
CLOSED = f"<= (SELECT max(us) FROM ev) - {DELAY_US}"


@query("r1_tumbling_counts", f"""
WITH {EVENTS_SQL}, g AS (SELECT us // {hours(24)} * {hours(24)} AS start_us, user_id, count(*) AS n FROM ev GROUP BY 1, 2) SELECT * FROM g WHERE n > 3 AND start_us + {hours(24)} {CLOSED}""")
def _(spark, d):
    return runner.run_to_table(sw.tumbling_counts(stream(spark, d), "ts", ["user_id"], "24 hours", "1 hour", 3), "r1")[0]


@query("r2_sliding_counts", f"""
WITH {EVENTS_SQL}, w AS (SELECT (us // {hours(6)} - i) * {hours(6)} AS start_us, user_id FROM ev, (SELECT unnest([0, 1, 2, 3]) AS i)),
g AS (SELECT start_us, user_id, count(*) AS n FROM w GROUP BY 1, 2) SELECT * FROM g WHERE start_us + {hours(24)} {CLOSED}""")
def _(spark, d):
    return runner.run_to_table(sw.sliding_counts(stream(spark, d), "ts", ["user_id"], "24 hours", "6 hours", "1 hour"), "r2")[0]


@query("r3_minute_rates", f"""
WITH {EVENTS_SQL}, g AS (SELECT us // 60000000 * 60000000 AS start_us, event_type, count(*) AS n FROM ev GROUP BY 1, 2) SELECT * FROM g WHERE start_us + 60000000 {CLOSED}""")
def _(spark, d):
    return runner.run_to_table(sw.tumbling_counts(stream(spark, d), "ts", ["event_type"], "1 minute", "1 hour"), "r3")[0]


@query("r4_sessions", f"""
WITH {EVENTS_SQL}, b AS (SELECT user_id, us, CASE WHEN us - lag(us) {ORDERED} < {hours(8)} THEN 0 ELSE 1 END AS brk FROM ev),
s AS (SELECT user_id, us, sum(brk) OVER (PARTITION BY user_id ORDER BY us) AS s FROM b), g AS (SELECT user_id, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM s GROUP BY user_id, s)
SELECT * FROM g WHERE last_us + {hours(8)} {CLOSED}""")
def _(spark, d):
    return runner.run_to_table(sw.session_counts(stream(spark, d), "ts", ["user_id"], "8 hours", "1 hour"), "r4")[0]


@query("r5_replay_dedupe", f"WITH {EVENTS_SQL} SELECT DISTINCT user_id, event_type, k, us // {hours(24)} AS day FROM ev")
def _(spark, d):
    s = sw.deduplicated(stream(spark, d), "ts", ["user_id", "event_type", "k"], "24 hours", "1 hour")
    return runner.run_to_table(s.select("user_id", "event_type", "k", F.floor(F.col("us") / hours(24)).alias("day")), "r5")[0]


@query("r5_duplicate_counts", f"""
WITH {EVENTS_SQL}, o AS (SELECT us // {hours(24)} * {hours(24)} AS start_us, user_id, event_type, count(*) AS n FROM ev GROUP BY ALL),
g AS (SELECT start_us, sum(n)::BIGINT AS n, count(*) AS signatures, (sum(n) - count(*))::BIGINT AS duplicates FROM o GROUP BY 1) SELECT * FROM g WHERE start_us + {hours(24)} {CLOSED}""")
def _(spark, d):
    return runner.run_to_table(sw.duplicate_counts(stream(spark, d), "ts", ["user_id", "event_type"], "24 hours", "1 hour"), "r5d")[0]


@query("r6_chain_tracker", f"""
WITH {EVENTS_SQL}, p AS (SELECT *, {case({k: CHAIN_PHASES.index(v) for k, v in CHAIN_OF.items()})} AS i,
  CASE WHEN us - lag(us) {ORDERED} <= {hours(24)} THEN 0 ELSE 1 END AS brk FROM ev WHERE us {CLOSED}),
s AS (SELECT *, sum(brk) {ORDERED} AS s FROM p),
w AS (SELECT event_id, i, lag(i) OVER w AS pi, max(i) OVER w AS furthest FROM s WINDOW w AS (PARTITION BY user_id, s ORDER BY us, event_id))
SELECT event_id, furthest, CAST(round((furthest + 1) / 7.0 * 100) AS BIGINT) AS progress FROM w WHERE pi IS NULL OR pi <> i""")
def _(spark, d):
    idle = hours(24)
    step = trackers.chain_tracker("user_id", "us", "event_id", "phase", idle=idle)
    s = replayed(spark, d, shape=lambda e: mapped(e, CHAIN_OF))
    r = runner.run_keyed(s, "r6", step, "user_id bigint, us bigint, event_id bigint, phase string, furthest int", ["user_id"], time="us", delay=DELAY_US, expire=F.col("us") + idle, slack=idle)
    return r.rows.select("event_id", "furthest", "progress")


@query("r7_baseline_tracker", f"""
WITH {EVENTS_SQL}, b AS (SELECT event_id, list(value) {PREV10} AS v FROM ev), c AS (SELECT a.event_id, coalesce(sum(b.value * 0.15 * pow(2, (b.us - a.us) / {hours(48)}.0)), 0) AS acc
  FROM ev a LEFT JOIN ev b ON a.user_id = b.user_id AND b.us >= a.us - {hours(144)} AND b.us < a.us AND b.value >= 20 GROUP BY 1)
SELECT event_id, round({_wmean('v')}, 7) AS base_value, round(acc, 3) AS accumulated FROM b JOIN c USING (event_id)""")
def _(spark, d):
    step = trackers.baseline_tracker("user_id", "us", "event_id", "value", F.col("value") >= 20, hours(144), hours(48))
    r = runner.run_keyed(replayed(spark, d), "r7", step, "user_id bigint, us bigint, event_id bigint, value double", ["user_id"], time="us", delay=DELAY_US, expire=F.col("us") + hours(24 * 60), finish=True)
    return r.rows.select("event_id", F.round("base_value", 7).alias("base_value"), (F.round("accumulated", 3) + 0.0).alias("accumulated"))


@query("r8_ban_tracker", f"""
WITH RECURSIVE {EVENTS_SQL}, o AS (SELECT event_id, user_id, us, row_number() {ORDERED} AS i FROM ev WHERE event_type = 'error'
  AND us <= (SELECT max(us) FROM ev WHERE event_type = 'error') - {DELAY_US}),
r AS (
  SELECT user_id, event_id, i, 1::BIGINT AS offence, [us + {hours(48)}] AS ends FROM o WHERE i = 1
  UNION ALL
  SELECT user_id, event_id, i, offence, list_append(live, CASE offence WHEN 1 THEN us + {hours(48)} WHEN 2 THEN us + {hours(192)} WHEN 3 THEN us + {hours(744)} ELSE 4611686018427387904 END)
  FROM (SELECT o.*, list_filter(r.ends, lambda e: e >= o.us) AS live, (len(list_filter(r.ends, lambda e: e >= o.us)) + 1)::BIGINT AS offence FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1))
SELECT event_id, offence, CAST(CASE offence WHEN 1 THEN 86400 WHEN 2 THEN 604800 WHEN 3 THEN 2592000 ELSE 0 END AS BIGINT) AS ban_s FROM r""")
def _(spark, d):
    s = replayed(spark, d, shape=lambda e: e.filter(F.col("event_type") == "error"))
    r = runner.run_keyed(s, "r8", trackers.ban_tracker("user_id", "us", "event_id"), "user_id bigint, ends array<bigint>, lasting bigint", ["user_id"], time="us", delay=DELAY_US, expire=trackers.ban_end(), slack=hours(24))
    return r.rows.select("event_id", "offence", "ban_s")


@query("r9_race_tracker", f"""
WITH {EVENTS_SQL} SELECT event_id, count(*) {frame('user_id, event_type', hours(48), True)} - 1 AS same_url, count(*) {frame('user_id, event_type', hours(12), True)} - 1 AS same_url_burst FROM ev""")
def _(spark, d):
    t = F.col("event_type")
    step = trackers.race_tracker("user_id", "us", "event_id", "event_type", "k", t.isin("purchase", "signup"), t == "purchase", hours(48), hours(12), hours(120))
    r = runner.run_keyed(replayed(spark, d), "r9", step, "user_id bigint, us bigint, event_id bigint, event_type string, k bigint", ["user_id"], time="us", delay=DELAY_US, expire=F.col("us") + hours(120), slack=hours(120), finish=True)
    return r.rows.select("event_id", "same_url", "same_url_burst")


FROZEN = [(0, False), (1704672000000000, True), (1705276800000000, False)]


@query("r10_path_learner", f"""
WITH {EVENTS_SQL} SELECT '/' || event_type || '/' || k AS path, count(*) AS seen, min(us) AS first_seen, max(us) AS last_seen FROM ev
WHERE us < {FROZEN[1][0]} OR us >= {FROZEN[2][0]} GROUP BY 1""")
def _(spark, d):
    s = replayed(spark, d, shape=lambda e: e.withColumn("path", F.concat(F.lit("/"), "event_type", F.lit("/"), F.col("k").cast("string"))))
    control = spark.createDataFrame(FROZEN, "since bigint, frozen boolean")
    return runner.run_keyed(s, "r10", trackers.path_learner("path", "us", control), "path string, seen bigint, first_seen bigint, last_seen bigint", ["path"]).state


@query("r10_token_learner", f"""
WITH x AS (SELECT role, lower(trim(text)) AS t FROM conversations),
g AS (SELECT role, unnest(list_transform(range(1, length(t)), lambda i: substr(t, i, 2)) || list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS token FROM x WHERE length(t) >= 4)
SELECT role AS class, token, count(*) AS n FROM g GROUP BY 1, 2""")
def _(spark, d):
    s = arriving(spark, d, "conversations")
    counts = lambda batch: bayes.train(batch, "text", "role")[1]
    return runner.run_keyed(s, "r10t", trackers.token_learner(), "class string, token string, n bigint", ["class", "token"], prepare=counts).state


@query("r11_enrichment", f"""
WITH {EVENTS_SQL}, {GEO_SQL} SELECT event_id, country, CASE event_type WHEN 'error' THEN 90 WHEN 'purchase' THEN 40 END AS severity FROM ev LEFT JOIN g ON user_id = c_custkey WHERE event_type <> 'view'""")
def _(spark, d):
    severity = spark.createDataFrame([("error", 90), ("purchase", 40)], "event_type string, severity int")
    allowed = spark.createDataFrame([("view",)], "event_type string")
    s = sw.enriched(stream(spark, d).select("event_id", "user_id", "event_type"), F.broadcast(severity), "event_type", F.broadcast(allowed))
    geo = ranges(spark, d)

    def step(batch, state, context):
        return range_lookup(batch, "user_id", geo, 64), state

    r = runner.run_keyed(s, "r11", step, "event_id bigint", ["event_id"])
    return r.rows.select("event_id", F.col("value").alias("country"), "severity")


@query("r12_file_changes", f"""
WITH {EVENTS_SQL}, f AS (SELECT CASE WHEN us < 1704931200000000 THEN 0 WHEN us < 1705795200000000 THEN 1 ELSE 2 END AS b, user_id, arg_max(k, us) AS v FROM ev GROUP BY 1, 2),
h AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY b) AS p FROM f)
SELECT user_id, count(*) FILTER (WHERE p IS NULL) AS added, count(*) FILTER (WHERE p <> v) AS changed, count(*) FILTER (WHERE p = v) AS same FROM h GROUP BY 1""")
def _(spark, d):
    e = events(spark, d)
    inv = [e.filter(cut).select("user_id", "us", F.md5(F.col("k").cast("string")).alias("md5")) for cut in CUTS]
    r = runner.run_keyed(runner.Arrivals(inv), "r12", trackers.change_tracker("user_id", "md5", "us"), inv[0].schema, ["user_id"], buckets=256)
    return r.rows.groupBy("user_id").agg(*[F.count_if(F.col("status") == x).alias(x) for x in ("added", "changed", "same")])


# The newest rows come first, so that of what follows all lies behind the clock.
NEWEST_FIRST = [f"{CUTS[2]} and us < 1706227200000000", "us >= 1706227200000000", CUTS[0], CUTS[1]]


@query("r13_late_rows", f"""
WITH {EVENTS_SQL}, c AS (SELECT us, CASE WHEN {CUTS[2]} AND us < 1706227200000000 THEN 0 WHEN us >= 1706227200000000 THEN 1 WHEN {CUTS[0]} THEN 2 ELSE 3 END::BIGINT AS batch FROM ev),
m AS (SELECT batch, max(us) - {DELAY_US} AS top FROM c GROUP BY 1),
b AS (SELECT a.batch, max(m.top) AS top FROM (SELECT DISTINCT batch FROM c) a LEFT JOIN m ON m.batch < a.batch GROUP BY 1)
SELECT c.batch, count(*) FILTER (WHERE c.us <= b.top) AS late FROM c JOIN b USING (batch) GROUP BY 1""")
def _(spark, d):
    step = trackers.race_tracker("user_id", "us", "event_id", "event_type", "k", F.col("k") > 0, F.col("k") > 5, hours(1), hours(1), hours(1))
    s = replayed(spark, d, NEWEST_FIRST)
    return runner.run_keyed(s, "r13", step, "user_id bigint, us bigint, event_id bigint, event_type string, k bigint", ["user_id"], time="us", delay=DELAY_US, expire=F.col("us") + hours(1)).late


@query("r13_counts_without_late", f"""
WITH {EVENTS_SQL}, l AS (SELECT * FROM ev WHERE us >= 1705795200000000),
g AS (SELECT us // {hours(24)} * {hours(24)} AS start_us, event_type, count(*) AS n FROM l GROUP BY 1, 2) SELECT * FROM g WHERE start_us + {hours(24)} {CLOSED}""")
def _(spark, d):
    # A watermark drops rows from the batch after next on, so the newest come in two batches.
    return runner.run_to_table((sw.tumbling_counts(s, "ts", ["event_type"], "24 hours", "1 hour") for s in replayed(spark, d, NEWEST_FIRST)), "r13")[0]
