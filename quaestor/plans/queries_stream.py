"""Registered queries: telemetry jobs, in batch form and as Structured Streaming runs over the same files."""

from pyspark.sql import functions as F

from quaestor.operators import quality
from quaestor.plans import oracle as O
from quaestor.plans.registry import query
from quaestor.session import shared_dir
from quaestor.sources import corpus as C
from quaestor.streaming import jobs as J

STAMP, DUCK_STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS", "'%Y-%m-%d %H:%M:%S.%f'"
# Milliseconds a stage of the sample telemetry may take.
STAGE_BUDGETS = [("view", 300.0), ("click", 500.0), ("signup", 800.0), ("purchase", 1200.0), ("error", 2000.0)]


def stamp(c):
    return F.date_format(c, STAMP).alias(c)


O.cte(
    "c_sess",
    """SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 30 MINUTE AS b, count(*) AS n, round(sum(round(ms, 1)), 3) AS total_ms,
    count(*) FILTER (ms > 2000) AS n_hot, count(*) FILTER (ms > 500 AND ms <= 2000) AS n_warn,
    arg_min(stage, (ts, event_id)) AS first_stage, arg_max(stage, (ts, event_id)) AS last_stage, 'Timeline[' || printf('%.0f',
    round(sum(round(ms, 1)), 3)) || 'ms]: ' || string_agg(stage || '→' || CASE WHEN round(ms, 1) > 2000 THEN '🔥' WHEN
    round(ms, 1) > 500 THEN '⚠️' ELSE '' END || printf('%.0f', round(ms, 1)) || 'ms', ' | ' ORDER BY ts, event_id) AS summary FROM (SELECT *, sum(fresh) OVER
    (PARTITION BY user_id ORDER BY ts, event_id) AS sess FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id
    ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM c_tel)) GROUP BY user_id, sess""",
)
_timeline = f"""SELECT user_id, strftime(a, {DUCK_STAMP}) AS started, strftime(b, {DUCK_STAMP}) AS ended, n, total_ms, n_hot,
    n_warn, first_stage, last_stage, summary FROM c_sess"""


def _show_timeline(t):
    return t.select(
        "user_id", stamp("started"), stamp("ended"), "n", F.round("total_ms", 3).alias("total_ms"), "n_hot", "n_warn",
        "first_stage", "last_stage", J.timeline_summary(F.col("stages"), F.round("total_ms", 3)).alias("summary"),
    )


@query("request_timeline", O.sql(_timeline))
def request_timeline(spark, folder):
    return _show_timeline(J.timeline_batch(C.telemetry(spark, folder)))


@query(
    "request_timeline_stream",
    O.sql(_timeline + " WHERE b <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM c_tel)"),
)
def request_timeline_stream(spark, folder):
    """Streaming sessions; those still open when the stream ends are not emitted."""
    return _show_timeline(J.run_batches(J.timeline_stream(J.read_events(spark, folder)), "timeline"))


@query(
    "hotspots",
    O.sql(
        f"""SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), {DUCK_STAMP}) AS window_start, stage, count(*) AS n,
        count(*) FILTER (ms > 2000) AS n_hot, count(*) FILTER (ms > 500 AND ms <= 2000) AS n_warn, max(ms) AS max_ms
        FROM c_tel GROUP BY ALL"""
    ),
)
def hotspots(spark, folder):
    h = J.hotspots(C.telemetry(spark, folder))
    return h.withColumn("window_start", F.date_format("window_start", STAMP))


@query(
    "hotspots_stream",
    O.sql(
        f"""SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), {DUCK_STAMP}) AS window_start, stage, count(*) AS n,
        count(*) FILTER (ms > 2000) AS n_hot FROM c_tel WHERE time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE <=
        (SELECT max(ts) - INTERVAL 10 MINUTE FROM c_tel) GROUP BY ALL"""
    ),
)
def hotspots_stream(spark, folder):
    e = J.read_events(spark, folder).withWatermark("ts", "10 minutes")
    h = J.run_batches(J.hotspots(e), "hotspots")
    return h.select(F.date_format("window_start", STAMP).alias("window_start"), "stage", "n", "n_hot")


_last = """SELECT user_id, event_id, stage, nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC,
    event_id DESC) AS nth FROM c_tel) WHERE nth <= 10"""


@query("last_n_events", O.sql(_last))
def last_n_events(spark, folder):
    return J.last_n(C.telemetry(spark, folder), 10, "user_id").select("user_id", "event_id", "stage", "nth")


@query("last_n_events_stream", O.sql(_last.replace("SELECT user_id,", "SELECT user_id,", 1)))
def last_n_events_stream(spark, folder):
    """The newest emission of each key holds its latest ten events."""
    e = J.read_events(spark, folder).withColumn("req_id", F.col("user_id").cast("string"))
    rows = J.run_batches(J.last_n_stream(e), "last-n", "update")
    newest = rows.groupBy("req_id").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["req_id", "batch"], "left_semi").select(
        F.col("req_id").cast("long").alias("user_id"), "event_id", "stage", "nth"
    )


@query(
    "recent_logs",
    O.sql(f"SELECT event_id, req_id, stage, event, strftime(ts, {DUCK_STAMP}) AS ts FROM (SELECT * FROM c_tel ORDER BY ts DESC, event_id DESC LIMIT 50)"),
)
def recent_logs(spark, folder):
    return J.recent_logs(C.telemetry(spark, folder), 50).select("event_id", "req_id", "stage", "event", stamp("ts"))


@query(
    "stage_latency",
    O.sql(
        """SELECT req_id, stage, start_id, arg_min(end_id, (e_ts, end_id)) AS end_id, arg_min(status, (e_ts, end_id)) AS status,
        round(min(epoch_us(e_ts) - epoch_us(s_ts)) / 1000.0, 3) AS elapsed_ms FROM (SELECT s.req_id, s.stage, s.event_id AS start_id,
        s.ts AS s_ts, e.event_id AS end_id, e.event AS status, e.ts AS e_ts FROM c_tel s JOIN c_tel e ON s.req_id = e.req_id
        AND s.stage = e.stage AND s.event = 'start' AND e.event IN ('success', 'error') AND e.ts > s.ts
        AND e.ts <= s.ts + INTERVAL 6 HOUR) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY req_id, stage, start_id")
    ),
)
def stage_latency(spark, folder):
    p = J.first_end(C.telemetry(spark, folder), 6 * 3600)
    return p.withColumn("elapsed_ms", F.round("elapsed_ms", 3))


@query(
    "stage_latency_stream",
    O.sql(
        """SELECT s.req_id, s.stage, s.event_id AS start_id, e.event_id AS end_id, e.event AS status FROM c_tel s JOIN c_tel e
        ON s.req_id = e.req_id AND s.stage = e.stage AND s.event = 'start' AND e.event IN ('success', 'error') AND e.ts > s.ts
        AND e.ts <= s.ts + INTERVAL 1 HOUR"""
    ),
)
def stage_latency_stream(spark, folder):
    """Stream-stream join of starts and ends within an hour."""
    p = J.run_batches(J.stage_latency(J.read_events(spark, folder)), "latency")
    return p.select("req_id", "stage", "start_id", "end_id", "status")


@query(
    "stage_rollup",
    O.sql(
        f"""SELECT strftime(w, {DUCK_STAMP}) AS window_start, stage, count(*) AS n, arg_min(ms, (ts, event_id)) FILTER
        (event = 'success') AS duration_ms, arg_min(k, (ts, event_id)) FILTER (event = 'success') AS results, CASE WHEN
        bool_or(event = 'error') THEN 'error' WHEN bool_or(event = 'success') THEN 'success' ELSE 'running' END AS status FROM
        (SELECT *, time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE * unnest([0, 1]) AS w FROM c_tel) GROUP BY ALL"""
    ),
)
def stage_rollup(spark, folder):
    r = J.stage_rollup(C.telemetry(spark, folder))
    return r.withColumn("window_start", F.date_format("window_start", STAMP))


_budgets = ", ".join(f"('{a}', CAST({b} AS DOUBLE))" for a, b in STAGE_BUDGETS)


@query(
    "budget_violations",
    O.sql(
        f"""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), {DUCK_STAMP}) AS window_start, stage, count(*) AS n,
        count(*) FILTER (ms > budget_ms) AS n_over, round(count(*) FILTER (ms > budget_ms) / count(*), 6) AS rate FROM c_tel
        JOIN (VALUES {_budgets}) b(stage, budget_ms) USING (stage) GROUP BY ALL"""
    ),
)
def budget_violations(spark, folder):
    b = spark.createDataFrame(STAGE_BUDGETS, "stage string, budget_ms double")
    v = J.budget_violations(C.telemetry(spark, folder), b)
    return v.select(
        F.date_format("window_start", STAMP).alias("window_start"), "stage", "n", "n_over", F.round("rate", 6).alias("rate")
    )


_passed = "WHERE ts <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM c_tel)"  # what a watermark of ten minutes has passed
_ttl = """SELECT key, r.h AS hits, r.m AS misses FROM (SELECT user_id AS key, list_reduce(list({'i': epoch_us(ts),
    'h': CAST(0 AS BIGINT), 'm': CAST(1 AS BIGINT)} ORDER BY ts, event_id), lambda acc, x: CASE WHEN x.i - acc.i < 14400000000 THEN
    {'i': acc.i, 'h': acc.h + 1, 'm': acc.m} ELSE {'i': x.i, 'h': acc.h, 'm': acc.m + 1} END) AS r FROM c_tel GROUP BY user_id)"""


@query("ttl_dedup", O.sql(_ttl))
def ttl_dedup(spark, folder):
    """Hits and misses of a cache whose entries live four hours."""
    return J.ttl_cache(C.telemetry(spark, folder), "user_id", 4 * 3600)


@query("ttl_dedup_stream", O.sql(_ttl))
def ttl_dedup_stream(spark, folder):
    """The counts of ttl_dedup from a stream, down to its last event."""
    uses = J.run_to_end(J.read_events(spark, folder), lambda events: J.ttl_stream(events, 4 * 3600), "ttl")
    return uses.groupBy("key").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


# a cache of eight users for each stage; a user's entry lives two days.  State: entries by user with insertion and last use.
_LRU_TTL, _LRU_CAPACITY = 2 * 86_400, 8


def _lru(where: str) -> str:
    uses = f"""(SELECT stage AS cache, CAST(user_id AS VARCHAR) AS e, epoch_us(ts) AS t, row_number() OVER (PARTITION BY stage
        ORDER BY ts, event_id) AS pos FROM c_tel {where})"""
    return f"""WITH RECURSIVE u AS MATERIALIZED {uses}, r AS (SELECT DISTINCT cache, CAST(0 AS BIGINT) AS pos,
        CAST([] AS STRUCT(e VARCHAR, i BIGINT, u BIGINT)[]) AS m, false AS hit, CAST(0 AS BIGINT) AS evicted FROM u UNION ALL
        SELECT cache, pos, CASE WHEN gone > 0 THEN list_slice(list_sort(m), gone + 1, len(m)) ELSE m END, hit, gone FROM
        (SELECT cache, pos, hit, m, CASE WHEN NOT hit AND len(m) > {_LRU_CAPACITY} THEN len(m) - {_LRU_CAPACITY * 3 // 4} ELSE 0 END
        AS gone FROM (SELECT r.cache, u.pos, len(mine) > 0 AS hit, list_append(list_filter(live, lambda x: x.e <> u.e),
        {{'u': u.t, 'e': u.e, 'i': CASE WHEN len(mine) > 0 THEN mine[1].i ELSE u.t END}}) AS m FROM (SELECT r.*, u.t, u.e AS ue,
        list_filter(r.m, lambda x: u.t - x.i < {_LRU_TTL}000000) AS live FROM r JOIN u ON u.cache = r.cache AND u.pos = r.pos + 1) r
        JOIN u ON u.cache = r.cache AND u.pos = r.pos + 1, LATERAL (SELECT list_filter(live, lambda x: x.e = u.e) AS mine))))
        SELECT cache, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, CAST(sum(evicted) AS BIGINT) AS evicted
        FROM r WHERE pos > 0 GROUP BY cache""".replace("STRUCT(e VARCHAR, i BIGINT, u BIGINT)", "STRUCT(u BIGINT, e VARCHAR, i BIGINT)")


def _lru_sql(where: str) -> str:
    return O.sql(f"SELECT * FROM ({_lru(where)})")


def _per_cache(uses):
    return uses.groupBy("cache").agg(
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.sum("evicted").alias("evicted")
    )


@query("lru_cache", _lru_sql(""))
def lru_cache(spark, folder):
    """Hits, misses and evictions of a bounded cache for each stage."""
    return _per_cache(J.cache_uses(C.telemetry(spark, folder), "stage", "user_id", _LRU_TTL, _LRU_CAPACITY))


@query("lru_cache_stream", _lru_sql(_passed))
def lru_cache_stream(spark, folder):
    uses = J.cache_stream(J.read_events(spark, folder), "stage", "user_id", _LRU_TTL, _LRU_CAPACITY)
    return _per_cache(J.run_batches(uses, "lru"))


@query(
    "event_log",
    O.sql("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_ids, round(sum(value), 6) AS total FROM events GROUP BY ALL"),
)
def event_log(spark, folder):
    """All events written as JSON lines, read back as a stream and kept by the standing sink."""
    lines, out = shared_dir(spark, "event-lines"), shared_dir(spark, "event-log")
    C.table(spark, folder, "events").write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(lines)
    J.event_sink(J.read_json_lines(spark, lines), out).awaitTermination()
    kept = spark.read.parquet(f"{out}/rows").groupBy("event_type")
    return kept.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_ids"), F.round(F.sum("value"), 6).alias("total"))


@query(
    "important_events",
    O.sql(
        """SELECT stage, event, count(*) AS n FROM c_tel WHERE event IN ('error', 'success') OR stage IN ('click') GROUP BY ALL
        UNION ALL SELECT stage, event, count(*) FROM c_tel WHERE event = 'start' AND stage <> 'click' GROUP BY ALL"""
    ),
)
def important_events(spark, folder):
    return J.important(C.telemetry(spark, folder)).groupBy("stage", "event").agg(F.count(F.lit(1)).alias("n"))


def event_observations(events):
    """Events as extraction observations: the stage is the index, the number in the props says what was found."""
    k = F.col("k")
    path = quality.content_path(k % 3 != 0, k % 2 == 0, F.when(k % 5 == 0, "body"), F.when(k % 7 == 0, 0).otherwise(1))
    return events.select(F.col("stage").alias("idx"), "ts", (k % 3 != 0).alias("has_inner_hits"), path.alias("path"))


@query(
    "schema_profile_stream",
    O.sql(
        f"""SELECT idx, path, count(*) AS n, count(*) FILTER (inner_hit) AS inner_n, strftime(max(ts), {DUCK_STAMP}) AS last_seen
        FROM (SELECT stage AS idx, ts, k % 3 <> 0 AS inner_hit, CASE WHEN k % 7 = 0 THEN 'no_content' WHEN k % 3 <> 0 THEN 'inner_hits'
        WHEN k % 2 = 0 THEN 'sections.content' WHEN k % 5 = 0 THEN 'body' ELSE 'unknown' END AS path FROM c_tel) GROUP BY ALL"""
    ),
)
def schema_profile_stream(spark, folder):
    p = J.schema_profile_stream(event_observations(J.read_events(spark, folder)))
    return p.select("idx", "path", "n", F.col("inner").alias("inner_n"), stamp("last_seen"))
