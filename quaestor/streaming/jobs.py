"""Telemetry jobs.  Stateless and windowed ones are written once and run on batch and streaming input alike; each
stateful job has a batch twin that computes the same rows from the whole table, as far as the stream's watermark has
passed them.  The stream-stream join of starts and ends gives all pairs within its bound, its twin the first end."""

import itertools
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quaestor.functions import rules as R
from quaestor.operators import quality
from quaestor.session import ROCKSDB, settle, shared_dir
from quaestor.sources.corpus import telemetry_columns

GAP = "30 minutes"


# ------------------------------------------------------------------------------------------------- sources
def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming telemetry from a folder of event files."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    path = folder if folder.endswith("events") else f"{folder}/events.parquet*"
    return telemetry_columns(spark.readStream.schema(schema).parquet(path))


EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_json_lines(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, files_per_batch: int | None = None) -> DataFrame:
    """Streaming rows of JSON-lines files; a line that is no such object comes with its text in the column corrupt."""
    reader = spark.readStream.schema(f"{schema}, corrupt string").option("mode", "PERMISSIVE")
    reader = reader.option("columnNameOfCorruptRecord", "corrupt").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def event_sink(df: DataFrame, out: str, form: str = "parquet", mode: str = "append", trigger: dict | None = None):
    """Start a standing sink: rows in out/rows, lines that could not be read in out/corrupt, a folder for each batch.

    A batch overwrites its own folder and the checkpoint lies beside the rows, so a run that is killed and started again
    with the same arguments neither loses rows nor writes them twice.  Returns the running query.
    """
    split = "corrupt" in df.columns

    def write(batch: DataFrame, batch_id: int) -> None:
        if not split:  # written once, so nothing is kept for a second time
            batch.write.mode("overwrite").format(form).save(f"{out}/rows/batch={batch_id}")
            return
        batch.persist()
        try:
            batch.where("corrupt IS NULL").drop("corrupt").write.mode("overwrite").format(form).save(f"{out}/rows/batch={batch_id}")
            bad = batch.where("corrupt IS NOT NULL").select("corrupt")
            bad.write.mode("overwrite").text(f"{out}/corrupt/batch={batch_id}")
        finally:
            batch.unpersist()

    writer = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{out}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def run_batches(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain a streaming frame into the sink and read the rows back with their batch number."""
    out = shared_dir(df.sparkSession, name)
    event_sink(df, out, mode=mode).awaitTermination()
    return df.sparkSession.read.parquet(f"{out}/rows")


def run_to_end(events: DataFrame, job, name: str, late: str = "10 minutes") -> DataFrame:
    """Drain job(events) as run_batches does, for a stream that ends here: what still waits for the watermark comes too.

    When the files are drained, the run goes on from its checkpoint with one more row: a mark later than all events, which
    moves the watermark past them.  The watermark never passes the mark itself, so no job sees it as due.
    """
    spark = events.sparkSession
    marks, out = shared_dir(spark, f"{name}-mark"), shared_dir(spark, name)
    spark.createDataFrame([], events.schema).write.parquet(marks)
    df = job(events.unionByName(spark.readStream.schema(events.schema).parquet(marks)))
    query = event_sink(df, out)
    query.awaitTermination()
    passed = [p["eventTime"]["watermark"] for p in query.recentProgress if "watermark" in p["eventTime"]]
    if passed:
        # the latest event lies one lateness ahead of the watermark, and the mark another one and a second ahead of it
        end = F.to_timestamp(F.lit(max(passed))) + F.expr(f"INTERVAL {late}") * 2 + F.expr("INTERVAL 1 second")
        known = {"event_id": F.lit(-1), "ts": end}
        mark = spark.range(1).select(*(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema.fields))
        mark.write.mode("append").parquet(marks)
        event_sink(df, out).awaitTermination()
    return spark.read.parquet(f"{out}/rows")


# ----------------------------------------------------------------------------------- stateless and windowed
def flag_hot(events: DataFrame) -> DataFrame:
    level = F.when(F.col("ms") > R.HOT_MS, "hot").when(F.col("ms") > R.WARN_MS, "warn").otherwise("ok")
    return events.withColumn("level", level)


def hotspots(events: DataFrame, width: str = "5 minutes") -> DataFrame:
    """window_start, stage, n, n_hot, n_warn, max_ms per tumbling window."""
    return (
        flag_hot(events)
        .groupBy(F.window("ts", width).alias("w"), "stage")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("level") == "hot").alias("n_hot"),
            F.count_if(F.col("level") == "warn").alias("n_warn"),
            F.max("ms").alias("max_ms"),
        )
        .select(F.col("w.start").alias("window_start"), "stage", "n", "n_hot", "n_warn", "max_ms")
    )


def important(events: DataFrame) -> DataFrame:
    """The verbosity filter."""
    return events.where(F.col("event").isin(R.IMPORTANT_EVENTS) | F.col("stage").isin(R.IMPORTANT_STAGES))


def budget_violations(events: DataFrame, budgets: DataFrame, width: str = "1 hour") -> DataFrame:
    """window_start, stage, n, n_over, rate.  budgets: stage, budget_ms (a handful of rows)."""
    return (
        events.join(F.broadcast(budgets), "stage")
        .groupBy(F.window("ts", width).alias("w"), "stage")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ms") > F.col("budget_ms")).alias("n_over"))
        .select(F.col("w.start").alias("window_start"), "stage", "n", "n_over", (F.col("n_over") / F.col("n")).alias("rate"))
    )


def stage_rollup(events: DataFrame, width: str = "10 minutes", slide: str = "5 minutes") -> DataFrame:
    """Per sliding window and stage: first end's duration and result count, and the worst status."""
    ended, failed = F.col("event").isin("success", "end"), F.col("event") == "error"
    at = F.struct("ts", "event_id")
    return (
        events.groupBy(F.window("ts", width, slide).alias("w"), "stage")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min_by(F.when(ended, F.col("ms")), F.when(ended, at)).alias("duration_ms"),
            F.min_by(F.when(ended, F.col("k")), F.when(ended, at)).alias("results"),
            F.max(failed.cast("int")).alias("_failed"),
            F.max(ended.cast("int")).alias("_ended"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            "stage",
            "n",
            "duration_ms",
            "results",
            F.when(F.col("_failed") == 1, "error").when(F.col("_ended") == 1, "success").otherwise("running").alias("status"),
        )
    )


# ------------------------------------------------------------------------------------------------ timelines
def _timeline() -> list:
    at = F.struct("ts", "event_id")
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum(F.round("ms", 1)).alias("total_ms"),
        F.count_if(F.col("ms") > R.HOT_MS).alias("n_hot"),
        F.count_if((F.col("ms") > R.WARN_MS) & (F.col("ms") <= R.HOT_MS)).alias("n_warn"),
        F.min_by("stage", at).alias("first_stage"),
        F.max_by("stage", at).alias("last_stage"),
        F.array_sort(F.collect_list(F.struct("ts", "event_id", "stage", F.round("ms", 1).alias("ms")))).alias("stages"),
    ]


def timeline_summary(stages: Column, total_ms: Column) -> Column:
    """One line: the total and every stage in order with its milliseconds, slow ones marked."""

    def whole(c):
        return F.bround(c, 0).cast("long").cast("string")

    def part(s):
        mark = F.when(s["ms"] > R.HOT_MS, "🔥").when(s["ms"] > R.WARN_MS, "⚠️").otherwise("")
        return F.concat(s["stage"], F.lit("→"), mark, whole(s["ms"]), F.lit("ms"))

    return F.concat(F.lit("Timeline["), whole(total_ms), F.lit("ms]: "), F.array_join(F.transform(stages, part), " | "))


def timeline_stream(events: DataFrame, gap: str = GAP, late: str = "10 minutes") -> DataFrame:
    """Closed timelines of a stream: one row per user session; late rows are dropped after the watermark."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("s"), "user_id")
        .agg(*_timeline())
        .select("user_id", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n", "total_ms", "n_hot",
                "n_warn", "first_stage", "last_stage", "stages")
    )


def timeline_batch(events: DataFrame, gap_s: int = 1800, bucket_s: int = 3600) -> DataFrame:
    """The same sessions from a table, in two steps so that no user's whole history lands in one task.

    Sessions are formed inside (user, hour) first; the pieces, few per user and hour, are then stitched where the gap
    between neighbours is short enough.
    """
    t = F.col("ts").cast("double")
    e = events.withColumn("_t", t).withColumn("_bucket", F.floor(t / bucket_s))
    in_day = Window.partitionBy("user_id", "_bucket").orderBy("ts", "event_id")
    new = F.coalesce((F.col("_t") - F.lag("_t").over(in_day) >= gap_s).cast("int"), F.lit(1))
    pieces = (
        e.withColumn("_new", new)
        .withColumn("_piece", F.sum("_new").over(in_day))
        .groupBy("user_id", "_bucket", "_piece")
        .agg(*_timeline(), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    )
    over_days = Window.partitionBy("user_id").orderBy("lo")
    apart = F.col("lo").cast("double") - F.lag(F.col("hi").cast("double")).over(over_days) >= gap_s
    return (
        pieces.withColumn("_new", F.coalesce(apart.cast("int"), F.lit(1)))
        .withColumn("_session", F.sum("_new").over(over_days))
        .groupBy("user_id", "_session")
        .agg(
            F.min("lo").alias("started"),
            (F.max("hi") + F.make_interval(secs=F.lit(gap_s))).alias("ended"),
            F.sum("n").alias("n"),
            F.sum("total_ms").alias("total_ms"),
            F.sum("n_hot").alias("n_hot"),
            F.sum("n_warn").alias("n_warn"),
            F.min_by("first_stage", "lo").alias("first_stage"),
            F.max_by("last_stage", "hi").alias("last_stage"),
            F.array_sort(F.flatten(F.collect_list("stages"))).alias("stages"),
        )
        .drop("_session")
    )


# ------------------------------------------------------------------------------------------- last n, logs
def last_n(events: DataFrame, n: int = 10, key: str = "req_id") -> DataFrame:
    """The latest n events per key; the window prunes inside each partition before it shuffles."""
    w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def recent_logs(events: DataFrame, n: int = 50, req_id: str | None = None) -> DataFrame:
    """The newest n log rows, of one request or of all."""
    e = events if req_id is None else events.where(F.col("req_id") == req_id)
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


class LastEvents(StatefulProcessor):
    """Keeps the latest ten event ids of each request, until the request has been silent for the given time."""

    def __init__(self, silence_s: int):
        self.silence = silence_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "ts timestamp, event_id long, stage string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [tuple(r) for r in self.events.get()] if self.events.exists() else []
        for pdf in rows:
            # never more than a batch over the ten, and a silence that lies between two events ends what was before it
            kept = sorted([*kept, *zip(pdf["ts"], pdf["event_id"], pdf["stage"])])
            gaps = [i for i in range(1, len(kept)) if (kept[i][0] - kept[i - 1][0]).total_seconds() * 1000 > self.silence]
            for a, b in zip([0, *gaps], gaps):
                yield self._rows(key, kept[a:b][-10:], True)
            kept = kept[gaps[-1] if gaps else 0 :][-10:]
        self.events.put(kept)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(pd.Timestamp(kept[-1][0]).timestamp() * 1000) + self.silence)
        yield self._rows(key, kept, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept = [tuple(r) for r in self.events.get()] if self.events.exists() else []
        self.events.clear()
        yield self._rows(key, kept, True)

    def _rows(self, key, kept, closed: bool) -> pd.DataFrame:
        n = len(kept)
        return pd.DataFrame(
            {
                "req_id": [key[0]] * n, "event_id": [r[1] for r in kept], "stage": [r[2] for r in kept],
                "nth": list(range(n, 0, -1)), "closed": [closed] * n,
            }
        )

    def close(self) -> None:
        pass


def last_n_stream(events: DataFrame, late: str = "10 minutes", silence_s: int = 30 * 86_400) -> DataFrame:
    """Running form of last_n: each batch re-emits the lists it changed.

    A request that stays silent in event time is emitted once more, closed, and its state is freed.  Events behind the
    watermark are dropped.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return events.withWatermark("ts", late).groupBy("req_id").transformWithStateInPandas(
        statefulProcessor=LastEvents(silence_s),
        outputStructType="req_id string, event_id long, stage string, nth int, closed boolean",
        outputMode="Update",
        timeMode="EventTime",
    )


# --------------------------------------------------------------------------------------------- stage pairs
def stage_latency(events: DataFrame, within: str = "1 hour") -> DataFrame:
    """Each start with the ends of its request and stage inside the bound; works on streams too."""
    s = events.where(F.col("event") == "start").select(
        F.col("req_id").alias("s_req"), F.col("stage").alias("s_stage"), F.col("ts").alias("s_ts"),
        F.col("event_id").alias("start_id"),
    )
    e = events.where(F.col("event").isin("success", "end", "error")).select(
        F.col("req_id").alias("e_req"), F.col("stage").alias("e_stage"), F.col("ts").alias("e_ts"),
        F.col("event_id").alias("end_id"), F.col("event").alias("status"),
    )
    if events.isStreaming:
        s, e = s.withWatermark("s_ts", "10 minutes"), e.withWatermark("e_ts", "10 minutes")
    on = (
        (F.col("s_req") == F.col("e_req"))
        & (F.col("s_stage") == F.col("e_stage"))
        & (F.col("e_ts") > F.col("s_ts"))
        & (F.col("e_ts") <= F.col("s_ts") + F.expr(f"interval {within}"))
    )
    elapsed = (F.unix_micros("e_ts") - F.unix_micros("s_ts")) / 1000.0
    return s.join(e, on).select(
        F.col("s_req").alias("req_id"), F.col("s_stage").alias("stage"), "start_id", "end_id", "status",
        elapsed.alias("elapsed_ms"),
    )


def first_end(events: DataFrame, within_s: int = 3600) -> DataFrame:
    """The nearest end of each start within the bound, without pairing every start with every end.

    Time is cut into slots as long as the bound: the nearest end lies in the start's slot or is the first of the next
    one.  A busy request is therefore spread over its slots.
    """
    slot = F.floor(F.unix_micros("ts") / (within_s * 1_000_000))
    ended = F.col("event").isin("success", "end", "error")
    end = F.struct(F.col("ts").alias("e_ts"), F.col("event_id").alias("end_id"), F.col("event").alias("status"))
    e = events.where(ended | (F.col("event") == "start")).withColumns(
        {"_slot": slot, "_end": F.when(ended, end), "_is_end": ended.cast("int")}
    )
    keys = ["req_id", "stage", "_slot"]
    # newest first: what has been seen so far lies in the future; at equal times a start comes before the ends
    ahead = Window.partitionBy(*keys).orderBy(F.desc("ts"), "_is_end").rowsBetween(Window.unboundedPreceding, -1)
    starts = e.withColumn("_here", F.min("_end").over(ahead)).where(F.col("event") == "start")
    following = (
        e.where(ended)
        .groupBy(*keys)
        .agg(F.min("_end").alias("_next"))
        .withColumn("_slot", F.col("_slot") - 1)
    )
    elapsed = (F.unix_micros("m.e_ts") - F.unix_micros("ts")) / 1000.0
    return (
        starts.join(following, keys, "left")
        .withColumn("m", F.coalesce("_here", "_next"))
        .select(
            "req_id", "stage", F.col("event_id").alias("start_id"), F.col("m.end_id").alias("end_id"),
            F.col("m.status").alias("status"), elapsed.alias("elapsed_ms"),
        )
        .where(F.col("elapsed_ms") <= within_s * 1000.0)
    )


# ------------------------------------------------------------------------------------------------- caches
def ttl_cache(events: DataFrame, key: str = "user_id", ttl_s: int = 600) -> DataFrame:
    """key, hits, misses of a cache whose entries expire a fixed time after insertion.

    A key's uses pass by in time order; the next insertion after one is found by a binary search in the batch, so the
    work per key is its insertions and nothing is gathered.  Counts of a batch leave the task and are summed.
    """
    ttl = ttl_s * 1_000_000

    def run(batches):
        last, inserted = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, t = batch.column("key"), batch.column("t").to_numpy()
            runs = pc.run_end_encode(keys)
            ends = runs.run_ends.to_numpy()
            found = []
            for k, a, b in zip(runs.values.to_pylist(), [0, *ends[:-1]], ends):
                at = a
                if k != last:
                    last, inserted = k, None
                elif inserted is not None:
                    at = a + int(np.searchsorted(t[a:b], inserted + ttl))
                misses = 0
                while at < b:
                    misses, inserted = misses + 1, int(t[at])
                    at += int(np.searchsorted(t[at:b], inserted + ttl))
                found.append((k, int(b - a) - misses, misses))
            yield pa.record_batch([pa.array(x) for x in zip(*found)], ["key", "hits", "misses"])

    e = events.select(F.col(key).cast("long").alias("key"), F.unix_micros("ts").alias("t"))
    parts = e.repartition("key").sortWithinPartitions("key", "t").mapInArrow(run, "key long, hits long, misses long")
    return parts.groupBy("key").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))


class Cache:
    """Entries that expire a fixed time after insertion; beyond the capacity the least recently used leave.

    Uses come in time order.  An eviction goes down to three quarters of the capacity, as one that removed a single entry
    would come with every insertion; of equal last uses the smaller entry leaves first.
    """

    def __init__(self, ttl_us: int, capacity: int | None, entries: dict | None = None):
        self.ttl, self.capacity, self.entries = ttl_us, capacity, entries or {}

    def expire(self, now: int) -> None:
        """Free what no use at or after `now` can hit."""
        self.entries = {k: v for k, v in self.entries.items() if now - v[0] < self.ttl}

    def use(self, entry: str, now: int) -> tuple[bool, int]:
        """(hit, entries evicted)"""
        inserted = self.entries.get(entry, (None,))[0]
        hit = inserted is not None and now - inserted < self.ttl
        self.entries[entry] = (inserted if hit else now, now)
        if hit or self.capacity is None or len(self.entries) <= self.capacity:
            return hit, 0
        self.expire(now)
        if len(self.entries) <= self.capacity:
            return hit, 0
        n = len(self.entries) - self.capacity * 3 // 4
        for k in sorted(self.entries, key=lambda k: (self.entries[k][1], k))[:n]:
            del self.entries[k]
        return hit, n


_USES = "cache string, event_id long, hit boolean, evicted int"


def cache_uses(events: DataFrame, cache: str, entry: str, ttl_s: int = 600, capacity: int | None = 1000) -> DataFrame:
    """cache, event_id, hit, evicted of every use, from a table: each cache's uses pass by in time order."""

    def run(batches):
        name, state = None, None
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                if state is None or r["cache"] != name:
                    name, state = r["cache"], Cache(ttl_s * 1_000_000, capacity)
                out.append(state.use(r["entry"], r["t"]))
            hits = [pa.array([h for h, _ in out], pa.bool_()), pa.array([n for _, n in out], pa.int32())]
            yield pa.record_batch([batch.column("cache"), batch.column("event_id"), *hits], ["cache", "event_id", "hit", "evicted"])

    e = _uses(events, cache, entry)
    return e.repartition("cache").sortWithinPartitions("cache", "t", "event_id").mapInArrow(run, _USES)


def _uses(events: DataFrame, cache: str, entry: str) -> DataFrame:
    names = [F.col(c).cast("string").alias(n) for c, n in ((cache, "cache"), (entry, "entry"))]
    return events.select(*names, "ts", "event_id", F.unix_micros("ts").alias("t"))


_WAITING = pa.schema([("t", pa.int64()), ("event_id", pa.int64()), ("entry", pa.string())])


def _in_time(uses: pa.Table) -> pa.Table:
    return uses.sort_by([(c, "ascending") for c in _WAITING.names]).combine_chunks()


class CacheUses(StatefulProcessor):
    """A cache kept up by a stream.

    Uses wait until the watermark has passed them and are then taken in time order, so results do not depend on how the
    stream was cut into batches.  Uses behind the watermark of the batch before are dropped: what has been answered stays.
    Entries leave at their expiry, by a timer.

    What waits lies in chunks by time, so that a busy cache is neither read nor sorted as a whole: `sorted_uses` uses are
    sorted together and cut into chunks of `chunk_uses`, and those whose times overlap are read together.
    """

    sorted_uses, chunk_uses, read_chunks = 1 << 18, 1 << 12, 16

    def __init__(self, ttl_us: int, capacity: int | None):
        self.ttl, self.capacity = ttl_us, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "first long, last long, number long", "uses binary")
        self.entries = handle.getMapState("entries", "entry string", "inserted long, used long")

    def _wake(self, t_us: int) -> None:
        self.handle.registerTimer(-(-t_us // 1000))

    def _put(self, uses: pa.Table) -> int:
        """Lay sorted uses down in chunks; the time of the first one."""
        t = uses.column("t").to_numpy()
        for a in range(0, len(uses), self.chunk_uses):
            part, sink = uses.slice(a, self.chunk_uses), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, uses.schema) as out:
                out.write_table(part)
            key = (int(t[a]), int(t[a + len(part) - 1]), int.from_bytes(os.urandom(7)))
            self.waiting.updateValue(key, (sink.getvalue().to_pybytes(),))
        return int(t[0])

    def _take(self, key: tuple) -> pa.Table:
        uses = pa.ipc.open_stream(self.waiting.getValue(key)[0]).read_all()
        self.waiting.removeKey(key)
        return uses

    def _due(self, now: int) -> Iterator[pa.Table]:
        """The uses up to now in time order, in stretches; what a chunk has beyond stays."""
        keys, ahead = sorted(tuple(k) for k in self.waiting.keys() if k[0] <= now), _WAITING.empty_table()
        for a in range(0, len(keys), self.read_chunks):
            ahead = _in_time(pa.concat_tables([ahead, *(self._take(k) for k in keys[a : a + self.read_chunks])]))
            # an unread chunk may begin at the time of the last ones
            until = min([now + 1, *(k[0] for k in keys[a + self.read_chunks : a + self.read_chunks + 1])])
            n = int(np.searchsorted(ahead.column("t").to_numpy(), until))
            for b in range(0, n, self.chunk_uses):
                yield ahead.slice(b, min(self.chunk_uses, n - b))
            ahead = ahead.slice(n)
        if len(ahead):
            self._put(ahead)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, held, n = [], [], 0
        for pdf in itertools.chain(rows, [None]):
            if pdf is not None:
                held.append(pa.Table.from_pandas(pdf[_WAITING.names], _WAITING, preserve_index=False))
                n += len(pdf)
            if n and (pdf is None or n >= self.sorted_uses):
                first.append(self._put(_in_time(pa.concat_tables(held))))
                held, n = [], 0
        self._wake(min(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        before = {k[0]: tuple(v) for k, v in self.entries.iterator()}
        state = Cache(self.ttl, self.capacity, dict(before))
        for uses in self._due(now):
            out = [(key[0], i, *state.use(e, t)) for t, i, e in zip(*(uses.column(c).to_pylist() for c in _WAITING.names))]
            yield pd.DataFrame(out, columns=["cache", "event_id", "hit", "evicted"])
        state.expire(now)  # uses to come are later than the watermark
        for e in before.keys() - state.entries.keys():
            self.entries.removeKey((e,))
        for e, v in state.entries.items():
            if before.get(e) != v:
                self.entries.updateValue((e,), v)
        rest = min((k[0] for k in self.waiting.keys()), default=None)
        if rest is not None:
            self._wake(rest)
        if state.entries:
            self._wake(max(now + 1, min(v[0] for v in state.entries.values()) + self.ttl))

    def close(self) -> None:
        pass


def cache_stream(
    events: DataFrame, cache: str, entry: str, ttl_s: int = 600, capacity: int | None = 1000, late: str = "10 minutes"
) -> DataFrame:
    """The rows of cache_uses for all uses that the watermark has passed."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")  # of all stores of an executor
    return _uses(events.withWatermark("ts", late), cache, entry).groupBy("cache").transformWithStateInPandas(
        statefulProcessor=CacheUses(ttl_s * 1_000_000, capacity),
        outputStructType=_USES,
        outputMode="Append",
        timeMode="EventTime",
    )


def ttl_stream(events: DataFrame, ttl_s: int = 600, late: str = "10 minutes") -> DataFrame:
    """key, event_id, hit of every use: a cache of its own for each key, so nothing is evicted."""
    uses = cache_stream(events, "user_id", "user_id", ttl_s, None, late)
    return uses.select(F.col("cache").cast("long").alias("key"), "event_id", "hit")


# ------------------------------------------------------------------------------------------ schema profile
class SchemaCounts(StatefulProcessor):
    """Running count per content path of one index.

    A path not seen for the TTL, measured in event time against the newest observation, is forgotten.
    """

    def __init__(self, ttl_s: int):
        self.ttl = pd.Timedelta(seconds=ttl_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.paths = handle.getMapState("paths", "path string", "n long, inner long, last timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = {k[0]: (v[0], v[1], pd.Timestamp(v[2])) for k, v in self.paths.iterator()}
        for pdf in rows:
            for path, n, inner, last in zip(pdf["path"], pdf["n"], pdf["inner"], pdf["last_seen"]):
                old = known.get(path, (0, 0, last))
                known[path] = (old[0] + int(n), old[1] + int(inner), max(old[2], last))
        newest = max(v[2] for v in known.values())
        alive = {p: v for p, v in known.items() if newest - v[2] <= self.ttl}
        for path, (n, inner, last) in alive.items():
            self.paths.updateValue((path,), (n, inner, last.to_pydatetime()))
        for path in known.keys() - alive.keys():
            self.paths.removeKey((path,))
        yield pd.DataFrame(
            [(key[0], p, n, inner, last) for p, (n, inner, last) in alive.items()],
            columns=["idx", "path", "n", "inner", "last_seen"],
        )

    def close(self) -> None:
        pass


def schema_profile_stream(observations: DataFrame, capacity: int | None = 100, ttl_s: int = 86_400) -> DataFrame:
    """idx, path, n, inner, last_seen of the newest indices, kept up by a stream of observations.

    Every micro-batch is counted per (index, path) before it meets the state, so a hot index reaches its state as a
    few rows.  Indices beyond the capacity (null: no limit) are evicted oldest first.
    """
    spark = observations.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    out = shared_dir(spark, "schema-counts")

    def count_batch(batch: DataFrame, batch_id: int) -> None:
        quality.path_counts(batch).write.mode("overwrite").parquet(f"{out}/counts/batch={batch_id}")

    query = (
        observations.writeStream.foreachBatch(count_batch)
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = "idx string, path string, n long, inner long, last_seen timestamp, batch int"
    counted = spark.readStream.schema(schema).parquet(f"{out}/counts")
    state = counted.groupBy("idx").transformWithStateInPandas(
        statefulProcessor=SchemaCounts(ttl_s),
        outputStructType="idx string, path string, n long, inner long, last_seen timestamp",
        outputMode="Update",
        timeMode="None",
    )
    rows = run_batches(state, "schema-profile", "update")
    latest = rows.groupBy("idx", "path").agg(*[F.max_by(c, "batch").alias(c) for c in ("n", "inner", "last_seen")])
    if capacity is None:
        return latest
    kept = latest.groupBy("idx").agg(F.max("last_seen").alias("seen")).orderBy(F.desc("seen"), "idx").limit(capacity)
    return latest.join(kept, "idx", "left_semi")
