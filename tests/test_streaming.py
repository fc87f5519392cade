"""Caches, sinks and timelines of streams: independent of how the stream was cut, restartable, with state that ends."""

import datetime as dt
import json
import random
from collections import OrderedDict, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quaestor.session import shared_dir
from quaestor.streaming import jobs as J

START = dt.datetime(2024, 1, 1)
TTL, CAPACITY = 3600, 5


def uses(seed, n=400):
    rng = random.Random(seed)
    at = sorted(rng.randrange(4 * 86_400) for _ in range(n))
    return [(i, START + dt.timedelta(seconds=t // 60 * 60), rng.randrange(9), rng.choice("ab")) for i, t in enumerate(at)]


def plain(rows, ttl, capacity):
    """Brute force, as rows (cache, event_id, hit, evicted)."""
    caches, out = defaultdict(dict), []
    for i, ts, user, stage in sorted(rows, key=lambda r: (r[1], r[0])):
        c, e = caches[stage], str(user)
        hit = e in c and (ts - c[e][0]).total_seconds() < ttl
        c[e] = (c[e][0] if hit else ts, ts)
        gone = 0
        live = {k: v for k, v in c.items() if (ts - v[0]).total_seconds() < ttl}
        if not hit and len(live) > capacity:
            gone = len(live) - capacity * 3 // 4
            order = OrderedDict(sorted(live.items(), key=lambda kv: (kv[1][1], kv[0])))
            for k in list(order)[:gone]:
                del live[k]
        caches[stage] = live
        out.append((stage, i, hit, gone))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, ts, u, s) for i, ts, u, s in rows], "event_id long, ts timestamp, user_id long, stage string")


def stream(spark, batches):
    """The rows as a stream of one file a batch, in the given order."""
    folder = shared_dir(spark, "cut")
    for k, rows in enumerate(batches):
        frame(spark, rows).coalesce(1).write.parquet(f"{folder}/f{k:03}")
    paths = spark.readStream.schema("event_id long, ts timestamp, user_id long, stage string").option("maxFilesPerTrigger", 1)
    return paths.parquet(f"{folder}/*")


def cut(rows, n, seed, shuffled):
    """n batches; within half an hour of each other rows may change places between batches."""
    rng = random.Random(seed)
    key = (lambda r: r[1] + dt.timedelta(minutes=rng.randrange(30))) if shuffled else (lambda r: r[1])
    rows = sorted(rows, key=key)
    size = -(-len(rows) // n)
    return [rows[a : a + size] for a in range(0, len(rows), size)]


def test_cache_of_a_table_equals_brute_force(spark):
    rows = uses(1)
    got = J.cache_uses(frame(spark, rows).repartition(4), "stage", "user_id", TTL, CAPACITY).collect()
    assert sorted(map(tuple, got)) == plain(rows, TTL, CAPACITY)
    assert any(r[3] for r in map(tuple, got)) and any(r[2] for r in map(tuple, got))


@pytest.mark.parametrize("n, shuffled", [(1, False), (6, False), (6, True)])
def test_cache_of_a_stream_does_not_depend_on_its_batches(spark, n, shuffled):
    rows = uses(2, 250)
    df = J.cache_stream(stream(spark, cut(rows, n, 3, shuffled)), "stage", "user_id", TTL, CAPACITY, late="1 hour")
    got = sorted(tuple(r)[:4] for r in J.run_batches(df, "cache").select("cache", "event_id", "hit", "evicted").collect())
    passed = max(r[1] for r in rows) - dt.timedelta(hours=1)
    ids = {r[0] for r in rows if r[1] <= passed}
    assert got == [r for r in plain(rows, TTL, CAPACITY) if r[1] in ids]


def test_a_use_behind_the_watermark_is_dropped(spark):
    first = [(0, START, 1, "a"), (1, START + dt.timedelta(days=1), 2, "a")]
    later, late = [(3, START + dt.timedelta(days=2), 3, "a")], [(2, START + dt.timedelta(hours=2), 1, "a")]
    df = J.cache_stream(stream(spark, [first, later, late]), "stage", "user_id", 10 * 86_400, 5, late="1 hour")
    assert sorted(r.event_id for r in J.run_batches(df, "cache").collect()) == [0, 1]


class Kept(dict):
    """A map state of one key."""

    getValue, updateValue, removeKey = dict.get, dict.__setitem__, dict.__delitem__

    def iterator(self):
        return iter(list(self.items()))


class Handle:
    def __init__(self):
        self.timers = set()

    def getMapState(self, *_):
        return Kept()

    def registerTimer(self, at):
        self.timers.add(at)


@pytest.mark.parametrize("shuffled", [False, True])
def test_a_busy_cache_is_never_read_as_a_whole(monkeypatch, shuffled):
    """All that waited for the watermark was one list, in the state, in the worker and once more when it was sorted."""
    rows = [(i, ts, user, "a") for i, ts, user, _ in uses(8, 4000)]
    if shuffled:
        random.Random(9).shuffle(rows)
    processor, handle, read = J.CacheUses(TTL * 1_000_000, CAPACITY), Handle(), []
    processor.sorted_uses, processor.chunk_uses, processor.read_chunks = 500, 40, 3
    in_time = J._in_time
    monkeypatch.setattr(J, "_in_time", lambda uses: read.append(len(uses)) or in_time(uses))
    processor.init(handle)
    t = [int(ts.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6) for _, ts, _, _ in rows]
    frame = pd.DataFrame({"cache": "a", "entry": [str(u) for _, _, u, _ in rows], "ts": 0, "event_id": [i for i, *_ in rows], "t": t})
    got = []

    class Now:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):
            return self.at // 1000

    for now in (min(t) + (max(t) - min(t)) // 3, max(t) // 60_000_000 * 60_000_000 - 1_000, max(t)):
        if not got:
            assert list(processor.handleInputRows(("a",), (frame[a : a + 130] for a in range(0, 4000, 130)), None)) == []
            assert handle.timers == {-(-min(t) // 1000)}
        for out in processor.handleExpiredTimer(("a",), Now(now), None):
            got += out.itertuples(index=False, name=None)
            assert len(out) <= 40
        assert all(k[0] > now // 1000 * 1000 for k in processor.waiting)
    assert [tuple(r) for r in sorted(got, key=lambda r: r[1])] == plain(rows, TTL, CAPACITY)
    assert max(read) <= (8 + 3) * 130


def test_ttl_counts_of_table_and_stream(spark):
    rows = uses(4)
    want = defaultdict(lambda: [0, 0])
    for user, _, hit, _ in plain([(i, ts, 0, str(u)) for i, ts, u, _ in rows], TTL, 99):
        want[int(user)][not hit] += 1
    got = {r.key: [r.hits, r.misses] for r in J.ttl_cache(frame(spark, rows).repartition(3), "user_id", TTL).collect()}
    assert got == want


@pytest.mark.parametrize("n", [1, 4])
def test_a_stream_that_ends_answers_its_last_uses(spark, n):
    rows = uses(5, 120)
    rows += [(500, rows[-1][1], 3, "a"), (501, rows[-1][1] + dt.timedelta(microseconds=700), 3, "a")]
    cuts = cut(rows, n, 6, False)
    job = lambda events: J.cache_stream(events, "stage", "user_id", TTL, CAPACITY, late="10 minutes")
    got = J.run_to_end(stream(spark, cuts), job, "end").select("cache", "event_id", "hit", "evicted")
    assert sorted(map(tuple, got.collect())) == plain(rows, TTL, CAPACITY)
    nothing = J.run_to_end(stream(spark, [[]]), job, "none")
    assert nothing.isEmpty()


def test_a_silent_request_leaves_the_state(spark):
    rows = [(k, START + dt.timedelta(minutes=k), 1, "s") for k in range(12)]
    later = [(99, START + dt.timedelta(days=9), 2, "s")]
    again = [(100, START + dt.timedelta(days=9, hours=1), 1, "s")]
    df = stream(spark, [rows, later, again]).withColumn("req_id", F.col("user_id").cast("string"))
    out = J.run_batches(J.last_n_stream(df, silence_s=3600), "last", "update").where("req_id = '1'").collect()
    closed = [r for r in out if r.closed]
    assert sorted(r.event_id for r in closed) == list(range(2, 12))
    assert [(r.event_id, r.nth) for r in out if r.event_id == 100] == [(100, 1)]  # the ten of before are gone


def lines(folder, k, rows):
    (folder / f"part{k}.json").write_text("\n".join(rows) + "\n")


def event(i):
    return json.dumps({"event_id": i, "ts": "2024-01-01T00:00:00", "user_id": 1, "event_type": "view", "value": 0.5, "props": "{}"})


def test_sink_is_exactly_once_over_a_crash(spark, tmp_path):
    source, out = tmp_path / "in", f"{tmp_path}/out"
    source.mkdir()
    for k in range(4):
        lines(source, k, [event(10 * k + j) for j in range(10)] + ["{broken", "7"][: k % 3])
    df = J.read_json_lines(spark, str(source), files_per_batch=1)

    class Killed(Exception):
        pass

    done = []

    def dies(batch, batch_id):
        """Writes as the sink does, then dies before the third batch is committed."""
        batch.where("corrupt IS NULL").drop("corrupt").write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")
        done.append(batch_id)
        if batch_id == 2:
            raise Killed

    query = df.writeStream.foreachBatch(dies).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="Killed"):
        query.awaitTermination()
    assert done == [0, 1, 2]
    lines(source, 4, [event(40)])
    J.event_sink(J.read_json_lines(spark, str(source), files_per_batch=1), out).awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(f"{out}/rows").collect()) == list(range(41))
    bad = [r.value for r in spark.read.text(f"{out}/corrupt").collect()]
    assert set(bad) <= {"{broken", "7"} and "{broken" in bad


def test_timeline_names_every_stage_in_order(spark):
    rows = [(1, START, 7, "bm25", 12.44), (2, START + dt.timedelta(minutes=1), 7, "knn", 2500.0), (3, START + dt.timedelta(minutes=59), 7, "late", 700.5)]
    rows += [(4, START + dt.timedelta(minutes=61), 7, "rrf", 0.5)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, stage string, ms double")
    got = J.timeline_batch(df).select(J.timeline_summary(F.col("stages"), F.col("total_ms")).alias("s"), "n").orderBy("n", "s").collect()
    assert sorted(r.s for r in got) == sorted(["Timeline[2512ms]: bm25→12ms | knn→🔥2500ms", "Timeline[701ms]: late→⚠️700ms | rrf→0ms"])
