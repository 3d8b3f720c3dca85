"""The job life cycle as a stream and the exactly-once store, over several files, replays, failures and restarts."""

import datetime
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from gridloom.sources.store import CellStore
from gridloom.streaming import lifecycle as S

SCHEMA = "job long, attempt int, seq long, kind string, processed long, ts timestamp"
CELLS = "job long, row long, col long, code string, confidence double, pos long"


@pytest.fixture(scope="module")
def rocks(spark):
    """A session with the state store that the stream needs."""
    for k, v in S.STATE_STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k in S.STATE_STORE:
        spark.conf.unset(k)


def life(rnd, job):
    """The events of a job in order, with retries, and sometimes events after its end."""
    out, attempt, seq = [], 0, 0
    for _ in range(rnd.randrange(1, 9)):
        seq += 1
        kind = rnd.choice(["created", "progress", "progress", "progress", "failed", "completed"] if rnd.random() < 0.9 else ["failed"])
        out.append((job, attempt, seq, kind, None if kind in ("created", "failed") else rnd.randrange(60), datetime.datetime(2026, 1, 1)))
        if kind == "failed":
            attempt, seq = attempt + 1, 0
    return out


def write_files(spark, tmp_path, events, files):
    for k in range(files):
        spark.createDataFrame(events[k::files], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def run(spark, tmp_path, name, **kw):
    stream = S.track(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), **kw)
    for k, v in S.BOUNDED.items():
        spark.conf.set(k, v)
    try:
        q = stream.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    finally:
        for k in S.BOUNDED:
            spark.conf.unset(k)
    return q


def final(spark, q, name):
    """The last row of each job: the memory sink keeps the order of batches."""
    return {r.job: tuple(r)[1:] for r in spark.table(name).collect()}


def test_shuffled_files_equal_replay(rocks, tmp_path):
    rnd = random.Random(11)
    events = [e for job in range(60) for e in life(rnd, job)]
    sent = events + rnd.sample(events, 40)  # some twice
    rnd.shuffle(sent)
    write_files(rocks, tmp_path, sent, 5)
    q = run(rocks, tmp_path, "shuffled")
    want = {r.job: tuple(r)[1:] for r in S.replay(rocks.createDataFrame(events, SCHEMA)).collect()}
    assert len(q.recentProgress) >= 5 and final(rocks, q, "shuffled") == want
    assert {w[0] for w in want.values()} == {"PENDING", "PROCESSING", "SUCCEEDED", "FAILED"}


def test_late_failure_takes_its_place(rocks, tmp_path):
    at = datetime.datetime(2026, 1, 1)
    write_files(rocks, tmp_path, [(1, 1, 1, "completed", 9, at)], 1)
    write_files(rocks, tmp_path, [(1, 0, 2, "failed", None, at), (1, 0, 1, "progress", 4, at)], 1)
    q = run(rocks, tmp_path, "late")
    rows = [tuple(r) for r in rocks.table("late").collect()]
    assert rows[0] == (1, "PENDING", 0, 0, 0) and rows[-1] == (1, "SUCCEEDED", 1, 1, 9), rows


def test_waiting_events_count_after_the_timer(rocks, tmp_path):
    write_files(rocks, tmp_path, [(1, 2, 1, "progress", 7, datetime.datetime(2026, 1, 1))], 1)
    stream = S.track(rocks.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), patience=datetime.timedelta(seconds=1))
    q = stream.writeStream.outputMode("update").format("memory").queryName("timer").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(120):
            if rocks.table("timer").filter("processed = 7").count():
                break
            time.sleep(0.5)
        assert [r.status for r in rocks.table("timer").collect()] == ["PENDING", "PROCESSING"]
    finally:
        q.stop()


def test_restart_begins_with_the_stored_jobs(rocks, tmp_path):
    at = datetime.datetime(2026, 1, 1)
    jobs = rocks.createDataFrame([(1, "PROCESSING", 0, 0, 5), (2, "PROCESSING", 2, 2, 5), (3, "SUCCEEDED", 1, 1, 9)], "job long, status string, attempt int, retry_count int, processed long")
    write_files(rocks, tmp_path, [(1, 1, 1, "progress", 3, at), (1, 0, 9, "failed", None, at), (2, 2, 8, "progress", 50, at), (3, 1, 7, "failed", None, at), (4, 0, 1, "progress", 1, at)], 1)
    q = run(rocks, tmp_path, "restart", jobs=jobs)
    assert final(rocks, q, "restart") == {1: ("PROCESSING", 1, 1, 5), 2: ("FAILED", 2, 2, 5), 3: ("SUCCEEDED", 1, 1, 9), 4: ("PROCESSING", 0, 0, 1)}


def test_needed_events_give_the_same_state():
    rnd = random.Random(4)
    for job in range(500):
        events = [e[1:5] for e in life(rnd, job)] + [e[1:5] for e in life(rnd, job)]
        rnd.shuffle(events)
        k = rnd.randrange(len(events) + 1)
        fold = lambda es: [s := S.START, [s := S.step(s, e[2], e[3]) for e in es], s][2]  # noqa: E731, B023
        ordered = []
        for e in sorted(events, key=lambda e: e[:2]):
            if not ordered or e[:2] != ordered[-1][:2]:
                ordered.append(next(x for x in S.needed(S.needed(events[:k]) + events[k:]) + [e] if x[:2] == e[:2]))
        assert fold(S.needed(S.needed(events[:k]) + events[k:])) == fold(ordered)
    steps = [(0, i, "progress", i % 50) for i in range(100_000)]
    assert len(S.needed(steps)) == 50


@pytest.fixture
def store(spark, tmp_path):
    return CellStore(spark, f"file://{tmp_path}/store")


def rows(df):
    return sorted((r.job, r.row, r.col, r.code) for r in df.collect())


def test_replayed_batch_changes_nothing(spark, store):
    first = spark.createDataFrame([(1, 0, 0, "A1", 0.5, 1), (1, 0, 0, "A2", 0.4, 2), (1, 0, 1, "B1", 0.9, 1)], CELLS)
    assert store.apply_cells(first, 0) and rows(store.staged()) == [(1, 0, 0, "A2"), (1, 0, 1, "B1")]
    assert store.apply_cells(spark.createDataFrame([(1, 0, 1, "B2", 0.1, 0)], CELLS), 1)
    before = store.commits()
    assert not store.apply_cells(first, 0) and store.commits() == before and rows(store.staged()) == [(1, 0, 0, "A2"), (1, 0, 1, "B2")]
    assert store.compact() == 2 and rows(store.staged()) == [(1, 0, 0, "A2"), (1, 0, 1, "B2")]
    assert not store.apply_cells(first, 0) and not store.apply_cells(first, 1) and store.apply_cells(first, 2)
    assert rows(store.staged()) == [(1, 0, 0, "A2"), (1, 0, 1, "B1")]


def test_failed_task_leaves_no_rows(spark, store, tmp_path):
    good = spark.createDataFrame([(1, 0, k, f"A{k}", 0.5, 1) for k in range(8)], CELLS)
    store.apply_cells(good, 0)
    bad = good.repartition(4).withColumn("code", F.when(F.col("col") == 7, F.raise_error(F.lit("lost"))).otherwise("Z9"))
    with pytest.raises(Exception, match="lost"):
        store.apply_cells(bad, 1)
    assert rows(store.staged()) == rows(good) and len(store.commits()) == 1
    assert [p.name for p in (tmp_path / "store").iterdir()] == store.commits()
    assert store.apply_cells(good.limit(0), 1)


def test_completion_is_one_commit(spark, store):
    store.apply_cells(spark.createDataFrame([(j, 0, k, "A1", 0.5, 1) for j in (1, 2) for k in range(j)], CELLS), 0)
    jobs = spark.createDataFrame([(1, 1, 2, 2), (2, 1, 2, 2)], "id long, rows int, cols int, total_cells long")
    assert store.complete(jobs, 0) and not store.complete(jobs, 0)
    assert [r.job for r in store.blueprints().collect()] == [2] and store.blueprint_cells().count() == 2
    assert rows(store.staged()) == [(1, 0, 0, "A1")]
    store.apply_cells(spark.createDataFrame([(1, 0, 1, "B1", 0.5, 1)], CELLS), 1)
    assert store.complete(jobs, 1) and store.staged().count() == 0 and sorted(r.job for r in store.blueprints().collect()) == [1, 2]
    store.compact()
    assert store.blueprint_cells().count() == 4 and store.staged().count() == 0 and len(store.commits()) == 1


def test_stream_into_the_store(spark, store, tmp_path):
    for k in range(3):
        spark.createDataFrame([(1, 0, 0, f"A{k}", 0.5, 1), (1, 1, k, "B1", 0.5, 1)], CELLS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(CELLS).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(store.sink()).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert rows(store.staged()) == [(1, 0, 0, "A2"), (1, 1, 0, "B1"), (1, 1, 1, "B1"), (1, 1, 2, "B1")]
    for c in list((tmp_path / "cp" / "commits").iterdir()):  # the last batch counts as not committed and is sent again
        if c.name.strip(".").startswith("2"):
            c.unlink()
    before = store.commits()
    spark.readStream.schema(CELLS).parquet(str(tmp_path / "in")).writeStream.foreachBatch(store.sink()).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert store.commits() == before


def test_following_ends_by_itself(rocks, tmp_path):
    at = datetime.datetime(2026, 1, 1)
    write_files(rocks, tmp_path, [(1, 0, 1, "progress", 3, at), (2, 0, 1, "completed", 4, at)], 1)
    states = S.track(rocks.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
    assert not S.follow(states, f"{tmp_path}/out", f"{tmp_path}/cp", "500 milliseconds", most=15)  # job 1 is under way
    write_files(rocks, tmp_path, [(1, 0, 2, "completed", 9, at)], 1)
    began = time.time()
    assert S.follow(states, f"{tmp_path}/out", f"{tmp_path}/cp", "500 milliseconds", most=120) and time.time() - began < 100
    assert {r.job: (r.status, r.processed) for r in S.shown(rocks, f"{tmp_path}/out").collect()} == {1: ("SUCCEEDED", 9), 2: ("SUCCEEDED", 4)}


def test_registry_follows_new_versions(rocks, tmp_path):
    from gridloom.sources import sinks
    from gridloom.streaming import registry

    def publish(*models):
        rows = [(i, json.dumps(m), ["<blank>"], bytearray(b"w")) for i, m in models]
        sinks.publish_artifacts(rocks.createDataFrame(rows, "id string, manifest string, charset array<string>, model binary"), f"file://{tmp_path}/r")

    def run_once():
        q = registry.follow(rocks, f"{tmp_path}/r").writeStream.outputMode("update").foreachBatch(lambda df, k: seen.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    seen = []
    publish(("a1", {"name": "bead", "version": "v9"}), ("b1", {"version": "v1"}), ("bad", {"name": "bead", "version": "next"}))
    run_once()
    assert sorted(seen) == [("b1", "b1", "v1", 1, None), ("bead", "a1", "v9", 9, None)]
    seen.clear()
    publish(("a2", {"name": "bead", "version": "v10"}), ("a0", {"name": "bead", "version": "v2"}))
    run_once()
    assert seen == [("bead", "a2", "v10", 10, "a1")]
    seen.clear()
    publish(("a3", {"name": "bead", "version": "v3"}))
    run_once()
    assert seen == []
