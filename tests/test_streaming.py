"""Streaming jobs: what a stream gives equals the batch, or a replay of the events one by one."""

import datetime as dt

import pytest

from foliant.streaming import jobs

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    import random

    r = random.Random(2)
    at, out = 0.0, []
    for i in range(240):
        at += r.choice([1, 5, 20, 40, 2000])
        out.append((i, START + dt.timedelta(seconds=at), r.randint(1, 3), r.choice("ab"), float(r.randint(-20, 120))))
    return out


def streamed(spark, tmp_path, rows, job, mode="append"):
    """Rows written as three files, read as a stream that ends, through a job into a table."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    for i in range(3):
        spark.createDataFrame(rows[i * 80 : (i + 1) * 80], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = "t" + tmp_path.name.replace("-", "_")
    job(events).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination(120)
    return spark.table(name).collect(), spark.createDataFrame(rows, schema)


def test_sliding_usage_and_sessions_equal_the_batch(spark, tmp_path, rows):
    for k, job in enumerate((jobs.sliding_usage, jobs.sessions, jobs.usage)):
        (tmp_path / str(k)).mkdir()
        got, batch = streamed(spark, tmp_path / str(k), rows, job, "complete" if job is not jobs.sessions else "append")
        want = {tuple(r) for r in job(batch).collect()}
        # An append stream keeps back what its watermark has not passed.
        assert {tuple(r) for r in got} <= want if job is jobs.sessions else {tuple(r) for r in got} == want
        assert len(got) > 0.8 * len(want)


def test_events_come_once(spark, tmp_path, rows):
    got, _ = streamed(spark, tmp_path, rows[:120] + rows[:120], jobs.once)
    assert sorted(r.event_id for r in got) == list(range(120))


def test_admission_equals_a_replay(spark, tmp_path, rows):
    got, _ = streamed(spark, tmp_path, rows, jobs.admit)
    held, want = {}, {}
    for i, ts, user, _, value in rows:
        now, units = ts.timestamp(), max(value, 0.0)
        mine = [(t, u) for t, u in held.get(user, []) if t > now - 60]
        granted = sum(u for _, u in mine) + units <= 200
        held[user] = mine + [(now, units)] * granted
        want[i] = granted
    assert {r.event_id: r.granted for r in got} == want
