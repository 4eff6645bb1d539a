"""Streams in several batches: late events, state between batches, and progress."""

import datetime
import os

import pytest

from loomstone.streaming.activity import event_buckets, run_to_end, user_totals

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture
def batches(spark, tmp_path):
    """Four files, read one by one: day 10; day 9; a late event of day 1; day 14."""
    day = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    rows = [[(1, day(10), 7, "a", 60.0, None), (2, day(10, 5), 8, "a", 10.0, None)], [(4, day(9), 7, "a", None, None)], [(3, day(1), 7, "a", 99.0, None)], [(5, day(14), 8, "b", 70.0, None)]]
    for k, part in enumerate(rows):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/w{k}")
        name = next(n for n in os.listdir(f"{tmp_path}/w{k}") if n.endswith(".parquet"))
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        os.rename(f"{tmp_path}/w{k}/{name}", f"{tmp_path}/in/{k}.parquet")
        os.utime(f"{tmp_path}/in/{k}.parquet", (1_700_000_000 + 100 * k,) * 2)
    return lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_late_events_are_dropped(spark, batches):
    progress = []
    found = run_to_end(event_buckets(batches(), "day", "2 days"), "append", progress.append)
    start = lambda d: int(datetime.datetime(2024, 1, d, tzinfo=datetime.timezone.utc).timestamp())
    told = {(r["bucket_start"], r["event_type"]): (r["events"], r["large"]) for r in found.collect()}
    assert told == {(start(9), "a"): (1, 0), (start(10), "a"): (2, 1)}  # day 1 came too late, day 14 is still open
    assert sum(p["late"] for p in progress) == 1 and sum(p["rows"] for p in progress) == 5 and progress[-1]["state"] >= 1
    whole = {(r["bucket_start"], r["event_type"]): r["events"] for r in run_to_end(event_buckets(batches())).collect()}
    assert whole[start(14), "b"] == 1 and whole[start(1), "a"] == 1  # complete mode keeps all state and drops nothing


def test_state_between_batches(spark, batches):
    rows = run_to_end(user_totals(batches()), "update").collect()
    of = lambda user: sorted(tuple(r)[1:3] for r in rows if r["user_id"] == user)
    assert of(7) == [(1, 60.0), (2, 60.0), (3, 159.0)] and of(8) == [(1, 10.0), (2, 80.0)]
