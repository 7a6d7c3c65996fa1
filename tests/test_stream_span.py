import pytest

from seatflow.catalog.streams import QUERIES


@pytest.mark.parametrize(("name", "keys"), [("stream_dedupe", 62), ("stream_latest", 31)])
def test_events_of_two_months_all_count(spark, tmp_path, name, keys):
    """A user has events on one day of both months, so of one arrival none may come too late."""
    days = [f"2024-{month:02}-{day:02} 12:00:00" for month in (1, 3) for day in range(1, 32)]
    data = [(100 + i, i % 31, "view", ts, 1.0) for i, ts in enumerate(days)]
    events = spark.createDataFrame(data, "event_id long, user_id long, event_type string, ts string, value double")
    sf = str(tmp_path / "sf")
    events.withColumn("ts", events.ts.cast("timestamp_ntz")).write.parquet(f"{sf}/events.parquet")
    got = QUERIES[name](spark, sf).collect()
    assert len(got) == keys
    if name == "stream_latest":
        assert {r["day"][:7] for r in got} == {"2024-03"}
