"""State per key over several batches and restarts."""

from __future__ import annotations

from prismata.streaming import state as st

from .test_streams_and_sources import SCHEMA, at, land


def test_first_price_is_kept_over_restarts(spark, tmp_path):
    path = str(tmp_path / "events")
    land(spark, path, 0, [(2, 1, at(2), 89.0), (1, 1, at(1), 100.0), (3, 2, at(1), 50.0), (9, None, at(1), 1.0), (10, 2, None, 1.0), (11, 2, at(2), None)])
    watch = lambda: st.run_stateful(st.price_watch(spark.readStream.schema(SCHEMA).parquet(path), "user_id", "ts", "value", "event_id"), "watch")
    first = {(r.id, r.key, r.value, r.threshold) for r in watch().collect()}
    assert first == {(2, "1", 89.0, 9000.0)}
    land(spark, path, 1, [(4, 1, at(3), 90.0), (5, 1, at(0), 10.0), (6, 2, at(4), 45.01), (7, 2, at(5), 45.0)])
    assert {(r.id, r.key, r.value, r.threshold) for r in watch().collect()} == first | {(4, "1", 90.0, 9000.0), (5, "1", 10.0, 9000.0), (7, "2", 45.0, 4500.0)}
    assert {r.id for r in watch().collect()} == {2, 4, 5, 7}  # nothing new, nothing twice


def test_silent_keys_come_out_once_and_may_return(spark, tmp_path):
    path = str(tmp_path / "events")
    stale = lambda: sorted((r.last, r.key) for r in st.run_stateful(st.gone_stale(spark.readStream.schema(SCHEMA).parquet(path), "user_id", "ts"), "stale").collect())
    land(spark, path, 0, [(1, 1, at(0), 1.0), (2, 2, at(5), 1.0), (3, 3, at(90), 1.0)])
    assert stale() == []  # the watermark stands at 66 hours, the timers at 72 and 77
    land(spark, path, 1, [(4, 3, at(100), 1.0)])
    assert stale() == [(at(0), "1")]
    land(spark, path, 2, [(5, 1, at(102), 1.0), (6, 3, at(130), 1.0)])
    assert stale() == [(at(0), "1"), (at(5), "2")]
    land(spark, path, 3, [(7, 3, at(300), 1.0)])
    assert stale() == [(at(0), "1"), (at(5), "2"), (at(102), "1")]  # key 3 was seen again before its timer ran out


def test_alerts_round_as_their_sql(spark, tmp_path):
    """Halves of a cent go away from zero, and nine tenths of a price are its 90 cents."""
    path = str(tmp_path / "events")
    land(spark, path, 0, [(1, 1, at(1), 0.35), (2, 1, at(2), 0.32), (3, 1, at(3), 0.31), (4, 2, at(1), 0.133), (5, 2, at(2), 0.125)])
    out = st.run_stateful(st.price_watch(spark.readStream.schema(SCHEMA).parquet(path), "user_id", "ts", "value", "event_id"), "halves")
    assert {(r.id, r.threshold) for r in out.collect()} == {(3, 31.0)}


def test_keys_of_one_bucket_fall_silent_each_at_its_time(spark, tmp_path):
    """Python and its timers are called once for a bucket; keys in it come out, stay and return by themselves."""
    path = str(tmp_path / "events")
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(path)
    stale = lambda: sorted((r.last, int(r.key)) for r in st.run_stateful(st.gone_stale(stream(), "user_id", "ts", buckets=1), "bucket").collect())
    land(spark, path, 0, [(k, k, at(k), 1.0) for k in range(60)] + [(900, 0, at(0.5), 1.0), (901, 999, at(100), 1.0), (902, None, at(0), 1.0), (903, 5, None, 1.0)])
    first = [(at(k or 0.5), k) for k in range(5)]  # the watermark stands at 76 hours: 4 is due at 76
    assert stale() == first
    land(spark, path, 1, [(1000, 7, at(101), 1.0), (1001, 2, at(99), 1.0), (1002, 999, at(110), 1.0)])
    second = first + [(at(k), k) for k in range(5, 15) if k != 7]
    assert stale() == second  # 7 was seen again, 2 is tracked anew
    land(spark, path, 2, [(1003, 999, at(400), 1.0)])
    assert stale() == sorted(second + [(at(k), k) for k in range(15, 60)] + [(at(99), 2), (at(101), 7)])
