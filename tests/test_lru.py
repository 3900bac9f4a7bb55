"""The cache's answers against an ordered dictionary that goes through all requests."""

from __future__ import annotations

import datetime
import random
from collections import OrderedDict

import pytest

from veldgraph.storage import load
from veldgraph.streaming import lru

SF = "/root/testdata/sf0.001"


def _plain(rows, capacity, ttl):  # noqa: ANN001, ANN202
    """id -> (cached, hit); rows are (id, key, seconds)."""
    held: OrderedDict = OrderedDict()
    out = {}
    for i, k, at in sorted(rows, key=lambda r: (r[2], r[0])):
        there = k in held
        hit = there and at - held[k] <= ttl
        out[i] = (there, hit)
        if not hit:
            held.pop(k, None)
            if len(held) >= capacity:
                held.popitem(last=False)
            held[k] = at
        held.move_to_end(k)
    return out


@pytest.mark.parametrize(("capacity", "ttl", "ranges"), [(1, 3600, 3), (3, 100_000, 7), (10, 86_400, None), (40, 10**9, 16), (1000, 3600, 5)])
def test_events(spark, capacity, ttl, ranges):
    events = load(spark, SF, "events")
    got = {r["id"]: (r["cached"], r["hit"]) for r in lru.hits(events, ["user_id", "event_type"], "ts", "event_id", capacity, ttl, ranges).collect()}
    start = datetime.datetime(2024, 1, 1)
    rows = [(r["event_id"], (r["user_id"], r["event_type"]), (r["ts"] - start).total_seconds()) for r in events.collect()]
    assert got == _plain(rows, capacity, ttl)


def test_ties_a_hot_key_and_empty_ranges(spark):
    rng = random.Random(1)
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, rng.choice(["hot", "hot", *"abcdefg", None]), start + datetime.timedelta(seconds=rng.randint(0, 40))) for i in range(600)]
    frame = spark.createDataFrame([*rows, (1000, "a", None)], "id long, key string, ts timestamp_ntz")
    for ranges in (1, 9, 64):
        got = {r["id"]: (r["cached"], r["hit"]) for r in lru.hits(frame, ["key"], "ts", "id", 4, 5, ranges).collect()}
        assert got == _plain([(i, k, (t - start).total_seconds()) for i, k, t in rows], 4, 5)
    assert lru.hits(frame.limit(0), ["key"], "ts", "id").count() == 0
