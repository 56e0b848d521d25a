"""What is written and shuffled on the way to sessions and workflows."""

from __future__ import annotations

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from taskloom.catalog import inputs as I
from taskloom.catalog import workflows as W
from taskloom.operators import clusters as C
from taskloom.operators import sessions as S
from taskloom.options import ClusterOptions
from taskloom.plans.materialize import materialize, scratch_dir
from taskloom.plans.slices import NO_TIME
from taskloom.streaming import live

KINDS = ["click", "view", "purchase", "signup", "error"]


def _plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def _shuffles(frame) -> int:
    return _plan(frame).count("Exchange hashpartitioning")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events of three users over some days, and pages, as the supplied tables have them."""
    path = str(tmp_path_factory.mktemp("tables"))
    n = 600
    events = pd.DataFrame(
        {
            "event_id": range(n),
            "ts": pd.to_datetime([1_704_067_200 + 12_701 * i for i in range(n)], unit="s"),
            "user_id": [i * i % 3 for i in range(n)],
            "event_type": [KINDS[i * 7 % 11 % 5] for i in range(n)],
            "value": 1.0,
            "props": ['{"k": %d}' % (i * i % 17) for i in range(n)],
        }
    )
    spark.createDataFrame(events).write.parquet(f"{path}/events.parquet")
    pages = [(i, f"https://shop.example.com/en/{i}") for i in range(20)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{path}/pages.parquet")
    return path


def _shuffle_files(spark) -> int:
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(f.startswith("shuffle_") for d in dirs for _, _, names in os.walk(d) for f in names)


def test_a_query_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert _shuffle_files(spark) <= before


def test_rows_kept_by_keys_are_read_without_a_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    kept = materialize(rows, "kept", ["k"])
    assert _shuffles(kept.groupBy("k", "id").count()) == 0
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, rows.collect()))


def test_whole_events_are_not_shuffled_for_their_sessions(spark, folder):
    """Nor are they for what is left of them in a session, but once."""
    events = I.labelled(spark, folder)
    assert _shuffles(events.groupBy("stream_id", "slice").count()) == 0
    assigned = I.assigned(spark, folder)
    assert _shuffles(S.roll_up_sessions(assigned)) == 1
    assert assigned.count() == 600 and NO_TIME not in {r.ms for r in assigned.select("ms").collect()}


def test_neighbours_read_only_what_is_compared(spark, folder):
    assert "contexts" not in _plan(W.g6(spark, folder)) and "tokens" in _plan(W.g6(spark, folder))


def test_lanes_write_a_member_once(spark, folder, monkeypatch):
    written = {}

    def recorded(frame, name="stage", *rest):
        written.setdefault(name, []).append(set(frame.columns))
        return materialize(frame, name, *rest)

    monkeypatch.setattr(C, "materialize", recorded)
    lax = ClusterOptions(min_frequency=1, min_duration_seconds=0)
    described = I.described(spark, folder)
    clusters, bridge = C.cluster_lane(described, I.assigned(spark, folder), lax)
    assert "assigned" not in written and not written["members"][0] & {"session_id", "boundary_details", "end_time"}
    assert bridge.count() == described.filter("size(actions) > 0").count() > 0
    assert clusters.agg(F.sum("frequency")).first()[0] == bridge.count()


def test_late_events_arrive_in_several_files_and_two_batches(spark, folder):
    before = set(os.listdir(_local(scratch_dir(spark))))
    from taskloom.catalog import reports

    rows = reports.l4(spark, folder).collect()
    base = next(x for x in set(os.listdir(_local(scratch_dir(spark)))) - before if x.startswith("late-"))
    base = f"{_local(scratch_dir(spark))}/{base}"
    assert sum(f.endswith(".parquet") for f in os.listdir(f"{base}/arriving")) > 2
    assert {x for x in os.listdir(f"{base}/events") if x.startswith("batch=")} == {"batch=0", "batch=1"}
    assert len(rows) > 0


def _local(path: str) -> str:
    return path.removeprefix("file:")


class _State(dict):
    """A map and a value as a processor sees them, counting what is sent."""

    sent = 0

    def updateValue(self, key, value):
        self.sent += 1
        self[key] = value

    def getValue(self, key):
        self.sent += 1
        return self[key]

    def removeKey(self, key):
        self.sent += 1
        del self[key]


class _Value:
    kept = None

    def exists(self):
        return self.kept is not None

    def get(self):
        return self.kept

    def update(self, value):
        self.kept = value

    def clear(self):
        self.kept = None


class _Timers:
    def __init__(self, mark):
        self.mark = mark

    def registerTimer(self, at):
        pass

    def getCurrentWatermarkInMs(self):
        return self.mark


def test_events_of_many_hours_wait_in_few_chunks():
    hour = live.HOUR
    processor = live.SessionProcessor(I.OPTIONS.sessions, 10**15)
    processor.handle, processor.session, processor.waiting = _Timers(0), _Value(), _State()
    fields = dict(zip(live._FIELDS, ("app", "site", None, None, None, "edit_order")))
    rows = pd.DataFrame([{"ms": i * 24 * hour, "seq": i, "signal": False, **fields} for i in reversed(range(600))])
    list(processor.handleInputRows(("a",), iter([rows]), None))
    assert 0 < processor.waiting.sent <= 3
    closed = []
    for days in (1, 299.5, 300, 10_000):
        for frame in processor.handleExpiredTimer(("a",), _Timers(int(days * 24 * hour)), None):
            closed += frame["session_seq"].tolist()
    assert closed == list(range(600)) and not processor.waiting
