"""Golden cases, boundaries, splitting and merging, clustering exactness."""

from __future__ import annotations

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from fixtures import ADMIN, GOLDEN, NAV, at, event, golden_events, raw
from taskloom.functions.similarity import sequence_score
from taskloom.operators.leaders import assign_clusters
from taskloom.operators.feedback import fold_feedback
from taskloom.operators.inspect import explain_membership, layer_coverage
from taskloom.operators.label import label_events
from taskloom.operators.normalize import normalize_events
from taskloom.operators.report import report_cycle, resolve_window
from taskloom.operators.sessions import assign_sessions, roll_up_sessions, session_steps
from taskloom.options import AnalyzeOptions, ClusterOptions, SessionOptions
from taskloom.plans.analysis import analyze
from taskloom.plans.materialize import materialize
from taskloom.schema import FEEDBACK


@pytest.fixture(scope="module")
def golden(spark):
    return analyze(materialize(raw(spark, golden_events())))


def test_golden_sessions(golden):
    rows = golden.sessions.orderBy("stream_id", "start_time").collect()
    for name, (_, _, _, second) in GOLDEN.items():
        reasons = [r["boundary_reason"] for r in rows if r["stream_id"] == name]
        assert reasons == ["stream_start", second, second], name


def test_golden_workflows(golden):
    rows = {r["stream_id"]: r for r in golden.clusters.collect()}
    assert set(rows) == set(GOLDEN)
    for name, (_, workflow, sequence, _) in GOLDEN.items():
        assert rows[name]["name"] == workflow
        assert list(rows[name]["representative_sequence"]) == sequence
        assert rows[name]["frequency"] == 3
    assert rows["ops-handoff"]["recommended_approach"] == "Excel macro"
    assert rows["order-review"]["automation_suitability"] == "high"
    assert rows["order-review"]["representative_steps"][0] == "Open Admin in Chrome (Order #{Id} Admin)"


def test_no_unknown_actions(golden):
    counts = {r["layer"]: r["event_count"] for r in layer_coverage(golden.events).collect()}
    assert counts["unknown"] == 0


def _sessions(spark, events, options=SessionOptions()):
    labelled = materialize(label_events(normalize_events(materialize(raw(spark, events)))))
    return materialize(assign_sessions(labelled, options, reuse=False))


def _reasons(assigned):
    rows = roll_up_sessions(assigned).orderBy("start_order").collect()
    return [(r["boundary_reason"], r["step_count"]) for r in rows]


def test_reset_after_interruption(spark):
    assigned = _sessions(spark, [
        event(0, "order_search", NAV, url=f"{ADMIN}/orders"),
        event(30, "send_status_reply", "app.switch", "Slack"),
        event(100, "edit_product", NAV, url=f"{ADMIN}/product/123/edit"),
    ])
    assert _reasons(assigned) == [("stream_start", 2), ("reset_after_interruption", 1)]


def _interrupted(quiet):
    orders = f"{ADMIN}/orders"
    return [
        event(0, "orders_report", NAV, url=orders),
        event(30, "search_order", url=orders),
        event(60, "status_dropdown", url=orders),
        event(90, "send_status_reply", "app.switch", "Slack"),
        event(90 + quiet, "search_order", url=orders),
    ]


def test_rolling_context_suppresses(spark):
    assert _reasons(_sessions(spark, _interrupted(80))) == [("stream_start", 5)]


def test_rolling_context_needs_the_window(spark):
    narrow = SessionOptions(rolling_window_ms=100_000)
    assert [r for r, _ in _reasons(_sessions(spark, _interrupted(80), narrow))] == [
        "stream_start", "context_shift"]


@pytest.mark.parametrize("slice_ms", [10_000, 60_000, 3_600_000])
def test_slices_do_not_change_sessions(spark, slice_ms):
    random.seed(5)
    second, events = 0.0, []
    for _ in range(120):
        second += random.choice([5, 20, 61, 76, 90, 149, 150, 151, 400])
        target = random.choice(["search_order", "status", "send_report", None])
        app = random.choice(["chrome", "chrome", "slack"])
        events.append(event(second, target, random.choice([NAV, "browser.click"]), app, url=random.choice([f"{ADMIN}/orders", f"{ADMIN}/refunds", None])))
    whole = SessionOptions(slice_ms=10**12)
    labelled = materialize(label_events(normalize_events(materialize(raw(spark, events)))).drop("slice"))
    expected = assign_sessions(labelled, whole).select("seq", "session_seq", "boundary_reason").orderBy("seq").collect()
    found = assign_sessions(labelled, SessionOptions(slice_ms=slice_ms)).select("seq", "session_seq", "boundary_reason").orderBy("seq").collect()
    assert found == expected
    steps = session_steps(assign_sessions(labelled, SessionOptions(slice_ms=slice_ms)))
    bad = steps.groupBy("session_seq").agg(F.max("step_order").alias("m"), F.count("*").alias("n")).filter("m <> n")
    assert bad.isEmpty()


def test_calendar_signal_splits_and_is_no_step(spark):
    signal = {"calendarSignal": {"signalType": "meeting_start", "signalOnly": True}}
    assigned = _sessions(spark, [
        event(0, "search_order", url=f"{ADMIN}/orders"),
        event(10, kind="calendar.meeting.start", app="gws-calendar", **signal),
        event(20, "search_order", url=f"{ADMIN}/orders"),
    ])
    assert _reasons(assigned) == [("stream_start", 1), ("calendar_signal", 1)]


def test_mixed_offsets_and_unreadable_times(spark):
    assigned = _sessions(spark, [
        event("2026-03-14T18:00:30+09:00", "search_order", url=f"{ADMIN}/orders"),
        event(at(0), "search_order", url=f"{ADMIN}/orders"),
        event("not a time", "search_order", url=f"{ADMIN}/orders"),
    ])
    order = [r["seq"] for r in assigned.orderBy("ms", "tie", "seq").collect()]
    assert order == [1, 0, 2]
    assert _reasons(assigned) == [("stream_start", 3)]


def test_streams_do_not_mix(spark):
    a = [{**e, "stream_id": "a"} for e in _interrupted(200)]
    b = [{**e, "stream_id": "b", "seq": i} for i, e in enumerate(_interrupted(80))]
    both = roll_up_sessions(_sessions(spark, a + b))
    alone = roll_up_sessions(_sessions(spark, a))
    mixed = both.filter("stream_id = 'a'").select("session_id").collect()
    assert sorted(mixed) == sorted(alone.select("session_id").collect())


SPLIT = [
    event(0, kind=NAV, url="https://admin.internal/orders", domain="admin.internal"),
    event(30, "search_order", domain="admin.internal"),
    event(60, "update_status", domain="admin.internal"),
]
LAX = AnalyzeOptions(clusters=ClusterOptions(min_frequency=1, min_duration_seconds=0))


def _feedback(spark, **fields):
    base = dict.fromkeys([f.split()[0] for f in FEEDBACK.split(", ")])
    row = {**base, "id": "1", "created_at": "2026-03-15", "workflow_cluster_id": "x", **fields}
    return fold_feedback(spark.createDataFrame([tuple(row.values())], FEEDBACK))


def test_split_feedback(spark):
    import hashlib

    legacy = hashlib.sha1(b"workflow_signature:open_admin>search_order>update_status").hexdigest()
    feedback = _feedback(spark, workflow_signature=legacy, split_after_action_name="search_order")
    run = analyze(materialize(raw(spark, SPLIT)), LAX, feedback)
    rows = run.described.orderBy("start_order").collect()
    assert [list(r["actions"]) for r in rows] == [["open_admin", "search_order"], ["update_status"]]
    assert rows[1]["boundary_details"]["split_after"] == "search_order"


def test_merge_feedback(spark):
    events = [{**e, "stream_id": "s"} for e in golden_events() if e["stream_id"] in ("order-review", "sheet-share")]
    for i, e in enumerate(events):
        e["seq"] = i
        e["timestamp"] = at(i // 3 * 400 + i % 3 * 30)
    plain = analyze(materialize(raw(spark, events))).clusters.collect()
    assert len(plain) == 2
    first, second = plain[0]["workflow_signature"], plain[1]["workflow_signature"]
    feedback = _feedback(spark, workflow_signature=first, merge_into_workflow_signature=second)
    run = analyze(materialize(raw(spark, events)), feedback=feedback)
    merged = run.clusters.collect()
    assert len(merged) == 1 and merged[0]["frequency"] == 6 and merged[0]["workflow_signature"] == second
    assert run.bridge.count() == 6


# --- clustering against the plain sequential rule ---------------------------------


def _overlap(a, b):
    u = set(a) | set(b)
    return len(set(a) & set(b)) / len(u) if u else 1.0


def _total(a, b):
    apart = abs(a["start_minute"] - b["start_minute"])
    day = max(0, 1 - min(apart, 1440 - apart) / 720)
    return ((sequence_score(a["tokens"], b["tokens"]) * 0.35 + _overlap(a["action_set"], b["action_set"]) * 0.25)
            + _overlap(a["contexts"], b["contexts"]) * 0.25) + day * 0.15


def _plain_loop(rows, threshold):
    clusters = []
    for r in rows:
        best, top = None, 0
        for members in clusters:
            two = sorted((_total(m, r) for m in members), reverse=True)[:2]
            score = sum(two) / len(two)
            if score >= threshold and score > top:
                best, top = members, score
        if best is None:
            clusters.append([r])
        else:
            best.append(r)
    return {m["session_seq"]: members[0]["session_seq"] for members in clusters for m in members}


def _random_sessions(seed, n=70):
    rng = random.Random(seed)
    shapes = []
    for _ in range(12):
        words = [rng.choice("abcdef") for _ in range(rng.randint(1, 4))]
        actions = [w for i, w in enumerate(words) if i == 0 or w != words[i - 1]]
        shapes.append((actions, [f"domain:{rng.choice('xyz')}"]))
    rows = []
    for i in range(n):
        actions, contexts = rng.choice(shapes)
        minute = rng.choice([0, 5, 300, 700])
        rows.append({
            "stream_id": "s", "session_seq": i, "start_time": f"2026-01-01T{i:06d}",
            "start_order": {"ms": i, "seq": i}, "tokens": [f"chrome|{a}" for a in actions],
            "actions": actions, "action_set": sorted(set(actions)), "contexts": contexts,
            "start_minute": minute, "descriptor": f"{actions}{contexts}{minute}",
        })
    return rows


SESSION_SCHEMA = (
    "stream_id string, session_seq long, start_time string, start_order struct<ms: long, seq: long>, "
    "tokens array<string>, actions array<string>, action_set array<string>, contexts array<string>, "
    "start_minute int, descriptor string"
)


@pytest.mark.parametrize("seed,threshold", [(1, 0.5), (2, 0.74), (3, 0.86), (4, 0.74)])
def test_clusters_equal_the_sequential_rule(spark, seed, threshold):
    rows = _random_sessions(seed)
    frame = spark.createDataFrame(rows, SESSION_SCHEMA).repartition(5)
    options = ClusterOptions(similarity_threshold=threshold)
    found = assign_clusters(frame, options).select("session_seq", "cluster_seq").collect()
    assert {r[0]: r[1] for r in found} == _plain_loop(rows, threshold)


@pytest.mark.parametrize("seed,threshold,strategy", [(9, 0.74, "hybrid_v2"), (11, 0.86, "hybrid_v2"), (12, 0.5, "hybrid_v2"), (13, 0.8, "legacy")])
def test_waves_change_no_result(spark, monkeypatch, seed, threshold, strategy):
    from taskloom.operators import leaders

    rows = _random_sessions(seed, 120) + [{**r, "stream_id": "t"} for r in _random_sessions(seed + 20, 25)]
    for i, r in enumerate(rows):
        r["start_time"] = f"2026-01-0{1 + i % 120 // 50}T{i:06d}"
    frame = spark.createDataFrame(rows, SESSION_SCHEMA).repartition(5)
    options = ClusterOptions(similarity_threshold=threshold, strategy=strategy)
    monkeypatch.setattr(leaders, "BLOCK", 7)

    def got(wave):
        found = assign_clusters(frame, options, wave).select("stream_id", "session_seq", "cluster_seq").collect()
        return {(r[0], r[1]): r[2] for r in found}

    whole = got(1000)
    assert got(20) == whole
    if strategy != "legacy":
        for stream in "st":
            own = [r for r in rows if r["stream_id"] == stream]
            assert {k[1]: v for k, v in whole.items() if k[0] == stream} == _plain_loop(own, threshold)


def test_membership_equals_all_pairs(spark):
    rows = _random_sessions(6, 40)
    frame = spark.createDataFrame(rows, SESSION_SCHEMA).withColumn("cluster_seq", F.lit(0).cast("long"))
    for block in (3, 1000):
        found = {r["session_seq"]: r for r in explain_membership(frame, block=block).collect()}
        for me in rows:
            others = sorted(
                (-(int(_total(o, me) * 100 + 0.5) / 100), o["start_time"], o["session_seq"])
                for o in rows if o["session_seq"] != me["session_seq"]
            )[:3]
            peers = found[me["session_seq"]]["peers"]
            assert [p["peer_seq"] for p in peers] == [o[2] for o in others]
            assert [p["peer_actions"] for p in peers] == [rows[o[2]]["actions"] for o in others]


def test_membership_of_many_small_workflows(spark):
    rows = _random_sessions(9, 90)
    # Workflows of one, two and more sessions of two streams, and one beyond a block.
    flow = [i % 30 if i < 45 else 30 for i in range(90)]
    rows = [{**r, "stream_id": "st"[c % 2 if c < 30 else 0]} for r, c in zip(rows, flow)]
    frame = spark.createDataFrame(rows, SESSION_SCHEMA)
    homes = spark.createDataFrame([(r["session_seq"], c) for r, c in zip(rows, flow)], "session_seq long, cluster_seq long")
    frame = frame.join(homes, "session_seq")
    for block in (4, 20, 1000):
        found = {r["session_seq"]: r for r in explain_membership(frame, block=block).collect()}
        assert len(found) == len(rows)
        for me, c in zip(rows, flow):
            others = sorted(
                (-(int(_total(o, me) * 100 + 0.5) / 100), o["start_time"], o["session_seq"])
                for o, d in zip(rows, flow) if d == c and o["session_seq"] != me["session_seq"]
            )
            got = found[me["session_seq"]]
            assert [p["peer_seq"] for p in got["peers"]] == [o[2] for o in others[:3]]
            assert got["comparison_window"] == min(2, len(others))
            mean = sum(-o[0] for o in others[:2]) / max(1, min(2, len(others)))
            assert got["membership_score"] == int(mean * 100 + 0.5) / 100


def test_membership_scores_few_pairs():
    from taskloom.operators.inspect import best_peers

    rows = [SimpleNamespace(cluster_seq=0, sessions=[r], **r) for r in _random_sessions(8, 400)]
    out, scored = best_peers(rows, rows, (0.35, 0.25, 0.25, 0.15))
    assert len(out) == 4 * len(rows) and scored < len(rows) ** 2 / 10


def test_benchmark_hybrid_beats_sequence_only(spark):
    from taskloom.operators.inspect import benchmark_clusters

    shapes = [["open_admin", "search_order", "review_order", "update_status"],
              ["open_admin", "review_order", "search_order", "update_status"]]
    rows = []
    for i, (hour, site, shape) in enumerate([(9, "admin", 0), (15, "support", 0), (9, "admin", 1), (15, "support", 1)]):
        actions = shapes[shape]
        rows.append({
            "stream_id": "s", "session_seq": i, "start_time": f"2026-03-{10 + i}T{hour}", "start_order": {"ms": i, "seq": i},
            "tokens": [f"chrome|{a}" for a in actions], "actions": actions, "action_set": sorted(actions),
            "contexts": [f"domain:{site}.internal"], "start_minute": hour * 60, "descriptor": f"{site}{shape}",
        })
    frame = spark.createDataFrame(rows, SESSION_SCHEMA)
    labels = frame.select(F.col("session_seq").alias("session_id"), F.col("contexts")[0].alias("expected"))
    errors = {}
    for strategy in ("legacy", "hybrid_v2"):
        found = assign_clusters(frame, ClusterOptions(strategy=strategy))
        pairs = found.select(F.col("session_seq").alias("session_id"), F.col("cluster_seq").alias("cluster_id"))
        errors[strategy] = benchmark_clusters(pairs, labels).first()
    assert errors["hybrid_v2"]["false_merges"] == 0 and errors["hybrid_v2"]["false_splits"] == 0
    assert errors["legacy"]["false_merges"] > 0 and errors["legacy"]["false_splits"] > 0


def test_report_cycle(spark):
    events = [e for e in golden_events() if e["stream_id"] == "order-review"]
    windows = [resolve_window("day", "2026-03-14"), resolve_window("week", "2026-03-13")]
    rows = report_cycle(materialize(raw(spark, events)), windows, F.lit("2026-03-15").cast("timestamp")).collect()
    assert [(r["window"], r["total_sessions"], len(r["workflows"])) for r in rows] == [("day", 3, 1)]


def test_window_rules():
    week = resolve_window("week", "2026-03-14", 540)
    assert (week.start.isoformat(), week.end.isoformat()) == ("2026-03-07T15:00:00+00:00", "2026-03-14T15:00:00+00:00")
    assert week.shifted().report_date == "2026-03-07"
    for bad in ("2026-02-30", "14.03.2026"):
        with pytest.raises(ValueError):
            resolve_window("day", bad)


def test_lcs_against_table():
    from taskloom.functions.similarity import lcs_length

    rng = random.Random(0)
    for _ in range(200):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 9))]
        b = [rng.choice("abc") for _ in range(rng.randint(0, 9))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                t[i][j] = t[i - 1][j - 1] + 1 if x == y else max(t[i - 1][j], t[i][j - 1])
        assert lcs_length(a, b) == t[-1][-1]


