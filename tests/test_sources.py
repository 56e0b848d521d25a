"""Readers, coercion and the run store."""

from __future__ import annotations

import json

from taskloom.sources.events import coerce_events, read_events, read_json, read_large_events, read_ndjson

LINE = {"sourceEventType": "app.switch", "timestamp": "2026-03-14T09:00:00Z", "metadata": {"a": 1}}


def _kinds(frame):
    accepted, rejected = coerce_events(frame)
    return sorted(r["source_event_type"] for r in accepted.collect()), rejected.count()


def test_ndjson_skips_blank_and_keeps_bad_lines_aside(spark, tmp_path):
    path = tmp_path / "e.ndjson"
    path.write_text(json.dumps(LINE) + "\n\n" + json.dumps({**LINE, "sourceEventType": " "}) + "\n{bad\n")
    assert _kinds(read_ndjson(spark, str(path))) == (["app.switch"], 2)


def test_json_forms(spark, tmp_path):
    forms = {"array": [LINE, LINE], "wrapper": {"events": [LINE, LINE]}, "single": LINE}
    for name, value in forms.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(value, indent=1))
        kinds, rejected = _kinds(read_json(spark, str(path)))
        assert (len(kinds), rejected) == (1 if name == "single" else 2, 0), name


def test_reader_choice(spark, tmp_path):
    path = tmp_path / "events.txt"
    path.write_text(json.dumps([LINE, LINE]))
    assert len(_kinds(read_events(spark, str(path)))[0]) == 2


def test_defaults(spark, tmp_path):
    path = tmp_path / "d.jsonl"
    path.write_text(json.dumps({"sourceEventType": " a.b.open ", "timestamp": "2026-03-14T18:00:00+09:00"}))
    row = coerce_events(read_events(spark, str(path)))[0].first()
    assert (row["source"], row["application"], row["action"], row["source_event_type"]) == (
        "chrome_extension", "chrome", "open", "a.b.open")
    assert row["metadata"] == "{}" and row["stream_id"] == "local"


def test_large_json_is_read_in_pieces(spark, tmp_path):
    odd = [
        {**LINE, "target": 'say "}{][" \\ back\\\\', "metadata": {"a": [{"b": "}"}, [1, {"c": '"{'}]]}},
        {**LINE, "target": "line\nbreak \u00e9 \u2028 }\\", "metadata": {}},
        {**LINE, "windowTitle": "x" * 700 + "}" * 5, "target": ""},
    ]
    events = [{**odd[i % 3], "seq": i} for i in range(200)]
    forms = {"array": (events, 1), "wrapper": ({"events": events}, None), "none": ([], 1), "empty": ({"events": []}, None)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    opened = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for name, (value, indent) in forms.items():
            path = tmp_path / f"{name}.json"
            path.write_text(json.dumps(value, indent=indent, ensure_ascii=name == "array"))
            spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
            columns = ["seq", "sourceEventType", "target", "windowTitle", "metadata"]
            expected = sorted(map(tuple, read_json(spark, str(path)).select(columns).filter("sourceEventType IS NOT NULL").collect()))
            for size in ("333", "5000", "128m"):
                spark.conf.set("spark.sql.files.maxPartitionBytes", size)
                got = read_large_events(spark, str(path)).select(*columns, "_corrupt_record").collect()
                assert all(r[-1] is None for r in got)
                plain = [(*r[:4], json.dumps(json.loads(r[4]))) for r in got]
                assert sorted(plain) == [(*e[:4], json.dumps(json.loads(e[4]))) for e in expected], (name, size)
                assert len(got) == (200 if name in ("array", "wrapper") else 0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", opened)


def test_large_json_keeps_what_is_broken_aside(spark, tmp_path):
    path = tmp_path / "cut.json"
    path.write_text("[" + json.dumps(LINE) + ', {"sourceEventType": 5.5.5}, ' + json.dumps(LINE) + ', {"sourceEv')
    rows = read_large_events(spark, str(path)).collect()
    assert sorted((r["sourceEventType"] is not None, r["_corrupt_record"] is not None) for r in rows) == [
        (False, True), (False, True), (True, False), (True, False)
    ]
