"""Authored events in the shapes the golden cases describe."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

from taskloom.operators.privacy import sanitize_events
from taskloom.schema import INCOMING
from taskloom.sources.events import coerce_events

DAY = datetime(2026, 3, 14, 9, tzinfo=timezone.utc)


def at(seconds: float, base: datetime = DAY) -> str:
    return (base + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


def event(second, target=None, kind="browser.click", app="chrome", url=None, title=None, **more):
    known = {f.name for f in INCOMING.fields}
    extra = {k: v for k, v in more.items() if k in known}
    meta = {k: v for k, v in more.items() if k not in known}
    return {
        "sourceEventType": kind,
        "timestamp": second if isinstance(second, str) else at(second),
        "application": app,
        "url": url,
        "windowTitle": title,
        "target": target,
        "metadata": json.dumps(meta),
        **extra,
    }


def incoming(spark, events, stream="local"):
    rows = []
    for i, e in enumerate(events):
        row = {f.name: e.get(f.name) for f in INCOMING.fields}
        row["stream_id"] = e.get("stream_id", stream)
        row["seq"] = e.get("seq", i)
        rows.append(tuple(row[f.name] for f in INCOMING.fields))
    return spark.createDataFrame(rows, INCOMING)


def raw(spark, events, stream="local"):
    return sanitize_events(coerce_events(incoming(spark, events, stream))[0])


def repeated(steps, times=3, apart=420):
    """The same steps several times, minutes apart. A step: (second, keyword arguments)."""
    return [event(n * apart + s, **dict(kw)) for n in range(times) for s, kw in steps]


ROUTE = {
    "browserContext": {
        "routeTaxonomy": {
            "source": "hash",
            "signature": "hash:/inbox/{id}",
            "routeTemplate": "/inbox/{id}",
            "primarySection": "inbox",
            "dynamicSegmentCount": 1,
        }
    }
}
ADMIN = "https://admin.example.com"
NAV = "chrome.navigation"
SHEET = "https://docs.google.com/spreadsheets/d/sheet_one_abc/edit"
BQ_META = {"browserContext": {"routeTaxonomy": {"source": "hash", "signature": "hash:/sqlworkspace", "routeTemplate": "/sqlworkspace"}}}
CAL = "https://calendar.google.com/calendar/u/0/r"

# case -> (steps, workflow name, representative sequence, second boundary reason)
GOLDEN = {
    "order-review": (
        [(0, dict(target="order_detail", kind=NAV, url=f"{ADMIN}/orders/1001", title="Order #1001 - Admin")),
         (25, dict(target="search_order", url=f"{ADMIN}/orders/1001", title="Order #1001 - Admin")),
         (70, dict(target="status_dropdown", url=f"{ADMIN}/orders/1001", title="Order #1001 - Admin"))],
        "Search Order workflow", ["open_admin", "search_order", "update_status"], "idle_gap"),
    "product-edit": (
        [(0, dict(kind=NAV, url=f"{ADMIN}/products/77/edit", title="Product 77")),
         (30, dict(target="price_field", url=f"{ADMIN}/products/77/edit", title="Product 77")),
         (70, dict(target="save", kind="form.submit", url=f"{ADMIN}/products/77/edit", title="Product 77"))],
        "Edit Product workflow", ["edit_product"], "idle_gap"),
    "report-export": (
        [(0, dict(target="report", kind=NAV, url=f"{ADMIN}/orders", title="Orders Report")),
         (65, dict(target="orders_csv", kind="file.download", url=f"{ADMIN}/orders", title="Orders Report"))],
        "Export Excel workflow", ["open_admin", "export_excel"], "idle_gap"),
    "ops-handoff": (
        [(0, dict(target="email_response", kind="app.switch", app="outlook", title="Responses")),
         (25, dict(target="send_email", kind="mouse.click", app="outlook", title="Responses")),
         (50, dict(target="open_sheet", kind="app.switch", app="excel", title="Tracker.xlsx")),
         (80, dict(target="save_sheet", kind="file.save", app="excel", title="Tracker.xlsx")),
         (105, dict(target="report_channel", kind="app.switch", app="slack", title="Alerts")),
         (135, dict(target="send_report", kind="mouse.click", app="slack", title="Alerts"))],
        "Send Email Response workflow", ["send_email_response", "save_sheet", "send_slack_report"], "idle_gap"),
    "sheet-share": (
        [(0, dict(kind=NAV, url=SHEET, title="Status")), (40, dict(target="edit_cell", url=SHEET, title="Status")),
         (75, dict(target="share_sheet", url=SHEET, title="Status"))],
        "Edit Sheet workflow", ["open_sheet", "edit_sheet", "share_sheet"], "idle_gap"),
    "mail-triage": (
        [(0, dict(target="open_thread", kind=NAV, domain="mail.google.com", title="Thread", **ROUTE)),
         (40, dict(target="reply_send", domain="mail.google.com", title="Thread", **ROUTE)),
         (80, dict(target="archive_thread", domain="mail.google.com", title="Thread", **ROUTE))],
        "Reply Mail Thread workflow", ["open_mail_thread", "reply_mail_thread", "archive_mail_thread"], "idle_gap"),
    "run-query": (
        [(0, dict(target="workspace", kind=NAV, domain="console.cloud.google.com", title="Workspace", **BQ_META)),
         (40, dict(target="run_query", domain="console.cloud.google.com", title="Workspace", **BQ_META)),
         (80, dict(target="save_query", domain="console.cloud.google.com", title="Workspace", **BQ_META))],
        "Run Query workflow", ["open_query_workspace", "run_query", "save_query"], "idle_gap"),
    "event-scheduling": (
        [(0, dict(kind=NAV, url=f"{CAL}/week", title="Calendar")),
         (35, dict(kind=NAV, url=f"{CAL}/eventedit", title="Event")),
         (75, dict(target="save_event", url=f"{CAL}/eventedit", title="Event"))],
        "Schedule Calendar Event workflow",
        ["open_calendar", "open_calendar_event", "schedule_calendar_event"], "idle_and_context_shift"),
    "page-update": (
        [(0, dict(kind=NAV, url="https://www.notion.so/roadmap", title="Roadmap")),
         (60, dict(target="edit_block", url="https://www.notion.so/roadmap", title="Roadmap"))],
        "Edit Notion Page workflow", ["open_notion_page", "edit_notion_page"], "idle_gap"),
}


def golden_events():
    """Every golden case as a stream of its own."""
    rows = []
    for name, (steps, *_) in GOLDEN.items():
        for i, e in enumerate(repeated(steps)):
            rows.append({**e, "stream_id": name, "seq": i})
    return rows
