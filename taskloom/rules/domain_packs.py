"""Which routes of which sites are recognised (first match wins).

``route`` is a regular expression on the route template, ``section`` a list of primary
sections, ``signature`` an exact taxonomy signature. ``source`` says what the match
rests on; None means "the taxonomy if it has a template, else the template".
"""

from __future__ import annotations

from dataclasses import dataclass

REGISTRY_VERSION = 1

MAIL_SECTIONS = (
    "all", "drafts", "important", "inbox", "sent", "spam", "starred", "trash", "label",
)
SLOT = r"\{(?:id|uuid)\}"


@dataclass(frozen=True)
class Route:
    family: str
    page_type: str
    hint: str
    source: str | None = "route_template"
    route: str | None = None
    not_route: str | None = None
    sections: tuple[str, ...] = ()
    or_template: str | None = None
    signature: str | None = None
    min_dynamic: int = 0


@dataclass(frozen=True)
class DomainPack:
    id: str
    domains: tuple[str, ...]
    routes: tuple[Route, ...]
    version: int = 1
    needs_section: bool = False


DOMAIN_PACKS = (
    DomainPack(
        "makestar-admin",
        ("admin.example.com", "makestar-admin", "makestar"),
        (
            Route("makestar-admin.orders.list", "orders_report", "order", route=r"^/orders$"),
            Route(
                "makestar-admin.orders.detail",
                "order_detail",
                "order",
                route=rf"^/orders/{SLOT}(?:/view)?$",
            ),
            Route(
                "makestar-admin.products.edit",
                "product_edit",
                "product",
                route=rf"^/products?/{SLOT}/edit$",
            ),
            Route(
                "makestar-admin.refunds.review",
                "refund_review",
                "refund",
                route=rf"^/refunds?(?:/{SLOT})?(?:/edit)?$",
            ),
        ),
    ),
    DomainPack(
        "google-mail",
        ("mail.google.com",),
        (
            Route(
                "google-mail.compose",
                "mail_compose",
                "email",
                "route_taxonomy",
                sections=("compose",),
                or_template="/compose",
            ),
            Route(
                "google-mail.search.results",
                "mail_search",
                "email",
                "route_taxonomy",
                sections=("search",),
                route=r"^/search(?:/\{id\})?$",
            ),
            Route(
                "google-mail.thread.detail",
                "email_thread",
                "email",
                "route_taxonomy",
                sections=MAIL_SECTIONS,
                min_dynamic=1,
            ),
            Route(
                "google-mail.mailbox.list",
                "mailbox_list",
                "email",
                "route_taxonomy",
                sections=MAIL_SECTIONS,
            ),
        ),
        needs_section=True,
    ),
    DomainPack(
        "google-calendar",
        ("calendar.google.com",),
        (
            Route(
                "google-calendar.event.edit",
                "calendar_event_edit",
                "event",
                None,
                route=r"(?i)^/calendar(?:/u/\{id\})?/r/eventedit(?:/\{id\})?$",
            ),
            Route(
                "google-calendar.schedule.view",
                "calendar_schedule",
                "event",
                None,
                route=r"(?i)^/calendar(?:/u/\{id\})?/r"
                r"(?:/(?:agenda|day|month|schedule|week|year)(?:/\{id\}){0,3})?$",
            ),
        ),
    ),
    DomainPack(
        "google-sheets",
        ("docs.google.com",),
        (
            Route(
                "google-sheets.sheet.edit",
                "sheet_edit",
                "sheet",
                route=rf"(?i)^/spreadsheets(?:/u/\{{id\}})?/d/(?:{SLOT}|[a-z0-9_-]+)/edit$",
            ),
        ),
    ),
    DomainPack(
        "google-docs",
        ("docs.google.com",),
        (
            Route(
                "google-docs.document.edit",
                "document_edit",
                "document",
                route=rf"(?i)^/document(?:/u/\{{id\}})?/d/(?:{SLOT}|[a-z0-9_-]+)/edit$",
            ),
        ),
    ),
    DomainPack(
        "notion",
        ("notion.so", "notion.site"),
        (
            Route("notion.workspace.home", "notion_workspace", "page", None, route=r"^/$"),
            Route(
                "notion.page.view",
                "notion_page",
                "page",
                None,
                route=r"^.",
                not_route=r"(?i)^/(?:api|login|signin|logout|signup)(?:/|$)",
            ),
        ),
    ),
    DomainPack(
        "bigquery-console",
        ("console.cloud.google.com",),
        (
            Route(
                "bigquery-console.sql-workspace",
                "bigquery_sql_workspace",
                "query",
                "route_taxonomy",
                signature="hash:/sqlworkspace",
                or_template="/sqlworkspace",
            ),
            Route(
                "bigquery-console.saved-queries",
                "bigquery_saved_queries",
                "query",
                "route_taxonomy",
                signature="hash:/savedqueries",
                or_template="/savedqueries",
            ),
            Route(
                "bigquery-console.workspace",
                "bigquery_workspace",
                "dataset",
                "route_taxonomy",
                signature="hash:/bigquery",
                or_template="/bigquery",
            ),
        ),
    ),
)
