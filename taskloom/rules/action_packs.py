"""The semantic action rules."""

from __future__ import annotations

from dataclasses import dataclass

REGISTRY_VERSION = 1
LAYER_RANK = {"domain_pack": 3, "page_type": 2, "generic": 1}


@dataclass(frozen=True)
class ActionRule:
    id: str
    action: str
    confidence: float
    applications: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()
    packs: tuple[str, ...] = ()
    routes: tuple[str, ...] = ()
    events: tuple[str, ...] = ()
    page_types: tuple[str, ...] = ()
    targets: tuple[str, ...] = ()
    explicit_target: bool = False
    hints: tuple[str, ...] = ()
    layer: str = "domain_pack"

    @property
    def specificity(self) -> int:
        conditions = (
            self.applications,
            self.domains,
            self.packs,
            self.routes,
            self.events,
            self.page_types,
            self.targets,
            self.explicit_target,
            self.hints,
        )
        return sum(1 for condition in conditions if condition)


@dataclass(frozen=True)
class ActionPack:
    id: str
    priority: int
    rules: tuple[ActionRule, ...]
    version: int = 1


R = ActionRule
NAVIGATE = ("page_navigation", "application_switch")
BROWSER = ("chrome", "safari", "firefox")
ADMIN = ("makestar-admin",)
SHEET_EDIT = ("google-sheets.sheet.edit",)
SHEETS = ("google-sheets",)
MAIL = ("google-mail",)
THREAD = ("google-mail.thread.detail",)
CALENDAR = ("google-calendar",)
CALENDAR_EDIT = ("google-calendar.event.edit",)
NOTION = ("notion",)
BQ = ("bigquery-console",)
BQ_SQL = "bigquery-console.sql-workspace"
BQ_SAVED = "bigquery-console.saved-queries"

ACTION_PACKS = (
    ActionPack("makestar-admin", 100, (
        R("edit-product", "edit_product", 0.98, packs=ADMIN, routes=("makestar-admin.products.edit",),
          events=("page_navigation", "button_click", "form_submit")),
        R("open-admin-order", "open_admin", 0.91, packs=ADMIN,
          routes=("makestar-admin.orders.detail", "makestar-admin.orders.list"), events=NAVIGATE),
        R("open-admin-refund", "open_admin", 0.9, packs=ADMIN,
          routes=("makestar-admin.refunds.review",), events=NAVIGATE),
        R("search-order", "search_order", 0.98, packs=ADMIN, targets=("search_order", "order_search")),
        R("update-status", "update_status", 0.95, packs=ADMIN,
          targets=("status", "approve_refund", "reschedule_delivery")),
        R("notify-customer", "notify_customer", 0.94, packs=ADMIN,
          targets=("notify_customer", "send_confirmation", "send_email")),
        R("export-excel-download", "export_excel", 0.97, packs=ADMIN, events=("file_download",)),
        R("export-excel-target", "export_excel", 0.93, packs=ADMIN,
          targets=("export", "download", "orders_csv")),
    )),
    ActionPack("google-sheets", 90, (
        R("open-sheet", "open_sheet", 0.95, packs=SHEETS, routes=SHEET_EDIT, events=NAVIGATE),
        R("edit-sheet", "edit_sheet", 0.94, packs=SHEETS, routes=SHEET_EDIT,
          targets=("edit_cell", "formula_bar", "cell_editor", "update_status_column", "save_sheet")),
        R("share-sheet", "share_sheet", 0.93, packs=SHEETS, routes=SHEET_EDIT,
          targets=("share_sheet", "share")),
    )),
    ActionPack("google-mail", 88, (
        R("open-mailbox", "open_inbox", 0.93, packs=MAIL, routes=("google-mail.mailbox.list",), events=NAVIGATE),
        R("search-mail", "search_mail", 0.94, packs=MAIL, routes=("google-mail.search.results",), events=NAVIGATE),
        R("open-mail-thread", "open_mail_thread", 0.95, packs=MAIL, routes=THREAD, events=NAVIGATE),
        R("compose-mail", "compose_mail", 0.93, packs=MAIL, routes=("google-mail.compose",), events=NAVIGATE),
        R("reply-mail-thread", "reply_mail_thread", 0.96, packs=MAIL, routes=THREAD,
          targets=("reply", "reply_send", "send_reply"), explicit_target=True),
        R("archive-mail-thread", "archive_mail_thread", 0.95, packs=MAIL, routes=THREAD,
          targets=("archive", "archive_thread"), explicit_target=True),
    )),
    ActionPack("google-calendar", 87, (
        R("open-calendar", "open_calendar", 0.93, packs=CALENDAR,
          routes=("google-calendar.schedule.view",), events=NAVIGATE),
        R("open-calendar-event", "open_calendar_event", 0.94, packs=CALENDAR, routes=CALENDAR_EDIT, events=NAVIGATE),
        R("schedule-calendar-event", "schedule_calendar_event", 0.96, packs=CALENDAR, routes=CALENDAR_EDIT,
          targets=("create_event", "quick_add", "save_event", "schedule_event"), explicit_target=True),
        R("update-calendar-event", "update_calendar_event", 0.94, packs=CALENDAR, routes=CALENDAR_EDIT,
          targets=("add_guest", "change_time", "edit_event", "update_event"), explicit_target=True),
    )),
    ActionPack("notion", 86, (
        R("open-notion-workspace", "open_notion_workspace", 0.92, packs=NOTION,
          routes=("notion.workspace.home",), events=NAVIGATE),
        R("open-notion-page", "open_notion_page", 0.94, packs=NOTION, routes=("notion.page.view",), events=NAVIGATE),
        R("search-notion-workspace", "search_notion_workspace", 0.95, packs=NOTION,
          targets=("open_search", "quick_find", "search"), explicit_target=True),
        R("edit-notion-page", "edit_notion_page", 0.95, packs=NOTION, routes=("notion.page.view",),
          targets=("comment_page", "edit_block", "new_block", "save_page", "toggle_todo", "update_page"),
          explicit_target=True),
    )),
    ActionPack("bigquery", 85, (
        R("open-query-workspace", "open_query_workspace", 0.96, packs=BQ, routes=(BQ_SQL,), events=NAVIGATE),
        R("run-query", "run_query", 0.98, packs=BQ, routes=(BQ_SQL,), targets=("run_query", "execute_query")),
        R("save-query", "save_query", 0.95, packs=BQ, routes=(BQ_SQL, BQ_SAVED),
          targets=("save_query", "bookmark_query")),
        R("open-saved-queries", "open_saved_queries", 0.92, packs=BQ, routes=(BQ_SAVED,), events=NAVIGATE),
        R("export-query-results", "export_query_results", 0.93, packs=BQ,
          targets=("export_results", "download_results")),
    )),
    ActionPack("general-web", 40, (
        R("open-admin", "open_admin", 0.9, applications=BROWSER, domains=("admin",), events=NAVIGATE, layer="generic"),
        R("search-order", "search_order", 0.97, applications=BROWSER,
          targets=("search_order", "order_search"), layer="generic"),
        R("update-status", "update_status", 0.92, applications=BROWSER,
          targets=("status", "approve_refund", "reschedule_delivery"), layer="generic"),
        R("notify-customer", "notify_customer", 0.9, applications=BROWSER,
          targets=("notify_customer", "send_confirmation"), layer="generic"),
        R("export-excel-download", "export_excel", 0.95, applications=BROWSER,
          events=("file_download",), layer="generic"),
        R("export-excel-target", "export_excel", 0.89, applications=BROWSER,
          targets=("export", "download"), layer="generic"),
    )),
    ActionPack("desktop-productivity", 30, (
        R("send-email-response", "send_email_response", 0.91, applications=("outlook",),
          targets=("send", "confirmation", "email", "email_response"), layer="generic"),
        R("open-sheet", "open_sheet", 0.89, applications=("excel",), targets=("sheet", "open"), layer="generic"),
        R("save-sheet", "save_sheet", 0.9, applications=("excel",), targets=("save", "sheet"), layer="generic"),
        R("send-slack-report", "send_slack_report", 0.92, applications=("slack",),
          targets=("send", "notify", "reply", "report"), layer="generic"),
    )),
)


def ranked_rules(packs: tuple[ActionPack, ...] = ACTION_PACKS):
    """(pack, rule) pairs, best first; the rank does not depend on the event."""
    pairs = [(pack, rule) for pack in packs for rule in pack.rules]
    return sorted(
        pairs,
        key=lambda p: (
            -LAYER_RANK[p[1].layer],
            -p[0].priority,
            -p[1].specificity,
            -p[1].confidence,
        ),
    )
