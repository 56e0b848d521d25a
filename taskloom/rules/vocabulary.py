"""Vocabularies and patterns that define the labels."""

# Source event type -> action kind.
ACTION_BY_EVENT_TYPE = {
    "app.switch": "application_switch",
    "application.switch": "application_switch",
    "browser.click": "button_click",
    "chrome.click": "button_click",
    "chrome.route_change": "page_navigation",
    "chrome.navigation": "page_navigation",
    "clipboard.use": "clipboard_usage",
    "dom.click": "button_click",
    "file.delete": "file_operation",
    "file.download": "file_download",
    "file.open": "file_operation",
    "file.save": "file_operation",
    "form.submit": "form_submit",
    "mouse.click": "button_click",
    "tab.navigation": "page_navigation",
}

# Application alias -> application.
APPLICATION_ALIASES = {
    "chrome": "chrome",
    "google chrome": "chrome",
    "chrome browser": "chrome",
    "safari": "safari",
    "firefox": "firefox",
    "slack": "slack",
    "slack desktop": "slack",
    "excel": "excel",
    "microsoft excel": "excel",
    "outlook": "outlook",
    "microsoft outlook": "outlook",
    "notion": "notion",
    "visual studio code": "vscode",
    "vscode": "vscode",
    "terminal": "terminal",
    "iterm2": "terminal",
}

BROWSERS = ["chrome", "safari", "firefox"]

# Page-type rules, in order: (domain token, path regex, title regex, page type).
PAGE_TYPE_RULES = [
    ("admin", r"^/products?/\{id\}/edit$", None, "product_edit"),
    ("admin", r"^/orders?/\{id\}(?:/view)?$", None, "order_detail"),
    (
        None,
        None,
        r"(?i)(?<![A-Za-z0-9_])order(?![A-Za-z0-9_]).*#\{id\}",
        "order_detail",
    ),
    ("admin", r"^/refunds?(?:/\{id\})?(?:/edit)?$", None, "refund_review"),
    (None, r"^/tickets?/\{id\}$", None, "ticket_detail"),
]

# Words that yield a resource hint, in order of preference.
TARGET_HINT_WORDS = ["order", "product", "ticket", "refund"]
TITLE_HINT_WORDS = ["order", "product", "ticket", "refund", "shipment", "customer"]
NON_RESOURCE_SEGMENTS = ["edit", "view", "new", "create"]

# Target words without meaning of their own, and verbs that carry meaning alone.
GENERIC_TARGET_WORDS = [
    "button", "card", "dialog", "dropdown", "field", "form", "icon", "input", "link",
    "list", "menu", "modal", "panel", "row", "section", "tab", "toolbar", "view",
]
TARGET_VERBS = [
    "approve", "download", "edit", "export", "focus", "notify", "open", "reply", "run",
    "save", "search", "send", "share", "submit", "update",
]

# Page types with an action name of their own.
ACTION_BY_PAGE_TYPE = {
    "bigquery_saved_queries": "open_saved_queries",
    "bigquery_sql_workspace": "open_query_workspace",
    "bigquery_workspace": "open_bigquery_workspace",
    "document_edit": "open_document",
    "sheet_edit": "open_sheet",
}

# Keys and texts that must never be stored.
SENSITIVE_PATTERN = (
    "(?i)password|passwd|secret|token|cookie|authorization|clipboard|emailbody|"
    "documentcontent|keystroke|session|auth"
)
REDACTED = "[REDACTED]"

RESET_ACTION_PATTERN = "^(open|search|edit|review|update|verify)_"
SHIFT_ACTION_PATTERN = "^(open|search|edit|review|update)_"
STRUCTURED_UPDATE_PATTERN = "^(edit|update|verify|review)_"

UUID_BODY = (
    "[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"
)
