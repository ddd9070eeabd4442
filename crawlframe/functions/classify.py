"""Outcome classes of attempts, error properties, and detectors of blocked or unrendered pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SESSION_CODES, RETRY_CODES, PROMOTE_CODES = (401, 403), (408, 429), (403, 503)

#: class: retryable, rotates the session, ignores the retry limit, critical, counts against retries.
ERROR_CLASSES = {
    "retryable": (True, False, False, False, True),
    "non_retryable": (False, False, False, False, True),
    "session": (True, True, False, False, False),
    "force_retry": (True, False, True, False, True),
    "critical": (False, False, False, True, True),
    "missing_route": (False, False, False, True, True),
    "timeout": (True, False, False, False, True),
}


def classify_status(status: Column, session_codes=SESSION_CODES, retry_codes=RETRY_CODES, server_errors: bool = True) -> Column:
    """success, session, retryable or non_retryable."""
    again = status.isin(*retry_codes)
    if server_errors:
        again = again | ((status >= 500) & (status < 600))
    return F.when(status.isin(*session_codes), "session").when(again, "retryable").when((status < 200) | (status >= 400), "non_retryable").when(status.isNotNull(), "success")


def classify_transport(kind: Column) -> Column:
    """Connect, timeout and io errors are tried again; others aren't."""
    return F.when(kind.isin("connect", "timeout", "io"), "retryable").when(kind.isNotNull(), "non_retryable")


def classify_browser(kind: Column) -> Column:
    return F.when(kind.isin("navigation", "timeout", "disconnected", "launch", "io"), "retryable").when(kind.isNotNull(), "non_retryable")


def classify_cause(kind: Column) -> Column:
    """Error class of a library error by its kind: io is tried again, and so is storage that was rate limited; bad input, a bad request and other storage errors aren't."""
    return F.when(kind.isin("io", "storage_rate_limited", "storage_io"), "retryable").when(kind.isin("json", "request_build", "url", "storage"), "non_retryable").when(kind.isNotNull(), "critical")


def chained(chain: Column, field: str) -> Column:
    """The first value of a field (http_status, retry_after) along an error's chain of causes, an array of structs."""
    return F.get(F.filter(F.transform(chain, lambda e: e[field]), lambda v: v.isNotNull()), F.lit(0))


def error_property(error: Column, name: str) -> Column:
    at = ("retryable", "rotates_session", "ignores_max_retries", "critical", "counts_against_retries").index(name)
    return F.coalesce(error.isin(*[c for c, flags in ERROR_CLASSES.items() if flags[at]]), F.lit(False))


def retry_allowed(error: Column, no_retry: Column, retries: Column, rotations: Column, max_retries: Column | int = 3, max_rotations: Column | int = 10) -> Column:
    """Whether a failed attempt is tried again: forced, or retryable, allowed and below its limit."""
    bound = lambda x: x if isinstance(x, Column) else F.lit(x)
    below = F.when(error_property(error, "rotates_session"), rotations < bound(max_rotations)).otherwise(retries < bound(max_retries))
    return error_property(error, "ignores_max_retries") | (error_property(error, "retryable") & ~F.coalesce(no_retry, F.lit(False)) & below)


def _any(text: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | text.contains(n)
    return out


#: Vendor: header names, header name prefix, marks in Set-Cookie, marks in the body. The first that fits counts.
VENDORS = [
    ("cloudflare", ["cf-ray", "cf-mitigated"], None, ["__cf_bm", "cf_clearance"], ["just a moment", "cf-chl", "challenges.cloudflare.com", "checking your browser"]),
    ("datadome", ["x-datadome", "x-dd-b"], None, ["datadome"], ["datadome", "geo.captcha-delivery.com"]),
    ("perimeterx", [], None, ["_px"], ["px-captcha", "perimeterx", "/_px"]),
    ("kasada", ["x-kpsdk-ct", "x-kpsdk-cd"], None, [], ["kpsdk", "kasada"]),
    ("imperva", ["x-iinfo"], None, ["visid_incap", "incap_ses"], ["incapsula", "_incap_", "incident id"]),
    ("akamai", [], "x-akamai", ["_abck", "ak_bmsc"], ["akamai bot manager", "akamaighost"]),
]


def inspected(body: Column, limit: int | None = 65536) -> Column:
    """The text a detector sees: the first bytes, or without limit all, lossy, A-Z lower-cased."""
    seen = body.cast("binary") if limit is None else F.substring(body.cast("binary"), 1, limit)
    text = F.make_valid_utf8(seen.cast("string"))
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def anti_bot(body: Column, headers: Column | None = None, custom: dict[str, str] | None = None, limit: int | None = 65536) -> Column:
    """Vendor whose challenge a response looks like; unknown for an unnamed captcha wall, else null. headers: array of (name, value)."""
    text = inspected(body, limit)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for vendor, names, start, cookies, marks in VENDORS:
        hit = _any(text, marks)
        if headers is not None:

            def fits(h: Column) -> Column:
                name, value = F.lower(h["name"]), F.lower(h["value"])
                met = name.isin(*names) if names else F.lit(False)
                if start:
                    met = met | name.startswith(start)
                if vendor == "cloudflare":
                    met = met | ((name == "server") & value.contains("cloudflare"))
                return met | ((name == "set-cookie") & _any(value, cookies))

            hit = hit | F.coalesce(F.exists(headers, fits), F.lit(False))
        out = out.when(hit, vendor)
    for mark, name in (custom or {}).items():
        out = out.when(text.contains(mark.lower()), name)
    return out.when(text.contains("captcha") & _any(text, ["access denied", "verify you are human", "are you a human"]), "unknown")


def visible_length(html: Column) -> Column:
    """Bytes of a page's body text, without tags, comments, scripts and styles, white space trimmed; 0 without body."""
    body = F.regexp_extract(html, r"(?is)<body[^>]*>(.*?)(?:</body>|$)", 1)
    bare = F.regexp_replace(F.regexp_replace(body, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<!--.*?-->|<[^>]*>", "")
    return F.octet_length(F.btrim(bare, F.lit(" \t\n\r\f")))


def promotion(status: Column, html: Column, headers: Column | None = None, required: str | None = None, least_text: int = 40) -> Column:
    """Why a page should be rendered in a browser: anti_bot, selector_missing, empty_body_likely_js; null if it needn't. required: a tag name."""
    out = F.when(anti_bot(html, headers).isNotNull(), "anti_bot")
    if required:
        out = out.when(~html.rlike(rf"(?i)<{required}[\s>/]"), "selector_missing")
    shell = status.between(200, 299) & (visible_length(html) < least_text) & html.rlike(r"(?i)<script[\s>]")
    return out.when(shell, "empty_body_likely_js")
