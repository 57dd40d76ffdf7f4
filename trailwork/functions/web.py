"""Scalar Columns over request fields. A NULL field gives NULL (unavailable), never 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Basenames and route segments that occur at the same path in unrelated applications.
GENERIC_BASENAMES = ["ads.txt", "apple-touch-icon.png", "crossdomain.xml", "default.aspx", "favicon.ico", "humans.txt", "index.asp", "index.htm", "index.html", "index.jsp", "index.php", "robots.txt", "security.txt", "sitemap.xml"]
GENERIC_SEGMENTS = [
    "about", "account", "accounts", "admin", "administrator", "api", "app", "auth", "config", "configuration", "console", "contact", "dashboard", "health", "healthz", "help", "home", "index", "login", "logout",
    "oauth", "portal", "profile", "public", "register", "search", "setting", "settings", "sign-in", "signin", "signup", "static", "status", "support", "user", "users", "v1", "v2", "v3", "web",
]

#: Other names of event fields in rules.
FIELD_ALIASES = {
    "cs-method": "method", "cs-uri": "uri", "cs-uri-stem": "uri_path", "cs-uri-query": "uri_query", "cs-host": "host", "cs-user-agent": "user_agent", "c-useragent": "user_agent", "cs-referer": "referer", "c-uri": "uri", "c-uri-query": "uri_query",
    "c-ip": "source_ip", "src_ip": "source_ip", "sc-status": "status", "sc-bytes": "response_bytes", "method": "method", "uri": "uri", "uri_path": "uri_path", "uri_query": "uri_query", "uri_fragment": "uri_fragment", "host": "host",
    "user_agent": "user_agent", "referer": "referer", "source_ip": "source_ip", "client_ip": "client_ip", "country": "country", "ja3": "ja3", "ja4": "ja4", "status": "status", "protocol": "protocol", "waf_action": "waf_action", "request_body": "request_body", "content_type": "content_type",
}


def field_value(alias: str, columns: list[str]) -> Column:
    """The column behind a field alias as text; NULL for unknown fields."""
    name = FIELD_ALIASES.get(alias.lower())
    return F.col(name).cast("string") if name in columns else F.lit(None).cast("string")


def status_class(status: Column) -> Column:
    return (
        F.when(status.isNull(), "unavailable")
        .when(status == 499, "499")
        .when(status.between(100, 199), "1xx")
        .when(status.between(200, 299), "2xx")
        .when(status.between(300, 399), "3xx")
        .when(status.between(400, 498), "4xx")
        .when(status.between(500, 599), "5xx")
        .otherwise("other")
    )


def waf_outcome(action: Column) -> Column:
    up = F.upper(action)
    return F.when(up == "BLOCK", "blocked").when(up.isin("ALLOW", "COUNT"), "not-blocked").otherwise("unknown")


def waf_action_name(action: Column) -> Column:
    up = F.upper(action)
    return F.when(action.isNull(), "unavailable").when(up.isin("ALLOW", "BLOCK", "COUNT", "CAPTCHA", "CHALLENGE"), up).otherwise("other")


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def first_segment(path: Column) -> Column:
    """First path segment with its slash; the root for an empty first segment."""
    return F.concat(F.lit("/"), F.split_part(path, F.lit("/"), F.lit(2)))


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_depth(path: Column) -> Column:
    return F.size(segments(path))


def extension(path: Column) -> Column:
    """Lower-case extension of the last segment, NULL if none."""
    return F.nullif(F.lower(F.regexp_extract(last_segment(path), r"\.([A-Za-z0-9]{1,10})$", 1)), F.lit(""))


def in_subtree(path: Column, root: str) -> Column:
    """/api holds /api and /api/x, not /apix."""
    base = root.rstrip("/")
    return (path == base) | path.startswith(base + "/")


def path_distinctiveness(path: Column) -> Column:
    parts = segments(F.lower(F.trim(F.coalesce(path, F.lit("")))))
    hidden = F.exists(parts, lambda s: s.contains("..") | s.contains("%2e"))
    base = F.get(parts, F.size(parts) - 1)
    generic = (F.size(parts) == 0) | base.isin(GENERIC_BASENAMES) | F.forall(parts, lambda s: s.isin(GENERIC_SEGMENTS))
    return F.when(~hidden & generic, "generic").otherwise("distinctive")


def split_target(target: Column) -> tuple[Column, Column, Column]:
    """(path, query, fragment) of a request target; absent and empty parts are NULL."""
    before = F.substring_index(target, "#", 1)
    rest = lambda whole, head: F.nullif(F.substring(whole, F.length(head) + 2, F.length(whole)), F.lit(""))
    path = F.substring_index(before, "?", 1)
    return path, rest(before, path), rest(target, before)


def query_keys(query: Column) -> Column:
    """Literal keys before the first =, empty ones dropped, not decoded; none for NULL."""
    parts = F.split(F.coalesce(query, F.lit("")), "&")
    return F.filter(F.transform(parts, lambda p: F.split_part(p, F.lit("="), F.lit(1))), lambda k: k != "")


def valid_percent_escapes(text: Column) -> Column:
    return ~text.rlike("%(?![0-9A-Fa-f]{2})")


def id_kind(value: Column) -> Column:
    return F.when(value.rlike("^[0-9]{1,20}$"), "{num}").when(value.rlike("^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"), "{uuid}")


def path_id(segment: Column) -> tuple[Column, Column]:
    """(identifier, template) of a path segment, NULLs if it holds none; an extension of up to ten characters stays."""
    plain = id_kind(segment)
    base, ext = F.regexp_extract(segment, r"^(.*)\.([A-Za-z0-9]{1,10})$", 1), F.regexp_extract(segment, r"^(.*)\.([A-Za-z0-9]{1,10})$", 2)
    with_ext = F.concat(id_kind(base), F.lit("."), ext)
    return F.when(plain.isNotNull(), segment).when(with_ext.isNotNull(), base), F.coalesce(plain, with_ext)


def path_template(path: Column) -> Column:
    return F.array_join(F.transform(F.split(path, "/"), lambda s: F.coalesce(path_id(s)[1], s)), "/")


def header_value(headers: Column, name: str) -> Column:
    """First header of a name, without case."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


def keyword_text(columns: list[str]) -> Column:
    parts = [F.col(c) for c in ("method", "host", "uri") if c in columns]
    if "headers" in columns:
        parts.append(F.array_join(F.transform(F.col("headers"), lambda h: F.concat_ws("\n", h["name"], h["value"])), "\n"))
    if "raw" in columns:
        parts.append(F.col("raw"))
    return F.concat_ws("\n", *parts)


def printable(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{Cntrl}", "�")


def secret_like(text: Column) -> Column:
    """Values that look like credentials: authorization or cookie headers, JSON web tokens."""
    return text.rlike(r"(?i)(authorization|cookie|bearer\s|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.)")


def cves_in(text: Column) -> Column:
    """Distinct upper-case CVE ids of a text, dotted tags included, in order."""
    found = F.regexp_extract_all(F.upper(text), F.lit(r"CVE[-.](\d{4})[-.](\d{4,})"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda c: F.translate(c, ".", "-"))))


def share(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    """part / whole; on a zero denominator 0.0 or, with empty=None, NULL."""
    return F.when(whole != 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(empty).cast("double"))


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970, floored."""
    return F.floor(F.unix_micros(ts) / F.lit(1_000_000))


def bucket(ts: Column, width: int | Column) -> Column:
    """Start of the UTC bucket of a width in seconds, floored also before 1970."""
    w = F.lit(width) if isinstance(width, int) else width
    return F.floor(epoch(ts) / w) * w
