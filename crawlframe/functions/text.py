"""Text and header columns: error keys, Retry-After, media types, leading numbers, encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RETRY_CAP, KEY_CHARS = 600, 200
EXTENSIONS = {"application/json": "json", "text/plain": "txt", "text/html": "html", "application/xml": "xml", "text/xml": "xml", "image/png": "png", "image/jpeg": "jpeg", "application/octet-stream": "bin"}


def error_key(text: Column) -> Column:
    """First line; white space runs are one space; url tokens `<url>`, UUID tokens `<uuid>`, digit runs in other tokens `#`; KEY_CHARS characters."""
    line = F.regexp_extract(text, r"^([^\n]*)", 1)
    tokens = F.filter(F.split(line, r"\s+"), lambda t: t != "")
    uuid = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
    masked = F.transform(tokens, lambda t: F.when(t.startswith("http://") | t.startswith("https://"), "<url>").when(t.rlike(uuid), "<uuid>").otherwise(F.regexp_replace(t, "[0-9]+", "#")))
    return F.left(F.array_join(masked, " "), F.lit(KEY_CHARS))


def retry_after(value: Column, now: Column) -> Column:
    """Seconds to wait: digits, or the time until an HTTP date; 0 if past, RETRY_CAP at most, null if neither."""
    v = F.btrim(value)
    digits = F.when(F.length(F.ltrim(v, F.lit("0"))) > 9, F.lit(RETRY_CAP)).otherwise(F.least(v.try_cast("long"), F.lit(RETRY_CAP)))
    date = F.try_to_timestamp(F.regexp_extract(v, r"^(?:[A-Za-z]{3}, )?(\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.least(F.greatest(F.unix_timestamp(date) - F.unix_timestamp(now), F.lit(0)), F.lit(RETRY_CAP))
    return F.when(v.rlike("^[0-9]+$"), digits).when(date.isNotNull(), wait).cast("long")


def media_type(content_type: Column) -> Column:
    return F.lower(F.btrim(F.split_part(content_type, F.lit(";"), F.lit(1))))


def is_html(content_type: Column) -> Column:
    """HTML by its header, or without one."""
    return content_type.isNull() | media_type(content_type).isin("text/html", "application/xhtml+xml")


def extension(content_type: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, media_type(content_type)), F.lit("bin"))


def content_type(ext: Column) -> Column:
    own = {e: t for t, e in reversed(EXTENSIONS.items())}
    known = F.create_map(*[F.lit(x) for pair in own.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(ext)), F.lit("application/octet-stream"))


def lossy_text(body: Column) -> Column:
    """Bytes as text; invalid sequences become the replacement character."""
    return F.make_valid_utf8(body.cast("string"))


def json_value(text: Column, path: str = "$", kind: str = "string") -> Column:
    """A value of a JSON text; null if the text isn't JSON or holds none of that kind."""
    return F.try_variant_get(F.try_parse_json(text), path, kind)


def rfc3339(at: Column) -> Column:
    """A time as text in UTC with microseconds."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def from_rfc3339(text: Column) -> Column:
    """The time that a text with `T` and an offset or `Z` says; null for anything else."""
    good = text.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    return F.when(good, F.try_to_timestamp(F.upper(F.regexp_replace(text, " ", "T"))))


def leading_integer(s: Column) -> Column:
    return F.regexp_extract(F.btrim(s), r"^(\d+)", 1).try_cast("int")


def valid_component(name: Column) -> Column:
    """Whether a store name or key is usable as a file name."""
    return (name != "") & ~name.rlike(r"[/\\\x00]|\.\.")
