"""String functions over mail fields (X10-X39), as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake.functions.identity import stable_id

_UNSAFE = r'[/\\:*?"<>|\x00-\x1F\x7F-\x9F]'


def none() -> Column:
    return F.lit(None).cast("string")


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column, by: str = " ") -> Column:
    return F.regexp_replace(trim(c), r"(?U)\s+", by)


def normalize_subject(c: Column) -> Column:
    """Reply and forward marks off, white space collapsed, lower case."""
    return F.lower(collapse(F.regexp_replace(c, r"(?iU)^(\s*(re|fw|fwd)\s*:)+", "")))


def split_references(c: Column) -> Column:
    """X11: the bracketed ids of a References field; a null field has none."""
    items = F.transform(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda x: F.regexp_replace(F.regexp_replace(x, "^,+|,+$", ""), "^;+|;+$", ""))
    return F.filter(items, lambda x: x.startswith("<") & x.endswith(">") & (F.length(x) > 2))


def threading_status(message_id: Column, reply_to: Column, references: Column, conversation: Column) -> Column:
    """X12."""
    some = message_id.isNotNull() | reply_to.isNotNull() | (F.size(references) > 0) | conversation.isNotNull()
    return F.when(some, "threading_metadata_available").otherwise("threading_metadata_absent")


def sanitize_segment(c: Column) -> Column:
    """One path segment of at most 120 characters."""
    x = F.regexp_replace(trim(F.regexp_replace(c, _UNSAFE, "_")), r"^\.+|\.+$", "")
    return F.substring(F.when(x == "", "_").otherwise(x), 1, 120)


def safe_filename(name: Column, ordinal: Column) -> Column:
    """A missing or empty name becomes attachment_<ordinal>."""
    fallback = F.concat(F.lit("attachment_"), ordinal.cast("string"))
    x = collapse(F.regexp_replace(trim(F.coalesce(name, fallback)), _UNSAFE, "_"), "_")
    x = F.regexp_replace(F.regexp_replace(x, r"^\.+|\.+$", ""), "^_+|_+$", "")
    return F.when(x == "", fallback).otherwise(x)


def file_extension(c: Column) -> Column:
    """Null without a point or with nothing after the last one."""
    x = F.lower(F.regexp_extract(c, r"\.([^.]+)$", 1))
    return F.when(x != "", x)


def _segments(path: Column) -> Column:
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), sanitize_segment)


def safe_folder_path(path: Column) -> Column:
    """X16."""
    parts = _segments(path)
    return F.when(F.size(parts) > 0, F.array_join(parts, "/")).otherwise("root")


def nested_mailbox_path(path: Column) -> Column:
    """The parent folders, then .<name>.directory/<name>.mbox."""
    parts = F.when(F.size(_segments(path)) > 0, _segments(path)).otherwise(F.array(F.lit("root")))
    parent = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.concat(x, F.lit("/")))
    leaf = F.element_at(parts, -1)
    return F.concat(F.array_join(parent, ""), F.lit("."), leaf, F.lit(".directory/"), leaf, F.lit(".mbox"))


def is_confined(path: Column) -> Column:
    """Neither absolute nor with a .. segment."""
    return ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")


def clean_header(c: Column) -> Column:
    """Null where the value breaks a line or holds nothing."""
    x = trim(F.regexp_replace(c, r"[\x00-\x08\x0A-\x1F\x7F-\x9F]", ""))
    return F.when(~c.rlike(r"[\r\n]") & (x != ""), x)


def format_address(name: Column, address: Column) -> Column:
    """X24."""
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(name, F.lit(" <"), address, F.lit(">"))).otherwise(address)


def _replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escape_text(c: Column) -> Column:
    """For vCard, iCalendar and vJournal values."""
    return _replaced(c, [("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\r", ""), ("\n", "\\n")])


def escape_parameter(c: Column) -> Column:
    return F.replace(escape_text(c), F.lit(":"), F.lit("\\:"))


def mboxrd(c: Column) -> Column:
    """From lines gain a mark, line ends are LF and the last one is there."""
    x = F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), r"(?md)^(>*From )", ">$1")
    return F.when(x.endswith("\n"), x).otherwise(F.concat(x, F.lit("\n")))


def crlf(c: Column) -> Column:
    """X28."""
    return _replaced(c, [("\r\n", "\n"), ("\r", "\n"), ("\n", "\r\n")])


def header_value(headers: Column, name: str) -> Column:
    """The first field of that name, unfolded lines only; null where there is none."""
    m = F.regexp_extract_all(headers, F.lit(rf"(?im)^{name}:[ \t]*([^\r\n]*)"), 1)
    return F.when(F.size(m) > 0, trim(F.element_at(m, 1)))


def safe_media_type(c: Column) -> Column:
    """X31."""
    x = trim(c)
    return F.when(~c.rlike(r"[;\r\n]") & x.contains("/"), x).otherwise("application/octet-stream")


def transfer_encoding(content: Column) -> Column:
    """Of binary content."""
    ok = F.is_valid_utf8(content.cast("string")) & (F.instr(content.cast("string"), "\0") == 0)
    return F.when(ok, "8bit").otherwise("base64")


def status_counter(status: Column, key: str) -> Column:
    """The number under key: or key= in a status text; null where there is none."""
    m = F.coalesce(F.nullif(F.regexp_extract(status, rf"{key}:\s*([^,;]*)", 1), F.lit("")), F.nullif(F.regexp_extract(status, rf"{key}=\s*([^,;]*)", 1), F.lit("")))
    return trim(m).try_cast("bigint")


def table_role(code: Column) -> Column:
    """X36, of recipient tables."""
    return F.when(code == 0, "originator").when(code == 1, "to").when(code == 2, "cc").when(code == 3, "bcc").otherwise("unknown")


def flat_role(code: Column) -> Column:
    """X36, of flat recipient rows."""
    known = F.when(code == 1, "to").when(code == 2, "cc").when(code == 3, "bcc").when(code == 4, "reply_to")
    return known.when(code.isNull(), "unknown").otherwise(F.concat(F.lit("unknown_"), code.cast("string")))


def bounded_hex(content: Column, limit: int = 65536) -> Column:
    """X37."""
    return F.lower(F.hex(F.substring(content, 1, limit)))


def sanitized_reason(c: Column, limit: int = 80) -> Column:
    """X38."""
    return F.substring(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_-]", "_"), "^_+|_+$", ""), 1, limit)


def size_bucket(n: Column) -> Column:
    """X39."""
    return F.when(n < 128, "lt_128").when(n < 512, "lt_512").when(n < 4096, "lt_4096").when(n < 65536, "lt_65536").otherwise("gte_65536")


def run_directory(path: Column) -> Column:
    """A directory name for one input file's results."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    safe = F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9_-]", "_"), "^_+|_+$", "")
    return F.concat(F.when(safe == "", "pst").otherwise(safe), F.lit("_"), F.substring(stable_id("pstout", path), 8, 16))
