"""What built-in expressions can't say, as Arrow-batched functions: encoded words and parameters
(X21-X23), header validation (P07), header line filtering (X29), compressed RTF (S29), HTML inside
RTF (X34)."""

from __future__ import annotations

import base64
import re
import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


MAX_RTF = 16 << 20
_CONTROL = re.compile(r"[\x00-\x08\x0a-\x1f\x7f-\x9f]")
_ATTRIBUTE = re.compile(rb"[A-Za-z0-9!#$&+\-.^_`|~]")
_MIME_FIELDS = {"mime-version", "content-type", "content-transfer-encoding", "content-disposition", "content-id", "bcc"}
#: The dictionary that compressed RTF begins with, as published.
_RTF_START = (
    b"{\\rtf1\\ansi\\mac\\deff0\\deftab720{\\fonttbl;}{\\f0\\fnil \\froman \\fswiss \\fmodern \\fscript \\fdecor MS Sans SerifSymbolArialTimes New RomanCourier"
    b"{\\colortbl\\red0\\green0\\blue0\r\n\\par \\pard\\plain\\f0\\fs20\\b\\i\\u\\tab\\tx"
)


def clean(value: str | None) -> str | None:
    if value is None or "\r" in value or "\n" in value:
        return None
    return _CONTROL.sub("", value).strip() or None


def encoded_words(value: str) -> str:
    """Base64 words of at most 45 bytes each, cut between characters."""
    words, part = [], b""
    for ch in value:
        raw = ch.encode()
        if part and len(part) + len(raw) > 45:
            words.append(part)
            part = b""
        part += raw
    return " ".join(f"=?UTF-8?B?{base64.b64encode(w).decode()}?=" for w in [*words, *([part] if part else [])])


def unstructured(value: str | None) -> str:
    """X21."""
    v = clean(value) or ""
    return v if v.isascii() else encoded_words(v)


def display_name(value: str | None) -> str:
    """Bare, quoted or encoded."""
    v = clean(value) or ""
    if not v.isascii():
        return encoded_words(v)
    if re.fullmatch(r"[A-Za-z0-9 ._-]*", v):
        return v
    return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'


def parameter(name: str, value: str | None) -> str:
    """Quoted where that is enough, else with a plain fallback and encoded continuations."""
    v = clean(value) or ""
    units = [chr(b) if _ATTRIBUTE.match(bytes([b])) else f"%{b:02X}" for b in v.encode()]
    if v.isascii() and sum(map(len, units)) <= 60:
        quoted = v.replace("\\", "\\\\").replace('"', '\\"')
        return f'{name}="{quoted}"'
    plain = "".join(ch if " " <= ch < "\x7f" and ch not in '"\\' else "_" for ch in v) or "attachment"
    lines, now = [], ""
    for u in units:
        if now and len(now) + len(u) > 60:
            lines.append(now)
            now = ""
        now += u
    lines.append(now)
    head = f'{name}="{plain}"'
    if len(lines) == 1:
        return f"{head}; {name}*=UTF-8''{lines[0]}"
    return head + "".join(f"; {name}*{k}*={chr(85) + 'TF-8' + chr(39) * 2 if not k else ''}{x}" for k, x in enumerate(lines))


def validated_headers(text: str | None) -> tuple[str | None, str | None, bool]:
    """(fields joined by LF, what is wrong, whether a body follows); one of the first two is null."""
    if not text:
        return None, "empty", False
    if "\n" in text.replace("\r\n", ""):
        return None, "bare_line_feed", False
    if "\r" in text and "\r\n" not in text:
        return None, "bare_carriage_return", False
    lines, field, body = [], False, False
    for line in text.split("\r\n"):
        if not line:
            if not lines:
                return None, "leading_blank_line", False
            body = bool(text.partition("\r\n\r\n")[2])
            break
        if line[0] in " \t":
            if not field:
                return None, "orphan_continuation", False
            rest = line
        else:
            name, colon, rest = line.partition(":")
            if not colon:
                return None, "missing_colon", False
            if not re.fullmatch(r"[A-Za-z0-9-]+", name):
                return None, "invalid_field_name", False
            field = True
        if _CONTROL.search(rest):
            return None, "control_character", False
        lines.append(line)
    return "\n".join(lines), None, body


def kept_header_lines(text: str | None) -> str:
    """Fields that a new MIME structure replaces go, with their continuations."""
    out, drop = [], False
    for line in (text or "").split("\n"):
        if line[:1] not in (" ", "\t"):
            drop = line.partition(":")[0].lower() in _MIME_FIELDS
        if line and not drop:
            out.append(line)
    return "\n".join(out)


def _crc(data: bytes) -> int:
    import zlib

    return zlib.crc32(data)


def rtf(data: bytes | None, crc=_crc) -> bytes | None:
    """Null unless sizes and checksum agree. ``crc`` is the standard CRC-32 by default; files
    of other writers may need the format's own variant (start 0, no inversion)."""
    if data is None or len(data) < 16:
        return None
    packed, size, magic, check = struct.unpack_from("<4I", data)
    body = data[16:]
    if packed + 4 != len(data) or size > MAX_RTF:
        return None
    if magic == 0x414C454D:
        return body if not check and packed == size and len(body) + 12 == size else None
    if magic != 0x75465A4C or crc(body) != check:
        return None
    window = bytearray(4096)
    window[: len(_RTF_START)] = _RTF_START
    at, pos, out = len(_RTF_START), 0, bytearray()
    try:
        while len(out) < size:
            flags = body[pos]
            pos += 1
            for bit in range(8):
                if len(out) == size:
                    break
                if flags >> bit & 1:
                    back, run = body[pos] << 4 | body[pos + 1] >> 4, (body[pos + 1] & 15) + 2
                    pos += 2
                else:
                    window[at], back, run = body[pos], at, 1
                    pos += 1
                for k in range(min(run, size - len(out))):
                    ch = window[(back + k) & 4095]
                    window[at] = ch
                    at = (at + 1) & 4095
                    out.append(ch)
    except IndexError:
        return None
    return bytes(out)


_RTF_TOKEN = re.compile(rb"\\'([0-9a-fA-F]{2})|\\([a-z]+)(-?\d+)? ?|\\([^a-z])|([{}])|([^\\{}\r\n]+)")


def rtf_html(data: bytes | None) -> str | None:
    """The HTML that \\fromhtml1 RTF carries; null for other RTF."""
    if not data or b"\\fromhtml1" not in data[:2048]:
        return None
    out: list[str] = []
    stack = [(False, False)]
    star = False
    for m in _RTF_TOKEN.finditer(data):
        quoted, hex_, word, number, symbol, brace, plain = stack[-1], m[1], m[2], m[3], m[4], m[5], m[6]
        hidden, tag = quoted
        if brace == b"{":
            stack.append(stack[-1])
        elif brace:
            if len(stack) > 1:
                stack.pop()
        elif word:
            if star:
                stack[-1] = (word != b"htmltag", word == b"htmltag")
            elif word == b"htmlrtf":
                stack[-1] = (number != b"0", tag)
            elif word in (b"fonttbl", b"colortbl", b"stylesheet", b"info"):
                stack[-1] = (True, tag)
            elif not hidden:
                out.append({b"par": "\r\n", b"line": "\r\n", b"tab": "\t"}.get(word, chr(int(number) & 0xFFFF) if word == b"u" and number else ""))
        elif symbol == b"*":
            star = True
            continue
        elif not hidden and hex_:
            out.append(bytes([int(hex_, 16)]).decode("cp1252", "replace"))
        elif not hidden and symbol in (b"\\", b"{", b"}"):
            out.append(symbol.decode())
        elif not hidden and symbol == b"~":
            out.append(" ")
        elif not hidden and plain:
            out.append(plain.decode("cp1252", "replace"))
        star = False
    return "".join(out)


@F.pandas_udf(T.StringType())
def unstructured_udf(v: pd.Series) -> pd.Series:
    return v.map(unstructured)


@F.pandas_udf(T.StringType())
def display_name_udf(v: pd.Series) -> pd.Series:
    return v.map(display_name)


@F.pandas_udf(T.StringType())
def parameter_udf(name: pd.Series, v: pd.Series) -> pd.Series:
    return pd.Series([parameter(a, b) for a, b in zip(name, v)])


@F.pandas_udf(T.StructType().add("normalized", "string").add("failure", "string").add("embedded_body", "boolean"))
def validated_headers_udf(v: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([validated_headers(x) for x in v], columns=["normalized", "failure", "embedded_body"])


@F.pandas_udf(T.BinaryType())
def rtf_udf(v: pd.Series) -> pd.Series:
    return v.map(rtf)


@F.pandas_udf(T.StringType())
def rtf_html_udf(v: pd.Series) -> pd.Series:
    return v.map(rtf_html)


def transport_date(headers: str | None) -> str | None:
    """The Date field if there is exactly one and it is valid, as it stands."""
    from email.utils import parsedate_to_datetime

    found = re.findall(r"(?im)^date:[ \t]*([^\r\n]*)", headers or "")
    if len(found) != 1:
        return None
    try:
        parsedate_to_datetime(found[0].strip())
    except (TypeError, ValueError):
        return None
    return found[0].strip()


def _wrapped(raw: bytes) -> bytes:
    return base64.encodebytes(raw).replace(b"\n", b"\r\n") if raw else b""


def _leaf(media: str, content: bytes, extra: str = "") -> bytes:
    try:
        plain = "\0" not in content.decode()
    except UnicodeDecodeError:
        plain = False
    plain = plain and media.startswith("text/")
    charset = "; charset=utf-8" if plain else ""
    head = f"Content-Type: {media}{charset}\r\nContent-Transfer-Encoding: {'8bit' if plain else 'base64'}\r\n{extra}\r\n".encode()
    body = re.sub(rb"\r\n|\r|\n", b"\r\n", content) if plain else _wrapped(content)
    return head + body + (b"" if body.endswith(b"\r\n") else b"\r\n")


def _many(kind: str, boundary: str, parts: list[bytes], extra: str = "") -> bytes:
    mark = f"--{boundary}".encode()
    return f'Content-Type: multipart/{kind}; boundary="{boundary}"{extra}\r\n\r\n'.encode() + b"".join(mark + b"\r\n" + p for p in parts) + mark + b"--\r\n"


def eml(key: str, fields: list[tuple[str, str | None]], bodies: dict[str, bytes], attachments: list[tuple[str, str | None, str | None, bytes]]) -> bytes | None:
    """A message of any shape. bodies: text, html, rtf, report, calendar; attachments: (name,
    media type, content id, content). Null without a body. Boundaries come from the message's key."""
    if not any(bodies.get(k) is not None for k in ("text", "html", "rtf", "report")):
        return None
    head = "".join(f"{n}: {v}\r\n" for n, v in fields if v) + "MIME-Version: 1.0\r\n"
    shown = [_leaf(f"text/{m}", bodies[k]) for k, m in (("text", "plain"), ("html", "html")) if bodies.get(k) is not None]
    parts = [_many("alternative", f"alt-{key}", shown)] if len(shown) == 2 else shown
    if bodies.get("rtf") is not None:
        parts.append(_leaf("application/rtf", bodies["rtf"], 'Content-Disposition: attachment; filename="body.rtf"\r\n'))
    if bodies.get("report") is not None:
        parts.append(_leaf("message/delivery-status", bodies["report"]))
    if bodies.get("calendar") is not None:
        parts.append(_leaf("text/calendar", bodies["calendar"]))
    for name, media, cid, content in attachments:
        kind = media if media and "/" in media and not re.search(r"[;\r\n]", media) else "application/octet-stream"
        inline = f"Content-ID: <{clean(cid)}>\r\n" if clean(cid) else ""
        parts.append(_leaf(kind, content, f"Content-Disposition: {'inline' if inline else 'attachment'}; {parameter('filename', name)}\r\n{inline}"))
    if len(parts) == 1:
        return head.encode() + parts[0]
    report = bodies.get("report") is not None
    return head.encode() + _many("report" if report else "mixed", f"mix-{key}", parts, "; report-type=delivery-status" if report else "")


def cfb(streams: dict[str, bytes]) -> bytes:
    """A compound file of one storage with these streams; the container of .msg files. Streams
    under 4096 bytes lie in the mini stream. Names are at most 31 UTF-16 units."""
    free, end, fat_mark = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD
    order = sorted(streams, key=lambda n: (len(n), n.upper()))
    if any(len(n.encode("utf-16-le")) > 62 or not n for n in order):
        raise ValueError("a stream name is 1 to 31 UTF-16 units long")
    fat: list[int] = []
    sectors: list[bytes] = []

    def put(data: bytes, size: int = 512) -> int:
        count = -(-len(data) // size)
        if not count:
            return end
        first = len(sectors)
        for k in range(count):
            sectors.append(data[k * size : (k + 1) * size].ljust(size, b"\0"))
            fat.append(first + k + 1 if k + 1 < count else end)
        return first

    mini, mini_fat, starts = b"", [], {}
    for name in order:
        data = streams[name]
        if len(data) >= 4096:
            starts[name] = put(data)
        elif data:
            count, first = -(-len(data) // 64), len(mini_fat)
            mini += data.ljust(64 * count, b"\0")
            mini_fat += [first + k + 1 for k in range(count - 1)] + [end]
            starts[name] = first
        else:
            starts[name] = end

    def entry(name: str, kind: int, child: int, right: int, start: int, size: int) -> bytes:
        raw = name.encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw) + 2 if name else 0, kind, 1, free, right, child) + bytes(36) + struct.pack("<IQ", start, size)

    mini_start = put(mini)
    # siblings hang to the right of one another, in the order that readers search by
    listed = [entry("Root Entry", 5, 1 if order else free, free, mini_start, len(mini))]
    listed += [entry(n, 2, free, k + 2 if k + 1 < len(order) else free, starts[n], len(streams[n])) for k, n in enumerate(order)]
    listed += [bytes(68) + struct.pack("<III", free, free, free) + bytes(48)] * (-len(listed) % 4)
    directory = put(b"".join(listed))
    mini_fat_start = put(b"".join(struct.pack("<I", x) for x in mini_fat + [free] * (-len(mini_fat) % 128))) if mini_fat else end
    need = 1
    while need * 128 < len(fat) + need:
        need += 1
    if need > 109:
        raise ValueError("over 109 allocation sectors")
    table = fat + [fat_mark] * need
    table += [free] * (need * 128 - len(table))
    at = len(sectors)
    sectors += [struct.pack("<128I", *table[k * 128 : (k + 1) * 128]) for k in range(need)]
    difat = list(range(at, at + need)) + [free] * (109 - need)
    head = bytes.fromhex("d0cf11e0a1b11ae1") + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6)
    head += struct.pack("<IIIIIIIII", 0, need, directory, 0, 4096, mini_fat_start, -(-len(mini_fat) // 128), end, 0) + struct.pack("<109I", *difat)
    return head + b"".join(sectors)


def msg(fields: dict[int, str | int | bytes]) -> bytes:
    """A message file of properties by tag: texts (type 001F), bytes (0102) and 32-bit numbers (0003)."""
    streams, table = {}, bytes(32)
    for tag, value in sorted(fields.items()):
        kind = tag & 0xFFFF
        if kind == 0x0003:
            table += struct.pack("<IIiI", tag, 6, value, 0)
            continue
        raw = value.encode("utf-16-le") if kind == 0x001F else value
        streams[f"__substg1.0_{tag:08X}"] = raw
        table += struct.pack("<IIII", tag, 6, len(raw) + (2 if kind == 0x001F else 0), 0)
    streams["__properties_version1.0"] = table
    return cfb(streams)
