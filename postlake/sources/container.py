"""Decoding of Outlook personal folder files, from bytes: header, index pages, blocks, heaps, property
bags and tables (S02-S22, S26, S28). Nothing here knows Spark; readers.py runs it in tasks.

Offsets are those of the published file format. Every parse is bounded: what is damaged gives an
error or a status, never an endless loop. It is tested on synthetic bytes only; no real mailbox was
at hand.
"""

from __future__ import annotations

import struct
from collections import deque
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np

MAGIC = b"!BDN"
MAX_FILE, MAX_READ, MAX_BLOCK = 16 << 30, 64 << 20, 64 << 20
MAX_PAGES, MAX_DEPTH, MAX_HEAP, MAX_LEVELS, MAX_ENTRIES = 1024, 16, 4096, 8, 4096
_PERMUTE = np.frombuffer(bytes.fromhex(
    "47f1b4e60b6a7248854e9eebe2f89453e0bba002e85a09abdbe3bac67cc310dd39059630f53760828cc9134a6b1df3fb8f2697ca911701c4322d6e3195ffd923"
    "d1005e79dc443b1a28c5615720903d83b943be67d2464276c06d5b7eb20f16293ca903540dda5ddff6b7c762cd8d06d3695c86d614f7a56675acb1e94521700c"
    "879f74a4224c6fbf1f56aa2eb3783350b0a392bccf191ca763cb1e4d3e4b1b9b4fe7f0eead3ab55904ea40552551e57a893868527bfc27aed7bdfa07f4cc8e5f"
    "ef359c842b15d5773449b6120a7f7188fd9d18417d93d8582ccefe24afdeb836c8a180a69998a82f0e816573e4c2a28ad4e111d0088b2af2ed9a643fc16cf9ec"
), np.uint8)
_HIGH1 = np.frombuffer(bytes.fromhex(
    "41361362a8216ebbf416cc047f64e85d1ef2cb2a74c55e35d295479e962d9a884c7d843fdbac31b6485ff6c4d8398be7233b388ec8c1df25b120a546604e9cfb"
    "aad35651457c550007c92b9d859b09a08fadb30f63ab894bd7a7155a716642bf264a6b98faea7753b270052cfd593a867ece06eb827857c78d43afb41cd45bcd"
    "e2e9274fc3087280cfb0eff5286dbe304d3492d50e3c2232e5e4f99fc2d10a8112e1ee918376e397e6618a1779a4b7dc907a5c8c02a6ca69de501a1193b95287"
    "58fced1d37491b6ae0293399bd6cd994f340546ff0c673b8d63e6518441fdd6710f10c19ecae03a1147ba90bfff8a3c0a201f72ebc2468750dfeba2fb5d0da3d"
), np.uint8)
_HIGH2 = np.frombuffer(bytes.fromhex(
    "14530f56b3c87a9ceb65481716159f02cc547c83000d0c0ba262a876dbd9edc7c5a4dcac8574d6d0a79bae9a967166c36399b8dd73928e847da55ed15d93b157"
    "5150808952944f4e0a6bbc8d7f6e47464140440111cb033ff7f4e1a98f3c3af9fbf0193082092ec99da08649ee6f4d6dc42d813425871b88aafc06a11238fd4c"
    "4272641337246a757743ffe6b44b365ce4d8353d45b92cecb7312b290768a30e697b189e2139be281a5b78f523ca2ab0af3efe048ce7e5983295d3f64ae8a6ea"
    "e9f3d52f7020f21f0567ad5510cecde3273bdabad7c226d4911dd21c2233f8faf15aefcf90b68bb5bdc0bf08971e6ce261e0c6c159abbb58de5fdf60797eb28a"
), np.uint8)


class FormatError(ValueError):
    pass


class Layout(NamedTuple):
    """How a variant lays out its index pages."""

    variant: str
    page: int
    area: int
    count_width: int
    id_width: int

    @property
    def meta(self) -> int:
        return self.area


LAYOUTS = {
    "unicode": Layout("unicode", 512, 488, 1, 8),
    "ansi": Layout("ansi", 512, 496, 1, 4),
    "ost2013": Layout("ost2013", 4096, 4056, 2, 8),
    "unknown": Layout("unknown", 512, 488, 1, 8),
}
_VARIANTS = {0x0E: "ansi", 0x0F: "ansi", 0x15: "unicode", 0x17: "unicode", 0x24: "ost2013"}


def need(data: bytes, at: int, size: int) -> bytes:
    """A range that has to lie within the data."""
    if at < 0 or size < 0 or at + size > len(data):
        raise FormatError(f"{size} bytes at {at} lie outside {len(data)}")
    return data[at : at + size]


def uint(data: bytes, at: int, width: int) -> int:
    return int.from_bytes(need(data, at, width), "little")


class Source:
    """Random access with a budget. ``read(offset, size)`` may return less at the end."""

    def __init__(self, read: Callable[[int, int], bytes], size: int, most: int = MAX_FILE):
        if size > most:
            raise FormatError(f"a file of {size} bytes is over the budget of {most}")
        self._read, self.size = read, size

    def at(self, offset: int, size: int) -> bytes:
        if size > MAX_READ or offset < 0 or offset + size > self.size:
            raise FormatError(f"cannot read {size} bytes at {offset} of {self.size}")
        got = self._read(offset, size)
        if len(got) != size:
            raise FormatError(f"short read at {offset}")
        return got


class Header(NamedTuple):
    variant: str
    version: int
    crypt: int | None
    nbt_root: int | None
    bbt_root: int | None
    root_source: str | None


#: variant: places of the (NBT, BBT) root offsets and their width, the first that lies in the file counts.
_ROOTS = {"unicode": (("root_block", 224, 240, 8), ("legacy", 48, 56, 8)), "ansi": (("root_block", 188, 196, 4),), "unknown": (("legacy", 48, 56, 8),)}
_ROOTS["ost2013"] = _ROOTS["unicode"]


def header(source: Source) -> Header:
    """S04, S05."""
    head = source.at(0, min(source.size, 514))
    if len(head) < 64:
        raise FormatError(f"a header of {len(head)} bytes is too short")
    if head[:4] != MAGIC:
        raise FormatError("the magic is missing")
    variant = _VARIANTS.get(head[10], "unknown")
    page = LAYOUTS[variant].page
    roots: tuple = (None, None, None)
    for name, n, b, width in _ROOTS[variant]:
        if max(n, b) + width > len(head):
            continue
        pair = uint(head, n, width), uint(head, b, width)
        if all(0 < x and x + page <= source.size for x in pair):
            roots = (*pair, name)
            break
    crypt = {"ansi": 461, "unknown": None}.get(variant, 513)
    return Header(variant, uint(head, 10, 2), head[crypt] if crypt is not None and crypt < len(head) else None, *roots)


def readiness(h: Header) -> str:
    """S06."""
    if h.variant == "unknown":
        return "unsupported_version"
    if h.nbt_root is None:
        return "roots_out_of_bounds"
    return "ready" if h.crypt in (0, 1, 2) else "unsupported_crypt_method"


class Page(NamedTuple):
    level: int
    entries: list[tuple[int, ...]]
    children: list[int]
    dropped: int
    status: str


def page(data: bytes, layout: Layout, nodes: bool) -> Page:
    """Leaf entries are (block, offset, size) or (node, data block, subnode block)."""
    data = need(data, 0, layout.page)
    w, c = layout.id_width, layout.count_width
    count, capacity, size, level = (uint(data, layout.meta + k * c, c) for k in range(4))
    least = 3 * w if level or nodes else 2 * w + 2
    if size < least:
        return Page(level, [], [], count, "zero_entry_size" if not size else "entry_size_too_small")
    kept = min(count, capacity, layout.area // size)
    entries, children = [], []
    for at in range(0, kept * size, size):
        if level:
            children.append(uint(data, at + 2 * w, w))
        elif nodes:
            entries.append((uint(data, at, w), uint(data, at + w, w), uint(data, at + 2 * w, w)))
        else:
            entries.append((uint(data, at, w), uint(data, at + w, w), uint(data, at + 2 * w, 2)))
    kind = "internal" if level else "leaf"
    return Page(level, entries, children, count - kept, f"complete_{kind}" if kept == count else f"truncated_{kind}_entries")


class Scan(NamedTuple):
    entries: list[tuple[int, ...]]
    pages: int
    failed: int
    dropped: int


def scan(source: Source, root: int, layout: Layout, nodes: bool) -> Scan:
    """Breadth first from the root, each page once. An error on the first page ends the scan,
    later ones are counted."""
    queue, seen, out = deque([root]), set(), []
    failed = dropped = 0
    while queue and len(seen) < MAX_PAGES:
        at = queue.popleft()
        if at in seen:
            continue
        seen.add(at)
        try:
            p = page(source.at(at, layout.page), layout, nodes)
        except FormatError:
            if at == root:
                raise
            failed += 1
            continue
        out += p.entries
        dropped += p.dropped
        queue.extend(p.children)
    return Scan(out, len(seen), failed, dropped)


def decode(data: bytes, block: int, method: int) -> bytes:
    """Vectorised; the cyclic cipher's salt only depends on the block and the position."""
    x = np.frombuffer(data, np.uint8)
    if method == 0:
        return data
    if method == 1:
        return _PERMUTE[x].tobytes()
    if method != 2:
        raise FormatError(f"no crypt method {method}")
    salt = ((((block >> 16) & 0xFFFF) ^ (block & 0xFFFF)) + np.arange(len(x))).astype(np.uint16)
    low, high = (salt & 255).astype(np.uint8), (salt >> 8).astype(np.uint8)
    return (_PERMUTE[_HIGH2[_HIGH1[x + low] + high] - high] - low).tobytes()


def encode(data: bytes, block: int, method: int) -> bytes:
    """The inverse of decode, for writing fixtures."""
    back = lambda t: np.argsort(t).astype(np.uint8)
    x = np.frombuffer(data, np.uint8)
    if method == 1:
        return back(_PERMUTE)[x].tobytes()
    if method == 2:
        salt = ((((block >> 16) & 0xFFFF) ^ (block & 0xFFFF)) + np.arange(len(x))).astype(np.uint16)
        low, high = (salt & 255).astype(np.uint8), (salt >> 8).astype(np.uint8)
        return (back(_HIGH1)[back(_HIGH2)[back(_PERMUTE)[x + low] + high] - high] - low).tobytes()
    return data


class Heap:
    """A heap on a node; allocations by one-based index."""

    def __init__(self, data: bytes):
        at = uint(need(data, 0, 8), 0, 2)
        if data[2] != 0xEC:
            raise FormatError(f"heap signature 0x{data[2]:02x}")
        count = uint(data, at, 2)
        if count > MAX_HEAP:
            raise FormatError(f"{count} heap allocations")
        marks = struct.unpack(f"<{count + 1}H", need(data, at + 4, 2 * count + 2))
        self.data, self.client, self.root = data, data[3], uint(data, 4, 4)
        self.spans = {k + 1: (a, b) for k, (a, b) in enumerate(zip(marks, marks[1:])) if a <= b <= len(data)}

    def get(self, hid: int) -> bytes:
        span = self.spans.get(hid >> 5)
        if span is None:
            raise FormatError(f"no heap allocation 0x{hid:08x}")
        return self.data[span[0] : span[1]]


def probe(data: bytes) -> int | None:
    """Where in the first 4096 bytes a valid heap begins."""
    for at in range(max(0, min(len(data), 4096) - 7)):
        if data[at + 2] == 0xEC:
            try:
                Heap(data[at:])
                return at
            except FormatError:
                pass
    return None


def tree_entries(heap: Heap, hid: int, key: int | None = None, value: int | None = None) -> list[tuple[bytes, bytes]]:
    """The (key, value) entries of a heap's B-tree, whose header is allocation ``hid``."""
    head = need(heap.get(hid), 0, 8)
    if head[0] != 0xB5:
        raise FormatError(f"tree type 0x{head[0]:02x}")
    k, v, levels = head[1], head[2], head[3]
    if (key is not None and k != key) or (value is not None and v != value) or not k:
        raise FormatError(f"entry sizes {k} and {v}")
    if levels > MAX_LEVELS:
        raise FormatError(f"{levels} tree levels")
    seen: set[int] = set()

    def walk(at: int, level: int) -> Iterator[tuple[bytes, bytes]]:
        if at in seen:
            raise FormatError(f"tree cycle at 0x{at:08x}")
        seen.add(at)
        node = heap.get(at)
        step = k + (4 if level else v)
        for x in range(0, len(node) // step * step, step):
            if level:
                yield from walk(uint(node, x + k, 4), level - 1)
            else:
                yield node[x : x + k], node[x + k : x + k + v]

    out = []
    root = uint(head, 4, 4)
    if root:
        for entry in walk(root, levels):
            if len(out) == MAX_ENTRIES:
                break
            out.append(entry)
    return out


#: Public property tags: name by property id.
NAMES = {
    0x001A: "message_class", 0x0037: "subject", 0x0039: "client_submit_time", 0x0042: "sent_representing_name", 0x0065: "sent_representing_email", 0x0070: "conversation_topic", 0x0071: "conversation_index",
    0x007D: "transport_headers", 0x0C15: "recipient_type", 0x0C1A: "sender_name", 0x0C1E: "sender_address_type", 0x0C1F: "sender_email", 0x0E02: "display_bcc", 0x0E03: "display_cc", 0x0E04: "display_to", 0x0E06: "delivery_time",
    0x0E07: "message_flags", 0x0E08: "message_size", 0x0E1B: "has_attachments", 0x0E20: "attach_size", 0x1000: "body", 0x1009: "rtf_compressed", 0x1013: "html", 0x1035: "internet_message_id", 0x1039: "internet_references",
    0x1042: "in_reply_to_id", 0x3001: "display_name", 0x3002: "address_type", 0x3003: "email_address", 0x3007: "creation_time", 0x3008: "last_modification_time", 0x3602: "content_count", 0x3701: "attach_data", 0x3703: "attach_extension",
    0x3704: "attach_filename", 0x3705: "attach_method", 0x3707: "attach_long_filename", 0x370E: "attach_mime_tag", 0x3712: "attach_content_id", 0x39FE: "smtp_address", 0x7FFE: "attachment_hidden",
}
_INLINE = {0x0002: 2, 0x0003: 4, 0x000B: 1}
PLAUSIBLE = {0x0002, 0x0003, 0x0005, 0x000B, 0x000D, 0x0014, 0x001E, 0x001F, 0x0040, 0x0048, 0x0102, 0x1002, 0x1003, 0x101E, 0x101F, 0x1040, 0x1102}


def value_text(kind: int, raw: bytes) -> str | None:
    """A value as text; null where the bytes don't hold one of that type."""
    if kind == 0x001F:
        units = np.frombuffer(raw[: len(raw) // 2 * 2], "<u2")
        end = np.flatnonzero(units == 0)
        return raw[: 2 * (int(end[0]) if len(end) else len(units))].decode("utf-16-le", "replace")
    if kind == 0x001E:
        return raw.split(b"\0")[0].decode("utf-8", "replace")
    width = {0x0002: 2, 0x0003: 4, 0x0014: 8}.get(kind)
    if width:
        return str(int.from_bytes(raw[:width], "little", signed=True)) if len(raw) >= width else None
    if kind == 0x000B:
        return str(bool(raw[:1].strip(b"\0"))).lower()
    if kind == 0x0040:
        return f"filetime:{int.from_bytes(raw[:8], 'little')}" if len(raw) >= 8 else None
    return f"{len(raw)} bytes" if kind == 0x0102 else f"{len(raw)} bytes unknown"


class Property(NamedTuple):
    tag: int
    name: str
    raw: bytes
    text: str | None
    status: str


def properties(data: bytes) -> list[Property]:
    """A node's property bag. Unknown properties are kept with their bytes; a tag whose bytes
    are swapped is turned round if only that makes its type plausible."""
    heap = Heap(data)
    out = []
    for key, value in tree_entries(heap, heap.root, 2, 6):
        ident, kind = uint(key, 0, 2), uint(value, 0, 2)
        status = "property_decoded"
        if kind not in PLAUSIBLE:
            turned = int.from_bytes(((ident << 16) | kind).to_bytes(4, "big"), "little")
            if turned & 0xFFFF in PLAUSIBLE:
                ident, kind, status = turned >> 16, turned & 0xFFFF, "property_decoded_byte_swapped"
        if kind in _INLINE:
            raw = value[2 : 2 + _INLINE[kind]]
        else:
            hnid = uint(value, 2, 4)
            raw = heap.get(hnid) if hnid and not hnid & 0x1F and hnid >> 5 in heap.spans else value[2:6]
        name = NAMES.get(ident)
        tag = (ident << 16) | kind
        if name is None:
            out.append(Property(tag, f"unknown_0x{tag:08x}", raw, None, "property_unknown_retained"))
        else:
            text = value_text(kind, raw)
            out.append(Property(tag, name, raw, text, status if text is not None else "property_value_undecodable"))
    return out


class Column(NamedTuple):
    tag: int
    offset: int
    size: int
    bit: int


class Table(NamedTuple):
    columns: list[Column]
    bounds: tuple[int, int, int, int]
    index: int
    rows: int


def table_info(data: bytes) -> Table:
    """The columns' bits have to be a permutation."""
    head = need(data, 0, 22)
    if head[0] != 0x7C:
        raise FormatError(f"table type 0x{head[0]:02x}")
    n = head[1]
    need(data, 22, 8 * n)
    bounds = struct.unpack_from("<4H", data, 2)
    if any(a > b for a, b in zip(bounds, bounds[1:])):
        raise FormatError("table boundaries fall")
    columns = [Column(*struct.unpack_from("<IHBB", data, 22 + 8 * k)) for k in range(n)]
    if any(not c.size for c in columns) or sorted(c.bit for c in columns) != list(range(n)):
        raise FormatError("column sizes or bits")
    return Table(columns, bounds, uint(data, 10, 4), uint(data, 14, 4))


def table_rows(data: bytes, outside: Callable[[int], bytes] | None = None) -> list[tuple[int, int, str | None, bytes]]:
    """(row, tag, text, raw) of the cells that exist. ``outside`` loads a row matrix that
    lies in a subnode. A row's number is its position in the matrix."""
    heap = Heap(data)
    info = table_info(heap.get(heap.root))
    if not info.rows:
        return []
    matrix = heap.get(info.rows) if not info.rows & 0x1F else outside(info.rows) if outside else b""
    width = info.bounds[3]
    if not width:
        return []
    out = []
    for _, (key, value) in enumerate(tree_entries(heap, info.index, 4, 4)):
        row = uint(value, 0, 4)
        cells = matrix[row * width : (row + 1) * width]
        if len(cells) < width:
            continue
        mask = cells[info.bounds[2] : width]
        for c in info.columns:
            if c.bit // 8 < len(mask) and mask[c.bit // 8] & (0x80 >> c.bit % 8) and c.offset + c.size <= info.bounds[2]:
                raw = cells[c.offset : c.offset + c.size]
                kind = c.tag & 0xFFFF
                if kind not in (0x0002, 0x0003, 0x000B, 0x0014, 0x0040):
                    hnid = uint(raw, 0, min(4, len(raw)))
                    raw = heap.get(hnid) if hnid and not hnid & 0x1F and hnid >> 5 in heap.spans else raw
                out.append((row, c.tag, value_text(kind, raw), raw))
    return out


def subnode_entries(data: bytes) -> list[tuple[int, int, int]] | None:
    """(node, data block, subnode block) of a leaf; null where it isn't one, or any data block is 0."""
    if len(data) < 8 or data[0] != 2 or data[1] != 0 or data[4:8] != bytes(4) or 8 + 24 * uint(data, 2, 2) > len(data):
        return None
    rows = [struct.unpack_from("<3Q", data, 8 + 24 * k) for k in range(uint(data, 2, 2))]
    return None if any(not r[1] or r[0] >> 32 for r in rows) else rows


_HEAPS = {0x7C: "heap_table_context", 0xBC: "heap_property_context", 0xB5: "heap_bth"}


def layout_kind(data: bytes) -> str:
    """What a subnode's block holds, by its first bytes. Flat tables are only told from the
    rest, by whether their declared columns and rows fit."""
    if len(data) < 8:
        return "short"
    if data[:2] == b"\x02\x00":
        return "subnode_leaf" if subnode_entries(data) is not None else "subnode_leaf_damaged"
    if data[2] == 0xEC:
        try:
            return _HEAPS.get(Heap(data).client, "heap_other")
        except FormatError:
            return "heap_damaged"
    columns, rows, width = struct.unpack_from("<3H", data)
    end = 8 + 8 * columns
    return "flat_table" if 0 < columns <= 256 and width and end + rows * width <= len(data) else "unsupported"


class Store:
    """One file: its indexes as dictionaries (S11), blocks on demand."""

    def __init__(self, source: Source):
        self.source, self.header = source, header(source)
        state = readiness(self.header)
        if state != "ready":
            raise FormatError(state)
        layout = LAYOUTS[self.header.variant]
        self.bbt_scan = scan(source, self.header.bbt_root, layout, False)
        self.nbt_scan = scan(source, self.header.nbt_root, layout, True)
        self.bbt = {}
        for block, offset, size in self.bbt_scan.entries:
            self.bbt.setdefault(block, (offset, size))
        self.nodes = self.nbt_scan.entries

    def block(self, block: int) -> bytes:
        """An internal block is never encoded."""
        if block not in self.bbt:
            raise FormatError(f"no block {block}")
        offset, size = self.bbt[block]
        if size > MAX_BLOCK:
            raise FormatError(f"a block of {size} bytes")
        raw = self.source.at(offset, size)
        return raw if block & 2 else decode(raw, block, self.header.crypt)

    def payload(self, block: int) -> bytes:
        """A block, or the data tree of one level that it heads."""
        raw = self.block(block)
        if not block & 2 or len(raw) < 8 or raw[:2] != b"\x01\x01":
            return raw
        count, total = uint(raw, 2, 2), uint(raw, 4, 4)
        kids = [uint(raw, 8 + 8 * k, 8) for k in range(count)]
        if len(set(kids)) != len(kids):
            raise FormatError("a data tree names a block twice")
        whole = b"".join(self.block(k) for k in kids)
        if len(whole) != total:
            raise FormatError(f"a data tree of {len(whole)} bytes instead of {total}")
        return whole

    def subnodes(self, root: int) -> dict[int, tuple[int, int]]:
        """Every subnode below a root block, breadth first, each block once."""
        out: dict[int, tuple[int, int]] = {}
        queue, seen = deque([(root, 0)]), set()
        while queue:
            block, depth = queue.popleft()
            if not block or block in seen or depth > MAX_DEPTH:
                continue
            seen.add(block)
            for node, data, sub in subnode_entries(self.block(block)) or []:
                out.setdefault(node, (data, sub))
                queue.append((sub, depth + 1))
        return out

    def embedded(self, attachment: bytes, subnode_root: int) -> tuple[int, int, int]:
        """(node, data block, subnode block) of the message that an attachment's object
        property names by an 8-byte (node, size). The node has to be among the attachment's own
        subnodes, so what another attachment holds is out of reach."""
        found = [p for p in properties(attachment) if p.tag >> 16 == 0x3701 and len(p.raw) == 8]
        if len(found) != 1:
            raise FormatError(f"{len(found)} object references")
        node = uint(found[0].raw, 0, 4)
        below = self.subnodes(subnode_root)
        if node not in below:
            raise FormatError(f"no subnode 0x{node:08x}")
        return node, *below[node]
