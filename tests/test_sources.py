import struct

import pytest

from postlake.sources import container as c
from postlake.sources.readers import discover, read_store


def heap(parts, client, root):
    """A heap whose allocations are ``parts``; the page map comes last."""
    body = bytearray(8)
    marks = [8]
    for p in parts:
        body += p
        marks.append(len(body))
    at = len(body)
    body += struct.pack("<HH", len(parts), 0) + struct.pack(f"<{len(marks)}H", *marks)
    body[:8] = struct.pack("<HBBI", at, 0xEC, client, root)
    return bytes(body)


def hid(k):
    return k << 5


def bag(*props):
    """A property bag: (id, type, bytes); values over four bytes get an allocation."""
    parts, entries = [b"\xb5\x02\x06\x00" + struct.pack("<I", hid(2)), b""], b""
    for ident, kind, raw in props:
        if kind in (0x0002, 0x0003, 0x000B):
            value = raw.ljust(4, b"\0")
        else:
            parts.append(raw)
            value = struct.pack("<I", hid(len(parts)))
        entries += struct.pack("<HH", ident, kind) + value
    parts[1] = entries
    return heap(parts, 0xBC, hid(1))


def table(rows):
    """Two columns: an integer and a string."""
    cols = struct.pack("<IHBB", 0x0C150003, 0, 4, 0) + struct.pack("<IHBB", 0x3001001F, 4, 4, 1)
    strings, matrix, index = [], b"", b""
    for k, (number, text) in enumerate(rows):
        ref = 0
        if text is not None:
            strings.append(text.encode("utf-16-le"))
            ref = hid(4 + len(strings))
        matrix += struct.pack("<II", number, ref) + bytes([0x80 | (0x40 if text is not None else 0)])
        index += struct.pack("<II", 100 + k, k)
    info = bytes([0x7C, 2]) + struct.pack("<4H", 8, 8, 8, 9) + struct.pack("<III", hid(2), hid(4), 0) + cols
    return heap([info, b"\xb5\x04\x04\x00" + struct.pack("<I", hid(3)), index, matrix, *strings], 0x7C, hid(1))


def index_page(entries, level=0, size=24):
    body = b"".join(e.ljust(size, b"\0") for e in entries).ljust(488, b"\0")
    return body + bytes([len(entries), 20, size, level]) + bytes(20)


def store(nodes, crypt=1):
    """nodes: {node: payload}. Two leaf pages below an internal one for the nodes."""
    blocks, out = {}, bytearray(4096)
    for k, (node, payload) in enumerate(nodes.items()):
        block = 4 * (k + 1)
        blocks[node] = (block, len(out), len(payload))
        out += c.encode(payload, block, crypt)
    out += bytes(-len(out) % 512)
    leaf = [struct.pack("<QQQ", n, blocks[n][0], 0) for n in nodes]
    half = len(leaf) // 2
    offsets = []
    for part in (leaf[:half], leaf[half:]):
        offsets.append(len(out))
        out += index_page(part)
    nbt = len(out)
    out += index_page([struct.pack("<QQQ", 0, 0, o) for o in offsets], level=1)
    bbt = len(out)
    out += index_page([struct.pack("<QQHH", b, o, n, 1) for b, o, n in blocks.values()])
    out[:4], out[8:10], out[10] = b"!BDN", b"SM", 0x17
    out[224:232], out[240:248], out[513] = struct.pack("<Q", nbt), struct.pack("<Q", bbt), crypt
    return bytes(out)


MESSAGE = bag((0x001A, 0x001F, "IPM.Note".encode("utf-16-le")), (0x0037, 0x001F, "Héllo\0rest".encode("utf-16-le")), (0x0E07, 0x0003, struct.pack("<i", -7)), (0x0E1B, 0x000B, b"\1"), (0x0039, 0x0040, struct.pack("<Q", 5)), (0x9999, 0x0102, b"abc"))
NODES = {0x24: MESSAGE, 0x22: bag((0x3001, 0x001E, b"Inbox\0x")), 0x2E: table([(1, "Ann"), (2, None), (3, "Bob")]), 0x44: b"no heap"}


def source(data):
    return c.Source(lambda o, n: data[o : o + n], len(data))


@pytest.mark.parametrize("crypt", [0, 1, 2])
def test_store(crypt):
    s = c.Store(source(store(NODES, crypt)))
    assert [n[0] for n in s.nodes] == list(NODES) and s.header.variant == "unicode" and s.nbt_scan.pages == 3
    got = {p.name: p.text for p in c.properties(s.payload(s.nodes[0][1]))}
    assert got == {"message_class": "IPM.Note", "subject": "Héllo", "message_flags": "-7", "has_attachments": "true", "client_submit_time": "filetime:5", "unknown_0x99990102": None}


def test_cipher_is_as_published():
    # by the definition, a byte at a time
    data, block = bytes(range(256)) * 3, 0x1234_5678
    salt, want = ((block >> 16) ^ block) & 0xFFFF, []
    for x in data:
        low, high = salt & 255, salt >> 8
        y = int(c._HIGH2[(int(c._HIGH1[(x + low) & 255]) + high) & 255])
        want.append((int(c._PERMUTE[(y - high) & 255]) - low) & 255)
        salt = (salt + 1) & 0xFFFF
    assert c.decode(data, block, 2) == bytes(want) and c.encode(bytes(want), block, 2) == data
    with pytest.raises(c.FormatError):
        c.decode(data, block, 9)


def test_table_rows():
    assert [r[:3] for r in c.table_rows(NODES[0x2E])] == [(0, 0x0C150003, "1"), (0, 0x3001001F, "Ann"), (1, 0x0C150003, "2"), (2, 0x0C150003, "3"), (2, 0x3001001F, "Bob")]


def test_damage_is_refused():
    good = store(NODES)
    for bad in (b"", b"!BDN", b"XXXX" + good[4:], good[:10] + b"\x99" + good[11:], good[:513] + b"\x09" + good[514:], good[:300]):
        with pytest.raises(c.FormatError):
            c.Store(source(bad))
    with pytest.raises(c.FormatError):
        c.Source(lambda o, n: b"", 20 << 30)
    for damaged in (MESSAGE[:5], b"\0" * 20, heap([b"\xb5\x02\x06\x01" + struct.pack("<I", hid(2)), struct.pack("<HI", 1, hid(2))], 0xBC, hid(1))):
        with pytest.raises(c.FormatError):
            c.properties(damaged)
    assert c.probe(b"\0\0\0" + MESSAGE) == 3 and c.probe(b"nothing here at all") is None


def test_pages_and_subnodes():
    p = c.page(index_page([bytes(24)] * 3, size=0), c.LAYOUTS["unicode"], True)
    assert p.status == "zero_entry_size" and p.dropped == 3
    cyclic = bytearray(2048)
    cyclic[512:1024] = index_page([struct.pack("<QQQ", 1, 1, 512)], level=1)
    assert c.scan(source(bytes(cyclic)), 512, c.LAYOUTS["unicode"], True).pages == 1
    leaf = b"\x02\x00\x02\x00" + bytes(4) + struct.pack("<3Q", 5, 8, 0) + struct.pack("<3Q", 6, 12, 0)
    assert c.subnode_entries(leaf) == [(5, 8, 0), (6, 12, 0)]
    assert c.subnode_entries(leaf[:-24] + struct.pack("<3Q", 6, 0, 0)) is None and c.subnode_entries(b"\1\1") is None


def test_data_source(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "One.PST").write_bytes(store(NODES, 2))
    (tmp_path / "a.pst").write_bytes(b"not a store")
    (tmp_path / "c.txt").write_bytes(b"")
    (tmp_path / "link.pst").symlink_to(tmp_path / "a.pst")
    assert [p[len(str(tmp_path)) :] for p in discover(str(tmp_path))] == ["/a.pst", "/b/One.PST"]
    files = {r.path[len(str(tmp_path)) :]: r for r in read_store(spark, str(tmp_path)).collect()}
    assert files["/a.pst"].readiness == "unreadable" and files["/b/One.PST"].nbt_entries == 4
    assert read_store(spark, str(tmp_path), "nodes").count() == 4
    props = read_store(spark, str(tmp_path), "properties")
    assert {(r.node_id, r.name) for r in props.where("text is not null").collect()} >= {(0x24, "subject"), (0x22, "display_name")}
    assert {r.text for r in read_store(spark, str(tmp_path), "rows").collect()} == {"1", "2", "3", "Ann", "Bob"}
    assert read_store(spark, str(tmp_path), "blocks").where("content is not null").count() == 4
    with pytest.raises(ValueError):
        read_store(spark, str(tmp_path), "nothing")


def test_layouts_and_embedded_objects():
    leaf = b"\x02\x00\x01\x00" + bytes(4) + struct.pack("<3Q", 0x44, 8, 12)
    kinds = [c.layout_kind(x) for x in (b"abc", leaf, b"\x02\x00\x09\x00" + bytes(4), MESSAGE, NODES[0x2E], b"\xff\xff\xec\0\0\0\0\0", struct.pack("<4H", 1, 2, 4, 0) + bytes(16), b"\xff" * 20)]
    assert kinds == ["short", "subnode_leaf", "subnode_leaf_damaged", "heap_property_context", "heap_table_context", "heap_damaged", "flat_table", "unsupported"]
    s = c.Store(source(store(NODES | {0x64: leaf}, 0)))
    root = next(n[1] for n in s.nodes if n[0] == 0x64)
    ref = bag((0x3701, 0x000D, struct.pack("<II", 0x44, 99)))
    assert s.embedded(ref, root) == (0x44, 8, 12)
    for bad in (bag((0x3701, 0x000D, struct.pack("<II", 0x45, 99))), MESSAGE):
        with pytest.raises(c.FormatError):
            s.embedded(bad, root)
