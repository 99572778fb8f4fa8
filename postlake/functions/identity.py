"""Deterministic keys, node identities and bit predicates on node ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Part = Column | str


def _column(part: Part) -> Column:
    return part if isinstance(part, Column) else F.lit(part)


def stable_id(prefix: str, *parts: Part) -> Column:
    """Prefix and 16 hex digits of the SHA-256 of the parts, each closed by 0x1f. A null part
    counts as empty, so that a key is never null."""
    closed = [x for p in parts for x in (F.coalesce(_column(p).cast("string"), F.lit("")), F.lit("\x1f"))]
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat(*closed).cast("binary"), 256), 1, 16))


def archive_id(source: Part) -> Column:
    return stable_id("pst", source)


def folder_key(archive: Part, identity: Part) -> Column:
    return stable_id("folder", archive, identity)


def message_key(archive: Part, identity: Part) -> Column:
    return stable_id("msg", archive, identity)


def embedded_key(parent: Part, attachment: Part, data_nid: Column) -> Column:
    return stable_id("msg", parent, attachment, F.lpad(F.lower(F.hex(data_nid)), 8, "0"))


def body_key(message: Part, kind: Part) -> Column:
    return stable_id("body", message, kind)


def attachment_key(message: Part, ordinal: Part) -> Column:
    return stable_id("att", message, ordinal)


def recipient_key(message: Part, role: Part, ordinal: Part) -> Column:
    return stable_id("rcpt", message, role, ordinal)


def node_identity(node: Column) -> Column:
    """X06."""
    return F.concat(F.lit("node_"), F.lower(F.hex(node)))


def swapped32(value: Column) -> Column:
    """The bytes of an unsigned 32-bit number the other way round."""
    v = value.cast("bigint")
    at = lambda shift, left: F.shiftleft(F.shiftright(v, shift).bitwiseAND(255), left)
    return at(0, 24) + at(8, 16) + at(16, 8) + at(24, 0)


#: Type codes of properties that a value may plausibly have.
PLAUSIBLE_TYPES = (0x0002, 0x0003, 0x0005, 0x000B, 0x0014, 0x001E, 0x001F, 0x0040, 0x0048, 0x0102, 0x1002, 0x1003, 0x101E, 0x101F, 0x1040, 0x1102, 0x000D)


def tag_type(tag: Column) -> Column:
    """X08."""
    return tag.cast("bigint").bitwiseAND(0xFFFF)


def tag_is_plausible(tag: Column) -> Column:
    return tag_type(tag).isin(*PLAUSIBLE_TYPES)


def low_bits(node: Column) -> Column:
    return node.cast("bigint").bitwiseAND(0x1F)


def _named(code: Column, names: dict[int, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def folder_kind(node: Column) -> Column:
    """Null where the node is no folder."""
    return _named(low_bits(node), {2: "normal_folder", 3: "search_folder"})


def message_kind(node: Column) -> Column:
    """B02."""
    return _named(low_bits(node), {4: "normal_message", 8: "associated_message"})


def table_kind(node: Column) -> Column:
    """B03."""
    return _named(low_bits(node), {0x0D: "hierarchy_table", 0x0E: "contents_table", 0x0F: "associated_contents_table", 0x10: "search_contents_table"})


def owner_folder(node: Column) -> Column:
    """The folder that a table belongs to."""
    v = node.cast("bigint")
    return (v - v.bitwiseAND(0x1F)).bitwiseOR(2)


def reference_kind(hnid: Column) -> Column:
    """What a value reference points at."""
    return F.when(hnid == 0, "null").when(low_bits(hnid) == 0, "heap").otherwise("node")


def heap_index(hid: Column) -> Column:
    """Null where the index is out of 1..65535."""
    i = F.shiftright(hid.cast("bigint"), 5)
    return F.when(i.between(1, 65535), i)


def is_internal_block(block: Column) -> Column:
    """B07."""
    return block.cast("bigint").bitwiseAND(2) != 0


def is_recipient_table(node: Column) -> Column:
    """B08."""
    return low_bits(node) == 0x12
