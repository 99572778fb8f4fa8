"""Mailbox files as tables: discovery and a Spark data source, one task a file.

    spark.dataSource.register(MailStore)
    spark.read.format("mailstore").option("path", folder).option("table", "properties").load()

Tables: files, nodes, blocks, properties, rows. A file that can't be read gives a row in ``files``
that says why, and none elsewhere; the others aren't affected.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from postlake.sources import container as c

MAX_FOLDERS_DEEP, MAX_FILES = 64, 100_000
SCHEMAS = {
    "files": "path string, size bigint, variant string, version int, crypt int, readiness string, bbt_entries bigint, nbt_entries bigint, message string",
    "nodes": "path string, node_id bigint, data_block bigint, subnode_block bigint, ordinal bigint",
    "blocks": "path string, block_id bigint, offset bigint, size bigint, content binary, message string",
    "properties": "path string, node_id bigint, tag bigint, name string, raw binary, text string, status string",
    "rows": "path string, node_id bigint, row bigint, tag bigint, text string, raw binary",
}


def discover(path: str, suffix: str = ".pst") -> list[str]:
    """The files of a folder and below, sorted; links aren't followed, one as the root is refused."""
    if os.path.islink(path):
        raise ValueError(f"{path} is a link")
    if os.path.isfile(path):
        return [path]
    found = []
    base = path.rstrip("/").count("/")
    for folder, kids, files in os.walk(path, followlinks=False):
        if folder.count("/") - base >= MAX_FOLDERS_DEEP:
            kids.clear()
        for name in files:
            whole = os.path.join(folder, name)
            if name.lower().endswith(suffix) and not os.path.islink(whole):
                found.append(whole)
                if len(found) > MAX_FILES:
                    raise ValueError(f"more than {MAX_FILES} files")
    return sorted(found)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _rows(path: str, store: c.Store, table: str) -> Iterator[tuple]:
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    if table == "nodes":
        for k, (node, data, sub) in enumerate(store.nodes):
            yield path, signed(node), signed(data), signed(sub) or None, k
    elif table == "blocks":
        for block, (offset, size) in store.bbt.items():
            try:
                content, message = store.block(block), None
            except c.FormatError as e:
                content, message = None, str(e)
            yield path, signed(block), signed(offset), size, content, message
    else:
        for node, data, sub in store.nodes:
            try:
                payload = store.payload(data)
                kind = c.Heap(payload).client
                if table == "properties" and kind == 0xBC:
                    for p in c.properties(payload):
                        yield path, signed(node), p.tag, p.name, p.raw, p.text, p.status
                elif table == "rows" and kind == 0x7C:
                    below = store.subnodes(sub)
                    for row, tag, text, raw in c.table_rows(payload, lambda n: store.payload(below[n][0]) if n in below else b""):  # noqa: B023
                        yield path, signed(node), row, tag, text, raw
            except c.FormatError:
                continue  # a node without a heap holds neither


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str):
        self.files, self.table = discover(path), table

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.files]

    def read(self, partition: _File) -> Iterator[tuple]:
        path = partition.path
        size = os.path.getsize(path)
        with open(path, "rb") as f:

            def at(offset: int, length: int) -> bytes:
                f.seek(offset)
                return f.read(length)

            head = None
            try:
                source = c.Source(at, size)
                head = c.header(source)
                store = c.Store(source)
            except c.FormatError as e:
                if self.table == "files":
                    yield path, size, head and head.variant, head and head.version, head and head.crypt, c.readiness(head) if head else "unreadable", None, None, str(e)
                return
            if self.table == "files":
                yield path, size, head.variant, head.version, head.crypt, "ready", len(store.bbt_scan.entries), len(store.nodes), None
            else:
                yield from _rows(path, store, self.table)


class MailStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mailstore"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "files")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("table", "files"))


def read_store(spark: SparkSession, path: str, table: str = "files") -> DataFrame:
    if table not in SCHEMAS:
        raise ValueError(f"no table {table}")
    spark.dataSource.register(MailStore)
    return spark.read.format("mailstore").option("path", path).option("table", table).load()
