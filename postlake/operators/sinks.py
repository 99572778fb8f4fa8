"""Mail as text and files: mbox, EML, JSON lines, sharded archives, sidecars (K01, K02, K04-K08, K10,
K17, W02, W03, W11, F13, L03)."""

from __future__ import annotations

import io
import os
import tarfile
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.functions import text as tx
from postlake.functions.mailcode import rtf_udf, unstructured_udf

_EPOCH = "Thu Jan 1 00:00:00 1970"


def separator(sender: Column, date: Column) -> Column:
    """The From line before a message of an mbox."""
    return F.concat(F.lit("From "), F.coalesce(tx.clean_header(sender), F.lit("MAILER-DAEMON")), F.lit(" "), F.coalesce(date, F.lit(_EPOCH)), F.lit("\n"))


def mbox_folders(messages: DataFrame) -> DataFrame:
    """K04, L03. messages(folder_path, message_key, sender, date, content string) to (folder_path,
    messages, mbox): a folder is one row, as it is one file; mail_stream is for folders too large for that."""
    m = messages.select("folder_path", "message_key", F.concat(separator(F.col("sender"), F.col("date")), tx.mboxrd(F.col("content")), F.lit("\n")).alias("part"))
    rows = m.groupBy("folder_path").agg(F.count("*").alias("messages"), F.array_sort(F.collect_list(F.struct("message_key", "part"))).alias("parts"))
    return rows.select("folder_path", "messages", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("mbox"))


def mail_stream(messages: DataFrame) -> DataFrame:
    """The same parts in order, a row each; written by partition no folder has to fit in memory."""
    part = F.concat(separator(F.col("sender"), F.col("date")), tx.mboxrd(F.col("content")), F.lit("\n"))
    return messages.select("folder_path", "message_key", part.alias("part")).repartition("folder_path").sortWithinPartitions("folder_path", "message_key")


def numbered(messages: DataFrame, folder: str = "folder_path", key: str = "message_key", suffix: str = "") -> DataFrame:
    """Adds file_name, 1 and up within a folder."""
    n = F.row_number().over(Window.partitionBy(folder).orderBy(key))
    return messages.withColumn("file_name", F.concat(n.cast("string"), F.lit(suffix)))


def folder_directories(folders: DataFrame) -> DataFrame:
    """W03. folders(folder_key, folder_path): adds directory; the second and later folders of one
    safe path get _0002 and so on."""
    d = folders.withColumn("__safe", tx.safe_folder_path(F.col("folder_path")))
    n = F.row_number().over(Window.partitionBy("__safe").orderBy("folder_path", "folder_key"))
    d = d.withColumn("__n", n)
    return d.withColumn("directory", F.when(F.col("__n") == 1, F.col("__safe")).otherwise(F.concat("__safe", F.lit("_"), F.lpad(F.col("__n").cast("string"), 4, "0")))).drop("__safe", "__n")


def plain_eml(messages: DataFrame) -> DataFrame:
    """K08, F13. messages(message_key, subject, sender_name, sender_address, to_list, cc_list, date,
    message_id, text) to (message_key, eml): null unless subject, sender, date, text and a
    recipient are there."""
    clean = {c: tx.clean_header(F.col(c)) for c in ("subject", "sender_name", "sender_address", "message_id")}
    field = lambda name, v: F.coalesce(F.concat(F.lit(f"{name}: "), v, F.lit("\r\n")), F.lit(""))
    body = tx.crlf(F.col("text"))
    # encoding is only asked of Python where there is something to encode
    m = messages.withColumn("__subject", clean["subject"])
    plain = m.where("__subject is null or __subject rlike '^[\\\\x00-\\\\x7F]*$'").withColumn("__coded", F.col("__subject"))
    coded = m.where("not (__subject is null or __subject rlike '^[\\\\x00-\\\\x7F]*$')").withColumn("__coded", unstructured_udf("__subject"))
    d = plain.unionByName(coded)
    eml = F.concat(
        field("From", tx.format_address(clean["sender_name"], clean["sender_address"])), field("To", F.col("to_list")), field("Cc", F.col("cc_list")), field("Subject", F.col("__coded")),
        field("Date", F.col("date")), field("Message-ID", clean["message_id"]), F.lit("MIME-Version: 1.0\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"),
        body, F.when(body.endswith("\r\n"), "").otherwise("\r\n"),
    )
    whole = F.col("__subject").isNotNull() & clean["sender_address"].isNotNull() & F.coalesce("to_list", "cc_list").isNotNull() & F.col("date").isNotNull() & F.col("text").isNotNull()
    return d.select("message_key", F.when(whole, eml).alias("eml"))


def sidecars(messages: DataFrame, folders: DataFrame) -> DataFrame:
    """(folder_path, size_line): how many messages were written and how many the folder holds."""
    n = messages.groupBy("folder_path").agg(F.count("*").alias("n"))
    f = folders.groupBy("folder_path").agg(F.min("item_count").alias("stored"))
    return n.join(f, "folder_path", "left").select("folder_path", F.concat(F.col("n").cast("string"), F.lit(" "), F.coalesce("stored", "n").cast("string"), F.lit("\n")).alias("size_line"))


def json_lines(records: DataFrame) -> DataFrame:
    """One object a row, nulls kept, fields in the table's order."""
    return records.select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("value"))


def _shard_batches(batches: Iterator[pa.RecordBatch], target: int) -> Iterator[pa.RecordBatch]:
    """Sorted files of whole groups with their shard. Behind an unknown size a group's sum is unknown and nothing closes."""
    group, used, shard = ..., 0, 0
    for batch in batches:
        out = []
        for g, size in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if g != group and not (g != g and group != group):  # one NaN is as good as another
                group, used, shard = g, 0, 0
            if used is None or size is None:
                used = None
            elif used > 0 and used + size > target:
                used, shard = size, shard + 1
            else:
                used += size
            out.append(shard)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], [*batch.schema.names, "shard"])


def shards(files: DataFrame, target: int, group: str | None = None) -> DataFrame:
    """W11. files(path, size): adds shard. A shard closes before the file that would take it past
    ``target``; the running sum restarts there, which no window can say. A task goes through the
    sizes of its groups once, in path order, and holds a batch of them: group cuts a large run into
    shares that shard on their own."""
    g = F.col(f"`{group}`") if group else F.lit(0)
    f = files.select(g.alias("__g"), "path", F.col("size").cast("bigint").alias("size"))
    f = f.repartition("__g").sortWithinPartitions("__g", "path", "size")
    out = f.mapInArrow(partial(_shard_batches, target=target), f"__g {f.schema['__g'].dataType.simpleString()}, path string, size bigint, shard int")
    return out.withColumnRenamed("__g", group) if group else out.drop("__g")


def _tar_batches(batches: Iterator[pa.RecordBatch], folder: str, target: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    out, used, shard, handle, path = [], 0, 0, None, None

    def close():
        nonlocal handle
        if handle is not None:
            handle.close()
            os.replace(f"{path}.part", path)
            handle = None

    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            size = len(content) + 1024
            if handle is not None and used + size > target:
                close()
            if handle is None:
                path = os.path.join(folder, f"part-{part:05d}-{shard:05d}.tar")
                handle, used, shard = tarfile.open(f"{path}.part", "w"), 0, shard + 1
            entry = tarfile.TarInfo(name)
            entry.size, entry.mode, entry.mtime = len(content), 0o644, 0
            handle.addfile(entry, io.BytesIO(content))
            used += size
            out.append((os.path.basename(path), name, len(content)))
    close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["shard", "path", "size"])


def write_tar(files: DataFrame, folder: str, target: int = 1 << 30) -> DataFrame:
    """K02. files(path, content) into archives of about ``target`` bytes in a shared folder: each
    task writes its own, in path order, under a temporary name until it is whole, so a task that is
    run again replaces what it left. Returns (shard, path, size)."""
    os.makedirs(folder, exist_ok=True)
    rows = files.select("path", "content").repartitionByRange("path").sortWithinPartitions("path")
    return rows.mapInArrow(lambda b: _tar_batches(b, folder, target), "shard string, path string, size bigint")


def rtf_files(bodies: DataFrame) -> DataFrame:
    """K16. bodies(message_key, body_type, content): (message_key, path, content, status) of the RTF
    bodies; content is null where it didn't decompress to what its header says."""
    d = bodies.where("body_type = 'rtf'").select("message_key", rtf_udf("content").alias("content"))
    ok = F.col("content").isNotNull() & F.startswith(F.col("content"), F.lit(b"{\\rtf"))
    return d.select("message_key", F.concat(F.lit("rtf/"), "message_key", F.lit(".rtf")).alias("path"), F.when(ok, F.col("content")).alias("content"), F.when(ok, "rtf_validated").otherwise("rtf_invalid").alias("status"))


def append_progress(events: DataFrame, path: str) -> None:
    """Events as JSON lines behind those that are there."""
    json_lines(events).write.mode("append").text(path)


def typed_streams(contacts: DataFrame, calendars: DataFrame, journals: DataFrame, frame: tuple[str, str]) -> DataFrame:
    """K11. (folder_path, text) of contacts, events and journals to (folder_path, file, content): a
    file of each kind a folder; the events lie between the frame's two parts."""
    out = None
    for name, rows, (head, tail) in (("contacts.vcf", contacts, ("", "")), ("calendar.ics", calendars, frame), ("journal.ics", journals, ("", ""))):
        g = rows.groupBy("folder_path").agg(F.array_join(F.array_sort(F.collect_list("text")), "").alias("body"))
        part = g.select("folder_path", F.lit(name).alias("file"), F.concat(F.lit(head), "body", F.lit(tail)).alias("content"))
        out = part if out is None else out.unionByName(part)
    return out
