"""Contacts, appointments, other non-mail items and special items, and their text forms
(P22-P25, F07, F08, K12-K14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions import identity as ids
from postlake.functions import text as tx
from postlake.operators.routing import ascii_lower, item_kind

#: Vendor fields in the text forms begin with this.
VENDOR = "X-MAIL"


def _class() -> Column:
    return ascii_lower(tx.trim(F.col("message_class")))


def is_contact() -> Column:
    """wider than the route of that name, distribution lists are among them."""
    return F.coalesce(_class().startswith("ipm.contact") | _class().contains("distlist") | _class().contains("distribution"), F.lit(False))


def is_appointment() -> Column:
    return F.coalesce(_class().startswith("ipm.appointment"), F.lit(False))


def is_report() -> Column:
    """F08."""
    c = ascii_lower(F.coalesce("message_class", F.lit("")))
    return c.startswith("report.") | c.contains("ndr")


def is_schedule() -> Column:
    c = ascii_lower(F.coalesce("message_class", F.lit("")))
    return c.startswith("ipm.schedule.") | c.contains("calendar") | c.contains("meeting")


def is_encrypted() -> Column:
    return ascii_lower(F.coalesce("message_class", F.lit(""))).contains("encrypted")


def _record_ref() -> Column:
    return F.concat(F.lit("message_record:"), "message_key")


def _class_ref() -> Column:
    return F.concat(F.lit("message_class:"), F.coalesce("message_class", F.lit("<missing>")))


def contacts(messages: DataFrame) -> DataFrame:
    """P22."""
    some = F.col("sender_name").isNotNull() | F.col("sender_email").isNotNull()
    return messages.where(is_contact()).select(
        ids.stable_id("contact", F.col("message_key")).alias("contact_key"), "message_key", "folder_path", F.col("sender_name").alias("full_name"), F.col("sender_email").alias("email"),
        F.col("sender_address_type").alias("address_type"), F.when(some, "contact_partial_source_fields").otherwise("contact_fields_unavailable").alias("status"), some.alias("authoritative"),
        F.array(_record_ref()).alias("raw_evidence_refs"),
    )


def calendars(messages: DataFrame) -> DataFrame:
    """Times and recurrence aren't decoded, and their statuses say so."""
    some = F.col("subject").isNotNull() | F.col("sender_name").isNotNull() | F.col("sender_email").isNotNull()
    undecoded = lambda what: F.lit(f"{what}_unavailable_source_properties_not_decoded")
    return messages.where(is_appointment()).select(
        ids.stable_id("calendar", F.col("message_key")).alias("calendar_key"), "message_key", "folder_path", "message_class", ids.stable_id("calendar-uid", F.col("message_key")).alias("uid"),
        F.col("subject").alias("summary"), F.col("sender_name").alias("organizer_name"), F.col("sender_email").alias("organizer_email"), undecoded("recurrence").alias("recurrence_status"),
        undecoded("exceptions").alias("exception_status"), undecoded("alarm").alias("alarm_status"), F.when(some, "calendar_partial_source_fields").otherwise("calendar_fields_unavailable").alias("status"),
        F.lit(False).alias("authoritative"), F.array(_record_ref(), _class_ref()).alias("raw_evidence_refs"),
    )


def non_mail(messages: DataFrame, bodies: DataFrame) -> DataFrame:
    """Journals, tasks, notes and what has an unknown class or none; bodies(message_key, body_key)."""
    kind = item_kind(F.col("message_class"))
    refs = bodies.groupBy("message_key").agg(F.collect_list(F.concat(F.lit("body_record:"), "body_key")).alias("body_refs"))
    d = messages.withColumn("kind", F.coalesce(kind, F.lit("unknown"))).where(F.col("kind").isin("journal", "task", "sticky_note", "other", "unknown")).join(refs, "message_key", "left")
    some = F.coalesce("subject", "sender_name", "created_at", "modified_at").isNotNull()
    pick = lambda journal, kept, other, unknown: F.when(F.col("kind") == "journal", journal).when(F.col("kind").isin("task", "sticky_note"), kept).when(F.col("kind") == "other", other).otherwise(unknown)
    journal = F.when(some, "journal_partial_source_fields").otherwise("journal_fields_unavailable")
    route = pick(F.lit("routed_journal"), F.lit("skipped_unsupported_by_readpst"), F.lit("skipped_unknown_item_class"), F.lit("unavailable_missing_item_class"))
    status = pick(journal, F.lit("unsupported_by_readpst_preserved"), F.lit("unknown_class_preserved"), F.lit("missing_class_preserved"))
    return d.select(
        ids.stable_id("non-mail", F.col("message_key")).alias("non_mail_key"), "message_key", "folder_path", "message_class", F.col("kind").alias("item_kind"), F.col("subject").alias("summary"),
        "sender_name", "sender_email", "created_at", "modified_at", route.alias("route_status"), status.alias("status"), F.lit(False).alias("authoritative"),
        F.array_sort(F.concat(F.array(_record_ref(), _class_ref()), F.coalesce("body_refs", F.array().cast("array<string>")))).alias("raw_evidence_refs"),
    )


def special_items(messages: DataFrame, bodies: DataFrame) -> DataFrame:
    """P25. bodies(message_key, body_key, body_type, sha256, content, null if it couldn't be had).
    Reports and schedules show their bodies of that type, encrypted mail its opaque ones, or one
    unavailable row where there is none; every RTF body has a row of its own."""
    m = messages.select("message_key", "message_class", is_report().alias("r"), is_schedule().alias("s"), is_encrypted().alias("e"))
    rules = [
        ("report", "r", "message/delivery-status", ("report",), "report_payload_unavailable", "report_payload_observed_report_type_unavailable", True),
        ("schedule", "s", "text/calendar", ("calendar",), "schedule_payload_unavailable", "schedule_payload_observed_method_unavailable", True),
        ("encrypted", "e", "application/octet-stream", ("text", "html", "rtf"), "encrypted_body_unavailable", "encrypted_body_opaque", False),
    ]
    out = None
    b = bodies.select(F.col("message_key").alias("bm"), "body_key", "body_type", "sha256", "content")
    for kind, flag, media, types, absent, status, decoded in rules:
        d = m.where(flag).join(b.where(F.col("body_type").isin(*types)), F.col("message_key") == F.col("bm"), "left")
        has, body = F.col("content").isNotNull(), F.col("body_key").isNotNull()
        state = F.when(~body, absent).when(has, status).otherwise(F.lit(f"{status}; source_body_unavailable"))
        size = F.octet_length("content").cast("bigint")
        rows = d.select(
            ids.stable_id("special", F.col("message_key"), kind, F.coalesce("body_key", F.lit("unavailable"))).alias("special_key"), "message_key", F.lit(kind).alias("kind"), "message_class",
            F.lit(media).alias("media_type"), F.col("body_key").alias("source_body_key"), F.coalesce(size, F.lit(0)).alias("raw_size_bytes"), F.when(has, F.col("sha256")).alias("raw_sha256"),
            F.when(has & F.lit(decoded), size).alias("decoded_size_bytes"), state.alias("status"), (has & F.lit(decoded)).alias("authoritative"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def _line(name: str, value: Column) -> Column:
    """A field, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(name), value, F.lit("\r\n")), F.lit(""))


def vcards(records: DataFrame, vendor: str = VENDOR) -> DataFrame:
    """(contact_key, vcard)."""
    mail = F.concat(F.lit("EMAIL;TYPE="), tx.escape_text(F.coalesce("address_type", F.lit("unknown"))), F.lit(":"), tx.escape_text(F.col("email")), F.lit("\r\n"))
    card = F.concat(
        F.lit("BEGIN:VCARD\r\nVERSION:3.0\r\n"), _line("UID:", F.col("contact_key")), _line("FN:", tx.escape_text(F.col("full_name"))), F.coalesce(mail, F.lit("")),
        _line(f"{vendor}-STATUS:", tx.escape_text(F.col("status"))), _line(f"{vendor}-AUTHORITATIVE:", F.col("authoritative").cast("string")), F.lit("END:VCARD\r\n"),
    )
    return records.select("contact_key", card.alias("vcard"))


def contact_lines(records: DataFrame) -> DataFrame:
    return records.select("contact_key", F.concat(F.coalesce("full_name", F.lit("<unnamed>")), F.lit(" <"), F.coalesce("email", F.lit("<address-unavailable>")), F.lit(">\n")).alias("line"))


def events(records: DataFrame, vendor: str = VENDOR) -> DataFrame:
    """(calendar_key, vevent); a calendar is these between calendar_frame's two parts."""
    organizer = F.concat(F.lit("ORGANIZER;CN="), tx.escape_parameter(F.col("organizer_name")), F.lit(":mailto:"), tx.escape_text(F.col("organizer_email")), F.lit("\r\n"))
    event = F.concat(
        F.lit("BEGIN:VEVENT\r\n"), _line("UID:", tx.escape_text(F.col("uid"))), F.lit(f"DTSTAMP:19700101T000000Z\r\n{vendor}-DTSTAMP-SYNTHETIC:TRUE\r\n"),
        _line("SUMMARY:", tx.escape_text(F.col("summary"))), F.coalesce(organizer, F.lit("")), _line(f"{vendor}-MESSAGE-CLASS:", tx.escape_text(F.coalesce("message_class", F.lit("<missing>")))),
        _line(f"{vendor}-STATUS:", tx.escape_text(F.col("status"))), _line(f"{vendor}-RECURRENCE-STATUS:", tx.escape_text(F.col("recurrence_status"))), F.lit("END:VEVENT\r\n"),
    )
    return records.select("calendar_key", event.alias("vevent"))


def calendar_frame(product: str = "-//mail//calendar//EN") -> tuple[str, str]:
    return f"BEGIN:VCALENDAR\r\nVERSION:2.0\r\nPRODID:{product}\r\nCALSCALE:GREGORIAN\r\n", "END:VCALENDAR\r\n"


def journals(records: DataFrame, vendor: str = VENDOR) -> DataFrame:
    """(non_mail_key, vjournal) of the journals alone."""
    body = F.concat(
        F.lit("BEGIN:VJOURNAL\r\nVERSION:1.0\r\n"), _line("UID:", tx.escape_text(F.col("non_mail_key"))), F.lit(f"DTSTAMP:19700101T000000Z\r\n{vendor}-DTSTAMP-SYNTHETIC:TRUE\r\n"),
        _line("SUMMARY:", tx.escape_text(F.col("summary"))), _line(f"{vendor}-SOURCE-CREATED-AT:", tx.escape_text(F.col("created_at"))),
        _line(f"{vendor}-SOURCE-MODIFIED-AT:", tx.escape_text(F.col("modified_at"))), _line(f"{vendor}-STATUS:", tx.escape_text(F.col("status"))), F.lit("END:VJOURNAL\r\n"),
    )
    return records.where("item_kind = 'journal'").select("non_mail_key", body.alias("vjournal"))
