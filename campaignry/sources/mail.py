"""Mailbox exports as records: mbox files read by ranges, MIME parsed with the standard library, forwards unwrapped, errors as rows."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.safe import recipient_terms, safe_brand, safe_text
from ..functions.text import content_hash, normal_domain
from ..operators.store import branded, identifier, mailbox_name

MESSAGE = (
    "path string, place long, source_uid string, message_id string, list_id string, campaign string, subject string, preheader string, sender string, sender_domain string, received timestamp, "
    "received_source string, trusted boolean, visible_text string, recipients array<string>, bulk boolean, header_date timestamp, notes array<string>, error string"
)
# Where a receipt time is looked for, in this order, and its names; those of UNTRUSTED are anybody's word.
DELIVERY_HEADERS = (("X-Delivery-Time", "x_delivery_time"), ("Delivery-Date", "delivery_date"))
RECEIVED_HEADERS, RECEIVED = ("Received", "X-Received"), "received_header"
SEPARATOR, MESSAGE_DATE, FILE_TIME = "mbox_separator", "message_date_untrusted", "file_mtime_untrusted"
SKIPPED_TAGS = ("head", "script", "style", "svg", "template", "noscript")
CAMPAIGN_HEADERS = ("X-Campaign-Id", "X-Klaviyo-Campaign-Id", "X-MC-Campaign", "X-Entity-Ref-ID", "X-SES-Outgoing")
RECIPIENT_HEADERS = ("To", "Cc", "Delivered-To", "X-Original-To", "Envelope-To")
UNWRAPPED, AMBIGUOUS, BAD_DATE, SKEWED = "forward_unwrapped", "embedded_message_not_unwrapped", "invalid_header_date", "header_date_skew_over_7_days"
BULK = ("bulk", "list")
ENCLOSED = "message/rfc822"
SKEW_DAYS, SUBJECT_MOST, PREHEADER_MOST, FIRST_LINE_MOST, TEXT_MOST = 7, 500, 300, 180, 100_000
BLOCK_TAGS = ("address", "article", "aside", "blockquote", "br", "div", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "li", "main", "nav", "p", "section", "table", "td", "th", "tr")


def html_text(html: str | None) -> str:
    """What a reader sees: hidden elements go, block elements begin lines, entities are decoded."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.hidden, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in SKIPPED_TAGS
            if tag in BLOCK_TAGS and not self.hidden:
                self.out.append("\n")

        def handle_endtag(self, tag):
            self.hidden -= tag in SKIPPED_TAGS and self.hidden > 0
            if tag in BLOCK_TAGS and not self.hidden:
                self.out.append("\n")

        def handle_data(self, data):
            if not self.hidden:
                self.out.append(data)

    reader = Reader()
    reader.feed(html or "")
    reader.close()
    lines = (" ".join(x.split()) for x in "".join(reader.out).split("\n"))
    return "\n".join(x for x in lines if x)


def timestamp(text: object):
    """A time in UTC from an epoch (of 1e10 and more in milliseconds) or a mail date, else None."""
    import re
    from datetime import UTC
    from email.utils import parsedate_to_datetime

    text = str(text or "").strip()
    try:
        if re.fullmatch(r"\d{9,16}(?:\.\d+)?", text):
            n = float(text)
            return datetime.fromtimestamp(n / 1000 if n >= 10**10 else n, UTC)
        found = parsedate_to_datetime(text) if text else None
    except (TypeError, ValueError, OverflowError, OSError):
        return None
    return found and (found if found.tzinfo else found.replace(tzinfo=UTC)).astimezone(UTC)


def receipt_time(message, separator: str = "", file_time=None) -> tuple[object, str, bool]:
    """UTC time, what gave it, and whether it can be trusted: delivery headers, the last part of received ones, the line that separates messages, the sender's date, the file's time."""
    tried = [(name, [message.get(given)], True) for given, name in DELIVERY_HEADERS]
    tried.append((RECEIVED, [str(v).rpartition(";")[2] for h in RECEIVED_HEADERS for v in message.get_all(h, [])], True))
    words = separator.split()
    tried.append((SEPARATOR, [" ".join(words[i:]) for i in range(1, len(words))], True))
    tried.append((MESSAGE_DATE, [message.get("Date")], False))
    for name, texts, trusted in tried:
        found = next((t for t in map(timestamp, texts) if t), None)
        if found:
            return found.replace(tzinfo=None), name, trusted
    return file_time, FILE_TIME if file_time is not None else "", False


def leaves(part) -> Iterator:
    """The parts that a reader sees as the message's own: nothing attached, named or enclosed, whatever its type."""
    if part.get_content_disposition() == "attachment" or part.get_filename() or part.get_content_type() == ENCLOSED:
        return
    if part.is_multipart():
        for child in part.iter_parts():
            yield from leaves(child)
    else:
        yield part


def part_text(part) -> str:
    """The text of a leaf in its own charset; in UTF-8 with replacements where that charset is unknown or broken."""
    try:
        text = part.get_content()
    except (LookupError, UnicodeError, ValueError, KeyError, AttributeError):
        text = part.get_payload(decode=True) or b""
    return text if isinstance(text, str) else text.decode("utf-8", "replace")


def header(message, name: str) -> str:
    return str(message.get(name) or "")


def is_bulk(message) -> bool:
    return bool(message.get("List-ID") or message.get("List-Unsubscribe") or header(message, "Precedence").strip().lower() in BULK)


def unwrapped(message) -> tuple[object, str]:
    """The message that a forward encloses, or the message itself, and a note.

    Only one enclosed message is taken, and only from a pure container, or from a mail whose subject says that it is a
    forward and that no list sent. Any other message with enclosed ones is ambiguous.
    """
    import re

    enclosed = [p for p in message.walk() if p.get_content_type() == ENCLOSED]
    if not enclosed:
        return message, ""
    forwarded = re.match(r"\s*(?:fwd?|forwarded)\s*:", header(message, "Subject"), re.I) and not is_bulk(message)
    if len(enclosed) == 1 and (enclosed[0] is message or forwarded):
        inner = enclosed[0].get_payload()
        if isinstance(inner, list) and len(inner) == 1:
            return inner[0], UNWRAPPED
    return message, AMBIGUOUS


def header_date(message) -> tuple[object, bool]:
    """The sender's date in UTC, and whether there is one that can't be read."""
    from datetime import UTC
    from email.utils import parsedate_to_datetime

    text = header(message, "Date")
    try:
        found = parsedate_to_datetime(text) if text else None
        return found and (found if found.tzinfo else found.replace(tzinfo=UTC)).astimezone(UTC).replace(tzinfo=None), False
    except (TypeError, ValueError, OverflowError):
        return None, True


def parsed(raw: bytes, separator: str = "", file_time=None) -> dict:
    """Columns of one message; a message that can't be parsed has only its error. What a forward encloses is the message; who received either is known."""
    import email
    import hashlib
    from email.policy import default
    from email.utils import parseaddr

    row = {"source_uid": hashlib.sha256(raw).hexdigest()[:24]}
    try:
        outer = email.message_from_bytes(raw, policy=default)
        message, note = unwrapped(outer)
        texts = {"text/plain": [], "text/html": []}
        for part in leaves(message):
            if part.get_content_type() in texts:
                texts[part.get_content_type()].append(part_text(part))
        plain, html = texts.values()
        sender = parseaddr(header(message, "From"))
        received, source, trusted = receipt_time(outer, separator, file_time)
        date, bad = header_date(message)
        row |= {"message_id": message.get("Message-ID"), "list_id": message.get("List-ID"), "campaign": next((header(message, h) for h in CAMPAIGN_HEADERS if message.get(h)), None)}
        row |= {"subject": header(message, "Subject"), "preheader": header(message, "X-Preheader"), "sender": sender[0], "sender_domain": sender[1].rpartition("@")[2].lower() if "@" in sender[1] else ""}
        row |= {"received": received, "received_source": source, "trusted": trusted, "visible_text": "\n".join(plain).strip() or "\n".join(map(html_text, html)).strip()}
        row |= {"recipients": [str(v) for m in dict.fromkeys((outer, message)) for h in RECIPIENT_HEADERS for v in m.get_all(h, [])], "bulk": is_bulk(message), "header_date": date, "notes": [n for n in (note, BAD_DATE if bad else "") if n]}
    except Exception as e:  # whatever a broken message raises becomes its row's error
        row["error"] = type(e).__name__
    return row


def raw_mbox(spark: SparkSession, path: str, partition_bytes: int = 64 << 20) -> DataFrame:
    """Messages as they lie in the mbox files under path: path, block, at, separator, raw, changed. See mbox.py."""
    from .mbox import MboxSource

    spark.dataSource.register(MboxSource)
    return spark.read.format("mbox").option("partitionBytes", str(partition_bytes)).load(path)


def line_mbox(spark: SparkSession, path: str) -> DataFrame:
    """The same rows from Spark's own text reader, for stores that only Spark reads: lines that begin at separators."""
    lines = spark.read.option("lineSep", "\nFrom ").text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.unix_micros("_metadata.file_modification_time").alias("changed"))

    def run(batches):
        import pyarrow as pa

        of, at = None, 0
        for batch in batches:
            rows = []
            for data, file, block, changed in zip(*(batch.column(i).to_pylist() for i in range(4))):
                of, at = (file, block), at + 1 if (file, block) == of else 0
                line, _, body = data.removeprefix(b"From ").partition(b"\n")
                rows.append((file, block, at, line.decode("ascii", "replace"), body, changed))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64()))], names=["path", "block", "at", "separator", "raw", "changed"])

    return lines.mapInArrow(run, "path string, block long, at long, separator string, raw binary, changed long")


def parsed_messages(raw: DataFrame) -> DataFrame:
    """Rows of raw_mbox or line_mbox as columns of MESSAGE. place is a message's number in its file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in (MESSAGE + ", block long").split(", ")]
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                time = datetime(1970, 1, 1) + timedelta(microseconds=r.changed)
                rows.append(dict.fromkeys(names) | {"path": r.path, "place": r.at, "block": r.block} | parsed(r.raw, r.separator, time))
            yield pd.DataFrame(rows, columns=names).astype({"received": "datetime64[us]", "header_date": "datetime64[us]", "trusted": "boolean", "bulk": "boolean"})

    sizes = raw.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"))  # a row for each part of a file
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("path", "block", F.coalesce(before, F.lit(0)).alias("before"))
    placed = raw.mapInPandas(run, MESSAGE + ", block long").join(starts, ["path", "block"]).withColumn("place", F.col("place") + F.col("before"))
    return placed.withColumn("source_uid", F.concat_ws(":", F.col("place").cast("string"), "source_uid")).select(*[c.split()[0] for c in MESSAGE.split(", ")])


def read_mbox(spark: SparkSession, path: str, since: str | None = None, domains: tuple[str, ...] = (), partition_bytes: int | None = None) -> DataFrame:
    """Messages of the mbox files under path. since drops older trusted rows only; domains keeps senders of those domains and their subdomains.

    With partition_bytes files are planned as byte ranges of that size (raw_mbox), else they are read as Spark's text
    reader splits them (line_mbox). Texts stay bytes until their own charset is known. source_uid is a message's place in its file and a hash of it.
    """
    found = parsed_messages(raw_mbox(spark, path, partition_bytes) if partition_bytes else line_mbox(spark, path))
    if since:
        found = found.where(~F.coalesce("trusted", F.lit(False)) | (F.col("received") >= F.lit(since).cast("timestamp")))
    if domains:
        listed = F.array(*[F.lit(d.lower()) for d in domains])
        found = found.where(F.exists(listed, lambda d: (F.col("sender_domain") == d) | F.col("sender_domain").endswith(F.concat(F.lit("."), d))))
    return found


def record_id(source_type: Column, mailbox: Column, uidvalidity: Column, source_uid: Column, message_id: Column, content: Column) -> Column:
    """A record's id: of its source's numbering if there is one, else of its uid alone, else of its message id, else of its content."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    joined = lambda *c: F.concat(*[x for i, y in enumerate(c) for x in ((F.lit("\0"), y) if i else (y,))])
    identity = F.when(given(source_uid) & given(uidvalidity), joined(source_type, mailbox, uidvalidity, source_uid)).when(given(source_uid), joined(source_type, mailbox, source_uid)).when(given(message_id), message_id).otherwise(content)
    return F.sha2(F.concat(F.lit("record\0"), identity), 256)


def normalized(messages: DataFrame, source_type: str = "mbox", mailbox: str = "mbox-import", aliases: DataFrame | None = None) -> DataFrame:
    """Parsed messages as records without identifiers, with all that deduplication and classification read.

    Texts are cleaned with the recipients' own terms. Without a preheader the first line of the text stands for it. A
    null field counts as empty; a message without a receipt time has no date.
    """
    rows = messages.where("error IS NULL").withColumn("terms", recipient_terms(F.col("recipients")))
    key = ["path", "place"]
    fields = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("text"), F.lit(most).alias("most")) for n, most in (("subject", SUBJECT_MOST), ("preheader", PREHEADER_MOST), ("visible_text", TEXT_MOST))])
    texts = rows.select(*key, "terms", F.inline(fields)).select(*key, "field", safe_text(F.col("text"), F.col("terms"), F.col("most")).alias("text"))  # one expression for all fields
    safe = texts.groupBy(*key).agg(*[F.max(F.when(F.col("field") == n, F.col("text"))).alias(n) for n in ("subject", "preheader", "visible_text")])
    first = F.regexp_extract("visible_text", r"(?m)^\s*(\S[^\n]*)$", 1)
    rows = rows.drop("subject", "preheader", "visible_text").join(safe, key)
    rows = rows.withColumn("preheader", F.when(F.col("preheader") != "", F.col("preheader")).otherwise(safe_text(first, F.col("terms"), FIRST_LINE_MOST)))
    rows = rows.withColumns({"message_id": identifier("message", F.col("message_id")), "list_id": identifier("list", F.col("list_id")), "campaign_id": identifier("campaign", F.col("campaign")), "sender_domain": normal_domain(F.col("sender_domain")), "brand": safe_brand(F.col("sender"), F.col("sender_domain"))})
    if aliases is not None:
        rows = branded(rows, aliases).withColumn("brand", F.col("canonical_brand")).drop("canonical_brand")
    skew = F.abs(F.unix_micros("received") - F.unix_micros("header_date")) / 86_400_000_000
    box = mailbox_name(F.lit(mailbox))
    content = content_hash("subject", "preheader", "visible_text")
    rows = rows.withColumns({"source_type": F.lit(source_type), "mailbox": box, "content_hash": content, "date_skew_days": F.round(skew, 3)})
    rows = rows.withColumns({
        "id": record_id(F.col("source_type"), F.col("mailbox"), F.lit(None).cast("string"), F.col("source_uid"), F.col("message_id"), F.col("content_hash")),
        "parse_errors": F.concat("notes", F.when(skew > SKEW_DAYS, F.array(F.lit(SKEWED))).otherwise(F.array().cast("array<string>"))),
        "received_at": F.col("received"), "source_key": F.concat_ws("\0", "source_type", "mailbox", "source_uid"), "source_completeness": F.lit("complete"),
    })
    curated = {c: F.lit(None).cast("string") for c in ("curated_offer", "curated_occasion", "curated_intent")}
    rows = rows.withColumns({"variant_ids": F.array("id"), "received": F.to_date("received_at"), "ambiguous": F.array_contains("notes", AMBIGUOUS), **curated})
    return rows.drop("terms", "recipients", "campaign", "notes", "error", "path", "place")


def records_and_failures(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The messages that were parsed, and a ledger of those that were not: source_type, source_uid, error_code, brand."""
    bad = messages.where("error IS NOT NULL").select(F.lit("mbox").alias("source_type"), "source_uid", F.col("error").alias("error_code"), F.lit("Unassigned").alias("brand"))
    return messages.where("error IS NULL").drop("error"), bad
