"""Mails as files: headers and plain text of raw messages."""

from __future__ import annotations

import email
from collections.abc import Iterator
from email.message import Message

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

FIELDS = {"message_id": "Message-ID", "date": "Date", "sender": "From", "receiver": "To", "subject": "Subject", "cc": "Cc", "bcc": "Bcc", "content_type": "Content-Type"}


def plain_text(message: Message) -> str:
    """The text/plain parts that are no attachments, joined."""
    if not message.is_multipart():
        return decoded(message)
    return "".join(decoded(p) for p in message.walk() if p.get_content_type() == "text/plain" and "attachment" not in str(p.get("Content-Disposition", "")))


def decoded(part: Message) -> str:
    body = part.get_payload(decode=True)
    return body.decode(part.get_content_charset() or "utf-8", "replace") if body is not None else ""


@pandas_udf(T.StructType([T.StructField(f, T.StringType()) for f in (*FIELDS, "body")]))
def _parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for raws in batches:
        rows = []
        for raw in raws:
            message = email.message_from_string(raw or "")
            rows.append([None if message[h] is None else str(message[h]) for h in FIELDS.values()] + [plain_text(message)])
        yield pd.DataFrame(rows, columns=[*FIELDS, "body"], dtype=object)


def parse_mail(raw: Column) -> Column:
    """struct of FIELDS and body; a header that is missing is null, and so is every field of a null or empty mail but its empty body."""
    return _parse(raw)
