"""Mail and archives from binary files: each file is one row, parsed in its own task.

`raw` tables hold (path, content), as `spark.read.format("binaryFile")` gives them.
"""

from __future__ import annotations

import email
import email.policy
import email.utils
import io
import zipfile
from collections.abc import Iterator
from datetime import UTC

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import html
from tracelake.functions.text import cut_bytes

MAIL = (
    "path string, message_id string, from_email string, from_name string, to array<string>, subject string, sent_at timestamp, list_id string, list_unsubscribe string, "
    "precedence string, auto_submitted string, body_text string, body_html string, attachments array<struct<filename:string,content_type:string,size:bigint>>"
)


def files(spark: SparkSession, path: str, pattern: str = "*.eml") -> DataFrame:
    """(path, content) of the files that match, in any store that Spark reads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def _parsed(path: str, content: bytes) -> dict:
    m = email.message_from_bytes(content or b"", policy=email.policy.default)
    name, address = email.utils.parseaddr(str(m.get("From", "")))
    plain = m.get_body(("plain",))
    marked = m.get_body(("html",))
    try:
        sent = email.utils.parsedate_to_datetime(str(m.get("Date", ""))).astimezone(UTC)
    except (TypeError, ValueError):
        sent = None
    held = []
    for part in m.iter_attachments():
        data = part.get_payload(decode=True) or b""
        held.append({"filename": part.get_filename(), "content_type": part.get_content_type(), "size": len(data)})
    get = lambda k: str(m[k]).strip() if m[k] is not None else None
    return {
        "path": path, "message_id": get("Message-ID"), "from_email": address.lower() or None, "from_name": name or None,
        "to": [a for _, a in email.utils.getaddresses([str(x) for x in m.get_all("To", [])])], "subject": get("Subject"), "sent_at": sent,
        "list_id": get("List-ID"), "list_unsubscribe": get("List-Unsubscribe"), "precedence": get("Precedence"), "auto_submitted": get("Auto-Submitted"),
        "body_text": plain.get_content() if plain is not None else None, "body_html": marked.get_content() if marked is not None else None, "attachments": held,
    }


def messages(raw: DataFrame, server_time: Column | None = None, most_bytes: int = 1 << 20) -> DataFrame:
    """Parsed mail: headers, one body (the plain one, else the other without its
    markup), cut to so many bytes, and what is attached. A date before 2000 or
    more than a year ahead of `server_time` gives way to it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                one = pd.DataFrame([_parsed(path, content)])
                one["sent_at"] = pd.to_datetime(one["sent_at"], utc=True)
                yield one

    rows = raw.select("path", "content").mapInPandas(run, MAIL)
    body = cut_bytes(F.coalesce("body_text", html.stripped(F.col("body_html"))), most_bytes)
    now = server_time if server_time is not None else F.current_timestamp()
    sane = F.col("sent_at").between(F.lit("2000-01-01").cast("timestamp"), now + F.expr("INTERVAL 1 YEAR"))
    return rows.withColumns({"body": body, "occurred_at": F.when(sane, F.col("sent_at")).otherwise(now)}).drop("body_text", "body_html")


def unpacked(raw: DataFrame, most_files: int = 1000, most_bytes: int = 64 << 20, most_ratio: int = 200) -> DataFrame:
    """(path, name, size, content, refused) of the members of ZIP files. Members
    beyond the number, the total size or the ratio of sizes that are allowed are
    named with the reason and without content; so are broken files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content or b""))
                except zipfile.BadZipFile:
                    yield pd.DataFrame([{"path": path, "name": None, "size": None, "content": None, "refused": "broken"}])
                    continue
                total = 0
                for k, member in enumerate(x for x in archive.infolist() if not x.is_dir()):
                    row = {"path": path, "name": member.filename, "size": member.file_size, "content": None, "refused": None}
                    if k >= most_files:
                        row["refused"] = "too many"
                    elif total + member.file_size > most_bytes or member.file_size > most_ratio * max(1, member.compress_size):
                        row["refused"] = "too large"
                    else:
                        total += member.file_size
                        row["content"] = archive.read(member)
                    yield pd.DataFrame([row])

    return raw.select("path", "content").mapInPandas(run, "path string, name string, size long, content binary, refused string")


def object_keys(media: DataFrame, owner: str = "user_id", content: str = "content", extension: str = "extension") -> DataFrame:
    """`media` with the key that its content gives it: owner, digest, extension. Equal contents share a key."""
    return media.withColumn("object_key", F.concat_ws("/", F.col(owner).cast("string"), F.concat_ws(".", F.sha2(F.col(content), 256), F.col(extension))))
