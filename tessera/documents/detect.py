"""What a body is: media type, charset, text or not."""

from __future__ import annotations

import codecs
import re

#: Marks that open a file, and the media type that they mean.
MAGIC = (
    (b"%PDF-", "application/pdf"), (b"PK\x03\x04", "application/zip"), (b"\x1f\x8b", "application/gzip"), (b"BZh", "application/x-bzip2"), (b"\xfd7zXZ\x00", "application/x-xz"),
    (b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF8", "image/gif"), (b"SQLite format 3\x00", "application/vnd.sqlite3"), (b"PAR1", "application/vnd.apache.parquet"),
    (b"{\\rtf", "application/rtf"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "application/x-ole-storage"), (b"7z\xbc\xaf\x27\x1c", "application/x-7z-compressed"), (b"ID3", "audio/mpeg"), (b"OggS", "audio/ogg"),
)
#: Other names of media types, and types by extension.
ALIASES = {"text/x-markdown": "text/markdown", "application/x-zip-compressed": "application/zip", "application/x-gzip": "application/gzip", "text/xml": "application/xml", "application/x-json": "application/json", "text/json": "application/json", "image/jpg": "image/jpeg", "application/x-pdf": "application/pdf", "text/comma-separated-values": "text/csv", "application/csv": "text/csv"}
BY_EXTENSION = {"md": "text/markdown", "html": "text/html", "htm": "text/html", "csv": "text/csv", "tsv": "text/tab-separated-values", "json": "application/json", "jsonl": "application/x-ndjson", "xml": "application/xml", "yaml": "application/yaml", "yml": "application/yaml", "toml": "application/toml", "eml": "message/rfc822", "mbox": "application/mbox", "ipynb": "application/x-ipynb+json", "txt": "text/plain", "log": "text/plain"}
HEAD, TAIL = 1 << 20, 64 << 10


def sample(body: bytes) -> bytes:
    """The first MiB and the last 64 KiB."""
    return body if len(body) <= HEAD + TAIL else body[:HEAD] + body[-TAIL:]


def normal_mime(mime: str) -> str | None:
    """Lower case, no parameters, one name for each type; null for what is no media type."""
    plain = mime.split(";")[0].strip().lower()
    return ALIASES.get(plain, plain) if re.fullmatch(r"[\w.+-]+/[\w.+-]+", plain) else None


def family(mime: str) -> str:
    """The family that converters are grouped by."""
    groups = {"web": ("text/html", "application/xhtml+xml"), "data": ("text/csv", "text/tab-separated-values", "application/json", "application/x-ndjson", "application/xml", "application/yaml", "application/toml", "application/vnd.sqlite3", "application/vnd.apache.parquet"), "mail": ("message/rfc822", "application/mbox"), "archive": ("application/zip", "application/gzip", "application/x-tar", "application/x-7z-compressed", "application/x-bzip2", "application/x-xz"), "pdf": ("application/pdf",)}
    found = next((k for k, v in groups.items() if mime in v), None)
    return found or ("office" if re.search("officedocument|opendocument|msword|ms-excel|rtf", mime) else "media" if mime.startswith(("audio/", "video/")) else "image" if mime.startswith("image/") else "text" if mime.startswith("text/") else "other")


def looks_text(body: bytes) -> bool:
    """No NUL, and valid UTF-8 (a character cut at the end doesn't count) or 97 % printable as Latin-1."""
    if b"\0" in body:
        return False
    try:
        codecs.getincrementaldecoder("utf-8")().decode(body)
        return True
    except UnicodeDecodeError:
        good = sum(b in (9, 10, 13) or 32 <= b < 127 or b >= 160 for b in body)
        return good >= 0.97 * len(body)


def mail_evidence(text: str) -> int:
    """How many header fields of a message a text opens with, each name once; 0 if its first line is none."""
    names = []
    for line in text.replace("\r\n", "\n").split("\n")[:60]:
        if not line:
            break
        if m := re.match(r"([A-Za-z][A-Za-z-]*):\s", line):
            names.append(m[1].lower())
        elif not line.startswith((" ", "\t")) or not names:
            break
    known = {"from", "to", "cc", "date", "subject", "message-id", "received", "return-path", "mime-version", "content-type", "reply-to", "in-reply-to", "references", "delivered-to"}
    return len(known & set(names))


def detect(name: str, body: bytes) -> list:
    """[media type, confidence]: by magic, then what the text says, then the extension, then text or not."""
    for mark, mime in MAGIC:
        if body.startswith(mark):
            if mime == "application/zip" and (m := re.search(rb"mimetypeapplication/([\w.+-]+)|(word/|xl/|ppt/)", body[:4096])):
                office = {b"word/": "wordprocessingml.document", b"xl/": "spreadsheetml.sheet", b"ppt/": "presentationml.presentation"}
                return [f"application/{m[1].decode()}", 0.95] if m[1] else [f"application/vnd.openxmlformats-officedocument.{office[m[2]]}", 0.95]
            return [mime, 0.95]
    if body[257:262] == b"ustar":
        return ["application/x-tar", 0.95]
    if not looks_text(sample(body)):
        return ["application/octet-stream", 0.2]
    head = body[:4096].decode("utf-8", "replace").lstrip("﻿ \t\r\n")
    low = head.lower()
    if low.startswith(("<!doctype html", "<html")) or re.match(r"<(head|body)\b", low):
        return ["text/html", 0.9]
    if low.startswith("<?xml"):
        return ["application/xhtml+xml" if "<html" in low else "application/xml", 0.9]
    extension = BY_EXTENSION.get(name.lower().rpartition(".")[2]) if "." in name else None
    if mail_evidence(head) >= 3:
        return ["message/rfc822", 0.85]
    if head.startswith("From ") and mail_evidence(head.partition("\n")[2]) >= 2:
        return ["application/mbox", 0.85]
    return [extension, 0.7] if extension else ["text/plain", 0.5]


def decode(body: bytes) -> list:
    """[text, charset, confidence]: by mark, as UTF-8, as Windows-1252 where that gives no control characters, else with replacements."""
    for mark, charset in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\0\0", "utf-32"), (b"\0\0\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if body.startswith(mark):
            return [body.decode(charset, "replace"), charset, 1.0]
    try:
        return [body.decode("utf-8"), "utf-8", 1.0]
    except UnicodeDecodeError:
        pass
    try:
        text = body.decode("cp1252")
        if not re.search(r"[\x00-\x08\x0e-\x1f]", text):
            return [text, "cp1252", 0.6]
    except UnicodeDecodeError:
        pass
    return [body.decode("utf-8", "replace"), "utf-8", 0.2]


def connection_string(text: str) -> bool:
    """Whether an input is a database's address and no document."""
    return re.match(r"(?i)\s*((postgres(ql)?|mysql|mariadb|mongodb(\+srv)?|redis|mssql|oracle|sqlserver|snowflake)://|jdbc:|server=.*;.*(database|uid|user id)=)", text) is not None


def redact_connection(text: str) -> str:
    text = re.sub(r"(://)[^/\s@]*@", r"\1***@", text)
    return re.sub(r"(?i)\b(password|pwd|user id|uid|user)\s*=\s*[^;&\s]*", r"\1=***", text)


def capped(text: str, most: int) -> str:
    """A text of at most `most` characters, cut at the end of a line."""
    if len(text) <= most:
        return text
    at = text.rfind("\n", 0, most)
    return text[: at + 1 if at >= 0 else most]
