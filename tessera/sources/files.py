"""Sources that Spark has no reader for: archives, mailboxes and notebooks, read with binaryFile and parsed under caps. A failure is a row, not an exception."""

from __future__ import annotations

import io
import json
import mailbox
import tarfile
import tempfile
import zipfile
from email import policy
from email.parser import BytesParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Caps of an archive: bytes of an entry, of all entries, number of entries, ratio of inflated to stored bytes above a MiB.
ENTRY_BYTES, ALL_BYTES, ENTRIES, RATIO = 100 << 20, 500 << 20, 10_000, 100


def safe_member(name: str) -> str | None:
    """The path of an archive's member, or None where it is absolute or leaves the archive."""
    parts = [p for p in name.replace("\\", "/").split("/") if p not in ("", ".")]
    if name.startswith(("/", "\\")) or ".." in parts or (parts and ":" in parts[0]):
        return None
    return "/".join(parts) or None


def _members(raw: bytes):
    """(name, stored bytes, inflated bytes, reader) of each file in a zip or tar archive."""
    if zipfile.is_zipfile(io.BytesIO(raw)):
        z = zipfile.ZipFile(io.BytesIO(raw))
        yield from ((i.filename, i.compress_size, i.file_size, lambda i=i: z.read(i)) for i in z.infolist() if not i.is_dir())
    else:
        t = tarfile.open(fileobj=io.BytesIO(raw))
        yield from ((i.name, i.size, i.size, lambda i=i: t.extractfile(i).read()) for i in t if i.isfile())


def _archive(raw: bytes):
    total = 0
    try:
        for n, (name, stored, size, load) in enumerate(_members(raw)):
            path = safe_member(name)
            total += size
            if n >= ENTRIES or total > ALL_BYTES or (size > 1 << 20 and size > RATIO * max(stored, 1)):
                yield name, None, "cap: the archive ends here"
                return
            if path is None:
                yield name, None, "unsafe path"
            elif size > ENTRY_BYTES:
                yield path, None, "entry too large"
            else:
                yield path, load(), None
    except Exception as e:  # noqa: BLE001  any damage is a row
        yield None, None, f"unreadable: {type(e).__name__}"


def _mbox(raw: bytes):
    with tempfile.NamedTemporaryFile() as f:
        f.write(raw)
        f.flush()
        for m in mailbox.mbox(f.name, create=False):
            x = BytesParser(policy=policy.default).parsebytes(m.as_bytes())
            body = x.get_body(("plain", "html"))
            yield x["Message-ID"], json.dumps({k: str(v) for k, v in x.items()}), body.get_content() if body else ""


def _notebook(raw: bytes):
    for i, cell in enumerate(json.loads(raw).get("cells", [])):
        source = cell.get("source", "")
        yield i, cell.get("cell_type"), "".join(source) if isinstance(source, list) else source


def _read(spark: SparkSession, path: str, parse, names: str, kinds: list[pa.DataType]) -> DataFrame:
    fields = [x.split()[0] for x in names.split(", ")]

    def run(batches):
        for batch in batches:
            for at, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(at, *x) for x in parse(raw)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.string(), *kinds], strict=True)], names=["file", *fields])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"file string, {names}")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, member, content, problem) of the members of zip and tar archives."""
    return _read(spark, path, _archive, "member string, content binary, problem string", [pa.string(), pa.binary(), pa.string()])


def read_mailboxes(spark: SparkSession, path: str) -> DataFrame:
    """(file, message_id, headers as JSON, body) of the messages of mbox files."""
    return _read(spark, path, _mbox, "message_id string, headers string, body string", [pa.string()] * 3)


def read_notebooks(spark: SparkSession, path: str) -> DataFrame:
    """(file, cell, kind, source) of the cells of notebooks."""
    return _read(spark, path, _notebook, "cell bigint, kind string, source string", [pa.int64(), pa.string(), pa.string()])
