"""WARC: a monolithic gzip normaliser.

Archives that are one gzip stream can only be read from their start. `normalise` inflates such a stream once, rewrites every record as a gzip member of
its own and writes a sidecar index (JSON lines: offset, length, type, ids, digest), so that `read_records` can fetch any record by range.

Files are written under names that no other attempt uses; the table of archives, written by Spark's own commit, names those that count, so a lost
executor or a repeated task leaves at most unnamed files. Records stream: memory follows the largest record. Null html is an empty payload. Rows with the
same payload refer to the largest page_id among them; rows that repeat that id are each a response. Null ids come before all others.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Bytes of records after which a writer starts another archive; the level of compression; bytes read at once.
ROLL, LEVEL, BLOCK = 256 << 20, 1, 1 << 20
_ID = "urn:tessera:page:"
ARCHIVES = "archive string, index string, records bigint, bytes bigint"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, uri string, archive string, offset bigint, length bigint"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, uri: str, payload: bytes, sha1: str, n_bytes: int, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 response or revisit record. The HTTP head of a revisit keeps the length of the payload that it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_ID}{page_id}>", "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <{_ID}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]) if k}


class Inflated:
    """The bytes of a gzip file, of one member or many, taken in order."""

    def __init__(self, stream):
        self.stream, self.z, self.held, self.over = stream, zlib.decompressobj(31), bytearray(), False

    def _more(self) -> bool:
        if self.over:
            return False
        if self.z.eof:
            data, self.z = self.z.unused_data, zlib.decompressobj(31)
        elif self.z.unconsumed_tail:
            data = self.z.unconsumed_tail
        else:
            data = b""
        data = data or self.stream.read(BLOCK)
        if not data:
            self.over = True
            return False
        self.held += self.z.decompress(data, BLOCK)
        return True

    def until(self, mark: bytes) -> bytes:
        """Up to and with mark; b"" at the end of the file."""
        seen = 0
        while (i := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                if self.held.strip():
                    raise ValueError("the archive ends inside a record")
                return b""
        return self.take(i + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def records(stream) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(fields, block, whole record) of each record of a gzip file."""
    source = Inflated(stream)
    while head := source.until(b"\r\n\r\n"):
        if not head.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {head[:40]!r}")
        fields = _fields(head)
        block = source.take(int(fields["content-length"]))
        yield fields, block, head + block + source.take(4)


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _table(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in names.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """pages: (page_id, url, html as binary or null, payload_digest hex, payload_bytes, refers_to, revisit). Each task writes archives of one gzip stream each."""

    def write(batches):
        out = sink = z = None
        n = size = 0

        def close():
            sink.write(z.flush())
            sink.close()
            return out, None, n, size

        for batch in batches:
            done = []
            for page_id, url, html, sha1, n_bytes, refers_to, revisit in zip(*(batch.column(i) for i in range(7)), strict=True):
                if sink is None:
                    out, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    fs, path = _open(folder)
                    fs.create_dir(path, recursive=True)
                    sink, z = fs.open_output_stream(f"{path}/{out.rpartition('/')[2]}", compression=None), zlib.compressobj(LEVEL, wbits=31)
                text = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                whole = record(page_id.as_py(), " ".join((url.as_py() or "").split()), html.as_py() or b"", text, n_bytes.as_py(), refers_to.as_py(), revisit.as_py())
                sink.write(z.compress(whole))
                n, size = n + 1, size + len(whole)
                if size >= ROLL:
                    done.append(close())
                    sink = None
            if done:
                yield _table(done, ARCHIVES)
        if sink is not None:
            yield _table([close()], ARCHIVES)

    return common.materialize(pages.mapInArrow(write, ARCHIVES))


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites each archive with a member for each record, and an index beside it."""

    def rewrite(batches):
        fs, path = _open(folder)
        fs.create_dir(path, recursive=True)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                name, offset, n = uuid.uuid4().hex, 0, 0
                own, at = _open(archive)
                with own.open_input_stream(at, compression=None) as source, fs.open_output_stream(f"{path}/{name}.warc.gz", compression=None) as sink, fs.open_output_stream(f"{path}/{name}.idx", compression=None) as index:
                    for fields, _, whole in records(source):
                        z = zlib.compressobj(LEVEL, wbits=31)
                        member = z.compress(whole) + z.flush()
                        sink.write(member)
                        entry = {"offset": offset, "length": len(member), "id": fields["warc-record-id"], "type": fields["warc-type"], "uri": fields.get("warc-target-uri", ""), "digest": fields.get("warc-payload-digest", "")}
                        index.write(json.dumps(entry, ensure_ascii=False).encode() + b"\n")
                        offset, n = offset + len(member), n + 1
                yield _table([(f"{folder}/{name}.warc.gz", f"{folder}/{name}.idx", n, offset)], ARCHIVES)

    return common.materialize(archives.select("archive").mapInArrow(rewrite, ARCHIVES))


def _page(urn: str) -> int | None:
    text = urn.strip("<>").removeprefix(_ID)
    return None if text == "None" else int(text)


def read_records(archives: DataFrame, payload: bool = False) -> DataFrame:
    """Reads the records of normalised archives by the ranges of their indexes, checks their digests, and returns RECORDS, with the payload if it is asked for."""
    names = RECORDS + ", payload binary" * payload

    def read(batches):
        for batch in batches:
            for archive, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = _open(archive)
                beside, place = _open(index)
                rows, held = [], 0
                with fs.open_input_file(at) as data, beside.open_input_stream(place, compression=None) as lines:
                    for entry in map(json.loads, _lines(lines)):
                        data.seek(entry["offset"])
                        fields, block, _ = next(records(pa.BufferReader(data.read(entry["length"]))))
                        if digest(block) != fields["warc-block-digest"].removeprefix("sha1:"):
                            raise ValueError(f"{archive} at {entry['offset']}: the block differs from its digest")
                        http, _, body = block.partition(b"\r\n\r\n")
                        revisit = fields["warc-type"] == "revisit"
                        sha1 = fields["warc-payload-digest"].removeprefix("sha1:") if revisit else digest(body)
                        n = int(_fields(http)["content-length"]) if revisit else len(body)
                        row = (_page(fields["warc-record-id"]), n, sha1, fields["warc-type"], _page(fields["warc-refers-to"]) if revisit else None, fields.get("warc-target-uri"), archive, entry["offset"], entry["length"])
                        rows.append((*row, body) if payload else row)
                        held += len(body) * payload + 200
                        if held > 8 << 20:
                            yield _table(rows, names)
                            rows, held = [], 0
                if rows:
                    yield _table(rows, names)

    return archives.select("archive", "index").mapInArrow(read, names)


def _lines(stream) -> Iterator[bytes]:
    held = b""
    while data := stream.read(BLOCK):
        *whole, held = (held + data).split(b"\n")
        yield from whole
    if held:
        yield held


def with_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Marks the rows whose payload another row keeps. Only digests are grouped; rows meet their group by a join whose hot keys adaptive execution splits."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.cast("binary").alias("html"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).cast("bigint").alias("n_bytes"))
    kept = rows.where(F.col("n_bytes") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("__kept"), F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col("sha1").alias("__sha1"), "__kept")
    other = F.coalesce(F.col("page_id") < F.col("__kept"), F.col("__kept").isNotNull())
    joined = rows.join(kept, F.col("sha1") == F.col("__sha1"), "left").withColumn("revisit", F.when(F.col("__sha1").isNull(), F.lit(False)).otherwise(other))
    return joined.select("page_id", "url", F.when(~F.col("revisit"), F.col("html")).alias("html"), "sha1", "n_bytes", F.when(F.col("revisit"), F.col("__kept")).alias("refers_to"), "revisit")


def archive_pages(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) as monolithic archives, normalises them, drops the first form, and returns the table of normalised archives."""
    raw = write_monolithic(with_roles(pages, least_bytes), f"{folder}/raw")
    done = normalise(raw.repartition(max(1, min(raw.count(), 10_000))), f"{folder}/members")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    if store.get_file_info(f"{path}/raw").type != fs.FileType.NotFound:
        store.delete_dir(f"{path}/raw")
    return done


def op1_warc(spark, sf_dir: str) -> DataFrame:
    done = archive_pages(common.read(spark, sf_dir, "pages"), common.scratch(spark))
    return read_records(done.repartition(max(1, min(done.count(), 10_000)))).drop("uri", "archive", "offset", "length")


_BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
  (CAST('0x' || substr(sha, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), '')"""
ORACLES = {
    "op1_warc": f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS sha FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS kept, count(*) OVER (PARTITION BY sha) AS copies FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN copies > 1 AND page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN copies > 1 AND page_id < kept THEN kept END AS refers_to
FROM q"""
}
