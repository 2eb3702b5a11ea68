"""WARC archives: a writer with revisit records and a splittable reader (operator 9).

Writer: one gzip member per record.  Of equal payloads of at least ``least`` bytes the
row with the largest key is a response; the others become revisit records that refer to
it and carry only headers.

Reader: tasks take byte ranges.  A task looks for the gzip magic from its range's start,
accepts a member only if it decodes to a WARC header and is followed by another member or
the file's end, and owns the records that start inside its range; the last of them may
end beyond it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs as storage
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import Workspace

MAGIC = b"\x1f\x8b\x08"
#: Payloads below this size are always stored.  Bytes of archive that one task reads, and of one archive file.
LEAST, SPLIT, ROTATE = 1000, 16 << 20, 1 << 30
_WINDOW = 1 << 20
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def locate(uri: str) -> tuple[storage.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    uri = re.sub(r"^file:/+", "/", uri)
    return (storage.LocalFileSystem(), uri) if uri.startswith("/") else storage.FileSystem.from_uri(uri)


# --- writing ---------------------------------------------------------------------------


def record(key: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """The bytes of one record, uncompressed."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = f"urn:row:{key}" if key is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest)}"
    target = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "") or "about:blank"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:row:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def revisits(pages: DataFrame, key: str, payload: str, least: int) -> DataFrame:
    """(key, digest, refers_to) of the rows that revisit another.  Payloads stay where they are; only digests are shuffled."""
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "utf-8")
    narrow = pages.select(F.col(key).alias("_key"), F.sha1(body).alias("_digest"), F.octet_length(body).alias("_n")).where(F.col("_n") >= least)
    last = narrow.groupBy("_digest").agg(F.max("_key").alias("_last"), F.count("*").alias("_rows")).where("_rows > 1").select("_digest", "_last")
    return narrow.join(last, "_digest").where("_key < _last").select("_key", "_digest", "_last").distinct()


def write_archives(pages: DataFrame, work: Workspace, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write every row of ``pages``; returns the files written: file, bytes, records.

    A null payload is empty.  A row with a null key is always a response.  Rows that
    repeat the largest key are all responses.  Files of lost tasks are left behind but
    are not in the result.  An empty table gives no files; other columns are not read.
    """
    folder = work.path("archives")
    back = revisits(pages, key, payload, least)
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "utf-8")
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), body.alias("_body"), F.sha1(body).alias("_digest"))
    # keys go to Python as text: a null would turn a column of numbers into floats
    rows = rows.join(back, ["_key", "_digest"], "left").select(F.col("_key").cast("string").alias("_key"), "_url", "_body", F.col("_last").cast("string").alias("_last"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = locate(folder)
        system.create_dir(top, recursive=True)
        written, out, size, count = [], None, 0, 0
        try:
            for frame in frames:
                for k, u, b, to in zip(frame["_key"], frame["_url"], frame["_body"], frame["_last"]):
                    if out is None:
                        name, size, count = f"{top}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = system.open_output_stream(name, compression=None)
                    data = gzip_member(record(k, u, bytes(b), to, date))
                    out.write(data)
                    size, count = size + len(data), count + 1
                    if size >= ROTATE:
                        out.close()
                        written.append((name, size, count))
                        out = None
        finally:
            if out is not None:
                out.close()
        if out is not None:
            written.append((name, size, count))
        yield pd.DataFrame(written, columns=["file", "bytes", "records"])

    return work.save(rows.mapInPandas(run, "file string, bytes long, records long"), "files")


# --- reading ---------------------------------------------------------------------------


class Window:
    """Reads of a file through one buffer, so that neighbouring small reads cost one request."""

    def __init__(self, handle, size: int):
        self.handle, self.size, self.base, self.data = handle, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if not self.base <= at <= at + n <= self.base + len(self.data):
            self.handle.seek(at)
            self.base, self.data = at, self.handle.read(max(n, _WINDOW))
        return self.data[at - self.base : at - self.base + n]


def member_at(window: Window, at: int) -> tuple[bytes, int] | None:
    """The decoded member that starts at a position and its end; None if no WARC record starts there."""
    if window.read(at, 3) != MAGIC:
        return None
    decoder, parts, position, begun = zlib.decompressobj(31), [], at, b""
    step = 1 << 12
    try:
        while not decoder.eof:
            chunk = window.read(position, step)
            if not chunk:
                return None
            position += len(chunk)
            found = decoder.decompress(chunk)
            parts.append(found)
            if len(begun) < 5:
                begun += found[:5]
                if not b"WARC/".startswith(begun[:5]):
                    return None
            step = min(step * 2, _WINDOW)
    except zlib.error:
        return None
    return (b"".join(parts), position - len(decoder.unused_data)) if begun[:5] == b"WARC/" else None


def members(window: Window, low: int, high: int) -> Iterator[tuple[int, bytes]]:
    """(position, decoded bytes) of the members that start in [low, high)."""
    at, sure = low, low == 0
    while at < high:
        found = member_at(window, at)
        # a chance match inside another member isn't followed by a member or the end
        if found and (sure or found[1] == window.size or member_at(window, found[1])):
            yield at, found[0]
            at, sure = found[1], True
            continue
        sure = False
        at += 1
        while at < high:
            block = window.read(at, min(_WINDOW, high - at + len(MAGIC) - 1))
            hit = block.find(MAGIC)
            if hit >= 0:
                at += hit
                break
            at += max(1, len(block) - len(MAGIC) + 1)


@dataclass(frozen=True)
class Parsed:
    record_id: str
    kind: str
    url: str | None
    payload: bytes | None
    payload_bytes: int
    digest: str
    refers_to: str | None


def _fields(block: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in block.decode("utf-8").split("\r\n")[1:] if ":" in line)
    return {name.strip().lower(): value.strip() for name, value in pairs}


def parse(data: bytes) -> Parsed:
    """A record from its decoded bytes; a stored payload must match its length and digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(_fields(http)["content-length"])
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    stored = fields["warc-type"] == "response"
    if stored and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['warc-record-id']} does not match its length or digest")
    return Parsed(fields["warc-record-id"], fields["warc-type"], fields.get("warc-target-uri"), payload if stored else None, n, digest, fields.get("warc-refers-to"))


def read_archives(files: DataFrame, split: int = SPLIT, payloads: bool = False, most_tasks: int = 100_000) -> DataFrame:
    """The records of archive files (file, bytes): record_id, record_type, url, payload_bytes, payload_digest, refers_to.

    ``payloads`` adds the column payload, null for revisits.  Archives are cut into
    ranges of ``split`` bytes that are read independently, one in a task up to
    ``most_tasks`` tasks; an empty table of files gives
    no records.
    """
    ranges = files.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("low"))
    # a task for each range, whatever the size of the rows that name it; range numbers are dealt evenly
    tasks = max(1, min(most_tasks, int(files.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 1)))
    ranges = ranges.repartition(tasks)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, size, low in zip(frame["file"], frame["bytes"], frame["low"]):
                system, path = locate(file)
                with system.open_input_file(path) as handle:
                    rows = []
                    for _, data in members(Window(handle, int(size)), int(low), min(int(low) + split, int(size))):
                        r = parse(data)
                        rows.append((r.record_id, r.kind, r.url, r.payload_bytes, r.digest, r.refers_to, r.payload if payloads else None))
                        if len(rows) >= 500:
                            yield _frame(rows)
                            rows = []
                    yield _frame(rows)

    found = ranges.mapInPandas(run, "record_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary")
    return found if payloads else found.drop("payload")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["record_id", "record_type", "url", "payload_bytes", "payload_digest", "refers_to", "payload"])
