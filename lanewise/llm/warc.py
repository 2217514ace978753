"""WARC archives: writing one gzip member per record, and a sequential streaming reader.

Archives are written by tasks, each into files of its own; a file is named in the manifest only
when its task has committed, so an attempt that was lost leaves at most an unnamed file. The
reader holds one chunk of compressed bytes and one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.session import scratch_path, stored

CHUNK = 1 << 20
BATCH_BYTES = 8 << 20
READ_TASKS = 20_000  # at most; below that a task reads one archive
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """A record breaks the format, or its content does not match its digest."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes


def _open(path: str):
    """File system and path of a URI, or of a local path."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def http_response(payload: bytes, length: int) -> bytes:
    """An HTTP response head that declares ``length``, followed by ``payload``."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n"
    return head.encode() + payload


def encode_record(headers: dict[str, str], block: bytes) -> bytes:
    """One record as one gzip member; header values lose line breaks."""
    lines = [f"{k}: {' '.join(str(v).split())}" for k, v in headers.items() if v is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode()
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(head + block + b"\r\n\r\n") + press.flush()


def page_record(page_id, url, payload: bytes, refers_to) -> bytes:
    """A response, or a revisit that names the response's page and carries the HTTP head only."""
    same = refers_to is not None
    block = http_response(b"" if same else payload, len(payload))
    headers = {
        "WARC-Type": "revisit" if same else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": url,
        "WARC-Identified-Payload-Type": "text/html",
        "Content-Type": "application/http; msgtype=response",
        "WARC-Block-Digest": sha1_label(block),
        "WARC-Payload-Digest": sha1_label(payload),
        "WARC-Profile": REVISIT_PROFILE if same else None,
        "WARC-Refers-To": f"<urn:page:{refers_to}>" if same else None,
        "X-Page-ID": None if page_id is None else str(page_id),
    }
    return encode_record(headers, block)


def read_members(stream, chunk: int = CHUNK) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as an iterator of decompressed pieces."""
    rest = b""
    while rest or (rest := stream.read(chunk)):
        press = zlib.decompressobj(31)

        def pieces() -> Iterator[bytes]:
            nonlocal rest
            while not press.eof:
                data = press.unconsumed_tail or rest or stream.read(chunk)
                if not data:
                    raise WarcError("the last member is cut off")
                rest = b""
                if out := press.decompress(data, chunk):
                    yield out
            rest = press.unused_data

        yield pieces()
        if not press.eof:
            raise WarcError("a member was not read to its end")


def read_record(pieces: Iterator[bytes]) -> Record:
    """Frame one record by its content length and check its block digest."""
    buffer = bytearray()
    for piece in pieces:
        buffer += piece
    end = buffer.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError("no end of the record's head")
    version, *lines = bytes(buffer[:end]).decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise WarcError(f"not a record: {version[:20]!r}")
    headers = {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    start = end + 4
    try:
        stop = start + int(headers["Content-Length"])
    except (KeyError, ValueError):
        raise WarcError("no content length") from None
    if bytes(buffer[stop:]) != b"\r\n\r\n":
        raise WarcError("the content length does not meet the record's end")
    block = bytes(buffer[start:stop])
    digest = headers.get("WARC-Block-Digest")
    if digest is not None and digest != sha1_label(block):
        raise WarcError("block digest differs")
    return Record(headers, block)


def read_archive(path: str, chunk: int = CHUNK) -> Iterator[Record]:
    """The records of an archive in order."""
    system, inner = _open(path)
    with system.open_input_stream(inner, compression=None) as stream:
        for pieces in read_members(stream, chunk):
            yield read_record(pieces)


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("no end of the HTTP head")
    lines = head.decode("utf-8").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, body


def revisit_targets(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``pages`` with ``refers_to``: the largest page id among equal payloads, for the others.

    Only payloads of at least ``least`` bytes are compared, by SHA-1 and length. A page without
    id never is a target; the row that is the target, and repeats of its id, refer to nothing.
    """
    digest, size = F.sha1(F.col("payload").cast("binary")), F.octet_length("payload")
    keyed = pages.withColumns({"digest": digest, "bytes": size.cast("long")})
    targets = (
        keyed.where((F.col("bytes") >= least) & F.col("page_id").isNotNull())
        .groupBy("digest", "bytes")
        .agg(F.max("page_id").alias("target"), F.count("*").alias("times"))
    )
    joined = keyed.join(targets, ["digest", "bytes"], "left")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("target"))
    return joined.select("page_id", "url", "payload", F.when(other, F.col("target")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, max_bytes: int = 256 << 20) -> DataFrame:
    """Write (page_id, url, payload, refers_to) rows; a manifest of (path, records, bytes).

    A file is closed once it has ``max_bytes`` compressed bytes. Running it writes, so store the
    manifest and read that.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        done, sink, path, records, size = [], None, None, 0, 0
        try:
            for batch in batches:
                for page_id, url, payload, target in batch[["page_id", "url", "payload", "refers_to"]].itertuples(index=False):
                    if sink is None:
                        name = f"pages-{uuid.uuid4().hex}.warc.gz"
                        path, records, size = f"{folder.rstrip('/')}/{name}", 0, 0
                        sink = system.open_output_stream(f"{root.rstrip('/')}/{name}", compression=None)
                        info = b"software: lanewise\r\nformat: WARC File Format 1.1\r\n"
                        size += sink.write(encode_record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields", "WARC-Block-Digest": sha1_label(info)}, info)) or 0
                    member = page_record(None if pd.isna(page_id) else int(page_id), url, (payload or "").encode("utf-8", "surrogatepass"), None if pd.isna(target) else int(target))
                    sink.write(member)
                    records, size = records + 1, size + len(member)
                    if size >= max_bytes:
                        sink.close()
                        done.append((path, records, size))
                        sink = None
        finally:
            if sink is not None:
                sink.close()
        if sink is not None:
            done.append((path, records, size))
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    ints = {c: F.col(c).cast("string").alias(c) for c in ("page_id", "refers_to")}
    return pages.select(ints["page_id"], "url", "payload", ints["refers_to"]).mapInPandas(
        write, "path string, records long, bytes long"
    )


RECORDS = (
    "page_id long, url string, record_type string, record_id string, refers_to long, payload binary, "
    "payload_bytes long, payload_digest string"
)


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The response and revisit records of the archives in ``manifest.path``.

    ``payload_bytes`` and ``payload_digest`` (hex SHA-1) describe the full payload, also for a
    revisit, whose ``payload`` is null. A response's payload is checked against its digest and
    its declared length. A broken record is an error, never skipped.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        for batch in batches:
            for path in batch["path"]:
                rows, held = [], 0
                for record in read_archive(path):
                    h = record.headers
                    if h.get("WARC-Type") not in ("response", "revisit"):
                        continue
                    http, body = split_http(record.block)
                    revisit = h["WARC-Type"] == "revisit"
                    label = h["WARC-Payload-Digest"]
                    if not revisit and (sha1_label(body) != label or int(http["content-length"]) != len(body)):
                        raise WarcError(f"payload of {h.get('WARC-Record-ID')} differs from its digest or length")
                    target = h.get("WARC-Refers-To")
                    rows.append(
                        (
                            int(h["X-Page-ID"]) if "X-Page-ID" in h else None,
                            h.get("WARC-Target-URI"),
                            h["WARC-Type"],
                            h.get("WARC-Record-ID"),
                            int(target.rpartition(":")[2].rstrip(">")) if target else None,
                            body if with_payload and not revisit else None,
                            int(http["content-length"]),
                            base64.b32decode(label.partition(":")[2]).hex(),
                        )
                    )
                    held += len(body)
                    if held >= BATCH_BYTES:
                        yield _frame(rows, names)
                        rows, held = [], 0
                yield _frame(rows, names)

    files = manifest.select("path").repartition(max(1, min(manifest.count(), READ_TASKS)))
    return files.mapInPandas(read, RECORDS)


def _frame(rows: list, names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names, dtype=object)
    for c in ("page_id", "refers_to", "payload_bytes"):
        frame[c] = frame[c].astype("Int64")
    return frame


def archive_pages(pages: DataFrame, folder: str | None = None, least: int = 1000) -> DataFrame:
    """Write a record per page (``page_id``, ``url``, ``html``) and return the stored manifest.

    A null html is an empty payload, a null url or id leaves its header out, repeated rows get a
    record each, other columns are ignored, and no pages give no files.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce("html", F.lit("")).alias("payload"),
    )
    return stored(write_archives(revisit_targets(rows, least), folder), "warc-manifest")
