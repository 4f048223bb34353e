"""WARC archives as seekable Zstandard bundles.

A bundle groups the records of some pages: records fill independent Zstandard frames of about a megabyte, and
the bundle ends in a seek table (a skippable frame in the public seekable format). A bundle's index row maps
each record id to its frame, the offset inside the decompressed frame and the length, so one record is read
by decompressing one frame. Bundles are rows of a Parquet table in the shared folder, so that any store that
Spark can write will do; ``export_bundles`` writes them as files.

Of records with equal payloads the one with the largest page_id is a ``response`` and the others are
``revisit`` records that refer to it and carry no payload, only its digest and length.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.numbering import join_hint
from jobloom.llm.scratch import materialize

#: Bytes of records in a frame and in a bundle, at most (one larger record makes its own).
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 4 << 20
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # fixed by the seekable format
DATE = "2024-01-01T00:00:00Z"
#: An extension field: the length of the full payload, which a revisit does not carry.
PAYLOAD_LENGTH = "X-Payload-Length"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>"


def write_record(page_id: int | None, url: str | None, kind: str, payload: bytes, digest: str, refers: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no block."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url:
        # white space and controls would break the header
        lines.append("WARC-Target-URI: " + "".join(quote(c) if c.isspace() or not c.isprintable() else c for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    lines.append(f"{PAYLOAD_LENGTH}: {len(payload)}")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {record_id(refers)}")
    block = b"" if kind == "revisit" else payload
    lines += ["Content-Type: text/html", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def read_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a WARC record: {first!r}")
    headers = dict(line.split(": ", 1) for line in lines)
    return headers, rest[: int(headers["Content-Length"])]


def seal(frames: list[tuple[bytes, int]]) -> bytes:
    """A bundle of compressed frames, given with their uncompressed sizes, and its seek table."""
    table = b"".join(struct.pack("<II", len(frame), size) for frame, size in frames)
    footer = struct.pack("<IBI", len(frames), 0, SEEKABLE)
    head = struct.pack("<II", SKIPPABLE, len(table) + len(footer))
    return b"".join(frame for frame, _ in frames) + head + table + footer


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of every frame, read from the end of a bundle."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    entry = 12 if flags & 0x80 else 8
    at, out = len(bundle) - 9 - entry * n, []
    offset = 0
    for k in range(n):
        packed, size = struct.unpack_from("<II", bundle, at + entry * k)
        out.append((offset, packed, size))
        offset += packed
    return out


def read_record_at(bundle: bytes, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record at ``offset`` of a frame's content."""
    content = _frame(bundle, *seek_table(bundle)[frame])
    return read_record(content[offset : offset + length])


def _frame(bundle: bytes, at: int, packed: int, size: int) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=size)


def _utf8(text: str | None) -> bytes:
    return (text or "").encode()


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose last column is html, with the payload's size and digest added."""
    for whole in batches:
        for batch in (whole.slice(at, 200) for at in range(0, len(whole), 200)):
            payloads = [_utf8(html) for html in batch.column(batch.num_columns - 1).to_pylist()]
            found = [pa.array(map(len, payloads), pa.int64()), pa.array(map(_digest, payloads), pa.string())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *found], names=[*batch.schema.names, "payload_bytes", "payload_digest"]
            )


_INDEX = [("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]
_ARCHIVES = "bundle_id string, bundle binary, index array<struct<record_id:string,frame:int,offset:long,length:long>>"


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    packer = zstandard.ZstdCompressor(level=3)
    frames: list[tuple[bytes, int]] = []
    records: list[bytes] = []  # of the frame that is being filled
    index: list[dict] = []
    held = in_frame = 0

    def end_frame() -> None:
        content = b"".join(records)
        frames.append((packer.compress(content), len(content)))
        records.clear()

    def sealed() -> pa.RecordBatch:
        bundle = seal(frames)
        kinds = (pa.string(), pa.binary(), pa.list_(pa.struct(_INDEX)))
        values = ([hashlib.sha1(bundle).hexdigest()], [bundle], [list(index)])
        arrays = [pa.array(v, kind) for v, kind in zip(values, kinds, strict=True)]
        frames.clear()
        index.clear()
        return pa.RecordBatch.from_arrays(arrays, names=["bundle_id", "bundle", "index"])

    for row in (row for batch in batches for at in range(0, len(batch), 200) for row in batch.slice(at, 200).to_pylist()):
        refers = row["response_id"] if row["record_type"] == "revisit" else None
        record = write_record(row["page_id"], row["url"], row["record_type"], _utf8(row["html"]), row["payload_digest"], refers)
        if records and in_frame + len(record) > FRAME_BYTES:
            end_frame()
            in_frame = 0
        if index and held + len(record) > BUNDLE_BYTES:
            if records:
                end_frame()
            yield sealed()
            held = in_frame = 0
        index.append({"record_id": record_id(row["page_id"]), "frame": len(frames), "offset": in_frame, "length": len(record)})
        records.append(record)
        held, in_frame = held + len(record), in_frame + len(record)
    if records:
        end_frame()
    if frames:
        yield sealed()


def write_archives(pages: DataFrame) -> DataFrame:
    """Write ``pages(page_id, url, html, ...)`` as a table ``(bundle_id, bundle, index)``.

    A null html is an empty payload. Rows that repeat the largest page_id of a payload are all responses.
    Only the digests are shuffled; pages are written where they are read, unless more than
    ``BROADCAST_ROWS`` payloads are shared.
    """
    pages = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")
    )
    hashed = pages.select("page_id", "html").mapInArrow(
        _digests, "page_id long, html string, payload_bytes long, payload_digest string"
    )
    responses = hashed.groupBy("payload_digest", "payload_bytes").agg(
        F.max("page_id").alias("response_id"), F.count("*").alias("copies")
    )
    shared = materialize(responses.filter("copies > 1").drop("copies"), "shared")
    # The digest is computed again beside the html, so that no page waits in a table.
    digested = pages.mapInArrow(_digests, "page_id long, url string, html string, payload_bytes long, payload_digest string")
    joined = digested.join(shared.hint(join_hint(shared.count())), ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("response_id").isNotNull() & ~F.col("response_id").eqNullSafe(F.col("page_id"))
    typed = joined.select(
        "page_id", "url", "html", "payload_digest", "response_id",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
    )
    return materialize(typed.mapInArrow(_bundles, _ARCHIVES), "archives")


def _page(header: str | None) -> int | None:
    number = header.removeprefix("<urn:page:").removesuffix(">") if header else "None"
    return None if number == "None" else int(number)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of bundles, a frame at a time."""
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "block"]
    for batch in (whole.slice(at, 1) for whole in batches for at in range(len(whole))):
        bundle, index = batch.column("bundle")[0].as_py(), batch.column("index")[0].as_py()
        for number, place in enumerate(seek_table(bundle)):
            content, rows = _frame(bundle, *place), []
            for entry in (x for x in index if x["frame"] == number):
                headers, block = read_record(content[entry["offset"] : entry["offset"] + entry["length"]])
                if headers["WARC-Record-ID"] != entry["record_id"]:
                    raise ValueError(f"index names {entry['record_id']}, the frame {headers['WARC-Record-ID']}")
                digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                size = int(headers[PAYLOAD_LENGTH])
                if kind == "response" and (len(block) != size or _digest(block) != digest):
                    raise ValueError(f"damaged payload of {entry['record_id']}")
                page, refers = _page(headers["WARC-Record-ID"]), _page(headers.get("WARC-Refers-To"))
                rows.append((page, headers.get("WARC-Target-URI"), size, digest, kind, refers, block))
            arrays = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of the bundles, through index and seek table.

    ``(page_id, url, payload_bytes, payload_digest, record_type, refers_to, block)``; ``block`` is the payload
    of a response, which is verified, and empty for a revisit, whose size is that of the payload it refers to.
    """
    kind = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, block binary"
    return archives.select("bundle", "index").mapInArrow(_read, kind)


def archive_digest(pages: DataFrame) -> DataFrame:
    """Write ``pages``, read the archives back, and return one row per record.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``, all read from the archives. Null and
    empty html are equal (empty) payloads; pages of any length are written whole, a large one as its own
    frame and bundle; repeated rows are records of their own; an empty table gives no rows; other columns
    are ignored.
    """
    return read_archives(write_archives(pages)).drop("block", "url")


def export_bundles(archives: DataFrame, folder: str) -> None:
    """Write each bundle to ``folder`` (which all executors share) as ``<bundle_id>.warc.zst``."""

    def save(rows) -> None:
        import os

        os.makedirs(folder, exist_ok=True)
        for row in rows:
            part = f"{folder}/.{row.bundle_id}.{os.getpid()}"
            with open(part, "wb") as f:
                f.write(row.bundle)
            os.replace(part, f"{folder}/{row.bundle_id}.warc.zst")  # a repeated task writes the same file

    archives.select("bundle_id", "bundle").foreachPartition(save)
