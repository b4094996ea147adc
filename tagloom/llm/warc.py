"""WARC archives: whole-stream gzip files, their normalisation, and reading by offset.

* ``write_archives`` writes a record for each page; each task streams its pages
  into one file that is a single gzip member, as many crawlers leave them.
* ``normalise`` inflates each such file once, as a stream, rewrites every record
  as a gzip member of its own, and writes a sidecar index (a JSON line for each
  record: offset, length, type, id, digest) beside it.
* ``read_archives`` reads records by their offsets, inflates each member alone,
  checks payloads against their digests, and returns a row for each record.

Pages with equal payloads (by SHA-1) are stored once: the smallest page_id is the
response, the others are revisit records that refer to it.  The length of the
full payload is in the HTTP header of either.

Files live in the shared folder.  A task writes under a new name and only names
in the manifest that Spark has committed count, so a lost executor leaves nothing
but orphans.  The normaliser's names follow from its input: a repeated task finds
finished work and returns it, and the input can go as soon as it is rewritten.

Defined cases: null html is an empty payload; null pages urls get a urn; a null
page_id is written as ``null``, and revisits whatever page has the same payload;
rows that repeat the smallest page_id are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.shared import file_system, shared_folder, slices, stored

DATE = "2024-01-01T00:00:00Z"  # the pages table has no dates; fixed, so that archives repeat
PART = 1 << 20
GROUP_BYTES = 32 << 20


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_of(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if re.fullmatch(r"-?\d+", text) else None


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, first: int | None) -> bytes:
    """A response, or a revisit without payload if ``first`` (the page it refers to) is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else _urn(page_id)[1:-1]
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest_text(sha1)}",
    ]
    if first is not None:
        head += [f"WARC-Refers-To: {_urn(first)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "surrogatepass").split("\r\n")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}


# ---- writing ----


def write_archives(pages: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """One single-member .warc.gz for each task below ``folder``; the manifest: archive, records."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint"), "url", payload.alias("html"), F.unhex(F.sha1(payload.cast("binary"))).alias("sha1"))
    shared = rows.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = stored(shared, "shared-payloads")
    rows = rows.join(shared, "sha1", "left")
    first = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, n = None, f"{folder}/whole/{uuid.uuid4().hex}.warc.gz", 0
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        files, path = file_system(name)
        for batch in slices(batches, 2):
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = files.open_output_stream(path, compression=None)
                page_id, url, html, sha1, of = row
                out.write(packer.compress(record(page_id, url, html.encode("utf-8", "surrogatepass"), sha1, of)))
                n += 1
        if out is not None:
            out.write(packer.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["archive", "records"])

    return rows.select("page_id", "url", "html", "sha1", first.alias("first")).mapInArrow(write, "archive string, records bigint")


# ---- normalising ----


def inflated(stream) -> Iterator[bytes]:
    """The content of a gzip stream in parts, however many members it has."""
    unpacker = zlib.decompressobj(31)
    fed = False
    while data := stream.read(PART):
        while data:
            if unpacker.eof:
                unpacker, fed = zlib.decompressobj(31), False
            fed = True
            part = unpacker.decompress(data, PART)
            if part:
                yield part
            data = unpacker.unused_data if unpacker.eof else unpacker.unconsumed_tail
    if fed and not unpacker.eof:
        raise ValueError("the gzip stream ends too early")


class Cursor:
    """Reads ahead in a stream of parts without holding more than is asked for."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.held = parts, b""

    def _more(self) -> bool:
        part = next(self.parts, None)
        if part is None:
            return False
        self.held += part
        return True

    def head(self) -> bytes | None:
        """Up to and including the next empty line; None at the end."""
        while (at := self.held.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.held.strip():
                    raise ValueError("the last record has no end")
                return None
        result, self.held = self.held[: at + 4], self.held[at + 4 :]
        return result

    def take(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.held and not self._more():
                raise ValueError("the last record is too short")
            part, self.held = self.held[:size], self.held[size:]
            size -= len(part)
            yield part


def normalise_file(archive: str, target: str, level: int = 6) -> list[tuple[int, int]]:
    """Rewrite one archive with a member for each record, and write its index; ranges of about GROUP_BYTES to read together."""
    files, path = file_system(target)
    source, source_path = file_system(archive)
    index_path = f"{path}.idx"
    if files.get_file_info(index_path).type.name == "File":  # a task before this one has finished
        with files.open_input_stream(index_path, compression=None) as held:
            entries = [json.loads(line) for line in held.read().splitlines()]
        return _ranges([(e["offset"], e["length"]) for e in entries])
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft, draft_index = f"{path}.{uuid.uuid4().hex}", f"{index_path}.{uuid.uuid4().hex}"
    places: list[tuple[int, int]] = []
    with source.open_input_stream(source_path, compression=None) as stream, files.open_output_stream(draft, compression=None) as out, files.open_output_stream(draft_index, compression=None) as index:
        cursor, offset = Cursor(inflated(stream)), 0
        while (head := cursor.head()) is not None:
            fields = headers(head)
            packer, length = zlib.compressobj(level, zlib.DEFLATED, 31), 0
            for part in chain([head], cursor.take(int(fields["content-length"]) + 4)):
                packed = packer.compress(part)
                out.write(packed)
                length += len(packed)
            packed = packer.flush()
            out.write(packed)
            length += len(packed)
            entry = {"offset": offset, "length": length, "type": fields["warc-type"], "id": fields["warc-record-id"], "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest")}
            index.write(json.dumps(entry).encode() + b"\n")
            places.append((offset, length))
            offset += length
    files.move(draft, path)
    files.move(draft_index, index_path)  # last: what has an index is whole
    return _ranges(places)


def _ranges(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """First and end offsets of runs of records."""
    runs: list[tuple[int, int]] = []
    for offset, length in places:
        if runs and offset + length - runs[-1][0] <= GROUP_BYTES:
            runs[-1] = (runs[-1][0], offset + length)
        else:
            runs.append((offset, offset + length))
    return runs


def normalise(manifest: DataFrame, folder: str, level: int = 6, drop_source: bool = False) -> DataFrame:
    """Normalised archives below ``folder``: archive, start, stop of ranges of whole records.

    With ``drop_source`` an archive is deleted once its normal form and index are there.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                target = f"{folder}/records/{archive.rsplit('/', 1)[1]}"
                runs = normalise_file(archive, target, level)
                if drop_source:
                    source, path = file_system(archive)
                    if source.get_file_info(path).type.name == "File":
                        source.delete_file(path)
                yield pa.RecordBatch.from_arrays([pa.array([target] * len(runs), pa.string()), pa.array([r[0] for r in runs], pa.int64()), pa.array([r[1] for r in runs], pa.int64())], ["archive", "start", "stop"])

    spread = manifest.select("archive").repartition(max(1, manifest.count()))  # one archive for each task
    return spread.mapInArrow(rewrite, "archive string, start bigint, stop bigint")


# ---- reading ----

ROWS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_member(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """A row of one record; a response's payload must have the length and digest that its headers tell."""
    content = zlib.decompress(data, 31)
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = headers(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size, digest = int(headers(http)["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload) != size or digest_text(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"the payload of {fields['warc-record-id']} is not what its headers say")
    return _page_of(fields["warc-record-id"]), size, digest, fields["warc-type"], _page_of(fields.get("warc-refers-to"))


def read_archives(ranges: DataFrame) -> DataFrame:
    """A row for each record of the ranges that ``normalise`` gave, found through the sidecar index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, start, stop in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                files, path = file_system(archive)
                with files.open_input_stream(f"{path}.idx", compression=None) as index:
                    places = [(e["offset"], e["length"]) for e in map(json.loads, index.read().splitlines()) if start <= e["offset"] < stop]
                with files.open_input_file(path) as held:
                    rows = [read_member(held.read_at(length, offset)) for offset, length in places]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    spread = ranges.repartition(max(1, ranges.count()))  # one range for each task
    return spread.select("archive", "start", "stop").mapInArrow(read, ROWS)


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write, normalise and read back: a row for each page."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    manifest = stored(write_archives(pages, folder), "warc-manifest")
    ranges = stored(normalise(manifest, folder, drop_source=True), "warc-ranges")
    return read_archives(ranges)
