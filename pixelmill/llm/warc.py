"""Zstandard WARC archives: written by Spark's own committer, read frame by frame.

An archive is a sequence of frames. The first is a skippable frame (magic 0x184D2A5D) that holds the
dictionary; then one frame per record. The writer uses the text sink, whose line separator is itself a
frame: an empty skippable one, which every decoder passes over. So archives go to whatever file system
Spark writes to, under its commit protocol, and a lost executor leaves no half archive behind. The
reader takes whole archives (``binaryFile``), loads the dictionary from the leading frame, walks the
frames by their block headers, and decodes one at a time, so what is open at once is one archive (a
few tens of MB, see ``ARCHIVE_BYTES``) and one record.

A record is refused, with the reason in ``error``, if its frame does not decode to its declared size,
if its headers cannot be read, or if Content-Length, the payload's length or its digest disagree. Reading goes on
with the next frame; only where a frame's own bounds cannot be told (cut off, or no frame) does the rest of its
archive become one refused row. A damaged dictionary refuses the records that need it.

Equal payloads are found by their digests alone: of digests with several pages the largest id is looked up,
by broadcast up to ``SMALL`` of them. Beyond it the revisits are found over ids and digests alone, and payloads meet them by
page, never by digest: an empty or boilerplate page that a third of all rows share is no hot key of the join that carries payloads.

Defined cases: null html is the empty payload, null url leaves WARC-Target-URI out; a null id leaves
WARC-Record-ID out, and such a row is a response only if its payload has no row with an id; rows with
the same largest id are all responses; payloads of any length are one record; an empty table gives no
archives' rows; columns other than the three named are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, stored, text_of

#: Payload bytes in an archive, before compression.
ARCHIVE_BYTES = 48 << 20
#: The dictionary of an archive is trained on at most so many of its first payloads, cut to so many bytes each.
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 4096, 32 << 10
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
SEPARATOR = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
#: Digests with several pages that may be broadcast: 20 bytes and an id each.
SMALL = 200_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "payload", "error"]
SCHEMA = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, target_uri string, payload binary, error string"


def roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Pages with ``record_type`` and ``refers_to``: of equal payloads of at least ``least_bytes`` the largest id is the response."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).cast("string").alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(F.encode("html", "utf-8"))))
    first = rows.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
    first = stored(first.where("n > 1").drop("n"), "originals")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    if first.count() <= SMALL:
        joined = rows.join(F.broadcast(first), "digest", "left")
    else:
        joined = _by_page(rows, first)
    return joined.select("page_id", "url", "html", "digest", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), F.when(revisit, F.col("original")).alias("refers_to"))


def _by_page(rows: DataFrame, first: DataFrame) -> DataFrame:
    """``rows`` with ``original``: digests meet ``first`` without their payloads, and payloads meet the outcome by page.

    A page is its id, its digest and a hash of its url, so that rows without an id do not lie on one key; rows that
    agree in all three have one role.
    """
    page = [F.coalesce("page_id", F.lit(0)).alias("k_id"), F.col("page_id").isNull().alias("k_null"), F.xxhash64("url").alias("k_url")]
    keyed = rows.select("*", *page)
    names = ["digest", "k_id", "k_null", "k_url"]
    originals = keyed.select(*names).distinct().join(first, "digest")
    return keyed.join(originals, names, "left").drop("k_id", "k_null", "k_url")


def _record(page_id, url, payload: bytes, digest: bytes, kind: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        lines.append(f"WARC-Target-URI: {url.replace('%', '%25').replace(chr(13), '%0D').replace(chr(10), '%0A')}")
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(payloads: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [p[:SAMPLE_BYTES] for p in payloads])
    except zstandard.ZstdError:  # too few or too uniform payloads to train on
        return None


def _archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frames of a partition's archives; ``archive`` numbers them, ``seq`` orders the frames of one."""
    archive, seq, size, packer, pending = -1, 0, 0, None, []

    def frames(rows):
        return [packer.compress(_record(*row)) for row in rows]

    def emit(cells, first):
        n = len(cells)
        return pa.record_batch([pa.array([archive] * n, pa.int32()), pa.array(range(first, first + n), pa.int64()), pa.array(cells, pa.binary())], names=["archive", "seq", "frame"])

    for batch in batches:
        rows = [(p, u, (h or "").encode(), d, t, r) for p, u, h, d, t, r in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True)]
        at = 0
        while at < len(rows):
            if packer is None or size >= ARCHIVE_BYTES:
                archive, seq, size = archive + 1, 0, 0
                trained = _dictionary([row[2] for row in rows[at : at + SAMPLES] if row[2]])
                packer = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True, write_content_size=True)
                if trained is not None:
                    raw = trained.as_bytes()
                    yield emit([struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw], 0)
                    seq = 1
            pending, held = [], 0
            while at < len(rows) and size < ARCHIVE_BYTES and held < (4 << 20):
                pending.append(rows[at])
                size += len(rows[at][2])
                held += len(rows[at][2])
                at += 1
            yield emit(frames(pending), seq)
            seq += len(pending)


def write(pages: DataFrame, path: str, **columns) -> None:
    """Archives of all pages under ``path``: one folder a number of archive, one file a task."""
    frames = roles(pages, **columns).select("page_id", "url", "html", "digest", "record_type", "refers_to").mapInArrow(_archive, "archive int, seq bigint, frame binary")
    ordered = frames.sortWithinPartitions("archive", "seq").select("archive", F.col("frame").cast("string").alias("value"))
    ordered.write.partitionBy("archive").option("lineSep", SEPARATOR).text(path)


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends, told by its block headers."""
    if at + 6 > len(data):
        raise ValueError("a frame is cut off")
    descriptor = data[at + 4]
    end = at + zstandard.frame_header_size(data[at : at + 18])
    last = False
    while not last:
        if end + 3 > len(data):
            raise ValueError("a frame is cut off")
        head = int.from_bytes(data[end : end + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        if kind == 3:
            raise ValueError("a block of no known kind")
        end += 3 + (1 if kind == 1 else size)
    end += 4 * (descriptor >> 2 & 1)
    if end > len(data):
        raise ValueError("a frame is cut off")
    return end


def _load_dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    """A dictionary as stored, or compressed as a frame of its own."""
    if raw[:4] == struct.pack("<I", ZSTD_MAGIC):
        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
    return zstandard.ZstdCompressionDict(raw)


def _decoded(frame: bytes, trained) -> tuple[bytes, str | None]:
    declared = zstandard.get_frame_parameters(frame[:18]).content_size
    unpacker = zstandard.ZstdDecompressor(dict_data=trained) if trained is not None else zstandard.ZstdDecompressor()
    record = unpacker.decompressobj().decompress(frame)
    unknown = declared in (zstandard.CONTENTSIZE_UNKNOWN, zstandard.CONTENTSIZE_ERROR)
    return record, None if unknown or len(record) == declared else f"{len(record)} bytes, {declared} declared"


def records(content: bytes) -> Iterator[tuple[bytes, str | None]]:
    """(record, error) of every record frame of an archive."""
    data, at, trained = memoryview(content), 0, None
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            if at + 8 + size > len(data) or at + 8 > len(data):
                yield b"", "a skippable frame is cut off"
                return
            if magic == DICTIONARY_MAGIC and at == 0:
                try:
                    trained = _load_dictionary(bytes(data[8 : 8 + size]))
                except zstandard.ZstdError as problem:
                    yield b"", f"the dictionary: {problem}"
            at += 8 + size
            continue
        if magic != ZSTD_MAGIC:
            yield b"", f"no frame at byte {at}"
            return
        try:
            end = frame_end(data, at)
        except (zstandard.ZstdError, ValueError) as problem:
            yield b"", str(problem)
            return
        try:
            yield _decoded(bytes(data[at:end]), trained)
        except zstandard.ZstdError as problem:
            yield b"", str(problem)
        at = end


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("a header without a colon")
        out[name.strip().lower().decode("ascii")] = value.strip().decode("utf-8")
    return out


def _page(urn: str | None) -> int | None:
    if urn is None:
        return None
    if not (urn.startswith("<urn:page:") and urn.endswith(">")):
        raise ValueError(f"no page id: {urn[:40]}")
    return int(urn[10:-1])


def parse(record: bytes) -> dict:
    """A record's fields; raises ValueError where headers, lengths or digest disagree."""
    head, blank, rest = record.partition(b"\r\n\r\n")
    if not blank or not head.startswith(b"WARC/1."):
        raise ValueError("no WARC header")
    fields = _headers(head)
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {length}, the block has {len(rest) - 4} bytes")
    http, blank, payload = rest[:length].partition(b"\r\n\r\n")
    if not blank:
        raise ValueError("no HTTP header")
    size, kind = int(_headers(http)["content-length"]), fields["warc-type"]
    name, _, digest = fields["warc-payload-digest"].partition(":")
    if name != "sha1" or kind not in ("response", "revisit"):
        raise ValueError("unknown digest or record type")
    if kind == "response":
        if len(payload) != size:
            raise ValueError(f"the payload has {len(payload)} bytes, {size} declared")
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError("the payload's digest differs")
    elif payload:
        raise ValueError("a revisit with a payload")
    uri = fields.get("warc-target-uri")
    return {
        "page_id": _page(fields.get("warc-record-id")), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": _page(fields.get("warc-refers-to")),
        "target_uri": uri and uri.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"), "payload": payload if kind == "response" else None, "error": None,
    }


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = dict.fromkeys(FIELDS)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]

        def emit(rows):
            return pa.record_batch([pa.array([row[f] for row in rows], kind) for f, kind in zip(FIELDS, kinds, strict=True)], names=FIELDS)

        for batch in batches:
            for i in range(batch.num_rows):
                out, held = [], 0
                for record, error in records(batch.column(0)[i].as_py()):
                    try:
                        row = empty | {"error": error} if error else parse(record)
                    except (ValueError, KeyError, UnicodeDecodeError) as problem:
                        row = empty | {"error": f"{type(problem).__name__}: {problem}"}
                    if not with_payload:
                        row["payload"] = None
                    out.append(row)
                    held += len(row["payload"] or b"")
                    if held > 8 << 20 or len(out) >= 5000:
                        yield emit(out)
                        out, held = [], 0
                yield emit(out)

    return run


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of all archives under ``path``; a record that is refused has its reason in ``error``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(_read(with_payload), SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives of all pages in the shared folder, read back: one row per record."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path, with_payload=False).drop("payload")
