"""WARC archives compressed with Zstandard: a writer, and a reader that checks what it decodes.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, raw or itself
Zstandard-compressed; then every record is one frame. The reader loads the dictionary, walks the
frames one by one and checks each record's version line, headers, block length and digests. It takes
archives of other writers too: every record type, unknown content sizes, chunked bodies.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.cluster import scratch
from codexlake.llm.common import only, prepare, table

#: Fixed values of the format.
DICT_MAGIC, ZSTD_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
VERSION, VERSIONS = b"WARC/1.1", (b"WARC/1.1", b"WARC/1.0")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: An archive is closed after so many payload bytes.
ARCHIVE_BYTES = 24 << 20
#: The dictionary is trained on the first records of its archive, up to these bounds.
DICT_BYTES, SAMPLE_RECORDS, SAMPLE_BYTES = 16 << 10, 64, 512 << 10
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("9b1c9f3e-2f55-5c1e-9b62-6f0d6ad3a001")

#: Parts that a digest's copies are dealt to when pages meet the digests that repeat.
SALTS = 16

RECORD_SCHEMA = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, record_id string, refers_to_id string"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, str(page_id))}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit keeps the HTTP head, with the full payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC-Type: " + ("response" if refers_to is None else "revisit"), f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{payload_digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is None:
        head.append("X-No-Url: 1")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes]) -> bytes:
    """Dictionary bytes; too few or too uniform samples serve as a raw-content dictionary."""
    try:
        return zstd.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[:DICT_BYTES]


def write_archive(records: list[bytes]) -> bytes:
    sample, size = [], 0
    for r in records[:SAMPLE_RECORDS]:
        sample.append(r[: SAMPLE_BYTES - size])
        size += len(sample[-1])
        if size >= SAMPLE_BYTES:
            break
    raw = train_dictionary(sample)
    packed = zstd.ZstdCompressor(level=LEVEL).compress(raw)
    comp = zstd.ZstdCompressor(level=LEVEL, dict_data=zstd.ZstdCompressionDict(raw), write_content_size=True, write_checksum=True)
    return b"".join([struct.pack("<II", DICT_MAGIC, len(packed)), packed, *(comp.compress(r) for r in records)])


class BadArchive(ValueError):
    """The archive breaks the format; the message says where."""


def read_dictionary(data: bytes) -> tuple[bytes | None, int]:
    """The dictionary of a leading skippable frame, if there is one, and where the records begin."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICT_MAGIC:
        return None, 0
    n = struct.unpack_from("<I", data, 4)[0]
    if 8 + n > len(data):
        raise BadArchive("the dictionary frame is cut off")
    body = bytes(data[8 : 8 + n])
    return (zstd.ZstdDecompressor().decompress(body, max_output_size=1 << 27) if body[:4] == ZSTD_MAGIC else body), 8 + n


def frame_end(view: memoryview, at: int) -> int:
    """Where the frame at a place ends: its header, then its blocks one by one, then a checksum if it has one."""
    try:
        end = at + zstd.frame_header_size(view[at : at + 18])
        checked = zstd.get_frame_parameters(view[at : at + 18]).has_checksum
    except zstd.ZstdError as e:
        raise BadArchive(f"no frame at byte {at}: {e}") from e
    last = False
    while not last:
        if end + 3 > len(view):
            raise BadArchive(f"the frame at byte {at} is cut off")
        word = int.from_bytes(view[end : end + 3], "little")
        last, kind, size = bool(word & 1), word >> 1 & 3, word >> 3
        if kind == 3:
            raise BadArchive(f"the frame at byte {at} has a block of no known type")
        end += 3 + (1 if kind == 1 else size)
    end += 4 * checked
    if end > len(view):
        raise BadArchive(f"the frame at byte {at} is cut off")
    return end


def read_archive(data: bytes) -> Iterator[bytes]:
    """Each record's bytes, one frame at a time; other skippable frames are passed over. Time grows with the archive's size."""
    view = memoryview(data)
    words, at = read_dictionary(view)
    engine = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(words) if words else None)
    while at < len(view):
        if len(view) - at >= 8 and 0x184D2A50 <= struct.unpack_from("<I", view, at)[0] <= 0x184D2A5F:
            at += 8 + struct.unpack_from("<I", view, at + 4)[0]
            if at > len(view):
                raise BadArchive("a skippable frame is cut off")
            continue
        end = frame_end(view, at)
        try:
            frame = engine.decompressobj()
            out = frame.decompress(view[at:end])
        except zstd.ZstdError as e:
            raise BadArchive(f"no whole frame at byte {at}: {e}") from e
        if not frame.eof:
            raise BadArchive(f"the frame at byte {at} is cut off")
        at = end
        yield out


def headers(raw: bytes, what: str) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with a blank continues the one before. A repeated field keeps its first value."""
    out: dict[str, str] = {}
    last = None
    for line in raw.decode("utf-8", "surrogateescape").split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise BadArchive(f"a {what} header line has no name: {line[:80]!r}")
        last = name.strip().lower()
        if last in out:
            last = None
        else:
            out[last] = value.strip()
    return out


def _length(fields: dict[str, str], what: str) -> int | None:
    text = fields.get("content-length")
    if text is None:
        return None
    if not text.isascii() or not text.isdigit():
        raise BadArchive(f"the {what} Content-Length is no number: {text[:40]!r}")
    return int(text)


def _agrees(digest: str, body: bytes) -> bool:
    """Whether a labelled digest is that of these bytes, in base32 or hex; of an unknown algorithm nothing can be said."""
    kind, _, value = digest.partition(":")
    if kind.lower() not in ("sha1", "sha256", "md5"):
        return True
    sum_ = hashlib.new(kind.lower(), body).digest()
    return value.rstrip("=").upper() in (base64.b32encode(sum_).decode().rstrip("="), sum_.hex().upper())


def unchunked(body: bytes) -> bytes:
    """The body of a chunked HTTP message."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        try:
            n = int(size, 16)
        except ValueError:
            raise BadArchive("a chunk has no length") from None
        if n == 0:
            return b"".join(out)
        if len(body) < end + 2 + n:
            raise BadArchive("a chunk is cut off")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def parse_record(raw: bytes) -> dict:
    """The fields of one record, after checks of version, headers, lengths and digests; whatever breaks them is a BadArchive.

    A response or revisit of type application/http has the HTTP body as payload, a revisit's length comes
    from its HTTP head; other records, such as warcinfo, request or metadata, have their block as payload.
    """
    end = raw.find(b"\r\n\r\n")
    line = raw[: raw.find(b"\r\n")]
    if line not in VERSIONS or end < 0:
        raise BadArchive("no WARC/1.1 or WARC/1.0 header")
    head = headers(raw[len(line) + 2 : end], "WARC")
    for need in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"):
        if not head.get(need.lower()):
            raise BadArchive(f"{need} is missing")
    n = _length(head, "WARC")
    block = raw[end + 4 : end + 4 + n]
    if len(block) != n or raw[end + 4 + n :] != b"\r\n\r\n":
        raise BadArchive("Content-Length differs from the block's length")
    if not _agrees(head.get("warc-block-digest", ""), block):
        raise BadArchive("the block digest differs")
    kind, cut_short = head["warc-type"].lower(), "warc-truncated" in head
    payload, full = block, len(block)
    if kind in ("response", "revisit") and head.get("content-type", "").lower().startswith("application/http") and block:
        cut = block.find(b"\r\n\r\n")
        if cut < 0:
            raise BadArchive("the HTTP head does not end")
        status, _, rest = block[:cut].partition(b"\r\n")
        if not status.startswith(b"HTTP/"):
            raise BadArchive("the HTTP head has no status line")
        http = headers(rest, "HTTP") if rest else {}
        payload, said = block[cut + 4 :], _length(http, "HTTP")
        if "chunked" in http.get("transfer-encoding", "").lower():
            said, whole = None, unchunked(payload) if payload and not cut_short else payload
        else:
            whole = payload
        if kind == "response" and said is not None and said != len(payload) and not cut_short:
            raise BadArchive("the payload's length differs from the HTTP head's")
        if kind == "response" and not cut_short and not (_agrees(head.get("warc-payload-digest", ""), payload) or _agrees(head.get("warc-payload-digest", ""), whole)):
            raise BadArchive("the payload's digest differs")
        payload, full = whole, len(whole) if kind == "response" else said
    elif kind == "response" and not cut_short and not _agrees(head.get("warc-payload-digest", ""), block):
        raise BadArchive("the payload's digest differs")
    if kind == "revisit":
        if payload is not block and payload:
            raise BadArchive("a revisit has a payload")
        if "warc-refers-to" not in head and "warc-refers-to-target-uri" not in head:
            raise BadArchive("a revisit refers to nothing")
    digest = head.get("warc-payload-digest", "")
    page, refers = head.get("x-page-id"), head.get("x-refers-to-page-id")
    for name, value in (("X-Page-Id", page), ("X-Refers-To-Page-Id", refers)):
        if value is not None and not value.lstrip("-").isdigit():
            raise BadArchive(f"{name} is no number")
    return {
        "page_id": None if page is None else int(page), "url": None if "x-no-url" in head else head.get("warc-target-uri", ""), "record_type": kind,
        "refers_to": None if refers is None else int(refers), "payload_bytes": full, "payload_digest": digest.partition(":")[2] or (None if kind == "revisit" else payload_digest(payload)),
        "payload": None if kind == "revisit" else payload, "record_id": head["warc-record-id"], "refers_to_id": head.get("warc-refers-to"),
    }


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): of equal payloads of at least `min_bytes`, the largest page_id is the response.

    A first narrow pass finds the groups of two and more by digest; only their pages refer to another,
    so a table without copies has nothing to join. Rows that repeat the largest page_id are responses;
    a group whose page_ids are all null has only responses.
    """
    html = F.coalesce("html", F.lit(""))
    keyed = pages.withColumn("digest", F.sha2(html.cast("binary"), 256))
    groups = keyed.where(F.octet_length(html) >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 and last is not null").select("digest", "last")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    # a digest that a third of the pages share is dealt to several tasks; the groups are narrow, so they repeat instead
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return keyed.join(groups, ["digest", "salt"], "left").select("page_id", "url", html.alias("html"), refers.alias("refers_to"))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Write archives below a folder that every executor reaches; returns how many records were written.

    Columns: page_id, url, html. A null html is an empty payload, a null url an empty target; others
    are ignored. Each task streams its rows; an archive is written under a name of its own attempt and
    then renamed, so a task that runs again replaces its own archives with the same bytes.
    """
    spark = pages.sparkSession
    prepare(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        kept, size, count, number = [], 0, 0, 0

        def close() -> None:
            draft = f"{root}/.draft-{task.taskAttemptId()}-{number}"
            with store.open_output_stream(draft) as f:
                f.write(write_archive(kept))
            store.move(draft, f"{root}/part-{task.partitionId():06d}-{number:04d}.warc.zst")

        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(i) for i in range(4)), strict=True):
                body = html.as_py().encode()
                page_id, target = page.as_py(), refers.as_py()
                kept.append(record(page_id, url.as_py(), body, payload_digest(body), target))
                size += len(kept[-1])
                count += 1
                if size >= archive_bytes:
                    close()
                    kept, size, number = [], 0, number + 1
        if kept:
            close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([count], pa.int64())})

    marked = mark_revisits(only(pages, "page_id", "url", "html"), min_bytes)
    return marked.mapInArrow(write, "n bigint").agg(F.sum("n").alias("n")).first().n or 0


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record of the archives (*.warc.zst) below a path. A broken archive raises BadArchive with its name.

    Records of other writers have no page_id and refers_to; record_id and refers_to_id have what the
    archive says. A folder without archives gives no rows; an archive's records keep their order.
    """
    prepare(spark)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                rows, size = [], 0
                try:
                    for raw in read_archive(data.as_buffer()):
                        rows.append(parse_record(raw))
                        size += len(raw)
                        if not with_payload:
                            rows[-1]["payload"] = None
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)
                            rows, size = [], 0
                except BadArchive as e:
                    raise BadArchive(f"{name.as_py()}: {e}") from e
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("path", "content")
    return files.mapInArrow(decode, RECORD_SCHEMA)


_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("record_id", pa.string()), ("refers_to_id", pa.string())])


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of `pages` written as a record and read back; nulls and repeats as in `write_warc`, an empty table gives no rows."""
    path = scratch(spark, "warc")
    path = path if "://" in path else f"file://{path}"
    if not write_warc(table(spark, sf_dir, "pages"), path):
        return spark.createDataFrame([], "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
    return read_warc(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
