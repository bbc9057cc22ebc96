"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Records are written one gzip member each through Spark's own text writer, which sends the
bytes of a cell on as they are: files therefore reach any store that Spark reaches, and a lost
task leaves nothing behind. The writer ends every cell with one byte, the zero byte with which
a member ends anyhow.

The reader walks a file record by record. Where a check fails (the member's checksum, the
record's length, its block digest), it searches for the next place at which a whole valid
record begins, a gzip member or a version line, goes on there, and logs the bytes in between
as a quarantined gap.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casetable.operators.joins import join_spread

#: Smaller payloads are always stored, never revisited.
REVISIT_BYTES = 100
#: Files are cut after so many bytes, or one longer record, so that a reader can hold one file.
FILE_BYTES = 32 << 20
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
_EMPTY_MEMBER = gzip.compress(b"", mtime=0)

RECORD_SCHEMA = (
    "path string, begins long, ends long, record_id string, record_type string, refers_to string, uri string, "
    "payload_digest string, payload_bytes long, block_digest string, payload binary, after_gap boolean, gap_reason string"
)
_ARROW = pa.schema([
    ("path", pa.string()), ("begins", pa.int64()), ("ends", pa.int64()), ("record_id", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("payload_digest", pa.string()),
    ("payload_bytes", pa.int64()), ("block_digest", pa.string()), ("payload", pa.binary()), ("after_gap", pa.bool_()), ("gap_reason", pa.string()),
])


def record_bytes(record_id: str, kind: str, payload: bytes, digest: str, uri: str | None, refers_to: str | None) -> bytes:
    """One record: version line, named fields, block. A revisit has no block."""
    block = payload if kind == "response" else b""
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
    ]
    if uri is not None:
        fields.append(("WARC-Target-URI", uri.replace("\r", "%0D").replace("\n", "%0A")))
    if kind == "revisit":
        fields.append(("WARC-Refers-To", f"<{refers_to}>"))
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    else:
        fields.append(("Content-Type", "text/html"))
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(record: bytes, level: int) -> bytes:
    """A gzip member that ends with a zero byte; past 16 MB an empty member follows to end so."""
    packed = gzip.compress(record, level, mtime=0)
    return packed if packed[-1] == 0 else packed + _EMPTY_MEMBER


class Damaged(Exception):
    """A check of a record failed."""


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Fields, block and end of the record at a version line, every check included."""
    if data[at:at + len(VERSION)] != VERSION:
        raise Damaged("no version line")
    head_end = data.find(b"\r\n\r\n", at)
    if head_end < 0:
        raise Damaged("fields cut")
    fields = {}
    for line in data[at:head_end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("field without a colon")
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Damaged("no length")
    begins = head_end + 4
    ends = begins + int(length)
    if data[ends:ends + 4] != b"\r\n\r\n":
        raise Damaged("block cut or of another length")
    block = data[begins:ends]
    algorithm, _, digest = fields.get("warc-block-digest", "").partition(":")
    if algorithm == "sha256" and hashlib.sha256(block).hexdigest() != digest:
        raise Damaged("block digest differs")
    return fields, block, ends + 4


def read_member(data: bytes, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at a place, and where it ends. Reads on in growing steps, never the whole rest."""
    stream = zlib.decompressobj(wbits=31)
    view, content, step = memoryview(data), [], 4096
    try:
        while not stream.eof and at < len(data):
            content.append(stream.decompress(view[at:at + step]))
            at += step
            step = min(2 * step, 1 << 20)
    except zlib.error as e:
        raise Damaged(f"member: {e}") from None
    if not stream.eof:
        raise Damaged("member cut")
    return b"".join(content), min(at, len(data)) - len(stream.unused_data)


def read_at(data: bytes, at: int) -> tuple[dict[str, str] | None, bytes, int]:
    """The record at a place, compressed or not. An empty member gives no fields."""
    if data[at:at + len(MAGIC)] != MAGIC:
        return parse_record(data, at)
    content, ends = read_member(data, at)
    if not content:
        return None, b"", ends
    fields, block, used = parse_record(content, 0)
    if used != len(content):
        raise Damaged("bytes after the record in its member")
    return fields, block, ends


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str | None]]:
    """Begin, end, fields, block and None for each record; or begin, end, None, b"" and a reason for a gap."""
    at, size = 0, len(data)
    while at < size:
        try:
            fields, block, ends = read_at(data, at)
        except Damaged as e:
            bad, reason = at, str(e)
            while True:
                found = [x for x in (data.find(MAGIC, at + 1), data.find(VERSION, at + 1)) if x >= 0]
                if not found:
                    at = size
                    break
                at = min(found)
                try:
                    read_at(data, at)
                    break
                except Damaged:
                    continue
            yield bad, at, None, b"", reason
            continue
        if fields is not None:
            yield at, ends, fields, block, None
        at = ends


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Each page with its payload, digest, record id, and the record that it revisits, if any.

    Of pages with equal payloads of at least 100 bytes the one with the smallest id is stored. A
    null page is empty; a page without an id has no place in that order and is stored unless
    another equal page has one.
    """
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("uri"),
        F.coalesce(F.col(html_col), F.lit("")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= REVISIT_BYTES
    firsts = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"))

    def urn(page):
        return F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), F.col("digest"))

    revisit = large & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return join_spread(rows, firsts, ["digest"], "left").select(
        urn(F.col("page_id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("kind"),
        "payload", "digest", "uri", F.when(revisit, urn(F.col("first"))).alias("refers_to"),
    )


def write_archives(
    records: DataFrame, path: str, *, level: int = 6, torn_every: int | None = None, file_bytes: int = FILE_BYTES
) -> None:
    """Write records as ``.txt`` parts of gzip members, each a WARC file of its own of about ``file_bytes``.

    ``torn_every=n`` writes the first half of every n-th record of a task once more before it,
    as an interrupted writer leaves it; the reader has to pass over these.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, out, held = 0, [], 0

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(out)[:-1]], pa.binary())], ["value"])

        for batch in batches:
            for i in range(batch.num_rows):
                record_id, kind, payload, digest, uri, refers_to = (c[i].as_py() for c in batch.columns)
                packed = member(record_bytes(record_id, kind, payload.encode(), digest, uri, refers_to), level)
                n += 1
                if torn_every and n % torn_every == 0:
                    packed = packed[:len(packed) // 2] + packed
                out.append(packed)
                held += len(packed)
                if held >= file_bytes:
                    yield file()
                    out, held = [], 0
        if out:
            yield file()

    rows = records.select("record_id", "kind", "payload", "digest", "uri", "refers_to").mapInArrow(build, "value binary")
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records and gaps of the files below a path; without ``payloads`` only their sizes and digests.

    A gap is a row with a ``gap_reason`` and no record fields. One file is held at a time in a task,
    at most 2 GB by Spark's own limit. No file or an empty file gives no rows.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, held, after_gap = [], 0, False
                name = batch.column(0)[k].as_py()
                for begins, ends, fields, block, reason in salvage(batch.column(1)[k].as_py()):
                    if fields is None:
                        rows.append((name, begins, ends, *[None] * 9, reason))
                        after_gap = True
                        continue
                    rows.append((
                        name, begins, ends, fields.get("warc-record-id", "").strip("<>"), fields.get("warc-type"),
                        fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
                        fields.get("warc-target-uri"), fields.get("warc-payload-digest", "").partition(":")[2] or None,
                        len(block), hashlib.sha256(block).hexdigest(), block if payloads else None, after_gap, None,
                    ))
                    after_gap, held = False, held + len(block) * payloads
                    if held >= 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(parse, RECORD_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def resolve_pages(records: DataFrame) -> DataFrame:
    """Payload size and digest per record; a revisit takes them from the record it refers to.

    The records are read several times: hand in a written table, without payloads.
    """

    def page(urn):
        return F.nullif(F.split_part(urn, F.lit(":"), F.lit(3)), F.lit("none")).cast("bigint")

    found = records.where(F.col("gap_reason").isNull())
    stored = found.where("record_type = 'response'").select(
        F.col("record_id"), F.lit(None).cast("string").alias("refers_to"),
        "payload_bytes", F.col("block_digest").alias("payload_digest"),
    )
    firsts = stored.groupBy(F.col("record_id").alias("refers_to")).agg(
        F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest")
    )
    again = join_spread(
        found.where("record_type = 'revisit'").select("record_id", "refers_to"), firsts, ["refers_to"], "left"
    ).select("record_id", "refers_to", "payload_bytes", "payload_digest")
    return stored.unionByName(again).select(
        page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest",
        F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"),
        page(F.col("refers_to")).alias("refers_to"),
    )
