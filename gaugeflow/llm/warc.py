"""WARC archives as a table of record chunks.

``write_archive`` turns pages into WARC/1.1 records and writes them with Spark's text sink as
gzipped archives. A payload that repeats an earlier one (equal bytes, at least ``REVISIT_BYTES``)
becomes a revisit record without payload, of the identical-payload-digest profile. A payload longer
than ``CHUNK_BYTES`` is cut by Spark into rows of (record identifier, chunk number), each a WARC
segment (a continuation record) of its own that carries the SHA-1 of the payload so far: Python
sees chunks only, and neither writing nor reading joins the chunks of such a record in memory.
``read_archive`` reads archives back into the chunk table, and ``records`` digests it, following the
chunks of a record in order with one incremental hash.

Archives of other writers are read too: records of WARC/1.0 and 1.1, field names in any case,
segments by their standard fields. Blocks are digested as they stand (an HTTP head is part of the
block), page_id and refers_to are null, and each record is one chunk unless it was segmented. A
block that holds an empty line followed by ``WARC/1.`` can't be told from two records: it raises.

Null payloads count as empty, empty payloads are responses, a null page_id stays null, rows that
repeat a page_id are records each, and columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm.common import batches_of, scratch_path
from gaugeflow.llm.sketch import bind

CHUNK_BYTES = 64 * 1024
REVISIT_BYTES = 1000
#: Bytes of chunks that a Python worker receives at once.
BATCH_BYTES = 4 << 20
CRLF = "\r\n"
#: How a record begins, whatever the minor version.
START = "WARC/1."
#: What stands between two records: the end of one and how the next begins.
BETWEEN = CRLF * 2 + START
#: Every place within the name of the version: a cut there leaves no chunk that reads like the start of a record.
WITHIN_START = r"(?<=WA)(?=RC/1\.)"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_RECORDS = 50_000

HEAD = ["page_id", "uri", "record_type", "refers_to", "refers_to_uri", "payload_bytes", "payload_digest", "record_id"]
_HEAD = [("page_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("refers_to_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_id", pa.string())]
_SCHEMA = pa.schema([*_HEAD, ("chunk_no", pa.int32()), ("total_bytes", pa.int64()), ("prefix_digest", pa.string()), ("chunk", pa.binary())])
SEGMENTS = "page_id long, uri string, record_type string, refers_to long, refers_to_uri string, payload_bytes long, payload_digest string, record_id string, chunk_no int, total_bytes long, prefix_digest string, chunk binary"


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the chunks of each record and gives each the digest of the payload so far; holds one hash."""
    record, number, seen = None, 0, hashlib.sha1()
    for batch in batches:
        numbers, digests = [], []
        for name, chunk in zip(batch.column("record_id"), batch.column("chunk"), strict=True):
            if name.as_py() != record:
                record, number, seen = name.as_py(), 0, hashlib.sha1()
            seen.update(chunk.as_buffer())
            numbers.append(number)
            digests.append(seen.hexdigest())
            number += 1
        made = {"chunk_no": pa.array(numbers, pa.int32()), "prefix_digest": pa.array(digests, pa.string())}
        yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else batch.column(f.name).cast(f.type) for f in _SCHEMA], schema=_SCHEMA)


def _decided(pages: DataFrame, revisit_bytes: int) -> DataFrame:
    """``pages`` with the record type of each.

    Which record is the response of a payload is decided on narrow rows (page, digest, uri); only the
    revisits among them meet the payloads again, by page and digest, so that copies of one payload
    aren't sent to one task.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    uri = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))))
    safe = F.when(uri.rlike(r"^[\x21-\x7E]*$"), uri).otherwise(F.url_encode(uri))
    place = F.coalesce(F.col("page_id").cast("long"), F.xxhash64("url"))
    narrow = [F.col("page_id").cast("long").alias("page_id"), safe.alias("uri"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("payload_digest"), place.alias("place")]
    heads = pages.select(*narrow).where(F.col("payload_bytes") >= revisit_bytes)
    responses = heads.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.max_by("uri", "page_id").alias("refers_to_uri"), F.count("*").alias("copies"))
    responses = responses.where((F.col("copies") > 1) & F.col("refers_to").isNotNull()).drop("copies")
    later = F.col("page_id").isNull() | (F.col("page_id") < F.col("refers_to"))
    missing = F.col("page_id").isNull().alias("missing")
    revisits = heads.select("place", "payload_digest", "page_id").distinct().join(responses, "payload_digest").where(later).select("place", missing, "payload_digest", "refers_to", "refers_to_uri")
    rows = pages.select(*narrow, html.alias("html")).select("*", missing).join(revisits, ["place", "missing", "payload_digest"], "left")
    kind = F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response")
    return rows.select("*", kind.alias("record_type"), F.expr("uuid()").alias("record_id")).select(*HEAD, "html")


def segments(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, revisit_bytes: int = REVISIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """The chunk table of ``pages`` in two parts: records of one chunk (``chunk_no`` null), and those that are streamed."""
    rows, own = _decided(pages, revisit_bytes), F.col("record_type") == "response"
    marked = F.col("html").contains(START)
    streamed = own & ((F.col("payload_bytes") > chunk_bytes) | marked)
    body = F.when(own, F.col("html")).otherwise(F.lit("")).cast("binary")
    none = F.lit(None)
    whole = rows.where(~streamed).select(*HEAD, none.cast("int").alias("chunk_no"), none.cast("long").alias("total_bytes"), none.cast("string").alias("prefix_digest"), body.alias("chunk"))
    pieces = F.when(marked, F.split("html", WITHIN_START, -1)).otherwise(F.array("html"))
    cut = rows.where(streamed).select(*HEAD, F.size(pieces).alias("n_pieces"), F.posexplode(pieces).alias("piece_no", "piece"))
    last = F.greatest(F.lit(0), F.floor((F.octet_length("piece") - 1) / chunk_bytes).cast("int"))
    # the array is cut once and exploded alone, so that each byte is copied a fixed number of times, however long the piece
    slices = bind(F.col("piece").cast("binary"), lambda whole_piece: F.transform(F.sequence(F.lit(0), last), lambda i: whole_piece.substr(i * chunk_bytes + 1, F.lit(chunk_bytes))))
    cut = cut.select(*HEAD, "n_pieces", "piece_no", last.alias("last_no"), F.posexplode(slices).alias("slice_no", "chunk"))
    ends = (F.col("piece_no") == F.col("n_pieces") - 1) & (F.col("slice_no") == F.col("last_no"))
    return whole, cut.select(*HEAD, F.when(ends, F.col("payload_bytes")).alias("total_bytes"), "chunk").mapInArrow(_running, SEGMENTS)


def _header(*fields: tuple[str, Column]) -> Column:
    """The fields that have a value, a line each."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit("")) for name, value in fields])


def _urn(record_id: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), record_id, F.lit(">"))


def write_archive(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Writes gzipped WARC archives of at most ``ARCHIVE_RECORDS`` records each under ``path``.

    A page without a URL gets ``urn:page:`` and its id as target; all records carry the time of the call.
    """
    c, now = F.col, F.lit(datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))
    later, revisit = c("chunk_no") > 0, c("record_type") == "revisit"
    mixed = F.md5(F.concat_ws("/", "record_id", "chunk_no"))
    own_id = F.when(later, F.regexp_replace(mixed, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")).otherwise(c("record_id"))
    header = F.concat(
        F.lit(START + "1" + CRLF),
        _header(
            ("WARC-Type", F.when(later, "continuation").otherwise(c("record_type"))), ("WARC-Record-ID", _urn(own_id)), ("WARC-Date", now), ("WARC-Target-URI", c("uri")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), c("payload_digest"))), ("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1("chunk"))),
            ("WARC-Profile", F.when(revisit, PROFILE)), ("WARC-Refers-To-Target-URI", c("refers_to_uri")), ("WARC-Refers-To-Date", F.when(revisit, now)),
            ("WARC-Segment-Number", c("chunk_no") + 1), ("WARC-Segment-Origin-ID", F.when(later, _urn(c("record_id")))), ("WARC-Segment-Total-Length", c("total_bytes")),
            ("Content-Type", F.when(~F.coalesce(later, F.lit(False)), "text/html")), ("Content-Length", F.octet_length("chunk")),
            ("X-Page", c("page_id")), ("X-Refers-To-Page", c("refers_to")), ("X-Payload-Length", c("payload_bytes")), ("X-Digest-So-Far", c("prefix_digest")),
        ),
        F.lit(CRLF),
    )
    with batches_of(pages.sparkSession, BATCH_BYTES):
        whole, streamed = segments(pages, chunk_bytes, revisit_bytes)
        lines = whole.unionByName(streamed).select(F.concat(header.cast("binary"), c("chunk"), F.lit(CRLF).cast("binary")).cast("string").alias("value"))
        lines.write.option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of the archives under ``path``; blocks come back byte by byte as their headers measure them.

    ``chunk_no`` is null where a record isn't segmented; ``record_id`` is that of the first segment.
    """
    raw = spark.read.option("lineSep", BETWEEN).text(path)  # a row starts at its minor version; the first of a file with its whole version line
    raw = raw.where(F.octet_length("value") > 0)
    head = F.substring_index("value", CRLF * 2, 1)
    field = lambda name: F.nullif(F.regexp_extract("head", f"(?i)\\n{name}: *([^\\r]*)", 1), F.lit(""))
    number = lambda name, kind="long": field(name).cast(kind)
    rows = raw.select(head.alias("head"), F.col("value").cast("binary").alias("raw"))
    rows = rows.select("*", number("Content-Length", "int").alias("block_bytes"))
    block = F.col("raw").substr(F.octet_length("head") + 5, F.col("block_bytes"))
    broken = F.raise_error(F.concat(F.coalesce(field("WARC-Record-ID"), F.lit("a record")), F.lit(": its block isn't as long as its header says")))
    whole = F.when(F.octet_length(block) == F.col("block_bytes"), block).otherwise(broken.cast("binary"))
    origin = F.coalesce(field("WARC-Segment-Origin-ID"), field("WARC-Record-ID"))
    return rows.select(
        number("X-Page").alias("page_id"), field("WARC-Target-URI").alias("uri"), field("WARC-Type").alias("record_type"), number("X-Refers-To-Page").alias("refers_to"), number("X-Payload-Length").alias("payload_bytes"), F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        origin.alias("record_id"), (number("WARC-Segment-Number", "int") - 1).alias("chunk_no"), number("WARC-Segment-Total-Length").alias("total_bytes"), field("X-Digest-So-Far").alias("prefix_digest"), whole.alias("chunk"),
    )


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order of (record_id, chunk_no) to a row per record; holds one hash, never a payload."""
    record, seen, size, first, total, number = None, hashlib.sha1(), 0, {}, None, 0

    def done() -> list[dict]:
        if record is None:
            return []
        if total != size:
            raise ValueError(f"{record}: its last chunk is missing")
        kept = {name: first[name] for name in ("page_id", "record_type", "refers_to")}
        return [kept | {"payload_bytes": size, "payload_digest": seen.hexdigest()}]

    for batch in batches:
        out = []
        chunks = batch.column("chunk")
        for at, row in enumerate(batch.drop_columns(["chunk"]).to_pylist()):
            if row["record_id"] != record:
                out += done()
                record, seen, size, first, total, number = row["record_id"], hashlib.sha1(), 0, row, None, 0
            if row["chunk_no"] != number:
                raise ValueError(f"{record}: chunk {number} is missing or stands twice")
            piece = chunks[at].as_buffer()
            seen.update(piece)
            size += len(piece)
            number += 1
            total = row["total_bytes"]
            if row["prefix_digest"] is not None and seen.hexdigest() != row["prefix_digest"]:
                raise ValueError(f"{record}: chunk {row['chunk_no']} differs from its digest")
        yield pa.RecordBatch.from_pylist(out, schema=_RECORD)
    yield pa.RecordBatch.from_pylist(done(), schema=_RECORD)


_RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def records(chunks: DataFrame) -> DataFrame:
    """A row per record, digested from the bytes that were read; a revisit has length and digest of the payload it names."""
    single = chunks.where(F.col("chunk_no").isNull())
    own = F.col("record_type") != "revisit"
    whole = single.select("page_id", F.when(own, F.octet_length("chunk").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(own, F.sha1("chunk")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")
    several = chunks.where(F.col("chunk_no").isNotNull()).select("page_id", "record_type", "refers_to", "record_id", "chunk_no", "total_bytes", "prefix_digest", "chunk")
    return whole.unionByName(several.repartition("record_id").sortWithinPartitions("record_id", "chunk_no").mapInArrow(_follow, RECORDS))


def round_trip(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes the archives of ``pages`` to the shared folder and reads their records back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archive(pages, path, chunk_bytes, revisit_bytes)
    return records(read_archive(spark, path))


__all__ = ["write_archive", "read_archive", "records", "round_trip", "segments"]
