"""WARC archives: writing with segments and chunked framing, reading with segment reassembly.

A response larger than ``segment_bytes`` is cut: the first segment is the response record, the others are
continuation records that name its identifier, their number, and, the last, the total length. Reading
groups segments by origin identifier, orders them by number, verifies that none is missing and that the
lengths add up, and then decodes the HTTP message and its chunked transfer framing.

Of pages with equal payloads, that of smallest page_id is written as response, the others as revisit
records that refer to it and hold no payload.

Nulls and ties: a null payload is empty. Pages without page_id are always responses. Repeated rows of a
page are written as often as they occur; those of the smallest page_id are all responses. Empty tables
make empty archives. Further columns are not written.
"""

from __future__ import annotations

import base64
import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from diarist.scratch import materialize
from llm import text as T

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
END = "\r\n\r\n"
RECORD = (
    "record_id string, type string, origin_id string, segment int, total_length long, refers_to string, uri string, "
    "payload_digest string, declared long, block binary"
)
DECODED = "complete boolean, payload binary, payload_bytes long, found_digest string"
PAYLOAD = f"record_id string, type string, refers_to string, uri string, payload_digest string, {DECODED}"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    """A message body in chunked framing."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> tuple[bytes, bool]:
    """The framed message, and whether the framing was whole. Extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            return b"".join(parts), False
        try:
            size = int(body[at:line].split(b";")[0].strip(), 16)
        except ValueError:
            return b"".join(parts), False
        if size == 0:
            return b"".join(parts), True
        piece = body[line + 2 : line + 2 + size]
        parts.append(piece)
        at = line + 2 + size + 2
        if len(piece) < size or body[at - 2 : at] != b"\r\n":
            return b"".join(parts), False


def _record(kind: str, record_id: str, block: bytes, **more) -> bytes:
    fields = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": "1970-01-01T00:00:00Z", **more}
    fields["Content-Length"] = len(block)
    lines = [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block


def _field(value: str | None) -> str | None:
    """A header value on one line."""
    return None if value is None else " ".join(value.split())


def page_records(name: str, uri, payload: bytes, digest: str, refers_to, segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    """The records of one page, without the blank lines between records."""
    own = f"<urn:x-page:{name}>"
    common = {"WARC_Target_URI": _field(uri), "WARC_Payload_Digest": f"sha1:{digest}"}
    kind = "application/http; msgtype=response"
    if refers_to is not None:
        return [_record(
            "revisit", own, HTTP + b"\r\n", **common, Content_Type=kind, WARC_Refers_To=f"<urn:x-page:{refers_to}>",
            WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        )]
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        return [_record("response", own, block, **common, Content_Type=kind)]
    pieces = [block[a : a + segment_bytes] for a in range(0, len(block), segment_bytes)]
    out = [_record("response", own, pieces[0], **common, Content_Type=kind, WARC_Segment_Number=1)]
    for i, piece in enumerate(pieces[1:], 2):
        out.append(_record(
            "continuation", f"<urn:x-page:{name}:segment:{i}>", piece, WARC_Segment_Origin_ID=own, WARC_Segment_Number=i,
            WARC_Segment_Total_Length=len(block) if i == len(pieces) else None,
        ))
    return out


def write_archives(pages: DataFrame, path: str, segment_bytes: int = 16_384, chunk_bytes: int = 4096,
                   records_per_file: int = 500) -> None:
    """Gzipped WARC files of at most ``records_per_file`` records, so of bounded size, in the folder ``path``."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digest = F.sha1(payload)
    narrow = pages.select("page_id", digest.alias("sha1"))
    first = narrow.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = narrow.join(first, "sha1").where("page_id != first").select("page_id", "sha1", "first").distinct()
    keyed = pages.select("page_id", "url", payload.alias("payload"), digest.alias("sha1"))
    repeat = Window.partitionBy("page_id", "sha1").orderBy("url")
    rows = keyed.join(revisits, ["page_id", "sha1"], "left").withColumn("repeat", F.row_number().over(repeat))

    def records(batches):
        for part in (p for b in batches for p in T.slices(b, "payload", 4 << 20)):
            made = []
            for row in part.to_pylist():
                digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                name = f"none-{digest}" if row["page_id"] is None else str(row["page_id"])
                name += f":{row['repeat']}" if row["repeat"] > 1 else ""
                made += page_records(name, row["url"], row["payload"], digest, row["first"], segment_bytes, chunk_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])

    rows = rows.select("page_id", "url", "payload", "sha1", "first", "repeat")
    written = rows.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value"))
    out = written.write.option("lineSep", END).option("maxRecordsPerFile", records_per_file)
    out.option("compression", "gzip").text(path)


def plain(content: bytes) -> bytes:
    """An archive without its compression, be it one gzip member or one for each record."""
    return gzip.decompress(content) if bytes(content[:2]) == b"\x1f\x8b" else bytes(content)


def parse_archive(content: bytes):
    """The records of one archive in order, as dicts of RECORD; a record's length is what its header declares."""
    at = 0
    while True:
        at = content.find(b"WARC/", at)
        head = content.find(b"\r\n\r\n", at)
        if at < 0 or head < 0:
            return
        fields = {}
        for line in content[at:head].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        declared = int(fields.get("content-length") or 0)
        own = fields.get("warc-record-id")
        total = fields.get("warc-segment-total-length")
        number = fields.get("warc-segment-number")
        yield {
            "record_id": own, "type": fields.get("warc-type"), "origin_id": fields.get("warc-segment-origin-id", own),
            "segment": int(number) if number else None, "total_length": int(total) if total else None,
            "refers_to": fields.get("warc-refers-to"), "uri": fields.get("warc-target-uri"),
            "payload_digest": (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
            "declared": declared, "block": content[head + 4 : head + 4 + declared],
        }
        at = head + 4 + declared


_DECODED = [("complete", pa.bool_()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("found_digest", pa.string())]
_READ = pa.schema([
    ("record_id", pa.string()), ("type", pa.string()), ("origin_id", pa.string()), ("segment", pa.int32()),
    ("total_length", pa.int64()), ("refers_to", pa.string()), ("uri", pa.string()), ("payload_digest", pa.string()),
    ("declared", pa.int64()), ("block", pa.binary()), *_DECODED,
])
_PAYLOAD = pa.schema([
    ("record_id", pa.string()), ("type", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()),
    ("payload_digest", pa.string()), *_DECODED,
])


def read_records(spark: SparkSession, path: str, part_records: int = 64) -> DataFrame:
    """All records of the archives in a folder, gzipped or not, as RECORD and PAYLOAD's own columns.

    A file is parsed from its beginning, so by one task. Records that aren't cut are decoded at once and
    come without ``block``; segments come with it.
    """

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                held = []
                for record in parse_archive(plain(content.as_buffer())):
                    if record["segment"] is None:
                        record |= decoded(record["block"], len(record["block"]) == record["declared"]) | {"block": None}
                    held.append(record)
                    if len(held) == part_records:
                        yield pa.RecordBatch.from_pylist(held, _READ)
                        held = []
                yield pa.RecordBatch.from_pylist(held, _READ)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, f"{RECORD}, {DECODED}")


def decoded(block: bytes, complete: bool) -> dict:
    """What an HTTP message holds."""
    payload, ok = message(block)
    return {"complete": complete and ok, "payload": payload, "payload_bytes": len(payload), "found_digest": digest32(payload)}


def message(block: bytes) -> tuple[bytes, bool]:
    """The payload of an HTTP response, and whether it was whole."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return b"", False
    if any(line.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for line in head.split(b"\r\n")):
        return unchunked(body)
    return body, True


def reassemble(records: DataFrame) -> DataFrame:
    """One row for each record that was cut, from its segments: their origin's columns, and what they hold together.

    ``complete`` says whether all segments were there, with the declared total length. Only segments are
    shuffled, by the identifier of their origin.
    """
    columns = ["type", "refers_to", "uri", "payload_digest"]
    cut = records.where("segment is not null").groupBy(F.col("origin_id").alias("record_id")).agg(
        F.max(F.when(F.col("segment") == 1, F.struct(*columns))).alias("first"),
        F.max("total_length").alias("total"),
        F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("parts"),
    )
    size = F.aggregate("parts", F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x["block"]))
    in_order = F.transform("parts", lambda x: x["segment"]) == F.sequence(F.lit(1), F.size("parts"))
    joined = cut.select(
        "record_id", *(f"first.{c}" for c in columns),
        F.coalesce(F.col("first").isNotNull() & in_order & (size == F.col("total")), F.lit(False)).alias("complete"),
        F.transform("parts", lambda x: x["block"]).alias("blocks"),
    )

    def decode(batches):
        for part in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
            rows = [{c: r[c] for c in ("record_id", *columns)} | decoded(b"".join(r["blocks"]), r["complete"]) for r in part.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, _PAYLOAD)

    return joined.mapInArrow(decode, PAYLOAD)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """PAYLOAD of every record of the archives in a folder, continuations put together with their origin."""
    records = read_records(spark, path)
    names = [f.name for f in _PAYLOAD]
    return records.where("segment is null").select(*names).unionByName(reassemble(records).select(*names))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Per page of archives that write_archives made: payload figures, and the page that a revisit refers to.

    A revisit takes its payload's figures from the response. A payload that is incomplete, or whose
    digest isn't the declared one, has null figures.
    """
    found = read_payloads(spark, path)
    good = F.col("complete") & (F.col("payload_digest") == F.col("found_digest"))
    pattern = r"^<urn:x-page:(\d+|-\d+)(?::\d+)?>$"

    def page(column):
        number = F.regexp_extract(column, pattern, 1)
        return F.when(number != "", number.cast("long"))

    rows = materialize(found.select(
        page("record_id").alias("page_id"), F.col("type").alias("record_type"), page("refers_to").alias("refers_to"),
        F.when(good, F.col("payload_bytes")).alias("payload_bytes"),
        F.when(good, F.col("payload_digest")).alias("payload_digest"),
    ), "pages-read")
    responses = rows.where("record_type = 'response'")
    kept = responses.select(
        F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest")
    ).distinct()
    revisits = rows.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to").join(kept, "refers_to", "left")
    return responses.unionByName(revisits.withColumnsRenamed({"_bytes": "payload_bytes", "_digest": "payload_digest"}))
