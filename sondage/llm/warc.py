"""WARC archives with revisit records.

Headers (digest, length, page id, url) are shuffled by payload digest; the page with the largest id of each repeated payload keeps the response record, the others become revisit records that name it. Revisit records are made of headers alone. Payloads stay where they are read: a key filter of the revisits tells almost all pages that are responses from the others, and only the pages of its false alarms are joined to be sure. Archives are written by Spark's text sink, whose line separator is the record separator of WARC, and read back as a stream of the pieces between separators, one record at a time. Revisits are resolved by a join on record ids.
"""

from __future__ import annotations

import datetime
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import key_filter, materialize, pack, scratch_dir, shuffle_cleanup, slices

_END = "\r\n"


def _record_id(page_id: Column, digest: Column) -> Column:
    """One id for each page id and payload, so that pages that repeat an id are told apart."""
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("-")), F.lit(":"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(kind: str, date: str, *, html: Column | None = None) -> Column:
    """The text of a record from the columns page_id, url, bytes, digest, and first_id, first_url for a revisit."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.col("bytes").cast("string"), F.lit(_END * 2))
    fields = [
        F.lit(f"WARC/1.1{_END}WARC-Type: {kind}{_END}WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("digest")), F.lit(f"{_END}WARC-Date: {date}{_END}WARC-Target-URI: "), F.col("url"),
        F.lit(f"{_END}WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(f"{_END}X-Page-Id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.lit(_END),
    ]
    if html is None:
        fields += [F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{_END}WARC-Refers-To: "), _record_id(F.col("first_id"), F.col("digest")), F.lit(f"{_END}WARC-Refers-To-Target-URI: "), F.col("first_url"), F.lit(_END)]
    size = F.octet_length(http) + (F.lit(0) if html is None else F.col("bytes"))
    fields += [F.lit(f"Content-Type: application/http; msgtype=response{_END}Content-Length: "), size.cast("string"), F.lit(_END * 2), http]
    return F.concat(*fields, *([] if html is None else [html]))


def write_warc(pages: DataFrame, path: str, *, least: int = 1000, date: str | None = None, records_per_file: int = 20_000) -> None:
    """One record per row of ``pages`` (page_id, url, html), gzip files under ``path``; a file is compressed as a whole.

    Payloads of at least ``least`` bytes that are equal (by SHA-1 and length) share the response with the largest page_id; the rest are revisits. ``date`` is that of all records, by default the time of the call. Null html is an empty payload, a null url an empty one, and line ends in a url are percent-escaped. Rows that repeat the largest id of their payload are responses each; a null id, or one that is no whole number, is a response. An empty table writes no records. Other columns are not read.
    """
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    sized = lambda df: df.withColumns({"bytes": F.octet_length("html").cast("long"), "digest": F.sha1(F.col("html"))})
    plain, rows = rows, sized(rows)
    headers = materialize(rows.filter(F.col("bytes") >= least).select("page_id", "url", "bytes", "digest"), "warc-headers")
    originals = headers.groupBy("digest", "bytes").agg(F.max_by("url", "page_id").alias("first_url"), F.max("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisits = materialize(headers.join(originals, ["digest", "bytes"]).filter("page_id < first_id"), "warc-revisits")

    # by page id and digest a page is a revisit or not: what the filter doesn't hold is a response
    key = [F.col("page_id"), F.col("digest")]
    may_revisit = key_filter(revisits, *key)
    alarms = may_revisit(headers, *key).filter("_may_hold").select("page_id", "digest").distinct()
    alarms = materialize(alarms.join(revisits.select("page_id", "digest"), ["page_id", "digest"], "left_anti"), "warc-alarms")
    columns = ["page_id", "url", "bytes", "digest", "html"]
    responses = may_revisit(rows, *key).filter((F.col("bytes") < least) | ~F.col("_may_hold")).select(*columns)
    # few pages have the id of an alarm: only theirs are digested again
    checked = sized(key_filter(alarms, F.col("page_id"))(plain, F.col("page_id")).filter("_may_hold")).filter(F.col("bytes") >= least).join(alarms, ["page_id", "digest"], "left_semi").select(*columns)
    records = responses.unionByName(checked).select(_record("response", date, html=F.col("html")).alias("value")).unionByName(revisits.select(_record("revisit", date).alias("value")))
    with shuffle_cleanup(pages.sparkSession):
        records.write.option("compression", "gzip").option("lineSep", _END * 2).option("maxRecordsPerFile", records_per_file).text(path)


_INDEX = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to_record", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def parse_records(pieces: Iterable[bytes]) -> Iterator[dict]:
    """The records of archives, from the pieces between blank lines (CR LF CR LF) in order; a response's digest is that of the payload that was read."""
    pieces = iter(pieces)
    for head in pieces:
        fields = dict(line.split(b": ", 1) if b": " in line else (line.rstrip(b":"), b"") for line in head.split(b"\r\n")[1:])
        size, parts = int(fields[b"Content-Length"]), [next(pieces)]
        have = len(parts[0])
        while have < size:
            parts.append(next(pieces))
            have += 4 + len(parts[-1])
        http, payload = parts[0], b"\r\n\r\n".join(parts[1:])
        declared, is_response = fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode(), fields[b"WARC-Type"] == b"response"
        digest = hashlib.sha1(payload).hexdigest() if is_response else declared
        if digest != declared or have != size:
            raise ValueError(f"{fields[b'WARC-Record-ID']!r}: digest or length does not match the payload")
        key = fields[b"X-Page-Id"]
        yield {"page_id": None if key == b"-" else int(key), "record_id": fields[b"WARC-Record-ID"].decode(), "record_type": fields[b"WARC-Type"].decode(), "refers_to_record": fields[b"WARC-Refers-To"].decode() if b"WARC-Refers-To" in fields else None, "url": fields[b"WARC-Target-URI"].decode(), "payload_bytes": len(payload) if is_response else int(http.rpartition(b"Content-Length: ")[2]), "payload_digest": digest, "payload": payload if is_response else None}


def read_warc(spark: SparkSession, path: str, *, payloads: bool = False) -> DataFrame:
    """Records of the archives under ``path``, without payloads unless asked for. A task reads its archives as a stream; it holds one record, and a batch of results."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {f.name: [] for f in _INDEX}
        held = 0
        pieces = (piece for batch in slices(batches, "value", 1 << 20) for piece in batch.column("value").cast(pa.binary()).to_pylist())
        for record in parse_records(pieces):
            for name, value in record.items():
                out[name].append(value if payloads or name != "payload" else None)
            held += record["payload_bytes"] if payloads else 0
            if len(out["page_id"]) >= 5000 or held > 8 << 20:
                yield pack(out, _INDEX)
                out, held = {f.name: [] for f in _INDEX}, 0
        yield pack(out, _INDEX)

    pieces = spark.read.option("lineSep", _END * 2).option("pathGlobFilter", "part-*").text(path)
    return pieces.mapInArrow(parse, "page_id long, record_id string, record_type string, refers_to_record string, url string, payload_bytes long, payload_digest string, payload binary")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Each record with ``refers_to``: the page id of the response that a revisit names, else null. A revisit takes length and digest from that response. Responses with one record id have one page id and payload."""
    records = records.select("page_id", "record_id", "record_type", "refers_to_record", "payload_bytes", "payload_digest")
    first = records.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_record")).agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("first_bytes"), F.min("payload_digest").alias("first_digest"))
    first = materialize(first, "warc-responses")
    joined = records.join(first, "refers_to_record", "left")
    return joined.select("page_id", F.coalesce("first_bytes", "payload_bytes").alias("payload_bytes"), F.coalesce("first_digest", "payload_digest").alias("payload_digest"), "record_type", "refers_to")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write archives into the shared folder, read them back and resolve the revisits."""
    spark = pages.sparkSession
    path = scratch_dir(spark, "warc")
    write_warc(pages, path, **options)
    return resolve_revisits(materialize(read_warc(spark, path).drop("payload"), "warc-index"))
