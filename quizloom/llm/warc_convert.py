"""Legacy archive converter: ARC files in, WARC files out, both read as streams of lines.

ARC version 1 names a record by ``URL IP date type length``, version 2 by ``URL IP date type
status checksum location offset file length``; which one holds is said by the ``filedesc``
record at a file's head.  The parser takes the fields from the right (old crawlers left
blanks in URLs), reads the declared number of bytes, and makes up what WARC wants and ARC
lacks: record id, ISO date, record type, digests.

Files are written by Spark's text writer with the record separator as line separator, so
every file system and commit protocol of Spark serves, and read by its text reader, so a
record is the most that a task holds.  gzip files are not split, which keeps records whole.

Of the records with one payload digest and at least ``least`` bytes one stays a response (the
largest id, then the last one in the archives), others become revisits.  Digests are counted
with partial aggregation; the payloads are not part of that shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.llm.common import forget_at_end, prepare, scratch_folder, stored

LEAST = 1000
CRAWL_DATE = "19960401120000"
#: HTTP header that carries a page's id through the archives.
ID_HEADER = "X-Page-Id"
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def write_arc(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write an ARC record for each row: version 1 and 2 by turns, one version a file.

    Null html gives an empty payload, a null id no id header, a null url ``-``.  White space in
    a URL is percent-encoded.
    """
    body = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    size = F.octet_length(body)
    head = F.concat(
        F.lit("HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        F.coalesce(F.concat(F.lit(f"{ID_HEADER}: "), F.col(f"`{id}`").cast("string"), F.lit("\r\n")), F.lit("")),
        F.concat(F.lit("Content-Length: "), size.cast("string"), F.lit("\r\n\r\n")))
    target = F.coalesce(F.regexp_replace(F.col(f"`{url}`"), r"\s", "%20"), F.lit("-"))
    target = F.when(target == "", F.lit("-")).otherwise(target)
    second = F.spark_partition_id() % 2 == 1
    middle = F.when(second, F.lit(" 200 - - 0 - ")).otherwise(F.lit(" "))
    length = (F.octet_length(head) + size).cast("string")
    record = F.concat(target, F.lit(f" 0.0.0.0 {CRAWL_DATE} text/html"), middle, length, F.lit("\n"), head, body)

    def opening(version: int) -> str:
        names = ["URL IP-address Archive-date Content-type Archive-length",
                 "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"]
        block = f"{version} 0 crawl\n{names[version - 1]}\n"
        fields = " 200 - - 0 -" if version == 2 else ""
        return f"filedesc://crawl.arc 0.0.0.0 {CRAWL_DATE} text/plain{fields} {len(block)}\n{block}\n"

    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    row = F.when(first, F.concat(F.when(second, F.lit(opening(2))).otherwise(F.lit(opening(1))), record)).otherwise(record)
    pages.select(row.alias("value")).write.option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("line"),
                                                                F.input_file_name().alias("path"))


def _records(batches, read_head):
    """(path, ordinal, head, block) of each record.  read_head(lines) -> (head, length), or None to read on."""
    path, ordinal, lines, head, parts, need = None, 0, [], None, [], 0
    for b in batches:
        for line, where in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if where != path:
                path, ordinal, lines, head = where, 0, [], None
            if head is None:
                if not lines and not line.strip():
                    continue
                lines.append(line)
                got = read_head(lines)
                if got is None:
                    continue
                (head, need), parts, lines = got, [], []
                if need:
                    continue
            else:
                parts += (line, b"\n")
                need -= len(line) + 1
                if need > 0:
                    continue
            block = b"".join(parts)
            yield path, ordinal, head, block[:len(block) + need] if need < 0 else block
            ordinal, head = ordinal + 1, None


def _payload(block: bytes) -> tuple[int, dict[str, str]]:
    """Bytes of an HTTP response's head, and its headers; 0 if it isn't one."""
    end = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or end < 0:
        return 0, {}
    rows = (x.split(b":", 1) for x in block[:end].split(b"\r\n")[1:] if b":" in x)
    return end + 4, {k.strip().decode("latin-1").lower(): v.strip().decode("latin-1") for k, v in rows}


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d{1,18}", text) else None


_ARC = ("path string, ordinal long, record_id string, id long, type string, url string, ip string, date string, "
        "mime string, head_bytes int, payload_bytes long, digest string")


def arc_records(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """The records of gzip ARC files (version by their ``filedesc``): one row each, with what WARC
    wants made up; ``blocks``: with the record's bytes.  A head that can't be read is an error."""
    def run(batches):
        version = {}

        def head(lines):
            line = lines[0].rstrip(b"\r")
            many = 10 if version.get("now") == 2 else 5
            if line.startswith(b"filedesc://"):
                many = 10 if len(line.split(b" ")) >= 10 else 5
            fields = line.rsplit(b" ", many - 1)
            if len(fields) != many or not fields[-1].isdigit():
                raise ValueError(f"not an ARC record head: {line[:200]!r}")
            return fields, int(fields[-1])

        def watched():
            for where, ordinal, fields, block in _records(batches, head):
                if fields[0].startswith(b"filedesc://"):
                    version["now"] = 2 if block[:1] == b"2" else 1
                else:
                    yield where, ordinal, fields, block

        rows: list[tuple] = []
        held = 0
        for where, ordinal, fields, block in watched():
            n, headers = _payload(block)
            digest = hashlib.sha1(memoryview(block)[n:]).digest()
            url, ip, date, mime = (f.decode("utf-8", "replace") for f in fields[:4])
            d = date.ljust(14, "0")
            name = uuid.uuid5(uuid.NAMESPACE_URL, f"{where}#{ordinal} {url} {date}")
            rows.append((where, ordinal, f"<urn:uuid:{name}>", _number(headers.get(ID_HEADER.lower())),
                         "response" if n else "resource", None if url == "-" else url, ip,
                         f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z", mime, n, len(block) - n,
                         base64.b32encode(digest).decode(), *([block] if blocks else [])))
            held += len(block)
            if len(rows) >= 4096 or held > 8 << 20:
                yield _batch(rows, schema)
                rows, held = [], 0
        if rows:
            yield _batch(rows, schema)

    ddl = _ARC + (", block binary" if blocks else "")
    schema = _arrow(ddl)
    return _lines(prepare(spark), path).mapInArrow(run, ddl)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(","))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, least: int = LEAST) -> None:
    """Convert the ARC files below ``arc_path`` to gzip WARC files; no input records give no records.

    A file is one gzip stream, as Spark writes it, not a member for each record.
    """
    light = stored(arc_records(spark, arc_path, blocks=False)
                   .where((F.col("payload_bytes") >= least) & (F.col("type") == "response"))
                   .select("path", "ordinal", "record_id", "id", "url", "date", "digest"))
    order = F.struct(F.coalesce("id", F.lit(-(1 << 63)).cast("long")), "path", "ordinal")
    chosen = light.groupBy("digest").agg(F.count("*").alias("n"), F.max_by(
        F.struct("record_id", "url", "date"), order).alias("first")).where("n > 1")
    again = stored(light.join(chosen, "digest").where(F.col("record_id") != F.col("first.record_id"))
                   .select("path", "ordinal", "first"))  # its size tells Spark whether to broadcast it
    rows = arc_records(spark, arc_path).join(again, ["path", "ordinal"], "left")
    revisit = F.col("first").isNotNull()
    block = F.when(revisit, F.substring(F.col("block"), F.lit(1), F.col("head_bytes"))).otherwise(F.col("block"))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    kind = F.when(F.col("type") == "response", F.lit("application/http; msgtype=response")).otherwise(F.col("mime"))
    head = F.concat(
        F.lit("WARC/1.0\r\n"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.col("type"))),
        line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.col("date")), line("WARC-Target-URI", F.col("url")),
        line("WARC-IP-Address", F.col("ip")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Refers-To", F.col("first.record_id")), line("WARC-Refers-To-Target-URI", F.col("first.url")),
        line("WARC-Refers-To-Date", F.col("first.date")), line("WARC-Profile", F.when(revisit, F.lit(REVISIT))),
        line("Content-Type", kind), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"))
    rows.select(F.concat(head.cast("binary"), block).cast("string").alias("value")).write.option(
        "lineSep", "\r\n\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(warc_path)


_WARC = ("record_id string, type string, url string, date string, refers_to string, id long, payload_bytes long, "
         "payload_digest string")


def warc_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of gzip WARC files: one row each; for a revisit payload_bytes and payload_digest
    (``sha1:`` and base 32) are those its head states, else those of the payload read.
    ``payloads``: with the payload's bytes (null for a revisit)."""
    def head(lines):
        if lines[-1] not in (b"\r", b""):
            return None
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"not a WARC record head: {lines[0][:200]!r}")
        fields = {k.strip().lower(): v.strip() for k, v in (
            x.decode("utf-8", "replace").split(":", 1) for x in lines[1:-1] if b":" in x)}
        return fields, int(fields["content-length"])

    ddl = _WARC + (", payload binary" if payloads else "")
    schema = _arrow(ddl)

    def run(batches):
        rows: list[tuple] = []
        held = 0
        for _, _, fields, block in _records(batches, head):
            n, headers = _payload(block)
            kind = fields.get("warc-type")
            if kind == "revisit":
                size, digest, payload = _number(headers.get("content-length")), fields.get("warc-payload-digest"), None
            else:
                payload = block[n:]
                size, digest = len(payload), "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if fields.get("warc-payload-digest", digest) != digest:
                    raise ValueError(f"payload of {fields.get('warc-record-id')} differs from its digest")
            rows.append((fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-date"),
                         fields.get("warc-refers-to"), _number(headers.get(ID_HEADER.lower())), size, digest,
                         *([payload] if payloads else [])))
            held += len(block) if payloads else 0
            if len(rows) >= 4096 or held > 8 << 20:
                yield _batch(rows, schema)
                rows, held = [], 0
        if rows:
            yield _batch(rows, schema)

    return _lines(prepare(spark), path).mapInArrow(run, ddl)


def op7_warc_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: pages to ARC, ARC to WARC, and what the WARC files say, page by page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    arc, warc = scratch_folder(prepare(spark), "arc"), scratch_folder(spark, "warc")
    write_arc(pages, arc)
    arc_to_warc(spark, arc, warc)
    forget_at_end(spark, arc)
    forget_at_end(spark, warc)
    found = stored(warc_records(spark, warc))
    target = found.where("type = 'response' AND payload_bytes >= 1000").select(
        F.col("record_id").alias("refers_to"), F.col("id").alias("target"))
    return found.join(target, "refers_to", "left").select(
        F.col("id").alias("page_id"), "payload_bytes", _base32_hex(F.substring("payload_digest", 6, 32)).alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("target").alias("refers_to"))


def _base32_hex(text: Column) -> Column:
    """Lower-case hex of 32 base-32 characters, by eights: 40 bits, ten hex digits."""
    digits = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV")
    return F.concat(*[F.lower(F.lpad(F.conv(F.substring(digits, 1 + 8 * i, 8), 32, 16), 10, "0")) for i in range(4)])


#: DuckDB: the largest page of each payload is the response.
OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
d AS (SELECT page_id, CAST(n AS BIGINT) AS n, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n AS payload_bytes, s AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to FROM d
"""
