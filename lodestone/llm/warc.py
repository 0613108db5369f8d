"""WARC archives: written by Spark's text writer, read back, and assembled.

Each page becomes a capture of three records: the request, the response (or a
revisit that refers to the response with the same payload) and the metadata.
Request and metadata name the response in WARC-Concurrent-To. Reading parses
the records of each file as a stream and joins the records of a capture through
these identifiers into one nested row.

A record ends with two line ends, which is the writer's line separator, so
Spark's own committer writes the archives, in whatever store the folder is.
Payloads move once, when a page is joined with the keeper of its digest; Spark
splits that join where one payload has a third of all rows. Pages are written
in tiers of size, a job for each tier that occurs, with fewer pages to a file
the larger they are: a file, which one task reads, holds FILE_BYTES before
compression, or the records of a single larger page.

The reader takes archives of other writers too (.warc and .warc.gz, with a gzip
member for each record or for all). A record cut short, of no readable length,
or behind damaged compression gives a row of what its fields tell, with intact
false and no payload, and ends its archive. Payloads are bodies as they are
stored: transfer encodings are not undone.

Defined cases: a null payload counts as empty; a null url is left out of the
record; a null page id counts as smallest. Rows repeated in id, url and payload
have the same record ids; each gets its row back, and all rows with the largest
id of a payload are responses. An empty table gives no archive and no rows.
Extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import shared_path, written

FILE_BYTES = 256 << 20
#: Largest bytes of a page in each tier but the last, which has one page a file.
TIERS = (128 << 10, 4 << 20)
END = "\r\n"
#: Rows and payload bytes that the reader passes on at once.
BATCH, BATCH_BYTES = 2000, 8 << 20

RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, page_id bigint, payload_bytes bigint, payload_digest string, intact boolean, payload binary"


def base32_of_hex(digest: Column) -> Column:
    """Base 32 of a SHA-1 given in hexadecimal: five hexadecimal digits are
    four of base 32."""
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(kind: str, capture: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind + ":"), capture))
    dashed = F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">"))


def _record(fields: list[tuple[str, Column | str]], block: Column) -> Column:
    """A record as text, without the separator at its end; null fields are
    left out."""
    lines = [F.lit("WARC/1.1")]
    for name, value in fields:
        lines.append(F.concat(F.lit(name + ": "), value if isinstance(value, Column) else F.lit(value)))
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(END, *lines), F.lit(END * 2), block)


def write_archives(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes the captures of pages to gzipped archives below path. Payloads of
    least_bytes or more are written once, in the response of the largest id."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    plain_url = F.regexp_replace(F.regexp_replace(F.col(url).cast("string"), "\r", "%0D"), "\n", "%0A")
    rows = pages.select(F.col(id).cast("bigint").alias("id"), plain_url.alias("url"), payload.alias("html"))
    # SHA-1 is of the bytes; the length keeps apart what only a forged digest could join
    rows = rows.withColumn("digest", base32_of_hex(F.sha1(F.col("html").cast("binary")))).withColumn("bytes", F.octet_length("html"))
    keepers = rows.filter(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.max(F.struct("id", "url")).alias("keeper"), F.count("*").alias("n"))
    weight = F.col("bytes") + 3 * F.coalesce(F.octet_length("url"), F.lit(0))  # three records name the url
    tier = sum((weight > most).cast("int") for most in TIERS)
    present = {r[0] for r in rows.select(tier.alias("tier")).distinct().collect()} or {0}
    rows = rows.withColumn("tier", tier).join(keepers.filter("n > 1").drop("n"), ["digest", "bytes"], "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper.id"))

    def capture(i: str, u: str) -> Column:
        return F.concat_ws("|", F.coalesce(F.col(i).cast("string"), F.lit("null")), F.col("digest"), F.coalesce(F.col(u), F.lit("null")))

    rows = rows.withColumn("revisit", F.coalesce(revisit, F.lit(False)))
    rows = rows.withColumn("rid", _urn("response", capture("id", "url"))).withColumn("kid", F.when(F.col("revisit"), _urn("response", capture("keeper.id", "keeper.url"))))
    at = [("WARC-Date", date), ("WARC-Target-URI", F.col("url"))]
    host = F.coalesce(F.regexp_extract("url", r"://([^/?#]*)", 1), F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END * 2))
    response = _record(
        [
            ("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
            ("WARC-Record-ID", F.col("rid")),
            *at,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Profile", F.when(F.col("revisit"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("WARC-Refers-To", F.col("kid")),
            ("Content-Type", "application/http;msgtype=response"),
        ],
        F.concat(head, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html"))),
    )
    link = ("WARC-Concurrent-To", F.col("rid"))
    request = _record(
        [("WARC-Type", "request"), ("WARC-Record-ID", _urn("request", F.col("rid"))), *at, link, ("Content-Type", "application/http;msgtype=request")],
        F.concat(F.lit(f"GET / HTTP/1.1{END}Host: "), host, F.lit(END * 2)),
    )
    metadata = _record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", _urn("metadata", F.col("rid"))), *at, link, ("Content-Type", "application/warc-fields")],
        F.concat(F.lit("pageId: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(END)),
    )
    for n in sorted(present):
        pages_a_file = FILE_BYTES // TIERS[n] if n < len(TIERS) else 1
        records = rows.filter(F.col("tier") == n).select(F.explode(F.array(request, response, metadata)).alias("value"))
        records.write.mode("errorifexists" if n == min(present) else "append").option("lineSep", END * 2).option("compression", "gzip").option("maxRecordsPerFile", 3 * pages_a_file).text(path)


def parse(data: bytes) -> Iterator[dict]:
    """The records of an archive, plain or gzipped, one after another, and
    whether each is cut short, which ends the archive."""
    raw = _Members(data) if data[:2] == b"\x1f\x8b" else None
    stream = io.BufferedReader(raw, 1 << 16) if raw else io.BytesIO(data)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue  # what separates records
        fields = _fields(iter(stream.readline, b""))
        size = _number(fields.get("content-length"))
        block = b"" if size is None else _read(stream, size)
        cut = size is None or len(block) < size
        yield {"fields": fields, "block": block, "cut": cut}
        if cut:
            return
    if raw and raw.damaged:
        yield {"fields": {}, "block": b"", "cut": True}


class _Members(io.RawIOBase):
    """What the gzip members of an archive hold, as far as they are sound."""

    STEP = 1 << 14

    def __init__(self, data: bytes):
        self.data, self.at, self.out, self.damaged = data, 0, b"", False
        self.member = zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.out and not self.damaged:
            if self.member.eof:  # padding may stand between members
                while self.data[self.at : self.at + 1] == b"\0":
                    self.at += 1
                if self.at == len(self.data):
                    return 0
                self.member = zlib.decompressobj(31)
            part = self.data[self.at : self.at + self.STEP]
            try:
                self.out = self.member.decompress(part, 1 << 20)
            except zlib.error:
                self.damaged = True
            self.damaged |= not (part or self.out or self.member.eof)
            self.at += len(part) - len(self.member.unused_data) - len(self.member.unconsumed_tail)
        taken = min(len(into), len(self.out))
        into[:taken], self.out = self.out[:taken], self.out[taken:]
        return taken


def _read(stream, size: int) -> bytes:
    """As many bytes as there are up to size, which may be any told number."""
    parts = []
    while size and (part := stream.read(min(size, 1 << 20))):
        parts.append(part)
        size -= len(part)
    return b"".join(parts)


def _number(text: str | None) -> int | None:
    """A count of at most 18 digits."""
    return int(text) if text and text.isascii() and text.isdigit() and len(text) <= 18 else None


def _fields(lines) -> dict[str, str]:
    out = {}
    for line in lines:
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            break
        name, _, value = text.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _row(record: dict, payloads: bool) -> dict:
    fields, block = record["fields"], record["block"]
    kind = fields.get("warc-type")
    row = {
        "record_id": fields.get("warc-record-id"), "type": kind, "concurrent_to": fields.get("warc-concurrent-to"), "refers_to": fields.get("warc-refers-to"), "target_uri": fields.get("warc-target-uri"),
        "page_id": None, "payload_bytes": None, "payload_digest": None, "intact": None, "payload": None,
    }
    if record["cut"]:
        return row | {"intact": False}
    if kind == "metadata":
        told = _fields(block.splitlines()).get("pageid", "")
        number = _number(told.removeprefix("-"))
        row["page_id"] = -number if number is not None and told.startswith("-") else number
    elif kind in ("response", "revisit"):
        head, _, body = block.partition(b"\r\n\r\n")
        how, _, told = (fields.get("warc-payload-digest") or "").partition(":")
        if kind == "response":
            digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
            row |= {"payload_bytes": len(body), "payload_digest": digest, "intact": digest == told.upper() if how.lower() == "sha1" else None, "payload": body if payloads else None}
        else:  # the payload is elsewhere; its digest and length are told
            http = _fields(head.split(b"\r\n")[1:])
            row |= {"payload_bytes": _number(http.get("content-length")), "payload_digest": told or None}
    return row


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the archives below path; intact tells whether a
    response's payload has the SHA-1 that its record tells (null where it tells
    none), and is false for records that are cut short."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz,txt,txt.gz}").load(path).select("content")

    def rows(batches):
        held, size = [], 0
        for batch in batches:
            for data in batch["content"]:
                for record in parse(data):
                    held.append(_row(record, payloads))
                    size += len(record["block"]) if payloads else 0
                    if len(held) >= BATCH or size >= BATCH_BYTES:
                        yield _frame(held)
                        held, size = [], 0
        if held:
            yield _frame(held)

    def _frame(held):
        df = pd.DataFrame(held)
        return df.astype({"page_id": "Int64", "payload_bytes": "Int64", "intact": "boolean"})

    return files.mapInPandas(rows, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: capture_id, and the structs response
    (a response or revisit), request and metadata.

    Records meet through WARC-Concurrent-To, whichever side tells it: a request
    or metadata record that names the response, or one that the response names.
    A record that belongs to no response gives no row.
    """
    is_answer = F.col("type").isin("response", "revisit")
    fields = [c for c in records.columns if c != "type"]
    whole = F.struct(*fields)
    as_named = records.filter(is_answer & F.col("concurrent_to").isNotNull()).select(F.col("concurrent_to").alias("other"), F.col("record_id").alias("answer"))
    rest = records.filter(F.col("type").isin("request", "metadata"))
    told = rest.filter("concurrent_to is not null").select(F.col("concurrent_to").alias("key"), "type", whole.alias("r"))
    untold = rest.filter("concurrent_to is null").join(as_named.distinct(), F.col("record_id") == F.col("other")).select(F.col("answer").alias("key"), "type", whole.alias("r"))
    answers = records.filter(is_answer).select(F.col("record_id").alias("key"), F.lit("response").alias("type"), F.struct("type", *fields).alias("a"))
    both = answers.unionByName(told.unionByName(untold), allowMissingColumns=True)
    first = lambda kind, c: F.max(F.when(F.col("type") == kind, F.col(c)))
    got = both.groupBy("key").agg(F.sum((F.col("type") == "response").cast("int")).alias("copies"), first("response", "a").alias("response"), first("request", "r").alias("request"), first("metadata", "r").alias("metadata"))
    got = got.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return got.select(F.col("key").alias("capture_id"), "response", "request", "metadata")


def op3_warc(spark, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = written(read_records(spark, path, payloads=False), "records")
    captures = assemble(records).select(
        F.col("metadata.page_id").alias("page_id"), "response.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"), "capture_id", F.col("response.refers_to").alias("kept"), "response.intact"
    )
    captures = written(captures, "captures")
    # a revisit's response may be referred to by a third of all pages: Spark splits that join
    keepers = captures.filter("record_type = 'response'").select(F.col("capture_id").alias("kept"), F.col("page_id").alias("refers_to")).distinct()
    return captures.join(keepers, "kept", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
