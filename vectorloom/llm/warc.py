"""Content-addressed WARC archive.

Payload bytes lie once each in a store keyed by their SHA-256; exact record headers lie apart, one row a record, and
name the digest. A record is read back by joining its header with the store. Of records with equal payloads of at
least ``LEAST`` bytes, the one with the smallest page_id is the response and the others revisit it; shorter
ones are all responses. Digests are verified on what has been read back.

Cases: a null html is an empty payload; a null url gives no target; line breaks in a url are percent-encoded; rows that repeat
the smallest page_id are all responses; a null page_id counts as the greatest; an empty table gives an empty archive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import hot_keys, join_one
from .storage import Workspace

LEAST = 100
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
_ID = "<urn:page:"
#: Characters that end a line somewhere or print nothing, which a header must not hold.
_CONTROLS = [chr(c) for c in (*range(32), 127, 133, 0x2028, 0x2029)]


def _header(kind: Column, page: Column, url: Column, digest: Column, size: Column, refers: Column) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    safe = url
    for c in _CONTROLS:
        safe = F.replace(safe, F.lit(c), F.lit("".join(f"%{b:02X}" for b in c.encode())))
    safe = F.when(url.rlike(f"[{''.join(f'{chr(92)}u{ord(c):04x}' for c in _CONTROLS)}]"), safe).otherwise(url)
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.concat(F.lit(_ID), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", safe), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        F.coalesce(line("WARC-Refers-To", F.concat(F.lit(_ID), refers.cast("string"), F.lit(">"))), F.lit("")),
        F.when(kind == "revisit", line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.lit(len(HTTP)) + F.when(kind == "revisit", 0).otherwise(size)).cast("string")),
        F.lit("\r\n"),
    )


def _field(header: Column, name: str) -> Column:
    """Value of a header's field: it begins behind a line end (CRLF) and ends before the next, whatever other characters it holds."""
    return F.regexp_extract(header, f"\\r\\n{name}: ([^\\r\\n]*)\\r\\n", 1)


def _page(header: Column, name: str) -> Column:
    return F.regexp_extract(_field(header, name), r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


@dataclass
class Archive:
    """Tables of a written archive: ``headers`` (header, digest, record_type), ``store`` (digest, payload), ``hot`` (digests of many records)."""

    headers: DataFrame
    store: DataFrame
    hot: DataFrame

    def _joined(self, headers: DataFrame) -> DataFrame:
        """``headers`` with their payloads."""
        return join_one(headers, self.store, ["digest"], self.hot)

    def records(self) -> DataFrame:
        """page_id, record (a WARC record's exact bytes; a revisit has no payload) and payload (the full payload of either kind)."""
        return self._joined(self.headers).select(_page(F.col("header"), "WARC-Record-ID").alias("page_id"), _record(F.col("payload")).alias("record"), "payload")

    def index(self, space: Workspace | None = None) -> DataFrame:
        """page_id, payload_bytes, payload_digest, record_type, refers_to of each record, as the rebuilt record tells."""
        responses = self._joined(self.headers.where("record_type = 'response'")).select(_record(F.col("payload")).alias("record"))
        revisits = self.headers.where("record_type = 'revisit'").select(_record(F.lit(b"")).alias("record"))
        told = (space or Workspace(self.headers.sparkSession)).written(parsed(responses), "told")
        held = told.groupBy("payload_digest").agg(F.max("payload_bytes").alias("held"))
        again = join_one(parsed(revisits), held, ["payload_digest"], self.hot.withColumnRenamed("digest", "payload_digest")).select("page_id", F.col("held").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
        return told.unionByName(again)


def _record(payload: Column) -> Column:
    """Header, HTTP header, payload (none in a revisit) and closing line ends."""
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(payload)
    return F.concat(F.concat(F.col("header"), F.lit(HTTP)).cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def parsed(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of WARC records (record). A record whose length or payload is not what its header says is an error."""
    whole = F.col("record").cast("string")
    # the header ends at the first empty line, as no field can hold a line end
    r = records.select("record", F.concat(F.substring_index(whole, "\r\n\r\n", 1), F.lit("\r\n")).alias("header"))
    begin = F.octet_length("header") + 2 + len(HTTP)
    size = _field(F.col("header"), "Content-Length").cast("long") - len(HTTP)
    r = r.select("header", F.octet_length("record").alias("whole"), begin.alias("begin"), size.alias("size"), F.substring("record", begin + 1, size.cast("int")).alias("payload"))
    named = F.substring(_field(F.col("header"), "WARC-Payload-Digest"), 8, 64)
    kind = _field(F.col("header"), "WARC-Type")
    right = (F.col("whole") == F.col("begin") + F.col("size") + 4) & ((kind == "revisit") | (F.sha2("payload", 256) == named))
    digest = F.when(right, named).otherwise(F.raise_error(F.concat(F.lit("record is not what its header says: "), "header")))
    return r.select(_page(F.col("header"), "WARC-Record-ID").alias("page_id"), F.col("size").alias("payload_bytes"), digest.alias("payload_digest"), kind.alias("record_type"), _page(F.col("header"), "WARC-Refers-To").alias("refers_to"))


def write(pages: DataFrame, space: Workspace | None = None) -> Archive:
    """Archives ``pages`` (page_id, url, html) and reads the archive's tables back."""
    space = space or Workspace(pages.sparkSession)
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    slim = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("size"))
    # equal payloads fold before the shuffle; the store gets one row a digest
    store = rows.groupBy("digest").agg(F.first("payload").alias("payload"))
    stored = space.written(store, "store", compression="zstd")
    space.release()
    response = space.written(slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")), "responses")
    hot = space.written(hot_keys(response, ["digest"]), "hot")
    joined = join_one(slim, response, ["digest"], hot)
    again = (F.col("size") >= LEAST) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    kind = F.when(again, "revisit").otherwise("response")
    refers = F.when(again, F.col("first"))
    header = _header(kind, F.col("page_id"), F.col("url"), F.col("digest"), F.col("size"), refers)
    headers = space.written(joined.select(header.alias("header"), "digest", kind.alias("record_type")), "headers", compression="zstd")
    space.release()
    return Archive(headers, stored, hot)
