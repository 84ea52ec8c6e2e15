"""WARC archives as a Spark data source, and pages written with revisits for repeated payloads.

`spark.read.format("warc")`: partitions are ranges of files. A folder written here has a manifest with files and the
places where records begin, about every RANGE bytes; a file without one is one range. Filters on record_type,
record_id, target_uri, payload_digest and refers_to (equality, IN, not null) are checked on headers, before a block is
decoded; with option blocks=false no block is. `df.write.format("warc")`: one gzip file per task, one member per record;
files count only once the manifest names them, so tasks that failed or ran twice leave nothing behind that is read.
Both go through the file systems that pyarrow opens by URI.

A null payload is an empty one; missing fields are left out of the header. Empty tables give an archive without
records. Columns other than those of the schema are not written.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition,
                                    IsNotNull, WriterCommitMessage)

from concord.llm.common import arrow_batches, bounded_batches, qualified, query, shared_path, stored, table
from concord.llm.warc_format import EQUAL_PAYLOAD, http_block, member, open_range, payload_of, record_bytes, records

SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, payload_bytes long, refers_to string, payload binary"
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
RANGE = 16 << 20
MANIFEST = "_manifest.json"
EMPTY_DATE = "1970-01-01T00:00:00Z"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _field(headers: dict[str, str], column: str) -> str | None:
    """A column's value as it stands in the headers: without brackets, digests without their method."""
    value = headers.get(HEADERS[column])
    if value is not None and column in ("record_id", "refers_to", "target_uri"):
        return value.strip("<>")
    return value.removeprefix("sha1:") if value is not None and column == "payload_digest" else value


@dataclass
class WarcRange(InputPartition):
    path: str
    start: int
    end: int | None


@dataclass
class WarcFile(WriterCommitMessage):
    name: str
    starts: list[int]
    size: int


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.blocks = options["path"], options.get("blocks", "true").lower() != "false"
        self.tests: list[tuple[str, tuple | None]] = []

    def pushFilters(self, filters: list[Filter]):
        for one in filters:
            column = one.attribute[0] if len(getattr(one, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(one, (EqualTo, EqualNullSafe, In)) and (isinstance(one, In) or one.value is not None):
                self.tests.append((column, tuple(one.value) if isinstance(one, In) else (one.value,)))
            elif column in HEADERS and isinstance(one, IsNotNull):
                self.tests.append((column, None))
            else:
                yield one

    def wanted(self, headers: dict[str, str]) -> bool:
        return all((value := _field(headers, c)) is not None and (allowed is None or value in allowed) for c, allowed in self.tests)

    def partitions(self) -> list[WarcRange]:
        system, root = _opened(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.File:
            return [WarcRange(root, 0, None)]
        if system.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            with system.open_input_stream(f"{root}/{MANIFEST}") as file:
                files = json.loads(file.read())
            return [WarcRange(f"{root}/{f['name']}", s, e) for f in files for s, e in zip(f["starts"], [*f["starts"][1:], f["size"]])]
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        return [WarcRange(f.path, 0, None) for f in found if f.type == fs.FileType.File and f.path.endswith((".warc", ".warc.gz"))]

    def read(self, partition: WarcRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        system, _ = _opened(self.path)
        rows, held = [], 0
        with system.open_input_file(partition.path) as file:
            for headers, block in records(open_range(file, partition.start), partition.end, self.wanted, self.blocks):
                own = {c: _field(headers, c) for c in HEADERS}
                kind = own["record_type"]
                payload = None if block is None or kind == "revisit" else payload_of(block)
                length = headers.get("x-payload-length")
                size = int(length) if length is not None else None if payload is None else len(payload)
                rows.append((kind, own["record_id"], own["target_uri"], headers.get("warc-date"), own["payload_digest"], size, own["refers_to"], payload))
                held += len(payload or b"")
                if len(rows) >= 2000 or held > 4 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


FIELDS = ["record_type", "record_id", "target_uri", "date", "payload_digest", "payload_bytes", "refers_to", "payload"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [*[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=FIELDS)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WarcFile:
        system, root = _opened(self.path)
        system.create_dir(root, recursive=True)
        name, starts, at = f"part-{uuid.uuid4().hex}.warc.gz", [0], 0
        with system.open_output_stream(f"{root}/{name}", compression=None) as file:
            for batch in arrow_batches(iterator):
                for row in batch.to_pylist():
                    if at - starts[-1] >= RANGE:
                        starts.append(at)
                    at += file.write(_member_of(row))
        return WarcFile(name, starts, at)

    def commit(self, messages: list[WarcFile | None]) -> None:
        system, root = _opened(self.path)
        system.create_dir(root, recursive=True)
        old = system.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File
        files: list[dict] = []
        if old and not self.overwrite:
            with system.open_input_stream(f"{root}/{MANIFEST}") as file:
                files = json.loads(file.read())
        files += [{"name": m.name, "starts": m.starts, "size": m.size} for m in messages if m is not None and m.size]
        with system.open_output_stream(f"{root}/{MANIFEST}", compression=None) as file:
            file.write(json.dumps(files).encode())

    def abort(self, messages: list[WarcFile | None]) -> None:
        system, root = _opened(self.path)
        for message in messages:
            if message is not None:
                system.delete_file(f"{root}/{message.name}")


def _member_of(row: dict) -> bytes:
    kind = row["record_type"] or "response"
    payload = row.get("payload") or b""
    size = row["payload_bytes"] if row.get("payload_bytes") is not None else len(payload)
    digest = row.get("payload_digest") or base64.b32encode(hashlib.sha1(payload).digest()).decode()
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", row.get("date") or EMPTY_DATE)]
    if row.get("target_uri") is not None:
        headers.append(("WARC-Target-URI", row["target_uri"]))
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(size)), ("Content-Type", "application/http; msgtype=response")]
    if kind == "revisit":
        headers += [("WARC-Profile", EQUAL_PAYLOAD), ("WARC-Refers-To", f"<{row['refers_to']}>")]
    return member(record_bytes(headers, http_block(None if kind == "revisit" else payload, size)))


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    bounded_batches(spark)


def base32(hexed: Column) -> Column:
    """A SHA-1 in hexadecimal digits as base32: each ten digits are eight letters."""
    parts = [F.lpad(F.conv(F.substring(hexed, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def id_of_page(page: Column) -> Column:
    """A record id that holds the page's id; one without it where that is null."""
    digits = F.lpad(F.hex(page), 16, "0")
    known = F.concat(F.lit("urn:uuid:00000000-0000-8000-"), F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 12))
    return F.coalesce(known, F.lit("urn:uuid:00000000-0000-8001-0000-000000000000"))


def page_of_id(record: Column) -> Column:
    digits = F.regexp_extract(record, "^urn:uuid:00000000-0000-8000-([0-9A-Fa-f]{4}-[0-9A-Fa-f]{12})$", 1)
    number = F.conv(F.replace(digits, F.lit("-"), F.lit("")), 16, 10).cast("decimal(20,0)")
    signed = F.when(number >= F.lit(str(2**63)).cast("decimal(20,0)"), number - F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(number)
    return F.when(digits != "", signed.cast("long"))


def page_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """WARC rows of pages: of equal payloads of at least `least` bytes, the largest page_id answers and others revisit it.

    Smaller payloads all answer, and so do rows that repeat the largest page_id. Null ids come last.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("sha1"))
    # Stored, so that the join below has nothing but shuffles on either side and Spark can split a frequent payload.
    first = pages.select(F.col("page_id").cast("long"), F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("size")).filter(F.col("size") >= least)
    first = stored(first.groupBy("sha1").agg(F.max("page_id").alias("largest")), "payloads")
    joined = rows.join(first, "sha1", "left")
    again = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    again = again & (F.col("payload_bytes") >= least)
    return joined.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), id_of_page(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit(None).cast("string").alias("date"), base32(F.upper("sha1")).alias("payload_digest"),
        "payload_bytes", F.when(again, id_of_page(F.col("largest"))).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"))


ORACLE = """
with p as (select page_id, coalesce(html, '') as html from pages),
b as (select page_id, html, max(page_id) over (partition by html) as largest, unhex(sha1(html)) as raw from p),
bits as (select page_id, html, largest, string_agg(lpad(bin(('0x' || substr(hex(raw), 2 * k + 1, 2))::int), 8, '0'), '' order by k) as bits
         from b, range(20) t(k) group by all),
d as (select page_id, html, largest, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + 16 * substr(bits, 5 * k + 1, 1)::int + 8 * substr(bits, 5 * k + 2, 1)::int + 4 * substr(bits, 5 * k + 3, 1)::int
          + 2 * substr(bits, 5 * k + 4, 1)::int + substr(bits, 5 * k + 5, 1)::int, 1), '' order by k) as payload_digest
      from bits, range(32) t(k) group by all)
select page_id, strlen(html) as payload_bytes, payload_digest,
       case when page_id = largest then 'response' else 'revisit' end as record_type,
       case when page_id <> largest then largest end as refers_to
from d
"""


@query("op10_warc", ORACLE)
def op10_warc(spark, folder):
    register(spark)
    path = qualified(spark, shared_path(spark, "warc"))
    page_records(table(spark, folder, "pages")).write.format("warc").mode("append").save(path)
    read = spark.read.format("warc").load(path)
    # Digests and sizes of answers are those of the payloads read back; a revisit has only its header's.
    answer = F.col("record_type") == "response"
    return read.select(
        page_of_id(F.col("record_id")).alias("page_id"),
        F.when(answer, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(answer, base32(F.upper(F.sha1("payload")))).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", page_of_id(F.col("refers_to")).alias("refers_to"))
