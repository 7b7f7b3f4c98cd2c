"""WARC archives: a Spark-native writer and a Python data source that reads them.

Writing: every record is one string, put together in the JVM and written by Spark's text sink with CR LF between records,
so it works on any file system that Spark has and under task retries. Records whose payload was seen before become
revisits that refer to the first.

Reading: partitions are runs of whole files up to partition_bytes (a compressed stream can't be entered in the middle; the
writer keeps files small). Filters on header columns are pushed down. Headers are parsed first, and the block of a record
that a pushed filter or an option excludes is skipped, not decoded.

Cases: a null payload is written as an empty one. A null target is written as urn:unknown, and characters that a header
can't hold are percent-escaped. A null id is written as null and read as null. Rows that repeat an id and a payload are each written. A
malformed record raises an error that names file and offset. A path without archives gives an empty table.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith

CRLF = "\r\n"
#: Payloads shorter than this are never written as revisits.
REVISIT_FROM = 100
#: Fixed values of the format (WARC 1.1).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, type string, target_uri string, date string, refers_to string, payload_digest string, content_type string, content_length long, payload_length long, payload binary"
HEADERS = {
    "record_id": "warc-record-id",
    "type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
    "content_type": "content-type",
}


def with_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """pages with __digest, __bytes and __first: the smallest id with the same payload where the row is a revisit, else null.

    Equal payloads are counted by digest; only digests that repeat are joined back.
    """
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    sized = pages.withColumn("__digest", F.sha2(body, 256)).withColumn("__bytes", F.octet_length(body).cast("long"))
    firsts = sized.where(F.col("__bytes") >= REVISIT_FROM).groupBy(F.col("__digest").alias("__d")).agg(F.min(id_col).alias("__least"), F.count("*").alias("__rows")).where("__rows > 1")
    joined = sized.join(firsts, F.col("__digest") == F.col("__d"), "left")
    first = F.when(F.col("__least").isNotNull() & (F.col(id_col).isNull() | (F.col(id_col) > F.col("__least"))), F.col("__least"))
    return joined.withColumn("__first", first).drop("__d", "__least", "__rows")


def _header(name: str, value) -> object:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _name(value) -> object:
    return F.concat(F.lit("<urn:page:"), F.coalesce(value.cast("string"), F.lit("null")), F.lit(">"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Writes one record per row into archive files under path."""
    rows = with_revisits(pages, id_col, payload_col)
    body = F.coalesce(F.col(payload_col), F.lit(""))
    revisit = F.col("__first").isNotNull()
    # what a header line can't hold: controls, blanks and anything that isn't ASCII
    uri = F.coalesce(F.url_encode(F.col(uri_col)), F.lit("urn:unknown"))
    uri = F.when(F.col(uri_col).rlike(r"^[\x21-\x7e]+$"), F.col(uri_col)).otherwise(uri)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("__bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("__bytes"))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", _name(F.col(id_col))),
        _header("WARC-Target-URI", uri),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("__digest"))),
        F.when(revisit, F.concat(_header("WARC-Profile", F.lit(PROFILE)), _header("WARC-Refers-To", _name(F.col("__first"))), _header("X-Payload-Length", F.col("__bytes").cast("string")))).otherwise(F.lit("")),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", block.cast("string")),
        F.lit(CRLF),
        http,
        F.when(revisit, F.lit("")).otherwise(body),
        F.lit(CRLF),
    )
    rows.select(record.alias("value")).write.option("lineSep", CRLF).option("compression", compression).text(path)


@dataclass
class Files(InputPartition):
    """Whole files of one partition."""

    paths: list[str]


def _file_system(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "file:///" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _listed(path: str) -> list[tuple[str, int]]:
    from pyarrow import fs

    system, root = _file_system(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(root, info.size)]
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.base_name[0] not in "_.")


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.bytes = int(options.get("partition_bytes", 32 << 20))
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.filters: list[Filter] = []
        if options.get("record_types"):
            self.filters.append(In(("type",), tuple(x.strip() for x in options["record_types"].split(","))))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            header = len(getattr(f, "attribute", ())) == 1 and f.attribute[0] in HEADERS
            if header and isinstance(f, (EqualTo, EqualNullSafe, In, IsNotNull, StringStartsWith, StringEndsWith, StringContains)):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        parts, size = [Files([])], 0
        for path, n in _listed(self.path):
            if parts[-1].paths and size + n > self.bytes:
                parts.append(Files([]))
                size = 0
            parts[-1].paths.append(path)
            size += n
        return parts

    def wanted(self, head: dict[str, str]) -> bool:
        for f in self.filters:
            value = head.get(HEADERS[f.attribute[0]])
            if isinstance(f, EqualNullSafe):
                ok = value == f.value
            elif value is None:
                ok = False
            elif isinstance(f, EqualTo):
                ok = value == f.value
            elif isinstance(f, In):
                ok = value in f.value
            elif isinstance(f, StringStartsWith):
                ok = value.startswith(f.value)
            elif isinstance(f, StringEndsWith):
                ok = value.endswith(f.value)
            elif isinstance(f, StringContains):
                ok = f.value in value
            else:
                ok = True
            if not ok:
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64() if n.endswith("length") else pa.binary() if n == "payload" else pa.string()) for n in (c.split()[0] for c in SCHEMA.split(", "))])
        system, _ = _file_system(self.path)
        rows: list[dict] = []
        held = 0
        for path in partition.paths:
            for row in self.records(system, path):
                rows.append(row)
                held += 1000 + len(row["payload"] or b"")
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def records(self, system, path: str) -> Iterator[dict]:
        raw = system.open_input_file(path)
        packed = raw.read(2) == b"\x1f\x8b"
        raw.seek(0)
        f = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if packed else raw
        lines = f if packed else io.BufferedReader(raw, 1 << 16)
        try:
            yield from parse(lines, path, self.wanted, self.payload, packed)
        finally:
            raw.close()


def parse(f, path: str, wanted, payload: bool, packed: bool) -> Iterator[dict]:
    """Records of a buffered stream; blocks that aren't wanted are skipped."""
    at = 0

    def skip(n: int) -> None:
        if not packed:
            f.seek(n, io.SEEK_CUR)
            return
        while n > 0:
            got = len(f.read(min(n, 1 << 20)))
            if not got:
                raise ValueError(f"{path}: a record's block ends early, at byte {at}")
            n -= got

    while True:
        line = f.readline()
        at += len(line)
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{path}: no record starts at byte {at - len(line)}")
        head: dict[str, str] = {}
        name = ""
        while (line := f.readline()).strip():
            at += len(line)
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[0] in " \t" and name:  # a folded line
                head[name] += " " + text.strip()
            else:
                name, _, value = text.partition(":")
                name = name.strip().lower()
                head[name] = value.strip()
        at += len(line)
        try:
            size = int(head["content-length"])
        except (KeyError, ValueError):
            raise ValueError(f"{path}: a record without a Content-Length ends at byte {at}") from None
        if not wanted(head):
            skip(size)
            at += size
            continue
        row: dict = {c: head.get(h) for c, h in HEADERS.items()}
        row |= {"content_length": size, "payload_length": None, "payload": None}
        if head.get("warc-type") == "revisit":
            row["payload_length"] = int(head["x-payload-length"]) if head.get("x-payload-length", "").isdigit() else None
            skip(size)
        elif payload:
            block = f.read(size)
            if len(block) < size:
                raise ValueError(f"{path}: a record's block ends early, at byte {at}")
            if head.get("content-type", "").startswith("application/http"):
                block = block.partition(b"\r\n\r\n")[2]
            row["payload"], row["payload_length"] = block, len(block)
        else:
            skip(size)
        at += size
        yield row


class WarcSource(DataSource):
    """Format "warc". Options: path; record_types (comma-separated); payload (false: headers only); partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(path=path, **options).load()


#: DuckDB: what the archives must say of every page.
SQL = """
WITH sized AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS least FROM sized)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > least THEN least END AS refers_to
FROM firsts
"""
