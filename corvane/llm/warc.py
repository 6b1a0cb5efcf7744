"""WARC archives with an index of records (operator 5).

Each page becomes one gzip member: a response, or a revisit where an equal payload is already a response. While a
task writes, it notes offset, length, URL and digest of every record; that index is written beside the archives, in
Parquet files that only successful tasks commit. Reading starts from the index: the selected records are sorted by file
and offset, neighbouring byte ranges are joined, and each joined range is read once.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the WARC 1.1 format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, file string, offset long, length long, url string, payload_digest string, record_type string, refers_to long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(uri: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri)
    return int(found[1]) if found else None


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP head, with the full payload's length, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    lines = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_uri(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> dict:
    """The record of one gzip member; the payload's digest is computed anew where there is a payload."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    block = rest[: int(fields["content-length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("broken WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    told = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and _base32(hashlib.sha1(payload).digest()) != told:
        raise ValueError("payload and digest differ")
    return {
        "page_id": _page_of(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": int(re.search(rb"(?i)content-length: (\d+)", http)[1]),
        "payload_digest": told,
        "record_type": kind,
        "refers_to": _page_of(fields.get("warc-refers-to", "")),
        "payload": payload if kind == "response" else None,
    }


def assign(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """i, url, html, sha1 (hex), refers: the page that holds an equal payload, null for responses.

    Of equal payloads of at least `at_least` bytes the one of the largest page_id is the response. Rows that share that
    id and payload are all responses, and so are all where no id is known. Digests of one page need no match; those
    of several are spread over salts, so that a group of copies is dealt to many tasks.
    """
    salts = common.partitions(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("i"), "url", html.alias("html"))
    rows = rows.withColumn("sha1", F.sha1("html")).withColumn("salt", F.pmod(F.xxhash64("i"), F.lit(salts)).cast("int"))
    groups = rows.filter(F.length("html") >= at_least).groupBy("sha1").agg(F.max("i").alias("last"), F.count("*").alias("n"))
    shared = groups.filter("n > 1 and last is not null").select("sha1", "last", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    refers = F.when((F.col("i").isNull()) | (F.col("i") != F.col("last")), F.col("last"))
    return rows.join(shared, ["sha1", "salt"], "left").select("i", "url", "html", "sha1", F.when(F.length("html") >= at_least, refers).alias("refers"))


def write(pages: DataFrame, folder: str, at_least: int = 0) -> DataFrame:
    """Write one archive per task, and the index beside them, which is returned: a row per page, of INDEX.

    Null html: an empty payload; null url: no target; null id: a record without a page. Equal rows give a record each;
    payloads of any length are written whole; other columns are not read; an empty table gives an empty index. A task
    that is run again writes a new file; the index names one file per record only, and the others are removed.
    """

    def to_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = common.byte_files(folder)
        sink, at = None, 0
        for batch in batches:
            if sink is None:
                system.create_dir(root, recursive=True)
                name = f"{root}/pages-{uuid.uuid4().hex}.warc.gz"
                sink = system.open_output_stream(name, compression=None)
            rows = []
            for i, url, html, sha1, refers in zip(*(batch[c] for c in ("i", "url", "html", "sha1", "refers")), strict=True):
                i, refers = (None if pd.isna(x) else int(x) for x in (i, refers))
                digest = _base32(binascii.unhexlify(sha1))
                member = record(i, url, html, len(html), digest, refers)
                sink.write(member)
                rows.append((i, name, at, len(member), url, digest, "response" if refers is None else "revisit", refers))
                at += len(member)
            out = pd.DataFrame(rows, columns=["page_id", "file", "offset", "length", "url", "payload_digest", "record_type", "refers_to"])
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})
        if sink is not None:
            sink.close()

    spark = pages.sparkSession
    assign(pages, at_least).mapInPandas(to_files, INDEX).write.parquet(f"{folder}/index")
    delete_orphans(spark, folder)
    return open_index(spark, folder)


def open_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def delete_orphans(spark: SparkSession, folder: str) -> int:
    """Delete archives that the index does not name, left by attempts that failed; how many there were. One name per task."""
    named = {r["file"].rsplit("/", 1)[-1] for r in open_index(spark, folder).select("file").distinct().collect()}
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in system.listStatus(path) if f.getPath().getName().endswith(".warc.gz") and f.getPath().getName() not in named]
    for f in found:
        system.delete(f, False)
    return len(found)


def ranges(rows: Iterator[tuple[str, int, int]], gap: int, most: int) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Join records sorted by (file, offset) into byte ranges: (file, offset, length, records within)."""
    file, start, end, held = None, 0, 0, []
    for name, offset, length in rows:
        if held and (name != file or offset - end > gap or offset + length - start > most):
            yield file, start, end - start, held
            held = []
        if not held:
            file, start, end = name, offset, offset
        held.append((offset - start, length))
        end = max(end, offset + length)
    if held:
        yield file, start, end - start, held


def read(index: DataFrame, folder: str, gap: int = 64 << 10, most: int = 8 << 20, keep_payload: bool = True) -> DataFrame:
    """The records that the index selects; of an empty index none. A record that is selected twice comes twice, but repeats of one place are read once. Ranges are dealt out by file and stretch of `most` bytes, so that no task has a whole large file."""

    def to_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = common.byte_files(folder)
        open_name, source = None, None

        def selected() -> Iterator[tuple[str, int, int]]:
            for batch in batches:
                yield from zip(batch["file"], batch["offset"], batch["length"], strict=True)

        out, size = [], 0
        for name, start, length, records in ranges(selected(), gap, most):
            if name != open_name:
                if source is not None:
                    source.close()
                open_name, source = name, system.open_input_file(name)
            source.seek(start)
            span = source.read(length)
            for offset, n in records:
                got = parse(span[offset : offset + n])
                if not keep_payload:
                    got["payload"] = None
                size += n
                out.append(got)
            if size > 4 << 20 or len(out) > 5000:
                yield pd.DataFrame(out).astype({"page_id": "Int64", "refers_to": "Int64"})
                out, size = [], 0
        if source is not None:
            source.close()
        if out:
            yield pd.DataFrame(out).astype({"page_id": "Int64", "refers_to": "Int64"})

    stretch: Column = F.floor(F.col("offset") / most)
    dealt = index.select("file", "offset", "length").repartition(common.partitions(index.sparkSession), "file", stretch).sortWithinPartitions("file", "offset")
    return dealt.mapInPandas(to_records, RECORD)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_folder(spark, "warc")
    index = write(common.read(spark, sf_dir, "pages"), folder)
    out = common.checkpointed(read(index, folder, keep_payload=False).drop("payload", "url"))
    common.remove(spark, folder)
    return out


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS s FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS last FROM d),
bits AS (
  SELECT *, list_transform(range(40), lambda i: strpos('0123456789abcdef', s[i + 1]) - 1) AS nibbles FROM g
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(5), lambda b:
      ((nibbles[1 + (5 * k + b) // 4] >> (3 - (5 * k + b) % 4)) & 1) << (4 - b))) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM bits
"""
