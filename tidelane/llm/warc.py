"""WARC archives with revisit resolution.

``write_archive`` turns a page table into WARC/1.1 records: headers (id, digest, size, file) are shuffled by
digest, the record with the largest id of each group of equal payloads stays a ``response`` and the
others become ``revisit`` records that refer to it.  Payloads are not shuffled: the ids of revisits
go to the scan that writes the records, in slices small enough to be broadcast.  A slice has the revisits of some
input files, so each file is read once; a file with more revisits than a slice holds is read once for each of its
parts.  A record's id is made of its page's id, its payload's digest and a number that tells rows apart which
share both (only such rows are shuffled).  Records are written by Spark's text sink with
the record terminator as line separator, which is exactly the WARC layout, as gzip files, and commits
atomically on any file system that Spark reaches.  ``read_archive`` parses the files again,
``resolve_revisits`` joins revisits to their originals.

Defined results: a null payload is empty; a null url becomes ``urn:page:<id>``; repeated rows that all
hold the largest id are all responses; a null id sorts below every other id; an empty table gives an
empty archive; extra columns are ignored, whatever their names; equal payloads that tie on the largest
id are all responses.  Very long payloads are whole; a file of the archive holds about ``FILE_BYTES``
and must stay below 2 GB, so a single payload must too.  A file that ends inside a record, or holds
none where one should begin, raises ``ValueError``.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm.prefix import numbered
from tidelane.llm.storage import Scratch, has_files

CRLF = "\r\n"
FILE_BYTES = 32 << 20
#: Revisits (an id, an original and a digest, about 100 bytes each) that one scan gets by broadcast.
SCAN_REVISITS = 1_000_000
#: Parts of the copies of one payload, where originals are too many to be broadcast.
SALTS = 16
ARCHIVE_SCHEMA = "page_id long, record_id string, record_type string, payload_digest string, payload_bytes long, refers_to_record string, target_uri string, digest_ok boolean"


def record_id(page_id: Column, digest: Column, nth: Column) -> Column:
    """A stable URN for the ``nth`` record of a page with a payload."""
    h = F.md5(F.concat_ws(":", F.lit("page"), F.coalesce(page_id.cast("string"), F.lit("")), digest, nth.cast("string")))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def plan_revisits(heads: DataFrame, scratch: Scratch, min_bytes: int) -> DataFrame:
    """(page_id, digest, file, original_id) of the pages that become revisits."""
    large = heads.where(F.col("payload_bytes") >= min_bytes)
    originals = large.groupBy("digest").agg(F.max("page_id").alias("original_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    originals = scratch.keep(originals, "originals")
    if originals.count() <= SCAN_REVISITS:
        met = large.join(F.broadcast(originals), "digest")
    else:  # one payload may have any number of copies: they are dealt into parts, each with its original
        parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        met = large.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(originals.select("*", parts), ["digest", "salt"]).drop("salt")
    revisits = met.where(F.col("page_id").isNull() | (F.col("page_id") < F.col("original_id")))
    return scratch.keep(revisits.groupBy("page_id", "digest", "file").agg(F.max("original_id").alias("original_id")), "revisits")


def sliced(revisits: DataFrame, most: int) -> tuple[Column, int]:
    """(slice of a row with page_id, digest and file; number of slices) such that no slice has over ``most`` revisits.

    One slice if all fit.  Else files are dealt to slices whole, or in as many parts as the largest needs.
    """
    total = revisits.count()
    if total <= most:
        return F.lit(0), 1
    largest = revisits.groupBy("file").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    parts, slices = -(-2 * largest // most), -(-2 * total // most)
    while True:
        part = F.pmod(F.xxhash64("page_id", "digest"), F.lit(parts)) if parts > 1 else F.lit(0).cast("long")
        at = F.pmod(F.xxhash64(F.col("file"), part), F.lit(slices))
        if revisits.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] <= most:
            return at, slices
        parts, slices = 2 * parts, 2 * slices


def archive_records(rows: DataFrame, date: str) -> DataFrame:
    """The text of each record; rows with an ``original_id`` are revisits."""
    uri = F.coalesce(F.regexp_replace("url", r"[\x00-\x20]", "%20"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes"), F.lit(CRLF * 2))
    block = F.concat(http, F.when(F.col("original_id").isNull(), F.col("payload")).otherwise(F.lit("")))
    kind = F.when(F.col("original_id").isNull(), F.lit("response")).otherwise(F.lit("revisit"))
    extra = F.when(
        F.col("original_id").isNotNull(),
        F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("original_id"), F.col("digest"), F.lit(0)), F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}")),
    ).otherwise(F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind, F.lit(f"{CRLF}WARC-Record-ID: "), record_id(F.col("page_id"), F.col("digest"), F.col("nth")), F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "), uri,
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(CRLF), extra, F.lit("X-Page-Id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length("block").cast("string"), F.lit(CRLF * 2),
    )
    return rows.withColumn("block", block).select(F.concat(head, F.col("block")).alias("value"))


def write_archive(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z", min_revisit_bytes: int = 1000, scan_revisits: int = SCAN_REVISITS) -> None:
    """Write one record for each row of ``pages`` below ``path``; a scan gets ``scan_revisits`` ids of revisits at most."""
    scratch = Scratch(pages.sparkSession, "warc")
    file = F.col("_metadata.file_path") if has_files(pages) else F.lit("")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), file.alias("file"))
    base = base.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    heads = scratch.keep(base.select("page_id", "digest", "payload_bytes", "file"), "heads")
    n, mean = heads.agg(F.count(F.lit(1)), F.avg("payload_bytes")).first()
    per_file = max(1, int(FILE_BYTES / (1000 + (mean or 0)))) if n else 1
    again = scratch.keep(heads.groupBy("page_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "again")
    n_again = again.count()
    same = F.col("b.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("b.digest") == F.col("r.digest"))
    revisits = plan_revisits(heads, scratch, min_revisit_bytes)
    at, slices = sliced(revisits, scan_revisits)
    for g in range(slices):
        due = revisits.where(at == g).groupBy("page_id", "digest").agg(F.max("original_id").alias("original_id"))
        part = base.where(at == g) if slices > 1 else base
        rows = part.alias("b").join(F.broadcast(due).alias("r"), same, "left").select("b.*", "r.original_id")
        if n_again:
            few = (F.broadcast(again) if n_again <= SCAN_REVISITS else again).alias("r")
            copies = numbered(rows.alias("b").join(few, same, "left_semi"), ["page_id", "digest"], "nth", scratch, f"copies{g}")
            rows = rows.alias("b").join(few, same, "left_anti").withColumn("nth", F.lit(0).cast("long")).unionByName(copies)
        else:
            rows = rows.withColumn("nth", F.lit(0))
        records = archive_records(rows, date).write.mode("append" if g else "errorifexists")
        records.option("lineSep", CRLF * 2).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)
        scratch.drop(f"copies{g}")
    scratch.drop("heads", "originals", "revisits", "again")


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError(f"the archive ends inside the record at byte {at}")
        lines = content[at:end].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        if end + 4 + size > len(content):
            raise ValueError(f"the archive ends inside the record at byte {at}")
        yield fields, content[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _plain(content: bytes) -> bytes:
    """The bytes of a file, gzip members of whole files or of single records undone."""
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def _content_length(http: bytes) -> int | None:
    """The size of the payload that a revisit leaves out, from its HTTP header."""
    for line in http.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value)
    return None


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in ARCHIVE_SCHEMA.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in ARCHIVE_SCHEMA.split(", ")])
    for batch in batches:
        for cell in batch.column(0):
            out: dict[str, list] = {k: [] for k in names}
            for fields, block in parse_records(_plain(cell.as_buffer().to_pybytes())):
                http, _, payload = block.partition(b"\r\n\r\n")
                kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                response = kind == "response"
                row = (int(fields["x-page-id"]) if fields["x-page-id"] else None, fields["warc-record-id"], kind, digest, len(payload) if response else _content_length(http), fields.get("warc-refers-to"), fields["warc-target-uri"], hashlib.sha1(payload).hexdigest() == digest if response else None)
                for k, v in zip(names, row):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[k], schema.field(k).type) for k in names], schema=schema)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Header rows of every record below ``path``; ``digest_ok`` says if a payload has its digest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(_parsed, ARCHIVE_SCHEMA)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Give revisits the id of the response that they refer to, and its size where they do not tell one."""
    originals = records.where("record_type = 'response'").select(F.col("record_id").alias("o_record"), F.col("page_id").alias("o_page"), F.col("payload_bytes").alias("o_bytes"))
    wanted = records.where("record_type = 'revisit'").select(F.col("refers_to_record").alias("o_record")).distinct()
    originals = Scratch(records.sparkSession, "warc").keep(originals.join(wanted, "o_record").dropDuplicates(["o_record"]), "originals")
    revisits = records.where("record_type = 'revisit'").join(originals, F.col("refers_to_record") == F.col("o_record"), "left")
    same = lambda d, size, refers: d.select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", refers.alias("refers_to"))
    return same(records.where("record_type = 'response'"), F.col("payload_bytes"), F.lit(None).cast("long")).unionByName(same(revisits, F.coalesce("payload_bytes", "o_bytes"), F.col("o_page")))


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to WARC archives, read them back and resolve the revisits."""
    scratch = Scratch(spark, "op9")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch.path("archive"))
    records = scratch.keep(read_archive(spark, scratch.path("archive")), "records")
    scratch.drop("archive")
    return resolve_revisits(records)


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS last_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last_id THEN NULL ELSE last_id END AS refers_to
FROM g
"""
