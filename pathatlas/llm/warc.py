"""WARC archives with an index that is written first and read by coalesced byte ranges.

Writing: payload digests are grouped (partial maximum) to name the response of each repeated payload; each task then writes
gzip members, one per record, to files of its own in the shared folder and hands out an index row with file, offset, length,
URL and digest per record. A retried task writes new files and the index names those of the attempt that was kept.
Reading: index rows are dealt out by file and slab of the file and sorted by offset; neighbouring ranges become one read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import part_count, query, saved, table

MIN_REVISIT = 1000
FILE_BYTES = 256 << 20
RANGE_BYTES = 8 << 20
TASK_BYTES = 64 << 20  # of archives that one task reads back
GAP_BYTES = 64 << 10
INDEX = "page_id long, url string, payload_digest string, record_type string, file string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if "://" not in uri else fs.FileSystem.from_uri(uri)


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, date: str = "2000-01-01T00:00:00Z") -> bytes:
    """One record: a response with its payload, or a revisit whose HTTP head still tells the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
            ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="%:/?#[]@!$&'()*+,;=~ ")))
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields of one record; payload is None for a revisit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    http, _, payload = rest[: int(field["content-length"])].partition(b"\r\n\r\n")
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda x: int(x[10:-1]) if x and len(x) > 11 else None
    return {"page_id": number(field["warc-record-id"]), "url": field.get("warc-target-uri"), "record_type": field["warc-type"],
            "digest": field["warc-payload-digest"].partition(":")[2], "refers_to": number(field.get("warc-refers-to")),
            "length": length, "payload": payload if field["warc-type"] == "response" else None}


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Archive every row of ``pages`` below ``folder`` and return the written index.

    Payload is the text in UTF-8 (null: empty). Of equal payloads of at least ``min_revisit`` bytes the row with the largest
    id is the response and the others revisit it; rows that repeat that id are responses too, and so are all rows whose
    payload comes with null ids only. A null url is left out of the record. An empty table gives an empty index.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html")))
    again = saved(rows.where(F.octet_length("html") >= min_revisit).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
                  .where("n > 1").select(F.col("digest").alias("_digest"), "first_id"))
    told = rows.join(again, F.col("digest") == F.col("_digest"), "left").select(
        "page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = open_store(folder)
        out, name, at = None, "", 0
        for pdf in batches:
            index = []
            refers = pdf["refers_to"].astype("Int64")
            ids = pdf["page_id"].astype("Int64")
            for page_id, url, html, digest, ref in zip(ids, pdf["url"], pdf["html"], pdf["digest"], refers, strict=True):
                page_id, ref = (None if pd.isna(x) else int(x) for x in (page_id, ref))
                raw = gzip.compress(record_bytes(page_id, url, html.encode("utf-8"), digest, ref), mtime=0)
                if out is None or at > FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                out.write(raw)
                index.append((page_id, url, digest, "response" if ref is None else "revisit", name, at, len(raw)))
                at += len(raw)
            got = pd.DataFrame(index, columns=["page_id", "url", "payload_digest", "record_type", "file", "offset", "length"])
            yield got.astype({"page_id": "Int64"})
        if out is not None:
            out.close()

    store, top = open_store(folder)
    store.create_dir(top, recursive=True)
    return saved(told.mapInPandas(archive, INDEX))


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that the rows of ``index`` name, digested anew from the archived bytes (revisits: as recorded).

    ``index`` may be any selection of index rows; without ``payloads`` the payload column is null.
    """
    def ranges(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        begin = 0
        for i in range(1, len(rows) + 1):
            a, b = rows.iloc[begin], rows.iloc[i - 1]
            if i == len(rows) or rows["file"].iat[i] != a["file"] or rows["offset"].iat[i] - (b["offset"] + b["length"]) > GAP_BYTES \
                    or rows["offset"].iat[i] + rows["length"].iat[i] - a["offset"] > RANGE_BYTES:
                yield rows.iloc[begin:i]
                begin = i

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = open_store(folder)
        for pdf in batches:
            for part in ranges(pdf):
                first = int(part["offset"].iat[0])
                with store.open_input_file(f"{top}/{part['file'].iat[0]}") as f:
                    data = f.read_at(int(part["offset"].iat[-1] + part["length"].iat[-1]) - first, first)
                out = []
                for offset, length in zip(part["offset"], part["length"], strict=True):
                    r = parse_record(gzip.decompress(data[offset - first:offset - first + length]))
                    whole = r["payload"]
                    digest = r["digest"] if whole is None else hashlib.sha1(whole).hexdigest()
                    if whole is not None and (digest != r["digest"] or len(whole) != r["length"]):
                        raise ValueError(f"record {r['page_id']} does not match its digest")
                    out.append((r["page_id"], r["url"], r["length"], digest, r["record_type"], r["refers_to"], whole if payloads else None))
                got = pd.DataFrame(out, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
                yield got.astype({"page_id": "Int64", "refers_to": "Int64"})

    slab = F.floor(F.col("offset") / F.lit(4 * RANGE_BYTES))
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(part_count(index), -(-total // TASK_BYTES))  # by the bytes to be read: the index rows themselves are small
    return index.select("file", "offset", "length", slab.alias("slab")).repartition(tasks, "file", "slab").sortWithinPartitions("file", "offset").select(
        "file", "offset", "length").mapInPandas(fetch, RECORD)


SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS n, sha1(h) AS digest FROM p),
f AS (SELECT digest, max(page_id) AS first_id FROM d WHERE n >= {MIN_REVISIT} GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN first_id IS NOT NULL AND first_id IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
FROM d LEFT JOIN f USING (digest)"""


@query("op10_warc", SQL)
def op10(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    index = write(table(spark, sf_dir, "pages"), folder)
    return read(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
