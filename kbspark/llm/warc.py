"""WARC archives: records written with an index, revisits for equal payloads, and reads by byte range.

Every task writes one archive file and returns an index row per record: file, offset, length, URL and
digest. A record is a gzip member of its own, so it can be read alone. The index is kept as a table. A reader selects index rows, sorts them by place, joins neighbouring
byte ranges into one read each, and cuts the records out of what it read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.shared import shared_dir, written

#: A smaller gap between two records is read along with them; one read is at most so many bytes.
GAP, MOST = 1 << 16, 8 << 20
#: Repeated payloads (a digest and an id each) that are broadcast; tasks that the rows of one digest are dealt to beyond.
BROADCAST_ROWS, SALTS = 200_000, 32
#: Bytes of archives that a task reads, and from TASKS tasks on.
READ_BYTES, READ_BYTES_MOST, TASKS = 2 << 20, 128 << 20, 4096
INDEX = "file string, offset long, length long, url string, page_id long, record_type string, payload_digest string, refers_to long"


def _open(path: str, mode: str):
    """A file on whatever file system the path names."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    if mode == "w":
        system.create_dir(name.rpartition("/")[0], recursive=True)
        return system.open_output_stream(name, compression=None)
    return system.open_input_file(name)


def _id(page_id) -> str:
    return "urn:kb:none" if page_id is None else f"urn:kb:{page_id}"


def record(page_id, url: str | None, record_type: str, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One WARC/1.1 record: a response has the payload as its block, a revisit has no block."""
    block = payload if record_type == "response" else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: <{_id(page_id)}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *(["WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A")] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_id(refers_to)}>"] if record_type == "revisit" else []),
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; ValueError if it is not whole."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {data[:40]!r}")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    n = int(headers["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("the record has another length than its header says")
    return headers, rest[:n]


def revisits(pages: DataFrame, least: int = 1000, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """pages(page_id, url, html) with payload_digest, record_type and refers_to.

    Of rows with equal payloads of at least `least` bytes the one with the largest page_id is the response
    (every row of that page_id, if it is repeated), and the others revisit it; smaller payloads are all
    responses. A null html is an empty payload. A row of null page_id is the response of its payload only if all
    of the payload's rows are; then each of them is.

    Payloads that occur more than once are counted first, by digest and id alone. Up to BROADCAST_ROWS of them are
    broadcast, and no payload is shuffled. More are joined by digest and one of SALTS numbers, so that the rows of
    one digest are dealt out over as many tasks.
    """
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.sha1(body).alias("payload_digest"), (F.octet_length(body) >= least).alias("large"))
    first = written(rows.where("large").groupBy("payload_digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).where("n > 1").drop("n"))
    own = F.coalesce(F.col("page_id") == F.col("response_id"), F.col("response_id").isNull())
    if first.count() <= broadcast_rows:
        out = rows.join(F.broadcast(first), "payload_digest", "left")
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
        out = salted.join(first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).cast("long")), ["payload_digest", "salt"], "left")
    return out.select("page_id", "url", "html", "payload_digest", F.when(own, "response").otherwise("revisit").alias("record_type"), F.when(~own, F.col("response_id")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes the rows of revisits() to WARC files in folder, one a task, and returns their index.

    A task that is run again writes a file of another name; the index, a table in the shared folder, names
    the files of the tasks that counted.
    """

    def write(batches):
        path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        offset, out = 0, None
        for pdf in batches:
            made = []
            for page_id, url, html, digest, kind, refers in zip(*(pdf[c] for c in ("page_id", "url", "html", "payload_digest", "record_type", "refers_to"))):
                page_id, refers = (None if pd.isna(x) else int(x) for x in (page_id, refers))
                data = gzip.compress(record(page_id, url, kind, (html or "").encode(), digest, refers), 6, mtime=0)
                out = out or _open(path, "w")
                out.write(data)
                made.append((path, offset, len(data), url, page_id, kind, digest, refers))
                offset += len(data)
            if made:
                yield pd.DataFrame(made, columns=[c.split()[0] for c in INDEX.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})
        if out:
            out.close()

    # ids as strings: pandas would turn nullable integers into floats
    return written(rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")}).mapInPandas(write, INDEX))


def coalesced(spans: list[tuple[int, int]], gap: int = GAP, most: int = MOST) -> list[tuple[int, int, list[int]]]:
    """(start, end, indexes of the spans inside) for sorted (offset, length) spans joined over small gaps."""
    out: list[tuple[int, int, list[int]]] = []
    for i, (offset, length) in enumerate(spans):
        if out and offset - out[-1][1] <= gap and offset + length - out[-1][0] <= most:
            start, end, inside = out[-1]
            out[-1] = (start, max(end, offset + length), inside)
            inside.append(i)
        else:
            out.append((offset, offset + length, [i]))
    return out


def read_records(index: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload binary) of the records that the index rows name.

    The index rows are dealt out by place, so a large file is shared by several tasks, and sorted; each
    task joins neighbouring ranges and reads them one by one. A revisit has a null payload; its
    payload_bytes and digest are those of the payload it stands for. A response whose payload does not
    have the digest of its header is an error.
    """

    def read(batches):
        for pdf in batches:
            for path, part in pdf.groupby("file", sort=False):
                spans = list(zip(part["offset"].tolist(), part["length"].tolist()))
                with _open(path, "r") as f:
                    for start, end, inside in coalesced(spans):
                        f.seek(start)
                        data, made = f.read(end - start), []
                        for i in inside:
                            at = spans[i][0] - start
                            headers, block = parse(gzip.decompress(data[at : at + spans[i][1]]))
                            digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                            if kind == "response" and hashlib.sha1(block).hexdigest() != digest:
                                raise ValueError(f"{path} at {spans[i][0]}: the payload has another digest")
                            ids = [None if x is None or x.endswith(":none>") else int(x[8:-1]) for x in (headers["WARC-Record-ID"], headers.get("WARC-Refers-To"))]
                            made.append((ids[0], headers.get("WARC-Target-URI"), kind, digest, int(headers["X-Payload-Length"]), ids[1], block if kind == "response" else None))
                        yield pd.DataFrame(made, columns=["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, min(-(-size // READ_BYTES), max(TASKS, -(-size // READ_BYTES_MOST))))
    dealt = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInPandas(read, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")


def archive(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes the pages as WARC files under the shared folder; returns the index table."""
    return write_archives(revisits(pages, least), shared_dir(pages.sparkSession))
