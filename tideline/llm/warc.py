"""Web archives packed in ZIP files: written by partition, read back by range.

An archive is a ZIP file with two stored members: ``archive/data.warc.gz``, one
gzip member for each record, and ``indexes/index.cdx``, one line for each
record with its place. Readers parse the ZIP's end record (and its ZIP64 form),
the central directory and the index, and then read the byte range of each
record. Nothing is unpacked to disk.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import join_hot, shared_path, stage_table

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
# Fixed values of the ZIP format: signatures of its records, and the marker of a value kept in the ZIP64 field.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
IN_ZIP64, IN_ZIP64_SHORT = 0xFFFFFFFF, 0xFFFF


def open_store(url: str):
    """A file system and path for a URL, for local folders as for cluster stores."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(url if "://" in url or url.startswith("file:") else f"file://{url}")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def warc_record(page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit carries its HTTP head and the full payload's digest and length, and names the response."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Target-URI", " ".join((url or "").split()) or f"page:{page_id}"), ("X-Page-ID", str(page_id)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        fields += [("X-Payload-Length", str(len(payload))), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record (after its HTTP head)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


class ArchiveWriter:
    """Collects compressed records in memory, up to an archive's size, and writes one ZIP; a retried task replaces the same file as a whole."""

    def __init__(self, level: int = 1):
        self.data, self.lines, self.level = io.BytesIO(), [], level

    def add(self, page_id: int, record: bytes) -> None:
        begin = self.data.tell()
        self.data.write(gzip.compress(record, self.level, mtime=0))
        self.lines.append(json.dumps({"page_id": page_id, "offset": begin, "length": self.data.tell() - begin}))

    def close(self, url: str) -> tuple[str, int, int]:
        store, path = open_store(url)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        draft = f"{path}.{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(draft) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            for name, content in ((DATA, self.data.getbuffer()), (INDEX, "\n".join(self.lines).encode())):
                with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as member:
                    member.write(content)
        store.move(draft, path)
        return url, len(self.lines), self.data.tell()


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int


def read_directory(file, size: int, tail: int = 65_557) -> dict[str, Member]:
    """Members by name, from the central directory at a ZIP's end; only that part of the file is read."""

    def read(offset: int, length: int) -> bytes:
        file.seek(offset)
        return file.read(length)

    from_here = max(0, size - tail)
    ending = read(from_here, size - from_here)
    at = ending.rfind(END)
    if at < 0:
        raise ValueError("no end record: not a ZIP file")
    count, length, begin = struct.unpack("<HII", ending[at + 10 : at + 20])
    if IN_ZIP64_SHORT == count or IN_ZIP64 in (length, begin) or ending[max(0, at - 20) : at][:4] == LOCATOR64:
        locator = ending[at - 20 : at] if at >= 20 else read(from_here + at - 20, 20)
        (where,) = struct.unpack("<Q", locator[8:16])
        end64 = read(where, 56)
        if end64[:4] != END64:
            raise ValueError("the ZIP64 end record is not where its locator says")
        count, length, begin = struct.unpack("<QQQ", end64[32:56])
    directory, members, i = read(begin, length), {}, 0
    for _ in range(count):
        if directory[i : i + 4] != CENTRAL:
            raise ValueError("the central directory is damaged")
        method, stored, full = *struct.unpack("<H", directory[i + 10 : i + 12]), *struct.unpack("<II", directory[i + 20 : i + 28])
        n_name, n_extra, n_comment = struct.unpack("<HHH", directory[i + 28 : i + 34])
        (header,) = struct.unpack("<I", directory[i + 42 : i + 46])
        name = directory[i + 46 : i + 46 + n_name].decode()
        extra = directory[i + 46 + n_name : i + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:  # large values, in this order, for the fields that are marked
                values = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                full = values.pop(0) if full == IN_ZIP64 and values else full
                stored = values.pop(0) if stored == IN_ZIP64 and values else stored
                header = values.pop(0) if header == IN_ZIP64 and values else header
            extra = extra[4 + n :]
        members[name] = Member(name, method, stored, header)
        i += 46 + n_name + n_extra + n_comment
    return members


def member_start(file, member: Member) -> int:
    """Where a stored member's bytes begin: its local header's names and fields differ in length from the directory's."""
    if member.method:
        raise ValueError(f"{member.name} is compressed: its parts can't be read by range")
    file.seek(member.header)
    head = file.read(30)
    if head[:4] != LOCAL:
        raise ValueError(f"no local header for {member.name}")
    return member.header + 30 + sum(struct.unpack("<HH", head[26:30]))


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = 32 << 20, least_revisit: int = 0) -> DataFrame:
    """Write one WARC record for each page, and give the archives: url, records and bytes.

    Of pages with equal payloads of at least ``least_revisit`` bytes the one
    with the largest page_id is the response and others revisit it; smaller
    payloads are always responses. Rows that share a page_id are judged each by
    its own payload; of equal rows that are the response each is one. Equal
    payloads are found by their digests: the largest page_id of each is taken
    before the shuffle too, and that of a payload that very many pages have is
    broadcast to them. A null html is an empty payload;
    a null url is replaced by the page's id. Payloads may be of any length;
    other columns are ignored, and no pages give no archives.
    """
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "archives")
    pages = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    digests = pages.where(F.octet_length("html") >= least_revisit).select("page_id", "sha1")
    kept = digests.groupBy("sha1").agg(F.max("page_id").alias("first_id"), F.min("page_id").alias("least_id"), F.count("*").alias("times"))
    kept = stage_table(spark, kept.where("least_id < first_id").drop("least_id"), "payloads")
    again = join_hot(digests, kept, ["sha1"]).where("page_id < first_id").select(F.col("page_id").alias("again_id"), F.col("sha1").alias("again_sha1"), "first_id").distinct()
    known = pages.join(again, (F.col("page_id") == F.col("again_id")) & (F.col("sha1") == F.col("again_sha1")), "left").select("page_id", "url", "html", F.col("first_id").alias("refers_to"))

    def write(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, number, writer, done = TaskContext.get().partitionId(), 0, ArchiveWriter(), []
        for batch in batches:
            for page_id, url, html, refers_to in batch.itertuples(index=False):
                payload = html.encode("utf-8", "surrogatepass")
                writer.add(page_id, warc_record(page_id, url, payload, base32_sha1(payload), None if pd.isna(refers_to) else int(refers_to)))
                if writer.data.tell() >= archive_bytes:
                    done.append(writer.close(f"{folder}/part-{part:06d}-{number:04d}.wacz"))
                    number, writer = number + 1, ArchiveWriter()
        if writer.lines:
            done.append(writer.close(f"{folder}/part-{part:06d}-{number:04d}.wacz"))
        yield pd.DataFrame(done, columns=["url", "records", "bytes"])

    return stage_table(spark, known.mapInPandas(write, "url string, records long, bytes long"), "archive-list")


def locate_records(archives: DataFrame) -> DataFrame:
    """Places of all records: url, page_id, start and length in the archive file, from directories and indexes."""

    def locate(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for url in batch["url"]:
                store, path = open_store(url)
                with store.open_input_file(path) as file:
                    members = read_directory(file, file.size())
                    data = member_start(file, members[DATA])
                    file.seek(member_start(file, members[INDEX]))
                    lines = file.read(members[INDEX].size).decode().splitlines()
                entries = [json.loads(x) for x in lines]
                yield pd.DataFrame({"url": url, "page_id": [x["page_id"] for x in entries], "start": [data + x["offset"] for x in entries], "length": [x["length"] for x in entries]})

    return archives.select("url").mapInPandas(locate, "url string, page_id long, start long, length long")


RECORDS = "page_id long, target string, record_type string, payload_digest string, refers_to long, payload_bytes long, payload binary"


def read_records(places: DataFrame, archives: DataFrame, run_bytes: int = 1 << 20, task_bytes: int = 128 << 20) -> DataFrame:
    """Range-read records: page_id, target, record_type, payload_digest, refers_to, payload_bytes and payload (null for revisits).

    Places are dealt out by stretches of their file, to as many tasks as the
    archives' bytes need at ``task_bytes`` each and Spark runs at once. Records that lie side by side
    in a file are fetched in runs of up to ``run_bytes``. The size of a
    revisit's full payload is the one that its record states, or null. A
    response whose payload doesn't fit its digest is an error.
    """
    total = archives.agg(F.sum("bytes")).first()[0] or 0

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for url, own in batch.sort_values("start").groupby("url"):
                store, path = open_store(url)
                rows, run, begin = [], b"", -1
                with store.open_input_file(path) as file:
                    last = int((own["start"] + own["length"]).max())
                    for start, length in zip(own["start"], own["length"], strict=True):
                        if not begin <= start <= start + length <= begin + len(run):
                            file.seek(start)
                            run, begin = file.read(max(length, min(run_bytes, last - start))), start
                        fields, payload = parse_record(zlib.decompress(run[start - begin : start - begin + length], 31))
                        digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                        if kind == "response" and base32_sha1(payload) != digest:
                            raise ValueError(f"{url}: the payload at {start} doesn't fit its digest")
                        again, stated = fields.get("X-Refers-To-Page"), fields.get("X-Payload-Length")
                        full = len(payload) if kind == "response" else int(stated) if stated else None
                        rows.append((int(fields["X-Page-ID"]), fields["WARC-Target-URI"], kind, digest, int(again) if again else None, full, None if kind == "revisit" else payload))
                        if len(rows) >= 500:
                            yield _frame(rows)
                            rows = []
                yield _frame(rows)

    dealt = places.repartition(max(places.sparkSession.sparkContext.defaultParallelism, total // task_bytes), "url", F.floor(F.col("start") / run_bytes))
    return dealt.mapInPandas(read, RECORDS)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "target", "record_type", "payload_digest", "refers_to", "payload_bytes", "payload"])
    return out.astype({"refers_to": "Int64", "payload_bytes": "Int64"})
