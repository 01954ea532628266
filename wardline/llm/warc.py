"""WARC records in ZIP packages, written and read back by byte range.

A package is a ZIP of stored (uncompressed) members: ``archive/data.warc.gz`` (one gzip member for
each record), ``indexes/index.cdxj`` (one line for each record: offset, length) and a small
description.  The reader parses the end-of-directory record, its ZIP64 form and the central
directory itself, finds where stored members begin, reads the index, and then reads single records
by range; nothing is extracted.  Files go through ``pyarrow.fs`` so that any store with a
file-system URI serves.

Defined cases: null html is an empty payload; a payload that occurs again is a revisit of the
smallest page_id that has it, and rows which share that page_id are all responses; a row with null
page_id is a response only if its payload has no other id; payloads below ``min_bytes`` are always
responses; an empty table gives no package and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import save, shared_folder

DATA, INDEX, ABOUT = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
#: ZIP signatures, ZIP64 marks and the ZIP64 extra field's id: fixed values of the format.
CENTRAL, LOCAL, END, END64, LOCATOR64 = b"PK\x01\x02", b"PK\x03\x04", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
MARK32, MARK16, EXTRA64 = 0xFFFFFFFF, 0xFFFF, 1
WHOLE = 8 << 20  # adjacent records are read together up to so many bytes


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- writing


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit whose block keeps only the HTTP header of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest32(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "").replace("\n", ""))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class PackageWriter:
    """One ZIP at ``path``, written under another name and moved there when complete."""

    def __init__(self, path: str, attempt: int):
        self.fs, self.path = pafs.FileSystem.from_uri(path)
        self.fs.create_dir(self.path.rpartition("/")[0])
        self.part = f"{self.path}.{attempt}.part"
        self.out = self.fs.open_output_stream(self.part)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.size, self.index = 0, []

    def add(self, record: bytes) -> None:
        packed = gzip.compress(record, 5, mtime=0)
        self.data.write(packed)
        self.index.append(f"{self.size} {len(packed)}")
        self.size += len(packed)

    def close(self) -> int:
        self.data.close()
        self.zip.writestr(INDEX, "\n".join(self.index))
        self.zip.writestr(ABOUT, json.dumps({"profile": "data-package", "records": len(self.index)}))
        self.zip.close()
        self.out.close()
        self.fs.move(self.part, self.path)
        return len(self.index)


def write_packages(pages: DataFrame, folder: str, min_bytes: int = 0, package_bytes: int = 256 << 20) -> DataFrame:
    """Write (page_id, url, html) as packages below ``folder``; returns (path, records)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select("page_id", "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("sha1"))
    firsts = pages.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.where("n > 1 AND first_id IS NOT NULL").drop("n")
    firsts = save(firsts)  # joined as written, so that a payload of many copies can be split
    again = (F.octet_length("html") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    ids = pages.join(firsts, "sha1").where(again).groupBy("sha1", "page_id").agg(F.first("first_id").alias("refers_to"))
    ids = ids.withColumnsRenamed({"sha1": "of", "page_id": "again"})  # pages meet by id, copies of a payload apart
    rows = pages.join(ids, (F.col("sha1") == F.col("of")) & F.col("page_id").eqNullSafe(F.col("again")), "left")
    rows = rows.select("page_id", "url", "html", "refers_to")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, writer, made, k = TaskContext.get(), None, [], 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(batch.page_id.tolist(), batch.url, batch.html, batch.refers_to.tolist(), strict=True):
                if writer is None:
                    writer = PackageWriter(f"{folder}/part-{task.partitionId():06d}-{k:04d}.wacz", task.taskAttemptId())
                ids = [None if pd.isna(x) else int(x) for x in (page_id, refers_to)]
                writer.add(encode_record(ids[0], url, html.encode("utf-8", "replace"), ids[1]))
                if writer.size >= package_bytes:
                    made.append((f"{folder}/part-{task.partitionId():06d}-{k:04d}.wacz", writer.close()))
                    writer, k = None, k + 1
        if writer is not None:
            made.append((f"{folder}/part-{task.partitionId():06d}-{k:04d}.wacz", writer.close()))
        yield pd.DataFrame(made, columns=["path", "records"]).astype({"records": "int64"})

    # ids as text: pandas would make doubles of nullable longs
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return save(rows.mapInPandas(write, "path string, records long"))


# ---------------------------------------------------------------- reading


def read_at(file, at: int, n: int) -> bytes:
    file.seek(at)
    return file.read(n)


def directory(file, size: int) -> tuple[int, int, int]:
    """(offset, bytes, entries) of the central directory, from the ZIP64 end record where marked."""
    tail_at = max(0, size - 22 - MARK16)
    tail = read_at(file, tail_at, size - tail_at)
    k = tail.rfind(END)
    if k < 0:
        raise ValueError("no end of central directory")
    entries, length, offset = struct.unpack_from("<HII", tail, k + 10)
    if MARK16 == entries or MARK32 in (length, offset):
        at = tail_at + k - 20
        locator = read_at(file, at, 20) if at >= 0 else b""
        if locator[:4] == LOCATOR64:
            end64 = read_at(file, struct.unpack_from("<Q", locator, 8)[0], 56)
            if end64[:4] != END64:
                raise ValueError("no ZIP64 end record where the locator points")
            entries, length, offset = struct.unpack_from("<QQQ", end64, 32)
    return offset, length, entries


def members(file, size: int) -> dict[str, tuple[int, int]]:
    """Where the bytes of each stored member begin and how many they are."""
    offset, length, entries = directory(file, size)
    block, at, found = read_at(file, offset, length), 0, {}
    for _ in range(entries):
        if block[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", block, at + 10)
        packed, plain, n_name, n_extra, n_note, _, _, _, local = struct.unpack_from("<IIHHHHHII", block, at + 20)
        name = block[at + 46 : at + 46 + n_name].decode()
        extra, e = block[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, e)
            if kind == EXTRA64:  # holds, in this order, only the fields that are marked
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                plain = next(wide) if plain == MARK32 else plain
                packed = next(wide) if packed == MARK32 else packed
                local = next(wide) if local == MARK32 else local
            e += 4 + n
        at += 46 + n_name + n_extra + n_note
        if method == zipfile.ZIP_STORED:
            head = read_at(file, local, 30)
            if head[:4] != LOCAL:
                raise ValueError("no local header where the directory points")
            found[name] = (local + 30 + sum(struct.unpack_from("<HH", head, 26)), packed)
    return found


def decode_record(raw: bytes) -> dict:
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    own = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    number = lambda x: int(x[10:-1]) if x and len(x) > 11 else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and digest32(payload) != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": int(own["Content-Length"]), "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def read_index(packages: DataFrame) -> DataFrame:
    """(path, at, n) of every record, from the index member of each package."""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                store, inner = pafs.FileSystem.from_uri(path)
                with store.open_input_file(inner) as file:
                    where = members(file, file.size())
                    begin, n = where[INDEX]
                    lines = io.BytesIO(read_at(file, begin, n)).read().decode().split("\n")
                pairs = [tuple(map(int, x.split(" "))) for x in lines if x]
                yield pd.DataFrame({"path": path, "at": [where[DATA][0] + a for a, _ in pairs], "n": [b for _, b in pairs]}).astype({"path": "str", "at": "int64", "n": "int64"})

    return packages.select("path").mapInPandas(entries, "path string, at long, n long")


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Range-read and parse the records at (path, at, n); neighbours are read together."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 7 if payloads else 6]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, part in batch.groupby("path", sort=False):
                part = part.sort_values("at")
                store, inner = pafs.FileSystem.from_uri(path)
                rows, have, got = [], 0, b""
                with store.open_input_file(inner) as file:
                    spans = list(zip(part["at"].tolist(), part["n"].tolist(), strict=True))
                    for i, (at, n) in enumerate(spans):
                        if at < have or at + n > have + len(got):
                            stop = at + n
                            for a, m in spans[i + 1 :]:
                                if a != stop or stop + m - at > WHOLE:
                                    break
                                stop += m
                            have, got = at, read_at(file, at, stop - at)
                        rows.append(decode_record(gzip.decompress(got[at - have : at - have + n])))
                        if len(rows) >= 500:
                            yield frame(rows, names)
                            rows = []
                if rows:
                    yield frame(rows, names)

    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return index.mapInPandas(read, ", ".join(kinds.split(", ")[: len(names)]))


def frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as packages in the shared folder and read every record back."""
    packages = write_packages(pages, shared_folder(spark), min_bytes)
    return read_records(read_index(packages), payloads=False)
