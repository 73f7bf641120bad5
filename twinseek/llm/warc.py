"""WARC archives: a deterministic sharded writer, and a reader.

Records stand in order of page id (null last), payload digest and url. Cuts of that order come from a sample drawn by hash with
chances in proportion to size, so they depend on the rows alone; each shard between two cuts is one sorted partition, written as
a row of files of bounded compressed size. Headers, record names, digests and gzip members follow from the rows, dates are
given: the same pages give the same bytes, however they were partitioned before, and a task that runs again writes them again.

A file is written under a temporary name and renamed when it is whole. What a finished job wrote is listed in a manifest (name, records,
bytes, digest), itself written under a temporary name and renamed at last. Readers read what the manifest lists and nothing else.

Of the records with equal payloads of LEAST bytes or more, the first in order is a response, all others are revisits without payload that
refer to it. Only digests, sizes and ids are compared to find them; the payloads are shuffled once, into their shards, where a
note per shared key meets them.

Workers hold one record at a time. They write and read through `pyarrow.fs`, so the folder must be one that it can open.

Defined cases: a null payload is an empty one; a null url is written as `about:blank`, other than printable ASCII is percent-encoded
in it; a null page id is written as none; of rows alike in id and payload one is the first; rows of one id and different payloads
are records of their own; an empty table gives an empty manifest and no rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinseek.llm.common import stored

# Payloads of fewer bytes are never replaced by a revisit.
LEAST = 100
# Payload bytes of a shard, shards at most, sampled keys of a shard, and compressed bytes after which a file is full.
SHARD_BYTES, MOST_SHARDS, SAMPLED, FILE_BYTES = 32 << 20, 4096, 16, 128 << 20
# Bytes that a record counts for besides its payload, and what is read or compressed at a time.
OVERHEAD, READ = 512, 1 << 20
DATE = "1970-01-01T00:00:00Z"
# Version line, profile of a revisit, digits of a page id as a key and the key of none.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DIGITS, NO_ID = 16, "g" * 16
MANIFEST = "file string, records long, bytes long, sha256 string"
RECORD = "record string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers string"


def record_name(key: str, number: int) -> str:
    """Name of the record of a key; rows alike in id and payload are numbered."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{key}:{number}'.encode()).digest())}>"


def _key(page_id, digest):
    """Text in the order of (page id, digest), null last."""
    number = F.lpad(F.hex(page_id.bitwiseXOR(F.lit(-(1 << 63)))), DIGITS, "0")
    return F.concat(F.coalesce(number, F.lit(NO_ID)), digest)


def _head(name: str, kind: str, length: int, block: str, more: list[tuple[str, str]], date: str) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}"]
    lines += [f"{k}: {v}" for k, v in more]
    lines += [f"WARC-Block-Digest: sha256:{block}", f"Content-Length: {length}", "", ""]
    return "\r\n".join(lines).encode()


class _File:
    """One archive under its temporary name: every record is a gzip member of its own."""

    def __init__(self, system: fs.FileSystem, root: str, name: str, date: str):
        self.system, self.path, self.name, self.date = system, f"{root}/{name}", name, date
        self.temporary = f"{root}/_temporary/{uuid.uuid4().hex}"
        self.out = system.open_output_stream(self.temporary, compression=None)
        self.bytes, self.records, self.digest = 0, 0, hashlib.sha256()
        about = b"software: twinseek\r\nformat: WARC File Format 1.1\r\n"
        self.add(record_name(name, 0), "warcinfo", [about], [("WARC-Filename", name), ("Content-Type", "application/warc-fields")])
        self.records = 0

    def add(self, name: str, kind: str, block: list[bytes], more: list[tuple[str, str]]) -> None:
        digest = hashlib.sha256()
        for part in block:
            digest.update(part)
        head = _head(name, kind, sum(map(len, block)), digest.hexdigest(), more, self.date)
        member = zlib.compressobj(6, zlib.DEFLATED, 31)
        for part in (head, *block, b"\r\n\r\n"):
            for start in range(0, len(part), READ):
                self._write(member.compress(part[start : start + READ]))
        self._write(member.flush())
        self.records += 1

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.digest.update(data)
        self.bytes += len(data)

    def close(self) -> dict:
        self.out.close()
        self.system.move(self.temporary, self.path)
        return {"file": self.name, "records": self.records, "bytes": self.bytes, "sha256": self.digest.hexdigest()}


def _record(file: _File, row: dict, number: int, first: int | None, shared: bool) -> None:
    payload, digest, key = row["payload"], row["digest"], row["key"]
    revisit = shared and (row["page_id"] != first or number > 0)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    url = row["url"]
    more = [("WARC-Target-URI", "about:blank" if url is None else quote(url, safe="".join(map(chr, range(33, 127)))))]
    if row["page_id"] is not None:
        more.append(("Page-Id", str(row["page_id"])))
    more += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if revisit:
        of = NO_ID if first is None else f"{first + (1 << 63):0{DIGITS}X}"
        more += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_name(of + digest, 0))]
    file.add(record_name(key, number), "revisit" if revisit else "response", [http] if revisit else [http, payload], more)


def _writer(folder: str, file_bytes: int, date: str):
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(f"{root}/_temporary", recursive=True)
        kinds = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
        file: _File | None = None
        shard, part, key, number, first, shared = -1, 0, None, 0, None, False
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    noted, first = row["key"], row["page_id"]
                    key, number, shared = noted, 0, True
                    continue
                if row["key"] != key:
                    key, number, shared = row["key"], 0, False
                if file is not None and (row["shard"] != shard or file.bytes >= file_bytes):
                    yield pa.RecordBatch.from_pylist([file.close()], kinds)
                    file = None
                if file is None:
                    part = part + 1 if row["shard"] == shard else 0
                    shard = row["shard"]
                    file = _File(system, root, f"shard-{shard:05d}-{part:05d}.warc.gz", date)
                _record(file, row, number, first, shared)
                number += 1
        if file is not None:
            yield pa.RecordBatch.from_pylist([file.close()], kinds)

    return written


def cuts(light: DataFrame, shard_bytes: int = SHARD_BYTES) -> list[str]:
    """Keys at which shards begin. At most SAMPLED keys a shard are expected on the driver."""
    weight = F.col("size") + OVERHEAD
    total = light.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    shards = min(MOST_SHARDS, -(-total // shard_bytes))
    if shards < 2:
        return []
    drawn = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1 << 40)) < weight * F.lit((SAMPLED * shards << 40) / total)
    keys = sorted(r[0] for r in light.filter(drawn).select("key").collect())
    return sorted(set(keys[SAMPLED // 2 :: SAMPLED][1:]))


def _committed(spark: SparkSession, source: str, target: str) -> None:
    """Rename the finished manifest; there is one per folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    system = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(path(target)) or not system.rename(path(source), path(target)):
        raise FileExistsError(f"{target} was committed before")


def write(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES, date: str = DATE) -> None:
    """Archives of (page_id, url, html) and their manifest in a folder that has none yet."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    known = page.withColumn("digest", F.sha2("payload", 256)).withColumn("key", _key(F.col("page_id"), F.col("digest")))
    light = stored(known.select("page_id", "digest", "key", F.octet_length("payload").cast("long").alias("size")), "page-keys")
    begins = cuts(light, shard_bytes)

    def shard_of(keys: pa.Array) -> pa.Array:
        return pa.array([bisect_right(begins, k) for k in keys.to_pylist()], pa.int32())

    shard = F.arrow_udf(shard_of, "int")(F.col("key")).alias("shard")
    shared = (
        light.filter(F.col("size") >= LEAST)
        .groupBy(F.col("digest").alias("d"))
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter(F.col("n") > 1)
    )
    notes = light.join(shared, F.col("digest") == F.col("d")).select("key", "first").distinct()
    none = F.lit(None)
    rows = known.select(shard, "key", F.lit(1).alias("kind"), "page_id", "url", "payload", "digest").unionByName(
        notes.select(
            shard, "key", F.lit(0).alias("kind"), F.col("first").alias("page_id"), none.cast("string").alias("url"),
            none.cast("binary").alias("payload"), none.cast("string").alias("digest"),
        )
    )
    dealt = rows.repartitionById(len(begins) + 1, "shard").sortWithinPartitions("shard", "key", "kind", "url")
    temporary = f"{folder}/_manifest-{uuid.uuid4().hex}"
    dealt.mapInArrow(_writer(folder, file_bytes, date), MANIFEST).write.parquet(temporary)
    _committed(pages.sparkSession, temporary, f"{folder}/manifest")


class _Stream:
    """The decompressed bytes of a file of gzip members, with its compressed size and digest."""

    def __init__(self, source: BinaryIO):
        self.source, self.held = source, bytearray()
        self.member = zlib.decompressobj(31)
        self.bytes, self.digest = 0, hashlib.sha256()

    def _more(self) -> bool:
        data = self.source.read(READ)
        self.bytes += len(data)
        self.digest.update(data)
        if not data:
            return False
        while data:
            self.held += self.member.decompress(data)
            data = self.member.unused_data
            if self.member.eof:
                self.member = zlib.decompressobj(31)
        return True

    def head(self) -> dict[str, str] | None:
        """Named fields of the next record, None behind the last one."""
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.held:
                    raise ValueError("an archive ends inside a record")
                return None
        lines = bytes(self.held[:end]).decode().split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"no record begins with {lines[0]!r}")
        del self.held[: end + 4]
        return dict(line.split(": ", 1) for line in lines[1:])

    def block(self, length: int) -> bytes:
        while len(self.held) < length + 4:
            if not self._more():
                raise ValueError("an archive ends inside a record")
        data = bytes(self.held[:length])
        if self.held[length : length + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        del self.held[: length + 4]
        return data


def _parsed(source: BinaryIO, file: dict, with_payload: bool) -> Iterator[dict]:
    """The records of one listed file, checked against their digests and the manifest."""
    stream, records = _Stream(source), 0
    while (head := stream.head()) is not None:
        block = stream.block(int(head["Content-Length"]))
        if f"sha256:{hashlib.sha256(block).hexdigest()}" != head["WARC-Block-Digest"]:
            raise ValueError(f"{file['file']}: {head['WARC-Record-ID']} is damaged")
        kind = head["WARC-Type"]
        if kind == "warcinfo":
            continue
        records += 1
        payload = block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else None
        digest = head["WARC-Payload-Digest"].removeprefix("sha256:") if payload is None else hashlib.sha256(payload).hexdigest()
        if head["WARC-Payload-Digest"] != f"sha256:{digest}":
            raise ValueError(f"{file['file']}: the payload of {head['WARC-Record-ID']} is damaged")
        yield {
            "record": head["WARC-Record-ID"],
            "page_id": int(head["Page-Id"]) if "Page-Id" in head else None,
            "url": head["WARC-Target-URI"],
            "record_type": kind,
            "payload_bytes": None if payload is None else len(payload),
            "payload_digest": digest,
            "refers": head.get("WARC-Refers-To"),
        } | ({"payload": payload} if with_payload else {})
    if (records, stream.bytes, stream.digest.hexdigest()) != (file["records"], file["bytes"], file["sha256"]):
        raise ValueError(f"{file['file']} is not the file that the manifest lists")


def _reader(folder: str, with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        kinds = pa.schema([(f.split()[0], pa.int64() if f.endswith("long") else pa.string()) for f in RECORD.split(", ")])
        if with_payload:
            kinds = kinds.append(pa.field("payload", pa.binary()))
        for batch in batches:
            for file in batch.to_pylist():
                held, size = [], 0
                with system.open_input_stream(f"{root}/{file['file']}", compression=None) as source:
                    for record in _parsed(source, file, with_payload):
                        held.append(record)
                        size += OVERHEAD + len(record.get("payload") or b"")
                        if size >= READ:
                            yield pa.RecordBatch.from_pylist(held, kinds)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, kinds)

    return read


def read(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of all files that the manifest lists, as written: a revisit has neither payload nor size."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    schema = RECORD + (", payload binary" if with_payload else "")
    return files.repartition(max(1, files.count()), "file").mapInArrow(_reader(folder, with_payload), schema)


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: revisits with what they refer to.

    `records` should be a stored table; it is read twice.
    """
    of = records.filter(F.col("record_type") == "response").select(
        F.col("record").alias("of"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d")
    )
    joined = records.join(of, F.col("refers") == F.col("of"), "left")
    broken = F.col("refers").isNotNull() & ~F.equal_null("payload_digest", "d")
    size = F.when(broken, F.raise_error(F.concat(F.lit("no payload for "), "record")).cast("long")).otherwise(F.coalesce("payload_bytes", "n"))
    return joined.select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
