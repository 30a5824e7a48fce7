"""Deterministic sharded WARC archives of pages, and their reader.

Pages are range-sorted by id into shards of about equal bytes; the ranges come from a sample
chosen by a hash of the ids, so reruns and other partitionings give the same files. A task
writes its shards one record (one gzip member) at a time and rolls to the next file before the
compressed size would pass ``roll_bytes``. Headers, record ids, dates and digests are regenerated
from the payload. Files are written under ``_temporary/<attempt>``; only the attempt whose manifest
rows Spark committed is renamed into place, and the manifest, itself renamed last, names the files
a reader may open. A lost executor leaves at most unnamed temporary files.

Of records with equal payloads of at least ``least`` bytes the one with the smallest id is a
response and the others are revisits to it.

Defined results: a null payload counts as empty; a null url becomes ``urn:page:<id>``; rows that
repeat both id and payload are a response and revisits to it; a null id sorts first, is never
referred to, and revisits a twin that has an id; an empty table gives an archive without files.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from warmgrid.llm.common import Stored, bounded, delete, range_block, shared_folder

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LOWEST = -(1 << 63)
SALT = 16
MANIFEST = "shard int, seq int, name string, temporary string, sha256 string, size long, records long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}:{digest}')}>"


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member; equal input gives equal bytes."""
    lines = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    target = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url) if url else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    own = record_id(page_id, digest) if refers_to != page_id or refers_to is None else f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'again:{page_id}:{digest}')}>"
    headers = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("X-Page-Id", "" if page_id is None else str(page_id))]
    if refers_to is None:
        return record("response", headers, http + payload)
    return record("revisit", [*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to))], http)


class ShardFiles:
    """Files of the shards one task attempt writes, rolled by compressed size."""

    def __init__(self, folder: str, roll_bytes: int):
        self.fs, base = filesystem(folder)
        self.temporary = f"_temporary/{uuid.uuid4().hex}"
        self.base, self.roll = base, roll_bytes
        self.fs.create_dir(f"{base}/{self.temporary}", recursive=True)
        self.shard, self.out, self.done = None, None, []

    def _open(self) -> None:
        self.name = f"pages-{self.shard:06d}-{self.seq:05d}.warc.gz"
        self.out = self.fs.open_output_stream(f"{self.base}/{self.temporary}/{self.name}")
        self.sha, self.size, self.records = hashlib.sha256(), 0, 0
        info = f"software: warmgrid\r\nformat: WARC File Format 1.1\r\nisPartOf: {self.name}\r\n".encode()
        self._put(record("warcinfo", [("WARC-Record-ID", record_id(None, self.name)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))

    def _put(self, member: bytes) -> None:
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.shard, self.seq, self.name, f"{self.temporary}/{self.name}", self.sha.hexdigest(), self.size, self.records))
            self.out = None

    def add(self, shard: int, member: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.seq = shard, 0
        elif self.out is not None and self.size + len(member) > self.roll and self.records:
            self.close()
            self.seq += 1
        if self.out is None:
            self._open()
        self._put(member)
        self.records += 1


def _payload(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def first_copies(ids: DataFrame, least: int) -> DataFrame:
    """(page_id, digest, refers_to) of the records whose payload a smaller id holds too.

    A digest can be that of a third of all pages, so it is counted with map-side
    aggregation and the copies are joined back over salted keys.
    """
    large = ids.where(F.col("bytes") >= least)
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("first").isNotNull()).drop("n")
    spread = first.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALT)])))
    salted = large.select("page_id", "digest", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int").alias("salt"))
    copies = salted.join(spread, ["digest", "salt"]).where(~F.col("page_id").eqNullSafe(F.col("first")))
    return copies.select("page_id", "digest", F.col("first").alias("refers_to")).distinct()


def shard_edges(ids: DataFrame, shard_bytes: int, most: int = 100_000) -> np.ndarray:
    """Ids where a new shard begins; from at most about ``most`` ids, chosen by their hash."""
    n, total = ids.agg(F.count("page_id"), F.sum("bytes")).first()
    if not n or total <= shard_bytes:
        return np.zeros(0, np.int64)
    step = -(-n // most)
    rows = ids.where(F.col("page_id").isNotNull() & (F.pmod(F.xxhash64("page_id", F.lit(1)), F.lit(step)) == 0)).select("page_id", "bytes").collect()
    key = np.array([r[0] for r in rows], np.int64)
    order = np.argsort(key, kind="stable")
    part = np.cumsum(np.array([r[1] for r in rows], float)[order])
    if not len(part):
        return np.zeros(0, np.int64)
    shards = int(-(-total // shard_bytes))
    return np.unique(key[order][np.searchsorted(part, part[-1] * np.arange(1, shards) / shards)])


def write_archive(pages: DataFrame, folder: str, least: int = 100, roll_bytes: int = 16 << 20, shard_bytes: int = 32 << 20) -> str:
    """Write ``pages`` (page_id, url, html) as WARC files and a manifest under ``folder``; returns the manifest's path."""
    spark = pages.sparkSession
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", _payload(F.col("html")).alias("payload")).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    ids = Stored(base.select("page_id", "digest", F.octet_length("payload").cast("long").alias("bytes")), "warc-ids")
    edges = shard_edges(ids.df, shard_bytes)
    shard = range_block(F.coalesce("page_id", F.lit(LOWEST)), edges)
    names = ["shard", "page_id", "digest", "refers_to", "page", "url", "payload"]
    rows = base.withColumns({"shard": shard, "refers_to": F.lit(None).cast("long"), "page": F.lit(True)}).select(*names)
    marks = first_copies(ids.df, least).withColumns({"shard": shard, "page": F.lit(False), "url": F.lit(None).cast("string"), "payload": F.lit(None).cast("binary")}).select(*names)
    # a mark comes just before the record it turns into a revisit
    dealt = rows.unionByName(marks).repartition(len(edges) + 1, "shard").sortWithinPartitions("shard", "page_id", "digest", "page", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, mark, before = None, None, None
        for b in bounded(batches, "payload"):
            files = files or ShardFiles(folder, roll_bytes)
            for at, page_id, digest, refers_to, page, url, payload in zip(*[b.column(c).to_pylist() for c in names]):
                key = (at, page_id, digest)
                if not page:
                    mark = (key, refers_to)
                    continue
                to = mark[1] if mark and mark[0] == key else None
                if to is None and key == before and page_id is not None and len(payload) >= least:
                    to = page_id
                before = key
                files.add(at, page_record(page_id, url, payload, digest.hex(), to))
        if files:
            files.close()
            yield pa.RecordBatch.from_pandas(pd.DataFrame(files.done, columns=["shard", "seq", "name", "temporary", "sha256", "size", "records"]).astype({"shard": "int32", "seq": "int32"}), preserve_index=False)

    # written once by Spark's own commit: the rows of exactly one attempt of each task
    written = Stored(dealt.mapInArrow(write, MANIFEST), "warc-written")
    ids.drop()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = filesystem(folder)
        for rows in batches:
            for t, name in zip(rows["temporary"], rows["name"]):
                if fs.get_file_info(f"{base}/{t}").type != pafs.FileType.NotFound:
                    fs.move(f"{base}/{t}", f"{base}/{name}")
            yield rows

    placed = written.df.repartition(8, "name").mapInPandas(place, MANIFEST)
    placed.drop("temporary").write.parquet(f"{folder}/_manifest.tmp")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/_manifest.tmp")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(path, jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest"))
    delete(spark, f"{folder}/_temporary")
    written.drop()
    return f"{folder}/manifest"


def parse(text: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one inflated record."""
    head, _, rest = text.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def members(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file of gzip members."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, text = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("truncated record")
            part = view[at : at + (1 << 14)]
            text.append(z.decompress(part))
            at += len(part) - len(z.unused_data)
        yield parse(b"".join(text))


def page_of(headers: dict[str, str], block: bytes) -> tuple | None:
    """READ's columns of a page record, checked against its digests; None for other records."""
    kind = headers["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    whole = hashlib.sha256(block).hexdigest() == headers["WARC-Block-Digest"].removeprefix("sha256:")
    size = int(dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:])[b"Content-Length"])
    own = headers["X-Page-Id"]
    if kind == "response":
        digest = hashlib.sha256(payload).hexdigest()
        return (int(own) if own else None, len(payload), digest, kind, None, whole and digest == stated and size == len(payload))
    return (int(own) if own else None, size, stated, kind, int(headers["X-Refers-To-Page-Id"]), whole)


def read_archive(spark: SparkSession, folder: str, tasks: int | None = None) -> DataFrame:
    """The page records of the files the manifest names, one row each; a file is held by one task at a time."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    tasks = tasks or max(spark.sparkContext.defaultParallelism, 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        for b in batches:
            for name, sha in zip(b.column("name").to_pylist(), b.column("sha256").to_pylist()):
                with fs.open_input_stream(f"{base}/{name}") as f:
                    data = f.read()
                sound = hashlib.sha256(data).hexdigest() == sha
                rows = [p for p in (page_of(h, block) for h, block in members(data)) if p]
                columns = list(zip(*rows)) or [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)] + [pa.array([sound and x for x in columns[5]], pa.bool_())], [x.split()[0] for x in READ.split(", ")])

    return manifest.select("name", "sha256").repartition(max(tasks, min(manifest.count(), 10_000))).mapInArrow(read, READ)


def archive_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
