"""Deterministic sharded WARC archives.

``write`` range-sorts records by key, cuts them into shards by payload bytes, and writes each shard
as gzip members, rolling to a new file when the compressed size is reached. Headers and digests are
regenerated: record ids are name-based, the date is a parameter, so the same rows give the same
bytes whatever the partitioning. Equal payloads of at least ``min_revisit`` bytes are stored once;
the other records revisit the one with the least key. Tasks write under temporary names; the
manifest holds the files of successful attempts only, and the commit renames those (a repeated
commit finds them renamed) and drops what lost attempts left. ``read`` takes the files from the
manifest, checks every digest and returns one row per record.

Defined results: null html is an empty payload; equal keys with equal payloads of that size are
one response and revisits of it; null keys sort first (in shards of their own,
by a hash of the digest), and are referred to only if all keys of their payload are null; a null url gives ``urn:page:<key>``; control characters in urls are
percent-encoded; an empty table gives no files and no rows; other columns are ignored.

Scale: payloads are shuffled once, by shard, and streamed batch by batch into the files; the
duplicate search shuffles (digest, key) only, and a payload that a third of all rows share is
combined before its shuffle.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import itertools
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import keep_as_table, null_safe_ranges

SHARD_BYTES = 32 << 20
#: A table has at most so many shards: those of a very large one are larger.
MOST_SHARDS = 20_000
#: Unless told otherwise, a file's compressed size is this part of a shard's payload, so that shards roll unless pages
#: shrink to less, and files grow with the shards (over 1 GB at 100 TB).
FILE_PART = 4
READ_ROWS = 20_000
MIN_REVISIT = 100
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FILES = "shard int, seq int, temp string, name string, file_bytes long, records long, sha256 string"
_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string"


def filesystem(path: str):
    """(pyarrow file system, path in it) of a Hadoop-style path."""
    from pyarrow import fs
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _record_id(key: object, digest: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}:{digest}:{nth}')}>"


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _record(fields: list[tuple[str, object]], block: bytes, level: int) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def _http(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def _clean_url(url: str | None, key: object) -> str:
    if url is None or not url.strip():
        return f"urn:page:{key}"
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


class _Roll:
    """The open file of one shard."""

    def __init__(self, root: str, shard: int, limit: int, level: int):
        self.fs, self.root = filesystem(root)
        self.shard, self.limit, self.level, self.seq, self.out = shard, limit, level, 0, None

    def add(self, record: bytes) -> Iterator[tuple]:
        if self.out is not None and self.size + len(record) > self.limit and self.records:
            yield self.close()
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.seq:05d}.warc.gz"
            self.temp = f"{self.root}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha256()
            info = b"software: corpusflow\r\nformat: WARC File Format 1.1\r\n"
            self._put(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(self.name, _sha(info), 0)), ("WARC-Date", DATE),
                               ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields"),
                               ("WARC-Block-Digest", f"sha256:{_sha(info)}")], info, self.level))
        self._put(record)
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)
        self.sha.update(data)

    def close(self) -> tuple:
        self.out.close()
        self.out = None
        row = (self.shard, self.seq, self.temp, self.name, self.size, self.records, self.sha.hexdigest())
        self.seq += 1
        return row


def _writer(root: str, limit: int, level: int, min_revisit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, at, owner, known, nth = None, None, None, False, 0
        done: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                if roll is None or roll.shard != row["shard"]:
                    if roll is not None and roll.out is not None:
                        done.append(roll.close())
                    roll, at = _Roll(root, row["shard"], limit, level), None
                here = (row["page_id"], row["digest"])
                if here != at:
                    at, known, nth = here, False, 0
                if not row["is_page"]:
                    owner, known = row["owner"], True
                    continue
                key, payload = row["page_id"], (row["html"] or "").encode()
                digest, url = _sha(payload), _clean_url(row["url"], row["page_id"])
                again = known and len(payload) >= min_revisit and (owner != key or nth > 0)
                fields = [("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", _record_id(key, digest, nth)),
                          ("WARC-Date", DATE), ("WARC-Target-URI", url), ("Content-Type", "application/http; msgtype=response"),
                          ("WARC-Payload-Digest", f"sha256:{digest}")]
                block = _http(len(payload)) if again else _http(len(payload)) + payload
                if again:
                    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(owner, digest, 0))]
                    fields += [("X-Refers-To-Key", owner)] if owner is not None else []
                fields += [("WARC-Block-Digest", f"sha256:{_sha(block)}")] + ([("X-Key", key)] if key is not None else [])
                done += roll.add(_record(fields, block, level))
                nth += 1
        if roll is not None and roll.out is not None:
            done.append(roll.close())
        names = [f.split()[0] for f in _FILES.split(", ")]
        types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        cols = list(zip(*done, strict=True)) if done else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
    return run


def _committer(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(root)
        for batch in batches:
            for row in batch.to_pylist():
                final = f"{base}/{row['name']}"
                if fs.get_file_info(row["temp"]).is_file:
                    fs.move(row["temp"], final)
                elif fs.get_file_info(final).size != row["file_bytes"]:
                    raise OSError(f"{final} is neither committed nor pending")
            yield batch
    return run


def _a_task_each(files: DataFrame) -> DataFrame:
    """Rows of a manifest (a few bytes that stand for whole files) dealt to as many tasks as there are files, up
    to 20,000: a number that is given is not reduced by the few bytes."""
    return files.repartition(min(20_000, max(1, files.count())))


def write(pages: DataFrame, root: str, shard_bytes: int = SHARD_BYTES, file_bytes: int | None = None,
          min_revisit: int = MIN_REVISIT, level: int = 6) -> DataFrame:
    """Write (page_id, url, html) as archives under ``root`` and return the manifest, which is
    also the Parquet table ``root/manifest``: one row per file, in order of shard and seq."""
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html"))
    facts = keep_as_table(rows.select("page_id", F.unhex(F.sha2(html, 256)).alias("digest"),
                                      F.octet_length(html).cast("long").alias("n")), "warc-facts")
    weighed = facts.withColumn("n", F.col("n") + 500)
    if file_bytes is None:
        total = weighed.agg(F.sum("n")).first()[0] or 0
        file_bytes = max(shard_bytes, total // MOST_SHARDS) // FILE_PART
    # pages without an id: shards of their own, by digest
    tied = lambda df: df.withColumn("tie", F.when(F.col("page_id").isNull(), F.xxhash64("digest")))
    shards, shard_of = null_safe_ranges(tied(weighed), "page_id", "tie", "n", shard_bytes, MOST_SHARDS)
    shared = (facts.filter(F.col("n") >= min_revisit).groupBy("digest")
              .agg(F.min("page_id").alias("owner"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies"))
    notes = facts.filter(F.col("n") >= min_revisit).join(shared, "digest").select("page_id", "digest", "owner").distinct()
    columns = ["page_id", "digest", "is_page", "owner", "url", "html"]
    pieces = (rows.select("page_id", F.unhex(F.sha2(html, 256)).alias("digest"), F.lit(True).alias("is_page"),
                          F.lit(None).cast("long").alias("owner"), "url", "html")
              .unionByName(notes.select("page_id", "digest", F.lit(False).alias("is_page"), "owner",
                                        F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))))
    pieces = tied(pieces).select(shard_of("page_id", "tie").alias("shard"), *columns)
    fs, base = filesystem(root)
    fs.create_dir(f"{base}/_temporary", recursive=True)
    pending = keep_as_table(
        pieces.repartitionById(shards, F.col("shard"))
        .sortWithinPartitions("shard", "page_id", "digest", "is_page", "url")
        .mapInArrow(_writer(root, file_bytes, level, min_revisit), _FILES), "warc-pending")
    done = _a_task_each(pending).mapInArrow(_committer(root), _FILES)
    done.drop("temp").write.mode("overwrite").parquet(f"{root}/manifest")
    fs.delete_dir(f"{base}/_temporary")
    return spark.read.parquet(f"{root}/manifest")


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed WARC stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            head[k] = v
        block = stream.read(n := int(head["Content-Length"]))
        if len(block) != n or stream.read(4) != b"\r\n\r\n":
            raise ValueError("truncated WARC record")
        yield head, block


def _checked(name: str, head: dict[str, str], block: bytes) -> bool:
    """Is it a page's record? Its block must match its digest."""
    if head["WARC-Block-Digest"] != f"sha256:{_sha(block)}":
        raise ValueError(f"{name}: a block does not match its digest")
    return head["WARC-Type"] != "warcinfo"


def _read_row(name: str, head: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    if head["WARC-Type"] == "response" and (len(payload) != size or _sha(payload) != digest):
        raise ValueError(f"{name}: a payload does not match its digest")
    key, to = head.get("X-Key"), head.get("X-Refers-To-Key")
    return (None if key is None else int(key), size, digest, head["WARC-Type"], None if to is None else int(to), head["WARC-Target-URI"], name)


def _reader(root: str):
    columns = [f.split()[0] for f in _RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        fs, base = filesystem(root)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with fs.open_input_file(f"{base}/{name}") as f, gzip.GzipFile(fileobj=f) as z:
                    rows = (_read_row(name, head, block) for head, block in records(z) if _checked(name, head, block))
                    while some := list(itertools.islice(rows, READ_ROWS)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names=columns)
    return run


def read(spark, root: str) -> DataFrame:
    """One row per response or revisit record of the committed archives under ``root``."""
    manifest = spark.read.parquet(f"{root}/manifest")
    return _a_task_each(manifest.select("name")).mapInArrow(_reader(root), _RECORDS)


def fresh_root(spark) -> str:
    """A new folder for archives in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex[:12]}"


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
o AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS owner,
      row_number() OVER (PARTITION BY payload_digest ORDER BY page_id) AS nth FROM f)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND nth > 1 THEN owner END AS refers_to
FROM o
"""
