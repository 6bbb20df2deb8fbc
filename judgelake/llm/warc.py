"""Sharded WARC archives: the same rows always give the same files, whoever wrote them.

Records are sorted by key into ranges, a shard each, and every shard rolls its files by
compressed size. Payloads that occur more than once are written once and revisited
elsewhere. Tasks write under temporary names; only files named in the manifest of the
task attempts that Spark accepted get their final names.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as filesystems
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from judgelake.llm.common import small, stored

#: Compressed bytes at which a file is closed, shorter payloads are never revisits, keys
#: sampled for the bounds of the shards (per shard, at most about so many in all).
ROLL_BYTES, LEAST_BYTES, KEYS_PER_SHARD, KEYS = 256 << 20, 100, 64, 200_000
BROADCAST_ROWS = 200_000
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
PARTS = "_parts"

_MANIFEST = "shard int, part int, file string, records long, bytes long, sha256 string"


def _open(path: str):
    """File system and path in it of a folder that driver and executors share."""
    return filesystems.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}")


def _line(value: str) -> str:
    """A header value on one line: control characters and spaces are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    text = "".join([f"{VERSION}\r\n", *(f"{k}: {v}\r\n" for k, v in head), "\r\n"])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + packer.flush()


def _urn(*parts) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(json.dumps(parts).encode()).digest()[:16], version=5)}>"


class _Files:
    """Files of a task, one open at a time; ``done`` has a row of the manifest for each."""

    def __init__(self, path: str, roll: int, date: str):
        self.fs, self.folder = _open(path)
        self.roll, self.date, self.attempt, self.done = roll, date, uuid.uuid4().hex, []
        self.out, self.shard, self.part = None, None, 0

    def put(self, shard: int, record: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.part = shard, 0
        elif self.out is not None and self.records and self.size + len(record) > self.roll:
            self.close()
            self.part += 1
        if self.out is None:
            self.name = f"{PARTS}/{self.shard:06d}-{self.part:06d}-{self.attempt}"
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None), 0, 0, hashlib.sha256()
            final = _final(self.shard, self.part)
            self._write(_record("warcinfo", [("WARC-Record-ID", _urn("info", final)), ("WARC-Date", self.date), ("WARC-Filename", final), ("Content-Type", "application/warc-fields")],
                                b"format: WARC File Format 1.1\r\n"))
        self._write(record)
        self.records += 1

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.shard, self.part, self.name, self.records, self.size, self.sha.hexdigest()))
            self.out = None


def _final(shard: int, part: int) -> str:
    return f"records-{shard:06d}-{part:06d}.warc.gz"


def _bounds(keys: DataFrame, shards: int) -> list:
    """Keys that part ``keys`` (id, digest) into about ``shards`` even ranges.

    They come from a sample chosen by a hash of the key, so equal tables have equal bounds,
    however their rows are dealt.
    """
    n = keys.count()
    want = min(KEYS, shards * KEYS_PER_SHARD)
    rate = int((1 << 30) * min(1.0, want / max(1, n)))
    rows = keys.filter(F.pmod(F.xxhash64("id", "digest"), F.lit(1 << 30)) < rate).groupBy("id", "digest").agg(F.count("*").alias("n")).orderBy("id", "digest").collect()
    total, seen, out = sum(r.n for r in rows), 0, []
    for r in rows:
        if seen * shards >= total * (len(out) + 1):
            out.append((r.id, r.digest))
        seen += r.n
    return out


def _shard(bounds: list, key: Column) -> Column:
    """How many of the sorted bounds are at most ``key``: a binary search in the plan."""
    if not bounds:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps([{"id": i, "digest": d} for i, d in bounds])), "array<struct<id: long, digest: string>>")
    steps = F.lit([1 << b for b in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(table, at + step - 1) <= key), at + step).otherwise(at))


def write(pages: DataFrame, path: str, row_id: str = "page_id", url: str = "url", payload: str = "html",
          shards: int | None = None, roll_bytes: int = ROLL_BYTES, least_bytes: int = LEAST_BYTES, date: str = DATE) -> DataFrame:
    """Archives of all rows below ``path``, a new folder that all machines share; the manifest.

    The payload is UTF-8; null is empty. Of records with equal payloads of at least
    ``least_bytes`` bytes, the one with the smallest id (null is the smallest, then the
    smallest url) is a response, the others revisit it: their block is the HTTP header only.
    Rows without url have no target URI, rows without id no row id. Repeated rows are
    records of their own, told apart by a running number in their record id. Only the three
    columns are read; an empty table gives an empty manifest.

    Rows are sorted by id, payload digest and url, and cut into ``shards`` ranges (the
    shuffle partitions, if not given). Files hold a warcinfo record first and are closed
    before a record that would lift them over ``roll_bytes``; a longer record has a file of
    its own. One gzip member per record, so every record can be read from its offset. The
    files depend on the rows, ``shards`` and ``roll_bytes`` alone.

    A row travels once: payloads seen twice are found from digests, and revisits leave theirs
    behind before the sort. Above ``BROADCAST_ROWS`` repeated payloads that join costs a
    second shuffle. A task holds one Arrow batch of payloads. Rows that agree in all three
    columns are in one shard.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(row_id).cast("long").alias("id"), F.col(url).alias("url"), body.alias("body"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("size"))
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = rows.select("id", "url", "digest", "size")
    first = F.min(F.struct("id", "url"))
    shared = stored(keys.filter(F.col("size") >= least_bytes).groupBy("digest").agg(first.alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "warc-shared")
    marked = rows.join(small(shared, BROADCAST_ROWS), "digest", "left")
    copy = F.col("first").isNotNull() & ~F.struct("id", "url").eqNullSafe(F.col("first"))
    marked = marked.withColumn("body", F.when(~copy, F.col("body")))
    bounds = _bounds(keys.select("id", "digest"), shards)
    placed = marked.select(_shard(bounds, F.struct("id", "digest")).alias("shard"), "id", "url", "digest", "size", "body", "first", F.col("first").isNotNull().alias("shared"))
    order = ["shard", "id", "digest", "url"]
    sorted_rows = placed.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions(*order)

    def run(batches):
        files, last, nth = _Files(path, roll_bytes, date), None, 0
        for batch in batches:
            for shard, num, link, digest, size, html, kept, is_shared in zip(*(c.to_pylist() for c in batch.columns)):
                same = (num, link, digest)
                nth = nth + 1 if same == last else 0
                last = same
                head = [("WARC-Record-ID", _urn(num, link, digest, nth)), ("WARC-Date", date)]
                head += [("WARC-Target-URI", _line(link))] if link is not None else []
                head += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
                head += [("X-Row-ID", str(num))] if num is not None else []
                start = HTTP.format(size).encode()
                if html is None or (is_shared and nth):
                    head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _urn(kept["id"], kept["url"], digest, 0))]
                    head += [("X-Refers-To-Row-ID", str(kept["id"]))] if kept["id"] is not None else []
                    files.put(shard, _record("revisit", head, start))
                else:
                    files.put(shard, _record("response", head, start + html.encode("utf-8", "surrogatepass")))
            yield _rows(files)
        files.close()
        yield _rows(files)

    fs, folder = _open(path)
    fs.create_dir(f"{folder}/{PARTS}")
    staged = stored(sorted_rows.mapInArrow(run, _MANIFEST), "warc-staged")
    commit(staged, path)
    return manifest(spark, path)


def _rows(files: _Files) -> pa.RecordBatch:
    done, files.done = files.done, []
    cols = list(zip(*done)) or [()] * 6
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["shard", "part", "file", "records", "bytes", "sha256"])


def commit(staged: DataFrame, path: str) -> None:
    """Gives the files of ``staged`` their final names, then writes the manifest.

    May be repeated after a failure: a file that has its name already stays. What lies
    under ``_parts`` after the manifest is from attempts that failed; it is removed.
    """
    def run(batches):
        fs, folder = _open(path)
        for batch in batches:
            names = []
            for shard, part, temp, size in zip(*(batch.column(c).to_pylist() for c in ("shard", "part", "file", "bytes"))):
                name = _final(shard, part)
                if fs.get_file_info(f"{folder}/{temp}").type != filesystems.FileType.NotFound:
                    fs.move(f"{folder}/{temp}", f"{folder}/{name}")
                if fs.get_file_info(f"{folder}/{name}").size != size:
                    raise OSError(f"{name} is not whole")
                names.append(name)
            yield batch.set_column(2, "file", pa.array(names, pa.string()))

    staged.mapInArrow(run, _MANIFEST).write.mode("overwrite").parquet(f"{path}/_manifest")
    fs, folder = _open(path)
    fs.delete_dir(f"{folder}/{PARTS}")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """shard, part, file, records (without warcinfo), bytes, sha256 of each file of a finished archive."""
    return spark.read.schema(_MANIFEST).parquet(f"{path}/_manifest")


def _members(stream):
    """The records of a file of one gzip member each: offset and content."""
    at, offset, unpack, parts = 0, 0, zlib.decompressobj(31), []
    while chunk := stream.read(1 << 20):
        while chunk:
            parts.append(unpack.decompress(chunk))
            used = len(chunk) - len(unpack.unused_data)
            at, chunk = at + used, unpack.unused_data
            if unpack.eof:
                yield offset, b"".join(parts)
                offset, unpack, parts = at, zlib.decompressobj(31), []
    if at != offset:
        raise ValueError(f"cut off in the record at {offset}")


_COLUMNS = "file string, offset long, record_type string, record_id string, target_uri string, row_id long, payload_digest string, payload_bytes long, refers_to string, refers_to_row long"


def read(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """A row per response and revisit of the files of the manifest, ``content`` with the payload if asked for.

    Block and payload digests are computed again and files and records counted; what does
    not agree is an error. A file is read by one task as a stream, a record at a time.
    ``payload_bytes`` and ``payload_digest`` of a revisit are those of the full payload.
    """
    files = manifest(spark, path)
    names = [c.split()[0] for c in _COLUMNS.split(", ")] + ["content"] * content

    def run(batches):
        fs, folder = _open(path)
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held, seen = [], 0, 0
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for offset, data in _members(stream):
                        head, _, rest = data.partition(b"\r\n\r\n")
                        fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
                        block = rest[:int(fields["Content-Length"])]
                        if rest[len(block):] != b"\r\n\r\n" or hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"][7:]:
                            raise ValueError(f"{name}: damaged record at {offset}")
                        kind = fields["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        start, _, payload = block.partition(b"\r\n\r\n")
                        digest, size = fields["WARC-Payload-Digest"][7:], int(re.search(rb"(?m)^Content-Length: (\d+)", start)[1])
                        if kind == "response" and (size != len(payload) or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{name}: payload of the record at {offset} is not the one of its header")
                        num, to = fields.get("X-Row-ID"), fields.get("X-Refers-To-Row-ID")
                        rows.append((name, offset, kind, fields["WARC-Record-ID"], fields.get("WARC-Target-URI"), num and int(num), digest, size, fields.get("WARC-Refers-To"), to and int(to),
                                     *([payload if kind == "response" else None] if content else [])))
                        seen, held = seen + 1, held + (len(payload) if content else 0)
                        if len(rows) >= 5000 or held > 16 << 20:
                            yield _batch(names, rows)
                            rows, held = [], 0
                if seen != records:
                    raise ValueError(f"{name}: {seen} records, the manifest has {records}")
                if rows:
                    yield _batch(names, rows)

    spread = files.select("file", "records").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file")
    return spread.mapInArrow(run, _COLUMNS + ", content binary" * content)


def _batch(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"offset": pa.int64(), "row_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to_row": pa.int64(), "content": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows))], names=names)
