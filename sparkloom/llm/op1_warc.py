"""WARC archives: a deterministic, sharded writer and a reader.

Writing.  Records are range-sorted by page id into shards; each shard streams its records into files that roll when
their compressed size passes ``roll_bytes``.  Shard bounds come from exact sums of bytes by id range, never from a sample,
so they depend on the pages alone, not on how these are partitioned.  Every header and digest is made anew from the
payload, nothing depends on clock or chance, so another run writes the same bytes.  A file is written under a temporary
name for each attempt and renamed when whole; the manifest, committed after all shards, names the files that count.

Of records with equal payloads of at least ``least_bytes``, that with the largest id is the response and the others are
revisits.  Which pages repeat is settled on digests alone; the verdicts travel to the writer as rows that sort just
before their page, so payloads are shuffled once.

Defined results.  Null html: empty payload.  Null url: an empty target.  Null id: sorts first, never a response for
others.  Rows repeated with one id: the first is the response, the others revisit it.  An id (or null) with more bytes
than a shard holds goes to several shards, by digest.  Empty table: no files, no rows.
Very long payloads are streamed to the file, one record at a time in memory.  Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_chunks, new_folder, settle

MANIFEST = "file string, shard int, records long, bytes long, sha1 string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
PAGE = "WARC-X-Page-Id"
REFERS = "WARC-X-Refers-To-Page-Id"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _base32(digest_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest_hex)).decode()


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id, url: str, payload: bytes, digest: str, refers_to, date: str, revisit: bool) -> bytes:
    """One record, before compression."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Block-Digest: {_base32(hashlib.sha1(block).hexdigest())}",
        f"WARC-Payload-Digest: {_base32(digest)}",
    ]
    lines += [f"{PAGE}: {page_id}"] * (page_id is not None)
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}"]
        lines += [f"{REFERS}: {refers_to}"] * (refers_to is not None)
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


class _Roller:
    """Writes members to files of one shard; a file gets its final name when it is whole."""

    def __init__(self, folder: str, shard: int, roll_bytes: int, level: int):
        from pyarrow import fs

        self.fs, self.base = fs.FileSystem.from_uri(folder)
        self.shard, self.roll, self.level, self.number, self.out = shard, roll_bytes, level, 0, None
        self.attempt = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
        self.fs.create_dir(f"{self.base}/temporary", recursive=True)

    def write(self, raw: bytes):
        """Yields the manifest row of a file that this record completes."""
        if self.out is None:
            self.name = f"shard-{self.shard:07d}-{self.number:06d}.warc.gz"
            self.temporary = f"{self.base}/temporary/{self.name}.{self.attempt}"
            self.out, self.size, self.records, self.sum = self.fs.open_output_stream(self.temporary), 0, 0, hashlib.sha1()
        packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)  # a gzip member without a time
        member = packer.compress(raw) + packer.flush()
        self.out.write(member)
        self.sum.update(member)
        self.size += len(member)
        self.records += 1
        if self.size >= self.roll:
            yield self.close()

    def close(self):
        self.out.close()
        self.out = None
        self.fs.move(self.temporary, f"{self.base}/{self.name}")
        self.number += 1
        return self.name, self.shard, self.records, self.size, self.sum.hexdigest()


def _shards(sizes: DataFrame, shard_bytes: int, bits: int = 4) -> tuple[list[tuple[int, list[tuple]]], int]:
    """Levels (shift, [(cell, first shard, number of shards)]) and the number of shards, for sizes (page_id, size).

    A cell holds the ids with equal ``id >> shift``; one that holds more than a quarter of a shard is split further by
    ``bits``, down to single ids.  Only cells reach the driver: at most 2 ** bits for each quarter of a shard, and the first
    ones, 64 a shard.
    """
    stats = sizes.agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(F.col("page_id").isNull(), F.col("size") + 1)), F.lit(0)).alias("none")).first()
    cells: dict[int, dict[int, int]] = {}
    if stats["low"] is not None:
        most, shift = 64 * n_chunks(stats["bytes"], shard_bytes), 0
        while (stats["high"] >> shift) - (stats["low"] >> shift) >= most:
            shift += 1
        open_ = sizes.where("page_id is not null")
        while True:
            own = cells[shift] = {r["cell"]: r["bytes"] for r in open_.groupBy(F.shiftright("page_id", shift).alias("cell")).agg(F.sum("size").alias("bytes")).collect()}
            heavy = [c for c, n in own.items() if 4 * n > shard_bytes and shift]
            if not heavy:
                break
            for c in heavy:
                del own[c]
            split = sizes.sparkSession.createDataFrame([(c,) for c in heavy], "cell long")
            open_ = open_.withColumn("cell", F.shiftright("page_id", shift)).join(F.broadcast(split), "cell", "left_semi").drop("cell")
            shift = max(0, shift - bits)
    placed: dict[int, list[tuple]] = {shift: [] for shift in cells}
    shard, filled = -(-stats["none"] // shard_bytes), 0
    null_shards = shard
    for _, shift, cell, n in sorted((cell << shift, shift, cell, n) for shift, own in cells.items() for cell, n in own.items()):
        if n > shard_bytes and not shift:
            shard, filled = shard + (filled > 0), 0
            k = -(-n // shard_bytes)
            placed[shift].append((cell, shard, k))
            shard += k
            continue
        if filled and filled + n > shard_bytes:
            shard, filled = shard + 1, 0
        placed[shift].append((cell, shard, 1))
        filled += max(n, 1)
    return [(-1, [(0, 0, null_shards)]), *placed.items()], max(shard + (filled > 0), 1)


def _with_shard(rows: DataFrame, levels: list[tuple[int, list[tuple]]]) -> DataFrame:
    """rows with the column shard, by page_id and, where an id has several shards, by digest."""
    null_shards = levels[0][1][0][2]
    first, k = F.when(F.col("page_id").isNull(), 0), F.when(F.col("page_id").isNull(), max(null_shards, 1))
    for shift, cells in levels[1:]:
        # As many rows as the cells that the driver has just made.
        table = rows.sparkSession.createDataFrame(cells, f"cell{shift} long, first{shift} int, k{shift} int")
        rows = rows.join(F.broadcast(table), F.shiftright("page_id", shift) == F.col(f"cell{shift}"), "left")
        first, k = F.coalesce(first, f"first{shift}"), F.coalesce(k, f"k{shift}")
    return rows.withColumn("shard", (first + F.pmod(F.xxhash64("digest"), k)).cast("int"))


def write_warc(pages: DataFrame, folder: str, roll_bytes: int = 64 << 20, shard_bytes: int = 32 << 20, least_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z", level: int = 6, least_shards: int = 8) -> DataFrame:
    """Write pages (page_id, url, html) under folder and return the manifest, which is committed at folder/manifest.

    Small tables get smaller shards, so that there are about ``least_shards``, and roll at an eighth of a shard's bytes.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body"))
    narrow = settle(rows.select("page_id", F.sha1("body").alias("digest"), F.octet_length("body").cast("long").alias("size")), "digests")
    total = narrow.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shard_bytes = max(1, min(shard_bytes, -(-total // least_shards)))
    roll_bytes = min(roll_bytes, max(1 << 16, shard_bytes // 8))
    levels, shards = _shards(narrow, shard_bytes)
    large = narrow.where(F.col("size") >= least_bytes)
    repeated = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null").drop("n")
    verdicts = large.join(repeated, "digest").where("page_id is null or page_id <> refers_to")
    both = verdicts.select("page_id", F.lit(0).alias("kind"), "digest", "refers_to", F.lit("").alias("url"), F.lit(b"").alias("body")).union(
        rows.select("page_id", F.lit(1), F.sha1("body"), F.lit(None).cast("long"), "url", "body")
    )

    def write(batches):
        roller, place, refers, seen, done = None, object(), {}, set(), []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    run = row["page_id"]
                    if (row["shard"], run) != place:
                        if roller and roller.shard != row["shard"]:
                            if roller.out:
                                done.append(roller.close())
                            roller = None
                        place, refers, seen = (row["shard"], run), {}, set()
                    if row["kind"] == 0:
                        refers[row["digest"]] = row["refers_to"]
                        continue
                    roller = roller or _Roller(folder, row["shard"], roll_bytes, level)
                    digest, large = row["digest"], len(row["body"]) >= least_bytes
                    again = large and digest in seen
                    target = refers.get(digest, run if again else None)
                    revisit = digest in refers or again
                    if large:
                        seen.add(digest)
                    done += roller.write(record(run, row["url"], row["body"], digest, target, date, revisit))
        if roller and roller.out:
            done.append(roller.close())
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in done], schema=pa.schema([("file", pa.string()), ("shard", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())]))

    columns = ["shard", "page_id", "kind", "digest", "refers_to", "url", "body"]
    sorted_ = _with_shard(both, levels).select(*columns).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "page_id", "kind", "digest", "url")
    sorted_.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _headers(stream) -> dict[str, str]:
    found = {}
    while (line := stream.readline().strip()):
        name, _, value = line.decode().partition(":")
        found[name.lower()] = value.strip()
    return found


def records_of(stream):
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of each record, digests checked."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = _headers(stream)
        length = int(head["content-length"])
        block = stream.read(length)
        if len(block) != length or _base32(hashlib.sha1(block).hexdigest()) != head["warc-block-digest"]:
            raise ValueError(f"a damaged record: {head.get('warc-record-id')}")
        inner = io.BytesIO(block)
        inner.readline()
        http = _headers(inner)
        payload = block[inner.tell() :]
        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
        kind = head["warc-type"]
        if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(http["content-length"])):
            raise ValueError(f"a damaged payload: {head.get('warc-record-id')}")
        number = lambda name: int(head[name]) if name in head else None
        yield number(PAGE.lower()), head["warc-target-uri"], int(http["content-length"]), digest, kind, number(REFERS.lower())


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the files in the manifest; files that no manifest names are left alone."""
    names = [x.split()[0] for x in RECORDS.split(", ")]
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file in batch.column("file").to_pylist():
                with store.open_input_stream(f"{base}/{file}", compression=None) as raw:
                    rows = []
                    for x in records_of(io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20)):
                        rows.append(dict(zip(names, x)))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return manifest.select("file").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(read, RECORDS)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder, roll_bytes=4 << 20, shard_bytes=16 << 20)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
