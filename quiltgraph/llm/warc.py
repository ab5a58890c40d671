"""Deterministic sharded WARC files.

Records are range-sorted by id, and each range is written by one task as files that roll over at a
compressed size. Ranges are cut by the bytes of the records, from exact histograms of the ids, so they depend on
nothing but the records. Every record is a gzip member of its own without a time stamp, with headers and
digests made anew, so the same input gives the same bytes. A task writes under temporary names and
returns a manifest row for each file; the manifest is committed by Spark's own table writer, so of the
attempts of a task one counts; then the files that it lists get their final names. Renaming can be
repeated after a failure. Files of attempts that don't count go with the temporary folder.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltgraph.llm.common import materialise, skew_safe_lookup

#: Compressed bytes from which a file is closed.
ROLL_BYTES = 64 << 20
#: A range has about this share of the payloads' bytes, within these bounds.
RANGE_SHARE, RANGE_BYTES = 256, (1 << 20, 512 << 20)
#: Bytes that a record counts besides its payload.
RECORD_BYTES = 512
#: Bits by which a histogram's cell is divided.
CELL_BITS = 12
#: Groups of equal payloads up to this number are broadcast (40 bytes each), more are joined by shuffling.
BROADCAST_GROUPS = 100_000
#: Date of all records; a capture date isn't part of the data.
DATE = "2000-01-01T00:00:00Z"
LEVEL = 4

MANIFEST = "name string, temporary string, records long, bytes long, sha256 string"
ROW = "page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _number(name: str) -> int | None:
    text = name.strip("<>").removeprefix("urn:page:")
    return None if text == "none" else int(text)


def member(data: bytes) -> bytes:
    coder = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return coder.compress(data) + coder.flush()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join(c if c.isprintable() and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "") or "urn:page:none"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _info(name: str) -> bytes:
    block = b"software: quiltgraph\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:file:{name}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Ranges:
    """Cuts of the ids: the first id of each cell, the number of the cell's first range, and over how many ranges its
    records are spread by a hash. Null ids are in ranges of their own, before all others."""

    starts: list[int]
    first: list[int]
    spread: list[int]
    nulls: int

    def column(self, number: Column, *record: Column) -> Column:
        """The range of a record. Cells are found by bisection."""
        starts = F.array(*[F.lit(s).cast("long") for s in self.starts])

        def step(s: Column, _: Column) -> Column:
            middle = ((s["low"] + s["high"] + 1) / 2).cast("int")
            right = F.get(starts, middle) <= number
            return F.struct(F.when(right, middle).otherwise(s["low"]).alias("low"), F.when(right, s["high"]).otherwise(middle - 1).alias("high"))

        cell = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, len(self.starts).bit_length()))), F.struct(F.lit(0).alias("low"), F.lit(len(self.starts) - 1).alias("high")), step, lambda s: s["low"])
        of = lambda n: F.pmod(F.xxhash64(*record), n.cast("long")).cast("int")
        known = F.get(F.transform(F.array(cell), lambda c: F.get(F.array(*map(F.lit, self.first)), c) + of(F.get(F.array(*map(F.lit, self.spread)), c))), F.lit(0))
        return F.when(number.isNull(), of(F.lit(max(1, self.nulls)))).otherwise(known)


def even_ranges(rows: DataFrame) -> Ranges:
    """Ranges of about equal bytes for rows (page_id, n: bytes). Histograms of the ids' highest bits, of at most
    2 ** CELL_BITS cells, are refined where a cell holds more than a range, down to single ids; an id whose records
    are more than a range is spread."""
    total = rows.agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("page_id").isNull(), F.col("n"))), F.lit(0)).alias("none")).first()
    most = min(RANGE_BYTES[1], max(RANGE_BYTES[0], total["n"] // RANGE_SHARE))
    nulls = -(-total["none"] // most)
    if total["low"] is None:
        return Ranges([0], [nulls], [1], nulls)
    shift = next(s for s in range(64) if (total["high"] >> s) - (total["low"] >> s) < 1 << CELL_BITS)
    found, left = [], rows.where("page_id is not null")
    while True:
        # at most 2 ** CELL_BITS cells, and later that many for each cell that is larger than a range
        cells = [(r["cell"], r["n"]) for r in left.groupBy(F.shiftright("page_id", shift).alias("cell")).agg(F.sum("n").alias("n")).collect()]
        large = [c for c, n in cells if n > most and shift]
        found += [(c << shift, n) for c, n in cells if not (n > most and shift)]
        if not large:
            break
        wanted = rows.sparkSession.createDataFrame([(c,) for c in large], "cell long")
        left = left.join(F.broadcast(wanted), F.shiftright("page_id", shift) == F.col("cell"), "left_semi")
        shift = max(0, shift - CELL_BITS)
    starts, first, spread, held, number = [], [], [], most, nulls - 1
    for start, n in sorted(found):
        if held + n > most:
            number, held = number + 1, 0
        starts.append(start)
        first.append(number)
        spread.append(max(1, -(-n // most)))
        number, held = number + spread[-1] - 1, held + n
    # neighbours of one range need one cut only
    kept = [i for i in range(len(starts)) if not i or first[i] != first[i - 1] or spread[i] > 1 or spread[i - 1] > 1]
    return Ranges([starts[i] for i in kept], [first[i] for i in kept], [spread[i] for i in kept], nulls)


class Shards:
    """The files of one task, range by range."""

    def __init__(self, folder: str, roll_bytes: int):
        self.fs, self.folder = opened(folder)
        self.roll_bytes, self.range, self.out = roll_bytes, None, None

    def write(self, number: int, data: bytes) -> Iterator[dict]:
        """Puts a record of the given range; yields the manifest rows of files that are closed."""
        if number != self.range:
            yield from self.close()
            self.range, self.count = number, 0
        if self.out is None:
            self.name = f"part-{self.range:06d}-{self.count:06d}.warc.gz"
            self.temporary = f"_temporary/{self.name}.{uuid.uuid4().hex}"
            self.fs.create_dir(f"{self.folder}/_temporary", recursive=True)
            self.out, self.records, self.bytes, self.sum = self.fs.open_output_stream(f"{self.folder}/{self.temporary}", compression=None), 0, 0, hashlib.sha256()
            self._put(member(_info(self.name)))
        self._put(member(data))
        self.records += 1
        if self.bytes >= self.roll_bytes:
            yield from self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sum.update(data)
        self.bytes += len(data)

    def close(self) -> Iterator[dict]:
        if self.out is None:
            return
        self.out.close()
        self.out = None
        self.count += 1
        yield {"name": self.name, "temporary": self.temporary, "records": self.records, "bytes": self.bytes, "sha256": self.sum.hexdigest()}


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, payload) with refers_to: null, or the largest page_id of the records with an
    equal payload of at least ``least_bytes`` bytes, where that is another id."""
    keyed = pages.withColumn("_key", F.sha2("payload", 256))
    same = keyed.where(F.octet_length("payload") >= least_bytes).groupBy("_key").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("_n"))
    same = materialise(same.where("_n > 1"), "equal-payloads")
    if (groups := same.count()) <= BROADCAST_GROUPS:
        held = keyed.join(F.broadcast(same.drop("_n")), "_key", "left") if groups else keyed.withColumn("largest", F.lit(None).cast("long"))
    else:
        held = skew_safe_lookup(keyed.withColumn("_id", F.coalesce("page_id", F.lit(0))), same, "_key", "_n", pages.count(), "_id")
    return held.withColumn("refers_to", F.when(~F.col("largest").eqNullSafe(F.col("page_id")), F.col("largest"))).select("page_id", "url", "payload", "refers_to")


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes a record per row into ``folder`` (new, on storage that all executors share) and returns the
    manifest (name, records, bytes, sha256), which lies in ``folder``/_manifest.

    The payload is the html as UTF-8 (null: empty). Records whose payload another record of a larger id
    has are revisits of the largest; rows that share the largest id are all responses. Null ids sort
    first and never are what others refer to unless all are null; a null url becomes urn:page:none. Other
    columns are ignored; an empty table gives no file; a long html is one record. The records of an id that has more
    than a range are spread over several by a hash. The same records give the same files, byte by byte.
    """
    spark = pages.sparkSession
    rows = mark_revisits(pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), F.encode(F.coalesce(pages[html_col].cast("string"), F.lit("")), "utf-8").alias("payload")), least_bytes)
    sizes = pages.select(pages[id_col].cast("long").alias("page_id"), (F.octet_length(F.coalesce(pages[html_col].cast("string"), F.lit(""))) + RECORD_BYTES).cast("long").alias("n"))
    ranges = even_ranges(sizes)
    rows = rows.select(ranges.column(F.col("page_id"), F.col("url"), F.col("payload")).alias("_range"), "*")
    # by a hash of the range, so that a task has all of it; where two meet, each has its own files
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_range").sortWithinPartitions("_range", "page_id", "url", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, done = Shards(folder, roll_bytes), []
        for b in batches:
            for number, page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                done += shards.write(number, record(page_id, url, payload, refers_to, refers_to is not None))
        done += shards.close()
        if done:
            yield pa.RecordBatch.from_pylist(done)

    rows.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/_manifest")
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(folder)
        for b in batches:
            for row in b.to_pylist():
                if fs.get_file_info(f"{path}/{row['temporary']}").type != pafs.FileType.NotFound:
                    fs.move(f"{path}/{row['temporary']}", f"{path}/{row['name']}")
            yield pa.RecordBatch.from_arrays([b.column(0)], ["name"])

    manifest.mapInArrow(commit, "name string").write.parquet(f"{folder}/_committed")
    fs, path = opened(folder)
    if fs.get_file_info(f"{path}/_temporary").type != pafs.FileType.NotFound:
        fs.delete_dir(f"{path}/_temporary")
    return manifest.drop("temporary")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        headers = {}
        while line := stream.readline().strip():
            key, _, value = line.decode().partition(": ")
            headers[key] = value
        block = stream.read(int(headers["Content-Length"]))
        yield headers, block


def read_warc(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The page records of the files that the manifest of ``folder`` lists. payload_bytes and payload_digest
    are those of the full payload, for revisits from the record's headers; payload is null for revisits,
    and for all if not asked for. A digest that doesn't match its payload or block is an error."""
    names = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest").select("name")
    names = names.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                out, held = [], 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) as stream:
                    for headers, block in records(stream):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        revisit, own = headers["WARC-Type"] == "revisit", headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if headers["WARC-Block-Digest"] != f"sha1:{digest(block)}" or not revisit and digest(payload) != own:
                            raise ValueError(f"{name}: digest of {headers['WARC-Record-ID']} doesn't match")
                        size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                        out.append((_number(headers["WARC-Record-ID"]), headers["WARC-Type"], headers["WARC-Target-URI"], size, own, _number(headers["WARC-Refers-To"]) if revisit else None, None if revisit or not with_payload else payload))
                        held += len(block) if with_payload else 64
                        if held > 8 << 20 or len(out) == 8192:
                            yield _rows(out)
                            out, held = [], 0
                if out:
                    yield _rows(out)

    return names.mapInArrow(run, ROW)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["page_id", "record_type", "url", "payload_bytes", "payload_digest", "refers_to", "payload"])
