"""WARC archives with a Merkle fixity audit of their replicas.

Records are packed, in the order in which they are read and without any shuffle, into immutable blocks of
WARC bytes; a block's row also holds the offset ranges of its records. A block's leaf digest is the hash of
its records' ranges and hashes in order; leaves are numbered by (part, seq), and each node above is the
hash of up to FANOUT nodes below it. An audit compares the roots of two replicas, then only the children of
nodes that differ, level by level, and last the records of the blocks that differ.

Records are WARC/1.1: their id is a UUID made of their contents, the key goes into a field of its own, and control
characters and spaces of a URL are percent-encoded. ``export`` and ``read_files`` write and read ``.warc`` and
``.warc.gz`` files, a gzip member a record.

Cases: a null body is an empty one; a null or empty URL has the record's own id as its target and is read back as null;
null keys are kept, without the field; repeated records are separate leaves with one id; an empty table has no blocks, and its root is null; a body longer than a block
gets a block of its own; blocks missing from a replica, or only there, differ at their leaf; truncated
bytes hash as what is left of them; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, pieces, small_batches

BLOCK_BYTES = 4 << 20
FANOUT = 16

BLOCK = "part int, seq int, keys binary, known binary, ends binary, payload binary"
MANIFEST = "part int, seq int, keys binary, known binary, ends binary, digests binary, leaf string"


#: The date of records whose pages have none.
DATE = "2000-01-01T00:00:00Z"
#: Header field of the key.
KEY = "X-Record-Key"
UNSAFE = [*range(33), 127]


def safe_url(url: Column) -> Column:
    """The URL with control characters and spaces percent-encoded."""
    clean = url
    for c in UNSAFE:
        clean = F.replace(clean, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), clean).otherwise(url)


def record(key: Column, url: Column, body: Column, date: str = DATE) -> Column:
    """A WARC resource record as a string; its bytes are the UTF-8 ones."""
    body, end = F.coalesce(body.cast("string"), F.lit("")), "\r\n"
    key, url = key.cast("string"), F.coalesce(url.cast("string"), F.lit(""))
    own = F.md5(F.concat_ws("\n", F.coalesce(key, F.lit("")), url, body).cast("binary"))
    urn = F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *(F.substring(own, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))
    head = F.concat(
        F.lit(f"WARC/1.1{end}WARC-Type: resource{end}WARC-Record-ID: <"), urn, F.lit(f">{end}WARC-Date: {date}{end}WARC-Target-URI: "), F.when(url == "", urn).otherwise(safe_url(url)),
        F.when(key.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{end}{KEY}: "), key)),
        F.lit(f"{end}Content-Type: text/html; charset=utf-8{end}Content-Length: "), F.octet_length(body).cast("string"), F.lit(end * 2),
    )
    return F.concat(head, body, F.lit(end * 2))


def fields(headers: dict[str, str]) -> tuple[int | None, str | None]:
    """(key, url) of a record's headers."""
    key, target = headers.get(KEY.lower()), headers.get("warc-target-uri", "")
    return int(key) if key and re.fullmatch(r"-?[0-9]{1,18}", key) else None, target if target and f"<{target}>" != headers.get("warc-record-id") else None


def parse(raw: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The records of WARC bytes: (headers, body)."""
    out, at = [], 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        version, *fields = raw[at:stop].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (f.partition(":") for f in fields)}
        size = int(headers["content-length"])
        out.append((headers, raw[stop + 4 : stop + 4 + size]))
        at = stop + 4 + size
        if raw[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record ends wrongly at byte {at}")
        at += 4
    return out


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", body: str = "html", block_bytes: int = BLOCK_BYTES) -> None:
    """Packs every record into blocks under ``path``."""
    own = pages.select(F.col(page_id).cast("long").alias("key"), record(F.col(page_id), F.col(url), F.col(body)).cast("binary").alias("record"))

    def run(batches):
        part, seq, held, keys, size = TaskContext.get().partitionId(), 0, [], [], 0

        def made():
            known = np.array([k is not None for k in keys], bool)
            ends = np.cumsum([len(r) for r in held], dtype="<u8")
            columns = [[part], [seq], [np.array([k or 0 for k in keys], "<i8").tobytes()], [known.tobytes()], [ends.tobytes()], [b"".join(held)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), *([pa.binary()] * 4)))], ["part", "seq", "keys", "known", "ends", "payload"])

        for batch in batches:
            for piece in pieces(batch, "record"):
                for k, r in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    if held and size + len(r) > block_bytes:
                        yield made()
                        seq, held, keys, size = seq + 1, [], [], 0
                    held.append(r)
                    keys.append(k)
                    size += len(r)
        if held:
            yield made()

    small_batches(pages.sparkSession)
    own.mapInArrow(run, BLOCK).write.option("compression", "zstd").parquet(path)


def copy(spark: SparkSession, source: str, path: str, change=None) -> None:
    """Another replica. ``change`` (key, record bytes) -> bytes of the same length stands for the decay of a disk."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                if change is not None:
                    raw = bytearray(row.column(5)[0].as_py())
                    keys, known, ends = (np.frombuffer(row.column(c)[0].as_py(), t) for c, t in ((2, "<i8"), (3, bool), (4, "<u8")))
                    start = 0
                    for k, ok, stop in zip(keys.tolist(), known.tolist(), ends.tolist()):
                        raw[start:stop] = change(k if ok else None, bytes(raw[start:stop]))
                        start = stop
                    row = row.set_column(5, "payload", pa.array([bytes(raw)], row.schema.field(5).type))
                yield row

    spark.read.schema(BLOCK).parquet(source).mapInArrow(run, BLOCK).write.option("compression", "zstd").parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Hashes what the replica holds now: a row a block with its records' digests and its leaf digest."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part, seq, keys, known, ends, raw = (c[0].as_py() for c in batch.slice(i, 1).columns)
                stops = np.frombuffer(ends, "<u8")
                view, start, digests = memoryview(raw), 0, []
                for stop in stops.tolist():
                    digests.append(hashlib.sha256(view[start:stop]).digest())
                    start = stop
                digests = b"".join(digests)
                columns = [[part], [seq], [keys], [known], [ends], [digests], [hashlib.sha256(keys + known + ends + digests).hexdigest()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), *([pa.binary()] * 4), pa.string()))], ["part", "seq", "keys", "known", "ends", "digests", "leaf"])

    return spark.read.schema(BLOCK).parquet(path).mapInArrow(run, MANIFEST)


class Tree:
    """The levels of a replica's tree, leaves first, as written tables (node, digest); at most FANOUT children are hashed at once."""

    def __init__(self, scratch: Scratch, leaves: DataFrame):
        self.levels = [leaves]
        while self.levels[-1].limit(2).count() > 1:
            below = self.levels[-1]
            up = below.groupBy(F.floor(F.col("node") / FANOUT).cast("long").alias("up")).agg(F.sort_array(F.collect_list(F.struct("node", "digest"))).alias("c"))
            up = up.select(F.col("up").alias("node"), F.sha2(F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["node"].cast("string"), x["digest"])), "|"), 256).alias("digest"))
            self.levels.append(scratch.save(up, f"level{len(self.levels)}"))

    def root(self) -> str | None:
        row = self.levels[-1].first()
        return row.digest if row else None


def numbered(blocks: DataFrame) -> DataFrame:
    """(part, seq, node): nodes count the blocks in order of (part, seq). One task sees a row a part only."""
    parts = blocks.groupBy("part").agg(F.max("seq").alias("last"))
    base = parts.select("part", (F.sum(F.col("last") + 1).over(Window.orderBy("part")) - F.col("last") - 1).alias("base"))
    return blocks.select("part", "seq").join(base, "part").select("part", "seq", (F.col("base") + F.col("seq")).cast("long").alias("node"))


def audit(spark: SparkSession, scratch: Scratch, first: DataFrame, second: DataFrame) -> DataFrame:
    """(part, seq, n, start, stop, key): the records whose bytes differ between two written manifests, found from the roots down.

    A block that only one replica has is reported with all its records.
    """
    blocks = first.select("part", "seq").union(second.select("part", "seq")).distinct()
    number = scratch.save(numbered(blocks), "numbered")
    trees = [Tree(scratch, scratch.save(number.join(m, ["part", "seq"], "left").select("node", F.coalesce("leaf", F.lit("-")).alias("digest")), "leaves")) for m in (first, second)]
    bad = None
    for a, b in zip(reversed(trees[0].levels), reversed(trees[1].levels)):
        if bad is not None:
            a, b = (t.join(bad, F.floor(t["node"] / FANOUT) == bad["up"], "left_semi") for t in (a, b))
        differ = a.alias("a").join(b.alias("b"), "node").where("a.digest <> b.digest").select(F.col("node").alias("up"))
        bad = scratch.save(differ, "differ")
        if bad.isEmpty():
            break
    where = number.join(bad, number["node"] == bad["up"], "left_semi").select("part", "seq")
    return exploded(first.join(where, ["part", "seq"], "left_semi")).alias("a").join(
        exploded(second.join(where, ["part", "seq"], "left_semi")).alias("b"), ["part", "seq", "n"], "full"
    ).where("not (a.digest <=> b.digest)").select("part", "seq", "n", *(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("start", "stop", "key")))


def exploded(blocks: DataFrame) -> DataFrame:
    """(part, seq, n, key, start, stop, digest): a manifest by record."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part, seq, keys, known, ends, digests, _ = (c[0].as_py() for c in batch.slice(i, 1).columns)
                stops = np.frombuffer(ends, "<u8").astype(np.int64)
                n = len(stops)
                columns = [
                    pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.frombuffer(keys, "<i8"), mask=~np.frombuffer(known, bool)),
                    pa.array(np.concatenate([[0], stops[:-1]]).astype(np.int64)), pa.array(stops), pa.array([digests[32 * k : 32 * k + 32].hex() for k in range(n)], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["part", "seq", "n", "key", "start", "stop", "digest"])

    return blocks.select("part", "seq", "keys", "known", "ends", "digests", "leaf").mapInArrow(run, "part int, seq int, n int, key long, start long, stop long, digest string")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(key, url, body) of every record, parsed back from the WARC bytes."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                found = parse(batch.column(0)[i].as_py())
                named = [fields(h) for h, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in named], pa.int64()), pa.array([u for _, u in named], pa.string()), pa.array([b.decode() for _, b in found])], ["key", "url", "body"])

    return spark.read.schema(BLOCK).parquet(path).select("payload").mapInArrow(run, "key long, url string, body string")


def export(spark: SparkSession, path: str, folder: str, compress: bool = True) -> DataFrame:
    """Writes every block as a file of its own into ``folder`` (a URI that pyarrow's file systems know) and returns (name, n_records, n_bytes).

    A file is written beside and then moved, so a task that runs twice leaves the same files.
    """

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part, seq, _, _, ends, raw = (c[0].as_py() for c in batch.slice(i, 1).columns)
                stops = np.frombuffer(ends, "<u8").tolist()
                name = f"part-{part:06d}-{seq:06d}.warc" + (".gz" if compress else "")
                fs, at = pa.fs.FileSystem.from_uri(folder)
                fs.create_dir(at)
                beside = f"{at}/.{name}.{uuid.uuid4().hex}"
                with fs.open_output_stream(beside, compression=None) as out:
                    size = 0
                    for start, stop in zip([0, *stops], stops):
                        size += out.write(gzip.compress(raw[start:stop], 6, mtime=0) if compress else raw[start:stop])
                fs.move(beside, f"{at}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(stops)], pa.int64()), pa.array([size], pa.int64())], ["name", "n_records", "n_bytes"])

    written = spark.read.schema(BLOCK).parquet(path).mapInArrow(run, "name string, n_records long, n_bytes long")
    return Scratch(spark, "warc-export").save(written, "files")


def stream(source, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, body) of the records of an open file, plain or of gzip members; one record is in memory at a time."""
    held, inflate, plain = bytearray(), None, None

    def more() -> bool:
        nonlocal inflate, plain
        raw = source.read(chunk)
        if plain is None:
            raw += source.read(1) if len(raw) == 1 else b""
            plain = raw[:2] != b"\x1f\x8b"
        if not raw:
            return False
        while raw and not plain:
            inflate = inflate or zlib.decompressobj(31)
            held.extend(inflate.decompress(raw))
            raw = inflate.unused_data if inflate.eof else b""
            inflate = None if inflate.eof else inflate
        held.extend(raw)
        return True

    while True:
        seen = 0
        while (stop := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not more():
                if held.strip():
                    raise ValueError("the file ends within a record's headers")
                return
        version, *lines = held[:stop].decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record where one should begin: {version[:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (f.partition(":") for f in lines)}
        if not headers.get("content-length", "").isdigit():
            raise ValueError("a record without a length")
        size = stop + 4 + int(headers["content-length"])
        while len(held) < size + 4 and more():
            pass
        if len(held) < size:
            raise ValueError("the file ends within a record")
        yield headers, bytes(held[stop + 4 : size])
        del held[: size + 4 if held[size : size + 4] == b"\r\n\r\n" else size]


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, type, key, url, body) of the records of the ``.warc`` and ``.warc.gz`` files in ``folder``, whoever wrote them; files are read as streams.

    A record of another writer has no key; the body of a response begins with its HTTP headers; a body that isn't UTF-8 has replacement characters.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc{,.gz}").load(folder).select("path", "length")

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = pa.fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1))
                out, size = [], 0
                with fs.open_input_stream(at, compression=None) as source:
                    for headers, body in stream(source):
                        out.append((at.rsplit("/", 1)[-1], headers.get("warc-type"), *fields(headers), body.decode("utf-8", "replace")))
                        size += len(body)
                        if size > BLOCK_BYTES:
                            yield packed(out)
                            out, size = [], 0
                if out:
                    yield packed(out)

    def packed(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()))], ["name", "type", "key", "url", "body"])

    return files.select("path").mapInArrow(run, "name string, type string, key long, url string, body string")


def fixity(spark: SparkSession, first: str, second: str) -> DataFrame:
    """(key, n_bytes, digest, damaged) of every record of the first replica, audited against the second."""
    scratch = Scratch(spark, "fixity")
    a, b = (scratch.save(manifest(spark, p), "manifest") for p in (first, second))
    bad = scratch.save(audit(spark, scratch, a, b).select(F.col("part").alias("p"), F.col("seq").alias("s"), F.col("n").alias("k")), "bad")
    every = exploded(a)
    hit = (every["part"] == bad["p"]) & (every["seq"] == bad["s"]) & (every["n"] == bad["k"])
    return every.join(bad, hit, "left").select("key", (F.col("stop") - F.col("start")).alias("n_bytes"), "digest", F.col("p").isNotNull().alias("damaged"))
