"""Token ids as binary shards with keyed access.

Format: a folder ``shards`` of Parquet rows, one immutable shard a row, in ascending order of key:

- part, seq: order of the shard; n_docs, n_tokens
- width, ids: the raw payload, little-endian unsigned integers of 2 bytes (vocabularies of up to
  65,536 ids) or 4, document after document, each with the end id
- index: a minimal perfect hash from key to slot; marks: a 32-bit fingerprint by slot; ordinals: by slot
  the number of the key's first document in the shard
- keys, known: the keys in document order (0 where null) and whether they are not null, to list what
  is there; ends: where each document's ids end (a document begins where the one before it ends)

A keyed read picks the shard by its first and last key from the small columns, then needs one probe of
the perfect hash, one fingerprint and one offset, however many documents the shard holds. Spark's
writer commits the folder as a whole, so a lost executor's part is written again.

Cases: a null text has no ids but the end id; null keys come first, are stored and can't be looked up;
repeated keys lie side by side, ordered by text, and one lookup returns all of them in each shard that has
some (the rows of one key are dealt to several ranges by the beginnings of their texts, so that a key, or
null, may have a third of all rows); an empty table gives an empty folder; a text longer than a shard gets a
shard of its own; other columns are ignored.
"""

from __future__ import annotations

import functools
import gc
import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, estimated, pieces, released, small_batches
from .perfect_hash import PerfectHash, marks

#: Ids in a shard, unless one document has more.
SHARD_IDS = 1 << 20
#: Pieces whose ids a worker keeps, and characters of the longest that is kept: some 100 MB; others are encoded again when they come.
CACHE_PIECES, CACHE_CHARS = 600_000, 40
#: Bytes of input in one range of keys, by the plan's estimate, and ranges at most (they grow beyond that).
RANGE_BYTES, MOST_RANGES = 32 << 20, 20_000
#: Beginning of a text that parts the rows of one key.
BEGINNING = 12
#: Keys that the driver samples to cut ranges, about.
SAMPLED = 100_000
#: Shards whose starts (24 bytes each) are broadcast at most.
BROADCAST_SHARDS = 1_000_000

SHARD = "part int, seq int, n_docs int, n_tokens long, first_key long, last_key long, width int, ids binary, index binary, marks binary, ordinals binary, keys binary, known binary, ends binary"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Texts to ids by the tokenizers library.

    The byte-level vocabularies split a text by a fixed pattern before any merge, so the ids of a text
    are those of its pieces one after another. Pieces are encoded once by the library and kept; a text
    with characters outside the Latin blocks, where the pattern's classes are spelled out here, or with
    the string of an added token is encoded by the library as a whole. With ``added``, special tokens'
    strings in a text are their ids, as the library's default has it; without, they are ordinary text.
    """

    #: Letters and digits up to U+024F, as the pattern's classes have them.
    LETTER, DIGIT = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"
    SPACE = "\t-\r \x85\xa0"
    PIECE = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^{SPACE}{LETTER}{DIGIT}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
    OTHER = re.compile("[^\t-\r -ɏ]")

    def __init__(self, path: str, added: bool = False):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.strings = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.kept: dict[str, bytes] = {}
        self.by_piece = '"ByteLevel"' in self.tokenizer.to_str()[:4000]

    def packed(self, ids: list[int]) -> bytes:
        found = array(self.code, ids)
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        split = [self.PIECE.findall(t) if self.by_piece and not self.OTHER.search(t) and not any(s in t for s in self.strings) else None for t in texts]
        kept = self.kept
        missing = list(set().union(*(s for s in split if s is not None)).difference(kept))
        if missing:
            got = self.tokenizer.encode_batch_fast(missing, add_special_tokens=False)
            kept.update((p, self.packed(e.ids)) for p, e in zip(missing, got, strict=True))
        out = [self.packed(self.tokenizer.encode(t, add_special_tokens=False).ids) if s is None else b"".join(map(kept.__getitem__, s)) for t, s in zip(texts, split, strict=True)]
        full = len(kept) > CACHE_PIECES
        for p in missing:
            if full or len(p) > CACHE_CHARS:
                del kept[p]
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str, added: bool = False) -> Encoder:
    """One for each Python worker, kept from task to task."""
    return Encoder(path, added)


def shard_row(part: int, seq: int, keys: list[int | None], payloads: list[bytes], width: int) -> dict:
    known = np.array([k is not None for k in keys], bool)
    values = np.array([k or 0 for k in keys], "<i8")
    distinct, first = np.unique(values[known], return_index=True)
    ordinal = np.flatnonzero(known)[first] if len(distinct) else np.zeros(0, np.int64)
    mph = PerfectHash.build(distinct.view(np.uint64))
    slot = mph.slots(distinct.view(np.uint64))
    mark, ordinals = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
    mark[slot], ordinals[slot] = marks(distinct.view(np.uint64)), ordinal
    ends = np.cumsum([len(p) // width for p in payloads], dtype="<i8")
    return {
        "part": part, "seq": seq, "n_docs": len(keys), "n_tokens": int(ends[-1]), "first_key": next((k for k in keys if k is not None), None), "last_key": keys[-1], "width": width,
        "ids": b"".join(payloads), "index": mph.dump(), "marks": mark.tobytes(), "ordinals": ordinals.tobytes(), "keys": values.tobytes(), "known": known.tobytes(), "ends": ends.tobytes(),
    }


class Shard:
    """A shard row read back."""

    def __init__(self, row: dict):
        self.width, raw = row["width"], row["ids"]
        self.ids = np.frombuffer(raw, f"<u{self.width}")
        self.keys, self.known = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["known"], bool)
        self.ends = np.frombuffer(row["ends"], "<i8")
        self.marks, self.ordinals = np.frombuffer(row["marks"], "<u4"), np.frombuffer(row["ordinals"], "<u4")
        self.index = PerfectHash.load(row["index"])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key's first document, -1 for a key that isn't there (wrong for one foreign key in 2 ** 32)."""
        keys = np.asarray(keys, "<i8").view(np.uint64)
        slot = self.index.slots(keys)
        if not len(self.marks):
            return np.full(len(keys), -1, np.int64)
        good = (slot >= 0) & (self.marks[slot] == marks(keys))
        return np.where(good, self.ordinals[np.maximum(slot, 0)].astype(np.int64), -1)

    def numbers(self) -> np.ndarray:
        """The number of every document that is listed, by a lookup of its key: repeated keys follow the key's first document, null keys have no slot and go by place."""
        n, known = np.arange(len(self.keys)), np.flatnonzero(self.known)
        keys = self.keys[known]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        nth = np.arange(len(keys)) - np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
        first = self.find(keys)
        if (first < 0).any() or (self.keys[first] != keys).any():
            raise ValueError("a shard's index doesn't agree with its keys")
        n[known] = first + nth
        return n

    def bounds(self, n: int) -> tuple[int, int]:
        return int(self.ends[n - 1]) if n else 0, int(self.ends[n])

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each document of the key."""
        n, out = int(self.find(np.array([key]))[0]), []
        while 0 <= n < len(self.keys) and self.known[n] and self.keys[n] == key:
            a, b = self.bounds(n)
            out.append(self.ids[a:b])
            n += 1
        return out


def write(spark: SparkSession, docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 2, shard_ids: int = SHARD_IDS, added: bool = False) -> None:
    """Encodes every whole text and writes the shards in ascending order of key. ``added``: as in Encoder."""
    tokenizer = tokenizer or vocabulary()
    ordered = docs.select(F.col(doc_id).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, estimated(ordered) // RANGE_BYTES))
    ordered = ordered.repartitionByRange(parts, "key", F.substring("text", 1, BEGINNING)).sortWithinPartitions("key", "text")

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(SHARD))

    def run(batches):
        enc, part, seq, keys, payloads, held = encoder(tokenizer, added), TaskContext.get().partitionId(), 0, [], [], 0
        end = enc.packed([end_id])

        def made():
            return pa.RecordBatch.from_pylist([shard_row(part, seq, keys, payloads, enc.width)], schema=arrow)

        for batch in batches:
            for piece in pieces(batch, "text", 8 << 20):
                ids = enc.encode([t or "" for t in piece.column(1).to_pylist()])
                for k, p in zip(piece.column(0).to_pylist(), ids, strict=True):
                    if keys and held + len(p) // enc.width + 1 > shard_ids:
                        yield made()
                        seq, keys, payloads, held = seq + 1, [], [], 0
                    keys.append(k)
                    payloads.append(p + end)
                    held += len(p) // enc.width + 1
        if keys:
            yield made()

    def uncollected(batches):
        """Pieces and ids make no cycles, and looking for some among millions of them takes a tenth of the time."""
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()

    small_batches(spark)
    sampling = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    before = spark.conf.get(sampling)
    try:
        spark.conf.set(sampling, str(max(1, min(int(before), SAMPLED // parts))))
        ordered.mapInArrow(lambda batches: released(uncollected(batches)), SHARD).write.option("compression", "zstd").parquet(f"{path}/shards")
    finally:
        spark.conf.set(sampling, before)


def starts(shards: DataFrame) -> DataFrame:
    """(part, seq, start): ids in all shards before. Sums by part first, so that one task sees a row a part only."""
    small = shards.select("part", "seq", "n_tokens")
    parts = small.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inner = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return small.select("part", "seq", inner.alias("inner")).join(parts, "part").select("part", "seq", (F.col("before") + F.col("inner")).alias("start"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD).parquet(f"{path}/shards")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files: each key is looked up in its shard's index."""
    shards = read(spark, path)
    first = starts(shards)
    placed = shards.join(F.broadcast(first) if shards.count() <= BROADCAST_SHARDS else first, ["part", "seq"])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                shard, base = Shard(row), row["start"]
                n = shard.numbers()
                spans = [shard.bounds(k) for k in n.tolist()]
                crc = [zlib.crc32(shard.ids[a:b].astype("<u4").tobytes()) for a, b in spans]
                yield pa.RecordBatch.from_arrays([
                    pa.array(shard.keys, pa.int64(), mask=~shard.known), pa.array([base + a for a, _ in spans], pa.int64()), pa.array([b - a for a, b in spans], pa.int64()), pa.array(crc, pa.int64()),
                ], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(lambda batches: released(run(batches)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """(key, ids) of the given keys: only shards whose range holds one are read."""
    wanted = sorted({int(k) for k in keys})
    shards = read(spark, path)
    hold = F.lit(False)
    for k in wanted:
        hold = hold | F.lit(k).between(F.col("first_key"), F.col("last_key"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                out = [(k, ids.astype(np.int64).tolist()) for k in wanted for ids in shard.get(k)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([x for _, x in out], pa.list_(pa.int64()))], ["key", "ids"])

    return shards.where(hold).mapInArrow(run, "key long, ids array<long>")


def encode_and_read(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    path = Scratch(spark, "tokens").root
    write(spark, docs, path, **how)
    return digests(spark, path)
