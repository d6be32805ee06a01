import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from millrace.llm import queries as Q
from millrace.llm import token_store as T
from millrace.llm.common import Scratch
from millrace.llm.perfect_hash import PerfectHash


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(T.vocabulary())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


TEXTS = [
    None, "", " ", "\n\n\n x", "a  b\t\tc \x85 d\xa0\xa0e", "don't I'll we've 'sx ''s '", "Ünïcödé straße ªº²³¼½ 12³4", "日本語 тест 😀 a\x1cb\x00c", "<|endoftext|>a<|endoftext|>",
    "tabs\r\n\r\n  end  ", "x" * 5000, "!?…—“”", "ǅ ɏ ɐ ə", "  wide space",
]


def test_encoder_equals_library(plain):
    enc = T.Encoder(T.vocabulary())
    rng = random.Random(4)
    signs = [chr(c) for c in (*range(32, 127), 9, 10, 11, 12, 13, 0x85, 0xA0, *range(0xA1, 0x250))] + [" ", " ", "'", "\n", "s", "t"] * 20
    texts = [t or "" for t in TEXTS] + [" lead", "trail ", "a\nb c\nd", "a \nb", "one two\nthree's four 日本 語,\nсловo ok", "x\u3000y z", "a\x1c b", "it's 'tis\n's 's\n'", "a b" * 50]
    texts += ["".join(rng.choice(["the", "Über", "x9", "$$", "日", "'s", "."]) + rng.choice([" ", " ", "\n", ""]) for _ in range(rng.randrange(1, 60))).strip() for _ in range(300)]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(200))) for _ in range(400)]
    for t, packed in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(packed, "<u2").tolist() == plain(t), repr(t)


def test_full_cache_still_encodes(plain, monkeypatch):
    monkeypatch.setattr(T, "CACHE_PIECES", 3)
    enc = T.Encoder(T.vocabulary())
    for _ in range(2):
        for t in ("one two three four five", "six seven one"):
            assert np.frombuffer(enc.encode([t])[0], "<u2").tolist() == plain(t)


def test_round_trip(spark, plain):
    rows = [(7 * k % 101 - 20, t) for k, t in enumerate(TEXTS * 3)] + [(None, "no id"), (None, None), (5000, "twice"), (5000, "twice"), (5000, "also")]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, seq int")
    path = Scratch(spark, "test").root
    T.write(spark, df, path, shard_ids=900)
    assert T.read(spark, path).count() > 5
    want, at = [], 0
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*plain(t), 2]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, T.digests(spark, path).collect()), key=lambda r: r[1]) == want
    got = sorted((r.key, r.ids) for r in T.lookup(spark, path, [5000, rows[3][0], 999_999]).collect())
    assert got == sorted((k, [*plain(t), 2]) for k, t in rows if k in (5000, rows[3][0]))


def test_empty_table(spark):
    assert T.encode_and_read(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64))
        h = PerfectHash.load(PerfectHash.build(keys).dump())
        assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([3, 3], np.uint64))


def test_foreign_keys_are_refused():
    row = T.shard_row(0, 0, [1, 5, 9], [b"\1\0", b"\2\0", b"\3\0"], 2)
    assert T.Shard(row).find(np.arange(2000)).tolist().count(-1) == 1997


def test_queries_have_the_ids_of_the_plain_library(spark):
    library = Tokenizer.from_file(T.vocabulary())
    rows = [(k, t) for k, t in enumerate([*TEXTS, "a<|endoftext|>b", "it's <|endoftext|> <|endoftext", "x <|endoftext|>\n日本"])]
    df, folder = spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "documents").root
    df.write.parquet(f"{folder}/documents.parquet")
    want, at = [], 0
    for k, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert 50256 in library.encode("a<|endoftext|>b", add_special_tokens=False).ids
    for got in (Q.op3_token_store(spark, folder), P.write_tokens(spark, df, folder)):
        assert sorted(map(tuple, got.collect())) == want
