import gzip
import hashlib
import io
import pathlib

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import queries as Q
from millrace.llm import warc_fixity as W
from millrace.llm.common import Scratch

ROWS = [(k, f"http://h/{k}", "<p>é" + "x" * (k * 37 % 400) + "\r\n\r\nWARC/1.1</p>") for k in range(120)] + [(None, None, None), (500, "http://h/500", ""), (500, "http://h/500", ""), (501, "u", "y" * 50_000)]


@pytest.fixture(scope="module")
def archive(spark):
    path = f"{Scratch(spark, 'test-warc').root}/first"
    W.write(spark.createDataFrame([(*r, 3) for r in ROWS], "page_id long, url string, html string, part int").repartition(5), path, block_bytes=3000)
    return path


def test_records_come_back(spark, archive):
    got = sorted((r.key is not None, r.key or 0, r.url or "", r.body) for r in W.records(spark, archive).collect())
    assert got == sorted((k is not None, k or 0, u or "", b or "") for k, u, b in ROWS)


def audit(spark, archive, change):
    second = f"{Scratch(spark, 'test-warc').root}/second"
    W.copy(spark, archive, second, change)
    return W.fixity(spark, archive, second).collect()


def test_sound_replica_and_digests(spark, archive):
    got = audit(spark, archive, None)
    assert len(got) == len(ROWS) and not any(r.damaged for r in got)
    by = {r.key: r for r in got}
    body = ROWS[7][2].encode()
    m = hashlib.md5(b"7\nhttp://h/7\n" + body).hexdigest()
    urn = f"<urn:uuid:{m[:8]}-{m[8:12]}-{m[12:16]}-{m[16:20]}-{m[20:]}>"
    head = {"WARC-Type": "resource", "WARC-Record-ID": urn, "WARC-Date": "2000-01-01T00:00:00Z", "WARC-Target-URI": "http://h/7", "X-Record-Key": "7", "Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(body))}
    raw = "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in head.items()), "", ""]).encode() + body + b"\r\n\r\n"
    assert (by[7].n_bytes, by[7].digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert W.parse(raw) == [({k.lower(): v for k, v in head.items()}, body)]


ODD = [(1, "http://h/a b", "x"), (2, "http://h/\r\n\r\nWARC/1.1\r\nContent-Length: 0", "y"), (3, "", "z"), (4, None, "z"), (5, "http://h/\x00\x7f\té%20", "é"), (None, "u: v", None)]
SAFE = {1: "http://h/a%20b", 2: "http://h/%0D%0A%0D%0AWARC/1.1%0D%0AContent-Length:%200", 3: None, 4: None, 5: "http://h/%00%7F%09é%20", None: "u:%20v"}


def test_odd_urls(spark):
    path = f"{Scratch(spark, 'test-warc').root}/odd"
    W.write(spark.createDataFrame(ODD, "page_id long, url string, html string"), path)
    got = W.records(spark, path).collect()
    assert {r.key: r.url for r in got} == SAFE and {r.key: r.body for r in got} == {k: b or "" for k, _, b in ODD}


@pytest.mark.parametrize("compress", [True, False])
def test_files_round_trip(spark, archive, compress):
    folder = f"{Scratch(spark, 'test-warc').root}/files"
    files = W.export(spark, archive, folder, compress).collect()
    assert sum(r.n_records for r in files) == len(ROWS) and len(files) > 5
    assert W.export(spark, archive, folder, compress).count() == len(files)  # the same files again
    got = sorted((r.key is not None, r.key or 0, r.url or "", r.body) for r in W.read_files(spark, folder).collect())
    assert got == sorted((k is not None, k or 0, u or "", b or "") for k, u, b in ROWS)
    names = [p.name for p in pathlib.Path(folder.removeprefix("file://")).iterdir() if not p.name.startswith(".")]
    assert sorted(names) == sorted(r.name for r in files)


def test_files_of_other_writers(spark, tmp_path):
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\na:b\r\n\r\n"
    answer = b"WARC/1.0\r\nwarc-type: response\r\nWARC-Target-URI: http://h/\r\nX-Record-Key: not a number\r\nContent-Length: 22\r\n\r\nHTTP/1.1 200 OK\r\n\r\n\xff\xfe!\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(answer))
    (tmp_path / "b.warc").write_bytes(info)
    (tmp_path / "notes.txt").write_text("no archive")
    got = sorted(tuple(r) for r in W.read_files(spark, f"file://{tmp_path}").collect())
    assert [(n, t, k, u) for n, t, k, u, _ in got] == [("a.warc.gz", "response", None, "http://h/"), ("a.warc.gz", "warcinfo", None, None), ("b.warc", "warcinfo", None, None)]
    assert got[0][4] == "HTTP/1.1 200 OK\r\n\r\n\ufffd\ufffd!" and got[1][4] == "a:b"


@pytest.mark.parametrize("chunk", [1, 7, 100, 1 << 20])
def test_streams_of_any_chunks(chunk):
    raws = [b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in (b"", b"\r\n\r\nWARC/1.1", bytes(range(256)) * 9)]
    for packed in (b"".join(raws), b"".join(map(gzip.compress, raws)), gzip.compress(b"".join(raws))):
        assert [b for _, b in W.stream(io.BytesIO(packed), chunk)] == [b"", b"\r\n\r\nWARC/1.1", bytes(range(256)) * 9]
    assert list(W.stream(io.BytesIO(b""), chunk)) == []
    for broken in (b"WARC/1.1\r\nWARC-Type: x\r\n\r\n", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc", b"WARC/1.1\r\nContent", b"HTTP/1.1 200\r\n\r\n"):
        with pytest.raises(ValueError):
            list(W.stream(io.BytesIO(broken), chunk))


def test_query_equals_its_sql(spark):
    folder = Scratch(spark, "test-warc").root
    spark.createDataFrame([(k, u if k != 5 else "http://h/é%20", b) for k, u, b in ODD] + ROWS, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder.removeprefix('file://')}/pages.parquet/*.parquet'")
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    got = [(r.page_id, r.n_bytes, r.digest, r.damaged) for r in Q.op8_warc_fixity(spark, folder).collect()]
    assert sorted(got, key=key) == sorted(con.execute(f"SELECT page_id, n_bytes, digest, damaged FROM ({Q.OP8_SQL})").fetchall(), key=key)


@pytest.mark.parametrize("hurt", [{3}, {0, 55, 119, 501}, set(range(120)), {None}])
def test_finds_exactly_the_damaged_records(spark, archive, hurt):
    got = audit(spark, archive, lambda k, raw: raw[:-1] + b"!" if k in hurt else raw)
    assert {r.key for r in got if r.damaged} == hurt and len(got) == len(ROWS)


def test_missing_block(spark, archive):
    scratch = Scratch(spark, "test-warc")
    first = scratch.save(W.manifest(spark, archive), "m")
    gone = first.orderBy("part", "seq").first()
    second = scratch.save(first.where(f"not (part = {gone.part} and seq = {gone.seq})"), "m")
    bad = W.audit(spark, scratch, first, second).collect()
    assert bad and {(r.part, r.seq) for r in bad} == {(gone.part, gone.seq)} and len(bad) == len(gone.ends) // 8


def test_root_is_of_all_blocks(spark, archive):
    scratch = Scratch(spark, "test-warc")
    m = scratch.save(W.manifest(spark, archive), "m")
    leaves = W.numbered(m.select("part", "seq")).join(m, ["part", "seq"]).select("node", F.col("leaf").alias("digest"))
    tree = W.Tree(scratch, leaves)
    nodes = [r.digest for r in sorted(leaves.collect())]
    assert sorted(r.node for r in leaves.collect()) == list(range(len(nodes)))
    while len(nodes) > 1:
        nodes = [hashlib.sha256("|".join(f"{at + i}:{d}" for i, d in enumerate(nodes[at : at + W.FANOUT])).encode()).hexdigest() for at in range(0, len(nodes), W.FANOUT)]
    assert tree.root() == nodes[0] and len(tree.levels) >= 3


def test_empty(spark):
    root = Scratch(spark, "test-warc").root
    W.write(spark.createDataFrame([], "page_id long, url string, html string"), f"{root}/a")
    W.copy(spark, f"{root}/a", f"{root}/b")
    assert W.fixity(spark, f"{root}/a", f"{root}/b").collect() == []
