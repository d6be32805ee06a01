from concurrent.futures import ThreadPoolExecutor

import pytest

from millrace.llm.common import Scratch
from millrace.llm.shard_store import Conflict, Run, ShardStore

SCHEMA = "doc_id long, text string, part int"


def frame(spark, n, at=0):
    return spark.createDataFrame([(at + i, f"text {at + i}" * 20, None) for i in range(n)], SCHEMA)


@pytest.fixture
def store(spark):
    return ShardStore(spark, Scratch(spark, "test-store").root, target=1 << 20)


def test_append_compact_vacuum(spark, store):
    for k in range(9):
        store.append(frame(spark, 50, 50 * k))
    assert len(store.runs()) == 9 and store.versions() == list(range(1, 10))
    before = sorted(map(tuple, store.read().collect()))
    assert store.compact() == 1 and [len(r.files) for r in store.runs()] == [1]
    assert sorted(map(tuple, store.read().collect())) == before and len(before) == 450
    assert sorted(map(tuple, store.read(version=9).collect())) == before
    store.vacuum()
    assert store.versions() == [10] and sorted(map(tuple, store.read().collect())) == before


def test_merges_only_runs_of_a_tier(spark, store):
    big = Run("big", ("a",), 300 << 20)
    small = [Run(str(k), ("a",), 1 << 21) for k in range(4)]
    assert big.tier() > small[0].tier() > Run("x", (), 5).tier() == 0
    store.commit(0, [big, *small[:3]])
    assert store.due() == []
    store.commit(1, [big, *small])
    assert store.due() == small


def test_commit_is_all_or_nothing(spark, store):
    other = ShardStore(spark, store.root)
    store.append(frame(spark, 3))
    with pytest.raises(Conflict):
        other.commit(0, [])
    assert store.versions() == [1] and store.read().count() == 3


def test_arrivals_nulls_and_repeats(spark, store):
    rows = [(1, "a", 0), (1, "a", 0), (None, None, 1), (2, "b", None), (3, "c", 2)]
    store.append_arrivals(spark.createDataFrame(rows, SCHEMA), "part")
    assert len(store.runs()) == 4
    store.compact()
    store.vacuum()
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(map(tuple, store.read(schema=SCHEMA).collect()), key=key) == sorted(rows, key=key)


def test_empty(spark, store):
    assert store.read(schema=SCHEMA).collect() == [] and store.compact() == 0
    store.append(frame(spark, 0))
    assert store.versions() == [1] and store.runs() == []


def test_abandoned_files_are_deleted_once_they_are_old(spark, store):
    store.append(frame(spark, 5))
    frame(spark, 5).write.parquet(f"{store.root}/runs/abandoned")
    there = lambda: store._fs.exists(store._path(f"{store.root}/runs/abandoned"))
    store.vacuum()
    assert there()  # it may be a writer's that is about to commit
    store.vacuum(abandoned=-60)
    assert store.read().count() == 5 and not there()


def test_writers_at_once_lose_nothing(spark, store):
    others = [ShardStore(spark, store.root, target=1 << 20) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: [others[k].append(frame(spark, 10, 100 * k + 10 * i)) for i in range(3)], range(4)))
    assert store.versions()[-1] == 12 and sorted(r.doc_id for r in store.read().collect()) == sorted(100 * k + i for k in range(4) for i in range(30))
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda s: s.compact(), others[:3]))
    assert store.read().count() == 120 and len(store.due()) == 0


def test_a_run_in_between_is_not_lost_by_compaction(spark, store, monkeypatch):
    for k in range(4):
        store.append(frame(spark, 10, 10 * k))
    commit, other = store.commit, ShardStore(spark, store.root)

    def late(base, runs):
        monkeypatch.setattr(store, "commit", commit)
        other.append(frame(spark, 10, 40))
        return commit(base, runs)

    monkeypatch.setattr(store, "commit", late)
    assert store.compact() == 1 and sorted(r.doc_id for r in store.read().collect()) == list(range(50))


def test_columns_of_any_name_and_long_texts(spark, store):
    df = spark.createDataFrame([(1, "x" * 3_000_000, 2), (2, None, None)], "__run int, text string, `__RUN_` int")
    store.append_arrivals(df, "__run")
    assert sorted(map(tuple, store.read(schema=df.schema).collect())) == sorted(map(tuple, df.collect())) and len(store.runs()) == 2
