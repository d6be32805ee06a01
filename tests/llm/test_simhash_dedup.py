import random

import numpy as np
import pytest
import xxhash

from millrace.llm import simhash_dedup as S


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(rows):
    """{row number: least id of its class}, by all pairs."""
    fps = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k if k is not None else -1, f"{fps[i]:016x}", least.get(find(i), -1)) for i, (k, _) in enumerate(rows))


def got(spark, df):
    rows = S.near_duplicates(spark, df).collect()
    return sorted((r.doc_id if r.doc_id is not None else -1, f"{r.fp & (2**64 - 1):016x}", -1 if r.component_id is None else r.component_id) for r in rows)


def test_fingerprint_matches_plain_form():
    rng = random.Random(1)
    for t in ["", None, " \n", "One", "a b c", "A\tb\x0bc d É É", "x\xa0y z", "é" * 50, *(" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 90))) for _ in range(40))]:
        assert S.fingerprint(t.encode() if t is not None else None) == plain_fingerprint(t)


def test_long_text():
    t = " ".join(str(i % 977) for i in range(200_000))
    assert S.fingerprint(t.encode()) == plain_fingerprint(t)


def test_classes_match_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP_LEAST", 16)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randrange(5, 120))] for _ in range(60)]
    rows = []
    for k in range(400):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((k * 3 + 1, " ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, "one"), (5002, "one"), (None, "one"), (None, "lonely words stand here")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, fp int, component_id int")
    assert got(spark, df) == plain_classes(rows)


def test_empty_table(spark):
    assert S.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_forest_spans_every_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ np.uint64(1 << int(b)) for b in rng.integers(0, 63, 12))]))
    for a, b in ((fps, None), (fps[::2], fps[1::2])):
        x, y = S.forest(a, b, block=(7, 13))
        nodes = fps.tolist()
        parent = {n: n for n in nodes}

        def find(n):
            while parent[n] != n:
                n = parent[n]
            return n

        for i, j in zip(x.tolist(), y.tolist()):
            parent[find(i)] = find(j)
        pairs = [(i, j) for i in a.tolist() for j in (a if b is None else b).tolist() if (i ^ j).bit_count() <= 4]
        assert pairs and all(find(i) == find(j) for i, j in pairs)
        assert len(x) <= len(nodes)


def test_groups_cover_all_near_cells(spark):
    cells = [(h, l, 50 + h * l + 20_000 * (h == 12)) for h in range(10, 24) for l in range(9, 22)]
    routes = S.deal(cells)
    pairs = [tuple(r) for r in S.pair_table(spark, S.near_ranges(routes, 4)).collect()]
    assert len(pairs) == len(set(pairs)) and max(parts for *_, parts in routes) > 1
    held = {(h, l): range(first, first + parts) for h, l, first, parts in routes}
    assert len(held) == len(cells)
    for a in held:
        for b in held:
            if abs(a[0] - b[0]) + abs(a[1] - b[1]) <= 4:
                assert all((min(g, k), max(g, k)) in set(pairs) for g in held[a] for k in held[b])


@pytest.mark.parametrize("extra", [[], [(1, "a b c d e")], [(3, "a b c d e"), (2, "a b c d e")]])
def test_deduplicate_keeps_one_of_each_class(spark, extra):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (3, "other words of another text"), (None, "a b c d e"), *extra]
    kept = S.deduplicate(spark, spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, root string"))
    assert kept.columns == ["doc_id", "text", "root"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_deduplicate_keeps_one_of_each_class_whatever_its_ids(spark):
    own = ["lonely words stand here all by themselves", "quite another text about rivers and stones", "a third one that nobody else has written", "the fourth is on ships and their captains"]
    rows = [(None, own[0], "a"), (7, own[1], "b"), (7, own[2], "c"), (None, own[3], "e"), (None, own[3], "d"), (9, own[2], "f"), (2, "a b c d e", "g"), (None, "a b c d e", "h"), (2, "a b c d e", "g"), (11, "plain words once", "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, root string")
    kept = S.deduplicate(spark, df)
    assert kept.columns == df.columns
    want = [(None, own[0], "a"), (7, own[1], "b"), (7, own[2], "c"), (None, own[3], "d"), (2, "a b c d e", "g"), (11, "plain words once", "i")]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)
