"""Near duplicates against brute force on all pairs."""

import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from rasterspark.llm import neardup
from rasterspark.llm.components import connected
from rasterspark.llm.queries import queries
from rasterspark.llm.textbytes import flat
from rasterspark.session import Scratch

_UP = {c: c + 32 for c in range(65, 91)}


def word_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_UP))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size, percent):
    """[(doc_id, n, component)] by comparing all pairs that share a shingle."""
    sets = [(key, word_set(text, size)) for key, text in rows]
    at = defaultdict(set)
    for i, (key, s) in enumerate(sets):
        if key is not None:
            for x in s:
                at[x].add(i)
    root = {key: key for key, _ in sets if key is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (key, s) in enumerate(sets):
        if key is None:
            continue
        for j in set().union(*(at[x] for x in s)) if s else ():
            t = sets[j][1]
            if j > i and 100 * len(s & t) >= percent * len(s | t):
                a, b = find(key), find(sets[j][0])
                root[max(a, b)] = min(a, b)
    return sorted(((-1 if k is None else k), len(s), -1 if k is None else find(k)) for k, s in sets)


def found(df):
    rows = df.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in rows)


def test_registered_query_on_all_documents(spark):
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet")
    rows = list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True))
    assert found(queries()["op2_near_duplicates"](spark, "/root/testdata/sf0.01")) == brute(rows, 3, 85)


def edited(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize(("large", "grams"), [(10**9, 1), (2, 500), (64, 400_000)])
def test_large_group_of_near_copies_and_edge_cases(spark, monkeypatch, large, grams):
    monkeypatch.setattr(neardup, "LARGE", large)
    monkeypatch.setattr(neardup, "BLOCK_GRAMS", grams)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 30 if grams < 1000 else 2048)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, edited(rng, base, rng.choice([0, 1, 1, 2, 3]))) for i in range(1, 120)]
    rows += [(i, "Same text here, twice.") for i in range(200, 260)] + [(300, "one"), (301, "ONE "), (302, "two words"), (303, "Two\twords\n"), (304, None), (305, ""), (306, " \n"), (None, "Same text here, twice."), (307, "É é"), (308, "é é"), (1, edited(random.Random(5), base, 0))]
    rows += [(400, " ".join(f"l{i}" for i in range(20_000))), (401, " ".join(f"l{i}" for i in range(19_900)))]
    rng.shuffle(rows)
    df = spark.createDataFrame([(k, t, 1, "x", 2) for k, t in rows], "doc_id long, text string, n int, component string, key int")
    assert found(neardup.components(df, size=3, percent=80)) == brute(rows, 3, 80)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.components(df).collect() == [] and neardup.deduplicate(df).collect() == []


def test_deduplicate_keeps_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text, "a"), (3, text, "b"), (9, text + " more", "c"), (9, text + " more", "c"), (11, "clean text", "d"), (11, "clean text", "d"), (12, "another clean text", "e"), (None, text, "f"), (13, None, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = neardup.deduplicate(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or -1, r.kept) for r in out.collect()) == [(-1, "f"), (3, "b"), (11, "d"), (12, "e"), (13, "g")]


def test_texts_of_one_id_are_decided_by_themselves(spark):
    words = lambda name: " ".join(f"{name}{i}" for i in range(40))
    rows = [(5, words("a")), (5, words("b")), (5, words("c")), (5, words("c")), (3, words("a") + " more"), (7, words("b") + " more"), (8, words("c")), (9, words("d")), (9, words("e")), (6, ""), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text or "") for r in neardup.deduplicate(df).collect())
    assert got == sorted([(3, words("a") + " more"), (5, words("b")), (5, words("c")), (6, ""), (6, ""), (9, words("d")), (9, words("e"))])
    ids = sorted((r.doc_id, r.component_id) for r in neardup.components(df).collect())
    assert ids == sorted([(3, 3), (5, 3), (5, 5), (5, 5), (5, 5), (7, 5), (8, 5), (9, 9), (9, 9), (6, 6), (6, 6)])


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 150)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = connected(Scratch(spark, "test"), spark.createDataFrame(edges, "u long, v long"), "c").collect()
    want = {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 150)} | {i: 200 for i in (200, 201, 202)}
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_tables_reach_the_stated_recall():
    for percent in (80, 85, 90):
        m, s = neardup.tables(percent), percent / 100
        assert 1 - (1 - (1 - s**neardup.ROWS) ** m) ** 2 <= neardup.MISS
    assert neardup.tables(100) == 1


def test_signatures_collide_as_often_as_sets_agree():
    rng = np.random.default_rng(0)
    hits = []
    for _ in range(60):
        words = [f"x{i}" for i in rng.integers(0, 10**9, 220)]
        one, two = " ".join(words[:200]), " ".join(words[10:210])
        data, offsets = flat(pa.array([one, two]))
        a, b = neardup.signature(*neardup.sets(data, offsets, 1), 40)[:, 2:]
        hits.append((a == b).mean())
    jaccard = 190 / 210
    assert abs(np.mean(hits) - jaccard**neardup.ROWS) < 0.03


def test_sets_are_exact():
    texts = ["a b c a b c", "", "A  B", "x", "q w e r t y " * 50]
    grams, counts = neardup.sets(*flat(pa.array(texts)), 3)
    assert counts.tolist() == [len(word_set(t, 3)) for t in texts]
    assert len(set(itertools.chain(grams.tolist()))) == len(set().union(*(word_set(t, 3) for t in texts)))


@pytest.mark.parametrize("chunk", [7, 4096])
def test_blocks_find_every_joined_component(monkeypatch, chunk):
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    base = np.arange(60)
    sets = [np.unique(np.concatenate([rng.choice(base, 52, replace=False), rng.integers(100, 400, rng.integers(0, 9))])) for _ in range(40)]
    parts = rng.integers(0, 12, 40)

    def side(at):
        return np.array([len(sets[i]) for i in at]), np.array([parts[i] for i in at]), np.concatenate([sets[i] for i in at])

    def reach(pairs):
        root = {int(c): {int(c)} for c in parts}
        for u, v in pairs:
            whole = root[int(u)] | root[int(v)]
            for k in whole:
                root[k] = whole
        return root

    for left, right in ((range(40), None), (range(15), range(15, 40))):
        want = [(parts[i], parts[j]) for i in left for j in (right or left) if parts[i] != parts[j] and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
        got = neardup.joined_components(80, side(left), side(right) if right else None)
        assert want and reach(got) == reach(want) and len(got) < 12


def thue_morse(n, flip):
    out = "b" if flip else "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out


def test_words_that_collide_under_polynomials_stay_apart(spark):
    from rasterspark.llm.textbytes import span_hashes

    words = [thue_morse(n, flip) for n in (8, 64, 1024, 2048, 4096) for flip in (False, True)]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    assert len(set(span_hashes(data, ends - [len(w) for w in words], ends).tolist())) == len(words)
    sides = [" ".join(f"x{i} {thue_morse(n, flip)}" for i in range(4) for n in (1024, 2048, 4096)) for flip in (False, True)]
    rows = [(1, sides[0]), (2, sides[1]), (3, sides[0] + " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(neardup.components(df)) == brute(rows, 5, 80) == [(1, 20, 1), (2, 20, 2), (3, 20, 1)]
    assert sorted(r.doc_id for r in neardup.deduplicate(df).collect()) == [1, 2]


def test_hashes_depend_on_the_bytes_only():
    from rasterspark.llm.textbytes import span_hashes

    rng = np.random.default_rng(0)
    data = rng.integers(0, 3, 3000, dtype=np.uint8)
    starts = rng.integers(0, 2900, 4000)
    ends = starts + rng.integers(0, 90, 4000)
    got = {}
    for s, e, h in zip(starts, ends, span_hashes(data, starts, ends).tolist(), strict=True):
        assert got.setdefault(data[s:e].tobytes(), h) == h
    assert len(set(got.values())) == len(got) > 3000
    # the end of the data and what follows a span do not matter
    whole = span_hashes(data[:13], np.array([5]), np.array([13]))
    assert whole == span_hashes(data, np.array([5]), np.array([13]))


def test_both_ways_of_comparing_groups_agree(spark, monkeypatch):
    got = []
    for large in (2, 10**9):
        monkeypatch.setattr(neardup, "LARGE", large)
        got.append(found(queries()["op2_near_duplicates"](spark, "/root/testdata/sf0.001")))
    assert got[0] == got[1]
