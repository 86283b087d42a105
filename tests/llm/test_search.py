"""Exact searches against brute force."""

import numpy as np
import pytest

from rasterspark.llm import blocks, neighbours, threshold
from rasterspark.llm.queries import queries
from rasterspark.session import shared_dir

SCHEMA = "vec_id long, embedding array<float>, label int, block int, n int, score string"


def vectors(n=400, dims=8, seed=3):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, dims)).astype(np.float32)
    data[50:90] = data[100]  # copies: ties on both sides
    data[7] = 0
    return {i: v for i, v in enumerate(data)}


def frame(spark, known, more=()):
    rows = [(int(i), [float(x) for x in v], 1, 2, 3, "s") for i, v in known.items()]
    return spark.createDataFrame([*rows, *more], SCHEMA)


BAD = [(1000, None, 1, 2, 3, "s"), (1100, [1.0, None] + [0.0] * 6, 1, 2, 3, "s"), (1200, [float("nan")] * 8, 1, 2, 3, "s"), (1300, [float("inf")] * 8, None, 2, 3, "s"), (None, [1.0] * 8, 1, 2, 3, "s")]


def brute(known, every, k, score):
    out = {}
    for q in (q for q in known if q % every == 0):
        hits = sorted(((-score(known[q], v), i) for i, v in known.items() if i != q and score(known[q], v) is not None))[:k]
        out[q] = [(i, -s) for s, i in hits]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def whole(v):
    return [int(np.floor(np.float64(x) * 1024)) for x in v]


@pytest.mark.parametrize("block_rows", [64, 4096])
def test_threshold_equals_brute_force(spark, block_rows):
    known = vectors()
    got = found(threshold.top_k(frame(spark, known, BAD), every=20, k=10, block_rows=block_rows))
    assert got == brute(known, 20, 10, lambda a, b: sum(x * y for x, y in zip(whole(a), whole(b), strict=True)))


def test_threshold_stops_early():
    rng = np.random.default_rng(0)
    data = np.floor(rng.pareto(1.5, size=(20_000, 3)) * 50)
    ids, scored = np.arange(20_000), []
    lists = threshold.SortedLists(ids, data)
    for i in range(20):
        query = rng.random(3)
        at, scores, n = lists.top(-1, query, 10)
        want = blocks.best_of(ids, data @ query, 10)
        assert at.tolist() == want.tolist() and np.allclose(scores, data[want] @ query)
        scored.append(n)
    assert max(scored) < 10_000


def test_fewer_candidates_and_repeated_rows(spark):
    known = {0: np.ones(3, np.float32), 5: np.ones(3, np.float32), 9: np.array([1, 0, 0], np.float32)}
    df = frame(spark, known).unionByName(frame(spark, known))
    assert found(threshold.top_k(df, every=100, k=10)) == {0: [(5, 3 * 1024 * 1024), (9, 1024 * 1024)]}
    assert threshold.top_k(df.limit(0)).collect() == []
    got = found(neighbours.nearest(df, every=50))
    assert [i for i, _ in got[0]] == [5, 9] and got[0][0][1] == pytest.approx(1)
    assert neighbours.nearest(df.limit(0)).collect() == []


def cosine(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    if not a.any() or not b.any():
        return None
    return float(neighbours.cosines(a[None], b[None])[0])


@pytest.mark.parametrize("block_rows", [64, 4096])
def test_neighbours_equal_brute_force(spark, block_rows):
    known = vectors(dims=12)
    got = found(neighbours.nearest(frame(spark, known, [(i, v and v + [0.0] * 4, *r) for i, v, *r in BAD if i]), every=10, k=5, block_rows=block_rows))
    known.pop(7)
    assert got == brute(known, 10, 5, cosine)


def test_bounds_hold_for_extreme_scales():
    rng = np.random.default_rng(1)
    data = rng.normal(size=(300, 16)) * 10.0 ** rng.integers(-150, 150, size=(300, 1))
    ids = np.arange(300)
    q, got, scores = neighbours.tile(5)(ids, data, ids, data, np.full(300, -np.inf))
    for i in range(300):
        want = sorted((-cosine(data[i], data[j]), j) for j in range(300) if j != i)[:5]
        assert got[q == i].tolist() == [j for _, j in want]


def test_registered_queries_cover_the_table(spark):
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.001/embeddings.parquet")
    known = dict(zip(table["vec_id"].to_pylist(), table["embedding"].to_pylist(), strict=True))
    got = found(queries()["op4_threshold_top_k"](spark, "/root/testdata/sf0.001"))
    ints = {i: np.array(whole(np.float32(v)), np.int64) for i, v in known.items()}
    assert got == brute(ints, 100, 10, lambda a, b: int(a @ b))
    assert len(found(queries()["op8_neighbours"](spark, "/root/testdata/sf0.001"))) == sum(i % 50 == 0 for i in known)


def by_rows(rows, every, k, score):
    """For each query row the scores and ids of the k best other rows, as a sorted list over all query rows."""
    out = []
    for i, (q, u) in enumerate(rows):
        if q % every == 0:
            hits = sorted(((-score(u, v), c) for j, (c, v) in enumerate(rows) if j != i))[:k]
            out.append((q, [(c, -s) for s, c in hits]))
    return sorted(out, key=repr)


def plain_cosine(a, b):
    a, b = [float(x) for x in a], [float(x) for x in b]
    dot = sum(x * y for x, y in zip(a, b, strict=True))
    return round(dot / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5, 9)


@pytest.mark.parametrize("block_rows", [16, 4096])
def test_every_row_is_a_query_and_a_candidate_of_its_own(spark, block_rows):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(60, 6)).astype(np.float32)
    rows = [(i, data[i]) for i in range(60)] + [(0, data[7]), (0, data[0]), (0, data[0]), (20, data[3])] + [(21, data[50])] * 40
    df = spark.createDataFrame([(i, [float(x) for x in v], 1, 2, 3, "s") for i, v in rows], SCHEMA)
    got = threshold.top_k(df, every=20, k=10, block_rows=block_rows, repeats=True).collect()
    want = by_rows([(i, whole(v)) for i, v in rows], 20, 10, lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)))
    pairs = lambda q, hits: [(q, n + 1, c, s) for n, (c, s) in enumerate(hits)]
    assert sorted(tuple(r) for r in got) == sorted(x for q, hits in want for x in pairs(q, hits))
    got = neighbours.nearest(df, every=20, k=5, block_rows=block_rows, repeats=True).collect()
    want = by_rows(rows, 20, 5, plain_cosine)
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got) == sorted(x for q, hits in want for x in pairs(q, hits))


def test_vectors_of_different_length_do_not_meet(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [1.0]), (100, [3.0]), (3, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, 1, 2, 3, "s") for i, v in rows], SCHEMA)
    assert found(threshold.top_k(df, factor=1, repeats=True)) == {0: [(1, 4)], 100: [(2, 3)]}
    assert [(r.query_id, r.vec_id) for r in neighbours.nearest(df, repeats=True).orderBy("query_id").collect()] == [(0, 1), (100, 2)]


def test_registered_neighbours_equal_a_plain_scan(spark):
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.001/embeddings.parquet")
    rows = list(zip(table["vec_id"].to_pylist(), table["embedding"].to_pylist(), strict=True))
    got = queries()["op8_neighbours"](spark, "/root/testdata/sf0.001").collect()
    want = {q: hits for q, hits in by_rows(rows, 50, 5, plain_cosine)}
    assert {(r.query_id, r.rank): (r.vec_id, round(r.score, 9)) for r in got} == {(q, n + 1): hit for q, hits in want.items() for n, hit in enumerate(hits)}


def test_cosines_are_those_of_plain_sums():
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(2, 200, 64))
    for x, y, s in zip(a, b, neighbours.cosines(a, b), strict=True):
        dot = xx = yy = 0.0
        for u, v in zip(x.tolist(), y.tolist(), strict=True):
            dot, xx, yy = dot + u * v, xx + u * u, yy + v * v
        assert s == dot / np.sqrt(xx * yy)
    assert neighbours.cosines(a[:1] * 1e200, b[:1] * 1e-200) == pytest.approx(neighbours.cosines(a[:1], b[:1]))


def test_searches_broadcast_no_blocks(spark):
    """A copy of a query block for each candidate block is more than the driver holds, however small the query table is."""
    df = frame(spark, vectors(n=200))
    for found_rows in (threshold.top_k(df, block_rows=16, repeats=True), neighbours.nearest(df, block_rows=16, repeats=True)):
        found_rows.collect()
        assert "Broadcast" not in found_rows._jdf.queryExecution().executedPlan().toString()


def test_several_groups_of_query_blocks(spark):
    known = vectors(n=110, dims=3)
    df = frame(spark, known)
    got = found(threshold.top_k(df, every=1, k=4, block_rows=1))
    assert got == brute(known, 1, 4, lambda a, b: sum(x * y for x, y in zip(whole(a), whole(b), strict=True)))
    known.pop(7)
    assert found(neighbours.nearest(df, every=1, k=4, block_rows=1)) == brute(known, 1, 4, cosine)


def test_threshold_tiles_walk_or_score_whole():
    """Walks that stop early, whole tiles by one product and products beyond float32 give the same as brute force."""
    from types import SimpleNamespace

    import pyarrow as pa

    rng = np.random.default_rng(2)
    for shape, scale in ((3, 50), (3, 5000), (40, 50)):
        data = np.floor(rng.pareto(1.5, size=(6000, shape)) * scale)
        ids = np.arange(6000)
        held = lambda a, b: SimpleNamespace(own=ids[a:b], ids=ids[a:b], vectors=blocks.narrow(data[a:b]), more=pa.py_buffer(threshold.sorted_order(data[a:b]).tobytes()))  # noqa: B023, E731
        queries, best = threshold.left(held(0, 100)), blocks.Best(ids[:100], ids[:100], 10)
        for a in range(0, 6000, 2000):
            candidates = threshold.right(held(a, a + 2000))
            short = (candidates[0].depths(queries.vectors, best.floors) * shape < 2000).sum()
            assert short == 0 if a == 0 else shape == 40 or short > 50
            best.add(*threshold.tile(10)(ids[:100], queries, candidates, best.floors))
        for i in range(100):
            scores = data @ data[i]
            scores[i] = -np.inf
            want = blocks.best_of(ids, scores, 10)
            assert best.ids[i].tolist() == want.tolist() and best.scores[i].tolist() == scores[want].tolist()


def test_neighbours_keep_floors_over_blocks():
    """Later blocks give fewer candidates, and the best over all blocks are those of brute force."""
    rng = np.random.default_rng(6)
    data, ids = rng.normal(size=(1500, 24)).astype(np.float32), np.arange(1500)
    data[700:720] = data[3]
    queries, best, given = neighbours.Side(ids[:50], ids[:50], data[:50]), blocks.Best(ids[:50], ids[:50], 5), []
    for a in range(0, 1500, 300):
        found_pairs = neighbours.near(5)(ids[:50], queries, neighbours.Side(ids[a : a + 300], ids[a : a + 300], data[a : a + 300]), best.floors)
        given.append(len(found_pairs[0]))
        best.add(*found_pairs)
    assert given[-1] < given[0]
    for i in range(50):
        want = sorted((-cosine(data[i], data[j]), j) for j in range(1500) if j != i)[:5]
        assert [(-s, j) for s, j in zip(best.scores[i], best.ids[i], strict=True)] == want


@pytest.mark.parametrize("repeats", [True, False])
def test_copies_beyond_the_first_are_no_candidates(spark, repeats):
    """Of rows that are mostly copies, few are scored and all that no step reads any more goes; the results are those of all rows."""
    import glob

    rng = np.random.default_rng(9)
    data = rng.normal(size=(12, 5)).astype(np.float32)
    known = {i: data[0 if i % 3 else i % 12] for i in range(600)}
    before = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/rasterspark/neighbours-*"))
    got = found(neighbours.nearest(frame(spark, known), every=20, k=3, block_rows=8, repeats=repeats))
    assert got == brute(known, 20, 3, cosine)
    at, = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/rasterspark/neighbours-*")) - before
    assert {p.rsplit("/", 1)[1] for p in glob.glob(f"{at}/*")} == {"queries", "candidates"}
    held = spark.read.parquet(f"{at}/candidates").selectExpr("sum(length(ids) / 8)", "max(length(vectors) / length(ids))").first()
    assert tuple(held) == (4 * 4, 5 * 4 / 8)  # four vectors; components as float32


def test_groups_of_blocks_are_dealt_evenly(spark):
    """Each task has one group; by a hash some had none and others several."""
    for found_rows in (threshold.top_k(frame(spark, vectors()), block_rows=16, repeats=True), neighbours.nearest(frame(spark, vectors()), block_rows=16, repeats=True)):
        plan = found_rows._jdf.queryExecution().executedPlan().toString()
        dealt = [x for x in plan.splitlines() if "REPARTITION_BY_NUM" in x]
        assert len(dealt) == 1 and "hashpartitioning" not in dealt[0], plan
