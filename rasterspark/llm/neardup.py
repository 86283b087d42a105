"""Near-duplicate documents by MinHash with tensored banding.

A document is the set of its distinct word shingles. Two small collections of composed minhashes, a and
b, are computed for each set; the keys of the m * m hash tables are the pairs (a_i, b_j), so m * m tables
need 2 * m composed hashes only. A pair of similarity s meets in a table with probability
(1 - (1 - s**r)**m)**2, and m is chosen so that a pair at the threshold is missed with at most `MISS`.

Documents with equal sets are one node from the start. Nodes that share some a_i are compared with one of
them, the centre, if they also share a b_j with it; the centre is the node whose a_i are commonest, which in a
group of near copies is the one that most of them were made from. Where nodes that share an a_i then still
lie in several components, what lies across components is compared in full: in a small group the pairs
that share a table key, equal buckets taken once; in a large group all nodes, block against block, as products of
incidence matrices that give the joined components only. So no group is expanded into all its pairs, and
no link between two components of a bucket is left out.
Both ways find the same links but for the chance of a missed table key.
Candidates are confirmed on full sets, which are made once. A shingle is the 64-bit hash of its words, so two unequal
shingles of a pair of documents are taken for equal with probability n1 * n2 / 2**64 (2e-11 for 20,000 shingles each).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from rasterspark.llm.components import connected
from rasterspark.llm.textbytes import flat, lower_ascii, mix, release, shingles, slices, span_hashes, words
from rasterspark.session import Scratch

MISS = 1e-5
ROWS = 2  # minhashes composed into one
LARGE = 64  # nodes of an a_i from which they are compared in blocks
BLOCK_GRAMS = 400_000  # shingles of a block, on average
BLOCK_ROWS = 2048  # nodes of a block, on average
LARGE_PART = 512  # rows of a comparison after which memory is given back
CHUNK = 4096  # columns of an incidence matrix
GROUP = ["g1", "g2", "n"]  # digests and size of a set: what makes a node


def tables(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Size m of each collection for a similarity threshold in percent."""
    s = (percent / 100) ** rows
    return 1 if s >= 1 else math.ceil(math.log(miss / 2) / math.log(1 - s))


def sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after the other, and how many each text has."""
    low = lower_ascii(data)
    starts, ends, counts = words(low, offsets)
    grams, lengths = shingles(span_hashes(low, starts, ends), counts, size)
    edges = np.concatenate([[0], np.cumsum(lengths)])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        grams[a:b].sort()
    first = np.ones(len(grams), bool)
    first[1:] = grams[1:] != grams[:-1]
    first[edges[:-1][lengths > 0]] = True
    rows = np.repeat(np.arange(len(lengths)), lengths)
    return grams[first], np.bincount(rows[first], minlength=len(lengths))


def signature(grams: np.ndarray, counts: np.ndarray, m: int, rows: int = ROWS) -> np.ndarray:
    """For each text g1, g2 (a digest of the whole set), a_1..a_m, b_1..b_m; zeros for empty sets."""
    out = np.zeros((len(counts), 2 + 2 * m), np.uint64)
    some = counts > 0
    if some.any():
        heads = (np.cumsum(counts) - counts)[some]
        out[some, 0] = np.add.reduceat(mix(grams + np.uint64(0x51ED2701)), heads)
        out[some, 1] = np.add.reduceat(mix(grams ^ np.uint64(0xA5A5F00DCAFE1234)), heads)
        seeds = mix(np.arange(1, 4 * m * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for k in range(2 * m):
            acc = np.full(int(some.sum()), np.uint64(k + 1), np.uint64)
            for r in range(rows):
                t = 2 * (k * rows + r)
                values = grams * (seeds[t] | np.uint64(1)) + seeds[t + 1]
                values ^= values >> np.uint64(32)
                acc = mix(acc * np.uint64(0xD1342543DE82EF95) + np.minimum.reduceat(values, heads))
            out[some, 2 + k] = acc
    return out


def _signed(df: DataFrame, size: int, m: int) -> DataFrame:
    names = ["g1", "g2", *(f"a{i}" for i in range(m)), *(f"b{i}" for i in range(m))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for a, b in slices(offsets):
                base = offsets[a]
                grams, counts = sets(data[base : offsets[b]], offsets[a : b + 1] - base, size)
                out = signature(grams, counts, m).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(counts, pa.int64()), *(pa.array(np.ascontiguousarray(out[:, k])) for k in range(out.shape[1]))], names=["doc_id", "digest", "n", *names])
        release()

    return df.mapInArrow(run, ", ".join(["doc_id long", "digest long", "n long", *(f"{x} long" for x in names)]))


def _full_sets(df: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for a, b in slices(offsets):
                base = offsets[a]
                grams, counts = sets(data[base : offsets[b]], offsets[a : b + 1] - base, size)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(grams.view(np.int64)))], names=["node", "grams"])
        release()

    return df.mapInArrow(run, "node long, grams array<long>")


def _similar_sizes(x: str, y: str, percent: int) -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _confirmed(pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """The rows of `pairs` (with nodes u and v) whose full sets are similar."""
    left = grams.select(F.col("node").alias("u"), F.col("grams").alias("x"))
    right = grams.select(F.col("node").alias("v"), F.col("grams").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "u").join(right, "v").where(shared * 100 >= (F.size("x") + F.size("y") - shared) * percent).select(*pairs.columns)


def joined_components(percent: int, own: tuple, other: tuple | None) -> set[tuple[int, int]]:
    """Pairs of components that a link joins, enough of them to connect all that links do.

    own and other: (sizes, components, grams of all rows in a row); without other, own against itself.
    Counts of shared shingles are products of 0/1 matrices over the shingles that both sides have.
    """
    sides = (own, other or own)
    values, columns = [], []
    for sizes, _, grams in sides:
        found, at = np.unique(grams, return_inverse=True)
        values.append(found)
        columns.append((np.repeat(np.arange(len(sizes)), sizes), at))
    both, left_at, right_at = np.intersect1d(values[0], values[1], assume_unique=True, return_indices=True)
    shared = np.zeros((len(own[0]), len(sides[1][0])), np.float32)
    place = []
    for (_, at), known, found in zip(columns, (left_at, right_at), values, strict=True):
        new = np.full(len(found), -1)
        new[known] = np.arange(len(both))
        place.append(new[at])
    if other is None:  # a shingle of one row only is shared with no other row
        frequent = np.bincount(place[0], minlength=len(both)) > 1
        renumber = np.where(frequent, np.cumsum(frequent) - 1, -1)
        place = [renumber[p] for p in place]
        both = both[frequent]
    for first in range(0, len(both), CHUNK):
        parts = []
        for (rows, _), at, (sizes, _, _) in zip(columns, place, sides, strict=True):
            mine = (at >= first) & (at < first + CHUNK)
            part = np.zeros((len(sizes), min(CHUNK, len(both) - first)), np.float32)
            part[rows[mine], at[mine] - first] = 1
            parts.append(part)
        shared += parts[0] @ parts[1].T
    total = sides[0][0][:, None] + sides[1][0][None, :] - shared
    x, y = np.nonzero((100 * shared >= percent * total) & (own[1][:, None] != sides[1][1][None, :]))
    joined = np.unique(np.sort(np.column_stack([own[1][x], sides[1][1][y]]), axis=1), axis=0) if len(x) else np.empty((0, 2), np.int64)
    root: dict[int, int] = {}
    out = set()
    for u, v in joined.tolist():
        tops = []
        for k in (u, v):
            while root.get(k, k) != k:
                k = root[k]
            tops.append(k)
        if tops[0] != tops[1]:
            root[max(tops)] = min(tops)
            out.add((u, v))
    return out


def _across_blocks(large: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """(u, v) of components that links inside large groups join.

    Rows are dealt to blocks by a hash, as many as keep a block at BLOCK_GRAMS shingles and BLOCK_ROWS nodes on
    average; each pair of blocks of a group meets in one task. large: (ka, node, n, component, many, total).
    """
    blocks = F.ceil(F.greatest(F.col("total") / BLOCK_GRAMS, F.col("many") / BLOCK_ROWS)).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(7)), blocks).cast("int")
    rows = large.select("ka", "node", "n", "component", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    rows = rows.select("ka", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "n", "component").join(grams, "node")

    def compare(group: pa.Table) -> pa.Table:
        p, q = group["p"][0].as_py(), group["q"][0].as_py()
        own = group["own"].to_numpy()
        sides = []
        for side in dict.fromkeys((p, q)):
            part = group.filter(pa.array(own == side))
            lists = part["grams"].combine_chunks()
            sides.append((part["n"].to_numpy(), part["component"].to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)))
        if len(sides) == 2 and not len(sides[0][0]) * len(sides[1][0]):
            found = set()
        else:
            found = joined_components(percent, sides[0], sides[1] if len(sides) == 2 else None)
        u, v = zip(*sorted(found), strict=True) if found else ((), ())
        if len(own) > LARGE_PART:
            release()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return rows.select("ka", "p", "q", "own", "n", "component", "grams").groupBy("ka", "p", "q").applyInArrow(compare, "u long, v long")


def components(df: DataFrame, *, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    A text's words are the runs outside [\\x20\\x09-\\x0D] after A-Z are lower-cased; its set has the distinct
    runs of `size` words, or the whole sequence if it has fewer. Documents are linked if 100 * intersection >=
    percent * union; component_id is the smallest doc_id that links reach. Null, empty and blank texts have
    an empty set and are linked with nothing. A row with a null id is linked with nothing, has a null component
    and is kept. Repeated rows keep a row each; rows of one id with different texts are linked by their texts
    only, so they may have different components. Other columns are not looked at; no rows give no rows.
    """
    signed, nodes = _resolved(Scratch(df.sparkSession, "neardup"), df, size, percent, key, text)
    named = nodes.select(F.col("g1").alias("node_g"), "g2", "n", F.col("best.doc_id").alias("component"))
    rows = signed.select("doc_id", *GROUP).withColumn("node_g", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("g1")))
    out = rows.join(named, ["node_g", "g2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _digest(text: str) -> Column:
    return F.xxhash64(F.col(f"`{text}`").cast("string"))


def _resolved(scratch: Scratch, df: DataFrame, size: int, percent: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Every row with the digests of its text and set, and every node (g1, g2, n) with `best`.

    best is the smallest (doc_id, digest) of the node's component. A node is a set, not an id: texts of one
    id are nodes of their own, and ids of equal sets share one. Each node's full set is made from one row.
    """
    m = tables(percent)
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), _digest(text).alias("digest"))
    signed = scratch.table(_signed(docs, size, m), "signed")

    whole = signed.where("n > 0 AND doc_id IS NOT NULL")
    hashes = [c for c in signed.columns if c[0] in "ab" and c[1:].isdigit()]
    nodes = whole.groupBy(*GROUP).agg(F.min(F.struct("doc_id", "digest")).alias("first"), *(F.min(c).alias(c) for c in hashes))
    nodes = scratch.table(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    alive = _alive(scratch, nodes, m)
    wanted = alive.select("node").distinct().join(nodes.select("node", "first.*"), "node")
    once = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "digest"])  # repeated rows go before they are dealt
    texts = once.join(wanted.hint("shuffle_hash"), ["doc_id", "digest"]).select("node", "text")
    grams = scratch.table(_full_sets(texts, size), "sets")
    found = _link(scratch, alive, grams, percent)
    scratch.drop_all_but("signed", "nodes", "linked")

    placed = nodes.select(*GROUP, "node", "first").join(found, "node", "left")
    lowest = placed.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("low"))
    return signed, placed.join(scratch.table(lowest, "lowest"), "component", "left").select(*GROUP, F.coalesce("low", "first").alias("best"))


def _alive(scratch: Scratch, nodes: DataFrame, m: int) -> DataFrame:
    """(ka, i, node, n, b, weight) of every node that shares its a_i with another.

    ka stands for i and a_i, b is the array of all b_j, weight the number of nodes that share the a_i, over all i.
    """
    first = F.posexplode(F.array(*(f"a{i}" for i in range(m)))).alias("i", "a")
    sides = scratch.table(nodes.select("node", first).select("node", "i", F.xxhash64("i", "a").alias("ka")), "sides")
    shared = scratch.table(sides.groupBy("ka").agg(F.count(F.lit(1)).alias("many")).where("many > 1"), "shared")
    rows = scratch.table(sides.join(shared, "ka"), "some")
    weights = scratch.table(rows.groupBy("node").agg(F.sum("many").alias("weight")), "weights")
    known = nodes.select("node", "n", F.array(*(f"b{i}" for i in range(m))).alias("b")).join(weights, "node")
    out = scratch.table(rows.drop("many").join(scratch.table(known, "known"), "node"), "alive")
    for old in ("sides", "shared", "some", "weights"):
        scratch.drop(old)
    return out


def _link(scratch: Scratch, alive: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the nodes that have links."""
    order = F.xxhash64("node").bitwiseAND((1 << 20) - 1) - F.shiftleft("weight", 20)
    centres = alive.withColumn("order", order).groupBy("ka").agg(F.min_by("node", "order").alias("centre"))
    known = alive.select(F.col("node").alias("centre"), F.col("n").alias("c_n"), F.col("b").alias("c_b")).dropDuplicates(["centre"])
    centres = scratch.table(centres.join(known, "centre"), "centres")
    same_b = F.exists(F.zip_with("b", "c_b", lambda x, y: x == y), lambda same: same)
    met = alive.join(centres, "ka").where("node != centre").where(_similar_sizes("n", "c_n", percent)).where(same_b)
    pairs = scratch.table(met.select(F.least("node", "centre").alias("u"), F.greatest("node", "centre").alias("v")).distinct(), "pairs")
    found = scratch.table(connected(scratch, _confirmed(pairs, grams, percent), "first"), "found")

    rows = alive.select("ka", "node", "n", "b").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = scratch.table(rows, "named")
    groups = rows.groupBy("ka").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("total"), F.min("component").alias("low"), F.max("component").alias("high"))
    groups = scratch.table(groups.where("low < high").select("ka", "many", "total"), "groups")
    rows = scratch.table(rows.join(groups, "ka"), "mixed")

    in_blocks = _across_blocks(rows.where(F.col("many") >= LARGE).drop("b"), grams, percent)
    in_pairs = _across_pairs(scratch, rows.where(F.col("many") < LARGE), percent)
    in_pairs = _confirmed(in_pairs.join(pairs, ["u", "v"], "left_anti"), grams, percent).select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    edges = scratch.table(in_blocks.unionByName(in_pairs).distinct(), "edges")
    joined = scratch.table(connected(scratch, edges, "second"), "joined").select(F.col("node").alias("component"), F.col("component").alias("top"))
    moved = found.join(joined, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    alone = joined.join(found.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("top").alias("component"))
    return scratch.table(moved.unionByName(alone), "linked")


def _across_pairs(scratch: Scratch, rows: DataFrame, percent: int) -> DataFrame:
    """(u, v, cu, cv) of nodes that share a table key and lie in different components; a group has few rows."""
    keyed = rows.select("node", "n", "component", "ka", F.posexplode("b").alias("j", "bj")).select(F.xxhash64("ka", "j", "bj").alias("key"), "node", "n", "component")
    keyed = scratch.table(keyed, "keyed")
    h = F.xxhash64("node")
    buckets = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("k"), F.min("node").alias("low"), F.max("node").alias("high"), F.sum(h.bitwiseAND((1 << 31) - 1)).alias("s1"), F.sum(F.shiftrightunsigned(h, 31)).alias("s2"),
        F.min("component").alias("c_low"), F.max("component").alias("c_high"),
    )
    # buckets of equal members are one bucket
    once = scratch.table(buckets.where("c_low < c_high").groupBy("k", "low", "high", "s1", "s2").agg(F.min("key").alias("key")).select("key"), "once")
    live = scratch.table(keyed.join(once, "key", "left_semi"), "live")
    scratch.drop("keyed")
    other = live.select("key", F.col("node").alias("o_node"), F.col("n").alias("o_n"), F.col("component").alias("o_component"))
    met = live.join(other, "key").where("node < o_node AND component != o_component").where(_similar_sizes("n", "o_n", percent))
    return scratch.table(met.select(F.col("node").alias("u"), F.col("o_node").alias("v"), F.col("component").alias("cu"), F.col("o_component").alias("cv")).distinct(), "across")


def deduplicate(df: DataFrame, *, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `df` that stay: of each component the text of the smallest id, once.

    Decided by text, not by id: rows of one id with different texts stay unless their own text is a copy.
    Rows with a null id stay. Of rows that repeat both id and text one stays; blank texts are copies of nothing else.
    """
    scratch = Scratch(df.sparkSession, "deduplicate")
    signed, nodes = _resolved(scratch, df, size, percent, key, text)
    pairs = signed.where("doc_id IS NOT NULL").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("n"))
    best = nodes.select("best.*").withColumn("first", F.lit(True)).distinct()
    kept = (F.col("n") == 0) | F.coalesce("first", F.lit(False))
    found = pairs.join(best, ["doc_id", "digest"], "left").select("doc_id", "digest", "rows", kept.alias("kept"))
    found = scratch.table(found.where("NOT kept OR rows > 1"), "kept")
    scratch.drop_all_but("kept")
    columns = df.columns
    marked = df.withColumn("__key", F.col(f"`{key}`").cast("long")).withColumn("__digest", _digest(text))
    named = found.select(F.col("doc_id").alias("__key"), F.col("digest").alias("__digest"), "kept", "rows")
    out = marked.join(named, ["__key", "__digest"], "left_anti")
    again = named.where("kept AND rows > 1")
    if not again.isEmpty():
        once = marked.where("__key IS NOT NULL").dropDuplicates(["__key", "__digest"])
        out = out.unionByName(once.join(again, ["__key", "__digest"], "left_semi"))
    return out.select(*[F.col(f"`{c}`") for c in columns])


#: What `components` returns for `documents` of distinct ids, in SQL by counting shared shingles of all pairs that have one.
ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {size} THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - {size} + 2), lambda i: array_to_string(ws[i : i + {size} - 1], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM shared JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * k >= {percent} * (nu.n + nv.n - k)),
reached(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.v FROM reached r JOIN links l ON l.u = r.other),
components AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM components LEFT JOIN n USING (doc_id)
"""


def oracle(size: int, percent: int) -> str:
    return ORACLE.format(size=size, percent=percent)
