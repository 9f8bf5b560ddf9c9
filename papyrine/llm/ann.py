"""Approximate nearest neighbours by inner product: NN-descent graph, greedy graph search, rows in lists.

Equal vectors are one node (its smallest ids are kept as members), so a vector that a third of the
rows share costs one node. The graph is fitted on a bounded sample of the nodes, the pivots: one in
``LIST``, ``PIVOTS`` at most. It starts from neighbours within blocks of random projections and is improved by rounds
of NN-descent: every pivot brings its neighbours, and those it is a neighbour of, together (neighbours of
neighbours), they are scored against each other, and each keeps its best. All nodes are indexed: each is in
the list of the pivot of nearest direction. Queries start at their own pivot and a few fixed ones and walk the
graph until the best ``beam`` pivots known are all visited, however many steps that takes; every row in
the lists of those pivots is scored.

``beam`` is no constant: ``ASKED`` of the queries are compared with all nodes, and the beam is made as wide
as it takes for their walk to hold ``RECALL`` of their true neighbours (all lists, if it must be).

What is dealt out is parts of about ``PART`` nodes (a long list goes to several) and all queries to each part,
packed, with a bit for every list of the part: no vector travels for a pair, and queries meet a list in one
product. Products in single precision only sort out what cannot be among the best, by a bound on
their error; where that tells too little apart they are repeated in double. What is left is scored in double
precision from the original vectors.

Defined results: vectors that are null, empty, zero, hold null or non-finite components, or are not as
long as most are take no part; fewer candidates than asked for give all of them; ties go to smaller
ids; rows that repeat an id and vector are one candidate; rows that share an id but not a vector are
candidates each, of which a result names an id once, by its best score.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.llm.common import bound_batches, materialise, release, trimmed

PIVOTS = 4096
LIST = 32
DEGREE = 28
SAMPLE = 16
PASS_ON = 8
ROUNDS = 6
TREES = 4
BLOCK = 256
ENTRIES = 8
ASKED = 256
RECALL = 0.93
PART = 800_000
CHUNK = 2048
PACK = 64_000
PACKED = "part int, kind int, chunk long, a binary, b binary, c binary, raw binary, bits binary"
FOUND = "chunk long, k1 binary, k2 binary, q binary, head binary, tag binary, score binary"


def _bounds(key: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))


def _runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Tables of about ``least`` rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= least:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def _matrix(column: pa.ChunkedArray, width: type) -> np.ndarray:
    """Rows of a binary column as a matrix in their own precision."""
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), width).reshape(len(cells), -1)


def _directions(x: np.ndarray) -> np.ndarray:
    """Rows at length one, in single precision."""
    y = x.astype(np.float64)
    y /= np.abs(y).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return (y / np.sqrt((y * y).sum(axis=1, keepdims=True))).astype(np.float32)


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part; floats stay floats, all else is double."""
    kind = "array<float>" if vectors.select(vec_col).dtypes[0][1] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("vec")).filter("id is not null and vec is not null and size(vec) > 0")
    rows = rows.filter("forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))").filter("exists(vec, x -> x <> 0)")
    common = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.filter(F.size("vec") == (common[0]["d"] if common else 0))


def _packed(rows: DataFrame) -> DataFrame:
    """(id, k1, k2, raw): the vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in raw], pa.binary())], names=["id", "k1", "k2", "raw"])

    return rows.mapInArrow(run, "id long, k1 long, k2 long, raw binary")


# Graph over the pivots ----------------------------------------------------------------------------


def _best_edges(node: np.ndarray, nbr: np.ndarray, score: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``degree`` best distinct neighbours of every node among these edges."""
    order = np.lexsort((-score, nbr, node))
    node, nbr, score = node[order], nbr[order], score[order]
    first = np.concatenate(([True], (node[1:] != node[:-1]) | (nbr[1:] != nbr[:-1])))[: len(node)]
    node, nbr, score = node[first], nbr[first], score[first]
    order = np.lexsort((nbr, -score, node))
    node, nbr, score = node[order], nbr[order], score[order]
    cuts = _bounds(node) if len(node) else np.zeros(1, int)
    keep = np.arange(len(node)) - np.repeat(cuts[:-1], np.diff(cuts)) < degree
    return node[keep], nbr[keep], score[keep]


def _best(scores: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``count`` largest of each row."""
    count = min(count, scores.shape[1])
    top = np.argpartition(-scores, count - 1, axis=1)[:, :count]
    return np.repeat(np.arange(len(scores)), count), top.ravel()


def _places(true: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of what is true, eight cells at a time, as little of it is."""
    flat = true.ravel()
    whole = flat.size // 8 * 8
    at = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.divmod(np.concatenate((at[flat[at]], whole + np.flatnonzero(flat[whole:]))), true.shape[1])


def _start(x: np.ndarray) -> list[tuple]:
    """First edges: the best of each block of BLOCK pivots that are neighbours in a random projection."""
    out = []
    bits = max(0, int(np.ceil(np.log2(len(x) / BLOCK))))
    for planes in np.random.default_rng(11).normal(size=(TREES, bits + 1, x.shape[1])):
        y = x @ planes.T
        order = np.lexsort((y[:, bits], (y[:, :bits] > 0) @ (1 << np.arange(bits))))
        for a in range(0, len(x), BLOCK):
            part = order[max(0, min(a, len(x) - BLOCK)) : a + BLOCK]
            s = x[part] @ x[part].T
            np.fill_diagonal(s, -np.inf)
            i, j = _best(s, min(DEGREE // 2, len(s) - 1))
            out.append((part[i], part[j], s[i, j]))
    return out


def _some(key: np.ndarray, other: np.ndarray, count: int, rng: np.random.Generator) -> np.ndarray:
    """(count, SAMPLE): up to SAMPLE of the others of every key, -1 where there are no more."""
    order = np.lexsort((rng.random(len(key)), key))
    key, other = key[order], other[order]
    cuts = _bounds(key)
    at = np.arange(len(key)) - np.repeat(cuts[:-1], np.diff(cuts))
    out = np.full((count, SAMPLE), -1)
    out[key[at < SAMPLE], at[at < SAMPLE]] = other[at < SAMPLE]
    return out


def build_graph(x: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """(pivots, 2 * DEGREE): the neighbours of every pivot and those it is a neighbour of; itself where there are fewer."""
    n, rng = len(x), np.random.default_rng(12)
    near = np.repeat(np.arange(n)[:, None], 2 * DEGREE, axis=1)
    if n < 2:
        return near
    node, nbr, score = _best_edges(*(np.concatenate(c) for c in zip(*_start(x), strict=True)), DEGREE)
    for _ in range(rounds):
        worst = np.full(n, np.inf)
        np.minimum.at(worst, node, score)
        worst[np.bincount(node, minlength=n) < DEGREE] = -np.inf
        members = np.hstack((np.arange(n)[:, None], _some(node, nbr, n, rng), _some(nbr, node, n, rng)))
        out = [(node, nbr, score)]
        for a in range(0, n, 1024):
            own = members[a : a + 1024]
            own = np.sort(own, axis=1)
            own[:, 1:][own[:, 1:] == own[:, :-1]] = -1
            v = x[own]
            s = v @ v.transpose(0, 2, 1)
            s[np.broadcast_to((own < 0)[:, None, :], s.shape)] = -np.inf
            s[:, np.arange(s.shape[1]), np.arange(s.shape[1])] = -np.inf
            flat = own.ravel()
            i, j = _best(s.reshape(len(flat), -1), PASS_ON)
            v = s.reshape(len(flat), -1)[i, j]
            good = (flat[i] >= 0) & (v > -np.inf)
            i, j, v = i[good], j[good], v[good]
            good = v > worst[flat[i]]
            i, j, v = i[good], j[good], v[good]
            out.append((flat[i], own[i // own.shape[1], j], v))
        node, nbr, score = _best_edges(*(np.concatenate(c) for c in zip(*out, strict=True)), DEGREE)
    node, nbr, score = _best_edges(np.concatenate((node, nbr)), np.concatenate((nbr, node)), np.concatenate((score, score)), 2 * DEGREE)
    cuts = _bounds(node)
    near[node, np.arange(len(node)) - np.repeat(cuts[:-1], np.diff(cuts))] = nbr
    return near


def walk(s: np.ndarray, near: np.ndarray, beam: int) -> np.ndarray:
    """Which pivots the walk of each row of ``s`` (its scores with all pivots) ends with: its best ``beam``, all visited."""
    known, seen = np.zeros(s.shape, bool), np.zeros(s.shape, bool)
    known[:, :ENTRIES] = True
    known[np.arange(len(s)), s.argmax(axis=1)] = True
    while True:
        cut = np.full(len(s), -np.inf, s.dtype)
        if beam < s.shape[1]:
            cut = np.partition(np.where(known, s, -np.inf), s.shape[1] - beam, axis=1)[:, s.shape[1] - beam]
        held = known & (s >= cut[:, None])
        q, p = _places(held & ~seen)
        if not len(q):
            # A beam that holds every pivot needs no way to reach them.
            return held if beam < s.shape[1] else np.ones_like(held)
        seen |= held
        known[q[:, None], near[p]] = True


# Scoring ------------------------------------------------------------------------------------------


def _distinct_rank(q: np.ndarray, head: np.ndarray) -> np.ndarray:
    """For rows sorted by query and then by score: how many distinct heads of the query come up to each row."""
    order = np.lexsort((np.arange(len(q)), head, q))
    first = np.ones(len(q), bool)
    first[order[1:]] = (q[order][1:] != q[order][:-1]) | (head[order][1:] != head[order][:-1])
    total = np.cumsum(first)
    cuts = _bounds(q) if len(q) else np.zeros(1, int)
    return total - np.repeat(total[cuts[:-1]] - 1, np.diff(cuts))


def _cut(q: np.ndarray, head: np.ndarray, score: np.ndarray, keep: int) -> np.ndarray:
    """Places of the best rows of every query, until ``keep`` distinct heads are named; ties to smaller heads."""
    order = np.lexsort((head, -score, q))
    return order[_distinct_rank(q[order], head[order]) <= keep]


def _pair_scores(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in one fixed order per row."""
    out = np.empty(len(i))
    for at in range(0, len(i), 20_000):
        p = slice(at, at + 20_000)
        out[p] = (a[i[p]].astype(np.float64) * b[j[p]].astype(np.float64)).sum(1)
    return out


def _norms(x: np.ndarray) -> np.ndarray:
    out = np.empty(len(x))
    for at in range(0, len(x), 10_000):
        y = x[at : at + 10_000].astype(np.float64)
        most = np.abs(y).max(axis=1, initial=0)
        out[at : at + 10_000] = most * np.sqrt(((y / np.where(most == 0, 1, most)[:, None]) ** 2).sum(axis=1))
    return out


class Part:
    """The rows of one part, by list."""

    def __init__(self, low: int, lists: int, width: type, dim: int, rows: int) -> None:
        self.low, self.lists, self.n = low, lists, 0
        self.x, self.at, self.head, self.tag = np.empty((rows, dim), width), [], [], []

    def add(self, at: np.ndarray, head: np.ndarray, tag: np.ndarray, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.x):
            self.x = np.concatenate((self.x[: self.n], np.empty((len(x) + len(self.x) // 8, self.x.shape[1]), self.x.dtype)))
        self.x[self.n : self.n + len(x)] = x
        self.n += len(x)
        self.at.append(at)
        self.head.append(head)
        self.tag.append(tag)

    def close(self) -> None:
        none = [np.zeros(0, np.int64)]
        at, self.head, self.tag = (np.concatenate(c or none) for c in (self.at, self.head, self.tag))
        self.x = self.x[: self.n]
        self.order = np.argsort(at, kind="stable").astype(np.int32)
        self.cuts = np.searchsorted(at[self.order], np.arange(self.low, self.low + self.lists + 1))
        self.norm = _norms(self.x)
        self.single = self.n and self.norm.max() < 1e15 and self.norm.min() > 1e-15

    def find(self, asked: np.ndarray, floor: np.ndarray, bits: np.ndarray, keep: int) -> tuple[np.ndarray, ...]:
        """(query, row, score) of the best of each query in its lists, in double precision."""
        length, error = _norms(asked), (asked.shape[1] + 8) * 2.0**-23
        single = self.single and len(asked) and length.max() < 1e15 and length.min() > 1e-15
        floor = floor.copy()
        small = asked.astype(np.float32) if single else None
        held, size = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0), np.zeros(0))], 0
        for one in np.flatnonzero(bits.any(axis=0)):
            mine = np.flatnonzero(bits[:, one])
            for a in range(self.cuts[one], self.cuts[one + 1], 1024):
                rows = self.order[a : min(a + 1024, self.cuts[one + 1])]
                x, most = self.x[rows], self.norm[rows].max()
                off, dense = length[mine] * most * error, not single
                if single:
                    s = small[mine] @ x.astype(np.float32, copy=False).T
                    i, j = _places(s >= np.nextafter((floor[mine] - off).astype(np.float32), np.float32(-np.inf))[:, None])
                    dense = 16 * len(i) > s.size
                if dense:
                    s = asked[mine].astype(np.float64) @ x.astype(np.float64).T
                    off = off * 2.0**-29
                    i, j = _places(s >= (floor[mine] - off)[:, None])
                held.append((mine[i].astype(np.int32), rows[j], s[i, j].astype(np.float64), off[i]))
                size += len(i)
                if size > 200_000:
                    held, size = [self._best(held, floor, keep)], 0
        q, row, *_ = self._best(held, floor, keep)
        score = _pair_scores(asked, q, self.x, row)
        best = _cut(q, self.head[row], score, keep)
        return q[best], row[best], score[best]

    def _best(self, held: list[tuple], floor: np.ndarray, keep: int) -> tuple[np.ndarray, ...]:
        """What can still be among the best; raises ``floor`` to what ``keep`` distinct heads reach at least."""
        q, row, s, off = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((off - s, q))
        rank = _distinct_rank(q[order], self.head[row[order]])
        last = order[np.flatnonzero((rank == keep) & (np.concatenate(([0], rank[:-1])) == keep - 1))] if keep > 1 else order[rank == 1]
        floor[q[last]] = np.maximum(floor[q[last]], s[last] - off[last])
        good = s + off >= floor[q]
        return q[good], row[good], s[good], off[good]


# Search -------------------------------------------------------------------------------------------


def _sampled(rows: DataFrame, total: int, count: int, seed: int) -> list:
    """``count`` rows (all, if fewer) by the order of a hash of their keys; few more than that reach the driver."""
    mix = F.xxhash64(F.lit(seed), "k1", "k2")
    share = min(1.0, (count + 6 * count**0.5 + 10) / max(1, total))
    got = rows.withColumn("mix", mix).filter(F.col("mix") <= F.lit(int(-(2**63) + share * (2**64 - 1) // 1) if share < 1 else 2**63 - 1)).collect()
    return sorted(got, key=lambda r: (r["mix"], r["k1"], r["k2"]))[:count]


def _assigned(nodes: DataFrame, pivots: np.ndarray, width: type) -> DataFrame:
    """(list, head, k1, k2, raw): every node in the list of the pivot of nearest direction."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, 1000):
            x = _directions(_matrix(rows["raw"], width))
            at = np.concatenate([(x[a : a + 1024] @ pivots.T).argmax(axis=1) for a in range(0, len(x), 1024)])
            yield from rows.select(["head", "k1", "k2", "raw"]).add_column(0, "list", pa.array(at, pa.int32())).combine_chunks().to_batches()

    return nodes.mapInArrow(run, "list int, head long, k1 long, k2 long, raw binary")


def _true(assigned: DataFrame, asked: list, k: int, width: type) -> list:
    """(q, list) of the ``k`` nearest other nodes of each of a few queries, against all nodes."""
    x = np.frombuffer(b"".join(bytes(r["raw"]) for r in asked), width).reshape(len(asked), -1).astype(np.float64)
    k1, k2 = (np.array([r[c] for r in asked]) for c in ("k1", "k2"))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros((len(x), 0)), np.zeros((len(x), 0), np.int32)]
        for rows in _runs(batches, 4000):
            s = x @ _matrix(rows["raw"], width).astype(np.float64).T
            s[(k1[:, None] == rows["k1"].to_numpy()) & (k2[:, None] == rows["k2"].to_numpy())] = -np.inf
            both = np.hstack((best[0], s))
            lists = np.hstack((best[1], np.broadcast_to(rows["list"].to_numpy(), s.shape)))
            top = np.argpartition(-both, min(k, both.shape[1]) - 1, axis=1)[:, :k]
            best = [np.take_along_axis(both, top, 1), np.take_along_axis(lists, top, 1)]
        q = np.repeat(np.arange(len(x)), best[0].shape[1])
        score, at = best[0].ravel(), best[1].ravel()
        there = score > -np.inf
        yield pa.RecordBatch.from_arrays([pa.array(q[there], pa.int32()), pa.array(at[there], pa.int32()), pa.array(score[there])], names=["q", "list", "score"])

    found = assigned.select("list", "k1", "k2", "raw").mapInArrow(run, "q int, list int, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "list")
    return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("q", "list").collect()


def _beam(assigned: DataFrame, asked: list, pivots: np.ndarray, near: np.ndarray, k: int, width: type) -> int:
    """The narrowest beam found that holds RECALL of the true neighbours of these queries."""
    true = np.array([tuple(r) for r in _true(assigned, asked, k, width)], int).reshape(-1, 2)
    if not len(true):
        return len(pivots)
    x = _directions(np.frombuffer(b"".join(bytes(r["raw"]) for r in asked), width).reshape(len(asked), -1))
    s = x @ pivots.T
    ahead = (s[true[:, 0]] > s[true[:, 0], true[:, 1]][:, None]).sum(axis=1) + 1
    beam = int(np.quantile(ahead, RECALL, method="higher"))
    while beam < len(pivots) and walk(s, near, beam)[true[:, 0], true[:, 1]].mean() < RECALL:
        beam = min(len(pivots), beam + beam // 8 + 1)
    return beam


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest other rows found for every row for which ``is_query`` holds."""
    spark, keep = vectors.sparkSession, k + 1
    bound_batches(spark)
    rows = valid(vectors, id_col, vec_col)
    width = np.float32 if isinstance(rows.schema["vec"].dataType.elementType, T.FloatType) else np.float64
    rows = rows.select("id", F.xxhash64(F.lit(1), "vec").alias("k1"), F.xxhash64(F.lit(2), "vec").alias("k2"), "vec")
    # Copies: one node, its head the smallest id; the next smallest ids beside it.
    alike = Window.partitionBy("k1", "k2")
    ranked = rows.select("id", "k1", "k2").distinct().withColumn("r", F.row_number().over(alike.orderBy("id"))).filter(F.col("r") <= keep)
    copies = materialise(ranked.withColumn("head", F.min("id").over(alike)).filter("r > 1").select("head", F.col("k1").bitwiseAND(F.lit(2**31 - 1)).cast("int").alias("tag"), F.col("id").alias("vec_id")), "copies")
    nodes = materialise(_packed(rows).groupBy("k1", "k2").agg(F.min("id").alias("head"), F.first("raw").alias("raw")), "nodes")
    asked = rows.withColumnRenamed("id", id_col).filter(is_query).withColumnRenamed(id_col, "id")
    names = materialise(asked.select("id", "k1", "k2").distinct(), "asked")
    queries = materialise(_packed(asked).groupBy("k1", "k2").agg(F.first("raw").alias("raw")), "queries")
    total, wanted = nodes.count(), queries.count()
    if not wanted:
        return names.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))

    sample = _sampled(nodes, total, max(1, min(PIVOTS, total // LIST)), 3)
    exact = np.frombuffer(b"".join(bytes(r["raw"]) for r in sample), width).reshape(len(sample), -1)
    pivots, heads = _directions(exact), np.array([r["head"] for r in sample])
    near = build_graph(pivots)
    assigned = materialise(_assigned(nodes, pivots, width), "assigned")
    release(nodes)
    beam = _beam(assigned, _sampled(queries, wanted, ASKED, 4), pivots, near, k, width)

    # A node's place: its list's first place and, within the list, its hash; parts are ranges of places.
    count = np.zeros(len(pivots), np.int64)
    for r in assigned.groupBy("list").count().collect():
        count[r["list"]] = r["count"]
    start = np.concatenate(([0], np.cumsum(count)))
    parts = max(-(-total // PART), min(2 * spark.sparkContext.defaultParallelism, -(-total // 1000)))
    size = -(-total // parts)
    lows = np.minimum(np.searchsorted(start, np.arange(parts) * size, side="right") - 1, len(pivots) - 1)
    highs = np.minimum(np.searchsorted(start, np.minimum((np.arange(parts) + 1) * size, total), side="left"), len(pivots))
    highs = np.maximum(highs, lows + 1)
    dim = pivots.shape[1]

    @trimmed
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, PACK):
            at, head, k1 = (rows[c].to_numpy() for c in ("list", "head", "k1"))
            x = _matrix(rows["raw"], width)
            share = (k1.view(np.uint64) >> np.uint64(11)).astype(np.float64) / 2.0**53
            place = start[at] + np.minimum((share * count[at]).astype(np.int64), count[at] - 1)
            part = place // size
            order = np.argsort(part, kind="stable")
            cuts = _bounds(part[order])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = order[a:b]
                cells = [at[own].astype(np.int32), head[own], (k1[own] & (2**31 - 1)).astype(np.int32), x[own]]
                yield _row(part[own[0]], 0, 0, *(c.tobytes() for c in cells), b"")

    @trimmed
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, CHUNK):
            x, k1, k2 = _matrix(rows["raw"], width), rows["k1"].to_numpy(), rows["k2"].to_numpy()
            floor, held = np.full(len(x), -np.inf), np.zeros((len(x), len(pivots)), bool)
            for a in range(0, len(x), 256):
                some = x[a : a + 256]
                held[a : a + 256] = walk(_directions(some) @ pivots.T, near, beam)
                # The nearest pivots are found anyway, and nothing beyond what they reach need be told.
                with np.errstate(over="ignore", invalid="ignore"):
                    q, p = _best(some.astype(np.float32) @ exact.astype(np.float32).T, 2 * keep)
                q, p = q.astype(np.int64), p.astype(np.int64)
                score = _pair_scores(some, q, exact, p)
                top = _cut(q, heads[p], score, keep)
                q, p, score = q[top], p[top], score[top]
                held[a + q, p] = True
                last = _distinct_rank(q, heads[p]) == keep
                floor[a + q[last]] = score[last] - 1e-12 * np.abs(score[last])
            for part, (low, high) in enumerate(zip(lows, highs, strict=True)):
                yield _row(part, 1, int(k1[0]), *(c.tobytes() for c in (k1, k2, floor, x)), np.packbits(held[:, low:high], axis=1).tobytes())

    @trimmed
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part, closed = -1, None, False
        for batch in batches:
            for i in range(batch.num_rows):
                here, kind, chunk = (batch.column(c)[i].as_py() for c in range(3))
                a, b, c, raw, bits = (batch.column(n)[i].as_buffer() for n in range(3, 8))
                low, high = int(lows[here]), int(highs[here])
                if here != number:
                    part, number, closed = None, here, False  # frees the last one first
                    part = Part(low, high - low, width, dim, size + size // 50 + 1000)
                x = np.frombuffer(raw, width).reshape(-1, dim)
                if kind == 0:
                    part.add(np.frombuffer(a, np.int32), np.frombuffer(b, np.int64), np.frombuffer(c, np.int32), x)
                    continue
                if not closed:
                    part.close()
                    closed = True
                held = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(len(x), -1), axis=1, count=high - low).view(bool)
                q, row, score = part.find(x, np.frombuffer(c, np.float64), held, keep)
                cells = [q.astype(np.int32), part.head[row].astype(np.int64), part.tag[row].astype(np.int32), score]
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *(pa.array([v], pa.binary()) for v in (a.to_pybytes(), b.to_pybytes(), *(v.tobytes() for v in cells)))], names=["chunk", "k1", "k2", "q", "head", "tag", "score"])

    @trimmed
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def best(rows: list[tuple]) -> pa.RecordBatch:
            k1, k2 = (np.frombuffer(v, np.int64) for v in rows[0][1:3])
            q, head, tag, score = (np.concatenate([np.frombuffer(r[n], kind) for r in rows]) for n, kind in ((3, np.int32), (4, np.int64), (5, np.int32), (6, np.float64)))
            top = _cut(q, head, score, keep)
            return pa.RecordBatch.from_arrays([pa.array(v) for v in (k1[q[top]], k2[q[top]], head[top], tag[top], score[top])], names=["k1", "k2", "head", "tag", "score"])

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    yield best(held)
                    held = []
                held.append(row)
        if held:
            yield best(held)

    dealt = assigned.mapInArrow(pack, PACKED).unionByName(queries.repartition(max(1, min(-(-wanted // CHUNK), 4 * spark.sparkContext.defaultParallelism)), "k1").mapInArrow(ask, PACKED))
    met = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind").mapInArrow(meet, FOUND)
    lead = materialise(met.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(merge, "k1 long, k2 long, head long, tag int, score double"), "lead")
    release(assigned, queries)
    more = lead.join(copies, ["head", "tag"]).select("k1", "k2", "vec_id", "score")
    lists = lead.select("k1", "k2", F.col("head").alias("vec_id"), "score").unionByName(more).groupBy("k1", "k2", "vec_id").agg(F.max("score").alias("score"))
    lists = lists.withColumn("r", F.row_number().over(alike.orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= keep).drop("r")
    per = names.join(lists, ["k1", "k2"]).filter("vec_id <> id").groupBy("id", "vec_id").agg(F.max("score").alias("score"))
    final = per.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return final.select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _row(part: int, kind: int, chunk: int, *cells: bytes) -> pa.RecordBatch:
    values = [pa.array([int(part)], pa.int32()), pa.array([kind], pa.int32()), pa.array([chunk], pa.int64()), *(pa.array([c], pa.binary()) for c in cells)]
    return pa.RecordBatch.from_arrays(values, names=["part", "kind", "chunk", "a", "b", "c", "raw", "bits"])
