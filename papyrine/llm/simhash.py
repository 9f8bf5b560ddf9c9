"""SimHash near-duplicate detection with BK-trees.

Fingerprints are computed in Python over whole texts; only distinct ones go further. They are dealt
into shards that agree on one of r+1 blocks and one of r+1 sub-blocks of the rest, so that any two
fingerprints at r differing bits or fewer meet in at least one shard (two pigeonholes). Each shard
holds a BK-tree: children are keyed by their integer Hamming distance to the parent, and a search
follows only edges whose key is within the radius of the distance just measured. A shard's tree is
never sent to the driver; it lives in the task that owns the shard, which bounds it by the shard.

Links found inside a shard that join two members already joined there are left out: components are
the same and the number of links stays below the number of rows, whatever a group's size.

Defined results: a null or empty text, or one of white space, has fingerprint zero and is linked like
any other; equal texts share a fingerprint, texts of any length are read whole; repeated rows stay
repeated; a component of null ids alone has a null id, null ids count for nothing in others; an empty table
gives none; extra columns do not matter.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.llm.common import append_columns, materialise, rebatch, release, row_key, split_by_keys, trimmed
from papyrine.llm.components import connected_components

SEED = 42
MASK = (1 << 64) - 1


def shingles(text: str | None, words: int) -> list[bytes]:
    """Word shingles, repeats included, of a text with A-Z lower-cased; fewer words: the whole sequence."""
    found = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [line[s:e] for s, e in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    found = shingles(text, words)
    return np.fromiter((xxh64_intdigest(s, SEED) for s in found), np.uint64, len(found))


def fold_bits(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes: a bit is 1 if set in over half of them."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(df: DataFrame, words: int = 3, text_col: str = "text", out_col: str = "fp") -> DataFrame:
    """Append the fingerprint as a signed 64-bit integer."""

    def make():
        return lambda texts: {out_col: [signed(fold_bits(shingle_hashes(t, words))) for t in texts]}

    return append_columns(df, make, [T.StructField(out_col, T.LongType())], text_col)


class BKTree:
    """Fingerprints under Hamming distance; nodes are numbered in order of insertion."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        me = len(self.values)
        self.values.append(value)
        self.children.append({})
        if me:
            at = 0
            while True:
                d = (self.values[at] ^ value).bit_count()
                nxt = self.children[at].get(d)
                if nxt is None:
                    self.children[at][d] = me
                    break
                at = nxt
        return me

    def within(self, value: int, radius: int) -> Iterator[tuple[int, int]]:
        """(node, distance) of every node within the radius."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield at, d
            todo.extend(child for key, child in self.children[at].items() if d - radius <= key <= d + radius)


def spanning_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links within the radius that make the shard's components, no more than needed."""
    tree, parent, parts, out = BKTree(), [], 0, []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for value in values:
        met: set[int] = set()
        me = len(parent)
        parent.append(me)
        for node, _ in tree.within(value, radius):
            root = find(node)
            if root not in met:
                met.add(root)
                out.append((tree.values[node], value))
                if len(met) == parts:
                    break  # every component of the shard is joined already
        for root in met:
            parent[root] = me
        parts += 1 - len(met)
        tree.add(value)
    return out


def _blocks(bits: int, parts: int) -> list[tuple[int, int]]:
    edges = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def shard_keys(fp: str, radius: int) -> list:
    """One key column per (block, sub-block): a row whose key equals another's agrees on both."""
    keys = []
    outer, width = _blocks(64, radius + 1), 64
    for a, (at, size) in enumerate(outer):
        block = f"(shiftrightunsigned({fp}, {at}) & {(1 << size) - 1}L)"
        low = f"({fp} & {(1 << at) - 1}L)" if at else "0L"
        high = f"shiftleft(shiftrightunsigned({fp}, {at + size}), {at})" if at + size < width else "0L"
        rest = f"({low} | {high})"
        for b, (sub, n) in enumerate(_blocks(width - size, radius + 1)):
            part = f"(shiftrightunsigned({rest}, {sub}) & {(1 << n) - 1}L)"
            table = a * (radius + 1) + b
            keys.append(F.expr(f"{table}L | shiftleft({block}, 8) | shiftleft({part}, {8 + size})"))
    return keys


def _scan_runs(radius: int):
    """Walk rows sorted by key; a run of equal keys is a shard, which may span batches."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(pairs):
            u, v = zip(*pairs, strict=True) if pairs else ((), ())
            arrays = [pa.array([signed(x) for x in c], pa.int64()) for c in (u, v)]
            return pa.RecordBatch.from_arrays(arrays, names=["u", "v"])

        held_key, held = None, []
        for batch in rebatch(batches):
            key = batch.column(0).to_numpy()
            fp = batch.column(1).to_numpy().view(np.uint64)
            if not len(key):
                continue
            cuts = np.flatnonzero(np.diff(key)) + 1
            begins, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
            pairs: list[tuple[int, int]] = []
            if held_key is not None and key[0] == held_key:
                held.extend(fp[: ends[0]].tolist())
                begins, ends = begins[1:], ends[1:]
                if not len(begins):
                    continue
            if len(held) > 1:
                pairs += spanning_links(held, radius)
            held_key, held = key[begins[-1]], fp[begins[-1] : ends[-1]].tolist()
            begins, ends = begins[:-1], ends[:-1]
            size = ends - begins
            two = begins[size == 2]
            near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius
            pairs += zip(fp[two[near]].tolist(), fp[two[near] + 1].tolist(), strict=True)
            for s, e in zip(begins[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
                pairs += spanning_links(fp[s:e].tolist(), radius)
            if pairs:
                yield emit(pairs)
        if len(held) > 1:
            yield emit(spanning_links(held, radius))

    return run


def links(fps: DataFrame, radius: int = 3, fp_col: str = "fp") -> DataFrame:
    """Links (u, v) between distinct fingerprints at ``radius`` differing bits or fewer, enough for every component."""
    keyed = fps.select(F.col(fp_col).alias("fp")).distinct().select(F.explode(F.array(*shard_keys("fp", radius))).alias("key"), "fp")
    shards = keyed.repartition("key").sortWithinPartitions("key")
    return shards.mapInArrow(_scan_runs(radius), "u long, v long").distinct()


def components(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id of the documents reachable over links, itself included."""
    rows = fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), words).select("id", "fp")
    rows = materialise(rows, "fingerprints")
    firsts = materialise(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct_fp")
    roots = connected_components(links(firsts, radius))
    named = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = materialise(named, "roots")
    heads = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = named.join(heads, "root").select("fp", "component_id")
    return rows.join(of_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


# Near duplicates by verified similarity ------------------------------------------------------------

#: Tables that shard the documents and min-hashes in a table's key. Texts of similarity 0.8 agree in a key
#: with probability 0.33 and miss all 40 with 1e-7; texts that share a passage of a third of their length
#: agree with 0.004, so that a passage of very many documents makes no large shard.
TABLES, KEY_HASHES = 40, 5
#: Rows of a shard that one task leads; a larger shard is led block by block.
LEAD_ROWS = 20_000
#: Rows and bytes of shingle sets in a block of a group that is compared member by member: two blocks meet in a task.
BLOCK_ROWS, BLOCK_BYTES = 1_000, 4 << 20
#: Members of a group that comes from several shards; beyond that its shards are compared one by one.
CLUSTER_ROWS = 50_000
_MULTIPLIERS = np.random.default_rng(5).integers(1, 1 << 63, size=TABLES * KEY_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def near_radius(n: int) -> int:
    """Bits searched for sets of at most ``n`` shingles.

    For every pair of sets at similarity 0.8 or more the odds that more bits than that differ are below
    1e-5: a bit differs with probability 0.161 at most, and with 0.188 for four of five shingles.
    """
    return 27 if n <= 5 else 24


def signature(text: str | None, words: int) -> tuple[int, int, int, int, list[int]]:
    """(two digests of the shingle set, its size, fingerprint, shard keys), all of the set: repeats do not count."""
    from xxhash import xxh64_intdigest

    distinct = np.unique(shingle_hashes(text, words))
    raw = distinct.tobytes()
    keys = [0] * TABLES
    if len(distinct):
        least = np.full(len(_MULTIPLIERS), MASK, np.uint64)
        for at in range(0, len(distinct), 1024):
            mixed = distinct[at : at + 1024, None] * _MULTIPLIERS[None, :]
            least = np.minimum(least, (mixed ^ (mixed >> np.uint64(31))).min(0))
        key = np.arange(TABLES, dtype=np.uint64)
        for part in least.reshape(KEY_HASHES, TABLES):
            key = (key ^ part) * _MULTIPLIERS[0]
            key ^= key >> np.uint64(29)
        keys = key.view(np.int64).tolist()
    return signed(xxh64_intdigest(raw, 1)), signed(xxh64_intdigest(raw, 2)), len(distinct), signed(fold_bits(distinct)), keys


Member = tuple[int, int, int, int]  # node, fingerprint, set size, component


def _reach(tree: BKTree, where: list[Member], fp: int, n: int, similarity: float) -> Iterator[tuple[int, Member]]:
    """(distance, member) of the tree's members that a set of ``n`` shingles may be similar to."""
    for i, d in tree.within(fp, near_radius(n) if n <= 5 else near_radius(6)):
        other = where[i]
        if d <= near_radius(max(n, other[2])) and min(n, other[2]) >= similarity * max(n, other[2]):
            yield d, other


def shard_leads(members: list[Member], similarity: float) -> list[int | None]:
    """For each member the least leader within reach, or none: then it is a leader from there on."""
    tree, where, out = BKTree(), [], []
    for member in members:
        node, fp, n, _ = member
        lead = min((o[0] for _, o in _reach(tree, where, fp, n, similarity)), default=None)
        out.append(lead)
        if lead is None:
            tree.add(fp)
            where.append(member)
    return out


def _similar(x: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Whether the exact similarity of a sorted set to each of ``others`` reaches the threshold; no set is empty."""
    sizes = np.array([len(o) for o in others])
    y = np.concatenate(others)
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    shared = np.add.reduceat((x[at] == y).astype(np.int64), np.concatenate(([0], np.cumsum(sizes)[:-1])))
    return shared >= similarity * (len(x) + sizes - shared) - 1e-9


def group_links(members: list[Member], blocks: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Similar members of different components, no more links than join them (and, of two blocks, only across).

    The BK-tree holds all but the largest component, whose members only search; what lies within the radius
    is verified on the sets, unless a link found before has joined the two already.
    """
    parent: dict[int, int] = {m[3]: m[3] for m in members}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    if len(parent) < 2:
        return []
    sizes: dict[int, int] = {}
    for m in members:
        sizes[m[3]] = sizes.get(m[3], 0) + 1
    most = max(sizes, key=lambda r: (sizes[r], r))
    across = min(blocks) != max(blocks)
    tree, where, number, out = BKTree(), [], {}, []
    for i in sorted(range(len(members)), key=lambda i: members[i][3] == most):
        node, fp, n, root = members[i]
        met = [number[o[0]] for _, o in _reach(tree, where, fp, n, similarity)]
        if across:
            met = [j for j in met if blocks[j] != blocks[i]]
        while met:
            own = find(root)
            part, met = [j for j in met[:64] if find(members[j][3]) != own], met[64:]
            if part:
                for j, ok in zip(part, _similar(sets[i], [sets[j] for j in part], similarity).tolist(), strict=True):
                    its = find(members[j][3])
                    if ok and its != find(root):
                        parent[its] = find(root)
                        out.append((node, members[j][0]))
        if root != most:
            tree.add(fp)
            where.append(members[i])
            number[node] = i
    return out


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole runs of the first column (rows come sorted by it)."""
    held: list[pa.Table] = []
    for batch in rebatch(batches):
        if not batch.num_rows:
            continue
        rows = pa.concat_tables([*held, pa.Table.from_batches([batch])]).combine_chunks()
        key = rows.column(0).to_numpy()
        cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        if cut:
            yield rows.slice(0, cut)
        held = [rows.slice(cut)]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _members(rows: pa.Table, begin: int, end: int) -> list[Member]:
    part = rows.slice(begin, end - begin)
    root = part["root"].to_pylist() if "root" in part.column_names else [0] * (end - begin)
    return list(zip(part["node"].to_pylist(), part["fp"].to_numpy().view(np.uint64).tolist(), part["n"].to_pylist(), root, strict=True))


def _cuts(key: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))


SHARD = "shard long, key long, node long, fp long, n long, lead long"


def _lead_runs(similarity: float):
    """Members of shards of two or more, each with its leader; rows come sorted by (shard, node)."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _shards(batches):
            cuts = _cuts(rows["shard"].to_numpy())
            shared = np.repeat(np.diff(cuts) > 1, np.diff(cuts))
            rows = rows.filter(pa.array(shared))
            if not len(rows):
                continue
            cuts, leads = _cuts(rows["shard"].to_numpy()), []
            for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                leads += shard_leads(_members(rows, begin, end), similarity)
            yield from rows.append_column("lead", pa.array(leads, pa.int64())).combine_chunks().to_batches()

    return run


def _link_runs(similarity: float):
    """Links of each group; rows (group, block, node, fp, n, root, shingles) come sorted by group."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _shards(batches):
            cuts, blocks = _cuts(rows["group"].to_numpy()), rows["block"].to_pylist()
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["shingles"].combine_chunks()]
            for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                found = group_links(_members(rows, begin, end), blocks[begin:end], sets[begin:end], similarity)
                if found:
                    u, v = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v, ok): the exact similarity of the two shingle sets reaches the threshold."""
    a = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 100) for b in batches for at in range(0, b.num_rows, 100)):
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["u", "v", "ok"])

    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long, ok boolean")


def _shard_table(heads: DataFrame, similarity: float) -> DataFrame:
    """Members of all shards of two or more with their leaders. A shard of over LEAD_ROWS is led block by block."""
    keyed = heads.filter("n > 0").select(F.explode("keys").alias("key"), "node", "fp", "n")
    large = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > LEAD_ROWS)
    large = large.select("key", F.ceil(F.col("c") / LEAD_ROWS).alias("parts"))
    shard = F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.pmod(F.xxhash64("node"), "parts")))
    keyed = keyed.join(large, "key", "left").select(shard.alias("shard"), "key", "node", "fp", "n")
    led = keyed.repartition("shard").sortWithinPartitions("shard", "node").mapInArrow(_lead_runs(similarity), SHARD)
    return materialise(led, "shards")


def _contested(shards: DataFrame, roots: DataFrame) -> DataFrame:
    """(group, block, node, root) of members that share a shard with one of another component.

    Shards that have members in common are compared as one group, so that a pair meets once and not in
    each of its shards, unless that group would be large: then its shards stay groups of their own. A
    group of more than a block is cut into blocks, of which every two meet in a group of their own.
    """
    rooted = shards.select("key", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("node").alias("first")).filter("low <> high")
    members = materialise(rooted.join(mixed.select("key", "first"), "key"), "contested")
    clusters = connected_components(members.select("first", "node"), "first", "node").withColumnRenamed("root", "cluster")
    small = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") <= CLUSTER_ROWS).select("cluster", F.lit(True).alias("small"))
    named = clusters.join(small, "cluster", "left")
    group = F.when(F.col("small"), F.xxhash64(F.lit("cluster"), "cluster")).otherwise(F.xxhash64(F.lit("shard"), "key"))
    grouped = materialise(members.join(named, "node").select(group.alias("group"), "node", "n", "root").distinct(), "grouped")
    size = F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("n") * 8 / BLOCK_BYTES)
    parts = grouped.groupBy("group").agg(F.ceil(size).cast("int").alias("parts"))
    cut = grouped.join(parts, "group").withColumn("block", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    # A block meets every block: those after it, those before it and itself.
    met = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select(F.xxhash64("group", F.least("block", "with"), F.greatest("block", "with")).alias("group"), "block", "node", "root")
    met = materialise(met, "groups")
    release(members, grouped)
    return met


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row_a, row_b, group_id, root) per row: the class, and the row's key beside its id.

    Classes are joined by pairs of ``similarity`` or more: the exact Jaccard similarity of the sets of word
    shingles. Texts of equal sets are one node. Nodes are dealt into shards by keys of min-hashes; each
    shard holds a BK-tree of SimHash fingerprints, and what it finds within the radius is verified on the
    whole sets, in two rounds: every member with one leader of its shards; then all members of a shard that
    are in different components, verified where they meet, so that what leaves a task is links alone. So a
    large group of near copies costs few pairs a member, and every pair that a shard and the radius propose
    is verified unless its members are joined already.

    Defined results: ``group_id`` is the smallest id of the class (null where all its ids are), ``root``
    names the class where ids are null or repeat; texts without words are one class; rows that share an id
    are nodes by their texts; an empty table gives none.
    """
    def make():
        def run(texts):
            got = [signature(t, words) for t in texts]
            return {name: [g[i] for g in got] for i, name in enumerate(("da", "db", "n", "fp", "keys"))}

        return run

    fields = [T.StructField(c, T.LongType()) for c in ("da", "db", "n", "fp")] + [T.StructField("keys", T.ArrayType(T.LongType()))]
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), *row_key(text_col, "row_a", "row_b"), F.col(text_col).alias("text"))
    rows = materialise(append_columns(keyed, make, fields).drop("text"), "signatures")
    one = F.min(F.struct("id", "row_a", "row_b")).alias("one")  # the row whose text is read again for the node
    heads = rows.groupBy("da", "db").agg(F.min("id").alias("least"), one, F.any_value("n").alias("n"), F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys"))
    heads = materialise(heads.withColumn("node", F.xxhash64("da", "db")), "nodes")

    def shingle_sets(wanted: DataFrame) -> DataFrame:
        owners = materialise(heads.select("node", "one").join(wanted.distinct(), "node").select("node", "one.*"), "owners")
        _, maybe = split_by_keys(keyed, F.xxhash64("id", "row_a", "row_b"), owners.select(F.xxhash64("id", "row_a", "row_b").alias("key")))

        def sets():
            return lambda texts: {"shingles": [np.unique(shingle_hashes(t, words)).tobytes() for t in texts]}

        on = maybe["id"].eqNullSafe(owners["id"]) & (maybe["row_a"] == owners["row_a"]) & (maybe["row_b"] == owners["row_b"])
        mine = maybe.join(owners, on).select("node", "text").dropDuplicates(["node"])
        found = materialise(append_columns(mine, sets, [T.StructField("shingles", T.BinaryType())]).select("node", "shingles"), "sets")
        release(owners)
        return found

    shards = _shard_table(heads, similarity)
    pairs = materialise(shards.filter("lead is not null").groupBy(F.col("node").alias("u")).agg(F.min("lead").alias("v")), "pairs")
    sets = shingle_sets(pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))))
    first = materialise(_verified(pairs, sets, similarity).filter("ok").select("u", "v"), "links")
    roots = materialise(connected_components(first), "roots")
    groups = _contested(shards, roots)
    release(pairs, sets, shards, roots)
    sets = shingle_sets(groups.select("node"))
    compared = groups.join(heads.select("node", "fp", "n"), "node").join(sets, "node").select("group", "block", "node", "fp", "n", "root", "shingles")
    later = compared.repartition("group").sortWithinPartitions("group").mapInArrow(_link_runs(similarity), "u long, v long")
    links = materialise(first.unionByName(later), "links")
    release(first, groups, sets)
    roots = connected_components(links)
    named = materialise(heads.join(roots, "node", "left").select("da", "db", "least", F.coalesce("root", "node").alias("root")), "roots")
    least = named.groupBy("root").agg(F.min("least").alias("group_id"))
    of_set = named.join(least, "root").select("da", "db", "group_id", "root")
    return rows.join(of_set, ["da", "db"]).select(F.col("id").alias(id_col), "row_a", "row_b", "group_id", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row of each near-duplicate class: the smallest id (a null one last), of equal ids the smallest text key.

    Rows of equal id and text that differ in other columns are copies too; one of them stays.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **settings)
    key = ["late", "id", "row_a", "row_b"]  # without nulls; in the order of preference
    found = materialise(found.select("root", F.col(id_col).isNull().alias("late"), F.coalesce(F.col(id_col), F.lit(0)).alias("id"), "row_a", "row_b"), "groups")
    # Rows of one key are alike in id and text, so they are in one class: a key stays or goes as a whole.
    first = found.groupBy("root").agg(F.min(F.struct(*key)).alias("first")).select("first.*", F.lit(True).alias("stays"))
    kept = found.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).join(first, key, "left")
    kept = materialise(kept.filter("stays is null or c > 1").select(*key, F.col("stays").isNotNull().alias("stays")), "gone")
    release(found)
    names = dict(zip(key, ("__late__", "__id__", "__a__", "__b__"), strict=True))
    own = [F.col(id_col).isNull(), F.coalesce(F.col(id_col).cast("long"), F.lit(0)), *row_key(text_col, "a", "b")]
    clear, maybe = split_by_keys(docs, F.xxhash64(*own), kept.select(F.xxhash64(*key).alias("key")))
    gone = kept.filter("not stays").select(*[F.col(k).alias(n) for k, n in names.items()])
    on = reduce(and_, (c == gone[n] for c, n in zip(own, names.values(), strict=True)))
    copies = Window.partitionBy(*own).orderBy(F.xxhash64(F.to_json(F.struct(*docs.columns))))
    left = maybe.join(gone, on, "left_anti").withColumn("__copy__", F.row_number().over(copies)).filter("__copy__ = 1").drop("__copy__")
    return clear.unionByName(left)
