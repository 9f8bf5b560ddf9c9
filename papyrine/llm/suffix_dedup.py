"""Exact repeated-substring removal with a distributed difference-cover suffix sort.

Every byte that lies in a ``LENGTH``-byte string which also starts anywhere else is removed.

1. Anchors. Each window of LENGTH bytes has an anchor: the leftmost K-gram of least hash in it. Equal
   windows have equal anchors at equal offsets, so windows only meet within an anchor's group, and
   positions at multiples of 8 from the anchor are a difference cover: equal windows reach a sampled
   position after the same l < 8 bytes. An anchor's context spans the windows that it owns.
2. Groups. Anchors are dealt by hash. One that occurs once is dropped. Contexts of equal bytes, told by
   128 bits of their SHA-256, are copies: their windows repeat, and one of them stands for all from here on.
3. Suffix sort of what is left, per group (a group of over ``HOT`` contexts is dealt out further first): sort the sampled triples of 8-byte words and name them,
   recurse on triples of names (24, 72, then 192 bytes), merge the remaining suffixes by the bytes
   before and after the named 192, and compare adjacent prefixes of LENGTH bytes exactly.
4. Spans go back to their documents, and the remaining bytes are concatenated.

Documents never meet in one task as a whole; what moves is anchors, distinct contexts and, twice, the
compressed texts next to their own spans. Anchors of a long text are found piece by piece (``PIECE``).

Defined results: a null text is empty; texts shorter than LENGTH keep everything; repeated rows (equal
id and text) are copies of each other, so each loses all that LENGTH covers; rows that share an id, or
have a null one, stay apart by their texts; an empty table gives none; extra columns pass.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.llm.common import bound_batches, materialise, rebatch, release, split_by_keys, trimmed, whole_text

LENGTH = 200
K = 64
WINDOW = LENGTH - K + 1
#: Windows of a text that are looked at together: bounds a task's memory, not the length of texts.
PIECE = 1 << 20
#: Low bits of an anchor's order that hold its position in a piece.
POSITION_BITS = 21
#: Context bytes suffix-sorted at once in a task (whole groups, so a larger group is taken alone).
SORT_BYTES = 2 << 20
#: Contexts of one anchor that are sorted together. More of them (the border of a passage that very many texts
#: share) are dealt by ranges of RANGE places as well, and by whole windows where a range is as large again.
HOT, RANGE = 500, 17
#: Rows of texts taken out of an Arrow batch at once.
ROWS = 500
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xC2B2AE3D27D4EB4F)]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _grams(text: np.ndarray) -> np.ndarray:
    """Hashes of all strings of K bytes, by doubling."""
    h = (text.astype(np.uint64) + np.uint64(1)) * _C[0]
    h ^= h >> np.uint64(29)
    size = 1
    while size < K:
        h = h[:-size] * _C[1] + h[size:] * _C[2]
        h ^= h >> np.uint64(31)
        size *= 2
    return h * _C[0]


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    rest = width - span
    return np.minimum(a[:-rest], a[rest:]) if rest else a


def anchors(raw: bytes) -> tuple[np.ndarray, ...]:
    """(gram hash, two halves of the context's digest, first owned window, last owned window, anchor) of every anchor.

    A piece takes the windows that start in it, so an anchor beside a border has a context on either side.
    """
    low, found = np.uint64((1 << POSITION_BITS) - 1), []
    windows, view, sha = len(raw) - LENGTH + 1, memoryview(raw), hashlib.sha256
    for start in range(0, windows, PIECE):
        text = np.frombuffer(raw, np.uint8, min(PIECE, windows - start) + LENGTH - 1, start)
        gram = _grams(text)
        order = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
        owner = (_sliding_min(order, WINDOW) & low).astype(np.int64)  # of the window that starts at each position
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        last = np.concatenate((first[1:] - 1, [len(owner) - 1]))
        digest = b"".join([sha(view[f:e]).digest()[:16] for f, e in zip((first + start).tolist(), (last + start + LENGTH).tolist(), strict=True)])
        halves = np.frombuffer(digest, np.int64).reshape(-1, 2)
        found.append((gram[owner[first]], halves[:, 0], halves[:, 1], first + start, last + start, owner[first] + start))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


@trimmed
def _all_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _pieces(batches):
        rows, parts = [], []
        for i, raw in enumerate(batch.column(2).to_pylist()):
            if len(raw) >= LENGTH:
                parts.append(anchors(raw))
                rows.append(np.full(len(parts[-1][0]), i))
        if not parts:
            continue
        row = np.concatenate(rows)
        gram, da, db, first, last, at = (np.concatenate(c) for c in zip(*parts, strict=True))
        # Copies that meet here already are settled: one stands for them, the rest only carry their
        # spans on, dealt by place instead of by gram, so that a common line does not fill one task.
        order = np.lexsort((db, da, gram))
        new = np.concatenate(([True], np.any([c[order][1:] != c[order][:-1] for c in (gram, da, db)], axis=0)))
        run = np.cumsum(new) - 1
        copied, settled = np.zeros(len(gram), bool), np.zeros(len(gram), bool)
        copied[order] = np.bincount(run)[run] > 1
        settled[order] = ~new
        spread = (first.astype(np.uint64) + row.astype(np.uint64) * _C[1]) * _C[0]
        gram = np.where(settled, spread ^ (spread >> np.uint64(29)) ^ gram, gram)
        keys = [batch.column(i).take(pa.array(row)) for i in (0, 1)]
        columns = [gram.view(np.int64), da, db, *keys, first.astype(np.int32), (last - first).astype(np.int16), (at - first).astype(np.int16), copied]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["gram", "da", "db", "row_a", "row_b", "first", "span", "off", "copied"])


ANCHOR = "gram long, da long, db long, row_a long, row_b long, first int, span short, off short, copied boolean"
VERDICT = ANCHOR + ", known boolean, open boolean"


@trimmed
def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (gram, digest). ``known``: the context has copies; ``open``: it goes to the suffix sort."""
    held: pa.Table | None = None
    held_copies = np.zeros(0, bool)

    def judge(rows: pa.Table, copies: np.ndarray, more: bool):
        """(finished rows, rows of the last group if it goes on, whether those have copies)."""
        gram, da, db = (rows[c].to_numpy() for c in ("gram", "da", "db"))
        n = len(gram)
        new_gram = np.concatenate(([True], gram[1:] != gram[:-1]))
        new_mix = new_gram | np.concatenate(([True], (da[1:] != da[:-1]) | (db[1:] != db[:-1])))
        run = np.cumsum(new_mix) - 1
        size = np.bincount(run)
        has_copies = (size > 1) | (np.bincount(run, copies, len(size)) > 0)
        known, group = has_copies[run], np.cumsum(new_gram) - 1
        distinct = np.bincount(group, new_mix)[group]
        lone = np.bincount(group, new_mix & ~known)[group]
        opened = new_mix & (distinct > 1) & (lone > 0)
        keep = np.arange(n) if not more else np.flatnonzero(group < group[-1])
        done = pa.table({**{c: rows[c].take(pa.array(keep)) for c in rows.column_names}, "known": pa.array(known[keep]), "open": pa.array(opened[keep])})
        done = done.filter(pa.array(known[keep] | opened[keep]))
        if not more:
            return done, None, np.zeros(0, bool)
        # A group that goes on keeps one row per context; its other copies are known already.
        tail = np.flatnonzero((group == group[-1]) & new_mix)
        spare = np.flatnonzero((group == group[-1]) & ~new_mix)
        extra = pa.table({**{c: rows[c].take(pa.array(spare)) for c in rows.column_names}, "known": pa.array(np.ones(len(spare), bool)), "open": pa.array(np.zeros(len(spare), bool))})
        return pa.concat_tables([done, extra]), rows.take(pa.array(tail)), known[tail]

    for batch in rebatch(batches):
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        copies = rows["copied"].to_numpy()
        if held is not None:
            rows, copies = pa.concat_tables([held, rows]), np.concatenate((held_copies, copies))
        done, held, held_copies = judge(rows, copies, True)
        yield from done.combine_chunks().to_batches()
    if held is not None:
        yield from judge(held, held_copies, False)[0].combine_chunks().to_batches()


def _name(keys: list[np.ndarray], alive: np.ndarray) -> np.ndarray:
    """Ranks of the key tuples of the alive entries, in sorted order; -1 for dead ones and for tuples that occur once."""
    names = np.full(len(alive), -1, np.int64)
    at = np.flatnonzero(alive)
    if not len(at):
        return names
    keys = [k[at] for k in keys]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(at), bool)
    new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.cumsum(new) - 1
    names[at[order]] = np.where(np.bincount(rank)[rank] > 1, rank, -1)
    return names


def repeated_windows(groups: np.ndarray, off: np.ndarray, sizes: np.ndarray, buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(context, start) of every window of LENGTH bytes that some other context of its group has at the same place.

    ``groups`` numbers the group of each context, ``off`` is where its anchor lies in it, ``sizes``
    its length; contexts are concatenated in ``buffer``.
    """
    buffer += bytes(8)
    words = np.ndarray((len(buffer) - 7,), dtype=">u8", buffer=buffer, strides=(1,))
    base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    lead = off % 8
    count = np.maximum((sizes - 8 - lead) // 8 + 1, 0)
    ctx = np.repeat(np.arange(len(sizes)), count)
    index = np.concatenate(([0], np.cumsum(count)[:-1]))  # of each context's first sample
    x = (np.arange(len(ctx)) - index[ctx]) * 8 + lead[ctx]
    word = words[base[ctx] + x].astype(np.uint64)
    left = sizes[ctx] - x
    place = groups[ctx] * 128 + (x - off[ctx]) // 8 + 64  # equal windows lie at equal distance from their anchors

    def ahead(a: np.ndarray, steps: int) -> np.ndarray:
        return np.concatenate((a[steps:], np.full(min(steps, len(a)), -1, a.dtype) if a.dtype != np.uint64 else np.zeros(min(steps, len(a)), a.dtype)))

    # Sort sampled triples of words, then recurse on triples of names; a name that occurs once ends there.
    n24 = _name([place, word, ahead(word, 1), ahead(word, 2)], left >= 24)
    a, b = ahead(n24, 3), ahead(n24, 6)
    n72 = _name([n24, a, b], (left >= 72) & (n24 >= 0) & (a >= 0) & (b >= 0))
    a, b = ahead(n72, 9), ahead(n72, 15)
    n192 = _name([n72, a, b], (left >= 192) & (n72 >= 0) & (a >= 0) & (b >= 0))
    # Merge the remaining suffixes: every window is `lead` bytes, a named 192 and what is missing to LENGTH.
    live = np.flatnonzero(n192 >= 0)
    owner = np.repeat(live, 8)
    skip = np.tile(np.arange(8), len(live))
    start = x[owner] - skip
    fine = (start >= 0) & (start + LENGTH <= sizes[ctx[owner]])
    owner, skip, start = owner[fine], skip[fine], start[fine]
    if not len(owner):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    here = base[ctx[owner]] + start
    shift = (8 * (8 - skip)).astype(np.uint64)
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    tail_mask = np.where(skip == 0, ones, (np.uint64(1) << (shift % np.uint64(64))) - np.uint64(1))
    edge = (words[here].astype(np.uint64) & ~tail_mask) | (words[here + LENGTH - 8].astype(np.uint64) & tail_mask)
    # Compare adjacent prefixes in sorted order.
    same = _name([n192[owner] * 8 + skip, edge], np.ones(len(owner), bool)) >= 0
    return ctx[owner[same]], start[same]


@trimmed
def _suffix_sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, off, row_a, row_b, first, context) come sorted by gram; yields spans (row_a, row_b, begin, end)."""

    def solve(rows: pa.Table):
        gram = rows["gram"].to_numpy()
        groups = np.cumsum(np.concatenate(([True], gram[1:] != gram[:-1]))) - 1
        contexts = rows["context"].to_pylist()
        ctx, start = repeated_windows(groups, rows["off"].to_numpy().astype(np.int64), np.array([len(c) for c in contexts]), b"".join(contexts))
        if not len(ctx):
            return None
        order = np.lexsort((start, ctx))
        ctx, start = ctx[order], start[order]
        begin = np.concatenate(([True], (ctx[1:] != ctx[:-1]) | (start[1:] != start[:-1] + 1)))
        head = np.flatnonzero(begin)
        stop = np.concatenate((head[1:] - 1, [len(ctx) - 1]))
        of = pa.array(ctx[head])
        first = rows["first"].to_numpy()[ctx[head]]
        return pa.table({"row_a": rows["row_a"].take(of), "row_b": rows["row_b"].take(of), "begin": pa.array((first + start[head]).astype(np.int32)), "end": pa.array((first + start[stop] + LENGTH).astype(np.int32))})

    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        size += batch.nbytes
        if size < SORT_BYTES:
            continue
        rows = pa.concat_tables(held).combine_chunks()
        gram = rows["gram"].to_numpy()
        cut = int(np.flatnonzero(gram != gram[-1])[-1]) + 1 if gram[0] != gram[-1] else 0
        if cut:
            found = solve(rows.slice(0, cut))
            if found is not None:
                yield from found.combine_chunks().to_batches()
        held, size = [rows.slice(cut)], rows.slice(cut).nbytes
    if held:
        found = solve(pa.concat_tables(held).combine_chunks())
        if found is not None:
            yield from found.combine_chunks().to_batches()


@trimmed
def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compress the last column; the others pass."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
    for batch in _pieces(batches):
        columns = [*batch.columns[:-1], pa.array([pack(raw) for raw in batch.column(batch.num_columns - 1).to_pylist()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def core_keys(gram: int, off: int, span: int, context: bytes) -> Iterator[tuple[int, int]]:
    """(first place, key) for each range of anchor places that the context's windows have: equal windows share the key of their place.

    A window of place l holds l bytes before its anchor's gram and LENGTH - K - l behind it, so all windows
    of a range hold the bytes that the key is a hash of.
    """
    from xxhash import xxh64_intdigest

    for place in range(max(0, (off - span) // RANGE * RANGE), off + 1, RANGE):
        core = context[max(0, off - place) : off - place + LENGTH - RANGE + 1]
        yield place, xxh64_intdigest(core, gram + place & (1 << 64) - 1)


def _contexts(spread: bool):
    """Rows (row_a, row_b, packed, found) to one row per anchor, or, ``spread``, to one per anchor and range of places."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        names, types = ("gram", "off", "place", "row_a", "row_b", "first", "context"), (pa.int64(), pa.int16(), pa.int16(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        for batch in _pieces(batches):
            out: list[tuple] = []
            for row in batch.to_pylist():
                raw = unpack(row["packed"])
                for a in row["found"]:
                    context = raw[a["first"] : a["first"] + a["span"] + LENGTH]
                    keys = core_keys(a["gram"], a["off"], a["span"], context) if spread else [(0, a["gram"])]
                    out += [(k - (1 << 64) if k >> 63 > 0 else k, a["off"], place, row["row_a"], row["row_b"], a["first"], context) for place, k in keys]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=list(names))

    return run


@trimmed
def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each context whose anchor lies in its range: their digests and where they begin."""
    for batch in _pieces(batches):
        keys, begins, of = [], [], []
        for i, (off, place, first, context) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("off", "place", "first", "context")), strict=True)):
            some = range(max(0, off - place - RANGE + 1), min(off - place, len(context) - LENGTH) + 1)
            keys += [hashlib.sha256(context[j : j + LENGTH]).digest()[:16] for j in some]
            begins += [first + j for j in some]
            of += [i] * len(some)
        at = pa.array(of, pa.int32())
        halves = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column("row_a").take(at), batch.column("row_b").take(at), pa.array(begins, pa.int32())], names=["da", "db", "row_a", "row_b", "begin"])


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def _row_keys(id_col: str, text: Column) -> dict[str, Column]:
    """128 bits that name a row by its id and text; rows that are equal in both share them."""
    key = F.col(id_col)
    return {name: F.xxhash64(F.lit(i), key.isNull(), key, text) for i, name in enumerate(("row_a", "row_b"))}


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole_text(text_col)
    return docs.select(*[c.alias(n) for n, c in _row_keys(id_col, text).items()], text.cast("binary").alias("raw")).filter(F.length("raw") >= LENGTH)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_a, row_b, begin, end) of repeated byte ranges; they may overlap. The row's key is that of ``_row_keys``."""
    bound_batches(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    rows = keyed.mapInArrow(_all_anchors, ANCHOR)
    judged = rows.repartition("gram").sortWithinPartitions("gram", "da", "db").mapInArrow(_groups, VERDICT)
    judged = materialise(judged.drop("da", "db", "copied"), "anchors")
    known = judged.filter("known").select("row_a", "row_b", F.col("first").alias("begin"), F.expr(f"cast(first + span + {LENGTH} as int)").alias("end"))
    opened = judged.filter("open").select("row_a", "row_b", "gram", "first", "span", "off")
    hot = materialise(opened.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > HOT).select("gram"), "hot")
    contexts = _contexts_of(keyed, opened.join(hot, "gram", "left_anti"), False)
    found = _sorted_spans(contexts)
    parts, written = [known, found], [judged, hot]
    if hot.head(1):
        ranged = materialise(_contexts_of(keyed, opened.join(hot, "gram", "left_semi"), True), "ranged")
        large = materialise(ranged.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > HOT).select("gram"), "large")
        parts.append(_sorted_spans(ranged.join(large, "gram", "left_anti")))
        # What is left agrees on nearly a whole window: its windows are counted, combined before the shuffle.
        windows = materialise(ranged.join(large, "gram", "left_semi").mapInArrow(_windows, "da long, db long, row_a long, row_b long, begin int"), "windows")
        twice = windows.groupBy("da", "db").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("da", "db")
        parts.append(windows.join(twice, ["da", "db"]).select("row_a", "row_b", "begin", (F.col("begin") + LENGTH).alias("end")))
        written += [ranged, large, windows]
    spans = materialise(reduce(DataFrame.unionByName, parts), "spans")
    release(*written)
    return spans


def _contexts_of(keyed: DataFrame, anchors_: DataFrame, spread: bool) -> DataFrame:
    """Contexts of anchors, cut out of their texts; ``gram`` is the group they are sorted in."""
    opened = materialise(anchors_.groupBy("row_a", "row_b").agg(F.collect_list(F.struct("gram", "first", "span", "off")).alias("found")), "open")
    _, maybe = split_by_keys(keyed, F.xxhash64("row_a", "row_b"), opened.select(F.xxhash64("row_a", "row_b").alias("key")))
    packed = maybe.mapInArrow(_packed, "row_a long, row_b long, packed binary").dropDuplicates(["row_a", "row_b"])
    return packed.join(opened, ["row_a", "row_b"]).mapInArrow(_contexts(spread), "gram long, off short, place short, row_a long, row_b long, first int, context binary")


def _sorted_spans(contexts: DataFrame) -> DataFrame:
    return contexts.repartition("gram").sortWithinPartitions("gram").mapInArrow(_suffix_sort, "row_a long, row_b long, begin int, end int")


def _kept(raw: bytes, found: list | None) -> tuple[bytes, int, int]:
    """(bytes that remain, bytes removed, runs removed)."""
    spans = merge_spans([(s["begin"], s["end"]) for s in found or []])
    parts, at = [], 0
    for begin, end in spans:
        parts.append(raw[at:begin])
        at = end
    return b"".join([*parts, raw[at:]]), sum(e - b for b, e in spans), len(spans)


def strip_repeats(docs: DataFrame, id_col: str, text_col: str, finish, fields: list[T.StructField], untouched: list[Column]) -> DataFrame:
    """``docs`` with the text column replaced by ``fields``: what ``finish`` makes of (kept bytes, removed, runs).

    Only documents that have a span are shuffled, next to their spans, and go through Python; the rest pass
    with ``untouched`` in the JVM.
    """
    spans = repeated_spans(docs, id_col, text_col)
    per = materialise(spans.distinct().groupBy("row_a", "row_b").agg(F.collect_list(F.struct("begin", "end")).alias("__spans__")).withColumnsRenamed({"row_a": "__a__", "row_b": "__b__"}), "spans")
    release(spans)
    text = whole_text(text_col)
    keys = list(_row_keys(id_col, text).values())
    clear, maybe = split_by_keys(docs, F.xxhash64(*keys), per.select(F.xxhash64("__a__", "__b__").alias("key")))
    others = [c for c in docs.columns if c != text_col]
    joined = maybe.join(per, (keys[0] == per["__a__"]) & (keys[1] == per["__b__"]), "left").select(*others, text.cast("binary").alias("__raw__"), "__spans__")
    n = len(others)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in _pieces(batches):
            made = [finish(*_kept(raw, found)) for raw, found in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)]
            new = [pa.array([m[i] for m in made], to_arrow_type(f.dataType)) for i, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *new], names=[*batch.schema.names[:n], *(f.name for f in fields)])

    out = T.StructType([*(docs.schema[c] for c in others), *fields])
    return joined.mapInArrow(run, out).unionByName(clear.select(*others, *[c.alias(f.name) for c, f in zip(untouched, fields, strict=True)]))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) per row."""
    text, zero = whole_text(text_col).cast("binary"), F.lit(0).cast("long")
    fields = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]
    finish = lambda kept, removed, runs: (len(kept) + removed, removed, runs, hashlib.sha256(kept).hexdigest())
    return strip_repeats(docs.select(id_col, text_col), id_col, text_col, finish, fields, [F.octet_length(text).cast("long"), zero, zero, F.sha2(text, 256)])


def rewrite(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated bytes removed from the text (null: empty); a character that loses some of its bytes goes whole."""
    finish = lambda kept, removed, runs: (kept.decode(errors="ignore"),)
    return strip_repeats(docs, id_col, text_col, finish, [T.StructField(text_col, T.StringType())], [whole_text(text_col)]).select(*docs.columns)
