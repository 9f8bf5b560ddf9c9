"""Benchmark decontamination, in DataFrame expressions only.

For a benchmark item of n words every window of n words of a document is a candidate. Windows are
compared by SimHash over their word shingles: a window and an item within ``RADIUS`` differing bits
agree on at least one of ``RADIUS`` + 1 blocks of the fingerprint, so blocks that agree are a test that
none of them fails; candidates are then verified by exact weighted (multiset) shingle similarity.

Fingerprints are computed only for windows that can pass: a window of the same size at similarity s
shares at least ceil(2 m s / (1 + s)) of the item's m shingles, so it holds at least one of any
m - that + 1 of them. Those ``anchors`` (the rarest in the benchmark) are looked up for every shingle
of every document; no window at the threshold or above is lost by that. The look-up is a hash table
held in a scalar value: an array of short arrays, probed within the row (``_tables``).

A document with fewer shingles than the item is one window, the whole document. At similarity s it
shares at least ceil(m s) of the item's shingles, so more anchors are looked up for it, and it is
verified without the index.

Rows are told apart by their id together with two hashes of their text, never by the id alone.

Defined results: null or empty texts and items match nothing; items shorter than a shingle are one
shingle of all their words; several windows of a document that match one item give one row, the most
similar window, then the first; ``n_words`` is the window's length; rows of equal id and text are one
document; rows that share an id, or have a null one, are documents of their own if their texts differ,
and so are items; empty tables give no rows; extra columns do not matter.
"""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.llm.common import materialise, row_key

WORDS = 5
SIMILARITY = 0.8
RADIUS = 24
#: Anchors in one hash table (about 40 bytes each). A larger benchmark takes several, each with a pass over the documents.
TABLE_ROWS = 1 << 20
LANES = 281479271743489  # a one in each of four 16-bit lanes
WIDE_LANES = 4294967297  # a one in each of two 32-bit lanes
ROW = ["doc_id", "row_a", "row_b"]


def word_array(text: Column) -> Column:
    """Words of a whole text with lower-cased letters; no words: an empty array."""
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\r\f\x0b"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \t\n\r\f\x0b]+"))


def shingle_array(words: str, size: int) -> Column:
    """64-bit hashes of all shingles of ``size`` words, in order, repeats included."""
    return F.expr(f"case when size({words}) >= {size} then transform(sequence(0, size({words}) - {size}), i -> xxhash64(slice({words}, i + 1, {size}))) else cast(array() as array<bigint>) end")


def _counted(hashes: str, lanes: int) -> Column:
    """SimHash with bits counted in ``64 / lanes`` longs of that many lanes."""
    width, ones = 64 // lanes, LANES if lanes == 4 else WIDE_LANES
    counts = F.expr(f"aggregate({hashes}, array_repeat(0L, {width}), (acc, h) -> transform(acc, (a, b) -> a + (shiftrightunsigned(h, b) & {ones}L)))")
    size, mask = 64 // lanes, (1 << 64 // lanes) - 1

    def bits(s: Column):
        def of_word(a: Column, b: Column) -> Column:
            out = F.lit(0).cast("long")
            for k in range(lanes):
                more = F.shiftrightunsigned(a, size * k).bitwiseAND(F.lit(mask)) * 2 > s["n"]
                out = out.bitwiseOR(F.when(more, F.call_function("shiftleft", F.lit(1).cast("long"), b + width * k)).otherwise(F.lit(0).cast("long")))
            return out

        return F.aggregate(F.transform(s["c"], of_word), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))

    return F.transform(F.array(F.struct(counts.alias("c"), F.size(hashes).alias("n"))), bits)[0]


def fingerprint(hashes: str) -> Column:
    """SimHash of an array of hashes; arrays that 16-bit lanes cannot count get 32-bit ones, with the same result."""
    return F.when(F.size(hashes) < 1 << 16, _counted(hashes, 4)).otherwise(_counted(hashes, 2))


def _blocks(fp: Column, radius: int) -> Column:
    """Keys of radius + 1 blocks: the block's number above its value."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).bitwiseOR(F.lit(k << 32)) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])


def least_overlap(m: Column, similarity: float) -> Column:
    """Shingles that two multisets of m must share to reach the similarity; a hair is taken off against rounding."""
    return F.ceil(m * (2 * similarity / (1 + similarity)) - 1e-9)


def least_overlap_of_shorter(m: Column, similarity: float) -> Column:
    """Shingles of an item's m that a multiset of fewer must share to reach the similarity."""
    return F.ceil(m * similarity - 1e-9)


def find_rows(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """As ``find``, with the row key (row_a, row_b) beside doc_id."""
    source = docs.select(F.col(id_col).alias("doc_id"), *row_key(text_col, "row_a", "row_b"), word_array(F.col(text_col)).alias("words"))
    known = items.select(F.col(item_id).alias("item_id"), word_array(F.col(item_text)).alias("item_words")).filter("size(item_words) > 0").distinct()
    known = known.withColumns({"item": F.monotonically_increasing_id(), "n": F.size("item_words"), "k": F.least(F.size("item_words"), F.lit(words))})
    own = F.coalesce(*[F.when(F.col("k") == k, shingle_array("item_words", k)) for k in range(1, words + 1)])
    known = materialise(known.select("item_id", "item", "n", "k", own.alias("own")), "items")  # the numbers are fixed from here on
    counts = known.select("item", F.explode("own").alias("h")).groupBy("item", "h").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.groupBy("item").agg(F.collect_list(F.struct("h", "c")).alias("counts"))
    known = materialise(known.join(counts, "item").withColumns({"m": F.size("own"), "item_fp": fingerprint("own")}), "items")
    sizes = sorted(r["k"] for r in known.select("k").distinct().collect())  # at most `words` numbers
    found = None
    for k in sizes or [words]:
        part = _find(source, known.filter(F.col("k") == k), k, similarity, radius)
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy(*ROW, "item").orderBy(F.desc("similarity"), "start_word")
    return found.withColumn("r", F.row_number().over(best)).filter("r = 1").drop("r", "item")


def find(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): the best window of every contaminated (document, item)."""
    return find_rows(docs, items, **settings).drop("row_a", "row_b")


def _tables(anchors: DataFrame) -> Iterator[tuple[Column, int]]:
    """(table, number of slots): hash tables of the anchors (h, most), together holding each of them once.

    Slot ``h & (slots - 1)`` is the array of the anchors whose hash ends so. A table is one value of a scalar
    subquery and holds about ``TABLE_ROWS`` anchors at most, whatever the size of the benchmark.
    """
    spark, count = anchors.sparkSession, anchors.count()
    parts = max(1, -(-count // TABLE_ROWS))
    slots = 1 << max(4, (count // parts).bit_length())
    for part in range(parts):
        mine = anchors.filter(F.pmod(F.xxhash64("h"), F.lit(parts)) == part)
        filled = mine.groupBy(F.col("h").bitwiseAND(F.lit(slots - 1)).alias("id")).agg(F.collect_list(F.struct("h", "most")).alias("cell"))
        cells = spark.range(slots).join(filled, "id", "left").select("id", F.coalesce("cell", F.expr("cast(array() as array<struct<h: bigint, most: int>>)")).alias("cell"))
        cells = cells.agg(F.sort_array(F.collect_list(F.struct("id", "cell"))).alias("t")).select(F.transform("t", lambda x: x["cell"]).alias("t"))
        yield materialise(cells, "anchors").scalar(), slots


def _hits(source: DataFrame, k: int, table: Column, slots: int) -> DataFrame:
    """(row, h, p, total, low, region) of every shingle that is an anchor; region: the hashes within its items' size of it.

    One expression does it all: words, hashes and the table are bound as lambda variables, so the
    optimiser cannot copy the splitting of a text into a loop over its words.
    """
    most = f"get(filter(t[cast(h & {slots - 1} as int)], e -> e.h = h), 0).most"
    marked = f"filter(transform(a, (h, i) -> struct(h, i as p, {most} as most)), x -> x.most is not null)"
    hit = "struct(x.h as h, x.p as p, size(a) as total, greatest(x.p - x.most + 1, 0) as low, slice(a, greatest(x.p - x.most + 1, 0) + 1, 2 * x.most) as region)"
    hashes = f"case when size(w) >= {k} then transform(sequence(0, size(w) - {k}), i -> xxhash64(slice(w, i + 1, {k}))) else cast(array() as array<bigint>) end"
    # A lambda may not hold the subquery itself, so the table comes in as an argument.
    bound = F.expr(f"flatten(transform(array(__table__), t -> flatten(transform(array(words), w -> flatten(transform(array({hashes}), a -> transform({marked}, x -> {hit})))))))")
    held = source.withColumn("__table__", table)
    return held.select(*ROW, F.explode(bound).alias("x")).select(*ROW, "x.*")


def _find(docs: DataFrame, known: DataFrame, k: int, similarity: float, radius: int) -> DataFrame:
    flat = known.select("item", "m", F.explode("own").alias("h"))
    spread = flat.groupBy("h").agg(F.count(F.lit(1)).alias("f"))
    rarest = Window.partitionBy("item").orderBy("f", "h")
    ranked = flat.join(spread, "h").withColumn("r", F.row_number().over(rarest)).filter(F.col("r") <= F.col("m") - least_overlap_of_shorter(F.col("m"), similarity) + 1)
    same_size = F.col("r") <= F.col("m") - least_overlap(F.col("m"), similarity) + 1
    anchors = materialise(ranked.groupBy("h", "item", "m").agg(F.max(same_size).alias("any_size")), "anchors")
    widest = anchors.groupBy("h").agg(F.max("m").alias("most"))
    hits = None
    for table, slots in _tables(widest):
        part = _hits(docs, k, table, slots)
        hits = part if hits is None else hits.unionByName(part)
    hits = hits.join(anchors.drop("m"), "h").join(known.select("item", "n", "m"), "item").filter("any_size or total < m")
    # A window belongs to the first anchor in it: starts after the one before, so that none is made twice.
    last = F.lag("p").over(Window.partitionBy(*ROW, "item").orderBy("p"))
    first = F.greatest(F.col("p") - F.col("m") + 1, F.coalesce(last + 1, F.lit(0)), F.lit(0))
    hits = hits.withColumn("n", F.least("n", F.col("total") + (k - 1)))
    near = hits.withColumns({"first": first, "until": F.least("p", F.greatest(F.col("total") - F.col("m"), F.lit(0)))}).filter("first <= until")
    windows = near.select(*ROW, "item", "n", "m", "low", "region", F.explode(F.sequence("first", "until")).alias("start_word"))
    windows = windows.select(*ROW, "item", "n", "start_word", F.expr("slice(region, start_word - low + 1, m)").alias("win"))
    # Every window knows its item here, so the (block, value) index is probed in the row: no window is
    # copied per block, and what agrees on no block never gets as far as the verification.
    index = known.select("item", "item_id", "m", "counts", "item_fp", _blocks(F.col("item_fp"), radius).alias("item_blocks"))
    windows = windows.join(index, "item")
    near_item = lambda f: F.arrays_overlap(_blocks(f, radius), F.col("item_blocks")) & (F.bit_count(f.bitwiseXOR(F.col("item_fp"))) <= radius)
    close = windows.filter((F.size("win") < F.col("m")) | F.transform(F.array(fingerprint("win")), near_item)[0])
    shared = F.expr("aggregate(counts, 0, (acc, e) -> acc + cast(least(e.c, size(filter(win, x -> x = e.h))) as int))")
    close = close.withColumn("similarity", F.transform(F.array(shared), lambda s: s / (F.col("m") + F.size("win") - s))[0])
    return close.filter(F.col("similarity") >= similarity - 1e-12).select(*ROW, "item", "item_id", "start_word", F.col("n").alias("n_words"), "similarity")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Documents in which no item is found; every row is judged by its own text, whatever its id."""
    dirty = find_rows(docs, items, id_col=id_col, text_col=text_col, **settings).select(F.col("doc_id").alias("__id__"), "row_a", "row_b").distinct()
    dirty = materialise(dirty, "dirty")
    a, b = row_key(text_col, "a", "b")
    return docs.join(dirty, docs[id_col].eqNullSafe(dirty["__id__"]) & (a == dirty["row_a"]) & (b == dirty["row_b"]), "left_anti")


def oracle(words: int = WORDS, similarity: float = SIMILARITY) -> str:
    """The same rows by brute force over all shared shingles (items of at least ``words`` words)."""
    split = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\r\f\v]+'), lambda x: x <> '')"
    return f"""
with d as (select doc_id, {split} as w from documents),
i as (select item_id, {split} as w from benchmark),
ds as (select doc_id, len(w) - {words - 1} as total, unnest(range(0, len(w) - {words - 1})) as p, w from d where len(w) >= {words}),
dsh as (select doc_id, total, p, array_to_string(w[p + 1 : p + {words}], ' ') as s from ds),
ish as (select item_id, len(w) as n, len(w) - {words - 1} as m, array_to_string(w[q + 1 : q + {words}], ' ') as s
        from (select item_id, w, unnest(range(0, len(w) - {words - 1})) as q from i where len(w) >= {words})),
ic as (select item_id, n, m, s, count(*) as c from ish group by all),
hit as (select doc_id, total, p, item_id, n, m, dsh.s, c from dsh join ic on dsh.s = ic.s),
win as (select doc_id, item_id, n, m, s, c, unnest(range(greatest(p - m + 1, 0), least(p, total - m) + 1)) as start_word from hit),
per as (select doc_id, item_id, n, m, start_word, s, least(count(*), any_value(c)) as o from win group by doc_id, item_id, n, m, start_word, s),
sim as (select doc_id, item_id, n as n_words, start_word, cast(sum(o) as double) / (2 * m - cast(sum(o) as double)) as similarity from per group by doc_id, item_id, n, m, start_word),
best as (select *, row_number() over (partition by doc_id, item_id order by similarity desc, start_word) as r from sim where similarity >= {similarity} - 1e-12)
select doc_id, item_id, cast(start_word as int) as start_word, cast(n_words as int) as n_words, similarity from best where r = 1
"""
