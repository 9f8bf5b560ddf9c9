"""Shared plumbing of the training-data operators."""
from __future__ import annotations

import ctypes
import functools
import gc
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.session import scratch

#: Rows and bytes that travel to a worker in one Arrow batch (one row at least): both sides hold a batch outside the heap.
ROWS, BYTES = 1000, 4 << 20


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and a lost executor costs nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def release(*frames: DataFrame) -> None:
    """Delete tables written by ``materialise`` that nothing reads any more."""
    for frame in frames:
        spark = frame.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(frame.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def trimmed(run: Callable) -> Callable:
    """A worker waits for its next task with what its last one allocated; give freed memory back first."""

    @functools.wraps(run)
    def inner(batches, *args):
        try:
            yield from run(batches, *args)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return inner


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of what follows by rows and by bytes; smaller settings of the user's stand.

    They are read when a plan is run, which may be after the operator has returned, so they stay set.
    """
    for name, most in (("maxRecordsPerBatch", ROWS), ("maxBytesPerBatch", BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(spark.conf.get(name).rstrip("b")) <= most:
            spark.conf.set(name, str(most))


def rebatch(batches: Iterator[pa.RecordBatch], least: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Join batches of short rows, so that vectorised steps have enough of them; long rows make no large batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= least or sum(b.nbytes for b in held) >= BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; where they lie in fewer input partitions than there are cores, dealt out for the Python stages."""
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def whole_text(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def row_key(text: str | Column, *names: str) -> list[Column]:
    """Two 64-bit hashes that, beside the id, tell the rows of a table apart by their texts; a null text has its own."""
    c = F.col(text) if isinstance(text, str) else text
    return [F.xxhash64(F.lit(7 * i), c.isNull(), c).alias(n) for i, n in enumerate(names)]


def fold(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``; a null id is in fold of the empty text (0)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def append_columns(
    df: DataFrame, make: Callable[[], Callable[[list[str | None]], dict[str, list]]], fields: list[T.StructField], text_col: str = "text"
) -> DataFrame:
    """Append columns computed from one text column; every other column passes through as Arrow, untouched.

    ``make`` runs once per task and returns the function applied to each batch of texts. New
    columns replace input columns of the same name (case-insensitive, as Spark resolves names).
    """
    bound_batches(df.sparkSession)
    taken = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken]
    out_schema = T.StructType([*kept, *fields])
    names, new = [f.name for f in kept], [f.name for f in fields]

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        apply, types = make(), [to_arrow_type(f.dataType) for f in fields]
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            got = apply(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
            arrays += [pa.array(got[n], type=t) for n, t in zip(new, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names + new)

    return df.mapInArrow(run, out_schema)


#: Bits of the largest filter that ``split_by_keys`` makes: 4 MB whatever the number of keys.
FILTER_BITS = 1 << 25


def _bitmap(keys: DataFrame) -> tuple[Column, int]:
    """(bitmap as one array of longs, its bits) of the hashes of a one-column frame; 32 bits a key or more, up to FILTER_BITS."""
    hashed = keys.select(F.xxhash64(keys.columns[0]).alias("h"))
    bits = min(FILTER_BITS, 1 << max(10, (32 * hashed.count()).bit_length()))
    at = F.col("h").bitwiseAND(F.lit(bits - 1))
    words = hashed.groupBy(F.shiftright(at, 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("w"))
    cells = keys.sparkSession.range(bits // 64).join(words, "id", "left").select("id", F.coalesce("w", F.lit(0).cast("long")).alias("w"))
    whole = cells.agg(F.sort_array(F.collect_list(F.struct("id", "w"))).alias("t")).select(F.transform("t", lambda x: x["w"]).alias("t"))
    return whole.scalar(), bits


def split_by_keys(df: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that cannot match, rows that may) for the one long column of ``keys``.

    A bitmap of bounded size travels, never the keys; false hits only send a few more rows through the
    join that follows. So a filter by a small share of the ids does not shuffle every text, and the
    texts do not leave the JVM for it. Both parts hold all columns of ``df`` and no other. Null keys may match.
    """
    table, bits = _bitmap(keys)
    at = F.xxhash64(key).bitwiseAND(F.lit(bits - 1))
    word = F.get(table, F.shiftright(at, 6).cast("int"))
    hit = F.call_function("shiftrightunsigned", word, at.bitwiseAND(F.lit(63)).cast("int"))
    may = key.isNull() | (hit.bitwiseAND(F.lit(1)) == 1)
    return df.filter(~may), df.filter(may)


def drop_ids(docs: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id is in the one column of ``gone``; rows with a null id stay."""
    gone = gone.select(F.col(gone.columns[0]).alias("__gone__")).distinct()
    clear, maybe = split_by_keys(docs, F.col(id_col), gone)
    return clear.unionByName(maybe.join(gone, maybe[id_col] == F.col("__gone__"), "left_anti"))
