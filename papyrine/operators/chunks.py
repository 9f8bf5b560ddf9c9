"""Overlapping chunks of tokens or characters.

Tokens are word runs and signs by default, worked out in the JVM. A sub-word tokenizer is a factory of a
function from a text to its token spans, called once per task (``tokenizer_file`` makes one from a file).
"""
from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.functions.text import text_of

#: Stands in for a sub-word tokenizer: runs of word characters, and single signs.
TOKEN = r"(?U)\w+|[^\w\s]"
#: Texts whose spans are held at once.
SPAN_ROWS = 256
Tokenizer = Callable[[], Callable[[str], list[tuple[int, int]]]]


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(text_of(c), F.lit(TOKEN), F.lit(0))


def token_count(c: Column) -> Column:
    return F.regexp_count(text_of(c), F.lit(TOKEN))


def tokenizer_file(path: str) -> Tokenizer:
    """Spans by a tokenizer file, special tokens left out. ``.json``: the tokenizers library; else a SentencePiece model."""

    def load():
        if path.endswith(".json"):
            from tokenizers import Tokenizer as Loaded

            loaded = Loaded.from_file(path)
            return lambda text: [s for s in loaded.encode(text, add_special_tokens=False).offsets if s[1] > s[0]]
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        return lambda text: [(p.begin, p.end) for p in model.encode(text, out_type="immutable_proto").pieces if p.end > p.begin]

    return load


def with_token_spans(df: DataFrame, text_col: str, tokenizer: Tokenizer, out_col: str = "_spans") -> DataFrame:
    """Append the array of (b, e) character spans of each text's tokens, a few texts at a time, as whole numbers side by side."""
    names = [f.name for f in df.schema.fields if f.name != out_col]
    item = T.StructType([T.StructField("b", T.IntegerType()), T.StructField("e", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, kind = tokenizer(), pa.list_(pa.struct([("b", pa.int32()), ("e", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, SPAN_ROWS):
                part = batch.slice(at, SPAN_ROWS)
                sizes, flat = [0], array("i")
                for text in part.column(part.schema.get_field_index(text_col)):
                    for span in cut(text.as_py() or ""):
                        flat.extend(span)
                    sizes.append(len(flat) // 2)
                ends = np.frombuffer(flat, np.int32).reshape(-1, 2) if flat else np.empty((0, 2), np.int32)
                spans = pa.StructArray.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], fields=list(kind.value_type))
                found = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), spans, type=kind)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), found], names=[*names, out_col])

    return df.mapInArrow(run, T.StructType([*(df.schema[n] for n in names), T.StructField(out_col, T.ArrayType(item))]))


def _count(n: Column, size: int, overlap: int) -> Column:
    return F.when(n <= size, 1).otherwise(F.ceil((n - overlap) / (size - overlap))).cast("int")


def _check(size: int, overlap: int) -> None:
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the chunk")


_plain_tokens = re.compile(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]").findall


def _plain_chunks(df: DataFrame, text_col: str, size: int, overlap: int) -> DataFrame:
    """Append _chunks, the pieces of an ASCII text (n: its tokens, t: their texts); null for another text, whose tokens columns find."""
    item = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("t", T.ArrayType(T.StringType()))])

    def cut(text: str | None) -> tuple[int | None, list[str] | None]:
        if text is None or not text.isascii() or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return None, None
        found = _plain_tokens(text)
        starts = range(0, max(len(found) - overlap, 1), size - overlap) if found else ()
        return len(found), [" ".join(found[b : b + size]) for b in starts]

    @F.arrow_udf(item)
    def run(texts: pa.Array) -> pa.Array:
        rows = [cut(t) for t in texts.to_pylist()]
        arrays = [pa.array([n for n, _ in rows], pa.int32()), pa.array([t for _, t in rows], pa.list_(pa.string()))]
        return pa.StructArray.from_arrays(arrays, names=["n", "t"], mask=pa.array([n is None for n, _ in rows], pa.bool_()))

    return df.withColumn("_chunks", run(text_of(F.col(text_col))))


def token_chunks(df: DataFrame, text_col: str, size: int = 300, overlap: int = 50, tokenizer: Tokenizer | None = None, keep_empty: bool = False) -> DataFrame:
    """One row per chunk: chunk_id, token_start, token_end, n_tokens_chunk, texto_chunk. Texts without a token give none.

    ``keep_empty``: they give a chunk without text.

    Word tokens are joined by spaces; a chunk of sub-word tokens is the text from its first to its last one.
    """
    _check(size, overlap)
    step, names = size - overlap, df.columns
    if tokenizer is None:
        df = _plain_chunks(df, text_col, size, overlap)
        pieces = lambda t: F.transform(F.sequence(F.lit(0), _count(F.size(t), size, overlap) - 1), lambda i: F.array_join(F.slice(t, i * step + 1, F.lit(size)), " "))
        slow = F.transform(F.array(tokens(F.col(text_col))), lambda t: F.struct(F.size(t).alias("n"), F.when(F.size(t) > 0, pieces(t)).otherwise(F.array().cast("array<string>")).alias("t")))[0]
        df = df.select(*names, F.inline(F.array(F.coalesce("_chunks", slow))).alias("_n", "_texts"))
        explode = F.posexplode_outer if keep_empty else F.posexplode
        df = df.select(*names, "_n", explode("_texts").alias("chunk_id", "texto_chunk")).withColumn("chunk_id", F.coalesce("chunk_id", F.lit(0)))
    else:
        df = with_token_spans(df, text_col, tokenizer, "_t").withColumn("_n", F.size("_t"))
        df = df if keep_empty else df.filter("_n > 0")
        df = df.select("*", F.explode(F.sequence(F.lit(0), _count(F.col("_n"), size, overlap) - 1)).alias("chunk_id"))
    df = df.withColumn("token_start", F.col("chunk_id") * step).withColumn("token_end", F.least("_n", F.col("token_start") + size))
    if tokenizer is not None:
        begin, end = F.get("_t", F.col("token_start"))["b"], F.get("_t", F.col("token_end") - 1)["e"]
        df = df.withColumn("texto_chunk", F.substring(F.col(text_col), begin + 1, end - begin))
    return df.select(*names, "chunk_id", "token_start", "token_end", (F.col("token_end") - F.col("token_start")).alias("n_tokens_chunk"), "texto_chunk")


def char_chunks(df: DataFrame, text_col: str, size: int = 2800, overlap: int = 400) -> DataFrame:
    """One row per chunk of characters: chunk_id, offset, texto_chunk. An empty text gives one empty chunk."""
    _check(size, overlap)
    text, step = text_of(F.col(text_col)), size - overlap
    df = df.select("*", F.explode(F.sequence(F.lit(0), _count(F.length(text), size, overlap) - 1)).alias("chunk_id"))
    df = df.withColumn("offset", F.col("chunk_id") * step)
    return df.withColumn("texto_chunk", F.substring(text, F.col("offset") + 1, F.lit(size)))
