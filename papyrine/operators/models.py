"""Model inference over documents: whole texts or token chunks, one row per prediction.

A model is a factory called once per task (``pretrained`` opens a folder once per worker); what it returns
maps a text and a list of labels to predictions in any of the usual shapes, which ``spans`` brings to one.
One that has ``many`` gets a batch of texts at once. Every document gives a row at
least: a sentinel label says that it has no text, no entity, or that the model failed on it.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.functions import patterns as P
from papyrine.functions.text import context
from papyrine.operators import chunks

Model = Callable[[str, list[str], float], object]
#: Labels and threshold.
Setting = tuple[list[str], float]
ROW = T.StructType(
    [
        T.StructField("entidad_texto", T.StringType()),
        T.StructField("entidad_label", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)
NO_ENTITY, NO_TEXT, FAILED = P.SENTINELS


def spans(raw: object, text: str, label: str | None = None) -> Iterator[tuple[str, str | None, float | None, int | None, int | None]]:
    """(text, label, score, start, end) of a result given as strings, dictionaries, or lists and mappings of them.

    A prediction without a span gets the first place of its text, if it is found.
    """
    if isinstance(raw, str):
        at = text.find(raw)
        yield raw, label, None, at if at >= 0 else None, at + len(raw) if at >= 0 else None
    elif isinstance(raw, (list, tuple)):
        for item in raw:
            yield from spans(item, text, label)
    elif isinstance(raw, dict):
        value = raw.get("text") or raw.get("span")
        if value is None and not {"start", "end"} <= raw.keys():
            inner = raw.get("entities", raw)
            for name, items in inner.items() if isinstance(inner, dict) else [(label, inner)]:
                yield from spans(items, text, name)
            return
        begin, end = raw.get("start"), raw.get("end")
        value = value if value is not None else text[begin:end]
        if begin is None or end is None:
            begin = text.find(value)
            begin, end = (begin, begin + len(value)) if begin >= 0 else (None, None)
        score = raw.get("score", raw.get("confidence"))
        yield value, raw.get("label", label), None if score is None else float(score), begin, end


def _open_library(path: str) -> object:
    """The model that a folder or name holds, by the usual library, which is asked for only here."""
    try:
        from gliner import GLiNER
    except ImportError as e:
        raise RuntimeError("loading a pretrained model needs its library on the executors") from e
    return GLiNER.from_pretrained(path)


_OPENED: dict[tuple, object] = {}


class Pretrained:
    """A loaded model with ``predict_entities`` (and, if it has one, ``batch_predict_entities``) as a ``Model``."""

    def __init__(self, inner: object):
        self.inner = inner

    def __call__(self, text: str, labels: list[str], threshold: float) -> object:
        return self.inner.predict_entities(text, labels, threshold=threshold)

    def many(self, texts: list[str], labels: list[str], threshold: float) -> list[object]:
        batch = getattr(self.inner, "batch_predict_entities", None)
        return batch(texts, labels, threshold=threshold) if batch else [self(t, labels, threshold) for t in texts]

    def persons(self, text: str, label: str = "persona", threshold: float = 0.35) -> list[tuple[int, int, float]]:
        """Spans for ``extract.with_entities``."""
        return [(b, e, s or 0.0) for _, name, s, b, e in spans(self(text, [label], threshold), text) if b is not None and name in (label, None)]


def pretrained(path: str, open_model: Callable[[str], object] = _open_library) -> Callable[[], Pretrained]:
    """A factory that opens the model at ``path`` once per worker process, not once per task."""

    def load() -> Pretrained:
        from papyrine.operators import models

        key = (path, open_model.__qualname__)
        if key not in models._OPENED:
            models._OPENED[key] = Pretrained(open_model(path))
        return models._OPENED[key]

    return load


#: Texts that a model with ``many`` gets at once.
BATCH = 16


def _answers(model: Model, texts: list[str], labels: list[str], threshold: float) -> Iterator[tuple[object, str | None]]:
    """(result, error) per text; where a batch fails its texts are tried one by one."""
    one_by_one = texts
    if hasattr(model, "many"):
        try:
            got = model.many(texts, labels, threshold)
            if len(got) == len(texts):
                yield from ((g, None) for g in got)
                one_by_one = []
        except Exception:  # noqa: BLE001, S110  each text is tried below
            pass
    for text in one_by_one:
        try:
            yield model(text, labels, threshold), None
        except Exception as e:  # a model's failure on one text is a row, not the end of the job
            yield None, str(e)[:500]


def _run(df: DataFrame, text_col: str, load: Callable[[], Model], settings: list[Setting]) -> DataFrame:
    """A row per prediction under each setting, whose number is _setting, in one pass over the texts.

    A text without a prediction gives a row of ``NO_TEXT`` or ``NO_ENTITY``, a failure one of ``FAILED``.
    """
    kept = [f for f in df.schema.fields if f.name not in ROW.names]
    names, out_schema = [f.name for f in kept], T.StructType([*kept, *ROW.fields, T.StructField("_setting", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        model, schema = load(), to_arrow_schema(out_schema)

        def under(batch: pa.RecordBatch, texts: list[str | None], asked: list[str], number: int, labels: list[str], threshold: float) -> pa.RecordBatch:
            picked, out = [], []
            answers = (a for at in range(0, len(asked), BATCH) for a in _answers(model, asked[at : at + BATCH], labels, threshold))
            for i, text in enumerate(texts):
                found: list[tuple] = [(None, NO_TEXT, None, None, None, None)]
                if text and text.strip():
                    raw, error = next(answers)
                    found = [(None, FAILED, None, None, None, error)] if error is not None else [(*s, None) for s in spans(raw, text)] or [(None, NO_ENTITY, None, None, None, None)]
                out += found
                picked += [i] * len(found)
            rows = pa.array(picked, pa.int32())
            arrays = [batch.column(batch.schema.get_field_index(n)).take(rows) for n in names]
            arrays += [pa.array(list(c), schema.field(f.name).type) for f, c in zip(ROW.fields, zip(*out, strict=True) if out else [()] * len(ROW.fields), strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([number] * len(rows), pa.int32())], schema=schema)

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            asked = [t for t in texts if t and t.strip()]
            for number, (labels, threshold) in enumerate(settings):
                yield under(batch, texts, asked, number, labels, threshold)

    return df.mapInArrow(run, out_schema)


def predict(df: DataFrame, text_col: str, load: Callable[[], Model], labels: list[str], threshold: float = 0.35) -> DataFrame:
    """Whole texts: one row per prediction with its context, a sentinel row for the rest."""
    return predict_all(df, text_col, load, [(labels, threshold)]).drop("_setting")


def predict_all(df: DataFrame, text_col: str, load: Callable[[], Model], settings: list[Setting]) -> DataFrame:
    found = _run(df, text_col, load, settings)
    return found.withColumn("texto_contexto", context(F.col(text_col), F.col("start"), F.col("end")))


def predict_chunks(df: DataFrame, text_col: str, load: Callable[[], Model], labels: list[str], threshold: float = 0.35, id_col: str = "id", size: int = 300, overlap: int = 50, tokenizer: chunks.Tokenizer | None = None) -> DataFrame:
    """Token chunks: spans lie in the chunk; a document in which no chunk finds anything keeps one sentinel row.

    Repeats from overlapping chunks stay; ``extract.dedupe_first`` removes them.
    """
    return predict_chunks_all(df, text_col, load, [(labels, threshold)], id_col, size, overlap, tokenizer).drop("_setting")


def predict_chunks_all(df: DataFrame, text_col: str, load: Callable[[], Model], settings: list[Setting], id_col: str = "id", size: int = 300, overlap: int = 50, tokenizer: chunks.Tokenizer | None = None) -> DataFrame:
    label = F.when(F.trim(F.coalesce(text_col, F.lit(""))) == "", NO_TEXT).otherwise(NO_ENTITY)
    parts = chunks.token_chunks(df, text_col, size, overlap, tokenizer, keep_empty=True).withColumn("_none", label)
    found = _run(parts, "texto_chunk", load, settings)
    # The first chunk speaks for a document without a hit. Whether there is one is told by the id, in one pass over the
    # predictions; a null id is a document of its own.
    hit = ~F.coalesce(F.col("entidad_label").isin(NO_ENTITY, NO_TEXT), F.lit(False))
    by_id = Window.partitionBy(id_col, "_setting")
    found = found.filter(hit | (F.col("chunk_id") == 0)).withColumns({"_hit": hit, "_any": F.col(id_col).isNotNull() & F.max(hit).over(by_id)})
    found = found.filter(F.col("_hit") | ~F.col("_any"))
    blank = [c for c in parts.columns if c not in df.columns and c != "_none"]
    rows = found.withColumns({"entidad_label": F.when(F.col("_hit"), F.col("entidad_label")).otherwise(F.col("_none"))} | {c: F.when(F.col("_hit"), F.col(c)) for c in blank})
    return rows.drop("_hit", "_any", "_none").withColumn("texto_contexto", context(F.col("texto_chunk"), F.col("start"), F.col("end")))


def digit_runs(text: str, labels: list[str], threshold: float) -> object:
    """The model of tests and demonstrations: runs of seven digits or more under the first label, at a score of 0.9."""
    import re

    return {labels[0]: [] if threshold > 0.9 else [{"text": m[0], "start": m.start(), "end": m.end(), "score": 0.9} for m in re.finditer(r"\d{7,}", text)]}
