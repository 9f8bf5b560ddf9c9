"""Entity extraction: one document row to an array of entities with character spans.

Spans of all matches need Python's matcher (no built-in returns every offset), so the texts pass one
Arrow stage that applies all patterns; everything after it is column expressions on the arrays.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.functions import patterns as P
from papyrine.functions import plain

#: Spans come first so that the natural order of an array of entities is the order in the text.
ENTITY = T.StructType(
    [
        T.StructField("span_inicio", T.IntegerType()),
        T.StructField("span_fin", T.IntegerType()),
        T.StructField("orden", T.IntegerType()),
        T.StructField("tipo", T.StringType()),
        T.StructField("subtipo", T.StringType()),
        T.StructField("valor", T.StringType()),
        T.StructField("valor_normalizado", T.StringType()),
        T.StructField("monto_normalizado", T.DoubleType()),
        T.StructField("metodo", T.StringType()),
        T.StructField("contexto", T.StringType()),
        T.StructField("confianza", T.DoubleType()),
        T.StructField("texto_monto", T.StringType()),
        T.StructField("origen", T.StringType()),
    ]
)
SIMPLE = T.StructType([T.StructField("etiqueta", T.StringType()), T.StructField("texto", T.StringType()), T.StructField("valor_normalizado", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])

_rich = {k: re.compile(p, re.IGNORECASE) for k, p in P.RICH.items()}
_near_id = [re.compile(p, re.IGNORECASE) for p in P.PERSON_NEAR_ID]
_simple = {k: (re.compile(p, re.IGNORECASE), re.compile(v)) for k, (p, v) in P.SIMPLE_IDS.items()}
#: What the matches of a pattern begin with, in lower case.
_HEADS = {
    "ACCOUNT": ("cbu", "cvu"),
    "TAX_ID": ("cuit", "cuil", "c.u.i.t.", "c.u.i.l."),
    "DNI": ("dni", "d.n.i.", "d.n.l.", "dn!", "documento", "doc."),
    "ALIAS": ("alias",),
    "AMOUNT": ("$", "ars", "peso"),
    "CUIL": ("cuil", "c.u.i.l."),
    "CUIT": ("cuit", "c.u.i.t."),
    "CBU": ("cbu",),
    "CVU": ("cvu",),
}
_SIMPLE_HEADS = _HEADS | {"DNI": ("dni", "d.n.i.", "documento", "doc")}
_PERSON_HEADS = ("sr", "señor")
#: What a name before an identity document ends with, and the signs that may be in it and after it.
_ID_MARKS = ("dni", "d.n.i.", "d.n.l.", "dn!")
_NAME_SIGNS = "".join(chr(i) for i in range(0xFF) if chr(i).isalpha()) + "\t\n\x0b\x0c\r "


class EntityModel(Protocol):
    """A named-entity model: spans of persons in a text, with scores. Loaded once per worker."""

    def persons(self, text: str) -> list[tuple[int, int, float]]: ...


class CapitalRuns:
    """The model used where none is given: runs of two to six capitalised words, at a fixed score."""

    _run = re.compile(r"\b[A-ZÁÉÍÓÚÑ][A-Za-zÁÉÍÓÚÑáéíóúñ]+(?:[ ]+[A-ZÁÉÍÓÚÑ][A-Za-zÁÉÍÓÚÑáéíóúñ]+){1,5}\b")

    def persons(self, text: str) -> list[tuple[int, int, float]]:
        return [(m.start(), m.end(), 0.5) for m in self._run.finditer(text)]


def squeeze(text: str) -> str:
    return " ".join(text.split())


def digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def money(text: str) -> float | None:
    """The amount an es-AR figure stands for; see ``functions.text.money_ar`` for the rule."""
    figure = re.sub(r"[^\d,.]", "", re.sub(r"(?i)\bARS\b|\bpesos?\b", "", text))
    if "," in figure:
        figure = (figure.replace(".", "") if "." in figure else figure).replace(",", ".")
    elif figure.count(".") > 1 or len(figure.rpartition(".")[2]) == 3 and "." in figure:
        figure = figure.replace(".", "")
    try:
        return float(figure) if figure else None
    except ValueError:
        return None


def window(text: str, begin: int, end: int, size: int = 220) -> str:
    return squeeze(text[max(0, begin - size) : end + size])


class _Found(list):
    """Collects entities of one text in the order of discovery."""

    def __init__(self, text: str):
        super().__init__()
        self.text = text

    def put(self, kind: str, begin: int, end: int, value: str, norm: str | None, **more) -> None:
        row = dict.fromkeys(ENTITY.names)
        row |= {"span_inicio": begin, "span_fin": end, "orden": len(self), "tipo": kind, "valor": squeeze(value), "valor_normalizado": norm, "contexto": window(self.text, begin, end), "metodo": "regex"}
        self.append(row | more)


def _finder(patterns: dict[str, re.Pattern], heads: dict[str, tuple[str, ...]], text: str) -> Callable[[str], Iterator[re.Match]]:
    """Matches of a pattern by name, those of a plain text only where they can begin."""
    low = plain.lower_if_plain(text)
    return (lambda k: patterns[k].finditer(text)) if low is None else lambda k: plain.matches(patterns[k], text, low, heads[k])


def _names_near_id(text: str) -> Iterator[re.Match]:
    low = plain.lower_if_plain(text)
    if low is None:
        for pattern in _near_id:
            yield from pattern.finditer(text)
        return
    titled, holder, direct = _near_id
    yield from plain.matches(titled, text, low, _PERSON_HEADS)
    if "titular" in low:
        yield from plain.matches_before(holder, text, low, _ID_MARKS, _NAME_SIGNS + ",")
    yield from plain.matches_before(direct, text, low, _ID_MARKS, _NAME_SIGNS + "([")


def rich_entities(text: str, found: _Found | None = None) -> _Found:
    """Accounts, tax ids, DNI, aliases and amounts, in this order."""
    found, find = _Found(text) if found is None else found, _finder(_rich, _HEADS, text)
    for kind, length, sure in (("ACCOUNT", (22, 22), 0.97), ("TAX_ID", (11, 11), 0.96), ("DNI", (7, 8), 0.94)):
        for m in find(kind):
            norm, label = digits(m["value"]), m["label"].upper().replace(".", "")
            if length[0] <= len(norm) <= length[1]:
                name = {"ACCOUNT": label, "TAX_ID": "CUIT_CUIL"}.get(kind, kind)
                found.put(name, *m.span("value"), m["value"], norm, confianza=sure, subtipo=label if kind == "TAX_ID" else None)
    for m in find("ALIAS"):
        found.put("ALIAS", *m.span("value"), m["value"], m["value"].upper(), confianza=P.CONFIDENCE["ALIAS"])
    for m in find("AMOUNT"):
        raw = f"{m['prefix']} {m['value']}"
        value = money(raw)
        if value is not None and value >= P.LEAST_AMOUNT:
            before = squeeze(text[max(0, m.start() - 180) : m.start()])
            words = _rich["AMOUNT_IN_WORDS"].search(before) if not before.isascii() or "peso" in before.lower() else None
            found.put("MONTO", *m.span(), raw, None, monto_normalizado=value, metodo="regex_contextual", texto_monto=squeeze(words[1]) if words else None)
    return found


def persons_near_id(text: str, found: _Found | None = None) -> _Found:
    """Names directly before an identity document mark."""
    found = _Found(text) if found is None else found
    for m in _names_near_id(text):
        name = squeeze(m["name"])
        around = window(text, *m.span("name"), 180).lower()
        if any(t in name.lower() for t in P.PERSON_BAD_TOKENS) or any(t in around for t in P.PERSON_BAD_CONTEXT):
            continue
        found.put("persona", *m.span("name"), name, name.upper(), confianza=P.CONFIDENCE["PERSON"], metodo="regex_persona_cerca_dni", origen="persona_cerca_dni")
    return found


def char_windows(text: str, size: int = 2800, overlap: int = 400) -> Iterator[tuple[int, str]]:
    for begin in range(0, max(1, len(text) - overlap), size - overlap):
        yield begin, text[begin : begin + size]


def model_persons(text: str, model: EntityModel, least: float, found: _Found) -> _Found:
    """Persons by the model, piece by piece, spans in the whole text."""
    for offset, piece in char_windows(text):
        if not piece.strip():
            continue
        for begin, end, score in model.persons(piece):
            value = squeeze(piece[begin:end])
            if score >= least and valid_candidate(value):
                found.put("persona", offset + begin, offset + end, value, value.upper(), confianza=score, metodo="modelo")
    return found


def valid_candidate(value: str) -> bool:
    low, letters = value.lower(), sum(map(str.isalpha, value))
    return len(value) >= 5 and letters >= 3 and sum(map(str.isdigit, value)) <= letters and not any(t in low for t in P.CANDIDATE_BAD_TOKENS)


def simple_entities(text: str) -> list[dict]:
    out, find = [], _finder({k: p for k, (p, _) in _simple.items()}, _SIMPLE_HEADS, text)
    for label, (_, shape) in _simple.items():
        for m in find(label):
            raw = m[1].strip()
            norm = re.sub(r"\D", "", raw)
            if shape.fullmatch(norm):
                out.append({"etiqueta": label, "texto": f"{label} {squeeze(raw)}", "valor_normalizado": norm, "start": m.start(), "end": m.end()})
    return out


def _lists(rows: list[list[dict]], kind: pa.ListType) -> pa.ListArray:
    """Lists of structs, built field by field: several times as fast as from the dictionaries."""
    flat = [e for row in rows for e in row]
    fields = list(kind.value_type)
    items = pa.StructArray.from_arrays([pa.array([e[f.name] for e in flat], f.type) for f in fields], fields=fields)
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, rows))], pa.int32()), items, type=kind)


def _append(df: DataFrame, text_col: str, name: str, item: T.StructType, find: Callable[[], Callable[[str], list[dict]]], choose: Callable[[str, list[dict]], tuple] | None = None, chosen: T.StructType | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Append the items that are found in a text, and what is chosen among them, if that is asked for."""
    more = chosen.fields if chosen else []
    kept = [f for f in df.schema.fields if f.name not in (name, *drop, *(m.name for m in more))]
    schema = T.StructType([*kept, T.StructField(name, T.ArrayType(item)), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        apply, kind = find(), pa.list_(to_arrow_type(item))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            arrays = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            found = [apply(t or "") for t in texts]
            if choose and found:
                picks = zip(*(choose(t or "", items) for t, items in zip(texts, found, strict=True)), strict=True)
            else:
                picks = [()] * len(more)
            chosen_arrays = [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(picks, more, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, _lists(found, kind), *chosen_arrays], names=schema.names)

    return df.mapInArrow(run, schema)


def ordered(entities: list[dict]) -> list[dict]:
    """As ``drop_partial_persons`` of ``order_and_dedupe``, on the entities of one text."""
    seen, others, persons = set(), [], []
    for e in sorted(entities, key=lambda e: (e["span_inicio"], e["span_fin"], e["orden"])):
        norm, amount = e["valor_normalizado"], e["monto_normalizado"]
        key = (e["tipo"], amount if norm is None and amount is not None else (e["valor"] if norm is None else norm).strip(" ").lower(), e["span_inicio"], e["span_fin"])
        if key not in seen:
            seen.add(key)
            (persons if e["tipo"] == "persona" else others).append(e)
    if persons:
        values = [(e["valor_normalizado"] if e["valor_normalizado"] is not None else e["valor"] or "").strip(" ").upper() for e in persons]
        others += [e for e, v in zip(persons, values, strict=True) if v and not any(v != w and v in w for w in values)]
    return others


def with_entities(df: DataFrame, text_col: str, out_col: str = "entidades", model: Callable[[], EntityModel] | None = None, least: float = 0.20, near_id: bool = True, in_order: bool = False, **choice) -> DataFrame:
    """Append the array of rich entities: by pattern, then by model (a factory, if given), then persons near ids.

    ``in_order``: in the order of their spans, without repeats and partial persons.
    """

    def find():
        loaded = model() if model else None

        def apply(text: str) -> list[dict]:
            found = rich_entities(text)
            if loaded is not None:
                model_persons(text, loaded, least, found)
            found = persons_near_id(text, found) if near_id else found
            return ordered(found) if in_order else found

        return apply

    return _append(df, text_col, out_col, ENTITY, find, **choice)


def with_simple_ids(df: DataFrame, text_col: str, out_col: str = "entidades", keep_text: bool = True) -> DataFrame:
    return _append(df, text_col, out_col, SIMPLE, lambda: simple_entities, drop=() if keep_text else (text_col,))


def order_and_dedupe(entities: Column) -> Column:
    """By span, first of equal (kind, normalised value, span)."""
    ordered = F.sort_array(entities)  # the fields of ENTITY begin with the span and the order of discovery
    key = lambda e: F.struct(e["tipo"], F.lower(F.trim(F.coalesce(e["valor_normalizado"], e["monto_normalizado"].cast("string"), e["valor"]))), e["span_inicio"], e["span_fin"])
    return F.transform(
        F.array(ordered),
        lambda all_: F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, 1, i), lambda p: key(p) == key(e))),
    )[0]


def drop_partial_persons(entities: Column) -> Column:
    """Others first, then the persons that no other person's value contains; empty values go."""
    value = lambda e: F.upper(F.trim(F.coalesce(e["valor_normalizado"], e["valor"], F.lit(""))))
    persons = F.filter(entities, lambda e: (e["tipo"] == "persona") & (value(e) != ""))
    others = F.filter(entities, lambda e: e["tipo"] != "persona")
    whole = F.transform(F.array(persons), lambda ps: F.filter(ps, lambda p: ~F.exists(ps, lambda q: (value(q) != value(p)) & value(q).contains(value(p)))))[0]
    return F.concat(others, whole)


def dedupe_best(entities: DataFrame, id_col: str = "id", label_col: str = "etiqueta", text_col: str = "texto", score_col: str = "score") -> DataFrame:
    """One row per (document, label, squeezed lower text): the best score, a null score last."""
    key = F.lower(F.trim(F.regexp_replace(text_col, r"(?U)\s+", " ")))
    best = Window.partitionBy(id_col, label_col, key).orderBy(F.desc_nulls_last(score_col), text_col)
    return entities.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def dedupe_first(entities: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of equal keys: removes what overlapping chunks find twice."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return entities.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
