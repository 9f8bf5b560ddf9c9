"""Choosing the main amount, person and account of a document, and assembling documents and reports.

``resolve`` chooses by expressions on an array of entities; ``resolved`` finds and chooses in the one pass through
Python that finding needs, which takes a fraction of the time. Neither shuffles.
"""
from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.functions import patterns as P
from papyrine.functions.text import ICASE, squeeze
from papyrine.operators.extract import drop_partial_persons, order_and_dedupe, with_entities


def _any(text: Column, words: list[str]) -> Column:
    return reduce(or_, (text.contains(w) for w in words))


def _hits(text: Column, words: list[str]) -> Column:
    return reduce(add, (text.contains(w).cast("int") for w in words))


def _before(text: Column, at: Column, size: int) -> Column:
    low = F.greatest(at - size, F.lit(0))
    return F.lower(F.substring(text, low + 1, at - low))


def _after(text: Column, at: Column, size: int) -> Column:
    return F.lower(F.substring(text, at + 1, F.lit(size)))


def _points(test: Column, points: float) -> Column:
    return F.when(test, F.lit(float(points))).otherwise(F.lit(0.0))


def _with(value: Column, use) -> Column:
    """``use`` of a value that is worked out once: a lambda variable is not copied into every place that reads it."""
    return F.transform(F.array(value), use)[0]


def amount_score(e: Column, text: Column) -> Column:
    """Points for an amount by the words around it."""
    begin, end = e["span_inicio"], e["span_fin"]
    parts = F.struct(
        F.concat(_before(text, begin, 250), F.lit(" "), _after(text, end, 180)).alias("around"),
        _before(text, begin, 100).alias("before"),
        _after(text, end, 120).alias("after"),
        (F.instr(F.lower(text), P.QUOTED_ORDERS) - 1).alias("orders"),
    )

    def points(w: Column) -> Column:
        return (
            _points(e["valor"].contains("$"), 2)
            + 5.0 * _hits(w["around"], P.AMOUNT_STRONG)
            + 3.0 * _hits(w["around"], P.AMOUNT_MEDIUM)
            + _points(_any(w["before"], P.AMOUNT_EXTRA_BEFORE), -8)
            + _points(_any(w["after"], P.AMOUNT_COSTS_AFTER), -6)
            + _points(_any(w["around"], P.AMOUNT_FALSE_CONTEXT), -4)
            + _points((w["orders"] >= 0) & (begin < w["orders"]), 4)
            + _points((w["orders"] >= 0) & (begin > w["orders"]), -1)
            + _points(F.coalesce(e["texto_monto"], F.lit("")) != "", 1)
            + _points(F.coalesce(e["monto_normalizado"], F.lit(0.0)) > 0, 1)
        )

    return _with(parts, points)


def person_score(e: Column, text: Column) -> Column:
    """Points for a person being the debtor: role words, caption side, identity marks, wording of the order."""
    begin, end = e["span_inicio"], e["span_fin"]
    # The line of the name: from the line end before it, or 200 characters where there is none.
    head = F.substring(text, F.lit(1), begin)
    broken = F.instr(F.reverse(head), "\n")
    rest = F.instr(F.substring(text, end + 1, F.length(text)), "\n")
    places = F.struct(
        F.when(broken > 0, begin - broken).otherwise(F.greatest(begin - 200, F.lit(0))).alias("line_begin"),
        F.when(rest > 0, end + rest - 1).otherwise(F.least(F.length(text), end + 200)).alias("line_end"),
        _before(text, begin, 120).alias("before"),
        _after(text, end, 160).alias("after"),
        F.concat(_before(text, begin, 260), F.lit(" "), _after(text, end, 260)).alias("medium"),
        _before(text, begin, 500).alias("wide"),
        F.lower(F.coalesce(e["valor"], F.lit(""))).alias("value"),
    )

    def read(w: Column) -> Column:
        line = F.lower(F.substring(text, w["line_begin"] + 1, w["line_end"] - w["line_begin"]))
        versus = _with(line, lambda x: F.when(x.contains("c/"), F.instr(x, "c/") - 1).otherwise(F.instr(x, " c ") - 1))
        return F.struct(w.alias("w"), F.concat(w["before"], F.lit(" "), w["after"]).alias("near"), versus.alias("versus"), (begin - w["line_begin"]).alias("place"))

    def points(r: Column) -> Column:
        w, near = r["w"], r["near"]
        system = w["wide"].contains("usuario conectado") | (w["wide"].contains("usuari") & w["wide"].contains("conectado"))
        return (
            F.coalesce(e["confianza"], F.lit(0.0))
            + _points(_any(w["value"], P.ROLE_IN_VALUE), -20)
            + _points(_any(near, P.AUTHORITY_NEAR), -20)
            + _points(system & ~_any(near, P.ID_NEAR), -10)
            + _points(_any(F.right(w["before"], F.lit(45)), P.TITLES_NEAR), -6)
            + _points(w["value"].startswith("dr.") | w["value"].startswith("dra."), -6)
            + _points((r["versus"] >= 0) & (r["place"] < r["versus"]), -8)
            + _points((r["versus"] >= 0) & (r["place"] > r["versus"]), 4)
            + 5.0 * _hits(near, P.DEBTOR_NEAR)
            + _points(_any(near, P.ID_TOKENS), 7)
            + _points(_any(F.substring(w["after"], 1, 110), P.ID_TOKENS), 5)
            + _points(_any(F.substring(w["after"], 1, 90), P.ID_SHORT), 4)
            + 1.5 * _hits(w["medium"], P.EMBARGO_MEDIUM)
            - 3.0 * _hits(near, P.THIRD_PARTY_NEAR)
        )

    return _with(_with(places, read), points)


def account_score(e: Column) -> Column:
    return _with(F.lower(F.coalesce(e["contexto"], F.lit(""))), lambda c: 2.0 * _hits(c, P.ACCOUNT_NEAR))


def _first_best(items: Column, *keys) -> Column:
    """The item with the largest keys, the first of equals; null without items. ``keys`` map an item to a column."""
    rated = F.transform(items, lambda e, i: F.struct(*[k(e).alias(f"k{n}") for n, k in enumerate(keys)], (-i).alias("place"), e.alias("e")))
    return F.array_max(rated)["e"]


def _scored(items: Column, name: str, score) -> Column:
    return F.transform(items, lambda e: e.withField(name, score(e)))


def best_amount(entities: Column, text: Column) -> Column:
    amounts = _scored(F.filter(entities, lambda e: e["tipo"] == "MONTO"), "score_contextual", lambda e: amount_score(e, text))
    best = _first_best(amounts, lambda e: e["score_contextual"], lambda e: -e["span_inicio"])
    sure = lambda b: F.round(F.greatest(F.lit(0.35), F.least(F.lit(0.98), 0.55 + b["score_contextual"] * 0.035)), 2)
    return _with(best, lambda b: F.when(b.isNotNull(), b.withField("confianza", sure(b))))


def best_person(entities: Column, text: Column) -> Column:
    persons = _scored(F.filter(entities, lambda e: e["tipo"] == "persona"), "score_rol_embargado", lambda e: person_score(e, text))
    return _first_best(persons, lambda e: e["score_rol_embargado"], lambda e: F.coalesce(e["confianza"], F.lit(0.0)))


def nearest(target: Column, candidates: Column, most: int) -> Column:
    """The candidate with the least gap to the target's span (0 if they overlap), the first of equals, if within ``most``."""
    gap = lambda c: F.greatest(c["span_inicio"] - target["span_fin"], target["span_inicio"] - c["span_fin"], F.lit(0))
    rated = F.transform(candidates, lambda c, i: F.struct(gap(c).alias("gap"), i.alias("place"), c.alias("c")))
    best = F.array_min(F.filter(rated, lambda r: r["gap"].isNotNull()))
    return _with(best, lambda b: F.when(target.isNotNull() & (b["gap"] <= most), b["c"]))


def bank_in(context: Column) -> Column:
    return _with(squeeze(F.regexp_extract(squeeze(context), ICASE + P.RICH["BANK"], 1)), lambda b: F.when(b != "", b))


def resolve(df: DataFrame, text_col: str = "texto", entities_col: str = "entidades") -> DataFrame:
    """Append the choices: best_monto, best_persona, dni, cuil, best_cuenta, alias. Entities are deduplicated first."""
    text = F.col(text_col)
    df = df.withColumn(entities_col, drop_partial_persons(order_and_dedupe(F.col(entities_col))))
    ents = F.col(entities_col)
    kind = lambda *names: F.filter(ents, lambda e: e["tipo"].isin(*names))
    df = df.withColumns({"best_monto": best_amount(ents, text), "best_persona": best_person(ents, text)})
    return df.withColumns(
        {
            "best_dni": nearest(F.col("best_persona"), kind("DNI"), 500),
            "best_cuil": nearest(F.col("best_persona"), kind("CUIT_CUIL"), 550),
            "best_cuenta": _first_best(kind("CBU", "CVU"), account_score),
            "best_alias": F.get(kind("ALIAS"), F.lit(0))["valor_normalizado"],
        }
    )


# The same choices on the entities of one text, as places in the list --------------------------------

CHOICE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("_monto", "_persona", "_dni", "_cuil", "_cuenta", "_alias")] + [T.StructField(n, T.DoubleType()) for n in ("_monto_score", "_persona_score")])


def _holds(text: str, words: list[str]) -> bool:
    return any(w in text for w in words)


def _n(text: str, words: list[str]) -> int:
    return sum(w in text for w in words)


def _amount_points(e: dict, text: str, orders: int) -> float:
    begin, end = e["span_inicio"], e["span_fin"]
    left = text[max(begin - 250, 0) : begin].lower()
    around, before, after = left + " " + text[end : end + 180].lower(), text[max(begin - 100, 0) : begin].lower(), text[end : end + 120].lower()
    return (
        (2.0 if "$" in e["valor"] else 0.0)
        + 5.0 * _n(around, P.AMOUNT_STRONG)
        + 3.0 * _n(around, P.AMOUNT_MEDIUM)
        + (-8.0 if _holds(before, P.AMOUNT_EXTRA_BEFORE) else 0.0)
        + (-6.0 if _holds(after, P.AMOUNT_COSTS_AFTER) else 0.0)
        + (-4.0 if _holds(around, P.AMOUNT_FALSE_CONTEXT) else 0.0)
        + (4.0 if 0 <= orders and begin < orders else 0.0)
        + (-1.0 if 0 <= orders < begin else 0.0)
        + (1.0 if e["texto_monto"] else 0.0)
        + (1.0 if (e["monto_normalizado"] or 0.0) > 0 else 0.0)
    )


def _person_points(e: dict, text: str) -> float:
    begin, end = e["span_inicio"], e["span_fin"]
    broken, rest = text.rfind("\n", 0, begin), text.find("\n", end)
    line_begin = broken + 1 if broken >= 0 else max(begin - 200, 0)
    line = text[line_begin : rest if rest >= 0 else min(len(text), end + 200)].lower()
    versus = line.find("c/") if "c/" in line else line.find(" c ")
    place = begin - line_begin
    before, after = text[max(begin - 120, 0) : begin].lower(), text[end : end + 160].lower()
    near, medium, wide = before + " " + after, text[max(begin - 260, 0) : begin].lower() + " " + text[end : end + 260].lower(), text[max(begin - 500, 0) : begin].lower()
    value = (e["valor"] or "").lower()
    system = "usuari" in wide and "conectado" in wide
    return (
        (e["confianza"] or 0.0)
        + (-20.0 if _holds(value, P.ROLE_IN_VALUE) else 0.0)
        + (-20.0 if _holds(near, P.AUTHORITY_NEAR) else 0.0)
        + (-10.0 if system and not _holds(near, P.ID_NEAR) else 0.0)
        + (-6.0 if _holds(before[-45:], P.TITLES_NEAR) else 0.0)
        + (-6.0 if value.startswith(("dr.", "dra.")) else 0.0)
        + (-8.0 if 0 <= versus and place < versus else 0.0)
        + (4.0 if 0 <= versus < place else 0.0)
        + 5.0 * _n(near, P.DEBTOR_NEAR)
        + (7.0 if _holds(near, P.ID_TOKENS) else 0.0)
        + (5.0 if _holds(after[:110], P.ID_TOKENS) else 0.0)
        + (4.0 if _holds(after[:90], P.ID_SHORT) else 0.0)
        + 1.5 * _n(medium, P.EMBARGO_MEDIUM)
        - 3.0 * _n(near, P.THIRD_PARTY_NEAR)
    )


def choices(text: str, entities: list[dict]) -> tuple:
    """The ``CHOICE`` among entities in order."""
    kind = lambda *names: [(i, e) for i, e in enumerate(entities) if e["tipo"] in names]
    orders = text.lower().find(P.QUOTED_ORDERS)
    amount = max(((_amount_points(e, text, orders), -e["span_inicio"], -i) for i, e in kind("MONTO")), default=None)
    person = max(((_person_points(e, text), e["confianza"] or 0.0, -i) for i, e in kind("persona")), default=None)
    account = max(((2.0 * _n((e["contexto"] or "").lower(), P.ACCOUNT_NEAR), -i) for i, e in kind("CBU", "CVU")), default=None)
    alias = next((i for i, _ in kind("ALIAS")), None)

    def near(name: str, most: int) -> int | None:
        if person is None:
            return None
        p = entities[-person[2]]
        gap, i = min(((max(e["span_inicio"] - p["span_fin"], p["span_inicio"] - e["span_fin"], 0), i) for i, e in kind(name)), default=(most + 1, None))
        return i if gap <= most else None

    last = lambda best: None if best is None else -best[-1]
    first = lambda best: None if best is None else best[0]
    return last(amount), last(person), near("DNI", 500), near("CUIT_CUIL", 550), last(account), alias, first(amount), first(person)


def resolved(df: DataFrame, text_col: str = "texto", model=None) -> DataFrame:
    """As ``resolve`` of ``with_entities``."""
    df = with_entities(df, text_col, model=model, in_order=True, choose=choices, chosen=CHOICE)
    at = lambda name: F.get("entidades", F.col(name))
    scored = lambda name, score: F.when(F.col(name).isNotNull(), at(name).withField(score, F.col(f"{name}_score")))
    sure = F.round(F.greatest(F.lit(0.35), F.least(F.lit(0.98), 0.55 + F.col("_monto_score") * 0.035)), 2)
    best = {
        "best_monto": scored("_monto", "score_contextual").withField("confianza", sure),
        "best_persona": scored("_persona", "score_rol_embargado"),
        "best_dni": at("_dni"),
        "best_cuil": at("_cuil"),
        "best_cuenta": at("_cuenta"),
        "best_alias": at("_alias")["valor_normalizado"],
    }
    return df.withColumns(best).drop(*CHOICE.names)


def reasons() -> Column:
    """Why a document needs manual review, in order."""
    person, amount = F.col("best_persona"), F.col("best_monto")
    none = F.lit(None).cast("string")
    why = F.array(
        F.when(person.isNull() | (F.coalesce(person["valor"], F.lit("")) == ""), P.REASONS["person"]).otherwise(none),
        F.when(person["score_rol_embargado"] < 5, P.REASONS["person_score"]).otherwise(none),
        F.when(F.col("best_dni").isNull() & F.col("best_cuil").isNull(), P.REASONS["id"]).otherwise(none),
        F.when(amount.isNull(), P.REASONS["amount"]).otherwise(none),
        F.when(F.col("best_cuenta").isNull() & F.col("best_alias").isNull(), P.REASONS["account"]).otherwise(none),
        F.when(amount["confianza"] < 0.65, P.REASONS["amount_confidence"]).otherwise(none),
    )
    return F.filter(why, lambda r: r.isNotNull())


def _of_kind(value: Column, wanted: str) -> Column:
    return F.when(F.col("best_cuenta")["tipo"] == wanted, value)


def assemble(df: DataFrame, id_col: str = "id", name_col: str = "nombre", kind_col: str = "clasificacion", text_col: str = "texto") -> DataFrame:
    """The nested document per row; needs the columns that ``resolve`` appends."""
    p, m, a, ents = F.col("best_persona"), F.col("best_monto"), F.col("best_cuenta"), F.col("entidades")
    has = lambda c, word: F.when(c.isNotNull(), word)
    person = F.struct(
        p["valor"].alias("nombre"),
        F.col("best_dni")["valor_normalizado"].alias("dni"),
        F.col("best_cuil")["valor_normalizado"].alias("cuil_cuit"),
        # The label says model even where the person came from a pattern.
        F.struct(has(p, "gliner_fastino").alias("nombre"), has(F.col("best_dni"), "regex").alias("dni"), has(F.col("best_cuil"), "regex").alias("cuil_cuit")).alias("metodo"),
        p["confianza"].alias("confianza"),
        p["score_rol_embargado"].alias("score_rol_embargado"),
        p["contexto"].alias("contexto"),
    )
    amount = F.struct(
        m["valor"].alias("valor_raw"),
        m["monto_normalizado"].alias("valor_normalizado"),
        F.lit("ARS").alias("moneda"),
        m["texto_monto"].alias("texto_monto"),
        m["contexto"].alias("contexto"),
        F.lit("regex_contextual").alias("metodo"),
        m["confianza"].alias("confianza"),
        m["score_contextual"].alias("score_contextual"),
    )
    account = F.struct(
        _of_kind(a["valor_normalizado"], "CBU").alias("cbu"),
        _of_kind(a["valor_normalizado"], "CVU").alias("cvu"),
        F.col("best_alias").alias("alias"),
        F.when(a.isNotNull(), bank_in(a["contexto"])).alias("banco"),
        F.lit(None).cast("string").alias("titular"),
        F.lit("regex").alias("metodo"),
        a["confianza"].alias("confianza"),
        a["contexto"].alias("contexto"),
    )
    kinds = F.array_distinct(F.transform(ents, lambda e: e["tipo"]))
    per_kind = F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, F.size(F.filter(ents, lambda e: e["tipo"] == k)))))
    # Columns of their own: read many times further on, worked out once.
    df = df.withColumns({"_por_tipo": per_kind, "_motivos": reasons()})
    why = F.col("_motivos")
    return df.select(
        F.col(id_col).cast("string").alias("id"),
        F.col(name_col).alias("nombre_archivo"),
        F.col(kind_col).alias("clasificacion"),
        F.col(text_col).alias("texto_limpio"),
        person.alias("persona_embargada"),
        amount.alias("monto"),
        account.alias("cuenta_deposito"),
        F.size(ents).alias("cantidad_entidades_encontradas"),
        F.struct(F.size(ents).alias("total"), F.col("_por_tipo").alias("por_tipo")).alias("estadisticas_entidades"),
        ents.alias("entidades"),
        (F.size(why) > 0).alias("revision_manual"),
        why.alias("motivos_revision"),
    )


def process(df: DataFrame, text_col: str = "texto", model=None, **columns: str) -> DataFrame:
    """Texts to nested documents: extraction, deduplication, choices, review reasons. One narrow stage."""
    return assemble(resolved(df, text_col, model), text_col=text_col, **columns)


def summary(documents: DataFrame) -> DataFrame:
    """One flat row per nested document."""
    count = lambda kind: F.coalesce(F.col("estadisticas_entidades.por_tipo")[kind], F.lit(0))
    renamed = {
        "persona_nombre": "persona_embargada.nombre", "persona_dni": "persona_embargada.dni", "persona_cuil_cuit": "persona_embargada.cuil_cuit",
        "persona_confianza": "persona_embargada.confianza", "monto_valor_raw": "monto.valor_raw", "monto_valor_normalizado": "monto.valor_normalizado",
        "monto_moneda": "monto.moneda", "monto_confianza": "monto.confianza", "monto_score_contextual": "monto.score_contextual",
        "cuenta_cbu": "cuenta_deposito.cbu", "cuenta_cvu": "cuenta_deposito.cvu", "cuenta_alias": "cuenta_deposito.alias",
        "cuenta_banco": "cuenta_deposito.banco", "cuenta_confianza": "cuenta_deposito.confianza",
    }
    counts = {"cant_personas": "persona", "cant_dni": "DNI", "cant_cuit_cuil": "CUIT_CUIL", "cant_cbu": "CBU", "cant_cvu": "CVU", "cant_alias": "ALIAS", "cant_montos": "MONTO"}
    return documents.select(
        "id", "nombre_archivo", "clasificacion",
        *[F.col(path).alias(name) for name, path in renamed.items()],
        "cantidad_entidades_encontradas",
        *[count(kind).alias(name) for name, kind in counts.items()],
        "revision_manual",
        F.array_join("motivos_revision", " | ").alias("motivos_revision"),
    )


def review_rows(documents: DataFrame) -> DataFrame:
    """One row per entity, numbered from 1, with the columns a reviewer fills in."""
    rows = documents.select("id", "nombre_archivo", F.col("monto.score_contextual").alias("_m"), F.posexplode("entidades").alias("_n", "e"))
    value = F.coalesce(F.col("e.valor_normalizado"), F.col("e.monto_normalizado").cast("string"))
    return rows.select(
        F.col("id").alias("grupo_revision"), "id", "nombre_archivo", (F.col("_n") + 1).alias("entidad_n"),
        F.col("e.tipo").alias("tipo_entidad"), "e.valor", value.alias("valor_normalizado"), "e.metodo", "e.confianza",
        "e.span_inicio", "e.span_fin", "e.contexto",
        F.lit(P.REVIEW_STATES[0]).alias("estado_revision"), F.lit("").alias("valor_corregido"), F.lit("").alias("observaciones"),
    )
