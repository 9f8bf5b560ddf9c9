"""Predicates and classifiers over text columns."""
from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.functions import patterns as P
from papyrine.functions.text import ICASE, digits_only, person_name, squeeze, strip, text_of


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(or_, (text.contains(w) for w in words), F.lit(False))


def looks_like_html(c: Column, long_list: bool = False) -> Column:
    return contains_any(F.lower(text_of(c)), P.HTML_LONG if long_list else P.HTML_SHORT)


def html_traces(c: Column) -> Column:
    low = F.lower(text_of(c))
    return F.filter(F.array(*map(F.lit, P.HTML_LONG)), lambda p: low.contains(p))


def ocr_state(c: Column) -> Column:
    text = strip(c)
    return (
        F.when(c.isNull(), "nulo")
        .when(text == "", "vacio")
        .when(text == "\\n", "solo_salto_linea")
        .when(text.contains(P.DOWNLOAD_ERROR), "error_descarga_bucket")
        .when(F.length(text) < P.SHORT_TEXT, "texto_muy_corto")
        .otherwise("ok")
    )


def document_type(c: Column) -> Column:
    low = F.lower(c)
    return (
        F.when(c.isNull(), "desconocido")
        .when(contains_any(low, ["embargo", "embargar"]), "embargo")
        .when(contains_any(low, ["oficio", "solicito informe", "informe si"]), "oficio")
        .otherwise("desconocido")
    )


def is_target(state: Column, kind: Column, kinds: tuple[str, ...] = ("Oficio", "Embargo")) -> Column:
    return (state == "ok") & kind.isin(*kinds)


def to_bool(c: Column) -> Column:
    """Truth of a string column: true, 1, si, sí, yes; numbers other than 0."""
    low = F.lower(strip(c.cast("string")))
    number = F.coalesce(low.try_cast("double") != 0, F.lit(False))
    return F.coalesce(low.isin("true", "1", "si", "sí", "yes") | number, F.lit(False))


def valid_person(c: Column) -> Column:
    """A name after clean-up: long enough, letters, no digits, nothing that is no person."""
    name = person_name(c)
    bad = name.rlike(ICASE + "(?:" + "|".join(P.NAME_BAD_PATTERNS) + ")")
    return c.isNotNull() & (F.length(name) >= 5) & ~bad & name.rlike("[A-Za-zÁÉÍÓÚáéíóúÑñ]") & ~name.rlike(r"(?U)\d")


def valid_candidate(c: Column) -> Column:
    text = squeeze(c)
    digits, letters = F.regexp_count(text, F.lit(r"\p{Nd}")), F.regexp_count(text, F.lit(r"\p{L}"))
    return (F.length(text) >= 5) & (letters >= 3) & (digits <= letters) & ~contains_any(F.lower(text), P.CANDIDATE_BAD_TOKENS)


def valid_format(label: Column, value: Column) -> Column:
    """Whether a value has the format its label asks for; rules in order."""
    low, text, digits = F.lower(strip(label)), strip(value), digits_only(value)
    has = lambda pattern: text.rlike(ICASE + pattern)
    account = has(r"(?:\b(?:CBU|CVU)\b|\d(?:\D?\d){21})")
    bank, mail = has(r"(?:banco|mercado\s*pago|cuenta|alias|transfer)"), has(r"(?:notificaciones|scba|@|gov)")
    return (
        F.when(value.isNull(), False)
        .when(low.isin("persona", "caratula", "banco"), True)
        .when(low.contains("dni"), digits.rlike(r"^\d{7,8}$"))
        .when(contains_any(low, ["cuil", "cuit"]), digits.rlike(r"^(20|23|24|27|30|33|34)\d{9}$"))
        .when(contains_any(low, ["cbu", "cvu"]), digits.rlike(r"^\d{22}$"))
        .when(low.contains("monto"), has(r"\d") & has(r"(?:\$|pesos|importe|monto)"))
        .when(low.contains("expediente"), has(r"\d") & (F.length(text) >= 3))
        .when(low.contains("destino de transferencia"), ~(mail & ~account) & (account | bank))
        .otherwise(True)
    )


def needs_review(label: Column, value: Column, score: Column, valid: Column, noisy: Column | None = None) -> Column:
    """Manual review: no or low score, bad format, noise, a person with a title, a caption under 4 words."""
    low = F.lower(label)
    words = F.size(F.filter(F.split(squeeze(value), " "), lambda w: w != ""))
    return (
        score.isNull()
        | F.coalesce(score < 0.60, F.lit(False))
        | ~F.coalesce(valid, F.lit(True))
        | F.coalesce(noisy if noisy is not None else F.lit(False), F.lit(False))
        | ((low == "persona") & text_of(value).rlike(ICASE + r"(?:\bjuez\b|\bdra?\.?\b|\bsecretario\b)"))
        | ((low == "caratula") & (words < 4))
    )


def not_sentinel(label: Column) -> Column:
    return ~F.coalesce(label.isin(*P.SENTINELS), F.lit(False))
