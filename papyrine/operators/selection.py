"""Advanced cleaning with loss checks, and ranking of documents for the next stage."""
from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions import metrics as M
from papyrine.functions import patterns as P
from papyrine.functions import plain
from papyrine.functions.predicates import to_bool
from papyrine.functions.text import ICASE, clean_columns, preview, text_of


def bind(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """As ``withColumns``, but worked out once a row: a generator of one row that the optimiser does not look into.

    Otherwise it may copy a long chain of expressions into every place that reads the column.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def clean_and_check(df: DataFrame, text_col: str) -> DataFrame:
    """Append the cleaned text, what was removed, the metrics after cleaning, and loss alerts per kind of data."""
    df = bind(df, {"texto_base": text_of(F.col(text_col))})
    # Plain texts are worked out in one go; the columns are for the others.
    df = df.withColumn("_plain", plain.check_of(F.col("texto_base")))
    known = F.col("_plain")
    or_else = lambda name, slow: F.coalesce(known[name], slow)
    df = bind(df, {"texto_limpieza_avanzada": or_else("texto", clean_columns(F.col("texto_base")))})
    before, after = F.col("texto_base"), F.col("texto_limpieza_avanzada")
    df = df.withColumns({"len_antes": F.length(before), "len_despues": F.length(after), "palabras_antes": or_else("palabras_antes", M.word_count(before)), "palabras_despues": or_else("palabras_despues", M.word_count(after))})
    df = df.withColumns(
        {
            "chars_eliminados": F.col("len_antes") - F.col("len_despues"),
            "porcentaje_reduccion": M.reduction(F.col("len_antes"), F.col("len_despues")),
            "porcentaje_reduccion_palabras": M.reduction(F.col("palabras_antes"), F.col("palabras_despues")),
        }
    )
    # What the metrics count tells what is there, so each pattern runs over the cleaned text once.
    df = bind(df, {f"_n_{k}": or_else(f"n_{k}", c) for k, c in M.important_counts(after).items()} | {k: or_else(k, c) for k, c in M.has_important(before, "antes_").items()})
    df = M.measure(df, "texto_limpieza_avanzada", sum((F.col(f"_n_{k}") for k in P.IMPORTANT), F.lit(0)), known)
    df = df.withColumns({f"despues_{k}": F.col(f"_n_{k}") > 0 for k in P.IMPORTANT}).drop("_plain", *[f"_n_{k}" for k in P.IMPORTANT])
    df = bind(df, {c: F.col(c) for c in ("ocr_quality_score", "ocr_estado", "palabras_antes", "palabras_despues")})
    df = df.withColumns({f"alerta_desaparece_{k}": F.col(f"antes_{k}") & ~F.col(f"despues_{k}") for k in P.IMPORTANT})
    return df.withColumns(
        {
            "alerta_reduccion_alta": F.col("porcentaje_reduccion") > 0.35,
            "alerta_texto_muy_corto": F.col("palabras_despues") < 80,
            "alerta_posible_perdida_datos": reduce(or_, map(F.col, P.LOSS_ALERTS)),
        }
    )


def alert_report(checked: DataFrame) -> DataFrame:
    """Eight alert counts, one row each."""
    flags = {f"desaparece_posible_{k}": F.col(f"alerta_desaparece_{k}") for k in ("dni", "cuil_cuit", "cbu_cvu", "monto", "expediente")}
    flags |= {"reduccion_texto_mayor_35": F.col("alerta_reduccion_alta"), "reduccion_palabras_mayor_35": F.col("porcentaje_reduccion_palabras") > 0.35, "alerta_posible_perdida_datos_total": F.col("alerta_posible_perdida_datos")}
    rows = [F.struct(F.lit(name).alias("metrica"), F.count_if(test).alias("cantidad")) for name, test in flags.items()]
    return checked.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def final_report(checked: DataFrame) -> DataFrame:
    """One row: documents per state, mean reduction in percent, alerts."""
    state = lambda s: F.count_if(F.col("ocr_estado") == s)
    return checked.agg(
        F.count(F.lit(1)).alias("total_embargos_procesados"),
        state("legible").alias("textos_legibles"),
        state("regular").alias("textos_regulares"),
        state("muy_ruidoso").alias("textos_muy_ruidosos"),
        state("irrecuperable").alias("textos_irrecuperables"),
        (F.avg("porcentaje_reduccion") * 100).alias("porcentaje_promedio_reduccion_texto"),
        F.count_if("alerta_reduccion_alta").alias("alertas_reduccion_alta"),
        F.count_if("alerta_posible_perdida_datos").alias("alertas_posible_perdida_datos"),
    )


def _lead(df: DataFrame, kind: Column, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of every kind (null: none): each task cuts its own before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("_kind").orderBy(*order))
    return df.withColumn("_kind", kind).filter("_kind is not null").withColumn("_r", rank).filter(F.col("_r") <= most).drop("_r")


def top_for_model(checked: DataFrame, id_col: str = "id", most: int = 15) -> DataFrame:
    """The best documents for the entity model; regular ones join in where too few are legible.

    One pass: the best legible and the best regular ones are picked side by side, and the few that are left decide.
    """
    known = all(f"despues_{k}" in checked.columns for k in P.IMPORTANT)
    df = checked.withColumns({f"tiene_{k}": F.col(f"despues_{k}") for k in P.IMPORTANT} if known else M.has_important(F.col("texto_limpieza_avanzada"), "tiene_"))
    df = df.withColumn("cantidad_indicadores_importantes", sum((F.col(f"tiene_{k}").cast("int") for k in P.IMPORTANT), F.lit(0)))
    df = bind(df, {"cantidad_indicadores_importantes": F.col("cantidad_indicadores_importantes"), "score_seleccion_gliner": M.selection_score()})
    fine = (F.col("palabras_despues") >= 120) & (F.col("porcentaje_reduccion") <= 0.35) & ~F.col("alerta_posible_perdida_datos")
    keys = [*(F.desc(c) for c in ("score_seleccion_gliner", "ocr_quality_score", "cantidad_indicadores_importantes", "palabras_despues")), F.col(id_col)]
    lead = _lead(df, F.when(fine & F.col("ocr_estado").isin("legible", "regular"), F.col("ocr_estado")), keys, most)
    strict = F.count_if(F.col("_kind") == "legible").over(Window.partitionBy(F.lit(0)))  # over 2 x most rows
    pool = lead.withColumn("_n", strict).filter((F.col("_kind") == "legible") | (F.col("_n") < most)).drop("_n", "_kind")
    return pool.orderBy(*keys).limit(most).withColumn("texto_limpio_avanzado_preview_500", preview(F.col("texto_limpieza_avanzada")))


def detect_patterns(df: DataFrame, text_col: str) -> DataFrame:
    text = text_of(F.col(text_col))
    found = {name: text.rlike(ICASE + "(?:" + p + ")") for name, p in P.SELECTION.items()}
    words = r"\b(?:" + "|".join(P.EMBARGO_KEYWORDS) + r")\b"
    return df.withColumns({**found, "tiene_palabras_clave_embargo": text.rlike(ICASE + words)})


def _number(df: DataFrame, name: str):
    """A column as a number; what is none counts 0."""
    return F.coalesce(F.col(name).try_cast("double"), F.lit(0.0))


def _ranked(df: DataFrame, text_col: str) -> tuple[DataFrame, Column | None]:
    """``df`` with the score for either scale of porcentaje_reduccion (_as_shares, _as_percents), and that column."""
    df, has = detect_patterns(df, text_col), set(df.columns)
    size_col = next((c for c in ("largo_limpio", "len_despues") if c in has), None)
    size = _number(df, size_col) if size_col else F.length(text_of(F.col(text_col))).cast("double")
    df = df.withColumn("_texto_len_ranking", size)
    score = F.lit(0.0)
    if "ocr_quality_score" in has:
        score += _number(df, "ocr_quality_score")
    if "ocr_estado" in has:
        state = F.lower(F.coalesce(F.col("ocr_estado"), F.lit("")))
        score += F.when(state == "legible", 25.0).when(state == "muy_ruidoso", -50.0).when(state == "irrecuperable", -90.0).otherwise(0.0)
    long = F.col("_texto_len_ranking")
    score += F.least(long, F.lit(6000.0)) / 6000 * 30
    score -= F.when(long < 500, 35.0).otherwise(0.0) + F.when(long < 200, 65.0).otherwise(0.0)
    raw = _number(df, "porcentaje_reduccion") if "porcentaje_reduccion" in has else None

    def cut_points(share: Column) -> Column:
        cut = F.greatest(share, F.lit(0.0))
        return -0.25 * F.least(cut, F.lit(100.0)) - F.when(cut > 60, 20.0).otherwise(0.0) + F.when(cut <= 35, 8.0).otherwise(0.0)

    points = [*((c, -30.0) for c in P.SEVERE_ALERTS), *((c, -12.0) for c in P.LOSS_ALERTS), *((c, 9.0) for c in P.SELECTION), ("tiene_palabras_clave_embargo", 12.0)]
    rest = F.lit(0.0)
    for name, worth in points:
        if name in df.columns:
            flag = F.col(name) if dict(df.dtypes)[name] == "boolean" else to_bool(F.col(name))
            rest += F.when(F.coalesce(flag, F.lit(False)), worth).otherwise(0.0)
    if "important_data_count" in has:
        rest += 2 * F.least(_number(df, "important_data_count"), F.lit(10.0))
    if "legal_terms_count" in has:
        rest += F.least(_number(df, "legal_terms_count"), F.lit(10.0))
    whole = lambda share: F.round(score + cut_points(share) + rest, 4)
    zero = F.lit(0.0)
    both = {"_as_shares": whole(raw * 100 if raw is not None else zero), "_as_percents": whole(raw if raw is not None else zero)}
    return bind(df, both | {"_raw": raw if raw is not None else zero, "_texto_len_ranking": long}), raw


def ranking(df: DataFrame, text_col: str) -> DataFrame:
    """Append the selection patterns, ``ranking_80_score`` and the length it used. Absent columns count nothing.

    Whether porcentaje_reduccion holds shares or percents is one decision for the whole table.
    """
    ranked, _ = _ranked(df, text_col)
    scale = ranked.agg((F.max("_raw") <= 1).alias("_shares"))
    ranked = ranked.join(F.broadcast(scale)).withColumn("ranking_80_score", F.when(F.col("_shares"), F.col("_as_shares")).otherwise(F.col("_as_percents")))
    return ranked.drop("_shares", "_as_shares", "_as_percents", "_raw")


def select_top(df: DataFrame, text_col: str, id_col: str = "id", most: int = 80) -> DataFrame:
    """The best documents by ranking among the usable ones; among all where fewer than ``most`` are usable.

    One pass: the best of either scale, usable or not, are picked side by side with a row, if there is one,
    that shows the column to hold percents; the few rows that are left decide.
    """
    ranked, _ = _ranked(df, text_col)
    usable = F.col("_texto_len_ranking") >= 300
    if "ocr_estado" in df.columns:
        usable &= ~F.lower(F.coalesce(F.col("ocr_estado"), F.lit(""))).isin("irrecuperable", "muy_ruidoso")
    if "alerta_texto_muy_corto" in df.columns:
        usable &= ~F.coalesce(F.col("alerta_texto_muy_corto"), F.lit(False))
    entry = lambda scale, score: F.struct(F.lit(scale).alias("_scale"), score.alias("ranking_80_score"))
    entries = F.array(entry("shares", F.col("_as_shares")), entry("percents", F.col("_as_percents")), entry("witness", F.lit(0.0)))
    several = ranked.withColumn("_usable", usable).select("*", F.inline(entries)).filter("_scale <> 'witness' or _raw > 1")
    keys = [F.desc(c) for c in ["ranking_80_score", *(["ocr_quality_score"] if "ocr_quality_score" in df.columns else []), "_texto_len_ranking"]] + [F.col(id_col)]
    lead = _lead(several, F.concat_ws(" ", "_scale", F.col("_usable").cast("string")), keys, most)
    few = Window.partitionBy(F.lit(0))  # over 6 x most rows
    lead = lead.withColumn("_scales", F.when(F.count_if(F.col("_scale") == "witness").over(few) > 0, "percents").otherwise("shares")).filter("_scale = _scales")
    lead = lead.withColumn("_n", F.count_if("_usable").over(few)).filter(F.col("_usable") | (F.col("_n") < most))
    return lead.orderBy(*keys).limit(most).drop("_n", "_scales", "_scale", "_kind", "_usable", "_raw", "_as_shares", "_as_percents", "_texto_len_ranking")


def stratified_sample(df: DataFrame, by: str, id_col: str, per_class: int, seed: int = 42) -> DataFrame:
    """At most ``per_class`` rows of each class by a seeded hash of the id: the same rows on every run.

    The ranked filter is cut per task before the shuffle, so a large class does not gather.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order, id_col)))
    return ranked.filter(F.col("_n") <= per_class).drop("_n")


def extremes(df: DataFrame, column: str, id_col: str, most: int, largest: bool = True) -> DataFrame:
    return df.orderBy(F.desc(column) if largest else F.asc(column), id_col).limit(most)


def short_middle_long(df: DataFrame, column: str, id_col: str) -> DataFrame:
    """The rows of least, most and closest-to-median value, ties to the smaller id."""
    median = df.agg(F.percentile(column, F.lit(0.5)).alias("_m"))
    gap = F.struct(F.abs(F.col(column) - F.col("_m")), F.col(id_col))
    picks = df.join(F.broadcast(median)).agg(
        F.min_by(F.struct(id_col, column), F.struct(F.col(column), F.col(id_col))).alias("corto"),
        F.min_by(F.struct(id_col, column), gap).alias("medio"),
        F.max_by(F.struct(id_col, column), F.struct(F.col(column), -F.col(id_col))).alias("largo"),
    )
    kinds = F.array(*[F.struct(F.lit(k).alias("caso"), F.col(k)[id_col].alias(id_col), F.col(k)[column].alias(column)) for k in ("corto", "medio", "largo")])
    return picks.select(F.inline(kinds))


def by_ids(df: DataFrame, ids: list, id_col: str = "id") -> DataFrame:
    """Rows whose id, as text, is one of a short list."""
    return df.filter(F.col(id_col).cast("string").isin([str(i) for i in ids]))
