"""Aggregates and joins over entity tables: counts, labels, model comparison, review queues."""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.functions import patterns as P
from papyrine.functions import plain
from papyrine.functions.predicates import contains_any, needs_review, not_sentinel, valid_format
from papyrine.functions.text import ICASE, text_of
from papyrine.operators.extract import dedupe_first
from papyrine.operators.models import Model, predict_all, predict_chunks_all


def score_stats(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("cantidad"), F.avg(score).alias("score_promedio"), F.min(score).alias("score_minimo"), F.max(score).alias("score_maximo"))


def document_labels(entities: DataFrame, id_col: str = "id", label_col: str = "etiqueta") -> DataFrame:
    """Per document: how many entities, and the distinct labels, sorted and joined."""
    labels = F.array_join(F.sort_array(F.collect_set(label_col)), ", ")  # a closed set of labels
    return entities.groupBy(id_col).agg(F.count(F.lit(1)).alias("total_entidades"), labels.alias("etiquetas_encontradas"))


def label_pivot(entities: DataFrame, labels: list[str], id_col: str = "id", label_col: str = "etiqueta") -> DataFrame:
    """Per document one count column per label, blank where there is none."""
    wide = entities.groupBy(id_col).pivot(label_col, labels).count()
    return wide.select(id_col, *[F.col(f"`{x}`").alias(f"entidades_{x}") for x in labels])


def validated(entities: DataFrame, label_col: str = "entidad_label", text_col: str = "entidad_texto", noise_col: str = "posible_ruido_ocr") -> DataFrame:
    """Append formato_valido_label and requiere_revision_manual; an absent noise column counts as no noise."""
    noisy = F.col(noise_col) if noise_col in entities.columns else None
    df = entities.withColumn("formato_valido_label", valid_format(F.col(label_col), F.col(text_col)))
    return df.withColumn("requiere_revision_manual", needs_review(F.col(label_col), F.col(text_col), F.col("score"), F.col("formato_valido_label"), noisy))


def model_comparison(checked: DataFrame, by: tuple[str, ...] = ("modelo", "labels_set", "threshold", "estrategia")) -> DataFrame:
    rows = checked.filter(not_sentinel(F.col("entidad_label")))
    return rows.groupBy(*by).agg(
        F.count("entidad_texto").alias("total_entidades"),
        F.count_distinct("id").alias("documentos_cubiertos"),
        F.avg("score").alias("score_promedio"),
        F.min("score").alias("score_minimo"),
        F.max("score").alias("score_maximo"),
        F.count_if("formato_valido_label").alias("entidades_formato_valido"),
        F.count_if(~F.col("formato_valido_label")).alias("entidades_formato_invalido"),
        F.count_if("requiere_revision_manual").alias("entidades_requieren_revision"),
        F.count_if(~F.col("requiere_revision_manual")).alias("entidades_confiables"),
    )


def review_summary(checked: DataFrame) -> DataFrame:
    keys = ["entidad_label", "formato_valido_label", "requiere_revision_manual"]
    rows = checked.filter(not_sentinel(F.col("entidad_label"))).groupBy(*keys).agg(F.count(F.lit(1)).alias("cantidad"))
    return rows.orderBy("entidad_label", F.desc("requiere_revision_manual"), F.desc("cantidad"))


def review_template(checked: DataFrame, id_col: str = "id") -> DataFrame:
    """Entities for a reviewer, those that need it first, with four blank columns."""
    blank = {c: F.lit("") for c in ("correcto_manual", "label_correcto_manual", "valor_correcto_manual", "observaciones")}
    rows = checked.filter(not_sentinel(F.col("entidad_label"))).withColumns(blank)
    # A sort of the whole table reads its rows twice, first for the bounds of its ranges: dealt out, they are made once.
    return rows.repartition(id_col).orderBy(F.desc("requiere_revision_manual"), "entidad_label", "score")


def split_trusted(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = checked.filter(not_sentinel(F.col("entidad_label")))
    return rows.filter(~F.col("requiere_revision_manual")), rows.filter("requiere_revision_manual")


def trusted_counts(checked: DataFrame) -> DataFrame:
    """How many rows either part of ``split_trusted`` has, in one pass."""
    rows, again = checked.filter(not_sentinel(F.col("entidad_label"))), F.col("requiere_revision_manual")
    sizes = [F.struct(F.lit(name).alias("cola"), F.count_if(test).alias("cantidad")) for name, test in (("confiables", ~again), ("revisar", again))]
    return rows.agg(F.array(*sizes).alias("r")).select(F.inline("r"))


def audit_flags(df: DataFrame, text_col: str) -> DataFrame:
    text, kept = text_of(F.col(text_col)), [c for c in df.columns if c not in (f"regex_tiene_{k}" for k in P.AUDIT)]
    df = df.withColumn("_plain", plain.audit_of(text))
    return df.select(*kept, *[F.coalesce(F.col("_plain")[k], text.rlike(ICASE + "(?:" + p + ")")).alias(f"regex_tiene_{k}") for k, p in P.AUDIT.items()])


def pattern_against_model(docs: DataFrame, entities: DataFrame, text_col: str, id_col: str = "id", label_col: str = "entidad_label") -> DataFrame:
    """Per document and family: does the pattern match, and did the model find a label of the family."""
    low = F.lower(F.coalesce(F.col(label_col), F.lit("")))
    found = entities.filter(not_sentinel(F.col(label_col))).groupBy(id_col).agg(*[F.bool_or(contains_any(low, words)).alias(f"gliner_detecto_{k}") for k, words in P.LABEL_FAMILIES.items()])
    joined = audit_flags(docs, text_col).join(found, id_col, "left")
    return joined.na.fill(False, [f"gliner_detecto_{k}" for k in P.LABEL_FAMILIES])


def without_entities(docs: DataFrame, entities: DataFrame, id_col: str = "id") -> DataFrame:
    return docs.join(entities.select(id_col).distinct(), id_col, "left_anti")


def nested_documents(docs: DataFrame, entities: DataFrame, id_col: str = "id") -> DataFrame:
    """Documents with their entities as an array, empty where there is none."""
    lists = entities.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("etiqueta", "texto"))).alias("entidades"))  # one document's entities
    none = F.array().cast("array<struct<etiqueta:string,texto:string>>")
    df = docs.join(lists, id_col, "left").withColumn("entidades", F.coalesce("entidades", none))
    labels = F.sort_array(F.array_distinct(F.transform("entidades", lambda e: e["etiqueta"])))
    return df.withColumns({"total_entidades": F.size("entidades"), "etiquetas_encontradas": labels})


def any_flag(columns: list[str]):
    return reduce(or_, map(F.col, columns))


STRATEGIES = ("directo", "chunks")


def run_grid(docs: DataFrame, text_col: str, models: dict[str, Callable[[], Model]], label_sets: dict[str, list[str]], thresholds: list[float], strategies: tuple[str, ...] = STRATEGIES, id_col: str = "id", size: int = 300, overlap: int = 50) -> DataFrame:
    """Predictions of every model under every set of labels, threshold and strategy, one row each.

    A model and a strategy are one narrow stage, which cuts a text once for all labels and thresholds; repeats that
    overlapping chunks find twice are removed, the first staying.
    """
    if unknown := set(strategies) - set(STRATEGIES):
        raise ValueError(f"unknown strategies: {sorted(unknown)}")
    out, grid = None, list(product(label_sets, thresholds))
    settings = [(label_sets[labels], threshold) for labels, threshold in grid]
    told = F.array(*[F.struct(F.lit(labels).alias("labels_set"), F.lit(float(threshold)).alias("threshold")) for labels, threshold in grid])
    for model, strategy in product(models, strategies):
        if strategy == "directo":
            found = predict_all(docs, text_col, models[model], settings).withColumn("chunk_id", F.lit(0))
        else:
            found = predict_chunks_all(docs, text_col, models[model], settings, id_col, size, overlap)
        setting = F.get(told, F.col("_setting"))
        found = found.select(
            id_col, "chunk_id", "entidad_label", "entidad_texto", "score", "start", "end", "error", "texto_contexto",
            F.lit(model).alias("modelo"), setting["labels_set"].alias("labels_set"), setting["threshold"].alias("threshold"), F.lit(strategy).alias("estrategia"),
        )
        out = found if out is None else out.unionByName(found)
    keys = [id_col, "modelo", "labels_set", "threshold", "estrategia", "entidad_label", "entidad_texto"]
    return dedupe_first(out, keys, ["chunk_id", "start"])
