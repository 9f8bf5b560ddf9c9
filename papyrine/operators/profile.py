"""Profiling of raw tables: nulls, lengths, cardinalities, duplicates, distributions, diagnostics."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.functions import metrics as M
from papyrine.functions import patterns as P
from papyrine.functions.text import strip, text_of


def _long(df: DataFrame, values: dict[str, dict[str, Column]], key_name: str) -> DataFrame:
    """One aggregate over the table, turned to one row per entry: {entry: {column: aggregate}}."""
    structs = [F.struct(F.lit(entry).alias(key_name), *[c.alias(n) for n, c in cols.items()]) for entry, cols in values.items()]
    return df.agg(F.array(*structs).alias("rows")).select(F.inline("rows"))


def null_report(df: DataFrame) -> DataFrame:
    """(columna, nulos, porcentaje) per column, most nulls first."""
    found = {c: {"nulos": F.count_if(F.col(c).isNull()), "porcentaje": F.round(F.try_divide(F.count_if(F.col(c).isNull()) * 100.0, F.count(F.lit(1))), 2)} for c in df.columns}
    return _long(df, found, "columna").orderBy(F.desc("nulos"), "columna")


def text_columns(df: DataFrame, all_types: bool = False) -> DataFrame:
    """Lengths of columns as text, longest mean first; string columns only unless ``all_types``. All-null columns are left out."""
    found = {}
    for f in df.schema.fields:
        if all_types or isinstance(f.dataType, T.StringType):
            size = F.length(F.col(f.name).cast("string"))
            found[f.name] = {"promedio_caracteres": F.avg(size), "max_caracteres": F.max(size), "min_caracteres": F.min(size), "valores_no_nulos": F.count(f.name)}
    if not found:
        return df.sparkSession.createDataFrame([], "columna string, promedio_caracteres double, max_caracteres int, min_caracteres int, valores_no_nulos long")
    return _long(df, found, "columna").filter("valores_no_nulos > 0").orderBy(F.desc("promedio_caracteres"), "columna")


def text_column_stats(df: DataFrame) -> DataFrame:
    """As ``text_columns`` with the exact median, nulls counting as length 0."""
    found = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            size = F.length(text_of(F.col(f.name)))
            found[f.name] = {"no_nulos": F.count(f.name), "largo_promedio": F.avg(size), "largo_mediana": F.percentile(size, F.lit(0.5)), "largo_max": F.max(size)}
    return _long(df, found, "columna")


def find_text_column(df: DataFrame, purpose: str = "selection", by: str = "mean") -> str:
    """The first known text column; else the string column of the longest mean (or median) text."""
    for name in P.TEXT_COLUMNS[purpose]:
        if name in df.columns:
            return name
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strings or purpose == "rich":
        raise ValueError("no text column found")
    size = {"mean": F.avg, "median": lambda c: F.percentile(c, F.lit(0.5))}[by]
    row = df.agg(*[size(F.length(text_of(F.col(c)))).alias(c) for c in strings]).first()
    return max(strings, key=lambda c: row[c] or 0)


def categorical_columns(df: DataFrame, most: int = 30) -> DataFrame:
    """Columns of at most ``most`` distinct values (exact), nested types left out."""
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    found = {c: {"valores_unicos": F.count_distinct(c), "nulos": F.count_if(F.col(c).isNull())} for c in plain}
    return _long(df, found, "columna").filter(F.col("valores_unicos") <= most).orderBy("valores_unicos", "columna")


def value_counts(df: DataFrame, column: str, nulls: bool = True) -> DataFrame:
    rows = df if nulls else df.filter(F.col(column).isNotNull())
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("cantidad")).orderBy(F.desc("cantidad"), column)


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of ``column`` values per ``row``, absent pairs 0; naming the values spares a pass."""
    return df.groupBy(row).pivot(column, values).count().na.fill(0)


def describe(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles, maximum."""
    c = F.col(column).cast("double")
    quarter = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*(by or [])).agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), quarter.alias("q"), F.max(c).alias("max"))
    return out.select(*(by or []), "count", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


def duplicate_counts(df: DataFrame, key_sets: dict[str, list[str]]) -> DataFrame:
    """Rows after the first of equal keys, per key set; null keys are equal."""
    out = None
    for name, keys in key_sets.items():
        part = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicados")).select(F.lit(name).alias("clave"), "duplicados")
        out = part if out is None else out.unionByName(part)
    return out


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of groups of two or more. Groups are counted with a combine, so a common key does not gather its rows."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("repeticiones")).filter("repeticiones > 1")
    named = groups.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "repeticiones")
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = df.join(named, on)
    return joined.drop(*[f"_k{i}" for i in range(len(keys))])


def diagnostic_report(df: DataFrame, text_col: str) -> DataFrame:
    """Nine metrics of a text column, one row each."""
    text = text_of(F.col(text_col))
    size, one = F.length(text), lambda c: {"valor": c.cast("double")}
    return _long(
        df.select(text_col),
        {
            "filas_totales": one(F.count(F.lit(1))),
            "textos_vacios": one(F.count_if(strip(text) == "")),
            "textos_muy_cortos_menos_100_chars": one(F.count_if(size < 100)),
            "longitud_minima": one(F.min(size)),
            "longitud_maxima": one(F.max(size)),
            "longitud_promedio": one(F.avg(size)),
            "longitud_mediana": one(F.percentile(size, F.lit(0.5))),
            "palabras_promedio": one(F.avg(M.word_count(text))),
            "caracteres_raros_total": one(F.sum(M.odd_characters(text))),
        },
        "metrica",
    )


def column_check(df: DataFrame, expected: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(c, "OK" if c in df.columns else "FALTA") for c in expected], "columna string, estado string")


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def class_warnings(df: DataFrame, column: str, word: str = "embargo") -> DataFrame:
    """Rows whose class does not contain the word."""
    return df.filter(~F.coalesce(F.lower(F.col(column)).contains(word), F.lit(False)))


def numbered(df: DataFrame, order: str, name: str = "numero_embargo", start: int = 1, parts: int = 200) -> DataFrame:
    """Append consecutive numbers in the order of a numeric column, nulls last (ties in any order).

    Rows are numbered within ``parts`` ranges of about equal size and shifted by how many lie before, so
    that no task sorts the whole table.
    """
    bounds = sorted(set(df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.002)))
    below = F.size(F.filter(F.lit(bounds).cast("array<double>"), lambda b: b < F.col(order)))
    ranged = df.withColumn("_part", F.when(F.col(order).isNull(), len(bounds) + 1).otherwise(below))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))  # at most `parts` rows
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    shifted = ranged.withColumn("_n", inside).join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    return shifted.withColumn(name, F.col("_n") + F.col("_before") + (start - 1)).drop("_part", "_n", "_before")


def mean_min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: its mean, least and largest value, as the selection shows them."""
    stats = lambda c: F.struct(F.lit(c).alias("columna"), F.avg(c).alias("promedio"), F.min(c).cast("double").alias("minimo"), F.max(c).cast("double").alias("maximo"))
    return df.agg(F.array(*map(stats, columns)).alias("r")).select(F.inline("r"))
