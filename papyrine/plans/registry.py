"""Registered queries of the document operators and the SQL they are held against."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions import metrics as M
from papyrine.functions import patterns as P
from papyrine.functions import predicates as R
from papyrine.functions import text as X
from papyrine.operators import chunks, entities, extract, models, profile, resolve, selection
from papyrine.plans import sqlgen as S
from papyrine.plans.legal import CTE, legal_documents, spread
from papyrine.sources import io

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def _all() -> None:
    from papyrine.plans import built  # noqa: F401  registers its queries


def queries() -> dict[str, Query]:
    _all()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_sql)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents"))



# Profiling -----------------------------------------------------------------------------------------


@_query(f"select coalesce(lang, '-') as lang, {S.state('text')} as estado, count(*) as cantidad, avg(length(text)) as largo_promedio from documents group by all")
def ocr_state(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(F.coalesce("lang", F.lit("-")).alias("lang"), R.ocr_state(F.col("text")).alias("estado"), F.length("text").alias("n"))
    return rows.groupBy("lang", "estado").agg(F.count(F.lit(1)).alias("cantidad"), F.avg("n").alias("largo_promedio"))


@_query(" union all ".join(f"select '{c}' as columna, avg(length({c})) as promedio_caracteres, cast(max(length({c})) as int) as max_caracteres, cast(min(length({c})) as int) as min_caracteres, count({c}) as valores_no_nulos from documents" for c in ("text", "lang", "source")))
def text_profile(spark, sf_dir):
    return profile.text_columns(_docs(spark, sf_dir))


@_query(" union all ".join(f"select '{c}' as columna, count({c}) as no_nulos, avg(length(coalesce({c}, ''))) as largo_promedio, quantile_cont(length(coalesce({c}, '')), 0.5) as largo_mediana, cast(max(length(coalesce({c}, ''))) as int) as largo_max from documents" for c in ("text", "lang", "source")))
def text_column_stats(spark, sf_dir):
    return profile.text_column_stats(_docs(spark, sf_dir))


_DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


@_query(" union all ".join(f"select '{c}' as columna, count(*) - count({c}) as nulos, round((count(*) - count({c})) * 100.0 / count(*), 2)::double as porcentaje from documents" for c in _DOC_COLUMNS))
def null_report(spark, sf_dir):
    df = profile.null_report(_docs(spark, sf_dir))
    return df.withColumn("porcentaje", F.col("porcentaje").cast("double"))


@_query("select * from (" + " union all ".join(f"select '{c}' as columna, count(distinct {c}) as valores_unicos, count(*) - count({c}) as nulos from documents" for c in _DOC_COLUMNS) + ") where valores_unicos <= 30")
def categorical_cols(spark, sf_dir):
    return profile.categorical_columns(_docs(spark, sf_dir), 30)


@_query("select lang, count(*) as cantidad from documents group by lang")
def value_counts(spark, sf_dir):
    return profile.value_counts(_docs(spark, sf_dir), "lang")


_STATES = ["nulo", "vacio", "texto_muy_corto", "ok"]


@_query(f"select source, {', '.join(f"count(*) filter (estado = '{s}') as {s}" for s in _STATES)} from (select source, {S.state('text')} as estado from documents) group by source")
def state_crosstab(spark, sf_dir):
    return profile.crosstab(_docs(spark, sf_dir).select("source", R.ocr_state(F.col("text")).alias("estado")), "source", "estado", _STATES)


@_query("select lang, count(n_chars) as count, avg(n_chars) as mean, stddev_samp(n_chars) as std, cast(min(n_chars) as double) as min, quantile_cont(n_chars, 0.25) as p25, quantile_cont(n_chars, 0.5) as p50, quantile_cont(n_chars, 0.75) as p75, cast(max(n_chars) as double) as max from documents group by lang")
def describe_by_group(spark, sf_dir):
    return profile.describe(_docs(spark, sf_dir), "n_chars", ["lang"])


@_query("select 'id' as clave, count(*) - count(distinct doc_id) as duplicados from documents union all select 'texto', (select cast(sum(n - 1) as bigint) from (select count(*) as n from documents group by text)) union all select 'texto_fuente_idioma', (select cast(sum(n - 1) as bigint) from (select count(*) as n from documents group by text, source, lang))")
def dup_counts(spark, sf_dir):
    return profile.duplicate_counts(_docs(spark, sf_dir), {"id": ["doc_id"], "texto": ["text"], "texto_fuente_idioma": ["text", "source", "lang"]})


@_query("select doc_id, repeticiones from (select doc_id, count(*) over (partition by text) as repeticiones from documents) where repeticiones > 1")
def dup_rows(spark, sf_dir):
    return profile.duplicate_rows(_docs(spark, sf_dir), ["text"]).select("doc_id", "repeticiones")


_REPORT = {
    "filas_totales": "count(*)",
    "textos_vacios": f"count(*) filter ({S.strip("coalesce(text, '')")} = '')",
    "textos_muy_cortos_menos_100_chars": "count(*) filter (length(coalesce(text, '')) < 100)",
    "longitud_minima": "min(length(coalesce(text, '')))",
    "longitud_maxima": "max(length(coalesce(text, '')))",
    "longitud_promedio": "avg(length(coalesce(text, '')))",
    "longitud_mediana": "quantile_cont(length(coalesce(text, '')), 0.5)",
    "palabras_promedio": f"avg({S.word_count("coalesce(text, '')")})",
    "caracteres_raros_total": f"sum({S.count("coalesce(text, '')", r'\p{Cc}|\p{Cf}|\p{Co}|\p{Zl}|\p{Zp}|[\x{00a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]')})",
}


@_query(" union all ".join(f"select '{k}' as metrica, cast({v} as double) as valor from documents" for k, v in _REPORT.items()))
def diag_report(spark, sf_dir):
    return profile.diagnostic_report(_docs(spark, sf_dir), "text")


@_query("select unnest(['doc_id', 'text', 'titulo']) as columna, unnest(['OK', 'OK', 'FALTA']) as estado")
def column_check(spark, sf_dir):
    return profile.column_check(_docs(spark, sf_dir), ["doc_id", "text", "titulo"])


@_query("select lang, avg(case when length(text) > 1000 then 1 else 0 end) * 100 as porcentaje from documents group by lang")
def boolean_share(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("lang").agg((F.avg((F.length("text") > 1000).cast("int")) * 100).alias("porcentaje"))


@_query("select doc_id, lang from documents where lang is null or not contains(lower(lang), 'e')")
def class_warnings(spark, sf_dir):
    return profile.class_warnings(_docs(spark, sf_dir), "lang", "e").select("doc_id", "lang")


# Predicates ----------------------------------------------------------------------------------------


@_query(f"select page_id, {S.any_of('lower(html)', P.HTML_SHORT)} as corto, {S.any_of('lower(html)', P.HTML_LONG)} as largo from pages")
def html_detect(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", R.looks_like_html(F.col("html")).alias("corto"), R.looks_like_html(F.col("html"), True).alias("largo"))


@_query(f"select page_id, array_to_string(list_filter([{', '.join(map(S.quote, P.HTML_LONG))}], lambda p: contains(lower(html), p)), ' ') as patrones from pages")
def html_patterns(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.array_join(R.html_traces(F.col("html")), " ").alias("patrones"))


@_query(f"select doc_id from documents where {S.state('text')} = 'ok' and lang in ('en', 'es')")
def target_filter(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return docs.filter(R.is_target(R.ocr_state(F.col("text")), F.col("lang"), ("en", "es"))).select("doc_id")


@_query(f"with {CTE} select id, case when {S.any_of('lower(texto)', ['embargo', 'embargar'])} then 'embargo' when {S.any_of('lower(texto)', ['oficio', 'solicito informe', 'informe si'])} then 'oficio' else 'desconocido' end as tipo from legal")
def document_type(spark, sf_dir):
    return legal_documents(spark, sf_dir).select("id", R.document_type(F.col("texto")).alias("tipo"))


# Cleaning ------------------------------------------------------------------------------------------

_QUOTES = f"translate(coalesce(text, ''), '“”„‘’‚', {S.quote('\"\"\"' + "'''")})"
_LINES = S.replace_all(f"translate(regexp_replace({_QUOTES}, '\r\n?', chr(10), 'g'), chr(9) || chr(160), '  ')", [(" {2,}", " "), (r"(?m)^ +| +$", "")])


@_query(f"select doc_id, {S.strip(S.replace_all(_LINES, [(r'\n{3,}', chr(10) * 2)]))} as texto_limpio from documents")
def clean_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.clean_legal(F.col("text")).alias("texto_limpio"))


@_query()
def clean_pages(spark, sf_dir):
    """Visible text and Markdown of raw pages; an HTML parser has no SQL form (tests hold it against samples)."""
    html = F.col("html")
    return _table(spark, sf_dir, "pages").select("page_id", X.clean_legal(html).alias("texto_limpio"), X.html_to_markdown(html).alias("markdown"))


@_query(rf"select doc_id, trim(regexp_replace(replace(translate(lower(coalesce(text, '')), '{X.ACCENTED}', '{X.PLAIN}'), 'ß', 'ss'), '\s+', ' ', 'g')) as clave from documents")
def search_norm(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.search_key(F.col("text")).alias("clave"))


@_query("select doc_id, '# Documento legal' || chr(10) || chr(10) || '## Metadatos' || chr(10) || chr(10) || '* ID: ' || doc_id || chr(10) || '* Nombre: ' || coalesce(source, '') || chr(10) || '* Clasificación: ' || coalesce(lang, '') || chr(10) || chr(10) || '## Texto limpio' || chr(10) || chr(10) || coalesce(text, '') as markdown from documents")
def markdown_doc(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.markdown_document(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("text")).alias("markdown"))


@_query("select lang, doc_id from (select lang, doc_id, row_number() over (partition by lang order by md5('42:' || doc_id), doc_id) as n from documents) where n <= 5")
def stratified_sample(spark, sf_dir):
    """A sampling operator: five documents per language."""
    return selection.stratified_sample(_docs(spark, sf_dir).select("lang", "doc_id"), "lang", "doc_id", 5)


@_query(f"with {CTE} select lower(clasificacion) || '_' || id || '.txt' as archivo, 'TIPO: ' || clasificacion || chr(10) || 'ID: ' || id || chr(10) || 'NOMBRE: ' || nombre || chr(10) || 'CLASIFICACION: ' || clasificacion || chr(10) || chr(10) || repeat('=', 80) || chr(10) || chr(10) || texto || chr(10) as contenido from legal")
def reading_sample(spark, sf_dir):
    return io.reading_sample(legal_documents(spark, sf_dir), text="texto")


@_query(f"with {CTE} select id, {S.replace_all('texto', [(('(?i)' if a else '') + p, n) for p, n, a in P.TERM_FIXES])} as texto from legal")
def term_fix(spark, sf_dir):
    return legal_documents(spark, sf_dir).select("id", X.fix_terms(F.col("texto")).alias("texto"))


_CLEANED = f"{CTE}, cleaned as (select id, nombre, clasificacion, texto as texto_base, {S.clean_ocr('texto')} as limpio from legal)"


@_query(f"with {_CLEANED} select id, limpio from cleaned")
def line_clean(spark, sf_dir):
    return legal_documents(spark, sf_dir).select("id", X.clean_ocr(F.col("texto")).alias("limpio"))


@_query(f"with {CTE} select id, replace({S.replace_all('substr(texto, 1, 300)', P.MASKS)}, chr(10), ' ') as vista from legal")
def mask_preview(spark, sf_dir):
    return legal_documents(spark, sf_dir).select("id", X.mask(F.col("texto")).alias("vista"))


@_query(f"with {CTE} select id, case when length(texto) > 300 then substr(texto, 1, 300) || chr(10) || '[...]' else texto end as recorte, substr(texto, 1, 500) as vista, replace(replace(replace('org/model-v' || (id % 9) || '.5', '/', '__'), '-', '_'), '.', '_') as modelo from legal")
def crop_and_preview(spark, sf_dir):
    model = F.concat(F.lit("org/model-v"), (F.col("id") % 9).cast("string"), F.lit(".5"))
    return legal_documents(spark, sf_dir).select("id", X.crop(F.col("texto"), 300).alias("recorte"), X.preview(F.col("texto")).alias("vista"), X.model_slug(model).alias("modelo"))


@_query()
def before_after_report(spark, sf_dir):
    """The ten documents with the worst score, before and after cleaning, with a unified diff (a top-k report)."""
    checked = selection.clean_and_check(legal_documents(spark, sf_dir), "texto")
    worst = selection.extremes(checked, "ocr_quality_score", "id", 10, largest=False)
    cut = lambda c: X.crop(F.col(c), 1500).alias(c)
    return worst.select("id", "nombre", "ocr_quality_score", "ocr_estado", "len_antes", "len_despues", "porcentaje_reduccion", cut("texto_base"), cut("texto_limpieza_avanzada"), X.unified_diff("texto_base", "texto_limpieza_avanzada").alias("diff"))


# OCR quality, loss alerts, ranking -----------------------------------------------------------------

_METRICS = S.metrics("texto")
_INT_METRICS = [k for k in _METRICS if "ratio" not in k]


@_query(f"with {CTE} select id, {', '.join(f'{v} as {k}' if 'ratio' in k else f'cast({v} as int) as {k}' for k, v in _METRICS.items())} from legal")
def ocr_metrics(spark, sf_dir):
    cols = M.ocr_metrics(F.col("texto"))
    return legal_documents(spark, sf_dir).select("id", *[(c.cast("int") if k in _INT_METRICS else c).alias(k) for k, c in cols.items()])


_SCORED = f"{CTE}, measured as (select id, clasificacion, {', '.join(f'{v} as {k}' for k, v in _METRICS.items())} from legal), scored as (select *, {S.score()} as ocr_quality_score from measured)"


@_query(f"with {_SCORED} select id, ocr_quality_score, {S.QUALITY_STATE} as ocr_estado from scored")
def ocr_score(spark, sf_dir):
    return M.measure(legal_documents(spark, sf_dir), "texto").select("id", "ocr_quality_score", "ocr_estado")


@_query(f"with {_SCORED} select clasificacion, {S.QUALITY_STATE} as ocr_estado, count(*) as cantidad, avg(ocr_quality_score) as score_promedio from scored group by all")
def ocr_state_class(spark, sf_dir):
    df = M.measure(legal_documents(spark, sf_dir), "texto")
    return df.groupBy("clasificacion", "ocr_estado").agg(F.count(F.lit(1)).alias("cantidad"), F.avg("ocr_quality_score").alias("score_promedio"))


_AFTER = S.metrics("limpio")
_CHECKED = (
    _CLEANED
    + f""", flagged as (
  select *, length(texto_base) as len_antes, length(limpio) as len_despues, {S.word_count('texto_base')} as palabras_antes, {S.word_count('limpio')} as palabras_despues,
    {', '.join(f"regexp_matches(texto_base, {S.re2(p)}) as antes_{k}, regexp_matches(limpio, {S.re2(p)}) as despues_{k}" for k, p in P.IMPORTANT.items())},
    {', '.join(f'{v} as {k}' for k, v in _AFTER.items())}
  from cleaned),
checked as (
  select *, (len_antes - len_despues) / len_antes::double as porcentaje_reduccion, (palabras_antes - palabras_despues) / palabras_antes::double as porcentaje_reduccion_palabras,
    {', '.join(f'(antes_{k} and not despues_{k}) as alerta_desaparece_{k}' for k in P.IMPORTANT)}, {S.score()} as ocr_quality_score
  from flagged),
alerts as (
  select *, porcentaje_reduccion > 0.35 as alerta_reduccion_alta, palabras_despues < 80 as alerta_texto_muy_corto,
    ({' or '.join(P.LOSS_ALERTS)}) as alerta_posible_perdida_datos, {S.QUALITY_STATE} as ocr_estado
  from checked)"""
)


def _checked(spark, sf_dir):
    return selection.clean_and_check(legal_documents(spark, sf_dir), "texto")


_ALERT_COLUMNS = ["id", "len_antes", "len_despues", "porcentaje_reduccion", "porcentaje_reduccion_palabras", "ocr_quality_score", "ocr_estado", *P.SEVERE_ALERTS, *P.LOSS_ALERTS]


@_query(f"with {_CHECKED} select {', '.join('cast(' + c + ' as int) as ' + c if c.startswith('len_') else c for c in _ALERT_COLUMNS)} from alerts")
def loss_alerts(spark, sf_dir):
    return _checked(spark, sf_dir).select(*_ALERT_COLUMNS)


_ALERT_ROWS = {f"desaparece_posible_{k}": f"alerta_desaparece_{k}" for k in ("dni", "cuil_cuit", "cbu_cvu", "monto", "expediente")} | {"reduccion_texto_mayor_35": "alerta_reduccion_alta", "reduccion_palabras_mayor_35": "porcentaje_reduccion_palabras > 0.35", "alerta_posible_perdida_datos_total": "alerta_posible_perdida_datos"}


@_query(f"with {_CHECKED} " + " union all ".join(f"select '{k}' as metrica, count(*) filter ({v}) as cantidad from alerts" for k, v in _ALERT_ROWS.items()))
def alert_report(spark, sf_dir):
    return selection.alert_report(_checked(spark, sf_dir))


@_query(
    f"with {_CHECKED} select count(*) as total_embargos_procesados, count(*) filter (ocr_estado = 'legible') as textos_legibles, count(*) filter (ocr_estado = 'regular') as textos_regulares, "
    "count(*) filter (ocr_estado = 'muy_ruidoso') as textos_muy_ruidosos, count(*) filter (ocr_estado = 'irrecuperable') as textos_irrecuperables, avg(porcentaje_reduccion) * 100 as porcentaje_promedio_reduccion_texto, "
    "count(*) filter (alerta_reduccion_alta) as alertas_reduccion_alta, count(*) filter (alerta_posible_perdida_datos) as alertas_posible_perdida_datos from alerts"
)
def final_report(spark, sf_dir):
    return selection.final_report(_checked(spark, sf_dir))


_TOP = f"""{_CHECKED}, marked as (select *, ({' + '.join(f'cast(despues_{k} as int)' for k in P.IMPORTANT)}) as indicadores from alerts),
rated as (select *, ocr_quality_score * 0.55::double + least(palabras_despues / 700::double, 1.0) * 0.15::double + least(indicadores / 8::double, 1.0) * 0.20::double + (1 - least(greatest(porcentaje_reduccion, 0.0), 1.0)) * 0.10::double as score_seleccion_gliner from marked),
fine as (select * from rated where palabras_despues >= 120 and porcentaje_reduccion <= 0.35 and not alerta_posible_perdida_datos),
pool as (select * from fine where ocr_estado = 'legible' or (ocr_estado = 'regular' and (select count(*) from fine where ocr_estado = 'legible') < 15))"""


@_query(f"with {_TOP} select id, score_seleccion_gliner, ocr_estado, substr(limpio, 1, 500) as texto_limpio_avanzado_preview_500 from pool order by score_seleccion_gliner desc, ocr_quality_score desc, indicadores desc, palabras_despues desc, id limit 15")
def top15(spark, sf_dir):
    """The best fifteen documents for the entity model (a top-k report)."""
    return selection.top_for_model(_checked(spark, sf_dir)).select("id", "score_seleccion_gliner", "ocr_estado", "texto_limpio_avanzado_preview_500")


_RANK = f"""{_CHECKED}, ranked as (
  select *, round(ocr_quality_score + case ocr_estado when 'legible' then 25 when 'muy_ruidoso' then -50 when 'irrecuperable' then -90 else 0 end
    + least(len_despues, 6000) / 6000::double * 30 - case when len_despues < 500 then 35 else 0 end - case when len_despues < 200 then 65 else 0 end
    - 0.25::double * least(greatest(porcentaje_reduccion * 100, 0), 100) - case when porcentaje_reduccion * 100 > 60 then 20 else 0 end + case when porcentaje_reduccion * 100 <= 35 then 8 else 0 end
    - 30 * ({' + '.join(f'cast({c} as int)' for c in P.SEVERE_ALERTS)}) - 12 * ({' + '.join(f'cast({c} as int)' for c in P.LOSS_ALERTS)})
    + 9 * ({' + '.join(f'cast(regexp_matches(limpio, {S.re2(p)}) as int)' for p in P.SELECTION.values())})
    + 12 * cast(regexp_matches(limpio, {S.re2(r'\b(?:' + '|'.join(P.EMBARGO_KEYWORDS) + r')\b')}) as int)
    + 2 * least(important_data_count, 10) + least(legal_terms_count, 10), 4) as ranking_80_score
  from alerts),
usable as (select * from ranked where ocr_estado not in ('irrecuperable', 'muy_ruidoso') and not alerta_texto_muy_corto and len_despues >= 300),
pool as (select * from usable union all select * from ranked where (select count(*) from usable) < 80 and id not in (select id from usable))"""


@_query(f"with {_RANK} select id, ranking_80_score, ocr_estado from pool order by ranking_80_score desc, ocr_quality_score desc, len_despues desc, id limit 80")
def rank80(spark, sf_dir):
    """The best eighty documents (a top-k report)."""
    return selection.select_top(_checked(spark, sf_dir), "texto_limpieza_avanzada").select("id", "ranking_80_score", "ocr_estado")


# Chunks --------------------------------------------------------------------------------------------


@_query("with c as (select doc_id, coalesce(text, '') as t, unnest(range(0, case when length(coalesce(text, '')) <= 2800 then 1 else cast(ceil((length(text) - 400) / 2400.0) as int) end)) as chunk_id from documents) select doc_id, cast(chunk_id as int) as chunk_id, cast(chunk_id * 2400 as int) as \"offset\", substr(t, cast(chunk_id * 2400 + 1 as bigint), 2800) as texto_chunk from c")
def char_chunks(spark, sf_dir):
    return chunks.char_chunks(_docs(spark, sf_dir).select("doc_id", "text"), "text").drop("text")


_TOK = r"regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]')"


@_query(f"with t as (select doc_id, {_TOK} as k from documents), c as (select doc_id, k, unnest(range(0, case when len(k) <= 300 then 1 else cast(ceil((len(k) - 50) / 250.0) as int) end)) as chunk_id from t where len(k) > 0) select doc_id, cast(chunk_id as int) as chunk_id, cast(chunk_id * 250 as int) as token_start, cast(least(len(k), chunk_id * 250 + 300) as int) as token_end, cast(len(k[chunk_id * 250 + 1 : chunk_id * 250 + 300]) as int) as n_tokens_chunk, array_to_string(k[chunk_id * 250 + 1 : chunk_id * 250 + 300], ' ') as texto_chunk from c")
def token_chunks(spark, sf_dir):
    return chunks.token_chunks(_docs(spark, sf_dir).select("doc_id", "text"), "text").drop("text")


@_query(f"select lang, count(*) as cantidad, avg(n) as media, cast(min(n) as int) as minimo, cast(max(n) as int) as maximo, count(*) filter (n > 300) as con_riesgo from (select lang, len({_TOK}) as n from documents) group by lang")
def token_stats(spark, sf_dir):
    n = F.col("n")
    rows = _docs(spark, sf_dir).select("lang", chunks.token_count(F.col("text")).alias("n"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("cantidad"), F.avg(n).alias("media"), F.min(n).alias("minimo"), F.max(n).alias("maximo"), F.count_if(n > 300).alias("con_riesgo"))


@_query("with m as (select quantile_cont(n_chars, 0.5) as m from documents) select 'corto' as caso, doc_id, n_chars from (select doc_id, n_chars from documents order by n_chars, doc_id limit 1) union all select 'medio', doc_id, n_chars from (select doc_id, n_chars from documents, m order by abs(n_chars - m), doc_id limit 1) union all select 'largo', doc_id, n_chars from (select doc_id, n_chars from documents order by n_chars desc, doc_id limit 1)")
def short_mid_long(spark, sf_dir):
    return selection.short_middle_long(_docs(spark, sf_dir), "n_chars", "doc_id")


@_query(rf"select doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')) as palabras_espacio, {S.word_count("coalesce(text, '')")} as palabras from documents")
def word_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", M.space_word_count(F.col("text")).cast("long").alias("palabras_espacio"), M.word_count(F.col("text")).cast("long").alias("palabras"))


@_query(f"with {CTE} select id, substr(texto, greatest(strpos(texto, 'DNI') - 1 - 180, 0) + 1, least(length(texto), strpos(texto, 'DNI') + 2 + 180) - greatest(strpos(texto, 'DNI') - 1 - 180, 0)) as contexto from legal")
def context_window(spark, sf_dir):
    at = F.instr("texto", "DNI") - 1
    return legal_documents(spark, sf_dir).select("id", X.context(F.col("texto"), at, at + 3).alias("contexto"))


# Entities ------------------------------------------------------------------------------------------

_SIMPLE = CTE + ", simple as (" + " union all ".join(f"select id, '{k}' as etiqueta, trim(v) as raw from (select id, unnest(regexp_extract_all(texto, {S.re2(p)}, 1)) as v from legal) where regexp_full_match(regexp_replace(v, '\\D', '', 'g'), '{shape.replace('\\\\', '\\')}')" for k, (p, shape) in P.SIMPLE_IDS.items()) + r"), ids as (select id, etiqueta, etiqueta || ' ' || regexp_replace(raw, '\s+', ' ', 'g') as texto, regexp_replace(raw, '\D', '', 'g') as valor_normalizado from simple)"


def _simple(spark, sf_dir):
    rows = extract.with_simple_ids(legal_documents(spark, sf_dir), "texto", "e", keep_text=False)
    return rows.select("id", "nombre", "clasificacion", F.explode("e").alias("e")).select("id", "nombre", "clasificacion", "e.*")


@_query(f"with {_SIMPLE} select id, etiqueta, texto, valor_normalizado from ids")
def id_entities(spark, sf_dir):
    return _simple(spark, sf_dir).select("id", "etiqueta", "texto", "valor_normalizado")


@_query(f"with {_SIMPLE} select etiqueta, count(*) as cantidad from ids group by etiqueta")
def entity_counts(spark, sf_dir):
    return _simple(spark, sf_dir).groupBy("etiqueta").agg(F.count(F.lit(1)).alias("cantidad"))


@_query(f"with {_SIMPLE} select id, count(*) as total_entidades, string_agg(distinct etiqueta, ', ' order by etiqueta) as etiquetas_encontradas from ids group by id")
def doc_labels(spark, sf_dir):
    return entities.document_labels(_simple(spark, sf_dir))


_LABELS = list(P.SIMPLE_IDS)


@_query(f"with {_SIMPLE} select id, " + ", ".join(f"nullif(count(*) filter (etiqueta = '{x}'), 0) as entidades_{x}" for x in _LABELS) + " from ids group by id")
def label_pivot(spark, sf_dir):
    return entities.label_pivot(_simple(spark, sf_dir), _LABELS)


@_query(f"with {_SIMPLE}, twice as (select id, etiqueta, texto, null::double as score from ids union all select id, etiqueta, upper(texto), (id % 10) / 10.0::double from ids) select id, etiqueta, texto, score from (select *, row_number() over (partition by id, etiqueta, lower(texto) order by score desc nulls last, texto) as n from twice) where n = 1")
def dedupe_best(spark, sf_dir):
    ids = _simple(spark, sf_dir).select("id", "etiqueta", "texto")
    entry = lambda text, score: F.struct(text.alias("texto"), score.cast("double").alias("score"))
    twice = F.array(entry(F.col("texto"), F.lit(None)), entry(F.upper("texto"), (F.col("id") % 10) / 10.0))
    return extract.dedupe_best(ids.select("id", "etiqueta", F.inline(twice)))


@_query(f"with {_SIMPLE} select id, nombre from legal where id not in (select id from ids where etiqueta in ('CBU', 'CVU'))")
def docs_without_entities(spark, sf_dir):
    docs = legal_documents(spark, sf_dir).select("id", "nombre")
    return entities.without_entities(docs, _simple(spark, sf_dir).filter(F.col("etiqueta").isin("CBU", "CVU")))


@_query(f"with {_SIMPLE}, l as (select id, count(*) as n, string_agg(etiqueta || '=' || texto, '; ' order by etiqueta, texto) as entidades, string_agg(distinct etiqueta, ', ' order by etiqueta) as etiquetas from ids group by id) select legal.id, clasificacion, cast(coalesce(n, 0) as int) as total_entidades, coalesce(entidades, '') as entidades, coalesce(etiquetas, '') as etiquetas from legal left join l on legal.id = l.id")
def nested_doc(spark, sf_dir):
    docs = entities.nested_documents(legal_documents(spark, sf_dir), _simple(spark, sf_dir).select("id", "etiqueta", "texto"))
    flat = F.array_join(F.transform("entidades", lambda e: F.concat_ws("=", e["etiqueta"], e["texto"])), "; ")
    return docs.select("id", "clasificacion", "total_entidades", flat.alias("entidades"), F.array_join("etiquetas_encontradas", ", ").alias("etiquetas"))


@_query(rf"with {CTE} select id, v as valor_raw, cast(replace(replace(replace(v, '$ ', ''), '.', ''), ',', '.') as double) as valor from (select id, unnest(regexp_extract_all(texto, '\$ [0-9.]+,[0-9]+')) as v from legal)")
def money_norm(spark, sf_dir):
    found = legal_documents(spark, sf_dir).select("id", F.explode(F.regexp_extract_all("texto", F.lit(r"\$ [0-9.]+,[0-9]+"), F.lit(0))).alias("valor_raw"))
    return found.withColumn("valor", X.money_ar(F.col("valor_raw")))


# The rich entities of the synthetic texts, each kind by its pattern; a value occurs once in a text,
# so its place is found by the value.
def _first(pattern: str, group: int = 1) -> str:
    return f"regexp_extract(texto, {S.quote('(?i)' + pattern)}, {group})"


_GROUP = {k: p.replace("(?P<label>", "(").replace("(?P<value>", "(").replace("(?P<prefix>", "(") for k, p in P.RICH.items()}
_PERSON = P.PERSON_NEAR_ID[0].replace("(?P<name>", "(")
_RICH = (
    CTE
    + ", rich as ("
    + " union all ".join(
        [
            f"select id, texto, upper({_first(_GROUP['ACCOUNT'], 1)}) as tipo, {_first(_GROUP['ACCOUNT'], 2)} as valor, 0.97::double as confianza from legal",
            f"select id, texto, 'CUIT_CUIL', {_first(_GROUP['TAX_ID'], 2)}, 0.96 from legal",
            f"select id, texto, 'DNI', {_first(_GROUP['DNI'], 2)}, 0.94 from legal",
            f"select id, texto, 'ALIAS', {_first(_GROUP['ALIAS'], 1)}, 0.85 from legal",
            f"select id, texto, 'persona', {_first(_PERSON, 1)}, 0.90 from legal",
            rf"select id, texto, 'MONTO', unnest(regexp_extract_all(texto, '\$ [0-9.]+,[0-9]+')), null from legal",
        ]
    )
    + r"), places as (select id, texto, tipo, valor, confianza, case when tipo = 'persona' then strpos(texto, 'Sr. ' || valor) + 3 when tipo = 'CUIT_CUIL' then strpos(texto, 'CUIL ' || valor) + 4 when tipo = 'DNI' then strpos(texto, 'DNI ' || valor) + 3 else strpos(texto, valor) - 1 end as a from rich where valor <> ''), "
    + r"ents as (select id, texto, tipo, valor, case when tipo in ('persona', 'ALIAS') then upper(valor) when tipo = 'MONTO' then null else regexp_replace(valor, '\D', '', 'g') end as valor_normalizado, case when tipo = 'MONTO' then cast(replace(replace(replace(valor, '$ ', ''), '.', ''), ',', '.') as double) end as monto_normalizado, cast(a as int) as span_inicio, cast(a + length(valor) as int) as span_fin, confianza from places), "
    + "rich_entities as (select * from ents where tipo <> 'MONTO' or monto_normalizado >= 1000)"
)


def _rich(spark, sf_dir):
    return extract.with_entities(legal_documents(spark, sf_dir), "texto", in_order=True)


@_query(f"with {_RICH} select id, tipo, trim(valor) as valor, valor_normalizado, monto_normalizado, span_inicio, span_fin, confianza from rich_entities")
def rich_entities(spark, sf_dir):
    rows = _rich(spark, sf_dir).select("id", F.explode("entidades").alias("e"))
    return rows.select("id", *[f"e.{c}" for c in ("tipo", "valor", "valor_normalizado", "monto_normalizado", "span_inicio", "span_fin", "confianza")])


_b, _a = "span_inicio", "span_fin"
_CTX = f"({S.before('texto', _b, 250)} || ' ' || {S.after('texto', _a, 180)})"
_AMOUNT_SCORE = " + ".join(
    [
        S.points("contains(valor, '$')", 2),
        f"5 * {S.hits(_CTX, P.AMOUNT_STRONG)}",
        f"3 * {S.hits(_CTX, P.AMOUNT_MEDIUM)}",
        S.points(S.any_of(S.before("texto", _b, 100), P.AMOUNT_EXTRA_BEFORE), -8),
        S.points(S.any_of(S.after("texto", _a, 120), P.AMOUNT_COSTS_AFTER), -6),
        S.points(S.any_of(_CTX, P.AMOUNT_FALSE_CONTEXT), -4),
        S.points("monto_normalizado > 0", 1),
    ]
)
_AMOUNTS = f"{_RICH}, amounts as (select *, {_AMOUNT_SCORE} as score_contextual from rich_entities where tipo = 'MONTO'), best_amount as (select *, round(greatest(0.35, least(0.98, 0.55 + score_contextual * 0.035)), 2) as sure from (select *, row_number() over (partition by id order by score_contextual desc, span_inicio) as n from amounts) where n = 1)"


@_query(f"with {_AMOUNTS} select legal.id, valor as valor_raw, monto_normalizado, cast(score_contextual as double) as score_contextual, cast(sure as double) as confianza from legal left join best_amount on legal.id = best_amount.id")
def amount_rank(spark, sf_dir):
    best = F.col("best_monto")
    rows = resolve.resolved(legal_documents(spark, sf_dir))
    return rows.select("id", best["valor"].alias("valor_raw"), best["monto_normalizado"].alias("monto_normalizado"), best["score_contextual"].alias("score_contextual"), best["confianza"].alias("confianza"))


_NEAR = f"({S.before('texto', _b, 120)} || ' ' || {S.after('texto', _a, 160)})"
_MEDIUM = f"({S.before('texto', _b, 260)} || ' ' || {S.after('texto', _a, 260)})"
_WIDE = S.before("texto", _b, 500)
_HEAD = f"substr(texto, 1, {_b})"
_LINE_B = f"(case when contains({_HEAD}, chr(10)) then length({_HEAD}) - strpos(reverse({_HEAD}), chr(10)) else greatest({_b} - 200, 0) end)"
_LINE_E = f"(case when contains(substr(texto, {_a} + 1), chr(10)) then {_a} + strpos(substr(texto, {_a} + 1), chr(10)) - 1 else least(length(texto), {_a} + 200) end)"
_LINE = f"lower(substr(texto, {_LINE_B} + 1, {_LINE_E} - {_LINE_B}))"
_VERSUS = f"(case when contains({_LINE}, 'c/') then strpos({_LINE}, 'c/') - 1 else strpos({_LINE}, ' c ') - 1 end)"
_PERSON_SCORE = " + ".join(
    [
        "coalesce(confianza, 0)",
        S.points(S.any_of("lower(valor)", P.ROLE_IN_VALUE), -20),
        S.points(S.any_of(_NEAR, P.AUTHORITY_NEAR), -20),
        S.points(f"(contains({_WIDE}, 'usuario conectado') or (contains({_WIDE}, 'usuari') and contains({_WIDE}, 'conectado'))) and not {S.any_of(_NEAR, P.ID_NEAR)}", -10),
        S.points(S.any_of(f"right({S.before('texto', _b, 120)}, 45)", P.TITLES_NEAR), -6),
        S.points("starts_with(lower(valor), 'dr.') or starts_with(lower(valor), 'dra.')", -6),
        S.points(f"{_VERSUS} >= 0 and {_b} - {_LINE_B} < {_VERSUS}", -8),
        S.points(f"{_VERSUS} >= 0 and {_b} - {_LINE_B} > {_VERSUS}", 4),
        f"5 * {S.hits(_NEAR, P.DEBTOR_NEAR)}",
        S.points(S.any_of(_NEAR, P.ID_TOKENS), 7),
        S.points(S.any_of(f"substr({S.after('texto', _a, 160)}, 1, 110)", P.ID_TOKENS), 5),
        S.points(S.any_of(f"substr({S.after('texto', _a, 160)}, 1, 90)", P.ID_SHORT), 4),
        f"1.5 * {S.hits(_MEDIUM, P.EMBARGO_MEDIUM)}",
        f"-3 * {S.hits(_NEAR, P.THIRD_PARTY_NEAR)}",
    ]
)


@_query(f"with {_RICH} select legal.id, p.valor as nombre, cast(p.s as double) as score_rol_embargado from legal left join (select id, valor, {_PERSON_SCORE} as s from rich_entities where tipo = 'persona') p on legal.id = p.id")
def person_rank(spark, sf_dir):
    best = F.col("best_persona")
    return resolve.resolved(legal_documents(spark, sf_dir)).select("id", best["valor"].alias("nombre"), best["score_rol_embargado"].alias("score_rol_embargado"))


_NEAREST = "(select p.id, e.tipo, e.valor_normalizado, greatest(e.span_inicio - p.span_fin, p.span_inicio - e.span_fin, 0) as gap from rich_entities p join rich_entities e on p.id = e.id where p.tipo = 'persona' and e.tipo in ('DNI', 'CUIT_CUIL'))"


@_query(f"with {_RICH} select legal.id, d.valor_normalizado as dni, c.valor_normalizado as cuil_cuit from legal left join {_NEAREST} d on legal.id = d.id and d.tipo = 'DNI' and d.gap <= 500 left join {_NEAREST} c on legal.id = c.id and c.tipo = 'CUIT_CUIL' and c.gap <= 550")
def nearest_id(spark, sf_dir):
    rows = resolve.resolved(legal_documents(spark, sf_dir))
    return rows.select("id", F.col("best_dni.valor_normalizado").alias("dni"), F.col("best_cuil.valor_normalizado").alias("cuil_cuit"))


_CONTEXT = r"trim(regexp_replace(substr(texto, greatest(span_inicio - 220, 0) + 1, span_fin + 220 - greatest(span_inicio - 220, 0)), '\s+', ' ', 'g'))"
_BANK = f"nullif(trim(regexp_extract({_CONTEXT}, {S.quote('(?i)' + P.RICH['BANK'])}, 1)), '')"


@_query(f"with {_RICH} select legal.id, case when a.tipo = 'CBU' then a.valor_normalizado end as cbu, case when a.tipo = 'CVU' then a.valor_normalizado end as cvu, l.valor_normalizado as alias, a.banco from legal left join (select id, tipo, valor_normalizado, {_BANK} as banco from rich_entities where tipo in ('CBU', 'CVU')) a on legal.id = a.id left join (select id, valor_normalizado from rich_entities where tipo = 'ALIAS') l on legal.id = l.id")
def account_choice(spark, sf_dir):
    return resolve.process(legal_documents(spark, sf_dir)).select(F.col("id").cast("long").alias("id"), "cuenta_deposito.cbu", "cuenta_deposito.cvu", "cuenta_deposito.alias", "cuenta_deposito.banco")


_COUNTS = ", ".join(f"count(*) filter (tipo = '{k}') as {n}" for n, k in {"cant_personas": "persona", "cant_dni": "DNI", "cant_cuit_cuil": "CUIT_CUIL", "cant_cbu": "CBU", "cant_cvu": "CVU", "cant_alias": "ALIAS", "cant_montos": "MONTO"}.items())


@_query(
    f"with {_AMOUNTS}, counts as (select id, count(*) as n, {_COUNTS} from rich_entities group by id), p as (select id, {_PERSON_SCORE} as s from rich_entities where tipo = 'persona') "
    f"select cast(legal.id as string) as id, cast(counts.n as int) as cantidad_entidades_encontradas, {', '.join(f'cast({c} as int) as {c}' for c in ('cant_personas', 'cant_dni', 'cant_cuit_cuil', 'cant_cbu', 'cant_cvu', 'cant_alias', 'cant_montos'))}, "
    f"array_to_string(list_filter([case when p.s is null then {S.quote(P.REASONS['person'])} end, case when p.s < 5 then {S.quote(P.REASONS['person_score'])} end, case when p.s is null or (cant_dni = 0 and cant_cuit_cuil = 0) then {S.quote(P.REASONS['id'])} end, "
    f"case when best_amount.id is null then {S.quote(P.REASONS['amount'])} end, case when cant_cbu + cant_cvu + cant_alias = 0 then {S.quote(P.REASONS['account'])} end, case when sure < 0.65 then {S.quote(P.REASONS['amount_confidence'])} end], lambda r: r is not null), ' | ') as motivos_revision "
    "from legal left join counts on legal.id = counts.id left join p on legal.id = p.id left join best_amount on legal.id = best_amount.id"
)
def summary_row(spark, sf_dir):
    rows = resolve.summary(resolve.process(legal_documents(spark, sf_dir)))
    return rows.select("id", "cantidad_entidades_encontradas", *[c for c in rows.columns if c.startswith("cant_")], "motivos_revision")


@_query(f"with {_RICH} select cast(id as string) as id, tipo as tipo_entidad, trim(valor) as valor, span_inicio, span_fin, 'pendiente' as estado_revision, '' as valor_corregido, true as estado_valido from rich_entities")
def review_rows(spark, sf_dir):
    rows = io.workbook_rows(resolve.review_rows(resolve.process(legal_documents(spark, sf_dir))))
    return rows.select("id", "tipo_entidad", "valor", "span_inicio", "span_fin", "estado_revision", "valor_corregido", "estado_valido")


@_query()
def model_persons(spark, sf_dir):
    """Persons by the built-in entity model beside those near an identity document, partial ones dropped."""
    found = extract.with_entities(legal_documents(spark, sf_dir), "texto", model=extract.CapitalRuns, in_order=True)
    rows = found.select("id", F.explode("entidades").alias("e"))
    return rows.filter("e.tipo = 'persona'").select("id", "e.valor", "e.metodo", "e.span_inicio", "e.span_fin", "e.confianza")


@_query(rf"with {CTE}, hits as (select id, unnest(regexp_extract_all(texto, '\d{{7,}}')) as v from legal) select id, 'numero' as entidad_label, v as entidad_texto, 0.9::double as score from hits union all select id, 'SIN_ENTIDADES', null, null from legal where id not in (select id from hits)")
def model_predictions(spark, sf_dir):
    """Whole-text inference with the demonstration model: its predictions and sentinel rows."""
    found = models.predict(legal_documents(spark, sf_dir), "texto", lambda: models.digit_runs, ["numero"])
    return found.select("id", "entidad_label", "entidad_texto", "score")


@_query(rf"with {CTE}, t as (select id, regexp_extract_all(texto, '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_\s]') as k from legal), c as (select id, k, unnest(range(0, case when len(k) <= 60 then 1 else cast(ceil((len(k) - 20) / 40.0) as int) end)) as chunk_id from t), hits as (select id, unnest(regexp_extract_all(array_to_string(k[chunk_id * 40 + 1 : chunk_id * 40 + 60], ' '), '\d{{7,}}')) as v from c) select distinct id, 'numero' as entidad_label, v as entidad_texto from hits union all select id, 'SIN_ENTIDADES', null from legal where id not in (select id from hits)")
def chunk_predictions(spark, sf_dir):
    """Chunked inference with the demonstration model, repeats of overlapping chunks removed."""
    found = models.predict_chunks(legal_documents(spark, sf_dir), "texto", lambda: models.digit_runs, ["numero"], size=60, overlap=20)
    first = extract.dedupe_first(found, ["id", "entidad_label", "entidad_texto"], ["chunk_id", "start"])
    return first.select("id", "entidad_label", "entidad_texto")


# Validation, review, comparison --------------------------------------------------------------------

_PREDICTED = (
    _SIMPLE
    + """, preds as (
  select id, 'm' || (id % 2) as modelo, case when id % 5 = 0 then null else 'set_' || (id % 3) end as labels_set, lower(etiqueta) as entidad_label, texto as entidad_texto, case when id % 11 = 0 then null else 0.5 + (id % 50) / 100.0::double end as score from ids
  union all select id, 'm' || (id % 2), case when id % 5 = 0 then null else 'set_' || (id % 3) end, case id % 4 when 0 then 'persona' when 1 then 'caratula' when 2 then 'monto' else 'SIN_ENTIDADES' end,
    case id % 4 when 0 then 'Dra. ANA GOMEZ' when 1 then 'Banco c/ Perez' when 2 then '$ ' || id else null end, 0.7 from legal)"""
)


def _predictions(spark, sf_dir):
    docs = legal_documents(spark, sf_dir)
    model = F.concat(F.lit("m"), (F.col("id") % 2).cast("string")).alias("modelo")
    labels = F.when(F.col("id") % 5 != 0, F.concat(F.lit("set_"), (F.col("id") % 3).cast("string"))).alias("labels_set")
    score = F.when(F.col("id") % 11 != 0, 0.5 + (F.col("id") % 50) / 100.0).alias("score")
    a = _simple(spark, sf_dir).select("id", model, labels, F.lower("etiqueta").alias("entidad_label"), F.col("texto").alias("entidad_texto"), score)
    four = F.col("id") % 4
    label = F.when(four == 0, "persona").when(four == 1, "caratula").when(four == 2, "monto").otherwise("SIN_ENTIDADES")
    value = F.when(four == 0, "Dra. ANA GOMEZ").when(four == 1, "Banco c/ Perez").when(four == 2, F.concat(F.lit("$ "), F.col("id").cast("string")))
    b = docs.select("id", model, labels, label.alias("entidad_label"), value.alias("entidad_texto"), F.lit(0.7).alias("score"))
    return entities.validated(a.unionByName(b))


_DIG = r"regexp_replace(entidad_texto, '\D', '', 'g')"
_VALID = (
    _PREDICTED
    + rf""", valid as (select *, case when entidad_texto is null then false when entidad_label in ('persona', 'caratula', 'banco') then true when contains(entidad_label, 'dni') then regexp_full_match({_DIG}, '\d{{7,8}}')
  when contains(entidad_label, 'cuil') or contains(entidad_label, 'cuit') then regexp_full_match({_DIG}, '(20|23|24|27|30|33|34)\d{{9}}') when contains(entidad_label, 'cbu') or contains(entidad_label, 'cvu') then regexp_full_match({_DIG}, '\d{{22}}')
  when contains(entidad_label, 'monto') then regexp_matches(entidad_texto, '\d') and regexp_matches(entidad_texto, '(?i)\$|pesos|importe|monto') else true end as formato_valido_label from preds),
revised as (select *, score is null or score < 0.60 or not formato_valido_label or (entidad_label = 'persona' and regexp_matches(coalesce(entidad_texto, ''), '(?i)\bjuez\b|\bdra?\.?\b|\bsecretario\b')) or (entidad_label = 'caratula' and len(regexp_split_to_array(trim(entidad_texto), '\s+')) < 4) as requiere_revision_manual from valid),
shown as (select * from revised where entidad_label <> 'SIN_ENTIDADES')"""
)


@_query(f"with {_VALID} select id, entidad_label, entidad_texto, formato_valido_label from revised")
def label_validation(spark, sf_dir):
    return _predictions(spark, sf_dir).select("id", "entidad_label", "entidad_texto", "formato_valido_label")


@_query(f"with {_VALID} select id, entidad_label, entidad_texto, requiere_revision_manual from revised")
def review_flags(spark, sf_dir):
    return _predictions(spark, sf_dir).select("id", "entidad_label", "entidad_texto", "requiere_revision_manual")


@_query(f"with {_VALID} select entidad_label, formato_valido_label, requiere_revision_manual, count(*) as cantidad from shown group by all")
def review_summary(spark, sf_dir):
    return entities.review_summary(_predictions(spark, sf_dir))


@_query(f"with {_VALID} select id, entidad_label, entidad_texto, requiere_revision_manual, '' as correcto_manual, '' as observaciones from shown")
def review_template(spark, sf_dir):
    return entities.review_template(_predictions(spark, sf_dir)).select("id", "entidad_label", "entidad_texto", "requiere_revision_manual", "correcto_manual", "observaciones")


@_query(
    f"with {_VALID} select modelo, labels_set, 0.35::double as threshold, case when id % 2 = 0 then 'directo' else 'chunks' end as estrategia, count(entidad_texto) as total_entidades, count(distinct id) as documentos_cubiertos, avg(score) as score_promedio, min(score) as score_minimo, max(score) as score_maximo, "
    "count(*) filter (formato_valido_label) as entidades_formato_valido, count(*) filter (not formato_valido_label) as entidades_formato_invalido, count(*) filter (requiere_revision_manual) as entidades_requieren_revision, count(*) filter (not requiere_revision_manual) as entidades_confiables from shown group by all"
)
def model_compare(spark, sf_dir):
    strategy = F.when(F.col("id") % 2 == 0, "directo").otherwise("chunks")
    return entities.model_comparison(_predictions(spark, sf_dir).withColumns({"threshold": F.lit(0.35), "estrategia": strategy}))


@_query(f"with {_VALID} select entidad_label, count(*) as cantidad, avg(score) as score_promedio, min(score) as score_minimo, max(score) as score_maximo from shown group by entidad_label")
def score_per_label(spark, sf_dir):
    return entities.score_stats(_predictions(spark, sf_dir).filter(R.not_sentinel(F.col("entidad_label"))), ["entidad_label"])


@_query(
    f"with {_VALID}, found as (select id, {', '.join(f'bool_or({S.any_of('entidad_label', w)}) as {k}' for k, w in P.LABEL_FAMILIES.items())} from shown group by id) select legal.id, "
    + ", ".join(f"regexp_matches(texto, {S.re2(p)}) as regex_tiene_{k}, coalesce({k}, false) as gliner_detecto_{k}" for k, p in P.AUDIT.items())
    + " from legal left join found on legal.id = found.id"
)
def regex_vs_model(spark, sf_dir):
    docs = legal_documents(spark, sf_dir).select("id", "texto")
    return entities.pattern_against_model(docs, _predictions(spark, sf_dir).select("id", "entidad_label"), "texto").drop("texto")


@_query(f"with {_VALID} select 'confiables' as cola, count(*) as cantidad from shown where not requiere_revision_manual union all select 'revisar', count(*) from shown where requiere_revision_manual")
def trusted_split(spark, sf_dir):
    return entities.trusted_counts(_predictions(spark, sf_dir))


_SURE_NAME = r"Sr\. ([A-Z ]+), DNI"


@_query(f"with {CTE}, n as (select id, regexp_extract(texto, '{_SURE_NAME}', 1) as n from legal) select id, case when id % 4 = 2 then 'Banco ' || n else n end as limpio, id % 4 <> 2 as valida from n")
def person_names(spark, sf_dir):
    """Names with a title before, an office behind, or the word for bank: what is left, and whether it is a person."""
    rows = legal_documents(spark, sf_dir).select("id", F.regexp_extract("texto", _SURE_NAME, 1).alias("n"))
    four, n = F.col("id") % 4, F.col("n")
    dressed = F.when(four == 0, F.concat(F.lit("Dra. "), n)).when(four == 1, F.concat(n, F.lit(" JUEZ"))).when(four == 2, F.concat(F.lit("Banco "), n)).otherwise(n)
    return rows.select("id", X.person_name(dressed).alias("limpio"), R.valid_person(dressed).alias("valida"))


@_query("select role, count(*) as cantidad, count(distinct conv_id) as conversaciones, avg(length(text)) as largo from conversations group by role")
def conversation_roles(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("cantidad"), F.count_distinct("conv_id").alias("conversaciones"), F.avg(F.length("text")).alias("largo"))
