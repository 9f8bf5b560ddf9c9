"""Registered queries over built inputs: marked-up pages, damaged texts, dialogue of sources and sinks.

The input of a query is put together from table columns, so its SQL states the result from the same
columns without doing what the operator does.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.functions import patterns as P
from papyrine.functions import predicates as R
from papyrine.functions import text as X
from papyrine.operators import chunks, entities, extract, models, profile, selection
from papyrine.plans.legal import CTE, legal_documents, parts_of
from papyrine.plans.registry import _CHECKED, _docs, _predictions, _query, _table, _VALID
from papyrine.session import scratch
from papyrine.sources import io

# Cleaning ------------------------------------------------------------------------------------------

_PEOPLE = "customer join nation on c_nationkey = n_nationkey"


def _people(spark, sf_dir):
    people = _table(spark, sf_dir, "customer")
    joined = people.join(_table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
    return joined.repartition(parts_of(people), "c_custkey", "c_name")  # what is built from a row is many times as long


_PAGE = "concat('<html><head><style>p {color: red}</style></head><body><h2>', n_name, '</h2><p>', c_name, ' &amp; <b>tel ', c_custkey, '</b></p>\\n\\n\\n<script>x = 1</script><ul><li>', c_mktsegment, '</li><li>dos</li></ul><a href=\"u', c_custkey, '\">mas</a></body></html>')"


@_query(f"select c_custkey, n_name || chr(10) || c_name || ' &' || chr(10) || 'tel ' || c_custkey || chr(10) || chr(10) || c_mktsegment || chr(10) || 'dos' || chr(10) || 'mas' as limpio from {_PEOPLE}")
def clean_markup(spark, sf_dir):
    """Pages of a few tags: visible text only, one line a piece, runs of blank lines cut to one."""
    return _people(spark, sf_dir).select("c_custkey", X.clean_legal(F.expr(_PAGE)).alias("limpio"))


@_query(f"select c_custkey, '## ' || n_name || chr(10) || chr(10) || c_name || ' & **tel ' || c_custkey || '**' || chr(10) || chr(10) || '* ' || c_mktsegment || chr(10) || '* dos' || chr(10) || '[mas](u' || c_custkey || ')' as markdown from {_PEOPLE}")
def markup_to_markdown(spark, sf_dir):
    return _people(spark, sf_dir).select("c_custkey", X.html_to_markdown(F.expr(_PAGE)).alias("markdown"))


@_query("select doc_id, 'EMBARGÓ \"suma fija\" ' || source || ' ABC 12°' || chr(10) || 'ñandú' as texto from documents")
def text_repair(spark, sf_dir):
    """A wrong code page, curly quotes, ligatures, wide letters, control signs and line ends around the source's name."""
    damaged = F.concat(F.lit("EMBARGÃ“ â€œsuma ﬁja” "), F.col("source"), F.lit("\u0007 ＡＢＣ 12Â°\r\nnÃ".replace("nÃ", "Ã±andÃº")))
    return _docs(spark, sf_dir).select("doc_id", X.fix_text(damaged).alias("texto"))


@_query("select doc_id, 'shchuka ' || lower(source) || ' athena nandu 1/2 strasse -- ?que?' as clave from documents")
def transliteration(spark, sf_dir):
    mixed = F.concat(F.lit("ЩУКА  "), F.upper("source"), F.lit("\nΑθήνα ÑANDÚ ½ Straße — ¿Qué?"))
    return _docs(spark, sf_dir).select("doc_id", X.search_key(mixed).alias("clave"))


@_query("select n_nationkey, '--- antes' || chr(10) || '+++ despues' || chr(10) || '@@ -1,3 +1,4 @@' || chr(10) || ' ' || n_name || chr(10) || '-uno' || chr(10) || '+' || lower(n_name) || chr(10) || '+' || n_regionkey || chr(10) || ' dos' as diff from nation")
def line_diff(spark, sf_dir):
    rows = _table(spark, sf_dir, "nation").withColumns({"antes": F.concat_ws("\n", "n_name", F.lit("uno"), F.lit("dos")), "despues": F.concat_ws("\n", "n_name", F.lower("n_name"), F.col("n_regionkey").cast("string"), F.lit("dos"))})
    return rows.select("n_nationkey", X.unified_diff("antes", "despues").alias("diff"))


_WORST = ["id", "nombre", "ocr_quality_score", "ocr_estado", "len_antes", "len_despues", "porcentaje_reduccion"]


@_query(
    f"with {_CHECKED} select {', '.join('cast(' + c + ' as int) as ' + c if c.startswith('len_') else c for c in _WORST)}, case when length(texto_base) > 1500 then substr(texto_base, 1, 1500) || chr(10) || '[...]' else texto_base end as texto_base, "
    "case when length(limpio) > 1500 then substr(limpio, 1, 1500) || chr(10) || '[...]' else limpio end as texto_limpieza_avanzada from alerts order by ocr_quality_score, id limit 10"
)
def before_after_rows(spark, sf_dir):
    """The rows of the before and after report, but for the diff (a top-k report)."""
    checked = selection.clean_and_check(legal_documents(spark, sf_dir), "texto")
    cut = lambda c: X.crop(F.col(c), 1500).alias(c)
    return selection.extremes(checked, "ocr_quality_score", "id", 10, largest=False).select(*_WORST, cut("texto_base"), cut("texto_limpieza_avanzada"))


# Persons by model ----------------------------------------------------------------------------------


def _persons_text():
    given = F.expr("element_at(array('Ana', 'Luis', 'Eva'), cast(c_custkey % 3 + 1 as int))")
    family = F.expr("element_at(array('Sosa', 'Paz'), cast(c_nationkey % 2 + 1 as int))")
    return F.concat(F.lit("paga "), given, F.lit(" "), family, F.lit(" y luego "), given, F.lit(" "), family, F.lit(" Mayor, con el Oficio Judicial, y "), F.upper(F.concat(given, F.lit(" "), family)), F.lit(" de Paz, DNI 20111222"))


_GIVEN = "(case c_custkey % 3 when 0 then 'Ana' when 1 then 'Luis' else 'Eva' end || ' ' || case c_nationkey % 2 when 0 then 'Sosa' else 'Paz' end)"


@_query(f"with p as (select c_custkey as id, {_GIVEN} as n from {_PEOPLE}) select id, n || ' Mayor' as valor, 'modelo' as metodo, cast(5 + length(n) + 9 as int) as span_inicio, cast(5 + length(n) + 9 + length(n) + 6 as int) as span_fin, 0.5::double as confianza from p")
def model_persons_built(spark, sf_dir):
    """Persons by the built-in model: offices are no persons, and a name that a longer one holds goes."""
    docs = _people(spark, sf_dir).select(F.col("c_custkey").alias("id"), _persons_text().alias("texto"))
    found = extract.with_entities(docs, "texto", model=extract.CapitalRuns, near_id=False, in_order=True)
    rows = found.select("id", F.explode("entidades").alias("e"))
    return rows.filter("e.tipo = 'persona'").select("id", "e.valor", "e.metodo", "e.span_inicio", "e.span_fin", "e.confianza")


_TOKENS = r"regexp_extract_all(texto, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]')"


@_query(
    rf"""with {CTE}, t as (select id, {_TOKENS} as k from legal),
c as (select id, k, unnest(range(0, case when len(k) <= 60 then 1 else cast(ceil((len(k) - 20) / 40.0) as int) end)) as chunk_id from t),
hits as (select distinct 'chunks' as estrategia, id, v from (select id, unnest(regexp_extract_all(array_to_string(k[chunk_id * 40 + 1 : chunk_id * 40 + 60], ' '), '\d{{7,}}')) as v from c)
  union all select distinct 'directo', id, v from (select id, unnest(regexp_extract_all(texto, '\d{{7,}}')) as v from legal)),
cfg as (select 'cifras' as modelo, * from (values ('simple', 'numero'), ('doble', 'dni')) l(labels_set, label), (values (0.35::double), (0.95::double)) t(threshold), (values ('directo'), ('chunks')) e(estrategia))
select id, modelo, labels_set, threshold, cfg.estrategia, label as entidad_label, v as entidad_texto from cfg join hits on cfg.estrategia = hits.estrategia where threshold < 0.9
union all select id, modelo, labels_set, threshold, estrategia, 'SIN_ENTIDADES', null from cfg, legal where threshold > 0.9 or not exists (select 1 from hits where hits.id = legal.id and hits.estrategia = cfg.estrategia)"""
)
def grid_run(spark, sf_dir):
    """Inference under every setting: label sets, thresholds (one above what the demonstration model scores), strategies."""
    docs = legal_documents(spark, sf_dir).select("id", "texto")
    found = entities.run_grid(docs, "texto", {"cifras": lambda: models.digit_runs}, {"simple": ["numero"], "doble": ["dni", "monto"]}, [0.35, 0.95], size=60, overlap=20)
    return found.select("id", "modelo", "labels_set", "threshold", "estrategia", "entidad_label", "entidad_texto")


# Aggregates ----------------------------------------------------------------------------------------


@_query(f"with {_VALID} select id, count(*) as cantidad, avg(score) as score_promedio, min(score) as score_minimo, max(score) as score_maximo from shown group by id")
def score_per_document(spark, sf_dir):
    return entities.score_stats(_predictions(spark, sf_dir).filter(R.not_sentinel(F.col("entidad_label"))), ["id"])


@_query(f"with {_VALID} select id, entidad_label, count(*) as cantidad, avg(score) as score_promedio, min(score) as score_minimo, max(score) as score_maximo from shown group by id, entidad_label")
def score_per_document_label(spark, sf_dir):
    return entities.score_stats(_predictions(spark, sf_dir).filter(R.not_sentinel(F.col("entidad_label"))), ["id", "entidad_label"])


@_query(f"with {_CHECKED} select unnest(['ocr_quality_score', 'len_despues']) as columna, unnest([avg(ocr_quality_score), avg(len_despues)]) as promedio, unnest([min(ocr_quality_score), min(len_despues)]) as minimo, unnest([max(ocr_quality_score), max(len_despues)]) as maximo from alerts")
def score_range(spark, sf_dir):
    return profile.mean_min_max(selection.clean_and_check(legal_documents(spark, sf_dir), "texto"), ["ocr_quality_score", "len_despues"])


# Selection, order, numbers -------------------------------------------------------------------------


@_query("select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) as numero_embargo from orders where o_totalprice in (select o_totalprice from orders group by o_totalprice having count(*) = 1)")
def sequence_numbers(spark, sf_dir):
    """Consecutive numbers by an order without ties."""
    orders = _table(spark, sf_dir, "orders")
    alone = orders.groupBy("o_totalprice").agg(F.count(F.lit(1)).alias("c")).filter("c = 1")
    return profile.numbered(orders.join(alone, "o_totalprice"), "o_totalprice").select("o_orderkey", "numero_embargo")


@_query(f"with {_VALID} select entidad_label, formato_valido_label, requiere_revision_manual, cantidad, row_number() over (order by entidad_label, requiere_revision_manual desc, cantidad desc) as puesto from (select entidad_label, formato_valido_label, requiere_revision_manual, count(*) as cantidad from shown group by all)")
def review_order(spark, sf_dir):
    """The order of the review summary, as a column."""
    rows = entities.review_summary(_predictions(spark, sf_dir)).collect()  # a row per label and flag: a closed set
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows, 1)], "entidad_label string, formato_valido_label boolean, requiere_revision_manual boolean, cantidad long, puesto long")


@_query(f"with {CTE} select id, nombre from legal where cast(id as varchar) in ('1', '7', '39', '999999999')")
def id_lookup(spark, sf_dir):
    return selection.by_ids(legal_documents(spark, sf_dir), [1, "7", 39, 999999999]).select("id", "nombre")


_FLAGS = ["TRUE", " 1", "si", "Sí", "yes", "0", "no", "2.5", "nan", ""]


@_query("select o_orderkey, o_orderkey % 10 in (0, 1, 2, 3, 4, 7, 8) as valor from orders")
def flag_words(spark, sf_dir):
    """Words for true and false, numbers, and what is neither."""
    word = F.get(F.array(*map(F.lit, _FLAGS)), (F.col("o_orderkey") % 10).cast("int"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", R.to_bool(word).alias("valor"))


@_query("select 'documents' as tabla, 'text' as columna, 'OK' as requeridas union all select 'pages', 'html', 'OK' union all select 'supplier', 's_name', 'FALTA'")
def text_column_choice(spark, sf_dir):
    """The column found to hold the text of a table, and whether required ones are there."""
    out = []
    for name, needed in (("documents", ["doc_id", "text"]), ("pages", ["page_id"]), ("supplier", ["s_suppkey", "texto_ocr"])):
        df = _table(spark, sf_dir, name)
        try:
            profile.require_columns(df, needed)
            state = "OK"
        except ValueError:
            state = "FALTA"
        out.append((name, profile.find_text_column(df), state))
    return spark.createDataFrame(out, "tabla string, columna string, requeridas string")


@_query(" union all ".join(f"select '{c}' as columna, avg(length(cast({c} as varchar))) as promedio_caracteres, cast(max(length(cast({c} as varchar))) as int) as max_caracteres, cast(min(length(cast({c} as varchar))) as int) as min_caracteres, count({c}) as valores_no_nulos from documents" for c in ("doc_id", "text", "lang", "source", "n_chars")))
def text_profile_all(spark, sf_dir):
    return profile.text_columns(_docs(spark, sf_dir), all_types=True)


_WORDS = "(case o_orderkey % 3 when 0 then 'PESOS CIEN MIL' when 1 then 'PESOS UN MILLON' else '' end)"


@_query(f"select o_orderkey as id, '$ 150.000,00' as valor, nullif(lower({_WORDS}), '') as en_letras from orders")
def amount_in_words(spark, sf_dir):
    """The amount in words that stands before the figure."""
    text = F.concat(F.lit("hasta cubrir la suma de "), F.expr(_WORDS), F.lit(" $ 150.000,00 con mas costas"))
    found = extract.with_entities(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.alias("texto")), "texto")
    rows = found.select("id", F.explode("entidades").alias("e")).filter("e.tipo = 'MONTO'")
    return rows.select("id", "e.valor", F.lower("e.texto_monto").alias("en_letras"))


# Sources and sinks ---------------------------------------------------------------------------------

_ROUND = "select doc_id, text, lang, source from documents"


def _plain(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", "text", "lang", "source")


@_query(_ROUND)
def csv_round_trip(spark, sf_dir):
    """Quoted multi-line CSV, written and read back."""
    df, path = _plain(spark, sf_dir), scratch(spark, "csv")
    io.write_csv(df, path)
    return io.read_csv(spark, path, df.schema, null_words=False)


@_query(_ROUND)
def json_lines_round_trip(spark, sf_dir):
    df, path = _plain(spark, sf_dir), scratch(spark, "jsonl")
    io.write_json_lines(df, path)
    return spark.read.schema(df.schema).json(path)


@_query(_ROUND)
def json_array_round_trip(spark, sf_dir):
    """An array of objects over several part files, read back object by object."""
    df, path = _plain(spark, sf_dir), scratch(spark, "array")
    io.write_json_array(df, path)
    lines = spark.read.text(path).filter("length(value) > 1").select(F.from_json(F.regexp_replace("value", "^,", ""), df.schema).alias("r"))
    return lines.select("r.*")


@_query("select count(*) as filas, sum(n_chars) as letras, true as existe, false as falta from documents")
def report_round_trip(spark, sf_dir):
    """A one-row report as one JSON object; whether its folder and another one are there."""
    path = scratch(spark, "report")
    io.write_report(_docs(spark, sf_dir).agg(F.count(F.lit(1)).alias("filas"), F.sum("n_chars").alias("letras")), path)
    there = F.lit(io.exists(spark, path)), F.lit(io.exists(spark, path + "_none"))
    return io.read_json(spark, path, lines=True).select("filas", "letras", there[0].alias("existe"), there[1].alias("falta"))


_SAMPLE = "row_number() over (partition by clasificacion order by md5('42:' || id), id)"
_MARKDOWN = "'" + "' || {} || '".join(p.replace("'", "''").replace("\n", "' || chr(10) || '") for p in P.MARKDOWN) + "' || {}"


@_query(f"with {CTE} select lower(clasificacion) || '_' || id || '.md' as archivo, {_MARKDOWN.format('cast(id as varchar)', 'nombre', 'clasificacion', 'texto')} as contenido from (select *, {_SAMPLE} as n from legal) where n <= 3")
def markdown_files(spark, sf_dir):
    """Three documents of each class, written as class_id.md and read back (a sampling operator)."""
    docs = legal_documents(spark, sf_dir)
    docs = docs.withColumn("texto_markdown", X.markdown_document(F.col("id"), F.col("nombre"), F.col("clasificacion"), F.col("texto")))
    path = scratch(spark, "markdown")
    io.write_documents(io.markdown_sample(docs, 3), path, "archivo", "contenido")
    files = io.list_files(spark, path, "*.md").select(F.element_at(F.split("path", "/"), -1).alias("archivo"))
    texts = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("archivo"), F.col("value").alias("contenido"))
    return files.join(texts, "archivo")


@_query(r"select doc_id, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]')) as tokens from documents")
def tokenizer_spans(spark, sf_dir):
    """Token spans by a factory of a tokenizer: here word runs and signs, so that SQL can count them."""
    import re

    def load():
        return lambda text: [m.span() for m in re.finditer(r"\w+|[^\w\s]", text)]

    found = chunks.with_token_spans(_docs(spark, sf_dir).select("doc_id", "text"), "text", load)
    return found.select("doc_id", F.size("_spans").cast("long").alias("tokens"))
