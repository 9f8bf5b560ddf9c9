"""Extraction, deduplication, resolution and chunks on hand-made rows."""
import pytest
from pyspark.sql import functions as F

from papyrine.operators import chunks, entities, extract, resolve, selection
from papyrine.operators.extract import ENTITY, money, rich_entities, simple_entities


def test_amount_alternation():
    assert [e["monto_normalizado"] for e in rich_entities("$108.332,50 y $108332,50 y $999 y ARS 81.249")] == [108332.5, 81249.0]
    assert money("$ 1.000.000") == 1000000.0 and money("x") is None


def test_simple_ids():
    got = simple_entities("DNI N° 12.345.678, CUIL 20-12345678-9; CUIT 20-12345678-9; CBU " + "1" * 22)
    assert [(e["etiqueta"], e["valor_normalizado"]) for e in got] == [("DNI", "12345678"), ("CUIL", "20123456789"), ("CBU", "1" * 22)]


def _entity(kind, a, b, value, n=0):
    return {**dict.fromkeys(ENTITY.names), "span_inicio": a, "span_fin": b, "orden": n, "tipo": kind, "valor": value, "valor_normalizado": value}


def _frame(spark, ents, text="x" * 3000):
    from pyspark.sql import types as T

    return spark.createDataFrame([(text, ents)], T.StructType([T.StructField("texto", T.StringType()), T.StructField("entidades", T.ArrayType(ENTITY))]))


def test_order_dedupe_and_partial_persons(spark):
    ents = [_entity("persona", 50, 60, "ANA GOMEZ", 0), _entity("persona", 10, 30, "ANA GOMEZ RUIZ", 1), _entity("persona", 10, 30, "ANA GOMEZ RUIZ", 2), _entity("DNI", 40, 48, "1", 3), _entity("persona", 70, 71, "", 4), _entity("persona", 80, 99, "ANA GOMEZ RUIZ", 5)]
    got = _frame(spark, ents).select(extract.drop_partial_persons(extract.order_and_dedupe(F.col("entidades"))).alias("e")).first()["e"]
    assert [(e["tipo"], e["span_inicio"]) for e in got] == [("DNI", 40), ("persona", 10), ("persona", 80)]


@pytest.mark.parametrize("spans,most,want", [([(95, 99), (121, 130)], 500, 0), ([(90, 99), (121, 122)], 500, 0), ([(105, 110), (98, 99)], 500, 0), ([(620, 630)], 500, 0), ([(621, 630)], 500, None)])
def test_nearest(spark, spans, most, want):
    df = _frame(spark, [_entity("persona", 100, 120, "P")] + [_entity("DNI", a, b, str(i), i) for i, (a, b) in enumerate(spans)])
    got = df.select(resolve.nearest(F.col("entidades")[0], F.filter("entidades", lambda e: e["tipo"] == "DNI"), most).alias("n")).first()["n"]
    assert (got and got["valor"]) == (None if want is None else str(want))


def test_empty_document(spark):
    df = spark.createDataFrame([(1, "f", "Embargo", None), (2, "f", "Embargo", "")], "id long, nombre string, clasificacion string, texto string")
    for r in resolve.summary(resolve.process(df)).collect():
        assert r["cantidad_entidades_encontradas"] == 0 and r["revision_manual"]
        assert r["motivos_revision"].split(" | ") == ["No se detectó persona embargada", "No se detectó DNI/CUIL/CUIT asociado a la persona", "No se detectó monto principal", "No se detectó cuenta de depósito"]


def test_model_spans_are_in_the_whole_text(spark):
    text = "z " * 1300 + "\nMARIA SOSA RUIZ firma"
    df = spark.createDataFrame([(1, text)], "id long, texto string")
    got = extract.with_entities(df, "texto", model=extract.CapitalRuns, near_id=False).first()["entidades"]
    assert {text[e["span_inicio"] : e["span_fin"]] for e in got if e["tipo"] == "persona"} == {"MARIA SOSA RUIZ"}


@pytest.mark.parametrize("n", [0, 1, 10, 11, 17, 18, 40])
def test_chunks_follow_the_loop(spark, n):
    text, size, overlap = " ".join(f"t{i}" for i in range(n)), 10, 3
    want, at, toks = [], 0, text.split()
    while toks:
        want.append(toks[at : at + size])
        if at + size >= n:
            break
        at += size - overlap
    df = spark.createDataFrame([(text,)], "t string")
    got = [r["texto_chunk"].split() for r in chunks.token_chunks(df, "t", size, overlap).orderBy("chunk_id").collect()]
    assert got == want
    pieces = [r["texto_chunk"] for r in chunks.char_chunks(df, "t", 10, 3).orderBy("chunk_id").collect()]
    assert len(pieces) == (1 if len(text) <= 10 else -(-(len(text) - 3) // 7)) and pieces[0] == text[:10]


def test_chunk_overlap_must_be_smaller(spark):
    with pytest.raises(ValueError):
        chunks.token_chunks(spark.createDataFrame([("a",)], "t string"), "t", 5, 5)


def test_dedupe_best(spark):
    rows = [(1, "DNI", "DNI 1", None), (1, "DNI", "dni  1", 0.5), (1, "DNI", "DNI 1", 0.9), (1, "DNI", "DNI 1.0", 0.1)]
    got = extract.dedupe_best(spark.createDataFrame(rows, "id int, etiqueta string, texto string, score double"))
    assert sorted(r["score"] for r in got.collect()) == [0.1, 0.9]


@pytest.mark.parametrize("legible,want", [(14, {"legible": 14, "regular": 1}), (15, {"legible": 15}), (40, {"legible": 15})])
def test_regular_documents_join_where_few_are_legible(spark, legible, want):
    df = spark.range(60).select("id", F.when(F.col("id") < legible, "legible").when(F.col("id") < 45, "regular").otherwise("muy_ruidoso").alias("ocr_estado"))
    df = df.withColumns({"texto_limpieza_avanzada": F.lit("x"), "palabras_despues": F.lit(200), "porcentaje_reduccion": F.lit(0.0), "alerta_posible_perdida_datos": F.lit(False), "ocr_quality_score": 1 - F.col("id") / 100})
    got = selection.top_for_model(df).collect()
    assert {k: sum(r["ocr_estado"] == k for r in got) for k in {r["ocr_estado"] for r in got}} == want
    assert [r["id"] for r in got] == list(range(15))


@pytest.mark.parametrize("usable,top", [(4, 0.5), (5, 0.5), (9, 0.5), (4, 60.0), (9, 60.0)])
def test_all_documents_join_where_few_are_usable(spark, usable, top):
    """Against the plain rule; one percentage of ``top`` decides how the column is read."""
    df = spark.range(12).select("id", F.when(F.col("id") < usable, "legible").otherwise("irrecuperable").alias("ocr_estado"), F.repeat(F.lit("a"), (F.col("id") * 10 + 400).cast("int")).alias("texto"))
    df = df.withColumn("porcentaje_reduccion", F.when(F.col("id") == 11, top).otherwise(F.col("id") / 20))
    ranked = {r["id"]: r["ranking_80_score"] for r in selection.ranking(df, "texto").collect()}
    pool = range(usable) if usable >= 5 else range(12)
    want = sorted(pool, key=lambda i: (-ranked[i], -i))[:5]
    got = selection.select_top(df, "texto", most=5).collect()
    assert [r["id"] for r in got] == want and [r["ranking_80_score"] for r in got] == [ranked[i] for i in want]


@pytest.mark.parametrize("top,shown", [(1.0, 50.0), (1.01, 0.5)])
def test_reduction_scale_is_one_decision(spark, top, shown):
    df = spark.createDataFrame([(1, "a" * 700, 0.5), (2, "b" * 700, top)], "id long, texto string, porcentaje_reduccion double")
    r = selection.ranking(df, "texto").filter("id = 1").first()["ranking_80_score"]
    base = 700 / 6000 * 30
    assert r == pytest.approx(round(base - 0.25 * shown + (8 if shown <= 35 else 0), 4))


def test_label_pivot_and_lists(spark):
    df = spark.createDataFrame([(1, "DNI"), (1, "DNI"), (1, "CBU"), (2, "CBU")], "id int, etiqueta string")
    got = {r["id"]: r for r in entities.label_pivot(df, ["DNI", "CBU", "CVU"]).collect()}
    assert (got[1]["entidades_DNI"], got[1]["entidades_CVU"], got[2]["entidades_DNI"]) == (2, None, None)
    assert {r["id"]: r["etiquetas_encontradas"] for r in entities.document_labels(df).collect()} == {1: "CBU, DNI", 2: "CBU"}


def test_prediction_shapes():
    from papyrine.operators.models import spans

    text = "ANA vive en LIMA"
    assert list(spans(["ANA", "x"], text, "p")) == [("ANA", "p", None, 0, 3), ("x", "p", None, None, None)]
    assert list(spans({"entities": {"p": ["ANA"], "l": [{"text": "LIMA", "confidence": 0.5}]}}, text)) == [("ANA", "p", None, 0, 3), ("LIMA", "l", 0.5, 12, 16)]
    assert list(spans([{"span": "ANA", "label": "p", "start": 0, "end": 3, "score": 1}], text)) == [("ANA", "p", 1.0, 0, 3)]
    assert list(spans({"start": 12, "end": 16, "label": "l"}, text)) == [("LIMA", "l", None, 12, 16)]


def test_every_document_gives_a_row(spark):
    from papyrine.operators import models

    def load():
        def model(text, labels, threshold):
            if "boom" in text:
                raise RuntimeError("no")
            return models.digit_runs(text, labels, threshold)

        return model

    df = spark.createDataFrame([(1, None), (2, " "), (3, "nada"), (4, "boom"), (5, "n 1234567 y 7654321")], "id long, texto string")
    for found in (models.predict(df, "texto", load, ["n"]), models.predict_chunks(df, "texto", load, ["n"], size=3, overlap=1)):
        got = sorted({(r["id"], r["entidad_label"], r["entidad_texto"]) for r in found.collect()}, key=str)
        assert got == [(1, "SIN_TEXTO", None), (2, "SIN_TEXTO", None), (3, "SIN_ENTIDADES", None), (4, "ERROR", None), (5, "n", "1234567"), (5, "n", "7654321")]


class FakeLibraryModel:
    """What a model library returns, with its interface."""

    opened = 0

    def predict_entities(self, text, labels, threshold=0.5):
        if "boom" in text:
            raise RuntimeError("no")
        return [{"text": m, "label": labels[0], "start": text.index(m), "end": text.index(m) + len(m), "score": 0.8} for m in text.split() if m.istitle() and threshold <= 0.8]

    def batch_predict_entities(self, texts, labels, threshold=0.5):
        return [self.predict_entities(t, labels, threshold) for t in texts]


def _open_fake(path):
    FakeLibraryModel.opened += 1
    return FakeLibraryModel()


def test_pretrained_model_is_opened_once_and_asked_in_batches(spark):
    from papyrine.operators import models

    load = models.pretrained("/no/such/folder", _open_fake)
    assert load() is load() and FakeLibraryModel.opened == 1
    df = spark.createDataFrame([(1, "paga Ana"), (2, "boom Ana"), (3, "nada"), (4, None)], "id long, texto string").coalesce(1)
    got = sorted({(r["id"], r["entidad_label"], r["entidad_texto"], r["start"]) for r in models.predict(df, "texto", load, ["persona"]).collect()}, key=str)
    assert got == [(1, "persona", "Ana", 5), (2, "ERROR", None, None), (3, "SIN_ENTIDADES", None, None), (4, "SIN_TEXTO", None, None)]
    assert load().persons("hoy Ana Paz") == [(4, 7, 0.8), (8, 11, 0.8)]
    found = extract.with_entities(df.filter("id = 1"), "texto", model=load, near_id=False)
    assert found.first()["entidades"] == []  # three letters are no candidate
    with pytest.raises(RuntimeError, match="library"):
        models.pretrained("/no/such/folder")()


def test_sub_word_chunks(spark):
    """Chunks by a tokenizer file against the library itself."""
    from tokenizers import Tokenizer

    path = "/opt/tokenizers/" + next(n for n in sorted(__import__("os").listdir("/opt/tokenizers")) if n.endswith(".json"))
    lib, texts = Tokenizer.from_file(path), ["Se ha decretado el embargo sobre los fondos. " * 8, "uno", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, texto string")
    got = chunks.token_chunks(df, "texto", 20, 5, chunks.tokenizer_file(path)).orderBy("id", "chunk_id").collect()
    want = []
    for i, t in enumerate(texts):
        spans = [s for s in lib.encode(t or "", add_special_tokens=False).offsets if s[1] > s[0]]
        n = len(spans)
        for c in range(0 if not n else 1 if n <= 20 else -(-(n - 5) // 15)):
            part = spans[c * 15 : c * 15 + 20]
            want.append((i, c, len(part), t[part[0][0] : part[-1][1]]))
    assert [(r["id"], r["chunk_id"], r["n_tokens_chunk"], r["texto_chunk"]) for r in got] == want


def test_chunks_of_plain_and_other_texts_are_cut_alike(spark):
    texts = ["", " ", "a", "a b_1, c-d.", "uno dos tres cuatro cinco seis", "\tx\n\ny\x0bz!", "a\x1fb"]
    odd = [t + "ñ" for t in texts]  # the columns cut these
    df = spark.createDataFrame([*enumerate(texts), *((i + 100, t) for i, t in enumerate(odd))], "id int, t string")
    got = {(r.id, r.chunk_id): r.texto_chunk.split(" ") for r in chunks.token_chunks(df, "t", 3, 1).collect()}
    word = __import__("re").compile(r"\w+|[^\w\s]")
    for i, text in [*enumerate(texts), *((i + 100, t) for i, t in enumerate(odd))]:
        tokens = word.findall(text) if "\x1f" not in text else None
        if tokens is not None:
            assert [got[k] for k in sorted(got) if k[0] == i] == [tokens[b : b + 3] for b in range(0, max(len(tokens) - 1, 1), 2) if tokens]


def test_inference_of_all_settings_reads_the_texts_once_per_strategy(spark):
    from papyrine.operators import entities, models

    docs = spark.createDataFrame([(1, "n 1234567"), (1, "nada"), (None, "n 7654321"), (None, "nada"), (2, "x " * 9 + "8888888")], "id long, t string")
    found = entities.run_grid(docs, "t", {"m": lambda: models.digit_runs}, {"a": ["x"], "b": ["y"]}, [0.1, 0.95], size=4, overlap=1)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    got = sorted((str(r.id), r.labels_set, r.threshold, r.entidad_label, str(r.entidad_texto)) for r in found.filter("estrategia = 'chunks' and labels_set = 'a'").collect())
    none = "SIN_ENTIDADES"
    assert got == [
        ("1", "a", 0.1, "x", "1234567"), ("1", "a", 0.95, none, "None"), ("2", "a", 0.1, "x", "8888888"), ("2", "a", 0.95, none, "None"),
        ("None", "a", 0.1, none, "None"), ("None", "a", 0.1, "x", "7654321"), ("None", "a", 0.95, none, "None"),
    ]


def test_token_spans_of_many_texts_are_plain_numbers(spark):
    texts = ["", "a b", None, "ñandú x"] * 200
    load = lambda: lambda text: [m.span() for m in __import__("re").finditer(r"\w+", text)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)
    want = {0: [], 1: [(0, 1), (2, 3)], 2: [], 3: [(0, 5), (6, 7)]}
    got = chunks.with_token_spans(df, "t", load).collect()
    assert len(got) == 800 and all([tuple(s) for s in r["_spans"]] == want[r.id % 4] for r in got)


def test_both_parts_are_counted_in_one_pass(spark):
    from papyrine.operators import entities

    rows = spark.createDataFrame([("dni", True), ("dni", False), ("SIN_TEXTO", True), ("monto", True)], "entidad_label string, requiere_revision_manual boolean")
    found = entities.trusted_counts(rows)
    assert sorted(map(tuple, found.collect())) == [("confiables", 1), ("revisar", 2)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
