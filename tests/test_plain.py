"""The short way for plain texts against the columns that hold for all texts."""
import random

import pytest
from pyspark.sql import functions as F

from papyrine.functions import metrics as M
from papyrine.functions import patterns as P
from papyrine.functions import plain
from papyrine.functions import text as X
from papyrine.plans.legal import legal_documents

PIECES = [
    *P.LEGAL_TERMS, "DNI", "D.N.I.", "Documento", "C.U.I.L.", "C U I L", "c b u", "CBU", "CUIT", "alias", "pago.perez.1", "causa", "expte.", "Expe.", "xp", "exped1ente", "expediente nro", "expediente n°",
    "embarg0", "bancario", "mercado  pago", "nación", "medida  cautelar", "$", "ARS", "1.234,56", "12/03/2020", "3 de marzo de 2020", "12345678", "20-12345678-3", "20123456783", "2907290729072907290729",
    "a1b2", "AB12", "aaaaa", "-----", "|||| |||", "~~~~", "......", "I1|l", "x", "ñ", "(", "]", ",", ".", ":", "..,", "\n", "\n \n\n", "\r\n", "\t", "\x07", "\x0b", "m0nto", "d n 1", "secretar1a", "cámara", "a_b", "aaaaaaaaaa", "€", "\x1d",
]


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(5)
    made = ["".join(rnd.choice(PIECES) + rnd.choice(["", " ", " ", "\n", "-"]) for _ in range(rnd.choice([0, 1, 3, 8, 30]))) for _ in range(1500)]
    return spark.createDataFrame([(t,) for t in made], "t string").persist()


def test_plain_texts_equal_the_columns(texts):
    c = F.col("t")
    for fast, slow in ((plain.fixed_of(c), X.fixed_columns(c)), (plain.clean_of(c), X.clean_columns(c))):
        assert texts.select(fast.alias("f"), slow.alias("s")).filter("f is not null and not (f <=> s)").limit(3).collect() == []
    rows = texts.withColumn("p", plain.check_of(c)).withColumn("m", plain.measure_of(c)).filter("p is not null")
    assert 500 < rows.count() < 1500  # both ways are taken
    none = F.lit(None).cast(plain.MEASURED)
    fast, slow = M.ocr_metrics(c, None, F.col("m")), M.ocr_metrics(c, None, none)
    limpio = F.col("p.texto")
    fast |= {k: F.col(f"p.{k}") for k in M.has_important(c, "antes_")} | {f"n_{k}": F.col(f"p.n_{k}") for k in P.IMPORTANT} | {"w": F.col("p.palabras_antes"), "v": F.col("p.palabras_despues")}
    slow |= M.has_important(c, "antes_") | {f"n_{k}": v for k, v in M.important_counts(limpio).items()} | {"w": M.word_count(c), "v": M.word_count(limpio)}
    differ = [F.when(~fast[k].eqNullSafe(slow[k]), F.concat_ws("|", F.lit(k), "t")) for k in fast]
    assert rows.select(F.explode(F.filter(F.array(*differ), lambda x: x.isNotNull()))).limit(3).collect() == []


def test_other_texts_are_left_to_the_columns(texts):
    for text in ("a €", "a\x1db", "ç"):
        assert plain.checked(text) is None and plain.measured(text) is None and plain.clean_ocr(text) is None and plain.fix_terms(text) is None


def test_legal_texts_take_the_short_way_in_short_tasks(spark, sf_dir, monkeypatch):
    docs = legal_documents(spark, sf_dir)
    assert docs.filter(plain.check_of(F.col("texto")).isNull()).count() == 0
    monkeypatch.setattr("papyrine.plans.legal.SLICE", 1000)
    assert legal_documents(spark, sf_dir).rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
