"""Finding and choosing in one pass against the old matching and the choices by expressions."""
import random

import pytest
from pyspark.sql import functions as F

from papyrine.functions import plain
from papyrine.operators import extract, resolve

PIECES = [
    "Sr.", "Sra", "Señor", "JUAN", "Perez", "maria", "ñandú", "titular del", "DNI", "D.N.I.", "d.n.l.", "DN!", "documento", "doc.", "CBU", "cvu", "N°", "CUIT", "cuil", "C.U.I.L.", "20-12345678-3", "20123456783",
    "12.345.678", "12345678", "2907290729072907290729", "alias", "pago.perez", "$", "ARS", "pesos", "1.234,56", "150.000", "PESOS CIEN MIL CON 10/100", "con mas la suma", "hasta cubrir", "c/", "los autos que ordenan",
    "embargado", "del sr.", "banco", "juez", "firmado por", "usuario conectado", "(", "[", ",", ".", "\n", "x", "ü", "€",
]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(7)
    names = ["Sr. JUAN PEREZ, DNI 12345678", "MARIA GOMEZ titular del DNI 7654321", "LUIS PAZ (DNI 1234567"]
    return ["".join(rnd.choice(PIECES if rnd.random() < 0.9 else names) + rnd.choice(["", " ", " ", "\n", ", ", ": "]) for _ in range(rnd.choice([0, 3, 8, 30, 60]))) for _ in range(1500)]


def test_matches_are_those_of_finditer(texts, monkeypatch):
    find = lambda: [(list(extract.persons_near_id(t)), list(extract.rich_entities(t)), extract.simple_entities(t)) for t in texts]
    fast = find()
    monkeypatch.setattr(plain, "lower_if_plain", lambda t: None)
    assert fast == find()
    assert sum(len(f[0]) for f in fast) > 100


def test_resolved_equals_resolve(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, texto string")
    fast = resolve.resolved(docs)
    slow = resolve.resolve(extract.with_entities(docs, "texto")).select(fast.columns)
    best = [c for c in fast.columns if c.startswith("best_")]
    text = lambda df: df.select("id", F.to_json(F.struct("entidades", *best)).alias("j"))
    both = text(fast).join(text(slow).withColumnRenamed("j", "k"), "id")
    assert both.filter("j <> k").limit(2).collect() == []
    assert fast.filter("best_persona is not null and best_dni is not null and best_monto is not null").count() > 30


def test_audit_of_plain_texts_is_that_of_the_patterns(texts):
    from papyrine.functions import patterns as P

    seen = [(t, found) for t in texts if (found := plain.audited(t)) is not None]
    assert len(seen) > 500
    for text, found in seen:
        assert found == [bool(__import__("re").search(p, text, 2)) for p in P.AUDIT.values()]
