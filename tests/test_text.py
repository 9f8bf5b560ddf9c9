"""Cleaning and normalisation on hand-made rows, and against Python's own functions."""
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from papyrine.functions import metrics as M
from papyrine.functions import predicates as R
from papyrine.functions import text as X


def apply(spark, column, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", column(F.col("v")).alias("out")).orderBy("i").select("out").collect()]


def test_ocr_state_in_order(spark):
    values = [None, "", "   ", "\\n", "xx Error al descargar el archivo desde el bucket yy", "a" * 49, "a" * 50, " "]
    assert apply(spark, R.ocr_state, values) == ["nulo", "vacio", "vacio", "solo_salto_linea", "error_descarga_bucket", "texto_muy_corto", "ok", "vacio"]


def test_money(spark):
    values = ["$108.332,50", "$81.249", "ARS 10,5", "12.5", "1.234.567", "pesos", None, "1,2,3"]
    assert apply(spark, X.money_ar, values) == [108332.5, 81249.0, 10.5, 12.5, 1234567.0, None, None, None]


def test_person_names(spark):
    values = ["Dra. ANA GOMEZ", "JUAN PEREZ JUEZ", "Banco Nacion", " .MARIA SOSA; ", "x1", "DNI 20111222", "Fdo. LUIS A. RUIZ SECRETARIO", None]
    assert apply(spark, X.person_name, values) == ["ANA GOMEZ", "JUAN PEREZ", "Banco Nacion", "MARIA SOSA", "x1", "DNI 20111222", "LUIS A. RUIZ", ""]
    assert apply(spark, R.valid_person, values) == [True, True, False, True, False, False, True, False]


def test_clean_legal(spark):
    values = [None, "a\r\nb\rc", "x\t y   z ", "\n\n\n\na\n\n\n\nb", "<p>uno &amp; dos</p><script>no()</script><b>tres</b>", "“q” ‘r’"]
    assert apply(spark, X.clean_legal, values) == ["", "a\nb\nc", "x y z", "a\n\nb", "uno & dos\ntres", "\"q\" 'r'"]


def test_search_key(spark):
    assert apply(spark, X.search_key, ["  ÁRBOL\nñandú  ", None, "Straße Œuvre"]) == ["arbol nandu", "", "strasse oeuvre"]


def test_html_to_markdown(spark):
    got = apply(spark, X.html_to_markdown, ["<h2>T</h2><p>a <b>b</b> <a href='u'>l</a></p><ul><li>x</li><li>y</li></ul>"])[0]
    assert "## T" in got and "a **b** [l](u)" in got and "* x\n* y" in got


def test_normalise_joins_lines_before_punctuation(spark):
    assert apply(spark, X.normalise_ocr, ["uno\n, dos", "a.....b", "( x )", "a\n\n\n\n\n\nb", "ﬁn Nº 5​"]) == ["uno, dos", "a.b", "(x)", "a\n\n\nb", "fin No 5"]


def test_terms_become_lower_case_and_rule_three_is_not_idempotent(spark):
    assert apply(spark, X.fix_terms, ["JUZGADO", "EMBARG0", "secretaria", "c b u", "expediente nro."]) == ["juzgado", "embargo", "secretaría", "CBU", "expediente nro.."]


def test_clean_ocr_drops_noise_and_keeps_data(spark):
    text = "Linea uno con texto\n|||| |||\n-----\nab\nDNI 20111222 !!\n\n\n\naaaaaaaaaaaa fin"
    assert apply(spark, X.clean_ocr, [text]) == ["Linea uno con texto\n\nDNI 20111222!!\n\naaa fin"]  # a line of bars becomes a blank one


def test_mask_cuts_first(spark):
    assert apply(spark, X.mask, ["a@b.com 20-12345678-9 12.345.678 $ 10,50\nfin"]) == ["[EMAIL] [CUIT/CUIL] [DNI] [MONTO] fin"]
    assert len(apply(spark, X.mask, ["x" * 400])[0]) == 300


def test_crop(spark):
    assert apply(spark, lambda c: X.crop(c, 3), ["abc", "abcd", None]) == ["abc", "abc\n[...]", ""]


@pytest.mark.parametrize("value,label,ok", [("20111222", "dni", True), ("2011122", "dni", True), ("201112", "dni", False), ("20-20111222-3", "cuil", True), ("99-20111222-3", "cuit", False), ("1" * 22, "cbu", True), ("$ 10", "monto", True), ("10", "monto", False), ("a1b", "expediente", True), ("a@b.gov", "destino de transferencia", False), ("x", "persona", True)])
def test_formats(spark, value, label, ok):
    df = spark.createDataFrame([(label, value)], "l string, v string")
    assert df.select(R.valid_format(F.col("l"), F.col("v"))).first()[0] is ok


def test_metrics_of_an_empty_text(spark):
    row = spark.createDataFrame([("",), (None,)], "t string").select(*[c.alias(k) for k, c in M.ocr_metrics(F.col("t")).items()]).collect()
    for r in row:
        assert (r["len_chars"], r["ratio_alpha"], r["ratio_rare_symbols"], r["ratio_non_printable"]) == (0, 0.0, 1.0, 1.0)


def test_metrics_against_python(spark):
    texts = ["Hola, mundo! ¿Qué tal? §¶ aaaaa b 12ab\n--\nx", "línea uno\n\n...\n a 1/2 A12 3b\x07"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[c.alias(k) for k, c in M.ocr_metrics(F.col("t")).items()])
    for r in df.collect():
        t = r["t"]
        words = re.findall(r"\b\w+\b", t)
        assert r["len_words"] == len(words)
        assert r["one_letter_words"] == sum(len(w) == 1 and w.isalpha() for w in words)
        assert r["ratio_alpha"] == pytest.approx(sum(map(str.isalpha, t)) / len(t))
        assert r["ratio_non_printable"] == pytest.approx(sum(not c.isprintable() and c not in "\n\r\t" for c in t) / len(t))
        allowed = set(".,;:()[]{}¿?¡!/-_+$%&@#°ºª'\"\n\r\t ")
        assert r["ratio_rare_symbols"] == pytest.approx(sum(not c.isalnum() and not c.isspace() and c not in allowed for c in t) / len(t))
        assert r["repeated_char_tokens"] == sum(bool(re.search(r"(.)\1{4,}", k)) for k in t.split())
    assert unicodedata.category("\x07") == "Cc"


def test_text_repair():
    """Texts damaged in known ways come back, and sound ones stay."""
    sound = ["EMBARGÓ la suma", "ÑANDÚ “x”", "1° ¿qué? á é í ó ú ü ñ", "naïve façade", "日本 ok", "a\tb\nc"]
    for s in sound:
        for code in ("cp1252", "latin-1"):
            damaged = "".join(bytes([b]).decode(code, "replace") if code == "latin-1" or b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in s.encode())
            if "日" not in s:
                assert X.repair_encoding(damaged) == s
        assert X.repair_encoding(s) == s
    assert X.repair_text("a&amp;b \ufb01n \x1b[31mrojo\x1b[0m\x07 \uff21\uff22\u3000z\r\n\u2028fin\ufeff") == "a&b fin rojo AB z\n\nfin"
    assert X.repair_text("<p>a &amp; b</p>") == "<p>a &amp; b</p>" and X.repair_text("cafe\u0301") == "café"
    assert X.fold_letters("щука ½ straße — «x» αθηνα") == "shchuka 1/2 strasse -- <<x>> athena"
