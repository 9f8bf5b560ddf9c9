"""OCR quality metrics, scores and ranking arithmetic."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions import patterns as P
from papyrine.functions import plain
from papyrine.functions.text import ICASE, legal_terms_pattern, strip, text_of

LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def word_count(c: Column) -> Column:
    return count(text_of(c), r"(?U)\b\w+\b")


def space_word_count(c: Column) -> Column:
    text = F.trim(F.regexp_replace(text_of(c), r"(?U)\s+", " "))
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def odd_characters(c: Column) -> Column:
    """Characters that do not print, line ends included."""
    return count(text_of(c), r"[\p{C}]|[\p{Z}&&[^ ]]")


def important_counts(c: Column) -> dict[str, Column]:
    text = text_of(c)
    return {name: count(text, ICASE + p) for name, p in P.IMPORTANT.items()}


def has_important(c: Column, prefix: str) -> dict[str, Column]:
    text = text_of(c)
    return {f"{prefix}{name}": text.rlike(ICASE + "(?:" + p + ")") for name, p in P.IMPORTANT.items()}


def _class(signs: str) -> str:
    return "".join("\\" + s if not s.isalnum() and s not in "\n\r\t " else s for s in signs)


def ocr_metrics(c: Column, important: Column | None = None, known: Column | None = None) -> dict[str, Column]:
    """The fifteen metrics of a text; an empty text has ratios 1 where 0 would flatter it.

    ``important``: the sum of ``important_counts``, ``known``: the ``plain.COUNTS`` of plain texts, where they are at hand already.
    """
    text = text_of(c)
    known = plain.measure_of(text) if known is None else known
    size = F.length(text)
    or_else = lambda name, slow: F.coalesce(known[name], slow)
    per = lambda n: F.when(size > 0, n / size)
    # A final line end opens no further line; F.split drops nothing, so the last empty part goes.
    lines = F.transform(F.split(F.regexp_replace(text, f"(?:{LINE_ENDS})$", ""), LINE_ENDS), strip)
    tokens = F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda t: t != "")
    words = or_else("len_words", word_count(c))
    rare = F.length(F.regexp_replace(text, rf"(?U)[\p{{L}}\p{{N}}\s\x1c-\x1f{_class(P.ALLOWED_SIGNS)}]", ""))
    hidden = count(text, r"[\p{C}&&[^\n\r\t]]|[\p{Z}&&[^ ]]")
    usual = r"^(?:\d+[/-]\d+|[A-Z]{1,4}\d+|\d+[A-Z]{1,4})$"
    weird = F.size(F.filter(tokens, lambda t: t.rlike(f"[{P.LATIN}]") & t.rlike(r"(?U)\d") & ~t.rlike(ICASE + usual)))
    if important is None:
        important = or_else("important_data_count", sum(important_counts(c).values(), F.lit(0)))
    return {
        "len_chars": size,
        "len_words": words,
        "ratio_alpha": F.coalesce(per(or_else("alpha", count(text, r"\p{L}"))), F.lit(0.0)),
        "ratio_digits": F.coalesce(per(or_else("digits", count(text, r"\p{Nd}"))), F.lit(0.0)),
        "ratio_rare_symbols": F.coalesce(per(or_else("rare", rare)), F.lit(1.0)),
        "ratio_non_printable": F.coalesce(per(or_else("hidden", hidden)), F.lit(1.0)),
        "line_breaks": or_else("line_breaks", count(text, "\n")),
        "one_letter_words": or_else("one_letter_words", count(text, r"(?U)\b\p{L}\b")),
        "weird_alnum_tokens": or_else("weird_alnum_tokens", weird),
        "repeated_char_tokens": or_else("repeated_char_tokens", F.size(F.filter(tokens, lambda t: t.rlike(r"(.)\1{4,}")))),
        "near_empty_lines": or_else("near_empty_lines", F.size(F.filter(lines, lambda x: F.length(x).between(1, 2)))),
        "symbol_only_lines": or_else("symbol_only_lines", F.size(F.filter(lines, lambda x: x.rlike(f"^[^{P.LATIN}0-9]+$")))),
        "legal_terms_count": or_else("legal_terms_count", count(text, ICASE + legal_terms_pattern())),
        "normal_word_ratio": F.when(size > 0, or_else("normal_words", count(text, f"[{P.LATIN}]{{2,}}")) / F.greatest(words, F.lit(1))).otherwise(0.0),
        "important_data_count": important,
    }


def _cap(c: Column) -> Column:
    return F.least(c, F.lit(1.0))


def ocr_score(m: str = "") -> Column:
    """Quality from 0 to 1 out of the metric columns (their names may carry a prefix)."""
    col = lambda name: F.col(m + name).cast("double")
    words = F.greatest(col("len_words"), F.lit(1.0))
    good = (
        0.18 * _cap(col("len_chars") / 2500)
        + 0.12 * _cap(col("len_words") / 350)
        + 0.18 * _cap(col("ratio_alpha") / 0.68)
        + 0.18 * _cap(col("normal_word_ratio") / 0.78)
        + 0.20 * _cap(col("legal_terms_count") / 12)
        + 0.14 * _cap(col("important_data_count") / 6)
    )
    bad = (
        0.22 * _cap(col("ratio_rare_symbols") / 0.04)
        + 0.18 * _cap(col("ratio_non_printable") / 0.01)
        + 0.18 * _cap(col("one_letter_words") / words / 0.20)
        + 0.18 * _cap(col("weird_alnum_tokens") / words / 0.08)
        + 0.12 * _cap(col("repeated_char_tokens") / words / 0.05)
        + 0.12 * _cap(col("symbol_only_lines") / (col("line_breaks") + 1) / 0.20)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), good * (1 - 0.55 * bad)))


def ocr_quality_state(score: Column, words: Column) -> Column:
    return F.when((words < 80) | (score < 0.22), "irrecuperable").when(score < 0.42, "muy_ruidoso").when(score < 0.65, "regular").otherwise("legible")


def reduction(before: Column, after: Column) -> Column:
    return F.when(before > 0, (before - after) / before).otherwise(0.0)


def selection_score() -> Column:
    """Rank for the next stage: quality, length, indicators and how little was removed."""
    return (
        F.col("ocr_quality_score") * 0.55
        + _cap(F.col("palabras_despues") / 700) * 0.15
        + _cap(F.col("cantidad_indicadores_importantes") / 8) * 0.20
        + (1 - F.least(F.greatest(F.col("porcentaje_reduccion"), F.lit(0.0)), F.lit(1.0))) * 0.10
    )


def measure(df: DataFrame, text_col: str, important: Column | None = None, known: Column | None = None) -> DataFrame:
    """Append the metrics, the score and the quality state of a text column."""
    df = df.withColumns(ocr_metrics(F.col(text_col), important, known))
    df = df.withColumn("ocr_quality_score", ocr_score())
    return df.withColumn("ocr_estado", ocr_quality_state(F.col("ocr_quality_score"), F.col("len_words")))
