"""Pieces of the SQL that the queries are held against, written from the same fixed values."""
from __future__ import annotations

from papyrine.functions import patterns as P


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    return quote("(?i)" + pattern)


def any_of(text: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({text}, {quote(w)})" for w in words) + ")"


def hits(text: str, words: list[str]) -> str:
    return "(" + " + ".join(f"cast(contains({text}, {quote(w)}) as int)" for w in words) + ")"


def points(test: str, worth: float) -> str:
    return f"(case when {test} then cast({worth} as double) else cast(0 as double) end)"


def before(text: str, at: str, size: int) -> str:
    return f"lower(substr({text}, greatest({at} - {size}, 0) + 1, {at} - greatest({at} - {size}, 0)))"


def after(text: str, at: str, size: int) -> str:
    return f"lower(substr({text}, {at} + 1, {size}))"


def replace_all(text: str, rules: list[tuple[str, str]]) -> str:
    for pattern, new in rules:
        text = f"regexp_replace({text}, {quote(pattern)}, {quote(new)}, 'g')"
    return text


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {quote(pattern)}))"


def word_count(text: str) -> str:
    return count(text, r"[\p{L}\p{M}\p{N}_]+")


def state(text: str) -> str:
    s = strip(text)
    return (
        f"(case when {text} is null then 'nulo' when {s} = '' then 'vacio' when {s} = '\\n' then 'solo_salto_linea' "
        f"when contains({s}, {quote(P.DOWNLOAD_ERROR)}) then 'error_descarga_bucket' when length({s}) < {P.SHORT_TEXT} then 'texto_muy_corto' else 'ok' end)"
    )


def same_runs(least: int) -> str:
    """A run of one printable ASCII character (RE2 has no back-references)."""
    return "(?:" + "|".join(f"\\x{c:02x}{{{least},}}" for c in range(33, 127)) + ")"


def legal_terms() -> str:
    return r"(?i)\b(?:" + "|".join(sorted(P.LEGAL_TERMS, key=len, reverse=True)) + r")\b"


def important_line() -> str:
    return "(?i)(?:" + legal_terms()[4:] + "|" + "|".join(f"(?:{p})" for p in P.IMPORTANT.values()) + ")"


def clean_ocr(text: str) -> str:
    """The OCR clean-up for ASCII texts without runs of letters or digits on unimportant lines."""
    t = replace_all(text, [("\r\n?", "\n"), ("\t", " "), (r"[ ]+", " "), (r" *\n *", "\n"), (r"([,.;:!?])\s*(?:[,.;:!?]){2,}", r"\1"), (r"\s+([,.;:!?])", r"\1"), (r"([({\[])\s+", r"\1"), (r"\s+([)}\]])", r"\1"), (r"\n{4,}", "\n\n\n")])
    t = strip(t)
    t = replace_all(t, [(("(?i)" if any_case else "") + p, new) for p, new, any_case in P.TERM_FIXES])
    important = f"(regexp_matches(x, {quote(important_line())}))"
    kept = replace_all(strip(replace_all("x", [("[ ]{2,}", " ")])), [(r"\s+([,.;:])", r"\1")])
    other = strip(replace_all("x", [(r"(?:\|\s*){3,}", " "), (r"[_~]{3,}", " "), (r"-{4,}", " -- "), (r"\.{5,}", " ... "), (r"[ ]{2,}", " ")]))
    y = strip("x")
    garbage = (
        rf"({y} <> '' and (regexp_matches({y}, '^[|!¡¿?\-_=~*#.:;,/\\\s]{{3,}}$') or regexp_matches({y}, '^(?:[|Il1]\s*){{4,}}$') "
        rf"or regexp_matches({y}, '^(?:[_\-~=.]{{2,}}\s*)+$') or (length({y}) <= 2 and not regexp_matches({y}, '\d')) "
        rf"or (length({y}) <= 5 and regexp_matches({y}, '^[^{P.LATIN}0-9]*[{P.LATIN}]?[^{P.LATIN}0-9]*$')) "
        rf"or (length({y}) >= 8 and length(regexp_replace({y}, '[\p{{L}}\p{{N}}\s]', '', 'g')) > 0.75 * length({y}))))"
    )
    lines = f"list_transform(string_split({t}, chr(10)), lambda x: case when {important} then {kept} else {other} end)"
    lines = f"list_filter({lines}, lambda x: {important} or not {garbage})"
    joined = f"array_to_string({lines}, chr(10))"
    return strip(replace_all(joined, [(r"\n(?:[ ]*\n){2,}", "\n\n"), ("[ ]{2,}", " ")]))


def metrics(text: str) -> dict[str, str]:
    """The fifteen metrics; texts are ASCII letters, digits and common signs."""
    tokens = rf"list_filter(regexp_split_to_array({text}, '\s+'), lambda k: k <> '')"
    words = rf"regexp_extract_all({text}, '[\p{{L}}\p{{M}}\p{{N}}_]+')"
    lines = rf"list_transform(string_split(regexp_replace({text}, '\n$', ''), chr(10)), lambda k: trim(k))"
    allowed = "".join("\\" + s if s in "\\]^-[" else s for s in P.ALLOWED_SIGNS if s not in "\n\r\t ")
    per = lambda n: f"(cast({n} as double) / length({text}))"
    return {
        "len_chars": f"length({text})",
        "len_words": word_count(text),
        "ratio_alpha": per(count(text, r"\p{L}")),
        "ratio_digits": per(count(text, r"\p{Nd}")),
        "ratio_rare_symbols": per(f"length(regexp_replace({text}, {quote(r'[\p{L}\p{N}\s' + allowed + ']')}, '', 'g'))"),
        "ratio_non_printable": "cast(0 as double)",
        "line_breaks": count(text, "\n"),
        "one_letter_words": rf"len(list_filter({words}, lambda k: regexp_matches(k, '^\p{{L}}$')))",
        "weird_alnum_tokens": rf"len(list_filter({tokens}, lambda k: regexp_matches(k, '[{P.LATIN}]') and regexp_matches(k, '\d') and not regexp_matches(k, '(?i)^(?:\d+[/-]\d+|[A-Z]{{1,4}}\d+|\d+[A-Z]{{1,4}})$')))",
        "repeated_char_tokens": f"len(list_filter({tokens}, lambda k: regexp_matches(k, {quote(same_runs(5))})))",
        "near_empty_lines": f"len(list_filter({lines}, lambda k: length(k) between 1 and 2))",
        "symbol_only_lines": f"len(list_filter({lines}, lambda k: regexp_matches(k, '^[^{P.LATIN}0-9]+$')))",
        "legal_terms_count": count(text, legal_terms()),
        "normal_word_ratio": f"(cast({count(text, '[' + P.LATIN + ']{2,}')} as double) / greatest({word_count(text)}, 1))",
        "important_data_count": "(" + " + ".join(count(text, "(?i)" + p) for p in P.IMPORTANT.values()) + ")",
    }


def score() -> str:
    cap = lambda x: f"least({x}, 1.0::double)"
    words = "greatest(len_words, 1)::double"
    good = (
        f"0.18::double * {cap('len_chars / 2500::double')} + 0.12::double * {cap('len_words / 350::double')} + 0.18::double * {cap('ratio_alpha / 0.68::double')} + 0.18::double * {cap('normal_word_ratio / 0.78::double')}"
        f" + 0.20::double * {cap('legal_terms_count / 12::double')} + 0.14::double * {cap('important_data_count / 6::double')}"
    )
    bad = (
        f"0.22::double * {cap('ratio_rare_symbols / 0.04::double')} + 0.18::double * {cap('ratio_non_printable / 0.01::double')} + 0.18::double * {cap(f'one_letter_words / {words} / 0.20::double')}"
        f" + 0.18::double * {cap(f'weird_alnum_tokens / {words} / 0.08::double')} + 0.12::double * {cap(f'repeated_char_tokens / {words} / 0.05::double')}"
        f" + 0.12::double * {cap('symbol_only_lines / (line_breaks + 1)::double / 0.20::double')}"
    )
    return f"greatest(0.0::double, least(1.0::double, ({good}) * (1 - 0.55::double * ({bad}))))"


QUALITY_STATE = "(case when len_words < 80 or ocr_quality_score < 0.22 then 'irrecuperable' when ocr_quality_score < 0.42 then 'muy_ruidoso' when ocr_quality_score < 0.65 then 'regular' else 'legible' end)"
